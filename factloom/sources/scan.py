"""A repository folder to the fact model: Java sources and POMs, with all diagnostics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.model import FactModel
from factloom.session import cut
from factloom.sources import discovery, javafacts, mavenfacts
from factloom.sources.discovery import PARSE_DIAGNOSTIC, ScanLimits


def scan(spark: SparkSession, root: str, identity: str, name: str, limits: ScanLimits = ScanLimits()) -> tuple[FactModel, DataFrame]:
    """(fact model, parse diagnostics) of one folder. The executors have to reach it."""
    found = discovery.discover(root, limits)
    pid = identity
    projects = spark.createDataFrame([(pid, identity, name)], "project_id string, identity string, name string")
    paths = spark.createDataFrame([(pid, p, m) for p, m, _ in found.files], "project_id string, path string, module_path string")
    texts, unread = discovery.read_texts(spark, root, paths, limit=limits.max_file_bytes)
    model, diagnostics = javafacts.facts(texts, projects)
    walked = spark.createDataFrame([(pid, *d) for d in found.diagnostics], PARSE_DIAGNOSTIC)
    diagnostics = walked.unionByName(unread.to(walked.schema)).unionByName(diagnostics)

    module = lambda p: p[: -len("/pom.xml")] if "/" in p else "."
    pom_paths = spark.createDataFrame([(pid, p, module(p)) for p in found.poms], "project_id string, path string, module_path string")
    read, bad = discovery.read_texts(spark, root, pom_paths, "maven", limits.max_file_bytes)
    poms = cut(mavenfacts.parsed(read))
    code = F.when(F.col("code") == "maven.limit.file-bytes", "maven.pom.too-large").when(F.col("code").startswith("maven.path"), "maven.pom.unsafe").otherwise("maven.pom.invalid")
    invalid = poms.where("not valid").select("project_id", F.lit("maven.pom.invalid").alias("code"), "path", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("module POM could not be parsed safely").alias("message"))
    poms = poms.where("valid").drop("valid")
    above = mavenfacts.parent_path(F.col("path"), F.col("parent_relative_path"), F.col("parent_artifact_id"))
    wanted = poms.select("project_id", above.alias("path")).where("path <> ''").distinct()
    parent_texts, _ = discovery.read_texts(spark, root, wanted, "maven", limits.max_file_bytes)  # a parent that is not there is none
    parents = cut(mavenfacts.parsed(parent_texts))
    artifact, component, dependency, evidence, maven = mavenfacts.facts(mavenfacts.with_parents(poms, parents.where("valid")), model.artifact, projects)
    broken = poms.select("project_id", "path", above.alias("_at")).join(parents.where("not valid").select("project_id", F.col("path").alias("_at")), ["project_id", "_at"]).select(
        "project_id", F.lit("maven.parent.invalid").alias("code"), "path", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("local parent POM could not be parsed safely").alias("message"))
    for more in (bad.withColumn("code", code), invalid, broken, maven):
        diagnostics = diagnostics.unionByName(more.to(walked.schema))
    model = replace(
        model, artifact=artifact, component=model.component.unionByName(component), dependency=model.dependency.unionByName(dependency),
        evidence=model.evidence.unionByName(evidence).dropDuplicates(["project_id", "id"]))
    return model, diagnostics
