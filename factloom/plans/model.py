"""The fact model: seven relations with content-addressed keys, each a DataFrame with project_id in every key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

LOCATION = "struct<path:string,start_line:int,start_column:int,end_line:int,end_column:int>"
EXTENSIONS = "map<string,array<string>>"
PROJECT = f"project_id string, identity string, name string, language string, repository_path string, extensions {EXTENSIONS}"
ARTIFACT = f"project_id string, id string, kind string, name string, language string, repository_path string, qualified_name string, extensions {EXTENSIONS}"
COMPONENT = f"project_id string, id string, artifact_id string, kind string, name string, language string, qualified_name string, location {LOCATION}, extensions {EXTENSIONS}"
DEPENDENCY = f"project_id string, id string, source_id string, target_id string, kind string, evidence_ids array<string>, extensions {EXTENSIONS}"
METRIC = f"project_id string, id string, scope_id string, key string, value decimal(38,18), unit string, extensions {EXTENSIONS}"
EVIDENCE = f"project_id string, id string, kind string, summary string, location {LOCATION}, extensions {EXTENSIONS}"
FINDING = f"project_id string, id string, fingerprint string, rule_id string, rule_version string, severity string, subject_id string, message string, location {LOCATION}, evidence_ids array<string>, extensions {EXTENSIONS}"
DIAGNOSTIC = "project_id string, code string, subject_id string, message string"
#: The kinds of each relation, and severities in order.
ARTIFACT_KINDS = ("library", "application", "module", "package", "service")
COMPONENT_KINDS = ("type", "function", "module", "service", "package", "other")
SEVERITIES = ("info", "low", "medium", "high", "critical")


class FactError(ValueError):
    """A fatal check; `code` is its stable name."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Budgets of one project. They fail a run, they never truncate it. None stands for no limit."""

    max_nodes: int | None = 100_000
    max_edges: int | None = 1_000_000
    max_findings: int | None = 10_000


@dataclass(frozen=True)
class Links:
    """Dependencies of one project by small keys in place of ids, a row per dependency and evidence, for work on all of them at once.

    rows: source_key, target_key and what dress() needs; without dependencies on nodes that depend on nothing, as these lie on no
    cycle. dress() gives any of these rows project_id, source_id, source_qualified_name, dependency_id, evidence_id and location.
    named() gives rows with a node (a key) the id of the component.
    """

    rows: DataFrame
    dress: Callable[[DataFrame], DataFrame]
    named: Callable[[DataFrame], DataFrame]

    @staticmethod
    def graph(rows: DataFrame) -> DataFrame:
        """rows as edges; the project has an empty name here, as its id in each row would take more room than all else."""
        return rows.select(F.lit("").alias("project_id"), F.col("source_key").alias("source_id"), F.col("target_key").alias("target_id"))


@dataclass(frozen=True)
class FactModel:
    project: DataFrame
    artifact: DataFrame
    component: DataFrame
    dependency: DataFrame
    evidence: DataFrame
    metric: DataFrame

    def written(self) -> FactModel:
        """The same relations, each worked out once and written: a rule set reads them many times."""
        return replace(self, **{k: cut(v) for k, v in vars(self).items() if k not in ("edges", "links")})


@dataclass(frozen=True)
class JoinedModel(FactModel):
    """A fact model whose source joins edges by smaller keys than ids.

    edges: what edge_facts() gives, and the location of the first evidence.
    """

    edges: DataFrame
    links: Links


def violations(f: FactModel, limits: Limits | None = None) -> DataFrame:
    """project_id, code, subject_id: every broken integrity check, as rows; all checks are in one plan."""
    parts: list[DataFrame] = []

    def add(df: DataFrame, code: str, subject: str = "id") -> None:
        parts.append(df.select("project_id", F.lit(code).alias("code"), F.col(subject).alias("subject_id")))

    for name, df in (("artifact", f.artifact), ("component", f.component), ("evidence", f.evidence), ("dependency", f.dependency), ("metric", f.metric)):
        add(df.groupBy("project_id", "id").count().where("count > 1"), f"rule.input.duplicate-{name}")
    ids = lambda df, c="id": df.select("project_id", F.col(c).alias("_ref"))
    missing = lambda df, col, to: df.withColumn("_ref", F.col(col)).join(to, ["project_id", "_ref"], "left_anti")
    add(f.artifact.join(f.project.select("project_id"), "project_id", "left_anti"), "rule.input.dangling-artifact")
    add(missing(f.component, "artifact_id", ids(f.artifact)), "rule.input.dangling-component")
    scopes = ids(f.artifact).unionByName(ids(f.component)).unionByName(ids(f.dependency)).unionByName(f.project.select("project_id", F.col("project_id").alias("_ref")))
    add(missing(f.metric, "scope_id", scopes), "rule.input.dangling-metric")
    for end in ("source_id", "target_id"):
        add(missing(f.dependency, end, ids(f.component)), "rule.input.dangling-dependency")
    add(missing(f.dependency.withColumn("_e", F.explode("evidence_ids")), "_e", ids(f.evidence)), "rule.input.missing-evidence")
    packages = F.size(F.try_element_at("extensions", F.lit("java.package")))
    add(f.component.where((packages >= 0) & (packages != 1)), "rule.input.missing-package")
    coords = F.size(F.try_element_at("extensions", F.lit("maven.coordinate")))
    add(f.artifact.where((coords >= 0) & (coords != 1)), "rule.input.invalid-maven-coordinate")
    if limits:
        for df, most, code in ((f.component, limits.max_nodes, "rule.limit.nodes"), (f.dependency, limits.max_edges, "rule.limit.edges")):
            if most is not None:
                add(df.groupBy("project_id").count().where(F.col("count") > most), code, "project_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(f: FactModel, limits: Limits | None = None) -> None:
    """Raises the FactError of the first broken check (by code, then subject)."""
    bad = violations(f, limits).agg(F.min(F.struct("code", "subject_id")).alias("m")).first()[0]
    if bad is not None:
        raise FactError(bad["code"], bad["subject_id"] or "")


def component_facts(f: FactModel) -> DataFrame:
    """Components with the extension keys that rules read, each as a column."""
    ext = lambda k: F.try_element_at(F.col("extensions"), F.lit(k))
    return f.component.select(
        "project_id", "id", "artifact_id", F.col("kind").alias("component_kind"), "qualified_name",
        F.get(ext("java.package"), 0).alias("package"), F.coalesce(ext("java.annotations"), F.array().cast("array<string>")).alias("annotations"),
        (F.coalesce(ext("java.annotation-resolution"), F.array(F.lit("complete"))) == F.array(F.lit("complete"))).alias("resolved"),
        F.get(ext("java.declaration-kind"), 0).alias("declaration_kind"),
        F.get(F.flatten(F.transform(F.filter(F.map_entries("extensions"), lambda e: e["key"].endswith(".declaration-evidence-id")), lambda e: e["value"])), 0).alias("declaration_evidence_id"),
    )


def artifact_facts(f: FactModel) -> DataFrame:
    ext = lambda k: F.try_element_at(F.col("extensions"), F.lit(k))
    return f.artifact.select(
        "project_id", F.col("id").alias("artifact_id"), F.col("repository_path").alias("module_path"), F.col("qualified_name").alias("artifact_name"),
        F.get(ext("maven.coordinate"), 0).alias("coordinate"), ext("maven.coordinate-unresolved").isNotNull().alias("coordinate_unresolved"), ext("maven.version-unresolved").isNotNull().alias("version_unresolved"),
    )


def edge_facts(f: FactModel) -> DataFrame:
    """Dependencies with both components' facts and the target's artifact: the one join that five rules share."""
    if isinstance(f, JoinedModel):
        return f.edges
    c = component_facts(f)
    side = lambda p: c.select("project_id", *(F.col(x).alias(f"{p}_{x}") for x in c.columns if x != "project_id"))
    a = artifact_facts(f).withColumnRenamed("artifact_id", "target_artifact_id")
    return (
        f.dependency.select("project_id", F.col("id").alias("dependency_id"), "source_id", "target_id", F.col("kind").alias("dependency_kind"), "evidence_ids")
        .join(side("source"), ["project_id", "source_id"]).join(side("target"), ["project_id", "target_id"])
        .join(a, ["project_id", "target_artifact_id"])
    )

