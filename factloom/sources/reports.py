"""The canonical JSON report: written byte-stable from the relations, read back, and checked for closure."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.plans.model import ARTIFACT_KINDS, COMPONENT_KINDS, SEVERITIES, FactError, FactModel

#: Kinds in reports, and the greatest length of a text.
DEPENDENCY_KINDS = ("calls", "contains", "depends-on", "extends", "implements", "imports", "reads", "writes")
EVIDENCE_KINDS = ("configuration", "declaration", "metric", "reference", "relation")
TEXT_LIMIT = 1024
_LOC = "struct<endColumn:int,endLine:int,path:string,startColumn:int,startLine:int>"
_EXT = "map<string,array<string>>"
SCHEMA = f"""artifacts array<struct<extensions:{_EXT},id:string,kind:string,language:string,name:string,projectId:string,qualifiedName:string,repositoryPath:string>>,
components array<struct<artifactId:string,extensions:{_EXT},id:string,kind:string,language:string,location:{_LOC},name:string,qualifiedName:string>>,
dependencies array<struct<evidenceIds:array<string>,extensions:{_EXT},id:string,kind:string,sourceId:string,targetId:string>>,
evidences array<struct<extensions:{_EXT},id:string,kind:string,location:{_LOC},summary:string>>,
findings array<struct<evidenceIds:array<string>,extensions:{_EXT},fingerprint:string,id:string,location:{_LOC},message:string,rule:struct<id:string,version:string>,severity:string,subjectId:string>>,
metrics array<struct<extensions:{_EXT},id:string,key:string,scopeId:string,unit:string,value:decimal(38,18)>>,
project struct<extensions:{_EXT},id:string,identity:string,language:string,name:string,repositoryPath:string>,
schemaVersion string"""


def _loc(c: str) -> Column:
    l = F.col(c)
    return F.when(l.isNotNull(), F.struct(l["end_column"].alias("endColumn"), l["end_line"].alias("endLine"), l["path"].alias("path"), l["start_column"].alias("startColumn"), l["start_line"].alias("startLine"))).alias("location")


def _camel(c: str) -> str:
    head, *rest = c.split("_")
    return head + "".join(x.title() for x in rest)


def to_json(f: FactModel, findings: DataFrame) -> DataFrame:
    """project_id, body: one canonical JSON document per project; members in alphabetical order, arrays by id.

    A report is one document, so one project's relations meet in one row; a project's size is bounded by its budgets.
    """
    ext = F.map_from_entries(F.array_sort(F.map_entries("extensions"))).alias("extensions")

    def rows(df: DataFrame, name: str, cols: list[Column]) -> DataFrame:
        one = F.struct(F.col("id"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("j"))
        return df.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ",").alias(name))

    def cols(*names: str) -> list[Column]:
        special = {"extensions": ext, "location": _loc("location"), "rule": F.struct(F.col("rule_id").alias("id"), F.col("rule_version").alias("version")).alias("rule")}
        return [special.get(n, F.col(n).alias(_camel(n))) for n in sorted(names, key=_camel)]

    parts = [
        rows(f.artifact, "artifacts", cols("extensions", "id", "kind", "language", "name", "project_id", "qualified_name", "repository_path")),
        rows(f.component, "components", cols("artifact_id", "extensions", "id", "kind", "language", "location", "name", "qualified_name")),
        rows(f.dependency, "dependencies", cols("evidence_ids", "extensions", "id", "kind", "source_id", "target_id")),
        rows(f.evidence, "evidences", cols("extensions", "id", "kind", "location", "summary")),
        rows(findings, "findings", cols("evidence_ids", "extensions", "fingerprint", "id", "location", "message", "rule", "severity", "subject_id")),
    ]
    number = F.concat(F.lit('{"extensions":'), F.to_json(ext), F.lit(',"id":'), F.to_json(F.struct("id")).substr(7, 1 << 30))
    m = f.metric.select("project_id", "id", F.concat(F.regexp_replace(number, r"\}$", ""), F.lit(',"key":"'), "key", F.lit('","scopeId":"'), "scope_id", F.lit('","unit":"'), "unit", F.lit('","value":'), ident.decimal_text("value"), F.lit("}")).alias("j"))
    parts.append(m.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "j"))), lambda x: x["j"]), ",").alias("metrics")))
    p = f.project.select("project_id", F.to_json(F.struct(ext, F.col("project_id").alias("id"), "identity", "language", "name", F.col("repository_path").alias("repositoryPath")), {"ignoreNullFields": "false"}).alias("project"))
    for x in parts:
        p = p.join(x, "project_id", "left")
    body = F.concat(F.lit("{"), *(y for n in ("artifacts", "components", "dependencies", "evidences", "findings", "metrics") for y in (F.lit(f'"{n}":['), F.coalesce(n, F.lit("")), F.lit("],"))), F.lit('"project":'), "project", F.lit(f',"schemaVersion":"{ident.SCHEMA_VERSION}"}}'))
    return p.select("project_id", body.alias("body"))


def read(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The parsed reports of a column of bodies; null where a body is not readable."""
    return bodies.select(F.from_json(body, SCHEMA).alias("r"), F.col(body).alias("body"))


def problems(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, reasons: the sorted reasons why a report is not valid; none for a valid one.

    Checked are members and their kinds, id and key patterns, text limits, location ranges, unique ids, and that every id
    referred to is there.
    """
    r = bodies.select(F.col(key).alias("key"), F.from_json(body, SCHEMA).alias("r"), F.try_parse_json(F.col(body)).alias("v"))
    g = lambda n: F.col(f"r.{n}")
    lists = ("artifacts", "components", "dependencies", "evidences", "findings", "metrics")
    ids = lambda n: F.transform(g(n), lambda x: x["id"])
    reason = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), text)
    every = lambda n, f: F.forall(g(n), f)
    pattern = lambda kind: rf"^{kind}_[0-9a-f]{{64}}$"
    path_ok = lambda c: ident.norm_path(c).isNotNull()
    ext_ok = lambda x: F.forall(F.map_entries(x["extensions"]), lambda e: e["key"].rlike(ident.NAMESPACED) & (F.size(e["value"]) > 0))
    loc_ok = lambda x: x["location"].isNull() | ((x["location"]["endLine"] > x["location"]["startLine"]) | ((x["location"]["endLine"] == x["location"]["startLine"]) & (x["location"]["endColumn"] >= x["location"]["startColumn"])))
    known = {"artifacts": "extensions id kind language name projectId qualifiedName repositoryPath", "components": "artifactId extensions id kind language location name qualifiedName", "dependencies": "evidenceIds extensions id kind sourceId targetId", "evidences": "extensions id kind location summary", "findings": "evidenceIds extensions fingerprint id location message rule severity subjectId", "metrics": "extensions id key scopeId unit value"}
    members = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    root = [*lists, "project", "schemaVersion"]
    keys_of = lambda path: F.map_keys(F.try_variant_get("v", path, "map<string,variant>"))
    only = lambda ks, names: F.size(F.array_except(ks, F.array(*map(F.lit, names)))) == 0
    extra = [reason(only(members, root) & only(keys_of("$.project"), ["extensions", "id", "identity", "language", "name", "repositoryPath"]), "additional properties")]
    for n in lists:
        rows = F.try_variant_get("v", f"$.{n}", "array<variant>")
        allowed = known[n].split()
        extra.append(reason(F.forall(rows, lambda x: only(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), allowed)), "additional properties"))
    targets = F.concat(F.array(g("project.id")), ids("artifacts"), ids("components"), ids("dependencies"))
    all_ids = F.concat(targets, ids("evidences"), ids("findings"), ids("metrics"))
    checks = [
        reason(F.size(F.array_except(F.array(*map(F.lit, root)), members)) == 0, "required"), *extra,
        reason(g("schemaVersion") == ident.SCHEMA_VERSION, "const"),
        reason(every("artifacts", lambda x: x["kind"].isin(*ARTIFACT_KINDS)) & every("components", lambda x: x["kind"].isin(*COMPONENT_KINDS)) & every("dependencies", lambda x: x["kind"].isin(*DEPENDENCY_KINDS)) & every("evidences", lambda x: x["kind"].isin(*EVIDENCE_KINDS)) & every("findings", lambda x: x["severity"].isin(*SEVERITIES)), "enum"),
        reason(g("project.id").rlike(pattern("project")) & every("artifacts", lambda x: x["id"].rlike(pattern("artifact")) & path_ok(x["repositoryPath"])) & every("components", lambda x: x["id"].rlike(pattern("component"))) & every("dependencies", lambda x: x["id"].rlike(pattern("dependency"))) & every("evidences", lambda x: x["id"].rlike(pattern("evidence")) & path_ok(x["location"]["path"])) & every("findings", lambda x: x["id"].rlike(pattern("finding")) & x["fingerprint"].rlike("^[0-9a-f]{64}$")) & every("metrics", lambda x: x["id"].rlike(pattern("metric"))) & path_ok(g("project.repositoryPath")), "regex pattern"),
        *(reason(every(n, ext_ok), "pattern") for n in lists), *(reason(every(n, loc_ok), "end") for n in ("components", "evidences", "findings")),
        reason(every("findings", lambda x: F.length(x["message"]) <= TEXT_LIMIT), "maximum length"),
        reason(F.size(F.array_distinct(all_ids)) == F.size(all_ids), "duplicate id"),
        reason(every("artifacts", lambda x: x["projectId"] == g("project.id")), "unknown project"),
        reason(every("components", lambda x: F.array_contains(ids("artifacts"), x["artifactId"])), "unknown artifact"),
        reason(every("dependencies", lambda x: F.array_contains(ids("components"), x["sourceId"]) & F.array_contains(ids("components"), x["targetId"])), "unknown component"),
        reason(every("dependencies", lambda x: (F.size(x["evidenceIds"]) > 0) & (F.size(F.array_except(x["evidenceIds"], ids("evidences"))) == 0)) & every("findings", lambda x: (F.size(x["evidenceIds"]) > 0) & (F.size(F.array_except(x["evidenceIds"], ids("evidences"))) == 0)), "unknown evidence"),
        reason(every("metrics", lambda x: F.array_contains(F.concat(targets, ids("findings")), x["scopeId"])), "unknown scope"),
        reason(every("findings", lambda x: F.array_contains(targets, x["subjectId"])), "unknown subject"),
    ]
    reasons = F.when(g("project").isNull() & F.col("v").isNull(), F.array(F.lit("not readable"))).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.array(*checks)))))
    return r.select("key", reasons.alias("reasons"))


def write_atomic(path: str | Path, body: bytes, limit: int = 52_428_800) -> None:
    """Puts body in place of the file at once: written beside it, synced, then renamed. Refuses links and missing folders."""
    p = Path(path)
    if len(body) > limit:
        raise FactError("report.limit.bytes")
    if p.is_symlink() or (p.exists() and not p.is_file()) or not p.parent.is_dir() or p.parent.is_symlink():
        raise FactError("report.write.failed")
    fd, tmp = tempfile.mkstemp(dir=p.parent, prefix=".report-")
    try:
        with os.fdopen(fd, "wb") as out:
            out.write(body)
            out.flush()
            os.fsync(out.fileno())
        os.replace(tmp, p)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return read(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))
