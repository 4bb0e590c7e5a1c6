"""POM files to facts: parsed without document types or entities, with line numbers, local parents, and edges between modules and libraries."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.plans.model import ARTIFACT, COMPONENT, DEPENDENCY, EVIDENCE
from factloom.session import cut
from factloom.sources.discovery import PARSE_DIAGNOSTIC
from factloom.sources.javafacts import LANGUAGE, _extensions
from factloom.sources.poms import coordinates, interpolate

_DEPENDENCY = "struct<group_id:string,artifact_id:string,dep_version:string,dep_scope:string,line_no:int>"
RAW = f"group_id string, artifact_id string, pom_version string, parent_group_id string, parent_artifact_id string, parent_version string, parent_relative_path string, pom_properties map<string,string>, dependencies array<{_DEPENDENCY}>"
_FIELDS = {
    ("project", "groupId"): "group_id", ("project", "artifactId"): "artifact_id", ("project", "version"): "pom_version", ("project", "parent", "groupId"): "parent_group_id",
    ("project", "parent", "artifactId"): "parent_artifact_id", ("project", "parent", "version"): "parent_version", ("project", "parent", "relativePath"): "parent_relative_path",
}
_OF_DEPENDENCY = {"groupId": "group_id", "artifactId": "artifact_id", "version": "dep_version", "scope": "dep_scope"}
_DIRECT = ["project", "dependencies", "dependency"]


def read_pom(text: str | bytes) -> dict | None:
    """The raw values of a POM; None if it is not well-formed or has a document type or an entity of its own.

    Only project/dependencies/dependency counts as a direct dependency; line_no is the line where it begins. A declared but empty
    relativePath is '', a missing one None.
    """
    out: dict = {"pom_properties": {}, "dependencies": []}
    path: list[str] = []
    dependency: dict | None = None
    parser = expat.ParserCreate()

    def refuse(*_):
        raise ValueError("document types and entities are refused")

    def start(name: str, _attributes) -> None:
        nonlocal dependency
        path.append(name.rpartition(":")[2])
        if path == _DIRECT:
            dependency = {"line_no": parser.CurrentLineNumber}
        elif _FIELDS.get(tuple(path)) == "parent_relative_path":
            out.setdefault("parent_relative_path", "")

    def end(_name) -> None:
        nonlocal dependency
        if path == _DIRECT:
            out["dependencies"].append(dependency)
            dependency = None
        path.pop()

    def said(text: str) -> None:
        value = text.strip()
        if not value:
            return
        if field := _FIELDS.get(tuple(path)):
            out[field] = (out.get(field) or "") + value
        elif len(path) == 3 and path[:2] == ["project", "properties"]:
            out["pom_properties"][path[2]] = out["pom_properties"].get(path[2], "") + value
        elif dependency is not None and len(path) == 4 and path[3] in _OF_DEPENDENCY:
            field = _OF_DEPENDENCY[path[3]]
            dependency[field] = dependency.get(field, "") + value

    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    try:
        parser.Parse(text.encode() if isinstance(text, str) else text, True)
    except (expat.ExpatError, ValueError):
        return None
    return out


def parsed(texts: DataFrame) -> DataFrame:
    """texts with the POM's raw values instead of the text, and valid: whether it could be read."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [n for n in texts.columns if n != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes if n != "text") + f", {RAW}, valid boolean"
    made = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_pom(t) for t in b.column("text").to_pylist()]
            full = [{**(g or {}), "valid": g is not None, "pom_properties": list((g or {}).get("pom_properties", {}).items())} for g in got]
            cols = [b.column(n) for n in keep] + [pa.array([g.get(f.name) for g in full], f.type) for f in made if f.name not in keep]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, made)], schema=made)

    return texts.where("text is not null").mapInArrow(run, schema)


def parent_path(path: Column, relative: Column, artifact: Column) -> Column:
    """Where a POM's local parent lies: '' outside the root, null if none is asked for. A missing relativePath means ../pom.xml."""
    rel = F.coalesce(relative, F.lit("../pom.xml"))
    folder = F.split(path, "/")
    steps = F.concat(F.slice(folder, F.lit(1), F.size(folder) - 1), F.split(F.replace(rel, F.lit("\\"), F.lit("/")), "/"))

    def walk(acc: Column, x: Column) -> Column:  # null once the root is left
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(acc.isNull(), acc).when(x == "..", up).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.when(artifact.isNull() | (F.trim(rel) == ""), None).otherwise(F.when(walked.isNull(), "").otherwise(F.array_join(walked, "/")))


def with_parents(poms: DataFrame, parents: DataFrame) -> DataFrame:
    """poms with the properties of their local parents added; a POM's own properties hold over them.

    poms: project_id, path and raw values; parents: project_id, path, pom_properties. Only one level is looked at.
    """
    at = poms.withColumn("_at", F.coalesce(parent_path(F.col("path"), F.col("parent_relative_path"), F.col("parent_artifact_id")), F.lit("")))
    above = parents.select("project_id", F.col("path").alias("_at"), F.col("pom_properties").alias("_above")).dropDuplicates(["project_id", "_at"])
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("pom_properties", none)
    kept = F.map_filter(F.coalesce("_above", none), lambda k, _: ~F.map_contains_key(own, k))
    return at.join(above, ["project_id", "_at"], "left").withColumn("pom_properties", F.map_concat(own, kept)).drop("_at", "_above")


def facts(poms: DataFrame, modules: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(artifacts, components, dependencies, evidence, diagnostics) of the POMs of modules.

    poms: project_id, module_path, path and raw values, parents' properties included; modules: the module artifacts of the Java sources;
    projects: project_id, identity. A dependency on the coordinates of a module leads to it (of several modules to the last by path), any
    other to a library. Test scope is left out; a missing scope is compile.
    """
    sid = lambda kind, path, name: ident.stable_id(kind, "identity", F.lit(LANGUAGE), path, name)
    known = coordinates(poms.join(projects.select("project_id", "identity"), "project_id")).drop("group_id", "artifact_id")
    known = known.join(modules.select("project_id", F.col("repository_path").alias("module_path"), F.col("id").alias("artifact_id"), F.col("name").alias("artifact_name"), F.col("qualified_name").alias("artifact_qualified")), ["project_id", "module_path"])
    part = lambda i: F.split("pom_key", ":")[i]
    known = cut(known.withColumn("coordinate", F.when(F.col("pom_key").isNotNull(), F.concat_ws(":", "pom_key", "resolved_version"))))
    version = F.when(F.col("pom_key").isNotNull(), F.col("resolved_version"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    flag = lambda c: F.when(c, F.array(F.lit("true")))
    told = known.select("project_id", F.col("artifact_id").alias("id"), _extensions(
        ("maven.coordinate", one(F.col("coordinate"))), ("maven.group-id", one(part(0))), ("maven.artifact-id", one(part(1))), ("maven.version", one(version)),
        ("maven.version-unresolved", flag(F.col("pom_key").isNotNull() & F.col("resolved_version").isNull()))).alias("_more"))
    unknown = F.create_map(F.lit("maven.coordinate-unresolved"), F.array(F.lit("true")))
    more = F.when(F.col("_more").isNull() | (F.size("_more") == 0), unknown).otherwise(F.col("_more"))
    sources = modules.join(told, ["project_id", "id"], "left").withColumn("extensions", F.map_concat("extensions", more)).drop("_more")

    given = {"groupId": part(0), "artifactId": part(1), "version": version}
    extra = F.filter(F.array(*(F.named_struct(F.lit("key"), F.lit(f"{p}.{k}"), F.lit("value"), v) for p in ("project", "pom") for k, v in given.items())), lambda e: e["value"].isNotNull())
    kept = F.filter(F.map_entries("pom_properties"), lambda e: ~F.exists(extra, lambda x: x["key"] == e["key"]))
    rows = known.select("project_id", "identity", "module_path", "path", "artifact_id", "artifact_name", F.coalesce("coordinate", "artifact_qualified").alias("source_name"), F.map_from_entries(F.concat(kept, extra)).alias("_p"), F.posexplode("dependencies").alias("pos", "d"))
    value = lambda n: interpolate(F.col(f"d.{n}"), F.col("_p"))
    rows = rows.select("*", F.col("d.line_no").alias("line"), F.coalesce(value("dep_scope"), F.lit("compile")).alias("scope"), value("group_id").alias("g"), value("artifact_id").alias("a"), value("dep_version").alias("v")).where("scope <> 'test'")
    rows = cut(rows.drop("_p", "d").withColumn("wanted", F.when(F.col("g").isNotNull() & F.col("a").isNotNull(), F.concat_ws(":", "g", "a", "v"))))
    good = rows.where("wanted is not null")
    of_module = known.where("pom_key is not null").groupBy("project_id", F.col("pom_key").alias("_ga")).agg(F.max_by(F.struct("artifact_id", "artifact_name", "path"), "module_path").alias("m"))
    good = good.withColumn("_ga", F.concat_ws(":", "g", "a")).join(of_module, ["project_id", "_ga"], "left")
    library = sid("artifact", F.lit("."), F.col("wanted"))
    good = cut(good.select("*", F.coalesce("m.artifact_id", library).alias("target_artifact"), F.coalesce("m.artifact_name", "a").alias("target_label"), F.col("m.path").alias("target_path"), F.col("m").isNull().alias("external")))

    # a module's component is named by the dependency that touches it first, in the order of module paths
    ends = rows.select("project_id", "identity", F.col("artifact_id").alias("artifact"), F.col("artifact_name").alias("label"), F.col("path").alias("at"), F.struct("module_path", "pos", F.lit(0).alias("role")).alias("turn"), F.col("source_name").alias("named"))
    ends = ends.unionByName(good.select("project_id", "identity", F.col("target_artifact").alias("artifact"), F.col("target_label").alias("label"), F.coalesce("target_path", F.lit(".")).alias("at"), F.struct("module_path", "pos", F.lit(1).alias("role")).alias("turn"), F.col("wanted").alias("named")))
    touched = ends.groupBy("project_id", "identity", "artifact").agg(F.min_by(F.struct("label", "at", "named"), "turn").alias("m")).select("project_id", "identity", "artifact", "m.*")
    touched = cut(touched.withColumn("id", sid("component", F.col("at"), F.col("named"))))
    spot = lambda path, line: F.struct(path.alias("path"), line.alias("start_line"), F.lit(1).alias("start_column"), line.alias("end_line"), F.lit(1).alias("end_column"))
    component = touched.select(
        "project_id", "id", F.col("artifact").alias("artifact_id"), F.lit("module").alias("kind"), F.col("label").alias("name"), F.lit(LANGUAGE).alias("language"), F.col("named").alias("qualified_name"),
        F.when(F.col("at") != ".", spot(F.col("at"), F.lit(1))).alias("location"), F.create_map(F.lit("maven.module-component"), F.array(F.lit("true"))).alias("extensions"))

    side = lambda key, to: touched.select("project_id", F.col("artifact").alias(key), F.col("id").alias(f"{to}_id"), F.col("named").alias(f"{to}_named"))
    links = good.join(side("artifact_id", "source"), ["project_id", "artifact_id"]).join(side("target_artifact", "target"), ["project_id", "target_artifact"])
    proof = sid("evidence", F.col("path"), F.concat_ws("|", "source_named", F.lit("maven"), "wanted", F.col("line").cast("string")))
    links = cut(links.withColumn("evidence_id", proof))
    dependency = links.groupBy("project_id", "identity", "source_id", "target_id", "source_named", "target_named", "path").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.array_sort(F.collect_set("scope")).alias("scopes")
    ).select("project_id", sid("dependency", F.col("path"), F.concat_ws("|", "source_named", F.lit("depends-on"), "target_named")).alias("id"), "source_id", "target_id", F.lit("depends-on").alias("kind"), "evidence_ids", _extensions(("maven.scope", F.col("scopes"))).alias("extensions"))
    first = links.groupBy("project_id", "evidence_id").agg(F.min_by(F.struct("scope", "wanted", "path", "line"), "pos").alias("m")).select("project_id", "evidence_id", "m.*")
    evidence = first.select(
        "project_id", F.col("evidence_id").alias("id"), F.lit("configuration").alias("kind"), F.concat(F.lit("Maven module declares direct "), "scope", F.lit(" dependency "), "wanted").alias("summary"),
        spot(F.col("path"), F.col("line")).alias("location"), F.create_map(F.lit("maven.scope"), F.array("scope")).alias("extensions"))
    outside = good.where("external").groupBy("project_id", F.col("target_artifact").alias("id")).agg(F.min(F.struct("wanted", "g", "a", "v")).alias("m")).select("project_id", "id", "m.*")
    libraries = outside.select("project_id", "id", F.lit("library").alias("kind"), F.col("a").alias("name"), F.lit(LANGUAGE).alias("language"), F.lit(".").alias("repository_path"), F.col("wanted").alias("qualified_name"), _extensions(
        ("maven.coordinate", F.array("wanted")), ("maven.external", F.array(F.lit("true"))), ("maven.group-id", F.array("g")), ("maven.artifact-id", F.array("a")), ("maven.version", one(F.col("v"))), ("maven.version-unresolved", flag(F.col("v").isNull()))).alias("extensions"))

    left_root = parent_path(F.col("path"), F.col("parent_relative_path"), F.col("parent_artifact_id")) == ""
    said = lambda df, code, line, message: df.select("project_id", F.lit(code).alias("code"), "path", line.alias("line"), F.lit(1).alias("column"), F.lit(message).alias("message"))
    diagnostics = said(known.where(left_root), "maven.parent.outside-root", F.lit(1), "local parent POM path leaves the repository root").unionByName(
        said(rows.where("wanted is null"), "maven.dependency.unresolved", F.col("line"), "direct dependency Maven G:A could not be resolved"))
    shaped = lambda df, schema: df.to(df.sparkSession.createDataFrame([], schema).schema)
    return (shaped(sources.unionByName(libraries), ARTIFACT), shaped(component, COMPONENT), shaped(dependency, DEPENDENCY), shaped(evidence, EVIDENCE), shaped(diagnostics, PARSE_DIAGNOSTIC))
