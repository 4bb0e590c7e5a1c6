"""Facts of Java sources: components, metrics, evidence and dependencies of all files of all projects, as one plan of joins.

Each file is read once, by itself (see javasource). What needs other files - unique names, types and annotations that names stand
for, sums per type and module, folded edges - is done by joins and aggregations over the whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import ident
from factloom.operators import names
from factloom.plans.model import ARTIFACT, COMPONENT, DEPENDENCY, EVIDENCE, METRIC, PROJECT, FactModel
from factloom.session import cut
from factloom.sources.discovery import PARSE_DIAGNOSTIC

LANGUAGE = "java"
#: Fixed values of the model: annotations that are known without their source, and those that mark generated code.
EXTERNAL = (
    "org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController", "org.springframework.stereotype.Repository", "org.springframework.stereotype.Service",
    "javax.annotation.Generated", "javax.annotation.processing.Generated", "jakarta.annotation.Generated",
    "java.lang.Deprecated", "java.lang.Override", "java.lang.SafeVarargs", "java.lang.SuppressWarnings", "java.lang.FunctionalInterface",
)
GENERATED = tuple(n for n in EXTERNAL if n.endswith(".Generated"))
_SPAN = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
_NOTES = f"array<struct<name:string,span:{_SPAN}>>"
_CALLABLE = f"struct<name:string,signature:string,kind:string,modifiers:array<string>,annotations:{_NOTES},span:{_SPAN},complexity:int>"
_TYPE = f"struct<name:string,qualified:string,kind:string,nesting:string,modifiers:array<string>,annotations:{_NOTES},span:{_SPAN},callables:array<{_CALLABLE}>,references:array<struct<name:string,kind:string,span:{_SPAN}>>>"
_UNIT = f"package string, imports array<struct<name:string,static:boolean,wild:boolean>>, types array<{_TYPE}>, error struct<line:int,column:int>"


def parsed(files: DataFrame) -> DataFrame:
    """files (with a column text) with package, imports and types instead of the text, or error: the place that could not be read."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [n for n in files.columns if n != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes if n != "text") + ", " + _UNIT
    made = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def unit(text: str) -> dict:
        from factloom.sources.javasource import Unreadable, declared

        span = lambda r: dict(zip(("start_line", "start_column", "end_line", "end_column"), r))
        notes = lambda x: [{"name": a.name, "span": span(a.range)} for a in x]
        try:
            u = declared(text)
        except (Unreadable, RecursionError) as e:
            return {"error": {"line": getattr(e, "line", 1), "column": getattr(e, "column", 1)}}
        types = [
            {"name": t.name, "qualified": t.qualified, "kind": t.kind, "nesting": t.nesting, "modifiers": t.modifiers, "annotations": notes(t.annotations), "span": span(t.range),
             "callables": [{"name": c.name, "signature": c.signature, "kind": c.kind, "modifiers": c.modifiers, "annotations": notes(c.annotations), "span": span(c.range), "complexity": c.complexity} for c in t.callables],
             "references": [{"name": r.name, "kind": r.kind, "span": span(r.range)} for r in t.references]}
            for t in u.types
        ]
        return {"package": u.package, "imports": [{"name": n, "static": s, "wild": w} for n, s, w in u.imports], "types": types}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unit(t) for t in b.column("text").to_pylist()]
            cols = [b.column(n) for n in keep] + [pa.array([g.get(f.name) for g in got], f.type) for f in made if f.name not in keep]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, made)], schema=made)

    return files.where("text is not null").mapInArrow(run, schema)


def _at(path: Column | str, span: str) -> Column:
    return F.struct((F.col(path) if isinstance(path, str) else path).alias("path"), *(F.col(f"{span}.{p}").alias(p) for p in ("start_line", "start_column", "end_line", "end_column")))


def type_candidates(name: Column, qualified: Column, package: Column, imports: Column) -> Column:
    """The qualified names that a name in a type may stand for, in the order in which they are tried.

    The name as it is; below each dotted prefix of the type's own name, longest first; in the package; by the imports as they stand.
    """
    parts = F.split(qualified, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "."))
    around = F.transform(F.filter(prefixes, lambda p: p != ""), lambda p: F.concat(p, F.lit("."), name))
    near = F.when(package == "", name).otherwise(F.concat(package, F.lit("."), name))

    def imported(i: Column) -> Column:
        simple = F.element_at(F.split(i["name"], r"\."), -1)
        below = F.when(name.startswith(F.concat(simple, F.lit("."))), F.concat(i["name"], F.substring(name, F.length(simple) + 1, F.length(name))))
        return F.when(i["wild"], F.concat(i["name"], F.lit("."), name)).when(name == simple, i["name"]).otherwise(below)

    by_import = F.array_compact(F.transform(F.filter(imports, lambda i: ~i["static"]), imported))
    return F.concat(F.array(name), around, F.array(near), by_import)


_SCOPE = "\u0001"


def resolve_annotations(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """uses (project_id, use, name, package, imports) with target, the qualified name of the annotation; null if it is not certain.

    A dotted name stands for itself; else an import of that name, an annotation type of the package, a known one of java.lang, and the
    only hit among the wildcard imports. declared: project_id, name of annotation types.
    """
    name = F.col("name")
    plain = F.filter("imports", lambda i: ~i["static"] & ~i["wild"] & i["name"].endswith(F.concat(F.lit("."), name)))
    wild = F.transform(F.filter("imports", lambda i: ~i["static"] & i["wild"]), lambda i: F.concat(i["name"], F.lit("."), name))
    sure = F.when(name.contains("."), name).otherwise(F.get(plain, 0)["name"])
    near = F.when(F.col("package") == "", name).otherwise(F.concat("package", F.lit("."), name))
    marked = uses.withColumn("_sure", sure).withColumn("_near", near).withColumn("_wild", F.array_distinct(wild))
    tries = marked.where("_sure is null").select("project_id", "use", "_near", F.explode(F.array_distinct(F.concat(F.array("_near"), "_wild"))).alias("name"), "_wild")
    hits = tries.join(declared.distinct().withColumn("_known", F.lit(True)), ["project_id", "name"], "left")
    of_package = F.coalesce("_known", F.lit(False)) & (F.col("name") == F.col("_near"))
    by_wild = (F.coalesce("_known", F.lit(False)) | F.col("name").isin(*EXTERNAL)) & F.array_contains("_wild", F.col("name"))
    found = hits.groupBy("project_id", "use").agg(F.max(F.when(of_package, F.col("name"))).alias("_in"), F.collect_set(F.when(by_wild, F.col("name"))).alias("_hits"))
    lang = F.concat(F.lit("java.lang."), "name")
    target = F.coalesce("_sure", "_in", F.when(lang.isin(*EXTERNAL), lang), F.when(F.size("_hits") == 1, F.get("_hits", 0)))
    return marked.join(found, ["project_id", "use"], "left").withColumn("target", target).drop("_sure", "_near", "_wild", "_in", "_hits")


def _extensions(*entries: tuple[str, Column]) -> Column:
    """A map of the entries whose value is not null."""
    e = F.filter(F.array(*(F.named_struct(F.lit("key"), F.lit(k), F.lit("value"), v) for k, v in entries)), lambda x: x["value"].isNotNull())
    return F.map_from_entries(e).cast("map<string,array<string>>")


def facts(files: DataFrame, projects: DataFrame, namespace: str = "arch") -> tuple[FactModel, DataFrame]:
    """(the fact model, parse diagnostics) of files (project_id, path, module_path, text) of projects (project_id, identity, name).

    A qualified name that is declared more than once is dropped, with a diagnostic for each declaration. Null texts are no files; other
    columns are ignored. Empty tables give an empty model.
    """
    who = projects.select("project_id", "identity", F.col("name").alias("project_name"))
    units = cut(parsed(files.select("project_id", "path", "module_path", "text").join(who, "project_id")))
    sid = lambda kind, path, name: ident.stable_id(kind, "identity", F.lit(LANGUAGE), path, name)
    module_name = F.concat("identity", F.lit(":"), "module_path")
    all_types = units.select("project_id", "identity", "path", "module_path", "package", "imports", F.inline("types"))
    unique, repeated = names.unique_or_drop(all_types, ["project_id", "qualified"])
    pack = F.when(F.col("package") == "", "<default>").otherwise(F.col("package"))
    types = cut(unique.select(
        "project_id", "identity", "path", "module_path", "package", "imports", "name", "qualified", "kind", "nesting", "modifiers", "annotations", "callables", "references",
        _at("path", "span").alias("location"), sid("component", F.col("path"), F.col("qualified")).alias("id"), sid("artifact", F.col("module_path"), module_name).alias("artifact_id"),
    ))
    calls = types.select("project_id", "identity", "path", "package", "imports", "artifact_id", F.col("id").alias("owner_id"), F.col("qualified").alias("owner"), F.inline("callables"))
    calls = calls.withColumn("qualified", F.concat("owner", F.lit("#"), "signature")).withColumn("location", _at("path", "span"))
    calls = calls.withColumn("id", sid("component", F.col("path"), F.col("qualified")))

    # annotations of types and callables together
    common = ["project_id", "id", "path", "package", "imports", "annotations"]
    uses = types.select(*common).unionByName(calls.select(*common))
    uses = uses.select("project_id", "id", "path", "package", "imports", F.posexplode("annotations").alias("pos", "note"))
    uses = uses.select("project_id", F.concat("id", F.lit("/"), "pos").alias("use"), "id", "path", "package", "imports", F.col("note.name").alias("name"), F.col("note.span").alias("span"))
    seen = cut(resolve_annotations(uses, types.where("kind = 'annotation'").select("project_id", F.col("qualified").alias("name"))).select("project_id", "id", "path", "span", "target"))
    marks = cut(seen.groupBy("project_id", "id").agg(F.array_sort(F.collect_set("target")).alias("marks"), F.max(F.col("target").isNull()).alias("open")))

    def noted(rows: DataFrame) -> DataFrame:
        out = rows.join(marks, ["project_id", "id"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))
        return out.withColumn("generated", F.exists("marks", lambda m: m.isin(*GENERATED)))

    shared = lambda qualified: [
        ("java.package", F.array(pack)), ("java.modifiers", F.when(F.size("modifiers") > 0, F.col("modifiers"))), ("java.annotations", F.when(F.size("marks") > 0, F.col("marks"))),
        ("java.annotation-resolution", F.array(F.when(F.col("open"), "incomplete").otherwise("complete"))), ("java.generated", F.when(F.col("generated"), F.array(F.lit("true")))),
        (f"{namespace}.declaration-evidence-id", F.array(sid("evidence", F.col("path"), F.concat(qualified, F.lit("|declaration"))))),
    ]
    full_types, full_calls = cut(noted(types.drop("callables", "references"))), cut(noted(calls))
    columns = lambda kind, name, extra: [
        "project_id", "id", "artifact_id", F.lit(kind).alias("kind"), name.alias("name"), F.lit(LANGUAGE).alias("language"), F.col("qualified").alias("qualified_name"), "location",
        _extensions(("java.declaration-kind", F.array("kind")), *extra, *shared("qualified")).alias("extensions")]
    component = full_types.select(*columns("type", F.col("name"), [("java.nesting", F.array("nesting"))])).unionByName(
        full_calls.select(*columns("function", F.col("name"), [("java.owner-component-id", F.array("owner_id"))])))

    # complexity: of a callable, summed per type and module; types and modules without callables keep a row of 0
    measured = full_calls.where("not generated").join(full_types.where("not generated").select("project_id", F.col("id").alias("owner_id")), ["project_id", "owner_id"], "left_semi")
    of_call = measured.select("project_id", "identity", "path", "id", "qualified", "location", F.col("complexity").cast("long").alias("value"))
    per_type = measured.groupBy("project_id", F.col("owner_id").alias("id")).agg(F.sum("complexity").alias("value"))
    of_type = full_types.where("not generated").join(per_type, ["project_id", "id"], "left").select("project_id", "identity", "path", "id", "artifact_id", "qualified", "location", F.coalesce("value", F.lit(0)).alias("value"))
    modules = units.select("project_id", "identity", "project_name", "module_path").distinct().withColumn("id", sid("artifact", F.col("module_path"), module_name)).withColumn("qualified", module_name)
    sums = of_type.groupBy("project_id", F.col("artifact_id").alias("id")).agg(F.sum("value").alias("value"))
    firsts = full_types.groupBy("project_id", F.col("artifact_id").alias("id")).agg(F.min("location").alias("location"))
    pom = F.when(F.col("module_path") == ".", "pom.xml").otherwise(F.concat("module_path", F.lit("/pom.xml")))
    start = F.struct(pom.alias("path"), *(F.lit(1).alias(p) for p in ("start_line", "start_column", "end_line", "end_column")))
    of_module = modules.join(sums, ["project_id", "id"], "left").join(firsts, ["project_id", "id"], "left").withColumn("location", F.coalesce("location", start)).select(
        "project_id", "identity", F.col("location.path").alias("path"), "id", "qualified", "location", F.coalesce("value", F.lit(0)).alias("value"))
    measures = cut(of_call.unionByName(of_type.drop("artifact_id")).unionByName(of_module))
    key = "complexity.cyclomatic"
    proof = sid("evidence", F.col("path"), F.concat("qualified", F.lit(f"|{key}|"), F.col("value").cast("string")))
    metric = measures.select(
        "project_id", sid("metric", F.col("path"), F.concat("qualified", F.lit(f"|{key}"))).alias("id"), F.col("id").alias("scope_id"), F.lit(key).alias("key"), F.col("value").cast("decimal(38,18)").alias("value"),
        F.lit("count").alias("unit"), _extensions((f"{namespace}.evidence-id", F.array(proof))).alias("extensions"))

    # references: the first candidate that is a type of the project; a type does not depend on itself
    refs = types.select("project_id", "identity", "path", "id", "qualified", "package", "imports", F.posexplode("references").alias("pos", "r"))
    refs = cut(refs.select(F.concat_ws(_SCOPE, "project_id", "id", "pos").alias("ref"), "project_id", "identity", "path", F.col("id").alias("source_id"), "qualified", F.col("r.kind").alias("kind"), F.col("r.span").alias("span"),
               type_candidates(F.col("r.name"), F.col("qualified"), F.col("package"), F.col("imports")).alias("candidates")))
    scoped = lambda n: F.concat(F.col("project_id"), F.lit(_SCOPE), n)
    hits = names.resolve_ranked(
        refs.select("ref", F.transform("candidates", lambda c: F.concat(F.col("project_id"), F.lit(_SCOPE), c)).alias("candidates")),
        types.select(scoped(F.col("qualified")).alias("name"), F.struct("id", "qualified").alias("target")))
    links = refs.join(hits.select("ref", F.col("target.id").alias("target_id"), F.col("target.qualified").alias("target_name")), "ref").where("source_id <> target_id")
    spot = F.concat(F.col("span.start_line"), F.lit(":"), F.col("span.start_column"), F.lit("-"), F.col("span.end_line"), F.lit(":"), F.col("span.end_column"))
    links = cut(links.withColumn("evidence_id", sid("evidence", F.col("path"), F.concat_ws("|", "qualified", "kind", "target_name", spot))))
    edge = sid("dependency", F.col("path"), F.concat_ws("|", "qualified", "kind", "target_name"))
    no_extensions = F.create_map().cast("map<string,array<string>>")
    dependency = links.groupBy("project_id", "identity", "path", "qualified", "source_id", "kind", "target_id", "target_name").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")).select(
        "project_id", edge.alias("id"), "source_id", "target_id", "kind", "evidence_ids", no_extensions.alias("extensions"))

    of = lambda rows, i, kind, summary, location: rows.select("project_id", i.alias("id"), kind.alias("kind"), summary.alias("summary"), location.alias("location"), no_extensions.alias("extensions"))
    declared = lambda rows: of(rows, sid("evidence", F.col("path"), F.concat("qualified", F.lit("|declaration"))), F.lit("declaration"), F.concat(F.lit("Declaration of "), "qualified"), F.col("location"))
    verb = F.when(F.col("kind").isin("extends", "implements"), F.col("kind")).otherwise("references")
    evidence = (
        declared(full_types).unionByName(declared(full_calls))
        .unionByName(of(measures, proof, F.lit("metric"), F.concat(F.lit("Cyclomatic complexity for "), "qualified", F.lit(" is "), F.col("value").cast("string")), F.col("location")))
        .unionByName(of(links, F.col("evidence_id"), F.when(F.col("kind") == "depends-on", "reference").otherwise("relation"), F.concat_ws(" ", "qualified", verb, "target_name"), _at("path", "span")))
        .dropDuplicates(["project_id", "id"])
    )
    artifact = modules.select(
        "project_id", "id", F.lit("module").alias("kind"), F.when(F.col("module_path") == ".", F.col("project_name")).otherwise(ident.last_segment("module_path")).alias("name"), F.lit(LANGUAGE).alias("language"),
        F.col("module_path").alias("repository_path"), F.col("qualified").alias("qualified_name"), _extensions(("java.source-set", F.array(F.lit("main"))), ("maven.module-path", F.array("module_path"))).alias("extensions"))
    project = projects.select("project_id", "identity", "name", F.lit(LANGUAGE).alias("language"), F.lit(".").alias("repository_path"), no_extensions.alias("extensions"))

    said = lambda rows, code, line, column, message: rows.select("project_id", F.lit(code).alias("code"), "path", line.alias("line"), column.alias("column"), F.lit(message).alias("message"))
    diagnostics = (
        said(units.where("error is not null"), "java.syntax.invalid", F.col("error.line"), F.col("error.column"), "Java syntax is invalid")
        .unionByName(said(repeated, "java.type.duplicate", F.col("span.start_line"), F.col("span.start_column"), "duplicate qualified type declaration was skipped"))
        .unionByName(said(seen.where("target is null"), "java.annotation.unresolved", F.col("span.start_line"), F.col("span.start_column"), "annotation name could not be resolved deterministically"))
    )
    shaped = lambda df, schema: df.to(df.sparkSession.createDataFrame([], schema).schema)
    model = FactModel(*(shaped(d, s) for d, s in ((project, PROJECT), (artifact, ARTIFACT), (component, COMPONENT), (dependency, DEPENDENCY), (evidence, EVIDENCE), (metric, METRIC))))
    return model, shaped(diagnostics, PARSE_DIAGNOSTIC)
