"""Problem 3: deeply nested report bodies to related flat tables, by higher-order projections over variants.

A body is parsed once into a variant. Nested transforms carry the ancestors' keys and positions down, flatten joins the arrays
of all places where a kind of entity may stand, and one inline per target table emits its rows. There is no Python and no schema
inference; a body's layout only decides which branch of an expression is taken.

An expression has a fixed depth, bodies have not. What lies deeper - an extension key spread over more than KEY_LEVELS objects, a
report in more than two wrappings - is emitted as a row that holds the rest as text, and goes through the same expressions again
until no rest is left. So depth costs rounds over the few deep rows, and nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_observed

#: Levels of nested objects ("a": {"b": {"c": ...}}) that one round takes an extension key from.
KEY_LEVELS = 3
#: Fixed value of Spark: a variant holds no more bytes than this.
VARIANT_BYTES = 128 << 20
_ENTITY = "array<struct<id:string,parent:string,pos:int,body:variant>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, name: str) -> Column:
    return _get(v, f"$.{name}", "array<variant>")


def _entities(owner: Column, name: str, parent: Column) -> Column:
    """The entities under owner.name: a list of objects, one object, or an object keyed by ids."""
    member = _get(owner, f"$.{name}", "variant")
    one_id = _get(member, "$.id", "string")
    made = lambda i, p, b: F.struct(i.alias("id"), parent.alias("parent"), p.cast("int").alias("pos"), b.alias("body"))
    listed = F.transform(_get(member, "$", "array<variant>"), lambda x, p: made(_get(x, "$.id", "string"), p, x))
    keyed = F.transform(F.map_entries(_get(member, "$", "map<string,variant>")), lambda e, p: made(F.coalesce(_get(e["value"], "$.id", "string"), e["key"]), p, e["value"]))
    single = F.array(made(one_id, F.lit(0), member))
    out = F.when(one_id.isNotNull(), single).otherwise(F.coalesce(listed, keyed, F.array().cast(_ENTITY)))
    return F.filter(out, lambda e: e["id"].isNotNull() & _get(e["body"], "$", "map<string,variant>").isNotNull())


def _read(body: Column) -> Column:
    """The body as a variant; null if it is no JSON. A body too long for a variant fails the query, as it cannot be told from no JSON."""
    v = F.try_parse_json(body)
    long = v.isNull() & (F.octet_length(body) >= VARIANT_BYTES // 2)
    return F.when(long, F.raise_error(F.concat(F.lit("a report body is too long for a variant, bytes: "), F.octet_length(body).cast("string"))).cast("variant")).otherwise(v)


def _inside(x: Column) -> Column:
    """What a wrapping holds: a report, its text, or a list; null if x is no wrapping."""
    text = _get(x, "$", "string")
    inner = F.try_parse_json(text)
    # objects, lists and numbers have a text, too, but they hold nothing but themselves
    plain = _get(x, "$", "map<string,variant>").isNull() & _get(x, "$", "array<variant>").isNull() & (text != F.coalesce(_get(inner, "$", "string"), F.lit("")))
    return F.coalesce(_get(x, "$.report", "variant"), F.try_parse_json(_get(x, "$.payload", "string")), F.when(plain, inner))


def _unwrapped(v: Column) -> Column:
    """A list of reports from one parsed value: the report itself, a wrapper around it, its text, or a list of these, two deep."""
    lists = lambda x: F.coalesce(_get(x, "$", "array<variant>"), F.array(x))
    step = lambda xs: F.flatten(F.transform(xs, lambda x: lists(F.coalesce(_inside(x), x))))
    return step(step(lists(v)))


def _wrapped(x: Column) -> Column:
    """The text of what is still a wrapping or a list; null for a report."""
    return F.when(_get(x, "$", "array<variant>").isNotNull(), F.to_json(x)).otherwise(F.to_json(_inside(x)))


def _location(body: Column) -> Column:
    part = lambda a, b: F.coalesce(_get(body, f"$.location.{a}", "string"), _get(body, f"$.location.{b}", "string"))
    path = _get(body, "$.location.path", "string")
    ends = [part("startLine", "start.line"), part("startColumn", "start.column"), part("endLine", "end.line"), part("endColumn", "end.column")]
    return F.concat(path, F.lit(":"), ends[0], F.lit(":"), ends[1], F.lit("-"), ends[2], F.lit(":"), ends[3])


def _texts(v: Column) -> Column:
    """A list of values as texts; a bare value counts as a list of one. Objects and nulls are no values."""
    scalar = _get(v, "$", "string")
    plain = F.when(_get(v, "$", "map<string,variant>").isNull(), scalar)
    out = F.coalesce(F.transform(_get(v, "$", "array<variant>"), lambda x: F.when(_get(x, "$", "map<string,variant>").isNull(), _get(x, "$", "string"))), F.array(plain))
    return F.filter(out, lambda x: x.isNotNull())


_PAIRS = "array<struct<k:string,v:string,rest:string>>"


def _pairs(v: Column, prefix: Column | None, level: int = 1) -> Column:
    """k, v rows of an extensions object, keys in full; an object at the last level is a row with its text as rest."""
    no = F.lit(None).cast("string")

    def entry(e: Column) -> Column:
        key = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
        here = F.transform(_texts(e["value"]), lambda x: F.struct(key.alias("k"), x.alias("v"), no.alias("rest")))
        if level < KEY_LEVELS:
            return F.concat(here, _pairs(e["value"], key, level + 1))
        deeper = F.size(_get(e["value"], "$", "map<string,variant>")) > 0
        return F.when(deeper, F.array(F.struct(key.alias("k"), no.alias("v"), F.to_json(e["value"]).alias("rest")))).otherwise(here)

    return F.coalesce(F.flatten(F.transform(F.map_entries(_get(v, "$", "map<string,variant>")), entry)), F.array().cast(_PAIRS))


def _extensions(body: Column) -> Column:
    ext = _get(body, "$.extensions", "variant")
    rows = _get(ext, "$", "array<variant>")
    named = F.flatten(F.transform(rows, lambda r: F.transform(
        F.concat(_texts(_get(r, "$.values", "variant")), _texts(_get(r, "$.value", "variant"))),
        lambda x: F.struct(_get(r, "$.key", "string").alias("k"), x.alias("v"), F.lit(None).cast("string").alias("rest")))))
    named = F.filter(named, lambda p: p["k"].isNotNull())
    return F.coalesce(named, _pairs(ext, None))


def _evidence(body: Column) -> Column:
    inner = F.transform(_entities(body, "evidences", F.lit(None).cast("string")), lambda e: e["id"])
    listed = lambda name: F.coalesce(_texts(_get(body, f"$.{name}", "variant")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(listed("evidenceIds"), inner))


def _parsed(values: DataFrame) -> DataFrame:
    """report_id, wrapped, components, findings from report_id, value: entities with the ids of their owners, wherever the layout put them.

    A list of reports yields one row each; wrapped is the text of what is not unwrapped yet, and then there are no entities.
    """
    one = values.select("report_id", F.explode(_unwrapped(F.col("value"))).alias("r"))
    no = F.lit(None).cast("string")
    one = one.select("report_id", "r", _wrapped(F.col("r")).alias("wrapped"), _entities(F.col("r"), "artifacts", no).alias("artifacts"))
    inner = F.flatten(F.transform("artifacts", lambda a: _entities(a["body"], "components", a["id"])))
    top = F.transform(_entities(F.col("r"), "components", no), lambda c: F.struct(c["id"].alias("id"), _get(c["body"], "$.artifactId", "string").alias("parent"), c["pos"].alias("pos"), c["body"].alias("body")))
    one = one.select("report_id", "r", "wrapped", "artifacts", F.concat(top, inner).alias("components"))
    nested = lambda owners: F.flatten(F.transform(owners, lambda o: _entities(o["body"], "findings", o["id"])))
    own = F.transform(_entities(F.col("r"), "findings", no), lambda f: F.struct(f["id"].alias("id"), _get(f["body"], "$.subjectId", "string").alias("parent"), f["pos"].alias("pos"), f["body"].alias("body")))
    return one.select("report_id", "wrapped", "components", F.concat(own, nested("components"), nested("artifacts")).alias("findings"))


def _emitted(reports: DataFrame, body: str, rows: Column, columns: list[str]) -> DataFrame:
    """The distinct structs of `rows` (over wrapped, components, findings) of all reports.

    Of what is wrapped deeper than one round unwraps the first column is null and rest its text; it goes through again.
    """
    todo = reports.select("report_id", _read(F.col(body)).alias("value"))
    done: DataFrame | None = None
    while True:
        got, seen = cut_observed(_parsed(todo).select("report_id", F.inline(rows)).distinct(), wrapped=F.count_if(F.col("wrapped").isNotNull()))
        here = got.where(F.col("wrapped").isNull()).select("report_id", *columns)
        done = here if done is None else done.unionByName(here)
        if not seen["wrapped"]:
            return done
        todo = got.where(F.col("wrapped").isNotNull()).select("report_id", F.try_parse_json("wrapped").alias("value"))


def _or_wrapped(made: Column, columns: list[tuple[str, str]]) -> Column:
    """made, an array of structs of the columns, with a field for what is wrapped: a row of its own, the others null."""
    named = ", ".join(f"{n}:{t}" for n, t in columns)
    nothing = F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in columns), F.col("wrapped").alias("wrapped")))
    full = F.transform(made, lambda e: F.struct(*(e[n].alias(n) for n, _ in columns), F.lit(None).cast("string").alias("wrapped")))
    return F.when(F.col("wrapped").isNotNull(), nothing).otherwise(full).cast(f"array<struct<{named}, wrapped:string>>")


_FACT = [("owner_kind", "string"), ("owner_id", "string"), ("fact_kind", "string"), ("fact_value", "string"), ("rest", "string")]


def _rows(kind: str, entities: str) -> Column:
    """owner_kind, owner_id, fact_kind, fact_value, rest structs of all entities of a kind; with a rest, fact_value is the key so far."""
    no = F.lit(None).cast("string")
    fact = lambda e, k, v, rest=no: F.struct(F.lit(kind).alias("owner_kind"), e["id"].alias("owner_id"), F.lit(k).alias("fact_kind"), v.alias("fact_value"), rest.alias("rest"))

    def of(e: Column) -> Column:
        where = F.filter(F.array(fact(e, "location", _location(e["body"]))), lambda f: f["fact_value"].isNotNull())
        more = F.transform(_extensions(e["body"]), lambda p: fact(e, "extension", F.when(p["rest"].isNull(), F.concat(p["k"], F.lit("="), p["v"])).otherwise(p["k"]), p["rest"]))
        links = [F.transform(_evidence(e["body"]), lambda i: fact(e, "evidence", i))] if kind == "finding" else []
        return F.concat(where, more, *links)

    return F.flatten(F.transform(entities, of))


def facts(reports: DataFrame, body: str = "body") -> DataFrame:
    """report_id, owner_kind, owner_id, fact_kind, fact_value: distinct facts of the components and findings of all bodies.

    Keys may be nested, and reports wrapped, to any depth. Unreadable and missing bodies yield no row; a body that may be too long for a
    variant fails the query.
    """
    rows = F.array_distinct(F.concat(_rows("component", "components"), _rows("finding", "findings")))
    columns = [n for n, _ in _FACT]
    got = _emitted(reports, body, _or_wrapped(rows, _FACT), columns)
    done: DataFrame | None = None
    while True:
        here = got.where(F.col("rest").isNull()).drop("rest")
        done = here if done is None else done.unionByName(here).distinct()
        deep = got.where(F.col("rest").isNotNull())
        if deep.isEmpty():
            return done
        pairs = _pairs(F.try_parse_json("rest"), F.col("fact_value"))
        deep = deep.select("report_id", "owner_kind", "owner_id", "fact_kind", F.inline(pairs))
        got, _ = cut_observed(deep.select("report_id", "owner_kind", "owner_id", "fact_kind", F.when(F.col("rest").isNull(), F.concat("k", F.lit("="), "v")).otherwise(F.col("k")).alias("fact_value"), "rest"), n=F.count("rest"))


def _table(reports: DataFrame, entities: str, owner: str, name: str, paths: list[tuple[str, str]]) -> DataFrame:
    """One row per entity: its owner, id, position, the members at `paths` and its location."""
    text = lambda c, n: _get(c["body"], f"$.{n}", "string")
    columns = [(owner, "string"), (f"{name}_id", "string"), (f"{name}_pos", "int"), *((c, "string") for c, _ in paths), ("location", "string")]
    rows = F.transform(entities, lambda c: F.struct(
        c["parent"].alias(owner), c["id"].alias(f"{name}_id"), c["pos"].alias(f"{name}_pos"), *(text(c, p).alias(n) for n, p in paths), _location(c["body"]).alias("location")))
    return _emitted(reports, "body", _or_wrapped(rows, columns), [n for n, _ in columns])


def components(reports: DataFrame) -> DataFrame:
    """report_id, artifact_id, component_id, component_pos, component_kind, component_name, qualified_name, location: one row per component."""
    return _table(reports, "components", "artifact_id", "component", [("component_kind", "kind"), ("component_name", "name"), ("qualified_name", "qualifiedName")])


def findings(reports: DataFrame) -> DataFrame:
    """report_id, subject_id, finding_id, finding_pos, fingerprint, rule_id, severity, message, location: one row per finding."""
    return _table(reports, "findings", "subject_id", "finding", [("fingerprint", "fingerprint"), ("rule_id", "rule.id"), ("severity", "severity"), ("message", "message")])
