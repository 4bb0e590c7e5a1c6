"""The order tables presented as a fact model: regions are modules, suppliers are types, consecutive suppliers of an order are edges."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.ident import SCHEMA_VERSION, coordinate, stable_id
from factloom.plans.model import FactModel, JoinedModel, Links
from factloom.plans.rules import CONTROLLERS, REPOSITORY
from factloom.session import sent, table

IDENTITY, LANGUAGE = "supply", "sql"
PROJECT_ID = "project_" + hashlib.sha256("\n".join((SCHEMA_VERSION, IDENTITY, "project", LANGUAGE, ".", IDENTITY)).encode()).hexdigest()
FUNDED = "acct.Funded"
#: The lines that make supplier and library edges in the sampled binding, whose queries have SQL.
SAMPLED = ("l_discount >= 0.095 and l_returnflag = 'R' and l_quantity >= 45", "l_quantity >= 50 and l_discount >= 0.095")
ALL_LINES = ("true", "true")
_NO_EXT = "map<string,array<string>>"


def _id(kind: str, path, name):
    return stable_id(kind, F.lit(IDENTITY), F.lit(LANGUAGE), path, name)


def _loc(path, line):
    one = F.lit(1)
    return F.struct(path.alias("path"), line.cast("int").alias("start_line"), one.alias("start_column"), line.cast("int").alias("end_line"), one.alias("end_column"))


#: What makes the evidence of a line; l_suppkey is in it too, and is the source of every dependency of the line.
_OF_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "cents", "day")


def _evidence() -> dict[str, Column]:
    """Path and id of the evidence of a line, from its key columns."""
    name = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", F.date_format("day", "yyyy-MM-dd"))
    path = F.concat(F.lit("orders/"), F.col("l_orderkey"))
    return {"ev_path": path, "ev_id": _id("evidence", path, name)}


#: Columns of a line that share one number in a shuffle, with their bits there; l_orderkey and l_partkey stay beside it.
_BITS = {"l_suppkey": 22, "cents": 24, "day": 15, "l_linenumber": 3}
_BESIDE = ("l_orderkey", "l_partkey")
_LINE = (*_OF_LINE, "l_suppkey", "of_cent", "of_day")


def numbered(li: DataFrame) -> DataFrame:
    """lineitem with price and date as whole cents and days, and what is left of them, which is 0 as a rule."""
    at = dict(li.dtypes)["l_shipdate"]
    li = li.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long")).withColumn("day", F.col("l_shipdate").cast("date"))
    return li.withColumn("of_cent", F.col("l_extendedprice") - F.col("cents") / 100).withColumn("of_day", F.col("l_shipdate") - F.col("day").cast(at)).drop("l_extendedprice", "l_shipdate")


def _met(lines: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Lines with the columns of _LINE and more, partitioned by key (one of _BESIDE), at about half the room of plain columns.

    A line with a null or with a number too large for its bits has all columns in `rest`, which is null for the others.
    """
    kinds = dict(lines.dtypes)
    number = {c: F.unix_date(c) if c == "day" else F.col(c) for c in _BITS}
    fits = F.col("of_cent") == 0
    if kinds["of_day"] != "void":
        fits = fits & (F.col("of_day") == F.lit(0).cast(kinds["of_day"]))
    one = F.lit(0).cast("long")
    for c, n in _BITS.items():
        fits = fits & number[c].between(0, (1 << n) - 1)
        one = F.shiftleft(one, n).bitwiseOR(number[c].cast("long"))
    rest = F.when(~F.coalesce(fits, F.lit(False)), F.struct(*_LINE))
    rows = lines.select(*_BESIDE, F.when(rest.isNull(), one).alias("one"), rest.alias("rest"), *more).repartition(key)
    left, out = 64, {}
    for c, n in _BITS.items():
        left -= n
        x = F.shiftrightunsigned("one", left).bitwiseAND(F.lit((1 << n) - 1).cast("long")).cast("int" if c == "day" else kinds[c])
        out[c] = F.when(F.col("rest").isNull(), F.date_from_unix_date(x) if c == "day" else x).otherwise(F.col(f"rest.{c}"))
    zero = {c: F.when(F.col("rest").isNull(), F.lit(0).cast(kinds[c])).otherwise(F.col(f"rest.{c}")) for c in ("of_cent", "of_day")}
    return rows.withColumns(out | zero).drop("one", "rest")


def _lines(spark: SparkSession, d: str, more: tuple[str, ...]) -> DataFrame:
    """The lines with the next supplier of the same order.

    (l_orderkey, l_linenumber) is no key, so the order within an order needs five columns.
    """
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents", "of_cent", "day", "of_day")
    return _met(numbered(table(spark, d, "lineitem")), "l_orderkey", more).withColumn("next_supp", F.lead("l_suppkey").over(w))


def _folded(rows: DataFrame, *ends: str) -> DataFrame:
    """Lines to dependencies: the sorted evidence of each pair of ends, and the first one with its place.

    Lines meet by their key columns; ids are made behind the shuffle, as 64 digits of a hash take more room than all of the columns.
    """
    met = rows.select(*dict.fromkeys(("l_suppkey", *ends, *_OF_LINE))).repartition(*ends).withColumns(_evidence())
    return met.groupBy(*ends).agg(F.array_sort(F.collect_set("ev_id")).alias("evidence_ids"), F.min(F.struct("ev_id", "ev_path", "l_linenumber")).alias("first"))


def whole_facts(spark: SparkSession, d: str) -> FactModel:
    """The fact model with an edge for every line that has a next supplier and for every supplier and part of a line."""
    return supply_facts(spark, d, ALL_LINES)


def supply_facts(spark: SparkSession, d: str, kept: tuple[str, str] = SAMPLED) -> FactModel:
    """The fact model of one folder of order tables; see the column expressions for the bindings.

    kept: the conditions on lines that make supplier edges and library edges.
    """
    to_supplier, to_part = f"next_supp is not null and ({kept[0]})", f"({kept[1]})"
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    none = F.create_map().cast(_NO_EXT)
    pid = F.lit(PROJECT_ID).alias("project_id")
    project = spark.range(1).select(pid, F.lit(IDENTITY).alias("identity"), F.lit(IDENTITY).alias("name"), F.lit(LANGUAGE).alias("language"), F.lit(".").alias("repository_path"), none.alias("extensions"))

    mpath = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
    modules = region.withColumn("mpath", mpath).withColumn("mname", F.concat(F.lit(f"{IDENTITY}:"), "mpath")).withColumn("artifact_id", _id("artifact", F.col("mpath"), F.col("mname")))
    part = table(spark, d, "part")
    coord = coordinate("p_brand", "p_type", F.col("p_size").cast("string"))
    libs = part.select(coord.alias("coord"), "p_size").where("coord is not null").distinct()
    libs = libs.withColumn("artifact_id", _id("artifact", F.lit("."), F.col("coord"))).withColumn("component_id", _id("component", F.lit("."), F.col("coord")))
    lang = F.lit(LANGUAGE).alias("language")
    lib_ext = F.map_concat(
        F.create_map(F.lit("maven.coordinate"), F.array("coord")),
        F.when(F.col("p_size") % 10 == 0, F.create_map(F.lit("maven.version-unresolved"), F.array(F.lit("true")))).otherwise(none),
    )
    artifact = modules.select(pid, F.col("artifact_id").alias("id"), F.lit("module").alias("kind"), F.col("mpath").alias("name"), lang, F.col("mpath").alias("repository_path"), F.col("mname").alias("qualified_name"), none.alias("extensions")).unionByName(
        libs.select(pid, F.col("artifact_id").alias("id"), F.lit("library").alias("kind"), F.col("coord").alias("name"), lang, F.lit(".").alias("repository_path"), F.col("coord").alias("qualified_name"), lib_ext.alias("extensions")))

    places = nation.join(modules, nation.n_regionkey == modules.r_regionkey).select("n_nationkey", "r_name", "mpath", "mname", "artifact_id")
    pkg = F.concat(F.lit("trade."), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit(".n"), "n_nationkey")
    sup = supplier.join(places, supplier.s_nationkey == F.col("n_nationkey")).withColumn("pkg", pkg).withColumn("qn", F.concat("pkg", F.lit(".S"), "s_suppkey")).withColumn("path", F.concat("mpath", F.lit("/S"), "s_suppkey"))
    sup = sup.withColumn("cid", _id("component", F.col("path"), F.col("qn"))).withColumn("decl", _id("evidence", F.col("path"), F.concat("qn", F.lit("|declaration"))))
    k = F.col("s_suppkey")
    marks = F.array_compact(F.array(F.when(k % 3 == 0, CONTROLLERS[0]), F.when(k % 4 == 1, REPOSITORY), F.when(F.col("s_acctbal") >= 5000, FUNDED)))
    sup_ext = F.create_map(
        F.lit("java.package"), F.array("pkg"), F.lit("java.declaration-kind"), F.array(F.lit("class")), F.lit("java.annotations"), marks,
        F.lit("java.annotation-resolution"), F.array(F.when(k % 17 == 3, "incomplete").otherwise("complete")), F.lit("arch.declaration-evidence-id"), F.array("decl"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.withColumn("path", F.concat(F.lit("orders/"), "o_orderkey")).withColumn("qn", F.concat(F.lit("orders#o"), "o_orderkey")).withColumn("cid", _id("component", F.col("path"), F.col("qn"))).withColumn("mev", _id("evidence", F.col("path"), F.concat("qn", F.lit("|complexity"))))
    cols = lambda df, i, kind, name, qn, loc, ext, art="artifact_id": df.select(pid, F.col(i).alias("id"), F.col(art).alias("artifact_id"), F.lit(kind).alias("kind"), name.alias("name"), lang, F.col(qn).alias("qualified_name"), loc.alias("location"), ext.alias("extensions"))
    component = (
        cols(sup, "cid", "type", F.col("s_name"), "qn", _loc(F.col("path"), F.lit(1)), sup_ext)
        .unionByName(cols(orders, "cid", "function", F.col("qn"), "qn", _loc(F.col("path"), F.lit(1)), none))
        .unionByName(cols(libs, "component_id", "module", F.col("coord"), "coord", F.lit(None).cast("struct<path:string,start_line:int,start_column:int,end_line:int,end_column:int>"), none))
    )

    plain = numbered(table(spark, d, "lineitem"))
    lines = _lines(spark, d, () if kept == ALL_LINES else tuple(c for c in plain.columns if c.startswith("l_") and c not in _LINE))
    n_supp = supplier.count()
    to_next = lines.where(to_supplier)
    to_lib = _met(plain.where(to_part), "l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), coord.alias("coord"), "p_size").where("coord is not null"), "l_partkey")
    kind = "depends-on"
    dep_id = _id("dependency", F.col("path"), F.concat_ws("|", "source_id", F.lit(kind), "target_id")).alias("id")
    ids = sup.select("s_suppkey", "cid", "path").distinct()
    end = lambda key, name, *more: sent(ids.select(F.col("s_suppkey").alias(key), F.col("cid").alias(f"{name}_id"), *more), n_supp)
    lib_id = _id("component", F.lit("."), F.col("coord")).alias("target_id")
    pairs = _folded(to_next, "l_suppkey", "next_supp").join(end("next_supp", "target"), "next_supp").select("l_suppkey", "target_id", "evidence_ids")
    pairs = pairs.unionByName(_folded(to_lib, "l_suppkey", "coord").select("l_suppkey", lib_id, "evidence_ids")).join(end("l_suppkey", "source", "path"), "l_suppkey")
    dependency = pairs.select(pid, dep_id, "source_id", "target_id", F.lit(kind).alias("kind"), "evidence_ids", none.alias("extensions"))

    texts = lambda c: c.cast("array<string>")
    type_side = {"id": F.col("cid"), "artifact_id": F.col("artifact_id"), "component_kind": F.lit("type"), "qualified_name": F.col("qn"), "package": F.col("pkg"), "annotations": texts(marks), "resolved": k % 17 != 3, "declaration_kind": F.lit("class"), "declaration_evidence_id": F.col("decl")}
    lib_side = {"id": lib_id, "artifact_id": _id("artifact", F.lit("."), F.col("coord")), "component_kind": F.lit("module"), "qualified_name": F.col("coord"), "package": F.lit(None).cast("string"), "annotations": texts(F.array()), "resolved": F.lit(True), "declaration_kind": F.lit(None).cast("string"), "declaration_evidence_id": F.lit(None).cast("string")}
    named = lambda p, cs: [c.alias(f"{p}_{n}") for n, c in cs.items()]
    source = sent(sup.select(k.alias("l_suppkey"), "path", *named("source", type_side)), n_supp)
    target = sent(sup.select(k.alias("next_supp"), *named("target", type_side), F.col("mpath").alias("module_path"), F.col("mname").alias("artifact_name"), F.lit(None).cast("string").alias("coordinate"), F.lit(False).alias("version_unresolved")), n_supp)
    lib = (*named("target", lib_side), F.lit(".").alias("module_path"), F.col("coord").alias("artifact_name"), F.col("coord").alias("coordinate"), F.coalesce(F.col("p_size") % 10 == 0, F.lit(False)).alias("version_unresolved"))
    ends = _folded(to_next, "l_suppkey", "next_supp").join(target, "next_supp").drop("next_supp").unionByName(_folded(to_lib, "l_suppkey", "coord", "p_size").select("l_suppkey", "evidence_ids", "first", *lib))
    edges = ends.join(source, "l_suppkey").select(
        pid, dep_id.alias("dependency_id"), F.lit(kind).alias("dependency_kind"), "evidence_ids", _loc(F.col("first.ev_path"), F.col("first.l_linenumber")).alias("location"), F.lit(False).alias("coordinate_unresolved"),
        *(c for c in (*target.columns, *source.columns) if c not in ("next_supp", "l_suppkey", "path")))

    def dress(rows: DataFrame) -> DataFrame:
        both = rows.join(end("target_key", "target"), "target_key").join(sent(sup.select(k.alias("source_key"), F.col("cid").alias("source_id"), "path", F.col("qn").alias("source_qualified_name")), n_supp), "source_key")
        made = both.withColumn("l_suppkey", F.col("source_key")).withColumns(_evidence())
        return made.withColumn("project_id", pid).withColumn("dependency_id", dep_id).withColumn("location", _loc(F.col("ev_path"), F.col("l_linenumber"))).withColumnRenamed("ev_id", "evidence_id")

    known = supplier.join(places, supplier.s_nationkey == F.col("n_nationkey"), "left_semi").select(k.alias("source_key"))
    rows = to_next.select(F.col("l_suppkey").alias("source_key"), F.col("next_supp").alias("target_key"), *_OF_LINE)
    for c in ("source_key", "target_key"):  # both ends have to be there
        rows = rows.join(sent(known.select(F.col("source_key").alias(c)), n_supp), c, "left_semi")
    links = Links(rows, dress, lambda nodes: nodes.join(end("node", "component"), "node"))

    ev = lambda df, i, kind, text, loc: df.select(pid, F.col(i).alias("id"), F.lit(kind).alias("kind"), text.alias("summary"), loc.alias("location"), none.alias("extensions"))
    touched = plain if kept == ALL_LINES else lines.where(f"({to_supplier}) or {to_part}")
    modev = modules.withColumn("mev", _id("evidence", F.col("mpath"), F.concat("mname", F.lit("|complexity"))))
    evidence = (
        ev(touched.withColumns(_evidence()), "ev_id", "reference", F.lit("order line"), _loc(F.col("ev_path"), F.col("l_linenumber")))
        .unionByName(ev(sup, "decl", "declaration", F.lit("supplier"), _loc(F.col("path"), F.lit(1))))
        .unionByName(ev(orders, "mev", "metric", F.lit("order"), _loc(F.col("path"), F.lit(1))))
        .unionByName(ev(modev, "mev", "metric", F.lit("region"), _loc(F.col("mpath"), F.lit(1))))
    )

    per_order = plain.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    per_supp = plain.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    functions = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select("cid", "mev", "n")
    types = sup.join(per_supp, k == F.col("l_suppkey"), "left").select("cid", F.col("decl").alias("mev"), F.coalesce("n", F.lit(0)).alias("n"), "artifact_id")
    summed = modev.join(types.groupBy("artifact_id").agg(F.sum("n").alias("n")), "artifact_id", "left").select(F.col("artifact_id").alias("cid"), "mev", F.coalesce("n", F.lit(0)).alias("n"))
    rows = functions.unionByName(types.drop("artifact_id")).unionByName(summed)
    key = "complexity.cyclomatic"
    metric = rows.select(
        pid, _id("metric", F.lit("."), F.concat("cid", F.lit(f"|{key}"))).alias("id"), F.col("cid").alias("scope_id"), F.lit(key).alias("key"), F.col("n").cast("decimal(38,18)").alias("value"), F.lit("count").alias("unit"),
        F.create_map(F.lit("arch.evidence-id"), F.array("mev")).alias("extensions"))
    return JoinedModel(project, artifact, component, dependency, evidence, metric, edges, links)
