"""The registered queries of the core: name -> (spark, folder) -> DataFrame, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fact_queries
from factloom.operators import flatten, hierarchy
from factloom.plans import supply_queries
from factloom.session import table
from factloom.sources import poms

Query = Callable[[SparkSession, str], DataFrame]


def _forest(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.hierarchy(poms.latest_links(table(spark, d, "raw_poms")), "pom_key", "parent_key")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.node_paths(_forest(spark, d)).withColumnRenamed("key", "pom_key")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).descendants()


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).intervals().select("key", "node_depth", "subtree_size", "enter", "leave")


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).members()


# operators that need array libraries on the driver are imported by the queries that use them


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import snapshotdiff

    return snapshotdiff.snapshot_changes(table(spark, d, "finding_snapshots")).withColumn("snapshot_no", F.col("snapshot_no").cast("int"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_changes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.facts(table(spark, d, "report_documents"))


def p3_components(spark: SparkSession, d: str) -> DataFrame:
    return flatten.components(table(spark, d, "report_documents"))


def p3_findings(spark: SparkSession, d: str) -> DataFrame:
    return flatten.findings(table(spark, d, "report_documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import widen

    return widen.filled_cells(table(spark, d, "extension_values"), table(spark, d, "extension_keys"))


def _wide(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        from factloom.operators import widen

        w = widen.wide_table(table(spark, d, "extension_values"), table(spark, d, "extension_keys"), kind)
        exact = F.array_join(F.transform(F.array_sort(F.map_entries("exact_numbers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
        w = w.withColumn("exact_numbers", exact)
        return w.toDF(*(c.replace(".", "_").replace("-", "_") for c in w.columns))

    return query


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_descendants, p1_intervals, p1_cycles, p2_found, p2_summary, p3_found, p3_components, p3_findings, p4_found)}
    for kind in ("component", "artifact", "metric"):
        out[f"p4_{kind}_table"] = _wide(kind)
    return out | supply_queries.queries() | fact_queries.queries()


def oracle_sql() -> dict[str, str]:
    return supply_queries.oracle_sql() | fact_queries.oracle_sql()
