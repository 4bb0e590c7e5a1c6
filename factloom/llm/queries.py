"""The registered queries on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


# each operator is imported by the queries that use it, so that a driver loads only what it needs


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.syntax import check as syntax

    return syntax.repairs(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm.syntax import check as syntax

    return syntax.broken(table(spark, d, "source_files")).distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per project and language: files, broken files and their share, and how many are of each kind."""
    files = p5_repairs(spark, d).groupBy("project_id", "language", "file_id").agg(F.max("edit_cost").alias("cost"), F.max("damage_kind").alias("kind"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("truncation", "conflict", "mismatch", "damage")]
    out = files.groupBy("project_id", "language").agg(F.count("*").alias("n_files"), F.count_if(F.col("cost") > 0).alias("n_broken"), *kinds)
    return out.withColumn("broken_share", F.col("n_broken") / F.col("n_files"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm import packing

    counts = cut(packing.token_counts(table(spark, d, "documents")))  # counted once, then sized and packed
    return packing.pack(counts, table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers used, the fewest that could do, and the share of unused space."""
    caps = table(spark, d, "pack_capacities").select("capacity_id", "capacity_tokens")
    used = p6_packing(spark, d).groupBy("capacity_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    return used.join(caps, "capacity_id").select("capacity_id", "n_containers", least.alias("least_containers"), (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm import leakage

    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm import leakage

    # aligned without any edit; whole leaves out what begins or ends within a word
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=0).where("whole").select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    from factloom.llm import langid

    return langid.languages(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang_found"))
    mixed = (F.col("segment_no") > 0) & (F.col("n_langs") > 1)
    rows = p8_languages(spark, d).where(F.col("lang_found").isNotNull() & (((F.col("segment_no") == 0) & wrong) | mixed))
    return rows.select("doc_id", F.col("segment_no").cast("long").alias("segment_no"), "lang_found").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p5_found, p5_repairs, p5_rates, p6_packing, p6_fill, p7_found, p7_leaks, p7_items, p8_found, p8_languages)}


def oracle_sql() -> dict[str, str]:
    return {}
