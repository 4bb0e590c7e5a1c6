"""Name operators: unique-or-drop, ordered multi-strategy resolution, and unique wildcard matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_or_drop(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is unique, rows whose key is not). A repeated key drops all its rows.

    Counts are joined back instead of a window, so a key with a third of all rows does not fill one task.
    """
    counts = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"))
    cond = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    marked = df.join(counts, cond).drop(*(f"_key{i}" for i in range(len(keys))))
    return marked.where("_n = 1").drop("_n"), marked.where("_n > 1").drop("_n")


def resolve_ranked(refs: DataFrame, known: DataFrame) -> DataFrame:
    """ref, target, rank: the first of each ref's candidates that is a known name. Unresolved refs have no row.

    refs: ref, candidates (names in order of preference); known: name, target. Of several targets of a name the smallest holds.
    """
    one = known.groupBy("name").agg(F.min("target").alias("target"))
    tries = refs.select("ref", F.posexplode("candidates").alias("rank", "name")).where("name is not null")
    return tries.join(one, "name").groupBy("ref").agg(F.min(F.struct("rank", "target")).alias("m")).select("ref", "m.target", "m.rank")


def resolve_unique(refs: DataFrame, known: DataFrame) -> DataFrame:
    """ref, target of refs whose candidates hit exactly one target."""
    hits = refs.select("ref", F.explode("candidates").alias("name")).join(known.distinct(), "name")
    return hits.groupBy("ref").agg(F.min("target").alias("target"), F.max("target").alias("_most")).where("target = _most").drop("_most")
