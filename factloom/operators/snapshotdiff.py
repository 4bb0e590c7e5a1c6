"""Problem 2: what changed between consecutive full snapshots, by invertible Bloom lookup tables (IBLTs).

Keys never meet each other in a join of whole snapshots. Each snapshot is folded, per hash bucket, into a table of cells that
hold a count and XOR sums of key hash, value digest and a check sum; every (key, digest) pair enters three cells. Subtracting
the tables of two consecutive snapshots cancels all pairs they share, and peeling cells that hold a single pair gives back the
rest. What has to be shuffled grows with buckets and cells. A bucket that does not peel completely, or whose digest does not
come out at zero, is built again with four times the cells until it does; no bucket is given up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import cut, trimmed

#: Keys a bucket holds on average, and cells of each of its three sub-tables at first.
BUCKET_KEYS, FIRST_CELLS, GROWTH = 8192, 512, 4
#: Fixed values of the 64-bit xxHash, as Spark's xxhash64 uses them on longs.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 over columns of longs, on numpy arrays; the result is int64."""
    with np.errstate(over="ignore"):
        seed = np.uint64(42)
        for c in columns:
            h = seed + _P5 + np.uint64(8)
            h = h ^ (_rotl(np.asarray(c).astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
            h = _rotl(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            seed = h ^ (h >> np.uint64(32))
    return seed.view(np.int64)


def fold(snapshots: DataFrame, snapshot: str, key: Column, values: list[Column], version: str) -> DataFrame:
    """snapshot_no, k1, k2 (128 bits of the key's hash), vd (digest of the values), one row per snapshot and key.

    Of several rows of a key in a snapshot the largest `version` holds, nulls lowest, ties by the digest. Rows without key or
    snapshot are no records.
    """
    digest = F.xxhash64(*(x for v in values for x in (v.isNull(), F.coalesce(v, F.lit("")))))
    rows = snapshots.select(F.col(snapshot).cast("long").alias("snapshot_no"), key.alias("_key"), digest.alias("vd"), F.col(version).alias("_version"))
    rows = rows.where(F.col("_key").isNotNull() & (F.col("_key") != "") & F.col("snapshot_no").isNotNull())
    hashed = rows.select("snapshot_no", F.xxhash64("_key").alias("k1"), F.xxhash64(F.lit(7), "_key").alias("k2"), "vd", "_version")
    return hashed.groupBy("snapshot_no", "k1", "k2").agg(F.max(F.struct("_version", "vd")).alias("m")).select("snapshot_no", "k1", "k2", F.col("m.vd").alias("vd"))


def _tables(folded: DataFrame, pairs: DataFrame, cells: int) -> DataFrame:
    """The subtracted cells of each pair of snapshots and bucket: pair, bucket, cell, n, x1, x2, xv, xc."""
    k = ("k1", "k2", "vd")
    at = F.array(*(F.lit(j * cells) + F.pmod(F.xxhash64(*k, F.lit(j).cast("long")), F.lit(cells)) for j in range(3)))
    one = (
        folded.select("snapshot_no", "bucket", *k, F.xxhash64(*k).alias("c"), F.explode(at).alias("cell"))
        .groupBy("snapshot_no", "bucket", "cell")
        .agg(F.count("*").alias("n"), *(F.bit_xor(a).alias(b) for a, b in (("k1", "x1"), ("k2", "x2"), ("vd", "xv"), ("c", "xc"))))
    )
    return (
        one.join(pairs, "snapshot_no")
        .groupBy("pair", "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("sign")).alias("n"), *(F.bit_xor(x).alias(x) for x in ("x1", "x2", "xv", "xc")))
        .where("n <> 0 or x1 <> 0 or x2 <> 0 or xv <> 0 or xc <> 0")
    )


def peel(cell: np.ndarray, n: np.ndarray, x1: np.ndarray, x2: np.ndarray, xv: np.ndarray, xc: np.ndarray, cells: int) -> tuple[np.ndarray, bool]:
    """Pairs (k1, k2, vd, sign) of one subtracted table, and whether it was emptied. Absent cells are zero."""
    tab = np.zeros((5, 3 * cells), dtype=np.int64)
    tab[:, cell] = np.stack([n, x1, x2, xv, xc])
    found: list[np.ndarray] = []
    while True:
        live = np.flatnonzero(np.abs(tab[0]) == 1)
        if not len(live):
            break
        k1, k2, vd = tab[1, live], tab[2, live], tab[3, live]
        pure = hash_longs(k1, k2, vd) == tab[4, live]
        if not pure.any():
            break
        got = np.unique(np.stack([k1, k2, vd, tab[0, live]])[:, pure], axis=1)
        found.append(got)
        check = hash_longs(got[0], got[1], got[2])
        for j in range(3):
            at = j * cells + np.mod(hash_longs(got[0], got[1], got[2], np.full(got.shape[1], j)), cells)
            np.subtract.at(tab[0], at, got[3])
            for row, x in ((1, got[0]), (2, got[1]), (3, got[2]), (4, check)):
                np.bitwise_xor.at(tab[row], at, x)
    out = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    return out, not tab.any()


def _peeled(tables: DataFrame, cells: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, clean = peel(*(pdf[c].to_numpy() for c in ("cell", "n", "x1", "x2", "xv", "xc")), cells)
        if not clean:
            out = np.zeros((4, 1), dtype=np.int64)  # sign 0: this bucket has to grow
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "bucket": pdf["bucket"].iloc[0], "k1": out[0], "k2": out[1], "vd": out[2], "sign": out[3]})

    # a group has at most 3 * cells rows, whatever the size of the snapshots, until a bucket has to grow
    return tables.groupBy("pair", "bucket").applyInPandas(one, "pair long, bucket long, k1 long, k2 long, vd long, sign long")


def changes(folded: DataFrame, bucket_keys: int = BUCKET_KEYS, first_cells: int = FIRST_CELLS) -> DataFrame:
    """pair (the later snapshot_no), k1, k2, change_kind for all keys that differ between consecutive snapshots of fold()."""
    folded = cut(folded)
    most = folded.groupBy("snapshot_no").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // bucket_keys))
    folded = folded.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)))
    # one row per delivered snapshot: as few as there were deliveries
    steps = folded.select("snapshot_no").distinct().withColumn("before", F.lag("snapshot_no").over(Window.orderBy("snapshot_no"))).where(F.col("before").isNotNull())
    pairs = steps.select(F.inline(F.array(
        F.struct(F.col("snapshot_no"), F.col("snapshot_no").alias("pair"), F.lit(1).alias("sign")),
        F.struct(F.col("before").alias("snapshot_no"), F.col("snapshot_no").alias("pair"), F.lit(-1).alias("sign")))))
    pairs = cut(pairs)
    parts: list[DataFrame] = []
    cells, rows = first_cells, folded
    todo = None
    while True:
        tables = _tables(rows, pairs, cells)
        if todo is not None:
            tables = tables.join(todo, ["pair", "bucket"], "left_semi")
        got = cut(_peeled(tables, cells))
        parts.append(got.where("sign <> 0"))
        todo = got.where("sign = 0").select("pair", "bucket").distinct()
        if todo.isEmpty():
            break
        cells *= GROWTH
        rows = folded.join(todo.join(pairs, "pair").select("snapshot_no", "bucket").distinct(), ["snapshot_no", "bucket"], "left_semi")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    kind = F.when(F.min("sign") == 1, "added").when(F.max("sign") == -1, "removed").otherwise("changed")
    return union.groupBy("pair", "k1", "k2").agg(kind.alias("change_kind"))


def snapshot_changes(snapshots: DataFrame, snapshot: str = "snapshot_no", key: str = "finding_id", values: tuple[str, ...] = ("severity", "fingerprint"), version: str = "loaded_at") -> DataFrame:
    """snapshot_no (the later one), <key>, change_kind ('added', 'removed', 'changed') between consecutive delivered snapshots.

    Keys and values are compared trimmed and in lower case; keys come out so. A null value differs from any text. Numbers that
    were not delivered are skipped. Other columns are ignored. One snapshot or none gives no rows.
    """
    norm = lambda c: F.lower(trimmed(c))
    k = norm(key)
    found = changes(fold(snapshots, snapshot, k, [norm(v) for v in values], version))
    names = snapshots.select(k.alias(key)).where(F.col(key) != "").select(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"), key)
    wanted = cut(found)
    # the changed keys' names: only those rows of the snapshots are kept, then one per key
    named = names.join(wanted.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min(key).alias(key))
    return wanted.join(named, ["k1", "k2"]).select(F.col("pair").alias(snapshot), key, "change_kind")


