"""Problem 6: filling containers of fixed capacity with texts, by best-two-fit.

Sizes are tokens of a public tokenizer. A text above the capacity is split: full containers, and a rest that is packed like
any text. A container is filled greedily with the largest texts that fit; if a gap stays, its smallest text is replaced with
the two unpacked texts that together fit the widened gap most tightly.

Texts are packed in shards, chosen by a hash of the id, of about SHARD_TEXTS texts: their number follows the input, so no task
and no shard grows with it. Each shard can waste at most the part of one container more than packing all at once would.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import spread

#: The vocabulary file and split pattern used unless others are given; executors read the file from the same path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TEXTS = 16_384
_loaded: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """The tokenizer of a rank file; loaded once a process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens of all texts that are not null or empty; a text is read whole."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer, pattern).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(t)) for t in s], dtype="int64")

    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).where("_t <> ''"), "doc_id")
    return rows.select("doc_id", count("_t").alias("n_tokens"))


class _Pool:
    """Unpacked texts by size: the sizes in order, and for each the texts' places."""

    def __init__(self, sizes: np.ndarray):
        self.by: dict[int, list[int]] = {}
        for i in np.argsort(sizes, kind="stable")[::-1].tolist():
            self.by.setdefault(int(sizes[i]), []).append(i)
        self.sizes = sorted(self.by)

    def take(self, size: int) -> int:
        got = self.by[size]
        i = got.pop()
        if not got:
            del self.by[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return i

    def give(self, size: int, i: int) -> None:
        if size not in self.by:
            insort(self.sizes, size)
            self.by[size] = []
        self.by[size].append(i)

    def pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked sizes whose sum is the largest in least < sum <= most."""
        s = self.sizes
        j = bisect_right(s, most - s[0]) - 1 if s else -1
        best, got, i = least, None, 0
        while i <= j:
            total = s[i] + s[j]
            if total > most or (i == j and len(self.by[s[i]]) < 2):
                j -= 1
                continue
            if total > best:
                best, got = total, (s[i], s[j])
                if total == most:
                    break
            i += 1
        return got


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each text; all sizes are 1 .. capacity."""
    out = np.full(len(sizes), -1, dtype=np.int64)
    pool = _Pool(sizes)
    bin_no = 0
    while pool.sizes:
        gap, inside = capacity, []
        while pool.sizes and pool.sizes[0] <= gap:
            size = pool.sizes[bisect_right(pool.sizes, gap) - 1]
            inside.append((size, pool.take(size)))
            gap -= size
        if gap and pool.sizes:
            size, i = inside[-1]  # taken in falling order, so the last is the smallest
            if two := pool.pair(size, size + gap):
                inside[-1:] = [(s, pool.take(s)) for s in two]
                pool.give(size, i)
        for _, i in inside:
            out[i] = bin_no
        bin_no += 1
    return out


def pack(counts: DataFrame, capacities: DataFrame, doc_id: str = "doc_id", size: str = "n_tokens", shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """capacity_id, doc_id, piece_no, token_from, n_tokens, container_id: where each text, or each piece of a split one, goes.

    Texts of no size and null ids have no container; only texts above the capacity have several pieces. Capacities that are
    null or below 1 are left out. Repeated ids are packed once for each row.
    """
    counts = counts.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(size).cast("long").alias("n_tokens")).where("doc_id is not null and n_tokens > 0")
    n = counts.count()
    shards = max(1, -(-n // shard_texts))
    caps = capacities.select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap = int(pdf["capacity_tokens"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "n_tokens"], ignore_index=True)
        total = pdf["n_tokens"].to_numpy()
        fulls, rest = np.where(total > cap, total // cap, 0), np.where(total > cap, total % cap, total)
        packed = np.flatnonzero(rest)
        bins = best_two_fit(rest[packed], cap)
        used = int(bins.max()) + 1 if len(bins) else 0
        doc = np.concatenate([np.repeat(np.arange(len(pdf)), fulls), packed])
        nth = np.arange(fulls.sum()) - np.repeat(np.cumsum(fulls) - fulls, fulls)
        piece = np.concatenate([nth, fulls[packed]])
        where = np.concatenate([used + np.arange(fulls.sum()), bins])
        prefix = f"{pdf['capacity_id'].iloc[0]}-{pdf['shard'].iloc[0]}-"
        return pd.DataFrame({
            "capacity_id": pdf["capacity_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[doc], "piece_no": piece, "token_from": piece * cap,
            "n_tokens": np.concatenate([np.full(fulls.sum(), cap), rest[packed]]), "container_id": [prefix + str(x) for x in where.tolist()],
        })

    # each capacity packs all texts; the capacities are a short list of settings, so they go into the rows as an array
    sizes = [F.struct(F.lit(r[0]).cast("long").alias("capacity_id"), F.lit(r[1]).cast("long").alias("capacity_tokens")) for r in caps.collect()]
    all_of = F.array(*sizes) if sizes else F.array().cast("array<struct<capacity_id:long,capacity_tokens:long>>")
    rows = counts.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.inline(all_of))
    return rows.groupBy("capacity_id", "shard").applyInPandas(one, "capacity_id long, doc_id long, piece_no long, token_from long, n_tokens long, container_id string")
