"""Problem 7: evaluation texts in training texts, by q-gram lemma filtering in diagonal bands and banded alignment.

Texts are folded to streams of letters and digits in which case, marks, punctuation, white space, markup and encodings have no
place; where words begin and end is kept beside the stream. If a stretch of an item of length L occurs with at most k edits, it
shares at least L + 1 - q * (k + 1) q-grams with the document, all within a diagonal band of width k. So q-grams of a document
are looked up in the items' index, hits are counted in overlapping bands of diagonals, bands below the bound are dropped, and
the rest is verified by banded alignment of all windows of 13 words. A q-gram that a document repeats is met in blocks of the
document that overlap by a window, so what is held at once does not grow with document times items.

The items are the stated query set: they are sent to the executors in blocks of bounded size, and all documents stream past
each block in place. Nothing is shuffled and nothing of the documents reaches the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import spread

#: Length of a q-gram, edits allowed in a window, words of a window.
Q, EDITS, WINDOW = 12, 1, 13
#: Width of a band of diagonals; a second set of bands is shifted by half of it, so EDITS fit into one of the two.
BAND = 16
#: Places a q-gram may have in one index, if more than one item is in it, and hits worked on at once: bounds of memory, not of results.
HOT, HITS = 1024, 1 << 20
#: Characters of items sent to the executors at once; more items go in further blocks.
BLOCK_CHARS = 8_000_000
#: Characters of documents handled at once in a task.
CHUNK_CHARS = 2_000_000
_MARK = re.compile(r"</?(?:a|b|i|u|s|em|strong|p|br|hr|span|div|code|pre|tt|ul|ol|li|td|tr|th|table|sub|sup|small|font|h[1-6])(?:\s[^<>]{0,200})?/?>", re.I)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_GONE = {"Mn", "Cf", "Me"}
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Fold(dict):
    """Per code point: what it becomes in the stream; '' for what vanishes inside a word, ' ' for what parts words."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if unicodedata.category(c) in _GONE:
            out = ""
        else:
            out = "".join(x if x.isalnum() else " " for x in unicodedata.normalize("NFKD", c).casefold() if unicodedata.category(x) not in _GONE)
        self[cp] = out
        return out


_FOLD = _Fold()


_SIZE, _MANY = 0x30000, 0xFFFFFFFF
_table: np.ndarray | None = None


def _folded_table() -> np.ndarray:
    """What each code point becomes: 0 if it vanishes, 32 if it parts words, _MANY if it becomes several; built once a process."""
    global _table
    if _table is None:
        out = np.full(_SIZE, 32, dtype=np.uint32)
        for cp in range(_SIZE):
            if not 0xD800 <= cp < 0xE000:
                f = _FOLD[cp]
                out[cp] = 0 if not f else ord(f) if len(f) == 1 else _MANY
        _FOLD.clear()
        _table = out
    return _table


def stream(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters and digits of a text, and whether a word begins at, or ends after, each of them."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if "<" in text:
        text = _MARK.sub(" ", text)
    table = _folded_table()
    cp = table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _SIZE - 1)]
    if (cp == _MANY).any():
        cp = np.frombuffer(text.translate(_FOLD).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cp = cp[cp != 0]
    solid = cp != 32
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    return cp[solid], begin[solid], end[solid]


def grams(cp: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q-gram at each position."""
    n = len(cp) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            h = h * _MULT + cp[j : n + j]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes, and for each the (item, position) pairs that have it."""

    q: int
    edits: int
    reach: int
    ids: np.ndarray
    texts: list[np.ndarray]
    windows: list[tuple[np.ndarray, np.ndarray]]
    bound: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    bitmap: np.ndarray


#: (id, stream, first letters of its windows, ends of its windows)
Folded = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _indexed(items: list[Folded], q: int, edits: int) -> list[Index]:
    """Indexes of the items; more than one where a q-gram would otherwise have more than HOT places."""
    hs = [grams(cp, q) for _, cp, _, _ in items]
    h = np.concatenate(hs)
    its, ps = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in hs]), np.concatenate([np.arange(len(x), dtype=np.int32) for x in hs])
    order = np.argsort(h, kind="stable")
    keys, starts = np.unique(h[order], return_index=True)
    starts = np.append(starts, len(h))
    if len(items) > 1 and np.diff(starts).max(initial=0) > HOT:
        return _indexed(items[::2], q, edits) + _indexed(items[1::2], q, edits)
    bitmap = np.zeros(1 << 22, dtype=bool)
    bitmap[(keys >> np.uint64(42)).astype(np.int64)] = True
    windows = [(lo, hi) for _, _, lo, hi in items]
    bound = np.array([int((hi - lo).min()) + 1 - q * (edits + 1) for lo, hi in windows], dtype=np.int64)
    reach = max(int((hi - lo).max()) for lo, hi in windows) + BAND + edits
    return [Index(q, edits, reach, np.array([i for i, *_ in items], dtype=np.int64), [cp for _, cp, _, _ in items], windows, bound, keys, starts, its[order], ps[order], bitmap)]


def build_index(items: list[tuple[int, str | None]], q: int = Q, edits: int = EDITS, window: int = WINDOW) -> list[Index]:
    """Indexes that together hold all items of at least `window` words.

    q is shortened where a window is so short that it could lose all its q-grams to the edits.
    """
    by_q: dict[int, list[Folded]] = {}
    for item_id, text in items:
        cp, begin, end = stream(text or "")
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if len(b) < window:
            continue
        lo, hi = b[: len(b) - window + 1], e[window - 1 :]
        own = min(q, int((hi - lo).min()) // (edits + 1))
        by_q.setdefault(max(own, 1), []).append((item_id, cp, lo, hi))
    return [x for own, some in sorted(by_q.items()) for x in _indexed(some, own, edits)]


def _along(doc: np.ndarray, item: np.ndarray, first: int) -> np.ndarray:
    """Whether doc and item agree, along the diagonals first .. first + BAND - 1."""
    j = np.arange(len(item))[None, :] + (first + np.arange(BAND))[:, None]
    ok = (j >= 0) & (j < len(doc))
    return ok & (doc[np.where(ok, j, 0)] == item[None, :])


def _banded(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int, edits: int) -> np.ndarray:
    """Least edits of each window item[lo:hi] aligned within the diagonals first .. first + BAND - 1, by the diagonal it ends on.

    A row is a letter of the windows, so all windows are aligned at once. What costs more than `edits` may come out as any such value.
    """
    n, rows = len(lo), int((hi - lo).max())
    off = np.arange(BAND)
    d = np.zeros((n, BAND), dtype=np.int32)  # a window may begin on any diagonal of the band
    padded = np.concatenate([doc, np.zeros(1, dtype=doc.dtype)])
    for r in range(rows):
        at = lo + r
        live = at < hi
        j = at[:, None] + first + off[None, :]
        ok = (j >= 0) & (j < len(doc))
        hit = ok & (padded[np.where(ok, j, len(doc))] == item[np.minimum(at, len(item) - 1)][:, None])
        step = d + ~hit
        if edits:
            step[:, :-1] = np.minimum(step[:, :-1], d[:, 1:] + 1)  # a letter of the item that the document lacks
            step = np.minimum.accumulate(step - off, axis=1) + off  # letters that the document has besides
        d = np.where(live[:, None], step, d)
        if r % 16 == 15 and d.min() > edits:
            break
    return d


def _blocks(at: np.ndarray, many: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of the places in `at` that hold about HITS hits each. They overlap by `reach`, so any window lies within one of them."""
    total = np.cumsum(many)
    lo, n = 0, len(at)
    while True:
        before = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, before + HITS, side="right")), int(np.searchsorted(at, at[lo] + 2 * reach, side="right")))
        yield lo, min(hi, n)
        if hi >= n:
            return
        lo = int(np.searchsorted(at, at[hi] - reach, side="right"))  # at[hi] is 2 * reach behind at[lo] or more


def _bands(index: Index, at: np.ndarray, k: np.ndarray, many: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(document, item, first diagonal, item positions hit) of each band of diagonals in which enough q-grams meet."""
    flat = np.repeat(index.starts[k] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    pos, item = np.repeat(at, many), index.item[flat].astype(np.int64)
    spot = index.pos[flat]
    diag = pos - spot + (1 << 20)
    doc = np.searchsorted(base, at, side="right") - 1
    pair = np.repeat(doc, many) * len(index.ids) + item
    # two sets of bands, the second shifted by half a band, one after the other
    for shift in (0, BAND // 2):
        band = (diag + shift) // BAND
        key = pair * (1 << 24) + (band - band.min())
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        count = np.diff(np.append(heads, len(order)))
        keep = count >= np.maximum(index.bound[item[order[heads]]], 1)
        for h0, size in zip(heads[keep].tolist(), count[keep].tolist()):
            members = order[h0 : h0 + size]
            d = int(pair[members[0]]) // len(index.ids)
            yield d, int(item[members[0]]), int(band[members[0]]) * BAND - shift - (1 << 20) - int(base[d]), spot[members]


def search(indexes: list[Index], docs: list[tuple[int, str]]) -> list[tuple[int, int, int, bool]]:
    """(doc_id, item_id, edits, whole): edits of the nearest window within the budget; whole if one is there word for word."""
    if not indexes or not docs:
        return []
    parts = [stream(t) for _, t in docs]
    gap = np.zeros(1, dtype=np.uint32)
    cp = np.concatenate([x for p in parts for x in (p[0], gap)])
    base = np.cumsum([0, *(len(p[0]) + 1 for p in parts)])
    hashed: dict[int, np.ndarray] = {}
    out: list[tuple[int, int, int, bool]] = []
    for index in indexes:
        q, edits = index.q, index.edits
        h = hashed[q] if q in hashed else hashed.setdefault(q, grams(cp, q))
        at = np.flatnonzero(index.bitmap[(h >> np.uint64(42)).astype(np.int64)])
        k = np.searchsorted(index.keys, h[at])
        k[k == len(index.keys)] = 0
        real = index.keys[k] == h[at]
        at, k = at[real], k[real]
        if not len(at):
            continue
        many = index.starts[k + 1] - index.starts[k]
        done: dict[tuple[int, int], tuple[int, bool]] = {}
        for a, z in _blocks(at, many, index.reach):
            for d, i, first, spots in _bands(index, at[a:z], k[a:z], many[a:z], base):
                old = done.get((d, i))
                if old and old[1]:
                    continue
                # the bound again, for each window by itself
                lo, hi = index.windows[i]
                it = index.texts[i]
                seen = np.zeros(len(it) + 1, dtype=np.int32)
                seen[spots + 1] = 1
                np.cumsum(seen, out=seen)
                enough = seen[np.maximum(hi - q + 1, lo)] - seen[lo] >= hi - lo + 1 - q * (edits + 1)
                if not enough.any():
                    continue
                text, begin, end = parts[d]
                if old and not old[0]:  # only word for word would be nearer
                    x, y = (v[:, None] + first + np.arange(BAND) for v in (lo, hi - 1))
                    there = (x >= 0) & (y < len(text))
                    if not (there & begin[np.where(there, x, 0)] & end[np.where(there, y, 0)]).any():
                        continue
                same = _along(text, it, first)
                if edits:
                    # the lemma once more, for 3-grams on any diagonal of the band: an edit spoils at most three
                    lost = np.zeros(len(it) + 1, dtype=np.int32)
                    np.cumsum(~(same[:, :-2] & same[:, 1:-1] & same[:, 2:]).any(axis=0), out=lost[1:-2])
                    lost[-2:] = lost[-3]
                    enough &= lost[np.maximum(hi - 2, lo)] - lost[lo] <= 3 * edits
                else:
                    # without edits a window has to agree along one diagonal: a letter that agrees on none rules out its windows
                    lost = np.zeros(len(it) + 1, dtype=np.int32)
                    np.cumsum(~same.any(axis=0), out=lost[1:])
                    enough &= lost[hi] == lost[lo]
                if not enough.any():
                    continue
                lo, hi = lo[enough], hi[enough]
                cost = _banded(text, it, lo, hi, first, edits)
                w, o = np.nonzero(cost == 0)
                x, y = lo[w] + first + o, hi[w] + first + o - 1
                got = (int(cost.min()), bool((begin[x] & end[y]).any()))
                if got[0] <= edits and (old is None or (-got[0], got[1]) > (-old[0], old[1])):
                    done[d, i] = got
        out.extend((docs[d][0], int(index.ids[i]), e, w) for (d, i), (e, w) in done.items())
    return out


#: The index of the items last searched for in this process: workers are used for many tasks, and build it once.
_indexes: dict[str, list[Index]] = {}


def _index_of(shared, key: str, q: int, edits: int, window: int) -> list[Index]:
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = build_index(shared.value, q, edits, window)
    return _indexes[key]


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text",
    edits: int = EDITS, q: int = Q, window: int = WINDOW,
) -> DataFrame:
    """doc_id, item_id, edits, whole for all pairs where a window of the item's words is in the document within the edit budget.

    whole tells that `window` words of the item stand in the document one after the other. At most BAND // 2 edits can be asked for.
    Null and empty texts and items of fewer words have no pairs; repeated documents have a row each; other columns are ignored. Texts
    are searched whole.
    """
    if not 0 <= edits <= BAND // 2:
        raise ValueError(f"edits has to lie within 0 and {BAND // 2}")
    spark = documents.sparkSession
    its = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull())
    chars = its.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    docs = spread(docs, "doc_id")
    out: DataFrame | None = None
    for b in range(blocks):
        rows = its.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else its
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index_of(shared, key, q, edits, window)

            def emit(chunk: list[tuple[int, str]]) -> pa.RecordBatch:
                got = search(index, chunk)
                cols = list(zip(*got)) or [[], [], [], []]
                return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())], names=["doc_id", "item_id", "edits", "whole"])

            for batch in batches:
                chunk, size = [], 0
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    t = t.as_py()
                    chunk.append((i, t))
                    size += len(t)
                    if size >= CHUNK_CHARS:
                        yield emit(chunk)
                        chunk, size = [], 0
                if chunk:
                    yield emit(chunk)

        found = docs.mapInArrow(run, "doc_id long, item_id long, edits int, whole boolean")
        out = found if out is None else out.unionByName(found)
    return out
