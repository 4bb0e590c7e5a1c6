"""Problem 8: languages of documents and paragraphs, by interpolated Kneser-Ney character models.

One model per language over character n-grams, kept in sorted hash arrays: for each order the hashes of all n-grams seen in any
language, beside them a row of finished interpolated log probabilities (one column a language) and a row of back-off weights
for contexts. A character costs one binary search where its longest n-gram was seen, one more for each shorter order where not.
The language with the lowest cross-entropy per character wins; thresholds on the entropy and on the margin, calibrated on rows
held out from training, reject what is in none of the languages.

The models are fitted on a bounded sample of labelled rows (SAMPLE_ROWS a language, SAMPLE_CHARS a row) and cleaned of wrong
labels by one round of self-agreement. All documents are then read whole, in place; nothing is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.prose import PAD, Streams, streams
from factloom.session import spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
#: Order of the models; rows sampled per language for fitting, and characters used of each such row.
ORDER, SAMPLE_ROWS, SAMPLE_CHARS = PAD, 250, 4000
#: Cross-entropies (nats a character) below which no text is rejected, however regular the fitted texts were.
LEAST_LIMIT = 3.0
#: Scales tried for the confidence.
HEATS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)
#: Characters handled at once in a task.
CHUNK_CHARS = 200_000
#: Spellings of the languages in labels: fixed values (ISO 639 codes, English and own names).
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский", "zh": "zh zho chi cmn chinese 中文 汉语 漢語 mandarin", "ja": "ja jpn jp japanese 日本語",
}
_NAMES = {s: lang for lang, names in SPELLINGS.items() for s in names.split()}
#: Labels that name no language: fixed values.
NO_LABEL = ("", "-", "n/a", "na", "none", "null", "und", "unknown", "unk", "mul", "zxx", "?")


def label_language(label: Column) -> Column:
    """The language a label names by any of its spellings (en_GB, eng, English, ...); other labels become null."""
    base = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^[\s\p{Z}]*([^\s\p{Z}_\-;,.()]+)", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv)), base)


def without_marks(text: str) -> str:
    """Latin letters without accents, as some texts have lost them; other scripts stay as they are."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ"))


# ---- models

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hash(cp: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n-grams that end at the positions `at`, or at all positions from PAD - 1 on."""
    first = None if at is None else at - (n - 1)
    size = len(cp) - PAD + 1 if at is None else len(at)
    with np.errstate(over="ignore"):
        h = np.full(size, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ (cp[PAD - n + j : PAD - n + j + size] if first is None else cp[first + j])) * _M1
            h ^= h >> np.uint64(31)
        return h * _M2


class Sorted:
    """A sorted array of hashes, with the place where each leading bit pattern begins."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.zeros(1, dtype=np.uint64)
        tops = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.minimum(np.searchsorted(tops, np.arange(1 << self.BITS)), len(self.keys) - 1).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash and whether it is there."""
        k = self.first[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        hit = self.keys[k] == h
        for _ in range(2):  # a pattern mostly has one or two hashes
            miss = np.flatnonzero(~hit & (self.keys[k] < h))
            if not len(miss):
                return k, hit
            k[miss] = np.minimum(k[miss] + 1, len(self.keys) - 1)
            hit[miss] = self.keys[k[miss]] == h[miss]
        miss = np.flatnonzero(~hit & (self.keys[k] < h))
        if len(miss):
            k[miss] = np.minimum(np.searchsorted(self.keys, h[miss]), len(self.keys) - 1)
            hit[miss] = self.keys[k[miss]] == h[miss]
        return k, hit


@dataclass
class Model:
    """keys[n], logp[n]: n-grams of order n and their finished log probabilities; ctx[n], gamma[n]: contexts and back-off weights."""

    keys: dict[int, Sorted] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    ctx: dict[int, Sorted] = field(default_factory=dict)
    gamma: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray | None = None
    worst: np.ndarray | None = None
    heat: float = 1.0

    def score(self, cp: np.ndarray) -> np.ndarray:
        """Log probability of each character from PAD - 1 on, a column per language."""
        k, hit = self.keys[ORDER].find(_hash(cp, ORDER))
        out = self.logp[ORDER][k]
        todo = np.flatnonzero(~hit)
        out[todo] = 0
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                k, hit = self.keys[order].find(_hash(cp, order, todo + PAD - 1))
                out[todo[hit]] += self.logp[order][k[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            if order > 1:
                k, seen = self.ctx[order].find(_hash(cp, order - 1, todo + PAD - 2))
                out[todo[seen]] += self.gamma[order][k[seen]]
        out[todo] += self.floor
        return out

    def judge(self, s: Streams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index, -1 if rejected) of each paragraph, its confidence, and its cross-entropy per character."""
        if not len(s.start):
            return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        logp = self.score(s.cp)
        # character i of the stream has row i - PAD + 1; a paragraph's closing blank is scored too
        bounds = np.stack([s.start - PAD + 1, s.end - PAD + 2], axis=1).ravel()
        total = np.add.reduceat(np.concatenate([logp, np.zeros((1, logp.shape[1]), dtype=logp.dtype)]), bounds, axis=0, dtype=np.float64)[::2]
        n = s.end - s.start + 1
        per = -total / n[:, None]
        best = per.argmin(axis=1)
        low = per[np.arange(len(n)), best]
        z = np.exp(-(per - low[:, None]) * self.heat * np.sqrt(n)[:, None])
        lang = best if self.worst is None else np.where(low <= self.worst[best], best, -1)
        return lang, 1 / z.sum(axis=1), low


def fit(texts: dict[str, list[np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models of the languages' paragraphs (padded streams), one discount an order."""
    m = Model()
    per: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in range(1, ORDER + 1)}
    for lang in LANGUAGES:
        parts = texts.get(lang, [])
        if not parts:
            for n in per:
                per[n].append((np.zeros(0, np.uint64), np.zeros((0, 4))))
            continue
        cp = np.concatenate(parts)
        lens = np.cumsum([len(p) for p in parts])
        inner = np.ones(len(cp) - PAD + 1, dtype=bool)
        for e in lens[:-1]:
            inner[e - PAD + 1 : e] = False
        shifted = np.concatenate([cp[:1], cp[:-1]])
        H = {n: _hash(cp, n)[inner] for n in range(1, ORDER + 1)}
        C = {n: _hash(shifted, n - 1)[inner] if n > 1 else np.zeros(inner.sum(), np.uint64) for n in range(1, ORDER + 1)}
        gram, first, count = np.unique(H[ORDER], return_index=True, return_counts=True)
        for n in range(ORDER, 0, -1):
            # count: at the highest order occurrences, below it the number of different characters in front
            ctx = C[n][first]
            cu, ci = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(ci, weights=count), np.bincount(ci)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            per[n].append((gram, np.stack([np.maximum(count - d, 0) / total[ci], d * kinds[ci] / total[ci], ctx.view(np.float64), H[n - 1][first].view(np.float64) if n > 1 else np.zeros(len(gram))], axis=1)))
            if n > 1:
                low_all = H[n - 1][first]
                gram, back, count = np.unique(low_all, return_index=True, return_counts=True)
                first = first[back]
    raw: dict[int, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        raw[n] = np.unique(np.concatenate([g for g, _ in per[n]]))
        m.keys[n] = Sorted(raw[n])
        p = np.zeros((len(raw[n]), len(LANGUAGES)))
        lower = np.zeros(len(raw[n]), dtype=np.uint64)
        context = np.zeros(len(raw[n]), dtype=np.uint64)
        for g, v in per[n]:
            at = np.searchsorted(raw[n], g)
            context[at], lower[at] = v[:, 2].copy().view(np.uint64), v[:, 3].copy().view(np.uint64)
        if n == 1:
            # what the discounts leave over is spread evenly over all known characters and one that stands for the unknown
            left = np.array([v[0, 1] if len(v) else 1.0 for _, v in per[n]]) / (len(raw[n]) + 1)
            for j, (g, v) in enumerate(per[n]):
                p[np.searchsorted(raw[n], g), j] = v[:, 0]
            m.logp[n], m.floor = np.log(p + left).astype(np.float32), np.log(left).astype(np.float32)
            continue
        ctx = np.unique(context)
        m.ctx[n] = Sorted(ctx)
        gamma = np.ones((len(ctx), len(LANGUAGES)))
        for j, (g, v) in enumerate(per[n]):
            at = np.searchsorted(raw[n], g)
            gamma[np.searchsorted(ctx, context[at]), j] = v[:, 1]
            p[at, j] = v[:, 0]
        m.gamma[n] = np.log(gamma).astype(np.float32)
        base = np.exp(m.logp[n - 1][np.searchsorted(raw[n - 1], lower)].astype(np.float64))
        m.logp[n] = np.log(p + gamma[np.searchsorted(ctx, context)] * base).astype(np.float32)
    return m


def _pieces(s: Streams, extra: int = 0) -> list[np.ndarray]:
    """The paragraphs with their blanks; with extra, at most so many characters of each."""
    return [s.cp[a - PAD + 1 : (b if not extra else min(b, a + extra)) + 1] for a, b in zip(s.start, s.end)]


def _agreeing(parts: list[np.ndarray], label: np.ndarray, n: int = 4, rounds: int = 2) -> np.ndarray:
    """Whether each labelled paragraph is in its label's language, by joint n-gram frequencies."""
    hs = [_hash(p, n) for p in parts]
    keys, flat = np.unique(np.concatenate(hs), return_inverse=True)
    idx = np.split(flat, np.cumsum([len(h) for h in hs])[:-1])
    ok = np.ones(len(parts), dtype=bool)
    for _ in range(rounds):
        count = np.full((len(keys), len(LANGUAGES)), 0.05)
        for j in range(len(LANGUAGES)):
            mine = [i for i, good, x in zip(idx, ok, label) if good and x == j]
            if mine:
                count[:, j] += np.bincount(np.concatenate(mine), minlength=len(keys))
        logp = np.log(count / count.sum(axis=0))
        ok = np.array([int(logp[i].sum(axis=0).argmax()) for i in idx]) == label
    return ok


def _joined(parts: list[np.ndarray]) -> Streams:
    lens = np.array([len(p) for p in parts])
    ends = np.cumsum(lens) - 1
    start = ends - lens + PAD
    z = np.zeros(len(parts), dtype=np.int64)
    return Streams(np.concatenate(parts), start, ends, z, z, ends - start)


def train(rows: list[tuple[str, str]]) -> Model:
    """A calibrated model of (language, text) rows whose labels may be partly wrong.

    Labels are cleaned first: joint frequencies of character 4-grams, in which a few foreign paragraphs under a label weigh
    little, judge every paragraph, twice over; those they put into another language are left out. Every fifth row is held out
    to set the rejection thresholds and, on short snippets, the scale of the confidence; the final models take all rows.
    Texts in Latin letters are fitted once more without their accents, as some texts have lost them.
    """
    s = streams([t[:SAMPLE_CHARS] for _, t in rows])
    parts = _pieces(s)
    if not parts:
        return Model()
    label = np.array([LANGUAGES.index(rows[k][0]) for k in s.text])
    agree = _agreeing(parts, label)
    held = s.text % 5 == 0
    bare = streams([without_marks(t[:SAMPLE_CHARS]) if x in ("de", "fr", "es", "pt") else "" for x, t in rows])
    bares = {(k, n): p for k, n, p in zip(bare.text.tolist(), bare.number.tolist(), _pieces(bare))}

    def gather(keep: np.ndarray) -> dict[str, list[np.ndarray]]:
        out: dict[str, list[np.ndarray]] = {x: [] for x in LANGUAGES}
        for i in np.flatnonzero(keep):
            out[LANGUAGES[label[i]]].append(parts[i])
            if (b := bares.get((int(s.text[i]), int(s.number[i])))) is not None:
                out[LANGUAGES[label[i]]].append(b)
        return out

    worst, heat = np.full(len(LANGUAGES), 9.0), 1.0
    test = np.flatnonzero(agree & held & (s.end - s.start > 40))
    if len(test) >= 20 and (agree & ~held).any():
        model = fit(gather(agree & ~held))
        truth = label[test]
        _, _, ent = model.judge(_joined([parts[i] for i in test]))
        for j in range(len(LANGUAGES)):
            e = ent[truth == j]
            if len(e) >= 5:
                worst[j] = max(LEAST_LIMIT, e.mean() + 8 * e.std())
        short = _joined([p for i, p in zip(range(len(parts)), _pieces(s, 14)) if i in set(test.tolist())])
        fits = []
        for heat in HEATS:
            model.heat = heat
            best, conf, _ = model.judge(short)
            fits.append(float(np.log(np.clip(np.where(best == truth, conf, 1 - conf), 1e-6, 1)).sum()))
        heat = HEATS[int(np.argmax(fits))]
    model = fit(gather(agree))
    model.worst, model.heat = worst, heat
    return model


def sample(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About SAMPLE_ROWS labelled rows a language, chosen by a hash of the id, so the same rows at every partitioning."""
    named = documents.select(F.xxhash64(doc_id).alias("h"), label_language(F.col(lang)).alias("l"), F.substring(text, 1, SAMPLE_CHARS).alias("t")).where("l is not null and length(t) > 40")
    counts = {r[0]: r[1] for r in named.groupBy("l").count().collect()}
    # a threshold on the hash in place of a sort: the sample's size is bounded in expectation, and cut off at twice that
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_ROWS / n)))) if counts else None
    if share is None:
        return []
    picked = named.where(F.pmod("h", F.lit(1_000_003)) < F.try_element_at(share, F.col("l")) * 1_000_003).limit(2 * SAMPLE_ROWS * len(LANGUAGES))
    return [(r[0], r[1]) for r in picked.select("l", "t", "h").orderBy("h").collect()]


def languages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, label_lang, segment_no, lang_found, confidence, n_letters, n_langs.

    segment_no 0 is the document: the language of most letters of its prose; 1, 2, ... are its prose paragraphs, numbered over
    all blocks. lang_found is null where no language is near enough or no prose is there; n_langs is the number of different
    languages among the document's paragraphs. Null and blank texts have no rows.
    """
    spark = documents.sparkSession
    model = model or train(sample(documents, doc_id, text, lang))
    shared = spark.sparkContext.broadcast(model)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), label_language(F.col(lang)).alias("label_lang"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}]"))
    docs = spread(docs, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("label_lang", pa.string()), ("segment_no", pa.int32()), ("lang_found", pa.string()), ("confidence", pa.float64()), ("n_letters", pa.int64()), ("n_langs", pa.int32())])

    def emit(m: Model, ids: list[int], labels: list[str | None], texts: list[str]) -> pa.RecordBatch:
        n, k = len(texts), len(LANGUAGES)
        s = streams(texts)
        best, conf, _ = m.judge(s) if m.keys else (np.full(len(s.start), -1), np.zeros(len(s.start)), None)
        known = best >= 0
        weight, sure = np.zeros((n, k)), np.zeros((n, k))
        np.add.at(weight, (s.text[known], best[known]), s.letters[known])
        np.add.at(sure, (s.text[known], best[known]), s.letters[known] * conf[known])
        kinds, total, top = (weight > 0).sum(axis=1), weight.sum(axis=1), weight.argmax(axis=1)
        whole = sure[np.arange(n), top] / np.maximum(total, 1)
        doc = np.concatenate([np.arange(n), s.text]).astype(np.int64)
        lang = np.concatenate([np.where(total > 0, top, -1), best]).astype(np.int64)
        names = pa.array(LANGUAGES).take(pa.array(lang, mask=lang < 0))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(labels, pa.string()).take(pa.array(doc)),
            pa.array(np.concatenate([np.zeros(n), s.number]), pa.int32()), names, pa.array(np.concatenate([whole, conf])),
            pa.array(np.concatenate([total, s.letters]).astype(np.int64)), pa.array(kinds[doc].astype(np.int32)),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            sizes = pc.utf8_length(batch.column(2)).to_numpy()
            a = 0
            while a < batch.num_rows:  # whole texts, as many as make a chunk
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), CHUNK_CHARS, side="right")))
                part = batch.slice(a, b - a)
                yield emit(m, *(part.column(j).to_pylist() for j in range(3)))
                a = b

    return docs.mapInArrow(run, "doc_id long, label_lang string, segment_no int, lang_found string, confidence double, n_letters long, n_langs int")
