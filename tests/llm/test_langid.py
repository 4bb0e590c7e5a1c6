"""Problem 8: blocks, prose, models and whole-table accuracy on clear labels."""

import numpy as np
import pytest

from factloom.llm import langid, prose
from factloom.llm.queries import queries


def texts_of(*texts):
    s = prose.streams(list(texts))
    return [(int(t), int(n), s.cp[a:b].tobytes().decode("utf-32-le")) for t, n, a, b in zip(s.text, s.number, s.start, s.end)]


def test_blocks_and_prose():
    text = "# Head / FooBar\nFirst line of org.foo.bar here.\n\n```java\nint x = 3;\n\nint y;\n```\n \t\nSecond “short quote” part, snake_case and x1.\n\n\n"
    assert texts_of(text) == [(0, 1, "head first line of here"), (0, 4, "second part and")]


def test_comment_stars_and_line_ends():
    assert texts_of("/**\r\n * One two.\r\n *\r\n * ```\r\n * code here\r\n * ```\r\n *\r\n * Three four.\r\n */\r\npublic interface X { }") == [(0, 1, "one two"), (0, 3, "three four")]


def test_odd_texts():
    assert texts_of("", " \n\n ", "{}", "a", "```\nnever closed\n\nplain words after") == [(4, 2, "plain words after")]
    assert texts_of("w​or­ds ｉｎ fu\U0001f600ll", "x " * 10)[0][2] == "words in fu ll"
    assert texts_of(*[""] * 3) == []


def test_kneser_ney_sums_to_one():
    s = prose.streams(["banana bandana ananas band and nab"])
    m = langid.fit({"en": langid._pieces(s)})
    chars = [*np.unique(s.cp), ord("ж")]  # one stands for all unknown characters
    for ctx in ("bana", "xxba", " nab"):
        probs = [np.exp(m.score(np.array([*map(ord, ctx), c], dtype=np.uint32))[0, 0]) for c in chars]
        assert sum(probs) == pytest.approx(1, abs=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([("en_GB",), ("German",), (" PT-br",), ("und",), (None,), ("",), ("nl",), ("ZH",)], "l string")
    assert [r[0] for r in df.select(langid.label_language(df.l)).collect()] == ["en", "de", "pt", None, None, None, None, "zh"]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["p8_languages"](spark, sf).where("segment_no = 0 and label_lang is not null and n_langs = 1").collect()
    same = sum(r.lang_found == r.label_lang for r in rows)
    assert same / len(rows) > 0.85  # the rest are labels that are wrong
    assert all(0 <= r.confidence <= 1 for r in rows)


def test_found_is_distinct_and_awkward_rows(spark, sf):
    got = queries()["p8_found"](spark, sf).collect()
    assert len(got) == len(set(got)) and {r.lang_found for r in got} <= set(langid.LANGUAGES)
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \n", "en"), (4, "{};", "de"), (None, "words without id", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.languages(docs).collect()} == {4, None}
    assert langid.languages(docs.limit(0)).count() == 0
