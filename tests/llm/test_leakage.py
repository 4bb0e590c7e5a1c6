"""Problem 7 against a plain search for 13 words."""

import html
import random
import re
import tracemalloc
import unicodedata

from factloom.llm import leakage


def words(text):
    text = unicodedata.normalize("NFKD", html.unescape(text)).casefold()
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    text = re.sub(r"(\w)-\n[\s*/]*(\w)", r"\1\2", text)
    return re.findall(r"[^\W_]+", text)


def brute(docs, items):
    out = set()
    for i, t in items:
        w = words(t or "")
        runs = {" ".join(w[k : k + 13]) for k in range(len(w) - 12)}
        for d, x in docs:
            if x and runs:
                dw = words(x)
                if any(" ".join(dw[k : k + 13]) in runs for k in range(len(dw) - 12)):
                    out.add((d, i))
    return out


def test_matches_brute_force_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    from factloom.llm.queries import queries

    got = {tuple(r) for r in queries()["p7_found"](spark, sf).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.item_text) for r in items.collect()])
    assert got == want and want


def test_layout_markup_and_encodings():
    item = "Die Prüfung der zweiten Schicht meldet täglich elf Kreise zwischen Modulen und übergeht dabei harmlose Kanten sowie Schleifen"
    w = item.split()
    forms = {
        1: item.upper(), 2: item.replace(" ", "_"), 3: html.escape(item).replace("ü", "&#252;"), 4: unicodedata.normalize("NFD", item),
        5: "​".join(item), 6: item.replace("Schicht", "Schi-\n * cht"), 7: "**" + "** **".join(w) + "**", 8: " ".join(w[:12]), 9: " ".join(w[2:15]),
        10: " ".join([*w[:6], "x", *w[6:]]), 11: " ".join(f"<b>{x}</b>" for x in w), 12: "x" + item + "y", 13: item.replace("ü", "u").replace("ä", "a"),
    }
    index = leakage.build_index([(7, item), (8, None), (9, "short text")])
    got = {(d, w) for d, _, _, w in leakage.search(index, list(forms.items()))}
    assert {d for d, whole in got if whole} == {1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13}


def test_edit_budget():
    rnd = random.Random(1)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(13))
    index = leakage.build_index([(1, item)])
    one, two = item.replace(item[30:32], item[30] + "q", 1), item[:20] + "z" + item[20:60] + item[61:]
    got = {d: e for d, _, e, _ in leakage.search(index, [(1, item), (2, one), (3, two), (4, "q" + item[3:40])])}
    assert got[1] == 0 and got[2] == 1 and 3 not in got and 4 not in got


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 50000, "c"), (None, "y", "d")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, None), (2, ""), (None, "z"), (3, " ".join(map(str, range(30))))], "item_id long, item_text string")
    assert leakage.leaks(docs, items).count() == 0
    assert leakage.leaks(docs.limit(0), items.limit(0)).count() == 0


def _distance(a, b, limit):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > limit:
            return limit + 1
    return row[-1]


def test_all_edits_within_the_budget_are_found():
    """Windows of random words, long and short, changed by 0 to 4 random edits: every one within the budget comes out, with its distance at most."""
    rnd = random.Random(5)
    for edits in (0, 1, 2, 3):
        items, docs, within = [], [], set()
        for i in range(60):
            size = 1 if i % 6 == 0 else rnd.randint(2, 8)
            item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(size)) for _ in range(13))
            text = list(item)
            for _ in range(rnd.randint(0, 4)):
                at, letter = rnd.choice([k for k, c in enumerate(text) if c != " "]), rnd.choice("klm")
                text[at : at + 1] = rnd.choice([[letter], [text[at], letter], []]) or [" "]
            items.append((i, item))
            docs.append((i, "x y " + "".join(text) + " z"))
            a, b = item.replace(" ", ""), "".join(text).replace(" ", "")
            if _distance(a, b, edits) <= edits:
                within.add(i)
        got = {(d, i): e for d, i, e, _ in leakage.search(leakage.build_index(items, edits=edits), docs) if d == i}
        assert within <= {d for d, _ in got} and all(e <= edits for e in got.values()) and len(within) > 4


def test_repetitive_texts_take_little_memory():
    items = [(i, " ".join(["a" * 10] * 48)) for i in range(5)] + [(9, " ".join("abcdefghijklmnop"))]
    docs = [(1, " ".join(["a" * 10] * 640)), (2, "a" * 6400), (3, " ".join("abcdefghijklmnopq" * 3))]
    tracemalloc.start()
    got = {(d, i): w for d, i, _, w in leakage.search(leakage.build_index(items), docs)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000, peak
    assert {k for k, w in got.items() if w} == {(1, i) for i in range(5)} | {(3, 9)}
    assert {(2, i) for i in range(5)} <= got.keys()  # the letters are there, the words are not


def test_blocks_of_items_and_documents_change_nothing(monkeypatch):
    rnd = random.Random(2)
    words_ = ["".join(rnd.choice("ab") for _ in range(4)) for _ in range(12)]
    items = [(i, " ".join(rnd.choice(words_) for _ in range(20))) for i in range(30)]
    docs = [(d, " ".join(rnd.choice([items[rnd.randrange(30)][1], " ".join(rnd.choice(words_) for _ in range(9))]) for _ in range(12))) for d in range(10)]
    want = sorted(leakage.search(leakage.build_index(items, edits=0), docs))
    monkeypatch.setattr(leakage, "HOT", 3)
    monkeypatch.setattr(leakage, "HITS", 50)
    assert sorted(leakage.search(leakage.build_index(items, edits=0), docs)) == want
    assert {(d, i) for d, i, _, w in want if w} == brute(docs, items)
