"""Problems 1 to 4 against plain Python on whole small tables and on fixtures of awkward rows."""

import json
import random
from datetime import datetime

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import flatten, hierarchy, snapshotdiff, widen
from factloom.queries import queries
from factloom.session import table
from factloom.sources import poms


def rows(spark, sf, name):
    return [r.asDict() for r in table(spark, sf, name).collect()]


def test_p1_matches_brute_force(spark, sf):
    want = brute.hierarchy(brute.pom_links(rows(spark, sf, "raw_poms")))
    got = {r.pom_key: (r.root_key, r.node_depth, r.node_path) for r in queries()["p1_found"](spark, sf).collect()}
    assert got == {k: (root or "", depth, " > ".join(path) if path else "|".join(ring)) for k, (root, depth, path, ring) in want.items()}


def found(forest):
    """key -> (root, depth, path, cycle members) of all nodes."""
    rings = {r.cycle_key: r.m for r in forest.members().groupBy("cycle_key").agg(F.sort_array(F.collect_list("member_key")).alias("m")).collect()}
    out = {r.key: (r.path[0], len(r.path) - 1, r.path, None) for r in forest.paths().collect()}
    cyclic = {r.key: (None, -1, None, rings[r.cycle_key]) for r in forest.cyclic().collect()}
    assert not out.keys() & cyclic.keys()
    return out | cyclic


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = 120
    links = {f"n{i}": (None if rnd.random() < 0.1 else f"n{max(0, i - rnd.randint(1, 5)) if rnd.random() < 0.9 else rnd.randrange(n)}") for i in range(n)}
    links["n3"] = "n3"
    df = spark.createDataFrame([(k, p, "x") for k, p in links.items()], "key string, parent string, jump string")
    forest = hierarchy.hierarchy(df)
    want = brute.hierarchy(links)
    assert found(forest) == want
    trees = {k: v for k, v in want.items() if v[2]}
    got = {r.key: r for r in forest.intervals().collect()}
    assert got.keys() == trees.keys()
    for a, ra in got.items():
        assert (ra.node_depth, ra.subtree_size) == (trees[a][1], sum(1 for v in trees.values() if a in v[2]))
        for b, rb in got.items():
            inside = ra.root == rb.root and ra.enter < rb.enter <= ra.leave
            assert inside == (a != b and a in trees[b][2]), (a, b)
    assert sorted(tuple(r) for r in forest.sizes().collect()) == sorted((k, v[0], v[1], got[k].subtree_size) for k, v in trees.items())
    pairs = sorted((a, k, v[1] - i) for k, v in trees.items() for i, a in enumerate(v[2][:-1]))
    assert sorted(tuple(r) for r in forest.descendants().collect()) == pairs


def test_hierarchy_long_chain_and_hot_root(spark):
    links = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [(f"leaf{i}", "hot") for i in range(300)] + [("hot", None), (None, "hot"), ("lone", "nowhere")]
    links += [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)] + [("below", "r7"), ("under", "below")]
    forest = hierarchy.hierarchy(spark.createDataFrame(links, "key string, parent string"))
    got = found(forest)
    assert got["c69"][1:3] == (69, [f"c{i}" for i in range(70)]) and got["lone"][1:3] == (0, ["lone"])
    assert len(got) == 404 and len(got["under"][3]) == 30 and got["under"] == got["below"] == got["r0"]
    assert forest.sizes().where("key = 'hot'").first().subtree_size == 301
    assert forest.descendants().where("ancestor_key = 'hot'").count() == 300
    assert forest.members().count() == 30  # members stand once, however many nodes the cycle carries


def test_hierarchy_empty_and_only_cycles(spark):
    empty = hierarchy.hierarchy(spark.createDataFrame([], "key string, parent string"))
    assert not any(t.count() for t in (empty.paths(), empty.intervals(), empty.sizes(), empty.descendants(), empty.cyclic(), empty.members()))
    ring = hierarchy.hierarchy(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "key string, parent string"))
    assert ring.paths().count() == 0 and {tuple(r) for r in ring.cyclic().collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_interpolation(spark):
    df = spark.createDataFrame([("${a}", {"a": "${b}.x", "b": "org"}), ("${a}", {"a": "${a}"}), ("${q}", {}), (" plain ", {}), ("  ", {}), (None, None), ("${a}-${b}", {"a": "1", "b": "2"})], "v string, p map<string,string>")
    got = [r[0] for r in df.select(poms.interpolate(F.col("v"), F.col("p"))).collect()]
    assert got == ["org.x", None, None, "plain", None, None, "1-2"]


def test_p2_matches_brute_force(spark, sf):
    got = [tuple(r) for r in queries()["p2_found"](spark, sf).select("snapshot_no", "finding_id", "change_kind").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.snapshot_changes(rows(spark, sf, "finding_snapshots"))


def test_iblt_hash_is_sparks(spark):
    pairs = [(i * 7919 - 5, -i, i << 40) for i in range(50)]
    df = spark.createDataFrame(pairs, "a long, b long, c long")
    want = [r[0] for r in df.select(F.xxhash64("a", "b", "c")).collect()]
    assert snapshotdiff.hash_longs(*(np.array(x) for x in zip(*pairs))).tolist() == want


def test_small_buckets_grow_until_all_is_found(spark):
    t = datetime(2025, 1, 1)
    old = [(1, f"f{i}", "low", str(i), t) for i in range(400)]
    new = [(4, f"F{i} ", "low" if i % 3 else None, str(i), t) for i in range(200, 700)] + [(None, "x", "low", "1", t), (4, None, "low", "1", t), (4, " ", "low", "1", None)]
    df = spark.createDataFrame(old + new, "snapshot_no int, finding_id string, severity string, fingerprint string, loaded_at timestamp").withColumn("pair", F.lit(1))
    folded = snapshotdiff.fold(df, "snapshot_no", F.lower(F.trim("finding_id")), [F.col("severity"), F.col("fingerprint")], "loaded_at")
    by = {r[0]: r[1] for r in snapshotdiff.changes(folded, bucket_keys=250, first_cells=8).groupBy("change_kind").count().collect()}
    assert by == {"added": 300, "removed": 200, "changed": sum(1 for i in range(200, 400) if i % 3 == 0)}


def test_p2_empty_and_single(spark):
    schema = "snapshot_no int, finding_id string, severity string, fingerprint string, loaded_at timestamp"
    assert snapshotdiff.snapshot_changes(spark.createDataFrame([], schema)).count() == 0
    assert snapshotdiff.snapshot_changes(spark.createDataFrame([(1, "a", None, None, None)], schema)).count() == 0


def test_p3_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in queries()["p3_found"](spark, sf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.report_facts(rows(spark, sf, "report_documents"))


def test_p3_awkward_bodies(spark):
    bodies = [None, "", "{", "[]", "null", "3", '{"findings":{"id":"f","evidenceIds":["e",null,"e"],"extensions":{"a":{"b":{"c":["v"]}}}}}', '{"components":[null,3,{"id":"c","location":{"path":"p"}}],"findings":"x"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "report_id long, body string")
    assert {tuple(r) for r in flatten.facts(df).collect()} == {(6, "finding", "f", "evidence", "e"), (6, "finding", "f", "extension", "a.b.c=v")}
    assert flatten.components(df).count() == 1 and flatten.findings(df).count() == 1


def test_p3_any_depth(spark):
    deep = {"v": ["x", 1]}
    for k in "gfedcba":
        deep = {k: deep, "t": "u"}
    report = {"components": [{"id": "c", "extensions": deep}]}
    wrapped = report
    for i in range(7):
        wrapped = [{"report": wrapped}] if i % 3 == 0 else {"payload": json.dumps(wrapped)} if i % 3 == 1 else json.dumps(wrapped)
    df = spark.createDataFrame([(0, json.dumps(report)), (1, json.dumps(wrapped))], "report_id long, body string")
    want = {f"{'.'.join('abcdefg'[:i])}{'.' if i else ''}t=u" for i in range(7)} | {"a.b.c.d.e.f.g.v=x", "a.b.c.d.e.f.g.v=1"}
    assert {tuple(r) for r in flatten.facts(df).collect()} == {(i, "component", "c", "extension", w) for i in (0, 1) for w in want}
    assert {r.report_id for r in flatten.components(df).collect()} == {0, 1}


def test_p4_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in queries()["p4_found"](spark, sf).collect()]
    assert len(got) == len(set(got))
    want = brute.filled_cells(rows(spark, sf, "extension_values"), rows(spark, sf, "extension_keys"))
    assert set(got) == want


def test_p4_wide_table_types_and_batches(spark):
    keys = spark.createDataFrame([("a.n", "x", "int"), ("a.l", "x", "string_list"), ("a.t", "x", "timestamp")], "ext_key string, entity_kind string, value_type string")
    t = datetime(2025, 1, 1)
    vals = [("x", f"e{i}", k, v, t) for i in range(50) for k, v in ((" A.N", str(i)), ("a.l", "q"), ("a.l", '["r", " "]'), ("a.t", "bad"), ("zz", "1"))] + [("x", "only", "zz", "1", None), ("x", None, "a.n", "1", t)]
    df = spark.createDataFrame(vals, "entity_kind string, entity_id string, ext_key string, ext_value string, loaded_at timestamp").withColumn("idx", F.lit(9))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: tuple(r)[1:] for r in widen.wide_table(df, keys, "x").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 51 and got["only"] == ({}, None, None, None)
    assert got["e7"][1] == ["q", "r"] and int(got["e7"][2]) == 7 and got["e7"][3] is None


def test_p4_numbers_are_exact(spark):
    cases = {
        "n": {"123456789012345678901234567": "123456789012345678901234567", "-" + "9" * 60: "-" + "9" * 60, "+007": "7", "-0": "0", "1,234,567.00": "1234567", "1.5": None, "": None},
        "d": {"9" * 29: "9" * 29, "0.00000000000049": "0.00000000000049", "-1,50": "-1.5", "1e3": "1000", "12.345E-2": "0.12345", "-2.50e1": "-25", "1e-30": "0." + "0" * 29 + "1", ",5": "0.5", "5.": "5", "-0.0": "0", "x": None, "1e400": "1" + "0" * 400},
    }
    keys = spark.createDataFrame([("n", "x", "int"), ("d", "x", "decimal")], "ext_key string, entity_kind string, value_type string")
    vals = [("x", f"{k}{i}", k, v) for k, c in cases.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(vals, "entity_kind string, entity_id string, ext_key string, ext_value string").withColumn("loaded_at", F.lit(None).cast("timestamp"))
    got = {r.entity_id: r.cell_value for r in widen.filled_cells(df, keys).collect()}
    assert got == {f"{k}{i}": w for k, c in cases.items() for i, w in enumerate(c.values()) if w is not None}
    wide = {r.entity_id: r for r in widen.wide_table(df, keys, "x").collect()}
    assert wide["n0"].n == 123456789012345678901234567 and wide["n1"].n is None and wide["n1"].exact_numbers == {"n": "-" + "9" * 60}
