"""The order tables' edges against plain Python over all lines."""

from collections import defaultdict

from factloom.plans import graph
from factloom.queries import queries


def whole_edges(spark, sf):
    """(source, target) names of every consecutive supplier pair of an order and every supplier and part of a line."""
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("region", "nation", "supplier", "part", "lineitem")}
    regions = {r.r_regionkey: r.r_name.lower().replace(" ", "_") for r in rows["region"]}
    nations = {r.n_nationkey: regions[r.n_regionkey] for r in rows["nation"]}
    name = {r.s_suppkey: f"trade.{nations[r.s_nationkey]}.n{r.s_nationkey}.S{r.s_suppkey}" for r in rows["supplier"]}
    coord = {r.p_partkey: f"{r.p_brand}:{r.p_type}:{r.p_size}" for r in rows["part"]}
    orders = defaultdict(list)
    for r in rows["lineitem"]:
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice, r.l_shipdate))
    edges = set()
    for lines in map(sorted, orders.values()):
        edges |= {(name[a[2]], name[b[2]]) for a, b in zip(lines, lines[1:]) if a[2] in name and b[2] in name}
        edges |= {(name[x[2]], coord[x[1]]) for x in lines if x[2] in name and x[1] in coord}
    return edges


def test_edges_of_all_lines(spark, sf):
    want = whole_edges(spark, sf)
    got = [(r.source_qualified_name, r.target_qualified_name) for r in queries()["whole_edge_facts"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cycle_members_of_all_lines(spark, sf):
    label = graph.tarjan(sorted(whole_edges(spark, sf)))
    edges = [(a, b) for a, b in whole_edges(spark, sf) if label[a] == label[b]]
    got = queries()["whole_cycle_members"](spark, sf).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.scc].add(r.node)
    assert sorted(map(len, groups.values())) == sorted(len({a for a, _ in edges if label[a] == x}) for x in {label[a] for a, _ in edges})


def test_findings_name_one_line_of_evidence(spark, sf):
    got = [r.subject_id for r in queries()["whole_layer_all"](spark, sf).select("subject_id").collect()]
    assert got and len(got) == len(set(got))
