"""Dependency graphs: adjacency, quotients, and strongly connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, cut_observed


def outgoing(edges: DataFrame) -> DataFrame:
    """project_id, node, neighbours (sorted, distinct) of all nodes with edges."""
    return edges.groupBy("project_id", F.col("source_id").alias("node")).agg(F.array_sort(F.collect_set("target_id")).alias("neighbours"))


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id", F.col("target_id").alias("node")).agg(F.array_sort(F.collect_set("source_id")).alias("neighbours"))


def tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Node -> smallest member of its strongly connected component; iterative, so depth is no matter."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    label: dict[str, str] = {}
    path: list[str] = []
    for root in sorted(out):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        path.append(root)
        work: list[tuple[str, Iterator[str]]] = [(root, iter(out[root]))]
        while work:
            v, nxt = work[-1]
            for w in nxt:
                if w not in index:
                    index[w] = low[w] = len(index)
                    path.append(w)
                    work.append((w, iter(out[w])))
                    break
                if w not in label:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = path.index(v) if len(path) < 64 else len(path) - 1 - path[::-1].index(v)
                    members = path[at:]
                    del path[at:]
                    label.update(dict.fromkeys(members, min(members)))
    return label


#: Edges up to which a project's graph is one task's group: the edge budget of a project (rule.limit.edges).
GROUP_EDGES = 1_000_000


def _thinned(pairs: list[tuple]) -> list[tuple]:
    """Fewer edges between the same nodes with the same ways from node to node: each component is one ring, its edges to others start
    and end at its smallest member. A node without edges to others keeps a self loop."""
    label = tarjan(pairs)
    members: dict = {}
    for v, low in label.items():
        members.setdefault(low, []).append(v)
    out = {(label[a], label[b]) for a, b in pairs if label[a] != label[b]}
    for vs in members.values():
        out.update(zip(vs, vs[1:] + vs[:1]))
    return list(out)


def thinned(edges: DataFrame, most: int) -> DataFrame:
    """Edges with the same components, thinned in blocks of at most `most` edges for as long as that leaves less than half.

    Any part of a graph may be thinned for itself, so blocks are cut where the rows happen to lie.
    """
    schema = edges.select("project_id", "source_id", "target_id").schema

    def run(batches):
        import pandas as pd

        def block(pdfs):
            pdf = pd.concat(pdfs).drop_duplicates()
            for p, g in pdf.groupby("project_id", sort=False):
                got = _thinned(list(zip(g["source_id"].tolist(), g["target_id"].tolist())))
                yield pd.DataFrame({"project_id": p, "source_id": [a for a, _ in got], "target_id": [b for _, b in got]})

        held, n = [], 0
        for pdf in batches:
            if held and n + len(pdf) > most:
                yield from block(held)
                held, n = [], 0
            held.append(pdf)
            n += len(pdf)
        if held:
            yield from block(held)

    pairs, n = edges.select("project_id", "source_id", "target_id"), None
    while True:
        pairs = cut(pairs.mapInPandas(run, schema))
        now = pairs.count()
        if now <= most or (n is not None and 2 * now > n):
            return pairs.distinct()
        n = now
        pairs = pairs.coalesce(max(1, -(-now // most)))


#: Edges in memory at once while a graph is thinned.
BLOCK_EDGES = 500_000


def scc(edges: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """project_id, node, scc (smallest member) of the graphs of all projects; self loops and parallel edges change nothing.

    A project of at most group_edges different edges is one task's group, so projects run side by side in bounded memory. Larger
    ones are coloured by rounds of joins over all of them, whatever their size; see coloured().
    """
    kind = dict(edges.dtypes)["source_id"]
    pairs = cut(thinned(edges, BLOCK_EDGES))
    # one row per project that is over the bound: at most (edges / group_edges) of them
    large = pairs.groupBy("project_id").agg(F.count("*").alias("n")).where(F.col("n") > group_edges).select("project_id")

    def one(pdf):
        import pandas as pd

        got = tarjan(list(zip(pdf["source_id"].tolist(), pdf["target_id"].tolist())))
        return pd.DataFrame({"project_id": pdf["project_id"].iloc[0], "node": list(got), "scc": list(got.values())})

    small = pairs.join(large, "project_id", "left_anti").groupBy("project_id").applyInPandas(one, f"project_id string, node {kind}, scc {kind}")
    if large.isEmpty():
        return small
    return small.unionByName(coloured(pairs.join(large, "project_id", "left_semi")))


_ENDS = ("source_id", "target_id")


def _spread_to_end(state: DataFrame, edges: DataFrame, towards: str, column: str) -> DataFrame:
    """state (project_id, node, <column>): each node's column raised to the greatest that reaches it along the edges, to the fix point."""
    come = _ENDS[1 - _ENDS.index(towards)]
    while True:
        sent = edges.join(state.withColumnRenamed("node", come).hint("merge"), ["project_id", come])
        # the greatest value a node is sent: pre-aggregated, so a node of many edges costs one row a task
        best = sent.groupBy("project_id", F.col(towards).alias("node")).agg(F.max(column).alias("_new"))
        state, seen = cut_observed(
            state.join(best.hint("merge"), ["project_id", "node"], "left").select("project_id", "node", F.greatest(column, "_new").alias(column), F.coalesce(F.col("_new") > F.col(column), F.lit(False)).alias("_up")),
            raised=F.count_if("_up"),
        )
        state = state.drop("_up")
        if not seen["raised"]:
            return state


def coloured(pairs: DataFrame) -> DataFrame:
    """scc() by rounds over whole tables. A round drops nodes without a way in or out; colours the rest by the greatest node that leads
    there; in each colour, the nodes that lead to the one it is named for are a component; edges between colours or to a component
    lie in no other component and go. Each round settles a component per colour, so it ends.
    """
    left = cut(pairs.where("source_id <> target_id").distinct())
    nodes = pairs.select("project_id", F.col("source_id").alias("node")).unionByName(pairs.select("project_id", F.col("target_id").alias("node"))).distinct()
    found: DataFrame | None = None
    while True:
        while True:  # nodes that nothing leads to, or that lead nowhere, are components of their own
            end = {c: left.groupBy("project_id", F.col(c).alias("_node")).agg(F.lit(True).alias(f"_{c}")) for c in _ENDS}
            kept = left
            for c in _ENDS:
                other = _ENDS[1 - _ENDS.index(c)]
                kept = kept.join(end[other].withColumnRenamed("_node", c).hint("merge"), ["project_id", c], "left")
            marked, seen = cut_observed(kept.withColumn("_in", F.coalesce(F.col("_source_id") & F.col("_target_id"), F.lit(False))).select("project_id", *_ENDS, "_in"), gone=F.count_if(~F.col("_in")), n=F.count_if("_in"))
            left = marked.where("_in").drop("_in")
            if not seen["gone"] or not seen["n"]:
                break
        if not seen["n"]:
            break
        start = left.select("project_id", F.col("source_id").alias("node")).distinct().withColumn("colour", F.col("node"))
        colour = _spread_to_end(cut(start), left, "target_id", "colour")
        ends = left
        for c in _ENDS:
            ends = ends.join(colour.select("project_id", F.col("node").alias(c), F.col("colour").alias(f"_{c}")).hint("merge"), ["project_id", c])
        within = cut(ends.where("_source_id = _target_id").select("project_id", *_ENDS))
        reached = _spread_to_end(cut(colour.withColumn("hit", F.col("node") == F.col("colour")).select("project_id", "node", "hit")), within, "source_id", "hit").where("hit")
        part = cut(colour.join(reached.hint("merge"), ["project_id", "node"], "left_semi"))
        named = part.groupBy("project_id", "colour").agg(F.min("node").alias("scc"))
        got = part.join(named.hint("merge"), ["project_id", "colour"]).select("project_id", "node", "scc")
        found = got if found is None else found.unionByName(got)
        left = within
        for c in _ENDS:
            left = left.join(part.select("project_id", F.col("node").alias(c)).hint("merge"), ["project_id", c], "left_anti")
        left = cut(left)
    if found is None:
        return nodes.withColumn("scc", F.col("node"))
    return nodes.join(found.hint("merge"), ["project_id", "node"], "left").select("project_id", "node", F.coalesce("scc", "node").alias("scc"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """project_id, node, scc of the nodes that lie on a cycle."""
    label = cut(scc(edges))
    loops = edges.where("source_id = target_id").select("project_id", F.col("source_id").alias("node")).distinct()
    many = label.groupBy("project_id", "scc").agg(F.count("*").alias("n")).where("n > 1").select("project_id", "scc")
    return label.join(many, ["project_id", "scc"], "left_semi").unionByName(label.join(loops, ["project_id", "node"], "left_semi")).distinct()


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges inside components of more than one node, and self loops, with their component's label."""
    label = scc(edges)
    s = label.select("project_id", F.col("node").alias("source_id"), F.col("scc").alias("scc"))
    t = label.select("project_id", F.col("node").alias("target_id"), F.col("scc").alias("_other"))
    return edges.join(s, ["project_id", "source_id"]).join(t, ["project_id", "target_id"]).where("scc = _other").drop("_other")
