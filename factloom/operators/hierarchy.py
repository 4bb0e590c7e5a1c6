"""Problem 1: parent-child rows to full hierarchies by heavy-path decomposition.

All steps work on whole DataFrames with O(log n) rounds over 64-bit ids; no tree is ever gathered into one task, so one tree
may hold most of the rows. Keys are text only in the first and last step. A round is one job: what it has to report (nodes
still open, nodes that changed) is observed while its result is written. Steps:

1. Ids. Each key gets the id of its row in a written table. Leaves are told apart: all rounds run over inner nodes only.
2. Cycle separation. Pointer doubling over the parent column finds each inner node's root and depth. When a round resolves no
   further node, the rest leads into cycles.
3. Subtree sizes. With jump(v) the ancestor 2^k above v and part(v) the number of descendants less than 2^k below v,
   part'(v) = part(v) + sum of part(u) over all u with jump(u) = v. This rides on the same rounds as the doubling.
4. Heavy paths. A node's heavy child is the inner child with the largest subtree (ties: the smallest key). Chains of heavy
   children are labelled by their heads; a node's offset in its chain is a difference of depths; a leaf is a chain of its own.
5. Paths. A chain is one row that holds its members in order; its prefix, the keys above it, is the prefix of the chain above
   plus that chain's segment down to the joint, doubled over the chain tree, whose height is at most log2 n. Exploding a chain
   gives its members' paths, so no node is joined with its chain. A row is never longer than a path that has to come out.
6. Intervals. Numbering heavy child first, then the other children by key, gives each node an interval [enter, leave] within
   its root, and each chain one as well; v is a descendant of u exactly if u.enter < v.enter <= u.leave. Sums over siblings
   are running sums over one global sort, so a parent with most of the nodes does not fill one task.
7. Cycles. The doubled map's image shrinks to the cycles' members; the smallest member, again found by doubling, names a
   cycle. Nodes carry the name only; members are rows of a table of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import cut, cut_observed

#: Doubling rounds after which the operator gives up; 2^40 steps exceed any table.
MAX_ROUNDS = 40
#: Numbers of a root that share a key when intervals are joined: a descendant is compared with at most so many others in vain.
BLOCK = 64


def _linked(links: DataFrame, key: str, parent: str) -> DataFrame:
    """id, key, up (the parent's id, null for a root), inner (whether the node has children), one row per node."""
    rows = links.select(F.col(key).cast("string").alias("key"), F.col(parent).cast("string").alias("parent")).where(F.col("key").isNotNull())
    # the ids are those of a written table, so they stay what they are if a task runs again
    rows = cut(rows.groupBy("key").agg(F.min("parent").alias("parent")).withColumn("id", F.monotonically_increasing_id()))
    up = rows.select(F.col("key").alias("parent"), F.col("id").alias("up"))
    named = rows.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.lit(True).alias("inner"))
    # nulls are kept out of the join: they would all meet in one task
    below = rows.where(F.col("parent").isNotNull()).join(up.hint("merge"), "parent", "left").select("id", "key", "up")
    top = rows.where(F.col("parent").isNull()).select("id", "key", F.lit(None).cast("long").alias("up"))
    return cut(below.unionByName(top).join(named.hint("merge"), "key", "left").select("id", "key", "up", F.coalesce("inner", F.lit(False)).alias("inner")))


def _ahead(rows: DataFrame, state: DataFrame, jump: str, columns: list[str]) -> DataFrame:
    """rows with columns of the node that `jump` names, as ahead_COLUMN; null where jump is null.

    State grows with the data, so it is never broadcast. Rows that jump nowhere get keys of their own that no node has, lest all
    nulls meet in one task. The state is shuffled once for all hops of a round.
    """
    there = state.select(F.col("id").alias("_there"), *(F.col(c).alias(f"ahead_{c}") for c in columns))
    return rows.withColumn("_there", F.coalesce(jump, -1 - F.col("id"))).join(there.hint("merge"), "_there", "left").drop("_there")


def _double(linked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Over inner nodes: settled(id, root, depth, size), and rest(id, jump, low) of those that lead into cycles, if there are any.

    A round doubles twice: three hops of the present length. low is the smallest id among a node and those it has jumped over.
    """
    leaves = linked.where("not inner and up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("leaves"))
    # jump: the node reached so far, null once the root is passed; top: the root once known; gone: the steps to jump or top
    state = cut(
        linked.where("inner").join(leaves.hint("merge"), "id", "left").select(
            "id", F.col("up").alias("jump"), F.when(F.col("up").isNull(), F.col("id")).alias("top"),
            F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("gone"), (F.coalesce("leaves", F.lit(0)) + 1).cast("long").alias("part"), F.col("id").alias("low"),
            F.col("up").isNotNull().alias("open"),
        )
    )
    for _ in range(MAX_ROUNDS):
        moved = state.where("open").withColumn("first_jump", F.col("jump"))
        for hop in ("first", "second", "third"):
            moved = _ahead(moved, state, "jump", ["jump", "top", "gone", "low"]).select(
                "id", "part", *(f"{h}_jump" for h in ("first", "second", "third") if h <= hop or h == "first"),
                F.col("ahead_jump").alias("jump"), F.coalesce("top", "ahead_top").alias("top"), (F.col("gone") + F.coalesce("ahead_gone", F.lit(0))).alias("gone"),
                F.least("low", "ahead_low").alias("low"), *([F.col("ahead_jump").alias({"first": "second_jump", "second": "third_jump"}[hop])] if hop != "third" else []),
            )
        moved = cut(moved)
        # sums over the nodes that jump to a node: pre-aggregated before the shuffle, so a popular ancestor costs one row a task
        targets = F.array_compact(F.array("first_jump", "second_jump", "third_jump"))
        below = moved.select(F.explode(targets).alias("id"), "part").groupBy("id").agg(F.sum("part").alias("more"))
        kept = state.where("not open").select("id", "jump", "top", "gone", "part", "low", F.lit(False).alias("was"))
        both = moved.select("id", "jump", "top", "gone", "part", "low", F.lit(True).alias("was")).unionByName(kept)
        state, seen = cut_observed(
            both.join(below.hint("merge"), "id", "left").select("id", "jump", "top", "gone", (F.col("part") + F.coalesce("more", F.lit(0))).alias("part"), "low", F.col("jump").isNotNull().alias("open"), "was"),
            still=F.count_if("open"), settled=F.count_if(F.col("was") & ~F.col("open")),
        )
        state = state.drop("was")
        # a node too deep for this round has an ancestor that this round settles; without one the rest has no root
        if not seen["still"] or not seen["settled"]:
            break
    done = state.where("not open").select("id", F.col("top").alias("root"), F.col("gone").alias("depth"), F.col("part").alias("size"))
    return done, state.where("open").select("id", "jump", "low") if seen["still"] else None


def _tree(linked: DataFrame, settled: DataFrame) -> DataFrame:
    """id, key, up, inner, root, depth, size of all nodes of trees; leaves take root and depth from their parents."""
    one = F.lit(1).cast("long")
    owned = linked.where("inner or up is not null").withColumn("owner", F.when(F.col("inner"), F.col("id")).otherwise(F.col("up")))
    there = settled.select(F.col("id").alias("owner"), "root", F.col("depth").alias("deep"), F.col("size").alias("full"))
    below = owned.join(there.hint("merge"), "owner").select(
        "id", "key", "up", "inner", "root", F.when(F.col("inner"), F.col("deep")).otherwise(F.col("deep") + 1).alias("depth"), F.when(F.col("inner"), F.col("full")).otherwise(one).alias("size")
    )
    alone = linked.where("not inner and up is null").select("id", "key", "up", "inner", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), one.alias("size"))
    return cut(below.unionByName(alone))


def _heads(tree: DataFrame) -> DataFrame:
    """id, key, up, depth, head (the first node of its chain) and heavy (whether it continues its parent's chain) of the inner nodes."""
    inner = tree.where("inner")
    heavy = (
        inner.where(F.col("up").isNotNull()).groupBy("up").agg(F.min(F.struct((-F.col("size")).alias("s"), "key", "id")).alias("m"))
        .select(F.col("m.id").alias("id"), F.lit(True).alias("heavy"))
    )
    state, seen = cut_observed(
        inner.join(heavy.hint("merge"), "id", "left").select(
            "id", "key", "up", "depth", F.when(F.col("heavy"), F.col("up")).alias("hop"), F.when(F.col("heavy").isNull(), F.col("id")).alias("head"), F.coalesce("heavy", F.lit(False)).alias("heavy"),
            F.coalesce("heavy", F.lit(False)).alias("open"),
        ),
        still=F.count_if("open"),
    )
    for _ in range(MAX_ROUNDS):  # along heavy edges only: one node a target, so no skew
        if not seen["still"]:
            break
        moved = state.where("open")
        for _hop in range(3):
            moved = _ahead(moved, state, "hop", ["hop", "head"]).select("id", "key", "up", "depth", F.col("ahead_hop").alias("hop"), F.coalesce("head", "ahead_head").alias("head"), "heavy")
        kept = state.where("not open").withColumn("open", F.lit(False))
        state, seen = cut_observed(kept.unionByName(moved.withColumn("open", F.col("head").isNull())), still=F.count_if("open"))
    return state.drop("hop", "open")


def _summed(state: DataFrame, add) -> DataFrame:
    """state: head, above (the head of the chain it hangs from, null for none), value. The values from the topmost chain down, added up."""
    state, seen = cut_observed(state, still=F.count_if(F.col("above").isNotNull()))
    for _ in range(MAX_ROUNDS):
        if not seen["still"]:
            break
        ahead = state.select(F.col("head").alias("above"), F.col("above").alias("above2"), F.col("value").alias("value2"))
        moved = state.where(F.col("above").isNotNull()).join(ahead.hint("merge"), "above").select("head", F.col("above2").alias("above"), add(F.col("value2"), F.col("value")).alias("value"))
        state, seen = cut_observed(state.where(F.col("above").isNull()).unionByName(moved), still=F.count_if(F.col("above").isNotNull()))
    return state.select("head", "value")


def _cycles(linked: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of inner nodes that lead into cycles: on(id, cycle_key), and members(cycle_key, member_key) of the cycles.

    What the nodes jump to are the cycles' members once the jumps are longer than all tails, and then low is the smallest id of a
    member's cycle once the jumps are longer than all cycles. Both hold exactly if no node is lowered any more and each member has
    one member before it; until then the doubling goes on.
    """
    for _ in range(MAX_ROUNDS):
        on = cut(_ahead(rest, rest, "jump", ["jump", "low"]))
        ring = on.groupBy(F.col("jump").alias("id")).agg(F.max("ahead_low").alias("low"), F.lit(1).alias("on"))
        ring = cut(linked.where("inner").join(ring.hint("merge"), "id").select("id", "key", "up", "low"))
        before = ring.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n"))
        _, seen = cut_observed(before, twice=F.count_if(F.col("n") > 1))
        lowered = on.where(F.col("ahead_low") < F.col("low")).join(ring.select("id").hint("merge"), "id", "left_semi").isEmpty()
        if not seen["twice"] and lowered:
            break
        rest = on.select("id", F.col("ahead_jump").alias("jump"), F.least("low", "ahead_low").alias("low"))
    names = ring.groupBy("low").agg(F.min("key").alias("cycle_key"))
    members = ring.join(names.hint("merge"), "low").select("cycle_key", F.col("key").alias("member_key"))
    return on.select("id", F.col("ahead_low").alias("low")).join(names.hint("merge"), "low").select("id", "cycle_key"), members


@dataclass
class Hierarchy:
    """What hierarchy() found; each table is planned when it is first asked for."""

    linked: DataFrame
    tree: DataFrame
    rest: DataFrame | None

    @cached_property
    def _headed(self) -> DataFrame:
        return _heads(self.tree)

    @cached_property
    def _ringed(self) -> tuple[DataFrame, DataFrame]:
        return _cycles(self.linked, self.rest)

    @cached_property
    def _chains(self) -> DataFrame:
        """head, joint (the node above the chain), depth (of the head), keys: one row per chain of inner nodes."""
        rows = self._headed.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("depth", "id", "key", "up"))).alias("m"))
        return cut(rows.select("head", F.col("m")[0]["up"].alias("joint"), F.col("m")[0]["depth"].alias("depth"), F.col("m.id").alias("ids"), F.col("m.key").alias("keys")))

    def _hung(self, columns: list[str]) -> DataFrame:
        """Chains that hang from another: head, above, at (the joint's offset in the chain above)."""
        lower = self._chains.where(F.col("joint").isNotNull()).select("head", "joint", F.col("depth").alias("deep"))
        where = self._headed.select(F.col("id").alias("joint"), F.col("head").alias("above"))
        upper = self._chains.select(F.col("head").alias("above"), "depth", *columns)
        return lower.join(where.hint("merge"), "joint").join(upper.hint("merge"), "above").withColumn("at", F.col("deep") - 1 - F.col("depth"))

    def paths(self) -> DataFrame:
        """key, path (array of keys from the root) of all nodes of trees."""
        none = F.array().cast("array<string>")
        tops = self._chains.where(F.col("joint").isNull()).select("head", F.lit(None).cast("long").alias("above"), none.alias("value"))
        hung = self._hung(["keys"]).select("head", "above", F.slice("keys", F.lit(1), (F.col("at") + 1).cast("int")).alias("value"))
        prefixes = _summed(tops.unionByName(hung), lambda a, b: F.concat(a, b))
        inner = self._chains.join(prefixes.hint("merge"), "head").select(
            F.posexplode("keys").alias("pos", "key"), "ids", "keys", F.col("value").alias("prefix")
        ).select(F.col("ids")[F.col("pos")].alias("id"), "key", F.concat("prefix", F.slice("keys", F.lit(1), F.col("pos") + 1)).alias("path"))
        leaf = self.tree.where("not inner and up is not null").select("key", F.col("up").alias("id")).join(inner.select("id", "path").hint("merge"), "id").select("key", F.concat("path", F.array("key")).alias("path"))
        alone = self.tree.where("not inner and up is null").select("key", F.array("key").alias("path"))
        return inner.select("key", "path").unionByName(leaf).unionByName(alone)

    def intervals(self) -> DataFrame:
        """key, root (the root's id), node_depth, subtree_size, enter, leave of all nodes of trees."""
        tree, heads = self.tree, self._headed
        heavy = heads.where("heavy").select("id")
        light = tree.where(F.col("up").isNotNull()).join(heavy, "id", "left_anti").select("id", "up", "key", "size")
        # a running sum over one global order: within a range partition, and what the parent's earlier partitions hold
        ranged = cut(light.repartitionByRange("up", "key").withColumn("pid", F.spark_partition_id()))
        before = Window.partitionBy("pid", "up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        carry = Window.partitionBy("up").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        nothing = F.lit(0).cast("long")
        base = ranged.groupBy("up", "pid").agg(F.sum("size").alias("total")).select("up", "pid", F.coalesce(F.sum("total").over(carry), nothing).alias("base"))
        run = ranged.withColumn("run", F.coalesce(F.sum("size").over(before), nothing))
        first = tree.join(heavy, "id", "left_semi").select("up", F.col("size").alias("heavy_size"))
        off = cut(run.join(base, ["up", "pid"]).join(first, "up", "left").select("id", "up", (F.col("run") + F.col("base") + F.coalesce("heavy_size", nothing) + 1).alias("off")))
        tops = self._chains.where(F.col("joint").isNull()).select("head", F.lit(None).cast("long").alias("above"), nothing.alias("value"))
        hung = self._hung([]).join(off.select(F.col("id").alias("head"), "off"), "head").select("head", "above", (F.col("at") + F.col("off")).alias("value"))
        enters = _summed(tops.unionByName(hung), lambda a, b: a + b)
        spots = self._chains.join(enters, "head").select(F.posexplode("ids").alias("pos", "id"), (F.col("value") + F.col("pos")).alias("enter")).select("id", "enter")
        inner = tree.where("inner").join(spots, "id")
        leaf = tree.where("not inner").join(off, ["id", "up"]).join(spots.select(F.col("id").alias("up"), F.col("enter").alias("above")), "up").withColumn("enter", F.col("above") + F.col("off")).drop("above", "off")
        alone = tree.where("not inner and up is null").withColumn("enter", nothing)
        return inner.unionByName(leaf).unionByName(alone).select("key", "root", F.col("depth").alias("node_depth"), F.col("size").alias("subtree_size"), "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))

    def sizes(self) -> DataFrame:
        """key, root_key, node_depth, subtree_size of all nodes of trees."""
        roots = self.tree.where(F.col("up").isNull()).select(F.col("id").alias("root"), F.col("key").alias("root_key"))
        return self.tree.join(roots, "root").select("key", "root_key", F.col("depth").alias("node_depth"), F.col("size").alias("subtree_size"))

    def cyclic(self) -> DataFrame:
        """key, cycle_key (the smallest key on the cycle) of all nodes on or below a cycle."""
        if self.rest is None:
            return self.linked.select("key", F.lit(None).cast("string").alias("cycle_key")).where(F.lit(False))
        owned = self.linked.where("inner or up is not null").select("key", F.when(F.col("inner"), F.col("id")).otherwise(F.col("up")).alias("id"))
        return owned.join(self._ringed[0].hint("merge"), "id").select("key", "cycle_key")

    def members(self) -> DataFrame:
        """cycle_key, member_key: one row per node on a cycle."""
        if self.rest is None:
            return self.linked.select(F.lit(None).cast("string").alias("cycle_key"), F.col("key").alias("member_key")).where(F.lit(False))
        return self._ringed[1]

    def descendants(self) -> DataFrame:
        """ancestor_key, descendant_key, distance of all proper pairs, from the intervals.

        An interval is cut at multiples of BLOCK numbers; a piece meets the nodes of its block only. So the pieces and pairs looked
        at are at most the pairs that come out plus some BLOCK for each node, and a hot root's pieces lie in as many groups as its
        tree has blocks.
        """
        at = cut(self.intervals())
        block = lambda c: F.floor(F.col(c) / F.lit(BLOCK)).cast("long")
        low = at.select("root", block("enter").alias("block"), F.col("key").alias("descendant_key"), F.col("enter").alias("spot"), F.col("node_depth").alias("deep"))
        up = at.where("leave > enter").select("root", F.explode(F.sequence(block("enter"), block("leave"))).alias("block"), F.col("key").alias("ancestor_key"), "enter", "leave", "node_depth")
        return up.join(low, ["root", "block"]).where("spot > enter and spot <= leave").select("ancestor_key", "descendant_key", (F.col("deep") - F.col("node_depth")).alias("distance"))


def hierarchy(links: DataFrame, key: str = "key", parent: str = "parent") -> Hierarchy:
    """Paths, depths, roots, subtree sizes, descendants and cycles of all nodes of a parent-child table.

    links: one row per node; repeated keys keep the smallest non-null parent; rows with a null key are no nodes. A null parent
    or one that is no key makes a root. Other columns are ignored, whatever their names. An empty table gives empty results.
    A node on or below a cycle is in cyclic() only, any other in paths(), intervals() and sizes() only.
    """
    linked = _linked(links, key, parent)
    settled, rest = _double(linked)
    return Hierarchy(linked, _tree(linked, settled), rest)


def node_paths(forest: Hierarchy, step: str = " > ", ring: str = "|") -> DataFrame:
    """key, root_key, node_depth, node_path: one row per node, the path as text.

    A node on or below a cycle has root_key '', node_depth -1 and the cycle's sorted members as its path.
    """
    trees = forest.paths().select("key", F.col("path")[0].alias("root_key"), (F.size("path") - 1).cast("long").alias("node_depth"), F.array_join("path", step).alias("node_path"))
    if forest.rest is None:
        return trees
    rings = forest.members().groupBy("cycle_key").agg(F.array_join(F.sort_array(F.collect_list("member_key")), ring).alias("node_path"))
    return trees.unionByName(forest.cyclic().join(rings, "cycle_key").select("key", F.lit("").alias("root_key"), F.lit(-1).cast("long").alias("node_depth"), "node_path"))
