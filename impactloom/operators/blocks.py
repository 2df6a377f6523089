"""Blocks (two-connected parts) of graphs of any size in a logarithmic number of rounds (Tarjan and Vishkin, 1985).

1. A spanning forest: in each round every component takes its smallest edge to another one, edges being
   ordered by a hash, and components so joined become one.
2. An Euler tour of each tree.  Arcs are numbered in the order of (tail, head), so the arc that follows
   u-v is the one after v-u, or the first of v; arcs learn their distance to the end of the tour by
   following four links a round.  The tour gives parents, and an interval of places for each subtree.
3. How far edges outside the forest lead out of each subtree: least and greatest place over an interval,
   from aggregates over dyadic ranges of places; an interval is at most two ranges of each size.
4. A tree edge belongs with the one above it where an edge leaves the upper end's subtree from below, and
   ends of an edge between unrelated nodes belong together.  Components of that relation are the blocks.

No step needs a node's edges, a component or a level of the tree in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..durable import Scratch
from .components import connected_components
from .ranking import ordered_starts

#: Links that one round follows.
HOPS = 8


def _roots(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, r): where links (c, r) end; an end is linked to itself."""
    k = 0
    while True:
        k += 1
        far = links
        for _ in range(HOPS - 1):
            far = far.join(links.select(F.col("c").alias("via"), F.col("r").alias("next")), F.col("r") == F.col("via")).select("c", F.col("next").alias("r"))
        links = scratch.save(far, f"{name}-{k}", release=False)
        ends = links.where("c = r").select("r")
        if links.join(ends, "r", "left_anti").isEmpty():
            return links


def spanning_forest(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((a, b) of a spanning forest, (node, component)) of edges (a, b) with a < b, each once."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    left = scratch.save(edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct(F.xxhash64("a", "b").alias("order"), "a", "b").alias("e")), "forest-0", release=False)
    forest, maps, k = None, [], 0
    while not left.isEmpty():
        k += 1
        both = left.select(F.col("ca").alias("c"), F.col("cb").alias("r"), "e").union(left.select("cb", "ca", "e"))
        picked = scratch.save(both.groupBy("c").agg(F.min(F.struct("e", "r")).alias("m")).select("c", "m.r", "m.e"), f"picked-{k}", release=False)
        chosen = picked.select("e.a", "e.b").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        # Two components that take the same edge point to each other; the smaller one is the end.
        back = picked.select(F.col("c").alias("r"), F.col("r").alias("c"))
        mutual = picked.select("c", "r").join(back, ["c", "r"]).where("c < r").select(F.col("c").alias("end"))
        links = picked.join(mutual, F.col("c") == F.col("end"), "left").select("c", F.when(F.col("end").isNotNull(), F.col("c")).otherwise(F.col("r")).alias("r"))
        root = _roots(links, scratch, f"roots-{k}")
        maps.append(root)
        moved = left.join(root.select(F.col("c").alias("ca"), F.col("r").alias("ra")), "ca").join(root.select(F.col("c").alias("cb"), F.col("r").alias("rb")), "cb").where("ra <> rb")
        left = scratch.save(moved.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min("e").alias("e")), f"forest-{k}", release=False)
    own = nodes.withColumn("component", F.col("node"))
    for root in maps:
        own = own.join(root, own["component"] == root["c"], "left").select("node", F.coalesce("r", "component").alias("component"))
    return scratch.save(forest, "forest", release=False), scratch.save(own, "own", release=False)


def _distances(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, d): how many arcs follow arc i, from links (i, s) with null at the end."""
    far = links.select("i", "s", F.when(F.col("s").isNull(), 0).otherwise(1).cast("long").alias("d"))
    k = 0
    while True:
        k += 1
        step = scratch.save(far, f"tour-{k}", release=False)
        if step.where("s IS NOT NULL").isEmpty():
            return step.select("i", "d")
        if k > 1:
            scratch.drop(f"tour-{k - 1}")
        far = step
        for _ in range(HOPS - 1):
            ahead = step.select(F.col("i").alias("at"), F.col("s").alias("s2"), F.col("d").alias("d2"))
            far = far.join(ahead, far["s"] == ahead["at"], "left").select("i", F.col("s2").alias("s"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"))


def rooted(forest: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent, tin, tout, component): a root is its component's node and has no parent.

    Places ``tin`` to ``tout`` are those of the node's subtree, and of no other node outside it.
    """
    arcs = forest.select(F.col("a").alias("u"), F.col("b").alias("v")).union(forest.select("b", "a")).withColumn("one", F.lit(1).cast("long"))
    arcs = scratch.save(ordered_starts(arcs, scratch, [F.col("u"), F.col("v")], "one", "i").select("u", "v", "i"), "arcs", release=False)
    ends = arcs.groupBy("u").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    twin = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("i").alias("t"))
    start = own.where("node = component").join(ends, F.col("node") == F.col("u")).select(F.col("first").alias("s"), F.lit(True).alias("over"))
    after = (arcs.join(twin, ["u", "v"]).join(ends.withColumnRenamed("u", "v"), "v")
             .withColumn("s", F.when(F.col("t") + 1 < F.col("first") + F.col("n"), F.col("t") + 1).otherwise(F.col("first"))))
    linked = scratch.save(after.join(start, "s", "left").select("u", "v", "i", "t", F.when(F.col("over").isNull(), F.col("s")).alias("s")), "linked", release=False)
    left = _distances(linked.select("i", "s"), scratch)
    # A tree of m nodes has 2 m places: its arcs, one before them and one after them.
    members = own.groupBy("component").agg((2 * F.count("*")).alias("places"))
    starts = scratch.save(ordered_starts(members, scratch, [F.col("component")], "places", "offset"), "offsets", release=False)
    place = left.join(linked.select("i", "t", "u", "v"), "i").join(left.select(F.col("i").alias("t"), F.col("d").alias("dt")), "t").where("d > dt")
    below = (place.join(own.select(F.col("node").alias("v"), "component"), "v").join(starts, "component")
             .select(F.col("v").alias("node"), F.col("u").alias("parent"), (F.col("offset") + F.col("places") - 2 - F.col("d")).alias("tin"), (F.col("offset") + F.col("places") - 2 - F.col("dt")).alias("tout"), "component"))
    tops = starts.select(F.col("component").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("offset").alias("tin"), (F.col("offset") + F.col("places") - 1).alias("tout"), "component")
    return scratch.save(below.unionByName(tops), "rooted", release=False)


def two_connected(edges: DataFrame, scratch: Scratch, one_task: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tree, (node, block), own): the rooted forest, the block of the edge from each non-root node to its parent where that
    is shared with another edge, and (node, component); ``edges`` (a, b) have a < b and come once."""
    forest, own = spanning_forest(edges, scratch)
    tree = rooted(forest, own, scratch)
    loose = scratch.save(edges.join(forest, ["a", "b"], "left_anti"), "loose", release=False)
    size = int(tree.agg(F.max("tout")).first()[0] or 0).bit_length()
    places = tree.select("node", "tin")
    to = places.select(F.col("node").alias("y"), F.col("tin").alias("ty"))
    both = loose.select(F.col("a").alias("node"), F.col("b").alias("y")).union(loose.select("b", "a"))
    ends = both.join(places, "node").join(to, "y").groupBy("tin").agg(F.min("ty").alias("low"), F.max("ty").alias("high"))
    # Dyadic ranges: range x of size 2^k holds the places p with p >> k = x.
    ranges = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size)))).groupBy("k", F.expr("shiftright(tin, k)").alias("x")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("tin").alias("ptin"), F.col("tout").alias("ptout"))
    inner = tree.where("parent IS NOT NULL").join(up, "parent").where("above IS NOT NULL")
    cut = inner.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size)))).withColumns({"l": F.expr("shiftright(tin + shiftleft(1L, k) - 1, k)"), "r": F.expr("shiftright(tout + 1, k)")}).where("l < r")
    pieces = cut.withColumn("x", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), q -> q is not null)")))
    reach = pieces.join(ranges, ["k", "x"]).groupBy("node", "parent", "ptin", "ptout").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    upwards = reach.where("low < ptin OR high > ptout").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    x, y = (tree.select(F.col("node").alias(n), F.col("tin").alias(f"{n}_in"), F.col("tout").alias(f"{n}_out")) for n in ("a", "b"))
    across = loose.join(x, "a").join(y, "b").where("a_out < b_in OR b_out < a_in").select("a", "b")
    joined = scratch.save(upwards.union(across), "joined", release=False)
    return tree, connected_components(joined, scratch, "blocks", one_task), own
