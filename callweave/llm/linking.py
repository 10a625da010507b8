"""From rows that share keys to exact links between them, without emitting all pairs of a group.

1. ``key_rows`` joins the nodes of a batch by their keys before the shuffle, so that a very common key reaches the
   shuffle once per batch and not once per node, and a group's nodes have one edge each and not one for each key.
2. ``star_edges`` links every node of a key to the key's least node.
3. ``components`` joins edges to groups of nodes by contracting them to least neighbours.
4. ``compared`` finds the links inside groups: by the distances from pivots where these settle them, else by comparisons
   in pairs of blocks of bounded size. Nodes have a class, and only equal and neighbouring classes can link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from callweave.llm.common import saved

BLOCK = 128
#: Pivots of a large component, and the most steps that a distance is told in.
PIVOTS, MOST_STEPS = 16, 4095
KEY_ROWS = "key long, node long"
GROUP = ["comp", "ka", "ba", "ia", "kb", "bb", "ib"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_rows(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of a batch -> rows for ``star_edges``. Nodes that keys join within the batch are led by the least of
    them: keys come with their leader, each once, and any other node with its leader under a key of their own."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    key, node = key[new], node[new]
    first = np.r_[True, key[1:] != key[:-1]][: len(key)]
    group = np.cumsum(first) - 1
    shared = np.bincount(group)[group] > 1 if len(key) else first
    names, who = np.unique(node[shared], return_inverse=True)
    lead = np.arange(len(names))
    if len(names):
        by_key = np.flatnonzero(np.r_[True, np.diff(group[shared]) != 0])
        sizes = np.diff(np.r_[by_key, len(who)])
        by_node = np.argsort(who, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(who[by_node]) != 0])
        while True:
            least = np.repeat(np.minimum.reduceat(lead[who], by_key), sizes)
            now = np.minimum(lead, np.minimum.reduceat(least[by_node], at))
            now = now[now]
            if (now == lead).all():
                break
            lead = now
    leader = node.copy()
    leader[shared] = names[lead][who]
    a, b = names[lead != np.arange(len(names))], names[lead][lead != np.arange(len(names))]
    own = mix64(mix64(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)
    return np.concatenate([key[first], own, own]), np.concatenate([leader[first], a, b])


def star_edges(rows: DataFrame) -> DataFrame:
    """(key, node) -> distinct (a, b): each node with the least node of a key of its own. One shuffle by key; a key has
    at most one row per batch that met it."""
    least = F.min("node").over(Window.partitionBy("key"))
    return rows.select(F.col("node").alias("a"), least.alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "cw-components") -> DataFrame:
    """(a, b) -> (node, comp) for all nodes with an edge; comp is the least node that can be reached.

    In each round every node goes to its least neighbour, if that is less, and on to that one's; the edges are then taken
    between the nodes arrived at. Nodes that stay are less than all their neighbours, so a round leaves half of them at
    most, and chains end in few rounds. The rounds' steps are composed at the end.
    """
    edges = saved(edges.select("a", "b"), name)
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to")), name)
        on = least.select(F.col("node").alias("to"), F.col("to").alias("comp"))
        step = saved(least.join(on, "to").select("node", "comp"), name)
        steps.append(step)
        of_a, of_b = step.select(F.col("node").alias("a"), F.col("comp").alias("ca")), step.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        met = edges.join(of_a, "a").join(of_b, "b").filter("ca <> cb")
        edges = saved(met.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), name)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("upper")), "comp", "left").select("node", F.coalesce("upper", "comp").alias("comp"))
    return saved(out, name)


def compared(nodes: DataFrame, links, steps, bound: int, name: str, block: int = BLOCK) -> DataFrame:
    """``nodes`` (node, comp, klass, copies and payload) -> (node, links, root): links to other nodes of its component, copies
    counted, and a node that it is joined to; a node has a row for each task that met links of it.

    A component of at most two blocks is one task. In a larger one all nodes are held against pivots, one for every eight blocks and
    ``PIVOTS`` at most, first the node with most copies, the others by a hash. ``steps`` gives distances in whole steps, rounded
    down, where distances of less than ``bound`` steps are links. A node belongs to its nearest pivot if that is so near, else to
    the first. By the triangle inequality nodes whose distances by way of their pivots add up to less are linked, and
    nodes whose distances are too far apart are not, without a comparison; so large groups of near copies of a text cost one pass.
    What neither rule settles is dealt by hash to blocks of about ``block`` nodes, and pairs of blocks of equal and
    neighbouring classes are compared.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = saved(nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), name)
    many = F.least(F.greatest(F.floor(F.col("n") / (8 * block)), F.lit(1)), F.lit(PIVOTS)).cast("int")
    big = sizes.filter(F.col("n") > 2 * block).select("comp", F.ceil(F.col("n") / block).cast("int").alias("nb"), many.alias("np"))
    one = [F.lit(0).alias(c) for c in GROUP[1:]]
    small = nodes.join(big.select("comp"), "comp", "left_anti").select("comp", *one, *[c for c in nodes.columns if c != "comp"], F.lit(0).alias("bin"), F.lit(0).alias("block"))
    if big.isEmpty():
        return saved(_in_groups(small, parts, links), name)

    columns = nodes.columns
    inside = nodes.join(big, "comp")
    rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("copies"), F.xxhash64("node"), "node"))
    pivots = saved(inside.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).filter(F.col("rank") <= F.col("np")).withColumn("q", F.col("rank") - 1).drop("rank"), name)

    def distances(found: pa.Table, own: pa.Table) -> np.ndarray:
        """In steps, from each pivot among the rows found (in order of q) to each row of ``own``."""
        at = pc.sort_indices(found, [("q", "ascending")])
        pivots = found.take(at)
        return np.stack([np.minimum(steps(pivots.slice(k, 1), own), MOST_STEPS) for k in range(pivots.num_rows)])

    def between(found: pa.Table) -> pa.Table:
        far, q = distances(found, found), np.sort(found.column("q").to_numpy())
        n = len(q)
        return pa.table({"comp": pa.array(np.repeat(found.column("comp").to_numpy()[:1], n * n)), "q": pa.array(np.repeat(q, n), pa.int32()), "r": pa.array(np.tile(found.column("q").to_numpy(), n), pa.int32()), "apart": pa.array(far.ravel(), pa.int32())})

    def placed(found: pa.Table) -> pa.Table:
        mark = found.column("mark").to_numpy(zero_copy_only=False)
        own = found.filter(pa.array(~mark)).select(columns)
        far = distances(found.filter(pa.array(mark)), own)
        q = far.argmin(0)
        q[far.min(0, initial=MOST_STEPS) >= bound] = 0
        return own.append_column("bin", pa.array(q * (MOST_STEPS + 1) + far[q, np.arange(far.shape[1])], pa.int32()))

    apart = saved(pivots.groupBy("comp").applyInArrow(between, "comp long, q int, r int, apart int"), name)
    dealt_in = inside.withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumns({"q": F.lit(None).cast("int"), "mark": F.lit(False)})
    held = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("mark", F.lit(True))
    both = dealt_in.unionByName(held).repartition(parts, "comp", "i")
    binned = saved(both.groupBy("comp", "i").applyInArrow(placed, StructType([*nodes.schema.fields, StructField("bin", IntegerType())])), name)

    # A distance of bin b is at least b steps and less than b + 1; by way of two pivots three distances add up.
    own = saved(binned.groupBy("comp", "klass", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("w")), name)
    nb = F.ceil(F.col("n") / block).cast("int")
    other = own.select("comp", F.col("klass").alias("k"), F.col("bin").alias("b"), F.col("w").alias("w2"), nb.alias("nb2"))
    met = own.withColumn("nb", nb).join(other, "comp")
    met = met.withColumns({"q": _pivot("bin"), "r": _pivot("b"), "_x": _steps_of("bin"), "_y": _steps_of("b")}).join(apart, ["comp", "q", "r"])
    same = F.col("q") == F.col("r")
    most = F.col("_x") + F.col("_y") + 2 + F.when(same, 0).otherwise(F.col("apart") + 1)
    least = F.when(same, F.abs(F.col("_x") - F.col("_y")) - 1).otherwise(F.col("apart") - F.col("_x") - F.col("_y") - 2)
    sure = most <= bound
    known = met.filter(sure).groupBy("comp", "klass", "bin").agg(F.sum("w2").alias("links"))
    beyond = F.when(_steps_of("bin") * 2 + 2 <= bound, F.col("copies")).otherwise(0)
    # Whoever is linked for sure is so near to its pivot that it is linked to it too.
    to = pivots.select("comp", "q", F.col("node").alias("pivot"))
    near = binned.join(known, ["comp", "klass", "bin"]).withColumn("q", _pivot("bin")).join(to, ["comp", "q"])
    near = near.select("node", (F.col("links") - beyond).cast("long").alias("links"), F.col("pivot").alias("root"))
    joined = apart.filter((F.col("q") < F.col("r")) & (F.col("apart") + 3 <= bound)).join(to, ["comp", "q"])
    joined = joined.join(to.select("comp", F.col("q").alias("r"), F.col("pivot").alias("root")), ["comp", "r"]).select(F.col("pivot").alias("node"), F.lit(0).cast("long").alias("links"), "root")

    open_ = met.filter(~sure & (least <= bound) & (F.abs(F.col("klass") - F.col("k")) <= 1))
    others = open_.groupBy("comp", "klass", "bin", "nb").agg(F.collect_list(F.struct("k", "b", "nb2")).alias("others"))
    rest = binned.join(others, ["comp", "klass", "bin"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    mine = F.struct(F.col("klass").alias("k"), F.col("bin").alias("b"), F.col("block").alias("i"))
    theirs = F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["nb2"] - 1), lambda i: F.struct(o["k"].alias("k"), o["b"].alias("b"), i.cast("int").alias("i"))))
    rest = rest.withColumn("_o", F.explode(F.flatten(theirs))).withColumn("_x", F.least(mine, "_o")).withColumn("_y", F.greatest(mine, "_o"))
    pair = [F.col(f"{v}.{f}").alias(g) for (v, f), g in zip([(v, f) for v in ("_x", "_y") for f in "kbi"], GROUP[1:], strict=True)]
    dealt = small.unionByName(rest.select("comp", *pair, *[c for c in nodes.columns if c != "comp"], "bin", "block"))
    return saved(_in_groups(dealt, parts, links).unionByName(near).unionByName(joined), name)


def _pivot(column: str) -> Column:
    return F.floor(F.col(column) / (MOST_STEPS + 1)).cast("int")


def _steps_of(column: str) -> Column:
    return F.col(column) % (MOST_STEPS + 1)


def _in_groups(dealt: DataFrame, parts: int, links) -> DataFrame:
    """``links`` of each group: it gets the group's rows, and which of them are the first block's (None: all are of one block)."""

    def work(found: pa.Table) -> pa.Table:
        first, second = ([found.column(c)[0].as_py() for c in GROUP[at : at + 3]] for at in (1, 4))
        in_first = None
        if first != second:
            in_first = np.logical_and.reduce([found.column(c).to_numpy() == v for c, v in zip(("klass", "bin", "block"), first, strict=True)])
        return pa.table(dict(zip(("node", "links", "root"), links(found, in_first), strict=True)))

    return dealt.repartition(parts, *GROUP).groupBy(*GROUP).applyInArrow(work, "node long, links long, root long")


def local_links(node: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links i - j of one group -> for each node with a link: node, sum of the weights that it links to, and least node of its component."""
    n = len(node)
    links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    root = node.copy()
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        if (before == root).all():
            break
    some = np.zeros(n, bool)
    some[i] = some[j] = True
    return node[some], links[some].astype(np.int64), root[some]
