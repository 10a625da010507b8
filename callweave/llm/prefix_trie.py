"""Conversation prefix trie by truncation peeling.

Every distinct beginning of a conversation is a node. Nodes are found from the greatest depth down: at each depth the
conversations that end there are merged with the nodes that survive from the depth below, each node's last turn is stripped,
and the stripped nodes are regrouped by what is left of them; counts, leaves and savings are added up on the way, so that one
descent gives the nodes and all that is told of them. A turn is known by a 128-bit digest, a prefix by the digest of its turns.

1. ``rebuilt_chains``: a row per conversation, its turns as digests and lengths (24 bytes a turn; texts don't travel on).
2. ``ended_at``: conversations with the same whole sequence become one row; their ids are hashed in a stream of sorted chunks.
3. Deep turns are peeled inside tasks, of conversations that share their first ``g`` turns: g is the least depth at which
   no such group holds more than a bounded number of turns, so a common beginning is divided and no task gets more.
4. The last g depths, where groups may be of any size, are a grouping each, with sums before the shuffle.

Turns of equal number are taken in order of their digests. Null turns come first; null roles and texts are empty ones.
A conversation is one row of digests, so it may have some fifty million turns. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. Long texts cost a hash once. An
empty table gives an empty result, without a root. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import join_groups, saved, table

KEY = 16
PREFIXES, FAMILY = 6, 100
#: Turns of a group that is peeled in one task, and the least of that bound on small tables; ids of a chunk that is hashed.
MOST_TURNS, LEAST_TURNS, IDS = 200_000, 500, 8192
DEPTHS = (0, 1, 2, 3, 4, 6, 8, 12, 16)
NODE = "key binary, chain binary, lens binary, depth int, conv long, parent_conv long, n long, children long, leaves long, saved long, ends string"
_NAMES = [f.split()[0] for f in NODE.split(", ")]


def rebuilt_chains(conversations: DataFrame) -> DataFrame:
    """(conv, depth, key, chain, lens) of every rebuilt conversation: the first h turns of the conversation of its hundred, then its own
    after its first h, where h is a hash of its id. ``chain`` has the digest of each prefix, ``lens`` each turn's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.struct(F.col("turn").alias("turn"), digest.alias("d"), F.length(text).alias("n")).alias("t"))
    own = turns.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("own"))
    base = own.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.slice("own", 1, PREFIXES - 1).alias("first"))
    h = (F.crc32(F.col("conv").cast("string")) % PREFIXES).cast("int")
    both = own.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", h).join(base, "base", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("own", 1, 0)), rest)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("turns")
            at, each = lists.offsets.to_pylist(), lists.values
            digests, lens = each.field("d").to_pylist(), each.field("n").to_numpy(zero_copy_only=False).astype(">i4")
            chains = []
            for i, j in zip(at, at[1:]):
                key, out = b"", []
                for d in digests[i:j]:
                    key = hashlib.md5(key + d, usedforsecurity=False).digest()
                    out.append(key)
                chains.append(b"".join(out))
            columns = [batch.column("conv"), pa.array([len(c) // KEY for c in chains], pa.int32()), pa.array([c[-KEY:] for c in chains], pa.binary()), pa.array(chains, pa.binary()), pa.array([lens[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "depth", "key", "chain", "lens"])

    return both.select("conv", whole.alias("turns")).mapInArrow(chained, "conv long, depth int, key binary, chain binary, lens binary")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def ended_at(chains: DataFrame, ids: int = IDS) -> DataFrame:
    """(key, depth, chain, lens, conv, n, ends) per distinct whole conversation: its least id, how many there are, and the hash of all
    their ids. Ids are sorted over all tasks by (key, id) and packed in chunks; a key's chunks are then hashed in a stream."""
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, run = [], None, []

        def closed() -> None:
            if run:
                out.append((key, run[0], len(run), ",".join(map(str, run))))
                run.clear()

        for k, conv in _runs(batches, ["key", "conv"]):
            if k != key or len(run) >= ids:
                closed()
                key = k
            run.append(conv)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "first", "n", "ids"])
                out.clear()
        closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "first", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, least, n, h = [], None, 0, 0, None
        for k, first, m, text in _runs(batches, ["key", "first", "n", "ids"]):
            if k != key:
                if h is not None:
                    out.append((key, least, n, h.hexdigest()))
                key, least, n, h = k, first, 0, hashlib.sha256()
            h.update(("," if n else "").encode() + text.encode())
            n += m
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "conv", "n", "ends"])
                out.clear()
        if h is not None:
            out.append((key, least, n, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "conv", "n", "ends"])

    packed = chains.select("key", "conv").repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pack, "key binary, first long, n long, ids string")
    merged = packed.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, conv long, n long, ends string")
    return chains.join(merged.drop("key"), "conv")


def peel(rows: list[tuple], g: int) -> Iterator[tuple]:
    """``NODE`` rows of all nodes deeper than g of (chain, lens, conv, n, ends): those at depth g + 1 keep what is left of their chain and
    have no parent yet."""
    ended = defaultdict(list)
    for chain, lens, *rest in rows:
        ended[len(chain) // KEY].append((chain, np.frombuffer(lens, ">i4"), *rest))
    live: dict[bytes, list] = {}
    stripped: list[tuple[bytes, tuple]] = []
    for d in range(max(ended, default=0), g, -1):
        for chain, lens, conv, n, ends in ended[d]:
            node = live.setdefault(chain[KEY * (d - 1) : KEY * d], [conv, 0, 0, 0, 0, None, chain, lens])
            node[0], node[1], node[5] = min(node[0], conv), node[1] + n, ends
        for parent, (before, after) in stripped:
            yield *before, live[parent][0], *after
        above: dict[bytes, list] = {}
        stripped = []
        for key, (conv, n, children, leaves, saved_, ends, chain, lens) in live.items():
            leaves, saved_ = leaves or 1, saved_ + (n - 1) * int(lens[d - 1])
            after = (n, children, leaves, saved_, ends)
            if d == g + 1:
                yield key, chain[: KEY * d], lens[:d].tobytes(), d, conv, None, *after
                continue
            parent = chain[KEY * (d - 2) : KEY * (d - 1)]
            up = above.setdefault(parent, [conv, 0, 0, 0, 0, None, chain, lens])
            up[0], up[1], up[2], up[3], up[4] = min(up[0], conv), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved_
            stripped.append((parent, ((key, None, None, d, conv), after)))
        live = above


def _start(column: str, d: Column | int) -> Column:
    return F.substring(column, F.lit(KEY) * (F.lit(d) - 1) + 1, F.lit(KEY)) if d else F.unhex(F.lit(""))


def division(ended: DataFrame, most: int) -> int:
    """The least depth (of a growing list) at which conversations that share that many turns have at most ``most`` turns below it
    together; a conversation that shares them with no other doesn't count. One pass over the chains for each list."""
    depths, deepest = DEPTHS, ended.agg(F.max("depth")).first()[0]
    while depths[0] < deepest:
        at = ended.select("depth", "chain", F.explode(F.array(*[F.lit(d) for d in depths])).alias("d")).filter("depth > d")
        start = F.expr(f"substring(chain, {KEY} * (d - 1) + 1, {KEY})")
        groups = at.groupBy("d", F.when(F.col("d") > 0, start).alias("start")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("depth") - F.col("d")).alias("turns"))
        largest = {r.d: r.turns for r in groups.filter("k > 1").groupBy("d").agg(F.max("turns").alias("turns")).collect()}
        fit = [d for d in depths if largest.get(d, 0) <= most]
        if fit:
            return min(fit[0], deepest)
        depths = tuple(d * 16 for d in DEPTHS[1:]) if depths is DEPTHS else tuple(d * 16 for d in depths)
    return deepest


def trie(conversations: DataFrame, most_turns: int = MOST_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """One row per node: conv_id (its least member), depth, parent_conv_id (the parent's), n_convs, n_children, n_leaves and saved_tokens of
    its subtree, ends_sha256 of the ids of the conversations that end at it."""
    name = "cw-trie"
    ended = saved(ended_at(saved(rebuilt_chains(conversations), name)), name)
    none = hashlib.sha256(b"").hexdigest()
    out = [F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256")]
    turns = ended.agg(F.sum("depth")).first()[0]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if turns is None:
        return ended.select(*[F.lit(None).cast("long").alias(c) for c in ("depth", "parent_conv", "children", "leaves", "saved")], "conv", "n", "ends").select(*out)
    g = division(ended, max(least_turns, min(most_turns, turns // (8 * parts))))

    def peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> Iterator[pa.RecordBatch]:
            found = list(peel(rows, g))
            for at in range(0, len(found), 16384):
                columns = zip(*found[at : at + 16384], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], _NAMES)

        types = [pa.binary()] * 3 + [pa.int32()] + [pa.int64()] * 6 + [pa.string()]
        rows, size, group = [], 0, None
        for start, *row in _runs(batches, ["start", "chain", "lens", "conv", "n", "ends"]):
            if start != group and size >= LEAST_TURNS * 32:
                yield from done(rows)
                rows, size = [], 0
            group = start
            rows.append(tuple(row))
            size += len(row[0]) // KEY
        if rows:
            yield from done(rows)

    deep = ended.filter(F.col("depth") > g).select(_start("chain", g).alias("start"), "chain", "lens", "conv", "n", "ends")
    deep = saved(deep.repartition(parts, "start").sortWithinPartitions("start").mapInArrow(peeled, NODE), name)

    shallow = [deep.filter(F.col("depth") == g + 1)]
    for d in range(g, -1, -1):
        less = lambda c, k: F.substring(c, F.lit(1), F.lit(k * d))
        survived = shallow[-1].select(_start("chain", d).alias("key"), less("chain", KEY).alias("chain"), less("lens", 4).alias("lens"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends"))
        zero = F.lit(0).cast("long")
        here = ended.filter(F.col("depth") == d).select("key", "chain", "lens", "conv", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
        met = survived.union(here).groupBy("key").agg(F.first("chain").alias("chain"), F.first("lens").alias("lens"), F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"))
        length = F.conv(F.hex(F.substring("lens", -4, 4)), 16, 10).cast("long") if d else F.lit(0)
        met = met.withColumns({"saved": F.col("saved") + (F.col("n") - 1) * length, "leaves": F.greatest("leaves", F.lit(1)), "depth": F.lit(d), "parent_conv": F.lit(None).cast("long")})
        shallow.append(saved(met.select(*_NAMES), name))

    top = shallow[0]
    for level in shallow[1:]:
        top = top.unionByName(level)
    below = top.filter("depth > 0").withColumn("_parent", F.expr(f"substring(chain, {KEY} * (depth - 2) + 1, if(depth > 1, {KEY}, 0))")).drop("parent_conv")
    parents = top.select(F.col("key").alias("_key"), F.col("conv").alias("parent_conv"), F.col("children").alias("_n")).filter("_n > 0")
    found = join_groups(below, parents, {"_parent": "_key"}, "_n", below.count())
    inside = deep.filter(F.col("depth") > g + 1)
    return found.select(*out).unionByName(inside.select(*out)).unionByName(top.filter("depth = 0").select(*out))


def op13_truncation_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


# The polynomial of CRC-32, and one step of it for each bit of each byte.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"

ORACLE = {
    "op13_truncation_peeling": f"""WITH t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
 ids AS MATERIALIZED (SELECT c, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
 rebuilt AS (SELECT ids.c, i, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND i <= h UNION ALL SELECT c, i, r, x FROM ids JOIN t USING (c) WHERE i > h),
 turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, length(x) AS n, sha256(length(r) || ':' || r || x) AS s FROM rebuilt),
 members AS MATERIALIZED (SELECT c, 0 AS d, '' AS k, 0 AS n FROM ids UNION ALL SELECT c, d, sha256(string_agg(s, '') OVER (PARTITION BY c ORDER BY d)), n FROM turns),
 nodes AS MATERIALIZED (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS m, any_value(n) AS n FROM members GROUP BY k),
 ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM (SELECT c, arg_max(k, d) AS k FROM members GROUP BY c) GROUP BY k),
 above AS MATERIALIZED (SELECT m.k, any_value(p.k) AS up FROM members m JOIN members p ON m.c = p.c AND p.d = m.d - 1 GROUP BY m.k),
 children AS (SELECT up AS k, count(*) AS n FROM above GROUP BY up),
 subtree AS (SELECT DISTINCT p.k AS top, m.k FROM members m JOIN members p ON m.c = p.c AND p.d <= m.d),
 sums AS (SELECT top AS k, count(*) FILTER (x.n IS NULL) AS leaves, sum((nodes.m - 1) * nodes.n) AS saved FROM subtree JOIN nodes USING (k) LEFT JOIN children x USING (k) GROUP BY top)
 SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, a.m::BIGINT AS n_convs, coalesce(x.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends.s, sha256('')) AS ends_sha256
 FROM nodes a LEFT JOIN above USING (k) LEFT JOIN nodes p ON p.k = above.up LEFT JOIN children x ON x.k = a.k JOIN sums ON sums.k = a.k LEFT JOIN ends ON ends.k = a.k"""
}
