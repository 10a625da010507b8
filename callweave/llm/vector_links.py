"""Embedding near-duplicates by cross-polytope hashing.

1. Vectors with equal components are one node, copies counted. A node's hash in a table is made of k pseudo-random rotations (three
   rounds of random signs and a fast Hadamard transform each): of each rotated vector the largest coordinate by magnitude with its
   sign, the nearest corner of the cross-polytope. k grows with the number of nodes, so that buckets stay small.
2. A node is filed under its own hash in each table, and looks into the next most likely buckets too, by what they lose in the
   rotated coordinates (multiprobe). Tables and probes are chosen by simulated pairs right at the threshold, for the target
   recall with the fewest rows.
3. Rows of buckets carry 64 sign bits of a rotated vector; in a bucket only members whose bits differ from another's in at most
   ``most_bits`` places get their components (a pair at the threshold is lost with a chance of about one in 400,000).
4. In each bucket candidates are then verified by their cosine in double precision. A bucket gives at most one edge for each member, to
   what it is joined to there, never its pairs. Buckets with more than two blocks of members are settled by the angles to
   pivots where these suffice, else in pairs of blocks (see ``linking.compared``).
5. Verified edges make components; within a component all links are counted in the same way, exactly, each pair once.

Vectors that are null, zero or empty, or hold null or non-finite components link with nothing; vectors of different lengths don't
link. Rows with equal vectors are linked to each other; repeated rows are rows each. Null ids are ignored when a component
takes its least id; a component without any id has none, and all its rows are kept. A pair exactly at the threshold is a
link. An empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import join_groups, saved, table
from callweave.llm.linking import BLOCK, compared, components, local_links, mix64

THRESHOLD, RECALL = 0.9, 0.995
#: Nodes of a bucket, on average, from which on one more rotation makes a hash; steps of the largest angle of a link.
OFTEN, STEPS, SEED = 16, 16, 20240607
SIMULATED = 3000
#: Of 64 sign bits a pair at the threshold of 0.9 differs in 9.2 on average (its angle by a half turn), with a deviation of 2.8, any
#: two vectors in 32. ``most_bits`` allows for 4.6 deviations at any threshold.
SIGNS = 64
PROBES = (1, 2, 3, 4, 6)


def width(dim: int) -> int:
    """The power of two that vectors of a length are filled up to."""
    return 1 << max(dim - 1, 1).bit_length()


def signs(dim: int, k: int, at: int) -> np.ndarray:
    """Random signs of the rotation ``at`` of the tables for k: (k, 3, width)."""
    return np.random.default_rng([SEED, dim, k, at]).choice(np.array([-1.0, 1.0]), (k, 3, width(dim)))


def rotated(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Three rounds of signs and a Hadamard transform, which keeps lengths."""
    n, size = x.shape
    for s in sign:
        x, h = x * s, 1
        while h < size:
            y = x.reshape(n, size // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
            h *= 2
        x = x / math.sqrt(size)
    return x


def buckets(x: np.ndarray, sign: np.ndarray, probes: int) -> np.ndarray:
    """(n, probes) of unit vectors: bucket numbers in one table, the own first, then the most likely others."""
    at = loss = None
    for s in sign:
        r = rotated(x, s)
        both = np.concatenate([r, -r], 1)
        m = min(probes, both.shape[1])
        part = np.argpartition(-both, m - 1, 1)[:, :m]
        value = np.take_along_axis(both, part, 1)
        order = np.argsort(-value, 1, kind="stable")
        part, value = np.take_along_axis(part, order, 1), np.take_along_axis(value, order, 1)
        lost = (value[:, :1] - value) ** 2
        if at is None:
            at, loss = part.astype(np.int64), lost
            continue
        at = (at[:, :, None] * both.shape[1] + part[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, 1, kind="stable")[:, :probes]
        at, loss = np.take_along_axis(at, order, 1), np.take_along_axis(loss, order, 1)
    return at


def rotations(dim: int, n: int) -> int:
    """Of a hash, so that buckets hold few of n nodes."""
    k = 1
    while (2 * width(dim)) ** k * OFTEN < n:
        k += 1
    return max(k, 2)


def choose_tables(dim: int, k: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, probes, hit): the fewest rows with which a pair at the threshold is found with probability ``recall`` or more; ``hit``
    is the share of simulated pairs that one table finds."""
    rng = np.random.default_rng([SEED, dim, k])
    a, b = rng.normal(size=(2, SIMULATED, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    sign = signs(dim, k, 0)
    a, b = (buckets(np.pad(x, ((0, 0), (0, width(dim) - dim))), sign, max(PROBES)) for x in (a, b))
    best = None
    for p in PROBES:
        found = (a[:, :p] == b[:, :1]).any(1) | (b[:, :p] == a[:, :1]).any(1)
        hit = min(max(found.mean() - 2 * found.std() / math.sqrt(SIMULATED), 1e-3), 0.999)
        tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if best is None or tables * p < best[0] * best[1]:
            best = (tables, p, float(hit))
    return best


def precision(vectors: DataFrame) -> str:
    """How components are carried: as floats where they are, else as doubles."""
    return "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"


def directions(vectors: DataFrame, kind: str) -> DataFrame:
    """(row, vec_id, node, dim, v) of every row: a number, a hash of the components, how many they are, and the components
    themselves; the last three are null where a vector links with nothing. Save it before use."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            at, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out = []
            for i, j, known in zip(at, at[1:], lists.is_valid().to_pylist()):
                x = values[i:j]
                top = np.abs(x).max(initial=0) if known else 0
                if not (0 < top < np.inf):  # false for NaN, too
                    out.append((None, None, None))
                    continue
                x = x + 0.0  # no negative zeros
                out.append((int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64)), j - i, x.astype(kind).tobytes()))
            node, dim, v = zip(*out, strict=True) if out else ((), (), ())
            rest = batch.drop_columns(["embedding"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(v, pa.binary())], [*rest.schema.names, "node", "dim", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(work, "row long, vec_id long, node long, dim int, v binary")


def units(values: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    if not values:
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(values), kind).astype(np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def most_bits(threshold: float) -> int:
    """How many sign bits a pair at the threshold may differ in."""
    p = math.acos(threshold) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + 4.6 * math.sqrt(SIGNS * p * (1 - p))))


def sketches(x: np.ndarray, dim: int) -> np.ndarray:
    """64 sign bits of each (filled up) unit vector, of as many rotations as it takes."""
    rng = np.random.default_rng([SEED, dim])
    rounds = -(-SIGNS // x.shape[1])
    bits = np.concatenate([rotated(x, s) for s in rng.choice(np.array([-1.0, 1.0]), (rounds, 3, x.shape[1]))], 1)[:, :SIGNS] > 0
    return np.packbits(bits, axis=1).view(np.int64)[:, 0]


def bucket_rows(nodes: DataFrame, plans: dict[int, tuple[int, int, int]], kind: str) -> DataFrame:
    """(key, node, own, bits): of each node its bucket in every table, and those that it looks into, with its sign bits. ``plans``:
    rotations, tables and probes by length of the vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    own = part.filter(pa.array(dims == dim))
                    k, tables, probes = plans[int(dim)]
                    x = np.pad(units(own.column("v").to_pylist(), kind), ((0, 0), (0, width(int(dim)) - int(dim))))
                    found = np.stack([buckets(x, signs(int(dim), k, t), probes) for t in range(tables)], 1)
                    place = (np.arange(tables, dtype=np.uint64) + np.uint64(1) << np.uint64(20)) + np.uint64(dim)
                    key = mix64(mix64(found.astype(np.uint64) + np.uint64(1)) + mix64(place)[None, :, None]).view(np.int64)
                    first = np.zeros(key.shape, bool)
                    first[:, :, 0] = True
                    node = np.repeat(own.column("node").to_numpy(), key[0].size)
                    bits = np.repeat(sketches(x, int(dim)), key[0].size)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node), pa.array(first.ravel()), pa.array(bits)], ["key", "node", "own", "bits"])

    return nodes.select("node", "dim", "v").mapInArrow(work, "key long, node long, own boolean, bits long")


def _pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(x @ y.T >= threshold - 1e-15)


def _links(threshold: float, kind: str):
    def links(found: pa.Table, in_first: np.ndarray | None) -> tuple:
        node, weight, x = found.column("node").to_numpy(), found.column("copies").to_numpy(), units(found.column("v").to_pylist(), kind)
        if in_first is None:
            i, j = _pairs(x, x, threshold)
            i, j = i[i < j], j[i < j]
        else:
            first, second = np.flatnonzero(in_first), np.flatnonzero(~in_first)
            i, j = _pairs(x[first], x[second], threshold)
            i, j = first[i], second[j]
        return local_links(node, weight, i, j)

    return links


def _steps(threshold: float, kind: str):
    def steps(pivot: pa.Table, found: pa.Table) -> np.ndarray:
        """Angles to the pivot, in steps of which ``STEPS`` make the largest angle of a link; told a hundred thousandth too large, more
        than they can err by, so that no pair just over the largest angle is taken for a link."""
        if not found.num_rows:
            return np.zeros(0, np.int32)
        angle = np.arccos(np.clip(units(found.column("v").to_pylist(), kind) @ units(pivot.column("v").to_pylist(), kind)[0], -1, 1))
        return np.floor(angle / math.acos(threshold) * STEPS * (1 + 1e-5)).astype(np.int32)

    return steps


def _in_buckets(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of the rows of small buckets: it gets a table in order of keys with whole buckets, and where each begins, and gives
    record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            whole = pa.concat_tables([left, new]) if left is not None else new
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            yield from buckets_of(whole.slice(0, cut))
            left = whole.slice(cut)
        if left is not None:
            yield from buckets_of(left)

    def buckets_of(found: pa.Table) -> Iterator[pa.RecordBatch]:
        if found.num_rows:
            keys = found.column("key").to_numpy()
            yield from work(found, np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)].tolist())

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def close_rows(rows: DataFrame, most: int) -> DataFrame:
    """(key, node, own, bits) -> (key, node, own) of members of a bucket whose bits differ from another's in at most ``most`` places, one of the
    two being filed there."""

    def work(found: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        own, bits = found.column("own").to_numpy(zero_copy_only=False), found.column("bits").to_numpy().view(np.uint64)
        near = np.zeros(len(own), bool)
        for lo, hi in zip(cuts, cuts[1:]):
            filed = lo + np.flatnonzero(own[lo:hi])
            if hi - lo > 1 and len(filed):
                few = np.bitwise_count(bits[filed][:, None] ^ bits[None, lo:hi]) <= most
                few[np.arange(len(filed)), filed - lo] = False
                near[lo:hi] |= few.any(0)
                near[filed] |= few.any(1)
        yield from found.select(["key", "node", "own"]).filter(pa.array(near)).to_batches()

    return _in_buckets(rows.select("key", "node", "own", "bits"), work, "key long, node long, own boolean")


def verified_edges(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(key, node, own, v) of small buckets -> (a, b): members and what verified links join them to within their bucket."""

    def work(found: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        own, node, v, out = found.column("own").to_numpy(zero_copy_only=False), found.column("node").to_numpy(), found.column("v").to_pylist(), []
        for lo, hi in zip(cuts, cuts[1:]):
            filed = np.flatnonzero(own[lo:hi])
            if hi - lo < 2 or not len(filed):
                continue
            x = units(v[lo:hi], kind)
            i, j = _pairs(x[filed], x, threshold)
            i = filed[i]
            i, j = i[i != j], j[i != j]
            if len(i):
                a, _, b = local_links(node[lo:hi], np.ones(hi - lo), i, j)
                out.append((a[a != b], b[a != b]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

    return _in_buckets(members.select("key", "node", "own", "v"), work, "a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked directly), component_id (least vec_id that can be reached), kept (it is its own)."""
    name = "cw-vectors"
    kind = precision(vectors)
    rows = saved(directions(vectors, kind), name)
    nodes = saved(rows.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("v").alias("v")), name)
    plans = {}
    for dim, n in nodes.groupBy("dim").agg(F.count(F.lit(1))).collect():
        k = rotations(dim, n)
        plans[dim] = (k, *choose_tables(dim, k, threshold, recall)[:2])
    keys = saved(bucket_rows(nodes, plans, kind), name)
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("filed")).filter("n > 1 and filed > 0")
    met = saved(met.select(F.col("key").alias("_key"), "n"), name)
    members = saved(join_groups(keys, met, {"key": "_key"}, "n", keys.count()), name)
    vectors_of = nodes.select("node", "v").hint("merge")
    near = close_rows(members.filter(F.col("n") <= 2 * block), most_bits(threshold)).join(vectors_of, "node")
    small = verified_edges(near, threshold, kind)
    hot = members.filter(F.col("n") > 2 * block).join(vectors_of, "node").select("node", F.col("key").alias("comp"), F.lit(0).alias("klass"), F.lit(1).cast("long").alias("copies"), "v")
    links, steps = _links(threshold, kind), _steps(threshold, kind)
    settled = compared(hot, links, steps, STEPS, name, block).filter("node <> root")
    groups = components(small.union(settled.select(F.col("node").alias("a"), F.col("root").alias("b"))).distinct(), name)

    inside = groups.join(nodes, "node").select("node", "comp", F.lit(0).alias("klass"), "copies", "v")
    counted = compared(inside, links, steps, STEPS, name, block).groupBy("node").agg(F.sum("links").alias("links"))
    least = groups.join(nodes.select("node", "least"), "node").groupBy("comp").agg(F.min("least").alias("of"))
    of_node = groups.join(least, "comp").join(counted, "node", "left").select("node", "of", "links")
    info = nodes.select(F.col("node").alias("_node"), "copies", "least").join(of_node.withColumnRenamed("node", "_node"), "_node", "left")
    info = saved(info.select("_node", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("of", "least").alias("component_id")), name)
    linked = join_groups(rows.filter("node is not null").select("vec_id", "node"), info, {"node": "_node"}, "copies", rows.count())
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_cross_polytope_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op12_cross_polytope_links": """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
 pairs AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
 reached AS (SELECT r AS a, r AS b FROM v UNION SELECT x.a, p.b FROM reached x JOIN pairs p ON x.b = p.a)
 SELECT a.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = a.r) AS n_links, c.component_id, a.vec_id IS NOT DISTINCT FROM c.component_id AS kept
 FROM v a JOIN (SELECT x.a, min(v.vec_id) AS component_id FROM reached x JOIN v ON v.r = x.b GROUP BY x.a) c ON c.a = a.r"""
}
