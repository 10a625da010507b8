"""Vector code compression: product codes by Lloyd rounds whose members stay with their owners.

A vector is cut into four equal parts, and each part is coded by the nearest of 256 entries of the codebook of its
position. The parts live in blocks owned by (position, entry, salt); salts divide an entry's members by a hash of their row, so
that an entry with a third of all rows is many owners. A round has three steps, all in one job:

1. each owner holds its resident members against the codebook (256 entries a position, carried to every task);
2. members that stay aren't moved; those with another nearest entry are packed by owner and migrate in the round's one shuffle;
3. owners add up the members that they have now, and the new entries are made of these sums: a row for each entry and no more.

Only the first round moves every part, to its first owner. Each round's blocks are checkpointed to the shared folder, so a lost
executor costs one round at most. Arithmetic is exact: integers, multiplied as floating-point numbers only where all sums
are small enough to be exact in them.

Vectors that are null or hold null or non-finite components are dropped, and so are empty ones and any of another length
than most have (of equally frequent lengths the longer counts). Equal vectors and repeated rows are coded each. Null ids come
after all others in the choice of first entries, equal ids in order of their components; null labels are one label. With fewer
than 256 vectors the codebooks have that many entries. An empty table gives an empty result. Other columns aren't looked at.
A length that four doesn't divide, and components of 2**18 or more, which the integers here don't hold, are errors.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callweave.llm.common import join_groups, new_folder, saved, table
from callweave.llm.linking import mix64

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members of an owner, on average, if all vectors had one entry.
OWNED = 65_536
LARGEST = 1 << 28
CHUNK = 8192


def whole_components(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v, n) of the vectors without null or non-finite components: v holds floor(1024 * x) as 32-bit integers, n
    is their number. Row numbers are those of the run that writes the table: save it before use."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(values)
            bad = np.r_[0, np.cumsum(~good)]
            kept = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[at[1:]] == bad[at[:-1]]) & (at[1:] > at[:-1]))
            whole = np.floor(np.where(good, values, 0) * SCALE)
            out = [whole[at[i] : at[i + 1]] for i in kept]
            if any(np.abs(x).max() >= LARGEST for x in out):
                raise ValueError(f"a component is {LARGEST // SCALE} or more")
            part = batch.take(pa.array(kept)).drop_columns(["embedding"])
            v = pa.array([x.astype(np.int32).tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, v, pa.array([len(x) for x in out], pa.int32())], [*part.schema.names, "v", "n"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter("embedding is not null")
    fields = [f for f in rows.schema.fields if f.name != "embedding"]
    return rows.mapInArrow(work, StructType([*fields, *StructType.fromDDL("v binary, n int").fields]))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equally near ones, and its squared distance, in exact integers."""
    entry, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    cc = (book * book).sum(1)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK].astype(np.int64)
        xx = (part * part).sum(1)
        top = 4 * max(int(xx.max()), int(cc.max()))  # no sum on the way is larger
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        d = xx.astype(kind)[:, None] - 2 * (part.astype(kind) @ book.T.astype(kind)) + cc.astype(kind)
        entry[at : at + CHUNK] = e = d.argmin(1)
        far[at : at + CHUNK] = d[np.arange(len(part)), e]
    return entry, far


def _by_owner(ids: np.ndarray, x: np.ndarray, entry: np.ndarray, salt: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(entry, salt, ids, members) for each owner among the rows."""
    order = np.lexsort((salt, entry))
    ids, x, entry, salt = ids[order], x[order], entry[order], salt[order]
    cuts = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (salt[1:] != salt[:-1])][: len(ids)])
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(ids)][: len(cuts)], strict=True):
        yield int(entry[lo]), int(salt[lo]), ids[lo:hi], x[lo:hi]


class Owners:
    """Blocks of members by owner, (position, entry, salt): the resident state between rounds."""

    def __init__(self, parts: int, salts: int, width: int):
        self.parts, self.salts, self.width = parts, salts, width
        # One object for all rounds: Spark takes partitionings for equal by the identity of their function.
        self.at = lambda owner: (owner[0] * ENTRIES + owner[1]) * salts + owner[2]

    def salt(self, ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.view(np.uint64)) % np.uint64(self.salts)).astype(np.int64)

    def _merged(self, blocks: Iterator) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """An owner's residents and arrivals as one block."""
        found = defaultdict(list)
        for owner, block in blocks:
            found[owner].append(block)
        for owner in list(found):
            ids, x = zip(*found.pop(owner), strict=True)
            yield owner, np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(x), np.int32).reshape(-1, self.width)

    def placed(self, vectors: DataFrame, books: np.ndarray) -> RDD:
        """Every part at its first owner."""
        width, own = self.width, self

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(-1, PARTS, width)
                ids = batch.column("row").to_numpy().tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([ids] * PARTS, pa.binary()), pa.array([x[:, p].tobytes() for p in range(PARTS)], pa.binary())], ["position", "ids", "x"])

        def place(rows: Iterator) -> Iterator:
            for position, ids, x in rows:
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x, np.int32).reshape(-1, width)
                for e, s, i, m in _by_owner(ids, x, nearest(x, books[position])[0], own.salt(ids)):
                    yield (position, e, s), (i.tobytes(), m.tobytes())

        return vectors.select("row", "v").mapInArrow(cut, "position int, ids binary, x binary").rdd.mapPartitions(place).partitionBy(self.parts, self.at)

    def sums(self, residents: RDD) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
        """(position, entry) -> members and their sum, for entries with any."""
        merged = self._merged

        def add(blocks: Iterator) -> Iterator:
            for (position, entry, _), ids, x in merged(blocks):
                yield (position, entry), (len(ids), x.sum(0, np.int64))

        return residents.mapPartitions(add).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), numPartitions=min(self.parts, 64)).collectAsMap()

    def reassigned(self, residents: RDD, books: np.ndarray) -> tuple[RDD, RDD]:
        """The residents after another assignment, and what to let go of when they have been used. Members that stay are
        joined with those that arrive without a shuffle, as both are by owner."""
        merged, salt = self._merged, self.salt

        def assign(blocks: Iterator) -> Iterator:
            for owner, ids, x in merged(blocks):
                entry = nearest(x, books[owner[0]])[0]
                stays = entry == owner[1]
                if stays.any():
                    yield owner, (ids[stays].tobytes(), x[stays].tobytes()), False
                ids, x, entry = ids[~stays], x[~stays], entry[~stays]
                for e, s, i, m in _by_owner(ids, x, entry, salt(ids)):
                    yield (owner[0], e, s), (i.tobytes(), m.tobytes()), True

        both = residents.mapPartitions(assign, preservesPartitioning=True).persist()
        both.checkpoint()
        stay = both.mapPartitions(lambda rows: ((o, b) for o, b, moved in rows if not moved), preservesPartitioning=True)
        moved = both.mapPartitions(lambda rows: ((o, b) for o, b, moved in rows if moved))
        return stay.union(moved.partitionBy(self.parts, self.at)), both

    def coded(self, residents: RDD, books: np.ndarray) -> DataFrame:
        """(row, position, entry, error) by a last assignment."""
        merged = self._merged

        def code(blocks: Iterator) -> Iterator:
            for owner, ids, x in merged(blocks):
                entry, far = nearest(x, books[owner[0]])
                yield owner[0], bytearray(ids.tobytes()), bytearray(entry.tobytes()), bytearray(far.tobytes())

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                long = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("ids", "entry", "error")]
                position = np.repeat(batch.column("position").to_numpy(), [len(x) // 8 for x in batch.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (long[0], position, long[1], long[2])], ["row", "position", "entry", "error"])

        spark = SparkSession.active()
        blocks = spark.createDataFrame(residents.mapPartitions(code), "position int, ids binary, entry binary, error binary")
        return blocks.mapInArrow(rows, "row long, position int, entry long, error long")


def first_vectors(whole: DataFrame, n: int) -> list:
    """The n rows of least ids, of equal ids those of least components, null ids last, with the components as ``x``. Only rows up
    to the n-th id are put in order."""
    ids = [r[0] for r in whole.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(n).collect()]
    some = whole if ids[-1] is None else whole.filter(F.col("vec_id") <= ids[-1])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v, np.int32) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.list_(pa.int32()))], ["vec_id", "x"])

    return some.select("vec_id", "v").mapInArrow(numbers, "vec_id long, x array<int>").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n).collect()


def compress(vectors: DataFrame, rounds: int = ROUNDS, owned: int = OWNED) -> tuple[DataFrame, np.ndarray | None]:
    """(row, vec_id, label, code, error) of every whole vector, and the codebooks as an array (part, entry, component)."""
    spark, name = vectors.sparkSession, "cw-codes"
    whole = saved(whole_components(vectors), name)
    lengths = whole.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("n")).limit(1).collect()
    if not lengths:
        none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
        return whole.select("row", "vec_id", "label", *none), None
    dim, count = lengths[0]
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    whole = whole.filter(F.col("n") == dim)
    books = np.stack([np.array(r.x) for r in first_vectors(whole, ENTRIES)]).astype(np.int64).reshape(-1, PARTS, dim // PARTS).transpose(1, 0, 2).copy()

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(new_folder(spark, name))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Owners(parts, -(-count // owned), dim // PARTS)
    residents, last = own.placed(whole, books), None
    for k in range(rounds):
        used = None
        if k:
            residents, used = own.reassigned(residents, books)
        for (position, entry), (n, total) in own.sums(residents).items():
            books[position, entry] = total // n
        if last is not None:
            last.unpersist()
        last = used
    codes = own.coded(residents, books).groupBy("row")
    each = [F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex("entry"), 2, "0")))).alias(f"c{p}") for p in range(PARTS)]
    codes = codes.agg(*each, F.sum("error").alias("error")).select("row", F.concat(*[f"c{p}" for p in range(PARTS)]).alias("code"), "error")
    out = saved(whole.select("row", "vec_id", "label").join(codes, "row"), name)
    if last is not None:
        last.unpersist()
    return out, books


def op11_member_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() if books is not None else None
    by_label = saved(coded.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.sum("error").alias("label_error")), "cw-codes")
    out = join_groups(coded, by_label, {"label": "_label"}, "_n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds, written out, over vectors of one length."""
    nearest_of = "SELECT p, rn, min(CAST(x2 - 2 * list_dot_product(x, c) + c2 AS BIGINT) * 256 + e) AS m FROM parts JOIN b{k} USING (p) GROUP BY p, rn"
    ctes = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rn, len(v) // 4 AS w FROM kept)",
        "parts AS MATERIALIZED (SELECT p, rn, w, x, list_dot_product(x, x) AS x2 FROM (SELECT p, rn, w, v[p * w + 1 : p * w + w] AS x FROM numbered, range(4) t(p)))",
        "b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c, x2 AS c2 FROM parts WHERE rn <= 256)",
    ]
    for k in range(ROUNDS):
        ctes += [
            f"a{k} AS MATERIALIZED ({nearest_of.format(k=k)})",
            f"s{k} AS (SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{k} JOIN parts USING (p, rn), range(1, w + 1) t(i) GROUP BY ALL)",
            f"n{k} AS (SELECT p, e, list(y ORDER BY i) AS y FROM s{k} GROUP BY ALL)",
            f"b{k + 1} AS MATERIALIZED (SELECT p, e, c, list_dot_product(c, c) AS c2 FROM (SELECT p, e, coalesce(y, c) AS c FROM b{k} LEFT JOIN n{k} USING (p, e)))",
        ]
    ctes += [
        f"a{ROUNDS} AS MATERIALIZED ({nearest_of.format(k=ROUNDS)})",
        f"coded AS (SELECT rn, string_agg(lpad(lower(hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn)",
        f"digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: CAST(x AS BIGINT)), 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})",
        "labelled AS (SELECT vec_id, label, code, error FROM coded JOIN numbered USING (rn))",
    ]
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM labelled, digest"


ORACLE = {"op11_member_resident_lloyd": _oracle()}
