"""N-gram Jaccard join of documents by MinHash banding.

Each text becomes the set of its word 5-grams (a text of fewer words: of the one n-gram of all its words). Texts with
equal sets are one node. Band and row counts are chosen for a target recall at the threshold; nodes are shuffled on band
hashes and linked to groups, and within a group all pairs of n-gram sets are compared in full, in blocks of bounded size
(see ``linking``), so that a link is a pair with Jaccard similarity at or over the threshold.

Words are runs of characters other than ASCII white space, case as is. A null, empty or blank text has no n-grams: it
links to nothing and is alone in its class. Repeated rows count as copies of each other; rows
of one id with different texts are texts of their own, however many. Null ids are ignored when a
class takes its least id. Texts of any length are compared on their whole sets; a pair exactly at the threshold is a link.
Other columns, whatever their names, aren't looked at. An empty table gives an empty result. Nodes carry 64-bit hashes of their sets; at a billion texts the chance that any two different
sets share one is about 0.03.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from callweave.llm.common import join_groups, saved, table
from callweave.llm.linking import BLOCK, KEY_ROWS, compared, components, key_rows, local_links, mix64, star_edges

NGRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 160
STEPS = 16
CHUNK = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which a pair at the threshold shares a
    band with probability ``recall`` or more within ``max_hashes`` hashes."""
    best = None
    for rows in range(1, 65):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach that recall within that many hashes")
    return best


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def set_id(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band."""
    a = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512]
        np.minimum(least, ((part[None, :] ^ a[:, None]) * (a | np.uint64(1))[:, None]).min(1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _texts(batch: pa.RecordBatch, size: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, part.column("text").to_pylist()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, d, node, n, keys) of every row: a number, the row itself as the struct ``d``, hash and size of the n-gram set and
    its band hashes; node and keys are null if it is empty. Numbers are those of the run that writes the table: save it before use."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [ngram_set(t) for t in part.column("d").field("text").to_pylist()]
                more = [
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([band_hashes(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "node", "n", "keys"])

    d = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), d)
    return numbered.mapInArrow(work, StructType([*numbered.schema.fields, *StructType.fromDDL("node long, n long, keys array<long>").fields]))


def band_rows(signed: DataFrame) -> DataFrame:
    """Key rows of all nodes: band hash and node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            node = np.repeat(batch.column("node").to_numpy(), np.diff(keys.offsets.to_numpy()))
            out = key_rows(keys.flatten().to_numpy(), node)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "node"])

    return signed.filter("node is not null").select("node", "keys").mapInArrow(work, KEY_ROWS)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct sets, as a matrix. Works through the shared members in chunks."""
    values = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.r_[True, values[1:] != values[:-1]]
    member = np.cumsum(new) - 1
    often = np.bincount(member)[member] > 1
    member, row = member[often], row[often]
    member = np.unique(member, return_inverse=True)[1]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(member.max(initial=-1)) + 1, CHUNK):
        lo, hi = np.searchsorted(member, [at, at + CHUNK])
        x = np.zeros((len(a) + len(b), CHUNK), np.float32)
        x[row[lo:hi], member[lo:hi] - at] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def _sets(found: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in found.column("grams").to_pylist()]


def _links(threshold: float):
    def links(found: pa.Table, in_first: np.ndarray | None) -> tuple:
        node, weight, sets = found.column("node").to_numpy(), found.column("copies").to_numpy(), _sets(found)
        n = np.array([len(s) for s in sets])
        first = second = np.arange(len(node))
        if in_first is not None:
            first, second = np.flatnonzero(in_first), np.flatnonzero(~in_first)
        i = j = np.zeros(0, np.int64)
        if len(first) and len(second):
            both = shared_counts([sets[x] for x in first], [sets[x] for x in second])
            i, j = np.nonzero(both >= threshold * (n[first][:, None] + n[second][None, :] - both) - 1e-6)
            i, j = first[i], second[j]
            if in_first is None:
                i, j = i[i < j], j[i < j]
        return local_links(node, weight, i, j)

    return links


def _steps(threshold: float):
    def steps(pivot: pa.Table, found: pa.Table) -> np.ndarray:
        """Jaccard distances from the pivot, in steps of which ``STEPS`` make the largest distance of a link."""
        (own,), sets = _sets(pivot), _sets(found)
        both = np.array([len(np.intersect1d(own, s, assume_unique=True)) for s in sets])
        all_ = len(own) + np.array([len(s) for s in sets]) - both
        return np.floor((all_ - both) / all_ / (1 - threshold) * STEPS + 1e-9).astype(np.int32)

    return steps


def gram_sets(texts: DataFrame) -> DataFrame:
    """``texts`` with the n-gram set ``grams`` for the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in _texts(batch):
                rest = part.drop_columns(["text"])
                grams = pa.array([ngram_set(t).tobytes() for t in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns, grams], [*rest.schema.names, "grams"])

    fields = [f for f in texts.schema.fields if f.name != "text"]
    return texts.mapInArrow(work, StructType([*fields, StructField("grams", BinaryType())]))


def _classes(whole: DataFrame, threshold: float, block: int) -> DataFrame:
    """One row per node: node, copies, n_links (copies included), of: (id is null, id, row) of the first row of its class. A node's
    text is fetched from its first row by that row's number, which no other row has, however often ids and texts repeat."""
    name = "cw-near"
    signed = whole.drop("d")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.first("n").alias("n"))
    nodes = saved(nodes, name)
    groups = components(star_edges(band_rows(signed)), name)

    # Half-open classes of set sizes, each a quarter larger than the last: sets two classes apart can't reach the threshold.
    step = math.log(1 / threshold)
    klass = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    members = saved(groups.join(nodes, "node").select("node", "comp", klass.alias("klass"), "copies", F.col("first.row").alias("row")), name)
    # Members grow with the table, so their texts are fetched by a shuffle at every size.
    texts = whole.select("row", "d.text").join(members.hint("merge"), "row").select("node", "comp", "klass", "copies", "text")
    found = compared(saved(gram_sets(texts), name), _links(threshold), _steps(threshold), STEPS, name, block)

    linked = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), name)
    of_class = linked.join(nodes.select("node", "first"), "node").groupBy("comp").agg(F.min("first").alias("of"))
    of_node = linked.join(of_class, "comp").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").select("node", "of", "links")
    info = nodes.join(of_node, "node", "left")
    return saved(info.select("node", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("of", "first").alias("of")), name)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id (least doc_id of its class) and n_links (rows that it links to, copies included)."""
    whole = saved(signatures(docs.select("doc_id", "text"), *choose_bands(threshold, recall)), "cw-near", "zstd")
    info = _classes(whole, threshold, block)
    rows = whole.select("doc_id", "node")
    met = join_groups(rows.filter("node is not null"), info.withColumnRenamed("node", "of_node"), {"node": "of_node"}, "copies", rows.count())
    out = met.select("doc_id", "node", F.coalesce(F.col("of.doc_id"), "doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"))
    return out.unionByName(rows.filter("node is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with one row left of each class: that of the least doc_id, rows without an id last; of equal ids
    the first row by its number in the written table. Rows without n-grams (null, empty or blank texts) all stay. Columns
    of any name are carried along; the table must have doc_id and text."""
    whole = saved(signatures(docs, *choose_bands(threshold, recall)), "cw-near", "zstd")
    first = _classes(whole, threshold, block).select(F.col("of.row").alias("row")).distinct()
    chosen = whole.filter("node is not null").join(first, "row", "left_semi").select("d.*")
    return chosen.unionByName(whole.filter("node is null").select("d.*"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
