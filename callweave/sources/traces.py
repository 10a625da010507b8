"""Readers of traces, call trees, exporter files and address tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACES = "block_number bigint, block_timestamp timestamp, transaction_hash string, trace_address string, trace_type string, call_type string, from_address string, to_address string, status int"
FRAMES = "transaction_hash string, trace_address string, depth int, from_address string, to_address string, type string"
#: Column names of the two exporters' files.
EXPORTERS = {
    "a": {"transaction_hash": "tx_hash", "trace_address": "trace_addr", "action_from": "from", "action_to": "to", "result_address": "result_address"},
    "b": {"transaction_hash": "tx_hash", "trace_address": "trace_addr", "from_address": "from", "to_address": "to"},
}


#: Blocks of one folder of written traces, and parts of a folder that are files of their own.
BUCKET, FILES = 100_000, 16


def lowered(traces: DataFrame) -> DataFrame:
    """Traces with their addresses in lower case, as all operators expect them."""
    return traces.withColumns({c: F.lower(c) for c in ("from_address", "to_address")})


def read_traces(spark: SparkSession, path: str, years: Sequence[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Traces as ``write_traces`` lays them out: folders by year and block bucket, addresses in lower case, so that conditions on
    years and blocks choose folders and those on any column reach the files. Blocks ``first`` .. ``last``, both included."""
    df = spark.read.schema(f"{TRACES}, year int, bucket long").parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin([int(y) for y in years]))
    if first is not None:
        df = df.filter((F.col("bucket") >= first // BUCKET) & (F.col("block_number") >= first))
    if last is not None:
        df = df.filter((F.col("bucket") <= last // BUCKET) & (F.col("block_number") <= last))
    return df


def stored_buckets(spark: SparkSession, path: str) -> list[int]:
    """Buckets that stored traces have, in order: from the names of folders, no column is read."""
    return sorted(r.bucket for r in spark.read.schema(f"{TRACES}, year int, bucket long").parquet(path).select("bucket").distinct().collect())


def latest_block(spark: SparkSession, path: str) -> int | None:
    """The latest block of stored traces: only the last bucket's block numbers are read."""
    buckets = stored_buckets(spark, path)
    return spark.read.schema(f"{TRACES}, year int, bucket long").parquet(path).filter(F.col("bucket") == buckets[-1]).agg(F.max("block_number")).first()[0] if buckets else None


def count_stored(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(traces): rows of blocks start .. end - 1. Whole buckets are counted from the files' footers, without a column; block numbers
    are read only in the buckets that the range cuts."""
    rows = spark.read.schema(f"{TRACES}, year int, bucket long").parquet(path)
    first, last = -(-start // BUCKET), end // BUCKET  # whole buckets: first .. last - 1
    inside = rows.filter((F.col("bucket") >= first) & (F.col("bucket") < last)).select("bucket")
    cut = rows.filter((F.col("bucket") >= start // BUCKET) & (F.col("bucket") <= end // BUCKET) & ((F.col("bucket") < first) | (F.col("bucket") >= last)))
    cut = cut.filter((F.col("block_number") >= start) & (F.col("block_number") < end))
    counts = [df.agg(F.count(F.lit(1)).alias("traces")) for df in (inside, cut)]
    return counts[0].union(counts[1]).agg(F.sum("traces").alias("traces"))


def write_traces(traces: DataFrame, path: str, row_group: int = 32 << 20, mode: str = "errorifexists") -> None:
    """Parquet by year and bucket of blocks, addresses in lower case.

    A file is a sixteenth of a bucket's blocks, so block ranges choose files by their footers. Within a file rows are
    clustered by caller and callee in row groups of ``row_group`` bytes, so that a condition on a caller skips row groups by
    their least and greatest values; callers and callees also have Bloom filters of a 32nd of a row group, by which most of
    the row groups that don't hold an address are skipped, wherever it would sort.
    """
    t = lowered(traces).withColumns({"year": F.year("block_timestamp"), "bucket": F.floor(F.col("block_number") / BUCKET).cast("long")})
    part = F.floor(F.col("block_number") / max(BUCKET // FILES, 1)).alias("part")
    t = t.withColumn("_part", part).repartition("year", "bucket", "_part").sortWithinPartitions("year", "bucket", "_part", "from_address", "to_address", "block_number").drop("_part")
    writer = t.write.mode(mode).partitionBy("year", "bucket").option("parquet.block.size", row_group).option("parquet.bloom.filter.max.bytes", max(row_group // 32, 1024))
    for c in ("from_address", "to_address"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def _frames(tree: dict) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    """(trace_address, depth, from, to, type) of a call tree, parents first, children in order; no recursion."""
    left = [(tree, "", 0)]
    while left:
        node, place, depth = left.pop()
        yield place, depth, node.get("from"), node.get("to"), node.get("type")
        calls = node.get("calls") or []
        left += [(calls[i], f"{place},{i}" if place else str(i), depth + 1) for i in range(len(calls) - 1, -1, -1)]


#: Levels beyond which a document is no call tree: calls nest 1,024 deep at most, and a place takes a number for each level.
MOST_LEVELS = 10_000
_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:"]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)')
_FIELDS = ("from", "to", "type")


def _streamed(doc: str) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    """``_frames`` of a document of any depth, read token by token with a stack of the open frames and nothing else in memory. A frame
    comes when it is closed, as its fields may stand behind its calls."""
    at = 0

    def token() -> str:
        nonlocal at
        found = _TOKEN.match(doc, at)
        if not found:
            raise json.JSONDecodeError("no token", doc, at)
        at = found.end()
        return found[1]

    def string() -> str:
        nonlocal at
        value, at = scanstring(doc, at, True)
        return value

    def value(first: str) -> str | None:
        """A string, or the text of a number or word; None for null and for whatever is nested, which is passed over."""
        if first == '"':
            return string()
        if first not in "{[":
            return None if first == "null" else first
        closing = ["}" if first == "{" else "]"]
        while closing:
            t = token()
            if t == '"':
                string()
            elif t in "{[":
                closing.append("}" if t == "{" else "]")
            elif t in "}]" and t != closing.pop():
                raise json.JSONDecodeError("brackets don't match", doc, at)
        return None

    def expect(wanted: str, got: str) -> None:
        if got not in wanted:
            raise json.JSONDecodeError(f"{got} where {wanted} should be", doc, at)

    expect("{", token())
    fields, places, calls = [dict.fromkeys(_FIELDS)], [], [0]  # of the open frames, their places, how many calls they had
    while fields:
        t = token()  # in an object, or behind the calls of one
        if t == "}":
            yield ",".join(map(str, places)), len(places), *(fields[-1][k] for k in _FIELDS)
            fields.pop()
            calls.pop()
            if not fields:
                break
            places.pop()
            t = token()
            expect(",]", t)
            if t == ",":
                t = token()
                expect("{", t)
                places.append(calls[-1])
                calls[-1] += 1
                fields.append(dict.fromkeys(_FIELDS))
                calls.append(0)
            continue
        if t == ",":
            t = token()
        expect('"', t)
        key = string()
        expect(":", token())
        t = token()
        if key == "calls" and t == "[":
            t = token()
            if t == "{":
                if len(fields) > MOST_LEVELS:
                    raise ValueError(f"more than {MOST_LEVELS} levels")
                places.append(calls[-1])
                calls[-1] += 1
                fields.append(dict.fromkeys(_FIELDS))
                calls.append(0)
            else:
                expect("]", t)
        elif key in fields[-1]:
            fields[-1][key] = value(t)
        else:
            value(t)
    if doc[at:].strip():
        raise json.JSONDecodeError("more than one document", doc, at)


def _frames_of(tx: str, doc: str) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    try:
        try:
            tree = json.loads(doc)
        except RecursionError:  # too deep for the quick way
            yield from _streamed(doc)
        else:
            yield from _frames(tree)
    except (ValueError, TypeError, AttributeError) as e:
        raise ValueError(f"the call tree of transaction {tx} can't be read: {type(e).__name__}") from None


def flatten_call_trees(trees: DataFrame, rows: int = 4096) -> DataFrame:
    """(transaction_hash, trace_json) -> one row per frame, addresses in lower case. Null documents give no rows. Documents are
    taken one at a time, and frames leave in batches of ``rows``. One that isn't JSON, or is nested far deeper than calls can
    be, is an error that names its transaction."""
    names = [f.split()[0] for f in FRAMES.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = ((tx, *frame) for batch in batches for tx, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if doc for frame in _frames_of(tx, doc))
        while found := list(islice(frames, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return lowered(trees.select("transaction_hash", "trace_json").mapInArrow(work, FRAMES))


def read_exporter_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """tx_hash, trace_addr, from, to of an exporter's CSV: blank cells are null, commas in trace addresses underscores, and
    in files of kind ``a`` the created address stands in for a missing callee."""
    raw = spark.read.csv(path, header=True, schema=None, inferSchema=False, quote='"', escape='"')
    raw = raw.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in raw.columns})
    df = raw.withColumnsRenamed(EXPORTERS[kind])
    if kind == "a":
        df = df.withColumn("to", F.coalesce("to", "result_address"))
    return df.select("tx_hash", F.translate("trace_addr", ",", "_").alias("trace_addr"), "from", "to")


def read_address_dims(spark: SparkSession, path: str, key: str = "address", sep: str = ",", order: str | None = None) -> DataFrame:
    """An address table in CSV: keys in lower case, values trimmed; of rows with one key the last wins (by the column
    ``order``, else by name of the file and place in it; files are then read whole). A byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=order is None)
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    df = df.withColumns({c: F.trim(c) for c in df.columns}).withColumn(key, F.lower(key))
    row = F.col(order).cast("long") if order else F.struct(F.input_file_name(), F.monotonically_increasing_id())
    rest = [c for c in df.columns if c not in (key, order, "_place")]
    last = df.withColumn("_row", row).groupBy(key).agg(F.max_by(F.struct(*rest), "_row").alias("_last"))
    return last.select(key, *[F.col("_last")[c].alias(c) for c in rest])
