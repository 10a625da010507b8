"""Two sources of the same traces compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.storage import written


def _in_range(traces: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks start .. end - 1 (the end is excluded here)."""
    return traces.filter((F.col("block_number") >= start) & (F.col("block_number") < end))


def trace_count(traces: DataFrame, start: int, end: int) -> DataFrame:
    return _in_range(traces, start, end).agg(F.count(F.lit(1)).alias("traces"))


def trace_count_by_chunk(traces: DataFrame, start: int, end: int, size: int = 10) -> DataFrame:
    chunk = F.floor((F.col("block_number") - start) / size)
    return _in_range(traces, start, end).groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("traces"))


def _pairs(traces: DataFrame, name: str) -> DataFrame:
    known = traces.filter(F.col("from_address").isNotNull() & F.col("to_address").isNotNull())
    return known.groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias(name))


def pair_count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(from_address, to_address, count_1, count_2) of pairs whose counts differ, 0 where missing."""
    both = _pairs(a, "count_1").join(_pairs(b, "count_2"), ["from_address", "to_address"], "full").fillna(0, ["count_1", "count_2"])
    return both.filter("count_1 <> count_2")


def block_checksums(traces: DataFrame, size: int, columns: tuple[str, ...] = ("from_address", "to_address")) -> DataFrame:
    """(bucket, n, low, high) per ``size`` blocks: rows that have all columns, and sums of the halves of their hashes, which
    don't depend on order. Two sources with equal sums have the same rows there, repeats included."""
    known = traces.dropna(subset=list(columns)).select(F.floor(F.col("block_number") / size).alias("bucket"), F.xxhash64(*columns).alias("h"))
    return known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))


def differing_buckets(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(bucket) of buckets in which the sources' pairs differ."""
    x, y = block_checksums(a, size), block_checksums(b, size).toDF("bucket", "n2", "low2", "high2")
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("low").eqNullSafe(F.col("low2")) & F.col("high").eqNullSafe(F.col("high2"))
    return x.join(y, "bucket", "full").filter(~same).select("bucket")


def pair_count_diff_by_bucket(a: DataFrame, b: DataFrame, size: int = 1000) -> DataFrame:
    """``pair_count_diff`` of sources that agree in most places: pairs are grouped only in buckets whose checksums differ. What a
    pair that differs there has in all other buckets is the same in both, and is counted in one of them, for such pairs only."""
    odd = written(differing_buckets(a, b, size), "buckets")
    at = lambda t, how: t.withColumn("bucket", F.floor(F.col("block_number") / size)).join(odd, "bucket", how)
    diff = written(pair_count_diff(at(a, "left_semi"), at(b, "left_semi")), "pairs")
    pair = ["from_address", "to_address"]
    rest = _pairs(at(a, "left_anti").join(diff.select(*pair), pair, "left_semi"), "_rest")
    both = diff.join(rest, pair, "left").fillna(0, ["_rest"])
    return both.select(*pair, *[(F.col(c) + F.col("_rest")).alias(c) for c in ("count_1", "count_2")])


def pair_count_diff_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair_count_diff(a, b).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("count_1"), F.lit(0)).alias("sum_1"), F.coalesce(F.sum("count_2"), F.lit(0)).alias("sum_2"))


def from_address_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Creators in a (create frames only) that b doesn't have as a caller at all."""
    made = a.filter(F.col("trace_type").startswith("create")).select("from_address").filter("from_address is not null")
    return made.subtract(b.select("from_address"))


def source_row_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    def of(t: DataFrame, name: str) -> DataFrame:
        per = t.groupBy("from_address").agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.lit(name).alias("source"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("from_address").alias("from_count"))

    return of(a, "a").union(of(b, "b"))
