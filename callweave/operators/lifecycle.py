"""Creation, destruction and survival of contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.traces import filter_traces


def create_by_year(traces: DataFrame) -> DataFrame:
    return filter_traces(traces, "creates").groupBy(F.year("block_timestamp").alias("year")).agg(F.count(F.lit(1)).alias("create_trace_count"))


def destruct_by_year(traces: DataFrame) -> DataFrame:
    return filter_traces(traces, "suicides").groupBy(F.year("block_timestamp").alias("year")).agg(F.count(F.lit(1)).alias("destruct_trace_count"))


def call_types_by_year(traces: DataFrame, last_block: int | None = None) -> DataFrame:
    """Per year: distinct callees, call rows, rows with a call type (``distinct_call_types``: a plain count, as published)
    and rows per call type. Callees are counted after a grouping by year and callee, so no year is counted in one place."""
    calls = filter_traces(traces, "calls", from_not_null=True, to_not_null=True)
    if last_block is not None:
        calls = calls.filter(F.col("block_number") <= last_block)
    types = ("call", "delegatecall", "staticcall", "callcode")
    first = calls.groupBy(F.year("block_timestamp").alias("year"), "to_address").agg(
        F.count(F.lit(1)).alias("edges_count"), F.count("call_type").alias("distinct_call_types"), *[F.count_if(F.col("call_type") == t).alias(f"call_count_{t}") for t in types]
    )
    sums = ["edges_count", "distinct_call_types", *[f"call_count_{t}" for t in types]]
    return first.groupBy("year").agg(F.count(F.lit(1)).alias("nodes_count"), *[F.sum(c).alias(c) for c in sums])


def creations_last(traces: DataFrame, *by: str) -> DataFrame:
    """Last creation of each contract (and of each ``by``): block and time."""
    creates = filter_traces(traces, "creates").withColumn("address", F.col("to_address"))
    return creates.groupBy(*by, "address").agg(F.max("block_number").alias("created_block"), F.max("block_timestamp").alias("created_time"))


def suicides_last(traces: DataFrame) -> DataFrame:
    return filter_traces(traces, "suicides").groupBy(F.col("from_address").alias("address")).agg(F.max("block_number").alias("destroyed_block"))


def alive_before(traces: DataFrame, *by: str) -> DataFrame:
    """Contracts whose last creation is after their last destruction, if any."""
    both = creations_last(traces, *by).join(suicides_last(traces), "address", "left")
    return both.filter(F.col("destroyed_block").isNull() | (F.col("created_block") > F.col("destroyed_block"))).drop("destroyed_block")


def alive_by_year(traces: DataFrame) -> DataFrame:
    """(year, n_alive_contracts): alive at the end of each year that has an event.

    One pass for all years: per contract and year the last creation and destruction, carried on from year to year; a
    contract adds one to the years from which it is alive and takes one from those in which it no longer is.
    """
    from pyspark.sql import Window

    c = filter_traces(traces, "creates").select(F.col("to_address").alias("address"), F.year("block_timestamp").alias("year"), F.col("block_number").alias("c"), F.lit(None).cast("long").alias("d"))
    d = filter_traces(traces, "suicides").select(F.col("from_address").alias("address"), F.year("block_timestamp").alias("year"), F.lit(None).cast("long").alias("c"), F.col("block_number").alias("d"))
    w = Window.partitionBy("address").orderBy("year")
    per = c.union(d).groupBy("address", "year").agg(F.max("c").alias("c"), F.max("d").alias("d"))
    per = per.select("address", "year", F.max("c").over(w).alias("c"), F.max("d").over(w).alias("d"))
    alive = per.withColumn("alive", (F.col("c").isNotNull() & (F.col("d").isNull() | (F.col("c") > F.col("d")))).cast("long"))
    change = alive.withColumn("change", F.col("alive") - F.coalesce(F.lag("alive").over(w), F.lit(0)))
    by_year = change.groupBy("year").agg(F.sum("change").alias("change"))
    return by_year.select("year", F.sum("change").over(Window.orderBy("year")).alias("n_alive_contracts"))


def alive_at(traces: DataFrame, fork_block: int, last_block: int | None = None, *by: str) -> DataFrame:
    """Contracts alive at ``last_block`` under two rules: before the fork as ``alive_before``; from the fork on a contract
    only dies in the transaction that created it. Contracts of both parts count twice, as published."""
    before = alive_before(traces.filter(F.col("block_number") < fork_block), *by)
    after = traces.filter(F.col("block_number") >= fork_block)
    if last_block is not None:
        after = after.filter(F.col("block_number") <= last_block)
    created = filter_traces(after, "creates").select(*by, F.col("to_address").alias("address"), F.col("block_number").alias("created_block"), F.col("block_timestamp").alias("created_time"), "transaction_hash").distinct()
    died = filter_traces(after, "suicides").select(F.col("from_address").alias("address"), "transaction_hash")
    return before.unionByName(created.join(died, ["address", "transaction_hash"], "left_anti").drop("transaction_hash"))


def lifecycle_by_year(traces: DataFrame) -> DataFrame:
    parts = [create_by_year(traces), destruct_by_year(traces), alive_by_year(traces)]
    return reduce(lambda a, b: a.join(b, "year", "full"), parts).fillna(0, ["create_trace_count", "destruct_trace_count"])
