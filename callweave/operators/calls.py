"""Calls counted: rankings, protocols, contracts per transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.traces import between_members, drop_precompile_and_self, filter_from_list, filter_traces


def top_callees(traces: DataFrame, first: int | None = None, last: int | None = None, n: int = 10) -> DataFrame:
    """(to_address, call_type, call_count): the n most called of each call type in a block window; ties by address."""
    calls = filter_traces(traces, "calls", to_not_null=True)
    if first is not None:
        calls = calls.filter(F.col("block_number") >= first)
    if last is not None:
        calls = calls.filter(F.col("block_number") <= last)
    per = calls.groupBy("to_address", "call_type").agg(F.count(F.lit(1)).alias("call_count"))
    w = Window.partitionBy("call_type").orderBy(F.desc("call_count"), "to_address")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def interactions(traces: DataFrame, addresses, after_block: int | None = None) -> DataFrame:
    """Calls per (from, to) of listed callers."""
    calls = filter_from_list(filter_traces(traces, "calls"), addresses, "from_address", after_block)
    return calls.groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias("call_count"))


def fan_in_fan_out(traces: DataFrame, addresses: DataFrame) -> DataFrame:
    """Distinct callers and callees of listed addresses that have both. Pairs are made distinct before they are counted."""
    calls = filter_traces(traces, "calls")
    fan_in = filter_from_list(calls, addresses, "to_address").select(F.col("to_address").alias("address"), "from_address").distinct().groupBy("address").agg(F.count("from_address").alias("from_address_count"))
    fan_out = filter_from_list(calls, addresses, "from_address").select(F.col("from_address").alias("address"), "to_address").distinct().groupBy("address").agg(F.count("to_address").alias("to_address_count"))
    return fan_in.join(fan_out, "address")


def top_calls_per_caller(traces: DataFrame, addresses: DataFrame, n: int = 5) -> DataFrame:
    per = interactions(drop_precompile_and_self(traces), addresses)
    w = Window.partitionBy("from_address").orderBy(F.desc("call_count"), "to_address")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def creators_of_callees(traces: DataFrame, addresses: DataFrame, creators: DataFrame, n: int = 5) -> DataFrame:
    """(from_address, to_address): listed creators and the contracts of theirs that are among the callers' top n."""
    callees = top_calls_per_caller(traces, addresses, n).select("to_address").distinct()
    made = filter_from_list(filter_traces(traces, "creates"), creators).select("from_address", "to_address")
    return made.join(callees, "to_address", "left_semi").select("from_address", "to_address").distinct()


def contract_to_contract_calls(traces: DataFrame, contracts: DataFrame, year: int | None = None) -> DataFrame:
    """Successful calls with both ends in ``contracts``."""
    calls = filter_traces(traces, "calls")
    if year is not None:
        calls = calls.filter(F.year("block_timestamp") == year)
    return between_members(calls.select(F.year("block_timestamp").alias("year"), "transaction_hash", "from_address", "to_address"), contracts)


def contracts_per_tx(traces: DataFrame, contracts: DataFrame, year: int | None = None) -> DataFrame:
    """(year, addresses_called, frequency): histogram of the distinct contracts, callers and callees, of transactions; all
    years in one pass."""
    both = contract_to_contract_calls(traces, contracts, year)
    met = both.select("year", "transaction_hash", F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    per = met.groupBy("year", "transaction_hash").agg(F.count(F.lit(1)).alias("addresses_called"))
    return per.groupBy("year", "addresses_called").agg(F.count(F.lit(1)).alias("frequency"))
