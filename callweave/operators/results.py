"""Post-processing of result tables, and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.scalars import share
from callweave.operators.labels import unique_labels

QUANTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def weighted_percentiles(histogram: DataFrame) -> DataFrame:
    """(year, addresses_called, frequency) -> per year minimum, quartiles, maximum and transactions.

    A quantile p is the value at p times the total on the line through (running weight, value), the first value to the
    left of it; ``median_rounded`` rounds half to even. Windows are per year, over a histogram's rows.
    """
    w = Window.partitionBy("year").orderBy("addresses_called")
    h = histogram.select("year", F.col("addresses_called").cast("double").alias("x"), F.col("frequency").cast("double").alias("f"), "addresses_called")
    h = h.withColumn("upto", F.sum("f").over(w)).withColumn("whole", F.sum("f").over(Window.partitionBy("year")))
    h = h.withColumn("x0", F.lag("x").over(w)).withColumn("upto0", F.lag("upto").over(w))
    columns = []
    for name, p in QUANTILES:
        at = p * F.col("whole")
        here = (F.col("upto") >= at) & (F.col("upto0").isNull() | (F.col("upto0") < at))
        value = F.when(F.col("upto0").isNull(), F.col("x")).otherwise(F.col("x0") + (at - F.col("upto0")) / (F.col("upto") - F.col("upto0")) * (F.col("x") - F.col("x0")))
        columns.append(F.round(F.max(F.when(here, value)), 6).alias(name))
    out = h.groupBy("year").agg(F.min("addresses_called").alias("min"), *columns, F.max("addresses_called").alias("max"), F.sum("f").cast("long").alias("txs"))
    return out.withColumn("median_rounded", F.bround("median", 0).cast("long"))


def call_type_share(yearly: DataFrame) -> DataFrame:
    """Per cent of calls, static calls and delegate calls among the three (callcode isn't in the whole)."""
    kinds = ("call", "staticcall", "delegatecall")
    whole = sum((F.col(f"call_count_{k}") for k in kinds), F.lit(0))
    return yearly.select("year", *[share(F.col(f"call_count_{k}"), whole).alias(f"{k}_share") for k in kinds])


def deployer_pareto(deployers: DataFrame, eoas: DataFrame, n: int = 100) -> DataFrame:
    """(address, alive) -> the first n by count with running sum, running per cent of the whole and whether they are EOAs.
    The whole is summed first; the window is over the first n rows only."""
    whole = deployers.agg(F.sum("alive")).first()[0]
    order = Window.orderBy(F.desc("alive"), "address")
    top = deployers.orderBy(F.desc("alive"), "address").limit(n)
    ranked = top.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("alive").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("whole", F.lit(whole).cast("long"))
    known = eoas.select("address", F.lit(True).alias("k")).distinct()
    out = ranked.join(known, "address", "left")
    return out.select("address", "alive", "rank", "running", share(F.col("running"), F.col("whole")).alias("running_share"), F.coalesce("k", F.lit(False)).alias("is_eoa"))


def top_callee_links(callees: DataFrame, labels: DataFrame) -> DataFrame:
    """(call_type, callee, call_count): callcode left out, labels for addresses, ``Unknown Callee`` for none."""
    named = callees.filter("call_type <> 'callcode'").join(unique_labels(labels).withColumnRenamed("address", "_a"), F.lower("to_address") == F.col("_a"), "left")
    return named.select("call_type", F.coalesce("label", "to_address", F.lit("Unknown Callee")).alias("callee"), "call_count")


def sankey_nodes(links: DataFrame) -> DataFrame:
    """(node_id, name) of call types and callees: dense ids from 0 in order of name, of a table of top rows."""
    names = links.select(F.col("call_type").alias("name")).union(links.select("callee")).distinct()
    return names.select((F.row_number().over(Window.orderBy("name")) - 1).alias("node_id"), "name")


def sankey_links(links: DataFrame) -> DataFrame:
    nodes = sankey_nodes(links)
    s, t = nodes.select(F.col("node_id").alias("source"), F.col("name").alias("call_type")), nodes.select(F.col("node_id").alias("target"), F.col("name").alias("callee"))
    return links.join(s, "call_type").join(t, "callee").select("source", "target", "call_count")


def top_callee_share(top: DataFrame, yearly_totals: DataFrame) -> DataFrame:
    """(call_type, top_calls, all_calls, top_share): share of a type's calls that go to its top callees."""
    per = top.groupBy("call_type").agg(F.sum("call_count").alias("top_calls"))
    return per.join(yearly_totals, "call_type").select("call_type", "top_calls", "all_calls", share(F.col("top_calls"), F.col("all_calls")).alias("top_share"))


def unlabelled_addresses(addresses: DataFrame, labels: DataFrame) -> DataFrame:
    return addresses.select("address").distinct().join(labels.select("address"), "address", "left_anti")


def attach_labels(nodes: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(node, label): the stored label, else the fetched one, else the address."""
    s, f = unique_labels(stored).toDF("_a", "_s"), unique_labels(fetched).toDF("_b", "_f")
    out = nodes.join(s, F.lower("node") == F.col("_a"), "left").join(f, F.lower("node") == F.col("_b"), "left")
    return out.select("node", F.coalesce("_s", "_f", "node").alias("label"))


def upsert_labels(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(address, label, date_added, last_updated) after taking in (address, label, now): a new snapshot, addresses in lower case.
    Of several new rows of an address the latest counts, then the one with the greatest label; of several stored rows
    the last updated, with the first date that any was added."""
    last = new.filter("address is not null").groupBy(F.lower("address").alias("address")).agg(F.max(F.struct("now", "label")).alias("n"))
    n = last.select("address", F.col("n.label").alias("new_label"), F.col("n.now").alias("now"))
    known = stored.filter("address is not null").groupBy(F.lower("address").alias("address"))
    old = known.agg(F.max(F.struct("last_updated", "label")).alias("o"), F.min("date_added").alias("date_added")).select("address", F.col("o.label").alias("label"), "date_added", F.col("o.last_updated").alias("last_updated"))
    out = old.join(n, "address", "full")
    return out.select("address", F.coalesce("new_label", "label").alias("label"), F.coalesce("date_added", "now").alias("date_added"), F.coalesce("now", "last_updated").alias("last_updated"))
