"""Who created contracts: rankings and chains of creators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.labels import unique_labels
from callweave.operators.lifecycle import alive_at
from callweave.operators.traces import filter_traces
from callweave.storage import written


def top_deployers(traces: DataFrame, labels: DataFrame, n: int = 1000) -> DataFrame:
    """(address, deployments, label) of the n creators with most creations; ties by address."""
    top = filter_traces(traces, "creates").groupBy(F.col("from_address").alias("address")).agg(F.count(F.lit(1)).alias("deployments"))
    top = top.orderBy(F.desc("deployments"), "address").limit(n)
    return top.join(unique_labels(labels), "address", "left")


def top_deployers_alive(traces: DataFrame, contracts: DataFrame, fork_block: int, last_block: int | None = None, n: int = 1000) -> DataFrame:
    """Living contracts per creator: the first n, of which then those that are contracts themselves go (in that order)."""
    alive = alive_at(traces, fork_block, last_block, "from_address")
    top = alive.groupBy("from_address").agg(F.count(F.lit(1)).alias("deployed_alive_contracts")).orderBy(F.desc("deployed_alive_contracts"), "from_address").limit(n)
    return top.join(contracts.select(F.col("address").alias("from_address")), "from_address", "left_anti")


def creation_lineage(traces: DataFrame, max_depth: int = 32, by_block: bool = False) -> DataFrame:
    """(original_creator, to_address, depth): every creation, and from it up to the creator's creators, one row for each way up.

    Ways are doubled: those of 2**k steps are put on top of all that have no more, which gives each way of up to 2**(k + 1)
    steps once, so there are as many rounds as the logarithm of the greatest depth. Each round's rows are written. With
    ``by_block`` a creator counts only if it was made no later than what it made, so that contracts that are made anew close no
    circles. Ways longer than ``max_depth`` are an error.
    """
    made = filter_traces(traces, "creates").select(F.col("from_address").alias("original_creator"), "to_address", F.lit(1).alias("depth"), F.col("block_number").alias("first"), F.col("block_number").alias("last"))
    every = top = written(made, "creates")
    steps = 1
    while True:
        lower = every.select(F.col("original_creator").alias("_at"), F.col("to_address").alias("_to"), F.col("depth").alias("_depth"), F.col("first").alias("_first"), F.col("last").alias("_last"))
        on = F.col("to_address") == F.col("_at")
        longer = top.join(lower, on & (F.col("last") <= F.col("_first")) if by_block else on)
        longer = longer.select("original_creator", F.col("_to").alias("to_address"), (F.col("depth") + F.col("_depth")).alias("depth"), "first", F.col("_last").alias("last"))
        longer = written(longer.filter(F.col("depth") <= max_depth + 1), "lineage")
        if not longer.filter(F.col("depth") > max_depth).isEmpty():
            raise ValueError(f"chains of creators are longer than {max_depth}")
        every, steps = every.union(longer), 2 * steps
        top = longer.filter(F.col("depth") == steps)
        if top.isEmpty():
            return every.select("original_creator", "to_address", "depth")


def top_eoa_deployers(lineage: DataFrame, contracts: DataFrame, n: int = 100) -> DataFrame:
    """Contracts made directly or indirectly, and longest chain, per creator that isn't a contract; the first n."""
    eoa = lineage.join(contracts.select(F.col("address").alias("original_creator")), "original_creator", "left_anti")
    per = eoa.groupBy("original_creator", "to_address").agg(F.max("depth").alias("depth"))
    per = per.groupBy("original_creator").agg(F.count("to_address").alias("total_created_contracts"), F.max("depth").alias("max_depth"))
    return per.orderBy(F.desc("total_created_contracts"), "original_creator").limit(n)


def eoa_direct_indirect(lineage: DataFrame, contracts: DataFrame, alive: DataFrame) -> DataFrame:
    """Living contracts per such creator, by whether they were made directly (depth 1) or only through others."""
    eoa = lineage.join(contracts.select(F.col("address").alias("original_creator")), "original_creator", "left_anti")
    eoa = eoa.join(alive.select(F.col("address").alias("to_address")).distinct(), "to_address", "left_semi")
    per = eoa.groupBy("original_creator", "to_address").agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    return per.groupBy("original_creator").agg(
        F.count_if(F.col("least") == 1).alias("direct_create"), F.count_if(F.col("least") > 1).alias("indirect_create"), F.count(F.lit(1)).alias("total"), F.max("most").alias("max_depth")
    )


def lineage_roots(lineage: DataFrame, contracts: DataFrame) -> DataFrame:
    """(to_address, deployer_eoa): the creator at the top of the longest chain that isn't a contract; ties by address."""
    eoa = lineage.join(contracts.select(F.col("address").alias("original_creator")), "original_creator", "left_anti")
    w = Window.partitionBy("to_address").orderBy(F.desc("depth"), "original_creator")
    return eoa.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("to_address", F.col("original_creator").alias("deployer_eoa"))


def deployment_lookup(traces: DataFrame, roots: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, deployer, deployer_eoa, tx_hash, block_number) of the last creation of each listed address."""
    made = filter_traces(traces, "creates").join(addresses.select(F.lower("address").alias("to_address")), "to_address", "left_semi")
    last = made.groupBy("to_address").agg(F.max(F.struct("block_number", "transaction_hash", "from_address")).alias("x"))
    out = last.join(roots, "to_address", "left")
    return out.select(F.col("to_address").alias("address"), F.col("x.from_address").alias("deployer"), "deployer_eoa", F.col("x.transaction_hash").alias("tx_hash"), F.col("x.block_number").alias("block_number"))
