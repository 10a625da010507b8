"""Addresses as numbers: a dense dictionary, traces with ids, and sets of ids as bits.

An address is 42 characters, and a table of contracts has tens of millions of them; with ids a call is 16 bytes and a set of
contracts a bit for each address of the dictionary, so membership of both ends of every call takes no shuffle of calls.
The joins with the dictionary are made once, when traces are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.storage import numbered, written

ENDS = {"from_address": "from_id", "to_address": "to_id"}
#: Ids of a block of bits as a power of two, its bytes with what is kept about it, and the most bytes of a set that goes to every task.
SHIFT, BLOCK_BYTES, MOST_BYTES = 12, 600, 256 << 20


def address_dictionary(traces: DataFrame, columns: Sequence[str] = tuple(ENDS)) -> DataFrame:
    """(address, id): each address of the columns, numbered from 0 in order of addresses, without gaps. Nulls have none."""
    ends = traces.select(F.explode(F.array(*columns)).alias("address")).filter("address is not null").distinct()
    return numbered(ends, ["address"], "id").withColumn("id", F.col("id") - 1)


def with_ids(df: DataFrame, dictionary: DataFrame, ends: dict[str, str] = ENDS) -> DataFrame:
    """``df`` with the id of each address column, null where the dictionary hasn't got it."""
    for column, name in ends.items():
        df = df.join(dictionary.select(F.col("address").alias("_address"), F.col("id").alias(name)), F.col(column) == F.col("_address"), "left").drop("_address")
    return df


def ids_of(addresses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id) of the addresses that the dictionary has."""
    return dictionary.join(addresses.select(F.lower("address").alias("address")), "address", "left_semi").select("id")


def id_bits(ids: DataFrame) -> DataFrame:
    """(block, words): the set of ids as bits, 4,096 ids a row, 64 of them a word. Repeated ids and nulls don't matter."""
    word = F.shiftright("id", 6).bitwiseAND(F.lit(63)).cast("int")
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    words = ids.filter("id is not null").groupBy(F.shiftright("id", SHIFT).alias("block"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    of = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # 64 words at most
    return of.select("block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("words"))


def _has(words: str, column: str) -> Column:
    return F.expr(f"getbit(get({words}, CAST(({column} >> 6) & 63 AS INT)), CAST({column} & 63 AS INT)) = 1")


def with_members(df: DataFrame, bits: DataFrame, columns: Sequence[str] = tuple(ENDS.values())) -> DataFrame:
    """The rows of which all id columns are in the set. The set goes to every task where its measured size is bounded (a bit for
    each address of the dictionary: 256 MB are 2 billion); a larger one is joined by block."""
    bits = written(bits, "bits")
    small = bits.count() * BLOCK_BYTES <= MOST_BYTES
    for k, column in enumerate(columns):
        own = bits.select(F.col("block").alias(f"_b{k}"), F.col("words").alias(f"_w{k}"))
        df = df.join(F.broadcast(own) if small else own, F.shiftright(column, SHIFT) == F.col(f"_b{k}")).filter(_has(f"_w{k}", column)).drop(f"_b{k}", f"_w{k}")
    return df


def contracts_per_tx_by_id(traces: DataFrame, bits: DataFrame) -> DataFrame:
    """(year, addresses_called, frequency) as ``calls.contracts_per_tx`` of traces with ids: the only shuffles are of distinct
    (transaction, id), and of counts."""
    calls = traces.filter((F.col("trace_type") == "call") & (F.col("status") == 1)).select(F.year("block_timestamp").alias("year"), "transaction_hash", *ENDS.values())
    met = with_members(calls, bits).select("year", "transaction_hash", F.explode(F.array(*ENDS.values())).alias("id")).distinct()
    per = met.groupBy("year", "transaction_hash").agg(F.count(F.lit(1)).alias("addresses_called"))
    return per.groupBy("year", "addresses_called").agg(F.count(F.lit(1)).alias("frequency"))
