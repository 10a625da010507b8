"""Filters on traces.

Traces carry their addresses in lower case, as the readers give them (``sources.traces.lowered`` for tables from elsewhere);
lists may be in any case. So conditions compare columns as they are stored and reach the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CREATES = ("create", "create2")
KINDS = {"calls": ("call",), "creates": CREATES, "suicides": ("suicide",)}
#: The most blocks of a request, the default window, and the precompile that is left out.
MAX_BLOCKS, LAST_BLOCKS, ECRECOVER = 7000, 10, "0x0000000000000000000000000000000000000001"


def filter_block_range(df: DataFrame, first: int, last: int, limit: int | None = None) -> DataFrame:
    """Blocks first .. last, both included."""
    if first > last:
        raise ValueError("the first block is after the last")
    if limit is not None and last - first > limit:
        raise ValueError(f"more than {limit} blocks")
    return df.filter(F.col("block_number").between(first, last))


def last_n_blocks(df: DataFrame, n: int = LAST_BLOCKS, floor: int = 0) -> DataFrame:
    """The latest block and the n before it."""
    latest = df.agg(F.max("block_number")).first()[0]
    return df.limit(0) if latest is None else filter_block_range(df, max(floor, latest - n), latest)


def filter_traces(df: DataFrame, kind: str, status: int | None = 1, from_not_null: bool = False, to_not_null: bool = False) -> DataFrame:
    df = df.filter(F.col("trace_type").isin(*KINDS[kind]))
    if status is not None:
        df = df.filter(F.col("status") == status)
    for wanted, c in ((from_not_null, "from_address"), (to_not_null, "to_address")):
        df = df.filter(F.col(c).isNotNull()) if wanted else df
    return df


#: A list of at most so many addresses becomes a condition on the column; a longer one is joined.
FEW = 1000


def filter_from_list(df: DataFrame, addresses: DataFrame | Sequence[str], column: str = "from_address", after_block: int | None = None) -> DataFrame:
    """Rows whose ``column`` is in the list, in any case: a table with a column ``address``, or strings. Of a table at most ``FEW`` + 1
    rows are looked at to choose between a condition and a semi-join."""
    if after_block is not None:
        df = df.filter(F.col("block_number") > after_block)
    if isinstance(addresses, DataFrame):
        listed = addresses.select(F.lower("address").alias("_listed")).distinct()
        some = listed.limit(FEW + 1).collect()
        if len(some) > FEW:
            return df.join(listed, df[column] == listed["_listed"], "left_semi")
        addresses = [r[0] for r in some if r[0] is not None]
    return df.filter(F.col(column).isin(sorted({a.lower() for a in addresses})))


def drop_precompile_and_self(df: DataFrame, precompile: str = ECRECOVER) -> DataFrame:
    """Without calls to the precompile or to oneself; rows without a callee go too."""
    return df.filter((F.col("to_address") != precompile) & (F.col("to_address") != F.col("from_address")))


def created_contracts(df: DataFrame) -> DataFrame:
    """Distinct addresses that a successful frame created."""
    return filter_traces(df, "creates").select(F.col("to_address").alias("address")).distinct()


def with_code(code: DataFrame, excluded: str | None = None) -> DataFrame:
    """(address): valid addresses, in lower case, that have code other than none and the excluded one."""
    has_code = code.filter(F.col("code").isNotNull() & ~F.col("code").isin("", "0x") & F.lower("address").rlike("^0x[0-9a-f]{40}$"))
    if excluded is not None:
        has_code = has_code.filter(F.col("code") != excluded)
    return has_code.select(F.lower("address").alias("address")).distinct()


def filter_contract_endpoints(calls: DataFrame, code: DataFrame, excluded: str | None = None, source: str = "from_address", target: str = "to_address") -> DataFrame:
    """Calls between two addresses that are valid and have code other than none and the excluded one."""
    return between_members(calls, with_code(code, excluded), source, target)


def between_members(calls: DataFrame, members: DataFrame, source: str = "from_address", target: str = "to_address") -> DataFrame:
    """Calls with both ends in ``members`` (address). The large table of members is met once, by the distinct ends of the calls;
    the calls then meet only those ends that are in it."""
    ends = calls.select(F.explode(F.array(source, target)).alias("_end")).distinct()
    good = ends.join(members.select(F.col("address").alias("_end")), "_end", "left_semi")
    out = calls.join(good, calls[target] == good["_end"], "left_semi")
    return out.join(good, out[source] == good["_end"], "left_semi")
