"""Labels of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_by_address(dimension: DataFrame, value: str, order: str | None = None) -> DataFrame:
    """(address, value) with one row per address in lower case, so that a join with it multiplies nothing: of several values the
    last by the column ``order`` counts, or where the table has no order the greatest, so that runs agree. Null values and
    addresses count as none."""
    known = dimension.filter(F.col(value).isNotNull() & F.col("address").isNotNull())
    one = F.max_by(value, F.struct(order, value)) if order else F.max(value)
    return known.groupBy(F.lower("address").alias("address")).agg(one.alias(value))


def unique_labels(labels: DataFrame, order: str | None = None) -> DataFrame:
    """(address, label), each address once."""
    return unique_by_address(labels, "label", order)
