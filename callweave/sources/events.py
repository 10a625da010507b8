"""The table of creations and destructions, kept up beside stored traces.

They are about a hundredth of all frames and serve all of ``operators.lifecycle`` and ``operators.deployers``. The table has a
folder per year and bucket of blocks like the traces, and a list of the buckets that it covers, so that a new bucket is read once
and no other again. The bucket that holds the latest block may still grow: it isn't covered, and is read from the traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from callweave.operators.traces import KINDS
from callweave.sources.traces import TRACES, stored_buckets

EVENT_TYPES = (*KINDS["creates"], *KINDS["suicides"])


def events_of(traces: DataFrame) -> DataFrame:
    """Successful creations and destructions."""
    return traces.filter(F.col("trace_type").isin(*EVENT_TYPES) & (F.col("status") == 1))


def covered_buckets(spark: SparkSession, path: str) -> list[int]:
    try:
        return sorted(r.bucket for r in spark.read.schema("bucket long").parquet(f"{path}/buckets").distinct().collect())
    except AnalysisException:  # nothing has been covered yet
        return []


def refresh_events(spark: SparkSession, traces_path: str, path: str) -> list[int]:
    """Takes in the buckets that the table doesn't cover, but for the last one; returns them. A run that broke off between writing
    events and listing their buckets is repaired by the next: a bucket's folder is replaced as a whole."""
    have = stored_buckets(spark, traces_path)
    new = sorted(set(have[:-1]) - set(covered_buckets(spark, path)))
    if new:
        rows = events_of(spark.read.schema(f"{TRACES}, year int, bucket long").parquet(traces_path).filter(F.col("bucket").isin(new)))
        rows.repartition("year", "bucket").sortWithinPartitions("year", "bucket", "block_number").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "bucket").parquet(f"{path}/events")
        spark.createDataFrame([(b,) for b in new], "bucket long").coalesce(1).write.mode("append").parquet(f"{path}/buckets")
    return new


def read_events(spark: SparkSession, traces_path: str, path: str) -> DataFrame:
    """All events: of covered buckets from the table, of others from the traces."""
    schema, done = f"{TRACES}, year int, bucket long", covered_buckets(spark, path)
    rest = events_of(spark.read.schema(schema).parquet(traces_path).filter(~F.col("bucket").isin(done)))
    if not done:
        return rest
    return spark.read.schema(schema).parquet(f"{path}/events").filter(F.col("bucket").isin(done)).unionByName(rest)
