"""Stored labels: whole snapshots, of which readers always see one.

A commit merges new labels into the version that it read, writes the outcome as a table of its own, and then names that table in the
next version's file, which can be made only once: of two writers that read the same version one makes the file, and the other
merges again into what the first left. A table that no version names (of a writer that was lost) is never read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.results import upsert_labels

LABELS = "address string, label string, date_added timestamp, last_updated timestamp"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def latest_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number of the latest version and its table; 0 and None before the first."""
    folder = _path(spark, f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    number = max((int(n) for n in names if n.isdigit()), default=0)
    if not number:
        return 0, None
    file = fs.open(_path(spark, f"{path}/versions/{number:012d}"))
    try:
        return number, file.readUTF()
    finally:
        file.close()


def read_labels(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """(address, label, date_added, last_updated) of the latest version, or of a table that ``latest_version`` named."""
    table = version or latest_version(spark, path)[1]
    return spark.read.schema(LABELS).parquet(f"{path}/tables/{table}") if table else spark.createDataFrame([], LABELS)


def commit_labels(spark: SparkSession, path: str, new: DataFrame, attempts: int = 10) -> int:
    """Takes in (address, label, now) as ``upsert_labels`` does; returns the number of the version that holds them."""
    new = new.select("address", "label", F.col("now").cast("timestamp").alias("now"))
    for _ in range(attempts):
        number, table = latest_version(spark, path)
        name = uuid.uuid4().hex
        upsert_labels(read_labels(spark, path, table) if table else spark.createDataFrame([], LABELS), new).write.parquet(f"{path}/tables/{name}")
        if _claimed(spark, path, number + 1, name):
            return number + 1
    raise RuntimeError(f"{attempts} other writers were faster")


def _claimed(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Whether this writer made the version's file. It is written under a name of its own and moved to the version's, which fails
    if another has it already; so the file is whole or not there."""
    jvm, own, to = spark._jvm.org.apache.hadoop.fs, _path(spark, f"{path}/versions/_{name}"), _path(spark, f"{path}/versions/{number:012d}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(own, False)
    out.writeUTF(name)
    out.close()
    try:
        never = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        jvm.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(own), fs.makeQualified(to), never)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        fs.delete(own, False)
        return False
    return True
