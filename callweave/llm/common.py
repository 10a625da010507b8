"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.storage import scratch_folder

#: A word: a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share. Nothing in it is deleted: results read from it."""
    return scratch_folder(spark, name)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], size: str, total: int, how: str = "inner", hot: int = 200) -> DataFrame:
    """``rows`` with the columns of their group, of which ``groups`` has one row: ``on`` maps columns of rows to those of groups
    (nulls are equal), ``size`` counts a group's rows of ``total``.

    Groups with a share of 1 / ``hot`` or more, of which there are at most ``hot``, are broadcast, so that their rows stay
    where they are; all others are joined by key.
    """

    def same(other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (rows[a].eqNullSafe(other[b]) for a, b in on.items()))

    big = groups.filter(F.col(size) >= total / hot).limit(hot)
    rest = groups.filter(F.col(size) < total / hot)
    names = F.broadcast(big.select(*on.values()))
    first, second = rows.join(F.broadcast(big), same(big)), rows.join(names, same(names), "left_anti").join(rest, same(rest), how)
    drop = [b for b in on.values() if b not in on]
    return first.drop(*drop).unionByName(second.drop(*drop))


def write_file(uri: str, data: bytes) -> None:
    """Whole or not at all: to a name of its own, then renamed."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, path)


def read_file(uri: str) -> bytes:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as file:
        return file.read()
