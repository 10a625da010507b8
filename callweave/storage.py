"""Tables written between steps of long jobs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def _own_folder() -> str:
    """One temporary folder of this process, removed at its end."""
    if "path" not in _own:
        _own["path"] = tempfile.mkdtemp(prefix="spark-callweave-")
        atexit.register(shutil.rmtree, _own["path"], ignore_errors=True)
    return f"file://{_own['path']}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; results read from it, so it must live as
    long as they are used. Where that is unset, a temporary folder on local masters and an error on any other."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again: cuts lineage."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the column ``name``: the row's place, from 1, in the given order, which should be total.

    Rows are range-partitioned, sorted and written; a row's place is that in its partition, after all rows of the
    partitions before, of which only the sizes are brought together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The number's upper bits are the partition, the lower 33 the place in it.
    rows = written(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("_part", before.alias("_before"))
    return rows.join(first, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def write_ordered(pieces: DataFrame, order: list, uri: str, column: str = "piece") -> None:
    """Writes the strings of ``column``, end to end in the given order, as the parts of one document in the folder ``uri``.

    Rows are dealt by ranges of the order and each task streams its range to a part of its own: a task has an even share, however
    long the document. A part is complete or not there: it is written under the attempt's own name and then renamed. The list
    of parts, in order, is written last, in one step; a folder without it holds no document, and parts that it doesn't
    name (of attempts that were lost) belong to none.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        name, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_{name}") as out:
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    data = text.encode()
                    out.write(data)
                    size += len(data)
        store.move(f"{path}/_{name}", f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([size], pa.int64())], ["part", "name", "size"])

    placed = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(column)
    listed = placed.mapInArrow(work, "part int, name string, size long").orderBy("part").collect()
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_parts.tmp") as out:
        out.write(json.dumps([{"name": r.name, "size": r.size} for r in listed if r.size]).encode())
    store.move(f"{path}/_parts.tmp", f"{path}/_parts.json")


def document_parts(uri: str) -> list[str]:
    """URIs of a written document's parts, in order."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{path}/_parts.json") as file:
        return [f"{uri}/{p['name']}" for p in json.loads(file.read())]


def read_document(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The document in chunks, in order: its parts end to end."""
    for part in document_parts(uri):
        store, path = pyarrow.fs.FileSystem.from_uri(part)
        with store.open_input_stream(path) as file:
            while data := file.read(chunk):
                yield data
