"""WARC archives as a Spark data source, read and written.

``spark.read.format("warc").load(folder)`` plans one partition per group of parts of files of about ``partition_bytes`` (files
of this writer have parts of about ``PART_BYTES``, others are one part each), and takes equality, membership and not-null conditions on record types and other header columns into the
scan. A reader decodes only a record's head at first: each record is a gzip member whose extra field gives its compressed
and uncompressed lengths, so that the payload of a record that no condition wants is skipped and never inflated (members
of other writers, without that field, are inflated and dropped). ``payload=false`` reads heads only.

``df.write.format("warc").save(folder)`` writes rows of (type, id, uri, date, payload, headers). Each task writes files of
about ``FILE_BYTES`` under names of its own attempt. The commit of a job puts a list of its files, with the places at which
their parts begin, into the folder in one step; the files of all lists are what is read, so that attempts that were lost leave
nothing that is read. Mode ``append`` adds a list; ``overwrite`` adds one that also names the lists that were there before: they
are out of force from the moment it is there, and are then removed with their files, so that a job lost on the way leaves
either the old records or the new ones to be read. A job that fails removes what its tasks have written. Files are opened by URI through pyarrow.

Records of any size are read and written whole, one at a time. An empty table gives a folder without records. Rows need the
columns named above; others are ignored. Equal rows give equal records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from callweave.llm.common import new_folder, saved, table

FILE_BYTES, PART_BYTES, PARTITION_BYTES, MIN_REVISIT = 64 << 20, 4 << 20, 12 << 20, 100
#: Repeats that every task may hold, of about 150 bytes each.
FEW_REPEATS = 200_000
#: Lists of files (name -> [size, place of each part]) and of the lists that they replace.
LIST = "_files-"
SCHEMA = "type string, id string, uri string, date string, content_type string, block_length long, payload_digest string, refers_to string, headers map<string,string>, http_headers map<string,string>, payload binary"
#: Columns that are WARC headers, and their names.
HEADERS = {"type": "warc-type", "id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
NAMES = SCHEMA.replace("map<string,string>", "map").split(", ")
TYPES = [pa.int64() if n.endswith(" long") else pa.binary() if n.endswith(" binary") else pa.map_(pa.string(), pa.string()) if n.endswith(" map") else pa.string() for n in NAMES]
NAMES = [n.split()[0] for n in NAMES]


def _clean(value: str) -> str:
    """A header's value: one line, without what would end it."""
    return " ".join(value.split("\r")).replace("\n", " ").strip()


def record(headers: Sequence[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, with its lengths in the extra field ``sl``."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode("utf-8", "replace") + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(raw) + press.flush()
    start = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    size = len(start) + 8 + len(body) + 8
    return start + struct.pack("<II", size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parsed(head: bytes) -> dict[str, str]:
    """Header lines after the first -> names in lower case; of repeated names the last counts."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class Members:
    """The records of one file from place ``at`` up to ``stop``, heads first: yields (headers, block), where block() inflates the rest."""

    STEP = 1 << 16

    def __init__(self, file, at: int = 0, stop: int | None = None):
        self.file, self.buffer, self.start, self.at, self.stop = file, b"", 0, at, stop
        file.seek(at)

    def _need(self, n: int) -> bool:
        while len(self.buffer) - self.start < n:
            more = self.file.read(max(self.STEP, n))
            if not more:
                return False
            self.buffer = self.buffer[self.start :] + more
            self.start = 0
        return True

    def _skip(self, n: int) -> None:
        self.at += n
        have = len(self.buffer) - self.start
        if n <= have:
            self.start += n
        else:
            self.file.seek(n - have, 1)
            self.buffer, self.start = b"", 0

    def _length(self) -> int | None:
        """Compressed size of the member that starts here, if its extra field has it."""
        if self.buffer[self.start + 3] & 4 and self._need(24):
            at = self.start
            (n,) = struct.unpack("<H", self.buffer[at + 10 : at + 12])
            self._need(12 + n)
            extra, k = self.buffer[self.start + 12 : self.start + 12 + n], 0
            while k + 4 <= len(extra):
                (m,) = struct.unpack("<H", extra[k + 2 : k + 4])
                if extra[k : k + 2] == b"sl" and m == 8:
                    return struct.unpack("<I", extra[k + 4 : k + 8])[0] or None
                k += 4 + m
        return None

    def __iter__(self) -> Iterator:
        while (self.stop is None or self.at < self.stop) and self._need(18):
            size = self._length()
            inflate, got, used = zlib.decompressobj(31), b"", 0
            end = -1
            while end < 0 and not inflate.eof:
                if size is not None and used >= size or not self._need(used + 1):
                    break
                piece = self.buffer[self.start + used : self.start + min(used + 2048, size if size is not None else used + 2048)]
                got += inflate.decompress(piece)
                used += len(piece) - len(inflate.unused_data)
                end = got.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError("a record without a whole head")
            headers = parsed(got[:end])
            state = {"used": used, "got": [got[end + 4 :]]}

            def rest(keep: bool, inflate=inflate, state=state, size=size) -> None:
                while not inflate.eof and self._need(state["used"] + 1):
                    limit = len(self.buffer) - self.start - state["used"]
                    piece = self.buffer[self.start + state["used"] : self.start + state["used"] + min(limit, self.STEP if size is None else size - state["used"])]
                    out = inflate.decompress(piece)
                    state["used"] += len(piece) - len(inflate.unused_data)
                    if keep:
                        state["got"].append(out)

            def block(rest=rest, state=state, n=int(headers.get("content-length", 0))) -> bytes:
                rest(True)
                return b"".join(state["got"])[:n]

            yield headers, block
            if size is None:
                rest(False)
                size = state["used"]
            self._skip(size)


@dataclass
class Parts(InputPartition):
    """Parts of files: URI, place of the first record, and of the first one beyond (None: the end of the file)."""

    parts: tuple[tuple[str, int, int | None], ...]


def _lists(store, path: str, past: bool = False) -> dict[str, dict[str, list]]:
    """Name of each list in the folder that is in force, or with ``past`` of every one -> the files that it lists."""
    out, replaced = {}, set()
    for x in store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)):
        if x.is_file and x.base_name.startswith(LIST) and x.base_name.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                listed = json.loads(f.read())
            out[x.base_name] = listed["files"]
            replaced.update(listed["replaces"])
    return {name: files for name, files in out.items() if past or name not in replaced}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.target = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            else:
                self.wanted.append((name, (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None))

    def partitions(self) -> list[Parts]:
        store, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        scheme = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else self.folder.partition("://")[0] + "://"
        lists = _lists(store, path)
        files: dict[str, list] = {f"{path}/{name}": places for listed in lists.values() for name, places in listed.items()}
        if not lists:
            found = store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
            files = {x.path: [x.size, 0] for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz"))}
        out, group, held = [], [], 0
        for p in sorted(files):
            size, *starts = files[p]
            for lo, hi in zip(starts, [*starts[1:], None], strict=True):
                if group and held + (hi or size) - lo > self.target:
                    out.append(Parts(tuple(group)))
                    group, held = [], 0
                group.append((scheme + p, lo, hi))
                held += (hi or size) - lo
        return [*out, Parts(tuple(group))]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for uri, lo, hi in partition.parts:
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                for headers, block in Members(file, lo, hi) if path.endswith(".gz") else _plain(file):
                    if any(name not in headers or (values is not None and headers[name] not in values) for name, values in self.wanted):
                        continue
                    http, payload = {}, None
                    if self.payload:
                        data = block()
                        http, payload = _payload(headers, data)
                    rows.append(tuple(_value(n, headers, http, payload) for n in NAMES))
                    held += len(payload or b"")
                    if len(rows) == 1024 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _plain(file) -> Iterator:
    """Records of an archive that isn't compressed."""
    buffer = b""
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            more = file.read(1 << 16)
            if not more:
                return
            buffer += more
        headers = parsed(buffer[:end])
        n, at = int(headers.get("content-length", 0)), file.tell() - len(buffer) + end + 4
        held = buffer[end + 4 : end + 4 + n]

        def block(at=at, n=n, held=held) -> bytes:
            if len(held) == n:
                return held
            file.seek(at)
            return file.read(n)

        yield headers, block
        file.seek(at + n + 4)
        buffer = b""


def _payload(headers: dict, block: bytes) -> tuple[dict, bytes]:
    """HTTP headers and payload of a block; a revisit has no payload."""
    if "msgtype=response" not in headers.get("content-type", "").replace(" ", "").lower():
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    return parsed(head), body


def _value(name: str, headers: dict, http: dict, payload: bytes | None):
    if name == "headers":
        return list(headers.items())
    if name == "http_headers":
        return list(http.items())
    if name == "payload":
        return payload
    return int(headers.get("content-length", 0)) if name == "block_length" else headers.get(HEADERS[name])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, list]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.file_bytes, self.part_bytes = int(options.get("file_bytes", FILE_BYTES)), int(options.get("part_bytes", PART_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.create_dir(path, recursive=True)
        task, job = TaskContext.get(), uuid.uuid4().hex[:8]
        files: dict[str, list] = {}
        out, held, name = None, 0, ""
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 256):
                    for row in batch.slice(at, 256).to_pylist():
                        if out is None:
                            name, held = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{job}-{len(files):04d}.warc.gz", 0
                            out = store.open_output_stream(f"{path}/{name}", compression=None)
                            files[name] = [0, 0]
                        elif held - files[name][-1] >= self.part_bytes:
                            files[name].append(held)
                        data = record(*_written(row))
                        out.write(data)
                        held += len(data)
                        if held >= self.file_bytes:
                            out.close()
                            out, files[name][0] = None, held
            if out is not None:
                out.close()
                files[name][0] = held
        except BaseException:
            if out is not None:
                out.close()
            _remove(store, path, files)
            raise
        return Written(files)

    def commit(self, messages: list) -> None:
        store, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.create_dir(path, recursive=True)
        before = _lists(store, path, past=True) if self.overwrite else {}
        name = f"{LIST}{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{path}/.{name}") as f:
            files = {file: places for m in messages if m for file, places in m.files.items()}
            f.write(json.dumps({"files": files, "replaces": sorted(before)}).encode())
        store.move(f"{path}/.{name}", f"{path}/{name}")
        _remove(store, path, before)
        _remove(store, path, [file for listed in before.values() for file in listed])

    def abort(self, messages: list) -> None:
        store, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        _remove(store, path, [file for m in messages if m for file in m.files])


def _remove(store, path: str, names) -> None:
    for name in names:
        if store.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.File:
            store.delete_file(f"{path}/{name}")


def _written(row: dict) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a row to write; a response's or revisit's block is HTTP headers and, for a response, the payload."""
    payload, kind = row["payload"] or b"", row["type"]
    length = row.get("payload_length") if row.get("payload_length") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [("WARC-Type", kind), ("WARC-Record-ID", row["id"]), ("WARC-Date", row["date"])]
    headers += [("WARC-Target-URI", row["uri"])] if row["uri"] else []
    headers += [("Content-Type", "application/http; msgtype=response")]
    headers += [(k, v) for k, v in (row["headers"] or []) if v is not None]
    return headers, http + payload if kind == "response" else http


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand conditions to sources written in Python (a session setting)."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ----


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))


def page_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html) -> rows to write. Of equal payloads of ``min_revisit`` bytes or more the least page id is the
    response and the others revisit it. A null html is an empty payload; rows with a null id are responses; equal rows
    are equal records. Repeats are found on ids and digests alone, and written; if they are at most ``FEW_REPEATS`` they are sent to
    all tasks, so that no payload moves, else the pages are joined to them by a shuffle on both."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = p.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_revisit)).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    later = keys.join(first, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct()
    later = saved(later, "cw-repeats")
    rows = p.join(F.broadcast(later) if later.count() <= FEW_REPEATS else later, ["page_id", "digest"], "left")
    is_later = F.col("first").isNotNull()
    headers = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("X-Page-ID", "WARC-Payload-Digest", "WARC-Refers-To", "X-Refers-To-Page-ID", "WARC-Profile")]),
        F.array(
            F.col("page_id").cast("string"), F.concat(F.lit("sha256:"), "digest"), F.when(is_later, record_id(F.col("first"), F.col("digest"))), F.col("first").cast("string"),
            F.when(is_later, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
    )
    return rows.select(
        F.when(is_later, "revisit").otherwise("response").alias("type"), record_id(F.col("page_id"), F.col("digest")).alias("id"), "uri", F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.octet_length("payload").cast("long").alias("payload_length"), F.when(~is_later, F.col("payload")).alias("payload"), headers.alias("headers"),
    )


def write_pages(pages: DataFrame, folder: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's figures are
    of the payload as read; a revisit's of its headers, and its scan inflates no payload."""
    register(spark)
    archive = spark.read.format("warc").load(folder).filter(F.col("type").isin("response", "revisit"))
    own = F.col("type") == "response"
    h = lambda name: F.element_at("headers", name)
    return archive.select(
        h("x-page-id").cast("long").alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.element_at("http_headers", "content-length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.substring_index(F.col("payload_digest"), ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        h("x-refers-to-page-id").cast("long").alias("refers_to"),
        F.col("uri").alias("url"),
    )


def op6_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "cw-warc")
    write_pages(table(spark, sf_dir, "pages"), folder)
    return read_pages(spark, folder).drop("url")


ORACLE = {
    "op6_warc_pages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN p.n >= 100 AND p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
""",
}
