import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from callweave.llm import warc
from callweave.llm.common import new_folder

PAGES = "page_id long, url string, html string, payload string"


def pages():
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", rng.choice(("<p>" + "é" * 60, "x" * 99, "y" * 100, f"<i>{k}</i>" * 30, "a\r\n\r\nb" * 40))) for k in range(120)]
    rows += [(500, None, None), (501, "bad\r\nurl: x", ""), (502, "u", "z" * 3_000_000), (503, "u", "z" * 3_000_000), (None, "n", "y" * 100), (3, *rows[3][1:]), (504, "u", "")]
    return rows


def want(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        later = i is not None and b in first and i > first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if later else "response", first[b] if later else None))
    return sorted(out, key=str)


def test_pages_through_archives(spark):
    rows = pages()
    folder = new_folder(spark, "t")
    warc.write_pages(spark.createDataFrame([(*r, "clash") for r in rows], PAGES), folder)
    got = warc.read_pages(spark, folder).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == want(rows)

    archive = spark.read.format("warc").load(folder)
    revisits = archive.filter(F.col("type") == "revisit")
    assert revisits.count() == sum(r[3] == "revisit" for r in want(rows))
    assert "BatchScan" in (plan := revisits._jdf.queryExecution().executedPlan().toString()) and "type" not in plan.split("Filter")[1:].__str__()
    heads = spark.read.format("warc").option("payload", "false").load(folder)
    assert heads.filter("payload is null").count() == len(rows)
    assert heads.filter(F.col("uri").isin("http://h/1", "http://h/2")).count() == 2
    whole = archive.filter("uri = 'http://h/7'").first()
    assert whole.payload.decode() == rows[7][2] or whole.type == "revisit"


def test_unwanted_payloads_are_not_inflated():
    bodies = [random.Random(k).randbytes(200_000) for k in range(3)]
    parts = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", str(k))], b) for k, b in enumerate(bodies)]
    broken = parts[1][:5000] + b"\xff" * (len(parts[1]) - 5000)  # its payload can't be inflated
    found = warc.Members(io.BytesIO(parts[0] + broken + parts[2]))
    assert [(h["warc-record-id"], block() if h["warc-record-id"] != "1" else None) for h, block in found] == [("0", bodies[0]), ("1", None), ("2", bodies[2])]


def test_archives_of_other_writers(spark, tmp_path):
    def raw(k, body):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    bodies = [b"", b"one", b"\r\n\r\n" * 5, b"q" * 500_000]
    (tmp_path / "a.warc").write_bytes(b"".join(raw(k, b) for k, b in enumerate(bodies)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(raw(k + 10, b)) for k, b in enumerate(bodies)))
    warc.register(spark)
    got = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert sorted((r.id, bytes(r.payload)) for r in got) == sorted((f"<{k + n}>", b) for n in (0, 10) for k, b in enumerate(bodies))
    parts = spark.read.format("warc").option("partition_bytes", "1").load(f"file://{tmp_path}")
    assert parts.rdd.getNumPartitions() == 2


def test_append_overwrite_and_abort(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    page = lambda k: spark.createDataFrame([(k, f"u{k}", f"<p>{k}", "")], PAGES)
    ids = lambda: sorted(r.page_id for r in warc.read_pages(spark, folder).collect())
    warc.write_pages(page(1), folder)
    warc.write_pages(page(2), folder)
    assert ids() == [1, 2]
    warc.page_records(page(3)).write.format("warc").mode("overwrite").save(folder)
    assert ids() == [3]
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 1
    bad = warc.page_records(spark.createDataFrame([(k, "u", "x" * 50, "") for k in range(40)], PAGES).repartition(4))
    bad = bad.withColumn("date", F.when(F.col("headers")["X-Page-ID"] == "7", F.raise_error(F.lit("stop"))).otherwise(F.col("date")))
    try:
        bad.write.format("warc").mode("append").save(folder)
        raise AssertionError("written")
    except Exception as e:
        assert "stop" in str(e)
    assert ids() == [3]
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


def test_an_overwriting_job_that_is_lost_leaves_one_state(spark, tmp_path, monkeypatch):
    """Lost after its list is there and before the old ones are gone: only the new records are read, then and after later jobs."""
    folder = f"file://{tmp_path}/w"
    page = lambda k: spark.createDataFrame([(k, f"u{k}", f"<p>{k}", "")], PAGES)
    ids = lambda: sorted(r.page_id for r in warc.read_pages(spark, folder).collect())
    warc.write_pages(page(1), folder)
    with monkeypatch.context() as m:
        m.setattr(warc, "_remove", lambda *a: None)
        warc.WarcWriter({"path": folder}, True).commit([])
    assert ids() == []
    warc.write_pages(page(2), folder)
    assert ids() == [2]
    warc.page_records(page(3)).write.format("warc").mode("overwrite").save(folder)
    assert ids() == [3] and len(list((tmp_path / "w").glob("*.warc.gz"))) == 1


def test_parts_of_files(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/w", pages()
    docs = warc.page_records(spark.createDataFrame([(*r, "clash") for r in rows], PAGES)).coalesce(1)
    warc.register(spark)
    docs.write.format("warc").option("part_bytes", "2000").option("file_bytes", "9000").mode("append").save(folder)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 2
    whole = spark.read.format("warc").option("partition_bytes", "1").load(folder)
    assert whole.rdd.getNumPartitions() > 5
    assert sorted(r.id for r in whole.collect()) == sorted(r.id for r in docs.collect())
    assert sorted(map(tuple, warc.read_pages(spark, folder).drop("url").collect()), key=str) == want(rows)


def test_more_repeats_than_a_task_may_hold(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "clash") for r in pages()], PAGES)
    few = sorted(map(str, warc.page_records(df).collect()))
    monkeypatch.setattr(warc, "FEW_REPEATS", 0)
    assert sorted(map(str, warc.page_records(df).collect())) == few


def test_empty_table(spark):
    folder = new_folder(spark, "t")
    warc.write_pages(spark.createDataFrame([], PAGES), folder)
    assert warc.read_pages(spark, folder).count() == 0
