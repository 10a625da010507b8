"""Traces and dimensions derived from the test tables lineitem, orders and part, in SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from callweave.sources.events import events_of
from callweave.sources.traces import read_traces, write_traces
from callweave.storage import scratch_folder

ADDRESS = "'0xc' || lpad(CAST(p_partkey AS STRING),39,'0')"

TRACES = """
 li AS (
  SELECT l.l_orderkey, l.l_suppkey, l.l_linestatus, o.o_custkey,
   row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_extendedprice) - 1 AS i,
   CASE WHEN l.l_suppkey % 20 = 0 THEN '0x' || lpad(CAST(1 + l.l_partkey % 9 AS STRING),40,'0')
        WHEN l.l_suppkey % 5 = 0 THEN '0xc' || lpad(CAST(l.l_partkey % 10 AS STRING),39,'0')
        ELSE '0xc' || lpad(CAST(l.l_partkey AS STRING),39,'0') END AS tgt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
 fr AS (SELECT *, CASE WHEN i = 0 THEN 'call' WHEN l_suppkey % 10 < 5 THEN 'call' WHEN l_suppkey % 10 < 7 THEN 'delegatecall' WHEN l_suppkey = 99 THEN 'callcode' ELSE 'staticcall' END AS ct,
   CASE WHEN i < 1 THEN -1 WHEN i < 4 THEN 0 ELSE 1 + (i - 4) % 3 END AS pi,
   CASE WHEN i < 1 THEN '' WHEN i < 4 THEN CAST(i - 1 AS STRING) ELSE CAST((i - 4) % 3 AS STRING) || ',' || CAST(CAST(floor((i - 4) / 3) AS BIGINT) AS STRING) END AS trace_address,
   first_value(tgt) OVER (PARTITION BY l_orderkey ORDER BY i) AS root_to FROM li),
 blk AS (SELECT o_orderkey, o_orderdate AS block_timestamp,
   CAST((((year(o_orderdate)-1995)*12 + month(o_orderdate)-1)*31 + day(o_orderdate)-1)*10 + o_orderkey % 10 AS BIGINT) AS block_number,
   '0x' || lpad(CAST(o_orderkey AS STRING),64,'0') AS transaction_hash FROM orders),
 ev AS (
  SELECT f.l_orderkey AS k, f.trace_address, 'call' AS trace_type, f.ct AS call_type,
   CASE WHEN f.i = 0 THEN '0xe' || lpad(CAST(f.o_custkey AS STRING),39,'0') WHEN f.pi = 0 THEN f.root_to WHEN p.ct = 'delegatecall' THEN f.root_to ELSE p.tgt END AS from_address,
   f.tgt AS to_address, CASE WHEN f.l_linestatus = 'F' AND f.l_suppkey % 7 = 0 THEN 0 ELSE 1 END AS status
  FROM fr f LEFT JOIN fr p ON f.l_orderkey = p.l_orderkey AND f.pi = p.i
  UNION ALL
  SELECT p_partkey, '50', CASE WHEN p_partkey % 3 = 0 THEN 'create2' ELSE 'create' END, NULL,
   CASE WHEN p_partkey < 20 OR p_partkey % 4 = 0 THEN '0xe' || lpad(CAST(p_partkey % 40 AS STRING),39,'0') ELSE '0xc' || lpad(CAST(CAST(floor(p_partkey/10) AS BIGINT) AS STRING),39,'0') END,
   '0xc' || lpad(CAST(p_partkey AS STRING),39,'0'), CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 1 END FROM part
  UNION ALL
  SELECT p_partkey + 1000, '52', 'create2', NULL, '0xe' || lpad(CAST(p_partkey % 40 + 1 AS STRING),39,'0'), '0xc' || lpad(CAST(p_partkey AS STRING),39,'0'), 1 FROM part WHERE p_partkey % 50 = 5
  UNION ALL
  SELECT CASE WHEN p_partkey % 10 = 0 THEN p_partkey ELSE p_partkey + 500 END, '51', 'suicide', NULL, '0xc' || lpad(CAST(p_partkey AS STRING),39,'0'), '0xe' || lpad(CAST(p_partkey % 40 AS STRING),39,'0'), 1 FROM part WHERE p_partkey % 5 = 0),
 traces AS (SELECT b.block_number, CAST(b.block_timestamp AS TIMESTAMP) AS block_timestamp, b.transaction_hash, ev.trace_address, ev.trace_type, ev.call_type, ev.from_address, ev.to_address, ev.status FROM ev JOIN blk b ON ev.k = b.o_orderkey)
"""

#: Dimensions, each the body of a query on part or on traces. Categories are fixed values.
DIMS = {
    "contracts": "SELECT DISTINCT to_address AS address FROM traces WHERE status = 1 AND trace_type IN ('create','create2')",
    "code": f"SELECT {ADDRESS} AS address, CASE WHEN p_partkey % 41 = 0 THEN '0x' ELSE '0x6080' END AS code FROM part",
    "labels": f"SELECT {ADDRESS} AS address, p_name AS label FROM part WHERE p_partkey % 3 = 0",
    "fetched": f"SELECT {ADDRESS} AS address, p_name AS label FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0",
    "annotations": f"SELECT {ADDRESS} AS address, p_partkey % 6 = 0 AS documented, p_size > 25 AS verified, CASE WHEN p_partkey % 4 = 0 THEN 'Lido' WHEN p_partkey % 4 = 1 THEN 'External' END AS category, p_name AS name_tag FROM part",
    "listed": f"SELECT {ADDRESS} AS address FROM part WHERE p_partkey < 50",
    "creators": "SELECT DISTINCT from_address AS address FROM traces WHERE status = 1 AND trace_type IN ('create','create2') AND CAST(substr(to_address, 4) AS BIGINT) % 2 = 0",
    "events": "SELECT * FROM traces WHERE status = 1 AND trace_type IN ('create','create2','suicide')",
    "source_b": "SELECT * FROM traces WHERE block_number % 13 <> 0 UNION ALL SELECT * FROM traces WHERE block_number % 17 = 0",
}
_TABLES = ("lineitem", "orders", "part")
#: Folders of test tables -> where their traces and events are stored.
_stored: dict[str, tuple[str, str]] = {}


def store(spark: SparkSession, sf_dir: str) -> None:
    """Writes the traces and events of a folder of test tables once; from then on ``frame`` reads them."""
    traces, events = scratch_folder(spark, "traces"), scratch_folder(spark, "events")
    write_traces(frame(spark, sf_dir), traces)
    events_of(read_traces(spark, traces)).drop("year", "bucket").write.parquet(events)
    _stored[sf_dir] = traces, events


def frame(spark: SparkSession, sf_dir: str, name: str = "traces") -> DataFrame:
    """The traces or a dimension of them."""
    for t in _TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"callweave_{t}")
    traces = TRACES
    if sf_dir in _stored:
        path, events = _stored[sf_dir]
        if name == "events":
            return spark.read.parquet(events)
        read_traces(spark, path).drop("year", "bucket").createOrReplaceTempView("callweave_traces")
        traces = "traces AS (SELECT * FROM callweave_traces)"
    sql = f"WITH {traces} {DIMS.get(name, 'SELECT * FROM traces')}"
    # Views of this library's own, so that none of the session's is replaced.
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 callweave_\2", sql))


def oracle(sql: str, *dims: str) -> str:
    """``sql`` with the traces and the named dimensions before it; further common tables may open it as ``WITH``."""
    ctes = [TRACES, *[f"{d} AS ({DIMS[d]})" for d in dims]]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {sql[5:]}"
    return f"WITH {', '.join(ctes)} {sql}"
