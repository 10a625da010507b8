"""All registered queries on the test tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import scalars as sc
from callweave.operators import addresses as oa
from callweave.operators import calls as oc
from callweave.operators import deployers as od
from callweave.operators import graph as og
from callweave.operators import lifecycle as ol
from callweave.operators import reconcile as rc
from callweave.operators import results as rs
from callweave.operators import traces as ot
from callweave.plans.network import network_documents, network_pieces
from callweave.plans.testview import frame, oracle
from callweave.sources import events as se
from callweave.sources import labels as sl
from callweave.sources import sinks
from callweave.sources import traces as st
from callweave.storage import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FORK = 18600
TARGET = "0xc000000000000000000000000000000000000003"
FIRST, LAST = 5000, 20000


class Tables:
    """The traces and dimensions of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def one(self, address: str = TARGET) -> DataFrame:
        return self.spark.createDataFrame([(address,)], "contract string")

    def edges(self) -> DataFrame:
        return og.call_edges(og.extract_calls(self.traces, self.one()))

    def part(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/part.parquet")


def query(name: str, sql: str | None, *dims: str):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql, *dims)
        return f

    return add


COUNT = "CAST(count(*) AS BIGINT)"
OK_CREATE = "status = 1 AND trace_type IN ('create','create2')"
OK_CALL = "status = 1 AND trace_type = 'call'"
YEAR = "CAST(year(block_timestamp) AS INTEGER)"

# ---- sources and sinks ----

_ALL = "SELECT block_number, block_timestamp, transaction_hash, trace_address, trace_type, call_type, from_address, to_address, status FROM traces"


@query("read_traces", _ALL + " WHERE year(block_timestamp) IN (1996, 1999)")
def _(t):
    path = scratch_folder(t.spark, "traces")
    st.write_traces(t.traces.withColumns({c: F.concat(F.lit("0x"), F.upper(F.substr(c, F.lit(3)))) for c in ("from_address", "to_address")}), path)
    return st.read_traces(t.spark, path, [1996, 1999]).drop("year", "bucket").na.fill({"trace_address": ""})


@query("flatten_call_trees", "SELECT transaction_hash, trace_address, CASE WHEN trace_address = '' THEN 0 ELSE length(trace_address) - length(replace(trace_address, ',', '')) + 1 END AS depth, from_address, to_address, upper(call_type) AS type FROM traces WHERE trace_type = 'call'")
def _(t):
    f = t.traces.filter("trace_type = 'call'").select("transaction_hash", "trace_address", F.struct(F.col("from_address").alias("from"), F.col("to_address").alias("to"), F.upper("call_type").alias("type")).alias("f"))
    place = F.split("trace_address", ",")
    f = f.withColumn("depth", F.when(F.col("trace_address") == "", 0).otherwise(F.size(place)))
    head = lambda c: F.regexp_replace(F.to_json(c), "\\}$", "")
    leaf = f.filter("depth = 2").select("transaction_hash", place[0].cast("int").alias("i"), place[1].cast("int").alias("j"), F.to_json("f").alias("doc"))
    leaf = leaf.groupBy("transaction_hash", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", "doc"))), lambda x: x["doc"]), ",").alias("inner"))
    mid = f.filter("depth = 1").select("transaction_hash", place[0].cast("int").alias("i"), head(F.col("f")).alias("h")).join(leaf, ["transaction_hash", "i"], "left")
    mid = mid.select("transaction_hash", "i", F.concat("h", F.when(F.col("inner").isNull(), "").otherwise(F.concat(F.lit(',"calls":['), "inner", F.lit("]"))), F.lit("}")).alias("doc"))
    mid = mid.groupBy("transaction_hash").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "doc"))), lambda x: x["doc"]), ",").alias("inner"))
    root = f.filter("depth = 0").select("transaction_hash", head(F.col("f")).alias("h")).join(mid, "transaction_hash", "left")
    return st.flatten_call_trees(root.select("transaction_hash", F.concat("h", F.lit(',"calls":['), F.coalesce("inner", F.lit("")), F.lit("]}")).alias("trace_json")))


@query("read_exporter_csv", "SELECT transaction_hash AS tx_hash, CASE WHEN trace_address <> '' THEN replace(trace_address, ',', '_') END AS trace_addr, from_address AS \"from\", to_address AS \"to\" FROM traces")
def _(t):
    path = scratch_folder(t.spark, "exporter")
    made = F.col("trace_type").startswith("create")
    rows = t.traces.select("transaction_hash", "trace_address", F.col("trace_type").alias("action_type"), F.col("from_address").alias("action_from"), F.when(made, "  ").otherwise(F.col("to_address")).alias("action_to"), F.when(made, F.col("to_address")).alias("result_address"))
    sinks.write_results(rows, path)
    return st.read_exporter_csv(t.spark, path, "a")


@query("read_address_dims", "SELECT '0xc' || lpad(CAST(p_partkey % 100 AS STRING),39,'0') AS address, max_by(p_name, p_partkey) AS label FROM part GROUP BY p_partkey % 100")
def _(t):
    path = scratch_folder(t.spark, "dims")
    key = F.concat(F.lit("0xC"), F.lpad((F.col("p_partkey") % 100).cast("string"), 39, "0"))
    sinks.write_results(t.part().select(key.alias("address"), F.concat(F.lit(" "), "p_name").alias("label"), F.col("p_partkey").alias("row_no")), path)
    return st.read_address_dims(t.spark, path, order="row_no")


_CALLS = f"""calls AS (
  SELECT f.transaction_hash, f.trace_address, f.from_address AS source, f.to_address AS target, upper(coalesce(f.call_type, f.trace_type)) AS type
  FROM traces f JOIN traces m ON f.transaction_hash = m.transaction_hash AND m.from_address = '{TARGET}'
    AND (m.trace_address = '' OR f.trace_address = m.trace_address OR starts_with(f.trace_address, m.trace_address || ','))
  WHERE f.to_address IS NOT NULL AND f.transaction_hash IN (SELECT transaction_hash FROM traces WHERE from_address = '{TARGET}' AND trace_type = 'call')),
 typed AS (SELECT source, target, type, {COUNT} AS n FROM calls GROUP BY source, target, type),
 pairs AS (SELECT source, target, string_agg(type || '=' || n, ', ' ORDER BY type) AS types, CAST(sum(n) AS BIGINT) AS n FROM typed GROUP BY source, target)"""
_G = f"WITH {_CALLS} "


def flat(edges: DataFrame) -> DataFrame:
    """Edges with their types as text."""
    one = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return edges.withColumn("types", F.array_join(F.transform(F.array_sort(F.map_entries("types")), one), ", "))


_JSON = """, doc AS (SELECT source, target, '{"types":{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '},"source":"' || source || '","target":"' || target || '"}' AS e FROM typed GROUP BY source, target)"""


@query("edges_to_node_link", f"""{_G}{_JSON} SELECT '{{"directed":true,"multigraph":false,"graph":{{}},"nodes":[' || coalesce((SELECT string_agg('{{"id":"' || node || '"}}', ',' ORDER BY node)
  FROM (SELECT source AS node FROM pairs UNION SELECT target FROM pairs)), '') || '],"edges":[' || coalesce((SELECT string_agg(e, ',' ORDER BY source, target) FROM doc), '') || ']}}' AS document""")
def _(t):
    return sinks.edges_to_node_link(t.edges())


@query("node_link_pieces", f"""{_G}{_JSON}, nodes AS (SELECT node, min(node) OVER () AS first FROM (SELECT source AS node FROM pairs UNION SELECT target FROM pairs)), edges AS (SELECT *, row_number() OVER (ORDER BY source, target) AS r FROM doc)
  SELECT CAST(1 AS INTEGER) AS section, node AS a, NULL::VARCHAR AS b, CASE WHEN node = first THEN '' ELSE ',' END || '{{"id":"' || node || '"}}' AS piece FROM nodes UNION ALL SELECT 3, source, target, CASE WHEN r = 1 THEN '' ELSE ',' END || e FROM edges
  UNION ALL SELECT 0, NULL, NULL, '{{"directed":true,"multigraph":false,"graph":{{}},"nodes":[' UNION ALL SELECT 2, NULL, NULL, '],"edges":[' UNION ALL SELECT 4, NULL, NULL, ']}}'""")
def _(t):
    return sinks.node_link_pieces(t.edges())


@query("edges_to_json_lines", f"""{_G}{_JSON} SELECT 'edge' AS kind, e AS line FROM doc UNION ALL SELECT 'node', '{{"id":"' || node || '"}}' FROM (SELECT source AS node FROM pairs UNION SELECT target FROM pairs)""")
def _(t):
    return sinks.edges_to_json_lines(t.edges())


@query("edges_to_dot", _G + """SELECT 1 AS line_no, '  "' || source || '" -> "' || target || '" [label="' || types || '"];' AS line FROM pairs UNION ALL SELECT 0, 'digraph {' UNION ALL SELECT 2, '}'""")
def _(t):
    return sinks.edges_to_dot(t.edges())


@query("write_results", f"SELECT CAST({YEAR} AS STRING) AS year, CAST(count(*) AS STRING) AS create_trace_count FROM traces WHERE {OK_CREATE} GROUP BY year(block_timestamp)")
def _(t):
    path = scratch_folder(t.spark, "results")
    sinks.write_results(ol.create_by_year(t.events), path)
    return t.spark.read.csv(path, header=True)


# ---- filters and scalar functions ----


@query("normalize_address", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN '0xc' || lpad(CAST(p_partkey AS STRING),39,'0') END AS address FROM part")
def _(t):
    hexed = F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 39, "0"))
    raw = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("0x12"), hexed)).when(F.col("p_partkey") % 2 == 0, hexed).otherwise(F.concat(F.lit(" 0x"), hexed))
    return t.part().select("p_partkey", sc.normalize_address(raw).alias("address"))


@query("parse_block", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS BIGINT) END AS block FROM part")
def _(t):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.lit("latest")).when(k % 2 == 0, F.concat(F.lit("0x"), F.hex(k))).otherwise(k.cast("string"))
    return t.part().select("p_partkey", sc.parse_block(raw).alias("block"))


@query("filter_block_range", _ALL + " WHERE block_number BETWEEN 5000 AND 6000")
def _(t):
    return ot.filter_block_range(t.traces, 5000, 6000, ot.MAX_BLOCKS)


@query("last_n_blocks", _ALL + " WHERE block_number >= (SELECT max(block_number) FROM traces) - 10")
def _(t):
    return ot.last_n_blocks(t.traces)


@query("filter_traces", _ALL + " WHERE trace_type = 'call' AND status = 1 AND from_address IS NOT NULL AND to_address IS NOT NULL")
def _(t):
    return ot.filter_traces(t.traces, "calls", from_not_null=True, to_not_null=True)


@query("filter_from_list", _ALL + " WHERE from_address IN (SELECT address FROM listed) AND block_number > 5000", "listed")
def _(t):
    return ot.filter_from_list(t.traces, t.listed, after_block=5000)


@query("drop_precompile_and_self", _ALL + " WHERE to_address <> '0x' || lpad('1', 40, '0') AND to_address <> from_address")
def _(t):
    return ot.drop_precompile_and_self(t.traces)


@query("filter_contract_endpoints", _ALL + " WHERE to_address IN (SELECT address FROM code WHERE code <> '0x') AND from_address IN (SELECT address FROM code WHERE code <> '0x')", "code")
def _(t):
    return ot.filter_contract_endpoints(t.traces, t.code)


@query("search_edges", _G + "SELECT source, target, types FROM pairs WHERE contains(source, '0031') OR contains(target, '0031')")
def _(t):
    return flat(og.search_edges(t.edges(), " 0031 ")).select("source", "target", "types")


@query("short_address", "SELECT DISTINCT to_address AS address, substr(to_address, 1, 4) || '...' || right(to_address, 4) AS short FROM traces WHERE to_address IS NOT NULL")
def _(t):
    return t.traces.filter("to_address is not null").select(F.col("to_address").alias("address"), sc.short_address(F.col("to_address")).alias("short")).distinct()


@query("log_weight", f"SELECT from_address, to_address, round(ln(1 + {COUNT}), 6) AS log_weight FROM traces WHERE to_address IS NOT NULL GROUP BY from_address, to_address")
def _(t):
    per = t.traces.filter("to_address is not null").groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias("n"))
    return per.select("from_address", "to_address", F.round(sc.log_weight(F.col("n")), 6).alias("log_weight"))


@query("hybrid_scale", "SELECT p_partkey, round(CASE WHEN p_partkey <= 5 THEN p_partkey ELSE 5 + log10(p_partkey - 5 + 1) END, 6) AS scaled, round(CAST(p_partkey AS DOUBLE), 6) AS back FROM part")
def _(t):
    s = sc.hybrid_scale(F.col("p_partkey"))
    return t.part().select("p_partkey", F.round(s, 6).alias("scaled"), F.round(sc.hybrid_scale_inverse(s), 6).alias("back"))


@query("abbreviate_number", "SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.2f', n / 1000000000.0) || 'b' WHEN n >= 1000000 THEN printf('%.2f', n / 1000000.0) || 'm' WHEN n >= 1000 THEN printf('%.2f', n / 1000.0) || 'k' ELSE CAST(n AS STRING) END AS short FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 512 ELSE o_orderkey * 524288 END AS n FROM orders)")
def _(t):
    k = F.col("o_orderkey")
    n = F.when(k % 3 == 0, k % 1000).when(k % 3 == 1, k * 512).otherwise(k * 524288)
    return t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select("o_orderkey", sc.abbreviate_number(n).alias("short"))


@query("activity_level", f"SELECT to_address, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN n < 10 THEN 'minimal' WHEN n < 100 THEN 'moderate' WHEN n < 1000 THEN 'high' ELSE 'significant' END AS activity FROM (SELECT to_address, {COUNT} AS n FROM traces WHERE to_address IS NOT NULL GROUP BY to_address)")
def _(t):
    per = t.traces.filter("to_address is not null").groupBy("to_address").agg(F.count(F.lit(1)).alias("n"))
    return per.select("to_address", sc.activity_level(F.col("n")).alias("activity"))


@query("year_of", f"SELECT {YEAR} AS year, CAST(date_trunc('year', block_timestamp) AS TIMESTAMP) AS start, {COUNT} AS n FROM traces GROUP BY 1, 2")
def _(t):
    ts = F.col("block_timestamp")
    return t.traces.groupBy(sc.year_of(ts).alias("year"), F.date_trunc("year", ts).alias("start")).agg(F.count(F.lit(1)).alias("n"))


# ---- call graph ----


@query("caller_transactions", f"SELECT DISTINCT '{TARGET}' AS contract, transaction_hash FROM traces WHERE from_address = '{TARGET}' AND trace_type = 'call'")
def _(t):
    return og.caller_transactions(t.traces, t.one())


@query("extract_calls", _G + f"SELECT '{TARGET}' AS contract, transaction_hash, trace_address, source, target, type, {COUNT} AS times FROM calls GROUP BY transaction_hash, trace_address, source, target, type")
def _(t):
    return og.extract_calls(t.traces, t.one())


@query("call_edges", _G + "SELECT source, target, types FROM pairs")
def _(t):
    return flat(t.edges())


_NODES = _G + ", nodes AS (SELECT source AS node FROM pairs UNION SELECT target FROM pairs) "


@query("graph_nodes", _NODES + "SELECT node FROM nodes")
def _(t):
    return og.graph_nodes(t.edges())


@query("dependencies", _NODES + f"SELECT node FROM nodes WHERE node <> '{TARGET}'")
def _(t):
    return og.dependencies(t.edges(), TARGET)


@query("callees", _G + f"SELECT DISTINCT target AS node FROM pairs WHERE source = '{TARGET}'")
def _(t):
    return og.callees(t.edges(), TARGET)


@query("callers", _G + f"SELECT DISTINCT source AS node FROM pairs WHERE target = '{TARGET}'")
def _(t):
    return og.callers(t.edges(), TARGET)


_LISTED = _CALLS.replace(f"m.from_address = '{TARGET}'", "m.from_address IN (SELECT address FROM listed)").replace(
    f"f.transaction_hash IN (SELECT transaction_hash FROM traces WHERE from_address = '{TARGET}' AND trace_type = 'call')",
    "EXISTS (SELECT 1 FROM traces x WHERE x.transaction_hash = f.transaction_hash AND x.from_address = m.from_address AND x.trace_type = 'call')",
).replace("SELECT f.transaction_hash, f.trace_address, f.from_address AS source", "SELECT m.from_address AS contract, f.from_address AS source")
_LISTED = _LISTED.replace("WHERE f.to_address IS NOT NULL", f"WHERE f.block_number BETWEEN {FIRST} AND {LAST} AND f.to_address IN (SELECT address FROM code WHERE code <> '0x') AND f.from_address IN (SELECT address FROM code WHERE code <> '0x') AND m.from_address IN (SELECT address FROM code WHERE code <> '0x')")
_LISTED = _LISTED.split(",\n typed AS")[0]


@query("network_document", f"""WITH {_LISTED},
 typed AS (SELECT contract, source, target, type, {COUNT} AS n FROM calls GROUP BY contract, source, target, type),
 pairs AS (SELECT contract, source, target, string_agg(type || '=' || n, ', ' ORDER BY type) AS types FROM typed GROUP BY contract, source, target),
 nodes AS (SELECT contract, source AS node FROM pairs UNION SELECT contract, target FROM pairs),
 named AS (SELECT n.contract, n.node, coalesce(l.label, f.label, n.node) AS label FROM nodes n LEFT JOIN labels l ON n.node = l.address LEFT JOIN fetched f ON n.node = f.address),
 a AS (SELECT contract, {COUNT} AS n_nodes, string_agg(node || ':' || label, ';' ORDER BY node) AS nodes FROM named GROUP BY contract),
 b AS (SELECT contract, string_agg(source || '>' || target || ' ' || types, ';' ORDER BY source, target) AS edges FROM pairs GROUP BY contract)
 SELECT a.contract AS address, CAST({FIRST} AS BIGINT) AS from_block, CAST({LAST} AS BIGINT) AS to_block, n_nodes, nodes, edges FROM a JOIN b ON a.contract = b.contract""", "listed", "code", "labels", "fetched")
def _(t):
    d = network_documents(t.traces, t.listed.select(F.col("address").alias("contract")), t.code, t.labels, t.fetched, FIRST, LAST, limit=None)
    nodes = F.array_join(F.transform(F.array_sort(F.map_entries("nodes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    types = lambda x: F.array_join(F.transform(x, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(" "), types(e["types"]))), ";")
    return d.withColumns({"nodes": nodes, "edges": edges})


@query("network_pieces", f"""WITH {_LISTED},
 typed AS (SELECT contract, source, target, type, {COUNT} AS n FROM calls GROUP BY contract, source, target, type),
 pairs AS (SELECT contract, source, target, '{{"types":{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}},"source":"' || source || '","target":"' || target || '"}}' AS e, row_number() OVER (PARTITION BY contract ORDER BY source, target) AS r FROM typed GROUP BY contract, source, target),
 nodes AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY node) AS r FROM (SELECT contract, source AS node FROM pairs UNION SELECT contract, target FROM pairs)),
 named AS (SELECT n.contract, n.node, n.r, coalesce(l.label, f.label, n.node) AS label FROM nodes n LEFT JOIN labels l ON n.node = l.address LEFT JOIN fetched f ON n.node = f.address),
 heads AS (SELECT contract, count(*) AS n FROM named GROUP BY contract)
 SELECT contract, CAST(0 AS INTEGER) AS section, NULL::VARCHAR AS a, NULL::VARCHAR AS b, '{{"address":"' || contract || '","from_block":{FIRST},"to_block":{LAST},"n_nodes":' || n || ',"nodes":{{' AS piece FROM heads
 UNION ALL SELECT contract, 1, node, NULL, CASE WHEN r = 1 THEN '' ELSE ',' END || '"' || node || '":"' || label || '"' FROM named UNION ALL SELECT contract, 2, NULL, NULL, '}},"edges":[' FROM heads
 UNION ALL SELECT contract, 3, source, target, CASE WHEN r = 1 THEN '' ELSE ',' END || e FROM pairs UNION ALL SELECT contract, 4, NULL, NULL, ']}}' || chr(10) FROM heads""", "listed", "code", "labels", "fetched")
def _(t):
    return network_pieces(t.traces, t.listed.select(F.col("address").alias("contract")), t.code, t.labels, t.fetched, FIRST, LAST, limit=None)


_CLASSED = _G + f", classed AS (SELECT p.source, p.target, p.types, p.n, CASE WHEN p.source = '{TARGET}' THEN 'Direct' ELSE 'Indirect' END AS interaction_type, a.label AS source_name, b.label AS target_name FROM pairs p LEFT JOIN labels a ON p.source = a.address LEFT JOIN labels b ON p.target = b.address) "


def classed(t):
    return og.classify_edges(t.edges(), TARGET, t.labels)


@query("classify_edges", _CLASSED + "SELECT source, target, types, interaction_type, source_name, target_name FROM classed", "labels")
def _(t):
    return flat(classed(t))


@query("direct_only", _CLASSED + "SELECT source, target, types, interaction_type, source_name, target_name FROM classed WHERE interaction_type = 'Direct'", "labels")
def _(t):
    return flat(og.direct_only(classed(t)))


@query("edge_types_long", _G + "SELECT source, target, type, n FROM typed")
def _(t):
    return og.edge_types_long(t.edges())


_WIDE = ["CALL", "DELEGATECALL", "STATICCALL", "CALLCODE"]


@query("edge_types_wide", _G + "SELECT source, target, " + ", ".join(f'CAST(coalesce(sum(n) FILTER (type = \'{k}\'), 0) AS BIGINT) AS "{k}"' for k in _WIDE) + " FROM typed GROUP BY source, target")
def _(t):
    return og.edge_types_wide(t.edges(), _WIDE)


@query("sort_edges", _CLASSED + "SELECT source, target, interaction_type, CAST(row_number() OVER (ORDER BY CASE WHEN interaction_type = 'Direct' THEN 0 ELSE 1 END, CASE WHEN interaction_type = 'Direct' THEN target ELSE source || target END, source, target) AS INTEGER) AS position FROM classed", "labels")
def _(t):
    return og.sort_edges(classed(t)).select("source", "target", "interaction_type", "position")


@query("node_groups", _NODES + f"SELECT node, CASE WHEN node = '{TARGET}' THEN 'main' ELSE 'other' END AS node_group FROM nodes")
def _(t):
    return og.node_groups(t.edges(), TARGET)


@query("incident_edges", _G + f"SELECT source, target, types FROM pairs WHERE source = '{TARGET}' OR target = '{TARGET}'")
def _(t):
    return flat(og.incident_edges(t.edges(), TARGET.upper().replace("0X", "0x")))


@query("direct_summary", _CLASSED + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS interactions, CAST(count(*) AS BIGINT) AS direct_dependencies, CASE WHEN coalesce(sum(n), 0) = 0 THEN 'none' WHEN sum(n) = 1 THEN 'single' WHEN sum(n) < 10 THEN 'minimal' WHEN sum(n) < 100 THEN 'moderate' WHEN sum(n) < 1000 THEN 'high' ELSE 'significant' END AS activity FROM classed WHERE interaction_type = 'Direct'", "labels")
def _(t):
    return og.direct_summary(og.direct_only(classed(t)))


_RANKED = _CLASSED + ", ranked AS (SELECT target, n, row_number() OVER (ORDER BY n DESC, target) AS r, sum(n) OVER (ORDER BY n DESC, target ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, sum(n) OVER () AS whole FROM classed WHERE interaction_type = 'Direct') "


@query("top10_ratio", _RANKED + "SELECT CAST(floor(100.0 * sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / max(whole) + 0.5) AS BIGINT) AS top10_ratio FROM ranked", "labels")
def _(t):
    return og.top10_ratio(og.direct_only(classed(t)))


@query("half_interactions_count", _RANKED + "SELECT CAST(min(r) AS INTEGER) AS half_count FROM ranked WHERE running >= 0.5 * whole", "labels")
def _(t):
    return og.half_interactions_count(og.direct_only(classed(t)))


_PER = f"per AS (SELECT from_address, to_address, {COUNT} AS call_count FROM traces WHERE {OK_CALL} AND from_address IN (SELECT address FROM listed) GROUP BY from_address, to_address)"
_UND = f"""WITH {_PER},
 und AS (SELECT least(from_address, to_address) AS u, greatest(from_address, to_address) AS v, max_by(call_count, from_address || to_address) AS weight FROM per GROUP BY 1, 2),
 kept AS (SELECT * FROM und WHERE NOT starts_with(u, '0x' || repeat('0', 39)) AND NOT starts_with(v, '0x' || repeat('0', 39))),
 nodes AS (SELECT u AS node FROM kept UNION SELECT v FROM kept)"""


def undirected(t):
    pairs = oc.interactions(t.traces, t.listed).withColumn("row_no", F.concat("from_address", "to_address"))
    return og.drop_prefixed_nodes(og.undirected_graph(pairs, "row_no"))


@query("undirected_graph", _UND + " SELECT u, v, weight, round(ln(1 + weight), 6) AS log_weight FROM und", "listed")
def _(t):
    pairs = oc.interactions(t.traces, t.listed).withColumn("row_no", F.concat("from_address", "to_address"))
    return og.undirected_graph(pairs, "row_no").withColumn("log_weight", F.round("log_weight", 6))


@query("drop_prefixed_nodes", _UND + " SELECT u, v, weight FROM kept", "listed")
def _(t):
    return undirected(t).drop("log_weight")


_FLAG = "flagged AS (SELECT node, CASE WHEN node IN (SELECT address FROM annotations WHERE documented) THEN 1 WHEN node IN (SELECT address FROM contracts) THEN 2 ELSE 0 END AS color_group FROM nodes)"


def flagged(t):
    return og.color_groups_flagged(og.undirected_nodes(undirected(t)), t.annotations.filter("documented"), t.contracts)


@query("color_groups_flagged", f"{_UND}, {_FLAG} SELECT node, CAST(color_group AS INTEGER) AS color_group FROM flagged", "listed", "annotations", "contracts")
def _(t):
    return flagged(t)


@query("color_groups_tagged", f"{_UND} SELECT n.node, CAST(CASE WHEN n.node IN (SELECT address FROM labels) THEN 1 WHEN a.category = 'Lido' THEN 2 WHEN a.category = 'External' THEN 0 ELSE 3 END AS INTEGER) AS color_group FROM nodes n LEFT JOIN annotations a ON n.node = a.address", "listed", "annotations", "labels")
def _(t):
    return og.color_groups_tagged(og.undirected_nodes(undirected(t)), t.labels, t.annotations)


_SHORT = "substr({0}, 1, 4) || '...' || right({0}, 4)"
_NAMED = f"named AS (SELECT n.node, coalesce(l.label, {_SHORT.format('n.node')}) || CASE WHEN a.verified THEN ' ✓' ELSE ' ✗' END AS name FROM nodes n LEFT JOIN labels l ON n.node = l.address LEFT JOIN annotations a ON n.node = a.address)"


def named(t):
    return og.display_names(og.undirected_nodes(undirected(t)), t.labels, t.annotations)


@query("color_groups_named", f"{_UND}, {_NAMED} SELECT DISTINCT name, CAST(CASE WHEN starts_with(name, '0x') THEN 0 ELSE 1 END AS INTEGER) AS color_group FROM named", "listed", "labels", "annotations")
def _(t):
    return og.color_groups_named(named(t))


@query("node_statistics", f"{_UND}, {_FLAG} SELECT CAST(color_group AS INTEGER) AS color_group, {COUNT} AS nodes, CAST(count(*) FILTER (NOT coalesce(a.verified, false)) AS BIGINT) AS unverified, CAST(sum(count(*)) OVER () AS BIGINT) AS all_nodes FROM flagged f LEFT JOIN annotations a ON f.node = a.address GROUP BY color_group", "listed", "annotations", "contracts")
def _(t):
    return og.node_statistics(flagged(t), t.annotations)


@query("relabel_nodes", f"{_UND}, {_NAMED} SELECT least(a.name, b.name) AS u, greatest(a.name, b.name) AS v, CAST(arg_max(weight, k.u || k.v) AS BIGINT) AS weight FROM kept k JOIN named a ON k.u = a.node JOIN named b ON k.v = b.node GROUP BY 1, 2", "listed", "labels", "annotations")
def _(t):
    return og.relabel_nodes(undirected(t), named(t)).drop("log_weight")


@query("tagged_names", f"{_UND} SELECT n.node, coalesce(a.name_tag, l.label, {_SHORT.format('n.node')}) AS name FROM nodes n LEFT JOIN (SELECT * FROM annotations WHERE category IS NOT NULL) a ON n.node = a.address LEFT JOIN labels l ON n.node = l.address", "listed", "labels", "annotations")
def _(t):
    return og.tagged_names(og.undirected_nodes(undirected(t)), t.annotations.filter("category is not null"), t.labels)


# ---- warehouse queries ----


@query("create_by_year", f"SELECT {YEAR} AS year, {COUNT} AS create_trace_count FROM traces WHERE {OK_CREATE} GROUP BY 1")
def _(t):
    return ol.create_by_year(t.events)


@query("destruct_by_year", f"SELECT {YEAR} AS year, {COUNT} AS destruct_trace_count FROM traces WHERE status = 1 AND trace_type = 'suicide' GROUP BY 1")
def _(t):
    return ol.destruct_by_year(t.events)


_YEARLY = f"yearly AS (SELECT {YEAR} AS year, CAST(count(DISTINCT to_address) AS BIGINT) AS nodes_count, {COUNT} AS edges_count, CAST(count(call_type) AS BIGINT) AS distinct_call_types, " + ", ".join(f"CAST(count(*) FILTER (call_type = '{k}') AS BIGINT) AS call_count_{k}" for k in ("call", "delegatecall", "staticcall", "callcode")) + f" FROM traces WHERE {OK_CALL} AND to_address IS NOT NULL AND from_address IS NOT NULL GROUP BY 1)"


@query("call_types_by_year", f"WITH {_YEARLY} SELECT * FROM yearly")
def _(t):
    return ol.call_types_by_year(t.traces)


@query("creations_last", f"SELECT to_address AS address, max(block_number) AS created_block, max(block_timestamp) AS created_time FROM traces WHERE {OK_CREATE} GROUP BY 1")
def _(t):
    return ol.creations_last(t.events)


@query("suicides_last", "SELECT from_address AS address, max(block_number) AS destroyed_block FROM traces WHERE status = 1 AND trace_type = 'suicide' GROUP BY 1")
def _(t):
    return ol.suicides_last(t.events)


@query("event_table", _ALL + " WHERE status = 1 AND trace_type IN ('create', 'create2', 'suicide')")
def _(t):
    """Kept up beside stored traces: taken in by bucket, the last one read from the traces."""
    traces, events = scratch_folder(t.spark, "traces"), scratch_folder(t.spark, "events")
    st.write_traces(t.traces, traces)
    se.refresh_events(t.spark, traces, events)
    return se.read_events(t.spark, traces, events).drop("year", "bucket").na.fill({"trace_address": ""})


_EVENT = f"((status = 1 AND trace_type = 'suicide') OR ({OK_CREATE}))"
_BY_YEAR = f"""years AS (SELECT DISTINCT {YEAR} AS year FROM traces WHERE {_EVENT}),
 cr AS (SELECT y.year, to_address AS address, max(block_number) AS c FROM years y JOIN traces ON year(block_timestamp) <= y.year WHERE {OK_CREATE} GROUP BY 1, 2),
 su AS (SELECT y.year, from_address AS address, max(block_number) AS d FROM years y JOIN traces ON year(block_timestamp) <= y.year WHERE status = 1 AND trace_type = 'suicide' GROUP BY 1, 2),
 al AS (SELECT y.year, CAST(count(x.address) AS BIGINT) AS n_alive_contracts FROM years y LEFT JOIN (SELECT cr.year, cr.address FROM cr LEFT JOIN su ON cr.year = su.year AND cr.address = su.address WHERE d IS NULL OR c > d) x ON x.year = y.year GROUP BY 1)"""


@query("alive_by_year", f"WITH {_BY_YEAR} SELECT * FROM al")
def _(t):
    return ol.alive_by_year(t.events)


def _alive(by: str = "") -> str:
    return f"""cb AS (SELECT {by} to_address AS address, max(block_number) AS created_block, max(block_timestamp) AS created_time FROM traces WHERE {OK_CREATE} AND block_number < {FORK} GROUP BY {by} to_address),
 sb AS (SELECT from_address AS address, max(block_number) AS d FROM traces WHERE status = 1 AND trace_type = 'suicide' AND block_number < {FORK} GROUP BY 1),
 ca AS (SELECT DISTINCT {by} to_address AS address, block_number AS created_block, block_timestamp AS created_time, transaction_hash FROM traces WHERE {OK_CREATE} AND block_number >= {FORK}),
 sa AS (SELECT DISTINCT from_address AS address, transaction_hash FROM traces WHERE status = 1 AND trace_type = 'suicide' AND block_number >= {FORK}),
 alive AS (SELECT {by} address, created_block, created_time FROM cb WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.address = cb.address AND d >= created_block)
  UNION ALL SELECT {by} address, created_block, created_time FROM ca WHERE NOT EXISTS (SELECT 1 FROM sa WHERE sa.address = ca.address AND sa.transaction_hash = ca.transaction_hash))"""


@query("alive_2024", f"WITH {_alive()} SELECT * FROM alive")
def _(t):
    return ol.alive_at(t.events, FORK)


@query("lifecycle_by_year", f"WITH {_BY_YEAR}, a AS (SELECT {YEAR} AS year, CAST(count(*) FILTER ({OK_CREATE}) AS BIGINT) AS create_trace_count, CAST(count(*) FILTER (trace_type = 'suicide' AND status = 1) AS BIGINT) AS destruct_trace_count FROM traces WHERE {_EVENT} GROUP BY 1) SELECT a.*, al.n_alive_contracts FROM a JOIN al ON a.year = al.year")
def _(t):
    return ol.lifecycle_by_year(t.events)


_C2C = f"c2c AS (SELECT {YEAR} AS year, transaction_hash, from_address, to_address FROM traces WHERE {OK_CALL} AND from_address IN (SELECT address FROM contracts) AND to_address IN (SELECT address FROM contracts))"
_HIST = f"{_C2C}, hist AS (SELECT year, addresses_called, {COUNT} AS frequency FROM (SELECT year, transaction_hash, CAST(count(DISTINCT address) AS BIGINT) AS addresses_called FROM (SELECT year, transaction_hash, from_address AS address FROM c2c UNION ALL SELECT year, transaction_hash, to_address FROM c2c) GROUP BY 1, 2) GROUP BY 1, 2)"


@query("contract_to_contract_calls", f"WITH {_C2C} SELECT * FROM c2c WHERE year = 1996", "contracts")
def _(t):
    return oc.contract_to_contract_calls(t.traces, t.contracts, 1996)


@query("contracts_per_tx", f"WITH {_HIST} SELECT * FROM hist WHERE year = 1996", "contracts")
def _(t):
    return oc.contracts_per_tx(t.traces, t.contracts, 1996)


@query("tx_histogram_all_years", f"WITH {_HIST} SELECT * FROM hist", "contracts")
def _(t):
    return oc.contracts_per_tx(t.traces, t.contracts)


_IDS = "ids AS (SELECT address, CAST(row_number() OVER (ORDER BY address) - 1 AS BIGINT) AS id FROM (SELECT from_address AS address FROM traces UNION SELECT to_address FROM traces) WHERE address IS NOT NULL)"


@query("address_dictionary", f"WITH {_IDS} SELECT * FROM ids")
def _(t):
    return oa.address_dictionary(t.traces)


@query("traces_with_ids", f"WITH {_IDS} SELECT transaction_hash, trace_address, trace_type, a.id AS from_id, b.id AS to_id FROM traces LEFT JOIN ids a ON from_address = a.address LEFT JOIN ids b ON to_address = b.address")
def _(t):
    return oa.with_ids(t.traces, oa.address_dictionary(t.traces)).select("transaction_hash", "trace_address", "trace_type", "from_id", "to_id")


@query("contracts_per_tx_by_id", f"WITH {_HIST} SELECT * FROM hist", "contracts")
def _(t):
    dictionary = oa.address_dictionary(t.traces)
    bits = oa.id_bits(oa.ids_of(t.contracts, dictionary))
    return oa.contracts_per_tx_by_id(oa.with_ids(t.traces, dictionary), bits)


@query("weighted_percentiles", f"""WITH {_HIST},
 w AS (SELECT *, sum(frequency) OVER (PARTITION BY year ORDER BY addresses_called) AS upto, sum(frequency) OVER (PARTITION BY year) AS whole FROM hist),
 l AS (SELECT *, lag(addresses_called) OVER (PARTITION BY year ORDER BY addresses_called) AS x0, lag(upto) OVER (PARTITION BY year ORDER BY addresses_called) AS u0 FROM w),
 q AS (SELECT year, p, max(CASE WHEN u0 IS NULL THEN addresses_called::DOUBLE ELSE x0 + (p * whole - u0) / (upto - u0) * (addresses_called - x0) END) AS v FROM l, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(p) WHERE upto >= p * whole AND (u0 IS NULL OR u0 < p * whole) GROUP BY 1, 2),
 m AS (SELECT year, round(max(v) FILTER (p = 0.25), 6) AS q1, round(max(v) FILTER (p = 0.5), 6) AS median, round(max(v) FILTER (p = 0.75), 6) AS q3 FROM q GROUP BY 1)
 SELECT h.year, min(addresses_called) AS min, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, max(addresses_called) AS max, CAST(sum(frequency) AS BIGINT) AS txs, CAST(round_even(any_value(median), 0) AS BIGINT) AS median_rounded FROM hist h JOIN m ON h.year = m.year GROUP BY h.year""", "contracts")
def _(t):
    return rs.weighted_percentiles(oc.contracts_per_tx(t.traces, t.contracts))


_TOPALIVE = f"WITH {_alive('from_address,')}, ranked AS (SELECT from_address, {COUNT} AS deployed_alive_contracts FROM alive GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000)"


@query("top_deployers_alive", _TOPALIVE + " SELECT * FROM ranked WHERE from_address NOT IN (SELECT address FROM contracts)", "contracts")
def _(t):
    return od.top_deployers_alive(t.events, t.contracts, FORK)


@query("top_deployers", f"WITH d AS (SELECT from_address AS address, {COUNT} AS deployments FROM traces WHERE {OK_CREATE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT d.*, label FROM d LEFT JOIN labels USING (address)", "labels")
def _(t):
    return od.top_deployers(t.events, t.labels, 50)


_CHAIN = f"""chain AS (SELECT from_address AS original_creator, to_address, 1 AS depth FROM traces WHERE {OK_CREATE}
  UNION ALL SELECT t.from_address, c.to_address, c.depth + 1 FROM traces t JOIN chain c ON t.to_address = c.original_creator WHERE t.status = 1 AND t.trace_type IN ('create','create2'))"""


@query("creation_lineage", f"WITH RECURSIVE {_CHAIN} SELECT original_creator, to_address, CAST(depth AS INTEGER) AS depth FROM chain")
def _(t):
    return od.creation_lineage(t.events)


@query("creation_lineage_by_block", f"WITH RECURSIVE chain AS (SELECT from_address AS original_creator, to_address, 1 AS depth, block_number AS first FROM traces WHERE {OK_CREATE} UNION ALL SELECT t.from_address, c.to_address, c.depth + 1, t.block_number FROM traces t JOIN chain c ON t.to_address = c.original_creator AND t.block_number <= c.first WHERE t.status = 1 AND t.trace_type IN ('create','create2')) SELECT original_creator, to_address, CAST(depth AS INTEGER) AS depth FROM chain")
def _(t):
    return od.creation_lineage(t.events, by_block=True)


_EOA = "eoa AS (SELECT * FROM chain WHERE original_creator NOT IN (SELECT address FROM contracts))"


@query("top_eoa_deployers", f"WITH RECURSIVE {_CHAIN}, {_EOA} SELECT original_creator, CAST(count(DISTINCT to_address) AS BIGINT) AS total_created_contracts, CAST(max(depth) AS INTEGER) AS max_depth FROM eoa GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "contracts")
def _(t):
    return od.top_eoa_deployers(od.creation_lineage(t.events), t.contracts)


@query("eoa_direct_indirect", f"WITH RECURSIVE {_CHAIN}, {_EOA}, {_alive()}, per AS (SELECT original_creator, to_address, min(depth) AS a, max(depth) AS b FROM eoa WHERE to_address IN (SELECT address FROM alive) GROUP BY 1, 2) SELECT original_creator, CAST(count(*) FILTER (a = 1) AS BIGINT) AS direct_create, CAST(count(*) FILTER (a > 1) AS BIGINT) AS indirect_create, {COUNT} AS total, CAST(max(b) AS INTEGER) AS max_depth FROM per GROUP BY 1", "contracts")
def _(t):
    return od.eoa_direct_indirect(od.creation_lineage(t.events), t.contracts, ol.alive_at(t.events, FORK))


_TOP10 = f"""tops AS (SELECT to_address, call_type, call_count FROM (SELECT *, row_number() OVER (PARTITION BY call_type ORDER BY call_count DESC, to_address) AS r FROM
  (SELECT to_address, call_type, {COUNT} AS call_count FROM traces WHERE {OK_CALL} AND to_address IS NOT NULL AND block_number BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2)) WHERE r <= 10)"""


@query("top10_callee", f"WITH {_TOP10} SELECT * FROM tops")
def _(t):
    return oc.top_callees(t.traces, FIRST, LAST)


@query("protocol_interactions", f"SELECT from_address, to_address, {COUNT} AS call_count FROM traces WHERE {OK_CALL} AND from_address IN (SELECT address FROM listed) AND block_number > {FIRST} GROUP BY 1, 2", "listed")
def _(t):
    return oc.interactions(t.traces, t.listed, FIRST)


@query("single_caller_interactions", f"SELECT from_address, to_address, {COUNT} AS call_count FROM traces WHERE {OK_CALL} AND from_address = '{TARGET}' AND block_number > {FIRST} GROUP BY 1, 2")
def _(t):
    return oc.interactions(t.traces, [TARGET], FIRST)


@query("fan_in_fan_out", f"""WITH i AS (SELECT to_address AS address, CAST(count(DISTINCT from_address) AS BIGINT) AS from_address_count FROM traces WHERE {OK_CALL} AND to_address IN (SELECT address FROM listed) GROUP BY 1),
 o AS (SELECT from_address AS address, CAST(count(DISTINCT to_address) AS BIGINT) AS to_address_count FROM traces WHERE {OK_CALL} AND from_address IN (SELECT address FROM listed) GROUP BY 1) SELECT * FROM i JOIN o USING (address)""", "listed")
def _(t):
    return oc.fan_in_fan_out(t.traces, t.listed)


_TOP5 = f"""top5 AS (SELECT from_address, to_address, call_count FROM (SELECT *, row_number() OVER (PARTITION BY from_address ORDER BY call_count DESC, to_address) AS r FROM
  (SELECT from_address, to_address, {COUNT} AS call_count FROM traces WHERE {OK_CALL} AND from_address IN (SELECT address FROM listed) AND to_address <> '0x' || lpad('1', 40, '0') AND to_address <> from_address GROUP BY 1, 2)) WHERE r <= 5)"""


@query("top5_calls_per_caller", f"WITH {_TOP5} SELECT * FROM top5", "listed")
def _(t):
    return oc.top_calls_per_caller(t.traces, t.listed)


@query("creators_of_callees", f"WITH {_TOP5} SELECT DISTINCT from_address, to_address FROM traces WHERE {OK_CREATE} AND from_address IN (SELECT address FROM creators) AND to_address IN (SELECT to_address FROM top5)", "listed", "creators")
def _(t):
    return oc.creators_of_callees(t.traces, t.listed, t.creators)


# ---- post-processing ----


@query("call_type_share", f"WITH {_YEARLY} SELECT year, " + ", ".join(f"round(100.0::DOUBLE * call_count_{k} / (call_count_call + call_count_staticcall + call_count_delegatecall), 6) AS {k}_share" for k in ("call", "staticcall", "delegatecall")) + " FROM yearly")
def _(t):
    return rs.call_type_share(ol.call_types_by_year(t.traces))


@query("deployer_pareto", _TOPALIVE + """, r AS (SELECT from_address AS address, deployed_alive_contracts AS alive, CAST(row_number() OVER (ORDER BY deployed_alive_contracts DESC, from_address) AS INTEGER) AS rank,
  CAST(sum(deployed_alive_contracts) OVER (ORDER BY deployed_alive_contracts DESC, from_address ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, CAST(sum(deployed_alive_contracts) OVER () AS BIGINT) AS whole FROM ranked)
 SELECT address, alive, rank, running, round(100.0::DOUBLE * running / whole, 6) AS running_share, starts_with(address, '0xe') AS is_eoa FROM r WHERE rank <= 100""")
def _(t):
    alive = ol.alive_at(t.events, FORK, None, "from_address")
    d = alive.groupBy(F.col("from_address").alias("address")).agg(F.count(F.lit(1)).alias("alive")).orderBy(F.desc("alive"), "address").limit(1000)
    eoas = t.traces.select(F.col("from_address").alias("address")).filter("address like '0xe%'")
    return rs.deployer_pareto(d, eoas)


_LINKS = f"{_TOP10}, links AS (SELECT call_type, coalesce(l.label, to_address, 'Unknown Callee') AS callee, call_count FROM tops LEFT JOIN labels l ON tops.to_address = l.address WHERE call_type <> 'callcode')"


def links(t):
    return rs.top_callee_links(oc.top_callees(t.traces, FIRST, LAST), t.labels)


@query("top_callee_links", f"WITH {_LINKS} SELECT * FROM links", "labels")
def _(t):
    return links(t)


_SANKEY = f"{_LINKS}, names AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS node_id, name FROM (SELECT call_type AS name FROM links UNION SELECT callee FROM links))"


@query("sankey_nodes", f"WITH {_SANKEY} SELECT * FROM names", "labels")
def _(t):
    return rs.sankey_nodes(links(t))


@query("sankey_links", f"WITH {_SANKEY} SELECT a.node_id AS source, b.node_id AS target, call_count FROM links JOIN names a ON call_type = a.name JOIN names b ON callee = b.name", "labels")
def _(t):
    return rs.sankey_links(links(t))


@query("top_callee_share", f"WITH {_TOP10}, w AS (SELECT call_type, {COUNT} AS all_calls FROM traces WHERE {OK_CALL} AND block_number BETWEEN {FIRST} AND {LAST} AND to_address IS NOT NULL GROUP BY 1) SELECT call_type, CAST(sum(call_count) AS BIGINT) AS top_calls, any_value(all_calls) AS all_calls, round(100.0::DOUBLE * sum(call_count) / any_value(all_calls), 6) AS top_share FROM tops JOIN w USING (call_type) GROUP BY 1")
def _(t):
    calls = ot.filter_traces(ot.filter_block_range(t.traces, FIRST, LAST), "calls", to_not_null=True)
    return rs.top_callee_share(oc.top_callees(t.traces, FIRST, LAST), calls.groupBy("call_type").agg(F.count(F.lit(1)).alias("all_calls")))


@query("unlabelled_addresses", f"SELECT DISTINCT to_address AS address FROM traces WHERE {OK_CALL} AND to_address IS NOT NULL AND to_address NOT IN (SELECT address FROM labels)", "labels")
def _(t):
    return rs.unlabelled_addresses(ot.filter_traces(t.traces, "calls", to_not_null=True).select(F.col("to_address").alias("address")), t.labels)


@query("attach_labels", _NODES + "SELECT n.node, coalesce(l.label, f.label, n.node) AS label FROM nodes n LEFT JOIN labels l ON n.node = l.address LEFT JOIN fetched f ON n.node = f.address", "labels", "fetched")
def _(t):
    return rs.attach_labels(og.graph_nodes(t.edges()), t.labels, t.fetched)


_UPSERT = "SELECT coalesce(s.address, n.address) AS address, coalesce(n.label, s.label) AS label, CASE WHEN s.address IS NULL THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2000-01-01' END AS date_added, CASE WHEN n.address IS NULL THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2001-01-01' END AS last_updated FROM labels s FULL JOIN (SELECT address, 'new ' || label AS label FROM fetched UNION ALL SELECT address, 'new ' || label FROM labels WHERE address LIKE '%6') n ON s.address = n.address"


@query("upsert_labels", _UPSERT, "labels", "fetched")
def _(t):
    old, new = F.to_timestamp(F.lit("2000-01-01")), F.to_timestamp(F.lit("2001-01-01"))
    stored = t.labels.withColumns({"date_added": old, "last_updated": old})
    fresh = t.fetched.union(t.labels.filter("address like '%6'")).select("address", F.concat(F.lit("new "), "label").alias("label"), new.alias("now"))
    return rs.upsert_labels(stored, fresh)


@query("stored_labels", _UPSERT, "labels", "fetched")
def _(t):
    """Two commits to a store, and what is read from it."""
    path = scratch_folder(t.spark, "labels")
    day = lambda df, year: df.withColumn("now", F.to_timestamp(F.lit(f"{year}-01-01")))
    fresh = t.fetched.union(t.labels.filter("address like '%6'")).select("address", F.concat(F.lit("new "), "label").alias("label"))
    sl.commit_labels(t.spark, path, day(t.labels, 2000))
    sl.commit_labels(t.spark, path, day(fresh, 2001))
    return sl.read_labels(t.spark, path)


@query("deployment_lookup", f"""WITH RECURSIVE {_CHAIN}, {_EOA},
 roots AS (SELECT to_address, original_creator AS deployer_eoa FROM (SELECT *, row_number() OVER (PARTITION BY to_address ORDER BY depth DESC, original_creator) AS r FROM eoa) WHERE r = 1),
 lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY to_address ORDER BY block_number DESC, transaction_hash DESC, from_address DESC) AS r FROM traces WHERE {OK_CREATE} AND to_address IN (SELECT address FROM listed)) WHERE r = 1)
 SELECT l.to_address AS address, l.from_address AS deployer, deployer_eoa, l.transaction_hash AS tx_hash, l.block_number FROM lastc l LEFT JOIN roots r ON l.to_address = r.to_address""", "contracts", "listed")
def _(t):
    return od.deployment_lookup(t.events, od.lineage_roots(od.creation_lineage(t.events), t.contracts), t.listed)


# ---- reconciliation ----


@query("trace_count", f"SELECT {COUNT} AS traces FROM traces WHERE block_number >= {FIRST} AND block_number < {LAST}")
def _(t):
    return rc.trace_count(t.traces, FIRST, LAST)


@query("trace_count_stored", f"SELECT {COUNT} AS traces FROM traces WHERE block_number >= {FIRST} AND block_number < {LAST}")
def _(t):
    path = scratch_folder(t.spark, "traces")
    st.write_traces(t.traces, path)
    return st.count_stored(t.spark, path, FIRST, LAST)


@query("trace_count_by_chunk", f"SELECT CAST(floor((block_number - {FIRST}) / 10) AS BIGINT) AS chunk, {COUNT} AS traces FROM traces WHERE block_number >= {FIRST} AND block_number < {LAST} GROUP BY 1")
def _(t):
    return rc.trace_count_by_chunk(t.traces, FIRST, LAST)


_DIFF = f"""a AS (SELECT from_address, to_address, {COUNT} AS n FROM traces GROUP BY 1, 2), b AS (SELECT from_address, to_address, {COUNT} AS n FROM source_b GROUP BY 1, 2),
 diff AS (SELECT coalesce(a.from_address, b.from_address) AS from_address, coalesce(a.to_address, b.to_address) AS to_address, coalesce(a.n, 0) AS count_1, coalesce(b.n, 0) AS count_2
  FROM a FULL JOIN b ON a.from_address = b.from_address AND a.to_address = b.to_address WHERE coalesce(a.n, 0) <> coalesce(b.n, 0))"""


@query("pair_count_diff", f"WITH {_DIFF} SELECT * FROM diff", "source_b")
def _(t):
    return rc.pair_count_diff(t.traces, t.source_b)


@query("differing_buckets", "WITH a AS (SELECT CAST(floor(block_number / 500) AS BIGINT) AS bucket, from_address, to_address, count(*) AS n FROM traces WHERE from_address IS NOT NULL AND to_address IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT CAST(floor(block_number / 500) AS BIGINT) AS bucket, from_address, to_address, count(*) AS n FROM source_b WHERE from_address IS NOT NULL AND to_address IS NOT NULL GROUP BY 1, 2, 3) SELECT DISTINCT bucket FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))", "source_b")
def _(t):
    return rc.differing_buckets(t.traces, t.source_b, 500)


@query("pair_count_diff_by_bucket", f"WITH {_DIFF} SELECT * FROM diff", "source_b")
def _(t):
    return rc.pair_count_diff_by_bucket(t.traces, t.source_b, 3)


@query("pair_count_diff_summary", f"WITH {_DIFF} SELECT {COUNT} AS pairs, CAST(sum(count_1) AS BIGINT) AS sum_1, CAST(sum(count_2) AS BIGINT) AS sum_2 FROM diff", "source_b")
def _(t):
    return rc.pair_count_diff_summary(t.traces, t.source_b)


@query("from_address_diff", "SELECT DISTINCT from_address FROM traces WHERE trace_type LIKE 'create%' AND from_address NOT IN (SELECT from_address FROM source_b)", "source_b")
def _(t):
    return rc.from_address_diff(t.traces, t.source_b)


@query("source_row_counts", f"SELECT 'a' AS source, {COUNT} AS row_count, CAST(count(DISTINCT from_address) AS BIGINT) AS from_count FROM traces UNION ALL SELECT 'b', {COUNT}, CAST(count(DISTINCT from_address) AS BIGINT) FROM source_b", "source_b")
def _(t):
    return rc.source_row_counts(t.traces, t.source_b)
