"""Small hand-made cases of the operators; the whole queries are held against SQL in test_catalog."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from callweave.functions import scalars as sc
from callweave.operators import addresses, deployers, graph, lifecycle, reconcile, results, traces as ot
from callweave.plans import network, testview
from callweave.sources import events, labels, sinks
from callweave.sources import traces as st
from callweave.storage import document_parts, numbered, read_document, scratch_folder

T = "block_number long, block_timestamp timestamp, transaction_hash string, trace_address string, trace_type string, call_type string, from_address string, to_address string, status int"


def rows(spark, *items):
    """(block, tx, place, type, from, to[, status]) -> traces."""
    return spark.createDataFrame([(b, None, tx, p, t, t if t == "call" else None, a, z, *(rest or (1,))) for b, tx, p, t, a, z, *rest in items], T).withColumn("block_timestamp", F.expr("timestamp'2020-01-01' + make_dt_interval(block_number)"))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([("C",)], "contract string")


def test_nested_calls_count_once_per_frame_above(spark, one):
    t = rows(spark, (1, "t", "", "call", "c", "a"), (1, "t", "0", "call", "a", "c"), (1, "t", "0,0", "call", "c", "b"), (1, "t", "1", "call", "x", None), (1, "u", "", "call", "x", "y"))
    calls = graph.extract_calls(t, one)
    assert got(calls, "source", "target", "times") == [("a", "c", 1), ("c", "a", 1), ("c", "b", 2)]
    assert got(graph.extract_calls(t, one, dedup=True), "target", "times") == [("a", 1), ("b", 1), ("c", 1)]
    assert {(r.source, r.target): r.types for r in graph.call_edges(calls).collect()} == {("a", "c"): {"CALL": 1}, ("c", "a"): {"CALL": 1}, ("c", "b"): {"CALL": 2}}


def test_flatten_call_trees(spark):
    doc = '{"from":"0x1","to":"0x2","type":"call","calls":[{"from":"0x2","to":"0x3","type":"call","calls":[{"from":"0x3","to":null,"type":"create"}]},{"from":"0x2","to":"0x4","type":"call"}]}'
    deep = '{"from":"a","to":"b","type":"call","calls":[' * 400 + '{"from":"a","to":"b","type":"call"}' + "]}" * 400
    df = spark.createDataFrame([("t", doc), ("d", deep), ("n", None)], "transaction_hash string, trace_json string")
    out = st.flatten_call_trees(df).collect()
    assert [(r.trace_address, r.depth, r.to_address) for r in out if r.transaction_hash == "t"] == [("", 0, "0x2"), ("0", 1, "0x3"), ("0,0", 2, None), ("1", 1, "0x4")]
    assert max(r.depth for r in out) == 400


def test_survival_rules(spark):
    t = rows(
        spark,
        (1, "a", "0", "create", "e", "same"), (1, "b", "0", "suicide", "same", "e"),  # in the block of its creation
        (1, "c", "0", "create", "e", "again"), (2, "d", "0", "suicide", "again", "e"), (3, "f", "0", "create2", "e", "again"),
        (10, "g", "0", "create", "e", "brief"), (10, "g", "1", "suicide", "brief", "e"),  # in its own transaction
        (11, "h", "0", "create", "e", "stays"), (12, "i", "0", "suicide", "stays", "e"), (13, "j", "0", "create", "e", "failed", 0),
    )
    assert got(lifecycle.alive_before(t), "address") == [("again",)]
    assert got(lifecycle.alive_at(t, 10), "address") == [("again",), ("stays",)]
    assert got(lifecycle.alive_by_year(t), "n_alive_contracts") == [(1,)]


def test_limit_comes_before_the_contracts_go(spark):
    t = rows(spark, *[(k, f"t{k}", "0", "create", "maker" if k < 5 else "eoa", f"c{k}") for k in range(8)], (9, "m", "0", "create", "eoa2", "maker"))
    contracts = ot.created_contracts(t)
    assert got(deployers.top_deployers_alive(t, contracts, 100, n=1)) == []
    assert got(deployers.top_deployers_alive(t, contracts, 100, n=2)) == [("eoa", 3)]


def test_circles_of_creators_end(spark):
    t = rows(spark, (1, "a", "0", "create", "x", "y"), (2, "b", "0", "create", "y", "x"))
    with pytest.raises(ValueError):
        deployers.creation_lineage(t, max_depth=3)
    # In the order of blocks x made y and then y made x, so that x is its own creator's creator, once.
    assert got(deployers.creation_lineage(t, by_block=True)) == [("x", "x", 2), ("x", "y", 1), ("y", "x", 1)]


def test_lineage_takes_rounds_by_the_logarithm_of_its_depth(spark, monkeypatch):
    n, tables = 70, []
    monkeypatch.setattr(deployers, "written", lambda df, name, own=deployers.written: tables.append(name) or own(df, name))
    chain = [(k, f"t{k}", "0", "create", f"c{k}", f"c{k + 1}") for k in range(n)]
    t = rows(spark, *chain, (500, "twice", "0", "create", "c0", "c1"), (501, "side", "0", "create2", "c5", "d"))
    depth = {(r.original_creator, r.to_address): r.depth for r in deployers.creation_lineage(t, max_depth=n).collect()}
    assert len(tables) <= 9  # the creations and seven rounds, the last of them empty
    assert depth[("c0", f"c{n}")] == n and depth[("c0", "d")] == 6 and len(depth) == n * (n + 1) // 2 + 6
    out = deployers.creation_lineage(t, max_depth=n)
    assert out.filter("original_creator = 'c0' AND to_address = 'c9'").count() == 2  # a row for each way up
    assert deployers.creation_lineage(t, n, by_block=True).filter("original_creator = 'c0' AND to_address = 'c9'").count() == 1
    with pytest.raises(ValueError):
        deployers.creation_lineage(t, max_depth=n - 1)


def test_last_row_of_a_pair_wins(spark):
    pairs = spark.createDataFrame([("A", "b", 5, 1), ("b", "a", 2, 2)], "from_address string, to_address string, call_count long, row_no int")
    assert got(graph.undirected_graph(pairs, "row_no"), "u", "v", "weight") == [("a", "b", 2)]


def test_pairs_with_nulls_drop_out(spark):
    a = rows(spark, (1, "t", "", "call", "x", None), (1, "t", "0", "call", "x", "y"))
    assert got(reconcile.pair_count_diff(a, a.limit(0))) == [("x", "y", 1, 0)]


def test_percentiles_interpolate(spark):
    h = spark.createDataFrame([(2000, 1, 10), (2000, 2, 10), (2000, 5, 20), (2001, 3, 4)], "year int, addresses_called long, frequency long")
    a, b = got(results.weighted_percentiles(h), "year", "min", "q1", "median", "q3", "max", "txs", "median_rounded")
    assert a == (2000, 1, 1.0, 2.0, 3.5, 5, 40, 2) and b == (2001, 3, 3.0, 3.0, 3.0, 3, 4, 3)


def test_scalars(spark):
    df = spark.createDataFrame([("0x1F", 1), (" 12 ", 999), ("latest", 2_500_000), (None, 10)], "b string, n long")
    assert [r[0] for r in df.select(sc.parse_block(F.col("b"))).collect()] == [31, 12, None, None]
    assert [r[0] for r in df.select(sc.abbreviate_number(F.col("n"))).collect()] == ["1", "999", "2.50m", "10"]
    assert [r[0] for r in df.select(sc.activity_level(F.col("n"))).collect()] == ["single", "high", "significant", "moderate"]
    with pytest.raises(Exception, match="not a block"):
        df.select(sc.parse_block(F.col("b"), strict=True)).collect()
    with pytest.raises(ValueError):
        ot.filter_block_range(df, 5, 4)
    with pytest.raises(ValueError):
        ot.filter_block_range(df, 0, 8000, limit=ot.MAX_BLOCKS)


def test_graph_documents(spark, one):
    t = rows(spark, (1, "t", "", "call", "c", "a"), (1, "t", "0", "call", "a", "b"))
    edges = graph.call_edges(graph.extract_calls(t, one))
    doc = sinks.edges_to_node_link(edges).first().document
    assert doc == '{"directed":true,"multigraph":false,"graph":{},"nodes":[{"id":"a"},{"id":"b"},{"id":"c"}],"edges":[{"types":{"CALL":1},"source":"a","target":"b"},{"types":{"CALL":1},"source":"c","target":"a"}]}'
    lines = [r.line for r in sinks.edges_to_dot(edges).collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and '  "c" -> "a" [label="CALL=1"];' in lines


@pytest.mark.parametrize("writer", [sinks.node_link_pieces, sinks.edges_to_json_lines])
def test_writers_of_graphs_read_the_traces_once(spark, one, tmp_path, writer):
    """What they return reads edges that are written, so that calls aren't extracted again for each part of it."""
    rows(spark, (1, "t", "", "call", "c", "a"), (1, "t", "0", "call", "a", "b")).write.parquet(str(tmp_path / "traces"))
    out = writer(graph.call_edges(graph.extract_calls(spark.read.parquet(str(tmp_path / "traces")), one)))
    assert out.count() >= 5
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]


def test_blank_cells_and_later_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('transaction_hash,trace_address,action_type,action_from,action_to,result_address\nt,"0,1",call,x,y,\nt,,create,x," ",z\n')
    out = st.read_exporter_csv(spark, f"file://{tmp_path}/a.csv", "a")
    assert [tuple(r) for r in out.collect()] == [("t", "0_1", "x", "y"), ("t", None, "x", "z")]
    (tmp_path / "d.csv").write_text("﻿address;label\n0xAB; one\n0xab;two\n0xC; three\n")
    assert got(st.read_address_dims(spark, f"file://{tmp_path}/d.csv", sep=";")) == [("0xab", "two"), ("0xc", "three")]


def test_labels_that_repeat_multiply_nothing(spark):
    labels = spark.createDataFrame([("0xA", "one"), ("0xa", "two"), ("0xa", None), ("0xb", None), (None, "x")], "address string, label string")
    nodes = spark.createDataFrame([("0xa",), ("0xb",)], "node string")
    assert got(results.attach_labels(nodes, labels, labels)) == [("0xa", "two"), ("0xb", "0xb")]
    edges = spark.createDataFrame([("0xa", "0xb", {"CALL": 1})], "source string, target string, types map<string,long>")
    assert got(graph.classify_edges(edges, "0xA", labels), "source_name", "interaction_type") == [("two", "Direct")]
    callees = spark.createDataFrame([("call", "0xa", 5), ("callcode", "0xa", 1)], "call_type string, to_address string, call_count long")
    assert got(results.top_callee_links(callees, labels)) == [("call", "two", 5)]
    old = spark.createDataFrame([("0xa", "old", 1, 1)], "address string, label string, date_added int, last_updated int")
    new = spark.createDataFrame([("0xa", "new", 2), ("0xa", "newer", 3), ("0xc", "c", 3), ("0xc", "d", 3)], "address string, label string, now int")
    assert got(results.upsert_labels(old, new)) == [("0xa", "newer", 1, 3), ("0xc", "d", 3, 3)]


def test_merged_edges_keep_the_last_weight(spark):
    edges = spark.createDataFrame([("a", "x", 5, 2), ("b", "x", 2, 1), ("a", "b", 9, 3)], "u string, v string, weight long, row_no int")
    names = spark.createDataFrame([("a", "N"), ("b", "N"), ("x", "X")], "node string, name string")
    assert got(graph.relabel_nodes(edges, names), "u", "v", "weight") == [("N", "N", 9), ("N", "X", 2)]
    assert got(graph.relabel_nodes(edges, names, "row_no"), "u", "v", "weight") == [("N", "N", 9), ("N", "X", 5)]


def test_places_in_an_order(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k", "id")
    out = numbered(df, [F.desc("k")], "place").collect()
    assert all(r.place == 1000 - r.k for r in out) and len(out) == 1000
    assert numbered(df.limit(0), ["k"], "place").count() == 0


def test_most_called_targets(spark):
    n = [40, 20, 20, 10, 10, 5, 5, 5, 3, 3, 3, 3, 3, 1, 0]
    edges = spark.createDataFrame([("c", f"t{i:02d}", {"CALL": k}) for i, k in enumerate(n)], "source string, target string, types map<string,long>")
    assert got(graph.top10_ratio(edges)) == [(int(100 * sum(n[:10]) / sum(n) + 0.5),)]
    assert got(graph.half_interactions_count(edges)) == [(3,)]
    assert got(graph.half_interactions_count(edges.filter("target <> 't00'"), "source")) == [("c", 3)]


def test_stored_traces_are_pruned(spark):
    path = scratch_folder(spark, "t")
    st.write_traces(rows(spark, *[(k * 50_000, f"t{k}", "", "call", "0xAB", f"0xC{k}") for k in range(8)]), path)
    out = st.read_traces(spark, path, first=100_000, last=249_999).filter("from_address = '0xab'")
    assert got(out, "block_number", "to_address") == [(100_000, "0xc2"), (150_000, "0xc3"), (200_000, "0xc4")]
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = st.read_traces(spark, path, first=100_000, last=249_999).filter("from_address = '0xab'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(from_address,0xab)" in plan


def test_documents_of_valid_contracts_only(spark):
    a, b, c = ("0x" + x * 40 for x in "abc")
    t = rows(spark, (1, "t", "", "call", a, b), (1, "t", "0", "call", b, c), (2, "u", "", "call", c, b), (9, "v", "", "call", a, b))
    code = spark.createDataFrame([(a.upper().replace("0X", "0x"), "0x60"), (b, "0x60"), (c, "0x")], "address string, code string")
    none = spark.createDataFrame([], "address string, label string")
    listed = spark.createDataFrame([(a,), (c,)], "contract string")
    (doc,) = network.network_documents(t, listed, code, none, none, 1, 5).collect()
    assert (doc.address, doc.n_nodes, [e.target for e in doc.edges]) == (a, 2, [b])
    with pytest.raises(ValueError):
        network.network_documents(t, listed, code, none, none, 1, 9000)


def test_trees_that_cannot_be_read_are_named(spark):
    deep = '{"calls":[' * 200_000 + "{}" + "]}" * 200_000
    for doc in (deep, "{"):
        df = spark.createDataFrame([("0xbad", doc)], "transaction_hash string, trace_json string")
        with pytest.raises(Exception, match="0xbad"):
            st.flatten_call_trees(df).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stored_traces_are_the_view(spark):
    sf, names = "/root/testdata/sf0.001", ("traces", "contracts", "source_b", "events")
    as_text = lambda: {n: sorted(str(r) for r in testview.frame(spark, sf, n).collect()) for n in names}
    derived = as_text()
    testview.store(spark, sf)
    try:
        assert as_text() == derived
    finally:
        testview._stored.clear()


def test_deep_trees_are_linear_rows(spark, one):
    """A thousand frames one below the other, every tenth by the contract: counts by hand, and no row per level in the plan."""
    t = rows(spark, *[(1, "t", ",".join(["0"] * k), "call", "c" if k % 10 == 0 else "x", f"y{k}") for k in range(1000)])
    calls = graph.extract_calls(t, one)
    assert {r.target: r.times for r in calls.collect()} == {f"y{k}": k // 10 + 1 for k in range(1000)}
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


def test_places_of_a_transaction_meet_in_one_shuffle(spark, one, tmp_path):
    """Rows that enter and leave a frame aren't the sides of a union: Spark puts the partitions of each side together by its own sizes, and
    a window above would take them as dealt alike."""
    rows(spark, (1, "t", "", "call", "c", "a"), (1, "t", "0", "call", "a", "b"), (1, "u", "", "call", "x", "c")).write.parquet(str(tmp_path / "t"))
    calls = graph.extract_calls(spark.read.parquet(str(tmp_path / "t")), one)
    assert got(calls, "target", "times") == [("a", 1), ("b", 1)]
    assert "Union" not in calls._jdf.queryExecution().executedPlan().toString()


def test_siblings_and_repeated_rows_of_a_tree(spark):
    """Places sort by numbers (2 before 10), a frame is left before its next sibling, repeated rows count each."""
    t = rows(spark, (1, "t", "", "call", "x", "a"), (1, "t", "2", "call", "c", "b"), (1, "t", "2,10", "call", "b", "d"), (1, "t", "2,9", "call", "b", "e"), (1, "t", "10", "call", "x", "f"), (1, "t", "20", "call", "d", "g"), (1, "t", "20,0", "call", "c", "h"), (1, "t", "20,0", "call", "c", "h"))
    listed = spark.createDataFrame([("C",), ("D",), ("d",)], "contract string")
    assert got(graph.extract_calls(t, listed), "contract", "target", "times") == [("c", "b", 1), ("c", "d", 1), ("c", "e", 1), ("c", "h", 4), ("d", "g", 1), ("d", "h", 2)]


def test_repeated_dimension_rows_give_one_row_a_node(spark):
    """Repeated and mixed-case rows of every dimension: a node stays one row."""
    df = lambda items, schema: spark.createDataFrame(items, schema)
    nodes = df([("0xa",), ("0xb",)], "node string")
    labels = df([("0xA", "one"), ("0xa", "two"), ("0xa", None), (None, "x")], "address string, label string")
    verified = df([("0xA", True), ("0xa", False), ("0xb", None)], "address string, verified boolean")
    tags = df([("0xA", "T", "External"), ("0xa", "S", "Lido"), ("0xa", None, None)], "address string, name_tag string, category string")
    listed = df([("0xA",), ("0xa",), (None,)], "address string")
    assert got(graph.color_groups_tagged(nodes, listed.limit(0), tags)) == [("0xa", 2), ("0xb", 3)]
    assert got(graph.color_groups_tagged(nodes, listed, tags)) == [("0xa", 1), ("0xb", 3)]
    assert got(graph.color_groups_flagged(nodes, listed, listed)) == [("0xa", 1), ("0xb", 0)]
    assert got(graph.display_names(nodes, labels, verified)) == [("0xa", "two ✓"), ("0xb", "0xb...0xb ✗")]
    assert got(graph.tagged_names(nodes, tags, labels)) == [("0xa", "T"), ("0xb", "0xb...0xb")]
    assert got(graph.node_statistics(nodes.selectExpr("node", "1 AS color_group"), verified)) == [(1, 2, 1, 2)]
    t = rows(spark, (1, "t", "0", "create", "0xa", "c1"), (1, "t", "1", "create", "0xa", "c2"), (1, "u", "0", "create", "0xb", "c3"))
    assert got(deployers.top_deployers(t, labels, 5)) == sorted([("0xa", 2, "two"), ("0xb", 1, None)], key=str)
    old = df([("0xA", "old", 1, 1), ("0xa", "older", 2, 0)], "address string, label string, date_added int, last_updated int")
    new = df([("0xA", "new", 5), ("0xa", "last", 6), (None, "x", 9)], "address string, label string, now int")
    assert got(results.upsert_labels(old, new)) == [("0xa", "last", 1, 6)]
    assert got(results.upsert_labels(old, new.limit(0))) == [("0xa", "old", 1, 1)]


def test_conditions_on_addresses_reach_the_files(spark):
    """A condition on one address is pushed down by every operator that has one, and most rows aren't read: the scan's own count."""
    path = scratch_folder(spark, "t")
    n = 600_000
    t = spark.range(n).selectExpr("id % 1000 AS block_number", "timestamp_seconds(1577836800 + id % 1000) AS block_timestamp", "'t' || id AS transaction_hash", "'' AS trace_address", "'call' AS trace_type", "'call' AS call_type", "lower('0x' || lpad(hex(id * 7919 % 1000), 40, '0')) AS from_address", "'0xe' || substr(sha2(CAST(id % 1000 AS STRING), 256), 1, 39) AS to_address", "1 AS status")
    st.write_traces(t, path, row_group=1 << 16)
    traces = st.read_traces(spark, path)
    caller, callee = "0x" + "0" * 37 + "2FA", traces.first().to_address

    def scanned(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
        try:
            df = df.select("*")  # planned anew
            df.collect()
            plan = df._jdf.queryExecution().executedPlan()
            leaves = plan.collectLeaves()
            return plan.toString(), max(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.maxMetadataStringLength")

    listed = spark.createDataFrame([(caller,)], "address string")
    for df in (ot.filter_from_list(traces, listed), ot.filter_from_list(traces, [caller]), graph.caller_transactions(traces, listed.toDF("contract"))):
        plan, rows_read = scanned(df)
        assert f"EqualTo(from_address,{caller.lower()})" in plan or f"In(from_address, [{caller.lower()}])" in plan
        assert 0 < rows_read < n / 8 and df.count() == n // 1000
    plan, rows_read = scanned(ot.filter_from_list(traces, [callee], "to_address"))
    assert 0 < rows_read < n / 8  # each row group has callees from all over the alphabet: Bloom filters skip them
    assert scanned(ot.filter_from_list(traces, ["0xe7absent"], "to_address"))[1] < n / 8


def test_ends_meet_the_members_once(spark):
    t = rows(spark, (1, "t", "", "call", "a", "b"), (1, "t", "0", "call", "b", "z"), (2, "u", "", "call", "b", "a"), (2, "u", "0", "call", "a", None))
    members = spark.createDataFrame([("a",), ("b",), ("b",), ("unused",)], "address string")
    out = ot.between_members(t, members)
    assert got(out, "from_address", "to_address") == [("a", "b"), ("b", "a")]


def test_sets_of_ids_as_bits(spark):
    ids = spark.range(0, 40_000, 7).union(spark.range(5_000_000, 5_000_100)).union(spark.createDataFrame([(63,), (64,), (64,), (None,)], "id long"))
    df = spark.range(0, 6_000_000, 3).selectExpr("id AS from_id", "id + 1 AS to_id")
    want = {r.id for r in ids.filter("id is not null").collect()}
    assert {(r.from_id, r.to_id) for r in addresses.with_members(df, addresses.id_bits(ids)).collect()} == {(x, x + 1) for x in want if x % 3 == 0 and x + 1 in want}
    one = addresses.with_members(df, addresses.id_bits(ids), ["from_id"])
    assert {r.from_id for r in one.collect()} == {x for x in want if x % 3 == 0}
    # No rows are shuffled for the membership of both ends.
    assert "hashpartitioning(from_id" not in (plan := addresses.with_members(df, addresses.id_bits(ids))._jdf.queryExecution().executedPlan().toString()) and plan.count("BroadcastHashJoin") == 2


def test_dictionary_has_no_gaps(spark):
    t = rows(spark, (1, "t", "", "call", "b", "a"), (1, "t", "0", "call", "a", None), (2, "u", "", "call", "d", "b"))
    d = addresses.address_dictionary(t)
    assert got(d, "address", "id") == [("a", 0), ("b", 1), ("d", 2)]
    assert sorted((tuple(r) for r in addresses.with_ids(t, d).select("from_id", "to_id").collect()), key=str) == [(0, None), (1, 0), (2, 1)]
    bits = addresses.id_bits(addresses.ids_of(spark.createDataFrame([("A",), ("b",), ("x",)], "address string"), d))
    assert got(addresses.with_members(addresses.with_ids(t, d), bits), "from_address", "to_address") == [("b", "a")]


def test_events_are_taken_in_by_bucket(spark, monkeypatch):
    """A new bucket is read once and no other again; what is read is as from all traces, also after a run that broke off."""
    monkeypatch.setattr(st, "BUCKET", 10)
    traces, table = scratch_folder(spark, "t"), scratch_folder(spark, "e")
    first = rows(spark, *[(b, f"t{b}", "0", ("create", "call", "suicide")[b % 3], "0xa", f"0xc{b}") for b in range(35)], (5, "f", "0", "create", "0xa", "0xfailed", 0))
    st.write_traces(first, traces)
    as_read = lambda: got(events.read_events(spark, traces, table), "block_number", "to_address")
    full = lambda: got(events.events_of(st.read_traces(spark, traces)), "block_number", "to_address")
    assert as_read() == full() and events.refresh_events(spark, traces, table) == [0, 1, 2]
    assert as_read() == full() and events.refresh_events(spark, traces, table) == []
    st.write_traces(rows(spark, *[(b, f"t{b}", "0", "create", "0xb", f"0xc{b}") for b in range(35, 58)]), traces, mode="append")
    assert as_read() == full() and events.refresh_events(spark, traces, table) == [3, 4] and as_read() == full()
    plan = events.read_events(spark, traces, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and len(full()) == 23 + 23
    # Events of a bucket that isn't listed as covered are of a run that broke off: they aren't read, and are replaced.
    other = scratch_folder(spark, "e")
    events.refresh_events(spark, traces, other)
    monkeypatch.setattr(events, "covered_buckets", lambda spark, path: [0, 1])
    assert got(events.read_events(spark, traces, other), "block_number", "to_address") == full()
    assert events.refresh_events(spark, traces, other) == [2, 3, 4]
    monkeypatch.undo()
    assert got(lifecycle.create_by_year(events.read_events(spark, traces, other))) == got(lifecycle.create_by_year(st.read_traces(spark, traces)))


def test_whole_buckets_are_counted_without_a_column(spark, monkeypatch):
    monkeypatch.setattr(st, "BUCKET", 10)
    path = scratch_folder(spark, "t")
    st.write_traces(rows(spark, *[(b, f"t{b}", "", "call", "0xa", "0xb") for b in range(3, 87)]), path)
    for start, end in ((0, 100), (10, 40), (15, 52), (21, 27), (20, 20), (33, 40), (90, 95)):
        assert st.count_stored(spark, path, start, end).first().traces == len([b for b in range(3, 87) if start <= b < end])
    assert st.latest_block(spark, path) == 86 and st.stored_buckets(spark, path) == list(range(9))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = st.count_stored(spark, path, 10, 40)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "ReadSchema: struct<>" in plan


def test_rows_of_a_file_in_splits_keep_their_order(spark, tmp_path):
    """The last row of a key wins, however many splits the file is read in."""
    lines = [f"0xA{k % 50},v{k}" for k in range(4000)]
    (tmp_path / "d.csv").write_text("address,label\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", (tmp_path / "d.csv").stat().st_size // 8)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.csv(f"file://{tmp_path}/d.csv").rdd.getNumPartitions() >= 8
        assert got(st.read_address_dims(spark, f"file://{tmp_path}/d.csv")) == sorted((f"0xa{k % 50}", f"v{k}") for k in range(3950, 4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_buckets_that_differ_are_grouped(spark):
    a = [(b, f"t{b}", "", "call", f"x{b % 7}", f"y{b % 3}") for b in range(200)]
    b = [r for r in a if r[0] not in (55, 57)] + [a[120], (130, "n", "", "call", None, "y1"), (131, "n", "", "call", "new", "y1")]
    a, b = rows(spark, *a), rows(spark, *b)
    assert got(reconcile.differing_buckets(a, b, 10)) == [(5,), (12,), (13,)]
    for size in (1, 10, 1000):
        assert got(reconcile.pair_count_diff_by_bucket(a, b, size)) == got(reconcile.pair_count_diff(a, b))
    assert reconcile.pair_count_diff_by_bucket(a, a, 10).count() == 0


def test_documents_are_written_in_even_ordered_parts(spark):
    """A document by all tasks: the same bytes as from one, no part over twice an even share."""
    edges = spark.range(20_000).selectExpr("'0x' || lpad(hex(id * 7919 % 20011), 40, '0') AS source", "'0x' || lpad(hex(id % 50), 40, 'e') AS target", "map('CALL', id % 9, 'STATICCALL', id % 4) AS types")
    uri = scratch_folder(spark, "document")
    sinks.write_node_link(edges, uri)
    whole = b"".join(read_document(uri, 1000)).decode()
    rows_ = sorted((r.source, r.target, sorted(r.types.items())) for r in edges.collect())
    nodes = ",".join(f'{{"id":"{n}"}}' for n in sorted({x for s, t, _ in rows_ for x in (s, t)}))
    links = ",".join('{"types":{' + ",".join(f'"{k}":{v}' for k, v in ty) + f'}},"source":"{s}","target":"{t}"}}' for s, t, ty in rows_)
    assert whole == '{"directed":true,"multigraph":false,"graph":{},"nodes":[' + nodes + '],"edges":[' + links + "]}"
    sizes = [os.path.getsize(p.removeprefix("file://")) for p in document_parts(uri)]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
    assert sinks.edges_to_node_link(edges).first().document == whole
    none = sinks.edges_to_node_link(edges.limit(0)).first().document
    assert none == '{"directed":true,"multigraph":false,"graph":{},"nodes":[],"edges":[]}'


def test_trees_are_read_without_recursion():
    """Token by token as by the JSON library: nested values, fields behind calls, escapes, white space; and very deep ones."""
    rng = random.Random(6)

    def tree(d):
        node = {"from": rng.choice(["0xA", None, 'q"\\\u00e9{']), "to": "0xb", "type": "call", "input": rng.choice([5, 1.5e-7, True, "]}", {"calls": [{"from": 1}], "x": []}, [[], {}]])}
        if rng.random() < 0.8 and d < 6:
            node["calls"] = [tree(d + 1) for _ in range(rng.randrange(4))]
        items = list(node.items())
        rng.shuffle(items)
        return dict(items)

    for k in range(60):
        t = tree(0)
        doc = json.dumps(t, indent=k % 3 or None, ensure_ascii=k % 2 == 0)
        assert sorted(st._streamed(doc), key=str) == sorted(st._frames(t), key=str)
    n = 4000
    deep = '{"calls":[' * n + '{"from":"a"}' + '],"to":"b"}' * n
    out = list(st._streamed(deep))
    assert len(out) == n + 1 and out[0] == (",".join(["0"] * n), n, "a", None, None) and out[-1] == ("", 0, None, "b", None)
    for bad in ("", "{", '{"from":"a"', '{"calls":[{]}', '{"calls":[}]}', '{"x":[}', '{"from":"a"} {}', '{"calls":[{} {}]}', "[]", '{"calls":[' * (st.MOST_LEVELS + 2)):
        with pytest.raises(ValueError):
            list(st._streamed(bad))


def test_two_writers_of_labels(spark, monkeypatch):
    """One of two writers of a version merges again; readers see whole versions; what a lost writer left is never read."""
    path = scratch_folder(spark, "labels")
    fresh = lambda *items: spark.createDataFrame(list(items), "address string, label string, day int").selectExpr("address", "label", "timestamp'2020-01-01' + make_dt_interval(day) AS now")
    now = lambda: got(labels.read_labels(spark, path), "address", "label")
    assert now() == [] and labels.commit_labels(spark, path, fresh(("0xA", "one", 1), ("0xb", "b", 1))) == 1
    first = labels.latest_version(spark, path)
    upsert, raced = labels.upsert_labels, []

    def slow(stored, new):
        if not raced:  # while this writer merges, another commits
            raced.append(True)
            labels.commit_labels(spark, path, fresh(("0xc", "c", 2)))
        return upsert(stored, new)

    monkeypatch.setattr(labels, "upsert_labels", slow)
    assert labels.commit_labels(spark, path, fresh(("0xa", "two", 3))) == 3
    assert now() == [("0xa", "two"), ("0xb", "b"), ("0xc", "c")]
    assert got(labels.read_labels(spark, path, first[1]), "address", "label") == [("0xa", "one"), ("0xb", "b")]
    row = labels.read_labels(spark, path).filter("address = '0xa'").first()
    assert (row.date_added.day, row.last_updated.day) == (2, 4)
    # A writer that is lost before it names its table.
    monkeypatch.setattr(labels, "_claimed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        labels.commit_labels(spark, path, fresh(("0xd", "d", 4)))
    monkeypatch.undo()
    assert labels.latest_version(spark, path)[0] == 3 and len(now()) == 3
    assert labels.commit_labels(spark, path, fresh(("0xd", "d", 4))) == 4 and len(now()) == 4


def test_networks_are_written_as_lines_in_parts(spark):
    a, b, hub = ("0x" + x * 40 for x in "abe")
    at = lambda k: f"0x{k:040x}"
    t = rows(spark, (1, "t", "", "call", a, b), (1, "t", "0", "call", b, hub), *[(2, f"h{k}", "", "call", hub, at(k)) for k in range(3000)])
    code = spark.createDataFrame([(x, "0x60") for x in (a, b, hub, *map(at, range(3000)))], "address string, code string")
    stored = spark.createDataFrame([(b, 'a "quoted"\nlabel')], "address string, label string")
    listed, uri = spark.createDataFrame([(a,), (hub,)], "contract string"), scratch_folder(spark, "networks")
    args = (t, listed, code, stored, stored.limit(0), 1, 5)
    network.write_network_documents(uri, *args)
    lines = [json.loads(x) for x in b"".join(read_document(uri)).decode().splitlines()]
    want = {r.address: r for r in network.network_documents(*args).collect()}
    assert [x["address"] for x in lines] == sorted(want) == [a, hub]
    for x in lines:
        r = want[x["address"]]
        assert (x["from_block"], x["to_block"], x["n_nodes"], x["nodes"]) == (1, 5, r.n_nodes, r.nodes)
        assert [(e["source"], e["target"], sorted(e["types"].items())) for e in x["edges"]] == [(e.source, e.target, [tuple(y) for y in e.types]) for e in r.edges]
    sizes = [os.path.getsize(p.removeprefix("file://")) for p in document_parts(uri)]
    assert len(lines[1]["edges"]) == 3000 and max(sizes) < 2 * sum(sizes) / 4
