"""Call extraction and the call graph: edges (source, target, types) with types a map of call type to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.scalars import activity_level, short_address
from callweave.operators.labels import unique_by_address, unique_labels
from callweave.operators.traces import filter_from_list
from callweave.storage import numbered


def _listed(contracts: DataFrame) -> DataFrame:
    return contracts.select(F.lower("contract").alias("contract")).distinct()


def caller_transactions(traces: DataFrame, contracts: DataFrame) -> DataFrame:
    """(contract, transaction_hash): transactions in which a listed contract makes a call. A list of few contracts is a condition
    on the caller that reaches the files."""
    calls = filter_from_list(traces.filter(F.col("trace_type") == "call"), contracts.select(F.col("contract").alias("address")))
    return calls.select(F.col("from_address").alias("contract"), "transaction_hash").distinct()


#: Comes after every place below a frame: the frame's end, where the frame is left.
END = 2**31 - 1


def extract_calls(traces: DataFrame, contracts: DataFrame, dedup: bool = False) -> DataFrame:
    """Every frame at or below a frame of which the contract is the caller, for each contract of a table.

    (contract, transaction_hash, trace_address, source, target, type, times): a frame counts once for each matching frame
    at or above it, or once if ``dedup``. Frames without a callee are dropped.

    The frames of a transaction are taken in the order of their places, parents first. A matching frame is entered at its
    place and left after the last place below it, and how many are open at a frame is a running sum over its transaction, so a
    frame is one row however deep it is, and a matching one two. Frames at one place are entered together.
    """
    txs = caller_transactions(traces, contracts)
    frames = traces.select(
        "transaction_hash", F.coalesce("trace_address", F.lit("")).alias("trace_address"), F.col("from_address").alias("source"), F.col("to_address").alias("target"),
        F.upper(F.coalesce("call_type", "trace_type")).alias("type"),
    ).join(txs, "transaction_hash")
    place = F.when(F.col("trace_address") == "", F.array().cast("array<int>")).otherwise(F.split("trace_address", ",").cast("array<int>"))
    matches = F.coalesce(F.col("source") == F.col("contract"), F.lit(False))
    # A matching frame is met twice by a join with two rows, not by a union: under a window Spark 4.1 takes the sides of a union as
    # dealt alike (no shuffle between), and results were wrong on larger tables, probably as each side is coalesced by its own sizes.
    kinds = traces.sparkSession.range(2).select((F.col("id") == 0).alias("frame"))
    frames = frames.withColumn("place", place).join(F.broadcast(kinds), F.col("frame") | matches)
    frames = frames.withColumns({"place": F.when(F.col("frame"), F.col("place")).otherwise(F.concat("place", F.array(F.lit(END)))), "opens": F.when(F.col("frame"), matches.cast("int")).otherwise(-1)})
    inside = F.sum("opens").over(Window.partitionBy("contract", "transaction_hash").orderBy("place"))  # with all of an equal place
    met = frames.withColumn("inside", inside).filter(F.col("frame") & (F.col("inside") > 0) & F.col("target").isNotNull())
    keys = ["contract", "transaction_hash", "trace_address", "source", "target", "type"]
    # Frames that are equal in all of these are one frame each per row of the table.
    return met.groupBy(*keys).agg((F.lit(1) if dedup else F.sum("inside")).cast("long").alias("times"))


def call_edges(calls: DataFrame, *by: str) -> DataFrame:
    """(source, target, type[, times]) -> (by, source, target, types)."""
    n = F.sum("times") if "times" in calls.columns else F.count(F.lit(1))
    typed = calls.groupBy(*by, "source", "target", "type").agg(n.alias("n"))
    return typed.groupBy(*by, "source", "target").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))


def total(types: Column) -> Column:
    return F.aggregate(F.map_values(types), F.lit(0).cast("long"), lambda a, x: a + x)


def graph_nodes(edges: DataFrame, *by: str) -> DataFrame:
    return edges.select(*by, F.explode(F.array("source", "target")).alias("node")).distinct()


def dependencies(edges: DataFrame, contract: str) -> DataFrame:
    return graph_nodes(edges).filter(F.col("node") != contract.lower())


def callees(edges: DataFrame, address: str) -> DataFrame:
    return edges.filter(F.col("source") == address.lower()).select(F.col("target").alias("node")).distinct()


def callers(edges: DataFrame, address: str) -> DataFrame:
    return edges.filter(F.col("target") == address.lower()).select(F.col("source").alias("node")).distinct()


def classify_edges(edges: DataFrame, contract: str, labels: DataFrame) -> DataFrame:
    """Adds interaction_type (Direct from the contract, else Indirect) and the names of both ends, null where unknown."""
    name = unique_labels(labels)
    s, t = name.select(F.col("address").alias("source"), F.col("label").alias("source_name")), name.select(F.col("address").alias("target"), F.col("label").alias("target_name"))
    kind = F.when(F.lower("source") == contract.lower(), "Direct").otherwise("Indirect")
    return edges.withColumn("interaction_type", kind).join(s, "source", "left").join(t, "target", "left")


def direct_only(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("interaction_type") == "Direct")


def search_edges(edges: DataFrame, text: str) -> DataFrame:
    """Edges with the trimmed text, in any case, in an end."""
    t = F.lit(text.strip().lower())
    return edges.filter(F.contains(F.lower("source"), t) | F.contains(F.lower("target"), t))


def edge_types_long(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.explode("types").alias("type", "n"))


def edge_types_wide(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.select("source", "target", *[F.coalesce(F.element_at("types", k), F.lit(0)).cast("long").alias(k) for k in types])


def sort_edges(classified: DataFrame, by: str = "address", ascending: bool = True) -> DataFrame:
    """Numbers the edges: by address (direct ones by target, others by source and target, directs first), by
    interaction_type, or by the count of a call type (none is 0). Ties go by source and target."""
    direct = F.col("interaction_type") == "Direct"
    keys = {
        "address": [F.when(direct, 0).otherwise(1), F.when(direct, F.col("target")).otherwise(F.concat("source", "target"))],
        "interaction_type": [F.col("interaction_type")],
    }.get(by, [F.coalesce(F.element_at("types", by), F.lit(0))])
    order = [k.asc() if ascending else k.desc() for k in keys]
    return numbered(classified, [*order, "source", "target"], "position").withColumn("position", F.col("position").cast("int"))


def node_groups(edges: DataFrame, contract: str) -> DataFrame:
    return graph_nodes(edges).withColumn("node_group", F.when(F.lower("node") == contract.lower(), "main").otherwise("other"))


def incident_edges(edges: DataFrame, address: str) -> DataFrame:
    return edges.filter((F.lower("source") == address.lower()) | (F.lower("target") == address.lower()))


def direct_summary(edges: DataFrame, *by: str) -> DataFrame:
    """Of direct edges, per ``by``: direct interactions, direct dependencies and the activity level."""
    out = edges.withColumn("n", total(F.col("types"))).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("interactions"), F.count(F.lit(1)).alias("direct_dependencies"))
    return out.withColumn("activity", activity_level(F.col("interactions")))


def _call_counts(edges: DataFrame, *by: str) -> DataFrame:
    """Direct targets by how often they are called, one row per ``by`` and number of calls n, with windows over these rows:
    targets, targets and calls of those called more often, and all calls."""
    to = edges.groupBy(*by, "target").agg(F.sum(total(F.col("types"))).alias("n"))
    counts = to.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("targets"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    above = w.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"rank": F.sum("targets").over(above), "calls": F.sum(F.col("targets") * F.col("n")).over(above)}
    return counts.select("*", *[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()], F.sum(F.col("targets") * F.col("n")).over(w).alias("whole"))


def top10_ratio(edges: DataFrame, *by: str) -> DataFrame:
    """Per cent, rounded, of direct calls that go to the ten most called targets."""
    part = F.sum(F.col("n") * F.least(F.greatest(10 - F.col("rank"), F.lit(0)), "targets"))
    return _call_counts(edges, *by).groupBy(*by).agg(F.floor(100.0 * part / F.max("whole") + 0.5).cast("long").alias("top10_ratio"))


def half_interactions_count(edges: DataFrame, *by: str) -> DataFrame:
    """Fewest targets, most called first, that have half of the direct calls or more."""
    # Of the targets called n times so many are needed, at least one.
    more = F.greatest(F.ceil((0.5 * F.col("whole") - F.col("calls")) / F.col("n")), F.lit(1))
    enough = F.when((F.col("n") > 0) & (more <= F.col("targets")), F.col("rank") + more)
    return _call_counts(edges, *by).groupBy(*by).agg(F.min(enough).cast("int").alias("half_count")).filter("half_count is not null")


# ---- undirected, labelled graphs ----


def undirected_graph(pairs: DataFrame, order: str) -> DataFrame:
    """(from_address, to_address, call_count) -> (u, v, weight, log_weight) per unordered pair; of repeated pairs the last
    by the column ``order`` counts, not the sum."""
    u, v = F.least(F.lower("from_address"), F.lower("to_address")), F.greatest(F.lower("from_address"), F.lower("to_address"))
    last = pairs.groupBy(u.alias("u"), v.alias("v")).agg(F.max_by("call_count", order).alias("weight"))
    return last.withColumn("log_weight", F.log1p("weight"))


def drop_prefixed_nodes(graph: DataFrame, zeros: int = 39) -> DataFrame:
    """Without the edges of nodes that start with that many zeros."""
    prefix = "0x" + "0" * zeros
    return graph.filter(~F.col("u").startswith(prefix) & ~F.col("v").startswith(prefix))


def undirected_nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def color_groups_flagged(nodes: DataFrame, documented: DataFrame, in_protocol: DataFrame) -> DataFrame:
    """1 if documented, else 2 if created in the protocol, else 0."""
    group = F.when(F.col("a"), 1).when(F.col("b"), 2).otherwise(0)
    return _joined(_joined(nodes, _flag(documented, "a"), "_a"), _flag(in_protocol, "b"), "_a").select("node", group.alias("color_group"))


#: ``own`` and ``other`` are fixed values: the categories of the tag files.
def color_groups_tagged(nodes: DataFrame, official: DataFrame, tags: DataFrame, own: str = "Lido", other: str = "External") -> DataFrame:
    """1 if official; else 2 or 0 by the tag's category, own or other; else 3. Of several tags of an address the greatest category counts."""
    a = _flag(official, "a")
    b = unique_by_address(tags, "category").withColumnRenamed("address", "_b")
    group = F.when(F.col("a"), 1).when(F.col("category") == own, 2).when(F.col("category") == other, 0).otherwise(3)
    return _joined(nodes, a, "_a").join(b, F.lower("node") == F.col("_b"), "left").select("node", group.alias("color_group"))


def _flag(addresses: DataFrame, name: str) -> DataFrame:
    """(_a, name): each address once, with true."""
    return addresses.select(F.lower("address").alias("_a")).filter("_a is not null").distinct().withColumn(name, F.lit(True))


def _joined(nodes: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return nodes.join(dimension, F.lower("node") == F.col(key), "left").drop(key)


def color_groups_named(names: DataFrame) -> DataFrame:
    """0 for names that are still addresses, else 1."""
    return names.select("name", F.when(F.col("name").startswith("0x"), 0).otherwise(1).alias("color_group")).distinct()


def node_statistics(grouped: DataFrame, verified: DataFrame) -> DataFrame:
    """(node, color_group), (address, verified) -> per group: nodes and unverified ones, with the total of nodes."""
    v = unique_by_address(verified, "verified").withColumnRenamed("address", "_v")
    per = _joined(grouped, v, "_v").groupBy("color_group").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.coalesce("verified", F.lit(False))).alias("unverified"))
    return per.withColumn("all_nodes", F.sum("nodes").over(Window.partitionBy()))


def display_names(nodes: DataFrame, labels: DataFrame, verified: DataFrame) -> DataFrame:
    """(node, name): the label or else the short address, and a mark whether it is verified."""
    label, v = unique_labels(labels).withColumnRenamed("address", "_l"), unique_by_address(verified, "verified").withColumnRenamed("address", "_v")
    named = _joined(_joined(nodes, label, "_l"), v, "_v")
    mark = F.when(F.coalesce("verified", F.lit(False)), " ✓").otherwise(" ✗")
    return named.select("node", F.concat(F.coalesce("label", short_address(F.col("node"))), mark).alias("name"))


def tagged_names(nodes: DataFrame, tags: DataFrame, official: DataFrame) -> DataFrame:
    """(node, name): the name tag, else the official label, else the short address."""
    a, b = unique_by_address(tags, "name_tag").withColumnRenamed("address", "_t"), unique_labels(official).withColumnRenamed("address", "_l")
    return _joined(_joined(nodes, a, "_t"), b, "_l").select("node", F.coalesce("name_tag", "label", short_address(F.col("node"))).alias("name"))


def relabel_nodes(graph: DataFrame, names: DataFrame, order: str | None = None) -> DataFrame:
    """The graph with names for nodes; nodes of one name become one. Of the edges that thus become one the last counts, by the
    column ``order``, else by the addresses of its ends; weights aren't summed."""
    at = F.col(order) if order else F.struct("u", "v")
    graph = graph.select("u", "v", "weight", at.alias("_at"))
    u, v = names.select(F.col("node").alias("u"), F.col("name").alias("nu")), names.select(F.col("node").alias("v"), F.col("name").alias("nv"))
    named = graph.join(u, "u").join(v, "v").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "weight", "_at")
    return named.groupBy("u", "v").agg(F.max_by("weight", "_at").alias("weight")).withColumn("log_weight", F.log1p("weight"))
