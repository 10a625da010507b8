"""The supply chain of contracts: from traces to one document per contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.graph import call_edges, extract_calls, graph_nodes
from callweave.operators.results import attach_labels
from callweave.operators.traces import MAX_BLOCKS, filter_block_range, filter_contract_endpoints, with_code
from callweave.storage import write_ordered, written


def contract_edges(traces: DataFrame, contracts: DataFrame, code: DataFrame | None = None) -> DataFrame:
    """(contract, source, target, types) of all contracts of a table in one pass over the traces."""
    calls = extract_calls(traces, contracts)
    if code is not None:
        calls = filter_contract_endpoints(calls, code, source="source", target="target")
    return call_edges(calls, "contract")


def _networks(traces: DataFrame, contracts: DataFrame, code: DataFrame, stored: DataFrame, fetched: DataFrame, first: int, last: int, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(contract, source, target, types) and (contract, node, label) of the contracts with code and calls."""
    valid = contracts.select(F.lower("contract").alias("contract")).join(with_code(code).withColumnRenamed("address", "contract"), "contract", "left_semi")
    edges = contract_edges(filter_block_range(traces, first, last, limit), valid, code)
    nodes = graph_nodes(edges, "contract")
    labels = attach_labels(nodes.select("node").distinct(), stored, fetched)
    return edges, nodes.join(labels, "node").select("contract", "node", "label")


def network_documents(traces: DataFrame, contracts: DataFrame, code: DataFrame, stored: DataFrame, fetched: DataFrame, first: int, last: int, limit: int | None = MAX_BLOCKS) -> DataFrame:
    """One row per contract with code and calls: address, from_block, to_block, n_nodes, nodes (address -> label), edges. More
    than ``limit`` blocks are an error, as in an interactive request; a batch job passes None. A contract's row is as large as
    its network; ``write_network_documents`` writes networks of any size."""
    edges, nodes = _networks(traces, contracts, code, stored, fetched, first, last, limit)
    named = nodes.groupBy("contract").agg(F.count(F.lit(1)).alias("n_nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "label")))).alias("nodes"))
    listed = edges.groupBy("contract").agg(F.sort_array(F.collect_list(F.struct("source", "target", F.array_sort(F.map_entries("types")).alias("types")))).alias("edges"))
    out = named.join(listed, "contract")
    return out.select(F.col("contract").alias("address"), F.lit(first).cast("long").alias("from_block"), F.lit(last).cast("long").alias("to_block"), "n_nodes", "nodes", "edges")


def network_pieces(traces: DataFrame, contracts: DataFrame, code: DataFrame, stored: DataFrame, fetched: DataFrame, first: int, last: int, limit: int | None = MAX_BLOCKS) -> DataFrame:
    """(contract, section, a, b, piece): the same networks as JSON, a line per contract, in pieces: a row for each node and each edge and
    three for what stands around them. Put end to end in the order of (contract, section, a, b) they are the lines."""
    edges, nodes = (written(x, "network") for x in _networks(traces, contracts, code, stored, fetched, first, last, limit))
    none = F.lit(None).cast("string")
    of_nodes = nodes.groupBy("contract").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    of_edges = edges.groupBy("contract").agg(F.min(F.struct("source", "target")).alias("first"))
    head = F.concat(F.lit('{"address":"'), "contract", F.lit(f'","from_block":{first},"to_block":{last},"n_nodes":'), F.col("n").cast("string"), F.lit(',"nodes":{'))
    around = of_nodes.select("contract", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), x.alias("piece")) for k, x in ((0, head), (2, F.lit('},"edges":[')), (4, F.lit("]}\n")))])).alias("p"))
    comma = lambda is_first: F.when(is_first, F.lit("")).otherwise(F.lit(","))
    pair = F.to_json(F.create_map("node", "label"))
    inside = nodes.join(of_nodes.select("contract", "first"), "contract").select("contract", F.lit(1).alias("section"), F.col("node").alias("a"), none.alias("b"), F.concat(comma(F.col("node") == F.col("first")), F.substring(pair, F.lit(2), F.length(pair) - 2)).alias("piece"))
    types = F.map_from_entries(F.array_sort(F.map_entries("types"))).alias("types")
    links = edges.join(of_edges, "contract").select("contract", F.lit(3).alias("section"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(comma(F.struct("source", "target") == F.col("first")), F.to_json(F.struct(types, "source", "target"))).alias("piece"))
    return around.select("contract", "p.section", none.alias("a"), none.alias("b"), "p.piece").union(inside).union(links)


def write_network_documents(uri: str, *networks, **options) -> None:
    """The networks (arguments of ``network_pieces``) as lines of JSON in ordered parts, each written by a task with an even share: the
    network of a hub is spread over as many parts as it fills (see ``storage.write_ordered``)."""
    write_ordered(network_pieces(*networks, **options), ["contract", "section", "a", "b"], uri)
