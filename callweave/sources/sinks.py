"""Writers of graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.graph import graph_nodes
from callweave.storage import document_parts, scratch_folder, write_ordered, written


def node_link_pieces(edges: DataFrame) -> DataFrame:
    """(section, a, b, piece): the graph of one contract as node-link JSON in pieces, a row for each node and each edge and three for
    what stands around them. Put end to end in the order of (section, a, b) they are the document. Edges are unique by their ends.
    They are written once, as they are met four times."""
    edges = written(edges, "edges")
    first_node, first_edge = graph_nodes(edges).agg(F.min("node")).first()[0], edges.agg(F.min(F.struct("source", "target")).alias("e")).first().e
    comma = lambda first, json: F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), json)
    none = F.lit(None).cast("string")
    nodes = graph_nodes(edges).select(F.lit(1).alias("section"), F.col("node").alias("a"), none.alias("b"), comma(F.col("node") == F.lit(first_node), F.to_json(F.struct(F.col("node").alias("id")))).alias("piece"))
    types = F.map_from_entries(F.array_sort(F.map_entries("types")))
    is_first = (F.col("source") == F.lit(first_edge and first_edge.source)) & (F.col("target") == F.lit(first_edge and first_edge.target))
    links = edges.select(F.lit(3).alias("section"), F.col("source").alias("a"), F.col("target").alias("b"), comma(is_first, F.to_json(F.struct(types.alias("types"), "source", "target"))).alias("piece"))
    around = [(0, None, None, '{"directed":true,"multigraph":false,"graph":{},"nodes":['), (2, None, None, '],"edges":['), (4, None, None, "]}")]
    return nodes.union(links).union(edges.sparkSession.createDataFrame(around, "section int, a string, b string, piece string"))


def write_node_link(edges: DataFrame, uri: str) -> None:
    """The graph as one node-link JSON document in ordered parts, each written by a task with an even share (see
    ``storage.write_ordered``; ``storage.read_document`` reads it)."""
    write_ordered(node_link_pieces(edges), ["section", "a", "b"], uri)


def edges_to_node_link(edges: DataFrame) -> DataFrame:
    """One row ``document``: the graph of one contract as node-link JSON, nodes and edges in order. The document is written in parts by
    all tasks; only the row itself, which holds all of it, is made in one place."""
    uri = scratch_folder(edges.sparkSession, "document")
    write_node_link(edges, uri)
    parts = document_parts(uri)
    place = F.element_at(F.create_map(*[x for k, p in enumerate(parts) for x in (F.lit(p.rpartition("/")[2]), F.lit(k))]), F.element_at(F.split("_metadata.file_path", "/"), -1))
    text = edges.sparkSession.read.text(parts, wholetext=True).select(F.struct(place.alias("k"), "value").alias("p"))
    return text.agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["value"]), "").alias("document"))


def edges_to_json_lines(edges: DataFrame) -> DataFrame:
    """(kind, line): every node and every edge of a graph as a JSON object of its own, to be written as text. The edges are written
    once, as nodes and lines both come from them."""
    edges = written(edges, "edges")
    nodes = graph_nodes(edges).select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"))).alias("line"))
    types = F.map_from_entries(F.array_sort(F.map_entries("types")))
    return nodes.union(edges.select(F.lit("edge"), F.to_json(F.struct(types.alias("types"), "source", "target"))))


def edges_to_dot(edges: DataFrame) -> DataFrame:
    """(line_no, line) of a DOT digraph: the head, one line per edge in order, the end."""
    types = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    line = F.format_string('  "%s" -> "%s" [label="%s"];', "source", "target", types)
    body = edges.select(F.lit(1).alias("line_no"), line.alias("line"))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph {"), (2, "}")], "line_no int, line string")
    return body.union(ends).orderBy("line_no", "line")


def write_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
