"""The property graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_COLUMNS = ("edge_id", "source", "rel", "target", "valid_from", "valid_to", "confidence", "inferred", "document_id")
NODE_COLUMNS = ("node_id", "type", "confidence")


class QueryError(ValueError):
    """A query that names an entity, metric or bound that does not exist."""


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, type, confidence ..), edges(edge_id, source, rel, target ..), members(cluster_id, node_id).

    `edge_id` is unique and its order stands for the order of insertion.
    """

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def require(self, *node_ids: str) -> None:
        """Raise unless every id is a node: a probe of a few rows."""
        found = {r[0] for r in self.nodes.where(F.col("node_id").isin(*node_ids)).select("node_id").distinct().collect()}
        missing = [n for n in node_ids if n not in found]
        if missing:
            raise QueryError(f"unknown entity: {missing[0]}")

    def endpoints(self) -> DataFrame:
        """(node_id, other, edge_id, rel): every edge seen from both ends."""
        e = self.edges
        out = e.select(F.col("source").alias("node_id"), F.col("target").alias("other"), "edge_id", "rel")
        return out.unionByName(e.select(F.col("target").alias("node_id"), F.col("source").alias("other"), "edge_id", "rel"))


def complete(edges: DataFrame) -> DataFrame:
    """Edges with every column of the model; missing ones are null or false."""
    kinds = {"confidence": "double", "inferred": "boolean"}
    for c in EDGE_COLUMNS:
        if c not in edges.columns:
            edges = edges.withColumn(c, F.lit(False) if c == "inferred" else F.lit(None).cast(kinds.get(c, "string")))
    return edges.select(*EDGE_COLUMNS)


#: what nodes and edges may carry besides; properties and metadata are JSON objects as text
NODE_EXTRAS = {"properties": "string", "metadata": "string", "aliases": "array<string>", "source_documents": "array<string>", "embedding": "array<double>"}
EDGE_EXTRAS = {"detail": "string", "is_negated": "boolean", "created_at": "string", "updated_at": "string", "metadata": "string"}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(k) for c, k in columns.items() if c not in df.columns})


def full_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with all columns they may carry; missing ones are null."""
    return _with(nodes, {"type": "string", "confidence": "double"} | NODE_EXTRAS).select(*NODE_COLUMNS, *NODE_EXTRAS)


def full_edges(edges: DataFrame) -> DataFrame:
    """Edges with all columns they may carry; missing ones are null."""
    extra = _with(edges, EDGE_EXTRAS)
    for c in EDGE_COLUMNS:
        if c not in extra.columns:
            extra = extra.withColumn(c, F.lit(False) if c == "inferred" else F.lit(None).cast("double" if c == "confidence" else "string"))
    return extra.select(*EDGE_COLUMNS, *EDGE_EXTRAS)


def meta(key: str, column: str = "metadata"):
    """A field of the metadata, as text; nested by dots."""
    return F.get_json_object(column, f"$.{key}")
