"""One object over a graph: lookups, search, traversal, time, communities, events, rules, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import analytics, build, merge, provenance, reasoning, search, temporal, traversal
from loomgraph.sources import exports, graph_json


class GraphQuery:
    """Queries over one graph; every method gives a DataFrame that runs when it is read."""

    def __init__(self, graph: Graph):
        self.graph = graph

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> GraphQuery:
        return cls(graph_json.read_graph(spark, path))

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> GraphQuery:
        return cls(graph_json.read_folder(spark, folder))

    # ---- lookups and search

    def entity(self, node_id: str) -> DataFrame:
        return search.entity(self.graph, node_id)

    def find_entities(self, query: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
        return search.find_entities(self.graph, query, entity_type, limit)

    def relations(self, source: str | None = None, target: str | None = None, rel: str | None = None, include_inferred: bool = True) -> DataFrame:
        return search.edge_views(self.graph, search.relations(self.graph, source, target, rel, include_inferred))

    def search(self, query: str, k_entities: int = 10, k_edges: int = 40) -> DataFrame:
        return search.search(self.graph, query, k_entities, k_edges)

    def answer(self, query: str, k_entities: int = 10, k_edges: int = 40) -> DataFrame:
        return search.answer(self.graph, query, k_entities, k_edges)

    def evidence(self, source: str, rel: str, target: str, include_inferred: bool = True) -> DataFrame:
        return provenance.bundle(self.graph, source, rel, target, include_inferred)

    def edge_evidence(self) -> DataFrame:
        return provenance.edge_evidence(self.graph)

    # ---- traversal

    def neighbors(self, node_id: str, hops: int = 1, direction: str = "both", rel: str | None = None, max_edges: int = 200) -> tuple[DataFrame, DataFrame]:
        return traversal.neighborhood(self.graph, node_id, hops, direction, rel, max_edges)

    def find_paths(self, source: str, target: str, max_hops: int = 3, direction: str = "both", max_paths: int = 10) -> DataFrame:
        return traversal.find_paths(self.graph, source, target, max_hops, direction, max_paths)

    def shortest_path(self, source: str, target: str, max_hops: int = 3, direction: str = "both") -> DataFrame:
        return traversal.shortest_path(self.graph, source, target, max_hops, direction)

    def explain(self, source: str, target: str, max_hops: int = 3, max_paths: int = 5) -> DataFrame:
        return traversal.explain(self.graph, source, target, max_hops, max_paths)

    # ---- metrics and communities

    def rank(self, metric: str = "degree", limit: int = 10) -> DataFrame:
        scores = search.metric(metric)(self.graph)
        degree = self.graph.endpoints().groupBy("node_id").agg(F.count("*").alias("degree"))
        return search.rank(scores, limit).join(degree, "node_id", "left").fillna(0, ["degree"]).orderBy("rank")

    def statistics(self) -> DataFrame:
        return analytics.statistics(self.graph)

    def community_of(self, node_id: str) -> DataFrame:
        return search.community_of(self.graph, node_id)

    def community_neighbors(self, node_id: str, limit: int = 20) -> DataFrame:
        return search.community_neighbors(self.graph, node_id, limit)

    def related(self, node_id: str, mode: str = "shared_neighbors", limit: int = 10, entity_type: str | None = None, hops: int = 2) -> DataFrame:
        return search.related(self.graph, node_id, mode, limit, entity_type, hops)

    def communities(self, method: str = "louvain") -> DataFrame:
        return {"louvain": analytics.louvain, "label_propagation": analytics.label_propagation, "spectral": analytics.spectral, "components": analytics.components}[method](self.graph)

    def reports(self) -> DataFrame:
        return analytics.community_report(self.graph)

    # ---- events and time

    def events_for(self, node_id: str, event_types: list[str] | None = None) -> DataFrame:
        return search.events_for(self.graph, node_id, event_types)

    def active_at(self, day: str, rel: str | None = None, target: str | None = None) -> DataFrame:
        return temporal.active_at(temporal.scoped(self.graph.edges), day, rel, target)

    def role_holders(self, rel: str, target: str, day: str) -> DataFrame:
        return temporal.role_holders(self.graph, rel, target, day)

    def ask(self, question: str) -> DataFrame:
        return temporal.ask(self.graph, question)

    def timeline(self, entity: str | None = None) -> DataFrame:
        return temporal.timeline(temporal.scoped(self.graph.edges), entity)

    def changes(self, start: str, end: str) -> DataFrame:
        return temporal.changes(temporal.scoped(self.graph.edges), start, end)

    def conflicts(self) -> DataFrame:
        return temporal.conflicts(temporal.scoped(self.graph.edges))

    def overlaps(self) -> DataFrame:
        return temporal.overlaps(temporal.scoped(self.graph.edges))

    # ---- changes of the graph

    def infer(self, rules: tuple[str, ...] = tuple(reasoning.RULES), min_confidence: float = 0.3) -> GraphQuery:
        return GraphQuery(reasoning.apply(self.graph, reasoning.infer(self.graph, rules, min_confidence)))

    def merge(self, incoming: Graph, **policies) -> GraphQuery:
        return GraphQuery(merge.merge(self.graph, incoming, **policies))

    def diff(self, newer: Graph) -> DataFrame:
        return merge.diff_graphs(self.graph, newer)

    def validate(self) -> DataFrame:
        return build.validate(self.graph)

    def export(self, kind: str) -> DataFrame:
        forms = {"cytoscape": exports.cytoscape, "vis": exports.vis_network, "d3": exports.d3, "mermaid": exports.mermaid, "linked_data": graph_json.linked_data, "sync": exports.sync_statements}
        return forms[kind](self.graph)
