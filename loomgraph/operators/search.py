"""Lookup, filters, neighbours and ranked search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.graph import Graph, QueryError


def with_cluster(g: Graph, rows: DataFrame, column: str = "node_id") -> DataFrame:
    """Left join of the cluster; of several the last one counts."""
    order = "cluster_order" if "cluster_order" in g.members.columns else "cluster_id"  # insertion, where it is known
    one = g.members.groupBy("node_id").agg(F.max_by("cluster_id", order).alias("cluster_id"))
    return rows.join(one.withColumnRenamed("node_id", "__n"), F.col(column) == F.col("__n"), "left").drop("__n")


def entity(g: Graph, node_id: str) -> DataFrame:
    g.require(node_id)
    return with_cluster(g, g.nodes.where(F.col("node_id") == node_id))


def parse_relation(text: str) -> str:
    """The relation of '(rel)', 'relation:rel', 'relation=rel', 'rel:x' or 'rel=x'; '' without one."""
    m = re.search(r"\(\s*([\w-]+)\s*\)|\b(?:relation|rel)\s*[:=]\s*([\w-]+)", text, re.I)
    return (m[1] or m[2]).lower() if m else ""


def relations(g: Graph, source: str | None = None, target: str | None = None, rel: str | None = None, include_inferred: bool = True) -> DataFrame:
    e = g.edges
    if source is not None:
        e = e.where(F.col("source") == source)
    if target is not None:
        e = e.where(F.col("target") == target)
    if rel is not None:
        e = e.where(F.lower(F.trim("rel")) == rel.strip().lower())
    return e if include_inferred else e.where(~F.coalesce("inferred", F.lit(False)))


def incident(g: Graph, node_id: str, direction: str = "both") -> DataFrame:
    """Edges at a node with their `direction`; those going out come first in the order (direction desc, edge_id)."""
    out = g.edges.where(F.col("source") == node_id).withColumn("direction", F.lit("out"))
    into = g.edges.where(F.col("target") == node_id).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def neighbors(g: Graph, node_id: str, direction: str = "both", rel: str | None = None) -> DataFrame:
    e = incident(g, node_id, direction)
    if rel:
        e = e.where(F.lower("rel") == rel.lower())
    return e.select(F.when(F.col("direction") == "out", F.col("target")).otherwise(F.col("source")).alias("node_id")).distinct()


def shared_neighbors(g: Graph, a: str, b: str) -> DataFrame:
    return neighbors(g, a).intersect(neighbors(g, b))


def edge_views(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Edges with the types and clusters of both ends, the documents they came from and the snippet that supports them."""
    from .provenance import evidence

    e = evidence(g.edges if edges is None else edges).withColumn("snippet", F.col("item.snippet")).drop("item", "provenance")
    n = with_cluster(g, g.nodes.select("node_id", "type"))
    for side in ("source", "target"):
        e = e.join(n.select(F.col("node_id").alias(side), F.col("type").alias(f"{side}_type"), F.col("cluster_id").alias(f"{side}_cluster")), side, "left")
    return e


def name_score(name, query: str):
    """5 for the whole name, else 3 for one within the other, and 1 + 0.4 k for k shared words."""
    q, toks = " ".join(query.lower().split()), sorted(set(X.py_query_tokens(query)))
    n = X.norm(name)
    shared = F.size(F.array_intersect(X.query_tokens(F.regexp_replace(name, "[:_]", " ")), F.array(*[F.lit(t) for t in toks]).cast("array<string>")))
    part = F.when((F.lit(q) != "") & (n.contains(q) | F.instr(F.lit(q), n).__gt__(0)), 3.0).otherwise(0.0)
    return F.when(n == q, 5.0).otherwise(part + F.when(shared > 0, 1.0 + 0.4 * shared).otherwise(0.0))


def find_entities(g: Graph, query: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
    """(node_id, type, score, rank): best names first, then by lower-case name; without any match those of the greatest degree."""
    n = g.nodes
    if entity_type:
        n = n.where(F.lower("type") == entity_type.lower())
    best = name_score(F.col("node_id"), query)
    if "aliases" in n.columns:
        best = F.greatest(best, F.coalesce(F.array_max(F.transform("aliases", lambda a: name_score(a, query))), F.lit(0.0)))
    hits = n.select("node_id", "type", best.alias("score")).where("score > 0").orderBy(F.desc("score"), F.lower("node_id"), "node_id").limit(max(1, limit))
    if not hits.take(1):
        deg = g.endpoints().groupBy("node_id").count().select("node_id", F.col("count").cast("double").alias("score"))
        hits = n.select("node_id", "type").join(deg, "node_id", "left").fillna(0.0, ["score"]).orderBy(F.desc("score"), F.lower("node_id"), "node_id").limit(max(1, limit))
    w = Window.orderBy(F.desc("score"), F.lower("node_id"), "node_id")  # of at most `limit` rows
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint"))


def search(g: Graph, query: str, k_entities: int = 10, k_edges: int = 40) -> DataFrame:
    """Edges at the best entities (of the relation the query names, if it names one), the first k by edge_id."""
    rel = parse_relation(query)
    seeds = find_entities(g, re.sub(r"\([\w\s-]+\)|\b(?:relation|rel)\s*[:=]\s*[\w-]+", " ", query), limit=k_entities).select("node_id")
    e = g.edges.where(F.lower("rel") == rel) if rel else g.edges
    out = e.join(F.broadcast(seeds), e.source == seeds.node_id, "left_semi").unionByName(e.join(F.broadcast(seeds), e.target == seeds.node_id, "left_semi"))
    return out.dropDuplicates(["edge_id"]).orderBy("edge_id").limit(k_edges)


def answer(g: Graph, query: str, k_entities: int = 10, k_edges: int = 40) -> DataFrame:
    """(n_entities, n_edges, documents, answer): what a search finds, in a sentence, with the documents behind it."""
    from .provenance import edge_evidence

    e = edge_evidence(g, search(g, query, k_entities, k_edges))
    ends = e.select(F.col("source").alias("n")).union(e.select("target")).agg(F.countDistinct("n").alias("n_entities"))
    docs = e.select(F.explode("documents").alias("d")).agg(F.array_sort(F.collect_set("d")).alias("documents"))
    say = F.when(F.col("n_edges") == 0, F.lit(f"Nothing was found for '{query}'.")).otherwise(F.format_string("Found %d relation(s) between %d entities in %d document(s).", "n_edges", "n_entities", F.size("documents")))
    return e.agg(F.count("*").alias("n_edges")).crossJoin(ends).crossJoin(docs).select("n_entities", "n_edges", "documents", say.alias("answer"))  # each is one row


def is_event_type(c):
    """'Event:..' with something behind it, or one of the plain names of events."""
    t = F.lower(F.trim(c))
    return t.rlike(r"^event:\s*\S") | t.isin("event", "acquisition", "merger", "launch", "announcement")


def event_role(rel):
    return F.when(F.lower(rel).startswith("role:"), F.substring(rel, 6, 1_000_000))


def events_for(g: Graph, node_id: str, event_types: list[str] | None = None) -> DataFrame:
    """(event_id, event_type, role, participants, documents): an entity's events (of some types), a row for each edge that joins it to one."""
    ev = g.nodes.where(is_event_type(F.col("type"))).select(F.col("node_id").alias("event_id"), F.substring("type", 7, 1_000_000).alias("event_type"))
    own = g.edges.where((F.col("target") == node_id) & F.col("rel").startswith("role:")).select(F.col("source").alias("event_id"), event_role(F.col("rel")).alias("role"), "edge_id")
    if event_types:
        ev = ev.where(F.lower("event_type").isin(*[t.lower() for t in event_types]))
    own = own.join(ev, "event_id")
    part = g.edges.where(F.col("rel").startswith("role:")).join(own.select(F.col("event_id").alias("source")).distinct(), "source", "left_semi")
    part = part.groupBy(F.col("source").alias("event_id")).agg(F.array_sort(F.collect_set("target")).alias("participants"), F.array_sort(F.collect_set("document_id")).alias("documents"))
    return own.join(part, "event_id").drop("edge_id")


def community_of(g: Graph, node_id: str) -> DataFrame:
    return with_cluster(g, g.nodes.where(F.col("node_id") == node_id)).select("node_id", "cluster_id")


def community_neighbors(g: Graph, node_id: str, limit: int = 20) -> DataFrame:
    """Other members of the node's cluster, by lower-case name."""
    own = community_of(g, node_id).select("cluster_id")
    return g.members.join(F.broadcast(own), "cluster_id", "left_semi").where(F.col("node_id") != node_id).select("node_id").distinct().orderBy(F.lower("node_id"), "node_id").limit(limit)


def related(g: Graph, node_id: str, mode: str = "shared_neighbors", limit: int = 10, entity_type: str | None = None, hops: int = 2) -> DataFrame:
    """(node_id, score): by shared neighbours, cluster, degree or shortest path."""
    if mode == "degree":
        rows = g.endpoints().groupBy("node_id").agg(F.count("*").cast("double").alias("score")).where(F.col("node_id") != node_id)
    elif mode == "same_community":
        rows = community_neighbors(g, node_id, 2**31 - 1).withColumn("score", F.lit(1.0))
    elif mode == "shortest_path":
        from .traversal import distances

        rows = distances(g, node_id, hops).where("hops > 0").select("node_id", (F.try_divide(F.lit(1.0), F.col("hops")) * F.coalesce("confidence", F.lit(1.0))).alias("score"))
    else:
        near = neighbors(g, node_id).select(F.col("node_id").alias("via"))
        ends = g.endpoints().select("node_id", F.col("other").alias("via")).distinct()
        rows = ends.join(near, "via").where(F.col("node_id") != node_id).groupBy("node_id").agg(F.count("*").cast("double").alias("score"))
    if entity_type:
        rows = rows.join(g.nodes.where(F.lower("type") == entity_type.lower()).select("node_id"), "node_id", "left_semi")
    else:
        rows = rows.join(g.nodes.select("node_id"), "node_id", "left_semi")
    return rows.orderBy(F.desc("score"), F.lower("node_id"), "node_id").limit(limit)


def rank(scores: DataFrame, limit: int = 10) -> DataFrame:
    """(node_id, score, rank): greatest first, then by lower-case name."""
    if limit < 1:
        limit = 1
    top = scores.select("node_id", "score").orderBy(F.desc("score"), F.lower("node_id"), "node_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.lower("node_id"), "node_id")).cast("bigint"))


def metric(name: str):
    from . import analytics

    known = {"degree": analytics.degree_centrality, "pagerank": analytics.pagerank, "influence": analytics.influence}
    if name not in known:
        raise QueryError(f"unknown metric: {name}")
    return known[name]
