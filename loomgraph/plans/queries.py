"""The registered queries over whole tables, each with the SQL for its rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import dates as D
from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.operators import analytics, build, evaluation, extraction, merge, provenance, reasoning, resolution, schema, search, temporal, traversal
from loomgraph.operators import events as ev
from loomgraph.operators import text as tx
from loomgraph.sources import exports, graph_json
from loomgraph.streaming.merge_stream import windowed_counts

from loomgraph.functions.json import js, obj
from loomgraph.graph import Graph, complete, full_edges, full_nodes

from .adapter import RICH, SQL, place_graph, rich_graph, table, trade_graph
from .registry import register

PLACE = SQL.replace("SELECT * FROM located UNION ALL SELECT * FROM supplies UNION ALL SELECT * FROM purchased", "SELECT * FROM located").replace("  UNION ALL SELECT 'part:' || p_partkey, 'Part', NULL FROM part\n", "")
ENDS = PLACE.rstrip() + ", ends AS (SELECT source AS node_id, target AS other, edge_id, rel FROM edges UNION ALL SELECT target, source, edge_id, rel FROM edges)\n"
ALL_ENDS = SQL.rstrip() + ", ends AS (SELECT source AS node_id, target AS other, edge_id, rel FROM edges UNION ALL SELECT target, source, edge_id, rel FROM edges)\n"


# ---- lookups and filters ----------------------------------------------------


@register("degree_centrality", ALL_ENDS + "SELECT node_id, round(count(other) / (SELECT greatest(1, count(*) - 1) FROM nodes), 9) AS score FROM nodes LEFT JOIN ends USING (node_id) GROUP BY node_id")
def _(spark, d):
    return analytics.degree_centrality(trade_graph(spark, d)).select("node_id", F.round("score", 9).alias("score"))


@register("degree_top10", ALL_ENDS + "SELECT node_id, score, row_number() OVER (ORDER BY score DESC, lower(node_id), node_id) AS rank FROM (SELECT node_id, round(count(other) / (SELECT greatest(1, count(*) - 1) FROM nodes), 9) AS score FROM nodes LEFT JOIN ends USING (node_id) GROUP BY node_id) ORDER BY rank LIMIT 10")
def _(spark, d):
    return search.rank(analytics.degree_centrality(trade_graph(spark, d)).withColumn("score", F.round("score", 9)), 10)


@register("entity_lookup", PLACE + "SELECT node_id, type, confidence, cluster_id FROM nodes LEFT JOIN members USING (node_id) WHERE node_id = 'customer:7'")
def _(spark, d):
    return search.entity(place_graph(spark, d), "customer:7").select("node_id", "type", "confidence", "cluster_id")


@register("relations_to", PLACE + "SELECT edge_id, source, target FROM edges WHERE target = 'nation:3' AND lower(rel) = 'located_in'")
def _(spark, d):
    return search.relations(place_graph(spark, d), target="nation:3", rel=" Located_In ").select("edge_id", "source", "target")


@register("incident_edges", SQL + "SELECT edge_id, 'out' AS direction FROM edges WHERE source = 'supplier:5' UNION ALL SELECT edge_id, 'in' FROM edges WHERE target = 'supplier:5'")
def _(spark, d):
    return search.incident(trade_graph(spark, d), "supplier:5").select("edge_id", "direction")


@register("neighbors", ALL_ENDS + "SELECT DISTINCT other AS node_id FROM ends WHERE node_id = 'part:10'")
def _(spark, d):
    return search.neighbors(trade_graph(spark, d), "part:10")


@register("shared_neighbors", ALL_ENDS + "SELECT other AS node_id FROM ends WHERE node_id = 'supplier:1' INTERSECT SELECT other FROM ends WHERE node_id = 'supplier:2'")
def _(spark, d):
    return search.shared_neighbors(trade_graph(spark, d), "supplier:1", "supplier:2")


@register("hide_inferred", PLACE + "SELECT edge_id, (SELECT count(*) FROM edges) AS n_inferred FROM edges")
def _(spark, d):
    g = place_graph(spark, d)
    both = reasoning.apply(g, reasoning.inverse(g))
    n = both.edges.where("inferred").agg(F.count("*").alias("n_inferred"))
    return search.relations(both, include_inferred=False).select("edge_id").crossJoin(n)


@register("edge_views", RICH + "SELECT edge_id, s.type AS source_type, t.type AS target_type, ms.cluster_id AS source_cluster, mt.cluster_id AS target_cluster, coalesce(document_id, '') AS documents, detail AS snippet FROM rich_edges LEFT JOIN nodes s ON s.node_id = source LEFT JOIN nodes t ON t.node_id = target LEFT JOIN members ms ON ms.node_id = source LEFT JOIN members mt ON mt.node_id = target")
def _(spark, d):
    v = search.edge_views(rich_graph(spark, d)).withColumn("documents", F.array_join("documents", ","))
    return v.select("edge_id", "source_type", "target_type", "source_cluster", "target_cluster", "documents", "snippet")


@register("find_entities", PLACE + """, q AS (SELECT node_id, type, lower(node_id) AS n, list_filter(string_split(replace(lower(node_id), ':', ' '), ' '), lambda x: len(x) > 1) AS toks FROM nodes),
s AS (SELECT node_id, type, CASE WHEN n = 'nation 12 customer' THEN 5.0 ELSE (CASE WHEN contains(n, 'nation 12 customer') OR contains('nation 12 customer', n) THEN 3.0 ELSE 0.0 END)
  + (CASE WHEN len(list_intersect(toks, ['nation', '12', 'customer'])) > 0 THEN 1.0 + 0.4 * len(list_intersect(toks, ['nation', '12', 'customer'])) ELSE 0.0 END) END AS score FROM q)
SELECT node_id, type, round(CAST(score AS DOUBLE), 4) AS score, row_number() OVER (ORDER BY score DESC, lower(node_id), node_id) AS rank FROM s WHERE score > 0 ORDER BY rank LIMIT 10""")
def _(spark, d):
    return search.find_entities(place_graph(spark, d), "nation 12 customer").withColumn("score", F.round("score", 4))


@register("search_edges", PLACE + "SELECT edge_id FROM edges WHERE source = 'nation:4' OR target = 'nation:4' ORDER BY edge_id LIMIT 40")
def _(spark, d):
    return search.search(place_graph(spark, d), "nation:4 (located_in)", k_entities=1).select("edge_id")


@register("community_neighbors", PLACE + "SELECT node_id FROM members WHERE cluster_id = (SELECT max(cluster_id) FROM members WHERE node_id = 'customer:7') AND node_id <> 'customer:7' ORDER BY lower(node_id), node_id LIMIT 20")
def _(spark, d):
    return search.community_neighbors(place_graph(spark, d), "customer:7")


@register("related_shared", ALL_ENDS + ", near AS (SELECT DISTINCT other AS via FROM ends WHERE node_id = 'supplier:1'), u AS (SELECT DISTINCT node_id, other AS via FROM ends) SELECT node_id, CAST(count(*) AS DOUBLE) AS score FROM u JOIN near USING (via) JOIN nodes USING (node_id) WHERE node_id <> 'supplier:1' GROUP BY node_id ORDER BY score DESC, lower(node_id), node_id LIMIT 10")
def _(spark, d):
    return search.related(trade_graph(spark, d), "supplier:1")


@register("related_degree", ALL_ENDS + "SELECT node_id, CAST(count(*) AS DOUBLE) AS score FROM ends JOIN nodes USING (node_id) WHERE node_id <> 'supplier:1' AND type = 'Part' GROUP BY node_id ORDER BY score DESC, lower(node_id), node_id LIMIT 10")
def _(spark, d):
    return search.related(trade_graph(spark, d), "supplier:1", "degree", entity_type="part")


@register("related_path", ENDS + ", h1 AS (SELECT DISTINCT other AS node_id FROM ends WHERE node_id = 'nation:1'), h2 AS (SELECT DISTINCT e.other AS node_id FROM ends e JOIN h1 USING (node_id) WHERE e.other <> 'nation:1' AND e.other NOT IN (SELECT node_id FROM h1)) SELECT node_id, CAST(CASE WHEN node_id LIKE 'region:%' THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score FROM h1 UNION ALL SELECT node_id, CAST(0.5 AS DOUBLE) FROM h2 ORDER BY score DESC, lower(node_id), node_id LIMIT 10")
def _(spark, d):
    return search.related(place_graph(spark, d), "nation:1", "shortest_path").withColumn("score", F.round("score", 6))


@register("evidence_bundle", RICH + "SELECT count(*) AS n_edges, string_agg(document_id, ',' ORDER BY edge_id) AS documents, string_agg(detail, ',' ORDER BY edge_id) AS snippets, max(confidence) AS confidence, 'Found ' || count(*) || ' edge(s) supporting customer:10 -[purchased]-> ' || min(target) || ' from ' || count(DISTINCT document_id) || ' source document(s).' AS summary FROM rich_edges WHERE source = 'customer:10' AND rel = 'purchased' AND target = (SELECT min(target) FROM purchased WHERE source = 'customer:10')")
def _(spark, d):
    g = rich_graph(spark, d)
    first = g.edges.where("source = 'customer:10' AND rel = 'purchased'").agg(F.min("target")).first()[0]
    b = provenance.bundle(g, "customer:10", "purchased", first or "")
    return b.select("n_edges", F.array_join("documents", ",").alias("documents"), F.array_join("evidence.snippet", ",").alias("snippets"), "confidence", "summary")


@register("edge_evidence", RICH + "SELECT edge_id, document_id AS source_ref, detail AS snippet, confidence, inferred, CASE WHEN document_id IS NULL THEN 0 ELSE 1 END AS n_documents FROM rich_edges")
def _(spark, d):
    return provenance.edge_evidence(rich_graph(spark, d)).select("edge_id", "source_ref", "snippet", "confidence", "inferred", F.size("documents").alias("n_documents"))


@register("attach_provenance", RICH + """SELECT edge_id, document_id AS block_document, 'loader' AS block_version, detail AS evidence, '["' || document_id || '"]' AS documents FROM rich_edges WHERE rel = 'purchased'""")
def _(spark, d):
    e = rich_graph(spark, d).edges.where("rel = 'purchased'")
    known = provenance.read(e)
    p = F.col("provenance").withField("extractor_version", F.lit("loader"))
    out = provenance.attach(known.withColumn("provenance", p))
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.select("edge_id", get("provenance.document_id").alias("block_document"), get("provenance.extractor_version").alias("block_version"), get("evidence").alias("evidence"), get("source_documents").alias("documents"))


@register("merge_provenance", RICH + "SELECT source, n_documents, n_evidence, cluster_id FROM (SELECT source, count(DISTINCT document_id) AS n_documents, count(*) AS n_evidence FROM (SELECT DISTINCT source, rel, target, document_id, detail FROM rich_edges) GROUP BY 1) LEFT JOIN members ON node_id = source")
def _(spark, d):
    g = rich_graph(spark, d)
    m = provenance.merge(provenance.evidence(g.edges), ["source"], members=g.members)
    return m.select("source", F.size(F.coalesce("documents", F.array())).cast("bigint").alias("n_documents"), F.size("evidence").cast("bigint").alias("n_evidence"), "cluster_id")


@register("search_answer", SQL + ", e AS (SELECT edge_id, source, target, document_id FROM edges WHERE source = 'nation:4' OR target = 'nation:4' ORDER BY edge_id LIMIT 40), n AS (SELECT count(*) AS n_edges, count(DISTINCT document_id) AS docs FROM e), v AS (SELECT count(*) AS n_entities FROM (SELECT source FROM e UNION SELECT target FROM e)) SELECT n_entities, n_edges, 'Found ' || n_edges || ' relation(s) between ' || n_entities || ' entities in ' || docs || ' document(s).' AS answer FROM n, v")
def _(spark, d):
    return search.answer(trade_graph(spark, d), "nation:4", k_entities=1).select("n_entities", "n_edges", "answer")


def event_graph(spark, d):
    """Events of the stream as event nodes, with their users."""
    e = table(spark, d, "events").select(
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), "event_type", F.create_map(F.lit("user"), F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")))).alias("participants"),
        F.date_format("ts", "yyyy-MM-dd").alias("ts_start"), F.date_format("ts", "yyyy-MM-dd").alias("ts_end"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("document_id"), F.lit(0.9).alias("confidence"),
    )
    from loomgraph.graph import Graph

    n, e2 = ev.project(e)
    users = e2.select(F.col("target").alias("node_id")).distinct().select("node_id", F.lit("User").alias("type"), F.lit(None).cast("double").alias("confidence"))
    return Graph(n.unionByName(users), e2, users.select(F.lit("u").alias("cluster_id"), "node_id").limit(0))


@register("events_of_entity", "SELECT 'event:' || event_id AS event_id, event_type, 'user' AS role, 'user:' || user_id AS participants FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def _(spark, d):
    user = table(spark, d, "events").agg(F.min("user_id")).first()[0]
    return search.events_for(event_graph(spark, d), f"user:{user}").withColumn("participants", F.array_join("participants", ",")).drop("documents")


@register("event_projection", "SELECT 'event:' || event_id AS source, 'role:user' AS rel, 'user:' || user_id AS target, strftime(ts, '%Y-%m-%d') AS valid_from FROM events")
def _(spark, d):
    return event_graph(spark, d).edges.select("source", "rel", "target", "valid_from")


@register("event_id", "SELECT event_id, 'event:' || event_type || ':' || substr(sha1(event_type || '|user=u' || user_id || '|' || strftime(ts, '%Y-%m-%d') || '|' || substr(sha1(''), 1, 8)), 1, 16) AS uid FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    p = F.create_map(F.lit("user"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    return e.select("event_id", ev.event_id(F.col("event_type"), p, F.date_format("ts", "yyyy-MM-dd"), F.lit(None).cast("string")).alias("uid"))


# ---- aggregates -------------------------------------------------------------


@register("graph_statistics", SQL + "SELECT n_nodes, n_edges, round(2.0 * n_edges / n_nodes, 4) AS avg_degree, round(n_edges / (n_nodes * (n_nodes - 1)), 4) AS density FROM (SELECT count(*) AS n_nodes FROM nodes), (SELECT count(*) AS n_edges FROM edges)")
def _(spark, d):
    return analytics.statistics(trade_graph(spark, d))


@register("type_counts", SQL + "SELECT 'node' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel")
def _(spark, d):
    return analytics.type_counts(trade_graph(spark, d))


@register("confidence_summary", SQL + "SELECT count(*) AS n, count(confidence) AS with_confidence, round(count(confidence) / count(*), 4) AS coverage, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS middle, count(*) FILTER (confidence >= 0.8) AS high, min(confidence) AS least, max(confidence) AS most, round(avg(confidence), 6) AS mean FROM edges")
def _(spark, d):
    return analytics.confidence_summary(trade_graph(spark, d).edges)


@register("ontology_types", SQL + "SELECT type, count(*) AS n, array_to_string(list_sort(list(node_id) FILTER (k <= 5)), ',') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY node_id) AS k FROM nodes) GROUP BY type")
def _(spark, d):
    return analytics.ontology_types(trade_graph(spark, d)).withColumn("examples", F.array_join("examples", ","))


@register("ontology_relations", RICH + "SELECT rel, s.type AS source_type, t.type AS target_type, count(*) AS n, max_by(detail, edge_id) AS detail FROM rich_edges JOIN nodes s ON s.node_id = source JOIN nodes t ON t.node_id = target GROUP BY 1, 2, 3")
def _(spark, d):
    return analytics.ontology_relations(rich_graph(spark, d))


COMMUNITY = ALL_ENDS + """, size AS (SELECT cluster_id, count(*) AS n_members FROM members GROUP BY 1),
inn AS (SELECT s.cluster_id, count(*) AS k FROM edges JOIN members s ON s.node_id = source JOIN members t ON t.node_id = target WHERE s.cluster_id = t.cluster_id GROUP BY 1),
act AS (SELECT cluster_id, node_id, row_number() OVER (PARTITION BY cluster_id ORDER BY d DESC, lower(node_id)) AS r FROM members JOIN (SELECT node_id, count(*) AS d FROM ends GROUP BY 1) USING (node_id)),
top AS (SELECT cluster_id, string_agg(node_id, ', ' ORDER BY r) AS top_actors FROM act WHERE r <= 3 GROUP BY 1),
kinds AS (SELECT cluster_id, string_agg(type, ', ' ORDER BY n DESC, type) AS themes FROM (SELECT cluster_id, type, count(*) AS n FROM members JOIN nodes USING (node_id) GROUP BY 1, 2) GROUP BY 1)
"""


@register("community_report", COMMUNITY + "SELECT cluster_id, n_members, coalesce(k, 0) AS n_internal, CASE WHEN n_members > 1 THEN round(coalesce(k, 0) / (n_members * (n_members - 1)), 6) ELSE 0.0 END AS density, coalesce(top_actors, '') AS top_actors, '' AS top_relations, themes FROM size LEFT JOIN inn USING (cluster_id) LEFT JOIN top USING (cluster_id) LEFT JOIN kinds USING (cluster_id)")
def _(spark, d):
    return analytics.community_report(trade_graph(spark, d))


@register("community_text", COMMUNITY + "SELECT cluster_id, printf('Community %s: %d members, %d internal relations (density %.4f). Most connected: %s.', cluster_id, n_members, coalesce(k, 0), CASE WHEN n_members > 1 THEN round(coalesce(k, 0) / (n_members * (n_members - 1)), 6) ELSE 0.0 END, coalesce(top_actors, '')) AS text FROM size LEFT JOIN inn USING (cluster_id) LEFT JOIN top USING (cluster_id)")
def _(spark, d):
    return analytics.report_text(analytics.community_report(trade_graph(spark, d)))


@register("cluster_summary", SQL + ", m AS (SELECT 'part' || (CAST(split_part(node_id, ':', 2) AS BIGINT) % 3) AS cluster_id, node_id FROM nodes WHERE type IN ('Customer', 'Part')), h AS (SELECT cluster_id, string_agg(node_id, ', ' ORDER BY node_id) FILTER (k <= 10) AS first_members, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY node_id) AS k FROM m) GROUP BY 1), t AS (SELECT a.cluster_id, source, rel, target, count(*) AS c FROM edges JOIN m a ON a.node_id = source JOIN m b ON b.node_id = target WHERE a.cluster_id = b.cluster_id GROUP BY ALL), r AS (SELECT cluster_id, sum(c) AS e, string_agg(source || ' ' || rel || ' ' || target, ', ' ORDER BY k) FILTER (k <= 5) AS top_triples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, source, rel, target) AS k FROM t) GROUP BY 1) SELECT cluster_id, first_members, coalesce(top_triples, '') AS top_triples, round(coalesce(e, 0) / (n * (n - 1) / 2), 6) AS density FROM h LEFT JOIN r USING (cluster_id)")
def _(spark, d):
    g = trade_graph(spark, d)
    m = g.nodes.where("type IN ('Customer', 'Part')").select(F.concat(F.lit("part"), (F.regexp_extract("node_id", r":(\d+)$", 1).cast("bigint") % 3).cast("string")).alias("cluster_id"), "node_id")
    return analytics.cluster_summary(Graph(g.nodes, g.edges, m))


@register("hub_dominance", SQL + ", b AS (SELECT source, count(*) AS n FROM edges GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS n_triples, round(max(n) / sum(n), 6) AS top_share, round(count(*) / sum(n), 6) AS diversity FROM b) SELECT *, top_share > 0.3 OR diversity < 0.5 AS dominated FROM s")
def _(spark, d):
    return analytics.hub_dominance(trade_graph(spark, d).edges)


def _labels_sql(rounds: int) -> str:
    """Least labels along the edges as generated common table expressions; every two nodes of a component are within as many steps."""
    s = ALL_ENDS + ", adj AS MATERIALIZED (SELECT DISTINCT node_id, other FROM ends UNION SELECT node_id, node_id FROM nodes), l0 AS (SELECT node_id, node_id AS component FROM nodes)"
    for k in range(1, rounds + 1):
        s += f", l{k} AS MATERIALIZED (SELECT a.node_id, min(l.component) AS component FROM adj a JOIN l{k - 1} l ON l.node_id = a.other GROUP BY 1)"
    return s


@register("components", _labels_sql(8) + " SELECT node_id, component FROM l8")
def _(spark, d):
    return analytics.components(trade_graph(spark, d))


@register("auto_clusters", PLACE + ", up AS (SELECT n.node_id, coalesce(e2.target, e1.target, n.node_id) AS region FROM nodes n LEFT JOIN edges e1 ON e1.source = n.node_id LEFT JOIN edges e2 ON e2.source = e1.target), s AS (SELECT region, count(*) AS n, min(lower(node_id)) AS first FROM up GROUP BY 1 HAVING count(*) >= 2) SELECT 'cc_' || k AS cluster_id, node_id FROM up JOIN (SELECT region, row_number() OVER (ORDER BY n DESC, first) AS k FROM s) USING (region) WHERE k <= 12")
def _(spark, d):
    return analytics.auto_clusters(place_graph(spark, d))


@register("label_propagation")
def _(spark, d):
    return analytics.label_propagation(trade_graph(spark, d))


@register("louvain")
def _(spark, d):
    return analytics.louvain(place_graph(spark, d))


@register("modularity", ENDS + ", w AS (SELECT node_id, other, count(*)::DOUBLE AS w FROM ends WHERE node_id <> other GROUP BY 1, 2), j AS (SELECT a.type AS c1, b.type AS c2, w FROM w JOIN nodes a USING (node_id) JOIN nodes b ON b.node_id = other), p AS (SELECT c1, sum(w) AS d, coalesce(sum(w) FILTER (c1 = c2), 0) AS i FROM j GROUP BY 1) SELECT round(sum(i) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 6) AS modularity FROM p")
def _(spark, d):
    g = place_graph(spark, d)
    return analytics.modularity(g, g.nodes.select("node_id", F.col("type").alias("community")))


def _ranks_sql(rounds: int) -> str:
    """PageRank as generated common table expressions; nodes without edges give their rank to all."""
    s = ALL_ENDS + ", adj AS MATERIALIZED (SELECT DISTINCT node_id, other FROM ends), deg AS (SELECT node_id, count(*) AS out FROM adj GROUP BY 1), r0 AS (SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes)"
    for k in range(1, rounds + 1):
        s += f", r{k} AS MATERIALIZED (SELECT n.node_id, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(sum(r.score / d.out), 0) + (SELECT coalesce(sum(score), 0) FROM r{k - 1} WHERE node_id NOT IN (SELECT node_id FROM deg)) / (SELECT count(*) FROM nodes)) AS score FROM nodes n LEFT JOIN adj a ON a.other = n.node_id LEFT JOIN r{k - 1} r ON r.node_id = a.node_id LEFT JOIN deg d ON d.node_id = a.node_id GROUP BY 1)"
    return s


@register("pagerank", _ranks_sql(30) + " SELECT node_id, round(score, 9) AS score FROM r30")
def _(spark, d):
    return analytics.pagerank(trade_graph(spark, d)).withColumn("score", F.round("score", 9))


@register("influence_top10", _ranks_sql(30) + ", dc AS (SELECT node_id, count(other) / (SELECT count(*) - 1 FROM nodes) AS c FROM nodes LEFT JOIN ends USING (node_id) GROUP BY 1), s AS (SELECT node_id, round(0.6 * score / (SELECT max(score) FROM r30) + 0.4 * c, 7) AS score FROM r30 JOIN dc USING (node_id)) SELECT node_id, score, row_number() OVER (ORDER BY score DESC, lower(node_id), node_id) AS rank FROM s ORDER BY rank LIMIT 10")
def _(spark, d):
    return search.rank(analytics.influence(trade_graph(spark, d)).withColumn("score", F.round("score", 7)), 10)


# ---- traversal --------------------------------------------------------------


@register("k_hop", PLACE + ", a AS (SELECT DISTINCT source, rel, target, 1 AS hop FROM edges WHERE source = 'customer:7' OR target = 'customer:7'), b AS (SELECT DISTINCT e.source, e.rel, e.target, 2 AS hop FROM edges e WHERE (e.source = (SELECT target FROM a) OR e.target = (SELECT target FROM a)) AND e.source <> 'customer:7') SELECT * FROM a UNION ALL SELECT * FROM b")
def _(spark, d):
    return traversal.k_hop(place_graph(spark, d), "customer:7", hops=2)


@register("distances", """WITH RECURSIVE """ + ENDS[5:] + ", w(node_id, hops) AS (SELECT 'nation:3', 0 UNION SELECT e.other, w.hops + 1 FROM w JOIN ends e USING (node_id) WHERE w.hops < 3) SELECT node_id, min(hops) AS hops FROM w GROUP BY 1")
def _(spark, d):
    return traversal.distances(place_graph(spark, d), "nation:3", 3).select("node_id", "hops")


PATHS = """WITH RECURSIVE """ + ENDS[5:] + ", w(tip, nodes, hops) AS (SELECT 'nation:3', ['nation:3'], 0 UNION ALL SELECT e.other, list_append(w.nodes, e.other), w.hops + 1 FROM w JOIN ends e ON e.node_id = w.tip WHERE w.hops < 4 AND NOT list_contains(w.nodes, e.other) AND w.tip <> 'nation:8')"


@register("find_paths", ALL_ENDS + "SELECT 'supplier:1>' || a.other || '>customer:10' AS path, a.rel || '>' || b.rel AS rels, a.edge_id || '>' || b.edge_id AS edges, CAST(2 AS INTEGER) AS hops FROM ends a JOIN ends b ON a.other = b.node_id WHERE a.node_id = 'supplier:1' AND b.other = 'customer:10'")
def _(spark, d):
    p = traversal.find_paths(trade_graph(spark, d), "supplier:1", "customer:10", max_hops=2, max_paths=1_000_000)
    return p.select(F.array_join("nodes", ">").alias("path"), F.array_join("rels", ">").alias("rels"), F.array_join("edges", ">").alias("edges"), F.col("hops").cast("int").alias("hops"))


@register("shortest_path", PATHS + " SELECT array_to_string(nodes, '>') AS path, hops FROM w WHERE tip = 'nation:8' ORDER BY hops, path LIMIT 1")
def _(spark, d):
    p = traversal.shortest_path(place_graph(spark, d), "nation:3", "nation:8", max_hops=4)
    return p.select(F.array_join("nodes", ">").alias("path"), F.col("hops").cast("int").alias("hops"))


@register("explain", RICH + "SELECT 'customer:10 is connected to ' || t || ' over 1 hop(s) (customer:10 > ' || t || '). Source document(s): ' || document_id || '.' AS sentence, 1 AS n_evidence, false AS same_cluster FROM purchased, (SELECT min(target) AS t FROM purchased WHERE source = 'customer:10') WHERE source = 'customer:10' AND target = t")
def _(spark, d):
    g = rich_graph(spark, d)
    first = g.edges.where("source = 'customer:10' AND rel = 'purchased'").agg(F.min("target")).first()[0]
    return traversal.explain(g, "customer:10", first, max_hops=1, max_paths=1000).select("sentence", F.col("n_evidence").cast("int").alias("n_evidence"), "same_cluster")


# ---- time -------------------------------------------------------------------

ACTIVE = "(valid_from IS NULL AND valid_to IS NULL) OR (coalesce(valid_from, '0000') <= '{0}' AND coalesce(valid_to, '9999-99') >= '{0}')"


@register("active_at", SQL + f"SELECT edge_id FROM edges WHERE {ACTIVE.format('1996-06-15')}")
def _(spark, d):
    return temporal.active_at(trade_graph(spark, d).edges, "1996-06-15").select("edge_id")


@register("role_holders", SQL + "SELECT DISTINCT source AS holder FROM purchased WHERE target = 'part:20' AND valid_from <= '1996-12-31' AND valid_to >= '1996-01-01'")
def _(spark, d):
    return temporal.role_holders(trade_graph(spark, d), "purchased", "part:20", "1996")


@register("timeline", SQL + "SELECT edge_id, valid_from, valid_to FROM edges WHERE source = 'customer:10' AND valid_from IS NOT NULL")
def _(spark, d):
    return temporal.timeline(trade_graph(spark, d).edges, "customer:10").select("edge_id", "valid_from", "valid_to")


@register("changes", SQL + f", x AS (SELECT edge_id, ({ACTIVE.format('1996-01-01')}) AS a, ({ACTIVE.format('1997-01-01')}) AS b FROM edges) SELECT edge_id, CASE WHEN b THEN 'started' ELSE 'ended' END AS change FROM x WHERE a <> b")
def _(spark, d):
    return temporal.changes(trade_graph(spark, d).edges, "1996-01-01", "1997-01-01").select("edge_id", "change")


@register("overlaps", SQL + "SELECT a.edge_id, b.edge_id AS edge_id_2 FROM purchased a JOIN purchased b ON a.source = b.source AND a.target = b.target AND a.edge_id < b.edge_id AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to")
def _(spark, d):
    return temporal.overlaps(trade_graph(spark, d).edges)


@register("conflicts", SQL + "SELECT a.edge_id, b.edge_id AS edge_id_2 FROM purchased a JOIN purchased b ON a.target = b.target AND a.source <> b.source AND a.edge_id < b.edge_id AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to AND a.valid_to <> b.valid_from AND b.valid_to <> a.valid_from")
def _(spark, d):
    return temporal.conflicts(trade_graph(spark, d).edges)


@register("transitions", SQL + "SELECT edge_id FROM purchased WHERE source = 'customer:10'")
def _(spark, d):
    return temporal.transitions(trade_graph(spark, d).edges, "customer:10").select("edge_id")


@register("temporal_question", SQL + "SELECT edge_id FROM purchased WHERE target = 'part:20' AND valid_from <= '1996-12-31' AND valid_to >= '1996-01-01'")
def _(spark, d):
    g = trade_graph(spark, d)
    held = g.edges.where("rel = 'purchased'").withColumn("rel", F.lit("BUYER_OF"))
    return temporal.ask(g.with_edges(held), "who was buyer of part:20 in 1996?").select("edge_id")


@register("temporal_scope", SQL + "SELECT edge_id, coalesce(valid_from, '1990') AS valid_from, CASE WHEN valid_from IS NULL THEN '1995-03' ELSE valid_to END AS valid_to, CASE WHEN valid_from IS NULL THEN 'year' ELSE 'day' END AS precision_from FROM edges")
def _(spark, d):
    e = full_edges(trade_graph(spark, d).edges)
    block = obj(temporal=obj(start=js(F.lit("1990")), end=js(F.lit("1995-03"))))
    e = e.withColumn("metadata", F.when(F.col("valid_from").isNull(), block))
    return temporal.scoped(e).select("edge_id", "valid_from", "valid_to", "precision_from")


@register("migrate_dates", SQL + """SELECT edge_id, CASE WHEN valid_from IS NOT NULL THEN '{"temporal":{"valid_from":"' || valid_from || '","valid_to":"' || valid_to || '"}}' END AS metadata FROM edges""")
def _(spark, d):
    return temporal.migrate(temporal.migrate(trade_graph(spark, d).edges)).select("edge_id", "metadata")


@register("date_spans", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, CAST(CAST(strftime(o_orderdate, '%Y') AS INT) + 2 AS VARCHAR) AS y2, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def _(spark, d):
    say = lambda p: F.date_format("o_orderdate", p)
    later = (F.year("o_orderdate") + 2).cast("string")
    span = D.parse_span(F.concat(later, F.lit(" - "), say("yyyy")))
    return table(spark, d, "orders").select(
        "o_orderkey", span["start"].alias("y"), span["end"].alias("y2"), D.parse_span(F.concat(F.lit("in "), say("MMMM yyyy")))["end"].alias("m"),
        F.when(D.parse_span(say("d MMM yyyy"))["precision"] == "day", D.parse_span(say("d MMM yyyy"))["start"]).alias("d"),
    )


@register("year_scopes", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS first, CAST(CAST(strftime(o_orderdate, '%Y') AS INT) + 1 AS VARCHAR) AS last, CAST(NULL AS VARCHAR) AS other FROM orders")
def _(spark, d):
    y = F.date_format("o_orderdate", "yyyy")
    text = F.concat(F.lit("she led the firm from "), y, F.lit(" to "), (F.year("o_orderdate") + 1).cast("string"))
    s = D.year_scope(text, F.lit("led_by"))
    return table(spark, d, "orders").select("o_orderkey", s["start"].alias("first"), s["end"].alias("last"), D.year_scope(text, F.lit("born_in"))["start"].alias("other"))


@register("partial_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-01-01' AS year_lo, strftime(o_orderdate, '%Y') || '-12-31' AS year_hi, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS month_hi, 'month' AS kind FROM orders")
def _(spark, d):
    y, m = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, d, "orders").select("o_orderkey", D.lo(y).alias("year_lo"), D.hi(y).alias("year_hi"), D.hi(m).alias("month_hi"), D.precision(m).alias("kind"))


@register("parse_timestamps", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m') AS b FROM orders")
def _(spark, d):
    say = lambda p: D.parse_timestamp(F.concat(F.lit("it was on "), F.date_format("o_orderdate", p)))
    return table(spark, d, "orders").select("o_orderkey", say("MMMM d, yyyy").alias("a"), say("MMM yyyy").alias("b"))


# ---- rules ------------------------------------------------------------------


@register("rule_inverse", PLACE + "SELECT target AS source, 'location_of' AS rel, source AS target, round(coalesce(confidence, 0.5) * 0.9, 4) AS confidence FROM edges")
def _(spark, d):
    return reasoning.inverse(place_graph(spark, d)).select("source", "rel", "target", "confidence")


@register("rule_transitive", PLACE + "SELECT a.source, 'located_in' AS rel, b.target, round(coalesce(a.confidence, 0.5) * coalesce(b.confidence, 0.5) * 0.85, 4) AS confidence, a.target AS via FROM edges a JOIN edges b ON a.target = b.source")
def _(spark, d):
    return reasoning.transitive(place_graph(spark, d)).select("source", "rel", "target", "confidence", "via")


@register("rule_bridge", SQL + ", h AS (SELECT a.source, b.target, min(a.edge_id || '|' || b.edge_id) AS support, count(*) AS n_same FROM edges a JOIN edges b ON a.target = b.source WHERE a.source <> b.target GROUP BY 1, 2) SELECT h.source, 'connected_via' AS rel, h.target, n_same, support, a.target AS via, round(coalesce(a.confidence, 0.5) * coalesce(b.confidence, 0.5) * 0.8, 3) AS confidence FROM h JOIN edges a ON a.edge_id = split_part(support, '|', 1) JOIN edges b ON b.edge_id = split_part(support, '|', 2)")
def _(spark, d):
    return reasoning.path_bridge(trade_graph(spark, d)).select("source", "rel", "target", "n_same", "support", "via", F.round("confidence", 3).alias("confidence"))


@register("stamped_inference", PLACE + """SELECT '~inverse:' || target || '>location_of>' || source AS edge_id, '{"inferred":true,"inference":{"rule":"inverse","composed_from":["' || edge_id || '"],"confidence":' || round(coalesce(confidence, 0.5) * 0.9, 4) || '}}' AS metadata FROM edges""")
def _(spark, d):
    g = place_graph(spark, d)
    return reasoning.apply(g, reasoning.inverse(g)).edges.where("inferred").select("edge_id", "metadata")


def member_graph(spark, d):
    """Users as members of nations and of one another's circle, besides the places."""
    g = place_graph(spark, d)
    u = table(spark, d, "events").select("user_id").distinct()
    name = lambda c: F.concat(F.lit("user:"), c.cast("string"))
    m = u.select(name(F.col("user_id")).alias("source"), F.lit("member_of").alias("rel"), F.concat(F.lit("nation:"), (F.col("user_id") % 25).cast("string")).alias("target"))
    m = m.unionByName(u.select(name(F.col("user_id")).alias("source"), F.lit("related_to").alias("rel"), name(F.col("user_id") + 25).alias("target")))
    m = m.withColumn("edge_id", F.concat_ws(">", "source", "rel", "target")).withColumn("confidence", F.lit(0.8))
    from loomgraph.graph import Graph, complete

    users = u.select(name(F.col("user_id")).alias("node_id"), F.lit("User").alias("type"), F.lit(None).cast("double").alias("confidence"))
    return Graph(g.nodes.unionByName(users), g.edges.unionByName(complete(m)), g.members)


@register("rule_composition", PLACE + ", u AS (SELECT DISTINCT user_id FROM events) SELECT 'user:' || user_id AS source, 'active_in' AS rel, target, CAST(round(0.8 * 0.5 * 0.75, 4) AS DOUBLE) AS confidence FROM u JOIN edges ON source = 'nation:' || (user_id % 25)")
def _(spark, d):
    return reasoning.composition(member_graph(spark, d)).select("source", "rel", "target", "confidence")


@register("rule_symmetric", "SELECT 'user:' || (user_id + 25) AS source, 'related_to' AS rel, 'user:' || user_id AS target, CAST(round(0.8 * 0.95, 4) AS DOUBLE) AS confidence FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return reasoning.symmetric(member_graph(spark, d)).select("source", "rel", "target", "confidence")


@register("infer_and_apply", PLACE + "SELECT 'location_of' AS rel, count(*) AS n FROM edges UNION ALL SELECT 'located_in', count(*) + (SELECT count(*) FROM edges a JOIN edges b ON a.target = b.source) FROM edges")
def _(spark, d):
    g = place_graph(spark, d)
    done = reasoning.apply(g, reasoning.infer(g, ("inverse", "transitive")))
    return done.edges.groupBy("rel").agg(F.count("*").alias("n"))


# ---- building ---------------------------------------------------------------


def allowed(spark):
    return spark.createDataFrame([("purchased", "Customer", "Part"), ("supplies", "Supplier", "Part"), ("LOCATED_IN", "Customer", "Nation")], "name string, src string, dst string")


def sorted_json(column: str, keys: tuple[str, ...]):
    """Some fields of a JSON object in a given order."""
    lists = lambda k: F.get_json_object(column, f"$.{k}")
    return obj(**{k: F.when(lists(k).startswith("["), lists(k)).otherwise(js(lists(k))) for k in keys})


@register("schema_filter", SQL + "SELECT DISTINCT source AS s, rel AS r, target AS o FROM edges WHERE rel IN ('purchased', 'supplies') OR source LIKE 'customer:%'")
def _(spark, d):
    g = trade_graph(spark, d)
    t = g.edges.select(F.col("source").alias("s"), F.col("rel").alias("r"), F.col("target").alias("o"))
    return build.schema_filter(t, g.nodes.select(F.col("node_id").alias("name"), "type"), allowed(spark))


@register("turn_reversed", SQL + "SELECT target AS s, 'supplied_by' AS r, source AS o FROM supplies UNION ALL SELECT source, rel, target FROM located UNION ALL SELECT target, 'purchased_by', source FROM purchased")
def _(spark, d):
    t = trade_graph(spark, d).edges.select(F.col("source").alias("s"), F.when(F.col("rel") == "purchased", "purchase").when(F.col("rel") == "supplies", "has_part").otherwise(F.col("rel")).alias("r"), F.col("target").alias("o"))
    t = t.withColumn("r", F.when(F.col("r") == "has_part", "supplier_of").otherwise(F.col("r")))
    names = spark.createDataFrame([("has_supplier", "a", "b"), ("located_in", "a", "b"), ("purchased_by", "a", "b")], "name string, src string, dst string")
    return build.turn_reversed(t, names).withColumn("r", F.when(F.col("r") == "has_supplier", "supplied_by").otherwise(F.col("r")))


@register("drop_doubtful", SQL + "SELECT edge_id FROM edges WHERE confidence IS NULL OR confidence >= 0.95")
def _(spark, d):
    e = trade_graph(spark, d).edges.withColumn("is_negated", F.lit(False))
    return build.drop_doubtful(e, 0.95).select("edge_id")


@register("first_triples", SQL + "SELECT min(edge_id) AS edge_id FROM edges GROUP BY source, rel, target")
def _(spark, d):
    return build.first_triples(trade_graph(spark, d).edges).select("edge_id")


@register("one_per_pair", SQL + "SELECT edge_id FROM (SELECT edge_id, row_number() OVER (PARTITION BY least(lower(source), lower(target)), greatest(lower(source), lower(target)), coalesce(document_id, '') ORDER BY coalesce(confidence, 0) DESC, edge_id) AS k FROM edges) WHERE k = 1")
def _(spark, d):
    return build.one_per_pair(trade_graph(spark, d).edges).select("edge_id")


@register("prune_isolated", ALL_ENDS + "SELECT node_id FROM nodes WHERE node_id IN (SELECT node_id FROM ends)")
def _(spark, d):
    return build.prune_isolated(trade_graph(spark, d)).nodes.select("node_id")


@register("canonical_names", PLACE + "SELECT CASE WHEN source = 'nation:1' THEN 'nation:0' ELSE source END AS source, rel, CASE WHEN target = 'nation:1' THEN 'nation:0' ELSE target END AS target FROM edges GROUP BY 1, 2, 3")
def _(spark, d):
    return build.canonical(place_graph(spark, d).edges, spark.createDataFrame([("nation:1", "nation:0")], "name string, canonical string")).select("source", "rel", "target")


@register("relation_confidence", SQL + "SELECT edge_id, round(coalesce(confidence, 0.5 + 0.1 + CASE WHEN rel IN ('purchased', 'supplies') OR source LIKE 'customer:%' THEN 0.2 ELSE 0 END + CASE WHEN valid_from IS NOT NULL THEN 0.05 ELSE 0 END), 4) AS confidence FROM (SELECT * REPLACE (CASE WHEN confidence >= 0.95 THEN confidence END AS confidence) FROM edges)")
def _(spark, d):
    g = trade_graph(spark, d)
    e = g.edges.withColumn("confidence", F.when(F.col("confidence") >= 0.95, F.col("confidence")))
    return build.relation_confidence(e, g.nodes, allowed(spark)).select("edge_id", "confidence")


@register("entity_confidence", SQL + "SELECT node_id, round(coalesce(confidence, CASE WHEN type = 'Nation' THEN 0.85 ELSE 0.75 END), 4) AS confidence FROM nodes")
def _(spark, d):
    types = spark.createDataFrame([("Region",), ("Nation",), ("Part",)], "name string")
    said = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("They live in nation:"), F.col("n_nationkey").cast("string"), F.lit(", far away.")).alias("text"))
    return build.entity_confidence(trade_graph(spark, d).nodes, types, said).select("node_id", "confidence")


@register("candidate_pairs", PLACE + "SELECT 'located_in' AS name, a.node_id AS source, b.node_id AS target FROM nodes a, nodes b WHERE a.type = 'Nation' AND b.type = 'Region'")
def _(spark, d):
    names = spark.createDataFrame([("located_in", "Nation", "Region")], "name string, src string, dst string")
    return build.candidate_pairs(place_graph(spark, d).nodes, names)


@register("split_hubs", ENDS + ", h AS (SELECT node_id FROM ends GROUP BY 1 HAVING count(*) >= 10), e AS (SELECT source, rel, target, source IN (SELECT node_id FROM h) AS hs, target IN (SELECT node_id FROM h) AS ht FROM edges), p AS (SELECT *, 'proxy:' || source || '::' || rel AS ps, 'proxy:' || target || '::' || rel AS pt FROM e) SELECT CASE WHEN hs THEN ps ELSE source END AS source, rel, CASE WHEN ht THEN pt ELSE target END AS target FROM p UNION SELECT source, 'has_proxy', ps FROM p WHERE hs UNION SELECT target, 'has_proxy', pt FROM p WHERE ht")
def _(spark, d):
    return build.split_hubs(place_graph(spark, d))


@register("join_hubs", PLACE + "SELECT DISTINCT source, rel, target FROM edges")
def _(spark, d):
    return build.join_hubs(build.split_hubs(place_graph(spark, d)))


@register("validate", SQL + """, n AS (SELECT * FROM nodes WHERE node_id <> 'nation:3' UNION ALL SELECT * FROM nodes WHERE type = 'Region'), d AS (SELECT source || ' ' || rel || ' ' || target AS s, unnest(range(1, count(*))) AS k FROM edges GROUP BY source, rel, target HAVING count(*) > 1)
SELECT 'warning' AS severity, 'duplicate_edge' AS code, s AS subject FROM d UNION ALL SELECT 'error', 'edge_target_missing_node', edge_id FROM edges WHERE target = 'nation:3' UNION ALL SELECT 'error', 'edge_source_missing_node', edge_id FROM edges WHERE source = 'nation:3'
UNION ALL SELECT 'error', 'duplicate_node_id', node_id FROM nodes WHERE type = 'Region' UNION ALL SELECT 'error', 'cluster_member_missing_node', 'x nation:3'""")
def _(spark, d):
    g = trade_graph(spark, d)
    n = g.nodes.where("node_id <> 'nation:3'").unionByName(g.nodes.where("type = 'Region'"))
    extra = spark.createDataFrame([("x", "nation:3")], "cluster_id string, node_id string")
    return build.validate(Graph(n, g.edges, g.members.select("cluster_id", "node_id").unionByName(extra)))


@register("build_graph", SQL + """, t AS (SELECT document_id, source, target, max(confidence) AS c FROM purchased GROUP BY ALL), f AS (SELECT source, target, min_by(c, 'purchased' || document_id) AS c, min_by(document_id, document_id) AS doc FROM t GROUP BY 1, 2)
SELECT source, 'purchased' AS rel, target, round(c, 4) AS confidence, doc AS document_id, source || ' purchased ' || target || '.' AS snippet FROM f""")
def _(spark, d):
    p = trade_graph(spark, d).edges.where("rel = 'purchased'").select(F.col("document_id").alias("doc_id"), F.col("source").alias("s"), F.col("rel").alias("r"), F.col("target").alias("o"), "confidence")
    p = p.groupBy("doc_id", "s", "r", "o").agg(F.max("confidence").alias("confidence"))
    docs = p.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("s", F.lit(" purchased "), "o", F.lit(".")))), " ").alias("text"))
    said = p.select("doc_id", F.col("s").alias("name"), F.lit("Customer").alias("type")).union(p.select("doc_id", "o", F.lit("Part"))).distinct()
    names = spark.createDataFrame([("purchased", "Customer", "Part")], "name string, src string, dst string")
    g = build.build_graph(said, p, docs, names)
    return g.edges.select("source", "rel", "target", F.round("confidence", 4).alias("confidence"), "document_id", F.get_json_object("metadata", "$.provenance.snippet").alias("snippet"))


@register("diff_snapshots", PLACE + "SELECT 'node' AS kind, node_id AS key, 'removed' AS change FROM nodes WHERE type = 'Region' UNION ALL SELECT 'edge', source || ' ' || rel || ' ' || target, 'changed' FROM edges WHERE confidence IS NOT NULL UNION ALL SELECT 'edge', source || ' ' || rel || ' ' || target, 'removed' FROM edges WHERE confidence IS NULL")
def _(spark, d):
    g = place_graph(spark, d)
    from loomgraph.graph import Graph

    new = Graph(g.nodes.where("type <> 'Region'"), g.edges.where("confidence IS NOT NULL").withColumn("confidence", F.col("confidence") / 2), g.members)
    return merge.diff_graphs(g, new)


@register("merge_nodes", PLACE + "SELECT upper(node_id) AS node_id, node_id AS matched, 'normalized' AS match_type FROM nodes")
def _(spark, d):
    g = place_graph(spark, d)
    return merge.match_nodes(g.nodes, g.nodes.withColumn("node_id", F.upper("node_id")))


@register("merge_graphs", SQL + "SELECT edge_id, greatest(confidence, 0.95) AS confidence FROM edges WHERE rel <> 'purchased' UNION ALL SELECT edge_id, CASE WHEN edge_id = (min(edge_id) OVER (PARTITION BY source, target)) THEN greatest(confidence, 0.95) ELSE confidence END FROM purchased")
def _(spark, d):
    g = trade_graph(spark, d)
    new = g.edges.select(*[F.upper(c).alias(c) if c in ("source", "target") else F.col(c) for c in g.edges.columns]).withColumn("confidence", F.lit(0.95))
    return merge.merge(g, Graph(g.nodes.withColumn("node_id", F.upper("node_id")), new, g.members)).edges.select("edge_id", "confidence")


@register("merge_append_evidence", RICH + """, f AS (SELECT source, target, min(edge_id) AS edge_id FROM purchased GROUP BY 1, 2)
SELECT e.edge_id, CASE WHEN f.edge_id IS NULL THEN '{"evidence":"' || detail || '","source_ref":"' || document_id || '"}' ELSE '{"evidence_refs":[{"evidence":"again","source_ref":"second"}],"evidence":"' || detail || '","source_ref":"' || document_id || '"}' END AS metadata FROM rich_edges e LEFT JOIN f USING (edge_id) WHERE rel = 'purchased'""")
def _(spark, d):
    g = rich_graph(spark, d)
    e = g.edges.where("rel = 'purchased'")
    again = e.withColumns({"metadata": F.lit('{"source_ref":"second","evidence":"again"}'), "confidence": F.lit(None).cast("double")})
    m = merge.merge_edges(e, again, g.nodes.select("node_id", F.col("node_id").alias("matched")))
    return m.select("edge_id", sorted_json("metadata", ("evidence_refs", "evidence", "source_ref")).alias("metadata"))


@register("merge_union_properties", RICH + """SELECT node_id, CASE WHEN type = 'Customer' THEN json_extract_string(properties, '$.segment') END AS segment, 'new' AS grade, '["' || lower(type) || '","update"]' AS documents, greatest(confidence, 0.6) AS confidence FROM rich_nodes WHERE type IN ('Customer', 'Supplier')""")
def _(spark, d):
    n = rich_graph(spark, d).nodes.where("type IN ('Customer', 'Supplier')")
    new = n.withColumns({"properties": F.lit('{"grade":"new"}'), "confidence": F.lit(0.6), "metadata": F.lit(None).cast("string"), "source_documents": F.lit(None).cast("array<string>")})
    m = merge.merge_nodes(n, new, merge.match_nodes(n, new), "union", "update")
    p = lambda k: F.get_json_object("properties", f"$.{k}")
    return m.select("node_id", p("segment").alias("segment"), p("grade").alias("grade"), F.to_json("source_documents").alias("documents"), "confidence")


@register("merge_prefer_existing", RICH + """SELECT node_id, type, properties, '[{"id":"' || node_id || '","type":"Other"}]' AS merged_from FROM rich_nodes WHERE type = 'Part'""")
def _(spark, d):
    n = rich_graph(spark, d).nodes.where("type = 'Part'")
    new = n.select("node_id", F.lit("Other").alias("type"))
    m = merge.merge_nodes(n, new, merge.match_nodes(n, new), "existing")
    return m.select("node_id", "type", "properties", F.get_json_object("metadata", "$.merged_from").alias("merged_from"))


# ---- evaluation -------------------------------------------------------------


@register("score_sets", "WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM labels WHERE toxic = 0), s AS (SELECT (SELECT count(*) FROM g JOIN p USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g) AS n_gold) SELECT *, round(tp / n_predicted, 6) AS precision, round(tp / n_gold, 6) AS recall, round(2 * (tp / n_predicted) * (tp / n_gold) / (tp / n_predicted + tp / n_gold), 6) AS f1 FROM s")
def _(spark, d):
    t = table(spark, d, "labels")
    return evaluation.score_sets(t.where("quality = 1").select("doc_id"), t.where("toxic = 0").select("doc_id"), ["doc_id"])


@register("macro_average", "WITH s AS (SELECT lang, sum((quality = 1 AND toxic = 0)::INT) / sum((toxic = 0)::INT) AS p, sum((quality = 1 AND toxic = 0)::INT) / sum((quality = 1)::INT) AS r, sum((quality = 1 AND toxic = 0)::INT) AS tp, sum((toxic = 0)::INT) AS np, sum((quality = 1)::INT) AS ng FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT round(avg(round(p, 6)), 6) AS precision, round(avg(round(r, 6)), 6) AS recall, round(avg(round(2 * p * r / (p + r), 6)), 6) AS f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np) AS BIGINT) AS n_predicted, CAST(sum(ng) AS BIGINT) AS n_gold FROM s")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.macro_average(evaluation.score_sets(t.where("quality = 1"), t.where("toxic = 0"), ["doc_id"], ["lang"]))


@register("calibration", "SELECT CAST(least(9, floor((1 - l_discount) * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(1 - l_discount), 6) AS mean_confidence, round(avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END), 6) AS accuracy FROM lineitem GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "lineitem").select((1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("correct"))
    return evaluation.calibration(t)


@register("calibration_error", "WITH t AS (SELECT 1 - l_discount AS c, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END AS k FROM lineitem), b AS (SELECT least(9, floor(c * 10)) AS bin, count(*) AS n, sum(c) AS c, sum(k) AS k, sum((c - k) ** 2) AS q FROM t GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(c - k)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM b")
def _(spark, d):
    t = table(spark, d, "lineitem").select((1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("correct"))
    return evaluation.calibration_error(t)


@register("compare_reports", "WITH b AS (SELECT lang AS dataset, round(avg(quality), 6) AS base, round(avg(1 - toxic), 6) AS candidate FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT dataset, 'rate' AS metric, base, candidate, round(candidate - base, 6) AS delta, coalesce(round(candidate - base, 6) < -0.02, true) AS regressed FROM b")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset")), "doc_id").groupBy("dataset")
    rate = lambda c: t.agg(F.round(F.avg(c), 6).alias("value")).withColumn("metric", F.lit("rate"))
    return evaluation.compare_reports(rate(F.col("quality")), rate(1 - F.col("toxic")))


@register("graph_quality", RICH + ", d AS (SELECT count(*) - count(DISTINCT (source, rel, target)) AS w FROM edges) SELECT CAST(0 AS BIGINT) AS errors, w AS warnings, CAST(1 AS BIGINT) AS unknown_types, (SELECT count(*) FROM located) AS invalid_relations, CAST(0 AS BIGINT) AS zero_confidence, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM located) + (SELECT count(*) FROM supplies) AS missing_evidence, (SELECT count(*) FROM located) + (SELECT count(*) FROM supplies) AS missing_provenance, CAST(0 AS DOUBLE) AS score FROM d")
def _(spark, d):
    types = spark.createDataFrame([("Nation",), ("Customer",), ("Supplier",), ("Part",)], "name string")
    names = spark.createDataFrame([("purchased", "Customer", "Part"), ("supplies", "Supplier", "Part")], "name string, src string, dst string")
    return evaluation.graph_quality(evaluation.quality_counts(rich_graph(spark, d), types, names))


@register("set_scores", "WITH g AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), p AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 0), s AS (SELECT lang, (SELECT count(*) FROM g x WHERE x.lang = l.lang) AS g, (SELECT count(*) FROM p x WHERE x.lang = l.lang) AS p, (SELECT count(*) FROM g x JOIN p y USING (lang, doc_id) WHERE x.lang = l.lang) AS tp FROM (SELECT lang FROM g UNION SELECT lang FROM p) l) SELECT lang, round(2 * tp / (g + p), 6) AS f1 FROM s")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    return evaluation.set_scores(t.where("quality = 1"), t.where("toxic = 0"), ["doc_id"], ["lang"])


@register("blended_f1", "WITH f AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, CAST(0.4 AS DOUBLE) AS score FROM f")
def _(spark, d):
    t = table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").alias("doc_id"))
    other = t.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))
    return evaluation.blended_f1(evaluation.set_scores(t, other, ["doc_id"], ["lang"]), evaluation.set_scores(t, t, ["doc_id"], ["lang"]), ["lang"])


# ---- text and functions -----------------------------------------------------


@register("token_chunks", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 256) / 218)) AS BIGINT) + 1)) AS k FROM t WHERE len(t) > 0) SELECT doc_id, k AS sequence_index, doc_id || '_chunk_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS chunk_id, len(t[k * 218 + 1 : k * 218 + 256]) AS token_count, md5(array_to_string(t[k * 218 + 1 : k * 218 + 256], ' ')) AS hash FROM w")
def _(spark, d):
    return tx.token_chunks(table(spark, d, "documents"), size=tx.PRESETS["small"]).select("doc_id", "sequence_index", "chunk_id", "token_count", F.md5("text").alias("hash"))


@register("sentences", r"SELECT doc_id, count(*) FILTER (trim(s, E' \t\r\n') <> '') AS n, sum(len(trim(s, E' \t\r\n')))::BIGINT AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]?')) AS s FROM documents) GROUP BY 1 HAVING n > 0")
def _(spark, d):
    return tx.sentences(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).cast("bigint").alias("chars"))


@register("sentence_chunks")
def _(spark, d):
    return tx.sentence_chunks(table(spark, d, "documents")).select("doc_id", "sequence_index", F.length("text").alias("chars"))


@register("aligned_chunks")
def _(spark, d):
    return tx.aligned_chunks(table(spark, d, "documents"), size=256).select("doc_id", "sequence_index", "start", F.length("text").alias("chars"))


@register("check_chunks", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((len(t) - 64) / 55)) AS BIGINT) + 1)) AS k FROM t WHERE len(t) > 0), c AS (SELECT *, doc_id || '_chunk_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS chunk_id FROM w), m AS (SELECT doc_id, max(k) AS last FROM c GROUP BY 1) SELECT chunk_id, 'empty_text' AS issue FROM c WHERE k % 5 = 4 AND k % 7 <> 3 UNION ALL SELECT chunk_id, 'gap' FROM c WHERE k % 7 = 4 UNION ALL SELECT chunk_id, 'repeated_index' FROM c WHERE k = 0 UNION ALL SELECT chunk_id, 'repeated_id' FROM c WHERE k = 0")
def _(spark, d):
    c = tx.token_chunks(table(spark, d, "documents"), size=64).where("sequence_index % 7 <> 3")
    c = c.withColumn("text", F.when(F.col("sequence_index") % 5 == 4, "").otherwise(F.col("text")))
    return tx.check_chunks(c.unionByName(c.where("sequence_index = 0")))


@register("sentence_offsets", r"SELECT doc_id, count(*) FILTER (trim(s, E' \t\r\n') <> '') AS n, true AS right FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]?')) AS s FROM documents) GROUP BY 1 HAVING n > 0")
def _(spark, d):
    t = table(spark, d, "documents")
    cut = F.expr("substring(text, start + 1, end - start)")
    s = tx.sentence_spans(t).join(t.select("doc_id", "text"), "doc_id")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(X.squeeze(cut) == F.col("sentence")).alias("right"))


@register("boundary_flags", r"SELECT doc_id, regexp_matches(text, '[.!?]\s*$') AS ends FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 64")
def _(spark, d):
    c = tx.chunk_flags(tx.token_chunks(table(spark, d, "documents"), size=64))
    last = c.groupBy("doc_id").agg(F.max("sequence_index").alias("last")).where("last > 0")
    return c.join(last, "doc_id").where("sequence_index = last").select("doc_id", F.col("ends_at_sentence").alias("ends"))


@register("sampled_texts", "SELECT doc_id, CASE WHEN len(text) <= 500 THEN len(text) ELSE 502 END AS chars, left(text, least(200, len(text))) = left(text, 200) AS same FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    s = tx.sample_text(F.col("text"), 500)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length(s).cast("bigint").alias("chars"), (F.left(s, F.lit(200)) == F.left("text", F.lit(200))).alias("same"))


@register("text_attempts", "SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([len(text), CAST(floor(len(text) * 0.75) AS BIGINT), CAST(floor(len(text) * 0.55) AS BIGINT), least(len(text), 1200)]) AS k FROM documents) WHERE k > 0 GROUP BY 1")
def _(spark, d):
    return tx.attempts(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("anchor_ranking", r"WITH t AS (SELECT unnest(['the', 'token', 'licensed', 'la']) AS term), n AS (SELECT count(*) AS n FROM documents), h AS (SELECT term, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w = term)) AS h FROM documents, t), s AS (SELECT term, CAST(sum(h) AS BIGINT) AS tf, count(*) AS df FROM h WHERE h > 0 GROUP BY 1) SELECT term, tf, df, round(tf * (ln((n + 1) / (df + 1)) + 1) * (1 + 0.1 * least(len(term) / 20, 1)), 4) AS score FROM s, n")
def _(spark, d):
    terms = spark.createDataFrame([("the",), ("token",), ("licensed",), ("la",)], "term string")
    return tx.rank_anchors(terms, table(spark, d, "documents")).withColumn("score", F.round("score", 4))


@register("conversation_evidence", r"WITH c AS (SELECT conv_id || ':' || turn AS chunk_id, turn AS i, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM conversations), p AS (SELECT * FROM (VALUES ('the', 'an'), ('that', 'rest'), ('nosuchword', 'neither')) v(s, o)), j AS (SELECT s, o, chunk_id, i, CAST(list_contains(w, s) AS INT) + CAST(list_contains(w, o) AS INT) AS n FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY s, o ORDER BY n DESC, i, chunk_id) AS k FROM j WHERE n > 0) SELECT s, o, chunk_id, k FROM r WHERE k <= 3 UNION ALL SELECT s, o, (SELECT min_by(chunk_id, (i, chunk_id)) FROM c), 1 FROM p WHERE s = 'nosuchword'")
def _(spark, d):
    t = table(spark, d, "conversations")
    c = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("turn").alias("sequence_index"), "text")
    return tx.evidence_windows(spark.createDataFrame([("the", "an"), ("that", "rest"), ("nosuchword", "neither")], "s string, o string"), c)


@register("context_snippets", r"WITH c AS (SELECT conv_id AS doc_id, turn AS i, text, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM conversations), a AS (SELECT DISTINCT conv_id AS doc_id, turn AS i FROM conversations), j AS (SELECT a.doc_id, a.i, c.i AS other, text, CAST(list_contains(w, 'the') AS INT) + CAST(list_contains(w, 'an') AS INT) AS n FROM a JOIN c USING (doc_id) WHERE a.i <> c.i), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC, abs(other - i), other) AS k FROM j WHERE n > 0), s AS (SELECT *, sum(len(left(text, 100))) OVER (PARTITION BY doc_id, i ORDER BY k) AS total FROM r) SELECT doc_id, i AS sequence_index, other AS other_index, left(text, 100) AS snippet, k AS rank FROM s WHERE total <= 250")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sequence_index"), "text")
    a = c.select("doc_id", "sequence_index", F.explode(F.array(F.lit("the"), F.lit("an"))).alias("term"))
    return tx.context_snippets(a, c, most=100, budget=250)


@register("benchmark_in_documents", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def _(spark, d):
    b, t = table(spark, d, "benchmark").toDF("item_id", "term"), table(spark, d, "documents").select("doc_id", "text")
    return tx.names_in(t, b).join(b, "term").select("item_id", "doc_id")


@register("identifiers", "SELECT DISTINCT p_type, upper(trim(regexp_replace(regexp_replace(p_type, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '_')) AS label FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_type", X.sanitize_identifier(F.col("p_type")).alias("label")).distinct()


@register("entity_names", r"SELECT c_custkey, trim(regexp_replace(lower('Dr. ' || c_name || '  Jr.'), '^(?:mr|mrs|ms|dr|prof)\.?\s*|\s+(?:jr|sr|ii|iii|iv)\.?$', '', 'g')) AS name FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.normalize_entity_name(F.concat(F.lit("Dr. "), "c_name", F.lit("  Jr."))).alias("name"))


@register("redaction", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\b(sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), '(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)(\"?)[^\s\"]+', '\1\2[REDACTED]', 'g')) AS hash, contains(text, 'token = ') AS had FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("hash"), F.contains("text", F.lit("token = ")).alias("had"))


@register("negation", "SELECT doc_id, n % 3 = 0 AS a, n % 3 = 0 AS b, false AS c FROM (SELECT doc_id, doc_id AS n FROM documents)")
def _(spark, d):
    n = F.col("doc_id") % 3
    say = lambda x: F.concat(F.lit("the firm "), F.when(n == 0, "no longer ").otherwise(""), F.lit(x))
    return table(spark, d, "documents").select("doc_id", X.negated(say("employs them"), F.lit("employs")).alias("a"), X.negated(say("manufactured it"), F.lit("makes")).alias("b"), X.negated(say("runs"), F.lit("owns")).alias("c"))


@register("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return exports.similar_pairs(v.repartition(16), 0.4).withColumn("cosine", F.round("cosine", 5))


@register("span_overlap", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(l_linenumber + 3, 6) - greatest(l_linenumber, 2)) / (greatest(l_linenumber + 3, 6) - least(l_linenumber, 2)), 6) AS iou FROM lineitem")
def _(spark, d):
    a = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(N.span_iou(a, a + 3, F.lit(2), F.lit(6)), 6).alias("iou"))


@register("entity_resolution")
def _(spark, d):
    return resolution.resolve(table(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name")))


@register("relationship_classes", r"WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), r AS (SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(t, 'caused|causes|leads to|results in') THEN 'causes' END, CASE WHEN regexp_matches(t, 'because|due to|result of') THEN 'caused_by' END, CASE WHEN regexp_matches(t, 'at|in|located|place') THEN 'located_at' END, CASE WHEN regexp_matches(t, 'contains|has|includes') THEN 'contains' END, CASE WHEN regexp_matches(t, 'before|earlier|prior') THEN 'occurs_before' END, CASE WHEN regexp_matches(t, 'after|later|subsequent') THEN 'occurs_after' END, CASE WHEN regexp_matches(t, 'affects|impacts|influences') THEN 'influences' END, CASE WHEN regexp_matches(t, 'collaborates|partners|works with') THEN 'collaborates_with' END, CASE WHEN regexp_matches(t, 'has ownership|owns|possesses') THEN 'owns' END, CASE WHEN regexp_matches(t, 'belongs|member|part of group') THEN 'member_of' END, CASE WHEN regexp_matches(t, 'father|mother|parent') THEN 'parent_of' END, CASE WHEN regexp_matches(t, 'child|daughter|son') THEN 'child_of' END, CASE WHEN regexp_matches(t, 'belongs to|component|part of') THEN 'part_of' END], lambda x: x IS NOT NULL) AS l FROM c) SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN 'related_to,knows' ELSE array_to_string(l[1:3], ',') END AS classes FROM r")
def _(spark, d):
    t = table(spark, d, "conversations").withColumns({"source_type": F.lit("Person"), "target_type": F.lit("Person")})
    return resolution.classify(t).select("conv_id", "turn", F.array_join("classes.rel", ",").alias("classes"))


@register("classes_within_schema", "SELECT conv_id, turn, 'owns' AS rel, CAST(0.72 AS DOUBLE) AS score FROM conversations")
def _(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.lit("it owns parts in town").alias("text"), F.lit("A").alias("source_type"), F.lit("B").alias("target_type"))
    c = resolution.classify(t, spark.createDataFrame([("owns_all", "A", "B")], "name string, src string, dst string"))
    return c.select("conv_id", "turn", F.col("classes")[0]["rel"].alias("rel"), F.round(F.col("classes")[0]["score"], 6).alias("score"))


def ontology(spark, d):
    """An ontology from the tables: types from the kinds of parts and events, relations between them."""
    t = table(spark, d, "part").select(F.col("p_type").alias("name")).union(table(spark, d, "events").select("event_type")).distinct()
    t = t.unionByName(spark.createDataFrame([("date",), ("Company",), ("LegalCase",)], "name string"))
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type").withColumn("k", F.col("p_partkey") % 5)
    word = F.replace("p_name", F.lit(" "), F.lit("-"))
    name = F.when(F.col("k") == 0, word).when(F.col("k") == 1, F.concat(word, F.lit("_by"))).when(F.col("k") == 2, F.concat(F.lit("product_"), word)).when(F.col("k") == 3, F.lit("owns")).otherwise(F.lit("created"))
    r = p.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("group_name"), name.alias("name"), F.lower("p_type").alias("src"), F.when(F.col("k") == 3, "nowhere").when(F.col("k") == 4, "Date").otherwise("Company").alias("dst"))
    return t.withColumn("idx", F.xxhash64("name")), r


ONTOLOGY = """WITH r AS (SELECT p_partkey AS idx, p_brand AS group_name, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '-') || '_by' WHEN 2 THEN 'product_' || replace(p_name, ' ', '-') WHEN 3 THEN 'owns' ELSE 'created' END AS name, lower(p_type) AS src, CASE p_partkey % 5 WHEN 3 THEN 'nowhere' WHEN 4 THEN 'Date' ELSE 'Company' END AS dst, p_type, p_partkey % 5 AS k, replace(p_name, ' ', '_') AS word FROM part)
"""


@register("schema_names", ONTOLOGY + "SELECT idx, CASE k WHEN 2 THEN word WHEN 4 THEN 'develops' ELSE name END AS name FROM r")
def _(spark, d):
    return schema.canonical_relations(ontology(spark, d)[1]).select("idx", "name")


@register("schema_types", "SELECT CASE WHEN name = 'Company' THEN 'Organization' ELSE name END AS name FROM (SELECT p_type AS name FROM part UNION SELECT event_type FROM events UNION SELECT 'date' UNION SELECT 'Company' UNION SELECT 'LegalCase')")
def _(spark, d):
    return schema.canonical_types(*ontology(spark, d))[0].select("name")


@register("schema_ends", ONTOLOGY + "SELECT idx, p_type AS src, CASE WHEN k = 4 THEN 'date' ELSE dst END AS dst FROM r WHERE k <> 3")
def _(spark, d):
    return schema.repair_ends(*ontology(spark, d)).select("idx", "src", "dst")


@register("schema_primitive", ONTOLOGY + "SELECT idx FROM r WHERE k <> 4")
def _(spark, d):
    return schema.drop_primitive(*ontology(spark, d))[1].select("idx")


@register("schema_exact", ONTOLOGY + "SELECT min(idx) AS idx FROM r GROUP BY replace(name, '-', '_'), src, dst")
def _(spark, d):
    return schema.distinct_relations(ontology(spark, d)[1]).select("idx")


@register("schema_meanings", ONTOLOGY + "SELECT min(idx) AS idx FROM r GROUP BY CASE WHEN k = 1 THEN word WHEN k = 2 THEN 'product_' || word WHEN k = 0 THEN word ELSE name END, src, dst")
def _(spark, d):
    return schema.distinct_meanings(ontology(spark, d)[1]).select("idx")


@register("schema_groups", ONTOLOGY + "SELECT idx, 'Product & Technology' AS group_name FROM r")
def _(spark, d):
    r = ontology(spark, d)[1].withColumn("group_name", F.when(F.col("idx") % 2 == 0, "Product Lifecycle").otherwise("product_usage"))
    return schema.merge_groups(r).select("idx", "group_name")


@register("schema_roles", ONTOLOGY + "SELECT idx FROM r WHERE idx % 2 = 0")
def _(spark, d):
    r = ontology(spark, d)[1].withColumns({"name": F.lit("located_in"), "src": F.lit("Company"), "dst": F.when(F.col("idx") % 2 == 0, "City").otherwise("Product")})
    return schema.fitting_roles(r).select("idx")


@register("schema_reusable", ONTOLOGY + "SELECT idx FROM r WHERE k <> 3")
def _(spark, d):
    return schema.reusable(ontology(spark, d)[1]).select("idx")


@register("schema_rescue", ONTOLOGY + "SELECT idx, CASE WHEN idx = (SELECT min(idx) FROM r WHERE k = 3) THEN 'filed_against' WHEN k = 3 THEN 'sued_by' ELSE name END AS name, CASE WHEN idx = (SELECT min(idx) FROM r WHERE k = 3) THEN 'LegalCase' ELSE dst END AS dst FROM r")
def _(spark, d):
    t, r = ontology(spark, d)
    return schema.rescue_types(t, r.withColumn("name", F.when(F.col("idx") % 5 == 3, "sued_by").otherwise(F.col("name")))).select("idx", "name", "dst")


@register("schema_used_types", ONTOLOGY + "SELECT DISTINCT p_type AS name FROM r WHERE p_type = src UNION SELECT 'Company'")
def _(spark, d):
    return schema.used_types(*ontology(spark, d)).select("name")


@register("schema_examples", "SELECT p_partkey AS idx FROM part WHERE p_partkey % 3 <> 0")
def _(spark, d):
    p = table(spark, d, "part")
    types = p.groupBy(F.col("p_type").alias("name")).agg(F.collect_set(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("examples"))
    rels = p.select(F.lit("g").alias("group_name"), F.concat(F.lit("is "), "p_type").alias("name"), F.col("p_type").alias("src"), F.lit("Brand").alias("dst"), F.lit(0).alias("idx")).distinct()
    own = F.when(F.col("p_partkey") % 3 == 0, "OTHER").otherwise(F.col("p_type"))
    x = p.select(F.lit("g").alias("group_name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("head"), F.concat(F.lit("IS-"), own).alias("relation"), F.col("p_brand").alias("tail"), F.col("p_partkey").alias("idx"))
    return schema.fitting_examples(x, types, rels).select("idx")


@register("schema_sanitise")
def _(spark, d):
    return schema.sanitise(*ontology(spark, d))[1].select("idx", "group_name", "name", "src", "dst")


@register("ontology_scores")
def _(spark, d):
    return evaluation.ontology_scores(*ontology(spark, d))


# ---- exports and streams ----------------------------------------------------


@register("sync_plan", SQL + "SELECT *, n_nodes * (n_nodes - 1) // 2 AS n_pairs FROM (SELECT count(*) AS n_nodes, string_agg(DISTINCT upper(type), ',' ORDER BY upper(type)) AS labels FROM nodes), (SELECT count(*) AS n_edges, string_agg(DISTINCT upper(rel), ',' ORDER BY upper(rel)) AS rel_types FROM edges), (SELECT count(DISTINCT cluster_id) AS n_clusters FROM members)")
def _(spark, d):
    return exports.sync_plan(trade_graph(spark, d))


@register("sync_statements", RICH + """SELECT 1 AS step, node_id AS key, upper(type) AS label FROM nodes UNION ALL SELECT 2, edge_id, upper(rel) FROM edges UNION ALL SELECT DISTINCT 3, cluster_id, 'CLUSTER' FROM members UNION ALL SELECT 4, node_id || '>' || cluster_id, 'MEMBER_OF' FROM members UNION ALL SELECT 0, '', ''
UNION ALL SELECT 5, 'customer:' || least(a.vec_id, b.vec_id) || '~customer:' || greatest(a.vec_id, b.vec_id), 'SIMILAR_TO' FROM embeddings a JOIN embeddings b ON 'customer:' || a.vec_id < 'customer:' || b.vec_id WHERE a.vec_id IN (SELECT c_custkey FROM customer) AND b.vec_id IN (SELECT c_custkey FROM customer) AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def _(spark, d):
    g = rich_graph(spark, d)
    v = table(spark, d, "embeddings").select(F.concat(F.lit("customer:"), F.col("vec_id").cast("string")).alias("text"), "embedding")
    s = exports.sync_statements(g.with_nodes(exports.embed(g.nodes, v)), similar=0.4, clear=True).select("step", "key", "label")
    ends = F.array_sort(F.transform(F.split("key", "~"), lambda x: F.substring(x, 10, 20).cast("bigint")))
    return s.withColumn("key", F.when(F.col("step") == 5, F.array_join(F.transform(ends, lambda x: F.concat(F.lit("customer:"), x.cast("string"))), "~")).otherwise(F.col("key")))


@register("mermaid", PLACE + """, n AS (SELECT node_id, type, 'N' || (row_number() OVER (ORDER BY node_id) - 1) AS m FROM nodes) SELECT 'graph TD' AS line UNION ALL SELECT '    ' || m || '["' || node_id || '<br/>(' || type || ')"]' FROM n UNION ALL SELECT '    classDef style_' || m || ' fill:#A8A8A8,stroke:#333,stroke-width:2px' FROM n UNION ALL SELECT '    class ' || m || ' style_' || m FROM n UNION ALL SELECT '    ' || s.m || ' -->|"' || rel || '\\n()"| ' || t.m FROM edges JOIN n s ON s.node_id = source JOIN n t ON t.node_id = target""")
def _(spark, d):
    return exports.mermaid(place_graph(spark, d)).select("line")


@register("viewer_elements", ENDS + """, c AS (SELECT node_id, count(DISTINCT edge_id) AS k FROM ends GROUP BY 1) SELECT 'node' AS kind, node_id AS id, '{"data":{"id":"' || node_id || '","label":"' || node_id || '","type":"' || type || '","weight":' || greatest(1, least(10, k)) || ',"connection_count":' || k || CASE WHEN cluster_id IS NULL THEN '' ELSE ',"community":"' || cluster_id || '"' END || '},"style":{"background-color":"#A8A8A8","label":"' || node_id || '"}}' AS json FROM nodes JOIN c USING (node_id) LEFT JOIN members USING (node_id) UNION ALL SELECT 'edge', edge_id, '{"data":{"id":"' || source || '-' || target || '","source":"' || source || '","target":"' || target || '","label":"' || rel || '","weight":' || coalesce(confidence, 1.0) || '},"style":{"width":' || greatest(3.0, least(10.0, coalesce(confidence, 1.0) * 5)) || ',"line-color":"#CCCCCC","label":"' || rel || '"}}' FROM edges""")
def _(spark, d):
    return exports.cytoscape(place_graph(spark, d))


@register("recoloured_nodes", PLACE + """, c AS (SELECT cluster_id, ['#FF6B6B', '#4ECDC4', '#FFE66D', '#95E1D3', '#F38181', '#A8E6CF', '#FFD3B6', '#FFAAA5', '#FF8B94', '#C7CEEA'][(row_number() OVER (ORDER BY cluster_id) - 1) % 10 + 1] AS colour FROM (SELECT DISTINCT cluster_id FROM members)) SELECT node_id AS id, coalesce(colour, '#A8A8A8') AS colour FROM nodes LEFT JOIN members USING (node_id) LEFT JOIN c USING (cluster_id)""")
def _(spark, d):
    c = exports.cytoscape(place_graph(spark, d), recolour=True).where("kind = 'node'")
    return c.select("id", F.get_json_object("json", "$.style['background-color']").alias("colour"))


@register("palette", "SELECT event_type, '#FFE66D' AS event, '#95E1D3' AS organisation, '#A8A8A8' AS plain, '#FFE66D' AS role, '#4ECDC4' AS cause FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    c = exports.node_colour
    return e.select("event_type", c(F.concat(F.lit("Event:"), "event_type")).alias("event"), c(F.lit("Company")).alias("organisation"), c(F.col("event_type")).alias("plain"), exports.edge_colour(F.lit("role:buyer")).alias("role"), exports.edge_colour(F.lit("caused_by")).alias("cause"))


@register("vis_network", PLACE + "SELECT 'node' AS kind, node_id AS id, 'Type: ' || type || chr(10) || 'ID: ' || node_id AS title, cluster_id AS \"group\", CAST(NULL AS DOUBLE) AS value FROM nodes LEFT JOIN members USING (node_id) UNION ALL SELECT 'edge', edge_id, rel || chr(10), NULL, coalesce(confidence, 1.0) FROM edges")
def _(spark, d):
    get = lambda k: F.get_json_object("json", f"$.{k}")
    return exports.vis_network(place_graph(spark, d)).select("kind", "id", get("title").alias("title"), get("group").alias("group"), get("value").cast("double").alias("value"))


@register("d3_links", PLACE + ", n AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS k FROM nodes) SELECT edge_id, s.k AS source, t.k AS target FROM edges JOIN n s ON s.node_id = source JOIN n t ON t.node_id = target")
def _(spark, d):
    get = lambda k: F.get_json_object("json", f"$.{k}").cast("bigint")
    return exports.d3(place_graph(spark, d)).where("kind = 'link'").select(F.col("k").alias("edge_id"), get("source").alias("source"), get("target").alias("target"))


@register("provenance_elements", "SELECT 'node' AS kind, 'c' || conv_id || ':' || turn AS id, CASE role WHEN 'user' THEN '#FF6B6B' WHEN 'assistant' THEN '#F38181' ELSE '#A8A8A8' END AS colour FROM conversations UNION ALL SELECT 'edge', 'c' || conv_id || ':' || (turn - 1) || '-c' || conv_id || ':' || turn, NULL FROM conversations WHERE turn > 0")
def _(spark, d):
    c = table(spark, d, "conversations")
    at = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    kind = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", "answer").otherwise(F.col("role"))
    n = c.select(at(F.col("turn")).alias("id"), kind.alias("type"), F.left("text", F.lit(20)).alias("label"), F.lit(None).cast("string").alias("data"))
    e = c.where("turn > 0").select(at(F.col("turn") - 1).alias("source"), at(F.col("turn")).alias("target"), F.lit("next").alias("type"), F.lit("next").alias("label"), F.lit(1.0).alias("weight"))
    return exports.provenance_elements(n, e).select("kind", "id", F.get_json_object("json", "$.style['background-color']").alias("colour"))


@register("node_json", RICH + """SELECT node_id, '{"id":"' || node_id || '","type":"' || type || '"' || CASE WHEN properties IS NULL THEN '' ELSE ',"properties":' || properties END || ',"metadata":' || metadata || CASE WHEN confidence IS NULL THEN '' ELSE ',"confidence":' || confidence END || '}' AS json FROM rich_nodes""")
def _(spark, d):
    return graph_json.node_json(rich_graph(spark, d).nodes)


@register("edge_json", RICH + """SELECT edge_id, '{"source":"' || source || '","target":"' || target || '","relationship_type":"' || rel || '"' || CASE WHEN detail IS NULL THEN '' ELSE ',"relationship_detail":"' || detail || '","metadata":' || metadata || ',"start_time":"' || valid_from || '","end_time":"' || valid_to || '"' END || '}' AS json FROM rich_edges""")
def _(spark, d):
    return graph_json.edge_json(rich_graph(spark, d).edges.withColumn("confidence", F.lit(None).cast("double")))


@register("event_json", """SELECT 'event:' || event_id AS node_id, '{"id":"event:' || event_id || '","event_type":"' || event_type || '","participants":{"user":["user:' || user_id || '"]},"timestamp":{"start":"' || strftime(ts, '%Y-%m-%d') || '","end":"' || strftime(ts, '%Y-%m-%d') || '"},"confidence":0.9}' AS json FROM events""")
def _(spark, d):
    return graph_json.events_json(event_graph(spark, d))


@register("enriched_form", RICH + "SELECT source, rel AS relationship_type, target, detail AS relationship_detail, document_id AS source_ref, valid_from AS start_time, coalesce(confidence, 0.25) AS confidence FROM rich_edges")
def _(spark, d):
    g = rich_graph(spark, d)
    e = g.edges.withColumn("metadata", F.when(F.col("confidence").isNull(), '{"confidence":0.25}').otherwise(F.col("metadata")))
    back = graph_json.from_enriched(*graph_json.enriched(g.with_edges(e)))
    return graph_json.enriched(back)[1].select("source", "relationship_type", "target", "relationship_detail", "source_ref", "start_time", "confidence")


@register("typed_tuples", SQL + "SELECT node_id, CASE WHEN type = 'Part' THEN NULL ELSE type END AS type FROM nodes WHERE type <> 'Part' OR node_id IN (SELECT target FROM edges)")
def _(spark, d):
    g = trade_graph(spark, d)
    known = g.nodes.where("type <> 'Part'").select(F.col("node_id").alias("name"), "type")
    return graph_json.from_typed(known, g.edges.select(F.col("source").alias("s"), F.col("rel").alias("r"), F.col("target").alias("o"))).nodes.select("node_id", "type")


@register("linked_data", RICH + """SELECT 'context' AS kind, '' AS id, '{"@context":{"@vocab":"https://schema.org/","kg":"https://example.org/kg/"}}' AS json
UNION ALL SELECT 'node', node_id, '{"@id":"kg:node/' || node_id || '","@type":"' || type || '","identifier":"' || node_id || '"' || CASE WHEN type = 'Customer' THEN ',"kg:prop/segment":"' || json_extract_string(properties, '$.segment') || '"' WHEN type = 'Part' THEN ',"kg:prop/brand":"' || json_extract_string(properties, '$.brand') || '","kg:prop/size":' || json_extract_string(properties, '$.size') ELSE '' END || ',"kg:meta/source_documents":["' || lower(type) || '"]' || CASE WHEN confidence IS NULL THEN '' ELSE ',"confidence":' || confidence END || '}' FROM rich_nodes
UNION ALL SELECT 'edge', edge_id, '{"@id":"kg:edge/' || source || '-' || target || '","@type":"Relationship","source":{"@id":"kg:node/' || source || '"},"target":{"@id":"kg:node/' || target || '"},"relationship_type":"' || rel || '"' || CASE WHEN confidence IS NULL THEN '' ELSE ',"confidence":' || confidence END || '}' FROM located
UNION ALL SELECT 'cluster', cluster_id, '{"@id":"kg:cluster/' || cluster_id || '","@type":"Cluster","identifier":"' || cluster_id || '","members":[' || string_agg('{"@id":"kg:node/' || node_id || '"}', ',' ORDER BY node_id) || ']}' FROM members GROUP BY cluster_id""")
def _(spark, d):
    g = rich_graph(spark, d)
    return graph_json.linked_data(g.with_edges(g.edges.where("rel = 'located_in'")))


@register("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return windowed_counts(table(spark, d, "events"))
