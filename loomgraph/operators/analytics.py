"""Degrees, ranks, components, statistics and community reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph, full_edges
from loomgraph.operators.compact import NONE, Compact, least_step, rank_step, vote_step
from loomgraph.plans.session import checkpoint


def degree(g: Graph) -> DataFrame:
    d = g.endpoints().groupBy("node_id").agg(F.count("*").alias("degree"))
    return g.nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_centrality(g: Graph) -> DataFrame:
    """(node_id, score): degree / max(1, n - 1); parallel edges count."""
    d = degree(g)
    n = g.nodes.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node_id", (F.col("degree") / F.col("n")).alias("score"))


def adjacency(g: Graph) -> DataFrame:
    """(node_id, other): distinct neighbours, without direction, between nodes that exist."""
    return g.endpoints().select("node_id", "other").where("node_id <> other").distinct()


def pagerank(g: Graph, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """(node_id, score): synchronous steps over distinct undirected neighbours; isolated nodes spread their rank over all; what flows to an id that is no node is lost."""
    c = Compact(g)
    node = c.is_node()
    n = int(node.sum())
    out = c.degrees()
    rank = np.where(node, 1.0 / max(1, n), 0.0)
    for _ in range(rounds):
        got = c.step(rank_step, np.divide(rank, out, out=np.zeros(c.n), where=out > 0), np.zeros(c.n))
        rank = np.where(node, (1 - damping) / max(1, n) + damping * (got + rank[out == 0].sum() / max(1, n)), 0.0)
    return c.column(rank, "score", "double")


def influence(g: Graph) -> DataFrame:
    """(node_id, score): 0.6 of the PageRank over its maximum and 0.4 of the degree centrality."""
    pr = checkpoint(pagerank(g))
    top = pr.agg(F.max("score").alias("top"))
    d = degree_centrality(g).withColumnRenamed("score", "dc")
    both = pr.join(d, "node_id").crossJoin(F.broadcast(top))
    return both.select("node_id", (0.6 * F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) + 0.4 * F.col("dc")).alias("score"))


def components(g: Graph) -> DataFrame:
    """(node_id, component): the least node_id that can be reached without direction.

    Labels hop to the least neighbour and along pointers, so rounds grow with the logarithm of the longest path.
    """
    c = Compact(g)
    node = c.is_node()
    label = np.where(node, np.arange(c.n), NONE)  # ends that are no nodes neither have a label nor pass one on
    while True:
        new = np.where(node, c.step(least_step, label, label), NONE)
        new[node] = np.minimum(new[node], new[new[node]])
        if (new == label).all():
            return c.names(label, "component")
        label = new


def auto_clusters(g: Graph, most: int = 12) -> DataFrame:
    """(cluster_id, node_id): the largest components of two nodes or more, or the types if there is only one such."""
    comp = checkpoint(components(g))
    size = comp.groupBy("component").agg(F.count("*").alias("size"), F.min(F.lower("node_id")).alias("first")).where("size >= 2")
    if size.count() >= 2:
        top = size.orderBy(F.desc("size"), "first").limit(most)
        top = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("size"), "first")))
        return comp.join(F.broadcast(top), "component").select(F.concat(F.lit("cc_"), F.col("k").cast("string")).alias("cluster_id"), "node_id")
    t = F.coalesce("type", F.lit("Unknown"))
    kinds = g.nodes.groupBy(t.alias("t")).count().withColumn("k", F.row_number().over(Window.orderBy("t")))
    return g.nodes.join(F.broadcast(kinds), t == F.col("t")).select(F.concat_ws("_", F.lit("type"), F.col("k").cast("string"), F.lower("t")).alias("cluster_id"), "node_id")


def label_propagation(g: Graph, rounds: int = 10) -> DataFrame:
    """(node_id, community): every node takes the label that weighs most among its neighbours and itself (weight: parallel edges), ties to the least; the distributed stand-in for modularity methods."""
    c = Compact(g)
    label = np.where(c.is_node(), np.arange(c.n), NONE)  # ends that are no nodes have no label to begin with
    for _ in range(rounds):
        label = c.step(vote_step, label, label)
    return c.names(label, "community", every=True)


def _weights(g: Graph) -> DataFrame:
    """(node_id, other, w): both ways, w the number of parallel edges."""
    return checkpoint(g.endpoints().where("node_id <> other").groupBy("node_id", "other").agg(F.count("*").cast("double").alias("w")))


def modularity(g: Graph, communities: DataFrame) -> DataFrame:
    """(modularity): of a labelling (node_id, community), the weight of an edge the number of its parallels."""
    w = g.endpoints().where("node_id <> other").groupBy("node_id", "other").agg(F.count("*").cast("double").alias("w"))
    return _modularity(w, communities)


def _modularity(w: DataFrame, lab: DataFrame) -> DataFrame:
    j = w.join(lab, "node_id").join(lab.select(F.col("node_id").alias("other"), F.col("community").alias("c2")), "other")
    per = j.groupBy("community").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("community") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inner"))
    m2 = F.sum("d")
    return per.agg(F.coalesce(F.round(F.sum("inner") / m2 - F.sum(F.col("d") * F.col("d")) / (m2 * m2), 6), F.lit(0.0)).alias("modularity"))


def louvain(g: Graph, rounds: int = 8, levels: int = 4) -> DataFrame:
    """(node_id, community): local moves that raise the modularity, then the same over communities as nodes, until nothing is gained.

    All nodes of one half (by a hash of the round) move at a time to the neighbouring community of the greatest gain; a round that lowers the
    modularity ends the level.  A community is named by its least node.
    """
    w = _weights(g)
    own = g.nodes.select("node_id", F.col("node_id").alias("community"))
    best_q = -1.0
    for level in range(levels):
        deg = checkpoint(w.groupBy("node_id").agg(F.sum("w").alias("k")))
        total = deg.agg(F.sum("k")).first()[0] or 0.0
        if not total:
            break
        lab = deg.select("node_id", F.col("node_id").alias("community"))
        q = _modularity(w, lab).first()[0]
        for r in range(rounds):
            size = deg.join(lab, "node_id").groupBy("community").agg(F.sum("k").alias("tot"))
            near = w.where("node_id <> other").join(lab.select(F.col("node_id").alias("other"), "community"), "other").groupBy("node_id", "community").agg(F.sum("w").alias("kin"))
            stay = lab.join(near, ["node_id", "community"], "left").select("node_id", "community", F.coalesce("kin", F.lit(0.0)).alias("kin"), F.lit(True).alias("stay"))
            move = near.join(lab.select("node_id", F.col("community").alias("at")), "node_id").where("community <> at").select("node_id", "community", "kin", F.lit(False).alias("stay"))
            gain = stay.unionByName(move).join(size, "community").join(deg, "node_id")
            gain = gain.withColumn("gain", F.col("kin") - F.col("k") * (F.col("tot") - F.when(F.col("stay"), F.col("k")).otherwise(0.0)) / total)
            top = gain.groupBy("node_id").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), "stay", "community")).alias("b"), F.max(F.when(F.col("stay"), F.col("community"))).alias("at"))
            half = F.pmod(F.xxhash64("node_id", F.lit(level * rounds + r)), F.lit(2)) == 0
            new = checkpoint(top.select("node_id", F.when(half, F.col("b.community")).otherwise(F.col("at")).alias("community")))
            q2 = _modularity(w, new).first()[0]
            if q2 < q:
                break
            done, lab, q = q2 == q and r > 1, new, q2
            if done:
                break
        name = lab.groupBy("community").agg(F.min("node_id").alias("name"))
        lab = checkpoint(lab.join(name, "community").select("node_id", F.col("name").alias("community")))
        if q <= best_q + 1e-6:
            break
        best_q = q
        own = checkpoint(own.join(lab.toDF("community", "up"), "community", "left").select("node_id", F.coalesce("up", "community").alias("community")))
        w = w.join(lab, "node_id").join(lab.select(F.col("node_id").alias("other"), F.col("community").alias("c2")), "other")
        w = checkpoint(w.groupBy(F.col("community").alias("node_id"), F.col("c2").alias("other")).agg(F.sum("w").alias("w")))  # what is within stays as a loop
    return own


def spectral(g: Graph, k: int = 8, rounds: int = 20) -> DataFrame:
    """(node_id, community): power iteration clustering of the weighted graph, by MLlib; nodes without edges are communities of their own."""
    from pyspark.ml.clustering import PowerIterationClustering

    from loomgraph.sources.exports import numbered

    w = _weights(g)
    number = checkpoint(numbered(w.select("node_id").distinct()))
    e = w.where("node_id < other").join(number.toDF("node_id", "src"), "node_id").join(number.toDF("other", "dst"), "other").select("src", "dst", "w")
    n = number.count()
    if not n:
        return g.nodes.select("node_id", F.col("node_id").alias("community"))
    out = PowerIterationClustering(k=min(k, n), maxIter=rounds, weightCol="w", initMode="degree").assignClusters(e)
    lab = number.join(out, number.k == out.id).select("node_id", "cluster")
    name = lab.groupBy("cluster").agg(F.min("node_id").alias("community"))
    lab = lab.join(name, "cluster").select("node_id", "community")
    return g.nodes.select("node_id").join(lab, "node_id", "left").withColumn("community", F.coalesce("community", "node_id"))


def statistics(g: Graph) -> DataFrame:
    """(n_nodes, n_edges, avg_degree, density)."""
    n, e = g.nodes.agg(F.count("*").alias("n_nodes")), g.edges.agg(F.count("*").alias("n_edges"))
    nn, ee = F.col("n_nodes"), F.col("n_edges")
    return n.crossJoin(e).select(
        "n_nodes", "n_edges", F.when(nn > 0, F.round(2.0 * ee / nn, 4)).otherwise(0.0).alias("avg_degree"),
        F.when(nn > 1, F.round(ee / (nn * (nn - 1)), 4)).otherwise(0.0).alias("density"),
    )


def type_counts(g: Graph) -> DataFrame:
    n = g.nodes.groupBy(F.coalesce("type", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    return n.unionByName(g.edges.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))


def confidence_summary(rows: DataFrame) -> DataFrame:
    """(n, with_confidence, coverage, low, middle, high, least, most, mean) of a confidence column."""
    c = F.col("confidence")
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return rows.agg(
        F.count("*").alias("n"), F.count(c).alias("with_confidence"), F.round(F.count(c) / F.greatest(F.lit(1), F.count("*")), 4).alias("coverage"),
        count(c < 0.5).alias("low"), count((c >= 0.5) & (c < 0.8)).alias("middle"), count(c >= 0.8).alias("high"),
        F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.avg(c), 6).alias("mean"),
    )


def ontology_types(g: Graph, examples: int = 5) -> DataFrame:
    """(type, n, examples): the first ids of each type, sorted; only the kept few are gathered."""
    t = g.nodes.select(F.coalesce("type", F.lit("Unknown")).alias("type"), "node_id")
    first = t.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("node_id"))).where(F.col("k") <= examples)
    first = first.groupBy("type").agg(F.array_sort(F.collect_list("node_id")).alias("examples"))
    return t.groupBy("type").agg(F.count("*").alias("n")).join(first, "type")


def ontology_relations(g: Graph) -> DataFrame:
    """(rel, source_type, target_type, n, detail): the distinct typed relations, with the detail of the last edge that has one."""
    n = g.nodes.select("node_id", F.coalesce("type", F.lit("Unknown")).alias("t"))
    e = full_edges(g.edges).join(n.toDF("source", "source_type"), "source", "left").join(n.toDF("target", "target_type"), "target", "left")
    return e.groupBy("rel", F.coalesce("source_type", F.lit("Unknown")).alias("source_type"), F.coalesce("target_type", F.lit("Unknown")).alias("target_type")).agg(F.count("*").alias("n"), F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col("edge_id"))).alias("detail"))


def community_report(g: Graph, top: int = 3) -> DataFrame:
    """(cluster_id, n_members, n_internal, density, top_actors, top_relations, themes): size, internal edges, directed density, the members with most edges (internal or not), the most frequent relations within, the most frequent types of members.

    Ties: actors by name; relations and types by what comes first.
    """
    m = g.members.distinct()
    size = m.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    inside = g.edges.select("source", "target", "rel", "edge_id").join(m.toDF("cs", "source"), "source").join(m.toDF("ct", "target"), "target").where("cs = ct")
    many = lambda rows, c, name: (
        rows.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "o"))).where(F.col("k") <= top).groupBy("cluster_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), ", ").alias(name))
    )
    rels = many(inside.groupBy(F.col("cs").alias("cluster_id"), "rel").agg(F.count("*").alias("n"), F.min("edge_id").alias("o")), "rel", "top_relations")
    kinds = many(m.join(g.nodes.select("node_id", "type"), "node_id").where("type IS NOT NULL").groupBy("cluster_id", "type").agg(F.count("*").alias("n"), F.min("type").alias("o")), "type", "themes")
    inner = inside.groupBy(F.col("cs").alias("cluster_id")).agg(F.count("*").alias("n_internal"))
    acts = m.join(g.endpoints().groupBy("node_id").agg(F.count("*").alias("d")), "node_id")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("d"), F.lower("node_id"))
    acts = acts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).groupBy("cluster_id")
    acts = acts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node_id"))), lambda x: x["node_id"]), ", ").alias("top_actors"))
    n, k = F.col("n_members"), F.coalesce("n_internal", F.lit(0))
    out = size.join(inner, "cluster_id", "left").join(acts, "cluster_id", "left").join(rels, "cluster_id", "left").join(kinds, "cluster_id", "left")
    return out.select(
        "cluster_id", "n_members", k.cast("bigint").alias("n_internal"), F.when(n > 1, F.round(k / (n * (n - 1)), 6)).otherwise(0.0).alias("density"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("top_actors", "top_relations", "themes")],
    )


def report_text(reports: DataFrame) -> DataFrame:
    return reports.select("cluster_id", F.format_string("Community %s: %d members, %d internal relations (density %.4f). Most connected: %s.", "cluster_id", "n_members", "n_internal", "density", "top_actors").alias("text"))


def cluster_summary(g: Graph, first: int = 10, triples: int = 5) -> DataFrame:
    """(cluster_id, first_members, top_triples, density): the first members by name, the most frequent triples within and how dense the cluster is without direction."""
    m = g.members.distinct()
    size = m.groupBy("cluster_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster_id").orderBy("node_id")
    head = m.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ", ").alias("first_members"))
    inner = g.edges.select("source", "rel", "target").join(m.toDF("cluster_id", "source"), "source").join(m.toDF("ct", "target"), "target").where("cluster_id = ct")
    rows = inner.groupBy("cluster_id", "source", "rel", "target").agg(F.count("*").alias("c"))
    total = rows.groupBy("cluster_id").agg(F.sum("c").alias("e"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "source", "rel", "target")
    t = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= triples).groupBy("cluster_id")
    t = t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "source", "rel", "target"))), lambda x: F.concat_ws(" ", x["source"], x["rel"], x["target"])), ", ").alias("top_triples"))
    out = head.join(size, "cluster_id").join(total, "cluster_id", "left").join(t, "cluster_id", "left")
    density = F.when(F.col("n") > 1, F.round(F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2), 6)).otherwise(0.0)
    return out.select("cluster_id", "first_members", F.coalesce("top_triples", F.lit("")).alias("top_triples"), density.alias("density"))


def hub_dominance(edges: DataFrame, most: float = 0.30, diversity: float = 0.50) -> DataFrame:
    """(n_triples, top_share, diversity, dominated): whether one source holds too many triples, or too few sources hold them."""
    by = edges.groupBy("source").agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"), F.max("n").alias("top"), F.count("*").alias("sources"))
    n = F.greatest(F.lit(1), F.col("n_triples"))
    out = out.select("n_triples", F.round(F.coalesce("top", F.lit(0)) / n, 6).alias("top_share"), F.round(F.col("sources") / n, 6).alias("diversity"))
    return out.withColumn("dominated", (F.col("n_triples") > 0) & ((F.col("top_share") > most) | (F.col("diversity") < diversity)))
