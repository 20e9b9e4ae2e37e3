"""Plans and payloads for graph databases and viewers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.json import js, obj
from loomgraph.functions.text import sanitize_identifier
from loomgraph.graph import Graph, full_edges, full_nodes, meta
from loomgraph.plans.session import checkpoint

#: colours by type, by relation, of communities in turn, of what provenance graphs hold
NODE_COLOURS = {"Person": "#FF6B6B", "Location": "#4ECDC4", "Event": "#FFE66D", "Organization": "#95E1D3", "Company": "#95E1D3", "Product": "#F38181"}
EDGE_COLOURS = {"influences": "#FF6B6B", "caused_by": "#4ECDC4", "located_at": "#95E1D3", "collaborates_with": "#FFE66D", "works_with": "#FFE66D"}
CLUSTER_COLOURS = ["#FF6B6B", "#4ECDC4", "#FFE66D", "#95E1D3", "#F38181", "#A8E6CF", "#FFD3B6", "#FFAAA5", "#FF8B94", "#C7CEEA"]
STEP_COLOURS = {"query": "#FF6B6B", "chunk": "#4ECDC4", "community": "#FFE66D", "summary": "#95E1D3", "answer": "#F38181"}
PLAIN_NODE, PLAIN_EDGE = "#A8A8A8", "#CCCCCC"


def _of(table: dict[str, str], c: Column, plain: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(plain))


def node_colour(kind: Column) -> Column:
    """By type; events of all types share one."""
    return F.when(kind.startswith("Event:"), F.lit(NODE_COLOURS["Event"])).otherwise(_of(NODE_COLOURS, kind, PLAIN_NODE))


def edge_colour(rel: Column) -> Column:
    """By relation; roles in events share one."""
    return F.when(rel.startswith("role:"), F.lit(NODE_COLOURS["Event"])).otherwise(_of(EDGE_COLOURS, rel, PLAIN_EDGE))


def cluster_colours(members: DataFrame) -> DataFrame:
    """(cluster_id, colour): in turn, in the order of the clusters."""
    order = F.min("cluster_order") if "cluster_order" in members.columns else F.min("cluster_id")
    c = members.groupBy("cluster_id").agg(order.alias("o"))
    k = F.row_number().over(Window.orderBy("o", "cluster_id")) - 1  # one row for each cluster
    return c.select("cluster_id", F.get(F.array(*[F.lit(x) for x in CLUSTER_COLOURS]), F.pmod(k, F.lit(len(CLUSTER_COLOURS)))).alias("colour"))


def edge_weight(edges: DataFrame) -> DataFrame:
    """Edges with `weight`: their confidence, else that of the metadata, else its weight, else 1."""
    e = full_edges(edges)
    return e.withColumn("weight", F.coalesce("confidence", meta("confidence").cast("double"), meta("weight").cast("double"), F.lit(1.0)))


def sync_plan(g: Graph) -> DataFrame:
    """(n_nodes, n_edges, n_clusters, labels, rel_types, n_pairs): what a sync would write."""
    n = g.nodes.agg(F.count("*").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set(sanitize_identifier(F.coalesce("type", F.lit("Entity"))))), ",").alias("labels"))
    e = g.edges.agg(F.count("*").alias("n_edges"), F.array_join(F.array_sort(F.collect_set(sanitize_identifier(F.col("rel")))), ",").alias("rel_types"))
    c = g.members.agg(F.countDistinct("cluster_id").alias("n_clusters"))
    k = F.col("n_nodes")
    return n.crossJoin(e).crossJoin(c).select("n_nodes", "n_edges", "n_clusters", "labels", "rel_types", F.expr("n_nodes * (n_nodes - 1) div 2").alias("n_pairs")).where(k >= 0)


def sync_statements(g: Graph, similar: float | None = None, clear: bool = False) -> DataFrame:
    """(step, key, label, payload): rows for a writer, by step: 0 clear, 1 nodes, 2 edges, 3 clusters, 4 memberships, 5 similarities of nodes with embeddings."""
    nodes = full_nodes(g.nodes)
    label = sanitize_identifier(F.coalesce("type", F.lit("Entity")))
    body = obj(id=js(F.col("node_id")), type=js(F.coalesce("type", F.lit("Unknown"))), properties=F.col("properties"), metadata=F.col("metadata"), confidence=js(F.col("confidence")), embedding=F.to_json("embedding"))
    out = nodes.select(F.lit(1).alias("step"), F.col("node_id").alias("key"), label.alias("label"), body.alias("payload"))
    body = obj(source=js(F.col("source")), target=js(F.col("target")), relationship_type=js(F.col("rel")), relationship_detail=js(F.col("detail")), metadata=F.col("metadata"), weight=js(F.col("weight")), confidence=js(F.col("confidence")))
    out = out.union(edge_weight(g.edges).select(F.lit(2), "edge_id", sanitize_identifier(F.col("rel"), "RELATES_TO"), body))
    out = out.union(g.members.groupBy("cluster_id").agg(F.countDistinct("node_id").alias("n")).select(F.lit(3), "cluster_id", F.lit("CLUSTER"), obj(id=js(F.col("cluster_id")), size=js(F.col("n")))))
    out = out.union(g.members.select("node_id", "cluster_id").distinct().select(F.lit(4), F.concat_ws(">", "node_id", "cluster_id"), F.lit("MEMBER_OF"), F.to_json(F.struct("node_id", "cluster_id"))))
    if similar is not None:
        pairs = similar_pairs(nodes.where("embedding IS NOT NULL").select(F.col("node_id").alias("id"), "embedding"), similar)
        out = out.union(pairs.select(F.lit(5), F.concat_ws("~", "a", "b"), F.lit("SIMILAR_TO"), obj(source=js(F.col("a")), target=js(F.col("b")), similarity=js(F.col("cosine")))))
    if clear:
        out = g.nodes.sparkSession.createDataFrame([(0, "", "", "{}")], "step int, key string, label string, payload string").union(out)
    return out


_BLOCK = 1024


def similar_pairs(vectors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, cosine) for rows (id, embedding), a < b: exact; lengths that differ and zero vectors give 0.

    The table is cut into blocks by a hash of the id, each pair of blocks is one matrix product.
    """
    v = vectors.select("id", F.col("embedding").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    k = max(1, -(-v.count() // _BLOCK))
    b = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    b = b.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    b = b.withColumns({"x": F.least("b", "o"), "y": F.greatest("b", "o")})

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, object), np.zeros(0, object), np.zeros(0))]
        for _, part in pdf.groupby(pdf["v"].map(len)):
            x = np.stack(part["v"].to_numpy()).astype(float)
            n = np.linalg.norm(x, axis=1)
            x, ids, own = x[n > 0] / n[n > 0, None], part["id"].to_numpy()[n > 0], part["b"].to_numpy()[n > 0]
            first = np.flatnonzero(own == pdf["x"].iloc[0])
            then = np.flatnonzero(own == pdf["y"].iloc[0])
            s = x[first] @ x[then].T
            i, j = np.nonzero(s >= threshold)
            a, c = ids[first[i]], ids[then[j]]
            keep = (a < c) if pdf["x"].iloc[0] == pdf["y"].iloc[0] else a != c
            a, c, s = a[keep], c[keep], s[i, j][keep]
            out.append((np.minimum(a, c), np.maximum(a, c), s))
        a, c, s = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"a": a, "b": c, "cosine": s})

    kind = dict(v.dtypes)["id"]
    found = b.select("x", "y", "b", "id", "v").groupBy("x", "y").applyInPandas(product, f"a {kind}, b {kind}, cosine double")
    if threshold > 0:
        return found
    ids = vectors.select("id").where("id IS NOT NULL")
    every = ids.toDF("a").join(ids.toDF("b"), F.col("a") < F.col("b"))  # all pairs are asked for
    return every.join(found, ["a", "b"], "left").fillna(0.0, ["cosine"])


def embed(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with the embeddings of vectors(text, embedding) for their ids; one row per text counts. A model runs over the distinct ids before, by mapInPandas."""
    v = vectors.groupBy(F.col("text").alias("node_id")).agg(F.first("embedding").alias("new"))
    return full_nodes(nodes).join(v, "node_id", "left").withColumn("embedding", F.coalesce(F.col("new").cast("array<double>"), "embedding")).drop("new")


def viewer(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of viewers: connected nodes only, with their number of edges, the first cluster that holds them and a colour; edges with weight and colour."""
    ends = g.endpoints().groupBy("node_id").agg(F.countDistinct("edge_id").alias("connections"))
    order = F.col("cluster_order") if "cluster_order" in g.members.columns else F.col("cluster_id")
    c = g.members.groupBy("node_id").agg(F.min_by("cluster_id", order).alias("cluster"))
    n = full_nodes(g.nodes).join(ends, "node_id").join(c, "node_id", "left")
    n = n.withColumn("colour", node_colour(F.coalesce("type", F.lit("")))).withColumn("type", F.coalesce("type", F.lit("Unknown")))
    return n, edge_weight(g.edges).withColumn("colour", edge_colour(F.col("rel")))


def _style(colour: Column, **more: Column) -> Column:
    return obj(**{"background-color": js(colour)}, **more)


def cytoscape(g: Graph, recolour: bool = False) -> DataFrame:
    """(kind, id, json): one element per row; nodes may take the colour of their cluster."""
    n, e = viewer(g)
    if recolour:
        n = n.join(cluster_colours(g.members).select(F.col("cluster_id").alias("cluster"), F.col("colour").alias("own")), "cluster", "left").withColumn("colour", F.coalesce("own", "colour"))
    size = F.greatest(F.lit(1), F.least(F.lit(10), "connections"))
    data = obj(id=js(F.col("node_id")), label=js(F.col("node_id")), type=js(F.col("type")), properties=F.col("properties"), metadata=F.col("metadata"), weight=js(size), connection_count=js(F.col("connections")), community=js(F.col("cluster")))
    n = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), obj(data=data, style=_style(F.col("colour"), label=js(F.col("node_id")))).alias("json"))
    width = F.greatest(F.lit(3.0), F.least(F.lit(10.0), F.col("weight") * 5))
    data = obj(id=js(F.concat_ws("-", "source", "target")), source=js(F.col("source")), target=js(F.col("target")), label=js(F.col("rel")), relationship_detail=js(F.col("detail")), weight=js(F.col("weight")), metadata=F.col("metadata"))
    style = obj(**{"width": js(width), "line-color": js(F.col("colour")), "label": js(F.col("rel"))})
    return n.union(e.select(F.lit("edge"), "edge_id", obj(data=data, style=style)))


def vis_network(g: Graph) -> DataFrame:
    """(kind, id, json): nodes and edges for a network viewer."""
    n, e = viewer(g)
    title = F.concat(F.lit("Type: "), "type", F.lit("\nID: "), "node_id")
    body = obj(id=js(F.col("node_id")), label=js(F.col("node_id")), title=js(title), color=js(F.col("colour")), type=js(F.col("type")), properties=F.col("properties"), metadata=F.col("metadata"), group=js(F.col("cluster")))
    n = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), body.alias("json"))
    title = F.concat(F.col("rel"), F.lit("\n"), F.coalesce("detail", F.lit("")))
    body = obj(**{"id": js(F.concat_ws("-", "source", "target")), "from": js(F.col("source")), "to": js(F.col("target")), "label": js(F.col("rel")), "title": js(title), "value": js(F.col("weight")), "color": obj(color=js(F.col("colour"))), "metadata": F.col("metadata")})
    return n.union(e.select(F.lit("edge"), "edge_id", body))


def numbered(nodes: DataFrame) -> DataFrame:
    """(node_id, k): places 0, 1 .. in the order of the ids, without bringing all rows together: by counts of ranges of the sorted ids."""
    s = nodes.select("node_id").distinct().repartitionByRange("node_id").sortWithinPartitions("node_id").withColumn("p", F.spark_partition_id())
    s = checkpoint(s)
    before = s.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    k = F.row_number().over(Window.partitionBy("p").orderBy("node_id"))
    return s.join(before, "p").select("node_id", (k + F.col("before") - 1).alias("k"))


def d3(g: Graph) -> DataFrame:
    """(kind, k, json): connected nodes by number, and links between their numbers."""
    n, e = viewer(g)
    number = numbered(n)
    body = obj(id=js(F.col("node_id")), name=js(F.col("node_id")), type=js(F.col("type")), color=js(F.col("colour")), group=F.coalesce(js(F.col("cluster")), F.lit("0")), properties=F.col("properties"), metadata=F.col("metadata"))
    nodes = n.join(number, "node_id").select(F.lit("node").alias("kind"), F.col("k").cast("string").alias("k"), body.alias("json"))
    e = e.join(number.toDF("source", "i"), "source").join(number.toDF("target", "j"), "target")
    body = obj(source=js(F.col("i")), target=js(F.col("j")), value=js(F.col("weight")), type=js(F.col("rel")), relationship_detail=js(F.col("detail")), metadata=F.col("metadata"))
    return nodes.union(e.select(F.lit("link"), "edge_id", body))


def mermaid(g: Graph, direction: str = "TD") -> DataFrame:
    """(part, k, line): the header, three lines for each node, one for each edge; lines go by (part, k)."""
    n = g.nodes.select("node_id", F.coalesce("type", F.lit("Entity")).alias("type")).join(numbered(g.nodes), "node_id")
    name = F.concat(F.lit("N"), F.col("k").cast("string"))
    plain = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    colour = node_colour(F.col("type"))
    lines = F.array(
        F.concat(F.lit("    "), name, F.lit('["'), plain(F.concat("node_id", F.lit("<br/>("), "type", F.lit(")"))), F.lit('"]')),
        F.concat(F.lit("    classDef style_"), name, F.lit(" fill:"), colour, F.lit(",stroke:#333,stroke-width:2px")),
        F.concat(F.lit("    class "), name, F.lit(" style_"), name),
    )
    head = g.nodes.sparkSession.createDataFrame([(0, "", f"graph {direction}")], "part int, k string, line string")
    number = n.select("node_id", name.alias("n"))
    nodes = n.select("k", F.posexplode(lines).alias("i", "line")).select(F.lit(1), F.concat(F.lpad(F.col("k").cast("string"), 18, "0"), F.lit("."), F.col("i").cast("string")), "line")
    e = full_edges(g.edges).join(number.toDF("source", "ns"), "source", "left").join(number.toDF("target", "nt"), "target", "left")
    rel = F.substring(plain(F.col("rel")), 1, 20)
    label = F.when(F.length(F.coalesce("detail", F.lit(""))) <= 50, F.concat(rel, F.lit("\\n("), F.coalesce("detail", F.lit("")), F.lit(")"))).otherwise(rel)
    edges = e.select(F.lit(2), "edge_id", F.concat(F.lit("    "), F.coalesce("ns", "source"), F.lit(' -->|"'), label, F.lit('"| '), F.coalesce("nt", "target")))
    return head.union(nodes).union(edges)


def provenance_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json) of a graph of how an answer came about: nodes(id, type, label, data), edges(source, target, type, label, weight)."""
    data = obj(id=js(F.col("id")), label=js(F.col("label")), type=js(F.col("type")), data=F.col("data"))
    n = nodes.select(F.lit("node").alias("kind"), "id", obj(data=data, style=_style(_of(STEP_COLOURS, F.col("type"), PLAIN_NODE), label=js(F.col("label")))).alias("json"))
    key = F.concat_ws("-", "source", "target")
    data = obj(id=js(key), source=js(F.col("source")), target=js(F.col("target")), label=js(F.col("label")), type=js(F.col("type")), weight=js(F.col("weight")))
    width = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("weight") * 3))
    return n.union(edges.select(F.lit("edge"), key, obj(data=data, style=obj(width=js(width), label=js(F.col("label"))))))
