"""Graphs as JSON: the property-graph form, linked data, the enriched form, the legacy form; text and table sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.json import fields, js, obj, prefixed
from loomgraph.graph import Graph, complete, full_edges, full_nodes, meta

_NODE = "struct<id: string, type: string, confidence: double, properties: string, metadata: string, embedding: array<double>>"
_EDGE = "struct<source: string, target: string, relationship_type: string, relationship_detail: string, start_time: string, end_time: string, created_at: string, updated_at: string, confidence: double, is_negated: boolean, metadata: string>"
SCHEMA = f"nodes array<{_NODE}>, edges array<{_EDGE}>, clusters array<struct<id: string, node_ids: array<string>>>"


def _strings(key: str) -> Column:
    return F.from_json(meta(key), "array<string>")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Nodes, edges and clusters of JSON files, with their properties and metadata.

    Order is that of the files' paths and of the lists in them; of nodes with one id the last counts; members that are no nodes are left out.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    n = raw.select("file", F.posexplode("nodes").alias("k", "n")).groupBy(F.col("n.id").alias("node_id")).agg(F.max_by("n", F.struct("file", "k")).alias("n"))
    n = n.select("node_id", "n.type", "n.confidence", "n.properties", "n.metadata", "n.embedding")
    n = full_nodes(n.withColumns({"aliases": _strings("aliases"), "source_documents": _strings("source_documents")}))
    e = raw.select("file", F.posexplode("edges").alias("k", "e")).select(
        F.format_string("%s#%09d", "file", "k").alias("edge_id"), F.col("e.source").alias("source"), F.col("e.relationship_type").alias("rel"), F.col("e.target").alias("target"),
        F.col("e.start_time").alias("valid_from"), F.col("e.end_time").alias("valid_to"), F.col("e.confidence").alias("confidence"), F.col("e.relationship_detail").alias("detail"),
        F.coalesce("e.is_negated", F.lit(False)).alias("is_negated"), F.col("e.created_at").alias("created_at"), F.col("e.updated_at").alias("updated_at"), F.col("e.metadata").alias("metadata"),
    )
    e = e.withColumns({"inferred": F.coalesce(meta("inferred") == "true", F.lit(False)), "document_id": F.coalesce(meta("provenance.document_id"), meta("source_ref"), _strings("source_documents")[0])})
    m = raw.select("file", F.posexplode("clusters").alias("k", "c")).select("file", F.col("c.id").alias("cluster_id"), F.explode("c.node_ids").alias("node_id"), "k")
    m = m.join(n.select("node_id"), "node_id", "left_semi").select("cluster_id", "node_id", F.format_string("%s#%09d", "file", "k").alias("cluster_order"))
    return Graph(n, full_edges(e), m)


def node_json(nodes: DataFrame) -> DataFrame:
    """(node_id, json): null keys are left out; properties and metadata as they are."""
    n = full_nodes(nodes)
    body = obj(id=js(F.col("node_id")), type=js(F.col("type")), properties=F.col("properties"), metadata=F.col("metadata"), embedding=F.to_json("embedding"), confidence=js(F.col("confidence")))
    return n.select("node_id", body.alias("json"))


def _edge_fields() -> dict[str, Column]:
    return {
        "start_time": js(F.col("valid_from")), "end_time": js(F.col("valid_to")), "created_at": js(F.col("created_at")), "updated_at": js(F.col("updated_at")),
        "confidence": js(F.col("confidence")), "is_negated": F.when(F.col("is_negated"), F.lit("true")),
    }


def edge_json(edges: DataFrame) -> DataFrame:
    """(edge_id, json)."""
    body = obj(source=js(F.col("source")), target=js(F.col("target")), relationship_type=js(F.col("rel")), relationship_detail=js(F.col("detail")), metadata=F.col("metadata"), **_edge_fields())
    return full_edges(edges).select("edge_id", body.alias("json"))


def events_json(g: Graph) -> DataFrame:
    """(node_id, json): event nodes in the form of events, with their participants by role."""
    from loomgraph.operators.search import event_role, is_event_type

    ev = full_nodes(g.nodes).where(is_event_type(F.col("type")))
    e = g.edges.join(ev.select(F.col("node_id").alias("source")), "source", "left_semi")
    part = e.where("lower(rel) LIKE 'role:%'").groupBy("source", event_role(F.col("rel")).alias("role")).agg(F.array_sort(F.collect_set("target")).alias("t"))
    part = part.groupBy(F.col("source").alias("node_id")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "t"))))).alias("participants"))
    place = e.where("rel = 'occurred_at'").groupBy(F.col("source").alias("node_id")).agg(F.min("target").alias("location"))
    when = e.groupBy(F.col("source").alias("node_id")).agg(F.min("valid_from").alias("a"), F.max("valid_to").alias("b"))
    out = ev.join(part, "node_id", "left").join(place, "node_id", "left").join(when, "node_id", "left")
    time = F.when(F.coalesce("a", "b").isNotNull(), obj(start=js(F.col("a")), end=js(F.col("b"))))
    kind = F.regexp_replace("type", r"(?i)^event:", "")
    body = obj(id=js(F.col("node_id")), event_type=js(kind), participants=F.coalesce("participants", F.lit("{}")), timestamp=time, location=js(F.col("location")), confidence=js(F.col("confidence")))
    return out.select("node_id", body.alias("json"))


def cluster_json(members: DataFrame) -> DataFrame:
    """(cluster_id, json)."""
    c = members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("node_id")).alias("ids"))
    return c.select("cluster_id", obj(id=js(F.col("cluster_id")), node_ids=F.to_json("ids")).alias("json"))


def write_graph(g: Graph, folder: str, events: bool = True) -> None:
    """JSON lines in a folder each for nodes, edges, clusters and (where there are any) events, written by all executors."""
    parts = {"nodes": node_json(g.nodes), "edges": edge_json(g.edges), "clusters": cluster_json(g.members)}
    if events:
        parts["events"] = events_json(g)
    for name, rows in parts.items():
        rows.select(F.col("json").alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def _flat(struct: str) -> str:
    """The fields of a struct type as a table's schema."""
    return struct[7:-1].replace(": ", " ")


def read_folder(spark: SparkSession, folder: str) -> Graph:
    """What write_graph wrote."""
    n = spark.read.schema(_flat(_NODE)).json(f"{folder}/nodes").withColumnRenamed("id", "node_id")
    n = full_nodes(n.withColumns({"aliases": _strings("aliases"), "source_documents": _strings("source_documents")}))
    e = spark.read.schema(_flat(_EDGE)).json(f"{folder}/edges").withColumnsRenamed({"relationship_type": "rel", "relationship_detail": "detail", "start_time": "valid_from", "end_time": "valid_to"})
    e = e.withColumns({
        "edge_id": F.concat_ws(">", "source", "rel", "target", F.sha1(F.to_json(F.struct("valid_from", "valid_to", "metadata")).cast("binary"))),
        "inferred": F.coalesce(meta("inferred") == "true", F.lit(False)), "document_id": F.coalesce(meta("provenance.document_id"), meta("source_ref"), _strings("source_documents")[0]),
    })
    c = spark.read.schema("id string, node_ids array<string>").json(f"{folder}/clusters").select(F.col("id").alias("cluster_id"), F.explode("node_ids").alias("node_id"))
    return Graph(n, full_edges(e), c)


CONTEXT = '{"@context":{"@vocab":"https://schema.org/","kg":"https://example.org/kg/"}}'


def linked_data(g: Graph) -> DataFrame:
    """(kind, id, json): the elements of the graph as linked data; the row of kind 'context' names the vocabularies."""
    kg = lambda kind, c: js(F.concat(F.lit(f"kg:{kind}/"), c))
    ref = lambda c: obj(at__id=kg("node", c))
    n = full_nodes(g.nodes)
    body = obj(at__id=kg("node", F.col("node_id")), at__type=js(F.coalesce("type", F.lit("Thing"))), identifier=js(F.col("node_id")))
    n = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), fields(body, prefixed(F.col("properties"), "kg:prop/"), prefixed(F.col("metadata"), "kg:meta/"), obj(confidence=js(F.col("confidence")))).alias("json"))
    e = full_edges(g.edges)
    times = {k: v for k, v in _edge_fields().items() if k not in ("created_at", "updated_at")}
    body = obj(
        at__id=kg("edge", F.concat_ws("-", "source", "target")), at__type=F.lit('"Relationship"'), source=ref(F.col("source")), target=ref(F.col("target")),
        relationship_type=js(F.col("rel")), relationship_detail=js(F.col("detail")), **times,
    )
    e = e.select(F.lit("edge"), "edge_id", fields(body, prefixed(F.col("metadata"), "kg:meta/")))
    c = g.members.groupBy("cluster_id").agg(F.array_sort(F.collect_set("node_id")).alias("ids"))
    ids = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: ref(x)), ","), F.lit("]"))
    c = c.select(F.lit("cluster"), "cluster_id", obj(at__id=kg("cluster", F.col("cluster_id")), at__type=F.lit('"Cluster"'), identifier=js(F.col("cluster_id")), members=ids))
    head = g.nodes.sparkSession.createDataFrame([("context", "", CONTEXT)], "kind string, id string, json string")
    return head.union(n).union(e).union(c)


def enriched(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, communities) of the enriched form; a relationship's confidence may come from its metadata."""
    e = full_edges(g.edges).select(
        "source", "target", F.col("rel").alias("relationship_type"), F.col("detail").alias("relationship_detail"), F.col("valid_from").alias("start_time"), F.col("valid_to").alias("end_time"),
        F.coalesce("confidence", meta("confidence").cast("double")).alias("confidence"), F.coalesce("is_negated", F.lit(False)).alias("is_negated"), F.coalesce(meta("source_ref"), "document_id").alias("source_ref"),
    )
    c = g.members.groupBy(F.col("cluster_id").alias("id")).agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    return full_nodes(g.nodes).select(F.col("node_id").alias("name"), "type", "properties", "metadata", "confidence"), e, c


def from_enriched(entities: DataFrame, relationships: DataFrame, communities: DataFrame | None = None) -> Graph:
    """The graph of the enriched form; dates may stand in a temporal block of the metadata."""
    n = full_nodes(entities.withColumnRenamed("name", "node_id").withColumn("confidence", F.col("confidence").cast("double")))
    r = relationships
    for c, kind in (("relationship_detail", "string"), ("start_time", "string"), ("end_time", "string"), ("is_negated", "boolean"), ("source_ref", "string"), ("metadata", "string"), ("confidence", "double")):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(kind))
    given = obj(confidence=js(F.col("confidence")), source_ref=js(F.col("source_ref")))
    e = r.select(
        F.concat_ws(">", "source", "relationship_type", "target").alias("edge_id"), "source", F.col("relationship_type").alias("rel"), "target", F.col("relationship_detail").alias("detail"),
        F.coalesce(meta("temporal.valid_from"), meta("temporal.start"), "start_time", meta("start_time")).alias("valid_from"), F.coalesce(meta("temporal.valid_to"), meta("temporal.end"), "end_time", meta("end_time")).alias("valid_to"),
        "confidence", F.coalesce("is_negated", F.lit(False)).alias("is_negated"), F.col("source_ref").alias("document_id"), F.when(given != "{}", given).alias("metadata"),
    )
    none = n.select(F.lit("").alias("cluster_id"), "node_id").limit(0)
    return Graph(n, full_edges(e), none if communities is None else communities.select(F.col("id").alias("cluster_id"), F.explode("node_ids").alias("node_id")))


def from_typed(entities: DataFrame, triples: DataFrame) -> Graph:
    """The legacy form: (name, type) and (s, r, o); names that only triples hold become nodes without a type."""
    t = triples.select("s", "r", "o").distinct()
    known = entities.groupBy(F.col("name").alias("node_id")).agg(F.min("type").alias("type"))
    ends = t.select(F.col("s").alias("node_id")).union(t.select("o")).distinct().join(known, "node_id", "left_anti")
    n = known.unionByName(ends.withColumn("type", F.lit(None).cast("string"))).withColumn("confidence", F.lit(None).cast("double"))
    e = t.select(F.concat_ws(">", "s", "r", "o").alias("edge_id"), F.col("s").alias("source"), F.col("r").alias("rel"), F.col("o").alias("target"))
    return Graph(n, complete(e), n.select(F.lit("").alias("cluster_id"), "node_id").limit(0))


def from_triples(triples: DataFrame) -> Graph:
    """The legacy form without types."""
    return from_typed(triples.sparkSession.createDataFrame([], "name string, type string"), triples)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
