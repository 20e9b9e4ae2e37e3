"""From extracted facts to a graph: filters, name mapping, scores, pruning, schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.json import obj
from loomgraph.functions.numbers import clamp
from loomgraph.graph import Graph, full_edges, full_nodes
from loomgraph.plans.session import checkpoint

_BY = "builds:built creates:created designs:designed develops:developed establishes:established founds:founded makes:made manages:managed manufactures:manufactured operates:operated owns:owned possesses:possessed produces:produced programs:programmed controls:controlled"
_BOTH = {a: f"{b}_by" for a, b in (x.split(":") for x in _BY.split())} | {"contains": "located_in", "has_member": "member_of", "has_part": "part_of", "hosts": "located_at", "parent_of": "child_of", "reports_to": "manager_of", "works_at": "employs"}
#: a relation and its inverse; those of the second line have one that leads elsewhere back
REVERSE = _BOTH | {b: a for a, b in _BOTH.items()} | {x: x for x in ("collaborates_with", "connected_to", "partners_with", "related_to")}
REVERSE |= {"belongs_to": "has_member", "created": "created_by", "designed": "designed_by", "employed_by": "employs", "founded": "founded_by", "situated_in": "contains", "subordinate_of": "supervises", "supervisor_of": "reports_to", "works_for": "employs"}


def keep_types(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """Mentions of declared types."""
    return mentions.join(types.select(F.col("name").alias("type")).distinct(), "type", "left_semi")


def schema_filter(triples: DataFrame, mentions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triples (s, r, o) whose relation and end types are in allowed(name, src, dst); a name with several types passes if any does."""
    m = mentions.select("name", "type").distinct()
    typed = triples.join(m.toDF("s", "st"), "s").join(m.toDF("o", "ot"), "o")
    ok = typed.join(allowed.select(F.lower("name").alias("n"), "src", "dst").distinct(), (F.lower("r") == F.col("n")) & (F.col("st") == F.col("src")) & (F.col("ot") == F.col("dst")), "left_semi")
    return ok.drop("st", "ot").dropDuplicates(["s", "r", "o"])


def reverse_name(rel: Column) -> Column:
    """The inverse of a relation's name: by table, else by its form (made_by: make, head_of: has_head, taken_from: takens, leads: leaded_by); null for a place (in, at)."""
    k = F.lower(F.trim(rel))
    known = F.create_map(*[F.lit(x) for kv in REVERSE.items() for x in kv])[k]
    cut = lambda n: F.substring(k, F.lit(1), F.length(k) - n)
    with_s = lambda c: F.when(c.endswith("s"), c).otherwise(F.concat(c, F.lit("s")))
    by = F.when(cut(3).endswith("ed"), cut(3)).otherwise(with_s(cut(3)))
    form = (
        F.when(k.endswith("_by"), by).when(k.endswith("_of"), F.concat(F.lit("has_"), cut(3))).when(k.endswith("_from"), with_s(cut(5)))
        .when(k.rlike("_(?:in|at)$"), None).when(k.endswith("s"), F.concat(cut(1), F.lit("ed_by"))).otherwise(F.concat(k, F.lit("d_by")))
    )
    return F.coalesce(known, form)


def turn_reversed(triples: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triples whose relation is not allowed but whose inverse is, turned around."""
    names = allowed.select(F.lower("name").alias("n")).distinct().withColumn("known", F.lit(True))
    t = triples.join(names, F.lower("r") == F.col("n"), "left").withColumn("keep", F.coalesce("known", F.lit(False))).drop("n", "known")
    t = t.join(names, reverse_name(F.col("r")) == F.col("n"), "left").withColumn("turn", ~F.col("keep") & F.coalesce("known", F.lit(False)))
    return t.where("keep OR turn").select(F.when(F.col("turn"), F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("turn"), reverse_name(F.col("r"))).otherwise(F.col("r")).alias("r"), F.when(F.col("turn"), F.col("s")).otherwise(F.col("o")).alias("o"))


def drop_doubtful(triples: DataFrame, least: float = 0.0, keep_negated: bool = False) -> DataFrame:
    """Without negated triples and those of low confidence; null confidence stays."""
    ok = F.coalesce(F.col("confidence") >= least, F.lit(True))
    return triples.where(ok if keep_negated else ok & ~F.coalesce("is_negated", F.lit(False)))


def first_triples(edges: DataFrame) -> DataFrame:
    """Of equal triples (relation in any case) the first edge."""
    return edges.groupBy("source", F.lower("rel").alias("k"), "target").agg(F.min_by(F.struct(*edges.columns), "edge_id").alias("b")).select("b.*")


def one_per_pair(edges: DataFrame) -> DataFrame:
    """Of edges with the same two ends, either way, and the same evidence: the most confident, the first on ties."""
    a, b = F.lower("source"), F.lower("target")
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b), F.coalesce("document_id", F.lit(""))).orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "edge_id")
    return edges.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def prune_isolated(g: Graph) -> Graph:
    """Without nodes that no edge touches (unless there are no edges); clusters shrink."""
    if not g.edges.take(1):
        return g
    ends = g.endpoints().select("node_id").distinct()
    return Graph(g.nodes.join(ends, "node_id", "left_semi"), g.edges, g.members.join(ends, "node_id", "left_semi"))


def canonical(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends renamed by names(name, canonical); self-loops go, of equal triples the first stays."""
    for side in ("source", "target"):
        edges = edges.join(names.select(F.col("name").alias(side), F.col("canonical").alias("__c")), side, "left").withColumn(side, F.coalesce("__c", side)).drop("__c")
    return first_triples(edges.where("source <> target"))


def entity_confidence(nodes: DataFrame, types: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """0.6, more for a declared type (.15), a name that a text holds as whole words (.10) and a name of several words (.05); a score given stays; within 0.05 and 1."""
    t = types.select(F.col("name").alias("type")).distinct().withColumn("__d", F.lit(0.15))
    s = F.lit(0.6) + F.coalesce("__d", F.lit(0.0)) + F.when(F.size(F.split(X.squeeze(F.col("node_id")), " ")) > 1, 0.05).otherwise(0.0)
    out = nodes.join(t, "type", "left")
    if texts is not None:
        from .text import names_in

        said = names_in(texts, nodes.select(F.col("node_id").alias("term"))).select(F.col("term").alias("node_id")).distinct().withColumn("__s", F.lit(0.1))
        out, s = out.join(said, "node_id", "left"), s + F.coalesce("__s", F.lit(0.0))
    return out.withColumn("confidence", F.round(clamp(F.coalesce("confidence", s), 0.05), 4)).select(*nodes.columns)


def relation_confidence(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """0.5, more for typed ends (.10), an allowed signature (.20) and dates (.05), less for negation (.30)."""
    n = nodes.select("node_id", "type")
    e = edges.join(n.toDF("source", "st"), "source", "left").join(n.toDF("target", "tt"), "target", "left")
    a = allowed.select(F.lower("name").alias("__n"), F.col("src").alias("__s"), F.col("dst").alias("__t")).distinct().withColumn("__ok", F.lit(0.2))
    e = e.join(a, (F.lower("rel") == F.col("__n")) & (F.col("st") == F.col("__s")) & (F.col("tt") == F.col("__t")), "left")
    s = F.lit(0.5) + F.when(F.col("st").isNotNull() & F.col("tt").isNotNull(), 0.1).otherwise(0.0) + F.coalesce("__ok", F.lit(0.0))
    s = s + F.when(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(), 0.05).otherwise(0.0)
    if "is_negated" in edges.columns:
        s = s - F.when(F.coalesce("is_negated", F.lit(False)), 0.3).otherwise(0.0)
    return e.withColumn("confidence", F.round(clamp(F.coalesce("confidence", s), 0.05), 4)).select(*edges.columns)


def candidate_pairs(nodes: DataFrame, allowed: DataFrame, limit: int | None = None) -> DataFrame:
    """(name, source, target): pairs of entities that a relation's signature allows."""
    n = nodes.select("node_id", "type")
    out = allowed.select("name", "src", "dst").distinct().join(n.toDF("source", "src"), "src").join(n.toDF("target", "dst"), "dst").where("source <> target").select("name", "source", "target").distinct()
    return out.orderBy("name", "source", "target").limit(limit) if limit else out


def split_hubs(g: Graph, least: int = 10) -> DataFrame:
    """(source, rel, target): edges of hubs led over a proxy for each hub and relation; a hub is joined to its proxies."""
    if least < 3:
        raise ValueError("a hub needs a degree of at least 3")
    hubs = g.endpoints().groupBy("node_id").agg(F.count("*").alias("d")).where(F.col("d") >= least).select("node_id")
    proxy = lambda hub, rel: F.concat(F.lit("proxy:"), hub, F.lit("::"), rel)
    e = g.edges.join(hubs.select(F.col("node_id").alias("source"), F.lit(True).alias("hs")), "source", "left").join(hubs.select(F.col("node_id").alias("target"), F.lit(True).alias("ht")), "target", "left")
    s = F.when(F.col("hs"), proxy(F.col("source"), F.col("rel"))).otherwise(F.col("source"))
    t = F.when(F.col("ht"), proxy(F.col("target"), F.col("rel"))).otherwise(F.col("target"))
    routed = e.select(s.alias("source"), "rel", t.alias("target"))
    join = e.where("hs").select("source", F.lit("has_proxy").alias("rel"), proxy(F.col("source"), F.col("rel")).alias("target"))
    join = join.unionByName(e.where("ht").select(F.col("target").alias("source"), F.lit("has_proxy").alias("rel"), proxy(F.col("target"), F.col("rel")).alias("target")))
    return routed.unionByName(join).distinct()


def join_hubs(split: DataFrame) -> DataFrame:
    """The edges before split_hubs, each once."""
    back = lambda c: F.when(F.col(c).startswith("proxy:"), F.regexp_extract(c, r"^proxy:(.*)::", 1)).otherwise(F.col(c))
    return split.where("rel <> 'has_proxy'").select(back("source").alias("source"), "rel", back("target").alias("target")).distinct()


def validate(g: Graph) -> DataFrame:
    """(severity, code, subject): broken references, missing names and repetitions; one row 'graph_valid' where nothing is an error.

    Repetitions of a node or a triple give a row for each row after the first.
    """
    n, e, m = g.nodes, g.edges, g.members
    ids = n.select("node_id").distinct()
    issue = lambda rows, severity, code, c: rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), c.cast("string").alias("subject"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    again = lambda rows, *by: rows.groupBy(*by).count().where("count > 1").withColumn("k", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("count"))))
    whole = e.where("source IS NOT NULL AND rel IS NOT NULL AND target IS NOT NULL")
    out = [
        issue(n.where(blank("node_id")), "error", "node_missing_id", F.lit(None)),
        issue(again(n.where(~blank("node_id")), "node_id"), "error", "duplicate_node_id", F.col("node_id")),
        issue(e.where(blank("source")), "error", "edge_missing_source", F.col("edge_id")),
        issue(e.where(blank("target")), "error", "edge_missing_target", F.col("edge_id")),
        issue(e.where(blank("rel")), "error", "edge_missing_relationship_type", F.col("edge_id")),
        issue(e.where(~blank("source")).join(ids.withColumnRenamed("node_id", "source"), "source", "left_anti"), "error", "edge_source_missing_node", F.col("edge_id")),
        issue(e.where(~blank("target")).join(ids.withColumnRenamed("node_id", "target"), "target", "left_anti"), "error", "edge_target_missing_node", F.col("edge_id")),
        issue(again(whole, "source", "rel", "target"), "warning", "duplicate_edge", F.concat_ws(" ", "source", "rel", "target")),
        issue(m.where(blank("cluster_id")), "error", "cluster_missing_id", F.col("node_id")),
        issue(m.join(ids, "node_id", "left_anti"), "error", "cluster_member_missing_node", F.concat_ws(" ", "cluster_id", "node_id")),
    ]
    if "cluster_order" in m.columns:
        out.append(issue(m.select("cluster_id", "cluster_order").distinct().groupBy("cluster_id").count().where("count > 1"), "warning", "duplicate_cluster_id", F.col("cluster_id")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    all_ = checkpoint(all_)
    errors = all_.where("severity = 'error'").agg(F.count("*").alias("n"))
    return all_.unionByName(issue(errors.where("n = 0"), "info", "graph_valid", F.lit(None)))


def validate_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, severity, code, subject): what is wrong with the shape of graphs as JSON files: lists that are none, entries that are no objects, types that are no text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    part = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    out = None
    for name, code, one in (("nodes", "nodes_not_list", "node_not_object"), ("edges", "edges_not_list", "edge_not_object"), ("clusters", "clusters_not_list", "cluster_not_object")):
        there = part(name).isNotNull() | F.lit(name != "clusters")
        bad = raw.where(there & (F.coalesce(kind(part(name)), F.lit("")) != "ARRAY")).select("path", F.lit("error").alias("severity"), F.lit(code).alias("code"), F.lit(f"$.{name}").alias("subject"))
        items = raw.where(kind(part(name)) == "ARRAY").select("path", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("k", "x"))
        at = F.format_string(f"$.{name}[%d]", "k")
        rows = [bad, items.where(F.coalesce(kind(F.col("x")), F.lit("")) != "OBJECT").select("path", F.lit("error"), F.lit(one), at)]
        objects = items.where(kind(F.col("x")) == "OBJECT")
        if name == "nodes":
            rows.append(objects.where(~F.coalesce(kind(F.try_variant_get("x", "$.type", "variant")), F.lit("VOID")).isin("STRING", "VOID")).select("path", F.lit("warning"), F.lit("node_type_not_string"), at))
        if name == "clusters":
            rows.append(objects.where(F.coalesce(kind(F.try_variant_get("x", "$.node_ids", "variant")), F.lit("")) != "ARRAY").select("path", F.lit("error"), F.lit("cluster_members_not_list"), at))
        for r in rows:
            out = r if out is None else out.union(r)
    return out


def build_graph(mentions: DataFrame, triples: DataFrame, docs: DataFrame, allowed: DataFrame | None = None, types: DataFrame | None = None, names: DataFrame | None = None, events: DataFrame | None = None, prune: bool = True) -> Graph:
    """A graph from what was extracted: mentions (doc_id, name, type), triples (doc_id, s, r, o, confidence, is_negated and more, if known), docs (doc_id, text).

    Names are mapped (names: name, canonical), a schema keeps what it allows, of edges with the same ends and evidence the most confident stays,
    scores are filled in, ends without a mention become nodes, every edge gets its evidence (the sentence with both ends) and provenance and every
    node its documents, event nodes join, names that became equal fold, isolated nodes go.
    """
    from . import provenance
    from .text import sentence_spans

    m = mentions.select("doc_id", "name", "type").where("trim(name) <> ''")
    t = triples
    for c, kind in (("confidence", "double"), ("is_negated", "boolean"), ("detail", "string"), ("valid_from", "string"), ("valid_to", "string")):
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast(kind))
    if names is not None:
        to = names.groupBy("name").agg(F.min("canonical").alias("__c"))
        m = m.join(to, "name", "left").withColumn("name", F.coalesce("__c", "name")).drop("__c")
        for side in ("s", "o"):
            t = t.join(to.withColumnRenamed("name", side), side, "left").withColumn(side, F.coalesce("__c", side)).drop("__c")
    if types is not None:
        m = keep_types(m, types)
    if allowed is not None:
        ok = schema_filter(t.select("s", "r", "o").distinct(), m, allowed)
        t = t.join(ok.select("s", "r", "o").distinct(), ["s", "r", "o"], "left_semi")
    # what is used again and again is computed once, else plans multiply until the driver can't hold them
    m, t = checkpoint(m), checkpoint(t.where("s <> o"))
    sents = sentence_spans(docs)
    j = t.select("doc_id", "s", "r", "o").distinct().join(sents, "doc_id").where(F.contains(F.lower("sentence"), F.lower("s")) & F.contains(F.lower("sentence"), F.lower("o")))
    ev = j.groupBy("doc_id", "s", "r", "o").agg(F.min_by(F.struct("sentence_id", "start", "end", "sentence"), "k").alias("ev"))
    t = t.join(ev, ["doc_id", "s", "r", "o"], "left")
    doc = F.col("doc_id").cast("string")
    e = t.select(
        F.concat_ws(">", "s", "r", "o", doc).alias("edge_id"), F.col("s").alias("source"), F.col("r").alias("rel"), F.col("o").alias("target"), "valid_from", "valid_to", "confidence", doc.alias("document_id"), "detail", "is_negated",
        F.struct(doc.alias("document_id"), F.col("ev.sentence_id").alias("sentence_id"), F.lit(None).cast("string").alias("chunk_id"), F.col("ev.sentence").alias("snippet"), F.lit(None).cast("string").alias("extracted_at"), F.lit(None).cast("string").alias("extractor_version"), F.when(F.col("ev").isNotNull(), F.array("ev.start", "ev.end")).alias("source_span")).alias("provenance"),
    ).dropDuplicates(["edge_id"])
    e = checkpoint(e)
    attached = provenance.attach(full_edges(e).join(e.select("edge_id", "provenance"), "edge_id"))
    e = checkpoint(one_per_pair(full_edges(attached.drop("provenance"))))
    kind = m.groupBy("name", "type").agg(F.count("*").alias("n")).groupBy(F.col("name").alias("node_id")).agg(F.max_by("type", F.struct("n", "type")).alias("type"))
    ends = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct().join(kind, "node_id", "left_anti").withColumn("type", F.lit(None).cast("string"))
    where = m.select(F.col("name").alias("node_id"), "doc_id").union(t.select("s", "doc_id")).union(t.select("o", "doc_id"))
    where = where.groupBy("node_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("source_documents"))
    n = kind.unionByName(ends).join(where, "node_id", "left").withColumn("confidence", F.lit(None).cast("double"))
    n = checkpoint(full_nodes(n.withColumn("metadata", obj(source_documents=F.to_json("source_documents")))))
    none = types if types is not None else n.select(F.lit("").alias("name")).limit(0)
    n = checkpoint(entity_confidence(n, none, docs.select("doc_id", "text")))
    e = relation_confidence(e, n, allowed if allowed is not None else none.select("name", F.lit("").alias("src"), F.lit("").alias("dst")).limit(0))
    if events is not None:
        from .events import project

        en, ee = project(events)
        n = n.unionByName(full_nodes(en.join(n.select("node_id"), "node_id", "left_anti")))
        e = e.unionByName(full_edges(ee.join(n.select(F.col("node_id").alias("target")), "target", "left_semi")))
    g = Graph(n, checkpoint(first_triples(e)), n.select(F.lit("").alias("cluster_id"), "node_id").limit(0))
    return prune_isolated(g) if prune else g
