"""Single-pass inference rules; every rule reads the same graph, the first support of a triple counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.json import js, obj
from loomgraph.functions.numbers import clamp
from loomgraph.graph import Graph, full_edges

SYMMETRIC = ("allied_with", "associated_with", "co-occurs_with", "collaborated_with", "competes_with", "married_to", "related_to", "sibling_of")
TRANSITIVE = ("contained_in", "is_a", "located_in", "owned_by", "part_of", "reports_to", "subclass_of", "subset_of")
_PAIRS = (("acquired", "acquired_by"), ("employs", "employed_by"), ("founded", "founded_by"), ("leads", "led_by"), ("located_in", "location_of"), ("member_of", "has_member"), ("owns", "owned_by"), ("parent_of", "child_of"), ("part_of", "has_part"), ("produces", "produced_by"))
INVERSE = dict(_PAIRS) | {b: a for a, b in _PAIRS}
COMPOSED = {("founded_by", "born_in"): "founder_from", ("member_of", "located_in"): "active_in", ("owns", "located_in"): "operates_in", ("subsidiary_of", "located_in"): "operates_in", ("works_for", "located_in"): "works_in"}
OUT = ("source", "rel", "target", "confidence", "rule", "via", "support", "n_same")

Rule = Callable[[Graph], DataFrame]


def _c(c) -> Column:
    return F.coalesce(c, F.lit(0.5))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def _first(rows: DataFrame, rule: str, factor: float) -> DataFrame:
    """Per triple the support that comes first, and how many there are."""
    best = rows.groupBy("source", "rel", "target").agg(F.min(F.struct("support", "via", "product")).alias("b"), F.count("*").alias("n_same"))
    return best.select("source", "rel", "target", F.round(clamp(F.col("b.product") * factor), 4).alias("confidence"), F.lit(rule).alias("rule"), F.col("b.via").alias("via"), F.col("b.support").alias("support"), "n_same")


def _missing(rows: DataFrame, g: Graph) -> DataFrame:
    return rows.join(g.edges.select("source", "rel", "target").distinct(), ["source", "rel", "target"], "left_anti")


def symmetric(g: Graph) -> DataFrame:
    e = g.edges.where(F.col("rel").isin(*SYMMETRIC))
    back = e.select(F.col("target").alias("source"), "rel", F.col("source").alias("target"), F.col("edge_id").alias("support"), F.lit(None).cast("string").alias("via"), _c("confidence").alias("product"))
    return _first(_missing(back, g), "symmetric", 0.95)


def inverse(g: Graph) -> DataFrame:
    e = g.edges.where(F.col("rel").isin(*INVERSE))
    back = e.select(F.col("target").alias("source"), _lookup(INVERSE, F.col("rel")).alias("rel"), F.col("source").alias("target"), F.col("edge_id").alias("support"), F.lit(None).cast("string").alias("via"), _c("confidence").alias("product"))
    return _first(_missing(back, g), "inverse", 0.9)


def _two(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select("source", F.col("rel").alias("r1"), F.col("target").alias("via"), F.col("edge_id").alias("e1"), _c("confidence").alias("c1"))
    b = second.select(F.col("source").alias("via"), F.col("rel").alias("r2"), "target", F.col("edge_id").alias("e2"), _c("confidence").alias("c2"))
    both = a.join(b, "via").where("source <> target")
    return both.select("source", "r1", "r2", "target", "via", F.concat_ws("|", "e1", "e2").alias("support"), (F.col("c1") * F.col("c2")).alias("product"))


def transitive(g: Graph) -> DataFrame:
    e = g.edges.where(F.col("rel").isin(*TRANSITIVE))
    both = _two(e, e).where("r1 = r2").withColumnRenamed("r1", "rel").drop("r2")
    return _first(_missing(both, g), "transitive", 0.85)


def composition(g: Graph) -> DataFrame:
    firsts, seconds = zip(*COMPOSED)
    both = _two(g.edges.where(F.col("rel").isin(*firsts)), g.edges.where(F.col("rel").isin(*seconds)))
    rel = _lookup({f"{a}|{b}": c for (a, b), c in COMPOSED.items()}, F.concat_ws("|", "r1", "r2"))
    return _first(both.withColumn("rel", rel).where("rel IS NOT NULL").drop("r1", "r2"), "composition", 0.75)


def path_bridge(g: Graph) -> DataFrame:
    """Any two hops give connected_via between their ends, of which the first pair of edges counts.

    Parallel edges between two nodes fold before the join: only the first of them can be part of a first pair, and its confidence counts.
    """
    e = g.edges.groupBy("source", "target").agg(F.min(F.struct("edge_id", "confidence")).alias("b"), F.count("*").alias("n"))
    a = e.select("source", F.col("target").alias("via"), F.col("b.edge_id").alias("e1"), _c("b.confidence").alias("c1"), F.col("n").alias("n1"))
    b = e.select(F.col("source").alias("via"), "target", F.col("b.edge_id").alias("e2"), _c("b.confidence").alias("c2"), F.col("n").alias("n2"))
    both = a.join(b, "via").where("source <> target").select("source", "target", F.struct(F.concat_ws("|", "e1", "e2").alias("support"), "via", (F.col("c1") * F.col("c2")).alias("product")).alias("b"), (F.col("n1") * F.col("n2")).alias("n"))
    best = both.groupBy("source", "target").agg(F.min("b").alias("b"), F.sum("n").alias("n_same"))
    return best.select("source", F.lit("connected_via").alias("rel"), "target", F.round(clamp(F.col("b.product") * 0.8), 4).alias("confidence"), F.lit("path_bridge").alias("rule"), F.col("b.via").alias("via"), F.col("b.support").alias("support"), "n_same")


RULES: dict[str, Rule] = {"symmetric": symmetric, "inverse": inverse, "transitive": transitive, "composition": composition, "path_bridge": path_bridge}


def infer(g: Graph, rules: tuple[str, ...] = tuple(RULES), min_confidence: float = 0.3) -> DataFrame:
    """Rule output above the least confidence; of several rules for a triple the most confident, the first on ties."""
    out = None
    for k, name in enumerate(rules):
        rows = RULES[name](g).withColumn("order", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    best = out.where(F.col("confidence") >= min_confidence).groupBy("source", "rel", "target").agg(F.max_by(F.struct(*OUT), F.struct("confidence", -F.col("order"))).alias("b"))
    return best.select("b.*")


def stamp(inferred: DataFrame) -> DataFrame:
    """Inferred edges with `metadata`: that they are inferred, by which rule, over which node, from which edges."""
    steps = F.to_json(F.split("support", r"\|"))
    return inferred.withColumn("metadata", obj(inferred=F.lit("true"), inference=obj(rule=js(F.col("rule")), via_node=js(F.col("via")), composed_from=steps, confidence=js(F.col("confidence")))))


def apply(g: Graph, inferred: DataFrame) -> Graph:
    """The graph with the inferred edges that are new and have both ends, stamped with how they came about."""
    new = _missing(inferred, g)
    for side in ("source", "target"):
        new = new.join(g.nodes.select(F.col("node_id").alias(side)), side, "left_semi")
    new = stamp(new).withColumn("edge_id", F.concat(F.lit("~"), "rule", F.lit(":"), "source", F.lit(">"), "rel", F.lit(">"), "target")).withColumn("inferred", F.lit(True))
    return g.with_edges(full_edges(g.edges).unionByName(full_edges(new)))
