"""The driver's relational tables as a property graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.json import js, obj
from loomgraph.graph import Graph, complete, full_edges, full_nodes
from loomgraph.plans.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NODES = (("region", "r_regionkey", "Region"), ("nation", "n_nationkey", "Nation"), ("customer", "c_custkey", "Customer"), ("supplier", "s_suppkey", "Supplier"), ("part", "p_partkey", "Part"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts; customers and suppliers have a confidence from their balance."""
    out = None
    for name, key, kind in _NODES:
        t = table(spark, sf_dir, name)
        conf = F.lit(None).cast("double")
        if name in ("customer", "supplier"):
            conf = F.when(F.col(f"{name[0]}_acctbal") >= 0, F.lit(0.9)).otherwise(F.lit(0.4))
        t = t.select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("type"), conf.alias("confidence"))
        out = t if out is None else out.unionByName(t)
    return out


def _edge(t: DataFrame, source, rel: str, target, conf, **more) -> DataFrame:
    return complete(
        t.select(
            more.pop("edge_id", F.concat(F.lit(f"{rel}:"), source, F.lit(">"), target)).alias("edge_id"),
            source.alias("source"), F.lit(rel).alias("rel"), target.alias("target"), conf.alias("confidence"), *[c.alias(k) for k, c in more.items()],
        )
    )


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def located_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _edge(table(spark, sf_dir, "nation"), _key("nation", "n_nationkey"), "located_in", _key("region", "n_regionkey"), F.lit(None).cast("double"))
    for name in ("customer", "supplier"):
        c = name[0]
        t = table(spark, sf_dir, name)
        out = out.unionByName(_edge(t, _key(name, f"{c}_{'cust' if c == 'c' else 'supp'}key"), "located_in", _key("nation", f"{c}_nationkey"), F.lit(0.9)))
    return out


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_discount").alias("d"))
    return _edge(t, _key("supplier", "l_suppkey"), "supplies", _key("part", "l_partkey"), 1 - F.col("d"))


def purchased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part, valid between the dates of order and shipment."""
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = (F.date_format(c, "yyyy-MM-dd") for c in ("o_orderdate", "l_shipdate"))
    name = F.concat_ws(":", F.lit("purchased"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return _edge(
        t, _key("customer", "o_custkey"), "purchased", _key("part", "l_partkey"), 1 - F.col("l_discount"),
        edge_id=name, valid_from=F.least(a, b), valid_to=F.greatest(a, b), document_id=_key("order", "o_orderkey"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for each nation: its customers and suppliers."""
    return located_in(spark, sf_dir).where(F.col("target").startswith("nation:")).select(F.concat(F.lit("market:"), F.col("target")).alias("cluster_id"), F.col("source").alias("node_id"))


def place_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, suppliers, nations and regions with located_in edges."""
    n = nodes(spark, sf_dir).where("type <> 'Part'")
    return Graph(n, located_in(spark, sf_dir), members(spark, sf_dir))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All nodes and edges."""
    spread(spark, *[f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "part", "orders", "lineitem")])
    e = located_in(spark, sf_dir).unionByName(supplies(spark, sf_dir)).unionByName(purchased(spark, sf_dir))
    return Graph(nodes(spark, sf_dir), e, members(spark, sf_dir))


def rich_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All nodes and edges with what they may carry: properties of customers and parts, the table of each node as its document, the order line behind each purchase."""
    g = trade_graph(spark, sf_dir)
    more = table(spark, sf_dir, "customer").select(_key("customer", "c_custkey").alias("node_id"), obj(segment=js(F.col("c_mktsegment"))).alias("properties"))
    more = more.unionByName(table(spark, sf_dir, "part").select(_key("part", "p_partkey"), obj(brand=js(F.col("p_brand")), size=js(F.col("p_size")))).toDF("node_id", "properties"))
    n = g.nodes.join(more, "node_id", "left").withColumn("source_documents", F.array(F.lower("type")))
    n = n.withColumn("metadata", obj(source_documents=F.to_json("source_documents")))
    line = F.regexp_extract("edge_id", r"^purchased:\d+:(\d+):", 1)
    bought = F.col("rel") == "purchased"
    e = g.edges.withColumns({
        "detail": F.when(bought, F.concat(F.lit("line "), line)),
        "metadata": F.when(bought, obj(source_ref=js(F.col("document_id")), evidence=js(F.concat(F.lit("line "), line)))),
    })
    return Graph(full_nodes(n), full_edges(e), g.members)


#: The same in SQL, as common table expressions: nodes, located, supplies, purchased, edges, members
SQL = """WITH nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'Region' AS type, CAST(NULL AS DOUBLE) AS confidence FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', CASE WHEN c_acctbal >= 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', CASE WHEN s_acctbal >= 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', NULL FROM part
), located AS (
  SELECT 'located_in:nation:' || n_nationkey || '>region:' || n_regionkey AS edge_id, 'nation:' || n_nationkey AS source, 'located_in' AS rel,
    'region:' || n_regionkey AS target, CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, CAST(NULL AS DOUBLE) AS confidence,
    false AS inferred, CAST(NULL AS VARCHAR) AS document_id FROM nation
  UNION ALL SELECT 'located_in:customer:' || c_custkey || '>nation:' || c_nationkey, 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, NULL, NULL, CAST(0.9 AS DOUBLE), false, NULL FROM customer
  UNION ALL SELECT 'located_in:supplier:' || s_suppkey || '>nation:' || s_nationkey, 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, NULL, NULL, CAST(0.9 AS DOUBLE), false, NULL FROM supplier
), supplies AS (
  SELECT 'supplies:supplier:' || l_suppkey || '>part:' || l_partkey AS edge_id, 'supplier:' || l_suppkey AS source, 'supplies' AS rel, 'part:' || l_partkey AS target,
    CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, 1 - min(l_discount) AS confidence, false AS inferred, CAST(NULL AS VARCHAR) AS document_id
  FROM lineitem GROUP BY l_suppkey, l_partkey
), purchased AS (
  SELECT 'purchased:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS edge_id, 'customer:' || o_custkey AS source, 'purchased' AS rel,
    'part:' || l_partkey AS target, strftime(least(o_orderdate, l_shipdate), '%Y-%m-%d') AS valid_from, strftime(greatest(o_orderdate, l_shipdate), '%Y-%m-%d') AS valid_to,
    1 - l_discount AS confidence, false AS inferred, 'order:' || o_orderkey AS document_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), edges AS (
  SELECT * FROM located UNION ALL SELECT * FROM supplies UNION ALL SELECT * FROM purchased
), members AS (
  SELECT 'market:' || target AS cluster_id, source AS node_id FROM located WHERE target LIKE 'nation:%'
)
"""

#: the same as rich_graph: rich_nodes, rich_edges
RICH = SQL.rstrip() + """, rich_nodes AS (
  SELECT n.*, CASE WHEN c_custkey IS NOT NULL THEN '{"segment":"' || c_mktsegment || '"}' WHEN p_partkey IS NOT NULL THEN '{"brand":"' || p_brand || '","size":' || p_size || '}' END AS properties,
    '{"source_documents":["' || lower(type) || '"]}' AS metadata
  FROM nodes n LEFT JOIN customer ON node_id = 'customer:' || c_custkey LEFT JOIN part ON node_id = 'part:' || p_partkey
), rich_edges AS (
  SELECT *, CASE WHEN rel = 'purchased' THEN 'line ' || split_part(edge_id, ':', 3) END AS detail,
    CASE WHEN rel = 'purchased' THEN '{"source_ref":"' || document_id || '","evidence":"line ' || split_part(edge_id, ':', 3) || '"}' END AS metadata FROM edges
)
"""
