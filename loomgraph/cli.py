"""Command line: python -m loomgraph.cli COMMAND ..; results are printed as JSON lines, or written to --out as JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.facade import GraphQuery
from loomgraph.graph import QueryError
from loomgraph.operators import evaluation
from loomgraph.operators.build import validate_json
from loomgraph.operators.merge import Versions, diff_graphs
from loomgraph.sources import graph_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("--out", help="folder to write to instead of printing")
    p.add_argument("--limit", type=int, default=1000, help="rows to print")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, (kind, default) in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", type=kind, default=default)

    add("validate", "graph")
    add("stats", "graph")
    add("diff", "old", "new")
    add("entity", "graph", "id")
    add("search", "graph", "query", edges=(int, 40))
    add("ask", "graph", "question")
    add("explain", "graph", "source", "target", hops=(int, 3))
    add("neighbors", "graph", "id", hops=(int, 1), max_edges=(int, 200))
    add("rank", "graph", metric=(str, "degree"), top=(int, 10))
    add("communities", "graph", method=(str, "louvain"))
    add("infer", "graph", min_confidence=(float, 0.3))
    add("merge", "base", "incoming", nodes=(str, "union"), edges=(str, "append_evidence"), document_id=(str, None))
    add("export", "graph", "form")
    add("eval", "suite", "predictions")
    add("compare", "base", "candidate", tolerance=(float, 0.01))
    add("versions", "folder", "action", version=(int, 0), other=(int, 0))
    return p


def scores(spark: SparkSession, suite: str, predictions: str) -> DataFrame:
    """(dataset, metric, value): F1 of entities and relations of each dataset and both blended."""
    g, p = evaluation.read_suite(spark, suite), evaluation.read_predictions(spark, predictions)
    e = evaluation.set_scores(g["gold_entities"], p["pred_entities"], ["name", "type"], ["dataset"])
    r = evaluation.set_scores(g["gold_relations"], p["pred_relations"], ["source", "rel", "target"], ["dataset"])
    out = e.selectExpr("dataset", "'entity_f1' AS metric", "f1 AS value").unionByName(r.selectExpr("dataset", "'relation_f1' AS metric", "f1 AS value"))
    return out.unionByName(evaluation.blended_f1(e, r, ["dataset"]).selectExpr("dataset", "'score' AS metric", "score AS value"))


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    q = lambda: GraphQuery.from_json(spark, a.graph)
    read = lambda path: graph_json.read_graph(spark, path)
    if a.command == "validate":
        return validate_json(spark, a.graph).drop("path").unionByName(q().validate())
    if a.command == "diff":
        return diff_graphs(read(a.old), read(a.new))
    if a.command in ("infer", "merge"):
        g = (q().infer(min_confidence=a.min_confidence) if a.command == "infer" else GraphQuery(read(a.base)).merge(read(a.incoming), nodes=a.nodes, edges=a.edges, document_id=a.document_id)).graph
        if a.out:
            graph_json.write_graph(g, a.out)
        return g.edges
    if a.command == "eval":
        return scores(spark, a.suite, a.predictions)
    if a.command == "compare":
        schema = "dataset string, metric string, value double"
        return evaluation.compare_reports(*[spark.read.schema(schema).json(x) for x in (a.base, a.candidate)], tolerance=a.tolerance)
    if a.command == "versions":
        v = Versions(a.folder)
        if a.action == "list":
            return spark.createDataFrame([tuple(x.values()) for x in v.list(spark)], "version int, note string, operation string, n_nodes bigint, n_edges bigint, time string")
        if a.action == "diff":
            return v.diff(spark, a.version, a.other)
        return v.rollback(spark, a.version).edges
    return {
        "stats": lambda: q().statistics(), "entity": lambda: q().entity(a.id), "search": lambda: q().search(a.query, k_edges=a.edges), "ask": lambda: q().ask(a.question),
        "explain": lambda: q().explain(a.source, a.target, a.hops), "neighbors": lambda: q().neighbors(a.id, a.hops, max_edges=a.max_edges)[1],
        "rank": lambda: q().rank(a.metric, a.top), "communities": lambda: q().communities(a.method), "export": lambda: q().export(a.form),
    }[a.command]()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    try:
        rows = run(spark, a)
        if a.out and a.command not in ("infer", "merge"):
            rows.write.mode("overwrite").json(a.out)
        elif not a.out:
            for line in rows.limit(a.limit).select(F.to_json(F.struct("*"))).collect():
                print(line[0])
        bad = a.command == "validate" and rows.where("severity = 'error'").limit(1).count() or a.command == "compare" and rows.where("regressed").limit(1).count()
        return int(bool(bad))
    except QueryError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
