"""What plans move, how often they compute a value, and how shuffles are cut."""

from pyspark.sql import functions as F

from loomgraph.functions import dates as D
from loomgraph.functions.json import js, obj, union
from loomgraph.operators import provenance
from loomgraph.operators import text as tx


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_anchors_leave_texts_in_place(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The token, the rest."), (2, "no such"), (3, "THE token is here")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("the",), ("token is",), ("absent",)], "term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(tx.rank_anchors(terms, docs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p
    want = {("the", 3, 2), ("token is", 1, 1)}
    assert {tuple(r)[:3] for r in tx.rank_anchors(terms, docs).collect()} == want
    monkeypatch.setattr(tx, "_FEW", 1)
    assert {tuple(r)[:3] for r in tx.rank_anchors(terms, docs).collect()} == want


def test_merged_provenance_has_the_first_cluster(spark):
    rows = spark.createDataFrame(
        [("g", "2", "", ["d2", "d1"], ("a", "r", "b", "d2", None, 0.5, False)), ("g", "1", None, ["d1"], ("a", "r", "b", "d1", "s", 0.9, False)), ("g", "3", "k3", ["d1"], ("a", "r", "b", "d1", "s", 0.1, False)), ("g", "4", "k4", [], ("x", "r", "b", None, None, None, True)), ("h", "5", None, None, ("x", "r", "b", None, None, None, True))],
        "by string, edge_id string, cluster_id string, documents array<string>, item struct<source: string, rel: string, target: string, source_ref: string, snippet: string, confidence: double, inferred: boolean>",
    )
    got = {r["by"]: r for r in provenance.merge(rows, ["by"]).collect()}
    assert got["g"]["cluster_id"] == "k3" and got["g"]["documents"] == ["d1", "d2"]
    assert [(e["source"], e["source_ref"], e["confidence"]) for e in got["g"]["evidence"]] == [("a", "d1", 0.9), ("a", "d2", 0.5), ("x", None, None)]
    assert got["h"]["cluster_id"] is None and got["h"]["documents"] is None and len(got["h"]["evidence"]) == 1
    m = spark.createDataFrame([("c", "x")], "cluster_id string, node_id string")
    assert {r["by"]: r["cluster_id"] for r in provenance.merge(rows.drop("cluster_id"), ["by"], members=m).collect()} == {"g": "c", "h": "c"}


def test_merged_provenance_moves_rows_once(spark):
    rows = spark.createDataFrame([], "by string, edge_id string, documents array<string>, item struct<source: string, rel: string, target: string, source_ref: string, snippet: string, confidence: double, inferred: boolean>")
    assert plan(provenance.merge(rows, ["by"])).count("Exchange") == 1


def test_json_computes_a_value_once(spark):
    o = spark.createDataFrame([('{"a":1,"b":{"c":"x"}}', '{"b":2,"d":"q"}', 'say "hi"\n', None)], "m string, n string, s string, none string")
    u = F.col("m")
    for _ in range(4):
        u = union(u, F.col("n"))
    p = plan(o.select(u), "optimizedPlan")
    assert p.count("from_json") == 8 and p.lower().count("structstojson") <= 4
    deep = js(F.col("s"))
    for _ in range(6):
        deep = obj(k=deep)
    assert plan(o.select(deep), "optimizedPlan").lower().count("structstojson") == 1
    row = o.select(u.alias("u"), union(F.col("m"), F.col("n"), new_wins=False).alias("o"), union(F.col("none"), F.lit("{}")).alias("e"), deep.alias("d"), obj(a=js(F.col("none")), b=js(F.lit("null"))).alias("z")).first()
    assert row["u"] == '{"b":2,"d":"q","a":1}' and row["o"] == '{"a":1,"b":{"c":"x"},"d":"q"}' and row["e"] is None
    assert row["d"] == '{"k":' * 6 + '"say \\"hi\\"\\n"' + "}" * 6 and row["z"] == '{"b":"null"}'


def test_dates_are_read_once(spark):
    d = spark.createDataFrame([("1996",), ("1996-02",), ("1996-02-03",), ("1996-02-03T04:05",), ("1996-13",), ("soon",), (None,)], "d string")
    c = F.col("d")
    assert plan(d.select(D.lo(c).alias("x")), "optimizedPlan").count("RLIKE") == 4
    assert [tuple(r) for r in d.select(D.precision(c), D.lo(c), D.hi(c)).collect()] == [
        ("year", "1996-01-01", "1996-12-31"), ("month", "1996-02-01", "1996-02-29"), ("day", "1996-02-03", "1996-02-03"), ("instant", "1996-02-03T04:05", "1996-02-03T04:05"), ("month", "1996-13-01", None), (None, None, None), (None, None, None),
    ]


def test_large_graphs_get_small_partitions(spark, tmp_path):
    from loomgraph.plans import session

    keys = (session._INITIAL, session._ADVISORY)
    (tmp_path / "t.parquet").write_bytes(b"x" * (41 << 20))
    for k in keys:
        spark.conf.unset(k)
    try:
        session.spread(spark, str(tmp_path / "t.parquet"))
        assert spark.conf.get(keys[0]) == "11" and spark.conf.get(keys[1]) == f"{8 << 20}b"
        spark.conf.set(keys[0], "50")
        spark.conf.set(keys[1], "1m")
        session.spread(spark, str(tmp_path / "t.parquet"))
        assert spark.conf.get(keys[0]) == "50" and spark.conf.get(keys[1]) == "1m"
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_iterations_move_no_edges(spark, monkeypatch):
    """Ranks, components and labels over packed blocks agree with steps over rows, also in many blocks, with ends that are no nodes and parallel edges."""
    import random

    from loomgraph.graph import Graph, complete
    from loomgraph.operators import analytics, compact

    r = random.Random(5)
    names = [f"n{k}" for k in range(60)]
    pairs = [(r.choice(names[:50]), r.choice(names[:50])) for _ in range(45)] + [("n0", "n1")] * 3 + [("n2", "gone"), ("gone", "n3"), ("gone", "lost"), ("lost", "end"), ("n4", "n4")]
    n = spark.createDataFrame([(x, "T", None) for x in names], "node_id string, type string, confidence double")
    e = spark.createDataFrame([(f"{k:03d}", a, "r", b) for k, (a, b) in enumerate(pairs)], "edge_id string, source string, rel string, target string")
    g = Graph(n, complete(e), spark.createDataFrame([], "cluster_id string, node_id string"))
    near = {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(y, 0)
                near[x][y] += 1
    comp = {x: x for x in names}
    for _ in names:
        comp = {x: min([comp[x], *[comp[y] for y in near.get(x, {}) if y in comp]]) for x in names}
    label = {x: x for x in names}
    for _ in range(10):
        votes = {}
        for x in {*names, *near}:
            for y, w in [*near.get(x, {}).items(), (x, 1)]:
                if y in label:
                    votes.setdefault(x, {}).setdefault(label[y], 0)
                    votes[x][label[y]] += w
        label = {x: min(v, key=lambda c: (-v[c], c)) for x, v in votes.items()}
    rank = {x: 1 / 60 for x in names}
    for _ in range(30):
        rest = sum(rank[x] for x in names if x not in near) / 60
        rank = {x: 0.15 / 60 + 0.85 * (sum(rank[y] / len(near[y]) for y in near.get(x, {}) if y in rank) + rest) for x in names}
    monkeypatch.setattr(compact, "_BLOCK", 16)
    got = lambda df: {a: b for a, b in df.collect()}
    assert got(analytics.components(g)) == comp and got(analytics.label_propagation(g)) == label
    ranks = got(analytics.pagerank(g))
    assert ranks.keys() == rank.keys() and all(abs(ranks[x] - rank[x]) < 1e-12 for x in rank)
    p = plan(compact.Compact(g).blocks.mapInArrow(lambda b: b, "b bigint, at binary, near binary, w binary"))
    assert "Exchange" not in p and "Join" not in p
    empty = g.with_nodes(n.limit(0)).with_edges(g.edges.limit(0))
    assert analytics.pagerank(empty).count() == 0 and analytics.components(empty).count() == 0 and analytics.label_propagation(empty).count() == 0


def test_conflicts_of_small_roles_meet_once(spark):
    from loomgraph.operators import temporal

    spans = [("1995", "1999"), ("1996-05", "1997-01-01"), (None, "1996"), ("1998-02-03", None), ("1997-01-01", "1997-06"), ("2003", "1990"), ("1996-05", "1996-02"), (None, None)]
    rows = [(f"{k}{t}", f"p{k % 5}", "held", t, a, b) for t in ("x", "y") for k, (a, b) in enumerate(spans)] + [("z1", "p1", "held", "z", "1990", "1991"), ("z2", "p2", "held", "z", "1991-07", "1995")]
    e = spark.createDataFrame([(*r, 1.0) for r in rows], "edge_id string, source string, rel string, target string, valid_from string, valid_to string, confidence double")
    whole, years = temporal.conflicts(e), temporal.conflicts(e, few=2)
    got = {tuple(r) for r in whole.collect()}
    assert got == {tuple(r) for r in years.collect()} and ("z1", "z2") in got and ("1x", "4x") not in got and len(got) > 5
    assert whole.count() == len(got) == years.count()
    assert "Generate" not in plan(whole) and "Generate" in plan(years)


def test_a_built_graph_has_a_short_plan(spark):
    from loomgraph.operators import build

    docs = spark.createDataFrame([(1, "Ann works at Acme. Bob left.")], "doc_id bigint, text string")
    m = spark.createDataFrame([(1, "Ann", "Person"), (1, "Acme", "Company"), (1, "Bob", "Person")], "doc_id bigint, name string, type string")
    t = spark.createDataFrame([(1, "Ann", "works_at", "Acme")], "doc_id bigint, s string, r string, o string")
    g = build.build_graph(m, t, docs, spark.createDataFrame([("works_at", "Person", "Company")], "name string, src string, dst string"))
    e = g.edges.first()
    assert (e["source"], e["rel"], e["target"], e["confidence"]) == ("Ann", "works_at", "Acme", 0.8) and '"snippet":"Ann works at Acme."' in e["metadata"]
    assert {r["node_id"] for r in g.nodes.collect()} == {"Ann", "Acme"}
    assert len(plan(g.edges)) < 20_000 and len(plan(g.nodes)) < 20_000
