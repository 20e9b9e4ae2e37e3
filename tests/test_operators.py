"""Scenarios on small graphs and texts, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import dates as D
from loomgraph.functions import numbers as N
from loomgraph.functions import text as X
from loomgraph.graph import Graph, QueryError, complete, full_edges, full_nodes
from loomgraph.operators import analytics, build, evaluation, events, merge, provenance, reasoning, resolution, schema, search, temporal, traversal
from loomgraph.operators import text as tx
from loomgraph.sources import exports, graph_json
from loomgraph.streaming.merge_stream import merge_stream, windowed_counts


def graph(spark, nodes, edges, members=()):
    n = spark.createDataFrame([(i, t, None) for i, t in nodes], "node_id string, type string, confidence double")
    e = spark.createDataFrame([(f"{k:03d}", *x, *[None] * (6 - len(x))) for k, x in enumerate(edges)], "edge_id string, source string, rel string, target string, confidence double, valid_from string, valid_to string")
    m = spark.createDataFrame(list(members), "cluster_id string, node_id string")
    return Graph(n, complete(e), m)


@pytest.fixture(scope="module")
def people(spark):
    return graph(
        spark, [("Alice", "Person"), ("Bob", "Person"), ("Acme Inc", "Company"), ("Globex", "Company"), ("Paris", "Place")],
        [("Alice", "works_at", "Acme Inc", 0.9), ("Bob", "works_at", "Globex", 0.9), ("Alice", "lives_in", "Paris", 0.9), ("Bob", "lives_in", "Paris", 0.9)],
        [("c1", "Alice"), ("c1", "Bob")],
    )


def test_search(people):
    assert [r["node_id"] for r in search.find_entities(people, "who is alice").collect()] == ["Alice"]
    assert search.find_entities(people, "zzz", limit=2).collect()[0]["node_id"] == "Alice"  # the greatest degree, then by name
    assert {r[0] for r in search.neighbors(people, "Alice").collect()} == {"Acme Inc", "Paris"}
    assert [r["node_id"] for r in search.related(people, "Alice").collect()] == ["Bob"]
    assert [r["node_id"] for r in search.related(people, "Alice", "same_community").collect()] == ["Bob"]
    with pytest.raises(QueryError):
        search.entity(people, "Nobody")
    with pytest.raises(QueryError):
        search.metric("none")
    assert search.parse_relation("Alice (works_at)") == "works_at" and search.parse_relation("rel=lives_in x") == "lives_in"


def test_paths(people):
    p = traversal.find_paths(people, "Alice", "Bob").collect()
    assert [r["nodes"] for r in p] == [["Alice", "Paris", "Bob"]] and abs(p[0]["confidence"] - 0.81) < 1e-9
    assert traversal.find_paths(people, "Alice", "Globex", max_hops=2).count() == 0
    assert traversal.explain(people, "Alice", "Bob").collect()[0]["same_cluster"] is True
    assert {(r["target"], r["hop"]) for r in traversal.k_hop(people, "Alice", 2).collect()} == {("Acme Inc", 1), ("Paris", 1), ("Paris", 2)}
    with pytest.raises(QueryError):
        traversal.distances(people, "Alice", 0)


def test_ranks_and_components(spark):
    g = graph(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", None)], [("a", "r", "b"), ("b", "r", "c"), ("d", "r", "e")])
    pr = {r["node_id"]: r["score"] for r in analytics.pagerank(g).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr["b"] > pr["a"] > pr["f"]
    assert {r["node_id"]: r["component"] for r in analytics.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {(r["cluster_id"], r["node_id"]) for r in analytics.auto_clusters(g).collect()} == {("cc_1", x) for x in "abc"} | {("cc_2", x) for x in "de"}
    assert analytics.label_propagation(g).count() == 6
    two = graph(spark, [(x, "t") for x in "abcdefg"], [(x, "r", y) for x, y in ("ab", "bc", "ca", "de", "ef", "fd", "cd")])
    for method in (analytics.louvain, analytics.spectral):
        lab = method(two, k=2) if method is analytics.spectral else method(two)
        assert lab.count() == 7
    lab = {r["node_id"]: r["community"] for r in analytics.louvain(two).collect()}
    assert lab == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d") | {"g": "g"}
    assert abs(analytics.modularity(two, spark.createDataFrame(list(lab.items()), "node_id string, community string")).first()[0] - 5 / 14) < 1e-6
    assert {r["node_id"] for r in build.prune_isolated(g).nodes.collect()} == set("abcde")
    assert analytics.pagerank(graph(spark, [], [])).count() == 0


def test_time(spark):
    g = graph(
        spark, [("Apple", "Company"), ("Jobs", "Person"), ("Cook", "Person"), ("Doe", "Person")],
        [("Jobs", "CEO_OF", "Apple", 0.9, "1997", "2011"), ("Cook", "CEO_OF", "Apple", 0.9, "2011", None), ("Doe", "CEO_OF", "Apple", 0.9, "2008", "2010"), ("Jobs", "CEO_OF", "Apple", 0.9, "2005", "2010")],
    )
    assert {r[0] for r in temporal.role_holders(g, "ceo_of", "Apple", "2012").collect()} == {"Cook"}
    assert temporal.ask(g, "who was ceo of apple in 2012?").count() == 1
    pairs = {tuple(r) for r in temporal.conflicts(g.edges).collect()}
    assert ("000", "002") in pairs and ("000", "001") not in pairs
    assert {tuple(r) for r in temporal.overlaps(g.edges).collect()} == {("000", "003")}
    assert {(r["edge_id"], r["change"]) for r in temporal.changes(g.edges, "2009", "2013").collect()} == {("000", "ended"), ("001", "started"), ("002", "ended"), ("003", "ended")}
    assert [r["valid_from"] for r in temporal.timeline(g.edges).collect()] == ["1997", "2005", "2008", "2011"]
    again = temporal.migrate(temporal.migrate(g.edges)).where("edge_id = '000'").first()["metadata"]
    assert json.loads(again) == {"temporal": {"valid_from": "1997", "valid_to": "2011"}}
    scoped = temporal.scoped(temporal.migrate(g.edges).withColumn("valid_from", F.lit("1900")))
    assert scoped.where("edge_id = '000'").first()["valid_from"] == "1997"
    n = temporal.migrate_nodes(spark.createDataFrame([("a", '{"valid_from":"2001","x":1}')], "node_id string, properties string")).first()
    assert json.loads(n["metadata"]) == {"temporal": {"valid_from": "2001"}} and json.loads(n["properties"]) == {"x": 1}
    assert temporal.parse_question("who was CEO_OF of Apple in 2012")[0] == "CEO_OF" and temporal.parse_question("Apple CEO in 2008") == ("CEO_OF", "Apple", "2008")
    assert temporal.active_at(g.edges, "not a day").count() == 0 and temporal.transitions(g.edges, "Apple", "in").count() == 4


def test_rules(spark):
    g = graph(spark, [(x, "t") for x in "ABCDN"], [("A", "parent_of", "B", 0.9), ("A", "part_of", "B"), ("B", "part_of", "C"), ("C", "married_to", "D", 0.8), ("D", "member_of", "C"), ("C", "located_in", "N")])
    assert ("B", "child_of", "A", 0.81) in {tuple(r)[:4] for r in reasoning.inverse(g).collect()}
    assert {tuple(r)[:3] for r in reasoning.transitive(g).collect()} == {("A", "part_of", "C")}
    assert {tuple(r)[:4] for r in reasoning.symmetric(g).collect()} == {("D", "married_to", "C", 0.76)}
    assert {tuple(r)[:3] for r in reasoning.composition(g).collect()} == {("D", "active_in", "N")}
    done = reasoning.apply(g, reasoning.infer(g, min_confidence=0.1))
    again = reasoning.apply(done, reasoning.inverse(g))
    assert done.edges.count() == again.edges.count() and done.edges.where("inferred").count() > 4
    how = json.loads(done.edges.where("source = 'A' AND rel = 'part_of' AND target = 'C'").first()["metadata"])
    assert how["inferred"] is True and how["inference"]["rule"] == "transitive" and how["inference"]["via_node"] == "B" and how["inference"]["composed_from"] == ["001", "002"]


def test_merge_and_versions(spark, tmp_path):
    base = graph(spark, [("Apple Inc", "Company"), ("Tim Cook", "Person")], [("Tim Cook", "WORKS_AT", "Apple Inc", 0.9)])
    new = graph(spark, [("apple inc", "Company"), ("Steve Jobs", "Person"), ("steve jobs", "Person"), ("Tim Cook", "Person")], [("Steve Jobs", "FOUNDED", "apple inc", 0.85), ("Tim Cook", "works_at", "apple inc", 0.95)])
    new = new.with_edges(new.edges.withColumn("edge_id", F.concat(F.lit("n"), "edge_id")))
    out = merge.merge(base, new)
    assert {r["node_id"] for r in out.nodes.collect()} == {"Apple Inc", "Tim Cook", "Steve Jobs"}
    assert {(r["source"], r["rel"], r["target"], r["confidence"]) for r in out.edges.collect()} == {("Tim Cook", "WORKS_AT", "Apple Inc", 0.95), ("Steve Jobs", "FOUNDED", "Apple Inc", 0.85)}
    v = merge.Versions(str(tmp_path / "v"))
    v.save(base)
    v.save(out)
    assert ("node", "Steve Jobs", "added") in {tuple(r) for r in v.diff(spark, 1, 2).collect()}
    assert v.rollback(spark, 1, current=out).nodes.count() == 2 and [x["operation"] for x in v.list(spark)] == ["save", "save", "pre_rollback", "rollback"]


def test_merge_policies(spark):
    n = lambda *rows: full_nodes(spark.createDataFrame(list(rows), "node_id string, type string, confidence double, properties string, metadata string, embedding array<double>"))
    base = n(("Apple Inc", "Company", 0.5, '{"a":1,"b":2}', '{"source_documents":["d1"]}', [1.0, 3.0]), ("Java", "Language", None, None, None, None))
    new = n(("apple inc", "Company", 0.7, '{"b":3,"c":4}', '{"source_documents":["d2"]}', [3.0, 1.0]), ("java", "Island", None, None, None, None))
    m = merge.match_nodes(base, new, require_type=True)
    assert {(r["node_id"], r["matched"], r["match_type"]) for r in m.collect()} == {("apple inc", "Apple Inc", "normalized"), ("java", "java", "type_mismatch")}
    got = {p: merge.merge_nodes(base, new, m, p, "d3").where("node_id = 'Apple Inc'").first() for p in merge.NODE_POLICIES}
    assert json.loads(got["union"]["properties"]) == {"a": 1, "b": 3, "c": 4} and got["union"]["embedding"] == [2.0, 2.0] and got["union"]["confidence"] == 0.7
    assert got["union"]["source_documents"] == ["d1", "d3", "d2"] == json.loads(got["union"]["metadata"])["source_documents"]
    assert json.loads(got["new"]["properties"]) == {"b": 3, "c": 4} and got["new"]["confidence"] == 0.7
    assert json.loads(got["existing"]["properties"]) == {"a": 1, "b": 2} and json.loads(got["existing"]["metadata"])["merged_from"] == [{"id": "apple inc", "type": "Company", "properties": {"b": 3, "c": 4}}]
    e = lambda *rows: full_edges(spark.createDataFrame(list(rows), "edge_id string, source string, rel string, target string, confidence double, metadata string"))
    old, more = e(("1", "A", "r", "B", 0.5, '{"evidence":"x"}')), e(("2", "A", "R", "B", 0.9, '{"source_ref":"d2","evidence":"y"}'), ("3", "A", "s", "B", None, None), ("4", "A", "r", "A", None, None))
    same = spark.createDataFrame([("A", "A"), ("B", "B")], "node_id string, matched string")
    for policy, confidence in (("skip", 0.5), ("append_evidence", 0.5), ("max_confidence", 0.9)):
        out = {r["edge_id"]: r for r in merge.merge_edges(old, more, same, policy, "d9").collect()}
        assert set(out) == {"1", "3"} and out["1"]["confidence"] == confidence and out["3"]["document_id"] == "d9"
        notes = json.loads(out["1"]["metadata"])
        assert ("evidence_refs" in notes) == (policy != "skip") and notes.get("alt_confidences", [0.5]) == [0.5]
    twice = merge.merge_edges(merge.merge_edges(old, more, same), more, same)
    assert len(json.loads(twice.where("edge_id = '1'").first()["metadata"])["evidence_refs"]) == 1


def test_provenance(spark):
    rows = spark.createDataFrame([("1", '{"provenance":{"document_id":"d","snippet":"s","source_span":[1,2]}}'), ("2", '{"source_documents":["","x"],"evidence":"e"}'), ("3", None)], "edge_id string, metadata string")
    p = {r["edge_id"]: r["provenance"] for r in provenance.read(rows).collect()}
    assert (p["1"]["document_id"], p["1"]["source_span"], p["2"]["document_id"], p["2"]["snippet"], p["3"]["document_id"]) == ("d", [1, 2], "x", "e", None)
    back = {r["edge_id"]: r["metadata"] for r in provenance.attach(provenance.read(rows)).collect()}
    assert json.loads(back["1"])["source_ref"] == "d" and json.loads(back["2"])["source_documents"] == ["", "x"] and not json.loads(back["3"] or "{}")
    t = spark.createDataFrame([(1, "One is here.\n\nAlice met Bob. Bob left.", ["Alice", "Bob"], None), (1, "One is here.\n\nAlice met Bob. Bob left.", ["x"], "\u2026 met bob \u2026"), (2, None, ["a"], None)], "doc_id bigint, text string, terms array<string>, preferred string")
    out = {(r["doc_id"], r["terms"][0]): (r["sentence_id"], r["span"], r["snippet"]) for r in provenance.of_text(t).collect()}
    assert out[1, "Alice"] == ("s1", [14, 28], "Alice met Bob.") and out[1, "x"][1:] == ([20, 27], "met bob") and out[2, "a"] == (None, None, None)


def test_validation_and_hubs(spark):
    g = graph(spark, [("a", "t"), ("a", "t")], [("a", "r", "b"), ("a", "r", "b"), ("", "r", "a")], [("c", "zz")])
    codes = {r["code"] for r in build.validate(g).collect()}
    assert "graph_valid" not in codes
    assert codes == {"duplicate_node_id", "edge_target_missing_node", "duplicate_edge", "edge_missing_source", "cluster_member_missing_node"}
    star = graph(spark, [("hub", "t")], [("hub", "knows", f"s{k}") for k in range(12)])
    assert {tuple(r) for r in build.join_hubs(build.split_hubs(star)).collect()} == {("hub", "knows", f"s{k}") for k in range(12)}
    with pytest.raises(ValueError):
        build.split_hubs(star, 2)


def test_evaluation(spark):
    g = spark.createDataFrame([("d", 0, "Microsoft", "Company", ["MSFT", "MS"], 0, 9), ("d", 1, "GitHub", "Company", [], None, None)], "dataset string, idx bigint, name string, type string, aliases array<string>, span_start int, span_end int")
    p = spark.createDataFrame([("d", 0, "MS", "company", None, None), ("d", 1, "Other", "Company", 0, 8)], "dataset string, idx bigint, name string, type string, span_start int, span_end int")
    assert [tuple(r) for r in evaluation.match_entities(g, p).collect()] == [("d", 0, 0, 1.0)]
    one = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert tuple(evaluation.score_sets(one, one.limit(0), ["k"]).first()) == (0, 0, 3, 0.0, 0.0, 0.0)
    assert evaluation.score_sets(one.limit(0), one.limit(0), ["k"]).first()["f1"] == 1.0
    s = spark.createDataFrame([("e", 2, 2, 1.0), ("r", 2, 2, 0.5), ("v", 0, 0, 0.0)], "metric string, n_gold bigint, n_predicted bigint, f1 double")
    assert evaluation.weighted_f1(s, {"e": 0.45, "r": 0.35, "v": 0.2}).first()[0] == 0.78125
    rows = spark.createDataFrame([(0.95, 1.0), (0.05, 0.0)], "confidence double, correct double")
    assert [r["calibrated"] for r in evaluation.calibrate(spark.createDataFrame([(0.6,), (0.2,)], "confidence double"), evaluation.calibration(rows)).orderBy("confidence").collect()] == [0.0, 1.0]


def test_dates_and_numbers(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(D.hi(F.lit("2024-02"))) == "2024-02-29" and v(D.hi(F.lit("2024-13"))) is None and v(D.precision(F.lit("x"))) is None
    assert v(D.compare(F.lit("2014"), F.lit("2014-06"))) == 0 and v(D.compare(F.lit("2013"), F.lit("2014-06"))) == -1
    assert v(D.parse_timestamp(F.lit("on 3 May 2014"))) == "2014-05-03" and v(D.parse_timestamp(F.lit("nothing"))) is None
    assert v(D.years(F.lit("from 2011 to 1999 and 2011"))) == ["1999", "2011"]
    assert v(N.clamp(F.lit(float("nan")))) == 0.0 and v(N.span_iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6))) == 2 / 6
    assert v(N.path_confidence(F.array(F.lit(None).cast("double"), F.lit(0.5)))) == 0.5
    assert v(X.normalize_entity_name(F.lit("Dr. Jane  Doe Jr."))) == "jane doe" and v(X.sanitize_identifier(F.lit("9 lives!"))) == "_9_LIVES"
    assert v(X.contains_word(F.lit("élena lena"), F.lit("LENA"))) and not v(X.contains_word(F.lit("élena"), F.lit("lena")))
    assert v(X.negated(F.lit("He never acquired it"), F.lit("acquired_by"))) and not v(X.negated(F.lit("He acquired it"), F.lit("acquired_by")))
    assert v(X.role_relation(F.lit("chief executive"))) == "CHIEF_EXECUTIVE_OF" and v(X.role_relation(F.lit("CEO_OF"))) == "CEO_OF"
    assert v(X.without_ends(F.lit("company hires person"), F.lit("Company"), F.lit("Person"))) == "hires" and v(X.relation_cues(F.lit("led_by_x"))) == ["led by x", "led"]
    s = v(D.parse_span(F.lit("2001 - 1999")))
    assert (s["start"], s["end"], s["precision"]) == ("1999", "2001", "year") and v(D.parse_span(F.lit("1850-03-04T10:00")))["start"] == "1850-03-04"
    assert v(N.mean_vectors(F.array(F.lit(1.0)), F.array(F.lit(3.0)))) == [2.0] and v(N.similarity(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))) == 0
    with pytest.raises(Exception, match="different lengths"):
        v(N.similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))
    assert v(N.sorted_aliases(F.array(F.lit("b"), F.lit("A")), F.array(F.lit("a")))) == ["A", "a", "b"]


def test_texts(spark):
    docs = spark.createDataFrame([(1, "Alice works at Acme. Bob works elsewhere."), (2, ""), (3, None)], "doc_id bigint, text string")
    t = spark.createDataFrame([(1, "Alice", "works_at", "Acme")], "doc_id bigint, s string, r string, o string")
    assert [tuple(r)[3:] for r in tx.sentence_evidence(t, docs).collect()] == [("s0", "Alice works at Acme.")]
    c = tx.token_chunks(docs, size=4, overlap=0.5)
    assert [(r["sequence_index"], r["text"]) for r in c.orderBy("sequence_index").collect()] == [(0, "Alice works at Acme."), (1, "at Acme. Bob works"), (2, "Bob works elsewhere.")]
    assert tx.check_chunks(c).count() == 0 and tx.aligned_chunks(docs, 4, 1.0).count() >= 2 and tx.sentence_chunks(docs, 4).count() == 2
    assert [r["k"] for r in tx.evidence_windows(t.select("s", "o"), c).collect()] == [1, 2]
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(tx.truncate(F.lit("One two. Three four five"), 14)) == "One two." and v(F.length(tx.sample_text(F.lit("x" * 50), 30))) == 32
    assert [len(r["text"]) for r in tx.attempts(spark.createDataFrame([(1, "word " * 1000)], "doc_id bigint, text string")).orderBy("attempt").collect()] == [5000, 3749, 2749, 1199]
    many = tx.token_chunks(spark.createDataFrame([(1, "w " * 1300)], "doc_id bigint, text string"), size=1, overlap=0.0)
    assert many.select("chunk_id").distinct().count() == 1300
    assert [r["text"] for r in tx.token_chunks(docs.limit(1), 3, 0.0, "word", "set").collect()][0] == "Alice works at"
    flags = {r["sequence_index"]: r for r in tx.chunk_flags(c).collect()}
    assert flags[0]["starts_at_sentence"] and flags[2]["ends_at_sentence"] and not flags[1]["ends_at_sentence"]
    long = spark.createDataFrame([(1, "a b c. d e f g. h i j k l m n o p.")], "doc_id bigint, text string")
    assert [r["text"] for r in tx.aligned_chunks(long, 4, 0.0).orderBy("sequence_index").collect()][:2] == ["a b c. d", "e f g. "]
    assert [r["text"] for r in tx.sentence_chunks(long, 4, 1).orderBy("sequence_index").collect()] == ["a b c.", "d e f g.", "h i j k l m n o p."]
    assert {tuple(r) for r in tx.names_in(docs, spark.createDataFrame([("works at",), ("alice",), ("ob",)], "term string")).collect()} == {(1, "works at"), (1, "alice")}


def test_resolution_and_events(spark):
    m = spark.createDataFrame([("Company", "Apple"), ("Company", "Apple Inc"), ("Company", "Globex")], "type string, name string")
    assert {(r["name"], r["canonical"]) for r in resolution.resolve(m).collect()} == {("Apple", "Apple Inc"), ("Apple Inc", "Apple Inc"), ("Globex", "Globex")}
    d = spark.createDataFrame([(1, "Alice came home. She slept.", [("Alice", "Person")])], "doc_id bigint, text string, entities array<struct<name: string, type: string>>")
    assert [tuple(r)[:3] for r in resolution.coreference(d).collect()] == [(1, "she", "Alice")]
    no = lambda p, t, *e: resolution.resolve_pronoun(p, t, list(e))
    assert no("he", "Tom met Jim. He left.", ("Tom", "Person"), ("Jim", "Person")) is None  # two could be meant
    assert no("it", "Acme grew. It hired Ann.", ("Acme", "Company"), ("Ann", "Person"))[0] == "Acme" and no("she", "No one came. She left.", ("Ann", "Person"))[0] == "Ann"
    r = resolution.resolve_names
    assert r(["Elena", "Elena Vasquez", "Elena Marsh"], "Person").get("Elena") == "Elena"  # stands for two people
    assert r(["John Smith", "John Smyth Jones"], "Person")["John Smith"] == "John Smith" and r(["Dr. Elena Vasquez", "Elena"], "Person")["Elena"] == "Dr. Elena Vasquez"
    assert r(["Apple", "Orange"], "Company") == {"Apple": "Apple", "Orange": "Orange"} and r(["Apple"], "Company") == {}
    assert resolution.threshold_for("Ann", "Ann Smith") == 0.3 and resolution.threshold_for("abcd", "something long") == 0.4
    assert resolution.blended("Acme Corp", "Acme Group", [1.0, 0.0], [1.0, 0.0]) > resolution.similarity("Acme Corp", "Acme Group")
    c = resolution.classify(spark.createDataFrame([("x", "Person", "Location")], "text string, source_type string, target_type string")).first()["classes"]
    assert [(x["rel"], x["score"]) for x in c] == [("located_at", 0.6), ("visits", 0.5)] and len(resolution.TAXONOMY) == 47
    e = spark.createDataFrame([("e1", "Acquisition", {"acquirer": ["apple", "Apple"], "acquired": ["Beats"], "bad": ["x"]}, None, "2014-05", "2014-05", "California", "d")], "id string, event_type string, participants map<string, array<string>>, confidence double, ts_start string, ts_end string, location string, document_id string")
    roles = spark.createDataFrame([("Acquisition", "acquirer", True), ("Acquisition", "acquired", True)], "event_type string, role string, required boolean")
    out = events.normalise(e, roles, spark.createDataFrame([("Apple",), ("Beats",)], "name string"))
    assert out.first()["participants"] == {"acquirer": ["Apple"], "acquired": ["Beats"]} and out.first()["confidence"] == 1.0
    assert {(r["rel"], r["target"]) for r in events.project(out)[1].collect()} == {("role:acquirer", "Apple"), ("role:acquired", "Beats"), ("occurred_at", "California")}


def test_schema(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"entity_types": [{"name": "Company"}, {"name": "Product"}], "relation_groups": [{"name": "g", "relations": [{"name": "produces", "source": "Company", "target": "Product"}]}]}))
    types, rels, *_ = schema.read_schema(spark, str(path))
    assert types.first()["description"] == "Auto-generated entity type" and rels.first()["src"] == "Company"
    assert {r["name"] for r in schema.augment_reversed(rels).collect()} == {"produces", "produced_by"}
    assert schema.relations_of(rels, "Product").count() == 1


def test_sources(spark, tmp_path, people):
    doc = {"nodes": [{"id": "a", "type": "T"}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "relationship_type": "r", "metadata": {"inferred": "true", "source_ref": "d"}}], "clusters": [{"id": "c", "node_ids": ["a", "zz"]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = graph_json.read_graph(spark, str(tmp_path / "g.json"))
    assert g.edges.first()["inferred"] and [r["node_id"] for r in g.members.collect()] == ["a"]
    graph_json.write_graph(g, str(tmp_path / "out"))
    assert json.loads((spark.read.text(str(tmp_path / "out/edges"))).first()[0]) == doc["edges"][0]
    again = graph_json.read_folder(spark, str(tmp_path / "out"))
    assert again.edges.first()["document_id"] == "d" and {r["node_id"] for r in again.nodes.collect()} == {"a", "b"}
    (tmp_path / "two").mkdir()
    for name in ("x.json", "y.json"):
        (tmp_path / "two" / name).write_text(json.dumps(doc))
    both = graph_json.read_graph(spark, str(tmp_path / "two"))
    assert both.edges.select("edge_id").distinct().count() == 2 and both.nodes.count() == 2
    ld = {r["id"]: json.loads(r["json"]) for r in graph_json.linked_data(people).collect()}
    assert ld["Paris"]["@type"] == "Place" and "@context" in ld[""] and ld["c1"]["members"] == [{"@id": "kg:node/Alice"}, {"@id": "kg:node/Bob"}]
    (tmp_path / "bad.json").write_text(json.dumps({"nodes": [1, {"id": "a", "type": 3}], "edges": {}, "clusters": [{"id": "c"}]}))
    assert {r["code"] for r in build.validate_json(spark, str(tmp_path / "bad.json")).collect()} == {"node_not_object", "node_type_not_string", "edges_not_list", "cluster_members_not_list"}
    assert graph_json.from_enriched(*graph_json.enriched(people)).edges.count() == 4
    assert graph_json.from_triples(spark.createDataFrame([("a", "r", "b")], "s string, r string, o string")).nodes.count() == 2
    assert exports.cytoscape(people).count() == 9 and exports.sync_plan(people).first()["n_pairs"] == 10


def test_stream(spark, tmp_path, people):
    src = tmp_path / "in"
    new = [("x1", "Carol", "works_at", "Acme Inc"), ("x2", "alice", "works_at", "Acme Inc")]
    spark.createDataFrame(new, "edge_id string, source string, rel string, target string").write.parquet(str(src))
    stream = spark.readStream.schema("edge_id string, source string, rel string, target string").parquet(str(src))
    q = merge_stream(stream, people, str(tmp_path / "v"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    g = merge.Versions(str(tmp_path / "v")).load(spark, 1)
    assert g.edges.count() == 5 and {r["node_id"] for r in g.nodes.collect()} >= {"Carol", "Alice"}
    e = spark.createDataFrame([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert windowed_counts(e).first()["n"] == 2


def test_facade_and_command_line(spark, tmp_path, capsys, monkeypatch):
    from loomgraph import cli
    from loomgraph.facade import GraphQuery

    doc = {"nodes": [{"id": x, "type": "T"} for x in "abc"], "edges": [{"source": "a", "target": "b", "relationship_type": "part_of", "metadata": {"source_ref": "d"}}, {"source": "b", "target": "c", "relationship_type": "part_of"}], "clusters": []}
    path = str(tmp_path / "g.json")
    (tmp_path / "g.json").write_text(json.dumps(doc))
    q = GraphQuery.from_json(spark, path)
    assert q.shortest_path("a", "c").first()["nodes"] == ["a", "b", "c"] and q.infer().relations(rel="has_part").count() == 2
    assert [r["node_id"] for r in q.rank(limit=1).collect()] == ["b"] and q.neighbors("a")[0].count() == 2 and q.evidence("a", "part_of", "b").first()["documents"] == ["d"]
    monkeypatch.setattr(cli.SparkSession, "builder", type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})())
    assert cli.main(["explain", path, "a", "c"]) == 0 and "a is connected to c over 2 hop(s)" in capsys.readouterr().out
    assert cli.main(["validate", path]) == 0 and cli.main(["entity", path, "zz"]) == 2
    suite = [{"name": "d", "entities": [{"name": "A", "type": "T"}], "relations": [{"source": "A", "relation": "r", "target": "B"}]}]
    (tmp_path / "s.json").write_text(json.dumps({"datasets": suite}))
    (tmp_path / "p.json").write_text(json.dumps({"predictions": {"d": {"entities": [{"name": "a", "type": "t"}], "relations": []}}}))
    got = {r["metric"]: r["value"] for r in cli.scores(spark, str(tmp_path / "s.json"), str(tmp_path / "p.json")).collect()}
    assert got == {"entity_f1": 1.0, "relation_f1": 0.0, "score": 0.6}
    report = cli.scores(spark, str(tmp_path / "s.json"), str(tmp_path / "p.json"))
    assert [r["line"] for r in evaluation.render_report(report).orderBy("k").collect()][:3] == ["# Evaluation report", "", "## d"]
    evaluation.save_report(report, str(tmp_path / "r"))
    assert evaluation.render_comparison(evaluation.compare_reports(report, report)).count() == 5
