from loomgraph.operators import extraction as E
from loomgraph.operators.evaluation import ontology_scores


def test_model_output(spark):
    rows = spark.createDataFrame([(1, 'so: [{"name": "A", "type": "T"}, {"entity": "B"}, {"x": 1}]'), (2, "no list"), (3, None)], "doc_id bigint, json string")
    assert {tuple(r) for r in E.read_mentions(rows).collect()} == {(1, "A", "T"), (1, "B", None)}
    rows = spark.createDataFrame([(1, '[{"subject": "A", "predicate": "p", "object": "B", "confidence": "0.5", "negated": true}, {"s": "A"}]')], "doc_id bigint, json string")
    assert [tuple(r) for r in E.read_triples(rows).collect()] == [(1, "A", "p", "B", 0.5, True)]


def test_evidence(spark):
    text = "Apple is old. Apple acquired Beats in 2014. Beats met Apple."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    t = spark.createDataFrame([(1, "Apple", "acquired", "Beats")], "doc_id bigint, s string, r string, o string")
    assert E.snippets(t, docs).first()["snippet"] == "Apple acquired Beats in 2014."
    assert E.snippet("Ann x\ny z Bob", "Ann", "Bob", "knows") == "Ann x\ny z Bob" and E.snippet("", "a", "b", "c") == ""
    assert E.smallest_window("a b c a x b", ["A", "b"]) == "a b" and E.smallest_window("a", ["z"]) == ""
    d = spark.createDataFrame([("Apple", "acquired", "Beats", "exact"), ("X", "made", "Y", "one")], "s string, r string, o string, description string")
    t2 = spark.createDataFrame([("Apple", "acquired", "Beats"), ("P", "made", "Q"), ("P", "none", "Q")], "s string, r string, o string")
    assert {(r["r"], r["description"]) for r in E.align_documents(t2, d).collect()} == {("acquired", "exact"), ("made", "one"), ("none", None)}


def test_salvage(spark):
    texts = ['[{"name": "A"}]', "Sure: {'name': 'A', 'ok': True, 'x': None}", '[{"name": "A"}, {"name": "B"', '```json\n{"name": "A"}\n```', "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, json string")
    assert sorted(tuple(r)[:2] for r in E.read_mentions(rows).collect()) == [(0, "A"), (1, "A"), (2, "A"), (3, "A")]


def test_raw_events(spark):
    raw = '[{"type": "company_acquisition", "participants": {"buyer": "Apple", "sold": ["Beats", "B2"]}, "date": "2014"}, {"type": "other", "participants": {"a": "b"}}, {"type": "Company Acquisition"}]'
    rows = spark.createDataFrame([(1, raw), (2, raw)], "doc_id bigint, json string")
    out = E.read_events(rows, spark.createDataFrame([("CompanyAcquisition",)], "event_type string")).collect()
    assert len(out) == 1 and out[0]["participants"] == {"buyer": ["Apple"], "sold": ["Beats", "B2"]} and out[0]["ts"] == "2014"
    w = E.windows_of(spark.createDataFrame([("a b c a x b", ["A", "b"]), (None, None)], "text string, names array<string>")).collect()
    assert [r["window"] for r in w] == ["a b", ""]


def test_ontology(spark):
    types = spark.createDataFrame([(0, "Company", "a firm that trades", ["Acme"], None), (1, "Event", "", [], '{"when":"the day it took place"}')], "idx bigint, name string, description string, examples array<string>, properties string")
    rels = spark.createDataFrame([("g", "held", "Company", "Event", "which firm held it"), ("", "has", "Company", "Nowhere", "")], "group_name string, name string, src string, dst string, description string")
    got = {r["metric"]: (r["score"], r["verdict"]) for r in ontology_scores(types, rels).collect()}
    assert got["consistency"] == (0.88, "strength") and got["completeness"][0] == 0.3 + 0.25 + 0.1 + 0.075 + 0.1 and len(got) == 8
    assert got["event_modeling"][0] == 0.4 and got["property_modeling"][0] == round(0.35 + 0.45 + 0.2 * 0.65, 6)
    empty = {r["metric"]: r["score"] for r in ontology_scores(types.limit(0), rels.limit(0)).collect()}
    assert empty["relation_quality"] == 0 and empty["event_modeling"] == 0.7
