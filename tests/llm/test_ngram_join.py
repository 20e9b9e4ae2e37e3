import random
import sys

import numpy as np
from helpers import ODD, frame, prose

from loomgraph.llm import _text, ngram_join


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def alike(a, b, t=ngram_join.THRESHOLD):
    o = len(a & b)
    return o > 0 and o >= t * (len(a) + len(b) - o) - 1e-9


def brute(pairs, t=ngram_join.THRESHOLD):
    """Links between documents: pairs of (doc_id, text)."""
    rows = [(x, grams(x[1])) for x in sorted({(i, x) for i, x in pairs if i is not None and x})]
    return {(x, y) for k, (x, a) in enumerate(rows) for y, b in rows[:k] if alike(a, b, t)}


def classes(pairs, t=ngram_join.THRESHOLD):
    """Rows (doc_id, class_id, links) of the documents that have links."""
    edges = brute(pairs, t)
    head = {x: x for e in edges for x in e}
    for _ in head:
        for x, y in edges:
            head[x] = head[y] = min(head[x], head[y])
    return sorted((x[0], h[0], sum(x in e for e in edges)) for x, h in head.items())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def documents():
    g = random.Random(3)
    out = []
    for i in range(80):
        w = prose(i % 12, 40 + i % 12).split()
        for _ in range(g.randint(0, 4)):
            w[g.randrange(len(w))] = "z"
        out.append((i, " ".join(w)))
    return [*out, (200, "two words"), (201, "Two  words"), (202, "two")]


def test_same_as_brute_force(spark):
    pairs = documents() + ODD
    out = ngram_join.ngram_jaccard_join(frame(spark, *pairs))
    assert out.columns == ["doc_id", "class_id", "links"]
    got = found(out)
    assert got == classes(pairs) and len(got) > 40


def test_hot_columns_and_small_blocks_change_nothing(spark):
    base = prose(1, 60)
    pairs = documents() + [(300 + i, base + f" end {i // 2} {i % 7}") for i in range(60)]
    assert len(ngram_join.frequent(frame(spark, *pairs), 3, hot=50)[0]) >= 50
    got = ngram_join.classes(frame(spark, *pairs), hot=50, block=16).select("doc_id", "class_id", "links")
    assert found(got) == classes(pairs)


def test_counters_keep_what_is_frequent():
    g = np.random.default_rng(1)
    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(20):
        new = np.concatenate([np.full(300, 7, np.uint64), g.integers(100, 10**9, 1000).astype(np.uint64)])
        u, c = np.unique(new, return_counts=True)
        keys, n = ngram_join._merge(np.concatenate([keys, u]), np.concatenate([n, c]), 50)
    assert len(keys) <= 50 and 0 < 20 * 300 - n[keys == 7][0] <= 20 * 1300 // 50


def test_one_of_each_class_stays(spark):
    pairs = documents()
    head = {i: c for i, c, _ in classes(pairs)}
    docs = frame(spark, *pairs, *ODD)
    out = ngram_join.drop_near_copies(docs)
    assert set(out.columns) == set(docs.columns)
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in pairs if head.get(i, i) == i} | {i for i, _ in ODD}


def test_repeated_rows_and_clashing_names(spark):
    one, two = prose(1, 30), prose(2, 30)
    pairs = [(1, one), (1, one), (2, one), (2, two), (3, two + " end"), (4, prose(3, 30))]
    docs = frame(spark, *pairs).withColumnsRenamed({"a": "doc", "ids": "TXT", "words": "txt_"})
    assert found(ngram_join.ngram_jaccard_join(docs)) == classes(pairs) == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(docs).collect()]
    assert sorted(kept) == sorted([(1, one), (1, one), (2, two), (4, prose(3, 30))])


def test_the_last_join_runs_by_itself(spark):
    plan = ngram_join.drop_near_copies(frame(spark, *documents()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "mapInArrow" not in plan and "MapInArrow" not in plan
    assert _text.trim_driver(spark) or sys.platform != "linux"


def test_very_long_text(spark):
    long = prose(8, 60_000, 10_000)
    pairs = [(1, long), (2, long + " end"), (3, "short text of words")]
    assert found(ngram_join.ngram_jaccard_join(frame(spark, *pairs))) == [(1, 1, 1), (2, 1, 1)]


def test_empty_table(spark):
    empty = frame(spark, (1, "a")).limit(0)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    assert ngram_join.drop_near_copies(empty).count() == 0
