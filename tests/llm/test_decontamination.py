import random

import numpy as np
import pyarrow as pa
from helpers import ODD, frame, prose

from loomgraph.llm import decontamination as D

BENCH = "item_id bigint, text string, doc_id bigint"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(text):
    return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in (text or "").split()) if w]


def brute(docs, items):
    out = {}
    for i, text in docs:
        w = plain(text)
        for k, it in items:
            x = plain(it)
            if i is None or k is None or not x:
                continue
            n, d = len(x), int(D.RATE * len(x) + 1e-9)
            for p in range(len(w)):
                y = w[p : p + n]
                if len(y) >= n - d and (e := lev(x, y)) <= d:
                    out[i, k] = min(out.get((i, k), (99, 0)), (e, p))
    return {(i, k, e, p) for (i, k), (e, p) in out.items()}


def test_same_as_brute_force(spark):
    g = random.Random(1)
    items = [(k, prose(100 + k, g.randint(8, 30), 10_000)) for k in range(12)] + [(50, "lone"), (51, None), (52, "..."), (None, "lone word")]
    docs = []
    for i in range(40):
        w = prose(i, g.randint(0, 60), 10_000).split()
        it = g.choice(items[:12])[1].split()
        for _ in range(g.randint(0, len(it) // 5)):
            it[g.randrange(len(it))] = "changed"
        docs.append((i, " ".join(w + ([x.upper() + "," for x in it] if i % 2 else []) + w[:9])))
    docs += [(100, "a lone word"), *ODD, (1, docs[1][1])]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], BENCH)
    got = {tuple(r) for r in D.contaminated(frame(spark, *docs), bench).collect()}
    want = brute(docs, items)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 15
    kept = D.drop_contaminated(frame(spark, *docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, *_ in got}


def test_parts_of_a_benchmark_and_empty_tables(spark):
    bench = spark.createDataFrame([(k, prose(k, 20), 0) for k in range(4)], BENCH)
    docs = frame(spark, *[(k, prose(k, 20)) for k in range(4)])
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(docs, bench, most_words=30).collect()} >= {(k, k, 0) for k in range(4)}
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0


def test_recall_of_the_repeated_samples():
    g = np.random.default_rng(2)
    h, off = D.words(pa.array([prose(k, 15 + k % 30, 10_000) for k in range(60)]))
    items = [h[a:b] for a, b in zip(off[:-1], off[1:])]
    index = D.Index(list(range(60)), items, D.RATE, D.RECALL)
    hit = total = 0
    for k, x in enumerate(items):
        y = D.edited(x, int(D.RATE * len(x)), g)
        text = np.concatenate([g.integers(0, 2**63, 30).astype(np.uint64), y, g.integers(0, 2**63, 30).astype(np.uint64)])
        start = np.arange(20, 40)
        n = len(x)
        d = D.edit_distance(np.tile(x, (20, 1)), np.full(20, n), text[start[:, None] + np.arange(n)], np.full(20, n), n)
        if d.min() <= int(D.RATE * n + 1e-9):
            total += 1
            hit += k in D.matches(text, np.array([0, len(text)]), index)[1]
    assert total > 20 and hit >= 0.95 * total


def test_edit_distance_within_a_band():
    g = np.random.default_rng(3)
    a, b = g.integers(0, 4, (200, 12)).astype(np.uint64), g.integers(0, 4, (200, 15)).astype(np.uint64)
    b[:100, :12] = a[:100]
    b[:60, 3] = 9
    na, nb = g.integers(1, 13, 200), g.integers(1, 16, 200)
    want = np.array([lev(x[:n].tolist(), y[:m].tolist()) for x, n, y, m in zip(a, na, b, nb)])
    for most in (0, 2, 5, 15):
        got = D.edit_distance(a, na, b, nb, most)
        assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most).all()


def test_long_items_are_found_among_short_ones(spark):
    """Repetitions go by size: copies of 400-word items with as many edits as allowed, and one item of 3000 words."""
    g = np.random.default_rng(4)
    h, off = D.words(pa.array([prose(k, 12, 10_000) for k in range(300)] + [prose(1000 + k, 400, 10_000) for k in range(20)] + [prose(5000, 3000, 10_000)]))
    items = [h[a:b] for a, b in zip(off[:-1], off[1:])]
    index = D.Index(list(range(len(items))), items, D.RATE, D.RECALL)
    assert index.reps[400] > index.reps[12] > 0
    noise = lambda: g.integers(0, 2**63, 50).astype(np.uint64)
    edits = [(k, D.edited(items[k], 60, g)) for k in range(300, 320)] + [(320, D.edited(items[320], 5, g))]
    text = [np.concatenate([noise(), y, noise()]) for _, y in edits]
    rows, found, *_ = D.matches(np.concatenate(text), np.concatenate([[0], np.cumsum([len(x) for x in text])]), index)
    hit = set(zip(rows.tolist(), found.tolist()))
    assert len(hit) >= 20 and (20, 320) in hit and hit <= {(r, k) for r, (k, _) in enumerate(edits)}


def test_sizes_beyond_the_repetitions_are_compared_whole():
    g = np.random.default_rng(5)
    h, off = D.words(pa.array([prose(k, 60, 10_000) for k in range(20)]))
    items = [h[a:b] for a, b in zip(off[:-1], off[1:])]
    index = D.Index(list(range(20)), items, D.RATE, D.RECALL, most=1)
    assert index.reps == {60: 0}
    y = D.edited(items[7], 7, g)
    text = np.concatenate([g.integers(0, 2**63, 30).astype(np.uint64), y, g.integers(0, 2**63, 30).astype(np.uint64)])
    assert D.matches(text, np.array([0, len(text)]), index)[1].tolist() == [7]


def test_a_very_long_text_and_clashing_names(spark):
    item = prose(77, 25, 10_000)
    docs = frame(spark, (1, prose(1, 50_000, 10_000) + " " + item), (2, prose(2, 50, 10_000)), (3, None), (None, item)).withColumnsRenamed({"a": "leak", "p": "item_id", "ids": "distance"})
    bench = spark.createDataFrame([(0, item, 1), (0, item, 1)], BENCH)
    got = {(r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 0, 0, 50_000)}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
