import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, frame, prose
from pyspark.sql import functions as F

from loomgraph.llm import resampling, vector_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, shard int, near string"


def brute(rows, t=0.95):
    """Rows (vec_id, class_id, links), for rows (vec_id, vector) without repeats."""
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, 0)
    assert not (abs(s - t) < 1e-6).any()
    hit, head = s >= t, np.array([i for i, _ in rows])
    for _ in rows:
        new = np.minimum(head, np.where(hit, head[None], 10**9).min(1))
        if (new == head).all():
            break
        head = new
    return sorted((i, int(h), int(n)) for (i, _), h, n in zip(rows, head, hit.sum(1)) if n)


def near_and_far():
    g = np.random.default_rng(0)
    x = g.normal(size=(700, 16))
    for k in range(200):
        x[400 + k] = x[k % 7] + 0.05 * g.normal(size=16)
    x[600:700] = x[0]
    return [(k, v.tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("shard", [1500, 150])
def test_near_vectors_as_brute_force(spark, shard):
    rows = near_and_far()
    odd = [(None, rows[0][1]), (2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, 2.0]), (0, rows[0][1]), (2005, [None, *rows[0][1][1:]])]
    frame_ = spark.createDataFrame([(*r, 0, 1, "x") for r in rows + odd], SCHEMA)
    out = vector_dedup.near_vectors(frame_, shard=shard)
    assert out.columns == ["vec_id", "class_id", "links"]
    got, want = {r[0]: r for r in map(tuple, out.collect())}, {r[0]: r for r in brute(rows)}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[i][2] <= want[i][2] for i in got) and sum(r[2] for r in got.values()) >= 0.95 * sum(r[2] for r in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in got]) > 0.98


def test_cells_that_are_not_cut_are_compared_exactly(spark, monkeypatch):
    """Few centroids of a cell give several levels, and one dense group stays larger than a shard."""
    monkeypatch.setattr(vector_dedup, "CENTROIDS", 2)
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(150, 12)), np.ones(12) + 0.03 * g.normal(size=(250, 12))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = vector_dedup.near_vectors(spark.createDataFrame([(*r, 0, 1, "x") for r in rows], SCHEMA), shard=30).collect()
    want = brute(rows)
    assert len(got) == len(want) and sum(r["links"] for r in got) >= 0.98 * sum(r[2] for r in want)


def test_block_pairs_as_brute_force(spark):
    rows = near_and_far()[:600]
    unit = [(1, k, 16, bytearray((np.array(v) / np.linalg.norm(v)).astype(np.float32).tobytes()), 1, [1]) for k, v in rows]
    parts = spark.createDataFrame(unit, "cell bigint, rep bigint, dim int, vec binary, many bigint, homes array<bigint>")
    got = vector_dedup.exact_links(parts, 0.95, block=100).groupBy("rep").agg({"links": "sum"}).where("`sum(links)` > 0").collect()
    assert sorted(map(tuple, got)) == [(i, n) for i, _, n in brute(rows)]


def test_a_vector_id_with_two_vectors(spark):
    x = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.1, 1.0]), (4, [-1.0, 0.0])]
    got = vector_dedup.near_vectors(spark.createDataFrame([(*r, 0, 1, "x") for r in x], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]


def test_recall_counts_groups(spark):
    """A group of 60 is found, 20 pairs are lost."""
    audit = object.__new__(vector_dedup._Audit)
    audit.truth = spark.createDataFrame([(a, 59) for a in range(60)] + [(a, 1) for a in range(100, 140)], "rep bigint, links bigint")
    assert audit.recall(audit.truth.where("rep < 60")) < 0.1
    assert 38 < audit.partnered() < 45


def test_audit_goes_on_until_it_holds_partners(spark):
    g = np.random.default_rng(7)
    x = g.normal(size=(900, 64))
    x[899] = x[0] + 0.01 * g.normal(size=64)
    unit = [(k, 64, bytearray((v / np.linalg.norm(v)).astype(np.float32).tobytes()), 1) for k, v in enumerate(x)]
    reps = spark.createDataFrame(unit, "rep bigint, dim int, vec binary, many bigint").withColumn("place", F.pmod(F.xxhash64("rep"), F.lit(vector_dedup._PLACES)))
    audit = vector_dedup._Audit(reps, 900, 64, 0.95)
    audit.extend(100)
    assert not audit.done
    audit.extend(900)
    assert audit.done and {tuple(r) for r in audit.truth.collect()} == {(0, 1), (899, 1)}
    assert audit.recall(audit.truth) == 1 and audit.recall(audit.truth.limit(0)) == 0


def test_labels_of_components():
    label = np.arange(8)
    vector_dedup.unite(label, np.array([7, 3]), np.array([3, 5]))
    vector_dedup.unite(label, np.array([1, 5]), np.array([2, 1]))
    assert label.tolist() == [0, 1, 1, 1, 4, 1, 6, 1]


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 0, 0, "")], SCHEMA)
    assert vector_dedup.near_vectors(one).count() == 0


def test_robust_prune_keeps_an_edge_per_direction():
    x = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0.99, -0.141]], np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = vector_dedup.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]), 3)
    assert sorted(v for v in out[0].tolist() if v >= 0) == [1, 3]


def brute_weights(texts, good):
    raw = np.zeros(1 << resampling.BITS)
    target = raw.copy()
    lists = []
    for k, t in enumerate(texts):
        b, _ = resampling.buckets(pa.array([t or ""]))
        lists.append(b)
        np.add.at(raw, b, 1)
        if k in good:
            np.add.at(target, b, 1)
    ratio = resampling.log_ratio(raw, target)
    return [float(ratio[b].astype(float).sum()) for b in lists]


def test_draw_as_brute_force(spark):
    texts = [prose(k, 60) if k % 3 else " ".join("%%" + w for w in prose(k, 60).split()) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)] + [(None, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, *enumerate(texts))
    w = np.array(brute_weights(texts, {k for k in range(60) if k % 3}))
    key = w + resampling.gumbel(np.arange(120), resampling.SEED)
    out = {r["doc_id"]: r["log_weight"] for r in resampling.resample(docs, labels, share=0.5).collect()}
    assert set(out) == set(np.argsort(-key)[:60].tolist())
    assert all(abs(v - w[k]) < 1e-3 for k, v in out.items())
    share = np.mean([k % 3 > 0 for k in out])
    assert share > 0.95  # held-out junk is drawn rarely


def test_draw_with_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, (1, "a b c"), (1, "a b c"), (2, "d"), *ODD)
    assert {r["doc_id"] for r in resampling.resample(docs, labels).collect()} == {1, 2, 900, 901, 902, 903, 904}
    assert resampling.resample(docs.limit(0), labels).count() == 0
    assert resampling.resample(docs, labels.limit(0)).count() == 8
    ranked = spark.createDataFrame([(v,) for v in (5, 5, -3, 7, 2**62, -(2**62))], "k bigint")
    assert [resampling.kth_greatest(ranked, "k", k) for k in (1, 2, 3, 4, 5, 6, 7)] == [2**62, 7, 5, 5, -3, -(2**62), None]
