import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import ODD

from loomgraph.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, known int, spans string"


def corpus(spark, more=()):
    g = np.random.default_rng(1)
    syll = {"aa": ["tho", "ing", "wer", "and"], "bb": ["zuk", "ych", "ßen", "üb"]}
    out = []
    for i in range(80):
        lang = "aa" if i % 2 else "bb"
        out.append((i, " ".join("".join(g.choice(syll[lang], g.integers(1, 4))) for _ in range(60)), lang, 1, "x"))
    return spark.createDataFrame([*out, *[(i, t, None, 1, "x") for i, t in [*more, *ODD]]], SCHEMA)


def brute(score, off, switch):
    best = []
    for a, b in zip(off[:-1], off[1:]):
        v = np.zeros(score.shape[1])
        for t in range(a, b):
            v = np.maximum(v, v.max() - switch) + score[t]
        best.append(v.max() if b > a else 0)
    return best


def test_viterbi_is_exact_across_segments():
    g = np.random.default_rng(0)
    for _ in range(10):
        off = np.concatenate([[0], np.cumsum(g.integers(0, 300, 8))])
        s = -4 * g.random((off[-1], 4)).astype(np.float32)
        lab = langid.viterbi(s, off, 3.0)
        value = [sum(s[t, lab[t]] for t in range(a, b)) - 3 * (lab[a + 1 : b] != lab[a : b - 1]).sum() if b > a else 0 for a, b in zip(off[:-1], off[1:])]
        assert np.allclose(value, brute(s.astype(float), off, 3.0), atol=0.02)


def test_many_distinct_words_in_bounded_memory():
    g = np.random.default_rng(2)
    m = langid.Model(["aa", "bb", "cc"], g.random((3, 1 << langid.BITS)), np.ones((3, langid.SCRIPTS)))
    words = [f"{'zuk' * (i % 3)}{i}wort" for i in range(120_000)] + ["x" * 40_000]
    text = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    tracemalloc.start()
    off, lab, letters = langid.label(text, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and letters.all() and off[-1] == len(words)
    some = pa.array(words[-50:])
    assert np.array_equal(m.scores(pa.array(words))[-50:], m._scores(some))


def test_many_labels_and_bounded_memory():
    g = np.random.default_rng(1)
    off = np.array([0, 500, 500, 501, 900, 1700])
    s = -4 * g.random((1700, 200)).astype(np.float32)
    s[:500, 190] += 4
    whole = langid.viterbi(s, off, 3.0)
    assert whole.max() > 128 and (whole[:500] == 190).mean() > 0.9
    for limit in (1, 200 * 200 * 3, 200 * 200 * 10):
        assert (langid.viterbi(s, off, 3.0, limit) == whole).all()
    tied = np.zeros((4, 3), np.float32)
    assert langid.viterbi(tied, np.array([0, 4])).tolist() == [0, 0, 0, 0]


def test_spans_and_filter(spark):
    mixed = "thoing wering andand thowering ingand " * 6 + "zukych ßenüb zukzuk ychüben " * 8
    docs = corpus(spark, [(500, mixed), (501, "Это другой алфавит совсем"), (502, "thoing 12 34 , wering and")])
    out = {r["doc_id"]: r for r in langid.languages(docs).collect() if r["doc_id"] is not None}
    assert all(out[i]["lang"] == ("aa" if i % 2 else "bb") for i in range(80))
    assert [(s["lang"], s["first"], s["words"]) for s in out[500]["spans"]] == [("aa", 0, 30), ("bb", 30, 32)]
    assert out[501]["lang"] == "und" and out[501]["known"] == 0
    assert out[502]["lang"] == "aa" and out[502]["share"] == 1
    for i in (900, 901, 902, 903):
        assert out[i]["lang"] == "und" and out[i]["share"] == 0
    kept = langid.keep_known(docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {*range(80), 500, 502} <= ids and not ids & {501, 900, 901, 902, 903}


def test_empty_and_unlabelled(spark):
    docs = corpus(spark)
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r["lang"] for r in langid.languages(docs.where("lang IS NULL")).collect()} == {"und"}


def test_scripts_narrow():
    assert langid.scripts(pa.array(["abc", "год", "aб", "12", "日本"])).tolist() == [2, 8, 10, 0, 1 << 15]


def test_repeated_rows_and_a_long_text(spark):
    long = "thoing wering andand thowering ingand " * 20_000
    docs = corpus(spark, [(700, long), (700, long), (700, "zukych ßenüb zukzuk ychüben")]).withColumnRenamed("spans", "text_")
    out = [r for r in langid.languages(docs).collect() if r["doc_id"] == 700]
    assert sorted((r["lang"], sum(x["words"] for x in r["spans"])) for r in out) == [("aa", 100_000), ("aa", 100_000), ("bb", 4)]
    assert sum(r["doc_id"] == 700 for r in langid.keep_known(docs).collect()) == 3
