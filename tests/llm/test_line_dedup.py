import random

import numpy as np
import pyarrow as pa
from helpers import ODD, frame, prose
from pyspark.sql import functions as F

from loomgraph.llm import _text as T
from loomgraph.llm import line_dedup


def brute(pairs, t=line_dedup.THRESHOLD):
    lines = [(i, k, frozenset(x.lower().split())) for i, text in pairs if i is not None and text for k, x in enumerate(text.split("\n"))]
    lines = sorted([x for x in lines if x[2]], key=lambda x: x[:2])
    out = set()
    for n, (i, k, s) in enumerate(lines):
        for j, m, r in lines[:n]:
            o = len(s & r)
            if o >= t * (len(s) + len(r) - o) - 1e-9:
                out.add((i, k, j, m))
                break
    return out


def documents():
    g = random.Random(4)
    base = [prose(k, g.randint(1, 30)) for k in range(40)]
    pairs = []
    for i in range(60):
        text = []
        for _ in range(g.randint(1, 8)):
            w = g.choice(base).split()
            for _ in range(g.randint(0, 3)):
                w[g.randrange(len(w))] = "new" + str(g.randint(0, 50))
            text.append(" ".join(w))
        pairs.append((i, "\n".join(text)))
    return pairs


def test_same_as_brute_force(spark):
    pairs = documents() + ODD
    got = {tuple(r) for r in line_dedup.matching_lines(frame(spark, *pairs)).collect()}
    assert got == brute(pairs)


def test_lines_and_emptied_documents_go(spark):
    docs = frame(spark, (1, "one two three\nfour five"), (2, "Three two one\nsix"), (3, "five four"), (None, "one two three"), (4, None), (5, ""), (6, "  "))
    out = line_dedup.drop_matching_lines(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, "one two three\nfour five", 23), (2, "six", 3), (None, "one two three", 13), (4, None, None), (5, "", 0), (6, "  ", 2)}


def test_repeated_rows_and_empty_table(spark):
    twice = frame(spark, (1, "one two\nthree"), (1, "one two\nthree"), (2, "two one"))
    assert {tuple(r) for r in line_dedup.matching_lines(twice).collect()} == {(2, 0, 1, 0)}
    empty = frame(spark, (1, "a")).limit(0)
    assert line_dedup.matching_lines(empty).count() == 0
    assert line_dedup.drop_matching_lines(empty).count() == 0


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    docs = frame(spark, (1, "a b c\nd e f"), (1, "g h i\nd e f"), (1, "g h i\nd e f"), (2, "a b c\nj k l"), (3, "m"))
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_matching_lines(docs).collect())
    assert got in (  # by the hashes of the texts
        [(1, "a b c"), (1, "g h i\nd e f"), (1, "g h i\nd e f"), (2, "j k l"), (3, "m")],
        [(1, "a b c\nd e f"), (1, "g h i"), (1, "g h i"), (2, "j k l"), (3, "m")],
    )


def test_names_used_inside_may_be_columns(spark):
    docs = frame(spark, (1, "one two three\nfour five"), (2, "Three two one\nsix")).withColumnsRenamed({"p": "gone", "a": "ID", "ids": "h", "words": "line.no", "cid": "variant"})
    out = line_dedup.drop_matching_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["ID"]) for r in out.collect()) == [(1, "one two three\nfour five", "x"), (2, "six", "x")]


def test_first_candidate_is_no_match(spark):
    """Lines that share a rare word and the bits of their signatures, but not enough words, stand before the real match."""
    base = [f"w{k}" for k in range(40)]
    lines = [" ".join(base[:36] + [f"x{j}{k}" for k in range(4)]) for j in range(30)]
    pairs = list(enumerate(lines)) + [(100 + j, " ".join(base[:36] + [f"x{j}{k}" for k in range(3)] + ["y"])) for j in range(30)]
    got = {tuple(r) for r in line_dedup.matching_lines(frame(spark, *pairs)).collect()}
    assert got == brute(pairs)


def test_long_lines_and_many_lines(spark):
    long = prose(1, 20_000, 10_000)
    many = "\n".join(prose(k, 6, 10_000) for k in range(5000))
    pairs = [(1, long), (2, long + " end"), (3, many), (4, many)]
    got = line_dedup.matching_lines(frame(spark, *pairs)).collect()
    assert (2, 0, 1, 0) in {tuple(r) for r in got}
    assert {r["line_no"] for r in got if r["doc_id"] == 4} == set(range(5000))
    left = line_dedup.drop_matching_lines(frame(spark, *pairs)).collect()
    assert 4 not in {r["doc_id"] for r in left}


def test_earliest_candidates_of_a_hot_word():
    """One word in all lines: the same pairs as all with all."""
    g = np.random.default_rng(2)
    n = 3000
    c = {"tok": np.full(n, 5, np.uint64), "doc": g.permutation(n), "line": np.zeros(n, np.int64), "n": g.integers(8, 14, n).astype(np.int32), "pos": g.integers(0, 3, n).astype(np.int32), "sig": g.integers(0, 7, n)}
    table = pa.table({"p": [0], **{k: [T.planes(c[k].astype(t))] for k, t in line_dedup._POST}})
    rows = line_dedup._earliest(0.85, 3, 10_000)(table).to_pylist()
    o = np.argsort(c["doc"])
    s = {k: v[o] for k, v in c.items()}
    want, cut = set(), set()
    for i in range(1, n):
        hit = np.flatnonzero(line_dedup._may_match(s, np.full(i, i), np.arange(i), 0.85))[:3]
        want |= {(i, int(j)) for j in hit}
        cut |= {(i, int(hit[-1]))} if len(hit) == 3 else set()
    assert {(r["doc_b"], r["doc_a"]) for r in rows} == want and len(want) > 1000
    assert {(r["doc_b"], r["doc_a"]) for r in rows if r["last"]} == cut


def test_many_wrong_candidates_come_first(spark, monkeypatch):
    """More candidates fail than are listed: the match after them is still found."""
    monkeypatch.setattr(line_dedup, "_bits", lambda h, off: np.zeros(len(off) - 1, np.uint64))
    monkeypatch.setattr(line_dedup, "LISTED", 1)
    asked = []
    monkeypatch.setattr(line_dedup, "_later", lambda t, f=line_dedup._later: asked.append(t) or f(t))
    pairs = documents() + ODD
    assert {tuple(r) for r in line_dedup.matching_lines(frame(spark, *pairs)).collect()} == brute(pairs)
    assert asked


def test_sketches_bound_the_overlap():
    g = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(g.integers(0, 400, 90).astype(np.uint64))
        b = np.unique(np.concatenate([a[: g.integers(40, len(a))], g.integers(0, 400, 10).astype(np.uint64)]))
        x, y = (np.array(line_dedup._sketch(T.mix(v), np.array([0, len(v)]))).view(np.uint64)[:, 0] for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_signatures_that_differ_in_the_top_bit():
    """Bits are counted without regard to a sign."""
    c = {"n": np.array([40, 40]), "pos": np.array([0, 0]), "sig": np.array([(1 << 63) | 1, 3], np.uint64)}
    table = pa.table({"p": [0], **{k: [T.planes(np.array(v).astype(t))] for (k, t), v in zip(line_dedup._POST, ([5, 5], [1, 2], [0, 0], c["n"], c["pos"], c["sig"]))}})
    assert [(r["doc_a"], r["doc_b"]) for r in line_dedup._earliest(0.85)(table).to_pylist()] == [(1, 2)]


def test_no_text_is_read_for_variants_where_doc_ids_differ(spark):
    unread = F.raise_error(F.concat(F.lit("read: "), "text")).cast("string")
    docs = frame(spark, (1, "a"), (2, "b")).select("doc_id", unread.alias("text"))
    texts = line_dedup.variants(docs)[1]
    assert texts.count() == 0 and texts.columns == ["doc_id", "h", "variant"]
    docs, texts = line_dedup.variants(frame(spark, (1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "b"), (3, "c")).select("doc_id", "text"))
    assert {(r["doc_id"], r["variant"]) for r in texts.collect()} == {(1, 0), (1, 1)}
    assert sorted((r["doc_id"], r["text"]) for r in docs.where("variant = 0").collect())[-3:] == [(2, "b"), (2, "b"), (3, "c")]


def test_words_and_sketches_as_by_hand():
    texts = ["a b", "a\u00a0b", "a\u3000b\u2003c", "x\x1cy z", "caf\u00e9 \u201cna\u00efve\u201d \u2026", " \t\n", "", "\u65e5\u672c x"]
    for x in texts:
        w = T.Words(pa.array([x]))
        assert [w.uniq[int(c)].as_py() for c in w.codes] == x.split()
    g = np.random.default_rng(1)
    off = np.concatenate([[0], np.cumsum(g.integers(0, 30, 9000))])
    h = g.integers(0, 2**63, off[-1]).astype(np.uint64)
    bit = (T.mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(55)).tolist()
    got = line_dedup._sketch(h, off)
    for i in (0, 8191, 8192, 8999):
        whole = sum(1 << b for b in set(bit[off[i] : off[i + 1]]))
        assert [int(x[i]) % 2**64 for x in got] == [whole >> 64 * k & 2**64 - 1 for k in range(8)]
