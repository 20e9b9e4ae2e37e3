"""The pipeline against its stages done by hand."""

import random

import sentencepiece
from helpers import prose
from test_decontamination import brute as leaks
from test_line_dedup import brute as matching
from test_ngram_join import classes as near

import corpus_pipeline
from loomgraph.llm import pieces

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    g = random.Random(9)
    out = [(i, "\n".join(prose(1000 * i + k, 14, 10_000) for k in range(4))) for i in range(40)]
    for i in range(40, 55):  # near copies: words put in at the ends of lines, so that some lines match and others don't
        lines = out[i - 40][1].split("\n")
        out.append((i, "\n".join(x + " " + " ".join(g.choice(["ba", "ke", "ti"]) for _ in range(g.randint(0, 4))) for x in lines)))
    copies = [(i, " ".join(out[i - 60][1].split("\n")[:3]) + " mo") for i in range(60, 66)]
    junk = [(70, "Это другой алфавит"), (71, ""), (72, None), (73, "123 ...")]
    leak = [(80, prose(81, 20, 10_000) + " " + prose(5, 15, 10_000)), (None, prose(82, 30, 10_000))]
    return out + copies + junk + leak


def test_pipeline_as_by_hand(spark, tmp_path):
    docs, bench = documents(), [(0, prose(5, 15, 10_000)), (1, prose(6, 20, 10_000))]
    spark.createDataFrame([(i, t, None if i and 70 <= i < 80 else "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "sentencepiece"]
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in docs if not (i and 70 <= i < 80)]
    gone = {(i, k) for i, k, *_ in matching(kept)}
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in kept]
    cut = [(i, t) for i, t in cut if t.strip()]
    assert len(gone) > 10 and len(cut) < len(kept) + 1
    head = {i: c for i, c, _ in near(cut)}
    one = [(i, t) for i, t in cut if head.get(i, i) == i]
    bad = {i for i, *_ in leaks(one, bench)}
    assert bad == {80} and len(one) < len(cut)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert got == {i: model.encode(t) for i, t in one if i not in bad}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([(0, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
