import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, frame, prose

from loomgraph.llm import pieces, token_binary

TEXTS = ["", "a", "  a  b ", "é  x ﬁ ①\n\t Ａｂ", "日本語 テスト", "😀 x  😀", "　 a", "¨ a", "x\n\n  y\r\n", "half ﾊﾞ ﾊ ﾞ", "     b", prose(1, 200)]


def test_tokens_as_for_whole_texts():
    with open(token_binary.VOCABULARY, "rb") as f:
        enc = token_binary.coder(f.read())
    ids, off = token_binary.tokenize(pa.array(TEXTS), enc)
    for k, text in enumerate(TEXTS):
        assert ids[off[k] : off[k + 1]].tolist() == enc.encode_ordinary(text)


def test_code_round_trip():
    g = np.random.default_rng(0)
    values = np.concatenate([g.integers(0, 2**b, 100) for b in (1, 8, 9, 16, 17, 24, 31)]).astype(np.uint32)
    g.shuffle(values)
    off = np.array([0, 0, 1, 5, 300, 700])
    c, co, d, do = token_binary.encode(values, off)
    for k in range(len(off) - 1):
        got = token_binary.decode(c[co[k] : co[k + 1]].tobytes(), d[do[k] : do[k + 1]].tobytes(), off[k + 1] - off[k])
        assert (got == values[off[k] : off[k + 1]]).all()


def test_binary_table(spark):
    docs = frame(spark, *[(k, t) for k, t in enumerate(TEXTS)], (1, "a"), *ODD)
    rows = token_binary.binary_ids(docs).collect()
    head = [r for r in rows if r["doc_id"] is None]
    assert len(head) == 1 and len(rows) == len(TEXTS) + 1 + len(ODD)
    with open(token_binary.VOCABULARY, "rb") as f:
        enc = token_binary.coder(f.read())
    text, count = {k: t for k, t in [*enumerate(TEXTS), *ODD[1:]]}, {}
    for r in rows:
        if r["doc_id"] is not None:
            ids = token_binary.decode_ids(bytes(r["control"]), bytes(r["data"]), r["n_tokens"], bytes(head[0]["data"])).tolist()
            assert ids == enc.encode_ordinary(text[r["doc_id"]] or "")
            for i in ids:
                count[i] = count.get(i, 0) + 1
    by_rank = np.frombuffer(bytes(head[0]["data"]), "<u4").tolist()
    assert by_rank == sorted(by_rank, key=lambda i: (-count.get(i, 0), i))
    assert token_binary.binary_ids(docs.limit(0)).count() == 1


@pytest.mark.parametrize("name", ["nfkc", "nmt_nfkc", None])
def test_pieces_and_spans_as_the_library(name):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    blob, proto = pieces.compiled(name), pb.ModelProto()
    proto.ParseFromString(model)
    if blob is not None:
        proto.normalizer_spec.precompiled_charsmap = blob
    library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    e = pieces.Encoder(model, blob)
    ids, begin, end, off, _ = e.encode(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        s = slice(off[k], off[k + 1])
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids[s].tolist(), begin[s].tolist(), end[s].tolist())) == want
        assert e.decode(ids[s].tolist()) == library.decode(ids[s].tolist())


def test_piece_table(spark):
    docs = frame(spark, *[(k, t) for k, t in enumerate(TEXTS)], *ODD)
    rows = {r["doc_id"]: r for r in pieces.encode_pieces(docs).collect()}
    text = {k: t for k, t in [*enumerate(TEXTS), *ODD]}
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    assert len(rows) == len(text)
    for k, r in rows.items():
        raw = (text[k] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw
        assert r["round_trip"] is (None if text[k] is None else back[k] == text[k])
    assert rows[900]["ids"] == [] and rows[901]["round_trip"] is True
    assert pieces.encode_pieces(docs.limit(0)).count() == 0
