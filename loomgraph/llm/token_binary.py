"""Token ids as bytes: frequency ranks in a byte-aligned variable-length code.

Texts are cut before white-space runs, where the pre-tokenizer always cuts too,
and each distinct unit of a few megabytes is tokenized once.  The ids go to the
shared folder; their counts over all documents give the ranks, so that frequent
tokens take one byte.  Of four ranks the lengths (1 to 4 bytes) share a control
byte, two bits each, the first in the low bits; control bytes and data bytes
are apart, and a table lookup by control byte gives the places of all data
bytes at once.

Defined results
* null doc_id: the row is left out.  Null or empty text: 0 tokens, no control and no data bytes.
* very long texts: whole; a unit of any length is one call of the tokenizer.
* ties of frequency: the lower token id has the lower rank.
* rows that repeat: each gives a row.
* one row without doc_id holds the vocabulary: its data are the token ids in rank order, 4 bytes each; it is there also
  for an empty table.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_CODERS: dict[int, object] = {}


def coder(ranks: bytes):
    """The tokenizer of a ranks file, made once in each process."""
    import tiktoken

    key = hash(ranks)
    if key not in _CODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _CODERS[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _CODERS[key]


def vocabulary_size(ranks: bytes) -> int:
    return max(int(line.split()[1]) for line in ranks.splitlines() if line.strip()) + 1


def tokenize(arr: pa.Array, enc) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a string column without nulls; as encode_ordinary gives for each whole text."""
    u = T.Units(arr)
    lists = [enc.encode_ordinary(x) for x in u.uniq.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    values = np.fromiter(chain.from_iterable(lists), np.uint32, int(off[-1]))
    at, o = T.expand(values, off, u.codes)
    return values[at], o[u.offsets]


_LEN = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_SUM = _LEN.sum(1)


def encode(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their offsets, data bytes, their offsets) of lists of numbers below 2^32."""
    values = values.astype(np.uint32)
    size = 1 + (values >= 1 << 8).astype(np.int64) + (values >= 1 << 16) + (values >= 1 << 24)
    n = np.diff(off)
    groups = (n + 3) // 4
    coff = np.concatenate([[0], np.cumsum(groups)])
    pos = T.within(off)
    slot = np.repeat(coff[:-1] * 4, n) + pos
    two = np.zeros(int(coff[-1]) * 4, np.uint8)
    two[slot] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    end = np.concatenate([[0], np.cumsum(size)])
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return control, coff, data, end[off]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of one list."""
    c = np.frombuffer(control, np.uint8)
    size = _LEN[c].reshape(-1)[:n]
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    quad = raw[start[:, None] + np.arange(4)]
    quad[np.arange(4) >= size[:, None]] = 0
    return np.ascontiguousarray(quad).view("<u4").reshape(-1)


def decode_ids(control: bytes, data: bytes, n: int, ids_by_rank: bytes) -> np.ndarray:
    """Token ids of one row of `binary_ids`, by the data of its vocabulary row."""
    return np.frombuffer(ids_by_rank, "<u4")[decode(control, data, n)]


def _tokens(ranks, wide: bool):
    def run(batches):
        enc = coder(ranks.value)
        for batch in batches:
            for piece in T.slices(batch):
                ids, off = tokenize(piece.column("text"), enc)
                w = 4 if wide else 2
                raw = ids.astype("<u4" if wide else "<u2").view(np.uint8)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), T.as_binary(raw, off * w)], ["doc_id", "ids"])

    return run


def _lists(batch: pa.RecordBatch, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("ids")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data).view("<u4" if wide else "<u2"), (off - off[0]) // (4 if wide else 2)


def binary_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, control, data): a row for each document, and one without doc_id for the vocabulary by rank; see the module for edge cases."""
    docs = T.documents(docs, "doc_id", "text")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    size = vocabulary_size(content)
    wide = size > 1 << 16
    ids = T.materialize(docs.mapInArrow(_tokens(spark.sparkContext.broadcast(content), wide), "doc_id bigint, ids binary"))

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            values, _ = _lists(batch, wide)
            total += np.bincount(values, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    total = T.add_up(ids.mapInArrow(count, "blob binary"), size, np.int64)
    by_rank = np.lexsort((np.arange(size), -total)).astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def write(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                values, off = _lists(part, wide)
                control, co, data, do = encode(shared.value[values], off)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(off)), T.as_binary(control, co), T.as_binary(data, do)], ["doc_id", "n_tokens", "control", "data"]
                )

    schema = "doc_id bigint, n_tokens bigint, control binary, data binary"
    head = spark.createDataFrame([(None, size, b"", by_rank.tobytes())], schema)
    return ids.mapInArrow(write, schema).unionByName(head)
