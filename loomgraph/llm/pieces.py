"""SentencePiece encoding that keeps the offsets of the original bytes, and decoding.

1. Normalisation takes, at each place, the longest prefix that the compiled
   character map knows (a double-array trie, read from its bytes) and writes
   down, for every byte it puts out, the place in the original it came from.
2. Texts are cut before runs of spaces.  No piece of the vocabulary has a space
   after another character (this is checked), so the model never merges across
   a cut, and each distinct unit of a few megabytes is encoded once.
3. The lengths of the pieces give their places in the normalised unit, and the
   alignment projects these to the original text.

Pieces of the byte fallback follow the library: all but the last byte of a
character have an empty span at its start, and the last spans the character.

Defined results
* null doc_id: the row is kept, doc_id null.  Null or empty text: no pieces, round_trip true for an empty text and null for null.
* very long texts: whole.  A model whose pieces may cross a cut encodes each text whole.
* ties: the model's own rule (the leftmost merge of the best score).
* rows that repeat: each gives a row.
* empty table: no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHARMAP = "nfkc"  # the library's compiled map of this name; None: the model's own


class CharMap:
    """A compiled character map: the size of its trie, the trie's units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.blob = blob
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.text = blob[4 + size :] if blob else b""
        self.seen: dict[bytes, tuple[int, bytes | None]] = {}

    def longest(self, s: bytes, at: int) -> tuple[int, bytes | None]:
        """(length, replacement) of the longest known prefix of s[at:]; (0, None) without one."""
        t = self.trie
        if not t:
            return 0, None
        node, found, n = 0, -1, 0
        unit = t[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(s)):
            c = s[k]
            if c == 0:
                break
            node ^= c
            if node >= len(t):
                break
            unit = t[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found, n = t[node] & 0x7FFFFFFF, k + 1 - at
        if found < 0:
            return 0, None
        return n, self.text[found : self.text.index(b"\0", found)]

    def keys(self) -> list[tuple[bytes, bytes]]:
        """Every entry of the trie."""
        if not self.trie:
            return []
        t = np.array(self.trie, np.int64)
        below = (t >> 10) << ((t & 0x200) >> 6)
        bases, prefixes, out = below[:1], [b""], []
        while len(bases):  # a level of the trie at a time
            parent, c, node = [], [], []
            for s in range(0, len(bases), 2000):
                n = bases[s : s + 2000, None] ^ np.arange(256)
                hit = (n < len(t)) & (t[np.minimum(n, len(t) - 1)] & 0x800000FF == np.arange(256))
                hit[:, 0] = False
                i, j = np.nonzero(hit)
                parent.append(i + s)
                c.append(j)
                node.append(n[i, j])
            parent, c, node = (np.concatenate(x) for x in (parent, c, node))
            child = node ^ below[node]
            prefixes = [prefixes[p] + bytes([x]) for p, x in zip(parent.tolist(), c.tolist())]
            for key, ends, at in zip(prefixes, (t[node] >> 8 & 1).tolist(), (t[np.minimum(child, len(t) - 1)] & 0x7FFFFFFF).tolist()):
                if ends:
                    out.append((key, self.text[at : self.text.index(b"\0", at)]))
            bases = child
        return out

    def normalise(self, s: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and the end its place in s)."""
        out, place, at = bytearray(), [], 0
        while at < len(s):
            n, new = self.longest(s, at)
            if n == 0:
                c = s[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                new = s[at : at + n]
            out += new
            place += [at] * len(new)
            at += n
        return bytes(out), np.array([*place, len(s)], np.int32)


class Encoder:
    """A model with a character map; made once in each process."""

    def __init__(self, model: bytes, charmap: bytes | None, facts: tuple[bool, bool] | None = None):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        own = proto.normalizer_spec.precompiled_charsmap
        self.map = CharMap(own if charmap is None else charmap)
        self.dummy, self.squeeze = proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that escape white space and put it before words")
        # normalisation happens here, so the library's own is turned off
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        self.sp = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        names = [p.piece for p in proto.pieces]
        self.bytes_ = np.array([p.type == 6 for p in proto.pieces])
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == 2}
        self.surface = [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, self.bytes_)]
        self.length = np.array([len(x) for x in self.surface], np.int32)
        #: whether units can be encoded by themselves, and whether ASCII stays as it is; listing the map takes a second, so the driver passes this on
        self.facts = facts or self._facts(names, [p.type for p in proto.pieces])
        self.apart, self.plain = self.facts

    def _facts(self, names: list[str], types: list[int]) -> tuple[bool, bool]:
        entries = self.map.keys()
        apart = not any("▁" in n.lstrip("▁") for n in names) and 4 not in types
        # an entry may start with a space, but must not hold one further on; what ends in a space is never cut off (T.Units)
        apart = apart and not any(b" " in k.lstrip(b" ") for k, _ in entries)
        apart = apart and all(len(k) > 1 and (k[-2] == 0xC2 or (len(k) > 2 and k[-3] >= 0xE1)) for k, v in entries if v.endswith(b" ") or not v)
        return apart and not self.squeeze, not any(k.isascii() for k, _ in entries)

    def normalise(self, unit: str, first: bool) -> tuple[bytes, np.ndarray]:
        raw = unit.encode()
        if self.plain and raw.isascii():
            new, place = raw, np.arange(len(raw) + 1, dtype=np.int32)
        else:
            new, place = self.map.normalise(raw)
        if self.squeeze:
            b = np.frombuffer(new, np.uint8)
            keep = (b != 32) | (np.concatenate([[32], b[:-1]]) != 32)
            end = len(new.rstrip(b" "))
            keep[end:] = False
            new, place = bytes(b[keep]), np.append(place[:-1][keep], place[end])
        if first and self.dummy and new:
            new, place = b" " + new, np.concatenate([place[:1], place])
        return new, place

    def units(self, units: list[str], first: np.ndarray):
        """For each unit, lists in one array each: ids, begins, ends (offsets `off`), and whether decoding gives the unit again."""
        norm = [self.normalise(u, f) for u, f in zip(units, first.tolist())]
        ids = self.sp.encode([n[0].decode() for n in norm], num_threads=1)
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(off[-1]))
        size = self.length[flat].astype(np.int64)
        if self.unknown and np.isin(flat, list(self.unknown)).any():  # a model without byte fallback: the library tells the lengths
            for k in np.flatnonzero(np.add.reduceat(np.isin(flat, list(self.unknown)), off[:-1][np.diff(off) > 0])).tolist():
                k = np.flatnonzero(np.diff(off) > 0)[k]
                p = self.sp.encode(norm[k][0].decode(), return_type="proto")
                size[off[k] : off[k + 1]] = [len(x.surface.encode()) for x in p.pieces]
        end = np.cumsum(size)
        begin = end - size
        # places in all normalised units joined, with one more place for the end of each
        noff = np.concatenate([[0], np.cumsum([len(n[1]) for n in norm], dtype=np.int64)])
        shift = np.repeat(noff[:-1] - np.concatenate([[0], end])[off[:-1]], np.diff(off))
        begin, end = begin + shift, end + shift
        place = np.concatenate([n[1] for n in norm]) if norm else np.zeros(0, np.int32)
        raw = np.frombuffer(b"".join(n[0] + b" " for n in norm), np.uint8)
        if self.bytes_.any() and len(flat):
            fall = self.bytes_[flat]
            start = np.maximum.accumulate(np.where(~fall | ((raw[begin] & 0xC0) != 0x80), begin, 0))
            last = ~fall | ((raw[end] & 0xC0) != 0x80)
            begin = np.where(fall, start, begin)
            end = np.where(last, end, begin)
        original = [(" " + u if f and self.dummy and u else u).encode() for u, f in zip(units, first.tolist())]
        same = np.array([self.decode_bytes(i) == o for i, o in zip(ids, original)], bool)
        return flat, place[begin].astype(np.int64) if len(flat) else np.zeros(0, np.int64), place[end].astype(np.int64) if len(flat) else np.zeros(0, np.int64), off, same

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids) -> str:
        """The normalised text of the ids; the dummy prefix goes."""
        out = self.decode_bytes(ids)
        if self.dummy and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")

    def encode(self, arr: pa.Array):
        """(ids, begins, ends, offsets, round trip) of a string column without nulls."""
        if self.apart:
            u = T.Units(arr, "space")
            uniq, codes, row_off, starts = u.uniq, u.codes.astype(np.int64), u.offsets, u.starts[:-1] - np.repeat(u.bytes[:-1], np.diff(u.offsets))
        else:
            uniq, codes, row_off, starts = arr, np.arange(len(arr)), np.arange(len(arr) + 1), np.zeros(len(arr), np.int64)
        first = np.zeros(len(codes), np.int64)
        heads = row_off[:-1][np.diff(row_off) > 0]
        first[heads] = 1
        kinds, inverse = np.unique(codes * 2 + first, return_inverse=True)
        ids, begin, end, off, same = self.units(uniq.take(pa.array(kinds >> 1)).to_pylist(), (kinds & 1).astype(bool))
        at, o = T.expand(ids, off, inverse)
        shift = np.repeat(starts, np.diff(o))
        bad = np.concatenate([[0], np.cumsum(~same[inverse])])
        return ids[at], begin[at] + shift, end[at] + shift, o[row_off], bad[row_off[1:]] == bad[row_off[:-1]]


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: bytes, charmap: bytes | None, facts: tuple[bool, bool] | None = None) -> Encoder:
    key = hash((model, charmap))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, charmap, facts)
    return _ENCODERS[key]


def compiled(name: str | None) -> bytes | None:
    """The library's compiled character map of a name."""
    if name is None:
        return None
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sp.SentencePieceNormalizer(rule_name=name).serialized_model_proto())
    return proto.normalizer_spec.precompiled_charsmap


def encode_pieces(docs: DataFrame, model: str = MODEL, charmap: str | None = CHARMAP) -> DataFrame:
    """(doc_id, ids, begins, ends, round_trip): the pieces of every text with their spans of its UTF-8 bytes, and whether decoding them gives the text; see the module for edge cases."""
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    with open(model, "rb") as f:
        content, charmap = f.read(), compiled(charmap)
    shared = docs.sparkSession.sparkContext.broadcast((content, charmap, encoder(content, charmap).facts))

    def run(batches):
        e = encoder(*shared.value)
        for batch in batches:
            null, at = np.asarray(batch.column("text").is_null()), 0
            for piece in T.slices(batch, limit=2 << 20):  # Python objects of the distinct units of a slice are many times its size
                ids, begin, end, off, same = e.encode(piece.column("text"))
                gone = null[at : at + len(piece)]
                at += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(T.as_list(x.astype(np.int32), off, pa.int32()) for x in (ids, begin, end)), pa.array(same, mask=gone)],
                    ["doc_id", "ids", "begins", "ends", "round_trip"],
                )

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, round_trip boolean")


def decode_pieces(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text): the normalised text of the ids of each row; null ids give null."""
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        e = encoder(shared.value, b"")
        for batch in batches:
            text = [None if x is None else e.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
