"""Language spans of mixed texts: script ranges narrow the candidates, Viterbi labels the words.

Each language of the table's `lang` column has a naive-Bayes model of hashed
byte n-grams (2 to 4) of words, trained on a bounded sample of rows, and a set
of scripts that its words use.  A distinct word is scored once per slice: its
scripts rule out the languages that do not use them, the n-grams score the
rest, and `und` (equal chance for every n-gram) stands for none of them.  The
best labelling of a text's words, with a penalty for each switch, is found
exactly: texts are cut into segments whose transfer matrices (max, +) are
computed side by side and then chained, so a long text costs no more per word.

Defined results
* null doc_id: kept, doc_id null.  Null or empty text, or no letters: lang `und`, share 0, no spans for no words.
* very long texts: whole.
* ties: the label of the word before goes on; else the first of the languages in alphabetical order, `und` last.
* rows that repeat: each is labelled.
* empty table, or no known language: all rows (if any) are `und`.
* Other columns are not read by the query; the filter passes them through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

TRAINING_ROWS = 4000
BITS = 16
SWITCH = 8.0
CLIP = 6.0
MIN_SHARE = 0.5
_SEGMENT = 64
_WORD_BYTES = 1 << 17  # of words whose n-grams are listed at a time: each takes some hundred bytes

#: first code point of each range, and its script's bit; 0: common to all
_RANGES = [
    (0x0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xC0, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6),
    (0x700, 7), (0x900, 8), (0x980, 9), (0xE00, 10), (0xE80, 11), (0x10A0, 12), (0x1100, 13), (0x1200, 14), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x2E80, 15), (0x3000, 0), (0x3040, 16), (0x3100, 15), (0x3130, 13), (0x3190, 15), (0xAC00, 13), (0xD7B0, 11), (0xF900, 15), (0xFB00, 1), (0xFB1D, 5),
    (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 16), (0xFFA0, 13), (0xFFE0, 0), (0x20000, 15), (0x32000, 0),
]
_FROM = np.array([a for a, _ in _RANGES])
_BIT = np.array([0 if b == 0 else 1 << b for _, b in _RANGES], np.int64)
SCRIPTS = 17

_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def scripts(words: pa.Array) -> np.ndarray:
    """Bit set of the scripts of each word."""
    raw, off = T.utf8_parts(words)
    if not len(raw):
        return np.zeros(len(words), np.int64)
    pad = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = pad[lead]
    one, two, three = pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
    cp = np.where(b < 0x80, b, np.where(b < 0xE0, (b & 31) << 6 | one, np.where(b < 0xF0, (b & 15) << 12 | one << 6 | two, (b & 7) << 18 | one << 12 | two << 6 | three)))
    bit = _BIT[np.searchsorted(_FROM, cp, "right") - 1]
    at = np.searchsorted(lead, off)
    out = np.zeros(len(words), np.int64)
    some = at[1:] > at[:-1]
    out[some] = np.bitwise_or.reduceat(bit, at[:-1][some])
    return out


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the byte n-grams of the letter runs, lower-cased, with their borders."""
    raw, off = T.utf8_parts(pc.utf8_lower(words))
    n = np.diff(off)
    o = np.concatenate([[0], np.cumsum(n + 2)])
    b = np.zeros(o[-1] + 4, np.uint64)
    b[np.arange(len(raw)) + np.repeat(o[:-1] + 1 - off[:-1], n)] = _LETTER[raw]
    word = np.repeat(np.arange(len(n)), n + 2)
    letter = b > 0
    at = np.arange(o[-1])
    end = np.repeat(o[1:], n + 2)
    buckets, owners = [], []
    for k, inner in ((2, None), (3, (1,)), (4, (1, 2))):
        ok = at + k <= end
        ok &= (letter[:-4] | letter[1:-3]) if inner is None else letter[1:-3] if k == 3 else letter[1:-3] & letter[2:-2]
        p = at[ok]
        h = b[p] + b[p + 1] * np.uint64(257)
        for j in range(2, k):
            h = h * np.uint64(1000003) + b[p + j]
        buckets.append((T.mix(h * np.uint64(7) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[p])
    return np.concatenate(buckets), np.concatenate(owners)


def parts(words: pa.Array, limit: int = _WORD_BYTES):
    """(first, words): stretches of about `limit` bytes."""
    for at, end in T.stretches(T.utf8_parts(words)[1], limit):
        yield at, words.slice(at, end - at)


class Model:
    """log p(bucket | language), the scripts of each language, and their names; `und` is the last label."""

    def __init__(self, names: list[str], counts: np.ndarray, script_counts: np.ndarray):
        self.names = [*names, "und"]
        v = 1 << BITS
        p = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * v)
        self.log = np.ascontiguousarray((np.log(p) + np.log(v)).T).astype(np.float32) / 3  # relative to equal chance; a character is in about three n-grams
        used = script_counts >= 0.01 * np.maximum(1, script_counts.sum(1, keepdims=True))
        self.uses = (used * (1 << np.arange(SCRIPTS))).sum(1).astype(np.int64)

    def scores(self, words: pa.Array) -> np.ndarray:
        """Score of each label for each word, the best at most CLIP above the next; all zero for a word without letters."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        for at, some in parts(words):
            out[at : at + len(some)] = self._scores(some)
        return out

    def _scores(self, words: pa.Array) -> np.ndarray:
        k = len(self.names)
        out = np.zeros((len(words), k), np.float32)
        bucket, owner = grams(words)
        if k > 1 and len(bucket):
            order = np.argsort(owner, kind="stable")
            off = np.searchsorted(owner[order], np.arange(len(words) + 1))
            out[:, :-1] = T.seg_sum(self.log[bucket[order]], off)
        s = scripts(words)
        out[:, :-1][(s[:, None] & ~self.uses[None]) != 0] = -1e4
        out = np.maximum(out - out.max(1, keepdims=True), -CLIP)
        out[s == 0] = 0
        return out


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on about `rows` rows of each language, chosen by a hash of doc_id."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    n = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(n)
    if not names:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, SCRIPTS)))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(min(1.0, rows / n[k]) * (1 << 30))))])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")
    place, width = {k: i for i, k in enumerate(names)}, (1 << BITS) + SCRIPTS

    def count(batches):
        total = np.zeros((len(names), width), np.float32)
        for batch in batches:
            for piece in T.slices(batch):
                for lang in piece.column("lang").unique().to_pylist():
                    w = T.Words(piece.filter(pc.equal(piece.column("lang"), lang)).column("text"), lower=False)
                    if not len(w.codes):
                        continue
                    times = np.bincount(w.codes, minlength=len(w.uniq))
                    own = np.zeros(width)
                    for at, some in parts(w.uniq):
                        bucket, owner = grams(some)
                        s, n = scripts(some), times[at : at + len(some)]
                        own[: 1 << BITS] += np.bincount(bucket, n[owner], minlength=1 << BITS)
                        own[1 << BITS :] += [n[(s >> i & 1) == 1].sum() for i in range(SCRIPTS)]
                    total[place[lang]] += own
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    total = T.add_up(picked.coalesce(16).mapInArrow(count, "blob binary"), len(names) * width, np.float32).reshape(len(names), width).astype(float)
    return Model(names, total[:, : 1 << BITS], total[:, 1 << BITS :])


def viterbi(score: np.ndarray, off: np.ndarray, switch: float = SWITCH, limit: int = 1 << 24) -> np.ndarray:
    """Best labels of the words of each text: the sum of scores less `switch` for every change.  `limit` bounds what is held at a time."""
    k = score.shape[1]
    segs = np.concatenate([[0], np.cumsum((np.diff(off) + _SEGMENT - 1) // _SEGMENT)])
    most = max(1, limit // (k * max(k, _SEGMENT)))
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(off) - 1:  # whole texts, as many as fit
        end = max(at + 1, int(np.searchsorted(segs, segs[at] + most, "right")) - 1)
        out.append(_viterbi(score[off[at] : off[end]], off[at : end + 1] - off[at], np.float32(switch), most))
        at = end
    return np.concatenate(out)


def _viterbi(score: np.ndarray, off: np.ndarray, switch: np.float32, most: int) -> np.ndarray:
    """Segments side by side, about `most` at a time."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(off)
    segs = (size + _SEGMENT - 1) // _SEGMENT
    so = np.concatenate([[0], np.cumsum(segs)])
    number = T.within(so)
    start = np.repeat(off[:-1], segs) + number * _SEGMENT
    length = np.minimum(_SEGMENT, np.repeat(off[1:], segs) - start)
    last = int(segs.max())
    with_number = lambda i: so[:-1][segs > i] + i
    groups, i = [], 0
    while i < last:  # segments i .. j - 1 of all texts
        j, total = i + 1, len(with_number(i))
        while j < last and total + (more := int((segs > j).sum())) <= most:
            j, total = j + 1, total + more
        groups.append((i, j))
        i = j

    def of_group(i, j):
        own = np.flatnonzero((number >= i) & (number < j)) if (i, j) != (0, last) else np.arange(len(number))
        own = own[np.argsort(-length[own], kind="stable")]
        place = np.full(len(number), -1)
        place[own] = np.arange(len(own))
        return own, place, [int(np.searchsorted(-length[own], -t, "left")) for t in range(int(length[own[0]]))]  # segments longer than t

    v = np.zeros((len(start), k), np.float32)  # scores before the first word of each segment
    if last > 1:  # transfer matrices: best score from each entry label to each exit label
        for i, j in groups:
            own, place, active = of_group(i, j)
            m = np.full((len(own), k, k), -1e9, np.float32)
            m[:, np.arange(k), np.arange(k)] = 0
            for t, a in enumerate(active):
                x = m[:a]
                m[:a] = np.maximum(x, x.max(2, keepdims=True) - switch) + score[start[own[:a]] + t][:, None, :]
            for p in range(i, min(j, last - 1)):
                here = with_number(p + 1)
                x = (v[here - 1][:, :, None] + m[place[here - 1]]).max(1)
                v[here] = x - x.max(1, keepdims=True)
    kind = np.int16 if k < 1 << 15 else np.int32
    labels = np.arange(k, dtype=kind)
    out, leave = np.empty(n, kind), np.full(len(start), -1, np.int64)
    for i, j in reversed(groups):
        own, place, active = of_group(i, j)
        x, first = v[own], np.concatenate([[0], np.cumsum(length[own])])
        back = np.zeros((first[-1], k), kind)
        for t, a in enumerate(active):
            y = x[:a]
            best, other = y.argmax(1), y.max(1, keepdims=True) - switch
            back[first[:a] + t] = np.where(y >= other, labels, best[:, None].astype(kind))
            x[:a] = np.maximum(y, other) + score[start[own[:a]] + t]
        leave[own] = np.where(leave[own] < 0, x.argmax(1), leave[own])  # but for those that a segment follows
        if last > 1:
            entry = np.tile(labels, (len(own), 1))  # for each label at the end of a segment, the label before its first word
            for t in range(len(active) - 1, -1, -1):
                a = active[t]
                entry[:a] = np.take_along_axis(back[first[:a] + t], entry[:a].astype(np.int64), 1)
            for p in range(j - 1, max(i, 1) - 1, -1):
                here = with_number(p)
                leave[here - 1] = entry[place[here], leave[here]]
        state = leave[own]
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            out[start[own[:a]] + t] = state[:a]
            state[:a] = back[first[:a] + t, state[:a]]
    return out.astype(np.int64)


def label(text: pa.Array, model: Model, switch: float = SWITCH):
    """(word offsets, label of each word, whether it has letters) of a string column without nulls."""
    w = T.Words(text, lower=False)
    if not len(w.codes):
        return w.offsets, np.zeros(0, np.int64), np.zeros(0, bool)
    letters = np.concatenate([scripts(some) != 0 for _, some in parts(w.uniq)])[w.codes]
    lab = viterbi(model.scores(w.uniq)[w.codes], w.offsets, switch)
    none = T.seg_sum(letters.astype(np.int64), w.offsets) == 0
    lab[np.repeat(none, np.diff(w.offsets))] = len(model.names) - 1
    return w.offsets, lab, letters


def summary(off: np.ndarray, lab: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(main label, its share of the words with letters, share of any known language) of each text."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    count = np.bincount(row[letters] * k + lab[letters], minlength=rows * k).reshape(rows, k)
    total = np.maximum(1, count.sum(1))
    main = np.where(count.sum(1) > 0, count.argmax(1), k - 1)
    return main, count.max(1) / total, count[:, :-1].sum(1) / total


SCHEMA = "doc_id bigint, lang string, share double, known double, spans array<struct<lang: string, first: int, words: int>>"


def languages(docs: DataFrame, training_rows: int = TRAINING_ROWS, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang, share, known, spans): each document's main language, its share and that of all known languages among the words with letters, and the spans of words of one language; see the module for edge cases."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, training_rows))
    docs = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])

    def run(batches):
        m = model.value
        names = pa.array(m.names)
        for batch in batches:
            for piece in T.slices(batch):
                off, lab, letters = label(piece.column("text"), m, switch)
                main, share, known = summary(off, lab, letters, len(m.names))
                new = np.ones(len(lab), bool)
                new[1:] = lab[1:] != lab[:-1]
                new[off[:-1][np.diff(off) > 0]] = True
                at = np.flatnonzero(new)
                row = np.searchsorted(off, at, "right") - 1
                size = np.diff(np.append(at, len(lab)))
                spans = pa.StructArray.from_arrays(
                    [names.take(pa.array(lab[at])), pa.array((at - off[row]).astype(np.int32)), pa.array(size.astype(np.int32))], ["lang", "first", "words"]
                )
                so = np.searchsorted(at, off)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), names.take(pa.array(main)), pa.array(np.round(share, 6)), pa.array(np.round(known, 6)), pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), spans)],
                    ["doc_id", "lang", "share", "known", "spans"],
                )

    return docs.mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, least: float = MIN_SHARE, training_rows: int = TRAINING_ROWS, switch: float = SWITCH) -> DataFrame:
    """The rows of which at least the share `least` of the words with letters are in known languages; null and empty texts and texts without letters go.

    Rows are judged one by one, whatever their doc_id (null too), so rows that repeat stay or go together.  Without any known language no
    row stays; an empty table gives an empty one.  Other columns pass through.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, training_rows))

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            keep = []
            for piece in T.slices(batch.select([i])):
                off, lab, letters = label(piece.column("text"), model.value, switch)
                _, _, known = summary(off, lab, letters, len(model.value.names))
                keep.append((known >= least) & (known > 0))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
