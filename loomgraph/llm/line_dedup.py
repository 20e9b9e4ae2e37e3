"""Line dedup: exact set-similarity join of lines, later matches removed.

A line is the set of its lower-cased words; two lines match when the Jaccard
index of their sets is at least the threshold, and a line goes when any earlier
line matches it (earlier: lower doc_id, then lower line number), whether or not
that one goes too.

1. Word counts over the whole corpus, by hashed bucket, give the rarity order;
   the table has a fixed size (a parameter) and is broadcast.
2. Lines with equal sets fold into the earliest.  One shuffle, of hashes only.
3. Of a set of size n only the n - ceil(t n) + 1 rarest words can be the first
   that a pair shares.  Words that occur once in the corpus match nothing.  The
   rest meet by word; length, position and a 64-bit signature of the words
   bound the overlap before a pair is taken.  The lines of a word are tried as
   partners from the earliest on, and a line that has found LISTED of them is
   done: a group of copies takes work in proportion to its size.
4. Candidates are narrowed by sketches of 512 bits, in which words that one line
   has and the other lacks show as bits that differ.  Then the words of the lines
   in pairs are read again and the Jaccard index is computed exactly: for the earliest candidate of each line first, then for the
   others listed, and where none of them is a match and there may be more, for
   all later ones, which are searched for these lines alone.  Bitmaps tell which
   documents and words to read; they only save work, the joins after them decide.

Defined results
* null doc_id: left as it is.  Null or empty text and lines of white space: never matched, never removed.
* very long texts and lines: whole.
* ties: the earliest of the matching lines is named.
* rows that repeat a doc_id and its text are one document; rows that repeat a doc_id with another text are documents of
  their own, in the order of the hashes of their texts.
* a document that loses all its lines goes; one that had none stays.
* empty table: no rows.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from .ngram_join import need

THRESHOLD = 0.85
BUCKET_BITS = 23
LISTED = 8  # candidates of a line that are looked at before its other ones are searched for
_PART_BITS = 20
_LINE_BITS = 40  # of a line number; above them is the number of the text among those of its doc_id


def _counts(bits: int):
    """Occurrences of words by bucket, cut into ranges of 2^20 buckets."""

    def run(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for piece in T.slices(batch):
                w = T.Words(piece.column("text"))
                if len(w.codes):
                    n = np.bincount(w.codes, minlength=len(w.uniq)).astype(np.uint32)
                    np.add.at(total, (w.uniq_hash >> np.uint64(64 - bits)).astype(np.int64), n)
        at = np.flatnonzero(total)
        part = at >> _PART_BITS
        for p in np.unique(part):
            i = at[part == p]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([i.astype(np.uint32).tobytes()]), pa.array([total[i].tobytes()])], ["p", "at", "n"]
            )

    return run


def _levels(bits: int):
    """Sum of a range, as a byte on a logarithmic scale: 0 absent, 1 once."""
    width = 1 << min(bits, _PART_BITS)

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            total[np.frombuffer(at, np.uint32) & (width - 1)] += np.frombuffer(n, np.uint32)
        level = np.zeros(width, np.uint8)
        some = total > 0
        level[some] = np.minimum(255, 1 + np.ceil(6 * np.log2(total[some].astype(float)))).astype(np.uint8)
        return pa.table([pa.array([table.column("p")[0].as_py()], pa.int32()), pa.array([level.tobytes()])], names=["p", "levels"])

    return run


def rarity(docs: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.uint8)
    width = 1 << min(bits, _PART_BITS)
    parts = docs.select("text").mapInArrow(_counts(bits), "p int, at binary, n binary")
    for r in parts.groupBy("p").applyInArrow(_levels(bits), "p int, levels binary").collect():
        out[r["p"] * width : (r["p"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


def _sets(lines: pa.Array, level: np.ndarray | None = None, bits: int = 0):
    """Distinct words of each line: (hash, level, offsets), rarest first, or by hash without levels."""
    w = T.Words(lines)
    h = w.uniq_hash if len(w.uniq) else np.zeros(0, np.uint64)
    lv = level[(h >> np.uint64(64 - bits)).astype(np.int64)] if level is not None else np.zeros(len(h), np.uint8)
    order = np.lexsort((h, lv))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    key = np.repeat(np.arange(len(lines), dtype=np.int64) << 32, np.diff(w.offsets)) | rank[w.codes]
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    u = order[key & 0xFFFFFFFF]
    off = np.searchsorted(key >> 32, np.arange(len(lines) + 1))
    return h[u], lv[u], off


def _bits(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit signature of each set: a bit for each word, by its hash."""
    out = np.zeros(len(off) - 1, np.uint64)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.bitwise_or.reduceat(np.uint64(1) << (h >> np.uint64(58)), off[:-1][full])
    return out


def _take(values: np.ndarray, off: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values of the lists in another order."""
    n = np.diff(off)[order]
    o = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(off[:-1][order] - o[:-1], n) + np.arange(o[-1])]


_FIELDS = (("a", np.uint64), ("sig", np.uint64), ("doc", np.int64), ("line", np.int64), ("n", np.int32), ("m", np.int32), ("tok", np.uint64), ("pos", np.int32))


def _lines(threshold: float, blocks: int, bits: int, levels):
    """Every line that has words: its signature, size and the prefix words that occur more than once."""

    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            for piece in T.slices(batch):
                ids, number_from = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc_id", "variant"))
                lines, row, number = T.split_lines(piece.column("text"))
                number = number + (number_from[row] << _LINE_BITS)
                h, lv, off = _sets(lines, level, bits)
                n = np.diff(off)
                a, sig = T.seg_sum(T.mix(h + np.uint64(1)), off), _bits(h, off)
                prefix = np.where(n >= threshold * (n + 1) - 1e-9, n - need(threshold, n) + 1, 0)
                pos = T.within(off)
                keep = (pos < np.repeat(prefix, n)) & (lv > 1)
                m = np.add.reduceat(keep, off[:-1][n > 0]) if (n > 0).any() else np.zeros(0, int)
                some = np.flatnonzero(n > 0)
                a, sig, n = a[some], sig[some], n[some]
                tok_off = np.concatenate([[0], np.cumsum(m)])
                tok, pos = h[keep], pos[keep]
                block = (a % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cut = np.searchsorted(block[order], np.arange(blocks + 1))
                tok, pos = _take(tok, tok_off, order), _take(pos, tok_off, order)
                tcut = np.concatenate([[0], np.cumsum(np.asarray(m)[order])])[cut]
                cols = {"a": a[order], "sig": sig[order], "doc": ids[row[some]][order], "line": number[some][order], "n": n[order], "m": np.asarray(m)[order], "tok": tok, "pos": pos}
                there = np.flatnonzero(np.diff(cut)).tolist()
                if there:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(there, pa.int32())]
                        + [pa.array([T.planes((cols[k][tcut[p] : tcut[p + 1]] if k in ("tok", "pos") else cols[k][cut[p] : cut[p + 1]]).astype(t)) for p in there], pa.binary()) for k, t in _FIELDS],
                        ["p", *(k for k, _ in _FIELDS)],
                    )

    return run


def _fold(table: pa.Table) -> pa.Table:
    """Lines with equal sets point to the earliest; only that one keeps its words."""
    c = {k: T.from_planes(table.column(k), t) for k, t in _FIELDS}
    tok_off = np.concatenate([[0], np.cumsum(c["m"], dtype=np.int64)])
    order = np.lexsort((c["line"], c["doc"], c["n"], c["sig"], c["a"]))
    a, sig, n, doc, line = (c[k][order] for k in ("a", "sig", "n", "doc", "line"))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    same = np.zeros(len(a), bool)
    same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (line[1:] == line[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    keep = ~same
    m = np.where(new, c["m"][order], 0)
    # the words of heads only, in the new order
    src = np.where(new, order, 0)
    o = np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    at = np.repeat(tok_off[:-1][src] - o[:-1], m) + np.arange(o[-1])
    tok, pos = c["tok"][at].view(np.int64), c["pos"][at]
    mk = m[keep]
    ok = np.concatenate([[0], np.cumsum(mk, dtype=np.int64)])
    return pa.table(
        [
            pa.array(doc[keep]), pa.array(line[keep]), pa.array(doc[head][keep]), pa.array(line[head][keep]), pa.array(n[keep]),
            pa.array(np.where(mk > 0, sig[keep], 0).view(np.int64)),
            T.as_list(tok, ok, pa.int64()), T.as_list(pos, ok, pa.int32()),
        ],
        names=["doc_id", "line_no", "head_doc", "head_line", "n", "sig", "tok", "pos"],
    )


_POST = (("tok", np.uint64), ("doc", np.int64), ("line", np.int64), ("n", np.int32), ("pos", np.int32), ("sig", np.uint64))


def _postings(blocks: int, known=None):
    """The prefix words of lines by block; with a bitmap only words that it knows."""

    def run(batches):
        some = None if known is None else np.unpackbits(np.frombuffer(known.value, np.uint8)).astype(bool)
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("tok")
            off = lists.offsets.to_numpy().astype(np.int64)
            tok = lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
            p = batch.column("pos")
            po = p.offsets.to_numpy()
            m = np.diff(off)
            cols = {"tok": tok, "pos": p.values.to_numpy()[po[0] : po[-1]]}
            for k, src in (("doc", "doc_id"), ("line", "line_no"), ("n", "n"), ("sig", "sig")):
                cols[k] = np.repeat(batch.column(src).to_numpy(), m)
            if some is not None:
                hit = some[(T.mix(tok) >> np.uint64(64 - (len(some).bit_length() - 1))).astype(np.int64)]
                cols = {k: v[hit] for k, v in cols.items()}
                tok = cols["tok"]
            block = (T.mix(tok) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            there = np.flatnonzero(np.diff(cut)).tolist()
            if there:
                cols = {k: v[order] for k, v in cols.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there, pa.int32())] + [pa.array([T.planes(cols[k][cut[x] : cut[x + 1]].astype(t)) for x in there], pa.binary()) for k, t in _POST],
                    ["p", *(k for k, _ in _POST)],
                )

    return run


def _may_match(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Do sizes, positions of the word and signatures leave room for the overlap that the pairs need?"""
    n, pos, sig = c["n"], c["pos"], c["sig"]
    least = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9)
    ok = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    # words that one set has and the other lacks: at least the bits in which the signatures differ
    ok[at] = np.bitwise_count(sig[i] ^ sig[j]) <= n[i] + n[j] - 2 * least[at]
    return ok


def _block(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(columns, first, rank): postings by word and line, where the run of each one's word begins, and its place there."""
    c = {k: T.from_planes(table.column(k), t) for k, t in _POST}
    order = np.lexsort((c["line"], c["doc"], c["tok"]))
    c = {k: v[order] for k, v in c.items()}
    off = T.runs(c["tok"])
    first = np.repeat(off[:-1], np.diff(off))
    return c, first, np.arange(len(first)) - first


_PAIRS = "doc_a bigint, line_a bigint, doc_b bigint, line_b bigint"


def _earliest(threshold: float, listed: int = LISTED, width: int = 4_000_000):
    """The earliest candidates of each line among the lines of the block's words; `last` marks the last one of a line that may have more."""

    def run(table: pa.Table) -> pa.Table:
        c, first, rank = _block(table)
        count = np.zeros(len(first), np.int64)
        todo, at, step = np.flatnonzero(rank > 0), 0, 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):  # places at .. at + step of each run, for all lines further on that have found too few
            k = np.minimum(at + step, rank[todo]) - at
            total = np.concatenate([[0], np.cumsum(k)])
            s = 0
            while s < len(todo):
                e = max(s + 1, int(np.searchsorted(total, total[s] + width, "right")) - 1)
                o = total[s : e + 1] - total[s]
                i = np.repeat(todo[s:e], k[s:e])
                j = first[i] + at + T.within(o)
                ok = _may_match(c, i, j, threshold)
                nth = np.cumsum(ok) - np.repeat(np.concatenate([[0], np.cumsum(ok)])[o[:-1]], k[s:e])  # of the line's hits in this step
                ok &= count[i] + nth <= listed
                found.append((i[ok], j[ok]))
                count += np.bincount(i[ok], minlength=len(count))
                s = e
            todo = todo[(count[todo] < listed) & (rank[todo] > at + step)]
            at, step = at + step, min(2 * step, 256)
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        rows = pd.DataFrame({"doc_a": c["doc"][j], "line_a": c["line"][j], "doc_b": c["doc"][i], "line_b": c["line"][i], "i": i})
        rows["full"] = count[i] >= listed
        rows = rows.sort_values(["doc_b", "line_b", "doc_a", "line_a"])
        # a word's list that is full may go on after its last candidate
        last = rows[rows["full"]].groupby("i").tail(1)[["doc_a", "line_a", "doc_b", "line_b"]].drop_duplicates(["doc_b", "line_b"]).assign(last=True)
        rows = rows.drop_duplicates(["doc_a", "line_a", "doc_b", "line_b"])[["doc_a", "line_a", "doc_b", "line_b"]].merge(last, "left", ["doc_a", "line_a", "doc_b", "line_b"])
        rows["last"] = rows["last"].notna()
        return pa.Table.from_pandas(rows, preserve_index=False)

    return run


def _later(threshold: float, width: int = 4_000_000):
    """Of the open lines of the block all candidates after the one that was tried."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c, first, rank = _block(left)
        names = ["doc_a", "line_a", "doc_b", "line_b"]
        if not right.num_rows or not len(first):
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        open_ = right.to_pandas().drop_duplicates(["doc_b", "line_b"]).set_index(["doc_b", "line_b"])
        at = open_.index.get_indexer(pd.MultiIndex.from_arrays([c["doc"], c["line"]]))
        tried = [open_[k].to_numpy() for k in ("doc_a", "line_a")]
        todo = np.flatnonzero((at >= 0) & (rank > 0))
        found, s, total = [], 0, np.concatenate([[0], np.cumsum(rank[todo])])
        while s < len(todo):
            e = max(s + 1, int(np.searchsorted(total, total[s] + width, "right")) - 1)
            i = np.repeat(todo[s:e], rank[todo[s:e]])
            j = first[i] + T.within(total[s : e + 1] - total[s])
            da, la = (x[at[i]] for x in tried)
            ok = (c["doc"][j] > da) | ((c["doc"][j] == da) & (c["line"][j] > la))
            i, j = i[ok], j[ok]
            ok = _may_match(c, i, j, threshold)
            found.append(np.stack([c[k][x[ok]] for x in (j, i) for k in ("doc", "line")], 1))
            s = e
        pair = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        return pa.table([pa.array(pair[:, k]) for k in range(4)], names=names)

    return run


def _key(doc: np.ndarray, line) -> np.ndarray:
    return T.mix(T.mix(doc.astype(np.int64).view(np.uint64)) + np.asarray(line).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bitmap(keys: DataFrame, bits: int, hashes) -> np.ndarray:
    """Bits of `hashes(batch)` of all batches."""

    def run(batches):
        for b in batches:
            at = np.unique(hashes(b) >> np.uint64(64 - bits)).astype(np.uint32)
            part = at >> 16
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([T.planes((at[part == p] & 0xFFFF).astype(np.uint16))], pa.binary())], ["p", "at"])

    def fill(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, bool)
        out[T.from_planes(table.column("at"), np.uint16)] = True
        return pa.table([pa.array([table.column("p")[0].as_py()], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], names=["p", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in keys.mapInArrow(run, "p int, at binary").groupBy("p").applyInArrow(fill, "p int, bits binary").toLocalIterator():
        out[r["p"] << 13 : (r["p"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def _width(count: int) -> int:
    """Bits of a bitmap's places for so many keys, at most 2^27 (16 MB)."""
    bits = 16
    while (1 << bits) < 16 * count and bits < 27:
        bits += 1
    return bits


def _places(b) -> np.ndarray:
    """Hashes of (doc_id, 0) for documents and (doc_id, line + 1) for lines."""
    doc, line = b.column("doc_id").to_numpy(), b.column("line_no").to_numpy().astype(np.int64)
    return np.concatenate([_key(doc, np.zeros(len(doc), np.int64)), _key(doc, line + 1)])


def _known_lines(known):
    """Rows whose line the bitmap knows."""

    def run(batches):
        some = np.unpackbits(np.frombuffer(known.value, np.uint8)).astype(bool)
        shift = np.uint64(64 - (len(some).bit_length() - 1))
        for b in batches:
            yield b.filter(pa.array(some[(_key(b.column("doc_id").to_numpy(), b.column("line_no").to_numpy() + 1) >> shift).astype(np.int64)]))

    return run


def _words(b) -> np.ndarray:
    return T.mix(b.column("tok").to_numpy().view(np.uint64))


_SKETCH = [f"s{k}" for k in range(8)]


def _sketch(h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """512 bits of each set, a bit for each word, in eight integers."""
    bit = (T.mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(55)).astype(np.int64)
    out = np.zeros((len(off) - 1, 8), "<u8")
    for at in range(0, len(out), 8192):  # some lines side by side, a byte for each bit
        o = off[at : at + 8193]
        m = np.zeros((len(o) - 1, 512), bool)
        m.reshape(-1)[np.repeat(np.arange(len(m)) << 9, np.diff(o)) + bit[o[0] : o[-1]]] = True
        out[at : at + len(m)] = np.packbits(m, axis=1, bitorder="little").view("<u8")
    return [np.ascontiguousarray(out[:, k]).view(np.int64) for k in range(8)]


def _reread(bits: int, bitmap, sketch: bool = False):
    """Word sets of the lines that the bitmap knows, or their sizes and sketches."""

    def run(batches):
        known = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        shift = np.uint64(64 - bits)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = known[(_key(ids, np.zeros(len(ids), np.int64)) >> shift).astype(np.int64)]
            if not hit.any():
                continue
            for piece in T.slices(batch.filter(pa.array(hit))):
                ids, number_from = (piece.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc_id", "variant"))
                lines, row, number = T.split_lines(piece.column("text"))
                number = number + (number_from[row] << _LINE_BITS)
                hit = known[(_key(ids[row], number + 1) >> shift).astype(np.int64)]
                if not hit.any():
                    continue
                h, _, off = _sets(lines.filter(pa.array(hit)))
                if sketch:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row][hit]), pa.array(number[hit]), pa.array(np.diff(off).astype(np.int32)), *map(pa.array, _sketch(h, off))], ["doc_id", "line_no", "n", *_SKETCH]
                    )
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row][hit]), pa.array(number[hit]), T.as_list(h.view(np.int64), off, pa.int64())],
                    ["doc_id", "line_no", "words"],
                )

    return run


def _read_again(docs: DataFrame, pairs: DataFrame, sketch: bool) -> DataFrame:
    """The lines of the pairs, with their words or with their sketches."""
    sides = pairs.select(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line_no")).union(pairs.select("doc_b", "line_b"))
    mask = _width(4 * pairs.count())
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(sides, mask, _places).tobytes())
    more = "n int, " + ", ".join(f"{k} bigint" for k in _SKETCH) if sketch else "words array<bigint>"
    return docs.mapInArrow(_reread(mask, known, sketch), f"doc_id bigint, line_no bigint, {more}")


def _narrowed(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches leave room for the overlap they need."""
    lines = _read_again(docs, pairs, True)
    a = lines.toDF("doc_a", "line_a", "n_a", *[f"{k}_a" for k in _SKETCH])
    b = lines.toDF("doc_b", "line_b", "n_b", *[f"{k}_b" for k in _SKETCH])
    both = pairs.join(a, ["doc_a", "line_a"]).join(b, ["doc_b", "line_b"])
    differ = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in _SKETCH), F.lit(0))
    size = F.col("n_a") + F.col("n_b")
    return both.where(differ <= size - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * size - 1e-9)).select("doc_a", "line_a", "doc_b", "line_b")


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(head_doc, head_line, e): of each later line the earliest line of its pairs that matches it, by the Jaccard index of the words themselves."""
    sets = _read_again(docs, pairs, False)
    a = sets.select(F.col("doc_id").alias("doc_a"), F.col("line_no").alias("line_a"), F.col("words").alias("words_a"))
    b = sets.select(F.col("doc_id").alias("doc_b"), F.col("line_no").alias("line_b"), F.col("words").alias("words_b"))
    both = pairs.join(a, ["doc_a", "line_a"]).join(b, ["doc_b", "line_b"])
    o = F.size(F.array_intersect("words_a", "words_b"))
    good = both.where(o >= F.lit(threshold) * (F.size("words_a") + F.size("words_b") - o) - 1e-9)
    return good.groupBy(F.col("doc_b").alias("head_doc"), F.col("line_b").alias("head_line")).agg(F.min(F.struct("doc_a", "line_a")).alias("e"))


def variants(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` (doc_id, text) with the number of the text among those of its doc_id, 0 where there is one; and (doc_id, h, variant) where there are several."""
    twice = T.materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():  # no text is read
        none = F.lit(0).cast("bigint")
        return docs.withColumn("variant", none), twice.select("doc_id", none.alias("h"), none.alias("variant"))
    keyed = T.materialize(docs.select("doc_id", F.xxhash64("text").alias("h")).join(twice, "doc_id", "left_semi").distinct())
    texts = T.materialize(keyed.join(keyed.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi"))
    texts = texts.withColumn("variant", (F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).cast("bigint"))
    if not texts.limit(1).count():
        return docs.withColumn("variant", F.lit(0).cast("bigint")), texts
    both = docs.withColumn("h", F.xxhash64("text")).join(texts, ["doc_id", "h"], "left")
    return both.select("doc_id", "text", F.coalesce("variant", F.lit(0)).alias("variant")), texts


def _matches(docs: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(doc_id, line, kept_doc_id, kept_line) of `variants`; lines are numbered with them."""
    sc = docs.sparkSession.sparkContext
    count = docs.count()
    blocks = 16
    while blocks * 8000 < count:
        blocks *= 2
    levels = sc.broadcast(rarity(docs, bits).tobytes())
    blobs = ", ".join(f"{k} binary" for k, _ in _FIELDS)
    lines = docs.mapInArrow(_lines(threshold, blocks, bits, levels), f"p int, {blobs}")
    lines = T.materialize(
        lines.groupBy("p").applyInArrow(_fold, "doc_id bigint, line_no bigint, head_doc bigint, head_line bigint, n int, sig bigint, tok array<bigint>, pos array<int>")
    )
    heads = lines.where(F.size("tok") > 0).select("doc_id", "line_no", "n", "sig", "tok", "pos")
    post_schema = "p int, " + ", ".join(f"{k} binary" for k, _ in _POST)
    found = heads.mapInArrow(_postings(blocks), post_schema).groupBy("p").applyInArrow(_earliest(threshold, LISTED), f"{_PAIRS}, last boolean")
    pair = F.struct("doc_a", "line_a")
    lists = found.groupBy("doc_b", "line_b").agg(F.array_sort(F.collect_set(pair)).alias("c"), F.min(F.when(F.col("last"), pair)).alias("cut"))
    # in the order of all candidates as far as the first list that may go on
    lists = T.materialize(lists.withColumn("c", F.when(F.col("cut").isNull(), F.col("c")).otherwise(F.filter("c", lambda x: x <= F.col("cut")))))
    every = T.materialize(lists.select("doc_b", "line_b", F.explode("c").alias("x")).select("x.doc_a", "x.line_a", "doc_b", "line_b"))
    good = _narrowed(docs, every, threshold).groupBy("doc_b", "line_b").agg(F.array_sort(F.collect_set(pair)).alias("c"))
    lists = T.materialize(lists.select("doc_b", "line_b", "cut").join(good, ["doc_b", "line_b"], "left").where("c IS NOT NULL OR cut IS NOT NULL"))
    guess = lists.where("c IS NOT NULL").select(F.col("c")[0]["doc_a"].alias("doc_a"), F.col("c")[0]["line_a"].alias("line_a"), "doc_b", "line_b")
    first = T.materialize(_verified(docs, guess, threshold))
    same = (F.col("doc_b") == F.col("head_doc")) & (F.col("line_b") == F.col("head_line"))
    # the earliest candidate is nearly always a match; where it is none, the others are looked at
    left = T.materialize(lists.where((F.size("c") > 1) | F.col("cut").isNotNull()).join(first, same, "left_anti"))
    rest = left.where(F.size("c") > 1).select("doc_b", "line_b", F.explode(F.slice("c", 2, F.size("c"))).alias("x")).select("x.doc_a", "x.line_a", "doc_b", "line_b")
    if rest.limit(1).count():
        first = T.materialize(first.unionByName(_verified(docs, T.materialize(rest), threshold)))
    open_ = T.materialize(left.where("cut IS NOT NULL").join(first, same, "left_anti").select("cut.doc_a", "cut.line_a", "doc_b", "line_b"))
    n_open = open_.count()
    if n_open:
        lines_known = sc.broadcast(_bitmap(open_.select(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line_no")), _width(2 * n_open), _places).tobytes())
        own = heads.select("doc_id", "line_no", "tok").mapInArrow(_known_lines(lines_known), "doc_id bigint, line_no bigint, tok array<bigint>")
        own = own.join(open_.withColumnsRenamed({"doc_b": "doc_id", "line_b": "line_no"}), ["doc_id", "line_no"])
        own = T.materialize(own.select("doc_a", "line_a", F.col("doc_id").alias("doc_b"), F.col("line_no").alias("line_b"), F.explode("tok").alias("tok")))
        known = sc.broadcast(_bitmap(own.select("tok"), _width(8 * n_open), _words).tobytes())

        def by_block(batches):
            for b in batches:
                p = (_words(b) % np.uint64(blocks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(p), *b.columns[:4]], ["p", "doc_a", "line_a", "doc_b", "line_b"])

        asked = own.mapInArrow(by_block, f"p int, {_PAIRS}").distinct().groupBy("p")
        more = heads.mapInArrow(_postings(blocks, known), post_schema).groupBy("p").cogroup(asked).applyInArrow(_later(threshold), _PAIRS)
        more = T.materialize(more.distinct())
        if more.count() > count:  # sketches take one more reading of all documents, which pays where pairs are many
            more = T.materialize(_narrowed(docs, more, threshold))
        first = T.materialize(first.unionByName(_verified(docs, more, threshold)))
    is_head = (F.col("doc_id") == F.col("head_doc")) & (F.col("line_no") == F.col("head_line"))
    copies = lines.where(~is_head).select("doc_id", "line_no", "head_doc", "head_line").join(first, ["head_doc", "head_line"], "left")
    out = copies.select("doc_id", "line_no", "head_doc", "head_line", "e").unionByName(
        first.select(F.col("head_doc").alias("doc_id"), F.col("head_line").alias("line_no"), "head_doc", "head_line", "e")
    )
    return out.select(
        "doc_id", F.col("line_no").alias("line"), F.coalesce("e.doc_a", "head_doc").alias("kept_doc_id"), F.coalesce("e.line_a", "head_line").alias("kept_line")
    )


_NUMBER = (1 << _LINE_BITS) - 1


def matching_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no): every line that an earlier line matches, and the earliest such line."""
    out = _matches(variants(T.documents(docs, "doc_id", "text"))[0], threshold, bits)
    number = lambda c: F.col(c).bitwiseAND(F.lit(_NUMBER))
    return out.select("doc_id", number("line").alias("line_no"), "kept_doc_id", number("kept_line").alias("kept_line_no"))


def drop_matching_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """`docs` without the lines that an earlier line matches, n_chars brought up to date; a document that loses all its lines goes.

    Rows without a doc_id, text or words stay as they are; an empty table gives an empty one.  Columns are those of `docs`, whatever
    their names.
    """
    own, texts = variants(T.documents(docs, "doc_id", "text"))
    gone = _matches(own, threshold, bits).select("doc_id", F.shiftright("line", _LINE_BITS).alias("variant"), F.col("line").bitwiseAND(F.lit(_NUMBER)).cast("int").alias("line"))
    gone = gone.groupBy("doc_id", "variant").agg(F.collect_set("line").alias("gone")).join(texts, ["doc_id", "variant"], "left")
    i, h, g = (T.fresh(docs, k) for k in ("id", "h", "gone"))
    gone = gone.select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    same = (docs["doc_id"] == F.col(i)) & (F.col(h).isNull() | (F.xxhash64(docs["text"]) == F.col(h)))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g)), lambda k: F.get(lines, k))
    both = docs.join(gone.hint("shuffle_hash"), same, "left")
    both = both.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    both = both.where(F.col(g).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
