"""Secret scan: log-likelihood ratio of two character Markov models.

One model is of random strings (keys, tokens), the other of ordinary
identifiers; both are second-order chains over one alphabet, trained from
labelled samples.  The random ones come from a seeded generator of the usual
shapes of keys; the ordinary ones join words of a bounded sample of the corpus
the way identifiers, paths, numbers and dates are written.  Every run of at
least MIN_LENGTH token characters is scored; it is a finding when the ratio
exceeds the prior odds.  In a run that is none, the stretches of greatest sum are
findings when they exceed the prior odds for each of the places where they could
begin; they are widened to the letters and digits they are part of, and must exceed
them again as strings of their own.

Defined results
* null doc_id: the row is left out.  Null or empty text: no findings.
* very long texts and runs: whole.
* a token that occurs twice in a text gives two findings; rows that repeat each give theirs.
* ties: none can arise, findings are at distinct places of a row.
* empty table: no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

MIN_LENGTH = 16
LOG_ODDS = 9.2  # one run in ten thousand is a secret
TRAINING_ROWS, TRAINING_WORDS, TRAINING_STRINGS = 2000, 20_000, 20_000
SEED = 11

_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_CHARS.encode(), np.uint8)] = np.arange(1, len(_CHARS) + 1)
_K = len(_CHARS) + 1  # code 0: the border


def random_strings(n: int, seed: int = SEED) -> list[str]:
    """Labelled samples of the first class: keys in the usual alphabets and lengths."""
    g = np.random.default_rng(seed)
    hexa, b62, b64, b32 = "0123456789abcdef", _CHARS[:62], _CHARS[:62] + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    url64 = _CHARS[:62] + "-_"
    kinds = [(hexa, 32, ""), (hexa, 40, ""), (hexa, 64, ""), (b62, 20, ""), (b62, 36, ""), (b62, 48, ""), (b64, 40, ""), (b64, 43, "="), (url64, 43, ""), (b32, 20, ""), (b32, 16, ""), (hexa.upper(), 32, "")]
    out = []
    for k in g.integers(0, len(kinds), n):
        letters, size, end = kinds[k]
        out.append("".join(letters[i] for i in g.integers(0, len(letters), size)) + end)
    return out


def ordinary_strings(words: list[str], n: int, seed: int = SEED) -> list[str]:
    """Labelled samples of the second class: identifiers, paths, numbers and dates, and the words by themselves."""
    g = np.random.default_rng(seed + 1)
    words = words or ["value", "name", "index", "result", "data", "item", "count", "list", "user", "file"]
    out = []
    for kind in g.integers(0, 10, n):
        w = [words[i] for i in g.integers(0, len(words), g.integers(2, 6))]
        number = str(g.integers(0, 10 ** int(g.integers(1, 16))))
        out.append(
            "".join(w) if kind == 0 else "_".join(w) if kind == 1 else "-".join(w) if kind == 2 else "/".join(w)
            if kind == 3 else w[0] + "".join(x.capitalize() for x in w[1:]) if kind == 4 else "_".join(w).upper() if kind == 5
            else "_".join(w) + number if kind == 6 else number.zfill(int(g.integers(8, 20))) if kind == 7
            else f"{g.integers(1900, 2100)}-{g.integers(1, 13):02d}-{g.integers(1, 29):02d}" if kind == 8
            else w[0] + w[1] + w[0].capitalize()
        )
    # characters repeated for decoration
    out += [c * k for c in "-_=+/xX0" for k in range(2, 40)]
    return out


def chain(strings: list[str]) -> np.ndarray:
    """log p(c | two before), back-off by interpolation with the shorter contexts."""
    raw = _CODE[np.frombuffer(("\0\0" + "\0\0".join(strings) + "\0\0").encode("latin-1", "replace"), np.uint8)]
    three = np.bincount((raw[:-2] * _K + raw[1:-1]) * _K + raw[2:], minlength=_K**3).reshape(_K, _K, _K).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _K)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
    return np.log(p3)


def train(words: list[str], strings: int = TRAINING_STRINGS, seed: int = SEED) -> np.ndarray:
    """Table of log-likelihood ratios, random to ordinary, by three characters."""
    return (chain(random_strings(strings, seed)) - chain(ordinary_strings(words, strings, seed))).astype(np.float32)


def tokens(raw: np.ndarray, off: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of token characters, in bytes of the column; a run does not pass the end of its row."""
    ok = np.zeros(len(raw) + 2, np.int8)
    ok[1:-1] = _CODE[raw] > 0
    step = np.diff(ok)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = np.unique(inner[(ok[inner] == 1) & (ok[inner + 1] == 1)])  # a border of rows inside a run
    start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    keep = end - start >= least
    return start[keep], end[keep]


def ratios(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each character of the runs, and where each run begins among them."""
    n = end - start
    o = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start - o[:-1], n) + np.arange(o[-1])
    c, pos = _CODE[raw[at]], T.within(o)
    b = np.where(pos > 0, np.concatenate([[0], c[:-1]]), 0)
    a = np.where(pos > 1, np.concatenate([[0, 0], c[:-2]])[: len(c)], 0)
    return table[a, b, c].astype(np.float64), o


def score(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each run."""
    each, o = ratios(raw, start, end, table)
    return T.seg_sum(each, o) if len(each) else np.zeros(0)


def stretches(each: np.ndarray, limit: float) -> list[tuple[int, int, float]]:
    """(start, end, sum) of the stretch of greatest sum, and so on in what is left and right of it, as long as the sum exceeds the limit."""
    out, todo = [], [(0, len(each))]
    while todo:
        s, e = todo.pop()
        if np.maximum(each[s:e], 0).sum() <= limit:
            continue
        total = np.concatenate([[0], np.cumsum(each[s:e])])
        gain = total - np.minimum.accumulate(total)
        j = int(gain.argmax())
        if gain[j] > limit:
            i = int(total[: j + 1].argmin())
            out.append((s + i, s + j, float(gain[j])))
            todo += [(s, s + i), (s + j, e)]
    return out


def findings(raw: np.ndarray, off: np.ndarray, table: np.ndarray, least: int = MIN_LENGTH, log_odds: float = LOG_ODDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, score), in bytes of the column: the runs that look like a secret, and the stretches of the others that do."""
    start, end = tokens(raw, off, least)
    each, o = ratios(raw, start, end, table)
    llr = T.seg_sum(each, o)
    hit = llr > log_odds
    out = list(zip(start[hit].tolist(), end[hit].tolist(), llr[hit].tolist()))
    limit = log_odds + np.log(np.maximum(end - start, 1))
    for k in np.flatnonzero(~hit & (T.seg_sum(np.maximum(each, 0), o) > limit)).tolist():
        n, s = end[k] - start[k], start[k]
        code = _CODE[raw[s : end[k]]]
        sep = np.flatnonzero(code > 62)  # _-+/=
        found: list[tuple[int, int, float]] = []
        for i, j, v in sorted(stretches(each[o[k] : o[k + 1]], limit[k])):
            while i < j and code[i] == _K - 1:  # = before a value
                i += 1
            core = (i, j)
            if i < j and code[i] <= 62:
                p = np.searchsorted(sep, i)
                i = int(sep[p - 1]) + 1 if p else 0
            p = np.searchsorted(sep, j)
            if j and code[j - 1] <= 62:
                j = int(sep[p]) if p < len(sep) else int(n)
            while j < n and code[j] == _K - 1 and (j + 1 == n or code[j + 1] == _K - 1):  # padding
                j += 1
            # scored again as strings of their own; what was cut off as ordinary must be more than the odd beginning of a word
            by_itself = score(raw, s + np.array([i, core[0]]), s + np.array([j, core[1]]), table) if core[0] < core[1] else np.zeros(2)
            if by_itself[0] <= limit[k] and (by_itself[1] <= limit[k] or j - i - (core[1] - core[0]) < 4):
                continue
            if found and i < found[-1][1]:
                a, b, w = found.pop()
                i, j, v = min(i, a), max(j, b), max(v, w)
            found.append((i, j, v))
        out += [(int(s) + i, int(s) + j, v) for i, j, v in found if j - i >= least]
    out.sort()
    a, b, v = zip(*out) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(v, np.float64)


def training_words(docs: DataFrame, rows: int = TRAINING_ROWS, most: int = TRAINING_WORDS) -> list[str]:
    """Words of ASCII letters of a bounded sample of rows; of these the `most` with the least hash."""

    def run(batches):
        for batch in batches:
            for piece in T.slices(batch):
                u = T.Words(piece.column("text"), lower=False).uniq
                yield pa.RecordBatch.from_arrays([u.filter(pc.match_substring_regex(u, "^[A-Za-z]{2,14}$"))], ["w"])

    words = T.sampled(docs, rows).select("text").mapInArrow(run, "w string").distinct().withColumn("h", F.xxhash64("w"))
    return sorted(r["w"] for r in words.orderBy("h").limit(most).select("w").collect())


def secrets(docs: DataFrame, least: int = MIN_LENGTH, log_odds: float = LOG_ODDS, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, start, length, score): every run, or stretch of a run, that looks like a secret, in bytes of the UTF-8 text; see the module for edge cases."""
    docs = T.documents(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(train(training_words(docs, training_rows)))

    def run(batches):
        for batch in batches:
            for piece in T.slices(batch):
                raw, off = T.utf8_parts(piece.column("text"))
                start, end, llr = findings(raw, off, table.value, least, log_odds)
                row = np.searchsorted(off, start, "right") - 1
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(start - off[row]), pa.array(end - start), pa.array(np.round(llr, 3))], ["doc_id", "start", "length", "score"]
                )

    return docs.mapInArrow(run, "doc_id bigint, start bigint, length bigint, score double")
