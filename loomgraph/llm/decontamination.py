"""Benchmark decontamination: windows of a document within a small edit distance of a benchmark item.

Texts are words, lower-cased and without punctuation; the edit distance counts
words put in, left out or changed.  A window of the size of an item matches when
its distance is at most floor(0.2 n).

1. Words and word pairs of the items are known by hash.  An edit destroys at most
   two pairs of neighbours, so a window with fewer than n - 1 - 2 d known pairs
   cannot match (n - d known words, where that is nothing); this loses nothing.
2. Windows that are left are embedded: a random walk (CGK) reads a word and
   steps on or not, by a hash of step and word, so that equal stretches meet
   again after an edit and edit distance becomes Hamming distance.  Bits of the
   embedding are sampled; windows and items whose samples agree are candidates.
   This is repeated as often as simulated edits of items of like size show to be
   needed for the target recall; sizes for which MOST_REPETITIONS do not reach it
   are compared with all the windows that are left.
3. Candidates, and the windows up to d words away, are compared exactly.

The items are broadcast a bounded part at a time; a larger benchmark takes more
passes.

Defined results
* null doc_id or item_id, null or empty text, no words: no matches.
* fewer words than an item: the text is the window if no more than d are missing; so are windows at the end of a text.
* very long texts and items: whole; candidates are verified within a band as wide as the distance allowed.
* ties: the first of the windows at the least distance.
* rows that repeat a doc_id: one result of the least distance (the first window) for each item.
* items of fewer than five words match exactly only.
* empty tables: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

RATE = 0.2
RECALL = 0.95
SAMPLES = 3
MOST_REPETITIONS = 512
TRIALS = 60  # edited copies of items of like size
ITEM_WORDS = 4_000_000  # of the items broadcast at a time
_PAD = np.uint64(0x5AD5AD5AD5AD5AD5)


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets) of the words of each text, without punctuation."""
    w = T.Words(text, lower=False)
    if not len(w.codes):
        return np.zeros(0, np.uint64), w.offsets
    plain = pc.replace_substring_regex(pc.utf8_lower(w.uniq), r"[^\p{L}\p{M}\p{N}]+", "")
    empty = np.diff(T.utf8_parts(plain)[1]) == 0
    keep = ~empty[w.codes]
    n = np.concatenate([[0], np.cumsum(keep)])
    return T.hash_strings(plain)[w.codes[keep]], n[w.offsets]


def pair_hash(h: np.ndarray) -> np.ndarray:
    return T.mix(h[:-1] * np.uint64(3) + T.mix(h[1:]))


def distances(n: np.ndarray, rate: float) -> np.ndarray:
    return np.floor(rate * n + 1e-9).astype(np.int64)


def edit_distance(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of the rows of a (lengths na) and b (lengths nb), side by side; right where at most `most`, else more than that."""
    far = np.int32(1 << 20)
    band = np.arange(-most, most + 1, dtype=np.int32)
    d = np.tile(np.where(band >= 0, band, far), (len(a), 1)).astype(np.int32)
    width = int(na.max()) if len(na) else 0
    b = np.pad(b, ((0, 0), (most, most + max(0, width - b.shape[1]))), constant_values=_PAD)
    out = np.full(len(a), far, np.int64)
    for i in range(1, width + 1):
        new = d + (a[:, i - 1 : i] != b[:, i - 1 : i + 2 * most])
        np.minimum(new[:, :-1], d[:, 1:] + 1, out=new[:, :-1])
        if i <= most:
            new[:, : most - i] = far
            new[:, most - i] = i
        d = np.minimum.accumulate(new - band, axis=1) + band  # words put in, left to right
        done = np.flatnonzero((na == i) & (abs(nb - i) <= most))
        out[done] = d[done, most + nb[done] - i]
    return out


def sample_places(n: int, seed: int, samples: int = SAMPLES) -> np.ndarray:
    """The places of the embedding that repetition `seed` reads for items of n words."""
    return np.sort(np.random.default_rng([seed, n]).integers(0, max(1, 2 * n), samples))


def embed(h: np.ndarray, start: np.ndarray, size: np.ndarray, places: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Sampled places (rows, ascending) of the CGK embeddings of the windows h[start : start + size], as one hash each; all walk side by side."""
    at = np.zeros(len(start), np.int64)
    key = seed.astype(np.uint64)
    salt = key * np.uint64(1_000_003)
    for j in range(int(places.max()) + 1 if len(start) else 0):
        sym = np.where(at < size, h[np.minimum(start + at, len(h) - 1)], _PAD)
        for c in range(places.shape[1]):
            hit = np.flatnonzero(places[:, c] == j)
            if len(hit):
                key[hit] = T.mix(key[hit] * np.uint64(31) + sym[hit])
        at += (T.mix(sym + (salt + np.uint64(j)) * np.uint64(2) + np.uint64(1)) >> np.uint64(63)).astype(np.int64)
    return key


def edited(h: np.ndarray, d: int, g: np.random.Generator) -> np.ndarray:
    """A copy with d random edits."""
    out = h.tolist()
    for _ in range(d):
        i, kind = int(g.integers(0, max(1, len(out)))), g.integers(0, 3)
        new = int(g.integers(0, 2**63))
        if kind == 0 and out:
            out[i] = new
        elif kind == 1 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, new)
    return np.array(out, np.uint64)


def repetitions(items: list[np.ndarray], rate: float, recall: float, most: int = MOST_REPETITIONS, trials: int = TRIALS) -> int:
    """The least power of two of repetitions that finds `recall` of copies of the items with as many edits as allowed; 0: none up to `most`."""
    g = np.random.default_rng(1)
    trial = [x for x in items if distances(np.array([len(x)]), rate)[0] > 0]
    if not trial:
        return 1
    pairs = [(x, edited(x, int(rate * len(x) + 1e-9), g)) for x in (trial[i] for i in g.integers(0, len(trial), trials))]
    h = np.concatenate([y for p in pairs for y in p])
    n = np.array([len(x) for x, _ in pairs])
    size = np.stack([n, np.minimum(n, [len(y) for _, y in pairs])], 1).reshape(-1)
    start = np.concatenate([[0], np.cumsum([len(y) for p in pairs for y in p])])[:-1]
    found, r, target = np.zeros(len(pairs), bool), 0, 1
    while target <= most:
        while r < target:  # some repetitions of all pairs side by side
            some = np.arange(r, min(target, r + 32))
            places = np.stack([sample_places(int(m), int(k)) for k in some for m in np.repeat(n, 2)])
            e = embed(h, np.tile(start, len(some)), np.tile(size, len(some)), places, np.repeat(some, len(start))).reshape(len(some), -1, 2)
            found |= (e[:, :, 0] == e[:, :, 1]).any(0)
            r = int(some[-1]) + 1
        if found.mean() >= recall:
            return target
        target *= 2
    return 0


def size_groups(sizes: list[int]) -> list[list[int]]:
    """Sizes that differ by at most a quarter."""
    out: list[list[int]] = []
    for n in sorted(sizes):
        if out and n <= 1.25 * out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return out


class Index:
    """The items of one part of the benchmark."""

    def __init__(self, ids: list[int], items: list[np.ndarray], rate: float, recall: float, most: int = MOST_REPETITIONS):
        self.ids, self.rate = np.array(ids, np.int64), rate
        self.size = np.array([len(x) for x in items], np.int64)
        self.flat, self.off = np.concatenate(items), np.concatenate([[0], np.cumsum(self.size)])
        self.words = np.unique(self.flat)
        self.pairs = np.unique(np.concatenate([pair_hash(x) for x in items] + [np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.pairs >> np.uint64(42)).astype(np.int64)] = True
        sizes = np.unique(self.size).tolist()
        # the sizes of the items that hold each pair, a bit for each size (sizes that share a bit only weaken the filter)
        self.bit = {n: k % 64 for k, n in enumerate(sizes)}
        self.of = np.zeros(len(self.pairs), np.uint64)
        for x in items:
            self.of[np.searchsorted(self.pairs, pair_hash(x))] |= np.uint64(1 << self.bit[len(x)])
        self.groups = size_groups(sizes)
        #: repetitions by size; 0: compare all
        self.reps = {n: r for g in self.groups for r in [repetitions([x for x in items if g[0] <= len(x) <= g[-1]], rate, recall, most)] for n in g}
        #: by size: the sampled places of each repetition, its sorted keys, and their items
        self.keys = {}
        for n in sizes:
            own = np.flatnonzero(self.size == n)
            k, r = len(own), self.reps[n]
            places = np.stack([sample_places(n, x) for x in range(r)]) if r else np.zeros((0, SAMPLES), np.int64)
            e = embed(self.flat, np.tile(self.off[own], r), np.full(k * r, n), np.repeat(places, k, 0), np.repeat(np.arange(r), k)).reshape(r, k)
            order = np.argsort(e, axis=1, kind="stable")
            self.keys[n] = (places, np.take_along_axis(e, order, 1), own[order] if r else own)

    def rows(self, item: np.ndarray, width: int) -> np.ndarray:
        """The words of items, side by side."""
        at = self.off[item][:, None] + np.arange(width)
        return np.where(np.arange(width) < self.size[item][:, None], self.flat[np.minimum(at, len(self.flat) - 1)], _PAD)


def _inside(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


def matches(h: np.ndarray, off: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(row, item, distance, first word) of the best window for each text and item found."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(h):
        return none
    pair = np.zeros(len(h), bool)
    p = pair_hash(h)
    maybe = index.seen[(p >> np.uint64(42)).astype(np.int64)]
    mask = np.zeros(len(h), np.uint64)
    if len(index.pairs):
        place = np.minimum(np.searchsorted(index.pairs, p[maybe]), len(index.pairs) - 1)
        mask[:-1][maybe] = np.where(index.pairs[place] == p[maybe], index.of[place], 0)
    mask[off[1:][(off[1:] > 0)] - 1] = 0  # the last word of a text starts no pair
    pair = mask > 0
    cp = np.concatenate([[0], np.cumsum(pair)])
    end = np.repeat(off[1:], np.diff(off))
    cw = None
    windows = []
    # sizes in groups: the places that could be right for any size of a group, then each size at these only
    where = {}
    for g in index.groups:
        needs = [n - 1 - 2 * int(distances(np.array([n]), index.rate)[0]) for n in g]
        if min(needs) <= 0:
            where |= dict.fromkeys(g, None)
            continue
        last = np.minimum(np.arange(len(h)) + (g[-1] - 1), end - 1)
        where |= dict.fromkeys(g, np.flatnonzero(cp[last] - cp[:-1] >= min(needs)))
    for n in index.keys:
        d = int(distances(np.array([n]), index.rate)[0])
        need = n - 1 - 2 * d
        at = where[n] if where[n] is not None else np.arange(len(h))
        m = np.minimum(n, end[at] - at)
        if need > 0 and len(at):
            own = np.concatenate([[0], np.cumsum(mask >> np.uint64(index.bit[n]) & np.uint64(1), dtype=np.int64)])
            ok = (m >= n - d) & (own[at + np.maximum(m - 1, 0)] - own[at] >= need)
        elif not len(at):
            continue
        else:
            if cw is None:
                cw = np.concatenate([[0], np.cumsum(_inside(index.words, h))])
            ok = (m >= max(1, n - d)) & (cw[at + m] - cw[at] >= n - d)
        at, m = at[ok], m[ok]
        if not len(at):
            continue
        windows.append(np.stack([at, m, np.full(len(at), n)], 1))
    some = []
    for win in windows:
        n = int(win[0, 2])
        places, keys, owners = index.keys[n]
        reps = index.reps[n]
        if not reps:
            some += [np.stack([win[:, 0], np.full(len(win), i)], 1) for i in owners]
            continue
        step = max(1, 1_000_000 // reps)
        for s in range(0, len(win), step):
            at, m = win[s : s + step, 0], win[s : s + step, 1]
            e = embed(h, np.repeat(at, reps), np.repeat(m, reps), np.tile(places, (len(at), 1)), np.tile(np.arange(reps), len(at))).reshape(len(at), reps)
            for r in range(reps):
                lo, hi = np.searchsorted(keys[r], e[:, r], "left"), np.searchsorted(keys[r], e[:, r], "right")
                k = hi - lo
                if k.any():
                    o = np.concatenate([[0], np.cumsum(k)])
                    item = owners[r][np.repeat(lo - o[:-1], k) + np.arange(o[-1])]
                    some.append(np.stack([np.repeat(at, k), item], 1))
    if not some:
        return none
    cand = np.unique(np.concatenate(some), axis=0)

    def verified(start, item, row):
        """The best window of each text and item; its distance."""
        n = index.size[item]
        m = np.minimum(n, off[row + 1] - start)
        most = distances(n, index.rate)
        ok = m >= n - most
        start, item, row, n, m, most = (x[ok] for x in (start, item, row, n, m, most))
        order = np.argsort(n, kind="stable")
        start, item, row, n, m, most = (x[order] for x in (start, item, row, n, m, most))
        dist = np.zeros(len(start), np.int64)
        s = 0
        while s < len(start):  # like sizes together, about four million words at a time
            e = min(len(start), int(np.searchsorted(n, 1.25 * n[s], "right")), s + max(1, 4_000_000 // int(1.25 * n[s])))
            q = slice(s, e)
            width = int(n[q].max())
            b = h[np.minimum(start[q][:, None] + np.arange(width), len(h) - 1)]
            dist[q] = edit_distance(index.rows(item[q], width), n[q], b, m[q], int(most[q].max()))
            s = e
        ok = dist <= most
        start, item, row, dist = start[ok], item[ok], row[ok], dist[ok]
        order = np.lexsort((start, dist, item, row))
        start, item, row, dist = start[order], item[order], row[order], dist[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return start[first], item[first], row[first], dist[first]

    start, item, row, dist = verified(*cand.T, np.searchsorted(off, cand[:, 0], "right") - 1)
    exact = dist == 0  # all equal windows are candidates, the first was taken
    d = distances(index.size[item[~exact]], index.rate)
    k = 2 * d + 1  # the windows around the best one
    o = np.concatenate([[0], np.cumsum(k)])
    near = np.repeat(start[~exact] - d, k) + (np.arange(o[-1]) - np.repeat(o[:-1], k))
    i, r = np.repeat(item[~exact], k), np.repeat(row[~exact], k)
    ok = (near >= off[r]) & (near < off[r + 1])
    more = verified(near[ok], i[ok], r[ok])
    start, item, row, dist = (np.concatenate([x[exact], y]) for x, y in zip((start, item, row, dist), more))
    return row, item, dist, start - off[row]


def indexes(benchmark: DataFrame, rate: float, recall: float, most_words: int):
    """Parts of the benchmark that are safe to broadcast, one after another."""
    hashed = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")

    def run(batches):
        for batch in batches:
            h, off = words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), T.as_binary(h.view(np.uint8), off * 8)], ["item_id", "words"])

    ids, items, total = [], [], 0
    for r in hashed.mapInArrow(run, "item_id bigint, words binary").where(F.length("words") > 0).toLocalIterator():
        ids.append(r["item_id"])
        items.append(np.frombuffer(bytes(r["words"]), np.uint64))
        total += len(items[-1])
        if total >= most_words:
            yield Index(ids, items, rate, recall)
            ids, items, total = [], [], 0
    if items:
        yield Index(ids, items, rate, recall)


SCHEMA = "doc_id bigint, item_id bigint, distance bigint, first_word bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, most_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, first_word): every document and item of which a window matches; see the module for edge cases."""
    docs = T.documents(docs, "doc_id", "text")
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for index in indexes(benchmark, rate, recall, most_words):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for piece in T.slices(batch):
                    h, off = words(piece.column("text"))
                    row, item, dist, first = matches(h, off, shared.value)
                    ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(shared.value.ids[item]), pa.array(dist), pa.array(first)], ["doc_id", "item_id", "distance", "first_word"])

        out = out.unionByName(docs.mapInArrow(run, SCHEMA))
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.first_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """`docs` without the documents that hold a benchmark item.

    Rows without a doc_id, text or words stay; rows that repeat a doc_id go together when one of them holds an item.  An empty table
    gives an empty one.  Columns are those of `docs`, whatever their names.
    """
    name = T.fresh(docs, "leak")
    gone = contaminated(docs, benchmark, rate, recall).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
