"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors fold into one.  Centroids of a bounded sample cut the rest into
   cells, and cells that are still large are cut again by centroids of their own,
   so that no table of centroids grows with the data; every vector goes to its
   `overlap` nearest, so the final cells (shards) overlap.
2. Each shard builds a flat graph: a vector's nearest candidates and some random
   ones are pruned (a candidate goes when a nearer one that was kept is clearly
   closer to it), and edges are added both ways.
3. A vector's adjacency lists from its shards are united.
4. In each shard every member is a query: greedy search with a beam from the
   medoids, then, from all that is in range and from the query itself, along
   the edges as long as they stay in range.
5. What is found is verified with double precision.  A pair that meets in several
   shards counts in the least of them.  A shard gives the number of links of each
   member and what it is connected to, never the pairs.  Shards that centroids do
   not cut (many vectors close together) are compared exactly, block by block.
6. The result is audited: the links of a sample of vectors are counted by brute
   force.  The sample grows with the table, and further until it holds enough
   vectors with links, at most MOST_AUDITED.  Recall is taken per vector and per
   group of near copies; if either is below the target, shards overlap more and
   beams widen, again until it is reached.  Where that would cost more than
   comparing all with all, that is done, block by block.

A link is a pair of vectors with a cosine of at least the threshold; a class is a
connected component of the links, named by its least vec_id.

Defined results
* null vec_id, null or empty vector, a null, infinite or NaN component, or length 0: left out.
* vectors of different dimensions are never linked.
* rows that repeat a vec_id and its vector (up to its length) are one; with another vector they are vectors of their own.
* ties: no order is implied.  Vectors without a link: no row.
* empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from .ngram_join import components

THRESHOLD = 0.95
SHARD = 1500
DEGREE, NEAR, FAR, ALPHA = 24, 48, 12, 1.2
BEAM, OVERLAP = 32, 2
RECALL, AUDITED, PARTNERED, MOST_AUDITED = 0.95, 256, 200, 65_536
CENTROIDS, SAMPLE_PER_SHARD = 1024, 12  # of one cell, at most; vectors of the sample for each
_BLOCK = 256
_ROWS = 20_000  # vectors of one cell that are assigned by one task
_EXACT = 2048  # rows of a block that is compared exactly
_AUDIT_ROWS, _AUDIT_BYTES = 8192, 16 << 20  # of the sample, for one pass over the table
_PLACES = 1 << 40


def _unit(batches):
    """(vec_id, dim, vec): unit vectors as float32 bytes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        there = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
        ids, lists = ids.filter(there), lists.filter(there)
        off = lists.offsets.to_numpy().astype(np.int64)
        v = lists.values.slice(off[0], off[-1] - off[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
        off = off - off[0]
        n = np.diff(off)
        with np.errstate(all="ignore"):
            length = np.sqrt(T.seg_sum(v * v, off))
            ok = np.isfinite(length) & (length > 0)
            x = (v / np.repeat(length, n)).astype(np.float32)[np.repeat(ok, n)]
        if ok.any():
            cut = np.concatenate([[0], np.cumsum(4 * n[ok])])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array(n[ok].astype(np.int32)), T.as_binary(x.view(np.uint8), cut)], ["vec_id", "dim", "vec"])


def _matrix(column, dim: int) -> np.ndarray:
    return T.from_bytes(column, np.float32).reshape(-1, dim)


def centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k means of a sample, by Lloyd's steps from k of its rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        off = np.searchsorted(own[order], np.arange(k + 1))
        total = T.seg_sum(x[order], off)
        some = np.diff(off) > 0
        c[some] = total[some]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _fit(shard: int):
    """Centroids of a cell, from its sample."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py())[order]
        c = centroids(x, min(len(x), math.ceil(table.column("size")[0].as_py() / shard), CENTROIDS))
        return pa.table([table.column("cell").slice(0, 1), pa.array([c.astype(np.float32).tobytes()], pa.binary())], names=["cell", "centroids"])

    return run


_PART = "cell bigint, rep bigint, dim int, vec binary, many bigint, place bigint"


def _assign(overlap: int):
    """Vectors of a cell to the `overlap` nearest centroids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select([x.split()[0] for x in _PART.split(", ")])
        dim = left.column("dim")[0].as_py()
        x, c = _matrix(left.column("vec"), dim), _matrix(right.column("centroids"), dim)
        k = min(overlap, len(c))
        top = np.concatenate([np.argpartition(-(x[s : s + 1024] @ c.T), k - 1, axis=1)[:, :k] for s in range(0, len(x), 1024)])
        at = pa.array(np.repeat(np.arange(len(x)), k))
        parent = np.uint64(left.column("cell")[0].as_py() % 2**64)
        child = T.mix(T.mix(parent + np.uint64(1)) + top.reshape(-1).astype(np.uint64)).view(np.int64)
        return pa.table([pa.array(child), *(left.column(n).take(at) for n in ("rep", "dim", "vec", "many", "place"))], names=[x.split()[0] for x in _PART.split(", ")])

    return run


def _local(df: DataFrame, most: int = CENTROIDS) -> DataFrame:
    """The same rows as a local table, whose size Spark knows and broadcasts by, if they are at most `most`."""
    rows = df.limit(most + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= most else df


def cells(reps: DataFrame, overlap: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(parts, large): the vectors by overlapping cells, and the cells of more than 2 * shard vectors that centroids do not cut."""
    parts = reps.select(F.col("dim").cast("bigint").alias("cell"), "rep", "dim", "vec", "many", "place")
    levels = 1 + math.ceil(math.log(max(2, reps.count() / shard), CENTROIDS))
    level, most = 0, shard
    while True:
        big = _local(T.materialize(parts.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most)))
        if level == levels or not big.limit(1).count():
            return parts, big.select("cell")
        big = big.withColumn("salts", F.ceil(F.col("size") / _ROWS))
        mine = parts.join(big, "cell")
        share = F.least(F.lit(CENTROIDS), F.ceil(F.col("size") / shard)) * SAMPLE_PER_SHARD / F.col("size")
        sample = mine.where(F.pmod(F.xxhash64("rep", F.lit(3 + level)), F.lit(1 << 30)) < share * (1 << 30)).select("cell", "rep", "dim", "vec", "size")
        fitted = sample.groupBy("cell").applyInArrow(_fit(shard), "cell bigint, centroids binary")
        fitted = fitted.join(big, "cell").select("cell", "centroids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        left = mine.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts"))).drop("size", "salts").groupBy("cell", "salt")
        cut = left.cogroup(fitted.groupBy("cell", "salt")).applyInArrow(_assign(overlap), _PART)
        parts = T.materialize(parts.join(big.select("cell"), "cell", "left_anti").unionByName(cut))
        level, most = level + 1, 2 * shard


def robust_prune(x: np.ndarray, rows: np.ndarray, cand: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Up to `degree` of the candidates (nearest first, -1: none) of each row: a candidate goes when a kept one is alpha times closer to it than the row is."""
    ok = (cand >= 0) & (cand != rows[:, None])
    y = x[np.maximum(cand, 0)]
    to_row = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", y, x[rows])))
    to_row[~ok] = np.inf
    order = np.argsort(to_row, axis=1, kind="stable")
    cand, to_row = np.take_along_axis(cand, order, 1), np.take_along_axis(to_row, order, 1)
    y = x[np.maximum(cand, 0)]
    between = np.sqrt(np.maximum(0, 2 - 2 * (y @ y.transpose(0, 2, 1))))
    alive = np.isfinite(to_row)
    out = np.full((len(rows), degree), -1, np.int64)
    every = np.arange(len(rows))
    for r in range(degree):
        pick = alive.argmax(1)
        some = alive[every, pick]
        if not some.any():
            break
        out[some, r] = cand[every, pick][some]
        alive &= ~(some[:, None] & (alpha * between[every, pick] <= to_row))
        alive[every, pick] = False
    return out


def flat_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency of each row (-1: none): pruned near edges, pruned random edges and edges back."""
    m = len(x)
    g = np.random.default_rng(seed)
    near = min(NEAR, m - 1)
    out = np.full((m, DEGREE), -1, np.int64)
    for s in range(0, m, _BLOCK) if m > 1 else ():
        rows = np.arange(s, min(m, s + _BLOCK))
        sim = x[rows] @ x.T
        sim[np.arange(len(rows)), rows] = -2
        top = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        out[rows, : DEGREE - 6] = robust_prune(x, rows, top, DEGREE - 6)
        out[rows, DEGREE - 6 :] = robust_prune(x, rows, g.integers(0, m, (len(rows), FAR)), 6)
    # edges back, as many as fit
    a, b = np.repeat(np.arange(m), DEGREE), out.reshape(-1)
    a, b = b[b >= 0], a[b >= 0]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    pos = T.within(np.searchsorted(a, np.arange(m + 1)))
    back = np.full((m, DEGREE), -1, np.int64)
    fits = pos < DEGREE
    back[a[fits], pos[fits]] = b[fits]
    return np.concatenate([out, back], 1)


def medoids(x: np.ndarray, k: int = 4) -> np.ndarray:
    """The rows nearest to k means."""
    c = centroids(x, min(k, len(x)), 2)
    return np.unique((x @ c.T).argmax(0))


def range_search(x: np.ndarray, adj: np.ndarray, entries: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, found): rows within the threshold of the queries (rows too), each pair once."""
    q, m = len(queries), len(x)
    seen = np.zeros((q, m), bool)
    own = np.arange(q)
    seen[own, queries] = True
    slack = threshold - 0.02
    got_q, got_v, got_s = [own], [queries], [np.ones(q)]

    def look(rows, nodes):
        """Similarities of new (query, node) pairs, marked as seen."""
        s = np.einsum("ij,ij->i", x[queries[rows]], x[nodes])
        hit = s >= slack
        got_q.append(rows[hit])
        got_v.append(nodes[hit])
        got_s.append(s[hit])
        return s

    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -2.0, np.float32)
    done = np.ones((q, beam), bool)
    e = np.tile(entries[:beam], (q, 1))
    fresh = ~np.take_along_axis(seen, e, 1)
    seen[own[:, None], e] = True
    rows, cols = np.nonzero(fresh)
    ids[rows, cols], done[rows, cols] = e[rows, cols], False
    sims[rows, cols] = look(rows, e[rows, cols])
    while True:
        open_ = np.where(done, -3, sims)
        best = open_.argmax(1)
        act = np.flatnonzero(open_[own, best] > -3)
        if not len(act):
            break
        done[act, best[act]] = True
        n = adj[ids[act, best[act]]]
        ok = n >= 0
        ok &= ~seen[act[:, None], np.maximum(n, 0)]
        # a node may stand twice in a list
        key = np.where(ok, n, -1 - np.arange(n.shape[1]))
        order = np.argsort(key, axis=1, kind="stable")
        srt = np.take_along_axis(key, order, 1)
        dup = np.zeros_like(ok)
        dup[:, 1:] = srt[:, 1:] == srt[:, :-1]
        n, ok = srt, (srt >= 0) & ~dup
        rows, cols = np.nonzero(ok)
        seen[act[rows], n[rows, cols]] = True
        s = np.full(n.shape, -2.0, np.float32)
        s[rows, cols] = look(act[rows], n[rows, cols])
        all_ids = np.concatenate([ids[act], n], 1)
        all_sims = np.concatenate([sims[act], s], 1)
        all_done = np.concatenate([done[act], ~ok], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[act], sims[act], done[act] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
    fq, fv = np.concatenate(got_q), np.concatenate(got_v)
    while len(fq):  # along the edges, as long as they stay in range
        before = len(got_q)
        for s in range(0, len(fq), 20_000):
            n = adj[fv[s : s + 20_000]]
            rows = np.repeat(fq[s : s + 20_000], n.shape[1])
            n = n.reshape(-1)
            ok = n >= 0
            rows, n = rows[ok], n[ok]
            key = np.unique((rows * m + n)[~seen[rows, n]])
            rows, n = key // m, key % m
            seen[rows, n] = True
            look(rows, n)
        fq, fv = np.concatenate(got_q[before:] or [np.zeros(0, np.int64)]), np.concatenate(got_v[before:] or [np.zeros(0, np.int64)])
    fq, fv, fs = np.concatenate(got_q), np.concatenate(got_v), np.concatenate(got_s)
    keep = fv != queries[fq]
    return fq[keep], fv[keep]


def _build(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("rep").to_numpy(), kind="stable")
    ids = table.column("rep").to_numpy()[order]
    cell = table.column("cell")[0].as_py()
    x = _matrix(table.column("vec"), table.column("dim")[0].as_py())[order]
    adj = flat_graph(x, cell % 2**63)
    n = (adj >= 0).sum(1)
    return pa.table(
        [pa.array([cell] * len(ids), pa.int64()), pa.array(ids), T.as_list(ids[adj[adj >= 0]], np.concatenate([[0], np.cumsum(n)]), pa.int64())], names=["cell", "rep", "near"]
    )


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Bring the labels (the least place of each component known so far) up to date for edges i, j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label[:] = label[label]


class _Homes:
    """Cells of each row, to count a pair in one of those that it meets in."""

    def __init__(self, column, order):
        lists = column.combine_chunks().take(pa.array(order))
        off = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(off)
        self.at = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.int64)
        self.there = np.arange(self.at.shape[1])[None] < n[:, None]
        self.at[self.there] = lists.values.to_numpy()[off[0] : off[-1]]

    def owns(self, cell: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is the cell the least of those that both i and j are in?"""
        least = np.full(len(i), np.iinfo(np.int64).max)
        for k in range(self.at.shape[1]):
            a = self.at[i, k]
            both = self.there[i, k] & ((self.at[j] == a[:, None]) & self.there[j]).any(1)
            least = np.where(both, np.minimum(least, a), least)
        return least == cell


_FOUND = "rep bigint, links bigint, low bigint"


def _result(ids, links, label) -> pa.Table:
    """Rows that have links or are connected to something."""
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    low = low[label]
    some = (links > 0) | (low < ids)
    return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(low[some])], names=["rep", "links", "low"])


def _search(threshold: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        ids, many = (table.column(k).to_numpy()[order] for k in ("rep", "many"))
        cell = table.column("cell")[0].as_py()
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py())[order]
        homes = _Homes(table.column("homes"), order)
        lists = table.column("near").combine_chunks().take(pa.array(order))
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()[off[0] : off[-1]]
        row = np.repeat(np.arange(len(ids)), np.diff(off))
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat  # neighbours that are in this shard too
        key = np.unique(row[here] * len(ids) + at[here])
        row, at = key // len(ids), key % len(ids)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        adj = np.full((len(ids), max(1, int(np.diff(cut).max()))), -1, np.int64)
        adj[row, T.within(cut)] = at
        entries = medoids(x)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        step = max(16, min(512, 32_000_000 // len(ids)))
        known = [np.zeros(0, np.int64)]
        for s in range(0, len(ids), step):
            q, v = range_search(x, adj, entries, np.arange(s, min(len(ids), s + step)), threshold, beam)
            q = q + s
            known.append(np.minimum(q, v) * len(ids) + np.maximum(q, v))
        known = np.unique(np.concatenate(known))  # a pair may be found from either end
        for t in range(0, len(known), 100_000):
            i, j = known[t : t + 100_000] // len(ids), known[t : t + 100_000] % len(ids)
            hit = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64)) >= threshold
            i, j = i[hit], j[hit]
            unite(label, i, j)
            own = homes.owns(cell, i, j)
            np.add.at(links, i[own], many[j[own]])
            np.add.at(links, j[own], many[i[own]])
        return _result(ids, links, label)

    return run


def _exact(threshold: float):
    """All pairs of a block with another of the same cell."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, many = (table.column(k).to_numpy() for k in ("side", "rep", "many"))
        cell = table.column("cell")[0].as_py()
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py()).astype(np.float64)
        homes = _Homes(table.column("homes"), np.arange(len(ids)))
        square = bool((side == 2).all())
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(left), 256):
            i, j = np.nonzero(x[left[s : s + 256]] @ x[right].T >= threshold)
            i, j = left[s : s + 256][i], right[j]
            if square:
                i, j = i[i < j], j[i < j]
            unite(label, i, j)
            for t in range(0, len(i), 100_000):
                a, b = i[t : t + 100_000], j[t : t + 100_000]
                own = homes.owns(cell, a, b)
                np.add.at(links, a[own], many[b[own]])
                np.add.at(links, b[own], many[a[own]])
        return _result(ids, links, label)

    return run


def exact_links(parts: DataFrame, threshold: float, block: int = _EXACT) -> DataFrame:
    """(rep, links, low) of the pairs within each cell, compared block by block; `parts` have homes."""
    k = parts.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("k"))
    at = parts.join(k, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")))
    at = at.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    at = at.withColumns({
        "x": F.least("block", "o"), "y": F.greatest("block", "o"),
        "side": F.when(F.col("block") == F.col("o"), 2).when(F.col("block") < F.col("o"), 0).otherwise(1),
    })
    return at.select("cell", "x", "y", "side", "rep", "many", "dim", "vec", "homes").groupBy("cell", "x", "y").applyInArrow(_exact(threshold), _FOUND)


def _truth(sample, threshold: float):
    """(rep, links): links of the audited vectors, in part."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sample.value:
                    continue
                part = batch.filter(pa.array(dims == dim))
                ids, x = sample.value[dim]
                own, many, y = part.column("rep").to_numpy(), part.column("many").to_numpy(), _matrix(part.column("vec"), dim)
                x = x.astype(np.float64)
                links = np.zeros(len(ids), np.int64)
                step = max(16, min(4096, 4_000_000 // len(x)))
                for s in range(0, len(y), step):
                    hit = y[s : s + step].astype(np.float64) @ x.T >= threshold
                    hit &= own[s : s + step, None] != ids[None]
                    links += many[s : s + step] @ hit
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["rep", "links"])

    return run


def _by_dim(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append((r["rep"], np.frombuffer(bytes(r["vec"]), np.float32)))
    return {d: (np.array([i for i, _ in v], np.int64), np.stack([x for _, x in v])) for d, v in out.items()}


class _Audit:
    """Brute force over a growing part of the vectors, in order of a hash."""

    def __init__(self, reps: DataFrame, n: int, dim: int, threshold: float):
        self.reps, self.n, self.threshold = reps, n, threshold
        self.rows = max(1, min(_AUDIT_ROWS, _AUDIT_BYTES // (4 * dim)))
        self.until, self.truth = 0, reps.sparkSession.createDataFrame([], "rep bigint, links bigint")

    @property
    def done(self) -> bool:
        return self.until >= _PLACES or self.until >= _PLACES * MOST_AUDITED // self.n

    def extend(self, size: int) -> None:
        """About `size` vectors more."""
        end = min(_PLACES, self.until + max(1, size * _PLACES // self.n))
        step = max(1, self.rows * _PLACES // self.n)
        parts = [self.truth]
        while self.until < end:
            to = min(end, self.until + step)
            some = self.reps.where((F.col("place") >= self.until) & (F.col("place") < to)).select("rep", "dim", "vec").collect()
            if some:
                shared = self.reps.sparkSession.sparkContext.broadcast(_by_dim(some))
                part = self.reps.select("rep", "many", "dim", "vec").mapInArrow(_truth(shared, self.threshold), "rep bigint, links bigint")
                parts.append(T.materialize(part.groupBy("rep").agg(F.sum("links").alias("links")).where("links > 0")))
                shared.destroy()
            self.until = to
        self.truth = T.materialize(_union(parts))

    def partnered(self) -> float:
        """Effective number of vectors with links, where each group of near copies has one vote (Kish)."""
        w = self.truth.select((1 / (1 + F.col("links"))).alias("w"))
        r = w.agg((F.sum("w") ** 2 / F.sum(F.col("w") ** 2)).alias("n")).first()
        return r["n"] or 0.0

    def recall(self, links: DataFrame) -> float:
        """Share of the links found: the lesser of its mean over vectors and over groups."""
        t = self.truth.join(links.select("rep", F.col("links").alias("found")), "rep", "left")
        t = t.select((F.coalesce("found", F.lit(0)) / F.col("links")).alias("r"), (1 / (1 + F.col("links"))).alias("w"))
        r = t.agg(F.avg("r").alias("x"), (F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("y")).first()
        return 1.0 if r["x"] is None else min(r["x"], r["y"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def search(reps: DataFrame, overlap: int, beam: int, threshold: float, shard: int) -> DataFrame:
    """(rep, links, low): links found in the shards, and edges that connect what is linked."""
    parts, large = cells(reps, overlap, shard)
    small = parts.join(large, "cell", "left_anti")
    edges = small.groupBy("cell").applyInArrow(_build, "cell bigint, rep bigint, near array<bigint>")
    edges = edges.unionByName(parts.join(large, "cell", "left_semi").select("cell", "rep", F.array().cast("array<bigint>").alias("near")))
    near = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_sort(F.collect_set("cell")).alias("homes"))
    both = T.materialize(parts.join(near, "rep"))
    found = both.join(large, "cell", "left_anti").groupBy("cell").applyInArrow(_search(threshold, beam), _FOUND)
    return T.materialize(found.unionByName(exact_links(both.join(large, "cell", "left_semi"), threshold)))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, shard: int = SHARD) -> DataFrame:
    """(vec_id, class_id, links): every vector that has a cosine of at least the threshold with another; see the module for edge cases."""
    spark = vectors.sparkSession
    units = T.materialize(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_unit, "vec_id bigint, dim int, vec binary").distinct())
    units = units.withColumn("rep", F.xxhash64("dim", "vec"))
    reps = units.groupBy("rep", "dim", "vec").agg(F.count("*").alias("many"), F.min("vec_id").alias("first"))
    reps = T.materialize(reps.withColumn("place", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(_PLACES))))
    size = reps.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n = size["n"]
    if not n:
        return spark.createDataFrame([], "vec_id bigint, class_id bigint, links bigint")
    audit = _Audit(reps, n, size["dim"], threshold)
    audit.extend(max(AUDITED, math.isqrt(n)))
    while not audit.done and audit.partnered() < PARTNERED:
        audit.extend(n * audit.until // _PLACES)
    overlap, beam = OVERLAP, BEAM
    while True:
        found = search(reps, overlap, beam, threshold, shard)
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        if audit.recall(links) >= recall:
            break
        overlap, beam = overlap * 2, beam * 2
        if overlap * overlap > n / shard:  # dearer than all with all
            one = reps.select(F.col("dim").cast("bigint").alias("cell"), "rep", "dim", "vec", "many").withColumn("homes", F.array("cell"))
            found = T.materialize(exact_links(one, threshold))
            links = found.groupBy("rep").agg(F.sum("links").alias("links"))
            break
    group = components(found.where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()).withColumnsRenamed({"v": "rep", "c": "group"})
    table = reps.select("rep", "first", "many").join(links, "rep", "left").join(group, "rep", "left")
    table = table.select("rep", "first", F.coalesce("group", "rep").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links")).where("links > 0")
    head = table.groupBy("group").agg(F.min("first").alias("class_id"))
    table = table.join(head, "group").select("rep", "class_id", "links")
    return units.select("vec_id", "rep").join(table, "rep").select("vec_id", "class_id", "links")
