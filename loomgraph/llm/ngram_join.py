"""N-gram Jaccard join: all documents whose word n-gram sets are alike, as classes and links.

The document by n-gram incidence matrix is cut into row blocks (a few megabytes
of text) and column blocks (ranges of the n-gram hash).  One shuffle brings a
column block together: it finds how many documents hold each n-gram and drops
the columns that a single document holds, for they overlap with nothing.  The
most frequent n-grams are known before, by mergeable counters of fixed size over
all documents; they go straight to their row blocks, so that no column block
holds a hot column.  A second shuffle returns the rest to its row block, where a
document is discarded when its shared n-grams are fewer than any partner would
need: a pair with Jaccard >= t overlaps in at least t * size n-grams.  Documents
of equal size and equal shared n-grams fold into one row.  Of a row of size n
only the n - ceil(t n) + 1 rarest columns can be the first that a pair shares, so
these link rows into tiles, and the sparse product of each tile with its own
transpose, taken block by block, accumulates the exact overlap counts.  A block
pair gives the number of links of each of its rows and what it is connected to,
never the pairs themselves.  Nothing is capped: a tile larger than a block
becomes several block pairs.

A link is a pair of documents with Jaccard >= t; a class is a connected
component of the links, named by its least doc_id.

Defined results
* null doc_id: the row is left out.  Null or empty text, or white space only: no n-grams, never linked.
* fewer than n words: the whole text is the only n-gram.
* very long texts: whole; work grows with their length.
* rows that repeat a doc_id and its text are one document; rows that repeat a doc_id with another text are documents of
  their own, each with its row of the result.
* ties: no order is implied.
* documents without a link: no row; such a class is the document alone.
* empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

N, THRESHOLD = 3, 0.7
BLOCK = 1024
FREQUENT, HOT = 1 << 16, 20_000  # counters of n-grams, and occurrences from which a column is hot
_MASK = np.uint64(0x7FFFFFFFFFFFFFFF)
_KEPT = 6  # bytes of the hash that travel, besides the number of the column block


def need(threshold: float, size):
    """ceil(threshold * size), safe from rounding."""
    return np.ceil(threshold * np.asarray(size, float) - 1e-9).astype(np.int64)


def ngram_hashes(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram occurrence; a row with fewer than n words has one n-gram, all of it."""
    h, off = w.hash, w.offsets
    size = np.diff(off)
    long = size >= n
    start = np.ones(len(h), bool)
    for k in range(1, n):  # the last n-1 words of a row start no n-gram
        at = off[1:] - k
        start[at[(at >= off[:-1])]] = False
    rows = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(start)
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = T.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    r = rows[at]
    short = np.flatnonzero(~long & (size > 0))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n):
            there = size[short] > k
            extra[there] = T.mix(extra[there] * np.uint64(0x9E3779B97F4A7C15) + h[off[short[there]] + k])
        g, r = np.concatenate([g, T.mix(extra + size[short].astype(np.uint64))]), np.concatenate([r, short])
    return g & _MASK, r


def _merge(g: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum counters by key and keep at most `most`, less the count of the first that is left out: what is frequent stays, and no count is too high."""
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    off = T.runs(g)
    g, n = g[off[:-1]], T.seg_sum(n, off)
    if len(g) > most:
        n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
        g, n = g[n > 0], n[n > 0]
    return g, n


def frequent(docs: DataFrame, n: int, most: int = FREQUENT, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes in order, their counts): those that occur `hot` times, and 1 / `most` of all occurrences, more often; at most `most` of them."""
    schema = "g binary, n binary"

    def give(g, c):
        return pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["g", "n"])

    def count(batches):
        g, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in T.slices(batch):
                new, times = np.unique(ngram_hashes(T.Words(piece.column("text")), n)[0], return_counts=True)
                g, c = _merge(np.concatenate([g, new]), np.concatenate([c, times]), most)
        yield give(g, c)

    def total(batches):
        g, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            g, c = np.concatenate([g, T.from_bytes(batch.column("g"), np.uint64)]), np.concatenate([c, T.from_bytes(batch.column("n"), np.int64)])
            g, c = _merge(g, c, most)
        yield give(g, c)

    parts = docs.select("text").mapInArrow(count, schema)
    for tasks in (512, 12, 1):
        if tasks < 512 or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 512:
            parts = parts.repartition(tasks).mapInArrow(total, schema)
    (row,) = parts.collect()
    g, c = np.frombuffer(row["g"], np.uint64), np.frombuffer(row["n"], np.int64)
    return g[c >= hot], c[c >= hot]


def _identity(g: np.ndarray, blocks: int) -> np.ndarray:
    """What stands for an n-gram in its row block: the kept bytes of its hash and its column block."""
    kept = T.read_low_bytes(T.low_bytes(g // np.uint64(blocks), _KEPT), _KEPT)
    return T.mix(kept + g % np.uint64(blocks) * np.uint64(0xD6E8FEB86659FD93)) & _MASK


def _level(df: np.ndarray) -> np.ndarray:
    """Frequency as a byte; 0: a lone document."""
    return np.minimum(255, np.ceil(8 * np.log2(df))).astype(np.uint8)


_INCIDENCE = "p bigint, r bigint, grams binary, df binary, rows binary, ids binary"


def _incidence(n: int, blocks: int, hot):
    """Rows (p, r, grams, df, rows, ids): the part of row block r in column block p; hot columns go in a part of their own (p < 0), doc_ids and text hashes with one column block."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        hot_g, hot_n = hot.value
        for batch in batches:
            for piece in T.slices(batch):
                ids = np.concatenate([piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "txt")])
                g, rows = ngram_hashes(T.Words(piece.column("text")), n)
                r = (part << 24) | k
                k += 1
                out = []
                if len(hot_g) and len(g):
                    at = np.minimum(np.searchsorted(hot_g, g), len(hot_g) - 1)
                    is_hot = hot_g[at] == g
                    if is_hot.any():
                        both = np.unique(at[is_hot] * np.int64(1 << 16) + rows[is_hot])
                        which, hr = both >> 16, (both & 0xFFFF).astype(np.uint16)
                        out.append((-1 - r, _identity(hot_g[which], blocks).tobytes(), _level(hot_n[which]).tobytes(), hr.tobytes(), None))
                        g, rows = g[~is_hot], rows[~is_hot]
                block = (g % np.uint64(blocks)).astype(np.uint16 if blocks <= 65536 else np.uint32)
                order = np.argsort(block, kind="stable")
                cut = np.searchsorted(block[order], np.arange(blocks + 1))
                g, rows = g[order] // np.uint64(blocks), rows[order].astype(np.uint16)
                for b in np.union1d(np.flatnonzero(cut[1:] > cut[:-1]), [r % blocks]).tolist():
                    s = slice(cut[b], cut[b + 1])
                    out.append((b, T.low_bytes(g[s], _KEPT), None, rows[s].tobytes(), ids.tobytes() if b == r % blocks else None))
                p, grams, df, at, own = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.int64()), pa.array([r] * len(p), pa.int64()), *(pa.array(x, pa.binary()) for x in (grams, df, at, own))],
                    ["p", "r", "grams", "df", "rows", "ids"],
                )

    return run


def _columns(table: pa.Table) -> pa.Table:
    """One column block: distinct (n-gram, document), frequencies, and back to row blocks without the lone columns."""
    rs, p = table.column("r").to_numpy(), table.column("p")[0].as_py()
    names = ("grams", "df", "rows", "sizes", "ids")
    schema = pa.schema([("r", pa.int64()), ("p", pa.int64()), *((k, pa.binary()) for k in names)])
    if p < 0:  # hot columns of one row block, distinct already
        size = T.small_ints(np.bincount(T.from_bytes(table.column("rows"), np.uint16)))
        return pa.table([table.column("r"), table.column("p"), *(table.column(k) for k in names[:3]), pa.array([size], pa.binary()), table.column("ids")], schema=schema)
    g = T.read_low_bytes(b"".join(table.column("grams").to_pylist()), _KEPT)
    n = np.array([len(x) // _KEPT for x in table.column("grams").to_pylist()], np.int64)
    src = np.repeat(np.arange(len(rs)), n)
    row = T.from_bytes(table.column("rows"), np.uint16).astype(np.int64)
    doc = (src << 32) | row
    order = np.lexsort((doc, g))
    g, doc = g[order], doc[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[first], doc[first]
    off = T.runs(g)
    df = np.diff(off)
    df_of = np.repeat(_level(df), df)
    order = np.argsort(doc, kind="stable")
    g, doc, df_of = g[order], doc[order], df_of[order]
    cut = np.searchsorted(doc >> 32, np.arange(len(rs) + 1))
    out = {k: [] for k in ("r", "p", *names)}
    for i in range(len(rs)):
        s = slice(cut[i], cut[i + 1])
        rows, keep = doc[s] & 0xFFFFFFFF, df_of[s] > 0
        out["r"].append(int(rs[i]))
        out["p"].append(p)
        out["grams"].append(T.low_bytes(g[s][keep], _KEPT))
        out["df"].append(df_of[s][keep].tobytes())
        out["rows"].append(rows[keep].astype(np.uint16).tobytes())
        out["sizes"].append(T.small_ints(np.bincount(rows.astype(np.int64)) if len(rows) else np.zeros(0, np.int64)))
        out["ids"].append(table.column("ids")[i].as_py())
    return pa.table(out, schema=schema)


def _rows(threshold: float):
    """One row block: documents that may have a partner, with their shared n-grams, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        ids, txt = T.from_bytes(table.column("ids"), np.int64).reshape(2, -1)
        size = np.zeros(len(ids), np.int64)
        for x in table.column("sizes").to_pylist():
            v = T.read_small_ints(x)
            size[: len(v)] += v
        g = [
            np.frombuffer(x, np.uint64) if p < 0 else T.mix(T.read_low_bytes(x, _KEPT) + np.uint64(p * 0xD6E8FEB86659FD93 % 2**64)) & _MASK
            for x, p in zip(table.column("grams").to_pylist(), table.column("p").to_pylist())
        ]
        g = np.concatenate(g)
        df, row = T.from_bytes(table.column("df"), np.uint8), T.from_bytes(table.column("rows"), np.uint16).astype(np.int64)
        shared = np.bincount(row, minlength=len(ids))
        stays = (size > 0) & (shared >= np.maximum(1, need(threshold, size)))
        keep = stays[row]
        g, df, row = g[keep], df[keep], row[keep]
        order = np.lexsort((g, df, row))
        g, row = g[order], row[order]
        at = np.flatnonzero(stays)
        off = np.concatenate([np.searchsorted(row, at), [len(row)]])
        a, b = (T.seg_sum(T.mix(g + np.uint64(k)), off).view(np.int64) for k in (1, 0xABCDEF12345))
        prefix = np.maximum(0, size[at] - need(threshold, size[at]) + 1 - (size[at] - shared[at]))
        return pa.table(
            [pa.array(ids[at]), pa.array(txt[at]), pa.array(size[at]), pa.array(a), pa.array(b), T.as_list(g.view(np.int64), off, pa.int64()), pa.array(prefix)],
            names=["doc_id", "txt", "size", "sig_a", "sig_b", "grams", "prefix"],
        )

    return run


ROWS = "doc_id bigint, txt bigint, size bigint, sig_a bigint, sig_b bigint, grams array<bigint>, prefix bigint"


def sets_with_partners(docs: DataFrame, n: int, threshold: float, hot: int = HOT) -> DataFrame:
    """Documents that pass the size bound, with their shared n-grams."""
    docs = T.documents(docs, "doc_id", "text").withColumn("txt", F.xxhash64("text"))
    count = docs.count()
    blocks = 16
    while blocks * 2000 < count:
        blocks *= 2
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, n, hot=hot))
    inc = docs.mapInArrow(_incidence(n, blocks, known), _INCIDENCE)
    cols = inc.groupBy("p").applyInArrow(_columns, "r bigint, p bigint, grams binary, df binary, rows binary, sizes binary, ids binary")
    return cols.groupBy("r").applyInArrow(_rows(threshold), ROWS)


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least vertex of each vertex's component; edges (a, b) with a < b.

    Hash-to-min with pointer jumping: every round halves the paths, so rounds grow with the logarithm of the longest.
    """
    both = T.materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = T.materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(lab, both.b == lab.v).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = lab.join(near, "v").select("v", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        up = step.select(F.col("v").alias("u"), F.col("n").alias("un"))
        new = T.materialize(
            step.join(up, step.n == up.u, "left").select("v", F.least("n", F.coalesce("un", "n")).alias("c"), "old")
        )
        changed = new.where("c <> old").limit(1).count()
        lab = new.select("v", "c")
        if not changed:
            return lab


def _product(threshold: float):
    """Sparse product of one block of rows with another of the same tile; overlap counts below the bound are discarded.

    Rows (cid, links, low): how many documents of the other block a row is linked to, and the least cid it is connected to within the pair of blocks.
    """
    none = pa.table([pa.array([], pa.int64())] * 3, names=["cid", "links", "low"])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cid, size, many = (table.column(k).to_numpy() for k in ("cid", "size", "many"))
        lists = table.column("grams").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        g = lists.values.to_numpy()[off[0] : off[-1]]
        off = off - off[0]
        row = np.repeat(np.arange(len(cid)), np.diff(off))
        square = bool((side == 2).all())
        left = np.flatnonzero(side != 1)
        right = left if square else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return none
        order = np.lexsort((row, g))
        g, row = g[order], row[order]
        cut = T.runs(g)
        df = np.diff(cut)
        col = np.repeat(np.arange(len(df)), df)
        keep = df[col] > 1
        row, col, cdf = row[keep], col[keep], df[col][keep]
        place = np.zeros(len(cid), np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        counts = np.zeros((len(left), len(right)), np.float32)
        hot = cdf > 12
        # sparse columns: their pairs one by one; dense columns: a matrix product, some thousand columns at a time
        cold = T.runs(col[~hot])
        r = row[~hot]
        for i, j in T.pairs_of(cold):
            i, j = r[i], r[j]
            if square:
                x, y = place[i], place[j]
            else:
                swap = side[i] == 1
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                ok = (side[i] == 0) & (side[j] == 1)
                x, y = place[i[ok]], place[j[ok]]
            counts += np.bincount(x * len(right) + y, minlength=counts.size).reshape(counts.shape).astype(np.float32)
        if square:
            counts = counts + counts.T
        hr, hc = row[hot], col[hot]
        uc = np.unique(hc)
        for s in range(0, len(uc), 4096):
            lo, hi = uc[s], uc[min(s + 4096, len(uc)) - 1]
            m = (hc >= lo) & (hc <= hi)
            dense = np.zeros((len(cid), min(4096, len(uc) - s)), np.float32)
            dense[hr[m], np.searchsorted(uc[s : s + 4096], hc[m])] = 1
            counts += dense[left] @ (dense[left] if square else dense[right]).T
        a, b = size[left].astype(float), size[right].astype(float)
        ok = counts >= threshold * (a[:, None] + b[None, :] - counts) - 1e-9
        ok &= counts > 0
        if square:
            np.fill_diagonal(ok, False)
        low_l, low_r = cid[left].copy(), cid[right].copy()
        x, y = np.nonzero(ok)
        while len(x):  # the least cid of each component
            before = low_l.copy(), low_r.copy()
            np.minimum.at(low_r, y, low_l[x])
            np.minimum.at(low_l, x, low_r[y])
            if square:
                low_l = low_r = np.minimum(low_l, low_r)
            if (before[0] == low_l).all() and (before[1] == low_r).all():
                break
        links_l, links_r = ok @ many[right], ok.T @ many[left]
        some_l, some_r = links_l > 0, (links_r > 0) & (not square)
        cols = (cid[left], cid[right]), (links_l, links_r), (low_l, low_r)
        return pa.table([pa.array(np.concatenate([u[some_l], v[some_r]])) for u, v in cols], names=["cid", "links", "low"])

    return run


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, txt, class_id, class_txt, links): documents that have links, the first document of their class (by doc_id, then by the hash of its text) and the number of their links."""
    rows = T.materialize(sets_with_partners(docs, n, threshold, hot)).withColumn("cid", F.xxhash64("sig_a", "sig_b", "size"))
    shared = F.size("grams").cast("bigint")
    members = rows.select("doc_id", "txt", "cid", (shared >= F.lit(threshold) * (2 * F.col("size") - shared) - 1e-9).alias("alike")).distinct()
    # documents that fold: how many, the first one, whether they are alike with one another
    folded = T.materialize(members.groupBy("cid").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "txt")).alias("first"), F.first("alike").alias("alike")))
    reps = T.materialize(rows.select("cid", "size", "grams", "prefix").dropDuplicates(["cid"]).join(folded.select("cid", "many"), "cid"))
    post = reps.select("cid", F.explode(F.slice("grams", 1, F.col("prefix").cast("int"))).alias("g"))
    least = post.groupBy("g").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("g", "a")
    links = post.join(least, "g").where("a < cid").select("a", F.col("cid").alias("b")).distinct()
    tile = components(links).withColumnsRenamed({"v": "cid", "c": "tile"})
    # rows of a tile in blocks of bounded size; a tile of one block is one task, a larger one all its block pairs
    counts = tile.groupBy("tile").count().select("tile", F.ceil(F.col("count") / block).alias("k"))
    at = tile.join(counts, "tile").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("k")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))
    spread = at.select("cid", "tile", "block", other.alias("o"))
    spread = spread.select(
        "cid", "tile", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"),
        F.when(F.col("block") == F.col("o"), 2).when(F.col("block") < F.col("o"), 0).otherwise(1).alias("side"),
    )
    tiles = spread.join(reps.select("cid", "size", "many", "grams"), "cid")
    found = T.materialize(tiles.groupBy("tile", "x", "y").applyInArrow(_product(threshold), "cid bigint, links bigint, low bigint"))
    group = components(found.where("low < cid").select(F.col("low").alias("a"), F.col("cid").alias("b"))).withColumnsRenamed({"v": "cid", "c": "group"})
    own = found.groupBy("cid").agg(F.sum("links").alias("links"))
    table = folded.join(own, "cid", "left").join(group, "cid", "left")
    table = table.select(
        "cid", "first", F.coalesce("group", "cid").alias("group"),
        (F.coalesce("links", F.lit(0)) + F.when(F.col("alike"), F.col("many") - 1).otherwise(0)).alias("links"),
    ).where("links > 0")
    head = table.groupBy("group").agg(F.min("first").alias("head"))
    table = table.join(head, "group").select("cid", "head", "links")
    return members.join(table, "cid").select("doc_id", "txt", F.col("head.doc_id").alias("class_id"), F.col("head.txt").alias("class_txt"), "links")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): every document with a Jaccard index >= threshold with another, over word n-gram sets; see the module for edge cases."""
    return classes(docs, n, threshold).select("doc_id", "class_id", "links")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays, the one with the least doc_id (among texts of that doc_id: with the least hash).

    Rows without a doc_id or without words stay, and so do documents without links.  Rows that repeat a doc_id and its text stay or go
    together; another text of the same doc_id is a document of its own.  An empty table gives an empty one.  Columns are those of `docs`,
    whatever their names.
    """
    gone = classes(docs, n, threshold).where("doc_id <> class_id or txt <> class_txt")
    d, t = T.fresh(docs, "doc"), T.fresh(docs, "txt")
    gone = T.materialize(gone.select(F.col("doc_id").alias(d), F.col("txt").alias(t)))  # else all of it is planned and run at once with the join: the driver's largest job
    return docs.join(gone, (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left_anti")
