"""Quality by importance resampling: target and raw models of hashed n-grams, sampled by Gumbel top-k.

The words and word pairs of a text are hashed into buckets.  The raw model
counts the buckets of all documents, the target model those of documents
labelled as of good quality (a bounded sample of them, the bound a parameter),
smoothed towards the raw one.  A document's log weight is the sum of its
buckets' log ratios; adding Gumbel noise and keeping the k greatest keys draws k
documents without replacement in proportion to their weights.  k is the share
of good ones among the labels, times the documents.  The k-th greatest key is
found exactly by counting 16 bits of it at a time, without a sort.

Defined results
* null doc_id: the row is left out.  Null or empty text: no n-grams, log weight 0; it takes part in the draw.
* very long texts: whole.
* ties of the key: the lower doc_id goes first; rows that repeat a doc_id and text have one key, and are all kept if one is.
* no labels, or none good: weights are 0, and the draw is uniform with k all documents.
* empty table: no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

BITS = 14
TARGET_ROWS = 20_000
SEED = 3


def buckets(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, offsets): the words of each text, then its word pairs."""
    w = T.Words(text, lower=False)
    h, off = w.hash, w.offsets
    shift = np.uint64(64 - bits)
    one = (h >> shift).astype(np.int64)
    pair = np.zeros(len(h), np.int64)
    if len(h) > 1:
        pair[:-1] = (T.mix(h[:-1] * np.uint64(3) + h[1:]) >> shift).astype(np.int64)
    last = np.zeros(len(h), bool)
    last[off[1:][np.diff(off) > 0] - 1] = True
    both = np.stack([one, pair], 1).reshape(-1)
    keep = np.stack([np.ones(len(h), bool), ~last], 1).reshape(-1)
    n = np.concatenate([[0], np.cumsum(keep)])
    return both[keep], n[2 * off]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(bucket | target) / p(bucket | raw), the target smoothed by a tenth of itself spread as the raw text is."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    p = np.maximum(raw, 1) / np.maximum(raw, 1).sum()
    n, extra = target.sum(), 0.1 * target.sum() + 1
    return np.log((target + extra * p) / ((n + extra) * p)).astype(np.float32)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of a hash of the doc_id."""
    u = ((T.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + T.mix(np.array([seed + 1]))[0]) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
    return -np.log(-np.log(u))


def sortable(key: np.ndarray) -> np.ndarray:
    """Integers in the order of the floats."""
    b = key.astype(np.float64).view(np.int64)
    return np.where(b >= 0, b, b ^ np.int64(0x7FFFFFFFFFFFFFFF))


def kth_greatest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest of a bigint column, exactly; None if there are fewer rows."""
    lo, hi, left = -(1 << 63), (1 << 63) - 1, k
    for bits in (48, 32, 16, 0):
        at = rows.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"shiftright({column}, {bits})").alias("b")).count().collect()
        for r in sorted(at, key=lambda r: -r["b"]):
            if r["count"] >= left:
                lo, hi = r["b"] << bits, (r["b"] << bits) + (1 << bits) - 1
                break
            left -= r["count"]
        else:
            return None
    return lo


def weights(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, rank_key) of every document."""
    docs = T.documents(docs, "doc_id", "text")
    sc = docs.sparkSession.sparkContext
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    ids = good.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_rows)
    chosen = sc.broadcast(np.sort(np.array([r[0] for r in ids.collect()], np.int64)))
    width = 1 << bits

    def count(batches):
        total = np.zeros((2, width), np.int64)
        for batch in batches:
            for piece in T.slices(batch):
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                b, off = buckets(piece.column("text"), bits)
                total[0] += np.bincount(b, minlength=width)
                hit = np.isin(ids, chosen.value)
                if hit.any():
                    total[1] += np.bincount(b[np.repeat(hit, np.diff(off))], minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    total = T.add_up(docs.mapInArrow(count, "blob binary"), 2 * width, np.int64).reshape(2, width)
    ratio = sc.broadcast(log_ratio(total[0].astype(float), total[1].astype(float)))

    def score(batches):
        for batch in batches:
            for piece in T.slices(batch):
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                b, off = buckets(piece.column("text"), bits)
                w = T.seg_sum(ratio.value[b].astype(np.float64), off)
                key = sortable(w + gumbel(ids, seed))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w), pa.array(key)], ["doc_id", "log_weight", "rank_key"])

    return docs.mapInArrow(score, "doc_id bigint, log_weight double, rank_key bigint")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, target_rows: int = TARGET_ROWS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight): the documents drawn; `share` of them all, None for the share of good ones among the labels; see the module for edge cases."""
    rows = T.materialize(weights(docs, labels, target_rows, bits, seed))
    if share is None:
        n, good = labels.agg(F.count("quality"), F.sum(F.expr("if(quality = 1, 1, 0)"))).first()
        share = good / n if n and good else 1.0
    k = round(share * rows.count())
    if k <= 0:
        return rows.where("false").select("doc_id", "log_weight")
    least = kth_greatest(rows, "rank_key", k)
    if least is None:
        return rows.select("doc_id", "log_weight")
    above = rows.where(F.col("rank_key") > least).count()
    tied = rows.where(F.col("rank_key") == least).orderBy("doc_id").select("doc_id").limit(k - above)
    ties = [r[0] for r in tied.distinct().collect()] if rows.where(F.col("rank_key") == least).count() > k - above else None
    last = F.col("rank_key") == least
    if ties is not None:
        last = last & F.col("doc_id").isin(ties)
    return rows.where((F.col("rank_key") > least) | last).select("doc_id", F.round("log_weight", 6).alias("log_weight"))
