"""Vectorised text helpers shared by the corpus operators.

Everything here works on whole Arrow columns: a batch is cut into slices of a
few megabytes, the words of a slice are dictionary-encoded in Arrow, and only
the distinct words are touched again.  Nothing depends on Python's own hash.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SLICE_ROWS = 60_000
_POS = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(
    0, 2**64, size=_POS * 256, dtype=np.uint64, endpoint=False
)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element by element."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets starting at 0."""
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def within(offsets: np.ndarray) -> np.ndarray:
    """Index of every element inside its own list."""
    return np.arange(offsets[-1], dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))


def seg_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum per list; empty lists give 0.  Integers wrap."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def hash_strings(arr: pa.Array) -> np.ndarray:
    """64-bit hash of each string, the same in every process."""
    raw, off = utf8_parts(arr)
    pos, n = within(off), np.diff(off)
    if len(n) and n.max() > _POS:
        v = _TABLE[((pos & (_POS - 1)) << 8) + raw] * ((pos >> 6) * 2 + 1).astype(np.uint64)
    else:
        pos <<= 8
        pos += raw
        v = _TABLE[pos]
    return mix(seg_sum(v, off) + np.uint64(0x9E3779B97F4A7C15) * n.astype(np.uint64))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return to the system what Arrow and the C library hold free: workers are reused, and idle ones keep it from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def stretches(off: np.ndarray, limit: int, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Cut lists so that a piece (from, to) holds about `limit` elements, at least one list, at most `rows`."""
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, at + rows)
        yield at, end
        at = end


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about `limit` bytes of `column`, at least one row; nulls become ''."""
    i = batch.schema.get_field_index(column)
    text = batch.column(i)
    if not pa.types.is_string(text.type):
        text = text.cast(pa.string())
    if text.null_count:
        text = text.fill_null("")
    batch = batch.set_column(i, column, text)
    if not len(batch):
        return
    _, off = utf8_parts(text)
    for at, end in stretches(off, limit):
        yield batch.slice(at, end - at)
    if off[-1] >= limit:
        give_back()


def wide_spaces(arr: pa.Array) -> bool:
    """May a string column hold white space other than the six characters that `ascii_split_whitespace` knows?  True is no promise."""
    raw, _ = utf8_parts(arr)
    if ((raw >= 0x1C) & (raw <= 0x1F)).any():
        return True
    at = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    pad = np.append(raw, np.zeros(2, np.uint8))
    a, b, c = raw[at], pad[at + 1], pad[at + 2]
    space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80)
    space |= (a == 0xE2) & ((b == 0x81) | (b == 0x80) & ((c <= 0x8B) | (c >= 0xA8)))
    return bool(space.any())


class Words:
    """The words of a string column: `codes` into `uniq`, list `offsets`, hashes of the distinct words."""

    def __init__(self, arr: pa.Array, lower: bool = True):
        arr = pc.utf8_lower(arr) if lower else arr
        lists = pc.utf8_split_whitespace(arr) if wide_spaces(arr) else pc.ascii_split_whitespace(arr)
        off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(arr) + 1].astype(np.int64)
        flat = lists.flatten()
        enc = flat.dictionary_encode()
        self.uniq = enc.dictionary
        self.codes = enc.indices.to_numpy(zero_copy_only=False)
        self.offsets = off - off[0]
        blank = np.flatnonzero(np.diff(utf8_parts(self.uniq)[1]) == 0)
        if len(blank):
            keep = self.codes != blank[0]
            n = np.concatenate([[0], np.cumsum(keep)])
            self.codes, self.offsets = self.codes[keep], n[self.offsets]
        self._hash: np.ndarray | None = None

    @property
    def uniq_hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_strings(self.uniq)
        return self._hash

    @property
    def hash(self) -> np.ndarray:
        return self.uniq_hash[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def split_lines(arr: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, row of each line, number of the line in its row) of a string column, split at newlines."""
    lists = pc.split_pattern(arr, "\n")
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(arr) + 1].astype(np.int64)
    off = off - off[0]
    return lists.flatten(), np.repeat(np.arange(len(arr)), np.diff(off)), within(off)


_SPACES = {"space": np.isin(np.arange(256), [32]), "all": np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])}


class Units:
    """A column cut before every white-space run that follows something else: `codes` into `uniq`, row `offsets` and the
    byte where each unit `starts` within the column.  Units joined give the column again.

    A run is not cut off where the character before it might itself be white space, or normalise to it (two bytes from
    C2, three from E1 to EF): such units are longer, which costs time only.
    """

    def __init__(self, arr: pa.Array, spaces: str = "all"):
        raw, self.bytes = utf8_parts(arr)
        white = _SPACES[spaces][raw]
        start = np.zeros(len(raw) + 1, bool)
        if len(raw) > 3:
            at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            b, c = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
            wide = (raw[at - 1] >= 0x80) & ((b == 0xC2) | (c >= 0xE1))
            start[at[~wide]] = True
        start[self.bytes] = True
        self.starts = np.flatnonzero(start)  # the last one is the end
        if self.starts[-1] != len(raw):
            self.starts = np.append(self.starts, len(raw))
        self.offsets = np.searchsorted(self.starts, self.bytes)
        n = len(self.starts) - 1
        units = pa.StringArray.from_buffers(n, pa.py_buffer(self.starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        enc = units.dictionary_encode()
        self.uniq, self.codes = enc.dictionary, enc.indices.to_numpy(zero_copy_only=False)


def expand(values: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists (values, off) of the codes in turn: (index into values, offsets of the result)."""
    n = np.diff(off)[codes]
    o = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(off[:-1][codes] - o[:-1], n) + np.arange(o[-1]), o


def sampled(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows, chosen by a hash of doc_id: a bounded sample, the same in every run."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys, with the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], cut, [len(sorted_keys)]]).astype(np.int64)


def pairs_of(off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every i < j inside each run, a bounded number at a time."""
    n = np.diff(off)
    # one row per (element, number of later elements in its run)
    later = np.repeat(off[1:], n) - np.arange(off[0], off[-1]) - 1
    at, total = 0, np.concatenate([[0], np.cumsum(later)])
    while at < len(later):
        end = max(at + 1, int(np.searchsorted(total, total[at] + 4_000_000, "right")) - 1)
        k = later[at:end]
        if k.sum():
            i = np.repeat(np.arange(at, end), k)
            o = np.concatenate([[0], np.cumsum(k)])
            yield i + off[0], i + off[0] + 1 + (np.arange(o[-1]) - np.repeat(o[:-1], k))
        at = end


def as_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


def as_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column cut from one byte array."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.uint8))]
    )


def from_bytes(column, kind) -> np.ndarray:
    """One array from a column of blobs."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def planes(values: np.ndarray) -> bytes:
    """The bytes of the values, all first bytes before all second ones and so on: what is zero or alike compresses."""
    k = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, k).T.tobytes()


def from_planes(column, kind) -> np.ndarray:
    """One array from a column of `planes`."""
    k = np.dtype(kind).itemsize
    parts = [np.frombuffer(x, np.uint8).reshape(k, -1) for x in column.to_pylist() if x]
    return np.ascontiguousarray(np.concatenate(parts, 1).T).view(kind).reshape(-1) if parts else np.zeros(0, kind)


def small_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each; the first byte tells how many."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def read_small_ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 8: np.uint64}[blob[0]], offset=1).astype(np.int64)


def low_bytes(values: np.ndarray, k: int) -> bytes:
    """The k low bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]).tobytes()


def read_low_bytes(blob: bytes, k: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, k)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :k] = raw
    return out.reshape(-1).view("<u8")


def trim_driver(spark: SparkSession) -> bool:
    """Return to the system what the driver's C library holds free, in Python and in the JVM (as `jcmd System.trim_native_heap`); False where that JVM can't."""
    give_back()
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    kinds, args = array(jvm.Class, 4), array(jvm.Object, 4)
    try:
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by reflection: the server's class is not open, its interface is
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # no such command
        return False
    return True


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected.  What that frees goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the one that the cluster names, else a temporary one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, of rows that have a doc_id; other columns never reach Python."""
    return docs.where(F.col("doc_id").isNotNull()).select(*[F.col(c) for c in columns])


def add_up(df: DataFrame, width: int, dtype) -> np.ndarray:
    """Sum the partial vectors (blob) that the partitions of `df` give, in a tree, and bring one vector to the driver.

    Its length is fixed by a parameter, whatever the size of the corpus.
    """
    kind = np.dtype(dtype)

    def total(batches):
        out = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_py(), kind)
                out = v.copy() if out is None else out + v
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["blob"])

    if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 512:
        df = df.repartition(512).mapInArrow(total, "blob binary")
    df = df.repartition(12).mapInArrow(total, "blob binary")
    got = [np.frombuffer(r[0], kind) for r in df.collect()]
    return sum(got[1:], got[0].copy()) if got else np.zeros(width, kind)


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share."""
    shared_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
