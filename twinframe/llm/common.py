"""Shared helpers: the cluster's shared folder, lineage cuts, and vectorised text kernels used inside Arrow tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a folder of our own only where it is unset and all runs on this
    machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="twinframe-shared-")
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/twinframe/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs survive lost executors and recompute nothing above."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a cut that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def same(a: str, b: str, columns: list[str]) -> Column:
    """All columns of the aliases `a` and `b` agree; null agrees with null."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with i (long, from 0: place among the rows of a `by` group, ascending by `order`, nulls first) and n (rows of the group).

    No group is gathered: rows are dealt by ranges and written, then only counts by range are summed. Rows that agree in all of
    `by` and `order` come in any order.
    """
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("at_", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("range_", F.shiftright("at_", 33)), name)
    sizes = placed.groupBy(*by, "range_").agg(F.count(F.lit(1)).alias("rows_"), F.min("at_").alias("low_"))
    group = Window.partitionBy(*by)  # a row for each range that has some of the group
    before = F.coalesce(F.sum("rows_").over(group.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "range_", (before - F.col("low_")).alias("shift_"), F.sum("rows_").over(group).alias("n"))
    kept = [F.col(f"p.{c}") for c in df.columns]
    return placed.alias("p").join(sizes.alias("s"), same("p", "s", [*by, "range_"])).select(*kept, (F.col("at_") + F.col("shift_")).alias("i"), "n")


# ---------------------------------------------------------------------------------------------------------------------
# kernels on the flat UTF-8 buffer of an Arrow text column

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes that are no white space
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: bytes of alphanumeric tokens: ASCII letters and digits, and every byte of a non-ASCII character
TOKEN = np.zeros(256, dtype=bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
#: as TOKEN without digits
LETTER = TOKEN.copy()
LETTER[48:58] = False


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def trim() -> None:
    """Give memory that is free back to the system: a worker's next task starts without what the last one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library knows it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 6 << 20):
    """Slices of the batches with about `max_bytes` of text (a longer text stands alone), with their flat texts."""
    for batch in batches:
        _, offsets = flat(batch.column(text_col))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield part, *flat(part.column(text_col))
            lo = hi
    trim()


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` bytes that never cross a text's end: starts, ends, and each text's first run (n + 1)."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    keep = inside[buf]
    first = np.empty(len(buf), bool)
    first[0], first[1:] = True, ~keep[:-1]
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    last = np.empty(len(buf), bool)
    last[-1], last[:-1] = True, first[1:] | ~keep[1:]
    starts, ends = np.flatnonzero(first & keep), np.flatnonzero(last & keep) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# fixed values: the published primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, computed length by length; the rare ranges over 255 bytes one by one."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    clipped = np.minimum(lengths, 256).astype(np.uint16)
    order = np.argsort(clipped, kind="stable")
    ends = np.cumsum(np.bincount(clipped, minlength=257))
    seed64 = np.uint64(seed)
    for size in np.flatnonzero(np.diff(ends, prepend=0)):
        at = order[ends[size - 1] if size else 0 : ends[size]]
        if size == 256:
            out[at] = [xxhash.xxh64_intdigest(buf[s : s + n].tobytes(), seed) for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)]
            continue
        pos, left = starts[at], int(size)
        if left >= 32:
            acc = [np.full(len(at), x, np.uint64) for x in ((seed + int(_P1) + int(_P2)) % 2**64, (seed + int(_P2)) % 2**64, seed, (seed - int(_P1)) % 2**64)]
            while left >= 32:
                acc = [_rot(a + u64[pos + 8 * i] * _P2, 31) * _P1 for i, a in enumerate(acc)]
                pos, left = pos + 32, left - 32
            h = reduce(np.add, (_rot(a, n) for a, n in zip(acc, (1, 7, 12, 18), strict=True)))
            for a in acc:
                h = (h ^ (_rot(a * _P2, 31) * _P1)) * _P1 + _P4
            h = h + np.uint64(size)
        else:
            h = np.full(len(at), (int(seed64) + int(_P5) + int(size)) % 2**64, np.uint64)
        while left >= 8:
            h = _rot(h ^ (_rot(u64[pos] * _P2, 31) * _P1), 27) * _P1 + _P4
            pos, left = pos + 8, left - 8
        if left >= 4:
            h = _rot(h ^ (u32[pos].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos, left = pos + 4, left - 4
        for _ in range(left):
            h = _rot(h ^ (padded[pos].astype(np.uint64) * _P5), 11) * _P1
            pos = pos + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, by first position (len - n + 1, at least 0)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = mix(out + words[i : i + size] + np.uint64(i + 1))
    return out


class Members:
    """A fixed set of 64-bit keys with their positions; a bitmap answers most misses in one look."""

    BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self._slot(self.keys)] = True

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * _P1) >> np.uint64(64 - self.BITS)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of members, and for each the index of (the first of) its key."""
        at = np.flatnonzero(self.map[self._slot(x)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.sorted, x[at]), len(self.sorted) - 1)
        hit = self.sorted[where] == x[at]
        return at[hit], self.order[where[hit]]


# ---------------------------------------------------------------------------------------------------------------------
# connected components


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, root): the smallest node reachable. Nodes without a link are absent.

    Alternating large and small stars; each round is written to the shared folder. A hub's links are never gathered in
    one group: its minimum is a partial aggregate, joined back (which adaptive execution may split).
    """

    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        return pairs.join(low, "a")

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = star(large)
        small = down.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b")))
        now = cut(small.where("a <> b").distinct(), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = new
