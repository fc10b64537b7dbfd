"""Operator 8, SimHash near-duplicates with BK-trees.

Two fingerprints within the radius agree in one of radius + 1 blocks of their bits at least (pigeonhole), so the value of
each block names a shard in which they meet. A shard with more than SHARD_MAX fingerprints is split in the same way by
further blocks of the bits that are still free, level by level; with LAST free bits it has 2 ** LAST fingerprints at most,
so every shard ends as a BK-tree of bounded size, however many fingerprints there are. A shard's tree is built where its
fingerprints meet (all trees together grow with the corpus, so they are never gathered on the driver), and a search
follows only edges whose distance lies within the radius of the query's. Fingerprints are compared in all their bits.

Defined results: null text counts as empty; a text without words has fingerprint zero; rows of equal text share a
fingerprint; a null doc_id keeps its row, and a component of null ids alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinframe.llm.common import LOWER, NON_SPACE, blocks, components, cut, documents, mix, spans, xxh64_spans

RADIUS, SHINGLE, SHARD_MAX, LAST = 2, 3, 1024, 10
#: of near copies in the pipeline; a pair at the similarity shares one of the bands of minima at least with probability 0.9993
COPY_SHINGLE, SIMILARITY, BAND_ROWS, BANDS, PARTS = 5, 0.8, 6, 24, 64
#: keys and bytes of shingles that a side of a tile holds on average
TILE_KEYS, TILE_BYTES = 256, 2 << 20
#: bytes of text whose shingles are made at a time; a longer text stands alone
BLOCK = 1 << 20


def shingles(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and each text's first (n + 1); fewer words than `shingle` make one."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # the words of all texts, each followed by one space
    lengths = ends - starts
    new_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(new_starts[-1], 32, np.uint8)
    keep = np.ones(new_starts[-1], bool)
    keep[new_starts[1:] - 1] = False
    joined[keep] = buf[NON_SPACE[buf]]
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    base = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(base[-1]) - np.repeat(base[:-1] - first[:-1], count)
    last = np.minimum(at + shingle, np.repeat(first[1:], count))
    return xxh64_spans(joined, new_starts[at], new_starts[last] - 1 - new_starts[at]), base


def fingerprint_block(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text of a flat buffer."""
    return simhashes(*shingles(buf, offsets, shingle))


def simhashes(h: np.ndarray, base: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes; base: where each begins (n + 1). A run without any has zero."""
    count = np.diff(base)
    full = np.flatnonzero(count)
    begin = base[full]
    ones = np.zeros((len(full), 64), np.int64)
    for lo in range(0, len(h), 1 << 17):  # bits of a bounded number of shingles at a time, so that a long text takes several
        part = h[lo : lo + (1 << 17)]
        a, b = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, lo + len(part))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[a:b] += np.add.reduceat(bits, np.maximum(begin[a:b] - lo, 0), axis=0, dtype=np.int32)
    out = np.zeros(len(count), np.uint64)
    major = (2 * ones > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each row as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprint_block(buf, offsets).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, fp long")


class BKTree:
    """Nodes keyed by the Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ x).bit_count()
            if d <= radius:
                found.append(node)
            kids = self.children[node]
            if kids:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def insert(self, x: int) -> int:
        new = len(self.values)
        self.values.append(x)
        self.children.append({})
        node = 0
        while new:
            d = (self.values[node] ^ x).bit_count()
            if d not in self.children[node]:
                self.children[node][d] = new
                break
            node = self.children[node][d]
        return new


def link_shard(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest of the links of one shard that the BK-tree finds within the radius."""
    tree, parent, out = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in values:
        near = tree.search(x, radius)
        me = tree.insert(x)
        parent.append(me)
        for other in near:
            if (r := root(other)) != root(me):
                parent[r] = root(me)
                out.append((x, values[other]))
    return out


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by path and shard: each shard's links. Shards are bounded, so the rest carried on is small."""

    def emit(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        links = [x for a, b in zip([0, *edges], [*edges, len(keys)], strict=True) if b - a > 1 for x in link_shard(fps[a:b].view(np.uint64).tolist())]
        if links:
            both = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    rest_k, rest_f = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([rest_k, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("path", "shard")])])
        fps = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        start = len(keys) - int((keys == keys[-1]).all(axis=1).sum())
        yield from emit(keys[:start], fps[:start]) if start else ()
        rest_k, rest_f = keys[start:], fps[start:]
    if len(rest_k):
        yield from emit(rest_k, rest_f)


def split(free: list[int], radius: int = RADIUS) -> list[tuple[list[int], list[int]]]:
    """The ways to agree in one of radius + 1 blocks of the free bits: (bits of the block, bits still free)."""
    blocks_ = [x.tolist() for x in np.array_split(free, radius + 1)]
    return [(own, [bit for other in blocks_ if other is not own for bit in other]) for own in blocks_]


def links(fps: DataFrame, shard_max: int = SHARD_MAX, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among distinct fingerprints `fp` whose components are those of all pairs within the radius."""
    spark = fps.sparkSession
    #: path -> (bits agreed, bits free); paths of one level have equally many free bits, but for one
    paths: dict[int, tuple[int, list[int]]] = {0: (0, list(range(64)))}
    rows, parts = fps.select("fp", F.lit(0).alias("path")), []
    while True:
        deeper, steps = {}, []
        for path, (mask, free) in paths.items():
            for own, left in split(free, radius):
                new = len(deeper)
                deeper[new] = (mask | sum(1 << bit for bit in own), left)
                steps.append((path, new, deeper[new][0] - (1 << 64 if deeper[new][0] >> 63 else 0)))
        paths = deeper
        table = F.broadcast(spark.createDataFrame(steps, "path int, next int, mask long"))  # (radius + 1) ** level rows, of a few levels
        keyed = rows.join(table, "path").select("fp", F.col("next").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("shard"))
        sizes = cut(keyed.groupBy("path", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        last = max(len(free) for _, free in paths.values()) <= LAST
        fits = sizes if last else sizes.where(F.col("n") <= shard_max)
        met = keyed.join(fits.select("path", "shard"), ["path", "shard"]).repartition("path", "shard").sortWithinPartitions("path", "shard", "fp")
        parts.append(met.select("fp", "path", "shard").mapInArrow(_shard_links, "a long, b long"))
        if last or sizes.where(F.col("n") > shard_max).isEmpty():
            return reduce(DataFrame.unionByName, parts)
        rows = cut(keyed.join(sizes.where(F.col("n") > shard_max).select("path", "shard"), ["path", "shard"], "left_semi").select("fp", "path"), "full")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id): one row per input row."""
    fp = cut(fingerprints(docs, id_col, text_col), "simhash")
    distinct = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    roots = components(links(distinct.select("fp")))
    own = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = own.groupBy("root").agg(F.min("low").alias("component_id"))
    of = own.join(ids, "root").select("fp", "component_id")
    return fp.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------------------------------------------------------------
# the pipeline's stage: near copies by the Jaccard index of word shingles
#
# A fingerprint of 64 bits can't serve here: at a Jaccard index of 0.8 two fingerprints differ in 9.7 bits on average (the
# angle between the shingle sets is 27 degrees, 0.15 of a half turn) and in up to 20, and no blocks of bits that such pairs
# share with near certainty are long enough to keep others apart. Candidates therefore share bands of minima over the
# shingles, and the index itself is counted.


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = COPY_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in rising order, one text after the other, where each text's begin (n + 1), and a key of each set."""
    h, base = shingles(buf, offsets, shingle)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(base))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    first = np.searchsorted(text, np.arange(len(offsets)))
    sums = np.append(np.uint64(0), np.cumsum(mix(h)))
    return h, first, mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def bands(h: np.ndarray, first: np.ndarray, rows: int = BAND_ROWS, n: int = BANDS) -> np.ndarray:
    """(sets, n): a hash of each band of `rows` minima over a set; an empty set has zeros."""
    out = np.zeros((len(first) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    multipliers, shifts = np.random.RandomState(42).randint(1, 1 << 62, (2, n * rows)).astype(np.uint64)
    for k in range(n):
        key = np.full(len(full), k, np.uint64)
        for m in range(k * rows, (k + 1) * rows):
            x = (h ^ shifts[m]) * (2 * multipliers[m] + np.uint64(1))
            key = mix(key + np.minimum.reduceat(x ^ (x >> np.uint64(32)), first[full]))
        out[full, k] = key
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) pairs of keys whose sets reach the similarity, counted exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(both) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those of the links (a, b) that join two classes when taken in turn; they join as much as all of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            out.append((x, y))
    return out


def tile_links(rows: pa.Table, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between the roots of one tile's keys: the exact index of each key of part `lo` with each of part `hi`.

    Common shingles are counted as a product of incidence matrices, some columns at a time; a shingle of one key adds nothing.
    """
    root, part, lo, hi = (rows.column(c).to_numpy() for c in ("root", "part", "lo", "hi"))
    if (root == root[0]).all():
        return []
    items = rows.column("items").to_pylist()
    size = np.array([len(x) // 8 for x in items])
    owner = np.repeat(np.arange(len(items)), size)
    _, column, count = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    common = np.zeros((len(a), len(b)))
    for first in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(column, [first, first + 4096])
        held = np.zeros((len(items), 4096), np.float32)
        held[owner[x:y], column[x:y] - first] = 1
        common += held[a] @ held[b].T
    near = common >= similarity * (size[a][:, None] + size[b][None, :] - common) - 1e-9
    x, y = np.nonzero(near & (root[a][:, None] != root[b][None, :]))
    both = np.unique(np.sort(np.column_stack([root[a[x]], root[b[y]]]), axis=1), axis=0)
    return forest(both[:, 0].tolist(), both[:, 1].tolist())


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by tile: each tile's links. A tile is bounded, so what is carried on is small."""

    def links_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1 and (found := tile_links(pa.Table.from_batches(held))):
            both = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.column_stack([batch.column(c).to_numpy() for c in ("band", "lo", "hi")])
        edges = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *edges], [*edges, len(tile)], strict=True):
            if held and tuple(tile[begin]) != at:
                yield from links_of(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            at = tuple(tile[begin])
    yield from links_of(held) if held else ()


def apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of SIMILARITY or more between the roots of keys that share a band; `members` are (band, key, root).

    A band's keys are dealt into parts of a bounded size and each two parts meet in a tile of their own, so no band is
    gathered in one task, and a tile gives a forest of its links and no pairs. Bands of just the same keys (by
    number, bytes and a sum of 64-bit hashes) count once.
    """
    sized = members.join(sets.select("key", F.octet_length("items").alias("bytes")), "key")
    bands_ = sized.groupBy("band").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("same"),
    ).where("least < most")
    parts = F.ceil(F.greatest(F.col("n") / TILE_KEYS, F.col("bytes") / TILE_BYTES, F.lit(1.0))).cast("int").alias("parts")
    once = bands_.groupBy("same", "n", "bytes").agg(F.min("band").alias("band")).select("band", parts)
    dealt = members.join(once, "band").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    tiled = dealt.select("band", "key", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiled = tiled.select("band", "key", "root", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    met = tiled.join(sets, "key").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return met.select("band", "lo", "hi", "root", "part", "items").mapInArrow(_tiles, "a long, b long")


def tree_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of `keyed` (key, fp) from the BK-trees of the fingerprints. Keys of one fingerprint are dealt into parts:
    each meets the least of its part, and that the least of all."""
    parted = keyed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    lows = cut(parted.groupBy("fp", "part").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")), "copy_fingerprints")
    least = lows.groupBy("fp").agg(F.min("low").alias("least"))
    same = parted.join(lows.where("n > 1"), ["fp", "part"]).where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    parts = lows.join(least, "fp").where("low <> least").select(F.col("low").alias("a"), F.col("least").alias("b"))
    at = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key"))
    near = cut(links(least.select("fp")), "tree_links").distinct().join(at("a"), "a").join(at("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    return cut(same.unionByName(parts).unionByName(near), "tree_pairs")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root): one row per input row; rows share a root just if candidate pairs of SIMILARITY or more join them.

    Rows of one shingle set share a key, and keys have a SimHash of the same shingles. Candidates come from the fingerprints' BK-trees:
    keys of one fingerprint, each with the least of them, and the least keys of two fingerprints that a tree links. Those that a
    tree can't reach share a band. In a band each key is compared with the least of its part and that with the least of all.
    All candidates are held to the exact index. The keys of bands that these links don't join as a whole are compared in tiles.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text", BLOCK):
            h, first, key = shingle_sets(buf, offsets)
            found = pa.array(bands(h, first).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * BANDS), found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key.view(np.int64)), pa.array(simhashes(h, first).view(np.int64)), lists], ["doc_id", "key", "fp", "bands"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in blocks(batches, "text", BLOCK):
            h, first, key = shingle_sets(buf, offsets)
            items = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(items, pa.binary())], ["key", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sign = cut(texts.mapInArrow(signed, "doc_id long, key long, fp long, bands array<long>"), "bands")
    keyed = sign.select("key", F.explode("bands").alias("band")).distinct()
    sizes = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    met = cut(keyed.join(sizes.select("band", "least"), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), "met")
    low = met.groupBy("band", "part").agg(F.min("key").alias("low"), F.first("least").alias("least"))
    pairs = met.join(low.select("band", "part", "low"), ["band", "part"]).select(F.col("key").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("low").alias("a"), F.col("least").alias("b")))
    trees = tree_pairs(sign.select("key", "fp").distinct())
    pairs = pairs.unionByName(trees)
    wanted = met.select("key").unionByName(trees.select(F.col("a").alias("key"))).unionByName(trees.select(F.col("b").alias("key"))).distinct()
    sets = cut(texts.select("text").mapInArrow(listed, "key long, items binary").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("items").alias("items")), "sets")
    some = cut(confirmed(pairs.where("a <> b").distinct(), sets), "links")
    rooted = cut(met.select("band", "key").join(components(some), F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root")), "rooted")
    roots = cut(components(some.unionByName(cut(apart(rooted, sets), "apart"))), "roots")
    return sign.select("doc_id", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents' columns, one row of each component of near copies: the one with its smallest doc_id.

    Rows count, not ids: of rows with one doc_id each stands for its own text's component. Where the smallest doc_id has several
    rows in a component, the least key and then the least text stay. Null ids are left as they are.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text", BLOCK):
            key = shingle_sets(buf, offsets)[2]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key.view(np.int64))], [*part.schema.names, "key__"])

    rows = cut(near_copies(docs).where("doc_id IS NOT NULL").groupBy("doc_id", "key", "root").agg(F.count(F.lit(1)).alias("n")), "copies")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("low")).select("root", F.col("low.doc_id").alias("low_id"), F.col("low.key").alias("low_key"))
    told = cut(rows.join(kept, "root").withColumn("stays", (F.col("doc_id") == F.col("low_id")) & (F.col("key") == F.col("low_key"))), "components")
    keyed = docs.mapInArrow(task, StructType([*docs.schema.fields, StructField("key__", LongType())]))
    at = [F.col("doc_id").cast("long") == F.col("doc_id__"), F.col("key__") == F.col("same__")]
    names = lambda df: df.select(F.col("doc_id").alias("doc_id__"), F.col("key").alias("same__"))
    left = keyed.join(names(told.where("NOT stays")), at, "left_anti")
    twice = names(told.where("stays AND n > 1"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    first = Window.partitionBy("doc_id", "key__").orderBy("text", *[F.col(c).cast("string") for c in docs.columns if c != "text"])
    again = left.join(twice, at, "left_semi").withColumn("row__", F.row_number().over(first)).where("row__ = 1")
    return left.join(twice, at, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
