"""Operator 9, benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits, compared by 64-bit hashes (two tokens agree by chance in one of 10**19
pairs). Documents meet benchmark items on shared seeds: runs of MIN_MATCH tokens. Only seeds whose tokens before differ begin
a match, so a match is met once, however long it is and however often its tokens repeat; it is extended by running
Karp-Rabin hashes, doubling steps first. Matches are marked longest first without overlap on either side, token by token, so
that reordered passages still count. An item leaks into a document if the tiles cover at least COVERAGE of its tokens.

The items' seeds are broadcast as one index of about MAX_SEEDS seeds; a larger benchmark is handled in several such blocks of
items, each against all documents and written before the next is read.
Defined results: null or empty texts share nothing; an item shorter than MIN_MATCH tokens must occur as a whole, one
without tokens never matches; equal items each give their own row; repeated documents give repeated rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import LOWER, TOKEN, Members, blocks, cut, documents, flat, mix, ngrams, spans, xxh64_spans

MIN_MATCH, COVERAGE, MAX_SEEDS, MAX_PAIRS = 5, 0.8, 400_000, 2_000_000
#: what stands before a text's and an item's first token: never equal
_TEXT_START, _ITEM_START = np.uint64(1), np.uint64(2)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, and each text's first token (n + 1)."""
    buf = LOWER[buf]
    starts, ends, first = spans(buf, offsets, TOKEN)
    return xxh64_spans(buf, starts, ends - starts), first


class Rolling:
    """Karp-Rabin hashes of all runs of an array of token hashes."""

    def __init__(self, h: np.ndarray):
        power = np.full(len(h) + 1, _BASE, np.uint64)
        inverse = np.full(len(h) + 1, _INVERSE, np.uint64)
        power[0] = inverse[0] = 1
        self.sums = np.append(np.uint64(0), np.cumsum(h * np.cumprod(power)[: len(h)]))
        self.inverse = np.cumprod(inverse)

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]


def extend(a: Rolling, i: np.ndarray, b: Rolling, j: np.ndarray, size: int, most: np.ndarray) -> np.ndarray:
    """Lengths of the matches that begin at i and j, `size` at least and `most` at most."""
    n = np.full(len(i), size, np.int64)
    step = 1 << int(most.max(initial=1)).bit_length()
    while step:
        at = np.flatnonzero(n + step <= most)
        at = at[a(i[at] + n[at], step) == b(j[at] + n[at], step)]
        n[at] += step
        step >>= 1
    return n


def greedy(doc: np.ndarray, item: np.ndarray, runs: Iterator[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item position, document position) from the maximal matches, given likewise."""
    heap = [(-n, j, i) for n, j, i in runs if (doc[i : i + n] == item[j : j + n]).all()]
    heapq.heapify(heap)
    out, in_doc, in_item, left = [], np.zeros(len(doc), bool), np.zeros(len(item), bool), len(item)
    while heap and left >= size:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = ~(in_item[j : j + n] | in_doc[i : i + n])
        if free.all():
            in_item[j : j + n] = in_doc[i : i + n] = True
            out.append((n, j, i))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(free, prepend=False, append=False))  # what is left of it between marked tokens
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= size:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return out


class Index:
    """Seeds of a block of items: by their run of tokens, and those of one run by the token before."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int = MIN_MATCH):
        arr = pa.array([t or "" for _, t in items], pa.string())
        self.h, self.first = tokens(*flat(arr))
        self.rolling = Rolling(self.h)
        self.ids = [i for i, _ in items]
        lengths = np.diff(self.first)
        before = np.append(_ITEM_START, self.h[:-1]) if len(self.h) else self.h
        before[self.first[:-1][lengths > 0]] = _ITEM_START
        self.seeds = {}
        for size in sorted({min(min_match, n) for n in lengths.tolist() if n}):
            of = np.flatnonzero(np.minimum(lengths, min_match) == size)
            where = np.concatenate([np.arange(self.first[k], self.first[k + 1] - size + 1) for k in of])
            keys = ngrams(self.h, size)[where]
            order = np.lexsort((before[where], keys))
            where, keys = where[order], keys[order]
            distinct, begin = np.unique(keys, return_index=True)
            both = mix(keys + mix(before[where]))
            edge = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            self.seeds[size] = (Members(distinct), np.append(begin, len(keys)), Members(both[edge]), np.append(edge, len(keys)), where)

    def starts(self, size: int, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, document position, seed position) of the seeds that begin a match, for a bounded number of them at a time (or one
        place of a text), in order of rows."""
        members, begin, pairs, edges, where = self.seeds[size]
        at, key = members.find(ngrams(h, size))
        row = np.searchsorted(first, at, "right") - 1
        inside = at + size <= first[row + 1]  # a run must not cross into the next text
        at, key, row = at[inside], key[inside], row[inside]
        if not len(at):
            return
        before = np.where(at > first[row], h[np.maximum(at - 1, 0)], _TEXT_START)
        hit, which = pairs.find(mix(members.keys[key] + mix(before)))
        # of a run's seeds those with the same token before are left out: a match through them begins further left
        skip_from, skip_to = begin[key + 1].copy(), begin[key + 1].copy()
        skip_from[hit], skip_to[hit] = edges[which], edges[which + 1]
        n = skip_from - begin[key] + begin[key + 1] - skip_to
        upto, lo = np.append(0, np.cumsum(n)), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + MAX_PAIRS, "right")) - 1)
            m = n[lo:hi]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            own = np.repeat(np.arange(lo, hi), m)
            seed = begin[key[own]] + nth
            seed += np.where(seed >= skip_from[own], skip_to[own] - skip_from[own], 0)
            yield row[own], at[own], where[seed]
            lo = hi

    def scan(self, buf: np.ndarray, offsets: np.ndarray, coverage: float) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item index, coverage, covered tokens, tiles, longest tile) of each leak in a block of texts."""
        h, first = tokens(buf, offsets)
        rolling = None
        out = []
        for size in self.seeds:
            wait: list[tuple[np.ndarray, ...]] = []
            for row, at, seed in self.starts(size, h, first):
                rolling = rolling or Rolling(h)
                item = np.searchsorted(self.first, seed, "right") - 1
                n = extend(rolling, at, self.rolling, seed, size, np.minimum(first[row + 1] - at, self.first[item + 1] - seed))
                wait.append((row, item, at, seed, n))
                # all rows but the last are whole
                row, item, at, seed, n = (np.concatenate(x) for x in zip(*wait, strict=True))
                done = int(np.searchsorted(row, row[-1])) if len(row) else 0
                out += self._leaks(size, *(x[:done] for x in (row, item, at, seed, n)), h, first, coverage)
                wait = [tuple(x[done:] for x in (row, item, at, seed, n))]
            if wait:
                out += self._leaks(size, *wait[0], h, first, coverage)
        return out

    def _leaks(self, size: int, row: np.ndarray, item: np.ndarray, at: np.ndarray, seed: np.ndarray, n: np.ndarray, h: np.ndarray, first: np.ndarray, coverage: float) -> list[tuple[int, int, float, int, int, int]]:
        """The leaks of the rows whose matches are given."""
        out = []
        if not len(row):
            return out
        order = np.lexsort((at, item, row))
        row, item, at, seed, n = (x[order] for x in (row, item, at, seed, n))
        edges = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
        for a, b in zip(edges, [*edges[1:], len(row)], strict=True):
            r, k = int(row[a]), int(item[a])
            own = self.h[self.first[k] : self.first[k + 1]]
            j = seed[a:b] - self.first[k]
            could = np.zeros(len(own) + 1, np.int64)
            np.add.at(could, j, 1)
            np.add.at(could, j + n[a:b], -1)
            if (np.cumsum(could)[:-1] > 0).sum() < coverage * len(own):
                continue  # even all matches together cover too little
            doc, i = h[first[r] : first[r + 1]], at[a:b] - first[r]
            tiles = greedy(doc, own, zip(n[a:b].tolist(), j.tolist(), i.tolist(), strict=True), size)
            covered = sum(t[0] for t in tiles)
            if covered >= coverage * len(own):
                out.append((r, k, covered / len(own), covered, len(tiles), tiles[0][0]))
        return out


def item_blocks(items: DataFrame, min_match: int, max_seeds: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of blocks of items (item_id, text), and whether more follow; one block, bounded in size, is on the driver at a time."""
    words = items.select(F.col("item_id"), "text", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    n = int(total // (2 * max_seeds)) + 1  # a token and its separator have two characters at least
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield Index([(r.item_id, r.text) for r in words.where(of == i).collect()], min_match), i + 1 < n


def leaks(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_id, item_id, coverage, covered_tokens, n_tiles, longest_tile) of each document and item that it leaks."""
    parts = []
    for index, more in item_blocks(items, min_match, max_seeds):

        def task(batches: Iterator[pa.RecordBatch], share=docs.sparkSession.sparkContext.broadcast(index)) -> Iterator[pa.RecordBatch]:
            index = share.value
            for part, buf, offsets in blocks(batches, "text"):
                if found := index.scan(buf, offsets, coverage):
                    rows, which, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), pa.array([index.ids[k] for k in which], pa.int64()), pa.array(rest[0]), *[pa.array(x, pa.int64()) for x in rest[1:]]], ["doc_id", "item_id", "coverage", "covered_tokens", "n_tiles", "longest_tile"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, item_id long, coverage double, covered_tokens long, n_tiles long, longest_tile long")
        parts.append(cut(part, "leaks") if more else part)
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The documents' columns, without documents that leak an item."""
    out = docs
    for index, more in item_blocks(items, min_match, max_seeds):

        def task(batches: Iterator[pa.RecordBatch], share=docs.sparkSession.sparkContext.broadcast(index)) -> Iterator[pa.RecordBatch]:
            index = share.value
            for part, buf, offsets in blocks(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, *_ in index.scan(buf, offsets, coverage)]] = False
                yield part.filter(pa.array(keep))

        out = out.mapInArrow(task, docs.schema)
        out = cut(out, "clean") if more else out
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
