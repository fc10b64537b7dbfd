"""Operator 7, exact substring dedup: every byte under a 100-byte string that also starts earlier is removed.

Dealing the work out: each 100-byte window names the 36-byte string with the smallest hash inside it (a function of the
window's content, so equal windows name equal strings); a stretch of windows with one such anchor is a fragment, and
fragments meet by anchor, in buckets whose number grows with the input. Copies of a fragment in one block of texts are
compared byte by byte and collapse to their earliest place. The texts of an anchor's fragments, and of fragments that occur
again the first two places, are gathered by anchor, and each task finds their repeats on a Burrows-Wheeler transform by
threshold-bounded interval expansion: breadth-first backward extension sets the common-prefix lengths of neighbouring
suffixes by increasing value and stops at the minimum length, so that boundaries still open then join suffixes that share a
whole window. A third and later place of a fragment is the first two's copy by its 64-bit content hash within one anchor
(a chance agreement needs 10**9 fragments of one anchor) and is removed where the first two agree in their bytes.

An anchor with more than HOT distinct fragments is no group at all: its windows are keyed one by one by a 128-bit hash and
meet in a partial aggregate. Anchors that would already be too many records for the task they meet in (over WIDE, or over
the share that MAX_WIDE anchors can have at most, by a sample of the documents) are told before and never meet: their
windows are keyed where they are. Which way an anchor goes changes no result.

Order is (doc_id, start). Defined results: null text counts as empty; texts under 100 bytes lose nothing; rows with one
doc_id and equal text are one document (each row gets its result), with different texts they follow each other in order
of a hash; null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import blocks, cut, documents, mix, xxh64_spans

MIN, K, HOT, CHUNK = 100, 36, 20_000, 1 << 20
#: records of one anchor that a task may hold; one in so many documents is looked at for that; so many anchors at most are wide, as
#: each must have its share of all records
WIDE, SAMPLE, MAX_WIDE = 1_000_000, 64, 100_000
_TABLE = np.random.RandomState(7).randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: odd powers that weigh the left half against the right, by its length
_STEP = {size: np.uint64(pow(0xD6E8FEB86659FD93, size, 2**64)) for size in (1, 2, 4, 8, 16, 32)}
_LOW = np.uint64((1 << 24) - 1)
_PIECE = 2 << 20
#: text bytes whose fragments meet in one bucket
BUCKET_BYTES = 32 << 20
_RECORD = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("windows", "<u2")])


def fragments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its text, number of windows, anchor hash, content hash) of each fragment of a block of texts."""
    out = []
    for base in range(0, max(0, len(buf) - MIN + 1), _PIECE):
        seg = buf[base : base + _PIECE + MIN - 1]
        n = len(seg) - MIN + 1
        h, by = _TABLE[seg], {}
        for size in (1, 2, 4, 8, 16):
            by[size] = h
            h = h[:-size] * _STEP[size] + h[size:]
            by[2 * size] = h
        h = by[32][: len(seg) - K + 1] * _STEP[4] + by[4][32 : 32 + len(seg) - K + 1]
        del by
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32, 1):  # minimum over the 65 places of a window
            low = np.minimum(low[:-step], low[step:])
        at = (low & _LOW).astype(np.int64)
        shut = np.zeros(n + 1, np.int32)
        ends = offsets[1:] - base
        ends = ends[(ends > 0) & (ends < len(seg))]  # windows over a text's end
        np.add.at(shut, np.clip(ends - MIN + 1, 0, n), 1)
        np.add.at(shut, np.minimum(ends, n), -1)
        valid = np.cumsum(shut[:-1]) == 0
        first = np.empty(n, bool)
        first[0], first[1:] = True, (at[1:] != at[:-1]) | ~valid[:-1]
        edges = np.flatnonzero(first | ~valid)
        windows = np.diff(np.append(edges, n))
        keep = valid[edges]
        start, windows = edges[keep], windows[keep]
        row = np.searchsorted(offsets, base + start, "right") - 1
        out.append((row, base + start - offsets[row], windows, h[at[start]], xxh64_spans(seg, start, windows + MIN - 1)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def earliest(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (anchor, content, doc, pos), and whether each in that order is the first of its anchor and content."""
    order = np.lexsort((pos, doc, content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return order, first


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s (symbols under 512) in order of their first `depth` symbols at least, by prefix doubling."""
    n = len(s)
    padded = np.concatenate([s, np.zeros(8, s.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(6):
        key = (key << 9) | padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(new)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.flatnonzero(~new | ~np.append(new[1:], True))
    h = 6
    while h < depth and len(slots):
        own = sa[slots]
        key = rank[own] * (n + 2) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank[own] = np.repeat(slots[starts], np.diff(np.append(starts, len(own))))
        slots = slots[~new | ~np.append(new[1:], True)]
        h *= 2
    return sa


def open_boundaries(s: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """By interval expansion: for each place p of the suffix order, whether suffixes p - 1 and p share `depth` symbols.

    Symbol 0 separates strings and is never extended, so only suffixes without it in their first `depth` symbols count.
    """
    n = len(s)
    bwt = s[sa - 1]
    order = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[order] = np.arange(n)
    head = bwt[order]  # first symbols
    owner = np.empty(n, np.int64)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        who = np.repeat(np.arange(len(lo)), size)
        inner = bwt[at] != 0
        to, who = step[at[inner]], who[inner]
        owner[to] = who
        if len(to) > n // 16:
            flag = np.zeros(n, bool)
            flag[to] = True
            to = np.flatnonzero(flag)
        else:
            to = np.sort(to)
        if not len(to):
            break
        cut_at = np.flatnonzero((np.diff(to) != 1) | (np.diff(owner[to]) != 0) | (np.diff(head[to].astype(np.int32)) != 0))
        new_lo, new_hi = to[np.append(0, cut_at + 1)], to[np.append(cut_at, len(to) - 1)] + 1
        fresh = ~known[new_hi]
        # the right end of the whole order is known from the start, but its interval still has to be extended
        fresh |= new_hi == n
        known[new_hi] = True
        lo, hi = new_lo[fresh], new_hi[fresh]
    return ~known[:-1]


def repeated(texts: list[bytes], doc: np.ndarray, pos: np.ndarray, depth: int = MIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the runs of windows that also start earlier among the fragments (texts at doc, pos)."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    s = raw.astype(np.uint16) + 1
    s[begin + sizes] = 0
    sa = suffix_order(s, depth)
    joined = open_boundaries(s, sa, depth)
    which = np.repeat(np.arange(len(texts)), sizes + 1)[sa]
    inside = sa - begin[which]
    good = sizes[which] - inside >= depth
    joined &= good
    joined[1:] &= good[:-1]
    member = good & (joined | np.append(joined[1:], False))
    group = np.cumsum(~joined)[member]
    doc, start = doc[which[member]], pos[which[member]] + inside[member]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    return runs(doc[later], start[later], depth)


def runs(doc: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows joined where they follow each other place by place: (doc, start, end)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    edge = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) > 1)) + 1
    a, b = np.append(0, edge), np.append(edge, len(doc))
    return (doc[a], start[a], start[b - 1] + depth) if len(doc) else (doc, start, start)


def wide_anchors(docs: DataFrame, wide: int = WIDE, sample: int = SAMPLE) -> np.ndarray:
    """Anchors with more than `wide` records, and at least one in MAX_WIDE of all, by a hashed sample of the documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in blocks(batches, "text", _PIECE):
            _, _, _, anchor, content = fragments(buf, offsets)
            _, first = earliest(anchor, content, np.zeros(len(anchor), np.int64), np.arange(len(anchor)))
            key, n = np.unique(np.sort(anchor)[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["anchor", "n"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("text")
    counts = cut(some.mapInArrow(task, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    least = max(wide / sample, (counts.agg(F.sum("n")).first()[0] or 0) / MAX_WIDE)
    return np.sort(np.array([r.anchor for r in counts.where(F.col("n") > least).collect()], np.int64).view(np.uint64))


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ranges at a and b agree."""
    if not len(a):
        return np.zeros(0, bool)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    return ~np.logical_or.reduceat(buf[np.repeat(a, sizes) + nth] != buf[np.repeat(b, sizes) + nth], begin)


def _gather(docs: DataFrame, hot: int, wide: int, sample: int) -> DataFrame:
    """docs (id, text) -> (kind, doc, pos, end, anchor, content). kind 0: bytes pos to end are removed; 1: a fragment to look into;
    2: the same of a hot anchor; 3: a later copy of two fragments of kind 1."""
    apart = wide_anchors(docs, wide, sample)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in blocks(batches, "text", _PIECE):
            row, pos, windows, anchor, content = fragments(buf, offsets)
            doc = part.column("id").to_numpy()[row]
            order, first = earliest(anchor, content, doc, pos)
            rec = np.empty(len(order), _RECORD)
            for name, x in (("anchor", anchor), ("content", content), ("doc", doc), ("pos", pos), ("windows", windows)):
                rec[name] = x[order]
            # copies inside the block, byte by byte: removed whatever else there is
            place = (offsets[row] + pos)[order]
            later = np.flatnonzero(~first)
            of = np.flatnonzero(first)[np.cumsum(first)[later] - 1]
            alike = same_bytes(buf, place[of], place[later], windows[order][later] + MIN - 1)
            first[later[~alike]] = True
            gone = rec[~first]
            own = rec[first]
            far = np.isin(own["anchor"], apart)
            spread, own = own[far], own[~far]
            bucket = (mix(own["anchor"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            own, ends = own[by], np.cumsum(np.bincount(bucket, minlength=buckets))
            here = [b for b in range(buckets) if ends[b] > (ends[b - 1] if b else 0)]
            blobs = [own[ends[b - 1] if b else 0 : ends[b]].tobytes() for b in here]
            if len(gone):
                here.append(int(gone["doc"][0] % buckets))
                blobs.append(b"gone" + gone.tobytes())
            if len(spread):
                here.append(int(spread["doc"][0] % buckets))
                blobs.append(b"wide" + spread.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def rows(kind: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        end = rec["pos"].astype(np.int64) + rec["windows"] + MIN - 1
        long = [np.ascontiguousarray(rec[c]).view(np.int64) for c in ("anchor", "content")]
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(rec["doc"]), pa.array(rec["pos"].astype(np.int64)), pa.array(end), *map(pa.array, long)], ["kind", "doc", "pos", "end", "anchor", "content"])

    def judged(rec: np.ndarray) -> pa.RecordBatch:
        """All records of one bucket."""
        _, inverse, count = np.unique(rec["anchor"], return_inverse=True, return_counts=True)
        rec = rec[count[inverse] > 1]
        order, first = earliest(rec["anchor"], rec["content"], rec["doc"], rec["pos"])
        rec = rec[order]
        begin = np.flatnonzero(first)
        nth = np.arange(len(rec)) - np.repeat(begin, np.diff(np.append(begin, len(rec))))
        _, inverse = np.unique(rec["anchor"], return_inverse=True)
        distinct = np.bincount(inverse[first])[inverse] if len(rec) else nth
        return rows(np.where(distinct > hot, np.where(first, 2, 0), np.where(nth < 2, 1, 3)), rec)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs in order of bucket, one bucket in memory at a time."""
        now, parts = None, []
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                blob = blob.as_py()
                if len(blob) % _RECORD.itemsize == 4:  # marked: they meet no others
                    rec = np.frombuffer(blob, _RECORD, offset=4)
                    yield rows(np.full(len(rec), 0 if blob[:4] == b"gone" else 2), rec)
                    continue
                if b != now and parts:
                    yield judged(np.concatenate(parts))
                    parts = []
                now = b
                parts.append(np.frombuffer(blob, _RECORD))
        if parts:
            yield judged(np.concatenate(parts))

    dealt = docs.mapInArrow(deal, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(meet, "kind int, doc long, pos long, end long, anchor long, content long"), "fragments")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, wanted) -> (kind, anchor, content, doc, pos, end, bytes)."""
    for part, buf, offsets in blocks(batches, "text", _PIECE):
        wanted = part.column("wanted")
        n = wanted.value_lengths().to_numpy(zero_copy_only=False)
        base = np.repeat(offsets[:-1], n)
        w = wanted.flatten().flatten()
        pos, end = base + w[1].to_numpy(), base + w[2].to_numpy()
        texts = pa.array([buf[a:b].tobytes() for a, b in zip(pos.tolist(), end.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([w[0], w[3], w[4], pa.array(np.repeat(part.column("id").to_numpy(), n)), w[1], w[2], texts], ["kind", "anchor", "content", "doc", "pos", "end", "bytes"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of anchor, content and kind -> removed runs; all of an anchor's fragments stay in one chunk."""
    names = ["doc", "pos", "end"]

    def flush() -> pa.RecordBatch:
        found = repeated(texts, np.concatenate(doc), np.concatenate(pos))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)

    texts: list[bytes] = []
    doc: list[np.ndarray] = []
    pos: list[np.ndarray] = []
    size, anchor, carried, last = 0, None, False, (None, None, None, False)  # the last fragment with a text: anchor, content, text, whether it is the one before again
    for batch in batches:
        a, c, d, p = (batch.column(x).to_numpy() for x in ("anchor", "content", "doc", "pos"))
        copy = batch.column("kind").to_numpy() == 3
        own = np.flatnonzero(~copy)
        all_texts = batch.column("bytes").take(pa.array(own)).to_pylist()
        # later copies go where the two before them agree
        agree = []
        for i, t in zip(own.tolist(), all_texts, strict=True):
            last = (a[i], c[i], t, last[0] == a[i] and last[1] == c[i] and last[2] == t)
            agree.append(last[3])
        if copy.any():
            before = np.cumsum(~copy) - 1
            follows = copy & np.append(agree, carried).astype(bool)[before]  # place -1: the last of the batch before
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(follows)) for x in names], names)
        carried = last[3]
        a, d, p = a[own], d[own], p[own]
        edges = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if x == y:
                continue
            if size > CHUNK and anchor != a[x]:
                yield flush()
                texts, doc, pos, size = [], [], [], 0
            anchor = a[x]
            texts += all_texts[x:y]
            doc.append(d[x:y])
            pos.append(p[x:y])
            size += sum(map(len, all_texts[x:y]))
    if texts:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of hot fragments: (h, g, doc, pos)."""
    for batch in batches:
        texts = batch.column("bytes").to_pylist()
        for lo in range(0, len(texts), 2000):
            part = texts[lo : lo + 2000]
            n = np.array([len(t) - MIN + 1 for t in part])
            begin = np.cumsum([0, *[len(t) for t in part][:-1]])
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            buf, at = np.frombuffer(b"".join(part), np.uint8), np.repeat(begin, n) + nth
            h, g = (xxh64_spans(buf, at, np.full(len(at), MIN), seed).view(np.int64) for seed in (42, 43))
            doc, pos = (np.repeat(batch.column(c).to_numpy()[lo : lo + 2000], n) for c in ("doc", "pos"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, doc, pos + nth)], ["h", "g", "doc", "pos"])


def removed_spans(docs: DataFrame, hot: int = HOT, wide: int = WIDE, sample: int = SAMPLE) -> DataFrame:
    """docs (id long, text), ids distinct -> (doc, pos, end): spans that together are all removed bytes."""
    found = _gather(docs, hot, wide, sample)
    wanted = found.where("kind IN (1, 2)").groupBy("doc").agg(F.collect_list(F.struct("kind", "pos", "end", "anchor", "content")).alias("wanted"))  # by text length
    texts = docs.join(wanted, F.col("id") == F.col("doc")).select("id", "text", "wanted").mapInArrow(_cut_out, "kind int, anchor long, content long, doc long, pos long, end long, bytes binary")
    out = found.where("kind = 0").select("doc", "pos", "end")
    if not found.where("kind = 2").isEmpty():
        keyed = texts.where("kind = 2").mapInArrow(_windows, "h long, g long, doc long, pos long")
        low = keyed.groupBy("h", "g").agg(F.min(F.struct("doc", "pos")).alias("low"))
        out = out.unionByName(keyed.join(low, ["h", "g"]).where(F.struct("doc", "pos") > F.col("low")).select("doc", "pos", (F.col("pos") + MIN).alias("end")))
    copies = found.where("kind = 3").select("kind", "anchor", "content", "doc", "pos", "end", F.lit(None).cast("binary").alias("bytes"))
    usual = texts.where("kind = 1").unionByName(copies).repartition("anchor").sortWithinPartitions("anchor", "content", "kind")
    return out.unionByName(usual.mapInArrow(_expand, "doc long, pos long, end long"))


def _kept(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    depth = np.zeros(len(buf) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    gone = np.cumsum(depth)[:-1] > 0
    return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(buf[~gone].tobytes()).hexdigest()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, buf, offsets in blocks(batches, "text", _PIECE):
        spans = part.column("spans")
        n = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        w = spans.flatten().flatten()
        s, e = w[0].to_numpy(), w[1].to_numpy()
        rows = [_kept(buf[a:b], s[x:y], e[x:y]) if y > x else (0, 0, hashlib.sha256(buf[a:b].tobytes()).hexdigest()) for a, b, x, y in zip(offsets[:-1], offsets[1:], n[:-1], n[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), *[pa.array(x) for x in zip(*rows, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _dedup(docs: DataFrame, hot: int, wide: int, sample: int) -> DataFrame:
    docs = docs.where("id is not null")  # as the joins want it, so that both use one shuffle of the texts
    spans = removed_spans(docs, hot, wide, sample).groupBy("doc").agg(F.collect_list(F.struct("pos", "end")).alias("spans"))  # by text length
    return docs.join(spans, F.col("id") == F.col("doc"), "left").select("id", "text", "spans").mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, wide: int = WIDE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if plain.groupBy("id").count().where("id is null or count > 1").isEmpty():
        return _dedup(plain, hot, wide, sample).withColumnRenamed("id", "doc_id")
    keyed = plain.withColumn("hash", F.xxhash64("text"))
    one = keyed.dropDuplicates(["id", "hash"]).repartitionByRange(F.col("id").asc_nulls_last(), "hash").sortWithinPartitions(F.col("id").asc_nulls_last(), "hash")
    one = cut(one.withColumn("rank", F.monotonically_increasing_id()), "ranked")
    found = _dedup(one.select(F.col("rank").alias("id"), "text"), hot, wide, sample).withColumnRenamed("id", "rank").join(one.select("rank", F.col("id").alias("doc_id"), "hash"), "rank")
    found = found.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return keyed.select("id", "hash").join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))
