"""Operator 6, LM scoring by masked pseudo-likelihood.

A window network, written in numpy, predicts every token from the two tokens on either side: position-wise embeddings are
summed, squashed, and give a token class, then a token within its class (a two-level softmax; the more frequent a class, the fewer
tokens it has). A text's score, log_prob, is the sum of the network's conditional log-probabilities of all its tokens; each
is a probability over all possible tokens. counted_log_prob stands beside it and adds what the corpus counts:

- The network's outputs are the corpus's most frequent tokens, as many as `outputs` says (they grow with the counted
  tokens, MAX_WORDS at most, so that the network stays under 50 MB), and one output for any other token. Such a token's
  probability is that output's times the probability of its spelling, byte by byte given the byte before, counted over
  all rarer tokens of the corpus.
- What a network of bounded size can't hold is kept as counts that grow with the corpus: of each context (left and right
  neighbour) whose left neighbour is no output, how often it occurs, and with which token. They are added to the network's
  prediction as to a prior of weight PRIOR, without the occurrence that is being predicted, so a text is never scored
  by itself, only by its repeats. A frequent left neighbour has no such counts, so no context is in more places than the
  rarest output's count.

Training is the same whatever the number of tasks: documents are dealt by a hash of their text into shards of about
SHARD_TOKENS tokens and ROUNDS rounds. In a round each shard continues from the round's common network on its documents,
in order of their hash; then the shards' networks are averaged, slice by slice, by their tokens. Every token of the
corpus is trained on once.

Tokens are lower-cased runs of letters and digits. Defined results: null, empty or tokenless text has no tokens,
log-probability 0 and a null mean; rows of equal text get equal scores (their repeats count for each other); an empty
table gives no rows. A token's neighbours beyond the text's ends are a place of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import LOWER, TOKEN, Members, blocks, cut, documents, mix, new_path, spans, xxh64_spans

HIDDEN, BATCH, RATE, ROUNDS, SHARD_TOKENS, SEED, SLICES = 16, 16_384, 0.1, 4, 4_000_000, 42, 64
MIN_WORDS, MAX_WORDS, GROWTH, PRIOR = 256, 65_536, 0.45, 1.0
#: text bytes whose contexts meet in one task
BUCKET_BYTES = 64 << 20
SIDES = (-2, -1, 1, 2)
#: symbol of a word's start and end in spellings
_EDGE = 256


def outputs(n_tokens: int) -> int:
    """Number of token classes; its square, the number of outputs, is about n_tokens ** GROWTH, between MIN_WORDS and MAX_WORDS."""
    return math.isqrt(int(min(MAX_WORDS, max(MIN_WORDS, n_tokens**GROWTH))))


class Network:
    """Parameters as views of one flat array.

    Tokens have ids 0 to side ** 2 - 1 in falling order of frequency; class c holds those from c ** 2 to (c + 1) ** 2 - 1. The
    id side ** 2 stands for any rarer token, a class of its own, and the next one for what lies beyond a text's ends.
    """

    def __init__(self, side: int, flat: np.ndarray | None = None):
        size = side * side
        self.side, self.rare = side, size
        shapes = {"embed": (len(SIDES), size + 2, HIDDEN), "bias": (HIDDEN,), "classes": (side + 1, HIDDEN), "class_bias": (side + 1,), "words": (size, HIDDEN), "word_bias": (size,)}
        if flat is None:
            rng = np.random.RandomState(SEED)
            flat = np.concatenate([(rng.randn(math.prod(s)) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for s in shapes.values()])
        self.flat, at = flat, 0
        self.views: dict[str, np.ndarray] = {}
        for name, shape in shapes.items():
            n = math.prod(shape)
            self.views[name] = flat[at : at + n].reshape(shape)
            at += n
        self.first = np.arange(side + 1) ** 2

    def start_from(self, counts: np.ndarray) -> Network:
        """Biases that give each token its share of the counts (the last: all rarer tokens)."""
        by = np.maximum(counts.astype(float), 0.5)
        mass = np.add.reduceat(by, self.first)
        self.views["class_bias"][:] = np.log(mass / mass.sum())
        self.views["word_bias"][:] = np.log(by[:-1] / np.repeat(mass[:-1], np.diff(self.first)))
        return self

    def forward(self, context: np.ndarray, target: np.ndarray, grad: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each target given its context (n, 4); with `grad`, adds the gradient of their mean's negative."""
        v, n = self.views, len(target)
        h = np.tanh(sum(v["embed"][k].take(context[:, k], axis=0) for k in range(len(SIDES))) + v["bias"])
        group = np.searchsorted(self.first, target, "right") - 1
        order = np.argsort(group.astype(np.uint16), kind="stable")
        h, group, target = h[order], group[order], target[order]
        ends = np.searchsorted(group, np.arange(self.side + 1))
        grads = Network(self.side, grad).views if grad is not None else None
        out = np.empty(n, h.dtype)
        dh = np.zeros_like(h)

        def choose(weights: str, biases: str, part: slice, h: np.ndarray, which: np.ndarray, dh: np.ndarray) -> np.ndarray:
            """Log-softmax of the outputs `part`, one column for each row of h, at `which`; gradients on the way."""
            e = v[weights][part] @ h.T
            e += v[biases][part][:, None]
            e -= e.max(axis=0)
            at = np.arange(len(which))
            own = e[which, at]
            np.exp(e, out=e)
            total = e.sum(axis=0)
            if grads is not None:
                e /= total * n
                e[which, at] -= 1 / n
                grads[weights][part] += e @ h
                grads[biases][part] += e.sum(axis=1)
                dh += e.T @ v[weights][part]
            return own - np.log(total)

        for lo in range(0, n, 4096):  # small enough for the processor's caches
            some = slice(lo, lo + 4096)
            out[some] = choose("classes", "class_bias", slice(None), h[some], group[some], dh[some])
        for c in range(1, self.side):  # class 0 has one token
            some = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                out[some] += choose("words", "word_bias", slice(c * c, (c + 1) ** 2), h[some], target[some] - c * c, dh[some])
        if grads is not None:
            dh *= 1 - h * h
            grads["bias"] += dh.sum(axis=0)
            for k in range(len(SIDES)):
                ids = context[order, k]
                by = np.argsort(ids.astype(np.uint16) if self.rare < 65_000 else ids, kind="stable")
                ids = ids[by]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                grads["embed"][k][ids[first]] += np.add.reduceat(dh[by], first, axis=0)
        back = np.empty_like(out)
        back[order] = out
        return back


def steps(ids: np.ndarray, n: np.ndarray, outside: int, batch: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) of all tokens of texts with n tokens each, a batch at a time."""
    place = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, len(n) + 1), n)
    padded = np.full(len(ids) + 2 * len(n) + 2, outside, np.int32)
    padded[place] = ids
    for lo in range(0, len(place), batch):
        at = place[lo : lo + batch]
        yield padded[at[:, None] + np.array(SIDES)], ids[lo : lo + batch].astype(np.int64)


class Words:
    """A block's tokens: bytes, starts, ends, hashes, and each text's first token (n + 1)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = LOWER[buf]
        self.starts, self.ends, self.first = spans(self.buf, offsets, TOKEN)
        self.hash = xxh64_spans(self.buf, self.starts, self.ends - self.starts)

    def pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring symbols (previous * 257 + next) of some tokens' spellings, one after the other, and where each token's begin."""
        starts, sizes = self.starts[which], self.ends[which] - self.starts[which]
        begin = np.cumsum(sizes + 1) - sizes - 1
        at = np.arange(int((sizes + 1).sum())) + np.repeat(starts - begin, sizes + 1)
        last = begin + sizes
        now = self.buf[np.minimum(at, max(len(self.buf) - 1, 0))].astype(np.int64)
        before = self.buf[np.maximum(at - 1, 0)].astype(np.int64)
        now[last] = _EDGE
        before[begin] = _EDGE
        return before * (_EDGE + 1) + now, begin


def vocabulary(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of classes, hashes of the outputs in falling order of their counts in all documents, and the counts of all ids (the
    last: all rarer tokens)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in blocks(batches, "text"):
            key, n = np.unique(Words(buf, offsets).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = cut(docs.select("text").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    side = outputs(total)
    top = counts.orderBy(F.desc("n"), "key").limit(side * side).collect()
    n = np.zeros(side * side + 1, np.int64)
    n[: len(top)] = [r.n for r in top]
    n[-1] = total - n.sum()
    return side, np.array([r.key for r in top], np.int64).view(np.uint64), n


def _ids(words: Words, members: Members, side: int) -> np.ndarray:
    ids = np.full(len(words.hash), side * side, np.int32)
    at, which = members.find(words.hash)
    ids[at] = which
    return ids


def _text_keys(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return xxh64_spans(buf, offsets[:-1], np.diff(offsets))


def encode(docs: DataFrame, side: int, words: np.ndarray, shards: int, path: str) -> None:
    """Files by round: (shard, key, ids) of each text, and in round -1 the pairs of rarer tokens' spellings with their counts."""
    share = docs.sparkSession.sparkContext.broadcast(words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, pairs, names = Members(share.value), np.zeros((_EDGE + 1) ** 2, np.int64), ["round", "shard", "key", "ids", "pair", "n"]
        none = lambda n, t: pa.nulls(n, t)
        for _, buf, offsets in blocks(batches, "text"):
            w = Words(buf, offsets)
            ids, key = _ids(w, members, side), _text_keys(buf, offsets)
            rare = np.flatnonzero(ids == side * side)
            for lo in range(0, len(rare), 1 << 18):
                pairs += np.bincount(w.pairs(rare[lo : lo + (1 << 18)])[0], minlength=len(pairs))
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(ids))
            scrambled = mix(key)
            round_ = (scrambled % np.uint64(ROUNDS)).astype(np.int32)
            shard = ((scrambled >> np.uint64(8)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(round_), pa.array(shard), pa.array(key.view(np.int64)), lists, none(len(key), pa.int32()), none(len(key), pa.int64())], names)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, np.int32)), *[none(len(at), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int32()))], pa.array(at.astype(np.int32)), pa.array(pairs[at])], names)

    docs.select("text").mapInArrow(task, "round int, shard int, key long, ids array<int>, pair int, n long").write.partitionBy("round").parquet(path)


_ENCODED = "shard int, key long, ids array<int>, pair int, n long, round int"


def spelling(spark: SparkSession, path: str) -> np.ndarray:
    """Log-probability of each symbol given the one before (257 * 257), by the counts over all rarer tokens."""
    found = spark.read.schema(_ENCODED).parquet(path).where("round = -1").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 257 ** 2 at most
    n = np.full((_EDGE + 1) ** 2, 0.01)
    for r in found:
        n[r.pair] += r.n
    n = n.reshape(_EDGE + 1, _EDGE + 1)
    return np.log(n / n.sum(axis=1, keepdims=True)).ravel()


def train(spark: SparkSession, path: str, side: int, counts: np.ndarray, shards: int, rounds: int = ROUNDS) -> np.ndarray:
    """The network's parameters after all rounds."""
    net = Network(side).start_from(counts)
    state = np.concatenate([net.flat, np.full_like(net.flat, 1e-6)])  # parameters, and sums of squared gradients
    size, bounds = len(net.flat), np.linspace(0, len(state), SLICES + 1).astype(int)
    texts = spark.read.schema(_ENCODED).parquet(path)
    for r in range(rounds):
        share = spark.sparkContext.broadcast(state)

        def local(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            """Rows in order of shard and key -> each shard's network in slices."""

            def learn(ids: list[np.ndarray], n: list[np.ndarray]) -> None:
                for context, target in steps(np.concatenate(ids), np.concatenate(n), side * side + 1):
                    grad[:] = 0
                    own.forward(context, target, grad)
                    np.multiply(grad, grad, out=step)
                    np.add(past, step, out=past)
                    np.sqrt(past, out=step)
                    np.divide(grad, step, out=step)
                    np.multiply(step, RATE, out=step)
                    np.subtract(own.flat, step, out=own.flat)

            def result(shard: int) -> pa.RecordBatch:
                parts = [now[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([shard] * SLICES), pa.array([seen] * SLICES), pa.array(parts, pa.binary())], ["slice", "shard", "n", "part"])

            shard, seen, wait, wait_n, size_ = None, 0, [], [], 0
            for batch in batches:
                of = batch.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if of[a] != shard:
                        if shard is not None:
                            if wait:
                                learn(wait, wait_n)
                            yield result(shard)
                        shard, seen, wait, wait_n, size_ = int(of[a]), 0, [], [], 0
                        now = share.value.copy()
                        own, past, grad, step = Network(side, now[:size]), now[size:], np.zeros(size, np.float32), np.empty(size, np.float32)
                    lists = batch.column("ids").slice(a, b - a)
                    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    for lo, ids in _texts(lists, n):  # whole texts of one batch at least, so that steps don't depend on Arrow's batches
                        wait.append(ids)
                        wait_n.append(n[lo : lo + 1])
                        size_ += len(ids)
                        seen += len(ids)
                        if size_ >= 4 * BATCH:
                            learn(wait, wait_n)
                            wait, wait_n, size_ = [], [], 0
            if shard is not None:
                if wait:
                    learn(wait, wait_n)
                yield result(shard)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows in order of slice and shard -> each slice's mean by tokens."""
            at, total, n = None, None, 0
            done = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary())], ["slice", "part"])
            for batch in batches:
                for k, m, part in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), batch.column("part"), strict=True):
                    if k != at:
                        if at is not None:
                            yield done()
                        at, total, n = k, 0.0, 0
                    total = total + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64) * m
                    n += m
            if at is not None:
                yield done()

        dealt = texts.where((F.col("round") == r) & (F.size("ids") > 0)).select("shard", "key", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "key")
        own = cut(dealt.mapInArrow(local, "slice long, shard long, n long, part binary"), "networks")
        mean = own.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").mapInArrow(add, "slice long, part binary").collect()  # one network
        if mean:
            state = np.concatenate([np.frombuffer(bytes(x.part), np.float32) for x in sorted(mean, key=lambda x: x.slice)])
        share.unpersist()
    return state[:size].copy()


def _texts(lists: pa.ListArray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(n)):
        yield i, ids[at[i] : at[i + 1]]


class Scorer:
    """What scoring a block needs: network, outputs, spellings."""

    def __init__(self, side: int, words: np.ndarray, flat: np.ndarray, spell: np.ndarray):
        self.net, self.members, self.spell, self.rare = Network(side, flat), Members(words), spell, side * side

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """Tokens, ids, and each token's log-probability by the network."""
        w = Words(buf, offsets)
        ids = _ids(w, self.members, self.net.side)
        logs = [self.net.forward(c, t) for c, t in steps(ids, np.diff(w.first), self.rare + 1, 2 * BATCH)]
        out = np.concatenate(logs).astype(np.float64) if logs else np.zeros(0)
        rare = np.flatnonzero(ids == self.rare)
        for lo in range(0, len(rare), 1 << 18):
            part = rare[lo : lo + (1 << 18)]
            pair, begin = w.pairs(part)
            out[part] += np.add.reduceat(self.spell[pair], begin)
        return w, ids, out


_HEAD = np.dtype("<u4")


def _pack(row: np.ndarray, context: np.ndarray, word: np.ndarray, log: np.ndarray, n: np.ndarray) -> bytes:
    """Records in order of rows, as arrays: each row's key and number of records, then the records; n only where it isn't 1."""
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    many = np.flatnonzero(n > 1)
    head = np.array([len(edge), len(row), len(many)], _HEAD)
    return b"".join(x.tobytes() for x in (head, row[edge], np.diff(np.append(edge, len(row))).astype("<u4"), context, word, log, many.astype("<u4"), n[many].astype("<u4")))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    rows, size, many = np.frombuffer(blob, _HEAD, 3).tolist()
    at, out = 12, []
    for kind, count in (("<u8", rows), ("<u4", rows), ("<u8", size), ("<u4", size), ("<f4", size), ("<u4", many), ("<u4", many)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    n = np.ones(size, np.int64)
    n[out[5]] = out[6]
    return np.repeat(out[0], out[1]), out[2], out[3], out[4], n


def gains(row: np.ndarray, context: np.ndarray, word: np.ndarray, log: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts add to the log-probabilities of all records of some contexts: (row, sum), rows without a repeated context left out."""
    order = np.lexsort((word, context))
    row, context, word, log, n = (x[order] for x in (row, context, word, log, n))
    new_context = np.append(True, context[1:] != context[:-1])
    new_word = new_context | np.append(True, word[1:] != word[:-1])

    def sums(new: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(new)
        return np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))

    of_context, of_word = sums(new_context), sums(new_word)
    at = np.flatnonzero(of_context > 1)
    log, n = log[at].astype(np.float64), n[at]
    gain = n * (np.log((of_word[at] - 1 + PRIOR * np.exp(log)) / (of_context[at] - 1 + PRIOR)) - log)
    keys, inverse = np.unique(row[at], return_inverse=True)
    return keys, np.bincount(inverse, gain, len(keys))


SCORED = ["doc_id", "n_tokens", "log_prob", "mean_log_prob", "counted_log_prob", "mean_counted_log_prob"]
_FOUND = "bucket int, blob binary, doc_id long, row long, n_tokens long, log_prob double"
_NAMES = ["bucket", "blob", "doc_id", "row", "n_tokens", "log_prob"]
_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]


def _blobs(bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), *[pa.nulls(len(bucket), t) for t in _TYPES[2:]]], _NAMES)


def _parts(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The buckets that occur in a sorted array, with their places."""
    ends = np.searchsorted(bucket, np.arange(n + 1))
    yield from ((int(b), slice(ends[b], ends[b + 1])) for b in np.flatnonzero(np.diff(ends)))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[pa.RecordBatch]]]:
    """Rows in order of bucket -> each bucket's blobs and other rows."""
    now, blobs, rows = None, [], []
    for batch in batches:
        of = batch.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if of[a] != now and now is not None:
                yield now, blobs, rows
                blobs, rows = [], []
            now, part = int(of[a]), batch.slice(a, b - a)
            blobs += [x.as_py() for x in part.column("blob").drop_null()]
            plain = part.filter(part.column("blob").is_null())
            if plain.num_rows:
                rows.append(plain)
    if now is not None:
        yield now, blobs, rows


def score(docs: DataFrame, side: int, words: np.ndarray, flat: np.ndarray, spell: np.ndarray, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob, counted_log_prob, mean_counted_log_prob), one row per input row: the network's
    score, and beside it the score with the counts of contexts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // bucket_bytes))
    share = spark.sparkContext.broadcast((side, words, flat, spell))  # at most MAX_WORDS outputs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its score by the network, and the places of contexts that have counts, by bucket of contexts."""
        scorer = Scorer(*share.value)
        for part, buf, offsets in blocks(batches, "text"):
            w, ids, log = scorer.block(buf, offsets)
            n = np.diff(w.first)
            text = np.repeat(np.arange(len(n)), n)
            doc_id = part.column("doc_id")
            row = mix(_text_keys(buf, offsets) + mix(doc_id.fill_null(-1).to_numpy().view(np.uint64) + doc_id.is_null().to_numpy(zero_copy_only=False)))
            where = (row % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.nulls(len(row), pa.binary()), doc_id, pa.array(row.view(np.int64)), pa.array(n), pa.array(np.bincount(text, log, len(n)))], _NAMES)
            # contexts with a left neighbour that is no output; the right one, or the text's end
            at = np.flatnonzero((ids[:-1] == scorer.rare) & (text[:-1] == text[1:])) + 1 if len(ids) else np.zeros(0, np.int64)
            if not len(at):
                continue
            after = np.minimum(at + 1, len(ids) - 1)
            right = np.where((at + 1 < len(ids)) & (text[after] == text[at]), w.hash[after], np.uint64(0))
            context, word, logs = mix(mix(w.hash[at - 1]) + right), (w.hash[at] >> np.uint64(32)).astype("<u4"), log[at].astype("<f4")
            bucket = (context % np.uint64(buckets)).astype(np.int32)
            # a text's records that agree in all become one
            same = mix(mix(context + word) + mix(text[at].astype(np.uint64) + (logs.view("<u4").astype(np.uint64) << np.uint64(32))))
            _, index, times = np.unique(same, return_index=True, return_counts=True)
            order = np.lexsort((text[at][index], bucket[index]))
            index, times = index[order], times[order]
            found = [(b, _pack(row[text[at[index[own]]]], context[index[own]], word[index[own]], logs[index[own]], times[own])) for b, own in _parts(bucket[index], buckets)]
            yield _blobs(*map(list, zip(*found, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What counts add to each row, by bucket of rows."""
        for _, blobs, rows in _by_bucket(batches):
            yield from rows
            if blobs:
                keys, gain = gains(*[np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True)])
                order = np.argsort(keys % np.uint64(buckets), kind="stable")
                keys, gain = keys[order], gain[order]
                found = [(b, keys[own].tobytes() + gain[own].tobytes()) for b, own in _parts((keys % np.uint64(buckets)).astype(np.int64), buckets)]
                if found:
                    yield _blobs(*map(list, zip(*found, strict=True)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, rows in _by_bucket(batches):
            both = [(np.frombuffer(b, "<u8", len(b) // 16), np.frombuffer(b, "<f8", len(b) // 16, len(b) // 2)) for b in blobs]
            keys, inverse = np.unique(np.concatenate([x for x, _ in both]) if both else np.zeros(0, np.uint64), return_inverse=True)
            gain = np.bincount(inverse, np.concatenate([x for _, x in both]) if both else None, len(keys))
            own = [x.column("row").to_numpy().view(np.uint64) for x in rows]
            # rows that agree in id and text share a key: their gains were summed
            distinct, of, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            plus = np.zeros(len(distinct))
            plus[np.searchsorted(distinct, keys)] = gain
            plus = (plus / times)[of]
            for part in rows:
                n = part.column("n_tokens").to_numpy()
                own_log = part.column("log_prob").to_numpy()
                total = own_log + plus[: len(n)]
                plus = plus[len(n) :]
                means = [pa.array(np.divide(x, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0) for x in (own_log, total)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), pa.array(own_log), means[0], pa.array(total), means[1]], SCORED)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = dealt(plain.mapInArrow(task, _FOUND)).mapInArrow(meet, _FOUND)
    return dealt(found).mapInArrow(add, ", ".join(f"{c} {'long' if c in SCORED[:2] else 'double'}" for c in SCORED))


def fit(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of classes, outputs, parameters, spellings: all from all documents."""
    spark = docs.sparkSession
    side, words, counts = vocabulary(docs)
    shards = max(1, int(counts.sum() // SHARD_TOKENS))
    path = new_path(spark, "ids")
    encode(docs, side, words, shards, path)
    return side, words, train(spark, path, side, counts, shards), spelling(spark, path)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, *fit(docs))
