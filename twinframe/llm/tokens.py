"""Operator 2, token-id output: ORC files of token ids in ascending doc_id order.

Documents are dealt by ranges of doc_id and sorted, so that files, stripes and row groups hold disjoint id ranges:
integer run-length encoding keeps ids small, row indexes and a Bloom filter on doc_id let a lookup skip stripes, and
stripes can be read in parallel. A row carries the number of its range and its first token's place there, however many
files the range's task writes; a document's place in the whole output adds the totals of the ranges before.

Texts are encoded with the tokenizers library. White space and the borders between ASCII letters, digits and other
ASCII characters always separate tokens in this vocabulary, so each distinct stretch between them is encoded once for a
block of texts; a text that holds a special token's string is encoded as a whole.
Defined results: null counts as empty; an empty text has the end id alone; rows of equal doc_id stand together in order of their text;
null ids come first; an empty table gives an empty output.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.llm.common import LOWER, blocks, cut, documents, new_path

END_ID = 2
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 never a border beside it but for white space: apostrophe, non-ASCII
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]], _KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[39], _KIND[128:] = 0, 1, 1, 2, 4, 4


class Encoder:
    """Encodes blocks of texts; words seen before are kept in a table of bounded size, and in the table before it."""

    KEEP = 150_000
    #: stands between words that are encoded in one call; words that hold it are encoded alone
    MARK = "\x01"

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.mark = self.whole([self.MARK])[0]
        self.clear()
        self.clear()

    def clear(self) -> None:
        """Begins a new table; words of the last are taken over when they occur again."""
        self.old = (self.known, self.ids, self.begin, self.size) if hasattr(self, "known") else ({}, *[np.zeros(0, np.int64)] * 3)
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Adds new words to the table."""
        plain = [w for w in words if self.MARK not in w] if len(self.mark) == 1 else []
        alone = [w for w in words if self.MARK in w] if len(self.mark) == 1 else words
        ids, sizes = [], []
        for lo in range(0, len(plain), 20_000):
            part = plain[lo : lo + 20_000]
            got = np.array(self.whole([f" {self.MARK} ".join([*part, ""])])[0], np.int32)
            marks = np.flatnonzero(got == self.mark[0])
            if len(marks) != len(part):
                raise ValueError("the mark is no token of its own in this vocabulary")
            ids.append(np.delete(got, marks))
            sizes.append(np.diff(marks, prepend=-1) - 1)
        rest = self.whole(alone)
        ids.append(np.array([x for w in rest for x in w], np.int32))
        sizes.append(np.array([len(w) for w in rest], np.int64))
        self.add([*plain, *alone], np.concatenate(ids), np.concatenate(sizes))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.ids, self.size = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.size, sizes])
        self.begin = np.cumsum(self.size) - self.size

    def slots(self, words: list[str]) -> np.ndarray:
        """Each distinct word's place in the table."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.KEEP:
            self.clear()
            new = words
        if new:
            known, ids, begin, size = self.old
            if again := [w for w in new if w in known]:
                at = np.fromiter(map(known.__getitem__, again), np.int64, len(again))
                n = size[at]
                ends = np.cumsum(n)
                self.add(again, ids[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1])], n)
                new = [w for w in new if w not in known]
            if new:
                self.learn(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a flat buffer, each text's end id included, and their offsets."""
        n = len(offsets) - 1
        if len(buf):
            kind = _KIND[buf]
            edge = np.empty(len(buf) + 1, bool)
            a, b = kind[:-1], kind[1:]
            edge[1:-1] = (a != b) & ((a == 0) | (b == 0) | ((a != 4) & (b != 4)))
            edge[0] = edge[-1] = True
            edge[offsets] = True
            at = np.flatnonzero(edge)
            words = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(LOWER[buf])]).dictionary_encode()
            which = self.slots(words.dictionary.to_pylist())[words.indices.to_numpy()]
            begin, size = self.begin[which], self.size[which]
            ends = np.cumsum(size)
            flat = self.ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]
            upto = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        else:
            flat, upto = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        whole = {}
        raw = buf.tobytes()
        for s in SPECIAL:
            pos = raw.find(s)
            while pos >= 0:
                i = int(np.searchsorted(offsets, pos, "right")) - 1
                if pos + len(s) <= offsets[i + 1]:
                    whole[i] = None
                pos = raw.find(s, pos + 1)
        if whole:
            parts, sizes = [], np.diff(upto)
            for i in range(n):
                own = np.array(self.whole([raw[offsets[i] : offsets[i + 1]].decode()])[0], np.int32) if i in whole else flat[upto[i] : upto[i + 1]]
                parts.append(own)
                sizes[i] = len(own)
            flat, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        out_at = upto + np.arange(n + 1)
        out = np.full(out_at[-1], END_ID, np.int32)
        keep = np.ones(len(out), bool)
        keep[out_at[1:] - 1] = False
        out[keep] = flat
        return out, out_at


@cache
def encoder(path: str | None) -> Encoder:
    """One for a Python worker, whose next task finds the words of the last."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """ORC files of (doc_id, part, first, tokens), ascending in doc_id over parts and rows; first: tokens before it in its part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, nth = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for part, buf, offsets in blocks(batches, "text", 4 << 20):
            ids, at = own.block(buf, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(part.num_rows, nth, np.int32)), pa.array(done + at[:-1]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "first", "tokens"])
            done += len(ids)

    # the beginning of the text splits the rows of one id (null above all) without changing the order
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    encoded = dealt.mapInArrow(task, "doc_id long, part int, first long, tokens array<int>")
    encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(32 << 20)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, first, tokens); a filter on doc_id skips files' stripes and row groups."""
    return spark.read.schema("doc_id long, part int, first long, tokens array<int>").orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            at = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "first")], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    found = cut(read_tokens(spark, path).mapInArrow(task, "doc_id long, part int, first long, n_tokens long, ids_crc32 long"), "digests")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path)
    return digests(spark, path)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir))
