r"""Operator 13, phrase collocation mining by dynamic itemset counting.

The corpus is dealt into SHARDS shards that are scanned in a cycle. Phrases of all lengths are counted in the same scans: words
from the first shard on, and a longer phrase from the shard after the one in which the second of its two subphrases (all but the
last word, all but the first) reached the threshold. Each phrase is counted for one full cycle from there, so its count is
whole. Scanning ends when no phrase is still in its cycle.

Which subphrases have reached the threshold is told to the tasks by a bitmap of a fixed 2**FILTER_BITS bits for each length (a Bloom
filter over hashes of the phrases), and "active" is defined by it: a phrase is counted at step t if both subphrases are in the bitmap of step
t, and weren't yet in the one of step t - SHARDS. Bitmaps only gain bits, so that is one full cycle for any phrase whatever else
shares its bits: a false hit makes a phrase be counted in vain and never changes a count. Counts are keyed by the phrase itself.

Memory and skew: a task counts in blocks of 4 MB of text (longer texts in stretches, with the next three words), Spark sums
partial counts by phrase; only bitmaps of a fixed size meet in the driver. Phrases below the threshold leave the state after their cycle.
Within one block occurrences are told apart by 64-bit hashes (a chance agreement needs one in 10**7 blocks).
Defined results: a null text has no words, a null language is `und`; ties in score go to the earliest cut, equal ranks to the
higher count, then to the phrase that sorts first in bytes; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.llm.common import LOWER, blocks, cut, documents, flat, mix, new_path, ngrams, remove, spans, xxh64_spans

#: with more shards longer phrases begin sooner, and the counts so far are joined with new ones more often
SHARDS, MIN_COUNT, MAX_WORDS, TOP, FILTER_BITS = 2, 30, 4, 2000, 25
BLOCK, SALTS = 4 << 20, 64
#: bytes that end a piece, and those that part words
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~PIECE_END
WORD[[9, 32]] = False
#: a phrase with its language before it, parted by a tab (which no phrase holds), and its count
COUNTS = "key string, n long"


class Bitmap:
    """Membership of hashes in a fixed number of bits, two for each member."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    def holds(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) * 64 - 1)
        bit = lambda at: (self.slots[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return bit(h & mask) & bit((h >> np.uint64(32)) & mask)


def grown(maps: dict[int, Bitmap], hashes: DataFrame, bits: int) -> dict[int, Bitmap]:
    """The bitmaps by length with the members of `hashes` (k, h); one without new bits stays the same object. Bits are joined in Spark:
    at most one row for each length and slot."""
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask))))
    rows = hashes.select("k", at.alias("at")).groupBy("k", F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    of, out = rows["k"].to_numpy(), {}
    for k, old in maps.items():
        slots = old.slots.copy()
        slots[rows["slot"].to_numpy()[of == k]] |= rows["bits"].to_numpy()[of == k].view(np.uint64)
        out[k] = old if np.array_equal(slots, old.slots) else Bitmap(slots)
    return out


def lang_keys(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(v, 7) for v in langs], np.uint64)


def phrase_hashes(rows: DataFrame) -> DataFrame:
    """rows (lang, phrase) -> (k, h), as `occurrences` hashes them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            buf, offsets = flat(batch.column("phrase"))
            starts, ends, of = spans(buf, offsets, WORD)
            text, size = np.repeat(np.arange(batch.num_rows), np.diff(of)), np.diff(of)
            key = xxh64_spans(buf, starts, ends - starts) ^ lang_keys(langs.dictionary.to_pylist())[langs.indices.to_numpy()][text]
            for k in np.unique(size[size > 0]):
                h = ngrams(key, int(k))[of[:-1][size == k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64))], ["k", "h"])

    return rows.select("lang", "phrase").mapInArrow(task, "k int, h long")


def stretches(buf: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, limit): a block as it is, or one longer text in stretches that end between words. What starts before
    `limit` belongs to the stretch; the next MAX_WORDS - 1 words stand behind it."""
    if len(offsets) > 2 or len(buf) <= size:
        yield buf, offsets, len(buf)
        return
    lo = 0
    while lo < len(buf):
        hi, look = min(lo + size, len(buf)), 4096
        while hi < len(buf) and WORD[buf[hi]]:
            rest = np.flatnonzero(~WORD[buf[hi : hi + look]])
            hi, look = (hi + int(rest[0]), look) if len(rest) else (min(hi + look, len(buf)), look * 2)
        end, look = hi, 4096
        while end < len(buf):
            end = min(hi + look, len(buf))
            if len(spans(buf[hi:end], np.array([0, end - hi]), WORD)[0]) > MAX_WORDS:
                break
            look *= 2
        yield buf[lo:end], np.array([0, end - lo]), hi - lo
        lo = hi


def occurrences(buf: np.ndarray, offsets: np.ndarray, limit: int, keys: np.ndarray, now: dict[int, Bitmap], past: dict[int, Bitmap], lengths: tuple[int, ...]):
    """For each of the lengths: (k, first words of one occurrence of each active phrase, counts); then the text of each word, and the
    bytes and bounds of the words. keys: the language's key of each text."""
    buf = LOWER[buf]
    starts, ends, of = spans(buf, offsets, WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    piece = np.cumsum(PIECE_END[buf], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    key = xxh64_spans(buf, starts, ends - starts) ^ keys[text]
    joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    own, out = starts < limit, []
    odd = np.cumsum(joined & ((starts[1:] - ends[:-1] != 1) | (buf[ends[:-1]] != 32))) if len(starts) > 1 else np.zeros(0, np.int64)
    plain = True  # all phrases told have single spaces between their words

    def tell(k: int, at: np.ndarray, h: np.ndarray) -> None:
        nonlocal plain
        order = np.argsort(h[at])
        run = h[at][order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        at = at[order[first]]
        out.append((k, at, np.diff(first, append=len(run))))
        if k > 1 and len(at):
            plain &= bool((odd[at + k - 2] == np.where(at > 0, odd[at - 1], 0)).all())

    h, valid = ngrams(key, 1), np.ones(len(key), bool)
    if 1 in lengths:
        tell(1, np.flatnonzero(own), h)
    for k in range(2, max(lengths, default=1) + 1):
        if len(key) < k:
            break
        valid = valid[:-1] & joined[k - 2 :]
        active = valid & own[: len(valid)]
        if k in lengths:
            for maps, wanted in ((now, True), (past, False)):
                if k - 1 in maps and active.any():
                    held = maps[k - 1].holds(h)
                    active &= (held[:-1] & held[1:]) == wanted
        h = mix(h[:-1] + key[k - 1 :] + np.uint64(k))  # as ngrams(key, k)
        if k in lengths:
            tell(k, np.flatnonzero(active), h)
    if plain:
        return out, text, buf, starts, ends
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)  # the words with one space behind each
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = buf[WORD[buf]]
    return out, text, spaced, begin, begin + size


def _strings(plain: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - begin
    upto = np.concatenate([[0], np.cumsum(size)])
    data = plain[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def count_shard(rows: DataFrame, now, past, lengths: tuple[int, ...]) -> DataFrame:
    """rows (lang, text) -> partial counts of the active phrases of some lengths; with length 1, of all single words, and of all words
    as an empty phrase. now, past: broadcast bitmaps by the length of the subphrases."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(langs: pa.Array, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(langs, phrases, "\t"), pa.array(n.astype(np.int64))], ["key", "n"])

        for part, whole, bounds in blocks(batches, "text", BLOCK):
            langs = part.column("lang").dictionary_encode()
            code, values = langs.indices.to_numpy(), langs.dictionary
            keys = lang_keys(values.to_pylist())[code]
            for buf, offsets, limit in stretches(whole, bounds):
                found, text, plain, begin, end = occurrences(buf, offsets, limit, keys, now.value, past.value, lengths)
                for k, at, n in found:
                    yield counted(values.take(pa.array(code[text[at]])), _strings(plain, begin[at], end[at + k - 1]), n)
                if 1 in lengths:
                    own = text[: int(found[0][2].sum())]  # words that start before the limit come first
                    yield counted(values, pa.array([""] * len(values), pa.string()), np.bincount(code[own], minlength=len(values)))

    return rows.select("lang", "text").mapInArrow(task, COUNTS)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs (doc_id, lang, text) -> (lang, k, phrase, n): every phrase of 1 to MAX_WORDS words with n >= min_count occurrences,
    and for each language a row k = 0 with the number of its words."""
    spark = docs.sparkSession
    path, state, old, step = new_path(spark, "shards"), None, None, 0
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), shard.alias("shard")).write.partitionBy("shard").parquet(path)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    maps = [dict.fromkeys(range(1, MAX_WORDS), Bitmap(np.zeros((1 << filter_bits) // 64, np.uint64)))]  # by step and length
    phrase = F.substring_index("key", "\t", -1)
    lang = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(phrase) - 1)
    k = F.when(phrase == "", F.lit(0)).otherwise(F.size(F.split(phrase, " ")))
    fresh = dict.fromkeys(range(1, MAX_WORDS), -1)  # by length, the last step that told new phrases over the threshold
    # a length is scanned while some phrase of it can be in its cycle: new subphrases were told less than a cycle ago
    while lengths := tuple(k for k in range(1, MAX_WORDS + 1) if (step < shards if k == 1 else fresh[k - 1] >= max(0, step - shards))):
        need = [k - 1 for k in lengths if k > 1]
        sent = [spark.sparkContext.broadcast({k: maps[at][k] for k in need} if at >= 0 else {}) for at in (step, step - shards)]
        found = count_shard(dealt.where(F.col("shard") == step % shards), *sent, lengths).withColumn("since", F.lit(step))
        found = found if state is None else state.unionByName(found)
        summed = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("since").alias("since"))
        at = new_path(spark, "phrases")
        summed.where((F.col("n") >= min_count) | (F.col("since") + shards > step + 1) | F.endswith("key", F.lit("\t"))).write.parquet(at)
        state = spark.read.schema(COUNTS + ", since int").parquet(at)
        if old:
            remove(spark, old)
        for x in sent:
            x.destroy()
        hits = state.where(F.col("n") >= min_count).select(lang.alias("lang"), phrase.alias("phrase"), k.alias("k")).where(F.col("k").between(1, MAX_WORDS - 1))
        maps.append(grown(maps[step], phrase_hashes(hits), filter_bits))
        fresh |= {n: step for n, m in maps[-1].items() if m is not maps[step][n]}
        if step >= shards:
            maps[step - shards] = None
        old, step = at, step + 1
    remove(spark, path)
    return state.where((F.col("n") >= min_count) | F.endswith("key", F.lit("\t"))).select(lang.alias("lang"), k.alias("k"), phrase.alias("phrase"), "n")


def collocations(frequent: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """frequent_phrases' rows -> (lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases."""
    counted = frequent.where((F.col("k") > 0) & (F.col("n") >= min_count))
    part = counted.where(F.col("k") < MAX_WORDS).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    long_ = counted.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = long_.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', j)").alias("first"), F.expr("substring_index(phrase, ' ', j - k)").alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("b"))
    words = F.split("phrase", " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " "))))
    holders = long_.where("k > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = best.join(holders, ["lang", "phrase"], "left").where("longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * 80")
    order = [F.col("b.score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within parts of a language, so that no task sorts a whole language
    some = open_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = frequent.where("k = 0").select("lang", F.col("n").alias("n"))
    return some.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", F.col("b.score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(cut(frequent_phrases(documents(spark, sf_dir).select("doc_id", "lang", "text")), "frequent"))


ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM f WHERE k > 1),
parted AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM parted QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN sizes ON sizes.lang = r.lang WHERE rank <= {TOP}
"""
