"""Operator 3, quality rules as a bitmask ledger. Native: DataFrame functions alone.

Every rule is evaluated once on a row's measurements; the ledger keeps the measurements and one integer with a bit for
each failed rule. A policy is a version and a mask of rules: a row passes if `failed & mask` is 0. Ablations (what each
rule alone costs a policy) come from counts by ledger value, of which there are 2 ** rules at most.

Three-word windows are compared by 64-bit hashes within one text (a chance agreement needs 1 in 10**19 pairs).
Defined results: null or empty text has zero measurements and fails too_few_words; a text of white space alone likewise;
texts of one or two words have no window; repeated rows are measured alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import WORD_SPLIT, documents

#: name -> failure, over the measurements; a rule's bit is its place
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: version -> rules in force
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements..., failed)."""
    zero = F.lit(0).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("doc_id", F.filter(F.split("t", WORD_SPLIT), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    base = base.select(
        "doc_id",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", zero, lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))).alias("windows"),
    )
    # sorted hashes show whether there is any repeat; only then are places sorted along
    base = base.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    ranked = F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("ranked", ranked).drop("windows")
    n = F.size("ranked")
    again = F.filter("ranked", lambda x, k: (F.coalesce(F.get("ranked", k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("ranked", k + 1)["h"] == x["h"], F.lit(False))))
    base = base.withColumn("places", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("ranked")
    covered = F.aggregate("places", F.struct(zero.alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    measured = base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, zero).alias("n_repeat_words"))
    failed = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failed", failed.cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(found: DataFrame) -> DataFrame:
    """(policy, rule, n_rows, n_failed, n_only): rows that each policy fails, and those it fails by that rule alone."""
    counts = found.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p, rs in POLICIES.items() for r in rs]))
    hit = F.col("failed").bitwiseAND(F.col("x.mask"))
    each = counts.select("failed", "n", parts.alias("x"))
    return each.groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule")).agg(F.sum("n").alias("n_rows"), F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(hit == F.col("x.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(CURRENT)).alias("kept"), "failed")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM k),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM g, range(3) t(o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, 10 * n_symbols > word_chars AS c, 10 * n_dup_lines > 3 * n_lines AS e, word_chars < 2 * n_words AS s, word_chars > 20 * n_words AS l FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b OR c OR e OR s OR l) AS kept,
  (a::INT + 2 * b::INT + 4 * c::INT + 8 * e::INT + 16 * s::INT + 32 * l::INT)::BIGINT AS failed FROM f
"""
