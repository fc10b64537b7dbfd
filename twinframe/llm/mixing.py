"""Operator 4, mixing sources to target weights by hierarchical budgeting. Native: DataFrame functions alone.

Token budgets flow from the root of a domain-language-source tree to its leaves by the children's weights. A child
never gets more than its subtree can give (its tokens times `max_epochs`); what it can't use goes to its siblings in
proportion to their weights, and only what a whole subtree can't use reaches the subtree's own siblings. Among
siblings this water level has a closed form over running sums by capacity per weight. A leaf then takes its whole
epochs, and from the next epoch, in that epoch's seeded order, the longest prefix of documents whose tokens fit.

The prefix is found without gathering a leaf: tokens are summed by 4096 stretches of the order, the stretch with the
budget's end is found from their running sums, and only that stretch is walked row by row.
Defined results: null or empty texts have no tokens; a null level is the level's own group; a weight of zero or less
(with all below it) gets nothing; rows of one doc_id share their place in the order and are taken together; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.llm.common import WORD_SPLIT, cut, documents

#: A tree of at most so many leaves is broadcast (some MB); a larger one is joined by its keys.
BROADCAST_LEAVES = 20_000
SHARE, MAX_EPOCHS, SEED, PIPELINE_SHARE = 0.5, 2, 42, 0.5
#: Weights by path; a path that isn't listed weighs 1.
WEIGHTS: Mapping[tuple[str, ...], float] = {("d0",): 2.0, ("d0", "en"): 3.0, ("d1", "en"): 2.0}


def tree(source: Column, lang: Column) -> dict[str, Column]:
    """Levels of `documents`: a domain is a fixed quarter of the sources."""
    return {"domain": F.concat(F.lit("d"), F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 2), 16, 10).cast("int") % 4), "lang": lang, "source": source}


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch, in [0, 2**60)."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def budgets(leaves: DataFrame, levels: list[str], share: float, max_epochs: int, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """leaves (levels..., tokens) -> (levels..., tokens, budget): water levels from the root down."""

    def weight(depth: int) -> Column:
        out = F.lit(1.0)
        for path, w in weights.items():
            if len(path) == depth:
                out = F.when(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(levels, path, strict=False)]), F.lit(float(w))).otherwise(out)
        return out

    alive = reduce(Column.__and__, [weight(d) > 0 for d in range(1, len(levels) + 1)])
    sized = leaves.withColumn("capacity", F.when(alive, F.col("tokens") * float(max_epochs)).otherwise(F.lit(0.0)))
    all_of = Window.partitionBy(F.lit(0))  # one row for each leaf of the tree
    sized = sized.withColumn("b0", F.least(F.sum("capacity").over(all_of), F.sum("tokens").over(all_of) * share))
    for depth in range(1, len(levels) + 1):
        parent, own = levels[: depth - 1], levels[:depth]
        nodes = sized.groupBy(*own).agg(F.sum("capacity").alias("c"), F.first(f"b{depth - 1}").alias("b")).withColumn("w", F.when(F.col("c") > 0, weight(depth)).otherwise(F.lit(0.0)))
        among = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        ordered = among.orderBy(F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(float("inf"))), *own)
        before = F.coalesce(F.sum("c").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        behind = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", (F.col("w") <= 0) | (F.col("c") / F.nullif(F.col("w"), F.lit(0.0)) * behind + before <= F.col("b")))
        spent = F.sum(F.when(F.col("full"), F.col("c")).otherwise(0.0)).over(among)
        open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(among)
        nodes = nodes.withColumn(f"b{depth}", F.when(F.col("full"), F.col("c")).otherwise(F.round((F.col("b") - spent) * F.col("w") / open_, 6)))
        on = reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in own])
        sized = sized.alias("s").join(nodes.alias("n"), on).select("s.*", f"n.b{depth}")
    return sized.select(*levels, "tokens", F.col(f"b{len(levels)}").alias("budget"))


def small(leaves: DataFrame) -> DataFrame:
    """A table with a row for each leaf, broadcast if it is counted to be small."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def leaf_cuts(rows: DataFrame, levels: list[str], share: float, max_epochs: int, seed: int, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """rows (doc_id, levels..., n_tokens) -> (levels..., budget, epochs, last): whole epochs, and the last place taken
    from the next one (null: none)."""
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, levels, share, max_epochs, weights)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("need", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")

    plan = small(plan)

    def same(a: str, b: str) -> Column:
        return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in levels])

    placed = rows.alias("r").join(plan.where("need > 0").alias("p"), same("r", "p")).select("r.*", "need", order_key(F.col("r.doc_id"), F.col("epochs"), seed).alias("u"))
    placed = placed.withColumn("stretch", F.shiftright("u", 48))
    sums = placed.groupBy(*levels, "stretch").agg(F.sum("n_tokens").alias("t"), F.first("need").alias("need"), F.max("u").alias("top"))
    run = Window.partitionBy(*levels).orderBy("stretch")
    sums = cut(sums.withColumn("until", F.sum("t").over(run)), "stretches")
    below = sums.where("until <= need").groupBy(*levels).agg(F.max("top").alias("last"))
    edge = sums.where("until > need and until - t <= need").select(*levels, F.col("stretch"), (F.col("until") - F.col("t")).alias("before"))
    walk = Window.partitionBy(*levels, "stretch").orderBy("u")  # by value: equal places stand or fall together
    inside = placed.alias("r").join(edge.alias("e"), same("r", "e") & (F.col("r.stretch") == F.col("e.stretch"))).select("r.*", "before")
    inside = inside.withColumn("sum", F.col("before") + F.sum("n_tokens").over(walk)).where("sum <= need").groupBy(*levels).agg(F.max("u").alias("last"))
    last = below.unionByName(inside).groupBy(*levels).agg(F.max("last").alias("last"))
    return small(cut(plan.alias("p").join(last.alias("l"), same("p", "l"), "left").select(*[f"p.{c}" for c in levels], "budget", "epochs", "last"), "cuts"))


def copies(docs: DataFrame, levels: dict[str, Column], share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Mapping[tuple[str, ...], float] = WEIGHTS) -> DataFrame:
    """(doc_id, levels..., n_tokens, budget, copies): how often the mix holds each row."""
    rows = cut(docs.select(F.col("doc_id"), *[e.cast("string").alias(k) for k, e in levels.items()], n_tokens(F.col("text")).alias("n_tokens")), "leaves")
    cuts = leaf_cuts(rows, list(levels), share, max_epochs, seed, weights)
    on = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in levels])
    taken = F.col("epochs") + F.coalesce((order_key(F.col("doc_id"), F.col("epochs"), seed) <= F.col("last")).cast("long"), F.lit(0))
    return rows.alias("r").join(cuts.alias("k"), on).select("r.*", "budget", taken.alias("copies"))


def mix(docs: DataFrame, levels: dict[str, Column], share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Mapping[tuple[str, ...], float] = WEIGHTS) -> DataFrame:
    """The documents' columns, each row as often as the mix holds it."""
    apart = max(docs.columns, key=len)  # longer than any column's name
    names = [f"{apart}_level_{i}" for i in range(len(levels))]
    rows = cut(docs.select("doc_id", *[e.cast("string").alias(n) for n, e in zip(names, levels.values(), strict=True)], n_tokens(F.col("text")).alias("n_tokens")), "leaves")
    cuts = leaf_cuts(rows, names, share, max_epochs, seed, weights).select(*[F.col(n).alias(f"cut_{n}") for n in names], F.col("epochs").alias(f"{apart}_epochs"), F.col("last").alias(f"{apart}_last"))
    cuts = small(cuts)
    on = reduce(Column.__and__, [e.cast("string").eqNullSafe(F.col(f"cut_{n}")) for n, e in zip(names, levels.values(), strict=True)])
    epochs, last = F.col(f"{apart}_epochs"), F.col(f"{apart}_last")
    taken = epochs + F.coalesce((order_key(docs.doc_id, epochs, seed) <= last).cast("long"), F.lit(0))
    joined = docs.join(cuts, on).where(taken > 0)
    if max_epochs > 1:
        free = max(docs.columns, key=len) + "_copy"  # no column's name
        return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), taken.cast("int"))).alias(free)).drop(free)
    return joined.select(*[docs[c] for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return copies(docs, tree(docs.source, docs.lang))


def _level_sql(depth: int, keys: str, parent: str, weight: str) -> str:
    """Water level of one depth, from s{depth-1} (leaves with b{depth-1}) to s{depth}."""
    over = f"PARTITION BY {parent}" if parent else ""
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM n.{k}" for k in keys.split(", "))
    return f"""
n{depth} AS (SELECT {keys}, sum(capacity) AS c, any_value(b{depth - 1}) AS b, CASE WHEN sum(capacity) > 0 THEN {weight} ELSE 0.0::DOUBLE END AS w FROM s{depth - 1} GROUP BY {keys}),
o{depth} AS (SELECT *, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM n{depth} WINDOW o AS ({over} ORDER BY CASE WHEN w > 0 THEN c / w ELSE 'inf'::DOUBLE END, {keys})),
f{depth} AS (SELECT *, w <= 0 OR c / nullif(w, 0) * behind + before <= b AS full_ FROM o{depth}),
a{depth} AS (SELECT {keys}, CASE WHEN full_ THEN c ELSE round((b - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER ({over})) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over}), 6) END AS b{depth} FROM f{depth}),
s{depth} AS (SELECT s.*, n.b{depth} FROM s{depth - 1} s JOIN a{depth} n ON {same}),"""


ORACLE = (
    f"""
WITH rows_ AS (SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 2))::BIGINT % 4) AS domain, lang, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens FROM rows_ GROUP BY ALL),
s0 AS (SELECT *, tokens * {MAX_EPOCHS} AS capacity, least(sum(tokens * {MAX_EPOCHS}) OVER (), sum(tokens) OVER () * {SHARE}::DOUBLE) AS b0 FROM leaves),"""
    + _level_sql(1, "domain", "", "CASE WHEN domain = 'd0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")
    + _level_sql(2, "domain, lang", "domain", "CASE WHEN domain = 'd0' AND lang = 'en' THEN 3.0::DOUBLE WHEN domain = 'd1' AND lang = 'en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")
    + _level_sql(3, "domain, lang, source", "domain, lang", "1.0::DOUBLE")
    + f"""
plan AS (SELECT domain, lang, source, b3 AS budget, CASE WHEN tokens > 0 THEN floor(b3 / tokens) ELSE 0 END::BIGINT AS epochs, tokens FROM s3),
placed AS (SELECT r.*, budget, epochs, budget - epochs * tokens AS need, ('0x' || substr(md5('{SEED}:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS u
  FROM rows_ r JOIN plan p ON r.domain = p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, budget, epochs + (need > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY u) <= need)::BIGINT AS copies FROM placed"""
)
