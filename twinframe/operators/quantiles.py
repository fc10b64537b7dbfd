"""Exact percentiles by distributed selection: no buffer and no window ever holds a whole column.

Each wanted rank starts with its group's whole range. While its range holds more than `limit` rows, a sketch of fixed size splits
the range at values that occur, rows are counted by part, and the part with the rank is kept; so a range gets some GRID times
smaller in each round. Values that are edges are parts of their own, so a value that fills a range ends the search for it.
Only the rows of ranges that are left are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.stages import same, written

#: parts that a round splits a range into, and the rows that a range may hold to be sorted
GRID, LIMIT = 64, 100_000


def select_ranks(rows: DataFrame, targets: DataFrame, by: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """rows (by..., x), targets (by..., at, rank from 0) -> targets with value, the row of that rank by x ascending."""
    by = list(by)
    key = [*by, "at", "rank"]
    sizes = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("inside"))
    open_ = targets.alias("t").join(sizes.alias("s"), same("t", "s", by)).select(*[F.col(f"t.{c}") for c in key], "lo", "hi", F.lit(0).cast("long").alias("below"), "inside")
    now = written(open_, "ranks")
    wide = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))

    def met(ranges: DataFrame) -> DataFrame:
        on = same("r", "t", by) & F.col("r.x").between(F.col("t.lo"), F.col("t.hi"))
        return rows.alias("r").join(ranges.alias("t"), on).select(*[F.col(f"t.{c}") for c in [*key, "below"]], "x")

    while not now.where(wide).isEmpty():
        inside = met(now.where(wide))
        edges = inside.groupBy(*key).agg(F.percentile_approx("x", F.array(*[F.lit(i / GRID) for i in range(1, GRID)]), 10 * GRID).alias("e"))
        part = F.size(F.filter("e", lambda v: v < F.col("x"))) * 2 + F.array_contains("e", F.col("x")).cast("int")
        split = inside.alias("i").join(edges.alias("e"), same("i", "e", key)).select(*[F.col(f"i.{c}") for c in [*key, "below", "x"]], part.alias("part"))
        counts = split.groupBy(*key, "part").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("inside"), F.first("below").alias("base"))
        upto = F.sum("inside").over(Window.partitionBy(*key).orderBy("part"))  # at most 2 * GRID rows for each rank
        found = counts.withColumn("below", F.col("base") + upto - F.col("inside")).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside")))
        now = written(now.where(~wide).unionByName(found.select(*now.columns)), "ranks")
    alone = now.where("lo = hi").select(*key, F.col("lo").alias("value"))
    listed = met(now.where("lo < hi")).groupBy(*key, "x").agg(F.count(F.lit(1)).alias("n"), F.first("below").alias("below"))
    last = F.col("below") + F.sum("n").over(Window.partitionBy(*key).orderBy("x"))  # at most `limit` rows for each rank
    picked = listed.withColumn("last", last).where((F.col("last") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("last")))
    return alone.unionByName(picked.select(*key, F.col("x").alias("value")))


def percentiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """(by..., at, value): the exact percentile of each group's values for each of `shares`, interpolated between neighbours;
    at: place in `shares`, from 0. Nulls are left out; a group without values has no row."""
    by = list(by)
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    wanted = sizes.select(*by, "n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("at", "share"))
    wanted = wanted.withColumn("place", F.col("share") * (F.col("n") - 1))
    low, high = F.floor("place"), F.ceil("place")
    targets = wanted.select(*by, "at", F.explode(F.array_distinct(F.array(low, high))).alias("rank"))
    found = select_ranks(rows, targets, by, limit)
    joined = wanted.alias("w").join(found.alias("f"), same("w", "f", [*by, "at"]))
    weight = F.when(low == high, F.lit(1.0)).when(F.col("rank") == low, high - F.col("place")).otherwise(F.col("place") - low)
    return joined.groupBy(*[F.col(f"w.{c}").alias(c) for c in [*by, "at"]]).agg(F.sum(F.col("value") * weight).alias("value"))
