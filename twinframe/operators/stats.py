"""Comparison of scores: ranks, ROC, DeLong, calibration, multiple testing, and exploratory tables.

Ranks over all rows are built from distinct score values: running sums inside about EDGES ranges of the score and the
totals of the ranges before, so no window gathers all rows in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FractionalType, IntegralType, StructField, StructType

from twinframe.functions.stages import written
from twinframe.operators.quantiles import percentiles
from twinframe.operators.resampling import RANGE_ROWS, block_bootstrap  # noqa: F401  (block_bootstrap is part of this module's interface)

EDGES = 64
#: fixed values: critical values of the studentised range for infinite degrees of freedom at 0.05, over sqrt(2), by number of models
NEMENYI = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def running(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of columns over all rows of a smaller `order` value (distinct in a group of `by`): {new column: column}."""
    df = written(df, "levels")  # read three times from here on
    edges = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / EDGES) for i in range(1, EDGES)]), 1000).alias("e")).first().e or []
    edges = sorted({float(x) for x in edges})

    def below(lo: int, hi: int) -> Column:  # edges below the value, halving their range
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.lit(edges[mid]) < F.col(order), below(mid + 1, hi)).otherwise(below(lo, mid))

    df = df.withColumn("bucket_", below(0, len(edges)))
    in_order = Window.partitionBy(*by, "bucket_").orderBy(order)
    totals = df.groupBy(*by, "bucket_").agg(*[F.sum(c).alias(f"{n}_t_") for n, c in sums.items()])  # EDGES rows a group at most
    before = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "bucket_", *[F.coalesce(F.sum(f"{n}_t_").over(before), F.lit(0)).alias(f"{n}_o_") for n in sums])
    out = df.join(offsets if by else F.broadcast(offsets), [*by, "bucket_"]).withColumns({n: F.sum(c).over(in_order) - F.col(c) + F.col(f"{n}_o_") for n, c in sums.items()})
    return out.drop("bucket_", *[f"{n}_o_" for n in sums])


def levels(df: DataFrame, score: str, y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each distinct score (of a group): pos, neg, and pos and neg below it."""
    v = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    return running(v, "score", {"pos_below": "pos", "neg_below": "neg"}, by)


def midrank(df: DataFrame, col: str) -> DataFrame:
    """Ranks of all rows, ties averaged: (value, n, midrank)."""
    v = running(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", {"below": "n"})
    return v.select("value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("midrank"))


def auc(df: DataFrame, score: str, y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group; null where a class is missing.

    Rows are dealt by ranges of group and score, and a range gives one row for each of its groups. Equal scores are summed before,
    batch by batch, so a common one fills no range.
    """
    types = {c: df.schema[c].dataType for c in (score, y)}
    if not isinstance(types[score], FractionalType) or not isinstance(types[y], (IntegralType, DoubleType)) or isinstance(types[score], DecimalType):
        return auc_of(levels(df, score, y, by), by)
    names = [f"g{i}_" for i in range(len(by))]
    rows = df.where(F.col(score).isNotNull()).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(score).cast("double").alias("s_"), *[F.coalesce(c, F.lit(0)).cast("double").alias(n) for c, n in ((F.col(y), "pos_"), (1 - F.col(y), "neg_"))])

    def runs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows' order by group and score s_, and in it the first places of each level of a group and of each group."""
        codes = [rows.column(n).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for n in names]
        s = rows.column("s_").to_numpy()
        order = np.lexsort((s, *codes))
        group, s = np.arange(len(s)) == 0, s[order]
        for c in codes:
            group[1:] |= c[order][1:] != c[order][:-1]
        level = group.copy()
        level[1:] |= (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        return order, np.flatnonzero(level), np.flatnonzero(group)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                order, level, _ = runs(rows)
                at = pa.array(order[level])
                yield pa.RecordBatch.from_arrays([*[rows.column(n).take(at) for n in (*names, "s_")], *[pa.array(np.add.reduceat(rows.column(c).to_numpy()[order], level)) for c in ("pos_", "neg_")]], [*names, "s_", "pos_", "neg_"])

    def won(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        order, level, group = runs(rows)
        pos, neg = (np.add.reduceat(rows.column(c).to_numpy()[order], level) for c in ("pos_", "neg_"))
        first = np.searchsorted(level, group)  # each group's first level
        below = np.cumsum(neg) - neg
        below -= np.repeat(below[first], np.diff(np.append(first, len(level))))
        at = pa.array(order[group])
        yield pa.RecordBatch.from_arrays([*[rows.column(n).take(at) for n in (*names, "s_")], *[pa.array(np.add.reduceat(v, first)) for v in (pos, neg, pos * (below + neg / 2))]], [*names, "s_", "pos_", "neg_", "won_"])

    dealt = written(rows.mapInArrow(summed, rows.schema), "scores")
    ranges = max(1, -(-dealt.count() // RANGE_ROWS))
    parts = dealt.repartitionByRange(ranges, *names, "s_").mapInArrow(won, StructType([*rows.schema.fields, StructField("won_", DoubleType())]))
    before = Window.partitionBy(*names).orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    parts = parts.withColumn("before_", F.coalesce(F.sum("neg_").over(before), F.lit(0.0)))
    out = parts.groupBy(*names).agg(F.try_divide(F.sum(F.col("won_") + F.col("pos_") * F.col("before_")), F.sum("pos_") * F.sum("neg_")).alias("auc"), *[F.sum(c).cast("long" if isinstance(types[y], IntegralType) else "double").alias(n) for c, n in (("pos_", "n_pos"), ("neg_", "n_neg"))])
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, by, strict=True)], "auc", "n_pos", "n_neg")


def auc_of(v: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    won = F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    return v.groupBy(*by).agg(won.alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc(df: DataFrame, score: str, y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """(threshold, tpr, fpr, precision) of score >= threshold."""
    return roc_of(levels(df, score, y, by), by)


def roc_of(v: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    t = v.groupBy(*by).agg(F.sum("pos").alias("p_"), F.sum("neg").alias("n_"))
    v = (v.join(t, list(by)) if by else v.join(F.broadcast(t))).withColumns({"tp_": F.col("p_") - F.col("pos_below"), "fp_": F.col("n_") - F.col("neg_below")})
    return v.select(*by, F.col("score").alias("threshold"), F.try_divide("tp_", "p_").alias("tpr"), F.try_divide("fp_", "n_").alias("fpr"), (F.col("tp_") / (F.col("tp_") + F.col("fp_"))).alias("precision"), F.try_divide("pos", "p_").alias("step_"))


def average_precision(df: DataFrame, score: str, y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    return average_precision_of(levels(df, score, y, by), by)


def average_precision_of(v: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return roc_of(v, by).groupBy(*by).agg(F.sum(F.col("precision") * F.col("step_")).alias("average_precision"))


def youden(df: DataFrame, score: str, y: str = "y") -> DataFrame:
    """The cut with the largest tpr - fpr (the lowest of several)."""
    return roc(df, score, y).agg(F.max_by("threshold", F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), -F.col("threshold"))).alias("threshold"), F.max(F.round(F.col("tpr") - F.col("fpr"), 12)).alias("youden"))


def delong(df: DataFrame, a: str, b: str, y: str = "y") -> DataFrame:
    """One row: both AUCs, their difference, its standard error, z, 95 % interval and two-sided p-value."""
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    totals = out.agg(F.sum(y).alias("p_"), F.sum(1 - F.col(y)).alias("n_"))
    for name, col in (("a", a), ("b", b)):
        v = levels(out, col, y).join(F.broadcast(totals))
        v = v.select(F.col("score").alias(f"s{name}_"), ((F.col("neg_below") + F.col("neg") / 2) / F.col("n_")).alias(f"x{name}_"), ((F.col("p_") - F.col("pos_below") - F.col("pos") / 2) / F.col("p_")).alias(f"w{name}_"))
        out = out.join(v, F.col(col) == F.col(f"s{name}_"))
    pos, neg = F.col(y) == 1, F.col(y) == 0

    def only(c: str, m: Column) -> Column:
        return F.when(m, F.col(c))

    dx, dw = F.when(pos, F.col("xa_") - F.col("xb_")), F.when(neg, F.col("wa_") - F.col("wb_"))
    r = out.agg(F.avg(only("xa_", pos)).alias("auc_a"), F.avg(only("xb_", pos)).alias("auc_b"), (F.var_samp(dx) / F.count(dx) + F.var_samp(dw) / F.count(dw)).alias("v_"))
    r = r.select("auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("diff"), F.sqrt("v_").alias("se"), ((F.col("auc_a") - F.col("auc_b")) / F.nullif(F.sqrt("v_"), F.lit(0.0))).alias("z"))
    return r.withColumns({"lo": F.col("diff") - 1.96 * F.col("se"), "hi": F.col("diff") + 1.96 * F.col("se"), "p_value": two_sided(F.col("z"))})


def delong_ci(df: DataFrame, score: str, y: str = "y", z: float = 1.959963984540054) -> DataFrame:
    """One row: the AUC, its standard error and its interval, cut to 0 and 1."""
    v = levels(df, score, y)
    t = v.agg(F.sum("pos").alias("p_"), F.sum("neg").alias("n_"))
    v = v.join(F.broadcast(t)).withColumns({"x_": (F.col("neg_below") + F.col("neg") / 2) / F.col("n_"), "w_": (F.col("p_") - F.col("pos_below") - F.col("pos") / 2) / F.col("p_")})

    def variance(c: str, n: str) -> Column:  # of the mean of c over n rows, each level counted n times
        m = F.sum(F.col(n) * F.col(c)) / F.sum(n)
        return F.try_divide(F.sum(F.col(n) * F.col(c) ** 2) - F.sum(n) * m * m, (F.sum(n) - 1) * F.sum(n))

    r = v.agg((F.sum(F.col("pos") * F.col("x_")) / F.sum("pos")).alias("auc"), F.sqrt(variance("x_", "pos") + variance("w_", "neg")).alias("se"))
    return r.select("auc", "se", F.greatest(F.lit(0.0), F.col("auc") - z * F.col("se")).alias("lo"), F.least(F.lit(1.0), F.col("auc") + z * F.col("se")).alias("hi"))


def circular_permutation(df: DataFrame, score: str, group: str, order: list[str], y: str = "y", n: int = 500, seed: int = 0, metric: str = "auc") -> DataFrame:
    """One row: AUC or Brier score, and the share of n replicates that do as well when each group's scores turn by a seeded offset
    in its order.

    A turn changes neither ranks nor squares, so a replicate only sums the ranks (or probabilities) that its positives meet.
    `order` must be unique in a group; rows without a score are left out.
    """
    if metric not in ("auc", "brier"):
        raise ValueError("metric must be auc or brier")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    if metric == "auc":
        ranks = midrank(df, score).select(F.col("value").alias("v_"), F.col("midrank").alias("r_"))
        used = df.join(ranks, F.col(score) == F.col("v_"))
    else:
        used = df.where(F.col(score).isNotNull()).withColumn("r_", F.col(score).cast("double"))
    rows = used.select(F.col(group).alias("g_"), F.col(y).alias("y_"), "r_", place.alias("i_"))
    # a group is a unit's days, so its ranks are one array; what it gives out is a sum for each replicate
    groups = rows.select(F.coalesce(F.col("g_").cast("string"), F.lit("")).alias("g_"), F.col("y_").cast("double").alias("y_"), F.col("r_").cast("double").alias("r_"), F.col("i_").cast("long").alias("i_"))

    def turned(table: pa.Table) -> pa.Table:
        order = np.argsort(table["i_"].to_numpy())
        ranks, met = table["r_"].to_numpy()[order], np.flatnonzero(table["y_"].to_numpy()[order] == 1)
        name, m = table["g_"][0].as_py(), len(order)
        digests = [hashlib.md5(":".join([str(seed), str(rep), *([name] if name else [])]).encode(), usedforsecurity=False).hexdigest()[:8] for rep in range(1, n + 1)]
        offsets = [1 + int(h, 16) % (m - 1) if m > 1 else 0 for h in digests]
        sums = [ranks[(met - off) % m].sum() for off in offsets] if len(met) else []
        return pa.table({"rep_": pa.array(range(1, len(sums) + 1), pa.int32()), "s_": pa.array(sums, pa.float64())})

    sums = groups.groupBy("g_").applyInArrow(turned, "rep_ int, s_ double").groupBy("rep_").agg(F.sum("s_").alias("s_"))
    t = rows.agg(F.sum("y_").alias("p_"), F.sum(1 - F.col("y_")).alias("n_"), F.sum(F.when(F.col("y_") == 1, F.col("r_"))).alias("o_"), F.sum(F.col("r_") ** 2).alias("q_"))

    def value(s: str) -> Column:
        if metric == "brier":
            return F.try_divide(F.col("q_") + F.col("p_") - 2 * F.coalesce(F.col(s), F.lit(0.0)), F.col("p_") + F.col("n_"))
        return F.try_divide(F.col(s) - F.col("p_") * (F.col("p_") + 1) / 2, F.col("p_") * F.col("n_"))

    each = t.join(sums, how="left").withColumns({metric: value("o_"), "turned_": value("s_")})
    well = F.col("turned_") >= F.col(metric) - 1e-12 if metric == "auc" else F.col("turned_") <= F.col(metric) + 1e-12
    return each.groupBy(metric).agg(((F.count_if(well & F.col("s_").isNotNull()) + 1) / (F.count("s_") + 1)).alias("p_value"), F.count("s_").alias("replicates"))


def calibration_line(df: DataFrame, p: str, y: str = "y") -> dict[str, float]:
    """Slope of a logistic fit on the log odds of p, and intercept of one with that slope held at 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.where(F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y_"), F.ln(q / (1 - q)).alias("odds_"), F.lit(0.0).alias("zero_"))
    free = GeneralizedLinearRegression(family="binomial", labelCol="y_", featuresCol="x_").fit(VectorAssembler(inputCols=["odds_"], outputCol="x_").transform(rows))
    held = GeneralizedLinearRegression(family="binomial", labelCol="y_", featuresCol="x_", offsetCol="odds_", regParam=1e-9).fit(VectorAssembler(inputCols=["zero_"], outputCol="x_").transform(rows))
    return {"slope": float(free.coefficients[0]), "intercept": float(held.intercept)}


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a normal deviate: the complementary error function by its continued fraction, or near 0 its series."""
    x = F.abs(z) / math.sqrt(2)
    tail = reduce(lambda below, k: x + (k / 2) / below, range(60, 0, -1), x)
    far = F.exp(-x * x) / (tail * math.sqrt(math.pi))
    series, term = x, x
    for k in range(1, 40):
        term = term * (-x * x / k)
        series = series + term / (2 * k + 1)
    return F.when(x > 2, far).otherwise(1 - series * (2 / math.sqrt(math.pi)))


def chi2_upper(x: Column, df: int) -> Column:
    """P(chi-square with df degrees of freedom >= x), by its finite sums."""
    half = x / 2
    if df % 2 == 0:
        return F.exp(-half) * reduce(lambda a, k: a * half / k + 1, range(df // 2 - 1, 0, -1), F.lit(1.0))
    out, term = two_sided(F.sqrt(x)), F.sqrt(half) / math.gamma(1.5) * F.exp(-half)
    for k in range(1, (df - 1) // 2 + 1):
        out, term = out + term, term * half / (k + 0.5)
    return out


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def brier(df: DataFrame, p: str, y: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(y).alias("prevalence"))


def spiegelhalter(df: DataFrame, p: str, y: str = "y") -> DataFrame:
    """One row: z and its two-sided p-value; probabilities are kept from 0 and 1 by 1e-6."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.agg((F.sum((F.col(y) - q) * (1 - 2 * q)) / F.sqrt(F.sum((1 - 2 * q) ** 2 * q * (1 - q)))).alias("z")).withColumn("p_value", two_sided(F.col("z")))


def binned_rate(df: DataFrame, x: str, y: str, n: int = 12) -> DataFrame:
    """Event rate in equal-frequency bins, with its standard error; edges are exact percentiles, repeated ones count once."""
    edges = percentiles(df, x, [i / n for i in range(n + 1)]).agg(F.array_sort(F.collect_set("value")).alias("e"))  # n + 1 rows
    at = df.where(F.col(x).isNotNull()).join(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("e", lambda v: v < F.col(x)))))
    out = at.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"), F.min(F.get("e", F.col("bin") - 1)).alias("lo"), F.min(F.get("e", F.col("bin"))).alias("hi"))
    return out.select("bin", "n", "rate", F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")).alias("se"), ((F.col("lo") + F.col("hi")) / 2).alias("mid"))


def reliability(df: DataFrame, p: str, y: str = "y", n: int = 10) -> DataFrame:
    return binned_rate(df, p, y, n)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    middle = percentiles(long, "v", [0.5], by=["feature"]).select("feature", F.col("value").alias("median"))
    out = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max")).join(middle, "feature", "left")
    return out.select("feature", "mean", "sd", "min", "median", "max")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ra = midrank(df, a).select(F.col("value").alias("va_"), F.col("midrank").alias("ra_"))
    rb = midrank(df, b).select(F.col("value").alias("vb_"), F.col("midrank").alias("rb_"))
    return df.join(ra, F.col(a) == F.col("va_")).join(rb, F.col(b) == F.col("vb_")).agg(F.corr("ra_", "rb_").alias("rho"))


def spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, rho) of each two columns, the strongest first; ranks of a column are over its own values."""
    out = df.select(*[F.col(c).alias(f"x{i}_") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        out = out.join(midrank(out, f"x{i}_").select(F.col("value").alias(f"v{i}_"), F.col("midrank").alias(f"r{i}_")), F.col(f"x{i}_") == F.col(f"v{i}_"), "left")
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = out.agg(*[F.corr(f"r{i}_", f"r{j}_").alias(f"c{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"c{i}_{j}").alias("rho")) for i, j in pairs])).alias("p")).select("p.*").orderBy(F.abs("rho").desc(), "a", "b")


def log_histogram(df: DataFrame, x: str, n: int = 30) -> DataFrame:
    v = df.where(F.col(x) > 0).select(F.log10(x).alias("v"))
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = v.join(F.broadcast(r)).withColumn("bin", F.least(F.lit(n), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n)) + 1))
    return b.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def holm(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p) of a family of tests -> step-down adjusted p-values. A family has a row for each comparison made."""
    order = Window.orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy())
    adjusted = F.least(F.lit(1.0), F.col("p") * (m - F.row_number().over(order) + 1))
    return df.withColumn("x_", adjusted).withColumn("p_adjusted", F.max("x_").over(order)).withColumn("reject", F.col("p_adjusted") <= alpha).drop("x_")


def mean_ranks(df: DataFrame) -> DataFrame:
    """(block, model, score) -> mean rank of each model; higher scores rank first, ties averaged."""
    by = Window.partitionBy("block").orderBy(F.col("score").desc())
    ranked = df.withColumn("r_", F.rank().over(by) + (F.count(F.lit(1)).over(Window.partitionBy("block", "score")) - 1) / 2)
    return ranked.groupBy("model").agg(F.avg("r_").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def friedman(df: DataFrame) -> DataFrame:
    """(block, model, score) -> chi-square of mean ranks (corrected for ties within blocks), its p-value, the number of blocks and
    models, and the critical difference of mean ranks. Blocks without a score of every model are left out."""
    models = df.select("model").distinct().count()
    whole = Window.partitionBy("block")
    df = df.where("score IS NOT NULL").withColumn("m_", F.count(F.lit(1)).over(whole)).where(F.col("m_") == models).drop("m_")
    ties = df.groupBy("block", "score").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties_"))
    k, n = F.count(F.lit(1)), F.max("n")
    return mean_ranks(df).agg(k.cast("int").alias("models"), n.cast("int").alias("blocks"), (12 * n / (k * (k + 1)) * (F.sum(F.col("mean_rank") ** 2) - k * (k + 1) ** 2 / 4)).alias("raw_")).join(F.broadcast(ties)).withColumn(
        "chi2", F.col("raw_") / (1 - F.col("ties_") / (F.col("blocks") * (F.lit(models) ** 3 - models)))
    ).select("models", "blocks", "chi2", chi2_upper(F.col("chi2"), models - 1).alias("p_value"), (NEMENYI[models] * F.sqrt(F.lit(models * (models + 1) / 6) / F.col("blocks"))).alias("critical_difference"))


def critical_difference(models: int, blocks: int) -> float:
    return NEMENYI[models] * math.sqrt(models * (models + 1) / (6 * blocks))


def corrected_t(df: DataFrame, col: str, n_train: int, n_test: int) -> DataFrame:
    n = F.count(col)
    return df.agg(F.avg(col).alias("mean"), (F.avg(col) / F.sqrt((1 / n + F.lit(n_test / n_train)) * F.var_samp(col))).alias("t"))


def diebold_mariano(losses: DataFrame, lag: int | None = None) -> DataFrame:
    """(day, d): daily loss differences, one row a day -> mean, Newey-West variance of the mean, statistic, two-sided p-value. The
    default lag is the number of days to the power of a third, rounded down."""
    if lag is None:
        n = losses.where("d IS NOT NULL").count()
        lag = max(k for k in range(int(n ** (1 / 3)) + 2) if k**3 <= n)
    losses = losses.where("d IS NOT NULL")
    w = Window.orderBy("day")  # one row a day
    e = losses.withColumn("e_", F.col("d") - F.avg("d").over(Window.partitionBy()))
    e = e.withColumns({f"l{h}_": F.col("e_") * F.lag("e_", h).over(w) for h in range(1, lag + 1)})
    var = reduce(lambda a, h: a + 2 * (1 - h / (lag + 1)) * F.sum(f"l{h}_") / F.count(F.lit(1)), range(1, lag + 1), F.avg(F.col("e_") ** 2))
    r = e.agg(F.avg("d").alias("mean"), (var / F.count(F.lit(1))).alias("var"))
    return r.withColumn("dm", F.col("mean") / F.sqrt("var")).withColumn("p_value", two_sided(F.col("dm")))
