"""Attributions of a model's scores, as long tables (id, feature, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from twinframe.operators import stats
from twinframe.operators.quantiles import percentiles

#: rows of a background sample, broadcast to every task
BACKGROUND = 200
#: rows of a block inside which a column is shuffled; a row's block is random
BLOCK = 100_000


def weights(model: PipelineModel) -> dict[str, tuple[float, float]]:
    """Of a scaled logistic pipeline: (slope on the raw feature, slope for one standard deviation) by feature."""
    assembler, scaler, linear = model.stages
    return {c: (b / s if s else 0.0, b) for c, b, s in zip(assembler.getInputCols(), linear.coefficients.toArray().tolist(), scaler.std.toArray().tolist(), strict=True)}


def linear(model: PipelineModel, df: DataFrame, background: DataFrame, id_col: str) -> DataFrame:
    """Each feature's share of the log odds, against the background's mean."""
    w = weights(model)
    mean = background.agg(*[F.avg(c).alias(f"m_{c}") for c in w])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"m_{c}")) * raw).alias("value")) for c, (raw, _) in w.items()])
    return df.join(F.broadcast(mean)).select(id_col, F.explode(parts).alias("x")).select(id_col, "x.*")


def odds_ratios(model: PipelineModel) -> list[tuple[str, float]]:
    """Odds ratio for one more standard deviation, farthest from 1 first."""
    import math

    return [(c, math.exp(b)) for c, (_, b) in sorted(weights(model).items(), key=lambda x: (-abs(x[1][1]), x[0]))]


def permutation_shapley(score: Callable[[DataFrame], DataFrame], df: DataFrame, background: DataFrame, features: Sequence[str], id_col: str, n: int = 8, seed: int = 0) -> DataFrame:
    """Sampled Shapley values: each row enters a background row feature by feature, in n seeded orders.

    `score` adds column p. One scoring job over rows x n x (features + 1); a row's values add up to its p less the mean p of
    the background rows drawn for it. The background is at most BACKGROUND rows by hash order, a documented sample.
    """
    d = len(features)
    drawn = background.select(*features).orderBy(F.xxhash64(F.lit(seed), *features), *features).limit(BACKGROUND)
    rows = drawn.agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in features])).alias("bg_"))
    order = F.transform(F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col(id_col), F.col("k_"), F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in features])), lambda s: s.c)
    at = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col("k_")), F.size("bg_")).cast("int")
    walk = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in features]).join(F.broadcast(rows)).where(F.size("bg_") > 0).withColumn("k_", F.explode(F.sequence(F.lit(1), F.lit(n))))
    walk = walk.withColumns({"order_": order, "b_": F.get("bg_", at)}).drop("bg_").withColumn("step_", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = walk.withColumns({c: F.when(F.array_position("order_", c) <= F.col("step_"), F.col(c)).otherwise(F.col(f"b_.{c}")) for c in features})
    signed = F.array(F.struct(F.get("order_", F.col("step_") - 1).alias("feature"), F.col("p").alias("v")), F.struct(F.get("order_", F.col("step_")).alias("feature"), (-F.col("p")).alias("v")))
    moved = score(mixed).select(id_col, F.explode(signed).alias("x")).where("x.feature is not null")
    return moved.groupBy(id_col, F.col("x.feature").alias("feature")).agg((F.sum("x.v") / n).alias("value"))


def top_contributions(attributions: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Each row's k largest values by size; an id has as many entries as there are features."""
    one = F.struct((-F.abs("value")).alias("size"), "feature", "value")
    return attributions.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("t_")).select(id_col, F.transform("t_", lambda s: F.struct(s.feature.alias("feature"), s.value.alias("value"))).alias("top"))


def global_importance(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def permuted(df: DataFrame, features: Sequence[str], id_col: str, repeats: int, seed: int, blocks: int) -> DataFrame:
    """df once as it is (feature ''), and once for each feature and repeat with that feature's values moved on along a random order of
    the rows of each random block. Rows are scanned and dealt to their blocks once; a task moves a block's values for all copies."""
    copies, names = [(c, r) for c in features for r in range(repeats)], df.columns
    own = {c: f"own{i}_" for i, c in enumerate(dict.fromkeys(features))}
    rows = df.withColumn("block_", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(blocks))).repartition("block_")
    rows = rows.select("*", *[F.col(c).cast("double").alias(o) for c, o in own.items()], *[F.xxhash64(F.lit(seed + 1), F.lit(c), F.lit(r), F.col(id_col)).alias(f"place{i}_") for i, (c, r) in enumerate(copies)])

    def move(table: pa.Table) -> pa.Table:
        n, taken = table.num_rows, [pa.array([], pa.float64())]
        for i, (c, _) in enumerate(copies):
            order = np.argsort(table[f"place{i}_"].to_numpy(), kind="stable")
            after = np.empty_like(order)
            after[order] = np.roll(order, -1)
            taken.append(table[own[c]].combine_chunks().take(pa.array(after)))
        by_row = pa.concat_arrays(taken).take(pa.array(np.arange(len(copies) * n).reshape(len(copies), n).T.ravel()))
        moved = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(copies), pa.int32()), by_row)
        return table.select(names).append_column("moved_", moved)

    moved = rows.groupBy("block_").applyInArrow(move, StructType([*df.schema.fields, StructField("moved_", ArrayType(DoubleType()))]))
    copy = lambda c, r, v: F.struct(F.lit(c).alias("feature"), F.lit(r).alias("rep"), v.alias("v"))
    each = [copy("", 0, F.lit(None).cast("double")), *[copy(c, r, F.get("moved_", F.lit(i))) for i, (c, r) in enumerate(copies)]]
    out = moved.select(*names, F.explode(F.array(*each)).alias("k_"))
    return out.select(*[F.when(F.col("k_.feature") == c, F.col("k_.v")).otherwise(F.col(c)).alias(c) if c in own else c for c in names], "k_.feature", "k_.rep")


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], id_col: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Mean and deviation of the AUC's fall when one feature is shuffled; df is read and scored once for all features and repeats."""
    blocks = df.count() // BLOCK + 1
    a = stats.auc(score(permuted(df, features, id_col, repeats, seed, blocks)), "p", by=("feature", "rep"))
    base = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy())  # over a row for each copy
    fall = a.withColumn("fall_", base - F.col("auc")).where("feature <> ''")
    return fall.groupBy("feature").agg(F.avg("fall_").alias("auc_drop"), F.stddev_pop("fall_").alias("sd"))


def grouped_load(attributions: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """The summed value of a set of features by row."""
    return attributions.where(F.col("feature").isin(*features)).groupBy(id_col).agg(F.sum("value").alias("load"))


def band_contrast(df: DataFrame, load: str, by: str, split: str, lo: float, hi: float) -> DataFrame:
    """Mean load of rows with lo <= by <= hi, below or at and above the band's median of split."""
    band = df.where(F.col(by).between(lo, hi))
    middle = percentiles(band, split, [0.5]).agg(F.max("value").alias("m_"))  # one row, null for an empty band
    out = band.join(F.broadcast(middle)).agg(F.avg(F.when(F.col(split) <= F.col("m_"), F.col(load))).alias("low"), F.avg(F.when(F.col(split) > F.col("m_"), F.col(load))).alias("high"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("difference", F.col("high") - F.col("low"))
