"""Exact selection against numpy, with groups, ties, nulls and ranges that need several rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import quantiles as qt
from twinframe.operators import stats

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    skewed = [("a", rng.choice([2.5, 2.5, 2.5, rng.random(), rng.lognormvariate(0, 5), -1e9])) for _ in range(3000)]
    return skewed + [("b", 7.0)] * 800 + [("c", 1.0), ("c", None), (None, 4.0), (None, 3.0), ("d", None)] + [("e", float(i % 3)) for i in range(500)]


@pytest.mark.parametrize("limit", [5, 100, 10**6])
def test_groups_against_numpy(spark, rows, limit):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r["at"]): r.value for r in qt.percentiles(df, "v", SHARES, by=["g"], limit=limit).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        if own:
            want.update({(g, i): float(np.percentile(own, 100 * s)) for i, s in enumerate(SHARES)})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_whole_table_and_none(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert [r.value for r in qt.percentiles(df, "v", [0.25, 0.5], limit=10).orderBy("at").collect()] == [2500.0, 5000.0]
    assert qt.percentiles(df.where("v < 0"), "v", [0.5]).count() == 0
    assert stats.binned_rate(df.withColumn("y", F.lit(1)).where("v < 0"), "v", "y").count() == 0


def test_no_exact_percentile_in_one_buffer_is_left(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("y"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert not any(" percentile(" in plan(x) or " median(" in plan(x) for x in (stats.binned_rate(df, "v", "y"), stats.describe(df, ["v"])))
