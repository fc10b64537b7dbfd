"""Models, explanations, permutation tests, report arrays and stateful streams against brute force."""

import datetime as dt
import hashlib
import json
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinframe.operators import explain as ex
from twinframe.operators import forecasts as fc
from twinframe.operators import models as md
from twinframe.operators import panel as pn
from twinframe.operators import reports as rp
from twinframe.operators import scenarios as sc
from twinframe.operators import stats as st
from twinframe.plans import queries
from twinframe.streaming import jobs


def panel(spark, n=600, seed=3):
    rng = np.random.RandomState(seed)
    a, b = rng.randn(n), rng.randn(n)
    y = (a + 0.5 * rng.randn(n) > 0).astype(int)
    rows = [(i, f"g{i % 5}", dt.date(2021 + i % 3, 6 + i % 4, 1 + i % 28), int(y[i]), float(a[i]), float(b[i]), 2021 + i % 3, i % 2 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, geoid string, valid_date date, y int, a double, b double, year int, hhs_region int")


def brute_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()


def test_folds_training_and_selection(spark):
    x = panel(spark).persist()
    folds = md.outer_folds(x)
    assert [f.name for f in folds] == ["2022", "2023"]
    assert [f.name for f in md.outer_folds(x.where("year < 2023"))] == ["region 1", "region 2"]
    run = md.train(x, md.ladder(["a", "b"], "b")[:2], folds, ["id"])
    oof = run.oof.toPandas()
    assert sorted(oof[oof.model == "logistic"].id) == sorted(r.id for r in x.where("year > 2021").collect())
    got = {(r.fold, r.model): r for r in md.fold_scores(run.oof).collect()}
    for (fold, model), r in got.items():
        part = oof[(oof.fold == fold) & (oof.model == model)]
        assert math.isclose(r.auc, brute_auc(part.y, part.p), abs_tol=1e-12) and math.isclose(r.brier, ((part.p - part.y) ** 2).mean(), abs_tol=1e-12)
    chosen = md.select(run, ["id"])
    assert chosen["best"] == chosen["chosen"] == "logistic" and chosen["not_worse"] == ["logistic"]
    warmed = md.scenario_scores(run, lambda d: x.withColumn("a", F.col("a") + d), [0.0, 1.0], ["id"]).where("model = 'logistic'").groupBy("delta").agg(F.avg("p").alias("p"))
    mean = {r.delta: r.p for r in warmed.collect()}
    assert mean[1.0] > mean[0.0] and math.isclose(mean[0.0], oof[oof.model == "logistic"].p.mean(), abs_tol=1e-9)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_model_fold_scores_as_registered(spark):
    got = {(r.fold, r.model): r.auc for r in queries.model_fold_scores(spark, "/root/testdata/sf0.001").collect()}
    models = ["threshold", "logistic", "forest", "boosted"]
    years = sorted({f for f, _ in got})
    assert len(years) >= 3 and set(got) == {(f, m) for f in years for m in models}


def test_outer_folds_need_no_region_where_years_decide(spark):
    x = panel(spark).drop("hhs_region")
    assert [f.name for f in md.outer_folds(x)] == ["2022", "2023"]
    with pytest.raises(Exception, match="hhs_region"):
        md.outer_folds(x.where("year < 2023"))


@pytest.mark.parametrize("packed", [md.PACKED_GROUPS, 3])
def test_group_folds_are_balanced_and_whole(spark, monkeypatch, packed):
    monkeypatch.setattr(md, "PACKED_GROUPS", packed)
    sizes = {"a": 50, "b": 20, "c": 20, "d": 19, "e": 1, None: 5, "f": 30}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    dealt, k = md.group_folds(df, "g", 3)
    rows = dealt.collect()
    of = {}
    for r in rows:
        of.setdefault(r.g, set()).add(r.fold_)
    load = [sum(sizes[g] for g, f in of.items() if f == {j}) for j in range(k)]
    assert len(rows) == sum(sizes.values()) and k == 3 and all(len(f) == 1 for f in of.values())
    assert max(load) - min(load) <= max(sizes.values()) and min(load) > 0
    assert md.group_folds(df.where("g = 'a'"), "g", 3)[1] == 1


def test_draws_are_seeded_distinct_and_in_their_space():
    space = {"x": [1, 2, 3], "y": (0.01, 1.0)}
    got = md.draws(space, 8)
    assert got == md.draws(space, 8) != md.draws(space, 8, seed=1) and len({tuple(d.items()) for d in got}) == 8
    assert all(d["x"] in space["x"] and 0.01 <= d["y"] <= 1 for d in got)
    assert sorted(d["x"] for d in md.draws({"x": [1, 2, 3]}, 10)) == [1, 2, 3]


def test_search_takes_the_best_draw(spark):
    x = panel(spark)
    spec = md.Spec("logistic", 1, md.ladder(["a", "b"], "a")[1].pipeline, {"regParam": [0.01, 1000.0], "elasticNetParam": [1.0]})
    model, tried = md.search(spec, x, "geoid", folds=2, n=2)
    best = max(tried, key=lambda d: d["auc"])
    assert len(tried) == 2 and best["regParam"] == 0.01 and model.stages[-1].getRegParam() == 0.01 and best["auc"] > 0.7


def test_fold_extremes(spark):
    rows = [("m", "2021", 0.7), ("m", "2022", 0.9), ("m", "2023", 0.7), ("m", "2020", None), ("k", "2021", 0.5)]
    got = {r.model: tuple(r)[1:] for r in md.fold_extremes(spark.createDataFrame(rows, "model string, fold string, auc double")).collect()}
    assert got == {"m": ("2022", 0.9, "2021", 0.7), "k": ("2021", 0.5, "2021", 0.5)}


def test_final_models_fit_the_whole_panel(spark):
    x = panel(spark)
    got = md.final_models(x, md.ladder(["a", "b"], "a")[:2], group="geoid", inner=2, n=2)
    assert set(got) == {"threshold", "logistic"} and md.score(got["logistic"], x).count() == x.count()


def test_threshold_rule_does_not_fall(spark):
    x = panel(spark).withColumn("minus", -F.col("a"))
    p = md.score(md.fit(md.threshold_rule("minus"), x), x)
    lo, hi = p.agg(F.min("p"), F.max("p")).first()
    assert math.isclose(lo, hi, abs_tol=1e-6) and math.isclose(lo, x.agg(F.avg("y")).first()[0], abs_tol=1e-3)
    assert -0.5 < md.alert_cut(x, "a") < 0.5


def test_search_temporal_fold_save_and_deploy(spark, tmp_path):
    x = panel(spark)
    fold = md.temporal_fold(x)
    assert x.where(fold.train).agg(F.max("valid_date")).first()[0] < dt.date(2023, 8, 1) <= dt.date(2023, 8, 8) <= x.where(fold.test).agg(F.min("valid_date")).first()[0]
    spec = md.ladder(["a", "b"], "a")[1]
    model = md.fit(spec, x, group="geoid", folds=2)
    md.save(model, {"version": md.version(spec, ["a", "b"], "s")}, str(tmp_path / "m"), spark)
    again, meta = md.load(str(tmp_path / "m"), spark)
    assert md.score(again, x).agg(F.sum("p")).first() == md.score(model, x).agg(F.sum("p")).first() and len(meta["version"]) == 12
    rows = md.score(model, x, "value").select(F.lit("county").alias("geo_level"), F.concat("geoid", F.col("id").cast("string")).alias("geoid"), F.col("valid_date").alias("target_date"), "value")
    fixed = {"quantity": "risk", "model_name": "logistic", "model_version": meta["version"], "issued_at": dt.datetime(2024, 1, 1), "seed": 42}
    log = md.deploy(rows, fc.with_ids(rows.withColumns({k: F.lit(v) for k, v in fixed.items()})).limit(0), **fixed)
    assert log.count() == 600 and md.deploy(rows, log, **fixed).count() == 0


def test_attributions_add_up(spark):
    x = panel(spark, 60)
    model = md.fit(md.ladder(["a", "b"], "a")[1], x)
    parts = ex.linear(model, x, x, "id").groupBy("id").agg(F.sum("value").alias("v"))
    odds = md.score(model, x).select("id", F.ln(F.col("p") / (1 - F.col("p"))).alias("o"))
    gap = parts.join(odds, "id").select((F.col("o") - F.col("v")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert math.isclose(gap[0], gap[1], abs_tol=1e-9)
    assert ex.odds_ratios(model)[0][0] == "a"
    add = lambda df: df.withColumn("p", 2 * F.col("a") - F.col("b"))
    one = x.where("id = 0").select("a", "b")
    got = {(r.id, r.feature): r.value for r in ex.permutation_shapley(add, x, one, ["a", "b"], "id", n=3).collect()}
    base = one.first()
    for r in x.collect():
        assert math.isclose(got[r.id, "a"], 2 * (r.a - base.a), abs_tol=1e-9) and math.isclose(got[r.id, "b"], base.b - r.b, abs_tol=1e-9)
    top = ex.top_contributions(ex.linear(model, x, x, "id"), "id", 1)
    assert top.count() == 60 and all(len(r.top) == 1 for r in top.collect())
    drop = {r.feature: r.auc_drop for r in ex.permutation_importance(lambda df: md.score(model, df), x, ["a", "b"], "id", 2).collect()}
    assert drop["a"] > 0.2 > abs(drop["b"])
    for blocks in (1, 4):
        moved = ex.permuted(x, ["a", "b"], "id", 2, 1, blocks)
        for feature, other in (("a", "b"), ("b", "a")):
            for rep in (0, 1):
                part = {r.id: r for r in moved.where((F.col("feature") == feature) & (F.col("rep") == rep)).collect()}
                assert sorted(r[feature] for r in part.values()) == sorted(r[feature] for r in x.collect())
                assert all(part[r.id][other] == r[other] for r in x.collect()) and sum(part[r.id][feature] != r[feature] for r in x.collect()) >= 50
        assert moved.where("feature = ''").select(*x.columns).exceptAll(x).count() == 0


def test_permutation_importance_scans_once(spark, tmp_path):
    x = panel(spark, 60)
    x.write.parquet(str(tmp_path / "x"))
    plan = ex.permuted(spark.read.parquet(str(tmp_path / "x")), [c for c in "ab" for _ in range(7)], "id", 5, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_circular_permutation_and_interval(spark):
    x = panel(spark, 120).withColumn("s", F.round("b", 1))
    rows = sorted(x.collect(), key=lambda r: r.id)
    groups = {}
    for r in rows:
        groups.setdefault(r.geoid, []).append(r)
    y = [r.y for g in groups.values() for r in g]
    seen, hits = brute_auc(y, [r.s for g in groups.values() for r in g]), 0
    for rep in range(1, 31):
        turned = []
        for name, g in groups.items():
            off = 1 + int(hashlib.md5(f"7:{rep}:{name}".encode()).hexdigest()[:8], 16) % (len(g) - 1)
            turned += list(np.roll([r.s for r in g], off))
        hits += brute_auc(y, turned) >= seen - 1e-12
    r = st.circular_permutation(x, "s", "geoid", ["id"], n=30, seed=7).first()
    assert math.isclose(r.auc, seen, abs_tol=1e-12) and math.isclose(r.p_value, (hits + 1) / 31, abs_tol=1e-12) and r.replicates == 30
    assert st.circular_permutation(x.limit(0), "s", "geoid", ["id"], n=3).first().auc is None
    pos, neg = (np.array([r.s for r in rows if r.y == k]) for k in (1, 0))
    won = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    se = math.sqrt(won.mean(1).var(ddof=1) / len(pos) + won.mean(0).var(ddof=1) / len(neg))
    r = st.delong_ci(x, "s").first()
    assert math.isclose(r.auc, won.mean(), abs_tol=1e-12) and math.isclose(r.se, se, rel_tol=1e-9)


def test_calibration_line(spark):
    rng = np.random.RandomState(0)
    o = rng.randn(4000)
    y = (rng.rand(4000) < 1 / (1 + np.exp(-o))).astype(int)
    x = spark.createDataFrame([(int(a), float(1 / (1 + np.exp(-b)))) for a, b in zip(y, o, strict=True)], "y int, p double")
    r = st.calibration_line(x, "p")
    assert abs(r["slope"] - 1) < 0.15 and abs(r["intercept"]) < 0.15


def test_risk_arrays_and_payload(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    d = [dt.date(2023, 7, k) for k in (1, 2, 4)]
    p = spark.createDataFrame([("1", "04", d[0], None, 0.5, t), ("2", "04", d[0], None, 0.61234, t + dt.timedelta(1)), ("3", "04", d[2], None, 0.1, t), ("4", "04", d[0], "w2", 0.9, t), ("5", "22", d[1], None, 0.3, t)], "prediction_id string, geoid string, target_date date, scenario_id string, value double, issued_at timestamp")
    o = spark.createDataFrame([("04", d[0], 1.0), ("22", d[2], 1.0)], "geoid string, target_date date, value double")
    a = rp.risk_arrays(p, o)
    assert {(r.geoid, r.series): r["values"] for r in a.collect()} == {("04", "p"): [0.6123, None, 0.1], ("04", "w2"): [0.9, None, None], ("04", "y"): [1.0, None, None], ("22", "p"): [None, 0.3, None]}
    rp.payload(a).coalesce(1).write.json(str(tmp_path / "j"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert {g["geoid"] for g in got} == {"04", "22"} and set(next(g for g in got if g["geoid"] == "04")["series"]) == {"p", "w2", "y"}
    r = rp.axes(p, "target_date").first()
    assert r.days == ["2023-07-01", "2023-07-02", "2023-07-04"] and r.years == [2023]


def test_streamed_streaks_equal_batch(spark, tmp_path):
    rng = np.random.RandomState(5)
    rows = [(g, dt.date(2023, 6, 1) + dt.timedelta(i), None if rng.rand() < 0.1 else float(rng.rand() < 0.7)) for g in ("a", "b") for i in range(30) if rng.rand() < 0.9]
    df = spark.createDataFrame(rows, "geoid string, valid_date date, hot double")
    for k in range(3):  # a file is a micro-batch
        df.where(F.floor((F.dayofmonth("valid_date") - 1) / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.geoid, r.valid_date): r.hot_streak for r in spark.table("streaks").collect()}
    assert got == {(r.geoid, r.valid_date): r.hot_streak for r in pn.with_streak(df).collect()}


def test_horizon_of_streamed_pairs(spark):
    key = "geo_level string, geoid string, target_date date, quantity string, value double, "
    of = ("county", "04", dt.date(2023, 9, 1), "risk", 0.5)
    p = spark.createDataFrame([(*of, dt.datetime(2023, 6, 1))], key + "issued_at timestamp")
    o = spark.createDataFrame([(*of, dt.datetime(2023, 7, 1)), (*of, dt.datetime(2023, 9, 3))], key + "known_at timestamp")  # after 30 and 94 days
    assert jobs.forecast_pairs(p, o).count() == 1 and jobs.forecast_pairs(p, o, horizon="100 days").count() == 2


def test_ordered_streaks_take_days_out_of_order(spark, tmp_path):
    rng = np.random.RandomState(9)
    rows = [(g, dt.date(2023, 6, 1) + dt.timedelta(i), None if rng.rand() < 0.1 else float(rng.rand() < 0.8)) for g in ("a", "b") for i in range(60) if rng.rand() < 0.9]
    end = ("~", dt.date(2100, 1, 1), 1.0)  # lets the watermark pass the last days
    parts = [[], [], [], [end]]
    for r in rows:  # every third day comes up to four days late
        parts[min(2, ((r[1] - dt.date(2023, 6, 1)).days + (4 if r[1].day % 3 == 0 else 0)) // 20)].append(r)
    schema = "geoid string, valid_date date, hot double"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.geoid, r.valid_date): r.hot_streak for r in queries.drained(spark, jobs.ordered_streaks(stream), jobs.ROCKSDB).collect()}
    assert got == {(r.geoid, r.valid_date): r.hot_streak for r in pn.with_streak(spark.createDataFrame(rows, schema)).collect()}


PAIR = "model_name string, model_version string, quantity string, value double, obs double, censored boolean, censor_lo double, censor_hi double, value_lower double, value_upper double"


def test_drift_from_moments(spark, tmp_path):
    make = lambda m, bias, n: spark.createDataFrame([(m, "1", "risk", 10.0 + bias + (i % 3) / 10, 10.0, False, None, None, None, None) for i in range(n)], PAIR)
    write = jobs.drift_moments(str(tmp_path / "moments"), str(tmp_path / "runs"))
    for k, df in enumerate([make("m", 5.0, 6), make("m", 5.0, 6), make("other", 0.0, 3), make("m", 5.0, 1)]):
        write(df, k)
    write(make("m", 5.0, 1), 3)  # a replay
    runs = {(r.batch, r.model_name): r for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert set(runs) == {(0, "m"), (1, "m"), (2, "other"), (3, "m")}
    assert [(runs[k, "m"].n_point, runs[k, "m"].drift) for k in (0, 1, 3)] == [(6, False), (12, True), (13, True)]
    assert sorted(p.name for p in (tmp_path / "moments").glob("batch=*")) == ["batch=2", "batch=3"]


def test_moments_merge_into_the_metrics(spark):
    rng = np.random.RandomState(2)
    rows = []
    for i in range(300):
        obs = None if rng.rand() < 0.05 else float(1e6 + rng.randn())  # large means, small spread
        cens = bool(rng.rand() < 0.2)
        rows.append(("m", str(i % 4), "q", None if rng.rand() < 0.05 else float(1e6 + rng.randn()), obs, cens, 1e6 - 1 if cens else None, 1e6 if cens else None, *((1e6 - 1, 1e6 + 1) if rng.rand() < 0.7 else (None, 1e6))))
    rows += [("one", "0", "q", 1.0, 2.0, False, None, None, None, None), ("none", "0", "q", None, None, False, None, None, None, None)]
    df = spark.createDataFrame(rows, PAIR).withColumn("part", F.pmod(F.xxhash64(*PAIR.replace(" string", "").replace(" double", "").replace(" boolean", "").split(", ")), F.lit(3)))
    by = ("model_name", "model_version")
    parts = [fc.moments(df.where(F.col("part") == k), by) for k in range(3)]
    merged = fc.metrics_of(fc.merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]), by), by)
    got, want = ({r[:2]: r for r in map(tuple, x.collect())} for x in (merged, fc.metrics(df, by)))
    assert got.keys() == want.keys() and merged.columns == fc.metrics(df, by).columns
    for k in want:
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)) for a, b in zip(got[k][2:], want[k][2:], strict=True)), (k, got[k], want[k])


def brute_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    return sum(((s == t) & (y == 1)).sum() / y.sum() * y[s >= t].mean() for t in np.unique(s))


def test_ranked_metrics_over_resampled_blocks(spark):
    rng = np.random.RandomState(5)
    rows = [(f"b{i % 12}", int(y := rng.rand() < 0.4), float(np.round(np.clip(0.5 * y + 0.5 * rng.rand(), 0, 1), 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "block string, y int, p double")
    whole = {"auc": brute_auc([r[1] for r in rows], [r[2] for r in rows]), "average_precision": brute_ap([r[1] for r in rows], [r[2] for r in rows]), "brier": np.mean([(r[2] - r[1]) ** 2 for r in rows])}
    for metric, v in whole.items():
        r = st.block_bootstrap(df, "p", "y", "block", n=60, metric=metric).first()
        assert r.lo < v < r.hi and r.hi - r.lo < 0.4 and r.replicates == 60
    one = st.block_bootstrap(df.where("block = 'b1'"), "p", "y", "block", n=30, metric="auc").first()
    want = brute_auc(*zip(*[r[1:] for r in rows if r[0] == "b1"], strict=True))
    assert one.lo == one.hi and abs(one.lo - want) < 1e-12 and one.replicates < 30  # any weight of a single block is that block


def test_bootstrap_replicates_against_brute_force(spark, monkeypatch):
    """Every replicate equals its metric over rows weighed by their block's draws, in one range of scores or in many."""
    from twinframe.operators import resampling as rs

    rng = np.random.RandomState(7)
    rows = [(f"b{rng.randint(9)}" if i % 11 else None, int(y := rng.rand() < 0.4), None if i % 17 == 0 else float(np.round(np.clip(0.5 * y + 0.6 * rng.rand(), 0, 1), 1))) for i in range(500)]
    df = spark.createDataFrame(rows, "block string, y int, p double")
    keys = {r.block: r.k for r in df.select("block", F.xxhash64("block").alias("k")).distinct().collect()}
    used = [r for r in rows if r[2] is not None]
    y, p = np.array([r[1] for r in used]), np.array([r[2] for r in used])
    n = 40
    draws = {b: rs.replicate_weights(k, n, 42) for b, k in keys.items()}
    w = np.array([draws[r[0]] for r in used])

    def brute(metric, w):
        pos, neg = w * y, w * (1 - y)
        if metric == "brier":
            return (w * (p - y) ** 2).sum() / w.sum()
        if metric == "auc":
            won = sum(pos[i] * (neg[p < p[i]].sum() + neg[p == p[i]].sum() / 2) for i in range(len(y)))
            return won / (pos.sum() * neg.sum())
        return sum(pos[i] * pos[p >= p[i]].sum() / w[p >= p[i]].sum() for i in range(len(y)) if pos[i]) / pos.sum()

    for rows_a_range in (10**6, 7):
        monkeypatch.setattr(rs, "RANGE_ROWS", rows_a_range)
        for metric in ("brier", "auc", "average_precision"):
            got = rs.replicates(df, "p", "y", "block", n, 42, metric)
            assert np.allclose(got, [brute(metric, w[:, k]) for k in range(n)], atol=1e-12), metric
    r = rs.block_bootstrap(df, "p", "y", "block", n, metric="auc").first()
    want = [brute("auc", w[:, k]) for k in range(n)]
    assert math.isclose(r.lo, np.quantile(want, 0.025)) and math.isclose(r.hi, np.quantile(want, 0.975)) and r.replicates == n
    assert rs.block_bootstrap(df.where("p > 2"), "p", "y", "block", 5, metric="auc").first().replicates == 0
    with pytest.raises(ValueError, match="metric"):
        rs.block_bootstrap(df, "p", "y", "block", 5, metric="f1")


def test_a_users_metric(spark):
    """A metric given as a vector of sums equals its built-in twin by fold, and can be resampled."""
    from twinframe.operators import resampling as rs

    x = panel(spark, 300).withColumn("p", F.least(F.greatest(F.col("a") / 4 + 0.5, F.lit(0.0)), F.lit(1.0))).withColumn("p", F.when(F.col("id") % 9 > 0, F.col("p"))).withColumn("year", F.when(F.col("id") % 7 > 0, F.col("year")))
    built = {(r.year, r.geoid): r.brier for r in st.brier(x.where("p is not null"), "p", by=("year", "geoid")).collect()}
    got = {(r.year, r.geoid): r.value for r in rs.metric_by(x.repartition(5), "p", "y", rs.BRIER, ["year", "geoid"]).collect()}
    assert got.keys() == built.keys() and all(math.isclose(got[k], built[k], abs_tol=1e-12) for k in built)
    hits = rs.Metric(lambda y, p: np.array([((p > 0.5) & (y == 1)).sum(), (p > 0.5).sum()]), lambda s: s[0] / s[1] if s[1] else float("nan"))
    whole = x.where("p > 0.5").agg(F.avg("y")).first()[0]
    assert math.isclose(rs.metric_by(x, "p", "y", hits).first().value, whole)
    assert rs.metric_by(x.where("p < 0.2"), "p", "y", hits).first().value is None and rs.metric_by(x.where("p is null"), "p", "y", hits).count() == 0
    r = rs.block_bootstrap(x, "p", "y", "geoid", 60, metric=hits).first()
    assert r.lo < whole < r.hi and 55 <= r.replicates <= 60  # a replicate may leave all blocks out


def test_brier_under_circular_shifts(spark):
    rng = np.random.RandomState(6)
    rows = [(f"g{i % 4}", i // 4, int(y := rng.rand() < 0.3), float(0.6 * y + 0.4 * rng.rand())) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, y int, p double")
    r = st.circular_permutation(df, "p", "g", ["i"], n=40, metric="brier").first()
    want = np.mean([(x[3] - x[2]) ** 2 for x in rows])
    hits = 0
    for rep in range(1, 41):
        total = 0.0
        for g in range(4):
            own = [x for x in rows if x[0] == f"g{g}"]
            off = 1 + int(hashlib.md5(f"0:{rep}:g{g}".encode()).hexdigest()[:8], 16) % (len(own) - 1)
            total += sum((own[(j - off) % len(own)][3] - x[2]) ** 2 for j, x in enumerate(own))
        hits += total / len(rows) <= want + 1e-12
    assert abs(r.brier - want) < 1e-9 and abs(r.p_value - (hits + 1) / 41) < 1e-12


def test_balanced_rungs(spark):
    df = panel(spark).where("y = 1 OR id % 5 = 0")
    w = {r.y: r.w for r in md.balance(df).groupBy("y").agg(F.sum("weight_").alias("w")).collect()}
    assert abs(w[0] - w[1]) < 1e-6
    plain, even = (md.score(md.fit(md.ladder(["a", "b"], "a", balanced)[1], df), df).agg(F.avg("p").alias("m")).first().m for balanced in (False, True))
    assert even < plain and md.balance(df.where("y = 1")).where("weight_ <> 1").count() == 0


def test_spearman_pairs(spark):
    df = panel(spark).withColumn("c", F.when(F.col("id") % 7 > 0, F.round("a", 1)))
    got = {(r.a, r.b): r.rho for r in st.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - st.spearman(df, "a", "b").first().rho) < 1e-12 and list(got)[0] == ("a", "c") and got["a", "c"] > 0.9


def test_lineage(spark):
    base = sc.State(spark.createDataFrame([("04", dt.date(2023, 7, i), 30.0, 20.0) for i in range(1, 5)], "geoid string, valid_date date, tmmx double, tmmn double"), "2024-01-01")
    both = sc.heatwave(2, delta_c=3.0) | sc.blackout(0.2, 4)
    s = base.under(both)
    assert base.is_baseline and base.under(sc.baseline()).is_baseline and not s.is_baseline and len(s.lineage) == 2 and s.lineage[0].startswith("heatwave {") and s.meta["scenario_id"] == both.scenario_id()
    assert s.df.where("tmmx = 33 AND outage_customers_frac = 0.2").count() == 1 and s.derive(s.df, "note", a=1).meta["a"] == 1 and s.known_at == "2024-01-01"


def test_calibration_runs(spark):
    day, at = dt.date(2023, 7, 1), lambda d, h=0: dt.datetime(2023, 7, d, h)
    p = spark.createDataFrame([(f"p{i}", "state", f"{i:02d}", day, "q", 10.0 + i % 3, 0.0, 99.0, "m", "v", at(1)) for i in range(20)] + [("late", "state", "00", day, "q", 0.0, 0.0, 99.0, "m", "v", at(20))], "prediction_id string, geo_level string, geoid string, target_date date, quantity string, value double, value_lower double, value_upper double, model_name string, model_version string, issued_at timestamp")
    o = spark.createDataFrame([("state", f"{i:02d}", day, "q", 5.0, False, None, None, at(10), 0) for i in range(20)], "geo_level string, geoid string, target_date date, quantity string, value double, censored boolean, censor_lo double, censor_hi double, known_at timestamp, revision int")
    one = fc.calibration_run(p, o, None, "2023-08-01")
    r = one.first()
    assert (r.n_pairs, r.n_postdiction, r.n_censored) == (20, 1, 0) and r.drift_bias and not r.drift_mae and r.reference_mae is None and json.loads(r.metrics_json)["mae"] == r.mae
    worse = fc.calibration_run(p.withColumn("value", F.col("value") + 20), o, one, "2023-08-02").first()
    assert worse.drift_mae and worse.reference_mae == r.mae and worse.run_id != r.run_id
    assert fc.calibration_history(one, "m").count() == 1 and fc.calibration_run(p, o, None, "2023-08-01", target_from="2024-01-01").count() == 0


def test_deployment_of_a_run(spark):
    """The chosen model's scores with folds, top attributions and scenarios, each with an id of its own."""
    x = panel(spark)
    folds = md.outer_folds(x)
    run = md.train(x, md.ladder(["a", "b"], "b")[:2], folds, ["id", "geoid", "valid_date"])
    own = x.unpivot(["id"], ["a", "b"], "feature", "value")
    rows = md.deployed_rows(run, "logistic", lambda d: x.withColumn("a", F.col("a") + d), [0.0, 1.0], "risk", "2024-02-01", "2024-01-01", "v1", own, k=1).collect()
    tested = run.oof.where("model = 'logistic'").count()
    base, warm = [r for r in rows if r.scenario_id is None], [r for r in rows if r.scenario_id is not None]
    assert len(base) == len(warm) == tested and all(r.model_name == "logistic" and r.quantity == "risk" for r in rows)
    extras = json.loads(base[0].extras_json)
    assert extras["fold"] in {f.name for f in folds} and len(json.loads(extras["top"])) == 1 and json.loads(warm[0].extras_json)["delta"] == "1.0"
    assert sum(r.value for r in warm) > sum(r.value for r in base)


def test_panel_asks_for_its_coverage(spark):
    x = spark.createDataFrame([("04", dt.date(2023, 6, 1), 30.0, 20.0, 40.0)], "geoid string, valid_date date, tmax double, tmin double, rh_min double")
    with pytest.raises(ValueError, match="pop_coverage"):
        pn.build_panel(x, x.select("geoid", "valid_date", F.lit(1.0).alias("rate")), x.select("geoid", F.lit(1).alias("hhs_region")), "2023-01-01", "2023-12-31")


def test_replicates_are_held_some_rows_at_a_time(monkeypatch):
    """No more levels at once than rows of a chunk, and one level over several chunks is one."""
    from twinframe.operators import resampling as rs

    monkeypatch.setattr(rs, "CHUNK", 8)
    r = np.random.default_rng(3)
    p = np.where(r.random(300) < 0.5, 0.5, r.random(300))
    rows = pa.table({"key": r.integers(0, 40, 300), "p": p, "pos": r.integers(0, 3, 300).astype(float), "neg": r.integers(0, 3, 300).astype(float)})
    parts = list(rs._ranked(rows, 5, 42))
    assert all(len(a) <= 8 and len(b) <= 8 for a, b in parts)
    pos, neg = (np.concatenate(x) for x in zip(*parts, strict=True))
    weights = np.stack([rs.replicate_weights(k, 5, 42) for k in rows["key"].to_pylist()])
    for have, c in ((pos, "pos"), (neg, "neg")):
        each = weights * rows[c].to_numpy()[:, None]
        assert np.allclose(have, [each[p == v].sum(axis=0) for v in sorted(set(p), reverse=True)])


def test_models_score_in_a_session_with_tags(spark):
    """A fitted model holds nothing of its session, which can't be sent to tasks once it has had a tag."""
    own = spark.newSession()
    own.addTag("used")
    x = own.createDataFrame(panel(spark).toPandas())
    specs = md.ladder(["a", "b"], "a", trees=2, rounds=2)
    assert all(md.score(md.fit(s, x), x).where("p between 0 and 1").count() == 600 for s in specs)
    assert all(md.score(md.search(s, x, "geoid", folds=2, n=2)[0], x).count() == 600 for s in specs[1:3])
    assert {r.feature for r in ex.permutation_importance(lambda df: md.score(md.fit(specs[1], x), df), x, ["a", "b"], "id", 2).collect()} == {"a", "b"}


def test_permutation_deals_rows_once(spark, tmp_path):
    """However many copies, rows are shuffled once and no window sorts each copy."""
    x = panel(spark, 60)
    x.write.parquet(str(tmp_path / "x"))
    plan = ex.permuted(spark.read.parquet(str(tmp_path / "x")), ["a", "b"], "id", 5, 0, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_auc_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows, groups, ties, NaN and null, against all pairs; a common score is one row of a batch."""
    monkeypatch.setattr(st, "RANGE_ROWS", 7)
    r = np.random.RandomState(5)
    rows = [(["u", "v", None][i % 3], int(r.randint(2)), float(r.randint(20)) if i % 4 else 3.0) for i in range(300)]
    rows += [("u", 1, float("nan")), ("u", 0, float("nan")), ("u", 1, None), ("one", 1, 0.5), ("w", None, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {x.g: x for x in st.auc(df, "s", by=("g",)).collect()}
    for g in ("u", "v", None):
        own = [(y, 99.0 if s != s else s) for h, y, s in rows if h == g and s is not None]
        y, s = zip(*own, strict=True)
        assert math.isclose(got[g].auc, brute_auc(y, s), abs_tol=1e-12) and (got[g].n_pos, got[g].n_neg) == (sum(y), len(y) - sum(y))
    assert got["one"].auc is None and got["w"].auc is None and set(got) == {"u", "v", None, "one", "w"}
    whole = [(y, s) for _, y, s in rows[:300]]
    assert math.isclose(st.auc(df.where("s < 50"), "s").first().auc, brute_auc(*zip(*[w for w in whole + [(1, 0.5)]], strict=True)), abs_tol=1e-12)
    assert tuple(st.auc(df.limit(0), "s").first()) == (None, None, None) and st.auc(df, "s").schema["n_pos"].dataType.simpleString() == "bigint"


def test_rungs_of_a_fold_share_their_dealing(spark, monkeypatch):
    """Inner folds are dealt and written once a fold, however many rungs search over them."""
    calls, real = [], md.group_folds
    monkeypatch.setattr(md, "group_folds", lambda *a: calls.append(1) or real(*a))
    x = panel(spark)
    run = md.train(x, md.ladder(["a", "b"], "b", trees=2, rounds=2)[1:3], md.outer_folds(x), ["id"], group="geoid", inner=2, n=1)
    assert len(calls) == 2 and set(run.fitted) == {(f, m) for f in ("2022", "2023") for m in ("logistic", "forest")}


def test_fold_scores_rank_rows_once(spark):
    """AUC and average precision come from one ranking: the scores are grouped by value in a single pass."""
    x = panel(spark, 60)
    oof = x.select("id", "y", F.lit("f").alias("fold"), F.lit("m").alias("model"), (F.col("a") / 10 + 0.5).alias("p"))
    seen, real = [], st.levels
    st.levels = lambda *a, **k: seen.append(1) or real(*a, **k)
    try:
        r = md.fold_scores(oof).first()
    finally:
        st.levels = real
    rows = oof.toPandas()
    assert len(seen) == 1 and math.isclose(r.auc, brute_auc(rows.y, rows.p), abs_tol=1e-12) and (r.n_pos, r.n_neg) == (rows.y.sum(), 60 - rows.y.sum())
    assert "MapInArrow" not in md.fold_scores(oof)._jdf.queryExecution().executedPlan().toString()
