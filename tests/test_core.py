"""Operators on small literal inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.functions.scalars import heat_index_c, parse_period, parse_ts, stable_id, to_number
from twinframe.operators import bitemporal as bt
from twinframe.operators import forecasts as fc
from twinframe.operators import panel as pn
from twinframe.operators import scenarios as sc
from twinframe.operators import stats as st

D = dt.date
KNOWN = [dt.datetime(2024, 1, 1, 12), dt.datetime(2025, 6, 1, 12)]


def batch(spark, values):
    return spark.createDataFrame([("state", g, D(2023, 1, 1), "hri_rate", "epht", v) for g, v in values.items()], "geo_level string, geoid string, valid_date date, variable string, source string, value double")


def empty(spark):
    return spark.createDataFrame([], bt.FACT)


def test_upsert_revises_changed_values_only(spark):
    first = batch(spark, {"04": 48.1, "22": 57.7, "36": 6.3})
    a, n = bt.upsert(empty(spark), first, KNOWN[0])
    assert n == {"received": 3, "collapsed": 0, "written": 3, "revisions": 0, "unchanged": 0}
    again, n = bt.upsert(a, first, KNOWN[1])
    assert again.count() == 0 and n["unchanged"] == 3
    b, n = bt.upsert(a, batch(spark, {"04": 49.4, "22": 57.7, "36": None}), KNOWN[1])
    assert n["written"] == 2 and n["revisions"] == 2
    table = a.unionByName(b)
    assert {r.geoid: r.value for r in bt.as_of(table, known_at=KNOWN[0]).collect()} == {"04": 48.1, "22": 57.7, "36": 6.3}
    assert {r.geoid: (r.value, r.revision) for r in bt.as_of(table).collect()} == {"04": (49.4, 1), "22": (57.7, 0), "36": (None, 1)}
    assert bt.as_of(table, known_at=dt.datetime(2020, 1, 1)).count() == 0


def test_upsert_guards(spark):
    a, _ = bt.upsert(empty(spark), batch(spark, {"04": 1.0}), KNOWN[1])
    with pytest.raises(ValueError, match="before"):
        bt.upsert(a, batch(spark, {"04": 2.0}), KNOWN[0])
    assert bt.upsert(a, batch(spark, {"04": 1.0}), KNOWN[0])[1]["unchanged"] == 1
    with pytest.raises(ValueError, match="future"):
        bt.upsert(a, batch(spark, {"04": 2.0}), dt.datetime(2999, 1, 1))


def test_bulk_history_is_the_replay(spark):
    rows = [("county", "01", D(2023, 1, 1), "v", "s", v, dt.datetime(2023, 2, d), i) for i, (v, d) in enumerate([(1.0, 1), (1.0, 2), (2.0, 3), (3.0, 3), (3.0, 4), (None, 5), (3.0, 6)])]
    reports = spark.createDataFrame(rows, "geo_level string, geoid string, valid_date date, variable string, source string, value double, known_at timestamp, seq long")
    bulk = [(r.value, r.revision) for r in bt.history_from_reports(reports).orderBy("revision").collect()]
    assert bulk == [(1.0, 0), (3.0, 1), (None, 2), (3.0, 3)]
    table = empty(spark)
    for d in range(1, 7):
        at = dt.datetime(2023, 2, d)
        fresh, _ = bt.upsert(table, reports.where(F.col("known_at") == F.lit(at)), at)
        table = spark.createDataFrame(table.unionByName(fresh).collect(), bt.FACT)
    assert [(r.value, r.revision) for r in table.orderBy("revision").collect()] == bulk


def test_state_id_ignores_order(spark):
    x = batch(spark, {"04": 1.0, "22": 2.0, "36": None})
    assert bt.state_id(x).first() == bt.state_id(x.orderBy(F.desc("geoid"))).first() != bt.state_id(batch(spark, {"04": 1.0, "22": 2.5, "36": None})).first()


def test_stable_id_and_parsers(spark):
    import hashlib

    r = spark.range(1).select(stable_id(F.lit("a"), F.lit(None), F.lit(3)).alias("i"), parse_period(F.lit("2018-2022")).alias("p"), parse_period(F.lit(""), F.lit("2019")).alias("q"), parse_ts(F.lit("x")).alias("t"), parse_ts(F.lit("7/15/2023 19:15")).alias("u"), to_number(F.lit(" ")).alias("n")).first()
    assert r.i == hashlib.sha256("a\x1f\x1f3".encode()).hexdigest()[:32]
    assert (r.p, r.q, r.t, r.n) == (D(2018, 1, 1), D(2019, 1, 1), None, None) and r.u == dt.datetime(2023, 7, 15, 19, 15)


@pytest.mark.parametrize(("f", "rh", "want"), [(90, 50, 95), (100, 40, 109), (86, 90, 105), (80, 40, 80)])
def test_heat_index_table(spark, f, rh, want):
    c = spark.range(1).select(heat_index_c(F.lit((f - 32) / 1.8), F.lit(float(rh))).alias("h")).first().h
    assert abs(c - (want - 32) / 1.8) < 0.9


def thermal(spark, hot, start=D(2023, 7, 1)):
    return spark.createDataFrame([("04", start + dt.timedelta(i), None if h is None else float(h)) for i, h in enumerate(hot)], "geoid string, valid_date date, hot double")


def test_streak_and_first_wave(spark):
    out = pn.with_streak(thermal(spark, [1.0, 1.0, 0.0, 1.0, None, 1.0])).orderBy("valid_date").collect()
    assert [r.hot_streak for r in out] == [1, 2, 0, 1, 0, 1]
    gap = thermal(spark, [1.0, 1.0, 1.0]).where(F.col("valid_date") != "2023-07-02")
    assert [r.hot_streak for r in pn.with_streak(gap).orderBy("valid_date").collect()] == [1, 1]
    waves = pn.with_first_wave(pn.with_streak(thermal(spark, [1.0, 0, 0, 1, 1, 1, 0, 1, 1, 0]))).orderBy("valid_date").collect()
    assert [r.first_wave for r in waves] == [0, 0, 0, 1, 1, 1, 0, 0, 0, 0]


def test_weighted_mean_needs_coverage(spark):
    child = spark.createDataFrame([("a", D(2023, 1, 1), "t", 46.0), ("b", D(2023, 1, 1), "t", 48.0)], "geoid string, valid_date date, variable string, value double")
    w = spark.createDataFrame([("a", "04", 800.0), ("b", "04", 150.0), ("c", "04", 50.0)], "geoid string, parent string, population double")
    assert pn.population_weighted(child, w, 0.99).count() == 0
    r = pn.population_weighted(child, w, 0.9).first()
    assert math.isclose(r.coverage, 0.95) and math.isclose(r.value, (46 * 800 + 48 * 150) / 950)


def test_outage_day_is_local(spark):
    t0 = dt.datetime(2023, 7, 15, 19)
    ts = [t0 + dt.timedelta(minutes=15 * i) for i in range(12)] + [dt.datetime(2023, 7, 16, 3)]
    raw = spark.createDataFrame([("04013", t, 50.0, 1000.0) for t in ts], "geoid string, ts_utc timestamp, customers_out double, customers double")
    r = pn.outage_daily(pn.outage_snapshots(raw)).collect()
    assert len(r) == 1 and r[0].day == D(2023, 7, 15) and math.isclose(r[0].max_frac, 0.05) and r[0].max_hours == 3.0 and math.isclose(r[0].customer_hours, 13 * 50 * 0.25)


def test_complete_days(spark):
    b = spark.createDataFrame([(dt.datetime(2023, 7, 1), dt.datetime(2023, 7, 4, 23, 45))], "first_utc timestamp, last_utc timestamp")
    z = spark.createDataFrame([("04", "America/Phoenix"), ("00", "UTC")], "geoid string, tz string")
    assert {r.geoid: (r.first_day.day, r.last_day.day) for r in pn.complete_days(b, z).collect()} == {"04": (1, 3), "00": (1, 4)}


def wide(spark):
    rows = [(g, D(2023, 7, 1) + dt.timedelta(i), b + i % 4, b - 10 + i % 3) for g, b in (("04", 38.0), ("22", 28.0)) for i in range(10)]
    return spark.createDataFrame(rows, "geoid string, valid_date date, tmmx double, tmmn double")


def test_scenarios_compose_and_diff(spark):
    x = wide(spark)
    a, b, c = sc.heatwave(3, delta_c=2.0), sc.blackout(0.25, 18.0, 2), sc.cooling(0.2)
    left, right = ((a | b) | c), (a | (b | c))
    assert left.scenario_id() == right.scenario_id() != (b | a | c).scenario_id()
    key = lambda df: sorted(map(tuple, df.select("geoid", "valid_date", "tmmx", "outage_customers_frac").collect()))
    assert key(left.apply(x)) == key(right.apply(x))
    assert sc.diff(x, sc.baseline().apply(x), ["tmmx"]).count() == 0
    d = sc.diff(x, a.apply(x), ["tmmx", "tmmn"]).collect()
    assert len(d) == 12 and all(math.isclose(r.new - r.base, 2.0) for r in d)
    with pytest.raises(ValueError, match="frac"):
        sc.blackout(1.5, 1.0)


def test_history_blackout_leaves_unknown_units(spark):
    h = spark.createDataFrame([("04", f, 10.0) for f in (0.05, 0.10, 0.40)], "geoid string, outage_customers_frac double, outage_max_hours double")
    out = sc.blackout_from_history(h, 90).apply(wide(spark)).where("outage_customers_frac > 0").collect()
    assert [(r.geoid, round(r.outage_customers_frac, 6)) for r in out] == [("04", 0.34)]


def test_text_requests(spark):
    q = spark.createDataFrame([("Ola de calor de 7 dias en Phoenix con +3 C y apagon 25 % por 18 horas",), ("nada",), (None,)], "q string")
    a, b, c = sc.extract_params(q, "q").collect()
    assert (a.geoids, a.heatwave_days, a.heatwave_delta_c, a.blackout_frac, a.blackout_hours) == (["04"], 7, 3.0, 0.25, 18.0)
    assert (b.geoids, b.heatwave_days, b.blackout_frac) == (["04"], 0, 0.0) and c.heatwave_days == 0


def scored(spark, n=400):
    rng = np.random.RandomState(1)
    y = rng.randint(0, 2, n)
    good, bad = np.round(y + rng.randn(n), 1), np.round(rng.randn(n), 1)
    return y, good, bad, spark.createDataFrame([(int(a), float(b), float(c), int(i % 7)) for i, (a, b, c) in enumerate(zip(y, good, bad, strict=True))], "y int, good double, bad double, grp int")


def test_auc_and_delong_against_numpy(spark):
    y, good, bad, df = scored(spark)
    place = lambda s: ((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
    a, b = place(good), place(bad)
    assert math.isclose(st.auc(df, "good").first().auc, a.mean(), abs_tol=1e-12)
    r = st.delong(df, "good", "bad").first()
    v = (a.mean(1) - b.mean(1)).var(ddof=1) / a.shape[0] + (a.mean(0) - b.mean(0)).var(ddof=1) / a.shape[1]
    assert math.isclose(r["diff"], a.mean() - b.mean(), abs_tol=1e-12) and math.isclose(r.se, math.sqrt(v), rel_tol=1e-9) and st.normal_p(r.z) < 1e-6


def test_holm_friedman_and_bootstrap(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.p_adjusted, 6) for r in st.holm(p).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    m = spark.createDataFrame([(b, k, float(s)) for b in range(5) for k, s in (("x", 3), ("y", 2), ("z", 1))], "block int, model string, score double")
    assert math.isclose(st.friedman(m).first().chi2, 10.0) and math.isclose(st.critical_difference(4, 2), 3.317, abs_tol=1e-3)
    _, _, _, df = scored(spark)
    q = df.withColumn("q", F.lit(0.5))
    r = st.block_bootstrap(q, "q", "y", "grp", 50).first()
    assert r.lo == r.hi == 0.25 and r.replicates == 50


def test_calibration_metrics_and_genuine_pairs(spark):
    p = spark.createDataFrame([(str(i), "state", g, D(2023, 7, 15), "risk", v, v - 1, v + 1, "m", "1", dt.datetime(2023, 7, 14, h)) for i, (g, v, h) in enumerate([("04", 5.0, 7), ("22", 12.0, 7), ("36", 3.0, 23)])], "prediction_id string, geo_level string, geoid string, target_date date, quantity string, value double, value_lower double, value_upper double, model_name string, model_version string, issued_at timestamp")
    o = spark.createDataFrame([("state", g, D(2023, 7, 15), "risk", v, c, 0.0, 10.0, dt.datetime(2023, 7, 14, 12), 0) for g, v, c in (("04", None, True), ("22", None, True), ("36", 3.0, False))], "geo_level string, geoid string, target_date date, quantity string, value double, censored boolean, censor_lo double, censor_hi double, known_at timestamp, revision int")
    found = fc.pairs(p, o)
    assert {r.geoid: r.genuine for r in found.collect()} == {"04": True, "22": True, "36": False}
    m = fc.metrics(fc.keep_latest(found), ("model_name",)).first()
    assert (m.mae, m.censored_hit_rate, m.n_point, m.bias) == (1.0, 0.5, 0, None)


def test_empty_inputs(spark):
    x = wide(spark).limit(0)
    assert pn.local_percentile(x, "tmmx", 90, "2023-01-01", "2023-12-31").count() == 0
    assert pn.with_first_wave(pn.with_streak(x.withColumn("hot", F.lit(1.0)))).count() == 0
    assert bt.as_of(empty(spark)).count() == 0
