"""The stated rules of forecasts, scenarios, sources, exposure and statistics, each on rows small enough to work out by hand."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from twinframe.operators import bitemporal as bt
from twinframe.operators import explain as ex
from twinframe.operators import forecasts as fc
from twinframe.operators import models as md
from twinframe.operators import panel as pn
from twinframe.operators import reports as rp
from twinframe.operators import scenarios as sc
from twinframe.operators import stats as st
from twinframe.sources import files as fs
from twinframe.streaming import jobs

D, TS = dt.date, dt.datetime
PRED = "prediction_id string, geo_level string, geoid string, target_date date, quantity string, value double, value_lower double, value_upper double, model_name string, model_version string, issued_at timestamp, scenario_id string"
OBS = "geo_level string, geoid string, target_date date, quantity string, value double, censored boolean, censor_lo double, censor_hi double, known_at timestamp, revision int"
FACTS = "geo_level string, geoid string, valid_date date, variable string, source string, value double, known_at timestamp, revision int"


def prediction(i, value, scenario=None, version="1", hour=7):
    return (i, "state", "04", D(2023, 7, 15), "risk", value, value - 1, value + 1, "m", version, TS(2023, 7, 14, hour), scenario)


def observation(value, censored=False, revision=0, known=TS(2024, 3, 1)):
    return ("state", "04", D(2023, 7, 15), "risk", value, censored, 0.0, 10.0, known, revision)


def test_counterfactuals_are_no_forecasts(spark):
    p = spark.createDataFrame([prediction("a", 10.0), prediction("b", 99.0, "warm", hour=9)], PRED)
    o = spark.createDataFrame([observation(10.0)], OBS)
    run = fc.calibration_run(p, o, None, "2024-04-01", known_at="2024-04-01").collect()
    assert [(r.mae, r.n_pairs, r.n_postdiction) for r in run] == [(0.0, 1, 0)]
    assert [r.prediction_id for r in fc.get(p, scenario_id="warm").collect()] == ["b"] and [r.prediction_id for r in fc.get(p, baseline_only=True, quantity="risk").collect()] == ["a"]


def test_each_version_keeps_its_latest_forecast(spark):
    p = spark.createDataFrame([prediction("a", 10.0), prediction("b", 11.0, hour=8), prediction("c", 12.0, version="2")], PRED)
    found = fc.pairs(p, spark.createDataFrame([observation(10.0)], OBS))
    assert sorted(r.prediction_id for r in fc.keep_latest(found).collect()) == ["b", "c"]


def test_log_keeps_the_last_of_repeated_rows(spark):
    log = spark.createDataFrame([("x", 1, 0.0)], "prediction_id string, seq int, value double")
    rows = spark.createDataFrame([("x", 2, 1.0), ("y", 5, 1.0), ("y", 7, 0.5), ("y", 6, 3.0)], "prediction_id string, seq int, value double")
    assert [tuple(r) for r in fc.append_new(log, rows, "prediction_id", ("seq",)).collect()] == [("y", 7, 0.5)]


def test_observations_collapse_and_revise(spark):
    stored = spark.createDataFrame([observation(5.0)], OBS)
    batch = lambda *rows: spark.createDataFrame([(*r[:9], i) for i, r in enumerate(rows)], OBS.replace("revision int", "seq int"))
    new = lambda *rows: [(r.value, r.censored, r.revision) for r in fc.new_observations(stored, batch(*rows)).collect()]
    assert new(observation(7.0), observation(6.0)) == [(6.0, False, 1)]
    assert new(observation(7.0), observation(5.0)) == [] and new(observation(5.0, True)) == [(5.0, True, 1)]
    assert [r.revision for r in fc.new_observations(stored.limit(0), batch(observation(7.0), observation(6.0))).collect()] == [0]
    later = stored.unionByName(spark.createDataFrame([observation(8.0, revision=1, known=TS(2025, 1, 1))], OBS))
    assert [(r.value, r.first_known_at) for r in fc.latest_observations(later, "2024-06-01", "risk").collect()] == [(5.0, TS(2024, 3, 1))]
    assert [(r.value, r.first_known_at) for r in fc.latest_observations(later).collect()] == [(8.0, TS(2024, 3, 1))] and fc.latest_observations(later, quantity="other").count() == 0


def test_audit_and_seal(spark):
    log = spark.createDataFrame([("a", '{"k": "v"}'), ("b", None)], "prediction_id string, extras_json string")
    assert fc.audit(log, "a").first().extras == {"k": "v"} and fc.audit(log, "b").first().extras is None
    outcome = spark.createDataFrame([("04", 1.0), ("22", 2.0)], "geoid string, value double")
    known = spark.createDataFrame([("04", TS(2024, 1, 1))], "geoid string, first_known_at timestamp")
    assert fc.seal(outcome.where("geoid = '04'"), known, ["geoid"]).first().first_known_at == TS(2024, 1, 1)
    with pytest.raises(ValueError, match="first known"):
        fc.seal(outcome, known, ["geoid"])


def days_of(spark, columns="tmmx double, tmmn double"):
    n = len(columns.split(","))
    return spark.createDataFrame([(g, D(2023, 7, 1 + i), *[base + i - 10 * k for k in range(n)]) for g, base in (("04", 38.0), ("22", 28.0)) for i in range(10)], f"geoid string, valid_date date, {columns}")


def test_heat_waves_are_marked_by_their_days(spark):
    x = days_of(spark)
    wave = sc.heatwave(3, delta_c=2.0, early=True).apply(x).orderBy("geoid", "valid_date").collect()
    assert [r.scn_heatwave_days for r in wave[:10]] == [0.0] * 7 + [3.0] * 3 and {r.scn_early_season for r in wave} == {1.0}
    old = {(r.geoid, r.valid_date): r for r in x.collect()}
    assert all((r.tmmx - old[r.geoid, r.valid_date].tmmx, r.tmmn - old[r.geoid, r.valid_date].tmmn) == ((2.0, 2.0) if r.scn_heatwave_days else (0.0, 0.0)) for r in wave)
    own = sc.heatwave(3, local_pct=100, delta_tmin_c=1.5).apply(x).where("scn_heatwave_days > 0").collect()
    assert {r.tmmx for r in own} == {47.0, 37.0} and all(r.tmmn - old[r.geoid, r.valid_date].tmmn == 1.5 for r in own)
    alone = sc.heatwave(2, delta_c=1.0).apply(days_of(spark, "tmmx double"))
    assert alone.columns == ["geoid", "valid_date", "tmmx", "scn_heatwave_days", "scn_early_season"] and alone.where("scn_heatwave_days = 2").count() == 4
    for bad in ({"days": 0, "delta_c": 1.0}, {"days": 2}, {"days": 2, "delta_c": 1.0, "local_pct": 90}):
        with pytest.raises(ValueError):
            sc.heatwave(**bad)


def test_scenario_ids_follow_from_all_parameters(spark):
    history = lambda f: spark.createDataFrame([("04", f, 10.0)], "geoid string, outage_customers_frac double, outage_max_hours double")
    all_ = [sc.heatwave(3, delta_c=2.0), sc.heatwave(3, delta_c=2.0, var="tmax"), sc.heatwave(3, delta_c=2.0, var_min="tmin"), sc.heatwave(3, delta_c=2.0, early=True), sc.cooling(0.2), sc.cooling(0.2, "tmax"), sc.blackout_from_history(history(0.1), 90), sc.blackout_from_history(history(0.2), 90), sc.blackout_from_history(history(0.2), 90, history_id="h1")]
    assert len({s.scenario_id() for s in all_}) == len(all_)
    assert sc.blackout_from_history(history(0.1), 90).scenario_id() == sc.blackout_from_history(history(0.1), 90).scenario_id()


def test_many_scenarios_in_one_table(spark):
    x = days_of(spark)
    both = [sc.heatwave(3, delta_c=2.0), sc.baseline()]
    out = sc.apply_many(x, both)
    assert {r.scenario_id: r.n for r in out.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {s.scenario_id(): 20 for s in both}


def test_requests_in_words(spark):
    texts = ["Simula en Arizona una ola de calor de 7 días (+3 C) con un corte de luz del 25% y 18 horas", "En Louisiana queremos evaluar un centro de enfriamiento del 20% con percentil 95", "fips 22 and 77", "apagón de 3 días", "heatwave in Texas", None]
    a, b, c, d, e, none = sc.extract_params(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string"), "q", "2023-07-01", "2023-07-31").orderBy("i").collect()
    assert (a.geoids, a.heatwave_days, a.heatwave_delta_c, a.heatwave_percentile, a.blackout_frac, a.blackout_hours, a.valid_from) == (["04"], 7, 3.0, None, 0.25, 18.0, D(2023, 7, 1))
    assert "22" in b.geoids and (b.cooling_epsilon, b.heatwave_percentile) == (0.2, 95.0) and c.geoids == ["22"]
    assert (d.blackout_days, d.blackout_frac, d.blackout_hours) == (3, 0.2, 12.0)
    assert (e.geoids, e.heatwave_days, e.heatwave_percentile, e.geo_level) == (["48"], 5, 95.0, "state")
    assert (none.geoids, none.heatwave_days, none.blackout_frac, none.blackout_hours, none.blackout_days, none.cooling_epsilon) == (["04"], 0, 0.0, 0.0, 1, 0.0)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_outage_files_unite_by_header(spark, tmp_path):
    one = write(tmp_path / "a.csv", "fips_code,county,state,customers_out,run_start_time\n4013,M,AZ,50,2023-07-01 19:00:00\n")
    two = write(tmp_path / "b.csv", "﻿fips_code,state,county,run_start_time,customers_out\n04012,AZ,L,2023-07-01 19:15:00,7\n")
    assert sorted((r.geoid, r.customers_out, r.ts_utc) for r in fs.outage_csv(spark, [one, two]).collect()) == [("04012", 7.0, TS(2023, 7, 1, 19, 15)), ("04013", 50.0, TS(2023, 7, 1, 19))]
    with pytest.raises(Exception, match="unreadable time"):
        fs.outage_csv(spark, [write(tmp_path / "c.csv", "fips_code,customers_out,run_start_time\n1,2,soon\n")]).collect()


def test_denominators_keep_the_first_row(spark, tmp_path):
    path = write(tmp_path / "m.csv", "﻿County_FIPS,Customers\n4013,1000\n4013,10\n4012,0\n4012,200\n6037,x\n")
    assert sorted(map(tuple, fs.customers_csv(spark, path).collect())) == [("04012", 200.0), ("04013", 1000.0)]


def test_coverage_file(spark, tmp_path):
    path = write(tmp_path / "c.csv", "year,state,total_customers,min_covered,max_covered,min_pct_covered,max_pct_covered\n1/1/18,AL,10,1,2,0.22,0.5\n1/1/18,ZZ,10,1,2,0.1,0.2\n")
    got = fs.coverage_csv(spark, path, spark.createDataFrame([("AL", "01")], "postal string, geoid string"))
    assert sorted((r.geoid, r.valid_date, r.variable, round(r.value, 9)) for r in got.collect()) == [("01", D(2018, 1, 1), "max_pct_covered", 50.0), ("01", D(2018, 1, 1), "min_pct_covered", 22.0)]


def test_grid_text_checks_its_cell(spark, tmp_path):
    write(tmp_path / "g.txt", "v.v[2][1][1]\n[0][0], 672\n[1][0], 666\n\nv.day[2]\n44925, 44926\n\nv.lat[1]\n33.4\n\nv.lon[1]\n-112.1\n")
    rows = fs.grid_text(spark, str(tmp_path), "v").orderBy("valid_date").collect()
    assert [(r.valid_date, r.raw, r.lat) for r in rows] == [(D(2023, 1, 1), 672.0, 33.4), (D(2023, 1, 2), 666.0, 33.4)]
    cell = lambda lat: spark.createDataFrame([("g.txt", lat, -112.1)], "file string, lat double, lon double")
    assert fs.grid_text(spark, str(tmp_path), "v", cell(33.4)).count() == 2
    with pytest.raises(Exception, match="another cell"):
        fs.grid_text(spark, str(tmp_path), "v", cell(33.9)).collect()


def test_files_are_verified(spark, tmp_path):
    path = write(tmp_path / "f.bin", "body")
    found = fs.artifacts(spark, path)
    publish = lambda md5: found.select("path").withColumn("md5", F.lit(md5))
    right = hashlib.md5(b"body").hexdigest()
    assert fs.verify(found, publish(right.upper())).count() == 0 and fs.verify(found, publish("0" * 32)).count() == 1


def test_incoming_rows_are_coerced(spark):
    raw = spark.createDataFrame([(" state ", "4", "2023-07-01", "v", "1.5", "extra"), ("county", "5", "never", "v", "x", None)], "geo_level string, geoid string, valid_date string, variable string, value string, note string")
    assert [tuple(r) for r in bt.coerce(raw).orderBy("geoid").collect()] == [("state", "4", D(2023, 7, 1), "v", 1.5, "extra"), ("county", "5", None, "v", None, None)]
    with pytest.raises(ValueError, match="geo level"):
        bt.coerce(raw.withColumn("geo_level", F.lit("planet")))
    with pytest.raises(ValueError, match="missing"):
        bt.coerce(raw.drop("value"))


def fact(geoid, variable, value, revision=0, known=TS(2024, 1, 1), day=D(2023, 7, 1)):
    return ("county", geoid, day, variable, "gridmet", value, known, revision)


def test_state_exposure(spark):
    facts = spark.createDataFrame([fact("04001", "tmmx", 40.0), fact("04001", "tmmx", 44.0, 1, TS(2025, 1, 1)), fact("04002", "tmmx", 30.0), fact("04001", "rmin", 10.0), fact("04002", "rmin", None), fact("22001", "rmin", 50.0)], FACTS)
    weights = spark.createDataFrame([("04001", "04", 300.0), ("04002", "04", 100.0), ("22001", "22", 10.0)], "geoid string, parent string, population double")
    at = lambda known: {r.geoid: r for r in pn.state_exposure(facts, weights, ["tmmx", "rmin"], "2023-01-01", "2023-12-31", known).collect()}
    got = at("2024-06-01")
    assert (got["04"].tmmx, got["04"].rmin, got["04"].pop_coverage) == (37.5, 10.0, 0.75) and (got["22"].tmmx, got["22"].rmin, got["22"].pop_coverage) == (None, 50.0, 1.0)
    assert at("2025-06-01")["04"].tmmx == 40.5
    meta = bt.snapshot_meta(facts, known_at="2024-06-01").first()
    assert (meta.n_facts, meta.sources, meta.valid_from, meta.known_at) == (5, ["gridmet"], D(2023, 7, 1), TS(2024, 1, 1))
    made = bt.manifest(facts).first()
    assert (made.n_rows, made.last_known_at) == (6, TS(2025, 1, 1)) and made.manifest_id == bt.manifest(facts.orderBy("value")).first().manifest_id


def test_outages_take_their_own_zone_and_denominator(spark):
    raw = spark.createDataFrame([("04013", TS(2023, 7, 1, 3), 50.0), ("36001", TS(2023, 7, 1, 3), 5.0), ("36002", TS(2023, 7, 1, 3), 5.0)], "geoid string, ts_utc timestamp, customers_out double")
    customers = spark.createDataFrame([("04013", 1000.0), ("36001", 100.0)], "geoid string, customers double")
    zones = spark.createDataFrame([("04", "America/Phoenix"), ("36", "America/New_York")], "state_fips string, tz string")
    got = pn.outage_snapshots(pn.with_denominators(raw, customers, zones), None)
    assert sorted((r.geoid, r.ts, r.frac) for r in got.collect()) == [("04013", TS(2023, 6, 30, 20), 0.05), ("36001", TS(2023, 6, 30, 23), 0.05)]


def test_daily_outages_in_one_pass(spark):
    slots = [0, 1, 2, 5, 6, 7, 8, 20]
    s = spark.createDataFrame([("04013", TS(2023, 7, 1) + dt.timedelta(minutes=15 * i), D(2023, 7, 1), 0.05 if i in slots else 0.001, 50.0 if i in slots else 1.0) for i in range(24)], "geoid string, ts timestamp, day date, frac double, customers_out double")
    r = pn.outage_daily(s).first()
    assert (r.max_frac, r.max_hours, r.customer_hours) == (0.05, 1.0, (50 * 8 + 16) / 4) and pn.outage_daily(s.where("frac < 0.01")).first().max_hours == 0.0


def test_p_values(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 2.5, 2.9, 4.2, 7.0, -3.1]
    got = spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").select("i", st.two_sided(F.col("z")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-6)
    for k in (1, 2, 3, 4, 5):
        steps = 200_000  # the density's integral from x on, by the midpoint rule
        for x in (0.5, 5.4):
            width = 120.0 / steps
            want = sum(t ** (k / 2 - 1) * math.exp(-t / 2) for t in (x + (i + 0.5) * width for i in range(steps))) * width / (2 ** (k / 2) * math.gamma(k / 2))
            assert spark.range(1).select(st.chi2_upper(F.lit(x), k).alias("p")).first().p == pytest.approx(want, rel=1e-4)


def test_friedman_corrects_for_ties(spark):
    m = spark.createDataFrame([(b, k, float(s)) for b, row in enumerate([(3, 3, 1), (3, 2, 1), (2, 2, 2), (5, 1, 4)]) for k, s in zip("xyz", row, strict=True)] + [(9, "x", 1.0)], "block int, model string, score double")
    r = st.friedman(m).first()
    ranks = {"x": (1.5 + 1 + 2 + 1) / 4, "y": (1.5 + 2 + 2 + 3) / 4, "z": (3 + 3 + 2 + 2) / 4}
    raw = 12 * 4 / (3 * 4) * (sum(v * v for v in ranks.values()) - 3 * 16 / 4)
    assert (r.models, r.blocks) == (3, 4) and r.chi2 == pytest.approx(raw / (1 - (6 + 24) / (4 * 24))) and r.p_value == pytest.approx(math.exp(-r.chi2 / 2))


def test_default_lag_of_loss_differences(spark):
    d = [math.sin(i) + 0.3 * i % 2 for i in range(30)]
    r = st.diebold_mariano(spark.createDataFrame([(i, x) for i, x in enumerate(d)] + [(99, None)], "day int, d double")).first()
    mean = sum(d) / 30
    e = [x - mean for x in d]
    var = sum(x * x for x in e) / 30 + sum(2 * (1 - h / 4) * sum(a * b for a, b in zip(e[h:], e[:-h], strict=True)) / 30 for h in (1, 2, 3))
    assert r.dm == pytest.approx(mean / math.sqrt(var / 30)) and r.p_value == pytest.approx(math.erfc(abs(r.dm) / math.sqrt(2)))


def test_corrected_t_and_log_histogram(spark):
    r = st.corrected_t(spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "d double"), "d", 90, 10).first()
    assert r.t == pytest.approx((0.7 / 3) / math.sqrt((1 / 3 + 10 / 90) * (((0.1 - 0.7 / 3) ** 2 + (0.2 - 0.7 / 3) ** 2 + (0.4 - 0.7 / 3) ** 2) / 2)))
    h = {r.bin: r.n for r in st.log_histogram(spark.createDataFrame([(x,) for x in (1.0, 2.0, 10.0, 100.0, 0.0, -1.0)], "x double"), "x", 2).collect()}
    assert h == {1: 2, 2: 2}


def test_choice_goes_by_gates_then_simplicity(spark):
    table = lambda *rows: spark.createDataFrame(rows, "model string, level int, value double, auc boolean, rank boolean, calibration boolean")
    pick = lambda *rows: md.choose(table(*rows)).first().model
    assert pick(("a", 0, 0.6, False, True, True), ("b", 1, 0.8, True, True, True), ("c", 2, 0.9, True, True, True)) == "b"
    assert pick(("a", 0, 0.6, False, True, True), ("b", 1, 0.8, True, True, False), ("c", 2, 0.9, True, True, True)) == "c"
    assert pick(("a", 0, 0.6, True, False, True), ("b", 1, 0.8, True, True, False), ("c", 1, 0.9, True, True, False)) == "c"
    assert pick(("a", 0, 0.6, False, True, True), ("b", 1, 0.9, True, False, True)) == "b"


def test_report_tables(spark):
    x = spark.createDataFrame([("04", D(2022, 7, 1), 1.0), ("04", D(2022, 7, 2), 3.0), ("04", D(2023, 7, 1), 5.0)], "geoid string, valid_date date, value double")
    assert rp.by_year(x).first().by_year == {2022: 2.0, 2023: 5.0}
    a = spark.createDataFrame([("a", TS(2023, 1, i + 1)) for i in range(20)], "source string, fetched_at timestamp")
    assert [r.fetched_at.day for r in rp.latest_artifacts(a, 3).collect()] == [20, 19, 18]
    load = ex.grouped_load(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (1, "c", 9.0), (2, "a", -1.0)], "id int, feature string, value double"), ["a", "b"], "id")
    assert {r.id: r.load for r in load.collect()} == {1: 0.75, 2: -1.0}
    flags = spark.createDataFrame([("04", 1.0, 0.0, 0.0), ("04", 1.0, 1.0, 1.0), ("22", 0.0, 1.0, 0.0)], "geoid string, hot double, outage double, compound double")
    t = pn.compound_totals(pn.compound_summary(flags)).first()
    assert (t.days, t.hot, t.outage, t.compound, t.expected) == (3, 2.0, 2.0, 1.0, 1.0)


def test_stream_pairs_equal_batch_pairs(spark, tmp_path):
    p = spark.createDataFrame([prediction("a", 10.0), prediction("b", 11.0, version="2", hour=9)], PRED)
    o = spark.createDataFrame([observation(10.0, known=TS(2023, 7, 20))], OBS)
    p.write.parquet(str(tmp_path / "p"))
    o.write.parquet(str(tmp_path / "o"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = jobs.forecast_pairs(read("p", p), read("o", o), horizon="90 days").writeStream.format("memory").queryName("stream_pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = fc.pairs(p, o).where("genuine")
    assert sorted((r.prediction_id, r.obs) for r in spark.table("stream_pairs").collect()) == sorted((r.prediction_id, r.obs) for r in batch.collect()) == [("a", 10.0), ("b", 10.0)]


def test_filters_reach_the_scan_of_a_written_fact_table(spark, tmp_path):
    bt.append(spark.createDataFrame([fact("04001", "tmmx", 40.0), ("state", "04", D(2023, 7, 1), "tmmx", "other", 1.0, TS(2024, 1, 1), 0)], FACTS), str(tmp_path / "facts"))
    known = bt.as_of(bt.scan(spark, str(tmp_path / "facts")), "2024-06-01", geo_level="county", variables=["tmmx"])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(geo_level" in plan and "PushedFilters: [" in plan and "variable" in plan.split("PushedFilters")[1]
    assert [(r.geoid, r.value) for r in known.collect()] == [("04001", 40.0)]


def test_requests_are_matched_once(spark):
    """A request's tokens are made in one place of the plan, and not again for each place of each slot."""
    df = spark.createDataFrame([("7 días en Texas, 20% sin luz 10 horas",), (None,), ("",)], "q string")
    got = sc.extract_params(df, "q")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2  # tokens, and codes of places
    rows = [(r.heatwave_days, r.blackout_frac, r.blackout_hours, r.geoids) for r in got.collect()]
    assert rows == [(7, 0.2, 10.0, ["48"]), (0, 0.0, 0.0, ["04"]), (0, 0.0, 0.0, ["04"])]
