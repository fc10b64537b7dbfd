"""Sources and streams on small landed files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from twinframe.functions import dims, stages
from twinframe.operators import bitemporal as bt
from twinframe.operators import facttable as ft
from twinframe.operators import panel as pn
from twinframe.plans import queries
from twinframe.sources import files
from twinframe.streaming import jobs


def test_health_json(spark, tmp_path):
    cell = {"geoId": "04", "temporal": "2023", "calculationType": "Crude Rate", "groupById": "7", "dataValue": "48.1", "suppressionFlag": "0"}
    (tmp_path / "a.json").write_text(json.dumps({"tableResult": [cell, cell | {"geoId": "22", "dataValue": "", "suppressionFlag": "1"}], "dailyEstimatesTableResult": []}))
    (tmp_path / "b.json").write_text(json.dumps({"code": 429, "message": "later", "status": "error"}))
    cells, bad = files.health_json(spark, str(tmp_path))
    r = {x.geoid: x for x in cells.collect()}
    assert r["04"].value == 48.1 and r["04"].variable == "m7_crude_rate" and r["22"].censored and r["22"].value is None and r["22"].censor_hi == 10.0
    assert [(x.code, x.retryable) for x in bad.collect()] == [(429, True)]


def test_outage_and_customer_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text("fips_code,county,state,customers_out,run_start_time\n4013,M,AZ,50,2023-07-15 19:00:00\n6037,L,CA,,7/15/2023 19:15\n")
    rows = files.outage_csv(spark, [str(tmp_path / "o.csv")]).orderBy("geoid").collect()
    assert [(r.geoid, r.customers_out, r.ts_utc.minute) for r in rows] == [("04013", 50.0, 0), ("06037", None, 15)]
    assert files.outage_csv(spark, [str(tmp_path / "o.csv")], ["04"]).count() == 1
    (tmp_path / "bad.csv").write_text("fips_code,county,state,customers_out,run_start_time\n4013,M,AZ,50,yesterday\n")
    with pytest.raises(Exception, match="unreadable time"):
        files.outage_csv(spark, [str(tmp_path / "bad.csv")]).collect()
    (tmp_path / "c.csv").write_text("﻿County_FIPS,Customers\n4013,1000\n4012,200\n4011,0\n", encoding="utf-8")
    assert {r.geoid: r.customers for r in files.customers_csv(spark, str(tmp_path / "c.csv")).collect()} == {"04013": 1000.0, "04012": 200.0}


def test_unpack_and_packing(spark, tmp_path):
    (tmp_path / "p.txt").write_text('v {\n _FillValue 32767;\n units "K";\n scale_factor 0.1;\n add_offset 220;\n}')
    p = files.packing_text(spark, str(tmp_path / "p.txt"))
    r = p.select(files.unpack(F.lit(971.0), F.col("scale"), F.col("offset"), F.col("fill"), F.col("units")).alias("v"), files.unpack(F.lit(32767.0), F.col("scale"), F.col("offset"), F.col("fill"), F.col("units")).alias("f")).first()
    assert round(r.v, 2) == 43.95 and r.f is None


def test_streamed_daily_metrics_equal_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"g{i % 3}", t + dt.timedelta(minutes=15 * i), (i % 10) / 100, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "geoid string, ts timestamp, frac double, customers_out double").withColumn("day", F.to_date("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.daily_metrics(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.geoid, r.day): (r.max_frac, r.customer_hours) for r in spark.table("daily").collect()}
    want = {(r.geoid, r.day): (r.max_frac, r.customer_hours) for r in pn.outage_daily(df.withColumn("customers", F.lit(1.0))).collect()}
    assert got == want


def report(v, day, seq, unit="04"):
    return ("state", unit, dt.date(2023, 1, 1), "x", "s", v, dt.datetime(2024, 1, day), seq)


REPORT = "geo_level string, geoid string, valid_date date, variable string, source string, value double, known_at timestamp, seq long"


def test_streamed_reports_are_stored_once(spark, tmp_path):
    """Several knowledge times in a batch, a report delivered twice, and a batch replayed before and after its entry in the ledger."""
    table = ft.FactTable(spark, "streamed_facts", str(tmp_path / "facts"), 2).open()
    parts = [[report(1.0, 1, 1), report(1.0, 2, 2), report(5.0, 1, 1, "22")], [report(1.0, 2, 2), report(2.0, 3, 3), report(3.0, 4, 4)], [report(3.0, 5, 5), report(None, 6, 6)]]
    for rows in parts:
        spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = jobs.store_batches(table, str(tmp_path / "ledger"))
    q = jobs.fresh_reports(stream).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = bt.history_from_reports(spark.createDataFrame([r for rows in parts for r in rows], REPORT))
    rows = lambda df: sorted(map(tuple, df.select(*bt.KEY, *ft.COLUMNS).collect()), key=repr)
    assert rows(table.rows()) == rows(ft.intervals(want))
    first = spark.createDataFrame(parts[0], REPORT)
    write(first, 0)  # the ledger has it
    write(first, 99)  # stored, but not entered
    entries = {r.batch: json.loads(r.counters) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    assert rows(table.rows()) == rows(ft.intervals(want)) and entries[99]["written"] == 0 and entries[0] == {"received": 3, "collapsed": 0, "written": 2, "revisions": 0, "unchanged": 1}


def test_fact_table_against_bulk_history(spark, tmp_path):
    rng = random.Random(8)
    rows = [("county", f"{rng.randrange(6):02d}", dt.date(2021 + rng.randrange(3), 1, 1 + rng.randrange(3)), rng.choice("xy"), "s", rng.choice([1.0, 2.0, None]), dt.datetime(2024, 1, 1 + k // 40), k) for k in range(400)]
    history = bt.history_from_reports(spark.createDataFrame(rows, REPORT))
    table = ft.FactTable(spark, "bulk_facts", str(tmp_path / "facts"), 3).open()
    early, *later = [[r for r in rows if r[6].day in days] for days in ((1, 2, 3), (4, 5), (6,), (7, 8, 9, 10))]
    table.create(bt.history_from_reports(spark.createDataFrame(early, REPORT)))
    for part in later:
        assert table.upsert(spark.createDataFrame(part, REPORT))["received"] == len(part)
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(table.rows().select(*bt.KEY, *ft.COLUMNS)) == got(ft.intervals(history).select(*bt.KEY, *ft.COLUMNS))
    for day in (1, 5, 9):
        at = dt.datetime(2024, 1, day)
        assert got(table.as_of(at)) == got(bt.as_of(history, known_at=at).select(*bt.KEY, "value", "known_at", "revision"))
    assert all(len(list((tmp_path / "facts").glob(f"year={y}/*.parquet"))) <= 3 for y in (2021, 2022, 2023))  # rewritten, not piled up
    again = ft.FactTable(spark, "bulk_facts_again", str(tmp_path / "facts"), 3).open()
    assert again.rows().count() == history.count()
    for bad, why in ((("county", "00", dt.date(2021, 1, 1), "x", "s", 77.0, dt.datetime(2023, 1, 1), 1), "known before"), (("county", None, dt.date(2021, 1, 1), "x", "s", 7.0, dt.datetime(2024, 2, 1), 1), "null in a key"), (("county", "00", dt.date(2021, 1, 1), "x", "s", 7.0, dt.datetime(2999, 1, 1), 1), "future")):
        with pytest.raises(Exception, match=why):
            table.upsert(spark.createDataFrame([bad], REPORT))
    assert table.rows().count() == history.count()


def test_plans_of_the_fact_table(spark, tmp_path):
    """An as-of is a pruned scan without a window; the stored side of an upsert's join is not shuffled."""
    table = ft.FactTable(spark, "planned_facts", str(tmp_path / "facts"), 2).open()
    table.create(bt.history_from_reports(spark.createDataFrame([report(1.0, 1, 1)], REPORT)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    full = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    state = (lambda df: df._jdf.queryExecution().explainString(full))(table.as_of("2024-01-02", geoid=["04"], valid_from="2023-01-01"))
    assert "Window" not in state and "Exchange" not in state and "PartitionFilters: [isnotnull(year" in state and "EqualTo(geoid,04)" in state
    one = spark.createDataFrame([report(2.0, 3, 2)], REPORT).select(*bt.KEY, "value", "known_at")
    new = stages.written(ft.news(table.rows(), one), "news")
    merged = plan(table._merged(table.rows(), new))
    assert merged.count("Exchange") == 1 and "planned_facts" in merged.split("Exchange")[0]  # the batch's alone


def test_as_of_join_over_spans(spark):
    rows = [("a", dt.datetime(2020, 1, 1), dt.datetime(2022, 6, 1), 1.0), ("a", dt.datetime(2022, 6, 1), None, 2.0), ("b", dt.datetime(2023, 1, 1), None, 3.0)]
    facts = spark.createDataFrame(rows, "k string, known_at timestamp, superseded_at timestamp, value double")
    points = spark.createDataFrame([("a", dt.datetime(y, 6, 1), y) for y in range(2019, 2026)] + [("b", dt.datetime(2022, 1, 1), 0), ("b", dt.datetime(2030, 1, 1), 1)], "k string, at timestamp, n int")
    got = {(r.k, r.n): r.value for r in ft.as_of_join(points, facts, ["k"], "at", span_days=100).collect()}
    assert got == {("a", 2020): 1.0, ("a", 2021): 1.0, ("a", 2022): 2.0, ("a", 2023): 2.0, ("a", 2024): 2.0, ("a", 2025): 2.0, ("b", 1): 3.0}


def test_missing_units_and_source_version(spark):
    rows = spark.createDataFrame([("04013",), ("04013",), ("06037",), (None,)], "geoid string")
    known = spark.createDataFrame([("04013", 10.0)], "geoid string, customers double")
    assert {r.geoid for r in files.missing_units(rows, known).collect()} == {"06037", None}
    found = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 2, 1)), ("b", dt.datetime(2024, 1, 5))], "source string, fetched_at timestamp")
    assert {r.source: r.source_version for r in files.source_version(found, {"b": "v2"}).collect()} == {"a": "2024-02-01", "b": "v2"}


def test_centroids_cells_and_grid_facts(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\ufeffSTATEFP,COUNTYFP,COUNAME,STNAME,POPULATION,LATITUDE,LONGITUDE\n4,13,M,Arizona,800,33.0,-112.0\n04,019,P,Arizona,150,33.01,-112.02\n02,020,A,Alaska,50,61.0,-150.0\n", encoding="utf-8")
    units = files.centroids_csv(spark, str(tmp_path / "c.csv"))
    assert sorted(r.geoid for r in units.collect()) == ["02020", "04013", "04019"]
    assert [r.geoid for r in files.select_units(units, ["4"], ["4019"]).collect()] == ["04019"] and files.select_units(units).count() == 3
    cells = files.assign_cell(units, 49.4, -124.8, 1 / 24, 585, 1386)
    at = {r.geoid: (r.i, r.j) for r in cells.collect()}
    assert set(at) == {"04013", "04019"}
    day = dt.date(2023, 1, 1)
    series = [("tmmx", *at["04013"], day, 971.0, dt.datetime(2024, 1, 1)), ("tmmx", *at["04013"], day, 981.0, dt.datetime(2024, 2, 1)), ("tmmx", *at["04019"], day, 32767.0, dt.datetime(2024, 1, 1))]
    series = spark.createDataFrame(series, "variable string, i int, j int, valid_date date, raw double, fetched_at timestamp")
    packing = spark.createDataFrame([("tmmx", 0.1, 220.0, 32767.0, "K")], "variable string, scale double, offset double, fill double, units string")
    got = {r.geoid: r.value for r in files.grid_facts(series, cells, packing, {"tmmx": "K"}).collect()}
    assert got["04013"] == pytest.approx(44.95) and (at["04013"] == at["04019"] or got["04019"] is None)
    with pytest.raises(Exception, match="unexpected units"):
        files.grid_facts(series, cells, packing, {"tmmx": "C"}).collect()
    (tmp_path / "d.csv").write_text("STATEFP,COUNTYFP,COUNAME,STNAME,POPULATION,LATITUDE,LONGITUDE\n4,13,M,A,1,3,4\n04,013,M,A,1,3,4\n")
    with pytest.raises(ValueError, match="twice"):
        files.centroids_csv(spark, str(tmp_path / "d.csv"))


def test_load_registers_and_counts(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for name, text in (("a", "one"), ("b", "one"), ("c", "two")):
        (tmp_path / "raw" / name).write_text(text)
    found = files.artifacts(spark, str(tmp_path / "raw"))
    known = found.where("path LIKE '%/c'")
    rows = spark.createDataFrame([("state", "04", dt.date(2023, 1, 1), "x", 1.0), ("state", "22", dt.date(2023, 1, 1), "x", None)], "geo_level string, geoid string, valid_date date, variable string, value double")
    fresh, new, stats = files.load(spark.createDataFrame([], bt.FACT), rows, "s", "2024-01-01", found, known)
    assert stats["written"] == 2 and stats["artifacts"] == 3 and stats["bytes"] == 9 and new.count() == 1 and fresh.where("source = 's'").count() == 2
    with pytest.raises(ValueError, match="surplus"):
        files.load(spark.createDataFrame([], bt.FACT), rows.unionByName(rows), "s", "2024-01-01")
    good, bad = files.split_bad(rows, F.col("value") > 0)
    assert (good.count(), bad.count()) == (1, 1)


def test_states(spark):
    r = {x.postal: x for x in dims.states(spark).collect()}
    assert len(r) == 52 and r["DC"].name == "District of Columbia" and r["IN"].tz == "America/Indiana/Indianapolis" and r["AZ"].hhs_region == 9 and r["PR"].hhs_region is None


@pytest.mark.parametrize("turn", (1, -1))
def test_reports_of_one_number_are_told_by_value(spark, turn):
    """Of reports with one key, time and number that of the greatest value counts, however they come; null is the least."""
    rows = [report(v, 1, 1) for v in (2.0, None, 7.0, 5.0)] + [report(v, 2, 2) for v in (None, 1.0)]
    df = spark.createDataFrame(rows[::turn], REPORT).coalesce(1)
    assert [r.value for r in bt.history_from_reports(df).orderBy("revision").collect()] == [7.0, 1.0]


@pytest.mark.parametrize("turn", (1, -1))
def test_stored_reports_of_one_number_are_told_by_value(spark, tmp_path, turn):
    rows = [report(v, 1, 1) for v in (2.0, None, 7.0, 5.0)] + [report(v, 2, 2) for v in (None, 1.0)]
    table = ft.FactTable(spark, f"told_facts_{turn + 1}", str(tmp_path / "facts"), 2).open()
    table.upsert(spark.createDataFrame(rows[::turn], REPORT).coalesce(1))
    assert [r.value for r in table.rows().orderBy("revision").collect()] == [7.0, 1.0]


def test_micro_batches_of_several_files(spark, monkeypatch):
    """Each part is one micro-batch also where it has more files, or fewer rows than files."""
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    df = spark.range(100).select("id", (F.col("id") >= 97).cast("int").alias("part"))
    stream = queries.micro_batches(spark, df, F.col("part"), 2)
    sizes = []
    stream.writeStream.foreachBatch(lambda rows, k: sizes.append(rows.count())).option("checkpointLocation", queries.new_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination(120)
    assert sizes == [97, 3]
