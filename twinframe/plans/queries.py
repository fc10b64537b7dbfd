"""Queries over the driver's tables, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe import fixtures as fx
from twinframe.functions.scalars import heat_index_c, heat_index_sql, stable_id
from twinframe.functions.stages import count_files, new_path, written
from twinframe.operators import bitemporal as bt
from twinframe.operators import explain as ex
from twinframe.operators import facttable as ft
from twinframe.operators import forecasts as fc
from twinframe.operators import models as md
from twinframe.operators import panel as pn
from twinframe.operators import reports as rp
from twinframe.operators import resampling as rs
from twinframe.operators import scenarios as sc
from twinframe.operators import stats as st
from twinframe.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T = "1998-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *cols, to=6):
    return df.withColumns({c: F.round(c, to) for c in cols})


KEY = ", ".join(bt.KEY)
FACTS = f"""reports AS ({fx.REPORTS}),
c AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, known_at ORDER BY seq DESC, value DESC NULLS LAST) AS nth FROM reports),
d AS (SELECT *, lag(value) OVER k AS was, row_number() OVER k AS n FROM c WHERE nth = 1 WINDOW k AS (PARTITION BY {KEY} ORDER BY known_at)),
facts AS (SELECT {KEY}, value, known_at, (row_number() OVER (PARTITION BY {KEY} ORDER BY known_at) - 1)::INTEGER AS revision FROM d WHERE n = 1 OR value IS DISTINCT FROM was),
latest AS (SELECT * FROM facts WHERE known_at <= TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY revision DESC) = 1)"""


def facts(spark, d):
    return bt.history_from_reports(fx.view(spark, d, fx.REPORTS))


def day(c="known_at"):
    return F.date_format(c, "yyyy-MM-dd")


@query(f"WITH {FACTS} SELECT {KEY}, value, strftime(known_at, '%Y-%m-%d') AS known_at, revision FROM facts")
def facts_history(spark, d):
    return facts(spark, d).withColumn("known_at", day())


@query(f"WITH {FACTS} SELECT {KEY}, value, revision FROM latest")
def facts_as_of(spark, d):
    return bt.as_of(facts(spark, d), known_at=T).select(*bt.KEY, "value", "revision")


@query(f"WITH {FACTS} SELECT geoid, valid_date, value, revision FROM facts WHERE known_at <= TIMESTAMP '{T}' AND variable = 'tmmx' AND geoid IN ('01', '02') AND valid_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY revision DESC) = 1")
def facts_as_of_filtered(spark, d):
    return bt.as_of(facts(spark, d), known_at=T, variables=["tmmx"], geoids=["01", "02"], valid_from="1996-01-01", valid_to="1996-12-31").select("geoid", "valid_date", "value", "revision")


@query(f"WITH {FACTS} SELECT geoid, valid_date, max(value) FILTER (variable = 'tmmx') AS tmmx, max(value) FILTER (variable = 'rmin') AS rmin FROM latest GROUP BY ALL")
def facts_snapshot(spark, d):
    return bt.snapshot(facts(spark, d), ["tmmx", "rmin"], known_at=T)


@query(f"WITH {FACTS} SELECT source, geo_level, variable, count(DISTINCT geoid) AS n_geoids, min(valid_date) AS first_date, max(valid_date) AS last_date, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, max(revision) AS max_revision FROM facts GROUP BY ALL")
def facts_coverage(spark, d):
    return bt.coverage(facts(spark, d))


@query(f"WITH {FACTS} SELECT geo_level, variable, source, count(*) AS n_facts, count(DISTINCT geoid) AS n_geoids, min(valid_date) AS first_date, max(valid_date) AS last_date FROM latest GROUP BY ALL")
def facts_inventory(spark, d):
    return bt.inventory(bt.as_of(facts(spark, d), known_at=T))


@query(f"WITH {FACTS} SELECT {KEY}, value, revision FROM facts QUALIFY max(revision) OVER (PARTITION BY {KEY}) > 0")
def facts_revised(spark, d):
    return bt.revised(facts(spark, d)).select(*bt.KEY, "value", "revision")


@query(f"WITH {FACTS} SELECT {KEY}, strftime(min(known_at), '%Y-%m-%d') AS first_known_at FROM facts GROUP BY ALL")
def facts_first_known(spark, d):
    return bt.first_known(facts(spark, d)).withColumn("first_known_at", day("first_known_at"))


@query(f"WITH {FACTS} SELECT value, revision, strftime(known_at, '%Y-%m-%d') AS known_at, geoid, valid_date FROM facts WHERE geoid = '03' AND variable = 'tmmx'")
def facts_unit_history(spark, d):
    return bt.history(facts(spark, d), geoid="03", variable="tmmx").select("value", "revision", day().alias("known_at"), "geoid", "valid_date")


@query(f"""WITH {FACTS}, b AS (SELECT {KEY}, value FROM reports WHERE known_at > TIMESTAMP '{T}' AND known_at <= TIMESTAMP '1998-02-01' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC, value DESC NULLS LAST) = 1)
SELECT b.geo_level, b.geoid, b.valid_date, b.variable, b.source, b.value, coalesce(l.revision + 1, 0) AS revision FROM b LEFT JOIN latest l USING ({KEY}) WHERE l.revision IS NULL OR b.value IS DISTINCT FROM l.value""")
def facts_upsert(spark, d):
    reports = fx.view(spark, d, fx.REPORTS)
    stored = facts(spark, d).where(F.col("known_at") <= F.lit(T).cast("timestamp"))
    batch = bt.collapse(reports.where((F.col("known_at") > F.lit(T).cast("timestamp")) & (F.col("known_at") <= F.lit("1998-02-01").cast("timestamp"))))
    return bt.new_revisions(stored, batch, "1998-02-01").select(*bt.KEY, "value", "revision")


@query(f"WITH {FACTS} SELECT (count(*) - count(DISTINCT (geo_level, geoid, valid_date, variable, source)))::BIGINT AS duplicates, 0::BIGINT AS null_keys, count(*) AS n_rows FROM reports")
def facts_validate(spark, d):
    return bt.validate(fx.view(spark, d, fx.REPORTS))


@query(f"""WITH {FACTS} SELECT substr(sha256(geo_level || chr(31) || geoid || chr(31) || valid_date || chr(31) || variable || chr(31) || source), 1, 32) AS fact_key, value FROM latest""")
def facts_keys(spark, d):
    return bt.as_of(facts(spark, d), known_at=T).select(bt.fact_key().alias("fact_key"), "value")


@query(f"WITH x AS ({fx.DAILY}) SELECT geoid, valid_date, variable, round(value, 6) AS value FROM x UNPIVOT (value FOR variable IN (tmmx, tmmn, rmin, rmax))")
def unpivot_daily(spark, d):
    return rounded(bt.to_facts(fx.view(spark, d, fx.DAILY), ["geoid", "valid_date"], ["tmmx", "tmmn", "rmin", "rmax"]), "value")


@query(f"""WITH c AS ({fx.CHILD}), w AS ({fx.WEIGHTS}), t AS (SELECT parent, sum(population) AS total FROM w GROUP BY parent)
SELECT parent, valid_date, variable, round(sum(value * population) / sum(population), 7) AS value, round(sum(population) / any_value(total), 6) AS coverage
FROM c JOIN w USING (geoid) JOIN t USING (parent) GROUP BY parent, valid_date, variable HAVING sum(population) / any_value(total) >= 0.5 - 1e-12""")
def weighted_parent_mean(spark, d):
    out = pn.population_weighted(fx.view(spark, d, fx.CHILD), fx.view(spark, d, fx.WEIGHTS), 0.5)
    return rounded(rounded(out, "value", to=7), "coverage")


@query(f"""WITH w AS ({fx.WEIGHTS}), s AS (SELECT *, (sum(population) OVER (PARTITION BY parent ORDER BY population DESC, geoid ROWS UNBOUNDED PRECEDING) - population) / sum(population) OVER (PARTITION BY parent) AS before FROM w)
SELECT geoid, parent, population FROM s WHERE before < 0.6""")
def top_until_share(spark, d):
    return pn.top_until_share(fx.view(spark, d, fx.WEIGHTS), "parent", "geoid", "population", 0.6)


SNAP = f"""o AS ({fx.OUTAGE}), s AS (SELECT geoid, ts_utc - INTERVAL '7' HOUR AS ts, max(customers_out) AS customers_out, max(customers) AS customers FROM o GROUP BY 1, 2),
snap AS (SELECT *, CAST(ts AS DATE) AS day, least(1.0::DOUBLE, customers_out / customers) AS frac FROM s)"""
DAYS = f"""{SNAP}, i AS (SELECT geoid, day, epoch(ts)::BIGINT // 900 - row_number() OVER (PARTITION BY geoid, day ORDER BY ts) AS run FROM snap WHERE frac >= 0.01),
l AS (SELECT geoid, day, max(n) * 0.25::DOUBLE AS max_hours FROM (SELECT geoid, day, run, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL),
daily AS (SELECT geoid, day, max(frac) AS max_frac, sum(customers_out) * 0.25 AS customer_hours FROM snap GROUP BY ALL)"""


def snaps(spark, d):
    return pn.outage_snapshots(fx.view(spark, d, fx.OUTAGE))


@query(f"WITH {SNAP} SELECT geoid, strftime(ts, '%Y-%m-%d %H:%M') AS ts, day, round(frac, 9) AS frac FROM snap")
def outage_snapshots(spark, d):
    return rounded(snaps(spark, d).select("geoid", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "day", "frac"), "frac", to=9)


@query(f"WITH {SNAP} SELECT count(*) AS n_snapshots, count(*) FILTER (customers_out > customers) AS n_clipped FROM snap")
def outage_clips(spark, d):
    return pn.clip_report(snaps(spark, d))


@query(f"WITH {DAYS} SELECT geoid, day, round(max_frac, 9) AS max_frac, coalesce(max_hours, 0) AS max_hours, round(customer_hours, 4) AS customer_hours FROM daily LEFT JOIN l USING (geoid, day)")
def outage_daily(spark, d):
    return rounded(rounded(pn.outage_daily(snaps(spark, d)), "max_frac", to=9), "customer_hours", to=4).select("geoid", "day", "max_frac", "max_hours", "customer_hours")


@query(f"""WITH {DAYS}, span AS (SELECT geoid, min(day) AS a, max(day) AS b FROM daily GROUP BY geoid),
g AS (SELECT geoid, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM span)
SELECT geoid, day, round(coalesce(max_frac, 0), 9) AS max_frac, round(coalesce(customer_hours, 0), 4) AS customer_hours FROM g LEFT JOIN daily USING (geoid, day)""")
def outage_densified(spark, d):
    daily = pn.outage_daily(snaps(spark, d))
    span = daily.groupBy("geoid").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    out = pn.densify(daily, span, ["max_frac", "customer_hours"]).select("geoid", "day", "max_frac", "customer_hours")
    return rounded(rounded(out, "max_frac", to=9), "customer_hours", to=4)


@query(f"""WITH {SNAP}, t AS (SELECT substr(geoid, 1, 2) AS parent, sum(c) AS total FROM (SELECT geoid, max(customers) AS c FROM snap GROUP BY geoid) GROUP BY 1)
SELECT parent, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(least(1.0::DOUBLE, sum(customers_out) / any_value(total)), 9) AS frac FROM snap JOIN t ON substr(geoid, 1, 2) = parent GROUP BY parent, ts""")
def outage_parent(spark, d):
    s = snaps(spark, d)
    total = s.groupBy("geoid").agg(F.max("customers").alias("c")).groupBy(F.substring("geoid", 1, 2).alias("parent")).agg(F.sum("c").alias("total"))
    out = pn.parent_snapshots(s, total, F.substring("geoid", 1, 2))
    return rounded(out.select("parent", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "frac"), "frac", to=9)


HOT = f"""x AS ({fx.DAILY}), thr AS (SELECT geoid, quantile_cont(tmmx::DOUBLE, 0.9) AS threshold FROM x WHERE valid_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY geoid),
h AS (SELECT x.geoid, valid_date, tmmx, tmmn, (tmmx > threshold)::INT::DOUBLE AS hot FROM x LEFT JOIN thr USING (geoid)),
b AS (SELECT *, sum(CASE WHEN coalesce(hot <> 1, true) OR coalesce(date_diff('day', before, valid_date) <> 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY geoid ORDER BY valid_date) AS isle
  FROM (SELECT *, lag(valid_date) OVER (PARTITION BY geoid ORDER BY valid_date) AS before FROM h)),
s AS (SELECT geoid, valid_date, tmmx, tmmn, hot, sum(CASE WHEN hot = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY geoid, isle ORDER BY valid_date)::DOUBLE AS hot_streak FROM b)"""


def hot_days(spark, d):
    x = fx.view(spark, d, fx.DAILY)
    thr = pn.local_percentile(x, "tmmx", 90, "1996-01-01", "1997-12-31")
    return x.join(thr, "geoid", "left").withColumn("hot", pn.above(F.col("tmmx"), F.col("threshold")))


@query(f"WITH {HOT} SELECT geoid, round(threshold, 6) AS threshold FROM thr")
def local_percentile(spark, d):
    return rounded(pn.local_percentile(fx.view(spark, d, fx.DAILY), "tmmx", 90, "1996-01-01", "1997-12-31"), "threshold")


@query(f"WITH {HOT} SELECT geoid, valid_date, hot, hot_streak FROM s")
def hot_streak(spark, d):
    return pn.with_streak(hot_days(spark, d)).select("geoid", "valid_date", "hot", "hot_streak")


@query(f"""WITH {HOT}, f AS (SELECT *, CASE WHEN hot_streak > 0 THEN valid_date - (hot_streak - 1)::INT END AS start, year(valid_date) AS y FROM s),
r AS (SELECT geoid, y, min(start) AS first FROM (SELECT geoid, y, start, max(hot_streak) AS n FROM f WHERE start IS NOT NULL GROUP BY ALL) WHERE n >= 2 GROUP BY ALL)
SELECT f.geoid, valid_date, coalesce((start = first)::INT::DOUBLE, 0) AS first_wave FROM f LEFT JOIN r ON f.geoid = r.geoid AND f.y = r.y""")
def first_wave(spark, d):
    return pn.with_first_wave(pn.with_streak(hot_days(spark, d))).select("geoid", "valid_date", "first_wave")


@query(f"WITH x AS ({fx.DAILY}) SELECT geoid, valid_date, round(lag(tmmx) OVER w, 6) AS lag1, round(avg(tmmx) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM x WINDOW w AS (PARTITION BY geoid ORDER BY valid_date)")
def lag_and_rolling_mean(spark, d):
    x = fx.view(spark, d, fx.DAILY)
    return rounded(x.select("geoid", "valid_date", F.lag("tmmx").over(pn.by_day()).alias("lag1"), F.avg("tmmx").over(pn.by_day().rowsBetween(-2, 0)).alias("mean3")), "lag1", "mean3")


@query(f"WITH x AS ({fx.DAILY}) SELECT geoid, valid_date, round({heat_index_sql('tmmx', 'rmin')}, 6) AS heat_index FROM x")
def heat_index(spark, d):
    return rounded(fx.view(spark, d, fx.DAILY).select("geoid", "valid_date", heat_index_c(F.col("tmmx"), F.col("rmin")).alias("heat_index")), "heat_index")


OUT = "CASE WHEN month(valid_date) <> 2 THEN (tmmn - 10) / 40 END AS outage_customers_frac, CASE WHEN month(valid_date) <> 2 THEN tmmn / 4 END AS outage_max_hours"


def exposed(spark, d):
    off = F.month("valid_date") != 2
    return fx.view(spark, d, fx.DAILY).withColumns({"outage_customers_frac": F.when(off, (F.col("tmmn") - 10) / 40), "outage_max_hours": F.when(off, F.col("tmmn") / 4)})


COMPOUND = f"{HOT}, e AS (SELECT *, {OUT} FROM s), k AS (SELECT geoid, valid_date, hot, hot_streak, CASE WHEN outage_customers_frac IS NOT NULL AND outage_max_hours IS NOT NULL THEN (outage_customers_frac >= 0.05 AND outage_max_hours >= 1)::INT::DOUBLE END AS outage FROM e)"


def flags(spark, d):
    x = exposed(spark, d)
    return pn.compound_flags(x, pn.local_percentile(x, "tmmx", 90, "1996-01-01", "1997-12-31"))


@query(f"WITH {COMPOUND} SELECT geoid, valid_date, hot, hot_streak, outage, hot * outage AS compound FROM k")
def compound_flags(spark, d):
    return flags(spark, d).select("geoid", "valid_date", "hot", "hot_streak", "outage", "compound")


@query(f"WITH {COMPOUND}, z AS (SELECT geoid, count(*) AS days, sum(hot) AS hot, sum(outage) AS outage, sum(hot * outage) AS compound FROM k WHERE hot IS NOT NULL AND outage IS NOT NULL GROUP BY geoid) SELECT *, round(hot * outage / days, 6) AS expected, round(compound / nullif(hot * outage / days, 0), 6) AS ratio FROM z")
def compound_summary(spark, d):
    return rounded(pn.compound_summary(flags(spark, d)), "expected", "ratio")


@query(f"WITH {COMPOUND}, z AS (SELECT geoid, count(*) AS days, sum(hot) AS hot, sum(outage) AS outage, sum(hot * outage) AS compound FROM k WHERE hot IS NOT NULL AND outage IS NOT NULL GROUP BY geoid) SELECT sum(days)::BIGINT AS days, sum(hot) AS hot, sum(outage) AS outage, sum(compound) AS compound, round(sum(hot * outage / days), 6) AS expected FROM z")
def compound_totals(spark, d):
    return rounded(pn.compound_totals(pn.compound_summary(flags(spark, d))), "expected")


EXPOSURE = f"""w AS ({fx.COUNTIES}), l2 AS (SELECT * FROM latest WHERE valid_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND value IS NOT NULL), t AS (SELECT parent, sum(population) AS total FROM w GROUP BY 1),
e AS (SELECT w.parent, valid_date, variable, sum(value * population) / sum(population) AS value, sum(population) / any_value(total) AS coverage FROM l2 JOIN w USING (geoid) JOIN t ON t.parent = w.parent GROUP BY 1, 2, 3)"""


@query(f"WITH {FACTS}, {EXPOSURE} SELECT parent AS geoid, valid_date, round(max(value) FILTER (variable = 'tmmx'), 6) AS tmmx, round(max(value) FILTER (variable = 'rmin'), 6) AS rmin, round(min(coverage), 9) AS pop_coverage FROM e GROUP BY 1, 2")
def state_exposure(spark, d):
    out = pn.state_exposure(facts(spark, d), fx.view(spark, d, fx.COUNTIES), ["tmmx", "rmin"], "1996-01-01", "1996-12-31", T)
    return rounded(rounded(out, "tmmx", "rmin"), "pop_coverage", to=9)


@query(f"WITH {FACTS} SELECT count(*) AS n_facts, 'gridmet' AS sources, min(valid_date) AS valid_from, max(valid_date) AS valid_to, strftime(max(known_at), '%Y-%m-%d') AS known_at FROM latest WHERE variable = 'tmmx'")
def facts_snapshot_meta(spark, d):
    return bt.snapshot_meta(facts(spark, d), known_at=T, variables=["tmmx"]).withColumn("known_at", day()).withColumn("sources", F.concat_ws(",", "sources"))


@query(f"""WITH o AS ({fx.OUTAGE}), z(state_fips, tz, hours) AS (VALUES ('040', 'America/Phoenix', 7), ('041', 'Etc/GMT+5', 5)), c AS (SELECT geoid, max(customers) AS customers FROM o WHERE geoid <> '04003' GROUP BY 1),
s AS (SELECT o.geoid, ts_utc - hours * INTERVAL '1' HOUR AS ts, max(customers_out) AS customers_out, any_value(c.customers) AS customers FROM o JOIN c ON c.geoid = o.geoid JOIN z ON z.state_fips = substr(o.geoid, 1, 3) GROUP BY 1, 2)
SELECT geoid, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(least(1.0::DOUBLE, customers_out / customers), 9) AS frac FROM s""")
def outage_by_zone(spark, d):
    raw = fx.view(spark, d, fx.OUTAGE)
    customers = raw.where("geoid <> '04003'").groupBy("geoid").agg(F.max("customers").alias("customers"))
    zones = raw.select(F.substring("geoid", 1, 3).alias("state_fips")).distinct().withColumn("tz", F.when(F.col("state_fips") == "040", "America/Phoenix").when(F.col("state_fips") == "041", "Etc/GMT+5")).where("tz IS NOT NULL")
    out = pn.outage_snapshots(pn.with_denominators(raw.drop("customers"), customers, zones, 3), None)
    return rounded(out.select("geoid", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "frac"), "frac", to=9)


def panel_of(spark, d):
    x = fx.view(spark, d, fx.DAILY)
    regions = x.select("geoid").distinct().withColumn("hhs_region", F.col("geoid").cast("int") + 1)
    outcome = x.select("geoid", "valid_date", (F.col("tmmn") - 16).alias("rate"))
    return pn.build_panel(x.select("geoid", "valid_date", F.col("tmmx").alias("tmax"), F.col("tmmn").alias("tmin"), F.col("rmin").alias("rh_min")), outcome, regions, "1996-01-01", "1997-12-31", coverage=None)


PANEL = f"""x AS ({fx.DAILY}), hi AS (SELECT geoid, valid_date, tmmx AS tmax, tmmn AS tmin, rmin AS rh_min, {heat_index_sql('tmmx', 'rmin')} AS heat_index FROM x),
p AS (SELECT geoid, quantile_cont(heat_index::DOUBLE, 0.95) AS p95, avg(heat_index) FILTER (month(valid_date) BETWEEN 5 AND 9) AS clim FROM hi WHERE valid_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY geoid),
f AS (SELECT hi.*, heat_index - p95 AS hi_excess_p95, clim AS hi_clim_ref, lag(heat_index) OVER w AS hi_lag1, avg(heat_index) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hi_mean_3d FROM hi JOIN p USING (geoid) WINDOW w AS (PARTITION BY geoid ORDER BY valid_date))"""


@query(f"""WITH {PANEL} SELECT geoid, valid_date, round(heat_index, 5) AS heat_index, round(hi_excess_p95, 5) AS hi_excess_p95, round(hi_clim_ref, 5) AS hi_clim_ref, round(hi_lag1, 5) AS hi_lag1, round(hi_mean_3d, 5) AS hi_mean_3d,
round(sin(dayofyear(valid_date) * 2 * pi() / 365.25), 6) AS doy_sin, (isodow(valid_date) >= 6)::INT::DOUBLE AS weekend, (tmin > 16)::INT AS y, year(valid_date)::INT AS year, weekofyear(valid_date)::INT AS week, (geoid::INT + 1) AS hhs_region
FROM f WHERE month(valid_date) BETWEEN 5 AND 9 AND hi_lag1 IS NOT NULL AND hi_clim_ref IS NOT NULL""")
def feature_panel(spark, d):
    out = panel_of(spark, d).select("geoid", "valid_date", "heat_index", "hi_excess_p95", "hi_clim_ref", "hi_lag1", "hi_mean_3d", "doy_sin", "weekend", "y", "year", "week", "hhs_region")
    return rounded(rounded(out, "heat_index", "hi_excess_p95", "hi_clim_ref", "hi_lag1", "hi_mean_3d", to=5), "doy_sin")


@query(f"""WITH {PANEL}, q AS (SELECT * FROM f WHERE month(valid_date) BETWEEN 5 AND 9 AND hi_lag1 IS NOT NULL), dd AS (SELECT *, {heat_index_sql('(tmax + 2)', 'rh_min')} - heat_index AS dh FROM q)
SELECT geoid, valid_date, round(heat_index + dh, 5) AS heat_index, round(hi_excess_p95 + dh, 5) AS hi_excess_p95, round(hi_lag1 + coalesce(lag(dh) OVER w, dh), 5) AS hi_lag1, round(hi_mean_3d + avg(dh) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 5) AS hi_mean_3d FROM dd WINDOW w AS (PARTITION BY geoid ORDER BY valid_date)""")
def warming(spark, d):
    return rounded(pn.with_warming(panel_of(spark, d), 2.0).select("geoid", "valid_date", "heat_index", "hi_excess_p95", "hi_lag1", "hi_mean_3d"), "heat_index", "hi_excess_p95", "hi_lag1", "hi_mean_3d", to=5)


#: an outcome of the parents as facts: a day's mean discount, known a week later and corrected a month later
RATES = """SELECT 'state' AS geo_level, CASE WHEN l_suppkey % 5 < 2 THEN 'a' ELSE 'b' END AS geoid, CAST(l_shipdate AS DATE) AS valid_date, 'rate' AS variable, 'epht' AS source,
 round(avg(l_discount) * 100 - 5, 6) + k AS value, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL '1' DAY * CAST(7 + 600 * k AS INT) AS known_at, k AS revision
 FROM lineitem, (SELECT 0 AS k UNION ALL SELECT 1) r GROUP BY 2, 3, k"""


@query(f"""WITH {FACTS}, {EXPOSURE}, x0 AS (SELECT parent AS geoid, valid_date, max(value) FILTER (variable = 'tmmx') AS tmax, max(value) FILTER (variable = 'rmin') AS rh_min, least(1.0::DOUBLE, min(coverage)) AS c FROM e GROUP BY 1, 2),
x AS (SELECT geoid, valid_date, tmax, rh_min, {heat_index_sql('tmax', 'rh_min')} AS heat_index FROM x0 WHERE c >= 0.5),
p AS (SELECT geoid, quantile_cont(heat_index::DOUBLE, 0.95) AS p95 FROM x GROUP BY geoid),
f AS (SELECT x.*, heat_index - p95 AS over, lag(heat_index) OVER w AS hi_lag1, avg(heat_index) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3 FROM x JOIN p USING (geoid) WINDOW w AS (PARTITION BY geoid ORDER BY valid_date)),
o AS (SELECT geoid, valid_date, value AS rate FROM ({RATES}) WHERE known_at <= TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY geoid, valid_date ORDER BY revision DESC) = 1)
SELECT geoid, valid_date, round(heat_index, 5) AS heat_index, round(over, 5) AS hi_excess_p95, round(mean3, 5) AS hi_mean_3d, round(rate, 6) AS rate, (rate > 0)::INT AS y FROM f JOIN o USING (geoid, valid_date)
WHERE month(valid_date) BETWEEN 5 AND 9 AND hi_lag1 IS NOT NULL AND heat_index IS NOT NULL AND mean3 IS NOT NULL""")
def panel_from_facts(spark, d):
    """Exposures and outcome both from facts as known at T: parents' exposures with their coverage, then the panel."""
    exposure = pn.state_exposure(facts(spark, d), fx.view(spark, d, fx.COUNTIES), ["tmmx", "rmin"], "1996-01-01", "1996-12-31", T)
    exposure = exposure.select("geoid", "valid_date", F.col("tmmx").alias("tmax"), (F.col("tmmx") - 10).alias("tmin"), F.col("rmin").alias("rh_min"), "pop_coverage")
    regions = exposure.select("geoid").distinct().withColumn("hhs_region", F.lit(1))
    rates = pn.outcome(fx.view(spark, d, RATES), "rate", T, source="epht")
    panel = pn.build_panel(exposure, rates, regions, "1996-01-01", "1996-12-31", min_coverage=0.5)
    return rounded(rounded(panel.select("geoid", "valid_date", "heat_index", "hi_excess_p95", "hi_mean_3d", "rate", "y"), "heat_index", "hi_excess_p95", "hi_mean_3d", to=5), "rate")


@query(f"""WITH o AS (SELECT geoid, valid_date, (value > 0)::INT::DOUBLE AS value FROM ({RATES}) WHERE revision = 1), k AS (SELECT geoid, valid_date, min(known_at) AS known_at FROM ({RATES}) GROUP BY 1, 2)
SELECT geoid, valid_date AS target_date, value, strftime(known_at, '%Y-%m-%d') AS known_at, 0 AS revision FROM o JOIN k USING (geoid, valid_date) WHERE year(valid_date) > 1996""")
def sealed_observations(spark, d):
    """Outcomes sealed with the first known time of their facts, those stored already left out."""
    rates = fx.view(spark, d, RATES)
    panel = rates.where("revision = 1").select("geoid", "valid_date", (F.col("value") > 0).cast("int").alias("y"))
    none = rates.limit(0)
    first = fc.sealed_observations(panel.where(F.year("valid_date") <= 1996), rates, "rate", "risk", none.select("geo_level", "geoid", F.col("valid_date").alias("target_date"), F.lit("risk").alias("quantity"), "value", F.lit(False).alias("censored"), "revision"))
    new = fc.sealed_observations(panel, rates, "rate", "risk", first)
    return new.select("geoid", "target_date", "value", day().alias("known_at"), "revision")


@query(f"WITH p AS ({fx.PRED}) SELECT 'first' AS step, count(*) FILTER (prediction_id % 2 = 0) AS stored FROM p UNION ALL SELECT 'again', 0 FROM p GROUP BY () UNION ALL SELECT 'rest', count(*) FILTER (prediction_id % 2 = 1) FROM p UNION ALL SELECT 'log', count(*) FROM p")
def prediction_log_writes(spark, d):
    """Appends to a stored log: half of the rows, the same again, all rows; and what the log then holds."""
    p, path = fx.view(spark, d, fx.PRED).withColumn("prediction_id", F.col("prediction_id").cast("string")), new_path(spark, "log")
    even = p.where(F.col("prediction_id").cast("long") % 2 == 0)
    steps = [("first", fc.store_new(even, path)), ("again", fc.store_new(even, path)), ("rest", fc.store_new(p, path))]
    return spark.createDataFrame([*steps, ("log", spark.read.parquet(path).count())], "step string, stored long")


PAIRS = f"""pred AS ({fx.PRED}), obs AS ({fx.OBS}), cutp AS (SELECT * FROM pred WHERE issued_at <= TIMESTAMP '2001-06-01' AND scenario_id IS NULL),
o AS (SELECT geo_level, geoid, target_date, quantity, value AS obs, censored, censor_lo, censor_hi, min(known_at) OVER (PARTITION BY geo_level, geoid, target_date, quantity) AS first_known_at FROM obs WHERE known_at <= TIMESTAMP '2001-06-01'),
pairs AS (SELECT p.*, obs, censored, censor_lo, censor_hi, issued_at < first_known_at AS genuine FROM cutp p JOIN o USING (geo_level, geoid, target_date, quantity)),
kept AS (SELECT * FROM pairs WHERE genuine QUALIFY row_number() OVER (PARTITION BY geo_level, geoid, target_date, quantity, model_name, model_version ORDER BY issued_at DESC, prediction_id DESC) = 1),
g AS (SELECT *, greatest(censor_lo - value, 0) + greatest(value - censor_hi, 0) AS gap, CASE WHEN NOT censored THEN value END AS p, CASE WHEN NOT censored THEN obs END AS y FROM kept),
m AS (SELECT model_version, count(y) AS n_point, avg(CASE WHEN censored THEN gap ELSE abs(value - obs) END) AS mae, avg(p - y) AS bias, avg(p - y) / (stddev_samp(p - y) / sqrt(count(y))) AS bias_t, sqrt(avg((p - y) ** 2)) AS rmse, avg(y) AS obs_mean,
  regr_slope(y, p) AS calib_slope, regr_intercept(y, p) AS calib_intercept, avg(CASE WHEN censored THEN (gap = 0)::INT END) AS censored_hit_rate, avg(CASE WHEN y IS NOT NULL THEN (obs BETWEEN value_lower AND value_upper)::INT END) AS pi_coverage FROM g GROUP BY model_version)"""


def found_pairs(spark, d):
    return fc.pairs(fx.view(spark, d, fx.PRED), fx.view(spark, d, fx.OBS), "2001-06-01")


@query(f"WITH {PAIRS} SELECT prediction_id, geoid, target_date, round(value, 5) AS value, round(obs, 5) AS obs, censored, genuine FROM pairs")
def forecast_pairs(spark, d):
    return rounded(found_pairs(spark, d).select("prediction_id", "geoid", "target_date", "value", "obs", "censored", "genuine"), "value", "obs", to=5)


METRICS = ("mae", "bias", "bias_t", "rmse", "obs_mean", "calib_slope", "calib_intercept", "censored_hit_rate", "pi_coverage")


@query(f"WITH {PAIRS} SELECT model_version, n_point, {', '.join(f'round({c}, 4) AS {c}' for c in METRICS)} FROM m")
def calibration_metrics(spark, d):
    return rounded(fc.metrics(fc.keep_latest(found_pairs(spark, d)), ("model_version",)).select("model_version", "n_point", *METRICS), *METRICS, to=4)


@query(f"""WITH {PAIRS}, r AS (SELECT model_version, mae, 0.7 * mae AS reference_mae, n_point, bias_t, bias, obs_mean FROM m)
SELECT model_version, coalesce(n_point >= 10 AND abs(bias_t) > 1.96 AND abs(bias) > 0.1 * abs(obs_mean), false) AS drift_bias, coalesce(mae > 1.25 * reference_mae, false) AS drift_mae,
coalesce(n_point >= 10 AND abs(bias_t) > 1.96 AND abs(bias) > 0.1 * abs(obs_mean), false) OR coalesce(mae > 1.25 * reference_mae, false) AS drift FROM r""")
def drift_rules(spark, d):
    measured = fc.metrics(fc.keep_latest(found_pairs(spark, d)), ("model_version",)).withColumn("reference_mae", 0.7 * F.col("mae"))
    return fc.drift(measured).select("model_version", "drift_bias", "drift_mae", "drift")


@query(f"""WITH {PAIRS} SELECT 'm1' AS model_name, m.model_version, 'load' AS quantity, m.n_point, round(mae, 4) AS mae, n.n_pairs, n.n_censored, k.n_postdiction FROM m
JOIN (SELECT model_version, count(*) AS n_pairs, count(*) FILTER (censored) AS n_censored FROM kept GROUP BY 1) n USING (model_version)
JOIN (SELECT model_version, count(*) FILTER (NOT genuine) AS n_postdiction FROM pairs GROUP BY 1) k USING (model_version)""")
def calibration_runs(spark, d):
    run = fc.calibration_run(fx.view(spark, d, fx.PRED), fx.view(spark, d, fx.OBS), None, "2001-06-01", known_at="2001-06-01")
    return rounded(run.select("model_name", "model_version", "quantity", "n_point", "mae", "n_pairs", "n_censored", "n_postdiction"), "mae", to=4)


PRED_IDS = f"""p AS ({fx.PRED}), i AS (SELECT *, substr(sha256(geo_level || chr(31) || geoid || chr(31) || target_date || chr(31) || quantity || chr(31) || model_version), 1, 32) AS id FROM p)"""


@query(f"""WITH {PRED_IDS} SELECT id AS prediction_id, prediction_id AS seq, round(value, 5) AS value FROM i WHERE id NOT IN (SELECT id FROM i WHERE target_date < DATE '1996-01-01')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY issued_at DESC, prediction_id DESC) = 1""")
def prediction_ids(spark, d):
    p = fx.view(spark, d, fx.PRED).withColumnRenamed("prediction_id", "seq").withColumn("prediction_id", stable_id(*[F.col(c) for c in (*fc.TARGET, "model_version")]))
    log = p.where(F.col("target_date") < F.lit("1996-01-01").cast("date"))
    return rounded(fc.append_new(log, p, "prediction_id", ("issued_at", "seq")).select("prediction_id", "seq", "value"), "value", to=5)


@query(f"""WITH r AS ({fx.OBS_ROWS}), a AS (SELECT * FROM r WHERE seq % 3 > 0 QUALIFY row_number() OVER (PARTITION BY geoid, target_date ORDER BY seq DESC) = 1),
b AS (SELECT * FROM r WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY geoid, target_date ORDER BY seq DESC) = 1)
SELECT b.geoid, b.target_date, round(b.value, 5) AS value, b.censored, CASE WHEN a.geoid IS NULL THEN 0 ELSE 1 END AS revision FROM b LEFT JOIN a USING (geoid, target_date)
WHERE a.geoid IS NULL OR a.value IS DISTINCT FROM b.value OR a.censored IS DISTINCT FROM b.censored""")
def observations_upsert(spark, d):
    rows = fx.view(spark, d, fx.OBS_ROWS)
    empty = rows.where("false").withColumn("revision", F.lit(0))
    stored = fc.new_observations(empty, rows.where("seq % 3 > 0"))
    return rounded(fc.new_observations(stored, rows.where("seq % 3 = 0")).select("geoid", "target_date", "value", "censored", F.col("revision").cast("int").alias("revision")), "value", to=5)


@query(f"WITH p AS ({fx.PRED}) SELECT geoid, target_date, round(value, 5) AS value FROM p WHERE target_date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND issued_at < TIMESTAMP '1996-06-01'")
def prediction_log_query(spark, d):
    return rounded(fc.get(fx.view(spark, d, fx.PRED), model_name="m1", target_from="1996-01-01", target_to="1996-06-30", issued_before="1996-06-01").select("geoid", "target_date", "value"), "value", to=5)


def scored(spark, d):
    return fx.view(spark, d, fx.SCORED)


LEVELS = f"""s AS ({fx.SCORED}), v AS (SELECT score_a AS score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY 1),
l AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM v)"""


@query(f"WITH {LEVELS} SELECT round(sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM l")
def auc(spark, d):
    return rounded(st.auc(scored(spark, d), "score_a"), "auc", to=9)


@query(f"WITH {LEVELS} SELECT score AS threshold, round((p - pos_below) / p, 9) AS tpr, round((n - neg_below) / n, 9) AS fpr FROM l")
def roc_points(spark, d):
    return rounded(st.roc(scored(spark, d), "score_a").select("threshold", "tpr", "fpr"), "tpr", "fpr", to=9)


@query(f"WITH {LEVELS} SELECT round(sum((p - pos_below) / ((p - pos_below) + (n - neg_below)) * pos / p), 9) AS average_precision FROM l")
def average_precision(spark, d):
    return rounded(st.average_precision(scored(spark, d), "score_a"), "average_precision", to=9)


@query(f"""WITH s AS ({fx.SCORED}), r AS (SELECT *, sum(1 - y) OVER () AS nn, sum(y) OVER () AS np FROM s),
a AS (SELECT y, nn, np, (sum(1 - y) OVER (ORDER BY score_a) - sum(1 - y) OVER (PARTITION BY score_a) / 2) / nn AS xa, (np - sum(y) OVER (ORDER BY score_a) + sum(y) OVER (PARTITION BY score_a) / 2) / np AS wa,
 (sum(1 - y) OVER (ORDER BY score_b) - sum(1 - y) OVER (PARTITION BY score_b) / 2) / nn AS xb, (np - sum(y) OVER (ORDER BY score_b) + sum(y) OVER (PARTITION BY score_b) / 2) / np AS wb FROM r),
q AS (SELECT avg(xa) FILTER (y = 1) AS auc_a, avg(xb) FILTER (y = 1) AS auc_b, var_samp(xa - xb) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(wa - wb) FILTER (y = 0) / count(*) FILTER (y = 0) AS v FROM a)
SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(auc_a - auc_b, 8) AS diff, round(sqrt(v), 8) AS se, round((auc_a - auc_b) / sqrt(v), 6) AS z, round(auc_a - auc_b - 1.96 * sqrt(v), 8) AS lo, round(auc_a - auc_b + 1.96 * sqrt(v), 8) AS hi FROM q""")
def delong_test(spark, d):
    return rounded(rounded(st.delong(scored(spark, d), "score_a", "score_b").drop("p_value"), "auc_a", "auc_b", "diff", "se", "lo", "hi", to=8), "z")


@query(f"WITH s AS ({fx.SCORED}), p AS (SELECT y, score_a / (score_a + 200000) AS q FROM s) SELECT round(avg((q - y) ** 2), 9) AS brier, round(avg(y), 9) AS prevalence FROM p")
def brier_score(spark, d):
    return rounded(st.brier(scored(spark, d).withColumn("q", F.col("score_a") / (F.col("score_a") + 200000)), "q"), "brier", "prevalence", to=9)


@query(f"WITH s AS ({fx.SCORED}), p AS (SELECT y, score_a / (score_a + 200000) AS q FROM s) SELECT round(sum((y - q) * (1 - 2 * q)) / sqrt(sum((1 - 2 * q) ** 2 * q * (1 - q))), 6) AS z FROM p")
def calibration_z(spark, d):
    return rounded(st.spiegelhalter(scored(spark, d).withColumn("q", F.col("score_a") / (F.col("score_a") + 200000)), "q").select("z"), "z")


@query(f"""WITH s AS ({fx.SCORED}), e AS (SELECT list_sort(list_distinct(quantile_cont(score_a::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM s),
b AS (SELECT s.y, greatest(1, len(list_filter(e.e, lambda v: v < score_a)))::INT AS bin, e.e AS e FROM s, e)
SELECT bin, count(*) AS n, round(avg(y), 9) AS rate, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 9) AS se, round((any_value(e[bin]) + any_value(e[bin + 1])) / 2, 4) AS mid FROM b GROUP BY bin""")
def reliability_curve(spark, d):
    return rounded(rounded(st.reliability(scored(spark, d), "score_a"), "rate", "se", to=9), "mid", to=4)


@query(f"WITH s AS ({fx.SCORED}), r AS (SELECT rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2 AS ra, rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2 AS rb FROM s) SELECT round(corr(ra, rb), 8) AS rho FROM r")
def spearman(spark, d):
    return rounded(st.spearman(scored(spark, d), "score_a", "score_b"), "rho", to=8)


@query(f"""WITH s AS ({fx.SCORED}), v AS (SELECT 'score_a' AS feature, score_a AS v FROM s UNION ALL SELECT 'score_b', score_b FROM s)
SELECT feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS min, round(quantile_cont(v::DOUBLE, 0.5), 4) AS median, max(v) AS max FROM v GROUP BY feature""")
def describe_scores(spark, d):
    return rounded(st.describe(scored(spark, d), ["score_a", "score_b"]), "mean", "sd", "median", to=4)


@query(f"WITH s AS ({fx.SCORED}) SELECT month(valid_date)::INT AS month, round(avg(y), 9) AS prevalence, count(*) AS n FROM s GROUP BY 1")
def prevalence_by_month(spark, d):
    return rounded(pn.prevalence(scored(spark, d), F.month("valid_date").alias("month")), "prevalence", to=9)


@query(f"WITH s AS ({fx.SCORED}) SELECT grp, round(avg(y), 9) AS prevalence, count(*) AS n FROM s GROUP BY 1")
def prevalence_by_unit(spark, d):
    return rounded(pn.prevalence(scored(spark, d), "grp"), "prevalence", to=9)


@query(f"WITH s AS ({fx.SCORED}) SELECT y::INT AS y, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY y")
def class_balance(spark, d):
    return rounded(pn.class_balance(scored(spark, d)), "share", to=9)


@query(f"""WITH s AS ({fx.SCORED}), m AS (SELECT grp AS block, 'a' AS model, avg(score_a) AS score FROM s GROUP BY grp UNION ALL SELECT grp, 'b', avg(score_b) * 100 FROM s GROUP BY grp UNION ALL SELECT grp, 'c', avg(y) * 100000 FROM s GROUP BY grp),
r AS (SELECT model, rank() OVER (PARTITION BY block ORDER BY score DESC) + (count(*) OVER (PARTITION BY block, score) - 1) / 2 AS r FROM m), k AS (SELECT model, avg(r) AS r, count(*) AS n FROM r GROUP BY model)
SELECT models, blocks, chi2, round(exp(-chi2 / 2), 6) AS p_value, round(2.343 * sqrt(3 * 4 / (6 * blocks)), 6) AS critical_difference FROM (SELECT count(*)::INT AS models, max(n)::INT AS blocks, round(12 * max(n) / (count(*) * (count(*) + 1)) * (sum(r ** 2) - count(*) * (count(*) + 1) ** 2 / 4), 6) AS chi2 FROM k)""")
def friedman_test(spark, d):
    g = scored(spark, d).groupBy(F.col("grp").alias("block")).agg(F.avg("score_a").alias("a"), (F.avg("score_b") * 100).alias("b"), (F.avg("y") * 100000).alias("c"))
    out = rounded(st.friedman(g.unpivot("block", ["a", "b", "c"], "model", "score")), "chi2", "critical_difference")
    return rounded(out, "p_value", to=6)


@query(f"""WITH s AS ({fx.SCORED}), d AS (SELECT valid_date AS day, avg(score_a / 1000 - score_b) AS d FROM s GROUP BY 1), n AS (SELECT count(*) AS n, list_max(list_filter(range(1, 200), lambda k: k * k * k <= count(*))) AS lag FROM d),
e AS (SELECT row_number() OVER (ORDER BY day) AS i, d, d - avg(d) OVER () AS e FROM d),
g AS (SELECT h, sum(a.e * b.e) AS s FROM e a, n, (SELECT unnest(range(0, 200)) AS h) h, e b WHERE h <= lag AND b.i = a.i - h GROUP BY h),
v AS (SELECT (SELECT avg(d) FROM d) AS mean, sum(CASE WHEN h = 0 THEN s ELSE 2 * (1 - h / (lag + 1)) * s END) / any_value(n) / any_value(n) AS var, any_value(lag)::INT AS lag FROM g, n) SELECT round(mean, 5) AS mean, round(var, 5) AS var, round(mean / sqrt(var), 5) AS dm FROM v""")
def diebold_mariano(spark, d):
    daily = scored(spark, d).groupBy(F.col("valid_date").alias("day")).agg(F.avg(F.col("score_a") / 1000 - F.col("score_b")).alias("d"))
    return rounded(st.diebold_mariano(daily).select("mean", "var", "dm"), "mean", "var", "dm", to=5)


@query(f"""WITH s AS ({fx.SCORED}), p AS (SELECT grp AS name, 1 / (1 + count(*) + sum(y)) AS p FROM s GROUP BY grp), x AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS x FROM p), a AS (SELECT name, p, max(x) OVER (ORDER BY p, name) AS q FROM x)
SELECT name, round(p, 9) AS p, round(q, 9) AS p_adjusted, q <= 0.05 AS reject FROM a""")
def holm_adjusted(spark, d):
    p = scored(spark, d).groupBy(F.col("grp").alias("name")).agg((1 / (1 + F.count(F.lit(1)) + F.sum("y"))).alias("p"))
    return rounded(st.holm(p), "p", "p_adjusted", to=9)


@query()
def bootstrap_interval(spark, d):
    return st.block_bootstrap(scored(spark, d).withColumn("q", F.col("score_a") / (F.col("score_a") + 200000)), "q", "y", "grp")


LAST = f"x AS ({fx.DAILY}), r AS (SELECT *, row_number() OVER (PARTITION BY geoid ORDER BY valid_date DESC) <= 30 AS inside FROM x)"


@query(f"WITH {LAST} SELECT geoid, valid_date, round(tmmx + CASE WHEN inside THEN 3 ELSE 0 END, 6) AS tmmx, round(tmmn + CASE WHEN inside THEN 1.5 ELSE 0 END, 6) AS tmmn, CASE WHEN inside THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS scn_heatwave_days, 1.0::DOUBLE AS scn_early_season FROM r")
def scenario_heatwave(spark, d):
    return rounded(sc.heatwave(30, delta_c=3.0, delta_tmin_c=1.5, early=True).apply(fx.view(spark, d, fx.DAILY)).select("geoid", "valid_date", "tmmx", "tmmn", "scn_heatwave_days", "scn_early_season"), "tmmx", "tmmn")


@query(f"WITH {LAST}, t AS (SELECT geoid, quantile_cont(tmmx::DOUBLE, 0.95) AS top FROM x GROUP BY geoid) SELECT geoid, valid_date, round(CASE WHEN inside THEN greatest(tmmx, top) ELSE tmmx END, 6) AS tmmx, round(tmmn + CASE WHEN inside THEN 2 ELSE 0 END, 6) AS tmmn FROM r JOIN t USING (geoid)")
def scenario_heatwave_percentile(spark, d):
    return rounded(sc.heatwave(30, local_pct=95, delta_tmin_c=2.0).apply(fx.view(spark, d, fx.DAILY)).select("geoid", "valid_date", "tmmx", "tmmn"), "tmmx", "tmmn")


@query(f"WITH x AS ({fx.DAILY}), m AS (SELECT geoid, median(tmmx::DOUBLE) AS m FROM x GROUP BY geoid) SELECT geoid, valid_date, e AS eps, round(m + (tmmx - m) * (1 - e), 6) AS tmmx FROM x JOIN m USING (geoid), (VALUES (0.0::DOUBLE), (0.15::DOUBLE), (0.3::DOUBLE)) v(e)")
def scenario_cooling_sweep(spark, d):
    return rounded(sc.cooling_sweep(fx.view(spark, d, fx.DAILY), [0.0, 0.15, 0.3]).select("geoid", "valid_date", "eps", "tmmx"), "tmmx")


def chain():
    return sc.heatwave(30, delta_c=3.0) | sc.blackout(0.2, 12.0, 10)


CHAIN = f"""{LAST}, b AS (SELECT *, {OUT} FROM r), w AS (SELECT geoid, valid_date, tmmx, outage_customers_frac AS f, tmmx + CASE WHEN inside THEN 3 ELSE 0 END AS tmmx2,
 CASE WHEN row_number() OVER (PARTITION BY geoid ORDER BY valid_date DESC) <= 10 THEN greatest(outage_customers_frac, 0.2) ELSE outage_customers_frac END AS f2 FROM b)"""


@query(f"WITH {CHAIN} SELECT geoid, valid_date, 'tmmx' AS variable, round(tmmx, 6) AS base, round(tmmx2, 6) AS new FROM w WHERE tmmx IS DISTINCT FROM tmmx2 UNION ALL SELECT geoid, valid_date, 'outage_customers_frac', round(f, 6), round(f2, 6) FROM w WHERE f IS DISTINCT FROM f2")
def scenario_diff(spark, d):
    x = exposed(spark, d)
    return rounded(sc.diff(x, chain().apply(x), ["tmmx", "outage_customers_frac"]), "base", "new")


@query(f"WITH {CHAIN}, a AS (SELECT avg(tmmx) AS b, avg(tmmx2) AS t, max(tmmx2) AS mx, avg(f2) AS o FROM w), q AS (SELECT *, greatest(1, 1 + greatest(0, t - 35) * 0.18 + o * 4.5) AS rr FROM a) SELECT round(b, 6) AS base_tmax_mean, round(t, 6) AS new_tmax_mean, round(mx, 6) AS new_tmax_max, round(rr, 3) AS relative_risk, t >= 37 AND o >= 0.05 AS compound_flag FROM q")
def scenario_risk(spark, d):
    x = exposed(spark, d)
    return rounded(sc.risk_summary(x, chain().apply(x)).select("base_tmax_mean", "new_tmax_mean", "new_tmax_max", "relative_risk", "compound_flag"), "base_tmax_mean", "new_tmax_mean", "new_tmax_max")


#: requests written from orders; what each asks for is known from the order alone
_ASKED = """SELECT o_orderkey AS id, o_orderkey % 4 AS kind, o_custkey % 8 + 2 AS days, o_custkey % 5 + 1 AS degrees, o_custkey % 6 + 90 AS pct, CASE WHEN o_custkey % 2 = 0 THEN 20 ELSE 35 END AS share,
CASE WHEN o_custkey % 3 = 0 THEN 10 ELSE 14 END AS hours FROM orders"""


@query(f"""WITH a AS ({_ASKED}) SELECT id, CASE kind WHEN 1 THEN '48' WHEN 2 THEN '06' ELSE '04' END AS geoids, 'state' AS geo_level, '2023-06-01' AS valid_from, '2023-08-31' AS valid_to,
CASE kind WHEN 0 THEN days WHEN 1 THEN days ELSE 0 END::INT AS heatwave_days, CASE kind WHEN 0 THEN degrees::DOUBLE + 0.5::DOUBLE END AS heatwave_delta_c, CASE kind WHEN 1 THEN pct::DOUBLE END AS heatwave_percentile,
CASE kind WHEN 1 THEN share / 100.0::DOUBLE WHEN 2 THEN share / 100.0::DOUBLE ELSE 0::DOUBLE END AS blackout_frac, CASE kind WHEN 1 THEN hours::DOUBLE WHEN 2 THEN 12::DOUBLE ELSE 0::DOUBLE END AS blackout_hours, CASE kind WHEN 1 THEN days ELSE 1 END::INT AS blackout_days,
CASE kind WHEN 2 THEN share / 100.0::DOUBLE ELSE 0::DOUBLE END AS cooling_epsilon FROM a""")
def scenario_requests(spark, d):
    """All parameters of requests of four kinds."""
    a = spark.sql(_ASKED.replace("FROM orders", f"FROM parquet.`{d}/orders.parquet`"))
    n = {c: F.col(c).cast("string") for c in ("days", "degrees", "pct", "share", "hours")}
    text = F.when(F.col("kind") == 0, F.concat(F.lit("Ola de calor de "), n["days"], F.lit(" días en Arizona con +"), n["degrees"], F.lit(".5°C")))
    text = text.when(F.col("kind") == 1, F.concat(F.lit("Heatwave p"), n["pct"], F.lit(", "), n["share"], F.lit("% sin luz "), n["hours"], F.lit(" horas; apagón de "), n["days"], F.lit(" días en Texas")))
    text = text.when(F.col("kind") == 2, F.concat(F.lit("centro de enfriamiento del "), n["share"], F.lit(" % en California"))).otherwise(F.lit("nada"))
    got = sc.extract_params(a.select("id", text.alias("text")), "text", "2023-06-01", "2023-08-31")
    names = ("heatwave_days", "heatwave_delta_c", "heatwave_percentile", "blackout_frac", "blackout_hours", "blackout_days", "cooling_epsilon")
    return got.select("id", F.array_join("geoids", ",").alias("geoids"), "geo_level", *[day(c).alias(c) for c in ("valid_from", "valid_to")], *names)


@query(f"WITH x AS ({fx.DAILY}) SELECT year(valid_date)::INT AS year, count(*) AS n, round(min(tmmx), 6) AS low, round(max(tmmx), 6) AS high, round(median(tmmx::DOUBLE), 6) AS middle, round(max(tmmx) / min(tmmx), 6) AS ratio FROM x GROUP BY 1")
def coverage_by_year(spark, d):
    return rounded(rp.coverage_by_year(fx.view(spark, d, fx.DAILY), "tmmx"), "low", "high", "middle", "ratio")


@query(f"WITH {FACTS} SELECT count(*) FILTER (variable = 'tmmx') AS n_tmmx, count(*) FILTER (variable = 'rmin') AS n_rmin, count(*) FILTER (revision > 0) AS n_revised FROM facts")
def layer_status(spark, d):
    return rp.status(facts(spark, d), {"n_tmmx": "variable = 'tmmx'", "n_rmin": "variable = 'rmin'", "n_revised": "revision > 0"})


@query(f"WITH {HOT}, e AS (SELECT *, {OUT} FROM s) SELECT geoid, valid_date, round(outage_customers_frac, 9) AS frac FROM e WHERE hot = 1 AND outage_customers_frac >= 0.05 AND outage_max_hours >= 1 ORDER BY outage_customers_frac DESC, geoid, valid_date LIMIT 25")
def top_compound_days(spark, d):
    return rounded(rp.top_compound_days(flags(spark, d), "outage_customers_frac").select("geoid", "valid_date", F.col("outage_customers_frac").alias("frac")), "frac", to=9)


@query(f"""WITH {LEVELS}, x AS (SELECT *, (neg_below + neg / 2) / n AS x, (p - pos_below - pos / 2) / p AS w FROM l), m AS (SELECT sum(pos * x) / sum(pos) AS auc, sum(neg * w) / sum(neg) AS mw FROM x),
e AS (SELECT auc, sqrt(sum(pos * (x - auc) ** 2) / (max(p) - 1) / max(p) + sum(neg * (w - mw) ** 2) / (max(n) - 1) / max(n)) AS se FROM x, m GROUP BY auc)
SELECT round(auc, 9) AS auc, round(se, 9) AS se, round(greatest(0, auc - 1.959963984540054 * se), 9) AS lo, round(least(1, auc + 1.959963984540054 * se), 9) AS hi FROM e""")
def delong_interval(spark, d):
    return rounded(st.delong_ci(scored(spark, d), "score_a"), "auc", "se", "lo", "hi", to=9)


@query(f"""WITH s AS ({fx.SCORED}), v AS (SELECT year(valid_date)::INT AS year, score_a, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2), l AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY year ORDER BY score_a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT year, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM l GROUP BY year""")
def auc_by_year(spark, d):
    return rounded(st.auc(scored(spark, d).withColumn("year", F.year("valid_date")), "score_a", by=("year",)), "auc", to=9)


@query(f"""WITH s AS ({fx.SCORED}), r AS (SELECT grp, y, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2 AS r, row_number() OVER (PARTITION BY grp ORDER BY valid_date, id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS m FROM s),
o AS (SELECT grp, rep, CASE WHEN m > 1 THEN 1 + ('0x' || substr(md5('0:' || rep || ':' || grp), 1, 8))::BIGINT % (m - 1) ELSE 0 END AS off FROM (SELECT DISTINCT grp, m FROM r) g, (SELECT unnest(range(1, 21)) AS rep) t),
t AS (SELECT o.rep, sum(q.r) AS s FROM r JOIN o USING (grp) JOIN r q ON q.grp = r.grp AND q.i = (r.i - o.off + r.m) % r.m WHERE r.y = 1 GROUP BY o.rep), c AS (SELECT sum(y) AS p, sum(1 - y) AS n, sum(r) FILTER (y = 1) AS o FROM r)
SELECT round((any_value(o) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)), 9) AS auc, round((count(*) FILTER (s >= o - 1e-6) + 1) / (count(*) + 1), 9) AS p_value, count(*) AS replicates FROM t, c""")
def circular_permutation(spark, d):
    return rounded(st.circular_permutation(scored(spark, d), "score_a", "grp", ["valid_date", "id"], n=20), "auc", "p_value", to=9)


_PRICED = ("l_quantity", "l_extendedprice", "l_discount")
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _PRICED)


@query(f"WITH r AS (SELECT {_RANKS} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS rho FROM r" for i, a in enumerate(_PRICED) for b in _PRICED[i + 1 :]))
def spearman_pairs(spark, d):
    return rounded(st.spearman_pairs(spark.read.parquet(f"{d}/lineitem.parquet"), list(_PRICED)), "rho", to=9)


@query(f"WITH x AS ({fx.SCORED}), b AS (SELECT *, median(score_a::DOUBLE) OVER () AS m FROM x WHERE score_b BETWEEN 100 AND 900) SELECT round(avg(y) FILTER (score_a <= m), 9) AS low, round(avg(y) FILTER (score_a > m), 9) AS high, count(*) AS n, round(avg(y) FILTER (score_a > m) - avg(y) FILTER (score_a <= m), 9) AS difference FROM b")
def band_contrast(spark, d):
    return rounded(ex.band_contrast(scored(spark, d), "y", "score_b", "score_a", 100, 900), "low", "high", "difference", to=9)


@query(f"""WITH {FACTS}, a AS (SELECT source, count(*) AS files, sum(n)::BIGINT AS bytes, strftime(max(known_at), '%Y-%m-%d') AS latest FROM (SELECT source, known_at, count(*) * 8 AS n FROM reports GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT source, count(*) AS facts, count(DISTINCT geoid) AS units, min(valid_date)::DATE::VARCHAR || ' / ' || max(valid_date)::DATE::VARCHAR AS days FROM facts GROUP BY 1) SELECT * FROM f LEFT JOIN a USING (source)""")
def provenance(spark, d):
    files = fx.view(spark, d, fx.REPORTS).groupBy("source", F.col("known_at").alias("fetched_at")).agg((F.count(F.lit(1)) * 8).alias("n_bytes"))
    return rp.provenance(files, facts(spark, d))


@query(f"WITH x AS ({fx.DAILY}) SELECT count(DISTINCT valid_date)::INT AS n_days, min(valid_date)::DATE::VARCHAR AS first_day, string_agg(DISTINCT year(valid_date)::VARCHAR, ',' ORDER BY year(valid_date)::VARCHAR) AS years FROM x")
def report_axes(spark, d):
    return rp.axes(fx.view(spark, d, fx.DAILY)).select(F.size("days").alias("n_days"), F.element_at("days", 1).alias("first_day"), F.concat_ws(",", F.col("years").cast("array<string>")).alias("years"))


@query(f"""WITH p AS ({fx.PRED}), q AS (SELECT *, CASE WHEN prediction_id % 3 = 0 THEN 'p' ELSE 's' || prediction_id % 3 END AS series FROM p),
l AS (SELECT geoid, target_date, series, value FROM q QUALIFY row_number() OVER (PARTITION BY geoid, target_date, series ORDER BY issued_at DESC, prediction_id DESC) = 1),
o AS ({fx.OBS}), r AS (SELECT * FROM l UNION ALL SELECT geoid, target_date, 'y', value FROM o WHERE (geoid, target_date) IN (SELECT (geoid, target_date) FROM l)),
days AS (SELECT target_date, row_number() OVER (ORDER BY target_date) - 1 AS pos FROM (SELECT DISTINCT target_date FROM l))
SELECT g.geoid, g.series, d.pos::INT AS pos, round(r.value, 6) AS value FROM (SELECT DISTINCT geoid, series FROM r) g CROSS JOIN days d LEFT JOIN r ON r.geoid = g.geoid AND r.series = g.series AND r.target_date = d.target_date""")
def risk_arrays(spark, d):
    k = F.col("prediction_id") % 3
    p = fx.view(spark, d, fx.PRED).withColumn("scenario_id", F.when(k != 0, F.concat(F.lit("s"), k.cast("string"))))
    a = rp.risk_arrays(p, fx.view(spark, d, fx.OBS).select("geoid", "target_date", "value"), digits=6)  # prices in thousands have five digits, so none is a tie
    return rounded(a.select("geoid", "series", F.posexplode("values").alias("pos", "value")), "value")


@query()
def model_fold_scores(spark, d):
    panel = scored(spark, d).withColumn("year", F.year("valid_date")).withColumn("month", F.month("valid_date").cast("double"))
    panel = written(panel, "panel")  # every fit and score reads it
    specs = md.ladder(["score_a", "score_b", "month"], "score_a", trees=20, rounds=10)
    return md.fold_scores(written(md.train(panel, specs, md.outer_folds(panel), ["id"], group="grp", inner=2, n=2).oof, "out_of_fold"))


_OOF = f"""oof AS (SELECT id, y, year(valid_date)::VARCHAR AS fold, 'a' AS model, score_a / 600000 AS p FROM ({fx.SCORED}) UNION ALL SELECT id, y, year(valid_date)::VARCHAR, 'b', score_b / 20000 FROM ({fx.SCORED})),
lv AS (SELECT fold, model, p, sum(y) AS pos, sum(1 - y) AS neg FROM oof GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w - pos AS pos_below, sum(neg) OVER w - neg AS neg_below, sum(pos) OVER g AS all_pos, sum(neg) OVER g AS all_neg FROM lv WINDOW w AS (PARTITION BY fold, model ORDER BY p), g AS (PARTITION BY fold, model)),
ranked AS (SELECT fold, model, any_value(all_pos)::BIGINT AS n_pos, any_value(all_neg)::BIGINT AS n_neg, CASE WHEN any_value(all_pos) * any_value(all_neg) > 0 THEN sum(pos * (neg_below + neg / 2.0)) / any_value(all_pos * all_neg) END AS auc,
  sum((all_pos - pos_below) / (all_pos - pos_below + all_neg - neg_below) * pos / nullif(all_pos, 0)) AS average_precision FROM cum GROUP BY ALL),
scores AS (SELECT r.*, avg((p - y) ** 2) AS brier, avg(y) AS prevalence FROM ranked r JOIN oof USING (fold, model) GROUP BY ALL)"""


def fold_rows(spark, d):
    """Out-of-fold rows of two given scores, a fold a year."""
    x, fold = scored(spark, d), F.year("valid_date").cast("string").alias("fold")
    a, b = (x.select("id", "y", fold, F.lit(n).alias("model"), (F.col(f"score_{n}") / k).alias("p")) for n, k in (("a", 600000), ("b", 20000)))
    return a.unionByName(b)


@query(f"WITH {_OOF} SELECT fold, model, n_pos, n_neg, round(auc, 9) AS auc, round(average_precision, 9) AS average_precision, round(brier, 9) AS brier, round(prevalence, 9) AS prevalence FROM scores")
def fold_scores(spark, d):
    return rounded(md.fold_scores(written(fold_rows(spark, d), "out_of_fold")), "auc", "average_precision", "brier", "prevalence", to=9)


@query(f"WITH {_OOF}, v AS (SELECT model, fold, round(auc, 9) AS auc FROM scores WHERE auc IS NOT NULL) SELECT model, arg_max(fold, auc ORDER BY fold) AS best, max(auc) AS best_value, arg_min(fold, auc ORDER BY fold) AS worst, min(auc) AS worst_value FROM v GROUP BY model")
def fold_extremes(spark, d):
    return md.fold_extremes(fold_scores(spark, d))


@query(f"""WITH x AS ({fx.SCORED}), f AS (SELECT year(valid_date) AS k FROM x GROUP BY 1 QUALIFY row_number() OVER (ORDER BY year(valid_date)) > 1)
SELECT k::VARCHAR AS fold, count(*) FILTER (year(valid_date) < k) AS n_train, count(*) FILTER (year(valid_date) = k) AS n_test FROM f, x GROUP BY k""")
def outer_folds(spark, d):
    panel = scored(spark, d).withColumn("year", F.year("valid_date"))
    folds = md.outer_folds(panel)
    sizes = panel.agg(*[F.struct(F.lit(f.name).alias("fold"), F.count_if(f.train).alias("n_train"), F.count_if(f.test).alias("n_test")).alias(f"f{i}") for i, f in enumerate(folds)])
    return sizes.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(folds))])))


@query(f"""WITH x AS ({fx.SCORED}), c AS (SELECT make_date(max(year(valid_date)), 8, 1) AS c FROM x) SELECT c::VARCHAR AS fold, count(*) FILTER (valid_date < c) AS n_train, count(*) FILTER (valid_date >= c + 7) AS n_test FROM x, c GROUP BY c""")
def temporal_fold(spark, d):
    x = scored(spark, d)
    fold = md.temporal_fold(x)
    return x.agg(F.count_if(fold.train).alias("n_train"), F.count_if(fold.test).alias("n_test")).select(F.lit(fold.name).alias("fold"), "n_train", "n_test")


@query(f"WITH x AS ({fx.SCORED}), n AS (SELECT grp, count(*) AS n FROM x GROUP BY 1) SELECT count(DISTINCT grp) AS groups, sum(n)::BIGINT AS n_rows, true AS apart, true AS even FROM n")
def group_folds(spark, d):
    """Whole groups, and folds whose sizes differ by no more than the largest group."""
    dealt, k = md.group_folds(scored(spark, d), "grp", 3)
    groups = dealt.groupBy("grp").agg(F.count_distinct("fold_").alias("f"), F.count(F.lit(1)).alias("n"), F.first("fold_").alias("fold"))
    folds = groups.groupBy("fold").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest"), F.max("f").alias("f"))
    return folds.agg(F.sum("groups").alias("groups"), F.sum("size").alias("n_rows"), (F.max("f") == 1).alias("apart"), ((F.max("size") - F.min("size") <= F.max("largest")) & (F.count(F.lit(1)) == k)).alias("even"))


@query()
def shapley_importance(spark, d):
    x = scored(spark, d)
    odds = F.col("score_a") / 100000 - F.col("score_b") / 1000 + F.col("score_a") * F.col("score_b") / 1e8
    score = lambda df: df.withColumn("p", 1 / (1 + F.exp(-odds)))
    return ex.global_importance(ex.permutation_shapley(score, x, x, ["score_a", "score_b"], "id"))


@query()
def circular_permutation_whole(spark, d):
    """The default of 500 replicates, of which circular_permutation compares 20 with SQL."""
    return st.circular_permutation(scored(spark, d), "score_a", "grp", ["valid_date", "id"])


@query(f"WITH x AS ({fx.SCORED}) SELECT year(valid_date)::INT AS year, round(avg((score_a / 600000 - y) ** 2), 9) AS value FROM x GROUP BY 1")
def metric_by_year(spark, d):
    """A metric given as a vector of sums."""
    x = scored(spark, d).select(F.year("valid_date").alias("year"), "y", (F.col("score_a") / 600000).alias("p"))
    return rounded(rs.metric_by(x, "p", "y", rs.BRIER, ["year"]), "value", to=9)


@query()
def bootstrap_auc(spark, d):
    """Interval of the AUC over 500 replicates of resampled nations, read once."""
    return rs.block_bootstrap(scored(spark, d), "score_a", "y", "grp", metric="auc")


@query()
def permutation_importance(spark, d):
    """Fall of the AUC of a fitted model when a feature is moved around, all features and repeats in one scan."""
    x = written(scored(spark, d).withColumn("month", F.month("valid_date").cast("double")), "panel")
    model = md.fit(md.ladder(["score_a", "score_b", "month"], "score_a")[1], x)
    return ex.permutation_importance(lambda df: md.score(model, df), x, ["score_a", "score_b", "month"], "id", 3)


def fact_table(spark, d):
    """The reports' facts in a stored table: what was known by the middle of the time in bulk, the rest by two upserts."""
    reports, path = fx.view(spark, d, fx.REPORTS), new_path(spark, "facts")
    table = ft.FactTable(spark, "facts_" + path[-12:], path, 8).open()
    border = [F.lit(x).cast("timestamp") for x in ("1995-06-01", "1997-01-01")]
    table.create(bt.history_from_reports(reports.where(F.col("known_at") <= border[0])))
    table.upsert(reports.where((F.col("known_at") > border[0]) & (F.col("known_at") <= border[1])))
    table.upsert(reports.where(F.col("known_at") > border[1]))
    return table


@query(ORACLES["facts_as_of"])
def facts_table_as_of(spark, d):
    return fact_table(spark, d).as_of(T).select(*bt.KEY, "value", "revision")


@query(f"WITH {FACTS} SELECT {KEY}, value, strftime(known_at, '%Y-%m-%d') AS known_at, strftime(lead(known_at) OVER (PARTITION BY {KEY} ORDER BY revision), '%Y-%m-%d') AS superseded_at, revision FROM facts")
def facts_intervals(spark, d):
    return fact_table(spark, d).rows().select(*bt.KEY, "value", day().alias("known_at"), day("superseded_at").alias("superseded_at"), "revision")


@query(f"""WITH {FACTS}, p AS (SELECT o_orderkey AS id, concat('0', (o_custkey % 5)::VARCHAR) AS geoid, o_orderdate::DATE AS valid_date, o_orderdate::TIMESTAMP + INTERVAL 4 DAY AS at FROM orders)
SELECT p.id, f.geoid, f.valid_date, f.variable, f.value, f.revision FROM p JOIN facts f ON f.geoid = p.geoid AND f.valid_date = p.valid_date AND f.known_at <= p.at
QUALIFY row_number() OVER (PARTITION BY p.id, f.geoid, f.valid_date, f.variable, f.source ORDER BY f.revision DESC) = 1""")
def facts_as_of_each(spark, d):
    """What each order's unit and day were known to be four days after the order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    points = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("0"), (F.col("o_custkey") % 5).cast("string")).alias("geoid"), F.col("o_orderdate").cast("date").alias("valid_date"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 4 DAYS")).alias("at"))
    rows = ft.intervals(facts(spark, d))
    return ft.as_of_join(points, rows, ["geoid", "valid_date"], "at").select("id", "geoid", "valid_date", "variable", "value", "revision")


#: rows that a file of a micro-batch holds about
FILE_ROWS = 1_000_000


def micro_batches(spark, df, part, parts):
    """A stream over df whose micro-batches are the rows of each value of `part`, in order: each is the same number of files."""
    path = new_path(spark, "stream")
    df = written(df.withColumn("part_", part), "stream_rows")
    files = max(1, -(-df.count() // (FILE_ROWS * parts)))
    for k in range(parts):
        rows = df.where(F.col("part_") == k).drop("part_")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
        for _ in range(count_files(spark, path), files * (k + 1)):  # a part of few rows leaves files out
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part_").schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(spark, stream, conf=None):
    """All rows that a stream gives for what there is now."""
    out, before = new_path(spark, "drained"), {k: spark.conf.get(k) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)


@query(f"WITH {HOT} SELECT geoid, valid_date, hot_streak FROM s")
def stream_hot_streak(spark, d):
    """Days in three micro-batches, every fourth up to five days late; a last one lets the watermark pass them all."""
    days = hot_days(spark, d).select("geoid", "valid_date", "hot")
    end = spark.range(1).select(F.lit("~").alias("geoid"), F.lit("2200-01-01").cast("date").alias("valid_date"), F.lit(1.0).alias("hot"))
    turn = F.unix_date("valid_date") + F.when(F.dayofmonth("valid_date") % 4 == 0, 5).otherwise(0)
    border = [F.unix_date(F.lit(x).cast("date")) for x in ("1994-06-01", "1996-06-01")]
    part = F.when(F.col("geoid") == "~", 3).when(turn > border[1], 2).when(turn > border[0], 1).otherwise(0)
    return drained(spark, jobs.ordered_streaks(micro_batches(spark, days.unionByName(end), part, 4)), jobs.ROCKSDB)


@query(ORACLES["facts_as_of"])
def stream_facts(spark, d):
    """The reports as a stream of three micro-batches, a tenth of them delivered twice, into a fact table."""
    reports = fx.view(spark, d, fx.REPORTS)
    twice = reports.unionByName(reports.where(F.col("seq") % 10 == 0))
    part = F.when(F.col("known_at") > F.lit("1997-01-01").cast("timestamp"), 2).when(F.col("known_at") > F.lit("1995-01-01").cast("timestamp"), 1).otherwise(0)
    path = new_path(spark, "facts")
    table = ft.FactTable(spark, "streamed_" + path[-12:], path, 8).open()
    stream = jobs.fresh_reports(micro_batches(spark, twice, part, 3), "3650 days")
    q = stream.writeStream.foreachBatch(jobs.store_batches(table, new_path(spark, "ledger"))).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.as_of(T).select(*bt.KEY, "value", "revision")


@query(ORACLES["calibration_metrics"])
def stream_metrics(spark, d):
    """The metrics over all pairs, from moments that three micro-batches of pairs left."""
    pairs = fc.keep_latest(found_pairs(spark, d))
    stream = micro_batches(spark, pairs, F.pmod(F.xxhash64("prediction_id"), F.lit(3)), 3)
    path, by = new_path(spark, "moments"), ("model_version",)
    q = stream.writeStream.foreachBatch(jobs.drift_moments(path, new_path(spark, "runs"), by)).option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(path)
    whole = fc.metrics_of(last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]), by)
    return rounded(whole.select("model_version", "n_point", *METRICS), *METRICS, to=4)
