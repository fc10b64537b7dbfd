"""Queries over landed files: the driver's tables are written in the sources' formats and read back by their readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinframe import fixtures as fx
from twinframe.functions.stages import new_path
from twinframe.operators import bitemporal as bt
from twinframe.operators import explain as ex
from twinframe.operators import panel as pn
from twinframe.plans.queries import query, rounded
from twinframe.sources import files

KELVIN = (0.1, 220.0, 32767.0)  # scale, offset and fill of the packed grid


def outage_files(spark, d):
    """Outages in two folders of CSV files, of other headers and time formats."""
    x, paths = fx.view(spark, d, fx.OUTAGE), [new_path(spark, "outages") for _ in range(2)]
    odd = F.substring("geoid", 5, 1).cast("int") % 2
    fips, out = F.col("geoid").cast("int").cast("string").alias("fips_code"), F.col("customers_out").cast("string").alias("customers_out")
    first = x.where(odd == 0).select(fips, F.lit("c").alias("county"), F.lit("AZ").alias("state"), out, F.date_format("ts_utc", "yyyy-MM-dd HH:mm:ss").alias("run_start_time"))
    second = x.where(odd == 1).select(F.date_format("ts_utc", "M/d/yyyy H:mm").alias("run_start_time"), out, F.lit("AZ").alias("state"), fips)
    for df, path in zip((first, second), paths, strict=True):
        df.write.option("header", True).csv(path)
    return paths


@query(f"WITH x AS ({fx.OUTAGE}) SELECT geoid, strftime(ts_utc, '%Y-%m-%d %H:%M') AS ts_utc, customers_out FROM x")
def landed_outages(spark, d):
    return files.outage_csv(spark, outage_files(spark, d)).select("geoid", F.date_format("ts_utc", "yyyy-MM-dd HH:mm").alias("ts_utc"), "customers_out")


@query(f"WITH x AS ({fx.OUTAGE}) SELECT strftime(min(ts_utc), '%Y-%m-%d %H:%M') AS first_utc, strftime(max(ts_utc), '%Y-%m-%d %H:%M') AS last_utc FROM x WHERE geoid LIKE '04%'")
def landed_outage_bounds(spark, d):
    b = files.time_bounds(files.outage_csv(spark, outage_files(spark, d), ["04"]))
    return b.select(*[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("first_utc", "last_utc")])


@query(f"WITH x AS ({fx.OUTAGE}) SELECT geoid, max(customers) AS customers FROM x WHERE substr(geoid, 5, 1)::INT % 3 > 0 GROUP BY geoid")
def landed_customers(spark, d):
    """Denominators; those of every third unit are zero and count as missing."""
    path = new_path(spark, "customers")
    size = F.when(F.substring("geoid", 5, 1).cast("int") % 3 > 0, F.col("customers")).otherwise(0)
    fx.view(spark, d, fx.OUTAGE).groupBy("geoid").agg(F.max("customers").alias("customers")).select(F.col("geoid").cast("int").alias("County_FIPS"), size.alias("Customers")).coalesce(1).write.option("header", True).csv(path)
    return files.customers_csv(spark, path)


@query(f"WITH x AS ({fx.OUTAGE}) SELECT DISTINCT geoid FROM x WHERE substr(geoid, 5, 1)::INT % 3 = 0")
def landed_missing_units(spark, d):
    return files.missing_units(fx.view(spark, d, fx.OUTAGE), landed_customers(spark, d))


_COVERED = "SELECT n_name AS state, year(o_orderdate) AS y, min(o_totalprice) / 1000000 AS lo, max(o_totalprice) / 1000000 AS hi FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) >= 2000 GROUP BY 1, 2"


@query(f"""WITH x AS ({_COVERED}), n AS (SELECT n_name, n_nationkey::VARCHAR AS geoid FROM nation WHERE n_regionkey < 3)
SELECT geoid, y || '-01-01' AS valid_date, unnest(['min_pct_covered', 'max_pct_covered']) AS variable, round(unnest([lo, hi]) * 100, 6) AS value FROM x JOIN n ON n_name = state""")
def landed_coverage(spark, d):
    """Yearly coverage; states that no key is known for are left out."""
    path = new_path(spark, "coverage")
    spark.sql(_COVERED.replace("FROM orders", f"FROM parquet.`{d}/orders.parquet`").replace("JOIN customer", f"JOIN parquet.`{d}/customer.parquet`").replace("JOIN nation", f"JOIN parquet.`{d}/nation.parquet`")).select(
        F.concat(F.lit("1/1/"), F.substring(F.col("y").cast("string"), 3, 2)).alias("year"), "state", F.col("lo").cast("string").alias("min_pct_covered"), F.col("hi").cast("string").alias("max_pct_covered")
    ).write.option("header", True).csv(path)
    states = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 3").select(F.col("n_name").alias("postal"), F.col("n_nationkey").cast("string").alias("geoid"))
    return rounded(files.coverage_csv(spark, path, states).withColumn("valid_date", F.date_format("valid_date", "yyyy-MM-dd")), "value")


_RATES = f"SELECT geoid, year(valid_date) AS y, round(avg(value), 1) AS rate FROM ({fx.CHILD}) GROUP BY 1, 2"


def health_files(spark, d):
    """One JSON document for each nation: yearly rates, every seventh nation's suppressed; every ninth document is an error."""
    path, nation = new_path(spark, "health"), F.col("geoid").cast("int")
    rates = fx.view(spark, d, fx.CHILD).groupBy("geoid", F.year("valid_date").alias("y")).agg(F.round(F.avg("value"), 1).alias("rate"))
    hidden = nation % 7 == 0
    cell = F.struct(F.lpad("geoid", 2, "0").alias("geoId"), F.col("y").cast("string").alias("temporal"), F.lit("Average Rate").alias("calculationType"), F.lit("7").alias("groupById"), F.when(hidden, "").otherwise(F.col("rate").cast("string")).alias("dataValue"), F.when(hidden, "1").otherwise("0").alias("suppressionFlag"))
    docs = rates.groupBy("geoid").agg(F.to_json(F.struct(F.sort_array(F.collect_list(cell)).alias("tableResult"))).alias("value"))
    code = F.when(nation % 2 == 0, 429).otherwise(404)
    error = F.to_json(F.struct(code.alias("code"), F.lit("no data").alias("message")))
    docs.withColumn("value", F.when(nation % 9 == 8, error).otherwise(F.col("value"))).withColumn("doc", F.col("geoid")).select("doc", "value").write.partitionBy("doc").text(path)
    return files.health_json(spark, path)


@query(f"""WITH r AS ({_RATES}) SELECT lpad(geoid, 2, '0') AS geoid, y || '-01-01' AS valid_date, 'm7_average_rate' AS variable, CASE WHEN geoid::INT % 7 > 0 THEN rate END AS value, geoid::INT % 7 = 0 AS censored,
CASE WHEN geoid::INT % 7 = 0 THEN 0.0::DOUBLE END AS censor_lo, CASE WHEN geoid::INT % 7 = 0 THEN 10.0::DOUBLE END AS censor_hi FROM r WHERE geoid::INT % 9 <> 8""")
def landed_health(spark, d):
    cells, _ = health_files(spark, d)
    return cells.drop("file").withColumn("valid_date", F.date_format("valid_date", "yyyy-MM-dd"))


@query(f"WITH n AS (SELECT DISTINCT geoid::INT AS k FROM ({fx.CHILD})) SELECT CASE WHEN k % 2 = 0 THEN 429 ELSE 404 END AS code, 'no data' AS message, k % 2 = 0 AS retryable, count(*) AS n FROM n WHERE k % 9 = 8 GROUP BY ALL")
def landed_health_errors(spark, d):
    _, bad = health_files(spark, d)
    return bad.groupBy("code", "message", "retryable").agg(F.count(F.lit(1)).alias("n"))


def grid_files(spark, d, shift: int):
    """A packed series for each cell in the grid's text form, its values moved by `shift`; and the cells asked for."""
    scale, offset, _ = KELVIN
    raw = F.round((F.col("tmmx") + 273.15 - offset) / scale).cast("int") + shift
    k = F.col("geoid").cast("int")
    days = fx.view(spark, d, fx.DAILY).select("geoid", F.datediff("valid_date", F.lit("1900-01-01").cast("date")).alias("n"), raw.alias("raw"))
    series = days.groupBy("geoid").agg(F.sort_array(F.collect_list(F.struct("n", "raw"))).alias("s")).withColumn("n", F.size("s").cast("string"))
    values = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("][0], "), x["raw"].cast("string"))), "\n")
    text = F.concat(F.lit("v.v["), "n", F.lit("][1][1]\n"), values, F.lit("\n\nv.day["), "n", F.lit("]\n"), F.array_join(F.transform("s", lambda x: x["n"].cast("string")), ", "), F.lit("\n\nv.lat[1]\n"), (40 - k).cast("string"), F.lit("\n\nv.lon[1]\n"), (k - 110).cast("string"))
    path = new_path(spark, "grid")
    series.select(F.col("geoid").alias("doc"), text.alias("value")).write.partitionBy("doc").option("lineSep", "\n").text(path)
    return files.grid_text(spark, path, "v")


@query(f"SELECT 'county' AS geo_level, geoid, strftime(valid_date, '%Y-%m-%d') AS valid_date, 'tmmx' AS variable, round((round((tmmx + 273.15 - 220.0) / 0.1)::INT + 3) * 0.1 + 220.0 - 273.15, 6) AS value FROM ({fx.DAILY})")
def landed_grid(spark, d):
    """Gridded text of two fetches, of which the later counts, unpacked by its attribute text and dealt to the units of its cells."""
    scale, offset, fill = KELVIN
    path = new_path(spark, "packing")
    spark.range(1).select(F.lit(f'v {{\n _FillValue {fill:g};\n units "K";\n scale_factor {scale};\n add_offset {offset:g};\n}}').alias("value")).write.text(path)
    packing = files.packing_text(spark, path).select(F.lit("tmmx").alias("variable"), "scale", "offset", "fill", "units")
    both = grid_files(spark, d, 0).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).unionByName(grid_files(spark, d, 3).withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")))
    cells = lambda df: files.assign_cell(df, 49.0, -124.0, 1.0, 30, 60)
    series = cells(both).withColumn("variable", F.lit("tmmx"))
    k = F.col("geoid").cast("int")
    units = fx.view(spark, d, fx.DAILY).select("geoid").distinct().select("geoid", (40 - k + 0.2).alias("lat"), (k - 110 - 0.3).alias("lon"))
    facts = files.grid_facts(series, cells(units), packing, {"tmmx": "K"})
    return rounded(facts.withColumn("valid_date", F.date_format("valid_date", "yyyy-MM-dd")), "value")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) SELECT lpad(s_nationkey::VARCHAR, 2, '0') || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS geoid, lpad(s_nationkey::VARCHAR, 2, '0') AS state_fips, s_acctbal AS population
FROM s WHERE s_suppkey < 1000 AND s_nationkey IN (4, 7)""")
def landed_centroids(spark, d):
    """Units with their centroids, of two states."""
    path, s = new_path(spark, "centroids"), spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey < 1000")
    s.select(F.col("s_nationkey").alias("STATEFP"), (F.col("s_suppkey") % 1000).alias("COUNTYFP"), F.col("s_name").alias("COUNAME"), F.lit("s").alias("STNAME"), F.col("s_acctbal").alias("POPULATION"), F.lit(33.5).alias("LATITUDE"), F.lit(-112.0).alias("LONGITUDE")).write.option("header", True).csv(path)
    return files.select_units(files.centroids_csv(spark, path), ["4", "07"]).select("geoid", "state_fips", "population")


@query("""WITH f AS (SELECT n_nationkey AS k, n_name || ' ' || n_regionkey || chr(10) AS body FROM nation UNION ALL SELECT 100 + n_nationkey, n_name || ' ' || n_regionkey || chr(10) FROM nation WHERE n_nationkey % 3 = 0)
SELECT DISTINCT sha256(body) AS sha256, md5(body) AS md5, strlen(body) AS length FROM f WHERE k % 100 % 4 > 0""")
def landed_artifacts(spark, d):
    """Contents of files that a catalogue of every fourth doesn't hold yet, each once."""
    path, n = new_path(spark, "artifacts"), spark.read.parquet(f"{d}/nation.parquet")
    body = F.concat("n_name", F.lit(" "), F.col("n_regionkey").cast("string")).alias("value")
    both = n.select(F.col("n_nationkey").alias("doc"), body).unionByName(n.where("n_nationkey % 3 = 0").select((F.col("n_nationkey") + 100).alias("doc"), body))
    both.write.partitionBy("doc").text(path)
    found = files.artifacts(spark, path)
    known = found.where(F.regexp_extract("path", r"doc=(\d+)/", 1).cast("int") % 100 % 4 == 0)
    return files.register(known, found).select("sha256", "md5", F.col("length").cast("long").alias("length"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 = 1")
def landed_unverified(spark, d):
    """Files whose published checksum is another one."""
    path, n = new_path(spark, "artifacts"), spark.read.parquet(f"{d}/nation.parquet")
    n.select(F.col("n_nationkey").alias("doc"), F.col("n_name").alias("value")).write.partitionBy("doc").text(path)
    found = files.artifacts(spark, path)
    k = F.regexp_extract("path", r"doc=(\d+)/", 1).cast("int")
    published = found.select("path", F.when(k % 5 == 1, F.md5(F.col("md5"))).otherwise(F.upper("md5")).alias("md5"))
    return files.verify(found, published).select(k.alias("k"))


@query(f"""WITH x AS (SELECT geoid, valid_date FROM ({fx.DAILY})), n AS (SELECT 2 * count(*) AS n, 2 * count(*) FILTER (valid_date < DATE '1996-01-01') AS old, 2 * count(*) FILTER (valid_date < DATE '1996-01-01' AND geoid = '01') AS moved FROM x)
SELECT n AS received, 0::BIGINT AS collapsed, n - old + moved AS written, moved AS revisions, old - moved AS unchanged FROM n""")
def landed_load(spark, d):
    """Counters of a checked load: new days, and one unit's values changed."""
    x = bt.to_facts(fx.view(spark, d, fx.DAILY), ["geoid", "valid_date"], ["tmmx", "tmmn"]).select(F.lit("county").alias("geo_level"), "geoid", "valid_date", "variable", "value")
    stored = x.where("valid_date < '1996-01-01'").withColumns({"source": F.lit("s"), "known_at": F.lit("2020-01-01").cast("timestamp"), "revision": F.lit(0)})
    rows = bt.coerce(x.withColumn("value", F.col("value") + F.when((F.col("geoid") == "01") & (F.col("valid_date") < "1996-01-01"), 1.0).otherwise(0.0)))
    _, _, counters = files.load(stored, rows, "s", "2024-01-01")
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} long" for k in counters))


@query(f"""WITH c AS ({fx.CHILD}), w AS ({fx.WEIGHTS}), x AS (SELECT parent, valid_date, sum(value * population) / sum(population) AS value FROM c JOIN w USING (geoid) GROUP BY ALL)
SELECT level, count(*) AS n, count(DISTINCT geoid) AS units, round(avg(value), 4) AS mean FROM (SELECT 'county' AS level, geoid, value FROM c UNION ALL SELECT 'state', parent, value FROM x) GROUP BY level""")
def county_and_state_facts(spark, d):
    """Facts of units and of their parents in one table, checked as facts."""
    child = fx.view(spark, d, fx.CHILD)
    both = pn.with_parents(child, fx.view(spark, d, fx.WEIGHTS), "county", "state")
    out = bt.coerce(both).groupBy(F.col("geo_level").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("geoid").alias("units"), F.avg("value").alias("mean"))
    return rounded(out, "mean", to=4)


_LOADS = f"x AS ({fx.SCORED}), m AS (SELECT avg(score_a) AS a, avg(score_b) AS b FROM x), c AS (SELECT id, (score_a - a) / 1000 AS va, (score_b - b) / 50 AS vb FROM x, m)"


def loads(spark, d):
    """Attributions of a linear score: (id, feature, value)."""
    x = fx.view(spark, d, fx.SCORED)
    mean = x.agg(F.avg("score_a").alias("a"), F.avg("score_b").alias("b"))
    wide = x.join(F.broadcast(mean)).select("id", ((F.col("score_a") - F.col("a")) / 1000).alias("score_a"), ((F.col("score_b") - F.col("b")) / 50).alias("score_b"))
    return wide.unpivot(["id"], ["score_a", "score_b"], "feature", "value")


@query(f"WITH {_LOADS} SELECT id, CASE WHEN abs(va) >= abs(vb) THEN 'score_a' ELSE 'score_b' END AS feature, round(CASE WHEN abs(va) >= abs(vb) THEN va ELSE vb END, 6) AS value FROM c")
def top_contributions(spark, d):
    top = ex.top_contributions(loads(spark, d), "id", 1)
    return rounded(top.select("id", F.col("top")[0]["feature"].alias("feature"), F.col("top")[0]["value"].alias("value")), "value")


@query(f"WITH {_LOADS} SELECT 'score_a' AS feature, round(avg(abs(va)), 6) AS importance FROM c UNION ALL SELECT 'score_b', round(avg(abs(vb)), 6) FROM c")
def global_importance(spark, d):
    return rounded(ex.global_importance(loads(spark, d)), "importance")


@query(f"WITH {_LOADS} SELECT id, round(va + vb, 6) AS load FROM c")
def grouped_load(spark, d):
    return rounded(ex.grouped_load(loads(spark, d), ["score_a", "score_b"], "id"), "load")
