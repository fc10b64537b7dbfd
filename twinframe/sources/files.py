"""Landed files to tables: health JSON, outage and denominator CSV, gridded text, artifact catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.scalars import parse_period, parse_ts, to_number, variable_name
from twinframe.operators import bitemporal

_CELL = "geographicTypeId string, geo string, geoId string, calculationType string, temporalTypeId string, temporal string, temporalId string, dataValue string, displayValue string, groupById string, suppressionFlag string, confidenceIntervalLow string, confidenceIntervalHigh string"
#: byte-order mark before a file's first column
BOM = "\ufeff"
_ARRAYS = ("tableResult", "dailyEstimatesTableResult", "monthlyTableResult", "pmTableResult")
HEALTH = ", ".join([*[f"{a} array<struct<{_CELL.replace(' string', ':string')}>>" for a in _ARRAYS], "code int", "message string", "status string"])


def health_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, quarantined documents) of one JSON document a file. Suppressed cells are censored to [0, 10], not null."""
    docs = spark.read.schema(HEALTH).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    bad = F.coalesce(F.col("code") >= 400, F.lit(False))
    rows = docs.where(~bad).select("file", F.explode(F.concat(*[F.coalesce(a, F.array()) for a in _ARRAYS])).alias("c")).select("file", "c.*")
    hidden = F.coalesce("suppressionFlag", F.lit("0")) == "1"
    cells = rows.select("file", F.col("geoId").alias("geoid"), parse_period(F.col("temporal"), F.col("temporalId")).alias("valid_date"), variable_name(F.col("groupById"), F.col("calculationType")).alias("variable"), F.when(~hidden, to_number(F.col("dataValue"))).alias("value"), hidden.alias("censored"), F.when(hidden, 0.0).alias("censor_lo"), F.when(hidden, 10.0).alias("censor_hi"))
    return cells, docs.where(bad).select("file", "code", "message", F.col("code").isin(429, 500, 502, 503, 504).alias("retryable"))


def outage_csv(spark: SparkSession, paths: list[str], states: list[str] | None = None) -> DataFrame:
    """(geoid, customers_out, ts_utc); a time stamp in no known format stops the load. Files are united by their headers, whatever
    the order of their columns: one reader for all files of one header."""
    heads: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        heads.setdefault(tuple(spark.read.option("header", True).csv(path).columns), []).append(path)
    raw = reduce(DataFrame.unionByName, [spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in head)).csv(of).select(*[F.col(f"`{c}`").alias(c.lstrip(BOM)) for c in head]).select("fips_code", "customers_out", "run_start_time") for head, of in heads.items()])
    rows = raw.select(F.lpad("fips_code", 5, "0").alias("geoid"), to_number(F.col("customers_out")).alias("customers_out"), parse_ts(F.col("run_start_time")).alias("ts_utc"), "run_start_time")
    rows = rows.withColumn("ts_utc", F.when(F.col("ts_utc").isNull(), F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce("run_start_time", F.lit("null")))).cast("timestamp")).otherwise(F.col("ts_utc"))).drop("run_start_time")
    return rows if states is None else rows.where(F.substring("geoid", 1, 2).isin(*states))


def time_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("ts_utc").alias("first_utc"), F.max("ts_utc").alias("last_utc"))


def customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """(geoid, customers): positive denominators, of a unit's several the first in the file."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip(BOM) for c in raw.columns]).withColumn("nth_", F.monotonically_increasing_id())  # rises along a file
    rows = raw.select(F.lpad(F.trim("County_FIPS"), 5, "0").alias("geoid"), to_number(F.col("Customers")).alias("customers"), "nth_")
    return rows.where("customers > 0").groupBy("geoid").agg(F.min_by("customers", "nth_").alias("customers"))


def coverage_csv(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """(geoid, valid_date, variable, value) of yearly coverage; states (postal, geoid)."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.join(states, raw.state == states.postal).select("geoid", F.to_date("year", "M/d/yy").alias("valid_date"), *[(to_number(F.col(c)) * 100).alias(c) for c in ("min_pct_covered", "max_pct_covered")])
    return rows.unpivot(["geoid", "valid_date"], ["min_pct_covered", "max_pct_covered"], "variable", "value")


def packing_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, scale, offset, fill, units) from attribute text."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))

    def attr(name: str):
        return F.nullif(F.regexp_extract("value", rf"{name}\s*\"?([^\s;\"]+)", 1), F.lit(""))

    return t.select("file", attr("scale_factor").try_cast("double").alias("scale"), attr("add_offset").try_cast("double").alias("offset"), attr("_FillValue").try_cast("double").alias("fill"), attr("units").alias("units"))


def grid_text(spark: SparkSession, path: str, variable: str, cells: DataFrame | None = None, tolerance: float = 1e-3) -> DataFrame:
    """(file, lat, lon, valid_date, raw) of packed series; the declared length must be the number of values. With `cells` (file, lat,
    lon: the centres asked for) a series from elsewhere than its file's cell stops the load."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    v = variable.replace(".", r"\.")
    body = t.select("file", F.regexp_extract("value", rf"{v}\.{v}\[(\d+)\]", 1).try_cast("int").alias("n"), F.regexp_extract_all("value", F.lit(r"(?m)^\[\d+\]\[0\],?\s*(-?\d+)"), 1).alias("raw"), F.split(F.regexp_extract("value", rf"{v}\.day\[\d+\]\s*([^\n]*)", 1), r",\s*").alias("days"), F.regexp_extract("value", rf"{v}\.lat\[\d+\]\s*([^\n]*)", 1).try_cast("double").alias("lat"), F.regexp_extract("value", rf"{v}\.lon\[\d+\]\s*([^\n]*)", 1).try_cast("double").alias("lon"))
    body = body.withColumn("ok", (F.col("n") == F.size("raw")) & (F.col("n") == F.size("days")))
    body = body.withColumn("raw", F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("length mismatch in "), F.col("file"))).cast("array<string>")).otherwise(F.col("raw")))
    if cells is not None:
        asked = cells.select("file", F.col("lat").alias("lat_"), F.col("lon").alias("lon_"))
        off = (F.abs(F.col("lat") - F.col("lat_")) > tolerance) | (F.abs(F.col("lon") - F.col("lon_")) > tolerance)
        body = body.join(asked, "file", "left").withColumn("lat", F.when(off, F.raise_error(F.concat(F.lit("another cell than asked for in "), F.col("file"))).cast("double")).otherwise(F.col("lat")))
    return body.select("file", "lat", "lon", F.explode(F.arrays_zip("days", "raw")).alias("x")).select("file", "lat", "lon", F.date_add(F.lit("1900-01-01").cast("date"), F.col("x.days").cast("int")).alias("valid_date"), F.col("x.raw").cast("double").alias("raw"))


def unpack(raw, scale, offset, fill, units):
    """Unpacked value: fill is null, kelvin becomes deg C."""
    v = F.when(raw != fill, raw * scale + offset)
    return F.when(units == "K", v - 273.15).otherwise(v)


def assign_cell(df: DataFrame, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """Grid cell (i, j) of each point (lat, lon); points off the grid go."""
    out = df.withColumns({"i": F.bround((F.lit(lat0) - F.col("lat")) / step).cast("int"), "j": F.bround((F.col("lon") - lon0) / step).cast("int")})
    return out.where(F.col("i").between(0, n_lat - 1) & F.col("j").between(0, n_lon - 1))


def centroids_csv(spark: SparkSession, path: str) -> DataFrame:
    """(geoid, state_fips, county, state, population, lat, lon); a number that can't be read, or a unit given twice, stops the load."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])
    state = F.lpad("STATEFP", 2, "0")
    out = raw.select(F.concat(state, F.lpad("COUNTYFP", 3, "0")).alias("geoid"), state.alias("state_fips"), F.col("COUNAME").alias("county"), F.col("STNAME").alias("state"), *[F.trim(c).cast("double").alias(n) for c, n in (("POPULATION", "population"), ("LATITUDE", "lat"), ("LONGITUDE", "lon"))])
    if not out.groupBy("geoid").count().where("count > 1").isEmpty():
        raise ValueError("a unit is given twice")
    return out


def select_units(units: DataFrame, states: list[str] | None = None, counties: list[str] | None = None) -> DataFrame:
    if states:
        units = units.where(F.col("state_fips").isin([x.zfill(2) for x in states]))
    if counties:
        units = units.where(F.col("geoid").isin([x.zfill(5) for x in counties]))
    return units


def grid_facts(series: DataFrame, units: DataFrame, packing: DataFrame, units_expected: dict[str, str]) -> DataFrame:
    """Cell series to facts of all units in a cell (geo_level, geoid, valid_date, variable, value).

    series (variable, i, j, valid_date, raw, fetched_at), units (geoid, i, j), packing (variable, scale, offset, fill, units).
    Of a cell's day in several artifacts the last fetched stays; a variable in other units than expected stops the load.
    """
    last = series.groupBy("variable", "i", "j", "valid_date").agg(F.max_by("raw", F.struct("fetched_at", "raw")).alias("raw"))
    wanted = F.lit(None).cast("string")
    for name, unit in units_expected.items():
        wanted = F.when(F.col("variable") == name, unit).otherwise(wanted)
    checked = packing.withColumn("units", F.when(wanted.isNotNull() & ~F.col("units").eqNullSafe(wanted), F.raise_error(F.concat(F.lit("unexpected units of "), F.col("variable"))).cast("string")).otherwise(F.col("units")))
    value = unpack(F.col("raw"), F.col("scale"), F.col("offset"), F.col("fill"), F.col("units"))
    out = last.join(checked, "variable").withColumn("value", value).join(units.select("geoid", "i", "j"), ["i", "j"])
    return out.select(F.lit("county").alias("geo_level"), "geoid", "valid_date", "variable", "value")


def split_bad(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows); an undecided row is good."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)


def register(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Artifacts whose content the catalogue doesn't hold, each content once."""
    return found.dropDuplicates(["sha256"]).join(catalogue.select("sha256"), "sha256", "left_anti")


def load(stored: DataFrame, rows: DataFrame, source: str, known_at, found: DataFrame | None = None, catalogue: DataFrame | None = None, now=None) -> tuple[DataFrame, DataFrame | None, dict[str, int]]:
    """Normalised rows of one source, checked: (facts to append, artifacts to append, counters). A null key or a repeated natural
    key stops the load."""
    rows = rows.withColumn("source", F.lit(source))
    check = bitemporal.validate(rows).first()
    if check.null_keys or check.duplicates:
        raise ValueError(f"{check.null_keys} rows with a null key, {check.duplicates} surplus rows")
    fresh, stats = bitemporal.upsert(stored, rows, known_at, now)
    if found is None:
        return fresh, None, stats
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    return fresh, found if catalogue is None else register(catalogue, found), stats | {"artifacts": size.n, "bytes": size.b}


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, md5) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose MD5 isn't the published one; expected (path, md5)."""
    return found.join(expected.select("path", F.col("md5").alias("published")), "path", "left").where(~F.col("md5").eqNullSafe(F.lower("published")))


def missing_units(rows: DataFrame, customers: DataFrame, unit: str = "geoid") -> DataFrame:
    """Units of rows for which there is no denominator, each once; a null unit is one of them."""
    return rows.select(unit).distinct().join(customers.select(unit), unit, "left_anti")


def source_version(found: DataFrame, fixed: dict[str, str] | None = None) -> DataFrame:
    """(source, source_version): the fixed version of a dataset, else the day of its latest artifact (source, fetched_at)."""
    latest = found.groupBy("source").agg(F.date_format(F.max("fetched_at"), "yyyy-MM-dd").alias("day_"))
    stated = F.lit(None).cast("string")
    for name, version in (fixed or {}).items():
        stated = F.when(F.col("source") == name, version).otherwise(stated)
    return latest.select("source", F.coalesce(stated, "day_").alias("source_version"))
