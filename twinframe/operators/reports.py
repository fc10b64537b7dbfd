"""Tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators.bitemporal import latest_per
from twinframe.operators.quantiles import percentiles


def coverage_by_year(df: DataFrame, value: str = "value", day: str = "valid_date") -> DataFrame:
    """Count, extremes, exact median and largest over smallest value of each year."""
    rows = df.where(F.col(value).isNotNull()).select(F.year(day).alias("year"), F.col(value).alias("v"))
    middle = percentiles(rows, "v", [0.5], by=["year"]).select(F.col("year").alias("of"), F.col("value").alias("middle"))
    g = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    g = g.join(middle, F.col("year").eqNullSafe(F.col("of"))).select("year", "n", "low", "high", "middle")
    return g.withColumn("ratio", F.try_divide("high", F.nullif("low", F.lit(0.0))))


def status(df: DataFrame, layers: dict[str, str]) -> DataFrame:
    """One row: for each layer the rows that meet its condition."""
    return df.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in layers.items()])


def top_compound_days(flags: DataFrame, size: str, n: int = 25) -> DataFrame:
    """The n largest compound days; ties by unit and day."""
    return flags.where("compound = 1").orderBy(F.col(size).desc(), "geoid", "valid_date").limit(n)


def by_year(df: DataFrame, unit: str = "geoid", day: str = "valid_date", value: str = "value") -> DataFrame:
    """Each unit's yearly means as a map; a unit has as many entries as there are years."""
    yearly = df.groupBy(unit, F.year(day).alias("y")).agg(F.avg(value).alias("v"))
    return yearly.groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "v")))).alias("by_year"))


def provenance(artifacts: DataFrame, facts: DataFrame) -> DataFrame:
    """By source: files, bytes and the latest fetch; facts, units and their range of days as text. artifacts (source, n_bytes, fetched_at)."""
    a = artifacts.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("bytes"), F.date_format(F.max("fetched_at"), "yyyy-MM-dd").alias("latest"))
    f = facts.groupBy("source").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("geoid").alias("units"), F.concat_ws(" / ", F.min("valid_date").cast("string"), F.max("valid_date").cast("string")).alias("days"))
    return f.join(a, "source", "left")


def latest_artifacts(artifacts: DataFrame, n: int = 12) -> DataFrame:
    return artifacts.orderBy(F.col("fetched_at").desc(), *[c for c in artifacts.columns if c != "fetched_at"]).limit(n)


def axes(df: DataFrame, day: str = "valid_date") -> DataFrame:
    """One row: the sorted days and years that occur."""
    days = df.select(F.col(day).alias("d")).where("d is not null").distinct()
    return days.agg(F.sort_array(F.collect_set(F.col("d").cast("string"))).alias("days"), F.sort_array(F.collect_set(F.year("d"))).alias("years"))


def risk_arrays(predictions: DataFrame, observations: DataFrame, unit: str = "geoid", day: str = "target_date", digits: int = 4) -> DataFrame:
    """By unit and series, an array with one place for each day that any unit has (null where it has no value).

    Series: `p` the baseline, each scenario by its id, `y` the observed outcome. predictions (unit, day, scenario_id, value, issued_at,
    prediction_id): the latest issue counts, then the largest id. observations (unit, day, value). A row's array is as long as there are days.
    """
    latest = latest_per(predictions.withColumn("series", F.coalesce("scenario_id", F.lit("p"))), (unit, day, "series"), F.col("issued_at").desc(), F.col("prediction_id").desc())
    known = latest.select(unit, day).distinct()
    seen = observations.join(known, [unit, day], "left_semi").select(unit, day, F.lit("y").alias("series"), F.col("value").cast("double").alias("value"))
    rows = latest.select(unit, day, "series", F.round("value", digits).alias("value")).unionByName(seen)
    days = latest.select(day).distinct().agg(F.sort_array(F.collect_set(day)).alias("days_"))
    got = rows.groupBy(unit, "series").agg(F.map_from_entries(F.collect_list(F.struct(day, "value"))).alias("m_"))
    return got.join(F.broadcast(days)).select(unit, "series", F.transform("days_", lambda d: F.element_at("m_", d)).alias("values"))


def payload(arrays: DataFrame, unit: str = "geoid") -> DataFrame:
    """One nested row a unit for a JSON sink: its series by name."""
    return arrays.groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "values")))).alias("series"))
