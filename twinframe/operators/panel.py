"""Weighted aggregation, outage days, thermal and compound features, and the warming counterfactual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.scalars import heat_index_c
from twinframe.operators.bitemporal import as_of, require

WARM = (5, 6, 7, 8, 9)


def by_day():
    """Rows of a unit in order of days."""
    return Window.partitionBy("geoid").orderBy("valid_date")


def population_weighted(child: DataFrame, weights: DataFrame, min_coverage: float = 0.99) -> DataFrame:
    """Parent means by weight, where enough of the parent's whole weight has a value. weights (geoid, parent, population): a
    dimension as small as its geography, so Spark's own size limit decides whether it is broadcast."""
    total = weights.groupBy("parent").agg(F.sum("population").alias("total_"))
    w = weights.join(total, "parent")
    out = child.where("value is not null").join(w, "geoid").groupBy("parent", "valid_date", "variable").agg((F.sum(F.col("value") * F.col("population")) / F.sum("population")).alias("value"), (F.sum("population") / F.first("total_")).alias("coverage"))
    return out.where(F.col("coverage") >= min_coverage - 1e-12)


def with_parents(child: DataFrame, weights: DataFrame, level: str, parent_level: str, min_coverage: float = 0.0) -> DataFrame:
    """Facts of units (geoid, valid_date, variable, value) and the weighted means of their parents in one table, told apart by geo_level."""
    up = population_weighted(child, weights, min_coverage).select(F.lit(parent_level).alias("geo_level"), F.col("parent").alias("geoid"), "valid_date", "variable", "value")
    return child.select(F.lit(level).alias("geo_level"), "geoid", "valid_date", "variable", "value").unionByName(up)


def state_exposure(facts: DataFrame, weights: DataFrame, variables: list[str], start, end, known_at=None, source: str = "gridmet") -> DataFrame:
    """(geoid, valid_date, variables..., pop_coverage): parents' exposures from their children's facts as known at a time.

    Each value is the mean over the children that have one, by weight; pop_coverage is the least share of a parent's whole weight
    over the day's variables. Of a day with any value, variables without one are null.
    """
    known = as_of(facts.where(F.col("source") == source), known_at, geo_level="county", valid_from=start, valid_to=end, variables=variables)
    means = population_weighted(known.select("geoid", "valid_date", "variable", "value"), weights, 0.0)
    wide = means.groupBy("parent", "valid_date").pivot("variable", variables).agg(F.first("value").alias("value"), F.min("coverage").alias("coverage"))
    values = [F.col(f"{v}_value").alias(v) for v in variables]
    return wide.select(F.col("parent").alias("geoid"), "valid_date", *values, F.least(*[F.coalesce(f"{v}_coverage", F.lit(1.0)) for v in variables], F.lit(1.0)).alias("pop_coverage"))


def with_denominators(raw: DataFrame, customers: DataFrame, zones: DataFrame, state_digits: int = 2) -> DataFrame:
    """Outage rows (geoid, ts_utc, customers_out) with their unit's denominator and their state's time zone; rows without either go.
    customers (geoid, customers), zones (state_fips, tz)."""
    return raw.join(customers, "geoid").withColumn("state_fips", F.substring("geoid", 1, state_digits)).join(zones, "state_fips")


def top_until_share(df: DataFrame, group: str, unit: str, weight: str, share: float) -> DataFrame:
    """Each group's heaviest units until they reach a share of its weight, the one that crosses it included."""
    order = Window.partitionBy(group).orderBy(F.col(weight).desc(), unit)
    before = F.sum(weight).over(order) - F.col(weight)
    return df.withColumn("s_", before / F.sum(weight).over(Window.partitionBy(group))).where(F.col("s_") < share).drop("s_")


def outage_snapshots(raw: DataFrame, tz: str | None = "America/Phoenix") -> DataFrame:
    """Outages by unit and local quarter hour, as a share of customers (1 at most); repeated local times keep the largest. Local
    time is that of `tz`, or without it of each row's column tz."""
    local = raw.withColumn("ts", F.from_utc_timestamp("ts_utc", F.lit(tz) if tz else F.col("tz")))
    one = local.groupBy("geoid", "ts").agg(F.max("customers_out").alias("customers_out"), F.max("customers").alias("customers"))
    return one.withColumn("day", F.to_date("ts")).withColumn("frac", F.least(F.lit(1.0), F.col("customers_out") / F.col("customers")))


def clip_report(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count(F.lit(1)).alias("n_snapshots"), F.count_if(F.col("customers_out") > F.col("customers")).alias("n_clipped"))


def parent_snapshots(snapshots: DataFrame, totals: DataFrame, parent: Column) -> DataFrame:
    """Sum over children against the parent's whole denominator; totals (parent, total)."""
    s = snapshots.groupBy(parent.alias("parent"), "ts").agg(F.sum("customers_out").alias("customers_out"))
    return s.join(totals, "parent").withColumn("frac", F.least(F.lit(1.0), F.col("customers_out") / F.col("total")))


def outage_daily(snapshots: DataFrame, threshold: float = 0.01, step_hours: float = 0.25) -> DataFrame:
    """Largest share, longest run over the threshold (in hours, within a local day) and customer-hours."""
    step = int(step_hours * 3600)
    by = Window.partitionBy("geoid", "day").orderBy("ts")
    slot = F.floor(F.unix_timestamp("ts") / step)
    over = F.col("frac") >= threshold
    # slots over the threshold that follow each other share the slot less their number within the day
    run = F.when(over, slot - F.sum(over.cast("int")).over(by))
    marked = snapshots.withColumn("run_", run)
    sums = marked.groupBy("geoid", "day", "run_").agg(F.max("frac").alias("frac_"), F.sum("customers_out").alias("out_"), F.count("run_").alias("n_"))
    return sums.groupBy("geoid", "day").agg(F.max("frac_").alias("max_frac"), (F.sum("out_") * step_hours).alias("customer_hours"), (F.max("n_") * step_hours).alias("max_hours"))


def complete_days(bounds: DataFrame, zones: DataFrame) -> DataFrame:
    """bounds (first_utc, last_utc), one row; zones (geoid, tz) -> first and last local day wholly inside the bounds."""
    days = zones.join(F.broadcast(bounds.limit(1))).withColumn("day", F.explode(F.sequence(F.to_date("first_utc") - 1, F.to_date("last_utc") + 1)))
    start = F.to_utc_timestamp(F.col("day").cast("timestamp"), F.col("tz"))
    end = F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), F.col("tz"))
    return days.where((start >= F.col("first_utc")) & (end <= F.col("last_utc") + F.expr("INTERVAL 15 MINUTES"))).groupBy("geoid").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def densify(daily: DataFrame, span: DataFrame, values: list[str]) -> DataFrame:
    """Every day of each unit's span; days without a row count 0. span (geoid, first_day, last_day)."""
    days = span.select("geoid", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.join(daily, ["geoid", "day"], "left").fillna(0.0, values)


def local_percentile(df: DataFrame, var: str, q: float, ref_start, ref_end, months: tuple[int, ...] | None = None) -> DataFrame:
    """Exact percentile of each unit over its reference period alone."""
    ref = df.where(F.col("valid_date").between(F.lit(ref_start).cast("date"), F.lit(ref_end).cast("date")))
    if months:
        ref = ref.where(F.month("valid_date").isin(*months))
    return ref.groupBy("geoid").agg(F.percentile(var, F.lit(q / 100)).alias("threshold"))


def above(value: Column, threshold: Column) -> Column:
    """1, 0, or null where either is missing."""
    return (value > threshold).cast("double")


def with_streak(df: DataFrame, flag: str = "hot", out: str = "hot_streak") -> DataFrame:
    """Days in a row with the flag, up to and with each day; a missing day or flag ends it."""
    off = F.coalesce(F.col(flag) != 1, F.lit(True)) | F.coalesce(F.datediff("valid_date", F.lag("valid_date").over(by_day())) != 1, F.lit(True))
    isle = df.withColumn("isle_", F.sum(off.cast("int")).over(by_day()))
    hot = F.coalesce(F.col(flag) == 1, F.lit(False))
    return isle.withColumn(out, F.sum(hot.cast("int")).over(Window.partitionBy("geoid", "isle_").orderBy("valid_date")).cast("double")).drop("isle_")


def with_first_wave(df: DataFrame, streak: str = "hot_streak", min_days: int = 2, out: str = "first_wave") -> DataFrame:
    """1 on the days of each unit's first wave of the year (a run of min_days or more), by the year of the run's days."""
    start = F.date_sub("valid_date", F.col(streak).cast("int") - 1)
    w = df.withColumn("from_", F.when(F.col(streak) > 0, start)).withColumn("year_", F.year("valid_date"))
    runs = w.where("from_ is not null").groupBy("geoid", "year_", "from_").agg(F.max(streak).alias("n_")).where(F.col("n_") >= min_days)
    first = runs.groupBy("geoid", "year_").agg(F.min("from_").alias("first_"))
    return w.join(first, ["geoid", "year_"], "left").withColumn(out, F.coalesce((F.col("from_") == F.col("first_")).cast("double"), F.lit(0.0))).drop("from_", "year_", "first_")


def compound_flags(df: DataFrame, thresholds: DataFrame, var: str = "tmmx", frac: str = "outage_customers_frac", hours: str = "outage_max_hours", min_frac: float = 0.05, min_hours: float = 1.0) -> DataFrame:
    """hot, its streak, outage and compound; without outage data both latter are null."""
    hot = df.join(thresholds, "geoid", "left").withColumn("hot", above(F.col(var), F.col("threshold"))).drop("threshold")
    out = with_streak(hot).withColumn("outage", F.when(F.col(frac).isNotNull() & F.col(hours).isNotNull(), ((F.col(frac) >= min_frac) & (F.col(hours) >= min_hours)).cast("double")))
    return out.withColumn("compound", F.col("hot") * F.col("outage"))


def compound_summary(flags: DataFrame) -> DataFrame:
    """By unit: days with all flags, hot, outage and compound days, those expected were hot and outage days independent, and their
    ratio."""
    s = flags.dropna(subset=["hot", "outage", "compound"]).groupBy("geoid").agg(F.count(F.lit(1)).alias("days"), *[F.sum(c).alias(c) for c in ("hot", "outage", "compound")])
    return s.withColumn("expected", F.col("hot") * F.col("outage") / F.col("days")).withColumn("ratio", F.try_divide("compound", F.nullif("expected", F.lit(0.0))))


def compound_totals(summary: DataFrame) -> DataFrame:
    """One row: the summary's days and counts over all units."""
    return summary.agg(*[F.sum(c).alias(c) for c in ("days", "hot", "outage", "compound", "expected")])


def prevalence(panel: DataFrame, *by: Column | str, y: str = "y") -> DataFrame:
    """Share of positives and number of rows, by anything."""
    return panel.groupBy(*by).agg(F.avg(y).alias("prevalence"), F.count(F.lit(1)).alias("n"))


def class_balance(panel: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, share)."""
    c = panel.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("t_")))).select(y, "n", (F.col("n") / F.col("t_")).alias("share"))  # one row


def thermal_features(exposure: DataFrame, ref_start, ref_end) -> DataFrame:
    """exposure (geoid, valid_date, tmax, tmin, rh_min) -> the 14 features; thresholds and climate come from the reference period."""
    f = exposure.withColumn("heat_index", heat_index_c(F.col("tmax"), F.col("rh_min")))
    p95 = local_percentile(f, "heat_index", 95.0, ref_start, ref_end)
    warm = F.col("valid_date").between(F.lit(ref_start).cast("date"), F.lit(ref_end).cast("date")) & F.month("valid_date").isin(*WARM)
    clim = f.where(warm).groupBy("geoid").agg(F.avg("heat_index").alias("hi_clim_ref"))
    f = f.join(p95.join(clim, "geoid", "left"), "geoid", "left").withColumn("hi_excess_p95", F.col("heat_index") - F.col("threshold"))
    f = f.withColumn("hot", above(F.col("heat_index"), F.col("threshold"))).drop("threshold")
    last3 = by_day().rowsBetween(-2, 0)
    f = f.withColumns({"hi_lag1": F.lag("heat_index").over(by_day()), "hi_mean_3d": F.avg("heat_index").over(last3), "tmin_mean_3d": F.avg("tmin").over(last3)})
    f = with_first_wave(with_streak(f)).drop("hot").withColumnRenamed("first_wave", "first_heatwave")
    angle = F.dayofyear("valid_date") * (2 * 3.141592653589793 / 365.25)
    return f.withColumns({"doy_sin": F.sin(angle), "doy_cos": F.cos(angle), "weekend": (F.weekday("valid_date") >= 5).cast("double")})


FEATURES = ("heat_index", "tmax", "tmin", "rh_min", "hi_excess_p95", "hi_mean_3d", "hi_lag1", "tmin_mean_3d", "hot_streak", "first_heatwave", "hi_clim_ref", "doy_sin", "doy_cos", "weekend")


def outcome(facts: DataFrame, variable: str, known_at=None, geo_level: str = "state", source: str | None = None) -> DataFrame:
    """(geoid, valid_date, rate): an outcome's series as known at a time, from the facts; days without a value are left out."""
    if source is not None:
        facts = facts.where(F.col("source") == source)
    return as_of(facts, known_at, geo_level=geo_level, variables=[variable]).where("value IS NOT NULL").select("geoid", "valid_date", F.col("value").alias("rate"))


def build_panel(exposure: DataFrame, outcome: DataFrame, regions: DataFrame, ref_start, ref_end, min_coverage: float = 0.7, coverage: str | None = "pop_coverage") -> DataFrame:
    """Warm-season rows with all features and an outcome. outcome (geoid, valid_date, rate); regions (geoid, hhs_region). Days of less
    than min_coverage in the exposure's column `coverage` are left out; None: exposures that cover their units wholly."""
    if coverage is not None:
        exposure = require(exposure, coverage).where(F.col(coverage) >= min_coverage)
    f = thermal_features(exposure, ref_start, ref_end).join(outcome, ["geoid", "valid_date"]).where(F.month("valid_date").isin(*WARM)).dropna(subset=list(FEATURES))
    f = f.withColumns({"y": (F.col("rate") > 0).cast("int"), "year": F.year("valid_date"), "week": F.weekofyear("valid_date")})
    return f.join(regions, "geoid").where("hhs_region is not null")


def with_warming(panel: DataFrame, delta: float) -> DataFrame:
    """The features had each day been warmer by delta; thresholds and climate stay."""
    if delta == 0:
        return panel.select("geoid", "valid_date", *FEATURES)
    f = panel.withColumns({"tmax": F.col("tmax") + delta, "tmin": F.col("tmin") + delta, "tmin_mean_3d": F.col("tmin_mean_3d") + delta})
    f = f.withColumn("d_", heat_index_c(F.col("tmax"), F.col("rh_min")) - F.col("heat_index"))
    f = f.withColumns({"heat_index": F.col("heat_index") + F.col("d_"), "hi_excess_p95": F.col("hi_excess_p95") + F.col("d_"), "hi_lag1": F.col("hi_lag1") + F.coalesce(F.lag("d_").over(by_day()), F.col("d_")), "hi_mean_3d": F.col("hi_mean_3d") + F.avg("d_").over(by_day().rowsBetween(-2, 0))})
    f = f.drop("hot_streak", "first_heatwave").withColumn("hot", (F.col("hi_excess_p95") > 0).cast("double"))
    return with_first_wave(with_streak(f)).withColumnRenamed("first_wave", "first_heatwave").select("geoid", "valid_date", *FEATURES)
