"""Prediction log, observations, genuine forecast pairs, calibration metrics and drift rules, for any number of groups in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from twinframe.functions.scalars import stable_id
from twinframe.functions.stages import exists, same
from twinframe.operators.bitemporal import changed, latest_per

TARGET = ("geo_level", "geoid", "target_date", "quantity")
ID_PARTS = (*TARGET, "model_name", "model_version", "issued_at", "scenario_id", "seed")


def with_ids(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("prediction_id", stable_id(*[F.col(c) if c in predictions.columns else F.lit(None) for c in ID_PARTS]))


def append_new(log: DataFrame, rows: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key the log doesn't hold; of several with one key the last by `order` (then by all columns) stays."""
    by = [F.col(c).desc_nulls_last() for c in (*order, *(c for c in sorted(rows.columns) if c not in order and not isinstance(rows.schema[c].dataType, MapType)))]
    return latest_per(rows.join(log.select(key), key, "left_anti"), (key,), *by)


def store_new(rows: DataFrame, path: str, key: str = "prediction_id", by: tuple[str, ...] = ("model_name",)) -> int:
    """Appends to the log at path, in folders by model, the rows whose key it doesn't hold, and gives their number, observed on the
    write. The same rows again are no new ones. Of the log only the keys of the rows' own folders are read."""
    spark, counted = rows.sparkSession, Observation()
    if exists(spark, path):
        log = spark.read.parquet(path)
        folders = rows.select(*by).distinct()
        log = log.alias("l").join(F.broadcast(folders).alias("f"), same("l", "f", by), "left_semi").select(key)  # a row a model
    else:
        log = rows.select(key).limit(0)
    fresh = append_new(log, rows, key).observe(counted, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").partitionBy(*by).parquet(path)
    return counted.get["n"]


def get(log: DataFrame, model_name=None, quantity=None, target_from=None, target_to=None, issued_before=None, scenario_id=None, baseline_only=False) -> DataFrame:
    for col, v in (("model_name", model_name), ("quantity", quantity), ("scenario_id", scenario_id)):
        if v is not None:
            log = log.where(F.col(col) == v)
    if target_from is not None:
        log = log.where(F.col("target_date") >= F.lit(target_from).cast("date"))
    if target_to is not None:
        log = log.where(F.col("target_date") <= F.lit(target_to).cast("date"))
    if issued_before is not None:
        log = log.where(F.col("issued_at") < F.lit(issued_before).cast("timestamp"))
    if baseline_only:
        log = log.where(F.col("scenario_id").isNull())
    return log.orderBy("target_date", "geoid")


def audit(log: DataFrame, prediction_id: str) -> DataFrame:
    """One prediction with its extras decoded."""
    return log.where(F.col("prediction_id") == prediction_id).withColumn("extras", F.from_json("extras_json", "map<string,string>"))


def new_observations(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """As for facts but without guards: new targets, and those whose value or censoring changed, with their next revision.

    Of a batch's rows for one target the last by `seq` counts (by all columns where the batch has no such column).
    """
    order = [seq] if seq in batch.columns else sorted(set(batch.columns) - {*TARGET, "revision"})
    one = latest_per(batch.drop("revision"), TARGET, *[F.col(c).desc_nulls_last() for c in order])
    last = latest_per(stored, TARGET, F.col("revision").desc()).select(*TARGET, F.col("value").alias("old_"), F.coalesce("censored", F.lit(False)).alias("hid_"), F.col("revision").alias("was_"))
    both = one.withColumn("censored", F.coalesce("censored", F.lit(False))).join(last, list(TARGET), "left")
    new = F.col("was_").isNull() | changed(F.col("value"), F.col("old_")) | changed(F.col("censored"), F.col("hid_"))
    return both.where(new).withColumn("revision", F.coalesce(F.col("was_") + 1, F.lit(0))).drop("old_", "hid_", "was_")


def latest_observations(obs: DataFrame, known_at=None, quantity=None) -> DataFrame:
    if known_at is not None:
        obs = obs.where(F.col("known_at") <= F.lit(known_at).cast("timestamp"))
    if quantity is not None:
        obs = obs.where(F.col("quantity") == quantity)
    first = F.min("known_at").over(Window.partitionBy(*TARGET))
    return latest_per(obs.withColumn("first_known_at", first), TARGET, F.col("revision").desc())


def sealed_observations(panel: DataFrame, facts: DataFrame, variable: str, quantity: str, stored: DataFrame, y: str = "y", geo_level: str = "state") -> DataFrame:
    """New observations of a panel's outcome, each with the time when its own fact was first known (no loop over those times): what a
    later forecast is told from. An outcome without such a fact stops the job."""
    first = facts.where((F.col("variable") == variable) & (F.col("geo_level") == geo_level)).groupBy("geoid", "valid_date").agg(F.min("known_at").alias("first_known_at"))
    sealed = seal(panel.select("geoid", "valid_date", F.col(y).cast("double").alias("value")), first, ["geoid", "valid_date"])
    rows = sealed.select(F.lit(geo_level).alias("geo_level"), "geoid", F.col("valid_date").alias("target_date"), F.lit(quantity).alias("quantity"), "value", F.lit(False).alias("censored"), F.lit(None).cast("double").alias("censor_lo"), F.lit(None).cast("double").alias("censor_hi"), F.col("first_known_at").alias("known_at"))
    return new_observations(stored, rows)


def seal(outcome: DataFrame, first_known: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes stamped with when they were first known; each must have such a time."""
    out = outcome.join(first_known, keys, "left")
    if not out.where("first_known_at is null").isEmpty():
        raise ValueError("outcome without a first known time")
    return out


def pairs(predictions: DataFrame, obs: DataFrame, known_at=None) -> DataFrame:
    """Forecasts with the observation of their target; genuine: issued before anything of it was known. Predictions under a scenario
    are no forecasts and are left out."""
    if "scenario_id" in predictions.columns:
        predictions = predictions.where("scenario_id IS NULL")
    if known_at is not None:
        predictions = predictions.where(F.col("issued_at") <= F.lit(known_at).cast("timestamp"))
    o = latest_observations(obs, known_at).select(*TARGET, F.col("value").alias("obs"), "censored", "censor_lo", "censor_hi", "first_known_at")
    made = F.coalesce(F.col("state_known_at"), F.col("issued_at")) if "state_known_at" in predictions.columns else F.col("issued_at")
    return predictions.join(o, list(TARGET)).withColumn("genuine", made < F.col("first_known_at"))


def keep_latest(found: DataFrame, by: tuple[str, ...] = ("model_name", "model_version")) -> DataFrame:
    """Of each target's genuine predictions by a model's version the last issued."""
    return latest_per(found.where("genuine"), (*TARGET, *by), F.col("issued_at").desc(), F.col("prediction_id").desc())


def metrics(found: DataFrame, by: tuple[str, ...] = ("model_name", "model_version", "quantity")) -> DataFrame:
    """Error metrics for each group in one aggregate; censored errors are distances to their interval."""
    gap = F.greatest(F.coalesce(F.col("censor_lo") - F.col("value"), F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(F.col("value") - F.col("censor_hi"), F.lit(0.0)), F.lit(0.0))
    cens = F.coalesce(F.col("censored"), F.lit(False))
    point = ~cens & F.col("obs").isNotNull()
    p, y = F.when(point, F.col("value")), F.when(point, F.col("obs"))
    r = p - y
    banded = point & F.col("value_lower").isNotNull() & F.col("value_upper").isNotNull()
    term = F.when(y > 0, y * F.ln(F.when((y > 0) & (p > 0), y / p))).otherwise(0.0)
    out = found.groupBy(*by).agg(
        F.count_if(point).alias("n_point"), F.avg(F.when(cens, gap).otherwise(F.abs(F.col("value") - F.col("obs")))).alias("mae"), F.avg(r).alias("bias"), F.stddev_samp(r).alias("sd_"),
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(y).alias("obs_mean"), F.regr_slope(y, p).alias("slope_"), F.regr_intercept(y, p).alias("intercept_"), F.var_pop(p).alias("var_"),
        F.when(F.min(y) >= 0, F.when(F.min(p) > 0, F.avg(2 * (term - (y - p))))).alias("poisson_deviance"),
        F.avg(F.when(cens, (gap == 0).cast("double"))).alias("censored_hit_rate"), F.avg(F.when(banded, F.col("obs").between(F.col("value_lower"), F.col("value_upper")).cast("double"))).alias("pi_coverage"))
    line = (F.col("n_point") >= 3) & (F.col("var_") > 0)
    return out.select(*by, "n_point", "mae", "bias", F.when((F.col("n_point") >= 2) & (F.col("sd_") > 0), F.col("bias") / (F.col("sd_") / F.sqrt("n_point"))).alias("bias_t"), "rmse", "obs_mean", F.when(line, F.col("slope_")).alias("calib_slope"), F.when(line, F.col("intercept_")).alias("calib_intercept"), "poisson_deviance", "censored_hit_rate", "pi_coverage")


#: of a group's pairs: sums and counts, which add up, least values, and a centred pair of columns (observed against predicted)
SUMS = ("n_point", "n_error", "error", "n_resid", "square", "n_obs", "obs", "n_deviance", "deviance", "n_censored", "hit", "n_band", "inside")
CENTRED = "struct<n:double,resid:double,resid2:double,p:double,p2:double,y:double,py:double>"


def moments(found: DataFrame, by: tuple[str, ...] = ("model_name", "model_version", "quantity")) -> DataFrame:
    """All that `metrics` needs of each group's pairs, in one row that `merge_moments` joins with those of other pairs."""
    gap = F.greatest(F.coalesce(F.col("censor_lo") - F.col("value"), F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(F.col("value") - F.col("censor_hi"), F.lit(0.0)), F.lit(0.0))
    cens = F.coalesce(F.col("censored"), F.lit(False))
    point = ~cens & F.col("obs").isNotNull()
    p, y = F.when(point, F.col("value")), F.when(point, F.col("obs"))
    r = p - y
    both = r.isNotNull()
    pb, yb = F.when(both, p), F.when(both, y)
    error = F.when(cens, gap).otherwise(F.abs(F.col("value") - F.col("obs")))
    term = F.when(y > 0, y * F.ln(F.when((y > 0) & (p > 0), y / p))).otherwise(0.0)
    off = 2 * (term - (y - p))
    hit = F.when(cens, (gap == 0).cast("double"))
    inside = F.when(point & F.col("value_lower").isNotNull() & F.col("value_upper").isNotNull(), F.col("obs").between(F.col("value_lower"), F.col("value_upper")).cast("double"))
    n = F.count(r)
    centred = F.struct(n.cast("double").alias("n"), F.avg(r).alias("resid"), (F.var_pop(r) * n).alias("resid2"), F.avg(pb).alias("p"), (F.var_pop(pb) * n).alias("p2"), F.avg(yb).alias("y"), (F.covar_pop(yb, pb) * n).alias("py"))
    add = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return found.groupBy(*by).agg(
        F.count_if(point).alias("n_point"), F.count(error).alias("n_error"), add(error).alias("error"), n.alias("n_resid"), add(r * r).alias("square"), F.count(y).alias("n_obs"), add(y).alias("obs"),
        F.count(off).alias("n_deviance"), add(off).alias("deviance"), F.count(hit).alias("n_censored"), add(hit).alias("hit"), F.count(inside).alias("n_band"), add(inside).alias("inside"),
        F.min(y).alias("least_obs"), F.min(p).alias("least_p"), centred.cast(CENTRED).alias("centred"))


def merge_moments(rows: DataFrame, by: tuple[str, ...] = ("model_name", "model_version", "quantity")) -> DataFrame:
    """Rows of `moments` -> one for each group. Centred sums are joined pair by pair, so that large means cost no digits; a group has
    as many rows as were kept for it (two in a stream)."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "resid", "resid2", "p", "p2", "y", "py")]).cast(CENTRED)

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share, both = b["n"] / n, a["n"] * b["n"] / n
        d = {c: b[c] - a[c] for c in ("resid", "p", "y")}
        out = F.struct(n.alias("n"), (a["resid"] + d["resid"] * share).alias("resid"), (a["resid2"] + b["resid2"] + d["resid"] ** 2 * both).alias("resid2"), (a["p"] + d["p"] * share).alias("p"), (a["p2"] + b["p2"] + d["p"] ** 2 * both).alias("p2"), (a["y"] + d["y"] * share).alias("y"), (a["py"] + b["py"] + d["p"] * d["y"] * both).alias("py"))
        return F.when(b["n"] > 0, out.cast(CENTRED)).otherwise(a)

    out = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("least_obs").alias("least_obs"), F.min("least_p").alias("least_p"), F.collect_list("centred").alias("c_"))
    return out.withColumn("centred", F.aggregate("c_", start, join)).drop("c_")


def metrics_of(m: DataFrame, by: tuple[str, ...] = ("model_name", "model_version", "quantity")) -> DataFrame:
    """`metrics` from merged moments."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    c, n = F.col("centred"), F.col("n_resid")
    sd = F.sqrt(F.try_divide(c["resid2"], F.nullif(n - 1, F.lit(0))))
    bias = F.when(n > 0, c["resid"])
    line = (F.col("n_point") >= 3) & (c["p2"] > 0)
    slope = F.try_divide(c["py"], F.nullif(c["p2"], F.lit(0.0)))
    return m.select(
        *by, "n_point", ratio("error", "n_error").alias("mae"), bias.alias("bias"), F.when((F.col("n_point") >= 2) & (sd > 0), bias / (sd / F.sqrt("n_point"))).alias("bias_t"), F.sqrt(ratio("square", "n_resid")).alias("rmse"),
        ratio("obs", "n_obs").alias("obs_mean"), F.when(line, slope).alias("calib_slope"), F.when(line, c["y"] - slope * c["p"]).alias("calib_intercept"),
        F.when((F.col("least_obs") >= 0) & (F.col("least_p") > 0), ratio("deviance", "n_deviance")).alias("poisson_deviance"), ratio("hit", "n_censored").alias("censored_hit_rate"), ratio("inside", "n_band").alias("pi_coverage"))


def reference_mae(runs: DataFrame, by: tuple[str, ...], k: int = 3) -> DataFrame:
    """Median MAE of each group's last k runs."""
    last = Window.partitionBy(*by).orderBy(F.col("ran_at").desc())
    return runs.withColumn("n_", F.row_number().over(last)).where(F.col("n_") <= k).groupBy(*by).agg(F.median("mae").alias("reference_mae"))


def drift(measured: DataFrame, mae_tol: float = 0.25, rel_bias_tol: float = 0.10) -> DataFrame:
    """Drift flags; measured may carry reference_mae."""
    biased = (F.col("n_point") >= 10) & (F.abs("bias_t") > 1.96) & (F.abs("bias") > rel_bias_tol * F.abs("obs_mean"))
    worse = F.col("mae") > (1 + mae_tol) * F.col("reference_mae") if "reference_mae" in measured.columns else F.lit(False)
    out = measured.withColumn("drift_bias", F.coalesce(biased, F.lit(False))).withColumn("drift_mae", F.coalesce(worse, F.lit(False)))
    return out.withColumn("drift", F.col("drift_bias") | F.col("drift_mae"))


def calibration_run(predictions: DataFrame, obs: DataFrame, runs: DataFrame | None, ran_at: str, known_at=None, target_from=None, target_to=None, by: tuple[str, ...] = ("model_name", "model_version", "quantity"), k: int = 3) -> DataFrame:
    """A row for each group: its run_id, window, pair counts, metrics (also as JSON), reference MAE over its last k runs and drift flags.

    Post-dictions are counted before the latest prediction of a target is kept. `runs`: earlier rows of this function, or None.
    """
    found = pairs(get(predictions, target_from=target_from, target_to=target_to), obs, known_at)
    counts = found.groupBy(*by).agg(F.count_if(~F.col("genuine")).alias("n_postdiction"))
    latest = keep_latest(found, tuple(dict.fromkeys(("model_name", "model_version", *(c for c in by if c not in TARGET)))))
    sizes = latest.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.coalesce("censored", F.lit(False))).alias("n_censored"))
    measured = metrics(latest, by)
    names = [c for c in measured.columns if c not in by]
    past = reference_mae(runs, by, k) if runs is not None else measured.select(*by).withColumn("reference_mae", F.lit(None).cast("double"))
    out = drift(measured.join(past, list(by), "left")).join(sizes, list(by)).join(counts, list(by))
    window = {"window_start": F.lit(target_from).cast("date"), "window_end": F.lit(target_to).cast("date"), "obs_known_at": F.lit(known_at).cast("timestamp"), "ran_at": F.lit(ran_at).cast("timestamp")}
    out = out.withColumns(window).withColumn("metrics_json", F.to_json(F.struct(*names)))
    return out.withColumn("run_id", stable_id(F.lit("calibration"), *[F.col(c) for c in by], *[F.col(c).cast("string") for c in window]))


def calibration_history(runs: DataFrame, model_name: str) -> DataFrame:
    return runs.where(F.col("model_name") == model_name).orderBy("ran_at")
