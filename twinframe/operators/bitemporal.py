"""Revisioned facts on two time axes: the day a fact describes and the moment it became known.

Windows are partitioned by the natural key's columns (not by its hash), so that filters on them reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from twinframe.functions.scalars import rows_hash, stable_id

# fixed values: the columns of a fact's natural key, and the geographic levels
KEY = ("geo_level", "geoid", "valid_date", "variable", "source")
LEVELS = ("nation", "hhs_region", "state", "county", "tract", "zcta")
FACT = "geo_level string, geoid string, valid_date date, variable string, source string, value double, known_at timestamp, revision int"


def require(df: DataFrame, *cols: str) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def coerce(df: DataFrame, schema: str = "geo_level string, geoid string, valid_date date, variable string, value double") -> DataFrame:
    """The schema's columns in their types, then the others as they are: text is trimmed, numbers and days that can't be read are
    null, geo levels are checked. A missing column stops the load."""
    wanted = StructType.fromDDL(schema)
    require(df, *wanted.names)

    def read(f: StructField) -> Column:
        text = isinstance(df.schema[f.name].dataType, StringType)
        if isinstance(f.dataType, StringType):
            return F.trim(F.col(f.name).cast("string")).alias(f.name)
        return (F.trim(f.name).try_cast(f.dataType) if text else F.col(f.name).try_cast(f.dataType)).alias(f.name)

    out = df.select(*[read(f) for f in wanted], *[c for c in df.columns if c not in wanted.names])
    return check_levels(out) if "geo_level" in wanted.names else out


def check_levels(df: DataFrame) -> DataFrame:
    bad = df.where(~F.col("geo_level").isin(*LEVELS) | F.col("geo_level").isNull()).select("geo_level").limit(1).collect()
    if bad:
        raise ValueError(f"unknown geo level: {bad[0][0]}")
    return df


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def latest_per(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_ = 1").drop("nth_")


def collapse(df: DataFrame, keys: tuple[str, ...] = KEY, seq: str = "seq") -> DataFrame:
    """Last row of each key by the ingest sequence; of several with one number that of the greatest value, null being the least."""
    return latest_per(require(df, seq), keys, F.col(seq).desc(), *[F.col(c).desc() for c in ("value",) if c in df.columns])


def history_from_reports(reports: DataFrame) -> DataFrame:
    """All revisions of a bulk load: last report of each knowledge time (as collapse has it), unchanged values dropped, numbered from
    0. All windows share the key's one shuffle."""
    latest = Window.partitionBy(*KEY).orderBy(F.col("known_at").desc(), F.col("seq").desc(), F.col("value").desc())
    last = require(reports, "seq").withColumn("next_", F.lag("known_at").over(latest)).where(F.col("next_").isNull() | (F.col("next_") != F.col("known_at")))
    by = Window.partitionBy(*KEY).orderBy("known_at")
    kept = last.withColumn("n_", F.row_number().over(by)).withColumn("was_", F.lag("value").over(by)).where((F.col("n_") == 1) | changed(F.col("value"), F.col("was_")))
    return kept.select(*KEY, "value", "known_at", (F.row_number().over(by) - 1).alias("revision"))


def as_of(facts: DataFrame, known_at=None, geo_level: str | None = None, valid_from=None, valid_to=None, variables=None, geoids=None) -> DataFrame:
    """Latest revision of each fact among those known at a time; the time filter stays below the ranking."""
    for col, values in (("variable", variables), ("geoid", geoids)):
        if values is not None:
            facts = facts.where(F.col(col).isin(*values))
    if geo_level is not None:
        facts = facts.where(F.col("geo_level") == geo_level)
    if valid_from is not None:
        facts = facts.where(F.col("valid_date") >= F.lit(valid_from).cast("date"))
    if valid_to is not None:
        facts = facts.where(F.col("valid_date") <= F.lit(valid_to).cast("date"))
    if known_at is not None:
        facts = facts.where(F.col("known_at") <= F.lit(known_at).cast("timestamp"))
    return latest_per(facts, KEY, F.col("revision").desc())


def snapshot(facts: DataFrame, variables: list[str], priority: list[str] | None = None, **filters) -> DataFrame:
    """Wide state: a column for each variable; of several sources the first by priority, then by name; all-null rows go."""
    state = as_of(facts, variables=variables, **filters)
    rank = reduce(lambda a, s: F.when(F.col("source") == s[1], F.lit(s[0])).otherwise(a), reversed(list(enumerate(priority or []))), F.lit(len(priority or [])))
    wide = state.where("value is not null").groupBy("geoid", "valid_date").pivot("variable", variables).agg(F.min_by("value", F.struct(rank, F.col("source"))))
    return wide.dropna("all", subset=variables)


def snapshot_meta(facts: DataFrame, **filters) -> DataFrame:
    """One row of what a snapshot is made from: number of facts, sources, window, and the latest knowledge in it."""
    state = as_of(facts, **filters)
    return state.agg(F.count(F.lit(1)).alias("n_facts"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("valid_date").alias("valid_from"), F.max("valid_date").alias("valid_to"), F.max("known_at").alias("known_at"))


def to_facts(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return wide.unpivot(keys, variables, "variable", "value")


def history(facts: DataFrame, **key: str) -> DataFrame:
    return facts.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in key.items()])).orderBy(*KEY, "revision")


def revised(facts: DataFrame) -> DataFrame:
    """Full history of the facts that have a revision."""
    keys = facts.groupBy(*KEY).agg(F.max("revision").alias("m_")).where("m_ > 0").drop("m_")
    return facts.join(keys, list(KEY), "left_semi")


def first_known(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*KEY).agg(F.min("known_at").alias("first_known_at"))


def coverage(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source", "geo_level", "variable").agg(
        F.count_distinct("geoid").alias("n_geoids"), F.min("valid_date").alias("first_date"), F.max("valid_date").alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.max("revision").alias("max_revision"))


def inventory(facts: DataFrame) -> DataFrame:
    return facts.groupBy("geo_level", "variable", "source").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("geoid").alias("n_geoids"), F.min("valid_date").alias("first_date"), F.max("valid_date").alias("last_date"))


def state_id(state: DataFrame) -> DataFrame:
    """One row: a content hash that doesn't depend on the order of rows."""
    return state.agg(rows_hash(*sorted(state.columns)).alias("state_id"))


def manifest(batch: DataFrame) -> DataFrame:
    """One row for a written batch: rows, content hash, knowledge range."""
    m = batch.agg(F.count(F.lit(1)).alias("n_rows"), rows_hash(*sorted(batch.columns)).alias("content"), F.min("known_at").alias("first_known_at"), F.max("known_at").alias("last_known_at"))
    return m.withColumn("manifest_id", F.sha2(F.to_json(F.struct(*m.columns)), 256))


def new_revisions(facts: DataFrame, batch: DataFrame, known_at) -> DataFrame:
    """Rows to append for a batch (one row a key): new keys, and changed values with the next revision. Only the history of the
    batch's keys is ranked."""
    batch = batch.select(*KEY, F.col("value").alias("new_"))
    known = latest_per(facts.join(batch.select(*KEY), list(KEY), "left_semi"), KEY, F.col("revision").desc())
    both = batch.join(known.select(*KEY, F.col("value").alias("old_"), "revision"), list(KEY), "left")
    return both.where(F.col("revision").isNull() | changed(F.col("new_"), F.col("old_"))).select(*KEY, F.col("new_").alias("value"), F.lit(known_at).cast("timestamp").alias("known_at"), F.coalesce(F.col("revision") + 1, F.lit(0)).alias("revision"))


def upsert(facts: DataFrame, batch: DataFrame, known_at, now=None) -> tuple[DataFrame, dict[str, int]]:
    """Rows to append and counters. Raises if the knowledge time lies in the future, or if a changed value would be known before
    the revision it replaces."""
    spark = facts.sparkSession
    limit = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    if spark.range(1).where(F.lit(known_at).cast("timestamp") > limit + F.expr("INTERVAL 1 SECOND")).count():
        raise ValueError("known_at lies in the future")
    one = collapse(batch, KEY, "seq") if "seq" in batch.columns else batch
    fresh = new_revisions(facts, one, known_at)
    late = fresh.where("revision > 0").select(*KEY).join(facts.where(F.col("known_at") > F.lit(known_at).cast("timestamp")).select(*KEY).distinct(), list(KEY), "left_semi")
    if not late.isEmpty():
        raise ValueError("a changed value would be known before the revision it replaces")
    received, kept = batch.count(), one.count()
    written = fresh.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("revision") > 0).alias("r")).first()
    return fresh, {"received": received, "collapsed": received - kept, "written": written.n, "revisions": written.r, "unchanged": kept - written.n}


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("geo_level", "source").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT).parquet(path)


def fact_key() -> Column:
    return stable_id(*[F.col(c) for c in KEY])


def validate(df: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One row: null keys and surplus rows of the natural key."""
    null = reduce(Column.__or__, [F.col(c).isNull() for c in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).agg(F.coalesce(F.sum(F.when(null, F.col("n_"))), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("n_"), F.lit(0)).alias("n_rows"))
