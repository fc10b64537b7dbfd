"""Facts as a stored table of validity intervals, laid out for their keys.

A row is one revision with the time it became known and the time the next one replaced it (null: it stands), so a state as known
at a time is a filter of the scan, without any window. The table is partitioned by the year of the fact's day and bucketed and
sorted by the natural key: an upsert joins its batch to the buckets where they lie (only the batch is shuffled), and overwrites
only the years that the batch touches, with one file a bucket. So no revision folders pile up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.functions.stages import hadoop_path, written
from twinframe.operators.bitemporal import KEY, changed, collapse

INTERVAL = "geo_level string, geoid string, valid_date date, variable string, source string, value double, known_at timestamp, superseded_at timestamp, revision int"
COLUMNS = ("value", "known_at", "superseded_at", "revision")


def intervals(history: DataFrame) -> DataFrame:
    """All revisions of facts -> with superseded_at, the time of the next one."""
    return history.withColumn("superseded_at", F.lead("known_at").over(Window.partitionBy(*KEY).orderBy("revision"))).select(*KEY, *COLUMNS)


def standing(rows: DataFrame, known_at) -> DataFrame:
    """The revisions that stood at a time: two comparisons, which reach the scan."""
    at = F.lit(known_at).cast("timestamp")
    return rows.where((F.col("known_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))


def as_of_join(points: DataFrame, rows: DataFrame, on: list[str], at: str, span_days: int = 365, horizon="2100-01-01") -> DataFrame:
    """Each point with what was known of its `on` columns at its own time `at`; points without any are left out.

    Intervals and points meet by `on` and by spans of time, so that a key with very many revisions or points is dealt over its
    spans. An interval stands in each span that it overlaps; one that still stands reaches to the last point's span.
    """
    size = span_days * 86400
    span = lambda c: F.floor(F.unix_seconds(c) / size)
    last = points.agg(F.max(at)).first()[0]
    end = F.least(F.coalesce("superseded_at", F.lit(horizon).cast("timestamp")), F.lit(last).cast("timestamp"))
    kept = [c for c in rows.columns if c not in on]
    spread = rows.where(F.col("known_at") <= F.lit(last).cast("timestamp")).withColumn("span_", F.explode(F.sequence(span(F.col("known_at")), F.greatest(span(F.col("known_at")), span(end)))))
    met = points.withColumn("span_", span(F.col(at))).alias("p").join(spread.alias("f"), [*on, "span_"])
    stood = (F.col("f.known_at") <= F.col(f"p.{at}")) & (F.col("f.superseded_at").isNull() | (F.col("f.superseded_at") > F.col(f"p.{at}")))
    return met.where(stood).select(*[F.col(c) for c in on], *[F.col(f"p.{c}") for c in points.columns if c not in on], *[F.col(f"f.{c}").alias(f"fact_{c}" if c in points.columns else c) for c in kept])


def news(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """reports (KEY, value, known_at; one row of a key and time) against the stored rows of their keys -> a row for each key with
    news: closes (when the standing row ends, null for a new key) and fresh, its new revisions in order.

    A report known before the standing revision is no news if its value stood at that time (a replay), and else stops the job, as
    does a null in a key.
    """
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in KEY]) == 1
    checked = reports.withColumn("value", F.when(null, F.raise_error(F.lit("a null in a key")).cast("double")).otherwise(F.col("value")))
    now = stored.where("superseded_at IS NULL").select(*KEY, F.col("value").alias("was"), F.col("known_at").alias("since"), F.col("revision").alias("number"))
    past = stored.where("superseded_at IS NOT NULL").select(*KEY, F.col("value").alias("then"), F.col("known_at").alias("from"), "superseded_at")
    met = checked.join(now, list(KEY), "left")
    late = F.coalesce(F.col("r.known_at") < F.col("r.since"), F.lit(False))
    stood = reduce(Column.__and__, [F.col(f"r.{c}") == F.col(f"p.{c}") for c in KEY]) & late & (F.col("p.from") <= F.col("r.known_at")) & (F.col("r.known_at") < F.col("p.superseded_at"))
    met = met.alias("r").join(past.alias("p"), stood, "left").withColumn("late_", late)
    wrong = F.col("late_") & (F.col("from").isNull() | changed(F.col("r.value"), F.col("then")))
    value = F.when(wrong, F.raise_error(F.lit("a changed value would be known before the revision it replaces")).cast("double")).otherwise(F.col("r.value"))
    met = met.select(*[F.col(f"r.{c}") for c in KEY], value.alias("value"), "r.known_at", "was", "since", "number", "late_").where(~F.col("late_") | F.col("value").isNaN())
    by = Window.partitionBy(*KEY).orderBy("known_at")
    first = F.row_number().over(by) == 1
    before = F.when(first, F.col("was")).otherwise(F.lag("value").over(by))
    kept = met.withColumn("new_", (first & F.col("number").isNull()) | changed(F.col("value"), before)).where("new_")
    numbered = kept.select(*KEY, "value", "known_at", F.lead("known_at").over(by).alias("superseded_at"), (F.coalesce("number", F.lit(-1)) + F.row_number().over(by)).cast("int").alias("revision"), "since")
    row = F.struct(*COLUMNS)
    return numbered.groupBy(*KEY).agg(F.when(F.max("since").isNotNull(), F.min("known_at")).alias("closes"), F.sort_array(F.collect_list(F.struct("revision", row.alias("row")))).alias("fresh"))


@dataclass(frozen=True)
class FactTable:
    """A named table at a path; one writer at a time."""

    spark: SparkSession
    name: str
    path: str
    buckets: int = 16

    def open(self) -> FactTable:
        """Makes the table, or finds what is stored at its path."""
        keys = ", ".join(KEY)
        fs, at = hadoop_path(self.spark, self.path)
        fs.mkdirs(at)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({INTERVAL}, year int) USING parquet PARTITIONED BY (year) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.recoverPartitions(self.name)
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def as_of(self, known_at, **equal) -> DataFrame:
        """The state as known at a time; `equal`: columns and the values they may have. The days' range prunes partitions."""
        rows = self.rows()
        lo, hi = equal.pop("valid_from", None), equal.pop("valid_to", None)
        if lo is not None:
            rows = rows.where((F.col("year") >= F.year(F.lit(lo).cast("date"))) & (F.col("valid_date") >= F.lit(lo).cast("date")))
        if hi is not None:
            rows = rows.where((F.col("year") <= F.year(F.lit(hi).cast("date"))) & (F.col("valid_date") <= F.lit(hi).cast("date")))
        for c, values in equal.items():
            rows = rows.where(F.col(c).isin(values))
        return standing(rows, known_at).select(*KEY, "value", "known_at", "revision")

    def _overwrite(self, rows: DataFrame) -> None:
        """Replaces the years that rows have."""
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.select(*KEY, *COLUMNS, F.year("valid_date").alias("year")).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)
        self.spark.catalog.refreshTable(self.name)

    def create(self, history: DataFrame) -> None:
        """Fills the table from all revisions of facts."""
        self._overwrite(intervals(history).repartition(self.buckets, *KEY))

    def upsert(self, reports: DataFrame, now=None) -> dict[str, int]:
        """Stores reports (KEY, value, known_at, seq), which may be of several times; gives counters, observed on the write itself."""
        limit = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        future = F.col("known_at") > limit + F.expr("INTERVAL 1 SECOND")
        seen, kept, out = Observation(), Observation(), Observation()
        batch = reports.withColumn("value", F.when(future, F.raise_error(F.lit("known_at lies in the future")).cast("double")).otherwise(F.col("value"))).observe(seen, F.count(F.lit(1)).alias("n"))
        one = collapse(batch, (*KEY, "known_at")).observe(kept, F.count(F.lit(1)).alias("n")).select(*KEY, "value", "known_at")
        # the batch is known to be small against the table: its years tell which partitions are read and replaced
        years = [r[0] for r in reports.select(F.year("valid_date")).distinct().collect() if r[0] is not None]
        stored = self.rows().where(F.col("year").isin(years)) if years else self.rows().limit(0)
        new = news(stored, one)
        later = F.filter("fresh", lambda x: x["revision"] > 0)
        new = written(new.observe(out, F.coalesce(F.sum(F.size("fresh")), F.lit(0)).alias("written"), F.coalesce(F.sum(F.size(later)), F.lit(0)).alias("revisions")), "news")
        counters = {"received": seen.get["n"], "collapsed": seen.get["n"] - kept.get["n"], "written": out.get["written"], "revisions": out.get["revisions"], "unchanged": kept.get["n"] - out.get["written"]}
        if counters["written"]:
            touched = [r[0] for r in new.select(F.year("valid_date")).distinct().collect()]
            self._overwrite(self._merged(self.rows().where(F.col("year").isin(touched)), new))
        return counters

    def _merged(self, stored: DataFrame, new: DataFrame) -> DataFrame:
        """Stored rows with their ends, and the new revisions; the stored side of the join stays in its buckets."""
        row = F.struct(*COLUMNS)
        own = stored.select(*KEY, row.alias("row"))
        met = own.join(new, list(KEY), "full")
        ended = F.when(F.col("row.superseded_at").isNull() & F.col("closes").isNotNull(), F.col("row").withField("superseded_at", F.col("closes"))).otherwise(F.col("row"))
        first = F.col("row").isNull() | F.col("row.superseded_at").isNull()  # of a key's rows the standing one brings the new ones along
        fresh = F.when(first, F.transform("fresh", lambda x: x["row"]))
        none = F.array().cast(own.select(F.array("row")).schema[0].dataType)
        each = F.concat(F.when(F.col("row").isNotNull(), F.array(ended)).otherwise(none), F.coalesce(fresh, none))
        return met.select(*KEY, F.explode(each).alias("r")).select(*KEY, "r.*")
