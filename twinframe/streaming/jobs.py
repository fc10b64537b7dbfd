"""The batch operators over streams. Timestamps must be with time zone (session UTC)."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from twinframe.functions.stages import exists, remove
from twinframe.operators import bitemporal, forecasts
from twinframe.operators.facttable import FactTable

#: the state store that timers and several states a key need
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY_MS = 86_400_000


def daily_metrics(stream: DataFrame, lateness: str = "2 days", step_hours: float = 0.25) -> DataFrame:
    """Largest share and customer-hours by unit and UTC day; snapshots (geoid, ts, frac, customers_out)."""
    return stream.withWatermark("ts", lateness).groupBy("geoid", F.window("ts", "1 day")).agg(F.max("frac").alias("max_frac"), (F.sum("customers_out") * step_hours).alias("customer_hours")).select("geoid", F.to_date("window.start").alias("day"), "max_frac", "customer_hours")


def runs(stream: DataFrame, threshold: float = 0.01, lateness: str = "2 days", step_hours: float = 0.25) -> DataFrame:
    """Runs over the threshold as sessions of consecutive quarter hours inside a local day."""
    over = stream.withWatermark("ts", lateness).where(F.col("frac") >= threshold)
    return over.groupBy("geoid", "day", F.session_window("ts", "16 minutes")).agg((F.count(F.lit(1)) * step_hours).alias("hours")).select("geoid", "day", F.col("session_window.start").alias("start"), "hours")


def forecast_pairs(predictions: DataFrame, observations: DataFrame, delay: str = "30 days", horizon: str = "60 days") -> DataFrame:
    """Predictions with later observations of their target; both streams carry their own event time.

    An observation known later than `horizon` after the prediction was issued gives no pair, as the join's state must end
    somewhere; the batch pairs of `operators/forecasts.py` know no such bound and have the rest.
    """
    p = predictions.withWatermark("issued_at", delay).alias("p")
    o = observations.withWatermark("known_at", delay).alias("o")
    same = [F.col(f"p.{c}") == F.col(f"o.{c}") for c in ("geo_level", "geoid", "target_date", "quantity")]
    later = (F.col("o.known_at") > F.col("p.issued_at")) & (F.col("o.known_at") <= F.col("p.issued_at") + F.expr(f"INTERVAL {horizon}"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return p.join(o, on & later).select("p.*", F.col("o.value").alias("obs"), F.col("o.known_at").alias("known_at"))


def fresh_reports(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Reports without those delivered again within `lateness` of their knowledge time; the state of older ones is dropped. A report of
    the same number with another value is not the same one."""
    return stream.withWatermark("known_at", lateness).dropDuplicatesWithinWatermark([*bitemporal.KEY, "known_at", "seq", "value"])


def store_batches(table: FactTable, ledger: str):
    """A foreachBatch function: stores each micro-batch's reports in the fact table, each report with its own knowledge time, and
    enters the batch with its counters in a ledger of one row a batch. A batch that the ledger holds is not stored again; one that
    was stored but not entered changes nothing the second time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, entry = batch.sparkSession, f"{ledger}/batch={batch_id}"
        if not exists(spark, f"{entry}/_SUCCESS"):
            counters = dataclasses.replace(table, spark=spark).upsert(batch)
            spark.createDataFrame([(json.dumps(counters),)], "counters string").coalesce(1).write.mode("overwrite").parquet(entry)

    return write


def _extend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, length = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("valid_date", kind="stable")
    out = []
    for day, hot in zip(rows.valid_date, rows.hot, strict=True):
        now = day.toordinal()
        if last is not None and now <= last:
            out.append((key[0], day, None))
            continue
        length = 0 if pd.isna(hot) or hot != 1 else length + 1 if last is not None and now == last + 1 else 1
        last = now
        out.append((key[0], day, float(length)))
    state.update((last, length))
    yield pd.DataFrame(out, columns=["geoid", "valid_date", "hot_streak"])


def streaks(stream: DataFrame) -> DataFrame:
    """Days (geoid, valid_date, hot) -> the run of hot days up to each, carried over micro-batches by unit.

    Days of a unit must come in order from batch to batch (any order inside one); a day at or before the last one seen gets a
    null streak, not a wrong one. A missing day or a null flag breaks the run.
    """
    days = stream.select("geoid", "valid_date", F.col("hot").cast("double").alias("hot")).where("geoid is not null and valid_date is not null")
    return days.groupBy("geoid").applyInPandasWithState(_extend, "geoid string, valid_date date, hot_streak double", "last long, length long", "append", GroupStateTimeout.NoTimeout)


class DayStreaks(StatefulProcessor):
    """A unit's days wait until the watermark has passed them, and are then counted in order.

    State: the last counted day with its streak, and the waiting days with their flags. Days that the watermark has passed go out with
    the unit's next rows, or when the timer of its last waiting day expires (one timer for each micro-batch of a unit).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day long, length long")
        self.waiting = handle.getMapState("waiting", "day long", "hot double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            for day, hot in zip(part.valid_date, part.hot, strict=True):
                number = (day - dt.date(1970, 1, 1)).days
                latest = number if latest is None else max(latest, number)
                self.waiting.updateValue((number,), (None if pd.isna(hot) else float(hot),))
        if latest is not None:
            self.handle.registerTimer(latest * DAY_MS)
        yield self._counted(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._counted(key, expiredTimerInfo.getExpiryTimeInMs())

    def _counted(self, key, upto: int) -> pd.DataFrame:
        last, length = self.last.get() if self.last.exists() else (None, 0)
        ready = sorted(((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] * DAY_MS <= upto), key=lambda x: x[0])
        out = []
        for day, hot in ready:
            self.waiting.removeKey((day,))
            length = 0 if hot != 1 else length + 1 if last is not None and day == last + 1 else 1
            last = day
            out.append((key[0], dt.date(1970, 1, 1) + dt.timedelta(day), float(length)))
        if ready:
            self.last.update((last, length))
        return pd.DataFrame(out, columns=["geoid", "valid_date", "hot_streak"])

    def close(self) -> None:
        pass


def ordered_streaks(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Days (geoid, valid_date, hot), in any order within `lateness` -> the run of hot days up to each.

    A day is given out after the watermark has passed it; a day later than that is dropped, as by any watermark. Of a day that is
    delivered twice the last stays. Needs the state store of ROCKSDB.
    """
    days = stream.select("geoid", "valid_date", F.col("hot").cast("double").alias("hot"), F.col("valid_date").cast("timestamp").alias("at")).where("geoid is not null and valid_date is not null")
    return days.withWatermark("at", lateness).groupBy("geoid").transformWithStateInPandas(DayStreaks(), "geoid string, valid_date date, hot_streak double", "Append", "EventTime")


def _last_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The latest batch stored under path before this one."""
    return next((k for k in range(batch_id - 1, -1, -1) if exists(spark, f"{path}/batch={k}/_SUCCESS")), None)


def drift_moments(path: str, out: str, by: tuple[str, ...] = ("model_name", "model_version", "quantity")):
    """A foreachBatch function over prediction-observation pairs: keeps each group's moments (a row a group, one folder a batch,
    the last two of them) and writes the metrics and drift flags over all pairs so far of the groups that the batch touches. No
    stored pair is read again, and a replay starts from the batch before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = forecasts.moments(batch, by).withColumn("touched", F.lit(True))
        before = _last_before(spark, path, batch_id)
        rows = own
        if before is not None:
            rows = own.unionByName(spark.read.schema(own.schema).parquet(f"{path}/batch={before}").withColumn("touched", F.lit(False)))
        touched = rows.groupBy(*by).agg(F.max("touched").alias("touched"))
        merged = forecasts.merge_moments(rows, by).join(touched, list(by))
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        stored = spark.read.parquet(f"{path}/batch={batch_id}").where("touched")
        measured = forecasts.drift(forecasts.metrics_of(stored, by))
        measured.withColumn("ran_at", F.lit(dt.datetime.now(dt.UTC))).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if before is not None and (old := _last_before(spark, path, before)) is not None:
            remove(spark, f"{path}/batch={old}")

    return write
