"""What-if scenarios: functions from a wide state to a wide state that keep their lineage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.scalars import rows_hash


@dataclass(frozen=True)
class Scenario:
    name: str
    apply: Callable[[DataFrame], DataFrame]
    spec: dict = field(default_factory=dict)

    def scenario_id(self) -> str:
        return hashlib.sha256(json.dumps({"name": self.name, **self.spec}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]

    def __or__(self, then: Scenario) -> Scenario:
        parts = [*self.spec.get("parts", [[self.name, self.spec]]), *then.spec.get("parts", [[then.name, then.spec]])]
        return Scenario(f"{self.name} | {then.name}", lambda df: df.transform(self.apply).transform(then.apply), {"parts": parts})


@dataclass(frozen=True)
class State:
    """A wide state with what is known of it: when, and the notes of all that was done to it."""

    df: DataFrame
    known_at: str | None = None
    lineage: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)

    @property
    def is_baseline(self) -> bool:
        return not self.lineage

    def derive(self, df: DataFrame, note: str, **meta) -> State:
        return State(df, self.known_at, (*self.lineage, note), {**self.meta, **meta})

    def under(self, scenario: Scenario) -> State:
        """This state under a scenario; each part of a chain leaves its own note, the baseline none."""
        parts = [p for p in scenario.spec.get("parts", [[scenario.name, scenario.spec]]) if p[0] != "baseline"]
        if not parts:
            return self
        notes = tuple(f"{name} {json.dumps(spec, sort_keys=True, separators=(',', ':'))}" for name, spec in parts)
        return State(self.df.transform(scenario.apply), self.known_at, (*self.lineage, *notes), {**self.meta, "scenario_id": scenario.scenario_id()})


def baseline() -> Scenario:
    return Scenario("baseline", lambda df: df)


def last_days(n: int) -> Column:
    """Each unit's last n rows."""
    return F.row_number().over(Window.partitionBy("geoid").orderBy(F.col("valid_date").desc())) <= n


def heatwave(days: int, delta_c: float | None = None, delta_tmin_c: float | None = None, local_pct: float | None = None, var: str = "tmmx", var_min: str = "tmmn", early: bool = False) -> Scenario:
    """Raises each unit's last days by a step, or up to the unit's own percentile; these rows are marked with the number of days.

    The night's column takes its own step (0 counts as none), in the first form the day's step where it has none; it may be absent.
    """
    if (delta_c is None) == (local_pct is None):
        raise ValueError("either delta_c or local_pct")
    if days < 1:
        raise ValueError("days must be 1 or more")
    at_night = delta_tmin_c or delta_c

    def run(df: DataFrame) -> DataFrame:
        cols = df.columns
        df = df.withColumn("in_", last_days(days))

        def raised(col: str, step: float) -> Column:
            return F.col(col) + F.when(F.col("in_"), float(step)).otherwise(0.0)

        if delta_c is not None:
            df = df.withColumn(var, raised(var, delta_c))
        else:
            top = df.groupBy("geoid").agg(F.percentile(var, F.lit(local_pct / 100)).alias("top_"))
            df = df.join(top, "geoid").withColumn(var, F.when(F.col("in_") & F.col(var).isNotNull(), F.greatest(var, "top_")).otherwise(F.col(var)))
        if var_min in cols and at_night is not None:
            df = df.withColumn(var_min, raised(var_min, at_night))
        return df.select(*cols, F.when(F.col("in_"), float(days)).otherwise(0.0).alias("scn_heatwave_days"), F.lit(float(early)).alias("scn_early_season"))

    return Scenario("heatwave", run, {"days": days, "delta_c": delta_c, "delta_tmin_c": delta_tmin_c, "local_pct": local_pct, "early": early, "var": var, "var_min": var_min})


def blackout(frac: float, hours: float, days: int = 1) -> Scenario:
    """An outage of at least this share and length on the last days."""
    if not 0 <= frac <= 1:
        raise ValueError("frac must lie in [0, 1]")

    def run(df: DataFrame) -> DataFrame:
        inside, out = last_days(days), df
        for col, v in (("outage_customers_frac", frac), ("outage_max_hours", hours)):
            old = F.col(col) if col in df.columns else F.lit(0.0)
            out = out.withColumn(col, F.when(inside, F.greatest(old, F.lit(float(v)))).otherwise(old))
        return out

    return Scenario("blackout", run, {"frac": frac, "hours": hours, "days": days})


def outage_profile(history: DataFrame, pct: float) -> DataFrame:
    return history.groupBy("geoid").agg(F.percentile("outage_customers_frac", F.lit(pct / 100)).alias("frac_"), F.percentile("outage_max_hours", F.lit(pct / 100)).alias("hours_"))


def blackout_from_history(history: DataFrame, pct: float, days: int = 1, history_id: str | None = None) -> Scenario:
    """As blackout, by each unit's own history; units without one stay. `history_id` names the history in the scenario's id; without
    it the id follows from the profiles' content (one small job)."""
    if history_id is None:
        profile = outage_profile(history, pct)
        history_id = profile.agg(rows_hash(*sorted(profile.columns)).alias("h")).first().h

    def run(df: DataFrame) -> DataFrame:
        out = df.withColumn("in_", last_days(days)).join(outage_profile(history, pct), "geoid", "left")
        for col, v in (("outage_customers_frac", "frac_"), ("outage_max_hours", "hours_")):
            old = F.col(col) if col in df.columns else F.lit(0.0)
            out = out.withColumn(col, F.when(F.col("in_"), F.greatest(old, F.coalesce(v, F.lit(0.0)))).otherwise(old))
        return out.drop("in_", "frac_", "hours_")

    return Scenario("blackout_from_history", run, {"pct": pct, "days": days, "history": str(history_id)})


def cooled(value: Column, middle: Column, eps: Column) -> Column:
    return middle + (value - middle) * (F.lit(1.0) - eps)


def cooling(eps: float, var: str = "tmmx") -> Scenario:
    """Shrinks each unit's anomaly from its median by eps."""

    def run(df: DataFrame) -> DataFrame:
        m = df.groupBy("geoid").agg(F.median(var).alias("m_"))
        return df.join(m, "geoid").withColumn(var, cooled(F.col(var), F.col("m_"), F.lit(eps))).withColumn("scn_cooling", F.lit(eps)).drop("m_")

    return Scenario("cooling", run, {"eps": eps, "var": var})


def cooling_sweep(df: DataFrame, values: list[float], var: str = "tmmx") -> DataFrame:
    """All values of eps in one job: (eps, the state's columns)."""
    m = df.groupBy("geoid").agg(F.median(var).alias("m_"))
    each = df.join(m, "geoid").withColumn("eps", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return each.withColumn(var, cooled(F.col(var), F.col("m_"), F.col("eps"))).drop("m_")


def apply_many(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """The state under each scenario, with its id."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.apply(df).withColumn("scenario_id", F.lit(s.scenario_id())) for s in scenarios])


def diff(base: DataFrame, new: DataFrame, variables: list[str]) -> DataFrame:
    """Cells that differ, null being equal to null."""
    long = [d.select("geoid", "valid_date", *variables).unpivot(["geoid", "valid_date"], variables, "variable", name) for d, name in ((base, "base"), (new, "new"))]
    return long[0].join(long[1], ["geoid", "valid_date", "variable"]).where(~F.col("base").eqNullSafe(F.col("new")))


#: fixed values: the constants of the risk formula
RISK = {"comfort": 35.0, "per_degree": 0.18, "per_outage": 4.5, "relief": 0.8, "floor": 0.99, "base_rate": 0.12, "most": 0.95, "hot": 37.0, "dark": 0.05}


def risk_summary(base: DataFrame, new: DataFrame, eps: float = 0.0) -> DataFrame:
    """One row: mean exposures, relative risk and its parts."""
    def one(df: DataFrame, p: str) -> DataFrame:
        return df.agg(F.avg("tmmx").alias(f"{p}_tmax_mean"), F.max("tmmx").alias(f"{p}_tmax_max"), F.avg("outage_customers_frac").alias(f"{p}_outage_mean"))

    s = one(base, "base").join(F.broadcast(one(new, "new")))  # one row each
    k = RISK
    parts = s.withColumns({
        "heat_": k["per_degree"] * F.greatest(F.col("new_tmax_mean") - k["comfort"], F.lit(0.0)),
        "power_": k["per_outage"] * F.coalesce("new_outage_mean", F.lit(0.0)),
    })
    parts = parts.withColumn("rr_", F.greatest(F.col("heat_") + F.col("power_") + (1.0 - k["relief"] * eps), F.lit(1.0)))
    shares = {name: F.when(F.col("rr_") <= 1, 0.0).otherwise(F.round(100 * F.least(F.greatest(F.col(c) / (F.col("rr_") - k["floor"]), F.lit(0.0)), F.lit(1.0)), 1)) for name, c in (("thermal_pct", "heat_"), ("blackout_pct", "power_"))}
    out = parts.withColumns({
        **shares, "cooling_pct": F.lit(round(100 * k["relief"] * eps, 1)), "relative_risk": F.round("rr_", 3), "excess_pct": F.round(100 * (F.col("rr_") - 1), 1),
        "p_scenario": F.round(F.least(k["base_rate"] * F.col("rr_"), F.lit(k["most"])), 4), "compound_flag": (F.col("new_tmax_mean") >= k["hot"]) & (F.col("new_outage_mean") >= k["dark"])})
    return out.drop("heat_", "power_", "rr_")


#: fixed values: place names and their ids
PLACES = {"arizona": "04", "az": "04", "phoenix": "04", "maricopa": "04", "louisiana": "22", "luisiana": "22", "la": "22", "new orleans": "22", "nueva orleans": "22", "florida": "12", "fl": "12", "texas": "48", "tx": "48", "california": "06", "ca": "06", "new york": "36", "nueva york": "36", "ny": "36"}


#: fixed values: codes that count when they stand alone in a request
CODES = ("04", "22", "12", "48", "06", "36", "01", "08", "53")
#: fixed values: words of a request. Units stand behind a number, cues before it, fillers between a cue and its number
DAYS, DEGREES, PERCENT, HOURS = ("días", "dias", "day"), ("°c", "c", "grados", "deg"), ("%",), ("hora", "hr", "hour")
BLACKOUT_CUES, COOLING_CUES, PERCENTILE_CUES = ("apagón", "apagon"), ("enfriamiento", "cooling", "centro"), ("p", "percentil")
BLACKOUT_FILLERS, COOLING_FILLERS = ("de", "por"), ("de", "del")
#: fixed values: words that name an event
EVENTS = {"heat": ("ola de calor", "calor extremo", "heatwave"), "blackout": ("apagón", "apagon", "corte de luz", "blackout"), "cooling": ("enfriamiento", "cooling center")}


def tokens(text: Column) -> Column:
    """A request's numbers, words (with a degree sign before them) and other signs, in order."""
    return F.regexp_extract_all(text, F.lit(r"[+-]?\d+(?:\.\d+)?|°?\p{L}+|\S"), F.lit(0))


@dataclass(frozen=True)
class Slot:
    """A number told by its neighbours: the word behind it begins with a unit, the word before it (or before a filler) ends with a cue.

    kind: signed and decimal numbers as they stand (decimal without a sign), whole: the digits next to the unit, pair: the first two
    digits.
    """

    units: tuple[str, ...] = ()
    cues: tuple[str, ...] = ()
    fillers: tuple[str, ...] = ()
    kind: str = "decimal"
    scale: float = 1.0

    def read(self, found: Column, numbers: Column) -> Column:
        """The slot's number in a request's tokens; numbers: the places from 0 where one begins with a digit or a signed one."""
        at = lambda i: F.coalesce(F.get(found, i), F.lit(""))
        begins = lambda word: reduce(Column.__or__, [F.startswith(word, F.lit(u)) for u in self.units])
        ends = lambda word: reduce(Column.__or__, [F.endswith(word, F.lit(c)) for c in self.cues])

        def fits(i: Column) -> Column:
            ok = at(i).rlike(r"^[+-]?\d\d") if self.kind == "pair" else F.lit(True)
            if self.units:
                ok = ok & begins(at(i + 1))
            if self.cues:
                near = ends(at(i - 1))
                ok = ok & (near | (at(i - 1).isin(*self.fillers) & ends(at(i - 2))) if self.fillers else near)
            return ok

        first = F.get(F.filter(numbers, fits), F.lit(0))
        number = F.get(found, first)
        if self.kind != "signed":
            number = F.ltrim(number, F.lit("+-"))
        if self.kind == "whole":
            number = F.element_at(F.split(number, r"\."), -1)
        if self.kind == "pair":
            number = F.substring(number, 1, 2)
        return number.try_cast("double") / self.scale


SLOTS = {
    "heatwave_days": Slot(DAYS, kind="whole"),
    "heatwave_delta_c": Slot(DEGREES, kind="signed"),
    "heatwave_percentile": Slot(cues=PERCENTILE_CUES, kind="pair"),
    "blackout_frac": Slot(PERCENT, scale=100.0),
    "blackout_hours": Slot(HOURS),
    "blackout_days": Slot(DAYS, BLACKOUT_CUES, BLACKOUT_FILLERS, kind="whole"),
    "cooling_epsilon": Slot(PERCENT, COOLING_CUES, COOLING_FILLERS, scale=100.0),
}


def extract_params(df: DataFrame, text: str, valid_from: str | None = None, valid_to: str | None = None, geo_level: str = "state") -> DataFrame:
    """Scenario parameters read from each row's request: the numbers of SLOTS, and where one is missing what its event implies.

    Adds geoids (by name, then by bare code; the first place where there is none), the slots' columns, geo_level and the window.
    """
    q = F.col("q_")
    named = F.array(*[F.when(q.rlike(rf"\b{n}\b"), F.lit(i)) for n, i in PLACES.items()])
    coded = F.filter(F.regexp_extract_all(q, F.lit(r"\b(\d{2})\b"), 1), lambda c: c.isin(*CODES))
    places = F.array_distinct(F.concat(F.array_compact(named), coded))
    # columns of their own, so that a request is matched once and not at each place of each slot, and slots look at its numbers alone
    read = df.withColumn("q_", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("found_", tokens(q))
    whole = F.sequence(F.lit(0), F.size("found_"))  # one place more than there are tokens
    read = read.withColumn("places_", places).withColumn("numbers_", F.filter(whole, lambda i: F.coalesce(F.get("found_", i).rlike(r"^[+-]?\d"), F.lit(False))))
    said = read.withColumns({"geoids": F.when(F.size("places_") > 0, F.col("places_")).otherwise(F.array(F.lit(next(iter(PLACES.values()))))), **{name: slot.read(F.col("found_"), F.col("numbers_")) for name, slot in SLOTS.items()}, **{f"{e}_": reduce(Column.__or__, [F.contains(q, F.lit(w)) for w in words]) for e, words in EVENTS.items()}}).drop("q_", "found_", "places_", "numbers_")

    def or_implied(col: str, *implied: tuple[Column, float]) -> Column:
        return F.coalesce(col, *[F.when(condition, value) for condition, value in implied])

    always = F.lit(True)
    out = said.withColumns({"heatwave_days": or_implied("heatwave_days", (F.col("heat_"), 5.0), (always, 0.0)).cast("int"), "blackout_frac": or_implied("blackout_frac", (F.col("blackout_"), 0.2), (always, 0.0)), "cooling_epsilon": or_implied("cooling_epsilon", (F.col("cooling_"), 0.15), (always, 0.0)), "blackout_days": or_implied("blackout_days", (always, 1.0)).cast("int")})
    out = out.withColumns({"heatwave_percentile": or_implied("heatwave_percentile", (F.col("heatwave_delta_c").isNull() & (F.col("heatwave_days") > 0), 95.0)), "blackout_hours": or_implied("blackout_hours", (F.col("blackout_frac") > 0, 12.0), (always, 0.0))})
    return out.withColumns({"geo_level": F.lit(geo_level), "valid_from": F.lit(valid_from).cast("date"), "valid_to": F.lit(valid_to).cast("date")}).drop(*[f"{e}_" for e in EVENTS])
