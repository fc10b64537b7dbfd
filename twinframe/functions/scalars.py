"""Column functions: ids, lenient parsing, heat index, periods, row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def to_number(text: Column) -> Column:
    """Number, or null for blank and unreadable text."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def parse_ts(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm")) -> Column:
    """Timestamp in the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_period(period: Column, period_id: Column | None = None) -> Column:
    """Anchor date of a year, a range of years or an ISO day; falls back to the id."""

    def one(c: Column) -> Column:
        return (
            F.when(c.rlike(r"^\d{4}$") | c.rlike(r"^\d{4}-\d{4}$"), F.make_date(F.substring(c, 1, 4).try_cast("int"), F.lit(1), F.lit(1)))
            .when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
        )

    first = one(F.trim(period))
    return first if period_id is None else F.coalesce(first, one(F.trim(period_id.cast("string"))))


def variable_name(measure: Column, calculation: Column, known: dict[str, str] | None = None) -> Column:
    """Canonical variable name of a measure and its calculation type."""
    base = F.concat(F.lit("m"), measure.cast("string"))
    if known:
        names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        base = F.coalesce(F.try_element_at(names, measure.cast("string")), base)
    kind = F.regexp_replace(F.lower(F.trim(calculation)), r"[^a-z0-9]+", "_")
    return F.concat_ws("_", base, F.nullif(kind, F.lit("")))


def heat_index_c(t: Column, rh: Column) -> Column:
    """US National Weather Service heat index in deg C of a temperature in deg C and a relative humidity in percent."""
    f = t * 1.8 + 32
    simple = (f + 61 + (f - 68) * 1.2 + rh * 0.094) * 0.5
    # fixed values: the published regression
    full = F.lit(-42.379) + f * 2.04901523 + rh * 10.14333127 - f * rh * 0.22475541 - f * f * 0.00683783 - rh * rh * 0.05481717 + f * f * rh * 0.00122874 + f * rh * rh * 0.00085282 - f * f * rh * rh * 0.00000199
    dry = full - (F.lit(13) - rh) / 4 * F.sqrt((F.lit(17) - F.abs(f - 95)) / 17)
    humid = full + (rh - 85) / 10 * ((F.lit(87) - f) / 5)
    out = F.when((simple + f) / 2 < 80, simple).when((rh < 13) & f.between(80, 112), dry).when((rh > 85) & f.between(80, 87), humid).otherwise(full)
    return F.when(t.isNotNull() & rh.isNotNull(), (out - 32) / 1.8)


HEAT_INDEX_SQL = """CASE WHEN {t} IS NULL OR {rh} IS NULL THEN NULL ELSE ((CASE
 WHEN ((({f}) + 61 + (({f}) - 68) * 1.2 + {rh} * 0.094) * 0.5 + ({f})) / 2 < 80 THEN (({f}) + 61 + (({f}) - 68) * 1.2 + {rh} * 0.094) * 0.5
 WHEN {rh} < 13 AND ({f}) BETWEEN 80 AND 112 THEN {full} - (13 - {rh}) / 4 * sqrt((17 - abs(({f}) - 95)) / 17)
 WHEN {rh} > 85 AND ({f}) BETWEEN 80 AND 87 THEN {full} + ({rh} - 85) / 10 * ((87 - ({f})) / 5)
 ELSE {full} END) - 32) / 1.8 END"""


def heat_index_sql(t: str, rh: str) -> str:
    """The same in SQL, for the oracle."""
    f = f"{t} * 1.8 + 32"
    full = f"(-42.379::DOUBLE + ({f}) * 2.04901523 + {rh} * 10.14333127 - ({f}) * {rh} * 0.22475541 - ({f}) * ({f}) * 0.00683783 - {rh} * {rh} * 0.05481717 + ({f}) * ({f}) * {rh} * 0.00122874 + ({f}) * {rh} * {rh} * 0.00085282 - ({f}) * ({f}) * {rh} * {rh} * 0.00000199)"
    return HEAT_INDEX_SQL.format(t=t, rh=rh, f=f, full=full)


def rows_hash(*cols: str) -> Column:
    """Aggregate: content hash of a group of rows, whatever their order."""
    h = F.xxhash64(*cols)
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")), 256)
