"""Amounts, units and periods written in text, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each unit's dimension and its size in the common unit of that dimension.
UNITS = {
    "mg": ("mg", 1.0), "mgs": ("mg", 1.0), "milligram": ("mg", 1.0), "milligrams": ("mg", 1.0),
    "mcg": ("mg", 1e-3), "mcgs": ("mg", 1e-3), "ug": ("mg", 1e-3), "µg": ("mg", 1e-3), "μg": ("mg", 1e-3), "microgram": ("mg", 1e-3), "micrograms": ("mg", 1e-3),
    "ng": ("mg", 1e-6), "nanogram": ("mg", 1e-6), "nanograms": ("mg", 1e-6),
    "g": ("mg", 1e3), "gm": ("mg", 1e3), "gms": ("mg", 1e3), "gram": ("mg", 1e3), "grams": ("mg", 1e3),
    "kg": ("mg", 1e6), "kilogram": ("mg", 1e6), "kilograms": ("mg", 1e6),
    "u": ("units", 1.0), "unit": ("units", 1.0), "units": ("units", 1.0), "iu": ("units", 1.0), "ius": ("units", 1.0), "ie": ("units", 1.0),
    "meq": ("mEq", 1.0), "meqs": ("mEq", 1.0), "milliequivalent": ("mEq", 1.0), "milliequivalents": ("mEq", 1.0), "eq": ("mEq", 1e3),
}
#: Words and signs that multiply a unit of activity.
SCALES = {"k": 1e3, "thousand": 1e3, "x1000": 1e3, "thou": 1e3, "m": 1e6, "million": 1e6, "mio": 1e6, "mill": 1e6}
#: Periods as times per day.
PERIODS = {"d": 1.0, "day": 1.0, "days": 1.0, "daily": 1.0, "24h": 1.0, "wk": 1 / 7, "week": 1 / 7, "weeks": 1 / 7, "weekly": 1 / 7, "fortnight": 1 / 14, "fortnightly": 1 / 14, "biweekly": 1 / 14, "h": 24.0, "hr": 24.0, "hour": 24.0, "hourly": 24.0, "rate": 24.0, "min": 1440.0, "minute": 1440.0}

_NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d*[.,]\d+|\d+)"
_SCALE = r"(x\s?1,?000|thousand|thou\.?|million|mio\.?|mill\.?|k|m)"
_UNIT = "(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r"|i\.\s?u\.?|m\s?eq)"
_PERIOD = r"(?:/\s*|\bper\s+|\ba\s+)([\w ]+?)\.?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def to_number(text: Column) -> Column:
    """1,500 and 12,5 and 12.5 as a double: a comma before exactly three digits groups them, else it is the point."""
    plain = F.when(text.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(text, ",", "")).otherwise(F.regexp_replace(text, ",", "."))
    return plain.try_cast("double")


def period_rate(text: Column) -> Column:
    """Times per day of a period: day, per week, /h, q8h, every 12 hours, 14d, 2 weeks; null if it is none of these."""
    counted_as = r"^(\d+(?:\.\d+)?)\s*(h|hr|hrs|hour|hours|d|day|days|wk|wks|week|weeks)$"

    def rate(t: Column) -> Column:
        size = F.regexp_extract(t, counted_as, 1).try_cast("double")
        kind = F.substring(F.regexp_extract(t, counted_as, 2), 1, 1)
        return F.coalesce(F.element_at(_map(PERIODS), t), F.when(size > 0, F.when(kind == "h", 24.0 / size).when(kind == "d", 1.0 / size).when(kind == "w", 1.0 / (7.0 * size))))

    return let(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^(/|per |every |each |q\.?\s?)\s*|\.$", ""), r"^every\s+", "")), rate)


def _parts(text: Column, pattern: str) -> Column:
    """Groups 1 to 4 of a pattern that spans the text, from one pass of the regular expression; null without a match."""
    cut = F.split(F.regexp_replace(text, pattern, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    return F.when(F.size(cut) == 4, cut)


def unit_parts(text: Column) -> Column:
    """Of a whole unit field: optional number, multiplier, unit and optional period, as an array; null if it says anything else."""
    return _parts(text, rf"(?iu)^\s*{_NUMBER}?\s*{_SCALE}??\s*(?:int\.?\s*|international\s+|usp\s+)?{_UNIT}\.?\s*(?:{_PERIOD})?\s*$")


def strength_parts(text: Column) -> Column:
    """Of the first strength within a free text, the same; its period is one written with a stroke or 'per'."""
    return _parts(text, rf"(?isu)^.*?(?<![\w.,]){_NUMBER}\s*{_SCALE}??\s*(?:int\.?\s*|international\s+|usp\s+)?{_UNIT}(?![\p{{L}}\p{{N}}µμ])\.?\s*(?:(?:/\s*|per\s+)(h|hr|hour|d|day|wk|week)\b)?.*$")


def _of(parts: Column) -> Column:
    def with_unit(unit: Column) -> Column:
        scale = F.regexp_replace(F.lower(parts[1]), r"[.,\s]", "")
        good = ((scale == "") | (unit["dim"] == "units")) & ((parts[3] == "") | unit["per_day"].isNotNull())
        factor = unit["factor"] * F.coalesce(F.element_at(_map(SCALES), scale), F.lit(1.0))
        return F.struct(to_number(parts[0]).alias("number"), F.when(good, unit["dim"]).alias("dim"), F.when(good, factor).alias("factor"), unit["per_day"].alias("per_day"))

    def known(name: Column) -> Column:
        found = F.element_at(_map({k: v[0] for k, v in UNITS.items()}), name), F.element_at(_map({k: v[1] for k, v in UNITS.items()}), name)
        return F.struct(found[0].alias("dim"), found[1].alias("factor"), F.when(parts[3] != "", period_rate(parts[3])).alias("per_day"))

    return let(known(F.regexp_replace(F.lower(parts[2]), r"[.\s]", "")), with_unit)


def amount_of(parts: Column) -> Column:
    """Struct number, dim, factor (to the dimension's common unit) and per_day (null without a period) of such parts."""
    return let(parts, _of)
