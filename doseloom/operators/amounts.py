"""Amounts of ingredients per day, week or as a rate, from parsed entries, added up over a list; opioid equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entries import amount_text

#: Fixed value: name under which the factor of a fentanyl patch stands.
PATCH = "fentanyl_transdermal_per_mcg_h"


def unit_class(unit: Column) -> tuple[Column, Column]:
    """Common unit of a strength and the factor to it: masses in mg; mEq, units and mcg/h as they are; null for the rest."""
    return F.when(unit.isin("mg", "mcg", "g"), "mg").when(unit.isin("mEq", "units", "mcg/h"), unit), F.when(unit == "mcg", 0.001).when(unit == "g", 1000.0).when(unit.isin("mg", "mEq", "units", "mcg/h"), 1.0)


def paired_bases(components: Column, bases: Column) -> Column:
    """The base ingredient that each written component names (equal, or one begins with the other), in order; empty if one names none."""
    low = F.transform(components, lambda c: F.lower(c))
    found = F.transform(low, lambda c: F.get(F.filter(bases, lambda b: (b == c) | c.startswith(b) | b.startswith(c)), F.lit(0)))
    return F.when(F.exists(found, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(found)


def entry_amounts(entries: DataFrame, parsed: str = "parsed", bases: str = "bases", name: str = "display_name") -> DataFrame:
    """One row per ingredient of an entry with an amount: the other columns, then ingredient, amount, unit, period ('day', 'week', 'rate'), as_needed.

    entries has a parsed entry (functions/entries) and the base ingredients of what it was resolved to. Components with
    strengths of their own are paired with bases; else a product of several bases is one ingredient joined by strokes. A
    schedule of named or weekly days gives an amount per week, a rate is its own amount. Entries without a strength, a
    unit that adds up or a frequency give none.
    """
    p = F.col(parsed)
    none = F.array().cast("array<string>")
    own = F.transform(F.coalesce(F.col(bases), none), lambda b: F.lower(b))
    unit, factor = unit_class(p["strength_unit"])
    pairs = F.when(F.size(p["component_strengths"]) > 0, paired_bases(p["components"], own)).otherwise(none)

    def component(base: Column, strength: Column) -> Column:
        u, f = unit_class(strength["unit"])
        return F.struct(base.alias("ingredient"), (strength["value"] * F.coalesce(f, F.lit(1.0))).alias("each"), F.coalesce(u, F.lit("mg")).alias("unit"))

    several = F.zip_with(pairs, p["component_strengths"], component)
    whole = F.array(F.struct(F.array_join(own, "/").alias("ingredient"), (p["strength_value"] * factor).alias("each"), unit.alias("unit")))
    parts = F.when(F.size(pairs) > 0, several).otherwise(whole)
    weekly = F.coalesce(p["days_per_week"] < 7, F.lit(False))
    count = F.coalesce(F.when(p["dose_count"] != 0, p["dose_count"]), F.lit(1.0))

    def amounts(x: Column) -> Column:
        daily = F.when((F.size(pairs) == 0) & p["daily_total"].isNotNull(), p["daily_total"] * factor).otherwise(x["each"] * p["times_per_day"] * count)
        amount = F.when(weekly & p["times_per_day"].isNull(), x["each"] * count).when(weekly, daily * p["days_per_week"]).otherwise(daily)
        return F.struct(x["ingredient"].alias("ingredient"), amount.alias("amount"), x["unit"].alias("unit"), F.when(weekly, "week").otherwise("day").alias("period"))

    rate = F.array(F.struct(F.coalesce(F.get(own, F.lit(0)), p["name_text"]).alias("ingredient"), p["strength_value"].alias("amount"), unit.alias("unit"), F.lit("rate").alias("period")))
    usable = entries.where(p["strength_value"].isNotNull() & unit.isNotNull())
    rows = F.when(p["strength_unit"] == "mcg/h", rate).otherwise(F.filter(F.transform(parts, amounts), lambda x: x["amount"].isNotNull()))
    others = [F.col(f"`{c}`") for c in entries.columns if c not in (parsed, bases)]
    return usable.select(*others, F.inline(rows), p["as_needed"].alias("as_needed"))


def list_totals(amounts: DataFrame, factors: DataFrame, keys: list[str], name: str = "display_name", order: str = "pos") -> DataFrame:
    """keys, ingredient, unit, period, total, text, entries (names in order), entry_count, as_needed, mme: sums of each ingredient by unit and period.

    factors: ingredient, factor (morphine equivalents a mg, and PATCH for a rate of fentanyl). Amounts of other units or
    periods are never added up. The names of one ingredient in one list are gathered; there are few.
    """
    summed = amounts.groupBy(*keys, "ingredient", "unit", "period").agg(F.sum("amount").alias("sum"), F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]).alias("entries"), F.count("*").alias("entry_count"), F.coalesce(F.bool_or("as_needed"), F.lit(False)).alias("as_needed"))
    wanted = F.when((F.col("ingredient") == "fentanyl") & (F.col("unit") == "mcg/h"), PATCH).when((F.col("unit") == "mg") & (F.col("period") == "day"), F.col("ingredient"))
    met = summed.withColumn("_key", wanted).join(factors.select(F.col("ingredient").alias("_key"), "factor"), "_key", "left")
    mme = F.nullif(F.bround(F.col("sum") * F.col("factor"), 1), F.lit(0.0))
    suffix = F.when(F.col("period") == "day", "/day").when(F.col("period") == "week", "/week").otherwise(" continuous")
    text = F.concat(amount_text(F.col("sum"), F.col("unit")), suffix, F.when(F.col("as_needed"), " max").otherwise(""))
    return met.select(*keys, "ingredient", "unit", "period", F.round("sum", 4).alias("total"), text.alias("text"), "entries", "entry_count", "as_needed", mme.alias("mme"))


def total_mme(totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mme: the sum over a list's opioids; null if it has none."""
    return totals.groupBy(*keys).agg(F.bround(F.sum("mme"), 1).alias("mme"))


def daily_mg(totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base, mg: totals per day in mg."""
    return totals.where("unit = 'mg' and period = 'day'").select(*keys, F.col("ingredient").alias("base"), F.col("total").alias("mg"))
