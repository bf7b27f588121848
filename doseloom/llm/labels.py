"""Label summaries brought to one notation, and the survivor of each set of ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .survivors import Field, survivors

#: Notations of a day.
DAYS = (("^[0-9]{8}([0-9]{6})?$", "yyyyMMdd", 8), ("^[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd", 10), ("^[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd", 10), ("^[0-9]{2} [A-Za-z]{3} [0-9]{4}$", "dd MMM yyyy", 11), ("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$", "dd.MM.yyyy", 10))

#: Day of labels whose time is unusable; weight of such a label in votes; days in which a label's weight falls by half.
NO_DAY, UNDATED, HALF_LIFE_DAYS = "0001-01-01", 2.0**-20, 1826


def plain(text: Column) -> Column:
    """Single plain spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{200b}\x{feff}]+", " "))


def day_of(text: Column) -> Column:
    """Calendar day of a time in any of the notations; null if it is none."""
    t = plain(text)
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_timestamp(F.substring(t, 1, n), F.lit(f)).cast("date")) for p, f, n in DAYS))


def version_of(text: Column) -> Column:
    """Version as a whole number: 12, 012, v12, 12.0; 0 if there is none."""
    return F.coalesce(F.regexp_extract(plain(text), r"^[vV]?\.?\s?([0-9]{1,18})(?:[.,][0-9]*)?$", 1).try_cast("bigint"), F.lit(0))


def ingredient_key(names: Column) -> Column:
    """Distinct ingredient names, upper case, in order, joined by a bar; an entry may hold several. Empty if there is no name."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.split(x, r"[,;|/]")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.upper(plain(x))), lambda x: x != ""))), "|")


def real_set_id(text: Column) -> Column:
    """Lower case set_id if it is a real one: a UUID other than all zeros; else null."""
    t = F.lower(plain(text))
    return F.when(t.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$") & ~t.rlike("^[0-]+$"), t)


def label_survivors(labels: DataFrame, shared_only: bool = True, half_life_days: int = HALF_LIFE_DAYS) -> DataFrame:
    """One row per ingredient set: ingredient_key, n_records, label_id, set_id, version, effective_time, ingredients, brand_names.

    label_id, version and effective_time are the newest label's (by day, version number, label_id), set_id that of the
    newest label that has a real one ('' if none has): there a label outweighs all older ones. ingredients and brand_names
    are the written forms closest to the consensus of all labels of the set, a label's weight falling by half every
    half_life_days, so a form that most recent labels agree on survives a newest label that strays from it. Labels
    without any ingredient name are in no set; repeated rows count once. With shared_only, sets of a single label are
    left out.
    """
    joined = lambda c: F.array_join(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: plain(x)), lambda x: x.isNotNull() & (x != "")), ", ")
    age = F.datediff(F.lit("2020-01-01").cast("date"), "day")
    more = {"version_text": F.coalesce("version", F.lit("")), "time_text": F.coalesce("effective_time", F.lit("")), "ingredients": joined("ingredient_set"), "brands": joined("brand_names"), "weight": F.when(F.col("day") > NO_DAY, F.pow(F.lit(2.0), -age / half_life_days)).otherwise(UNDATED)}
    rank = F.col("rank")
    fields = {
        "label_id": Field(rank),
        "set_id": Field(rank, value=F.col("real_set")),
        "version": Field(rank, value=F.col("version_text")),
        "effective_time": Field(rank, value=F.col("time_text")),
        "ingredients": Field(rank, vote="sum", weight=F.col("weight")),
        "brand_names": Field(rank, value=F.nullif("brands", F.lit("")), vote="sum", weight=F.col("weight")),
    }
    return _filled(survivors(_keyed(labels, more), "ingredient_key", fields, "label_id", 2 if shared_only else 1))


def newest_labels(labels: DataFrame) -> DataFrame:
    """The same with ingredient_key, n_records, label_id and set_id only, for sets of two or more labels."""
    rank = F.col("rank")
    return _filled(survivors(_keyed(labels, {}), "ingredient_key", {"label_id": Field(rank), "set_id": Field(rank, value=F.col("real_set"))}, "label_id", 2))


def _keyed(labels: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Labels with their ingredient set and rank, a text that sorts by day, version number, label_id; labels without ingredients are left out."""
    day = F.coalesce(day_of(F.col("effective_time")), F.lit(NO_DAY).cast("date"))
    read = labels.where("label_id is not null").withColumn("day", day)
    rank = F.concat(F.date_format("day", "yyyyMMdd"), F.lpad(version_of(F.col("version")).cast("string"), 19, "0"), F.col("label_id"))
    return read.select("label_id", ingredient_key(F.col("ingredient_set")).alias("ingredient_key"), rank.alias("rank"), real_set_id(F.col("set_id")).alias("real_set"), *(c.alias(n) for n, c in more.items())).where("ingredient_key <> ''")


def _filled(found: DataFrame) -> DataFrame:
    return found.withColumn("set_id", F.coalesce("set_id", F.lit("")))
