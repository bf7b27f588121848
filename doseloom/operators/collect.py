"""Collecting documents: staged filters, newest per key, checks, dictionaries of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows that fail at each stage and rows that remain after it: stage, ord, failed, remaining.

    Each row counts at the first stage whose condition is not true. Stages without a row are there with 0.
    """
    reached = F.lit(len(stages) + 1)
    for i, (_, condition) in reversed(list(enumerate(stages, 1))):
        reached = F.when(~F.coalesce(condition, F.lit(False)), i).otherwise(reached)
    counted = df.select(reached.alias("ord")).groupBy("ord").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(stages, 1)] + [("kept", len(stages) + 1)], "stage string, ord int")
    all_stages = names.join(counted, "ord", "left").na.fill(0, ["n"])
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    return all_stages.select("stage", "ord", F.when(F.col("ord") > len(stages), 0).otherwise(F.col("n")).cast("bigint").alias("failed"), F.when(F.col("ord") > len(stages), F.col("n")).otherwise(F.coalesce(F.sum("n").over(after), F.lit(0))).cast("bigint").alias("remaining"))


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns for each key; one aggregate with map-side combine, so hot keys cost nothing."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def repeated_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")


def name_table(df: DataFrame, kinds: dict[str, str], sets: Column) -> DataFrame:
    """One row per normalised name: name_key, kinds (sorted), n_sets (distinct ingredient sets), n_rows.

    kinds maps a kind to the array column that holds its names; empty and null names are left out.
    """

    def of_kind(kind: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(collapse(x)).alias("name_key")))

    names = F.flatten(F.array(*[of_kind(k, F.coalesce(F.col(c), F.array().cast("array<string>"))) for k, c in kinds.items()]))
    rows = df.select(sets.alias("set_key"), F.inline(names)).where("name_key <> ''")
    return rows.groupBy("name_key").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("set_key").alias("n_sets"), F.count("*").alias("n_rows"))


def unseen(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the cache yet."""
    return df.join(cache.select(key).distinct(), key, "left_anti")
