"""Relations between entries and between findings: mentions, links, overlaps, containment, distinct sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def mentioned_pairs(entries: DataFrame, sentences: DataFrame, list_id: str, entry: str, name: str, text: str) -> DataFrame:
    """list, a, b wherever a sentence of entry a holds the (one-word) name of another entry b of the same list as a whole word.

    The sentences' words meet the names on list and word, an equi join; no entry is compared with all others.
    """
    words = sentences.select(list_id, F.col(entry).alias("a"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    names = entries.select(list_id, F.col(entry).alias("b"), F.lower(F.col(name)).alias("word")).distinct()
    return words.join(names, [list_id, "word"]).where("a <> b").select(list_id, "a", "b").distinct()


def linked_pairs(entries: DataFrame, links: DataFrame, list_id: str, entry: str, name: str) -> DataFrame:
    """list, a, b (a before b) of entries whose names are linked in either direction (columns one, other)."""
    both = links.select("one", "other").union(links.select(F.col("other").alias("one"), F.col("one").alias("other"))).distinct()
    mine = entries.select(list_id, F.col(entry).alias("e"), F.lower(F.col(name)).alias("n")).distinct()
    far = mine.withColumnRenamed("n", "one").join(both, "one").select(list_id, F.col("e").alias("a"), F.col("other").alias("n"))
    return far.join(mine.withColumnRenamed("e", "b"), [list_id, "n"]).where("a < b").select(list_id, "a", "b").distinct()


def contained(small: DataFrame, large: DataFrame, on: list[str], small_id: str, large_id: str, member: str) -> DataFrame:
    """on, small_id, large_id wherever the large finding has every member of the small one; both are in long form.

    Members meet in an equi join and are counted, so no finding is compared with all others. A finding without members
    is in none.
    """
    a, b = small.select(*on, small_id, member).distinct(), large.select(*on, large_id, member).distinct()
    sizes = a.groupBy(*on, small_id).agg(F.count("*").alias("_size"))
    met = a.join(b, [*on, member]).groupBy(*on, small_id, large_id).agg(F.count("*").alias("_met"))
    return met.join(sizes, [*on, small_id]).where("_met = _size").select(*on, small_id, large_id)


def first_home(small: DataFrame, large: DataFrame, on: list[str], small_id: str, large_id: str, member: str, order: Column) -> DataFrame:
    """on, small_id and the first large finding that contains it; the others are not absorbed and don't appear."""
    return contained(small, large, on, small_id, large_id, member).groupBy(*on, small_id).agg(F.min_by(large_id, order).alias(large_id))


def distinct_sides(a: DataFrame, b: DataFrame, on: list[str], entry: str) -> DataFrame:
    """on wherever two sides can be filled by different entries: not if both have one and the same entry only."""
    sides = [x.select(*on, entry).distinct().groupBy(*on).agg(F.count("*").alias("n"), F.min(entry).alias("one")) for x in (a, b)]
    met = sides[0].join(sides[1].select(*on, F.col("n").alias("m"), F.col("one").alias("other")), on)
    return met.where("n > 1 or m > 1 or one <> other").select(*on)


def first_of(rows: DataFrame, sources: list[tuple[DataFrame, list[str], Column, bool]], value: str) -> DataFrame:
    """rows with the value of the first source that has one for the row's keys; null if none has.

    Each source is given with its keys, the order of its rows, and whether the last one of a key counts or the first.
    """
    names = [f"_{i}" for i in range(len(sources))]
    for name, (source, keys, order, last) in zip(names, sources):
        pick = F.max_by(value, order) if last else F.min_by(value, order)
        rows = rows.join(source.where(F.col(value).isNotNull()).groupBy(*keys).agg(pick.alias(name)), keys, "left")
    return rows.withColumn(value, F.coalesce(*names)).drop(*names)
