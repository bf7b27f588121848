"""Orders and sets: worst first, the first n, order-preserving distinct, streams one after another, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst_first(rows: DataFrame, keys: list[str], grade: str, order: str, into: str = "place") -> DataFrame:
    """rows with their place within a key, the most severe grade first, equal ones by order."""
    severity = F.position(F.col(grade), F.lit("ABCDE"))
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(severity.desc(), order)))


def first_n(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; no more than n a task are kept."""
    return rows.orderBy(*order).limit(n)


def shared(a: Column, b: Column) -> Column:
    """The names that both arrays have, sorted, joined by bars."""
    return F.array_join(F.array_sort(F.array_intersect(a, b)), "|")


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, values: the distinct values of a key in the order of their first row. Values are made distinct before they are gathered."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def concatenated(streams: list[DataFrame], order: list[str], into: str = "ord") -> DataFrame:
    """Streams one after another with a place that counts on. Places within a stream are counted per range of the order, so no task sorts a whole one."""
    out = None
    for i, s in enumerate(streams):
        part = s.withColumn("_s", F.lit(i))
        out = part if out is None else out.unionByName(part)
    chunked = out.repartitionByRange("_s", *order).sortWithinPartitions("_s", *order).withColumn("_p", F.spark_partition_id())
    before = chunked.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = chunked.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_s", *order))).join(before, "_p")
    return placed.withColumn(into, F.col("_at") + F.col("_r")).drop("_s", "_p", "_r", "_at")


def changes(first: DataFrame, second: DataFrame, into: str = "side") -> DataFrame:
    """Rows that only one of two tables has, marked 'first' or 'second'."""
    one, two = first.exceptAll(second), second.exceptAll(first)
    return one.withColumn(into, F.lit("first")).unionByName(two.withColumn(into, F.lit("second")))
