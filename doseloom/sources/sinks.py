"""Writing tables: JSON lines, and a lean table beside its bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> int:
    """df as JSON lines in a folder, and its number of rows, counted on the way; the commit protocol makes it appear whole or not at all."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_json(df: DataFrame, path: str) -> None:
    """A small table as one JSON-lines file within a folder."""
    df.coalesce(1).write.mode("overwrite").json(path)


def safe_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be part of a path: not null, not empty, without strokes and dots that climb."""
    k = F.col(key)
    return df.where(k.isNotNull() & (k != "") & ~k.contains("/") & ~k.contains("\\") & ~k.isin(".", ".."))


def write_split(df: DataFrame, path: str, key: str, body: str, parts: int = 64) -> None:
    """The columns without the body at path/lean, key and body at path/bodies in folders by hash of the key, so that a point read opens one of them."""
    df.drop(body).write.mode("overwrite").parquet(f"{path}/lean")
    bodies = df.select(key, body).where(F.col(key).isNotNull()).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    bodies.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/bodies")


def read_bodies(hits: DataFrame, path: str, key: str, body: str, parts: int = 64) -> DataFrame:
    """hits with their body, '' where there is none. The folders that the hits lie in (at most `parts`) become a filter of the
    partition column, so no others are listed or read."""
    spark = hits.sparkSession
    keyed = hits.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    wanted = [r.part for r in keyed.select("part").distinct().collect()]
    bodies = spark.read.parquet(f"{path}/bodies").where(F.col("part").isin(wanted) if wanted else F.lit(False))
    return keyed.join(bodies, [key, "part"], "left").withColumn(body, F.coalesce(body, F.lit(""))).drop("part")
