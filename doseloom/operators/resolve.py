"""Typed names resolved by equal key or by likeness of their letters."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least likeness that is accepted, lead up to which another entry makes it doubtful, candidates that are kept,
#: least likeness of a candidate, least ratio of an external name.
ACCEPT, DOUBT, TOP, CLOSE, RATIO = 0.85, 0.03, 5, 0.75, 0.75
#: Keys that go to the workers at once; a longer list is taken in blocks.
BLOCK_KEYS = 100_000


def normal(name: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def likeness(typed: str, key: str) -> float:
    """Ratio of matching letters with the key, or with as many of its leading words as are typed; the larger counts."""
    whole = difflib.SequenceMatcher(None, typed, key).ratio()
    head = " ".join(key.split()[: len(typed.split())])
    return whole if head == key else max(whole, difflib.SequenceMatcher(None, typed, head).ratio())


class Keys:
    """The keys of a list, with how often each letter is in them and in their leading words: a bound on every ratio."""

    def __init__(self, keys: list[str]):
        self.keys = sorted(set(keys))
        self.letters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole = self._counts(self.keys)

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), 64), np.int16)
        if len(texts) and size.sum():
            np.add.at(out, (np.repeat(np.arange(len(texts)), size), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 63), 1)
        return out, size

    def close(self, typed: str) -> list[tuple[str, float]]:
        """The TOP keys of a likeness of CLOSE or more, best first. Every key whose letters allow it is compared."""
        own, size = self._counts([typed])
        words = len(typed.split())
        if words not in self.letters:
            self.letters[words] = self._counts([" ".join(k.split()[:words]) for k in self.keys])
        may = np.zeros(len(self.keys), bool)
        for counts, sizes in (self.whole, self.letters[words]):
            may |= 2 * np.minimum(counts, own).sum(1) >= CLOSE * (sizes + size) - 1e-9
        found = [(k, s) for k in (self.keys[i] for i in np.flatnonzero(may)) if (s := likeness(typed, k)) >= CLOSE]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:TOP]


def candidates(typed: DataFrame, keys: DataFrame) -> DataFrame:
    """typed, key, score, n: the TOP most alike keys of each typed name (one-column tables, normalised), best first, ties by key."""
    spark = typed.sparkSession
    name, key = typed.columns[0], keys.columns[0]
    listed = keys.select(F.col(key).alias("key")).where("key <> ''").distinct()
    parts = max(1, -(-listed.count() // BLOCK_KEYS))
    once = typed.select(F.col(name).alias("typed")).where("typed <> ''").distinct()
    out = None
    for part in range(parts):
        block = listed.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else listed
        sent = spark.sparkContext.broadcast([r.key for r in block.collect()])

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Keys(sent.value)
            for batch in batches:
                rows = [(t, k, s) for t in batch.column(0).to_pylist() for k, s in known.close(t)]
                cols = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["typed", "key", "score"])

        found = once.mapInArrow(compare, "typed string, key string, score double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("n", F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("score"), "key"))).where(F.col("n") <= TOP)


def described(display: Column, sets: Column) -> Column:
    """A candidate for reading: its display name and ingredient sets."""
    return F.concat(display, F.lit(" → "), F.array_join(F.transform(sets, lambda s: F.array_join(s, ", ")), " | "))


def local_matches(typed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """name, status, matched_name, ingredient_set, score, reason, candidates, sets, many_sets for every distinct typed name.

    typed: name; dictionary: name_key, display, ingredient_sets. An equal key has a score of 1; else the most alike key of
    ACCEPT or more is taken. It needs confirmation if another key with other sets comes within DOUBT, or if it stands for
    several sets of which not exactly one is the name itself (many_sets). Unresolved names list their three best candidates.
    Null and blank names are unresolved.
    """
    names = typed.select("name").distinct().withColumn("q", F.coalesce(normal(F.col("name")), F.lit("")))
    book = dictionary.groupBy(normal(F.col("name_key")).alias("key")).agg(F.min("display").alias("display"), F.min_by("ingredient_sets", "display").alias("sets"))
    exact = names.select("q").distinct().join(book, F.col("q") == F.col("key")).select("q", "key", F.lit(1.0).alias("score"), "display", "sets", F.lit(False).alias("rivals"), F.lit("").alias("candidates"))
    open_ = names.select("q").distinct().where("q <> ''").join(book.select("key"), F.col("q") == F.col("key"), "left_anti")
    ranked = candidates(open_, book.select("key")).join(book, "key")
    top = ranked.groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("n", "score", "key", "display", "sets"))).alias("c"))
    best = F.get("c", F.lit(0))
    near = F.filter("c", lambda x: (x["n"] > 1) & (best["score"] - x["score"] <= DOUBT) & (x["sets"] != best["sets"]))
    good = best["score"] >= ACCEPT
    shown = F.when(good, F.concat(F.slice("c", 1, 1), near)).otherwise(F.slice("c", 1, 3))
    fuzzy = top.select(F.col("typed").alias("q"), F.when(good, best["key"]).alias("key"), best["score"].alias("score"), F.when(good, best["display"]).alias("display"), F.when(good, best["sets"]).alias("sets"), (good & (F.size(near) > 0)).alias("rivals"), F.array_join(F.transform(shown, lambda x: described(x["display"], x["sets"])), "; ").alias("candidates"))
    met = names.join(exact.unionByName(fuzzy), "q", "left")
    itself = F.filter("sets", lambda s: (F.size(s) == 1) & (normal(F.get(s, F.lit(0))) == F.col("key")))
    single = F.when(F.size("sets") == 1, F.get("sets", F.lit(0))).when(F.size(itself) == 1, F.get(itself, F.lit(0)))
    taken = F.col("key").isNotNull() & ~F.coalesce("rivals", F.lit(False))
    many = taken & single.isNull()
    status = F.when(F.col("key").isNull(), "unresolved").when(F.col("rivals") | many, "needs_confirmation").otherwise("matched")
    reason = F.when(F.col("q") == "", "empty name").when(F.col("key").isNull(), "no dictionary name is close enough").when(F.col("rivals"), "two or more names are equally close").when(many, "the name is used by more than one ingredient set").otherwise("")
    told = F.when(many, F.array_join(F.transform("sets", lambda s: F.concat(F.col("display"), F.lit(" → "), F.array_join(s, ", "))), "; ")).when(status == "matched", "").otherwise(F.coalesce("candidates", F.lit("")))
    return met.select("name", status.alias("status"), F.when(taken, F.col("display")).alias("matched_name"), F.when(taken, single).alias("ingredient_set"), F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason"), told.alias("candidates"), F.when(taken, F.col("sets")).alias("sets"), many.alias("many_sets"))
