"""Lists of entries: sums, shared tags, pairs, duplicates, connected entries, class membership."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_type, runs
from ..functions.lineage import cut_lineage


def totals(entries: DataFrame, keys: list[str], amount: str, name: str, flag: str) -> DataFrame:
    """Sum, count, names in order and any flag, per key; nulls don't add. Amounts of different units or periods need these among the keys."""
    return entries.groupBy(*keys).agg(F.round(F.sum(amount), 6).alias("total"), F.count(amount).alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_flag"))


def ceiling(total: Column, most: Column) -> Column:
    """'above' from 100.5 % of the most on, 'at' from 99.5 % on, else null."""
    return F.when(total > most * 1.005, "above").when(total >= most * 0.995, "at")


def shared_tags(entries: DataFrame, list_id: str, entry: str, tag: str, rank: Column) -> DataFrame:
    """Tags that two or more different entries of a list have: list, tag, n_entries, least rank."""
    return entries.groupBy(list_id, tag).agg(F.countDistinct(entry).alias("n_entries"), F.min(rank).alias("least_rank")).where("n_entries >= 2")


def rule_pairs(entries: DataFrame, rules: DataFrame, list_id: str, entry: str, tag: str) -> DataFrame:
    """list, rule, a and b: entries of one list whose tags are the two sides of a rule (columns rule, side_a, side_b), a and b different.

    Sides are matched by equi joins with the rules; the two halves meet on list and rule, so no list is paired with itself as a whole.
    """
    mine = entries.select(list_id, F.col(entry).alias("e"), F.col(tag).alias("t")).distinct()
    a = mine.join(rules, F.col("t") == F.col("side_a")).select(list_id, "rule", F.col("e").alias("a"))
    b = mine.join(rules, F.col("t") == F.col("side_b")).select(list_id, "rule", F.col("e").alias("b"))
    return a.join(b, [list_id, "rule"]).where("a <> b")


def strongest(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


#: Rows of a list from which on it is worked off in rounds over all tasks.
LARGE = 10_000


def connected(members: DataFrame, list_id: str, entry: str, tag: str) -> DataFrame:
    """list, entry, component: entries of a list that share a tag, directly or through others, have the same (least) entry as component.

    Null entries are left out; null tags join nothing; a null list is none. Lists of up to LARGE rows are joined within a task,
    one after another; longer ones in rounds of aggregates with map-side combine (least labels go along entry and tag,
    then each label takes on the label of its own label, so that rounds grow with the logarithm of a chain).
    """
    edges = members.select(F.col(list_id).alias("l"), F.col(entry).alias("e"), F.col(tag).alias("t")).where("e is not null and l is not null")
    large = edges.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("l")
    if large.isEmpty():
        found = _joined(edges)
    else:
        large = cut_lineage(large)
        found = _joined(edges.join(large, "l", "left_anti")).unionByName(_in_rounds(edges.join(large, "l", "left_semi")))
    return found.select(F.col("l").alias(list_id), F.col("e").alias(entry), F.col("c").alias("component"))


def _joined(edges: DataFrame) -> DataFrame:
    kinds = [arrow_type(edges.schema[c].dataType) for c in "le"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], kinds[1]), pa.array(cols[2], kinds[1])], ["l", "e", "c"])

        for group, rows in runs(batches):
            head: dict = {}

            def find(x):
                while head[x] != x:
                    head[x] = x = head[head[x]]
                return x

            seen: dict = {}
            for _, e, t in rows:
                head.setdefault(e, e)
                if t is None:
                    continue
                a, b = find(e), find(seen.setdefault(t, e))
                if a != b:
                    head[max(a, b)] = min(a, b)
            out += [(group, e, find(e)) for e in head]
            if len(out) >= 5_000:
                yield batch()
                out.clear()
        yield batch()

    kind = {c: edges.schema[c].dataType.simpleString() for c in "le"}
    return edges.repartition("l").sortWithinPartitions("l").mapInArrow(join, f"l {kind['l']}, e {kind['e']}, c {kind['e']}")


def _in_rounds(edges: DataFrame) -> DataFrame:
    edges = cut_lineage(edges.distinct())
    labels = edges.groupBy("l", "e").agg(F.min("e").alias("c"))
    while True:
        by_tag = edges.join(labels, ["l", "e"]).where("t is not null").groupBy("l", "t").agg(F.min("c").alias("c"))
        near = edges.join(by_tag, ["l", "t"]).groupBy("l", "e").agg(F.min("c").alias("near"))
        moved = cut_lineage(labels.join(near, ["l", "e"], "left").select("l", "e", F.least("c", F.coalesce("near", "c")).alias("c"), (F.coalesce("near", "c") < F.col("c")).alias("new")))
        if moved.where("new").isEmpty():
            return moved.drop("new")
        parent = moved.select("l", F.col("e").alias("c"), F.col("c").alias("up"))
        labels = moved.drop("new").join(parent, ["l", "c"], "left").select("l", "e", F.least("c", F.coalesce("up", "c")).alias("c"))


def closure(members: DataFrame) -> DataFrame:
    """class, member: names of each class with those of the classes it refers to ('@name'), to any depth, cycles included.

    members has class and member. Names reached are added round by round until there are none new.
    """
    base = cut_lineage(members.select("class", "member").distinct())
    links = base.where("member like '@%'").select("class", F.expr("substring(member, 2)").alias("inner"))
    known, fresh = links, links
    while True:
        step = fresh.join(links.select(F.col("class").alias("inner"), F.col("inner").alias("next")), "inner").select("class", F.col("next").alias("inner")).distinct()
        fresh = cut_lineage(step.join(known, ["class", "inner"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut_lineage(known.union(fresh))
    names = base.where("member not like '@%'")
    reached = known.join(names.withColumnRenamed("class", "inner"), "inner").select("class", "member")
    return names.union(reached).distinct()


def prefix_members(names: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """name, class: a name is in a class if it equals a member or extends one by a space; an equi join on the name's leading words."""
    words = F.split(F.col(name), " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    spread = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("member", F.explode(heads))
    return spread.join(members, "member").select(name, "class").distinct()
