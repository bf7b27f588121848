"""Tagging documents by a table of text rules, with a small hierarchy of terms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import negated, strip_heading


@dataclass(frozen=True)
class Rule:
    """A sentence of one of the fields (the first named goes first) that matches and is not excluded makes the term.

    also: a second pattern that must match; unless: one that lifts the exclusion; test: a further condition; ranked: patterns
    of which the first that any sentence matches goes first; prefer: sentences that go first within a field; bare: the
    evidence is given without its heading.
    """

    term: str
    fields: tuple[str, ...]
    include: str
    exclude: str = ""
    prefer: str = ""
    honour_negation: bool = True
    also: str = ""
    unless: str = ""
    ranked: tuple[str, ...] = ()
    test: Callable[[Column], Column] | None = None
    bare: bool = False


def tag(sentences: DataFrame, rules: list[Rule], doc: str, order: list[str]) -> DataFrame:
    """One row per document and term: doc, term, field_name, sentence of the best evidence.

    sentences has doc, field_name, sentence and the order columns that tell sentences of a field apart. The best
    evidence is in the earliest field of the rule, there of the first ranked pattern, a preferred sentence before others,
    then the first. Rules are few and become expressions of one scan; the choice is a min_by with partial aggregation.
    """
    hits, s = [], F.col("sentence")
    for r in rules:
        place = F.array_position(F.array(*[F.lit(f) for f in r.fields]), F.col("field_name"))
        ok = (place > 0) & s.rlike(r.include)
        if r.also:
            ok = ok & s.rlike(r.also)
        if r.test is not None:
            ok = ok & F.coalesce(r.test(s), F.lit(False))
        if r.exclude:
            ok = ok & (~s.rlike(r.exclude) | s.rlike(r.unless) if r.unless else ~s.rlike(r.exclude))
        if r.honour_negation:
            ok = ok & ~negated(s)
        rank = F.lit(len(r.ranked))
        for i, p in reversed(list(enumerate(r.ranked))):
            rank = F.when(s.rlike(p), i).otherwise(rank)
        late = F.when(s.rlike(r.prefer), 0).otherwise(1) if r.prefer else F.lit(0)
        hits.append(F.when(ok, F.struct(F.lit(r.term).alias("term"), place.cast("int").alias("place"), rank.alias("rank"), late.alias("late"), (strip_heading(s) if r.bare else s).alias("said"))))
    found = sentences.select(doc, "field_name", *order, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    best = F.min_by(F.struct("field_name", F.col("h.said").alias("sentence")), F.struct("h.place", "h.rank", "h.late", *order))
    return found.groupBy(doc, F.col("h.term").alias("term")).agg(best.alias("b")).select(doc, "term", "b.*")


def expand_hierarchy(tags: DataFrame, edges: list[tuple[str, str]], doc: str, evidence: list[str]) -> DataFrame:
    """tags plus the broader term of each narrower one that is not there yet, with the evidence of the first narrower term in the order of the edges."""
    rows = tags.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "narrow string, broad string, edge int")
    wider = tags.join(F.broadcast(rows), F.col("term") == F.col("narrow")).groupBy(doc, F.col("broad").alias("term")).agg(F.min_by(F.struct(*evidence), F.col("edge")).alias("b")).select(doc, "term", "b.*")
    return tags.unionByName(wider.join(tags.select(doc, "term"), [doc, "term"], "left_anti"))


def hierarchy_violations(tags: DataFrame, edges: list[tuple[str, str]], doc: str) -> DataFrame:
    """doc, narrow, broad wherever a narrower term stands without its broader one."""
    rows = tags.sparkSession.createDataFrame(edges, "narrow string, broad string")
    have = tags.select(doc, "term").distinct()
    need = have.join(F.broadcast(rows), F.col("term") == F.col("narrow")).select(doc, "narrow", "broad")
    return need.join(have.withColumnRenamed("term", "broad"), [doc, "broad"], "left_anti").select(doc, "narrow", "broad")


def tier(field: Column) -> Column:
    """Tier of a section: 1 contraindications, 2 boxed warning, 3 warnings, 4 others that speak of interactions; null else."""
    return F.when(field == "contraindications", 1).when(field == "boxed_warning", 2).when(field.isin("warnings", "warnings_and_cautions", "precautions"), 3).when(field == "drug_interactions", 4)
