"""A check of a list for reading: alerts with titles and reasons, and all parts of the report in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import RELEASE, rank

#: Names of sections and grades, and the order of a report's parts.
SECTIONS = {"contraindications": "Contraindications", "boxed_warning": "Boxed Warning", "warnings_and_cautions": "Warnings and Precautions", "warnings": "Warnings", "precautions": "Precautions", "drug_interactions": "Drug Interactions"}
GRADE_NAMES = {"E": "Avoid combination", "D": "Consider changing therapy", "C": "Monitor closely", "B": "Monitor", "A": "Minor"}
PARTS = ("medication", "total", "alert", "unresolved", "notice")


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def section_name(section: Column) -> Column:
    """Name of a section for reading; others as they are."""
    return _named(section, SECTIONS)


def grade_name(grade: Column) -> Column:
    return _named(grade, GRADE_NAMES)


def alert_title(kind: Column, names: Column, n: Column, plural: Column, risk: Column) -> Column:
    """3 CNS depressants: risk; or: A with B: risk; or, with several others: A with 3 drugs: risk."""
    others = F.when(F.size(names) == 2, F.get(names, F.lit(1))).otherwise(F.concat_ws(" ", (F.size(names) - 1).cast("string"), F.coalesce(plural, F.lit("drugs"))))
    return F.when(kind == "pair", F.concat(F.get(names, F.lit(0)), F.lit(" with "), others, F.lit(": "), risk)).otherwise(F.concat(n.cast("string"), F.lit(" "), F.coalesce(plural, F.lit("drugs")), F.lit(": "), risk))


def alert_basis(section: Column, drug: Column, risk: Column, rows: Column) -> Column:
    """Why an alert is given: the section of the label that says so, or the rule; and the rows of the rule book."""
    book = F.when(F.size(rows) > 0, F.concat(F.lit(" Clinical rulebook row "), F.array_join(rows, ", "), F.lit("."))).otherwise("")
    quoted = F.concat(F.lit("The "), section_name(section), F.lit(" section of the "), drug, F.lit(" label addresses this combination: "), risk, F.lit("."))
    return F.concat(F.when(F.coalesce(section, F.lit("")) != "", quoted).otherwise(F.concat(F.lit("Class rule: "), risk, F.lit("."))), book)


def strongest_member(members: DataFrame, alert: str, order: list[str]) -> DataFrame:
    """alert and the member (drug, section, sentence) whose section weighs most, sections in the given order; without a sentence the first."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("section"))
    weight = F.when((place > 0) & (F.coalesce("sentence", F.lit("")) != ""), place).otherwise(len(order) + 1)
    return members.groupBy(alert).agg(F.min_by(F.struct("drug", "section", "sentence"), F.struct(weight, "drug")).alias("m")).select(alert, "m.*")


def report_rows(parts: dict[str, DataFrame], list_id: str, notice: str) -> DataFrame:
    """list_id, part, place, text: a report's parts one after another, in long form so that a list may have any number of rows.

    parts: for each of PARTS but the notice, a table of list_id, ord and text; alerts have a grade too and go worst first.
    Every list of any part ends with the notice.
    """
    out = None
    for i, name in enumerate(PARTS[:-1]):
        if name not in parts:
            continue
        p = parts[name]
        severity = -rank(F.col("grade")) if name == "alert" else F.lit(0)
        rows = p.select(F.col(list_id).alias("list_id"), F.lit(name).alias("part"), F.lit(i).alias("_i"), severity.cast("int").alias("_s"), F.col("ord").cast("bigint").alias("_o"), "text")
        out = rows if out is None else out.unionByName(rows)
    ends = out.select("list_id").distinct().select("list_id", F.lit("notice").alias("part"), F.lit(len(PARTS)).alias("_i"), F.lit(0).alias("_s"), F.lit(0).cast("bigint").alias("_o"), F.lit(notice).alias("text"))
    place = F.row_number().over(Window.partitionBy("list_id", "part").orderBy("_s", "_o", "text"))
    return out.unionByName(ends).select("list_id", "part", place.alias("place"), "text")


def name_words(name: Column) -> Column:
    """The words of a name without release suffixes."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.trim(name), "-", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(*RELEASE))


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are equal or one goes on where the other ends, word by word, release suffixes aside."""
    x, y = name_words(a), name_words(b)
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
