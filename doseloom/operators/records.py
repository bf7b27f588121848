"""Records of labels for looking up: profiles quoted from their texts, notes, checker records, gold labels, checks of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lists import prefix_members
from .vocabulary import TERMS, schedule_of

#: Lengths of a quoted sentence (most for indications), and the patterns of what is quoted.
SHORTEST, LONGEST, LONGEST_INDICATION = 20, 420, 900
HEADER = r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(?:INDICATIONS\s*(?:AND|&)\s*USAGE|DOSAGE\s*(?:AND|&)\s*ADMINISTRATION|MECHANISM\s+OF\s+ACTION|CLINICAL\s+PHARMACOLOGY)\s*"
NUMBERED = r"^\s*\d+(?:\.\d+)+\s+(?=[A-Z])"
REFERENCE = r"(?i)\s*\[\s*see[^\]]*\]|\(\s*\d+(?:\.\d+)*\s*\)"
FRAGMENT = r"^[\[(]|^\W*$"
STRENGTH = r"(?i)\d+(?:\.\d+)?\s*(?:mg|mcg|g|units?|mEq)\b"
RECOMMENDED = r"(?i)\b(?:recommended|usual|starting|initial)\b[^.]*\b(?:dose|dosage)\b|\b(?:dose|dosage)\b[^.]*\b(?:recommended|usual)\b"
MAXIMUM = r"(?i)\bmaximum\b|\bnot (?:to )?exceed\b|\bshould not exceed\b|\bup to a (?:total|maximum)\b"
DURATION = r"(?i)\bshort[- ]term\b|\bshortest (?:possible )?duration\b|\blimit(?:ed)? (?:the )?(?:use|duration|treatment)\b|\b(?:longer|more) than (?:\w+ )?\(?\d*\)? ?(?:days?|weeks?|months?)\b|\bfor (?:up to |no more than )?\d+(?: to \d+)? (?:days?|weeks?)\b|\bperiodically re-?(?:assess|evaluate)\b|\bgradually (?:taper|reduce)\b|\btaper\b"
STUDY = r"(?i)\b(?:stud(?:y|ies)|trials?|patients treated|placebo)\b"
MECHANISM = r"(?i)mechanism|acts|binds|inhibit|block"
#: Terms whose evidence is shown as a note; text of a gold cell that nobody has filled yet.
NOTES = ("T01", "T04", "T06", "T12", "T14", "T15", "T16", "T17")
PLACEHOLDER = "PLACEHOLDER: replace with your own rationale before this label counts as real."


def clean_sentence(sentence: Column) -> Column:
    """A sentence without heading, numbering and cross references; bullets become semicolons."""
    t = F.regexp_replace(F.regexp_replace(F.trim(sentence), HEADER, ""), NUMBERED, "")
    t = T.collapse(F.replace(F.regexp_replace(t, REFERENCE, ""), F.lit("•"), F.lit(";")))
    t = F.replace(F.replace(t, F.lit(" ;"), F.lit(";")), F.lit(":;"), F.lit(":"))
    return F.regexp_replace(t, r"\s+([.,;:])", "$1")


def section_sentences(texts: Column, longest: int = LONGEST) -> Column:
    """Cleaned sentences of a section's entries, in order, of fitting length and no fragments."""
    every = F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: T.plain_sentences(F.coalesce(t, F.lit("")))))
    return F.filter(F.transform(every, clean_sentence), lambda s: F.length(s).between(SHORTEST, longest) & ~s.rlike(FRAGMENT))


def first_matching(sentences: Column, pattern: str, n: int, unless: str = "", also: str = "") -> Column:
    """The first n distinct sentences that match a pattern (and `also`, but not `unless`)."""

    def fits(s: Column) -> Column:
        ok = s.rlike(pattern)
        ok = ok & ~s.rlike(unless) if unless else ok
        return ok & s.rlike(also) if also else ok

    return F.slice(F.array_distinct(F.filter(sentences, fits)), 1, n)


def label_profiles(labels: DataFrame, key: str, sections: str = "sections") -> DataFrame:
    """key, indications, mechanism, dose_recommended, dose_maximum, duration of labels with a map of sections (name to texts);
    a missing section gives an empty array. All are expressions of one row."""
    of = lambda name, longest=LONGEST: section_sentences(F.try_element_at(sections, F.lit(name)), longest)
    work = labels.select(key, of("indications_and_usage", LONGEST_INDICATION).alias("i"), of("mechanism_of_action").alias("m"), F.filter(of("clinical_pharmacology"), lambda s: s.rlike(MECHANISM)).alias("c"), of("dosage_and_administration").alias("d"), F.concat(of("boxed_warning"), of("warnings_and_cautions"), of("warnings")).alias("w"))
    return work.select(
        key,
        F.slice("i", 1, 3).alias("indications"),
        F.slice(F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("c")), 1, 2).alias("mechanism"),
        first_matching(F.col("d"), RECOMMENDED, 2, unless=MAXIMUM, also=STRENGTH).alias("dose_recommended"),
        first_matching(F.col("d"), MAXIMUM, 2).alias("dose_maximum"),
        first_matching(F.concat("d", "i", "w"), DURATION, 2, unless=STUDY).alias("duration"),
    )


def drug_profiles(records: DataFrame, classes: DataFrame, members: DataFrame, references: DataFrame, profiles: DataFrame, ceilings: DataFrame) -> DataFrame:
    """set_id, classes, references, ceilings (sorted arrays) and the label's profile of each record (set_id, base_ingredients).

    classes: class, name; members: class, member (a base belongs also if it extends a member by a word); references: base, url;
    ceilings: base, most. Left joins on the record's bases; what is missing is empty.
    """
    bases = records.select("set_id", F.explode("base_ingredients").alias("base")).select("set_id", F.lower("base").alias("base")).distinct()
    low = members.select("class", F.lower("member").alias("member")).distinct()
    of = bases.join(prefix_members(bases, low, "base"), "base").join(classes, "class").groupBy("set_id").agg(F.array_sort(F.collect_set("name")).alias("classes"))
    refs = bases.join(references, "base").groupBy("set_id").agg(F.array_sort(F.collect_set("url")).alias("references"))
    most = bases.join(ceilings, "base").groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("base", "most"))).alias("ceilings"))
    out = records.select("set_id").distinct().join(of, "set_id", "left").join(refs, "set_id", "left").join(most, "set_id", "left").join(profiles, "set_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"classes": F.coalesce("classes", none), "references": F.coalesce("references", none), "ceilings": F.coalesce("ceilings", F.array().cast(out.schema["ceilings"].dataType))})


def label_notes(evidence: DataFrame, key: str, order: str) -> DataFrame:
    """key, term, name, field_name, sentence, place of the evidence that is shown, in order: terms of NOTES with a sentence."""
    names = evidence.sparkSession.createDataFrame([t[:2] for t in TERMS], "term string, name string")
    shown = evidence.where(F.col("term").isin(*NOTES) & (F.coalesce("sentence", F.lit("")) != ""))
    return shown.join(names, "term").select(key, "term", "name", "field_name", "sentence", F.col(order).alias("place"))


def checker_records(labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """One record per set_id: effective_time, names, ingredient_set (distinct, upper case, sorted), route, classes, schedule, evidence.

    labels: set_id, effective_time, brand_name, generic_name, substance_name, route, pharm_class_epc (arrays), controlled_substance
    (text); evidence: set_id, term, field_name, sentence. Labels without evidence have an empty array.
    """
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    told = evidence.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("term", "field_name", "sentence"))).alias("evidence"))
    rows = labels.select("set_id", "effective_time", some("brand_name").alias("brand_names"), some("generic_name").alias("generic_names"), F.array_sort(F.array_distinct(F.transform(some("substance_name"), lambda x: F.upper(x)))).alias("ingredient_set"), some("route").alias("route"), some("pharm_class_epc").alias("pharm_class_epc"), F.nullif(schedule_of(F.col("controlled_substance")), F.lit("")).alias("schedule"))
    met = rows.join(told, "set_id", "left")
    return met.withColumn("evidence", F.coalesce("evidence", F.array().cast(told.schema["evidence"].dataType)))


def collection_problems(records: DataFrame, set_id: str = "set_id", label_id: str = "label_id", ingredients: str = "ingredient_set") -> DataFrame:
    """problem, key, n of a collection that should hold one document per set of ingredients: repeated label ids, repeated sets, records
    without set id or ingredients."""
    key = F.array_join(F.array_sort(F.coalesce(ingredients, F.array().cast("array<string>"))), "|")
    rows = records.select(F.col(set_id).alias("s"), F.col(label_id).alias("l"), key.alias("k"))
    repeated = lambda c, name: rows.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("problem"), "key", "n")
    empty = lambda c, name: rows.where(F.coalesce(F.col(c), F.lit("")) == "").groupBy(F.coalesce("l", F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "key", "n")
    return repeated("l", "repeated label").unionByName(repeated("k", "repeated ingredient set")).unionByName(empty("s", "no set id")).unionByName(empty("k", "no ingredients"))


def name_entries(labels: DataFrame, kinds: dict[str, str], sets: str, order: str) -> DataFrame:
    """name_key, display, kinds, ingredient_sets: every normalised name with its kinds and its distinct sets of ingredients, in order
    of their first row, and its first spelling. kinds maps a kind to the array column with its names."""
    def of_kind(kind: str, names: str) -> Column:
        known = F.coalesce(F.col(names), F.array().cast("array<string>"))
        return F.transform(known, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("display"), F.lower(T.collapse(x)).alias("name_key")))

    named = F.flatten(F.array(*[of_kind(k, c) for k, c in kinds.items()]))
    rows = labels.select(F.col(order).alias("_o"), F.col(sets).alias("_s"), F.inline(named)).where("name_key <> ''")
    once = rows.groupBy("name_key", "_s").agg(F.min("_o").alias("_o"), F.collect_set("kind").alias("k"), F.min_by("display", "_o").alias("display"))
    return once.groupBy("name_key").agg(F.min_by("display", "_o").alias("display"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("kinds"), F.transform(F.array_sort(F.collect_list(F.struct("_o", "_s"))), lambda x: x["_s"]).alias("ingredient_sets"))


def gold_template(sets: DataFrame, terms: DataFrame, rationale: str = PLACEHOLDER) -> DataFrame:
    """set_id, term, gold, rationale of every set and term of the vocabulary (a fixed few), to be filled in."""
    listed = [r.term for r in terms.select("term").distinct().collect()]
    return sets.select("set_id").distinct().select("set_id", F.explode(F.array(*[F.lit(t) for t in sorted(listed)])).alias("term"), F.lit(False).alias("gold"), F.lit(rationale).alias("rationale"))


def set_gold(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells with the gold value and rationale of the edits (the same columns) where there are any; new cells are added."""
    e = edits.select("set_id", "term", F.col("gold").alias("_g"), F.col("rationale").alias("_r"), F.lit(True).alias("_e")).dropDuplicates(["set_id", "term"])
    met = cells.join(e, ["set_id", "term"], "full")
    return met.select("set_id", "term", F.when(F.col("_e"), F.col("_g")).otherwise(F.col("gold")).alias("gold"), F.when(F.col("_e"), F.col("_r")).otherwise(F.col("rationale")).alias("rationale"))


def gold_problems(cells: DataFrame, terms: DataFrame) -> DataFrame:
    """set_id, term, problem of cells with an unknown term or without a gold value."""
    known = terms.select("term").distinct().withColumn("_k", F.lit(True))
    problem = F.when(F.col("_k").isNull(), "unknown term").when(F.col("gold").isNull(), "gold value must be true or false")
    return cells.join(known, "term", "left").withColumn("problem", problem).where("problem is not null").select("set_id", "term", "problem")


def filled_gold(cells: DataFrame) -> DataFrame:
    """set_id, term, gold of the cells that somebody has filled."""
    return cells.where(F.coalesce(F.col("rationale") != PLACEHOLDER, F.lit(True))).select("set_id", "term", F.coalesce("gold", F.lit(False)).alias("gold"))
