"""Rules over lists of entries: groups, pairs, duplicates, ceilings, and how their alerts are graded, folded and merged.

An entry has a list, a position and one row per base ingredient. Rules are data: their tables become expressions or
equi joins, and everything is counted per list by aggregates over distinct ingredients, so that no list is gathered in
a task and no entry is paired with all others.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.text import whole_word
from .lists import connected, prefix_members

#: Grades from the mildest to the most severe; label terms and the family that their alerts belong to.
GRADES = "ABCDE"
FAMILIES = {"T14": "serotonin", "T15": "cns", "T16": "qt"}
#: Pair rules that a group may take in although its category is another.
ABSORBABLE = ("opioid_benzodiazepine", "opioid_gabapentinoid", "clozapine_benzodiazepine", "beta_blocker_nondhp", "alpha_blocker_pde5")
#: Suffixes of a release form; names of days.
RELEASE = ("xr", "er", "sr", "xl", "cd", "la", "ds", "ir", "dr", "odt", "ec", "cr")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: What a label sentence says about use together, and what to do about it.
AVOID = r"(?i)\b(avoid\w*|not recommended|(?:do|must|should) not (?:be )?(?:use|used|take|taken|co-?administer\w*|combine\w*))\b"
TOGETHER = r"(?i)\b(concomitant\w*|combination\w*|combined|co-?administ\w*|together|with other|in combination)\b"
ACTION = r"(?i)\b(monitor\w*|caution\w*|closely|dose (?:reduction|adjustment)|(?:reduce|adjust|lower|decrease)\w* (?:the )?(?:dose|dosage))\b"
WARNINGS = ("warnings_and_cautions", "warnings", "precautions")


@dataclass(frozen=True)
class Condition:
    """Holds if each class of `has` has an ingredient of its own, the list has min_members medicines and `least` ingredients of count_of."""

    grade: str
    has: tuple[str, ...] = ()
    min_members: int = 0
    count_of: str = ""
    least: int = 0


@dataclass(frozen=True)
class GroupRule:
    """Medicines of some classes taken together."""

    rule: str
    classes: tuple[str, ...]
    grade: str = "C"
    family: str = ""
    category: str = ""
    min_members: int = 2
    anchor: str = ""
    require_any: tuple[str, ...] = ()
    all_distinct: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    escalate: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class PairRule:
    """A victim of side a with perpetrators of side b; caps: most mg a day of the victim by perpetrator (0: any dose), cap_a: whatever the perpetrator."""

    rule: str
    a: tuple[str, ...]
    b: tuple[str, ...]
    grade: str
    family: str = ""
    category: str = ""
    exclude_b: tuple[str, ...] = ()
    over_grade: str = ""
    caps: dict[str, float] = field(default_factory=dict, hash=False)
    cap_a: float | None = None


def rank(grade: Column) -> Column:
    """Severity of a grade, 1 the mildest."""
    return F.position(grade, F.lit(GRADES))


def grade_of(severity: Column) -> Column:
    return F.substring(F.lit(GRADES), severity, F.lit(1))


def classified(entries: DataFrame, members: DataFrame) -> DataFrame:
    """list_id, pos, base, class of every class that a base ingredient is in (equal to a member or one word longer and so on), lower case."""
    low = entries.where("base is not null").select("list_id", "pos", F.lower("base").alias("base")).distinct()
    of = prefix_members(low.select("base"), members.select(F.lower("class").alias("class"), F.lower("member").alias("member")).distinct(), "base")
    return low.join(of, "base").select("list_id", "pos", "base", "class")


def _any_class(mask: Column, classes: tuple[str, ...]) -> Column:
    return F.arrays_overlap(mask, F.array(*[F.lit(c) for c in classes]))


def _count(masks: Column, classes: tuple[str, ...]) -> Column:
    """Ingredients in any of some classes, from the counts by set of classes."""
    return F.aggregate(masks, F.lit(0).cast("bigint"), lambda n, m: n + F.when(_any_class(m["classes"], classes), m["n"]).otherwise(0))


def _distinct_sides(masks: Column, sides: tuple[str, ...]) -> Column:
    """Whether each side can have an ingredient of its own: any k of the sides have at least k ingredients among them."""
    ok = F.lit(True)
    for k in range(1, len(sides) + 1):
        for some in itertools.combinations(sides, k):
            ok = ok & (_count(masks, tuple(dict.fromkeys(some))) >= k)
    return ok


def _met(c: Condition, masks: Column, medicines: Column) -> Column:
    ok = medicines >= c.min_members
    if c.has:
        ok = ok & _distinct_sides(masks, c.has)
    if c.count_of:
        ok = ok & (_count(masks, (c.count_of,)) >= c.least)
    return ok


def _group_grade(r: GroupRule, masks: Column, medicines: Column) -> Column:
    ok = medicines >= r.min_members
    if r.anchor:
        ok = ok & (_count(masks, (r.anchor,)) > 0)
    if r.require_any:
        ok = ok & (_count(masks, r.require_any) > 0)
    if r.all_distinct:
        ok = ok & _distinct_sides(masks, r.all_distinct)
    grade = F.lit(GRADES.index(r.grade) + 1)
    if r.conditions:
        met = [F.when(_met(c, masks, medicines), GRADES.index(c.grade) + 1) for c in r.conditions]
        grade = F.greatest(*met, F.lit(None).cast("int")) if len(met) > 1 else met[0]
    more = [F.when(_met(c, masks, medicines), GRADES.index(c.grade) + 1) for c in r.escalate]
    grade = F.when(grade.isNotNull(), F.greatest(grade, *more) if more else grade)
    return F.when(ok, grade)


def group_alerts(entries: DataFrame, members: DataFrame, rules: list[GroupRule]) -> DataFrame:
    """list_id, rule, family, category, medicines, grade of each group rule that applies.

    Medicines are entries joined by shared ingredients, so a drug entered twice and one of two ingredients count once.
    members: class, member, with references expanded.
    """
    spark = entries.sparkSession
    of = cut_lineage(classified(entries, members))  # read three times
    wanted = spark.createDataFrame([(r.rule, c) for r in rules for c in r.classes], "rule string, class string")
    hits = of.join(wanted, "class").select("list_id", "rule", "pos", "base").distinct()
    kind = hits.schema["list_id"].dataType
    keyed = hits.withColumn("key", F.concat_ws("\u0001", "rule", F.col("list_id").cast("string")))
    parts = connected(keyed, "key", "pos", "base").groupBy("key").agg(F.countDistinct("component").alias("medicines"))
    parts = parts.select(F.substring_index("key", "\u0001", 1).alias("rule"), F.substring_index("key", "\u0001", -1).cast(kind).alias("list_id"), "medicines")
    masks = of.groupBy("list_id", "base").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    own = hits.select("list_id", "rule", "base").distinct().join(masks, ["list_id", "base"])
    counted = own.groupBy("list_id", "rule", "classes").agg(F.count("*").alias("n")).groupBy("list_id", "rule").agg(F.collect_list(F.struct("classes", "n")).alias("masks"))
    both = counted.join(parts, ["list_id", "rule"])
    severity = F.lit(None).cast("int")
    for r in rules:
        severity = F.when(F.col("rule") == r.rule, _group_grade(r, F.col("masks"), F.col("medicines"))).otherwise(severity)
    facts = spark.createDataFrame([(r.rule, r.family, r.category) for r in rules], "rule string, family string, category string")
    return both.withColumn("severity", severity).where("severity is not null").join(facts, "rule").select("list_id", "rule", "family", "category", "medicines", grade_of(F.col("severity")).alias("grade"))


def pair_alerts(entries: DataFrame, members: DataFrame, rules: list[PairRule], daily_mg: DataFrame) -> DataFrame:
    """list_id, rule, family, category, victim (bases of an entry, joined by a bar), perpetrators (sorted), grade.

    One row per rule and victim. A perpetrator is no ingredient of the victim's entry, so it is in another entry and another
    ingredient. daily_mg: list_id, base, mg. Victims meet distinct ingredients of the other side, of which a rule has few.
    """
    spark = entries.sparkSession
    of = cut_lineage(classified(entries, members))  # read twice
    whole = entries.where("base is not null").groupBy("list_id", "pos").agg(F.array_sort(F.collect_set(F.lower("base"))).alias("bases"))
    side = lambda which: spark.createDataFrame([(r.rule, c) for r in rules for c in getattr(r, which)], "rule string, class string")
    dose = daily_mg.groupBy("list_id", F.lower("base").alias("base")).agg(F.first("mg").alias("mg"))
    a = of.join(side("a"), "class").select("list_id", "rule", "pos").distinct().join(whole, ["list_id", "pos"]).select("list_id", "rule", "bases").distinct()
    doses = a.select("list_id", "bases").distinct().select("list_id", "bases", F.posexplode("bases").alias("n", "base")).join(dose, ["list_id", "base"])
    a = a.join(doses.groupBy("list_id", "bases").agg(F.min_by("mg", "n").alias("mg")), ["list_id", "bases"], "left")
    b = of.join(side("b"), "class").select("list_id", "rule", "base").distinct()
    out_b = [(r.rule, x.lower()) for r in rules for x in r.exclude_b]
    if out_b:
        b = b.join(spark.createDataFrame(out_b, "rule string, base string"), ["rule", "base"], "left_anti")
    met = a.join(b, ["list_id", "rule"]).where(~F.array_contains("bases", F.col("base")))
    severity = F.lit(0)
    for r in rules:
        plain, over = GRADES.index(r.grade) + 1, GRADES.index(r.over_grade or r.grade) + 1
        hot = F.lit(False)
        for who, cap in r.caps.items():
            hot = hot | ((F.col("base") == who.lower()) & (F.lit(cap == 0) | F.coalesce(F.col("mg") > cap, F.lit(False))))
        if r.cap_a is not None:
            hot = hot | F.coalesce(F.col("mg") > r.cap_a, F.lit(False))
        severity = F.when(F.col("rule") == r.rule, F.when(hot, over).otherwise(plain)).otherwise(severity)
    merged = met.withColumn("severity", severity).groupBy("list_id", "rule", F.array_join("bases", "|").alias("victim")).agg(F.array_sort(F.collect_set("base")).alias("perpetrators"), F.max("severity").alias("severity"))
    facts = spark.createDataFrame([(r.rule, r.family, r.category) for r in rules], "rule string, family string, category string")
    return merged.join(facts, "rule").select("list_id", "rule", "family", "category", "victim", "perpetrators", grade_of(F.col("severity")).alias("grade"))


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs with the same drugs and category in a list the most severe, of equal ones that of the first rule."""
    drugs = F.array_sort(F.array_distinct(F.concat(F.split("victim", r"\|"), "perpetrators")))
    keyed = pairs.withColumn("_drugs", F.array_join(drugs, "|"))
    rest = [c for c in pairs.columns if c not in ("list_id", "category")]
    best = keyed.groupBy("list_id", "category", "_drugs").agg(F.min_by(F.struct(*rest), F.struct(-rank(F.col("grade")), "rule", "victim")).alias("b"))
    return best.select("list_id", "category", "b.*").select(*pairs.columns)


def duplicate_classes(entries: DataFrame, members: DataFrame, require: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """list_id, class, ingredients, entries of classes with two or more ingredients in two or more entries of a list.

    require: for some classes, other classes one of whose ingredients must be among them.
    """
    of = classified(entries, members)
    masks = of.groupBy("list_id", "base").agg(F.collect_set("class").alias("classes"))
    needed = F.lit(True)
    for name, classes in (require or {}).items():
        needed = F.when(F.col("class") == name, _any_class(F.col("classes"), classes)).otherwise(needed)
    by_base = of.select("list_id", "class", "base").distinct().join(masks, ["list_id", "base"]).groupBy("list_id", "class").agg(F.count("*").alias("ingredients"), F.bool_or(needed).alias("ok"))
    by_entry = of.groupBy("list_id", "class").agg(F.countDistinct("pos").alias("entries"))
    return by_base.join(by_entry, ["list_id", "class"]).where("ingredients >= 2 and entries >= 2 and ok").select("list_id", "class", "ingredients", "entries")


def duplicate_ingredients(entries: DataFrame, metabolites: DataFrame) -> DataFrame:
    """list_id, risk ('shared_ingredient' or 'active_metabolite'), base, other, pos, first_pos, n_links.

    Entries that share a base ingredient, or of which one's is an active metabolite of the other's (columns parent,
    metabolite): one row per entry but the first of such a group, linked to the first one; n_links counts the entries
    that it is linked to. Pairs that share an ingredient are not metabolite pairs.
    """
    low = entries.where("base is not null").select("list_id", "pos", F.lower("base").alias("base")).distinct()
    groups = low.groupBy("list_id", "base").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1")
    shared = low.join(groups, ["list_id", "base"]).where("pos <> first_pos").select("list_id", F.lit("shared_ingredient").alias("risk"), "base", F.col("base").alias("other"), "pos", "first_pos", (F.col("n") - 1).alias("n_links"))
    links = metabolites.select(F.lower("parent").alias("base"), F.lower("metabolite").alias("other")).distinct()
    child = low.groupBy("list_id", F.col("base").alias("other")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_links"))
    both = low.join(links, "base").join(child, ["list_id", "other"])
    same = low.select("list_id", "pos", F.col("base").alias("other"))
    # the first entry with the metabolite is another one that has not the parent too
    far = both.where("pos <> first_pos").join(same, ["list_id", "pos", "other"], "left_anti").join(low.select("list_id", F.col("pos").alias("first_pos"), "base"), ["list_id", "first_pos", "base"], "left_anti")
    return shared.unionByName(far.select("list_id", F.lit("active_metabolite").alias("risk"), "base", "other", "pos", "first_pos", "n_links"))


def ceilings(totals: DataFrame, most: DataFrame) -> DataFrame:
    """list_id, ingredient, total, most, verdict ('at' or 'above'), grade of daily totals in mg at or above the most a day.

    totals: list_id, ingredient (a product of several joined by strokes), unit, period, total; most: ingredient (the parts of
    a combination joined by strokes, in any order), most, grade. Within half a percent is 'at', of grade A.
    """
    key = lambda c: F.array_join(F.array_sort(F.split(F.lower(c), "/")), "/")
    daily = totals.where("period = 'day' and unit = 'mg'").withColumn("key", key("ingredient"))
    met = daily.join(most.select(key("ingredient").alias("key"), "most", F.col("grade").alias("over")), "key").where(F.col("total") >= F.col("most") * 0.995)
    above = F.col("total") > F.col("most") * 1.005
    return met.select("list_id", "ingredient", "total", "most", F.when(above, "above").otherwise("at").alias("verdict"), F.when(above, F.col("over")).otherwise("A").alias("grade"))


def absorb(pairs: DataFrame, pair_drugs: DataFrame, groups: DataFrame, group_drugs: DataFrame) -> DataFrame:
    """list_id, alert, home: pairs that a group takes in: of the same family, with all their drugs, at the same or a higher
    grade, and of the same category or one of ABSORBABLE. The first such group (by ord) is the home; the others stay.

    pairs: list_id, alert, rule, family, category, grade; groups: list_id, alert, ord, family, category, grade; the drugs of
    each: list_id, alert, drug. Pairs and groups meet by drug and are counted.
    """
    size = pair_drugs.distinct().groupBy("list_id", "alert").agg(F.count("*").alias("size"))
    met = pair_drugs.distinct().join(group_drugs.distinct().withColumnRenamed("alert", "home"), ["list_id", "drug"]).groupBy("list_id", "alert", "home").agg(F.count("*").alias("met"))
    full = met.join(size, ["list_id", "alert"]).where("met = size")
    g = groups.select("list_id", F.col("alert").alias("home"), "ord", F.col("family").alias("gf"), F.col("category").alias("gc"), F.col("grade").alias("gg"))
    fits = (F.col("family") == F.col("gf")) & ((F.col("category") == F.col("gc")) | F.col("rule").isin(*ABSORBABLE)) & (rank(F.col("gg")) >= rank(F.col("grade")))
    return full.join(pairs, ["list_id", "alert"]).join(g, ["list_id", "home"]).where(fits).groupBy("list_id", "alert").agg(F.min_by("home", "ord").alias("home"))


def merge_quotes(labels: DataFrame, label_drugs: DataFrame, rules: DataFrame, rule_drugs: DataFrame) -> DataFrame:
    """list_id, alert, home, grade, kept of label alerts: the first rule alert (by ord) that takes in their quotes, or none.

    labels: list_id, alert, kind ('group' or 'pair'), term, grade; rules: list_id, alert, ord, family; the drugs of each:
    list_id, alert, drug, component (the medicine that a drug is). Alerts of one medicine only are dropped (kept is false).
    A group's home has its family and two or more of its drugs, a pair's home all its drugs. Without a home a group is kept
    at grade A, a pair as it is.
    """
    family = F.lit(None).cast("string")
    for term, name in FAMILIES.items():
        family = F.when(F.col("term") == term, name).otherwise(family)
    size = label_drugs.groupBy("list_id", "alert").agg(F.countDistinct("drug").alias("size"), F.countDistinct("component").alias("medicines"))
    known = labels.join(size, ["list_id", "alert"], "left").withColumn("want", family)
    met = label_drugs.select("list_id", "alert", "drug").distinct().join(rule_drugs.select("list_id", F.col("alert").alias("home"), "drug").distinct(), ["list_id", "drug"]).groupBy("list_id", "alert", "home").agg(F.count("*").alias("met"))
    r = rules.select("list_id", F.col("alert").alias("home"), "ord", F.col("family").alias("have"))
    fits = (F.col("met") >= 2) & F.when(F.col("want").isNotNull(), F.col("want") == F.col("have")).otherwise(F.col("met") == F.col("size"))
    home = met.join(known, ["list_id", "alert"]).join(r, ["list_id", "home"]).where(fits).groupBy("list_id", "alert").agg(F.min_by("home", "ord").alias("home"))
    kept = F.coalesce((F.col("size") >= 2) & (F.col("medicines") >= 2), F.lit(False))
    done = known.join(home, ["list_id", "alert"], "left")
    return done.select("list_id", "alert", F.when(kept, F.col("home")).alias("home"), F.when(F.col("home").isNull() & (F.col("kind") == "group"), "A").otherwise(F.col("grade")).alias("grade"), kept.alias("kept"))


def member_grade(section: Column, sentence: Column, kind: Column) -> Column:
    """Grade of a label sentence in an alert: contraindications E in a pair, else D; boxed warning or 'avoid together' D; warnings C;
    interactions B with an action, else A; null without a sentence or in other sections."""
    avoid = sentence.rlike(AVOID) & sentence.rlike(TOGETHER)
    graded = F.when(section == "contraindications", F.when(kind == "pair", "E").otherwise("D")).when((section == "boxed_warning") | avoid, "D").when(section.isin(*WARNINGS), "C").when(section == "drug_interactions", F.when(sentence.rlike(ACTION), "B").otherwise("A"))
    return F.when(F.coalesce(sentence != "", F.lit(False)) & F.coalesce(section != "", F.lit(False)), graded)


def alert_grades(alerts: DataFrame) -> DataFrame:
    """alert, grade: the most severe grade of the members' sentences (alert, kind, grade, section, sentence); a grade that is
    given stands, duplicates are C, alerts without a graded sentence A. Worst first by severity."""
    given = F.when(F.col("grade").isin(*GRADES), rank(F.col("grade")))
    own = rank(F.coalesce(member_grade(F.col("section"), F.col("sentence"), F.col("kind")), F.lit("A")))
    severity = F.coalesce(F.max(given), F.when(F.max("kind") == "duplication", 3), F.max(own))
    return alerts.groupBy("alert").agg(severity.alias("severity")).select("alert", "severity", grade_of(F.col("severity")).alias("grade"))


def typed_key(name: Column) -> Column:
    """A typed name without release suffixes: Xanax and Xanax-XR are one."""
    words = F.split(F.lower(F.regexp_replace(name, "-", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*RELEASE)), " ")


def named_days(schedule: Column) -> Column:
    """The days (three letters) that a schedule names."""
    low = F.lower(F.coalesce(schedule, F.lit("")))
    return F.filter(F.array(*[F.lit(d) for d in DAYS]), lambda d: F.contains(low, d))


def grade_duplicates(pairs: DataFrame) -> DataFrame:
    """pairs (risk, name, other_name, schedule, other_schedule, at_ceiling) with grade: D if the names differ, one is the other's
    metabolite or the total is at its ceiling, else C; entries on named days that don't overlap are one regimen and left out."""
    a, b = named_days(F.col("schedule")), named_days(F.col("other_schedule"))
    split = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    hidden = (F.col("risk") == "active_metabolite") | ~typed_key(F.col("name")).eqNullSafe(typed_key(F.col("other_name")))
    return pairs.where(~split).withColumn("grade", F.when(hidden | F.coalesce("at_ceiling", F.lit(False)), "D").otherwise("C"))


def contraindicated_pairs(evidence: DataFrame, entries: DataFrame, names: DataFrame, itself: str) -> DataFrame:
    """list_id, a, b wherever a clause of entry a's evidence (list_id, pos, sentence) names entry b or its class as whole words.

    names: list_id, pos, name (own names, bases and classes). Clauses that only speak of the drug itself (pattern `itself`)
    don't count, nor do entries that share a base with a. Words of clauses meet the first word of names in an equi join
    within the list, and only those are compared in full.
    """
    parts = F.split("sentence", "•")
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(itself))
    said = evidence.select("list_id", F.col("pos").alias("a"), F.explode(parts).alias("clause")).withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("clause"), F.lit(r"[a-z0-9]+"), F.lit(0)))))
    called = names.where("name <> ''").select("list_id", F.col("pos").alias("b"), F.lower("name").alias("name")).distinct().withColumn("word", F.regexp_extract("name", r"[a-z0-9]+", 0))
    met = said.join(called, ["list_id", "word"]).where((F.col("a") != F.col("b")) & whole_word(F.col("clause"), F.col("name"))).select("list_id", "a", "b").distinct()
    base = entries.where("base is not null").select("list_id", "pos", F.lower("base").alias("base")).distinct()
    shared = met.join(base.withColumnRenamed("pos", "a"), ["list_id", "a"]).join(base.withColumnRenamed("pos", "b"), ["list_id", "b", "base"]).select("list_id", "a", "b").distinct()
    return met.join(shared, ["list_id", "a", "b"], "left_anti")


def rule_evidence(sentences: DataFrame, bases: DataFrame, members: DataFrame, rules: DataFrame, order: list[str], longest: int = 600) -> tuple[DataFrame, DataFrame]:
    """Evidence of each rule by label (rule, set_id, section, sentence) and by base (rule, base, section, sentence, set_id).

    sentences: set_id, ord, section, n, sentence; bases: set_id, base; rules: rule, class (of the label side), pattern; order:
    the sections, the weightiest first. The first sentence of a label counts that matches the rule's pattern; of several
    labels of one set the last (by ord), of one base the first. Labels meet rules by class, so only their own are tried.
    """
    side = classified(bases.select(F.col("set_id").alias("list_id"), F.lit(0).alias("pos"), "base"), members).select(F.col("list_id").alias("set_id"), "base", "class")
    on = side.join(rules, "class").select("set_id", "base", "rule", "pattern").distinct()
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("section"))
    short = sentences.where((F.length("sentence") <= longest) & (place > 0))
    hit = short.join(on.select("set_id", "rule", "pattern").distinct(), "set_id").where(F.expr("sentence rlike concat('(?i)', pattern)"))
    first = hit.groupBy("rule", "set_id", "ord").agg(F.min_by(F.struct("section", "sentence"), F.struct(place, "n")).alias("h"))
    by_set = first.groupBy("rule", "set_id").agg(F.max_by("h", "ord").alias("h")).select("rule", "set_id", "h.section", "h.sentence")
    by_base = first.join(on.select("set_id", "rule", "base").distinct(), ["set_id", "rule"]).groupBy("rule", "base").agg(F.min_by(F.struct("h.section", "h.sentence", "set_id"), F.struct("ord", "set_id")).alias("x")).select("rule", "base", "x.*")
    return by_set, by_base
