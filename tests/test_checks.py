import itertools
import random

import pytest
from pyspark.sql import functions as F

from doseloom.operators import checks as C

ENTRY = "list_id int, pos int, base string"
MEMBERS = [("cns", "opi"), ("cns", "benz"), ("cns", "gab"), ("opioid", "opi"), ("opioid", "oxy"), ("cns", "oxy"), ("benzo", "benz"), ("ssri", "sert"), ("ssri", "flu"), ("statin", "sim"), ("azole", "keto"), ("azole", "itra"), ("lith", "lithium")]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(MEMBERS, "class string, member string")


def entries(spark, *rows):
    return spark.createDataFrame([*rows], ENTRY)


def test_group_rules(spark, members):
    rules = [
        C.GroupRule("cns", ("cns",), "C", "cns", "sedation", escalate=(C.Condition("D", ("opioid", "benzo")), C.Condition("E", min_members=4), C.Condition("E", count_of="opioid", least=2))),
        C.GroupRule("need", ("cns", "ssri"), "B", anchor="ssri", require_any=("benzo",)),
        C.GroupRule("cond", ("ssri", "lith"), conditions=(C.Condition("D", ("ssri", "lith")),), min_members=1),
        C.GroupRule("two", ("opioid",), "A", all_distinct=("opioid", "opioid")),
    ]
    e = entries(spark, (1, 1, "opi"), (1, 2, "opi"), (2, 1, "OPI"), (2, 2, "benz"), (2, 3, None), (3, 1, "opi"), (3, 2, "oxy"), (4, 1, "gab"), (4, 1, "benz"), (5, 1, "sert"), (5, 2, "lithium carbonate"), (6, 1, "flu"), (6, 2, "benz"), (6, 3, "flu"))
    got = {(r.list_id, r.rule): (r.medicines, r.grade) for r in C.group_alerts(e, members, rules).collect()}
    # one drug twice and two ingredients of one entry are one medicine; each side needs its own ingredient
    assert got == {(2, "cns"): (2, "D"), (3, "cns"): (2, "E"), (3, "two"): (2, "A"), (5, "cond"): (2, "D"), (6, "need"): (2, "B")}
    assert C.group_alerts(e.limit(0), members, rules).count() == 0


def test_distinct_sides_against_search(spark):
    """Counts by class sets decide as trying all assignments does."""
    rng = random.Random(3)
    cases = []
    for i in range(60):
        bases = [tuple(sorted(rng.sample("xyz", rng.randint(1, 3)))) for _ in range(rng.randint(0, 4))]
        cases.append((i, bases))
    df = spark.createDataFrame([(i, [(list(b), bases.count(b)) for b in dict.fromkeys(bases)]) for i, bases in cases], "i int, masks array<struct<classes:array<string>,n:bigint>>")
    for sides in (("x",), ("x", "y"), ("x", "x"), ("x", "y", "z"), ("x", "x", "y")):
        got = {r.i: r.ok for r in df.select("i", C._distinct_sides(F.col("masks"), sides).alias("ok")).collect()}
        for i, bases in cases:
            want = any(all(s in bases[j] for s, j in zip(sides, p)) for p in itertools.permutations(range(len(bases)), len(sides)))
            assert got[i] == want, (sides, bases)


def test_pair_rules(spark, members):
    rules = [C.PairRule("cap", ("statin",), ("azole",), "C", category="m", over_grade="D", caps={"keto": 20.0, "itra": 0}, exclude_b=()), C.PairRule("self", ("opioid",), ("cns",), "B", category="m", exclude_b=("gab",)), C.PairRule("dup", ("statin",), ("azole",), "E", category="m")]
    e = entries(spark, (1, 1, "sim"), (1, 2, "keto"), (2, 1, "sim"), (2, 2, "keto"), (3, 1, "sim"), (3, 2, "itra"), (3, 3, "keto"), (4, 1, "opi"), (4, 1, "benz"), (4, 2, "gab"), (5, 1, "opi"), (5, 2, "benz"), (5, 3, "opi"))
    dose = spark.createDataFrame([(1, "sim", 20.0), (2, "SIM", 20.5)], "list_id int, base string, mg double")
    got = {(r.list_id, r.rule, r.victim): (r.perpetrators, r.grade) for r in C.pair_alerts(e, members, rules, dose).collect()}
    assert got[1, "cap", "sim"] == (["keto"], "C") and got[2, "cap", "sim"][1] == "D" and got[3, "cap", "sim"] == (["itra", "keto"], "D")
    assert (4, "self", "benz|opi") not in got and got[5, "self", "opi"] == (["benz"], "B") and got[1, "dup", "sim"][1] == "E"
    kept = C.dedupe_pairs(C.pair_alerts(e, members, rules, dose)).collect()
    assert sorted((r.list_id, r.rule) for r in kept) == [(1, "dup"), (2, "dup"), (3, "dup"), (5, "self")]


def test_duplicates(spark, members):
    e = entries(spark, (1, 1, "sert"), (1, 2, "flu"), (2, 1, "sert"), (2, 1, "flu"), (3, 1, "sert"), (3, 2, "sert"), (3, 3, "Sert"), (4, 1, "ven"), (4, 2, "desven"), (5, 1, "ven"), (5, 1, "desven"), (5, 2, "desven"))
    assert [(r.list_id, r["class"], r.ingredients, r.entries) for r in C.duplicate_classes(e, members).collect()] == [(1, "ssri", 2, 2)]
    assert C.duplicate_classes(e, members, {"ssri": ("opioid",)}).count() == 0
    links = spark.createDataFrame([("ven", "desven")], "parent string, metabolite string")
    got = sorted((r.list_id, r.risk, r.pos, r.first_pos, r.n_links) for r in C.duplicate_ingredients(e, links).collect())
    assert got == [(3, "shared_ingredient", 2, 1, 2), (3, "shared_ingredient", 3, 1, 2), (4, "active_metabolite", 1, 2, 1), (5, "shared_ingredient", 2, 1, 1)]
    p = spark.createDataFrame([("shared_ingredient", "Xanax", "Xanax-XR", None, None, None), ("shared_ingredient", "Xanax", "alprazolam", None, None, None), ("shared_ingredient", "a", "a", "Mon/Wed", "Tue/Thu", None), ("shared_ingredient", "a", "a", "Mon", "Mon", True), ("active_metabolite", "a", "a", None, None, None)], "risk string, name string, other_name string, schedule string, other_schedule string, at_ceiling boolean")
    assert sorted((r.name, r.other_name, r.grade) for r in C.grade_duplicates(p).collect()) == [("Xanax", "Xanax-XR", "C"), ("Xanax", "alprazolam", "D"), ("a", "a", "D"), ("a", "a", "D")]


def test_ceilings(spark):
    t = spark.createDataFrame([(1, "apap", "mg", "day", 4300.0), (2, "apap", "mg", "day", 4000.0), (3, "b/a", "mg", "day", 61.0), (4, "apap", "mg", "week", 9000.0), (5, "apap", "mg", "day", 3979.0)], "list_id int, ingredient string, unit string, period string, total double")
    most = spark.createDataFrame([("APAP", 4000.0, "D"), ("a/b", 60.0, "C")], "ingredient string, most double, grade string")
    assert sorted((r.list_id, r.verdict, r.grade) for r in C.ceilings(t, most).collect()) == [(1, "above", "D"), (2, "at", "A"), (3, "above", "C")]


def test_folding_and_merging(spark):
    pairs = spark.createDataFrame([(1, "p1", "r", "cns", "sed", "C"), (1, "p2", "r", "cns", "other", "C"), (1, "p3", "opioid_benzodiazepine", "cns", "other", "E"), (1, "p4", "opioid_benzodiazepine", "cns", "other", "D")], "list_id int, alert string, rule string, family string, category string, grade string")
    drugs = "list_id int, alert string, drug string"
    pd = spark.createDataFrame([(1, f"p{i}", d) for i in range(1, 5) for d in "xy"], drugs)
    groups = spark.createDataFrame([(1, "g2", 2, "cns", "sed", "D"), (1, "g1", 1, "cns", "sed", "D"), (1, "g0", 0, "qt", "sed", "E")], "list_id int, alert string, ord int, family string, category string, grade string")
    gd = spark.createDataFrame([(1, g, d) for g in ("g0", "g1", "g2") for d in "xyz"], drugs)
    assert sorted((r.alert, r.home) for r in C.absorb(pairs, pd, groups, gd).collect()) == [("p1", "g1"), ("p4", "g1")]
    labels = spark.createDataFrame([(1, "l1", "group", "T15", "C"), (1, "l2", "group", "T14", "C"), (1, "l3", "pair", "T17", "E"), (1, "l4", "pair", "T17", "E"), (1, "l5", "group", "T15", "C")], "list_id int, alert string, kind string, term string, grade string")
    ld = spark.createDataFrame([(1, "l1", "x", 1), (1, "l1", "y", 2), (1, "l1", "q", 3), (1, "l2", "x", 1), (1, "l2", "y", 2), (1, "l3", "x", 1), (1, "l3", "z", 2), (1, "l4", "x", 1), (1, "l4", "q", 3), (1, "l5", "x", 1), (1, "l5", "y", 1)], drugs + ", component int")
    got = {r.alert: (r.home, r.grade, r.kept) for r in C.merge_quotes(labels, ld, groups, gd).collect()}
    assert got == {"l1": ("g1", "C", True), "l2": (None, "A", True), "l3": ("g0", "E", True), "l4": (None, "E", True), "l5": (None, "C", False)}


def test_grades(spark):
    rows = [("contraindications", "x", "pair", "E"), ("contraindications", "x", "group", "D"), ("boxed_warning", "x", "pair", "D"), ("warnings", "Avoid x", "pair", "C"), ("precautions", "Avoid concomitant x", "pair", "D"), ("drug_interactions", "Monitor closely", "pair", "B"), ("drug_interactions", "x", "pair", "A"), ("other", "x", "pair", None), ("warnings", "", "pair", None), (None, "x", "pair", None)]
    df = spark.createDataFrame(rows, "section string, sentence string, kind string, want string")
    assert all(r.got == r.want for r in df.select("want", C.member_grade(F.col("section"), F.col("sentence"), F.col("kind")).alias("got")).collect())
    a = spark.createDataFrame([(1, "group", None, "warnings", "x"), (1, "group", None, "boxed_warning", "x"), (2, "duplication", None, "", ""), (3, "pair", "B", "contraindications", "x"), (4, "pair", None, None, None)], "alert int, kind string, grade string, section string, sentence string")
    assert {r.alert: r.grade for r in C.alert_grades(a).collect()} == {1: "D", 2: "C", 3: "B", 4: "A"}


def test_contraindicated_pairs(spark):
    e = entries(spark, (1, 1, "a"), (1, 2, "venlafaxine"), (1, 3, "desvenlafaxine"), (1, 4, "a"), (1, 5, "q"))
    evidence = spark.createDataFrame([(1, 1, "Known hypersensitivity to q • Do not use with MAO Inhibitors or venlafaxine, or a")], "list_id int, pos int, sentence string")
    names = spark.createDataFrame([(1, 2, "Venlafaxine"), (1, 3, "desvenlafaxine"), (1, 4, "a"), (1, 5, "q"), (1, 5, "mao inhibitors"), (1, 1, "a")], "list_id int, pos int, name string")
    got = C.contraindicated_pairs(evidence, e, names, "(?i)hypersensitivity to").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (1, 5)]


def test_rule_evidence(spark, members):
    s = spark.createDataFrame([("s1", 1, "warnings", 0, "With keto x"), ("s1", 1, "contraindications", 5, "Not with KETO"), ("s1", 2, "warnings", 0, "again keto"), ("s2", 3, "warnings", 0, "none"), ("s3", 4, "warnings", 1, "keto here")], "set_id string, ord int, section string, n int, sentence string")
    bases = spark.createDataFrame([("s1", "sim"), ("s2", "sim"), ("s3", "sim"), ("s3", "other")], "set_id string, base string")
    rules = spark.createDataFrame([("cap", "statin", r"\b(?:keto)")], "rule string, class string, pattern string")
    by_set, by_base = C.rule_evidence(s, bases, members, rules, ["contraindications", "warnings"])
    assert sorted((r.set_id, r.sentence) for r in by_set.collect()) == [("s1", "again keto"), ("s3", "keto here")]
    assert [(r.base, r.sentence, r.set_id) for r in by_base.collect()] == [("sim", "Not with KETO", "s1")]
