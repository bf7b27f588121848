import difflib
import random

import pytest
from pyspark.sql import functions as F

from doseloom.functions.entries import parse_entries
from doseloom.operators import amounts, resolve, rollup

BOOK = "name_key string, display string, ingredient_sets array<array<string>>"
DIM = "substance string, bases array<string>"


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("ONDANSETRON HYDROCHLORIDE", ["Ondansetron"]), ("SERTRALINE HYDROCHLORIDE", ["sertraline"]), ("MIXED", ["b", "A", "b"]), ("EMPTY", [])], DIM)


@pytest.fixture(scope="module")
def book(spark):
    rows = [("trazodone", "Trazodone", [["TRAZODONE"]]), ("zofran", "Zofran", [["ONDANSETRON"], ["ONDANSETRON HYDROCHLORIDE"]]), ("acetam", "Acetam", [["ACETAM"], ["ACETAM", "X"]]), ("abcdefgi", "Abcdefgi", [["I"]]), ("abcdefgj", "Abcdefgj", [["J"]]), ("qwertyui", "Qwertyui", [["Q"]]), ("qwertyuo", "Qwertyuo", [["Q"]]), ("twoform", "Twoform", [["P"], ["Q", "R"]]), ("coumarin", "COUMARIN", [["COUMARIN"]]), ("zoloft tablets film", "Zoloft", [["SERTRALINE HYDROCHLORIDE"]])]
    return spark.createDataFrame(rows, BOOK)


def test_close_keys_against_all_pairs():
    """The bound on letters leaves out no key that is close enough."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 9)))
    keys = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(300)]
    known = resolve.Keys(keys)
    for _ in range(150):
        k = list(rng.choice(keys))
        k[rng.randrange(len(k))] = rng.choice("abcx")
        typed = " ".join("".join(k).split()) or "a"
        want = sorted(((x, resolve.likeness(typed, x)) for x in set(keys)), key=lambda x: (-x[1], x[0]))
        assert known.close(typed) == [x for x in want if x[1] >= resolve.CLOSE][:5]
    assert resolve.likeness("trazdone", "trazodone") > 0.9 and resolve.likeness("zoloft", "zoloft tablets film") == 1.0
    assert resolve.likeness("ab", "ab cd") == max(difflib.SequenceMatcher(None, "ab", "ab cd").ratio(), 1.0)


def test_local_matches(spark, book, monkeypatch):
    typed = spark.createDataFrame([(n,) for n in ("Trazdone ", "TRAZODONE", "qqq", None, "", "abcdefgh", "qwertyux", "zofran", "acetam", "twoform", "zoloft", "abcdxxgi")], "name string")
    rows = resolve.local_matches(typed, book).collect()
    got = {r.name: (r.status, r.matched_name, r.ingredient_set) for r in rows}
    assert got["Trazdone "] == got["TRAZODONE"] == ("matched", "Trazodone", ["TRAZODONE"]) and got["zoloft"][1] == "Zoloft"
    assert got["abcdefgh"][:2] == ("needs_confirmation", None) and got["qwertyux"] == ("matched", "Qwertyui", ["Q"])  # rivals of equal sets are none
    assert got["zofran"][0] == "needs_confirmation" and got["acetam"] == ("matched", "Acetam", ["ACETAM"]) and got["twoform"][0] == "needs_confirmation"
    assert all(got[x][0] == "unresolved" for x in ("qqq", None, "", "abcdxxgi"))
    said = {r.name: r.candidates for r in rows}
    assert said["abcdefgh"] == "Abcdefgi → I; Abcdefgj → J" and said["abcdxxgi"].startswith("Abcdefgi → I") and said["twoform"] == "Twoform → P; Twoform → Q, R"
    monkeypatch.setattr(resolve, "BLOCK_KEYS", 2)
    assert sorted(map(str, resolve.local_matches(typed, book).collect())) == sorted(map(str, rows))
    assert resolve.local_matches(typed.limit(0), book).count() == 0 and {r.status for r in resolve.local_matches(typed, book.limit(0)).collect()} == {"unresolved"}


def test_rollup(spark, dim):
    rows = spark.createDataFrame([("a", ["SERTRALINE HYDROCHLORIDE", "MIXED", "Plain"]), ("b", []), ("c", None), ("d", ["EMPTY"])], "k string, s array<string>")
    assert {r.k: r.bases for r in rollup.set_bases(rows, dim, "k", "s").collect()} == {"a": ["a", "b", "plain", "sertraline"], "b": [], "c": [], "d": ["empty"]}
    sets = spark.createDataFrame([(["ONDANSETRON"],), (["ONDANSETRON HYDROCHLORIDE"],), (["ONDANSETRON HYDROCHLORIDE"],), (["X", "ONDANSETRON"],), (None,)], "ingredient_set array<string>")
    want = spark.createDataFrame([(1, ["Ondansetron"]), (2, ["none"]), (3, [])], "k int, bases array<string>")
    found = rollup.sets_with_bases(want, "k", "bases", sets, dim)
    assert sorted(map(str, found.collect())) == ["Row(k=1, ingredient_set=['ONDANSETRON HYDROCHLORIDE'])", "Row(k=1, ingredient_set=['ONDANSETRON'])"]
    best = rollup.plainest(found, dim, "k").first()
    assert (best.ingredient_set, best.n_sets, best.n_rollups) == (["ONDANSETRON"], 2, 1)
    labels = spark.createDataFrame([("s1", ["B", "A"], 1), ("s2", ["A", "B"], 2)], "set_id string, s array<string>, n int")
    assert [(r.key, r.set_id) for r in rollup.set_index(labels, "s", "set_id", "n").collect()] == [("A|B", "s2")]


EXT = "query string, name string, concept string, rank int, ratio double, bases array<string>"


def test_cascade(spark, book, dim):
    typed = spark.createDataFrame([(n,) for n in ("zofran", "Coumadin", "newname", "twins", "nothing", "far")], "name string")
    ext = [("coumadin", "Coumadin", "1", 1, 1.0, ["warfarin"]), ("newname", "New Name", "2", 1, 0.8, ["Ondansetron"]), ("newname", "worse", "9", 2, 0.9, ["x"]), ("twins", "Twin A", "3", 1, 0.9, ["a"]), ("twins", "Twin B", "4", 1, 0.9, ["b"]), ("far", "far away", "5", 1, 0.5, ["warfarin"])]
    sets = spark.createDataFrame([(["WARFARIN"],), (["ONDANSETRON"],), (["ONDANSETRON HYDROCHLORIDE"],)], "ingredient_set array<string>")
    got = {r.name: (r.status, r.ingredient_set) for r in rollup.resolve_names(typed, book, dim, spark.createDataFrame(ext, EXT), sets).collect()}
    assert got["zofran"] == ("matched", ["ONDANSETRON"])  # salt forms of one molecule
    assert got["Coumadin"][0] in ("unresolved", "matched_via_rxnorm") and got["newname"] == ("matched_via_rxnorm", ["ONDANSETRON"])
    assert got["twins"][0] == "needs_confirmation" and got["nothing"] == got["far"] == ("unresolved", None)


def test_entry_cascade(spark, book, dim):
    texts = ["Zofran (ondansetron hydrochloride) 4 mg daily", "trazdone 50 mg daily", "Foo (aspirin) 81 mg daily", "Foo (unknownium) 5 mg", "5 mg daily", "Trazodone (generic) 5 mg", "Oleptro (trazodone/zzz) 50/5 mg daily"]
    entries = parse_entries(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t")
    names = rollup.resolve_names(spark.createDataFrame([(x,) for x in ("trazdone", "Foo", "aspirin", "unknownium", "Oleptro", "trazodone and zzz", "Zofran", "Foo aspirin", "Oleptro trazodone / zzz")], "name string"), book, dim, spark.createDataFrame([], EXT), spark.createDataFrame([(["TRAZODONE"],)], "ingredient_set array<string>"))
    labels = spark.createDataFrame([(["ONDANSETRON"], ["Other"]), (["ONDANSETRON HYDROCHLORIDE"], ["Zofran"]), (["TRAZODONE"], ["Oleptro"])], "ingredient_set array<string>, brand_names array<string>")
    found = rollup.resolve_entries(entries, names, dim, labels, spark.createDataFrame([("aspirin",)], "name string"), "id")
    got = {r.id: (r.step, r.status, r.ingredient_set) for r in found.collect()}
    assert got[0] == (0, "matched", ["ONDANSETRON HYDROCHLORIDE"]) and got[1] == (1, "matched", ["TRAZODONE"]) and got[2] == (2, "matched_ingredient_only", ["ASPIRIN"])
    assert got[3][:2] == (3, "unresolved") and got[4][:2] == (3, "unresolved") and got[5] == (0, "matched", ["TRAZODONE"]) and got[6][:2] == (3, "unresolved")
    index = spark.createDataFrame([("ONDANSETRON HYDROCHLORIDE", "s1"), ("TRAZODONE", "s2")], "key string, set_id string")
    records = spark.createDataFrame([("s1",)], "set_id string")
    at = {r.id: (r.set_id, r.no_label, r.bases) for r in rollup.attach_records(found, index, records, dim, "id").collect()}
    assert at[0] == ("s1", False, ["ondansetron"]) and at[1][0] is None and at[2] == ("", True, ["aspirin"]) and at[3] == (None, False, None)


def test_totals(spark):
    texts = [("a (apap) 500 mg 2 tablets four times daily", ["apap"]), ("b (apap/codeine) 300/30 mg daily", ["apap", "codeine"]), ("c (levo) 88 mcg daily", ["levo"]), ("d (mtx) 12.5 mg 2 tablets once weekly", ["mtx"]), ("e 25 mcg/h patch", ["fentanyl"]), ("f (oxy) 20 mg bid", ["oxy"]), ("g 5 mL daily", ["x"]), ("h (q) 5 mg", ["q"]), ("k (w) 5 mg daily Mon/Wed/Fri", ["w"]), ("m 10 mg daily prn", ["y", "z"]), ("n (levo) 112 mcg daily", ["levo"])]
    df = spark.createDataFrame([(1, i, t, b, t[0]) for i, (t, b) in enumerate(texts)], "list_id int, pos int, t string, bases array<string>, display_name string")
    each = amounts.entry_amounts(parse_entries(df, "t").drop("t"))
    factors = spark.createDataFrame([("oxy", 1.5), ("codeine", 0.15), (amounts.PATCH, 2.4)], "ingredient string, factor double")
    totals = amounts.list_totals(each, factors, ["list_id"])
    got = {r.ingredient: (r.total, r.unit, r.period, r.text, r.mme) for r in totals.collect()}
    assert got["apap"] == (4300.0, "mg", "day", "4,300 mg (4.3 g)/day", None) and got["levo"] == (0.2, "mg", "day", "200 mcg (0.2 mg)/day", None)
    assert got["mtx"] == (25.0, "mg", "week", "25 mg/week", None) and got["fentanyl"] == (25.0, "mcg/h", "rate", "25 mcg/h continuous", 60.0) and got["oxy"][4] == 60.0
    assert got["w"][:3] == (15.0, "mg", "week") and got["y/z"][3] == "10 mg/day max" and "x" not in got and "q" not in got and got["codeine"][0] == 30.0
    assert amounts.total_mme(totals, ["list_id"]).first().mme == 124.5 and amounts.daily_mg(totals, ["list_id"]).where("base = 'apap'").first().mg == 4300.0
    assert {r.ingredient: r.entries for r in totals.collect()}["levo"] == ["c", "n"]
    assert amounts.list_totals(each.limit(0), factors, ["list_id"]).count() == 0
