import pytest

from doseloom.functions.runon import split_run_on
from doseloom.operators.packed import cuts, infer_delimiters, judge, scanner, unpack_values, values

SCHEMA = "id long, src string, text string"


def split(text, *delimiters):
    return values(text, scanner(list(delimiters)))


def test_quotes_brackets_and_numbers_keep_separators():
    assert split('"A, chewable" | B (x, y) 1,500 mg | "C ""Forte"""', "comma", "bar") == ["A, chewable", "B (x, y) 1,500 mg", 'C "Forte"']


def test_list_marks_and_numbers_go():
    assert split("1) Abcde 5 mg 2) Fghij 10 mg daily", "comma") == ["Abcde 5 mg", "Fghij 10 mg daily"]
    assert split("- Abcde 5 mg\n- Fghij 2.5 mg", "line") == ["Abcde 5 mg", "Fghij 2.5 mg"]
    assert split("(1) Abcde 5 mg; (2) Fghij 6 mg", "semicolon") == ["Abcde 5 mg", "Fghij 6 mg"]


def test_joining_words_and_empty_values():
    assert split("Abcde 5 mg, , Fghij 6 mg and Klmno 7 mg,", "comma", "and") == ["Abcde 5 mg", "Fghij 6 mg", "Klmno 7 mg"]


def test_run_on_list():
    assert split_run_on("abcde 5 mg fghij 10 mg Klmnomax 2.5 mg Opqrs 1 mg") == ["abcde 5 mg", "fghij 10 mg", "Klmnomax 2.5 mg", "Opqrs 1 mg"]
    assert split_run_on("Abcde 5 mg every morning") == ["Abcde 5 mg every morning"] and split_run_on(" ") == []
    # six words ahead at most, no equals sign between, directions begin nothing
    assert len(split_run_on("Abcde 5 mg as needed for chest pain Fghij a a a a a 6 mg")) == 2 and len(split_run_on("Abcde 5 mg Fghij b b b b b b 6 mg")) == 2
    assert len(split_run_on("Abcde 5 mg twice = 10 mg/day")) == 1 and len(split_run_on("Abcde 10/325 mg Fghij 25 mcg/h")) == 2
    assert values("Abcde 5 mg Fghij 6 mg; Klmno", scanner(["semicolon"]), split_run_on) == ["Abcde 5 mg", "Fghij 6 mg", "Klmno"]


def test_unbalanced_quote_and_bracket_do_not_swallow():
    assert split('Abcde "x, Fghij (y, Klmno', "comma") == ['Abcde "x', "Fghij (y", "Klmno"]
    assert cuts("", scanner(["comma"])) == []


def rows(spark):
    one = [(i, "names", n) for i, n in enumerate(["Alpha", "Bravo", "Charlie, Delta", "Echo/Foxtrot", "Golf, Hotel", "India", "Juliet"])]
    return spark.createDataFrame([*one, (6, "names", "Juliet"), (90, "names", None), (91, "names", " "), (92, None, "Kilo"), (93, "names", "Lima" * 30000)], SCHEMA)


def test_inference_and_shapes(spark):
    taken = {(r.source, r.delimiter): r.taken for r in infer_delimiters(rows(spark), "text", "src").collect()}
    assert taken["names", "comma"]


def test_count_consistency_decides():
    """Two candidates with equally regular pieces: one cuts every field alike, the other at random."""
    plain = [("", "a", "a", True, 0, 50)]
    shapes = lambda d: [(d, "a", "a", True, 0, 78), (d, "0", "a", True, 0, 22)]
    steady, erratic = [("bar", "", "", False, 3, 33)], [("slash", "", "", False, k, 3) for k in range(2, 13)]
    got = {x[0]: x for x in judge([*plain, *shapes("bar"), *steady, *shapes("slash"), *erratic])}
    assert got["bar"][2] == got["slash"][2] == 0.78 and got["bar"][6] and not got["slash"][6]


def test_codes_without_words(spark):
    """A source of short codes, never alone in a field: words of four letters are not asked for."""
    df = spark.createDataFrame([(i, "codes", " | ".join(["ASA", "ZN", "MG", "K2"][: 2 + i % 3])) for i in range(30)], SCHEMA)
    assert {(r.id, r.pos): r.item for r in unpack_values(df, "text", "src").where("id = 2").collect()} == {(2, 1): "ASA", (2, 2): "ZN", (2, 3): "MG", (2, 4): "K2"}


def test_many_sources_are_joined(spark, monkeypatch):
    import doseloom.operators.packed as module

    want = sorted(map(str, unpack_values(rows(spark), "text", "src", ["id"]).collect()))
    monkeypatch.setattr(module, "MAX_SOURCES", 0)
    assert sorted(map(str, unpack_values(rows(spark), "text", "src", ["id"]).collect())) == want


def test_operator_edge_cases(spark):
    found = {(r.id, r.pos): r.item for r in unpack_values(rows(spark), "text", "src", ["id"]).collect()}
    assert found[2, 1] == "Charlie" and found[2, 2] == "Delta" and found[6, 1] == "Juliet" and found[92, 1] == "Kilo"
    assert not {90, 91} & {i for i, _ in found} and len(found[93, 1]) == 120000
    again = unpack_values(rows(spark), "text", "src")
    assert again.where("id = 6").count() == 2
    assert unpack_values(rows(spark).limit(0), "text", "src").count() == 0


def test_clashing_columns(spark):
    with pytest.raises(ValueError):
        unpack_values(rows(spark).withColumnRenamed("id", "pos"), "text", "src")
