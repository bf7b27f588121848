import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doseloom.operators.nested import EVERY, child_table, nested_tables, readable, shred
from doseloom.queries import label_values


def tables(*blocks, lists=frozenset()):
    """Rows (record, table, places, is_value, leaves) from the level sequences."""
    out = []
    for t in shred(list(enumerate(blocks)), frozenset(lists)):
        for i, r in enumerate(t.record):
            leaves = {name: values[i] for name, full, values in t.leaves if full[i]}
            out.append((int(r), t.path, tuple(map(int, t.places[i])), bool(t.is_value[i]), leaves))
    return sorted(out, key=str)


def brute(*blocks):
    """The same by recursion over the values."""
    out = []

    def leaves(value, name=""):
        if isinstance(value, dict):
            return {k: v for key, x in value.items() for k, v in leaves(x, f"{name}.{key}" if name else key).items()}
        return {} if value is None or isinstance(value, list) else {name: value}

    def lists(value, path, places, r):
        if isinstance(value, dict):
            for key, x in value.items():
                lists(x, f"{path}.{key}" if path else key, places, r)
        elif isinstance(value, list):
            for i, x in enumerate(value, 1):
                if x is not None:
                    out.append((r, f"{path}[]", (*places, i), not isinstance(x, (dict, list)), leaves(x)))
                lists(x, f"{path}[]", (*places, i), r)

    for r, b in enumerate(blocks):
        lists(b, "", (), r)
    if any(leaves(b) for b in blocks):
        out += [(r, "", (), False, leaves(b)) for r, b in enumerate(blocks)]
    return sorted(out, key=str)


scalar = st.one_of(st.none(), st.booleans(), st.integers(0, 3), st.sampled_from(["", "a", "bb"]))
value = st.recursive(scalar, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("xyz"), x, max_size=3)), max_leaves=12)
block = st.dictionaries(st.sampled_from("abc"), value, max_size=3)


@given(st.lists(block, min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_tables_equal_recursion(blocks):
    """Values of any depth and mixed kinds: every element of every list, its places and its leaves."""
    assert tables(*blocks) == brute(*blocks)


def test_siblings_and_deep_lists_are_kept():
    got = tables({"c": [{"name": "a", "kind": "k", "s": ["1", "2"], "d": [[{"e": [5]}]]}]})
    assert (0, "c[]", (1,), False, {"name": "a", "kind": "k"}) in got and (0, "c[].s[]", (1, 2), True, {"": "2"}) in got
    assert (0, "c[].d[][].e[]", (1, 1, 1, 1), True, {"": 5}) in got


def test_named_lists_take_single_values():
    got = tables({"a": "x", "b": {"c": "y"}, "d": None}, {"a": ["x"]}, lists={EVERY, "b[].c"})
    assert [x[:4] for x in got] == [(0, "a[]", (1,), True), (0, "b[]", (1,), False), (0, "b[].c[]", (1, 1), True), (1, "a[]", (1,), True)]


def test_wrappings():
    plain = {"a": ["x"], "b": "y"}
    for wrapped in (plain, {"t": plain}, json.dumps(plain), {"t": json.dumps(plain)}, [plain], [{"name": "a", "values": ["x"]}, {"name": "b", "values": "y"}]):
        assert readable(json.dumps(wrapped), "t") == plain
    for bad in ("{not json", "null,", "", "7", '["a", "b"]', "<x/>"):
        assert not isinstance(readable(bad, "t"), dict)


def test_operator_edge_cases(spark):
    long = {"a": ["x" * 200_000, None, "", {"text": "z"}], "n": 1, "p.q": [True], "components": {"strengths": {"v": 1}}}
    df = spark.createDataFrame([(1, json.dumps(long)), (1, json.dumps(long)), (2, None), (3, "{"), (4, "{}"), (5, "[" * 3000)], "rec long, t string")
    rows = nested_tables(df, "t", "t", {"components", "components[].strengths"}, keys=["rec"])
    got = {(r.table, tuple(r.places)): r["values"] for r in rows.where("rec = 1").collect()}
    assert set(got) == {("a[]", (1,)), ("a[]", (3,)), ("a[]", (4,)), ("", ()), ("`p.q`[]", (1,)), ("components[]", (1,)), ("components[].strengths[]", (1, 1))}
    assert len(got["a[]", (1,)][""]) == 200_000 and got["a[]", (4,)] == {"text": "z"} and got["", ()] == {"n": "1"} and got["`p.q`[]", (1,)] == {"": "true"}
    child = child_table(rows, "components[].strengths[]", {"amount": "v"}, ["rec"]).collect()
    assert [(r.rec, r.place, r.parent, r.amount) for r in child] == [(1, 1, [1], "1")]
    assert rows.where("rec <> 1").where("table <> ''").count() == 0 and nested_tables(df, "t", "t").where("table = 'a[]'").count() == 6
    assert nested_tables(df.limit(0), "t", "t").count() == 0
    with pytest.raises(ValueError):
        nested_tables(df.withColumnRenamed("rec", "places"), "t", "t")


def test_values_of_label_blocks(spark):
    block = {"route": ["ORAL", " ", None, {"text": "x"}, {"text": {"text": "y"}}], "brand": "B", "components": [{"name": "n"}, {"name": "m", "strengths": [{"unit": "mg"}, None, {"unit": None}]}, "text"], "adverse_reactions_table": [{"rows": [{"cells": ["1", "", "3"]}, {"cells": "4"}]}, "<b>html</b>", {"caption": "c"}]}
    df = spark.createDataFrame([(7, json.dumps(block)), (7, json.dumps(block))], "rec_id long, openfda string")
    places = lambda d: sorted((r.field, r.pos, r.row_pos, r.cell_pos) for r in d.collect())
    table = "adverse_reactions_table"
    want = [(table, 1, 1, 1), (table, 1, 1, 3), (table, 1, 2, 1), (table, 2, 0, 0), ("brand", 1, 0, 0), ("components", 2, 1, 0), ("components", 2, 3, 0), ("components", 3, 0, 0), ("route", 1, 0, 0), ("route", 4, 0, 0), ("route", 5, 0, 0)]
    assert places(label_values(df, "openfda", False, ["rec_id"])) == want == places(label_values(df, "openfda", True, ["rec_id"]))
    values = {(r.field, r.pos): r.value for r in label_values(df, "openfda", True, ["rec_id"]).where("row_pos = 0").collect()}
    assert values["route", 5] == "y" and values["brand", 1] == "B" and values[table, 2] == "<b>html</b>"


def test_repeated_names_and_many_wrappings():
    named = [{"name": "a", "values": ["x", None]}, {"name": "b", "value": "y"}, {"name": "a", "value": "z"}]
    assert readable(json.dumps(named), "t") == {"a": ["x", None, "z"], "b": "y"}
    block = {"a": ["x"], "b": ["y"]}
    for _ in range(12):
        block = [{"t": block}]
    assert readable(json.dumps(block), "t") == {"a": ["x"], "b": ["y"]}
