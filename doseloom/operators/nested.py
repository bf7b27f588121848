"""Nested JSON records as related flat tables, by columnar shredding.

Every record is written as columns of leaf values, one for each path of keys and lists that leads to a value, with a
repetition level (at which list a value goes on) and a definition level (how much of its path is there). Paths are
found in the records themselves. For every list on a path there is a table with one row per element; the places of
its rows, which link it to its parent, are read back from the level sequences alone, for a whole batch at once.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, no_clash, quoted, spec

#: What stands for a block that can't be read.
_UNREADABLE = object()
#: In `lists`: every field of the block itself is a list.
EVERY = "*"


@dataclass
class Leaf:
    """One leaf column of a batch: record of each entry, repetition level, definition level, value.

    Level k of repetition means that list k (counted from the outside) goes on; 0 begins a record. Every list adds two to
    the definition level: its element is there, and is not null; a value that is there adds one.
    """

    record: list[int] = field(default_factory=list)
    rep: list[int] = field(default_factory=list)
    deep: list[int] = field(default_factory=list)
    value: list = field(default_factory=list)

    def put(self, record: int, rep: int, deep: int, value) -> None:
        self.record.append(record)
        self.rep.append(rep)
        self.deep.append(deep)
        self.value.append(value)

    def places(self, levels: int) -> np.ndarray:
        """Place (from 1) of each entry at each of its lists, from the levels: an entry of repetition level r is the next
        one in list r, the first one in every deeper list; r = 0 begins a record."""
        rep = np.asarray(self.rep, np.int64)
        out = np.empty((len(rep), levels), np.int64)
        for k in range(1, levels + 1):
            fresh = rep < k
            step = np.cumsum((rep == k) | fresh)
            out[:, k - 1] = step - np.maximum.accumulate(np.where(fresh, step, 0)) + 1
        return out


class Node:
    """A place in the records' common structure: it may hold values, fields and a list, as different records have it."""

    def __init__(self, path: str, name: str, depth: int, forced: frozenset[str]):
        self.path, self.name, self.depth, self.forced = path, name, depth, forced
        self.is_list = path in forced or (EVERY in forced and bool(path) and not depth and "." not in path)
        self.leaf: Leaf | None = None
        self.fields: dict[str, Node] = {}
        self.item: Node | None = None

    def learn(self, value) -> None:
        """Adds what a value needs."""
        if self.is_list and not isinstance(value, list):
            value = [] if value is None else [value]
        if isinstance(value, list):
            if self.item is None:
                self.item = Node(f"{self.path}[]", "", self.depth + 1, self.forced)
            for x in value:
                self.item.learn(x)
        elif isinstance(value, dict):
            for key, x in value.items():
                if key not in self.fields:
                    step = f"`{key}`" if "." in key or "[" in key else key
                    self.fields[key] = Node(f"{self.path}.{step}" if self.path else step, f"{self.name}.{step}" if self.name else step, self.depth, self.forced)
                self.fields[key].learn(x)
        elif value is not None and self.leaf is None:
            self.leaf = Leaf()

    def settle(self) -> None:
        """Elements without any leaf below them get one, so that their places are kept."""
        if self.item is not None:
            self.item.settle()
            if not any(True for _ in self.item.leaves()):
                self.item.leaf = Leaf()
        for x in self.fields.values():
            x.settle()

    def leaves(self) -> Iterator[Leaf]:
        if self.leaf is not None:
            yield self.leaf
        for x in self.fields.values():
            yield from x.leaves()
        if self.item is not None:
            yield from self.item.leaves()

    def lists(self) -> Iterator[Node]:
        """The elements of every list here and below."""
        if self.item is not None:
            yield self.item
            yield from self.item.lists()
        for x in self.fields.values():
            yield from x.lists()

    def own(self) -> Iterator[tuple[str, Leaf]]:
        """Leaves with no further list above them: name below this node, leaf."""
        if self.leaf is not None:
            yield self.name, self.leaf
        for x in self.fields.values():
            yield from x.own()

    def miss(self, record: int, rep: int, deep: int) -> None:
        for leaf in self.leaves():
            leaf.put(record, rep, deep, None)

    def write(self, value, record: int, rep: int, deep: int) -> None:
        """Writes a value into the leaf columns; each column below this node gets at least one entry."""
        if self.is_list and not isinstance(value, list):
            value = [] if value is None else [value]
        many, keyed = isinstance(value, list), isinstance(value, dict)
        if self.leaf is not None:
            there = value is not None and not many and not keyed
            self.leaf.put(record, rep, deep + there, value if there else None)
        for key, x in self.fields.items():
            if keyed and key in value:
                x.write(value[key], record, rep, deep)
            else:
                x.miss(record, rep, deep)
        if self.item is not None:
            if not many or not value:
                self.item.miss(record, rep, deep)
            else:
                for i, x in enumerate(value):
                    self.item.write(x, record, self.depth + 1 if i else rep, deep + (1 if x is None else 2))


@dataclass
class Table:
    """Rows of one list: its path, record and places of each element that is not null, whether it is a value, and its leaves."""

    path: str
    record: np.ndarray
    places: np.ndarray
    is_value: np.ndarray
    leaves: list[tuple[str, np.ndarray, list]]


def shred(blocks: list[tuple[int, dict]], lists: frozenset[str] = frozenset()) -> list[Table]:
    """The tables of a batch of records (number, block), from the levels of their leaf columns."""
    root = Node("", "", 0, lists)
    for _, block in blocks:
        root.learn(block)
    root.settle()
    for record, block in blocks:
        for key, value in block.items():  # a record writes the columns of its own fields only
            root.fields[key].write(value, record, 0, 0)
    out = []
    for top in root.fields.values():
        for node in top.lists():
            k, guide = node.depth, next(node.leaves())
            rep, deep = np.asarray(guide.rep), np.asarray(guide.deep)
            begins = np.flatnonzero(rep <= k)  # every element of this list begins with one entry of each column below it
            there = deep[begins] >= 2 * k
            places = guide.places(k)[begins]
            leaves = []
            is_value = np.zeros(len(begins), bool)
            for name, leaf in node.own():
                full = np.asarray(leaf.deep) == 2 * k + 1
                if leaf is node.leaf:
                    is_value = full
                leaves.append((name, full[there], [leaf.value[i] for i in np.flatnonzero(there)]))
            out.append(Table(node.path, np.asarray(guide.record)[begins][there], places[there], is_value[there], leaves))
    plain = [(name, leaf) for x in root.fields.values() for name, leaf in x.own() if leaf.record]
    if plain:  # fields that are no lists: one row per record
        records = np.array([r for r, _ in blocks], np.int64)
        at = {int(r): i for i, r in enumerate(records)}
        leaves = []
        for name, leaf in plain:
            values: list = [None] * len(records)
            for r, v in zip(leaf.record, leaf.value):
                values[at[r]] = v
            leaves.append((name, np.array([v is not None for v in values], bool), values))
        out.append(Table("", records, np.zeros((len(records), 0), np.int64), np.zeros(len(records), bool), leaves))
    return out


def readable(text: str | None, name: str):
    """The block as a dict of fields, without wrappings; _UNREADABLE if there is no such block."""
    block = text
    while True:  # every step takes a wrapping off
        if isinstance(block, str):
            try:
                block = json.loads(block)
            except (ValueError, RecursionError):
                return _UNREADABLE
        elif isinstance(block, dict):
            if len(block) == 1 and name in block and isinstance(block[name], (dict, list, str)):
                block = block[name]
            elif "name" in block and set(block) <= {"name", "values", "value"} and isinstance(block["name"], str):
                return _named([block])
            else:
                return block
        elif isinstance(block, list):
            if block and all(isinstance(x, dict) and isinstance(x.get("name"), str) and set(x) <= {"name", "values", "value"} for x in block):
                return _named(block)
            if len(block) == 1:
                block = block[0]
            elif block and all(isinstance(x, dict) for x in block) and len({k for x in block for k in x}) == sum(map(len, block)):
                return {k: v for x in block for k, v in x.items()}
            else:
                return _UNREADABLE
        else:
            return _UNREADABLE


def _named(block: list[dict]) -> dict:
    """Fields of a list of {name, values}; the values of a repeated name follow each other."""
    out: dict = {}
    for x in block:
        name, value = x["name"], x.get("values", x.get("value"))
        out[name] = [*as_list(out[name]), *as_list(value)] if name in out else value
    return out


def as_list(value) -> list:
    """A list as it is, nothing as none, a single value as a list of one."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _rows(tables: list[Table], rows: int, with_values: bool) -> pa.ListArray:
    """The rows of all tables by record, in order of table and place."""
    kind = _struct(with_values)
    if not tables or not sum(len(t.record) for t in tables):
        return pa.array([[]] * rows, pa.list_(kind))
    record = np.concatenate([t.record for t in tables])
    names = pa.array([t.path for t in tables]).take(pa.array(np.repeat(np.arange(len(tables)), [len(t.record) for t in tables])))
    places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate([np.full(len(t.record), t.places.shape[1]) for t in tables])))), pa.int32()), pa.array(np.concatenate([t.places.ravel() for t in tables]), pa.int32()))
    # leaves of each row: name and value where there is one
    row_at, key, value, base = [], [], [], 0
    for t in tables:
        for name, full, values in t.leaves:
            for i in np.flatnonzero(full):
                v = values[i]
                v = v if isinstance(v, str) else json.dumps(v)
                if with_values or v.strip():
                    row_at.append(base + i)
                    key.append(name)
                    value.append(v)
        base += len(t.record)
    at = np.asarray(row_at, np.int64)
    order = np.argsort(at, kind="stable")
    offsets = pa.array(np.searchsorted(at[order], np.arange(base + 1)), pa.int32())
    keys = pa.array(key, pa.string()).take(pa.array(order))
    is_value = pa.array(np.concatenate([t.is_value for t in tables]))
    if with_values:
        last = pa.MapArray.from_arrays(offsets, keys, pa.array(value, pa.string()).take(pa.array(order)))
    else:
        last = pa.ListArray.from_arrays(offsets, keys)
    by_record = pa.array(np.argsort(record, kind="stable"))
    struct = pa.StructArray.from_arrays([x.take(by_record) for x in (names, places, is_value, last)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(np.sort(record), np.arange(rows + 1)), pa.int32()), struct)


def _struct(with_values: bool) -> pa.DataType:
    return pa.struct([("table", pa.string()), ("places", pa.list_(pa.int32())), ("is_value", pa.bool_()), ("values", pa.map_(pa.string(), pa.string())) if with_values else ("filled", pa.list_(pa.string()))])


def nested_tables(df: DataFrame, column: str, name: str = "", lists: set[str] | None = None, with_values: bool = True, keys: list[str] | None = None) -> DataFrame:
    """One row per element of every list of a JSON block, at any depth: df's other columns, then table, places, is_value and values.

    table is the path of the list (components[].strengths[]), places the element's place (from 1) in each list on that path;
    all but the last one are the places of its parent row, in the table of the list above. is_value tells a plain value
    from an object. values maps the names of the leaves below the element, with no further list between, to their texts
    ('' for a plain value); numbers and booleans are in JSON notation. Fields that are in no list make one row of the
    table '' (places empty) per record. Null elements give no row but hold their place. A null, unreadable or empty
    block gives no rows. Wrappings of a block (its name, JSON within a string, a list of {name, values}, where the
    values of a repeated name count on) are taken off, however many. lists names paths of fields that are lists even
    where a single value or object stands (EVERY: all fields of the block). with_values=False gives filled, the names
    of leaves with a value that is not blank, in place of values. With keys, rows that agree in them are one record.
    Existing columns of the new names are a ValueError.
    """
    new = ["table", "places", "is_value", "values" if with_values else "filled"]
    no_clash(df, new)
    forced = frozenset(lists or ())
    others = [c for c in df.columns if c != column]
    n = len(others)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            found = [(i, b) for i, t in enumerate(batch.column(n).to_pylist()) if t is not None and isinstance(b := readable(t, name), dict)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], _rows(shred(found, forced), batch.num_rows, with_values)], [*others, "_rows"])

    last = "values:map<string,string>" if with_values else "filled:array<string>"
    flat = df.select(*columns(others), F.col(quoted(column)).cast("string")).mapInArrow(flatten, spec(df.select(*columns(others)), f"_rows array<struct<table:string,places:array<int>,is_value:boolean,{last}>>"))
    if keys:
        flat = flat.where(F.size("_rows") > 0).dropDuplicates(keys)
    return flat.select(*columns(others), F.inline("_rows"))


def child_table(rows: DataFrame, table: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """One table of nested_tables' rows: keys, place, parent (places of the parent row, an array) and the named fields (new name -> leaf name)."""
    places = F.col("places")
    picked = [F.try_element_at("values", F.lit(leaf)).alias(as_) for as_, leaf in fields.items()]
    return rows.where(F.col("table") == table).select(*columns(keys), F.element_at(places, -1).alias("place"), F.slice(places, 1, F.size(places) - 1).alias("parent"), *picked)
