"""Tables in HTML text as rows, and names cleaned for a list of known names."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, no_clash, quoted, spec
from ..functions.text import collapse


class _Cells(HTMLParser):
    """Collects (table, row, cell, text) with entities decoded; a nested table goes on its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, int, str]] = []
        self.tables, self.open = 0, []  # of each open table: its number, row, cell, text or None outside of cells

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.open.append([self.tables, 0, 0, None])
        elif self.open and tag == "tr":
            self._close()
            self.open[-1][1:] = [self.open[-1][1] + 1, 0, None]
        elif self.open and tag in ("td", "th"):
            self._close()
            self.open[-1][2:] = [self.open[-1][2] + 1, []]
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1][3] is not None:
            self.open[-1][3].append(data)

    def _close(self):
        table, row, cell, text = self.open[-1]
        if text is not None:
            self.found.append((table, max(row, 1), cell, " ".join("".join(text).split())))
            self.open[-1][3] = None


def cells_of(html: str) -> list[tuple[int, int, int, str]]:
    parser = _Cells()
    parser.feed(html)
    parser.close()
    while parser.open:
        parser._close()
        parser.open.pop()
    return sorted(parser.found)


def html_cells(df: DataFrame, column: str) -> DataFrame:
    """One row per cell of the tables in an HTML text: df's other columns, table_no, row_no, cell_no (from 1), cell.

    Cells are plain text with white space collapsed and entities decoded; empty ones are kept. Texts without a table,
    null and empty ones give no rows; tables that are not closed end with the text. Existing columns of the new names
    are a ValueError.
    """
    new = ["table_no", "row_no", "cell_no", "cell"]
    no_clash(df, new)
    others = [c for c in df.columns if c != column]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, t in enumerate(batch.column(len(others)).to_pylist()) if t and "<table" in t.lower() for c in cells_of(t)]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3)), pa.array([r[4] for r in rows], pa.string())], [*others, *new])

    return df.select(*columns(others), F.col(quoted(column)).cast("string")).mapInArrow(read, spec(df.select(*columns(others)), "table_no int, row_no int, cell_no int, cell string"))


def without_tag(name: Column) -> Column:
    """A class name without its bracketed tag."""
    return F.regexp_replace(name, r"\s*\[[A-Za-z]+\]\s*$", "")


def without_footnotes(name: Column) -> Column:
    """A name without brackets that hold single letters or digits only."""
    return F.regexp_replace(name, r"\s*\(\s*\w?(\s*,\s*\w?)*\s*\)", "")


def known_names(*columns_of_names: DataFrame, least: int = 3) -> DataFrame:
    """name: the distinct cleaned names of several one-column tables, lower case, of at least so many letters."""
    out = None
    for part in columns_of_names:
        name = F.lower(collapse(F.regexp_replace(without_footnotes(without_tag(F.col(quoted(part.columns[0])))), r"[0-9^*]", "")))
        part = part.select(name.alias("name")).where(F.length("name") >= least)
        out = part if out is None else out.union(part)
    return out.distinct()
