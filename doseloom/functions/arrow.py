"""Arrow helpers shared by the operators that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def columns(names: Iterable[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def spec(df: DataFrame, added: str) -> str:
    """Schema of df's columns followed by those added, as DDL."""
    return ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema), added])


def arrow_type(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def no_clash(df: DataFrame, names: Iterable[str]) -> None:
    """A ValueError if df already has one of the names."""
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist in the input; rename them first")


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """First value and rows of each run of equal first values, over the borders of batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held
