"""Texts of an Arrow batch as one array of code points, with class tables for them.

Everything here works on whole arrays, so the Python side of an operator costs a few array
passes per batch and no loop over characters or rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Classes of a character.
OTHER, SPACE, UPPER, LOWER, UNCASED, DIGIT, MARK = range(7)
#: Class outside a row.
EDGE = 7
#: Code points from here on share the class and fold of the last table entry's neighbours (plane 3 and up are unassigned or rare).
TABLE_SIZE = 0x32000
#: Characters in one block, unless one text alone is longer.
BLOCK_CHARS = 2_000_000
#: White space as the tokenizer's and Java's Unicode class has it.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    of = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": UNCASED, "Lm": UNCASED, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Mn": MARK, "Mc": MARK, "Me": MARK}
    table = np.fromiter((of.get(unicodedata.category(chr(i)), OTHER) for i in range(TABLE_SIZE)), np.uint8, TABLE_SIZE)
    table[SPACES] = SPACE
    return table


@cache
def lower_table() -> np.ndarray:
    """Lower case of each code point, where that is a single one."""
    return np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(TABLE_SIZE)), np.uint32, TABLE_SIZE)


@cache
def fold_table() -> np.ndarray:
    """Each code point without case, accents and compatibility forms; 0 for what is dropped."""
    out = np.zeros(TABLE_SIZE, np.uint32)
    for i in range(TABLE_SIZE):
        if 0xD800 <= i < 0xE000:
            continue
        kept = [c for c in unicodedata.normalize("NFKD", chr(i)) if unicodedata.category(c) != "Mn"]
        low = kept[0].lower() if kept else ""
        out[i] = ord(low[0]) if low else 0
    return out


@dataclass
class Block:
    """Consecutive rows of a batch: their code points, and where each row starts (one more start than rows)."""

    cp: np.ndarray
    starts: np.ndarray
    first_row: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def clipped(self) -> np.ndarray:
        return np.minimum(self.cp, TABLE_SIZE - 1)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """Row within the block of each position."""
        return np.searchsorted(self.starts, at, "right") - 1

    def text(self, start: int, end: int) -> str:
        return self.cp[start:end].tobytes().decode("utf-32-le")


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string())


def blocks(column: pa.Array | pa.ChunkedArray, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The column's texts in blocks of at most so many bytes, a longer text alone. A null counts as an empty text."""
    column = _flat(column).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + chars, "right")) - 1)
        end = min(end, n)
        part = whole[at[row] : at[end]]
        cp = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        yield Block(cp, lead[at[row : end + 1] - at[row]].astype(np.int64), row)
        row = end


def neighbours(kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character before and after each position, EDGE at the ends of a row."""
    before, after = np.empty_like(kind), np.empty_like(kind)
    if len(kind):
        before[1:], after[:-1] = kind[:-1], kind[1:]
        full = starts[:-1][np.diff(starts) > 0]
        before[full] = EDGE
        after[np.concatenate((full[1:] - 1, [len(kind) - 1]))] = EDGE
    return before, after
