"""Token counts of a public byte-pair tokenizer for whole columns.

Byte-pair tokenizers cut a text into words by a fixed pattern and merge bytes within a word only, so
the count of a text is the sum over its words. The pattern is run here as array operations over the
code points; each distinct word is encoded once per worker and its count kept by hash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import DIGIT, EDGE, SPACE, UNCASED, UPPER, Block, blocks, class_table, neighbours

#: Folder of the tokenizers' files; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("DOSELOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k"
#: Fixed value: the word pattern that the tokenizers were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLOTS = 1 << 20


@cache
def encoding(name: str = TOKENIZER, folder: str = TOKENIZERS):
    """The tokenizer read from its ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_starts(block: Block) -> np.ndarray:
    """Positions at which the words of the pattern start, over all rows of a block."""
    cp = block.cp
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[block.clipped()]
    letter = (kind >= UPPER) & (kind <= UNCASED)
    group = np.where(kind == SPACE, 1, np.where(letter, 2, np.where(kind == DIGIT, 3, 4))).astype(np.uint8)
    before, after = neighbours(group, block.starts)
    blank = np.zeros(n, bool)
    blank[1:] = cp[:-1] == 32
    blank &= before == 1
    starts = np.where(group == 1, (before != 1) | ((after != 1) & (after != EDGE)), (before != group) & ~blank)
    quote = np.flatnonzero((cp == 39) & starts & (after == 2))
    if len(quote):
        stop = block.starts[np.searchsorted(block.starts, quote, "right")]
        one = cp[quote + 1]
        two = np.where(quote + 2 < stop, cp[np.minimum(quote + 2, n - 1)], 0)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        hit = short | long
        q, end, stop = quote[hit], quote[hit] + np.where(long[hit], 3, 2), stop[hit]
        starts[q + 1] = False
        inner = end < stop
        starts[end[inner]] |= group[end[inner]] == 2
    return np.flatnonzero(starts)


class Counter:
    """Tokens of each word, by hash; a table of bounded size holds the latest words."""

    def __init__(self, name: str = TOKENIZER, folder: str = TOKENIZERS):
        self.encode = encoding(name, folder).encode_ordinary
        self.keys, self.counts = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.powers = np.zeros(0, np.uint64)

    def hashes(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(cp)
        size = np.diff(at, append=n)
        if (most := int(size.max(initial=0))) > len(self.powers):
            self.powers = np.cumprod(np.full(max(most, 64), 0x9E3779B97F4A7C15, np.uint64))
        within = np.arange(n) - np.repeat(at, size)
        h = np.add.reduceat((cp.astype(np.uint64) + np.uint64(7)) * self.powers[within], at) if n else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32)) | np.uint64(1)

    def words(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of tokens of every word of a block."""
        at = word_starts(block)
        if not len(at):
            return at, np.zeros(0, np.int32)
        h = self.hashes(block.cp, at)
        slot = (h >> np.uint64(44)).astype(np.intp)
        count = self.counts[slot]
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            ends = np.append(at[1:], len(block.cp))
            found = np.fromiter((len(self.encode(block.text(at[i], ends[i]))) for i in miss[first]), np.int32, len(new))
            count[miss] = found[back]
            where = (new >> np.uint64(44)).astype(np.intp)
            self.keys[where], self.counts[where] = new, found
        return at, count

    def totals(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; a null or empty one has none."""
        out = np.zeros(len(column), np.int64)
        for block in blocks(column):
            at, count = self.words(block)
            cum = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
            where = np.searchsorted(at, block.starts)
            out[block.first_row : block.first_row + block.rows] = cum[where[1:]] - cum[where[:-1]]
        return out


_counters: dict[tuple[str, str], Counter] = {}


def counter(name: str = TOKENIZER, folder: str = TOKENIZERS) -> Counter:
    """One counter per worker and tokenizer."""
    if (name, folder) not in _counters:
        _counters[name, folder] = Counter(name, folder)
    return _counters[name, folder]


def count_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """df with the text column replaced by its number of tokens (bigint). Null and empty texts have 0; rows are kept as they are.

    A ValueError is raised if another column has the name of the new one.
    """
    others = [c for c in df.columns if c != text]
    if into in others:
        raise ValueError(f"column {into} exists; give another name")
    kept = df.select(*[F.col(f"`{c}`") for c in others])
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{into}` bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, folder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(c.totals(batch.column(len(others))))], [*others, into])

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string")).mapInArrow(count, spec)
