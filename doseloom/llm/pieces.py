"""Cutting texts that are longer than a limit of tokens into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import Block, blocks
from .sentences import bounds
from .tokens import TOKENIZER, TOKENIZERS, Counter, counter

#: Cost of a cut before a paragraph, a sentence or list item, after a comma or at a line break, before any word, within a word.
PARAGRAPH, SENTENCE, CLAUSE, WORD, WITHIN = 0.0, 0.4, 2.0, 4.0, 8.0
#: Weight of a piece's squared distance from the even size, as a share of the limit; cost of each token of overlap beyond the wanted.
IMBALANCE, EXCESS = 6.0, 0.05
#: A word of more tokens than this is taken in slices of so many characters.
LONG_WORD, SLICE = 48, 24
#: Where natural boundaries are further apart than this part of a piece, every word between is a boundary too.
GAP = 6
#: Texts of more boundaries than this are solved alone.
MANY = 5_000


class Task:
    """Boundaries of one text: words that a piece may end before, tokens before each word and in all, cost of each cut."""

    def __init__(self, at: np.ndarray, cum: np.ndarray, cost: np.ndarray, limit: int, overlap: int):
        late = cum[at] > overlap
        at, cost = at[late], cost[late]
        total = int(cum[-1])
        self.at, self.cum = at, cum
        self.back = np.searchsorted(cum, cum[at] - overlap, "right") - 1  # first word of the piece after the cut
        ends = np.append(cum[at], total)
        begins = np.concatenate(([0], cum[self.back]))  # of the text's start, then of each cut
        few = max(1, -(-(total - overlap) // (limit - overlap)))
        self.aim = ends - (total + (few - 1) * overlap) / few
        self.price = np.append(cost + EXCESS * (cum[at] - overlap - cum[self.back]), 0.0)
        self.low = np.searchsorted(begins, ends - limit)
        self.begins = begins.astype(float)
        self.size = len(ends)
        self.came: np.ndarray | None = None
        self.value = np.inf

    def pieces(self) -> list[tuple[int, int]]:
        """First and last (exclusive) word of each piece; none if no choice of cuts keeps the limit."""
        if not np.isfinite(self.value):
            return []
        cuts, j = [], self.size
        while j:
            cuts.append(j)
            j = int(self.came[j])
        first = [0, *(int(self.back[j - 1]) for j in cuts[:0:-1])]
        last = [int(self.at[j - 1]) if j <= len(self.at) else len(self.cum) - 1 for j in cuts[::-1]]
        return list(zip(first, last))


def solve(tasks: list[Task], limit: int) -> None:
    """Dynamic programming over the boundaries of many texts in step.

    best[j], the least cost of pieces that end at boundary j, is the least over the pieces' beginnings b of
    best[b] + scale * (end - b - even size)^2, plus the cost of the cut; the part that only b decides is kept in `held`.
    """
    scale = IMBALANCE / (limit * limit)
    tasks = sorted(tasks, key=lambda t: -t.size)
    done = 0
    while done < len(tasks):  # texts of like numbers of boundaries together
        group = [t for t in tasks[done:] if 4 * t.size >= tasks[done].size]
        done += len(group)
        rows, wide = len(group), group[0].size
        begins, held = np.zeros((rows, wide + 1)), np.full((rows, wide + 1), np.inf)
        low, aim, price, came = np.zeros((rows, wide), np.intp), np.zeros((rows, wide)), np.zeros((rows, wide)), np.zeros((rows, wide + 1), np.int32)
        for i, t in enumerate(group):
            n = t.size
            begins[i, :n], low[i, :n], aim[i, :n], price[i, :n] = t.begins, t.low, t.aim, t.price
        own = scale * begins * begins
        held[:, 0] = own[:, 0]
        flat_held, flat_begins, base = held.ravel(), begins.ravel(), np.arange(rows) * (wide + 1)
        sizes = np.array([t.size for t in group])
        value = np.full((rows, wide), np.inf)
        active = np.searchsorted(-sizes, -np.arange(1, wide + 1), "right")
        for j in range(wide):
            k = active[j]
            lo = low[:k, j]
            window = np.arange(j + 1 - int(lo.min()))
            at = np.minimum(lo[:, None] + window, j + 1)  # held[j + 1] is not known yet: infinite
            at += base[:k, None]
            trial = flat_held[at] - (2 * scale * aim[:k, j])[:, None] * flat_begins[at]
            i = trial.argmin(1)
            v = trial[np.arange(k), i] + scale * aim[:k, j] ** 2 + price[:k, j]
            value[:k, j] = v
            came[:k, j + 1] = lo + i
            if j + 1 < wide:
                held[:k, j + 1] = v + own[:k, j + 1]
        for i, t in enumerate(group):
            t.value, t.came = float(value[i, t.size - 1]), came[i]


def _slices(block: Block, at: np.ndarray, count: np.ndarray, c: Counter, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, those of many tokens in slices if their row is long; whether each is the rest of a word."""
    big = np.flatnonzero(count > LONG_WORD)
    big = big[long[np.searchsorted(block.starts, at[big], "right") - 1]]
    if not len(big):
        return at, count, np.zeros(len(at), bool)
    new_at, new_count, rest = [], [], []
    ends = np.append(at[1:], len(block.cp))
    done = 0
    for i in big:
        new_at.append(at[done:i])
        new_count.append(count[done:i])
        rest.append(np.zeros(i - done, bool))
        pos = np.arange(at[i], ends[i], SLICE)
        new_at.append(pos)
        new_count.append(np.array([len(c.encode(block.text(p, min(p + SLICE, ends[i])))) for p in pos], np.int32))
        rest.append(np.arange(len(pos)) > 0)
        done = i + 1
    return tuple(np.concatenate([*x, y[done:]]) for x, y in zip((new_at, new_count, rest), (at, count, np.zeros(len(at), bool))))


def cut_block(block: Block, limit: int, overlap: int, c: Counter, exact: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row: its number in the batch, and start, end, tokens and overlapping tokens of its pieces, in characters of the row."""
    at, count = c.words(block)
    cum = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    word = np.searchsorted(at, block.starts)
    total = cum[word[1:]] - cum[word[:-1]]  # of whole words: slices count for more
    long = np.flatnonzero(total > limit)
    at, count, rest = _slices(block, at, count, c, total > limit)
    cum = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
    word = np.searchsorted(at, block.starts)
    natural: dict[int, np.ndarray] = {}
    if len(long):
        size = block.starts[long + 1] - block.starts[long]
        sub = Block(np.concatenate([block.cp[block.starts[r] : block.starts[r + 1]] for r in long]), np.concatenate(([0], np.cumsum(size))), 0)
        rows, starts, _ = bounds(sub)
        for i, r in enumerate(long):
            natural[r] = starts[np.searchsorted(rows, i) : np.searchsorted(rows, i, "right")] - sub.starts[i]
    clause = _clauses()[np.minimum(block.cp[np.maximum(at - 1, 0)], len(_clauses()) - 1)]
    cost = np.where(rest, WITHIN, np.where(clause, CLAUSE, WORD))
    texts: dict[int, _Text] = {}
    for r, bound in natural.items():
        part, base = slice(word[r], word[r + 1]), block.starts[r]
        texts[r] = _Text(block.cp[base : block.starts[r + 1]], at[part] - base, cum[word[r] : word[r + 1] + 1] - cum[word[r]], rest[part], cost[part], bound, limit, overlap)
    tasks = {r: t.task(limit, exact) for r, t in texts.items()}
    usual = [t for t in tasks.values() if t.size <= MANY]
    for group in [usual, *([t] for t in tasks.values() if t.size > MANY)]:
        solve(group, limit)
    for r in range(block.rows):
        if r in texts:
            yield block.first_row + r, *texts[r].cut(tasks[r], c)
        else:
            yield block.first_row + r, np.array([0]), block.starts[r + 1 : r + 2] - block.starts[r], total[r : r + 1], np.array([0])


@cache
def _clauses() -> np.ndarray:
    table = np.zeros(0x10000, bool)
    table[[ord(x) for x in ",;:)，；：、،\n"]] = True
    return table


class _Text:
    """One text that is too long. w: its words' starts, cum: tokens before them, natural: where its sentences begin."""

    def __init__(self, cp, w, cum, rest, cost, natural, limit, overlap):
        self.cp, self.w, self.cum, self.rest, self.cost, self.limit, self.overlap = cp, w, cum, rest, cost.copy(), limit, overlap
        where = np.searchsorted(w, natural, "right") - 1
        good = (where > 0) & ((w[where] == natural) | (w[where] == natural - 1))
        where, natural = where[good], natural[good]
        gap = (cp[np.maximum(natural - 1, 0)] == 10) & (cp[np.maximum(natural - 2, 0)] == 10)
        self.cost[where] = np.where(gap, PARAGRAPH, SENTENCE)
        at = where
        # every word between, where natural boundaries are too far apart
        far = np.flatnonzero(np.diff(np.concatenate(([0], cum[at], [cum[-1]]))) > (limit - overlap) // GAP)
        if len(far):
            edges = np.concatenate(([0], at, [len(w)]))
            at = np.union1d(at, np.concatenate([np.arange(edges[i] + 1, edges[i + 1]) for i in far]).astype(np.intp))
        self.at = at

    def task(self, limit: int, every_word: bool = False) -> Task:
        at = np.arange(1, len(self.w)) if every_word else self.at
        return Task(at, self.cum, self.cost[at], limit, self.overlap)

    def cut(self, task: Task, c: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, tokens and overlapping tokens of the pieces."""
        room = self.limit
        while True:
            found = task.pieces()
            if not found:
                solve([task := self.task(room, True)], room)
                found = task.pieces()
            first, last = (np.array(x) for x in zip(*found))
            begin, stop = self.w[first], np.append(self.w, len(self.cp))[last]
            tokens = self.cum[last] - self.cum[first]
            if self.rest.any():  # slices of a word may join or split otherwise in a piece: count each piece as it stands
                tokens = np.array([len(c.encode(self.cp[a:b].tobytes().decode("utf-32-le"))) for a, b in zip(begin, stop)])
                if tokens.max() > self.limit and room > self.limit // 2:
                    room -= int(tokens.max()) - self.limit
                    solve([task := self.task(room)], room)
                    continue
            return begin, stop, tokens, np.concatenate(([0], self.cum[last[:-1]] - self.cum[first[1:]]))


def cut_texts(df: DataFrame, text: str = "text", limit: int = 512, overlap: int = 48, with_text: bool = False, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS, prefix: str = "", exact: bool = False) -> DataFrame:
    """One row per piece: df's other columns, then piece_no (from 1), n_pieces, start_char, end_char, n_tokens, overlap_tokens.

    Each piece has at most `limit` tokens and, but for the first, begins with the last `overlap` tokens
    of the one before (a few more where a word would be cut). Cuts come before paragraphs and sentences
    where there are any, else between words, and within a word only if it is longer than a piece. Among
    all choices of such boundaries the sum of cut costs and squared size differences is least. Words are boundaries
    where sentences are more than a quarter of a piece apart; with exact, all are (four times the work: on 1,490 long
    texts of the test tables one choice changed, and the sum by 0.001 %). A text within the limit is
    one piece; an empty or null one is a piece of 0 tokens. Repeated rows are cut each. Texts of any
    length are taken whole. with_text adds piece_text.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must lie between 0 and half the limit")
    names = [prefix + x for x in ("piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens", *["piece_text"] * with_text)]
    others = [x for x in df.columns if x != text]
    if clash := set(names) & set(others):
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    kept = df.select(*[F.col(f"`{x}`") for x in others])
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{x}` int" for x in names[:6]), *(f"`{x}` string" for x in names[6:])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, folder)
        for batch in batches:
            row, cols, texts = [], [[] for _ in range(6)], []
            for block in blocks(batch.column(len(others))):
                for r, begin, stop, tokens, shared in cut_block(block, limit, overlap, c, exact):
                    k = len(begin)
                    row.append(np.full(k, r))
                    for col, x in zip(cols, (np.arange(1, k + 1), np.full(k, k), begin, stop, tokens, shared)):
                        col.append(x)
                    if with_text:
                        base = block.starts[r - block.first_row]
                        texts += [block.text(base + a, base + b) for a, b in zip(begin, stop)]
            take = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
            made = [pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)) for x in cols]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(others))), *made, *([pa.array(texts, pa.string())] if with_text else [])], [*others, *names])

    return df.select(*[F.col(f"`{x}`") for x in others], F.col(f"`{text}`").cast("string")).mapInArrow(cut, spec)
