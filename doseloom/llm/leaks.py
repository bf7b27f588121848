"""Passages of held-out texts inside a corpus.

The held-out texts' word windows, as hashes, go to every worker; each text of the corpus is scanned
window by window, and what is hit is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_type
from .codepoints import DIGIT, MARK, UPPER, Block, blocks, class_table, fold_table

#: Words (characters in scripts without spaces) in a window.
WINDOW = 5
#: A passage must hold this share of the item; one word in so many may differ.
SHARE, ONE_IN = 0.5, 8
#: Characters of held-out texts that go to the workers at once; a larger set is taken in several scans.
SET_CHARS = 20_000_000
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


@dataclass
class Words:
    """Words of a block's rows: hash, start and end in the block; where each row's words start."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray


def cjk(cp: np.ndarray) -> np.ndarray:
    """Whether each is a kana or an ideograph."""
    return ((cp >= 0x3040) & (cp < 0x3100)) | ((cp >= 0x3400) & (cp < 0xA000)) | ((cp >= 0xF900) & (cp < 0xFB00)) | (cp >= 0x20000)


def words(block: Block, by_char: bool) -> Words:
    """Normalised words (runs of letters and digits without case and accents), or each letter or digit for itself."""
    cp = block.clipped()
    kind, fold = class_table()[cp], fold_table()[cp]
    solid = (((kind >= UPPER) & (kind <= DIGIT)) | (kind == MARK)) & (fold != 0)
    at = np.flatnonzero(solid)
    row_of = None
    if by_char:
        start, end, h = at, at + 1, fold[at].astype(np.uint64)
    else:
        if not len(at):
            return Words(np.zeros(0, np.uint64), at, at, np.zeros(block.rows + 1, np.int64))
        # accents that stand alone lie within a word
        mute = (kind == MARK) & (fold == 0)
        gap = np.concatenate(([0], np.cumsum(~solid & ~mute, dtype=np.int64)))
        first = np.ones(len(at), bool)
        first[1:] = gap[at[1:]] != gap[at[:-1]]
        row_of = np.searchsorted(block.starts, at, "right")
        first[1:] |= row_of[1:] != row_of[:-1]
        head = np.flatnonzero(first)
        within = np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))
        powers = np.cumprod(np.full(int(within.max()) + 1, _A[0], np.uint64))
        h = np.add.reduceat(fold[at].astype(np.uint64) * powers[within], head)
        start, end = at[head], at[np.append(head[1:], len(at)) - 1] + 1
    h = (h ^ (h >> np.uint64(31))) * _A[1]
    return Words(h ^ (h >> np.uint64(29)), start, end, np.searchsorted(start, block.starts))


def windows(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of the window that begins at each word (those that run over an end must be left out by the caller)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * _A[i]
    return out ^ (out >> np.uint64(32))


def least_windows(words: int, size: int = WINDOW) -> int:
    """Windows that every passage of an item of so many words keeps, whatever its length: an edit breaks `size` of them."""
    spans = range(max(1, int(-(-words * SHARE // 1))), words + 1)
    return max(1, min((n - size + 1 - size * (n // ONE_IN) for n in spans), default=1))


@dataclass
class Held:
    """A block of held-out texts, as the workers need it; one for words, one for characters."""

    ids: list
    by_char: bool
    size: int
    words: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray = None
    at: np.ndarray = None
    item: np.ndarray = None
    pos: np.ndarray = None
    least: list[int] = field(default_factory=list)

    def build(self) -> Held:
        self.least = [least_windows(len(h), self.size) for h in self.words]
        all_keys, items, poss = [], [], []
        for i, h in enumerate(self.words):
            w = windows(h, self.size)
            all_keys.append(w)
            items.append(np.full(len(w), i))
            poss.append(np.arange(len(w)))
        keys = np.concatenate(all_keys) if all_keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.at = np.append(first, len(keys))
        self.item, self.pos = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (items, poss))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.intp)] = True
        return self


def held_out(table: pa.Table, size: int = WINDOW) -> tuple[Held, ...]:
    """The held-out texts with spaces between words, and those without, by the size of their windows: texts shorter than a
    window are one as a whole. Columns: id, text. Texts without any word are in none."""
    out: dict[tuple[bool, int], Held] = {}
    ids = table.column(0).to_pylist()
    for block in blocks(table.column(1)):
        dense = cjk(block.cp)
        plain, chars = words(block, False), words(block, True)
        for r in range(block.rows):
            own = dense[block.starts[r] : block.starts[r + 1]]
            by_char = bool(own.sum() * 4 > len(own))
            w = chars if by_char else plain
            h = w.hash[w.row_at[r] : w.row_at[r + 1]]
            if not len(h):
                continue
            held = out.setdefault((by_char, min(size, len(h))), Held([], by_char, min(size, len(h))))
            held.ids.append(ids[block.first_row + r])
            held.words.append(h)
    return tuple(out[k].build() for k in sorted(out))


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits (change, insert, delete) between two short runs of words, or a number over `most` if there are more than that."""
    if abs(len(a) - len(b)) > most or not len(a) or not len(b):
        return max(len(a), len(b))
    before = list(range(len(b) + 1))
    bb = b.tolist()
    for i, x in enumerate(a.tolist(), 1):
        now = [i]
        for j, y in enumerate(bb, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
        if min(now) > most:
            return most + 1
        before = now
    return before[-1]


def reach(item: list[int], text: list[int], most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """How many words of an item, and of a text beside it, are passed with 0, 1, ... `most` edits; and those up to an equal word.

    Furthest place on each diagonal for each number of edits, so unlike texts cost little.
    """
    m, n = len(item), len(text)
    furthest, equal = [], []
    end, before = (0, 0), {}
    far = (0, 0)
    for e in range(most + 1):
        now = {}
        for k in range(-e, e + 1):
            i = max(before.get(k, -2) + 1, before.get(k + 1, -2) + 1, before.get(k - 1, -1)) if e else 0
            i = min(i, m, n - k)
            if i < 0 or i + k < 0:
                continue
            first = i
            while i < m and i + k < n and item[i] == text[i + k]:
                i += 1
            now[k] = i
            if i > far[0]:
                far = i, i + k
            if i > first and i > end[0]:
                end = i, i + k
        furthest.append(far)
        equal.append(end)
        before = now
    return furthest, equal


def passage(item: np.ndarray, text: np.ndarray, runs: list[tuple[int, int, int]], share: float = SHARE, one_in: int = ONE_IN, size: int = WINDOW) -> tuple[int, int, int, int] | None:
    """Longest passage of an item in a text: first and last word in the text, words of the item, edits; none below the share.

    runs: (place in the text, place in the item, words) of all equal runs of `size` words or more. They are chained; what
    lies between and beyond them is compared word by word. A passage begins and ends with equal words if one of these is
    long enough.
    """
    runs = sorted(set(runs))
    need, most = -(-len(item) * share // 1), len(item) // one_in
    spare = []
    for s, q, cost in _chains(item, text, runs, most):
        span = runs[q][1] + runs[q][2] - runs[s][1]
        # beyond the outermost runs every edit adds `size` words at most, as no equal run of that length is left
        more = most - cost
        if one_in > size:
            more = min(more, (span + 2 * (size - 1) - one_in * cost) // (one_in - size))
        if more >= 0 and span + 2 * (size - 1) + size * more >= need:
            spare.append((s, q, cost, more))
    ahead, behind = {}, {}
    for s, q, _, more in spare:
        ahead[s], behind[q] = max(more, ahead.get(s, 0)), max(more, behind.get(q, 0))
    for s, edits in ahead.items():
        t, i, _ = runs[s]
        ahead[s] = reach(item[:i][::-1].tolist(), text[max(0, t - i - edits) : t][::-1].tolist(), edits)
    for q, edits in behind.items():
        t, i = runs[q][0] + runs[q][2], runs[q][1] + runs[q][2]
        behind[q] = reach(item[i:].tolist(), text[t : t + len(item) - i + edits].tolist(), edits)
    best = None
    for equal in (1, 0):
        for s, q, cost, more in spare:
            (begin_t, begin_i, _), (t, i, k) = runs[s], runs[q]
            for a in range(more + 1):
                i1, t1 = ahead[s][equal][a]
                for b in range(more - a + 1):
                    i2, t2 = behind[q][equal][b]
                    wide, edits = i + k - begin_i + i1 + i2, cost + a + b
                    if edits * one_in <= wide and wide >= need and (best is None or (wide, -edits) > (best[2], -best[3])):
                        best = begin_t - t1, t + k + t2, wide, edits
        if best:
            break
    return best


def _chains(item: np.ndarray, text: np.ndarray, runs: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """First and last run and edits of each chain of runs with no more than `most` edits."""
    out = []
    n = len(runs)
    for s in range(n):
        cost = {s: 0}
        for q in range(s, n):
            t, i, k = runs[q]
            if q > s:
                least = None
                for p in range(s, q):
                    if p not in cost:
                        continue
                    pt, pi, pk = runs[p]
                    # runs may overlap after a repeat: the later one is shortened
                    cut = max(0, pt + pk - t, pi + pk - i)
                    if cut >= k or t + cut - (pt + pk) > len(item) or i + cut - (pi + pk) < 0:
                        continue
                    gap = distance(item[pi + pk : i + cut], text[pt + pk : t + cut], most - cost[p])
                    if cost[p] + gap <= most and (least is None or cost[p] + gap < least):
                        least = cost[p] + gap
                if least is None:
                    continue
                cost[q] = least
            out.append((s, q, cost[q]))
    return out


def scan(column: pa.Array, sets: tuple[Held, ...]) -> Iterator[tuple[int, int, int, int, int, int, Held]]:
    """Row, item, first and last character (exclusive), words of the item and edits of each passage found in a column."""
    for block in blocks(column):
        for held in sets:
            if not len(held.keys):
                continue
            own = block
            if held.by_char:
                dense = np.concatenate(([0], np.cumsum(cjk(block.cp))))
                rows = np.flatnonzero(dense[block.starts[1:]] > dense[block.starts[:-1]])
                if not len(rows):
                    continue
                size = np.diff(block.starts)[rows]
                own = Block(np.concatenate([block.cp[block.starts[r] : block.starts[r + 1]] for r in rows]), np.concatenate(([0], np.cumsum(size))), 0)
            else:
                rows = np.arange(block.rows)
            w = words(own, held.by_char)
            keys = windows(w.hash, held.size)
            hit = np.flatnonzero(held.table[(keys >> np.uint64(44)).astype(np.intp)])
            if not len(hit):
                continue
            key = np.minimum(np.searchsorted(held.keys, keys[hit]), len(held.keys) - 1)
            same = held.keys[key] == keys[hit]
            hit, key = hit[same], key[same]
            row = np.searchsorted(w.row_at, hit, "right") - 1
            whole = hit + held.size <= w.row_at[row + 1]
            hit, key, row = hit[whole], key[whole], row[whole]
            many = held.at[key + 1] - held.at[key]
            where = np.repeat(held.at[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hit, row = np.repeat(hit, many), np.repeat(row, many)
            item, pos = held.item[where], held.pos[where]
            # equal runs: hits of one row and item on one diagonal, one after the other
            order = np.lexsort((hit, hit - pos, item, row))
            hit, row, item, pos = hit[order], row[order], item[order], pos[order]
            if not len(hit):
                continue
            new = np.ones(len(hit), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (hit[1:] - pos[1:] != hit[:-1] - pos[:-1]) | (hit[1:] != hit[:-1] + 1)
            head = np.flatnonzero(new)
            length = np.diff(head, append=len(hit)) + held.size - 1
            hit, row, item, pos = hit[head], row[head], item[head], pos[head]
            pair = np.ones(len(head), bool)
            pair[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
            at = np.flatnonzero(pair)
            ends = np.append(at[1:], len(head))
            got = np.add.reduceat(length - held.size + 1, at)
            for a, b, windows_hit in zip(at, ends, got):
                h = held.words[item[a]]
                if windows_hit < held.least[item[a]]:
                    continue
                base = w.row_at[row[a]]
                text = w.hash[base : w.row_at[row[a] + 1]]
                found = passage(h, text, [(int(t - base), int(p), int(k)) for t, p, k in zip(hit[a:b], pos[a:b], length[a:b])], size=held.size)
                if found:
                    first, last, span, edits = found
                    r = rows[row[a]]
                    shift = own.starts[row[a]]
                    yield block.first_row + int(r), held.ids[item[a]], int(w.start[base + first] - shift), int(w.end[base + last - 1] - shift), span, edits, held


def _sets(spark, items: DataFrame, item_id: str, item_text: str, size: int) -> Iterator[object]:
    """Broadcast blocks of the held-out texts, each of bounded size."""
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("id is not null").dropDuplicates()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // SET_CHARS)
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else rows
        yield spark.sparkContext.broadcast(held_out(some.toArrow(), size))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per item and document whose text holds the whole item, or half of it or more, as one passage.

    Columns: item_id, doc_id, start_char, end_char, item_words (length of the longest passage), edits.
    Words (in ja and zh characters) are compared without case, accents, punctuation and white space; one
    in eight may differ, at the ends of the passage too. Items shorter than a window of five words are found where they stand whole; null texts and ids
    give no rows, nor do items without any word (see unsearchable) or a passage without five equal words in a row (only one under ten words can be so). Repeated documents and items give a pair once. Every window of every text is looked at. Held-out
    sets of more than SET_CHARS characters are taken in blocks, one scan of the corpus each.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    kinds = dict(items.dtypes)[item_id], dict(named.dtypes)["doc_id"]
    schema = f"item_id {kinds[0]}, doc_id {kinds[1]}, start_char int, end_char int, item_words int, edits int"
    out = None
    for held in _sets(spark, items, item_id, item_text, size):

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(scan(batch.column(1), held.value))
                take = pa.array([x[0] for x in found], pa.int64())
                ids = pa.array([x[1] for x in found], item_type)
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).take(take), *(pa.array([x[i] for x in found], pa.int32()) for i in (2, 3, 4, 5))], ["item_id", "doc_id", "start_char", "end_char", "item_words", "edits"])

        item_type = arrow_type(items.schema[item_id].dataType)
        part = named.mapInArrow(find, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.max_by(F.struct("start_char", "end_char", "item_words", "edits"), F.struct("item_words", -F.col("edits"), -F.col("start_char")))
    return out.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.*")


def unsearchable(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id and reason ('null id', 'null text', 'no word') of the held-out texts that can't be searched for."""
    i, t = F.col(f"`{item_id}`"), F.col(f"`{item_text}`").cast("string")
    reason = F.when(i.isNull(), "null id").when(t.isNull(), "null text").when(~t.rlike(r"[\p{L}\p{N}]"), "no word")
    return items.select(i.alias("item_id"), reason.alias("reason")).where("reason is not null").distinct()


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", how: str = "spans", size: int = WINDOW) -> DataFrame:
    """docs without leaked passages: how='spans' cuts them out of the text (one blank each), 'documents' drops every text that holds one.

    All columns stay, the text last. Null texts stay null and are kept; repeated rows are treated alike.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how must be spans or documents")
    others = [c for c in docs.columns if c != text]
    df = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string"))
    for held in _sets(docs.sparkSession, items, item_id, item_text, size):

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(len(others)).to_pylist()
                spans: dict[int, list[tuple[int, int]]] = {}
                for row, _, a, b, *_ in scan(batch.column(len(others)), held.value):
                    spans.setdefault(row, []).append((a, b))
                if how == "documents":
                    keep = pa.array([i for i in range(len(texts)) if i not in spans], pa.int64())
                    yield batch.take(keep)
                    continue
                for row, found in spans.items():
                    parts, at = [], 0
                    for a, b in sorted(found):
                        if a >= at:
                            parts.append(texts[row][at:a])
                        at = max(at, b)
                    texts[row] = " ".join([*parts, texts[row][at:]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)

        df = df.mapInArrow(clean, df.schema)
    return df
