"""Sentence boundaries in any language, by a finite transducer over the marks of a text.

Marks (ends of sentences, quotes, brackets, blank lines, list items, spaces between Thai letters)
are turned into symbols that already hold what stands around them: abbreviations, numbers, the kind
of the next character. The transducer keeps the open quote, the depth of brackets and whether it is
in a list item, and puts out the boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, no_clash, quoted, spec
from ..functions.lineage import cut_lineage
from .codepoints import DIGIT, EDGE, LOWER, MARK, OTHER, SPACE, UNCASED, UPPER, Block, blocks, class_table, lower_table
from .transducer import Transducer

#: Abbreviations that never end a sentence (without their last dot, lower case).
NEVER_LAST = """
    dr mr mrs ms prof st fig figs no nos nr est ev vs cf approx aprox ca env rev re wk sec sect abschn bzw vgl apdo
    pág pag núm sra sr dra vol ed eds ch pp e.g i.e viz al max máx resp incl bzgl inkl ggf evtl usw.z z d u p т c n
    ej см разд рис стр тел г-н д-р им ред डॉ श्री मि.ग्रा ग्रा मि มก มล ดร นพ พญ
""".split()
#: Abbreviations that end a sentence if a new one seems to begin after them.
MAY_BE_LAST = """
    etc inc corp ltd co min h hr hrs std usw a.m p.m u.s jr sr bd ч мин г др пр т.д т.п т.е е п j b a m
""".split()
#: Words before a number with a dot that make it an ordinal.
ORDINAL_AFTER = "am vom zum im dem den der des ab bis beim".split()

DOTS, ELLIPSES = ".．", "…"
HARD, WIDE, DANDA = "!?‼⁇⁈⁉؟۔", "。！？｡", "।॥"
OPENERS = "“„«「『(（[【¿¡‘‚‹\"'"
BULLETS = "-*•–·▪‣◦●○■□"
#: Characters before a dot that are compared with the abbreviations.
LOOK = 12

# symbols
(NOTHING, TERM, QUOTE, QUOTE_END, CURLY, CURLY_END, CURLY_CLOSE, CURLY_CLOSE_END, LOW, ANGLE, ANGLE_CLOSE, ANGLE_CLOSE_END, CORNER, CORNER_CLOSE, CORNER_CLOSE_END, PAREN, PAREN_CLOSE, PAREN_CLOSE_END, BREAK, ITEM, START, START_ITEM, NEXT_ITEM) = range(23)
_QUOTES, _DEPTHS = 6, 3


@cache
def transducer() -> Transducer:
    """States: list item or not x open quote (none, straight, curly, low, angle, corner) x depth of brackets up to 2."""
    states = 2 * _QUOTES * _DEPTHS
    step, out = np.zeros((23, states), np.uint8), np.zeros((23, states), bool)
    toggles = {QUOTE: {0: 1, 1: 0}, CURLY: {0: 2, 3: 0}, CURLY_CLOSE: {2: 0, 3: 0}, LOW: {0: 3}, ANGLE: {0: 4}, ANGLE_CLOSE: {4: 0}, CORNER: {0: 5}, CORNER_CLOSE: {5: 0}}
    ends = {QUOTE_END: QUOTE, CURLY_END: CURLY, CURLY_CLOSE_END: CURLY_CLOSE, ANGLE_CLOSE_END: ANGLE_CLOSE, CORNER_CLOSE_END: CORNER_CLOSE, PAREN_CLOSE_END: PAREN_CLOSE}
    for state in range(states):
        item, rest = divmod(state, _QUOTES * _DEPTHS)
        quote, depth = divmod(rest, _DEPTHS)
        for symbol in range(23):
            q, d, i = quote, depth, item
            base = ends.get(symbol, symbol)
            if base == NEXT_ITEM:  # a mark after a line that does not end is one within a list only
                base = ITEM if item else NOTHING
            if base in toggles:
                q = toggles[base].get(quote, quote)
            elif base == PAREN:
                d = min(depth + 1, _DEPTHS - 1)
            elif base == PAREN_CLOSE:
                d = max(depth - 1, 0)
            elif base in (BREAK, ITEM, START, START_ITEM):
                q, d, i = 0, 0, int(base in (ITEM, START_ITEM))
            step[symbol, state] = (i * _QUOTES + q) * _DEPTHS + d
            plain = q == 0 and d == 0 and not i
            closed = (quote, depth) != (0, 0)
            out[symbol, state] = base in (BREAK, ITEM, START, START_ITEM) or (symbol == TERM and plain) or (symbol in ends and plain and closed)
    return Transducer(step, out)


def _hash_of(words: list[str]) -> np.ndarray:
    padded = np.zeros((len(words), LOOK), np.uint32)
    for i, w in enumerate(words):
        for j, c in enumerate(reversed(w[-LOOK:])):
            padded[i, j] = ord(c)
    return np.sort(_hash_rows(padded))


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(rows.shape[1], 0x9E3779B97F4A7C15, np.uint64))
    return (rows.astype(np.uint64) * powers).sum(1)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


@cache
def _sets() -> tuple[np.ndarray, ...]:
    return _hash_of(NEVER_LAST), _hash_of(MAY_BE_LAST), _hash_of(ORDINAL_AFTER)


@cache
def _marks() -> np.ndarray:
    """Code of each mark in the Basic Multilingual Plane: 1 dot, 2 ellipsis, 3 hard, 4 wide, 5 danda, 6 straight quote, 7 curly, 8 its close, 9 low, 10 angle, 11 its close, 12 corner, 13 its close, 14 bracket, 15 its close."""
    table = np.zeros(0x32000, np.uint8)
    for code, chars in enumerate((DOTS, ELLIPSES, HARD, WIDE, DANDA, '"＂', "“", "”", "„", "«", "»", "「『", "」』", "(（[【", ")）]】"), 1):
        for c in chars:
            table[ord(c)] = code
    return table


@cache
def _is(chars: str) -> np.ndarray:
    table = np.zeros(0x32000, bool)
    table[[ord(c) for c in chars]] = True
    return table


def lower_words(cp: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word that begins with a small letter."""
    letter = (kind == UPPER) | (kind == LOWER) | (kind == UNCASED) | (kind == MARK)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    heads = starts[:-1][np.diff(starts) > 0]
    begins[heads] = letter[heads]
    at = np.flatnonzero(begins)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    inside = np.flatnonzero(letter)
    first = np.searchsorted(inside, at)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(first, append=len(inside)))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    hashed = np.add.reduceat((cp[inside].astype(np.uint64) + np.uint64(7)) * powers[place], first)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    low = kind[at] == LOWER
    return at[low], (hashed ^ (hashed >> np.uint64(32)))[low]


def bounds(block: Block, starters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in the block) of every sentence unit of a block, in order. starters: sorted hashes of words that
    begin a sentence although they are written small (see learn_starters)."""
    cp, starts = block.clipped(), block.starts
    n = len(cp)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = class_table()[cp]
    mark = _marks()[cp]
    space = kind == SPACE
    # next character that is no space, previous one
    at = np.arange(n, dtype=np.int32)
    ahead = np.where(space, n, at)
    ahead = np.concatenate((np.minimum.accumulate(ahead[::-1])[::-1], [n, n])).astype(np.int32)
    behind = np.maximum.accumulate(np.where(space, -1, at))
    row_end = np.zeros(n + 1, bool)
    row_end[starts] = True

    def kind_at(i: np.ndarray, row_stop: np.ndarray) -> np.ndarray:
        return np.where(i < row_stop, kind[np.minimum(i, n - 1)], EDGE)

    known = np.zeros(n + 1, bool)  # where such a word begins
    if starters is not None and len(starters):
        at_word, hashed = lower_words(block.cp, kind, starts)
        known[at_word[_among(hashed, starters)]] = True
    symbol = np.zeros(n, np.uint8)
    # ends of sentences, at the last mark of a run
    term = (mark >= 1) & (mark <= 5)
    last = term.copy()
    last[:-1] &= ~(term[1:] & ~row_end[1:-1])
    p = np.flatnonzero(last)
    if len(p):
        symbol[p[_ends(p, cp, kind, mark, term, ahead, starts, row_end, known)]] = TERM
    # quotes and brackets
    q = np.flatnonzero(mark >= 6)
    if len(q):
        stop = starts[np.searchsorted(starts, q, "right")]
        begin = starts[np.searchsorted(starts, q, "right") - 1]
        base = np.array([0, 0, 0, 0, 0, 0, QUOTE, CURLY, CURLY_CLOSE, LOW, ANGLE, ANGLE_CLOSE, CORNER, CORNER_CLOSE, PAREN, PAREN_CLOSE], np.uint8)[mark[q]]
        before = np.where(q - 1 >= begin, behind[np.maximum(q - 1, 0)], -1)
        two = np.where((before > begin) & (mark[np.maximum(before, 0)] >= 6), before - 1, before)
        after_term = (two >= begin) & term[np.maximum(two, 0)] & (q - before <= 2)
        nxt, direct = ahead[q + 1], q + 1
        spaced = nxt > direct
        k = kind_at(nxt, stop)
        c = cp[np.minimum(nxt, n - 1)]
        opens = _is(OPENERS)[c] & (k == OTHER)
        wide = _is("」』”）】")[cp[q]] & (cp[np.maximum(two, 0)] >= 0x3000)
        fresh = np.where(spaced, (k == UPPER) | (k == DIGIT) | opens | ((k == UNCASED) & ~wide) | (known[np.minimum(nxt, n)] & (nxt < stop)), ((k == UPPER) | (opens & (mark[np.minimum(nxt, n - 1)] != 6))) & ~wide)
        symbol[q] = base + (after_term & fresh & np.isin(base, (QUOTE, CURLY, CURLY_CLOSE, ANGLE_CLOSE, CORNER_CLOSE, PAREN_CLOSE)))
    # white space: blank lines, list items, gaps between Thai letters
    begins = space.copy()
    begins[1:] &= ~space[:-1] | row_end[1:n]
    ws = np.flatnonzero(begins)
    next_start = np.full(n, -1, np.int64)
    if len(ws):
        row = np.searchsorted(starts, ws, "right")
        b = np.minimum(ahead[ws], starts[row])
        inside = (ws > starts[row - 1]) & (b < starts[row])
        ws, b, stop = ws[inside], b[inside], starts[row][inside]
    if len(ws):
        line = (cp == 10) | (cp == 0x2028) | (cp == 11) | (cp == 12)
        lines = np.concatenate(([0], np.cumsum(line + 2 * (cp == 0x2029), dtype=np.int64)))
        count = lines[b] - lines[ws]
        item, content = _item(b, stop, cp, space, ahead)
        item &= count >= 1
        symbol[ws[count >= 2]] = BREAK
        ended = (mark[ws - 1] > 0) | _is(":;")[cp[ws - 1]] | (count >= 2)
        symbol[ws[item]] = np.where(ended, ITEM, NEXT_ITEM)[item]
        next_start[ws[item]] = content[item]
        thai = lambda i: (cp[i] >= 0xE00) & (cp[i] < 0xE80) & ((kind[i] == UNCASED) | (kind[i] == MARK))
        symbol[ws[thai(ws - 1) & thai(b) & (count < 2) & ~item]] = TERM
        gap = ws[thai(ws - 1) & thai(b) & (count < 2) & ~item]
    else:
        gap = np.zeros(0, np.int64)
    # the stream: row starts and marks in order
    events = np.flatnonzero(symbol)
    full = np.flatnonzero(np.diff(starts) > 0)
    heads = starts[full]
    first = np.minimum(ahead[heads], starts[full + 1])
    head_item, head_content = _item(first, starts[full + 1], cp, space, ahead)
    keys = np.concatenate((heads * 2, events * 2 + 1))
    order = np.argsort(keys, kind="stable")
    stream = np.concatenate((np.where(head_item, START_ITEM, START), symbol[events]))[order]
    left = np.concatenate((heads, np.where(np.isin(symbol[events], (BREAK, ITEM, NEXT_ITEM)), events, events + 1)))[order]
    resume = np.concatenate((np.where(head_item, head_content, heads), np.where(next_start[events] >= 0, next_start[events], np.where(symbol[events] == BREAK, events, events + 1))))[order]
    del gap
    put = transducer().run(stream)
    start, stop = resume[put], np.concatenate((left[put][1:], [n]))
    # trim
    start = np.minimum(ahead[start], n)
    end = np.where(stop > 0, behind[np.maximum(stop - 1, 0)] + 1, 0)
    kept = start < end
    start, end = start[kept].astype(np.int64), end[kept].astype(np.int64)
    return block.row_of(start), start, end


def _item(b: np.ndarray, stop: np.ndarray, cp: np.ndarray, space: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a list marker stands at b, and where its content begins."""
    n = len(cp)
    inner = np.minimum(b, n - 1)
    after = np.minimum(b + 1, n - 1)
    is_item = _is(BULLETS)[cp[inner]] & (b + 1 < stop) & space[after]
    return is_item, np.minimum(ahead[np.minimum(b + 1, n)], stop)


def _ends(p, cp, kind, mark, term, ahead, starts, row_end, known) -> np.ndarray:
    """Which of the marks at p may end a sentence, seen from what stands around them."""
    n = len(cp)
    row = np.searchsorted(starts, p, "right")
    begin, stop = starts[row - 1], starts[row]
    code = mark[p]
    direct, nxt = p + 1, ahead[p + 1]
    spaced = nxt > direct
    inside = nxt < stop
    safe = np.minimum(nxt, n - 1)
    k, c = np.where(inside, kind[safe], EDGE), np.where(inside, cp[safe], 0)
    opens = _is(OPENERS)[np.minimum(c, 0x31FFF)] & (k == OTHER)
    fresh = (k == UPPER) | (k == DIGIT) | (k == UNCASED) | opens
    ellipsis = (code == 2) | ((code == 1) & (p >= begin + 2) & (mark[np.maximum(p - 1, 0)] == 1) & (mark[np.maximum(p - 2, 0)] == 1))
    # the token before a dot
    back = p[:, None] - 1 - np.arange(LOOK)[None, :]
    ok = back >= begin[:, None]
    back = np.maximum(back, 0)
    chars, kinds = lower_table()[cp[back]], kind[back]
    part = ok & ((kinds == UPPER) | (kinds == LOWER) | (kinds == UNCASED) | (kinds == DIGIT) | (kinds == MARK) | (cp[back] == 46))
    part = np.logical_and.accumulate(part, 1)
    size = part.sum(1)
    never, maybe, ordinal = _sets()
    hashed = _hash_rows(np.where(part, chars, 0))
    turns = (part & (chars == 46)).any(1) & letters_or_dots(kinds, chars, part) & (size <= 8)
    # what stands after its last inner dot
    part = np.logical_and.accumulate(part & (chars != 46), 1)
    size = part.sum(1)
    plain = _hash_rows(np.where(part, chars, 0))
    letters = (part & (kinds != DIGIT)).sum(1) == size
    digits = ((part & (kinds == DIGIT)).sum(1) == size) & (size > 0)
    is_never = (code == 1) & (_among(hashed, never) | (_among(plain, never) & ~turns))
    capital = (code == 1) & (size == 1) & (kinds[:, 0] == UPPER) & ~turns
    may = (code == 1) & (_among(plain, maybe) | turns | ((size == 1) & (kinds[:, 0] == LOWER)))
    # ordinals: a number after one of a few words, before a capital
    near = np.flatnonzero((code == 1) & digits & (size <= 3) & spaced & (k == UPPER))
    is_ordinal = np.zeros(len(p), bool)
    if len(near):
        gap = p[near] - 1 - size[near]
        back = gap[:, None] - 1 - np.arange(LOOK)[None, :]
        good = (back >= begin[near][:, None]) & (gap >= begin[near])[:, None]
        back = np.maximum(back, 0)
        word = np.logical_and.accumulate(good & ((kind[back] == UPPER) | (kind[back] == LOWER)), 1)
        is_ordinal[near] = _among(_hash_rows(np.where(word, lower_table()[cp[back]], 0)), ordinal) & (kind[np.maximum(gap, 0)] == SPACE)
    prev = kind[np.maximum(p - 1, 0)]
    # a lower-case word of six letters or more after the mark, without a space between
    run = np.zeros(len(p), bool)
    low = np.flatnonzero(~spaced & (k == LOWER))
    if len(low):
        fore = p[low][:, None] + 1 + np.arange(6)[None, :]
        run[low] = ((fore < stop[low][:, None]) & (kind[np.minimum(fore, n - 1)] == LOWER)).all(1)
    dot_direct = np.select(
        [k == UPPER, k == DIGIT, k == UNCASED, k == LOWER],
        [(prev == LOWER) | (prev == DIGIT) | (prev == OTHER) | (prev == MARK) | may, letters & (size >= 1) & ~capital & ((size >= 3) | may), (prev == UNCASED) | (prev == MARK), run & letters & (size >= 4)],
        opens,
    )
    # a number with a dot right before digits or letters of its own is no end; nor one followed by closing marks
    single = np.flatnonzero((code == 1) & turns & ~spaced & (k == UPPER))
    if len(single):  # U.S.A: a capital that has its own dot
        after = np.minimum(p[single] + 2, n - 1)
        dot_direct[single] &= cp[after] != 46
    hard_direct = (k == UPPER) | (k == DIGIT) | (k == UNCASED) | opens | run
    closing = (k == OTHER) & ~opens
    dot_spaced = np.where(may, (k == UPPER) | (k == DIGIT) | opens | (known[np.minimum(nxt, n)] & inside), ~(closing & ~_is("№#*")[np.minimum(c, 0x31FFF)] & (c != ord("<")))) & ~is_ordinal
    dot = np.where(spaced, dot_spaced, dot_direct) & ~is_never & ~capital
    dot = np.where(ellipsis, np.where(spaced, fresh, (k == UPPER) | opens), dot)
    hard = np.where(spaced, ~closing | _is("№#")[np.minimum(c, 0x31FFF)], hard_direct)
    wide = ~(closing & (mark[safe] >= 6)) & ~(np.isin(mark[safe], (8, 11, 13, 15)) & inside)
    return np.select([(code == 1) | (code == 2), code == 3, code == 4], [dot, hard, wide], ~(np.isin(mark[safe], (6, 8, 11, 13, 15)) & inside & ~spaced)) & inside


def letters_or_dots(kinds: np.ndarray, chars: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether letters and dots take turns in the token, as in t.i.d."""
    turns = np.arange(kinds.shape[1])[None, :] % 2 == 1
    dots = chars == 46
    return (~part | (dots == turns)).all(1)


def counted_starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of a column that begins with a small letter, how often it begins a sentence after an end that leaves no
    doubt (a mark of its own, then a space), and how often it occurs."""
    words, begins = [], []
    for block in blocks(column):
        cp, kind = block.clipped(), class_table()[block.clipped()]
        at, hashed = lower_words(block.cp, kind, block.starts)
        if not len(at):
            continue
        row, start, end = bounds(block)
        same = row[1:] == row[:-1]
        sure = np.isin(_marks()[cp[np.maximum(end[:-1] - 1, 0)]], (1, 3)) & (cp[np.maximum(start[1:] - 1, 0)] == 32) & same
        words.append(hashed)
        begins.append(np.isin(at, start[1:][sure]))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    unique, back = np.unique(np.concatenate(words), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(begins), len(unique)).astype(np.int64), np.bincount(back, minlength=len(unique))


def learn_starters(*texts: DataFrame, least: int = 3, share: float = 0.001, rarest: float = 1e-7) -> np.ndarray:
    """Sorted hashes of the words that begin sentences although they are written small (names of substances), counted over all
    rows of one-column tables of texts.

    A word is one if at least `least` sentences and `share` of its occurrences begin with it, after ends that leave no doubt,
    and these make at least `rarest` of all words; so there are at most 1 / rarest of them, 8 bytes each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, starts, every = counted_starts(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(starts), pa.array(every.astype(np.int64))], ["word", "starts", "every"])

    parts = [t.select(F.col(quoted(t.columns[0])).cast("string").alias("t")).mapInArrow(count, "word bigint, starts bigint, every bigint") for t in texts]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    counts = cut_lineage(both.groupBy("word").agg(F.sum("starts").alias("starts"), F.sum("every").alias("every")))
    total = counts.agg(F.sum("every")).first()[0] or 0
    found = counts.where((F.col("starts") >= max(least, rarest * total)) & (F.col("starts") >= share * F.col("every"))).select("word").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def spans(column: pa.Array, starters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence of a column: its row, number within the row from 1, start and end character."""
    parts = []
    for block in blocks(column):
        row, start, end = bounds(block, starters)
        if len(row):
            new = np.concatenate(([True], row[1:] != row[:-1]))
            number = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) + 1
            base = block.starts[row]
            parts.append((row + block.first_row, number, start - base, end - base))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def sentence_arrays(df: DataFrame, text: str = "text", starters: np.ndarray | None = None) -> DataFrame:
    """df with the text replaced by the starts and ends of its sentences (two arrays of int), one row per row."""
    no_clash(df, ["starts", "ends"])
    others = [c for c in df.columns if c != text]
    kept = df.select(*columns(others))
    sent = df.sparkSession.sparkContext.broadcast(starters) if starters is not None else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, start, end = spans(batch.column(len(others)), sent.value if sent is not None else None)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*others, "starts", "ends"])

    return df.select(*columns(others), F.col(quoted(text)).cast("string")).mapInArrow(split, spec(kept, "starts array<int>, ends array<int>"))


def split_sentences(df: DataFrame, text: str = "text", keys: list[str] | None = None, prefix: str = "", starters: np.ndarray | None = None) -> DataFrame:
    """One row per sentence: the other columns of df, then sent_no (from 1), start_char and end_char (code points, end exclusive).

    White space and list markers around a unit are left out. Headings, list items and blank lines end
    a unit; quotations and bracketed remarks stay in theirs. Null, empty and blank texts give no rows.
    Texts of any length are taken whole. With keys, rows that agree in them are one record, told apart by
    the places of their sentences only, so that no text is moved; without, repeated rows are split each. If
    df already has one of the three new columns, give a prefix for the new ones, else a ValueError is raised. With starters
    (learn_starters) a word written small that begins sentences elsewhere does so after a closing quote or an abbreviation too.
    """
    names = [prefix + x for x in ("sent_no", "start_char", "end_char")]
    no_clash(df, names)
    others = [c for c in df.columns if c != text]
    found = sentence_arrays(df, text, starters)
    if keys:
        found = found.dropDuplicates(keys)
    rows = found.select(*columns(others), F.posexplode(F.arrays_zip("starts", "ends")).alias("_no", "_at"))
    return rows.select(*columns(others), (F.col("_no") + 1).cast("int").alias(names[0]), F.col("_at.starts").alias(names[1]), F.col("_at.ends").alias(names[2]))
