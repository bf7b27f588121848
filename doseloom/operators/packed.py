"""Several values packed in one field: which delimiters a source uses, and the values one by one.

The delimiters are inferred for each source (a table or field) from all of its fields. Every candidate splits every
field, outside quotes, brackets and numbers, and is scored on two things: how regular its pieces are (first and last
characters of kinds that the source's undelimited fields have, words where those have words, none empty), and how
consistent the number of pieces per field is (always the same, or distributed as with the source's other candidates).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import columns, no_clash, quoted, spec

#: Candidates: name and pattern outside of quotes and brackets.
CANDIDATES = {
    "comma": r",(?!\d)|(?<!\d),",
    "semicolon": r";",
    "bar": r"\|",
    "line": r"[\r\n]+",
    "tab": r"\t",
    "double slash": r"(?<=\s)//(?=\s|$)|^//",
    "spaced slash": r"(?<=\s)/(?=\s|$)",
    "slash": r"(?<![\s/])/(?![\s/])",
    "plus": r"(?<=\s)\+(?=\s|$)",
    "ampersand": r"(?<=\s)&(?=\s|$)",
    "and": r"(?<=\s)and(?=\s)",
}
#: Weight of the regular pieces in the score (the rest is that of the counts' consistency), least score of a delimiter.
SHARE, LEAST = 0.75, 0.7
#: Most share of empty pieces; share from which a kind of first or last character counts as usual.
EMPTY, USUAL = 0.34, 0.02
#: Sources whose delimiters are kept at the driver; with more of them they are joined to the fields.
MAX_SOURCES = 10_000
_QUOTED = r'"(?:[^"]|"")*"'
_BRACKET = r"\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]"
_ALL = re.compile("|".join([f"(?P<q>{_QUOTED})|(?P<b>{_BRACKET})", *(f"(?P<{k.replace(' ', '_')}>{v})" for k, v in CANDIDATES.items())]))
_WORD = re.compile(r"[^\W\d_]{4}")
_BULLET = re.compile(r"\s*[-*•·–▪]\s+")
_NUMBER = re.compile(r"(?:^|(?<=[\s,;|/]))(?:\((\d{1,3})\)|(\d{1,3})[.)])(?=\s)")
#: What may stand right before a quote that opens a value: nothing, a separator, a list mark or number, a joining word.
_OPEN = re.compile(r"(?:^|[,;|/+&\r\n\t]|\band|^\s*[-*•·–▪]|[\r\n]\s*[-*•·–▪]|(?:^|(?<=[\s(]))\(?\d{1,3}[.)])\s*\Z")
_JOINED = re.compile(r"(?:\s*(?:and|&)\s+)+", re.I)


def cuts(text: str, scan: re.Pattern) -> list[tuple[int, int, str]]:
    """Start, end and name of each delimiter in a text."""
    out, at = [], 0
    while m := scan.search(text, at):
        name, at = m.lastgroup, m.end()
        if name == "q":
            if not _OPEN.search(text, max(0, m.start() - 12), m.start()):
                at = m.start() + 1  # a quote within a piece protects nothing
        elif name != "b":
            out.append((m.start(), m.end(), name))
    return out


def pieces(text: str, scan: re.Pattern) -> list[str]:
    out, at = [], 0
    for a, b, _ in cuts(text, scan):
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


def kind(c: str) -> str:
    """Kind of a first or last character."""
    return "a" if c.isalpha() else "0" if c.isdigit() else ")" if c in ")" else "]" if c in "]" else '"' if c in "\"'“”" else "." if c in ".%" else "?"


def shape(piece: str) -> tuple[str, str, bool]:
    """First kind, last kind, whether there is a word of four letters."""
    p = piece.strip()
    if not p:
        return "", "", False
    p = _BULLET.sub("", p, count=1).strip(" \t\r\n,;|/+&") or p
    return kind(p[0]), kind(p[-1]), _WORD.search(p) is not None


def by_candidate(text: str) -> dict[str, list[str]]:
    """The pieces that each candidate cuts a text into; the whole text under '' if none occurs."""
    found: dict[str, list[tuple[int, int]]] = {}
    for a, b, name in cuts(text, _ALL):
        found.setdefault(name.replace("_", " "), []).append((a, b))
    return {k: [text[x:y] for x, y in zip([0, *(b for _, b in v)], [*(a for a, _ in v), len(text)])] for k, v in found.items()} or {"": [text]}


_SEEN = "source string, delimiter string, first string, last string, word boolean, pieces int"


def shapes(df: DataFrame, column: str, source: str) -> DataFrame:
    """Counts, over all fields, by source and candidate ('' for fields without any delimiter): of piece shapes (pieces is 0),
    and of fields by their number of pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                for cand, parts in by_candidate(text.strip()).items():
                    seen[name, cand, "", "", False, len(parts)] += 1
                    for part in parts:
                        seen[name, cand, *shape(part), 0] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([k[4] for k in keys], pa.bool_()), pa.array([k[5] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], [*"source delimiter first last word pieces n".split()])

    named = df.select(F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(column)).cast("string").alias("text"))
    return named.mapInArrow(count, f"{_SEEN}, n bigint").groupBy("source", "delimiter", "first", "last", "word", "pieces").agg(F.sum("n").alias("n"))


def judge(seen: list[tuple[str, str, str, bool, int, int]]) -> list[tuple[str, int, float, float, float, float, bool]]:
    """Of one source's counts (delimiter, first, last, word, pieces, n): delimiter, pieces, regular, empty, consistent, score, taken of each candidate."""
    plain = [x for x in seen if not x[0] and not x[4] and x[1]]
    total = sum(x[5] for x in plain)
    usual = []
    for end in (1, 2):
        kinds: Counter = Counter()
        for x in plain:
            kinds[x[end]] += x[5]
        usual.append({k for k, n in kinds.items() if n >= USUAL * total})
    # whether values hold words is told by the undelimited fields, or without any by all pieces
    told = plain or [x for x in seen if not x[4] and x[1]]
    wordy = 2 * sum(x[5] for x in told if x[3]) >= sum(x[5] for x in told)
    fields: dict[str, Counter] = {}
    for d, _, _, _, pieces, n in seen:
        if d and pieces:
            fields.setdefault(d, Counter())[pieces] += n
    pooled = sum(fields.values(), Counter())
    out = []
    for d in sorted(fields):
        own = [x for x in seen if x[0] == d and not x[4]]
        filled, every = sum(x[5] for x in own if x[1]), sum(x[5] for x in own)
        fit = sum(x[5] for x in own if x[1] and (x[3] or not wordy) and (not plain or (x[1] in usual[0] and x[2] in usual[1])))
        regular, empty = fit / max(1, filled), 1 - filled / max(1, every)
        n = fields[d].total()
        others = pooled - fields[d]
        same = sum((k / n) ** 2 for k in fields[d].values())
        alike = sum(min(k / n, others[p] / others.total()) for p, k in fields[d].items()) if others else 0.0
        consistent = max(same, alike)
        score = SHARE * regular + (1 - SHARE) * consistent
        out.append((d, every, regular, empty, consistent, score, score >= LEAST and empty <= EMPTY))
    return out


def infer_delimiters(df: DataFrame, column: str, source: str) -> DataFrame:
    """One row per source and candidate that occurs in it: pieces, regular (share of pieces), empty (share), consistent
    (of the number of pieces per field), score, taken. Each source is judged from its counts, a few hundred rows."""
    seen = shapes(df, column, source)

    def one(table: pa.Table) -> pa.Table:
        found = judge(list(zip(*(table.column(c).to_pylist() for c in ("delimiter", "first", "last", "word", "pieces", "n")))))
        names = ["delimiter", "pieces", "regular", "empty", "consistent", "score", "taken"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        cols = list(zip(*found)) or [()] * 7
        return pa.table([pa.array([table.column("source")[0].as_py()] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["source", *names])

    return seen.groupBy("source").applyInArrow(one, "source string, delimiter string, pieces bigint, regular double, empty double, consistent double, score double, taken boolean")


def scanner(delimiters: list[str]) -> re.Pattern:
    """Pattern of quotes, brackets and the given delimiters."""
    found = "|".join(CANDIDATES[d] for d in CANDIDATES if d in set(delimiters)) or r"(?!)"
    return re.compile(f"(?P<q>{_QUOTED})|(?P<b>{_BRACKET})|(?P<s>{found})")


def values(text: str, scan: re.Pattern, further: Callable[[str], list[str]] | None = None) -> list[str]:
    """The values of a field, in order, without separators, list marks, joining words and outer quotes; unquoted ones are
    taken further apart by `further`."""
    out: list[str] = []
    expected = 1
    for piece in pieces(text, scan):
        for part in _numbered(piece, expected):
            if isinstance(part, int):
                expected = part
                continue
            p = _BULLET.sub("", part, count=1) if _BULLET.match(part) else part
            p = _JOINED.sub("", p, count=1) if _JOINED.match(p) else p
            p = p.strip()
            if len(p) > 1 and p[0] == '"' and re.fullmatch(_QUOTED, p):
                p = p[1:-1].replace('""', '"').strip()
                out += [p] if p else []
            elif p:
                more = further(p) if further is not None else [p]
                out += more if len(more) > 1 else [p]
    return out


def _numbered(piece: str, expected: int) -> Iterator[str | int]:
    """Parts between list numbers that count on from the number expected; the next expected number comes along."""
    at = 0
    protected = [(m.start(), m.end()) for m in re.finditer(f"{_QUOTED}|{_BRACKET}", piece)]
    for m in _NUMBER.finditer(piece):
        if int(m[1] or m[2]) != expected or any(a <= m.start() < b for a, b in protected if b > m.end() or m[2]):
            continue
        if expected == 1 and piece[: m.start()].strip():
            continue
        yield piece[at : m.start()]
        at, expected = m.end(), expected + 1
        yield expected
    yield piece[at:]


def unpack_values(df: DataFrame, column: str, source: str, keys: list[str] | None = None, further: dict[str, Callable[[str], list[str]]] | None = None) -> DataFrame:
    """One row per value packed in a field: df's other columns, then pos (from 1, empty values not counted) and item.

    Delimiters are inferred per value of the column `source`, over all fields. Null and blank fields give no
    rows; a field without a delimiter gives one. Delimiters in quotes, brackets and numbers belong to the
    value; outer quotes go, doubled ones within become one. A null source is a source of its own. further names, for
    sources whose values also follow each other without any separator, what takes such a value apart. With keys,
    rows that agree in them are one record. Columns pos and item in df are a ValueError.
    """
    no_clash(df, ["pos", "item"])
    others = [c for c in df.columns if c != column]
    taken = infer_delimiters(df, column, source).where("taken").groupBy("source").agg(F.collect_set("delimiter").alias("delimiters"))
    some = taken.limit(MAX_SOURCES + 1).collect()
    if len(some) <= MAX_SOURCES:
        known = {r[0]: sorted(r[1]) for r in some}
        fields = df.select(*columns(others), F.col(column).cast("string"), F.col(source).cast("string").alias("_source"), F.lit(None).cast("array<string>").alias("_delimiters"))
    else:
        known = {}
        marks = taken.select(F.col("source").alias("_named"), F.col("delimiters").alias("_delimiters"))
        fields = df.select(*columns(others), F.col(quoted(column)).cast("string").alias("_text"), F.col(quoted(source)).cast("string").alias("_source")).join(marks, F.col("_source").eqNullSafe(F.col("_named")), "left")
        fields = fields.select(*columns(others), "_text", "_source", F.coalesce("_delimiters", F.array().cast("array<string>")).alias("_delimiters"))
    n, more = len(others), further or {}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: dict[tuple[str, ...], re.Pattern] = {}
        for batch in batches:
            items = []
            for text, name, own in zip(*(batch.column(n + i).to_pylist() for i in range(3))):
                key = tuple(sorted(own) if own is not None else known.get(name, ()))
                if key not in scans:
                    scans[key] = scanner(list(key))
                items.append(values(text, scans[key], more.get(name)) if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(items, pa.list_(pa.string()))], [*others, "_items"])

    packed = fields.mapInArrow(split, spec(df.select(*columns(others)), "_items array<string>"))
    if keys:
        packed = packed.where(F.size("_items") > 0).dropDuplicates(keys)
    return packed.select(*columns(others), F.posexplode("_items").alias("pos", "item")).withColumn("pos", (F.col("pos") + 1).cast("int"))
