"""One surviving record for each group of duplicates, field by field, by weighted token consensus.

The distinct values of a field are put in order of strength. The strongest few are aligned one after another to a
growing profile (progressive alignment); the others are aligned to the finished profile, so that every token of
every value gets a column. Tokens and gaps vote in their column with the weight of their value; of the group's own
values the one closest to the winning tokens survives. Small groups are worked off whole within a task. In groups
of many records each value is placed on its own and the votes are counted by grouped aggregates, so that no task
holds such a group; both ways give the same rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_type, columns, quoted, runs
from ..functions.lineage import cut_lineage

#: Strongest values that make the profile; all others are aligned to it and vote alike.
PROFILE = 16
#: Records of a group from which on its values are spread over all tasks.
LARGE = 2_000
#: Parts into which a large group's values are dealt where they meet its profile.
SALTS = 64
#: Rows of an alignment held at once, at least; of longer ones the root of their number. The result doesn't depend on it.
BLOCK = 256
#: Digits after the point of a sum of weights: sums that differ only by the order of adding are equal.
DIGITS = 9

#: From here on a double has no digits to round.
_WHOLE = 2.0**52
_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass
class Field:
    """How a field's survivor is chosen.

    rank: the trust in each record (larger is more; a number, a time or a text, compared as such). vote: 'sum' adds up
    the weights of the records, so the majority decides, or the recent ones if weight falls with age; 'rank' lets a
    record outweigh any number of lower rank. valid: whether a value may vote and survive. value: what is taken (the
    column of the field's name by default). weight: of a record in 'sum' votes, 1 by default; a null counts as 0.
    """

    rank: Column
    valid: Column | None = None
    vote: str = "rank"
    weight: Column | None = None
    value: Column | None = None


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def align(guide: list[str], other: list[str]) -> list[tuple[int, int, str]]:
    """Columns of other's tokens: (place in the guide, 0) for those that stand for a guide token, (place before them,
    1, 2, ...) for those inserted. Least edits at any length; a change is preferred to an insert and a delete. What both
    begin and end with is not compared."""
    a, b = [x.lower() for x in guide], [x.lower() for x in other]
    if a == b:
        return [(i, 0, t) for i, t in enumerate(other, 1)]
    head, tail = _shared(a, b)
    out = [(i, 0, t) for i, t in enumerate(other[:head], 1)]
    moves = _middle(a[head : len(a) - tail], b[head : len(b) - tail])
    out += [(head + at, sub, other[head + j]) for j, (at, sub) in enumerate(moves)]
    return out + [(len(a) - tail + i, 0, other[len(b) - tail + i - 1]) for i in range(1, tail + 1)]


def _shared(a: list[str], b: list[str]) -> tuple[int, int]:
    """Tokens that both begin with, and tokens that what is left ends with."""
    head, tail, most = 0, 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


class _Edits:
    """Table of edits between x (rows) and y (columns), a row at a time; a row is kept as bits (Myers, Hyyrö)."""

    def __init__(self, y: list[str]):
        self.full = (1 << len(y)) - 1
        self.places: dict[str, int] = defaultdict(int)
        for j, t in enumerate(y):
            self.places[t] |= 1 << j
        #: Columns that take one edit more, and one less, than the column before.
        self.row = (self.full, 0)

    def step(self, token: str) -> tuple[int, int]:
        """Next row. Columns that take as many edits as the row and column before, and those that take one more than the row before."""
        (more, less), full, met = self.row, self.full, self.places.get(token, 0)
        slant = ((((met & more) + more) ^ more) | met | less) & full
        down = less | (full ^ (slant | more))
        shifted = ((down << 1) | 1) & full
        self.row = (((slant & more) << 1) & full) | (full ^ (slant | shifted)), shifted & slant
        return slant, down


def _middle(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    if not y:
        return []
    n, j = len(x), len(y)
    edits, block = _Edits(y), max(BLOCK, math.isqrt(n))
    starts = []
    for i, c in enumerate(x):
        if i % block == 0:
            starts.append(edits.row)
            if i + block >= n:
                break
        edits.step(c)
    out: list[tuple[int, bool]] = []
    for low in range(block * (len(starts) - 1), -1, -block):  # from the last block of rows on, each made again from its start
        if not j:
            break
        edits.row = starts.pop()
        rows = [edits.step(c) for c in x[low : low + block]]
        i = len(rows)
        while i and j:
            slant, down = rows[i - 1]
            if x[low + i - 1] == y[j - 1] or not slant >> (j - 1) & 1:
                out.append((low + i, True))
                i, j = i - 1, j - 1
            elif down >> (j - 1) & 1:
                i -= 1
            else:
                out.append((low + i, False))
                j -= 1
    out += [(0, False)] * j
    placed, last, run = [], None, 0
    for at, matched in reversed(out):
        run = 0 if matched else run + 1 if at == last else 1
        last = None if matched else at
        placed.append((at, run))
    return placed


def far(a: list[str], b: list[str]) -> int:
    """Tokens to change, add or take away between two values."""
    a, b = sorted(([x.lower() for x in a], [x.lower() for x in b]), key=len)
    head, tail = _shared(a, b)
    edits = _Edits(b[head : len(b) - tail])
    for c in a[head : len(a) - tail]:
        edits.step(c)
    more, less = edits.row
    return len(a) - head - tail + more.bit_count() - less.bit_count()


def _order(rank) -> tuple:
    """Nulls rank lowest, NaN highest, as in Spark."""
    return (0, 0) if rank is None else (2, 0) if rank != rank else (1, rank)


def _rounded(weight: float) -> float:
    """The weight to DIGITS, by the same operations as _rounded_column."""
    scaled = weight * 10.0**DIGITS
    return round(scaled) / 10.0**DIGITS if abs(scaled) < _WHOLE else weight


def _rounded_column(weight: Column) -> Column:
    scaled = weight * 10.0**DIGITS
    return F.when(F.abs(scaled) < _WHOLE, F.rint(scaled) / 10.0**DIGITS).otherwise(weight)


def strength(vote: str, weight: float, rank, value: str) -> tuple:
    return (_rounded(weight), _order(rank), value) if vote == "sum" else (_order(rank), value)


def profile(strongest: list[tuple[float, object, str]], vote: str) -> list[str]:
    """Progressive alignment of values (weight, rank, value), the strongest first: the strongest token of each column."""
    guide: list[tuple[str, dict[str, list]]] = []
    for weight, rank, value in strongest:
        own = tokens(value)
        if not guide:
            guide = [(t, {t: [weight, rank]}) for t in own]
            continue
        new: dict[int, list] = defaultdict(list)
        for at, sub, token in align([g[0] for g in guide], own):
            if sub:
                new[at].append((token, {token: [weight, rank]}))
                continue
            seen = guide[at - 1][1].setdefault(token, [0.0, rank])
            seen[0] += weight
            seen[1] = max(seen[1], rank, key=_order)
        grown = list(new[0])
        for at, (_, seen) in enumerate(guide, 1):
            grown.append((max(seen, key=lambda t: strength(vote, *seen[t], t)), seen))
            grown += new.get(at, [])
        guide = grown
    return [g[0] for g in guide]


def winners(votes: dict[tuple[int, int], dict[str, list]], total: float, ranked: list, vote: str) -> list[str]:
    """The winning token of each column in order, columns won by their gap left out. votes: column -> token -> weight and
    ranks of its values; ranked: all ranks. A gap has the weight of the values without a token in the column."""
    out = []
    for at in sorted(votes):
        column = votes[at]
        if vote == "sum":
            token, (weight, _) = max(column.items(), key=lambda c: strength(vote, c[1][0], c[1][1], c[0]))
            filled = sum(w for w, _ in column.values())
            if _rounded(weight) >= _rounded(total - filled):
                out.append(token)
        else:
            token, (_, rank) = max(column.items(), key=lambda c: strength(vote, c[1][0], c[1][1], c[0]))
            if _order(rank) >= _order(ranked):
                out.append(token)
    return out


def consensus(values: dict[str, list], vote: str) -> str | None:
    """The value closest to the consensus of values (value -> weight, rank); null if there is none."""
    if len(values) < 2:
        return next(iter(values), None)
    ordered = sorted(values, key=lambda v: strength(vote, *values[v], v), reverse=True)
    guide = profile([(*values[v], v) for v in ordered[:PROFILE]], vote)
    votes: dict[tuple[int, int], dict[str, list]] = defaultdict(dict)
    for v in sorted(values):
        weight, rank = values[v]
        for at, sub, token in align(guide, tokens(v)):
            seen = votes[at, sub].setdefault(token, [0.0, rank])
            seen[0] += weight
            seen[1] = max(seen[1], rank, key=_order)
    ideal = winners(votes, sum(w for w, _ in values.values()), max((r for _, r in values.values()), key=_order), vote)
    return max(values, key=lambda v: (-far(tokens(v), ideal), _order(values[v][1]), v))


def survivors(df: DataFrame, key: str, fields: dict[str, Field], record: str | None = None, least: int = 1) -> DataFrame:
    """One row per key: the key, n_records, and for each field its surviving value as a string (null if the group has no valid one).

    Of values equally close to the consensus the one with the greatest rank survives, then the greatest value. Null keys
    are left out, null values don't vote. With record, rows that agree in it and in the key are one record (the greatest
    by rank and values, then weights, stands for it) and those with a null record are left out; without, every row is a record. Groups of
    fewer than `least` records are left out. Groups of any size are handled; no task holds a group of more than LARGE rows.
    """
    rows = df.where(F.col(quoted(key)).isNotNull())
    kept = rows.select(F.col(quoted(key)).alias("key"), F.col(quoted(record)).cast("string").alias("record") if record else F.lit(None).cast("string").alias("record"), *_columns(fields))
    kept = kept.where("record is not null") if record else kept
    large = kept.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("key")
    if large.isEmpty():
        return _whole(kept, fields, bool(record), key, least)
    large = cut_lineage(large)
    small = kept.join(large, "key", "left_anti")
    return _whole(small, fields, bool(record), key, least).unionByName(_spread(kept.join(large, "key", "left_semi"), fields, bool(record), key, least))


def _columns(fields: dict[str, Field]) -> list[Column]:
    """Value, rank and weight of each field; values that may not survive are null."""
    out = []
    for i, (name, f) in enumerate(fields.items()):
        value = (f.value if f.value is not None else F.col(quoted(name))).cast("string")
        weight = F.coalesce(f.weight.cast("double"), F.lit(0.0)) if f.weight is not None else F.lit(1.0)
        out += [(value if f.valid is None else F.when(f.valid, value)).alias(f"v{i}"), f.rank.alias(f"r{i}"), weight.alias(f"w{i}")]
    return out


def _once(rows: list[tuple], n_fields: int) -> list[tuple]:
    """Each record once: the row with the greatest ranks and values, then weights."""

    def order(row: tuple) -> tuple:
        return tuple(_order(row[2 + 3 * i + j]) for js in ((1, 0), (2,)) for i in range(n_fields) for j in js)

    best: dict[str, tuple] = {}
    for row in rows:
        old = best.get(row[1])
        if old is None or (row != old and order(row) > order(old)):
            best[row[1]] = row
    return list(best.values())


def _whole(rows: DataFrame, fields: dict[str, Field], recorded: bool, key: str, least: int) -> DataFrame:
    """Groups worked off whole, one after another within sorted partitions."""
    names, votes = list(fields), [f.vote for f in fields.values()]
    kind = arrow_type(rows.schema["key"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * (2 + len(names))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], [key, "n_records", *names])

        for group, held in runs(batches):
            held = _once(held, len(names)) if recorded else held
            if len(held) < least:
                continue
            found = []
            for i, vote in enumerate(votes):
                values: dict[str, list] = {}
                for row in held:
                    value, rank, weight = row[2 + 3 * i : 5 + 3 * i]
                    if value is None:
                        continue
                    seen = values.setdefault(value, [0.0, rank])
                    seen[0] += weight
                    seen[1] = max(seen[1], rank, key=_order)
                for seen in values.values():
                    seen[0] = _rounded(seen[0])
                found.append(consensus(values, vote))
            out.append((group, len(held), *found))
            if len(out) == 5_000:
                yield batch()
                out.clear()
        yield batch()

    schema = ", ".join([f"{quoted(key)} {rows.schema['key'].dataType.simpleString()}", "n_records bigint", *(f"{quoted(n)} string" for n in names)])
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(work, schema)


def _spread(rows: DataFrame, fields: dict[str, Field], recorded: bool, key: str, least: int) -> DataFrame:
    """Groups of many records: the same by aggregates over (key, value), (key, column, token) and their salts."""
    if recorded:
        order = F.struct(*[F.col(f"{x}{i}") for xs in ("rv", "w") for i in range(len(fields)) for x in xs])
        rows = rows.groupBy("key", "record").agg(F.max_by(F.struct(*[F.col(f"{x}{i}") for i in range(len(fields)) for x in "vrw"]), order).alias("b")).select("key", "record", "b.*")
    rows = cut_lineage(rows)
    out = rows.groupBy("key").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= least)
    for i, (name, f) in enumerate(fields.items()):
        out = out.join(_field(rows.select("key", F.col(f"v{i}").alias("value"), F.col(f"r{i}").alias("rank"), F.col(f"w{i}").alias("weight")), f.vote, name), "key", "left")
    return out.select(F.col("key").alias(key), "n_records", *columns(fields))


def _field(rows: DataFrame, vote: str, name: str) -> DataFrame:
    """Key and surviving value of one field of large groups."""
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    votes = rows.where("value is not null").groupBy("key", "value").agg(_rounded_column(F.sum("weight")).alias("weight"), F.max("rank").alias("rank")).withColumn("salt", salt)
    votes = cut_lineage(votes)  # distinct values with their weights, read several times
    order = [F.desc("weight"), F.desc_nulls_last("rank"), F.desc("value")] if vote == "sum" else [F.desc_nulls_last("rank"), F.desc("value")]
    # the strongest of every part, then of those: no task sorts a whole group
    first = votes.withColumn("n", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("n") <= PROFILE)
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("n") <= PROFILE)
    packed = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "weight", "rank", "value"))).alias("strongest"))
    kind, rank = rows.schema["key"].dataType.simpleString(), rows.schema["rank"].dataType.simpleString()

    def skeleton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guides = [profile([(x["weight"], x["rank"], x["value"]) for x in row], vote) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(guides, pa.list_(pa.string()))], ["key", "guide"])

    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    guide = packed.select("key", "strongest").mapInArrow(skeleton, f"key {kind}, guide array<string>").select("key", "guide", salts.alias("salt"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, sub, token = [], [], [], []
            for i, (g, v) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                for a, b, t in align(g, tokens(v)):
                    row.append(i)
                    at.append(a)
                    sub.append(b)
                    token.append(t)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(at, pa.int32()), pa.array(sub, pa.int32()), pa.array(token, pa.string()), batch.column(1).take(take), batch.column(2).take(take)], ["key", "at", "sub", "token", "weight", "rank"])

    placed = votes.join(guide, ["key", "salt"]).select("key", "weight", "rank", "guide", "value").mapInArrow(place, f"key {kind}, at int, sub int, token string, weight double, rank {rank}")
    counted = placed.groupBy("key", "at", "sub", "token").agg(F.sum("weight").alias("weight"), F.max("rank").alias("rank"))
    total = votes.groupBy("key").agg(F.sum("weight").alias("total"), F.max("rank").alias("top"))
    if vote == "sum":
        won = counted.groupBy("key", "at", "sub").agg(F.max(F.struct(_rounded_column(F.col("weight")).alias("weight"), "rank", "token")).alias("w"), F.sum("weight").alias("filled")).join(total, "key").where(F.col("w.weight") >= _rounded_column(F.col("total") - F.col("filled")))
    else:
        won = counted.groupBy("key", "at", "sub").agg(F.max(F.struct("rank", "token")).alias("w")).join(total, "key").where(F.col("w.rank").eqNullSafe(F.col("top")))
    ideal = won.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", F.col("w.token").alias("token")))), lambda x: x["token"]).alias("ideal")).select("key", "ideal", salts.alias("salt"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [far(tokens(v), w or []) for v, w in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(gaps, pa.int32())], ["key", "value", "rank", "far"])

    scored = votes.join(ideal, ["key", "salt"], "left").select("key", "value", "rank", "ideal").mapInArrow(measure, f"key {kind}, value string, rank {rank}, far int")
    return scored.groupBy("key").agg(F.max(F.struct((-F.col("far")).alias("near"), "rank", "value"))["value"].alias(name))
