"""Typed lists of medications: entries apart, each entry taken apart, and how it is shown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import columns, no_clash, quoted, spec
from .runon import UNITS, split_run_on

#: How units are written out; words and abbreviations as times a day, and as counts.
UNIT_NAMES = {"mg": "mg", "mcg": "mcg", "g": "g", "ml": "mL", "meq": "mEq", "mcg/h": "mcg/h", "mcg/hr": "mcg/h", "unit": "units", "units": "units", "%": "%"}
TIMES = {"once": 1.0, "twice": 2.0, "three times": 3.0, "four times": 4.0, "qd": 1.0, "bid": 2.0, "tid": 3.0, "qid": 4.0, "qhs": 1.0}
COUNTS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0}
#: Release forms and routes spelled out; mass units in mg.
RELEASE = {"er": "extended-release", "xr": "extended-release", "xl": "extended-release", "sr": "sustained-release", "cd": "extended-release", "la": "extended-release", "dr": "delayed-release", "ec": "delayed-release", "ir": "immediate-release"}
ROUTES = {"iv": "intravenous", "im": "intramuscular", "subcutaneous": "subcutaneous", "transdermal": "transdermal", "sublingual": "sublingual", "nasal": "nasal", "inhaled": "inhaled", "topical": "topical"}
MASS = {"mg": 1.0, "mcg": 0.001, "g": 1000.0}
#: The patterns of an entry's parts.
NUMBER = r"\d+(?:\.\d+)?"
_DAILY = r"(?:a\s*|per\s*|/\s*)?(?:daily|day|d\b)"
_WEEKDAY = r"(?:mon|tues?|wed|thu(?:rs?)?|fri|sat|sun)(?:day)?"
_I = re.I
THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
SEPARATORS = re.compile(r"[,;\n]+")
STRENGTH = re.compile(rf"(?<![\w.])({NUMBER})\s*({UNITS})(?![a-z])", _I)
COMBINATION = re.compile(rf"(?<![\w.])({NUMBER})\s*({UNITS})?(?:\s*/\s*{NUMBER}\s*(?:{UNITS})?)+(?![a-z/])", _I)
PART = re.compile(rf"({NUMBER})\s*({UNITS})?", _I)
NAMED = re.compile(r"^\s*([^()=]*?)\s*\(([^()=]+)\)\s*(.*)$", re.S)
QUALIFIER = re.compile(r"\b(?:otc|generic|er|ir|sr|xl|xr|dr|ec|cd|la|ds|odt|sublingual|nasal|transdermal|oral|topical|inhaled|iv|im|subcutaneous|patch)\b", _I)
RELEASE_WORD = re.compile(r"\b(er|xr|xl|sr|cd|la|dr|ec|ir)\b", _I)
ROUTE_WORD = re.compile(r"\b(iv|im|subcutaneous|transdermal|sublingual|nasal|inhaled|topical)\b", _I)
WEEKDAYS = re.compile(rf"\b(?:on\s+)?{_WEEKDAY}(?:\s*(?:/|,|and)\s*{_WEEKDAY})+\b", _I)
WEEKDAY = re.compile(_WEEKDAY, _I)
AS_NEEDED = re.compile(r"\b(?:as\s+needed|prn|as\s+necessary)\b", _I)
DIRECTIONS = re.compile(r"\b(?:as\s+needed(?:\s+for\b.*)?|as\s+necessary|prn|at\s+bedtime|at\s+night|in\s+the\s+(?:morning|evening|afternoon)|(?:with|before|after)\s+(?:the\s+|a\s+)?(?:evening\s+|morning\s+)?(?:food|meals?|breakfast|lunch|dinner|supper)|on\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)s?)\b", _I)
QUANTITY = re.compile(rf"\b{NUMBER}\s*(?:puffs?|sprays?|inhalations?|actuations?|drops?)\b|\b(?:in\s+)?each\s+(?:nostril|eye|ear)\b|\bper\s+(?:spray|puff|tablet|capsule|dose|actuation|patch)\b", _I)
DOSES = re.compile(r"\b(\d+|one|two|three|four)\s*(?:tablets?|tabs?|capsules?|caps?|pills?|patch(?:es)?)\b", _I)
APPLICATIONS = re.compile(r"\b(\d+|one|two|three|four)\s*(?:sprays?|puffs?|inhalations?|actuations?|drops?)\b", _I)
BOTH_SIDES = re.compile(r"\b(?:in\s+)?each\s+(?:nostril|eye|ear)\b", _I)
MOST_AMOUNT = re.compile(rf"\b(?:max(?:imum)?|not\s+to\s+exceed|up\s+to)\s+({NUMBER})\s*(mg|mcg|g)\s*(?:/|per|a)\s*day\b", _I)
MOST_UNITS = re.compile(r"\b(?:max(?:imum)?|not\s+to\s+exceed|up\s+to)\s+(\d+)\s*(?:doses?|tablets?|tabs?|capsules?|caps?|sprays?|puffs?|patch(?:es)?)\s*(?:/|per|a)\s*day\b", _I)
NO_MORE = re.compile(r"\bno\s+more\s+than\s+(once|twice|\d+\s*times?)\s*(?:daily|a\s+day|per\s+day)\b", _I)
REPEAT = re.compile(r"\bmay\s+repeat(?:\s+(once|twice))?\b", _I)
EPISODE = re.compile(r"\bup\s+to\s+(\d+)\s*(?:tablets?|doses?|sprays?)\s+in\s+\d+\s*minutes\b", _I)
#: Ways to say how often, of which the first that occurs counts: pattern, kind.
FREQUENCIES = tuple((re.compile(p, _I), kind) for p, kind in (
    (r"\bx\s*(\d+)\s*(?:times\s*)?" + _DAILY, "count"),
    (r"\b(\d+)\s*(?:times|time|x)\s*" + _DAILY, "count"),
    (r"\b(once|twice|three times|four times)\s*" + _DAILY, "word"),
    (r"\b(qd|bid|tid|qid|qhs)\b", "word"),
    (r"\b(?:every|q)\s*(\d+)\s*(?:hours|hrs|hr|h)\b", "hours"),
    (r"\bq(\d+)h\b", "hours"),
    (r"\bx\s*(daily|day)\b", "bare"),
    (r"\b(?:once\s+|twice\s+)?(weekly|every\s+week|each\s+week|once\s+a\s+week|q\s*week|q7d)\b", "weekly"),
    (r"\b(daily|once a day|every day)\b", "bare"),
))


@dataclass
class Entry:
    """What an entry says; what it does not say is None, '' for the name, or empty."""

    raw_text: str = ""
    name_text: str = ""
    strength_value: float | None = None
    strength_unit: str | None = None
    times_per_day: float | None = None
    daily_total: float | None = None
    notes: list[str] = field(default_factory=list)
    brand_text: str | None = None
    components: list[str] = field(default_factory=list)
    component_strengths: list[dict] = field(default_factory=list)
    dose_count: float | None = None
    days_per_week: float | None = None
    schedule_text: str | None = None
    as_needed: bool = False
    stated_total: str | None = None
    release_form: str | None = None
    route: str | None = None


KIND = "struct<raw_text:string,name_text:string,strength_value:double,strength_unit:string,times_per_day:double,daily_total:double,notes:array<string>,brand_text:string,components:array<string>,component_strengths:array<struct<value:double,unit:string>>,dose_count:double,days_per_week:double,schedule_text:string,as_needed:boolean,stated_total:string,release_form:string,route:string>"
_ARROW = pa.struct([("raw_text", pa.string()), ("name_text", pa.string()), ("strength_value", pa.float64()), ("strength_unit", pa.string()), ("times_per_day", pa.float64()), ("daily_total", pa.float64()), ("notes", pa.list_(pa.string())), ("brand_text", pa.string()), ("components", pa.list_(pa.string())), ("component_strengths", pa.list_(pa.struct([("value", pa.float64()), ("unit", pa.string())]))), ("dose_count", pa.float64()), ("days_per_week", pa.float64()), ("schedule_text", pa.string()), ("as_needed", pa.bool_()), ("stated_total", pa.string()), ("release_form", pa.string()), ("route", pa.string())])


class _Rest:
    """A text from which parts are taken out."""

    def __init__(self, text: str):
        self.text = text

    def take(self, pattern: re.Pattern, every: bool = False) -> re.Match | None:
        found = pattern.search(self.text)
        if found is not None:
            self.text = pattern.sub(" ", self.text) if every else f"{self.text[: found.start()]} {self.text[found.end() :]}"
        return found


def _number(word: str) -> float:
    return COUNTS[word.lower()] if word.lower() in COUNTS else float(word)


def _clean(text: str) -> str:
    return re.sub(r"^[\s\-–:.]+|[\s\-–:.]+$", "", " ".join(text.split())).strip()


def _plain(names: str) -> list[str]:
    """Component names of a written generic, without forms and routes."""
    return [x for part in names.split("/") if (x := " ".join(QUALIFIER.sub(" ", part).split()))]


def _strengths(found: re.Match | None) -> list[tuple[float, str]]:
    """Value and unit of each part of a combination; a part without a unit has that of the last one."""
    parts = [(float(n), UNIT_NAMES[u.lower()] if u else None) for n, u in PART.findall(found[0])] if found else []
    last = next((u for _, u in reversed(parts) if u), None)
    return [(n, u or last) for n, u in parts] if last else []


def _how_often(rest: _Rest) -> tuple[float | None, bool, list[str]]:
    """Times a day, whether it is weekly, notes."""
    for pattern, kind in FREQUENCIES:
        if (found := rest.take(pattern)) is None:
            continue
        said = found[0].strip()
        if kind == "weekly":
            return None, True, [f'weekly dosing read from "{said}"; daily total not computed']
        if kind == "hours":
            return 24.0 / float(found[1]), False, [f'times per day computed as 24 divided by the hours in "{said}"']
        if kind == "bare":
            return 1.0, False, [f'frequency read as once daily from "{said}"']
        return (float(found[1]) if kind == "count" else TIMES[found[1].lower()]), False, []
    return None, False, ["no frequency found; daily total not computed"]


def _limits(text: str, value: float | None, unit: str | None) -> tuple[float | None, float | None, list[str]]:
    """Most a day as an amount in the strength's unit, most a day as units, notes."""
    if (m := MOST_AMOUNT.search(text)) and unit is not None:
        return float(m[1]) * MASS[m[2].lower()] / MASS.get(unit.lower(), 1.0), None, [f'daily maximum read from "{m[0].strip()}"']
    if m := MOST_UNITS.search(text):
        return None, float(m[1]), [f'daily maximum read from "{m[0].strip()}"']
    if m := NO_MORE.search(text):
        return None, TIMES.get(m[1].lower()) or float(re.search(r"\d+", m[1])[0]), [f'daily maximum read from "{m[0].strip()}"']
    if (m := REPEAT.search(text)) and value is not None:
        again = TIMES[(m[1] or "once").lower()]
        return None, 1.0 + again, [f'daily maximum read from "{m[0].strip()}": the first dose plus {again:g} repeat']
    return None, None, []


def _generic(parts: list[str]) -> str:
    return " and ".join(parts) if len(parts) < 3 else f"{', '.join(parts[:-1])} and {parts[-1]}"


def _word(pattern: re.Pattern, names: dict[str, str], *texts: str | None) -> str | None:
    return next((names[m[1].lower()] for t in texts if (m := pattern.search(t or ""))), None)


def parse(raw: str) -> Entry:
    """One entry, in any common form, such as Brand (generic) 10 mg twice daily = 20 mg/day; the stated total is kept as written."""
    out = Entry(raw_text=raw.strip())
    cut = re.search(r"\s=\s*", raw)
    text = raw[: cut.start()] if cut else raw
    out.stated_total = (raw[cut.end() :].strip() or None) if cut else None
    written, dosing = None, text
    if (named := NAMED.match(text)) and named[1].strip():
        own, inner, dosing = named[1].strip(), named[2].strip(), named[3]
        out.brand_text, written = (own, inner) if QUALIFIER.sub("", inner).strip() else (None, f"{own} {inner}")
    out.components = _plain(written) if written else []
    rest = _Rest(dosing)
    combined = COMBINATION.search(dosing)
    each = _strengths(combined)
    if each:
        rest.take(COMBINATION)
        unit = combined[2] or [u for _, u in PART.findall(combined[0]) if u][-1]
        out.strength_value, out.strength_unit = each[0][0], UNIT_NAMES[unit.lower()]
        notes = [f'combination strength "{combined[0].strip()}": daily total computed from the first number only']
    else:
        notes = []
        if found := rest.take(STRENGTH):
            out.strength_value, out.strength_unit = float(found[1]), UNIT_NAMES[found[2].lower()]
    value, unit = out.strength_value, out.strength_unit
    if len(out.components) > 1 and len(each) == len(out.components):
        out.component_strengths = [{"value": n, "unit": u} for n, u in each]
        notes = ["combination strength read per component: " + ", ".join(f"{c} {n:g} {u}" for c, (n, u) in zip(out.components, each))]
    days = rest.take(WEEKDAYS)
    times, weekly, said = _how_often(rest)
    if days:
        out.days_per_week = float(len({d.lower()[:3] for d in WEEKDAY.findall(days[0])}))
        out.schedule_text = re.sub(r"^on\s", "", days[0].strip(), flags=re.I).strip()
        times, said = times if times is not None else 1.0, [f"taken on {out.schedule_text} only: {out.days_per_week:g} days a week"]
    elif weekly:
        out.days_per_week, out.schedule_text = 1.0, "once weekly"
    out.as_needed = AS_NEEDED.search(dosing) is not None
    most, units, limits = _limits(dosing, value, unit)
    notes += said + limits
    episode = EPISODE.search(dosing)
    rest.take(EPISODE, every=True)
    rest.take(DIRECTIONS, every=True)
    applied = None
    if found := rest.take(APPLICATIONS):
        applied = _number(found[1]) * (2 if rest.take(BOTH_SIDES, every=True) else 1)
    found = rest.take(DOSES)
    out.dose_count = _number(found[1]) if found else applied
    rest.take(QUANTITY, every=True)
    if units is not None:
        times = units / (out.dose_count or 1.0)
    if out.as_needed and times is None and episode:
        notes.append(f"as-needed use of up to {episode[1]} per episode; no daily total")
    if written:
        out.name_text = _generic(out.components) if out.components else _clean(out.brand_text or "") if out.brand_text else _clean(QUALIFIER.sub(" ", rest.text))
    else:
        out.name_text = _clean(rest.text)
    notes += ["no drug name found in entry"] * (not out.name_text) + ["no strength found"] * (value is None)
    if out.dose_count is not None:
        notes.append(f"per-dose count of {out.dose_count:g} multiplied into the daily total")
    if unit == "mcg/h" and value is not None:
        notes.append("continuous rate; the daily total shows the rate itself")
        out.daily_total = value
    elif value is not None and times is not None:
        out.daily_total = value * times * (out.dose_count if out.dose_count is not None else 1.0)
    if most is not None:
        out.daily_total = most
        if times is None and value:
            times = most / (value * (out.dose_count or 1.0))
    out.times_per_day, out.notes = times, notes
    out.release_form = _word(RELEASE_WORD, RELEASE, out.brand_text, written, dosing)
    out.route = _word(ROUTE_WORD, ROUTES, written, dosing)
    return out


def split_list(text: str) -> list[str]:
    """The entries of a list: between commas, semicolons and lines (not within numbers), and where a new name follows a dosed one."""
    return [x for part in SEPARATORS.split(THOUSANDS.sub("", text)) if part.strip() for x in split_run_on(part.strip())]


def split_lists(df: DataFrame, column: str) -> DataFrame:
    """One row per entry of a typed list: df's other columns, pos (from 1), entry. Null and blank lists give none; existing columns of these names are a ValueError."""
    no_clash(df, ["pos", "entry"])
    others = [c for c in df.columns if c != column]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_list(t) if t else [] for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*others, "_entries"])

    packed = df.select(*columns(others), F.col(quoted(column)).cast("string")).mapInArrow(split, spec(df.select(*columns(others)), "_entries array<string>"))
    return packed.select(*columns(others), F.posexplode("_entries").alias("pos", "entry")).withColumn("pos", F.col("pos") + 1)


def parse_entries(df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
    """df with a struct of what each entry says (see Entry). A null entry gives null, a blank one a struct without a name."""
    no_clash(df, [into])
    kept, at = df.columns, df.columns.index(column)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = {t: asdict(parse(t)) for t in set(texts) if t is not None}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known.get(t) for t in texts], _ARROW)], [*kept, into])

    return df.select(*columns(kept)).mapInArrow(read, spec(df, f"{quoted(into)} {KIND}"))


def request_limit(value: Column, most: int = 50, usual: int = 10) -> Column:
    """A requested number of results between 1 and most; the usual number if it is none."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(value.try_cast("int"), F.lit(usual))))


def short_enough(text: Column, most: int = 4000) -> Column:
    """The text, or an error if it is too long; it is never cut."""
    return F.when(F.length(text) > most, F.raise_error(F.lit(f"the list has more than {most} characters"))).otherwise(text)


def _short(number: Column, digits: int) -> Column:
    """A number with thousands separators and without needless zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(number, digits), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def amount_text(amount: Column, unit: Column) -> Column:
    """An amount for reading: below 1 mg in micrograms, from 1,000 mg on with the grams in brackets, else two digits at most."""
    plain = F.concat_ws(" ", _short(amount, 2), unit)
    grams = F.concat(F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 1)), F.lit(" mg ("), F.replace(_short(amount / 1000, 6), F.lit(","), F.lit("")), F.lit(" g)"))
    tiny = F.concat(F.replace(_short(amount * 1000, 6), F.lit(","), F.lit("")), F.lit(" mcg ("), _short(amount, 9), F.lit(" mg)"))
    return F.when((unit == "mg") & (amount > 0) & (amount < 1), tiny).when((unit == "mg") & (amount >= 1000), grams).otherwise(plain)
