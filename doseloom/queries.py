"""Queries of the problems whose operators are general."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.runon import split_run_on
from .operators.nested import EVERY, nested_tables
from .operators.packed import unpack_values
from .plans.dosing import daily_totals, ingredient_amounts, stated_amounts, stated_totals

Query = Callable[[SparkSession, str], DataFrame]
#: Fields of a raw label's blocks that are lists even where a single value stands: all, and lists within them.
LABEL_LISTS = {EVERY, "components[].strengths", "adverse_reactions_table[].rows", "adverse_reactions_table[].rows[].cells"}
#: The lists whose elements are the innermost values, other than lists of texts.
INNERMOST = ("components[].strengths[]", "adverse_reactions_table[].rows[].cells[]")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lists = read(spark, folder, "patient_result").select(F.lit("patient_result").alias("tbl"), F.col("result_id").alias("row_id"), F.lit("medications").alias("source"), F.col("medications").alias("text"))
    labels = read(spark, folder, "tag_evidence").where("field_name like 'openfda.%'").select(F.lit("tag_evidence").alias("tbl"), F.col("evidence_id").alias("row_id"), F.col("field_name").alias("source"), F.col("sentence").alias("text"))
    return unpack_values(lists.unionByName(labels), "text", "source", ["tbl", "row_id"], {"medications": split_run_on}).select("tbl", "row_id", "pos", "item")


def _both(totals: DataFrame, parts: DataFrame) -> DataFrame:
    """Totals of medication rows and ingredient amounts as one table."""
    totals = totals.withColumnRenamed("med_id", "row_id").select(F.lit("medication_row").alias("tbl"), "*")
    return totals.unionByName(parts.withColumnRenamed("amount_id", "row_id").select(F.lit("entry_amount").alias("tbl"), "*"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What is stated; nothing is left to solve there."""
    rows, amounts = read(spark, folder, "medication_row"), read(spark, folder, "entry_amount")
    return _both(stated_totals(rows), stated_amounts(amounts, rows))


def p5_solved(spark: SparkSession, folder: str) -> DataFrame:
    """p5_found's rows and those whose unit or period the identity gives, with what it says of them all."""
    rows, amounts = read(spark, folder, "medication_row"), read(spark, folder, "entry_amount")
    totals = daily_totals(rows).withColumn("period_from", F.lit(None).cast("string"))
    return _both(totals, ingredient_amounts(amounts, rows)).where("milli_per_day is not null")


def label_values(labels: DataFrame, block: str, with_values: bool, keys: list[str], once: bool = True) -> DataFrame:
    """Innermost values of a block of raw labels: keys, field, pos, row_pos, cell_pos, and value (text of a plain value or of an object around it) or not.

    Fields list texts, but for INNERMOST; an object around a text counts as the text, and a text in the place of such a
    list's object too. Blank texts are left out. With once, rows that agree in the keys are one record.
    """
    last = F.map_keys(F.map_filter("values", lambda _, v: F.trim(v) != "")) if with_values else F.col("filled")
    rows = nested_tables(labels.select(*keys, block), block, block, LABEL_LISTS, with_values, keys if once else None)
    depth, place = F.size("places"), lambda i: F.coalesce(F.get("places", F.lit(i)), F.lit(0))
    field = F.regexp_extract("table", r"^([^\[.]+|`[^`]*`)\[\]", 1)
    deep = field.isin([x.split("[")[0] for x in INNERMOST])
    text = F.exists(last, lambda n: n.rlike(r"^(text(\.text)*)?$"))
    listed = (depth == 1) & F.when(deep, text).otherwise(F.size(last) > 0)
    inner = F.col("table").isin(list(INNERMOST)) & (~F.col("is_value") | (F.size(last) > 0))
    value = F.coalesce(*[F.try_element_at("values", F.lit(".".join(["text"] * i))) for i in range(4)]) if with_values else None
    return rows.where(listed | inner).select(*keys, F.regexp_replace(field, "`", "").alias("field"), *[place(i).alias(n) for i, n in enumerate(("pos", "row_pos", "cell_pos"))], *([value.alias("value")] if with_values else []))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "raw_label")
    blocks = [label_values(labels, b, False, ["rec_id"]).select("rec_id", F.lit(b).alias("block"), "field", "pos", "row_pos", "cell_pos") for b in ("openfda", "text_fields")]
    return blocks[0].unionByName(blocks[1])


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p5_found": p5_found, "p5_solved": p5_solved, "p6_found": p6_found}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


#: The units, multipliers and periods as the SQL has them, written down for themselves so that they can disagree with functions/units.
_SQL_UNITS = [
    *((u, "mg", 1.0) for u in "mg mgs milligram milligrams".split()),
    *((u, "mg", 0.001) for u in "mcg mcgs ug \u00b5g \u03bcg microgram micrograms".split()),
    *((u, "mg", 0.000001) for u in "ng nanogram nanograms".split()),
    *((u, "mg", 1000.0) for u in "g gm gms gram grams".split()),
    *((u, "mg", 1000000.0) for u in "kg kilogram kilograms".split()),
    *((u, "units", 1.0) for u in "u unit units iu ius ie".split()),
    *((u, "mEq", 1.0) for u in "meq meqs milliequivalent milliequivalents".split()),
    ("eq", "mEq", 1000.0),
]
_SQL_SCALES = [("k", 1000.0), ("thousand", 1000.0), ("x1000", 1000.0), ("thou", 1000.0), ("m", 1000000.0), ("million", 1000000.0), ("mio", 1000000.0), ("mill", 1000000.0)]
_SQL_PERIODS = [*((p, 1.0) for p in "d day days daily 24h".split()), *((p, 1 / 7) for p in "wk week weeks weekly".split()), *((p, 1 / 14) for p in "fortnight fortnightly biweekly".split()), *((p, 24.0) for p in "h hr hour hourly rate".split()), ("min", 1440.0), ("minute", 1440.0)]
_NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]*[.,][0-9]+|[0-9]+)"
_UNIT = r"(x ?1,?000|thousand|thou|million|mio\.?|mill|k|m)??\s*(?:int\.?\s*|international\s+|usp\s+)?(" + "|".join(sorted((u[0] for u in _SQL_UNITS), key=lambda u: (-len(u), u))) + ")"


def _rate(text: str) -> str:
    """SQL for the times per day of a period's text."""
    t = rf"regexp_replace(regexp_replace(lower(trim({text})), '^(/|per |every |each |q\.?\s?)\s*|\.$', ''), '^every\s+', '')"
    counted = rf"regexp_extract({t}, '^([0-9.]+)\s*(h|hr|hrs|hour|hours|d|day|days|wk|wks|week|weeks)$', 2)"
    size = rf"try_cast(regexp_extract({t}, '^([0-9.]+)\s*(h|hr|hrs|hour|hours|d|day|days|wk|wks|week|weeks)$', 1) as double)"
    return f"coalesce((select rate from periods where name = {t}), case left({counted}, 1) when 'h' then 24 / {size} when 'd' then 1 / {size} when 'w' then 1 / (7 * {size}) end)"


def _number(text: str) -> str:
    return rf"try_cast(case when regexp_full_match({text}, '[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?') then replace({text}, ',', '') else replace({text}, ',', '.') end as double)"


def _unwrapped(j: str) -> str:
    return f"case when json_type({j}) = 'VARCHAR' and json_valid({j} ->> '$') then ({j} ->> '$')::json when json_type({j}) = 'OBJECT' and len(json_keys({j})) = 1 and json_keys({j})[1] = block then {j} -> block else {j} end"


def _items(j: str) -> str:
    """SQL for a JSON value as a list of JSON values."""
    return f"case coalesce(json_type({j}), 'NULL') when 'NULL' then []::json[] when 'ARRAY' then from_json({j}, '[\"json\"]') else [{j}] end"


_DEEP = "((field = 'components' and block = 'openfda') or (field = 'adverse_reactions_table' and block = 'text_fields'))"

SQL: dict[str, str] = {
    "p6_found": f"""
with once as (select distinct rec_id, openfda, text_fields from raw_label),
t0 as (select rec_id, 'openfda' as block, openfda as t from once union all select rec_id, 'text_fields', text_fields from once),
j0 as (select rec_id, block, t::json as j from t0 where t is not null and json_valid(t)),
j1 as (select rec_id, block, {_unwrapped("j")} as j from j0), j2 as (select rec_id, block, {_unwrapped("j")} as j from j1), j3 as (select rec_id, block, {_unwrapped("j")} as j from j2), j4 as (select rec_id, block, {_unwrapped("j")} as j from j3),
named as (select rec_id, block, unnest(from_json(j, '["json"]')) as x from j4 where json_type(j) = 'ARRAY'),
keys as (select rec_id, block, j, unnest(json_keys(j)) as field from j4 where json_type(j) = 'OBJECT'),
fields as (select rec_id, block, field, json_extract(j, '$."' || field || '"') as v from keys union all select rec_id, block, x ->> 'name', x -> 'values' from named where json_type(x) = 'OBJECT'),
outer_items as (select rec_id, block, field, unnest({_items("v")}) as e, generate_subscripts({_items("v")}, 1) as pos from fields),
texts as (select rec_id, block, field, pos, 0 as row_pos, 0 as cell_pos, case when json_type(e) = 'OBJECT' then e ->> 'text' else e ->> '$' end as value from outer_items where not {_DEEP} or json_type(e) = 'VARCHAR'),
inner_items as (select rec_id, block, field, pos, unnest({_items("(case field when 'components' then e -> 'strengths' else e -> 'rows' end)")}) as e, generate_subscripts({_items("(case field when 'components' then e -> 'strengths' else e -> 'rows' end)")}, 1) as row_pos from outer_items where {_DEEP} and json_type(e) = 'OBJECT'),
cells as (select rec_id, block, field, pos, row_pos, unnest({_items("(e -> 'cells')")}) as e, generate_subscripts({_items("(e -> 'cells')")}, 1) as cell_pos from inner_items where field <> 'components')
select rec_id, block, field, pos::int as pos, row_pos, cell_pos from texts where value is not null and trim(value, E' \\t\\n\\r') <> ''
union all select rec_id, block, field, pos::int, row_pos::int, 0 from inner_items where field = 'components' and json_type(e) <> 'NULL'
union all select rec_id, block, field, pos::int, row_pos::int, cell_pos::int from cells where json_type(e) <> 'NULL'""",
    "p5_found": rf"""
with units(name, dim, size) as (values {_values(_SQL_UNITS)}),
scales(name, times) as (values {_values(_SQL_SCALES)}, ('', 1.0)),
periods(name, rate) as (values {_values(_SQL_PERIODS)}),
texts as (select distinct daily_total_unit as t, 'unit' as kind from medication_row union select distinct unit, 'unit' from entry_amount union select distinct as_entered, 'entered' from medication_row),
parts as (select t, kind, case kind
    when 'unit' then regexp_extract(lower(t), '^\s*{_NUMBER}?\s*{_UNIT}\.?\s*(?:(?:/\s*|per\s+)([a-z0-9 ]+?)\.?)?\s*$', ['number', 'scale', 'unit', 'period'])
    else regexp_extract(lower(t), '(?:^|[^a-z0-9_.,]){_NUMBER}\s*{_UNIT}(?:$|[^\pL\pN])', ['number', 'scale', 'unit']) end as x,
    case kind when 'entered' then regexp_extract(lower(t), '(?:^|[^a-z0-9_.,]){_NUMBER}\s*{_UNIT}\.?\s*(?:/\s*|per\s+)(h|hr|hour|d|day|wk|week)\b', 4) end as entered_period from texts where t is not null),
read as (select t, kind, {_number("x.number")} as number, dim, size * times as factor, nullif(coalesce(entered_period, x.period), '') as period
  from parts join units on units.name = x.unit join scales on scales.name = regexp_replace(coalesce(x.scale, ''), '[., ]', '', 'g') where scales.name = '' or dim = 'units'),
known as (select t, kind, number, dim, factor, case when period is not null then {_rate("period")} end as rate from read where period is null or {_rate("period")} is not null),
med as (select distinct med_id, as_entered, daily_total, daily_total_unit from medication_row),
totals as (select 'medication_row' as tbl, med_id as row_id, dim, round(daily_total * factor * coalesce(rate, 1) * 1000)::bigint as milli_per_day
  from med join known on kind = case when daily_total_unit is null then 'entered' else 'unit' end and t = coalesce(daily_total_unit, as_entered) where daily_total is not null),
amt as (select distinct amount_id, med_id, amount, unit, period from entry_amount),
parts_of as (select 'entry_amount' as tbl, amount_id as row_id, dim, round(coalesce(amount, case when unit is not null then number end) * factor * coalesce(case when unit is not null then rate end, {_rate("period")}) * 1000)::bigint as milli_per_day
  from amt left join (select med_id, any_value(as_entered) as as_entered from med group by med_id) m using (med_id) join known on kind = case when unit is null then 'entered' else 'unit' end and t = coalesce(unit, as_entered))
select * from totals where milli_per_day is not null union all select * from parts_of where milli_per_day is not null""",
}
