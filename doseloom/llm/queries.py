"""Queries of the operators in this package, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import label_values
from .labels import label_survivors, newest_labels
from .leaks import find_leaks
from .mixing import mix
from .names import map_names
from .pieces import cut_texts
from .sentences import learn_starters, split_sentences

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return newest_labels(_read(spark, folder, "label_summary")).select("ingredient_key", "label_id", "set_id")


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return label_survivors(_read(spark, folder, "label_summary"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    out = ["tbl", "row_id", "field", "pos", "sent_no", "start_char", "end_char"]
    documents = _read(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), F.lit("text").alias("field"), F.lit(1).alias("pos"), "text")
    sections = label_values(_read(spark, folder, "raw_label").withColumnRenamed("rec_id", "row_id"), "text_fields", True, ["row_id"], once=False)
    sections = sections.where("field <> 'adverse_reactions_table' and row_pos = 0").select(F.lit("raw_label").alias("tbl"), "row_id", "field", F.col("pos").cast("int"), F.col("value").alias("text"))
    evidence = _read(spark, folder, "tag_evidence").where("field_name not like 'openfda.%'").select(F.lit("tag_evidence").alias("tbl"), F.col("evidence_id").alias("row_id"), F.col("field_name").alias("field"), F.lit(1).alias("pos"), F.col("sentence").alias("text"))
    known = learn_starters(*(t.select("text") for t in (documents, sections, evidence)))
    parts = [split_sentences(documents, starters=known), split_sentences(sections, keys=["row_id", "field", "pos"], starters=known), split_sentences(evidence, keys=["row_id"], starters=known)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*out)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, labels = _read(spark, folder, "medication_row"), _read(spark, folder, "label_summary")
    typed = F.array(F.struct(F.lit("as_entered").alias("field"), F.col("as_entered").alias("value")), F.struct(F.lit("matched_name").alias("field"), F.col("matched_name").alias("value")))
    entered = rows.dropDuplicates(["med_id"]).select(F.lit("medication_row").alias("tbl"), F.col("med_id").alias("row_id"), F.inline(typed)).where("field = 'as_entered' or value is not null").select("tbl", "row_id", "field", F.lit(1).alias("pos"), "value")
    once = labels.select("row_id", "brand_names", "generic_names").dropDuplicates(["row_id"])
    named = [once.select(F.lit("label_summary").alias("tbl"), "row_id", F.lit(c).alias("field"), F.posexplode(c).alias("pos", "value")).withColumn("pos", F.col("pos") + 1) for c in ("brand_names", "generic_names")]
    found = map_names(entered.unionByName(named[0]).unionByName(named[1]), "value", _read(spark, folder, "name_dictionary"))
    return found.select("tbl", "row_id", "field", "pos", "name_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_read(spark, folder, "documents"), _read(spark, folder, "eval_item")).select("item_id", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    report = mix(_read(spark, folder, "documents"), _read(spark, folder, "mix_target")).report
    return report.where("placed_tokens < target_tokens and short").select("source")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """A document of more than 512 tokens is one that gets a second piece."""
    pieces = cut_texts(_read(spark, folder, "documents").select("doc_id", "text"))
    return pieces.where("piece_no = 2").select("doc_id").distinct()


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_read(spark, folder, "documents"), _read(spark, folder, "mix_target")).rows


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(_read(spark, folder, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_survivors, p3_found, p4_found, p7_found, p8_found, p8_mixture, p9_found, p9_pieces)}

SQL: dict[str, str] = {
    "p2_found": r"""
with once as (select distinct label_id, set_id, version, effective_time, ingredient_set from label_summary where label_id is not null),
parts as (select label_id, unnest(ingredient_set) as entry from once),
names as (select label_id, upper(trim(regexp_replace(unnest(regexp_split_to_array(entry, '[,;|/]')), '[\s\x{a0}]+', ' ', 'g'))) as name from parts where entry is not null),
keyed as (select label_id, array_to_string(list_sort(list(distinct name)), '|') as ingredient_key from names where name <> '' group by label_id),
ranked as (
  select k.ingredient_key, k.label_id,
    coalesce(try_strptime(case when regexp_full_match(trim(effective_time), '[0-9]{14}') then substr(trim(effective_time), 1, 8) else trim(effective_time) end, ['%Y%m%d', '%Y-%m-%d', '%Y/%m/%d', '%d %b %Y']), timestamp '0001-01-01') as day,
    coalesce(try_cast(nullif(regexp_extract(trim(version), '^v?([0-9]+)([.][0-9]*)?$', 1), '') as bigint), 0) as number,
    case when regexp_full_match(lower(trim(set_id)), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') and not regexp_full_match(set_id, '[0-]+') then lower(trim(set_id)) end as real_set
  from keyed k join once using (label_id))
select ingredient_key, max_by(label_id, row(day, number, label_id)) as label_id,
  coalesce(max_by(real_set, row(day, number, label_id)) filter (where real_set is not null), '') as set_id
from ranked group by ingredient_key having count(distinct label_id) > 1
""",
}
