"""Queries of the document, search, list and evaluation operators over the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import entries
from .functions import text as T
from .operators import collect, evaluation, lists, markup, relations, resolve, search, tagging
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:[.''][a-z0-9]+)*')"
_POSTED = f"words as (select doc_id, unnest({_WORDS}) as term from documents), posted as (select doc_id, term, count(*) as tf from words group by all), size as (select doc_id, len({_WORDS}) as n_terms from documents), stats as (select count(*) as n_docs, avg(n_terms) as mean from size), dfs as (select term, count(*) as df from posted group by term)"
_SCORE = "round(sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6)"
_FIXED = [(1, "liver dose tablets"), (2, "kidney rash rash"), (3, "alcohol")]
_FIXED_SQL = "asked as (select * from (values (1, 'liver dose tablets'), (2, 'kidney rash rash'), (3, 'alcohol')) v(query_id, query)), wanted as (select query_id, unnest(string_split(query, ' ')) as term from asked), times as (select query_id, term, count(*) as times from wanted group by all)"
_NEGATED = "(?i)\\bno clinically (significant|meaningful|relevant|important)\\b|\\bnot clinically (significant|meaningful|relevant|important)\\b|\\bno (significant|meaningful|relevant) (effect|interaction|change|increase|prolongation)|\\bno (dose|dosage) adjustments? (is|are|was|were)? ?(needed|necessary|required|recommended)|\\bdoes not (require|need) (a )?(dose|dosage) adjustment|\\bno (evidence|reports?|cases?) of\\b|\\bnot (been )?(associated|observed|reported|seen|expected)\\b|\\bdid not (prolong|increase|affect|alter|result in|cause)\\b|\\bdoes not (prolong|increase|affect|alter|cause)\\b|\\bis not (a )?(controlled|scheduled)\\b|\\bnot a controlled substance\\b|\\bnot (expected|known|likely) to\\b|\\bwithout (clinically )?(significant|meaningful)\\b|\\b(was|were) not (observed|seen|reported|detected|found)\\b|\\bunlikely to\\b|\\bno interaction"
_EVIDENCE = "evidence as (select distinct * from tag_evidence)"


# collecting


@query("""
with d as (select *, case when text is null or text = '' then 1 when lang is null then 2 when source is null then 3 when section is null then 4 else 5 end as ord from documents),
n as (select ord, count(*) as n from d group by ord),
s(stage, ord) as (values ('text', 1), ('lang', 2), ('source', 3), ('section', 4), ('kept', 5))
select stage, s.ord, case when s.ord = 5 then 0 else coalesce(n.n, 0) end::bigint as failed,
  case when s.ord = 5 then coalesce(n.n, 0) else (select coalesce(sum(m.n), 0) from n m where m.ord > s.ord) end::bigint as remaining
from s left join n using (ord)""")
def scope_stage_counts(spark, folder):
    stages = [("text", F.length("text") > 0), ("lang", F.col("lang").isNotNull()), ("source", F.col("source").isNotNull()), ("section", F.col("section").isNotNull())]
    return collect.stage_counts(read(spark, folder, "documents"), stages)


@query("select o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as o_orderdate, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) as o_totalprice from orders group by o_custkey")
def newest_per_key(spark, folder):
    orders = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return collect.newest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("with w as (select arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as k from orders group by o_custkey) select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem where l_orderkey in (select k from w) group by l_returnflag")
def winner_semi_join(spark, folder):
    won = collect.newest_per_key(read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    kept = read(spark, folder, "lineitem").join(won, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select sha256(text) as key, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def key_violations(spark, folder):
    return collect.repeated_keys(read(spark, folder, "documents"), F.sha2("text", 256))


@query(r"""
with once as (select distinct * from label_summary),
named as (select 'brand' as kind, row_id, unnest(brand_names) as name from once union all select 'generic', row_id, unnest(generic_names) from once),
clean as (select kind, row_id, lower(trim(regexp_replace(name, '[\s\x{a0}]+', ' ', 'g'))) as name_key from named),
sets as (select row_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(ingredient_set, lambda x: x is not null))), '|'), '') as set_key from once)
select name_key, string_agg(distinct kind, ',' order by kind) as kinds, count(distinct set_key) as n_sets, count(*) as n_rows from clean join sets using (row_id) where name_key <> '' group by name_key""")
def name_dictionary_build(spark, folder):
    labels = read(spark, folder, "label_summary").dropDuplicates(["row_id"])
    names = F.filter(F.coalesce("ingredient_set", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return collect.name_table(labels, {"brand": "brand_names", "generic": "generic_names"}, F.array_join(F.array_sort(F.array_distinct(names)), "|"))


@query(r"""
with once as (select distinct row_id, ingredient_set from label_summary),
names as (select row_id, upper(trim(regexp_replace(unnest(ingredient_set), '[\s\x{a0}]+', ' ', 'g'))) as name from once),
keyed as (select row_id, string_agg(distinct name, '|' order by name) as set_key from names where name <> '' group by row_id)
select set_key, count(*) as n_labels from keyed group by set_key""")
def canonical_set_key(spark, folder):
    labels = read(spark, folder, "label_summary").dropDuplicates(["row_id"])
    names = F.filter(F.transform("ingredient_set", lambda x: F.upper(T.collapse(x))), lambda x: x != "")
    return labels.select(F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("set_key")).where("set_key <> ''").groupBy("set_key").agg(F.count("*").alias("n_labels"))


@query("""
with e as (select distinct evidence_id, set_id, term_id from tag_evidence), k as (select distinct term_id from e where term_id < 'T05')
select set_id, count(*) as n from e where set_id is not null and not exists (select 1 from k where k.term_id = e.term_id) group by set_id""")
def incremental_anti_join(spark, folder):
    rows = read(spark, folder, "tag_evidence").select("evidence_id", "set_id", "term_id").dropDuplicates(["evidence_id"])
    return collect.unseen(rows, rows.where("term_id < 'T05'"), "term_id").where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("n"))


@query("select doc_id, substr(sha256(concat_ws('|', doc_id::varchar, coalesce(set_id, ''), coalesce(lang, ''), 'rules-v1')), 1, 16) as cache_key from documents")
def cache_key_hash(spark, folder):
    return read(spark, folder, "documents").select("doc_id", T.cache_key(F.col("doc_id"), F.col("set_id"), F.col("lang"), F.lit("rules-v1")).alias("cache_key"))


# words and search


@query(f"select lang, count(*) as n_docs, sum(len({_WORDS}))::bigint as n_terms, max(len({_WORDS}))::int as longest from documents group by lang")
def tokenize_stats(spark, folder):
    size = F.size(T.tokens(F.col("text")))
    return read(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_terms"), F.max(size).alias("longest"))


@query(f"with {_POSTED} select doc_id, term, tf from posted")
def term_frequencies(spark, folder):
    return search.postings(read(spark, folder, "documents"))


@query(f"with {_POSTED} select term, df from dfs")
def document_frequencies(spark, folder):
    return search.document_frequencies(search.postings(read(spark, folder, "documents")))


@query(f"with {_POSTED} select n_docs, round(mean, 6) as mean_terms from stats")
def avg_doc_length(spark, folder):
    return search.lengths(read(spark, folder, "documents")).agg(F.count("*").alias("n_docs"), F.round(F.coalesce(F.avg("n_terms"), F.lit(0.0)), 6).alias("mean_terms"))


_BM25 = f"hits as (select query_id, doc_id, {_SCORE} as score from times join posted using (term) join dfs using (term) join size using (doc_id) cross join stats where doc_id in (select doc_id from seen) group by all), ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits where score > 0)"


def _asked(spark):
    return spark.createDataFrame(_FIXED, "query_id int, query string")


@query(f"with {_POSTED}, {_FIXED_SQL}, seen as (select doc_id from documents), {_BM25} select query_id, rank::int as rank, doc_id, score from ranked where rank <= 10")
def bm25_topk(spark, folder):
    return search.bm25(read(spark, folder, "documents"), _asked(spark))


@query(f"with {_POSTED}, wanted as (select item_id as query_id, unnest({_WORDS}) as term from eval_item where kind = 'query'), times as (select query_id, term, count(*) as times from wanted group by all), seen as (select doc_id from documents), {_BM25} select query_id, rank::int as rank, doc_id, score from ranked where rank <= 10")
def bm25_multi_query(spark, folder):
    asked = read(spark, folder, "eval_item").where("kind = 'query'").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(read(spark, folder, "documents"), asked)


_TAGS = "tagged as (select doc_id, list_value(coalesce(lang, '-'), coalesce(source, '-'), coalesce(section, '-')) as tags from documents)"


def _tags():
    return F.array(*[F.coalesce(c, F.lit("-")) for c in ("lang", "source", "section")])


@query(f"with {_TAGS} select doc_id from tagged where list_has_all(tags, ['en', 'openfda_label'])")
def facet_and(spark, folder):
    return read(spark, folder, "documents").where(search.has_facets(_tags(), ["en", "openfda_label"])).select("doc_id")


@query(f"with {_TAGS} select doc_id from tagged where list_has_any(tags, ['ja', 'rxnorm_note'])")
def facet_or(spark, folder):
    return read(spark, folder, "documents").where(search.has_facets(_tags(), ["ja", "rxnorm_note"], "or")).select("doc_id")


@query("select count(*) as n from documents")
def facet_none(spark, folder):
    return read(spark, folder, "documents").where(search.has_facets(_tags(), [])).agg(F.count("*").alias("n"))


@query("select doc_id, 0.0::double as score from documents where source = 'lay_summary' order by doc_id limit 20")
def blank_query_listing(spark, folder):
    return read(spark, folder, "documents").where("source = 'lay_summary'").select("doc_id", F.lit(0.0).alias("score")).orderBy("doc_id").limit(20)


@query(f"with {_POSTED}, {_FIXED_SQL}, seen as (select doc_id from documents where source = 'lay_summary'), {_BM25} select query_id, rank::int as rank, doc_id, score from ranked where rank <= 10")
def facet_then_bm25(spark, folder):
    return search.bm25(read(spark, folder, "documents"), _asked(spark), facet=F.col("source") == "lay_summary")


@query(r"""
with p as (select doc_id, text, list_min(list_filter([strpos(lower(text), 'liver'), strpos(lower(text), 'kidney')], lambda x: x > 0)) as hit from documents),
b as (select *, greatest(coalesce(hit, 1) - 80, 1) as a, least(coalesce(hit - 1 + 80, 160), length(text)) as z from p)
select doc_id, coalesce(case when a > 1 then '…' else '' end || regexp_replace(substr(text, a, z - a + 1), '^[\s\x{a0}\x{3000}\x{2028}]+|[\s\x{a0}\x{3000}\x{2028}]+$', '', 'g') || case when z < length(text) then '…' else '' end, '') as snippet from b""")
def snippet_extract(spark, folder):
    return read(spark, folder, "documents").select("doc_id", T.snippet(F.col("text"), F.array(F.lit("liver"), F.lit("kidney"))).alias("snippet"))


# sentences and tags


_PLAIN = "trim(regexp_replace(sentence, '[\\s\\x{a0}\\x{3000}\\x{2028}]+', ' ', 'g'))"
_PLAIN = f"regexp_replace({_PLAIN}, '(e\\.g|i\\.e|vs|approx|etc|mg|no|dr|fig|spp)\\.', '\\1' || chr(1), 'gi')"
_PLAIN = f"list_filter(list_transform(string_split(regexp_replace({_PLAIN}, '([.!?]) ([A-Z0-9(\\[\"''])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@query(f"with {_EVIDENCE} select field_name, count(*) as n_rows, sum(len({_PLAIN}))::bigint as n_sentences from evidence where sentence is not null group by field_name")
def sentence_split_counts(spark, folder):
    rows = read(spark, folder, "tag_evidence").dropDuplicates(["evidence_id"]).where("sentence is not null")
    return rows.groupBy("field_name").agg(F.count("*").alias("n_rows"), F.sum(F.size(T.plain_sentences(F.col("sentence")))).alias("n_sentences"))


@query(f"""
with {_EVIDENCE}, s as (select set_id, evidence_id, field_name, unnest({_PLAIN}) as s, generate_subscripts({_PLAIN}, 1) as n from evidence where sentence is not null and set_id is not null),
m as (select *, case field_name when 'contraindications' then 1 when 'boxed_warning' then 2 else 3 end as f from s where regexp_matches(s, '(?i)dialysis'))
select set_id, arg_min(s, row(f, evidence_id, n)) as sentence from m group by set_id""")
def first_matching_sentence(spark, folder):
    rows = read(spark, folder, "tag_evidence").dropDuplicates(["evidence_id"]).where("set_id is not null")
    s = rows.select("set_id", "evidence_id", "field_name", F.posexplode(T.plain_sentences(F.col("sentence"))).alias("n", "s")).where(F.col("s").rlike("(?i)dialysis"))
    place = F.when(F.col("field_name") == "contraindications", 1).when(F.col("field_name") == "boxed_warning", 2).otherwise(3)
    return s.groupBy("set_id").agg(F.min_by("s", F.struct(place.alias("f"), "evidence_id", "n")).alias("sentence"))


@query(f"with {_EVIDENCE} select field_name, count(*) filter (where regexp_matches(sentence, '{_NEGATED}')) as n_negated, count(sentence) as n from evidence group by field_name")
def negation_filter(spark, folder):
    rows = read(spark, folder, "tag_evidence").dropDuplicates(["evidence_id"])
    return rows.groupBy("field_name").agg(F.count_if(T.negated(F.col("sentence"))).alias("n_negated"), F.count("sentence").alias("n"))


#: Demonstration rules over the test labels.
RULES = [
    tagging.Rule("T06", ("dosage_and_administration", "warnings"), r"(?i)kidney (function|tests)", prefer=r"(?i)reduce"),
    tagging.Rule("T12", ("dosage_and_administration", "warnings", "boxed_warning"), r"(?i)liver (function|tests)"),
    tagging.Rule("T14", ("contraindications", "boxed_warning", "drug_interactions"), r"(?i)do not take", honour_negation=False),
    tagging.Rule("T16", ("contraindications", "drug_interactions"), r"(?i)low sodium", exclude=r"(?i)placebo"),
]
EDGES = [("T06", "T11"), ("T12", "T11"), ("T14", "T13"), ("T16", "T13")]


def _rule_sql(r: tagging.Rule) -> str:
    place = "case field_name " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(r.fields, 1)) + " end"
    late = f"case when regexp_matches(sentence, '{r.prefer}') then 0 else 1 end" if r.prefer else "0"
    tests = [f"regexp_matches(sentence, '{r.include}')", f"field_name in {r.fields}"]
    tests += [f"not regexp_matches(sentence, '{r.exclude}')"] * bool(r.exclude) + [f"not regexp_matches(sentence, '{_NEGATED}')"] * r.honour_negation
    return f"select label_id, '{r.term}' as term, field_name, sentence, {place} as place, {late} as late, evidence_id from evidence where {' and '.join(tests)}"


_TAGGED = f"{_EVIDENCE}, found as ({' union all '.join(map(_rule_sql, RULES))}), tags as (select label_id, term, arg_min(field_name, row(place, late, evidence_id)) as field_name, arg_min(sentence, row(place, late, evidence_id)) as sentence from found group by label_id, term)"
_EDGES = "edges(narrow, broad, edge) as (values " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(EDGES)) + ")"


def _tagged(spark, folder):
    rows = read(spark, folder, "tag_evidence").dropDuplicates(["evidence_id"])
    return tagging.tag(rows, RULES, "label_id", ["evidence_id"])


@query(f"with {_TAGGED} select * from tags")
def rule_tagging(spark, folder):
    return _tagged(spark, folder)


@query(f"with {_TAGGED}, {_EDGES}, wide as (select label_id, broad as term, arg_min(field_name, edge) as field_name, arg_min(sentence, edge) as sentence from tags join edges on term = narrow group by label_id, broad) select * from tags union all select * from wide")
def hierarchy_expand(spark, folder):
    return tagging.expand_hierarchy(_tagged(spark, folder), EDGES, "label_id", ["field_name", "sentence"])


@query("with have as (select distinct label_id, term_id as term from tag_evidence), edges(narrow, broad) as (values ('T10', 'T07'), ('T06', 'T11'), ('T12', 'T11'), ('T14', 'T13'), ('T15', 'T13'), ('T16', 'T13'), ('T17', 'T13')) select label_id, narrow, broad from have h join edges on term = narrow where not exists (select 1 from have b where b.label_id = h.label_id and b.term = broad)")
def hierarchy_violations(spark, folder):
    edges = [("T10", "T07"), ("T06", "T11"), ("T12", "T11"), ("T14", "T13"), ("T15", "T13"), ("T16", "T13"), ("T17", "T13")]
    return tagging.hierarchy_violations(read(spark, folder, "tag_evidence").withColumnRenamed("term_id", "term"), edges, "label_id")


@query(r"select doc_id, try_cast(regexp_extract(text, '([0-9]+(?:\.[0-9]+)?) ?%', 1) as double) as percent from documents where regexp_matches(text, '[0-9] ?%')")
def percent_in_prose(spark, folder):
    docs = read(spark, folder, "documents").where(F.col("text").rlike("[0-9] ?%"))
    return docs.select("doc_id", T.first_percent(F.col("text")).alias("percent"))


@query(r"select distinct rec_id, trim(regexp_replace(replace(replace(regexp_replace(text_fields, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) as plain from raw_label where text_fields like '%<table>%'")
def html_strip_text(spark, folder):
    rows = read(spark, folder, "raw_label").where("text_fields like '%<table>%'").dropDuplicates(["rec_id"])
    return rows.select("rec_id", T.strip_tags(F.col("text_fields")).alias("plain"))


@query("with e as (select distinct set_id, term_id, case field_name when 'contraindications' then 1 when 'boxed_warning' then 2 when 'warnings' then 3 when 'warnings_and_cautions' then 3 when 'precautions' then 3 when 'drug_interactions' then 4 end as tier from tag_evidence where set_id is not null) select set_id, term_id, min(tier) as tier from e group by all having min(tier) is not null")
def tier_min(spark, folder):
    rows = read(spark, folder, "tag_evidence").where("set_id is not null").select("set_id", "term_id", tagging.tier(F.col("field_name")).alias("tier"))
    return rows.groupBy("set_id", "term_id").agg(F.min("tier").alias("tier")).where("tier is not null")


# evaluation: terms as queries, sets of labels as documents, ranked by rows of evidence


_JUDGED = "e as (select distinct evidence_id, set_id, term_id, field_name from tag_evidence where set_id is not null), hit as (select term_id as query_id, set_id as doc_id, row_number() over (partition by term_id order by count(*) desc, set_id) as rank from e group by term_id, set_id), judged as (select term_id as query_id, set_id as doc_id, max(case field_name when 'boxed_warning' then 3 when 'contraindications' then 2 when 'warnings' then 1 else 0 end) as grade from e group by all), rel as (select * from judged where grade > 0)"


def _judged(spark, folder):
    e = read(spark, folder, "tag_evidence").where("set_id is not null").select("evidence_id", "set_id", "term_id", "field_name").dropDuplicates(["evidence_id"])
    keyed = e.groupBy(F.col("term_id").alias("query_id"), F.col("set_id").alias("doc_id"))
    grade = F.when(F.col("field_name") == "boxed_warning", 3).when(F.col("field_name") == "contraindications", 2).when(F.col("field_name") == "warnings", 1).otherwise(0)
    both = keyed.agg(F.count("*").alias("n"), F.max(grade).alias("grade"))
    hits = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id"))).select("query_id", "doc_id", "rank")
    return e.select(F.col("term_id").alias("query_id")), hits, both.select("query_id", "doc_id", "grade")


@query(f"""
with {_JUDGED}, f as (select hit.*, coalesce(grade, 0) as grade, case when grade is null then 0 else 1 end as rel from hit left join rel using (query_id, doc_id)),
r as (select *, sum(rel) over (partition by query_id order by rank) as so_far from f),
per as (select query_id, sum(case when rank <= 10 then rel else 0 end) as hits_k, sum(case when rel = 1 then so_far / rank else 0 end) as ap_sum, sum(case when rank <= 10 then grade / log2(rank + 1) else 0 end) as dcg from r group by query_id),
o as (select *, row_number() over (partition by query_id order by grade desc, doc_id) as k from rel),
ideal as (select query_id, count(*) as n_rel, sum(case when k <= 10 then grade / log2(k + 1) else 0 end) as idcg from o group by query_id)
select query_id, round(hits_k / 10.0, 6) as p_at_k, round(coalesce(hits_k / nullif(n_rel, 0), 0), 6) as r_at_k, round(coalesce(ap_sum / nullif(n_rel, 0), 0), 6) as ap, round(coalesce(dcg / nullif(idcg, 0), 0), 6) as ndcg_at_k
from per left join ideal using (query_id)""")
def ranking_measures(spark, folder):
    return evaluation.ranking_metrics(*_judged(spark, folder))


_PAIRS = "p as (select term_id, set_id, bool_or(field_name = 'drug_interactions') as predicted, bool_or(field_name in ('warnings', 'warnings_and_cautions')) as gold from tag_evidence where set_id is not null group by all), c as (select term_id, count(*) filter (where predicted and gold) as tp, count(*) filter (where predicted and not gold) as fp, count(*) filter (where not predicted and gold) as fn, count(*) filter (where not predicted and not gold) as tn from p group by term_id)"


def _counts(spark, folder):
    rows = read(spark, folder, "tag_evidence").where("set_id is not null")
    pairs = rows.groupBy("term_id", "set_id").agg(F.bool_or(F.col("field_name") == "drug_interactions").alias("predicted"), F.bool_or(F.col("field_name").isin("warnings", "warnings_and_cautions")).alias("gold"))
    return evaluation.confusion(pairs, "term_id", F.col("predicted"), F.col("gold"))


@query(f"with {_PAIRS} select * from c")
def confusion_matrix(spark, folder):
    return _counts(spark, folder)


@query(f"with {_PAIRS}, m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c) select term_id, tp, fp, fn, tn, round(p, 6) as prec, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from m")
def precision_recall_f1(spark, folder):
    return evaluation.precision_recall_f1(_counts(spark, folder))


@query(f"with {_PAIRS}, s as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn, sum(tn)::double as tn from c), k as (select tp + fp + fn + tn as n, (tp + tn) / (tp + fp + fn + tn) as o, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) as e from s) select n::bigint as n, round(o, 6) as observed, round(e, 6) as expected, round((o - e) / (1 - e), 6) as kappa from k")
def cohen_kappa(spark, folder):
    return evaluation.cohen_kappa(_counts(spark, folder))


# lists: an order is a list, a line its entry, the part's brand and type its tags


def _entries(spark, folder):
    lines = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("entry"), F.col("l_quantity").alias("amount"))
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("entry"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    return lines.join(parts, "entry")


_LISTS = "e as (select l_orderkey as list_id, l_partkey as entry, l_quantity as amount, p_brand as brand, p_type as type, p_size as size from lineitem join part on l_partkey = p_partkey)"


@query("with a as (select distinct * from entry_amount), m as (select distinct med_id, list_id from medication_row) select list_id, ingredient, unit, period, round(sum(amount), 6) as total, count(amount) as n, array_to_string(list_sort(list_filter(list(display_name), lambda x: x is not null)), ',') as names, coalesce(bool_or(as_needed), false) as any_flag from a join m using (med_id) group by all")
def molecule_totals(spark, folder):
    amounts = read(spark, folder, "entry_amount").dropDuplicates(["amount_id"])
    rows = read(spark, folder, "medication_row").select("med_id", "list_id").dropDuplicates(["med_id"])
    return lists.totals(amounts.join(rows, "med_id"), ["list_id", "ingredient", "unit", "period"], "amount", "display_name", "as_needed")


@query(f"with {_LISTS}, t as (select list_id, entry, max(size) as size, sum(amount) as total from e group by all) select list_id, entry, round(total, 6) as total, case when total > size * 1.005 then 'above' else 'at' end as verdict from t where total >= size * 0.995")
def dose_ceiling(spark, folder):
    t = _entries(spark, folder).groupBy("list_id", "entry").agg(F.max("size").alias("size"), F.sum("amount").alias("total"))
    return t.select("list_id", "entry", F.round("total", 6).alias("total"), lists.ceiling(F.col("total"), F.col("size")).alias("verdict")).where("verdict is not null")


@query(f"with {_LISTS} select list_id, brand, count(distinct entry) as n_entries, min(size) as least_rank from e group by all having count(distinct entry) >= 2")
def group_alerts(spark, folder):
    return lists.shared_tags(_entries(spark, folder), "list_id", "entry", "brand", F.col("size"))


_RULE_SQL = "rules(rule, side_a, side_b) as (values ('r1', 'Brand#11', 'Brand#12'), ('r2', 'Brand#21', 'Brand#34'), ('r3', 'Brand#45', 'Brand#45')), hit as (select distinct a.list_id, rule, a.entry as a, b.entry as b from e a join rules on a.brand = side_a join e b on b.list_id = a.list_id and b.brand = side_b where a.entry <> b.entry)"
_RULE_ROWS = [("r1", "Brand#11", "Brand#12"), ("r2", "Brand#21", "Brand#34"), ("r3", "Brand#45", "Brand#45")]


def _pairs(spark, folder):
    return lists.rule_pairs(_entries(spark, folder), spark.createDataFrame(_RULE_ROWS, "rule string, side_a string, side_b string"), "list_id", "entry", "brand")


@query(f"with {_LISTS}, {_RULE_SQL} select * from hit")
def pair_alerts(spark, folder):
    return _pairs(spark, folder)


@query(f"with {_LISTS}, {_RULE_SQL} select list_id, rule, a, count(distinct b) as n_others, min(b) as first_other from hit group by all")
def pair_merge_victim(spark, folder):
    return _pairs(spark, folder).groupBy("list_id", "rule", "a").agg(F.countDistinct("b").alias("n_others"), F.min("b").alias("first_other"))


@query(f"with {_LISTS}, {_RULE_SQL}, r as (select *, row_number() over (partition by list_id, least(a, b), greatest(a, b) order by rule desc, a) as n from hit) select list_id, rule, a, b from r where n = 1")
def pair_dedupe(spark, folder):
    return lists.strongest(_pairs(spark, folder), ["list_id", F.least("a", "b"), F.greatest("a", "b")], [F.desc("rule"), F.col("a")])


@query("select l_orderkey as list_id, l_partkey as entry, count(*) as n_lines, count(*) * (count(*) - 1) // 2 as n_pairs from lineitem group by all having count(*) > 1")
def duplicate_entries(spark, folder):
    lines = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("entry")).agg(F.count("*").alias("n_lines"))
    return lines.where("n_lines > 1").withColumn("n_pairs", F.expr("n_lines * (n_lines - 1) div 2"))


_CLASSES = [("all", "@metal"), ("all", "@red"), ("metal", "copper"), ("metal", "@bright"), ("bright", "silver"), ("bright", "@metal"), ("red", "rose"), ("red", "light red")]
_CLASS_SQL = "members(class, member) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _CLASSES) + "), links as (select class, substr(member, 2) as inner_class from members where member like '@%')"


@query(f"with recursive {_CLASS_SQL}, reach(class, inner_class) as (select * from links union select r.class, l.inner_class from reach r join links l on r.inner_class = l.class) select class, member from members where member not like '@%' union select r.class, m.member from reach r join members m on r.inner_class = m.class where m.member not like '@%'")
def class_closure(spark, folder):
    return lists.closure(spark.createDataFrame(_CLASSES, "class string, member string"))


@query("with m as (select distinct string_split(p_name, ' ')[1] as member, p_type as class from part where p_size <= 10) select distinct p_name, class from part join m on p_name = member or starts_with(p_name, member || ' ')")
def class_prefix_membership(spark, folder):
    parts = read(spark, folder, "part")
    members = parts.where("p_size <= 10").select(F.split("p_name", " ")[0].alias("member"), F.col("p_type").alias("class")).distinct()
    return lists.prefix_members(parts, members, "p_name")


@query(f"""
with recursive {_LISTS}, n as (select distinct list_id, entry, type from e),
edge as (select distinct a.list_id, a.entry as a, b.entry as b from n a join n b on a.list_id = b.list_id and a.type = b.type),
reach(list_id, a, b) as (select * from edge union select r.list_id, r.a, x.b from reach r join edge x on r.list_id = x.list_id and r.b = x.a)
select list_id, a as entry, min(b) as component from reach group by list_id, a""")
def list_components(spark, folder):
    return lists.connected(_entries(spark, folder), "list_id", "entry", "type")


# names and free text


@query(r"select distinct med_id, name_id from medication_row join name_dictionary on lower(trim(regexp_replace(matched_name, '\s+', ' ', 'g'))) = name_key")
def exact_name_join(spark, folder):
    rows = read(spark, folder, "medication_row").select("med_id", resolve.normal(F.col("matched_name")).alias("name_key")).distinct()
    return rows.join(read(spark, folder, "name_dictionary").select("name_key", "name_id"), "name_key").select("med_id", "name_id")


@query()
def fuzzy_name_join(spark, folder):
    """Status, set and candidates of every distinct name; tests/test_resolve.py compares with all pairs."""
    typed = read(spark, folder, "medication_row").select(F.col("matched_name").alias("name")).where("name is not null")
    found = resolve.local_matches(typed, read(spark, folder, "name_dictionary"))
    return found.select("name", "status", "matched_name", F.array_join("ingredient_set", "|").alias("set_key"), F.round("score", 6).alias("score"), "reason", "candidates")


_STRENGTH = r"([0-9]+(?:[.,][0-9]+)*) ?(mg|mcg|g|mL|units|IU|mEq)\b"


@query(rf"with m as (select distinct med_id, as_entered from medication_row) select med_id, regexp_extract(as_entered, '{_STRENGTH}', 1) as amount, regexp_extract(as_entered, '{_STRENGTH}', 2) as unit, case when regexp_matches(as_entered, '(?i)\b(three times|tid|x 3)\b') then 3 when regexp_matches(as_entered, '(?i)\b(twice|bid|2 times|every 12 hours)\b') then 2 when regexp_matches(as_entered, '(?i)\b(once|daily|bedtime|morning)\b') then 1 end as per_day from m")
def strength_frequency_parse(spark, folder):
    rows = read(spark, folder, "medication_row").select("med_id", "as_entered").distinct()
    t = F.col("as_entered")
    per_day = F.when(t.rlike(r"(?i)\b(three times|tid|x 3)\b"), 3).when(t.rlike(r"(?i)\b(twice|bid|2 times|every 12 hours)\b"), 2).when(t.rlike(r"(?i)\b(once|daily|bedtime|morning)\b"), 1)
    return rows.select("med_id", F.regexp_extract(t, _STRENGTH, 1).alias("amount"), F.regexp_extract(t, _STRENGTH, 2).alias("unit"), per_day.alias("per_day"))


@query(r"with p as (select distinct result_id, medications from patient_result where medications is not null), s as (select result_id, trim(unnest(regexp_split_to_array(medications, '[,;\n]'))) as item, generate_subscripts(regexp_split_to_array(medications, '[,;\n]'), 1) as pos from p) select result_id, pos::int as pos, item from s where item <> ''")
def list_split_entries(spark, folder):
    rows = read(spark, folder, "patient_result").where("medications is not null").select("result_id", "medications").distinct()
    return rows.select("result_id", F.posexplode(F.split("medications", r"[,;\n]")).alias("n", "raw")).select("result_id", (F.col("n") + 1).alias("pos"), F.trim("raw").alias("item")).where("item <> ''")


@query(r"with a as (select distinct row_id, upper(trim(regexp_replace(unnest(ingredient_set), '[\s\x{a0}]+', ' ', 'g'))) as s from label_summary), b as (select row_id, s, case when regexp_matches(s, ' (SODIUM|HYDROCHLORIDE|MALEATE|TARTRATE|SULFATE)$') then regexp_replace(s, ' [A-Z]+$', '') else s end as base from a where s <> '') select base, count(distinct s) as n_forms, count(distinct row_id) as n_labels from b group by base")
def salt_rollup(spark, folder):
    names = read(spark, folder, "label_summary").select("row_id", F.explode("ingredient_set").alias("raw")).select("row_id", F.upper(T.collapse(F.col("raw"))).alias("s")).where("s <> ''").distinct()
    base = F.regexp_replace("s", " (SODIUM|HYDROCHLORIDE|MALEATE|TARTRATE|SULFATE)$", "")
    return names.groupBy(base.alias("base")).agg(F.countDistinct("s").alias("n_forms"), F.countDistinct("row_id").alias("n_labels"))


@query("""
with a as (select distinct row_id, upper(trim(unnest(ingredient_set))) as s from label_summary), k as (select row_id, string_agg(distinct s, '|' order by s) as set_key from a where s <> '' group by row_id),
d as (select name_id, unnest(unnest(ingredient_sets)) as s, generate_subscripts(ingredient_sets, 1) as n from name_dictionary),
w as (select name_id, n, string_agg(distinct upper(trim(s)), '|' order by upper(trim(s))) as set_key from (select name_id, generate_subscripts(ingredient_sets, 1) as n, unnest(ingredient_sets) as one from name_dictionary) x, unnest(one) u(s) group by all)
select distinct row_id, name_id from k join w using (set_key)""")
def set_equality_join(spark, folder):
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(F.trim(x))), lambda x: x != ""))), "|")
    labels = read(spark, folder, "label_summary").select("row_id", key(F.col("ingredient_set")).alias("set_key")).where("set_key <> ''")
    names = read(spark, folder, "name_dictionary").select("name_id", F.explode("ingredient_sets").alias("one")).select("name_id", key(F.col("one")).alias("set_key"))
    return labels.join(names, "set_key").select("row_id", "name_id").distinct()


@query(r"with a as (select lower(trim(regexp_replace(unnest(brand_names), '[\s\x{a0}]+', ' ', 'g'))) as n from label_summary), b as (select lower(trim(regexp_replace(matched_name, '[\s\x{a0}]+', ' ', 'g'))) as n from medication_row), x as (select distinct n from a where n is not null), y as (select distinct n from b where n is not null) select 'labels' as side, n from (select n from x except select n from y) union all select 'lists', n from (select n from y except select n from x)")
def signature_difference(spark, folder):
    a = read(spark, folder, "label_summary").select(F.explode("brand_names").alias("n")).select(F.lower(T.collapse(F.col("n"))).alias("n")).where("n is not null")
    b = read(spark, folder, "medication_row").select(F.lower(T.collapse(F.col("matched_name"))).alias("n")).where("n is not null")
    return a.subtract(b).select(F.lit("labels").alias("side"), "n").union(b.subtract(a).select(F.lit("lists").alias("side"), "n"))


@query("with a as (select ingredient, count(distinct amount_id) as n from entry_amount where recorded_at < timestamp '2025-01-01' group by ingredient), b as (select ingredient, count(distinct amount_id) as n from entry_amount where recorded_at >= timestamp '2025-01-01' group by ingredient) select coalesce(a.ingredient, b.ingredient) as ingredient, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.ingredient = b.ingredient where coalesce(b.n, 0) <> coalesce(a.n, 0)")
def run_diff_outer_join(spark, folder):
    rows = read(spark, folder, "entry_amount")
    cut = F.lit("2025-01-01").cast("timestamp")
    side = lambda c, n: rows.where(c).groupBy("ingredient").agg(F.countDistinct("amount_id").alias(n))
    both = side(F.col("recorded_at") < cut, "a").join(side(F.col("recorded_at") >= cut, "b"), "ingredient", "full")
    return both.select("ingredient", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta")).where("delta <> 0")


# entries and relations


_UNITS_SQL = "mcg/hr?|mg|mcg|g|ml|meq|units?|%"
_DAILY_SQL = r"(?:a\s*|per\s*|/\s*)?(?:daily|day|d\b)"


def _first_of(text: str, *patterns: str) -> str:
    """SQL for what the first pattern that occurs says (patterns with one group, and what it stands for)."""
    return "case " + " ".join(f"when regexp_matches({text}, '(?i){p}') then {value.format(x=f"regexp_extract({text}, '(?i){p}', 1)")}" for p, value in patterns) + " end"


_WORDS_SQL = "case lower({x}) when 'once' then 1.0 when 'twice' then 2.0 when 'three times' then 3.0 when 'four times' then 4.0 when 'qd' then 1.0 when 'bid' then 2.0 when 'tid' then 3.0 when 'qid' then 4.0 when 'qhs' then 1.0 end"
_OFTEN_SQL = _first_of(
    "rest",
    (r"\bx\s*([0-9]+)\s*(?:times\s*)?" + _DAILY_SQL, "{x}::double"),
    (r"\b([0-9]+)\s*(?:times|time|x)\s*" + _DAILY_SQL, "{x}::double"),
    (r"\b(once|twice|three times|four times)\s*" + _DAILY_SQL, _WORDS_SQL),
    (r"\b(qd|bid|tid|qid|qhs)\b", _WORDS_SQL),
    (r"\b(?:every|q)\s*([0-9]+)\s*(?:hours|hrs|hr|h)\b", "24.0 / {x}::double"),
    (r"\bx\s*(daily|day)\b", "1.0"),
    (r"\b(?:once\s+|twice\s+)?(weekly|every\s+week|each\s+week|once\s+a\s+week|q\s*week|q7d)\b", "null::double"),
    (r"\b(daily|once a day|every day)\b", "1.0"),
)


@query(rf"""
with m as (select distinct med_id, as_entered as t from medication_row),
s as (select *, regexp_extract(t, '(?i)(?:^|[^\w.])([0-9]+(?:\.[0-9]+)?)\s*({_UNITS_SQL})(?:$|[^a-z])', ['value', 'unit']) as x, regexp_replace(t, '(?i)(^|[^\w.])[0-9]+(?:\.[0-9]+)?\s*(?:{_UNITS_SQL})($|[^a-z])', '\1 \2') as rest from m where not regexp_matches(t, '[0-9]\s*(?:{_UNITS_SQL})?\s*/\s*[0-9]|[=()]')),
f as (select *, {_OFTEN_SQL} as times_per_day, try_cast(x.value as double) as strength_value, nullif(lower(x.unit), '') as u, regexp_matches(t, '(?i)\b(?:as\s+needed|prn|as\s+necessary)\b') as as_needed from s)
select med_id, strength_value, case u when 'ml' then 'mL' when 'meq' then 'mEq' when 'mcg/hr' then 'mcg/h' when 'unit' then 'units' else u end as strength_unit, times_per_day,
  case when u in ('mcg/h', 'mcg/hr') then strength_value else strength_value * times_per_day end as daily_total, as_needed from f""")
def entry_doses(spark, folder):
    """Entries without a combination, a stated total or brackets: strength, frequency and total of the parser."""
    rows = read(spark, folder, "medication_row").select("med_id", "as_entered").distinct().where(~F.col("as_entered").rlike(r"(?i)[0-9]\s*(?:mcg/hr?|mg|mcg|g|ml|meq|units?|%)?\s*/\s*[0-9]|[=()]"))
    return entries.parse_entries(rows, "as_entered").select("med_id", *[F.col(f"parsed.{c}") for c in ("strength_value", "strength_unit", "times_per_day", "daily_total", "as_needed")])


@query()
def entry_parse(spark, folder):
    """Everything that an entry says; tests/test_entries.py holds the golden values."""
    rows = read(spark, folder, "medication_row").select("med_id", "as_entered").distinct()
    return entries.parse_entries(rows, "as_entered").select("med_id", "parsed.*")


@query()
def list_entries(spark, folder):
    rows = read(spark, folder, "patient_result").select("result_id", "medications").distinct()
    return entries.split_lists(rows, "medications")


@query(f"with m as (select distinct med_id, list_id, lower(matched_name) as name from medication_row where matched_name is not null), w as (select distinct list_id, med_id as a, unnest({_WORDS.replace('text', 'as_entered')}) as word from medication_row) select distinct w.list_id, a, med_id as b from w join m on m.list_id = w.list_id and m.name = word where a <> med_id")
def mentioned_pairs(spark, folder):
    rows = read(spark, folder, "medication_row").dropDuplicates(["med_id"])
    return relations.mentioned_pairs(rows.where("matched_name is not null"), rows, "list_id", "med_id", "matched_name", "as_entered")


_LINKS = [("Brand#11", "Brand#22"), ("Brand#33", "Brand#44")]


@query(f"with {_LISTS}, links(one, other) as (values ('brand#11', 'brand#22'), ('brand#33', 'brand#44'), ('brand#22', 'brand#11'), ('brand#44', 'brand#33')) select distinct x.list_id, x.entry as a, y.entry as b from e x join links on lower(x.brand) = one join e y on y.list_id = x.list_id and lower(y.brand) = other where x.entry < y.entry")
def linked_pairs(spark, folder):
    links = spark.createDataFrame([(a.lower(), b.lower()) for a, b in _LINKS], "one string, other string")
    return relations.linked_pairs(_entries(spark, folder), links, "list_id", "entry", "brand")


_FINDINGS = f"{_LISTS}, {_RULE_SQL}, small as (select list_id, rule || ':' || a || ':' || b as pair_id, unnest([a, b]) as member from hit), large as (select distinct list_id, type as group_id, entry as member from e)"


@query(f"with {_FINDINGS}, size as (select list_id, pair_id, count(distinct member) as n from small group by all), met as (select s.list_id, pair_id, group_id, count(distinct s.member) as m from small s join large l on l.list_id = s.list_id and l.member = s.member group by all) select list_id, pair_id, min(group_id) as group_id from met join size using (list_id, pair_id) where m = n group by all")
def absorb_pairs(spark, folder):
    pairs = _pairs(spark, folder).select("list_id", F.concat_ws(":", "rule", "a", "b").alias("pair_id"), F.explode(F.array("a", "b")).alias("member"))
    groups = _entries(spark, folder).select("list_id", F.col("type").alias("group_id"), F.col("entry").alias("member"))
    return relations.first_home(pairs, groups, ["list_id"], "pair_id", "group_id", "member", F.col("group_id"))


@query(f"with {_LISTS} select distinct x.list_id from e x join e y on x.list_id = y.list_id where x.brand in ('Brand#11', 'Brand#12') and y.brand in ('Brand#12', 'Brand#13') and x.entry <> y.entry")
def distinct_sides(spark, folder):
    e = _entries(spark, folder)
    return relations.distinct_sides(e.where("brand in ('Brand#11', 'Brand#12')"), e.where("brand in ('Brand#12', 'Brand#13')"), ["list_id"], "entry")


@query("with e as (select distinct evidence_id, label_id, set_id, term_id, sentence from tag_evidence), own as (select label_id, term_id, arg_max(sentence, evidence_id) as s from e where sentence is not null group by all), sets as (select set_id, term_id, arg_min(sentence, evidence_id) as s from e where sentence is not null and set_id is not null group by all) select k.label_id, k.set_id, k.term_id, coalesce(own.s, sets.s) as sentence from (select distinct label_id, set_id, term_id from e) k left join own on own.label_id = k.label_id and own.term_id = k.term_id left join sets on sets.set_id = k.set_id and sets.term_id = k.term_id")
def evidence_fallback(spark, folder):
    e = read(spark, folder, "tag_evidence").select("evidence_id", "label_id", "set_id", "term_id", "sentence").distinct()
    order = F.col("evidence_id")
    keys = e.select("label_id", "set_id", "term_id").distinct()
    return relations.first_of(keys, [(e, ["label_id", "term_id"], order, True), (e.where("set_id is not null"), ["set_id", "term_id"], order, False)], "sentence")


@query(f"with {_EVIDENCE}, s as (select label_id, evidence_id, unnest({_PLAIN}) as s, generate_subscripts({_PLAIN}, 1) as n from evidence where field_name = 'indications_and_usage' and sentence is not null), k as (select *, row_number() over (partition by label_id order by evidence_id, n) as r from (select label_id, s, min(evidence_id) as evidence_id, arg_min(n, row(evidence_id, n)) as n from s where length(s) between 20 and 420 group by label_id, s)) select label_id, r::int as place, s as sentence from k where r <= 3")
def profile_sentences(spark, folder):
    e = read(spark, folder, "tag_evidence").where("field_name = 'indications_and_usage'").dropDuplicates(["evidence_id"])
    s = e.select("label_id", "evidence_id", F.posexplode(T.plain_sentences(F.col("sentence"))).alias("n", "s")).where(F.length("s").between(20, 420))
    first = s.groupBy("label_id", "s").agg(F.min(F.struct("evidence_id", "n")).alias("at"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("label_id").orderBy("at")))
    return ranked.where("place <= 3").select("label_id", "place", F.col("s").alias("sentence"))


@query("with t as (select field_name, count(distinct evidence_id) as n from tag_evidence group by field_name), f(field_name, grade) as (values ('contraindications', 'A'), ('boxed_warning', 'B'), ('warnings', 'C'), ('precautions', 'D')) select f.field_name, grade, coalesce(n, 0) as n from f left join t using (field_name)")
def grade_histogram(spark, folder):
    grades = spark.createDataFrame([("contraindications", "A"), ("boxed_warning", "B"), ("warnings", "C"), ("precautions", "D")], "field_name string, grade string")
    seen = read(spark, folder, "tag_evidence").groupBy("field_name").agg(F.countDistinct("evidence_id").alias("n"))
    return grades.join(seen, "field_name", "left").na.fill(0, ["n"])


@query()
def html_table_cells(spark, folder):
    rows = read(spark, folder, "raw_label").dropDuplicates(["rec_id"]).select("rec_id", F.explode(F.regexp_extract_all("text_fields", F.lit(r"<table>.*?</table>"), F.lit(0))).alias("html"))
    return markup.html_cells(rows, "html")


@query(r"with s as (select unnest(ingredient_set) as n from label_summary union all select unnest(generic_names) from label_summary union all select display from name_dictionary), c as (select lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '\s*\[[A-Za-z]+\]\s*$', ''), '\s*\(\s*\w?(\s*,\s*\w?)*\s*\)', '', 'g'), '[0-9^*]', '', 'g'), '[\s\x{a0}]+', ' ', 'g'))) as name from s) select distinct name from c where length(name) >= 3")
def gazetteer(spark, folder):
    labels, names = read(spark, folder, "label_summary"), read(spark, folder, "name_dictionary")
    return markup.known_names(labels.select(F.explode("ingredient_set").alias("n")), labels.select(F.explode("generic_names").alias("n")), names.select("display"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def event_windows(spark, folder):
    return incremental.windowed_counts(read(spark, folder, "events"), "ts", "1 day", "1 hour", "event_type")


@query("select user_id, event_type, arg_max(event_id, row(ts, event_id)) as event_id, count(*) as n from events group by all")
def newest_event(spark, folder):
    events = read(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    newest = collect.newest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])
    return newest.join(events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "n")
