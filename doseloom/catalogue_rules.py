"""Queries of the rule, amount, rollup, index, ordering and source operators over the test tables, each beside its SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import _BM25, _EVIDENCE, _FIXED_SQL, _NEGATED, _PLAIN, _POSTED, SQL, _asked, _counts, _judged, query, read
from .functions import text as T
from .functions.lineage import checkpoint_folder
from .operators import amounts, checks, collect, evaluation, index, orders, records, reports, rollup, tagging, vocabulary
from .queries import SQL as GENERAL_SQL
from .queries import label_values
from .sources import files, sinks
from .streaming import incremental

FIXTURES = Path(__file__).resolve().parents[1] / "tests" / "fixtures"


def _rows(table: str, rows, columns: str) -> str:
    """SQL for a table of fixed rows."""
    show = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"[{', '.join(show(y) for y in x)}]" if isinstance(x, (list, tuple)) else str(x).lower() if isinstance(x, bool) else repr(x)
    return f"{table}({columns}) as (values {', '.join('(' + ', '.join(show(x) for x in r) + ')' for r in rows)})"


# tags


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "tag_evidence").dropDuplicates(["evidence_id"])


def _rule_sql(r: tagging.Rule) -> str:
    place = "case field_name " + " ".join(f"when '{f}' then {i}" for i, f in enumerate(r.fields, 1)) + " end"
    late = f"case when regexp_matches(s, '{r.prefer}') then 0 else 1 end" if r.prefer else "0"
    rank = "case " + " ".join(f"when regexp_matches(s, '{p}') then {i}" for i, p in enumerate(r.ranked)) + " else 9 end" if r.ranked else "0"
    tests = [f"field_name in ({', '.join(repr(f) for f in r.fields)})", f"regexp_matches(s, '{r.include}')", f"not regexp_matches(s, '{_NEGATED}')"]
    tests += [f"regexp_matches(s, '{r.also}')"] * bool(r.also) + [f"(not regexp_matches(s, '{r.exclude}')" + (f" or regexp_matches(s, '{r.unless}'))" if r.unless else ")")] * bool(r.exclude)
    tests += [r"regexp_extract(s, '([0-9]+(?:\.[0-9]+)?)\s*%', 1)::double >= 10"] * (r.term == "T04")
    said = r"trim(regexp_replace(regexp_replace(s, '^\s*(?:\(\s*\d+(?:\.\d+)*\s*\)\s*)+(?:•\s*)?', ''), '^\s*\d*\s*(?:WARNINGS AND PRECAUTIONS|WARNINGS AND CAUTIONS|DRUG INTERACTIONS|CONTRAINDICATIONS|PRECAUTIONS|WARNINGS|BOXED WARNING)\s+', ''))" if r.bare else "s"
    return f"select label_id, '{r.term}' as term, field_name, {said} as sentence, {place} as place, {rank} as rank, {late} as late, evidence_id, n from sentences where {' and '.join(tests)}"


_SENTENCES = f"{_EVIDENCE}, sentences as (select label_id, evidence_id, field_name, unnest({_PLAIN}) as s, generate_subscripts({_PLAIN}, 1) as n from evidence where sentence is not null and label_id is not null)"
#: The rules of the vocabulary, and demonstration rules for the sections and words that the test texts have.
TEXT_RULES = [*vocabulary.TEXT_RULES, tagging.Rule("X01", ("warnings", "boxed_warning"), "(?i)low sodium", also="(?i)hold", prefer="(?i)restart", bare=True), tagging.Rule("X02", ("contraindications", "drug_interactions"), "(?i)do not take|kidney|liver", exclude="(?i)avoid|do not", unless="(?i)[0-9] ?mg", ranked=("(?i)kidney", "(?i)liver"))]


@query(f"with {_SENTENCES}, found as ({' union all '.join(_rule_sql(r) for r in TEXT_RULES)}) select label_id, term, arg_min(field_name, row(place, rank, late, evidence_id, n)) as field_name, arg_min(sentence, row(place, rank, late, evidence_id, n)) as sentence from found group by label_id, term")
def label_terms(spark, folder):
    rows = _evidence(spark, folder).where("label_id is not null").select("label_id", "evidence_id", "field_name", F.posexplode(T.plain_sentences(F.col("sentence"))).alias("n", "sentence"))
    return tagging.tag(rows, TEXT_RULES, "label_id", ["evidence_id", "n"])


@query("""
with once as (select distinct row_id, ingredient_set, brand_names, generic_names from label_summary),
b as (select row_id, coalesce(ingredient_set, []) as i, coalesce(brand_names, []) as b, coalesce(generic_names, []) as g from once)
select row_id, 'T08' as term, 'openfda.substance_name' as field_name, i[1] as sentence from b where len(i) = 1
union all select row_id, 'T09', 'openfda.brand_name', 'brand_name=' || array_to_string(b, ', ') || '; generic_name=' || array_to_string(g, ', ') from b where len(list_filter(b, lambda x: not list_contains(list_transform(g, lambda y: lower(y)), lower(x)))) > 0""")
def name_terms(spark, folder):
    once = read(spark, folder, "label_summary").select("row_id", "ingredient_set", "brand_names", "generic_names").distinct()
    none = F.lit(None).cast("array<string>")
    return vocabulary.name_tags(once.withColumn("route", none).withColumn("application", none), "row_id", "route", "ingredient_set", "brand_names", "generic_names", "application")


@query(f"with {_EVIDENCE}, b as (select label_id, evidence_id, trim(sentence) as t, {_PLAIN}[1] as first from evidence where field_name = 'boxed_warning' and trim(coalesce(sentence, '')) <> '') select label_id, 'T01' as term, 'boxed_warning' as field_name, min(coalesce(first, t)) as sentence from b group by label_id")
def boxed_terms(spark, folder):
    sections = _evidence(spark, folder).select("label_id", "field_name", F.col("sentence").alias("text"))
    return vocabulary.presence_tags(sections, "label_id")


@query()
def partner_terms(spark, folder):
    """Known names in the sentences that forbid; tests/test_vocabulary.py holds the cases."""
    rows = _evidence(spark, folder).where("sentence is not null").select("evidence_id", "sentence")
    names = read(spark, folder, "name_dictionary").select(F.lower("name_key").alias("name"))
    return vocabulary.mentions(rows, "sentence", names).where("size(mentioned) > 0").select("evidence_id", F.array_join("mentioned", ",").alias("mentioned"))


@query("with s as (select distinct evidence_id, sentence, field_name from tag_evidence) select evidence_id, case when coalesce(sentence, '') = '' then null when field_name = 'contraindications' then 'E' when field_name = 'boxed_warning' then 'D' when regexp_matches(sentence, '(?i)\\b(avoid\\w*|not recommended|(do|must|should) not (be )?(use|used|take|taken|co-?administer\\w*|combine\\w*))\\b') and regexp_matches(sentence, '(?i)\\b(concomitant\\w*|combination\\w*|combined|co-?administ\\w*|together|with other|in combination)\\b') then 'D' when field_name in ('warnings', 'warnings_and_cautions', 'precautions') then 'C' when field_name = 'drug_interactions' then case when regexp_matches(sentence, '(?i)\\b(monitor\\w*|caution\\w*|closely|dose (reduction|adjustment)|(reduce|adjust|lower|decrease)\\w* (the )?(dose|dosage))\\b') then 'B' else 'A' end end as grade from s")
def member_grades(spark, folder):
    rows = _evidence(spark, folder)
    return rows.select("evidence_id", checks.member_grade(F.col("field_name"), F.col("sentence"), F.lit("pair")).alias("grade"))


@query(f"with s as (select distinct evidence_id, sentence from tag_evidence where sentence is not null), p as (select *, strpos(sentence, '.') as dot from s) select evidence_id, dot::int as dot, regexp_matches(substr(sentence, greatest(dot - 120, 0)::bigint + 1, least(dot, 120)::bigint), '{_NEGATED}') as near from p where dot > 0")
def negation_near(spark, folder):
    rows = read(spark, folder, "tag_evidence").select("evidence_id", "sentence").distinct().withColumn("dot", F.position(F.lit("."), F.col("sentence")))
    return rows.where("dot > 0").select("evidence_id", "dot", T.negated_near(F.col("sentence"), F.col("dot")).alias("near"))


@query(r"with d as (select doc_id, text from documents where text is not null), x as (select doc_id, regexp_extract_all(text, '\(([0-9]+(?:\.[0-9]+)?)\s*%?\)', 1) as a, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s*%', 1) as b from d) select doc_id, try_cast(coalesce(a[-1], b[-1]) as double) as percent from x where coalesce(a[-1], b[-1]) is not null")
def last_percent(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", T.cell_percent(F.col("text")).alias("percent"))
    return docs.where("percent is not null")


# rules over lists: an order is a list, a part its entry, its brand the ingredient, demonstration classes of brands


_CLASSES = [("c1", f"brand#1{i}") for i in range(1, 6)] + [("c2", f"brand#2{i}") for i in range(1, 6)] + [("c3", "brand#11"), ("c3", "brand#21"), ("c3", "brand#31"), ("c4", "brand#44")]
_ENTRIES = "e as (select distinct l_orderkey as list_id, l_partkey as pos, lower(p_brand) as base, l_quantity as q from lineitem join part on l_partkey = p_partkey)"
_OF = f"{_ENTRIES}, {_rows('m', _CLASSES, 'class, member')}, c as (select distinct list_id, pos, base, class from e join m on base = member)"


def _list_entries(spark, folder):
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("base"))
    return read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("pos"), F.col("l_quantity").alias("q")).join(parts, "pos")


def _members(spark):
    return spark.createDataFrame(_CLASSES, "class string, member string")


_GROUPS = [
    checks.GroupRule("g1", ("c1",), "C", "one", "k", escalate=(checks.Condition("D", min_members=3), checks.Condition("E", has=("c3", "c1"), min_members=3))),
    checks.GroupRule("g2", ("c1", "c2"), "B", "two", "k", min_members=3, anchor="c3", require_any=("c2",)),
    checks.GroupRule("g3", ("c2", "c4"), "A", "two", "k", all_distinct=("c2", "c4"), conditions=(checks.Condition("D", count_of="c2", least=2), checks.Condition("B"))),
]


@query(f"""
with {_OF}, n as (select list_id, count(distinct base) filter (where class = 'c1') as n1, count(distinct base) filter (where class = 'c2') as n2, count(distinct base) filter (where base = 'brand#11') as n3, count(distinct base) filter (where base in ('brand#11', 'brand#21')) as n3b, count(distinct base) filter (where class = 'c4') as n4, count(distinct base) filter (where class in ('c1', 'c2')) as n12, count(distinct base) filter (where class in ('c2', 'c4')) as n24 from c group by list_id)
select list_id, 'g1' as rule, 'one' as family, 'k' as category, n1 as medicines, case when n1 >= 3 and n3 >= 1 then 'E' when n1 >= 3 then 'D' else 'C' end as grade from n where n1 >= 2
union all select list_id, 'g2', 'two', 'k', n12, 'B' from n where n12 >= 3 and n3b > 0 and n2 > 0
union all select list_id, 'g3', 'two', 'k', n24, case when n2 >= 2 then 'D' else 'B' end from n where n24 >= 2 and n2 >= 1 and n4 >= 1""")
def group_rule_alerts(spark, folder):
    return checks.group_alerts(_list_entries(spark, folder), _members(spark), _GROUPS)


_PAIRS = [checks.PairRule("p1", ("c1",), ("c2",), "C", "one", "k", exclude_b=("brand#25",), over_grade="D", caps={"brand#21": 30.0, "brand#22": 0}), checks.PairRule("p2", ("c4",), ("c1", "c3"), "B", "two", "k", over_grade="E", cap_a=40.0)]
_PAIR_SQL = f"""{_OF}, dose as (select list_id, base, sum(q) as mg from e group by all),
p1 as (select distinct a.list_id, 'p1' as rule, 'one' as family, 'k' as category, a.base as victim, b.base as b, case when b.base = 'brand#22' or (b.base = 'brand#21' and mg > 30) then 'D' else 'C' end as grade from c a join c b on a.list_id = b.list_id and a.class = 'c1' and b.class = 'c2' and b.base <> 'brand#25' and a.base <> b.base left join dose d on d.list_id = a.list_id and d.base = a.base),
p2 as (select distinct a.list_id, 'p2' as rule, 'two' as family, 'k' as category, a.base as victim, b.base as b, case when mg > 40 then 'E' else 'B' end as grade from c a join c b on a.list_id = b.list_id and a.class = 'c4' and b.class in ('c1', 'c3') and a.base <> b.base left join dose d on d.list_id = a.list_id and d.base = a.base),
hits as (select list_id, rule, family, category, victim, array_to_string(list_sort(list(b)), '|') as perpetrators, max(grade) as grade from (select * from p1 union all select * from p2) group by list_id, rule, family, category, victim)"""


def _pair_alerts(spark, folder):
    e = _list_entries(spark, folder)
    dose = e.distinct().groupBy("list_id", "base").agg(F.sum("q").alias("mg"))
    return checks.pair_alerts(e, _members(spark), _PAIRS, dose)


@query(f"with {_PAIR_SQL} select * from hits")
def pair_rule_alerts(spark, folder):
    return _pair_alerts(spark, folder).withColumn("perpetrators", F.array_join("perpetrators", "|"))


@query(f"with {_PAIR_SQL}, k as (select *, array_to_string(list_sort(list_distinct(string_split(victim || '|' || perpetrators, '|'))), '|') as drugs from hits), r as (select *, row_number() over (partition by list_id, category, drugs order by grade desc, rule, victim) as n from k) select list_id, rule, family, category, victim, perpetrators, grade from r where n = 1")
def pair_rule_dedupe(spark, folder):
    return checks.dedupe_pairs(_pair_alerts(spark, folder)).withColumn("perpetrators", F.array_join("perpetrators", "|"))


@query(f"with {_OF} select list_id, class, count(distinct base) as ingredients, count(distinct pos) as entries from c group by all having count(distinct base) >= 2 and count(distinct pos) >= 2")
def duplicate_classes(spark, folder):
    return checks.duplicate_classes(_list_entries(spark, folder), _members(spark))


@query(f"with {_ENTRIES}, d as (select distinct list_id, pos, base from e), g as (select list_id, base, min(pos) as first_pos, count(*) as n from d group by all having count(*) > 1) select d.list_id, 'shared_ingredient' as risk, d.base, d.base as other, pos, first_pos, n - 1 as n_links from d join g on g.list_id = d.list_id and g.base = d.base where pos <> first_pos")
def duplicate_ingredients(spark, folder):
    return checks.duplicate_ingredients(_list_entries(spark, folder), spark.createDataFrame([("none", "nothing")], "parent string, metabolite string"))


@query(f"with {_ENTRIES}, d as (select distinct list_id, pos, base from e), c as (select list_id, min(pos) as first_pos, count(*) as n_links from d where base = 'brand#22' group by all) select d.list_id, 'active_metabolite' as risk, d.base, 'brand#22' as other, pos, first_pos, n_links from d join c using (list_id) where d.base = 'brand#11'")
def metabolite_links(spark, folder):
    found = checks.duplicate_ingredients(_list_entries(spark, folder), spark.createDataFrame([("Brand#11", "Brand#22")], "parent string, metabolite string"))
    return found.where("risk = 'active_metabolite'")


@query(f"with {_ENTRIES}, t as (select list_id, base as ingredient, sum(q) as total from e group by all), {_rows('most', [('brand#11', 40.0, 'D'), ('brand#22', 25.0, 'C'), ('brand#33', 50.0, 'E')], 'ingredient, most, over_grade')} select list_id, ingredient, total, most::double as most, case when total > most * 1.005 then 'above' else 'at' end as verdict, case when total > most * 1.005 then over_grade else 'A' end as grade from t join most using (ingredient) where total >= most * 0.995")
def dose_ceilings(spark, folder):
    totals = _list_entries(spark, folder).distinct().groupBy("list_id", F.lower("base").alias("ingredient")).agg(F.sum("q").alias("total")).withColumn("unit", F.lit("mg")).withColumn("period", F.lit("day"))
    most = spark.createDataFrame([("brand#11", 40.0, "D"), ("brand#22", 25.0, "C"), ("brand#33", 50.0, "E")], "ingredient string, most double, grade string")
    return checks.ceilings(totals, most)


@query("""
with a as (select distinct * from entry_amount), m as (select distinct med_id, list_id from medication_row),
x as (select list_id, ingredient, case when lower(unit) in ('mg', 'mcg', 'g') then 'mg' when unit in ('mEq', 'units') then unit end as u, period, amount * case lower(unit) when 'mcg' then 0.001 when 'g' then 1000.0 else 1.0 end as v, as_needed, display_name from a join m using (med_id) where amount is not null and (lower(unit) in ('mg', 'mcg', 'g') or unit in ('mEq', 'units')))
select list_id, ingredient, u as unit, period, round(sum(v), 4) as total, count(*) as entry_count, coalesce(bool_or(as_needed), false) as as_needed from x group by all""")
def ingredient_totals(spark, folder):
    a = read(spark, folder, "entry_amount").distinct().join(read(spark, folder, "medication_row").select("med_id", "list_id").distinct(), "med_id")
    plain = F.when(F.lower("unit").isin("mg", "mcg", "g"), F.lower("unit")).when(F.col("unit").isin("mEq", "units"), F.col("unit"))
    unit, factor = amounts.unit_class(plain)
    each = a.select("list_id", "ingredient", (F.col("amount") * factor).alias("amount"), unit.alias("unit"), "period", "as_needed", "display_name", F.col("amount_id").alias("pos")).where("amount is not null and unit is not null")
    totals = amounts.list_totals(each, spark.createDataFrame([], "ingredient string, factor double"), ["list_id"])
    return totals.select("list_id", "ingredient", "unit", "period", "total", "entry_count", "as_needed")


@query("with l as (select l_orderkey as list_id, lower(p_brand) as ingredient, l_quantity as q from lineitem join part on l_partkey = p_partkey), t as (select list_id, ingredient, sum(q) as s from l group by all) select list_id, round(sum(round_even(s * case ingredient when 'brand#11' then 1.5 else 0.25 end, 1)), 1) as mme from t where ingredient in ('brand#11', 'brand#12') group by list_id")
def equivalents(spark, folder):
    each = _list_entries(spark, folder).select("list_id", F.lower("base").alias("ingredient"), F.col("q").alias("amount"), F.lit("mg").alias("unit"), F.lit("day").alias("period"), F.lit(False).alias("as_needed"), F.col("base").alias("display_name"), "pos")
    totals = amounts.list_totals(each, spark.createDataFrame([("brand#11", 1.5), ("brand#12", 0.25)], "ingredient string, factor double"), ["list_id"])
    return amounts.total_mme(totals, ["list_id"]).where("mme is not null")


# rollup


_SALTS = "s as (select distinct row_id, unnest(ingredient_set) as raw from label_summary), n as (select distinct row_id, upper(trim(regexp_replace(raw, '[\\s\\x{a0}]+', ' ', 'g'))) as s from s where raw is not null), dim as (select distinct s, lower(regexp_replace(s, ' [A-Z]+$', '')) as base from n where regexp_matches(s, ' (SODIUM|MALEATE|HYDROCHLORIDE)$'))"


def _substances(spark, folder):
    rows = read(spark, folder, "label_summary").select("row_id", F.explode("ingredient_set").alias("raw")).where("raw is not null")
    return rows.select("row_id", F.upper(T.collapse(F.col("raw"))).alias("s")).where("s <> ''").distinct()


def _dim(substances):
    salted = substances.where(F.col("s").rlike(" (SODIUM|MALEATE|HYDROCHLORIDE)$"))
    return salted.select(F.col("s").alias("substance"), F.array(F.regexp_replace("s", " [A-Z]+$", "")).alias("bases")).distinct()


@query(f"with {_SALTS}, b as (select row_id, coalesce(base, lower(n.s)) as base from n left join dim using (s) where n.s <> '') select row_id, string_agg(distinct base, '|' order by base) as bases from b group by row_id")
def base_rollup(spark, folder):
    s = _substances(spark, folder)
    sets = s.groupBy("row_id").agg(F.collect_set("s").alias("members"))
    return rollup.set_bases(sets, _dim(s), "row_id", "members").select("row_id", F.array_join("bases", "|").alias("bases"))


@query(f"with {_SALTS}, b as (select row_id, coalesce(base, lower(n.s)) as base from n left join dim using (s) where n.s <> ''), k as (select row_id, string_agg(distinct base, '|' order by base) as bases from b group by row_id), w as (select name_id, lower(name_key) as base from name_dictionary) select distinct name_id, string_agg(distinct s, '|' order by s) as ingredient_set from w join k on bases = base join n using (row_id) where n.s <> '' group by name_id, row_id")
def sets_of_bases(spark, folder):
    s = _substances(spark, folder)
    sets = s.groupBy("row_id").agg(F.array_sort(F.collect_set("s")).alias("ingredient_set"))
    wanted = read(spark, folder, "name_dictionary").select("name_id", F.array("name_key").alias("bases"))
    found = rollup.sets_with_bases(wanted, "name_id", "bases", sets, _dim(s))
    return found.select("name_id", F.array_join("ingredient_set", "|").alias("ingredient_set")).distinct()


@query("with o as (select distinct row_id, set_id, label_id, list_sort(list_filter(ingredient_set, lambda x: x is not null)) as s from label_summary) select array_to_string(s, '|') as key, arg_max(label_id, row_id) as label_id from o where len(s) > 0 group by 1")
def set_index(spark, folder):
    once = read(spark, folder, "label_summary").select("row_id", "label_id", F.filter("ingredient_set", lambda x: x.isNotNull()).alias("s")).distinct().where(F.size("s") > 0)
    return rollup.set_index(once, "s", "label_id", "row_id")


@query()
def resolve_cascade(spark, folder):
    """All steps over the typed names; tests/test_resolve.py holds the cases of each step."""
    typed = read(spark, folder, "medication_row").select(F.col("matched_name").alias("name")).where("name is not null").distinct()
    s = _substances(spark, folder)
    sets = s.groupBy("row_id").agg(F.array_sort(F.collect_set("s")).alias("ingredient_set")).select("ingredient_set").distinct()
    external = spark.createDataFrame([], "query string, name string, concept string, rank int, ratio double, bases array<string>")
    return rollup.resolve_names(typed, read(spark, folder, "name_dictionary"), _dim(s), external, sets).select("name", "status", "matched_name", F.array_join("ingredient_set", "|").alias("set_key"), "reason")


# a kept index


def _index(spark: SparkSession, folder: str) -> str:
    """The index of a folder's documents, built once in a session."""
    path = f"{checkpoint_folder(spark).removeprefix('file:')}/index-{spark.sparkContext.applicationId}-{abs(hash(folder))}"
    if path not in _BUILT:
        index.build_index(read(spark, folder, "documents"), path, lean=["source", "lang"])
        _BUILT.add(path)
    return path


_BUILT: set[str] = set()


@query(f"with {_POSTED} select (select n_docs from stats) as n_docs, round((select mean from stats), 6) as mean_terms, (select count(*) from dfs) as n_terms, (select count(*) from posted) as n_postings")
def index_build(spark, folder):
    _BUILT.clear()
    path = _index(spark, folder)
    posted, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats"))
    return stats.select("n_docs", F.round("mean_terms", 6).alias("mean_terms")).join(terms.agg(F.count("*").alias("n_terms"))).join(posted.agg(F.count("*").alias("n_postings")))


@query(f"with {_POSTED}, {_FIXED_SQL}, seen as (select doc_id from documents), {_BM25} select query_id, rank::int as rank, doc_id, score from ranked where rank <= 10")
def index_search(spark, folder):
    return index.search_index(spark, _index(spark, folder), _asked(spark))


@query(f"with {_POSTED}, {_FIXED_SQL}, seen as (select doc_id from documents where source = 'lay_summary'), {_BM25}, b as (select 9 as query_id, row_number() over (order by doc_id)::int as rank, doc_id, 0.0::double as score from seen qualify rank <= 10) select query_id, rank::int as rank, doc_id, score from ranked where rank <= 10 union all select * from b")
def index_search_facet(spark, folder):
    asked = _asked(spark).union(spark.createDataFrame([(9, " ?! ")], "query_id int, query string"))
    return index.search_index(spark, _index(spark, folder), asked, facet=F.col("source") == "lay_summary")


@query()
def index_snippets(spark, folder):
    """Hits with snippets, whose texts are read after the ranking."""
    path = _index(spark, folder)
    asked = _asked(spark)
    return index.with_snippets(spark, path, index.search_index(spark, path, asked), asked)


@query(f"with {_POSTED} select doc_id, n_terms::int as n_terms, coalesce(n, 0) as n_different, coalesce(most, 0)::int as most from size left join (select doc_id, count(*) as n, max(tf) as most from posted group by doc_id) using (doc_id)")
def index_read_back(spark, folder):
    docs = index.read_index(spark, _index(spark, folder))
    return docs.select("doc_id", "n_terms", F.size("terms").cast("bigint").alias("n_different"), F.coalesce(F.array_max(F.map_values("terms")), F.lit(0)).alias("most"))


# orders


@query("select term, name, property_group, broader, place from (values ('T10', 'Schedule II Controlled Substance', 'DEA control', 'T07', 7), ('T06', 'Renal Dose Adjustment', 'Dosing', 'T11', 11), ('T13', 'Interaction Risk', 'Interaction risk', null, 13)) v(term, name, property_group, broader, place)")
def term_listing(spark, folder):
    return vocabulary.terms(spark).where("term in ('T06', 'T10', 'T13')")


@query("with e as (select distinct evidence_id, set_id, field_name from tag_evidence where set_id is not null), g as (select set_id, evidence_id, case field_name when 'contraindications' then 'E' when 'boxed_warning' then 'D' when 'warnings' then 'C' else 'A' end as grade from e) select set_id, evidence_id, grade, row_number() over (partition by set_id order by grade desc, evidence_id)::int as place from g")
def worst_first(spark, folder):
    e = read(spark, folder, "tag_evidence").where("set_id is not null").select("evidence_id", "set_id", "field_name").distinct()
    grade = F.when(F.col("field_name") == "contraindications", "E").when(F.col("field_name") == "boxed_warning", "D").when(F.col("field_name") == "warnings", "C").otherwise("A")
    return orders.worst_first(e.select("set_id", "evidence_id", grade.alias("grade")), ["set_id"], "grade", "evidence_id")


@query("select doc_id, set_id from (select distinct set_id, min(doc_id) as doc_id from documents where set_id is not null group by set_id) order by set_id")
def summaries_by_set(spark, folder):
    docs = read(spark, folder, "documents").where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    return docs.orderBy("set_id").select("doc_id", "set_id")


@query("with t as (select label_id, min(evidence_id) as ord from tag_evidence group by label_id) select label_id from t order by ord, label_id limit 25")
def first_tagged(spark, folder):
    rows = read(spark, folder, "tag_evidence").groupBy("label_id").agg(F.min("evidence_id").alias("ord"))
    return orders.first_n(rows, ["ord", "label_id"], 25).select("label_id")


@query("with h as (select doc_id, coalesce(set_id, '') as s, row_number() over (order by doc_id) as ord from documents where source = 'lay_summary'), w as (select h.*, exists (select 1 from label_summary l where l.set_id = h.s) as on_list from h) select doc_id, on_list, row_number() over (order by on_list desc, ord)::int as place from w")
def listed_first(spark, folder):
    hits = read(spark, folder, "documents").where("source = 'lay_summary'").select("doc_id", F.coalesce("set_id", F.lit("")).alias("s"))
    known = read(spark, folder, "label_summary").select(F.col("set_id").alias("s")).where("s is not null").distinct().withColumn("on_list", F.lit(True))
    met = hits.join(known, "s", "left").select("doc_id", F.coalesce("on_list", F.lit(False)).alias("on_list"))
    return met.select("doc_id", "on_list", F.row_number().over(Window.orderBy(F.desc("on_list"), "doc_id")).alias("place"))


# sets


@query("with s as (select distinct row_id, coalesce(brand_names, []) as b, coalesce(generic_names, []) as g from label_summary), l as (select row_id, list_transform(b, lambda x: lower(x)) as b, list_transform(g, lambda x: lower(x)) as g from s) select row_id, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: list_contains(g, x)))), '|') as both, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: not list_contains(g, x)))), '|') as only_brand from l")
def shared_names(spark, folder):
    low = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(x))
    rows = read(spark, folder, "label_summary").select("row_id", "brand_names", "generic_names").distinct()
    return rows.select("row_id", orders.shared(low("brand_names"), low("generic_names")).alias("both"), F.array_join(F.array_sort(F.array_except(low("brand_names"), low("generic_names"))), "|").alias("only_brand"))


@query("with s as (select distinct evidence_id, set_id, term_id from tag_evidence where set_id is not null), d as (select set_id, term_id, min(evidence_id) as ord from s group by all) select set_id, string_agg(term_id, ',' order by ord) as terms from d group by set_id")
def ordered_distinct(spark, folder):
    rows = read(spark, folder, "tag_evidence").where("set_id is not null")
    return orders.ordered_distinct(rows, ["set_id"], "term_id", "evidence_id").select("set_id", F.array_join("values", ",").alias("terms"))


@query("with a as (select distinct set_id, term_id from tag_evidence where set_id is not null and field_name = 'warnings'), b as (select distinct set_id, term_id from tag_evidence where set_id is not null and field_name = 'boxed_warning') select 'first' as side, * from (select * from a except select * from b) union all select 'second', * from (select * from b except select * from a)")
def signature_changes(spark, folder):
    rows = read(spark, folder, "tag_evidence").where("set_id is not null")
    side = lambda f: rows.where(F.col("field_name") == f).select("set_id", "term_id").distinct()
    return orders.changes(side("warnings"), side("boxed_warning"))


@query("with e as (select distinct evidence_id, field_name from tag_evidence) select 'group' as kind, evidence_id, row_number() over (order by evidence_id) as ord from e where field_name = 'boxed_warning' union all select 'pair', evidence_id, row_number() over (order by evidence_id) + (select count(*) from e where field_name = 'boxed_warning') from e where field_name = 'contraindications'")
def alert_streams(spark, folder):
    rows = read(spark, folder, "tag_evidence").select("evidence_id", "field_name").distinct()
    parts = [rows.where(F.col("field_name") == f).select(F.lit(k).alias("kind"), "evidence_id") for k, f in (("group", "boxed_warning"), ("pair", "contraindications"))]
    return orders.concatenated(parts, ["evidence_id"])


# evaluation


@query(f"with per as ({SQL['ranking_measures']}) select count(*) as n_queries, round(avg(p_at_k), 6) as mean_p_at_k, round(avg(r_at_k), 6) as mean_r_at_k, round(avg(ap), 6) as map, round(avg(ndcg_at_k), 6) as mean_ndcg_at_k from per")
def mean_measures(spark, folder):

    return evaluation.mean_measures(evaluation.ranking_metrics(*_judged(spark, folder)))


@query("with t(term_id) as (select 'T' || lpad(i::varchar, 2, '0') from range(1, 18) r(i)), p as (select term_id, set_id, bool_or(field_name = 'drug_interactions') as predicted, bool_or(field_name in ('warnings', 'warnings_and_cautions')) as gold from tag_evidence where set_id is not null group by all), c as (select term_id, count(*) filter (where predicted and gold) as tp, count(*) filter (where predicted and not gold) as fp, count(*) filter (where not predicted and gold) as fn, count(*) filter (where not predicted and not gold) as tn from p group by term_id) select t.term_id, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(tn, 0) as tn from t left join c using (term_id)")
def confusion_padded(spark, folder):
    return evaluation.padded(_counts(spark, folder), vocabulary.terms(spark).select(F.col("term").alias("term_id")), "term_id")


_RATED = "e as (select distinct evidence_id, set_id, field_name from tag_evidence where set_id is not null), r as (select set_id, max(case field_name when 'contraindications' then 4 when 'boxed_warning' then 3 when 'warnings' then 2 else 1 end) as a, least(4, count(*))::int as b from e group by set_id)"


def _rated(spark, folder):
    e = read(spark, folder, "tag_evidence").where("set_id is not null").select("evidence_id", "set_id", "field_name").distinct()
    a = F.when(F.col("field_name") == "contraindications", 4).when(F.col("field_name") == "boxed_warning", 3).when(F.col("field_name") == "warnings", 2).otherwise(1)
    return e.groupBy("set_id").agg(F.max(a).alias("a"), F.least(F.lit(4), F.count("*")).cast("int").alias("b"))


@query(f"with {_RATED}, g(x) as (values (1), (2), (3), (4)) select x.x as a, y.x as b, (select count(*) from r where a = x.x and b = y.x) as n from g x cross join g y")
def agreement_matrix(spark, folder):
    return evaluation.agreement(_rated(spark, folder), "a", "b", [1, 2, 3, 4])


@query(f"with {_RATED}, n as (select count(*)::double as n, count(*) filter (where a = b) as same from r), m as (select sum((select count(*) from r where a = g.x)::double * (select count(*) from r where b = g.x)) as e from (values (1), (2), (3), (4)) g(x)) select n::bigint as n, round(same / n, 6) as observed, round(e / (n * n), 6) as expected, round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) as kappa from n, m")
def agreement_kappa(spark, folder):
    return evaluation.kappa(evaluation.agreement(_rated(spark, folder), "a", "b", [1, 2, 3, 4]), "a", "b")


@query(f"with {_RATED}, s as (select set_id, case a when 4 then 'D' when 3 then 'C' when 2 then 'B' else 'A' end as grade, b >= 2 as hit, b::double as seconds from r) select grade, count(*) as items, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 6) as recall, median(seconds) as median_seconds, max(seconds) as max_seconds from s group by grade")
def pack_metrics(spark, folder):
    grade = F.substring(F.lit("ABCD"), F.col("a"), F.lit(1))
    rows = _rated(spark, folder).select("set_id", grade.alias("grade"), (F.col("b") >= 2).alias("hit"), F.col("b").cast("double").alias("seconds"))
    return evaluation.pack_metrics(rows, "grade", "hit", "seconds")


# sources and sinks: fixture files beside the tests


@query("select * from (values ('2024-05-01', 'part1.json.zip', 'one', 0.0001::double, 2::bigint), ('2024-05-01', 'part2.json.zip', 'two', 5.0::double, 3::bigint)) v(export_date, file, display_name, size_mb, records)")
def source_manifest(spark, folder):
    path = str(FIXTURES / "manifest.json")
    return files.manifest(spark, path).join(files.export_date(spark, path)).select("export_date", "file", "display_name", "size_mb", "records")


@query("select * from (values ('part1.json', 'a', 'X'), ('part1.json', 'b', 'Y')) v(member, id, name)")
def source_bulk_json(spark, folder):
    rows = files.zipped_records(spark, str(FIXTURES / "*.json.zip"))
    return rows.select(F.col("member"), F.get_json_object("record", "$.id").alias("id"), F.get_json_object("record", "$.name").alias("name"))


@query("select * from (values ('q1', 'd1', 2.0::double), ('q1', 'd2', 0.0::double), ('q2', 'd1', null)) v(query_id, doc_id, grade)")
def source_judgments(spark, folder):
    return files.judgments_tsv(spark, str(FIXTURES / "judgments.tsv"))


@query("select * from (values ('q1', 'renal dose'), ('q2', 'two\twords')) v(query_id, query)")
def source_queries(spark, folder):
    return files.queries_tsv(spark, str(FIXTURES / "queries.tsv"))


@query("select 'part2.json.zip' as file")
def source_incomplete(spark, folder):
    return files.incomplete(files.manifest(spark, str(FIXTURES / "manifest.json")), spark, str(FIXTURES / "*.zip")).select("file")


@query("select * from (values ('L01', 'Xanax 1 mg', 2::bigint), ('L02', 'Zoloft 50 mg, Advil', 1::bigint)) v(list_id, meds, n_items)")
def source_answer_keys(spark, folder):
    return files.answer_keys(spark, str(FIXTURES / "pack.md")).select("list_id", F.get_json_object("record", "$.meds").alias("meds"), F.size(F.from_json(F.get_json_object("record", "$.items"), "array<string>")).cast("bigint").alias("n_items"))


@query("with o as (select distinct label_id, set_id, version from label_summary) select count(*) as written, count(distinct label_id) as labels from o where set_id is not null and set_id <> '' and set_id not like '%/%'")
def sink_rows(spark, folder):
    path = f"{checkpoint_folder(spark).removeprefix('file:')}/sink-{spark.sparkContext.applicationId}"
    rows = read(spark, folder, "label_summary").select("label_id", "set_id", "version").distinct()
    n = sinks.write_json_lines(sinks.safe_keys(rows, "set_id"), path)
    back = files.json_lines(spark, path, "label_id string, set_id string, version string")
    return back.agg(F.lit(n).cast("bigint").alias("written"), F.countDistinct("label_id").alias("labels"))


@query("select set_id, label_id from (select distinct set_id, label_id from label_summary) where set_id in (select min(set_id) from label_summary where length(set_id) = 36 union select max(set_id) from label_summary where length(set_id) = 36)")
def point_read(spark, folder):
    rows = read(spark, folder, "label_summary").select("set_id", "label_id").distinct()
    ends = rows.where(F.length("set_id") == 36).agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).first()
    return files.by_keys(rows, "set_id", [ends.a, ends.b])



# records


@query("with e as (select distinct user_id, ts, event_id from events), f as (select *, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as fresh from e window w as (partition by user_id order by ts, event_id)), g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from f) select user_id, min(ts) as start, max(ts) + interval 30 minute as finish, count(*) as n from g group by user_id, s")
def event_sessions(spark, folder):
    events = read(spark, folder, "events").select("user_id", "ts", "event_id").distinct()
    return incremental.sessions(events, "ts", "1 day", "30 minutes", ["user_id"]).withColumnRenamed("end", "finish")


@query()
def label_profiles(spark, folder):
    """Quotes of labels by section; tests/test_records.py holds the cases."""
    rows = _evidence(spark, folder).where("label_id is not null and field_name not like 'openfda.%'")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "sentence"))), lambda x: x["sentence"])
    sections = rows.groupBy("label_id", "field_name").agg(texts.alias("texts")).groupBy("label_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "texts"))).alias("sections"))
    return records.label_profiles(sections, "label_id")


@query(f"with {_EVIDENCE}, {_rows('t', vocabulary.TERMS, 'term, name, grp')} select set_id, term_id as term, name, field_name, sentence, evidence_id as place from evidence join t on term = term_id where set_id is not null and term_id in ('T01', 'T04', 'T06', 'T12', 'T14', 'T15', 'T16', 'T17') and coalesce(sentence, '') <> ''")
def label_notes(spark, folder):
    e = _evidence(spark, folder).where("set_id is not null").withColumnRenamed("term_id", "term")
    return records.label_notes(e, "set_id", "evidence_id")


@query("with o as (select distinct label_id, set_id, list_sort(list_filter(ingredient_set, lambda x: x is not null)) as s from label_summary), r as (select label_id, set_id, coalesce(array_to_string(s, '|'), '') as k from o) select 'repeated label' as problem, label_id as key, count(*) as n from r where label_id <> '' group by label_id having count(*) > 1 union all select 'repeated ingredient set', k, count(*) from r where k <> '' group by k having count(*) > 1 union all select 'no set id', coalesce(label_id, ''), count(*) from r where coalesce(set_id, '') = '' group by 2 union all select 'no ingredients', coalesce(label_id, ''), count(*) from r where k = '' group by 2")
def collection_problems(spark, folder):
    rows = read(spark, folder, "label_summary").select("label_id", "set_id", F.filter("ingredient_set", lambda x: x.isNotNull()).alias("ingredient_set")).distinct()
    return records.collection_problems(rows)


@query(r"""
with once as (select distinct row_id, brand_names, generic_names, array_to_string(list_filter(ingredient_set, lambda x: x is not null), '|') as s from label_summary),
n as (select row_id, s, 'brand' as kind, unnest(brand_names) as display from once union all select row_id, s, 'generic', unnest(generic_names) from once),
k as (select *, lower(trim(regexp_replace(display, '[\s\x{a0}]+', ' ', 'g'))) as name_key from n where display is not null)
select name_key, string_agg(distinct kind, ',' order by kind) as kinds, count(distinct coalesce(s, '')) as n_sets, min(row_id) as first_row from k where name_key <> '' group by name_key""")
def name_entries(spark, folder):
    none = F.array().cast("array<string>")
    once = read(spark, folder, "label_summary").select("row_id", "brand_names", "generic_names", F.coalesce(F.filter("ingredient_set", lambda x: x.isNotNull()), none).alias("s")).distinct()
    entries = records.name_entries(once, {"brand": "brand_names", "generic": "generic_names"}, "s", "row_id")
    every = once.select("row_id", F.explode(F.concat(F.coalesce("brand_names", none), F.coalesce("generic_names", none))).alias("x"))
    first = every.groupBy(F.lower(T.collapse(F.col("x"))).alias("name_key")).agg(F.min("row_id").alias("first_row"))
    return entries.join(first, "name_key").select("name_key", F.array_join("kinds", ",").alias("kinds"), F.size("ingredient_sets").cast("bigint").alias("n_sets"), "first_row")


@query("with l as (select distinct label_id, set_id, brand_names, generic_names, ingredient_set from label_summary where set_id is not null), e as (select distinct evidence_id, set_id, term_id from tag_evidence where set_id is not null), c as (select set_id, count(*) as n from e group by set_id) select label_id, l.set_id, len(coalesce(brand_names, []))::int as n_brands, array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(ingredient_set, []), lambda x: x is not null), lambda x: upper(x)))), '|') as ingredients, coalesce(n, 0)::int as n_evidence from l left join c using (set_id)")
def checker_records(spark, folder):
    none = F.lit(None).cast("array<string>")
    rows = read(spark, folder, "label_summary").where("set_id is not null").select("label_id", "set_id", "brand_names", "generic_names", "ingredient_set").distinct()
    labels = rows.select("set_id", F.col("label_id").alias("effective_time"), F.col("brand_names").alias("brand_name"), F.col("generic_names").alias("generic_name"), F.filter("ingredient_set", lambda x: x.isNotNull()).alias("substance_name"), none.alias("route"), none.alias("pharm_class_epc"), F.lit(None).cast("string").alias("controlled_substance"))
    evidence = _evidence(spark, folder).where("set_id is not null").select("set_id", F.col("term_id").alias("term"), "field_name", "sentence")
    made = records.checker_records(labels, evidence)
    return made.select(F.col("effective_time").alias("label_id"), "set_id", F.size("brand_names").alias("n_brands"), F.array_join("ingredient_set", "|").alias("ingredients"), F.size("evidence").alias("n_evidence"))


@query("with s as (select distinct set_id from tag_evidence where set_id is not null), t(term) as (select 'T' || lpad(i::varchar, 2, '0') from range(1, 18) r(i)), g as (select set_id, term_id, bool_or(field_name = 'warnings') as gold from tag_evidence where set_id is not null and field_name in ('warnings', 'boxed_warning') group by all) select s.set_id, t.term, coalesce(gold, false) as gold, g.gold is not null as filled from s cross join t left join g on g.set_id = s.set_id and g.term_id = t.term")
def gold_cells(spark, folder):
    rows = read(spark, folder, "tag_evidence").where("set_id is not null")
    edits = rows.where("field_name in ('warnings', 'boxed_warning')").groupBy("set_id", F.col("term_id").alias("term")).agg(F.bool_or(F.col("field_name") == "warnings").alias("gold")).withColumn("rationale", F.lit("read"))
    cells = records.set_gold(records.gold_template(rows, vocabulary.terms(spark)), edits)
    return cells.select("set_id", "term", "gold", (F.col("rationale") != records.PLACEHOLDER).alias("filled"))


# scope of raw labels, reports


_TEXTS = GENERAL_SQL["p6_found"].split("inner_items as")[0].rstrip().rstrip(",")


@query(f"""
{_TEXTS}, f as (select distinct rec_id, field, value from texts where block = 'openfda' and trim(coalesce(value, '')) <> ''),
r as (select distinct rec_id from raw_label),
x as (select rec_id, (select count(*) from f where f.rec_id = r.rec_id and field = 'product_type' and value = 'HUMAN PRESCRIPTION DRUG') as scope, (select count(*) from f where f.rec_id = r.rec_id) as blocks, (select count(*) from f where f.rec_id = r.rec_id and field = 'substance_name') as sub from r),
o as (select case when scope = 0 then 1 when blocks = 0 then 2 when sub = 0 then 3 else 4 end as ord, count(*) as n from x group by 1),
s(stage, ord) as (values ('prescription', 1), ('openfda', 2), ('ingredients', 3), ('kept', 4))
select stage, s.ord, case when s.ord = 4 then 0 else coalesce(o.n, 0) end::bigint as failed, case when s.ord = 4 then coalesce(o.n, 0) else (select coalesce(sum(m.n), 0) from o m where m.ord > s.ord) end::bigint as remaining from s left join o using (ord)""")
def label_scope(spark, folder):
    raw = read(spark, folder, "raw_label")
    values = label_values(raw, "openfda", True, ["rec_id"])
    has = values.groupBy("rec_id").agg(F.bool_or((F.col("field") == "product_type") & (F.col("value") == "HUMAN PRESCRIPTION DRUG")).alias("scope"), F.lit(True).alias("some"), F.bool_or(F.col("field") == "substance_name").alias("sub"))
    met = raw.select("rec_id").distinct().join(has, "rec_id", "left")
    return collect.stage_counts(met, [("prescription", F.col("scope")), ("openfda", F.col("some")), ("ingredients", F.col("sub"))])


@query("with m as (select distinct list_id, med_id, as_entered from medication_row), p as (select list_id, 'medication' as part, row_number() over (partition by list_id order by med_id, as_entered) as place, as_entered as text from m) select list_id, part, place::int as place, text from p union all select distinct list_id, 'notice', 1, 'Ask a pharmacist.' from m")
def list_reports(spark, folder):
    rows = read(spark, folder, "medication_row").select("list_id", F.col("med_id").alias("ord"), F.col("as_entered").alias("text")).distinct()
    return reports.report_rows({"medication": rows}, "list_id", "Ask a pharmacist.")
