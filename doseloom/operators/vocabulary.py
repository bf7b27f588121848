"""The table of terms and text rules, and the rules that look at a whole label: names, routes, tables, known partners."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import columns, no_clash, quoted, spec
from .markup import html_cells
from .tagging import Rule, expand_hierarchy, tag

#: Terms with their names and groups, and the narrower term before its broader one.
TERMS = (
    ("T01", "Boxed Warning", "Safety signal"), ("T02", "Oral Route", "Route"), ("T03", "Pediatric Indication", "Patient group"),
    ("T04", "High-Frequency Adverse Effect", "Safety signal"), ("T05", "Medication Guide", "Patient information"), ("T06", "Renal Dose Adjustment", "Dosing"),
    ("T07", "Controlled Substance", "DEA control"), ("T08", "Single Active Ingredient", "Product form"), ("T09", "Brand Name Product", "Product form"),
    ("T10", "Schedule II Controlled Substance", "DEA control"), ("T11", "Organ Impairment Dose Adjustment", "Dosing"), ("T12", "Hepatic Dose Adjustment", "Dosing"),
    ("T13", "Interaction Risk", "Interaction risk"), ("T14", "Serotonin Syndrome Risk", "Interaction risk"), ("T15", "CNS Depression Risk", "Interaction risk"),
    ("T16", "QT Prolongation Risk", "Interaction risk"), ("T17", "Contraindicated Combination", "Interaction risk"),
)
EDGES = [("T10", "T07"), ("T06", "T11"), ("T12", "T11"), ("T14", "T13"), ("T15", "T13"), ("T16", "T13"), ("T17", "T13")]
#: Least frequency of a high-frequency effect, in percent; characters of a guide taken as evidence.
FREQUENT, GUIDE = 10.0, 200
#: The sections that a rule reads, in order.
DOSING = ("dosage_and_administration", "use_in_specific_populations", "precautions")
CNS = ("boxed_warning", "warnings_and_cautions", "warnings", "precautions", "drug_interactions")
SEROTONIN, QT = (*CNS, "contraindications"), ("boxed_warning", "warnings_and_cautions", "warnings", "precautions", "contraindications", "drug_interactions")
#: Patterns of the rules.
ESTABLISHED = r"safety and (?:effectiveness|efficacy) (?:of [^.]*?)?(?:have|has) been established in\s+(?:pediatric|children)|indicated for\s+.{0,80}?\bpediatric patients\b"
NOT_ESTABLISHED = r"safety and (?:effectiveness|efficacy)[^.]*?have not been established|have not been established in pediatric|contraindicat\w* in (?:children|pediatric)"
RENAL = r"renal impair|kidney|creatinine clearance|\bcrcl\b|\begfr\b|dialysis|end-stage renal"
HEPATIC = r"hepatic impair|liver impair|child-?pugh|hepatic insufficiency"
DOSE_CHANGE = r"dos(?:e|age) adjustment|adjust(?:ed|ing)? (?:the )?dose|reduce (?:the )?(?:daily )?dose|lower (?:the )?(?:maximum )?dose|decrease (?:the )?dose|extend(?:ed)? (?:the )?(?:dosing )?interval|increase (?:the )?interval|maximum (?:daily )?dose of|\d+(?:\.\d+)?\s*mg|dosage is recommended|dosing recommendations|titrat"
AVOID, MORE_THAN_AVOID = r"\bavoid\b|contraindicat", r"\d+(?:\.\d+)?\s*mg|adjustment|reduce|lower|decrease|extend|interval"
SCHEDULES = tuple(rf"\bschedule\s+{n}\b|\bc-?{n}\b" for n in ("ii", "iii", "iv", "v"))
SEROTONIN_TEXT = r"serotonin syndrome|serotonin toxicity"
CNS_TEXT = r"additive (?:cns depress|sedat|effects? (?:on|with) (?:the )?cns)|additional (?:cns depress|sedat)|(?:other |additional )?cns depressants?|central nervous system depressants?|respiratory depression"
QT_TEXT = r"qtc? prolongation|prolongs? the qt interval|torsades de pointes"
COMBINED = r"\bconcomitant\w*|\bco-?administ\w*|\bcombin\w*|\bconcurrent\w*|\bother\s+(?:cns\s+depressants?|central\s+nervous\s+system\s+depressants?)\b|\balong\s+with\b|\bin\s+conjunction\s+with\b"
FORBIDDEN = r"\bis contraindicated\b|\bare contraindicated\b|\bmust not be (?:used|combined|given|taken)\b|\bshould not be (?:used|administered|combined|taken)\b|\b(?:must|should) not (?:take|use|combine|administer)\b"
CLASS_WORD = r"\binhibitors?\b|\binducers?\b|\bantagonists?\b|\bagonists?\b|\bmaois?\b"
ITSELF = r"\bin common with other\b|\bother members of\b|\bknown\s+\S+\s+sensitivity\b|\bhistory of\s+\S+\s+(?:sensitivity|allergy)\b|\bhypersensitivity to\b"
PARTNER = r"\bco-?administ\w*|\bconcomitant\w*|\bconcurrent\w*|\bcombin\w*|\btaking,?\s*or\b|\bwithin\s+\d+\s+days\b|\bmaois?\b"
PLACEBO = r"(?i)placebo|vehicle|\bcontrol\b"

#: The rules that a sentence of a section decides, as data.
TEXT_RULES = [
    Rule("T03", ("pediatric_use", "indications_and_usage"), "(?i)" + ESTABLISHED, exclude="(?i)" + NOT_ESTABLISHED),
    Rule("T04", ("adverse_reactions",), r"[0-9]\s*%", test=lambda s: T.first_percent(s) >= FREQUENT),
    Rule("T06", DOSING, "(?i)" + RENAL, also="(?i)" + DOSE_CHANGE, exclude="(?i)" + AVOID, unless="(?i)" + MORE_THAN_AVOID),
    Rule("T07", ("controlled_substance",), "(?i)" + "|".join(SCHEDULES), ranked=tuple("(?i)" + p for p in SCHEDULES)),
    Rule("T10", ("controlled_substance",), "(?i)" + SCHEDULES[0]),
    Rule("T12", DOSING, "(?i)" + HEPATIC, also="(?i)" + DOSE_CHANGE, exclude="(?i)" + AVOID, unless="(?i)" + MORE_THAN_AVOID),
    Rule("T14", SEROTONIN, "(?i)" + SEROTONIN_TEXT, prefer="(?i)" + COMBINED, bare=True),
    Rule("T15", CNS, "(?i)" + CNS_TEXT, prefer="(?i)" + COMBINED, bare=True),
    Rule("T16", QT, "(?i)" + QT_TEXT, prefer="(?i)" + COMBINED, bare=True),
]


def terms(spark) -> DataFrame:
    """term, name, property_group and the place of each term in the vocabulary: broader terms, each followed by its narrower ones."""
    broader = dict(EDGES)
    order = {t: (broader.get(t, t), t in broader, t) for t, *_ in TERMS}
    place = {t: i for i, t in enumerate(sorted(order, key=order.get), 1)}
    return spark.createDataFrame([(*t, broader.get(t[0]), place[t[0]]) for t in TERMS], "term string, name string, property_group string, broader string, place int")


def schedule_of(text: Column) -> Column:
    """The first schedule that a text names, whether it denies it or not; '' for none."""
    found = F.lit("")
    for name, pattern in reversed(list(zip(("II", "III", "IV", "V"), SCHEDULES))):
        found = F.when(text.rlike("(?i)" + pattern), name).otherwise(found)
    return F.coalesce(found, F.lit(""))


def sentences_of(sections: DataFrame, key: str) -> DataFrame:
    """key, field_name, n, sentence of sections (key, field_name, text)."""
    return sections.select(key, "field_name", F.posexplode(T.plain_sentences(F.col("text"))).alias("n", "sentence"))


def presence_tags(sections: DataFrame, key: str) -> DataFrame:
    """T01 and T05: a boxed warning (its first sentence) and a medication guide (its first GUIDE characters)."""
    text = F.trim("text")
    first = F.when(F.col("field_name") == "boxed_warning", F.coalesce(F.get(T.plain_sentences(text), F.lit(0)), text)).otherwise(F.substring(text, 1, GUIDE))
    kept = sections.where(F.col("field_name").isin("boxed_warning", "spl_medguide") & (text != ""))
    rows = kept.select(key, F.when(F.col("field_name") == "boxed_warning", "T01").otherwise("T05").alias("term"), "field_name", first.alias("sentence"))
    return rows.groupBy(key, "term", "field_name").agg(F.min("sentence").alias("sentence"))


def name_tags(labels: DataFrame, key: str, route: str, substance: str, brand: str, generic: str, application: str) -> DataFrame:
    """T02, T08 and T09 from arrays of names: routes with ORAL; a single substance; a brand of its own that is no ANDA product."""
    some = lambda c: F.coalesce(F.col(quoted(c)), F.array().cast("array<string>"))
    low = lambda c: F.transform(some(c), lambda x: F.lower(x))
    copied = F.exists(some(application), lambda x: F.upper(x).startswith("ANDA"))
    own = F.exists(low(brand), lambda x: ~F.array_contains(low(generic), x))
    joined = lambda c: F.array_join(some(c), ", ")
    rules = [
        F.when(F.array_contains(some(route), "ORAL"), F.struct(F.lit("T02").alias("term"), F.lit("openfda.route").alias("field_name"), joined(route).alias("sentence"))),
        F.when(F.size(some(substance)) == 1, F.struct(F.lit("T08").alias("term"), F.lit("openfda.substance_name").alias("field_name"), F.get(some(substance), F.lit(0)).alias("sentence"))),
        F.when(F.coalesce(own, F.lit(False)) & ~F.coalesce(copied, F.lit(False)), F.struct(F.lit("T09").alias("term"), F.lit("openfda.brand_name").alias("field_name"), F.concat(F.lit("brand_name="), joined(brand), F.lit("; generic_name="), joined(generic)).alias("sentence"))),
    ]
    return labels.select(key, F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))


def table_tags(tables: DataFrame, key: str, html: str, place: str) -> DataFrame:
    """T04 from HTML tables: the first reaction with at least FREQUENT percent in a column of a group that takes the drug.

    The first row of a table names the columns; rows of another width and columns of placebo or control don't count.
    place tells tables of one key apart; rows of a table are gathered, never a whole label.
    """
    cells = html_cells(tables.select(key, place, html), html)
    rows = cells.groupBy(key, place, "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "cell"))), lambda x: F.trim(x["cell"])).alias("cells"))
    at = [key, place, "table_no"]
    heads = rows.where("row_no = 1").select(*at, F.col("cells").alias("head"))
    body = rows.where((F.col("row_no") > 1) & (F.col("cells")[0] != "")).join(heads, at).where(F.size("cells") == F.size("head"))
    spread = body.select(*at, "row_no", F.col("cells")[0].alias("reaction"), F.posexplode(F.arrays_zip("head", "cells")).alias("n", "c")).where("n > 0 and c.head <> ''")
    high = spread.where(~F.col("c.head").rlike(PLACEBO) & (T.cell_percent(F.col("c.cells")) >= FREQUENT))
    sentence = F.concat(F.col("reaction"), F.lit(": "), F.col("c.head"), F.lit(": "), F.col("c.cells"))
    best = high.groupBy(key).agg(F.min_by(sentence, F.struct(place, "table_no", "row_no", "n")).alias("sentence"))
    return best.select(key, F.lit("T04").alias("term"), F.lit("adverse_reactions_table").alias("field_name"), "sentence")


#: Characters of known names that go to the workers.
NAMES_CHARS = 20_000_000


def mentions(df: DataFrame, column: str, names: DataFrame, into: str = "mentioned") -> DataFrame:
    """df with the known names (a one-column table, lower case) that a text holds anywhere, also within words, sorted.

    All names are searched for in one pass of an automaton, which goes to the workers; more than NAMES_CHARS characters
    of names are a ValueError. Null texts hold none.
    """
    no_clash(df, [into])
    name = names.columns[0]
    listed = names.select(F.col(quoted(name)).cast("string").alias("name")).where("name <> ''").distinct()
    if (listed.agg(F.sum(F.length("name"))).first()[0] or 0) > NAMES_CHARS:
        raise ValueError(f"the names have more than {NAMES_CHARS} characters")
    sent = df.sparkSession.sparkContext.broadcast([r.name for r in listed.collect()])
    kept, at = df.columns, df.columns.index(column)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in sent.value:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({x for _, x in automaton.iter(t.lower())}) if t and len(automaton) else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*kept, into])

    return df.select(*columns(kept)).mapInArrow(find, spec(df, f"{quoted(into)} array<string>"))


def partner_tags(sentences: DataFrame, own: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """T17: the first sentence of contraindications that forbids a combination with a class or a known name other than the label's own.

    own: key and `names`, the label's own names in lower case. A sentence that only speaks of the drug itself doesn't count.
    """
    s = F.col("sentence")
    cued = sentences.where((F.col("field_name") == "contraindications") & s.rlike("(?i)" + FORBIDDEN) & ~T.negated(s) & ~(s.rlike("(?i)" + ITSELF) & ~s.rlike("(?i)" + PARTNER)))
    named = mentions(cued, "sentence", names).join(own.select(key, F.col("names").alias("_own")), key, "left")
    others = F.array_except("mentioned", F.coalesce("_own", F.array().cast("array<string>")))
    hit = named.where(s.rlike("(?i)" + CLASS_WORD) | (F.size(others) > 0))
    best = hit.groupBy(key).agg(F.min_by(T.strip_heading(s), F.col("n")).alias("sentence"))
    return best.select(key, F.lit("T17").alias("term"), F.lit("contraindications").alias("field_name"), "sentence")


def tag_labels(labels: DataFrame, sections: DataFrame, tables: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, term, field_name, sentence of all terms of the vocabulary.

    labels: key and the arrays route, substance_name, brand_name, generic_name, application_number; sections: key,
    field_name, text; tables: key, place, html; names: known partner names, lower case. A frequency in a table goes before
    one in prose; broader terms take the evidence of their first narrower one.
    """
    sentences = sentences_of(sections, key)
    prose = tag(sentences, TEXT_RULES, key, ["n"])
    tabled = table_tags(tables, key, "html", "place")
    prose = prose.where("term <> 'T04'").unionByName(prose.where("term = 'T04'").join(tabled.select(key), key, "left_anti"))
    low = F.transform(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("brand_name", "generic_name", "substance_name")]), lambda x: F.lower(x))
    own = labels.select(key, F.filter(low, lambda x: x != "").alias("names"))
    parts = [presence_tags(sections, key), name_tags(labels, key, "route", "substance_name", "brand_name", "generic_name", "application_number"), tabled, partner_tags(sentences, own, names, key)]
    for p in parts:
        prose = prose.unionByName(p)
    return expand_hierarchy(prose, EDGES, key, ["field_name", "sentence"])
