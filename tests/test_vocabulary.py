import pytest
from pyspark.sql import functions as F

from doseloom.functions import text as T
from doseloom.operators import tagging, vocabulary as V

#: Label sections: key, field, text.
SECTIONS = [
    ("a", "boxed_warning", "WARNING: danger. More text."),
    ("a", "spl_medguide", "Guide " * 60),
    ("a", "pediatric_use", "Safety and effectiveness have not been established in pediatric patients. Safety and effectiveness have been established in pediatric patients aged 6."),
    ("a", "adverse_reactions", "Rash did occur in 3%. Nausea in 12.5% of patients (placebo 4%). Not observed in 40 % of them."),
    ("a", "dosage_and_administration", "Avoid in dialysis. In renal impairment reduce the dose to 5 mg daily. No dose adjustment is needed in hepatic impairment of 5 mg."),
    ("a", "controlled_substance", "This is not a controlled substance under C-II. It is a Schedule IV drug. It was Schedule III."),
    ("a", "drug_interactions", "5 DRUG INTERACTIONS Serotonin syndrome may occur. Concomitant use raises serotonin syndrome risk."),
    ("a", "warnings", "( 5.4 ) • QT prolongation was seen. No cases of torsades de pointes occurred."),
    ("a", "contraindications", "Hypersensitivity to foo is contraindicated with bar. Acmene is contraindicated in all. It must not be combined with zorprexal."),
    ("b", "contraindications", "Acmene is contraindicated in all patients."),
    ("b", "precautions", "Child-Pugh class C: titrate slowly."),
    ("b", "controlled_substance", "Schedule II (C-II)."),
    ("c", "warnings", None), ("c", "boxed_warning", "  "),
]
TABLE = "<table><tr><th>Reaction</th><th>Placebo</th><th>Drug</th><th></th></tr><tr><td>Rash</td><td>20 (30)</td><td>5 (9.9)</td><td>50%</td></tr><tr><td>Odd</td><td>99%</td></tr><tr><td>Nausea</td><td>1%</td><td>30 (21)</td><td>1</td></tr></table>"


def test_all_terms(spark):
    sections = spark.createDataFrame(SECTIONS, "id string, field_name string, text string")
    names = "array<string>"
    labels = spark.createDataFrame([("a", ["ORAL", "TOPICAL"], ["ACMENE"], ["Brandy", "acmene"], ["ACMENE"], ["NDA1"]), ("b", ["ORALLY"], ["X", "Y"], ["Brandy"], ["x"], ["ANDA7"]), ("c", None, None, None, None, None)], f"id string, route {names}, substance_name {names}, brand_name {names}, generic_name {names}, application_number {names}")
    tables = spark.createDataFrame([("a", 1, "<p>none</p>"), ("a", 2, TABLE), ("b", 1, None)], "id string, place int, html string")
    gazetteer = spark.createDataFrame([("acmene",), ("zorprexal",), ("",)], "name string")
    got = {(r.id, r.term): (r.field_name, r.sentence) for r in V.tag_labels(labels, sections, tables, gazetteer, "id").collect()}
    assert {t for i, t in got if i == "a"} == {"T01", "T02", "T03", "T04", "T05", "T06", "T07", "T08", "T09", "T11", "T13", "T14", "T16", "T17"}
    assert got["a", "T01"] == ("boxed_warning", "WARNING: danger.") and len(got["a", "T05"][1]) == 200 and got["a", "T02"][1] == "ORAL, TOPICAL"
    assert got["a", "T04"] == ("adverse_reactions_table", "Nausea: Drug: 30 (21)") and got["a", "T06"][1].startswith("In renal")
    assert got["a", "T07"][1] == "It was Schedule III." and got["a", "T14"][1].startswith("Concomitant") and got["a", "T16"][1] == "QT prolongation was seen."
    assert got["a", "T17"][1] == "It must not be combined with zorprexal." and got["a", "T13"] == got["a", "T14"] and got["a", "T09"][1] == "brand_name=Brandy, acmene; generic_name=ACMENE"
    assert {t for i, t in got if i == "b"} == {"T07", "T10", "T11", "T12", "T13", "T17"} and got["b", "T17"][1].startswith("Acmene") and not [i for i, _ in got if i == "c"]
    assert V.tag_labels(labels.limit(0), sections.limit(0), tables.limit(0), gazetteer.limit(0), "id").count() == 0
    prose = {r.id: r.sentence for r in tagging.tag(V.sentences_of(sections, "id"), V.TEXT_RULES, "id", ["n"]).where("term = 'T04'").collect()}
    assert prose == {"a": "Nausea in 12.5% of patients (placebo 4%)."}


def test_cells_and_schedules(spark):
    df = spark.createDataFrame([("(23)",), ("30 (21)",), ("23%",), ("N/A",), ("5 (3%) 7 (4.5)",), (None,)], "c string")
    assert [r.v for r in df.select(T.cell_percent(F.col("c")).alias("v")).collect()] == [23, 21, 23, None, 4.5, None]
    s = spark.createDataFrame([("not a schedule II drug",), ("CIV",), ("c-v and C-III",), ("none",), (None,)], "c string")
    assert [r.v for r in s.select(V.schedule_of(F.col("c")).alias("v")).collect()] == ["II", "IV", "III", "", ""]
    assert [r.term for r in V.terms(spark).orderBy("place").collect()][5:12] == ["T07", "T10", "T08", "T09", "T11", "T06", "T12"]


def test_negation_and_clauses(spark):
    texts = ["Did not prolong the QT interval.", "Do not take with x.", "UNLIKELY TO matter", "No interaction", "Was not observed", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(T.negated(F.col("t")).alias("v")).collect()] == [True, False, True, True, True, None, False]
    near = spark.createDataFrame([("no evidence of x. " + "y" * 130 + " z", 20), ("no evidence of x. " + "y" * 130 + " z", 149), ("z no evidence of", 1)], "t string, at int")
    assert [r.v for r in near.select(T.negated_near(F.col("t"), F.col("at")).alias("v")).collect()] == [True, False, False]
    c = spark.createDataFrame([("a • b •• this drug itself ",)], "t string")
    assert c.select(T.clauses(F.col("t"), "itself").alias("v")).first().v == ["a", "b"]
    h = spark.createDataFrame([("( 5.4 ) • Text",), ("7 DRUG INTERACTIONS Text",), ("Text",)], "t string")
    assert {r.v for r in h.select(T.strip_heading(F.col("t")).alias("v")).collect()} == {"Text"}
    p = spark.createDataFrame([("Take 5 mg. Then stop. See No. 5. Piano. Next! (Yes) e.G. Five",), ("",), (None,)], "t string")
    assert [r.v for r in p.select(T.plain_sentences(F.col("t")).alias("v")).collect()] == [["Take 5 mg. Then stop.", "See No. 5.", "Piano. Next!", "(Yes) e.G. Five"], [], None]


def test_mentions(spark):
    df = spark.createDataFrame([(1, "Foo and BARistas"), (2, None), (3, "x" * 100_000)], "i int, t string")
    names = spark.createDataFrame([("bar",), ("foo",), ("foo",), (None,)], "n string")
    assert {r.i: r.mentioned for r in V.mentions(df, "t", names).collect()} == {1: ["bar", "foo"], 2: [], 3: []}
    assert V.mentions(df, "t", names.limit(0)).where("size(mentioned) > 0").count() == 0
    with pytest.raises(ValueError):
        V.mentions(df, "t", names, "i")
