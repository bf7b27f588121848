from pyspark.sql import functions as F

from doseloom.operators import reports


def test_titles_and_reasons(spark):
    df = spark.createDataFrame([("pair", ["A", "B"], 2, None, "bleeding", "warnings", [3]), ("pair", ["A", "B", "C"], 3, "azoles", "x", "", []), ("group", ["A", "B"], 2, "opioids", "sedation", None, None)], "kind string, names array<string>, n int, plural string, risk string, section string, rows array<int>")
    got = df.select(reports.alert_title(F.col("kind"), F.col("names"), F.col("n"), F.col("plural"), F.col("risk")).alias("t"), reports.alert_basis(F.col("section"), F.lit("A"), F.col("risk"), F.col("rows").cast("array<string>")).alias("b")).collect()
    assert [r.t for r in got] == ["A with B: bleeding", "A with 2 azoles: x", "2 opioids: sedation"]
    assert [r.b for r in got] == ["The Warnings section of the A label addresses this combination: bleeding. Clinical rulebook row 3.", "Class rule: x.", "Class rule: sedation."]
    assert spark.range(1).select(reports.grade_name(F.lit("E")).alias("g")).first().g == "Avoid combination"


def test_report(spark):
    meds = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "list_id int, ord int, text string")
    alerts = spark.createDataFrame([(1, 1, "mild", "A"), (1, 2, "bad", "E"), (1, 3, "bad too", "E")], "list_id int, ord int, text string, grade string")
    rows = [(r.list_id, r.part, r.place, r.text) for r in reports.report_rows({"medication": meds, "alert": alerts}, "list_id", "Ask.").collect()]
    assert sorted(rows) == [(1, "alert", 1, "bad"), (1, "alert", 2, "bad too"), (1, "alert", 3, "mild"), (1, "medication", 1, "a"), (1, "medication", 2, "b"), (1, "notice", 1, "Ask."), (2, "medication", 1, "c"), (2, "notice", 1, "Ask.")]
    members = spark.createDataFrame([(1, "x", "warnings", "w"), (1, "y", "contraindications", "c"), (1, "z", "boxed_warning", ""), (2, "q", "", "")], "alert int, drug string, section string, sentence string")
    assert sorted((r.alert, r.drug) for r in reports.strongest_member(members, "alert", ["contraindications", "boxed_warning", "warnings"]).collect()) == [(1, "y"), (2, "q")]


def test_names(spark):
    df = spark.createDataFrame([("Xanax XR", "xanax", True), ("Seroquel-XR", "Seroquel", True), ("lithium", "Lithium carbonate", True), ("lith", "lithium", False), ("", "a", False), (None, "a", None)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", reports.same_name(F.col("a"), F.col("b")).alias("got")).collect())
