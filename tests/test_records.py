import pytest
from pyspark.sql import functions as F

from doseloom.__main__ import main
from doseloom.operators import records, vocabulary
from doseloom.streaming import incremental


def test_profiles(spark):
    s = {
        "indications_and_usage": ["1 INDICATIONS AND USAGE Acmene is indicated for pain ( 5.1 ) in adults [see Warnings]. [Short fragment of some length]. " + "x" * 500 + ". Is it for short-term use only by all of them. Fourth sentence is left out of it."],
        "clinical_pharmacology": ["It binds to the receptor very tightly. Nothing is known about its colour."],
        "dosage_and_administration": ["The recommended dose is 10 mg once daily. The recommended dose is small. The maximum recommended dose is 40 mg daily. The recommended dose is 10 mg once daily. Use for up to 14 days in all patients."],
        "warnings": ["In trials, short-term use was studied in patients."],
    }
    df = spark.createDataFrame([("a", s), ("b", {}), ("c", None)], "id string, sections map<string,array<string>>")
    got = {r.id: r for r in records.label_profiles(df, "id").collect()}
    a = got["a"]
    assert a.indications[0] == "Acmene is indicated for pain in adults." and len(a.indications) == 3 and a.mechanism == ["It binds to the receptor very tightly."]
    assert a.dose_recommended == ["The recommended dose is 10 mg once daily."] and a.dose_maximum == ["The maximum recommended dose is 40 mg daily."]
    assert a.duration == ["Use for up to 14 days in all patients.", "Is it for short-term use only by all of them."]
    assert got["b"].indications == [] and got["c"].duration == []


def test_drug_profiles_and_records(spark):
    r = spark.createDataFrame([("s1", ["Lithium carbonate"]), ("s2", [])], "set_id string, base_ingredients array<string>")
    classes = spark.createDataFrame([("c", "Mood")], "class string, name string")
    members = spark.createDataFrame([("c", "lithium")], "class string, member string")
    refs = spark.createDataFrame([("lithium carbonate", "https://host.example/l")], "base string, url string")
    profiles = spark.createDataFrame([("s1", "text")], "set_id string, label string")
    most = spark.createDataFrame([("lithium carbonate", 1800.0)], "base string, most double")
    got = {x.set_id: x for x in records.drug_profiles(r, classes, members, refs, profiles, most).collect()}
    assert got["s1"].classes == ["Mood"] and got["s1"].ceilings[0].most == 1800.0 and got["s1"].label == "text" and got["s2"].classes == [] and got["s2"].ceilings == []
    labels = spark.createDataFrame([("s1", "2024", ["B"], None, ["b", "A", "B"], None, None, "C-IV")], "set_id string, effective_time string, brand_name array<string>, generic_name array<string>, substance_name array<string>, route array<string>, pharm_class_epc array<string>, controlled_substance string")
    evidence = spark.createDataFrame([("s1", "T01", "f", "x"), ("s1", "T02", "f", "y"), ("s1", "T14", "f", "")], "set_id string, term string, field_name string, sentence string")
    x = records.checker_records(labels, evidence).first()
    assert x.ingredient_set == ["A", "B"] and x.schedule == "IV" and len(x.evidence) == 3 and x.generic_names == []
    notes = records.label_notes(evidence.withColumn("n", F.lit(1)), "set_id", "n").collect()
    assert [(n.term, n.name) for n in notes] == [("T01", "Boxed Warning")]


def test_gold(spark):
    sets = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "set_id string")
    cells = records.gold_template(sets, vocabulary.terms(spark))
    assert cells.count() == 34 and records.filled_gold(cells).count() == 0
    edits = spark.createDataFrame([("s1", "T01", True, "why"), ("s9", "TXX", None, "new")], "set_id string, term string, gold boolean, rationale string")
    done = records.set_gold(cells, edits)
    assert done.count() == 35 and {(r.set_id, r.term, r.gold) for r in records.filled_gold(done).collect()} == {("s1", "T01", True), ("s9", "TXX", False)}
    assert [(r.term, r.problem) for r in records.gold_problems(done, vocabulary.terms(spark)).collect()] == [("TXX", "unknown term")]


def test_collection(spark):
    df = spark.createDataFrame([("s", "l1", ["a", "b"]), ("s", "l1", ["b", "a"]), (None, "l2", []), ("", "l3", None)], "set_id string, label_id string, ingredient_set array<string>")
    got = {(r.problem, r.key): r.n for r in records.collection_problems(df).collect()}
    assert got == {("repeated label", "l1"): 2, ("repeated ingredient set", "a|b"): 2, ("no set id", "l2"): 1, ("no set id", "l3"): 1, ("no ingredients", "l2"): 1, ("no ingredients", "l3"): 1}


def test_session_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-05 00:00:00")], "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    found = incremental.sessions(incremental.follow(spark, str(tmp_path / "in"), rows.schema), "t", "1 hour", "30 minutes", ["u"])
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.u, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2)]


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", "facet_none", folder, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 1
    assert main(["run", "nothing", folder]) == 2
    assert main(["index", folder, str(tmp_path / "i")]) == 0 and main(["search", str(tmp_path / "i"), "liver", "--limit", "2"]) == 0
    with pytest.raises(SystemExit):
        main([])
