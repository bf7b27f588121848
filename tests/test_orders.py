import pytest
from pyspark.sql import functions as F

from doseloom.operators import evaluation, index, orders, search
from doseloom.sources import files, sinks


def test_orders(spark):
    df = spark.createDataFrame([(1, "C", 1), (1, "E", 2), (1, "C", 0), (2, None, 1)], "k int, grade string, o int")
    assert sorted((r.k, r.place, r.o) for r in orders.worst_first(df, ["k"], "grade", "o").collect()) == [(1, 1, 2), (1, 2, 0), (1, 3, 1), (2, 1, 1)]
    assert [r["values"] for r in orders.ordered_distinct(df, ["k"], "grade", "o").collect()] == [["C", "E"]]
    assert [r.o for r in orders.first_n(df, ["o", "k"], 2).collect()] == [0, 1]


def test_streams_and_changes(spark):
    a, b = spark.range(100).select(F.col("id").alias("v")), spark.range(5).select((F.col("id") + 1000).alias("v"))
    got = {r.v: r.ord for r in orders.concatenated([a, b], ["v"]).collect()}
    assert got == {**{i: i + 1 for i in range(100)}, **{1000 + i: 101 + i for i in range(5)}}
    x, y = spark.createDataFrame([(1,), (1,), (2,)], "v int"), spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted((r.side, r.v) for r in orders.changes(x, y).collect()) == [("first", 1), ("first", 2), ("second", 3)]


def test_index_equals_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red red blue", "a"), (2, "blue", "b"), (3, None, "a"), (4, "green red", "b"), (None, "red", "a"), (5, "", "a")], "doc_id long, text string, source string")
    path = str(tmp_path / "index")
    index.build_index(docs, path, lean=["source"])
    asked = spark.createDataFrame([(1, "red red"), (2, "blue green"), (3, "absent"), (4, " ")], "query_id int, query string")
    kept = docs.where("doc_id is not null")
    want = sorted(map(str, search.bm25(kept, asked).collect()))
    found = index.search_index(spark, path, asked)
    assert sorted(map(str, found.where("query_id < 4").collect())) == want and [r.doc_id for r in found.where("query_id = 4").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    part = index.search_index(spark, path, asked, facet=F.col("source") == "b")
    assert sorted(map(str, part.where("query_id < 4").collect())) == sorted(map(str, search.bm25(kept, asked, facet=F.col("source") == "b").collect()))
    assert {r.doc_id: r.snippet for r in index.with_snippets(spark, path, found.where("query_id = 1"), asked).collect()} == {1: "red red blue", 4: "green red"}
    assert index.search_index(spark, path, asked, k=0).where("query_id = 1").count() == 1
    assert {r.doc_id: r.terms for r in index.read_index(spark, path).collect()} == {1: {"red": 2, "blue": 1}, 2: {"blue": 1}, 3: {}, 4: {"green": 1, "red": 1}, 5: {}}
    index.build_index(docs.limit(0), path)
    assert index.search_index(spark, path, asked).count() == 0


def test_evaluation(spark):
    m = spark.createDataFrame([("a", 0.5, 1.0, 0.25, 0.1), ("b", 0.0, 0.0, 0.0, 0.0)], "query_id string, p_at_k double, r_at_k double, ap double, ndcg_at_k double")
    r = evaluation.mean_measures(m).first()
    assert (r.n_queries, r.mean_p_at_k, r.map) == (2, 0.25, 0.125) and evaluation.mean_measures(m.limit(0)).first().map == 0
    e = spark.createDataFrame([(1, "i", "x", 3), (1, "i", "y", 3), (1, "j", "x", 5), (1, "k", "q", 1)], "l int, item string, drug string, severity int")
    a = spark.createDataFrame([(1, "a1", "x", 4), (1, "a1", "y", 4), (1, "a1", "z", 4)], "l int, alert string, drug string, severity int")
    assert {r.item: r.status for r in evaluation.scored_items(e, a, ["l"]).collect()} == {"i": "HIT", "j": "PARTIAL", "k": "MISS"}
    assert evaluation.markdown_table(m.limit(1), ["query_id", "ap"]) == "| query_id | ap |\n| --- | --- |\n| a | 0.25 |\n"
    assert spark.range(1).select(evaluation.metric_row(F.lit("x"), F.lit(0.5)).alias("v")).first().v == "| x | 0.500 |"


def test_external_answers(spark):
    approx = '{"approximateGroup": {"candidate": [{"rxcui": "1", "name": "A", "score": "9.5", "rank": "1"}, {"rxcui": "2", "name": null, "score": "x", "rank": "2"}]}}'
    related = '{"relatedGroup": {"conceptGroup": [{"tty": "IN"}, {"conceptProperties": [{"rxcui": "7", "name": "Base"}]}]}}'
    df = spark.createDataFrame([("q", approx, related), ("r", "{bad", None)], "query string, a string, b string")
    assert [(r.query, r.concept, r.score, r["rank"]) for r in files.approximate_candidates(df.select("query", "a"), "a").collect()] == [("q", "1", 9.5, 1), ("q", "2", None, 2)]
    assert [(r.query, r.concept, r.name) for r in files.related_names(df.select("query", "b"), "b").collect()] == [("q", "7", "Base")]
    assert spark.range(1).select(files.query_url("https://host.example/api", F.lit("a b&c"), F.lit(5)).alias("v")).first().v == "https://host.example/api?search=a+b%26c&limit=5"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b/c", 2), ("", 3), (None, 4), ("..", 5)], "k string, n int")
    assert sinks.write_json_lines(df, str(tmp_path / "x")) == 5 and [r.k for r in sinks.safe_keys(df, "k").collect()] == ["a"]
    assert [r.n for r in files.by_keys(df, "k", ["a", "zz"]).collect()] == [1]
    with pytest.raises(Exception):
        files.zipped_records(spark, str(tmp_path / "none/*.zip")).collect()
