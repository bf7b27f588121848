import os

import duckdb
import pytest

import __spark_entry__ as entry
from doseloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_newest_labels_equal_sql(spark, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got = entry.queries()["p2_found"](spark, folder)
    rows = con.execute(SQL["p2_found"])
    columns = [d[0] for d in rows.description]
    assert sorted(map(tuple, rows.fetchall())) == sorted(tuple(r[c] for c in columns) for r in got.collect())


def test_documents_over_the_limit_are_those_cut(spark, folder):
    from doseloom.llm.tokens import encoding

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    long = {r.doc_id for r in docs if len(encoding().encode_ordinary(r.text or "")) > 512}
    assert {r.doc_id for r in entry.queries()["p9_found"](spark, folder).collect()} == long


def test_short_sources_are_those_of_the_rule(spark, folder):
    from doseloom.llm.tokens import encoding

    docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").select("source", "text").collect() if r.source is not None]
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(encoding().encode_ordinary(r.text or ""))
    total = sum(sizes.values())
    want = {r.source for r in spark.read.parquet(f"{folder}/mix_target.parquet").collect() if sizes.get(r.source, 0) * r.max_repeats < r.target_share * total}
    assert {r.source for r in entry.queries()["p8_found"](spark, folder).collect()} == want
