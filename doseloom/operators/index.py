"""A keyword index that is kept: postings by term, documents without their texts, texts by document, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, tokens
from .search import B, K1

#: Folders over which postings are spread by hash of the term, and texts by hash of the document; most hits of a request.
BUCKETS, MOST_HITS = 16, 50


def _bucket(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str, name: str, kind: str | None = None) -> DataFrame:
    """A table of the index; its columns are given, as an empty one has no file to tell them."""
    kind = kind or spark.read.parquet(f"{path}/docs").schema["doc_id"].dataType.simpleString()
    columns = {"postings": f"term string, doc_id {kind}, n_terms int, tf int, bucket int", "terms": "term string, df bigint, bucket int", "bodies": f"doc_id {kind}, body string, bucket int"}
    return spark.read.schema(columns[name]).parquet(f"{path}/{name}")


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lean: list[str] | None = None) -> None:
    """Writes path/postings (term, doc_id, tf, n_terms, by bucket of the term), path/terms (term, df), path/docs (doc_id, n_terms and the
    lean columns), path/bodies (doc_id, body, by bucket) and path/stats (n_docs, mean_terms).

    Frequencies come from the written postings. A null or empty text has no words and counts as a document of length 0. Documents with a null id are left out; ids must be unique.
    """
    spark = docs.sparkSession
    kept = docs.where(F.col(doc_id).isNotNull())
    words = kept.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    counted = words.select("doc_id", F.size("w").alias("n_terms"), F.explode("w").alias("term")).groupBy("term", "doc_id", "n_terms").agg(F.count("*").cast("int").alias("tf"))
    counted.withColumn("bucket", _bucket("term")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    posted = _table(spark, path, "postings", docs.schema[doc_id].dataType.simpleString())
    posted.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    kept.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).alias("n_terms"), *(lean or [])).write.mode("overwrite").parquet(f"{path}/docs")
    kept.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), _bucket(F.col(doc_id)).alias("bucket")).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bodies")
    spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("mean_terms")).write.mode("overwrite").parquet(f"{path}/stats")


#: Words of all queries that are read as a filter of folders and row groups; more are joined.
MANY_WORDS = 5_000


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, facet: Column | None = None, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents (MOST_HITS at most) for each query, best first, ties by doc_id.

    Only the folders and rows of the queries' words are read. Statistics are those of all documents, also where a facet (over
    the lean columns) filters the hits. A query without words lists the facet's documents in order of doc_id with score 0.
    """
    k = max(1, min(k, MOST_HITS))
    words = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokens(F.col(query))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket("term"))
    few = asked.limit(MANY_WORDS + 1).collect()
    posted, terms = _table(spark, path, "postings"), _table(spark, path, "terms")
    if len(few) <= MANY_WORDS:  # one look at the queries tells which folders and rows to read
        buckets, sought = sorted({r.bucket for r in few if r.term is not None}), sorted({r.term for r in few if r.term is not None})
        posted, terms = (t.where(F.col("bucket").isin(buckets) & F.col("term").isin(sought) if sought else F.lit(False)) for t in (posted, terms))
        asked = spark.createDataFrame(few, asked.schema) if few else asked
        blank = [r.query_id for r in few if r.term is None]
    else:
        blank = None
    wanted = asked.where("term is not null").select("query_id", "term", "times")
    stats = spark.read.schema("n_docs bigint, mean_terms double").parquet(f"{path}/stats").first()
    n_docs, mean = F.lit(stats.n_docs), F.lit(stats.mean_terms)
    weighted = wanted.join(terms.select("term", "df"), "term")
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / mean)
    scored = posted.join(weighted, "term")
    if facet is not None:
        scored = scored.join(spark.read.parquet(f"{path}/docs").where(facet).select("doc_id"), "doc_id", "left_semi")
    hits = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * idf * F.col("tf") * (K1 + 1) / norm), 6).alias("score")).where("score > 0")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    ranked = ranked.select("query_id", "rank", "doc_id", "score")
    if blank == []:
        return ranked
    docs = spark.read.parquet(f"{path}/docs")
    first = (docs if facet is None else docs.where(facet)).select("doc_id").orderBy("doc_id").limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("doc_id")))
    listed = asked.where("term is null").select("query_id").join(first).select("query_id", "rank", "doc_id", F.lit(0.0).alias("score"))
    return ranked.unionByName(listed)


def with_snippets(spark: SparkSession, path: str, hits: DataFrame, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """hits with a snippet of each document for its query; texts are read after the ranking, only from the folders of the hits
    (hits are few: MOST_HITS a query), '' where there is none."""
    asked = queries.select(F.col(query_id).alias("query_id"), tokens(F.col(query)).alias("terms"))
    keyed = hits.withColumn("bucket", _bucket("doc_id"))
    bodies = _table(spark, path, "bodies").join(F.broadcast(keyed.select("bucket").distinct()), "bucket", "left_semi")
    met = keyed.join(bodies, ["bucket", "doc_id"], "left").join(asked, "query_id")
    return met.select(*hits.columns, snippet(F.col("body"), F.col("terms")).alias("snippet"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_terms, terms (map of term to frequency): the index by document again."""
    posted = _table(spark, path, "postings").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    empty = F.create_map().cast("map<string,int>")
    return spark.read.parquet(f"{path}/docs").select("doc_id", "n_terms").join(posted, "doc_id", "left").withColumn("terms", F.coalesce("terms", empty))
