"""Keyword search: postings, statistics, BM25 with facets, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.text import tokens

#: Fixed values of the ranking function.
K1, B = 1.2, 0.75
#: Different words of all queries that are sought within each row; with more of them all words are counted.
MANY_WORDS = 5_000


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf. With `only` (column term), terms outside it are dropped before the shuffle."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))
    if only is not None:
        words = words.join(only.select("term").distinct(), "term", "left_semi")
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """term, df over (document, term) rows."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_terms of every document; an empty or null text has 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).alias("n_terms"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, term, times: a term that a query holds twice counts twice."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", facet: Column | None = None, k: int | None = 10) -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents for each query (all with k=None), best first, ties by doc_id.

    Document count, frequencies and mean length come from all documents, also where a facet filters the hits. Only
    documents with a score above 0 are hits; a query without words has none. Postings are cut to the queries' terms
    before they are shuffled, and scores are summed per query and document with partial aggregation.
    """
    wanted = query_terms(queries, query_id, query)
    words = [r.term for r in wanted.select("term").distinct().limit(MANY_WORDS + 1).collect()]
    seen = F.lit(True) if facet is None else F.coalesce(facet, F.lit(False))
    split = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"), seen.alias("seen"))
    kept = F.filter("w", lambda x: x.isin(words)) if len(words) <= MANY_WORDS else F.col("w")  # the queries' words only, within the row
    # texts are read and split once; lengths, statistics and postings come from what is kept of them
    read = cut_lineage(split.select("doc_id", "seen", F.size("w").alias("n_terms"), kept.alias("kept")))
    posted = read.where(F.size("kept") > 0).select("doc_id", "n_terms", "seen", F.explode("kept").alias("term")).groupBy("doc_id", "n_terms", "seen", "term").agg(F.count("*").alias("tf"))
    stats = read.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("mean")).first()
    n_docs, mean = F.lit(stats.n_docs), F.lit(stats.mean)
    scored = posted.where("seen").join(wanted.join(document_frequencies(posted), "term"), "term")
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / mean)
    hits = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * idf * F.col("tf") * (K1 + 1) / norm), 6).alias("score")).where("score > 0")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "doc_id", "score")


def has_facets(tags: Column, selected: list[str], mode: str = "and") -> Column:
    """Whether a document's tags hold all ('and') or any ('or') of the selected ones; none selected holds always."""
    if not selected:
        return F.lit(True)
    chosen = F.array(*[F.lit(x) for x in selected])
    return F.size(F.array_except(chosen, tags)) == 0 if mode == "and" else F.arrays_overlap(chosen, tags)
