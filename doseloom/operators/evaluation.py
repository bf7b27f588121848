"""Measures of rankings and of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(queries: DataFrame, hits: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, p_at_k, r_at_k, ap, ndcg_at_k for every query, rounded to 6 digits.

    hits: query_id, doc_id, rank; judged: query_id, doc_id, grade (above 0 is relevant). Precision divides by k even
    if fewer are returned; the ideal order of nDCG is made from all judged documents. Queries without hits or without
    relevant documents have 0.
    """
    relevant = judged.where("grade > 0").select("query_id", "doc_id", "grade")
    found = hits.join(relevant, ["query_id", "doc_id"], "left").withColumn("rel", F.col("grade").isNotNull().cast("int"))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = found.withColumn("so_far", F.sum("rel").over(running))
    top = F.col("rank") <= k
    gain = lambda g, r: F.coalesce(g, F.lit(0.0)) / F.log2(r + 1.0)
    per = scored.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("hits_k"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(top, gain(F.col("grade").cast("double"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = relevant.withColumn("ideal_rank", ideal_rank).groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("ideal_rank") <= k, gain(F.col("grade").cast("double"), F.col("ideal_rank"))).otherwise(0.0)).alias("idcg"))
    joined = queries.select("query_id").distinct().join(per, "query_id", "left").join(ideal, "query_id", "left").na.fill(0)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return joined.select("query_id", F.round(F.col("hits_k") / k, 6).alias("p_at_k"), share(F.col("hits_k"), F.col("n_rel")).alias("r_at_k"), share(F.col("ap_sum"), F.col("n_rel")).alias("ap"), share(F.col("dcg"), F.col("idcg")).alias("ndcg_at_k"))


def confusion(pairs: DataFrame, label: str, predicted: Column, gold: Column) -> DataFrame:
    """tp, fp, fn, tn for each label."""
    return pairs.groupBy(label).agg(F.count_if(predicted & gold).alias("tp"), F.count_if(predicted & ~gold).alias("fp"), F.count_if(~predicted & gold).alias("fn"), F.count_if(~predicted & ~gold).alias("tn"))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """counts with prec, recall and f1 (0 where there is nothing to divide by), rounded to 6 digits."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(share(2 * p * r, p + r), 6).alias("f1"))


def cohen_kappa(counts: DataFrame) -> DataFrame:
    """One row: n, observed and expected agreement, kappa of two-way counts summed over all labels."""
    s = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    observed = (F.col("tp") + F.col("tn")) / n
    expected = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    return s.select(n.cast("bigint").alias("n"), F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.coalesce(F.try_divide(observed - expected, 1 - expected), F.lit(0.0)), 6).alias("kappa"))


def mean_measures(measures: DataFrame) -> DataFrame:
    """One row: n_queries and the mean of each measure (mean average precision among them), rounded to 6 digits; 0 without queries."""
    names = [c for c in measures.columns if c != "query_id"]
    return measures.agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}" if c != "ap" else "map") for c in names])


def padded(counts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """counts with a row of zeros for each label that has none."""
    return labels.select(label).distinct().join(counts, label, "left").na.fill(0)


def agreement(rows: DataFrame, a: str, b: str, grades: list) -> DataFrame:
    """a, b, n for every two grades, those that never meet with 0."""
    kind = rows.schema[a].dataType.simpleString()
    every = rows.sparkSession.createDataFrame([(x, y) for x in grades for y in grades], f"{a} {kind}, {b} {kind}")
    return every.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").na.fill(0, ["n"])


def kappa(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of a matrix of agreement (a few cells)."""
    total = matrix.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = matrix.groupBy(F.col(a).alias("g")).agg(F.sum("n").alias("x")), matrix.groupBy(F.col(b).alias("g")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "g").agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("e"))
    observed, expected = F.col("same") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return total.join(chance).select(F.col("t").cast("bigint").alias("n"), F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.coalesce(F.try_divide(observed - expected, 1 - expected), F.lit(0.0)), 6).alias("kappa"))


def pack_metrics(items: DataFrame, grade: str, hit: str, seconds: str) -> DataFrame:
    """grade, items, hits, recall, median_seconds, max_seconds of graded items."""
    return items.groupBy(grade).agg(F.count("*").alias("items"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("recall"), F.median(seconds).alias("median_seconds"), F.max(seconds).alias("max_seconds"))


def scored_items(expected: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, status: 'HIT' if an alert of the list holds all of the item's drugs at its grade or above, 'PARTIAL' if one holds
    some of them or a lower grade, else 'MISS'.

    expected: keys, item, drug, severity; alerts: keys, alert, drug, severity. Items and alerts meet by drug and are counted.
    """
    size = expected.groupBy(*keys, "item").agg(F.countDistinct("drug").alias("size"), F.max("severity").alias("want"))
    met = expected.select(*keys, "item", "drug").distinct().join(alerts.select(*keys, "alert", "drug", F.col("severity").alias("got")).distinct(), [*keys, "drug"]).groupBy(*keys, "item", "alert").agg(F.count("*").alias("met"), F.max("got").alias("got"))
    both = met.join(size, [*keys, "item"]).groupBy(*keys, "item").agg(F.max(F.when((F.col("met") == F.col("size")) & (F.col("got") >= F.col("want")), 2).otherwise(1)).alias("s"))
    return size.join(both, [*keys, "item"], "left").select(*keys, "item", F.when(F.col("s") == 2, "HIT").when(F.col("s") == 1, "PARTIAL").otherwise("MISS").alias("status"))


def metric_row(name: Column, value: Column) -> Column:
    """A measure for a report: | name | 0.123 |."""
    return F.format_string("| %s | %.3f |", name, value)


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A small table (a report) in Markdown; it is collected, so give aggregates only."""
    lines = [f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect())]) + "\n"
