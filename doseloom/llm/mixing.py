"""Mixing sources to target shares of the tokens, in a low-discrepancy order of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from .tokens import TOKENIZER, TOKENIZERS, count_tokens

#: Sources that a mixture may have; their names and shares are part of the plan.
MAX_SOURCES = 1_000
#: Slots ranked in one window, and tokens of one source that are put in order in one window, on average.
SLOT_CHUNK, BUCKET_TOKENS = 1 << 16, 50_000_000
_BITS = 48


def van_der_corput(i: Column) -> Column:
    """i's bits mirrored at the point: 1/2, 1/4, 3/4, 1/8, ... for 1, 2, 3, 4, ..."""
    return F.conv(F.reverse(F.lpad(F.bin(i), _BITS, "0")), 2, 10).cast("double") / float(1 << _BITS)


class Mixture:
    """The result: `rows` with the placed documents, `report` with one row per source of the targets."""

    def __init__(self, rows: DataFrame, report: DataFrame):
        self.rows, self.report = rows, report


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 4096, seed: int = 0, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> Mixture:
    """Documents of several sources combined so that each has its target share of the tokens.

    docs needs a column source; targets has source, target_share and max_repeats (at most 1,000 sources;
    their shares are taken relative to their sum; a null max_repeats counts as 1). The mixture has as many
    tokens as all documents with a source. Each source's documents are put in a shuffled order, joined end to
    end (again for each repeat) and cut into blocks of equal tokens; slot i of the mixture goes to the source
    whose part of the cumulative shares holds the i-th van der Corput point, and the slots of a source take its
    blocks in turn. A source that has too few tokens even with all repeats leaves its last slots empty, and the
    report says so. A document belongs to the block in which it starts.

    rows: doc_id, source, repeat_no (from 1), slot (order of the mixture), place (order within the slot), n_tokens.
    report: source, target_share, max_repeats, supply_tokens, target_tokens, placed_tokens, reached_share, repeats, short.
    Documents with null source or one not in the targets are not placed (the former don't count for the total,
    the latter do). Null texts have 0 tokens. Repeated rows are documents of their own. A source listed twice
    is a ValueError; no documents at all give an empty mixture.
    """
    spark = docs.sparkSession
    wanted = targets.select("source", F.col("target_share").cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).where("source is not null and target_share > 0").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES or len({r[0] for r in wanted}) < len(wanted):
        raise ValueError(f"the targets must hold at most {MAX_SOURCES} sources, each once")
    wanted = sorted(wanted)
    whole = sum(r[1] for r in wanted) or 1.0
    columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(f"`{text}`").alias("text")).where("source is not null")
    sized = cut_lineage(count_tokens(columns, "text", "n_tokens", tokenizer, folder).withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    # tokens of all sources together, and of those wanted
    named = F.when(F.col("source").isin([r[0] for r in wanted]), F.col("source")) if wanted else F.lit(None).cast("string")
    supply = {r[0]: r[1] for r in sized.groupBy(named.alias("source")).agg(F.sum("n_tokens")).collect()}
    total = sum(supply.values())
    slots = -(-total // block_tokens)
    rows_of = [(r[0], r[1] / whole, r[2], supply.get(r[0], 0), total * r[1] / whole) for r in wanted]
    facts = spark.createDataFrame(rows_of, "source string, target_share double, max_repeats long, supply_tokens long, target_tokens double").coalesce(1)
    # slots: source by cumulative share, rank by chunk and within it
    point, at, source = van_der_corput(F.col("slot")), 0.0, F.lit(wanted[-1][0] if wanted else None).cast("string")
    cases = []
    for name, share, *_ in rows_of:
        at += share
        cases.append((at, name))
    for edge, name in reversed(cases[:-1]):
        source = F.when(F.col("u") < edge, name).otherwise(source)
    taken = spark.range(1, slots + 1).select(F.col("id").alias("slot")).withColumn("u", point).withColumn("source", source).withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK)).drop("u")
    before = taken.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = taken.join(before.hint("merge"), ["source", "chunk"]).withColumn("block", F.col("offset") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1).select("source", "block", "slot")
    # (the tables of slots and offsets grow with the corpus: they are merged, never sent to every task)
    # documents: place in the shuffled order of their source, by bucket and within it
    buckets = max(16, -(-total // BUCKET_TOKENS))
    mine = sized.where(F.col("source").isin([r[0] for r in wanted]) if wanted else F.lit(False)).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    ahead = mine.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = mine.join(ahead.hint("merge"), ["source", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = facts.select("source", "max_repeats", "supply_tokens", F.least("max_repeats", F.ceil((F.col("target_tokens") + 2 * block_tokens) / F.greatest("supply_tokens", F.lit(1)))).cast("long").alias("passes"))
    again = placed.join(F.broadcast(own), "source").withColumn("repeat", F.explode(F.expr("sequence(0L, greatest(passes, 1L) - 1L)"))).withColumn("from", F.col("start") + F.col("repeat") * F.col("supply_tokens")).withColumn("block", F.floor(F.col("from") / block_tokens))
    rows = again.join(ranked.hint("merge"), ["source", "block"]).select("doc_id", "source", (F.col("repeat") + 1).cast("int").alias("repeat_no"), "slot", (F.col("from") % block_tokens).cast("int").alias("place"), "n_tokens")
    reached = rows.groupBy("source").agg(F.sum("n_tokens").alias("placed_tokens"), F.max("repeat_no").alias("repeats"))
    report = facts.join(reached, "source", "left").na.fill(0, ["placed_tokens", "repeats"])
    report = report.select("*", (F.col("placed_tokens") / F.sum("placed_tokens").over(Window.partitionBy(F.lit(1)))).alias("reached_share"), (F.col("supply_tokens") * F.col("max_repeats") < F.col("target_tokens")).alias("short"))
    return Mixture(rows, report)
