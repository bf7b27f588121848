"""Reading bulk JSON, manifests and tables of queries and judgments."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters read from a member at once.
CHUNK = 1 << 20


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """url, display_name, size_mb, records and file of every part that a manifest names; a url without a last segment is an error."""
    schema = "results struct<drug:struct<label:struct<export_date:string,partitions:array<struct<file:string,display_name:string,size_mb:string,records:long>>>>>"
    parts = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results.drug.label.partitions").alias("p"))
    name = F.try_element_at(F.split(F.rtrim(F.col("p.file"), F.lit("/")), "/"), F.lit(-1))
    return parts.select(F.col("p.file").alias("url"), "p.display_name", F.col("p.size_mb").try_cast("double").alias("size_mb"), "p.records", F.when(name != "", name).otherwise(F.raise_error(F.lit("a manifest url has no last segment"))).alias("file"))


def export_date(spark: SparkSession, path: str) -> DataFrame:
    """One row: export_date of a manifest."""
    return spark.read.schema("results struct<drug:struct<label:struct<export_date:string>>>").json(path, multiLine=True).select("results.drug.label.export_date")


def elements(chunks: Iterator[str], key: str) -> Iterator[dict]:
    """Elements of the array under a key, decoded one after another with bounded memory; a cut-off tail is left out."""
    decoder, buffer, inside = json.JSONDecoder(), "", False
    mark = f'"{key}"'
    for chunk in chunks:
        buffer += chunk
        if not inside:
            at = buffer.find(mark)
            start = buffer.find("[", at + len(mark)) if at >= 0 else -1
            if start < 0:
                buffer = buffer if at >= 0 else buffer[-len(mark) :]
                continue
            buffer, inside = buffer[start + 1 :], True
        while True:
            buffer = buffer.lstrip(" \t\r\n,")
            if not buffer:
                break
            if buffer[0] == "]":
                return
            try:
                value, end = decoder.raw_decode(buffer)
            except ValueError:
                break  # the element goes on in the next chunk
            yield value
            buffer = buffer[end:]


def _members(path: str) -> Iterator[tuple[str, Iterator[str]]]:
    """Name and text of each JSON member of an archive, or of a plain file, read piece by piece."""

    def pieces(stream) -> Iterator[str]:
        reader = io.TextIOWrapper(stream, "utf-8")
        while chunk := reader.read(CHUNK):
            yield chunk

    system, name = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))
    with system.open_input_file(name) as file:
        if zipfile.is_zipfile(file):
            with zipfile.ZipFile(file) as archive:
                for member in archive.namelist():
                    if member.endswith(".json"):
                        with archive.open(member) as stream:
                            yield member, pieces(stream)
        else:
            file.seek(0)
            yield name.rpartition("/")[2], pieces(file)


def zipped_records(spark: SparkSession, path: str, key: str = "results") -> DataFrame:
    """file, member, record (JSON text) of every element in the array of each zipped or plain JSON file.

    Only the files' names go through Spark; a task opens its file where it lies and holds one element and one piece of
    text at a time, however large the file is.
    """
    # one task a file: archives can't be split
    names = spark.read.format("binaryFile").load(path).select("path")
    count = names.count()
    spread = names.repartition(max(1, min(count, 10_000)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, member: str, held: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array([member] * len(held), pa.string()), pa.array(held, pa.string())], ["file", "member", "record"])

        for part in batches:
            for name in part.column(0).to_pylist():
                for member, chunks in _members(name):
                    held: list[str] = []
                    size = 0
                    for value in elements(chunks, key):
                        held.append(json.dumps(value, ensure_ascii=False))
                        size += len(held[-1])
                        if size > 4 * CHUNK:
                            yield batch(name, member, held)
                            held, size = [], 0
                    yield batch(name, member, held)

    return spread.mapInArrow(read, "file string, member string, record string")


def incomplete(parts: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Parts of a manifest whose file is missing or has less than 99 % of its size."""
    there = spark.read.format("binaryFile").load(folder).select(F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("file"), "length")
    return parts.join(there, "file", "left").where("length is null or length < size_mb * 1000000 * 0.99").drop("length")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, unreadable ones have nulls."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id and query, parted at the first tab; lines without one are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("query_id"), parts[1].alias("query"))


def judgments_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade; of lines for one pair the last counts."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 3).select(parts[0].alias("query_id"), parts[1].alias("doc_id"), parts[2].try_cast("double").alias("grade"), "n")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", "n").alias("grade"))


def answer_keys(spark: SparkSession, path: str) -> DataFrame:
    """list_id, record (JSON text) of Markdown files in which a heading names a list (L01) and a fenced JSON block follows it."""
    text = spark.read.text(path, wholetext=True)
    blocks = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(#+ L[0-9]+.*?```json\s.*?```)"), F.lit(1)))
    block = text.select(blocks.alias("b"))
    return block.select(F.regexp_extract("b", r"^#+ (L[0-9]+)", 1).alias("list_id"), F.regexp_extract("b", r"(?s)```json\s+(.*?)\s*```", 1).alias("record"))


def by_keys(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows of a few keys, as a filter that reaches the scan."""
    return rows.where(F.col(key).isin(wanted))


def query_url(base: str, terms: Column, limit: Column) -> Column:
    """Address of a search: base?search=terms&limit=n, encoded."""
    return F.concat(F.lit(base + "?search="), F.url_encode(terms), F.lit("&limit="), limit.cast("string"))


def approximate_candidates(answers: DataFrame, body: str) -> DataFrame:
    """The other columns, concept, name, score, rank of each candidate in an answer (JSON text) to an approximate search; unreadable answers have none."""
    kind = "approximateGroup struct<candidate:array<struct<rxcui:string,name:string,score:string,rank:string>>>"
    others = [c for c in answers.columns if c != body]
    rows = answers.select(*others, F.explode(F.from_json(body, kind)["approximateGroup"]["candidate"]).alias("c"))
    return rows.select(*others, F.col("c.rxcui").alias("concept"), "c.name", F.col("c.score").try_cast("double").alias("score"), F.col("c.rank").try_cast("int").alias("rank"))


def related_names(answers: DataFrame, body: str) -> DataFrame:
    """The other columns, concept, name of each related concept in an answer, over all its groups."""
    kind = "relatedGroup struct<conceptGroup:array<struct<conceptProperties:array<struct<rxcui:string,name:string>>>>>"
    others = [c for c in answers.columns if c != body]
    groups = F.from_json(body, kind)["relatedGroup"]["conceptGroup"]["conceptProperties"]
    return answers.select(*others, F.explode(F.flatten(F.filter(groups, lambda x: x.isNotNull()))).alias("c")).select(*others, F.col("c.rxcui").alias("concept"), "c.name")
