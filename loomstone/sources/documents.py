"""Text documents and JSON lines as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of documents that are read as text.
TEXT_SUFFIXES = ("md", "markdown", "txt", "text", "rst")


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file of a folder (top level only), or one file.

    Files of other kinds and files that are no UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "content")
    wanted = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).isin(*TEXT_SUFFIXES)
    rows = files.where(wanted).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where("text is not null")


def document_ids(documents: DataFrame) -> DataFrame:
    return documents.withColumn("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12)))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw): the complete lines of JSON-lines traces.  A last line
    without its line end is torn and left out, as are lines that are no JSON."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("t"))
    lines = whole.select("source", F.posexplode(F.split(F.regexp_extract("t", r"(?s)^(.*\n)?", 1), "\n")).alias("seq", "raw"))
    return lines.where(F.col("raw").rlike(r"^\s*\{") & F.try_parse_json("raw").isNotNull()).select("source", F.col("seq").cast("long").alias("seq"), "raw")


def write_by_scope(df: DataFrame, path: str, scope: str = "scope") -> None:
    """Partitioned by scope, so that a scope is read without the others."""
    df.write.mode("append").partitionBy(scope).parquet(path)
