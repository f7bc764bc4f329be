"""Sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_type


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, doc_type, content)``: whole text and Markdown files."""
    t = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return t.select("path", file_type(F.col("path")).alias("doc_type"), F.col("value").alias("content"))


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata files, one JSON object each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def orphan_files(files: DataFrame, known: DataFrame, path: str = "path", known_path: str = "file_path") -> DataFrame:
    """Files that no metadata mentions."""
    return files.join(known.select(F.col(known_path).alias(path)), path, "left_anti")


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a word processor file, a line each; null if it can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, status, error)``: files that can't be read fail on their own."""

    return _docx(spark.read.format("binaryFile").load(path))


def _docx(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            text = [docx_text(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "content": text, "status": ["failed" if t is None else "completed" for t in text], "error": ["not a readable file" if t is None else None for t in text]})

    return files.select("path", "content").mapInPandas(run, "path string, content string, status string, error string")


def any_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, status, error)`` of all files of a folder by their type; those of other types fail on their own."""
    files = spark.read.format("binaryFile").load(path).withColumn("kind", file_type(F.col("path")))
    text = files.where(F.col("kind").isin("text", "markdown")).select("path", F.decode("content", "UTF-8").alias("content"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    other = files.where(~F.col("kind").isin("text", "markdown", "docx")).select("path", F.lit(None).cast("string").alias("content"), F.lit("failed").alias("status"), F.concat(F.lit("unsupported type: "), F.col("kind")).alias("error"))
    return text.unionByName(_docx(files.where("kind = 'docx'"))).unionByName(other)
