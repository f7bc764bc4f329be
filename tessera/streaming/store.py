"""Ingest of a stream into several tables at once: a batch counts when its manifest row stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.vectors import hash_vector
from tessera.operators import graph
from tessera.operators.chunking import recursive_chunks
from tessera.operators.retrieval import term_postings
from tessera.sources.stores import stored

Part = Callable[[DataFrame, DataFrame], DataFrame]

#: What becomes of a batch, by table: from documents(doc_id, text, ...) and their chunks.
PARTS: dict[str, Part] = {
    "documents": lambda docs, chunks: docs,
    "chunks": lambda docs, chunks: chunks,
    "vectors": lambda docs, chunks: chunks.select("doc_id", "chunk_id", hash_vector(F.col("content")).alias("vector")),
    "postings": lambda docs, chunks: term_postings(chunks, "chunk_id", "content").join(chunks.select("chunk_id", "doc_id"), "chunk_id"),
    "appears": lambda docs, chunks: graph.token_entities(chunks, 5, "chunk_id", "content").join(chunks.select("chunk_id", "doc_id"), "chunk_id"),
}


def write_batch(batch: DataFrame, out: str, number: int, parts: dict[str, Part] | None = None) -> None:
    """Write one batch into all tables, each into its own folder of the batch's number, then the manifest row that makes it count.

    Running again overwrites what a lost run left, so that a batch stands once, however often it is tried.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{out}/_batch/batch={number}")
    docs = spark.read.parquet(f"{out}/_batch/batch={number}")
    recursive_chunks(docs).write.mode("overwrite").parquet(f"{out}/_chunks/batch={number}")
    chunks = spark.read.parquet(f"{out}/_chunks/batch={number}")
    for name, part in (parts or PARTS).items():
        part(docs, chunks).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    row = docs.agg(F.count("*").alias("n_documents")).crossJoin(chunks.agg(F.count("*").alias("n_chunks")))  # one row each
    row.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")


def ingest_all(docs: DataFrame, out: str, checkpoint: str, parts: dict[str, Part] | None = None) -> StreamingQuery:
    """A stream of documents into all tables; see ``write_batch``."""
    return docs.writeStream.foreachBatch(lambda b, n: write_batch(b, out, n, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove_documents(ids: DataFrame, out: str) -> None:
    """Take documents out of every table: tombstones up to the newest batch that counts, so that a later one can bring an id back."""
    done = stored(ids.sparkSession, f"{out}/manifest")
    newest = done.agg(F.max("batch")).first()[0] if done is not None else None
    if newest is not None:
        ids.select("doc_id").distinct().withColumn("until", F.lit(newest)).write.mode("append").parquet(f"{out}/tombstones")


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table's rows of batches in the manifest, less those of documents that were removed after."""
    rows = spark.read.parquet(f"{out}/{name}")
    done = spark.read.parquet(f"{out}/manifest").select(F.col("batch").alias("_done"))
    rows = rows.join(done, F.col("batch") == F.col("_done"), "left_semi")
    gone = stored(spark, f"{out}/tombstones")
    if gone is None:
        return rows
    gone = gone.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("until").alias("until"))
    return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("batch") <= F.col("until")), "left_anti")
