"""Sinks: new tables are written beside old ones, never over a path that is being read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, tenant: str = "user_id") -> None:
    """Chunks by tenant, so that a tenant's search reads its own files."""
    chunks.write.partitionBy(tenant).mode("errorifexists").parquet(path)


def write_sidecars(docs: DataFrame, path: str) -> None:
    docs.write.mode("errorifexists").json(path)


def bucketed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by its join key: joins of two such tables need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).mode("errorifexists").saveAsTable(table)


def write_index(chunks: DataFrame, path: str, vector: str = "vector", sparse: str | None = "terms", chunk_id: str = "chunk_id", tenant: str = "user_id") -> None:
    """A search index by tenant: dense vectors, and postings of a map column of term weights where there is one."""
    chunks.select(tenant, chunk_id, vector).write.partitionBy(tenant).mode("errorifexists").parquet(f"{path}/vectors")
    if sparse is not None and sparse in chunks.columns:
        chunks.select(tenant, chunk_id, F.explode(sparse).alias("term", "weight")).write.partitionBy(tenant).mode("errorifexists").parquet(f"{path}/postings")
