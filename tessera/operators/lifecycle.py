"""Document lifecycle on immutable tables: upserts, soft deletes, restores, purges. The clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.sizes import broadcast_small

RETENTION_DAYS = 30


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Base with changes merged in: the latest version of each key, changes before base rows of the same version."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = W.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base with the non-null fields of at most one change a key."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    both = base.join(c, key, "left")
    return both.select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in both.columns else F.col(x) for x in base.columns])


def days_since(ts: Column, now: Column) -> Column:
    """Full days gone by."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400)


def expired(rows: DataFrame, now: Column, deleted_at: str = "deleted_at", days: int = RETENTION_DAYS) -> DataFrame:
    """Soft-deleted rows past retention: more than ``days`` full days ago."""
    return rows.where(F.col(deleted_at).isNotNull() & (days_since(F.col(deleted_at), now) > days))


def recycle_bin(rows: DataFrame, now: Column, deleted_at: str = "deleted_at", days: int = RETENTION_DAYS) -> DataFrame:
    return rows.where(F.col(deleted_at).isNotNull() & (days_since(F.col(deleted_at), now) <= days))


def soft_delete(docs: DataFrame, ids: DataFrame, now: Column, key: str = "doc_id") -> DataFrame:
    """Docs with those of ``ids`` marked deleted."""
    d = docs.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    hit = F.coalesce("_gone", F.lit(False))
    return d.withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at"))}).drop("_gone")


def restore(docs: DataFrame, ids: DataFrame, now: Column, key: str = "doc_id", days: int = RETENTION_DAYS) -> DataFrame:
    """Docs with those of ``ids`` back, if they are within retention."""
    d = docs.join(ids.select(key).distinct().withColumn("_back", F.lit(True)), key, "left")
    hit = F.coalesce("_back", F.lit(False)) & F.col("deleted_at").isNotNull() & (days_since(F.col("deleted_at"), now) <= days)
    return d.withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "deleted_at": F.when(hit, F.lit(None)).otherwise(F.col("deleted_at"))}).drop("_back")


def delete_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def dedup_paths(rows: DataFrame, path: str = "file_path", key: str = "doc_id", order: str = "created_at") -> DataFrame:
    """One row a path, the newest; rows without a path all stay."""
    by = F.coalesce(F.col(path), F.concat(F.lit("__no_path__:"), F.col(key).cast("string")))
    w = W.partitionBy(by).orderBy(F.desc(order), key)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def recent_paths(rows: DataFrame, limit: int, path: str = "file_path", key: str = "doc_id", order: str = "created_at") -> DataFrame:
    """``dedup_paths`` of the newest ``limit`` rows: a path's older rows still take places of the limit, so fewer may be left."""
    return dedup_paths(rows.orderBy(F.desc_nulls_last(order), key).limit(limit), path, key, order)


def same_tags(docs: DataFrame, anchor: Column, key: str = "doc_id", tags: str = "tags") -> DataFrame:
    """``(doc_id, common)``: other documents that share tags with one document."""
    mine = docs.where(F.col(key) == anchor).select(F.explode(tags).alias("tag")).distinct()
    each = docs.where(F.col(key) != anchor).select(key, F.explode(F.array_distinct(tags)).alias("tag"))
    return each.join(broadcast_small(mine), "tag").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("common"))


# Progress of each stage of an ingest, and statuses from which a document may be processed again.
PROGRESS = {"pending": 0, "parsing": 10, "chunking": 30, "embedding": 60, "completed": 100}
AGAIN = ("failed", "completed", "indexed")


def ingest(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, status, progress, error)``: how far each document has come, from what its stages have made.

    ``chunks(doc_id, ...)`` and ``vectors(doc_id, ...)`` hold a row a chunk and a row an embedded chunk. A document
    without text fails in parsing, one without chunks in chunking; one of whose chunks only some are embedded
    is still embedding. Errors are cut to 500 characters.
    """
    made = lambda df, name: df.groupBy(F.col(key).alias(f"_{name}")).agg(F.count("*").alias(name))
    d = docs.join(made(chunks, "chunks"), F.col(key) == F.col("_chunks"), "left").join(made(vectors, "vectors"), F.col(key) == F.col("_vectors"), "left")
    error = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "no text could be read").when(F.col("chunks").isNull(), "no chunks")
    status = F.when(error.isNotNull(), "failed").when(F.col("vectors").isNull() | (F.col("vectors") < F.col("chunks")), "embedding").otherwise("completed")
    progress = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv]), status), F.when(F.col("chunks").isNull() & (error == "no chunks"), PROGRESS["chunking"]).otherwise(PROGRESS["parsing"]))
    return d.select(key, status.alias("status"), progress.alias("progress"), F.left(error, F.lit(500)).alias("error"))


def reprocess(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Docs with those of ``ids`` pending again, if their status allows it."""
    d = docs.join(ids.select(key).distinct().withColumn("_again", F.lit(True)), key, "left")
    hit = F.coalesce("_again", F.lit(False)) & F.col("status").isin(*AGAIN)
    return d.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "progress": F.when(hit, 0).otherwise(F.col("progress")), "error": F.when(~hit, F.col("error"))}).drop("_again")


def batch_outcomes(files: DataFrame, valid: Column, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """A row a file ``(name, status, error)``, and one row of counts ``(success, failed)``."""
    rows = files.select(name, F.when(valid, "success").otherwise("failed").alias("status"), F.when(~valid, F.concat(F.lit("unsupported type or too large: "), F.col(name))).alias("error"))
    return rows, rows.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


def count_documents(docs: DataFrame, user: str = "user_id") -> DataFrame:
    """``(user, n_all, n_live)``: documents of each user, with and without those deleted."""
    return docs.groupBy(user).agg(F.count("*").alias("n_all"), F.count_if(F.coalesce(F.col("status") != "deleted", F.lit(True))).alias("n_live"))


def light(docs: DataFrame, content: str = "content") -> DataFrame:
    """Documents without their content, which is then not read."""
    return docs.drop(content)


def with_text(docs: DataFrame, extracted: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Documents whose content is blank get what was extracted for them."""
    e = extracted.select(key, F.col(content).alias("_extracted"))
    blank = F.trim(F.coalesce(F.col(content), F.lit(""))) == ""
    return docs.join(e, key, "left").withColumn(content, F.when(blank, F.coalesce("_extracted", content)).otherwise(F.col(content))).drop("_extracted")


def cached_summaries(docs: DataFrame, fallback: Column, metadata: str = "metadata") -> DataFrame:
    """Docs with ``summary`` from their metadata map, or made by ``fallback`` and put there."""
    held = F.try_element_at(metadata, F.lit("summary"))
    made = F.coalesce(held, fallback)
    kept = F.when(held.isNull(), F.map_concat(F.map_filter(metadata, lambda k, v: k != "summary"), F.create_map(F.lit("summary"), made))).otherwise(F.col(metadata))
    return docs.withColumn("summary", made).withColumn(metadata, kept)
