"""The corpus pipeline: documents through toxicity, line dedup, near dedup, decontamination and token round trip.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. A stage's result is written to the shared scratch folder and read
again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hyperminhash, line_dedup, toxicity, trie_bpe
from tessera.llm.base import cut, ensure_checkpoint_dir
from tessera.llm.queries import table, vocabulary

#: Copies up to which their ids and text hashes go to every task; beyond that documents are shuffled to meet them.
BROADCAST_IDS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those predicted toxic, learnt from ``labels`` of rows outside the held-out fold."""
    return _documents(toxicity.reject_toxic(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their lines found in ten documents or more; n_chars follows the text."""
    out = line_dedup.dedup_lines(_documents(docs), min_docs=10)
    return _documents(out.withColumn("n_chars", F.length("text").cast("long")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarity 0.8 or more, and all without words.

    Rows are told apart by id and text: of an id with several texts only the copies go. Rows of one id and
    text, if it has words, are one document; rows with a null id all stay.
    """
    docs = _documents(docs)
    by = [F.col("doc_id"), F.xxhash64("text")]
    found = cut(hyperminhash.near_duplicates(docs, percent=80, text_hash=True).where("doc_id is not null and n_shingles > 0"))
    same = lambda df: (by[0] == df["id"]) & (by[1] == df["h"])
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, same(gone), "left_anti")
    again = cut(found.where("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).count().where("count > 1"))
    if not again.isEmpty():
        once = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(again, same(again), "left_anti").unionByName(once)
    return _documents(left)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item or a re-parameterised copy of one."""
    return _documents(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return trie_bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", remove_benchmark),
    ("bpe", tokens),
]

#: Learnt scores, components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stage results stand in the session's checkpoint folder, under a name of this run."""
    docs, place = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
