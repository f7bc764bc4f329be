"""Dense and sparse retrieval, rank fusion, rerank guard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.sizes import broadcast_small
from tessera.functions.vectors import cosine

DENSE_THRESHOLD, SPARSE_THRESHOLD, RRF_K, RERANK_SKIP, RERANK_TOP = 0.3, 0.0, 60, 0.75, 5


def knn(vectors: DataFrame, query: DataFrame, k: int, threshold: float | None = None, where: Column | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, score)``: the k rows with the largest cosine to the one row of ``query(q)``, ties to the smaller id.

    The filter comes before the scan's similarities; the query is one row, so it is sent to every task.
    """
    base = vectors if where is None else vectors.where(where)
    scored = base.crossJoin(F.broadcast(query.select("q").limit(1))).select(id_col, cosine(F.col(vec), F.col("q")).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = 4096, query_block: int = 512) -> DataFrame:
    """``(query_id, id, score, rank)``: the k rows with the largest cosine to each of a stated set of queries ``(query_id, q)``.

    Vectors and queries are dealt into blocks of bounded size. A unit of work is a block of each, multiplied as
    matrices; it returns its k best a query, of which the k best stay. Vectors meet queries of their own length
    only. Vectors that are null, empty or have a null component take no part.
    """
    whole = lambda v: F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0)
    dealt = lambda df, i, v, n: df.where(F.col(v).isNotNull() & whole(v)).select(F.col(i).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.size(v).alias("length"), F.pmod(F.xxhash64(i), F.lit(n)).alias("block"))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    gather = lambda df, name: df.groupBy("length", "block").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(name))
    n = blocks(queries, query_block)
    rows = gather(dealt(vectors, id_col, vec, blocks(vectors, block)), "v").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).drop("block")
    asks = gather(dealt(queries, "query_id", "q", n), "q").withColumnRenamed("block", "q_block")

    def matrix(col: pa.ListScalar) -> np.ndarray:
        flat = col.values
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, qids = (b[c][row].values.to_numpy() for c in ("v_ids", "q_ids"))
                unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (matrix(b["v"][row]), matrix(b["q"][row]))]
                score = unit[1] @ unit[0].T
                best = np.stack([np.lexsort((ids, -s))[:k] for s in score])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query_id", id_col, "score"])

    found = rows.join(asks, ["length", "q_block"]).select("v_ids", "v", "q_ids", "q").mapInArrow(run, f"query_id long, {id_col} long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, term, weight)``: term frequencies of lower-cased words, the sparse channel without a model.

    Texts are dealt by id, so that words are counted where they are split and are not shuffled; or by ``by``, columns that an
    id decides, which come along.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    dealt = docs.select(*by, id_col, text).repartition(*(by or (id_col,)))
    terms = dealt.select(*by, id_col, F.explode(words).alias("term")).where("term <> ''")
    return terms.groupBy(*by, id_col, "term").agg(F.count("*").cast("double").alias("weight"))


def search_terms(docs: DataFrame, query_terms: DataFrame, k: int, threshold: float = SPARSE_THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``sparse_search`` straight from texts: words that the query lacks go before anything is counted.

    ``query_terms(term, q)`` is one query's list; a short one goes to every task.
    """
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    hits = docs.select(id_col, F.explode(words).alias("term")).join(broadcast_small(query_terms), "term")
    found = hits.groupBy(id_col).agg(F.sum("q").alias("score"))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(k)


def sparse_search(postings: DataFrame, query_terms: DataFrame, k: int, threshold: float = SPARSE_THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """``(id, score)``: dot products with ``query_terms(term, q)``, the k largest, ties to the smaller id."""
    hits = postings.join(query_terms, "term").groupBy(id_col).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return hits.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """``(id, rrf, score, dense_rank, sparse_rank, rank)`` from ranked lists ``(id, score, rank)``.

    rrf orders; score is the dense one, or the sparse one of rows that only it found. Ties: dense order first.
    """
    both = dense.select(id_col, F.col("score").alias("ds"), F.lit(None).cast("double").alias("ss"), F.col("rank").alias("dr"), F.lit(None).cast("int").alias("sr")).unionByName(
        sparse.select(id_col, F.lit(None).cast("double").alias("ds"), F.col("score").alias("ss"), F.lit(None).cast("int").alias("dr"), F.col("rank").alias("sr"))
    )
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    one = both.groupBy(id_col).agg(F.max("ds").alias("ds"), F.max("ss").alias("ss"), F.min("dr").alias("dense_rank"), F.min("sr").alias("sparse_rank"))
    one = one.select(id_col, (part("dense_rank") + part("sparse_rank")).alias("rrf"), F.coalesce("ds", "ss").alias("score"), "dense_rank", "sparse_rank")
    order = W.orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), id_col)
    return one.withColumn("rank", F.row_number().over(order))


def ranked(found: DataFrame, id_col: str) -> DataFrame:
    """A short result list with its ranks."""
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_col)).cast("int"))


def rerank_guard(found: DataFrame, limit: int, skip_at: float = RERANK_SKIP, top: int = RERANK_TOP, id_col: str = "vec_id", rerank: Column | None = None) -> DataFrame:
    """The first ``limit`` rows if the best score is high enough, else the ``top`` best by ``rerank``, a score of all rows.

    Reranking returns ``top`` rows whatever the limit. Without a reranker the order stays and scores become 1.
    """
    best = found.agg(F.max("score").alias("best"))
    r = ranked(found, id_col).crossJoin(F.broadcast(best)).withColumn("sure", F.col("best") >= skip_at)
    if rerank is not None:
        r = r.withColumn("_again", F.when(~F.col("sure"), rerank))
        r = r.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("_again"), "rank")).cast("int"))
    kept = r.where(F.col("rank") <= F.when(F.col("sure"), limit).otherwise(top))
    score = F.when(F.col("sure"), F.col("score")).otherwise(F.lit(1.0) if rerank is None else F.col("_again"))
    return kept.select(id_col, "rank", score.alias("score"), (~F.col("sure")).alias("reranked"))


def related_documents(parts: list[tuple[DataFrame, float | None, str]], limit: int, id_col: str = "doc_id") -> DataFrame:
    """``(id, similarity, reason)``: relations of several kinds, the first kind's similarity, all reasons in order.

    ``parts`` are (rows with id and perhaps score, fixed similarity or None for the score, reason).
    """
    tagged = None
    for prio, (df, fixed, why) in enumerate(parts):
        sim = F.round(F.col("score"), 4) if fixed is None else F.lit(fixed)
        one = df.select(id_col, sim.cast("double").alias("similarity"), F.lit(why).alias("reason"), F.lit(prio).alias("prio"))
        tagged = one if tagged is None else tagged.unionByName(one)
    why = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("prio", "reason"))), lambda x: x["reason"]), " + ")
    return tagged.groupBy(id_col).agg(F.min_by("similarity", "prio").alias("similarity"), why.alias("reason")).orderBy(F.desc("similarity"), id_col).limit(limit)
