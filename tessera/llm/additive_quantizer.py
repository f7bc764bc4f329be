"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of M full-dimensional codewords, found by beam search over the residuals, and
stored with the norms that set a score of the sum right. Queries are scored against all codes through
lookup tables, block by block. Each block ranks what scores best in it again by exact inner products and
returns a few, so that candidates grow with the blocks and recall doesn't fall with the size of the table.
Equal vectors are searched as one, so that a very common vector is one code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.base import cut, give_back

#: Codebooks, codewords of each, beam width, vectors that the codebooks are fitted on at most.
BOOKS, WORDS, BEAM, SAMPLE = 16, 256, 4, 16_384
#: Candidates of each block of codes ranked exactly for a query; codes and queries of one unit of work, and
#: queries scored at a time.
RERANK, CODE_BLOCK, QUERY_BLOCK, QUERY_STEP = 500, 32_768, 2_048, 128


def _assign(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks books x words x dim: k-means on the residuals, then one least-squares fit of all codewords at once."""
    words = min(words, len(x))
    rng, rest = np.random.default_rng(seed), x.astype(np.float32).copy()
    out = np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)] + 1e-4 * rng.standard_normal((words, x.shape[1])).astype(np.float32)
        for _ in range(steps):
            at = _assign(rest, c)
            n = np.bincount(at, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, at, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], rest[rng.integers(0, len(rest), words)])
        out[m] = c
        rest = rest - c[_assign(rest, c)]
    codes = encode(x, out)[0].astype(np.int64) + np.arange(books) * words
    gram = np.zeros((books * words, books * words), np.float32)  # counts, exact; solved in double
    for i in range(books):
        for j in range(books):
            np.add.at(gram, (codes[:, i], codes[:, j]), 1)
    gram[np.diag_indices(books * words)] += 0.5
    right = 0.5 * out.reshape(books * words, -1)
    for i in range(books):
        np.add.at(right, codes[:, i], x)
    return np.linalg.solve(gram, right).astype(np.float32).reshape(out.shape)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x M bytes) by beam search, and the gain |x| / |sum of codewords| that scores are multiplied by."""
    m, k, d = books.shape
    codes, gain = np.zeros((len(x), m), np.uint8), np.ones(len(x), np.float32)
    norms = (books**2).sum(2)
    for at in range(0, len(x), 256):
        part = x[at : at + 256].astype(np.float32)
        n = len(part)
        rest, error = part[:, None, :], np.zeros((n, 1), np.float32)
        path = np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            width = rest.shape[1]
            cost = (error[:, :, None] + norms[b] - 2 * rest @ books[b].T).reshape(n, width * k)
            best = np.argpartition(cost, min(beam, width * k - 1), axis=1)[:, :beam]
            rows, parent, word = np.arange(n)[:, None], best // k, best % k
            error = np.take_along_axis(cost, best, 1)
            rest = rest[rows, parent] - books[b][word]
            path = np.concatenate([path[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        win = np.argmin(error, axis=1)
        codes[at : at + n] = path[np.arange(n), win]
        made = part - rest[np.arange(n), win]
        gain[at : at + n] = np.linalg.norm(part, axis=1) / np.maximum(1e-12, np.linalg.norm(made, axis=1))
    return codes, gain


def lookup_scores(queries: np.ndarray, codes: np.ndarray, gain: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products, queries x codes, through one table of query-codeword products a codebook."""
    total = np.zeros((len(codes), len(queries)), np.float32)
    for m in range(books.shape[0]):
        total += np.take(books[m] @ queries.T, codes[:, m], axis=0)
    return (total * gain[:, None]).T


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: rows with an id and a finite, non-zero vector, in double precision; one row an id.

    Of an id with several vectors the smallest in array order stays. Minus zero becomes zero.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    t = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return t.where(fine & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _single(x: np.ndarray) -> np.ndarray:
    """Vectors in the precision of the codes; what that can't hold is its largest number."""
    most = float(np.finfo(np.float32).max) / 1e4
    return np.clip(x, -most, most).astype(np.float32)


def nearest_of_block(queries: np.ndarray, reps: np.ndarray, vectors: np.ndarray, coded: np.ndarray, gain: np.ndarray, books: np.ndarray | None, rerank: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and exact inner products of each query's ``k`` nearest among the ``rerank`` that score best.

    Where there are no more than ``rerank`` all are ranked, and neither codes nor codebooks are needed.
    """
    out = []
    n = min(rerank, len(reps))
    for at in range(0, len(queries), QUERY_STEP):
        part = queries[at : at + QUERY_STEP]
        if n < len(reps):
            best = np.argpartition(-lookup_scores(_single(part), coded, gain, books), n - 1, axis=1)[:, :n]
        else:
            best = np.broadcast_to(np.arange(n), (len(part), n))
        for i, (q, b) in enumerate(zip(part, best, strict=True)):
            exact = vectors[b] @ q
            top = np.lexsort((reps[b], -exact))[:k]
            out.append((np.full(len(top), at + i), reps[b][top], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` nearest found.

    Nearness is the inner product in double precision, largest first, ties to the smaller id; a row is
    no candidate for itself. Every usable row is indexed (see ``usable``); an inner product needs vectors of
    one length, so rows meet those of their own. Each length has codebooks of its own, fitted on its
    ``sample`` distinct vectors with the smallest id hashes; a length of ``rerank`` distinct vectors or fewer
    needs none, as all of them are ranked. No rows give an empty result.
    """
    spark = vectors.sparkSession
    own = cut(usable(vectors, vec_id, embedding))
    first = W.partitionBy("v").orderBy("vec_id")
    groups = own.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = cut(groups.select(F.col("ids")[0].alias("rep"), "ids", "v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(v, np.float64).tobytes() for v in b["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["rep"], b["n"], pa.array(rows, pa.binary())], ["rep", "n", "vec"])

    packed = cut(groups.select("rep", F.size("v").alias("n"), "v").mapInArrow(pack, "rep long, n int, vec binary"))
    total = packed.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = {}
    for (n,) in packed.groupBy("n").count().where(F.col("count") > rerank).orderBy("n").select("n").collect():
        taken = [bytes(r["vec"]) for r in packed.where(F.col("n") == n).orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()]
        fitted[n] = fit_codebooks(_single(np.frombuffer(b"".join(taken), np.float64).reshape(len(taken), n)))
    books = spark.sparkContext.broadcast(fitted)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["n"].to_numpy()
            for n in np.unique(size):
                part = b.filter(pa.array(size == n))
                codes, gain = encode(_single(_matrix(part["vec"])), books.value[n]) if n in books.value else (np.zeros((len(part), 0), np.uint8), np.ones(len(part), np.float32))
                yield pa.RecordBatch.from_arrays([part["rep"], part["n"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(gain), part["vec"]], ["rep", "n", "code", "gain", "vec"])

    codes = packed.mapInArrow(code, "rep long, n int, code binary, gain float, vec binary").withColumn("cblock", F.pmod(F.xxhash64("rep"), F.lit(-(-total // CODE_BLOCK))))
    asks = own.where(F.col("vec_id") % every == 0).join(groups.select(F.col("v").alias("gv"), "rep"), F.col("v") == F.col("gv")).select("vec_id", "rep")
    queries = packed.join(asks.select("rep").distinct(), "rep")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    qblocks = queries.withColumn("qblock", F.pmod(F.xxhash64("rep"), F.lit(blocks))).groupBy("n", "qblock").agg(F.collect_list(F.struct("rep", "vec")).alias("q"))
    cblocks = codes.groupBy("n", "cblock").agg(F.collect_list(F.struct("rep", "code", "gain", "vec")).alias("c"))
    units = cblocks.withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(qblocks, ["n", "qblock"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, q, c = b["n"][i].as_py(), b["q"][i].values, b["c"][i].values
                coded = np.frombuffer(b"".join(c.field("code").to_pylist()), np.uint8).reshape(len(c), -1)
                at, reps, exact = nearest_of_block(_matrix(q.field("vec")), c.field("rep").to_numpy(), _matrix(c.field("vec")), coded, c.field("gain").to_numpy(), books.value.get(n), rerank, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q.field("rep").to_numpy()[at]), pa.array(reps), pa.array(exact)], ["query", "rep", "score"])
        give_back()

    found = units.select("n", "q", "c").mapInArrow(look, "query long, rep long, score double")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    near = found.select("query", "rep", "score").join(groups.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), "vec_id"]
    near = near.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1)
    out = asks.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(near.drop("r"), "query").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
