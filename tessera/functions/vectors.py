"""Vector arithmetic and the offline embedding, in double precision, as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import has_cjk

#: Features whose buckets a worker keeps.
KEPT_FEATURES = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def features(text: Column, most: int = 1000) -> Column:
    """Words, or character 3-grams of texts with CJK or a single word; the first ``most``."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")
    words = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")
    solid = F.regexp_replace(body, r"(?U)\s+", "")
    grams = F.when(F.length(solid) < 3, F.filter(F.array(solid), lambda g: g != "")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(solid) - 2, F.lit(1))), lambda i: F.substr(solid, i, F.lit(3))))
    return F.slice(F.when(has_cjk(body) | (F.size(words) <= 1), grams).otherwise(words), 1, most)


def hash_buckets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """``(doc_id, idx, weight)``: feature-hashing embedding as sparse rows; dim is a power of two up to 2**32.

    A row of docs is summed up where it is, so nothing is shuffled; rows of one id have each their own.
    """
    f = docs.select(F.col(doc_id).alias("doc"), features(F.col(text)).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            at, idx, weight = [], [], []
            for row, found in enumerate(b["f"].to_pylist()):
                sums: dict[int, float] = {}
                for x in found or ():
                    if x not in known:
                        if len(known) >= KEPT_FEATURES:
                            known.clear()
                        known[x] = int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[-4:], "big") % dim, 1.0 + 0.1 * (len(x) % 3)
                    k, w = known[x]
                    sums[k] = sums.get(k, 0.0) + w
                at += [row] * len(sums)
                idx += sums.keys()
                weight += sums.values()
            yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(at, pa.int64())), pa.array(idx, pa.int64()), pa.array(weight, pa.float64())], ["doc", "idx", "weight"])

    made = f.mapInArrow(run, f"doc {f.schema['doc'].dataType.simpleString()}, idx long, weight double")
    return made.select(F.col("doc").alias(doc_id), F.col("idx").cast("int").alias("idx"), "weight")


def hash_embedding(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """``(doc_id, vector)``: the embedding as L2-normalised dense arrays; texts without features get zeros."""
    b = hash_buckets(docs, doc_id, text, dim).groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    both = docs.select(doc_id).join(b, doc_id, "left")
    at = lambda i: F.coalesce(F.element_at("m", i.cast("int")) / F.col("n"), F.lit(0.0))
    return both.select(doc_id, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at).alias("vector"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: an array of one stands in for a name."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hash_tenths(text: Column, dim: int = 64) -> Column:
    """The embedding of one short text within its row, in tenths and not normalised: whole numbers, so that sums and products are exact."""
    bucket = lambda t: (F.conv(F.right(F.md5(t), F.lit(8)), 16, 10).cast("long") % dim).cast("int")
    each = F.transform(features(text), lambda t: F.struct(bucket(t).alias("i"), (F.lit(10.0) + F.length(t) % 3).alias("w")))
    return F.aggregate(each, F.array_repeat(F.lit(0.0), dim), lambda acc, x: F.transform(acc, lambda v, k: v + F.when(k == x["i"], x["w"]).otherwise(F.lit(0.0))))


def hash_vector(text: Column, dim: int = 64) -> Column:
    """The embedding of one short text within its row; for texts of many features ``hash_embedding`` shares the work."""
    return _once(hash_tenths(text, dim), lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))))
