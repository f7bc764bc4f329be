"""Tables at rest that change: upserts by bucket, answer caches, a search index with block maxima, point look-ups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.sizes import broadcast_small

BUCKETS = 64


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all machines share; below a temporary one on a local master without it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = tempfile.mkdtemp(prefix="tessera-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# upserts


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_table(new: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS, whole: bool = False) -> None:
    """Write rows into a table of files by hash bucket of ``key``; of a key the new rows stay.

    Of several new rows of a key the one with the largest ``order`` stays (any one without it); with ``whole`` all
    of them do, in place of all old ones. Only buckets with a new key are read and written again, by dynamic partition
    overwrite: the files of all others keep their names. A run that dies leaves the old files; running again gives the
    same table. Rows with a null key are a key of their own. Columns that the table lacks are an error.
    """
    spark = new.sparkSession
    new = new.withColumn("bucket", bucket_of(F.col(key), buckets))
    if not whole:
        first = W.partitionBy(key).orderBy(F.col(order).desc_nulls_last() if order else F.lit(0))
        new = new.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")
    old = stored(spark, path)
    if old is not None:
        if set(old.columns) != set(new.columns):
            raise ValueError(f"columns {sorted(new.columns)} in place of {sorted(old.columns)}")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # one number a bucket
        stay = old.where(F.col("bucket").isin(touched)).join(new.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        new = stay.select(*new.columns).unionByName(new)
    new.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def delete_rows(keys: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Take the rows of ``keys(key)`` out of such a table, again by touched buckets. A bucket that empties leaves an empty file."""
    old = stored(keys.sparkSession, path)
    if old is None:
        return
    gone = keys.select(F.col(key).alias("_k"), bucket_of(F.col(key), buckets).alias("_b")).distinct()
    touched = [r["_b"] for r in gone.select("_b").distinct().collect()]
    within = old.where(F.col("bucket").isin(touched))
    stay = within.join(gone, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    full = [r["bucket"] for r in stay.select("bucket").distinct().collect()]
    stay.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for b in set(touched) - set(full):
        within.limit(0).drop("bucket").coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket={b}")


def upsert_index(chunks: DataFrame, path: str, chunk_id: str = "chunk_id", vector: str = "vector", sparse: str = "terms", buckets: int = BUCKETS) -> None:
    """Upsert chunks into a search index of two tables, ``vectors`` and ``postings``.

    Every chunk has its vector there; a chunk without term weights (no such column, null or an empty map) has no postings,
    also if it had some before: it can be found by its vector alone.
    """
    rest = [c for c in chunks.columns if c not in (vector, sparse)]
    upsert_table(chunks.select(*rest, vector), f"{path}/vectors", chunk_id, buckets=buckets)
    if sparse in chunks.columns:
        upsert_table(chunks.select(chunk_id, F.explode(sparse).alias("term", "weight")), f"{path}/postings", chunk_id, buckets=buckets, whole=True)
        bare = chunks.where(F.col(sparse).isNull() | (F.size(sparse) == 0))
    else:
        bare = chunks
    delete_rows(bare.select(chunk_id), f"{path}/postings", chunk_id, buckets)


# answer caches


class AnswerCache:
    """Answers of a model by content hash, a folder a day, so that old ones go by folder.

    The key is a digest of the model's name, a version of its prompt and the text. Empty answers aren't kept, so that a
    failure is asked again. What is kept is the answer alone, without the row that asked.
    """

    def __init__(self, path: str, model: str, version: str = "v1"):
        self.path, self.model, self.version = path, model, version

    def key(self, text: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(self.model), F.lit(self.version), text))

    def held(self, spark: SparkSession, now: Column, days: int | None = None) -> DataFrame | None:
        """``(hash, answer)`` kept at most ``days`` days before ``now``."""
        got = stored(spark, self.path)
        if got is None:
            return None
        fresh = got if days is None else got.where(F.col("day") >= F.date_sub(now.cast("date"), days))
        return fresh.groupBy("hash").agg(F.max_by("answer", "day").alias("answer"))

    def ask(self, rows: DataFrame, text: str, model: Callable[[Column], Column], now: Column, empty: Callable[[Column], Column], days: int | None = None) -> DataFrame:
        """rows with ``answer``: what is kept, else what ``model`` (of a text column) says, which is kept unless ``empty``.

        Each new text goes to the model once, however many rows have it; rows with a null text get null.
        """
        spark = rows.sparkSession
        asked = rows.where(F.col(text).isNotNull()).select(self.key(F.col(text)).alias("hash"), F.col(text).alias("said")).dropDuplicates(["hash"])
        known = self.held(spark, now, days)
        new = asked if known is None else asked.join(known, "hash", "left_anti")
        place = scratch_folder(spark, "answers")
        new.select("hash", model(F.col("said")).alias("answer")).write.parquet(place)
        made = spark.read.parquet(place)
        made.where(~F.coalesce(empty(F.col("answer")), F.lit(True))).withColumn("day", now.cast("date")).write.partitionBy("day").mode("append").parquet(self.path)
        every = made if known is None else made.unionByName(known)
        every = every.select(F.col("hash").alias("_hash"), "answer")
        return rows.join(every, self.key(F.col(text)) == F.col("_hash"), "left").drop("_hash")

    def sweep(self, spark: SparkSession, now: Column, days: int = 30) -> int:
        """Delete the folders of days more than ``days`` before ``now``; returns how many."""
        got = stored(spark, self.path)
        if got is None:
            return 0
        old = got.where(F.col("day") < F.date_sub(now.cast("date"), days)).select("day").distinct().collect()
        to = spark._jvm.org.apache.hadoop.fs.Path
        fs = to(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        return sum(fs.delete(to(f"{self.path}/day={r['day']}"), True) for r in old)


def stale_files(files: DataFrame, parsed: DataFrame, slack: float = 1.0) -> DataFrame:
    """Files ``(path, mtime, config)`` to be parsed again: not parsed yet, or changed by more than ``slack`` seconds, or parsed another way."""
    p = parsed.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("config").alias("_config"))
    near = F.abs(F.col("mtime").cast("double") - F.col("_mtime").cast("double")) <= slack
    return files.join(p, (F.col("path") == F.col("_path")) & F.col("config").eqNullSafe(F.col("_config")) & near, "left_anti")


# block-max postings

#: Document ids of one block, as a power of two, and blocks of ids that are scored first.
BLOCK_BITS, FIRST_BLOCKS = 10, 64
#: Terms of a query that the scan itself looks for.
FEW_TERMS = 1000


def block_of(doc_id: Column, block_bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(doc_id.cast("long"), block_bits)


def write_postings(postings: DataFrame, path: str, doc_id: str = "doc_id", block_bits: int = BLOCK_BITS) -> None:
    """Store ``postings(doc_id, term, weight)`` by term and block of ids, with each block's largest weight.

    Blocks of all terms span the same ids, so that bounds of terms add up block by block. Rows of a file are sorted by term, block
    and id, so that a scan for a few terms reads a few pages, and what a block's rows have in common takes next to no
    space. Weights must not be negative. ``postings`` that have their ``block`` and are dealt by it are not shuffled again.
    """
    block = F.col("block") if "block" in postings.columns else block_of(F.col(doc_id), block_bits)
    rows = postings.select("term", block.alias("block"), F.col(doc_id).alias("doc"), "weight")
    whole = W.partitionBy("term", "block").orderBy("doc").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows.withColumn("most", F.max("weight").over(whole)).write.mode("errorifexists").parquet(path)


def search_postings(spark: SparkSession, path: str, query: DataFrame, k: int, first: int = FIRST_BLOCKS, seen: list[int] | None = None) -> DataFrame:
    """``(doc_id, score)``: the ``k`` documents with the largest sums of weight times query weight, ties to the smaller id.

    ``query(term, q)`` is a short list. From block maxima alone every block of ids gets an upper bound. The ``first`` blocks by
    bound are scored; after that only blocks whose bound isn't under the k-th score can matter, and the rest of the
    documents is never read. ``seen`` gets the numbers of blocks with a query term and of blocks scored.
    """
    terms = query.groupBy("term").agg(F.sum("q").alias("q"))
    few = terms.limit(FEW_TERMS + 1).collect()  # a longer list is joined as it is
    index = spark.read.parquet(path)
    if len(few) <= FEW_TERMS:
        terms = F.broadcast(spark.createDataFrame(few, terms.schema))
        index = index.where(F.col("term").isin([r["term"] for r in few if r["term"] is not None]))
    else:
        terms = broadcast_small(terms)
    bounds = index.select("term", "block", "most").distinct().join(terms, "term").groupBy("block").agg(F.sum(F.col("most") * F.col("q")).alias("bound"))

    def scored(hit: DataFrame) -> DataFrame:
        each = hit.select("term", "doc", "weight").join(terms, "term").groupBy(F.col("doc").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
        return each.orderBy(F.desc("score"), "doc_id").limit(k)

    head = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]  # ``first`` numbers
    start = scored(index.where(F.col("block").isin(head)))
    got = start.collect()  # ``k`` rows
    least = got[-1]["score"] if len(got) == k else float("-inf")
    # sums of bounds and of scores are rounded in different orders
    rest = bounds.where((F.col("bound") >= least - abs(least) * 1e-9 if got and len(got) == k else F.lit(True)) & ~F.col("block").isin(head))
    if seen is not None:
        seen += [bounds.count(), len(head) + rest.count()]
    both = spark.createDataFrame(got, start.schema).unionByName(scored(index.join(rest.select("block"), "block", "left_semi")))
    return both.orderBy(F.desc("score"), "doc_id").limit(k)


# point look-ups


def write_lookup(rows: DataFrame, path: str, key: str, group_bytes: int = 8 << 20, distinct: int = 1_000_000) -> None:
    """Store rows for look-ups by key: sorted over all files, in small row groups, with a bloom filter for each.

    Sorting lets statistics rule out row groups by range, and the filter those that span a key but lack it.
    """
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key)
    ranged.write.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct).mode("errorifexists").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list, **owner) -> DataFrame:
    """Rows of a few keys, of an owner's where columns of one are given."""
    found = spark.read.parquet(path).where(F.col(key).isin(values))
    for name, value in owner.items():
        found = found.where(F.col(name) == value)
    return found
