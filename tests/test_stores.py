"""Tables at rest: which files change, what a cache asks, which blocks are read, which row groups hold a key."""

import datetime
import os
import random
from collections import Counter

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.sources import stores

SCHEMA = "k string, v int, at int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_touches_buckets_of_new_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    want = {f"k{i}": i for i in range(500)}
    stores.upsert_table(spark.createDataFrame([(k, v, 0) for k, v in want.items()], SCHEMA), path, "k", "at", 16)
    before = files(path)
    new = spark.createDataFrame([("k1", 7, 1), ("k1", 9, 2), ("k1", 8, None), ("fresh", 1, 1), (None, 5, 1)], SCHEMA)
    stores.upsert_table(new, path, "k", "at", 16)
    want |= {"k1": 9, "fresh": 1, None: 5}
    rows = spark.read.parquet(path)
    assert {r["k"]: r["v"] for r in rows.collect()} == want and rows.count() == len(want)
    touched = {f"bucket={r[0]}" for r in new.select(stores.bucket_of(F.col("k"), 16)).distinct().collect()}
    changed = {f.split("/")[-2] for f in before ^ files(path)}
    assert changed == touched and len(before & files(path)) == 16 - len(touched)
    stores.upsert_table(new, path, "k", "at", 16)  # again, as after a lost run
    assert spark.read.parquet(path).count() == len(want)
    stores.delete_rows(spark.createDataFrame([("k2",), (None,), ("absent",)], "k string"), path, "k", 16)
    assert {r["k"] for r in spark.read.parquet(path).collect()} == set(want) - {"k2", None}
    with pytest.raises(ValueError, match="columns"):
        stores.upsert_table(new.drop("v"), path, "k", "at", 16)


def test_index_degrades_to_vectors(spark, tmp_path):
    path = str(tmp_path / "i")
    schema = "chunk_id string, user_id int, vector array<float>, terms map<string,double>"
    stores.upsert_index(spark.createDataFrame([("a", 1, [1.0], {"x": 1.0, "y": 2.0}), ("b", 1, [2.0], {}), ("c", 2, [3.0], None)], schema), path)
    posts = lambda: {(r["chunk_id"], r["term"], r["weight"]) for r in spark.read.parquet(f"{path}/postings").collect()}
    assert posts() == {("a", "x", 1.0), ("a", "y", 2.0)}
    stores.upsert_index(spark.createDataFrame([("a", 1, [9.0], {"z": 3.0}), ("b", 1, [8.0], {"x": 1.0})], schema), path)
    assert posts() == {("a", "z", 3.0), ("b", "x", 1.0)}
    stores.upsert_index(spark.createDataFrame([("a", 1, [7.0])], "chunk_id string, user_id int, vector array<float>"), path)
    assert posts() == {("b", "x", 1.0)}
    assert {r["chunk_id"]: r["vector"] for r in spark.read.parquet(f"{path}/vectors").collect()} == {"a": [7.0], "b": [8.0], "c": [3.0]}


def test_cache_asks_for_new_texts_only(spark, tmp_path):
    asked, cache = spark.sparkContext.accumulator(0), stores.AnswerCache(str(tmp_path / "c"), "m")

    def model(c):
        @pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            asked.add(len(s))
            return s.map(lambda t: "" if t == "bad" else t.upper())

        return run(c)

    def ask(texts, day):
        rows = cache.ask(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text", model, F.lit(day).cast("date"), lambda a: a == "", 30)
        before = asked.value
        return {r["id"]: r["answer"] for r in rows.collect()}, before

    got, n = ask(["a", "b", "a", "bad", None], "2024-01-01")
    assert got == {0: "A", 1: "B", 2: "A", 3: "", 4: None} and n == 3
    got, n = ask(["b", "c", "bad"], "2024-01-10")
    assert got == {0: "B", 1: "C", 2: ""} and n == 5  # c, and what came back empty
    got, n = ask(["a", "c"], "2024-02-05")
    assert got == {0: "A", 1: "C"} and n == 6  # a is over 30 days old
    assert cache.sweep(spark, F.lit("2024-02-10").cast("date")) == 2 and cache.sweep(spark, F.lit("2024-02-10").cast("date")) == 0
    assert {r["day"] for r in spark.read.parquet(cache.path).select("day").distinct().collect()} == {datetime.date(2024, 2, 5)}
    other = stores.AnswerCache(cache.path, "another")
    other.ask(spark.createDataFrame([("a",)], "text string"), "text", model, F.lit("2024-02-05").cast("date"), lambda a: a == "").collect()
    assert asked.value == 7


def test_stale_files(spark):
    files_ = spark.createDataFrame([("a", 10.0, "x"), ("b", 10.0, "x"), ("c", 10.0, "x"), ("d", 10.0, None)], "path string, mtime double, config string")
    parsed = spark.createDataFrame([("a", 10.9, "x"), ("b", 12.0, "x"), ("c", 10.0, "y"), ("d", 10.0, None)], "path string, mtime double, config string")
    assert {r["path"] for r in stores.stale_files(files_, parsed).collect()} == {"b", "c"}


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_block_maxima_skip_and_lose_nothing(spark, tmp_path, k):
    rng, rows = random.Random(k), []
    for doc in range(20_000):
        for t in {"common", *(f"t{rng.randrange(40)}" for _ in range(3))}:
            rows.append((doc, t, float(rng.choice([1, 1, 1, 2, 50 if doc // 500 == 7 else 2]))))
    path, query, seen = str(tmp_path / "p"), {"common": 1.0, "t3": 2.5, "t9": 0.5, "absent": 9.0}, []
    stores.write_postings(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "term", "weight"])), path, block_bits=5)
    got = stores.search_postings(spark, path, spark.createDataFrame([*query.items()], "term string, q double"), k, 4, seen).collect()
    score = Counter()
    for doc, t, w in rows:
        if t in query:
            score[doc] += w * query[t]
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in got] == want
    assert seen[0] == 625 and (seen[1] < 100 if k <= 10 else seen[1] <= 625)


def test_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = spark.range(200_000).select((F.col("id") * 3).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("body"), (F.col("id") % 5).alias("user_id"))
    stores.write_lookup(rows.repartition(3), path, "doc_id", group_bytes=1 << 20)
    groups = [(f, g) for f in files(path) for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups) for c in [m.row_group(g).column(0)] if c.statistics.min <= 300_000 <= c.statistics.max]
    assert len(groups) == 1 and sum(pq.ParquetFile(f).metadata.num_row_groups for f in files(path)) > 3
    got = stores.lookup(spark, path, "doc_id", [300_000, 300_001], user_id=0)
    assert "In(doc_id" in got._jdf.queryExecution().toString() and [r["doc_id"] for r in got.collect()] == [300_000]
    assert stores.lookup(spark, path, "doc_id", [300_000], user_id=1).count() == 0
