"""Ingest of a stream into several tables with lost and replayed batches, removal, and failure gates as a stream and a table."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import gates, ingest, store

DOC = "doc_id long, text string"


def rows(spark, out, name):
    return sorted(str(r) for r in store.read_table(spark, out, name).drop("batch").collect())


def test_lost_batch_is_replayed_once(spark, tmp_path):
    """A batch that dies between its tables doesn't show, and after it has been tried again all is as if it hadn't died."""
    src = str(tmp_path / "in")

    def feed(k):
        spark.createDataFrame([(k, f"words number{k} alpha beta gamma delta " * 30)], DOC).coalesce(1).write.mode("append").parquet(src)

    def run(out, parts=None):
        store.ingest_all(ingest.documents(spark, src, DOC, 1), str(tmp_path / out), str(tmp_path / f"{out}-cp"), parts).awaitTermination(180)

    feed(0)
    run("a")
    feed(1)

    def lost(docs, chunks):
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        run("a", {k: lost if k == "postings" else v for k, v in store.PARTS.items()})
    out = str(tmp_path / "a")
    written = lambda name: spark.read.parquet(f"{out}/{name}").select("doc_id").distinct().count()
    assert written("vectors") == 2 and len(rows(spark, out, "documents")) == 1 and all("number1" not in r for r in rows(spark, out, "chunks"))
    run("a")
    run("b")
    for name in store.PARTS:
        assert rows(spark, out, name) == rows(spark, str(tmp_path / "b"), name) != []
    assert {r["doc_id"] for r in store.read_table(spark, out, "appears").collect()} == {0, 1}
    done = spark.read.parquet(f"{out}/manifest")
    assert sorted(r["batch"] for r in done.collect()) == [0, 1] and {r["n_documents"] for r in done.collect()} == {1}

    # removal from every table, and an id that comes back
    store.remove_documents(spark.createDataFrame([(0,), (9,)], "doc_id long"), out)
    assert all({r["doc_id"] for r in store.read_table(spark, out, name).collect()} == {1} for name in store.PARTS)
    feed(0)
    run("a")
    assert all({r["doc_id"] for r in store.read_table(spark, out, name).collect()} == {0, 1} for name in store.PARTS)
    store.remove_documents(spark.createDataFrame([(1,)], "doc_id long"), str(tmp_path / "nothing"))


def calls(n, seed):
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([1, 5, 20, 70])
        out.append((f"s{rng.randrange(4)}", i, at, rng.random() < 0.6))
    return out


def plain(rows, threshold, reset):
    """The same gate written down differently: by looking back at what was let through."""
    seen, out = {}, {}
    for s, i, at, failed in sorted(rows, key=lambda r: (r[2], r[1])):
        past = seen.setdefault(s, [])  # (time, failed) of calls let through
        run = 0
        opened = False
        last = None
        for t, f in past:
            if not f:
                run, opened = 0, False
            else:
                run = threshold if opened else 1 if last is not None and t - last >= reset else run + 1
                last, opened = t, run >= threshold
        if opened and at - last < reset:
            out[i] = (False, "open")
            continue
        past.append((at, failed))
        grown = threshold if opened else 1 if last is None or at - last >= reset else run + 1
        out[i] = (True, "closed" if not failed or grown < threshold else "open")
    return out


def test_gate_table(spark):
    data = calls(400, 1)
    got = gates.gate_table(spark.createDataFrame(data, "service string, call_id long, at double, failed boolean").repartition(5), 3, 60.0).collect()
    want = plain(data, 3, 60.0)
    assert {r["call_id"]: (r["admitted"], r["state"]) for r in got} == want
    assert {a for a, _ in want.values()} == {True, False}
    odd = spark.createDataFrame([(None, 1, 1.0, True), ("a", 2, None, True), ("a", 3, 1.0, None)], "service string, call_id long, at double, failed boolean")
    assert [(r["call_id"], r["state"]) for r in gates.gate_table(odd).collect()] == [(3, "closed")]


def test_gate_stream_equals_table(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        data, src = calls(240, 2), str(tmp_path / "in")
        schema = "service string, call_id long, at double, failed boolean"
        for k in range(3):
            part = spark.createDataFrame(data[80 * k : 80 * k + 80], schema).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
            part.drop("at").coalesce(1).write.mode("append").parquet(src)
        read = spark.readStream.schema("service string, call_id long, failed boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        out = gates.gate_stream(read, "ts", 3, 60.0, idle=1e6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination(240)
        got = spark.read.parquet(str(tmp_path / "out")).where("call_id is not null").collect()
        want = {r["call_id"]: (r["admitted"], r["state"]) for r in gates.gate_table(spark.createDataFrame(data, schema), 3, 60.0).collect()}
        assert {r["call_id"]: (r["admitted"], r["state"]) for r in got} == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_idle_state_is_forgotten(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = str(tmp_path / "in")
        for k, at in enumerate([0, 10, 9_000_000, 9_000_010]):
            spark.createDataFrame([("a" if k < 2 else "b", k, True)], "service string, call_id long, failed boolean").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + at))).coalesce(1).write.mode("append").parquet(src)
            read = spark.readStream.schema("service string, call_id long, failed boolean, ts timestamp").parquet(src)
            gates.gate_stream(read, "ts", 2, 60.0, idle=1000.0, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert [r["service"] for r in got if r["state"] == "forgotten"] == ["a"]
        assert [r["state"] for r in sorted((r for r in got if r["call_id"] is not None), key=lambda r: r["call_id"])] == ["closed", "open", "closed", "open"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_distinct_users_from_sketches(spark):
    from tessera.operators import stats

    e = spark.range(60_000).select((F.col("id") * 7919 % 20_011).alias("user_id"), (F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("kind"))
    got = {r["kind"]: r["n_users"] for r in stats.distinct_users(stats.user_sketches(e, "kind", "day"), "kind").collect()}
    want = {r["kind"]: r["n"] for r in e.groupBy("kind").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert all(abs(got[k] - want[k]) < 0.05 * want[k] for k in want)
