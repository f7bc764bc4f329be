from pyspark.sql import functions as F

from tessera.streaming import ingest


def test_incremental_ingest(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k, "some words " * 80)], "doc_id long, text string").write.mode("append").parquet(src)
        ingest.ingest(ingest.documents(spark, src, "doc_id long, text string"), out, str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(out).select("doc_id").distinct().count() == k + 1


def test_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"), F.lit("click").alias("event_type"))
    assert sorted(r["n"] for r in ingest.sessions(e).collect()) == [1, 2]
    assert [r["n"] for r in ingest.usage(e).collect()] == [3]
