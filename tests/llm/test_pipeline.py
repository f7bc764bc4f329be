import os
import random

import pytest

import corpus_pipeline as P
from tessera.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    noise = lambda n: " ".join(word() for _ in range(n))
    item = noise(30)
    clean = {i: noise(60) for i in range(100)}
    docs = {i: t + "\nboilerplate here\n" + noise(40) for i, t in clean.items()}
    copies = {200: docs[1], 201: docs[1].replace("boilerplate", "Boilerplate")}
    toxic = {300 + i: noise(30) + " idiot " + noise(10) + " moron scum" for i in range(40)}
    leak = {400: noise(20) + " " + item + " " + noise(20)}
    rows = [(i, t, "en", "s", len(t)) for part in (docs, copies, toxic, leak) for i, t in part.items()] + [(500, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(r[0], 1, int(300 <= r[0] < 400)) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    assert set(kept[0]) == {*docs, *copies, *leak, 500}
    assert all("boilerplate" not in t for t in kept[1].values()) and set(kept[1]) == set(kept[0])
    assert set(kept[2]) == {*docs, *leak, 500} and set(kept[3]) == {*docs, 500}
    final = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(kept[3]) and all((r["n_tokens"] > 0) == (r["doc_id"] != 500) for r in final)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_near_dedup_goes_by_rows(spark):
    a, b = "one two three four five six seven", "something else that nobody else has written down"
    rows = [(3, a), (5, a), (5, b), (8, None), (8, None), (None, a), (None, a), (9, "only here and in this row twice"), (9, "only here and in this row twice")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in P.keep_one_of_near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (8, None), (8, None), (None, a), (None, a), (9, rows[-1][1])], key=repr)


def test_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, missing labels and columns of clashing names go through all stages."""
    names = ["_key", "_gone", "_bad", "score", "component_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, None, "s", None, *names) for i, t in [(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (1, "other words here"), (2, "x" * 50_000), (3, ""), (4, None)]]
    for k, docs in enumerate(([], rows)):
        at = str(tmp_path / str(k))
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got = sorted((str(r["doc_id"]) for r in P.run(spark, at).collect()))
        assert got == (sorted(["None", "None", "1", "1", "2", "3", "4"]) if docs else [])
