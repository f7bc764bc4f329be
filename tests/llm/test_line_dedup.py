import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def brute(docs, least):
    blank = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    keys = [[low(x.strip(blank)) for x in (t or "").split("\n")] for _, t in docs]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(docs, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if n[k] < least]
        out.append((i, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def ours(df, **how):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in L.dedup_lines(df, **how).collect()), key=repr)


DOCS = [(1, "A line\nown 1\n\n"), (2, " a LINE\t\nown 2\r"), (3, "a line"), (4, None), (5, ""), (6, "\n\n"), (None, "A line\nx"), (3, "a line"), (7, "É line\né line"), (8, "é line")]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_brute_force(spark, least):
    rng = random.Random(least)
    docs = DOCS + [(100 + i, "\n".join(rng.choice(["a", "B ", "c c", "", "  ", f"own {i}"]) for _ in range(rng.randint(0, 30)))) for i in range(30)]
    assert ours(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=least) == brute(docs, least)


def test_without_filters_the_same(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    each = df.select("doc_id", F.explode(F.transform(L.lines_of(F.col("text")), L.line_digest)).alias("digest"))
    counts = L.reference_counts(df)
    filters = L.build_filters(counts, 2, 3)
    some, every = L.probe(each, filters, 3), L.probe(each, filters, 3, most_bytes=0)
    frequent = counts.where("n_docs >= 2").select("digest")
    assert some.join(frequent, "digest").count() == every.join(frequent, "digest").count() > 0


def test_insertions_and_deletions_undo(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b = make([(1, "x\ny"), (2, "x\nz")]), make([(3, "z\nx"), (4, "y")])
    ca, cb = L.reference_counts(a), L.reference_counts(b)
    both = L.add_counts(ca, cb)
    table = lambda c: {(bytes(r["digest"]), r["n_docs"]) for r in c.collect()}
    assert table(both) == table(L.reference_counts(a.union(b)))
    assert table(L.remove_counts(both, cb)) == table(ca)
    old = L.build_filters(ca, 2, 2)
    new = L.update_filters(old, ca, both, 2, 2)
    back = L.update_filters(new, both, ca, 2, 2)
    keys = lambda f: sum(r["n_keys"] for r in f.collect())
    assert (keys(old), keys(new), keys(back)) == (1, 3, 1)
    assert sum(int(np.count_nonzero(np.frombuffer(r["filter"], np.uint16))) for r in back.collect()) == 1


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000, np.int64)
    f = L.CuckooFilter.of(h)
    assert f.contains(h).all()
    assert f.contains(h + 1).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ours(none) == []
    df = spark.createDataFrame([(1, "a\nb", 5, "d")], "doc_id long, text string, n_lines int, digest string")
    row = L.dedup_lines(df, min_docs=1).first()
    assert (row["n_lines"], row["n_dropped"], row["text"], row["digest"]) == (2, 2, "", "d")


def test_query(spark, tmp_path):
    from tessera.llm.queries import op2_line_dedup

    docs = [(i, f"common\nown {i}") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i]["kept_sha256"] == hashlib.sha256(f"own {i}".encode()).hexdigest() and got[i]["n_dropped"] == 1 for i, _ in docs)


def test_query_counts_documents_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL, op2_line_dedup

    rows = [(1, "often\nx")] * 8 + [(1, "often")] * 4 + [(k, "Nine\nten \nrest\nonce") for k in range(2, 10)] + [(10, "nine\nTEN"), (11, "ten\nonce\n"), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    ours = sorted(tuple(r[c] for c in names) for r in op2_line_dedup(spark, str(tmp_path)).collect())
    assert ours == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op2_line_dedup']})").fetchall())
    assert (1, 2, 0) in {r[:3] for r in ours} and (10, 2, 1) in {r[:3] for r in ours}


@pytest.mark.parametrize("least", [2, 3])
def test_shards_in_turn_give_the_same(spark, least, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    rng = random.Random(least)
    docs = DOCS + [(100 + i, "\n".join(rng.choice(["a", "b", "c c", "", "  ", "dd", f"own {i}"]) for _ in range(rng.randint(0, 30)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    filters = L.build_filters(L.reference_counts(df), least, 4)
    assert len(L.shard_groups(filters, 1)) >= 3
    assert ours(df, min_docs=least, most_bytes=1) == ours(df, min_docs=least) == brute(docs, least)


def test_clashing_names(spark):
    names = ["_gone", "_lines", "_kept", "_key", "_row", "_id"]
    df = spark.createDataFrame([(1, "a\nb", *names), (2, "a", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = L.dedup_lines(df, min_docs=2).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(1, "b"), (2, "")} and all(r[n] == n for r in rows for n in names)
    with pytest.raises(ValueError, match="together"):
        L.dedup_lines(df, filters=df)


def test_very_many_frequent_lines(spark):
    """Documents of a hundred thousand frequent lines, some of them several times: time goes with lines, not with pairs of them."""
    lines = [f"line {k}" for k in range(50_000)]
    docs = [(i, "\n".join([*lines, f"own {i}", *reversed(lines)])) for i in range(10)]
    rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), min_docs=10).collect()
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows} == {(i, f"own {i}", 100_001, 100_000) for i in range(10)}
