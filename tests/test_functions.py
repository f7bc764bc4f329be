"""Worked examples of functions and operators whose order matters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import hash_embedding
from tessera.operators import chunking, content, conversations, fusion, graph, lifecycle, retrieval, stats
from tessera.sources.readers import docx_text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_sentences(spark):
    assert one(spark, T.sentences, "Pi is 3.14 ok. Next one! 你好。再见") == ["Pi is 3.", "14 ok.", "Next one!", "你好。", "再见"]


def test_query_tokens(spark):
    assert one(spark, T.query_tokens, "what's spark 流 处理？ok a") == ["what's", "spark", "处理", "ok"]


def test_cut_at_sentence(spark):
    assert one(spark, lambda c: T.cut_at_sentence(c, F.lit(30)), "Alpha beta. Gamma delta! epsilon zeta") == "Alpha beta. Gamma delta"
    assert one(spark, lambda c: T.cut_at_sentence(c, F.lit(5)), "abcdefgh") == "abcde"


@pytest.mark.parametrize(("raw", "want"), [("依赖", "DEPENDS_ON"), ("depends on", "DEPENDS_ON"), ("foo", "RELATED_TO"), ("", "RELATED_TO"), (None, "RELATED_TO")])
def test_relation_label(spark, raw, want):
    assert one(spark, T.relation_label, raw) == want


@pytest.mark.parametrize(("raw", "want"), [(" Dataset ", "数据"), ("公司", "组织"), ("xyz", "概念"), (None, "概念")])
def test_entity_type(spark, raw, want):
    assert one(spark, T.entity_type, raw) == want


def test_titles(spark):
    assert one(spark, T.auto_title, "总结  Spark: a/b\nsecond") == "Spark ab"
    assert one(spark, T.auto_title, "  \n ") == T.NO_TITLE
    assert one(spark, lambda c: T.safe_filename(c, "md"), ' a:b?. ') == "a_b_.md"


def test_context_cut(spark):
    assert one(spark, lambda c: T.cut_context(c, 10), "abcdefghi. jk") == "abcdefghi."
    assert one(spark, lambda c: T.cut_context(c, 10), "abcdefghijkl") == "abcdefghij..."
    assert one(spark, lambda c: T.cut_context(c, 10), "abcdefghi\njkl") == "abcdefghi"


def test_markdown_to_html(spark):
    assert one(spark, T.md_to_html, "# T\n\n**b** and *i*\nnext\n\n- x") == "<h1>T</h1>\n<p><strong>b</strong> and <em>i</em><br>next<br><li>x</li></p>"


def test_status_and_type(spark):
    assert [one(spark, T.status, s) for s in ("indexed", "parsing", "nope")] == ["completed", "parsing", "pending"]
    assert one(spark, T.file_type, "a/b.DOC") == "docx"


def test_levels(spark):
    got = spark.createDataFrame([(n,) for n in (0, 2, 5, 9, 10)], "n int").select(stats.level(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 4]


def test_ttl(spark):
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 2, 29, 1)), (2, dt.datetime(2024, 2, 29)), (3, None)], "id int, deleted_at timestamp")
    assert [r["id"] for r in lifecycle.expired(rows, now).collect()] == [2]
    assert [r["id"] for r in lifecycle.recycle_bin(rows, now).collect()] == [1]


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 480), (2, ""), (3, None)], "doc_id int, text string")
    assert [len(r["content"]) for r in chunking.fixed_windows(docs).orderBy("idx").collect()] == [480, 30]
    assert chunking.fixed_windows(docs, keep_tail=False).count() == 1


def test_recursive_chunks(spark):
    text = "Alpha beta gamma.\n\n" + "word " * 300 + "\n\n" + "y" * 1200
    got = chunking.recursive_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("idx").collect()
    assert all(0 < len(r["content"]) <= 500 and text[r["start"] : r["end"]] == r["content"] for r in got)
    assert {w for r in got for w in r["content"].split()} >= {"Alpha", "word"}
    assert sum("y" in r["content"] for r in got) >= 3


def test_sections(spark):
    text = "# A\nx\n## B\ny\n# C\n1.1 sub\nz"
    heads = chunking.sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert {(r["position"], r["path"]) for r in heads.collect()} == {(0, "A"), (6, "A > B"), (13, "C"), (17, "C > 1.1 sub")}
    chunks = spark.createDataFrame([(1, 0, 4), (1, 1, 12), (2, 0, 3)], "doc_id int, idx int, start int")
    assert {(r["doc_id"], r["idx"], r["section_path"]) for r in chunking.section_of(chunks, heads).collect()} == {(1, 0, "A"), (1, 1, "A > B"), (2, 0, None)}


def test_units(spark):
    rows = [(1, 0, "A", "x" * 10), (1, 1, "A", "y" * 10), (1, 2, "B", "z"), (1, 3, "B", "w" * 30)]
    got = chunking.extraction_units(spark.createDataFrame(rows, "doc_id int, idx int, section_path string, content string"), most=25).orderBy("unit").collect()
    assert [(r["first_idx"], len(r["content"])) for r in got] == [(0, 21), (2, 1), (3, 30)]


def test_fusion_order(spark):
    dense = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 2), ("c", 0.7, 3)], "id string, score double, rank int")
    sparse = spark.createDataFrame([("b", 5.0, 1), ("d", 4.0, 2)], "id string, score double, rank int")
    got = retrieval.reciprocal_rank_fusion(dense, sparse).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "d", "c"]
    assert [r["score"] for r in got] == [0.8, 0.9, 4.0, 0.7]


def test_packing(spark):
    rows = [("vector_rerank_top", 1, "1", "Short one.", 1.8), ("graph_expansion", 2, "2", "First. Second part is long", 1.0)]
    cand = spark.createDataFrame(rows, "source_type string, seq int, chunk_id string, content string, weight double")
    assert fusion.packed_text(fusion.pack(cand, 16)).first()[0] == "Short one. [来源:向量]\nFirst. Second part [来源:图谱-扩展]\n".replace("First. Second part", "First")
    assert one(spark, fusion.vector_weight, 0.8, "double") == pytest.approx(1.8)


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "a bb ccc"), (2, ""), (3, "流处理系统")], "doc_id int, text string")
    v = {r["doc_id"]: r["vector"] for r in hash_embedding(docs).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and sum(x * x for x in v[3]) == pytest.approx(1) and not any(v[2])


def test_trails(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 2)], "edge_id long, src long, dst long")
    got = graph.trails(edges, spark.createDataFrame([(1,)], "seed long"), 2).groupBy("target", "hops").count().collect()
    assert {(r["target"], r["hops"], r["count"]) for r in got} == {(2, 1, 2), (3, 2, 2), (1, 2, 2)}


def test_descriptions(spark):
    rows = [("n", "t", "alpha", "c1", 1), ("n", "t", "alp", "c2", 2), ("n", "t", "beta", None, 3)]
    got = graph.append_descriptions(spark.createDataFrame(rows, "name string, type string, description string, chunk_id string, seq int")).first()
    assert (got["description"], got["chunk_id"]) == ("alpha; beta", "c1")


def test_sessions(spark):
    s = spark.createDataFrame([("a", "u", "m", True, None), ("b", "u", "m", False, None), ("c", "v", "m", True, None)], "session_id string, user_id string, mode string, is_active boolean, ended_at timestamp")
    assert {r["session_id"]: r["is_active"] for r in conversations.activate(s, F.lit("b")).collect()} == {"a": False, "b": True, "c": True}
    m = spark.createDataFrame([("a",)], "session_id string")
    assert {r["session_id"] for r in conversations.close(s, m, F.lit("b"), F.current_timestamp()).collect()} == {"a", "c"}
    assert not conversations.close(s, m, F.lit("a"), F.current_timestamp()).where("session_id = 'a'").first()["is_active"]


def test_upsert_and_restore(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id int, v int, t string")
    new = spark.createDataFrame([(2, 1, "c"), (3, 0, "d")], "doc_id int, v int, t string")
    assert {tuple(r) for r in lifecycle.upsert(base, new, "doc_id", "v").collect()} == {(1, 1, "a"), (2, 1, "c"), (3, 0, "d")}
    now = F.lit("2024-01-10").cast("timestamp")
    docs = base.withColumns({"status": F.lit("completed"), "deleted_at": F.lit(None).cast("timestamp")})
    gone = lifecycle.soft_delete(docs, new, now)
    assert gone.where("status = 'deleted'").count() == 1
    assert lifecycle.restore(gone, new, now).where("status = 'deleted'").count() == 0


def test_page():
    title, md = content.read_page("<html><head><title> T </title><script>x</script></head><body><article><h1>Head</h1><p>Some <b>text</b></p><ol><li>a</li><li>b</li></ol><a href='u'>l</a><pre>c</pre><blockquote>q</blockquote><img src='i' alt='z'></article></body></html>")
    assert title == "T"
    assert md == "# Head\n\nSome text\n\n1. a\n2. b\n\n[l](u)\n```\nc\n```\n\n> q\n\n![z](i)"
    assert content.read_page(None) == (content.NO_PAGE_TITLE, "")


def test_bad_docx():
    assert docx_text(b"no zip") is None
