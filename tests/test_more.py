"""Sources, sinks, plug-in models, search by mode, structured content, extraction, sessions."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions import text as T
from tessera.operators import chunking, content, conversations, extraction, fusion, graph, lifecycle, retrieval, search, structured, tokens
from tessera.sources import readers, sinks


def day(n):
    return dt.datetime(2024, 1, n)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "b.md").write_text("# head")
    got = {r["path"].rsplit("/", 1)[1]: (r["doc_type"], r["content"]) for r in readers.text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("text", "one\ntwo"), "b.md": ("markdown", "# head")}
    files = readers.text_files(spark, str(tmp_path / "in"))
    known = files.where("doc_type = 'text'").select(F.col("path").alias("file_path"))
    assert [r["doc_type"] for r in readers.orphan_files(files, known).collect()] == ["markdown"]


def test_word_processor_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["status"]) for r in readers.docx_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Hello you\n", "completed"), "b.docx": (None, "failed")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "doc_id int, user_id string, content string")
    sinks.write_chunks(df, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).where("user_id = 'v'").first()["content"] == "y"
    sinks.write_sidecars(df, str(tmp_path / "meta"))
    assert readers.sidecars(spark, str(tmp_path / "meta"), "doc_id int, content string").count() == 2
    sinks.bucketed(df, "more_bucketed", "doc_id", 4)
    try:
        t = spark.table("more_bucketed")
        plan = t.hint("merge").join(t.withColumnRenamed("content", "c"), "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert t.count() == 2 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE more_bucketed")


def test_answers(spark):
    whole = {"entities": [{"name": " A ", "type": "tool", "description": None}, {"name": "", "type": "x"}, {"type": "x"}], "relations": [{"source": "a", "target": "b", "type": "", "description": "d"}, {"source": " ", "target": "b"}]}
    texts = [
        json.dumps(whole), "```json\n" + json.dumps(whole) + "\n```", "Here: " + json.dumps(whole) + " done", "```json\n" + json.dumps(whole),
        '{"entities": [{"name": "A", "type": "tool"}, {"name": "B", "ty', '{"entities": [{"name": "A", "type": "tool"},', "nothing", "", None, "[1, 2]",
    ]
    e, r = extraction.parse_answers(spark.createDataFrame(list(enumerate(texts)), "k int, answer string"), "k")
    names = {}
    for row in e.collect():
        names.setdefault(row["k"], []).append((row["name"], row["type"]))
    assert {k for k, v in names.items() if v[0] == ("A", "技术")} == {0, 1, 2, 3, 4, 5} and set(names) == {0, 1, 2, 3, 4, 5}
    assert {(x["k"], x["source"], x["target"], x["type"]) for x in r.collect()} == {(k, "a", "b", "相关") for k in range(4)}


@pytest.mark.parametrize(("cut", "want"), [('{"a": [1, {"b": "x\\"', '{"a": [1, {"b": "x\\""}]}'), ('{"a": 1,', '{"a": 1}'), ('{"a": "}', '{"a": "}"}'), ("{}", "{}"), ("", "")])
def test_closing(spark, cut, want):
    assert spark.createDataFrame([(cut,)], "t string").select(extraction.close_open(F.col("t"))).first()[0] == want


def test_closing_any_cut(spark):
    """Every beginning of an answer is closed to JSON or to what lacks a value only."""
    whole = json.dumps({"a": [{"b": 'x "y" \\ {[', "c": [1, [2]]}, "]}"], "d": {"e": "f, "}})
    cuts = [whole[:n] for n in range(1, len(whole) + 1)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cuts], "t string").select(extraction.close_open(F.col("t"))).collect()]
    for text in got:
        out, quoted, skip = [], False, False
        for c in text:  # balanced outside strings
            if quoted:
                skip, quoted = c == "\\" and not skip, skip or c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                out.append({"[": "]", "{": "}"}[c])
            elif c in "]}":
                assert out.pop() == c
        assert not out and not quoted


def test_result_summary(spark):
    rows = [(1, "line one\nline two"), (2, "A! b. c"), (3, "x" * 130), (4, "never")]
    df = spark.createDataFrame(rows, "rank int, content string")
    assert extraction.summarise_results(df).first()[0] == "- line one\n- A! b.\n- " + "x" * 120 + "..."
    assert extraction.summarise_results(df.limit(0)).first()[0] == T.NO_CONTEXT


def items(spark, rows):
    names = "doc_id int, pos int, type string, text string, text_level int, page_idx int, captions array<string>, footnotes array<string>, caption string, footnote string, img_path string, table_body string, latex string"
    blank = {n.split()[0]: None for n in names.split(", ")}
    return spark.createDataFrame([tuple((blank | {"doc_id": 1, "pos": k} | r).values()) for k, r in enumerate(rows)], names)


ROWS = [
    {"type": "text", "text": " Title ", "text_level": 1, "page_idx": 0},
    {"type": "text", "text": "Intro", "page_idx": 0},
    {"type": "image", "captions": ["one", "two"], "page_idx": 0, "img_path": "i.png"},
    {"type": "text", "text": "Part", "text_level": 2, "page_idx": 1},
    {"type": "table", "caption": "plain", "footnote": "f", "table_body": "|a|", "page_idx": 1},
    {"type": "text", "text": "  ", "page_idx": 1},
    {"type": "text", "text": "Second", "text_level": 1, "page_idx": 2},
    {"type": "equation", "latex": "x=1", "page_idx": 2},
    {"type": "video", "page_idx": 2},
]


def test_typed_items(spark):
    got = {r["pos"]: r for r in structured.typed_items(items(spark, ROWS)).collect()}
    assert {k: r["section_path"] for k, r in got.items()} == {0: "Title", 1: "Title", 2: "Title", 3: "Title > Part", 4: "Title > Part", 6: "Second", 7: "Second"}
    assert (got[2]["caption"], got[2]["neighbour_text"], got[2]["image_path"]) == ("one, two", "Intro", "i.png")
    assert (got[4]["caption"], got[4]["footnote"], got[4]["table_body"], got[4]["neighbour_text"]) == ("plain", "f", "|a|", None)
    assert (got[7]["equation"], got[0]["text"]) == ("x=1", "Title")


def test_contexts(spark):
    t = items(spark, ROWS)
    pages = {r["page"]: r["context"] for r in structured.page_contexts(t).collect()}
    assert pages == {0: "#  Title \nIntro\n[Page 1] ## Part", 1: "[Page 0] #  Title \n[Page 0] Intro\n## Part\n[Page 2] # Second", 2: "[Page 1] ## Part\n# Second"}
    assert "[Page 1] [Table" not in pages[0]
    both = {r["page"]: r["context"] for r in structured.page_contexts(t, types=("text", "image")).collect()}
    assert "[Image: one, two]" in both[0]
    near = {r["pos"]: r["context"] for r in structured.chunk_contexts(t).collect()}
    assert near[2] == "Intro\n## Part" and near[0] == "Intro"
    media = {r["pos"]: r["context"] for r in structured.media_contexts(t).collect()}
    assert set(media) == {2, 4, 7} and media[2] == pages[0]
    lonely = items(spark, [{"type": "text", "text": "far", "page_idx": 0}, {"type": "image", "page_idx": 5}])
    assert structured.media_contexts(lonely).first()["context"] == "far"


def test_records(spark):
    typed = structured.typed_items(items(spark, ROWS))
    records = structured.to_records(typed, "doc_id", "pos")
    assert json.loads(records.where("pos = 1").first()["record"]) == {"type": "text", "text": "Intro", "page_idx": 0, "section_path": "Title"}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed.schema if f.name not in ("doc_id", "pos"))
    assert sorted(map(str, structured.from_records(records, schema).collect())) == sorted(map(str, typed.collect()))
    plain = structured.plain_items(spark.createDataFrame([(1, " a "), (2, " "), (3, None)], "doc_id int, text string"))
    assert [(r["doc_id"], r["text"]) for r in plain.collect()] == [(1, "a")]


def test_media_columns(spark):
    df = spark.createDataFrame([("/x/uploads/u1/images/a.png", "image"), ("/x/uploads/a.png", "image"), (None, "image"), ("/uploads/u/q/b.png", "table"), ("/uploads/u/q/b.png", "text")], "p string, k string")
    got = df.select(*[c.alias(n) for n, c in structured.media_columns(F.col("p"), F.col("k")).items()]).collect()
    assert [r["image_url"] for r in got] == ["/api/v1/images/u1/a.png", None, None, "/api/v1/images/u/b.png", None]
    assert [r["content_format"] for r in got] == ["png", "png", "jpg", "markdown", None]


def test_models(spark):
    df = spark.createDataFrame([(1, " a bb "), (2, " "), (3, None), (4, "ccc")], "i int, text string")
    dense = models.dense_embedder(lambda: lambda s: s.map(lambda t: [float(len(t))]))
    assert {r["i"]: r["vector"] for r in models.embed_texts(df, dense, "text").collect()} == {1: [4.0], 4: [3.0]}
    sparse = models.sparse_embedder(lambda: lambda s: s.map(lambda t: {len(t): 1.0}))
    assert df.where("i = 4").select(sparse(F.col("text"))).first()[0] == {3: 1.0}
    again = models.reranker(lambda: lambda q, c: pd.Series([float(len(x)) for x in c]), F.lit("q"))
    found = spark.createDataFrame([(k, 0.5 - k / 10, "x" * k) for k in range(1, 8)], "vec_id int, score double, content string")
    got = retrieval.rerank_guard(found.withColumn("again", again(F.col("content"))), 10, rerank=F.col("again")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(k, 8 - k, 8.0 - k) for k in range(1, 6)]
    sure = retrieval.rerank_guard(found.withColumn("score", F.col("score") + 0.5).withColumn("again", F.lit(1.0)), 3, rerank=F.col("again")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in sure) == [(1, 1), (2, 2), (3, 3)]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(90)] + [(90, [0.0] * 6), (91, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.knn_batch(df, asked, 4, block=16, query_block=4).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v is not None}
    want = {(q, r): c for q in range(0, 91, 10) for r, c in enumerate(sorted(unit, key=lambda c: (-round(float(unit[q] @ unit[c]), 12), c))[:4], 1)}
    assert got == want


def known(spark):
    e = spark.createDataFrame([("ann", "人物", "a person"), ("anna", "人物", ""), ("bob", "人物", None), ("cat", "概念", "x")], "name string, kind string, description string")
    r = spark.createDataFrame([(1, "ann", "bob", "knows", "well"), (2, "bob", "cat", "has", ""), (3, "ann", "bob", "knows", "well")], "edge_id long, src string, dst string, kind string, description string")
    return search.Graph(e, r)


def test_graph_contexts(spark):
    g, terms = known(spark), spark.createDataFrame([("ann", 0)], "term string, pos int")
    nodes, rels = graph.local_query(g.edges, g.entities, terms)
    assert [r["name"] for r in nodes.orderBy("seq").collect()] == ["ann", "anna"]
    assert {(r["source"], r["kind"], r["target"]) for r in rels.collect()} == {("ann", "knows", "bob")}
    nodes, rels = graph.global_context(g.edges, g.entities, terms.select(F.col("term").alias("seed")))
    assert {r["name"] for r in nodes.collect()} == {"ann", "bob", "cat"}
    got = {(r["source"], r["kind"], r["target"], r["description"]) for r in rels.collect()}
    assert ("ann", "has", "cat", "") in got and ("ann", "knows", "cat", "well") in got
    few = graph.global_context(g.edges, g.entities, terms.select(F.col("term").alias("seed")), limit=1)
    assert [(r["target"], r["kind"]) for r in few[1].collect()] == [("bob", "knows")]


def test_modes(spark):
    g, terms = known(spark), spark.createDataFrame([("ann", 0)], "term string, pos int")
    v = spark.createDataFrame([(7, "From a document.", 0.9, 1)], "chunk_id int, content string, score double, seq long")
    says = {m: search.context(m, v, g, terms).first()[0] for m in (*search.MODES, "odd")}
    assert says["vector"] == says["odd"] == "From a document. [来源:向量]\n"
    assert says["vector"] == search.context("mix", v, None, terms).first()[0] == search.context("mix", v, g, terms.limit(0)).first()[0]
    assert "From a document" not in says["local"] + says["global"] and says["hybrid"] == says["mix"]
    assert says["local"].startswith("[实体] ann (人物): a person [来源:图谱-实体]\n[实体] anna (人物) [来源:图谱-实体]\n") and "[关系] ann ←knows→ bob: well [来源:图谱-关系]" in says["local"]
    assert says["mix"].count("[实体] ann (") == 1 and says["mix"].index("From a document") > says["mix"].index("[实体]")


def test_search(spark):
    v = spark.createDataFrame([(i, i % 2, [1.0, i / 10]) for i in range(10)], "doc_id long, user_id int, embedding array<double>")
    d = spark.createDataFrame([(i, "deleted" if i == 1 else "completed", None, ["a"] if i % 3 else ["b"]) for i in range(9)], "doc_id long, status string, deleted_at timestamp, tags array<string>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    got = search.search_documents(v, q, d, F.lit(1), 4, tags=["a", "z"]).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(5, 1), (7, 2)]
    assert search.search_documents(v, q, d, F.lit(1), 9, most=2).count() == 1


def test_chunks_of_entities(spark):
    a = spark.createDataFrame([("x", 1, 5, "t"), ("x", 1, 5, "t"), ("x", 1, None, "t"), ("x", 2, 6, ""), ("y", 3, 7, "u"), ("z", 4, 8, "w")], "entity_name string, doc_id int, chunk_id int, snippet string")
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {r["chunk_id"] for r in graph.related_chunks(a, names).collect()} == {5, 7}
    assert {r["chunk_id"] for r in graph.related_chunks(a, names, 2).collect()} == {5}
    ids = spark.createDataFrame([(1,), (9,)], "doc_id int")
    docs, stay, left = graph.delete_documents(spark.range(1, 5).select(F.col("id").cast("int").alias("doc_id")), a, a.select("entity_name").distinct(), ids)
    assert docs.count() == 3 and stay.count() == 3 and {r[0] for r in left.collect()} == {"x", "y", "z"}
    assert tuple(graph.delete_statistics(a.select("doc_id"), a, ids).first()) == (1, 3)


def test_many_descriptions(spark):
    rows = [("n", "t", f"d{k % 3} end", f"c{k}", k) for k in range(600)]
    got = graph.append_descriptions(spark.createDataFrame(rows, "name string, type string, description string, chunk_id string, seq int")).first()
    assert (got["description"], got["chunk_id"]) == ("d0 end; d1 end; d2 end", "c0")


def test_page_windows(spark):
    rows = [(1, k, k // 2, f"t{k}") for k in range(6)]
    got = {r["idx"]: r["context"] for r in chunking.page_context(spark.createDataFrame(rows, "doc_id int, idx int, page int, content string")).collect()}
    assert got[0] == got[1] == "t0\nt1\n[Page 1] t2\n[Page 1] t3" and got[3] == "[Page 0] t0\n[Page 0] t1\nt2\nt3\n[Page 2] t4\n[Page 2] t5"


def test_open_sessions(spark):
    schema = "session_id string, user_id int, mode string, is_active boolean, expires_at timestamp, updated_at timestamp"
    s = spark.createDataFrame([("a", 1, "m", True, day(20), day(1)), ("b", 1, "m", True, day(20), day(2)), ("c", 2, "m", True, day(3), day(1)), ("d", 3, "m", True, None, day(1))], schema)
    r = spark.createDataFrame([(1, "m", "n1", day(10)), (2, "m", "n2", day(10)), (4, "m", "n4", day(10))], "user_id int, mode string, session_id string, now timestamp")
    got = {x["session_id"]: x for x in conversations.open_sessions(s, r).collect()}
    assert {k for k, x in got.items() if x["is_active"]} == {"b", "n2", "d", "n4"} and set(got) == {"a", "b", "c", "d", "n2", "n4"}
    assert got["b"]["expires_at"] == got["n2"]["expires_at"] == day(10) + dt.timedelta(days=180) and got["d"]["expires_at"] is None
    assert conversations.active_sessions(s).where("user_id = 1").first()["session_id"] == "b"


def test_tokens(spark):
    schema = "token_id int, user_id int, device_info string, expires_at timestamp, is_revoked boolean, revoked_at timestamp, created_at timestamp"
    old = spark.createDataFrame([(1, 1, "iPhone", day(30), False, None, day(1)), (2, 1, "iPhone", day(30), True, day(2), day(1)), (3, 1, "curl", day(30), False, None, day(1)), (4, 2, "iPad", day(5), False, None, day(1))], schema)
    new = spark.createDataFrame([(5, 1, "iphone 9", day(31), False, None, day(9)), (6, 1, "curl", day(31), False, None, day(9)), (7, 1, "iPhone", day(31), False, None, day(8))], schema)
    t = tokens.create(old, new)
    assert {r["token_id"] for r in t.collect()} == {2, 3, 4, 5, 6}
    now = F.lit("2024-01-10").cast("timestamp")
    assert [r["token_id"] for r in tokens.active(t, now).collect()] == [5, 6, 3]
    gone = tokens.revoke(t, F.col("user_id") == 1, now)
    assert {r["token_id"]: r["revoked_at"] for r in gone.where("is_revoked").collect()} == {2: day(2), 3: day(10), 5: day(10), 6: day(10)}
    assert {r["token_id"] for r in tokens.clean_up(gone, now).collect()} == {3, 5, 6}


def test_lifecycle(spark):
    docs = spark.createDataFrame([(1, "x", "failed"), (2, " ", "parsing"), (3, "y", "completed")], "doc_id int, text string, status string").withColumns({"progress": F.lit(5), "error": F.lit("e")})
    chunks = spark.createDataFrame([(1,), (1,), (3,)], "doc_id int")
    got = {r["doc_id"]: (r["status"], r["progress"]) for r in lifecycle.ingest(docs, chunks, chunks.distinct()).collect()}
    assert got == {1: ("embedding", 60), 2: ("failed", 10), 3: ("completed", 100)}
    assert {r["doc_id"] for r in lifecycle.reprocess(docs, docs).where("status = 'pending'").collect()} == {1, 3}
    assert "text" not in lifecycle.light(docs, "text").columns


def test_scalars(spark):
    one = spark.createDataFrame([('```json\n{"a": 1}\n```',)], "x string")
    assert one.select(T.robust_json(F.col("x"), "a int")["a"]).first()[0] == 1
    row = spark.createDataFrame([("table", "cap", "body", None)], "k string, c string, b string, f string")
    assert row.select(content.multimodal_text(F.col("k"), F.col("c"), F.col("b"), F.col("f"))).first()[0] == "[表格]\ncap\nbody"
    assert "<h1>T</h1><p>x</p>" in spark.range(1).select(content.export_html(F.lit("T"), F.lit("x"))).first()[0]
    assert spark.range(1).select(fusion.relation_text(F.lit("a"), F.lit("r"), F.lit("b"), F.lit(""))).first()[0] == "[关系] a ←r→ b"


def test_any_files_and_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in (("a.txt", "é one".encode()), ("b.docx", b"no zip"), ("c.pdf", b"%PDF"), ("d.md", b"# h")):
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["status"], r["error"]) for r in readers.any_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("é one", "completed", None), "d.md": ("# h", "completed", None), "b.docx": (None, "failed", "not a readable file"), "c.pdf": (None, "failed", "unsupported type: pdf")}
    chunks = spark.createDataFrame([("u", "c1", [1.0], {"x": 2.0})], "user_id string, chunk_id string, vector array<double>, terms map<string,double>")
    sinks.write_index(chunks, str(tmp_path / "both"))
    sinks.write_index(chunks.drop("terms"), str(tmp_path / "dense"))
    assert spark.read.parquet(str(tmp_path / "both" / "postings")).first()["term"] == "x" and not (tmp_path / "dense" / "postings").exists()


def test_exports(spark):
    docs = spark.createDataFrame([("T", "text", ["a"], None, "x")], "title string, file_type string, tags array<string>, created_at timestamp, content string")
    got = {f: content.export_files(docs, f).first() for f in content.MIME}
    assert [got[f]["filename"] for f in ("md", "html", "json")] == ["T.md", "T.html", "T.json"] and json.loads(got["json"]["body"])["title"] == "T"


def test_row_embedding_is_the_embedding(spark):
    from tessera.functions.vectors import hash_embedding, hash_vector

    docs = spark.createDataFrame([(1, "a bb ccc a"), (2, ""), (3, "流处理系统"), (4, "solo")], "doc_id int, text string")
    want = {r["doc_id"]: r["vector"] for r in hash_embedding(docs).collect()}
    for r in docs.select("doc_id", hash_vector(F.col("text")).alias("v")).collect():
        assert r["v"] == pytest.approx(want[r["doc_id"]])
