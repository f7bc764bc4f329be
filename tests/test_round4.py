"""Steps whose work or memory grew faster than their input, and sums that hung on their rounding."""

import re
import time

from pyspark.sql import functions as F

from tessera.functions import text as T


def _cut(t, n=2000):
    head = t[:n]
    if len(t) <= n:
        return t
    line = head.rfind("\n")
    stop = max(m.start() for m in re.finditer(f"[{T.SENTENCE_END}]", head)) if re.search(f"[{T.SENTENCE_END}]", head) else -1
    return head[:line] if line > n * 0.8 else head[: stop + 1] if stop > n * 0.8 else head + "..."


def test_cut_context_looks_once(spark):
    """Texts without a sentence end cost no more than their length: a pattern took the square of it, minutes for these rows."""
    texts = ["w" * 3000, "a. " * 900, "w" * 1700 + "\n" + "v" * 900, "w" * 1601 + "！" + "é𝄞" * 400, "w" * 1600 + "." + "x" * 500, "短。" * 1100, "x" * 1999 + ".y", "", "x" * 2000]
    got = spark.createDataFrame([*enumerate(texts)], "k int, t string").select("k", T.cut_context(F.col("t")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in got} == {k: _cut(t) for k, t in enumerate(texts)}
    start = time.time()
    long = spark.range(60_000).select(F.concat(F.repeat(F.lit("word "), F.lit(500)), F.col("id").cast("string")).alias("t"))
    assert long.select(F.length(T.cut_context(F.col("t"))).alias("n")).agg(F.max("n")).first()[0] == 2003
    assert time.time() - start < 25


def test_likeness_at_the_threshold(spark):
    """The last two sentences are alike by just under a half, as whole numbers over norms say; sums of tenths rounded that up."""
    from tessera.operators import chunking

    first = "It tion stenes on thedndre re therlyan, heblent and onenin ththes was reingnting wh. Hehean of thsthant. In of of onintion of nthe."
    docs = spark.createDataFrame([(1, first + " The ernder threthed.")], "doc_id int, text string")
    assert [r["content"] for r in chunking.semantic_chunks(docs).orderBy("idx").collect()] == [first, "The ernder threthed."]


def test_pages_in_parts(spark):
    """Batches of pages go through Python in parts, as they come, not as frames of whole batches; results stay."""
    from tessera.operators import content

    pages = [(i, None if i % 50 == 7 else f"<title>t{i}</title><body><article><h1>H{i}</h1><p>{'x' * (i * 997 % 40_000)}</p></article></body>") for i in range(400)]
    got = content.pages_to_markdown(spark.createDataFrame(pages, "page_id long, html string").coalesce(1))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == [(i, *content.read_page(h)) for i, h in pages]


def test_listed_counts_send_no_appearances(spark):
    """As appearance_counts of single rows, also of documents in several rows; no grouping by document and name."""
    from tessera.operators import graph

    rows = [("u", 1, ["x", "x"]), ("u", 2, ["x"]), ("u", 2, ["y", "x"]), ("v", 3, ["x"]), ("v", 4, []), (None, 5, ["z"]), ("v", 6, None)]
    lists = spark.createDataFrame(rows, "user_id string, doc_id int, names array<string>")
    key = lambda r: repr(tuple(r))
    want = graph.appearance_counts(lists.select("user_id", "doc_id", F.explode("names").alias("entity_name")))
    got = graph.listed_counts(lists)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_postings_shuffle_texts_only(spark, tmp_path):
    """Words are counted where they are split; dealt by block they are stored without a shuffle, and a search's scan looks for its terms."""
    from tessera.operators import retrieval
    from tessera.sources import stores

    docs = spark.createDataFrame([(i, f"All all w{i % 9} x{i % 7}. {'rare ' * (i % 4)}") for i in range(300)] + [(7, "all again")], "doc_id long, text string")
    held = retrieval.term_postings(docs.withColumn("block", stores.block_of(F.col("doc_id"), 4)), by=("block",))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    key = lambda r: (r["doc_id"], r["term"], r["weight"])
    assert sorted(map(key, held.collect())) == sorted(map(key, retrieval.term_postings(docs).collect()))
    stores.write_postings(held, str(tmp_path / "p"), block_bits=4)
    query = spark.createDataFrame([("all", 1.0), ("rare", 2.0), ("w3", 0.5)], "term string, q double")
    found = stores.search_postings(spark, str(tmp_path / "p"), query, 12, first=2)
    assert "In(term, [" in found._jdf.queryExecution().executedPlan().toString()
    want = held.join(query, "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(12)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]


def test_source_is_parsed_once(spark):
    """A source's JSON and its joined text are made once, however often later steps use them."""
    from tessera.operators import structured

    rows = [(1, '["a", " b ", "c"]', 1, 0), (2, "not [json", 0, 0), (3, '"x"', 0, 0), (4, None, 0, 0), (5, '[{"type": "text", "text": "t", "text_level": 2}]', 0, 0), (6, "[]", 0, 0)]
    got = structured.any_contexts(spark.createDataFrame(rows, "id int, source string, index int, page_idx int"))
    assert got.columns == ["id", "source", "index", "page_idx", "context"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count(" AS _whole#") == 1
    assert [r["context"] for r in got.orderBy("id").collect()] == ["a\nc", "not [json", "x", "", "## t", ""]


def test_modes_share_what_they_find(spark, monkeypatch):
    """Several modes look around a graph once, and say what each says alone."""
    from tessera.operators import graph, search

    entities = spark.createDataFrame([(f"n{i}", "k", f"about {i}") for i in range(9)], "name string, kind string, description string")
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i * 2 % 9}", "e", "") for i in range(9)], "edge_id long, src string, dst string, kind string, description string")
    terms = spark.createDataFrame([("n1", 0), ("n4", 1)], "term string, pos int")
    vector = spark.createDataFrame([("a", "text a", 0.9, 1), ("b", "text b", 0.5, 2)], "chunk_id string, content string, score double, seq long")
    known, modes = search.Graph(entities, edges), (*search.MODES, "odd")
    want = {m: search.context(m, vector, known, terms).first()[0] for m in modes}
    called = []
    for name in ("local_query", "nearest_trails"):
        plain = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda *a, _n=name, _p=plain: (called.append(_n), _p(*a))[1])
    assert {r["mode"]: r["context"] for r in search.contexts(modes, vector, known, terms).collect()} == want
    assert sorted(called) == ["local_query", "nearest_trails"]


def test_live_results_shuffle_no_documents(spark):
    """A few results meet all documents without a shuffle of these; results with several vectors or document rows stay as they were."""
    from tessera.operators import search

    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 0, [1.0, 0.5]), (4, 1, [1.0, 0.0])], "doc_id long, user_id int, embedding array<double>")
    docs = spark.createDataFrame([(1, "completed", None, ["x"]), (2, "deleted", None, ["x"]), (3, "completed", None, ["x"]), (3, "completed", None, ["y"])], "doc_id long, status string, deleted_at timestamp, tags array<string>")
    got = search.search_documents(vectors, vectors.where("doc_id = 4").select(F.col("embedding").alias("q")), docs, F.lit(0), 10)
    assert [(r["doc_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (1, 2), (3, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
