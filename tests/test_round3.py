"""Context sources of any form, degrading chunking, typed and limited graph expansion."""

import json

from pyspark.sql import functions as F

from tessera.operators import chunking, graph, lifecycle, retrieval, structured


def test_sources_of_any_form(spark):
    layout = [{"type": "text", "text": "Head", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "a"}, {"type": "image", "image_caption": ["one", "two"], "page_idx": 1}, {"type": "text", "text": " ", "page_idx": 1}, {"type": "text", "text": "b", "page_idx": 2}, {"type": "table", "table_caption": "t", "page_idx": 1}, 5]
    rows = [
        (0, json.dumps(layout), 1, 1), (1, json.dumps(layout), None, None), (2, json.dumps([" x ", "y", {"content": "z "}, 7, ""]), 1, 0), (3, '"quoted"', 0, 0), (4, "[not json", 0, 0),
        (5, None, 0, 0), (6, "", 0, 0), (7, "[]", 0, 0), (8, '{"a": 1}', 0, 0), (9, "12", 0, 0), (10, json.dumps(["x", "y"]), 9, 0), (11, "w" * 1900 + ". " + "v" * 300, 0, 0),
    ]
    df = spark.createDataFrame(rows, "k int, source string, index int, page_idx int")
    page = {r["k"]: r["context"] for r in structured.any_contexts(df).collect()}
    assert page[0] == "[Page 0] # Head\n[Page 0] a\n[Page 2] b" and page[1] == "# Head\na"
    assert page[2] == "x\nz" and page[3] == "quoted" and page[4] == "[not json"
    assert [page[k] for k in (5, 6, 7, 8, 9, 10)] == [""] * 6 and page[11] == "w" * 1900 + "."
    chunk = {r["k"]: r["context"] for r in structured.any_contexts(df, mode="chunk", types=("text", "image", "table")).collect()}
    assert chunk[0] == "# Head\n[Image: one, two]" and chunk[2] == "x\nz"
    all_types = {r["k"]: r["context"] for r in structured.any_contexts(df, types=("text", "image", "table")).collect()}
    assert all_types[0] == "[Page 0] # Head\n[Page 0] a\n[Image: one, two]\n[Page 2] b\n[Table: t]"


def test_limited_trails_are_the_first_of_all(spark):
    edges = [(i, f"n{i * 7 % 23}", f"n{i * i % 19}", "k" if i % 3 else None, "d" * (i % 2)) for i in range(60)] + [(100 + i, "n1", "n2", "k", "") for i in range(4)] + [(200, "n3", "n3", "k", "")]
    e = spark.createDataFrame(edges, "edge_id long, src string, dst string, kind string, description string")
    seeds = spark.createDataFrame([("n1",), ("n5",), ("nowhere",)], "seed string")
    order = ["hops", "seed", "target", "rels"]
    every = graph.trails(e, seeds, 3, ("kind", "description")).select("seed", "target", "hops", "rels").distinct().orderBy(*order).collect()
    for limit in (1, 5, 12, 50, 400):
        got = graph.nearest_trails(e, seeds, 3, limit, ("kind", "description")).orderBy(*order).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in every[:limit]]


def test_hub_does_not_explode(spark):
    """Three seeds at a hub of very many edges: all trails of three hops would be a third power of that."""
    n = 1_000_000
    hub = spark.range(n).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("src"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1).alias("dst"), F.lit("k").alias("kind"), F.lit("").alias("description"))
    tail = spark.range(3).select((F.col("id") + n).alias("edge_id"), (-F.col("id") - 1).alias("src"), F.lit(0).cast("long").alias("dst"), F.lit("k").alias("kind"), F.lit("").alias("description"))
    seeds = spark.range(3).select((-F.col("id") - 1).alias("seed"))
    got = graph.nearest_trails(hub.unionByName(tail), seeds, 3, 50, ("kind", "description")).collect()
    assert len(got) == 50 and [r["hops"] for r in got[:3]] == [1, 1, 1]
    assert {r["target"] for r in got if r["hops"] == 2 and r["seed"] == -3} <= {*range(-3, 80)}


def test_through_documents(spark):
    rel = spark.createDataFrame([(1, "a", "b", "r", None), (2, "b", "c", None, "x")], "edge_id int, source string, target string, relation_type string, description string")
    app = spark.createDataFrame([("a", 9), ("d", 9), ("a", 9), ("e", 8)], "entity_name string, doc_id int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    names, said = graph.entity_neighbourhood(rel, app, seeds)
    assert {r["entity_name"] for r in names.collect()} == {"a", "b", "c", "d"}
    assert {tuple(r)[1:] for r in said.collect()} == {("r", "a", "b"), ("", "b", "c"), ("", "a", ""), ("", "d", "")}
    assert all(r["target"] != "9" for r in graph.typed_trails(rel, app, seeds, 3).collect())


def test_chunks_by_strategy(spark):
    """Against a plain version: which documents fail, and what they and the others become."""

    def load():
        def embed(sentences):
            if any("boom" in s for s in sentences):
                raise ValueError("boom")
            if any("short" in s for s in sentences):
                return [[1.0]]
            return [[s.count("a"), s.count("b"), 0.0] for s in sentences]

        return embed

    a, b = "aa a aaa a. " * 12, "bb b bbb b. " * 12
    texts = [a + b, "one boom. " + a, "short. " + b, None, "", "Single sentence only", a, a + b]
    asked = ["semantic"] * 6 + ["recursive", None]
    df = spark.createDataFrame([*zip(range(8), texts, asked)], "doc_id int, text string, how string")
    got = {}
    for r in chunking.chunk_by_strategy(df, load, F.col("how"), least=20, most=90).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["used"], r["error"]))
    fixed = {}
    for r in chunking.recursive_chunks(df).orderBy("doc_id", "idx").collect():
        fixed.setdefault(r["doc_id"], []).append(r["content"])
    runs = lambda c, n: [" ".join([c] * n)]
    sa, sb = "aa a aaa a.", "bb b bbb b."
    assert [x[0] for x in got[0]] == [*runs(sa, 8), *runs(sa, 4), *runs(sb, 8), *runs(sb, 4)] and {x[1:] for x in got[0]} == {("semantic", None)}
    assert [x[0] for x in got[1]] == fixed[1] and {x[1:] for x in got[1]} == {("recursive", "ValueError: boom")}
    assert [x[0] for x in got[2]] == fixed[2] and got[2][0][2] == "ValueError: 1 vectors for 13 sentences"
    assert 3 not in got and 4 not in got and got[5] == [("Single sentence only", "semantic", None)]
    assert [[x[0] for x in got[k]] for k in (6, 7)] == [fixed[6], fixed[7]] and {x[1:] for x in got[7]} == {("recursive", None)}

    def broken():
        raise OSError("no model")

    lost = chunking.chunk_by_strategy(df, broken, F.lit("semantic")).where("doc_id in (0, 5)").collect()
    assert {(r["used"], r["error"]) for r in lost} == {("recursive", "OSError: no model")}
    assert "".join(r["content"] for r in lost if r["doc_id"] == 5) == "Single sentence only"


def test_sentences_stay_whole_and_in_order():
    sentences = [f"s{i} {'x' * (i * 37 % 140)}." for i in range(200)]
    like = [1.0 if i % 7 else 0.0 for i in range(200)]
    got = chunking.merge_sentences(sentences, like, 100, 750, 0.5)
    assert " ".join(got) == " ".join(sentences) and all(len(c) <= 760 for c in got) and sum(len(c) < 100 for c in got) <= 1
    assert chunking.merge_sentences([], []) == []


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0]), (4, [2.0]), (5, None), (6, [None, 1.0]), (7, []), (8, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id in (1, 3, 5, 7)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.knn_batch(v, asked, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (3, 1): 3, (3, 2): 4}


def test_reranked_rows_whatever_the_limit(spark):
    found = spark.createDataFrame([(i, 0.5 - i / 100) for i in range(9)], "vec_id long, score double")
    assert [r["vec_id"] for r in retrieval.rerank_guard(found, 2).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert retrieval.rerank_guard(found, 2, skip_at=0.5).count() == 2


def test_limit_before_paths(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i < 6 else None, i) for i in range(8)], "doc_id int, file_path string, created_at int")
    assert {r["doc_id"] for r in lifecycle.recent_paths(rows, 5).collect()} == {7, 6, 5, 4}
    assert {r["doc_id"] for r in lifecycle.recent_paths(rows, 3).collect()} == {7, 6, 5}


def test_appearance_counts(spark):
    rows = [("u", 1, "x"), ("u", 1, "x"), ("u", 2, "x"), ("u", 2, "y"), ("v", 3, "x")]
    got = {(r["user_id"], r["doc_id"]): (r["n_entities"], r["n_appearances"]) for r in graph.appearance_counts(spark.createDataFrame(rows, "user_id string, doc_id int, entity_name string")).collect()}
    assert got == {("u", 1): (1, 2), ("u", 2): (2, 2), ("v", 3): (1, 1), ("u", None): (2, 4), ("v", None): (1, 1), (None, None): (2, 5)}


def test_recursive_chunks_are_places_of_the_text(spark):
    """Every chunk stands where it says; chunks come in order, overlap by no more than asked and leave out white space alone."""
    import random

    rng = random.Random(3)
    bits = ["word{} ", "longer words {} here, ", "\n{}", "\n\n{}", "。{}", "end{}. ", "x" * 90 + "{}", "é{}？", " {}"]
    texts = ["".join(rng.choice(bits).format(k) for k in range(n)) for n in (0, 1, 5, 40, 200, 600)] + [None, "\n\n ", "".join(map(str, range(1000, 1400)))]
    got = {}
    for r in chunking.recursive_chunks(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), 120, 30).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        parts = got.get(i, [])
        assert bool(parts) == bool((t or "").strip()) and [r["idx"] for r in parts] == [*range(len(parts))]
        end = 0
        for r in parts:
            assert t[r["start"] : r["end"]] == r["content"] and 0 < len(r["content"]) <= 120
            assert not t[end : r["start"]].strip() and end - r["start"] <= 30
            end = r["end"]
        assert not (t or "")[end:].strip()


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    from tessera.functions import sizes
    from tessera.operators import retrieval

    side = spark.range(10)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizes.broadcast_small(side, 10)) and not hinted(sizes.broadcast_small(side, 9))
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, q double")
    want = [(1, 4.0), (2, 2.0)]
    assert [tuple(r) for r in retrieval.search_terms(docs, terms, 5).collect()] == want
    monkeypatch.setattr(retrieval, "broadcast_small", lambda side: sizes.broadcast_small(side, 0))
    assert [tuple(r) for r in retrieval.search_terms(docs, terms, 5).collect()] == want
