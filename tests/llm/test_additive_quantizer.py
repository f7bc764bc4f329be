import numpy as np

from tessera.llm import additive_quantizer as A


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = list(np.array(v, np.float32).astype(float))
        ok[i] = min(ok[i], v) if i in ok else v
    out = set()
    for q in ok:
        if q % every == 0:
            near = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(near, 1)}
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(30)]  # one common vector, more often than k
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1.0] * 7), (None, [1.0] * 8), (7, rows[7][1]), (8, [1.0] * 8), (400, [-0.0, 1.0] * 4), (401, [0.0, 1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = A.search(df, k=6, every=10).collect()
    want = brute(rows, 6, 10)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == {w[:3] for w in want}
    exact = {w[:3]: w[3] for w in want}
    assert all(abs(r["score"] - exact[r["query_id"], r["rank"], r["vec_id"]]) < 1e-12 for r in got)
    assert A.search(df.limit(0)).count() == 0


def test_beam_beats_greedy_and_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16)).astype(np.float32)
    books = A.fit_codebooks(x, books=6, words=64)
    error = {b: np.mean((x - sum(books[m][A.encode(x, books, b)[0][:, m]] for m in range(6))) ** 2) for b in (1, 6)}
    assert error[6] < error[1]
    codes, gain = A.encode(x, books)
    q = x[:50]
    top = np.argsort(-(q.astype(float) @ x.T.astype(float)), 1)[:, :20]
    best = np.argsort(-A.lookup_scores(q, codes, gain, books), 1)[:, :200]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top, best, strict=True)]) >= 0.9


def test_recall_of_search(spark, monkeypatch):
    """Many blocks, and few candidates of each: quantisation decides who is ranked."""
    monkeypatch.setattr(A, "CODE_BLOCK", 5000)
    monkeypatch.setattr(A, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = A.search(df, k=20, every=400, rerank=100, sample=4000).collect()
    asked = np.arange(0, 20_000, 400)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(q), int(c)) for q, s in zip(asked, score, strict=True) for c in np.argsort(-s)[:20]}
    assert len(got) == 20 * len(asked)
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) / len(want) >= 0.9
    assert all(abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12 for r in got)


def test_double_precision(spark):
    big = [1e200, 1.0, 0.0]
    rows = [(0, [1.0, 1.0, 1.0]), (1, [1.0 + 1e-12, 1.0, 1.0]), (2, [1.0 + 2e-12, 1.0, 1.0]), (3, big)]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 3), (0, 2), (0, 1), (2, 3), (2, 1), (2, 0)]
    assert got[0]["score"] == 1e200 + 1.0


def test_lengths_have_codebooks_of_their_own(spark, monkeypatch):
    """Three lengths, mixed in every batch: two of them coded, one ranked as a whole; rows meet their own length only."""
    monkeypatch.setattr(A, "CODE_BLOCK", 1000)
    rng = np.random.default_rng(7)
    x = {n: rng.standard_normal((m, n)) for n, m in ((16, 3000), (24, 1500), (5, 40))}
    rows = [(10 * i + j, v.tolist()) for j, n in enumerate(x) for i, v in enumerate(x[n])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = A.search(df, k=10, every=20, rerank=60, sample=1000).collect()
    hit = every = 0
    for j, n in enumerate(x):
        mine = [r for r in got if r["query_id"] % 10 == j]
        asked = [i for i in range(len(x[n])) if (10 * i + j) % 20 == 0]
        want = {(10 * q + j, 10 * int(c) + j) for q in asked for c in [c for c in np.argsort(-(x[n] @ x[n][q])) if c != q][:10]}
        assert {r["vec_id"] % 10 for r in mine} <= {j}
        assert len(mine) == len(want)
        hit, every = hit + len(want & {(r["query_id"], r["vec_id"]) for r in mine}), every + len(want)
    assert every and hit / every >= 0.9
