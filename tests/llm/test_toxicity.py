import random

import numpy as np
import zlib

from tessera.llm import toxicity as X


def make(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 150))]
        bad = i % 8 == 0
        if bad:
            for _ in range(2 + len(w) // 25):
                w.insert(rng.randrange(len(w)), rng.choice(["IDIOT!", "moron", "scum,"]) if i % 16 else "xyzzy" + word())
        docs.append((i, " ".join(w), "en"))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = make()
    docs += [(5000, None, "en"), (5001, "", "en"), (None, "moron idiot scum", "en"), (3, docs[3][1], "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.toxicity(d, y).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 8 == 0) for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] < 0.5 and by[None]["held_out"] is None and by[None]["predicted"] == 1
    kept = {r["doc_id"] for r in X.reject_toxic(d, y).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_held_out_labels_play_no_part(spark):
    docs, labels = make(300, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in X.toxicity(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flip))
    assert a == b


def test_without_labels_or_rows(spark):
    docs, _ = make(20)
    d, none = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in X.toxicity(d, none).collect()} == {0}
    assert X.toxicity(d.limit(0), none).count() == 0


def test_label_model_finds_rates():
    rng = np.random.default_rng(5)
    y = rng.random(20000) < 0.1
    hit, miss = np.array([0.6, 0.5, 0.7, 0.4, 0.3]), np.array([0.01, 0.02, 0.005, 0.01, 0.3])
    v = (rng.random((20000, 5)) < np.where(y[:, None], hit, miss)).astype(np.int8)
    p, c = np.unique(v, axis=0, return_counts=True)
    prior, h, m, r = X.label_model(p, c)
    post = X.posterior(p, prior, h, m, r)
    match = post[[np.flatnonzero((p == row).all(1))[0] for row in v]] >= 0.5
    assert np.mean(match == y) >= 0.95 and (h[:4] > 5 * m[:4]).all()


def plain_features(text):
    """Words without ASCII punctuation, and beginnings that two words or more, one in a hundred, share."""
    words = "".join(" " if c < "\x7f" and not c.isalnum() and not c.isspace() and c > " " else c for c in (text or "").lower()).split()
    begun = {}
    for w in words:
        for n in X.BEGINNINGS:
            if len(w) > n:
                begun[w[:n] + "*"] = begun.get(w[:n] + "*", 0) + 1
    return set(words) | {s for s, n in begun.items() if n >= max(2, len(words) / 100)}


def test_brute_force_of_features_counts_and_scores(spark):
    docs, labels = make(400, 7)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, toxic = {i: t for i, t, _ in docs}, {i: t for i, _, t in labels}
    learnt = [i for i in toxic if zlib.crc32(str(i).encode()) % 5]
    counts = {}
    for i in learnt:
        for f in plain_features(texts[i]):
            counts.setdefault(f, [0, 0])[toxic[i]] += 1
    labelled = spark.createDataFrame([(texts[i], toxic[i]) for i in learnt], "text string, toxic int")
    found = X.association(labelled)
    assert found and all(counts[f] == [clean, bad] for f, bad, clean, _ in found)
    strong = {f for f, (c, t) in counts.items() if t >= X.LEAST_ROWS and not c and t >= 20}
    assert strong <= {f for f, *_ in found}
    model, _ = X.train(d, y)
    for r in X.toxicity(d, y).collect():
        logit = model.bias + sum(model.weights[f] for f in plain_features(texts[r["doc_id"]]) & model.weights.keys())
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-9
    again = {r["doc_id"]: r["score"] for r in X.score(d, model).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in X.toxicity(d, y).collect())
