"""The forward recursion and Baum-Welch against sums over all paths; base scores and counts against plain Python."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import hmm

K, S = 3, 7
RNG = np.random.default_rng(1)
FIRST, STEP, EMITS = RNG.dirichlet(np.ones(K)), RNG.dirichlet(np.ones(K), K), RNG.dirichlet(np.ones(S), K).T
TEXTS = [RNG.integers(0, S, n).astype(np.uint16) for n in (1, 5, 8, 3, 8)]
SCHEMA = "doc_id long, text string, rid int, h string, codes int"


def paths(codes):
    """Probability of each path of states."""
    for p in itertools.product(range(K), repeat=len(codes)):
        yield p, FIRST[p[0]] * EMITS[codes[0], p[0]] * np.prod([STEP[a, b] * EMITS[c, b] for a, b, c in zip(p, p[1:], codes[1:])])


@pytest.mark.parametrize("segment", [100, 2, 3])
def test_all_paths(segment):
    seqs, at = hmm.Sequences(FIRST, STEP, EMITS, segment), []
    first, pairs, kept = np.zeros(K), np.zeros((K, K)), np.zeros((S, K))
    whole = []
    for i, codes in enumerate(TEXTS):
        seqs.add(codes)
        at += [i] * (len(seqs.codes) - len(at))
        total = sum(x for _, x in paths(codes))
        whole.append(total)
        for p, x in paths(codes):
            first[p[0]] += x / total
            for a, b in zip(p, p[1:]):
                pairs[a, b] += x / total
            for c, s in zip(codes, p):
                kept[c, s] += x / total
    lay = hmm.Layout(np.array([len(c) for c in seqs.codes]))
    _, scale = hmm.forward(EMITS[np.concatenate(seqs.codes)[lay.source]], lay, STEP, np.array(seqs.start)[lay.order])
    assert np.allclose(np.bincount(at, hmm.log_likelihood(scale, lay)), np.log(whole), rtol=1e-12)
    for got, want in zip(hmm.expected_counts(seqs), (first, pairs, kept), strict=True):
        assert np.allclose(got, want, rtol=1e-9)


def rows():
    rng = np.random.default_rng(5)
    a, b = [[f"{c}{i}" for i in range(30)] for c in "xy"]
    made = [(i, " ".join(rng.choice((a, b)[i % 2], 40))) for i in range(300)]
    odd = [(None, "Once only\x0bWORDS\x1cword é É"), (4, None), (5, ""), (5, " \n\t"), (6, "x1 " * 9_000), (7, "ünseen " * 3 + "Y1"), (7, "ünseen " * 3 + "Y1"), (-3, "a" * 5_000)]
    return made + odd


def base_of(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in rows]


@pytest.mark.parametrize("symbols", [20, 1000])
def test_base_and_gain(spark, symbols):
    """Whatever words have symbols; the model tells the two kinds of texts apart, which single words can't."""
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows()], SCHEMA).repartition(3)
    models = []
    got = hmm.score(docs, symbols=symbols, fitted=models.append).collect()
    key = lambda r: tuple(map(str, r[:4]))
    got, want = sorted(got, key=key), sorted(base_of(rows()), key=key)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r["base_score"] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose(models[0].emits.sum(0), 1) and np.allclose(models[0].step.sum(1), 1) and all(r["score"] < 0 for r in got)
    made = [r for r in got if r["n_tokens"] == 41 and r["held_out"]]
    assert len(made) > 20 and (symbols == 20 or np.mean([r["score"] - r["base_score"] for r in made]) > 10)


def test_rounds_over_partitions(spark):
    """Counts don't depend on how texts are dealt; each round makes the training texts likelier."""
    texts = [[RNG.integers(0, 40), *RNG.integers(0, 40, n)] for n in RNG.integers(1, 60, 50)]
    unigram = np.full(hmm.SYMBOLS, 1e-9)
    unigram[:40] = 1 / 40
    df = spark.createDataFrame([(bytearray(np.array(t, np.uint16).tobytes()),) for t in texts], "codes binary")
    model, before = hmm.Model.start(unigram, 4), -np.inf
    for _ in range(3):
        one, many = (hmm.train_round(df.repartition(n), model) for n in (1, 4))
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(one, many, strict=True))
        seqs = hmm.Sequences(model.first, model.step, model.emits)
        for t in texts:
            seqs.add(np.array(t, np.uint16))
        lay = hmm.Layout(np.array([len(t) for t in texts]))
        _, scale = hmm.forward(model.emits[np.concatenate(seqs.codes)[lay.source]], lay, model.step, np.array(seqs.start)[lay.order])
        now = hmm.log_likelihood(scale, lay).sum()
        assert now > before
        before, model = now, hmm.Model.of_counts(*one, unigram)


def test_empty_and_held_out_only(spark):
    assert hmm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = hmm.score(spark.createDataFrame([(held, "a b", 1, "", 1)], SCHEMA)).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)


def test_all_training_texts_in_every_round(spark, monkeypatch):
    """No round takes a sample: the parts of the first are all training texts, each once, and the other rounds take all."""
    taken, plain = [], hmm.train_round
    monkeypatch.setattr(hmm, "train_round", lambda coded, model: (taken.append(coded.count()), plain(coded, model))[1])
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows()], SCHEMA)
    n = sum(not r["held_out"] for r in hmm.score(docs).select("held_out").collect())
    assert sum(taken[: -hmm.ROUNDS]) == n and taken[-hmm.ROUNDS :] == [n] * hmm.ROUNDS


def test_each_distinct_word_once(monkeypatch):
    """Tokens are told apart in Arrow and only distinct ones are hashed; a text is cut only where it alone would make a batch too large."""
    import pyarrow as pa
    import xxhash

    texts = ["B a\x0bb  A", None, "", " \n\t", "ünseen\x1c É é  " * 50, "a" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b"\n"] for t in texts]
    for size in (1 << 20, 1):
        monkeypatch.setattr(hmm, "PART_BYTES", size)
        got = []
        for _, words, places, n in hmm._texts([batch]):
            listed = words.to_pylist()
            assert len(set(listed)) == len(listed)
            h, cls = hmm.word_keys(words)
            assert [*h] == [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in listed] and [*cls] == [(w[-1] & 7) * 8 + min(len(w) // 2, 7) for w in listed]
            got += [[listed[i] for i in p] for p in np.split(places, np.cumsum(n)[:-1])]
        assert got == want
    seqs = hmm.Sequences(FIRST, STEP, EMITS)
    seqs.add(np.zeros(20_000, np.uint16))
    assert len(seqs.codes) == 1
