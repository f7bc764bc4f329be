import random
import re

import numpy as np
import pytest

from tessera.llm import hyperminhash as H
from tessera.llm.components import connected_components


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, percent):
    ids = sorted(i for i, _ in docs if i is not None)
    s, up = {i: shingles(t) for i, t in docs}, {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and s[x] and s[y] and 100 * len(s[x] & s[y]) >= percent * len(s[x] | s[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120, 300]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((n, " ".join(w)))
            n += 1
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "a b c d"), (n + 4, "A  b\nC d"), (n + 5, "a b c d"), (n + 6, "one"), (n + 7, "x " * 3000)]


@pytest.mark.parametrize("percent", [80, 85])
def test_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_DOCS", 8)  # many blocks
    docs = corpus(percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute(docs, percent)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (1, "a b c d e f", None)], "doc_id long, text string, id string")
    got = sorted((tuple(r) for r in H.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)], key=repr)
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 1 << 63, int(2000 * share), np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 2000 - len(common), np.uint64)]) for _ in range(2))
        r = H.registers([a, b], 2048)
        true = len(common) / (4000 - len(common))
        assert abs(H.estimate(np.array([(r[0] == r[1]).sum()]), 2048)[0] - true) < 0.05


def test_compress_keeps_order_bits():
    r = H.compress(np.array([0, 1, 2, 3, (1 << 32) - 1, 1 << 31, 1 << 20], np.uint32))
    assert list(r >> H.MANTISSA) == [32, 31, 30, 30, 0, 0, 11] and r[3] != r[2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_open_buckets(spark, monkeypatch):
    """Rows that meet in buckets whose hub is unlike them are compared among themselves, over several blocks."""
    monkeypatch.setattr(H, "BLOCK_DOCS", 3)
    monkeypatch.setattr(H, "STAR_LEAVES", 2)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    docs, n = [], 0
    for _ in range(4):  # families whose members share about half, in groups of near copies
        common = [rng.choice(words) for _ in range(150)]
        for _ in range(4):
            own = common + [rng.choice(words) for _ in range(40)]
            for _ in range(4):
                w = list(own)
                w[rng.randrange(len(w))] = rng.choice(words)
                docs.append((n, " ".join(w)))
                n += 1
    rng.shuffle(docs)
    seen = []
    before = H._open_links
    monkeypatch.setattr(H, "_open_links", lambda *a: seen.append(before(*a)) or seen[-1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    assert got == brute(docs, 85)
    assert seen[0] is not None


def test_many_near_copies(spark):
    rng = random.Random(22)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = []
    for i in range(1000):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(w)))
    got = H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, 1000)]


def test_accidents(spark):
    rng = np.random.default_rng(6)
    for n, m in ((50, 50), (50, 5000), (3000, 3000)):
        share = [np.mean(np.equal(*H.registers([rng.integers(0, 1 << 63, x, np.uint64) for x in (n, m)], 4000))) for _ in range(12)]
        assert abs(np.mean(share) - H.accident(np.array([n]), np.array([m]))[0]) < 3e-4
