"""Hard negatives against plain Python over all pairs, and bounds against scores."""

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, q string"


def brute(rows):
    kept = {}
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        row = ((y + 1) % 10 if i % 7 == 0 else y, q)
        kept[i] = min(row, kept.get(i, row))
    out = []
    for a, (y, q) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, q2)), i, y2) for i, (y2, q2) in kept.items() if i != a and len(q2) == len(q))
        for p, pos, _ in [x for x in scored if x[2] == y][:5]:
            good = [(n, i) for n, i, y2 in scored if y2 != y and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, pos, r, i, -p, -n) for r, (n, i) in enumerate(good, 1)]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in hn.hard_negatives(df, **how).collect())
    want = brute(rows)
    assert got == want
    return want


def test_clusters_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(12)).tolist(), int(rng.integers(0, 10))) for i in range(1200)]
    hot = [0.5, -0.25] * 6
    rows += [(i, hot, i % 2) for i in range(2000, 2400)] + [(i, [0.0] * 12, 3) for i in range(2500, 2520)]
    rows += [(3000 + i, rng.standard_normal(5).tolist(), i % 3) for i in range(101)]  # another length
    rows += [(5000, None, 1), (5050, hot, None), (5100, [*hot[:-1], None], 1), (5150, [*hot[:-1], float("nan")], 1), (5200, [float("inf"), *hot[1:]], 1), (None, hot, 1), (5250, [], 1)]
    rows += [(50, hot, 4), (50, hot, 4), (-50, hot, 1), (-49, hot, 1), (6000, [1e-9] * 12, 2)]
    assert len(check(spark, rows)) > 300


def test_small_and_large_numbers(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert check(spark, [(50, [1.0, 2.0], 1)]) == []
    rows = [(i, [3.0e5 * (1 + i % 7), float(i % 11), 1.0e6], i % 2) for i in range(0, 120)]  # sums beyond doubles
    assert check(spark, rows)


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_bounds(spread):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16)) * 100
    x = np.floor(centres[rng.integers(0, 8, 4000)] + 100 * spread * rng.standard_normal((4000, 16)))
    x[7] = 0
    c = hn.fit_directions(x[:2000])
    ang, norm = hn.angles(x, c)
    order = np.lexsort((ang.min(1), ang.argmin(1)))
    skipped = 0
    for at in range(0, 4000, 100):
        w = order[at : at + 100]
        top, bottom = hn.score_bounds(ang[:500], norm[:500], ang[w].min(0), ang[w].max(0), norm[w].min(), norm[w].max())
        s = x[:500] @ x[w].T
        assert (s.max(1) <= top).all() and (s.min(1) >= bottom).all()
        skipped += (top < 0.5 * norm[:500] ** 2).sum()
    assert spread > 0.1 or skipped > 0.6 * 40 * 500  # windows that can't hold half of an anchor's own score
