"""The manifest against one that sorts, on odd tables and several sizes of trees."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle

SCHEMA = "lang string, doc_id long, source string, n_chars long, text string, leaf string, base int"
H = merkle.digest


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def brute(rows):
    """Expected rows by sorting."""
    leaf = lambda r, more=0: H(*map(part, (r[1], r[2], r[0], None if r[3] is None else r[3] + more, r[4])))
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or 0, leaf(r))) for g in langs}
    trees = {g: build([leaf(r) for r in groups[g]]) for g in langs}
    top = build([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(groups[g]):
            bad = r[1] is not None and zlib.crc32(str(r[1]).encode()) % 7 == 0
            node, proof = leaf(r, int(bad)), []
            for levels, i in ((trees[g], at), (top, k)):
                for nodes in levels[:-1]:
                    first = i & ~1
                    run = nodes[first : first + 2]
                    proof += [x for j, x in enumerate(run) if first + j != i]
                    node = H(*[node if first + j == i else x for j, x in enumerate(run)])
                    i >>= 1
            out.append((r[1], leaf(r), trees[g][-1][0], top[-1][0], H(*proof), node, node == top[-1][0]))
    return out


def check(spark, rows, **how):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **how).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 3)
    rows = [("en", i, "web", (10 + i) % 10**9, f"text {i} é") for i in [*range(40), -5, -70, 1 << 62, -(1 << 63), (1 << 63) - 1, 100_000, 5_000_000]]
    rows += [("en", 3, "web", 13, "text 3 é")] * 9  # rows of one id, equal and not
    rows += [("en", 3, "web", 13, f"other {k}") for k in range(7)] + [("en", None, None, None, None)] * 4 + [("en", None, "s", 1, "t")]
    rows += [(None, 14, None, None, ""), (None, 21, "a", (1 << 63) - 1, "b"), ("", 7, "", 0, ""), ("zz", None, None, None, None), ("é", 1, "s", 2, "x" * 70_000)]
    random.Random(3).shuffle(rows)
    got = check(spark, rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 3, 257])
def test_sizes(spark, n):
    check(spark, [("de", 64 * i if i % 2 else i, "s", i, "t") for i in range(n)])


def test_arrays_of_four_slots(spark):
    check(spark, [("abcdefgh"[i % 8] if i % 3 else "m", i * 97, "s", i, "t") for i in range(300)], levels=2)


def test_empty_and_no_parts(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H() == hashlib.sha256(b"").hexdigest()
