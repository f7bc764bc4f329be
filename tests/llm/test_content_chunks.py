import random

import numpy as np

from tessera.llm import content_chunks as C


def test_gear_is_rolling():
    data, table = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8), C.gear_table()
    h, want = np.uint32(0), []
    with np.errstate(over="ignore"):
        for b in data:
            h = (h << np.uint32(1)) + table[b]
            want.append(h)
    assert (C.gear(data, table) == np.array(want)).all()


def test_cuts_resist_shifts():
    data, table = np.random.default_rng(2).integers(97, 123, 5000).astype(np.uint8), C.gear_table()
    moved = np.concatenate([data[:100], data[:7], data[100:]])
    a, b = set(C.cut_points(data, table)), set(C.cut_points(moved, table) - 7)
    assert {x for x in a if x > 140} <= b
    assert np.diff(C.cut_points(np.zeros(5000, np.uint8), table)).max() <= C.MOST_BYTES


def test_run_digests_depend_on_content_alone():
    d = np.random.default_rng(3).integers(0, 1 << 63, (20, 2)).astype(np.uint64)
    twice = np.concatenate([d[5:9], d])
    assert (C.run_digests(d, np.array([5]), np.array([9])) == C.run_digests(twice, np.array([0]), np.array([4]))).all()
    assert (C.run_digests(twice, np.array([0, 9]), np.array([4, 13]))[0] == C.run_digests(twice, np.array([0, 9]), np.array([4, 13]))[1]).all()


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9)))
    noise = lambda n: " ".join(word() for _ in range(n))
    docs, planted = [], set()
    for k in range(60):
        p = noise(55 + k)
        for i in (3 * k, 3 * k + 1):
            docs.append((i, noise(rng.randint(0, 90)) + " " + p + " " + noise(rng.randint(0, 90))))
            planted.add(i)
        docs.append((3 * k + 2, noise(200)))
    docs += [(1000, None), (1001, ""), (1002, "short"), (1003, "short"), (None, docs[0][1]), (2, docs[2][1]), (1004, "z " * 4000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    rows = C.repeated_passages(df).collect()
    got = {r["doc_id"] for r in rows}
    assert got <= planted and len(got) >= 0.97 * len(planted)
    text = {i: (t or "").encode() for i, t in docs if i is not None}
    for r in rows:
        passage = text[r["doc_id"]][r["start"] : r["end"]]
        assert len(passage) >= C.LEAST_PASSAGE and passage == passage.strip() and r["first_doc"] <= r["doc_id"]
        assert any(passage in t for i, t in text.items() if i != r["doc_id"])
    assert C.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_51_short_words_are_all_found(spark):
    rng = random.Random(6)
    for letters in (3, 4):
        word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(letters))  # noqa: B023, E731
        noise = lambda n: " ".join(word() for _ in range(n))  # noqa: B023, E731
        docs = []
        for k in range(150):
            p = noise(51)
            docs += [(i, noise(rng.randint(10, 90)) + " " + p + " " + noise(rng.randint(10, 90))) for i in (2 * k, 2 * k + 1)]
        rows = C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r["doc_id"] for r in rows} == {i for i, _ in docs}
        text = {i: t.encode() for i, t in docs}
        assert all(text[r["doc_id"]][r["start"] : r["end"]] in text[r["doc_id"] ^ 1] for r in rows)


def test_every_window_has_a_cut():
    data, table = np.random.default_rng(5).integers(97, 123, 20000).astype(np.uint8), C.gear_table()
    assert np.diff(C.cut_points(data, table, span=96)).max() <= 96 < np.diff(C.cut_points(data, table)).max()


def test_against_brute_force(spark):
    """Documents share 60 words in a row or more exactly where passages are found, unless they share less."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    noise = lambda n: [word() for _ in range(n)]
    shared = [noise(n) for n in (8, 10, 60, 75, 120, 300)]
    docs = []
    for k in range(60):
        w = noise(rng.randint(20, 80))
        for p in rng.sample(shared, rng.choice([0, 1, 2])):
            w += p + noise(rng.randint(5, 40))
        docs.append((k, w))

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    must, may = set(), set()
    for n, out in ((60, must), (16, may)):
        sets = {k: grams(w, n) for k, w in docs}
        out |= {a for a, s in sets.items() for b, t in sets.items() if a != b and s & t}
    got = C.repeated_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in got}
    assert must <= found <= may and len(must) >= 20 and must != {k for k, _ in docs}


def test_numbers_of_documents(spark):
    p = " ".join(f"word{k} and" for k in range(60))
    docs = [(1, f"{p} . {p} . {p}"), (2, f"so {p}"), (3, "x y z " * 5), (4, f"{p} end")]
    got = C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4} and {r["n_docs"] for r in got} == {3} and {r["first_doc"] for r in got} == {1}


def test_drop_repeats_leaves_one_copy(spark):
    rng = random.Random(14)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(6)) for _ in range(n))
    p, own = noise(120), [noise(30) for _ in range(4)]
    docs = [(1, f"{own[0]} {p}", "u", "v"), (2, f"{own[1]} {p} {own[2]}", "u", "v"), (3, own[3], "u", "v"), (4, None, "u", "v"), (None, p, "u", "v")]
    rows = C.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string, _key string, _spans string")).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[1] == docs[0][1] and got[3] == own[3] and got[4] is None and got[None] == p
    assert got[2].startswith(own[1]) and got[2].endswith(own[2]) and len(got[2]) < len(own[1]) + len(own[2]) + len(p) // 2
    assert all((r["_key"], r["_spans"]) == ("u", "v") for r in rows)


def test_rows_of_one_id(spark):
    """Texts of one id are cut at their own offsets; other passages, and what stands around them, stay."""
    rng = random.Random(15)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(6)) for _ in range(n))
    p, q, own = noise(80), noise(80), [noise(n) for n in (150, 40, 20, 90, 60)]
    docs = [(1, f"{own[0]} {p}"), (2, f"{q} {own[1]}"), (7, f"{own[2]} {p} {own[3]}"), (7, f"{own[4]} {q}"), (7, f"{own[4]} {q}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r["text"] for r in C.drop_repeats(df).where("doc_id = 7").collect())
    a, b = max(got, key=len), min(got, key=len)
    assert len(got) == 3 and got.count(b) == 2
    assert a.startswith(own[2]) and a.endswith(own[3]) and len(a) < len(own[2]) + len(own[3]) + 200
    assert b.startswith(own[4]) and len(b) < len(own[4]) + 200
    texts = [t.encode() for _, t in docs]
    for r in C.repeated_passages(df).where("doc_id = 7").collect():
        assert any(t[r["start"] : r["end"]] in (p + q).encode() for t in texts[2:4])


def test_unspaced_texts(spark):
    """Unspaced scripts, encoded data and code without blanks, held against the longest common stretch of bytes."""
    rng = random.Random(16)
    kinds = {
        "han": lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n // 3)), "base64": lambda n: "".join(rng.choice("ABCDEFGHabcdefgh01234567+/") for _ in range(n)),
        "code": lambda n: "".join(rng.choice(["f(", "x", ")", ";", "a=b", "{", "}", "return"]) for _ in range(n // 2)),
    }
    docs, want, other = [], {}, {}
    for kind in kinds.values():
        for size in (240, 400, 2000):
            for _ in range(10):
                shared, k = kind(size), len(docs)
                for i in (k, k + 1):
                    head = kind(rng.randint(0, 300))
                    docs.append((i, head + shared + kind(rng.randint(0, 300))))
                    want[i], other[i] = (len(head.encode()), len((head + shared).encode())), 2 * k + 1 - i
        docs.append((len(docs), kind(900)))
    got = C.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {}
    for r in got:
        lo, hi = want[r["doc_id"]]
        assert docs[r["doc_id"]][1].encode()[r["start"] : r["end"]].decode() in docs[other[r["doc_id"]]][1]
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + min(r["end"], hi) - max(r["start"], lo)
    assert set(covered) == set(want)
    assert sum(covered.values()) > 0.85 * sum(hi - lo for lo, hi in want.values())


def test_chunks_of_bytes():
    data, table = np.frombuffer(("é漢x " * 300 + "z" * 500).encode(), np.uint8), C.gear_table()
    ends = C.chunk_ends(data, table)
    starts, stops = C.chunks(data, ends)
    assert (np.diff(ends) <= C.SPAN + 3).all() and (stops - starts >= C.LEAST_CHUNK).all()
    for e in ends:
        data[:e].tobytes().decode()
