from tessera.llm.chat import rotate

SCHEMA = "conv_id long, turn long, role string, text string, mask string"


def test_every_participant(spark):
    rows = [(1, 0, "system", "Rules", "m"), (1, 1, "ann", "Hi", "m"), (1, 2, 'b"ob', None, "m"), (1, 3, "ann", "Bye é😀", "m"), (1, 3, "ann", "Bye é😀", "m"), (2, 0, "system", "alone", "m"), (None, 0, "ann", "x", "m"), (3, 0, None, "x", "m")]
    got = {r["perspective"]: r for r in rotate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"ann", 'b"ob'}
    ann, bob = got["ann"], got['b"ob']
    assert ann["text"] == "<|system|>\nRules<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=\"b'ob\"|>\n<|end|>\n<|assistant|>\nBye é😀<|end|>\n"
    parts = lambda r: [r["text"][int(a) : int(b)] for a, b in (s.split(":") for s in r["mask"].split(","))]
    assert parts(ann) == ["Hi<|end|>\n", "Bye é😀<|end|>\n"] and parts(bob) == ["<|end|>\n"]
    assert (ann["n_turns"], ann["n_masked"], bob["n_masked"]) == (4, 2, 1)


def test_long_and_unnumbered(spark):
    rows = [(1, t, "ab"[t % 2], f"t{t}", "") for t in range(150)] + [(1, None, "a", "loose", ""), (1, None, "b", "loose", "")]
    got = rotate(spark.createDataFrame(rows, SCHEMA)).where("perspective = 'a'").collect()
    order = sorted((r for r in got if r["segment"] is not None), key=lambda r: r["segment"])
    assert [r["segment"] for r in order] == [0, 1, 2] and sum(r["n_turns"] for r in got) == 152
    whole = "".join(r["text"] for r in order)
    assert whole.index("t0<") < whole.index("t63<") < whole.index("t64<") < whole.index("t149<")
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_of_one_number(spark, monkeypatch):
    from tessera.llm import chat

    monkeypatch.setattr(chat, "MOST_TURNS", 10)
    rows = [(1, 5, "ab"[k % 2], f"t{k:03d}", "") for k in range(95)] + [(1, None, "a", f"u{k:03d}", "") for k in range(20)] + [(2, 1, "a", "x", "")]
    got = [r for r in rotate(spark.createDataFrame(rows, SCHEMA).repartition(5)).where("perspective = 'a'").collect() if r["conv_id"] == 1]
    numbered = sorted((r for r in got if r["segment"] is not None), key=lambda r: r["bucket"])
    assert [r["bucket"] for r in numbered] == [chat.LOOSE * k for k in range(10)] and [r["n_turns"] for r in numbered] == [10] * 9 + [5]
    whole = "".join(r["text"] for r in numbered)
    places = [whole.index(f"{t}<") for _, t in sorted((r, t) for _, n, r, t, _ in rows if n == 5)]
    assert places == sorted(places)
    assert sum(r["n_turns"] for r in got) == 115
