import random

import pytest

from tessera.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id long, slots string"
BENCH = [
    (1, "If John buys 3 apples at 2 dollars each and then John sells 3 apples, how many dollars did he pay?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wise owls watch from above"),
    (3, None),
    (4, ""),
    (5, "too short"),
]


def found(spark, docs, bench=BENCH):
    df = spark.createDataFrame([(i, t, 99, "x") for i, t in docs], SCHEMA)
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["n_changed"] for r in D.contamination(df, b).collect()}


def test_copies_parameters_and_clean(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.random())[2:4].translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    docs = [
        (10, noise(40) + " " + BENCH[0][1] + " " + noise(40)),
        (11, noise(20) + ". " + BENCH[0][1].replace("John", "Mary").replace("3", "7").replace(" 2 ", " 11 ") + " " + noise(9)),
        (12, BENCH[0][1].replace("sells 3", "sells 4").replace("then John", "then Paul")),  # slots don't map
        (13, BENCH[1][1].upper().replace(" ", "\n")),
        (14, noise(200)),
        (15, None),
        (16, ""),
        (17, "the quick brown fox jumps over"),
        (None, BENCH[1][1]),
        (13, BENCH[1][1]),
    ]
    got = found(spark, docs)
    assert got[10, 1] == 0 and got[11, 1] == 3 and got[13, 2] == 0
    assert set(got) == {(10, 1), (11, 1), (13, 2)}


def test_short_items_and_empty_tables(spark):
    assert set(found(spark, [(1, "so four little words here"), (2, "four little words")], [(5, "four little words here"), (6, "little words")])) == {(1, 5)}
    assert found(spark, [(1, "a")], [(5, None)]) == {}
    assert found(spark, [(1, None)]) == {}


def test_capitalised_items_inside_a_sentence(spark):
    bench = [(1, "What is the capital of France?"), (2, "Where does the longest river of Peru begin today?")]
    docs = [
        (1, "as he asked me What is the capital of France? and left"),
        (2, "A heading\nWhat is the capital of France?"),
        (3, "so then Where does the longest river of Peru begin today? he said"),
        (4, "What is the capital of France?"),
        (5, "we know that Paris is the capital of France, of course"),
        (6, "one asks What is the capital of Spain?"),
        (7, "Yes. Where does the longest river of Peru begin today?"),
    ]
    assert found(spark, docs, bench) == {(1, 1): 0, (2, 1): 0, (3, 2): 0, (4, 1): 0, (6, 1): 1, (7, 2): 0}


def test_no_filter_gives_the_same(spark, monkeypatch):
    docs = [(1, "so " + BENCH[1][1]), (2, "other words entirely, nothing of the kind, and then a little more of it")]
    with_filter = found(spark, docs)
    monkeypatch.setattr(D, "FILTER_BYTES", 0)
    assert found(spark, docs) == with_filter == {(1, 2): 0}


def test_reader_forgets_between_texts():
    r = D.TemplateReader(limit=4)
    for text in ("a b c d e", "f g", "a b c"):
        h, _, at = r.read(text)
        assert r.values(at) == text.split() and len(h) == len(at)


@pytest.mark.parametrize(("token", "kind"), [("3", 1), ("1,000.5", 1), ("$5", 1), ("km", 3), ("Mary", 2), ("MARY", 0), ("word", 0), ("a1", 0), ("...", 0)])
def test_types(token, kind):
    assert D._read(token)[3] == kind


def test_changes_of_all_parts_count(spark):
    a, b = "the baker sold 12 loaves on the first day of the fair in May", "and then 30 rolls to the mayor who paid 9 coins for all of them"
    changed = b.replace("30", "31").replace("9", "8")
    rest = "so it went on and on for quite some time that year"
    got = found(spark, [(1, f"{a} {rest} {changed}"), (2, f"{a} {b}"), (3, f"{a} {b} {rest} {a} {changed}")], [(1, f"{a} {b}")])
    assert got == {(1, 1): 2, (2, 1): 0, (3, 1): 0}


def test_number_tables_go_by_values(spark):
    table = "11 12 13 14 15 16 17 18 19 20 21 22"
    docs = [(1, " ".join(str(k) for k in range(3000, 5000))), (2, f"see {table} there"), (3, "1 2 3 4 5 6 7 8 9 10")]
    assert set(found(spark, docs, [(1, table)])) == {(2, 1)}


def test_one_slip_in_a_long_item(spark):
    parts = [f"clerk number {k} filed {k * 7} forms in room {k + 400} that day" for k in range(12)]
    item = " and ".join(parts) + " while clerk number 3 slept"
    assert (1, 1) in found(spark, [(1, item.replace("clerk number 3 slept", "clerk number 8 slept"))], [(1, item)])


def brute(docs, bench):
    """Items whose tokens, but for case, all stand in a row in a text: what any method must find."""
    norm = lambda t: [D._read(w)[2].lower() for w in (t or "").split()]
    out = set()
    for i, t in docs:
        words = norm(t)
        for k, b in bench:
            item = norm(b)
            if len(item) >= D.LEAST_TOKENS and any(words[j : j + len(item)] == item for j in range(len(words) - len(item) + 1)):
                out.add((i, k))
    return out


def test_all_verbatim_copies_and_no_others(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))), str(rng.randrange(1000)), "Zed", "km"])
    noise = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, noise(rng.randint(4, 40))) for k in range(25)]
    docs = [(k, noise(rng.randint(0, 60)) + " " + rng.choice(bench)[1] + " " + noise(rng.randint(0, 60)) if k % 2 else noise(rng.randint(0, 160))) for k in range(120)]
    want = brute(docs, bench)
    assert len(want) >= 60 and set(found(spark, docs, bench)) == want


def test_names_and_numbers_of_several_words(spark):
    bench = [(1, "On her way home Maria met John at the old bridge and gave him three of the 60 shells that she had found")]
    new = bench[0][1].replace("Maria", "Anna Lopez Diaz").replace("John", "Peter van Smith".replace(" van", "")).replace("three", "twenty five").replace("60", "80")
    docs = [(1, f"so {new} and more"), (2, new.replace("Peter Smith", "Anna Lopez Diaz"))]
    assert found(spark, docs, bench)[1, 1] == 4
    assert found(spark, [(3, "we drove 80 km in three hours on the road to the sea and back")], [(1, "we drove 60 miles in two hours on the road to the sea and back")]) == {(3, 1): 3}


def test_scripts_without_spaces(spark):
    item = "小明有3个苹果，又买了5个苹果，请问他一共有多少个苹果？"
    docs = [(1, "这是一个很长的前言。" + item + "后面还有别的话。"), (2, item.replace("3", "17").replace("5", "29")), (3, "小明去学校上课，老师问了他很多问题，他都答对了。"), (4, item.replace(" ", ""))]
    assert found(spark, docs, [(1, item)]) == {(1, 1): 0, (2, 1): 2, (4, 1): 0}


def test_short_items_are_whole_lines(spark):
    bench = [(1, "What is 2+2?"), (2, "Define entropy."), (3, "???")]
    docs = [(1, "Quiz\n  what is 2+2 \nDefine it"), (2, "Do you know What is 2+2? Yes"), (3, "DEFINE ENTROPY"), (4, "???"), (5, None)]
    assert found(spark, docs, bench) == {(1, 1): 0, (3, 2): 0}


def test_reparameterised_copies_against_all_alignments(spark):
    """Items with other names and numbers are found where the new values map one to one, and only there."""
    rng = random.Random(17)
    names, plain = ["Ann", "Ben", "Carl", "Dora", "Ed"], "the a red box sold went near many of it was when left over under field stone".split()

    def made():
        return [rng.choice(plain) if rng.random() < 0.7 else rng.choice(names) if rng.random() < 0.5 else str(rng.randrange(10, 99)) for _ in range(24)]

    bench, docs, want = [], [], set()
    for k in range(30):
        item = ["so", *made(), "end"]
        used = sorted({w for w in item if w in names or w.isdigit()})
        new_names, new_numbers = iter(rng.sample(["Pia", "Quin", "Rob", "Sue", "Tom"], 5)), iter(rng.sample(range(100, 999), 30))
        swap = {w: next(new_names) if w in names else str(next(new_numbers)) for w in used}
        copy = [swap.get(w, w) for w in item]
        bench.append((k, " ".join(item)))
        docs.append((2 * k, "it is told " + " ".join(copy) + " and on"))
        want.add((2 * k, k))
        slots = [i for i, w in enumerate(copy) if w in swap.values()]
        for i in slots[:: max(1, len(slots) // 4)]:  # values that map to several
            copy[i] = "Zoe" if copy[i].isalpha() else "7777"
        docs.append((2 * k + 1, " ".join(made())))
    got = found(spark, docs, bench)
    runs = lambda ws: [w for w, v in zip(ws, [None, *ws]) if not (w in names and v in names)]
    assert want <= set(got) and {d for d, _ in got} <= {2 * k for k in range(30)}
    assert all(got[2 * k, k] >= len({w for w in runs(bench[k][1].split()) if w.isdigit()}) for k in range(30))
