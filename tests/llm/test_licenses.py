import random
import re

from tessera.llm import licenses as L


def scan(spark, docs):
    return {(r["doc_id"], r["license"]) for r in L.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")).collect()}


def test_notices_texts_and_clean(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    mit = L.TEMPLATES["mit"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i not in (20, 60))
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    docs = [
        (1, noise(30) + "\nReleased under the MIT License.\n" + noise(30)),
        (2, noise(70) + "\n" + wrapped + "\n" + noise(33)),
        (3, edited),
        (4, noise(400)),
        (5, None),
        (6, ""),
        (7, "this work is LICENSED under the GNU general public license, version 3"),
        (8, " ".join(mit[:30])),
        (None, "Released under the MIT License."),
        (1, "Released under the MIT License."),
        (9, "a" * 5000),
    ]
    got = scan(spark, docs)
    assert got == {(1, "notice-mit"), (2, "mit"), (3, "mit"), (7, "notice-gpl-3.0")}
    assert scan(spark, []) == set()


def test_each_template_finds_itself(spark):
    docs = list(enumerate(L.TEMPLATES.values()))
    got = scan(spark, docs)
    assert {(i, k) for i, k in enumerate(L.TEMPLATES)} <= got


def test_each_template_inside_a_long_paragraph(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = [(20 * i + k, noise(rng.randint(100, 180)) + " " + body + " " + noise(rng.randint(100, 180))) for i, body in enumerate(L.TEMPLATES.values()) for k in range(10)]
    docs += [(20 * i + 10, noise(12) + " " + body + " " + noise(12)) for i, body in enumerate(L.TEMPLATES.values())]
    got = scan(spark, docs)
    assert {(20 * i + k, name) for i, name in enumerate(L.TEMPLATES) for k in range(11)} <= got


def test_very_long_texts(spark):
    texts = ["1." * 500_000, "a-" * 500_000, "x" * 1_000_000, "word " * 100_000 + "Released under the MIT License." + " word" * 1000]
    assert scan(spark, list(enumerate(texts))) == {(3, "notice-mit")}


def brute(docs):
    """Containment of all templates in all documents, by their words."""
    words = lambda t: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    out = set()
    for i, t in docs:
        mine = grams(words(t))
        for name, body in L.TEMPLATES.items():
            need = grams(words(body))
            if len(mine & need) / len(need) >= (1.0 if len(need) < L.SHORT else L.CONTAINED):
                out.add((i, name))
    return out


def test_brute_force(spark):
    """Templates whole, wrapped, in running text, and with words changed, among texts that share parts of them."""
    rng = random.Random(15)
    noise = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = []
    for i, body in enumerate(list(L.TEMPLATES.values()) * 6):
        w = body.split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed"
        kind = i % 4
        if kind == 1:
            w = w[: len(w) * 2 // 3]
        if kind == 2:
            w = [x + ("\n" if k % 5 == 4 else "") for k, x in enumerate(w)]
        docs.append((i, noise(rng.randint(0, 90)) + rng.choice([" ", "\n"]) + " ".join(w) + rng.choice([" ", "\n"]) + noise(rng.randint(0, 90))))
    want = brute(docs)
    assert scan(spark, docs) == want and len(want) >= 40
