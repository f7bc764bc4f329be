import hashlib
import random

import pytest

from tessera.llm.queries import vocabulary
from tessera.llm.trie_bpe import TrieEncoder, encode_decode

tokenizers = pytest.importorskip("tokenizers")
ODD = [None, "", " ", "<|endoftext|>a<|startoftext|>", "İΣΑΣ ΣΣ", "a\x1cb\x85c d", "Ᲊa࢏ x", "é Å", "日本語 テスト", "🎉🎉 ok 's 'S don't 'LL", "a" * 3000, "_" * 500, "<|endoftext|", "1234 5.6", "\x00"]


@pytest.fixture(scope="module")
def both():
    return TrieEncoder(vocabulary()), tokenizers.Tokenizer.from_str(vocabulary())


def expect(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False)


def test_against_library(both):
    ours, library = both
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), rng.randrange(0x21, 0x500), rng.randrange(0x2000, 0x3100), rng.randrange(0xE000, 0x110000), rng.randrange(0xD800)]))
    texts = ODD + ["".join(pick() for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    assert ours.encode(texts) == [expect(library, t) for t in texts]


def test_full_memory_is_emptied(both, monkeypatch):
    ours, library = TrieEncoder(vocabulary()), both[1]
    monkeypatch.setattr("tessera.llm.trie_bpe.KEPT_WORDS", 5)
    for k in range(4):
        texts = [f"word{k} alpha{k} beta gamma delta epsilon zeta eta", "theta iota"]
        assert ours.encode(texts) == [expect(library, t) for t in texts]


def test_rows(spark, both):
    rows = [(i, t, "x") for i, t in enumerate(ODD[:-1])] + [(None, "a b", "y"), (0, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in encode_decode(df, vocabulary()).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, (e := expect(both[1], t))[1], sha(e[0]), sha(e[2])) for i, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert encode_decode(df.limit(0), vocabulary()).count() == 0


def plain_bpe(enc, symbols):
    """Merges in order of rank, the one further left first."""
    while True:
        ranked = [(enc.rank[p[0] * enc.size + p[1]], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p[0] * enc.size + p[1] in enc.rank]
        if not ranked:
            return symbols
        k = min(ranked)[1]
        joined = enc.text[symbols[k]] + enc.text[symbols[k + 1]]
        symbols = [*symbols[:k], enc.text.index(joined), *symbols[k + 2 :]]


def test_border_test_is_plain_bpe(both):
    enc = both[0]
    number = {t: i for i, t in enumerate(enc.text)}
    cut = lambda t: [*t[: -len(enc.end) - 1], t[-len(enc.end) - 1] + enc.end] if t.endswith(enc.end) and t != enc.end else list(t)
    rng = random.Random(9)
    plain, every = [*enc.plain.values()], [*enc.plain.values(), *enc.ended.values()]
    seen = set()
    for _ in range(400):
        a, b = rng.choice(plain), rng.choice(every)
        if rng.random() < 0.5:  # halves of a token meet at a border that some merge crosses
            t = rng.choice([*enc.plain])
            k = rng.randrange(1, len(t)) if len(t) > 1 else 0
            if k and t[:k] in enc.plain and t[k:] in enc.plain:
                a, b = enc.plain[t[:k]], enc.plain[t[k:]]
        want = plain_bpe(enc, [number[s] for t in (a, b) for s in cut(enc.text[t])]) == [a, b]
        assert enc.follows(a, b) == want
        seen.add(want)
    assert seen == {True, False}


def test_long_words_share_no_state(both):
    ours, library = both
    rng = random.Random(11)
    texts = ["ab" * 5000 + " abab", "x" * 101 + " " + "x" * 100 + " " + "x" * 99, "".join(rng.choice("etaoinshrdlu") for _ in range(200_000)), "é" * 3000, " ".join("q" * k for k in range(1, 140))]
    assert ours.encode(texts) == [expect(library, t) for t in texts]
