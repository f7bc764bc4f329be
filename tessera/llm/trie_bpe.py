"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch are sorted, which lays their trie out in depth-first order: a word shares
with the one before it the path of their common prefix. The walk carries one state for each prefix of the
path, the last token of that prefix's encoding with the encoding so far, and a word begins with the states
its predecessor left on the shared path. The encoding of a prefix is the encoding of a shorter prefix plus
its last token, and a token may follow another if no merge ever crosses the border between the two; exactly
one suffix of each prefix meets this. So the prefixes that words share are encoded once.

Vocabularies are JSON files of the kind whose words end in a marker and are lower-cased, with NFC and
white space runs made one space.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.base import give_back

#: The vocabulary's own split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII texts.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
_BLANKS = regex.compile(r"\s+")
#: Every code point up to here is assigned, so that all Unicode versions agree on it.
_OLD = re.compile("[^\x00-ͷ]")
#: White space to Python's split() but not to the split pattern.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks a worker keeps encoded, and borders between tokens that it keeps judged.
KEPT_WORDS, KEPT_BORDERS = 250_000, 100_000
#: Bytes of text encoded at a time, or one text, if longer.
PART_BYTES = 2_000_000
#: Symbols of a word up to which it goes into the trie; a longer one shares nothing and is walked alone.
LONG_WORD = 100


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes with one vocabulary; ``words`` and ``ids`` keep the ids of words and chunks met, as text."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        model = read["model"]
        vocab: dict[str, int] = model["vocab"]
        self.spec, self.end = spec, model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.text: list[str] = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        self.number = [str(i) for i in range(self.size)]
        self.token_of = dict(zip(self.number, self.text))
        #: rank of the merge of two tokens, by first * size + second; and of the merge that makes a token, with its parts.
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        #: tokens that merges do reach, without and with the end marker, by their symbols.
        self.plain: dict[str, int] = {}
        self.ended: dict[str, int] = {}
        for t, i in vocab.items():
            if len(t) == 1:
                self.plain[t] = i
            elif len(t) == 1 + len(self.end) and t.endswith(self.end):
                self.ended[t[:1]] = i
        self._read_merges(vocab, [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]])
        #: length of the longest token that ends in given three symbols; tokens of two symbols may end in any.
        self.reach, self.reach_end = ({}, {})
        for tokens, reach in ((self.plain, self.reach), (self.ended, self.reach_end)):
            for t in tokens:
                if len(t) > reach.get(t[-3:], 2):
                    reach[t[-3:]] = len(t)
        self.borders: dict[int, bool] = {}
        self.byte = byte_symbols()
        self.table = {b: ord(c) for b, c in self.byte.items()}
        self.words: dict[str, str] = {}
        self.ids: dict[str, str] = {}
        self.again: set[str] = set()

    def _read_merges(self, vocab: dict[str, int], merges: list) -> None:
        """Ranks of all merges, then how each token that merges reach is made: by the one merge that its own symbols lead to."""
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        for r, (a, b, _) in enumerate(pairs):
            self.rank.setdefault(a * self.size + b, r)
        known = {*self.plain.values(), *self.ended.values()}
        for r, (a, b, c) in enumerate(pairs):
            if c not in known and a in known and b in known and self.follows(a, b, r):
                self.made[c], self.left[c], self.right[c] = r, a, b
                known.add(c)
                t = self.text[c]
                if t.endswith(self.end):
                    self.ended[t[: -len(self.end)]] = c
                else:
                    self.plain[t] = c

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.spec)

    def follows(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether token b may stand after token a: no merge ranked under ``limit`` crosses their border at any time.

        The merges that made the two are undone, the later one first; what then stands at the border must not
        have been merged before. Of equal merges the one further left comes first.
        """
        rank, made, size = self.rank, self.made, self.size
        while True:
            r = rank.get(a * size + b)
            if r is not None and r < limit:
                return False
            ra, rb = made[a], made[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def _may_follow(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) >= KEPT_BORDERS:
                self.borders.clear()
            known = self.borders[key] = self.follows(a, b)
        return known

    def encode_words(self, words: list[str]) -> None:
        """Walk the trie of the words depth first and store each word's ids."""
        table, out = self.table, self.words
        #: the last token of each prefix of the path, -1 until a word asks for it, and the prefix's ids
        last, ids = [-1], [""]
        before = ""
        paths = [(w.encode("utf-8").decode("latin-1").translate(table), w) for w in words]
        for path, word in sorted(p for p in paths if len(p[0]) <= LONG_WORD):
            shared, n = 0, len(path)
            for x, y in zip(before, path):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], ids[shared + 1 :]
            more = n - shared
            last += [-1] * more
            ids += [""] * more
            out[word] = self._find(path, n, self.ended, self.reach_end, last, ids)[1]
            before = path
        for path, word in paths:
            if len(path) > LONG_WORD:
                out[word] = self._alone(path)

    def _alone(self, path: str) -> str:
        """Ids of a long word, all its states found in order, without the ids so far, and read off backwards."""
        n, last = len(path), [-1]
        none = [""] * (n + 1)
        for k in range(1, n):
            last.append(self._find(path, k, self.plain, self.reach, last, none)[0])
        found = [self._find(path, n, self.ended, self.reach_end, last, none)[0]]
        at = n - len(self.text[found[0]]) + len(self.end)
        while at:
            found.append(last[at])
            at -= len(self.text[last[at]])
        return " ".join([self.number[t] for t in reversed(found)])

    def _state(self, path: str, n: int, last: list[int], ids: list[str]) -> int:
        """The last token of path[:n]'s encoding, found once and kept for all words below."""
        last[n], ids[n] = self._find(path, n, self.plain, self.reach, last, ids)
        return last[n]

    def _find(self, path: str, n: int, tokens: dict[str, int], reach: dict[str, int], last: list[int], ids: list[str]) -> tuple[int, str]:
        """The last token of path[:n], one of ``tokens``, and the ids of path[:n].

        The longest token that may follow what stands before it wins. States of shorter prefixes that are asked
        for and not known yet are found first.
        """
        for i in range(max(0, n - reach.get(path[max(0, n - 3) : n], 2)), n):
            token = tokens.get(path[i:n])
            if token is not None:
                if not i:
                    return token, self.number[token]
                before = last[i]
                if before < 0:
                    before = self._state(path, i, last, ids)
                if self._may_follow(before, token):
                    return token, f"{ids[i]} {self.number[token]}"
        raise ValueError(f"no token ends {path[:n]!r}")

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens: NFC, one space for white space, lower case, split pattern.

        Characters younger than this Python's Unicode tables are left to the vocabulary's own library.
        """
        if not text.isascii():
            if _OLD.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
                seen = self.library.normalizer.normalize_str(text)
                return [seen[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(seen)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return PIECES.findall(_BLANKS.sub(" ", text).lower())

    def chunks(self, text: str) -> list[str]:
        """A text cut at white space and around special tokens; no word of ``pieces`` crosses such a cut."""
        if self.split_special and any(t in text for t in self.special):
            return [c for p in self.split_special.split(text) for c in ([p] if p in self.special else self.chunks(p))]
        return [c for c in _BLANKS.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks not met before, all their new words in common tries, and keep the results."""
        plain = {c: (([c.lower()] if c.isalpha() else _ASCII.findall(c.lower())) if c.isascii() else self.pieces(c)) for c in chunks if c not in self.special}
        known = self.words
        self.encode_words([*{w for words in plain.values() for w in words if w not in known}])
        for c in chunks:
            if c in self.special:
                self.ids[c] = str(self.special[c])
            else:
                self.ids[c] = known[plain[c][0]] if len(plain[c]) == 1 else " ".join([known[w] for w in plain[c]])

    def forget(self) -> None:
        """Keep only what was met in two batches or more, if that is well under the limit, else nothing."""
        keep = self.again if len(self.again) < KEPT_WORDS // 2 else set()
        self.words, self.ids = ({c: v for c, v in x.items() if c in keep} for x in (self.words, self.ids))
        self.again = set()

    def encode(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """(ids, number of ids, tokens) of each text; ids and tokens joined by one space."""
        cut = [self.chunks(t or "") for t in texts]
        now = set().union(*cut)
        if len(self.ids) > KEPT_WORDS:
            self.forget()
        new = [c for c in now if c not in self.ids]
        self.again |= now.difference(new)
        self.learn(new)
        out = []
        for c in cut:
            ids = " ".join(map(self.ids.__getitem__, c))
            each = ids.split(" ") if ids else []
            out.append((ids, len(each), " ".join(map(self.token_of.__getitem__, each))))
        return out


@cache
def encoder(spec: str) -> TrieEncoder:
    """One encoder a worker and vocabulary, so that tasks of one worker share the words met so far."""
    return TrieEncoder(spec)


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PART_BYTES of text, one row at least."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch[text]), 0).to_pylist()):
        if size and size + n > PART_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    yield batch.slice(at)


def encode_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row.

    ``vocabulary`` is the content of a vocabulary file, read by the driver. Special tokens in a text
    count as such. Null text counts as empty: 0 tokens, digests of the empty string. Decoding joins
    the tokens' strings by one space, as the library does without a decoder. With ``keep_text`` the
    columns ids (text) and decoded come too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    more = ", ids string, decoded string" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            for part in parts(b, "_text"):
                got = enc.encode(part["_text"].to_pylist())
                sha = [[hashlib.sha256(g[k].encode("utf-8")).hexdigest() for g in got] for k in (0, 2)]
                cols = [part["_id"], pa.array([g[1] for g in got], pa.int64()), pa.array(sha[0], pa.string()), pa.array(sha[1], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_text:
                    cols, names = [*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return base.mapInArrow(run, f"doc_id {base.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
