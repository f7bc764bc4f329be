"""Benchmark decontamination by template windows.

Tokens become a template: numbers, names and units turn into typed placeholders. Windows of template
tokens are hash-joined between benchmark items and documents, so that a question with other numbers
or names still meets its source. Names and number words of several tokens are one placeholder; scripts without
spaces have a token a character. A slot is a placeholder's value; along one alignment each benchmark
value must map to one document value of its type and back, but for one slip in ten, else the match is
chance. A window of placeholders alone has no template to go by and is joined by its values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import Memo, cut, fresh, give_back, windows64

WINDOW, COVERAGE = 8, 0.6
#: Tokens of an item at least; a shorter one recurs by chance and matches whole lines only.
LEAST_TOKENS = 4
#: Bytes of benchmark window hashes that every task gets at a time as a filter ahead of the join.
FILTER_BYTES = 32 << 20
#: Conflicting slots of an alignment for each so many slots.
SLIPS = 10
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|e[+-]?\d+)?")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "k c f v w kw kwh j hz khz mhz ghz b kb mb gb tb mph kmh km/h m/s usd eur gbp dollar dollars euro euros cent cents percent % $ € £ °c °f meter meters metre metres kilometer kilometers".split()
)
#: Number words of the language of the units.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
#: Characters of scripts without spaces: kana, Han, Thai, Lao, Khmer.
_SOLID = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1780-\u17ff\U00020000-\U0002ffff"
SOLID, SOLID_PARTS = re.compile(f"[{_SOLID}]"), re.compile(f"[{_SOLID}]|[^{_SOLID}]+")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%") + "“”‘’«»¿¡…–—。！？，、；："
_END = tuple(".!?:;。！？：；")


def _read(token: str) -> tuple[int, int, str, int, bool]:
    """A token's template hash, type at the start of a sentence, value, type elsewhere, and whether it ends one.

    Types: 0 plain, 1 number, 2 name, 3 unit. A name is a capitalised word that doesn't open a sentence.
    """
    bare = token.strip(_EDGE) or token
    ends = token.rstrip("\"')]}”’»").endswith(_END)
    low = bare.lower()
    if low in NUMBER_WORDS:
        return xxhash.xxh3_64_intdigest("\0number"), 1, low, 1, ends
    if NUMBER.fullmatch(bare.strip("$%")):
        return xxhash.xxh3_64_intdigest("\0number"), 1, bare, 1, ends
    if low in UNITS and len(low) > 1 or bare in "%$€£":
        return xxhash.xxh3_64_intdigest("\0unit"), 3, low, 3, ends
    name = bare[:1].isupper() and bare[1:].islower()
    return xxhash.xxh3_64_intdigest(low), 0, low, 2 if name else 0, ends


class TemplateReader:
    """Token tables of a worker: equal tokens are read once. Emptied between texts at ``limit`` tokens."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.name_hash = np.uint64(xxhash.xxh3_64_intdigest("\0name"))
        self._empty()

    def _empty(self) -> None:
        self.index = Memo(self._add, 1 << 62)
        self.texts: list[str] = []
        self.hash, self.exact = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.kinds, self.ends, self.glued = np.zeros((1024, 2), np.int8), np.zeros(1024, bool), np.zeros(1024, np.int8)

    def _add(self, token: str) -> int:
        i = len(self.texts)
        if i == len(self.hash):
            self.hash, self.exact, self.kinds, self.ends, self.glued = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.exact, self.kinds, self.ends, self.glued))
        if token.startswith("\0"):  # of several
            first = later = 0
            value = token[1:]
        else:
            self.hash[i], first, value, later, self.ends[i] = _read(token)
            # which kind of run it may be part of: 1 number words, 2 names; and 4 if the next token may go on
            self.glued[i] = (2 * (later == 2) or value.lower() in NUMBER_WORDS) | 4 * (token[-1:].isalnum())
        self.exact[i] = xxhash.xxh3_64_intdigest(value)
        self.kinds[i] = first, later
        self.texts.append(value)
        return i

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes, slot types and table places of a text's tokens; the places hold until the next read."""
        tokens = (text or "").split()
        if text and SOLID.search(text):
            tokens = [p for t in tokens for p in (SOLID_PARTS.findall(t) if SOLID.search(t) else (t,))]
        if len(self.texts) + 2 * len(tokens) > self.limit:
            self._empty()
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        later = np.zeros(len(at), np.int64)
        later[1:] = ~self.ends[at[:-1]]
        kind, h = self.kinds[at, later], self.hash[at]
        h[kind == 2] = self.name_hash
        run = np.where(kind == 2, 2, np.where(kind == 1, self.glued[at] & 1, 0))
        joined = (run[1:] > 0) & (run[1:] == run[:-1]) & (self.glued[at[:-1]] & 4 > 0) & (at[1:] != at[:-1])
        if joined.any():
            starts = np.flatnonzero(np.concatenate([[True], ~joined]))
            sizes = np.diff(np.append(starts, len(at)))
            # a name goes by its last word: the first may be a word that only opens a sentence
            h, kind, merged = h[starts], kind[starts], at[starts + sizes - 1]
            for k in np.flatnonzero((sizes > 1) & (kind == 1)):
                merged[k] = self.index["\0" + " ".join(self.values(at[starts[k] : starts[k] + sizes[k]]))]
            at = merged
        return h, kind, at

    def values(self, at: np.ndarray) -> list[str]:
        return [self.texts[i] for i in at]


_READERS: list[TemplateReader] = []


def _reader() -> TemplateReader:
    if not _READERS:
        _READERS.append(TemplateReader())
    return _READERS[0]


def _hashes(h: np.ndarray, kind: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n tokens: of their templates, or of the values where no token is plain."""
    out = windows64(h, n)
    plain = np.concatenate([[0], np.cumsum(kind == 0)])
    bare = plain[n:] == plain[:-n]
    if bare.any():
        out[bare] = windows64(~_reader().exact[at], n)[bare]
    return out


def _slots(kind: np.ndarray, at: np.ndarray, lo: int, n: int) -> str | None:
    here = np.flatnonzero(kind[lo : lo + n]) + lo
    if not len(here):
        return None
    return "\x1f".join(f"{i - lo}={kind[i]}={v}" for i, v in zip(here, _reader().values(at[here]), strict=True))


def _inside(text: str | None, n: int) -> tuple[int, int, str] | None:
    """Length, hash and slots of a text's first window of n tokens at most as it reads inside a sentence, where its first word is a name; None if it isn't."""
    was = _reader().read(text)[1]
    h, kind, at = (x[1:] for x in _reader().read(f"x {text or ''}"))
    if not len(kind) or kind[0] != 2 or was[0] == 2:
        return None
    n = min(n, len(h))
    return n, int(_hashes(h[:n], kind[:n], at[:n], n).view(np.int64)[0]), _slots(kind, at, 0, n)


_SCHEMA = "row string, pos int, n int, h long, slots string, total int, inside boolean"


def template_windows(rows: DataFrame, window: int, lengths: list[int] | None = None, among: np.ndarray | None = None, inside: bool = False) -> DataFrame:
    """``rows(row, text)`` -> their template windows, only those whose hash is in ``among`` if that is given.

    Without ``lengths`` each text has windows of ``window`` tokens, or one of its own length if it is shorter.
    With ``inside`` the first window comes also as it reads inside a sentence, if that differs.
    """
    sent = rows.sparkSession.sparkContext.broadcast(among) if among is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent is not None:
            wanted = sent.value
            seen = np.zeros(1 << 20, bool)
            seen[(wanted & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for b in batches:
            out: list[tuple] = []
            for row, t in zip(b["row"].to_pylist(), b["text"], strict=True):
                text = t.as_py()
                tokens, kind, at = _reader().read(text)
                for n in lengths or [max(1, min(window, len(tokens)))]:
                    if len(tokens) < n:
                        continue
                    h = _hashes(tokens, kind, at, n)
                    keep = np.arange(len(h))
                    if sent is not None and len(wanted):
                        keep = np.flatnonzero(seen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                        near = np.minimum(np.searchsorted(wanted, h[keep]), len(wanted) - 1)
                        keep = keep[wanted[near] == h[keep]]
                    elif sent is not None:
                        keep = keep[:0]
                    out += [(row, int(i), n, int(h[i : i + 1].view(np.int64)[0]), _slots(kind, at, i, n), len(h), False) for i in keep]
                    other = _inside(text, n) if inside else None
                    if other:
                        out.append((row, 0, other[0], other[1], other[2], len(h), True))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row", "pos", "n", "h", "slots", "total", "inside"])
        give_back()

    return rows.select(F.col("row").cast("string").alias("row"), F.col("text").alias("text")).mapInArrow(run, _SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_matched, n_windows, coverage, n_changed)``: documents that hold an item, or a re-parameterised copy.

    A pair is returned if, over alignments whose slots are consistent, the share of the item's
    distinct windows found reaches ``coverage``. n_changed counts the slot values that differ, each window
    taken where it differs least: 0 for a plain copy. Null and empty texts and items match nothing; items of fewer than
    LEAST_TOKENS tokens match lines that hold nothing else, case and outer punctuation aside. Repeated rows of an id count once;
    rows with a null id are left out. Other columns play no part.
    """
    items = template_windows(benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("row"), F.col(item_text).alias("text")), window, inside=True)
    items = cut(items.distinct())
    short = items.where((F.col("total") == 1) & (F.col("n") < LEAST_TOKENS)).select("row").distinct()
    items = items.where(F.col("n") >= LEAST_TOKENS)
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most `window` of them
    found = _held_windows(items, docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("row"), F.col(text).alias("text")), window, lengths or [window])
    i = items.select(F.col("row").alias("item"), F.col("pos").alias("item_pos"), "n", "h", F.col("slots").alias("item_slots"), "total", "inside")
    d = found.select("row", "pos", "n", "h", "slots")
    pairs = i.join(d, ["h", "n"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    slot = lambda a: F.split(F.coalesce(F.col(a), F.lit("")), "\x1f")
    of = F.zip_with(slot("item_slots"), slot("slots"), lambda x, y: F.struct(F.regexp_replace(x, "^[0-9]+=", "").alias("a"), F.regexp_replace(y, "^[0-9]+=", "").alias("b")))
    # a first word that only its place made a name must be the same word
    pairs = pairs.where(~F.col("inside") | (slot("item_slots")[0] == slot("slots")[0]))
    pairs = pairs.withColumn("maps", F.filter(of, lambda m: m["a"] != ""))
    aligned = pairs.groupBy("row", "item", "shift").agg(F.sort_array(F.collect_set("item_pos")).alias("at"), F.max("total").alias("total"), F.array_distinct(F.flatten(F.collect_set("maps"))).alias("maps"))
    one = lambda side: F.size(F.array_distinct(F.transform("maps", lambda m: m[side])))
    aligned = aligned.where((F.size("maps") - F.least(one("a"), one("b"))) * SLIPS <= F.size("maps"))
    changed = F.sort_array(F.filter("maps", lambda m: m["a"] != m["b"]))
    # alignments that say the same, as in a text that repeats itself, are one
    aligned = aligned.groupBy("row", "item", "at", changed.alias("changed")).agg(F.max("total").alias("total"))
    each = F.sort_array(F.collect_list(F.struct(F.size("changed").alias("n"), "at", "changed")))
    whole = aligned.groupBy("row", "item").agg(each.alias("each"), F.max("total").cast("long").alias("n_windows"))
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("at"), F.expr("cast(array() as array<struct<a:string,b:string>>)").alias("changed"))
    # each window is read where least differs
    take = lambda acc, x: F.when(F.size(F.array_except(x["at"], acc["at"])) == 0, acc).otherwise(F.struct(F.array_union(acc["at"], x["at"]).alias("at"), F.array_union(acc["changed"], x["changed"]).alias("changed")))
    whole = whole.withColumn("whole", F.aggregate("each", zero, take))
    whole = whole.select("row", "item", F.size("whole.at").cast("long").alias("n_matched"), "n_windows", F.size("whole.changed").cast("long").alias("n_changed"))
    whole = whole.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    lines = _short_items(short, docs, benchmark, doc_id, text, item_id, item_text)
    return _own_ids(whole.unionByName(lines) if lines is not None else whole, docs, doc_id, benchmark, item_id)


def _short_items(short: DataFrame, docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame | None:
    """Documents with a line that is one of the items ``short(row)`` and nothing else; None where there are no such items."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"^[\p{P}\s&&[^-+]]+|[\p{P}\s]+$", ""))
    mine = benchmark.join(short, F.col(item_id).cast("string") == F.col("row"), "left_semi").select(F.col(item_id).cast("string").alias("item"), bare(F.col(item_text)).alias("said")).where("said <> ''")
    longest = mine.agg(F.max(F.length("said"))).first()[0]
    if longest is None:
        return None
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("string").alias("row"), F.explode(F.split(F.col(text), r"[\r\n]+")).alias("line"))
    lines = lines.where(F.length(F.trim("line")) <= 3 * longest + 20).select("row", bare(F.col("line")).alias("line"))
    hit = lines.join(mine, F.col("line") == F.col("said")).select("row", "item").distinct()
    one = F.lit(1).cast("long")
    return hit.select("row", "item", one.alias("n_matched"), one.alias("n_windows"), F.lit(0).cast("long").alias("n_changed"), F.lit(1.0).alias("coverage"))


def _held_windows(items: DataFrame, docs: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """The documents' windows whose hash some item has.

    The items' hashes go to every task as a filter; where they are too many for that, in turns, each of which
    reads the documents and writes what it finds.
    """
    hashes = cut(items.select("h").distinct())
    turns, out = max(1, -(-hashes.count() // max(1, FILTER_BYTES // 8))), None
    for k in range(turns):
        held = hashes.where(F.pmod("h", F.lit(turns)) == k).toPandas()["h"].to_numpy(np.int64)
        part = template_windows(docs, window, lengths, np.sort(held.view(np.uint64)))
        part = cut(part) if turns > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _own_ids(found: DataFrame, docs: DataFrame, doc_id: str, benchmark: DataFrame, item_id: str) -> DataFrame:
    """Ids back in their own types."""
    back = lambda name, df, col, out: F.col(name).cast(df.schema[col].dataType).alias(out)
    return found.select(back("row", docs, doc_id, "doc_id"), back("item", benchmark, item_id, "item_id"), "n_matched", "n_windows", "coverage", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null id stay, and columns whatever their names.

    Of an id with several texts all rows go if one of them holds an item.
    """
    (bad,) = fresh(docs, "_bad")
    found = contamination(docs, benchmark, doc_id=doc_id, **how).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col(doc_id) == F.col(bad), "left_anti")
