"""Secret scans: patterns, and sliding-window Shannon entropy per character class; DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs without a count would match the same spans or shorter ones that fail anyway.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Character classes by name: the runs that are candidates, their alphabet, and bits a character of a
#: window from which it is suspect. Alphabets are matched case-sensitively unless folded.
CLASSES = {
    "hex": (r"(?<![0-9A-Za-z+/_-])[0-9A-Fa-f]{20,}(?![0-9A-Za-z+/_-])", "0123456789abcdefABCDEF", 3.0),
    "base64": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
    "printable": (r"[!-~]{20,}", "".join(map(chr, range(33, 127))), 4.0),
}
#: What a stretch of a class must hold; a key with symbols has letters, digits and symbols.
HOLDS = {"printable": r"^(?=.*[A-Za-z])(?=.*[0-9])(?=.*[^A-Za-z0-9+/_.,:;-])"}
WINDOW = 20
#: Candidates and stretches that match one of these are let through: one letter case or a capitalised word, decimal
#: numbers, UUIDs, paths of words, addresses. Repeated groups are possessive, as others take a stack frame a turn.
ALLOWED = (
    r"[A-Z]?[a-z]+|[A-Z]+",
    r"[0-9]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"/?[A-Za-z]++(?:[/_-][A-Za-z]++)*+/?",
    r"[A-Za-z][A-Za-z0-9+.-]*+://.*|[^@]*+@[A-Za-z0-9.-]++",
)
#: Placeholders cut a candidate in two: no window over one is looked at.
PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx|0123456789|abcdefghij"


#: Matches whose places are found in one fold, and characters of a run whose windows are.
PART_MATCHES, PART_CHARS = 500, 256
_SPAN = "struct<start:int,end:int,m:string>"


def _scan(text: Column, pattern: str) -> Column:
    """Spans ``(start, end, m)`` of the leftmost non-overlapping matches, in code points.

    split gives what lies between the matches, so that lengths add up to places. A fold copies the array it
    adds to, so matches are dealt into parts: one fold over the parts' lengths, one inside each part.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def spans(part: Column, begin: Column) -> Column:
        def step(acc, x):
            end = acc["at"] + length(x)
            start = acc["at"] + F.length(x["gap"])
            span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
            return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], span)).alias("spans"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def all_parts(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(x), F.lit(PART_MATCHES)), lambda i: F.slice(x, i, PART_MATCHES))
        add = lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(p, F.lit(0), lambda n, y: n + length(y)))
        begins = lambda ps: F.aggregate(ps, F.array(F.lit(0)), add)
        return once(parts, lambda ps: once(begins(ps), lambda bs: F.flatten(F.transform(ps, lambda p, k: spans(p, F.element_at(bs, k + 1))))))

    return F.when(text.rlike(pattern), once(found, lambda x: F.when(F.size(x) <= PART_MATCHES, spans(x, F.lit(0))).otherwise(all_parts(x)))).otherwise(none)


def _part_windows(chars: Column, alphabet: str, least: float, n: int) -> Column:
    """Stretches ``(first, last)`` of the starts of windows of ``n`` characters with ``least`` bits a character that overlap or touch.

    Entropy is log2(n) - S / n with S the sum of c log2 c over the counts c. A character that comes in or
    goes out changes one count by one, and S by the difference of that term. Counts are five bits each of
    some numbers, so that a step changes one of those and copies few. ``chars`` are places in the alphabet.
    """
    each = 12  # counts of one number
    words = -(-len(alphabet) // each)
    term = F.lit(np.array([c * math.log2(c) if c else 0.0 for c in range(n + 2)]))
    unit = F.lit(np.array([1 << 5 * k for k in range(each)], np.int64))
    t = lambda c: F.element_at(term, c + 1)
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    count = lambda ws, at: F.call_function("shiftright", F.element_at(ws, F.floor(at / each).cast("int") + 1), (at % each * 5).cast("int")).bitwiseAND(31).cast("int")
    change = lambda ws, at, by: F.transform(ws, lambda w, k: F.when(k == F.floor(at / each).cast("int"), w + by * F.element_at(unit, (at % each + 1).cast("int"))).otherwise(w))
    keep = ("first", "last", "found")

    def move(acc, at, by):
        return once(count(acc["counts"], at), lambda c: F.struct(change(acc["counts"], at, by).alias("counts"), (acc["s"] - t(c) + t(c + by)).alias("s"), *[acc[k].alias(k) for k in keep]))

    def done(acc):  # the stretch that ends here, if there is one
        return F.when(acc["first"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    def step(acc, i):
        came = move(acc, F.element_at(chars, i), 1)
        went = lambda a: F.when(i > n, move(a, F.element_at(chars, F.greatest(i - n, F.lit(1))), -1)).otherwise(a)

        def mark(a):
            start = i - n
            hit = (i >= n) & (F.lit(math.log2(n)) - a["s"] / n >= least)
            new = hit & (a["first"].isNull() | (start > a["last"] + n))
            return F.struct(
                a["counts"].alias("counts"), a["s"].alias("s"), F.when(new, start).otherwise(a["first"]).alias("first"),
                F.when(hit, start).otherwise(a["last"]).alias("last"), F.when(new, done(a)).otherwise(a["found"]).alias("found"),
            )

        return once(once(came, went), mark)

    null = F.lit(None).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("s"), null.alias("first"), null.alias("last"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step, done)


def high_entropy(run: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """Stretches ``(first, last)`` of a run, start and end, of windows with ``least`` bits a character that overlap or touch.

    The run is cut into parts that share ``window - 1`` characters, so that every window lies in one and is
    looked at once; stretches that go on in the next part are joined.
    """
    code = F.lit(np.array([max(0, alphabet.find(chr(c))) for c in range(128)], np.int32))
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    pieces = F.regexp_extract_all(run, F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))
    places = lambda piece: F.transform(F.split(piece, ""), lambda ch: F.element_at(code, F.ascii(ch) + 1))

    def part(ps: Column, piece: Column, k: Column) -> Column:
        whole = F.concat(piece, F.left(F.coalesce(F.try_element_at(ps, k + 2), F.lit("")), F.lit(window - 1)))
        moved = lambda w: F.struct((w["first"] + k * PART_CHARS).alias("first"), (w["last"] + k * PART_CHARS).alias("last"))
        return once(places(whole), lambda chars: F.transform(_part_windows(chars, alphabet, least, window), moved))

    def joined(found: Column) -> Column:
        apart = lambda i: F.element_at(found, i + 1)["first"] > F.element_at(found, i)["last"] + window
        firsts = F.filter(F.transform(found, lambda w, i: F.when((i == 0) | apart(F.greatest(i, F.lit(1))), w["first"])), lambda x: x.isNotNull())
        lasts = F.filter(F.transform(found, lambda w, i: F.when((i == F.size(found) - 1) | apart(F.least(i + 1, F.size(found) - 1)), w["last"] + window)), lambda x: x.isNotNull())
        return F.when(F.size(found) < 2, F.transform(found, lambda w: F.struct(w["first"].alias("first"), (w["last"] + window).alias("last")))).otherwise(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))

    return once(pieces, lambda ps: once(F.flatten(F.transform(ps, lambda piece, k: part(ps, piece, k))), joined))


def _between_placeholders(runs: Column) -> Column:
    """Runs, those with placeholders as what stands before, between and after these."""

    def cut(s: Column) -> Column:
        held = _scan(s["m"], PLACEHOLDER)
        begins = F.concat(F.array(F.lit(0)), F.transform(held, lambda x: x["end"]))
        ends = F.concat(F.transform(held, lambda x: x["start"]), F.array(F.length(s["m"])))
        return F.zip_with(begins, ends, lambda a, b: F.struct((s["start"] + a).alias("start"), (s["start"] + b).alias("end"), F.substr(s["m"], a + 1, b - a).alias("m")))

    return F.filter(F.flatten(F.transform(runs, lambda s: F.when(s["m"].rlike(PLACEHOLDER), cut(s)).otherwise(F.array(s)))), lambda s: s["end"] - s["start"] >= WINDOW)


def _matching(runs: Column, pattern: str) -> Column:
    return F.filter(runs, lambda s: s["m"].rlike(pattern))


def _stretches(runs: Column, name: str, dull: str) -> Column:
    """Spans ``(start, end)`` of suspect stretches of runs that the allow-list doesn't hold."""
    _, alphabet, least = CLASSES[name]

    def of_run(s: Column) -> Column:
        text = lambda w: F.substr(s["m"], w["first"] + 1, w["last"] - w["first"])
        fine = lambda w: ~text(w).rlike(dull) & (text(w).rlike(HOLDS[name]) if name in HOLDS else F.lit(True))
        return F.transform(F.filter(high_entropy(s["m"], alphabet, least), fine), lambda w: F.struct((s["start"] + w["first"]).alias("start"), (s["start"] + w["last"]).alias("end")))

    return F.flatten(F.transform(runs, of_run))


def _spans(kind: str, found: Column) -> Column:
    """Spans as sortable structs: start, place of the kind in the list, end."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans)`` for each row of docs.

    Spans are ``kind:start:end`` in code points, by start, then kind, comma-joined. Null and empty
    texts have none. An entropy span is a stretch of a candidate's suspect windows that overlap or touch; it may repeat
    a pattern's span. The allow-list holds back entropy spans only: candidates and stretches that it matches as a
    whole, and windows over a placeholder.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
    values = F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(1))
    out = out.withColumns({"_assign": _scan(F.col("_text"), ASSIGN), "_access": _scan(F.col("_text"), ACCESS), "_hex": _scan(F.col("_text"), HEX)})
    out = out.withColumn("_assign", F.when(F.size("_assign") > 0, F.filter(F.zip_with("_assign", values, lambda s, v: F.when(F.length(v) >= LEAST_VALUE, s)), lambda s: s.isNotNull())).otherwise(F.col("_assign")))
    dull = "^(?:" + "|".join(f"(?:{p})" for p in allowed) + ")$"
    for name, (pattern, _, _) in CLASSES.items():
        runs = F.filter(_scan(F.col("_text"), pattern), lambda s: ~s["m"].rlike(dull))
        if name in HOLDS:
            runs = _matching(runs, HOLDS[name])
        out = out.withColumn(f"_class_{name}", _between_placeholders(runs))
        out = out.withColumn(f"_class_{name}", _stretches(F.col(f"_class_{name}"), name, dull))
    out = out.withColumn("_base", F.concat(*[_spans(k, F.col(f"_{k}")) for k in KINDS[:3]]))
    # spans as numbers, of which repeated ones are found by hash and not by comparing all
    packed = F.transform(F.concat(*[F.col(f"_class_{c}") for c in CLASSES]), lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"])
    unpacked = F.transform(F.array_distinct(packed), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND((1 << 32) - 1).cast("int").alias("end")))
    out = out.withColumn("_entropy", _spans("entropy", unpacked))
    count = lambda k: F.size(f"_{k}").cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), _written(F.col("_base")).alias("base_spans"), _written(F.concat("_base", "_entropy")).alias("spans"))
