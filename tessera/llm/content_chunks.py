"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes decides where chunks end: at the least hash of any ``SPAN`` bytes in a row, a hash being
of 16 bytes alone, so that an insertion moves the ends around it but none further on, and every ``SPAN`` bytes have one.
A chunk goes from an end to the first one ``LEAST_CHUNK`` bytes on, and one starts at every end, so that chunks overlap. Chunks
are deduplicated by the digest of their bytes; consecutive ones that other documents hold too are joined to repeated
passages, of which ``drop_repeats`` leaves one copy. Words play no part but at the borders of a passage, which are moved
inward to words where there are any, so that unspaced scripts and encoded data are searched like all else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.base import fresh, give_back, mix64

#: Bytes of a chunk on average and at most, as ``cut_points`` takes them.
MEAN_BYTES, MOST_BYTES = 32, 1024
#: Bytes in a row of which the least hash ends a chunk, of a chunk at least, and of a passage at least.
SPAN, LEAST_CHUNK, LEAST_PASSAGE = 64, 48, 64
#: Bytes up to which a border of a passage moves to a word.
MOVE = 63
#: Bytes digested together; a run is told by those that lie inside it.
GRAM = 8
#: Sign bit of a run that is not the first of its kind in its document.
AGAIN = np.int64(-(1 << 63))
LOW = (1 << 32) - 1
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gear_table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + table[byte], which forgets bytes 32 places back."""
    h = table[data]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        h[k:] += h[:-k].copy() << np.uint32(k)
    return h


def _sliding(pick: np.ufunc, h: np.ndarray, n: int) -> np.ndarray:
    """``pick`` (a minimum or maximum) over each window of n values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = pick(h[:-step], h[step:])
        size += step
    return h


def chunk_ends(data: np.ndarray, table: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Ends of the smallest pieces of one text: where the lower half of the gear hash, of the last 16 bytes, is the least of
    ``span`` bytes in a row, never inside a character; the text's end is one."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = table.astype(np.uint16)[data]
    for k in (1, 2, 4, 8):  # as in gear(): sums over 2, 4, 8 and 16 bytes, in 16 bits
        h[k:] += h[:-k].copy() << np.uint16(k)
    inside = np.concatenate([(data[1:] & 0xC0) == 0x80, [False]])
    h[inside] = 0xFFFF
    at_end = np.zeros(len(h), bool)
    if len(h) >= span:
        least = np.pad(_sliding(np.minimum, h, span), span - 1)
        at_end = (_sliding(np.maximum, least, span) == h) & ~inside
    return np.union1d(np.flatnonzero(at_end) + 1, [len(data)])


def chunks(data: np.ndarray, ends: np.ndarray, least: int = LEAST_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks of ``least`` bytes or more; what is left at a text's end is none."""
    starts = np.concatenate([[0], ends[:-1]])
    to = np.searchsorted(ends, starts + least)
    fine = to < len(ends)
    return starts[fine], ends[to[fine]]


def cut_points(data: np.ndarray, table: np.ndarray, mean: int = MEAN_BYTES, most: int = MOST_BYTES, span: int | None = None) -> np.ndarray:
    """Ends of the chunks of one text; no chunk is longer than ``most``.

    With ``span`` the least hash of each ``span`` bytes in a row is an end too.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = gear(data, table)
    at_end = h < np.uint32((1 << 32) // mean)
    if span and len(h) >= span:
        least = np.pad(_sliding(np.minimum, h, span), span - 1)  # no window is outside the text
        at_end |= _sliding(np.maximum, least, span) == h
    ends = np.union1d(np.flatnonzero(at_end) + 1, [len(data)])
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > most:
        extra = [np.arange(s + most, e, most) for s, e in zip(starts, ends, strict=True) if e - s > most]
        ends = np.union1d(ends, np.concatenate(extra))
    return ends


def byte_digests(data: np.ndarray) -> np.ndarray:
    """2 x 64-bit digests of the ``GRAM`` bytes from each byte on; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(GRAM - 1, np.uint8)])
    grams = np.ndarray(len(data), np.uint64, padded, strides=(1,)).copy()
    return np.stack([mix64(grams ^ np.uint64(p)) for p in _P], axis=1)


def run_digests(digests: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Digest of places lo[i] to hi[i] (exclusive) from the places' 2 x 64-bit digests, by prefix sums of powers."""
    out = np.empty((len(lo), 2), np.uint64)
    up, down = powers(max(len(digests) + 1, KEPT_POWERS))
    with np.errstate(over="ignore"):
        for lane in range(2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests[:, lane] * up[lane, : len(digests)], dtype=np.uint64)])
            out[:, lane] = (total[hi] - total[lo]) * down[lane, lo]
    return out


#: Powers that a worker keeps; longer texts have their own.
KEPT_POWERS = 1 << 17


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.ones((2, 2, n), np.uint64)
    for lane, p in enumerate(_P):
        made[0, lane, 1:], made[1, lane, 1:] = p, pow(p, -1, 1 << 64)
    with np.errstate(over="ignore"):
        made = np.cumprod(made, axis=2, dtype=np.uint64)
    return made[0], made[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of both factors, and of their inverses: lanes x n."""
    return _kept_powers() if n == KEPT_POWERS else _powers(n)


def chunk_rows(docs: DataFrame, span: int = SPAN, least: int = LEAST_CHUNK) -> DataFrame:
    """``docs(doc, th, text)`` -> ``(doc, at, d1, rest)``: a row for each chunk, th being 32 bits of a hash of the text.

    To keep the shuffled rows short, at holds 31 bits of the chunk's start, 20 of its length, and twice 6 of how far its borders
    are from words inside it; it is negative if the document has the same chunk further up. d1 and the upper half
    of rest are 96 bits of its digest, the lower half is th.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        for b in batches:
            for at in range(0, b.num_rows, 64):
                cols: list[tuple] = []
                part = b.slice(at, 64)
                for doc, th, t in zip(part["doc"].to_pylist(), part["th"].to_pylist(), part["text"], strict=True):
                    data = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                    start, end = chunks(data, chunk_ends(data, table, span), least)
                    fits = end - start < 1 << 20  # always, but in bytes that are no UTF-8
                    start, end = start[fits], end[fits]
                    if not len(start):
                        continue
                    gap = blank[data]
                    opens = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
                    closes = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
                    none = np.int64(1 << 40)
                    ahead = np.append(opens, none)[np.searchsorted(opens, start)] - start
                    back = end - np.insert(closes, 0, -none)[np.searchsorted(closes, end, "right")]
                    ahead, back = np.where(ahead > MOVE, 0, ahead), np.where(back > MOVE, 0, back)
                    d = run_digests(byte_digests(data), start, end - GRAM + 1).view(np.int64)
                    place = start << 32 | (end - start) << 12 | ahead << 6 | back
                    seen = np.ones(len(place), bool)
                    seen[np.unique(d[:, 0], return_index=True)[1]] = False
                    place[seen] |= AGAIN
                    cols.append((np.full(len(start), doc, np.int64), place, d[:, 0], d[:, 1] >> 32 << 32 | th))
                if cols:
                    merged = [np.concatenate(c) for c in zip(*cols, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], ["doc", "at", "d1", "rest"])
        give_back()

    return docs.mapInArrow(run, "doc long, at long, d1 long, rest long")


def _text_half(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(LOW)


def _passages(docs: DataFrame, doc_id: str, text: str, span: int, least_chunk: int, least: int) -> DataFrame:
    """``repeated_passages`` with th, by which texts of one id are told apart."""
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), _text_half(F.col(text)).alias("th"), F.col(text).alias("text"))
    each = chunk_rows(base, span, least_chunk)
    d2 = F.shiftright("rest", 32).cast("int")
    held = each.groupBy("d1", d2.alias("d2")).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count_if(F.col("at") >= 0).alias("n_docs")).where("low < high")
    # a join key of its own has an exchange of its own on both sides, which the skew-join rule can split
    key = F.col("d1").bitwiseXOR(F.lit(1))
    held = held.select(key.alias("held_key"), "d2", "low", "n_docs")
    hits = each.select(key.alias("key"), "doc", "at", "rest").join(held, (F.col("key") == F.col("held_key")) & (d2 == F.col("d2")))
    bits = lambda n, size: F.shiftright(F.col("at"), n).bitwiseAND((1 << size) - 1)
    start = bits(32, 31)
    hits = hits.select("doc", F.col("rest").bitwiseAND(LOW).alias("th"), start.alias("start"), (start + bits(12, 20)).alias("end"), bits(6, 6).alias("ahead"), bits(0, 6).alias("back"), "low", "n_docs").dropDuplicates(["doc", "th", "start", "end"])
    order = W.partitionBy("doc", "th").orderBy("start", "end")
    hits = hits.withColumn("gap", F.coalesce((F.col("start") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0)))
    hits = hits.withColumn("run", F.sum("gap").over(order))
    runs = hits.groupBy("doc", "th", "run").agg(
        (F.min("start") + F.min_by("ahead", F.struct("start", "end"))).alias("start"), (F.max("end") - F.min_by("back", F.struct(-F.col("end"), "start"))).alias("end"),
        F.count("*").alias("n_chunks"), F.max("n_docs").alias("n_docs"), F.min_by("low", F.struct("start", "end")).alias("first_doc"),
    )
    return runs.where(F.col("end") - F.col("start") >= least).select(F.col("doc").alias("doc_id"), "th", "start", "end", "n_chunks", "n_docs", "first_doc")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, least_chunk: int = LEAST_CHUNK, least: int = LEAST_PASSAGE) -> DataFrame:
    """``(doc_id, start, end, n_chunks, n_docs, first_doc)``: passages that other documents hold too.

    start and end are byte offsets in the UTF-8 text, never inside a character. A passage is the union of consecutive chunks
    each found in two documents or more, of ``least`` bytes at least; it lies inside the true repeated passage and falls
    short of it by up to 15 bytes and ``span`` at the start, by up to ``span`` at the end, and by parts of words. So with
    the given sizes a passage of 207 bytes is always found (51 words of 3 letters have 203: one in some ten thousand may be
    missed), whatever script it is in. Text that repeats a few bytes has an end at each least hash, a byte apart at worst.
    n_docs is the largest number of rows that hold one of its chunks, however often, first_doc the smallest id that holds
    the first one: where that is another document, this copy is redundant. Rows of one id with several texts are passages
    each of its own text, and a passage that rows of one id alone hold is none. Null, empty and short texts have no
    chunks; rows with a null id are left out.
    """
    return _passages(docs, doc_id, text, span, least_chunk, least).drop("th").distinct()


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with ``text`` less the passages that a document of a smaller id holds too, so that one copy of each stays.

    Rows without such passages, null texts and rows with a null id stay as they are; other columns stay
    whatever their names. What is cut out leaves the white space around it. Rows of one
    id with several texts lose what is repeated of their own text.
    """
    sizes = {"span": SPAN, "least_chunk": LEAST_CHUNK, "least": LEAST_PASSAGE} | how
    passages = _passages(docs, doc_id, text, **sizes).where("first_doc < doc_id")
    key, half, spans = fresh(docs, "_key", "_half", "_spans")
    cuts = passages.groupBy(F.col("doc_id").alias(key), F.col("th").alias(half)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(spans))
    raw = F.col(text).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(raw).cast("long")))
    kept = F.zip_with(begins, ends, lambda b, e: F.substring(raw, (b + 1).cast("int"), (e - b).cast("int")).cast("string"))
    both = docs.join(cuts, (F.col(doc_id).cast("long") == F.col(key)) & (_text_half(F.col(text)) == F.col(half)), "left")
    return both.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).drop(key, half, spans)
