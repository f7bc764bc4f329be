"""Reversible line dedup: exact reference counts, and cuckoo filters sharded by line digest over them.

The counts are the truth: one row for each distinct line, with the number of documents that hold it,
so that a document can be added or withdrawn by adding or subtracting its lines. The cuckoo filters
hold the digests of lines at or over the limit. They take insertions and deletions, have no false
negatives, and are small enough to keep almost every line occurrence out of the shuffle; what passes
them is confirmed against the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import SPACES, ascii_lower, cut, fresh, give_back

SLOTS, KICKS = 4, 500
#: Keys a shard is laid out for, and the bytes of filters that go to every task at a time (one shard at least).
SHARD_KEYS, BROADCAST_BYTES = 1 << 20, 32 << 20
#: Repeated ids up to which they go to every task.
BROADCAST_IDS = 1_000_000


class CuckooFilter:
    """4 slots of 16-bit fingerprints a bucket. ``data`` is a uint16 array of buckets x 4; 0 is an empty slot.

    Equal digests inserted twice take two slots, so insertions and deletions must be paired; the
    reference counts see to that by inserting a line only when its count crosses the limit.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.mask = data.reshape(-1, SLOTS), len(data) // SLOTS - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Empty, for so many keys at a load of 0.8 at most."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))))
        return cls(np.zeros(buckets * SLOTS, np.uint16))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit digests."""
        h = h.astype(np.uint64)
        f = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        i = (h & np.uint64(self.mask)).astype(np.int64)
        return f, i, i ^ self._jump(f)

    def _jump(self, f):
        with np.errstate(over="ignore"):
            return ((np.asarray(f).astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, i, j = self.places(h)
        return (self.data[i] == f[:, None]).any(1) | (self.data[j] == f[:, None]).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if there was no room; the caller then lays out a larger filter from the counts.

        Most keys find a free slot in one of their buckets, all at once; the others push keys out one by one.
        """
        rng = np.random.default_rng(0)
        f, i, j = self.places(h)
        left = ~self._fill(f, i)
        f, i, j = f[left], i[left], j[left]
        left = ~self._fill(f, j)
        f, i, j = f[left], i[left], j[left]
        for f, i, j in zip(f, i, j, strict=True):
            at = i if rng.integers(2) else j
            for _ in range(KICKS):
                free = np.flatnonzero(self.data[at] == 0)
                if len(free):
                    self.data[at, free[0]] = f
                    break
                k = rng.integers(SLOTS)
                f, self.data[at, k] = self.data[at, k], f
                at = int(at ^ self._jump(f))
            else:
                return False
        return True

    def _fill(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of the buckets ``at``; which of them found one."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else b
        turn = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        fits = turn < (self.data[b] == 0).sum(1)
        b, turn = b[fits], turn[fits]
        slot = np.argsort(self.data[b] != 0, axis=1, kind="stable")[np.arange(len(b)), turn]  # free slots first
        self.data[b, slot] = f[order[fits]]
        out = np.zeros(len(at), bool)
        out[order[fits]] = True
        return out

    def delete(self, h: np.ndarray) -> None:
        for f, i, j in zip(*self.places(h), strict=True):
            for at in (i, j):
                held = np.flatnonzero(self.data[at] == f)
                if len(held):
                    self.data[at, held[0]] = 0
                    break

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        size = max(1, len(h))
        while True:
            out = cls.sized(size)
            if out.insert(h):
                return out
            size *= 2


def lines_of(text: Column) -> Column:
    """Lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_digest(line: Column) -> Column:
    """128-bit digest of a line's key."""
    return F.unhex(F.md5(line_key(line)))


def _filter_hash(digest: Column) -> Column:
    return F.xxhash64(digest)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.hash(digest), F.lit(shards)).cast("int")


def reference_counts(docs: DataFrame, text: str = "text", min_chars: int = 1, count_by: str | None = None) -> DataFrame:
    """``(digest, n_docs)``: how many documents hold each line key of ``min_chars`` code points or more.

    A document is a row, or with ``count_by`` a value of that column (rows where it is null are one each).
    """
    # of strings distinct ones are found by hash, of binary values by comparing all with all
    digests = F.array_distinct(F.transform(F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= min_chars), F.md5))
    counts = docs.select(F.explode(digests).alias("hex")).select(F.unhex("hex").alias("digest")).groupBy("digest").agg(F.count("*").alias("n_docs"))
    if count_by is None:
        return counts
    again = docs.where(F.col(count_by).isNotNull()).groupBy(F.col(count_by).alias("by")).agg(F.count("*").alias("n")).where("n > 1").select("by")
    n = again.count()
    if not n:
        return counts
    # rows of the same document count once: what they have in common is taken off
    rows = docs.select(F.col(count_by).alias("by"), digests.alias("digests")).join(F.broadcast(again) if n <= BROADCAST_IDS else again, "by", "left_semi")
    extra = rows.select("by", F.explode("digests").alias("hex")).select("by", F.unhex("hex").alias("digest")).groupBy("by", "digest").agg((F.lit(1) - F.count("*")).alias("n_docs")).where("n_docs < 0")
    return add_counts(counts, extra.select("digest", "n_docs"))


def add_counts(counts: DataFrame, more: DataFrame) -> DataFrame:
    """The counts once the documents behind ``more`` are inserted."""
    return counts.unionByName(more).groupBy("digest").agg(F.sum("n_docs").alias("n_docs"))


def remove_counts(counts: DataFrame, gone: DataFrame) -> DataFrame:
    """The counts once the documents behind ``gone`` are deleted; lines that no document holds leave the table."""
    return add_counts(counts, gone.select("digest", (-F.col("n_docs")).alias("n_docs"))).where("n_docs > 0")


def build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """``(shard, n_keys, filter)``: a cuckoo filter a shard, of the lines in ``min_docs`` documents or more."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(pdf["h"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(pdf)], "filter": [f.data.tobytes()]})

    keys = counts.where(F.col("n_docs") >= min_docs).select(_shard(F.col("digest"), shards).alias("shard"), _filter_hash(F.col("digest")).alias("h"))
    return keys.groupBy("shard").applyInPandas(build, "shard int, n_keys long, filter binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """The filters after a change of the counts: lines that crossed the limit upwards go in, downwards come out.

    A shard whose filter lacks room is laid out anew at twice the size, from the keys at the limit.
    """
    old, new = (x.select("digest", F.col("n_docs").alias(n)) for x, n in ((before, "old"), (after, "new")))
    move = old.join(new, "digest", "full").select("digest", (F.coalesce("old", F.lit(0)) >= min_docs).alias("was"), (F.coalesce("new", F.lit(0)) >= min_docs).alias("now"))
    move = move.where("was or now").select(_shard(F.col("digest"), shards).alias("shard"), _filter_hash(F.col("digest")).alias("h"), "was", "now")

    def change(key: tuple, held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        h, was, now = moved["h"].to_numpy(), moved["was"].to_numpy(bool), moved["now"].to_numpy(bool)
        if len(held):
            f = CuckooFilter(np.frombuffer(held["filter"].iloc[0], np.uint16).copy())
            f.delete(h[was & ~now])
            if not f.insert(h[now & ~was]):
                f = CuckooFilter.of(h[now])
        else:
            f = CuckooFilter.of(h[now])
        return pd.DataFrame({"shard": [key[0]], "n_keys": [int(now.sum())], "filter": [f.data.tobytes()]})

    return filters.groupBy("shard").cogroup(move.groupBy("shard")).applyInPandas(change, "shard int, n_keys long, filter binary")


def shard_groups(filters: DataFrame, most_bytes: int) -> list[list[int]]:
    """Shards whose filters have ``most_bytes`` together; a shard's number and size are all that the driver sees."""
    groups, size = [[]], 0
    for r in filters.select("shard", F.length("filter").alias("n")).orderBy("shard").collect():
        if groups[-1] and size + r["n"] > most_bytes:
            groups.append([])
            size = 0
        groups[-1].append(r["shard"])
        size += r["n"]
    return groups


def probe(lines: DataFrame, filters: DataFrame, shards: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``lines(..., digest)`` that the filters may hold.

    Filters go to every task, ``most_bytes`` at a time: where all together are larger, groups of shards are
    probed in turn, and each turn's hits are written before the next, so that memory stays bounded.
    """
    filters, out = cut(filters), None
    groups, names = shard_groups(filters, most_bytes), lines.columns
    for group in groups:
        held = {r["shard"]: bytes(r["filter"]) for r in filters.where(F.col("shard").isin(group)).collect()}
        part = _probe(lines if len(groups) == 1 else lines.where(_shard(F.col("digest"), shards).isin(group)), names, held, shards)
        part = part if len(groups) == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    return out


def _probe(lines: DataFrame, names: list[str], held: dict[int, bytes], shards: int) -> DataFrame:
    sent = lines.sparkSession.sparkContext.broadcast(held)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {k: CuckooFilter(np.frombuffer(v, np.uint16)) for k, v in sent.value.items()}
        for b in batches:
            shard, h = b["_shard"].to_numpy(zero_copy_only=False), b["_h"].to_numpy(zero_copy_only=False)
            hit = np.zeros(len(h), bool)
            for k in np.unique(shard):
                if (f := ready.get(int(k))) is not None:
                    hit[shard == k] = f.contains(h[shard == k])
            yield b.select(names).filter(pa.array(hit))
        give_back()

    asked = lines.select(*names, _shard(F.col("digest"), shards).alias("_shard"), _filter_hash(F.col("digest")).alias("_h"))
    return asked.mapInArrow(look, lines.schema)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, counts: DataFrame | None = None, filters: DataFrame | None = None,
    shards: int | None = None, count_by: str | None = None, most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with ``text`` less the lines found in ``min_docs`` documents or more, and ``n_lines``, ``n_dropped``.

    Each row of docs counts as a document, repeated rows and null ids too, unless ``count_by`` names a column
    whose values are documents. Null text counts as empty text and comes back as the empty string. Other
    columns stay, whatever their names; columns of docs named n_lines or n_dropped are replaced. ``counts``,
    ``filters`` and ``shards`` may come from an earlier state of the store; else they are made from docs.
    """
    if (filters is None) != (shards is None):
        raise ValueError("filters and shards come together")
    counts = counts if counts is not None else cut(reference_counts(docs, text, min_chars, count_by))
    frequent = counts.where(F.col("n_docs") >= min_docs)
    if filters is None:
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        filters = build_filters(counts, min_docs, shards)
    # rows of one id and text share their lines; null ids are told apart by their texts
    key, gone, all_lines, kept = fresh(docs, "_key", "_gone", "_lines", "_kept")
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    each = keyed.select(F.col(key).alias("_row"), F.posexplode(F.transform(lines_of(F.col(text)), line_digest)).alias("pos", "digest"))
    hits = probe(each, filters, shards, most_bytes).join(frequent.select("digest"), "digest").groupBy(F.col("_row").alias(key)).agg(F.collect_set("pos").alias(gone))
    lines = keyed.join(hits.hint("shuffle_hash"), key, "left").withColumn(all_lines, lines_of(F.col(text)))
    # places that stay, by hash, so that no line is compared with all that go
    places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    stay = F.when(F.col(gone).isNull(), F.col(all_lines)).otherwise(F.transform(places, lambda i: F.element_at(all_lines, i + 1)))
    lines = lines.withColumn(kept, stay)
    out = lines.withColumns({"n_lines": F.size(all_lines).cast("long"), "n_dropped": (F.size(all_lines) - F.size(kept)).cast("long"), text: F.array_join(kept, "\n")})
    return out.drop(key, gone, all_lines, kept)
