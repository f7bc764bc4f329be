"""Chunking: fixed windows, recursive splitting, sections, sentence merging, neighbours, extraction units."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import sentences, strip
from tessera.functions.vectors import dot, hash_tenths, norm

SIZE, OVERLAP = 500, 100
# Separators in the order in which they are tried.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "，", "；", "：", " ", ""]


def fixed_windows(docs: DataFrame, size: int = 500, overlap: int = 50, doc_id: str = "doc_id", text: str = "text", keep_tail: bool = True) -> DataFrame:
    """``(doc_id, idx, content)``: windows every size - overlap characters; ``keep_tail`` keeps a last one inside the overlap."""
    step, n = size - overlap, F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    w = docs.where(n > 0).select(doc_id, F.posexplode(F.transform(starts, lambda s: F.substr(F.col(text), s + 1, F.lit(size)))).alias("idx", "content"))
    return w if keep_tail else w.where((F.col("idx") == 0) | (F.length("content") > overlap))


def _split(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` where the separators allow: split at the first that occurs, merge up, recurse into what is too long."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    run: deque[str] = deque()
    length = 0  # of what is in run

    def flush() -> None:
        if run:
            out.append("".join(run))

    for p in parts:
        if len(p) > size and rest:
            flush()
            run.clear()
            length = 0
            out += _split(p, size, overlap, rest)
            continue
        if run and length + len(p) > size:
            flush()
            while run and (length > overlap or length + len(p) > size):
                length -= len(run.popleft())
        run.append(p)
        length += len(p)
    flush()
    return [s for s in (x.strip() for x in out) if s]


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, chunk_id, idx, content, start, end)``: recursive character chunks and their places.

    Places come from a cursor that goes on from each chunk's end less the overlap.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["_id"], pdf["_text"], strict=True):
                cursor = 0
                for k, c in enumerate(_split(t or "", size, overlap, SEPARATORS) if t else []):
                    start = t.find(c, cursor)
                    start = start if start >= 0 else max(t.find(c), 0) or cursor
                    rows.append((i, f"{i}_chunk_{k}", k, c, start, start + len(c)))
                    cursor = max(cursor, start + len(c) - overlap)
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "idx", "content", "start", "end"])

    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return base.mapInPandas(run, f"doc_id {base.schema['_id'].dataType.simpleString()}, chunk_id string, idx int, content string, start int, end int")


def with_neighbours(chunks: DataFrame, most: int = 2000, doc_id: str = "doc_id", idx: str = "idx") -> DataFrame:
    """Chunks with total_chunks, and the tail of the one before and head of the one after."""
    w = W.partitionBy(doc_id).orderBy(idx)
    return chunks.withColumns({
        "total_chunks": F.count("*").over(W.partitionBy(doc_id)),
        "context_before": F.right(F.lag("content").over(w), F.lit(most)),
        "context_after": F.left(F.lead("content").over(w), F.lit(most)),
    })


def around(chunks: DataFrame, width: int = 1, doc_id: str = "doc_id", idx: str = "idx") -> DataFrame:
    """Chunks with the contents of ``width`` neighbours on both sides, line by line."""
    w = W.partitionBy(doc_id).orderBy(idx)
    near = F.concat(F.collect_list("content").over(w.rowsBetween(-width, -1)), F.collect_list("content").over(w.rowsBetween(1, width)))
    return chunks.withColumn("context", F.array_join(near, "\n"))


def page_context(items: DataFrame, width: int = 1, doc_id: str = "doc_id", page: str = "page", idx: str = "idx") -> DataFrame:
    """Items with the contents of pages within ``width``, others than their own marked with the page.

    A page's contents are put together once, plain and marked; then an item asks for each page by its number.
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("content").alias("t"))))
    pages = items.groupBy(F.col(doc_id).alias("_d"), F.col(page).alias("_p")).agg(lines.alias("lines"))
    mark = F.concat(F.lit("[Page "), F.col("_p").cast("string"), F.lit("] "))
    join = lambda f: F.array_join(F.transform("lines", f), "\n")
    pages = pages.select("_d", "_p", join(lambda x: x["t"]).alias("own"), join(lambda x: F.concat(mark, x["t"])).alias("other"))
    # what an item gets is that of its page, so a page is asked for by pages and not by items
    asked = items.select(F.col(doc_id).alias("d"), F.col(page).alias("p")).distinct().select("d", "p", F.explode(F.sequence(F.col("p") - width, F.col("p") + width)).alias("near"))
    near = asked.join(pages, (F.col("d") == F.col("_d")) & (F.col("near") == F.col("_p")))
    text = F.when(F.col("near") == F.col("p"), F.col("own")).otherwise(F.col("other"))
    of_page = near.groupBy("d", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("near", text.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    return items.select(doc_id, page, idx).join(of_page, (F.col(doc_id) == F.col("d")) & (F.col(page) == F.col("p"))).select(doc_id, idx, "context")


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, idx, sentence)``."""
    return docs.select(doc_id, F.posexplode(sentences(F.coalesce(F.col(text), F.lit("")))).alias("idx", "sentence"))


def merge_sentences(sentences: list[str], likeness: list[float], least: int = 100, most: int = 750, similarity: float = 0.5) -> list[str]:
    """Sentences merged while neighbours are alike and the size allows; ``likeness`` has each one's to the one before.

    A chunk ends where the next sentence is unlike or would exceed ``most``, once it has ``least`` characters;
    then chunks under ``least`` join the next. Every character is copied twice.
    """
    runs: list[list[str]] = []
    size = 0
    for s, like in zip(sentences, likeness, strict=True):
        if not runs or size >= least and (like < similarity or size + len(s) > most):
            runs.append([])
            size = 0
        runs[-1].append(s)
        size += len(s)
    out: list[list[str]] = []
    for text in map(" ".join, runs):
        held = sum(map(len, out[-1])) + len(out[-1]) - 1 if out else least
        if held < least and held + len(text) <= most:
            out[-1].append(text)
        else:
            out.append([text])
    return [" ".join(c) for c in out]


def semantic_chunks(docs: DataFrame, least: int = 100, most: int = 750, similarity: float = 0.5, doc_id: str = "doc_id", text: str = "text", dim: int = 64) -> DataFrame:
    """``(doc_id, idx, content)``: sentences merged by ``merge_sentences``, alike by the offline embedding.

    Likeness is an exact product of whole numbers over that of the norms, as sentences just at ``similarity`` are common.
    """
    v = sentence_rows(docs, doc_id, text).withColumn("vector", hash_tenths(F.col("sentence"), dim)).withColumn("norm", norm(F.col("vector")))
    w = W.partitionBy(doc_id).orderBy("idx")
    v = v.withColumns({"_product": dot(F.col("vector"), F.lag("vector").over(w)), "_norms": F.col("norm") * F.lag("norm").over(w)})
    v = v.withColumn("sim", F.when(F.col("_product").isNull(), 1.0).when(F.col("_norms") == 0, 0.0).otherwise(F.col("_product") / F.col("_norms")))
    runs = v.groupBy(F.col(doc_id).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("idx", "sentence", "sim"))).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [s.values for s in b["s"]]
            out = [merge_sentences(r.field("sentence").to_pylist(), r.field("sim").to_pylist(), least, most, similarity) for r in runs]
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(out, pa.list_(pa.string()))], ["doc", "chunks"])

    merged = runs.mapInArrow(merge, f"doc {runs.schema['doc'].dataType.simpleString()}, chunks array<string>")
    return merged.select(F.col("doc").alias(doc_id), F.posexplode("chunks").alias("idx", "content"))


def chunk_by_strategy(
    docs: DataFrame, load: Callable[[], Callable[[list[str]], list]], strategy: Column, least: int = 100, most: int = 750, similarity: float = 0.5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(doc_id, idx, content, used, error)``: documents chunked by the strategy asked for, or by what is left if it fails.

    ``load`` is called in the worker and gives an embedder, from sentences to vectors. Where ``strategy`` is "semantic",
    sentences are merged by the cosine of their vectors; a document whose sentences the embedder throws at, or gives another
    number of vectors for, is split into characters like all others, with the error as data. A document of one sentence
    is one chunk, of none has none. An embedder that can't be loaded fails every document on its own. Only failed
    documents and those of other strategies reach the second pass.
    """
    base = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(strategy, F.lit("")) == "semantic").alias("asked"))
    parts = base.withColumn("sentences", F.when(F.col("asked"), sentences(F.col("text"))))

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model, broken = load(), None
        except Exception as e:  # the model's own errors, whatever they are, are results here
            model, broken = None, f"{type(e).__name__}: {e}"

        def one(found: list[str] | None) -> tuple[list[str] | None, str | None]:
            if found is None or broken:
                return None, None if found is None else broken
            if len(found) < 2:
                return found, None
            try:
                v = np.array(model(found), np.float64)
                if v.ndim != 2 or len(v) != len(found):
                    return None, f"ValueError: {len(v)} vectors for {len(found)} sentences"
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"
            size = np.linalg.norm(v, axis=1)
            like = (v[1:] * v[:-1]).sum(1) / np.where(size[1:] * size[:-1] > 0, size[1:] * size[:-1], np.inf)
            return merge_sentences(found, [1.0, *like.tolist()], least, most, similarity), None

        for b in batches:
            got = [one(s.as_py()) for s in b["sentences"]]
            yield pa.RecordBatch.from_arrays([b["doc"], b["text"], b["asked"], pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], ["doc", "text", "asked", "chunks", "error"])

    @pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _split(t, SIZE, OVERLAP, SEPARATORS) if t else [])

    tried = parts.select("doc", "text", "asked", "sentences").mapInArrow(attempt, f"doc {base.schema['doc'].dataType.simpleString()}, text string, asked boolean, chunks array<string>, error string")
    left = F.when(F.col("chunks").isNull(), F.col("text"))
    each = tried.select("doc", F.coalesce("chunks", split(left)).alias("c"), F.when(F.col("chunks").isNotNull(), "semantic").otherwise("recursive").alias("used"), "error")
    return each.select(F.col("doc").alias(doc_id), F.posexplode("c").alias("idx", "content"), "used", "error")


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, position, level, title, path)``: headings marked by # or numbers, and the path of those above them.

    Numbered headings are read in a second pass that starts from the headings left open by the first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(doc_id, F.split(body, "\n", -1).alias("ls")).select(doc_id, F.posexplode("ls").alias("no", "line"))
    lines = lines.withColumn("position", F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy(doc_id).orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    marked, numbered = r"^(#{1,6})\s+(\S.*)$", r"^(\d+(?:\.\d+)*)\s+(\S.*)$"
    head = lines.where(F.col("line").rlike(marked) | F.col("line").rlike(numbered))
    mark, number = F.regexp_extract("line", marked, 1), F.regexp_extract("line", numbered, 1)
    is_mark = mark != ""
    level = F.when(is_mark, F.length(mark)).otherwise(F.size(F.split(number, r"\.")))
    title = F.when(is_mark, strip(F.regexp_extract("line", marked, 2))).otherwise(F.concat_ws(" ", number, strip(F.regexp_extract("line", numbered, 2))))
    head = head.select(doc_id, F.when(is_mark, 0).otherwise(1).alias("turn"), "position", level.alias("level"), title.alias("title"))
    per = head.groupBy(F.col(doc_id).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", "position", "level", "title"))).alias("h"))
    item = "array<struct<position:bigint,level:int,title:string,path:string>>"
    kind = pa.list_(pa.struct([("position", pa.int64()), ("level", pa.int32()), ("title", pa.string()), ("path", pa.string())]))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h in b["h"].to_pylist():
                above: list[dict] = []
                rows = []
                for x in h:
                    above = [*[y for y in above if y["level"] < x["level"]], x]
                    rows.append({"position": x["position"], "level": x["level"], "title": x["title"], "path": " > ".join([y["title"] for y in above])})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(out, kind)], ["doc", "s"])

    found = per.mapInArrow(paths, f"doc {per.schema['doc'].dataType.simpleString()}, s {item}")
    return found.select(F.col("doc").alias(doc_id), F.explode("s").alias("s")).select(doc_id, "s.*")


def section_of(chunks: DataFrame, heads: DataFrame, doc_id: str = "doc_id", start: str = "start") -> DataFrame:
    """Chunks with the path of the last heading at or before their start: a backward as-of join by one window."""
    cols = [F.col(c) for c in chunks.columns]
    rows = chunks.select(*cols, F.lit(1).alias("_kind"), F.col(start).cast("long").alias("_at"), F.lit(None).cast("string").alias("_path"))
    empty = [F.lit(None).cast(chunks.schema[c].dataType).alias(c) if c != doc_id else F.col(c) for c in chunks.columns]
    both = rows.unionByName(heads.select(*empty, F.lit(0).alias("_kind"), F.col("position").cast("long").alias("_at"), F.col("path").alias("_path")))
    w = W.partitionBy(doc_id).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("section_path", F.last("_path", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_at", "_path")


def extraction_units(chunks: DataFrame, most: int = 2500, doc_id: str = "doc_id", idx: str = "idx", section: str = "section_path") -> DataFrame:
    """``(doc_id, unit, first_idx, content)``: consecutive chunks of one section joined up to ``most`` characters."""
    per = chunks.groupBy(F.col(doc_id).alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), F.coalesce(F.col(section), F.lit("")).alias("sec"), "content"))).alias("c"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_units = []
            for c in b["c"]:
                units: list[tuple[int, list[str]]] = []
                last, size = None, 0
                for i, sec, text in zip(*[c.values.field(k).to_pylist() for k in ("idx", "sec", "content")], strict=True):
                    size += len(text) + 1
                    if sec != last or size > most:
                        units.append((i, []))
                        last, size = sec, len(text)
                    units[-1][1].append(text)
                all_units.append([{"first": i, "content": "\n".join(texts)} for i, texts in units])
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(all_units, pa.list_(pa.struct([("first", pa.int32()), ("content", pa.string())])))], ["doc", "units"])

    joined = per.mapInArrow(join, f"doc {per.schema['doc'].dataType.simpleString()}, units array<struct<first:int,content:string>>")
    return joined.select(F.col("doc").alias(doc_id), F.posexplode("units").alias("unit", "u")).select(doc_id, "unit", F.col("u.first").alias("first_idx"), F.col("u.content").alias("content"))
