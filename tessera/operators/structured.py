"""Structured content: typed items of a laid-out document, their sections, neighbours and context.

Raw items are rows ``(doc_id, pos, type, text, text_level, page_idx, captions, footnotes, caption, footnote,
img_path, table_body, latex)``; captions and footnotes are arrays of strings, all may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import cut_context, strip

# Item types.
TYPES = ("text", "image", "table", "equation")
NEIGHBOUR_CHARS = 2000


def plain_items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, type, text)``: what stands in for a layout: one text item a document, none if it is blank."""
    t = docs.select(doc_id, strip(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return t.where("text <> ''").select(doc_id, F.lit(0).alias("pos"), F.lit("text").alias("type"), "text")


def section_paths(items: DataFrame, doc_id: str = "doc_id", pos: str = "pos", levels: int = 6) -> DataFrame:
    """Items with ``section_path``: titles of the headings they stand under, outermost first; null before the first.

    A heading of a level stands until the next one of its level or a lower number, so for each level the
    last heading is looked up by a window, and counts if it comes after the last of each level above it.
    """
    w = W.partitionBy(doc_id).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    is_head = (F.col("type") == "text") & (F.col("text_level") > 0)
    level = F.least(F.col("text_level").cast("int"), F.lit(levels))
    at = [F.last(F.when(is_head & (level == k), F.struct(F.col(pos).alias("p"), strip(F.col("text")).alias("t"))), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    out = items.withColumns({f"_h{k}": h for k, h in enumerate(at, 1)})
    parts, latest = [], F.lit(None).cast("long")
    for k in range(1, levels + 1):
        place = F.col(f"_h{k}.p").cast("long")
        parts.append(F.when(place.isNotNull() & (latest.isNull() | (place > latest)), F.col(f"_h{k}.t")))
        latest = F.greatest(latest, place)
    path = F.concat_ws(" > ", *parts)
    return out.withColumn("section_path", F.when(latest.isNotNull(), path)).drop(*[f"_h{k}" for k in range(1, levels + 1)])


def typed_items(items: DataFrame, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Typed items with ``section_path``, joined ``caption`` and ``footnote``, and images with ``neighbour_text``, the text before them.

    Text items without text and items of unknown types are left out, but blank headings still open a section.
    """
    t = section_paths(items, doc_id, pos)
    body = F.when(F.col("type") == "text", strip(F.coalesce("text", F.lit(""))))
    before = F.last(F.when(body != "", body), ignorenulls=True).over(W.partitionBy(doc_id).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    joined = lambda many, one: F.when(F.size(many) > 0, F.array_join(many, ", ")).otherwise(F.coalesce(one, F.lit("")))
    t = t.withColumns({"_body": body, "neighbour_text": F.when(F.col("type") == "image", before)})
    t = t.where(F.when(F.col("type") == "text", F.col("_body") != "").otherwise(F.col("type").isin(*TYPES)))
    media = F.col("type") != "text"
    return t.select(
        doc_id, pos, "type", F.col("_body").alias("text"), "page_idx", "section_path", "neighbour_text",
        F.when(media, joined("captions", "caption")).alias("caption"),
        F.when(F.col("type").isin("image", "table"), joined("footnotes", "footnote")).alias("footnote"),
        F.when(F.col("type").isin("image", "table"), F.col("img_path")).alias("image_path"),
        F.when(F.col("type") == "table", F.coalesce("table_body", F.lit(""))).alias("table_body"),
        F.when(F.col("type") == "equation", F.coalesce("latex", "text", F.lit(""))).alias("equation"),
    )


def item_text(headers: bool = True, captions: bool = True) -> Column:
    """What an item says in a context: text with its heading marks, or the captions of an image or table; else empty."""
    head = F.concat(F.repeat(F.lit("#"), F.col("text_level").cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    out = F.when(F.col("type") == "text", F.when(F.lit(headers) & (F.col("text_level") > 0), head).otherwise(F.coalesce("text", F.lit(""))))
    for kind, name in (("image", "Image"), ("table", "Table")):
        out = out.when((F.col("type") == kind) & F.lit(captions) & (F.size("captions") > 0), F.concat(F.lit(f"[{name}: "), F.array_join("captions", ", "), F.lit("]")))
    return out.otherwise(F.lit(""))


def _said(items: DataFrame, types: tuple[str, ...]) -> DataFrame:
    t = items.where(F.col("type").isin(*types)).withColumn("said", item_text())
    return t.where(strip(F.col("said")) != "")


def page_contexts(items: DataFrame, width: int = 1, types: tuple[str, ...] = ("text",), doc_id: str = "doc_id", pos: str = "pos", page: str = "page_idx") -> DataFrame:
    """``(doc_id, page, context)`` for each page with items: what the pages within ``width`` say, others marked ``[Page n]``.

    Items without a page are on page 0. Only ``types`` speak. Joined by page number, never page by page within a document.
    """
    on = lambda df: df.withColumn("_page", F.coalesce(F.col(page).cast("int"), F.lit(0)))
    lines = on(_said(items, types)).groupBy(F.col(doc_id).alias("d"), F.col("_page").alias("p")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), "said"))).alias("lines"))
    asked = on(items).select(doc_id, F.col("_page").alias("page")).distinct().select(doc_id, "page", F.explode(F.sequence(F.greatest(F.col("page") - width, F.lit(0)), F.col("page") + width)).alias("near"))
    found = asked.join(lines, (F.col(doc_id) == F.col("d")) & (F.col("near") == F.col("p")), "left")
    mark = F.when(F.col("near") == F.col("page"), F.lit("")).otherwise(F.concat(F.lit("[Page "), F.col("near").cast("string"), F.lit("] ")))
    each = F.transform("lines", lambda x: F.struct(x["pos"].alias("pos"), F.concat(mark, x["said"]).alias("said")))
    per = found.groupBy(doc_id, "page").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce(each, F.expr("cast(array() as array<struct<pos:int,said:string>>)"))))).alias("x"))
    whole = per.select(doc_id, "page", F.array_join(F.transform("x", lambda x: x["said"]), "\n").alias("_whole"))  # made once, cut in a step of its own
    return whole.select(doc_id, "page", cut_context(F.col("_whole")).alias("context"))


def chunk_contexts(items: DataFrame, width: int = 1, types: tuple[str, ...] = ("text",), doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``(doc_id, pos, context)``: what the ``width`` items before and after each say, if they are of ``types``."""
    speaks = F.col("type").isin(*types) & (strip(item_text()) != "")
    t = items.withColumn("_said", F.when(speaks, item_text()))
    w = W.partitionBy(doc_id).orderBy(pos)
    near = F.concat(F.collect_list("_said").over(w.rowsBetween(-width, -1)), F.collect_list("_said").over(w.rowsBetween(1, width)))
    return t.select(doc_id, pos, F.array_join(near, "\n").alias("_whole")).select(doc_id, pos, cut_context(F.col("_whole")).alias("context"))


def any_contexts(sources: DataFrame, width: int = 1, mode: str = "page", types: tuple[str, ...] = ("text",), source: str = "source", index: str = "index", page: str = "page_idx") -> DataFrame:
    """sources with ``context``, that of the asked item of a source of any form.

    A source is JSON or plain text. A list of objects is a layout: by page what pages within ``width`` of the asked page say,
    others marked ``[Page n]``, or with ``mode`` "chunk" what the items before and after say. Any other list gives
    the items before and after, objects by their ``content``. A string gives itself, anything else and an empty list nothing.
    What isn't JSON, or too large for a variant, is text; null gives nothing. Rows stay as they are, no shuffle.
    """
    parsed = sources.withColumn("_v", F.try_parse_json(F.col(source)))  # what later steps use more than once is made once, in a step before
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    parsed = parsed.withColumns({"_kind": F.schema_of_variant("_v"), "_items": get(F.col("_v"), "$", "array<variant>")})
    v, kind, items = F.col("_v"), F.col("_kind"), F.col("_items")
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    here, asked = F.coalesce(F.col(index), F.lit(0)), F.coalesce(F.col(page), F.lit(0))

    def captions(x: Column, *names: str) -> Column:
        found = [F.coalesce(get(x, f"$.{n}", "array<string>"), F.array(get(x, f"$.{n}", "string"))) for n in names]
        some = [F.when(F.size(F.filter(c, lambda s: s.isNotNull())) > 0, F.array_join(c, ", ")) for c in found]
        return F.coalesce(*some, F.lit(""))

    def said(x: Column) -> Column:
        kind, text, level = get(x, "$.type", "string"), F.coalesce(get(x, "$.text", "string"), F.lit("")), get(x, "$.text_level", "int")
        out = F.when(kind == "text", F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text))
        for name, mark, keys in (("image", "Image", ("image_caption", "img_caption")), ("table", "Table", ("table_caption",))):
            held = captions(x, *keys)
            out = out.when((kind == name) & (held != ""), F.concat(F.lit(f"[{mark}: "), held, F.lit("]")))
        return F.when(kind.isin(*types), out)

    full = lambda c: F.filter(c, lambda s: s.isNotNull() & (strip(s) != ""))
    near = lambda say: F.array_join(full(F.transform(items, lambda x, i: F.when((i != here) & (F.abs(i - here) <= width), say(x)))), "\n")

    def paged(x: Column) -> Column:
        own = F.coalesce(get(x, "$.page_idx", "int"), F.lit(0))
        text = F.when(own.between(F.greatest(asked - width, F.lit(0)), asked + width), said(x))
        return F.when(strip(text) != "", F.when(own == asked, text).otherwise(F.concat(F.lit("[Page "), own.cast("string"), F.lit("] "), text)))

    layout = near(said) if mode == "chunk" else F.array_join(full(F.transform(items, paged)), "\n")
    loose = near(lambda x: strip(F.coalesce(get(x, "$.content", "string"), get(x, "$", "string"))))
    text = (
        F.when(F.col(source).isNull(), "").when(v.isNull(), F.col(source)).when(kind == "STRING", get(v, "$", "string"))
        .when(F.size(items) > 0, F.when(is_object(get(v, "$[0]", "variant")), layout).otherwise(loose)).otherwise("")
    )
    whole = parsed.withColumn("_whole", F.coalesce(text, F.lit("")))
    return whole.withColumn("context", cut_context(F.col("_whole"))).drop("_v", "_kind", "_items", "_whole")


def media_contexts(items: DataFrame, width: int = 1, doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``(doc_id, pos, context)`` of images, tables and equations: their page's context, else the text before them, else empty."""
    typed = typed_items(items, doc_id, pos).where("type <> 'text'")
    pages = page_contexts(items, width, doc_id=doc_id, pos=pos).withColumnRenamed("page", "page_idx")
    both = typed.join(pages, [doc_id, "page_idx"], "left")
    own = F.when(F.coalesce("context", F.lit("")) != "", F.col("context"))
    return both.select(doc_id, pos, F.coalesce(own, F.left("neighbour_text", F.lit(NEIGHBOUR_CHARS)), F.lit("")).alias("context"))


def to_records(items: DataFrame, *key: str) -> DataFrame:
    """Items as JSON without what is null."""
    rest = [c for c in items.columns if c not in key]
    return items.select(*key, F.to_json(F.struct(*rest)).alias("record"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """Items back from JSON; what is absent is null."""
    return records.withColumn("_r", F.from_json("record", schema)).select(*[c for c in records.columns if c != "record"], "_r.*")


def media_columns(image_path: Column, kind: Column) -> dict[str, Column]:
    """``image_url``, ``thumbnail_url`` and ``content_format`` of a search result by its type and file.

    The address is made of the two path segments that matter, the one after ``uploads`` and the last.
    """
    user = F.regexp_extract(image_path, r"(?:^|/)uploads/([^/]+)/(?:[^/]+/)*([^/]+)$", 1)
    name = F.regexp_extract(image_path, r"(?:^|/)uploads/([^/]+)/(?:[^/]+/)*([^/]+)$", 2)
    url = F.when((kind != "text") & (user != ""), F.concat(F.lit("/api/v1/images/"), user, F.lit("/"), name))
    ending = F.regexp_extract(image_path, r"\.([^./]+)$", 1)
    form = F.when(kind == "table", "markdown").when(kind == "equation", "latex").when(kind == "image", F.when(image_path.isNull(), "jpg").otherwise(ending))
    return {"image_url": url, "thumbnail_url": F.concat(url, F.lit("?size=thumbnail")), "content_format": form}
