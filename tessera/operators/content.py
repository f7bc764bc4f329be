"""Web pages to Markdown, exports, summaries and multimodal templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import auto_title, local_summary, md_to_html, safe_filename, summary_parts

# Tags that are dropped, tags that stand alone, hints of a main part.
DROPPED = {"script", "style", "noscript"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
MAIN_HINTS = ("content", "post", "article", "entry", "markdown", "prose", "page-content", "container")
NO_PAGE_TITLE = "网页来源"
#: Characters of pages that are read at a time.
PART_CHARS = 4_000_000


class _Block:
    """What is gathered between a block's start and end: its texts, and those of the items of a list."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.texts, self.items = tag, attrs, [], []

    @property
    def raw(self) -> str:
        return "".join(self.texts)

    @property
    def tight(self) -> str:
        return _tight(self.texts)


def _tight(texts: list[str]) -> str:
    return "".join(t.strip() for t in texts)


def _heading(b: _Block) -> list[str]:
    return [f"{'#' * int(b.tag[1])} {b.tight}", ""]


def _listing(b: _Block) -> list[str]:
    bullet = (lambda i: f"{i}. ") if b.tag == "ol" else (lambda i: "- ")
    return [*(bullet(i) + _tight(item) for i, item in enumerate(b.items, 1)), ""]


def _fence(b: _Block) -> list[str]:
    return [f"```\n{b.raw}\n```", ""]


def _link(b: _Block) -> list[str]:
    return [f"[{b.tight}]({b.attrs['href']})" if b.attrs.get("href") else b.tight]


#: How each kind of block is written; a block inside another is part of its text.
WRITERS: dict[str, Callable[[_Block], list[str]]] = {
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), _heading),
    **dict.fromkeys(("ul", "ol"), _listing),
    **dict.fromkeys(("pre", "code"), _fence),
    "p": lambda b: [b.raw, ""],
    "blockquote": lambda b: [*(f"> {x}" for x in b.raw.splitlines()), ""],
    "a": _link,
}


class _Reader(HTMLParser):
    """Writes Markdown lines while it reads, and notes where texts and lines of possible main parts begin and end.

    A part that begins inside a block can't be written on its own and is none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []  # tags with the part they began
        self.parts: list[list] = []  # rank, first text and line, last text and line
        self.texts: list[str] = []
        self.lines: list[str] = []
        self.block: _Block | None = None
        self.block_depth = self.dropped = 0
        self.title: str | None = None
        self.has_body = False

    def _rank(self, tag: str, attrs: dict[str, str]) -> tuple | None:
        """The place of a possible main part among those of equal length; None if it is none."""
        if tag in ("article", "main"):
            first = all(p[0][:2] != (0, tag) for p in self.parts)
            return (0, tag) if first else None
        if tag in ("div", "section"):
            hints = [k for k, hint in enumerate(MAIN_HINTS) if hint in attrs.get("class", "")]
            return (1, hints[0], len(self.parts)) if hints else None
        if tag == "body" and not self.has_body:
            self.has_body = True
            return (2,)
        return None

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        if tag in VOID:
            self.handle_startendtag(tag, attrs)
            return
        part = None
        if tag in DROPPED:
            self.dropped += 1
        elif self.block is None and not self.dropped:
            if (rank := self._rank(tag, held)) is not None:
                part = len(self.parts)
                self.parts.append([rank, len(self.texts), len(self.lines), None, None])
            if tag in WRITERS:
                self.block, self.block_depth = _Block(tag, held), len(self.open)
        self.open.append((tag, part))
        if self.block is not None and tag == "li" and len(self.open) == self.block_depth + 2:
            self.block.items.append([])

    def handle_startendtag(self, tag, attrs):
        if self.block is None and not self.dropped:
            held = {k: v or "" for k, v in attrs}
            if tag == "br":
                self.lines.append("")
            elif tag == "img" and held.get("src"):
                self.lines.append(f"![{held.get('alt', '')}]({held['src']})")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._leave() != tag:
                pass

    def _leave(self) -> str:
        tag, part = self.open.pop()
        if tag in DROPPED:
            self.dropped -= 1
        if self.block is not None and len(self.open) == self.block_depth:
            self.lines += WRITERS[tag](self.block)
            self.block = None
        if part is not None:
            self.parts[part][3:] = [len(self.texts), len(self.lines)]
        return tag

    def handle_data(self, data):
        inside = {t for t, _ in self.open}
        if "title" in inside and self.title is None and data.strip():
            self.title = data.strip()
        if self.dropped:
            return
        self.texts.append(data)
        if self.block is None:
            if data.strip():
                self.lines.append(data)
        else:
            self.block.texts.append(data)
            if self.block.items and len(self.open) >= self.block_depth + 2 and self.open[self.block_depth + 1][0] == "li":
                self.block.items[-1].append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._leave()


def read_page(html: str | None, only_main: bool = True) -> tuple[str, str]:
    """Title and Markdown of a page: its main part with the most text, without scripts and styles."""
    page = _Reader()
    page.feed(html or "")
    page.finish()
    whole = [(3,), 0, 0, len(page.texts), len(page.lines)]
    bodies = [p for p in page.parts if p[0] == (2,)] or [whole]
    wanted = [p for p in page.parts if p[0] < (2,)] + bodies if only_main else bodies
    said = lambda p: "\n".join(page.texts[p[1] : p[3]]).strip()
    best = min(wanted, key=lambda p: (-len(said(p)), p[0]))
    lines = "\n".join(x.rstrip() for x in page.lines[best[2] : best[4]])
    return page.title or NO_PAGE_TITLE, "\n".join(lines.splitlines()).strip() or said(whole)


def pages_to_markdown(pages: DataFrame, page_id: str = "page_id", html: str = "html", only_main: bool = True) -> DataFrame:
    """``(page_id, title, markdown)``; null pages have the default title and no text.

    A batch is read in parts, so that Python holds a few pages as text and not a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                size, got = 0, []
                while at + len(got) < b.num_rows and (not got or size < PART_CHARS):
                    page = b["_html"][at + len(got)].as_py()
                    size += len(page or "")
                    got.append(read_page(page, only_main))
                yield pa.RecordBatch.from_arrays([b["_id"].slice(at, len(got)), *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], ["page_id", "title", "markdown"])
                at += len(got)

    base = pages.select(F.col(page_id).alias("_id"), F.col(html).alias("_html"))
    return base.mapInArrow(run, f"page_id {base.schema['_id'].dataType.simpleString()}, title string, markdown string")


def export_markdown(title: Column, kind: Column, tags: Column, created_at: Column, content: Column) -> Column:
    """A document as Markdown with a front matter."""
    tagged = F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    when = F.when(created_at.isNotNull(), F.concat(F.lit("created_at: "), F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss")))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit('title: "'), title, F.lit('"')), F.concat(F.lit("file_type: "), kind), tagged, when, F.lit("---"), F.lit(""), content)


def export_html(title: Column, content: Column) -> Column:
    return F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>"), md_to_html(content), F.lit("</body></html>"))


def export_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


# Media types of the exports.
MIME = {"md": "text/markdown", "html": "text/html", "json": "application/json"}


def export_files(docs: DataFrame, form: str, *kept: str) -> DataFrame:
    """``(filename, mime, body)`` of documents ``(title, file_type, tags, created_at, content)`` as Markdown, a page or JSON."""
    c = {x: F.col(x) for x in ("title", "file_type", "tags", "created_at", "content")}
    body = {"md": export_markdown(*c.values()), "html": export_html(c["title"], c["content"]), "json": export_json(*c)}[form]
    return docs.select(*kept, safe_filename(c["title"], form).alias("filename"), F.lit(MIME[form]).alias("mime"), body.alias("body"))


def multimodal_text(kind: Column, caption: Column, body: Column, footnote: Column) -> Column:
    """Text of an image, table or equation item for indexing, without a model."""
    name = F.create_map(*[F.lit(x) for x in ("image", "[图片]", "table", "[表格]", "equation", "[公式]")])
    return F.concat_ws("\n", F.element_at(name, kind), caption, body, footnote)


def local_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, title, bullets, summary, key_points, keywords)``: what stands in where no model answers."""
    t = docs.select(doc_id, F.col(text).alias("_t")).withColumn("title", auto_title(F.col("_t")))
    return t.select(doc_id, "title", local_summary(F.col("_t")).alias("bullets"), summary_parts(F.col("title"), F.col("_t")).alias("s")).select(doc_id, "title", "bullets", "s.*")
