"""Entities and relations from a model's JSON answers, also fenced or cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import NO_CONTEXT, SENTENCE_END, clip, entity_type, strip

LEAST_CHARS = 20
ANSWER = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,type:string,description:string>>>"


def worth_asking(text: Column) -> Column:
    """Texts of too few characters are not sent to a model."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= LEAST_CHARS


def fenced(text: Column) -> Column:
    """The JSON of an answer: what a code fence holds, to the end if it isn't closed; else the whole answer."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|\z)", 1)
    return strip(F.when(F.contains(text, F.lit("```")), inside).otherwise(text))


def close_open(text: Column) -> Column:
    """A cut JSON text with what is still open closed: a string, then brackets, innermost first; no comma before them.

    Whole strings are taken out; a quote that is left opens the last, cut one. Of what stands before it only the
    brackets count: each opening one puts its partner in front of those awaited, each closing one takes the first.
    """
    bare = F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(F.substring_index(bare, '"', 1), r"[^\[\]{}]", ""), "")
    awaited = F.aggregate(
        F.filter(brackets, lambda c: c != ""), F.lit(""),
        lambda held, c: F.when(c == "{", F.concat(F.lit("}"), held)).when(c == "[", F.concat(F.lit("]"), held)).otherwise(F.substr(held, F.lit(2))),
    )
    # a backslash that lost what it escapes would escape the added quote
    whole = F.when(F.contains(bare, F.lit('"')), F.concat(F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\\z", "$1"), F.lit('"'))).otherwise(text)
    return F.concat(F.regexp_replace(whole, r"[, \t\r\n]+\z", ""), awaited)


def answer(text: Column) -> Column:
    """The parsed answer: as it is, its outermost braces, those closed, or what stands up to the last brace closed."""
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    start = F.regexp_extract(text, r"(?s)(\{.*)\z", 1)
    whole = F.regexp_extract(start, r"(?s)\A(.*\})", 1)
    tries = (fenced(text), outer, close_open(start), close_open(whole))
    return F.coalesce(*[F.when(F.get_json_object(t, "$").startswith("{"), F.from_json(t, ANSWER)) for t in tries])


def parse_answers(answers: DataFrame, key: str, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Entities ``(key, pos, name, type, description)`` and relations ``(key, pos, source, target, type, description)``.

    Stripped; those without a name or an end are dropped; types are normalised. Answers that can't be read give none.
    """
    a = answers.select(key, answer(F.col(text)).alias("a"))
    clean = lambda c, default="": strip(F.coalesce(F.col(c), F.lit(default)))
    e = a.select(key, F.posexplode("a.entities").alias("pos", "e")).select(key, "pos", clean("e.name").alias("name"), entity_type(F.col("e.type")).alias("type"), clean("e.description").alias("description"))
    kind = F.when(clean("r.type") == "", "相关").otherwise(clean("r.type"))
    r = a.select(key, F.posexplode("a.relations").alias("pos", "r")).select(key, "pos", clean("r.source").alias("source"), clean("r.target").alias("target"), kind.alias("type"), clean("r.description").alias("description"))
    return e.where("name <> ''"), r.where("source <> '' and target <> ''")


def result_bullet(content: Column) -> Column:
    """A result's first line; of a single line its first sentence; else its first 120 characters."""
    text = F.regexp_replace(strip(F.coalesce(content, F.lit(""))), r"\r\n?", "\n")
    line = F.when(F.contains(text, F.lit("\n")), strip(F.substring_index(text, "\n", 1)))
    ends = [F.when(F.contains(text, F.lit(e)), strip(F.left(text, F.instr(text, e)))) for e in SENTENCE_END]
    first = F.coalesce(line, *ends, F.lit(""))
    return F.concat(F.lit("- "), F.when(first != "", first).otherwise(clip(text, 120)))


def summarise_results(results: DataFrame, top: int = 3, rank: str = "rank", content: str = "content") -> DataFrame:
    """``(summary)``: a bullet for each of the first results of one query; a fixed sentence where there are none."""
    each = results.where(F.col(rank) <= top).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), result_bullet(F.col(content)).alias("b")))).alias("x"))
    return each.select(F.when(F.size("x") == 0, NO_CONTEXT).otherwise(F.array_join(F.transform("x", lambda x: x["b"]), "\n")).alias("summary"))
