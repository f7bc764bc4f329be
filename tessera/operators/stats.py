"""Usage statistics and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("queries", "added", "deleted")


def month_range(month: str) -> tuple[Column, Column]:
    """First day of a month ``yyyy-mm`` and of the next."""
    first = F.to_date(F.lit(f"{month}-01"))
    return first, F.add_months(first, 1)


def daily(parts: dict[str, DataFrame], month: str) -> DataFrame:
    """``(date, queries, added, deleted)`` in a month from ``parts[kind](ts)``; days without any are absent."""
    first, end = month_range(month)
    both = None
    for kind in KINDS:
        one = parts[kind].select(F.to_date("ts").alias("date"), F.lit(kind).alias("kind")).where((F.col("date") >= first) & (F.col("date") < end))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("date").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def level(n: Column) -> Column:
    """Activity level 0 to 4."""
    return F.when(n <= 0, 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 9, 3).otherwise(4)


def calendar(days: DataFrame, month: str) -> DataFrame:
    """Every day of a month with its numbers, 0 where there are none, and its level by queries."""
    first, end = month_range(month)
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_sub(end, 1))).alias("date"))
    out = spine.join(days, "date", "left").select("date", *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS])
    return out.withColumn("level", level(F.col("queries")))


def month_totals(cal: DataFrame) -> DataFrame:
    return cal.agg(*[F.sum(k).alias(k) for k in KINDS], F.count_if(F.col("level") > 0).alias("active_days"))


def counts_by(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count("*").alias("n"))


def content_types(items: DataFrame, doc_id: str, kind: str = "type") -> DataFrame:
    """``(doc_id, types, has_multimodal)``: a histogram of content types a document."""
    each = items.groupBy(doc_id, kind).agg(F.count("*").alias("n"))
    return each.groupBy(doc_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("types"), F.bool_or(F.col(kind) != "text").alias("has_multimodal"))


def user_sketches(events: DataFrame, *by: str, user: str = "user_id", bits: int = 12) -> DataFrame:
    """``(by, users)``: mergeable sketches of the distinct users of each group, to be kept beside its counts.

    A sketch has 2 ** bits registers, so a few kilobytes however many users; counts are off by 1.04 / sqrt(2 ** bits) or so.
    """
    return events.where(F.col(user).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(user, bits).alias("users"))


def distinct_users(sketches: DataFrame, *by: str) -> DataFrame:
    """``(by, n_users)`` of coarser groups, by union of sketches: no event is read again."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("n_users"))
