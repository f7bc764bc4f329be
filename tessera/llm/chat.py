"""Multi-party perspective rotation of chats; DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and the others as named users; the mask covers what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.base import cut

#: Roles that take no part: their turns are rendered as they are, for everyone.
FIXED_ROLES = ("system",)
#: Turn numbers of one rendered segment.
SEGMENT_TURNS = 64
#: Buckets for turns without a number, which have no order among them.
LOOSE = 4096
#: Turns of one bucket; where a segment or bucket has more, as many turns may have one number, it goes on in others.
MOST_TURNS = 4096


def _dealt(t: DataFrame) -> DataFrame:
    """Turns of groups of more than MOST_TURNS in further buckets, in order, LOOSE apart.

    A sort over all machines puts each such group's turns in order; their places follow from how many of the
    group each partition holds, so that no task ever gathers a whole group.
    """
    group = ["conv_id", "segment", "bucket"]
    large = cut(t.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > MOST_TURNS).select(*[F.col(c).alias(f"_{c}") for c in group]))
    if large.isEmpty():
        return t
    same = (F.col("conv_id") == F.col("_conv_id")) & F.col("segment").eqNullSafe(F.col("_segment")) & (F.col("bucket") == F.col("_bucket"))
    order = [*group, "turn", "role", "text"]
    rows = t.join(large, same, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")))
    held = rows.groupBy(*group, "p").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy(*group).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"_{c}") for c in [*group, "p"]], "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.join(held, same & (F.col("p") == F.col("_p"))).withColumn("bucket", F.col("bucket") + LOOSE * F.floor((F.col("start") + F.col("at") - F.col("first")) / MOST_TURNS))
    return t.join(large, same, "left_anti").unionByName(placed.select(*t.columns))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``(conv_id, perspective, segment, bucket, n_turns, n_masked, text, mask)``.

    A row for each participant of each conversation and each segment of ``segment_turns`` turn
    numbers, so that no task gathers a long conversation: its segments in order, joined, are the
    dialogue. A turn is rendered as ``<|assistant|>\\n``, ``<|user name="..."|>\\n`` or
    ``<|system|>\\n``, its text, then ``<|end|>\\n``. mask lists start:end in code points of the
    segment, comma-joined: the assistant's texts with their end marks.

    Null text counts as empty; rows whose conversation or role is null are no one's turn and are
    left out; equal rows count once; several turns of one number stand by role, then text. Turns
    whose number is null come after all others (segment null), in buckets by digest. A segment or
    bucket of more than MOST_TURNS turns goes on in buckets LOOSE apart, in order. A
    conversation that only has fixed roles has no perspectives. Quotes in names become apostrophes.
    """
    t = turns.where(F.col(conv_id).isNotNull() & F.col(role).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    t = t.withColumn("segment", F.floor(F.col("turn") / segment_turns).cast("long")).withColumn("bucket", F.when(F.col("turn").isNull(), F.pmod(F.xxhash64("role", "text"), F.lit(LOOSE))).otherwise(F.lit(0)).cast("long"))
    people = t.where(~F.col("role").isin(*FIXED_ROLES)).select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = _dealt(t).groupBy("conv_id", "segment", "bucket").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = parts.join(people, "conv_id")
    own = lambda x: x["role"] == F.col("perspective")
    head = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).when(x["role"].isin(*FIXED_ROLES), F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit('<|user name="'), F.replace(x["role"], F.lit('"'), F.lit("'")), F.lit('"|>\n')))
    each = each.withColumn("said", F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), own(x).alias("own"))))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    each = each.withColumn("spans", F.aggregate("said", zero, step, lambda acc: acc["spans"]))
    whole = F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), "")
    return each.select("conv_id", "perspective", "segment", "bucket", F.size("said").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_masked"), whole.alias("text"), F.array_join("spans", ",").alias("mask"))
