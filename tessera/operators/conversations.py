"""Conversations: previews, turn pairs, session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previews(messages: DataFrame, chars: int = 20, conv_id: str = "conv_id", order: str = "turn", limit: int | None = None) -> DataFrame:
    """``(conv_id, preview, n_messages)``: the head of each conversation's first user message."""
    user = F.when(F.col("role") == "user", F.struct(order, "text"))
    p = messages.groupBy(conv_id).agg(F.left(F.min(user)["text"], F.lit(chars)).alias("preview"), F.count("*").alias("n_messages"))
    return p if limit is None else p.orderBy(conv_id).limit(limit)


def turn_pairs(messages: DataFrame, last: int = 5, conv_id: str = "conv_id", order: str = "turn", answer_role: str = "assistant") -> DataFrame:
    """``(conv_id, turn, question, answer)``: user turns answered at once, the last few of each conversation."""
    w = W.partitionBy(conv_id).orderBy(order)
    m = messages.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    pairs = m.where((F.col("role") == "user") & (F.col("next_role") == answer_role)).select(conv_id, order, F.col("text").alias("question"), "answer")
    return pairs.withColumn("_r", F.row_number().over(W.partitionBy(conv_id).orderBy(F.desc(order)))).where(F.col("_r") <= last).drop("_r")


def history_prompt(pairs: DataFrame, conv_id: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(conv_id, history)``: question and answer lines, oldest first."""
    line = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    each = pairs.groupBy(conv_id).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("x"))
    return each.select(conv_id, F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("history"))


def activate(sessions: DataFrame, session_id: Column) -> DataFrame:
    """Make one session the active one of its user and mode."""
    chosen = sessions.where(F.col("session_id") == session_id).select("user_id", "mode", F.lit(True).alias("_same"))
    s = sessions.join(F.broadcast(chosen), ["user_id", "mode"], "left")
    return s.withColumn("is_active", F.when(F.col("_same"), F.col("session_id") == session_id).otherwise(F.col("is_active"))).drop("_same")


def close(sessions: DataFrame, messages: DataFrame, session_id: Column, now: Column) -> DataFrame:
    """End a session; one without messages goes."""
    full = messages.where(F.col("session_id") == session_id).limit(1).select(F.lit(True).alias("_full"))
    s = sessions.crossJoin(F.broadcast(full.agg(F.count("*").alias("_n"))))
    this = F.col("session_id") == session_id
    ended = s.where(~(this & (F.col("_n") == 0)))
    return ended.withColumns({"is_active": F.when(this, F.lit(False)).otherwise(F.col("is_active")), "ended_at": F.when(this, now).otherwise(F.col("ended_at"))}).drop("_n")


def drop_expired(sessions: DataFrame, messages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions that are not past their expiry, and the messages of those."""
    live = sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return live, messages.join(live.select("session_id"), "session_id", "left_semi")


def save_messages(messages: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with those new ones whose session exists."""
    return messages.unionByName(new.join(sessions.select("session_id"), "session_id", "left_semi"))


def active_sessions(sessions: DataFrame) -> DataFrame:
    """``(user_id, mode, session_id)``: the active session of each user and mode, the newest if there are several."""
    live = sessions.where("is_active")
    return live.groupBy("user_id", "mode").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def open_sessions(sessions: DataFrame, requests: DataFrame, days: int = 180) -> DataFrame:
    """Sessions after requests ``(user_id, mode, session_id, now)``, one a user and mode.

    An active session that has not expired is used again and lives ``days`` longer from now; else the user's
    sessions of that mode are closed and the request's id becomes a new one.
    ``sessions(session_id, user_id, mode, is_active, expires_at, updated_at)``.
    """
    later = F.col("now") + F.make_interval(days=F.lit(days))
    asked = requests.select("user_id", "mode", F.col("session_id").alias("new_id"), "now")
    joined = sessions.join(asked, ["user_id", "mode"], "left")
    usable = F.col("now").isNotNull() & F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("now")))
    w = W.partitionBy("user_id", "mode").orderBy(F.desc(usable), F.desc("updated_at"), F.desc("session_id"))
    joined = joined.withColumn("_use", usable & (F.row_number().over(w) == 1))
    old = joined.select(
        "session_id", "user_id", "mode", F.when(F.col("now").isNull(), F.col("is_active")).otherwise(F.col("_use")).alias("is_active"),
        F.when(F.col("_use"), later).otherwise(F.col("expires_at")).alias("expires_at"), F.when(F.col("_use"), F.col("now")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    used = joined.where("_use").select("user_id", "mode")
    new = asked.join(used, ["user_id", "mode"], "left_anti").select(F.col("new_id").alias("session_id"), "user_id", "mode", F.lit(True).alias("is_active"), later.alias("expires_at"), F.col("now").alias("updated_at"))
    return old.unionByName(new)


def recent_sessions(sessions: DataFrame, user: Column, limit: int = 50) -> DataFrame:
    """A user's sessions, the latest first."""
    return sessions.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), "session_id").limit(limit)


def first_messages(messages: DataFrame, session: Column, limit: int = 100, order: str = "created_at", conv_id: str = "conv_id") -> DataFrame:
    """A session's messages, the oldest first."""
    return messages.where(F.col(conv_id) == session).orderBy(order).limit(limit)
