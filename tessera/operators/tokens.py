"""Refresh tokens on immutable tables: one a user and device class, expiry, revocation, cleaning up.

``tokens(token_id, user_id, device_info, expires_at, is_revoked, revoked_at, created_at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import device_type

KEPT_DAYS = 7


def active(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens neither revoked nor expired, the newest first."""
    return tokens.where(~F.col("is_revoked") & (F.col("expires_at") > now)).orderBy(F.desc("created_at"), "token_id")


def create(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """Tokens with new ones, each in place of its user's unrevoked ones of the same device class; unknown devices add up.

    Of several new ones of a user and device class the last created stays.
    """
    kind = lambda df: df.withColumn("_device", device_type(F.col("device_info")))
    w = W.partitionBy("user_id", "_device").orderBy(F.desc("created_at"), F.desc("token_id"))
    last = kind(new).withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | (F.col("_device") == "unknown")).drop("_rn")
    replaced = last.where(F.col("_device") != "unknown").select("user_id", "_device", F.lit(False).alias("is_revoked")).distinct()
    return kind(tokens).join(replaced, ["user_id", "_device", "is_revoked"], "left_anti").unionByName(last).drop("_device")


def revoke(tokens: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """Tokens with those chosen revoked now; what was revoked before keeps its time."""
    hit = chosen & ~F.col("is_revoked")
    return tokens.withColumns({"is_revoked": F.col("is_revoked") | chosen, "revoked_at": F.when(hit, now).otherwise(F.col("revoked_at"))})


def clean_up(tokens: DataFrame, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """Tokens less those expired, and those revoked more than ``days`` days ago."""
    old = F.col("is_revoked") & (F.col("revoked_at") < now - F.make_interval(days=F.lit(days)))
    return tokens.where(~((F.col("expires_at") < now) | F.coalesce(old, F.lit(False))))
