"""Versioned history as append-only tables: logs, state as of a commit, forward restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.desc("at"), "commit").limit(limit)


def as_of(history: DataFrame, key: str, until: str) -> DataFrame:
    """The last row of every key at or before a moment: a combined maximum, not a sort."""
    rest = [c for c in history.columns if c not in (key, "at", "commit")]
    last = history.filter(F.col("at") <= F.lit(until).cast("timestamp")).groupBy(key).agg(F.max(F.struct("at", "commit", *rest)).alias("r"))
    return last.select(key, "r.*")


def restore(history: DataFrame, key: str, until: str, commit: str = "restore", at: str | None = None) -> DataFrame:
    """Rows to append so that every key is again as it was: restoring only ever moves forward.

    A key that has changed since gets its old values once more, as kind ``restore``; one that was born since, or that was
    removed at that moment, gets none, as kind ``remove``, unless it is removed now. All carry the commit and moment (now,
    if none is given) of the restore.
    """
    old = as_of(history, key, until)
    now = as_of(history, key, "9999-12-31")
    rest = [c for c in history.columns if c not in (key, "at", "commit", "kind")]
    changed = now.alias("n").join(old.alias("o"), key, "left").filter(~F.col("n.commit").eqNullSafe(F.col("o.commit")))
    absent = F.col("o.commit").isNull() | (F.col("o.kind") == "remove")
    kind = F.when(absent, "remove").otherwise("restore")
    moment = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    values = [F.when(~absent, F.col(f"o.{c}")).alias(c) for c in rest]
    return changed.filter(~absent | (F.col("n.kind") != "remove")).select(key, F.lit(commit).alias("commit"), moment.alias("at"), kind.alias("kind"), *values).select(*history.columns)


def living(history: DataFrame, key: str, until: str) -> DataFrame:
    """``as_of`` without the keys whose last row removes them."""
    return as_of(history, key, until).filter("kind <> 'remove'")


def squash(history: DataFrame, transaction: str) -> DataFrame:
    """The rows of a transaction as one: the first and last moment, and how many they were."""
    return history.groupBy(transaction).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def commit(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What changed between two states of one schema: rows added and removed; empty means nothing to commit."""
    added = current.exceptAll(previous).withColumn("change", F.lit("added"))
    return added.unionByName(previous.exceptAll(current).withColumn("change", F.lit("removed")))


def by_day(history: DataFrame) -> DataFrame:
    """day, kind, n: the change log grouped by date."""
    return history.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


def last_heading(logs: DataFrame) -> DataFrame:
    """The first second-level heading of a change log, where the newest entry stands."""
    return logs.withColumn("heading", F.nullif(F.regexp_extract("text", r"(?m)^\s*## (\S.*)$", 1), F.lit("")))


def per_user_gap(history: DataFrame) -> DataFrame:
    """Seconds since the user's previous change."""
    w = Window.partitionBy("user_id").orderBy("at", "commit")
    return history.withColumn("gap", F.col("at").cast("long") - F.lag("at").over(w).cast("long"))
