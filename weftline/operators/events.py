"""Folds over append-only event logs: latest state, timeline, activity, order of reviews.

Events are ordered by time and then by a unique number; every function takes the names of these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the last event of each key; maxima are combined before the shuffle."""
    last = F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns])).alias("l")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"l.__{c}").alias(c) for c in columns])


def timeline(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events with their position in their key."""
    return events.withColumn("position", F.row_number().over(in_order(key, *order)))


def activity(events: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """Counts of each status by key, a column for each value."""
    return events.groupBy(key).agg(*[F.count(F.when(F.col(status) == v, 1)).alias(v) for v in values])


def next_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Events with the next status of their key, null if none came: an open dispatch."""
    return events.withColumn("next_status", F.lead(status).over(in_order(key, *order)))


def gate(events: DataFrame, key: str, time: str, first: Column, then: Column) -> DataFrame:
    """(key, passed): whether the first event of one kind precedes the first of another; keys that have both."""
    times = events.groupBy(key).agg(F.min(F.when(first, F.col(time))).alias("a"), F.min(F.when(then, F.col(time))).alias("b"))
    return times.where("a is not null and b is not null").select(key, (F.col("a") < F.col("b")).alias("passed"))


def streaks(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """(key, status, streak, length) of runs of the same status."""
    new = (~F.col(status).eqNullSafe(F.lag(status).over(in_order(key, *order)))).cast("int")
    runs = events.withColumn("new", new).withColumn("streak", F.sum("new").over(in_order(key, *order)))
    return runs.groupBy(key, status, "streak").agg(F.count(F.lit(1)).alias("length"))


def durations(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events with the seconds until the next one of their key."""
    step = F.lead(order[0]).over(in_order(key, *order))
    return events.withColumn("seconds", F.unix_timestamp(step) - F.unix_timestamp(order[0]))


def illegal_jumps(events: DataFrame, key: str, order: list[str], status: str, allowed: DataFrame) -> DataFrame:
    """Events whose step from the status before is not in allowed (before, after); a null before is a start."""
    steps = events.withColumn("before", F.lag(status).over(in_order(key, *order))).alias("s")
    same = F.col("s.before").eqNullSafe(F.col("a.before")) & (F.col(f"s.{status}") == F.col("a.after"))
    return steps.join(F.broadcast(allowed.alias("a")), same, "left_anti")


def agreement(reports: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, n_reports, agrees): whether all reports have one verdict."""
    return reports.groupBy(key).agg(F.count(F.lit(1)).alias("n_reports"), (F.min(verdict).eqNullSafe(F.max(verdict)) & (F.count(verdict) == F.count(F.lit(1)))).alias("agrees"))


def artifact_counts(events: DataFrame, key: str) -> DataFrame:
    """How many artifacts a key's events name."""
    return events.select(key, F.explode("artifacts").alias("artifact")).groupBy(key).agg(F.count(F.lit(1)).alias("n_artifacts"), F.count_distinct("artifact").alias("n_distinct"))
