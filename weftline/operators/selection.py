"""What answers of numbers select from a list, and where a setting is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def picked(options: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer, name, valid): each answer's option, counted from 1; an answer that is no number of the list is not valid.

    options have position (from 1) and name; answers have answer as text.
    """
    plain = F.col("answer").rlike(r"^[0-9]+$") & (F.length("answer") <= 9)
    number = F.when(plain, F.col("answer").cast("int")).alias("position")
    found = answers.select("answer", number).join(options.select(F.col("position").cast("int"), "name"), "position", "left")
    return found.select("answer", "name", F.col("name").isNotNull().alias("valid"))


def with_forced(selected: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """The selected keys and the forced ones, each once."""
    return selected.select(key).union(forced.select(key)).distinct()


def first_existing(wanted: DataFrame, listing: DataFrame, default: str) -> DataFrame:
    """(name, path): for each name the first of its wanted paths (name, rank, path) that the listing has, else the default."""
    there = listing.select("path", F.lit(True).alias("there")).distinct()
    found = wanted.join(there, "path", "left").groupBy("name").agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("rank"))).alias("path"))
    return found.select("name", F.coalesce("path", F.lit(default)).alias("path"))
