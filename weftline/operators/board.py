"""Boards and roll-ups over workflow items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import id_prefixes, parent_id


def columns(items: DataFrame, status: str, order: list[str]) -> DataFrame:
    """(status, position, n): items in each of the listed columns, empty ones kept."""
    spark = items.sparkSession
    board = spark.createDataFrame([(s, i) for i, s in enumerate(order)], f"{status} string, position int")
    counted = items.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return board.join(counted, status, "left").select(status, "position", F.coalesce("n", F.lit(0)).alias("n"))


def with_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a small table by key; rows without a match keep nulls."""
    return rows.join(table, key, "left")


def phase_position(rows: DataFrame, phase: str, order: list[str]) -> DataFrame:
    """Rows with the place of their phase, from 0; unknown phases get the place after the last."""
    places = F.array(*map(F.lit, order))
    at = F.array_position(places, F.col(phase))
    return rows.withColumn("phase_position", F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(order)).cast("int"))


def change_view(changes: DataFrame, parts: dict[str, DataFrame], key: str = "change_id") -> DataFrame:
    """Changes with the columns of several parts, each with one row for a key, and a has_<part> for each."""
    return reduce(lambda out, p: out.join(p[1].withColumn(f"has_{p[0]}", F.lit(True)), key, "left").fillna(False, [f"has_{p[0]}"]), parts.items(), changes)


def rollup(items: DataFrame, key: str, done: str) -> DataFrame:
    """(ancestor, n, n_done) for every dotted id and its ancestors; items count in themselves and above."""
    return items.select(F.explode(id_prefixes(key)).alias("ancestor"), F.col(done).cast("int").alias("d")).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("n_done"))


def with_parent(items: DataFrame, key: str) -> DataFrame:
    """Items with their parent's id, and whether the parent is there."""
    parents = items.select(F.col(key).alias("parent"), F.lit(True).alias("parent_found")).distinct()
    return items.withColumn("parent", parent_id(key)).join(parents, "parent", "left").fillna(False, ["parent_found"])


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows that are not there: outputs of a phase, reports of a board's personas, links of a trace."""
    return expected.join(actual.select(*on).distinct(), on, "left_anti")


def trace(rows: DataFrame, links: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows with has_<link> for each of the links, tables with the key, and gaps, the names of the links that are missing."""
    for name, table in links.items():
        rows = rows.join(table.select(key, F.lit(True).alias(f"has_{name}")).distinct(), key, "left").fillna(False, [f"has_{name}"])
    return rows.withColumn("gaps", F.array_compact(F.array(*[F.when(~F.col(f"has_{name}"), F.lit(name)) for name in links])))


def view(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """The rows of a view: those with the given value in every named column, such as a change, a node or a status."""
    for column, value in conditions.items():
        rows = rows.where(F.col(column) == value)
    return rows


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): entries of each project, registry or kind."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def failed_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows with the names of the rules (SQL conditions) that they don't meet, and passed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def unpivoted(matrix: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A wide placement matrix as rows, empty cells left out."""
    return matrix.unpivot([key], [c for c in matrix.columns if c != key], name, value).where(F.col(value).isNotNull())
