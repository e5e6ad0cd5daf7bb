"""Fields of handoffs, decision records and indexes, which are Markdown texts by convention."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import trimmed


def sections(docs: DataFrame, headings: Mapping[str, str], text: str = "text") -> DataFrame:
    """docs with a column for each heading (column name to heading): the trimmed text below it, down to the next heading.

    Headings are compared without case; the first of equal ones counts. A heading that a text lacks gives null.
    """
    found = {}
    for name, heading in headings.items():
        line = rf"(?im)^#+[ \t]*{re.escape(heading)}[ \t]*$"
        body = trimmed(F.regexp_extract(text, line + r"(?s:(.*?))(?=^#+[ \t]|\z)", 1))
        found[name] = F.when(F.col(text).rlike(line), body)
    return docs.withColumns(found)


def labelled(docs: DataFrame, labels: Mapping[str, str], text: str = "text") -> DataFrame:
    """docs with a column for each label (column name to label): the rest of its first `label: value` line.

    The line may be a list entry, and the label bold; labels are compared without case. A missing label gives null.
    """
    found = {}
    for name, label in labels.items():
        line = rf"(?im)^[ \t]*(?:[-*][ \t]+)?(?:\*\*)?{re.escape(label)}(?:\*\*)?[ \t]*:[ \t]*(.*?)[ \t]*$"
        found[name] = F.when(F.col(text).rlike(line), F.regexp_extract(text, line, 1))
    return docs.withColumns(found)


def prd_index(docs: DataFrame) -> DataFrame:
    """(path, position, prd_id, slug) of the PRD files that index documents (path, text) name, one a line, in their order."""
    line = docs.select("path", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    part = lambda i: F.regexp_extract("line", r"PRD(\d+)_([\w-]+)\.md", i)
    return line.select("path", "position", part(1).alias("prd_id"), part(2).alias("slug")).where("prd_id <> ''")


def packets(tasks: DataFrame, context: DataFrame, on: str) -> DataFrame:
    """Tasks with `packet`, what a worker is told of each: the task's fields and those of its context, which may be missing."""
    own, around = [c for c in tasks.columns if c != on], [c for c in context.columns if c != on]
    rows = tasks.alias("t").join(context.alias("c"), on, "left")
    return rows.select(on, F.struct(*[F.col(f"t.{c}") for c in own]).alias("task"), F.struct(*[F.col(f"c.{c}") for c in around]).alias("context")).select(F.col(on), F.struct("task", "context").alias("packet"))
