"""Column functions on names, paths and front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def line_feeds(text: Column) -> Column:
    """Carriage returns, with a line feed or alone, as line feeds."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def without_fences(text: Column) -> Column:
    """Markdown without its fenced code; a fence that is not closed goes to the end."""
    return F.regexp_replace(text, r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\z)", "")


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_id(dotted: str | Column) -> Column:
    """The parent of a dotted id; null for a root."""
    c = F.col(dotted) if isinstance(dotted, str) else dotted
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]+$", ""))


def id_prefixes(dotted: str | Column) -> Column:
    """A dotted id and all its ancestors, the root first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))


def front_matter_fields(header: Column) -> Column:
    """A map of `key: value` lines: split at the first colon, both sides trimmed, the last of equal keys wins."""
    pairs = F.transform(F.filter(F.split(header, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(trimmed(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 1)).alias("k"), trimmed(F.regexp_extract(x, r"(?s)^([^:]*):(.*)$", 2)).alias("v")))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def excluded(path: str | Column, names: list[str]) -> Column:
    """Whether any segment of a path is one of the names."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(names))
