"""Front-matter documents as rows, their contract and their renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import front_matter_fields, trimmed

# What closes a header; agents may end there, prompts need a line end.
AGENT = r"(?s)\A---\n(.*?)\n---\n?"
PROMPT = r"(?s)\A---\n(.*?)\n---\n"


def parsed(docs: DataFrame, pattern: str = AGENT) -> DataFrame:
    """docs (name, text) with has_header, header, fields and body; without a header the body is the whole text."""
    has = F.col("text").rlike(pattern)
    fields = F.when(has, front_matter_fields(F.regexp_extract("text", pattern, 1)))
    return docs.select("name", "text", has.alias("has_header"), F.when(has, F.regexp_extract("text", pattern, 1)).alias("header"), fields.alias("fields"), F.when(has, F.regexp_replace("text", pattern, "")).otherwise(F.col("text")).alias("body"))


def contract(docs: DataFrame, required: list[str], sections: list[str], prefix: str = "") -> DataFrame:
    """(name, missing_fields, missing_sections, severity) of parsed docs whose name begins with the prefix."""
    fields = F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.col("fields")[k], F.lit("")) == "")
    parts = F.filter(F.array(*map(F.lit, sections)), lambda s: ~F.contains(F.col("body"), s))
    out = docs.where(F.col("name").startswith(prefix) & F.col("has_header")).select("name", fields.alias("missing_fields"), parts.alias("missing_sections"))
    return out.withColumn("severity", F.when((F.size("missing_fields") > 0) | (F.size("missing_sections") > 0), 2).otherwise(0))


# The lines of a rendered agent's header that are the same in all.
AGENT_LINES = ["mode: subagent", "permission:", "  read: allow", "  glob: allow", "  grep: allow", "  edit: deny", "  task: deny"]


def agent_text(docs: DataFrame) -> DataFrame:
    """(name, rendered, severity) of parsed agents: a header by their tools, then the body.

    Without a header the text itself is rendered; a header without a description is an error (severity 2, no text).
    """
    tools = F.transform(F.split(F.coalesce(F.col("fields")["tools"], F.lit("")), ","), trimmed)
    has = lambda *names: F.arrays_overlap(tools, F.array(*map(F.lit, names)))
    line = lambda k: F.when(F.coalesce(F.col("fields")[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), F.col("fields")[k]))
    head = F.concat_ws("\n", F.lit("---"), line("description"), *map(F.lit, AGENT_LINES), F.when(has("Bash"), "  bash: allow").otherwise("  bash: deny"), F.when(has("WebSearch"), "  websearch: allow"), F.when(has("WebFetch"), "  webfetch: allow"), line("color"), F.lit("---"))
    bad = F.col("has_header") & line("description").isNull()
    rendered = F.when(bad, None).when(F.col("has_header"), F.concat(head, F.lit("\n"), F.col("body"))).otherwise(F.col("text"))
    return docs.select("name", rendered.alias("rendered"), F.when(bad, 2).otherwise(0).alias("severity"))


def prompt_text(docs: DataFrame) -> DataFrame:
    """(name, rendered, severity) of parsed prompts: description, allowed-tools, argument-hint, then the body.

    The first line of a key in the header counts, trimmed. No header and no or an empty description are errors.
    """
    found = lambda k: F.nullif(F.regexp_extract("header", rf"(?m)^{k}:\s*(.+)$", 1), F.lit(""))
    line = lambda k: F.concat(F.lit(f"{k}: "), trimmed(found(k)))
    head = F.concat_ws("\n", F.lit("---"), line("description"), line("allowed-tools"), line("argument-hint"), F.lit("---"))
    ok = F.col("has_header") & found("description").isNotNull()
    return docs.select("name", F.when(ok, F.concat(head, F.lit("\n"), F.col("body"))).alias("rendered"), F.when(ok, 0).otherwise(2).alias("severity"))
