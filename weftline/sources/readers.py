"""Readers of workflow artefacts: each gives a DataFrame with an explicit schema."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import file_name, line_feeds, trimmed, without_fences

EVENT_SCHEMA = "time timestamp, changeId string, phase string, node string, status string, subagent string, role string, task string, output string, summary string, artifacts array<string>, branch string, worktree string, _corrupt_record string"


def files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, content, length and modificationTime of the files of a folder. Pass a dot folder itself as the root.

    A scan leaves out files without a byte; they are added from Spark's own listing of it, without a modificationTime.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    listed = spark.createDataFrame([(unquote(p).replace("file:///", "file:/", 1),) for p in found.inputFiles()], "path string")
    empty = listed.join(found.select("path"), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    return found.unionByName(empty).withColumn("name", file_name("path"))


def texts(spark: SparkSession, root: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """path, name and text of text files, one row for each, empty ones too; every line end becomes a line feed."""
    return files(spark, root, pattern, recursive).select("path", "name", line_feeds(F.decode("content", "UTF-8")).alias("text"))


def fragments(spark: SparkSession, folder: str, main: str | None = None) -> DataFrame:
    """ord, path and text of JSON fragments: the main file first, then a folder's by path, bytewise."""
    found = files(spark, folder, "*.json", recursive=True).withColumn("is_main", F.lit(False))
    if main:
        found = found.unionByName(files(spark, main).withColumn("is_main", F.lit(True)))
    text = found.select("path", "is_main", F.decode("content", "UTF-8").alias("text"))
    return numbered(text)


def numbered(found: DataFrame) -> DataFrame:
    """Fragments (path, is_main, text) with their place in the merge; the number of files is a driver-sized one."""
    from pyspark.sql import Window

    return found.withColumn("ord", F.row_number().over(Window.orderBy(F.col("is_main").desc(), "path"))).select("ord", "path", "text")


def tuples(lines: DataFrame, separator: str, names: list[str]) -> DataFrame:
    """Fields of delimited lines (column line); missing ones are empty."""
    parts = F.split("line", f"\\Q{separator}\\E", -1)
    return lines.select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def prefixed(spark: SparkSession, root: str, prefixes: list[str], suffix: str = ".md") -> DataFrame:
    """The files of several name prefixes, in the order of the prefixes and then of the names (columns part, name)."""
    parts = [files(spark, root, f"{p}*{suffix}").withColumn("part", F.lit(i)) for i, p in enumerate(prefixes)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def user_list(lines: DataFrame, known: list[str]) -> DataFrame:
    """The trimmed, non-empty items of comma-separated lines, and whether each is known."""
    items = F.expr("filter(transform(split(line, ','), x -> regexp_replace(x, '^\\\\s+|\\\\s+$', '')), x -> x <> '')")
    return lines.select(F.posexplode(items).alias("position", "item")).withColumn("is_known", F.col("item").isin(known))


def path_check(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """label, path and ok of expected paths against a listing."""
    return manifest.join(listing.select("path", F.lit(True).alias("found")).distinct(), "path", "left").select("label", "path", F.coalesce("found", F.lit(False)).alias("ok"))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that aren't JSON keep their text in _corrupt_record.

    change_file is the file's name. A large file is read in blocks; (change_file, block, ord) is the order of its lines.
    """
    place = [F.col("_metadata.file_name").alias("change_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord")]
    return spark.read.schema(EVENT_SCHEMA).json(path).select("*", *place)


def event_lines(logs: DataFrame) -> DataFrame:
    """Events of whole logs (value, change_file), batch or stream, with their line as `ord`: for logs that fit a row, as those of one change do."""
    lines = logs.select("change_file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("ord", "line")).where(F.trim("line") != "")
    event = F.from_json("line", EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("change_file", "ord", event.alias("e")).select("e.*", "change_file", "ord")


def prds(spark: SparkSession, root: str) -> DataFrame:
    """prd_id, slug and status of files PRD<NN>_<slug>.md."""
    t = texts(spark, root, "PRD*.md")
    return t.select(F.regexp_extract("name", r"^PRD(\d+)_(.+)\.md$", 1).alias("prd_id"), F.regexp_extract("name", r"^PRD(\d+)_(.+)\.md$", 2).alias("slug"), trimmed(F.regexp_extract("text", r"(?mi)^status:\s*(.+)$", 1)).alias("status"), "text")


def handoffs(spark: SparkSession, root: str) -> DataFrame:
    """change_id and text of files context_<change-id>.md."""
    return texts(spark, root, "context_*.md").select(F.regexp_extract("name", r"^context_(.*)\.md$", 1).alias("change_id"), "text")


def change_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of artefacts below <root>/<change id>/..., for research, previews, tasks and specs."""
    listed = files(spark, root, "*", recursive=True).drop("content")
    base = F.regexp_extract("path", rf"\Q{root.rstrip('/').removeprefix('file://')}\E/([^/]+)/(.*)$", 1)
    return listed.withColumn("change_id", base).withColumn("artifact", F.regexp_extract("path", r"([^/]+)$", 1))


def manifest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) of a JSON manifest: the entries of each list or object, 1 for other values; contents are not shown."""
    text = spark.read.text(path, wholetext=True).select(F.expr("cast(parse_json(value) as map<string, variant>)").alias("m"))
    rows = text.select(F.explode("m").alias("name", "v"))
    size = F.expr("case when schema_of_variant(v) like 'ARRAY%' then size(cast(v as array<variant>)) when schema_of_variant(v) like 'OBJECT%' then size(cast(v as map<string, variant>)) else 1 end")
    return rows.select("name", size.cast("long").alias("n"))


def status_probe(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(name, present) of expected files of a folder."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    found = files(spark, root).select("name", F.lit(True).alias("present"))
    return wanted.join(found, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each list entry (`- name` or `* name`) of a registry document."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"^\s*[-*]\s+\S")).select("line_no", F.regexp_extract("line", r"^\s*[-*]\s+(.*?)\s*$", 1).alias("entry"))


def project_config(spark: SparkSession, path: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """The project's settings, with defaults for fields that are missing or null."""
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in found.columns])


def tasks(documents: DataFrame) -> DataFrame:
    """Tasks of lines `- [ ] <id> [AFK|HITL] title (blockedBy: a, b)` of documents (change_id, text), in order, with the fields written below each.

    The lines up to the next task may name `unblocks`, `files`, `acceptance criteria` and `verification`, each behind a
    colon, as list items or not, in bold or not; the first of equal ones counts, and lists are parted by commas. Code in
    fences is no task and no field.
    """
    start = r"(?m)(?=^[ \t]*-[ \t]*\[[ xX]\][ \t]*\S)"
    parts = F.split(without_fences(line_feeds(F.col("text"))), start)
    rows = documents.select("change_id", F.posexplode(parts).alias("position", "part"))
    pattern = r"\A[ \t]*-[ \t]*\[([ xX])\][ \t]*(\S+)[ \t]*(?:\[(AFK|HITL)\])?[ \t]*([^\n]*?)[ \t]*(?:\(blockedBy:[ \t]*([^)\n]*)\))?[ \t]*(?:\n|\z)"
    part = lambda i: F.regexp_extract("part", pattern, i)
    field = lambda name: F.nullif(F.regexp_extract("part", rf"(?mi)^[ \t]*(?:[-*][ \t]+)?\**{name}\**:\**[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(F.replace(x, F.lit("`"), F.lit("")))), lambda x: x != "")
    rows = rows.where(F.col("part").rlike(pattern))
    own = [part(2).alias("id"), (part(1) != " ").alias("done"), F.nullif(part(3), F.lit("")).alias("label"), part(4).alias("title"), items(part(5)).alias("blockedBy")]
    below = [items(field("unblocks")).alias("unblocks"), items(field("files")).alias("files"), field("acceptance criteria").alias("criteria"), field("verification(?: command)?").alias("verification")]
    return rows.select("change_id", "position", *own, *below)


def imported_status(local: DataFrame, provider: DataFrame) -> DataFrame:
    """Local items (id, status) with the provider's status where it has one, and the reason for a fallback."""
    p = provider.select("id", F.col("status").alias("provider_status"))
    return local.join(p, "id", "left").select("id", F.coalesce("provider_status", "status").alias("status"), F.when(F.col("provider_status").isNull(), "provider has no status").alias("fallback_reason"))
