"""Differences between a source and its mirror, and plans that would remove them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, DRIFT, MISSING, ORPHAN = "OK", "DRIFT", "MISSING", "ORPHAN"


def drift(source: DataFrame, mirror: DataFrame, key: str = "name", value: str = "content") -> DataFrame:
    """(key, action) by a full outer join: OK, DRIFT, MISSING (in the mirror) or ORPHAN (not in the source)."""
    s = source.select(key, F.col(value).alias("s_value"), F.lit(True).alias("in_source"))
    m = mirror.select(key, F.col(value).alias("m_value"), F.lit(True).alias("in_mirror"))
    action = F.when(F.col("in_mirror").isNull(), MISSING).when(F.col("in_source").isNull(), ORPHAN).when(F.col("s_value").eqNullSafe(F.col("m_value")), OK).otherwise(DRIFT)
    return s.join(m, key, "full").select(key, action.alias("action"))


def orphans(mirror: DataFrame, source: DataFrame, key: str = "name", prefixes: list[str] | None = None) -> DataFrame:
    """Rows of the mirror that the source lacks; with prefixes, among names that begin with one of them."""
    if prefixes:
        managed = F.lit(False)
        for p in prefixes:
            managed = managed | F.col(key).startswith(p)
        mirror = mirror.where(managed)
    return mirror.join(source.select(key), key, "left_anti")


def sync_plan(source: DataFrame, mirror: DataFrame, *, delete: bool, key: str = "name", value: str = "content") -> DataFrame:
    """(key, action) with COPY, UPDATE, KEEP or DELETE: a mirror deletes what the source lacks, an upsert keeps it."""
    gone = "DELETE" if delete else "KEEP"
    plan = F.when(F.col("action") == MISSING, "COPY").when(F.col("action") == DRIFT, "UPDATE").when(F.col("action") == ORPHAN, gone).otherwise("KEEP")
    return drift(source, mirror, key, value).select(key, plan.alias("action"))


def reported(actions: DataFrame) -> DataFrame:
    """What a check run shows of (key, action): all that is not in order; nothing is written."""
    return actions.where(F.col("action") != OK)


def any_drift(actions: DataFrame) -> DataFrame:
    """One row: drift, whether anything is not in order, and severity, the exit value 0 or 1."""
    found = actions.agg(F.coalesce(F.bool_or(F.col("action") != OK), F.lit(False)).alias("drift"))
    return found.select("drift", F.col("drift").cast("int").alias("severity"))


def rendered_drift(rendered: DataFrame, mirror: DataFrame) -> DataFrame:
    """(name, action) of rendered documents (name, rendered, severity) against a mirror (name, text); INVALID where severity is not 0."""
    fine = drift(rendered.where("severity = 0").select("name", F.col("rendered").alias("content")), mirror.select("name", F.col("text").alias("content")))
    bad = rendered.where("severity <> 0").select("name", F.lit("INVALID").alias("action"))
    return fine.join(bad.select("name"), "name", "left_anti").unionByName(bad)


def uninstall_plan(managed: DataFrame, chosen: DataFrame, listing: DataFrame) -> DataFrame:
    """(folder, action, n_files) of managed folders (target, folder, reported) of the chosen targets (target), by a listing (path).

    REMOVE where files lie below the folder, at any depth, with their number; SKIP where none do, for folders that are
    reported even then. Other folders are not touched, and a folder of several targets comes once.
    """
    wanted = managed.join(chosen.select("target").distinct(), "target", "left_semi").groupBy("folder").agg(F.bool_or("reported").alias("reported"))
    counted = below(listing, wanted).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))
    rows = wanted.join(counted, "folder", "left").select("folder", "reported", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    return rows.where("reported or n_files > 0").select("folder", F.when(F.col("n_files") > 0, "REMOVE").otherwise("SKIP").alias("action"), "n_files")


def below(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, path) of the files of a listing (path) that lie below a folder, by the folders above each file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    nested = listing.where(F.contains("path", F.lit("/"))).select("path", F.explode(above).alias("folder"))
    return nested.join(folders.select("folder").distinct(), "folder").select("folder", "path")


def uninstall_files(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, action, content) of an uninstall plan's files, as `apply_plan` takes them; a file below two folders comes once."""
    files = below(listing, plan.where("action = 'REMOVE'")).select("path").distinct()
    return files.select("path", F.lit("DELETE").alias("action"), F.lit(None).cast("binary").alias("content"))


def fan_out(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row for every target; Spark broadcasts the smaller side if its size allows."""
    return rows.join(targets)


def verdict(checks: DataFrame) -> DataFrame:
    """n_checks, n_failed and passed of checks (label, ok); severity is 0 or 1."""
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"))
