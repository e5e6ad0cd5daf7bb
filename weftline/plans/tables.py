"""Tables that cut lineage in iterative queries, and the writers that act on plans."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a new local folder where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a written table: what follows doesn't run it again, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/weftline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` wrote and nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def document_with_key(document: DataFrame, key: str, value: DataFrame, policy: str = "leave") -> DataFrame:
    """(text, action): a one-row JSON document (text) with one top-level key replaced by another one-row document.

    A null document is created with that key alone. One that can't be parsed is left as it is and reported
    (`unparseable`), or with policy `replace` made anew.
    """
    both = document.crossJoin(value.select(F.col("text").alias("new")))
    parsed = F.try_parse_json("text")
    fresh = F.concat(F.lit(f'{{"{key}":'), F.col("new"), F.lit("}"))
    entries = F.expr("cast(v as map<string, variant>)")
    replaced = F.to_json(F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json("new"))))
    fine = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    rows = both.withColumn("v", parsed)
    bad = fresh if policy == "replace" else F.col("text")
    text = F.when(F.col("text").isNull(), fresh).when(fine, replaced).otherwise(bad)
    action = F.when(F.col("text").isNull(), "CREATE").when(fine, "REPLACE KEY").otherwise("REPLACE" if policy == "replace" else "unparseable")
    return rows.select(text.alias("text"), action.alias("action"))


def write_document(document: DataFrame, path: str, *, apply: bool = False) -> dict[str, str]:
    """Writes one small document by a temporary file and a rename; without apply it only says what it would do."""
    rows = document.take(2)
    if len(rows) > 1:
        raise ValueError("more than one document for one path; use write_documents")
    row = rows[0] if rows else None
    if apply and row is not None:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        temporary.write_text(row[0], encoding="utf-8")
        os.replace(temporary, target)
    return {"path": path, "action": "WRITE" if row is not None else "NOTHING", "applied": str(bool(apply and row is not None)).lower()}


def write_documents(rendered: DataFrame, *, apply: bool = False) -> DataFrame:
    """(path, action) of rendered documents (path, text); with apply, each task writes its own documents, folders made first."""
    plan = rendered.select("path", F.lit("WRITE").alias("action"))
    if apply:

        def write(rows) -> None:
            for row in rows:
                target = Path(row.path)
                target.parent.mkdir(parents=True, exist_ok=True)
                temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                temporary.write_text(row.text, encoding="utf-8")
                os.replace(temporary, target)

        rendered.select("path", "text").foreachPartition(write)
    return plan


def delete_plan(orphans: DataFrame, reason: str) -> DataFrame:
    """(path, action, reason): what a deletion would remove; nothing is removed here."""
    return orphans.select("path", F.lit("DELETE").alias("action"), F.lit(reason).alias("reason"))


def status_plan(texts: DataFrame, statuses: DataFrame) -> DataFrame:
    """(path, text, action) of documents (path, text) with the first status line set to that of statuses (path, status); a text without one stays."""
    before = F.regexp_extract("text", r"(?msi)\A(.*?^status:[ \t]*)", 1)
    rest = F.regexp_replace(F.substring("text", F.length(before) + 1, F.length("text")), r"\A[^\n]*", "")
    new = F.when(before == "", F.col("text")).otherwise(F.concat(before, "status", rest))
    return texts.join(statuses, "path").select("path", new.alias("text"), F.when(new == F.col("text"), "KEEP").otherwise("UPDATE").alias("action"))


def append_events(events: DataFrame, folder: str, *, apply: bool = False) -> dict[str, str]:
    """Appends events to a folder of JSON lines; without apply it only says what it would do."""
    if apply:
        events.write.mode("append").json(folder)
    return {"path": folder, "action": "APPEND", "applied": str(apply).lower()}
