"""Carrying out plans: files are written beside their place by tasks and moved there when all tasks have ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a plan's actions do to the file of their path; others do nothing.
WRITES, DELETES = ("COPY", "UPDATE", "WRITE"), ("DELETE",)


@dataclass
class Staged(WriterCommitMessage):
    """What one task has prepared: (path, staged file) of files to move, and paths to delete."""

    files: list[tuple[str, str]]
    deletes: list[str]


def _inside(path: str) -> str:
    parts = path.split("/")
    if not path or path.startswith("/") or ".." in parts or "" in parts:
        raise ValueError(f"{path!r} is no path below the root")
    return path


class PlanWriter(DataSourceWriter):
    """Writes rows (path, action, content) below a root; nothing there changes before every task has ended."""

    def __init__(self, root: str):
        self.root, self.staging = root.rstrip("/"), f".staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = self._open()
        files, deletes = [], []
        for row in iterator:
            if row.action in WRITES:
                staged = f"{self.staging}/{uuid.uuid4().hex}"
                if not files:
                    system.create_dir(f"{root}/{self.staging}", recursive=True)
                with system.open_output_stream(f"{root}/{staged}") as out:
                    out.write(bytes(row.content))
                files.append((_inside(row.path), staged))
            elif row.action in DELETES:
                deletes.append(_inside(row.path))
        return Staged(files, deletes)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._open()
        made = set()
        for message in filter(None, messages):
            for path, staged in message.files:
                folder = f"{root}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(f"{root}/{staged}", f"{root}/{path}")
        for message in filter(None, messages):
            for path in message.deletes:
                if system.get_file_info(f"{root}/{path}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{path}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes what was prepared, by failed tasks and second attempts too."""
        system, root = self._open()
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class PlanSource(DataSource):
    """The sink `weftline_plan`, with the option root: a URI that pyarrow can open on every executor."""

    @classmethod
    def name(cls) -> str:
        return "weftline_plan"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PlanWriter(self.options["root"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlanSource)


def apply_plan(plan: DataFrame, root: str) -> None:
    """Carries out a plan (path, action, content): COPY, UPDATE and WRITE put the content at the path, DELETE removes the file, other actions keep it.

    Paths are relative; one that leaves the root fails the plan, and then nothing has changed. Files are moved one by
    one at the end, so a reader may see some of them before the others; each is whole. A plan may be applied again.
    """
    register(plan.sparkSession)
    rows = plan.select("path", "action", F.col("content").cast("binary").alias("content")).where(F.col("action").isin(*WRITES, *DELETES))
    rows.write.format("weftline_plan").mode("append").option("root", root).save()
