"""Plans carried out on real folders: the difference is gone afterwards, and a failed task leaves nothing."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import mirror
from weftline.plans import apply, tables
from weftline.sources import readers


def listing(spark, root):
    rows = readers.files(spark, str(root), recursive=True)
    return rows.select(F.regexp_replace("path", rf"^file:/*{root}/".replace("//", "/"), "").alias("name"), "content")


@pytest.mark.parametrize("delete", [True, False])
def test_a_sync_that_is_applied_leaves_no_difference(spark, tmp_path, delete):
    source, copy = tmp_path / "source", tmp_path / "copy"
    for folder, files in ((source, {"a.md": b"1", "d/b.md": b"22", "d/e/c.md": b"\xff\x00", "same.md": b"="}), (copy, {"same.md": b"=", "d/b.md": b"old", "gone/x.md": b"?"})):
        for name, content in files.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(content)
    mine, other = listing(spark, source), listing(spark, copy)
    plan = mirror.sync_plan(mine, other, delete=delete)
    actions = {r.name: r.action for r in plan.collect()}
    assert actions["a.md"] == "COPY" and actions["d/b.md"] == "UPDATE" and actions["gone/x.md"] == ("DELETE" if delete else "KEEP")
    full = plan.select(F.col("name").alias("path"), "action").join(mine.withColumnRenamed("name", "path"), "path", "left")
    full = tables.written(full)  # or applying it again would read the changed folder
    apply.apply_plan(full.repartition(3), copy.as_uri())
    after = {p.relative_to(copy).as_posix(): p.read_bytes() for p in copy.rglob("*") if p.is_file()}
    want = {p.relative_to(source).as_posix(): p.read_bytes() for p in source.rglob("*") if p.is_file()}
    assert after == (want if delete else want | {"gone/x.md": b"?"})
    assert not list(copy.glob(".staging-*"))
    apply.apply_plan(full, copy.as_uri())  # again: the same
    assert {p.relative_to(copy).as_posix() for p in copy.rglob("*") if p.is_file()} == set(after)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = [("a", "WRITE", b"1"), ("b", "DELETE", None), ("../c", "WRITE", b"2")]
    (tmp_path / "b").write_bytes(b"kept")
    plan = spark.createDataFrame(rows, "path string, action string, content binary").repartition(3)
    with pytest.raises(Exception, match="no path below the root"):
        apply.apply_plan(plan, tmp_path.as_uri())
    assert [p.name for p in tmp_path.iterdir()] == ["b"] and (tmp_path / "b").read_bytes() == b"kept"


def test_an_empty_plan(spark, tmp_path):
    apply.apply_plan(spark.createDataFrame([], "path string, action string, content binary"), tmp_path.as_uri())
    assert list(tmp_path.iterdir()) == []


def test_uninstall(spark, tmp_path):
    for name in (".cursor/a.json", ".cursor/d/b.md", "openspec/x", "own/y", ".cursorrules", "sub/.cursor/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    paths = spark.createDataFrame([(p.relative_to(tmp_path).as_posix(),) for p in tmp_path.rglob("*") if p.is_file()], "path string")
    managed = spark.createDataFrame([("cursor", ".cursor", True), ("kilo", ".kilo", True), ("openspec", "openspec", False), ("gitnexus", ".gitnexus", False), ("other", "own", True), ("again", ".cursor", False)], "target string, folder string, reported boolean")
    chosen = spark.createDataFrame([(t,) for t in ("cursor", "kilo", "openspec", "gitnexus", "again")], "target string")
    plan = mirror.uninstall_plan(managed, chosen, paths)
    assert {tuple(r) for r in plan.collect()} == {(".cursor", "REMOVE", 2), (".kilo", "SKIP", 0), ("openspec", "REMOVE", 1)}
    apply.apply_plan(mirror.uninstall_files(plan, paths), tmp_path.as_uri())
    assert {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()} == {"own/y", ".cursorrules", "sub/.cursor/z"}
