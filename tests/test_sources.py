"""Readers and plans over small files: each shape that they name, and what is missing or broken."""

import json

import pytest

from weftline.plans import tables
from weftline.sources import readers


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_files_texts_and_hidden_roots(spark, tmp_path):
    root = put(tmp_path / ".tool", a__md="one\ntwo", b__txt="x")
    put(tmp_path / ".tool" / "deep", c__md="three")
    (tmp_path / ".tool" / "a +%41 b.txt").write_text("")
    (tmp_path / ".tool" / "e +%41.md").write_text("")
    (tmp_path / ".tool" / "f +%41.md").write_text("f")
    assert {r.name: bytes(r.content) for r in readers.files(spark, root).collect()} == {"a.md": b"one\ntwo", "b.txt": b"x", "a +%41 b.txt": b"", "e +%41.md": b"", "f +%41.md": b"f"}
    assert {r.name for r in readers.files(spark, root, "*.md", recursive=True).collect()} == {"a.md", "c.md", "e +%41.md", "f +%41.md"}
    assert {r.name: r.text for r in readers.texts(spark, root).collect()} == {"a.md": "one\ntwo", "e +%41.md": "", "f +%41.md": "f"}
    assert readers.files(spark, put(tmp_path / "none")).count() == 0


def test_fragments_come_after_the_main_file_and_by_path(spark, tmp_path):
    main = put(tmp_path / "m", main__json='{"z":1}') + "/main.json"
    folder = put(tmp_path / "parts", b__json='{"b":1}', a__json='{"a":1}', note__txt="no")
    put(tmp_path / "parts" / "sub", c__json='{"c":1}')
    rows = readers.fragments(spark, folder, main).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in rows] == [(1, '{"z":1}'), (2, '{"a":1}'), (3, '{"b":1}'), (4, '{"c":1}')]


def test_tuples_take_the_separator_literally_and_fill_up(spark):
    lines = spark.createDataFrame([("a|b||d",), ("x",), ("",)], "line string")
    assert [tuple(r) for r in readers.tuples(lines, "|", ["p", "q", "r"]).collect()] == [("a", "b", ""), ("x", "", ""), ("", "", "")]


def test_prefixed_files_keep_the_order_of_prefixes(spark, tmp_path):
    root = put(tmp_path, b_2__md="", a_1__md="", a_0__md="", other__md="")
    rows = readers.prefixed(spark, root, ["b_", "a_"]).orderBy("part", "name").collect()
    assert [(r.part, r.name) for r in rows] == [(0, "b_2.md"), (1, "a_0.md"), (1, "a_1.md")]


def test_user_lists_and_expected_paths(spark):
    rows = readers.user_list(spark.createDataFrame([(" a , ,b,zz",)], "line string"), ["a", "b"]).collect()
    assert [(r.position, r.item, r.is_known) for r in rows] == [(0, "a", True), (1, "b", True), (2, "zz", False)]
    manifest = spark.createDataFrame([("one", "p"), ("two", "q"), ("none", None)], "label string, path string")
    listing = spark.createDataFrame([("p",), ("p",), ("r",)], "path string")
    assert {r.label: r.ok for r in readers.path_check(manifest, listing).collect()} == {"one": True, "two": False, "none": False}


def test_handoffs_and_change_files(spark, tmp_path):
    root = put(tmp_path / "h", context_c1__md="# Goal", other__md="x")
    assert [(r.change_id, r.text) for r in readers.handoffs(spark, root).collect()] == [("c1", "# Goal")]
    put(tmp_path / "changes" / "c1" / "specs", s__md="s")
    put(tmp_path / "changes" / "c2", tasks__md="t")
    rows = readers.change_files(spark, str(tmp_path / "changes")).collect()
    assert {(r.change_id, r.artifact) for r in rows} == {("c1", "s.md"), ("c2", "tasks.md")} and "content" not in rows[0].asDict()


def test_manifests_probes_registries_and_settings(spark, tmp_path):
    root = put(tmp_path, m__json='{"items":[1,2],"by":{"a":1},"one":"s","none":[]}', registry__md="# R\n- a \n  * b\n-no\n", c__json='{\n"x": 1, "y": null}')
    assert {r["name"]: r.n for r in readers.manifest_counts(spark, f"{root}/m.json").collect()} == {"items": 2, "by": 1, "one": 1, "none": 0}
    assert {r["name"]: r.present for r in readers.status_probe(spark, root, ["m.json", "gone.json"]).collect()} == {"m.json": True, "gone.json": False}
    assert [(r.line_no, r.entry) for r in readers.registry(spark, f"{root}/registry.md").collect()] == [(1, "a"), (2, "b")]
    (row,) = readers.project_config(spark, f"{root}/c.json", "x int, y string, z string", {"y": "d", "z": "e"}).collect()
    assert tuple(row) == (1, "d", "e")


def test_imported_status_falls_back_to_the_local_one(spark):
    local = spark.createDataFrame([("a", "todo"), ("b", "done"), ("c", None)], "id string, status string")
    provider = spark.createDataFrame([("a", "review"), ("b", None)], "id string, status string")
    rows = {r.id: (r.status, r.fallback_reason is None) for r in readers.imported_status(local, provider).collect()}
    assert rows == {"a": ("review", True), "b": ("done", False), "c": (None, False)}


def test_events_keep_the_order_of_lines(spark, tmp_path):
    lines = [json.dumps({"time": "2026-01-01T00:00:00Z", "changeId": "c", "status": s}) for s in ("z", "a", "m")]
    root = put(tmp_path, c__jsonl="\n".join(lines))
    rows = readers.events(spark, root).orderBy("ord").collect()
    assert [r.status for r in rows] == ["z", "a", "m"] and {r.change_file for r in rows} == {"c.jsonl"}


def test_documents_are_written_only_when_told_to(spark, tmp_path):
    one = spark.createDataFrame([("t",)], "text string")
    path = tmp_path / "new" / "a.txt"
    assert tables.write_document(one, str(path))["applied"] == "false" and not path.exists()
    assert tables.write_document(one, str(path), apply=True)["applied"] == "true" and path.read_text() == "t"
    assert tables.write_document(one.limit(0), str(path), apply=True)["action"] == "NOTHING" and path.read_text() == "t"
    with pytest.raises(ValueError, match="more than one"):
        tables.write_document(one.union(one), str(path))
    many = spark.createDataFrame([(str(tmp_path / "x" / f"{i}.md"), str(i)) for i in range(3)], "path string, text string")
    assert tables.write_documents(many).count() == 3 and not (tmp_path / "x").exists()
    tables.write_documents(many, apply=True)
    assert {p.name: p.read_text() for p in (tmp_path / "x").iterdir()} == {"0.md": "0", "1.md": "1", "2.md": "2"}


def test_plans_of_deletions_statuses_and_events(spark, tmp_path):
    assert [tuple(r) for r in tables.delete_plan(spark.createDataFrame([("p",)], "path string"), "orphan").collect()] == [("p", "DELETE", "orphan")]
    texts = spark.createDataFrame([("a", "# T\nStatus: todo\nbody\nstatus: later"), ("b", "none"), ("c", "status: $1\\x")], "path string, text string")
    wanted = spark.createDataFrame([("a", "do$1ne\\"), ("b", "done"), ("c", "$1\\x")], "path string, status string")
    rows = {r.path: (r.text, r.action) for r in tables.status_plan(texts, wanted).collect()}
    assert rows == {"a": ("# T\nStatus: do$1ne\\\nbody\nstatus: later", "UPDATE"), "b": ("none", "KEEP"), "c": ("status: $1\\x", "KEEP")}
    log, folder = spark.createDataFrame([("c", "done")], "changeId string, status string"), tmp_path / "log"
    assert tables.append_events(log, str(folder))["applied"] == "false" and not folder.exists()
    tables.append_events(log, str(folder), apply=True)
    tables.append_events(log, str(folder), apply=True)
    assert spark.read.json(str(folder)).count() == 2


def test_tasks_skip_fences_and_read_fields(spark):
    text = """# Tasks
```sh
- [ ] X not a task
files: no
```
- [ ] A [AFK] one (blockedBy: B, C)
  - **Acceptance criteria:** it works
  - files: `a.py`, b/c.py
  - Verification command: pytest -q
  ~~~
  - [ ] Y code
  files: wrong
  ~~~
- [x] B [HITL] two
  unblocks: A
- [ ] C
```
- [ ] Z in a fence that nobody closes
"""
    for ends in ("\n", "\r\n", "\r"):
        docs = spark.createDataFrame([("c", text.replace("\n", ends)), ("d", ""), ("e", None)], "change_id string, text string")
        got = [tuple(r)[2:] for r in readers.tasks(docs).orderBy("position").collect()]
        assert got == [
            ("A", False, "AFK", "one", ["B", "C"], [], ["a.py", "b/c.py"], "it works", "pytest -q"),
            ("B", True, "HITL", "two", [], ["A"], [], None, None),
            ("C", False, None, "", [], [], [], None, None),
        ]


def test_texts_have_line_feeds(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"---\r\nname: x\r---\r\nbody\n")
    (row,) = readers.texts(spark, str(tmp_path)).collect()
    assert row.text == "---\nname: x\n---\nbody\n"


def test_stream_and_batch_agree_on_equal_times(spark, tmp_path):
    import json

    from weftline.operators import events
    from weftline.streaming import latest

    log = tmp_path / "log"
    log.mkdir()
    for name in ("c1", "c2"):
        lines = [json.dumps({"time": "2026-01-01T00:00:00Z", "changeId": name, "status": s}) for s in ("kept", "merged", "created", "blocked" if name == "c1" else "started")]
        (log / f"{name}.jsonl").write_text("\n".join([*lines[:2], "broken", *lines[2:]]) + "\n")
    query = latest.to_table(latest.latest_state(latest.event_stream(spark, str(log))), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    streamed = {(r.changeId, r.status) for r in latest.current(spark, str(tmp_path / "out")).collect()}
    rows = readers.events(spark, str(log)).where("changeId is not null")
    batch = {(r.changeId, r.status) for r in events.latest(rows, "changeId", ["time", "change_file", "block", "ord"], ["status"]).collect()}
    assert streamed == batch == {("c1", "blocked"), ("c2", "started")}
