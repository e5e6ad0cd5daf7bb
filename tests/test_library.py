import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import board, census, config_merge, documents, events, frontmatter, mirror, waves
from weftline.plans import tables
from weftline.sources import readers
from weftline.streaming import latest

MAIN = {"mcpServers": {"a": {"command": "x", "args": [1, 2], "env": {"P": "1", "Q": "2"}}, "b": {"url": "u", "headers": None}}, "other": 1}
NEXT = {"a": {"args": [9], "env": {"Q": "3"}}, "$schema": "s", "c": {"command": "k", "url": "u", "args": False}, "d": {"serverUrl": "z"}}


def fragments(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "ord long, text string")


def merged(spark, *docs):
    return {r.server: json.loads(r["def"]) for r in config_merge.merged(fragments(spark, *docs)).collect()}


def test_merge_is_deep_ordered_and_replaces_arrays(spark):
    out = merged(spark, MAIN, NEXT)
    assert out["a"] == {"command": "x", "args": [9], "env": {"P": "1", "Q": "3"}}
    assert set(out) == {"a", "b", "$schema", "c", "d"} and out["$schema"] == "s"
    assert merged(spark, {"a": {"x": 1}}, {"a": 5}, {"a": {"y": 2}})["a"] == {"y": 2}
    assert [r.server for r in config_merge.server_names(fragments(spark, MAIN, NEXT)).orderBy("rank").collect()] == ["d", "c", "b", "a", "$schema"]


def fold(left, right):
    if isinstance(left, dict) and isinstance(right, dict):
        return left | {k: fold(left[k], v) if k in left else v for k, v in right.items()}
    return right


def test_merge_equals_a_fold(spark):
    r = random.Random(7)

    def value(depth):
        kind = r.random()
        if depth < 4 and kind < 0.6:
            return {r.choice('abc"\u00e9.$'): value(depth + 1) for _ in range(r.randint(0, 3))}
        return r.choice([None, True, False, 0, 1.5, "", "x/\u00e9\n\"{", [], [{"z": None, "a": [1]}], "{}", {}, -7])

    docs = [{"mcpServers": {s: value(1) for s in r.sample(["s", "t", "u v", "}{"], r.randint(0, 3))}, "x": 1} for _ in range(60)]
    want = {}
    for d in docs:
        want = fold(want, d["mcpServers"])
    rows = config_merge.merged(fragments(spark, *docs)).orderBy("ord").collect()
    assert json.dumps({x.server: json.loads(x["def"]) for x in rows}) == json.dumps(want)  # with the order of members
    assert config_merge.merged(fragments(spark, {"mcpServers": {}})).collect() == []
    assert config_merge.merged(spark.createDataFrame([], "ord long, text string")).collect() == []
    (row,) = config_merge.merged(fragments(spark, {"z": {"b": 1, "a": {"d": 1, "c": 2}}}, {"z": {"a": {"e": [2, 1]}, "0": {}}})).collect()
    assert row["def"] == '{"b":1,"a":{"d":1,"c":2,"e":[2,1]},"0":{}}'


def test_merge_runs_no_python(spark):
    defs = config_merge.merged(fragments(spark, MAIN, NEXT))
    plan = config_merge.emitted(defs, "cursor")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "collect_list" not in plan


def test_filter_before_merge_equals_filter_after(spark):
    keep = spark.createDataFrame([("a",)], "server string")
    (row,) = config_merge.merged(fragments(spark, MAIN, NEXT), keep).collect()
    assert json.loads(row["def"]) == merged(spark, MAIN, NEXT)["a"]


def test_fragment_that_is_no_object_fails(spark):
    with pytest.raises(Exception, match="not an object"):
        config_merge.merged(fragments(spark, MAIN, [1])).collect()


def test_shapes(spark):
    defs = config_merge.merged(fragments(spark, MAIN, NEXT))
    shape = lambda t: {r.server: json.loads(r["shape"]) for r in config_merge.emitted(defs, t).collect()}
    assert shape("cursor")["b"] == {"url": "u", "headers": None}
    assert shape("vscode")["c"] == {"type": "stdio", "command": "k", "args": []}
    assert shape("opencode")["a"] == {"enabled": True, "type": "local", "command": ["x", 9], "environment": {"P": "1", "Q": "3"}}
    assert shape("antigravity")["d"] == {"serverUrl": "z"}
    (doc,) = config_merge.document(config_merge.emitted(defs, "vscode"), "vscode").collect()
    assert list(json.loads(doc.document)["servers"]) == ["a", "b", "$schema", "c", "d"] and doc.n_servers == 5


def test_front_matter_contract_and_renderings(spark):
    texts = [("none", "body"), ("skill-a", "---\ndescription: a: b\ndescription: c:d\nno colon\ntools: Bash, WebFetch\n---\n# Goal\n"), ("open", "---\nname: x\n---")]
    docs = frontmatter.parsed(spark.createDataFrame(texts, "name string, text string"))
    rows = {r.name: r for r in docs.collect()}
    assert rows["skill-a"].fields == {"description": "c:d", "tools": "Bash, WebFetch"} and rows["skill-a"].body == "# Goal\n"
    assert rows["none"].body == "body" and not rows["none"].has_header and rows["open"].has_header
    bad = {r.name: (r.missing_fields, r.missing_sections) for r in frontmatter.contract(docs, ["description", "name"], ["# Goal", "# End"]).collect()}
    assert bad["skill-a"] == (["name"], ["# End"])
    agents = {r.name: r.rendered for r in frontmatter.agent_text(docs).collect()}
    assert agents["none"] == "body" and "  bash: allow" in agents["skill-a"] and "  webfetch: allow" in agents["skill-a"]
    prompts = frontmatter.parsed(spark.createDataFrame(texts, "name string, text string"), frontmatter.PROMPT)
    assert {r.name: r.severity for r in frontmatter.prompt_text(prompts).collect()} == {"none": 2, "skill-a": 0, "open": 2}


def test_mirror_sync_then_diff_is_empty(spark):
    a = spark.createDataFrame([("x", b"1"), ("y", b"2")], "name string, content binary")
    b = spark.createDataFrame([("y", b"3"), ("skill-z", b"4"), ("own", b"5")], "name string, content binary")
    assert {r.name: r.action for r in mirror.sync_plan(a, b, delete=True).collect()} == {"x": "COPY", "y": "UPDATE", "skill-z": "DELETE", "own": "DELETE"}
    assert [r.name for r in mirror.orphans(b, a, prefixes=["skill-"]).collect()] == ["skill-z"]
    assert {r.action for r in mirror.drift(a, a).collect()} == {"OK"}


def test_waves_ready_cycles_and_serialising(spark):
    tasks = spark.createDataFrame([(i,) for i in "ABCDXYZ"], "id string")
    edges = spark.createDataFrame([("C", "A"), ("C", "B"), ("D", "C"), ("X", "Y"), ("Y", "X"), ("Z", "X")], "id string, blocker string")
    out = {r.id: r.wave for r in waves.waves(tasks, edges).collect()}
    assert out == {"A": 1, "B": 1, "C": 2, "D": 3, "X": None, "Y": None, "Z": None}
    done = spark.createDataFrame([("A",), ("B",)], "id string")
    assert [r.id for r in waves.ready(tasks, edges, done).collect()] == ["C"]
    assert {r.id for r in waves.failed_and_blocked(edges, spark.createDataFrame([("A",)], "id string")).collect()} == {"A", "C", "D"}
    levels = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "id string, wave int")
    owned = spark.createDataFrame([("A", "f"), ("B", "f"), ("C", "f")], "id string, file string")
    assert {r.id: r.turn for r in waves.serialised(levels, owned).collect()} == {"A": 1, "B": 2, "C": 1}


def test_census_and_board(spark):
    deps = spark.createDataFrame([("a", "b1", "", "", True), ("c", "", "p", "n", False), ("d", "", "", "", None)], "name string, brew string, pip string, npm string, present boolean")
    assert {r.state: r.n for r in census.counts(deps).collect()} == {"installed": 1, "missing": 1}
    assert {r.manager: r.packages for r in census.package_lists(deps, "install").collect()} == {"brew": ["b1"], "pip": ["p"], "manual": ["d"]}
    assert {r.manager for r in census.package_lists(deps).collect()} == {"brew", "npm", "manual"}
    items = spark.createDataFrame([("r.1.1", True), ("r.1.2", False), ("r.2", True)], "id string, done boolean")
    assert {r.ancestor: (r.n, r.n_done) for r in board.rollup(items, "id", "done").collect()}["r.1"] == (2, 1)


def test_documents_with_a_key(spark):
    value = spark.createDataFrame([('{"s":1}',)], "text string")
    for old, policy, action, want in [('{"a":2,"mcp":{"t":1}}', "leave", "REPLACE KEY", {"a": 2, "mcp": {"s": 1}}), (None, "leave", "CREATE", {"mcp": {"s": 1}}), ("// no", "leave", "unparseable", None), ("// no", "replace", "REPLACE", {"mcp": {"s": 1}})]:
        (r,) = tables.document_with_key(spark.createDataFrame([(old,)], "text string"), "mcp", value, policy).collect()
        assert r.action == action and (r.text == old if want is None else json.loads(r.text) == want)


def test_readers_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [{"time": f"2026-01-01T00:00:0{i}Z", "changeId": "c1", "status": s} for i, s in enumerate(["dispatched", "blocked", "completed"])]
    (log / "c1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    e = readers.events(spark, str(log))
    assert len(e.where("_corrupt_record is not null").collect()) == 1
    (last,) = events.latest(e.where("changeId is not null"), "changeId", ["time"], ["status"]).collect()
    assert last.status == "completed"
    query = latest.to_table(latest.latest_state(latest.event_stream(spark, str(log))), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["completed"]
    (tmp_path / "prd").mkdir()
    (tmp_path / "prd" / "PRD01_first.md").write_text("# T\nStatus: todo\n")
    (prd,) = readers.prds(spark, str(tmp_path / "prd")).collect()
    assert (prd.prd_id, prd.slug, prd.status) == ("01", "first", "todo")
    docs = spark.createDataFrame([("c", "# Tasks\n- [ ] A [AFK] one\n- [x] B [HITL] two (blockedBy: A, C)\n")], "change_id string, text string")
    assert [(r.id, r.done, r.label, r.blockedBy) for r in readers.tasks(docs).orderBy("position").collect()] == [("A", False, "AFK", []), ("B", True, "HITL", ["A", "C"])]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "z.json").write_text('{"a":1}')
    assert [r.ord for r in readers.fragments(spark, str(tmp_path / "f")).collect()] == [1]


def test_gates(spark):
    rows = board.failed_rules(spark.createDataFrame([(1, None)], "a int, b string"), {"a": "a = 1", "b": "b = 'x'"}).collect()
    assert rows[0].failed == ["b"] and not rows[0].passed
    allowed = spark.createDataFrame([(None, "created"), ("created", "merged")], "before string, after string")
    log = spark.createDataFrame([(1, "k", "created"), (2, "k", "kept")], "t int, k string, status string")
    assert [r.status for r in events.illegal_jumps(log, "k", ["t"], "status", allowed).collect()] == ["kept"]
    assert events.durations(log.withColumn("t", F.to_timestamp(F.lit("2026-01-01"))), "k", ["t"]).count() == 2


def test_documents(spark):
    text = "# Handoff\n## Goal\nship\nit\n### Next action\n\n## Empty\n"
    (r,) = documents.sections(spark.createDataFrame([(text,)], "text string"), {"goal": "goal", "next": "Next action", "empty": "Empty", "none": "None"}).collect()
    assert (r.goal, r.next, r.empty, r.none) == ("ship\nit", "", "", None)
    (r,) = documents.labelled(spark.createDataFrame([("x\n* **Accepted** : yes \nAccepted: no",)], "text string"), {"accepted": "accepted", "other": "other"}).collect()
    assert (r.accepted, r.other) == ("yes", None)
    index = spark.createDataFrame([("i", "| PRD02_b-c.md | x |\nno\n- PRD01_a.md")], "path string, text string")
    assert [(r.position, r.prd_id, r.slug) for r in documents.prd_index(index).orderBy("position").collect()] == [(0, "02", "b-c"), (2, "01", "a")]
    tasks, context = spark.createDataFrame([(1, "t", "x"), (2, "u", "y")], "c int, id string, goal string"), spark.createDataFrame([(1, "g")], "c int, goal string")
    assert {(r.packet.task.id, r.packet.task.goal, r.packet.context.goal) for r in documents.packets(tasks, context, "c").collect()} == {("t", "x", "g"), ("u", "y", None)}
    levels = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "id string, wave int")
    items = spark.createDataFrame([("a", 0, True), ("b", 1, None), ("c", 2, True)], "id string, position int, verified boolean")
    assert [r.id for r in waves.in_dependency_order(levels, items).collect()] == ["b", "a", "c"]
    assert {r.wave: (r.n_tasks, r.n_failed, r.all_verified) for r in waves.wave_summary(levels, items).collect()}[1] == (1, 1, False)


def test_top_per_query_against_all_pairs(spark):
    import numpy as np

    from weftline.operators import search

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).astype("f4")
    x[200:220] = x[7]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 5), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [1.0, 2.0]), (904, [2.0, 4.0]), (905, [float("nan")] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>").repartition(3)
    ids = [0, 7, 100, 205, 900, 901, 904]
    found = search.top_per_query(frame, frame.where(F.col("vec_id").isin(ids)), "vec_id", "e", 8, rows=64, asked=2)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    fine = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    for q in ids:
        got = [(r.hit, round(r.score, 6)) for r in found.where(F.col("query") == q).orderBy("rank").collect()]
        if q not in fine:
            assert got == []
            continue
        a = fine[q]
        score = {i: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) for i, b in fine.items() if len(b) == len(a)}
        assert got == [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda t: (-t[1], t[0]))[:8]]
    assert search.top_per_query(frame.where("false"), frame, "vec_id", "e", 3).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_spelling_against_all_pairs(spark, most):
    from weftline.operators import search

    r = random.Random(most)
    words = ["billing", "billings", "checkout", "inventory", "api", "app", "release-1", "release-2", "z\u00fcrich", "billing portal"]
    names = []
    for _ in range(700):
        w = r.choice(words)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("xq") + w[i:], w[:i] + "q" + w[i + 1 :]]) or w
        names.append(r.choice([w, w.upper(), f"  {w}\t"]))
    names += [None, None, "", "  "]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    counts = {}
    for n in names:
        k = None if n is None else n.strip(" \t\n").lower()
        counts[k] = counts.get(k, 0) + 1
    digits = lambda x: [c for c in x if c.isdigit()]
    near = {a: [b for b in counts if a and b and a != b and min(len(a), len(b)) >= 4 and digits(a) == digits(b) and distance(a, b) <= most] for a in counts}
    assert sorted(tuple(x) for x in search.near_names(frame.select(F.lower(F.trim(F.regexp_replace("name", "\\s+$", ""))).alias("name")).where("name is not null"), "name", most).collect()) == sorted((a, b) for a in near for b in near[a] if a < b)

    def top(a):
        above = [b for b in near[a] if counts[b] > counts[a] or (counts[b] == counts[a] and b < a)]
        return top(min(above, key=lambda b: (-counts[b], b))) if above else a

    assert {x.name: (x.canonical, x.n) for x in search.spelled_alike(frame, "name", most).collect()} == {a: (top(a), n) for a, n in counts.items()}
