"""Graph operators against plain walks: rounds, cycles, hot nodes."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import waves


def graph(spark, edges, tasks=()):
    ids = sorted({x for e in edges for x in e if x is not None} | set(tasks))
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "id long, blocker long")


def reached(edges, seeds):
    out, stack = set(seeds), list(seeds)
    onwards = {}
    for i, b in edges:
        onwards.setdefault(b, []).append(i)
    while stack:
        for n in onwards.get(stack.pop(), []):
            if n is not None and n not in out:
                out.add(n)
                stack.append(n)
    return out


def strong(edges, ids):
    of = {i: reached(edges, [i]) for i in ids}
    return {i: min(j for j in of[i] if i in of[j]) for i in ids}


@pytest.fixture()
def rounds(monkeypatch):
    seen = []

    def counted(df):
        seen.append(1)
        return real(df)

    real = waves.written
    monkeypatch.setattr(waves, "written", counted)
    return seen


def test_a_chain_of_two_thousand_takes_few_rounds(spark, rounds):
    edges = [(i + 1, i) for i in range(2000)]
    _, frame = graph(spark, edges)
    got = waves.reach(frame, spark.createDataFrame([(3,)], "id long"))
    assert {r.id for r in got.collect()} == set(range(3, 2001))
    assert len(rounds) <= 2 + 3 * 12  # each round writes what is new, what is found and the next pairs


@pytest.mark.parametrize("growth", [0.0, 1.0, 4.0])
@pytest.mark.parametrize("seed", range(3))
def test_reach_on_random_graphs(spark, growth, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(100 + i, 99 + i) for i in range(20)] + [(r.randrange(60), 7) for _ in range(30)] + [(None, 7), (7, None)]
    _, frame = graph(spark, edges)
    seeds = [7, 99, 500]
    got = waves.reach(frame, spark.createDataFrame([(i,) for i in [*seeds, 7, None]], "id long"), growth=growth)
    assert sorted(x.id for x in got.collect()) == sorted(reached(edges, seeds))


@pytest.mark.parametrize("seed", range(2))
def test_components_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(50 + i, 50 + (i + 1) % 12) for i in range(12)] + [(70, 51), (71, 70), (72, 72), (73, 72), (80, 999)]
    tasks, frame = graph(spark, edges[:-1], [80, 81])
    ids = [x.id for x in tasks.collect()]
    frame = frame.union(spark.createDataFrame([(80, 999)], "id long, blocker long"))
    known = [e for e in edges if e[1] != 999]
    want = strong(known, ids)
    assert {x.id: x.component for x in waves.components(tasks, frame).collect()} == want
    size = {c: list(want.values()).count(c) for c in want.values()}
    on = {i for i in ids if size[want[i]] > 1 or (i, i) in known}
    waits = reached(known, on)
    got = {x.id: (x.cycle_id, x.on_cycle, x.behind) for x in waves.cycles(tasks, frame).collect()}
    assert got == {i: (want[i] if i in on else None, i in on, i in waits and i not in on) for i in ids}


def test_no_edges(spark):
    tasks, frame = graph(spark, [], [1, 2])
    assert {tuple(x) for x in waves.cycles(tasks, frame).collect()} == {(1, None, False, False), (2, None, False, False)}
    assert waves.cycles(tasks.where("false"), frame).collect() == []


@pytest.mark.parametrize("hub", [0, 10_000])
def test_loops_over_graphs_send_no_tables_by_way_of_the_driver(spark, monkeypatch, hub):
    plans, real = [], waves.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(waves, "written", seen)
    monkeypatch.setattr(waves, "HUB", hub)
    edges = [(i, (i + 1) % 9) for i in range(9)] + [(20 + i, 20 + (i + 1) % 3) for i in range(3)] + [(30, 4), (31, 30), (21, 31), (3, 40), (50, 50)]
    tasks, frame = graph(spark, edges)
    got = {x.id: (x.cycle_id, x.on_cycle, x.behind) for x in waves.cycles(tasks, frame).collect()}
    want = strong(edges, got)
    on = {*range(9), 20, 21, 22, 50}
    assert got == {i: (want[i] if i in on else None, i in on, i in {30, 31}) for i in {x for e in edges for x in e}}
    assert not [p for p in plans if "Broadcast" in p]


def test_tasks_that_share_no_file_have_the_first_turn(spark):
    levels, owned = spark.createDataFrame([(1, 1), (2, 1)], "id long, wave int"), spark.createDataFrame([(1, "a"), (2, "b")], "id long, file string")
    assert {tuple(x) for x in waves.serialised(levels, owned).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_a_hot_file_is_dealt_turns_in_few_rounds(spark, rounds):
    r = random.Random(5)
    owned = [(i, "hot") for i in range(400)] + [(i, f"f{r.randrange(900)}") for i in range(600) for _ in range(2)] + [(0, None)]
    levels = [(i, i % 2) for i in range(600)]
    turns = {x.id: (x.wave, x.turn) for x in waves.serialised(spark.createDataFrame(levels, "id long, wave int"), spark.createDataFrame(owned, "id long, file string")).collect()}
    want, last = {}, {}
    for i in range(600):
        files = {f for o, f in owned if o == i}
        want[i] = (i % 2, 1 + max((last.get((i % 2, f), 0) for f in files), default=0))
        last.update({(i % 2, f): want[i][1] for f in files})
    assert turns == want and max(t for _, t in turns.values()) >= 200
    assert len({(f, *turns[i]) for i, f in set(owned) if f}) == len({(i, f) for i, f in owned if f})
    assert len(rounds) < 60


def test_only_shared_files_are_sorted_and_only_linked_tasks_walk(spark, monkeypatch):
    seen = {}

    def ordered(rows, group, order):
        seen["sorted"] = {(x.id, x.file) for x in rows.collect()}
        return neighbours(rows, group, order)

    def stepped(start, last, step):
        seen["walked"] = {x.id for x in start.collect()}
        return by_strides(start, last, step)

    neighbours, by_strides = waves.neighbours, waves._by_strides
    monkeypatch.setattr(waves, "neighbours", ordered)
    monkeypatch.setattr(waves, "_by_strides", stepped)
    owned = [(i, f"own{i}") for i in range(300)] + [(i, "both") for i in (3, 4, 8, 8)] + [(i, None) for i in (8, 10, 11)] + [(i, "once") for i in (20, 21)]
    levels = spark.createDataFrame([(i, i % 2) for i in range(300)], "id long, wave int")
    turns = {x.id: x.turn for x in waves.serialised(levels, spark.createDataFrame(owned, "id long, file string")).collect()}
    assert turns == {i: {8: 2, 10: 3}.get(i, 1) for i in range(300)}
    assert seen == {"sorted": {(4, "both"), (8, "both"), (8, None), (10, None), (3, "both"), (11, None), (20, "once"), (21, "once")}, "walked": {4, 8, 10}}


def test_the_dispatch_gate_reads_its_tasks_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = [(1, "g", "a", "ok"), (2, "g", "b", "ok"), (3, "h", None, "ok"), (4, None, "b", "too long"), (5, "i", "c", None), (6, None, "d", "ok")]
    tasks = spark.createDataFrame(rows, "id long, goal string, output string, packet string").withColumn("output", F.udf(seen, "string")("output"))
    turns = spark.createDataFrame([(i, 1, 2 if i == 4 else 1) for i in range(1, 7)], "id long, wave int, turn long")
    owned = spark.createDataFrame([(i, "f") for i in (1, 2, 3, 4, 5, 5)], "id long, file string")
    got = {x.id: (x.failed, x.passed) for x in waves.dispatch_gate(tasks, turns, owned, 4).collect()}
    want = {1: ["goal"], 2: ["goal"], 3: ["output"], 4: ["goal", "packet"], 5: ["packet"], 6: ["goal", "ownership"]}
    assert got == {i: (f, not f) for i, f in want.items()}
    assert read.value == len(rows)


def test_communities_against_a_loop(spark):
    r = random.Random(9)
    edges = [(a, b, r.randint(1, 3) / 2) for _ in range(150) for a, b in [(r.randrange(30), r.randrange(30))] if r.random() < (0.9 if a // 10 == b // 10 else 0.1)] + [(5, 5, 9.0), (None, 1, 1.0)]
    near = {}
    for a, b, w in edges:
        if a is not None and a != b:
            near.setdefault(a, {}).update({b: near.get(a, {}).get(b, 0) + w})
            near.setdefault(b, {}).update({a: near.get(b, {}).get(a, 0) + w})
    label = {i: i for i in near}
    for _ in range(3):
        votes = {i: {label[i]: max(near[i].values())} for i in near}
        for i in near:
            for j, w in near[i].items():
                votes[i][label[j]] = votes[i].get(label[j], 0) + w
        label = {i: min(v, key=lambda c: (-v[c], c)) for i, v in votes.items()}
    frame = spark.createDataFrame(edges, "a long, b long, weight double").repartition(3)
    assert {x.id: x.community for x in waves.communities(frame, 3).collect()} == label


def test_communities_with_weights_beyond_whole_millionths_of_64_bits(spark):
    edges = [(1, 2, 3.0), (2, 3, 1.5), (3, 4, 2.5), (4, 1, 0.5)]
    got = [{tuple(x) for x in waves.communities(spark.createDataFrame([(a, b, w * f) for a, b, w in edges], "a long, b long, weight double"), 2).collect()} for f in (1, 10**13)]
    assert got[0] == got[1]
