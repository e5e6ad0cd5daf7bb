"""Automata over event sequences against a plain loop, with keys that span tasks."""

import random
from collections import Counter, defaultdict

import pytest

from weftline.operators import automaton
from weftline.operators.automaton import REVIEW, WORKTREE, Automaton


def plain(rows, machine):
    out, state, steps = [], defaultdict(lambda: machine.start), Counter()
    for k, t, a in sorted(rows, key=lambda r: r[1]):
        to = machine.steps.get((state[k], a))
        before, state[k] = state[k], to or state[k]
        steps[k] += to is not None
        out.append((k, t, a, before, state[k], to is not None, steps[k]))
    return Counter(out)


@pytest.mark.parametrize("machine", [REVIEW, WORKTREE, Automaton("x", {("x", "a"): "y", ("y", "a"): "x"})])
def test_against_a_loop(spark, machine):
    r = random.Random(2)
    keys = ["hot"] * 30 + ["a", "b", "", None, "z"]
    symbols = [*machine.symbols, *machine.symbols, "other", None]
    rows = [(r.choice(keys), i, r.choice(symbols)) for i in range(3000)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, t long, a string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the few rows meet in one task
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ran = automaton.run(frame, "k", ["t"], "a", machine)
        assert ran.columns == ["k", "t", "a", "before", "state", "legal", "step"]
        got = ran.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(rows, machine)
    assert Counter(map(tuple, got)) == want
    outcomes = {x.k: x for x in automaton.outcomes(ran, "k", ["t"], ["spec_again", "kept", "y"]).collect()}
    for k in set(keys):
        own = sorted((x for x in want if x[0] == k), key=lambda x: x[1])
        assert (outcomes[k].state, outcomes[k].n_illegal) == (own[-1][4], sum(not x[5] for x in own))
        assert outcomes[k].n_repeats == sum(x[5] and x[4] in ("spec_again", "kept", "y") for x in own)
    runs = automaton.illegal_runs(ran, "k", ["t"], "a").collect()
    expected = Counter((x[0], x[6]) for x in want if not x[5])
    assert Counter({(x.k, x.step): x.length for x in runs}) == expected


def test_a_later_review_counts(spark):
    rows = [("c", i, a) for i, a in enumerate(["spec_passed", "quality_passed", "spec_changes", "quality_passed"])]
    ran = automaton.run(spark.createDataFrame(rows, "k string, t long, a string"), "k", ["t"], "a", REVIEW)
    (end,) = automaton.outcomes(ran, "k", ["t"], ["spec_again"]).collect()
    assert (end.state, end.n_illegal, end.n_repeats) == ("spec_again", 1, 1)


def test_no_events(spark):
    ran = automaton.run(spark.createDataFrame([], "k string, t long, a string"), "k", ["t"], "a", REVIEW)
    assert ran.collect() == [] and automaton.outcomes(ran, "k", ["t"], []).collect() == []


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(1, 1, "created", "x"), (1, 2, "merged", "y")], "k int, t int, a string, note string")
    out = automaton.run(rows, "k", ["t"], "a", WORKTREE).orderBy("t").collect()
    assert [(r.state, r.legal, r.note) for r in out] == [("created", True, "x"), ("created", False, "y")]
