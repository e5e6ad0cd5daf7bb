"""Event sequences against a deterministic automaton: the state after each event, and the events that it does not allow."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import written


@dataclass(frozen=True)
class Automaton:
    """Steps (state, symbol) to state. Any other event is illegal and leaves the state as it is."""

    start: str
    steps: Mapping[tuple[str, str], str]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(s for s, _ in self.steps), *self.steps.values()]))

    @property
    def symbols(self) -> list[str]:
        return list(dict.fromkeys(a for _, a in self.steps))

    def table(self) -> np.ndarray:
        """The next state by state and symbol, -1 where there is none; the last column is for unknown symbols."""
        states, symbols = self.states, self.symbols
        out = np.full((len(states), len(symbols) + 1), -1)
        for (s, a), t in self.steps.items():
            out[states.index(s), symbols.index(a)] = states.index(t)
        return out


# Two reviews, the second only after the first has passed; a review that asks for changes is repeated
# before anything else, and one that asks for them later opens its stage again.
REVIEW = Automaton(
    "open",
    {
        ("open", "spec_passed"): "spec_passed", ("open", "spec_changes"): "spec_again",
        ("spec_again", "spec_passed"): "spec_passed", ("spec_again", "spec_changes"): "spec_again",
        ("spec_passed", "spec_passed"): "spec_passed", ("spec_passed", "spec_changes"): "spec_again",
        ("spec_passed", "quality_passed"): "passed", ("spec_passed", "quality_changes"): "quality_again",
        ("quality_again", "quality_passed"): "passed", ("quality_again", "quality_changes"): "quality_again",
        ("passed", "spec_passed"): "passed", ("passed", "quality_passed"): "passed",
        ("passed", "spec_changes"): "spec_again", ("passed", "quality_changes"): "quality_again",
    }
    | {(s, "new_slice"): "open" for s in ("open", "spec_again", "spec_passed", "quality_again", "passed")},
)

# The life of a worktree.
WORKTREE = Automaton(
    "none",
    {
        ("none", "created"): "created",
        ("created", "baseline_passed"): "ready", ("created", "baseline_failed"): "failed",
        ("failed", "baseline_passed"): "ready", ("failed", "baseline_failed"): "failed",
        ("failed", "discarded"): "discarded", ("failed", "kept"): "kept",
        ("ready", "merged"): "merged", ("ready", "discarded"): "discarded", ("ready", "kept"): "kept",
        ("kept", "merged"): "merged", ("kept", "discarded"): "discarded",
        ("merged", "created"): "created", ("discarded", "created"): "created",
    },
)

# A subagent is out from its dispatch until it returns in one of three ways; notes change nothing.
DISPATCH = Automaton(
    "idle",
    {("idle", "dispatched"): "open", ("idle", "note"): "idle", ("open", "note"): "open"} | {("open", s): "idle" for s in ("completed", "blocked", "failed")},
)


def run(events: DataFrame, key: str, order: list[str], symbol: str, automaton: Automaton) -> DataFrame:
    """Events with `before` and `state`, the states around each, `legal`, and `step`, the legal events of its key so far.

    Events are taken in order within their key, which must be unique there; a null key is a key of its own, and unknown
    or null symbols are illegal. They are sorted by ranges, so a key with very many events spans tasks. The state in
    which a task's first key comes in is not known there, so its events carry what follows from every state. What each
    task ends with is one row, and these are put together in order; then every event picks its own.
    """
    names, states, symbols, table = events.columns, automaton.states, automaton.symbols, automaton.table()
    plain = table.tolist()

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, first, last, seq = TaskContext.get().partitionId(), False, True, None, 0
        now, n, state, done = np.arange(len(states)), np.zeros(len(states), np.int64), 0, 0
        for batch in batches:
            codes = pc.fill_null(pc.index_in(batch[symbol].cast(pa.string()), pa.array(symbols, pa.string())), len(symbols)).to_pylist()
            before, after, legal, steps, firsts = [], [], [], [], []
            for k, a in zip(batch[key].to_pylist(), codes, strict=True):
                if not seen:
                    seen, last = True, k
                elif k != last:
                    first, last, state, done = False, k, 0, 0
                firsts.append(first)
                if first:
                    to = table[now, a]
                    fine = to >= 0
                    before.append(now.tolist())
                    now, n = np.where(fine, to, now), n + fine
                    after.append(now.tolist())
                    legal.append(fine.tolist())
                    steps.append(n.tolist())
                    continue
                before.append([state])
                to = plain[state][a]
                if to >= 0:
                    state, done = to, done + 1
                after.append([state])
                legal.append([to >= 0])
                steps.append([done])
            size = batch.num_rows
            more = [pa.array([task] * size, pa.int32()), pa.array(range(seq, seq + size), pa.int64()), pa.array(firsts, pa.bool_()), pa.array(before, pa.list_(pa.int32())), pa.array(after, pa.list_(pa.int32())), pa.array(legal, pa.list_(pa.bool_())), pa.array(steps, pa.list_(pa.int64()))]
            seq += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *added])

    added = ["__task", "__seq", "__first", "__before", "__after", "__legal", "__steps"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    rows = events.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order)
    rows = written(rows.mapInArrow(followed, f"{schema}, __task int, __seq long, __first boolean, __before array<int>, __after array<int>, __legal array<boolean>, __steps array<long>"))
    keyed = F.struct(F.col(key).alias("key"), "__first", "__after", "__steps")
    ends = rows.groupBy("__task").agg(F.min_by(F.col(key), "__seq").alias("first_key"), F.max_by(keyed, "__seq").alias("end")).orderBy("__task").collect()  # a row for each task
    came, previous = [], None
    for r in ends:
        state, n = previous[1:] if previous and previous[0] == r.first_key else (0, 0)
        came.append((r["__task"], state, n))
        i, more = (state, n) if r.end["__first"] else (0, 0)
        previous = (r.end.key, r.end["__after"][i], r.end["__steps"][i] + more)
    incoming = events.sparkSession.createDataFrame(came, "__task int, __state int, __n long")
    rows = rows.join(F.broadcast(incoming), "__task")  # a row for each task
    pick = lambda c: F.col(c)[F.when(F.col("__first"), F.col("__state")).otherwise(0)]
    name = lambda c: F.array(*map(F.lit, states))[pick(c)]
    step = pick("__steps") + F.when(F.col("__first"), F.col("__n")).otherwise(0)
    return rows.select(*[F.col(f"`{c}`") for c in names], name("__before").alias("before"), name("__after").alias("state"), pick("__legal").alias("legal"), step.alias("step"))


def outcomes(ran: DataFrame, key: str, order: list[str], repeats: list[str]) -> DataFrame:
    """(key, state, n_illegal, n_repeats): where each key stands, how many events were illegal, and how many legal ones led to a state of `repeats`."""
    last = F.max_by("state", F.struct(*order)).alias("state")
    return ran.groupBy(key).agg(last, F.count(F.when(~F.col("legal"), 1)).alias("n_illegal"), F.count(F.when(F.col("legal") & F.col("state").isin(repeats), 1)).alias("n_repeats"))


def illegal_runs(ran: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(key, step, state, first, length, symbols): illegal events of a key with no legal one between them, the first one's place in the order, and their different symbols."""
    bad = ran.where(~F.col("legal"))
    return bad.groupBy(key, "step", "state").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set(symbol)).alias("symbols"))
