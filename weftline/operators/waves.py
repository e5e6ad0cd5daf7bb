"""Dependency waves, readiness and reach over task graphs given as edges (id, blocker)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, GroupedData, Observation, Window
from pyspark.sql import functions as F

from weftline.plans.tables import dropped, written

#: Steps over a graph that one query takes, where no node has more than HUB strides: behind the first of them, Spark can't
#: split the rows of a node.
AT_ONCE, HUB = 6, 10_000


def waves(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, wave, in_cycle): wave is 1 + the largest wave of a task's blockers; null on and behind a cycle.

    Each round places the tasks whose open blockers are all gone, so it runs once for a level, over the edges that
    are left. Blockers that are no tasks don't block.
    """
    ids = tasks.select("id").distinct()
    left = written(edges.select("id", "blocker").distinct().join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("blocker")), "blocker", "left_semi"))
    open_ids, placed, level = written(ids), None, 0
    while True:
        level += 1
        now = open_ids.join(left.select("id").distinct(), "id", "left_anti").withColumn("wave", F.lit(level))
        now = written(now)
        if now.isEmpty():
            break
        placed = now if placed is None else placed.unionByName(now)
        left = written(left.join(now.select(F.col("id").alias("blocker")), "blocker", "left_anti"))
        open_ids = written(open_ids.join(now.select("id"), "id", "left_anti"))
    behind = open_ids.select("id", F.lit(None).cast("int").alias("wave"), F.lit(True).alias("in_cycle"))
    return behind if placed is None else placed.withColumn("in_cycle", F.lit(False)).unionByName(behind)


def _dealt(table: DataFrame) -> DataFrame:
    """table, to be joined by a shuffle: in loops, tables that go to all executors by way of the driver add up, and Spark judges their size by compressed files."""
    return table.hint("merge")


def _squared(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs two strides apart, without those that lead back or to what was found."""
    first, second = pairs.select("__from", F.col("__to").alias("__by")), pairs.select(F.col("__from").alias("__by"), "__to")
    return first.join(_dealt(second), "__by").where("__from <> __to").select("__from", "__to").distinct().join(_dealt(found.withColumnRenamed("id", "__to")), "__to", "left_anti").select("__from", "__to")


def _squared_size(pairs: DataFrame) -> int:
    """How many rows the join of pairs with themselves gives."""
    ends = _ends(pairs).agg(F.count(F.when(F.col("into"), 1)).alias("a"), F.count(F.when(~F.col("into"), 1)).alias("b"))
    return ends.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def _ends(pairs: DataFrame) -> GroupedData:
    """The ends of pairs by node: `into` are those that lead to it."""
    ends = F.explode(F.array(F.struct(F.col("__to").alias("n"), F.lit(True).alias("into")), F.struct(F.col("__from").alias("n"), F.lit(False).alias("into"))))
    return pairs.select(ends.alias("e")).select("e.n", "e.into").groupBy("n")


def reach(edges: DataFrame, seeds: DataFrame, source: str = "blocker", target: str = "id", growth: float = 4.0) -> DataFrame:
    """(id): the seeds (id) and everything that edges lead to from them. Null ends lead nowhere.

    Strides double: a round goes from all that is found by pairs exactly 1, 2, 4, ... edges apart, so a path of n edges
    takes log2(n) rounds. Where the next pairs would be more than `growth` times the edges, which their degrees tell
    before, doubling ends and rounds go on from the new nodes by all strides there are.
    """
    pairs = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from <> __to").distinct()
    strides = [written(pairs)]
    most = growth * max(1, strides[0].count())
    found = start = written(seeds.select("id").where("id is not null").distinct())
    doubling = True
    while True:
        steps = strides[-1] if doubling else reduce(DataFrame.union, strides)
        new = written(steps.join(_dealt(start.withColumnRenamed("id", "__from")), "__from", "left_semi").select(F.col("__to").alias("id")).distinct().join(_dealt(found), "id", "left_anti"))
        if new.isEmpty():
            dropped(new, *strides)
            return found
        union_rounds, doubling = not doubling, doubling and _squared_size(strides[-1]) <= most
        if doubling:
            strides.append(written(_squared(strides[-1], found)))
        before, found = found, written(found.union(new))
        dropped(before, *([start] if union_rounds and start is not before else []))
        # the first round by all strides goes from everything, since what doubling found has not tried the short ones
        start = new if union_rounds else found
        if not union_rounds:
            dropped(new)


def _strides(pairs: DataFrame, n: int, growth: float) -> tuple[DataFrame, int]:
    """(k, __from, __to): pairs exactly 2^k edges apart, for k up to the number that is returned; until 2^k is n, or the next pairs would be too many."""
    strides, most = [pairs], growth * max(1, pairs.count())
    while 2 ** len(strides) < 2 * n and _squared_size(strides[-1]) <= most:
        first, second = strides[-1].select("__from", F.col("__to").alias("__by")), strides[-1].select(F.col("__from").alias("__by"), "__to")
        strides.append(written(first.join(_dealt(second), "__by").select("__from", "__to").distinct()))
    out = written(reduce(DataFrame.union, [x.select(F.lit(k).alias("k"), "__from", "__to") for k, x in enumerate(strides)]))
    dropped(*strides)
    return out, len(strides) - 1


def _marked(df: DataFrame) -> tuple[DataFrame, dict]:
    """df as a written table, and what tells two such tables apart, which is counted while it is written."""
    mark = Observation()
    out = written(df.observe(mark, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash")))
    return out, mark.get


def _by_strides(start: DataFrame, last: int, step: Callable[[DataFrame, int | None], DataFrame], at_once: int = 1) -> DataFrame:
    """The table that steps by each stride, and then by all of them (None), lead to, once nothing changes any more.

    A value that comes from farther than 2^k edges would have changed something exactly 2^k edges away, so a step
    without a change is the last. So are several steps `at_once`, as no step takes back what another did.
    """
    (now, before), k = _marked(start), 0
    while True:
        steps, old = now, now
        for _ in range(at_once):
            steps, k = step(steps, k if k <= last else None), k + 1
        now, after = _marked(steps)
        dropped(old)
        if after == before:
            return now
        before = after


def components(ids: DataFrame, edges: DataFrame, source: str = "blocker", target: str = "id", growth: float = 4.0) -> DataFrame:
    """(id, component): the strongly connected components of ids and edges between them; component is its smallest id.

    Pairs 1, 2, 4, ... edges apart are made once, while they stay within `growth` times the edges. Nodes that no pair of
    the longest stride starts or ends at are on no cycle, and are components by themselves. The others are coloured: a
    node's colour is the node with the smallest hash among those that reach it. No component lies across two colours,
    and the nodes of a colour that reach the node it is named after are that one's component. What is left of each
    colour is coloured anew; no path leaves it and comes back, so the pairs within it stay right. A round finds a
    component in every colour at once, and colours along a path of components fall apart at random places.
    """
    every = ids.select("id").where("id is not null").distinct()
    pairs = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from <> __to").distinct()
    for end in ("__from", "__to"):
        pairs = pairs.join(_dealt(every.withColumnRenamed("id", end)), end, "left_semi").select("__from", "__to")
    strides, last = _strides(written(pairs), every.count(), growth)
    most = _ends(strides).agg(F.count(F.lit(1)).alias("rows")).agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    at_once = AT_ONCE if most <= HUB else 1
    nodes, done, turn = every, None, 0
    while True:
        longest = strides.where(F.col("k") == last)
        live = written(nodes.join(_dealt(longest.select(F.col("__from").alias("id")).distinct()), "id", "left_semi").join(_dealt(longest.select(F.col("__to").alias("id")).distinct()), "id", "left_semi"))
        among = strides.where("k >= 0").join(_dealt(live.select(F.col("id").alias("__from"))), "__from", "left_semi").join(_dealt(live.select(F.col("id").alias("__to"))), "__to", "left_semi").select("k", "__from", "__to")
        # every step also stands still (-1), so that it keeps what was told before without a second look at it
        old, strides = strides, written(among.union(live.select(F.lit(-1), "id", "id")))
        dropped(old)
        if strides.where("k >= 0").isEmpty():
            break
        of = lambda k: strides if k is None else strides.where(F.col("k").isin(k, -1))  # noqa: B023, E731
        first = live.select("id", F.struct(F.xxhash64("id", F.lit(turn)).alias("hash"), F.col("id").alias("of")).alias("colour"))
        told = lambda t, k: of(k).join(_dealt(t.select(F.col("id").alias("__from"), "colour")), "__from").groupBy(F.col("__to").alias("id")).agg(F.min("colour").alias("colour"))  # noqa: B023, E731
        coloured = _by_strides(first, last, told, at_once)
        colour = lambda end: _dealt(coloured.select(F.col("id").alias(end), F.col("colour.of").alias(f"{end}_of")))  # noqa: B023, E731
        old, strides = strides, written(strides.join(colour("__from"), "__from").join(colour("__to"), "__to").where("__from_of = __to_of").select("k", "__from", "__to"))
        dropped(old)
        back = lambda t, k: of(k).join(_dealt(t.select(F.col("id").alias("__to"))), "__to", "left_semi").select(F.col("__from").alias("id")).distinct()  # noqa: B023, E731
        found = _by_strides(coloured.where("colour.of = id").select("id"), last, back, at_once)
        own = coloured.join(_dealt(found), "id", "left_semi").select("id", F.col("colour.of").alias("of"))
        # written, so that Spark can split a component that holds most rows
        least = written(own.groupBy("of").agg(F.min("id").alias("component")))
        own = written(own.join(_dealt(least), "of").select("id", "component"))
        done = own if done is None else done.unionByName(own)
        nodes = written(live.join(_dealt(own), "id", "left_anti"))
        dropped(live, coloured, found, least)
        turn += 1
    if done is None:
        return every.withColumn("component", F.col("id"))
    return every.join(_dealt(done), "id", "left").withColumn("component", F.coalesce("component", "id"))


def cycles(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cycle_id, on_cycle, behind): the smallest id of a task's cycle or tangle of cycles, and whether a task waits for one without being on it.

    A task that blocks itself is a cycle of one. Blockers that are no tasks don't block.
    """
    ids = written(tasks.select("id").where("id is not null").distinct())
    known = edges.select("id", "blocker").join(_dealt(ids), "id", "left_semi").join(_dealt(ids.withColumnRenamed("id", "blocker")), "blocker", "left_semi").select("id", "blocker").distinct()
    known = written(known)
    found = components(ids, known)
    found = written(found.join(_dealt(known.where("id = blocker").select("id", F.lit(True).alias("own"))), "id", "left"))
    sizes = written(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    on = written(found.join(_dealt(sizes), "component").where("n > 1 or own").select("id", F.col("component").alias("cycle_id")))
    waits = reach(known, on.select("id")).select("id", F.lit(True).alias("waits"))
    rows = ids.join(_dealt(on), "id", "left").join(_dealt(waits), "id", "left")
    on_cycle = F.col("cycle_id").isNotNull()
    return rows.select("id", "cycle_id", on_cycle.alias("on_cycle"), (F.coalesce("waits", F.lit(False)) & ~on_cycle).alias("behind"))


def failed_and_blocked(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed tasks and all that depend on them."""
    return reach(edges, failed)


def impact(edges: DataFrame, of: DataFrame) -> DataFrame:
    """The given nodes and all that depend on them, directly or not."""
    return reach(edges, of)


def needs(edges: DataFrame, of: DataFrame) -> DataFrame:
    """The given nodes and all that they depend on, directly or not."""
    return reach(edges, of, source="id", target="blocker")


def ready(tasks: DataFrame, edges: DataFrame, resolved: DataFrame, label: str | None = None) -> DataFrame:
    """Tasks that are not resolved and whose blockers all are; with a label (AFK, HITL), only those that carry it."""
    tasks = tasks if label is None else tasks.where(F.col("label") == label)
    done = resolved.select("id").distinct()
    blocked = edges.join(done.select(F.col("id").alias("blocker")), "blocker", "left_anti").select("id").distinct()
    return tasks.join(done, "id", "left_anti").join(blocked, "id", "left_anti")


def next_unit(tasks: DataFrame, edges: DataFrame, resolved: DataFrame, order: list[str], label: str | None = None) -> DataFrame:
    """The first ready task, or no row; with a label, the first that carries it. Order by `wave` where tasks have one."""
    return ready(tasks, edges, resolved, label).orderBy(*order).limit(1)


def loop_gate(unit: DataFrame) -> DataFrame:
    """One row: whether a loop goes on, that is whether there is a next unit."""
    return unit.agg((F.count(F.lit(1)) > 0).alias("goes_on"))


def open_blockers(tasks: DataFrame, edges: DataFrame, resolved: DataFrame, label: str) -> DataFrame:
    """(id, blocker): blockers with the label that are not resolved and that an open task waits for."""
    done = resolved.select("id").distinct()
    blockers = tasks.where(F.col("label") == label).select(F.col("id").alias("blocker")).join(done.withColumnRenamed("id", "blocker"), "blocker", "left_anti")
    return edges.join(done, "id", "left_anti").join(blockers, "blocker").select("id", "blocker").distinct()


def inverse_gaps(blocked_by: DataFrame, unblocks: DataFrame) -> DataFrame:
    """(id, blocker, only_in) of edges (id, blocker) that one side states and the other lacks."""
    a, b = blocked_by.select("id", "blocker").distinct(), unblocks.select("id", "blocker").distinct()
    one = a.exceptAll(b).withColumn("only_in", F.lit("blockedBy"))
    return one.unionByName(b.exceptAll(a).withColumn("only_in", F.lit("unblocks")))


def overlaps(owned: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of tasks of (id, file) that own a file together: an equi-join on the file."""
    rows = owned.select("id", "file").distinct()
    pairs = rows.select(F.col("id").alias("a"), "file").join(rows.select(F.col("id").alias("b"), "file"), "file").where("a < b")
    return pairs.select("a", "b").distinct()


def neighbours(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """(before, after): each row's `order` and the next one's in its group, which may be of any size.

    Rows are sorted by ranges, so that a large group spans tasks. Neighbours meet within each part of a group; the parts
    of a group, one row for each task that holds some of it, are then put beside each other.
    """
    key = [*group, "__part"]
    parts = written(rows.select(*group, order).distinct().repartitionByRange(*group, order).withColumn("__part", F.spark_partition_id()))
    inside = parts.select(F.lag(order).over(Window.partitionBy(*key).orderBy(order)).alias("before"), F.col(order).alias("after")).where("before is not null")
    ends = parts.groupBy(*key).agg(F.min(order).alias("after"), F.max(order).alias("last"))
    between = ends.select(F.lag("last").over(Window.partitionBy(*group).orderBy("__part")).alias("before"), "after").where("before is not null")
    return inside.union(between)


def serialised(levels: DataFrame, owned: DataFrame) -> DataFrame:
    """(id, wave, turn): within a wave, a task goes one turn behind the last smaller id that it shares a file with, chain by chain.

    Two tasks of one wave and turn share no file. Only neighbours in a file's order of ids are linked, so a file that
    many tasks own gives a link for each, not for each pair. Only files with several owners are sorted, and only
    tasks with links take part in the rounds. The longest chains are found by strides of 1, 2, 4, ... links, so a file of
    n owners takes log2(n) rounds; where there would be too many pairs, by the strides there are.
    """
    waves_of = written(levels.select("id", "wave").where("id is not null").distinct())
    # a file that one task owns links nothing, and a task without links has the first turn: neither is carried along
    keyed = owned.select("id", "file", F.xxhash64("file").alias("__key"))
    several = keyed.groupBy("__key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("__key")
    shared = keyed.join(several, "__key", "left_semi").join(waves_of, "id")
    links = written(neighbours(shared, ["wave", "file"], "id").select(F.col("before").alias("__from"), F.col("after").alias("__to")).distinct())
    strides, last = _strides(links, waves_of.count(), 4.0)
    of = lambda k: strides if k is None else strides.where(F.col("k") == k)

    def behind(t: DataFrame, k: int | None) -> DataFrame:
        later = of(k).join(_dealt(t.select(F.col("id").alias("__from"), "turn")), "__from").select("__to", F.expr("turn + shiftleft(1L, k)"))
        return t.union(later).groupBy("id").agg(F.max("turn").alias("turn"))

    linked = of(0).select(F.col("__from").alias("id")).union(of(0).select("__to")).distinct()
    turns = _by_strides(linked.select("id", F.lit(1).cast("bigint").alias("turn")), last, behind)
    return waves_of.join(turns, "id", "left").select("id", "wave", F.coalesce("turn", F.lit(1)).cast("bigint").alias("turn"))


def dispatch_gate(tasks: DataFrame, turns: DataFrame, owned: DataFrame, limit: int) -> DataFrame:
    """(id, wave, turn, failed, passed) of tasks (id, goal, output, packet) that shall run side by side.

    The rules of parallel dispatch: a `goal` and an `output` that no other task of the wave and turn has, a `packet` of
    at most `limit` characters, and `ownership` of at least one file. Nulls fail; failed lists the rules that a task
    breaks, in this order.
    """
    owns = owned.select("id", F.lit(True).alias("__owns")).distinct()
    rows = tasks.select("id", "goal", "output", (F.length("packet") <= limit).alias("__short")).join(turns, "id").join(owns, "id", "left")
    rows = every = written(rows)
    for c in ("goal", "output"):
        counts = every.where(F.col(c).isNotNull()).groupBy("wave", "turn", c).agg(F.count(F.lit(1)).alias(f"__{c}s"))
        rows = rows.join(written(counts), ["wave", "turn", c], "left")
    rules = {"goal": F.col("__goals") == 1, "output": F.col("__outputs") == 1, "packet": F.col("__short"), "ownership": F.col("__owns")}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return rows.select("id", "wave", "turn", failed.alias("failed")).withColumn("passed", F.size("failed") == 0)


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that more than one row has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wave_summary(levels: DataFrame, tasks: DataFrame) -> DataFrame:
    """(wave, n_tasks, n_failed, all_verified) of levels (id, wave) and tasks (id, verified); a null counts as not verified."""
    fine = F.coalesce(F.col("verified"), F.lit(False))
    return levels.join(tasks.select("id", "verified"), "id").groupBy("wave").agg(F.count(F.lit(1)).alias("n_tasks"), F.count(F.when(~fine, 1)).alias("n_failed"), F.bool_and(fine).alias("all_verified"))


def in_dependency_order(levels: DataFrame, items: DataFrame, position: str = "position") -> DataFrame:
    """Items (id, position, ...) with their wave, sorted by wave and then by their own position; those in a cycle come last."""
    return items.join(levels.select("id", "wave"), "id").orderBy(F.col("wave").asc_nulls_last(), position)


def communities(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(id, community) by weighted label propagation over undirected edges (a, b, weight), in a fixed number of rounds.

    Every node starts as its own community. In each round all nodes at once take the label with the largest total weight
    among their neighbours and themselves, their own counting as much as their heaviest edge; ties go to the smallest
    label. Parallel edges add up; loops and null ends are left out. Weights are summed as decimals, so that the order of
    the sums doesn't matter, and before each shuffle.
    """
    weight = F.sum(F.col("weight").cast("decimal(20,6)")).cast("decimal(20,6)").alias("weight")
    pairs = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(weight)
    pairs = written(pairs)
    # whole millionths where no sum of weights can leave 64 bits: their sums are the same, and take a fraction of the time
    if pairs.agg(F.coalesce(F.sum(F.abs(F.col("weight"))), F.lit(0)) < 10**12).first()[0]:
        pairs = pairs.select("a", "b", (F.col("weight") * 1_000_000).cast("bigint").alias("weight"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").union(pairs.select("b", "a", "weight"))
    own = written(both.groupBy("id").agg(F.max("weight").alias("weight")))
    labels = own.select("id", F.col("id").alias("community"))
    for i in range(rounds):
        # at first every neighbour has a label of its own, so there is nothing to join or to add up
        if i == 0:
            total = both.select("id", F.col("other").alias("community"), "weight").union(own.select("id", F.col("id").alias("community"), "weight"))
        else:
            heard = both.join(labels.withColumnRenamed("id", "other"), "other").select("id", "community", "weight").union(own.join(labels, "id").select("id", "community", "weight"))
            total = heard.groupBy("id", "community").agg(F.sum("weight").alias("weight"))
        labels = written(total.groupBy("id").agg(F.min_by("community", F.struct(-F.col("weight"), "community")).alias("community")))
    return labels
