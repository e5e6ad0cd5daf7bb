"""Automata over event streams: the state of each key now, from events that come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.automaton import Automaton

#: The store that keeps states of several columns; set it before a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SETTLED = "state string, n_legal long, n_illegal long"
HELD = "time timestamp, place string, symbol string"


class Following(StatefulProcessor):
    """Per key: how far its settled events have come, and the events that earlier ones may still overtake.

    Events settle when the watermark has passed them, in the order of time and then of their place in the log. What is
    told of a key counts its open events too, as if no earlier one came any more.
    """

    def __init__(self, machine: Automaton):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.held = handle.getListState("held", HELD)

    def _follow(self, at: tuple[str, int, int], events: list[tuple]) -> tuple[str, int, int]:
        state, legal, illegal = at
        for _, _, symbol in events:
            to = self.machine.steps.get((state, symbol))
            state, legal, illegal = to or state, legal + (to is not None), illegal + (to is None)
        return state, legal, illegal

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        at = tuple(self.settled.get()) if self.settled.exists() else (self.machine.start, 0, 0)
        events = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        for frame in rows:
            events += list(frame[["time", "place", "symbol"]].itertuples(index=False, name=None))
        # an event that comes twice, as when a source is read again, counts once
        events = sorted({(pd.Timestamp(t).to_pydatetime(), p, s) for t, p, s in events}, key=lambda e: e[:2])
        passed = timer_values.getCurrentWatermarkInMs()
        old = [e for e in events if e[0].timestamp() * 1000 <= passed]
        now = events[len(old) :]
        at = self._follow(at, old)
        self.settled.update(at)
        if now:
            self.held.put(now)
        else:
            self.held.clear()
        state, legal, illegal = self._follow(at, now)
        last = events[-1][0] if events else None
        yield pd.DataFrame({"key": [key[0]], "time": [last], "state": [state], "n_legal": [legal], "n_illegal": [illegal], "n_held": [len(now)]})

    def close(self) -> None:
        pass


def followed(events: DataFrame, machine: Automaton, late: str) -> DataFrame:
    """(key, time, state, n_legal, n_illegal, n_held) of each key that a batch brings events of, from a stream (key, time, place, symbol).

    place orders events of one time, as a file and an offset in it do. Events may come up to `late` behind the latest
    time seen; later ones are dropped, as Spark drops them. So over any split into batches within that, the last row
    of a key is what a batch run over all its events gives. n_held are events that are not settled yet.
    """
    rows = events.withWatermark("time", late).where(F.col("key").isNotNull())
    schema = "key string, time timestamp, state string, n_legal long, n_illegal long, n_held long"
    return rows.groupBy("key").transformWithStateInPandas(Following(machine), schema, "Update", "EventTime")
