"""Runs and attempts as streams with state of their own: changes as they are asked for, deadlines as they pass.

Each has a batch twin in concord.operators.run_state. Both need the RocksDB state store
(STORE); state and timers live in it, so a query goes on where it was after a restart.
Late events, behind the watermark, are left out where there are deadlines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from concord.operators.lifecycle import STEPS
from concord.operators.run_state import change
from concord.streaming.events import timed

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CHANGES = "run_id {run}, event_id long, told string, state string, previous string, resume_state string, refused long"
ANSWERS = "attempt_id {attempt}, told string, state string, at timestamp"


class RunStates(StatefulProcessor):
    """A run's state and resume target as a value, its refused changes as a list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "state string, resume_state string, refused long")
        self.refused = handle.getListState("refused", "event_id long, state string, previous string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("event_id")
        state, resume, n = self.place.get() if self.place.exists() else ("", None, 0)
        out, refused = [], []
        for event_id, to in zip(asked["event_id"], asked["state"], strict=True):
            led = change(state, resume, to)
            if led is None:
                n += 1
                refused.append((event_id, to, state or None))
                out.append((key[0], event_id, "refused", to, state or None, resume, n))
            else:
                state, resume = led
        if refused:
            self.refused.appendList(refused)
        self.place.update((state, resume, n))
        out.append((key[0], asked["event_id"].iloc[-1], "standing", state or None, None, resume, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def run_states(events: DataFrame) -> DataFrame:
    """A row for each refused change (told: refused) and one for each run that a trigger touched (told: standing), for update mode. events: run_id, event_id, state."""
    kind = events.schema["run_id"].dataType.simpleString()
    rows = events.select("run_id", F.col("event_id").cast("long").alias("event_id"), F.coalesce("state", F.lit("")).alias("state"))
    return rows.groupBy("run_id").transformWithStateInPandas(RunStates(), CHANGES.format(run=kind), "Update", "None")


class Deadlines(StatefulProcessor):
    """An attempt's state as a value, and a timer at the time until which its answer is awaited."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "state string, due long")

    def _expired(self, key, due: int) -> tuple:
        return key[0], "expired", "unknown", pd.Timestamp(due, unit="ms")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, due = self.place.get() if self.place.exists() else ("none", None)
        told, out, timer = pd.concat(list(rows)).sort_values(["told_at", "event_id"]), [], due
        for at, kind in zip(told["told_at"], told["kind"], strict=True):
            now = at.value // 1_000_000
            if state == "dispatched" and now > due:
                out.append(self._expired(key, due))
                state, due = "unknown", None
            to = STEPS.get((state, kind))
            if to is None:
                continue
            state, due = to, now + self.limit if to == "dispatched" else None
            out.append((key[0], kind, state, at))
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.place.update((state, due))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, due = self.place.get()
        if state == "dispatched":
            self.place.update(("unknown", None))
            yield pd.DataFrame([self._expired(key, due)], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


def deadlines(events: DataFrame, limit_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Each change of an attempt's state as it is told or as its deadline passes (told: expired, state: unknown), for update mode. events: attempt_id, event_id, kind, told_at."""
    kind = events.schema["attempt_id"].dataType.simpleString()
    rows = timed(events.select("attempt_id", "event_id", "kind", "told_at"), "told_at", delay)
    return rows.groupBy("attempt_id").transformWithStateInPandas(Deadlines(limit_ms), ANSWERS.format(attempt=kind), "Update", "EventTime")
