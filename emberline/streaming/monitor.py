"""The decision operator as a stream: the same machine, kept as state for each print."""

from __future__ import annotations

import dataclasses
import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Decision
from ..operators.decision import DECIDED, Machine


def packed(m: Machine) -> str:
    """A machine's state as JSON."""
    return json.dumps([m.state, m.score, list(m.window), m.runs, m.latch, m.until, m.clear, m.before])


def unpacked(text: str, c: Decision) -> Machine:
    m = Machine(c)
    m.state, m.score, window, m.runs, m.latch, m.until, m.clear, before = json.loads(text)
    m.window = deque(window, maxlen=max(1, c.window))
    m.before = tuple(before) if before else None
    return m


def decide_stream(ticks: DataFrame, config: Decision, key: str = "trace_id") -> DataFrame:
    """ticks (key, tick, ts, p_raw, gated, state, filename) with decisions, row by row in the order of tick within a micro-batch.

    Rows of one key must come in order across micro-batches; a restart goes on from the checkpointed state.
    """
    kind = ticks.schema[key].dataType.simpleString()
    settings = dataclasses.replace(config)

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = unpacked(state.get[0], settings) if state.exists else Machine(settings)
        rows = pd.concat(list(parts)).sort_values(["tick", "ts"])
        out = []
        for r in rows.itertuples(index=False):
            text = lambda x: None if x is None or x != x else x
            m.identity(text(r.state), text(r.filename))
            out.append((keys[0], r.tick, r.ts, r.p_raw, *m.tick(r.p_raw, r.ts, bool(r.gated))))
        state.update((packed(m),))
        yield pd.DataFrame(out, columns=[key, "tick", "ts", "p_raw", *[x.split()[0] for x in DECIDED.split(", ")]])

    return ticks.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, tick long, ts double, p_raw double, {DECIDED}", "machine string", "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(events: DataFrame, key: str, seconds: str, interval: float) -> DataFrame:
    """key, seconds and sent, anchored at the last event that was sent."""
    kind = events.schema[key].dataType.simpleString()

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(seconds)
        sent = []
        for s in rows[seconds]:
            sent.append(last is None or s - last >= interval)
            if sent[-1]:
                last = s
        state.update((last,))
        yield pd.DataFrame({key: keys[0], seconds: rows[seconds].to_numpy(), "sent": sent})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {seconds} double, sent boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def stale(frame_ts: Column, now: Column, max_age_s: float) -> Column:
    """Late frames are marked, not dropped."""
    return now - frame_ts > max_age_s


class Actions:
    """A foreachBatch sink: log the acting rows, then notify, then pause or cancel; a dry run only logs.

    Rows of a micro-batch are taken in order of time. A failing step doesn't stop the others.
    """

    def __init__(self, path: str, notify: Callable[[dict], bool], pause: Callable[[], bool], cancel: Callable[[], bool], dry_run: bool = False, every: int = 100, prune: Callable[[], int] | None = None):
        self.path, self.notify, self.pause, self.cancel, self.dry, self.every, self.prune, self.batches = path, notify, pause, cancel, dry_run, every, prune, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        acting = batch.where(F.col("action") != "none")
        acting.write.mode("append").json(f"{self.path}/batch={batch_id}")
        if not self.dry:
            for row in acting.orderBy("ts", "tick").toLocalIterator():
                self._one(row.asDict())
        self.batches += 1
        if self.prune and self.batches % self.every == 0:
            self.prune()

    def _one(self, row: dict) -> None:
        steps = [lambda: self.notify(row)] + {"pause": [self.pause], "cancel": [self.cancel]}.get(row["action"], [])
        for step in steps:
            try:
                step()
            except OSError:
                pass


def monitor(ticks: DataFrame, config: Decision, sink: Actions, checkpoint: str, interval_s: float = 1.0):
    """Start the live query; missed intervals are skipped, not made up for."""
    decided = decide_stream(ticks, config)
    return decided.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{interval_s} seconds").start()
