"""The decision operator: smoothed score, K-of-N votes, runs, edges, cooldown.

`Machine` is the fold; `decide` applies it to every key of a table of ticks, or
every key and configuration of a grid. `votes_and_runs` gives the parts that
don't depend on the cooldown as window functions; tests hold one against the other.

A gated tick is reported but changes nothing, so votes and runs go on across it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Decision
from ..schemas import TERMINAL_STATES
from .fold import ordered_fold

DECIDED = "action string, state string, score double, votes int, consecutive int, level string, gated boolean"


def clamped(action: str, mode: str) -> str:
    """What the mode lets an action become."""
    if mode == "notify_only" and action in ("pause", "cancel"):
        return "notify"
    return "pause" if mode == "pause" and action == "cancel" else action


def clamp(action: Column, mode: Column | str) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    lowered = F.when((mode == "notify_only") & action.isin("pause", "cancel"), "notify").when((mode == "pause") & (action == "cancel"), "pause")
    return F.coalesce(lowered, action)


def gate_reason(state: Column, elapsed: Column, passed: Column, reason: Column, warmup: Column | float) -> Column:
    """Why a tick isn't scored: not_printing, warmup or quality:<reason>; null when it is."""
    return (
        F.when(state.isNull() | (state != "printing"), "not_printing").when(elapsed < warmup, "warmup").when(~passed, F.concat(F.lit("quality:"), F.coalesce(reason, F.lit(""))))
    )


def identity_reset(state: Column, filename: Column, before_state: Column, before_filename: Column) -> Column:
    """Whether a print ended or another began between two consecutive snapshots (null states: no snapshot)."""
    seen = state.isNotNull() & before_state.isNotNull()
    other = filename.isNotNull() & before_filename.isNotNull() & (filename != before_filename)
    return F.coalesce(seen & (F.coalesce(other, F.lit(False)) | ((before_state == "printing") & state.isin(*TERMINAL_STATES))), F.lit(False))


class Machine:
    """The operator's state for one key; `tick` returns one row of DECIDED."""

    def __init__(self, c: Decision):
        self.c, self.before = c, None
        self.reset()

    def reset(self) -> None:
        self.state, self.score, self.latch, self.until, self.clear = "idle", 0.0, False, 0.0, 0
        self.window: deque[bool] = deque(maxlen=max(1, self.c.window))
        self.runs = {"warn": 0, "pause": 0, "cancel": 0}

    def identity(self, state: str | None, filename: str | None) -> None:
        """Reset at a new print; what was seen last is kept even where it is nothing."""
        now = None if state is None else (state, filename)
        if self.before and now:
            renamed = self.before[1] is not None and filename is not None and self.before[1] != filename
            if renamed or (self.before[0] == "printing" and state in TERMINAL_STATES):
                self.reset()
        self.before = now

    def tick(self, p: float, now: float, gated: bool) -> tuple:
        c = self.c
        if gated:
            return "none", self.state, self.score, sum(self.window), 0, None, True
        self.score = c.ema_alpha * p + (1.0 - c.ema_alpha) * self.score
        self.window.append(p > c.vote_threshold)
        votes = sum(self.window)
        ok = {k: self.score > getattr(c, f"{k}_score") and votes >= getattr(c, f"{k}_votes") for k in self.runs}
        for k in self.runs:
            self.runs[k] = self.runs[k] + 1 if ok[k] else 0
        edge, self.latch = ok["warn"] and not self.latch, ok["warn"]
        if self.state == "cooldown":
            self.clear = self.clear + 1 if self.score < c.clear_score else 0
            if now < self.until or self.clear < c.clear_ticks:
                return "none", "cooldown", self.score, votes, self.runs["pause"], None, False
        level = None
        if c.cancel_enabled and self.runs["cancel"] >= c.cancel_consecutive:
            level = "cancel"
        elif self.runs["pause"] >= c.pause_consecutive:
            level = "pause"
        if level:
            self.state, self.until, self.clear = "cooldown", now + c.cooldown_s, 0
            return clamped(level, c.action_mode), "triggered", self.score, votes, self.runs[level], level, False
        self.state = "warning" if ok["warn"] else "armed"
        return ("notify" if edge else "none"), self.state, self.score, votes, self.runs["warn"], None, False


def decide(ticks: DataFrame, configs: Mapping[str, Decision], key: str = "trace_id") -> DataFrame:
    """ticks: key, tick, ts (seconds), p_raw, gated, and state and filename of the print. One row for each tick and configuration."""
    machines = dict(configs)

    def start():
        kept = {name: Machine(c) for name, c in machines.items()}

        def step(row: tuple) -> Iterator[tuple]:
            trace, tick, ts, p, gated, state, filename = row
            for name, m in kept.items():
                m.identity(state, filename)
                yield (trace, name, tick, ts, p, *m.tick(p, ts, gated))

        return step

    kind = ticks.schema[key].dataType.simpleString()
    return ordered_fold(ticks, [key], ["tick", "ts"], ["tick", "ts", "p_raw", "gated", "state", "filename"], start, f"{key} {kind}, config string, tick long, ts double, p_raw double, {DECIDED}")


def ema(p: str, alpha: float, order: str, key: str, df: DataFrame) -> DataFrame:
    """key, order column, p and score, the exponential mean that starts from 0."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def start():
        score = [0.0]

        def step(row: tuple) -> Iterator[tuple]:
            score[0] = alpha * row[2] + (1.0 - alpha) * score[0]
            yield (*row, score[0])

        return step

    return ordered_fold(df, [key], [order], [order, p], start, f"{key} {kind[key]}, {order} {kind[order]}, {p} double, score double")


def epochs(df: DataFrame, key: str, order: str, state: str, filename: str) -> DataFrame:
    """df with epoch, the number of identity resets so far."""
    w = Window.partitionBy(key).orderBy(order)
    reset = identity_reset(F.col(state), F.col(filename), F.lag(state).over(w), F.lag(filename).over(w))
    return df.withColumn("__reset", reset.cast("int")).withColumn("epoch", F.sum("__reset").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__reset")


def votes_and_runs(scored: DataFrame, c: Decision, keys: list[str], order: str) -> DataFrame:
    """scored rows (score, p_raw; gated ones left out) with votes, the three levels' runs, and notify_edge."""
    w = Window.partitionBy(*keys).orderBy(order)
    votes = F.sum((F.col("p_raw") > c.vote_threshold).cast("int")).over(w.rowsBetween(1 - max(1, c.window), 0))
    out = scored.withColumn("votes", votes.cast("int"))
    for level in ("warn", "pause", "cancel"):
        ok = (F.col("score") > getattr(c, f"{level}_score")) & (F.col("votes") >= getattr(c, f"{level}_votes"))
        out = run_length(out.withColumn(f"{level}_ok", ok), f"{level}_ok", keys, order, f"{level}_run")
    return out.withColumn("notify_edge", F.col("warn_ok") & ~F.lag("warn_ok", 1, False).over(w))


def run_length(df: DataFrame, flag: str, keys: list[str], order: str, name: str) -> DataFrame:
    """How many consecutive rows, this one included, have the flag."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("__island", F.sum((~F.col(flag)).cast("int")).over(w))
    inside = Window.partitionBy(*keys, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(name, F.sum(F.col(flag).cast("int")).over(inside).cast("int")).drop("__island")


def rate_limited(df: DataFrame, key: str, order: str, seconds: str, interval: float) -> DataFrame:
    """df's key, order and seconds with sent: false where less than the interval has passed since the last row that was sent."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def start():
        last: list[float | None] = [None]

        def step(row: tuple) -> Iterator[tuple]:
            sent = last[0] is None or row[2] - last[0] >= interval
            if sent:
                last[0] = row[2]
            yield (*row, sent)

        return step

    return ordered_fold(df, [key], [order], [order, seconds], start, f"{key} {kind[key]}, {order} {kind[order]}, {seconds} double, sent boolean")
