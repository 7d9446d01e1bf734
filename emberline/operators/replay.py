"""Replay of recorded traces through the decision operator, roll-up and grid sweep."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Decision
from .decision import decide


def grid(base: Decision, pause_scores: Iterable[float], pause_votes: Iterable[int], alphas: Iterable[float]) -> dict[str, Decision]:
    """Configurations by a name that sorts in grid order (outermost first)."""
    cells = itertools.product(pause_scores, pause_votes, alphas)
    return {f"{k:05d}": dataclasses.replace(base, pause_score=s, pause_votes=v, ema_alpha=a) for k, (s, v, a) in enumerate(cells)}


def recorded(ticks: DataFrame, key: str = "trace_id", warmup: float = 180.0) -> DataFrame:
    """Tick records as the operator's input: always printing one file, time measured from the first record."""
    first = ticks.groupBy(key).agg(F.min_by("timestamp", "tick").alias("first_ts"))
    passed = F.coalesce("gate_passed", F.lit(True))
    elapsed = F.col("timestamp") - F.col("first_ts")
    return ticks.join(first, key).select(key, "tick", F.col("timestamp").alias("ts"), "p_raw", (~passed | (elapsed < warmup)).alias("gated"), F.lit("printing").alias("state"), F.lit("calibration").alias("filename"))


def judged(decided: DataFrame, onset: Column, key: str = "trace_id") -> DataFrame:
    """Per trace and configuration: ticks, duration, actions, false positives (actions before the onset, all if it is null), detection and its delay.

    onset is an expression over decided rows; a trace whose onset tick is missing can be detected without a delay.
    """
    acted = F.col("action") != "none"
    rows = decided.withColumn("onset", onset.cast("long"))
    early = F.col("onset").isNull() | (F.col("tick") < F.col("onset"))
    first_hit = F.min(F.when(acted & ~early, F.struct("tick", "ts")))
    out = rows.groupBy(key, "config").agg(
        F.count(F.lit(1)).alias("n_ticks"), (F.max("ts") - F.min("ts")).alias("duration_s"), F.count_if(acted).alias("n_actions"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("notify", "pause", "cancel")],
        F.count_if(acted & early).alias("false_positives"), first_hit.alias("hit"), F.max(F.when(F.col("tick") == F.col("onset"), F.col("ts"))).alias("onset_ts"), F.max("onset").alias("onset"),
    )
    detected = F.when(F.col("onset").isNotNull(), F.col("hit").isNotNull())
    return out.withColumn("detected", detected).withColumn("time_to_detect_s", F.col("hit.ts") - F.col("onset_ts")).drop("hit", "onset_ts", "onset")


def rolled_up(traces: DataFrame) -> DataFrame:
    """Per configuration: totals, false positives per hour (0 without hours), mean delay and share of detections."""
    hours = F.sum("duration_s") / 3600
    return traces.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_traces"), F.sum("n_ticks").alias("total_ticks"), hours.alias("total_hours"), F.sum("n_actions").alias("total_actions"),
        *[F.sum(f"n_{a}").alias(f"n_{a}") for a in ("notify", "pause", "cancel")],
        F.sum("false_positives").alias("false_positives"), F.coalesce(F.try_divide(F.sum("false_positives").cast("double"), F.when(hours > 0, hours)), F.lit(0.0)).alias("fp_per_hour"),
        F.avg("time_to_detect_s").alias("mean_time_to_detect_s"), F.avg(F.col("detected").cast("double")).alias("detected_fraction"),
    )


def by_type(rolled: DataFrame) -> DataFrame:
    """The roll-up with actions_by_type, a map of the actions that occurred."""
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("k"), F.col(f"n_{a}").alias("v")) for a in ("notify", "pause", "cancel")]), lambda x: x["v"] > 0)
    return rolled.withColumn("actions_by_type", F.map_from_entries(pairs))


def best(rolled: DataFrame) -> DataFrame:
    """The configuration with the fewest false positives per hour, then the shortest delay, then the first of the grid."""
    return rolled.orderBy(F.asc("fp_per_hour"), F.asc_nulls_last("mean_time_to_detect_s"), F.asc("config")).limit(1)


def replay(ticks: DataFrame, configs: dict[str, Decision], onset: Column, key: str = "trace_id") -> DataFrame:
    warmup = next(iter(configs.values())).warmup_s
    return judged(decide(recorded(ticks, key, warmup), configs, key), onset, key)
