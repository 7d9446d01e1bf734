"""From frames to decisions: gate, score what passes, join the print's state, decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.images import measures
from ..functions.scalar import p_failure, quality_gate
from ..operators.decision import gate_reason, rate_limited
from ..operators.detections import Detector, classified, scored


def gated(frames: DataFrame, s: Settings, now: Column) -> DataFrame:
    """frames (image, ts) with luma, blur and quality, the reason that a frame isn't scored; late frames are kept and marked."""
    q = s.quality
    rows = frames.withColumn("__m", measures("image"))
    reason = quality_gate(now - F.col("ts"), F.col("__m.luma"), F.col("__m.blur"), q.max_frame_age_s, q.min_mean_luma, q.max_mean_luma, q.min_blur_var)
    return rows.withColumn("luma", F.col("__m.luma")).withColumn("blur", F.col("__m.blur")).withColumn("quality", reason).drop("__m")


def with_state(frames: DataFrame, states: DataFrame, key: str = "trace_id") -> DataFrame:
    """Each frame with the latest state at or before it; null fields where none came yet. states: key, ts, state, filename, elapsed_s."""
    fields = ["state", "filename", "elapsed_s"]
    kinds = {f.name: f.dataType for f in states.schema.fields}
    pad = frames.select("*", *[F.lit(None).cast(kinds[f]).alias(f) for f in fields], F.lit(1).alias("__kind"))
    both = pad.unionByName(states.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("__kind") == 0, F.struct(*fields)), ignorenulls=True).over(w)
    out = both.withColumn("__s", latest).where("__kind = 1")
    return out.select(*[c for c in frames.columns], *[F.col(f"__s.{f}").alias(f) for f in fields])


def polled(ticks: DataFrame, key: str, seconds: str, interval: float) -> DataFrame:
    """Which ticks poll the state: the first, and each after the interval since the last poll."""
    return rate_limited(ticks.withColumn("__order", F.col(seconds)), key, "__order", seconds, interval).drop("__order").withColumnRenamed("sent", "polls")


def ticks(frames: DataFrame, s: Settings, make: Callable[[], Detector], classes: list[str], now: Column, key: str = "trace_id") -> DataFrame:
    """The decision operator's input, from frames (key, tick, ts, image, state, filename, elapsed_s). Only frames that pass and print are scored."""
    rows = gated(frames, s, now)
    reason = gate_reason(F.col("state"), F.col("elapsed_s"), F.col("quality").isNull(), F.col("quality"), s.decision.warmup_s)
    rows = rows.withColumn("gate_reason", reason).withColumn("gated", F.col("gate_reason").isNotNull())
    done = scored(rows, make, F.col("quality").isNull() & (F.col("state") == "printing"))
    d = s.detector
    found = classified("probs", classes, dict(d.class_thresholds), d.default_threshold, dict(d.severity), F.col("image.width"), F.col("image.height"))
    with_found = done.withColumn("detections", F.when(F.col("probs").isNotNull(), found))
    return with_found.select(key, "tick", "ts", F.when(F.col("probs").isNotNull(), p_failure("detections")).otherwise(0.0).alias("p_raw"), "gated", "gate_reason", "state", "filename", "detections")


def recorded(frames: DataFrame, interval_s: float, printing_only: bool = True, most: int | None = None) -> DataFrame:
    """One frame per interval (the first of each), only while printing if asked, up to the most; frames: ts, state and more."""
    rows = frames.where(F.col("state") == "printing") if printing_only else frames
    slot = F.floor(F.col("ts") / interval_s)
    first = F.row_number().over(Window.partitionBy("__slot").orderBy("ts"))
    out = rows.withColumn("__slot", slot).withColumn("__first", first).where("__first = 1").drop("__slot", "__first").orderBy("ts")
    return out.limit(most) if most is not None else out


def recording_counts(frames: DataFrame, saved: DataFrame) -> DataFrame:
    """One row: saved, skipped_not_printing, skipped_no_frame (rows without a frame)."""
    counts = frames.agg(F.count_if(F.col("state") != "printing").alias("skipped_not_printing"), F.count_if(F.col("image").isNull()).alias("skipped_no_frame"))
    return saved.agg(F.count(F.lit(1)).alias("saved")).join(F.broadcast(counts))
