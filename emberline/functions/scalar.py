"""Scalar expressions over columns; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = "normal"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# detections


def by_severity(detections: Column | str, severity: str) -> Column:
    """The detections of one severity, in their order."""
    return F.filter(col(detections), lambda d: d["severity"] == severity)


def p_failure(detections: Column | str) -> Column:
    """The largest confidence among catastrophic detections; 0 without any."""
    return F.coalesce(F.array_max(F.transform(by_severity(detections, "catastrophic"), lambda d: d["confidence"])), F.lit(0.0))


def top_detection(detections: Column | str, type_string: str) -> Column:
    """The first catastrophic detection of the largest confidence; null without any."""
    better = lambda best, d: F.when(best.isNull() | (d["confidence"] > best["confidence"]), d).otherwise(best)
    return F.aggregate(by_severity(detections, "catastrophic"), F.lit(None).cast(type_string), better)


def quality_gate(age: Column, luma: Column, blur: Column, max_age: float, min_luma: float, max_luma: float, min_blur: float) -> Column:
    """Why a frame isn't scored, first reason first; null when it passes."""
    return F.when(age > max_age, "stale").when(luma < min_luma, "too_dark").when(luma > max_luma, "too_bright").when(blur < min_blur, "blurred")


def gate_struct(reason: Column) -> Column:
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"))


def is_printing(state: Column | str) -> Column:
    return F.coalesce(col(state) == "printing", F.lit(False))


def binary_label(name: Column | str, normal: str = NORMAL) -> Column:
    return F.when(F.lower(F.trim(col(name))) == normal.strip().lower(), "normal").otherwise("defect")


def label_name(label: Column | str) -> Column:
    """normal or failure; any other label is an error."""
    c = col(label)
    return F.when(c == 0, "normal").when(c == 1, "failure").otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(c.cast("string"), F.lit("null")))))


# probabilities


def argmax(probs: Column | str) -> Column:
    """The 0-based index of the first largest element."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(x: Column | str) -> Column:
    e = F.transform(col(x), lambda v: F.exp(v - F.array_max(col(x))))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def probabilities(raw: Column | str) -> Column:
    """raw itself where it is a distribution already, else its softmax."""
    r = col(raw)
    total = F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
    fine = F.forall(r, lambda v: (v >= -1e-6) & (v <= 1 + 1e-6)) & (F.abs(total - 1) <= 1e-3)
    return F.when(fine, r).otherwise(softmax(r))


def max_abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.array_max(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def arrays_agree(a: Column | str, b: Column | str, atol: float = 1e-4) -> Column:
    return max_abs_diff(a, b) <= atol


def unit_scale(pixels: Column | str) -> Column:
    return F.transform(col(pixels), lambda p: p / F.lit(255.0))


def cosine_schedule(step: Column, total: int, warmup: int, peak: float) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(F.lit(0.5 * peak) * (1 + F.cos(F.lit(3.141592653589793) * F.least(progress, F.lit(1.0)))))


def ema_decay(step: Column, target: float) -> Column:
    return F.least(F.lit(target), (step + 1) / (step + 10))


# hashes


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_hex(h: Column | str) -> Column:
    """A signed 64-bit hash as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(col(h))), 16, "0")


def content_hash(mode: Column | str, height: Column | str, width: Column | str, data: Column | str) -> Column:
    """SHA-256 over pixel type, shape and bytes of a decoded image."""
    shape = F.concat(col(mode).cast("string"), F.lit("|"), col(height).cast("string"), F.lit("x"), col(width).cast("string"), F.lit("|"))
    return F.sha2(F.concat(F.encode(shape, "UTF-8"), col(data)), 256)


# formats


def percent(x: Column | str) -> Column:
    return F.when(col(x).isNull(), "n/a").otherwise(F.format_string("%.1f%%", col(x).cast("double") * 100))


def seconds(x: Column | str) -> Column:
    return F.when(col(x).isNull(), "n/a").otherwise(F.format_string("%.1fs", col(x).cast("double")))


def redacted_url(url: Column | str) -> Column:
    return F.when(F.coalesce(col(url), F.lit("")) == "", "<none>").otherwise(F.concat(F.lit("..."), F.right(col(url), F.lit(6))))


def frame_name(ts: Column | str) -> Column:
    """The file name of an event's frame (UTC session): frame_20260101_010203_004.jpg."""
    return F.concat(F.lit("frame_"), F.date_format(col(ts), "yyyyMMdd_HHmmss_SSS"), F.lit(".jpg"))


def record_name(ts: Column | str) -> Column:
    return F.concat(F.date_format(col(ts), "yyyyMMdd'T'HHmmss_SSS"), F.lit("Z.jpg"))


def notification(event: Column) -> Column:
    """The JSON payload of an event notification."""
    subject = F.coalesce(event["class_name"], event["action"])
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(True).alias("inline"))
    fields = F.array(
        field("Action", event["action"]), field("State", event["state"]), field("Score", F.format_string("%.3f", event["score"])), field("Raw", F.format_string("%.3f", event["p_raw"])),
        field("Votes", event["votes"]), field("File", F.coalesce(event["print_filename"], F.lit("unknown"))), field("Reason", event["reason"]),
    )
    colour = F.when(event["action"].isin("pause", "cancel"), F.lit(0xCC0000)).otherwise(F.lit(0xE6A700))
    stamp = F.date_format(F.timestamp_micros((event["timestamp"] * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    embed = F.struct(F.concat(F.lit("Print alert: "), subject).alias("title"), colour.alias("color"), stamp.alias("timestamp"), fields.alias("fields"))
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def macro_path(macro: Column | str) -> Column:
    """A macro name percent-encoded: spaces as %20."""
    return F.replace(F.url_encode(col(macro)), F.lit("+"), F.lit("%20"))


# drivers' literals


def float_grid(spec: str | None, fallback: list[float]) -> list[float]:
    """Comma-separated numbers; blanks ignored, nothing means the fallback."""
    found = [float(x) for x in re.split(",", spec or "") if x.strip()]
    return found or fallback


def int_grid(spec: str | None, fallback: list[int]) -> list[int]:
    return [int(x) for x in float_grid(spec, [])] or fallback


def mock_scores(spec: str) -> list[float]:
    """Comma-separated scores in 0..1, at least one."""
    found = float_grid(spec, [])
    if not found or any(not 0 <= x <= 1 for x in found):
        raise ValueError(f"scores must be in 0..1 and not empty: {spec!r}")
    return found


def thresholds(start: float, end: float, step: float) -> list[float]:
    """start to end inclusive, to ten decimals."""
    return [round(start + k * step, 10) for k in range(int(round((end - start) / step)) + 1)]


def square_input(shape) -> int | None:
    """The side of a static square model input (N, C, H, W); null otherwise."""
    if shape and len(shape) == 4 and isinstance(shape[2], int) and shape[2] == shape[3] and shape[2] > 0:
        return shape[2]
    return None
