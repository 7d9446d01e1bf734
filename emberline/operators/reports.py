"""Composite evaluations: several tables from one set of scored rows, and their JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalar import argmax, binary_label, thresholds
from . import detections, metrics


def _rows(df: DataFrame) -> list[dict]:
    """A short table as rows; the tables of a report have a row per class, source or threshold."""
    return [r.asDict(recursive=True) for r in df.collect()]


def classifier_report(scored: DataFrame, classes: list[str], positive: str, target: float = 0.95, min_recall: float = 0.05, step: float = 0.05, preferred: list[str] | None = None, compared: tuple[str, ...] | None = None) -> dict:
    """Everything about rows (image_id, y_true, probs, source): accuracy, classes, binary view, sweep, sources and verdicts.

    The model's class order is that of `classes`; the report uses the preferred order where it names the same classes. The recall gap is that of the compared sources, by
    default all known ones.
    """
    k = detections.class_index(classes, positive)
    order = detections.report_order(classes, preferred or classes)
    rows = scored.withColumn("k", argmax("probs")).withColumn("y_pred", F.get(F.lit(classes), F.col("k"))).withColumn("is_argmax", F.col("k") == k).withColumn("prob", F.get("probs", F.lit(k))).cache()
    try:
        defect = lambda c: binary_label(F.col(c)) == "defect"
        points = metrics.sweep(rows, thresholds(step, 1 - step, step), F.col("y_true") == positive).cache()
        by_source = metrics.recall_by(rows.where(F.col("y_true") == positive), "source", F.col("y_pred") == positive)
        known = by_source.where(F.col("source").isin(*compared) if compared else F.col("source") != "unknown")
        gap = metrics.recall_range(known)
        lowest = metrics.lowest_threshold(points, target, min_recall)
        verdict = gap.join(by_source.agg(F.count(F.lit(1)).alias("n"))).join(lowest)
        return {
            "class_order": order,
            "top1": metrics.top1(rows).first()["accuracy"],
            "confusion": _rows(metrics.confusion(rows, order)),
            "per_class": _rows(metrics.per_class(rows, order)),
            "macro_f1": metrics.macro_f1(rows, order).first()["macro_f1"],
            "binary": _rows(metrics.binary(rows, defect("y_true"), defect("y_pred")))[0],
            "sweep": _rows(points.orderBy("threshold")),
            "lowest_threshold": _rows(lowest)[0],
            "best_point": _rows(metrics.best_point(points, min_recall))[0],
            "recall_by_source": _rows(by_source.orderBy("source")),
            "recall_gap": gap.first()["gap"],
            "gap_size": verdict.select(metrics.gap_size(F.col("gap"), F.col("n")).alias("v")).first()["v"],
            "fit_for_pausing": verdict.select(metrics.fit_for_pausing(F.col("threshold"), F.col("gap")).alias("v")).first()["v"],
        }
    finally:
        rows.unpersist()


LOW_PHOTOS, LOW_GROUPS, LEAST_IMAGES = 50, 50, 20


def detector_report(curves: DataFrame, instances: DataFrame, groups: DataFrame, classes: list[str], severities: dict[str, str], target: float = 0.95, min_recall: float = 0.05, step: float = 0.05) -> DataFrame:
    """One row per class: support, whether it is low, its severity (cosmetic where unknown), and the first threshold that reaches the target.

    curves: class, px, precision, recall (arrays over ascending confidence). instances: class, image, photo. groups: image, group.
    """
    spark = curves.sparkSession
    points = curves.select("class", F.posexplode(F.arrays_zip("px", "precision", "recall")).alias("pos", "p")).select("class", F.col("p.px").alias("x"), F.col("p.precision").alias("precision"), F.col("p.recall").alias("recall"))
    at = spark.createDataFrame([(t,) for t in thresholds(step, 1 - step, step)], "threshold double")
    p = metrics.interpolated(points.withColumnRenamed("precision", "y"), at).withColumnRenamed("value", "precision")
    r = metrics.interpolated(points.withColumnRenamed("recall", "y"), at).withColumnRenamed("value", "recall")
    swept = p.join(r, ["class", "threshold"])
    precise, real = F.col("precision") >= target, F.col("recall") >= min_recall
    first = swept.groupBy("class").agg(F.min(F.when(precise & real, F.col("threshold"))).alias("threshold"), F.min(F.when(precise & ~real, F.col("threshold"))).alias("v"))
    support = metrics.class_support(instances, classes).join(metrics.group_support(instances, groups), "class", "left").na.fill(0)
    low = (F.col("source_photos") < LOW_PHOTOS) | (F.col("groups") < LOW_GROUPS)
    return support.join(first, "class", "left").select(
        "class", detections.severity_of(F.col("class"), severities).alias("severity"), "instances", "images", "source_photos", "groups", low.alias("low_support"), "threshold", F.when(F.col("threshold").isNull(), F.col("v")).alias("vacuous_threshold")
    )


def source_subsets(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename and source of the images whose source is known and has enough images to be measured apart."""
    named = images.join(manifest, "filename", "left").select("filename", names.manifest_source(F.col("source"), "filename").alias("source"))
    enough = named.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_IMAGES) & (F.col("source") != "unknown"))
    return named.join(enough.select("source"), "source")


def coverage(recalls: DataFrame) -> DataFrame:
    """One row: all classes measured, those in several sources, and whether no class is."""
    per = recalls.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    shared = F.sort_array(F.collect_list(F.when(F.col("n") >= 2, F.col("class"))))
    return per.agg(F.sort_array(F.collect_list("class")).alias("classes"), shared.alias("shared")).withColumn("disjoint", F.size("shared") == 0)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str)


def as_text(df: DataFrame, rows: int = 50) -> str:
    """A short table as aligned text."""
    return df.limit(rows).toPandas().to_string(index=False)
