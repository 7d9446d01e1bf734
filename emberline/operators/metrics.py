"""Evaluation: confusion, precision and recall, threshold sweeps, support and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def names(spark: SparkSession, classes: list[str], column: str = "class") -> DataFrame:
    return spark.createDataFrame([(k, c) for k, c in enumerate(classes)], f"class_ix int, {column} string")


def confusion(df: DataFrame, classes: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row per true class and one column per predicted class; a class outside the list is an error."""
    known = lambda c: F.when(F.col(c).isin(*classes), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(c), F.lit("null")))))
    counted = df.select(known(y_true).alias("y_true"), known(y_pred).alias("y_pred")).groupBy("y_true").pivot("y_pred", classes).agg(F.count(F.lit(1)))
    return names(df.sparkSession, classes, "y_true").join(counted, "y_true", "left").na.fill(0, classes).drop("class_ix")


def top1(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")), F.lit(0.0)).alias("accuracy"))


def per_class(df: DataFrame, classes: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """class, precision, recall, f1 (0 on empty denominators), support and predicted_count."""
    hit = (F.col(y_true) == F.col(y_pred)).cast("int")
    side = F.explode(F.array(F.struct(F.col(y_true).alias("class"), hit.alias("tp"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col(y_pred).alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("s"), F.lit(1).alias("p"))))
    sums = df.select(side.alias("x")).select("x.*").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted_count"))
    joined = names(df.sparkSession, classes).join(sums, "class", "left").na.fill(0)
    out = joined.withColumn("precision", ratio(F.col("tp"), F.col("predicted_count"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support", "predicted_count")


def macro_f1(df: DataFrame, classes: list[str]) -> DataFrame:
    return per_class(df, classes).agg(F.avg("f1").alias("macro_f1"))


def binary(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """The 2 x 2 metrics of two boolean columns (true: defect); empty denominators give 0."""
    c = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    counts = df.agg(*[F.count_if(v).alias(k) for k, v in c.items()])
    return _rates(counts, 0.0).withColumn("false_positive_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def _rates(counts: DataFrame, empty_precision: float) -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty_precision)
    out = counts.withColumn("precision", p).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(records: DataFrame, values: list[float], positive: Column, is_argmax: str = "is_argmax", prob: str = "prob") -> DataFrame:
    """Per threshold: counts of rows that are argmax and reach it; precision is 1 where nothing is predicted.

    Rows meet the thresholds as an array inside their own row and are aggregated before any shuffle.
    """
    fired = F.explode(F.lit([float(v) for v in values])).alias("threshold")
    rows = records.select(positive.alias("is_true"), F.col(is_argmax).alias("a"), F.col(prob).alias("p"), fired)
    hit = F.col("a") & (F.col("p") >= F.col("threshold"))
    counts = rows.groupBy("threshold").agg(
        F.count_if(hit & F.col("is_true")).alias("tp"), F.count_if(hit & ~F.col("is_true")).alias("fp"), F.count_if(~hit & F.col("is_true")).alias("fn"), F.count_if(~hit & ~F.col("is_true")).alias("tn")
    )
    return _rates(counts, 1.0).drop("f1")


def lowest_threshold(points: DataFrame, target: float, min_recall: float) -> DataFrame:
    """One row: the first threshold that reaches the precision with enough recall, or null and the first vacuous one."""
    precise, real = F.col("precision") >= target, F.col("recall") >= min_recall
    return points.agg(F.min(F.when(precise & real, F.col("threshold"))).alias("threshold"), F.min(F.when(precise & ~real, F.col("threshold"))).alias("v")).select(
        "threshold", F.when(F.col("threshold").isNull(), F.col("v")).alias("vacuous_threshold")
    )


def best_point(points: DataFrame, min_recall: float) -> DataFrame:
    """The most precise point with enough recall, else the one of largest recall; the lowest threshold on ties."""
    real = F.col("recall") >= min_recall
    return points.orderBy(F.desc(real), F.desc(F.when(real, F.col("precision")).otherwise(F.col("recall"))), F.asc("threshold")).limit(1)


def recall_by(df: DataFrame, group: str, correct: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("support"), F.count_if(correct).alias("correct")).withColumn("recall", ratio(F.col("correct"), F.col("support")))


def shared_gaps(df: DataFrame, cls: str = "class", recall: str = "recall") -> DataFrame:
    """Classes measured in two sources or more, with the range of their recalls."""
    return df.where(F.col(recall).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n_sources"), F.min(recall).alias("low"), F.max(recall).alias("high")).where("n_sources >= 2").withColumn("gap", F.col("high") - F.col("low"))


def recall_range(df: DataFrame, recall: str = "recall") -> DataFrame:
    """The range of what was measured; null below two."""
    return df.agg(F.when(F.count(recall) >= 2, F.max(recall) - F.min(recall)).alias("gap"))


def confound_verdict(measured: DataFrame, gaps: DataFrame, warn: float = 0.15) -> DataFrame:
    """One row: verdict over recalls by source (column recall) and shared gaps."""
    a = measured.agg(F.count("recall").alias("n_measured"))
    b = gaps.agg(F.count(F.lit(1)).alias("n_shared"), F.max("gap").alias("worst_gap"), F.max_by("class", F.struct("gap", F.lit(0))).alias("worst_class"))
    verdict = F.when(F.col("n_measured") < 2, "INCONCLUSIVE").when(F.col("n_shared") == 0, "AGGREGATE ONLY").when(F.col("worst_gap") >= warn, "CONFOUND LIKELY").otherwise("NO STRONG CONFOUND")
    return a.join(F.broadcast(b)).withColumn("verdict", verdict)


def gap_size(gap: Column, n_sources: Column) -> Column:
    """The classifier's verdict over a recall gap between two sources."""
    return F.when(n_sources <= 1, "NOT APPLICABLE").when(gap.isNull(), "UNDEFINED").when(gap >= 0.20, "LARGE").when(gap >= 0.10, "MODERATE").otherwise("SMALL")


def fit_for_pausing(threshold: Column, gap: Column) -> Column:
    """A threshold was found and the gap, where known, isn't large."""
    return threshold.isNotNull() & F.coalesce(gap < 0.20, F.lit(True))


def class_support(instances: DataFrame, classes: list[str], cls: str = "class", image: str = "image", photo: str = "photo") -> DataFrame:
    """Boxes, images and photos of each class; a class without any has zeros."""
    counted = instances.groupBy(F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("instances"), F.countDistinct(image).alias("images"), F.countDistinct(photo).alias("source_photos"))
    return names(instances.sparkSession, classes).join(counted, "class", "left").na.fill(0).drop("class_ix")


def group_support(instances: DataFrame, groups: DataFrame, image: str = "image") -> DataFrame:
    """Independent groups of each class; images without a group are left out."""
    return instances.join(groups, image).groupBy("class").agg(F.countDistinct("group").alias("groups"))


def variant_stats(df: DataFrame, group: str) -> DataFrame:
    """How many rows a group has: total, groups, min, median, mean, max, the 90th percentile by nearest rank, and groups over 10."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    # groups by size: the percentile needs no list of all groups
    hist = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    below = hist.withColumn("upto", F.sum("groups").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    total = sizes.agg(F.sum("n").alias("num_rows"), F.count(F.lit(1)).alias("num_groups"), F.min("n").alias("min"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"), F.count_if(F.col("n") > 10).alias("num_over_10"))
    rank = F.least(F.col("num_groups") - 1, F.bround(F.lit(0.9) * (F.col("num_groups") - 1)).cast("long"))
    found = below.join(F.broadcast(total.select(rank.alias("rank"))), F.col("upto") > F.col("rank")).agg(F.min("n").alias("p90"))
    return total.join(F.broadcast(found)).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in (*total.columns, "p90")])


def map_gap(deduped: Column, raw: Column, warn: float = 0.10) -> Column:
    """struct(absolute, relative, significant, optimistic) of a raw against a de-duplicated score."""
    absolute = raw - deduped
    relative = F.when(deduped > 0, absolute / deduped)
    return F.struct(absolute.alias("absolute"), relative.alias("relative"), F.coalesce(F.abs(relative) >= warn, F.lit(False)).alias("significant"), (absolute > 0).alias("optimistic"))


def interpolated(curve: DataFrame, at: DataFrame, x: str = "x", y: str = "y", point: str = "threshold", keys: tuple[str, ...] = ("class",)) -> DataFrame:
    """Linear interpolation of each key's curve at every point, clamped at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    spans = curve.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w)).withColumn("first", F.row_number().over(w) == 1)
    joined = spans.join(F.broadcast(at))
    inside = (F.col(point) >= F.col(x)) & (F.col(point) < F.col("x2"))
    low, high = F.col("first") & (F.col(point) < F.col(x)), F.col("x2").isNull() & (F.col(point) >= F.col(x))
    value = F.when(inside, F.col(y) + (F.col("y2") - F.col(y)) * ((F.col(point) - F.col(x)) / (F.col("x2") - F.col(x)))).when(low | high, F.col(y))
    return joined.withColumn("value", value).where(F.col("value").isNotNull()).select(*keys, point, "value")


def curve_summary(df: DataFrame, arrays: list[str], cls: str = "classes") -> DataFrame:
    """An evaluator's per-class arrays, flattened to one row per class."""
    zipped = F.explode(F.arrays_zip(F.col(cls).alias("class"), *[F.col(a) for a in arrays]))
    return df.select(zipped.alias("x")).select("x.*")
