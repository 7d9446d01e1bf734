"""Data-quality rules: each is a query that yields (rule, subject, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the rules: fixed values.
SHARE_TOLERANCE, FRAMES_PER_GROUP, LEAST_GROUPS = 0.6, 3.0, 10
LEAST_SCENES, LEAST_PER_SPLIT = 40, 5
LEAST_TOTAL, LEAST_VAL_TEST, LEAST_EVALUABLE = 5, 2, 3


def rule(df: DataFrame, name: str, subject: Column, message: Column, when: Column) -> DataFrame:
    return df.where(F.coalesce(when, F.lit(False))).select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"), message.alias("message"))


def together(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def split_balance(counts: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """counts: split, n_images. val and test that got less than the tolerated part of their share."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame(list(ratios.items()), "split string, wanted double")
    total = counts.agg(F.greatest(F.coalesce(F.sum("n_images"), F.lit(0)), F.lit(1)).alias("total"))
    shares = wanted.join(counts, "split", "left").join(F.broadcast(total)).withColumn("share", F.coalesce("n_images", F.lit(0)) / F.col("total"))
    bad = F.col("split").isin("val", "test") & (F.col("share") < F.col("wanted") * SHARE_TOLERANCE)
    return rule(shares, "split_imbalance", F.col("split"), F.format_string("share %.3f of %.3f wanted", "share", "wanted"), bad)


def class_coverage(counts: DataFrame, classes: list[str]) -> DataFrame:
    """counts: split, class, n. Classes without any instance, and classes that val and test don't both hold."""
    wide = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("split") == "val", F.col("n"))).alias("val"), F.sum(F.when(F.col("split") == "test", F.col("n"))).alias("test"))
    every = counts.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(wide, "class", "left").na.fill(0)
    empty = rule(every, "empty_class", F.col("class"), F.lit("no instance in any split"), F.col("n") == 0)
    return empty.unionByName(rule(every, "not_evaluable", F.col("class"), F.lit("not in both val and test"), (F.col("n") > 0) & ((F.col("val") == 0) | (F.col("test") == 0))))


def collisions(matrix: DataFrame) -> DataFrame:
    """matrix: a, b, exact, near."""
    return rule(matrix, "collision", F.concat("a", F.lit("|"), "b"), F.format_string("%d in exact sets, %d in near sets", "exact", "near"), F.lit(True))


def sources(stats: DataFrame) -> DataFrame:
    """stats: source, n_images, n_groups, n_missing_labels, n_without_suffix, is_reference."""
    s, own = F.col("source"), ~F.col("is_reference")
    return together(
        [
            rule(stats, "timelapse", s, F.format_string("%d images in %d groups", "n_images", "n_groups"), (F.col("n_groups") > 0) & (F.col("n_images") / F.greatest("n_groups", F.lit(1)) >= FRAMES_PER_GROUP)),
            rule(stats, "too_few_groups", s, F.format_string("%d groups", "n_groups"), (F.col("n_groups") > 0) & (F.col("n_groups") < LEAST_GROUPS) & own),
            rule(stats, "missing_labels", s, F.format_string("%d images without labels", "n_missing_labels"), F.col("n_missing_labels") > 0),
            rule(stats, "no_suffix", s, F.format_string("%d of %d names", "n_without_suffix", "n_images"), (F.col("n_without_suffix") > 0) & own),
        ]
    )


def classes(remaps: DataFrame) -> DataFrame:
    """remaps: source, name, outcome."""
    named = remaps.groupBy("source", "outcome").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    return together([rule(named, f"{o}_classes", F.col("source"), F.col("names"), F.col("outcome") == o) for o in ("unmapped", "dropped")])


def licences(specs: DataFrame) -> DataFrame:
    """specs: source, licence, declared, noncommercial, included."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"[_\-/.]+", " "), r"\s+", " "))
    s, nc = F.col("source"), F.col("noncommercial")
    return together(
        [
            rule(specs, "licence_gate", s, F.concat(F.lit("excluded: "), "licence"), nc & ~F.col("included")),
            rule(specs, "licence_noncommercial", s, F.concat(F.lit("included: "), "licence"), nc & F.col("included")),
            rule(specs, "licence_mismatch", s, F.concat("licence", F.lit(" but declares "), "declared"), F.col("included") & F.col("declared").isNotNull() & (tidy("declared") != tidy("licence"))),
        ]
    )


def redundant(contained: DataFrame) -> DataFrame:
    return rule(contained, "redundant_source", F.col("source"), F.format_string("%d of %d in %s", "n_shared", "n_unique", "contained_in"), F.lit(True))


def provenance_note(df: DataFrame) -> DataFrame:
    """The note that is always given: pixels still tell where an image came from."""
    return df.sparkSession.createDataFrame([("confound_note", "all", "check recall by source before trusting pooled scores")], "rule string, subject string, message string")


def scene_reasons(total: DataFrame, per_split: DataFrame, class_names: list[str], splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row: whether the scenes are too few to evaluate on, and why. total: n. per_split: split, class, n."""
    spark = total.sparkSession
    cells = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate((s, c) for s in splits for c in class_names)], "ix int, split string, class string")
    thin = cells.join(per_split, ["split", "class"], "left").na.fill(0, ["n"]).where(F.col("n") < LEAST_PER_SPLIT)
    thin = thin.select(F.struct("ix", F.format_string("%s has %d of %s", "split", "n", "class").alias("m")).alias("r"))
    few = total.where(F.col("n") < LEAST_SCENES).select(F.struct(F.lit(-1).alias("ix"), F.format_string("only %d scenes", "n").alias("m")).alias("r"))
    reasons = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["m"])
    return few.unionByName(thin).agg(reasons.alias("reasons")).select((F.size("reasons") > 0).alias("warn"), F.array_join("reasons", "; ").alias("reasons"))


def session_verdicts(reports: DataFrame) -> DataFrame:
    """reports: class, n_sessions, n_val, n_test. verdict: not_evaluated, weak (with reasons) or fine."""
    n = F.col("n_sessions")
    why = F.concat_ws(
        ", ", F.when(n < LEAST_TOTAL, F.format_string("%d sessions", n)), F.when(F.col("n_val") < LEAST_VAL_TEST, F.format_string("%d val", "n_val")), F.when(F.col("n_test") < LEAST_VAL_TEST, F.format_string("%d test", "n_test"))
    )
    return reports.select("class", F.when(n < LEAST_EVALUABLE, "not_evaluated").when(why != "", "weak").otherwise("fine").alias("verdict"), F.when(n >= LEAST_EVALUABLE, why).otherwise("").alias("reasons"))
