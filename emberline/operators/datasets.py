"""Whole dataset builds: from scanned records to leak-free splits, with their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder, written
from . import grouping, similarity, splits


@dataclass
class Plan:
    """Records with their split, and one-row or short report tables by name."""

    records: DataFrame
    reports: dict[str, DataFrame]


def binary_plan(records: DataFrame, seed: int = 1337, distance: int = 6, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), cap: int | None = None) -> Plan:
    """records: uid, orig_split, label, content_hash, phash. Exact duplicates go, scenes are clustered, mixed ones excluded, the rest allocated by label."""
    base = folder(records.sparkSession)
    unique = splits.first_per(records, ["content_hash"], ["uid"], exempt_null=True)
    clustered = written(grouping.cluster(unique, distance), f"{base}/clustered")
    straddle, mixed = grouping.straddling(clustered, "orig_split"), grouping.mixed(clustered, "label")
    clean = clustered.join(mixed.select("cluster"), "cluster", "left_anti")
    sizes = clean.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("size"))
    kept = splits.capped(sizes, cap, seed + 1000) if cap is not None else sizes
    allocated = written(splits.allocated(kept, ratios, seed), f"{base}/allocated")
    out = clean.join(allocated.select("cluster", "split"), "cluster")
    totals = clustered.agg(F.countDistinct("cluster").alias("n"))
    return Plan(
        out,
        {
            "pooled": records.agg(F.count(F.lit(1)).alias("n")), "kept": unique.agg(F.count(F.lit(1)).alias("n")), "clusters": totals, "sizes": grouping.cluster_sizes(clustered),
            "straddling": straddle, "mixed": mixed, "per_split": allocated.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")),
        },
    )


def merged_plan(
    records: DataFrame, sources: list[str], references: list[str] = (), seed: int = 1337, ratios: tuple[float, float, float] = (0.6, 0.25, 0.15), excluded: list[str] = (), drop_reference_duplicates: bool = False, allow_redundant: bool = False, least_groups: int = 10, **options
) -> Plan:
    """records: uid, source, stem, rf_matched, content_hash, phash, of sources (in order of priority) and references.

    Excluded sources go; a source that another holds is refused; groups are made over everything that stays; each
    content stays once, from the first source; groups are split, and no split shares one. Fewer than least_groups
    groups, or an empty val or test, are errors.
    """
    base = folder(records.sparkSession)
    included = [s for s in sources if s not in excluded]
    used = records.where(F.col("source").isin(*included, *references))
    contained = similarity.contained(similarity.stem_sets(used), candidates=included, against=[*included, *references])
    similarity.refuse_redundant(contained, allow_redundant)
    grouped = written(grouping.assign(used, **options), f"{base}/grouped")
    own = splits.prioritised(grouped.where(F.col("source").isin(*included)), included)
    if drop_reference_duplicates:
        theirs = grouped.where(F.col("source").isin(*references) if references else F.lit(False))
        own = own.join(theirs.select("content_hash").dropna().distinct(), "content_hash", "left_anti").join(theirs.select("group").distinct(), "group", "left_anti")
    own = written(own, f"{base}/own")
    n = own.select("group").distinct().count()
    if n < least_groups:
        raise ValueError(f"{n} groups are too few; {least_groups} are needed")
    split_of = splits.ratio_split(own, "group", seed, ratios)
    out = written(own.join(split_of, "group"), f"{base}/out")
    there = {r["split"] for r in out.select("split").distinct().collect()}
    if missing := {"val", "test"} - there:
        raise ValueError(f"no group in {sorted(missing)}")
    grouping.assert_disjoint(out)
    exact = grouped.where(F.col("content_hash").isNotNull()).select(F.col("content_hash").alias("set_id"), "source")
    return Plan(
        out,
        {
            "contained": contained, "collisions": similarity.collisions(exact, "exact"), "groups_per_source": grouped.groupBy("source").agg(F.countDistinct("group").alias("n_groups"), F.count(F.lit(1)).alias("n_images")),
            "tallies": splits.tallies(out, "split", "source", "group", included),
        },
    )


def class_plan(candidates: DataFrame, budgets: dict[str, int], seed: int = 1337, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> Plan:
    """candidates: class, priority, group, stem. Each class up to its budget, lower priorities first; its sessions are split, at least one each where there are three."""
    spark = candidates.sparkSession
    chosen = None
    for name, budget in sorted(budgets.items()):
        part = splits.budgeted(candidates.where(F.col("class") == name), "priority", "stem", budget, seed)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen, f"{folder(spark)}/chosen")
    rows = []
    for name in sorted(budgets):
        mine = splits.ratio_split(chosen.where(F.col("class") == name), "group", seed, ratios).orderBy("group").collect()  # sessions of one class: a short list
        by: dict[str, list[str]] = {}
        for r in mine:
            by.setdefault(r["split"], []).append(r["group"])
        rows += [(name, g, s) for s, groups in splits.repaired(by).items() for g in groups]
    table = spark.createDataFrame(rows, "class string, group string, split string")
    out = chosen.join(F.broadcast(table), ["class", "group"])
    counts = table.groupBy("class").agg(F.count(F.lit(1)).alias("n_sessions"), F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"))
    return Plan(out, {"sessions": counts})
