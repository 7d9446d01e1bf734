"""Deterministic selection, sampling and leak-free splits.

Randomness is a hash of a seed and a key: the same for any order of rows and any
number of partitions, and expressible in SQL. It isn't that of any generator.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold

SPLITS = ("train", "val", "test")


def shuffled(key: Column | str, seed: int) -> Column:
    """The value to sort by for a seeded shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1: {ratios}")


def first_per(df: DataFrame, keys: list[str], order: list, exempt_null: bool = False) -> DataFrame:
    """The first row of each key; rows with a null key all stay where exempt."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("__rank", rank)
    keep = F.col("__rank") == 1
    for k in keys if exempt_null else ():
        keep = keep | F.col(k).isNull()
    return out.where(keep).drop("__rank")


def prioritised(df: DataFrame, sources: list[str], source: str = "source", key: str = "content_hash", uid: str = "uid") -> DataFrame:
    """One row per content, from the source that comes first in the list; rows without a hash all stay."""
    rank = F.array_position(F.lit(sources), F.col(source))
    return first_per(df.withColumn("__priority", rank), [key], ["__priority", uid], exempt_null=True).drop("__priority")


def representatives(df: DataFrame, group: str, name: str, strategy: str = "seeded", seed: int = 1337) -> DataFrame:
    """One name per group: the first, or one by a seeded hash that depends on the group and name only."""
    if strategy not in ("first", "seeded"):
        raise ValueError(f"unknown strategy {strategy}")
    pick = F.min(name) if strategy == "first" else F.min_by(name, F.struct(shuffled(F.concat(group, F.lit(":"), name), seed), F.col(name)))
    return df.groupBy(group).agg(pick.alias(name))


def sample_k(df: DataFrame, key: str, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Exactly k rows (or all) by a seeded order, per group."""
    order = Window.partitionBy(*by) if by else Window.partitionBy()
    if by:
        return df.withColumn("__r", F.row_number().over(order.orderBy(shuffled(key, seed), key))).where(F.col("__r") <= k).drop("__r")
    return df.orderBy(shuffled(key, seed), key).limit(k)


def allocation(classes: list[str], n: int) -> dict[str, int]:
    """n spread over the classes; the first ones in alphabetical order get one more."""
    if not classes:
        raise ValueError("no classes")
    return {c: n // len(classes) + (k < n % len(classes)) for k, c in enumerate(sorted(classes))}


def stratified(df: DataFrame, cls: str, key: str, counts: dict[str, int], seed: int) -> DataFrame:
    """As many rows of each class as counts says; too few are an error."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(counts.items()), f"{cls} string, __n int")
    there = {r[cls]: r["n"] for r in df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).where(F.col(cls).isin(*counts)).collect()}
    if short := {c: (there.get(c, 0), n) for c, n in counts.items() if there.get(c, 0) < n}:
        raise ValueError(f"too few rows (there, wanted): {short}")
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(shuffled(key, seed), key))
    return df.withColumn("__r", rank).join(F.broadcast(wanted), cls).where(F.col("__r") <= F.col("__n")).drop("__r", "__n")


def budgeted(df: DataFrame, priority: str, key: str, budget: int, seed: int) -> DataFrame:
    """Rows up to the budget, lower priorities first, by a seeded order within one."""
    return df.orderBy(priority, shuffled(key, seed), key).limit(budget)


def ratio_split(groups: DataFrame, group: str, seed: int, ratios: tuple[float, float, float]) -> DataFrame:
    """group, split of the distinct groups: counts are rounded half to even, the rest is test.

    Ranks come from counts per range of the hash, so groups aren't sorted in one task.
    """
    check_ratios(ratios)
    unique = groups.select(group).distinct().withColumn("h", shuffled(group, seed))
    dealt = unique.repartitionByRange("h", group).sortWithinPartitions("h", group).withColumn("p", F.spark_partition_id())
    inside = dealt.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("h", group)))
    counts = inside.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ranked = inside.join(F.broadcast(ahead.select("p", "ahead", "total")), "p").withColumn("rank", F.col("ahead") + F.col("i"))
    n_train = F.bround(F.col("total") * F.lit(ratios[0]))
    n_val = F.bround(F.col("total") * F.lit(ratios[1]))
    return ranked.select(group, F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test").alias("split"))


def repaired(split_of: dict[str, list[str]]) -> dict[str, list[str]]:
    """Group ids by split with at least one in each: below three groups all are train, else the last of a fuller split moves."""
    out = {s: list(split_of.get(s, [])) for s in SPLITS}
    if sum(map(len, out.values())) < 3:
        return {"train": [g for s in SPLITS for g in out[s]], "val": [], "test": []}
    for empty in ("val", "test"):
        if not out[empty]:
            donor = next(s for s in ("train", "val", "test") if s != empty and len(out[s]) > 1)
            out[empty].append(out[donor].pop())
    return out


def split_files(files: DataFrame, splits: DataFrame, group: str, name: str) -> DataFrame:
    """Every file of a train group, and the first file of the others."""
    joined = files.join(splits, group)
    first = F.row_number().over(Window.partitionBy(group).orderBy(name)) == 1
    return joined.withColumn("__first", first).where((F.col("split") == "train") | F.col("__first")).drop("__first")


def allocated(clusters: DataFrame, ratios: tuple[float, float, float], seed: int, label: str = "label") -> DataFrame:
    """label, cluster, size, split: in a seeded order, each cluster goes to the split that lacks most of its share so far."""
    check_ratios(ratios)
    kind = clusters.schema[label].dataType.simpleString()
    ordered = clusters.withColumn("__h", shuffled("cluster", seed))

    def start():
        total, assigned = [0], [0, 0, 0]

        def step(row: tuple) -> Iterator[tuple]:
            lab, cluster, size = row
            total[0] += size
            lack = [r * total[0] - a for r, a in zip(ratios, assigned)]
            best = lack.index(max(lack))
            assigned[best] += size
            yield lab, cluster, size, SPLITS[best]

        return step

    return ordered_fold(ordered, [label], ["__h", "cluster"], ["cluster", "size"], start, f"{label} {kind}, cluster {clusters.schema['cluster'].dataType.simpleString()}, size long, split string")


def capped(clusters: DataFrame, cap: int, seed: int, label: str = "label") -> DataFrame:
    """label, cluster, size of the clusters that are kept: one that doesn't fit under the cap is passed over, later ones may fit."""
    kind = clusters.schema[label].dataType.simpleString()

    def start():
        total = [0]

        def step(row: tuple) -> Iterator[tuple]:
            if total[0] + row[2] <= cap:
                total[0] += row[2]
                yield row

        return step

    ordered = clusters.withColumn("__h", shuffled("cluster", seed))
    return ordered_fold(ordered, [label], ["__h", "cluster"], ["cluster", "size"], start, f"{label} {kind}, cluster {clusters.schema['cluster'].dataType.simpleString()}, size long")


def round_robin(df: DataFrame, cls: str, key: str, steps: int, batch: int, seed: int) -> DataFrame:
    """step, slot and row of a class-balanced epoch: slot k draws from class k mod C, each class in a seeded order that starts anew when used up."""
    classes = [r[cls] for r in df.select(cls).distinct().orderBy(cls).collect()]
    size = df.groupBy(cls).agg(F.count(F.lit(1)).alias("__n"))
    pool = df.withColumn("__r", F.row_number().over(Window.partitionBy(cls).orderBy(shuffled(key, seed), key)) - 1)
    table = df.sparkSession.createDataFrame(list(enumerate(classes)), f"__c int, {cls} {df.schema[cls].dataType.simpleString()}")
    slots = df.sparkSession.range(steps * batch).withColumn("__c", (F.col("id") % len(classes)).cast("int")).join(F.broadcast(table), "__c").join(F.broadcast(size), cls)
    drawn = slots.withColumn("__r", F.floor(F.col("id") / len(classes)) % F.col("__n"))
    return drawn.join(pool, [cls, "__r"]).withColumn("step", F.floor(F.col("id") / batch)).withColumn("slot", F.col("id") % batch).drop("__c", "__r", "__n", "id")


def tallies(df: DataFrame, split: str, cls: str, group: str, classes: list[str]) -> DataFrame:
    """Per split: groups, rows, and rows of each class (zeros where none)."""
    counts = df.groupBy(split).agg(F.countDistinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in classes])
    every = df.sparkSession.createDataFrame([(s,) for s in SPLITS], f"{split} string")
    return every.join(counts, split, "left").na.fill(0)
