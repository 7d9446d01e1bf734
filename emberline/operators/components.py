"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join; its result is written to the
shared scratch folder, which cuts the lineage and survives lost executors. No
edge or component reaches the driver, only two counts per round do. A hub's
edges are pre-aggregated before the shuffle of the minimum, and the join back
is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder, written

ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over (u, v). Large: neighbours above u go to u's minimum; small: those below, and u."""
    if small:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = sided.groupBy("u").agg(F.min("v").alias("m"))
        moved = sided.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        sided = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sided.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = sided.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = ROUNDS) -> DataFrame:
    """(node, component): the smallest node that each endpoint reaches, for nodes with an edge to another.

    Self loops, repeated edges and edges with a null end have no effect; no edges give no rows.
    """
    spark, base = edges.sparkSession, folder(edges.sparkSession)
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull())
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    before = mark(now)
    for k in range(1, rounds + 1):
        now = written(_star(_star(now, small=False), small=True), f"{base}/{k}")
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
