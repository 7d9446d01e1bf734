"""Similarity: Hamming join over hashes, overlaps of sets of stems, session votes, and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64


def bands(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 bands that cover all bits; edges are rounded half to even."""
    edges = [round(k * bits / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _band(h: Column, shift: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(mask))


def hamming_pairs(df: DataFrame, distance: int, key: str = "uid", phash: str = "phash", scope: str | None = None) -> DataFrame:
    """a, b: all pairs of different hashes within the distance, by each hash's smallest key, and a star from that key to the others of its hash.

    Hashes that differ in at most `distance` bits agree in one of distance + 1 bands, so a join on bands loses none.
    Rows with a null hash have no pairs; scope restricts pairs to rows that agree in that column.
    """
    by = [scope] if scope else []
    rows = df.where(F.col(phash).isNotNull())
    reps = rows.groupBy(*by, phash).agg(F.min(key).alias("rep"))
    star = rows.join(reps, [*by, phash]).where(F.col(key) != F.col("rep")).select(*by, F.col("rep").alias("a"), F.col(key).alias("b"))
    if distance <= 0:
        return star.distinct()
    h = F.col(phash)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _band(h, s, w).alias("value")) for k, (s, w) in enumerate(bands(distance))])).alias("cell")
    dealt = reps.select(*by, F.col(phash).alias("h"), "rep", cells).select(*by, "h", "rep", "cell.band", "cell.value")
    left, right = dealt.alias("l"), dealt.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "band", "value")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    near = left.join(right, on & (F.col("l.h") < F.col("r.h"))).where(F.bit_count(F.col("l.h").bitwiseXOR(F.col("r.h"))) <= distance)
    found = near.select(*[F.col(f"l.{c}").alias(c) for c in by], F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()
    return found.unionByName(star.select(*by, "a", "b").distinct())


def stem_sets(df: DataFrame, source: str = "source", stem: str = "stem") -> DataFrame:
    return df.select(F.col(source).alias("source"), F.col(stem).alias("stem")).distinct()


def overlap(sets: DataFrame) -> DataFrame:
    """Every pair of sources a < b: sizes, shared stems, and the share of each in percent (two decimals, half to even).

    Sources are a short list (pairs without shared stems are kept); stems meet by an equi-join.
    """
    size = sets.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = size.select(F.col("source").alias("a"), F.col("n").alias("n_a")).join(size.select(F.col("source").alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))
    l, r = sets.alias("l"), sets.alias("r")
    shared = l.join(r, (F.col("l.stem") == F.col("r.stem")) & (F.col("l.source") < F.col("r.source"))).groupBy(F.col("l.source").alias("a"), F.col("r.source").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").na.fill(0, ["shared"])
    return out.withColumn("pct_of_a", F.bround(100.0 * F.col("shared") / F.col("n_a"), 2)).withColumn("pct_of_b", F.bround(100.0 * F.col("shared") / F.col("n_b"), 2))


def contained(sets: DataFrame, percent: float = 90.0, candidates: list[str] | None = None, against: list[str] | None = None) -> DataFrame:
    """source, contained_in, n_unique, n_shared, pct where at least so much of a source is in another."""
    pairs = overlap(sets)
    both = pairs.select(F.col("a").alias("source"), F.col("b").alias("contained_in"), F.col("n_a").alias("n_unique"), F.col("shared").alias("n_shared")).unionByName(
        pairs.select(F.col("b").alias("source"), F.col("a").alias("contained_in"), F.col("n_b").alias("n_unique"), F.col("shared").alias("n_shared"))
    )
    out = both.withColumn("pct", 100.0 * F.col("n_shared") / F.col("n_unique")).where(F.col("pct") >= percent)
    if candidates is not None:
        out = out.where(F.col("source").isin(*candidates))
    if against is not None:
        out = out.where(F.col("contained_in").isin(*against))
    return out.withColumn("pct", F.bround("pct", 2)).orderBy(F.desc("pct"), "source", "contained_in")


def refuse_redundant(found: DataFrame, allow: bool = False) -> None:
    """An error that names the redundant sources, unless they are allowed."""
    rows = [] if allow else found.limit(20).collect()
    if rows:
        raise ValueError("redundant sources: " + ", ".join(f"{r['source']} in {r['contained_in']} ({r['pct']} %)" for r in rows))


def corroboration(sessions: DataFrame, distance: int = 6) -> DataFrame:
    """session, n_stems, share: of each session's stems (the first row of each that has a hash), how many have a near neighbour in the session."""
    first = Window.partitionBy("session", "stem").orderBy("uid")
    reps = sessions.where(F.col("phash").isNotNull()).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    pairs = hamming_pairs(reps, distance, "uid", "phash", "session")
    linked = pairs.select("session", F.explode(F.array("a", "b")).alias("uid")).groupBy("session").agg(F.countDistinct("uid").alias("linked"))
    voters = reps.groupBy("session").agg(F.count(F.lit(1)).alias("voters"))
    stems = sessions.groupBy("session").agg(F.countDistinct("stem").alias("n_stems"))
    share = F.coalesce(F.col("linked") / F.col("voters"), F.lit(0.0))
    return stems.join(voters, "session", "left").join(linked, "session", "left").select("session", "n_stems", share.alias("share"))


def believed(sessions: DataFrame, least_share: float = 0.25, distance: int = 6, least_stems: int = 3) -> DataFrame:
    """corroboration with believed: small sessions and, with no least share, all."""
    voted = corroboration(sessions, distance)
    return voted.withColumn("believed", F.lit(least_share <= 0) | (F.col("n_stems") < least_stems) | (F.col("share") >= least_share))


def collisions(members: DataFrame, kind: str) -> DataFrame:
    """members: set_id, source. For sets over several sources, per pair of sources: how many members are in either."""
    counts = members.groupBy("set_id", "source").agg(F.count(F.lit(1)).alias("n"))
    l, r = counts.alias("l"), counts.alias("r")
    pairs = l.join(r, (F.col("l.set_id") == F.col("r.set_id")) & (F.col("l.source") < F.col("r.source")))
    return pairs.groupBy(F.col("l.source").alias("a"), F.col("r.source").alias("b")).agg(F.sum(F.col("l.n") + F.col("r.n")).alias(kind))
