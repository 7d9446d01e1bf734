"""Groups that must not be split: exact and near duplicates, siblings, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .components import components
from .similarity import believed, hamming_pairs


def sessions(df: DataFrame, keys: list[str], order: list[str], value: Column, gap: float, name: str = "session") -> DataFrame:
    """df with a session number per key: a new one where the value has moved by more than the gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = value - F.lag(value).over(w)
    opens = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return df.withColumn("__new", opens).withColumn(name, (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("__new")


def name_sessions(stems: DataFrame, keys: list[str], gap_s: float = 600.0, seq_gap: int = 3) -> DataFrame:
    """keys, stem, session of the distinct stems with a time (ts00000) or a sequence number (seq:family:00000) in them."""
    unique = stems.select(*keys, "stem").distinct().withColumn("ts", names.name_timestamp("stem"))
    timed = sessions(unique.where(F.col("ts").isNotNull()), keys, ["ts", "stem"], F.unix_micros("ts") / 1e6, gap_s)
    rest = unique.where(F.col("ts").isNull()).withColumn("s", names.sequence_key("stem")).where(F.col("s").isNotNull()).select(*keys, "stem", "s.family", "s.number")
    numbered = sessions(rest, [*keys, "family"], ["number", "stem"], F.col("number").cast("decimal(38,0)"), seq_gap)
    return timed.select(*keys, "stem", F.format_string("ts%05d", "session").alias("session")).unionByName(
        numbered.select(*keys, "stem", F.concat(F.lit("seq:"), "family", F.lit(":"), F.lpad(F.col("session").cast("string"), 5, "0")).alias("session"))
    )


def capture_sessions(stems: DataFrame, gap_s: float = 600.0) -> DataFrame:
    """stem, session by the capture time of each frame (the stem without variant marks); unparsed:<frame> without one."""
    frames = stems.select("stem", names.capture_key("stem").alias("frame")).withColumn("ts", names.capture_timestamp("frame"))
    known = frames.select("frame", "ts").distinct().where(F.col("ts").isNotNull()).withColumn("k", F.lit(0))
    timed = sessions(known, ["k"], ["ts", "frame"], F.unix_micros("ts") / 1e6, gap_s).select("frame", F.format_string("session%05d", "session").alias("session"))
    return frames.join(timed, "frame", "left").select("stem", F.coalesce("session", F.concat(F.lit("unparsed:"), "frame")).alias("session"))


def stars(df: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    """a, b: each row of a group with its smallest, for groups whose keys aren't null."""
    rows = df.dropna(subset=keys)
    hubs = rows.groupBy(*keys).agg(F.min(uid).alias("a"))
    return rows.join(hubs, keys).where(F.col(uid) != F.col("a")).select("a", F.col(uid).alias("b"))


def links(records: DataFrame, distance: int = 6, gap_s: float = 600.0, seq_gap: int = 3, use_sessions: bool = True, least_share: float = 0.25) -> DataFrame:
    """a, b, kind of the four kinds of links. records: uid, source, stem, rf_matched, content_hash, phash (both hashes null where undecodable)."""
    decoded = records.where(F.col("content_hash").isNotNull())
    out = stars(decoded, ["content_hash"]).withColumn("kind", F.lit("exact"))
    out = out.unionByName(hamming_pairs(decoded, distance).withColumn("kind", F.lit("near")))
    out = out.unionByName(stars(records.where("rf_matched"), ["source", "stem"]).withColumn("kind", F.lit("sibling")))
    if use_sessions:
        named = records.join(name_sessions(records, ["source"], gap_s, seq_gap), ["source", "stem"]).withColumn("session", F.concat_ws("/", "source", "session"))
        good = believed(named, least_share).where("believed").select("session")
        out = out.unionByName(stars(named.join(good, "session"), ["session"]).withColumn("kind", F.lit("session")))
    return out


def assign(records: DataFrame, **options) -> DataFrame:
    """records with group: g000000 and on, by each component's smallest uid."""
    found = components(links(records, **options), "a", "b").withColumnRenamed("node", "uid")
    rooted = records.join(found, "uid", "left").withColumn("root", F.coalesce("component", "uid")).drop("component")
    return numbered(rooted, "root", "group").drop("root")


def numbered(df: DataFrame, root: str, name: str) -> DataFrame:
    """df with dense group names in the order of the roots.

    Ranks come from counts per range partition, so the roots aren't sorted in one task.
    """
    roots = df.select(root).distinct().repartitionByRange(root).sortWithinPartitions(root)
    marked = roots.withColumn("p", F.spark_partition_id()).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(root)))
    ahead = marked.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = marked.join(F.broadcast(ahead), "p").select(root, F.format_string("g%06d", F.col("ahead") + F.col("i") - 1).alias(name))
    return df.join(ranked, root)


def cluster(records: DataFrame, distance: int, uid: str = "uid", phash: str = "phash") -> DataFrame:
    """records with cluster, the smallest uid that near hashes reach."""
    found = components(hamming_pairs(records, distance, uid, phash), "a", "b").select(F.col("node").alias(uid), F.col("component").alias("cluster"))
    return records.join(found, uid, "left").withColumn("cluster", F.coalesce("cluster", uid))


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("count"), *[F.coalesce(x, F.lit(0)).alias(n) for n, x in (("min", F.min("n")), ("max", F.max("n")), ("mean", F.bround(F.avg("n"), 3)), ("median", F.median("n")))])


def straddling(clustered: DataFrame, split: str) -> DataFrame:
    """Clusters with rows of more than one split."""
    return clustered.groupBy("cluster").agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def mixed(clustered: DataFrame, label: str) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.sort_array(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def overlaps(df: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """Groups that more than one split holds."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def assert_disjoint(df: DataFrame, group: str = "group", split: str = "split") -> None:
    if bad := overlaps(df, group, split).limit(5).collect():
        raise AssertionError("groups in several splits: " + "; ".join(f"{r[group]} in {', '.join(map(str, r['splits']))}" for r in bad))
