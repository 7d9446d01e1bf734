"""How the operators' inputs are read off the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Decision

#: The settings that the replay queries use.
SETTINGS = Decision(
    warn_score=0.5, warn_votes=3, pause_score=0.6, pause_votes=4, pause_consecutive=2, cancel_enabled=True, cancel_score=0.7, cancel_votes=5, cancel_consecutive=2, cooldown_s=86400.0, clear_ticks=2, warmup_s=0.0, action_mode="cancel"
)
CLASSES = [f"c{k}" for k in range(10)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with seconds and, per user, tick."""
    rows = table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return rows.withColumn("tick", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user: scores from values, gates from sign-ups (which end a print), file names that change with time."""
    state = F.when(F.col("event_type") == "signup", "complete").otherwise("printing")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("trace_id"), "tick", F.col("seconds").alias("ts"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p_raw"), (state != "printing").alias("gated"), state.alias("state"),
        F.concat(F.lit("f"), F.floor(F.col("event_id") / 2500).cast("string")).alias("filename"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded ticks per user, as a calibration run has them."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("trace_id"), "tick", F.col("seconds").alias("timestamp"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p_raw"), (F.col("event_type") != "signup").alias("gate_passed"), F.lit("blurred").alias("gate_reason")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: uid, source, stem, content hash, and a 60-bit hash of the whole text by its four quarters."""
    rows = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    quarter = F.ceil(F.length(text) / 4).cast("int")
    digits = [F.substring(F.md5(F.substr(text, quarter * k + 1, quarter).cast("binary")), 1, n) for k, n in enumerate((4, 4, 4, 3))]
    phash = F.conv(F.concat(*digits), 16, 10).cast("long")
    return rows.select(
        F.format_string("%s:%07d", "source", "doc_id").alias("uid"), "doc_id", "source", "lang", F.col("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), phash.alias("phash")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scored images: probabilities from ten dimensions, the true class from the label."""
    from ..functions.scalar import argmax, softmax

    x = F.transform(F.slice("embedding", 1, 10), lambda v: F.round(v.cast("double") * 8, 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", softmax(x).alias("probs"), argmax(x).alias("k"), x.alias("logits"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    # half of the rows have their own class as the prediction, so that there are hits
    pred = F.when(F.col("vec_id") % 2 == 0, name(F.col("label"))).otherwise(name(F.col("k")))
    return rows.select("vec_id", "probs", "logits", name(F.col("label")).alias("y_true"), pred.alias("y_pred"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("source"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, cluster, size: customers' orders by nation's region."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("n_regionkey").alias("label"), F.format_string("k%06d", "c_custkey").alias("cluster"), "size")
