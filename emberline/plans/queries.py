"""The registered queries of the library's own operators."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, names, scalar
from ..operators import decision, detections, grouping, metrics, replay, rules, similarity, splits
from ..sources import files, printer
from ..streaming import service
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# the decision operator


@query
def decision_replay(spark, d):
    out = decision.decide(b.ticks(spark, d), {"one": b.SETTINGS})
    return out.select("trace_id", "tick", "action", "state", "score", "votes", "consecutive", "level", "gated")


@query
def replay_traces(spark, d):
    out = replay.replay(b.records(spark, d), {"one": dataclasses.replace(b.SETTINGS, action_mode="pause")}, F.lit(30))
    return out.select("trace_id", "n_ticks", "n_actions", "n_notify", "n_pause", "false_positives", "detected", F.round("duration_s", 3).alias("duration_s"), F.round("time_to_detect_s", 3).alias("time_to_detect_s"))


def _sweep(spark, d):
    base = dataclasses.replace(b.SETTINGS, action_mode="pause")
    return replay.rolled_up(replay.replay(b.records(spark, d), replay.grid(base, [0.55, 0.65], [4, 6], [0.35, 0.6]), F.lit(30)))


def _told(df):
    return df.select(
        "config", "n_traces", "total_ticks", "total_actions", "n_notify", "n_pause", "false_positives", F.round("total_hours", 4).alias("total_hours"), F.round("fp_per_hour", 6).alias("fp_per_hour"),
        F.round("mean_time_to_detect_s", 1).alias("mean_time_to_detect_s"), F.round("detected_fraction", 6).alias("detected_fraction"),
    )


@query
def replay_sweep(spark, d):
    return _told(_sweep(spark, d))


@query
def replay_best(spark, d):
    return _told(replay.best(_sweep(spark, d)))


@query
def actions_by_type(spark, d):
    kinds = replay.by_type(_sweep(spark, d)).select("config", F.explode("actions_by_type").alias("action", "n"))
    return kinds


@query
def ema_score(spark, d):
    rows = b.events(spark, d).select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    return decision.ema("p", 0.35, "event_id", "user_id", rows).select("user_id", "event_id", "score")


@query
def votes_and_runs(spark, d):
    rows = b.events(spark, d).select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("p_raw"))
    scored = rows.withColumn("score", F.col("p_raw"))
    out = decision.votes_and_runs(scored, b.SETTINGS, ["user_id"], "event_id")
    return out.select("user_id", "event_id", "votes", "warn_run", "pause_run", "cancel_run", "notify_edge")


@query
def identity_epochs(spark, d):
    return decision.epochs(b.ticks(spark, d), "trace_id", "tick", "state", "filename").select("trace_id", "tick", "epoch")


@query
def rate_limit(spark, d):
    rows = b.events(spark, d).select("user_id", "event_id", "seconds")
    return decision.rate_limited(rows, "user_id", "event_id", "seconds", 21600.0).select("user_id", "event_id", "sent")


@query
def asof_state(spark, d):
    """Each view with its user's latest purchase."""
    rows = b.events(spark, d).withColumn("ts", F.col("event_id"))
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.lit("printing").alias("state"), F.col("event_id").alias("filename"), F.col("value").alias("elapsed_s"))
    seen = service.with_state(rows.where("event_type = 'view'").select("user_id", "event_id", "ts"), bought, "user_id")
    return seen.select("user_id", "event_id", F.coalesce("filename", F.lit(-1)).alias("purchase_id"))


@query
def state_polls(spark, d):
    rows = b.table(spark, d, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("at"))
    return service.polled(rows, "user_id", "at", 500.0).select("user_id", F.col("at").cast("long").alias("event_id"), "polls")


@query
def recorded_frames(spark, d):
    """The first printing frame of each seven seconds, an event a second."""
    rows = b.table(spark, d, "events").select(F.col("event_id").cast("double").alias("ts"), F.when(F.col("event_type") == "signup", "paused").otherwise("printing").alias("state"))
    return service.recorded(rows, 7.0).select("ts", "state")


@query
def gate_reasons(spark, d):
    t = b.ticks(spark, d)
    reason = decision.gate_reason(F.col("state"), F.col("tick").cast("double"), F.col("p_raw") >= 0.05, F.lit("blurred"), 5.0)
    return t.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def clamped_actions(spark, d):
    rows = b.events(spark, d).select(F.when(F.col("value") > 80, "cancel").when(F.col("value") > 60, "pause").when(F.col("value") > 40, "notify").otherwise("none").alias("action"))
    modes = rows.select("action", F.explode(F.array(F.lit("notify_only"), F.lit("pause"), F.lit("cancel"))).alias("mode"))
    return modes.groupBy("mode", decision.clamp(F.col("action"), F.col("mode")).alias("clamped")).agg(F.count(F.lit(1)).alias("n"))


# gates and detections


@query
def quality_gate(spark, d):
    l = b.table(spark, d, "lineitem")
    reason = scalar.quality_gate(F.col("l_tax") * 100, F.col("l_quantity") * 5, F.col("l_discount") * 1000, 5.0, 20.0, 240.0, 45.0)
    return l.groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


DETECTION = "struct<class_id:int,class_name:string,confidence:double,bbox:array<double>,severity:string>"


def _detections(spark, d):
    l = b.table(spark, d, "lineitem")
    one = F.struct(
        F.col("l_linenumber").cast("int").alias("class_id"), F.col("l_returnflag").alias("class_name"), (F.col("l_quantity") / 50).alias("confidence"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_tax"), F.col("l_discount")).alias("bbox"),
        F.when(F.col("l_returnflag") == "R", "catastrophic").otherwise("cosmetic").alias("severity"),
    )
    return l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("detections"))


@query
def failure_scores(spark, d):
    rows = _detections(spark, d)
    top = scalar.top_detection("detections", DETECTION)
    return rows.select("l_orderkey", F.size(scalar.by_severity("detections", "cosmetic")).alias("n_cosmetic"), scalar.p_failure("detections").alias("p_failure"), F.coalesce(top["class_id"], F.lit(-1)).alias("top_class"))


@query
def classified_frames(spark, d):
    p = b.predictions(spark, d)
    found = detections.classified("probs", ["normal", *b.CLASSES[1:]], {"c3": 0.3, "c4": 0.05}, 0.12, {"c1": "catastrophic", "c3": "catastrophic"}, F.lit(640), F.lit(480))
    return p.select("vec_id", F.explode(found).alias("x")).select("vec_id", "x.class_id", "x.class_name", F.round("x.confidence", 6).alias("confidence"), "x.severity")


@query
def candidate_boxes(spark, d):
    l = b.table(spark, d, "lineitem")
    rows = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("frame_id"), F.array(F.col("l_quantity") * 2, F.col("l_tax") * 100, F.col("l_quantity") * 9, F.col("l_discount") * 5000).alias("box"), (F.col("l_quantity") / 50).alias("conf"),
        (F.col("l_linenumber") - 1).cast("double").alias("cls"), F.lit(0.5).alias("scale"), F.lit(4.0).alias("pad_x"), F.lit(0.0).alias("pad_y"), F.lit(640).alias("width"), F.lit(480).alias("height"),
    )
    out = detections.candidates(rows, ["a", "b", "c", "d"], {"a": 0.9, "b": 0.5}, 0.25, {"a": "catastrophic"}, raw=False)
    return out.groupBy("class_name", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("bbox", F.lit(0))), 2).alias("x1"), F.round(F.sum(F.get("bbox", F.lit(2))), 2).alias("x2"), F.round(F.sum(F.get("bbox", F.lit(3))), 2).alias("y2"))


@query
def raw_boxes(spark, d):
    """Candidates of the layout with centres and a score for each class."""
    rows = b.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("frame_id"), F.array(F.col("l_quantity") * 10, F.col("l_tax") * 1000, F.col("l_quantity") * 4, F.col("l_discount") * 2000).alias("box"),
        F.array(F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_discount") * 10).alias("scores"), F.lit(0.5).alias("scale"), F.lit(4.0).alias("pad_x"), F.lit(0.0).alias("pad_y"), F.lit(640).alias("width"), F.lit(480).alias("height"),
    )
    out = detections.candidates(rows, ["a", "b", "c"], {"a": 0.9}, 0.25, {"a": "catastrophic"}, raw=True)
    return out.groupBy("class_name", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("bbox", F.lit(0))), 2).alias("x1"), F.round(F.sum(F.get("bbox", F.lit(2))), 2).alias("x2"), F.round(F.sum(F.get("bbox", F.lit(3))), 2).alias("y2"))


@query
def suppressed_boxes(spark, d):
    l = b.table(spark, d, "lineitem")
    box = F.array(F.col("l_quantity"), F.col("l_quantity"), F.col("l_quantity") + 20, F.col("l_quantity") + 20)
    rows = l.select(F.col("l_orderkey").alias("frame_id"), F.lit(0).alias("class_id"), F.col("l_returnflag").alias("class_name"), (F.col("l_extendedprice") + F.col("l_linenumber") / 1000).alias("confidence"), box.alias("bbox"), F.lit("cosmetic").alias("severity"))
    return detections.suppressed(rows, 0.45).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_kept"))


# similarity, groups, splits


@query
def exact_dedupe(spark, d):
    docs = b.documents(spark, d)
    return splits.first_per(docs, ["content_hash"], ["uid"]).select("uid", "content_hash")


@query
def priority_dedupe(spark, d):
    docs = b.documents(spark, d)
    return splits.prioritised(docs, ["src3", "src1", *[f"src{k}" for k in (0, 2, *range(4, 20))]]).select("uid", "source")


@query
def hamming_pairs(spark, d):
    return similarity.hamming_pairs(b.documents(spark, d), 6).select("a", "b")


def _clustered(spark, d):
    return grouping.cluster(splits.first_per(b.documents(spark, d), ["content_hash"], ["uid"]), 6)


@query
def near_clusters(spark, d):
    return _clustered(spark, d).select("uid", "cluster")


@query
def cluster_sizes(spark, d):
    return grouping.cluster_sizes(_clustered(spark, d))


@query
def straddling_clusters(spark, d):
    return grouping.straddling(_clustered(spark, d), "source").select("cluster", F.concat_ws(",", "splits").alias("splits"))


@query
def mixed_clusters(spark, d):
    rows = _clustered(spark, d).join(b.table(spark, d, "labels"), "doc_id")
    return grouping.mixed(rows, "quality").select("cluster", F.size("labels").alias("n"))


@query
def component_groups(spark, d):
    """Documents linked by equal texts or by source and length, by smallest uid."""
    docs = b.documents(spark, d)
    edges = grouping.stars(docs, ["content_hash"]).unionByName(grouping.stars(docs, ["source", "lang", "n_chars"]))
    from ..operators.components import components

    found = components(edges, "a", "b").select(F.col("node").alias("uid"), F.col("component").alias("root"))
    rooted = docs.join(found, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    return grouping.numbered(rooted, "root", "group").select("uid", "group")


@query
def assigned_groups(spark, d):
    """Documents linked by equal texts, near hashes or as siblings."""
    docs = b.documents(spark, d).withColumn("stem", F.floor(F.col("doc_id") / 3).cast("string")).withColumn("rf_matched", F.col("doc_id") % 2 == 0)
    return grouping.assign(docs, use_sessions=False).select("uid", "group")


def _stems(spark, d):
    """Names with a time in them, and names with a number."""
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)"), "yyyyMMddHHmmss")
    timed, numbered = F.concat(F.lit("Image_"), stamp, F.lit("123")), F.concat(F.lit("cam"), F.col("o_custkey") % 5, F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return b.table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("source"), F.when(F.col("o_orderkey") % 2 == 1, timed).otherwise(numbered).alias("stem"))


@query
def name_groups(spark, d):
    return grouping.name_sessions(_stems(spark, d), ["source"], 86400.0, 30).select("source", "stem", "session")


@query
def capture_groups(spark, d):
    return grouping.capture_sessions(_stems(spark, d), 7200.0).groupBy("stem", "session").agg(F.count(F.lit(1)).alias("n"))


@query
def group_split(spark, d):
    return splits.ratio_split(b.documents(spark, d), "content_hash", 7, (0.6, 0.25, 0.15))


@query
def split_overlaps(spark, d):
    docs = b.documents(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"))
    return grouping.overlaps(docs, "content_hash", "split").select(F.col("content_hash"), F.concat_ws(",", "splits").alias("splits"))


@query
def greedy_allocation(spark, d):
    return splits.allocated(b.clusters(spark, d), (0.7, 0.15, 0.15), 7)


@query
def capped_clusters(spark, d):
    return splits.capped(b.clusters(spark, d), 500, 7)


@query
def overlap_matrix(spark, d):
    sets = similarity.stem_sets(b.documents(spark, d), "source", "content_hash")
    return similarity.overlap(sets)


@query
def contained_sources(spark, d):
    l = b.table(spark, d, "lineitem")
    sets = similarity.stem_sets(l.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 6).cast("string")).alias("source"), (F.col("l_partkey") % 90).alias("stem")))
    return similarity.contained(sets, 90.0)


@query
def collision_matrix(spark, d):
    docs = b.documents(spark, d).select(F.col("content_hash").alias("set_id"), "source")
    return similarity.collisions(docs, "exact")


@query
def believed_sessions(spark, d):
    docs = b.documents(spark, d).select("uid", F.col("source").alias("session"), F.floor(F.col("doc_id") / 2).cast("string").alias("stem"), F.col("phash").bitwiseAND(F.lit(0x0F0F0F000000FFFF)).alias("phash"))
    return similarity.believed(docs, 0.02, 6).select("session", "n_stems", F.round("share", 6).alias("share"), "believed")


@query
def sessionize_time(spark, d):
    rows = b.events(spark, d)
    return grouping.sessions(rows, ["user_id"], ["seconds", "event_id"], F.col("seconds"), 21600.0).select("user_id", "event_id", "session")


@query
def sessionize_sequence(spark, d):
    rows = b.table(spark, d, "orders")
    return grouping.sessions(rows, ["o_custkey"], ["o_orderkey"], F.col("o_orderkey"), 900).select("o_custkey", "o_orderkey", "session")


@query
def representatives(spark, d):
    return splits.representatives(b.documents(spark, d), "content_hash", "uid", "seeded", 1337)


@query
def sampled(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", "p_brand")
    return splits.sample_k(rows, "p_partkey", 3, 11, ["p_brand"])


@query
def stratified_sample(spark, d):
    rows = b.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    classes = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    there = [r[0] for r in rows.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    return splits.stratified(rows, "c_mktsegment", "c_custkey", splits.allocation(there or classes, 42), 11)


@query
def budgeted_selection(spark, d):
    rows = b.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("priority"))
    return splits.budgeted(rows, "priority", "o_orderkey", 200, 11)


@query
def split_files(spark, d):
    rows = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.format_string("%08d_%d", F.col("l_orderkey"), F.col("l_linenumber").cast("int")).alias("name"))
    parts = splits.ratio_split(rows, "group", 5, (0.7, 0.15, 0.15))
    return splits.split_files(rows, parts, "group", "name").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query
def split_tallies(spark, d):
    rows = b.documents(spark, d).withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "val").otherwise("test"))
    return splits.tallies(rows, "split", "lang", "source", ["de", "en", "es", "fr"])


@query
def balanced_batches(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", F.concat(F.lit("c"), (F.col("p_partkey") % 4 % 3).cast("string")).alias("cls"))
    return splits.round_robin(rows, "cls", "p_partkey", 8, 8, 3).select("step", "slot", "cls", "p_partkey")


@query
def pooled_union(spark, d):
    orders = b.table(spark, d, "orders").select(F.col("o_custkey").alias("filename"), F.col("o_orderkey").alias("v"))
    first, second = orders.where("o_orderkey % 2 = 0").groupBy("filename").agg(F.min("v").alias("v")), orders.where("o_orderkey % 2 = 1").groupBy("filename").agg(F.min("v").alias("v"))
    return files.pooled([(0, first), (1, second)]).select("filename", "v", "split_rank", "n_copies")


# evaluation


@query
def confusion_matrix(spark, d):
    return metrics.confusion(b.predictions(spark, d), b.CLASSES)


@query
def top1_accuracy(spark, d):
    return metrics.top1(b.predictions(spark, d))


@query
def per_class_metrics(spark, d):
    out = metrics.per_class(b.predictions(spark, d), b.CLASSES)
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support", "predicted_count")


@query
def macro_f1(spark, d):
    return metrics.macro_f1(b.predictions(spark, d), b.CLASSES).select(F.round("macro_f1", 9).alias("macro_f1"))


@query
def binary_metrics(spark, d):
    p = b.predictions(spark, d)
    defect = lambda c: scalar.binary_label(F.concat(F.lit(" "), F.upper(F.col(c))), "c0") == "defect"
    out = metrics.binary(p, defect("y_true"), defect("y_pred"))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")])


def _points(spark, d):
    p = b.predictions(spark, d).withColumn("prob", F.round(F.get("probs", F.lit(1)), 6)).withColumn("is_argmax", scalar.argmax("logits") == 1)
    return metrics.sweep(p, scalar.thresholds(0.05, 0.95, 0.05), F.col("y_true") == "c1")


@query
def threshold_sweep(spark, d):
    return _points(spark, d).select("threshold", "tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query
def lowest_threshold(spark, d):
    return metrics.lowest_threshold(_points(spark, d), 0.2, 0.05)


@query
def best_operating_point(spark, d):
    return metrics.best_point(_points(spark, d), 0.02).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query
def recall_by_source(spark, d):
    out = metrics.recall_by(b.predictions(spark, d), "source", F.col("y_true") == F.col("y_pred"))
    return out.withColumn("recall", F.round("recall", 9))


def _gaps(spark, d):
    rows = b.predictions(spark, d).groupBy(F.col("y_true").alias("class"), "source").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return rows, metrics.shared_gaps(rows)


@query
def shared_recall_gaps(spark, d):
    return _gaps(spark, d)[1].select("class", "n_sources", F.round("gap", 9).alias("gap"))


@query
def confound_verdict(spark, d):
    rows, gaps = _gaps(spark, d)
    by_source = metrics.recall_by(b.predictions(spark, d), "source", F.col("y_true") == F.col("y_pred"))
    return metrics.confound_verdict(by_source, gaps).select("n_measured", "n_shared", F.round("worst_gap", 9).alias("worst_gap"), "verdict")


@query
def pausing_verdict(spark, d):
    by_source = metrics.recall_by(b.predictions(spark, d), "source", F.col("y_true") == F.col("y_pred"))
    gap = metrics.recall_range(by_source).join(by_source.agg(F.count(F.lit(1)).alias("n"))).join(metrics.lowest_threshold(_points(spark, d), 0.2, 0.05))
    return gap.select(F.round("gap", 9).alias("gap"), metrics.gap_size(F.col("gap"), F.col("n")).alias("size"), metrics.fit_for_pausing(F.col("threshold"), F.col("gap")).alias("fit"))


@query
def class_support(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("photo"))
    return metrics.class_support(l, ["A", "N", "R", "X"])


@query
def class_group_support(spark, d):
    l = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_orderkey").alias("image"))
    groups = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("group"))
    return metrics.group_support(l, groups)


@query
def variant_stats(spark, d):
    return metrics.variant_stats(b.table(spark, d, "orders"), "o_custkey")


@query
def score_gap(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("deduped"), (F.col("p_partkey") % 50 / 50).alias("raw"))
    return rows.select("p_partkey", metrics.map_gap(F.col("deduped"), F.col("raw")).alias("g")).select("p_partkey", F.round("g.absolute", 9).alias("absolute"), F.round("g.relative", 9).alias("relative"), "g.significant", "g.optimistic")


@query
def curve_values(spark, d):
    curve = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("class"), (F.col("p_size") / 50).alias("x")).agg(F.min("p_partkey").cast("double").alias("y"))
    at = spark.createDataFrame([(t,) for t in (0.05, 0.3, 0.42, 0.61, 0.9)], "threshold double")
    return metrics.interpolated(curve, at).select("class", "threshold", F.round("value", 6).alias("value"))


@query
def curve_summary(spark, d):
    rows = b.table(spark, d, "part").select((F.col("p_partkey") % 4).alias("k"), F.col("p_name").alias("n"), F.col("p_size").cast("double").alias("v"), "p_partkey")
    arrays = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "n", "v"))).alias("a")).select("k", F.col("a.n").alias("classes"), F.col("a.v").alias("ap"))
    return metrics.curve_summary(arrays, ["ap"])


# rules


@query
def split_rules(spark, d):
    docs = b.documents(spark, d).withColumn("split", F.when(F.col("doc_id") % 20 < 18, "train").when(F.col("doc_id") % 20 == 18, "val").otherwise("test"))
    counts = docs.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"))
    return rules.split_balance(counts, {"train": 0.7, "val": 0.15, "test": 0.15}).select("rule", "subject")


@query
def class_rules(spark, d):
    docs = b.documents(spark, d).withColumn("split", F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") != "es"), "val").when(F.col("doc_id") % 3 == 1, "test").otherwise("train"))
    counts = docs.groupBy("split", F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rules.class_coverage(counts, ["de", "en", "es", "fr", "it"])


@query
def source_rules(spark, d):
    docs = b.documents(spark, d)
    stats = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_images"), F.countDistinct(F.floor(F.col("doc_id") / 80)).alias("n_groups"), F.count_if(F.col("n_chars") < 100).alias("n_missing_labels"), F.count_if(F.col("lang") == "fr").alias("n_without_suffix"))
    return rules.sources(stats.withColumn("is_reference", F.col("source") == "src0"))


@query
def scene_rules(spark, d):
    docs = b.documents(spark, d)
    total = docs.agg(F.countDistinct("source").alias("n"))
    per = docs.groupBy(F.when(F.col("doc_id") % 50 == 0, "train").otherwise("val").alias("split"), F.col("lang").alias("class")).agg(F.countDistinct("source").alias("n"))
    return rules.scene_reasons(total, per, ["en", "es"])


@query
def session_rules(spark, d):
    docs = b.documents(spark, d)
    reports = docs.groupBy(F.col("source").alias("class")).agg(F.countDistinct(F.floor(F.col("doc_id") / 200)).alias("n_sessions"), F.countDistinct(F.when(F.col("doc_id") % 9 == 0, F.floor(F.col("doc_id") / 400))).alias("n_val"), F.countDistinct(F.when(F.col("doc_id") % 13 == 0, F.floor(F.col("doc_id") / 400))).alias("n_test"))
    return rules.session_verdicts(reports)


@query
def data_rules(spark, d):
    """Every rule over one set of inputs, as (rule, subject, message)."""
    docs = b.documents(spark, d)
    matrix = similarity.collisions(docs.select(F.col("content_hash").alias("set_id"), "source"), "exact").withColumn("near", F.lit(0))
    remaps = b.table(spark, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.element_at(F.split("p_type", " "), 1).alias("name"))
    remaps = remaps.select("source", "name", names.mapped_class("name", {"economy": "warping", "large": None})["outcome"].alias("outcome"))
    specs = b.table(spark, d, "region").select(
        F.col("r_name").alias("source"), F.when(F.col("r_regionkey") == 1, "CC BY-NC 4.0").otherwise("MIT").alias("licence"), F.when(F.col("r_regionkey") == 2, "mit ").when(F.col("r_regionkey") == 3, "GPL").alias("declared"),
        F.col("r_regionkey").isin(1, 4).alias("noncommercial"), (F.col("r_regionkey") != 1).alias("included"),
    )
    return rules.together([rules.collisions(matrix), rules.classes(remaps), rules.licences(specs), rules.provenance_note(docs)])


# files, names, texts


@query
def retention(spark, d):
    rows = b.events(spark, d).select(F.concat(F.lit("f"), "event_id").alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))
    from datetime import UTC, datetime

    newest = rows.agg(F.max("modificationTime")).first()[0]
    return files.to_prune(rows, newest.replace(tzinfo=UTC) if newest.tzinfo is None else datetime.fromtimestamp(newest.timestamp(), UTC), 20.0, 100)


@query
def event_log(spark, d):
    """Events through JSON and back."""
    from ..schemas import EVENT

    rows = b.events(spark, d)
    found = F.array(F.struct(F.lit(1).alias("class_id"), F.col("event_type").alias("class_name"), F.col("value").alias("confidence"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"), F.lit("cosmetic").alias("severity")))
    event = F.struct(
        F.col("seconds").alias("timestamp"), F.lit("notify").alias("action"), F.lit("warning").alias("state"), F.col("value").alias("score"), F.col("value").alias("p_raw"), F.col("tick").cast("int").alias("votes"), F.lit(None).cast("string").alias("reason"),
        F.col("event_type").alias("class_name"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("frame_path"), F.lit("a.gcode").alias("print_filename"), F.lit(1.5).alias("elapsed_s"), found.alias("detections"),
    )
    back = rows.select("event_id", F.from_json(F.to_json(event), EVENT).alias("e"))
    return back.select("event_id", "e.score", "e.votes", "e.class_name", F.get("e.detections", F.lit(0))["confidence"].alias("confidence"), F.get(F.get("e.detections", F.lit(0))["bbox"], F.lit(2)).alias("x2"))


@query
def printer_states(spark, d):
    rows = b.events(spark, d)
    name = F.when(F.col("event_type") == "view", "printing").when(F.col("event_type") == "click", "paused").when(F.col("event_type") == "purchase", "dancing").otherwise("complete")
    stats = F.struct(name.alias("state"), F.concat(F.lit("f"), "user_id").alias("filename"), F.col("value").alias("print_duration"))
    body = F.to_json(F.struct(F.struct(F.struct(stats.alias("print_stats"), F.struct((F.col("value") / 1000).alias("progress")).alias("virtual_sdcard")).alias("status")).alias("result")))
    body = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(body)
    state = printer.parsed_state(F.when(F.col("event_id") % 11 == 0, 500).otherwise(200), body, F.col("seconds"))
    return rows.select(state.alias("s")).groupBy("s.state").agg(F.count(F.lit(1)).alias("n"), F.count("s.filename").alias("n_files"), F.round(F.sum("s.elapsed_s"), 3).alias("elapsed"))


def _names(spark, d):
    o = b.table(spark, d, "orders")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)"), "yyyyMMddHHmmss")
    k = F.col("o_orderkey") % 7
    name = (
        F.when(k == 0, F.concat(F.lit("Image_"), stamp, F.lit("123_aug.jpg"))).when(k == 1, F.concat(F.lit("cam_"), F.substring(stamp, 1, 8), F.lit("_"), F.substring(stamp, 9, 6), F.lit(".PNG")))
        .when(k == 2, F.concat(F.lit("frame_"), F.col("o_orderkey"), F.lit(".rf.0a1b2c3d.jpg"))).when(k == 3, F.concat(F.lit("cam_v2_x"), F.col("o_orderkey"), F.lit("__y.jpeg")))
        .when(k == 4, F.concat(F.lit("bad_99999999999999_"), F.col("o_custkey"), F.lit(".jpg"))).when(k == 5, F.concat(F.lit("fdm_"), F.col("o_clerk") if "o_clerk" in o.columns else F.lit("plain"), F.lit("_original_aug")))
        .otherwise(F.concat(F.lit("s.dotted."), F.col("o_orderkey"), F.lit("-end.jpg")))
    )
    return o.select("o_orderkey", name.alias("name"))


@query
def name_keys(spark, d):
    n = _names(spark, d)
    return n.select("o_orderkey", names.source_id("name").alias("source_id"), names.has_suffix("name").alias("matched"), names.capture_key(names.stem("name")).alias("capture_key"), names.export_key(names.stem("name")).alias("export_key"), names.prefix_source("name", {"cam_v2_": "cam_v2"}).alias("origin"))


@query
def name_times(spark, d):
    n = _names(spark, d)
    t = names.name_timestamp(names.stem("name"))
    c = names.capture_timestamp(names.stem("name"))
    return n.select("o_orderkey", F.coalesce(F.unix_seconds(t), F.lit(-1)).alias("seconds"), F.coalesce(F.unix_seconds(c), F.lit(-1)).alias("capture_seconds"))


@query
def name_sequences(spark, d):
    s = names.sequence_key(names.stem("name"))
    return _names(spark, d).select("o_orderkey", s["family"].alias("family"), s["number"].cast("long").alias("number")).where("family is not null")


@query
def manifest_sources(spark, d):
    n = _names(spark, d)
    listed = F.when(F.col("o_orderkey") % 4 == 0, "listed").when(F.col("o_orderkey") % 4 == 1, "")
    return n.groupBy(names.manifest_source(listed, "name").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query
def first_addresses(spark, d):
    """The first address of each split in a JSON index."""
    k = F.col("o_orderkey").cast("string")
    index = F.concat(F.lit('{"default": {"train": ["https://h/'), k, F.lit('/0", "https://h/1"], "val": ['), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"https://h/v'), k, F.lit('"'))).otherwise(""), F.lit("]}}"))
    urls = F.explode(files.first_urls(index, "default")).alias("u")
    return b.table(spark, d, "orders").select("o_orderkey", urls).select("o_orderkey", "u.split", "u.url")


@query
def file_summary(spark, d):
    path = F.concat(F.lit("r/d"), F.col("o_orderkey") % 5, F.lit("/f.x"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, ".JPG").otherwise(".png"))
    return files.summary(b.table(spark, d, "orders").select(path.alias("path")))


@query
def collision_names(spark, d):
    rows = b.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("img"), F.col("o_custkey"), F.lit(".jpg")).alias("name"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("o_orderkey")) - 1
    return rows.select("o_orderkey", names.collision_name("name", rank).alias("output"))


@query
def class_keys(spark, d):
    p = b.table(spark, d, "part")
    raw = F.concat(F.lit(" "), F.upper("p_type"), F.when(F.col("p_partkey") % 2 == 0, "_-").otherwise("./ "))
    key = names.class_key(raw)
    mapped = names.mapped_class(F.element_at(F.split("p_type", " "), 1), {"economy": "warping", "large": None})
    return p.groupBy(key.alias("key"), mapped["outcome"].alias("outcome"), mapped["class"].alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def softmax_argmax(spark, d):
    p = b.predictions(spark, d)
    return p.select("vec_id", scalar.argmax("probs").alias("k"), F.round(F.array_max("probs"), 6).alias("top"), F.round(F.array_max(scalar.probabilities("probs")), 6).alias("kept"), scalar.arrays_agree("probs", scalar.softmax("logits")).alias("agree"))


def _labels(spark, d):
    l = b.table(spark, d, "lineitem")
    k = F.col("l_linenumber")
    s = lambda c: F.format_string("%.4f", F.col(c).cast("double") if c != "l_quantity" else (F.col("l_quantity") / 50).cast("double"))
    line = (
        F.when(k == 1, F.concat_ws(" ", F.lit("2"), s("l_quantity"), s("l_tax"), s("l_discount"), F.lit("0.5"))).when(k == 2, F.concat_ws(" ", F.lit("1"), s("l_quantity"), s("l_tax"), F.lit("0.9"), s("l_discount"), F.lit("1.2"), F.lit("0.7")))
        .when(k == 3, F.lit("0 0.5 0.5 0 0.2")).when(k == 4, F.lit("  ")).when(k == 5, F.lit("1 x 0.5 0.5 0.5")).otherwise(F.lit("3 0.1 0.2"))
    )
    return l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


@query
def label_rows(spark, d):
    n = labels.normalised("text")
    return _labels(spark, d).select(
        "l_orderkey", F.size(n["rows"]).alias("n_rows"), n["malformed"].alias("malformed"), n["degenerate"].alias("degenerate"), n["polygons"].alias("polygons"), labels.has_class("text", 1).alias("has_1"),
        F.round(F.aggregate(n["rows"], F.lit(0.0), lambda a, r: a + r["x1"] + 2 * r["y1"] + 3 * r["x2"] + 4 * r["y2"]), 6).alias("digest"),
    )


@query
def label_classes(spark, d):
    kept = labels.remapped(labels.normalised("text")["rows"], {2: 0, 1: 1})
    rows = _labels(spark, d).select("l_orderkey", F.explode(F.transform(kept, lambda r: r["cls"])).alias("cls"))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query
def formats(spark, d):
    o = b.table(spark, d, "orders")
    share = F.when(F.col("o_orderkey") % 60 != 0, F.floor(F.col("o_totalprice")) % 100 / 128)
    return o.select("o_orderkey", scalar.percent(share).alias("percent"), scalar.redacted_url(F.concat(F.lit("https://h/"), "o_orderkey")).alias("url"), scalar.frame_name(F.col("o_orderdate").cast("timestamp")).alias("frame"), scalar.hash_hex("o_orderkey").alias("hex"))


@query
def schedules(spark, d):
    p = b.table(spark, d, "part")
    step = F.col("p_partkey").cast("double")
    return p.select("p_partkey", F.round(scalar.cosine_schedule(step, 1000, 100, 0.01), 9).alias("rate"), F.round(scalar.ema_decay(step, 0.98), 9).alias("decay"))


@query
def confidence_order(spark, d):
    rows = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("int").alias("class_id"), F.col("l_returnflag").alias("class_name"), F.col("l_extendedprice").alias("confidence"), F.array(F.lit(0.0)).alias("bbox"), F.lit("cosmetic").alias("severity"))
    return detections.per_frame(rows).select("frame_id", F.concat_ws(",", F.transform("detections", lambda x: x["class_id"].cast("string"))).alias("order"))
