"""Similarity, components, groups, sessions, splits, metrics and rules against plain Python."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.operators import datasets, grouping, metrics, rules, similarity, splits
from emberline.operators.components import components

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def hashes(spark, values):
    return spark.createDataFrame([(f"u{k:04d}", None if h is None else signed(h)) for k, h in enumerate(values)], "uid string, phash long")


@pytest.mark.parametrize("d", [1, 3, 6])
def test_hamming_at_and_beyond(spark, d):
    rng = random.Random(d)
    base = [rng.getrandbits(64) for _ in range(8)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    values = base + [flip(h, d) for h in base] + [flip(h, d + 1) for h in base]
    found = {(r["a"], r["b"]) for r in similarity.hamming_pairs(hashes(spark, values), d).collect()}
    assert {(f"u{k:04d}", f"u{k + 8:04d}") for k in range(8)} <= found
    assert not {(f"u{k:04d}", f"u{k + 16:04d}") for k in range(8)} & found


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 255).map(lambda x: x * 0x0101010101010101)), max_size=30), st.integers(0, 8))
def test_hamming_is_complete(spark, values, d):
    found = {(r["a"], r["b"]) for r in similarity.hamming_pairs(hashes(spark, values), d).collect()}
    first = {}
    for k, h in enumerate(values):
        first.setdefault(h, f"u{k:04d}")
    want = {(first[h], f"u{k:04d}") for k, h in enumerate(values) if h is not None and first[h] != f"u{k:04d}"}
    if d > 0:
        want |= {tuple(sorted((first[a], first[b]))) for a, b in itertools.combinations({h for h in values if h is not None}, 2) if bin(a ^ b).count("1") <= d}
    assert found == want


def test_band_edges():
    assert [w for _, w in similarity.bands(6)] == [9, 9, 9, 10, 9, 9, 9]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@FEW
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert found == {k: v for k, v in brute_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}


def test_long_chain_and_nulls(spark):
    rows = [(k, k + 1) for k in range(100)] + [(None, 3), (5, None)]
    found = components(spark.createDataFrame(rows, "src long, dst long"))
    assert found.count() == 101 and found.select("component").distinct().count() == 1


def test_sessions(spark):
    stems = [f"cam_20260101_{t}" for t in ("000000", "000500", "001501", "010000")] + ["frame_0001", "frame_0004", "frame_0008", "plain", "x_99999999999999"]
    df = spark.createDataFrame([(s,) for s in stems], "stem string").withColumn("source", F.lit("s"))
    found = {r["stem"]: r["session"] for r in grouping.name_sessions(df, ["source"]).collect()}
    assert [found[s] for s in stems[:4]] == ["ts00000", "ts00000", "ts00001", "ts00002"]
    assert [found[s] for s in stems[4:7]] == ["seq:frame_|:00000", "seq:frame_|:00000", "seq:frame_|:00001"]
    assert "plain" not in found and found["x_99999999999999"].startswith("seq:")


def test_capture_sessions(spark):
    stems = ["Image_20260101000000123", "Image_20260101000000123_aug", "Image_20260101001001000", "odd"]
    found = {r["stem"]: r["session"] for r in grouping.capture_sessions(spark.createDataFrame([(s,) for s in stems], "stem string")).collect()}
    assert found[stems[0]] == found[stems[1]] == "session00000" and found[stems[2]] == "session00001" and found["odd"] == "unparsed:odd"


def image_records(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        h = rng.getrandbits(64)
        rows.append((f"a:{k:03d}", "a", f"p{k}", True, f"h{k}", signed(h)))
        if k % 5 == 0:
            rows.append((f"a:{k:03d}x", "a", f"p{k}", True, f"x{k}", signed(rng.getrandbits(64))))  # a sibling
        if k % 7 == 0:
            rows.append((f"b:{k:03d}", "b", f"q{k}", False, f"h{k}", signed(h)))  # the same pixels elsewhere
        if k % 11 == 0:
            rows.append((f"b:{k:03d}n", "b", f"r{k}", False, f"n{k}", signed(h ^ 0b101)))  # a near copy
    rows.append(("b:bad", "b", "bad", False, None, None))
    return spark.createDataFrame(rows, "uid string, source string, stem string, rf_matched boolean, content_hash string, phash long")


def test_groups_hold_linked_rows_together(spark):
    out = {r["uid"]: r["group"] for r in grouping.assign(image_records(spark), use_sessions=False).collect()}
    assert out["a:000"] == out["a:000x"] == out["b:000"] == out["b:000n"] and out["a:000"] == "g000000"
    assert out["a:001"] != out["a:002"] and len([g for g in out.values() if g == out["b:bad"]]) == 1
    assert sorted(set(out.values())) == [f"g{k:06d}" for k in range(len(set(out.values())))]


def test_merged_plan(spark):
    records = image_records(spark)
    plan = datasets.merged_plan(records, ["a", "b"], seed=3, use_sessions=False)
    grouping.assert_disjoint(plan.records)
    hashes_kept = [r[0] for r in plan.records.where("content_hash is not null").select("content_hash").collect()]
    assert len(hashes_kept) == len(set(hashes_kept)) and plan.records.where("source = 'b' and content_hash = 'h0'").count() == 0
    with pytest.raises(ValueError, match="too few"):
        datasets.merged_plan(records.where("uid < 'a:005'"), ["a"], use_sessions=False)
    again = datasets.merged_plan(records.orderBy(F.rand(9)), ["a", "b"], seed=3, use_sessions=False)
    key = lambda p: sorted((r["uid"], r["split"]) for r in p.records.collect())
    assert key(plan) == key(again)


def test_redundant_source_is_refused(spark):
    rows = [(f"a:{k}", "a", f"s{k}", False, f"a{k}", k * 7919) for k in range(20)] + [(f"b:{k}", "b", f"s{k}", False, f"b{k}", -k * 104729) for k in range(19)]
    records = spark.createDataFrame(rows, "uid string, source string, stem string, rf_matched boolean, content_hash string, phash long")
    with pytest.raises(ValueError, match="redundant"):
        datasets.merged_plan(records, ["a", "b"])


def test_binary_plan(spark):
    rng, rows = random.Random(4), []
    for k in range(80):
        h = rng.getrandbits(64)
        rows.append((f"train:{k:06d}", "train", k % 2, f"h{k}", signed(h)))
        if k % 9 == 0:
            rows.append((f"test:{k:06d}", "test", k % 2, f"h{k}", signed(h)))  # an exact copy
        if k % 10 == 0:
            rows.append((f"val:{k:06d}", "val", k % 2, f"n{k}", signed(h ^ 1)))  # a straddling near copy
        if k == 33:
            rows.append(("val:mixed", "val", 0, "m", signed(h ^ 2)))  # another label
    df = spark.createDataFrame(rows, "uid string, orig_split string, label int, content_hash string, phash long")
    plan = datasets.binary_plan(df)
    assert plan.reports["clusters"].first()["n"] == 80 and plan.reports["mixed"].count() == 1 and plan.reports["straddling"].count() == 9
    grouping.assert_disjoint(plan.records, "cluster")
    assert plan.records.where("cluster = 'train:000033'").count() == 0
    capped = datasets.binary_plan(df, cap=10)
    assert all(r["n"] <= 10 for r in capped.records.groupBy("label").agg(F.count("*").alias("n")).collect())


def test_class_plan(spark):
    rows = [("x", k % 2, f"g{k % 6}", f"s{k:03d}") for k in range(60)] + [("y", 0, f"h{k % 2}", f"t{k}") for k in range(10)]
    plan = datasets.class_plan(spark.createDataFrame(rows, "class string, priority int, group string, stem string"), {"x": 40, "y": 50})
    assert plan.records.where("class = 'x'").count() == 40 and plan.records.where("class = 'x' and priority = 0").count() == 30
    assert {r["split"] for r in plan.records.where("class = 'y'").select("split").distinct().collect()} == {"train"}
    verdicts = {r["class"]: r["verdict"] for r in rules.session_verdicts(plan.reports["sessions"]).collect()}
    assert verdicts == {"x": "weak", "y": "not_evaluated"}


def test_repair_and_allocation():
    assert splits.repaired({"train": ["a", "b", "c"]}) == {"train": ["a"], "val": ["c"], "test": ["b"]}
    assert splits.repaired({"train": ["a"], "val": ["b"]}) == {"train": ["a", "b"], "val": [], "test": []}
    assert splits.allocation(["b", "a", "c"], 8) == {"a": 3, "b": 3, "c": 2}
    with pytest.raises(ValueError):
        splits.check_ratios((0.5, 0.5, 0.5))


def test_stratified_needs_enough(spark):
    df = spark.createDataFrame([("a", k) for k in range(3)], "c string, k int")
    with pytest.raises(ValueError, match="too few"):
        splits.stratified(df, "c", "k", {"a": 4}, 1)


def test_metrics_on_empty_and_absent(spark):
    df = spark.createDataFrame([("normal", "normal"), ("spaghetti", "cracking"), ("spaghetti", "spaghetti")], "y_true string, y_pred string")
    out = {r["class"]: r for r in metrics.per_class(df, ["normal", "spaghetti", "cracking", "other"]).collect()}
    assert out["cracking"]["precision"] == 0.0 and out["other"]["recall"] == 0.0 and out["spaghetti"]["recall"] == 0.5 and out["spaghetti"]["f1"] == pytest.approx(2 / 3)
    assert metrics.top1(df.limit(0)).first()["accuracy"] == 0.0
    with pytest.raises(Exception, match="unknown class"):
        metrics.confusion(df, ["normal"]).collect()
    records = spark.createDataFrame([(True, 0.9, "a"), (True, 0.4, "b"), (False, 0.9, "a")], "is_argmax boolean, prob double, t string")
    points = metrics.sweep(records, [0.3, 0.5, 0.95], F.col("t") == "a")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in points.collect()}
    assert got == {0.3: (0.5, 0.5), 0.5: (1.0, 0.5), 0.95: (1.0, 0.0)}
    assert metrics.lowest_threshold(points, 0.95, 0.05).first().asDict() == {"threshold": 0.5, "vacuous_threshold": None}
    assert metrics.lowest_threshold(points, 0.95, 0.9).first().asDict() == {"threshold": None, "vacuous_threshold": 0.5}
    stats = metrics.variant_stats(spark.createDataFrame([], "g string"), "g").first()
    assert stats["num_rows"] == 0 and stats["p90"] == 0


def test_rule_engine(spark):
    counts = spark.createDataFrame([("train", 95), ("val", 3), ("test", 2)], "split string, n_images long")
    assert {r["subject"] for r in rules.split_balance(counts, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()} == {"val", "test"}
    stats = spark.createDataFrame([("s", 90, 10, 0, 5, False), ("r", 90, 5, 1, 5, True)], "source string, n_images long, n_groups long, n_missing_labels long, n_without_suffix long, is_reference boolean")
    found = {(r["rule"], r["subject"]) for r in rules.sources(stats).collect()}
    assert found == {("timelapse", "s"), ("timelapse", "r"), ("missing_labels", "r"), ("no_suffix", "s")}
    total = spark.createDataFrame([(50,)], "n long")
    full = spark.createDataFrame([(s, c, 9) for s in splits.SPLITS for c in ("a", "b")], "split string, class string, n long")
    assert not rules.scene_reasons(total, full, ["a", "b"]).first()["warn"]


@pytest.mark.parametrize("master, fine", [("local[8]", True), ("local", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_scratch_needs_a_shared_folder(master, fine):
    """Without spark.checkpoint.dir only a local session gets a folder."""
    from types import SimpleNamespace

    from emberline import scratch

    set_to = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: set_to.get("dir"), set=lambda k, v: set_to.update(dir=v)), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert scratch.folder(session).startswith("file:///")
    else:
        with pytest.raises(RuntimeError):
            scratch.folder(session)
