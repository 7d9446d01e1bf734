"""Scenarios of the decision operator, the fold against windows, and stream against batch."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from emberline.config import Decision
from emberline.operators import decision, replay
from emberline.operators.decision import Machine

BASE = Decision(warmup_s=60.0, action_mode="pause")


def play(ps, config=BASE, gate=lambda k: False, state=lambda k: ("printing", "a"), dt=1.0):
    m, out = Machine(config), []
    for k, p in enumerate(ps):
        m.identity(*state(k))
        out.append(m.tick(p, 1.7e9 + k * dt, gate(k)))
    return out


def test_noise_never_pauses():
    rng = random.Random(11)
    ps = [rng.uniform(0.85, 0.99) if rng.random() < 0.01 else rng.betavariate(2, 20) for _ in range(10_000)]
    assert not {r[0] for r in play(ps)} & {"pause", "cancel"}


@pytest.mark.parametrize("spikes", [(30,), (30, 31)])
def test_spikes_do_nothing(spikes):
    assert {r[0] for r in play([0.99 if k in spikes else 0.05 for k in range(60)])} == {"none"}


def test_sustained_failure_pauses_once():
    out = play([0.95] * 400, dt=0.5)
    first = [r[0] for r in out].index("pause")
    assert first <= 25 and [r[0] for r in out].count("pause") == 1
    assert out[first][1] == "triggered" and out[first + 1][1] == "cooldown"


def test_rearm_needs_time_and_clear_ticks():
    short = play([0.95] * 20 + [0.0] * 400 + [0.95] * 40)
    assert [r[0] for r in short].count("pause") == 2
    assert [r[0] for r in play([0.95] * 20 + [0.0] * 10 + [0.95] * 40)].count("pause") == 1


def test_gated_ticks_change_nothing():
    plain = play([0.9] * 30)
    gated = play([0.9 if k % 2 == 0 else 0.0 for k in range(60)], gate=lambda k: k % 2 == 1, dt=0.5)
    assert [r[:3] for r in gated[::2]] == [r[:3] for r in plain]
    assert all(r[0] == "none" and r[4] == 0 for r in gated[1::2])


@pytest.mark.parametrize(
    "before, after, resets",
    [
        (("printing", "a"), ("printing", "b"), True), (("printing", "a"), ("printing", None), False), (("printing", "a"), (None, None), False), (("printing", "a"), ("unknown", "a"), False),
        (("printing", "a"), ("paused", "a"), False), (("printing", "a"), ("complete", "a"), True), (("paused", "a"), ("complete", "a"), False), (("printing", None), ("printing", "b"), False),
    ],
)
def test_identity(before, after, resets):
    out = play([0.9] * 11, state=lambda k: before if k < 10 else after)
    assert (out[10][2] < out[9][2]) == resets


def test_nothing_between_hides_a_change():
    out = play([0.9] * 12, state=lambda k: ("printing", "a") if k < 10 else (None, None) if k == 10 else ("printing", "b"))
    assert out[11][2] > out[9][2]


@pytest.mark.parametrize("mode, action, level", [("notify_only", "notify", "pause"), ("pause", "pause", "pause"), ("cancel", "pause", "pause")])
def test_clamp(mode, action, level):
    out = play([0.95] * 30, dataclasses.replace(BASE, action_mode=mode))
    fired = next(r for r in out if r[1] == "triggered")
    assert fired[0] == action and fired[5] == level


def test_cancel_level():
    c = dataclasses.replace(BASE, cancel_enabled=True, action_mode="cancel", pause_consecutive=50, cancel_score=0.8)
    assert "cancel" in {r[0] for r in play([0.95] * 40, c)}
    assert "cancel" not in {r[0] for r in play([0.95] * 40, dataclasses.replace(c, cancel_enabled=False))}


def ticks(spark, n=300, keys=3, seed=5):
    rng = random.Random(seed)
    rows = [(f"t{k}", i, 1.7e9 + i, rng.random(), rng.random() < 0.1, "printing" if rng.random() < 0.97 else "complete", f"f{i // 120}") for k in range(keys) for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, tick long, ts double, p_raw double, gated boolean, state string, filename string")


def test_fold_equals_windows(spark):
    c = dataclasses.replace(BASE, warn_score=0.45, warn_votes=3, pause_score=0.5, pause_votes=4)
    rows = ticks(spark).withColumn("state", F.lit("printing")).withColumn("filename", F.lit("f"))
    fold = decision.decide(rows, {"c": c})
    windows = decision.votes_and_runs(fold.where("not gated"), c, ["trace_id"], "tick")
    both = fold.where("not gated").select("trace_id", "tick", F.col("votes").alias("v"), "action", "state", "consecutive").join(windows.select("trace_id", "tick", "votes", "warn_run", "notify_edge"), ["trace_id", "tick"])
    assert both.where("v <> votes").count() == 0
    assert both.where("state in ('armed', 'warning') and (consecutive <> warn_run or (action = 'notify') <> notify_edge)").count() == 0


def test_order_of_rows_does_not_matter(spark):
    rows = ticks(spark)
    a = decision.decide(rows, {"c": BASE}).orderBy("trace_id", "tick").collect()
    assert a == decision.decide(rows.orderBy(F.rand(3)).repartition(7), {"c": BASE}).orderBy("trace_id", "tick").collect()


def test_replay_counts(spark):
    rows = [("a", i, 1.7e9 + 60 * i, 0.0 if i < 40 else 0.95, True, None) for i in range(80)] + [("b", i, 1.7e9 + 60 * i, 0.05, True, None) for i in range(30)]
    df = spark.createDataFrame(rows, "trace_id string, tick long, timestamp double, p_raw double, gate_passed boolean, gate_reason string")
    out = {r["trace_id"]: r for r in replay.replay(df, {"c": BASE}, F.when(F.col("trace_id") == "a", 40)).collect()}
    assert out["a"]["detected"] and out["a"]["false_positives"] == 0 and out["a"]["time_to_detect_s"] > 0
    assert out["b"]["detected"] is None and out["b"]["n_actions"] == 0 and out["b"]["duration_s"] == 29 * 60
    rolled = replay.by_type(replay.rolled_up(replay.replay(df, {"c": BASE}, F.lit(40)))).first()
    assert rolled["n_traces"] == 2 and rolled["detected_fraction"] == 0.5 and set(rolled["actions_by_type"]) == {"notify", "pause"}
    missing = replay.replay(df.where("tick <> 40"), {"c": BASE}, F.lit(40)).where("trace_id = 'a'").first()
    assert missing["detected"] and missing["time_to_detect_s"] is None


def test_rate_limit(spark):
    df = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate((0, 5, 10, 19, 20, 31))], "k string, i long, s double")
    assert [r["sent"] for r in decision.rate_limited(df, "k", "i", "s", 10.0).orderBy("i").collect()] == [True, False, True, False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    from emberline.streaming import monitor

    rows = ticks(spark, 120, 2)
    for k in range(4):
        rows.where(f"tick >= {30 * k} and tick < {30 * (k + 1)}").coalesce(1).write.mode("append").json(str(tmp_path / f"in{k}"))
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    batch = decision.decide(rows, {"c": BASE}).drop("config")
    out, query = str(tmp_path / "out"), None
    for k in range(4):  # a restart between files: state comes back from the checkpoint
        for f in os.listdir(tmp_path / f"in{k}"):
            if f.endswith(".json"):
                shutil.copy(tmp_path / f"in{k}" / f, tmp_path / "in" / f"{k}{f}")
        stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
        query = monitor.decide_stream(stream, BASE).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
    key = ["trace_id", "tick"]
    assert spark.read.parquet(out).orderBy(*key).collect() == batch.orderBy(*key).collect()


def test_actions_sink(spark, tmp_path):
    from emberline.streaming.monitor import Actions

    done = []

    def fails(row):
        done.append(("notify", row["tick"]))
        raise OSError

    sink = Actions(str(tmp_path / "log"), fails, lambda: done.append("pause") or True, lambda: True, every=1, prune=lambda: done.append("prune") or 0)
    df = spark.createDataFrame([(1, 1.0, "none"), (3, 3.0, "pause"), (2, 2.0, "notify")], "tick long, ts double, action string")
    sink(df, 0)
    assert done == [("notify", 2), ("notify", 3), "pause", "prune"]
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    dry = Actions(str(tmp_path / "dry"), fails, lambda: True, lambda: True, dry_run=True)
    dry(df, 0)
    assert len(done) == 4 and spark.read.json(str(tmp_path / "dry")).count() == 2
