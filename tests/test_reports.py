"""Reports, the service's batch pipeline and fetching."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.config import Settings
from emberline.operators import decision, reports
from emberline.operators.detections import ScriptedDetector
from emberline.sources import archives
from emberline.streaming import service


def test_classifier_report(spark):
    rows = [(k, t, p, s) for k, (t, p, s) in enumerate([("normal", [0.9, 0.1], "fdm"), ("bad", [0.2, 0.8], "fdm"), ("bad", [0.6, 0.4], "cam_v2"), ("bad", [0.1, 0.9], "cam_v2"), ("normal", [0.45, 0.55], "unknown")])]
    df = spark.createDataFrame(rows, "image_id long, y_true string, probs array<double>, source string")
    out = reports.classifier_report(df, ["normal", "bad"], "bad")
    assert out["top1"] == 0.6 and out["recall_gap"] == 0.5 and out["gap_size"] == "LARGE" and out["fit_for_pausing"] is False
    assert out["lowest_threshold"]["threshold"] == 0.6 and out["binary"]["fp"] == 1 and json.loads(reports.as_json(out))["class_order"] == ["normal", "bad"]
    with pytest.raises(ValueError):
        reports.classifier_report(df, ["normal", "bad"], "other")


def test_detector_report(spark):
    px = [0.0, 0.5, 1.0]
    curves = spark.createDataFrame([("a", px, [0.5, 0.9, 1.0], [1.0, 0.5, 0.1]), ("b", px, [0.1, 0.2, 0.99], [1.0, 0.1, 0.0])], "class string, px array<double>, precision array<double>, recall array<double>")
    instances = spark.createDataFrame([("a", f"i{k}", f"p{k}") for k in range(60)] + [("b", "i1", "p1")], "class string, image string, photo string")
    groups = spark.createDataFrame([(f"i{k}", f"g{k}") for k in range(60)], "image string, group string")
    out = {r["class"]: r for r in reports.detector_report(curves, instances, groups, ["a", "b", "c"], {"a": "catastrophic"}).collect()}
    assert out["a"]["threshold"] == 0.75 and not out["a"]["low_support"] and out["a"]["severity"] == "catastrophic"
    assert out["b"]["threshold"] is None and out["b"]["low_support"] and out["c"]["instances"] == 0 and out["c"]["severity"] == "cosmetic"
    images = spark.createDataFrame([(f"s1__{k}",) for k in range(25)] + [("s2__1",), ("plain",)], "filename string")
    manifest = spark.createDataFrame([], "filename string, source string")
    assert {r["source"] for r in reports.source_subsets(images, manifest).collect()} == {"s1"}
    recalls = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "class string, source string")
    assert tuple(reports.coverage(recalls).first()) == (["x", "y"], ["x"], False)
    assert "x" in reports.as_text(recalls)


def test_frames_to_decisions(spark):
    rng = np.random.default_rng(1)
    sharp = rng.integers(60, 200, (32, 32, 3), dtype=np.uint8)
    dark = np.zeros((32, 32, 3), np.uint8)
    image = lambda x: ("", 32, 32, 3, 16, x.tobytes())
    rows = [("t", k, 1000.0 + k, image(dark if k == 5 else sharp)) for k in range(12)]
    frames = spark.createDataFrame(rows, "trace_id string, tick long, ts double, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    states = spark.createDataFrame([("t", 1000.5, "printing", "a", 500.0), ("t", 1010.5, "complete", "a", 510.0)], "trace_id string, ts double, state string, filename string, elapsed_s double")
    s = Settings()
    joined = service.with_state(frames, states)
    found = service.ticks(joined, s, lambda: ScriptedDetector([0.9]), ["normal", "bad"], F.col("ts") + 1).orderBy("tick").collect()
    assert [r["gate_reason"] for r in found] == ["not_printing", *[None] * 4, "quality:too_dark", *[None] * 5, "not_printing"]
    assert all(r["detections"][0]["class_name"] == "bad" for r in found if not r["gated"])
    late = service.gated(frames, s, F.col("ts") + 9).select("quality").distinct().collect()
    assert [r["quality"] for r in late] == ["stale"]
    ticks = service.ticks(joined, s, lambda: ScriptedDetector([0.9]), ["normal", "bad"], F.col("ts") + 1)
    assert decision.decide(ticks.select("trace_id", "tick", "ts", "p_raw", "gated", "state", "filename"), {"c": s.decision}).count() == 12
    saved = service.recorded(joined, 3.0, most=3)
    assert saved.count() == 3 and service.recording_counts(joined, saved).first()["saved"] == 3
    polls = service.polled(frames.select("trace_id", "ts"), "trace_id", "ts", 4.0)
    assert [r["ts"] for r in polls.where("polls").orderBy("ts").collect()] == [1000.0, 1004.0, 1008.0]


def test_fetch_and_unpack(tmp_path):
    target = str(tmp_path / "d" / "x.zip")
    archive = tmp_path / "src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("data.yaml", "names: [a]\n")
    assert archives.fetched(target, lambda: iter([archive.read_bytes()])) and not archives.fetched(target, lambda: iter([b"other"]))

    def broken():
        yield b"x"
        raise OSError

    with pytest.raises(OSError):
        archives.fetched(str(tmp_path / "y"), broken)
    assert not (tmp_path / "y").exists()
    assert archives.unpacked(target, str(tmp_path / "out")) and not archives.unpacked(target, str(tmp_path / "out"))
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        archives.unpacked(str(bad), str(tmp_path / "other"))
