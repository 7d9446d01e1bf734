"""Settings: typed sections, loading with environment references, and cross-field rules.

A settings document is a mapping of sections. Unknown sections and keys are
refused; a string that is exactly `env:NAME` stands for that environment
variable (null when unset). `check` applies the rules and raises at the first
that fails; a Settings object built by hand isn't checked until then.
"""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A settings document that breaks a rule."""


@dataclass(frozen=True)
class Camera:
    source: str = "0"
    width: int = 1280
    height: int = 720
    fps: int = 5
    reconnect_backoff_s: float = 2.0
    max_reconnect_backoff_s: float = 30.0


@dataclass(frozen=True)
class Detector:
    kind: str = "detection"
    model_path: str = ""
    layout: str = "auto"
    input_size: int = 640
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    class_names: tuple[str, ...] = ()
    default_threshold: float = 0.5
    nms_iou: float = 0.45
    class_thresholds: Mapping[str, float] = field(default_factory=dict)
    severity: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Decision:
    ema_alpha: float = 0.35
    window: int = 12
    vote_threshold: float = 0.55
    warn_score: float = 0.60
    warn_votes: int = 4
    pause_score: float = 0.75
    pause_votes: int = 6
    pause_consecutive: int = 3
    cancel_enabled: bool = False
    cancel_score: float = 0.92
    cancel_votes: int = 9
    cancel_consecutive: int = 2
    clear_score: float = 0.40
    clear_ticks: int = 5
    cooldown_s: float = 300.0
    warmup_s: float = 180.0
    tick_interval_s: float = 1.0
    action_mode: str = "notify_only"


@dataclass(frozen=True)
class Quality:
    min_mean_luma: float = 20.0
    max_mean_luma: float = 240.0
    min_blur_var: float = 45.0
    max_frame_age_s: float = 5.0


@dataclass(frozen=True)
class Printer:
    base_url: str = "http://localhost:7125"
    timeout_s: float = 5.0
    poll_interval_s: float = 1.0
    pause_macro: str | None = None


@dataclass(frozen=True)
class Notify:
    discord_webhook_url: str | None = None
    min_interval_s: float = 60.0
    attach_frame: bool = True


@dataclass(frozen=True)
class Storage:
    event_log: str = "logs/events.jsonl"
    frame_dir: str = "captures"
    max_frames: int = 500
    retention_days: int = 14


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"


@dataclass(frozen=True)
class Settings:
    camera: Camera = Camera()
    detector: Detector = Detector()
    decision: Decision = Decision()
    quality: Quality = Quality()
    moonraker: Printer = Printer()
    notify: Notify = Notify()
    storage: Storage = Storage()
    logging: Logging = Logging()


#: Allowed values, and what the names of sections and keys above are: fixed values, as settings files have them.
KINDS = ("detection", "classification", "hailo")
NAMED_KINDS = ("classification", "hailo")
LAYOUTS = ("auto", "yolov8", "end2end")
SEVERITIES = ("catastrophic", "cosmetic")
REFERENCE = re.compile(r"env:([A-Za-z_][A-Za-z0-9_]*)")
MODES = ("notify_only", "pause", "cancel")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def environment(value):
    """Strings that are exactly env:NAME replaced, at any depth; others stay."""
    if isinstance(value, Mapping):
        return {k: environment(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [environment(v) for v in value]
    if isinstance(value, str) and (named := REFERENCE.fullmatch(value)):
        return os.environ.get(named[1])
    return value


def _section(kind: type, data, name: str):
    if data is None:
        return kind()
    if not isinstance(data, Mapping):
        raise ConfigError(f"section {name} must be a mapping")
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(data) - known):
        raise ConfigError(f"unknown keys in {name}: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def from_mapping(data: Mapping | None) -> Settings:
    """Settings from a parsed document (null: all defaults), checked."""
    data = {} if data is None else data
    if not isinstance(data, Mapping):
        raise ConfigError("the document must be a mapping")
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Settings)}
    if unknown := sorted(set(data) - set(kinds)):
        raise ConfigError(f"unknown sections: {', '.join(unknown)}")
    data = environment(data)
    return check(Settings(**{name: _section(kind, data.get(name), name) for name, kind in kinds.items()}))


def load(path: str) -> Settings:
    """Settings from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return from_mapping(yaml.safe_load(file))


def rules(s: Settings) -> list[tuple[str, bool]]:
    """Every rule with whether it holds, in the order in which they are checked."""
    d, det, cam, q = s.decision, s.detector, s.camera, s.quality
    inside = lambda x: 0 <= x <= 1
    out = [
        (f"detector.kind is one of {', '.join(KINDS)}", det.kind in KINDS),
        (f"detector.class_names is given for {', '.join(NAMED_KINDS)}", det.kind not in NAMED_KINDS or bool(det.class_names)),
        (f"detector.layout is one of {', '.join(LAYOUTS)}", det.layout in LAYOUTS),
        ("detector.default_threshold is in 0..1", inside(det.default_threshold)),
        ("detector.nms_iou is in 0..1", inside(det.nms_iou)),
        *[(f"detector.class_thresholds.{k} is in 0..1", inside(v)) for k, v in det.class_thresholds.items()],
        *[(f"detector.severity.{k} is one of {', '.join(SEVERITIES)}", v in SEVERITIES) for k, v in det.severity.items()],
        ("detector.class_thresholds and detector.severity name the same classes: " + key_differences(det.class_thresholds, det.severity), set(det.class_thresholds) == set(det.severity)),
        (f"decision.action_mode is one of {', '.join(MODES)}", d.action_mode in MODES),
        *[(f"decision.{k} is in 0..1", inside(getattr(d, k))) for k in ("vote_threshold", "warn_score", "pause_score", "cancel_score", "clear_score")],
        ("decision.window is at least 1", d.window >= 1),
        *[(f"decision.{k} is in 0..window", 0 <= getattr(d, k) <= d.window) for k in ("warn_votes", "pause_votes", "cancel_votes")],
        ("decision.ema_alpha is in (0, 1]", 0 < d.ema_alpha <= 1),
        ("decision.warmup_s isn't negative", d.warmup_s >= 0),
        ("decision scores rise from warn to pause to cancel", d.warn_score <= d.pause_score <= d.cancel_score),
        ("decision.tick_interval_s is positive", d.tick_interval_s > 0),
        ("decision.cooldown_s isn't negative", d.cooldown_s >= 0),
        *[(f"decision.{k} is at least 1", getattr(d, k) >= 1) for k in ("clear_ticks", "pause_consecutive", "cancel_consecutive")],
        ("camera sizes and rate are positive", min(cam.width, cam.height, cam.fps) > 0),
        ("camera back-offs are positive and ordered", 0 < cam.reconnect_backoff_s <= cam.max_reconnect_backoff_s),
        ("quality luma limits are ordered", q.min_mean_luma < q.max_mean_luma),
        ("quality.min_blur_var isn't negative", q.min_blur_var >= 0),
        ("quality.max_frame_age_s is positive", q.max_frame_age_s > 0),
        ("moonraker intervals are positive", min(s.moonraker.timeout_s, s.moonraker.poll_interval_s) > 0),
        ("notify.min_interval_s isn't negative", s.notify.min_interval_s >= 0),
        ("storage limits aren't negative", min(s.storage.max_frames, s.storage.retention_days) >= 0),
        (f"logging.level is one of {', '.join(LEVELS)}", s.logging.level.upper() in LEVELS),
    ]
    return out


def key_differences(a: Mapping, b: Mapping) -> str:
    """What either mapping lacks of the other's keys."""
    return f"missing in the second {sorted(set(a) - set(b))}, in the first {sorted(set(b) - set(a))}"


def check(s: Settings) -> Settings:
    for text, holds in rules(s):
        if not holds:
            raise ConfigError(f"broken rule: {text}")
    return s
