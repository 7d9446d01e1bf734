"""Row types that the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _LONG, _INT, _BOOLEAN = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def row(*fields: tuple[str, T.DataType]) -> T.StructType:
    """A row type of nullable fields; no session is needed to make it."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


DETECTION = row(("class_id", _INT), ("class_name", _STRING), ("confidence", _DOUBLE), ("bbox", T.ArrayType(_DOUBLE)), ("severity", _STRING))
DETECTIONS = T.ArrayType(DETECTION)
GATE = "struct<passed:boolean,reason:string>"
PRINT_STATE = "struct<state:string,filename:string,elapsed_s:double,progress:double,fetched_at:double>"
TICK = row(("tick", _LONG), ("timestamp", _DOUBLE), ("p_raw", _DOUBLE), ("gate_passed", _BOOLEAN), ("gate_reason", _STRING), ("detections", DETECTIONS))
EVENT = row(
    ("timestamp", _DOUBLE), ("action", _STRING), ("state", _STRING), ("score", _DOUBLE), ("p_raw", _DOUBLE), ("votes", _INT), ("reason", _STRING), ("class_name", _STRING),
    ("confidence", _DOUBLE), ("frame_path", _STRING), ("print_filename", _STRING), ("elapsed_s", _DOUBLE), ("detections", DETECTIONS),
)
MANIFEST = row(*[(n, _STRING) for n in ("output", "split", "source", "source_path", "group", "content_sha256", "dhash")], ("n_boxes", _INT))
FRAME = "struct<image:struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>,ts:timestamp,seq:long>"
#: States of the decision operator, printer states, actions and severities: fixed values.
DECISION_STATES = ("idle", "armed", "warning", "triggered", "cooldown")
PRINTER_STATES = ("printing", "paused", "complete", "cancelled", "error", "standby", "unknown")
TERMINAL_STATES = ("complete", "cancelled", "error", "standby")
ACTIONS = ("none", "notify", "pause", "cancel")
SEVERITIES = ("catastrophic", "cosmetic")
