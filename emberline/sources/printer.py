"""Printer state, commands and notifications over HTTP, with the transport injected; and live frame sources."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schemas import PRINT_STATE, PRINTER_STATES

REPLY = "struct<result:struct<status:struct<print_stats:struct<state:string,filename:string,print_duration:double>,virtual_sdcard:struct<progress:double>>>>"


def parsed_state(status: Column, body: Column, fetched_at: Column) -> Column:
    """A reply as a print state. Anything but a complete reply is unknown, without a file; a state of another name is unknown, with its file."""
    reply = F.from_json(body, REPLY)["result"]["status"]
    state, stats = reply["print_stats"]["state"], reply["print_stats"]
    whole = (status == 200) & state.isNotNull() & stats["print_duration"].isNotNull() & reply["virtual_sdcard"]["progress"].isNotNull()
    known = F.when(state.isin(*PRINTER_STATES), state).otherwise("unknown")
    fields = F.struct(known.alias("state"), F.nullif(stats["filename"], F.lit("")).alias("filename"), stats["print_duration"].alias("elapsed_s"), reply["virtual_sdcard"]["progress"].alias("progress"), fetched_at.cast("double").alias("fetched_at"))
    nothing = F.struct(F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("filename"), F.lit(0.0).alias("elapsed_s"), F.lit(0.0).alias("progress"), fetched_at.cast("double").alias("fetched_at"))
    return F.when(F.coalesce(whole, F.lit(False)), fields).otherwise(nothing).cast(PRINT_STATE)


class Commands:
    """pause, cancel and health; send(method, url) returns a status code and may raise OSError."""

    def __init__(self, base_url: str, send: Callable[[str, str], int], macro: str = ""):
        self.base, self.send, self.macro = base_url.rstrip("/"), send, macro

    def _done(self, method: str, path: str) -> bool:
        try:
            return 200 <= self.send(method, self.base + path) < 300
        except OSError:
            return False

    def pause(self) -> bool:
        return self._done("POST", f"/printer/gcode/script?script={quote(self.macro, safe='')}" if self.macro else "/printer/print/pause")

    def cancel(self) -> bool:
        return self._done("POST", "/printer/print/cancel")

    def health(self) -> bool:
        return self._done("GET", "/server/info")


class Notifier:
    """Payloads to a webhook, at most one per interval; the interval runs from the last that was delivered."""

    def __init__(self, post: Callable[[bytes], int], min_interval_s: float = 30.0, post_file: Callable[[str], int] | None = None, clock: Callable[[], float] = time.monotonic):
        self.post, self.wait, self.post_file, self.clock, self.last = post, min_interval_s, post_file, clock, None

    def send(self, payload: str, frame_path: str | None = None) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.wait:
            return False
        try:
            if not 200 <= self.post(payload.encode()) < 300:
                return False
        except OSError:
            return False
        self.last = now
        if self.post_file and frame_path:
            try:
                self.post_file(frame_path)
            except OSError:
                pass  # the message itself was delivered
        return True


class Silent(Notifier):
    """Where no address is set: everything counts as sent."""

    def __init__(self):
        super().__init__(lambda _: 200, 0.0)

    def send(self, payload: str, frame_path: str | None = None) -> bool:
        return True


def notifier(url: str | None, post: Callable[[bytes], int], **options) -> Notifier:
    return Notifier(post, **options) if url else Silent()


def retry_after(headers: dict[str, str], body: str) -> float | None:
    """Seconds to wait, by the body or the header; null without either."""
    try:
        return float(json.loads(body)["retry_after"])
    except (ValueError, KeyError, TypeError):
        pass
    try:
        return float(headers.get("Retry-After", ""))
    except ValueError:
        return None


class Backoff:
    """Whether to try again: after each failure the wait doubles, up to the most; a success resets it."""

    def __init__(self, initial: float, most: float, clock: Callable[[], float] = time.monotonic):
        self.initial, self.most, self.clock = initial, most, clock
        self.failures, self.until = 0, None

    def ready(self) -> bool:
        return self.until is None or self.clock() >= self.until

    def failed(self) -> None:
        self.until = self.clock() + delay(self.initial, self.most, self.failures)
        self.failures += 1

    def succeeded(self) -> None:
        self.failures, self.until = 0, None


def delay(initial: float, most: float, failures: int) -> float:
    return min(initial * 2.0 ** min(failures, 64), most)


class FrameReader(SimpleDataSourceStreamReader):
    """One frame per micro-batch from a fetcher; while it fails, batches are empty and tries are spaced out."""

    def __init__(self, fetch: Callable[[], bytes | None], backoff: Backoff):
        self.fetch, self.backoff = fetch, backoff

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict):
        if not self.backoff.ready():
            return iter([]), start
        try:
            data = self.fetch()
        except OSError:
            data = None
        if data is None:
            self.backoff.failed()
            return iter([]), start
        self.backoff.succeeded()
        return iter([(start["seq"], time.time(), data)]), {"seq": start["seq"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([])  # frames aren't kept


class HttpFrames(DataSource):
    """Snapshots from a URL: option url, and initial and most for the waits. Schema: seq, ts, data."""

    @classmethod
    def name(cls) -> str:
        return "http_frames"

    def schema(self) -> str:
        return "seq long, ts double, data binary"

    def simpleStreamReader(self, schema) -> FrameReader:
        from urllib.request import urlopen

        url = self.options["url"]

        def fetch() -> bytes:
            with urlopen(url, timeout=5) as reply:
                return reply.read()

        return FrameReader(fetch, Backoff(float(self.options.get("initial", 1)), float(self.options.get("most", 30))))
