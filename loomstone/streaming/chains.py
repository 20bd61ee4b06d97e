"""Stateful streams: verify event chains, pair calls with results, windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

_OUT = StructType([StructField("run_id", StringType()), StructField("events", LongType()), StructField("ok", BooleanType()), StructField("head", StringType())])


def event_sound(event: dict) -> bool:
    body = {k: v for k, v in event.items() if k not in ("hash", "sig")}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest() == event.get("hash")


class SealedRuns(StatefulProcessor):
    """Per run: the last hash, the number of events, and whether the chain has
    held so far; once broken it stays broken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", StructType([StructField("head", StringType()), StructField("events", LongType()), StructField("ok", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, events, ok = self.state.get() if self.state.exists() else (None, 0, True)
        batch = pd.concat(list(rows)).sort_values("seq")
        for raw in batch["raw"]:
            try:
                event = json.loads(raw)
            except ValueError:
                event = {}
            ok = bool(ok and event_sound(event) and event.get("prev_event_hash") == head)
            head = event.get("hash")
            events += 1
        self.state.update((head, events, ok))
        yield pd.DataFrame([(key[0], events, ok, head)], columns=["run_id", "events", "ok", "head"])

    def close(self) -> None:
        pass


def verify_stream(trace: DataFrame) -> DataFrame:
    """(run_id, events, ok, head) after each batch; ``trace`` is a stream of
    (seq, raw).  Needs the RocksDB state store."""
    rows = trace.select(F.coalesce(F.get_json_object("raw", "$.run_id"), F.lit("")).alias("run_id"), "seq", "raw")
    return rows.groupBy("run_id").transformWithStateInPandas(SealedRuns(), _OUT, "Update", "None")


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums per event-time window; later events than the watermark
    are dropped by design of the stream."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("events"))


class CallPairer(StatefulProcessor):
    """Per session, agent and tool: open calls in order; a result takes the
    oldest one that is no older than the time to live."""

    TTL = 900

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType([StructField("calls", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = json.loads(self.open.get()[0]) if self.open.exists() else []
        out = []
        for _, at, pid, result in pd.concat(list(rows)).sort_values(["at", "payload_id"])[["key", "at", "payload_id", "result"]].itertuples(index=False):
            calls = [c for c in calls if at - c[0] <= self.TTL]
            if not result:
                calls.append([int(at), int(pid)])
            elif calls:
                t0, call = calls.pop(0)
                out.append((call, int(pid), int(at - t0)))
        self.open.update((json.dumps(calls),))
        yield pd.DataFrame(out, columns=["call_id", "result_id", "waited"]).astype("int64")

    def close(self) -> None:
        pass


def pair_stream(payloads: DataFrame) -> DataFrame:
    """(call_id, result_id, waited) from a stream of hook payloads."""
    rows = payloads.where("hook_event_name in ('PreToolUse', 'PostToolUse')").select(
        F.concat_ws("|", "session_id", F.coalesce("agent_id", F.lit("")), "tool_name").alias("key"), F.unix_timestamp("ts").alias("at"), "payload_id", (F.col("hook_event_name") == "PostToolUse").alias("result")
    )
    return rows.groupBy("key").transformWithStateInPandas(CallPairer(), "call_id long, result_id long, waited long", "Append", "None")
