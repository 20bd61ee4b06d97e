"""Hash-chained event logs: seal, verify, attribute, pair.

An event's hash covers everything in it but ``hash`` and ``sig``, its
predecessor's hash included; sealing is therefore sequential within a run and
streams each run in order, while verifying is not: every stored
hash is recomputed on its own and links are compared with ``lag``.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.canonical import canonical_digest


def _dump(event: dict) -> str:
    return json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def seal_event(event: dict, previous: str | None) -> dict:
    """``event`` linked to the previous hash and hashed itself."""
    body = {k: v for k, v in event.items() if k not in ("hash", "sig") and not (k in ("cap_id", "cap_chain", "subject_thumbprint", "role") and v is None)}
    body["prev_event_hash"] = previous
    return body | {"hash": hashlib.sha256(_dump(body).encode("utf-8")).hexdigest()}


def seal(events: DataFrame) -> DataFrame:
    """(run_id, seq, raw): chained events of each run in order of ``seq``.

    ``events`` has run_id, seq and ``body``, the event as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, None
        for pdf in batches:
            out = []
            for run_id, seq, body in pdf[["run_id", "seq", "body"]].itertuples(index=False):
                if run_id != here:
                    here, last = run_id, None
                event = seal_event(json.loads(body), last)
                last = event["hash"]
                out.append((run_id, seq, _dump(event)))
            yield pd.DataFrame(out, columns=["run_id", "seq", "raw"])

    # A run streams through one task in order; it is never held as a whole.
    rows = events.select("run_id", F.col("seq").cast("long").alias("seq"), "body").repartition("run_id").sortWithinPartitions("run_id", "seq")
    return rows.mapInPandas(run, "run_id string, seq long, raw string")


def check_events(trace: DataFrame) -> DataFrame:
    """(run_id, seq, sound, linked, intact): each event's own hash, its link,
    and whether the chain is unbroken up to it."""
    # The digest covers the event without hash and sig.
    bare = F.regexp_replace(F.regexp_replace("raw", r',"hash":"[^"]*"|"hash":"[^"]*",', ""), r',"sig":"[^"]*"|"sig":"[^"]*",', "")
    rows = trace.select(
        "run_id", "seq", F.get_json_object("raw", "$.hash").alias("hash"), F.get_json_object("raw", "$.prev_event_hash").alias("prev"), canonical_digest(bare).alias("digest")
    )
    line = Window.partitionBy("run_id").orderBy("seq")
    rows = rows.withColumn("sound", F.coalesce(F.col("hash") == F.col("digest"), F.lit(False))).withColumn("linked", F.col("prev").eqNullSafe(F.lag("hash").over(line)))
    ok = (F.col("sound") & F.col("linked")).cast("int")
    return rows.select("run_id", "seq", "sound", "linked", (F.min(ok).over(line.rowsBetween(Window.unboundedPreceding, 0)) == 1).alias("intact"))


def verify_chains(trace: DataFrame) -> DataFrame:
    """(run_id, events, ok, broken_at)."""
    c = check_events(trace)
    return c.groupBy("run_id").agg(F.count("*").alias("events"), F.min("intact").alias("ok"), F.min(F.when(~F.col("intact"), F.col("seq"))).alias("broken_at"))


def chain_heads(trace: DataFrame) -> DataFrame:
    return trace.groupBy("run_id").agg(F.max_by(F.get_json_object("raw", "$.hash"), "seq").alias("head"))


def under_chain(events: DataFrame, ancestor: str) -> DataFrame:
    """Events whose capability chain holds ``ancestor``; without a chain, whose
    own capability it is."""
    chain = F.coalesce("cap_chain", F.array().cast("array<string>"))
    return events.where(F.when(F.size(chain) > 0, F.array_contains(chain, ancestor)).otherwise(F.col("cap_id") == ancestor))


def delegation_edges(events: DataFrame) -> DataFrame:
    """(cap, parent, events, place): each capability's parent, as first seen."""
    hops = events.select("seq", F.posexplode("cap_chain").alias("pos", "cap"), "cap_chain")
    hops = hops.withColumn("parent", F.when(F.col("pos") > 0, F.element_at("cap_chain", F.col("pos").cast("int"))))
    edges = hops.groupBy("cap").agg(F.min_by("parent", F.struct("seq", "pos")).alias("parent"), F.countDistinct("seq").alias("events"))
    inner = edges.select(F.col("parent").alias("cap")).where("cap is not null").distinct().withColumn("_inner", F.lit(True))
    place = F.when(F.col("parent").isNull(), "root").when(F.col("_inner"), "branch").otherwise("leaf")
    return edges.join(inner, "cap", "left").select("cap", "parent", "events", place.alias("place"))


# Event types of hook payloads and kinds of tools.
HOOK_EVENTS = {
    "SessionStart": "session_started", "UserPromptSubmit": "prompt_submitted", "PreToolUse": "tool_called", "PostToolUse": "tool_returned",
    "SubagentStart": "subagent_started", "SubagentStop": "subagent_stopped", "Stop": "turn_ended", "SessionEnd": "session_ended",
}
TOOL_HINTS = [
    ("shell", r"(?i)(^|[^a-z])(bash|shell|exec|execute|run|terminal)|executebash"), ("write", r"(?i)(write|edit|create|append|patch)"),
    ("read", r"(?i)(read|view|cat|open|grep|glob|search|list)"), ("agent", r"(?i)(agent|task|delegate|subagent)"), ("web", r"(?i)(web|http|fetch|url)"),
]


def tool_kind(c):
    kind = F.when(c.isNull(), None)
    for name, pattern in TOOL_HINTS:
        kind = kind.when(c.rlike(pattern), name)
    return kind.otherwise(F.lit("other"))


def hook_events(payloads: DataFrame) -> DataFrame:
    """Payloads, each once, as events with receipts instead of contents."""
    once = payloads.dropDuplicates(["payload_id"])
    kinds = F.create_map(*[x for k, v in HOOK_EVENTS.items() for x in (F.lit(k), F.lit(v))])
    program = F.regexp_extract(F.col("tool_input.command"), r"^\s*(?:sudo\s+)?([\w./-]+)", 1)
    return once.select(
        "payload_id", "session_id", "agent_id", "ts",
        F.coalesce(kinds[F.col("hook_event_name")], F.lit("other")).alias("type"), tool_kind(F.col("tool_name")).alias("tool_kind"),
        F.regexp_extract(program, r"([^/]*)$", 1).alias("program"),
        F.sha2(F.coalesce("prompt", F.col("tool_input.prompt"), F.col("tool_input.command"), F.lit("")), 256).alias("receipt"),
        F.length(F.coalesce("prompt", F.col("tool_input.prompt"), F.col("tool_input.command"), F.lit(""))).alias("size"),
    )


def _paired(ttl: int):
    """Open calls of one key in order of time; only those younger than ``ttl``
    seconds are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, open_ = None, deque()
        for pdf in batches:
            out = []
            for key, at, pid, result in pdf[["key", "at", "payload_id", "result"]].itertuples(index=False):
                if key != here:
                    here, open_ = key, deque()
                while open_ and at - open_[0][0] > ttl:
                    open_.popleft()
                if not result:
                    open_.append((at, pid))
                elif open_:
                    began, call = open_.popleft()
                    out.append((call, pid, at - began))
            yield pd.DataFrame(out, columns=["call_id", "result_id", "waited"]).astype("int64")

    return run


def pair_calls(payloads: DataFrame, ttl_seconds: int = 900) -> DataFrame:
    """(call_id, result_id, waited): each result with the oldest call of its
    session, agent and tool that is still open, i.e. unanswered and no older
    than the time to live; a result without such a call has no row.

    Which call is open depends on all before it, so the events of one key
    stream through a task in order; only open calls are held."""
    rows = payloads.dropDuplicates(["payload_id"]).where("hook_event_name in ('PreToolUse', 'PostToolUse')")
    key = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in ("session_id", "agent_id", "tool_name")]))
    rows = rows.select(key.alias("key"), F.unix_timestamp("ts").alias("at"), "payload_id", (F.col("hook_event_name") == "PostToolUse").alias("result")).where("at is not null")
    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "payload_id")
    return ordered.mapInPandas(_paired(ttl_seconds), "call_id long, result_id long, waited long")
