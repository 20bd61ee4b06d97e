"""Bitemporal history of changing attributes (problem 4).

``bitemporal_ledger`` turns dated reports into a ledger with two time axes:
the period a value was valid in and the period the ledger believed so.  A late
report splits the interval it falls into; the earlier ledger row is closed on
the recorded axis and superseded by a shorter one, never overwritten.

The sweep runs in place over range partitions (chunks) of (key, start), so that
the longest history is cut into many tasks.  Within a chunk a monotone stack
finds for each start the neighbour that was known before it.  What it leaves
open at a chunk's edge is met by another chunk only if something there was
recorded earlier: the earliest moment of each chunk and key, of which there are
no more than two a chunk, tells which chunk that is, if any.  With reports in
order hardly a row goes on; what does is spread over salts and looked up in
the staircase of first and last moments of its chunk.

Defined results: a row without ``valid_from`` starts at ``recorded_at``; a row
with neither has no place in time and is left out; a row whose ``valid_to``
isn't after its start is left out; unreadable instants count as missing;
null keys and null values are values of their own; repeated rows collapse;
an empty table gives an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.instants import iso_utc, parse_instant
from loomstone.session import materialize, parallelism

_SWEPT = "_chunk int, _key string, _start long, _at long, _end long, _prev boolean, _next boolean"
_EVENT = "_key string, _start long, _at long, _end long"
#: Open rows that one salt of a chunk's staircase takes.
SALT_ROWS = 200_000


def _reports(
    df: DataFrame, keys: Sequence[str], value: str, valid_from: str, valid_to: str, recorded_at: str, tie: str
) -> DataFrame:
    recorded = F.col(recorded_at).cast("timestamp")
    start = F.coalesce(parse_instant(F.col(valid_from)), recorded)
    end = parse_instant(F.col(valid_to))
    rows = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(value).alias("value"),
        F.unix_micros(start).alias("_start"),
        F.unix_micros(end).alias("_to"),
        F.unix_micros(recorded).alias("_at"),
        F.col(tie).alias("_tie"),
    ).where("_start is not null and (_to is null or _to > _start)")
    named = F.to_json(F.struct(*[F.col(f"k{i}") for i in range(len(keys))]), {"ignoreNullFields": "false"})
    # A report without a recorded time is the oldest belief of all.
    return rows.withColumn("_key", named).withColumn("_at", F.coalesce("_at", F.lit(-(2**62)))).distinct()


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Monotone stack over one chunk, sorted by key and start.

    Emits, for a start, the ends it had and from when; and of the chunk's first
    and last key the rows whose neighbour before (``_prev``) or after
    (``_next``) may stand in another chunk.
    """
    cols = ["_chunk", "_key", "_start", "_at", "_end", "_prev", "_next"]
    out: list[tuple] = []
    stack: list[tuple[int, int]] = []
    chunk, here, first = 0, None, True

    def flush() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=cols).astype({"_end": "Int64"})
        out.clear()
        return rows

    for pdf in batches:
        for chunk, key, start, at in zip(*(pdf[c].tolist() for c in cols[:4])):
            if key != here:
                first = here is None
                here = key
                stack.clear()
            while stack and stack[-1][1] >= at:
                before, known = stack.pop()
                out.append((chunk, key, before, known, start, False, False))
            if stack:
                out.append((chunk, key, stack[-1][0], at, start, False, False))
            elif first:
                out.append((chunk, key, start, at, None, True, False))
            stack.append((start, at))
        if len(out) > 50_000:
            yield flush()
    out.extend((chunk, here, start, at, None, False, True) for start, at in stack)
    if out:
        yield flush()


def _lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open rows against the staircase of the chunk that holds their neighbour;
    groups come one after the other, each with its stairs first."""
    here: tuple = ()
    stairs: list[tuple[int, int]] = []
    for pdf in batches:
        out = []
        for group, part in pdf.groupby(["_key", "_target", "_right", "_salt"], sort=False):
            if group != here:
                here, stairs = group, []
            steps = part[part["_stair"]]
            stairs += list(zip(steps["_start"].tolist(), steps["_at"].tolist()))
            asked = part[~part["_stair"]]
            if not len(asked):
                continue
            starts, moments = (np.array(x, np.int64) for x in zip(*stairs))
            start, at = asked["_start"].to_numpy(np.int64), asked["_at"].to_numpy(np.int64)
            if group[2]:  # the first one after that was known no later
                found = starts[np.searchsorted(-moments, -at, "left")]
                out.append(pd.DataFrame({"_key": group[0], "_start": start, "_at": at, "_end": found}))
            else:  # the last one before that was known earlier
                found = starts[np.searchsorted(moments, at, "left") - 1]
                out.append(pd.DataFrame({"_key": group[0], "_start": found, "_at": at, "_end": start}))
        if out:
            yield pd.concat(out, ignore_index=True)


def range_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` cut into balanced, ordered chunks: a stored column ``_chunk``."""
    n = parallelism(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn("_chunk", F.spark_partition_id()))


def open_rows(swept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, minima): the rows that another chunk completes, with that chunk
    (``_target``) and its side (``_right``), and each key's earliest moments."""
    edges = swept.where("_prev or _next")
    minima = edges.groupBy("_key", "_chunk").agg(F.min("_at").alias("_m"))
    line = Window.partitionBy("_key").orderBy("_chunk")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    around = minima.select("_key", "_chunk", F.min("_m").over(before).alias("_earlier"), F.min("_m").over(after).alias("_later"))
    every = minima.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_m"))).alias("_all"))
    # A chunk has one first and one last key: two rows a chunk at most.
    told = edges.join(F.broadcast(around.where("_earlier is not null or _later is not null")), ["_key", "_chunk"])
    met = lambda rows, holds, end: rows.join(F.broadcast(every), "_key").withColumn("_target", F.element_at(F.filter("_all", holds), end)["_chunk"])
    left = met(told.where(F.col("_prev") & (F.col("_earlier") < F.col("_at"))), lambda x: (x["_chunk"] < F.col("_chunk")) & (x["_m"] < F.col("_at")), -1)
    right = met(told.where(F.col("_next") & (F.col("_later") <= F.col("_at"))), lambda x: (x["_chunk"] > F.col("_chunk")) & (x["_m"] <= F.col("_at")), 1)
    cols = ["_key", "_start", "_at", "_target"]
    asked = left.select(*cols, F.lit(False).alias("_right")).unionByName(right.select(*cols, F.lit(True).alias("_right")))
    return asked, minima


def _interval_ends(slots: DataFrame) -> DataFrame:
    """Every end each start ever had: (_key, _start, _at, _end), open is null."""
    n = parallelism(slots.sparkSession)
    ranged = slots.repartitionByRange(n, "_key", "_start").sortWithinPartitions("_key", "_start")
    swept = materialize(ranged.select(F.spark_partition_id().alias("_chunk"), "_key", "_start", "_at").mapInPandas(_sweep, _SWEPT))
    asked = materialize(open_rows(swept)[0])
    group = ["_key", "_target", "_right"]
    # As many groups as chunks have edges, so this is small too.
    sizes = asked.groupBy(*group).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_k"))
    stairs = swept.where("_prev or _next").select("_key", "_start", "_at", F.col("_chunk").alias("_target"), F.col("_prev").alias("_right"))
    stairs = stairs.join(F.broadcast(sizes), group).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    spread = asked.join(F.broadcast(sizes), group).withColumn("_salt", F.pmod(F.xxhash64("_start"), F.col("_k")).cast("int"))
    cols = [*group, "_salt", "_stair", "_start", "_at"]
    both = stairs.withColumn("_stair", F.lit(True)).select(cols).unionByName(spread.withColumn("_stair", F.lit(False)).select(cols))
    ordered = both.repartition(n, *group, "_salt").sortWithinPartitions(*group, "_salt", F.desc("_stair"), "_start")
    rest = ordered.mapInPandas(_lookup, _EVENT)
    # Starts reported at once have one end from that moment: the nearest.
    events = swept.where("_end is not null").select("_key", "_start", "_at", "_end").unionByName(rest)
    return events.groupBy("_key", "_start", "_at").agg(F.min("_end").alias("_end"))


def bitemporal_ledger(
    df: DataFrame,
    keys: Sequence[str] = ("subject", "predicate"),
    value: str = "object",
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    recorded_at: str = "recorded_at",
    tie: str = "triple_id",
) -> DataFrame:
    """The ledger of all beliefs: keys, ``value``, ``valid_from`` (micros),
    ``valid_to`` (what the report itself said), ``next_from`` (the start of the
    next report then known), ``recorded_from`` and ``recorded_to`` (null: still
    believed), ``tie``.
    """
    reports = materialize(_reports(df, keys, value, valid_from, valid_to, recorded_at, tie))
    slots = reports.groupBy("_key", "_start").agg(F.min("_at").alias("_at"))
    ends = _interval_ends(slots)
    # Of reports of one start and moment only the highest tie ever counted.
    said = reports.groupBy("_key", "_start", "_at").agg(
        F.max_by(F.struct("value", "_to", "_tie", *[f"k{i}" for i in range(len(keys))]), "_tie").alias("said")
    )
    moments = said.join(ends, ["_key", "_start", "_at"], "full").withColumn("_has", F.col("_end").isNotNull())
    line = Window.partitionBy("_key", "_start").orderBy("_at")
    back = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ledger = (
        moments.withColumn("said", F.last("said", ignorenulls=True).over(back))
        .withColumn("next_from", F.min("_end").over(back))
        .withColumn("recorded_to", F.lead("_at").over(line))
    )
    return ledger.select(
        *[F.col(f"said.k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("said.value").alias("value"),
        F.col("_start").alias("valid_from"),
        F.col("said._to").alias("valid_to"),
        "next_from",
        F.col("_at").alias("recorded_from"),
        "recorded_to",
        F.col("said._tie").alias("tie"),
        F.col("_key"),
    )


def coalesce_versions(ledger: DataFrame, keys: Sequence[str] = ("subject", "predicate")) -> DataFrame:
    """Versions of the rows still believed: keys, value, ``valid_from``,
    ``valid_to`` in micros (null: open).

    Neighbours of equal value form one version unless the earlier row ended
    before the next start.  Windows run per (chunk, key); the first and last
    row of each chunk are stitched through a table of one row per chunk and
    key, so no history is ever sorted in one task.
    """
    now = ledger.where("recorded_to is null").drop("recorded_from", "recorded_to", "tie")
    rows = range_chunks(now, ["_key", "valid_from"])
    inside = Window.partitionBy("_chunk", "_key").orderBy("valid_from")
    whole = Window.partitionBy("_chunk", "_key")
    edge = F.struct("valid_from", "valid_to", "value")
    # Chunk edges: what stands before the first and after the last row.
    edges = rows.groupBy("_chunk", "_key").agg(F.max_by(edge, "valid_from").alias("last"))
    across = Window.partitionBy("_key").orderBy("_chunk")
    edges = edges.select("_chunk", "_key", F.lag("last").over(across).alias("before"))
    joined = rows.join(edges, ["_chunk", "_key"], "left")
    before = F.coalesce(F.lag(edge).over(inside), F.col("before"))
    marked = (
        joined.withColumn("_b", before)
        .withColumn(
            "_new",
            F.col("_b").isNull()
            | ~F.col("_b.value").eqNullSafe(F.col("value"))
            | F.coalesce(F.col("_b.valid_to") < F.col("valid_from"), F.lit(False)),
        )
        .withColumn("_v", F.max(F.when(F.col("_new"), F.col("valid_from"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_tail", F.max("_v").over(whole))
    )
    # A version begun in an earlier chunk: its start is carried forward.
    marked = materialize(marked.drop("_b", "before", "_new"))
    carry = marked.groupBy("_chunk", "_key").agg(F.max("_tail").alias("_tail"))
    carry = carry.select(
        "_chunk",
        "_key",
        F.last("_tail", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
    )
    versions = (
        marked.join(carry, ["_chunk", "_key"], "left")
        .withColumn("_v", F.coalesce("_v", "_carried"))
        .groupBy("_key", "_v")
        .agg(
            F.max_by(F.struct(*keys, "value", "valid_to", "next_from"), "valid_from").alias("end"),
        )
    )
    return versions.select(
        *[F.col(f"end.{k}").alias(k) for k in keys],
        F.col("end.value").alias("value"),
        F.col("_v").alias("valid_from"),
        F.least("end.valid_to", "end.next_from").alias("valid_to"),
    )


def attribute_history(triples: DataFrame) -> DataFrame:
    """The full history of ``triples``: one row for each version and its period."""
    keys = ("subject", "predicate")
    rows = triples.select("triple_id", *keys, "object", "valid_from", "valid_to", "recorded_at")
    versions = coalesce_versions(bitemporal_ledger(rows, keys), keys)
    return versions.select(
        *keys,
        iso_utc(F.timestamp_micros("valid_from")).alias("valid_from"),
        F.coalesce(iso_utc(F.timestamp_micros("valid_to")), F.lit("")).alias("valid_to"),
        F.col("value").alias("object"),
    )
