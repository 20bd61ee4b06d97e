"""Duplicates hidden by formatting differences (problem 2).

``hash_rows`` streams each row once through the skip-and-fold table into two
polynomial hashes.  Groups are counted on those 16 bytes alone, combined
before the shuffle.  Only the texts of groups of two and more are fetched then:
a bitmap of fixed size turns nearly all others away at the scan.  Each group's
first row goes ahead of the others, which are compared with it by two pointers
that pass over what is skipped.  Groups of many rows are salted, their first
row goes to every salt.

Defined results: null, empty and formatting-only values are equal; rows whose
hashes collide but whose content differs are regrouped by exact comparison
with each other; repeated ids count as copies of their smallest id only once,
rows of one id with different content each in their own group; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.folding import combined_hashes, same_content
from loomstone.session import materialize

FIELDS = ("text", "entity", "key", "value")
#: Rows of one group that one salt takes.
SALT_ROWS = 50_000
#: Bits of the map of wanted ids (8 MB at most, whatever the input), in pages.
MAP_BITS, PAGE_BITS = 1 << 26, 1 << 15


def _hashes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = combined_hashes([batch.column(i + 2) for i in range(n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1), pa.array(h2)], ["id", "raw", "h1", "h2"])

    return run


def _texts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(id, raw, f0..): ``raw`` tells rows of one id apart."""
    cols = [F.col(f).cast("string") for f in fields]
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(*cols).alias("raw"), *[c.alias(f"f{i}") for i, c in enumerate(cols)])


def hash_rows(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(id, raw, h1, h2) of each row; equal content has equal hashes."""
    return _texts(df, key, fields).mapInArrow(_hashes(len(fields)), "id long, raw long, h1 long, h2 long")


def _verify(n: int):
    """Each row against the last first row before it; groups come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if ahead is None else [ahead, batch]).combine_chunks().to_batches()[0] if batch.num_rows else batch
            if not rows.num_rows:
                continue
            head = rows.column(2).to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            ahead = rows.slice(int(at[-1]), 1)
            other = np.flatnonzero(~head)
            take, first = pa.array(other), pa.array(at[other])
            cols = [rows.column(3 + i) for i in range(n)]
            same = same_content([c.take(take) for c in cols], [c.take(first) for c in cols]) if len(other) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(same)], ["id", "first", "same"])

    return run


def _regroup(n: int):
    """Exact classes among rows whose hashes collided though they differ: each
    is compared with the first row of every class found so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        cols = [pa.array(pdf[f"f{i}"].where(pdf[f"f{i}"].notna(), None).tolist(), pa.string()) for i in range(n)]
        firsts = np.full(len(pdf), -1, np.int64)
        while (firsts < 0).any():
            left = np.flatnonzero(firsts < 0)
            same = same_content([c.take(pa.array(left)) for c in cols], [c.take(pa.array(np.full(len(left), left[0]))) for c in cols])
            firsts[left[same]] = pdf["id"][left[0]]
        return pd.DataFrame({"id": pdf["id"], "first": firsts})

    return run


def _mapped(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` less most rows whose id isn't wanted."""
    place = lambda: F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    page = lambda: F.expr(f"cast(pmod(xxhash64(id), {MAP_BITS}) div {PAGE_BITS} as int)")
    bits = wanted.select(page().alias("_page"), F.pmod(place(), F.lit(PAGE_BITS)).alias("_bit"))
    pages = bits.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    # MAP_BITS / PAGE_BITS rows of PAGE_BITS / 8 bytes: 8 MB for any input.
    rows = texts.join(F.broadcast(pages), page() == F.col("_page"))
    bit = F.pmod(place(), F.lit(PAGE_BITS))
    byte = F.expr(f"conv(hex(substring(_map, cast(pmod(xxhash64(id), {PAGE_BITS}) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    return rows.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).drop("_page", "_map")


def copy_groups(df: DataFrame, key: str = "atom_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(first, id) for every row that has copies but the first: its group's
    smallest id and its own."""
    n = len(fields)
    hashed = materialize(hash_rows(df, key, fields).distinct())
    groups = hashed.groupBy("h1", "h2").agg(F.min(F.struct("id", "raw")).alias("m"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("h1", "h2", F.col("m.id").alias("first"), F.col("m.raw").alias("raw"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("k")))
    heads = groups.select(F.col("first").alias("id"), "raw", "first", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(True).alias("head"))
    others = hashed.join(groups.withColumnRenamed("raw", "_raw"), ["h1", "h2"]).where("id != first or raw != _raw")
    others = others.select("id", "raw", "first", F.pmod(F.xxhash64("id", "raw"), F.col("k")).cast("int").alias("salt"), F.lit(False).alias("head"))
    wanted = materialize(heads.unionByName(others))
    texts = _mapped(_texts(df, key, fields), wanted)
    rows = texts.join(wanted, ["id", "raw"])
    ordered = rows.repartition("first", "salt").sortWithinPartitions("first", "salt", F.desc("head"), "id")
    checked = ordered.select("id", "first", "head", *[f"f{i}" for i in range(n)]).mapInArrow(_verify(n), "id long, first long, same boolean")
    checked = materialize(checked)
    copies = checked.where("same and id > first").select("first", "id").distinct()
    odd = checked.where("not same").select("id", "first").distinct()
    if odd.limit(1).count():
        regrouped = _texts(df, key, fields).join(odd, "id").groupBy("first").applyInPandas(_regroup(n), "id long, first long")
        copies = copies.unionByName(regrouped.where("id > first").select("first", "id").distinct())
    return copies


def collapse(df: DataFrame, key: str = "atom_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row for each distinct content: its smallest id and ``copies``, the
    number of rows that hold it (itself included)."""
    copies = copy_groups(df, key, fields)
    counts = copies.groupBy("first").agg((F.count("*") + 1).alias("copies"))
    singles = df.select(F.col(key).alias("first")).distinct().join(copies.select(F.col("id").alias("first")), "first", "left_anti")
    return singles.join(counts, "first", "left").select(F.col("first").alias(key), F.coalesce("copies", F.lit(1)).alias("copies"))
