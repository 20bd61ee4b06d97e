"""Evaluation texts leaking into training text (problem 7).

Texts are compared on their letters and digits, case folded.  The q-grams of
all items form one index; a document's q-grams are looked up in it, counted
for each item and in overlapping diagonal bands.  By the q-gram lemma a region
of m characters within e edits shares m - q + 1 - q * e q-grams at least, so
bands below that hold no region; what is left is verified by banded alignment
with just that budget, so that the filter loses nothing verification would
accept.  A document leaks an item of which it holds ``SHARE`` of the wording
in regions of ``REGION`` characters and more, wherever they stand.

Defined results: null, blank and short items or texts hold nothing; each
(doc_id, item_id) comes once; documents with equal text are each reported;
an empty table gives an empty result; extra columns are ignored.  Items are
the stated query set: they are read in blocks of at most ``BLOCK_CHARS``
characters, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.folding import code_points, tables

Q = 7
#: Characters of a region, edits it may have, and half the width of a band; two
#: diagonals of one region are no further apart than its edits.
REGION, EDITS, HALF = 50, 4, 8
#: Share of an item's characters that makes a leak.
SHARE = 0.42
#: Characters of one block of items, so many are broadcast at once.
BLOCK_CHARS = 4_000_000
#: Counters of bands, and alignments that advance together.
SLOTS, ALIGNED = 1 << 22, 256
#: Least q-grams of a region (the lemma).
LEAST = REGION - Q + 1 - Q * EDITS

_BASE = np.uint64(0x9E3779B97F4A7C15)


def squeeze(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and digits of a column and the offsets of its values."""
    fold, _ = tables()
    cps, offsets = code_points(column)
    folded = np.where(cps > 0xFFFF, cps, fold[np.minimum(cps, 0xFFFF)])
    keep = folded != 0
    return folded[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, value number, position within the value) of every q-gram."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(Q):
            h = h * _BASE + c[j : j + n]
        h ^= h >> np.uint64(29)
    lengths = np.diff(offsets)
    value = np.repeat(np.arange(len(lengths)), lengths)[:n]
    at = np.arange(n) - offsets[value]
    inside = at + Q <= lengths[value]
    return h[inside], value[inside], at[inside]


class Index:
    """All q-grams of the items of one block."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.codes, self.offsets = squeeze(pa.array(texts, pa.string()))
        self.lengths = np.diff(self.offsets)
        h, item, at = grams(self.codes, self.offsets)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item, self.at = item[order].astype(np.int32), at[order].astype(np.int32)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the probe, posting) for every shared q-gram."""
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        slot = np.searchsorted(self.keys, h[maybe])
        slot = np.minimum(slot, len(self.keys) - 1)
        good = self.keys[slot] == h[maybe]
        probe, slot = maybe[good], slot[good]
        count = self.first[slot + 1] - self.first[slot]
        start = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return np.repeat(probe, count), start + np.arange(count.sum())


def edit_places(parts: list[tuple[np.ndarray, np.ndarray, int]], half: int = 2 * HALF) -> list[np.ndarray]:
    """For each (a, b, shift), the edits at each place of ``a`` in the best
    alignment to a part of ``b`` along a diagonal: a[i] stands at b[i + shift],
    give or take ``half``.  A symbol of ``b`` that ``a`` lacks counts at the
    place before it.  All alignments advance together, row by row."""
    if not parts:
        return []
    width = 2 * half + 1
    size = np.array([len(a) for a, _, _ in parts])
    longest, n = int(size.max()), len(parts)
    left = np.full((n, longest), -2, np.int64)
    right = np.full((n, longest + width - 1), -1, np.int64)
    for k, (a, b, shift) in enumerate(parts):
        lo = shift - half
        left[k, : len(a)] = a
        piece = b[max(0, lo) : max(0, lo + len(a) + width - 1)]
        right[k, max(0, -lo) : max(0, -lo) + len(piece)] = piece
    lane = np.arange(width, dtype=np.int16)
    rows = np.zeros((longest + 1, n, width), np.int16)  # free start within the band
    for i in range(longest):
        step = rows[i] + (right[:, i : i + width] != left[:, i, None])
        np.minimum(step[:, :-1], rows[i][:, 1:] + 1, out=step[:, :-1])
        rows[i + 1] = np.minimum.accumulate(step - lane, axis=1) + lane
    edits = np.zeros((n, longest), np.int64)
    every = np.arange(n)
    at = rows[size, every].argmin(1)
    for i in range(longest - 1, -1, -1):
        todo = every[i < size]
        while len(todo):
            here = at[todo]
            now, before = rows[i + 1, todo, here], rows[i, todo]
            miss = right[todo, i + here] != left[todo, i]
            over = np.minimum(here + 1, width - 1)
            diagonal = now == before[np.arange(len(todo)), here] + miss
            drop = ~diagonal & (over > here) & (now == before[np.arange(len(todo)), over] + 1)
            edits[todo[diagonal], i] += miss[diagonal]
            edits[todo[~diagonal], i] += 1
            at[todo[drop]] += 1
            todo = todo[~diagonal & ~drop]
            at[todo] -= 1
    return [e[:m] for e, m in zip(edits, size)]


def regions(pair: np.ndarray, at: np.ndarray, diag: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, from, to, diagonal) of the stretches of the pairs' items, given the
    q-grams of all pairs and the length of each one's item: all stretches of
    ``REGION`` characters that hold ``LEAST`` q-grams of one band, overlapping
    ones together."""
    out = []
    for offset in (0, HALF):
        band = (diag + offset) // (2 * HALF)
        order = np.lexsort((at, band, pair))
        p, g, a, d = pair[order], band[order], at[order], diag[order]
        n = len(a) - LEAST + 1
        if n <= 0:
            continue
        end = slice(LEAST - 1, None)
        first = np.flatnonzero((p[end] == p[:n]) & (g[end] == g[:n]) & (a[end] - a[:n] <= REGION - Q))
        if not len(first):
            continue
        last = first + LEAST - 1
        lo, hi = np.maximum(0, a[last] + Q - REGION), np.minimum(length[order][first], a[first] + REGION)
        # Starts and ends grow within a band, so a gap begins a new stretch.
        fresh = np.ones(len(first), bool)
        fresh[1:] = (p[first][1:] != p[first][:-1]) | (g[first][1:] != g[first][:-1]) | (lo[1:] > hi[:-1])
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(first)) - 1
        out.append((p[first[begin]], lo[begin], hi[stop], d[(first[begin] + last[stop]) // 2]))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    p, lo, hi, d = (np.concatenate(x) for x in zip(*out))
    long = hi - lo >= REGION
    order = np.argsort(p[long], kind="stable")
    return p[long][order], lo[long][order], hi[long][order], d[long][order]


def once(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches of one pair less those seen from the other band too."""
    kept: list[tuple[int, int, int]] = []
    for r in sorted(set(found), key=lambda r: r[0] - r[1]):
        if not any(k[0] <= r[0] and r[1] <= k[1] and abs(k[2] - r[2]) <= HALF // 2 for k in kept):
            kept.append(r)
    return kept


def covered(length: int, found: list[tuple[int, int, int]]) -> float:
    """Share of an item that its regions could hold at most."""
    cover = np.zeros(length, bool)
    for lo, hi, _ in found:
        cover[lo:hi] = True
    return float(cover.mean()) if length else 0.0


def held(length: int, found: list[tuple[int, int, int]], places: list[np.ndarray]) -> float:
    """Share of an item held in verified regions, given the edits at each place
    of them; none counts twice, and a place that was edited doesn't count."""
    worth = np.zeros(length, bool)
    for (lo, hi, _), edits in zip(found, places):
        total = np.concatenate(([0], np.cumsum(edits)))
        good = np.flatnonzero(total[REGION:] - total[:-REGION] <= EDITS)
        inside = np.zeros(hi - lo + 1, np.int64)
        np.add.at(inside, good, 1)
        np.add.at(inside, good + REGION, -1)
        worth[lo:hi] |= (np.cumsum(inside)[:-1] > 0) & (edits == 0)
    return float(worth.mean())


def leaks_of(index: Index, column: pa.Array) -> list[tuple[int, int, float]]:
    """(row, item number, share) of the leaks among the texts of a column."""
    codes, offsets = squeeze(column)
    h, doc, at = grams(codes, offsets)
    if not len(h) or not len(index.keys):
        return []
    probe, posting = index.hits(h)
    item = index.item[posting]
    pair = (doc[probe] * len(index.ids) + item).astype(np.int64)
    # Enough q-grams of the item at all, however they lie.
    need = np.maximum(LEAST, (SHARE * index.lengths / REGION).astype(np.int64) * LEAST)
    total = np.bincount(pair, minlength=len(column) * len(index.ids))
    keep = np.flatnonzero((total >= np.tile(need, len(column)))[pair])
    probe, posting, pair = probe[keep], posting[keep], pair[keep]
    item_at = index.at[posting].astype(np.int64)
    diag = at[probe] - item_at
    # Enough of them in bands that can hold a region (colliding bands count
    # together, which loses none).
    good = np.zeros(len(pair), bool)
    for offset in (0, HALF):
        slot = ((pair * 0x9E3779B1 + (diag + offset) // (2 * HALF)) * 0x85EBCA6B) & (SLOTS - 1)
        good |= np.bincount(slot, minlength=SLOTS)[slot] >= LEAST
    pair, item_at, diag = pair[good], item_at[good], diag[good]
    count = np.bincount(pair, minlength=len(total))
    enough = np.flatnonzero(count[pair] >= need[pair % len(index.ids)])
    pair, item_at, diag = pair[enough], item_at[enough], diag[enough]
    if not len(pair):
        return []
    size = index.lengths[pair % len(index.ids)]
    p, lo, hi, d = regions(pair, item_at, diag, size)
    if not len(p):
        return []
    own, at_pair = np.unique(p, return_inverse=True)
    most = np.bincount(at_pair, weights=hi - lo) >= SHARE * index.lengths[own % len(index.ids)]
    keep = most[at_pair]
    p, lo, hi, d = p[keep], lo[keep], hi[keep], d[keep]
    edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, np.int64)
    jobs = []
    for x, y in zip(edges[:-1], edges[1:]):
        row, k = divmod(int(p[x]), len(index.ids))
        found = once(list(zip(lo[x:y].tolist(), hi[x:y].tolist(), d[x:y].tolist())))
        if covered(int(index.lengths[k]), found) >= SHARE:  # if every region stood the test
            jobs.append((row, k, found))
    parts = []
    for row, k, found in jobs:
        own, text = index.codes[index.offsets[k] : index.offsets[k + 1]], codes[offsets[row] : offsets[row + 1]]
        parts += [(own[lo:hi], text, lo + shift) for lo, hi, shift in found]
    order = sorted(range(len(parts)), key=lambda x: len(parts[x][0]))
    places: list = [None] * len(parts)
    for lo in range(0, len(order), ALIGNED):
        some = order[lo : lo + ALIGNED]
        for x, edits in zip(some, edit_places([parts[x] for x in some])):
            places[x] = edits
    out, at_part = [], 0
    for row, k, found in jobs:
        share = held(int(index.lengths[k]), found, places[at_part : at_part + len(found)])
        at_part += len(found)
        if share >= SHARE:
            out.append((row, k, share))
    return out


def _scan(shared, rows_at_once: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(lo, rows_at_once)
                found = leaks_of(index, batch.column(1))
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                items = pa.array([int(index.ids[x[1]]) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, pa.array([x[2] for x in found], pa.float64())], ["doc_id", "item_id", "share"])

    return run


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): the items each document leaks."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("text is not null")
    schema = "doc_id long, item_id long, share double"
    out = spark.createDataFrame([], schema)
    block: list[tuple[int, str]] = []
    size = 0

    def scan(found: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index([i for i, _ in found], [x for _, x in found]))
        return docs.mapInArrow(_scan(shared), schema)

    for row in items.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        if block and size + len(row.text) > BLOCK_CHARS:
            out = out.unionByName(scan(block))
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        out = out.unionByName(scan(block))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many documents leak it and the greatest share."""
    found = leaked(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 4).alias("most"))
    return items.select("item_id", "suite").join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "most")
