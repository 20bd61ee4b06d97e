"""Structures that are equal up to a declared symmetry.

A ring (array of strings) is represented by its least rotation, a grouping by
its least relabelling under a permutation group.  Elements compare by their
quoted form, as their digests do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Greatest order of a closed group.
MOST_PERMUTATIONS = 100_000


def padded(c: Column, width: int) -> Column:
    """Non-negative integers as text of one width, so that text order is theirs."""
    return F.when((c >= 0) & (F.length(c.cast("string")) <= width), F.lpad(c.cast("string"), width, "0")).otherwise(
        F.raise_error(F.concat(F.lit("not a number of that width: "), c.cast("string")))
    )


def quoted(seq: Column) -> Column:
    return F.transform(seq, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))


def rotate(seq: Column, start: Column) -> Column:
    return F.concat(F.slice(seq, start + 1, F.size(seq) - start), F.slice(seq, F.lit(1), start))


def least_start(seq: Sequence[str]) -> int:
    """Where the least rotation of a ring begins, in time linear in its size:
    two candidates race, the one that loses a comparison skips all it shared."""
    n = len(seq)
    a, b, same = 0, 1, 0
    while a < n and b < n and same < n:
        x, y = seq[(a + same) % n], seq[(b + same) % n]
        if x == y:
            same += 1
            continue
        if x > y:
            a += same + 1
        else:
            b += same + 1
        if a == b:
            b += 1
        same = 0
    return min(a, b)


def _least(reflect: bool):
    def turn(ring: Sequence) -> tuple[list[str], list]:
        keys = [json.dumps(x, ensure_ascii=False) for x in ring]
        at = least_start(keys)
        return keys[at:] + keys[:at], list(ring[at:]) + list(ring[:at])

    def one(ring):
        if ring is None or len(ring) < 2:
            return ring
        ring = list(ring)
        return min(turn(ring), turn(ring[::-1]), key=lambda t: t[0])[1] if reflect else turn(ring)[1]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(one)

    return run


def canonical_cycle(seq: Column, reflect: bool = True) -> Column:
    """The least rotation; with ``reflect`` of the ring or its mirror image."""
    return _least(reflect)(seq)


def anchor_cycle(seq: Column, anchor: Column) -> Column:
    """The ring turned so that its only ``anchor`` comes first, else null."""
    hits = F.size(F.filter(seq, lambda x: x.eqNullSafe(anchor)))
    return F.when(hits == 1, rotate(seq, (F.array_position(seq, anchor) - 1).cast("int")))


def cycle_digest(seq: Column, reflect: bool = True, domain: str = "ring/v1") -> Column:
    """Equal if and only if the rings are; the domain keeps digests apart."""
    body = F.concat(F.lit("["), F.array_join(quoted(canonical_cycle(seq, reflect)), ","), F.lit("]"))
    return F.sha2(F.concat(F.lit(domain + "\x00"), body).cast("binary"), 256)


def close_group(perms: Sequence[Sequence[int]], n: int, most: int = MOST_PERMUTATIONS) -> list[tuple[int, ...]]:
    """All products of the permutations of 0..n-1, on the driver."""
    gens = [tuple(p) for p in perms]
    if any(sorted(p) != list(range(n)) for p in gens):
        raise ValueError(f"not permutations of {n} places")
    seen = {tuple(range(n))}
    todo = list(seen)
    while todo:
        p = todo.pop()
        for g in gens:
            q = tuple(p[i] for i in g)
            if q not in seen:
                if len(seen) >= most:
                    raise ValueError(f"the group has more than {most} members")
                seen.add(q)
                todo.append(q)
    return sorted(seen)


def permute(items: Column, perm: Column) -> Column:
    return F.transform(perm, lambda i: F.element_at(items, i + 1))


def canonical_under(items: Column, group: Sequence[Sequence[int]]) -> Column:
    """The least relabelling of ``items`` under a closed group."""
    perms = F.array(*[F.array(*[F.lit(i) for i in p]) for p in group])
    best = F.array_min(F.transform(perms, lambda p: F.struct(quoted(permute(items, p)).alias("k"), permute(items, p).alias("v"))))
    return best["v"]


def canonical_set(items: Column) -> Column:
    """Under the full symmetric group: sorted by quoted form."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.to_json(F.array(x)).alias("k"), x.alias("v")))), lambda s: s["v"])


def orbit_digest(items: Column, group: Sequence[Sequence[int]] | None = None, domain: str = "orbit/v1") -> Column:
    form = canonical_set(items) if group is None else canonical_under(items, group)
    return F.sha2(F.concat(F.lit(domain + "\x00["), F.array_join(quoted(form), ","), F.lit("]")).cast("binary"), 256)
