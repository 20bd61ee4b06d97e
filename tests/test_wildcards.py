"""Fuzzy resolution against a full scan by the reference's rules."""

import random

from loomstone.operators import resolution
from test_operators import FIELDS, SCHEMA, ratio


def scan(c, registry, schema):
    """Every entity is scored; only a contradiction rejects it."""
    best, norm = None, lambda x: x.strip().lower()
    for seq, r in registry:
        scores = {f: ratio(c[f], r[f]) for f in schema.fuzzy if c[f] is not None and r[f] is not None}
        if not scores or any(norm(c[f] or "") and norm(r[f] or "") and norm(c[f]) != norm(r[f]) for f in schema.exact):
            continue
        both = [f for f in schema.identity if c[f] is not None and r[f] is not None]
        score = (sum(scores.values()) / len(scores) + sum(norm(c[f]) == norm(r[f]) for f in both) / len(both)) / 2
        if best is None or score > best[0]:
            best = (score, seq, all(s >= schema.fuzzy[f] for f, s in scores.items()))
    if best and best[2] and best[0] >= 0.85:
        return best[1], "strong"
    return (best[1], "probable") if best and best[0] >= 0.65 else None


def people(r, n):
    last, first = ["Marlowe", "marlow ", "Hartley", "Quimby", "Mar'lowe", None, ""], ["Ann", "Anna", "Bert", "Berta", None, " "]
    dob = ["1990-01-01", "1991-02-02", None, None, "", " "]
    return [(i, {"last": r.choice(last), "first": r.choice(first), "dob": r.choice(dob), "site": r.choice(["x", "y", None])}) for i in range(n)]


def check(spark, schema, seed):
    r = random.Random(seed)
    reg, cand = people(r, 60), people(r, 80)
    registry = spark.createDataFrame([(i, *x.values()) for i, x in reg], "seq long, " + FIELDS)
    candidates = spark.createDataFrame([(i, *x.values()) for i, x in cand], "cid long, " + FIELDS)
    got = {x.cid: (x.seq, x.tier) for x in resolution.resolve_similar(candidates, registry, schema).collect()}
    want = {i: b for i, c in cand if (b := scan(c, reg, schema))}
    assert got == want and len(want) > 40


def test_empty_exact_fields_are_wildcards(spark):
    check(spark, SCHEMA, 4)


def test_more_and_no_exact_fields(spark):
    check(spark, resolution.Schema("two", ("last", "first", "dob", "site"), {"last": 0.85, "first": 0.8}), 5)
    check(spark, resolution.Schema("names", ("last", "first"), {"last": 0.85, "first": 0.8}), 6)


def test_a_typo_without_birth_date_is_found(spark):
    registry = spark.createDataFrame([(1, "Marlowe", "Ann", "1990-01-01", None), (2, "Hartley", "Bert", None, None)], "seq long, " + FIELDS)
    candidates = spark.createDataFrame([(1, "Marlxowe", "Ann", None, None), (2, "Hartxley", "Bert", "1991-02-02", None)], "cid long, " + FIELDS)
    got = {x.cid: (x.seq, x.tier) for x in resolution.resolve(candidates, registry, SCHEMA).collect()}
    assert got == {1: (1, "probable"), 2: (2, "probable")}
