"""A registry that grows record by record, against taking records one by one."""

import random

import pytest

from loomstone.operators import registry, resolution
from test_operators import FIELDS, SCHEMA
from test_wildcards import people, scan

NAMES = ("last", "first", "dob", "site")


def sign(x):
    return tuple((f, x[f].strip().lower()) for f in SCHEMA.identity if x[f] is not None)


def one_by_one(reg, cand):
    known, out, base = list(reg), {}, max(i for i, _ in reg) + 1
    for cid, x in cand:
        exact = [s for s, r in known if sign(r) == sign(x)]
        if exact:
            out[cid] = ("exact", exact[0], False)
            continue
        best = scan(x, known, SCHEMA)
        if best and best[1] == "strong":
            out[cid] = ("strong", best[0], False)
            continue
        tier = "probable" if best else "none"
        if not best:
            norm = lambda v: (v or "").strip().lower()
            if norm(x["site"]) and any(norm(r["site"]) == norm(x["site"]) and any(norm(x[f]) and norm(x[f]) == norm(r[f]) for f in SCHEMA.identity) for _, r in known):
                tier = "context"
        out[cid] = (tier, base + cid, True)
        known.append((base + cid, x))
    return out


def test_records_match_what_the_batch_created_before(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        reg, cand = people(r, 8), people(r, 70)
        known = spark.createDataFrame([(i, *x.values()) for i, x in reg], "seq long, " + FIELDS)
        rows = spark.createDataFrame([(i, *x.values()) for i, x in cand], "cid long, " + FIELDS)
        got = {x.cid: (x.tier, x.entity, x.created) for x in registry.register(rows, known, SCHEMA).collect()}
        want = one_by_one(reg, cand)
        # Records of one signature share their first one's decision.
        firsts = {}
        for cid, x in cand:
            firsts.setdefault(sign(x), cid)
        assert all(got[cid] == want[cid] for cid in firsts.values()), [(c, got[c], want[c]) for c in firsts.values() if got[c] != want[c]]
        assert len(got) == len(cand) and all(got[c][1] == got[firsts[sign(x)]][1] for c, x in cand)


def test_empty_registry_and_batch(spark):
    none = spark.createDataFrame([], "seq long, " + FIELDS)
    two = spark.createDataFrame([(0, "Marlowe", "Ann", "1990-01-01", None), (1, "MARLOWE ", "ann", "1990-01-01", "x")], "cid long, " + FIELDS)
    got = {x.cid: (x.tier, x.entity, x.created) for x in registry.register(two, none, SCHEMA).collect()}
    assert got == {0: ("none", 1, True), 1: ("exact", 1, False)}
    assert registry.register(two.where("false"), none, SCHEMA).count() == 0


def test_plan_and_upsert(spark):
    schema = resolution.Schema("p", ("last", "first", "dob"), {"last": 0.85, "first": 0.8}, ("site",), ("note",))
    columns = "last string, first string, dob string, site string, note string"
    known = spark.createDataFrame([(1, "Marlowe", "Ann", "1990-01-01", None, "It is red.")], "seq long, " + columns)
    rows = spark.createDataFrame([(0, "marlowe", "Ann", "1990-01-01", "north", "It is big."), (1, "Quimby", "Bert", None, "south", None), (2, "Marlow", "Ann", "1990-01-01", "west", None)], "cid long, " + columns)
    decisions = registry.register(rows, known, schema)
    steps = {(x.cid, x.field): (x.action, x.kept) for x in registry.plan(rows, decisions, known, schema, registry.Policy(combine=("note",))).collect()}
    assert steps[0, "site"] == ("fill", "north") and steps[0, "note"] == ("combine", "It is red. It is big.")
    after, merges = registry.upsert(rows, decisions, known, schema)
    state = {x.seq: x for x in after.collect()}
    assert state[1].site == "north" and state[1].note == "It is red." and state[1].last == "Marlowe"
    assert sum(x.sightings for x in state.values()) == 3 and merges.count() == sum(x.review is not None for x in decisions.collect())
    assert registry.inert(schema, registry.Policy(combine=("note", "dob", "odd"))) == {"dob": "identity", "odd": "undeclared"}
    meta = registry.guard(None, schema, spark)
    assert registry.guard(meta, schema, spark) is meta
    with pytest.raises(ValueError):
        registry.guard(meta, resolution.Schema("q", ("last",)), spark)
    assert registry.entities(rows, schema).select("entity_id").distinct().count() == 3
