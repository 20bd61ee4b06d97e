import random

import pyarrow as pa

from loomstone.llm import folding, formatting

SCHEMA = "atom_id long, text string, entity string, key string, value string, id string, first string"


def same(a, b):
    x, y = pa.array([a], pa.string()), pa.array([b], pa.string())
    hashes = folding.column_hashes(pa.array([a, b], pa.string()))
    exact = bool(folding.same_content([x], [y])[0])
    assert exact == all(h[0] == h[1] for h in hashes)
    return exact


def test_what_is_formatting_and_what_is_content():
    for a, b in [
        ("owner=1511;window=9218", " Window: 9218 | OWNER:\t1511."),
        ('{"route":\xa0"kept custody", "retries": "8.6"}', "retries = 8.6 / route = KEPT custody"),
        ("stale\r\nconfidence", "“Stale, confidence”"),
        ("zero​width", "ZERO width"),
        (None, " \t"),
        ("Straße", "STRASSE"),
        ("[a: v6.40\nb: -91]", "b=-91, a=V6.40"),
    ]:
        assert same(a, b), (a, b)
    for a, b in [("a=1;b=2", "a=2;b=1"), ("-30", "30"), ("v1.2", "v12"), ("red blue", "blue red"), ("a=1;b=-2", "a=1;b=2"), ("+5", "5"), ("x", None)]:
        assert not same(a, b), (a, b)


def dirty(r, text):
    if text is None:
        return r.choice([None, "", " ​"])
    out = text.upper() if r.random() < 0.3 else text
    return r.choice(["", " ", "﻿", "("]) + out.replace(" ", r.choice([" ", "\t", "\xa0 ", "\n"])) + r.choice(["", ".", " ", ")"])


def rows(n, seed):
    r = random.Random(seed)
    base = [("the %d th note" % i, "tool:x-%d" % (i % 3), r.choice(["last_run", None]), r.choice(["-5", "5", "a=1;b=2"])) for i in range(n // 4)]
    out, truth = [], []
    for i in range(n):
        k = 0 if r.random() < 0.4 else r.randrange(len(base))
        out.append((i, *[dirty(r, x) for x in base[k]], "clash", "clash"))
        truth.append(base[k])
    return out, truth


def brute(truth):
    first = {}
    return sorted((first[t], i) for i, t in enumerate(truth) if first.setdefault(t, i) != i)


def test_groups_match_and_hot_group_is_salted(spark, monkeypatch):
    data, truth = rows(400, 1)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(truth)
    assert sorted(map(tuple, formatting.copy_groups(df).collect())) == want
    monkeypatch.setattr(formatting, "SALT_ROWS", 20)
    assert sorted(map(tuple, formatting.copy_groups(df).collect())) == want
    got = {x.atom_id: x.copies for x in formatting.collapse(df).collect()}
    assert sum(got.values()) == len(data) and len(got) == len(set(truth))


def test_collisions_are_regrouped_exactly(spark, monkeypatch):
    data, truth = rows(60, 2)
    real = formatting.hash_rows

    def colliding(df, key, fields):
        from pyspark.sql import functions as F

        return real(df, key, fields).withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(1).cast("long"))

    monkeypatch.setattr(formatting, "hash_rows", colliding)
    got = formatting.copy_groups(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(truth)


def test_empty_and_long(spark):
    assert formatting.copy_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 50_000
    df = spark.createDataFrame([(1, long, None, None, None, "", ""), (2, long.upper(), "", None, None, "", ""), (3, long + "x", None, None, None, "", "")], SCHEMA)
    assert [tuple(x) for x in formatting.copy_groups(df).collect()] == [(1, 2)]


def test_two_pointers_in_step_and_by_blocks(monkeypatch):
    r = random.Random(4)
    for _ in range(60):
        text = " ".join(r.choice(["ab", "c1", "-5", "x.y", "..."]) for _ in range(r.randrange(0, 40)))
        other = dirty(r, text) if r.random() < 0.6 else text + r.choice(["a", "9"])
        verdicts = set()
        for most in (10**9, 0):
            monkeypatch.setattr(folding, "IN_STEP", most)
            verdicts.add(bool(folding.same_content([pa.array([text])], [pa.array([other])])[0]))
        h = folding.column_hashes(pa.array([text, other], pa.string()))
        assert verdicts == {all(x[0] == x[1] for x in h)}
