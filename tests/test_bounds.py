"""Bounds that keep pairs from being scored: never below the similarity."""

import random

from loomstone.functions import normalize as n
from loomstone.operators import resolution
from pyspark.sql import functions as F

PEOPLE = "last string, first string, dob string, site string"
SCHEMA = resolution.Schema("p", ("last", "first", "dob"), {"last": 0.85, "first": 0.8}, ("site",))


def test_no_similarity_exceeds_its_bound(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("AABNZÖ -7" if r.random() < 0.7 else "ABCDEFGH") for _ in range(r.choice([0, 1, 3, 7, 9, 30])))
    rows = [(a, b) for a in [word() for _ in range(60)] for b in [word(), a[: len(a) // 2], a[1:], a[::-1], a + "X", a]]
    df = spark.createDataFrame(rows, "a string, b string").select("*", n.letters("a").alias("la"), n.letters("b").alias("lb"))
    df = n.normalized_similarity(df.withColumn("most", n.similarity_bound(F.col("la"), F.col("lb"))), "a", "b", "s")
    got = df.select("a", "b", "s", "most").collect()
    assert not [x for x in got if x.s > x.most + 1e-12] and sum(x.most < 0.65 for x in got) > 60


def test_people_of_one_day_are_not_all_scored(spark):
    """Of 90,000 pairs that share the day of birth only those near the least score remain."""
    r = random.Random(9)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(i, name(), name(), "1990-01-01", None) for i in range(300)]
    registry = spark.createDataFrame(rows, "seq long, " + PEOPLE)
    candidates = spark.createDataFrame([(i, a[:3] + "x" + a[3:], *x) for i, a, *x in rows], "cid long, " + PEOPLE)
    pairs = resolution._blocked(candidates, registry, SCHEMA)
    assert 300 <= pairs.count() < 1000 and pairs.where("cid = seq").count() == 300
