"""Captions against every pair of an image and a caption."""

import random
import time

from pyspark.sql import functions as F

from loomstone.operators import knowledge

IMAGES, BLOCKS = "image_id long, page string, y0 double, y1 double", "page string, y0 double, y1 double, text string"


def rank(image, block, below=100, above=100, penalty=200):
    (_, _, y0, y1), (_, b0, b1, text) = image, block
    gap = None
    if None not in (b0, y1) and 0 <= b0 - y1 < below:
        gap = b0 - y1
    elif None not in (y0, b1) and 0 <= y0 - b1 < above:
        gap = y0 - b1 + penalty
    far, away = gap is None, None if None in (y0, y1, b0, b1) else abs((b0 + b1) / 2 - (y0 + y1) / 2)
    least = lambda x: (x is not None, x or 0)
    return far, least(away if far else gap), least(b0), text


def test_nearest_of_all_pairs(spark):
    r = random.Random(3)
    at = lambda: r.choice([None, *[float(x * 10) for x in range(60)] * 2])
    images, blocks = [], []
    for i in range(500):
        y, size = at(), r.choice([20, 50, 50.5, None])
        images.append((i % 450, f"p{r.randrange(9)}" if i % 50 else None, y, y + size if None not in (y, size) else at()))
        b, text = at(), r.choice(["Figure", "table", "fig.", "Text"]) + f" {r.randrange(90)}"
        if i % 3 == 0:
            blocks.append((f"p{r.randrange(8)}" if i % 50 else None, b, b + 10 if b is not None and i % 7 else at(), text))
    want = {}
    for x in images:
        for y in blocks:
            if x[1] is not None and x[1] == y[0] and not y[3].startswith("Text"):
                want[x[0]] = min(want.get(x[0], rank(x, y)), rank(x, y))
    got = {x.image_id: x.text for x in knowledge.captions(spark.createDataFrame(images, IMAGES), spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert got == {k: v[3] for k, v in want.items()} and len(got) > 300


def test_a_full_page_is_no_product(spark):
    """40,000 images and 40,000 captions on one page, each at a place of its own."""
    rows = spark.range(40_000).select("id", F.lit("p").alias("page"), (F.col("id") * 100.0).alias("y0"))
    images = rows.select(F.col("id").alias("image_id"), "page", "y0", (F.col("y0") + 50).alias("y1"))
    blk = rows.select("page", (F.col("y0") + 60).alias("y0"), (F.col("y0") + 70).alias("y1"), F.concat(F.lit("Figure "), "id").alias("text"))
    begun = time.monotonic()
    found = knowledge.captions(images, blk).where("text = concat('Figure ', image_id)").count()
    assert found == 40_000 and time.monotonic() - begun < 30
