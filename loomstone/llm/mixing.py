"""Mixing sources to target weights (problem 8).

A mixture's total is the greatest at which every source that has tokens can
give its share within its cap of repeats, so that the shares are reached and
no document is used more than ``max_repeats`` times.  Each source has a weight
that changes over training time u in [0, 1],

    w(u) = share * (1 + a * (1 - 2u)),

``a`` > 0 for sources that come early (those with short documents), and the
weights of a mixture sum to 1 at any time.  Integrated, this is the source's
cumulative token demand; a document's token offset within its source (and
repeat) put through the inverse demand gives its training position.

Offsets are prefix sums over hash buckets, so a source with any part of all
rows is spread over many tasks.

Defined results: targets without a positive share or cap, and sources without
tokens, get nothing and are reported with 0; shares are scaled to sum to 1
over the rest; texts without tokens are never used; sources are compared
without case, blanks and ``-``/``_``; a repeated target row counts once (the
greatest share and cap); repeated documents (same id) count once; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.tokens import TOKENIZER, token_counts
from loomstone.llm.truncation import source_key
from loomstone.session import materialize

#: Buckets of hash order within one source.
BUCKETS = 4096
#: Strongest tilt of a source's weight over time (below 1).
TILT = 0.5


def offsets(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, offset): each document's place in its source,
    in a fixed random order; written once, as it is read several times."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    rows = (
        token_counts(texts.where("text is not null and text != ''"), ["doc_id", "source"], "text", tokenizer)
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("source", "tokens"), "source").alias("d"))
        .select("doc_id", "d.source", "d.tokens")
        .where("tokens > 0")
        .withColumn("_h", F.xxhash64("doc_id"))
        .withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    )
    rows = materialize(rows)
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "_b").agg(F.sum("tokens").alias("_t"))
    base = base.select("source", "_b", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base"))
    return rows.join(base, ["source", "_b"]).select(
        "doc_id", "source", "tokens", (F.col("_base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("offset")
    )


def plan(targets: DataFrame, placed: DataFrame) -> DataFrame:
    """One row for each mixture and source: (mix_id, source, target_share,
    max_repeats, available, share, demand, total, tilt)."""
    sizes = placed.groupBy("source").agg(F.sum("tokens").alias("available"), F.avg("tokens").alias("mean"))
    wanted = (
        targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .groupBy("mix_id", "source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    mix = Window.partitionBy("mix_id")
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    rows = (
        wanted.join(sizes, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("_w", F.when(usable, F.col("target_share")).otherwise(0.0))
        .withColumn("share", F.coalesce(F.try_divide(F.col("_w"), F.sum("_w").over(mix)), F.lit(0.0)))
        .withColumn("total", F.min(F.try_divide(F.col("available") * F.col("max_repeats"), F.when(F.col("share") > 0, F.col("share")))).over(mix))
        .withColumn("demand", F.when(F.col("share") > 0, F.least(F.col("total") * F.col("share"), F.col("available") * F.col("max_repeats"))).otherwise(0.0))
    )
    # The tilt: early for short documents, centred so that weights sum to 1.
    raw = F.when(F.col("share") > 0, -F.log("mean"))
    centre = F.sum(F.col("share") * F.coalesce("_r", F.lit(0.0))).over(mix)
    reach = F.max(F.abs("_c")).over(mix)
    return (
        rows.withColumn("_r", raw)
        .withColumn("_c", F.col("_r") - centre)
        .withColumn("tilt", F.coalesce(F.lit(TILT) * F.try_divide(F.col("_c"), reach), F.lit(0.0)))
        .select("mix_id", "source", "target_share", "max_repeats", "available", "share", "total", "demand", "tilt")
    )


def weight(u: Column, share: Column, tilt: Column) -> Column:
    """A source's weight at training time u."""
    return share * (1 + tilt * (1 - 2 * u))


def demanded(u: Column, demand: Column, tilt: Column) -> Column:
    """The integral of the weight schedule: tokens of a source until time u."""
    return demand * (u + tilt * (u - u * u))


def time_of(tokens: Column, demand: Column, tilt: Column) -> Column:
    """The inverse of ``demanded``: when a source's demand reaches ``tokens``;
    null where it never does."""
    y = tokens / demand
    # The stable root of y = u + tilt * (u - u^2); it holds for tilt = 0 too.
    return F.when(y <= 1, 2 * y / ((1 + tilt) + F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * y))))


def positions(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, pass, tokens, position): every use of every
    document, at the time its source's demand reaches the middle of it.  A
    document's pass whose middle is never demanded is no use."""
    wanted = plans.where("demand > 0").select("mix_id", "source", "max_repeats", "available", "demand", "tilt")
    rows = placed.join(wanted, "source")
    passes = F.ceil(F.col("demand") / F.col("available")).cast("long")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("max_repeats"), passes) - 1)))
    middle = F.col("offset") + F.col("tokens") / 2 + F.col("pass") * F.col("available")
    rows = rows.withColumn("position", time_of(middle, F.col("demand"), F.col("tilt"))).where("position is not null")
    return rows.select("mix_id", "source", "doc_id", "pass", "tokens", "position")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats): the documents of each mixture,
    as many times as they have a training position."""
    placed = materialize(offsets(documents, tokenizer))
    used = positions(placed, plan(targets, placed))
    return used.groupBy("mix_id", "doc_id", "source", "tokens").agg(F.count("*").alias("repeats"))


def curriculum(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(mix_id, position, doc_id, pass, tokens) in training order: range-sorted
    by mixture and position in [0, 1]."""
    placed = materialize(offsets(documents, tokenizer))
    used = positions(placed, plan(targets, placed)).select("mix_id", "position", "doc_id", "pass", "tokens")
    return used.orderBy("mix_id", "position", "doc_id", "pass")


def progress(documents: DataFrame, targets: DataFrame, steps: int = 10, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per mixture, source and step of training time: the tokens its schedule
    asks for and those its documents give."""
    placed = materialize(offsets(documents, tokenizer))
    plans = materialize(plan(targets, placed))
    step = F.least(F.lit(steps - 1), F.floor(F.col("position") * steps)).cast("int")
    given = positions(placed, plans).groupBy("mix_id", "source", step.alias("step")).agg(F.sum("tokens").alias("tokens"))
    slots = plans.where("demand > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    until = lambda k: demanded(k / F.lit(float(steps)), F.col("demand"), F.col("tilt"))
    asked = until(F.col("step") + 1) - until(F.col("step"))
    rows = slots.select("mix_id", "source", "step", F.round(asked, 3).alias("asked")).join(given, ["mix_id", "source", "step"], "left")
    return rows.withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per mixture and source: target, tokens at hand, tokens used, the share
    reached and the most times one document is used."""
    placed = materialize(offsets(documents, tokenizer))
    plans = plan(targets, placed)
    used = positions(placed, plans).groupBy("mix_id", "source").agg(
        F.sum("tokens").alias("tokens"), (F.max("pass") + 1).alias("repeats"), F.sum((F.col("pass") == 0).cast("long")).alias("documents")
    )
    mix = Window.partitionBy("mix_id")
    return (
        plans.join(used, ["mix_id", "source"], "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .select(
            "mix_id", "source", "target_share", F.round("share", 6).alias("wanted_share"), "max_repeats", "available", "tokens",
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
            F.round(F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(mix)), F.lit(0.0)), 6).alias("reached_share"),
        )
    )
