"""Scoring of matches, thresholds and rankings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.normalize import strip_accents
from loomstone.operators.orbit import cycle_digest


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_set(*cols: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *cols)), r"\s+"), lambda w: w != ""))


def accuracy(pairs: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """Per group: pairs, recall, precision and false matches among differing pairs."""
    p, a = F.col(predicted), F.col(actual)
    n = lambda c: F.sum(c.cast("int"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.round(F.try_divide(n(p & a), n(a)), 6).alias("recall"), F.round(F.try_divide(n(p & a), n(p)), 6).alias("precision"), F.round(F.try_divide(n(p & ~a), n(~a)), 6).alias("false_match")
    )


def calibration(pairs: DataFrame, tier: str, stated: str, actual: str) -> DataFrame:
    """Per tier: pairs, stated confidence and share that is right."""
    return pairs.groupBy(tier).agg(F.count("*").alias("pairs"), F.round(F.avg(stated), 6).alias("stated"), F.round(F.avg(F.col(actual).cast("double")), 6).alias("actual"))


def threshold_sweep(pairs: DataFrame, score: str, actual: str, thresholds: list[float]) -> DataFrame:
    """(threshold, caught, wrong): each row is counted at once for all thresholds
    it reaches, in one pass and no join."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t)
    rows = pairs.select(F.explode(reached).alias("threshold"), F.col(actual).alias("a"))
    return rows.groupBy("threshold").agg(F.sum(F.col("a").cast("int")).alias("caught"), F.sum((~F.col("a")).cast("int")).alias("wrong"))


def ranking_scores(ranked: DataFrame, query: str, rank: str, relevant: str, totals: DataFrame, k: int = 5) -> DataFrame:
    """(query, recall, ndcg) at k; the ideal order is that of what was retrieved."""
    top = ranked.where(F.col(rank) <= k)
    ideal = Window.partitionBy(query).orderBy(F.desc(relevant), rank)
    rows = top.withColumn("_i", F.row_number().over(ideal)).withColumn("_r", F.col(relevant).cast("double"))
    gain = rows.groupBy(query).agg(F.sum(F.col("_r") / F.log2(F.col(rank) + 1)).alias("dcg"), F.sum(F.col("_r") / F.log2(F.col("_i") + 1)).alias("best"), F.sum("_r").alias("hits"))
    return gain.join(totals, query).select(
        query, F.round(F.try_divide("hits", F.col("total")), 6).alias("recall"), F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg")
    )


def mutations(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, family, same, fields...): records changed by fixed rules, the
    ground truth of a resolver."""
    families = {
        "case": (True, lambda c: F.upper(c)), "whitespace": (True, lambda c: F.concat(F.lit("  "), F.regexp_replace(c, " ", "   "), F.lit(" "))),
        "typo_substitution": (True, lambda c: F.concat(F.substring(c, 1, 2), F.lit("x"), c.substr(F.lit(4), F.length(c)))), "typo_insertion": (True, lambda c: F.concat(F.substring(c, 1, 2), F.lit("q"), c.substr(F.lit(3), F.length(c)))),
        "unicode_normalization": (True, lambda c: strip_accents(c)), "negative_control": (False, lambda c: F.reverse(c)), "garbled_all_fields": (False, lambda c: F.substring(F.sha2(c, 256), 1, 8)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(s).alias("same"), *[f(F.col(x)).alias(x) for x in fields]) for n, (s, f) in families.items()])
    return records.select(key, F.explode(rows).alias("m")).select(key, "m.*")


def surface_forms(texts: DataFrame, entities: list[str], source: str, text: str) -> DataFrame:
    """(entity, source, form, n): how each source writes each entity, as whole
    words in any case; ``entities`` is the stated set, looked for in one pass."""
    folded = {e.lower(): e for e in entities if e}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for low, entity in folded.items():
            machine.add_word(low, (low, entity))
        machine.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        counts: dict = {}
        for pdf in batches:
            for own, body in zip(pdf["s"], pdf["t"]):
                low = body.lower()
                if len(low) != len(body):  # a letter whose lower case is longer
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
                for end, (found, entity) in machine.iter(low):
                    begin = end + 1 - len(found)
                    if (begin == 0 or not word(body[begin - 1])) and (end + 1 == len(body) or not word(body[end + 1])):
                        k = (entity, own, body[begin : end + 1])
                        counts[k] = counts.get(k, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["entity", "source", "form", "n"]).astype({"n": "int64"})

    rows = texts.where(F.col(text).isNotNull()).select(F.coalesce(source, F.lit("unknown")).alias("s"), F.col(text).alias("t"))
    part = rows.mapInPandas(run, "entity string, source string, form string, n long") if folded else rows.limit(0).selectExpr("s entity", "s source", "s form", "0L n")
    return part.groupBy("entity", "source", "form").agg(F.sum("n").alias("n"))


def structure_pairs(rings: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, relation, same, caught): each ring against other writings of itself
    and against a sibling of the same members, and whether digests agree."""
    seq = F.col(ring)
    n = F.size(seq)
    turned = F.concat(F.slice(seq, F.lit(2), n - 1), F.slice(seq, F.lit(1), F.lit(1)))
    swapped = F.concat(F.slice(seq, F.lit(2), F.lit(1)), F.slice(seq, F.lit(1), F.lit(1)), F.slice(seq, F.lit(3), n - 2))
    rows = rings.where(n >= 4).select(key, seq.alias("a"), F.explode(F.array(
        F.struct(F.lit("rotation").alias("relation"), F.lit(True).alias("same"), turned.alias("b")), F.struct(F.lit("reflection").alias("relation"), F.lit(True).alias("same"), F.reverse(seq).alias("b")),
        F.struct(F.lit("sibling").alias("relation"), F.lit(False).alias("same"), swapped.alias("b")),
    )).alias("x")).select(key, "a", "x.*")
    return rows.select(key, "relation", "same", (cycle_digest(F.col("a")) == cycle_digest(F.col("b"))).alias("caught"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 of measured times."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], 10_000)
    return df.groupBy(*by).agg(F.count("*").alias("n"), p.alias("p")).select(*by, "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))
