"""Reports and traces fit for others: flagged values, re-chaining, bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators.audit import REDACT, residual_scan, scrub, token
from loomstone.operators.jobs import fingerprinted
from loomstone.operators.trace import seal, verify_chains

#: Characters a flagged value must have to be looked for in free text, and
#: those of a summary.
LEAST_LITERAL, SUMMARY = 8, 120


def secret_class(value: Column) -> Column:
    return F.coalesce(*[F.when(value.rlike(p), F.lit(c)) for c, p in REDACT], F.lit("embedded_secret"))


def flagged(secrets: DataFrame) -> DataFrame:
    """(report_id, value, token, swept): a report's flagged values, what stands
    in for them, and whether they are long enough to be swept from free text."""
    rows = secrets.where(F.length("value") > 0).select("report_id", "value").distinct()
    cases = None
    for c, p in REDACT:
        hit = F.col("value").rlike(p)
        cases = F.when(hit, token(c, F.col("value"))) if cases is None else cases.when(hit, token(c, F.col("value")))
    return rows.select("report_id", "value", cases.otherwise(token("embedded_secret", F.col("value"))).alias("token"), (F.length("value") >= LEAST_LITERAL).alias("swept"))


def sweep(texts: DataFrame, values: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` (with report_id) with their report's flagged values replaced
    where no letter or digit adjoins, longer ones first, and other secrets
    after them."""
    lists = values.where("swept").groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("l"), "value", "token"))).alias("_v"))
    rows = texts.join(lists, "report_id", "left")
    whole = lambda v: F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), v, F.lit(r"\E(?![0-9A-Za-z])"))
    swept = F.aggregate(F.coalesce("_v", F.array().cast("array<struct<l:int,value:string,token:string>>")), F.col(text), lambda t, v: F.regexp_replace(t, whole(v["value"]), v["token"]))
    return rows.withColumn(text, scrub(swept)).drop("_v")


def rechain(events: DataFrame, values: DataFrame) -> DataFrame:
    """(run_id, seq, raw): the events of each report's run, swept and sealed
    anew.  ``events`` has run_id (the report's id), seq and body."""
    clean = sweep(events.withColumn("report_id", F.col("run_id")), values, "body")
    return seal(clean.select("run_id", "seq", "body"))


def bundles(reports: DataFrame, events: DataFrame, secrets: DataFrame) -> DataFrame:
    """(report_id, status, events, short, safe): each report (report_id, text)
    redacted with its events.  ``skipped`` without a trace; ``safe`` only if
    its new chain holds and no secret is left in text or trace; ``short``
    counts values too short to be swept, for a reader to look at."""
    values = flagged(secrets)
    texts = sweep(reports.select("report_id", "text"), values)
    chain = rechain(events, values)
    checked = verify_chains(chain).select(F.col("run_id").alias("report_id"), "events", "ok")
    left = residual_scan(texts, "report_id", "text").select("report_id").unionByName(residual_scan(chain, "run_id", "raw").select(F.col("run_id").alias("report_id"))).distinct()
    few = values.where("not swept").groupBy("report_id").agg(F.count("*").alias("short"))
    rows = reports.select("report_id").join(checked, "report_id", "left").join(left.withColumn("leaks", F.lit(True)), "report_id", "left").join(few, "report_id", "left")
    return rows.select(
        "report_id", F.when(F.col("ok").isNull(), "skipped").otherwise("redacted").alias("status"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("short", F.lit(0)).alias("short"),
        (F.coalesce("ok", F.lit(False)) & F.col("leaks").isNull()).alias("safe"),
    )


@F.pandas_udf(T.StringType())
def _clean(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else fingerprinted(x))


def summary(text: Column, keep: str = "head", most: int = SUMMARY) -> Column:
    """A text on one line without secrets, cut to ``most`` characters; ``tail``
    keeps its end, as paths need."""
    line = F.trim(F.regexp_replace(_clean(text), r"(?U)\s+", " "))
    cut = F.concat(F.lit("…"), F.right(line, F.lit(most - 1))) if keep == "tail" else F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))
    return F.when(F.length(line) <= most, line).otherwise(cut)


def listing(registry: DataFrame, group: str, name: str, widths: tuple[int, int] = (24, 48)) -> DataFrame:
    """(line): a registry's entries in columns, by group and name."""
    return registry.select(F.rtrim(F.concat(F.rpad(F.coalesce(group, F.lit("")), widths[0], " "), F.rpad(F.coalesce(name, F.lit("")), widths[1], " "))).alias("line")).orderBy("line")


def seed(registry: DataFrame, new: DataFrame, key: str, fields: list[str], prefixes: list[str] | None = None) -> DataFrame:
    """(key, action): what seeding a registry does with each new entry.

    ``added``; ``kept`` if it is there just so, so seeding twice changes
    nothing; ``stale`` if it is there with other fields; ``no prefix`` if its
    key begins with none of the ``prefixes``."""
    known = registry.select(F.col(key), F.struct(*fields).alias("_old")).dropDuplicates([key])
    rows = new.select(key, F.struct(*fields).alias("_new")).dropDuplicates([key]).join(known, key, "left")
    bad = F.lit(False) if prefixes is None else ~F.coalesce(F.array_max(F.array(*[F.col(key).startswith(p) for p in prefixes])), F.lit(False))
    action = F.when(bad, "no prefix").when(F.col("_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "kept").otherwise("stale")
    return rows.select(key, action.alias("action"))
