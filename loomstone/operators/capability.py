"""Delegated access: scopes, caveats, attenuation, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: Column) -> Column:
    """A glob (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    text = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[!", "[^"), r"\*", ".*"), r"\?", "."), F.lit("$"))


def scope_matches(scope: Column, patterns: Column) -> Column:
    return F.coalesce(F.exists(patterns, lambda p: F.rlike(scope, glob_regex(p))), F.lit(False))


def scope_covered(child: Column, parents: Column) -> Column:
    """Whether a pattern is surely no broader than one of ``parents``: equal to
    it, or its text matched by one whose only wildcard is ``*``."""
    return F.exists(parents, lambda p: (p == child) | (~p.rlike(r"[?\[\]]") & F.rlike(child, glob_regex(p))))


def has_capability(token_caps: Column, action: str) -> Column:
    return F.coalesce(F.array_contains(token_caps, action), F.lit(False))


def is_expired(expires_at: Column, now: Column) -> Column:
    from loomstone.functions.instants import parse_instant

    return F.coalesce(parse_instant(now) >= parse_instant(expires_at), F.lit(False))


def caveat_holds(caveat: Column, scope: Column, depth: Column, now: Column, strict: bool = True) -> Column:
    """Whether one caveat permits the request; unknown types raise or deny."""
    unknown = F.raise_error(F.concat(F.lit("unknown caveat type: "), caveat["type"])).cast("boolean") if strict else F.lit(False)
    z = F.when(caveat["value"].endswith("Z"), now < caveat["value"]).otherwise(F.lit(False))
    return (
        F.when(caveat["type"] == "expires_at", z)
        .when(caveat["type"] == "scope_limit", scope.isNull() | F.rlike(scope, glob_regex(caveat["value"])))
        .when(caveat["type"] == "max_delegation_depth", depth <= caveat["value"].cast("int"))
        .otherwise(unknown)
    )


def caveats_hold(caveats: Column, scope: Column, depth: Column, now: Column, strict: bool = True) -> Column:
    return F.coalesce(F.forall(caveats, lambda c: caveat_holds(c, scope, depth, now, strict)), F.lit(True))


def attenuation_issues(tokens: DataFrame, parent: str = "parent_cap_id") -> DataFrame:
    """(token_id, issue): what a delegated token holds beyond its parent."""
    none = F.array().cast("array<string>")
    c = tokens.dropDuplicates(["token_id"]).withColumn("_p", F.lower(F.trim(parent)))
    p = tokens.dropDuplicates(["token_id"]).select(
        F.lower("token_id").alias("_p"), F.coalesce("capabilities", none).alias("p_caps"), F.coalesce("scopes", none).alias("p_scopes"),
        F.col("budget_usd").alias("p_budget"), F.col("expires_at").alias("p_expires"),
    )
    rows = c.join(p, "_p")
    wide = F.exists(F.coalesce("scopes", none), lambda s: ~scope_covered(s, F.col("p_scopes")))
    issues = F.array_compact(F.array(
        F.when(F.size(F.array_except(F.coalesce("capabilities", none), F.col("p_caps"))) > 0, "capabilities"),
        F.when(wide, "scopes"),
        F.when(~F.coalesce(F.col("budget_usd") <= F.col("p_budget"), F.lit(False)), "budget"),
        F.when(F.col("p_expires").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("p_expires"))), "expiry"),
    ))
    return rows.select("token_id", F.explode(issues).alias("issue"))


def _spent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    here, spent = None, 0.0
    for pdf in batches:
        ok, total = [], []
        for key, amount, budget in zip(pdf["k"].tolist(), pdf["a"].tolist(), pdf["b"].tolist()):
            if key != here:
                here, spent = key, 0.0
            good = spent + amount <= budget
            spent += amount if good else 0.0
            ok.append(good)
            total.append(spent)
        yield pdf[["k", "o", "a"]].assign(ok=ok, spent=total)


def budget_ledger(spends: DataFrame, budgets: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """(key, order, amount, accepted, spent): spends in order; one that would
    exceed the budget is rejected and doesn't count, so this is an ordered fold
    and no running sum.  A key's spends stream through a task in order; nothing
    but the sum is held."""
    rows = spends.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(amount).cast("double").alias("a"))
    rows = rows.join(budgets.select(F.col(key).alias("k"), F.col("budget").cast("double").alias("b")), "k")
    ordered = rows.where("a is not null").repartition("k").sortWithinPartitions("k", "o", "a")
    kinds = dict(spends.dtypes)
    folded = ordered.mapInPandas(_spent, f"k {kinds[key]}, o {kinds[order]}, a double, ok boolean, spent double")
    return folded.select(F.col("k").alias(key), F.col("o").alias(order), F.col("a").alias(amount), F.col("ok").alias("accepted"), "spent")
