"""Normalizing scalars as Column expressions (all JVM-side but the similarity)."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Normalizer = Callable[[Column], Column]


def pytrim(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_empty(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (pytrim(c) == "")


def normalize_name(c: Column) -> Column:
    """Upper case, trimmed, punctuation but hyphens dropped, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(pytrim(F.upper(c)), r"(?U)[^\w\s-]", ""), r"(?U)\s+", " ")


def strip_punctuation(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)[^\w\s-]", ""), F.lit(""))


def first_initial(c: Column) -> Column:
    return F.coalesce(F.upper(F.substring(F.regexp_replace(pytrim(c), r"^\.+", ""), 1, 1)), F.lit(""))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks (no JVM built-in)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_date(c: Column) -> Column:
    """ISO date of the first of eight written forms that fits, or null.

    Month before day where both fit; a two-digit year from 69 on is 19xx.
    """
    text = F.initcap(F.lower(pytrim(c)))
    two = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    century = F.when(two == "", None).when(two.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    forms = [
        (text, r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (text, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"), (text, r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
        (text, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"), (text, r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, y"), (text, r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, y"),
        (text, r"^\d{8}$", "yyyyMMdd"), (F.concat(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)\d{2}$", 1), century, two), r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    ]
    parsed = [F.when(t.rlike(shape), F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(fmt))) for t, shape, fmt in forms]
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd")


def age_bucket(age: Column, size: int = 2) -> Column:
    low = F.floor(age / size) * size
    return F.concat_ws("-", low.cast("string"), (low + size - 1).cast("string"))


def scalars_equivalent(a: Column, b: Column) -> Column:
    """Equality without regard to case and white space; null equals only null."""
    fold = lambda c: F.lower(F.regexp_replace(pytrim(c.cast("string")), r"(?U)\s+", " "))
    return fold(a).eqNullSafe(fold(b))


def pipeline(*steps: Normalizer) -> Normalizer:
    """One normalizer that applies ``steps`` from left to right."""
    return lambda c: reduce(lambda x, f: f(x), steps, c)


def apply_normalizers(df: DataFrame, normalizers: Mapping[str, Normalizer]) -> DataFrame:
    return df.withColumns({name: f(F.col(name)) for name, f in normalizers.items() if name in df.columns})


@F.pandas_udf(T.DoubleType())
def _matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of longest matching blocks, once for each pair of a batch; null
    where either is."""
    known: dict = {}
    match = difflib.SequenceMatcher(None)
    for x, y in sorted({(x, y) for x, y in zip(a, b) if x is not None and y is not None}, key=lambda p: p[1]):
        if match.b != y:
            match.set_seq2(y)
        match.set_seq1(x)
        known[x, y] = match.ratio()
    return pd.Series([known.get(p) for p in zip(a, b)], dtype=float)


def _decided(a: Column, b: Column, prefix: Column) -> Column:
    """What of two normalized names tells their similarity at once, else null."""
    la, lb = F.length(a), F.length(b)
    ratio = la / F.when(lb > 0, lb)
    return F.when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(~prefix & ((ratio < 0.5) | (ratio > 2.0)), 0.0)


def _prefix(a: Column, b: Column) -> Column:
    return (F.least(F.length(a), F.length(b)) >= 3) & (F.startswith(a, b) | F.startswith(b, a))


def normalized_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the similarity of two columns of normalized names, null where either
    is: 0 or 1 where blanks, equality or very unequal lengths tell, else the
    ratio of longest matching blocks, 0.85 at least for a prefix."""
    x, y = F.col(a), F.col(b)
    prefix = _prefix(x, y)
    open_ = _decided(x, y, prefix).isNull()
    rows = df.withColumn("_r", _matching_ratio(F.when(open_, x), F.when(open_, y)))
    ratio = F.when(prefix, F.greatest("_r", F.lit(0.85))).otherwise(F.col("_r"))
    return rows.withColumn(out, F.when(x.isNotNull() & y.isNotNull(), F.coalesce(_decided(x, y, prefix), ratio))).drop("_r")


@F.pandas_udf(T.StructType([T.StructField("bits", T.LongType()), T.StructField("rest", T.IntegerType()), T.StructField("size", T.IntegerType())]))
def letters(s: pd.Series) -> pd.DataFrame:
    """How often a normalized name has each letter: two bits for each of A to Z,
    ten for all other characters; what they don't hold counts as rest; size is
    its length."""
    known: dict = {}
    for name in set(s.dropna()):
        bits, count = 0, Counter(c if "A" <= c <= "Z" else "" for c in name)
        held = 0
        for c, n in count.items():
            at, most = (2 * (ord(c) - 65), 2) if c else (52, 10)
            bits |= ((1 << min(n, most)) - 1) << at
            held += min(n, most)
        known[name] = bits, len(name) - held, len(name)
    return pd.DataFrame([known.get(x, (0, 0, 0)) for x in s], columns=["bits", "rest", "size"])


def similarity_bound(a: Column, b: Column) -> Column:
    """What ``normalized_similarity`` doesn't exceed, from both names' ``letters``
    alone: no more characters match than both have."""
    common = F.bit_count(a["bits"].bitwiseAND(b["bits"])) + F.least(a["rest"], b["rest"])
    least, most = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
    ratio = 2.0 * common / (least + most)
    # Only where the shorter name's letters are all in the longer one can it be a prefix.
    return F.when(least == 0, 0.0).when((least >= 3) & (common >= least), F.greatest(ratio, F.lit(0.85))).when(least * 2 < most, 0.0).otherwise(ratio)


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the similarity of two name columns.

    Equal names, blanks, prefixes and very unequal lengths are decided in the
    JVM; a Python function would run on all rows of a ``when``, so only the
    rows that need the longest-matching-blocks ratio are sent to it.
    """
    na, nb = F.coalesce(normalize_name(F.col(a)), F.lit("")), F.coalesce(normalize_name(F.col(b)), F.lit(""))
    rows = df.withColumn("_a", na).withColumn("_b", nb)
    rows = rows.withColumn("_p", _prefix(F.col("_a"), F.col("_b"))).withColumn(out, _decided(F.col("_a"), F.col("_b"), F.col("_p")))
    costly = rows.where(F.col(out).isNull()).withColumn("_r", _matching_ratio("_a", "_b"))
    costly = costly.withColumn(out, F.when(F.col("_p"), F.greatest("_r", F.lit(0.85))).otherwise(F.col("_r"))).drop("_r")
    return rows.where(F.col(out).isNotNull()).unionByName(costly).drop("_a", "_b", "_p")
