"""Secrets, evidence and vocabulary."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Secrets that are replaced by a fingerprint, specific ones first.
REDACT = [
    ("google_api_key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("aws_cognito_identity_pool", r"\b[a-z]{2}-[a-z]+-\d:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("aws_cognito_user_pool", r"\b[a-z]{2}-[a-z]+-\d_[A-Za-z0-9]{8,}\b"),
    ("aws_api_gateway", r"(?:https?://)?[a-z0-9]+\.execute-api\.[a-z0-9-]+\.amazonaws\.com[^\s\"']*"),
    ("firebase_app_id", r"\b\d:\d{6,}:android:[0-9a-f]+\b"),
    ("firebase_rtdb", r"(?:https?://)?[a-z0-9-]+\.firebaseio\.com[^\s\"']*"),
    ("firebase_bucket", r"\b[a-z0-9][a-z0-9._-]*\.(?:firebasestorage\.app|appspot\.com)\b"),
    ("oauth_client_id", r"\b\d+-[a-z0-9]+\.apps\.googleusercontent\.com\b"),
]
# Secrets that are only reported.
DETECT = [
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("private_key_block", r"-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("github_token", r"\bghp_[0-9A-Za-z]{36}\b"),
    ("stripe_live_key", r"\bsk_live_[0-9A-Za-z]{16,}\b"),
    ("generic_bearer", r"\b[A-Za-z0-9_-]*(?:secret|token|password)[A-Za-z0-9_-]*\s*[=:]\s*[A-Za-z0-9._\-]{12,}"),
]
LEAST_ENTROPY = 3.9


def token(cls: str, value: Column) -> Column:
    return F.concat(F.lit(f"<REDACTED:{cls} fp:"), F.substring(F.sha2(value, 256), 1, 12), F.lit(">"))


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[str, re.Pattern]]:
    return [(cls, re.compile(pattern)) for cls, pattern in REDACT]


@F.pandas_udf(T.StringType())
def _scrub(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is not None:
            for cls, pattern in _compiled():
                text = pattern.sub(lambda m, c=cls: f"<REDACTED:{c} fp:{hashlib.sha256(m[0].encode()).hexdigest()[:12]}>", text)
        return text

    return texts.map(one)


def scrub(text: Column) -> Column:
    """The text with every secret replaced by a token that equal secrets share,
    in Arrow batches: one pass a class, which the JVM would interpret."""
    return _scrub(text)


def entropy(c: Column) -> Column:
    """Bits per character."""
    chars = F.split(c, "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(F.length(c) > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def residual_scan(texts: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """(key, class, sample): secrets still in redacted texts."""
    bare = F.regexp_replace(F.col(text), r"<REDACTED:[^>]*>", "")
    hits = lambda cls, p: F.transform(F.regexp_extract_all(bare, F.lit(f"({p})"), 1), lambda m: F.struct(F.lit(cls).alias("class"), F.substring(m, 1, 48).alias("sample")))
    groups = [hits(f"residual:{c}", p) for c, p in REDACT] + [hits(f"unhandled:{c}", p) for c, p in DETECT]
    if strict:
        runs = F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z0-9_\-]{20,})\b"), 1)
        keyish = F.filter(runs, lambda m: ~m.startswith("REDACTED") & ~m.rlike("^[0-9a-f]{32,64}$") & (entropy(m) >= LEAST_ENTROPY))
        groups.append(F.transform(keyish, lambda m: F.struct(F.lit("strict:high_entropy").alias("class"), F.substring(m, 1, 48).alias("sample"))))
    rows = texts.select(key, F.explode(F.flatten(F.array(*groups))).alias("f"))
    return rows.select(key, "f.*")


#: Characters of evidence that are looked for in one pass over the corpus.
BLOCK_CHARS = 2_000_000


def _holding(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text, own in shared.value.items():
            machine.add_word(text, own)
        machine.make_automaton()
        seen: set = set()
        for pdf in batches:
            for text in pdf["text"]:
                for _, own in machine.iter(text):
                    seen.update(own)
        yield pd.DataFrame({"key": sorted(seen)})

    return run


def verify_evidence(evidence: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): whether an evidence string stands in some text of the corpus.

    Evidence is a stated set of strings: it is read in blocks of bounded size,
    each looked for in one pass over the corpus by an automaton of all of its
    strings.  Null and empty evidence isn't found."""
    spark = evidence.sparkSession
    texts = corpus.select(F.col(text).cast("string").alias("text")).where("text is not null")
    found = spark.createDataFrame([], "key string")
    block: dict[str, list] = {}
    size = 0

    def scan() -> DataFrame:
        return texts.mapInPandas(_holding(spark.sparkContext.broadcast(dict(block))), "key string")

    for row in evidence.where("evidence is not null and evidence != ''").select(F.col(key).cast("string").alias("k"), "evidence").toLocalIterator():
        if block and size + len(row.evidence) > BLOCK_CHARS:
            found = found.unionByName(scan())
            block, size = {}, 0
        block.setdefault(row.evidence, []).append(row.k)
        size += len(row.evidence)
    if block:
        found = found.unionByName(scan())
    hits = found.distinct().withColumn("found", F.lit(True))
    return evidence.select(key).join(hits, F.col(key).cast("string") == F.col("key"), "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def reconcile(stated: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, issue): files of a witness that are missing, added or changed."""
    rows = stated.select(key, F.col(digest).alias("a")).join(actual.select(key, F.col(digest).alias("b")), key, "full")
    issue = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return rows.select(key, issue.alias("issue")).where("issue is not null")


def vocabulary_drift(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, alias, term, category): words of a text that are aliases of a term.

    ``terms`` has term, category, alias (lower case); texts meet it through
    their words, an equi-join."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(text, r"(?U)[^\w-]+", " ")), " "))).alias("alias")).where("alias != ''")
    return words.join(terms, "alias").select(key, "alias", "term", "category")


def candidates(text: Column) -> Column:
    """Bold and code spans of a text, each once."""
    spans = F.concat(F.regexp_extract_all(text, F.lit(r"\*\*([^*]+)\*\*"), 1), F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), 1))
    return F.array_distinct(F.transform(spans, lambda x: F.lower(F.trim(x))))
