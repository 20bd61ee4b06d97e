"""Canonical JSON and digests: the identity of records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; needed where floats or control
    characters occur, which the JVM writes differently."""
    return raw.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


@F.pandas_udf(T.StringType())
def canonical_digest(raw: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        text = json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    return raw.map(one)


def pairs_digest(fields: Sequence[tuple[str, Column]]) -> Column:
    """Digest of named values: nulls dropped, trimmed, lower case, by name."""
    from loomstone.functions.normalize import pytrim

    pairs = [F.when(v.isNotNull(), F.array(F.lit(k), F.lower(pytrim(v.cast("string"))))) for k, v in sorted(fields, key=lambda x: x[0])]
    return sha256(F.to_json(F.array_compact(F.array(*pairs))))


def struct_digest(**fields: Column) -> Column:
    """Digest of a flat record of strings; nulls are kept as null."""
    ordered = F.struct(*[v.cast("string").alias(k) for k, v in sorted(fields.items())])
    return sha256(F.to_json(ordered, {"ignoreNullFields": "false"}))


def short_id(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(sha256(seed), 1, 12))
