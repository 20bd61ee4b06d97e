"""Token counts by a public tokenizer; its file is a parameter, never a copy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File of ranks: a name among the installed public ones, or a path.
TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(name: str):
    import base64
    import os

    import tiktoken

    import public_tokenizers as public

    path = name if os.path.sep in name else public.path(name)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keys`` and ``tokens``; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for pdf in batches:
            text = pdf.pop("_text")
            yield pdf.assign(tokens=[len(encoding.encode_ordinary(x)) if x else 0 for x in text])

    rows = df.select(*keys, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInPandas(run, schema + ", tokens long")
