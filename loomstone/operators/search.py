"""Retrieval: keyword scores, vector neighbours, facts as of a time."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.instants import blank_to_null, parse_instant


#: Words of queries that are looked for in one pass over the texts.
BLOCK_WORDS = 200_000
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def _best_texts(shared, top: int):
    """Of each partition the ``top`` texts of each query, by share of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, holders = shared.value
        best: dict[int, list] = {}
        for pdf in batches:
            for key, text in zip(pdf["key"].tolist(), pdf["text"]):
                hits: dict[int, int] = {}
                for word in set(_BLANK.split(text.lower())):
                    for q in holders.get(word, ()):
                        hits[q] = hits.get(q, 0) + 1
                for q, n in hits.items():
                    # The least of the kept ones is first: low score, high key.
                    item = (n / sizes[q], -key)
                    kept = best.setdefault(q, [])
                    if len(kept) < top:
                        heapq.heappush(kept, item)
                    elif item > kept[0]:
                        heapq.heapreplace(kept, item)
        rows = [(q, -k, score) for q, kept in best.items() for score, k in kept]
        yield pd.DataFrame(rows, columns=["query_id", "key", "score"]).astype({"query_id": "int64", "key": "int64", "score": float})

    return run


def keyword_search(corpus: DataFrame, key: str, text: str, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, key, score, rank): share of a query's words that a text holds.

    Queries are the stated set: their words are read in blocks of bounded size
    and looked up while each text streams by; only the best texts of each
    partition are shuffled.  Texts come once for each ``key``."""
    spark = corpus.sparkSession
    texts = corpus.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = spark.createDataFrame([], "query_id long, key long, score double")
    sizes: dict[int, int] = {}
    holders: dict[str, list[int]] = {}
    count = 0

    def scan() -> DataFrame:
        shared = spark.sparkContext.broadcast((dict(sizes), dict(holders)))
        return texts.mapInPandas(_best_texts(shared, top), "query_id long, key long, score double")

    for row in queries.where("query is not null").select(F.col("query_id").cast("long").alias("q"), "query").toLocalIterator():
        words = {w for w in _BLANK.split(row.query.lower()) if w}
        if sizes and count + len(words) > BLOCK_WORDS:
            out = out.unionByName(scan())
            sizes, holders, count = {}, {}, 0
        if words:
            sizes[row.q] = len(words)
            count += len(words)
            for w in words:
                holders.setdefault(w, []).append(row.q)
    if sizes:
        out = out.unionByName(scan())
    hits = out.groupBy("query_id", F.col("key").alias(key)).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): nearest vectors by cosine.

    Queries are the stated set: taken in blocks of bounded size, each block
    against all vectors in one pass with a partial top-k per partition."""
    import numpy as np

    spark = vectors.sparkSession
    out = None
    block: list = []

    def scan(rows: list):
        ids = np.array([r.query_id for r in rows])
        q = np.array([r.embedding for r in rows], dtype=float)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

        def run(batches):
            ids, q = shared.value
            best = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
            for pdf in batches:
                v = np.array(pdf["embedding"].tolist(), dtype=float)
                scores = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T
                k = min(top + 1, scores.shape[1])
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                new = pd.DataFrame({"query_id": np.repeat(ids, k), "vec_id": pdf["vec_id"].to_numpy()[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})
                best = pd.concat([best, new], ignore_index=True).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(top + 1)
            yield best

        return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")

    for row in queries.select("query_id", "embedding").toLocalIterator():
        block.append(row)
        if len(block) == 2_000:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block = []
    if block or out is None:
        part = scan(block) if block else spark.createDataFrame([], "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.where("query_id != vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def duplicates_of(top1: DataFrame, least: float = 0.9) -> DataFrame:
    return top1.where((F.col("rank") == 1) & (F.col("score") >= least)).select("query_id", "vec_id", "score")


def triples_as_of(triples: DataFrame, at: str) -> DataFrame:
    """Facts valid at an instant: begun by then, and not yet ended."""
    t = parse_instant(F.lit(at))
    begun, ended = parse_instant(blank_to_null(F.col("valid_from"))), parse_instant(blank_to_null(F.col("valid_to")))
    return triples.where((begun.isNull() | (begun <= t)) & (ended.isNull() | (ended > t)))
