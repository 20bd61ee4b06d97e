"""Queries of the general problems 4 (history) and 6 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import hierarchy, history
from loomstone.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.attribute_history(table(spark, d, "triples"))


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every belief ever held, closed ones included; instants as the digits of
    their microseconds."""
    ledger = history.bitemporal_ledger(table(spark, d, "triples"))
    return ledger.select(
        "subject", "predicate", F.col("value").alias("object"), *[F.col(c).cast("string").alias(c) for c in ("valid_from", "valid_to", "next_from", "recorded_from", "recorded_to")]
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    shards = hierarchy.parent_links(table(spark, d, "shards"), "shard_id", "parent_shard_id", "shard")
    tokens = hierarchy.parent_links(table(spark, d, "entitlement_tokens"), "token_id", "parent_cap_id", "token")
    return shards.unionByName(tokens)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(_links(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy.expand_hierarchy(_links(spark, d))
    return rows.withColumn("path", F.array_join("path", "/")).withColumn("descendants", F.coalesce("descendants", F.lit(-1)))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of each node, -1 on and below cycles."""
    rows = hierarchy.descendant_counts(_links(spark, d))
    return rows.withColumn("descendants", F.coalesce("descendants", F.lit(-1)))


def p6_below(spark: SparkSession, d: str) -> DataFrame:
    """Which nodes are below each node, on and below cycles too."""
    return hierarchy.descendant_pairs(_links(spark, d))


QUERIES = {"p6_below": p6_below, "p6_descendants": p6_descendants, "p4_found": p4_found, "p4_ledger": p4_ledger, "p6_found": p6_found, "p6_paths": p6_paths}

_REPORTS = """
WITH r AS (
  SELECT subject, predicate, object, triple_id, recorded_at,
         COALESCE(CAST(valid_from AS TIMESTAMPTZ), recorded_at) AS s,
         CAST(valid_to AS TIMESTAMPTZ) AS e
  FROM (SELECT * REPLACE (
          CASE WHEN length(trim(valid_from)) = 10 THEN trim(valid_from) || 'T00:00:00Z' ELSE nullif(trim(valid_from), '') END AS valid_from,
          CASE WHEN length(trim(valid_to)) = 10 THEN trim(valid_to) || 'T00:00:00Z' ELSE nullif(trim(valid_to), '') END AS valid_to)
        FROM triples)
), k AS (
  SELECT * FROM r WHERE s IS NOT NULL AND (e IS NULL OR e > s)
  QUALIFY row_number() OVER (PARTITION BY subject, predicate, s ORDER BY recorded_at DESC NULLS LAST, triple_id DESC) = 1
)"""

_BELOW = """
WITH RECURSIVE n AS (
  SELECT hierarchy, lower(trim(id)) AS k, min(id) AS node_id, max(nullif(lower(trim(parent)), '')) AS p
  FROM (SELECT 'shard' AS hierarchy, shard_id AS id, parent_shard_id AS parent FROM shards
        UNION ALL SELECT 'token', token_id, parent_cap_id FROM entitlement_tokens)
  GROUP BY ALL
), t AS (
  SELECT n.hierarchy, n.k, [n.k] AS ids FROM n LEFT JOIN n q ON n.hierarchy = q.hierarchy AND n.p = q.k WHERE q.k IS NULL
  UNION ALL
  SELECT n.hierarchy, n.k, list_append(t.ids, n.k) FROM t JOIN n ON n.hierarchy = t.hierarchy AND n.p = t.k
)
SELECT n.hierarchy, n.node_id, COALESCE(c.m - 1, -1) AS descendants
FROM n LEFT JOIN (SELECT hierarchy, a, count(*) AS m FROM (SELECT hierarchy, unnest(ids) AS a FROM t) GROUP BY ALL) c ON c.hierarchy = n.hierarchy AND c.a = n.k"""

_PAIRS = """
WITH RECURSIVE n AS (
  SELECT hierarchy, lower(trim(id)) AS k, min(id) AS node_id, max(nullif(lower(trim(parent)), '')) AS p
  FROM (SELECT 'shard' AS hierarchy, shard_id AS id, parent_shard_id AS parent FROM shards
        UNION ALL SELECT 'token', token_id, parent_cap_id FROM entitlement_tokens)
  GROUP BY ALL
), e AS (SELECT n.hierarchy, n.k, n.p FROM n JOIN n q ON n.hierarchy = q.hierarchy AND n.p = q.k), t AS (
  SELECT hierarchy, k, p AS a FROM e
  UNION
  SELECT t.hierarchy, t.k, e.p FROM t JOIN e ON e.hierarchy = t.hierarchy AND e.k = t.a
)
SELECT t.hierarchy, u.node_id, n.node_id AS descendant_id
FROM t JOIN n ON n.hierarchy = t.hierarchy AND n.k = t.k JOIN n u ON u.hierarchy = t.hierarchy AND u.k = t.a
WHERE t.k <> t.a"""

SQL = {
    "p6_below": _PAIRS,
    "p6_descendants": _BELOW,
    "p4_found": _REPORTS
    + """, m AS (
  SELECT *, CASE WHEN lag(s) OVER w IS NULL OR lag(object) OVER w IS DISTINCT FROM object OR lag(e) OVER w < s THEN 1 ELSE 0 END AS n,
         lead(s) OVER w AS nx
  FROM k WINDOW w AS (PARTITION BY subject, predicate ORDER BY s)
), g AS (SELECT *, sum(n) OVER (PARTITION BY subject, predicate ORDER BY s ROWS UNBOUNDED PRECEDING) AS v FROM m)
SELECT subject, predicate, strftime(timezone('UTC', min(s)), '%Y-%m-%dT%H:%M:%SZ') AS valid_from,
       COALESCE(strftime(timezone('UTC', least(max(e) FILTER (WHERE s = ls), max(nx) FILTER (WHERE s = ls))), '%Y-%m-%dT%H:%M:%SZ'), '') AS valid_to,
       any_value(object) AS object
FROM (SELECT *, max(s) OVER (PARTITION BY subject, predicate, v) AS ls FROM g)
GROUP BY subject, predicate, v""",
    "p4_ledger": """
WITH r AS (
  SELECT subject, predicate, object, triple_id AS i, COALESCE(CAST(epoch_us(recorded_at) AS BIGINT), -4611686018427387904) AS a,
         epoch_us(COALESCE(CAST(valid_from AS TIMESTAMPTZ), recorded_at)) AS s, epoch_us(CAST(valid_to AS TIMESTAMPTZ)) AS e
  FROM (SELECT * REPLACE (
          CASE WHEN length(trim(valid_from)) = 10 THEN trim(valid_from) || 'T00:00:00Z' ELSE nullif(trim(valid_from), '') END AS valid_from,
          CASE WHEN length(trim(valid_to)) = 10 THEN trim(valid_to) || 'T00:00:00Z' ELSE nullif(trim(valid_to), '') END AS valid_to)
        FROM triples)
), k AS (SELECT * FROM r WHERE s IS NOT NULL AND (e IS NULL OR e > s)),
o AS (SELECT subject, predicate, s, min(a) AS a FROM k GROUP BY ALL),
m AS (  -- moments at which the belief about a start changed: it was reported, or a nearer next start became known
  SELECT DISTINCT subject, predicate, s, a FROM k
  UNION
  SELECT x.subject, x.predicate, x.s, y.a FROM o x JOIN o y ON x.subject IS NOT DISTINCT FROM y.subject AND x.predicate IS NOT DISTINCT FROM y.predicate AND y.s > x.s AND y.a > x.a
  WHERE NOT EXISTS (SELECT 1 FROM o z WHERE z.subject IS NOT DISTINCT FROM x.subject AND z.predicate IS NOT DISTINCT FROM x.predicate AND z.s > x.s AND z.s < y.s AND z.a <= y.a)
), w AS (
  SELECT m.*, (SELECT arg_max(struct_pack(v := object, e := e), (k.a, k.i)) FROM k WHERE k.subject IS NOT DISTINCT FROM m.subject AND k.predicate IS NOT DISTINCT FROM m.predicate AND k.s = m.s AND k.a <= m.a) AS said,
         (SELECT min(o.s) FROM o WHERE o.subject IS NOT DISTINCT FROM m.subject AND o.predicate IS NOT DISTINCT FROM m.predicate AND o.s > m.s AND o.a <= m.a) AS nx
  FROM m
)
SELECT subject, predicate, said.v AS object, CAST(s AS VARCHAR) AS valid_from, CAST(said.e AS VARCHAR) AS valid_to, CAST(nx AS VARCHAR) AS next_from, CAST(a AS VARCHAR) AS recorded_from,
       CAST(lead(a) OVER (PARTITION BY subject, predicate, s ORDER BY a) AS VARCHAR) AS recorded_to
FROM w""",
    "p6_found": """
WITH RECURSIVE n AS (
  SELECT hierarchy, lower(trim(id)) AS k, min(id) AS node_id, max(nullif(lower(trim(parent)), '')) AS p
  FROM (SELECT 'shard' AS hierarchy, shard_id AS id, parent_shard_id AS parent FROM shards
        UNION ALL SELECT 'token', token_id, parent_cap_id FROM entitlement_tokens)
  GROUP BY ALL
), t AS (
  SELECT n.hierarchy, n.k, n.node_id AS root_id, CAST(0 AS BIGINT) AS depth
  FROM n LEFT JOIN n q ON n.hierarchy = q.hierarchy AND n.p = q.k WHERE q.k IS NULL
  UNION ALL
  SELECT n.hierarchy, n.k, t.root_id, t.depth + 1 FROM t JOIN n ON n.hierarchy = t.hierarchy AND n.p = t.k
)
SELECT n.hierarchy, n.node_id, COALESCE(t.root_id, '') AS root_id, COALESCE(t.depth, -1) AS depth
FROM n LEFT JOIN t ON n.hierarchy = t.hierarchy AND n.k = t.k""",
    "p6_paths": """
WITH RECURSIVE n AS (
  SELECT hierarchy, lower(trim(id)) AS k, min(id) AS node_id, max(nullif(lower(trim(parent)), '')) AS p
  FROM (SELECT 'shard' AS hierarchy, shard_id AS id, parent_shard_id AS parent FROM shards
        UNION ALL SELECT 'token', token_id, parent_cap_id FROM entitlement_tokens)
  GROUP BY ALL
), t AS (
  SELECT n.hierarchy, n.k, n.node_id AS root_id, CAST(0 AS BIGINT) AS depth, [n.node_id] AS ids
  FROM n LEFT JOIN n q ON n.hierarchy = q.hierarchy AND n.p = q.k WHERE q.k IS NULL
  UNION ALL
  SELECT n.hierarchy, n.k, t.root_id, t.depth + 1, list_append(t.ids, n.node_id) FROM t JOIN n ON n.hierarchy = t.hierarchy AND n.p = t.k
), c AS (SELECT hierarchy, a, count(*) - 1 AS descendants FROM (SELECT hierarchy, unnest(ids) AS a FROM t) GROUP BY ALL)
SELECT n.hierarchy, n.node_id, COALESCE(t.root_id, '') AS root_id, COALESCE(t.depth, -1) AS depth,
       COALESCE(array_to_string(t.ids, '/'), '') AS path, COALESCE(c.descendants, -1) AS descendants
FROM n LEFT JOIN t ON n.hierarchy = t.hierarchy AND n.k = t.k LEFT JOIN c ON c.hierarchy = n.hierarchy AND c.a = n.node_id AND t.k IS NOT NULL""",
}
