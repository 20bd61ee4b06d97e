"""Queries over delegation chains, packaged jobs, ingest and redaction, with
their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import delegation
from loomstone.session import table

NOW, SCOPE = "2025-06-01T00:00:00Z", "project:harbor-ledger"


def _made_caveats() -> Column:
    """Caveats from a token's own dates, scopes and capabilities."""
    return F.array(
        F.struct(F.lit("expires_at").alias("type"), F.coalesce("expires_at", F.lit("2099-01-01T00:00:00Z")).alias("value")),
        F.struct(F.lit("scope_limit").alias("type"), F.coalesce(F.regexp_replace(F.try_element_at("scopes", F.lit(1)), ":.*", ":*"), F.lit("*")).alias("value")),
        F.struct(F.lit("max_delegation_depth").alias("type"), (3 * F.coalesce(F.size("capabilities"), F.lit(9))).cast("string").alias("value")),
    )


def chain_authorized(spark: SparkSession, d: str) -> DataFrame:
    return delegation.authorize_chains(table(spark, d, "entitlement_tokens"), _made_caveats(), SCOPE, NOW)


def chain_faults(spark: SparkSession, d: str) -> DataFrame:
    return delegation.chain_faults(table(spark, d, "entitlement_tokens"))


def token_caps(spark: SparkSession, d: str) -> DataFrame:
    t = delegation.distinct_tokens(table(spark, d, "entitlement_tokens")).select("token_id", "granted_to", "granted_by", "scopes", "capabilities", "created_at", "expires_at", "parent_cap_id")
    return t.select("token_id", delegation.cap_id(t).alias("cap_id"))


def delegated(spark: SparkSession, d: str) -> DataFrame:
    """Children that every token is asked for: a scope below its first one, its
    capabilities and export, half its budget."""
    t = delegation.distinct_tokens(table(spark, d, "entitlement_tokens")).withColumn("caveats", _made_caveats())
    asked = t.select(
        F.col("token_id").alias("request_id"), F.col("token_id").alias("parent"), F.array(F.concat(F.try_element_at("scopes", F.lit(1)), F.lit("/notes"))).alias("scopes"),
        F.array_union("capabilities", F.array(F.lit("export"))).alias("capabilities"), F.lit(None).cast("string").alias("expires_at"), (F.col("budget_usd") / 2).alias("budget_usd"),
        F.array().cast("array<struct<type:string,value:string>>").alias("caveats"),
    )
    rows = delegation.delegate(t, asked)
    return rows.select("request_id", "granted_by", F.element_at("caveats", 1)["value"].alias("depth"), "refusal")


def token_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = delegation.distinct_tokens(table(spark, d, "entitlement_tokens")).select("token_id", "granted_to", "scopes", "budget_usd", "expires_at")
    back = delegation.text_token(delegation.token_text(t), "token_id string, granted_to string, scopes array<string>, budget_usd double, expires_at string")
    return back.select("token_id", "granted_to", F.array_join("scopes", ",").alias("scopes"), "budget_usd", "expires_at")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("prompt"), F.col("p_retailprice").alias("budget_usd"),
        F.array(F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value"))).alias("constraints"),
    )


def job_tasks(spark: SparkSession, d: str) -> DataFrame:
    return delegation.job_atoms(_jobs(spark, d))


def job_packages(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    content = jobs.select("job_id", F.lit(0).alias("pos"), F.col("prompt").alias("text"), F.lit("fact").alias("kind"), F.lit(None).cast("string").alias("entity"), F.lit("name").alias("key"), F.lit(None).cast("string").alias("value"))
    return delegation.package_jobs(jobs, content, "agent-1").select("job_id", "content_shard", F.size("capabilities").alias("capabilities"), F.col("scopes")[0].alias("scope"), "budget_usd")


def job_config(spark: SparkSession, d: str) -> DataFrame:
    return delegation.job_config(delegation.job_atoms(_jobs(spark, d)))


def job_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of orders run as jobs: their price of a budget, mode and status."""
    o = table(spark, d, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("prompt"), F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double")).alias("spent_usd"),
        F.lit(None).cast("double").alias("budget_usd"), F.array(F.struct(F.lit("video").alias("type"), F.col("o_orderpriority").alias("ref")), F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("ref"))).alias("outputs"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("late"))).alias("warnings"),
    )
    return delegation.result_atoms(runs)


def shard_genealogy(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("token_id"), F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % 2 == 0).alias("packed"))
    none = F.lit(None).cast("string")
    events = o.select(
        F.when(F.col("packed"), "job_packaged").otherwise("job_completed").alias("type"), "token_id",
        F.when(F.col("packed"), F.concat(F.lit("c"), "k")).alias("content_shard"), F.when(F.col("packed"), F.concat(F.lit("t"), "k")).otherwise(none).alias("task_shard"), F.when(~F.col("packed"), F.concat(F.lit("r"), "k")).alias("result_shard"),
    )
    return delegation.genealogy(events)


def agent_steps(spark: SparkSession, d: str) -> DataFrame:
    """How often one kind of hook event follows another in a session."""
    h = table(spark, d, "hook_payloads").dropDuplicates(["payload_id"]).where("session_id is not null").withColumn("type", F.coalesce("hook_event_name", F.lit("")))
    return delegation.event_steps(h, "session_id", ["ts", "payload_id"]).groupBy("source", "target").agg(F.count("*").alias("steps"))


QUERIES = {f.__name__: f for f in (chain_authorized, chain_faults, token_caps, delegated, token_roundtrip, job_tasks, job_packages, job_config, job_results, shard_genealogy, agent_steps)}

_T = "t AS (SELECT * FROM entitlement_tokens QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ingested_at) = 1)"
_CHAIN = f"""WITH RECURSIVE {_T}, n AS (SELECT lower(trim(token_id)) AS k, max(nullif(lower(trim(parent_cap_id)), '')) AS p FROM t GROUP BY 1),
r AS (SELECT n.k FROM n WHERE n.p IS NULL OR n.p NOT IN (SELECT k FROM n)),
c AS (SELECT k, [k] AS links FROM r UNION ALL SELECT n.k, list_append(c.links, n.k) FROM c JOIN n ON n.p = c.k),
l AS (SELECT k, unnest(links) AS link, len(links) - unnest(range(1, len(links) + 1)) AS below FROM c)"""
_PARTS = "SELECT p_partkey AS job_id, 0 AS pos, p_name AS text, 'instruction' AS kind, 'production_prompt' AS key FROM part UNION ALL SELECT p_partkey, 1, printf('Budget: $%.2f', CAST(p_retailprice AS DOUBLE)), 'instruction', 'budget_limit' FROM part UNION ALL SELECT p_partkey, 2, 'brand: ' || p_brand, 'convention', 'constraint.brand' FROM part UNION ALL SELECT p_partkey, 3, 'size: ' || p_size, 'convention', 'constraint.size' FROM part"
SQL = {
    "chain_authorized": f"""{_CHAIN}, ok AS (SELECT l.k, bool_and('{NOW}' < coalesce(t.expires_at, '2099-01-01T00:00:00Z') AND '{SCOPE}' GLOB coalesce(regexp_replace(t.scopes[1], ':.*', ':*'), '*') AND l.below <= 3 * coalesce(len(t.capabilities), 9)) AS a
  FROM l JOIN t ON lower(trim(t.token_id)) = l.link GROUP BY 1) SELECT t.token_id, coalesce(ok.a, false) AS authorized FROM t LEFT JOIN ok ON ok.k = lower(trim(t.token_id))""",
    "chain_faults": f"""{_CHAIN}, d AS (SELECT lower(trim(token_id)) AS link FROM t WHERE length(trim(parent_cap_id)) > 0 AND lower(trim(parent_cap_id)) NOT IN (SELECT k FROM n)),
j AS (SELECT c.token_id, coalesce(c.capabilities, []) AS cc, coalesce(p.capabilities, []) AS pc, coalesce(c.scopes, []) AS cs, coalesce(p.scopes, []) AS ps, c.budget_usd AS cb, p.budget_usd AS pb, c.expires_at AS ce, p.expires_at AS pe FROM t c JOIN t p ON lower(trim(c.parent_cap_id)) = lower(p.token_id)),
b AS (SELECT lower(trim(token_id)) AS link FROM j WHERE len(list_filter(cc, lambda x: NOT list_contains(pc, x))) > 0 OR len(list_filter(cs, lambda x: len(list_filter(ps, lambda p: p = x OR (NOT regexp_matches(p, '[?\\[\\]]') AND x GLOB p))) = 0)) > 0 OR NOT coalesce(cb <= pb, false) OR (pe IS NOT NULL AND (ce IS NULL OR ce > pe)))
SELECT token_id, 'endless' AS fault FROM t WHERE lower(trim(token_id)) NOT IN (SELECT k FROM l)
UNION ALL SELECT DISTINCT t.token_id, 'no root' FROM l JOIN d USING (link) JOIN t ON lower(trim(t.token_id)) = l.k
UNION ALL SELECT DISTINCT t.token_id, 'broader' FROM l JOIN b USING (link) JOIN t ON lower(trim(t.token_id)) = l.k""",
    "token_caps": f"""WITH {_T} SELECT token_id, sha256('{{' || array_to_string(list_filter([
  '"capabilities":' || CAST(to_json(capabilities) AS VARCHAR), '"created_at":' || CAST(to_json(created_at) AS VARCHAR), '"expires_at":' || CAST(to_json(expires_at) AS VARCHAR), '"granted_by":' || CAST(to_json(granted_by) AS VARCHAR),
  '"granted_to":' || CAST(to_json(granted_to) AS VARCHAR), '"parent_cap_id":' || CAST(to_json(parent_cap_id) AS VARCHAR), '"scopes":' || CAST(to_json(scopes) AS VARCHAR), '"token_id":' || CAST(to_json(token_id) AS VARCHAR)],
  lambda x: x IS NOT NULL AND NOT x LIKE '%":null'), ',') || '}}') AS cap_id FROM t""",
    "delegated": f"""WITH {_T}, x AS (SELECT *, 3 * coalesce(len(capabilities), 9) AS p_depth FROM t) SELECT token_id AS request_id, granted_to AS granted_by, CAST(p_depth - 1 AS VARCHAR) AS depth,
  CASE WHEN p_depth <= 0 THEN 'no further delegation' WHEN capabilities IS NOT NULL AND NOT list_contains(capabilities, 'export') THEN 'capabilities'
  WHEN scopes[1] || '/notes' IS NULL OR len(list_filter(coalesce(scopes, []), lambda p: p = scopes[1] || '/notes' OR (NOT regexp_matches(p, '[?\\[\\]]') AND (scopes[1] || '/notes') GLOB p))) = 0 THEN 'scopes'
  WHEN NOT coalesce(budget_usd / 2 <= budget_usd, coalesce(budget_usd / 2, 0.0) <= budget_usd, false) THEN 'budget' END AS refusal FROM x""",
    "token_roundtrip": f"WITH {_T} SELECT token_id, granted_to, array_to_string(scopes, ',') AS scopes, budget_usd, expires_at FROM t",
    "job_tasks": _PARTS,
    "job_config": f"SELECT job_id, key, text FROM ({_PARTS})",
    "job_packages": """SELECT p_partkey AS job_id, sha256('{"atoms":[{"key":"name","kind":"fact","text":' || CAST(to_json(p_name) AS VARCHAR) || '}],"origin":"agent-1","scope":"job:content"}') AS content_shard, 7 AS capabilities, 'job:*' AS scope, p_retailprice AS budget_usd FROM part""",
    "job_results": """WITH r AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prompt, o_orderkey % 2 = 0 AS paid, floor(o_totalprice) AS spent, o_orderpriority AS ref, o_orderstatus FROM orders),
a AS (SELECT job_id, 0 AS o, 'Completed job: ' || coalesce(prompt, 'unknown') AS text, 'fact' AS kind, NULL AS entity, 'job_summary' AS key FROM r
UNION ALL SELECT job_id, 1, printf('Spent $%.2f of $0.00 budget', CAST(spent AS DOUBLE)), 'fact', 'job_run', 'cost_summary' FROM r WHERE paid
UNION ALL SELECT job_id, 2, 'video: ' || ref, 'fact', 'job_run', 'output.video' FROM r UNION ALL SELECT job_id, 3, 'output: unknown', 'fact', 'job_run', 'output.unknown' FROM r
UNION ALL SELECT job_id, 4, 'late', 'context', NULL, 'warning' FROM r WHERE o_orderstatus = 'F')
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS INTEGER) AS pos, text, kind, entity, key FROM a""",
    "shard_genealogy": """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS t, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 2 = 0 AS packed FROM orders)
SELECT 'c' || k AS source, t AS target, 'content' AS label FROM p WHERE packed UNION ALL SELECT 't' || k, t, 'task' FROM p WHERE packed
UNION ALL SELECT t, 'r' || k, 'result' FROM p WHERE NOT packed AND t IN (SELECT t FROM p WHERE packed)""",
    "agent_steps": """WITH h AS (SELECT * FROM hook_payloads QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY received_at) = 1), s AS (
SELECT coalesce(hook_event_name, '') AS source, lead(coalesce(hook_event_name, '')) OVER (PARTITION BY session_id ORDER BY ts, payload_id) AS target, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, payload_id DESC) AS k FROM h WHERE session_id IS NOT NULL)
SELECT source, target, count(*) AS steps FROM s WHERE k > 1 GROUP BY 1, 2""",
}
