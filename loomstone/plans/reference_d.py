"""Queries over jobs, manifests, checkpoints, views, findings and witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators import jobs, trace
from loomstone.session import table

NOW = "2025-06-01T00:00:00Z"


def scope_manifests(spark: SparkSession, d: str) -> DataFrame:
    return jobs.manifests(table(spark, d, "shards"), "publisher-1")


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shards").select(jobs.object_key("store", F.col("shard_id")).alias("key")).distinct()


def job_status(spark: SparkSession, d: str) -> DataFrame:
    """A job for every token that names a capability shard pair of its scope."""
    s = table(spark, d, "shards").where("cap_id is not null").groupBy("cap_id").agg(F.min("shard_id").alias("a"), F.max("shard_id").alias("b"))
    text = F.concat(F.lit("<job>\n<entitlement> "), "cap_id", F.lit(" </entitlement><content-shard>"), "a", F.lit("</content-shard>"), F.when(F.col("a") != F.col("b"), F.concat(F.lit("<task-shard>"), "b", F.lit("</task-shard>"))).otherwise(F.lit("")))
    made = s.select(F.col("cap_id").alias("job_id"), text.alias("text"))
    return jobs.hydrate_jobs(made, table(spark, d, "entitlement_tokens"), table(spark, d, "shards"), NOW, "shard:read")


def resume_stages(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a pipeline: an F order is its result."""
    o = table(spark, d, "orders")
    refs = o.select(F.col("o_custkey").alias("pipeline"), F.when(F.col("o_orderstatus") == "F", "result").otherwise("checkpoint").alias("kind"), F.concat("o_orderpriority", F.lit("_complete")).alias("stage"), F.col("o_orderkey").alias("at"))
    return jobs.resume_stages(refs)


def view_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = p.select(F.col("p_partkey").alias("view_id"), F.col("p_size").alias("zoom"), (F.col("p_partkey") % 180 - 90).cast("double").alias("lat"), (F.col("p_partkey") % 360 - 180).cast("double").alias("lng"), F.col("p_name").alias("annotation"))
    return jobs.atoms_view(jobs.view_atoms(v))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The leading documents of each scope that fit 4,000 characters."""
    s = table(spark, d, "documents").where("text is not null and scope is not null")
    return jobs.within_budget(s, "scope", "doc_id", "text").select("scope", "doc_id", "used")


def finding_issues(spark: SparkSession, d: str) -> DataFrame:
    """Parts as findings against a registry of their types."""
    p = table(spark, d, "part")
    reg = p.groupBy(F.col("p_type").alias("finding_name")).agg(F.min("p_brand").alias("category"), F.min(F.col("p_size") % 3).cast("string").alias("default_risk"))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper("p_type")).when(k == 1, F.concat("p_type", F.lit("x"))).when(k == 2, F.lit(" ")).otherwise(F.lit("qqqq zzzz"))
    f = p.select(F.col("p_partkey").alias("finding_id"), name.alias("name"), F.col("p_brand").alias("category"), (F.col("p_size") % 3).cast("string").alias("risk"))
    return jobs.validate_findings(f, reg)


def witness_check(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses of each user's chain, checked after every third lost an event."""
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("event_id")))
    sealed = trace.seal(e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), body.alias("body")))
    reports = e.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.to_json(F.struct(F.count("*").alias("n"))).alias("report"))
    last = e.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("event_id").alias("seq")).where("cast(run_id as long) % 3 = 0")
    cut = sealed.join(last, ["run_id", "seq"], "left_anti")
    return jobs.verify_witness(jobs.witness(sealed, reports), cut, reports)


def tool_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    tool = F.concat(F.lit("mcp_region_"), "n_regionkey", F.lit("_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")))
    return n.select("n_nationkey", jobs.split_tool(tool, ["region", "region_1", "region_2"]).alias("t")).select("n_nationkey", "t.server", "t.tool", "t.exact")


def session_keys(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hook_payloads").dropDuplicates(["payload_id"])
    return h.select("payload_id", jobs.session_key(F.when(F.col("payload_id") % 2 == 0, F.col("session_id")), F.col("cwd"), F.col("ts")).alias("key"))


def response_fields(spark: SparkSession, d: str) -> DataFrame:
    """Tool responses cut off at two thirds and repaired, and redacted ones."""
    h = table(spark, d, "hook_payloads").dropDuplicates(["payload_id"]).where("tool_response is not null")
    repair, redact = F.pandas_udf(jobs.repair_json, T.StringType()), F.pandas_udf(jobs.redact_json, T.StringType())
    cut = F.expr("substring(tool_response, 1, length(tool_response) * 2 div 3)")
    return h.select("payload_id", repair(cut).alias("repaired"), redact("tool_response").alias("redacted"))


QUERIES = {f.__name__: f for f in (scope_manifests, object_keys, job_status, resume_stages, view_roundtrip, context_budget, finding_issues, witness_check, tool_ids, session_keys, response_fields)}

_T = "t AS (SELECT * FROM entitlement_tokens QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ingested_at) = 1)"
SQL = {
    "scope_manifests": "WITH i AS (SELECT DISTINCT scope, shard_id FROM shards WHERE scope IS NOT NULL AND shard_id IS NOT NULL), l AS (SELECT scope, substr(shard_id, 1, 2) AS p, count(*) AS n, sha256(string_agg(shard_id, ',' ORDER BY shard_id)) AS h FROM i GROUP BY 1, 2) SELECT scope, CAST(sum(n) AS BIGINT) AS shards, sha256(scope || '|publisher-1|' || string_agg(p || ':' || h, ',' ORDER BY p)) AS manifest_id FROM l GROUP BY 1",
    "object_keys": "SELECT DISTINCT 'store/shards/' || substr(shard_id, 1, 2) || '/' || substr(shard_id, 3) || '.json' AS key FROM shards",
    "job_status": f"WITH {_T}, s AS (SELECT cap_id, min(shard_id) AS a, max(shard_id) AS b FROM shards WHERE cap_id IS NOT NULL GROUP BY 1), z AS (SELECT shard_id, min(scope) AS scope FROM shards GROUP BY 1) SELECT s.cap_id AS job_id, CASE WHEN a = b THEN 'malformed' WHEN t.token_id IS NULL THEN 'no token' WHEN TIMESTAMPTZ '{NOW}' >= CAST(t.expires_at AS TIMESTAMPTZ) THEN 'expired' WHEN NOT coalesce(list_contains(t.capabilities, 'shard:read'), false) THEN 'not permitted' ELSE 'ready' END AS status, CASE WHEN a <> b THEN x.scope END AS content_scope, CASE WHEN a <> b THEN y.scope END AS task_scope FROM s LEFT JOIN t ON a <> b AND t.token_id = trim(s.cap_id) LEFT JOIN z x ON x.shard_id = a LEFT JOIN z y ON y.shard_id = b",
    "resume_stages": "SELECT o_custkey AS pipeline, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'complete' ELSE 'in_progress' END AS status, CASE WHEN NOT bool_or(o_orderstatus = 'F') THEN arg_max(o_orderpriority, o_orderkey) END AS stage FROM orders GROUP BY 1",
    "view_roundtrip": "SELECT p_partkey AS view_id, p_size AS zoom, CAST(p_partkey % 180 - 90 AS DOUBLE) AS lat, CAST(p_partkey % 360 - 180 AS DOUBLE) AS lng, p_name AS annotation FROM part",
    "context_budget": "SELECT scope, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT scope, doc_id, sum(length(text)) OVER (PARTITION BY scope ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL AND scope IS NOT NULL) WHERE used <= 4000",
    "witness_check": "WITH u AS (SELECT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(*) > 1), o AS (SELECT CAST(user_id AS VARCHAR) AS run_id FROM events WHERE user_id % 3 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT run_id, unnest(['events', 'head', 'witness_sha']) AS issue FROM u UNION ALL SELECT run_id, unnest(['events', 'head', 'report_sha', 'witness_sha']) FROM o",
    "tool_ids": "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 2) THEN 'region_' || n_regionkey ELSE 'region' END AS server, CASE WHEN n_regionkey IN (1, 2) THEN '' ELSE n_regionkey || '_' END || lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS tool, true AS exact FROM nation",
    "session_keys": "SELECT payload_id, CASE WHEN payload_id % 2 = 0 AND length(trim(session_id)) > 0 THEN session_id ELSE 'session-' || substr(sha256(coalesce(cwd, '')), 1, 12) || '-' || strftime(timezone('UTC', ts), '%Y%m%d') END AS key FROM (SELECT * FROM hook_payloads QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY received_at) = 1)",
}
