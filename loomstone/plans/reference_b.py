"""Queries over resolution, traces and capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import capability, resolution, trace
from loomstone.session import table

NOW = "2025-10-01T00:00:00Z"
PERSON = resolution.Schema("person", ("last_name", "first_name", "dob"), {"last_name": 0.85, "first_name": 0.80}, ("facility",), ("gender",))
EXACT = resolution.Schema("person_exact", ("last_name", "first_name", "dob"), {}, ("facility",))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_entities").where("entity_type = 'person'").withColumn("seq", F.col("entity_id"))


def _mutated(spark: SparkSession, d: str) -> DataFrame:
    """The registry's own people, typed differently by a fixed rule."""
    p = _registry(spark, d)
    k = F.col("entity_id") % 4
    last = F.when(k == 0, F.upper("last_name")).when(k == 1, F.concat(F.lit("  "), "last_name", F.lit(" "))).when(
        k == 2, F.concat(F.substring("last_name", 1, 3), F.lit("x"), F.expr("substring(last_name, 4)"))
    ).otherwise(F.concat(F.lit("Zz"), F.reverse("last_name")))
    return p.select(F.col("entity_id").alias("cid"), last.alias("last_name"), "first_name", "dob", "facility", "gender")


def resolve_t1(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_exact(_mutated(spark, d), _registry(spark, d), PERSON)


def resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    r = resolution.resolve(_mutated(spark, d), _registry(spark, d), PERSON)
    return r.select("cid", "seq", "tier", "confidence")


def resolve_report(spark: SparkSession, d: str) -> DataFrame:
    return resolution.report(resolution.resolve(_mutated(spark, d), _registry(spark, d), PERSON))


def resolve_context(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_context(_mutated(spark, d), _registry(spark, d), EXACT)


_FOLD = ["first_author_last", "year", "venue"]


def _works(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication_sightings").dropDuplicates(["sighting_id"]).withColumn("work", F.lower("title"))


def fold_fill(spark: SparkSession, d: str) -> DataFrame:
    return resolution.fold_fields(_works(spark, d), "work", ["seen_at", "sighting_id"], _FOLD)


def fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return resolution.fold_fields(_works(spark, d), "work", ["seen_at", "sighting_id"], _FOLD, "latest")


def fold_conflicts(spark: SparkSession, d: str) -> DataFrame:
    w = _works(spark, d)
    one = resolution.fold_fields(w, "work", ["seen_at", "sighting_id"], _FOLD).drop("conflicts", "sightings")
    return resolution.field_conflicts(one, w, "work", _FOLD).distinct()


def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication_sightings").groupBy("source_name").agg(F.count("*").alias("deliveries"), F.countDistinct("sighting_id").alias("sightings"), F.countDistinct("title").alias("titles"))


def merge_remap(spark: SparkSession, d: str) -> DataFrame:
    """Every entity that shares a full name with an earlier one of its scope is
    merged into the one before; its variants' scope rows move along."""
    from pyspark.sql import Window

    p = _registry(spark, d)
    w = Window.partitionBy("source_scope", "last_name", "first_name").orderBy("entity_id")
    merges = p.select(F.col("entity_id").alias("discard"), F.lag("entity_id").over(w).alias("keep")).where("keep is not null")
    return resolution.merge_entities(p, merges, "entity_id")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("event_id"), "value", "props"))
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), body.alias("body"))


def trace_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains of each user's events; every run's 20th event is tampered with."""
    from pyspark.sql import Window

    sealed = trace.seal(_events(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))
    bad = sealed.withColumn("raw", F.when(F.col("k") == 20, F.regexp_replace("raw", '"value":', '"value":1')).otherwise(F.col("raw")))
    return trace.verify_chains(bad.select("run_id", "seq", "raw"))


def trace_heads(spark: SparkSession, d: str) -> DataFrame:
    return trace.chain_heads(trace.seal(_events(spark, d)))


def _caps(spark: SparkSession, d: str) -> DataFrame:
    """Events under region, nation and customer capabilities."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cap = F.concat(F.lit("c"), F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("seq"), F.array(F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey")), cap).alias("cap_chain"), cap.alias("cap_id"), F.col("o_orderpriority").alias("role"))


def events_by_role(spark: SparkSession, d: str) -> DataFrame:
    return _caps(spark, d).groupBy("role").agg(F.count("*").alias("events"))


def events_under_chain(spark: SparkSession, d: str) -> DataFrame:
    return trace.under_chain(_caps(spark, d), "r2").select("seq", "cap_id")


def delegation_tree(spark: SparkSession, d: str) -> DataFrame:
    return trace.delegation_edges(_caps(spark, d))


def hook_events(spark: SparkSession, d: str) -> DataFrame:
    return trace.hook_events(table(spark, d, "hook_payloads")).drop("ts")


def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    return trace.pair_calls(table(spark, d, "hook_payloads"))


def scope_match(spark: SparkSession, d: str) -> DataFrame:
    """Tokens whose scopes open ``project:harbor-ledger/notes``."""
    t = table(spark, d, "entitlement_tokens").dropDuplicates(["token_id"])
    return t.select("token_id", capability.scope_matches(F.lit("project:harbor-ledger/notes"), F.col("scopes")).alias("opens"), capability.has_capability(F.col("capabilities"), "export").alias("exports"), capability.is_expired(F.col("expires_at"), F.lit(NOW)).alias("expired"))


def caveat_check(spark: SparkSession, d: str) -> DataFrame:
    """Caveats built from a token's own dates, depth and scopes."""
    t = table(spark, d, "entitlement_tokens").dropDuplicates(["token_id"])
    made = F.array(
        F.struct(F.lit("expires_at").alias("type"), F.coalesce("expires_at", F.lit("2099-01-01T00:00:00Z")).alias("value")),
        F.struct(F.lit("scope_limit").alias("type"), F.coalesce(F.try_element_at("scopes", F.lit(1)), F.lit("*")).alias("value")),
        F.struct(F.lit("max_delegation_depth").alias("type"), F.size("capabilities").cast("string").alias("value")),
    )
    return t.select("token_id", capability.caveats_hold(made, F.lit("project:harbor-ledger"), F.lit(1), F.lit(NOW)).alias("holds"))


def attenuation(spark: SparkSession, d: str) -> DataFrame:
    return capability.attenuation_issues(table(spark, d, "entitlement_tokens"))


def budget_ledger(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("amount", F.col("o_totalprice"))
    budgets = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(500_000.0).alias("budget"))
    return capability.budget_ledger(o, budgets, "o_custkey", "o_orderkey", "amount").select("o_custkey", "o_orderkey", "accepted", F.round("spent", 2).alias("spent"))


QUERIES = {f.__name__: f for f in (resolve_t1, resolve_tiers, resolve_report, resolve_context, fold_fill, fold_latest, fold_conflicts, registry_stats, merge_remap, trace_verify, trace_heads, events_by_role, events_under_chain, delegation_tree, hook_events, call_pairs, scope_match, caveat_check, attenuation, budget_ledger)}

_P = "p AS (SELECT * FROM person_entities WHERE entity_type = 'person')"
_M = "m AS (SELECT entity_id AS cid, CASE entity_id % 4 WHEN 0 THEN upper(last_name) WHEN 1 THEN '  ' || last_name || ' ' WHEN 2 THEN substr(last_name, 1, 3) || 'x' || substr(last_name, 4) ELSE 'Zz' || reverse(last_name) END AS last_name, first_name, dob, facility FROM p)"
_EQ = " AND ".join(f"lower(trim(m.{f})) IS NOT DISTINCT FROM lower(trim(p.{f}))" for f in ("last_name", "first_name", "dob"))
_ANY = " OR ".join(f"(trim(m.{f}) <> '' AND lower(trim(m.{f})) = lower(trim(p.{f})))" for f in ("last_name", "first_name", "dob"))
_WORKS = "w AS (SELECT *, lower(title) AS work FROM publication_sightings QUALIFY row_number() OVER (PARTITION BY sighting_id ORDER BY seen_at) = 1)"
_NE = lambda f: f"CASE WHEN trim({f}) <> '' THEN {f} END"
_FOLDSQL = lambda agg: f"WITH {_WORKS} SELECT work, " + ", ".join(f"{agg}({_NE(f)}, {{'a': seen_at, 'b': sighting_id}}) FILTER (WHERE {_NE(f)} IS NOT NULL) AS {f}" for f in _FOLD) + ", concat_ws(',', " + ", ".join(f"CASE WHEN count(DISTINCT lower(regexp_replace(trim({_NE(f)}), '\\s+', ' ', 'g'))) > 1 THEN '{f}' END" for f in _FOLD) + ") AS conflicts, count(*) AS sightings FROM w GROUP BY work"
_CAPS = "e AS (SELECT o_orderkey AS seq, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey] AS cap_chain, 'c' || c_custkey AS cap_id, o_orderpriority AS role FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_T = "t AS (SELECT * FROM entitlement_tokens QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ingested_at) = 1)"
_HOOK = "h AS (SELECT * FROM hook_payloads QUALIFY row_number() OVER (PARTITION BY payload_id ORDER BY received_at) = 1)"

SQL = {
    "resolve_t1": f"WITH {_P}, {_M} SELECT m.cid, min(p.entity_id) AS seq FROM m JOIN p ON {_EQ} GROUP BY 1",
    "resolve_context": f"WITH {_P}, {_M} SELECT m.cid, min(p.entity_id) AS seq FROM m JOIN p ON trim(m.facility) <> '' AND lower(trim(m.facility)) = lower(trim(p.facility)) AND ({_ANY}) GROUP BY 1",
    "fold_fill": _FOLDSQL("arg_min"),
    "fold_latest": _FOLDSQL("arg_max"),
    "fold_conflicts": f"WITH {_WORKS}, o AS (SELECT{_FOLDSQL('arg_min').split(') SELECT', 1)[1]}) " + " UNION ".join(f"SELECT DISTINCT o.work, '{f}' AS field, o.{f} AS current, w.{f} AS incoming FROM o JOIN w ON o.work = w.work WHERE trim(o.{f}) <> '' AND trim(w.{f}) <> '' AND lower(regexp_replace(trim(o.{f}), '\\s+', ' ', 'g')) <> lower(regexp_replace(trim(w.{f}), '\\s+', ' ', 'g'))" for f in _FOLD),
    "registry_stats": "SELECT source_name, count(*) AS deliveries, count(DISTINCT sighting_id) AS sightings, count(DISTINCT title) AS titles FROM publication_sightings GROUP BY 1",
    "merge_remap": "SELECT CAST(min(entity_id) AS VARCHAR) AS kept, count(*) AS sightings, count(*) AS merged FROM person_entities WHERE entity_type = 'person' GROUP BY source_scope, last_name, first_name",
    "trace_verify": "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS events, count(*) < 20 AS ok, max(CASE WHEN k = 20 THEN event_id END) AS broken_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY 1",
    "events_by_role": f"WITH {_CAPS} SELECT role, count(*) AS events FROM e GROUP BY 1",
    "events_under_chain": f"WITH {_CAPS} SELECT seq, cap_id FROM e WHERE list_contains(cap_chain, 'r2')",
    "delegation_tree": f"WITH {_CAPS}, h AS (SELECT seq, unnest(cap_chain) AS cap, unnest([NULL, cap_chain[1], cap_chain[2]]) AS parent FROM e), g AS (SELECT cap, min(parent) AS parent, count(DISTINCT seq) AS events FROM h GROUP BY 1) SELECT cap, parent, events, CASE WHEN parent IS NULL THEN 'root' WHEN cap IN (SELECT parent FROM g WHERE parent IS NOT NULL) THEN 'branch' ELSE 'leaf' END AS place FROM g",
    "hook_events": f"WITH {_HOOK}, x AS (SELECT *, coalesce(prompt, tool_input.prompt, tool_input.command, '') AS body FROM h) SELECT payload_id, session_id, agent_id, coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in trace.HOOK_EVENTS.items())}}}[hook_event_name], 'other') AS type, CASE WHEN tool_name IS NULL THEN NULL {' '.join(f'WHEN regexp_matches(tool_name, {p!r}) THEN {k!r}' for k, p in trace.TOOL_HINTS)} ELSE 'other' END AS tool_kind, CASE WHEN tool_input.command IS NULL THEN NULL ELSE regexp_extract(regexp_extract(tool_input.command, '^\\s*(?:sudo\\s+)?([\\w./-]+)', 1), '([^/]*)$', 1) END AS program, sha256(body) AS receipt, length(body) AS size FROM x",
    "call_pairs": f"""WITH RECURSIVE {_HOOK}, e AS (SELECT coalesce(session_id, '') || '|' || coalesce(agent_id, '') || '|' || coalesce(tool_name, '') AS k, payload_id AS p, CAST(floor(epoch(ts)) AS BIGINT) AS t, hook_event_name = 'PostToolUse' AS r
  FROM h WHERE hook_event_name IN ('PreToolUse', 'PostToolUse') AND ts IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, p) AS i FROM e),
f AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t BIGINT, p BIGINT)[]) AS q, CAST(NULL AS BIGINT) AS call_id, CAST(NULL AS BIGINT) AS result_id, CAST(NULL AS BIGINT) AS waited FROM n GROUP BY k
  UNION ALL SELECT k, i, CASE WHEN r THEN q[2:] ELSE list_append(q, {{'t': t, 'p': p}}) END, CASE WHEN r AND len(q) > 0 THEN q[1].p END, CASE WHEN r AND len(q) > 0 THEN p END, CASE WHEN r AND len(q) > 0 THEN t - q[1].t END
  FROM (SELECT n.k, n.i, n.p, n.t, n.r, list_filter(f.q, lambda x: n.t - x.t <= 900) AS q FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1))
SELECT call_id, result_id, waited FROM f WHERE call_id IS NOT NULL""",
    "scope_match": f"WITH {_T} SELECT token_id, coalesce(len(list_filter(scopes, lambda s: 'project:harbor-ledger/notes' GLOB s)) > 0, false) AS opens, coalesce(list_contains(capabilities, 'export'), false) AS exports, coalesce(TIMESTAMPTZ '{NOW}' >= CAST(expires_at AS TIMESTAMPTZ), false) AS expired FROM t",
    "caveat_check": f"WITH {_T} SELECT token_id, coalesce('{NOW}' < coalesce(expires_at, '2099-01-01T00:00:00Z') AND 'project:harbor-ledger' GLOB coalesce(scopes[1], '*') AND 1 <= len(capabilities), true) AS holds FROM t",
    "attenuation": f"WITH {_T}, j AS (SELECT c.token_id, coalesce(c.capabilities, []) AS cc, coalesce(p.capabilities, []) AS pc, coalesce(c.scopes, []) AS cs, coalesce(p.scopes, []) AS ps, c.budget_usd AS cb, p.budget_usd AS pb, c.expires_at AS ce, p.expires_at AS pe FROM t c JOIN t p ON lower(trim(c.parent_cap_id)) = lower(p.token_id)) SELECT token_id, 'capabilities' AS issue FROM j WHERE len(list_filter(cc, lambda x: NOT list_contains(pc, x))) > 0 UNION ALL SELECT token_id, 'scopes' FROM j WHERE len(list_filter(cs, lambda x: len(list_filter(ps, lambda p: p = x OR (NOT regexp_matches(p, '[?\\[\\]]') AND x GLOB p))) = 0)) > 0 UNION ALL SELECT token_id, 'budget' FROM j WHERE NOT coalesce(cb <= pb, false) UNION ALL SELECT token_id, 'expiry' FROM j WHERE pe IS NOT NULL AND (ce IS NULL OR ce > pe)",
    "budget_ledger": "WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS k FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT o_custkey, o_orderkey, k, o_totalprice <= 500000.0 AS accepted, CASE WHEN o_totalprice <= 500000.0 THEN o_totalprice ELSE 0.0 END AS spent FROM o WHERE k = 1 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.k, f.spent + o.o_totalprice <= 500000.0, CASE WHEN f.spent + o.o_totalprice <= 500000.0 THEN f.spent + o.o_totalprice ELSE f.spent END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1) SELECT o_custkey, o_orderkey, accepted, round(spent, 2) AS spent FROM f",
}
