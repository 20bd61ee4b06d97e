"""Queries that reach the operators the others don't, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import normalize
from loomstone.operators import audit, delegation, evaluation, hooks, orbit, resolution, shards
from loomstone.session import table
from loomstone.streaming import chains


def plain_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_entities").select("entity_id", normalize.strip_accents(F.col("last_name")).alias("plain"))


def combined_notes(spark: SparkSession, d: str) -> DataFrame:
    """Two notes on each part, which share a sentence."""
    p = table(spark, d, "part")
    known = F.concat("p_name", F.lit(" is sold. It comes from "), "p_brand", F.lit("."))
    fresh = F.concat(F.lit("IT  comes from "), "p_brand", F.lit(". Its size is "), "p_size", F.lit("."))
    return p.select("p_partkey", resolution.combine_text(known, fresh).alias("note"))


def triple_orbits(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three lines, their parts up to rotation."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: orbit.padded(x["l_partkey"], 8))
    rings = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("ring")).where("size(ring) = 3")
    return rings.select("l_orderkey", F.array_join(orbit.canonical_under(F.col("ring"), orbit.close_group([(1, 2, 0)], 3)), ",").alias("least"))


def first_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Each shard's first atom about its last run."""
    return shards.atom_of_key(table(spark, d, "shard_atoms"), "last_run").select("shard_id", "atom_id")


def store_put(spark: SparkSession, d: str) -> DataFrame:
    """A store of the stable shards after all shards are put and the expired ones deleted."""
    s = shards.distinct_shards(table(spark, d, "shards")).select("shard_id", "scope", "decay_class")
    after = shards.put(s.where("decay_class = 'stable'"), s)
    return shards.delete(after, s.where("decay_class = 'checkpoint'")).select("shard_id", "scope")


def resolved_refs(spark: SparkSession, d: str) -> DataFrame:
    """Shards by references, every second of which leads nowhere."""
    s = shards.distinct_shards(table(spark, d, "shards")).select("shard_id", "scope")
    refs = table(spark, d, "shard_atoms").where("pos = 0").groupBy("shard_id").agg(F.min("atom_id").alias("pos"))
    refs = refs.withColumn("shard_id", F.when(F.col("pos") % 2 == 0, F.col("shard_id")).otherwise(F.concat("shard_id", F.lit("?"))))
    return shards.resolve_many(s, refs).select("pos", "shard_id", "scope")


def shards_of_entity(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "shard_atoms")
    name = a.where("entity is not null").groupBy("entity").count().orderBy(F.desc("count"), "entity").first()
    return shards.by_entity(shards.distinct_shards(table(spark, d, "shards")), a, name.entity if name else "").select("shard_id")


def witness_files(spark: SparkSession, d: str) -> DataFrame:
    """Stated and actual digests of parts: some gone, some new, some changed."""
    p = table(spark, d, "part").select("p_partkey", F.md5("p_name").alias("h"))
    actual = p.where("p_partkey % 10 != 3").withColumn("h", F.when(F.col("p_partkey") % 7 == 0, F.md5("h")).otherwise(F.col("h")))
    return audit.reconcile(p.where("p_partkey % 10 != 4"), actual, "p_partkey", "h")


def vocab_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.select("doc_id", F.explode(audit.candidates(F.col("text"))).alias("candidate"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("cap_id"), F.md5(F.col("o_orderstatus")).alias("subject_thumbprint"))


def events_of_cap(spark: SparkSession, d: str) -> DataFrame:
    return delegation.by_cap(_trace(spark, d), "c7").select("seq")


def events_of_signer(spark: SparkSession, d: str) -> DataFrame:
    import hashlib

    return delegation.by_signer(_trace(spark, d), hashlib.md5(b"F").hexdigest()).select("seq")


def revenue_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by status and priority with all subtotals."""
    rows = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.grouping_id().cast("long").alias("level"))
    return rows.withColumnRenamed("o_orderstatus", "status").withColumnRenamed("o_orderpriority", "priority")


def price_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("parts"), F.max("p_retailprice").alias("dearest"))
    return rows


_TRIGGERS = ["Prompt Submit", "agentSpawn", "user_prompt_submit", "PostFileSave", "odd one", " ", "STOP"]
_TOOLS = ["fsWrite", "executeBash", "grepSearch", "remote_web_search", "mcp_git_log", "@srv/tool", "invoke_sub_agent", "Spec", "codegen"]


def hook_dialect(spark: SparkSession, d: str) -> DataFrame:
    """Triggers and tools as the second dialect spells them."""
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    n = table(spark, d, "nation")
    server = hooks.server_name(F.concat(F.initcap("n_name"), F.lit("-Srv v1.0")))
    line = hooks.lineage(F.col("n_name"), F.when(F.col("n_regionkey") > 2, F.lit("ROOT")))
    return n.select("n_nationkey", hooks.trigger(pick(_TRIGGERS)).alias("trigger"), hooks.tool_kind(pick(_TOOLS)).alias("kind"), server.alias("server"), line["root"].alias("root"), line["child"].alias("child"))


def surface_forms(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.surface_forms(table(spark, d, "documents"), ["Trust", "session log", "ledger"], "lang", "text")


def structure_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: orbit.padded(x["l_partkey"], 8))
    rings = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("ring"))
    pairs = evaluation.structure_pairs(rings, "l_orderkey", "ring")
    return pairs.groupBy("relation", "same").agg(F.count("*").alias("pairs"), F.sum(F.col("caught").cast("long")).alias("caught"))


def resolver_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The resolver on mutated people: per family, records, those found at the
    first tier, at one that merges by itself, at any, and wrong merges."""
    from loomstone.plans.reference_b import PERSON

    people = table(spark, d, "person_entities").where("entity_type = 'person'").withColumn("seq", F.col("entity_id"))
    changed = evaluation.mutations(people, "entity_id", ["last_name", "first_name"]).join(people.select("entity_id", "dob", "facility"), "entity_id")
    cases = changed.withColumn("cid", F.xxhash64("entity_id", "family"))
    found = resolution.resolve(cases.select("cid", "last_name", "first_name", "dob", "facility"), people, PERSON)
    rows = cases.select("cid", "entity_id", "family", "same").join(found, "cid")
    own, auto = F.col("same") & (F.col("seq") == F.col("entity_id")), F.col("tier").isin("exact", "strong")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.groupBy("family").agg(
        F.count("*").alias("records"), n(own & (F.col("tier") == "exact")).alias("first_tier"), n(own & auto).alias("merged"), n(own).alias("found"),
        n(auto & ((F.col("seq") != F.col("entity_id")) | ~F.col("same"))).alias("wrong"),
    )


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's two-hour windows, one each hour, over a table."""
    rows = chains.windowed_counts(_timed(spark, d), width="2 hours", slide="1 hour")
    return rows.select(F.unix_seconds("w.start").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's sessions of each user, ended by three quiet hours."""
    rows = chains.session_counts(_timed(spark, d), gap="3 hours")
    return rows.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "events")


QUERIES = {f.__name__: f for f in (plain_names, combined_notes, triple_orbits, first_atoms, store_put, resolved_refs, shards_of_entity, witness_files, vocab_candidates, events_of_cap, events_of_signer, revenue_rollup, price_cube, hook_dialect, surface_forms, structure_pairs, resolver_accuracy, sliding_windows, session_windows)}

_S = "s AS (SELECT * FROM shards QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY ingested_at) = 1)"
_TURNS = lambda r: f"list_transform(range(0, len({r})), lambda i: {r}[i + 1:] || {r}[:i])"
_CANON = lambda r: f"least(list_min({_TURNS(r)}), list_min({_TURNS('list_reverse(' + r + ')')}))"
SQL = {
    "sliding_windows": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 - 3600 * unnest([0, 1]) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "session_windows": "WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE ts IS NOT NULL), n AS (SELECT *, sum(CASE WHEN b IS NULL OR t > b + 10800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(t) AS start, max(t) + 10800000000 AS \"end\", count(*) AS events FROM n GROUP BY user_id, k",
    "hook_dialect": "SELECT n_nationkey, ['UserPromptSubmit', 'SessionStart', 'UserPromptSubmit', 'PostFileSave', 'odd one', 'unknown', 'Stop'][n_nationkey % 7 + 1] AS trigger, ['write', 'shell', 'read', 'web', 'mcp', 'mcp', 'spawn', 'spec', 'other'][n_nationkey % 9 + 1] AS kind, lower(regexp_replace(replace(replace(n_name || '_Srv v10', ' ', '_'), '-', '_'), '[^A-Za-z0-9_]', '', 'g')) AS server, CASE WHEN n_regionkey > 2 THEN 'ROOT' ELSE n_name END AS root, n_regionkey > 2 AS child FROM nation",
    "surface_forms": " UNION ALL ".join(f"SELECT '{e}' AS entity, source, form, count(*) AS n FROM (SELECT coalesce(lang, 'unknown') AS source, unnest(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({e.replace(' ', '  ')})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) AS f, replace(f, '  ', ' ') AS form FROM documents WHERE text IS NOT NULL) GROUP BY 2, 3" for e in ("Trust", "session log", "ledger")).replace("\\\\", "\\"),
    "structure_pairs": f"WITH r AS (SELECT l_orderkey, list(lpad(CAST(l_partkey AS VARCHAR), 8, '0') ORDER BY l_linenumber, l_partkey, l_suppkey) AS g FROM lineitem GROUP BY 1 HAVING count(*) >= 4), w AS (SELECT g, [g[2], g[1]] || g[3:] AS h FROM r) SELECT 'rotation' AS relation, true AS same, count(*) AS pairs, count(*) AS caught FROM r UNION ALL SELECT 'reflection', true, count(*), count(*) FROM r UNION ALL SELECT 'sibling', false, count(*), CAST(sum(CASE WHEN {_CANON('g')} = {_CANON('h')} THEN 1 ELSE 0 END) AS BIGINT) FROM w",
    "plain_names": "SELECT entity_id, strip_accents(last_name) AS plain FROM person_entities",
    "combined_notes": "SELECT p_partkey, p_name || ' is sold. It comes from ' || p_brand || '. Its size is ' || p_size || '.' AS note FROM part",
    "triple_orbits": "WITH r AS (SELECT l_orderkey, list(lpad(CAST(l_partkey AS VARCHAR), 8, '0') ORDER BY l_linenumber, l_partkey, l_suppkey) AS g FROM lineitem GROUP BY 1 HAVING count(*) = 3) SELECT l_orderkey, array_to_string(list_min([g, [g[2], g[3], g[1]], [g[3], g[1], g[2]]]), ',') AS least FROM r",
    "first_atoms": "SELECT shard_id, atom_id FROM shard_atoms WHERE key = 'last_run' QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY pos, atom_id) = 1",
    "store_put": f"WITH {_S} SELECT shard_id, scope FROM s WHERE decay_class IS DISTINCT FROM 'checkpoint'",
    "resolved_refs": f"WITH {_S}, r AS (SELECT shard_id, min(atom_id) AS pos FROM shard_atoms WHERE pos = 0 GROUP BY 1) SELECT r.pos, s.shard_id, s.scope FROM r JOIN s USING (shard_id) WHERE r.pos % 2 = 0",
    "shards_of_entity": "WITH e AS (SELECT entity FROM shard_atoms WHERE entity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 1) SELECT DISTINCT shard_id FROM shards WHERE shard_id IN (SELECT shard_id FROM shard_atoms JOIN e USING (entity))",
    "witness_files": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'missing' WHEN p_partkey % 10 = 4 THEN 'added' ELSE 'changed' END AS issue FROM part WHERE p_partkey % 10 IN (3, 4) OR p_partkey % 7 = 0",
    "vocab_candidates": "WITH d AS (SELECT doc_id, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT DISTINCT doc_id, lower(trim(unnest(list_concat(regexp_extract_all(text, '\\*\\*([^*]+)\\*\\*', 1), regexp_extract_all(text, '`([^`]+)`', 1))), ' ')) AS candidate FROM d",
    "events_of_cap": "SELECT o_orderkey AS seq FROM orders WHERE o_custkey % 50 = 7",
    "events_of_signer": "SELECT o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'",
    "revenue_rollup": "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "price_cube": "SELECT p_brand, p_size, count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY CUBE (p_brand, p_size)",
}
