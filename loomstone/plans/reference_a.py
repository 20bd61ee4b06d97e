"""Queries over normalization, symmetric structures and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import normalize as n
from loomstone.functions.canonical import pairs_digest
from loomstone.operators import orbit, shards
from loomstone.session import table

NOW = "2025-10-01T00:00:00Z"


def norm_name(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("variant")
    return table(spark, d, "name_variants").select("variant_id", n.normalize_name(c).alias("name"), n.strip_punctuation(c).alias("plain"), n.first_initial(c).alias("initial"))


_WRITTEN = {0: "yyyy-MM-dd", 1: "MM/dd/yyyy", 2: "MM-dd-yyyy", 3: "dd/MM/yyyy", 4: "MMMM dd, yyyy", 5: "MMM dd, yyyy", 6: "yyyyMMdd", 7: "MM/dd/yy"}


def norm_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    written = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", f)) for k, f in _WRITTEN.items()])
    return o.select("o_orderkey", n.normalize_date(written).alias("iso"))


def age_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(n.age_bucket(F.col("p_size"), 5).alias("bucket")).agg(F.count("*").alias("parts"))


def name_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A composed normalizer per column, and whether it changed the value."""
    p = table(spark, d, "person_entities").select("entity_id", "first_name", "last_name")
    done = n.apply_normalizers(p, {"first_name": n.pipeline(n.strip_punctuation, F.upper), "last_name": n.normalize_name})
    return p.select("entity_id", F.col("last_name").alias("raw")).join(done, "entity_id").select(
        "entity_id", "first_name", "last_name", n.scalars_equivalent(F.col("raw"), F.col("last_name")).alias("same"), n.is_empty(F.col("first_name")).alias("nameless")
    )


_ESS = ("last_name", "first_name", "dob")


def _digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_entities").select("entity_id", pairs_digest([(k, F.col(k)) for k in _ESS]).alias("digest"))


def ess_digest(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d)


def ess_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Entities that one signature cannot tell apart."""
    names = pairs_digest([(k, F.col(k)) for k in ("last_name", "first_name")])
    return table(spark, d, "person_entities").select("entity_id", names.alias("digest")).groupBy("digest").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first")).where("entities > 1")


def _rings(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem").groupBy("l_orderkey")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: orbit.padded(x["l_partkey"], 8)).alias("ring"))
    )


def cycle_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d).select("l_orderkey", F.array_join(orbit.canonical_cycle(F.col("ring")), ",").alias("ring"))


def cycle_digest(spark: SparkSession, d: str) -> DataFrame:
    """Orders per ring class under rotation alone."""
    return _rings(spark, d).groupBy(orbit.cycle_digest(F.col("ring"), reflect=False).alias("digest")).agg(F.count("*").alias("orders"))


def orbit_group(spark: SparkSession, d: str) -> DataFrame:
    """Orders per unordered grouping of their parts."""
    return _rings(spark, d).groupBy(orbit.orbit_digest(F.col("ring")).alias("digest")).agg(F.count("*").alias("orders"))


def anchor_cycle(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d).select("l_orderkey", F.array_join(orbit.anchor_cycle(F.col("ring"), F.array_min("ring")), ",").alias("ring")).where("ring is not null")


def atom_hash(spark: SparkSession, d: str) -> DataFrame:
    return shards.with_content_hash(table(spark, d, "shard_atoms")).select("atom_id", "content_hash")


def atom_dedup(spark: SparkSession, d: str) -> DataFrame:
    return (
        shards.with_content_hash(table(spark, d, "shard_atoms")).groupBy("content_hash")
        .agg(F.min("atom_id").alias("atom_id"), F.count("*").alias("atoms"), F.countDistinct("shard_id").alias("shards"))
    )


def shard_address(spark: SparkSession, d: str) -> DataFrame:
    return shards.content_addresses(table(spark, d, "shards"), table(spark, d, "shard_atoms"))


def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    return shards.store_stats(table(spark, d, "shards"), table(spark, d, "shard_atoms"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return shards.token_estimate(table(spark, d, "shard_atoms"))


def hydrate_context(spark: SparkSession, d: str) -> DataFrame:
    return shards.hydrate_context(table(spark, d, "shards"), table(spark, d, "shard_atoms"))


def hydrate_compact(spark: SparkSession, d: str) -> DataFrame:
    return shards.hydrate_compact(table(spark, d, "shard_atoms"))


def ttl_prune(spark: SparkSession, d: str) -> DataFrame:
    s = shards.distinct_shards(table(spark, d, "shards"))
    return shards.expired(s, NOW).groupBy("decay_class").agg(F.count("*").alias("pruned"))


def index_verify(spark: SparkSession, d: str) -> DataFrame:
    """Shards without atoms and atoms without a shard."""
    return shards.verify_index(table(spark, d, "shards"), table(spark, d, "shard_atoms"))


def refs_latest(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "shards").where("scope is not null and origin is not null")
    return shards.latest_refs(s.select("scope", "origin", "shard_id", "created_at"), ["scope", "origin"], "shard_id", "created_at")


def encrypt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = b"0123456789abcdef0123456789abcdef"
    a = table(spark, d, "shard_atoms").where("text is not null").select("atom_id", "text")
    return shards.decrypt(shards.encrypt(a, "text", key), key).select("atom_id", F.col("payload").alias("text"), "intact", F.length("ciphertext").alias("size"))


QUERIES = {f.__name__: f for f in (norm_name, norm_date, age_bucket, name_pipeline, ess_digest, ess_collisions, cycle_canonical, cycle_digest, orbit_group, anchor_cycle, atom_hash, atom_dedup, shard_address, shard_stats, token_estimate, hydrate_context, hydrate_compact, ttl_prune, index_verify, refs_latest, encrypt_roundtrip)}

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_W = r"[^\p{L}\p{N}\p{M}_\s\p{Z}-]"
_ATOMJSON = "sha256('{\"entity\":' || coalesce(to_json(entity), 'null') || ',\"key\":' || coalesce(to_json(key), 'null') || ',\"kind\":' || coalesce(to_json(kind), 'null') || ',\"text\":' || coalesce(to_json(text), 'null') || ',\"value\":' || coalesce(to_json(value), 'null') || '}')"
_RINGS = "r AS (SELECT l_orderkey, list(lpad(CAST(l_partkey AS VARCHAR), 8, '0') ORDER BY l_linenumber, l_partkey, l_suppkey) AS ring FROM lineitem GROUP BY 1)"
_TURN = "list_transform(range(len(ring)), lambda i: ring[i + 1:] || ring[:i])"
_ESSJSON = "sha256(to_json(list_filter([CASE WHEN dob IS NULL THEN NULL ELSE ['dob', lower(trim(dob))] END, CASE WHEN first_name IS NULL THEN NULL ELSE ['first_name', lower(trim(first_name))] END, CASE WHEN last_name IS NULL THEN NULL ELSE ['last_name', lower(trim(last_name))] END], lambda x: x IS NOT NULL)))"
_SHARDS = "s AS (SELECT * FROM shards QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY ingested_at) = 1)"
_LINE = "CASE WHEN kind = 'instruction' AND key <> '' THEN '- **' || key || '**: ' || text WHEN kind = 'instruction' THEN '- ' || text WHEN entity <> '' AND key <> '' AND value <> '' THEN '- [' || kind || '] ' || entity || '.' || key || ' = ' || value WHEN entity <> '' AND key <> '' THEN '- [' || kind || '] ' || entity || '.' || key || ': ' || text ELSE '- [' || kind || '] ' || text END"
_COMPACT = "CASE WHEN entity <> '' AND key <> '' AND value <> '' THEN entity || '.' || key || '=' || value WHEN key <> '' AND value <> '' THEN key || '=' || value WHEN key <> '' THEN key || ': ' || text ELSE text END"

SQL = {
    "norm_name": f"SELECT variant_id, regexp_replace(regexp_replace({_TRIM.format('upper(variant)')}, '{_W}', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g') AS name, coalesce(regexp_replace(variant, '{_W}', '', 'g'), '') AS plain, coalesce(upper(substr(regexp_replace({_TRIM.format('variant')}, '^\\.+', ''), 1, 1)), '') AS initial FROM name_variants",
    "norm_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 3 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "age_bucket": "SELECT CAST(p_size // 5 * 5 AS VARCHAR) || '-' || CAST(p_size // 5 * 5 + 4 AS VARCHAR) AS bucket, count(*) AS parts FROM part GROUP BY 1",
    "name_pipeline": f"SELECT entity_id, upper(coalesce(regexp_replace(first_name, '{_W}', '', 'g'), '')) AS first_name, regexp_replace(regexp_replace({_TRIM.format('upper(last_name)')}, '{_W}', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g') AS last_name, lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')) IS NOT DISTINCT FROM lower(regexp_replace(regexp_replace({_TRIM.format('upper(last_name)')}, '{_W}', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS same, coalesce(trim(regexp_replace(first_name, '{_W}', '', 'g')), '') = '' AS nameless FROM (SELECT *, last_name AS raw FROM person_entities)",
    "ess_digest": f"SELECT entity_id, {_ESSJSON} AS digest FROM person_entities",
    "ess_collisions": f"SELECT digest, count(*) AS entities, min(entity_id) AS first FROM (SELECT entity_id, {_ESSJSON.replace("CASE WHEN dob IS NULL THEN NULL ELSE ['dob', lower(trim(dob))] END, ", "")} AS digest FROM person_entities) GROUP BY 1 HAVING count(*) > 1",
    "cycle_canonical": f"WITH {_RINGS} SELECT l_orderkey, array_to_string(least(list_min({_TURN}), list_min({_TURN.replace('ring', 'list_reverse(ring)')})), ',') AS ring FROM r",
    "cycle_digest": f"WITH {_RINGS} SELECT sha256('ring/v1' || chr(0) || '[\"' || array_to_string(list_min({_TURN}), '\",\"') || '\"]') AS digest, count(*) AS orders FROM r GROUP BY 1",
    "orbit_group": f"WITH {_RINGS} SELECT sha256('orbit/v1' || chr(0) || '[\"' || array_to_string(list_sort(ring), '\",\"') || '\"]') AS digest, count(*) AS orders FROM r GROUP BY 1",
    "anchor_cycle": f"WITH {_RINGS}, p AS (SELECT *, list_min(ring) AS a FROM r) SELECT l_orderkey, array_to_string(ring[list_position(ring, a):] || ring[:list_position(ring, a) - 1], ',') AS ring FROM p WHERE len(list_filter(ring, lambda x: x = a)) = 1",
    "atom_hash": f"SELECT atom_id, {_ATOMJSON} AS content_hash FROM shard_atoms",
    "atom_dedup": f"SELECT content_hash, min(atom_id) AS atom_id, count(*) AS atoms, count(DISTINCT shard_id) AS shards FROM (SELECT *, {_ATOMJSON} AS content_hash FROM shard_atoms) GROUP BY 1",
    "shard_stats": f"WITH {_SHARDS}, a AS (SELECT shard_id, count(*) AS n FROM shard_atoms GROUP BY 1) SELECT scope, decay_class, count(*) AS shards, CAST(coalesce(sum(n), 0) AS BIGINT) AS atoms FROM s LEFT JOIN a USING (shard_id) GROUP BY 1, 2",
    "token_estimate": "SELECT shard_id, CAST(floor(sum(coalesce(length(text), 0) + CASE WHEN entity <> '' THEN length(entity) + 10 ELSE 0 END + CASE WHEN key <> '' THEN length(key) + 10 ELSE 0 END + CASE WHEN value <> '' THEN length(value) + 10 ELSE 0 END) / 4) AS BIGINT) AS tokens FROM shard_atoms GROUP BY 1",
    "hydrate_context": f"WITH {_SHARDS}, b AS (SELECT shard_id, string_agg(coalesce({_LINE}, ''), chr(10) ORDER BY pos, atom_id) AS body FROM shard_atoms GROUP BY 1) SELECT shard_id, '<shard scope=\"' || coalesce(scope, '') || '\" label=\"' || coalesce(tags[1], scope, '') || '\">' || chr(10) || body || chr(10) || '</shard>' AS context FROM s JOIN b USING (shard_id)",
    "hydrate_compact": f"SELECT shard_id, string_agg(coalesce({_COMPACT}, ''), chr(10) ORDER BY pos, atom_id) AS compact FROM shard_atoms GROUP BY 1",
    "ttl_prune": f"WITH {_SHARDS} SELECT decay_class, count(*) AS pruned FROM s WHERE epoch(TIMESTAMPTZ '{NOW}') - epoch(CAST(coalesce(nullif(last_checked, ''), created_at) AS TIMESTAMPTZ)) > CASE decay_class WHEN 'stable' THEN 7776000 WHEN 'active' THEN 1209600 WHEN 'session' THEN 86400 WHEN 'checkpoint' THEN 14400 END GROUP BY 1",
    "index_verify": "SELECT shard_id, 'dangling' AS issue FROM (SELECT DISTINCT shard_id FROM shards) WHERE shard_id NOT IN (SELECT shard_id FROM shard_atoms WHERE shard_id IS NOT NULL) UNION ALL SELECT shard_id, 'missing' FROM (SELECT DISTINCT shard_id FROM shard_atoms WHERE shard_id IS NOT NULL) WHERE shard_id NOT IN (SELECT shard_id FROM shards)",
    "refs_latest": "SELECT scope, origin, m.shard_id AS shard_id, m.created_at AS created_at FROM (SELECT scope, origin, max({'created_at': created_at, 'shard_id': shard_id}) AS m FROM shards WHERE scope IS NOT NULL AND origin IS NOT NULL GROUP BY 1, 2)",
    "encrypt_roundtrip": "SELECT atom_id, text, true AS intact, octet_length(encode(text)) + 28 AS size FROM shard_atoms WHERE text IS NOT NULL",
}
