"""Content-addressed shards: identity, hydration, scopes, expiry, index checks.

Shards and their atoms are two tables; an atom belongs to its ``shard_id`` at
``pos``.  Aggregates over atoms combine before the shuffle where they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.canonical import canonical_digest, struct_digest

# Seconds until a shard of each class expires.
TTL = {"stable": 90 * 86400, "active": 14 * 86400, "session": 86400, "checkpoint": 4 * 3600}


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def with_content_hash(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("content_hash", struct_digest(**{c: F.col(c) for c in ("text", "kind", "entity", "key", "value")}))


def distinct_shards(shards: DataFrame) -> DataFrame:
    """One row for each address: the one ingested first (puts are idempotent)."""
    at = "ingested_at" if "ingested_at" in shards.columns else "shard_id"
    return shards.groupBy("shard_id").agg(F.min_by(F.struct(*[c for c in shards.columns if c != "shard_id"]), at).alias("s")).select("shard_id", "s.*")


def content_addresses(shards: DataFrame, atoms: DataFrame) -> DataFrame:
    """(shard_id, address): digest of a shard's atoms in order, scope, origin.

    Null fields are left out, as is a confidence of exactly 1."""
    record = F.struct("text", "kind", "entity", "key", "value", F.when(F.col("confidence") != 1.0, F.col("confidence")).alias("confidence"), "source_ref")
    lists = atoms.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom_id", record.alias("a")))), lambda x: x["a"]).alias("atoms"))
    rows = distinct_shards(shards).select("shard_id", "scope", "origin").join(lists, "shard_id")
    return rows.select("shard_id", canonical_digest(F.to_json(F.struct("atoms", "scope", "origin"))).alias("address"))


def token_estimate(atoms: DataFrame) -> DataFrame:
    """(shard_id, tokens): a quarter of the characters a shard hydrates to."""
    extra = sum((F.when(filled(F.col(c)), F.length(c) + 10).otherwise(0) for c in ("entity", "key", "value")), F.lit(0))
    chars = F.coalesce(F.length("text"), F.lit(0)) + extra
    return atoms.groupBy("shard_id").agg(F.floor(F.sum(chars) / 4).cast("long").alias("tokens"))


def context_line(a: dict[str, Column] | None = None) -> Column:
    """One atom as a labelled line."""
    c = a or {k: F.col(k) for k in ("text", "kind", "entity", "key", "value")}
    label, path = F.concat(F.lit("- ["), c["kind"], F.lit("] ")), F.concat(c["entity"], F.lit("."), c["key"])
    return (
        F.when((c["kind"] == "instruction") & filled(c["key"]), F.concat(F.lit("- **"), c["key"], F.lit("**: "), c["text"]))
        .when(c["kind"] == "instruction", F.concat(F.lit("- "), c["text"]))
        .when(filled(c["entity"]) & filled(c["key"]) & filled(c["value"]), F.concat(label, path, F.lit(" = "), c["value"]))
        .when(filled(c["entity"]) & filled(c["key"]), F.concat(label, path, F.lit(": "), c["text"]))
        .otherwise(F.concat(label, c["text"]))
    )


def compact_line() -> Column:
    """One atom as ``entity.key=value`` or less."""
    e, k, v, t = (F.col(c) for c in ("entity", "key", "value", "text"))
    return (
        F.when(filled(e) & filled(k) & filled(v), F.concat(e, F.lit("."), k, F.lit("="), v))
        .when(filled(k) & filled(v), F.concat(k, F.lit("="), v))
        .when(filled(k), F.concat(k, F.lit(": "), t))
        .otherwise(t)
    )


def _lines(atoms: DataFrame, line: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "atom_id", F.coalesce(line, F.lit("")).alias("line"))))
    return atoms.groupBy("shard_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def hydrate_context(shards: DataFrame, atoms: DataFrame) -> DataFrame:
    """(shard_id, context): the shard's atoms as lines in a tagged block."""
    rows = distinct_shards(shards).select("shard_id", "scope", "tags").join(_lines(atoms, context_line()), "shard_id")
    label = F.coalesce(F.try_element_at("tags", F.lit(1)), F.col("scope"))
    return rows.select(
        "shard_id",
        F.concat(F.lit('<shard scope="'), F.coalesce("scope", F.lit("")), F.lit('" label="'), F.coalesce(label, F.lit("")), F.lit('">\n'), F.col("body"), F.lit("\n</shard>")).alias("context"),
    )


def hydrate_compact(atoms: DataFrame) -> DataFrame:
    return _lines(atoms, compact_line()).withColumnRenamed("body", "compact")


def expired(shards: DataFrame, now: str) -> DataFrame:
    """The shards past their class's time to live at ``now`` (ISO, Z)."""
    from loomstone.functions.instants import parse_instant

    ttl = F.coalesce(*[F.when(F.col("decay_class") == k, F.lit(v)) for k, v in TTL.items()])
    anchor = parse_instant(F.coalesce(F.when(F.col("last_checked") != "", F.col("last_checked")), F.col("created_at")))
    return shards.where((F.unix_timestamp(parse_instant(F.lit(now))) - F.unix_timestamp(anchor)) > ttl)


def store_stats(shards: DataFrame, atoms: DataFrame) -> DataFrame:
    """(scope, decay_class, shards, atoms) over distinct shards."""
    counts = atoms.groupBy("shard_id").agg(F.count("*").alias("n"))
    return (
        distinct_shards(shards).join(counts, "shard_id", "left").groupBy("scope", "decay_class")
        .agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("atoms"))
    )


def verify_index(index: DataFrame, files: DataFrame, key: str = "shard_id") -> DataFrame:
    """(key, issue): ``dangling`` in the index only, ``missing`` from it."""
    a, b = index.select(key).where(F.col(key).isNotNull()).distinct(), files.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("issue", F.lit("dangling")).unionByName(b.join(a, key, "left_anti").withColumn("issue", F.lit("missing")))


def latest_refs(refs: DataFrame, name: list[str], target: str, at: str) -> DataFrame:
    """The newest target of each name; ties go to the greater target."""
    return refs.groupBy(*name).agg(F.max(F.struct(at, target)).alias("m")).select(*name, F.col(f"m.{target}").alias(target), F.col(f"m.{at}").alias(at))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store's next state: rows whose address is not yet known are added."""
    return store.unionByName(new.dropDuplicates(["shard_id"]).join(store.select("shard_id"), "shard_id", "left_anti"), allowMissingColumns=True)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("shard_id"), "shard_id", "left_anti")


def resolve_many(store: DataFrame, refs: DataFrame, pos: str = "pos") -> DataFrame:
    """Shards in the order of the references; absent ones are skipped."""
    return refs.select("shard_id", pos).join(store, "shard_id").orderBy(pos)


def move_scope(store: DataFrame, atoms: DataFrame, shard_id: str, scope: str) -> tuple[DataFrame, DataFrame]:
    """(store, atoms) with a copy of the shard in another scope, the original as
    its parent.  The copy's id is its own content address, so moving a shard
    and writing it there afresh give one and the same."""
    old = distinct_shards(store.where(F.col("shard_id") == shard_id)).withColumn("scope", F.lit(scope))
    own = atoms.where(F.col("shard_id") == shard_id)
    address = content_addresses(old, own)
    moved = old.join(address, "shard_id").withColumn("parent_shard_id", F.col("shard_id"))
    moved = moved.withColumn("shard_id", F.col("address")).drop("address").join(store.select("shard_id").distinct(), "shard_id", "left_anti")
    carried = own.join(address, "shard_id").withColumn("shard_id", F.col("address")).drop("address").join(atoms.select("shard_id").distinct(), "shard_id", "left_anti")
    return store.unionByName(moved.select(store.columns)), atoms.unionByName(carried.select(atoms.columns))


def by_entity(shards: DataFrame, atoms: DataFrame, entity: str) -> DataFrame:
    return shards.join(atoms.where(F.col("entity") == entity).select("shard_id"), "shard_id", "left_semi")


def encrypt(df: DataFrame, payload: str, key: bytes) -> DataFrame:
    """Adds ``ciphertext`` (nonce, AES-GCM text and tag) and ``content_hash``."""
    return df.withColumn("content_hash", F.sha2(F.col(payload).cast("binary"), 256)).withColumn(
        "ciphertext", F.aes_encrypt(F.col(payload).cast("binary"), F.lit(key), F.lit("GCM"))
    )


def decrypt(df: DataFrame, key: bytes, out: str = "payload") -> DataFrame:
    """Adds the text and whether its content hash holds."""
    plain = F.aes_decrypt("ciphertext", F.lit(key), F.lit("GCM"))
    return df.withColumn(out, plain.cast("string")).withColumn("intact", F.sha2(plain, 256) == F.col("content_hash"))


def atom_of_key(atoms: DataFrame, key: str) -> DataFrame:
    """The first atom of each shard that has ``key``."""
    w = Window.partitionBy("shard_id").orderBy("pos", "atom_id")
    return atoms.where(F.col("key") == key).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
