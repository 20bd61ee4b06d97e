"""A registry that grows record by record: create, sight, fold, plan.

Records are taken in order of ``cid``; one may match an entity that an earlier
record of the same batch created.  Who creates is settled in rounds: a record
is decided once all earlier records it could match are, so the work follows
the chains of like records, not their number.  Entities have ``seq``: those of
the registry keep theirs, a new one gets the registry's greatest plus 1 plus
its record's ``cid``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.canonical import short_id
from loomstone.functions.normalize import is_empty, scalars_equivalent
from loomstone.operators.resolution import (
    CONFIDENCE, PROBABLE, STRONG, Schema, _blocked, _scored, _wildcards, combine_text, resolve_context, resolve_exact, signature,
)
from loomstone.session import materialize


@dataclass(frozen=True)
class Policy:
    """How a sighting changes what is stored: fields whose sentences are
    joined, whether empty fields are filled, and whether a richer record wins."""

    combine: tuple[str, ...] = ()
    fill: bool = True
    richest: bool = False
    most: int = 2000


def foldable(schema: Schema) -> list[str]:
    """The fields a sighting may change: context and metadata, never identity."""
    return [f for f in (*schema.context, *schema.metadata) if f not in schema.identity]


def inert(schema: Schema, policy: Policy) -> dict[str, str]:
    """Fields the policy would join but never can, and why."""
    open_ = foldable(schema)
    return {f: "identity" if f in schema.identity else "undeclared" for f in sorted(policy.combine) if f not in open_}


def guard(meta: DataFrame | None, schema: Schema, spark: SparkSession) -> DataFrame:
    """The registry's (key, value) description; made where there is none, an
    error if it was built under another schema."""
    if meta is None or meta.limit(1).count() == 0:
        return spark.createDataFrame([("schema_name", schema.name), ("schema_hash", schema.digest())], "key string, value string")
    found = [r.value for r in meta.where("key = 'schema_hash'").limit(2).collect()]
    if found != [schema.digest()]:
        raise ValueError(f"the registry was built under another schema than {schema.name}")
    return meta


def richness(fields: list[str]) -> Column:
    """How many of the fields say something."""
    return sum((F.when(is_empty(F.col(f)), 0).otherwise(1) for f in fields), F.lit(0))


def entities(candidates: DataFrame, schema: Schema) -> DataFrame:
    """(cid, entity_id, digest, fields): records as new entities, their id by
    content; what isn't declared isn't stored."""
    fields = [f for f in dict.fromkeys((*schema.identity, *schema.context, *schema.metadata)) if f in candidates.columns]
    digest = signature(schema)
    return candidates.select("cid", short_id("ent", F.concat_ws("|", F.lit(schema.name), digest)).alias("entity_id"), digest.alias("digest"), F.to_json(F.struct(*sorted(fields))).alias("fields"))


def register(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, tier, confidence, entity, created, review): every record, taken in
    order, with the entity it now belongs to.

    ``exact`` and ``strong`` matches are sightings; ``probable`` ones create an
    entity and name the other one in ``review``, as do ``context`` and ``none``
    create one.  Records of one signature share the decision of their first."""
    fields = list(dict.fromkeys((*schema.identity, *schema.context)))
    base = (registry.agg(F.max("seq")).first()[0] or 0) + 1
    cand = materialize(candidates.select(F.col("cid").cast("long").alias("cid"), *fields, signature(schema).alias("_d")))
    old = materialize(resolve_exact(cand.select("cid", *fields), registry, schema).withColumnRenamed("seq", "entity"))
    rest = cand.join(old, "cid", "left_anti")
    first = rest.groupBy("_d").agg(F.min("cid").alias("_first"))
    rest = materialize(rest.join(first, "_d"))
    heads = rest.where("cid = _first").select("cid", *fields)

    # All that a head could match: the registry and earlier heads.
    both = registry.select(F.col("seq").cast("long").alias("seq"), *fields).unionByName(heads.select((F.col("cid") + base).alias("seq"), *fields))
    pairs = None
    if schema.fuzzy:
        pairs = _scored(_wildcards(heads, both, schema, once=False), schema)
        if schema.exact:
            pairs = pairs.unionByName(_scored(_blocked(heads, both, schema), schema))
        pairs = pairs.where((F.col("score") >= PROBABLE) & (F.col("seq") < F.col("cid") + base)).distinct()
        pairs = materialize(pairs.withColumn("other", F.when(F.col("seq") >= base, F.col("seq") - base)))
    decided = heads.select("cid", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("long").alias("match"))
    if pairs is not None:
        decided = decided.join(pairs.select("cid").distinct(), "cid", "left_anti")
        todo = materialize(pairs.select("cid").distinct())
        decided = materialize(decided)
        while todo.limit(1).count():
            waits = pairs.join(todo.select(F.col("cid").alias("other")), "other").select("cid").distinct()
            ready = todo.join(waits, "cid", "left_anti")
            # Only entities that exist count: a head that was merged made none.
            gone = decided.where("tier = 'strong'").select(F.col("cid").alias("other"))
            found = pairs.join(ready, "cid").join(gone, "other", "left_anti")
            best = found.groupBy("cid").agg(F.max(F.struct("score", (-F.col("seq")).alias("s"), "every")).alias("b"))
            tier = F.when(F.col("b.every") & (F.col("b.score") >= STRONG), "strong").when(F.col("b").isNotNull(), "probable")
            now = ready.join(best, "cid", "left").select("cid", tier.alias("tier"), (-F.col("b.s")).alias("match"))
            decided = materialize(decided.unionByName(now))
            todo = materialize(todo.join(decided.select("cid"), "cid", "left_anti"))
    # Heads without a likeness: what else they share with an entity before them.
    decided = decided.join(heads, "cid")
    if schema.context:
        made = decided.where("tier is null or tier = 'probable'").select((F.col("cid") + base).alias("seq"), *fields)
        alone = decided.where("tier is null").select("cid", *fields)
        known = registry.select(F.col("seq").cast("long").alias("seq"), *fields).unionByName(made)
        near = resolve_context(alone, known, schema).where(F.col("seq") < F.col("cid") + base).select("cid", F.col("seq").alias("_near"))
        decided = decided.join(near, "cid", "left").withColumn("tier", F.when(F.col("_near").isNotNull(), "context").otherwise(F.col("tier")))
    strong = F.coalesce(F.col("tier") == "strong", F.lit(False))
    heads = decided.select(F.col("cid").alias("_first"), F.coalesce("tier", F.lit("none")).alias("tier"), F.when(strong, F.col("match")).otherwise(F.col("cid") + base).alias("entity"), F.when(F.col("tier") == "probable", F.col("match")).alias("review"))
    rows = rest.select("cid", "_first").join(heads, "_first")
    again = (F.col("cid") > F.col("_first")) & (F.col("tier") != "strong")
    rows = rows.select(
        "cid", F.when(again, "exact").otherwise(F.col("tier")).alias("tier"), "entity", ((F.col("cid") == F.col("_first")) & (F.col("tier") != "strong")).alias("created"),
        F.when(~again, F.col("review")).alias("review"),
    )
    seen = old.select("cid", F.lit("exact").alias("tier"), "entity", F.lit(False).alias("created"), F.lit(None).cast("long").alias("review"))
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return seen.unionByName(rows).select("cid", "tier", confidence[F.col("tier")].alias("confidence"), "entity", "created", "review")


def plan(candidates: DataFrame, decisions: DataFrame, registry: DataFrame, schema: Schema, policy: Policy = Policy()) -> DataFrame:
    """(cid, entity, field, action, kept, dropped): what each sighting of a
    registered entity would change, without doing so.

    ``fill`` an empty field, ``combine`` sentences, ``replace`` by the richer
    record, ``keep`` against another value; a contradiction in an identity
    field is reported as ``identity`` and changes nothing."""
    open_ = [f for f in foldable(schema) if f in candidates.columns and f in registry.columns]
    every = [*schema.identity, *open_]
    rows = candidates.select("cid", *[F.col(f).alias(f"i_{f}") for f in every]).join(decisions.where("tier in ('exact', 'strong')").select("cid", "entity"), "cid")
    rows = rows.join(registry.select(F.col("seq").cast("long").alias("entity"), *[F.col(f).cast("string").alias(f"c_{f}") for f in every]), "entity")
    richer = F.lit(False)
    if policy.richest:
        count = lambda side: sum((F.when(is_empty(F.col(f"{side}_{f}")), 0).otherwise(1) for f in every), F.lit(0))
        richer = count("i") > count("c")
    steps = []
    for f in every:
        current, incoming = F.col(f"c_{f}"), F.col(f"i_{f}").cast("string")
        step = lambda action, kept, dropped, f=f: F.struct(F.lit(f).alias("field"), F.lit(action).alias("action"), kept.alias("kept"), dropped.cast("string").alias("dropped"))
        same = scalars_equivalent(current, incoming)
        if f in schema.identity:
            steps.append(F.when(~is_empty(current) & ~is_empty(incoming) & ~same, step("identity", current, incoming)))
            continue
        whole = combine_text(current, incoming, policy.most)
        case = F.when(is_empty(incoming), None)
        case = case.when(is_empty(current), step("fill", incoming, current) if policy.fill else F.lit(None)).when(same, None)
        if f in policy.combine:
            steps.append(case.when(whole != current, step("combine", whole, F.lit(None))))
        else:
            steps.append(case.when(richer, step("replace", incoming, current)).otherwise(step("keep", current, incoming)))
    return rows.select("cid", "entity", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("cid", "entity", "s.*")


def upsert(candidates: DataFrame, decisions: DataFrame, registry: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(registry, merges): the registry's next state, sightings folded in order
    into what is empty and counted, and the pairs to be looked at."""
    fields = [f for f in dict.fromkeys((*schema.identity, *schema.context, *schema.metadata)) if f in candidates.columns and f in registry.columns]
    stored = registry.select(F.col("seq").cast("long").alias("seq"), F.lit(-1).cast("long").alias("_o"), *[F.col(f).cast("string").alias(f) for f in fields])
    sighted = candidates.join(decisions.select("cid", "entity"), "cid").select(F.col("entity").alias("seq"), F.col("cid").cast("long").alias("_o"), *[F.col(f).cast("string").alias(f) for f in fields])
    open_ = set(foldable(schema))
    first = [F.min_by(f, "_o").alias(f) if f not in open_ else F.min_by(f, F.when(~is_empty(F.col(f)), F.col("_o"))).alias(f) for f in fields]
    after = stored.unionByName(sighted).groupBy("seq").agg(*first, F.sum((F.col("_o") >= 0).cast("long")).alias("sightings"))
    merges = decisions.where("review is not null").select(F.col("review").alias("keep"), F.col("entity").alias("discard"), "tier", "confidence")
    return after, merges
