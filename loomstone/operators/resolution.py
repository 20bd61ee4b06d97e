"""Tiered entity resolution against a registry, and folding of attributes.

The registry is a DataFrame with a unique ``seq`` (insertion order) and the
schema's fields.  Resolution blocks on the identity fields that are compared
exactly, so no candidate meets the whole registry.  Empty ones are wildcards:
pairs that share none of these fields are joined on a name that agrees, as
without one they can't reach the least score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.canonical import pairs_digest
from loomstone.functions.normalize import is_empty, letters, normalize_name, normalized_similarity, pytrim, scalars_equivalent, similarity_bound, with_similarity
from loomstone.session import materialize

# Confidence of each tier and the bounds of the fuzzy tiers.
CONFIDENCE = {"exact": 0.95, "strong": 0.85, "probable": 0.70, "context": 0.50, "none": 0.0}
STRONG, PROBABLE = 0.85, 0.65
SLACK = 1e-9  # of bounds, for rounding


@dataclass(frozen=True)
class Schema:
    """Which fields identify, which of these are fuzzy (least score), which
    give context and which are only carried along."""

    name: str
    identity: tuple[str, ...]
    fuzzy: dict[str, float] = field(default_factory=dict)
    context: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()

    @property
    def exact(self) -> tuple[str, ...]:
        return tuple(f for f in self.identity if f not in self.fuzzy)

    def digest(self) -> str:
        import hashlib
        import json

        body = json.dumps([self.name, sorted(self.identity), sorted(self.fuzzy.items()), sorted(self.context)], separators=(",", ":"))
        return hashlib.sha256(body.encode()).hexdigest()


def signature(schema: Schema) -> Column:
    return pairs_digest([(f, F.col(f)) for f in schema.identity])


def fold(c: Column) -> Column:
    return F.lower(pytrim(c))


def overlap(fields: list[tuple[Column, Column]], folded: bool = False) -> Column:
    """Share of the fields present on both sides that agree."""
    both = [a.isNotNull() & b.isNotNull() for a, b in fields]
    alike = lambda a, b: a == b if folded else fold(a) == fold(b)
    same = [F.when(p & alike(a, b), 1).otherwise(0) for p, (a, b) in zip(both, fields)]
    shared = reduce(lambda x, y: x + y, [F.when(p, 1).otherwise(0) for p in both])
    return F.when(shared > 0, reduce(lambda x, y: x + y, same) / shared).otherwise(0.0)


def resolve_exact(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq): the first registered entity of the same signature."""
    known = registry.withColumn("_d", signature(schema)).groupBy("_d").agg(F.min("seq").alias("seq"))
    return candidates.withColumn("_d", signature(schema)).join(known, "_d").select("cid", "seq")


def _side(rows: DataFrame, key: str, side: str, schema: Schema) -> DataFrame:
    """The identity fields of one side as pairs compare them: folded, and the
    fuzzy ones normalized with their letters.  A row's work is done here once,
    not for each of its pairs."""
    cols = [F.col(key), *[fold(F.col(f)).alias(f"{side}_{f}") for f in schema.identity]]
    rows = rows.select(*cols, *[normalize_name(F.col(f)).alias(f"{side}n_{f}") for f in schema.fuzzy])
    return materialize(rows.select("*", *[letters(F.col(f"{side}n_{f}")).alias(f"{side}l_{f}") for f in schema.fuzzy]))


def _blank(side: str, f: str) -> Column:
    return F.coalesce(F.col(f"{side}_{f}"), F.lit("")) == ""


def _bounded(pairs: DataFrame, schema: Schema) -> DataFrame:
    """Adds each pair's ``shared`` overlap and ``bound``, which its score
    doesn't exceed, and keeps the pairs that can reach the least score."""
    shared = overlap([(F.col(f"c_{f}"), F.col(f"r_{f}")) for f in schema.identity], folded=True)
    most = [F.when(F.col(f"cn_{f}").isNotNull() & F.col(f"rn_{f}").isNotNull(), similarity_bound(F.col(f"cl_{f}"), F.col(f"rl_{f}"))) for f in schema.fuzzy]
    count = reduce(lambda x, y: x + y, [F.when(b.isNull(), 0).otherwise(1) for b in most])
    mean = reduce(lambda x, y: x + y, [F.coalesce(b, F.lit(0.0)) for b in most]) / F.when(count > 0, count)
    rows = pairs.withColumn("shared", shared).withColumn("bound", (mean + F.col("shared")) / 2).where(F.col("bound") >= PROBABLE - SLACK)
    names = [f"{side}n_{f}" for side in "cr" for f in schema.fuzzy]
    return rows.select("cid", "seq", *names, "shared", "bound")


def _blocked(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """Pairs that contradict each other in no exact identity field.

    One equi-join for each set of exact fields that both sides have; pairs that
    share none are left to ``_wildcards``.
    """
    left, right = _side(candidates, "cid", "c", schema), _side(registry, "seq", "r", schema)
    parts = []
    for bits in range(1, 1 << len(schema.exact)):
        on = [f for i, f in enumerate(schema.exact) if bits >> i & 1]
        off = [f for f in schema.exact if f not in on]
        sides = [reduce(DataFrame.where, [~_blank(side, f) for f in on], rows) for side, rows in (("c", left), ("r", right))]
        rows = sides[0].join(sides[1], reduce(lambda a, b: a & b, [F.col(f"c_{f}") == F.col(f"r_{f}") for f in on]))
        for f in off:  # wildcards only: both present would be another block
            rows = rows.where(_blank("c", f) | _blank("r", f))
        parts.append(_bounded(rows, schema))
    return reduce(DataFrame.unionByName, parts)


def _wildcards(candidates: DataFrame, registry: DataFrame, schema: Schema, once: bool = True) -> DataFrame:
    """Pairs that share no exact identity field, as each is empty on a side.

    A score of PROBABLE needs an overlap of 2 * PROBABLE - 1 at least, so some
    field must agree: an equi-join on the agreeing field finds every pair that
    can count.  What an exact field holds doesn't matter here, only whether it
    holds anything; with ``once``, of rows of the registry that are equal then
    only the one with the first ``seq`` is read."""
    flat = [F.when(is_empty(F.col(f)), F.col(f)).otherwise("*").alias(f) if f in schema.exact else F.col(f) for f in schema.identity]
    left = _side(candidates.select("cid", *flat), "cid", "c", schema)
    right = registry.select("seq", *flat)
    if once:
        right = right.groupBy(*schema.identity).agg(F.min("seq").alias("seq"))
    right = _side(right, "seq", "r", schema)
    order = [*schema.fuzzy, *schema.exact]
    usable = lambda side, f: F.col(f"{side}_{f}").isNotNull() & (_blank(side, f) if f in schema.exact else F.lit(True))
    keys = lambda side: F.explode(F.array_compact(F.array(*[F.when(usable(side, f), F.struct(F.lit(i).alias("i"), F.col(f"{side}_{f}").alias("v"))) for i, f in enumerate(order)])))
    # Each registry row stands under every set of fields it lacks; a candidate under the set it has.
    sets = range(1 << len(schema.exact))
    has = reduce(lambda x, y: x + y, [F.when(_blank("c", f), 0).otherwise(1 << i) for i, f in enumerate(schema.exact)], F.lit(0))
    lacks = [reduce(lambda x, y: x & y, [_blank("r", f) for i, f in enumerate(schema.exact) if bits >> i & 1], F.lit(True)) for bits in sets]
    left = left.withColumn("_k", keys("c")).withColumn("_p", has)
    right = right.withColumn("_k", keys("r")).withColumn("_p", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(bits)) for bits, x in zip(sets, lacks)]))))
    agree = [usable("c", f) & usable("r", f) & (F.col(f"c_{f}") == F.col(f"r_{f}")) for f in order]
    # Few rows make many pairs here: the tasks are not to be put together by size.
    tasks = 4 * candidates.sparkSession.sparkContext.defaultParallelism
    pairs = left.repartition(tasks, "_k", "_p").join(right.repartition(tasks, "_k", "_p"), ["_k", "_p"])
    return _bounded(pairs.where(F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(agree)]) == F.col("_k.i")), schema)


def _scored(pairs: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq, score, every): each pair's mean similarity and overlap, and
    whether every similarity reaches its field's least score."""
    rows = materialize(pairs)  # else the joins are made for each similarity
    for f in schema.fuzzy:
        rows = normalized_similarity(rows, f"cn_{f}", f"rn_{f}", f"s_{f}")
    scores = F.array_compact(F.array(*[F.col(f"s_{f}") for f in schema.fuzzy]))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    every = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"s_{f}") >= least, F.lit(True)) for f, least in schema.fuzzy.items()])
    rows = rows.withColumn("score", (mean + F.col("shared")) / 2).withColumn("every", every).where("score is not null")
    return rows.select("cid", "seq", "score", "every")


def _best(pairs: DataFrame, schema: Schema) -> DataFrame:
    """(cid, b): of each candidate's pairs the best one, the first registered of
    equal ones."""
    return _scored(pairs, schema).groupBy("cid").agg(F.max(F.struct("score", (-F.col("seq")).alias("s"), "every")).alias("b"))


def _tiered(best: DataFrame) -> DataFrame:
    tier = F.when(F.col("b.every") & (F.col("b.score") >= STRONG), "strong").when(F.col("b.score") >= PROBABLE, "probable")
    return best.select("cid", (-F.col("b.s")).alias("seq"), tier.alias("tier"), F.col("b.score").alias("score")).where("tier is not null")


def resolve_fuzzy(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq, tier, score): the best of the entities that share an exact
    identity field; ``resolve_similar`` takes wildcards too, as a schema
    without exact fields needs."""
    if not schema.exact:
        return resolve_similar(candidates, registry, schema)
    return _tiered(_best(_blocked(candidates, registry, schema), schema))


def resolve_similar(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq, tier, score): the best entity of the whole registry that no
    exact identity field contradicts; an empty one contradicts nothing."""
    alike = candidates.withColumn("_g", F.to_json(F.struct(*[F.when(is_empty(F.col(f)), F.col(f)).otherwise("*").alias(f) if f in schema.exact else F.col(f) for f in schema.identity])))
    once = alike.groupBy("_g").agg(*[F.first(f).alias(f) for f in schema.identity]).withColumnRenamed("_g", "cid")
    wild = materialize(_best(_wildcards(once, registry, schema), schema)).withColumnRenamed("cid", "_g")
    best = alike.select("cid", "_g").join(wild, "_g").select("cid", "b")
    if schema.exact:
        blocked = _best(_blocked(candidates, registry, schema), schema)
        best = best.unionByName(blocked).groupBy("cid").agg(F.max("b").alias("b"))
    return _tiered(best)


def resolve_context(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq): the first registered entity that agrees in a context field
    and in some identity field."""
    hits = []
    for c in schema.context:
        for f in schema.identity:
            left = candidates.where(~is_empty(F.col(c)) & ~is_empty(F.col(f))).select("cid", fold(F.col(c)).alias("_c"), fold(F.col(f)).alias("_f"))
            right = registry.where(~is_empty(F.col(c)) & ~is_empty(F.col(f))).groupBy(fold(F.col(c)).alias("_c"), fold(F.col(f)).alias("_f")).agg(F.min("seq").alias("seq"))
            hits.append(left.join(right, ["_c", "_f"]).select("cid", "seq"))
    return reduce(DataFrame.unionByName, hits).groupBy("cid").agg(F.min("seq").alias("seq"))


def resolve(candidates: DataFrame, registry: DataFrame, schema: Schema) -> DataFrame:
    """(cid, seq, tier, confidence) for every candidate, the first tier that holds."""
    exact = resolve_exact(candidates, registry, schema).withColumn("tier", F.lit("exact"))
    left = candidates.join(exact, "cid", "left_anti")
    fuzzy = exact.limit(0)
    if schema.fuzzy:
        left = materialize(left)
        fuzzy = materialize(resolve_similar(left, registry, schema).select("cid", "seq", "tier"))
    left = left.join(fuzzy, "cid", "left_anti")
    context = resolve_context(left, registry, schema).withColumn("tier", F.lit("context")) if schema.context else exact.limit(0)
    found = exact.unionByName(fuzzy).unionByName(context)
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    rows = candidates.select("cid").join(found, "cid", "left").withColumn("tier", F.coalesce("tier", F.lit("none")))
    return rows.withColumn("confidence", confidence[F.col("tier")])


def report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("tier").agg(F.count("*").alias("candidates"), F.countDistinct("seq").alias("entities"))


def fold_fields(sightings: DataFrame, entity: str, order: list[str], fields: list[str], mode: str = "fill_empty") -> DataFrame:
    """One record per entity from its sightings in order.

    ``fill_empty`` keeps the first value that says something, ``latest`` the
    last.  ``conflicts`` names the fields in which later values differ."""
    at = F.struct(*order)
    said = lambda f: F.when(~is_empty(F.col(f)), F.struct(at.alias("at"), F.col(f).alias("v")))
    pick = F.min if mode == "fill_empty" else F.max
    aggs = [pick(said(f))["v"].alias(f) for f in fields]
    clash = [F.when(F.countDistinct(F.when(~is_empty(F.col(f)), F.lower(F.regexp_replace(pytrim(F.col(f)), r"(?U)\s+", " ")))) > 1, F.lit(f)) for f in fields]
    return sightings.groupBy(entity).agg(*aggs, F.array_join(F.array_compact(F.array(*clash)), ",").alias("conflicts"), F.count("*").alias("sightings"))


def field_conflicts(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, current, incoming): present on both sides and different."""
    pair = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("current"), F.col(f"b_{f}").alias("incoming")) for f in fields])
    out = pair.select(key, F.explode(rows).alias("x")).select(key, "x.*")
    return out.where(~is_empty(F.col("current")) & ~is_empty(F.col("incoming")) & ~scalars_equivalent(F.col("current"), F.col("incoming")))


def combine_text(current: Column, incoming: Column, most: int = 2000) -> Column:
    """``current`` and the sentences of ``incoming`` it doesn't hold yet."""
    cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")
    same = lambda s: F.lower(F.regexp_replace(s, r"\s+", " "))
    known = F.transform(cut(current), same)
    fresh = F.array_distinct(F.filter(cut(incoming), lambda s: ~F.array_contains(known, same(s))))
    return F.substring(F.array_join(F.concat(cut(current), fresh), " "), 1, most)


def merge_entities(sightings: DataFrame, merges: DataFrame, entity: str) -> DataFrame:
    """Sightings moved to the entity that was kept, and counted again.

    ``merges`` has keep and discard; chains of merges are followed with the
    hierarchy operator, so their length doesn't matter."""
    from loomstone.operators.hierarchy import parent_links, resolve_hierarchy

    ids = sightings.select(F.col(entity).cast("string").alias("e")).distinct()
    moves = merges.select(F.col("discard").cast("string").alias("e"), F.col("keep").cast("string").alias("k"))
    nodes = ids.unionByName(moves.select("e")).unionByName(moves.select(F.col("k").alias("e"))).distinct().join(moves, "e", "left")
    roots = resolve_hierarchy(parent_links(nodes, "e", "k", "merge")).where("depth >= 0")
    kept = sightings.withColumn("_e", F.col(entity).cast("string")).join(roots.select(F.col("node_id").alias("_e"), F.col("root_id").alias("kept")), "_e")
    return kept.groupBy("kept").agg(F.count("*").alias("sightings"), F.countDistinct("_e").alias("merged"))


def find_fuzzy(registry: DataFrame, fields: dict[str, str], limit: int = 10, least: float = 0.5) -> DataFrame:
    """Top entities by mean similarity to the given field values."""
    rows = registry
    for f, v in fields.items():
        rows = with_similarity(rows.withColumn("_q", F.lit(v)), "_q", f, f"s_{f}").drop("_q")
    mean = reduce(lambda a, b: a + b, [F.col(f"s_{f}") for f in fields]) / len(fields)
    return rows.withColumn("score", mean).where(F.col("score") >= least).orderBy(F.desc("score"), "seq").limit(limit)


def dedup_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (replace on conflict)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
