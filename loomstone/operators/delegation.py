"""Tokens along their delegation chains, packaged jobs and their results.

A chain runs from a root token down to the token in use.  What must hold for
every link of it is looked up through the pairs of token and ancestor of the
hierarchy operator, as large as the sum of the chains' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.canonical import canonical_digest, struct_digest
from loomstone.operators.capability import attenuation_issues, caveats_hold
from loomstone.operators.hierarchy import ancestor_pairs, numbered_forest, parent_links, solve_forest
from loomstone.session import materialize

DEPTH = "max_delegation_depth"
# What a job's runner may do unless told otherwise.
RUNNER = ("shard:read", "shard:write", "kb:create", "kb:produce", "web:search", "web:fetch", "exec:run")


def cap_id(token: DataFrame) -> Column:
    """The content address of a token: a digest over what gives it authority."""
    names = ["budget_usd", "capabilities", "caveats", "created_at", "expires_at", "granted_by", "granted_to", "parent_cap_id", "scopes", "token_id"]
    return canonical_digest(F.to_json(F.struct(*[n for n in names if n in token.columns])))


def within_budget(budget: Column, spent: Column) -> Column:
    return F.coalesce(spent <= budget, F.lit(False))


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where("token_id is not null").dropDuplicates(["token_id"])


def chain_links(tokens: DataFrame, parent: str = "parent_cap_id") -> DataFrame:
    """(token_id, link, below): every token with each link of its chain, itself
    included, and how many links are below that one; none on cycles."""
    nodes, edges = numbered_forest(parent_links(tokens, "token_id", parent, "token"))
    nodes = materialize(nodes.select("v", F.col("node_id").alias("token_id")))
    pairs = ancestor_pairs(edges, materialize(solve_forest(edges)))
    names = nodes.select(F.col("v").alias("ancestor"), F.col("token_id").alias("link"))
    return pairs.join(names, "ancestor").join(nodes, "v").select("token_id", "link", F.col("distance").alias("below"))


def authorize_chains(tokens: DataFrame, caveats: Column, scope: str | None, now: str) -> DataFrame:
    """(token_id, authorized): whether the caveats of every link permit the
    request, each at its own depth.  Unknown caveats deny, as does a chain that
    never ends; a token without parent is its own chain."""
    known = distinct_tokens(tokens)
    rows = chain_links(known).join(known.select(F.col("token_id").alias("link"), caveats.alias("c")), "link")
    holds = caveats_hold(F.col("c"), F.lit(scope), F.col("below"), F.lit(now), strict=False)
    found = rows.groupBy("token_id").agg(F.min(holds).alias("authorized"))
    return known.select("token_id").join(found, "token_id", "left").select("token_id", F.coalesce("authorized", F.lit(False)).alias("authorized"))


def chain_faults(tokens: DataFrame, parent: str = "parent_cap_id") -> DataFrame:
    """(token_id, fault): why a token's chain proves nothing.

    ``endless``: it never reaches a root; ``no root``: it ends at a token that
    names a parent nobody knows; ``broader``: some link holds more than its
    parent.  Signatures are not looked at."""
    known = distinct_tokens(tokens)
    links = materialize(chain_links(known, parent))
    dangling = known.where(F.length(F.trim(parent)) > 0).withColumn("_p", F.lower(F.trim(parent)))
    dangling = dangling.join(known.select(F.lower(F.trim("token_id")).alias("_p")), "_p", "left_anti").select(F.col("token_id").alias("link"))
    broad = attenuation_issues(known, parent).select(F.col("token_id").alias("link")).distinct()
    fault = lambda bad, name: links.join(bad, "link").select("token_id", F.lit(name).alias("fault")).distinct()
    endless = known.select("token_id").join(links.select("token_id").distinct(), "token_id", "left_anti").withColumn("fault", F.lit("endless"))
    return endless.unionByName(fault(dangling, "no root")).unionByName(fault(broad, "broader"))


def delegate(tokens: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, granted_by, scopes, capabilities, budget_usd, expires_at,
    parent_cap_id, caveats, refusal): the child tokens that ``requests`` ask for.

    ``requests`` has request_id, parent (a token_id) and, null where they are
    left to the parent, scopes, capabilities, expires_at; further budget_usd
    and caveats.  The parent's first depth caveat passes on less one, unless
    the request sets a smaller depth.  ``refusal`` says why there is no child."""
    depth = lambda c: F.try_element_at(F.filter(F.coalesce(c, F.array().cast("array<struct<type:string,value:string>>")), lambda x: x["type"] == DEPTH), F.lit(1))["value"].cast("int")
    p = distinct_tokens(tokens)
    p = p.withColumn("_cap", cap_id(p)).select(
        F.col("token_id").alias("parent"), F.col("_cap").alias("p_cap"), F.col("granted_to").alias("granted_by"), F.col("scopes").alias("p_scopes"),
        F.col("capabilities").alias("p_caps"), F.col("expires_at").alias("p_expires"), F.col("budget_usd").alias("p_budget"), depth(F.col("caveats")).alias("p_depth"),
    )
    rows = requests.join(p, "parent", "left").withColumn("own", depth(F.col("caveats")))
    rows = rows.select(
        "request_id", "granted_by", F.coalesce("scopes", "p_scopes").alias("scopes"), F.coalesce("capabilities", "p_caps").alias("capabilities"),
        F.coalesce("budget_usd", F.lit(0.0)).alias("budget_usd"), F.coalesce("expires_at", "p_expires").alias("expires_at"), F.col("p_cap").alias("parent_cap_id"),
        F.when(F.col("p_depth").isNotNull() & F.col("own").isNull(), F.concat(F.coalesce("caveats", F.array().cast("array<struct<type:string,value:string>>")), F.array(F.struct(F.lit(DEPTH).alias("type"), (F.col("p_depth") - 1).cast("string").alias("value")))))
        .otherwise(F.col("caveats")).alias("caveats"),
        "p_scopes", "p_caps", "p_expires", "p_budget", "p_depth", "own",
    )
    from loomstone.operators.capability import scope_covered

    none = F.array().cast("array<string>")
    wide = F.exists(F.coalesce("scopes", none), lambda s: ~scope_covered(s, F.coalesce("p_scopes", none)))
    refusal = (
        F.when(F.col("parent_cap_id").isNull(), "unknown parent").when(F.col("p_depth") <= 0, "no further delegation").when(F.col("own") > F.col("p_depth") - 1, "depth")
        .when(F.size(F.array_except(F.coalesce("capabilities", none), F.coalesce("p_caps", none))) > 0, "capabilities").when(wide, "scopes")
        .when(~F.coalesce(F.col("budget_usd") <= F.col("p_budget"), F.lit(False)), "budget")
        .when(F.col("p_expires").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("p_expires"))), "expiry")
    )
    return rows.withColumn("refusal", refusal).select("request_id", "granted_by", "scopes", "capabilities", "budget_usd", "expires_at", "parent_cap_id", "caveats", "refusal")


def token_text(tokens: DataFrame) -> DataFrame:
    """(token_id, text): tokens as URL-safe base64 of their JSON."""
    cols = [c for c in tokens.columns if c != "ingested_at"]
    return tokens.select("token_id", F.translate(F.base64(F.to_json(F.struct(*cols)).cast("binary")), "+/\r\n", "-_").alias("text"))


def text_token(texts: DataFrame, schema: str) -> DataFrame:
    """The way back; null fields where the text isn't a token."""
    return texts.select(F.from_json(F.unbase64(F.translate("text", "-_", "+/")).cast("string"), schema).alias("t")).select("t.*")


def job_atoms(jobs: DataFrame) -> DataFrame:
    """(job_id, pos, text, kind, key) of each job's task: its prompt, budget and
    constraints.  ``jobs`` has job_id, prompt, budget_usd and constraints, an
    array of (name, value)."""
    fixed = F.array(
        F.struct(F.col("prompt").alias("text"), F.lit("instruction").alias("kind"), F.lit("production_prompt").alias("key")),
        F.struct(F.format_string("Budget: $%.2f", F.col("budget_usd").cast("double")).alias("text"), F.lit("instruction").alias("kind"), F.lit("budget_limit").alias("key")),
    )
    free = F.transform(
        F.coalesce("constraints", F.array().cast("array<struct<name:string,value:string>>")),
        lambda c: F.struct(F.concat(c["name"], F.lit(": "), c["value"]).alias("text"), F.lit("convention").alias("kind"), F.concat(F.lit("constraint."), c["name"]).alias("key")),
    )
    return jobs.where("budget_usd >= 0").select("job_id", F.posexplode(F.concat(fixed, free)).alias("pos", "a")).select("job_id", "pos", "a.*")


def shard_address(atoms: DataFrame, by: str, scope: Column, origin: Column) -> DataFrame:
    """(by, shard_id): content addresses of shards made of (text, kind, entity,
    key, value) rows in order of ``pos``."""
    have = lambda c: F.col(c) if c in atoms.columns else F.lit(None).cast("string")
    record = F.struct(*[have(c).alias(c) for c in ("text", "kind", "entity", "key", "value")])
    lists = atoms.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", record.alias("a")))), lambda x: x["a"]).alias("atoms"))
    return lists.select(by, canonical_digest(F.to_json(F.struct("atoms", scope.alias("scope"), origin.alias("origin")))).alias("shard_id"))


def package_jobs(jobs: DataFrame, content: DataFrame, agent: str, prefix: str = "job") -> DataFrame:
    """(job_id, content_shard, task_shard, scopes, capabilities, budget_usd,
    spawn): everything an agent needs to start a job but keys; ``content`` holds
    the jobs' atoms (job_id, pos, text, kind, entity, key, value)."""
    c = shard_address(content, "job_id", F.lit(f"{prefix}:content"), F.lit(agent)).withColumnRenamed("shard_id", "content_shard")
    t = shard_address(job_atoms(jobs), "job_id", F.lit(f"{prefix}:task"), F.lit(agent)).withColumnRenamed("shard_id", "task_shard")
    token = struct_digest(job=F.col("job_id").cast("string"), content=F.col("content_shard"), task=F.col("task_shard"))
    block = F.concat(
        F.lit("<job>\n<entitlement>"), token, F.lit("</entitlement>\n<content-shard>"), F.col("content_shard"), F.lit("</content-shard>\n<task-shard>"), F.col("task_shard"), F.lit("</task-shard>\n</job>"),
    )
    rows = jobs.join(c, "job_id").join(t, "job_id")
    return rows.select("job_id", "content_shard", "task_shard", F.array(F.lit(f"{prefix}:*")).alias("scopes"), F.array(*[F.lit(x) for x in RUNNER]).alias("capabilities"), "budget_usd", block.alias("spawn"))


def job_config(atoms: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, key, text): a task's settings; of one key the last atom counts."""
    return atoms.where("key is not null").groupBy(by, "key").agg(F.max_by("text", "pos").alias("text"))


def result_atoms(runs: DataFrame) -> DataFrame:
    """(job_id, pos, text, kind, entity, key) of what runs gave: a summary, the
    cost, outputs and warnings.  ``runs`` has job_id, prompt, spent_usd,
    budget_usd, outputs (array of type and ref) and warnings."""
    atom = lambda text, kind, entity, key: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(entity).cast("string").alias("entity"), key.alias("key"))
    done = F.concat(F.lit("Completed job: "), F.coalesce(F.when(F.col("prompt") != "", F.col("prompt")), F.lit("unknown")))
    cost = F.format_string("Spent $%.2f of $%.2f budget", F.coalesce(F.col("spent_usd").cast("double"), F.lit(0.0)), F.coalesce(F.col("budget_usd").cast("double"), F.lit(0.0)))
    made = F.transform(
        F.coalesce("outputs", F.array().cast("array<struct<type:string,ref:string>>")),
        lambda o: atom(F.concat(F.coalesce(o["type"], F.lit("output")), F.lit(": "), F.coalesce(o["ref"], F.lit("unknown"))), "fact", "job_run", F.concat(F.lit("output."), F.coalesce(o["type"], F.lit("unknown")))),
    )
    warned = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: atom(w, "context", None, F.lit("warning")))
    has_cost = F.col("spent_usd").isNotNull() | F.col("budget_usd").isNotNull()
    first = F.array_compact(F.array(atom(done, "fact", None, F.lit("job_summary")), F.when(has_cost, atom(cost, "fact", "job_run", F.lit("cost_summary")))))
    return runs.select("job_id", F.posexplode(F.concat(first, made, warned)).alias("pos", "a")).select("job_id", "pos", "a.*")


def genealogy(events: DataFrame) -> DataFrame:
    """(source, target, label): shards packaged under a token lead to it, it
    leads to the result.  ``events`` has type, token_id, content_shard,
    task_shard, result_shard."""
    packed = events.where("type = 'job_packaged'").select("token_id", F.explode(F.array(F.struct(F.col("content_shard").alias("s"), F.lit("content").alias("l")), F.struct(F.col("task_shard").alias("s"), F.lit("task").alias("l")))).alias("x"))
    before = packed.where("x.s is not null").select(F.col("x.s").alias("source"), F.col("token_id").alias("target"), F.col("x.l").alias("label"))
    done = events.where("type = 'job_completed' and result_shard is not null").join(packed.select("token_id").distinct(), "token_id", "left_semi")
    return before.unionByName(done.select(F.col("token_id").alias("source"), F.col("result_shard").alias("target"), F.lit("result").alias("label"))).distinct()


def event_steps(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, step, source, target): each event and the next one of the same agent
    or run, numbered from 1."""
    from pyspark.sql import Window

    line = Window.partitionBy(by).orderBy(*order)
    rows = events.select(by, F.row_number().over(line).alias("step"), F.col("type").alias("source"), F.lead("type").over(line).alias("target"))
    return rows.where("target is not null")


def by_signer(events: DataFrame, thumbprint: str) -> DataFrame:
    return events.where(F.col("subject_thumbprint") == thumbprint)


def by_cap(events: DataFrame, cap: str) -> DataFrame:
    return events.where(F.col("cap_id") == cap)
