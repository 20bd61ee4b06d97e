"""Jobs, manifests, checkpoints, views and witnesses over shards and events."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.canonical import canonical_digest


def manifests(shards: DataFrame, publisher: str) -> DataFrame:
    """(scope, shards, manifest_id): the listing of each scope's distinct shards
    and its content address, a digest over the digests of 256 parts of the
    listing, so that no scope's whole listing ever is one row."""
    ids = shards.where("shard_id is not null and scope is not null").select("scope", "shard_id").distinct()
    leaf = ids.groupBy("scope", F.substring("shard_id", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("shard_id")), ","), 256).alias("h"))
    root = leaf.groupBy("scope").agg(F.sum("n").alias("shards"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: F.concat(x["p"], F.lit(":"), x["h"])), ",").alias("body"))
    return root.select("scope", "shards", F.sha2(F.concat_ws("|", "scope", F.lit(publisher), "body"), 256).alias("manifest_id"))


def object_key(prefix: str, shard_id: Column, suffix: str = "json") -> Column:
    """The place of a shard in an object store, spread over 256 folders."""
    return F.concat(F.lit(f"{prefix}/shards/"), F.substring(shard_id, 1, 2), F.lit("/"), shard_id.substr(F.lit(3), F.length(shard_id)), F.lit(f".{suffix}"))


def parse_job(text: Column) -> Column:
    """(entitlement, content, task) of a job block; null where one is missing."""
    tag = lambda t: F.trim(F.regexp_extract(text, rf"(?s)<{t}>(.*?)</{t}>", 1))
    whole = text.rlike(r"(?s)<entitlement>.*?</entitlement>") & text.rlike(r"(?s)<content-shard>.*?</content-shard>") & text.rlike(r"(?s)<task-shard>.*?</task-shard>")
    return F.when(whole, F.struct(tag("entitlement").alias("entitlement"), tag("content-shard").alias("content"), tag("task-shard").alias("task")))


def hydrate_jobs(jobs: DataFrame, tokens: DataFrame, shards: DataFrame, now: str, action: str) -> DataFrame:
    """(job_id, status, content_scope, task_scope): each job's token and shards,
    or why it can't run."""
    from loomstone.operators.capability import has_capability, is_expired

    rows = jobs.select("job_id", parse_job(F.col("text")).alias("j"))
    t = tokens.dropDuplicates(["token_id"]).select(F.col("token_id").alias("_t"), "capabilities", "expires_at")
    s = shards.groupBy("shard_id").agg(F.min("scope").alias("scope"))
    rows = rows.join(t, F.col("j.entitlement") == F.col("_t"), "left")
    rows = rows.join(s.select(F.col("shard_id").alias("_c"), F.col("scope").alias("content_scope")), F.col("j.content") == F.col("_c"), "left")
    rows = rows.join(s.select(F.col("shard_id").alias("_k"), F.col("scope").alias("task_scope")), F.col("j.task") == F.col("_k"), "left")
    status = (
        F.when(F.col("j").isNull(), "malformed").when(F.col("_t").isNull(), "no token").when(is_expired(F.col("expires_at"), F.lit(now)), "expired")
        .when(~has_capability(F.col("capabilities"), action), "not permitted").when(F.col("_c").isNull() | F.col("_k").isNull(), "shard missing").otherwise("ready")
    )
    return rows.select("job_id", status.alias("status"), "content_scope", "task_scope")


def resume_stages(refs: DataFrame) -> DataFrame:
    """(pipeline, status, stage) from named references: a result wins, then the
    last checkpoint.  ``refs`` has pipeline, kind (result, checkpoint), stage, at."""
    rows = refs.groupBy("pipeline").agg(F.max(F.col("kind") == "result").alias("done"), F.max_by("stage", F.when(F.col("kind") == "checkpoint", F.col("at"))).alias("stage"))
    return rows.select("pipeline", F.when(F.col("done"), "complete").when(F.col("stage").isNotNull(), "in_progress").otherwise("not_started").alias("status"), F.when(~F.col("done"), F.regexp_replace("stage", "_complete", "")).alias("stage"))


def view_atoms(views: DataFrame) -> DataFrame:
    """Geographic views (view_id, zoom, lat, lng, annotation) as atoms."""
    deg = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    note = F.substring(F.regexp_replace("annotation", r"\p{C}", ""), 1, 280)
    atoms = F.array(
        F.struct(F.lit("zoom").alias("key"), F.col("zoom").cast("string").alias("value")),
        F.struct(F.lit("center").alias("key"), F.concat(deg("lat"), F.lit(","), deg("lng")).alias("value")),
        F.struct(F.lit("annotation").alias("key"), note.alias("value")),
    )
    return views.select("view_id", F.explode(F.filter(atoms, lambda a: a["value"].isNotNull())).alias("a")).select("view_id", F.lit("view").alias("entity"), "a.*")


def atoms_view(atoms: DataFrame) -> DataFrame:
    """The way back; values that can't be read fall back to defaults."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    rows = atoms.groupBy("view_id").agg(pick("zoom").alias("z"), F.split(pick("center"), ",").alias("c"), pick("annotation").alias("annotation"))
    num = lambda i: F.coalesce(F.try_element_at("c", F.lit(i)).try_cast("double"), F.lit(0.0))
    return rows.select("view_id", F.coalesce(F.col("z").try_cast("int"), F.lit(0)).alias("zoom"), num(1).alias("lat"), num(2).alias("lng"), "annotation")


def within_budget(sections: DataFrame, group: str, order: str, text: str, most: int = 4000) -> DataFrame:
    """The leading sections of each group whose texts fit the budget: all before
    the first that overflows."""
    w = Window.partitionBy(group).orderBy(order)
    total = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", total).where(F.col("used") <= most)


def validate_findings(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """(finding_id, issue): findings against the registry by signature; a name
    that only resembles one is drift."""
    from loomstone.functions.normalize import is_empty, pytrim, with_similarity

    key = lambda c: F.lower(pytrim(F.col(c)))
    known = registry.select(key("finding_name").alias("_n"), F.col("finding_name").alias("canonical"), F.col("category").alias("k_category"), F.col("default_risk").alias("k_risk")).dropDuplicates(["_n"])
    rows = findings.withColumn("_n", key("name")).join(known, "_n", "left")
    bad = rows.where(is_empty(F.col("name"))).select("finding_id", F.lit("malformed_finding").alias("issue"))
    exact = rows.where(~is_empty(F.col("name")) & F.col("canonical").isNotNull())
    issues = F.array_compact(F.array(F.when(~F.col("category").eqNullSafe(F.col("k_category")), "category_mismatch"), F.when(~F.col("risk").eqNullSafe(F.col("k_risk")), "risk_mismatch")))
    rest = rows.where(~is_empty(F.col("name")) & F.col("canonical").isNull()).select("finding_id", "name").withColumn("_w", F.explode(F.array_distinct(F.split(F.lower("name"), r"\W+"))))
    words = known.select("canonical", F.explode(F.array_distinct(F.split("_n", r"\W+"))).alias("_w"))
    near = with_similarity(rest.join(words, "_w").select("finding_id", "name", "canonical").distinct(), "name", "canonical", "s").groupBy("finding_id").agg(F.max("s").alias("s"))
    drift = rest.select("finding_id").distinct().join(near, "finding_id", "left").select("finding_id", F.when(F.col("s") >= 0.65, "name_drift").otherwise("unknown_finding").alias("issue"))
    return bad.unionByName(exact.select("finding_id", F.explode(issues).alias("issue"))).unionByName(drift)


def witness(trace: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, events, head, report_sha, witness_sha): a self-hashing proof of
    a chain and its report (``reports`` has run_id and JSON ``report``)."""
    from loomstone.operators.trace import verify_chains

    heads = trace.groupBy("run_id").agg(F.max_by(F.get_json_object("raw", "$.hash"), "seq").alias("head"))
    rows = verify_chains(trace).join(heads, "run_id").join(reports.select("run_id", canonical_digest("report").alias("report_sha")), "run_id")
    body = F.to_json(F.struct("events", "head", "ok", "report_sha", "run_id"))
    return rows.select("run_id", "events", "ok", "head", "report_sha", canonical_digest(body).alias("witness_sha"))


def verify_witness(witnesses: DataFrame, trace: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, issue): what of a witness no longer holds."""
    now = witness(trace, reports).select("run_id", *[F.col(c).alias(f"n_{c}") for c in ("events", "head", "report_sha", "witness_sha")])
    rows = witnesses.join(now, "run_id", "left")
    issues = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in ("events", "head", "report_sha", "witness_sha")]))
    return rows.select("run_id", F.explode(issues).alias("issue"))


def change_stats(edits: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, added, removed, bytes): line differences of edits, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, a, b in pdf.itertuples(index=False):
                left, right = (a or "").splitlines(), (b or "").splitlines()
                codes = difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
                added = sum(j2 - j1 for op, _, _, j1, j2 in codes if op != "equal")
                removed = sum(i2 - i1 for op, i1, i2, _, _ in codes if op != "equal")
                out.append((k, added, removed, len((b or "").encode("utf-8"))))
            yield pd.DataFrame(out, columns=[key, "added", "removed", "bytes"])

    return edits.select(F.col(key).cast("long"), F.col(old), F.col(new)).mapInPandas(run, f"{key} long, added long, removed long, bytes long")


def session_key(session: Column, cwd: Column, day: Column) -> Column:
    """The session's id, or one from its folder and day."""
    made = F.concat(F.lit("session-"), F.substring(F.sha2(F.coalesce(cwd, F.lit("")), 256), 1, 12), F.lit("-"), F.date_format(day, "yyyyMMdd"))
    return F.when(F.length(F.trim(session)) > 0, session).otherwise(made)


def split_tool(tool: Column, servers: list[str]) -> Column:
    """(server, tool, exact) of a server tool's id; the longest server wins."""
    rest = F.regexp_replace(tool, "^mcp_", "")
    cases = [F.when(rest.startswith(s + "_") & (F.length(rest) > len(s) + 1), F.lit(s)) for s in sorted(servers, key=len, reverse=True)]
    server = F.coalesce(*cases)
    exact = (F.length(tool) < 64) & ~tool.rlike(r"_\d+$")
    return F.when(tool.startswith("mcp_") & server.isNotNull(), F.struct(server.alias("server"), rest.substr(F.length(server) + 2, F.length(rest)).alias("tool"), exact.alias("exact")))


# Escapes that JSON knows, words that are values.
_ESCAPES = '"\\/bfnrt'
_WORD = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def closed_json(text: str) -> str | None:
    """The longest readable beginning of ``text`` as JSON, closed where it was
    cut off, in one pass; null if nothing in it can be read.

    A string value that was cut keeps what there is of it, a key without its
    value is dropped, as is a number or word that isn't whole."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    closers: list[str] = []
    sound, i, n = start, start, len(text)  # all before ``sound`` reads well once closed
    tail, value_next = "", False
    while i < n:
        c = text[i]
        if c in "{[":
            closers.append("}" if c == "{" else "]")
            i += 1
            sound, value_next = i, c == "["
        elif c in "}]":
            if not closers or closers[-1] != c:
                break
            closers.pop()
            i += 1
            sound, value_next = i, False
            if not closers:
                break
        elif c == '"':
            j, good = i + 1, i + 1
            while j < n and text[j] != '"':
                if text[j] == "\\":
                    step = 6 if text[j + 1 : j + 2] == "u" else 2
                    if j + step > n or (step == 2 and text[j + 1] not in _ESCAPES):
                        break
                    j += step
                else:
                    j += 1
                good = j
            whole = j < n and text[j] == '"'
            if value_next:
                sound, tail = (j + 1, "") if whole else (good, '"')
            if not whole:
                break
            i, value_next = j + 1, False
        elif c in ":,":
            value_next = c == ":" or (bool(closers) and closers[-1] == "]")
            i += 1
        elif c.isspace():
            i += 1
        else:
            j = i
            while j < n and text[j] not in ',:{}[]"' and not text[j].isspace():
                j += 1
            word = text[i:j]
            if not value_next or not _WORD.fullmatch(word):
                break
            sound, i, value_next = j, j, False
    body = text[start:sound] + tail + "".join(reversed(closers))
    try:
        return json.dumps(json.loads(body, strict=False), sort_keys=True)
    except ValueError:
        return None


def repair_json(raw: pd.Series) -> pd.Series:
    """Cut-off JSON closed again; code fences around it are dropped.  Use with
    ``F.pandas_udf``."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        if "```" in text:
            text = text.split("```")[1].removeprefix("json")
        return closed_json(text)

    return raw.map(one)


# Names of secret fields, shapes of secrets besides those of
# ``audit``, marks and bounds of what is left out.
SECRET_KEY = r"(?i)(pass(word|wd)?|secret|token|api[_-]?key|authorization|credential|private[_-]?key|cookie)"
PROMPT_KEY = r"(?i)^(user[_-]?)?prompt$"
SECRET_SHAPES = [
    ("anthropic_key", r"\bsk-ant-[0-9A-Za-z_-]{16,}"),
    ("openai_style_key", r"\bsk-(?:proj-)?[0-9A-Za-z_-]{20,}"),
    ("github_pat", r"\bgithub_pat_[0-9A-Za-z_]{20,}"),
    ("jwt", r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
]
DEPTH, ENTRIES, CHARS = 20, 200, 4000


def fingerprinted(text: str) -> str:
    """``text`` with everything that has the shape of a secret replaced by its
    class and fingerprint."""
    for cls, shape in _shapes():
        text = shape.sub(lambda m, c=cls: f"<REDACTED:{c} fp:{hashlib.sha256(m[0].encode()).hexdigest()[:12]}>", text)
    return text


@lru_cache(maxsize=1)
def _shapes() -> list[tuple[str, re.Pattern]]:
    from loomstone.operators.audit import DETECT, REDACT

    return [(cls, re.compile(shape)) for cls, shape in [*REDACT, *DETECT, *SECRET_SHAPES]]


def without_secrets(document: object, prompts: bool = True) -> object:
    """A JSON document fit to be kept, changed in place level by level."""
    secret, prompt = re.compile(SECRET_KEY), re.compile(PROMPT_KEY)
    holder = [document]
    level: list[tuple] = [(holder, 0)]
    depth = 0
    while level:
        below: list[tuple] = []
        for box, at in level:
            item = box[at]
            if depth > DEPTH:
                box[at] = "<TRUNCATED:depth>"
            elif isinstance(item, str):
                text = fingerprinted(item)
                box[at] = text if len(text) <= CHARS else f"{text[:CHARS]}...<TRUNCATED:{len(text)} chars>"
            elif isinstance(item, list):
                del item[ENTRIES:]
                below += [(item, i) for i in range(len(item))]
            elif isinstance(item, dict):
                for name, inner in item.items():
                    plain = not isinstance(inner, (dict, list))
                    if plain and secret.search(name):
                        item[name] = "<REDACTED:key>"
                    elif isinstance(inner, str) and not prompts and prompt.match(name):
                        item[name] = f"<OMITTED:prompt {len(inner)} chars>"
                    else:
                        below.append((item, name))
        level, depth = below, depth + 1
    return holder[0]


def _redacted(raw: pd.Series, prompts: bool) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(without_secrets(json.loads(text), prompts), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return raw.map(one)


def redact_json(raw: pd.Series) -> pd.Series:
    """JSON documents ``without_secrets``; null where one can't be read.  Use
    with ``F.pandas_udf``."""
    return _redacted(raw, True)


def redact_json_and_prompts(raw: pd.Series) -> pd.Series:
    """The same, and without what users asked."""
    return _redacted(raw, False)
