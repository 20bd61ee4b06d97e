"""Queries over text, graphs, audits, retrieval, evaluation and plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators import audit, evaluation, extract, knowledge, search
from loomstone.session import table

AS_OF = "2024-10-01T00:00:00Z"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of six kinds about customers, one conversation per nation."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 6
    seg = F.lower("c_mktsegment")
    text = (
        F.when(k == 0, F.concat(F.lit("We decided to use "), seg, F.lit(" because key "), "c_custkey", F.lit(" asked."))).when(k == 1, F.concat(F.lit("Always check account "), "c_custkey", F.lit(".")))
        .when(k == 2, F.concat(F.lit("Anna's segment is "), seg)).when(k == 3, F.concat(F.lit("I prefer "), seg, F.lit(" lists.")))
        .when(k == 4, F.concat(F.lit("Never mix "), seg, F.lit(" and account "), "c_custkey")).otherwise(F.concat(F.lit("Nothing to note on "), "c_custkey"))
    )
    return c.select(F.col("c_nationkey").alias("conv"), F.col("c_custkey").alias("turn"), text.alias("text"))


def conv_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.conversation_atoms(_messages(spark, d), "conv", "turn", "text").select("conv", "turn", "kind", "entity", "key", "value")


def decay_classes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "shard_atoms")
    return a.select("atom_id", extract.decay_class(F.col("text"), F.col("kind"), F.col("key")).alias("decay"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return extract.chunks(table(spark, d, "documents"), "doc_id", "text", 800, 200).select("doc_id", "chunk", F.length("text").alias("chars"))


def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of shards' first five places confirmed by a second, later pass."""
    a = table(spark, d, "shard_atoms")
    return extract.consensus(a.where("pos < 5"), a.where("pos >= 5")).select("atom_id", "votes")


def doc_signals(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.signals(knowledge.blocks(table(spark, d, "documents")))


def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.classify(doc_signals(spark, d))


def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.sections(knowledge.blocks(table(spark, d, "documents"))).groupBy("kind").agg(F.count("*").alias("blocks"), F.countDistinct("section").alias("sections"))


def topic_index(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.topic_index(table(spark, d, "documents"))


def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.entity_index(table(spark, d, "documents")).groupBy("entity").agg(F.count("*").alias("documents"))


def cross_links(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.cross_links(knowledge.entity_index(table(spark, d, "documents")))


def key_themes(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.themes(knowledge.topic_index(table(spark, d, "documents")))


def topic_quality(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.topic_quality(knowledge.topic_index(table(spark, d, "documents")))


def entity_quality(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.entity_quality(knowledge.entity_index(table(spark, d, "documents")))


def atom_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shard_atoms").groupBy("kind").agg(F.count("*").alias("atoms"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _leaky(spark: SparkSession, d: str) -> DataFrame:
    """Notes into which secrets were put, each shape in turn."""
    o = table(spark, d, "orders")
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    k = F.col("o_orderkey") % 5
    secret = (
        F.when(k == 0, F.concat(F.lit("AIza"), F.substring(h, 1, 35))).when(k == 1, F.concat(F.lit("https://"), F.substring(h, 1, 8), F.lit(".firebaseio.com/x")))
        .when(k == 2, F.concat(F.lit("ghp_"), F.substring(h, 1, 36))).when(k == 3, F.concat(F.substring(h, 1, 6), F.lit(".execute-api.eu-west-1.amazonaws.com/dev"))).otherwise(F.lit("nothing"))
    )
    return o.select("o_orderkey", F.concat(F.lit("order uses "), secret, F.lit(" twice: "), secret, F.lit(" end")).alias("note"))


def redact_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _leaky(spark, d).select("o_orderkey", audit.scrub(F.col("note")).alias("note"))


def residual_scan(spark: SparkSession, d: str) -> DataFrame:
    return audit.residual_scan(redact_tokens(spark, d), "o_orderkey", "note")


def key_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(audit.entropy(F.col("p_name")), 6).alias("bits"))


def verify_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Which sentences of the held-out passages stand in the documents."""
    said = F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(r"([^.!?]+[.!?])"), 1), lambda x: F.trim(x)))
    e = table(spark, d, "eval_items").where("text is not null").select("item_id", said.alias("sentence", "evidence")).where("evidence != ''")
    e = e.select(F.concat_ws(":", "item_id", "sentence").alias("id"), "evidence")
    return audit.verify_evidence(e, table(spark, d, "documents").select("text"), "id", "text")


def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as images and captions on pages by brand, placed by their sizes."""
    p = table(spark, d, "part")
    place = (F.col("p_size") * 20).cast("double")
    images = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("page"), place.alias("y0"), (place + 50).alias("y1"))
    blk = p.where("p_partkey % 5 = 1").select(F.col("p_brand").alias("page"), (place + 7).alias("y0"), (place + 17).alias("y1"), F.concat(F.lit("Figure "), "p_partkey", F.lit(" at "), "p_size").alias("text"))
    return knowledge.captions(images, blk).select("image_id", F.regexp_extract("text", " at (.*)", 1).cast("int").alias("size"))


def vocab_drift(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("shard", "known", "snapshot"), ("shard", "invented", "record"), ("token", "deferred", "key"), ("trace", "known", "log")], "term string, category string, alias string")
    return audit.vocabulary_drift(table(spark, d, "documents").where("text is not null"), "doc_id", "text", terms)


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    rows = search.keyword_search(table(spark, d, "documents"), "doc_id", "text", q)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 20, among all."""
    v = table(spark, d, "embeddings")
    rows = search.vector_topk(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return rows.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def check_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return search.duplicates_of(vector_topk(spark, d), 0.3)


def triples_as_of(spark: SparkSession, d: str) -> DataFrame:
    return search.triples_as_of(table(spark, d, "triples"), AS_OF).select("triple_id", "subject", "predicate", "object")


def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples")
    return t.groupBy("predicate").agg(F.count("*").alias("triples"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "person_entities").where("entity_type = 'person'")
    m = evaluation.mutations(p, "entity_id", ["last_name", "first_name"])
    rows = p.select("entity_id", F.col("last_name").alias("a"), F.col("first_name").alias("b")).join(m, "entity_id")
    score = evaluation.jaccard(evaluation.token_set(F.col("a"), F.col("b")), evaluation.token_set(F.col("last_name"), F.col("first_name")))
    return rows.select("entity_id", "family", "same", score.alias("score"))


def jaccard_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(_judged(spark, d).withColumn("hit", F.col("score") >= 0.8), ["family"], "hit", "same")


def tier_calibration(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("score") >= 0.8, "match").when(F.col("score") > 0, "partial").otherwise("none")
    return evaluation.calibration(_judged(spark, d).withColumn("tier", tier), "tier", "score", "same")


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.threshold_sweep(_judged(spark, d), "score", "same", [0.25, 0.5, 0.75, 1.0])


def recall_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Whether a vector's neighbours bear its label, per query."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    ranked = vector_topk(spark, d).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    ranked = ranked.withColumn("relevant", (F.col("label") == F.col("own")).cast("int"))
    totals = v.groupBy("label").agg((F.count("*") - 1).alias("total")).join(v, "label").select(F.col("vec_id").alias("query_id"), "total")
    return evaluation.ranking_scores(ranked, "query_id", "rank", "relevant", totals)


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n "
        "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
    )


def region_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events no more than half an hour apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)))
    e = e.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1_800_000_000), 1).otherwise(0)).over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type (the streaming twin is in ``streaming``)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return e.select(F.unix_seconds("w.start").alias("hour"), "event_type", "events")


QUERIES = {f.__name__: f for f in (conv_extract, decay_classes, chunk_overlap, consensus_vote, doc_signals, doc_classify, doc_sections, topic_index, entity_index, cross_links, key_themes, topic_quality, entity_quality, atom_kinds, redact_tokens, residual_scan, key_entropy, verify_evidence, figure_captions, vocab_drift, keyword_search, vector_topk, check_duplicate, triples_as_of, entity_stats, jaccard_accuracy, tier_calibration, threshold_sweep, recall_ndcg, pricing_summary, region_revenue, sessions, event_windows)}

_MSG = "m AS (SELECT c_nationkey AS conv, c_custkey AS turn, lower(c_mktsegment) AS seg, c_custkey % 6 AS k FROM customer)"
_DOC = "b AS (SELECT doc_id, len(l) AS n, unnest(range(len(l))) AS block, trim(unnest(l), ' ') AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: length(trim(x, ' ')) > 0) AS l FROM documents WHERE text IS NOT NULL))"
_SIG = f"{_DOC}, g AS (SELECT doc_id, bool_or(block < 30 AND (regexp_matches(text, '10\\.\\d{{4,}}/[\\w\\.\\-/]+') OR contains(lower(text), 'arxiv'))) AS doi, bool_or(block < 15 AND starts_with(lower(text), 'abstract')) AS abstract, bool_or(block >= floor(n * 0.7) AND lower(text) IN ('references', 'bibliography', 'works cited')) AS \"references\", bool_or(block < 10 AND regexp_matches(text, '^[A-Z]{{3,}}\\s*[,\\-]\\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)')) AS dateline, bool_or(block < 10 AND (regexp_matches(text, '^By\\s+[A-Z][a-z]+\\s+[A-Z][a-z]+') OR regexp_matches(text, '(AP|Reuters|AFP|UPI)\\s*[-–—]'))) AS byline, bool_or(block < 30 AND regexp_matches(lower(text), 'columns:|schema:|csv|json|dataset description')) AS dataset, CAST(sum(CASE WHEN regexp_matches(text, '\\(\\d+\\)\\s*$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\\\[a-z]+\\{{') THEN 1 ELSE 0 END) AS BIGINT) AS equations FROM b GROUP BY 1)"
_TOPIC = "t AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '" + knowledge.PHRASE + "', 1), lambda x: lower(x))) AS topic, doc_id, source FROM documents WHERE text IS NOT NULL)"
_ENT = "t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '" + knowledge.INNER_NAME + "', 1) || regexp_extract_all(text, '" + knowledge.ACRONYM + "', 1)) AS entity, doc_id, source FROM documents WHERE text IS NOT NULL)"
_BAD = lambda words: "regexp_matches(lower(topic), '" + "|".join(words) + "')"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_NOTE = "x AS (SELECT o_orderkey, o_orderkey % 5 AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)"
_SECRET = "CASE k WHEN 0 THEN 'AIza' || substr(h, 1, 35) WHEN 1 THEN 'https://' || substr(h, 1, 8) || '.firebaseio.com/x' WHEN 2 THEN 'ghp_' || substr(h, 1, 36) WHEN 3 THEN substr(h, 1, 6) || '.execute-api.eu-west-1.amazonaws.com/dev' ELSE 'nothing' END"
_TOKEN = f"CASE k WHEN 0 THEN '<REDACTED:google_api_key fp:' || substr(sha256({_SECRET}), 1, 12) || '>' WHEN 1 THEN '<REDACTED:firebase_rtdb fp:' || substr(sha256({_SECRET}), 1, 12) || '>' WHEN 3 THEN '<REDACTED:aws_api_gateway fp:' || substr(sha256({_SECRET}), 1, 12) || '>' ELSE {_SECRET} END"
_COS = "s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), k AS (SELECT query_id, vec_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"
_INST = lambda c: f"CASE WHEN length({c}) = 10 THEN CAST({c} || 'T00:00:00Z' AS TIMESTAMPTZ) ELSE CAST({c} AS TIMESTAMPTZ) END"
_TS = lambda a, b: f"list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', {a}, {b})), '\\s+'), lambda w: w <> ''))"
_JUDGE = "p AS (SELECT * FROM person_entities WHERE entity_type = 'person'), m AS (" + " UNION ALL ".join(
    f"SELECT entity_id, '{n}' AS family, {s} AS same, last_name AS a, first_name AS b, {e.format('last_name')} AS l, {e.format('first_name')} AS f FROM p"
    for n, s, e in [
        ("case", "true", "upper({0})"), ("whitespace", "true", "'  ' || replace({0}, ' ', '   ') || ' '"), ("typo_substitution", "true", "substr({0}, 1, 2) || 'x' || substr({0}, 4)"),
        ("typo_insertion", "true", "substr({0}, 1, 2) || 'q' || substr({0}, 3)"), ("unicode_normalization", "true", "strip_accents({0})"), ("negative_control", "false", "reverse({0})"), ("garbled_all_fields", "false", "substr(sha256({0}), 1, 8)"),
    ]
) + f"), j AS (SELECT entity_id, family, same, {_TS('a', 'b')} AS x, {_TS('l', 'f')} AS y FROM m), d AS (SELECT *, CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END AS score FROM j)"

SQL = {
    "conv_extract": f"WITH {_MSG} SELECT conv, turn, kind, entity, key, value FROM (SELECT conv, turn, 'decision' AS kind, 'decision' AS entity, seg AS key, 'key ' || turn || ' asked' AS value, CAST(turn AS VARCHAR) AS u FROM m WHERE k = 0 UNION ALL SELECT conv, turn, 'convention', 'convention', 'check account ' || turn, 'always', CAST(turn AS VARCHAR) FROM m WHERE k = 1 UNION ALL SELECT conv, turn, 'fact', 'Anna', 'segment', seg, seg FROM m WHERE k = 2 UNION ALL SELECT conv, turn, 'preference', 'user', 'prefer', seg || ' lists', seg FROM m WHERE k = 3 UNION ALL SELECT conv, turn, 'convention', 'convention', 'mix ' || seg || ' and account ' || turn, 'never', CAST(turn AS VARCHAR) FROM m WHERE k = 4) QUALIFY row_number() OVER (PARTITION BY conv, kind, key, value, u ORDER BY turn) = 1",
    "decay_classes": "SELECT atom_id, CASE WHEN kind IN ('decision', 'convention') OR regexp_matches(lower(coalesce(key, '')), '" + "|".join(extract.LASTING) + "') THEN 'permanent' WHEN regexp_matches(lower(coalesce(text, '')), '" + "|".join(extract.SESSION) + "') OR regexp_matches(lower(coalesce(key, '')), '" + "|".join(extract.SESSION) + "') THEN 'session' WHEN regexp_matches(lower(coalesce(text, '')), '" + "|".join(extract.ACTIVE) + "') OR regexp_matches(lower(coalesce(key, '')), '" + "|".join(extract.ACTIVE) + "') THEN 'active' WHEN kind = 'checkpoint' THEN 'checkpoint' ELSE 'stable' END AS decay FROM shard_atoms",
    "doc_signals": f"WITH {_SIG} SELECT * FROM g",
    "doc_classify": f"WITH {_SIG} SELECT doc_id, CASE WHEN doi THEN 'scientific_paper' WHEN dateline THEN 'news_article' WHEN abstract THEN 'scientific_paper' WHEN byline THEN 'news_article' WHEN dataset THEN 'dataset_readme' WHEN \"references\" OR equations > 3 THEN 'scientific_paper' ELSE 'generic' END AS doc_type, CASE WHEN doi THEN 0.9 WHEN dateline THEN 0.8 WHEN abstract OR byline OR dataset THEN 0.7 WHEN \"references\" THEN 0.6 WHEN equations > 3 THEN 0.5 ELSE 0.3 END AS confidence FROM g",
    "topic_index": f"WITH {_TOPIC} SELECT * FROM t",
    "entity_index": f"WITH {_ENT} SELECT entity, count(*) AS documents FROM t GROUP BY 1",
    "cross_links": f"WITH {_ENT}, u AS (SELECT DISTINCT entity, source FROM t WHERE source IS NOT NULL) SELECT a.source AS source_a, b.source AS source_b, count(*) AS links FROM u a JOIN u b ON a.entity = b.entity AND a.source < b.source GROUP BY 1, 2",
    "key_themes": f"WITH {_TOPIC} SELECT topic, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM t WHERE NOT {_BAD(knowledge.INSTITUTION)} AND NOT {_BAD(knowledge.VENUE)} AND lower(topic) NOT IN {_IN(knowledge.GENERIC)} AND (length(topic) >= 6 OR contains(topic, ' ')) GROUP BY 1 HAVING count(DISTINCT source) >= 2 ORDER BY 2 DESC, 1 LIMIT 10",
    "topic_quality": f"WITH {_TOPIC} SELECT topic, count(*) AS count, CASE WHEN lower(trim(topic)) IN {_IN(knowledge.STRUCTURE)} THEN 'structural term' WHEN {_BAD(knowledge.INSTITUTION)} OR {_BAD(knowledge.VENUE)} THEN 'institutional/venue name' WHEN length(trim(topic)) < 3 THEN 'too short' WHEN regexp_matches(topic, '^\\d+$') THEN 'numeric only' WHEN NOT contains(topic, ' ') AND length(topic) < 6 THEN 'short single word' ELSE 'good' END AS verdict FROM t GROUP BY 1",
    "entity_quality": f"WITH {_ENT}, e AS (SELECT entity, count(*) AS n FROM t GROUP BY 1) SELECT CASE WHEN regexp_matches(entity, '^[A-Z0-9]*[A-Z][A-Z0-9]*$') AND length(entity) BETWEEN 2 AND 6 THEN 'acronym' WHEN contains(entity, ' ') AND regexp_matches(entity, '^[A-Z]') THEN 'proper name' ELSE 'other' END AS class, count(*) AS entities, CAST(sum(n) AS BIGINT) AS mentions FROM e GROUP BY 1",
    "atom_kinds": "SELECT kind, count(*) AS atoms, round(avg(confidence), 6) AS confidence FROM shard_atoms GROUP BY 1",
    "redact_tokens": f"WITH {_NOTE} SELECT o_orderkey, 'order uses ' || {_TOKEN} || ' twice: ' || {_TOKEN} || ' end' AS note FROM x",
    "residual_scan": f"WITH {_NOTE} SELECT o_orderkey, 'unhandled:github_token' AS class, {_SECRET} AS sample FROM x, range(2) WHERE k = 2",
    "key_entropy": "SELECT p_partkey, round(coalesce(-list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: (len(list_filter(string_split(p_name, ''), lambda y: y = c)) / length(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda y: y = c)) / length(p_name)))), 0), 6) AS bits FROM part",
    "verify_evidence": "WITH s AS (SELECT item_id, regexp_extract_all(text, '[^.!?]+[.!?]') AS l FROM eval_items WHERE text IS NOT NULL), e AS (SELECT item_id || ':' || unnest(range(0, len(l))) AS id, trim(unnest(l), ' ') AS s FROM s) SELECT id, EXISTS (SELECT 1 FROM documents WHERE contains(documents.text, e.s)) AS found FROM e WHERE s <> ''",
    "figure_captions": "WITH i AS (SELECT p_partkey AS k, p_brand AS page, p_size * 20.0 AS y FROM part WHERE p_partkey % 3 = 0), b AS (SELECT p_brand AS page, p_size * 20.0 + 7 AS b0, p_size FROM part WHERE p_partkey % 5 = 1), g AS (SELECT k, p_size, b0, CASE WHEN b0 >= y + 50 AND b0 - y - 50 < 100 THEN b0 - y - 50 WHEN y >= b0 + 10 AND y - b0 - 10 < 100 THEN y - b0 + 190 END AS near, abs(b0 + 5 - y - 25) AS away FROM i JOIN b USING (page)) SELECT k AS image_id, CAST(arg_min(p_size, (near IS NULL, coalesce(near, away), b0)) AS INTEGER) AS size FROM g GROUP BY 1",
    "doc_sections": """WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id), l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: length(trim(x, ' ')) > 0) AS ls FROM d),
b AS (SELECT doc_id, trim(unnest(ls), ' ') AS t, unnest(range(0, len(ls))) AS block FROM l), k AS (SELECT *, CASE WHEN regexp_matches(t, '^#{1,6}\\s|^==+\\s') THEN 'heading' WHEN regexp_matches(t, '^\\s*([-*•]|\\d+[.)])\\s') THEN 'item' WHEN starts_with(t, '```') THEN 'code'
  WHEN starts_with(t, '>') THEN 'quote' WHEN regexp_matches(lower(t), '^tags?:') THEN 'tags' ELSE 'paragraph' END AS kind FROM b),
s AS (SELECT kind, arg_max(regexp_replace(t, '^[#=]+\\s*', ''), block) FILTER (WHERE kind = 'heading') OVER (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS section FROM k)
SELECT kind, count(*) AS blocks, count(DISTINCT section) AS sections FROM s GROUP BY 1""",
    "consensus_vote": """WITH w AS (SELECT atom_id, pos, kind, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(entity, '')), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) > 2)) AS e, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(key, '')), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) > 2)) AS k FROM shard_atoms),
m AS (SELECT a.atom_id FROM w a JOIN w b ON a.kind = b.kind WHERE a.pos < 5 AND b.pos >= 5 AND (len(a.e) = 0 OR len(b.e) = 0 OR list_has_any(a.e, b.e)) AND
  CASE WHEN len(a.k) + len(b.k) = 0 THEN true ELSE len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) >= 0.4 END)
SELECT atom_id, count(*) AS votes FROM m GROUP BY 1""",
    "vocab_drift": "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_-]+', ' ', 'g')), ' ')) AS alias FROM documents WHERE text IS NOT NULL) SELECT doc_id, w.alias AS alias, term, category FROM w JOIN (VALUES ('shard', 'known', 'snapshot'), ('shard', 'invented', 'record'), ('token', 'deferred', 'key'), ('trace', 'known', 'log')) v(term, category, alias) ON w.alias = v.alias",
    "keyword_search": "WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '')) AS ws FROM eval_items), a AS (SELECT query_id, len(ws) AS n, unnest(ws) AS w FROM q), h AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT query_id, doc_id, count(*) / max(n) AS score FROM a JOIN h ON a.w = h.w WHERE h.w <> '' GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5",
    "vector_topk": f"WITH {_COS} SELECT * FROM k",
    "check_duplicate": f"WITH {_COS} SELECT query_id, vec_id, score FROM k WHERE rank = 1 AND score >= 0.3",
    "triples_as_of": f"SELECT triple_id, subject, predicate, object FROM triples WHERE (valid_from IS NULL OR trim(valid_from) = '' OR {_INST('valid_from')} <= TIMESTAMPTZ '{AS_OF}') AND (valid_to IS NULL OR trim(valid_to) = '' OR {_INST('valid_to')} > TIMESTAMPTZ '{AS_OF}')",
    "entity_stats": "SELECT predicate, count(*) AS triples, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM triples GROUP BY 1",
    "jaccard_accuracy": f"WITH {_JUDGE} SELECT family, count(*) AS pairs, round(sum(CASE WHEN score >= 0.8 AND same THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN same THEN 1 ELSE 0 END), 0), 6) AS recall, round(sum(CASE WHEN score >= 0.8 AND same THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN score >= 0.8 THEN 1 ELSE 0 END), 0), 6) AS \"precision\", round(sum(CASE WHEN score >= 0.8 AND NOT same THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN NOT same THEN 1 ELSE 0 END), 0), 6) AS false_match FROM d GROUP BY 1",
    "tier_calibration": f"WITH {_JUDGE} SELECT CASE WHEN score >= 0.8 THEN 'match' WHEN score > 0 THEN 'partial' ELSE 'none' END AS tier, count(*) AS pairs, round(avg(score), 6) AS stated, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS actual FROM d GROUP BY 1",
    "threshold_sweep": f"WITH {_JUDGE} SELECT threshold, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS caught, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS wrong FROM d JOIN (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75), (1.0)) v(threshold) ON score >= threshold GROUP BY 1",
    "recall_ndcg": f"WITH {_COS}, r AS (SELECT k.query_id, k.rank, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS rel, b.label AS own FROM k JOIN embeddings a ON a.vec_id = k.vec_id JOIN embeddings b ON b.vec_id = k.query_id), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ir FROM r) SELECT query_id, round(sum(rel) / nullif(max((SELECT count(*) - 1 FROM embeddings e WHERE e.label = own)), 0), 6) AS recall, round(CASE WHEN sum(rel / log2(ir + 1)) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ir + 1)) ELSE 0 END, 6) AS ndcg FROM i GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "region_revenue": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "sessions": "WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY 1, 2",
    "event_windows": "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
