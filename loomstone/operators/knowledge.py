"""Documents to blocks, types, topics and a graph across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell institutions, venues, structure and generic terms.
INSTITUTION = ("university", "institute", "school", "college", "department", "faculty", "laboratory", "centre", "center", "hospital", "corporation", "inc", "ltd", "gmbh", "polytechnic", "polytechnical", "academy", "research center", "research centre", "national lab")
VENUE = ("journal", "proceedings", "conference", "symposium", "transactions", "letters", "ieee", "acm", "springer", "workshop", "annual meeting")
STRUCTURE = (
    "figure", "figure caption", "caption", "header", "footer", "paragraph", "abstract", "section", "subsection", "title", "table", "equation", "citation", "reference", "bibliography", "author", "date", "keyword", "metadata", "page header", "page footer",
    "volume information", "mathematical expression", "mathematical bracket", "author biography", "affiliations", "contact", "acknowledgments", "introduction", "conclusion", "related work", "background", "methodology", "methods", "results", "discussion", "evaluation", "experimental", "experiment", "future work",
)
GENERIC = (
    "this", "that", "with", "from", "have", "been", "their", "which", "also", "more", "than", "into", "each", "such", "only", "other", "some", "these", "those", "over", "many", "most", "both", "does", "used", "using", "based", "however", "results", "experimental", "international", "introduction", "related", "conclusion", "nature",
    "conference", "proceedings", "references", "abstract", "proposed", "machine", "neural", "network", "networks", "learning", "training", "computer", "vision", "language", "intelligence", "artificial", "analysis", "system", "systems", "performance", "algorithm", "knowledge", "information", "processing", "research",
)
# Document signals (pattern over the first 30 blocks, type, weight).
DOI = r"10\.\d{4,}/[\w\.\-/]+"
# Capitalized phrases, names inside a sentence, acronyms.
PHRASE = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"
INNER_NAME = r"[\p{Ll},;:] (\p{Lu}\p{Ll}{3,}(?: \p{Lu}\p{Ll}+)*)"
ACRONYM = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9]{2,4})(?:[^\p{L}\p{N}_]|$)"
EMAIL = r"[\w\.\-]+@[\w\.\-]+\.\w+"


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, block, n, text): the non-blank lines of each text in order."""
    lines = F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: F.length(F.trim(x)) > 0)
    rows = documents.where("text is not null").select("doc_id", lines.alias("l"))
    return rows.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("block", "text")).select("doc_id", "block", "n", F.trim("text").alias("text"))


def signals(blk: DataFrame) -> DataFrame:
    """One row for each document: the signals its blocks give off."""
    t, low, b = F.col("text"), F.lower("text"), F.col("block")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    return blk.groupBy("doc_id").agg(
        any_((b < 30) & (t.rlike(DOI) | low.contains("arxiv"))).alias("doi"),
        any_((b < 15) & low.startswith("abstract")).alias("abstract"),
        any_((b >= F.floor(F.col("n") * 0.7)) & low.isin("references", "bibliography", "works cited")).alias("references"),
        any_((b < 10) & t.rlike(r"^[A-Z]{3,}\s*[,\-]\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)")).alias("dateline"),
        any_((b < 10) & (t.rlike(r"^By\s+[A-Z][a-z]+\s+[A-Z][a-z]+") | t.rlike("(AP|Reuters|AFP|UPI)\\s*[-–—]"))).alias("byline"),
        any_((b < 30) & low.rlike("columns:|schema:|csv|json|dataset description")).alias("dataset"),
        (F.sum(t.rlike(r"\(\d+\)\s*$").cast("int")) + F.sum(t.rlike(r"\\[a-z]+\{").cast("int"))).alias("equations"),
    )


def classify(sig: DataFrame) -> DataFrame:
    """(doc_id, doc_type, confidence): the strongest signal, the first of equals."""
    rules = [("doi", "scientific_paper", 0.9), ("abstract", "scientific_paper", 0.7), ("references", "scientific_paper", 0.6), ("dateline", "news_article", 0.8), ("byline", "news_article", 0.7), ("dataset", "dataset_readme", 0.7)]
    cases = [F.when(F.col(c), F.struct(F.lit(w).alias("w"), F.lit(-i).alias("i"), F.lit(k).alias("k"))) for i, (c, k, w) in enumerate(rules)]
    cases.append(F.when(F.col("equations") > 3, F.struct(F.lit(0.5).alias("w"), F.lit(-9).alias("i"), F.lit("scientific_paper").alias("k"))))
    best = F.array_max(F.array_compact(F.array(*cases)))
    return sig.select("doc_id", F.coalesce(best["k"], F.lit("generic")).alias("doc_type"), F.coalesce(best["w"], F.lit(0.3)).alias("confidence"))


def sections(blk: DataFrame) -> DataFrame:
    """(doc_id, block, kind, section): headings, lists, quotes and paragraphs,
    each under the last heading above it."""
    t = F.col("text")
    kind = (
        F.when(t.rlike(r"^#{1,6}\s|^==+\s"), "heading").when(t.rlike(r"^\s*([-*•]|\d+[.)])\s"), "item").when(t.rlike("^```"), "code")
        .when(t.rlike("^>"), "quote").when(t.rlike(r"^(?i)tags?:"), "tags").otherwise("paragraph")
    )
    rows = blk.withColumn("kind", kind)
    above = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "block", "kind", F.last(F.when(F.col("kind") == "heading", F.regexp_replace("text", r"^[#=]+\s*", "")), ignorenulls=True).over(above).alias("section"))


def topic_index(documents: DataFrame) -> DataFrame:
    """(topic, doc_id, source): capitalized phrases of two words and more."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(PHRASE), 1), F.lower))
    return documents.where("text is not null").select(F.explode(found).alias("topic"), "doc_id", "source")


def entity_index(documents: DataFrame) -> DataFrame:
    """(entity, doc_id, source): names that begin inside a sentence."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(INNER_NAME), 1))
    acronyms = F.regexp_extract_all("text", F.lit(ACRONYM), 1)
    return documents.where("text is not null").select(F.explode(F.array_union(found, acronyms)).alias("entity"), "doc_id", "source")


def cross_links(index: DataFrame, key: str = "entity") -> DataFrame:
    """(source_a, source_b, links): how many keys two sources share.

    Keys collapse to distinct (key, source) first, so a pair of sources meets
    once for each key whatever the number of documents."""
    per = index.where("source is not null").groupBy(key, "source").agg(F.min("doc_id").alias("first"))
    sources = per.groupBy(key).agg(F.array_sort(F.collect_list("source")).alias("s")).where(F.size("s") > 1)
    pairs = sources.select(key, F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))).alias("p"))
    return pairs.groupBy("p.source_a", "p.source_b").agg(F.count("*").alias("links"))


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


def themes(index: DataFrame, top: int = 10) -> DataFrame:
    """(topic, documents, sources): the topics most documents name, of two
    sources at least, without institutions, venues and generic terms."""
    t = F.col("topic")
    rows = index.groupBy("topic").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("source").alias("sources"))
    rows = rows.where(~_has(t, INSTITUTION) & ~_has(t, VENUE) & ~F.lower(t).isin(*GENERIC) & ((F.length(t) >= 6) | t.contains(" ")) & (F.col("sources") >= 2))
    return rows.orderBy(F.desc("documents"), "topic").limit(top)


def topic_quality(index: DataFrame) -> DataFrame:
    """(topic, count, verdict): ``good`` or the first reason it is noise."""
    t = F.lower(F.trim("topic"))
    rows = index.groupBy("topic").agg(F.count("*").alias("count"))
    verdict = (
        F.when(t.isin(*STRUCTURE), "structural term").when(_has(t, INSTITUTION) | _has(t, VENUE), "institutional/venue name").when(F.length(t) < 3, "too short")
        .when(t.rlike(r"^\d+$"), "numeric only").when(~t.contains(" ") & (F.length(t) < 6), "short single word").otherwise("good")
    )
    return rows.withColumn("verdict", verdict)


def entity_quality(index: DataFrame) -> DataFrame:
    """(class, entities, mentions) of acronyms, proper names and the rest."""
    e = F.col("entity")
    rows = index.groupBy("entity").agg(F.count("*").alias("n"))
    kind = F.when(e.rlike(r"^[A-Z0-9]*[A-Z][A-Z0-9]*$") & F.length(e).between(2, 6), "acronym").when(e.contains(" ") & e.rlike("^[A-Z]"), "proper name").otherwise("other")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("entities"), F.sum("n").alias("mentions"))


def captions(images: DataFrame, blk: DataFrame, below: float = 100, above: float = 100, penalty: float = 200) -> DataFrame:
    """(image_id, text): an image's caption on its page: the nearest one within
    ``below`` under it or ``above`` over it, one above counting as ``penalty``
    (``below`` at least) further away; else the nearest on the page, wherever it
    stands.  Of equally near ones the upper, then the first by text.

    ``images`` has image_id, page, y0, y1; ``blk`` page, y0, y1, text.  Images
    and captions of a page are sorted once for each way in which one can be the
    nearest, so they never meet pair by pair; each place is looked up once."""
    marks = blk.where(F.col("page").isNotNull() & F.col("text").rlike(r"(?i)^(fig(ure)?|table)\.?\s*\d"))
    marks = marks.groupBy("page", F.col("y0").alias("b0"), F.col("y1").alias("b1")).agg(F.min("text").alias("text"))
    places = images.where("page is not null").select("page", "y0", "y1").distinct()

    def sides(top: str, bottom: str, under: Column, over: Column, blank: Column, every: Column) -> Column:
        """(way, at) of a box, in the order in which the nearest one comes last."""
        middle = (F.col(top) + F.col(bottom)) / 2
        at = [-under.cast("double"), over.cast("double"), middle.cast("double"), -middle.cast("double"), F.when(every, 0.0), F.when(blank, 0.0)]
        ways = F.array(*[F.struct(F.lit(i).alias("way"), x.alias("at")) for i, x in enumerate(at)])
        return F.explode(F.filter(ways, lambda w: w["at"].isNotNull()))

    # The last two ways: boxes without a place are as far from all.
    bare = lambda top, bottom: F.col(top).isNull() | F.col(bottom).isNull()
    box = F.struct("b0", "b1", "text")
    left = marks.select("page", sides("b0", "b1", F.col("b0"), F.col("b1"), bare("b0", "b1"), F.lit(True)).alias("w"), box.alias("mark"))
    right = places.select("page", sides("y0", "y1", F.col("y1"), F.col("y0"), F.lit(True), bare("y0", "y1")).alias("w"), F.struct("y0", "y1").alias("place"))
    rows = left.unionByName(right, allowMissingColumns=True).select("page", "w.*", "mark", "place")
    nearest = Window.partitionBy("page", "way").orderBy(F.asc("at"), F.col("place").isNotNull(), F.desc_nulls_last("mark.b0"), F.desc("mark.text"))
    met = rows.withColumn("mark", F.last("mark", ignorenulls=True).over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.where("place is not null and mark is not null").select("page", "place.*", "mark.*")

    under, over = F.col("b0") - F.col("y1"), F.col("y0") - F.col("b1")
    gap = F.when((under >= 0) & (under < below), under).when((over >= 0) & (over < above), over + penalty)
    away = F.abs((F.col("b0") + F.col("b1")) / 2 - (F.col("y0") + F.col("y1")) / 2)
    key = F.struct(gap.isNull().alias("far"), F.coalesce(gap, away).alias("gap"), "b0", "text")
    best = met.groupBy(F.col("page").alias("_p"), F.col("y0").alias("_0"), F.col("y1").alias("_1")).agg(F.min(key).alias("_k"))
    same = (F.col("page") == F.col("_p")) & F.col("y0").eqNullSafe(F.col("_0")) & F.col("y1").eqNullSafe(F.col("_1"))
    found = images.join(best, same).select("image_id", F.col("_k").alias("key"))
    return found.groupBy("image_id").agg(F.min("key")["text"].alias("text"))
