"""Files to lines, typed blocks, zones and atoms; answers of models to atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.canonical import struct_digest
from loomstone.operators.extract import text_atoms
from loomstone.operators.knowledge import EMAIL, INSTITUTION

# Kinds of atoms, labels of blocks and what they stand for.
KINDS = ("fact", "decision", "preference", "convention", "context", "instruction")
BLOCK_TYPES = ("title", "section_header", "paragraph", "abstract", "citation", "quote", "figure", "table", "author", "date")
ALIASES = {
    "reference": "citation", "references": "citation", "bibliography": "citation", "subsection_header": "section_header", "heading": "section_header",
    "subheading": "section_header", "body_text": "paragraph", "method_description": "paragraph", "experiment_description": "paragraph",
    "results_description": "paragraph", "evaluation_description": "paragraph", "discussion": "paragraph", "introduction": "paragraph", "conclusion": "paragraph",
    "table_data": "table", "table_header": "table", "table_caption": "paragraph", "figure_caption": "paragraph", "page_footer": "citation",
    "page_header": "citation", "metadata": "citation", "authors": "author", "affiliations": "author", "contact": "author", "author_bio": "author", "date": "date",
}
# Openings of a paper's first section, titles of its references.
FIRST_SECTION = ("introduction", "1 introduction", "1. introduction", "background", "1 background", "1. background", "related work", "2 related", "2. related")
REFERENCES = ("references", "bibliography", "works cited")
BYLINE = r"^By\s+[A-Z][a-z]+"
# Zones whose blocks are metadata, by type of document.
METADATA = {
    "scientific_paper": ("biographical", "boilerplate", "back_matter"), "news_article": ("biographical", "boilerplate"), "blog_post": ("biographical", "boilerplate"),
    "dataset_readme": ("biographical", "boilerplate", "back_matter"), "generic": ("boilerplate",),
}


def memory_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): the lines of notes that may say something, headings
    aside, without emphasis and bullets, of 15 to 300 characters."""
    rows = files.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "text"))
    rows = rows.withColumn("text", F.trim("text")).where("text != '' and not startswith(text, '#')")
    clean = F.regexp_replace(F.regexp_replace("text", r"\*\*(.+?)\*\*", "$1"), "`(.+?)`", "$1")
    rows = rows.withColumn("text", F.trim(F.regexp_replace(clean, r"^\s*[-*]\s*", "")))
    return rows.where(F.length("text").between(15, 300))


def memory_atoms(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text, kind, entity, key_, value): atoms of ``memory_lines``,
    of equal ones of a file the first."""
    rows = memory_lines(files, key, text).select(key, "line", "text", F.posexplode(text_atoms(F.col("text"))).alias("pos", "a"))
    rows = rows.select(key, "line", "pos", "text", "a.kind", "a.entity", F.col("a.key").alias("key_"), "a.value")
    rows = rows.withColumn("_h", struct_digest(text=F.col("text"), kind=F.col("kind"), entity=F.col("entity"), key=F.col("key_"), value=F.col("value")))
    first = Window.partitionBy(key, "_h").orderBy("line", "pos")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_h", "pos")


def salvaged(raw: Column) -> Column:
    """A JSON array that was cut off, closed after its last whole object."""
    upto = F.length(raw) - F.locate("}", F.reverse(raw)) + 1
    cut = F.rtrim(F.substring(raw, F.lit(1), upto))
    closed = F.concat(F.regexp_replace(cut, r",\s*$", ""), F.lit("\n]"))
    return F.when(~F.contains(raw, F.lit("}")), F.lit("[]")).when(F.rtrim(raw).endswith("]"), raw).otherwise(closed)


def answer_atoms(answers: DataFrame, key: str, raw: str, least: float = 0.5) -> DataFrame:
    """(key, pos, text, kind, entity, key_, value, confidence): the atoms in a
    model's answer, a JSON array, cut off or not; those it is not sure of and
    those without text are left out, unknown kinds are context."""
    schema = "array<struct<text:string,kind:string,entity:string,key:string,value:string,confidence:double>>"
    parsed = F.from_json(F.coalesce(salvaged(F.col(raw)), F.lit("[]")), schema)
    rows = answers.select(key, F.posexplode(parsed).alias("pos", "x")).where("x is not null").select(key, "pos", "x.*")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("text", F.trim("text"))
    rows = rows.where((F.col("confidence") >= least) & (F.coalesce("text", F.lit("")) != ""))
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("context")
    return rows.select(key, "pos", "text", kind.alias("kind"), "entity", F.substring(F.coalesce("key", F.lit("")), 1, 60).alias("key_"), "value", "confidence")


def block_type(label: Column) -> Column:
    """A model's label of a block as one of ``BLOCK_TYPES``; else paragraph."""
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[label], label)
    return F.when(known.isin(*BLOCK_TYPES), known).otherwise("paragraph")


def typed_blocks(blk: DataFrame) -> DataFrame:
    """(doc_id, block, kind, importance, section): what each block is, by its
    place, size and wording, and the last header above a paragraph or quote.

    ``blk`` has doc_id, block, text, font_size and bold."""
    per, up = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    kind = (
        F.when((F.col("block") == 0) & (F.col("font_size") >= 0.9 * F.max("font_size").over(per)), "title")
        .when(F.col("bold") & (F.col("font_size") > 13) & (F.length(t) < 100), "section_header").when(F.lower(t).startswith("abstract"), "abstract")
        .when(t.rlike(r"^\[\d+\]") | t.rlike(r"^\d+\.\s+\w+.*\d{4}"), "citation").when(t.startswith('"') | t.startswith("“"), "quote").otherwise("paragraph")
    )
    weight = F.create_map(*[F.lit(x) for kv in {"title": 1.0, "section_header": 0.8, "abstract": 0.9, "citation": 0.3, "quote": 0.6, "paragraph": 0.5}.items() for x in kv])
    rows = blk.withColumn("kind", kind)
    above = F.last(F.when(F.col("kind") == "section_header", F.col("block")), ignorenulls=True).over(up)
    return rows.select("doc_id", "block", "kind", weight[F.col("kind")].alias("importance"), F.when(F.col("kind").isin("paragraph", "quote"), above).alias("section"))


def neighbours(entities: Column) -> Column:
    """Links between entities that follow each other in a block, three at most."""
    pairs = F.transform(F.sequence(F.lit(1), F.least(F.size(entities) - 1, F.lit(3))), lambda i: F.concat(F.element_at(entities, i), F.lit(" <-> "), F.element_at(entities, i + 1)))
    return F.when(F.size(entities) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def affiliation(text: Column) -> Column:
    """Whether a block names an institution or an e-mail address."""
    return F.lower(text).rlike("|".join(INSTITUTION)) | text.rlike(EMAIL)


def zones(blk: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, doc_type, ord, role, first, last): each document's zones in the
    order in which they are told.  ``blk`` has doc_id, block, n, text; ``types``
    doc_id and doc_type."""
    b, low = F.col("block"), F.lower(F.trim("text"))
    opens = low.rlike("^(" + "|".join(x.replace(".", r"\.") for x in FIRST_SECTION) + ")")
    marks = blk.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.min(F.when((b > 3) & opens, b)).alias("section"), F.max(F.when(low.isin(*REFERENCES), b)).alias("refs"),
        F.min(F.when((b < 5) & F.trim("text").rlike(BYLINE), b)).alias("byline"),
    ).join(types.select("doc_id", "doc_type"), "doc_id")
    paper, news, end = F.col("doc_type") == "scientific_paper", F.col("doc_type") == "news_article", F.col("n") - 1
    front = F.when(paper, F.least(F.coalesce("section", F.lit(10)), end)).otherwise(F.least(F.lit(2), end))
    marks = marks.withColumn("front", front).withColumn("refs", F.when(paper & (F.col("refs") > 0), F.col("refs")))
    start = F.when(paper, F.col("front") + 1).otherwise(F.least(F.lit(3), end))
    stop = F.coalesce(F.col("refs") - 1, end)
    zone = lambda o, role, a, z: F.struct(F.lit(o).cast("long").alias("ord"), F.lit(role).alias("role"), a.cast("int").alias("first"), z.cast("int").alias("last"))
    fixed = F.array_compact(F.array(
        zone(0, "front_matter", F.lit(0), F.col("front")), F.when(news & F.col("byline").isNotNull(), zone(1, "biographical", F.col("byline"), F.col("byline"))),
        F.when(start <= stop, zone(1 << 40, "body", start, stop)), F.when(F.col("refs").isNotNull(), zone((1 << 40) + 1, "back_matter", F.col("refs"), end)),
    ))
    whole = marks.select("doc_id", "doc_type", F.explode(fixed).alias("z")).select("doc_id", "doc_type", "z.*")
    people = blk.join(marks.where(paper).select("doc_id", "doc_type", "front"), "doc_id").where((b <= F.col("front")) & affiliation(F.col("text")))
    people = people.select("doc_id", "doc_type", (b + 1).cast("long").alias("ord"), F.lit("biographical").alias("role"), b.cast("int").alias("first"), b.cast("int").alias("last"))
    return whole.unionByName(people)


def block_zones(blk: DataFrame, zoned: DataFrame) -> DataFrame:
    """(doc_id, block, role, metadata): the first zone that holds each block,
    and whether its blocks are metadata there."""
    hits = blk.select("doc_id", "block").join(zoned, "doc_id").where((F.col("first") <= F.col("block")) & (F.col("block") <= F.col("last")))
    role = hits.groupBy("doc_id", "block", "doc_type").agg(F.min_by("role", "ord").alias("role"))
    cases = F.lit(False)
    for kind, roles in METADATA.items():
        cases = F.when(F.col("doc_type") == kind, F.col("role").isin(*roles)).otherwise(cases)
    return role.select("doc_id", "block", "role", cases.alias("metadata"))


def project_of(wanted: DataFrame, projects: DataFrame) -> DataFrame:
    """(query, project_id): the project a name means: its id, the first id that
    begins so, or its name in any case."""
    p = projects.select("project_id", F.col("name").alias("_n"))
    asked = wanted.select("query").distinct()
    exact = asked.join(p, F.col("query") == F.col("project_id")).select("query", "project_id", F.lit(0).alias("o"))
    named = asked.join(p, F.lower("query") == F.lower("_n")).select("query", "project_id", F.lit(2).alias("o"))
    heads = p.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("project_id")), lambda k: F.substring("project_id", F.lit(1), k))).alias("query"))
    begun = asked.join(heads, "query").select("query", "project_id", F.lit(1).alias("o"))
    return exact.unionByName(begun).unionByName(named).groupBy("query").agg(F.min_by("project_id", F.struct("o", "project_id")).alias("project_id"))
