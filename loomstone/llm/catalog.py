"""Queries of the training-data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import formatting, leakage, matching, mixing, names, personal, truncation
from loomstone.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    copies = formatting.copy_groups(table(spark, d, "shard_atoms"))
    return copies.select(F.col("first").alias("atom_id"), F.col("id").alias("copy_atom_id"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One atom for each statement and the number of its copies."""
    return formatting.collapse(table(spark, d, "shard_atoms"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hidden limits of each source and how many texts stop there."""
    return truncation.hidden_limits(truncation.measured_texts(table(spark, d, "documents")))


def p9_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many cut texts each step decides: those at a limit, the others."""
    return truncation.judged(table(spark, d, "documents")).groupBy("at_limit", "verdict").agg(F.count("*").alias("documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_curriculum(spark: SparkSession, d: str) -> DataFrame:
    return mixing.curriculum(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_progress(spark: SparkSession, d: str) -> DataFrame:
    """Tokens asked and given per mixture, source and tenth of training time."""
    return mixing.progress(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "name_variants"), table(spark, d, "person_entities")).select("entity_id", "variant_id")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per linked entity: how many variants and different spellings mean it."""
    typed = table(spark, d, "name_variants")
    links = names.link_names(typed, table(spark, d, "person_entities"))
    return links.join(typed.select("variant_id", "variant"), "variant_id").groupBy("entity_id").agg(
        F.count("*").alias("variants"), F.countDistinct("variant").alias("spellings")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.match(table(spark, d, "publication_entities"), table(spark, d, "publication_sightings"))
    return rows.where("entity_id is not null").select("entity_id", "sighting_id").distinct()


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every sighting with its work, if any, and the confidence."""
    rows = matching.match(table(spark, d, "publication_entities"), table(spark, d, "publication_sightings"))
    return rows.withColumn("confidence", F.round("confidence", 4))


def p1_rivalry(spark: SparkSession, d: str) -> DataFrame:
    """How much of the candidate graph is contested, and what propagation changes."""
    return matching.rivalry(table(spark, d, "publication_entities"), table(spark, d, "publication_sightings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "hook_payloads"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three fields with its items replaced by placeholders."""
    return personal.tagged(table(spark, d, "hook_payloads")).select("payload_id", "field", "redacted", F.size("items").alias("items"))


QUERIES = {"p3_found": p3_found, "p3_redacted": p3_redacted, "p1_found": p1_found, "p1_confidence": p1_confidence, "p1_rivalry": p1_rivalry, "p5_found": p5_found, "p5_groups": p5_groups, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_curriculum": p8_curriculum, "p8_progress": p8_progress, "p7_found": p7_found, "p7_items": p7_items, "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p9_found": p9_found, "p9_rates": p9_rates, "p9_limits": p9_limits, "p9_steps": p9_steps}
SQL: dict[str, str] = {}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
