"""The queries on training text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import TOKENIZER, mix_sources
from tidemark.llm.overlap import find_leaks
from tidemark.llm.residue import drop_residue, residue_matches
from tidemark.session import table


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a passage, or most of one in another order, with the tiling's figures."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).where(F.col("longest") >= 16).select("doc_id", "item_id").distinct()


def p6_exact(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p6_found``, without reading through foreign lines, and for items in Latin letters: what SQL can say."""
    items = table(spark, folder, "eval_items").where(_latin(F.col("passage")))
    leaks = find_leaks(table(spark, folder, "documents"), items, gap_words=0)
    return leaks.where(F.col("longest") >= 16).select("doc_id", "item_id").distinct()


def _latin(text):
    letters = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]", ""))
    return 2 * letters("a-zA-Z") >= letters("\\p{L}")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked test item is in, and the most of it that one carries."""
    return p6_leaks(spark, folder).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("longest").alias("longest"), F.round(F.max("coverage"), 6).alias("coverage"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each document with its repeats beside target and real share of its source; sources with nothing to give as rows without a document."""
    selection, shares = mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    real = shares.select("source_name", "target_share", "max_repeats", "actual_share", "falls_short")
    # One row for each target, a table of parameters: the selection stays where it is.
    chosen = selection.join(F.broadcast(real), "source_name")
    empty = shares.where(F.col("used_tokens") == 0).select(F.lit(None).cast("bigint").alias("doc_id"), "source_name", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(0).alias("repeats"), "max_repeats", "target_share", "actual_share", "falls_short")
    return chosen.select(*empty.columns).unionByName(empty).withColumn("tokenizer", F.lit(TOKENIZER))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1].withColumn("tokenizer", F.lit(TOKENIZER))


def p7_goals(spark: SparkSession, folder: str) -> DataFrame:
    """Shares to two decimals, which sources fall short, and whether the repeats are kept: what SQL can say of the mix."""
    selection, shares = mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    used = selection.groupBy("source_name").agg(F.max("repeats").alias("_most"))
    kept = F.coalesce(F.col("_most") <= F.col("max_repeats"), F.lit(True))
    return shares.join(F.broadcast(used), "source_name", "left").select("source_name", "documents", F.round("actual_share", 2).alias("share"), "falls_short", kept.alias("within_repeats"))


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    return residue_matches(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_matches(spark, folder).select("doc_id").distinct()


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without residue."""
    return drop_residue(table(spark, folder, "documents")).select("doc_id", "source", "n_chars")


QUERIES = {f.__name__: f for f in (p6_found, p6_leaks, p6_items, p6_exact, p7_mix, p7_shares, p7_goals, p8_found, p8_matches, p8_kept)}
