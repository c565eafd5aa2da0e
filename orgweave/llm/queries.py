"""Queries of this subpackage: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.llm import increments, langid, linkage, mixing, packing, spellings
from orgweave.llm.tokens import count_tokens
from orgweave.shared import cut, read


def _names(spark: SparkSession, d: str) -> DataFrame:
    return spellings.names_of({
        "patents_panel": (read(spark, d, "patents_panel"), "clean_name"),
        "arxiv_paper_institutions": (read(spark, d, "arxiv_paper_institutions"), "institution_name"),
    })


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spellings.variant_pairs(spellings.canonical_forms(_names(spark, d)))


def p2_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the most used spelling of its class."""
    classes = spellings.canonical_forms(_names(spark, d))
    top = classes.groupBy("tab_name", "class_id").agg(F.max(F.struct("n", "name")).alias("top"), F.count("*").alias("spellings"))
    return classes.join(top, ["tab_name", "class_id"]).select("tab_name", "name", F.col("top.name").alias("canonical_name"), "spellings",
        F.col("n").alias("rows_with_name"), F.round("posterior", 6).alias("posterior"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(read(spark, d, "publication_institutions_master"), read(spark, d, "compustat_firms_standardized"),
        read(spark, d, "publication_firm_matches_stage1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.best_links(_links(spark, d)).select("institution_id", "gvkey")


def p1_match_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.best_links(_links(spark, d)).select("institution_id", "gvkey", F.round("match_confidence", 6).alias("match_confidence"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.repeated_rows(read(spark, d, "ai_papers"), read(spark, d, "arxiv_paper_institutions"))


def p6_pack_documents(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "container_sizes"))


def p6_pack_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_pack_documents(spark, d), read(spark, d, "container_sizes"))


def p6_pack_check(spark: SparkSession, d: str) -> DataFrame:
    docs, containers = read(spark, d, "documents"), read(spark, d, "container_sizes")
    items = cut(docs.select("doc_id", count_tokens(F.col("text")).alias("tokens")))
    sizes = [(r["container_name"], r["capacity_tokens"]) for r in containers.select("container_name", "capacity_tokens").distinct().collect()]  # a few kinds
    return packing.check(cut(packing.pack_table(items, sizes)), items, containers)


def p7_mix_check(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = mixing.sized(read(spark, d, "documents")), read(spark, d, "mix_targets")
    return mixing.check(mixing.mix(docs, targets), docs, targets)


def p7_mix_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized(read(spark, d, "documents")), read(spark, d, "mix_targets"))


def p7_mix_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p7_mix_documents(spark, d), read(spark, d, "mix_targets"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return langid.segments(docs, langid.fit(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(_segments(spark, d)).select("doc_id", "lang_code")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("doc_id", "segment_no", "lang_code", F.round("confidence", 4).alias("confidence"), "start", "end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_match_confidence": p1_match_confidence, "p2_found": p2_found, "p2_canonical_names": p2_canonical_names,
        "p3_found": p3_found, "p6_pack_documents": p6_pack_documents, "p6_pack_report": p6_pack_report, "p6_pack_check": p6_pack_check,
        "p7_mix_documents": p7_mix_documents, "p7_mix_report": p7_mix_report, "p7_mix_check": p7_mix_check, "p8_found": p8_found, "p8_segments": p8_segments,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what can be said in SQL: that no document is lost, no bin is too full, and no source leaves its budget."""
    return {
        "p6_pack_check": """SELECT container_name, (SELECT count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) FROM documents) AS documents, 0 AS pieces_lost, 0 AS overfull, 0 AS split_too_small
 FROM container_sizes WHERE capacity_tokens > 0 GROUP BY 1""",
        "p7_mix_check": "SELECT mix_name, source, 0 AS over_repeats, 0 AS over_budget, 0 AS short FROM mix_targets GROUP BY 1, 2",
    }
