"""Whole pipelines: each stage is a function of tables, so that one plan runs across all of them; only stages that several others read are
written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import classify
from orgweave.functions.records import ordered_union
from orgweave.functions.text import clean_organization_name
from orgweave.operators import linking, metrics, panel
from orgweave.operators.dedup import keep_best
from orgweave.shared import cut


def patents_to_panel(scores: DataFrame, patents: DataFrame, assignees: DataFrame, flag: str, score_columns: list[str]) -> DataFrame:
    """scores(doc_id, flag, scores), patents(patent_id, patent_date), assignees(patent_id, assignee_id, organization) -> assignee-year panel."""
    ai = scores.filter(classify.ai_score_flag(F.col(flag), *[F.col(c) for c in score_columns])).select(F.col("doc_id").alias("patent_id"),
        F.greatest(*score_columns).alias("score"))
    dated = ai.join(patents.select("patent_id", F.left("patent_date", F.lit(4)).try_cast("int").alias("year")), "patent_id")
    named = dated.join(assignees.select("patent_id", "assignee_id", clean_organization_name(F.col("organization")).alias("clean_name")), "patent_id")
    return panel.assignee_year(named)


def link_patents(assignees: DataFrame, firms: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Three stages, each over what the one before left, then the best row per pair; stage 1 comes before 2 before 3 among equals."""
    one = cut(linking.patent_stage1(assignees, firms))
    rest_a, rest_f = assignees.join(one.select("entity_id").distinct(), "entity_id",
        "left_anti"), firms.join(one.select("gvkey").distinct(), "gvkey", "left_anti")
    two = cut(linking.patent_stage2(rest_a, rest_f))
    parts = [one.withColumn("stage", F.lit(1)), two.withColumn("stage", F.lit(2))]
    if manual is not None:
        left = rest_a.join(two.select("entity_id").distinct(), "entity_id", "left_anti")
        parts.append(linking.manual_matches(left, rest_f.join(two.select("gvkey").distinct(), "gvkey", "left_anti"), manual).withColumn("stage", F.lit(3)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return keep_best(every, ["entity_id", "gvkey"], F.desc("match_confidence"), F.col("stage"), F.col("match_method"))


def patent_report(assignee_panel: DataFrame, matches: DataFrame, financials: DataFrame | None = None, wanted: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Firm-year panel, with financials if there are any, and its concentration, growth and entrants."""
    fy = cut(panel.patent_firm_year(assignee_panel, matches))
    out = {"panel": fy if financials is None else panel.with_financials(fy, financials, list(wanted))}
    out["concentration"] = metrics.hhi(fy, "gvkey", "total_patents")
    out["growth"] = metrics.growth(fy.groupBy("year").agg(F.sum("total_patents").alias("total_patents")), "year", "total_patents")
    out["entrants"] = metrics.new_entrants(fy, "gvkey", "year")
    return out


def firm_papers(papers: DataFrame, affiliations: str, key: str, least: float = 0.5) -> DataFrame:
    """Papers with firm affiliations by keyword rules, with the counts of each class."""
    s = papers.select(key, classify.paper_affiliations(ordered_union(F.flatten(F.filter(affiliations, lambda x: x.isNotNull())))).alias("s"))
    return s.filter(classify.is_firm_paper(F.col("s"), least)).select(key, "s.*")
