"""Panels: one row per entity and year, and what is merged with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_with_null(c: str):
    """Distinct values, where null counts as one."""
    return (F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).cast("long")


def entity_year(df: DataFrame, keys: list[str], **aggregates) -> DataFrame:
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def assignee_year(patents: DataFrame) -> DataFrame:
    """patents(clean_name, year, patent_id, score, assignee_id) -> one row per name and year; assignee_id is the least."""
    return entity_year(patents.filter("clean_name is not null"), ["clean_name", "year"], total_ai_patents=F.countDistinct("patent_id"),
        avg_ai_score=F.avg("score"), assignee_id=F.min("assignee_id"))


def assignee_master(panel: DataFrame) -> DataFrame:
    """One row per assignee: totals, first and last year, mean score, number of years; the name is that of most patents (ties: the least)."""
    names = panel.groupBy("assignee_id", "clean_name").agg(F.sum("total_ai_patents").alias("n"))
    best = names.groupBy("assignee_id").agg(F.min_by("clean_name", F.struct(-F.col("n"), "clean_name")).alias("clean_name"))
    totals = panel.groupBy("assignee_id").agg(
        F.sum("total_ai_patents").alias("patent_count_total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.avg("avg_ai_score").alias("avg_ai_score_overall"), F.countDistinct("year").alias("year_count"),
    )
    return totals.filter("assignee_id is not null").join(best, "assignee_id")


def assignee_years(panel: DataFrame) -> DataFrame:
    """The distinct years of each assignee, as a sorted list."""
    return panel.filter("assignee_id is not null").groupBy("assignee_id").agg(F.sort_array(F.collect_set("year")).alias("years"))


def with_ma_columns(matches: DataFrame) -> DataFrame:
    """The columns of an adjustment for mergers that isn't made: nothing adjusted, no acquirer."""
    return matches.withColumns({"ma_adjusted": F.lit(False), "acquirer_gvkey": F.lit(None).cast("string"), "acquisition_year": F.lit(None).cast("int")})


def patent_firm_year(panel: DataFrame, matches: DataFrame) -> DataFrame:
    """Patents of matched assignees per firm and year."""
    joined = panel.join(matches.select(F.col("entity_id").alias("assignee_id"), "gvkey"), "assignee_id")
    return joined.groupBy("gvkey", "year").agg(F.sum("total_ai_patents").alias("total_patents"),
        F.countDistinct("assignee_id").alias("num_assignees"), F.avg("avg_ai_score").alias("avg_ai_score"))


def publication_firm_year(papers: DataFrame, matches: DataFrame, years: tuple[int, int] = (1900, 2100)) -> DataFrame:
    """papers(paper_id, year, ids: list of lists): rows count author and institution pairs, distinct_papers each paper once."""
    each = papers.filter(F.col("year").between(*years)).select("paper_id", "year", F.explode(F.flatten("ids")).alias("entity_id"))
    return each.join(matches.select("entity_id", "gvkey"), "entity_id").groupBy("gvkey", "year").agg(F.count("*").alias("total_papers"),
        F.countDistinct("paper_id").alias("distinct_papers"), F.countDistinct("entity_id").alias("num_institutions"))


def with_financials(panel: DataFrame, financials: DataFrame, wanted: list[str], one_row: bool = False) -> DataFrame:
    """Left join on (gvkey, year) = (gvkey, fyear), primary links only; of ``wanted`` the columns that are there. Several rows of a firm
    and year fan out, unless ``one_row`` keeps the one of the greatest lpermno."""
    have = [c for c in wanted if c in financials.columns]
    f = financials.filter(F.col("linkprim").isin("P", "C")) if "linkprim" in financials.columns else financials
    if one_row:
        order = "lpermno" if "lpermno" in f.columns else have[0]
        f = f.groupBy("gvkey", "fyear").agg(F.max_by(F.struct(*have), F.struct(order, *have)).alias("r")).select("gvkey", "fyear", "r.*")
    right = f.select(F.col("gvkey").alias("_g"), F.col("fyear").cast("int").alias("_y"), *have)
    return panel.join(right, (panel["gvkey"] == F.col("_g")) & (panel["year"] == F.col("_y")), "left").drop("_g", "_y")


def comprehensive(patents: DataFrame, papers: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Full outer join with both keys coalesced, counts that are missing 0."""
    out = patents.join(papers, keys, "full_outer")
    return out.na.fill(0, [c for c in counts if c in out.columns])


def entity_span(df: DataFrame, key: str, year: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))
