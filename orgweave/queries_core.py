"""The catalogue of queries over the operators, each over whole tables, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import classify, identifiers, records, similarity, text
from orgweave.operators import dedup, linking, linking_more, metrics, nested, panel, validate
from orgweave.plans import pipelines
from orgweave.shared import cut, read
from orgweave.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))


# -- panels ----------------------------------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue,
 count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def firm_year_panel(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey",
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("amount"))
    j = li.join(_orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"), "year"), "l_orderkey")
    return panel.entity_year(j, ["cust", "year"], orders=F.countDistinct("l_orderkey"), revenue=F.sum("amount").cast("double"),
        parts=F.countDistinct("l_partkey"))


@query("""WITH p AS (SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS orders FROM orders GROUP BY 1, 2),
 f AS (SELECT o_custkey AS g, CAST(year(o_orderdate) AS INT) + 1 AS y, max(o_totalprice) AS mkvalt FROM orders GROUP BY 1, 2)
 SELECT gvkey, year, orders, mkvalt FROM p LEFT JOIN f ON gvkey = g AND year = y""")
def panel_with_financials_left(spark, d):
    o = _orders(spark, d)
    p = o.groupBy(F.col("o_custkey").alias("gvkey"), "year").agg(F.count("*").alias("orders"))
    f = o.groupBy(F.col("o_custkey").alias("gvkey"), (F.col("year") + 1).alias("fyear")).agg(F.max("o_totalprice").alias("mkvalt"))
    return panel.with_financials(p, f, ["mkvalt", "emp"])


@query("""WITH a AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
 b AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
 SELECT coalesce(a.k, b.k) AS k, coalesce(a.year, b.year) AS year, coalesce(n_f, 0) AS n_f, coalesce(n_o, 0) AS n_o FROM a FULL JOIN b ON a.k = b.k AND a.year = b.year""")
def comprehensive_panel_outer(spark, d):
    o = _orders(spark, d).withColumnRenamed("o_custkey", "k")
    part = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy("k", "year").agg(F.count("*").alias(n))
    return panel.comprehensive(part("F", "n_f"), part("O", "n_o"), ["k", "year"], ["n_f", "n_o"])


@query("""WITH n AS (SELECT assignee_id, clean_name, sum(total_ai_patents) AS n FROM patents_panel GROUP BY 1, 2),
 b AS (SELECT assignee_id, clean_name, row_number() OVER (PARTITION BY assignee_id ORDER BY n DESC, clean_name) AS r FROM n)
 SELECT p.assignee_id, b.clean_name, CAST(sum(total_ai_patents) AS BIGINT) AS patent_count_total, min(patent_year) AS first_year, max(patent_year) AS last_year,
 round(avg(avg_ai_score), 4) AS avg_ai_score_overall, count(DISTINCT patent_year) AS year_count FROM patents_panel p JOIN b ON p.assignee_id = b.assignee_id AND r = 1 GROUP BY 1, 2""")
def assignee_master(spark, d):
    m = panel.assignee_master(read(spark, d, "patents_panel").withColumnRenamed("patent_year", "year"))
    return m.withColumn("avg_ai_score_overall", _r("avg_ai_score_overall"))


@query("""SELECT assignee_id, array_to_string(list_sort(list(DISTINCT patent_year)), ',') AS years FROM patents_panel WHERE assignee_id IS NOT NULL GROUP BY 1""")
def assignee_years(spark, d):
    y = panel.assignee_years(read(spark, d, "patents_panel").withColumnRenamed("patent_year", "year"))
    return y.select("assignee_id", F.array_join(F.transform("years", lambda x: x.cast("string")), ",").alias("years"))


@query("""WITH m AS (SELECT DISTINCT assignee_id, gvkey FROM patents_panel JOIN compustat_firms_standardized ON clean_name = conml_clean WHERE assignee_id IS NOT NULL)
 SELECT gvkey, patent_year AS year, CAST(sum(total_ai_patents) AS BIGINT) AS total_patents, count(DISTINCT p.assignee_id) AS num_assignees, round(avg(avg_ai_score), 8) AS avg_ai_score FROM patents_panel p JOIN m ON p.assignee_id = m.assignee_id GROUP BY 1, 2""")
def patent_firm_year(spark, d):
    p = read(spark, d, "patents_panel").withColumnRenamed("patent_year", "year")
    f = read(spark, d, "compustat_firms_standardized").select("gvkey", F.col("conml_clean").alias("clean_name")).dropna()
    m = p.filter("assignee_id is not null").join(f, "clean_name").select(F.col("assignee_id").alias("entity_id"), "gvkey").distinct()
    return panel.patent_firm_year(p, m).withColumn("avg_ai_score", _r("avg_ai_score", 8))


@query("""WITH e AS (SELECT record_id, publication_year AS year, unnest(flatten(author_affiliation_ids)) AS i FROM ai_papers), m AS (SELECT DISTINCT institution_id, lpad(gvkey, 6, '0') AS gvkey FROM publication_firm_matches_stage1)
 SELECT gvkey, year, count(*) AS total_papers, count(DISTINCT record_id) AS distinct_papers, count(DISTINCT i) AS num_institutions FROM e JOIN m ON i = institution_id WHERE year BETWEEN 2010 AND 2023 GROUP BY 1, 2""")
def publication_firm_year(spark, d):
    papers = read(spark, d, "ai_papers").select(F.col("record_id").alias("paper_id"), F.col("publication_year").alias("year"),
        F.transform("author_affiliation_ids", lambda x: F.coalesce(x, F.array().cast("array<string>"))).alias("ids"))
    m = read(spark, d, "publication_firm_matches_stage1").select(F.col("institution_id").alias("entity_id"), F.lpad("gvkey", 6, "0").alias("gvkey")).distinct()
    return panel.publication_firm_year(papers, m, (2010, 2023))


# -- metrics ---------------------------------------------------------------------------------------------------------------------------


@query("""WITH y AS (SELECT patent_year AS year, CAST(sum(total_ai_patents) AS BIGINT) AS n FROM patents_panel WHERE patent_year IS NOT NULL GROUP BY 1)
 SELECT year, n, round((n - lag(n) OVER (ORDER BY year)) * 100.0 / nullif(lag(n) OVER (ORDER BY year), 0), 4) AS growth_pct FROM y""")
def yoy_growth(spark, d):
    y = read(spark, d, "patents_panel").filter("patent_year is not null").groupBy(F.col("patent_year").alias("year")).agg(F.sum("total_ai_patents").alias("n"))
    return metrics.growth(y, "year", "n").withColumn("growth_pct", _r("growth_pct"))


@query("""WITH t AS (SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
 SELECT segment, year, round(x, 2) AS x, round(x / max(CASE WHEN year = 1996 THEN x END) OVER (PARTITION BY segment) * 100, 4) AS index_value FROM t""")
def base_year_index(spark, d):
    o = _orders(spark, d).join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    t = o.groupBy("segment", "year").agg(F.sum("o_totalprice").alias("x"))
    return metrics.index_to_base(t, ["segment"], "year", "x", 1996).select("segment", "year", _r("x", 2).alias("x"), _r("index_value").alias("index_value"))


@query("""WITH t AS (SELECT clean_name, CAST(sum(total_ai_patents) AS DOUBLE) AS x FROM patents_panel GROUP BY 1), s AS (SELECT *, sum(x) OVER () AS s FROM t WHERE x IS NOT NULL)
 SELECT count(*) AS entities, round(sum((x / s) * (x / s)) * 10000, 4) AS hhi FROM s""")
def concentration_hhi(spark, d):
    return metrics.hhi(read(spark, d, "patents_panel"), "clean_name", "total_ai_patents").withColumn("hhi", _r("hhi"))


@query("""WITH t AS (SELECT clean_name, CAST(sum(total_ai_patents) AS DOUBLE) AS x FROM patents_panel GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM t WHERE x IS NOT NULL)
 SELECT count(*) AS entities, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / CAST(count(*) AS DOUBLE), 6) AS gini FROM r""")
def concentration_gini(spark, d):
    return metrics.gini(read(spark, d, "patents_panel"), "clean_name", "total_ai_patents").withColumn("gini", _r("gini", 6))


@query("""WITH t AS (SELECT clean_name, CAST(sum(total_ai_patents) AS DOUBLE) AS x FROM patents_panel GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x DESC, clean_name) AS i, sum(x) OVER () AS s FROM t WHERE x IS NOT NULL)
 SELECT n AS top_n, round(sum(x) / max(s) * 100, 4) AS share_pct FROM r, (VALUES (1), (5), (10), (20), (50), (100)) v(n) WHERE i <= n GROUP BY 1""")
def topn_share(spark, d):
    return metrics.top_share(read(spark, d, "patents_panel"), "clean_name", "total_ai_patents",
        [1, 5, 10, 20, 50, 100]).withColumn("share_pct", _r("share_pct"))


@query("""WITH t AS (SELECT clean_name, CAST(sum(total_ai_patents) AS DOUBLE) AS x FROM patents_panel GROUP BY 1), g AS (SELECT x, count(*) AS n FROM t WHERE x IS NOT NULL GROUP BY 1)
 SELECT x, round(sum(n) OVER (ORDER BY x) / sum(n) OVER (), 6) AS entity_share, round(sum(x * n) OVER (ORDER BY x) / sum(x * n) OVER (), 6) AS value_share FROM g""")
def lorenz_curve(spark, d):
    return metrics.lorenz(read(spark, d, "patents_panel"), "clean_name", "total_ai_patents").select("x",
        _r("entity_share", 6).alias("entity_share"), _r("value_share", 6).alias("value_share"))


@query("""WITH u AS (SELECT cp AS checkpoint, clean_name, sum(total_ai_patents) AS c, sum(CASE WHEN patent_year = cp THEN total_ai_patents END) AS y FROM patents_panel, (VALUES (2010), (2015), (2020)) v(cp) WHERE patent_year <= cp GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY checkpoint ORDER BY c DESC NULLS LAST, clean_name) AS i, count(*) OVER (PARTITION BY checkpoint) AS n FROM u)
 SELECT checkpoint, max(n) AS entities, round(sum(CASE WHEN i <= greatest(1, floor(n * 0.01)) THEN y END) * 100.0 / nullif(sum(y), 0), 4) AS top1pct_share, round(sum(CASE WHEN i <= 10 THEN y END) * 100.0 / nullif(sum(y), 0), 4) AS top_share FROM r GROUP BY 1""")
def concentration_by_checkpoint(spark, d):
    c = metrics.concentration_at(read(spark, d, "patents_panel"), "clean_name", "patent_year", "total_ai_patents", [2010, 2015, 2020])
    return c.select("checkpoint", "entities", _r("top1pct_share").alias("top1pct_share"), _r("top_share").alias("top_share"))


@query("SELECT y AS entry_year, count(*) AS new_entrants FROM (SELECT clean_name, min(patent_year) AS y FROM patents_panel WHERE patent_year IS NOT NULL GROUP BY 1) GROUP BY 1")
def new_entrants(spark, d):
    return metrics.new_entrants(read(spark, d, "patents_panel"), "clean_name", "patent_year")


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, o_custkey) AS i, count(*) OVER () AS n FROM t),
 l AS (SELECT o_custkey FROM r WHERE i <= greatest(1, floor(n * 0.01)))
 SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) FILTER (o_custkey IN (SELECT o_custkey FROM l)) AS leader_orders, count(*) FILTER (o_custkey NOT IN (SELECT o_custkey FROM l)) AS crowd_orders FROM orders GROUP BY 1""")
def leaders_vs_crowd(spark, d):
    o = _orders(spark, d)
    top = metrics.leaders(o, "o_custkey", "o_totalprice").select("o_custkey", F.lit(True).alias("leader"))
    return o.join(top, "o_custkey", "left").groupBy("year").agg(F.count_if("leader").alias("leader_orders"),
        F.count_if(F.col("leader").isNull()).alias("crowd_orders"))


@query("""WITH t AS (SELECT clean_name, patent_year AS y, sum(total_ai_patents) AS x FROM patents_panel WHERE patent_year IS NOT NULL GROUP BY 1, 2),
 a AS (SELECT clean_name, CAST(sum(x) AS BIGINT) AS total, CAST(max(x) AS BIGINT) AS peak_value, avg(CASE WHEN y <= 2015 THEN x END) AS pre, avg(CASE WHEN y > 2015 THEN x END) AS post FROM t GROUP BY 1),
 p AS (SELECT clean_name, y, row_number() OVER (PARTITION BY clean_name ORDER BY x DESC, y) AS i FROM t)
 SELECT a.clean_name, total, p.y AS peak_year, peak_value, round(pre, 2) AS pre_avg, round(post, 2) AS post_avg, CASE WHEN pre > 0 THEN round((post - pre) / pre * 100, 2) ELSE 0 END AS decline_pct, p.y <= 2015 AS peak_before, post < pre AS has_decline
 FROM a JOIN p ON a.clean_name = p.clean_name AND i = 1 WHERE pre IS NOT NULL AND post IS NOT NULL""")
def decline_detection(spark, d):
    t = read(spark, d, "patents_panel").filter("patent_year is not null").groupBy("clean_name",
        F.col("patent_year").alias("y")).agg(F.sum("total_ai_patents").alias("x"))
    return metrics.decline(t.filter("x is not null"), "clean_name", "y", "x", 2015)


@query("""WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, CASE WHEN n <= 5 THEN 1 WHEN n <= 10 THEN 2 WHEN n <= 20 THEN 3 ELSE 4 END AS place FROM t)
 SELECT bucket, place, count(*) AS customers, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM b GROUP BY 1, 2""")
def distribution_buckets(spark, d):
    t = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    n = F.col("n")
    b = t.select(classify.ladder([(n <= 5, "1-5"), (n <= 10, "6-10"), (n <= 20, "11-20")], "21+").alias("bucket"),
        F.when(n <= 5, 1).when(n <= 10, 2).when(n <= 20, 3).otherwise(4).alias("place"))
    return metrics.share_of_total(b.groupBy("bucket", "place").agg(F.count("*").alias("customers")), "customers").withColumn("pct", _r("pct"))


@query("""SELECT p_brand AS brand, quantile_cont(p_retailprice, 0.25) AS q25, quantile_cont(p_retailprice, 0.5) AS q50, quantile_cont(p_retailprice, 0.75) AS q75, round(stddev_samp(p_retailprice), 4) AS sd, round(stddev_pop(p_retailprice), 4) AS sd_pop FROM part GROUP BY 1""")
def percentile_summary(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_brand", "brand")
    q = metrics.quantiles(p, ["brand"], "p_retailprice", [0.25, 0.5, 0.75])
    return q.join(p.groupBy("brand").agg(_r(F.stddev("p_retailprice")).alias("sd"), _r(F.stddev_pop("p_retailprice")).alias("sd_pop")), "brand")


@query("""WITH r AS (SELECT p_brand AS brand, p_size AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size IS NOT NULL)
 SELECT brand, max(CASE WHEN i = round_even((n - 1) * 0.9, 0) THEN v END) AS q90, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS q50 FROM r GROUP BY 1""")
def nearest_quantiles(spark, d):
    return metrics.quantiles(read(spark, d, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_size", [0.9, 0.5], nearest=True)


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS "F", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS "O",
 round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS "P", round(sum(CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY 1""")
def pivot_year_segment(spark, d):
    p = metrics.pivot_sum(_orders(spark, d), "year", "o_orderstatus", ["F", "O", "P"], "o_totalprice")
    return p.select("year", *[_r(c, 2).alias(c) for c in ("F", "O", "P", "total")])


@query("""SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY 1 ORDER BY n DESC, source NULLS LAST LIMIT 5""")
def value_counts_topk(spark, d):
    c = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return metrics.share_of_total(c, "n").withColumn("pct", _r("pct")).orderBy(F.desc("n"), F.asc_nulls_last("source")).limit(5)


@query("SELECT match_type, match_method, count(*) AS n, round(avg(match_confidence), 6) AS avg_confidence FROM publication_firm_matches_stage1 GROUP BY 1, 2")
def crosstab(spark, d):
    return read(spark, d, "publication_firm_matches_stage1").groupBy("match_type", "match_method").agg(F.count("*").alias("n"),
        _r(F.avg("match_confidence"), 6).alias("avg_confidence"))


@query("""SELECT count(*) FILTER (homepage_domain IS NOT NULL) AS with_host, count(*) FILTER (len(acronyms) > 0) AS with_acronym, count(*) FILTER (homepage_domain IS NOT NULL AND len(acronyms) > 0) AS with_both, count(*) AS institutions FROM publication_institutions_master""")
def flag_overlap(spark, d):
    host, acr = F.col("homepage_domain").isNotNull(), F.size("acronyms") > 0
    return read(spark, d, "publication_institutions_master").agg(F.count_if(host).alias("with_host"), F.count_if(acr).alias("with_acronym"),
        F.count_if(host & acr).alias("with_both"), F.count("*").alias("institutions"))


_PROFILED = ["gvkey", "tic", "conm", "city", "fic", "lpermno"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM compustat_firms_standardized"
    for c, t in [(x, "bigint" if x == "lpermno" else "string") for x in _PROFILED]))
def column_profile(spark, d):
    return metrics.column_profile(read(spark, d, "compustat_firms_standardized"), _PROFILED)


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d FROM events), s AS (SELECT min(d) AS a, max(d) AS b FROM e), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS p FROM s),
 n AS (SELECT CAST(a + CAST(floor((d - a) / 7.0) * 7 AS INT) AS DATE) AS p, count(*) AS n FROM e, s GROUP BY 1)
 SELECT c.p AS period_start, coalesce(n, 0) AS records, CAST(16800 AS DOUBLE) AS expected FROM c LEFT JOIN n ON c.p = n.p WHERE coalesce(n, 0) < 16800 * 0.99""")
def gap_detection_weekly(spark, d):
    return metrics.gaps(read(spark, d, "events"), "ts", 7, 2400.0)


@query("""SELECT CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= 1000 THEN '(-inf, 1000]' WHEN o_totalprice <= 100000 THEN '(1000, 100000]' ELSE '(100000, inf]' END AS bin, count(*) AS n FROM orders GROUP BY 1""")
def right_closed_bins(spark, d):
    return read(spark, d, "orders").groupBy(metrics.right_closed(F.col("o_totalprice"), [1000, 100000]).alias("bin")).agg(F.count("*").alias("n"))


# -- dedup, sets and pages -------------------------------------------------------------------------------------------------------------


@query("""SELECT l_partkey, l_suppkey, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def keep_best_dedup(spark, d):
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return dedup.keep_max(li, ["l_partkey", "l_suppkey"], "l_extendedprice", "l_orderkey", "l_linenumber").drop("l_linenumber")


@query("""SELECT gvkey, institution_id, match_method, c AS match_confidence FROM (SELECT *, CASE WHEN match_confidence > 1 THEN match_confidence / 100 ELSE match_confidence END AS c, row_number() OVER (PARTITION BY gvkey, institution_id ORDER BY
 CASE match_method WHEN 'exact_conm' THEN 1 WHEN 'exact_conml' THEN 2 WHEN 'homepage_domain' THEN 3 ELSE 4 END, CASE WHEN match_confidence > 1 THEN match_confidence / 100 ELSE match_confidence END DESC NULLS LAST, match_method) AS r FROM publication_firm_matches_stage1) WHERE r = 1""")
def priority_source_dedup(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1")
    c = F.when(F.col("match_confidence") > 1, F.col("match_confidence") / 100).otherwise(F.col("match_confidence"))
    m = m.select("gvkey", "institution_id", "match_method", c.alias("match_confidence"))
    order = F.when(F.col("match_method") == "exact_conm", 1).when(F.col("match_method") == "exact_conml",
        2).when(F.col("match_method") == "homepage_domain", 3).otherwise(4)
    return dedup.keep_best(m, ["gvkey", "institution_id"], order, F.desc_nulls_last("match_confidence"), F.col("match_method"))


@query("""SELECT DISTINCT institution_id, gvkey FROM publication_firm_matches_stage1 WHERE institution_id IN (SELECT institution_id FROM publication_firm_matches_stage1 GROUP BY 1 HAVING count(DISTINCT gvkey) = 1)""")
def drop_ambiguous(spark, d):
    return dedup.drop_ambiguous(read(spark, d, "publication_firm_matches_stage1"), "institution_id", "gvkey").select("institution_id", "gvkey").distinct()


@query("""SELECT gvkey AS id, conm AS name, fic AS country, NULL AS kind FROM compustat_firms_standardized UNION ALL SELECT institution_id, display_name, country_code, institution_type FROM publication_institutions_master""")
def union_diagonal(spark, d):
    a = read(spark, d, "compustat_firms_standardized").select(F.col("gvkey").alias("id"), F.col("conm").alias("name"), F.col("fic").alias("country"))
    b = read(spark, d, "publication_institutions_master").select(F.col("institution_type").alias("kind"),
        F.col("display_name").alias("name"), F.col("institution_id").alias("id"), F.col("country_code").alias("country"))
    return dedup.union_all(a, b).select("id", "name", "country", "kind")


@query("""WITH a AS (SELECT DISTINCT clean_name AS k FROM patents_panel WHERE clean_name IS NOT NULL), b AS (SELECT DISTINCT conml_clean AS k FROM compustat_firms_standardized WHERE conml_clean IS NOT NULL)
 SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k""")
def set_overlap(spark, d):
    return dedup.set_overlap(read(spark, d, "patents_panel").select(F.col("clean_name").alias("k")),
        read(spark, d, "compustat_firms_standardized").select(F.col("conml_clean").alias("k")), "k")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_orderdate >= '1997-01-01'")
def semi_filter_early(spark, d):
    big = read(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").filter(F.col("o_orderdate") >= "1997-01-01").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@query("SELECT gvkey, count(*) AS rows FROM compustat_firms_standardized f WHERE gvkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM publication_firm_matches_stage1 m WHERE lpad(m.gvkey, 6, '0') = f.gvkey) GROUP BY 1")
def anti_unmatched(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").select(F.lpad("gvkey", 6, "0").alias("gvkey"))
    return read(spark, d, "compustat_firms_standardized").filter("gvkey is not null").join(m, "gvkey",
        "left_anti").groupBy("gvkey").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, d):
    return readers.page_by_key(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 500)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 2000")
def offset_page(spark, d):
    return readers.page_by_offset(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 2000, 500)


@query("SELECT batch, count(*) AS ids FROM (SELECT DISTINCT o_custkey, CAST('0x' || left(md5(CAST(o_custkey AS VARCHAR)), 8) AS BIGINT) % 16 AS batch FROM orders) GROUP BY 1")
def id_batches(spark, d):
    return readers.id_batches(read(spark, d, "orders"), "o_custkey", 16).groupBy("batch").agg(F.count("*").alias("ids"))


# -- names, addresses and classes ------------------------------------------------------------------------------------------------------

_M1 = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\b(INCORPORATED|CORPORATION|COMPANY|LIMITED|L\.?L\.?C\.?|INC\.?|LTD\.?|CORP\.?|CO\.?|PLC\.?|S\.?A\.?|A\.?G\.?|GMBH|N\.?V\.?|B\.?V\.?)\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), '')"


@query(f"SELECT gvkey, conm, {_M1.format('conm')} AS conm_cleaned, {_M1.format('conml')} AS conml_cleaned FROM compustat_firms_standardized")
def org_name_clean(spark, d):
    f = read(spark, d, "compustat_firms_standardized")
    return f.select("gvkey", "conm", text.clean_organization_name(F.col("conm")).alias("conm_cleaned"),
        text.clean_organization_name(F.col("conml")).alias("conml_cleaned"))


@query(f"""WITH v AS (SELECT gvkey, lpermno, conm, unnest([{_M1.format('conm')}, {_M1.format('conml')}, upper(trim(tic)), CASE WHEN len(list_filter(string_split_regex(trim(conm), '\\s+'), lambda x: x <> '')) >= 2 THEN list_aggregate(list_transform(list_filter(string_split_regex(trim(conm), '\\s+'), lambda x: x <> ''), lambda x: x[1]), 'string_agg', '') END]) AS x FROM compustat_firms_standardized)
 SELECT gvkey, lpermno, conm, string_agg(DISTINCT x, '|' ORDER BY x) AS variants FROM v WHERE x IS NOT NULL AND x <> '' GROUP BY 1, 2, 3""")
def name_variants(spark, d):
    f = read(spark, d, "compustat_firms_standardized").select("gvkey", "lpermno", "conm", "conml", "tic")
    v = f.select("gvkey", "lpermno", "conm", F.explode(text.firm_variants(F.col("conm"), F.col("conml"), F.col("tic"))).alias("x"))
    return v.groupBy("gvkey", "lpermno", "conm").agg(F.array_join(F.sort_array(F.collect_set("x")), "|").alias("variants"))


@query()
def normaliser_table(spark, d):
    """Each institution name under every normaliser."""
    n = read(spark, d, "publication_institutions_master").select("display_name").distinct()
    return n.select("display_name", *[f(F.col("display_name")).alias(k) for k, f in text.NORMALISERS.items()])


_URL = r"nullif(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim({0})), '^https?://', ''), 'www.', ''), '/.*$', ''), '\.$', ''), '')"
_DOMAIN = _URL.format("weburl")


@query(f"SELECT gvkey, weburl, {_DOMAIN} AS domain FROM compustat_firms_standardized WHERE weburl IS NOT NULL")
def domain_extract(spark, d):
    return read(spark, d, "compustat_firms_standardized").filter("weburl is not null").select("gvkey", "weburl",
        identifiers.domain(F.col("weburl")).alias("domain"))


@query(r"""SELECT DISTINCT homepage_domain AS host, CASE WHEN len(string_split(homepage_domain, '.')) <= 2 THEN homepage_domain ELSE array_to_string(list_slice(string_split(homepage_domain, '.'), -2, -1), '.') END AS root FROM publication_institutions_master WHERE homepage_domain IS NOT NULL""")
def root_domain(spark, d):
    return read(spark, d, "publication_institutions_master").filter("homepage_domain is not null").select(F.col("homepage_domain")
        .alias("host"), identifiers.root_domain(F.col("homepage_domain")).alias("root")).distinct()


@query(r"""SELECT record_id, nullif(regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', ''), '(?i)v\d+$', ''), '') AS arxiv FROM ai_papers WHERE arxiv_id IS NOT NULL""")
def arxiv_id_clean(spark, d):
    return read(spark, d, "ai_papers").filter("arxiv_id is not null").select("record_id", identifiers.arxiv_id(F.col("arxiv_id")).alias("arxiv"))


@query(r"""SELECT institution_id AS raw, nullif(regexp_extract(upper(trim(institution_id)), '(?:^|/)(I\d+)/?$', 1), '') AS id, count(*) AS n FROM arxiv_paper_institutions WHERE institution_id IS NOT NULL GROUP BY 1, 2""")
def institution_id_clean(spark, d):
    return read(spark, d, "arxiv_paper_institutions").filter("institution_id is not null").groupBy(F.col("institution_id")
        .alias("raw")).agg(F.count("*").alias("n")).withColumn("id", identifiers.institution_id(F.col("raw")))


def _like(words: tuple[str, ...], c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _c1_sql() -> str:
    suffix = " OR ".join(f"ends_with(s, '{x}') OR contains(s, ' {x}')" for x in classify.COMPANY_SUFFIXES)
    word = "regexp_matches(s, '\\b(" + "|".join(w.replace("&", "[&]").replace(".", "[.]") for w in classify.COMPANY_RESEARCH) + ")\\b')"
    unclear = " ".join(f"WHEN contains(s, '{x}') THEN CASE WHEN starts_with(s, '{x}') OR contains(s, '{x} for') OR {_like(classify.UNCLEAR_FIRM, 's')} THEN 'firm' ELSE 'university' END" for x in classify.UNCLEAR)
    return f"""WITH n AS (SELECT institution_name, trim(lower(institution_name)) AS s FROM (SELECT DISTINCT institution_name FROM arxiv_paper_institutions WHERE institution_name IS NOT NULL))
 SELECT institution_name, CASE WHEN s = '' THEN 'unknown' WHEN {_like(classify.GOVERNMENT, 's')} THEN 'government' WHEN {_like(classify.UNIVERSITY, 's')} OR {_like(classify.EDUCATION, 's')} THEN 'university'
 WHEN {word} OR {suffix} THEN 'firm' {unclear} WHEN {_like(classify.FIRM, 's')} THEN 'firm' ELSE 'unknown' END AS kind FROM n"""


@query(_c1_sql())
def affiliation_type(spark, d):
    n = read(spark, d, "arxiv_paper_institutions").filter("institution_name is not null").select("institution_name").distinct()
    return n.select("institution_name", classify.affiliation_type(F.col("institution_name")).alias("kind"))


@query()
def paper_affiliation_summary(spark, d):
    p = read(spark, d, "ai_papers").select("record_id", records.ordered_union(F.flatten(F.filter("author_affiliations", lambda x: x.isNotNull()))).alias("a"))
    return p.select("record_id", classify.paper_affiliations(F.col("a")).alias("s")).select("record_id", "s.*")


def _c6_sql() -> str:
    n, h = "lower(coalesce(display_name, ''))", "lower(coalesce(homepage_domain, ''))"
    types = " ".join(f"WHEN institution_type = '{k}' THEN '{v}'" for k, v in classify.TYPE_MAP.items())
    return f"""SELECT institution_id, display_name, CASE {types} WHEN {_like(classify.ACADEMIC_WORDS, n)} OR {_like(classify.ACADEMIC_DOMAINS, h)} THEN 'academic' WHEN {_like(classify.STATE_WORDS, n)} THEN 'government'
 WHEN {_like(classify.NONPROFIT_WORDS, n)} OR {_like(classify.NONPROFIT_DOMAINS, h)} THEN 'nonprofit' WHEN {_like(classify.CORPORATE_WORDS, n)} THEN 'corporate' ELSE 'unknown' END AS class FROM publication_institutions_master"""


@query(_c6_sql())
def institution_class(spark, d):
    i = read(spark, d, "publication_institutions_master")
    return i.select("institution_id", "display_name", classify.institution_class(F.col("institution_type"), F.col("display_name"),
        F.col("homepage_domain")).alias("class"))


def _c8_sql() -> str:
    hit = {k: _like(w, "s") for k, w in classify.LABEL_WORDS.items()}
    for w, (label, need, bar) in classify.CONTEXT_WORDS.items():
        hit[label] = f"({hit[label]} OR (contains(s, '{w}') AND {_like(need, 's')} AND NOT {_like(bar, 's')}))"
    cols = ", ".join(f"coalesce({hit[k]}, false) AS is_{k}" for k in hit)
    ladder = " ".join(f"WHEN {hit[k]} THEN '{k.capitalize()}'" for k in hit)
    return f"SELECT doc_id, {cols}, CASE {ladder} ELSE 'Unknown' END AS \"primary\" FROM (SELECT doc_id, lower(text) AS s FROM documents)"


@query(_c8_sql())
def contextual_multilabel(spark, d):
    return read(spark, d, "documents").select("doc_id", classify.ai_labels(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"SELECT source, count(*) AS documents, count(*) FILTER ({_like(classify.AI_WORDS, 'lower(text)')}) AS ai_documents FROM documents GROUP BY 1")
def keyword_classify(spark, d):
    hit = text.contains_any(F.lower("text"), classify.AI_WORDS)
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(hit).alias("ai_documents"))


@query("""SELECT primary_category, CASE WHEN coalesce(primary_category, '') = '' THEN 'Unknown' """ + " "
    .join(f"WHEN starts_with(lower(primary_category), '{p}') THEN '{k}'" for p,
        k in classify.ARXIV_CLASSES) + """ ELSE 'Other' END AS class, count(*) AS n FROM arxiv_paper_institutions GROUP BY 1, 2""")
def arxiv_category_class(spark, d):
    return read(spark, d, "arxiv_paper_institutions").groupBy("primary_category").agg(F.count("*").alias("n")).withColumn("class",
        classify.arxiv_class(F.col("primary_category")))


# -- links -----------------------------------------------------------------------------------------------------------------------------


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "publication_institutions_master")
    return i.select(F.col("institution_id").alias("entity_id"), text.clean_organization_name(F.col("display_name")).alias("name"),
        F.col("alternative_names").alias("alternatives"), "acronyms", F.col("parent_institution_ids").alias("parents"),
        identifiers.domain(F.coalesce("homepage_domain", "homepage_url")).alias("host")).distinct()


def _firms(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "compustat_firms_standardized")
    return f.select("gvkey", text.clean_organization_name(F.col("conm")).alias("conm_clean"),
        text.clean_organization_name(F.col("conml")).alias("conml_clean"), F.upper(F.trim("tic")).alias("tic"),
        identifiers.domain(F.col("weburl")).alias("host"), "name_variants", "busdesc").distinct()


@query(f"""SELECT DISTINCT institution_id AS entity_id, gvkey, 'exact_conml' AS match_method, CAST(0.98 AS DOUBLE) AS match_confidence FROM (SELECT institution_id, {_M1.format('display_name')} AS k FROM publication_institutions_master) i JOIN (SELECT gvkey, {_M1.format('conml')} AS k FROM compustat_firms_standardized) f ON i.k = f.k""")
def exact_match(spark, d):
    return linking.equal_keys(_institutions(spark, d).select("entity_id", F.col("name").alias("key")),
        _firms(spark, d).select("gvkey", F.col("conml_clean").alias("key")), "exact_conml", 0.98)


@query("""WITH a AS (SELECT institution_id AS entity_id, unnest(acronyms) AS x, generate_subscripts(acronyms, 1) AS p FROM publication_institutions_master), t AS (SELECT gvkey, upper(trim(tic)) AS k, 'acronym_to_tic' AS s FROM compustat_firms_standardized WHERE tic IS NOT NULL UNION SELECT gvkey, v, 'acronym_to_name_variant' FROM (SELECT gvkey, unnest(name_variants) AS v FROM compustat_firms_standardized) WHERE length(v) <= 6 AND v = upper(v)),
 m AS (SELECT entity_id, p, gvkey, s FROM a JOIN t ON upper(trim(x)) = k)
 SELECT DISTINCT entity_id, gvkey, s AS match_method, CAST(0.97 AS DOUBLE) AS match_confidence FROM m WHERE p = (SELECT min(p) FROM m n WHERE n.entity_id = m.entity_id)""")
def acronym_match(spark, d):
    return linking.acronym_matches(_institutions(spark, d).select("entity_id", "acronyms"), _firms(spark, d))


@query(f"""WITH i AS (SELECT DISTINCT institution_id AS entity_id, {_M1.format('display_name')} AS n FROM publication_institutions_master), f AS (SELECT DISTINCT gvkey, {_M1.format('conml')} AS k FROM compustat_firms_standardized)
 SELECT DISTINCT entity_id, gvkey, n AS entity, k AS firm FROM i JOIN f ON contains(n, k) WHERE length(k) >= 8""")
def contained_match(spark, d):
    return linking.contained_pairs(_institutions(spark, d).select("entity_id", "name"), _firms(spark, d).select("gvkey", F.col("conml_clean").alias("name")))


@query(r"""WITH i AS (SELECT DISTINCT institution_id AS entity_id, unnest(regexp_split_to_array(upper(concat_ws(', ', display_name, acronyms[1])), '[^\p{L}\p{N}_]+')) AS k FROM publication_institutions_master), f AS (SELECT DISTINCT gvkey, upper(trim(tic)) AS k FROM compustat_firms_standardized WHERE length(tic) >= 2)
 SELECT DISTINCT entity_id, gvkey FROM i JOIN f ON i.k = f.k""")
def ticker_match(spark, d):
    named = F.concat_ws(", ", "display_name", F.try_element_at("acronyms", F.lit(1)))
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"), named.alias("name")).distinct()
    return linking.word_pairs(i, read(spark, d, "compustat_firms_standardized").select("gvkey", "tic"))


@query()
def publication_links(spark, d):
    return linking.publications(_institutions(spark, d), _firms(spark, d))


@query()
def cascade_first_hit(spark, d):
    return linking.publications_stage1(_institutions(spark, d), _firms(spark, d))


@query()
def patent_links(spark, d):
    a = read(spark, d, "patents_panel").select(F.col("clean_name").alias("name")).filter("name is not null").distinct().withColumn("entity_id", F.col("name"))
    return linking.keep_best_match(linking.patent_stage1(a, _firms(spark, d)))


@query()
def patent_links_fuzzy(spark, d):
    a = read(spark, d, "patents_panel").select(F.col("clean_name").alias("name")).filter("name is not null").distinct().withColumn("entity_id", F.col("name"))
    f = _firms(spark, d)
    done = cut(linking.patent_stage1(a, f))
    return linking.keep_best_match(linking.patent_stage2(a.join(done.select("entity_id").distinct(), "entity_id", "left_anti"),
        f.join(done.select("gvkey").distinct(), "gvkey", "left_anti")))


@query("""WITH m AS (SELECT e, gvkey, c, m FROM (SELECT institution_id AS e, lpad(gvkey, 6, '0') AS gvkey, CASE WHEN match_confidence > 1 THEN match_confidence / 100 ELSE match_confidence END AS c, match_method AS m, row_number() OVER (PARTITION BY institution_id, lpad(gvkey, 6, '0')
 ORDER BY CASE WHEN match_confidence > 1 THEN match_confidence / 100 ELSE match_confidence END DESC, match_method) AS r FROM publication_firm_matches_stage1 WHERE match_confidence IS NOT NULL) WHERE r = 1),
 i AS (SELECT DISTINCT institution_id AS e, parent_institution_ids AS p FROM publication_institutions_master), u AS (SELECT e, unnest(p) AS parent, generate_subscripts(p, 1) AS k FROM i WHERE e NOT IN (SELECT e FROM m)),
 x AS (SELECT u.e, k, gvkey, c, m FROM u JOIN m ON u.parent = m.e)
 SELECT DISTINCT e AS entity_id, gvkey, 'parent_cascade_' || m AS match_method, round(c * 0.98, 3) AS match_confidence FROM x WHERE k = (SELECT min(k) FROM x y WHERE y.e = x.e)""")
def parent_cascade(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").filter("match_confidence is not null")
    c = F.when(F.col("match_confidence") > 1, F.col("match_confidence") / 100).otherwise(F.col("match_confidence"))
    m = linking.keep_best_match(m.select(F.col("institution_id").alias("entity_id"), F.lpad("gvkey", 6, "0").alias("gvkey"), "match_method",
        c.alias("match_confidence")))
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"),
        F.col("parent_institution_ids").alias("parents")).distinct()
    return linking.parent_cascade(i, m)


@query()
def homepage_match(spark, d):
    return linking.homepage_matches(_institutions(spark, d).select("entity_id", "host"), _firms(spark, d).select("gvkey", "host"))


@query("""WITH w AS (SELECT DISTINCT clean_name AS n, split_part(clean_name, ' ', 1) AS k FROM patents_panel WHERE clean_name IS NOT NULL)
 SELECT a.n AS name_a, b.n AS name_b, round(jaro_winkler_similarity(a.n, b.n), 6) AS score FROM w a JOIN w b ON a.k = b.k AND a.n < b.n WHERE jaro_winkler_similarity(a.n, b.n) >= 0.9""")
def jw_similarity_block(spark, d):
    w = read(spark, d, "patents_panel").filter("clean_name is not null").select(F.col("clean_name")
        .alias("text")).distinct().withColumn("k", F.substring_index("text", " ", 1))
    near = linking.near_texts(w, w.withColumn("first", F.lit(None).cast("string")), "jaro_winkler", 0.9, within="k")  # names of one first word, in blocks
    return near.filter("a < b").select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), _r("score", 6).alias("score"))


@query("""WITH w AS (SELECT DISTINCT clean_name AS n, left(clean_name, 6) AS k FROM patents_panel WHERE clean_name IS NOT NULL)
 SELECT a.n AS name_a, b.n AS name_b, CAST(levenshtein(a.n, b.n) AS INT) AS edits FROM w a JOIN w b ON a.k = b.k AND a.n < b.n WHERE levenshtein(a.n, b.n) <= 3""")
def levenshtein_block(spark, d):
    w = read(spark, d, "patents_panel").filter("clean_name is not null").select(F.col("clean_name").alias("n")).distinct().withColumn("k",
        F.left("n", F.lit(6)))
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.n") < F.col("b.n")))
    return pairs.select(F.col("a.n").alias("name_a"), F.col("b.n").alias("name_b"),
        F.levenshtein(F.col("a.n"), F.col("b.n"), 3).alias("edits")).filter("edits >= 0")


@query(r"""WITH f AS (SELECT DISTINCT gvkey AS id, list_distinct(string_split(conml_clean, ' ')) AS t FROM compustat_firms_standardized WHERE conml_clean IS NOT NULL), i AS (SELECT DISTINCT institution_id AS id, list_distinct(string_split(normalized_name, ' ')) AS t FROM publication_institutions_master WHERE normalized_name IS NOT NULL),
 a AS (SELECT id, len(t) AS n, unnest(t) AS w FROM f), b AS (SELECT id, unnest(t) AS w FROM i)
 SELECT a.id AS a, b.id AS b, CAST(count(*) AS INT) AS shared FROM a JOIN b ON a.w = b.w GROUP BY a.id, b.id, a.n HAVING count(*) >= least(3, a.n)""")
def token_blocked_pairs(spark, d):
    f = read(spark, d, "compustat_firms_standardized").filter("conml_clean is not null").select(F.col("gvkey").alias("id"),
        F.split("conml_clean", " ").alias("tokens")).distinct()
    i = read(spark, d, "publication_institutions_master").filter("normalized_name is not null").select(F.col("institution_id").alias("id"),
        F.split("normalized_name", " ").alias("tokens")).distinct()
    return linking.token_pairs(f, i, 3)


@query()
def match_funnel(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").withColumnsRenamed({"institution_display_name": "institution_name", "firm_conm": "firm_name"})
    return linking.funnel(m, linking.aggressive_steps())[1]


@query()
def match_assessment(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1")
    a = m.select(classify.match_assessment(F.col("institution_display_name"), F.col("firm_conm"), F.col("match_method")).alias("a")).select("a.*")
    return a.groupBy("prediction", "reason").agg(F.count("*").alias("n"))


@query()
def similarity_scores(spark, d):
    f = read(spark, d, "compustat_firms_standardized").filter("conm is not null and conml is not null").select(F.upper("conm").alias("a"),
        F.upper("conml").alias("b")).distinct()
    return f.select("a", "b", *[_r(similarity.column(n)("a", "b")).alias(n) for n in ("ratio", "partial_ratio", "token_sort_ratio",
        "wratio", "jaro_winkler", "sequence_ratio")])


# -- nested records, samples, SQL ------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT record_id, unnest(flatten(author_affiliations)) AS a FROM ai_papers) SELECT a AS affiliation, count(*) AS n, count(DISTINCT record_id) AS papers FROM e WHERE a IS NOT NULL GROUP BY 1""")
def nested_explode_count(spark, d):
    e = read(spark, d, "ai_papers").select("record_id", F.explode(F.flatten(F.transform("author_affiliations",
        lambda x: F.coalesce(x, F.array().cast("array<string>"))))).alias("affiliation"))
    return e.filter("affiliation is not null").groupBy("affiliation").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("papers"))


@query("""WITH z AS (SELECT record_id, unnest(list_zip(coalesce(topic_names, []), coalesce(topic_ids, []))) AS z, unnest(generate_series(0, greatest(len(coalesce(topic_names, [])), len(coalesce(topic_ids, []))) - 1)) AS place FROM ai_papers)
 SELECT record_id, CAST(place AS INT) AS place, z[1] AS name, z[2] AS id FROM z""")
def parallel_array_explode(spark, d):
    return records.parallel_walk(read(spark, d, "ai_papers"), "record_id", {"topic_names": "name", "topic_ids": "id"})


@query("SELECT event_id, 'k' AS path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field_flatten(spark, d):
    return records.flatten_paths(read(spark, d, "events"), "event_id", "props")


@query()
def work_json_structure(spark, d):
    return records.json_structure(read(spark, d, "openalex_work_json"), "work_json")


@query()
def authorship_rows(spark, d):
    return records.authorship_rows(read(spark, d, "openalex_work_json"), "work_json")


@query()
def work_child_tables(spark, d):
    """Rows and columns of each table that a nested record becomes."""
    tables = nested.child_tables(read(spark, d, "openalex_work_json"), "record_id", "work_json")
    out = None
    for path, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("parents")).select(F.lit(path).alias("path"),
            F.lit(len(df.columns) - 1).alias("columns"), "rows", "parents")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def stratified_sample(spark, d):
    return validate.stratified(read(spark, d, "publication_firm_matches_stage1").select("match_method", "institution_id",
        "gvkey").distinct().withColumn("k", F.concat_ws("|", "institution_id", "gvkey")), ["match_method"], "k", 10)


@query()
def proportional_sample(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").select("match_method", "institution_id", "gvkey").distinct().withColumn("k",
        F.concat_ws("|", "institution_id", "gvkey"))
    return validate.proportional(m, "match_method", "k", 50)


@query("""WITH p AS (SELECT conm_clean IS NOT NULL AND contains(coalesce(conm_clean, ''), 'TECH') AS p, contains(lower(coalesce(busdesc, '')), 'develops') AS a FROM compustat_firms_standardized), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM p)
 SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS "precision", round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS f1,
 round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS false_positive_rate, round(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 6) AS false_negative_rate FROM c""")
def confusion_matrix(spark, d):
    f = read(spark, d, "compustat_firms_standardized").select(F.coalesce(F.col("conm_clean").contains("TECH"), F.lit(False)).alias("p"),
        F.coalesce(F.lower("busdesc").contains("develops"), F.lit(False)).alias("a"))
    c = validate.confusion(f, "p", "a")
    return c.select("tp", "fp", "fn", "tn", *[_r(x, 6).alias(x) for x in c.columns[4:]])


@query("""WITH t AS (SELECT patent_year AS y, sum(total_ai_patents) AS s, sum(CASE WHEN assignee_id IS NOT NULL THEN total_ai_patents END) AS m FROM patents_panel GROUP BY 1),
 a AS (SELECT avg(CASE WHEN y BETWEEN 2000 AND 2010 THEN s END) AS e, avg(CASE WHEN y BETWEEN 2020 AND 2024 THEN s END) AS l, sum(m) / sum(s) AS c FROM t)
 SELECT round(e, 4) AS early_avg, round(l, 4) AS late_avg, round(c, 6) AS coverage, round(l / nullif(e, 0), 6) AS truncation_ratio FROM a""")
def bias_ratios(spark, d):
    p = read(spark, d, "patents_panel").withColumn("has", F.col("assignee_id").isNotNull())
    b = validate.bias_ratios(p, "patent_year", "total_ai_patents", (2000, 2010), (2020, 2024), "has")
    return b.select(_r("early_avg").alias("early_avg"), _r("late_avg").alias("late_avg"), _r("coverage", 6).alias("coverage"),
        _r("truncation_ratio", 6).alias("truncation_ratio"))


_SUBQUERIES = """SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 1 ELSE 0 END) AS large_orders,
 count(DISTINCT o_custkey) * 100.0 / (SELECT count(*) FROM customer) AS pct FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) LIKE '%e%' GROUP BY c_mktsegment"""


@query(f"SELECT segment, customers, CAST(large_orders AS BIGINT) AS large_orders, round(CAST(pct AS DOUBLE), 4) AS pct FROM ({_SUBQUERIES})")
def sql_subqueries(spark, d):
    for t in ("orders", "customer"):
        read(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(f"SELECT segment, customers, CAST(large_orders AS BIGINT) AS large_orders, round(CAST(pct AS DOUBLE), 4) AS pct FROM ({_SUBQUERIES})")


@query("""SELECT year(published) AS year, count(*) AS rows, count(DISTINCT arxiv_id) AS papers, CAST(sum(CASE WHEN has_institution THEN 1 ELSE 0 END) AS BIGINT) AS with_institution, count(DISTINCT institution_id) + max(CASE WHEN institution_id IS NULL THEN 1 ELSE 0 END) AS institutions FROM arxiv_paper_institutions GROUP BY 1""")
def yearly_coverage(spark, d):
    a = read(spark, d, "arxiv_paper_institutions")
    return a.groupBy(F.year("published").cast("long").alias("year")).agg(F.count("*").alias("rows"),
        F.countDistinct("arxiv_id").alias("papers"), F.count_if("has_institution").alias("with_institution"),
        panel.distinct_with_null("institution_id").alias("institutions"))


def _institutions_full(spark: SparkSession, d: str) -> DataFrame:
    """Every different row of an institution: one with several names, hosts or places is compared by all of them."""
    i = read(spark, d, "publication_institutions_master")
    return i.select(
        F.col("institution_id").alias("entity_id"), "display_name", F.col("display_name").alias("name"),
        F.col("name_variants").alias("variants"), "acronyms", F.col("parent_institution_ids").alias("parents"), F.col("country_code").alias("country"),
        F.col("geo_city").alias("city"), F.col("geo_region").alias("region"), identifiers.host(F.col("homepage_domain")).alias("host"),
    ).distinct()


def _firms_full(spark: SparkSession, d: str) -> DataFrame:
    """Every different row of a firm but for its share classes."""
    f = read(spark, d, "compustat_firms_standardized")
    return f.select(
        "gvkey", "conm", text.clean_organization_name(F.col("conm")).alias("conm_clean"),
        text.clean_organization_name(F.col("conml")).alias("conml_clean"), "tic", F.col("name_variants").alias("variants"), "fic", "city", "state", "busdesc",
        identifiers.host(F.lower("weburl")).alias("host"),
    ).distinct()


@query()
def publication_links_fuzzy(spark, d):
    links = linking_more.publications_stage2(_institutions_full(spark, d), _firms_full(spark, d))
    return links.drop("match_confidence")  # halves of the third digit round differently elsewhere


@query()
def publication_links_enhanced(spark, d):
    i = _institutions_full(spark, d).withColumn("name", text.clean_organization_name(F.col("display_name")))
    return linking_more.stage1_enhanced(i, _firms_full(spark, d))


@query()
def smart_url_links(spark, d):
    i = _institutions_full(spark, d).withColumn("wikipedia_url",
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("display_name", F.lit(" "), F.lit("_"))))
    return linking_more.smart_urls(i, _firms_full(spark, d))


@query()
def wikipedia_links(spark, d):
    return linking_more.wikipedia_names(_institutions_full(spark, d).select("entity_id", F.col("display_name").alias("title")), _firms_full(spark, d))


@query()
def filtered_name_links(spark, d):
    return linking_more.filtered_names(_institutions_full(spark, d), _firms_full(spark, d))


@query()
def wratio_links(spark, d):
    return linking_more.wratio_stage2(_institutions_full(spark, d), _firms_full(spark, d))


@query()
def legacy_links(spark, d):
    return linking_more.legacy(_institutions_full(spark, d), _firms_full(spark, d))


@query()
def firm_to_institution_links(spark, d):
    return linking_more.firm_to_institutions(_firms_full(spark, d), _institutions_full(spark, d))


@query()
def topic_concepts(spark, d):
    p = read(spark, d, "ai_papers").select(F.explode(F.arrays_zip("topic_ids", "topic_names")).alias("t")).select(F.col("t.topic_ids")
        .alias("id"), F.col("t.topic_names").alias("display_name")).filter("id <> '' and display_name is not null")
    # the topics of the works that carry a topic stand for its ancestors: of each its most frequent companion
    both = read(spark, d, "ai_papers").select(F.explode("topic_ids").alias("id"), "topic_ids").select("id",
        F.explode("topic_ids").alias("anc")).filter("id <> '' and anc <> '' and id <> anc").groupBy("id", "anc").agg(F.count("*").alias("n"))
    top = both.groupBy("id").agg(F.array(F.min_by("anc", F.struct(-F.col("n"), "anc"))).alias("ancestors"))
    c = p.groupBy("id").agg(F.min("display_name").alias("display_name")).join(top, "id", "left")
    known, terms = spark.createDataFrame([("T90006",)], "id string"), spark.createDataFrame([("dialogue system",), ("speech recognition",)], "term string")
    return linking_more.select_concepts(c, known, terms)


@query()
def firm_papers(spark, d):
    return pipelines.firm_papers(read(spark, d, "ai_papers"), "author_affiliations", "record_id")


@query()
def patent_report_growth(spark, d):
    p = read(spark, d, "patents_panel").select("clean_name", F.col("patent_year").alias("year"), "total_ai_patents", "avg_ai_score",
        F.col("clean_name").alias("assignee_id")).filter("clean_name is not null")
    a = p.select(F.col("clean_name").alias("name")).distinct().withColumn("entity_id", F.col("name"))
    return pipelines.patent_report(p, pipelines.link_patents(a, _firms(spark, d)))["growth"]


@query(r"""SELECT CAST(date_part('year', published) AS INT) AS year, institution_type, count(*) AS rows, count(DISTINCT author_id) AS authors FROM arxiv_paper_institutions WHERE has_institution GROUP BY 1, 2""")
def yearly_types(spark, d):
    a = read(spark, d, "arxiv_paper_institutions").filter("has_institution").withColumn("y", F.year("published"))
    return metrics.grouped_by_year(a, "y", "institution_type", "author_id").withColumnRenamed("entities", "authors")


@query("""WITH c AS (SELECT institution_name AS k, CAST(publication_year AS INT) AS y, count(*) AS n FROM arxiv_paper_institutions WHERE institution_type = 'company' AND institution_name IS NOT NULL GROUP BY 1, 2)
 SELECT y AS year, CAST(sum(n) AS BIGINT) AS publications, count(DISTINCT k) AS companies FROM c GROUP BY 1""")
def market_trend(spark, d):
    a = read(spark, d, "arxiv_paper_institutions").filter("institution_type = 'company' and institution_name is not null")
    return metrics.yearly_totals(a, "publication_year", "institution_name").withColumnRenamed("entities", "companies")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


