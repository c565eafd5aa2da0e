"""SQL of the cascades of links, and further queries over links, classes, records, readers and sinks; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions import classify, identifiers, records, text
from orgweave.operators import linking, linking_more, metrics, panel, validate
from orgweave.queries_core import _M1, _URL, QUERIES, SQL, _c1_sql, _firms, _firms_full, _institutions, _institutions_full, _like, _r, query
from orgweave.queries_data import _items, _step
from orgweave.shared import cut, read, remove, work_path
from orgweave.sources import readers, sinks
from orgweave.streaming import ingest

# -- pieces of SQL ---------------------------------------------------------------------------------------------------------------------

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_I = f"""i AS (SELECT DISTINCT institution_id AS e, {_M1.format("display_name")} AS name, alternative_names AS alts, acronyms AS acr, parent_institution_ids AS parents, {_URL.format("coalesce(homepage_domain, homepage_url)")} AS host FROM publication_institutions_master)"""
_F = f"""f AS (SELECT DISTINCT gvkey, {_M1.format("conm")} AS conm, {_M1.format("conml")} AS conml, upper(trim(tic)) AS tic, {_URL.format("weburl")} AS host FROM compustat_firms_standardized)"""
_N = "n AS (SELECT gvkey, conm AS k FROM f WHERE conm IS NOT NULL UNION SELECT gvkey, conml FROM f WHERE conml IS NOT NULL)"
_AB = "ab(short, long) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in linking.ABBREVIATIONS.items()) + ")"
_NO_WORD = r"[^\p{L}\p{N}_\s]"
_ROOT = "CASE WHEN len(string_split({0}, '.')) <= 2 THEN {0} ELSE array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.') END"
_INITIALS = "CASE WHEN len(string_split({0}, ' ')) >= 2 THEN list_aggregate(list_transform(string_split({0}, ' '), lambda w: w[1]), 'string_agg', '') END"
_BEST = "SELECT e AS entity_id, gvkey, m AS match_method, CAST(c AS DOUBLE) AS match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY e, gvkey ORDER BY c DESC, m) AS r FROM m) WHERE r = 1"
_FIRST = "SELECT DISTINCT e AS entity_id, gvkey, m AS match_method, CAST(c AS DOUBLE) AS match_confidence FROM m WHERE s = (SELECT min(s) FROM m x WHERE x.e = m.e)"

SQL["publication_links"] = f"""WITH {_I}, {_F}, {_N}, {_AB}, al AS (SELECT e, trim(regexp_replace(regexp_replace(upper(a), '{_NO_WORD}', '', 'g'), '\\s+', ' ', 'g')) AS k FROM (SELECT e, unnest(alts) AS a FROM i)),
 ac AS (SELECT e, name, alts, upper(a) AS k FROM (SELECT e, name, alts, unnest(acr) AS a FROM i) WHERE length(a) > 2 AND upper(a) NOT IN ({_quoted(linking.BLOCKED_TICKERS)})),
 m AS (SELECT e, gvkey, 'exact_conm' AS m, 0.98 AS c FROM i JOIN n ON name = k UNION ALL SELECT e, gvkey, 'exact_alt', 0.98 FROM al JOIN n ON al.k = n.k
 UNION ALL SELECT e, gvkey, 'ticker_acronym', 0.97 FROM ac JOIN f ON k = tic WHERE contains(name, split_part(conm, ' ', 1)) OR len(list_filter(coalesce(alts, []), lambda a: contains(a, split_part(conm, ' ', 1)))) > 0 OR length(k) >= 4 OR left(k, 1) = left(conm, 1)
 UNION ALL SELECT e, gvkey, 'homepage_exact', 0.98 FROM i JOIN f ON i.host = f.host UNION ALL SELECT e, gvkey, 'abbreviation_dict', 0.95 FROM i JOIN ab ON name = short JOIN n ON k = long
 UNION ALL SELECT e, gvkey, 'firm_contained', 0.94 FROM i JOIN n ON contains(name, k) WHERE length(k) >= 8 AND k NOT IN ({_quoted(linking.GENERIC_NAMES)}) AND left(name, 1) = left(k, 1))
 {_BEST} AND c >= 0.94"""

SQL["cascade_first_hit"] = f"""WITH {_I}, {_F}, {_AB}, al AS (SELECT e, p, {_M1.format("a")} AS k FROM (SELECT e, unnest(alts) AS a, generate_subscripts(alts, 1) AS p FROM i)),
 alt AS (SELECT DISTINCT e, p, gvkey, w FROM (SELECT e, p, gvkey, 1 AS w FROM al JOIN f ON k = conm UNION ALL SELECT e, p, gvkey, 2 FROM al JOIN f ON k = conml)),
 w AS (SELECT DISTINCT e, unnest(regexp_split_to_array(name, '[^\\p{{L}}\\p{{N}}_]+')) AS k FROM i), ac AS (SELECT e, upper(unnest(acr)) AS k, generate_subscripts(acr, 1) AS p FROM i),
 acm AS (SELECT DISTINCT e, p, gvkey FROM ac JOIN f ON k = tic),
 m AS (SELECT 1 AS s, e, gvkey, 'exact_conm' AS m, 0.98 AS c FROM i JOIN f ON name = conm UNION ALL SELECT 2, e, gvkey, 'exact_conml', 0.98 FROM i JOIN f ON name = conml
 UNION ALL SELECT 3, e, gvkey, CASE w WHEN 1 THEN 'alternative_name_conm' ELSE 'alternative_name_conml' END, 0.95 FROM alt WHERE (p, w) = (SELECT (p, w) FROM alt x WHERE x.e = alt.e ORDER BY p, w LIMIT 1)
 UNION ALL SELECT 4, e, gvkey, 'url_domain_match', 0.96 FROM i JOIN f ON i.host = f.host UNION ALL SELECT 5, e, gvkey, 'ticker_in_name', 0.96 FROM w JOIN f ON k = tic WHERE length(tic) >= 2
 UNION ALL SELECT 6, e, gvkey, 'firm_contained_conm', 0.95 FROM i JOIN f ON contains(name, conm) WHERE length(conm) >= 5 AND conm <> 'COMPANY'
 UNION ALL SELECT 7, e, gvkey, 'ticker_match', 0.95 FROM i JOIN f ON name = tic UNION ALL SELECT 8, e, gvkey, 'acronym_match', 0.95 FROM acm WHERE p = (SELECT min(p) FROM acm x WHERE x.e = acm.e)
 UNION ALL SELECT 9, e, gvkey, 'abbreviation_dict', 0.95 FROM i JOIN ab ON name = short JOIN f ON conm = long UNION ALL SELECT 10, e, gvkey, 'abbreviation_dict_reverse', 0.95 FROM i JOIN ab ON name = long JOIN f ON tic = short
 UNION ALL SELECT 11, e, gvkey, 'abbreviation_generated', 0.95 FROM i JOIN f ON name = {_INITIALS.format("conm")})
 {_FIRST}"""

SQL["patent_links"] = f"""WITH {_F}, {_AB}, i AS (SELECT DISTINCT clean_name AS e FROM patents_panel WHERE clean_name IS NOT NULL),
 x AS (SELECT e, gvkey, 'exact_conm' AS m, 0.98 AS c FROM i JOIN f ON e = conm UNION ALL SELECT e, gvkey, 'exact_conml', 0.98 FROM i JOIN f ON e = conml), r AS (SELECT * FROM f WHERE gvkey NOT IN (SELECT gvkey FROM x WHERE gvkey IS NOT NULL)),
 w AS (SELECT DISTINCT e, unnest(regexp_split_to_array(upper(e), '[^\\p{{L}}\\p{{N}}_]+')) AS k FROM i),
 m AS (SELECT * FROM x UNION ALL SELECT e, gvkey, 'ticker_in_name', 0.97 FROM w JOIN r ON k = tic WHERE length(tic) >= 2 UNION ALL SELECT e, gvkey, 'firm_contained', 0.96 FROM i JOIN r ON contains(e, conm) WHERE length(conm) >= 5
 UNION ALL SELECT e, gvkey, 'abbreviation_generated', 0.95 FROM i JOIN r ON e = {_INITIALS.format("conm")} UNION ALL SELECT e, gvkey, 'abbreviation_dict', 0.95 FROM i JOIN ab ON e = short JOIN r ON conm = long
 UNION ALL SELECT e, gvkey, 'abbreviation_dict_reverse', 0.95 FROM i JOIN ab ON e = long JOIN r ON conm = short UNION ALL SELECT e, gvkey, 'ticker_match', 0.95 FROM i JOIN r ON e = tic)
 {_BEST}"""

SQL["homepage_match"] = f"""WITH {_I}, {_F} SELECT DISTINCT e AS entity_id, gvkey, 'homepage_exact' AS match_method, CAST(0.98 AS DOUBLE) AS match_confidence FROM i JOIN f ON i.host = f.host
 UNION ALL SELECT DISTINCT e, gvkey, 'homepage_root_domain', CAST(0.97 AS DOUBLE) FROM i JOIN f ON {_ROOT.format("i.host")} = {_ROOT.format("f.host")} WHERE {_ROOT.format("i.host")} <> i.host"""

_HOST = r"nullif(regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN regexp_matches({0}, '^https?://') THEN {0} ELSE 'http://' || {0} END, '^https?://([^/?#]*)', 1)), ':.*$', ''), '^www\.', ''), '')"
_IF = f"i AS (SELECT DISTINCT institution_id AS e, display_name, {_M1.format('display_name')} AS name, acronyms AS acr, parent_institution_ids AS parents, country_code, geo_city, name_variants AS variants, {_HOST.format('homepage_domain')} AS host FROM publication_institutions_master)"
_FF = f"f AS (SELECT DISTINCT gvkey, conm AS raw, {_M1.format('conm')} AS conm, {_M1.format('conml')} AS conml, tic, fic, city, busdesc, {_HOST.format('lower(weburl)')} AS host FROM compustat_firms_standardized)"

SQL["publication_links_enhanced"] = f"""WITH {_IF}, {_FF}, ac AS (SELECT e, upper(unnest(acr)) AS k FROM i),
 m AS (SELECT 1 AS s, e, gvkey, 'exact' AS m, 0.98 AS c FROM i JOIN f ON name = conm UNION ALL SELECT 2, e, gvkey, 'acronym_ticker', 0.97 FROM ac JOIN f ON k = tic UNION ALL SELECT 3, e, gvkey, 'domain', 0.98 FROM i JOIN f ON i.host = f.host),
 b AS ({_FIRST}) SELECT entity_id, min(gvkey) AS gvkey, min(match_method) AS match_method, min(match_confidence) AS match_confidence FROM b GROUP BY 1"""


# -- filters, samples and assessments --------------------------------------------------------------------------------------------------

_MEANING = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN (" + _quoted(linking.GENERIC_TERMS) + "))[1]"
_STEPS = {
    "blocked firm": f"gvkey NOT IN ({_quoted(linking.MATCHING_ANYTHING)})", "blocked method": "match_method NOT IN ('acronym_match', 'firm_contained_conm')",
    "generic term": f"len(list_filter(regexp_split_to_array(lower(i), '\\s+'), lambda w: w IN ({_quoted(linking.GENERIC_TERMS)}))) = 0",
    "short name": r"length(trim(regexp_replace(i, '(?i)\s+(INC|CORP|LLC|LTD|PLC|GMBH|AG)\.?$', ''))) >= 8",
    "low confidence": "match_confidence >= 0.96", "no word in common": f"{_MEANING.format('i')} = {_MEANING.format('f')}",
}


def _funnel_sql(steps: dict[str, str], rows: str) -> str:
    failed = " ".join(f"WHEN NOT coalesce({c}, false) THEN '{n}'" for n, c in steps.items())
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate(steps))
    return f"WITH r AS (SELECT CASE {failed} END AS step FROM ({rows})) SELECT step_no, v.step, count(r.step) AS removed FROM (VALUES {names}) v(step_no, step) LEFT JOIN r ON r.step = v.step GROUP BY 1, 2"


SQL["match_funnel"] = _funnel_sql(_STEPS, "SELECT *, institution_display_name AS i, firm_conm AS f FROM publication_firm_matches_stage1")

_UNSURE = {
    "blocked firm": f"coalesce(gvkey, 'N/A') NOT IN ({_quoted(linking.UNSURE_FIRMS)})",
    "blocked method": f"coalesce(match_method, '') NOT IN ({_quoted(linking.UNSURE_METHODS)})",
    "several firms": "rows_left = 1", "low confidence": "match_confidence >= 0.95",
}


@query(_funnel_sql(_UNSURE, f"""SELECT *, (SELECT count(*) FROM publication_firm_matches_stage1 x WHERE x.institution_id = p.institution_id AND {_UNSURE['blocked firm']} AND {_UNSURE['blocked method']}) AS rows_left FROM publication_firm_matches_stage1 p"""))
def match_funnel_mild(spark, d):
    steps = linking.unsure_steps()
    m = linking.with_rows_left(read(spark, d, "publication_firm_matches_stage1"), "institution_id", steps[:2])
    return linking.funnel(m, steps)[1]


def _assessment_sql() -> str:
    core = r"trim(regexp_replace(i, '\s*\([^)]*\)', '', 'g'))"
    generic = " OR ".join(f"contains(upper(i), '{w}')" for w in classify.GENERIC_ON_PAGES)
    pairs = [("correct", "Exact name match", "upper(k) = f"),
        ("correct", "Firm name in institution (subsidiary)", "length(f) > 8 AND contains(upper(i), f)"),
        ("incorrect", "AI name collision", "m = 'homepage_exact' AND contains(upper(i), 'AI ') AND k <> f")]
    pairs += [("uncertain", "Generic term in homepage match", f"m = 'homepage_exact' AND ({generic})"),
        ("correct", "Homepage exact match", "m = 'homepage_exact'"), ("uncertain", "Short acronym collision", "m = 'exact_alt' AND length(k) <= 4")]
    pairs += [("uncertain", "Name fragment possible collision", "m = 'exact_alt' AND length(k) < 10 AND NOT contains(f, k)"),
        ("correct", "Alternative name match", "m = 'exact_alt'"), ("uncertain", "Short ambiguous ticker", "m = 'ticker_acronym' AND length(k) <= 3")]
    pairs += [("correct", "Ticker in firm name", "m = 'ticker_acronym' AND contains(f, upper(k))"), ("correct", "Ticker acronym match", "m = 'ticker_acronym'")]
    pairs += [("incorrect", "Known name collision", f"contains(upper(i), '{a}') AND f = '{b}'") for a,
        b in classify.KNOWN_COLLISIONS] + [("incorrect", "Generic pattern mismatch",
        f"contains(upper(i), '{a}') AND contains(f, '{b}')") for a, b in classify.GENERIC_MISMATCHES]
    case = lambda n: " ".join(f"WHEN {c} THEN '{x[n]}'" for *x, c in pairs)
    return f"""WITH b AS (SELECT institution_display_name AS i, upper(firm_conm) AS f, match_method AS m FROM publication_firm_matches_stage1), s AS (SELECT *, {core} AS k FROM b)
 SELECT CASE {case(0)} ELSE 'uncertain' END AS prediction, CASE {case(1)} ELSE 'Requires manual verification' END AS reason, count(*) AS n FROM s GROUP BY 1, 2"""


SQL["match_assessment"] = _assessment_sql()
_KEYED = "(SELECT DISTINCT match_method, institution_id, gvkey, concat_ws('|', institution_id, gvkey) AS k FROM publication_firm_matches_stage1)"
_ORDER = "md5(concat_ws('|', k, '42'))"
SQL["stratified_sample"] = f"SELECT match_method, institution_id, gvkey, k FROM (SELECT *, row_number() OVER (PARTITION BY match_method ORDER BY {_ORDER}, k) AS r FROM {_KEYED}) WHERE r <= 10"
SQL["proportional_sample"] = f"""WITH t AS {_KEYED}, q AS (SELECT match_method, greatest(1, floor(50.0 * count(*) / (SELECT count(*) FROM t))) AS q FROM t GROUP BY 1), r AS (SELECT t.*, row_number() OVER (PARTITION BY match_method ORDER BY {_ORDER}, k) AS n FROM t)
 SELECT match_method, institution_id, gvkey, k FROM r JOIN q USING (match_method) ORDER BY CASE WHEN n > q THEN 1 ELSE 0 END, {_ORDER}, k LIMIT 50"""


@query(f"SELECT k FROM {_KEYED} ORDER BY {_ORDER}, k LIMIT 30")
def seeded_sample(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").select("match_method", "institution_id", "gvkey").distinct().withColumn("k",
        F.concat_ws("|", "institution_id", "gvkey"))
    return validate.sample(m, "k", 30).select("k")


_VERDICT = "CASE WHEN match_confidence IS NULL THEN '' WHEN match_confidence > 1 THEN 'Uncertain' WHEN match_confidence >= 0.96 THEN ' yes' ELSE 'No' END"


@query(f"""SELECT match_method, count(*) FILTER (v <> '') AS answered, count(*) FILTER (v = 'yes') AS yes, count(*) FILTER (v = 'no') AS no, count(*) FILTER (v = 'uncertain') AS uncertain,
 round(count(*) FILTER (v = 'yes') / nullif(CAST(count(*) FILTER (v IN ('yes', 'no')) AS DOUBLE), 0), 6) AS accuracy FROM (SELECT match_method, lower(trim({_VERDICT})) AS v FROM publication_firm_matches_stage1) GROUP BY 1""")
def accuracy_by_method(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").withColumn("v", F.expr(_VERDICT))
    return validate.accuracy_by(m, ["match_method"], "v").withColumn("accuracy", _r("accuracy", 6))


@query("""WITH t AS (SELECT match_method, count(*) AS n, CASE match_method WHEN 'exact_conm' THEN 1.0 WHEN 'contained_name' THEN 0.57 END AS r FROM publication_firm_matches_stage1 GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS links, round(sum(n * r) / sum(n), 6) AS estimated_accuracy FROM t WHERE r IS NOT NULL""")
def estimated_accuracy(spark, d):
    e = validate.estimated_accuracy(read(spark, d, "publication_firm_matches_stage1"), "match_method", {"exact_conm": 1.0, "contained_name": 0.57})
    return e.withColumn("estimated_accuracy", _r("estimated_accuracy", 6))


# -- further links ---------------------------------------------------------------------------------------------------------------------

_GROUPED = "coalesce(CASE " + " ".join(f"WHEN upper(trim({{0}})) IN ({_quoted(g)}) THEN '{g[0]}'" for g in linking
    .COUNTRY_GROUPS) + " END, nullif(upper(trim({0})), ''))"


@query(f"""WITH {_IF}, {_FF}, iv AS (SELECT DISTINCT e, {_GROUPED.format("country_code")} AS country, name, geo_city AS city, unnest(list_prepend(name, coalesce(variants, []))) AS a FROM i), fv AS (SELECT DISTINCT gvkey, {_GROUPED.format("fic")} AS country, city, busdesc, conm, unnest([conm, conml]) AS b FROM f),
 x AS (SELECT e, min(gvkey) AS gvkey FROM iv JOIN fv ON iv.country = fv.country AND a = b AND b = conm WHERE a <> '' GROUP BY 1),
 p AS (SELECT e, gvkey, jaro_winkler_similarity(a, b) AS s, least(0.99, 0.90 + (jaro_winkler_similarity(a, b) - 0.85) * 0.09 + 0.02 + CASE WHEN len(list_filter(list_distinct(string_split(name, ' ')), lambda w: contains(upper(busdesc), w))) >= 2 THEN 0.02 ELSE 0 END
 + CASE WHEN iv.city <> '' AND contains(fv.city, iv.city) THEN 0.01 ELSE 0 END) AS c FROM iv JOIN fv ON iv.country = fv.country WHERE a <> '' AND b <> '' AND jaro_winkler_similarity(a, b) >= 0.85 AND e NOT IN (SELECT e FROM x)),
 g AS (SELECT e, gvkey, round(max(s), 9) AS s, CAST(round(CAST(max(c) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS c FROM p GROUP BY 1, 2)
 SELECT e AS entity_id, gvkey, 'string_match' AS match_method FROM x UNION ALL SELECT e, gvkey, 'fuzzy_jaro_winkler' FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s DESC, gvkey) AS r FROM g) WHERE r = 1""")
def country_links(spark, d):
    i = _institutions_full(spark, d).withColumn("name", text.clean_organization_name(F.col("display_name")))
    return linking_more.country_links(i, _firms_full(spark, d)).drop("match_confidence")  # halves of the third digit round differently elsewhere


@query(f"""WITH {_IF}, {_FF}, u AS (SELECT e, unnest(list_slice(parents, 1, 3)) AS p FROM i) SELECT DISTINCT u.e AS entity_id, gvkey, 'parent_homepage' AS match_method, CAST(0.95 AS DOUBLE) AS match_confidence FROM u JOIN i ON u.p = i.e JOIN f ON i.host = f.host""")
def parent_host_links(spark, d):
    return linking.parent_hosts(_institutions_full(spark, d), _firms_full(spark, d))


@query("""WITH k AS (SELECT gvkey, upper(tic) AS k FROM compustat_firms_standardized WHERE tic IS NOT NULL UNION SELECT gvkey, unnest(name_variants) FROM compustat_firms_standardized)
 SELECT DISTINCT institution_id AS entity_id, gvkey, 'variant' AS match_method, CAST(0.9 AS DOUBLE) AS match_confidence FROM publication_institutions_master JOIN k ON normalized_name = k""")
def either_key_links(spark, d):
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"), F.col("normalized_name").alias("key")).dropna()
    return linking.either_key(i, read(spark, d, "compustat_firms_standardized").select("gvkey", "tic", "name_variants"), "variant", 0.9)


def _rules(spark, d) -> DataFrame:
    """Manual rules made of the tables: each firm's word, as a pattern for its ticker."""
    f = read(spark, d, "compustat_firms_standardized").filter("tic is not null and conml_clean is not null")
    return f.groupBy(F.substring_index("conml_clean", " ", 1).alias("pattern")).agg(F.min("tic").alias("tic"),
        F.min("gvkey").alias("g")).select(F.col("g").cast("int").alias("rule_no"), "pattern", "tic")


_RULES = "o AS (SELECT upper(trim(tic)) AS tic, max(gvkey) AS gvkey FROM compustat_firms_standardized WHERE tic IS NOT NULL GROUP BY 1), r AS (SELECT CAST(min(gvkey) AS INT) AS no, split_part(conml_clean, ' ', 1) AS pattern, min(tic) AS tic FROM compustat_firms_standardized WHERE tic IS NOT NULL AND conml_clean IS NOT NULL GROUP BY 2)"


@query(f"""WITH {_RULES}, x AS (SELECT DISTINCT institution_id AS e, normalized_name AS name FROM publication_institutions_master), m AS (SELECT e, no, gvkey FROM x JOIN r ON contains(name, pattern) JOIN o ON o.tic = r.tic WHERE pattern <> '')
 SELECT DISTINCT e AS entity_id, gvkey, 'manual' AS match_method, CAST(0.99 AS DOUBLE) AS match_confidence FROM m WHERE no = (SELECT min(no) FROM m y WHERE y.e = m.e)""")
def manual_contained_links(spark, d):
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"), F.col("normalized_name").alias("name")).distinct()
    return linking.manual_matches(i, read(spark, d, "compustat_firms_standardized"), _rules(spark, d), contained=True)


@query(f"""WITH {_RULES}, done AS (SELECT clean_name AS e FROM patents_panel JOIN compustat_firms_standardized ON clean_name = conml_clean) SELECT DISTINCT clean_name AS entity_id, gvkey, 'manual' AS match_method, CAST(0.99 AS DOUBLE) AS match_confidence
 FROM (SELECT clean_name, split_part(clean_name, ' ', 1) AS name FROM patents_panel WHERE clean_name NOT IN (SELECT e FROM done)) JOIN r ON name = pattern JOIN o ON o.tic = r.tic WHERE pattern <> ''""")
def manual_links(spark, d):
    f = read(spark, d, "compustat_firms_standardized")
    p = read(spark, d, "patents_panel").filter("clean_name is not null").select(F.col("clean_name").alias("entity_id"),
        F.substring_index("clean_name", " ", 1).alias("name")).distinct()
    done = p.join(f.select(F.col("conml_clean").alias("entity_id")), "entity_id", "left_semi")
    return linking.manual_matches(p, f, _rules(spark, d), matched=done)


def _texts(spark, d) -> DataFrame:
    """Raw affiliations with identifiers in them, made of the institutions' names and acronyms."""
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"), "display_name",
        F.try_element_at("acronyms", F.lit(1)).alias("a"), "normalized_name").distinct()
    return i.select("entity_id", F.when(F.col("a").isNotNull(),
        F.concat("display_name", F.lit(" ("), "a", F.lit(")"))).otherwise(F.col("display_name")).alias("text"), F.col("normalized_name").alias("name"))


@query(r"""WITH e AS (SELECT DISTINCT institution_id AS e, CASE WHEN acronyms[1] IS NOT NULL THEN display_name || ' (' || acronyms[1] || ')' ELSE display_name END AS text, normalized_name AS name FROM publication_institutions_master),
 t AS (SELECT tic AS k, min(gvkey) AS gvkey FROM compustat_firms_standardized WHERE tic IS NOT NULL GROUP BY 1 HAVING min(gvkey) = max(gvkey)), n AS (SELECT conml_clean AS k, min(gvkey) AS gvkey FROM compustat_firms_standardized WHERE conml_clean IS NOT NULL GROUP BY 1 HAVING min(gvkey) = max(gvkey)),
 x AS (SELECT e, name, nullif(regexp_extract(text, '\(([A-Z]{1,5})\)', 1), '') AS tic FROM e),
 m AS (SELECT 1 AS s, e, gvkey, 'ticker' AS m, 0.98 AS c FROM x JOIN t ON tic = k WHERE tic NOT IN ('THE', 'INC', 'CORP', 'LTD', 'LLC', 'USA', 'AND') UNION ALL SELECT 2, e, gvkey, 'unique_name', 0.97 FROM x JOIN n ON name = k) """ + _FIRST)
def identifier_links(spark, d):
    f = read(spark, d, "compustat_firms_standardized").select("gvkey", "tic", F.col("conml_clean").alias("conm_clean"),
        F.lit(None).cast("string").alias("cik"), F.lit(None).cast("string").alias("cusip6"))
    return linking.identifier_matches(_texts(spark, d), f)


@query("""WITH e AS (SELECT DISTINCT institution_id AS e, acronyms AS t, alternative_names AS n, parent_institution_ids AS p FROM publication_institutions_master), f AS (SELECT DISTINCT gvkey, upper(tic) AS tic, conm_clean, conml_clean, name_variants AS v FROM compustat_firms_standardized),
 k AS (SELECT gvkey, tic AS k FROM f WHERE tic IS NOT NULL UNION SELECT gvkey, unnest(v) FROM f), n AS (SELECT gvkey, upper(conm_clean) AS k FROM f WHERE conm_clean IS NOT NULL UNION SELECT gvkey, upper(conml_clean) FROM f WHERE conml_clean IS NOT NULL)
 SELECT DISTINCT e AS entity_id, gvkey, 'wikidata_ticker' AS match_method, CAST(0.98 AS DOUBLE) AS match_confidence FROM (SELECT e, upper(trim(unnest(t))) AS x FROM e) JOIN k ON x = k
 UNION ALL SELECT DISTINCT e, gvkey, 'wikidata_name', CAST(0.97 AS DOUBLE) FROM (SELECT e, upper(trim(unnest(n))) AS x FROM e) JOIN n ON x = k""")
def wikidata_links(spark, d):
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"),
        F.col("acronyms").alias("tickers"), F.col("alternative_names").alias("names"), F.col("parent_institution_ids").alias("parents"),
        F.array().cast("array<string>").alias("parent_tickers")).distinct()
    return linking_more.wikidata(i, read(spark, d, "compustat_firms_standardized"))


@query("""WITH e AS (SELECT DISTINCT institution_id AS e, upper(acronyms[1]) AS tic, geo_region AS state, display_name AS name FROM publication_institutions_master), f AS (SELECT DISTINCT gvkey, upper(tic) AS tic, state FROM compustat_firms_standardized), h AS (SELECT e, gvkey, e.state, f.state AS fs FROM e JOIN f ON e.tic = f.tic),
 c AS (SELECT e, count(DISTINCT gvkey) AS n FROM h GROUP BY 1), l AS (SELECT k, min(g) AS g FROM (SELECT split_part(lower(conm), ' ', 1) AS k, gvkey AS g FROM compustat_firms_standardized) WHERE length(k) >= 4 GROUP BY 1 HAVING min(g) = max(g)),
 m AS (SELECT 1 AS s, h.e, gvkey, 'wikidata_ticker' AS m, CASE WHEN n = 1 THEN 0.95 ELSE 0.93 END AS c FROM h JOIN c ON h.e = c.e WHERE n = 1 OR state = fs UNION ALL SELECT 2, e, g, 'first_word', 0.92 FROM e JOIN l ON split_part(lower(name), ' ', 1) = k) """ + _FIRST)
def enrichment_links(spark, d):
    i = read(spark, d, "publication_institutions_master").select(F.col("institution_id").alias("entity_id"),
        F.try_element_at("acronyms", F.lit(1)).alias("ticker"), F.col("geo_region").alias("state"), F.col("display_name").alias("name")).distinct()
    return linking_more.enrichment(i, read(spark, d, "compustat_firms_standardized"))


@query(f"""SELECT name, CASE WHEN contains(s, 'solutions') THEN 'known_patent_firm' WHEN {_like(linking_more.STRUCTURE_WORDS, 's')} THEN 'company_structure' WHEN {_like(linking_more.TECH_WORDS, 's')} THEN 'tech_indicator' END AS kind,
 CAST(CASE WHEN contains(s, 'solutions') THEN 0.90 WHEN {_like(linking_more.STRUCTURE_WORDS, 's')} THEN 0.75 WHEN {_like(linking_more.TECH_WORDS, 's')} THEN 0.70 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT conm AS name, lower(conm) AS s FROM compustat_firms_standardized WHERE conm IS NOT NULL)""")
def patent_capability(spark, d):
    f = read(spark, d, "compustat_firms_standardized").filter("conm is not null").select(F.col("conm").alias("name")).distinct()
    return f.select("name", linking_more.patent_capability(F.col("name"), ("solutions",)).alias("k")).select("name", "k.kind", "k.confidence")


# -- classes ---------------------------------------------------------------------------------------------------------------------------

_C1 = _c1_sql()
_C1_LADDER = _C1[_C1.index("CASE WHEN s = ''") : _C1.index(" AS kind FROM n")]
_SUMMARY = f"""WITH a AS (SELECT DISTINCT record_id, a FROM (SELECT record_id, unnest(flatten(author_affiliations)) AS a FROM ai_papers) WHERE a IS NOT NULL), c AS (SELECT a, {_C1_LADDER} AS kind FROM (SELECT DISTINCT a, trim(lower(a)) AS s FROM a)),
 n AS (SELECT record_id, count(*) AS t, count(*) FILTER (kind = 'firm') AS f, count(*) FILTER (kind = 'university') AS u, count(*) FILTER (kind = 'government') AS g, count(*) FILTER (kind = 'unknown') AS x FROM a JOIN c USING (a) GROUP BY 1),
 s AS (SELECT p.record_id, CAST(coalesce(t, 0) AS INT) AS total_affiliations, CAST(coalesce(f, 0) AS INT) AS firm_count, CAST(coalesce(u, 0) AS INT) AS university_count, CAST(coalesce(g, 0) AS INT) AS government_count, CAST(coalesce(x, 0) AS INT) AS unknown_count FROM ai_papers p LEFT JOIN n ON p.record_id = n.record_id)
 SELECT record_id, total_affiliations, firm_count, university_count, government_count, unknown_count, firm_count > 0 AS has_firm, university_count > 0 AS has_university, government_count > 0 AS has_government, CASE WHEN total_affiliations > 0 THEN CAST(firm_count AS DOUBLE) / total_affiliations ELSE 0 END AS firm_ratio,
 CASE WHEN total_affiliations = 0 THEN 'unknown' WHEN firm_count = greatest(firm_count, university_count, government_count, unknown_count) THEN 'firm' WHEN university_count = greatest(firm_count, university_count, government_count, unknown_count) THEN 'university'
 WHEN government_count = greatest(firm_count, university_count, government_count, unknown_count) THEN 'government' ELSE 'unknown' END AS primary_classification FROM s"""
SQL["paper_affiliation_summary"] = _SUMMARY
SQL["firm_papers"] = f"SELECT * FROM ({_SUMMARY}) WHERE has_firm AND firm_ratio >= 0.5"

_INST_IDS = "(SELECT DISTINCT record_id, i FROM (SELECT record_id, unnest(flatten(author_affiliation_ids)) AS i FROM ai_papers) WHERE i IS NOT NULL)"


@query(f"""WITH c AS (SELECT DISTINCT institution_id FROM publication_institutions_master WHERE institution_type = 'company') SELECT record_id, count(*) AS institutions, count(c.institution_id) AS firm_count, round(count(c.institution_id) / CAST(count(*) AS DOUBLE), 6) AS firm_ratio
 FROM {_INST_IDS} e LEFT JOIN c ON e.i = c.institution_id GROUP BY 1 HAVING count(c.institution_id) > 0""")
def firm_metrics_by_id(spark, d):
    p = read(spark, d, "ai_papers").select("record_id", F.flatten(F.filter("author_affiliation_ids", lambda x: x.isNotNull())).alias("ids"))
    c = read(spark, d, "publication_institutions_master").filter("institution_type = 'company'").select("institution_id")
    return classify.firm_metrics(p, c, "record_id", "ids").withColumn("firm_ratio", _r("firm_ratio", 6))


def _c5_sql() -> str:
    counted = ", ".join(f"count(*) FILTER (k = '{v}') AS {v.lower()}_count" for v in classify.EIGHT_CLASSES)
    case = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in classify.EIGHT_TYPES.items()) + " ELSE 'OTHER' END"
    return f"""WITH t AS (SELECT institution_id, min(institution_type) AS t FROM publication_institutions_master GROUP BY 1), e AS (SELECT record_id, i, {case} AS k FROM {_INST_IDS} LEFT JOIN t ON i = institution_id)
 SELECT record_id, count(*) AS total_affiliations, {counted}, round(count(*) FILTER (k = 'FIRM') / CAST(count(*) AS DOUBLE), 6) AS firm_ratio FROM e GROUP BY 1"""


@query(_c5_sql())
def institution_summary(spark, d):
    p = read(spark, d, "ai_papers").select("record_id", F.flatten(F.filter("author_affiliation_ids", lambda x: x.isNotNull())).alias("ids"))
    t = read(spark, d, "publication_institutions_master").groupBy("institution_id").agg(F.min("institution_type").alias("institution_type"))
    return classify.institution_summary(p, t, "record_id", "ids").withColumn("firm_ratio", _r("firm_ratio", 6))


_CODES = "[CASE p_size % 4 WHEN 0 THEN 'G06N' WHEN 1 THEN 'G06F' WHEN 2 THEN 'G06Q' ELSE 'A01B' END || '3/08', CASE WHEN p_size % 3 = 0 THEN 'H01L' ELSE 'A61K' END || '21/02']"
_PATENTS = f"(SELECT p_partkey, lower(p_name) AS s, {_CODES} AS c, p_size FROM part)"
_CPC = "CASE left({0}, 4) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.CPC_LABELS.items()) + " ELSE 'Unknown' END"
_VOTE = f"CASE WHEN {_CPC.format('c[1]')} = {_CPC.format('c[2]')} THEN {_CPC.format('c[1]')} ELSE {_CPC.format('c[1]')} END"


def _patents(spark, d) -> DataFrame:
    size = F.col("p_size") % 4
    a = F.when(size == 0, "G06N").when(size == 1, "G06F").when(size == 2, "G06Q").otherwise("A01B")
    codes = F.array(F.concat(a, F.lit("3/08")), F.concat(F.when(F.col("p_size") % 3 == 0, "H01L").otherwise("A61K"), F.lit("21/02")))
    return read(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), codes.alias("codes"), "p_size")


@query(f"""SELECT p_partkey, left(c[1], 4) IN ({_quoted(classify.AI_CPC)}) OR left(c[2], 4) IN ({_quoted(classify.AI_CPC)}) AS ai_by_code, {_VOTE} AS label, {_like(classify.SOFTWARE_WORDS, 's')} OR starts_with(c[1], 'G06F') OR starts_with(c[1], 'G06Q') AS software FROM {_PATENTS}""")
def patent_classes(spark, d):
    p = _patents(spark, d)
    return p.select("p_partkey", classify.is_ai_patent(F.col("text"), F.col("codes"), "cpc_only").alias("ai_by_code"),
        classify.cpc_label(F.col("codes")).alias("label"), classify.is_software_patent(F.col("text"), F.col("codes")).alias("software"))


@query("SELECT l_returnflag, count(*) AS kept FROM lineitem WHERE l_linenumber = 1 OR greatest(l_discount * 10, l_tax * 10) > 0.5 GROUP BY 1")
def ai_score_filter(spark, d):
    li = read(spark, d, "lineitem").filter(classify.ai_score_flag((F.col("l_linenumber") == 1).cast("int"), F.col("l_discount") * 10, F.col("l_tax") * 10))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("kept"))


def _tag_sql(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{f}'" for c, f in rules) + " END"


def _c12_sql() -> str:
    has = lambda w: f"contains(s, '{w}')"
    plain = [(f"{has('GOOGLE')} OR {has('ALPHABET')}", "GOOGLE"), (has("MICROSOFT"), "MICROSOFT"), (has("AMAZON"), "AMAZON"),
        (has("APPLE"), "APPLE"), (f"{has('META')} OR {has('FACEBOOK')}", "META")]
    ends = "(starts_with(s, 'META ') OR s = 'META' OR ends_with(s, ' META'))"
    barred = _like(classify.NOT_META, "s")
    careful = _tag_sql([(has("MICROSOFT"), "MICROSOFT"), (has("FACEBOOK"), "META")]).replace(" END",
        f" WHEN {ends} THEN CASE WHEN {barred} THEN NULL ELSE 'META' END {_tag_sql([(has(x), x) for x in ('AMAZON', 'GOOGLE', 'APPLE')])[5:]}")
    words = _tag_sql([("regexp_matches(lower(n), '\\b(" + "|".join(w) + ")\\b')", f) for f, w in classify.BIG_TECH_WORDS.items()])
    flag = "((starts_with(s, 'META ') OR contains(s, ' META') OR s = 'META' OR contains(s, 'FACEBOOK')) AND NOT " + barred + ")"
    return f"""WITH x AS (SELECT n, upper(n) AS s FROM (SELECT DISTINCT institution_name AS n FROM arxiv_paper_institutions WHERE institution_name IS NOT NULL UNION SELECT * FROM (VALUES {", ".join(f"('{w}')" for w in BIG_TECH_SAMPLES)})))
 SELECT n AS name, {_tag_sql(plain)} AS plain, {careful} AS careful, {words} AS words, {flag} AS meta_flag FROM x"""


#: Names that show the taggers' rules beside the table's own.
BIG_TECH_SAMPLES = ("Google Research", "Alphabet Inc", "Meta", "META AI", "Kennametal Inc", "Facebook Paris", "Pineapple Labs", "Apple",
    "AWS", "Amazon Science", "DeepMind", "Rheinmetall", "Deep Meta", "Microsoft Research Asia")


@query(_c12_sql())
def big_tech_taggers(spark, d):
    own = read(spark, d, "arxiv_paper_institutions").filter("institution_name is not null").select(F.col("institution_name").alias("name"))
    n = own.unionByName(spark.createDataFrame([(x,) for x in BIG_TECH_SAMPLES], "name string")).distinct()
    c = F.col("name")
    return n.select("name", classify.big_tech(F.upper(c)).alias("plain"), classify.big_tech_careful(c).alias("careful"),
        classify.big_tech_words(c, classify.BIG_TECH_WORDS).alias("words"), classify.meta_flag(c).alias("meta_flag"))


_C17 = _C1_LADDER
for _x in classify.UNCLEAR:
    _at = _C17.index(f"WHEN contains(s, '{_x}') THEN CASE")
    _C17 = _C17[:_at] + _C17[_C17.index(" END", _at) + 4 :].lstrip()


@query(f"SELECT n AS name, ({_C17}) = 'firm' AS firm FROM (SELECT DISTINCT institution_name AS n, trim(lower(institution_name)) AS s FROM arxiv_paper_institutions WHERE institution_name IS NOT NULL)")
def binary_firm_test(spark, d):
    n = read(spark, d, "arxiv_paper_institutions").filter("institution_name is not null").select(F.col("institution_name").alias("name")).distinct()
    return n.select("name", classify.is_firm(F.col("name")).alias("firm"))


# -- names and identifiers -------------------------------------------------------------------------------------------------------------


def _strip(c: str, suffixes: tuple[str, ...]) -> str:
    for s in suffixes:
        c = f"regexp_replace({c}, '(?s)^\\s*(.*?)\\s*{s}$', '\\1')"  # cut and trimmed where it ends so, else left as it is
    return c


def _normaliser_sql() -> str:
    low, brackets = "trim(lower(coalesce(n, '')))", r"regexp_replace(trim(lower(coalesce(n, ''))), '\s*\([^)]*\)', '', 'g')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    long_words = lambda x: f"array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an')), ' ')"
    inst = squeeze(f"replace({_strip(brackets, text.INSTITUTION_SUFFIXES)}, '&', 'and')")
    for a, b in text.INSTITUTION_ABBREVIATIONS:
        inst = f"replace({inst}, '{a}', '{b}')"
    places = r"regexp_replace(lower(coalesce(n, '')), '[[:punct:]]', '', 'g')"
    for p in text.PLACE_PHRASES:
        places = f"replace({places}, '{p}', ' ')"
    firm = _strip(brackets, text.FIRM_SUFFIXES)
    wiki = squeeze(f"regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_\\s&]', ' ', 'g')")
    columns = {
        "clean_organization_name": _M1.format("n"), "normalize_assignee": squeeze(f"replace({_strip(low, text.ASSIGNEE_SUFFIXES)}, '&', 'and')"), "normalize_aggressive": squeeze(long_words(f"replace({_strip(brackets, text.AGGRESSIVE_SUFFIXES)}, '&', 'and')")),
        "normalize_institution": f"trim({inst})", "normalize_filtered": squeeze(_strip(places, text.FILTERED_SUFFIXES)),
        "normalize_company_url": _strip(low, text.URL_SUFFIXES),
        "normalize_wikipedia": _strip(wiki, tuple(sorted(text.WIKI_SUFFIXES, key=len, reverse=True))),
        "normalize_firm": f"trim(regexp_replace(trim(regexp_replace({firm}, '^the ', '')), '^a ', ''))",
    }
    return "SELECT n AS display_name, " + ", ".join(f"{c} AS {k}" for k,
        c in columns.items()) + " FROM (SELECT DISTINCT display_name AS n FROM publication_institutions_master)"


SQL["normaliser_table"] = _normaliser_sql()


_BARE_NAME = r"regexp_replace(display_name, '\s*\([^)]*\)', '', 'g')"


@query(f"""SELECT institution_id, string_agg(DISTINCT v, '|' ORDER BY v) AS variants FROM (SELECT institution_id, unnest(list_concat([{_M1.format("display_name")}, {_M1.format(_BARE_NAME)}],
 list_transform(coalesce(alternative_names, []), lambda a: {_M1.format("a")}), list_transform(coalesce(acronyms, []), lambda a: upper(trim(a))))) AS v FROM publication_institutions_master) WHERE length(v) >= 2 GROUP BY 1""")
def institution_variants(spark, d):
    i = read(spark, d, "publication_institutions_master")
    v = i.select("institution_id", F.explode(text.institution_variants(F.col("display_name"), F.col("alternative_names"), F.col("acronyms"))).alias("v"))
    return v.groupBy("institution_id").agg(F.array_join(F.sort_array(F.collect_set("v")), "|").alias("variants"))


@query(r"""SELECT DISTINCT weburl, nullif(regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN regexp_matches(weburl, '^https?://') THEN weburl ELSE 'http://' || weburl END, '^https?://([^/?#]*)', 1)), ':.*$', ''), '^www\.', ''), '') AS host,
 nullif(regexp_extract(weburl, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS netloc FROM compustat_firms_standardized WHERE weburl IS NOT NULL""")
def host_forms(spark, d):
    w = read(spark, d, "compustat_firms_standardized").filter("weburl is not null").select("weburl").distinct()
    return w.select("weburl", identifiers.host(F.col("weburl")).alias("host"), identifiers.netloc(F.col("weburl")).alias("netloc"))


@query(r"""WITH x AS (SELECT DISTINCT gvkey, conm, tic, 'https://en.wikipedia.org/wiki/' || replace(conm, ' ', '_') || '#History' AS page, 'NYSE: ' || tic || ' and (' || tic || ') CIK 000' || gvkey || ' CUSIP: ' || gvkey || '109 http://www.wikidata.org/entity/Q' || gvkey AS t FROM compustat_firms_standardized WHERE conm IS NOT NULL AND tic IS NOT NULL)
 SELECT gvkey, conm, tic, nullif(trim(replace(replace(replace(replace(regexp_extract(page, 'en\.wikipedia\.org/wiki/([^#]*)', 1), '_', ' '), '%20', ' '), '%26', '&'), '%27', '''')), '') AS title, nullif(regexp_extract(t, '(Q\d+)', 1), '') AS wikidata, nullif(regexp_extract(t, '(?i)CIK[:\s]*(\d{6,10})', 1), '') AS cik,
 nullif(left(regexp_extract(t, '(?i)CUSIP[:\s]*(\d{6,9})', 1), 6), '') AS cusip, CASE WHEN tic IN ('THE', 'INC', 'CORP', 'LTD', 'LLC', 'USA', 'AND') THEN NULL WHEN regexp_matches(tic, '^[A-Z]{1,5}$') THEN tic ELSE nullif(regexp_extract(t, 'NYSE[:\s]*([A-Z]{1,5})', 1), '') END AS ticker FROM x""")
def identifier_table(spark, d):
    f = read(spark, d, "compustat_firms_standardized").filter("conm is not null and tic is not null").select("gvkey", "conm", "tic").distinct()
    page = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("conm", F.lit(" "), F.lit("_")), F.lit("#History"))
    t = F.concat(F.lit("NYSE: "), "tic", F.lit(" and ("), "tic", F.lit(") CIK 000"), "gvkey", F.lit(" CUSIP: "), "gvkey",
        F.lit("109 http://www.wikidata.org/entity/Q"), "gvkey")
    f = f.withColumns({"page": page, "t": t})
    return f.select("gvkey", "conm", "tic", identifiers.wikipedia_title(F.col("page")).alias("title"),
        identifiers.wikidata_id(F.col("t")).alias("wikidata"), identifiers.cik(F.col("t")).alias("cik"),
        identifiers.cusip6(F.col("t")).alias("cusip"), identifiers.ticker(F.col("t")).alias("ticker"))


@query("""SELECT record_id, try_cast(left(publication_date, 4) AS INT) AS year, CASE WHEN regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN dayofyear(try_cast(publication_date AS DATE)) END AS day_of_year, CASE WHEN regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN strftime(try_cast(publication_date AS DATE), '%Y-%m') END AS month FROM ai_papers""")
def date_parts(spark, d):
    p = read(spark, d, "ai_papers")
    c = F.col("publication_date")
    return p.select("record_id", identifiers.year_of(c).alias("year"), identifiers.day_of_year(c).alias("day_of_year"), identifiers.month_of(c).alias("month"))


# -- records ---------------------------------------------------------------------------------------------------------------------------

_WORK = f"s0 AS (SELECT record_id, CASE WHEN json_valid(work_json) THEN CAST(work_json AS JSON) END AS j FROM openalex_work_json), {', '.join(_step(i) for i in range(1, 5))}"
_RAW_WORDS = ("inc", "corp", "ltd", "llc", "gmbh", "research")
SQL["authorship_rows"] = f"""WITH {_WORK}, w AS (SELECT record_id, j->>'$.id' AS openalex_id, try_cast(j->>'$.publication_year' AS INT) AS publication_year, unnest({_items("j->'authorships'")}) AS a FROM s4 WHERE j IS NOT NULL),
 b AS (SELECT openalex_id, publication_year, a->'author'->>'id' AS author_id, a->>'$.author_position' AS author_position, try_cast(a->>'$.is_corresponding' AS BOOLEAN) AS is_corresponding, {_items("a->'institutions'")} AS ins FROM w),
 c AS (SELECT openalex_id, publication_year, author_id, author_position, is_corresponding, CASE WHEN json_type(i) = 'NULL' THEN NULL ELSE i END AS i, i IS NOT NULL AND json_type(i) <> 'NULL' AS h FROM (SELECT *, unnest(CASE WHEN len(ins) = 0 THEN [NULL] ELSE ins END) AS i FROM b))
 SELECT openalex_id, publication_year, author_id, author_position, is_corresponding, i->>'$.id' AS institution_id, i->>'$.display_name' AS institution_name, i->>'$.type' AS institution_type, i->>'$.country_code' AS country_code, h AS has_institution, 'institutions' AS source FROM c"""


@query("""WITH t AS (SELECT record_id, unnest(topic_names) AS t FROM ai_papers) SELECT t AS item, count(*) AS n, count(DISTINCT record_id) AS records FROM t WHERE trim(t) <> '' GROUP BY 1""")
def topic_counts(spark, d):
    return metrics.list_counts(read(spark, d, "ai_papers"), "record_id", F.col("topic_names"))


@query("""WITH t AS (SELECT record_id, unnest(flatten(author_affiliation_countries)) AS t FROM ai_papers) SELECT t AS item, count(*) AS n, count(DISTINCT record_id) AS records FROM t WHERE trim(t) <> '' GROUP BY 1""")
def country_counts(spark, d):
    return metrics.list_counts(read(spark, d, "ai_papers"), "record_id", F.flatten(F.filter("author_affiliation_countries", lambda x: x.isNotNull())))


@query("""SELECT publication_year, count(*) AS papers, CAST(sum(cited_by_count) AS BIGINT) AS citations, round(avg(cited_by_count), 4) AS mean_citations, max(cited_by_count) AS most, count(*) FILTER (cited_by_count = 0) AS uncited FROM ai_papers GROUP BY 1""")
def citation_counts(spark, d):
    c = F.col("cited_by_count")
    return panel.entity_year(read(spark, d, "ai_papers"), ["publication_year"], papers=F.count("*"), citations=F.sum(c),
        mean_citations=_r(F.avg(c)), most=F.max(c), uncited=F.count_if(c == 0))


@query("""SELECT record_id, array_to_string(list_distinct(list_filter(list_concat(coalesce(topic_names, []), coalesce(author_names, [])), lambda x: x IS NOT NULL)), '') IS NOT NULL AS known, len(list_distinct(list_filter(list_concat(coalesce(topic_names, []), coalesce(author_names, [])), lambda x: x IS NOT NULL))) AS items,
 CASE WHEN least(len(topic_names), len(author_names)) > 0 THEN round(len(list_intersect(topic_names, author_names)) / CAST(least(len(topic_names), len(author_names)) AS DOUBLE), 6) ELSE 0 END AS overlap, coalesce(array_to_string(topic_names[1:2], '|'), '') AS first_two FROM ai_papers WHERE topic_names IS NOT NULL AND author_names IS NOT NULL""")
def list_operations(spark, d):
    p = read(spark, d, "ai_papers").filter("topic_names is not null and author_names is not null")
    union = records.ordered_union(F.col("topic_names"), F.col("author_names"))
    return p.select("record_id", F.lit(True).alias("known"), F.size(union).cast("long").alias("items"),
        _r(text.overlap_ratio(F.col("topic_names"), F.col("author_names")), 6).alias("overlap"),
        F.array_join(records.bounded(F.col("topic_names"), 2), "|").alias("first_two"))


_HINTS = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{w}') THEN '{k}'" for w, k in classify.COUNTRY_HINTS) + " END"
_RAW = "concat_ws(', ', institution_name, CASE country_code WHEN 'DE' THEN 'Lab 3, Germany' WHEN 'US' THEN 'Plant, USA' ELSE country_code END)"


@query(f"""WITH r AS (SELECT DISTINCT {_RAW} AS raw FROM arxiv_paper_institutions WHERE institution_name IS NOT NULL), p AS (SELECT raw, list_transform(string_split(raw, ','), lambda x: trim(x)) AS p FROM r)
 SELECT raw, p[1] AS institution_name, nullif(array_to_string(p[2:], ', '), '') AS location, list_filter(list_transform(list_reverse(p[2:]), lambda x: {_HINTS.format("x")}), lambda x: x IS NOT NULL)[1] AS country_code, {_like(classify.COMPANY_HINTS, "lower(p[1])")} AS is_company_likely FROM p""")
def raw_affiliations(spark, d):
    place = F.when(F.col("country_code") == "DE", "Lab 3, Germany").when(F.col("country_code") == "US", "Plant, USA").otherwise(F.col("country_code"))
    r = read(spark, d, "arxiv_paper_institutions").filter("institution_name is not null").select(F.concat_ws(", ", "institution_name",
        place).alias("raw")).distinct()
    return r.select("raw", classify.raw_affiliation(F.col("raw")).alias("s")).select("raw", "s.*")


_AUTHOR = "CASE WHEN author_position = 'first' THEN author_display_name || ' (' || institution_name || ')' WHEN author_position = 'last' THEN author_display_name || ', ' || institution_name ELSE author_display_name END"
_LAST = "trim(string_split(a, ',')[-1])"
_IN_BRACKETS = r"regexp_matches(a, '^(.+?)\s*\(([^)]+)\)\s*$')"


@query(rf"""WITH r AS (SELECT DISTINCT {_AUTHOR} AS a FROM arxiv_paper_institutions WHERE author_display_name IS NOT NULL AND institution_name IS NOT NULL)
 SELECT a AS author, nullif(CASE WHEN {_IN_BRACKETS} THEN trim(regexp_extract(a, '^(.+?)\s*\(([^)]+)\)\s*$', 1)) WHEN contains(a, ',') AND {_like(classify.AFFILIATION_HINTS, f"lower({_LAST})")} THEN trim(left(a, length(a) - length(string_split(a, ',')[-1]) - 1)) ELSE trim(a) END, '') AS name,
 nullif(CASE WHEN {_IN_BRACKETS} THEN trim(regexp_extract(a, '^(.+?)\s*\(([^)]+)\)\s*$', 2)) WHEN contains(a, ',') AND {_like(classify.AFFILIATION_HINTS, f"lower({_LAST})")} THEN {_LAST} END, '') AS affiliation FROM r""")
def author_affiliations(spark, d):
    r = read(spark, d, "arxiv_paper_institutions").filter("author_display_name is not null and institution_name is not null").select(F
        .expr(_AUTHOR).alias("author")).distinct()
    return r.select("author", classify.author_affiliation(F.col("author")).alias("s")).select("author", "s.*")


_AGGRESSIVE = f"trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(replace({{0}}, '&', 'and'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an')), ' '), '\\s+', ' ', 'g'))"


def _aggressive(c: str) -> str:
    return _AGGRESSIVE.format(_strip(rf"regexp_replace(trim(lower(coalesce({c}, ''))), '\s*\([^)]*\)', '', 'g')", text.AGGRESSIVE_SUFFIXES))


SQL["firm_to_institution_links"] = f"""WITH i AS (SELECT DISTINCT institution_id AS e, display_name AS raw, {_aggressive("display_name")} AS k FROM publication_institutions_master), f AS (SELECT * FROM (SELECT DISTINCT gvkey, tic, {_aggressive("conm")} AS k FROM compustat_firms_standardized) WHERE length(k) >= 3)
 SELECT DISTINCT e AS entity_id, gvkey, 'exact_normalized' AS match_method, CAST(0.98 AS DOUBLE) AS match_confidence FROM i JOIN f ON i.k = f.k UNION ALL SELECT DISTINCT e, gvkey, 'subsidiary_pattern', CAST(0.95 AS DOUBLE) FROM i JOIN f ON starts_with(lower(raw) || ' ', f.k || ' ')
 UNION ALL SELECT DISTINCT e, gvkey, 'ticker', CAST(0.97 AS DOUBLE) FROM (SELECT e, unnest(regexp_extract_all(upper(raw), '[(\\[]([A-Z.]{{1,6}})[)\\]]', 1)) AS t FROM i) JOIN f ON t = upper(tic)"""

_TITLE = _strip("trim(lower(coalesce(nullif(trim(replace(replace(replace(regexp_extract(display_name, '^([^#]*)', 1), '%20', ' '), '%26', '&'), '%27', '''')), ''), '')))", text.URL_SUFFIXES)
SQL["smart_url_links"] = f"""WITH {_IF}, {_FF}, t AS (SELECT DISTINCT e, {_TITLE} AS k FROM i), w AS (SELECT e, gvkey, 0.98 AS c FROM t JOIN f ON contains(lower(conm), k) WHERE length(k) >= 4 UNION ALL SELECT e, gvkey, 0.97 FROM t JOIN f ON contains(lower(conml), k) WHERE length(k) >= 4),
 u AS (SELECT e, unnest(list_slice(parents, 1, 3)) AS p FROM i),
 m AS (SELECT 1 AS s, e, gvkey, 'wikipedia_name' AS m, max(c) AS c FROM w GROUP BY 2, 3 UNION ALL SELECT 2, e, gvkey, 'homepage_exact', 0.98 FROM i JOIN f ON i.host = f.host
 UNION ALL SELECT 3, e, gvkey, 'homepage_root', 0.96 FROM i JOIN f ON {_ROOT.format("i.host")} = {_ROOT.format("f.host")} WHERE {_ROOT.format("i.host")} <> i.host UNION ALL SELECT 4, u.e, gvkey, 'parent_homepage', 0.95 FROM u JOIN i ON u.p = i.e JOIN f ON i.host = f.host)
 {_FIRST}"""

_SAME_COUNTRY = "coalesce(upper(country_code) = upper(fic)" + "".join(f" OR (upper(country_code) IN ({_quoted(g)}) AND upper(fic) IN ({_quoted(g)}))" for g in linking.COUNTRY_GROUPS) + ", false)"
_BARE = lambda c: f"regexp_replace(upper({c}), '{_NO_WORD}', '', 'g')"
_PLACE = lambda a, b: f"coalesce({_BARE(a)} <> '' AND {_BARE(b)} <> '' AND (contains({_BARE(a)}, {_BARE(b)}) OR contains({_BARE(b)}, {_BARE(a)})), false)"
_WORDS = r"list_filter(list_distinct(regexp_extract_all(upper(display_name), '\b([A-Z]{2,})\b', 1)), lambda w: contains(upper(busdesc), w))"
SQL["publication_links_fuzzy"] = f"""WITH i AS (SELECT DISTINCT institution_id AS e, display_name, name_variants AS v, country_code, geo_city AS i_city, geo_region, {_HOST.format("homepage_domain")} AS i_host FROM publication_institutions_master),
 f AS (SELECT DISTINCT gvkey, name_variants AS v, fic, city AS f_city, state, busdesc, {_HOST.format("lower(weburl)")} AS f_host FROM compustat_firms_standardized),
 p AS (SELECT e, gvkey, max(jaro_winkler_similarity(a, b)) AS s FROM (SELECT DISTINCT e, unnest(v) AS a FROM i) JOIN (SELECT DISTINCT gvkey, unnest(v) AS b FROM f) ON a <> '' AND b <> '' AND jaro_winkler_similarity(a, b) >= 0.85 GROUP BY 1, 2),
 c AS (SELECT e, gvkey, s, CAST({_SAME_COUNTRY} AS INT) AS k1, CAST(coalesce(len({_WORDS}) >= 2 OR len(list_filter({_WORDS}, lambda w: length(w) >= 6)) > 0, false) AS INT) AS k2, CAST({_PLACE("i_city", "f_city")} OR {_PLACE("geo_region", "state")} AS INT) AS k3,
 CAST(coalesce(i_host = f_host OR (length(i_host) > 3 AND length(f_host) > 3 AND (contains(i_host, f_host) OR contains(f_host, i_host))), false) AS INT) AS k4 FROM p JOIN i USING (e) JOIN f USING (gvkey)),
 g AS (SELECT *, least(0.99, least(0.99, 0.90 + (s - 0.85) * 0.09 / 0.14) + 0.02 * k1 + 0.02 * k2 + 0.01 * (k3 + k4)) AS q FROM c)
 SELECT DISTINCT e AS entity_id, gvkey, 'jaro_winkler' AS match_method FROM g WHERE k1 + k2 + k3 + k4 >= CASE WHEN round(q, 3) < 0.95 THEN 2 ELSE 1 END"""

# -- panels, measures, readers and sinks -----------------------------------------------------------------------------------------------


@query("""SELECT clean_name, patent_year AS year, count(DISTINCT total_ai_patents) AS total_ai_patents, round(avg(avg_ai_score), 8) AS avg_ai_score, min(assignee_id) AS assignee_id FROM patents_panel WHERE clean_name IS NOT NULL GROUP BY 1, 2""")
def assignee_year_panel(spark, d):
    p = read(spark, d, "patents_panel").select("clean_name", F.col("patent_year").alias("year"),
        F.col("total_ai_patents").alias("patent_id"), F.col("avg_ai_score").alias("score"), "assignee_id")
    return panel.assignee_year(p).withColumn("avg_ai_score", _r("avg_ai_score", 8))


@query("SELECT assignee_id, min(patent_year) AS first_year, max(patent_year) AS last_year, false AS ma_adjusted, CAST(NULL AS VARCHAR) AS acquirer_gvkey, CAST(NULL AS INT) AS acquisition_year FROM patents_panel GROUP BY 1")
def assignee_span(spark, d):
    return panel.with_ma_columns(panel.entity_span(read(spark, d, "patents_panel"), "assignee_id", "patent_year"))


@query("""SELECT gvkey, institution_id, institution_paper_count, CAST(sum(institution_paper_count) OVER (PARTITION BY gvkey) AS BIGINT) AS total_papers_per_firm FROM publication_firm_matches_stage1""")
def papers_per_firm(spark, d):
    m = read(spark, d, "publication_firm_matches_stage1").select("gvkey", "institution_id", "institution_paper_count")
    return metrics.total_of_group(m, "gvkey", "institution_paper_count", "total_papers_per_firm")


_BINS = [(1.0, 1.0, "Perfect (1.0)"), (0.95, 0.999, "Very High (0.95-0.999)"), (0.90, 0.949, "High (0.90-0.949)"),
    (0.80, 0.899, "Medium-High (0.80-0.899)"), (0.0, 0.799, "Low (<0.80)")]


@query(" UNION ALL ".join(f"SELECT {i} AS bin_no, '{t}' AS label, count(*) FILTER ({'match_confidence = ' + str(a) if a == b else f'match_confidence >= {a} AND match_confidence < {b}'}) AS n, round(count(*) FILTER ({'match_confidence = ' + str(a) if a == b else f'match_confidence >= {a} AND match_confidence < {b}'}) * 100.0 / count(*), 4) AS pct FROM publication_firm_matches_stage1" for i, (a, b, t) in enumerate(_BINS)))
def confidence_bins(spark, d):
    return metrics.interval_counts(read(spark, d, "publication_firm_matches_stage1"), "match_confidence", _BINS)


@query("SELECT count(*) AS rows, count(*) FILTER (work_json LIKE '%\"authorships\"%') AS with_authorships, count(*) FILTER (work_json LIKE '%\"lineage\"%') AS with_lineage FROM openalex_work_json")
def like_coverage(spark, d):
    return metrics.like_counts(read(spark, d, "openalex_work_json"), "work_json", {"with_authorships": '%"authorships"%', "with_lineage": '%"lineage"%'})


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM compustat_firms_standardized WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY n DESC, value LIMIT 3)" for c in ("fic", "state", "lpermno")))
def column_examples(spark, d):
    return metrics.column_examples(read(spark, d, "compustat_firms_standardized"), ["fic", "state", "lpermno"])


@query("""SELECT 'publication_date' AS column_name, count(d) AS dates, min(d) AS first_day, max(d) AS last_day FROM (SELECT CASE WHEN regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') THEN try_cast(left(publication_date, 10) AS DATE) END AS d FROM ai_papers)
 UNION ALL SELECT 'title', count(d), min(d), max(d) FROM (SELECT CASE WHEN regexp_matches(title, '^\\d{4}-\\d{2}-\\d{2}') THEN try_cast(left(title, 10) AS DATE) END AS d FROM ai_papers)""")
def date_range_profile(spark, d):
    return metrics.date_ranges(read(spark, d, "ai_papers"), ["publication_date", "title"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, {n} AS columns, (SELECT count(*) FROM {t}) AS rows" for t,
    n in (("orders", 6), ("nation", 3), ("region", 2))))
def table_shapes(spark, d):
    return readers.shape({t: read(spark, d, t) for t in ("orders", "nation", "region")})


@query("SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def merged_files(spark, d):
    return readers.parquet(spark, f"{d}/nation.parquet", f"{d}/region.parquet", merge=True)


def _round_trip(spark, df: DataFrame, write, read_back) -> DataFrame:
    """What comes back of a table that was written; the files are gone afterwards."""
    path = work_path(spark, "trip")
    try:
        write(df, path)
        return cut(read_back(path))
    finally:
        remove(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return _round_trip(spark, o, sinks.csv, lambda p: readers.csv(spark, p, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"))


@query("SELECT gvkey, conm, tic FROM compustat_firms_standardized")
def json_lines_round_trip(spark, d):
    f = read(spark, d, "compustat_firms_standardized").select("gvkey", "conm", "tic")
    return _round_trip(spark, f, lambda df, p: df.write.option("compression", "gzip").json(p),
        lambda p: readers.json_lines(spark, p, "gvkey string, conm string, tic string"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def partitioned_parquet_round_trip(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return _round_trip(spark, o, lambda df, p: sinks.parquet(df, p, "o_orderstatus"), lambda p: readers.parquet(spark, p).select("o_orderkey", "o_orderstatus"))


@query("SELECT c_custkey AS id, c_name AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def append_unique_rows(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"))
    new = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("v"))
    return _round_trip(spark, old, lambda df, p: sinks.parquet(df, f"{p}/a"), lambda p: sinks.append_unique(spark, new, f"{p}/a", f"{p}/b", "id"))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS batch FROM orders")
def resumable_batches(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")

    def write(df: DataFrame, path: str) -> None:
        made = lambda b: df.filter(F.col("o_orderkey") % 4 == b)
        sinks.resumable(spark, [0, 1], path, made)
        sinks.resumable(spark, [0, 1, 2, 3], path, made)  # goes on where the first call ended

    return _round_trip(spark, o, write, lambda p: readers.parquet(spark, p))


@query("SELECT user_id, min(ts) AS ts FROM events GROUP BY 1")
def stream_first_events(spark, d):
    """The first event of each user, by a stream over the table's file that keeps its state in the target."""
    path = work_path(spark, "stream")
    try:
        events = read(spark, d, "events")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
        ingest.append_first(ingest.file_stream(spark, f"{d}/event[s].parquet", schema), "user_id", "ts", f"{path}/out", f"{path}/log")
        return cut(spark.read.parquet(f"{path}/out").select("user_id", "ts"))
    finally:
        remove(spark, path)


@query()
def legacy_links_aggressive(spark, d):
    """The second variant of the older matcher: a lower limit, lower confidences."""
    return linking_more.legacy(_institutions_full(spark, d), _firms_full(spark, d), 0.95, 0.98, 0.60, 80.0, 0.85)


@query()
def legacy_links_firm_level(spark, d):
    """The third variant of the older matcher."""
    return linking_more.legacy(_institutions_full(spark, d), _firms_full(spark, d), 0.95, 0.98, 0.70, 87.0, 0.90)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
