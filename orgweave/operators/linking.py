"""Linking organisations to firms: candidate generation, strategies with their confidences, cascades and filters.

Every strategy but the fuzzy ones is an equi-join: names, tickers, hosts, tokens and substrings become keys first. Fuzzy ones compare all
distinct texts in blocks (``near_texts``), since no key is shared by all pairs that reach their limits. A strategy gives rows of MATCH (entity_id, gvkey, match_method, match_confidence); where a name or ticker belongs to several firms all of
them come out, as in the rules these follow.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions import identifiers as ids
from orgweave.functions import similarity
from orgweave.functions.nearby import near
from orgweave.functions.text import NO_WORD, clean_organization_name, initials, overlap_ratio, squeeze
from orgweave.shared import cut

MATCH = ["entity_id", "gvkey", "match_method", "match_confidence"]
# ---- fixed values --------------------------------------------------------------------------------------------------------------------
GENERIC_NAMES = (
    "INTERNATIONAL", "GROUP", "SYSTEMS", "TECHNOLOGIES", "INNOVATIONS", "ASSOCIATES", "SOLUTIONS", "SERVICES", "RESEARCH", "LABORATORIES",
    "ENGINEERING", "ENERGY",
    "DEVELOPMENTS", "CONSULTING", "CORPORATION", "COMPANY", "INCORPORATED", "LIMITED", "ENTERPRISES", "INDUSTRIES", "HOLDINGS", "PARTNERS",
    "TECHNOLOGY", "GLOBAL", "WORLDWIDE",
)
BLOCKED_TICKERS = ("IT", "HP", "GM", "GE", "BA", "SA", "AP", "GT", "GS", "US", "UK")
ABBREVIATIONS = {
    "IBM": "INTERNATIONAL BUSINESS MACHINES", "AT&T": "AMERICAN TELEPHONE TELEGRAPH", "ATT": "AMERICAN TELEPHONE TELEGRAPH",
    "GE": "GENERAL ELECTRIC", "GM": "GENERAL MOTORS",
    "HP": "HEWLETT PACKARD", "HPE": "HEWLETT PACKARD ENTERPRISE", "JPM": "JPMORGAN CHASE", "JPMORGAN": "JPMORGAN CHASE", "BA": "BOEING", "CAT": "CATERPILLAR",
    "XOM": "EXXON MOBIL", "CVX": "CHEVRON", "WMT": "WALMART", "PG": "PROCTER GAMBLE", "KO": "COCA COLA", "PEP": "PEPSICO",
    "DIS": "WALT DISNEY", "NFLX": "NETFLIX",
    "TSLA": "TESLA", "META": "FACEBOOK", "GOOGL": "ALPHABET", "GOOG": "ALPHABET", "AMZN": "AMAZON", "MSFT": "MICROSOFT", "AAPL": "APPLE",
    "NVDA": "NVIDIA", "INTC": "INTEL",
    "AMD": "ADVANCED MICRO DEVICES", "QCOM": "QUALCOMM", "TXN": "TEXAS INSTRUMENTS", "AVGO": "BROADCOM", "CSCO": "CISCO", "ORCL": "ORACLE", "CRM": "SALESFORCE",
    "ADBE": "ADOBE", "NOW": "SERVICENOW", "PANW": "PALO ALTO NETWORKS", "ARM": "ARM HOLDINGS", "MRVL": "MARVELL", "MU": "MICRON TECHNOLOGY",
    "SKHYNIX": "SK HYNIX",
    "JNJ": "JOHNSON JOHNSON", "PFE": "PFIZER", "UNH": "UNITEDHEALTH GROUP", "ABT": "ABBOTT LABORATORIES", "MRK": "MERCK",
    "BMY": "BRISTOL MYERS SQUIBB", "LLY": "ELI LILLY",
    "GILD": "GILEAD SCIENCES", "AMGN": "AMGEN", "BIIB": "BIOGEN", "REGN": "REGENERON", "MMM": "3M", "HON": "HONEYWELL",
    "UPS": "UNITED PARCEL SERVICE", "FDX": "FEDEX",
    "CSX": "CSX CORPORATION", "NSC": "NORFOLK SOUTHERN", "UNP": "UNION PACIFIC", "BAC": "BANK OF AMERICA", "C": "CITIGROUP",
    "WFC": "WELLS FARGO", "GS": "GOLDMAN SACHS",
    "MS": "MORGAN STANLEY", "BLK": "BLACKROCK", "SCHW": "CHARLES SCHWAB", "AXP": "AMERICAN EXPRESS", "VZ": "VERIZON COMMUNICATIONS",
    "T": "AT&T", "TMUS": "T-MOBILE US",
    "NKE": "NIKE", "MCD": "MCDONALDS", "SBUX": "STARBUCKS", "HD": "HOME DEPOT", "LOW": "LOWES", "TJX": "TJX COMPANIES",
    "COP": "CONOCOPHILLIPS", "EOG": "EOG RESOURCES",
    "SLB": "SCHLUMBERGER", "HAL": "HALLIBURTON",
}
COUNTRY_GROUPS = (
    ("USA", "US"), ("UK", "GB", "ENG"), ("CHN", "CN"), ("JPN", "JP"), ("DEU", "DE"), ("FRA", "FR"), ("CAN", "CA"), ("AUS", "AU"),
    ("IND", "IN"), ("KOR", "KR"), ("NLD", "NL"),
    ("CHE", "CH"), ("SWE", "SE"), ("SGP", "SG"),
)
MATCHING_ANYTHING = ("019075", "031807", "038200", "120518", "327115")
UNSURE_FIRMS, UNSURE_METHODS = ("N/A", "025013"), ("homepage_root_domain",)
GENERIC_TERMS = (
    "international", "group", "groups", "system", "systems", "technologies", "technology", "innovations", "innovation", "associates",
    "solutions", "services", "scientific",
    "research", "laboratories", "engineering", "energy", "developments", "consulting", "consultants",
)
# --------------------------------------------------------------------------------------------------------------------------------------


# -- candidate generation --------------------------------------------------------------------------------------------------------------


def equal_keys(entities: DataFrame, firms: DataFrame, method: str, confidence: float) -> DataFrame:
    """Every pair of (entity_id, key) and (gvkey, key)."""
    pairs = entities.join(firms, "key").select("entity_id", "gvkey").distinct()
    return pairs.select("entity_id", "gvkey", F.lit(method).alias("match_method"), F.lit(confidence).alias("match_confidence"))


def first_key(entities: DataFrame, firms: DataFrame, method: str, confidence: float) -> DataFrame:
    """Of entities(entity_id, place, key) only the first key that any firm has counts."""
    pairs = entities.join(firms, "key")
    first = pairs.groupBy("entity_id").agg(F.min("place").alias("place"))
    return pairs.join(first, ["entity_id", "place"]).select("entity_id", "gvkey", F.lit(method).alias("match_method"),
        F.lit(confidence).alias("match_confidence")).distinct()


def token_pairs(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """Ids a, b of rows (id, tokens) that share at least min(least, tokens of a) tokens, and how many.

    Tokens are joined on the least frequent first: of each row only the tokens that are needed to find a partner (all but least - 1, in
    the order of rising frequency) are keys, so the most common words never build the groups; what the keys find is then counted whole.
    """
    x, y = (d.select("id", F.array_distinct("tokens").alias("tokens")).filter(F.size("tokens") > 0) for d in (a, b))
    every = x.select(F.explode("tokens").alias("t")).unionByName(y.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def keys(d: DataFrame) -> DataFrame:
        rare = d.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).join(every, "t")
        order = F.row_number().over(Window.partitionBy("id").orderBy("n", "t"))
        return rare.withColumn("no", order).filter(F.col("no") <= F.greatest(F.lit(1), F.col("size") - F.lit(least - 1))).select("id", "t")

    # one side keeps all tokens: a shared one is among the keys of the other whenever enough are shared
    left, right = keys(x), y.select("id", F.explode("tokens").alias("t"))
    cand = left.hint("merge").alias("l").join(right.alias("r"), "t").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    full = cand.join(x.select(F.col("id").alias("a"), F.col("tokens").alias("ta")),
        "a").join(y.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return full.select("a", "b", shared.alias("shared"), F.size("ta").alias("size_a")).filter(F.col("shared") >= F.least(F.lit(least),
        F.col("size_a"))).select("a", "b", "shared")


#: Letters of the piece by which a contained name is looked for.
PIECE = 8


def _pieces(name: Column, n: int) -> Column:
    """All distinct pieces of n letters of a name of n letters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n))))


def contained_pairs(entities: DataFrame, firms: DataFrame, least: int = PIECE) -> DataFrame:
    """J12, without loss: entity(entity_id, name) and firm(gvkey, name) with the firm's name inside the entity's.

    An entity has a key for each of its pieces of ``least`` letters; of a firm's name the piece that is rarest among distinct entity names
    is the key, so a beginning that a third of all names share builds no group. A name with a piece that no entity has is in none of
    them. Names shorter than that are left out, as the rules want; the whole name is compared after the join. Names meet once, however
    many entities and firms have them.
    """
    e = entities.filter(F.length("name") >= least).select("entity_id", F.col("name").alias("entity")).distinct()
    f = firms.filter(F.length("name") >= least).select("gvkey", F.col("name").alias("firm")).distinct()
    pieces = e.select("entity").distinct().select("entity", F.explode(_pieces(F.col("entity"), least)).alias("piece"))
    firm_pieces = f.select("firm").distinct().select("firm", F.explode(_pieces(F.col("firm"), least)).alias("piece"))
    often = pieces.join(firm_pieces.select("piece").distinct().hint("merge"), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = firm_pieces.join(often.hint("merge"), "piece", "left").groupBy("firm").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"),
        "piece")).alias("key"))
    keys = rarest.filter("key.n > 0").select("firm", "key.piece")
    named = pieces.hint("merge").join(keys, "piece").filter(F.col("entity").contains(F.col("firm"))).select("entity", "firm").distinct()
    return e.join(named, "entity").join(f, "firm").select("entity_id", "gvkey", "entity", "firm").distinct()


def word_pairs(entities: DataFrame, firms: DataFrame, least: int = 2) -> DataFrame:
    """Entities whose name has a firm's ticker as a word."""
    words = entities.select("entity_id", F.explode(F.array_distinct(F.split(F.upper("name"), r"[^\p{L}\p{N}_]+"))).alias("key"))
    return words.join(firms.filter(F.length("tic") >= least).select("gvkey", F.upper(F.trim("tic")).alias("key")).distinct(),
        "key").select("entity_id", "gvkey").distinct()


#: Most texts of either side in one block.
BLOCK_A, BLOCK_B = 2048, 8192


def near_texts(a: DataFrame, b: DataFrame, score: str, least: float, k: int | None = None, within: str | None = None) -> DataFrame:
    """J14, J15, J19, without loss: all pairs of texts a of a(text) and b of b(text, first) that score ``least`` or more; with k the k best of each a
    at least, where equal ones come by ``first`` (b's rows keep their least one). With ``within``, a column of both sides that comes out
    too, only texts of one value of it are compared (J16); its null is no value.

    Distinct texts are split into blocks by hash, and each block of one side meets each of the other in a task of its own, where bounds rule most
    pairs out: a limit so low has no key that all its pairs share, so the work grows with the product of the distinct texts."""
    group = [within] if within else []
    told = reduce(lambda c, g: c & F.col(g).isNotNull(), group, F.trim("text") != "")
    x = cut(a.filter(told).select("text", *group).distinct().withColumn("first", F.lit(None).cast("string")))
    y = cut(b.filter(told).groupBy("text", *group).agg(F.min("first").alias("first")))
    cores = x.sparkSession.sparkContext.defaultParallelism
    if within:  # blocks by the largest group; the groups themselves keep all cores busy
        most = lambda df: df.groupBy(within).count().agg(F.max("count")).first()[0] or 0
        wide, high = max(1, -(-most(y) // BLOCK_B)), max(1, -(-most(x) // BLOCK_A))
    else:
        wide = max(1, -(-y.count() // BLOCK_B))
        high = max(1, -(-x.count() // BLOCK_A), -(-2 * cores // wide))
    spot = lambda n: F.pmod(F.xxhash64("text"), F.lit(n))
    rows = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = x.withColumn("side", F.lit(0)).withColumn("block", F.explode(F.transform(rows(wide), lambda j: spot(high) * wide + j)))
    right = y.withColumn("side", F.lit(1)).withColumn("block", F.explode(F.transform(rows(high), lambda i: i * wide + spot(wide))))

    def meet(block: pa.Table) -> pa.Table:
        rows = sorted(zip(*(block[c].to_pylist() for c in ("side", "first", "text"))), key=lambda r: (r[0], r[1] or "", r[2]))
        t, u = ([r[2] for r in rows if r[0] == side] for side in (0, 1))
        found = near(t, u, score, least, k)
        out = {"a": pa.array([t[i] for i, _, _ in found], pa.string()), "b": pa.array([u[j] for _, j, _ in found], pa.string()),
            "score": pa.array([s for _, _, s in found], pa.float64())}
        for g in group:
            out[g] = pa.array([block[g][0].as_py()] * len(found), pa.string())
        return pa.table(out)

    blocks = left.unionByName(right).repartition(min(high * wide, 32 * cores), *group, "block")
    return blocks.groupBy(*group, "block").applyInArrow(meet, ", ".join(["a string", "b string", "score double", *[f"{g} string" for g in group]]))


def scored_pairs(pairs: DataFrame, a: str, b: str, score: str, least: float) -> DataFrame:
    """Similarity of two columns, computed once for each distinct pair of texts; pairs below the limit are left out."""
    texts = pairs.select(a, b).distinct()
    done = texts.withColumn("score", similarity.column(score)(F.col(a), F.col(b))).filter(F.col("score") >= least)
    return pairs.join(done, [a, b])


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_no", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_no") <= k).drop("_no")


# -- cascades --------------------------------------------------------------------------------------------------------------------------


def union_matches(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(MATCH) for p in parts])


def first_hit(*strategies: DataFrame, key: str = "entity_id") -> DataFrame:
    """Of each entity only the rows of the first strategy that has any. All strategies are cheap equi-joins: they run together, and one
    aggregate finds the first."""
    ranked = reduce(lambda a, b: a.unionByName(b), [s.select(MATCH).withColumn("_no", F.lit(i)) for i, s in enumerate(strategies)])
    first = ranked.groupBy(key).agg(F.min("_no").alias("_no"))
    return ranked.join(first, [key, "_no"]).drop("_no").select(MATCH)


def keep_best_match(matches: DataFrame) -> DataFrame:
    """Per entity and firm the method of greatest confidence (ties: by name of the method)."""
    best = F.min(F.struct((-F.col("match_confidence")).alias("c"), F.col("match_method").alias("m")))
    return matches.groupBy("entity_id", "gvkey").agg(best.alias("b")).select("entity_id", "gvkey", F.col("b.m").alias("match_method"),
        (-F.col("b.c")).alias("match_confidence"))


def _abbreviations(df_spark: DataFrame) -> DataFrame:
    return df_spark.sparkSession.createDataFrame(list(ABBREVIATIONS.items()), "short string, long string")


def patent_stage1(assignees: DataFrame, firms: DataFrame) -> DataFrame:
    """assignees(entity_id, name), firms(gvkey, conm_clean, conml_clean, tic), names cleaned.

    Firms with an exact name (.98) stop there; of the others ticker as a word (.97), firm contained (.96, five letters or more),
    initials (.95), abbreviations in both directions (.95) and ticker as the whole name (.95) all count.
    """
    e = assignees.select("entity_id", F.col("name").alias("key"))
    exact = union_matches(
        equal_keys(e, firms.select("gvkey", F.col("conm_clean").alias("key")).dropna(), "exact_conm", 0.98),
        equal_keys(e, firms.select("gvkey", F.col("conml_clean").alias("key")).dropna(), "exact_conml", 0.98),
    )
    exact = cut(exact)  # the other strategies start from what it leaves
    rest = cut(firms.join(exact.select("gvkey").distinct(), "gvkey", "left_anti"))
    as_name = rest.select("gvkey", F.col("conm_clean").alias("name"))
    words = word_pairs(assignees, rest.filter(F.col("tic").isNotNull()))
    inside = contained_pairs(assignees, as_name, 5)
    short = rest.select("gvkey", initials(F.col("conm_clean")).alias("key")).filter(F.length("key") >= 2)
    ab = _abbreviations(firms)
    from_long = rest.join(ab, F.col("conm_clean") == F.col("long")).select("gvkey", F.col("short").alias("key"))
    from_short = rest.join(ab, F.col("conm_clean") == F.col("short")).select("gvkey", F.col("long").alias("key"))
    tics = rest.select("gvkey", F.upper(F.trim("tic")).alias("key")).filter("key <> ''")
    tag = lambda p, m, c: p.select("entity_id", "gvkey", F.lit(m).alias("match_method"), F.lit(c).alias("match_confidence"))
    return union_matches(
        exact, tag(words, "ticker_in_name", 0.97), tag(inside, "firm_contained", 0.96), equal_keys(e, short, "abbreviation_generated", 0.95),
        equal_keys(e, from_long, "abbreviation_dict", 0.95), equal_keys(e, from_short, "abbreviation_dict_reverse", 0.95),
        equal_keys(e, tics, "ticker_match", 0.95),
    )


def patent_stage2(assignees: DataFrame, firms: DataFrame, k: int = 5) -> DataFrame:
    """Fuzzy names of assignees and firms unmatched so far: the k assignees of greatest ratio of at least 85 per firm, of all pairs of names; the
    best of three ratios gives .94 (90 and more) or .90; words of the assignee (four letters or more) in the business description add .05 or .03."""
    texts = near_texts(assignees.select(F.col("name").alias("text")),
        firms.select(F.col("conm_clean").alias("text"), F.col("gvkey").alias("first")), "ratio", 85.0)
    named = texts.select(F.col("a").alias("name"), F.col("b").alias("firm"), "score").join(assignees.select("entity_id", "name").distinct(),
        "name").join(firms.select("gvkey", F.col("conm_clean").alias("firm")).distinct(), "firm")
    once = named.groupBy("gvkey", "entity_id", "name").agg(F.max(F.struct(F.col("score").alias("r"), "firm")).alias("x")).select("gvkey",
        "entity_id", "name", "x.*")  # a firm may have several rows
    five = top_k(once, "gvkey", k, F.desc("r"), F.col("name"), F.col("entity_id"))
    full = five.join(firms.select("gvkey", F.col("conm_clean").alias("firm"), "busdesc").distinct(), ["gvkey", "firm"])
    best = F.greatest("r", similarity.column("partial_ratio")("name", "firm"), similarity.column("token_sort_ratio")("name", "firm"))
    hits = F.size(F.filter(F.split("name", " "), lambda w: (F.length(w) >= 4) & F.upper(F.col("busdesc")).contains(w)))
    boost = F.when(hits >= 2, 0.05).when(hits >= 1, 0.03).otherwise(0.0)
    base = F.when(F.col("best") >= 90, 0.94).otherwise(0.90)
    method = F.when(F.col("best") >= 90, "fuzzy_high").otherwise("fuzzy_medium")
    return full.withColumn("best", best).select("entity_id", "gvkey", method.alias("match_method"),
        F.round(F.least(base + F.coalesce(boost, F.lit(0.0)), F.lit(0.99)), 4).alias("match_confidence"))


def manual_matches(entities: DataFrame, firms: DataFrame, mapping: DataFrame, contained: bool = False, matched: DataFrame | None = None) -> DataFrame:
    """mapping(rule_no, pattern, tic). Equal names, or names that contain the pattern, where the first rule counts; .99.

    A ticker stands for one firm, that of the greatest gvkey. Entities of ``matched`` (entity_id) are left out."""
    owner = firms.select("gvkey", F.upper(F.trim("tic")).alias("tic")).filter("tic is not null").groupBy("tic").agg(F.max("gvkey").alias("gvkey"))
    rules = mapping.filter("pattern <> ''").hint("merge").join(owner, "tic")
    if matched is not None:
        entities = entities.join(matched.select("entity_id").distinct(), "entity_id", "left_anti")
    if not contained:
        pairs = entities.join(rules.withColumnRenamed("pattern", "name"), "name")
    else:
        width = 4  # shorter patterns are pieces as a whole
        piece = F.explode(F.array_distinct(F.flatten(F.array(*[F.when(F.length("name") >= n,
            _pieces(F.col("name"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, width + 1)])))).alias("piece")
        # Spark's estimate of the pieces leaves out how many each name has: unhinted it would broadcast them. Names and patterns meet once,
        # however many entities and rules have them
        names = entities.filter(F.length("name") > 0).select("name").distinct().select("name", piece)
        starts = rules.select("pattern").distinct().withColumn("piece", F.left("pattern", F.lit(width)))
        found = cut(names.hint("merge").join(starts, "piece").filter(F.col("name").contains(F.col("pattern"))).select("name", "pattern"))
        long = entities.hint("merge").join(found, "name").hint("merge").join(rules, "pattern")
        first = long.groupBy("entity_id").agg(F.min("rule_no").alias("rule_no"))
        pairs = long.hint("merge").join(first, ["entity_id", "rule_no"])
    return pairs.select("entity_id", "gvkey", F.lit("manual").alias("match_method"), F.lit(0.99).alias("match_confidence")).distinct()


def publications(institutions: DataFrame, firms: DataFrame, least: float = 0.94) -> DataFrame:
    """institutions(entity_id, name, alternatives, acronyms, host), firms(gvkey, conm_clean, conml_clean, tic, host).

    Exact names .98, tickers .97 (three letters or more; a word in common, four letters, or the same first letter), hosts .98,
    abbreviations .95, contained names .94 (eight letters, the same first letter, not generic); all count, the best per pair is kept.
    """
    by_name = firms.select("gvkey", F.col("conm_clean").alias("key")).unionByName(firms.select("gvkey", F.col("conml_clean").alias("key"))).dropna().distinct()
    own = institutions.select("entity_id", F.col("name").alias("key"))
    alt = institutions.select("entity_id", F.explode("alternatives").alias("alt")).select("entity_id",
        squeeze(F.regexp_replace(F.upper("alt"), NO_WORD, "")).alias("key"))
    acr = institutions.select("entity_id", "name", "alternatives", F.explode("acronyms").alias("acr")).select("entity_id", "name",
        "alternatives", F.upper("acr").alias("key"))
    acr = acr.filter((F.length("key") > 2) & ~F.col("key").isin(*BLOCKED_TICKERS))
    tic = acr.join(firms.select("gvkey", "conm_clean", F.upper(F.trim("tic")).alias("key")), "key")
    word = F.substring_index("conm_clean", " ", 1)
    alike = F.col("name").contains(word) | F.exists(F.coalesce("alternatives", F.array().cast("array<string>")), lambda a: a.contains(word))
    tic = tic.filter(alike | (F.length("key") >= 4) | (F.left("key", F.lit(1)) == F.left("conm_clean", F.lit(1))))
    hosts = equal_keys(institutions.select("entity_id", F.col("host").alias("key")).dropna(),
        firms.select("gvkey", F.col("host").alias("key")).dropna(), "homepage_exact", 0.98)
    ab = own.join(_abbreviations(firms), F.col("key") == F.col("short")).select("entity_id", F.col("long").alias("key"))
    inside = contained_pairs(institutions, by_name.select("gvkey", F.col("key").alias("name")).filter(~F.col("key").isin(*GENERIC_NAMES)),
        8).filter(F.left("entity", F.lit(1)) == F.left("firm", F.lit(1)))
    tag = lambda p, m, c: p.select("entity_id", "gvkey", F.lit(m).alias("match_method"), F.lit(c).alias("match_confidence")).distinct()
    every = union_matches(
        equal_keys(own, by_name, "exact_conm", 0.98), equal_keys(alt, by_name, "exact_alt", 0.98), tag(tic, "ticker_acronym", 0.97), hosts,
        equal_keys(ab, by_name, "abbreviation_dict", 0.95), tag(inside, "firm_contained", 0.94),
    )
    return keep_best_match(every).filter(F.col("match_confidence") >= least)


def publications_stage1(institutions: DataFrame, firms: DataFrame) -> DataFrame:
    """institutions(entity_id, name, alternatives, acronyms, host), firms(gvkey, conm_clean, conml_clean, tic, host), names cleaned.

    The first of exact name .98, exact long name .98, the first alternative name that is a firm's .95, host .96, ticker as a word .96, firm
    contained .95 (five letters or more, not COMPANY), and the abbreviations .95: ticker as the name, the first acronym that is a ticker,
    the dictionary in both directions, initials.
    """
    own = institutions.select("entity_id", F.col("name").alias("key"))
    conm, conml = (firms.select("gvkey", F.col(c).alias("key")).dropna().distinct() for c in ("conm_clean", "conml_clean"))
    alt = institutions.select("entity_id", F.posexplode("alternatives").alias("no", "alt")).select("entity_id", "no",
        clean_organization_name(F.col("alt")).alias("key")).filter("key is not null")
    met = alt.join(conm.withColumn("m", F.lit("alternative_name_conm")).unionByName(conml.withColumn("m", F.lit("alternative_name_conml"))), "key")
    first = met.groupBy("entity_id").agg(F.min(F.struct("no", "m")).alias("f"))
    alternative = met.join(first, "entity_id").filter(F.struct("no", "m") == F.col("f")).select("entity_id", "gvkey",
        F.col("m").alias("match_method"), F.lit(0.95).alias("match_confidence")).distinct()
    host = equal_keys(institutions.select("entity_id", F.col("host").alias("key")).dropna(),
        firms.select("gvkey", F.col("host").alias("key")).dropna(), "url_domain_match", 0.96)
    tag = lambda p, m, c: p.select("entity_id", "gvkey", F.lit(m).alias("match_method"), F.lit(c).alias("match_confidence"))
    words = tag(word_pairs(institutions, firms.filter(F.col("tic").isNotNull())), "ticker_in_name", 0.96)
    inside = tag(contained_pairs(institutions, conm.select("gvkey", F.col("key").alias("name")).filter("key <> 'COMPANY'"),
        5).select("entity_id", "gvkey").distinct(), "firm_contained_conm", 0.95)
    tics = firms.select("gvkey", F.upper(F.trim("tic")).alias("key")).filter("key <> ''").distinct()
    acronyms = institutions.select("entity_id", F.posexplode("acronyms").alias("place", "a")).select("entity_id", "place", F.upper("a").alias("key"))
    ab = _abbreviations(firms)
    by_short = own.join(ab, F.col("key") == F.col("short")).select("entity_id", F.col("long").alias("key"))
    by_long = own.join(ab, F.col("key") == F.col("long")).select("entity_id", F.col("short").alias("key"))
    short = conm.select("gvkey", initials(F.col("key")).alias("key")).filter(F.length("key") >= 2)
    return first_hit(
        equal_keys(own, conm, "exact_conm", 0.98), equal_keys(own, conml, "exact_conml", 0.98), alternative, host, words, inside,
        equal_keys(own, tics, "ticker_match", 0.95),
        first_key(acronyms, tics, "acronym_match", 0.95), equal_keys(by_short, conm, "abbreviation_dict", 0.95),
        equal_keys(by_long, tics, "abbreviation_dict_reverse", 0.95),
        equal_keys(own, short, "abbreviation_generated", 0.95),
    )


def same_country(a: Column, b: Column) -> Column:
    """Equal codes, or codes of one group; false for null."""
    x, y = F.upper(a), F.upper(b)
    either = x == y
    for g in COUNTRY_GROUPS:
        either = either | (x.isin(*g) & y.isin(*g))
    return F.coalesce(either, F.lit(False))


def stage2_confidence(score: Column, country: Column, business: Column, location: Column, url: Column) -> Column:
    """Base from a Jaro-Winkler score of .85 and more, boosts of .02, .02, .01 and .01, .99 at most; null unless two of the checks
    hold (one from .95 on)."""
    flags = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (country, business, location, url)), F.lit(0))
    base = F.least(F.lit(0.99), F.lit(0.90) + (score - 0.85) * 0.09 / 0.14)
    up = F.coalesce(country, F.lit(False)).cast("int") * 0.02 + F.coalesce(business,
        F.lit(False)).cast("int") * 0.02 + (F.coalesce(location, F.lit(False)).cast("int") + F.coalesce(url, F.lit(False)).cast("int")) * 0.01
    final = F.round(F.least(F.lit(0.99), base + up), 3)
    return F.when((score >= 0.85) & (flags >= F.when(final < 0.95, 2).otherwise(1)), final)


def wratio_confidence(score: Column) -> Column:
    """From WRatio 90 on, .05 more from 95 on, .92 at most."""
    return F.when(score >= 90, F.round(F.least(F.lit(0.92), 0.75 + (score - 90) * 0.015 + F.when(score >= 95, 0.05).otherwise(0.0)), 4))


def valid_overlap(a: Column, b: Column, score: Column) -> Column:
    """Half of the smaller word set in common, unless the score is 95 or more."""
    return (score >= 95) | (overlap_ratio(F.split(a, " "), F.split(b, " ")) >= 0.5)


def acronym_matches(institutions: DataFrame, firms: DataFrame, confidence: float = 0.97) -> DataFrame:
    """The first acronym that is a ticker, or an upper-case variant of at most six letters, of any firm; the method names which."""
    acr = institutions.select("entity_id", F.posexplode("acronyms").alias("place", "a")).select("entity_id", "place", F.upper(F.trim("a")).alias("key"))
    tics = firms.select("gvkey", F.upper(F.trim("tic")).alias("key"), F.lit("acronym_to_tic").alias("m")).filter("key is not null")
    variants = firms.select("gvkey", F.explode("name_variants").alias("key"),
        F.lit("acronym_to_name_variant").alias("m")).filter((F.length("key") <= 6) & (F.col("key") == F.upper("key")))
    pairs = acr.join(tics.unionByName(variants).distinct(), "key")
    first = pairs.groupBy("entity_id").agg(F.min("place").alias("place"))
    return pairs.join(first, ["entity_id", "place"]).select("entity_id", "gvkey", F.col("m").alias("match_method"),
        F.lit(confidence).alias("match_confidence")).distinct()


def homepage_matches(entities: DataFrame, firms: DataFrame) -> DataFrame:
    """Equal hosts .98, and equal root domains .97 where the host is not its root."""
    e, f = entities.filter("host is not null"), firms.filter("host is not null")
    root = ids.root_domain(F.col("host"))
    exact = equal_keys(e.select("entity_id", F.col("host").alias("key")), f.select("gvkey", F.col("host").alias("key")), "homepage_exact", 0.98)
    deep = e.withColumn("key", root).filter("key <> host").select("entity_id", "key")
    return exact.unionByName(equal_keys(deep, f.select("gvkey", root.alias("key")), "homepage_root_domain", 0.97))


def parent_cascade(institutions: DataFrame, matches: DataFrame, factor: float = 0.98) -> DataFrame:
    """An unmatched child takes all matches of its first matched parent; confidence x factor, three digits; the method is that of
    the parent, if it is known, after ``parent_cascade_``. Where institutions have a column ``children``, only parents that list some count."""
    children = institutions.join(matches.select("entity_id").distinct(), "entity_id", "left_anti")
    if "children" in institutions.columns:
        matches = matches.join(institutions.filter(F.size("children") > 0).select("entity_id").distinct(), "entity_id", "left_semi")
    parents = children.select("entity_id", F.posexplode("parents").alias("place", "parent"))
    named = F.concat(F.lit("parent_cascade_"), F.coalesce("match_method", F.lit(""))) if "match_method" in matches.columns else F.lit("parent_cascade")
    up = parents.join(matches.select(F.col("entity_id").alias("parent"), "gvkey", named.alias("match_method"), "match_confidence"), "parent")
    first = up.groupBy("entity_id").agg(F.min("place").alias("place"))
    return up.join(first, ["entity_id", "place"]).select("entity_id", "gvkey", "match_method",
        F.round(F.col("match_confidence") * factor, 3).alias("match_confidence")).distinct()


def parent_hosts(institutions: DataFrame, firms: DataFrame, confidence: float = 0.95, most: int = 3) -> DataFrame:
    """The host of one of the first parents is a firm's."""
    up = institutions.select("entity_id", F.explode(F.slice("parents", 1, most)).alias("parent")).join(institutions
        .select(F.col("entity_id").alias("parent"), F.col("host").alias("key")).dropna(), "parent")
    return equal_keys(up.select("entity_id", "key"), firms.select("gvkey", F.col("host").alias("key")).dropna(), "parent_homepage", confidence)


def identifier_matches(affiliations: DataFrame, firms: DataFrame) -> DataFrame:
    """affiliations(entity_id, text, name): CIK .99, CUSIP .99, ticker .98, then a name that exactly one firm has .97; the first counts."""
    from orgweave.operators.dedup import unique_matches

    def one(key: Column, firm_key: str, method: str, c: float) -> DataFrame:
        e = affiliations.select("entity_id", key.alias("key")).filter("key is not null")
        f = firms.select("gvkey", F.col(firm_key).alias("key")).dropna().distinct()
        return equal_keys(e.join(unique_matches(f, "key", "gvkey").select("key").distinct(), "key", "left_semi"), f, method, c)

    t = F.col("text")
    return first_hit(one(F.regexp_replace(ids.cik(t), "^0+", ""), "cik", "cik", 0.99), one(ids.cusip6(t), "cusip6", "cusip", 0.99),
        one(ids.ticker(t), "tic", "ticker", 0.98), one(F.col("name"), "conm_clean", "unique_name", 0.97))


def either_key(entities: DataFrame, firms: DataFrame, method: str, confidence: float) -> DataFrame:
    """The key is the firm's ticker or one of its variants: two equi-joins, not an OR."""
    a = firms.select("gvkey", F.upper("tic").alias("key")).dropna()
    b = firms.select("gvkey", F.explode("name_variants").alias("key"))
    return equal_keys(entities, a.unionByName(b).distinct(), method, confidence)


# -- filters ---------------------------------------------------------------------------------------------------------------------------


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all steps, step and rows it removed): the counts come from one pass, each row counted at the first step it fails."""
    failed = reduce(lambda acc, s: F.when(acc.isNotNull(), acc).when(~F.coalesce(s[1], F.lit(False)), s[0]), steps, F.lit(None).cast("string"))
    marked = df.withColumn("_failed", failed)
    names = df.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(steps)], "step_no int, step string")
    counts = names.join(marked.groupBy(F.col("_failed").alias("step")).agg(F.count("*").alias("removed")), "step", "left").na.fill(0,
        ["removed"]).select("step_no", "step", "removed")
    return marked.filter("_failed is null").drop("_failed"), counts


def aggressive_steps(blocked_firms: tuple[str, ...] = MATCHING_ANYTHING,
    blocked_methods: tuple[str, ...] = ("acronym_match", "firm_contained_conm"), least: float = 0.96) -> list[tuple[str, Column]]:
    """False-positive steps over gvkey, match_method, institution_name, firm_name, match_confidence."""
    name = F.col("institution_name")
    words = F.split(F.lower(name), r"\s+")
    bare = F.trim(F.regexp_replace(name, r"(?i)\s+(INC|CORP|LLC|LTD|PLC|GMBH|AG)\.?$", ""))
    meaning = lambda c: F.try_element_at(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_TERMS)), F.lit(1))
    return [
        ("blocked firm", ~F.col("gvkey").isin(*blocked_firms) if blocked_firms else F.lit(True)),
        ("blocked method", ~F.col("match_method").isin(*blocked_methods)),
        ("generic term", ~F.exists(words, lambda w: w.isin(*GENERIC_TERMS))), ("short name", F.length(bare) >= 8),
        ("low confidence", F.col("match_confidence") >= least),
        ("no word in common", meaning(name) == meaning(F.col("firm_name"))),
    ]


def unsure_steps(least: float = 0.95) -> list[tuple[str, Column]]:
    """The milder filter, over gvkey, match_method, match_confidence and ``rows_left``: how many rows the institution has after the first two
    steps (``with_rows_left``)."""
    return [
        ("blocked firm", ~F.coalesce(F.col("gvkey"), F.lit("N/A")).isin(*UNSURE_FIRMS)),
        ("blocked method", ~F.coalesce(F.col("match_method"), F.lit("")).isin(*UNSURE_METHODS)),
        ("several firms", F.col("rows_left") == 1), ("low confidence", F.col("match_confidence") >= least),
    ]


def with_rows_left(matches: DataFrame, key: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """``rows_left``: rows of the key that pass the given steps."""
    passes = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in steps])
    left = matches.filter(passes).groupBy(key).agg(F.count("*").alias("rows_left"))
    return matches.join(left, key, "left").withColumn("rows_left", F.coalesce("rows_left", F.lit(0)))
