"""Further cascades: fuzzy publication names with cross-checks, pages, knowledge bases, older matchers, concepts by taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import identifiers as ids
from orgweave.functions.classify import ladder
from orgweave.functions.text import COMPANY_PREFIXES, NO_WORD, contains_any, normalize_aggressive, normalize_company_url, normalize_filtered, normalize_wikipedia, tokens
from orgweave.operators import linking
from orgweave.operators.linking import MATCH, contained_pairs, equal_keys, first_hit, near_texts, same_country, scored_pairs, stage2_confidence, token_pairs, top_k, union_matches, valid_overlap, wratio_confidence
from orgweave.shared import cut

# ---- fixed values --------------------------------------------------------------------------------------------------------------------
NOT_AI_CONCEPTS = (
    "neural stem", "neural development", "neural cell", "neural activity", "neural system", "neural correlates", "biological neural",
    "ciliary", "ganglion", "neural crest",
    "neural tube", "neural plasticity", "synaptic", "organic chemistry", "inorganic chemistry", "organic radical", "organic matter",
    "organic compound", "inorganic compound",
    "ligand (biochemistry)", "radical battery", "pattern recognition (psychology)", "psychology", "cognitive psychology",
    "industrial organization", "margin (economics)",
    "organizational behavior", "microorganism", "organism", "soil classification", "battery", "radical", "organic radical battery",
)
AI_PHRASES = (
    "(machine learning)", "(artificial intelligence)", "(ai)", "machine learning", "artificial intelligence", "deep learning",
    "neural network", "computer vision",
    "natural language processing",
)
STRUCTURE_WORDS, TECH_WORDS = (" inc", " corp", "llc", "ltd", "plc", "gmbh"), ("research", "technologies", "technology", "labs", "systems")
# --------------------------------------------------------------------------------------------------------------------------------------


def _tag(p: DataFrame, method: str | Column, confidence: float | Column) -> DataFrame:
    m, c = (x if isinstance(x, Column) else F.lit(x) for x in (method, confidence))
    return p.select("entity_id", "gvkey", m.alias("match_method"), c.alias("match_confidence"))


def business_words(name: Column, description: Column) -> Column:
    """Two words of the name in the description, or one of six letters or more; false for null."""
    words = F.array_distinct(F.regexp_extract_all(F.upper(name), F.lit(r"\b([A-Z]{2,})\b"), 1))
    inside = F.filter(words, lambda w: F.upper(description).contains(w))
    return F.coalesce((F.size(inside) >= 2) | F.exists(inside, lambda w: F.length(w) >= 6), F.lit(False))


def places_agree(city: Column, region: Column, firm_city: Column, firm_state: Column) -> Column:
    """City or region equal, or one inside the other; false for null."""
    bare = lambda c: F.regexp_replace(F.upper(c), NO_WORD, "")
    one = lambda a, b: F.coalesce((bare(a) != "") & (bare(b) != "") & (bare(a).contains(bare(b)) | bare(b).contains(bare(a))), F.lit(False))
    return one(city, firm_city) | one(region, firm_state)


def hosts_agree(a: Column, b: Column) -> Column:
    """Hosts equal, or one inside the other if both are longer than three letters; false for null."""
    return F.coalesce((a == b) | ((F.length(a) > 3) & (F.length(b) > 3) & (a.contains(b) | b.contains(a))), F.lit(False))


def publications_stage2(institutions: DataFrame, firms: DataFrame) -> DataFrame:
    """institutions(entity_id, display_name, variants, country, city, region, host), firms(gvkey, variants, fic, city, state,
    busdesc, host): the greatest Jaro-Winkler score of any two variants, from .85 on, and enough of the four checks.

    All pairs of texts count; each is scored once."""
    iv = institutions.select("entity_id", F.explode("variants").alias("name")).filter("name <> ''").distinct()
    fv = firms.select("gvkey", F.explode("variants").alias("firm")).filter("firm <> ''").distinct()
    texts = cut(near_texts(iv.select(F.col("name").alias("text")), fv.select(F.col("firm").alias("text"), F.col("gvkey").alias("first")), "jaro_winkler", 0.85))
    pairs = texts.join(iv.withColumnRenamed("name", "a"), "a").join(fv.withColumnRenamed("firm", "b"), "b").groupBy("entity_id",
        "gvkey").agg(F.max("score").alias("score"))
    i = institutions.select("entity_id", "display_name", "country", F.col("city").alias("i_city"), "region", F.col("host").alias("i_host"))
    f = firms.select("gvkey", "fic", F.col("city").alias("f_city"), "state", "busdesc", F.col("host").alias("f_host"))
    full = pairs.join(i, "entity_id").join(f, "gvkey")
    checks = [same_country(F.col("country"), F.col("fic")), business_words(F.col("display_name"), F.col("busdesc")),
        places_agree(F.col("i_city"), F.col("region"), F.col("f_city"), F.col("state")), hosts_agree(F.col("i_host"), F.col("f_host"))]
    scored = full.withColumn("match_confidence", stage2_confidence(F.col("score"), *checks)).filter("match_confidence is not null")
    return scored.groupBy("entity_id", "gvkey").agg(F.lit("jaro_winkler").alias("match_method"), F.max("match_confidence").alias("match_confidence"))


def country_links(institutions: DataFrame, firms: DataFrame, least: float = 0.85) -> DataFrame:
    """institutions(entity_id, name, variants, country, city), firms(gvkey, conm_clean, conml_clean, fic, city, busdesc), each compared within
    its country only; of an institution without country (null or blank) nothing is compared.

    A variant that is a firm's clean name gives .97. Institutions without one take the firm of greatest Jaro-Winkler score from ``least`` on:
    .90 + .09 x what lies above it, .02 more for the country, .02 for two words of the name in the business description, .01 for the city,
    .99 at most; from .95 on the pair needs one of these checks, which the country always is, so it never fails here. Ties: the least gvkey.
    """
    i = institutions.select("entity_id", country_code(F.col("country")).alias("country"), F.col("name").alias("own"),
        F.col("city").alias("i_city"), F.explode(F.array_union(F.array("name"), F.coalesce("variants", F.array().cast("array<string>"))))
        .alias("a")).filter("country is not null and a <> ''").distinct()
    f = firms.select("gvkey", country_code(F.col("fic")).alias("country"), F.col("city").alias("f_city"), "busdesc", "conm_clean",
        F.explode(F.array("conm_clean", "conml_clean")).alias("b")).filter("country is not null and b <> ''").distinct()
    equal = i.join(f.filter(F.col("b") == F.col("conm_clean")).select("country", F.col("b").alias("a"), "gvkey").distinct(), ["country", "a"])
    exact = _tag(equal.groupBy("entity_id").agg(F.min("gvkey").alias("gvkey")), "string_match", 0.97)
    rest = i.join(exact.select("entity_id"), "entity_id", "left_anti")
    texts = near_texts(rest.select(F.col("a").alias("text"), "country"),
        f.select(F.col("b").alias("text"), "country", F.col("gvkey").alias("first")), "jaro_winkler", least, within="country")
    pairs = cut(texts).join(rest, ["country", "a"]).join(f, ["country", "b"])
    words = F.array_distinct(F.split("own", " "))
    described = F.coalesce(F.size(F.filter(words, lambda w: F.upper(F.col("busdesc")).contains(w))) >= 2, F.lit(False))
    place = F.coalesce((F.col("i_city") != "") & F.col("f_city").contains(F.col("i_city")), F.lit(False))
    score = F.least(F.lit(0.99), 0.90 + (F.col("score") - least) * 0.09 + 0.02 + described.cast("int") * 0.02 + place.cast("int") * 0.01)
    best = pairs.groupBy("entity_id", "gvkey").agg(F.max("score").alias("s"), F.max(F.round(F.round(score, 9), 3)).alias("c"))  # halves are told after noise of the ninth digit
    one = best.groupBy("entity_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "gvkey", "c")).alias("m"))
    return exact.unionByName(_tag(one.select("entity_id", "m.gvkey", "m.c"), "fuzzy_jaro_winkler", F.col("c")))


def country_code(c: Column) -> Column:
    """The first code of the group that a country's code belongs to, or the code itself, in upper case; null for blank."""
    u = F.nullif(F.upper(F.trim(c)), F.lit(""))
    return ladder([(u.isin(*g), g[0]) for g in linking.COUNTRY_GROUPS], u)


def stage1_enhanced(institutions: DataFrame, firms: DataFrame) -> DataFrame:
    """The first of exact name .98, acronym = ticker .97, host .98; of several firms the one of the least gvkey."""
    own = institutions.select("entity_id", F.col("name").alias("key"))
    acr = institutions.select("entity_id", F.explode("acronyms").alias("a")).select("entity_id", F.upper("a").alias("key"))
    host = institutions.select("entity_id", F.col("host").alias("key")).dropna()
    f = lambda c: firms.select("gvkey", F.col(c).alias("key")).dropna()
    hits = first_hit(equal_keys(own, f("conm_clean"), "exact", 0.98), equal_keys(acr, f("tic"), "acronym_ticker", 0.97),
        equal_keys(host, f("host"), "domain", 0.98))
    return hits.groupBy("entity_id").agg(F.min(F.struct("gvkey", "match_method", "match_confidence")).alias("m")).select("entity_id", "m.*").select(MATCH)


def smart_urls(institutions: DataFrame, firms: DataFrame) -> DataFrame:
    """X11: the first of page title in the firm's name .98 (.97 in the long name), host .98, root domain .96, parent's host .95.

    The title is looked for as a literal of four letters or more."""
    title = normalize_company_url(ids.wikipedia_title(F.col("wikipedia_url")))
    pages = institutions.select("entity_id", title.alias("name")).filter(F.length("name") >= 4)

    def inside(column: str, c: float) -> DataFrame:
        names = firms.select(F.col("gvkey").alias("entity_id"), F.lower(column).alias("name")).dropna()
        found = contained_pairs(names, pages.select(F.col("entity_id").alias("gvkey"), "name"), 4)
        return _tag(found.select(F.col("gvkey").alias("entity_id"), F.col("entity_id").alias("gvkey")), "wikipedia_name", c)

    wiki = union_matches(inside("conm_clean", 0.98), inside("conml_clean", 0.97)).groupBy("entity_id", "gvkey",
        "match_method").agg(F.max("match_confidence").alias("match_confidence")).select(MATCH)
    e, f = institutions.filter("host is not null"), firms.filter("host is not null")
    root = ids.root_domain(F.col("host"), ids.MORE_COUNTRY_DOMAINS)
    exact = equal_keys(e.select("entity_id", F.col("host").alias("key")), f.select("gvkey", F.col("host").alias("key")), "homepage_exact", 0.98)
    deep = equal_keys(e.withColumn("key", root).filter("key <> host").select("entity_id", "key"), f.select("gvkey", root.alias("key")), "homepage_root", 0.96)
    return first_hit(wiki, exact, deep, linking.parent_hosts(institutions, firms))


def wikipedia_names(pages: DataFrame, firms: DataFrame) -> DataFrame:
    """pages(entity_id, title), firms(gvkey, conm): one name inside the other (five letters or more, not generic) and WRatio: from 95
    on .98, from 85 on .95; the best firm of each page (ties: the least gvkey)."""
    p = pages.select("entity_id", normalize_wikipedia(F.col("title")).alias("name")).filter((F.length("name") >= 5)
        & ~F.upper("name").isin(*linking.GENERIC_NAMES))
    f = firms.select("gvkey", normalize_wikipedia(F.col("conm")).alias("name")).filter((F.length("name") >= 5) & ~F.upper("name").isin(*linking.GENERIC_NAMES))
    one = contained_pairs(p, f, 5).select("entity_id", "gvkey", F.col("entity").alias("a"), F.col("firm").alias("b"))
    two = contained_pairs(f.select(F.col("gvkey").alias("entity_id"), "name"), p.select(F.col("entity_id").alias("gvkey"), "name"), 5)
    both = one.unionByName(two.select(F.col("gvkey").alias("entity_id"), F.col("entity_id").alias("gvkey"), F.col("firm").alias("a"),
        F.col("entity").alias("b"))).distinct()
    best = top_k(scored_pairs(both, "a", "b", "wratio", 85.0), "entity_id", 1, F.desc("score"), F.col("gvkey"))
    return _tag(best, "wikipedia_improved", F.when(F.col("score") >= 95, 0.98).otherwise(0.95))


def wikidata(entities: DataFrame, firms: DataFrame) -> DataFrame:
    """entities(entity_id, tickers, names, parents, parent_tickers): ticker .98, other name .97, parent's name .97, its ticker .98; all count."""
    up = lambda c: entities.select("entity_id", F.explode(c).alias("k")).select("entity_id", F.upper(F.trim("k")).alias("key"))
    names = firms.select("gvkey", F.upper("conm_clean").alias("key")).unionByName(firms.select("gvkey",
        F.upper("conml_clean").alias("key"))).dropna().distinct()
    return union_matches(
        linking.either_key(up("tickers"), firms, "wikidata_ticker", 0.98), equal_keys(up("names"), names, "wikidata_name", 0.97),
        equal_keys(up("parents"), names, "wikidata_parent", 0.97),
        linking.either_key(up("parent_tickers"), firms, "wikidata_parent_ticker", 0.98),
    )


def filtered_names(entities: DataFrame, firms: DataFrame, least: float = 85.0) -> DataFrame:
    """Names that share two significant words (all, if there are fewer), the firm of greatest WRatio of at least 85."""
    e = entities.select("entity_id", normalize_filtered(F.col("name")).alias("a"), tokens(F.col("name")).alias("tokens"))
    f = firms.select("gvkey", normalize_filtered(F.col("conm")).alias("b"), tokens(F.col("conm")).alias("tokens")).distinct()
    pairs = token_pairs(e.select(F.col("entity_id").alias("id"), "tokens"), f.select(F.col("gvkey").alias("id"), "tokens"),
        2).select(F.col("a").alias("entity_id"), F.col("b").alias("gvkey"))
    named = pairs.join(e.select("entity_id", "a"), "entity_id").join(f.select("gvkey", "b"), "gvkey")
    best = top_k(scored_pairs(named, "a", "b", "wratio", least), "entity_id", 1, F.desc("score"), F.col("gvkey"))
    return _tag(best, "token_blocked", F.round(F.col("score") / 100, 4))


def wratio_stage2(affiliations: DataFrame, firms: DataFrame) -> DataFrame:
    """The first valid of the five firms of greatest WRatio of at least 90."""
    a = affiliations.select("entity_id", normalize_aggressive(F.col("name")).alias("a"))
    f = firms.select("gvkey", normalize_aggressive(F.col("conm")).alias("b")).distinct()
    texts = near_texts(a.select(F.col("a").alias("text")), f.select(F.col("b").alias("text"), F.col("gvkey").alias("first")), "wratio", 90.0, 5)
    five = top_k(texts.join(a, "a").join(f, "b"), "entity_id", 5, F.desc("score"), F.col("gvkey"))
    valid = top_k(five.filter(valid_overlap(F.col("a"), F.col("b"), F.col("score"))), "entity_id", 1, F.desc("score"), F.col("gvkey"))
    return _tag(valid, "wratio", wratio_confidence(F.col("score")))


def enrichment(entities: DataFrame, firms: DataFrame) -> DataFrame:
    """entities(entity_id, ticker, name): a ticker of one firm .95, of several .93 for the one in the entity's state; else a first word
    that one firm has .92."""
    t = entities.filter("ticker is not null").select("entity_id", F.upper("ticker").alias("tic"), "state")
    f = firms.select("gvkey", F.upper("tic").alias("tic"), F.col("state").alias("f_state")).distinct()
    hit = t.join(f, "tic")
    n = hit.groupBy("entity_id").agg(F.countDistinct("gvkey").alias("n"))
    hit = hit.join(n, "entity_id").filter((F.col("n") == 1) | (F.col("state") == F.col("f_state")))
    by_tic = _tag(hit, "wikidata_ticker", F.when(F.col("n") == 1, 0.95).otherwise(0.93)).distinct()
    first = lambda c: F.substring_index(F.lower(c), " ", 1)
    lone = firms.select("gvkey", first(F.col("conm")).alias("key")).filter(F.length("key") >= 4).groupBy("key").agg(F.min("gvkey")
        .alias("gvkey"), F.max("gvkey").alias("o")).filter("gvkey = o").select("key", "gvkey")
    return first_hit(by_tic, equal_keys(entities.select("entity_id", first(F.col("name")).alias("key")), lone, "first_word", 0.92))


def legacy(entities: DataFrame, firms: DataFrame, ticker_confidence: float = 0.98, exact_confidence: float = 0.95, slope_from: float = 0.70,
    least: float = 85.0, cap: float = 0.92) -> DataFrame:
    """The first of ticker in the text, exact name, subsidiary prefix .80, CIK in the text .90 (where firms have a column ``cik``), fuzzy name
    slope_from + (score - least) x .01 up to the cap, name contained .65; the constants give its three variants."""
    name = normalize_aggressive(F.col("name"))
    # cut, since each strategy starts from them: else the plan holds their many steps a dozen times, which the driver keeps
    e = cut(entities.select("entity_id", "name", name.alias("a")))
    f = cut(firms.select("gvkey", F.upper("tic").alias("tic"), normalize_aggressive(F.col("conm")).alias("b")).distinct())
    by_tic = equal_keys(e.select("entity_id", ids.ticker(F.col("name")).alias("key")).dropna(),
        f.select("gvkey", F.col("tic").alias("key")).dropna(), "ticker", ticker_confidence)
    exact = equal_keys(e.select("entity_id", F.col("a").alias("key")), f.select("gvkey", F.col("b").alias("key")), "exact", exact_confidence)
    sub = e.select("entity_id", normalize_aggressive(F.col("name"), prefixes=COMPANY_PREFIXES).alias("key"), "a").filter("key <> a")
    subs = equal_keys(sub.select("entity_id", "key"), f.select("gvkey", F.col("b").alias("key")), "subsidiary", 0.80)
    texts = cut(near_texts(e.select(F.col("a").alias("text")), f.select(F.col("b").alias("text"), F.col("gvkey").alias("first")), "wratio", least, 1))
    best = top_k(texts.join(e.select("entity_id", "a"), "a").join(f.select("gvkey", "b"), "b"), "entity_id", 1, F.desc("score"), F.col("gvkey"))
    fuzzy = _tag(best, "fuzzy", F.round(F.least(F.lit(cap), F.lit(slope_from) + (F.col("score") - least) * 0.01), 4))
    inside = _tag(contained_pairs(e.select("entity_id", F.col("a").alias("name")), f.select("gvkey", F.col("b").alias("name")), 5), "contains", 0.65)
    ciks = []
    if "cik" in firms.columns:
        number = F.regexp_replace(ids.cik(F.col("name")), "^0+", "")
        ciks = [equal_keys(e.select("entity_id", number.alias("key")).dropna(),
            firms.select("gvkey", F.regexp_replace("cik", "^0+", "").alias("key")).dropna(), "cik", 0.90)]
    return first_hit(by_tic, exact, subs, *ciks, fuzzy, inside)


def firm_to_institutions(firms: DataFrame, institutions: DataFrame) -> DataFrame:
    """Same normalised name .98, institution that begins with the firm's core name .95, ticker in round or square brackets .97; all count."""
    i = institutions.select("entity_id", F.col("name").alias("raw"), normalize_aggressive(F.col("name")).alias("key"))
    f = firms.select("gvkey", "tic", normalize_aggressive(F.col("conm")).alias("key")).filter(F.length("key") >= 3).distinct()
    begins = contained_pairs(i.select("entity_id", F.concat(F.lower("raw"), F.lit(" ")).alias("name")),
        f.select("gvkey", F.concat("key", F.lit(" ")).alias("name")), 4).filter(F.col("entity").startswith(F.col("firm")))
    tic = i.select("entity_id", F.explode(F.regexp_extract_all(F.upper("raw"), F.lit(r"[(\[]([A-Z.]{1,6})[)\]]"), 1)).alias("key"))
    return union_matches(
        equal_keys(i.select("entity_id", "key"), f.select("gvkey", "key"), "exact_normalized", 0.98),
        _tag(begins, "subsidiary_pattern", 0.95).distinct(), equal_keys(tic, f.select("gvkey", F.upper("tic").alias("key")).dropna(), "ticker", 0.97),
    )


def patent_capability(name: Column, known: tuple[str, ...]) -> Column:
    """Struct of kind and confidence: known firm .90, company structure .75, technical word .70, else null."""
    s = F.lower(name)
    pick = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return ladder([(contains_any(s, known), pick("known_patent_firm", 0.90)),
        (contains_any(s, STRUCTURE_WORDS), pick("company_structure", 0.75)), (contains_any(s, TECH_WORDS), pick("tech_indicator", 0.70))], F.lit(None))


def select_concepts(concepts: DataFrame, known_ids: DataFrame, taxonomy: DataFrame, least: float = 0.85) -> DataFrame:
    """concepts(id, display_name, ancestors) that are known, or fit the taxonomy(term): equal, one inside the other with a sequence
    ratio of ``least`` (terms of six letters or more), or a key phrase; or have a selected ancestor. Names with an excluding word only
    count if they are known. ``how`` says which; descendants come in one pass, from the selection before it."""
    name = F.lower(F.trim("display_name"))
    c = concepts.select("id", name.alias("name"), "ancestors", contains_any(name, NOT_AI_CONCEPTS).alias("barred"))
    known = c.join(known_ids.select("id").distinct(), "id", "left_semi").select("id", F.lit("known").alias("how"))
    open_ = c.filter("not barred").join(known, "id", "left_anti")
    terms = taxonomy.select(F.lower("term").alias("term")).distinct()
    same = open_.join(terms, open_["name"] == terms["term"], "left_semi").select("id")
    phrase = open_.filter(contains_any(F.col("name"), AI_PHRASES)).select("id")
    long = terms.filter(F.length("term") > 5)
    e, t = open_.select(F.col("id").alias("entity_id"), "name"), long.select(F.col("term").alias("gvkey"), F.col("term").alias("name"))
    in_name = contained_pairs(e, t, 6).select(F.col("entity_id").alias("id"), F.col("entity").alias("a"), F.col("firm").alias("b"))
    in_term = contained_pairs(t.select(F.col("gvkey").alias("entity_id"), "name"), e.select(F.col("entity_id").alias("gvkey"), "name"),
        4).select(F.col("gvkey").alias("id"), F.col("firm").alias("a"), F.col("entity").alias("b"))
    near = scored_pairs(in_name.unionByName(in_term), "a", "b", "sequence_ratio", least).select("id")
    fit = same.unionByName(phrase).unionByName(near).distinct().select("id", F.lit("taxonomy").alias("how"))
    chosen = cut(known.unionByName(fit))
    below = open_.select("id", F.explode("ancestors").alias("anc")).join(chosen.select(F.col("id").alias("anc")), "anc",
        "left_semi").select("id").distinct().join(chosen.select("id"), "id", "left_anti")
    return chosen.unionByName(below.select("id", F.lit("ancestor").alias("how")))
