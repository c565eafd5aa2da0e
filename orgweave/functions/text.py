"""Organisation names and their parts as column expressions. Every normaliser is a function Column -> Column; null and empty names give
an empty string unless it says otherwise. The word lists are fixed values: results must equal those of the rules they stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------------------------------------------------------
LEGAL_WORDS = r"\b(INCORPORATED|CORPORATION|COMPANY|LIMITED|L\.?L\.?C\.?|INC\.?|LTD\.?|CORP\.?|CO\.?|PLC\.?|S\.?A\.?|A\.?G\.?|GMBH|N\.?V\.?|B\.?V\.?)\b"
ASSIGNEE_SUFFIXES = (
    " inc", " corp", " llc", "ltd", "limited", "plc", "gmbh", "ag", "sa", "spa", "pty", "bv", "nv", "aps", "sro", "co", "company",
    "corporation", " technologies",
    "technology", "laboratories", "laboratory", "labs", " research", "group", "holdings", "international", "industries", " systems",
    "solutions", "software", "services",
)
AGGRESSIVE_SUFFIXES = (
    " inc", " corp", " llc", "ltd", "limited", "plc", "gmbh", "ag", "sa", "spa", "pty", "bv", "nv", "aps", "co", "company", "corporation",
    "laboratories", " laboratory",
    "research", "group", "holdings", "international", "industries", " technologies", "technology", "systems", "solutions", "software",
    "services", " incorporated",
    " llp", " partnership", " enterprises", " and",
)
INSTITUTION_SUFFIXES = (
    " inc", " corp", " llc", "ltd", "limited", "plc", "gmbh", "ag", "sa", "spa", "pty", "bv", "nv", "aps", "sro", "zoo", "kft", "oao",
    "ooo", "as", " co", "company",
    "companies", "corporation", "technologies", "technology", " laboratories", "laboratory", "labs", "research", "group", "holdings",
    " international", "industries",
    "systems", "solutions", "software",
)
INSTITUTION_ABBREVIATIONS = (
    ("ibm", "international business machines"), ("ge", "general electric"), ("gm", "general motors"), ("at&t", "at and t"),
    ("ibm corp", "international business machines"),
    ("ibm corporation", "international business machines"), ("hp", "hewlett packard"), ("hewlett-packard", "hewlett packard"),
)
PLACE_PHRASES = (
    " united states", " usa", " us ", " united kingdom", " uk ", " south korea", " north korea", " czechia", " czech republic", " china",
    " japan", " germany", " france",
    " canada", " australia", " india", " netherlands", " switzerland", " sweden", " norway", " denmark", " finland", " italy", " spain",
    " poland", " brazil", " argentina",
    " mexico", " singapore", " taiwan", " hong kong",
)
FILTERED_SUFFIXES = (" inc", " ltd", " llc", " corp", " corporation", " co", " plc", " gmbh", " ag", " sa", " pty", " limited",
    " incorporated", " technologies", " group")
URL_SUFFIXES = (
    " inc", " ltd", " corp", " llc", " plc", " gmbh", " ag", " co", " corporation", " company", " industries", " international",
    " worldwide", " group", " holdings",
    " limited", " technologies", " solutions",
)
WIKI_SUFFIXES = (
    " inc", " ltd", " corp", " plc", " gmbh", " ag", " co", " corporation", " company", " industries", " worldwide", " group", " holdings",
    " limited", " technologies",
    " solutions", " services", " international", " associates", " laboratories", " laboratory", " incorporated", " llc",
)
FIRM_SUFFIXES = (" inc", " corp", " llc", " ltd", " plc", " gmbh", " ag", " sa", " co.", " corporation", " technologies")
COMPANY_PREFIXES = ("subsidiary of", "division of", "unit of", "part of", "lab of", "labs of", "laboratory of")
STOP_WORDS = ("the", "and", "of", "in", "for", "with", "at", "on", "de", "la", "le", "les", "et", "und", "der", "die", "das")
# --------------------------------------------------------------------------------------------------------------------------------------


#: Whatever is no letter, digit or underscore of any script, nor white space.
NO_WORD = r"[^\p{L}\p{N}_\s]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_suffixes(c: Column, suffixes: tuple[str, ...]) -> Column:
    """One pass over the suffixes in their order: each is cut off (and the rest trimmed) if the name then ends with it.

    The name travels through the steps in an array of one, so that each step is evaluated once however many there are.
    """
    def without(s: str):
        return lambda x: F.when(x.endswith(s), F.trim(F.substring(x, F.lit(1), F.length(x) - len(s)))).otherwise(x)

    held = F.array(c)
    for s in suffixes:
        held = F.transform(held, without(s))
    return F.element_at(held, 1)


def strip_prefixes(c: Column, prefixes: tuple[str, ...]) -> Column:
    def without(s: str):
        return lambda x: F.when(x.startswith(s), F.trim(F.substring(x, F.lit(len(s) + 1), F.length(x)))).otherwise(x)

    held = F.array(c)
    for s in prefixes:
        held = F.transform(held, without(s))
    return F.element_at(held, 1)


def without_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\([^)]*\)", "")


def _lower(c: Column) -> Column:
    return F.trim(F.lower(F.coalesce(c, F.lit(""))))


def _long_words(c: Column, drop: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*drop)), " ")


def clean_organization_name(c: Column) -> Column:
    """M1: upper case without legal words, punctuation and doubled spaces; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), "(?U)" + LEGAL_WORDS, ""), NO_WORD, "")
    return F.nullif(squeeze(bare), F.lit(""))


def normalize_assignee(c: Column) -> Column:
    """M2: lower case, trailing suffixes off in one ordered pass (some without a word boundary, as in "cisco" -> "cis")."""
    return squeeze(F.replace(strip_suffixes(_lower(c), ASSIGNEE_SUFFIXES), F.lit("&"), F.lit("and")))


def normalize_aggressive(c: Column, suffixes: tuple[str, ...] = AGGRESSIVE_SUFFIXES, drop: tuple[str, ...] = ("the", "a", "an"),
    prefixes: tuple[str, ...] = ()) -> Column:
    """M3: brackets, prefixes, suffixes, articles and one-letter words off. Other suffixes, words and prefixes give its variants."""
    s = strip_prefixes(F.trim(without_brackets(_lower(c))), prefixes) if prefixes else without_brackets(_lower(c))
    return squeeze(_long_words(F.replace(strip_suffixes(s, suffixes), F.lit("&"), F.lit("and")), drop))


def normalize_institution(c: Column) -> Column:
    """M4: brackets and suffixes off, then abbreviations expanded wherever they occur, inside words too."""
    s = squeeze(F.replace(strip_suffixes(without_brackets(_lower(c)), INSTITUTION_SUFFIXES), F.lit("&"), F.lit("and")))
    return F.trim(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), INSTITUTION_ABBREVIATIONS, s))


def normalize_filtered(c: Column) -> Column:
    """M5: punctuation off, country phrases out, suffixes off."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Punct}", "")
    s = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(" ")), PLACE_PHRASES, s)
    return squeeze(strip_suffixes(s, FILTERED_SUFFIXES))


def normalize_company_url(c: Column) -> Column:
    """M6: lower case, suffixes off."""
    return strip_suffixes(_lower(c), URL_SUFFIXES)


def normalize_wikipedia(c: Column) -> Column:
    """M7: punctuation but & to spaces, suffixes off, the longest first."""
    s = squeeze(F.regexp_replace(_lower(c), r"[^\p{L}\p{N}_\s&]", " "))
    return strip_suffixes(s, tuple(sorted(WIKI_SUFFIXES, key=len, reverse=True)))


def normalize_firm(c: Column) -> Column:
    """M8: brackets and suffixes off, then a leading article."""
    return strip_prefixes(strip_suffixes(without_brackets(_lower(c)), FIRM_SUFFIXES), ("the ", "a "))


#: All normalisers by name: they differ on purpose.
NORMALISERS = {
    "clean_organization_name": clean_organization_name, "normalize_assignee": normalize_assignee, "normalize_aggressive": normalize_aggressive,
    "normalize_institution": normalize_institution, "normalize_filtered": normalize_filtered, "normalize_company_url": normalize_company_url,
    "normalize_wikipedia": normalize_wikipedia, "normalize_firm": normalize_firm,
}


def initials(c: Column) -> Column:
    """First letters of all words; null for a single word."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def _sorted_set(*items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.array(*items), lambda x: x.isNotNull() & (x != ""))))


def firm_variants(conm: Column, conml: Column, tic: Column) -> Column:
    """M9: cleaned names, ticker and initials, sorted."""
    return _sorted_set(clean_organization_name(conm), clean_organization_name(conml), F.upper(F.trim(tic)), initials(conm))


def institution_variants(name: Column, alternatives: Column, acronyms: Column) -> Column:
    """Cleaned name, with and without brackets, cleaned alternatives, upper-case acronyms; at least two characters; sorted."""
    none = F.array().cast("array<string>")
    all_ = F.concat(
        F.array(clean_organization_name(name), clean_organization_name(without_brackets(name))),
        F.transform(F.coalesce(alternatives, none), lambda a: clean_organization_name(a)),
        F.transform(F.coalesce(acronyms, none), lambda a: F.upper(F.trim(a))),
    )
    return F.array_sort(F.array_distinct(F.filter(all_, lambda x: F.length(x) >= 2)))


def tokens(c: Column) -> Column:
    """Significant words of a name for blocking: of three letters or more, no stop words, each once."""
    return F.filter(F.array_distinct(F.split(normalize_filtered(c), " ")), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the words is a substring (inside words too); false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), F.lit(False))


def contains_word(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the phrases occurs between word boundaries."""
    pattern = r"\b(" + "|".join(w.replace("&", "[&]").replace(".", "[.]") for w in words) + r")\b"
    return F.coalesce(c.rlike(pattern), F.lit(False))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller word set that both have; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def author_count(authors: Column) -> Column:
    """Authors in a free list: by semicolons, else by and/&, else by commas."""
    s = F.coalesce(authors, F.lit(""))
    semis = F.size(F.filter(F.split(s, ";"), lambda x: F.trim(x) != ""))
    ands = F.size(F.split(s, " and ")) + F.size(F.split(s, " & ")) - 1
    return F.when(F.trim(s) == "", 0).when(s.contains(";"), semis).when(s.contains(" and ") | s.contains(" & "), ands).when(s.contains(","),
        F.size(F.split(s, ","))).otherwise(1)
