"""Web addresses and identifiers as column expressions. All give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------------------------------------------------------
COUNTRY_DOMAINS = ("co.uk", "com.au", "co.nz", "com.sg", "co.jp", "co.in", "co.kr", "co.tw", "co.za", "co.il", "co.th", "com.cn")
MORE_COUNTRY_DOMAINS = (*COUNTRY_DOMAINS, "com.br", "com.mx", "com.my", "com.ph", "com.vn", "co.id")
NO_TICKERS = ("THE", "INC", "CORP", "LTD", "LLC", "USA", "AND")
TICKER_PATTERNS = (r"\(([A-Z]{1,5})\)", r"\[([A-Z]{1,5})\]", r"NASDAQ[:\s]*([A-Z]{1,5})", r"NYSE[:\s]*([A-Z]{1,5})", r":\s*([A-Z]{2,5})\s*$")
# --------------------------------------------------------------------------------------------------------------------------------------


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def domain(url: Column) -> Column:
    """Scheme, every "www.", path and a trailing dot off, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    return _found(F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("www."), F.lit("")), r"/.*$", ""), r"\.$", ""))


def host(url: Column) -> Column:
    """The host without a leading "www." and without port, lower case; null for 'None'."""
    with_scheme = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("http://"), url))
    net = F.lower(F.regexp_extract(with_scheme, r"^https?://([^/?#]*)", 1))
    return F.when(url != "None", _found(F.regexp_replace(F.regexp_replace(net, r":.*$", ""), r"^www\.", "")))


def netloc(url: Column) -> Column:
    """The host as written, with port and case."""
    return _found(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def root_domain(host_: Column, country_domains: tuple[str, ...] = COUNTRY_DOMAINS) -> Column:
    """U4: the last two labels, or three before one of the country domains; a host of one label is its own root."""
    ccs = "|".join(d.replace(".", r"\.") for d in country_domains)
    deep = _found(F.regexp_extract(host_, rf"([^.]+\.(?:{ccs}))$", 1))
    return F.coalesce(deep, F.substring_index(host_, ".", -2))


def arxiv_id(c: Column) -> Column:
    """Without "arXiv:" in any case and without version."""
    return _found(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^arxiv:\s*", ""), r"(?i)v\d+$", ""))


def arxiv_id_from_url(c: Column) -> Column:
    """U5, variant: the last part of the path, without version."""
    return _found(F.regexp_replace(F.substring_index(F.trim(c), "/", -1), r"v\d+$", ""))


def institution_id(c: Column) -> Column:
    """I and digits at the end of an address or by themselves, else null."""
    return _found(F.regexp_extract(F.upper(F.trim(c)), r"(?:^|/)(I\d+)/?$", 1))


def wikidata_id(c: Column) -> Column:
    """Q and digits."""
    return _found(F.regexp_extract(c, r"(Q\d+)", 1))


def wikipedia_title(url: Column) -> Column:
    """The page title of an English Wikipedia address, as text."""
    page = F.regexp_extract(url, r"en\.wikipedia\.org/wiki/([^#]*)", 1)
    text = F.replace(F.replace(F.replace(F.replace(page, F.lit("_"), F.lit(" ")), F.lit("%20"), F.lit(" ")), F.lit("%26"), F.lit("&")),
        F.lit("%27"), F.lit("'"))
    return _found(F.trim(text))


def cik(c: Column) -> Column:
    """U8: the number after CIK, six to ten digits."""
    return _found(F.regexp_extract(c, r"(?i)CIK[:\s]*(\d{6,10})", 1))


def cusip6(c: Column) -> Column:
    """U8: the first six of the six to nine digits after CUSIP."""
    return _found(F.left(F.regexp_extract(c, r"(?i)CUSIP[:\s]*(\d{6,9})", 1), F.lit(6)))


def ticker(c: Column) -> Column:
    """U8: the first pattern that gives a ticker which is no common word."""
    hits = [_found(F.regexp_extract(c, p, 1)) for p in TICKER_PATTERNS]
    return F.coalesce(*[F.when(~h.isin(*NO_TICKERS), h) for h in hits])


def exchange_tickers(c: Column) -> Column:
    """Tickers after NYSE: or NASDAQ:, and those in brackets, in their order."""
    named = F.regexp_extract_all(c, F.lit(r"(?:NYSE|NASDAQ)[:\s]+([A-Z]{1,5})\b"), 1)
    return F.array_distinct(F.concat(named, F.regexp_extract_all(c, F.lit(r"\(([A-Z]{1,5})\)"), 1)))


def year_of(date: Column) -> Column:
    """The year of a date string by its first four characters; null if they are none."""
    return F.left(date, F.lit(4)).try_cast("int")


def any_date(c: Column) -> Column:
    """The first of ISO, RFC 2822 and plain dates that reads; a timestamp, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[XXX]", "d MMM yyyy HH:mm:ss[ Z]",
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")])


def _day(date: Column) -> Column:
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))))


def day_of_year(date: Column) -> Column:
    """The ordinal day of a date string yyyy-MM-dd; null for anything else."""
    return F.dayofyear(_day(date))


def month_of(date: Column) -> Column:
    """yyyy-MM of a date string yyyy-MM-dd; null for anything else."""
    return F.date_format(_day(date), "yyyy-MM")
