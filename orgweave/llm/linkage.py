"""Matching entities across sources without keys: probabilistic record linkage.

Institutions and firms are compared on several partial, noisy attributes. Candidate pairs come from several blocking passes; each
pair is described by a vector of agreement levels; expectation-maximisation over the counts of these vectors estimates how often each
level occurs among matches (m) and non-matches (u); the posterior of a pair is its confidence, and it alone decides: a pair is a link if
it reaches THRESHOLD, and an institution's firm is the one of greatest posterior.

Candidates hold next to no plain non-matches. So the probabilities u come from the counts of the levels over all pairs of an institution and
a firm, less what EM takes for matches; pairs of firms with different gvkeys, which are non-matches for certain, set the least u of name,
host, ticker, country and city. All are counted by value, never paired.

Passes: (a) names of one kind whose cores are equal, one or two typing errors apart, or clipped; (b) an equal core, whatever the kind;
(c) an equal web host; (d) an acronym that is a ticker; (e) the firms of the parent and of the children. In b, c and d a value that one
firm has makes pairs by itself. One that several firms share identifies none of them, and its pairs would grow as the product of both
sides, so there a second attribute must agree too (city, host, or the beginning of the core). A pair that only shares such a value, and
nothing else, stays far below THRESHOLD; a test scores all pairs of a small table by brute force and finds none that the passes miss.

The table of vectors that the driver sees has at most the product of the numbers of levels (a few thousand rows), however large the
tables are. Attributes that are null compare as "missing", which is a level of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.llm.orgnames import CLIPPED, STUB, core_likelihood, parse_org
from orgweave.shared import blank, cut, width

#: field -> its levels; level 0 is disagreement (or nothing known), the last the strongest agreement.
LEVELS = {"name": 5, "host": 3, "country": 3, "city": 3, "acronym": 3, "parent": 3, "child": 2, "earlier": 3, "academic": 2}
#: What matches look like before any are seen, field by field, and for how many observations that counts: it steadies small tables.
MATCHES = {
    "name": (0.15, 0.005, 0.045, 0.05, 0.75), "host": (0.1, 0.4, 0.5), "country": (0.25, 0.05, 0.7), "city": (0.4, 0.2, 0.4),
    "acronym": (0.3, 0.4, 0.3), "parent": (0.05, 0.6, 0.35),
    "child": (0.85, 0.15), "earlier": (0.1, 0.5, 0.4), "academic": (0.02, 0.98),
}
WEIGHT = 5
#: Least posterior of a link.
THRESHOLD = 0.5
#: Letters of a core that count as its beginning.
HEAD = 4
_FORMER = r"(?:formerly known as|formerly|previously known as|previously named|traded as|once called|known until \d{4} as)\s+([^.();,]+)"
#: ISO alpha-3 codes and the alpha-2 codes of the same countries (fixed values).
ALPHA3 = {
    "USA": "US", "GBR": "GB", "DEU": "DE", "FRA": "FR", "ITA": "IT", "ESP": "ES", "CHN": "CN", "JPN": "JP", "KOR": "KR", "IND": "IN",
    "CAN": "CA", "BRA": "BR", "NLD": "NL",
    "CHE": "CH", "ISR": "IL", "PRT": "PT", "SWE": "SE", "AUS": "AU", "AUT": "AT", "BEL": "BE", "DNK": "DK", "FIN": "FI", "NOR": "NO",
    "IRL": "IE", "POL": "PL", "RUS": "RU",
    "SGP": "SG", "TWN": "TW", "MEX": "MX", "TUR": "TR", "GRC": "GR", "HKG": "HK", "HUN": "HU", "CZE": "CZ", "ZAF": "ZA", "NZL": "NZ",
    "ARG": "AR", "CHL": "CL", "THA": "TH",
    "MYS": "MY", "IDN": "ID", "VNM": "VN", "UKR": "UA", "LUX": "LU", "BMU": "BM", "CYM": "KY", "ARE": "AE", "SAU": "SA", "EGY": "EG",
    "PHL": "PH", "COL": "CO", "PER": "PE",
}


def web_host(url: Column) -> Column:
    """The host of a web address in any form, in lower case, without www."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^(www\d?\.)+", "")
    return F.when(host.contains("."), host)


@F.pandas_udf(T.IntegerType())
def _name_level(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        like = max(core_likelihood(x, y), core_likelihood(y, x))
        out.append(4 if x == y else 3 if like >= 0.05 else 2 if like > 0 else 0)
    return pd.Series(out, dtype="int32")


def _parsed(names: DataFrame, key: str) -> DataFrame:
    """key, name -> distinct key, kind, core of names that have a core."""
    distinct = names.filter(~blank(F.col("name"))).select(key, "name").distinct()
    org = distinct.repartition(width(names.sparkSession)).withColumn("org", parse_org("name"))
    return org.filter("org.core <> ''").select(key, F.col("org.kind").alias("kind"), F.col("org.core").alias("core")).distinct()


def _form_keys(forms: DataFrame) -> DataFrame:
    core, n = F.col("core"), F.length("core")
    gaps = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(core, F.lit(1), i - 1), F.substring(core, i + 1, n)))
    gaps = F.concat(gaps, F.transform(gaps, lambda g: F.regexp_replace(g, r"(.)\1+", "$1")))
    near = F.when(n >= 4, F.concat(F.array(core), gaps)).otherwise(F.array(core))
    return forms.select("*", F.explode(F.array_distinct(near)).alias("key"))


def _stub_keys(forms: DataFrame) -> DataFrame:
    n = F.length("core")
    cuts = F.filter(F.sequence(F.lit(2), F.lit(CLIPPED)), lambda j: n - j >= STUB)
    return forms.select("*", F.explode(F.transform(cuts, lambda j: F.substring(F.col("core"), F.lit(1), n - j))).alias("key"))


def _near_forms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of forms (kind, core) of two sides with their level of agreement, 2 to 4."""
    a, b = a.select("kind", "core").distinct(), b.select("kind", "core").distinct()

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        # keys are many times their forms, so they are never broadcast on an estimate that doesn't know it
        return x.hint("merge").alias("x").join(y.alias("y"), ["kind", "key"]).select("kind", F.col("x.core").alias("core_a"), F.col("y.core").alias("core_b"))

    whole_a, whole_b = a.withColumn("key", F.col("core")), b.withColumn("key", F.col("core"))
    pairs = cut(met(_form_keys(a), _form_keys(b)).unionByName(met(whole_a, _stub_keys(b))).unionByName(met(_stub_keys(a), whole_b)).distinct())
    same = pairs.filter("core_a = core_b").withColumn("level", F.lit(4))
    begun = F.startswith("core_a", F.col("core_b")) | F.startswith("core_b", F.col("core_a"))
    near = pairs.filter((F.col("core_a") != F.col("core_b")) & ((F.levenshtein("core_a", "core_b", 3) >= 0) | begun))  # a swap counts two here
    return same.unionByName(near.withColumn("level", _name_level("core_a", "core_b")).filter("level > 0"))


def firms_view(firms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per gvkey with its attributes as sets, names, hosts)."""
    firms = firms.filter(F.col("gvkey").isNotNull())
    former = F.regexp_extract_all("busdesc", F.lit(f"(?i){_FORMER}"), 1)
    names = firms.select("gvkey", F.explode(F.concat(F.array("conm", "conml"), F.coalesce(former, F.array()))).alias("name"))
    code = F.create_map(*[F.lit(x) for kv in ALPHA3.items() for x in kv])
    country = F.coalesce(code[F.upper(F.trim("fic"))], F.when(F.length(F.trim("fic")) == 2, F.upper(F.trim("fic"))))
    one = firms.groupBy("gvkey").agg(
        F.collect_set(F.upper(F.trim("tic"))).alias("tics"), F.collect_set(web_host(F.col("weburl"))).alias("f_hosts"),
        F.collect_set(country).alias("f_countries"), F.collect_set(F.lower(F.trim("city"))).alias("f_cities")
    )
    return one, names, firms.select("gvkey", web_host(F.col("weburl")).alias("host"), F.upper(F.trim("tic")).alias("tic"))


def institutions_view(inst: DataFrame) -> tuple[DataFrame, DataFrame]:
    inst = inst.filter(F.col("institution_id").isNotNull())
    empty = F.array().cast("array<string>")
    names = inst.select("institution_id", F.explode(F.concat(F.array("display_name"), F.coalesce("alternative_names", empty))).alias("name"))
    host = F.coalesce(web_host(F.col("homepage_domain")), web_host(F.col("homepage_url")))
    own = F.regexp_extract(F.col("display_name"), r"^([A-Z]{2,6})(?: (?:Labs?|Group|Research))?$", 1)
    one = inst.groupBy("institution_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.concat(F.coalesce("acronyms", empty), F.array(F.nullif(own, F.lit("")))),
        lambda x: F.upper(F.trim(x)))))).alias("acronyms"),
        F.collect_set(host).alias("i_hosts"), F.collect_set(F.upper(F.trim("country_code"))).alias("i_countries"),
        F.collect_set(F.lower(F.trim("geo_city"))).alias("i_cities"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("parent_institution_ids", empty)))).alias("parents"),
        F.max((F.lower(F.trim("institution_type")) == "education").cast("int")).alias("academic"),
    )
    return one, names


def _agree(a: Column, b: Column) -> Column:
    """0 differ, 1 one is missing, 2 share a value."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1).when(F.arrays_overlap(a, b), 2).otherwise(0)


class Parts(NamedTuple):
    """What both sides are read into, once: one row per record, and the forms (kind, core) of their names."""

    firms: DataFrame
    institutions: DataFrame
    firm_forms: DataFrame
    institution_forms: DataFrame


def read_parts(inst: DataFrame, firms: DataFrame) -> Parts:
    f_one, f_names, _ = firms_view(firms)
    i_one, i_names = institutions_view(inst)
    return Parts(cut(f_one), cut(i_one), cut(_parsed(f_names, "gvkey")), cut(_parsed(i_names, "institution_id")))


def _met(i: DataFrame, f: DataFrame, seconds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """institution_id, gvkey of equal values v of i(institution_id, v) and f(gvkey, v): all of them for a value of one firm; for one that several
    have those that agree on one of ``seconds`` too, pairs of (institution_id, w) and (gvkey, w)."""
    owned = f.filter("v is not null").groupBy("v").agg(F.min("gvkey").alias("gvkey"), F.max("gvkey").alias("_other"))
    lone = owned.filter("gvkey = _other").select("v", "gvkey")
    out = [i.hint("merge").join(lone, "v").select("institution_id", "gvkey")]
    shared = f.join(owned.filter("gvkey <> _other").select("v"), "v", "left_semi")
    for wi, wf in seconds:
        left, right = i.hint("merge").join(wi, "institution_id"), shared.hint("merge").join(wf, "gvkey")
        out.append(left.hint("merge").join(right, ["v", "w"]).select("institution_id", "gvkey"))
    return reduce(lambda x, y: x.unionByName(y), out).distinct()


def candidate_pairs(parts: Parts, earlier: DataFrame | None) -> DataFrame:
    """institution_id, gvkey and a column per field of LEVELS, one row per candidate pair.

    A ticker is made from a firm's name. Where the names of two bodies of unlike kinds share their word, a like acronym follows from it and
    is no evidence of its own: it counts as missing."""
    f_one, i_one, fn, im = parts
    level = _near_forms(im, fn)
    by_name = (
        im.withColumnRenamed("core", "core_a").hint("merge").join(level,
        ["kind", "core_a"]).join(fn.withColumnRenamed("core", "core_b").hint("merge"), ["kind", "core_b"])
        .groupBy("institution_id", "gvkey").agg(F.max("level").alias("name"))
    )
    values = lambda df, key, c, n: df.select(key, F.explode(c).alias(n))
    head = lambda df, key: df.select(key, F.left("core", F.lit(HEAD)).alias("w")).distinct()
    cities = values(i_one, "institution_id", "i_cities", "w"), values(f_one, "gvkey", "f_cities", "w")
    hosts = values(i_one, "institution_id", "i_hosts", "w"), values(f_one, "gvkey", "f_hosts", "w")
    heads = head(im, "institution_id"), head(fn, "gvkey")
    cores = im.select("institution_id", F.col("core").alias("v")).distinct(), fn.select("gvkey", F.col("core").alias("v")).distinct()
    by_word = _met(*cores, [cities, hosts]).withColumn("name", F.lit(1))
    by_host = cut(_met(values(i_one, "institution_id", "i_hosts", "v"), values(f_one, "gvkey", "f_hosts", "v"), [cities, heads]))
    by_tic = _met(values(i_one, "institution_id", "acronyms", "v"), values(f_one, "gvkey", "tics", "v"), [cities, hosts, heads])
    unnamed = by_host.unionByName(by_tic).withColumn("name", F.lit(0))
    direct = cut(by_name.unionByName(by_word).unionByName(unnamed).groupBy("institution_id", "gvkey").agg(F.max("name").alias("name")))
    parents = i_one.select("institution_id", F.explode("parents").alias("parent_id")).filter("parent_id <> institution_id").hint("merge")
    # a relative counts as the firm by its name, or, where it goes by another name, by its host or its children
    via_child = cut(parents.join(direct.filter("name >= 3").select("institution_id", "gvkey"),
        "institution_id").select(F.col("parent_id").alias("institution_id"), "gvkey").distinct())
    known = direct.filter("name >= 2").select("institution_id", "gvkey").unionByName(by_host).unionByName(via_child).distinct()
    via_parent = parents.join(known.withColumnRenamed("institution_id", "parent_id"), "parent_id").select("institution_id", "gvkey").distinct()
    pairs = (
        direct.withColumns({"p": F.lit(0), "c": F.lit(0)})
        .unionByName(via_parent.select("institution_id", "gvkey", F.lit(0).alias("name"), F.lit(1).alias("p"), F.lit(0).alias("c")))
        .unionByName(via_child.select("institution_id", "gvkey", F.lit(0).alias("name"), F.lit(0).alias("p"), F.lit(1).alias("c")))
        .groupBy("institution_id", "gvkey").agg(F.max("name").alias("name"), F.max("p").alias("p"), F.max("c").alias("child"))
    )
    pairs = pairs.join(i_one.hint("merge"), "institution_id").join(f_one.hint("merge"), "gvkey")
    if earlier is None:
        pairs = pairs.withColumn("earlier", F.lit(1))
    else:
        before = _earlier_pairs(earlier).groupBy("institution_id").agg(F.collect_set("e_gvkey").alias("e_gvkeys"))
        pairs = pairs.join(before.hint("merge"), "institution_id", "left").withColumn("earlier",
            F.when(F.col("e_gvkeys").isNull(), 1).when(F.array_contains("e_gvkeys", F.lpad("gvkey", 6, "0")), 2).otherwise(0))
    return pairs.select(
        "institution_id", "gvkey", "name", _agree(F.col("i_hosts"), F.col("f_hosts")).alias("host"),
        _agree(F.col("i_countries"), F.col("f_countries")).alias("country"), _agree(F.col("i_cities"), F.col("f_cities")).alias("city"),
        F.when((F.col("name") == 1) & F.arrays_overlap("acronyms", "tics"),
        1).otherwise(_agree(F.col("acronyms"), F.col("tics"))).alias("acronym"),
        F.when(F.size("parents") == 0, 1).when(F.col("p") == 1, 2).otherwise(0).alias("parent"), "child", "earlier",
        (1 - F.coalesce("academic", F.lit(0))).alias("academic"),
    )


def _earlier_pairs(earlier: DataFrame) -> DataFrame:
    e = earlier.select("institution_id", F.lpad(F.trim("gvkey"), 6, "0").alias("e_gvkey"))
    return e.filter("institution_id is not null and e_gvkey is not null").distinct()


def _share(df: DataFrame, owner: str, *value: str) -> DataFrame:
    """One row: ordered pairs of different owners that share a value, counted from the owners of each value."""
    got = df.dropna().distinct().groupBy(*value).agg(F.count("*").cast("double").alias("n"))
    return got.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("s"))


def chance_levels(parts: Parts, earlier: DataFrame | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
    """(chance of the levels of name, host, country, city and acronym among pairs of firms; counts of the levels of all fields over all pairs of
    an institution and a firm, where what only candidates can have is left open; the number of these pairs). A few small jobs."""
    f_one, i_one, fn, im = parts
    total = lambda c, n: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n)
    lacks = lambda *cs: [total(F.size(c) == 0, c) for c in cs]
    f = f_one.agg(F.count("*").cast("double").alias("n"), *lacks("tics", "f_hosts", "f_countries", "f_cities")).first()
    i = i_one.agg(F.count("*").cast("double").alias("n"), *lacks("acronyms", "i_hosts", "i_countries", "i_cities", "parents"),
        total(F.coalesce("academic", F.lit(0)) == 1, "schools")).first()
    nf, ni = max(f["n"], 1.0), max(i["n"], 1.0)
    pairs = nf * nf
    forms = fn.groupBy("kind", "core").agg(F.count("*").cast("double").alias("n"))
    met = _near_forms(fn, fn).join(forms.select("kind", F.col("core").alias("core_a"), F.col("n").alias("na")),
        ["kind", "core_a"]).join(forms.select("kind", F.col("core").alias("core_b"), F.col("n").alias("nb")), ["kind", "core_b"])
    near = met.groupBy("level").agg(F.sum(F.col("na") * F.when(F.col("core_a") == F.col("core_b"), F.col("nb") - 1).otherwise(F.col("nb")))
        .alias("s")).select(F.col("level").cast("string").alias("what"), "s")
    exploded = lambda c: f_one.select("gvkey", F.explode(c).alias("v"))
    shares = {"word": (fn.select("gvkey", "core"), "core"), "form": (fn, "kind", "core")} | {c: (exploded(c), "v") for c in ("f_hosts",
        "f_countries", "f_cities", "tics")}
    told = near
    n_of = lambda df, *v: df.dropna().distinct().groupBy(*v).agg(F.count("*").cast("double").alias("n"))
    across = lambda a, b, *v: n_of(a, *v).join(n_of(b, *v).withColumnRenamed("n", "k").hint("merge"),
        list(v)).agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0.0)).alias("s"))
    side = lambda c: i_one.select("institution_id", F.explode(c).alias("v"))
    crossed = {f"i_{fc}": across(side(ic), exploded(fc), "v") for fc,
        ic in (("f_hosts", "i_hosts"), ("f_countries", "i_countries"), ("f_cities", "i_cities"), ("tics", "acronyms"))}
    crossed |= {"i_word": across(im.select("institution_id", "core"), fn.select("gvkey", "core"), "core"), "i_form": across(im, fn, "kind", "core")}
    for what, one in crossed.items():
        told = told.unionByName(one.select(F.lit(what).alias("what"), "s"))
    for what, (df, *value) in shares.items():
        told = told.unionByName(_share(df, "gvkey", *value).select(F.lit(what).alias("what"), "s"))
    got = {r["what"]: r["s"] or 0.0 for r in told.collect()}  # a row per level and field
    name = np.array([0.0, max(got["word"] - got["form"], 0.0), got.get("2", 0.0), got.get("3", 0.0), got.get("4", 0.0)])
    name[0] = pairs - name.sum()
    u = {"name": name}
    for field, fc, ic in (("host", "f_hosts", "i_hosts"), ("country", "f_countries", "i_countries"), ("city", "f_cities", "i_cities"),
        ("acronym", "tics", "acronyms")):
        missing = 1 - (1 - f[fc] / nf) * (1 - i[ic] / ni)
        agree = got[fc] * (1 - i[ic] / ni)
        u[field] = np.array([max(pairs * (1 - missing) - agree, 0.0), pairs * missing, agree])
    every, known, agreed = ni * nf, 0.0, 0.0
    if earlier is not None:
        e = _earlier_pairs(earlier).join(i_one.select("institution_id").hint("merge"), "institution_id",
            "left_semi").agg(F.countDistinct("institution_id").alias("i"), F.count("*").alias("n")).first()
        known, agreed = float(e["i"]), float(e["n"])
    whole = np.array([0.0, max(got["i_word"] - got["i_form"], 0.0), 0.0, 0.0, 0.0])  # of names only the shared word is counted over all pairs
    overall = {"name": whole}
    for field, fc, ic in (("host", "f_hosts", "i_hosts"), ("country", "f_countries", "i_countries"), ("city", "f_cities", "i_cities"),
        ("acronym", "tics", "acronyms")):
        missing = every * (1 - (1 - f[fc] / nf) * (1 - i[ic] / ni))
        overall[field] = np.array([max(every - missing - got[f"i_{fc}"], 0.0), missing, got[f"i_{fc}"]])
    overall |= {
        "parent": np.array([every - i["parents"] * nf, i["parents"] * nf, 0.0]), "child": np.array([every, 0.0]),
        "earlier": np.array([known * nf - agreed, every - known * nf, agreed]), "academic": np.array([i["schools"] * nf, every - i["schools"] * nf]),
    }
    return {k: v / pairs for k, v in u.items()}, overall, every


class Model(NamedTuple):
    m: dict[str, np.ndarray]
    u: dict[str, np.ndarray]
    prior: float

    def posterior(self, levels: pd.DataFrame) -> np.ndarray:
        """The chance that a pair with these levels (a column per field) is a match. Levels are independent given the class."""
        seen = {f: levels[f].to_numpy(int) for f in LEVELS}
        a = np.log(self.prior) + sum(np.log(self.m[f][seen[f]]) for f in LEVELS)
        b = np.log(1 - self.prior) + sum(np.log(self.u[f][seen[f]]) for f in LEVELS)
        return 1 / (1 + np.exp(np.clip(b - a, -500, 500)))


def expectation_maximisation(patterns: pd.DataFrame, chance: dict[str, np.ndarray], overall: dict[str, np.ndarray], pairs: float,
    rounds: int = 200) -> tuple[Model, np.ndarray]:
    """The model of ``patterns`` (one column per field of LEVELS and the count n) and the posterior of each of its rows.

    u comes from the levels over all pairs (``overall``, and for relatives what candidates agree on) less those of the matches; where known
    non-matches (``chance``) agree more often, they count instead. The start takes pairs whose names agree for likely matches. ``pairs``
    counts all pairs, of which those that aren't candidates are non-matches. Each step adds WEIGHT observations of MATCHES to the matches and
    half an observation to every level of the rest. A pair is judged by the others: its own share is taken out of the counts that judge it,
    so that a lone odd pair can't vouch for itself.
    """
    n = patterns["n"].to_numpy(float)
    seen = {f: patterns[f].to_numpy(int) for f in LEVELS}
    everything = max(pairs, n.sum())
    held = {}
    for f, counts in overall.items():
        agree = np.bincount(seen[f], weights=n, minlength=LEVELS[f])
        held[f] = counts.copy()
        if f in ("parent", "child"):  # whatever agrees is a candidate
            held[f][-1] = agree[-1]
            held[f][0] = max(held[f][0] - agree[-1], 0.0)

    def maximise(post: np.ndarray) -> tuple[Model, np.ndarray]:
        """The model, and each vector's posterior by the counts without one pair of its own."""
        m, u, odds = {}, {}, np.zeros(len(n))
        for f, k in LEVELS.items():
            up = np.bincount(seen[f], weights=post * n, minlength=k)
            more = up + WEIGHT * np.array(MATCHES[f])
            m[f] = more / more.sum()
            down = np.maximum(held[f] - up, 0.0)
            if f in chance:
                down[1:] = np.maximum(down, chance[f] * everything)[1:]
                down[0] = max(everything - down[1:].sum(), 0.0)
            less = down + 0.5
            u[f] = less / less.sum()
            at = seen[f]
            odds += np.log((more[at] - post) / (more.sum() - post)) - np.log(np.maximum(less[at] - (1 - post), 0.5) / less.sum())
        prior = float(np.clip((post * n).sum() / everything, 1e-12, 0.5))
        return Model(m, u, prior), 1 / (1 + np.exp(np.clip(-odds - np.log(prior / (1 - prior)), -500, 500)))

    post = np.select([seen["name"] >= 3, seen["name"] == 2], [0.9, 0.7], 0.1)
    for _ in range(rounds):
        model, new = maximise(post)
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    return model, post


def fit(pairs: DataFrame, parts: Parts, earlier: DataFrame | None) -> tuple[Model | None, pd.DataFrame]:
    """The model, and its posterior of each vector of levels that occurs."""
    patterns = pairs.groupBy(*LEVELS).agg(F.count("*").alias("n")).toPandas()  # bounded by the product of LEVELS
    if patterns.empty:
        return None, patterns
    model, post = expectation_maximisation(patterns, *chance_levels(parts, earlier))
    return model, patterns.assign(match_confidence=post)


def link(inst: DataFrame, firms: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """institution_id, gvkey, match_confidence and the agreement levels of each candidate pair.

    Rows that are repeated, or that spread one institution or firm over several, are one record; rows without an id are left out.
    """
    parts = read_parts(inst, firms)
    pairs = cut(candidate_pairs(parts, earlier))
    _, patterns = fit(pairs, parts, earlier)
    if patterns.empty:
        return pairs.withColumn("match_confidence", F.lit(None).cast("double"))
    table = inst.sparkSession.createDataFrame(patterns[[*LEVELS, "match_confidence"]].astype({f: "int32" for f in LEVELS}))
    return pairs.join(F.broadcast(table), list(LEVELS))  # as many rows as vectors of levels occur


def best_links(scored: DataFrame) -> DataFrame:
    """One firm per institution, if any reaches THRESHOLD: that of greatest confidence (ties: more name agreement, then the smaller gvkey)."""
    kept = scored.filter(F.col("match_confidence") >= THRESHOLD)
    best = kept.groupBy("institution_id").agg(F.min(F.struct((-F.col("match_confidence")).alias("c"), (-F.col("name")).alias("n"), "gvkey")).alias("b"))
    return best.select("institution_id", "b.gvkey", (-F.col("b.c")).alias("match_confidence"))
