"""Variant spellings of names typed by people: noisy-channel attribution of spellings to canonical forms.

1. Every distinct spelling is read once into (kind, core) by ``orgnames.parse``: abbreviation, translation, word order, legal form,
   department, country and holder of rights belong to this deterministic part of the channel.
2. Spellings with one (kind, core) are a *form*; a form's prior is the number of rows that use it.
3. Forms of one kind meet over keys: the core with up to two letters left out (any two cores two edits apart share such a key), and the
   core with its last letters left out. Only forms used at least as often are candidates.
4. The channel has classes of errors (ERRORS). Expectation-maximisation over all candidate pairs learns how often each occurs per row. A
   writer who means form c types a given string by an error of class k as often as rows(c) x rate(k) / strings that k can make of c;
   that the string is meant as typed is as likely as a letter model of all cores makes it, times the forms there are, or as a namesake
   (TWIN) is that near, for each row of it. So a short core, of which there are few, is more likely a name of its own, and so is one that is
   two letters away and used nearly as often; no limits on lengths are needed.
5. Each form joins the candidate of greatest posterior, unless it is itself likelier; chains are followed to their end.

Nothing is capped: a candidate is never dropped for being in a large group. Rows are aggregated to distinct spellings and then to
forms before anything is joined, so a name that holds a third of all rows is one record here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.llm.orgnames import CLIPPED, STUB, core_key, osa, parse_org
from orgweave.shared import blank, cut, width

#: Classes of errors whose rates are learned: a letter left out, put in, swapped with its neighbour or exchanged for another; one left out
#: between two equal letters (which read as one then); an end of two to four letters left out. Two independent errors of the first four
#: ("out+swap") follow from them.
ERRORS = ("out", "in", "swap", "other", "double", "clipped")
#: Rates per row that the learning starts from, its rounds, and rows that each starting rate counts for.
START, LEARN, STEADY = (0.005, 0.005, 0.005, 0.005, 0.002, 0.005), 12, 20
#: Share of organisations that have a namesake of their own kind whose name is as near as an error would bring it.
TWIN = 0.0005
#: Names of a class on one side of the pair join that one task takes.
PAIR_BLOCK = 1000


def edits(seen: str, meant: str) -> tuple[str, ...]:
    """The fewest errors (ERRORS[:4], in order of their names) that make ``seen`` of ``meant``, where both are at most two apart."""
    rows = [[("in",) * j for j in range(len(seen) + 1)]]
    for i, m in enumerate(meant, 1):
        row = [("out",) * i]
        for j, c in enumerate(seen, 1):
            ways = [rows[i - 1][j - 1] if m == c else (*rows[i - 1][j - 1], "other"), (*row[j - 1], "in"), (*rows[i - 1][j], "out")]
            if i > 1 and j > 1 and m == seen[j - 2] and meant[i - 2] == c:
                ways.append((*rows[i - 2][j - 2], "swap"))
            row.append(min(ways, key=len))
        rows.append(row)
    return tuple(sorted(rows[-1][-1]))


def error_class(seen: str, meant: str) -> str | None:
    """Which class of error makes ``seen`` of ``meant``; none if they are too far apart."""
    d = osa(seen, meant, 2)
    if d == 1:
        return edits(seen, meant)[0]
    for x, y in ((seen, meant), (meant, seen)):
        if len(y) - len(x) == 2 and any(core_key(y[:i] + y[i + 1 :]) == x for i in range(len(y))):
            return "double"
    if len(seen) >= STUB and 2 <= len(meant) - len(seen) <= CLIPPED and meant.startswith(seen):
        return "clipped"
    return "+".join(edits(seen, meant)) if d == 2 else None


@F.pandas_udf(T.StringType())
def _error(seen: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([error_class(s, m) for s, m in zip(seen, meant)], dtype=object)


def either_way(near: DataFrame) -> DataFrame:
    """Pairs (seen, seen_n, meant, meant_n) with each ``error`` that explains them: the one that makes seen of meant, with the rows of meant, and
    the one that makes meant of seen, with those of seen: the form that is used more often may be the mistaken one. ``made`` is rows /
    strings that the error can make."""
    way = lambda e, form: F.struct(F.col(e).alias("error"), F.col(f"{form}_n").alias("rows"), F.length(form).alias("n"))
    ways = F.explode(F.array(way("there", "meant"), way("back", "seen"))).alias("way")
    told = near.withColumns({"there": _error("seen", "meant"), "back": _error("meant", "seen")}).select(*near.columns, ways).select(*near.columns, "way.*")
    both = told.filter("error is not null").withColumn("strings", _strings(F.col("error"), F.col("n")))
    return both.withColumn("made", F.col("rows") / F.col("strings")).drop("rows", "n")


def _strings(error: Column, n: Column) -> Column:
    """How many strings an error of a class can make of one of n letters."""
    n = n.cast("double")
    one = {"out": n, "in": 26 * (n + 1), "swap": n - 1, "other": 25 * n, "double": n, "clipped": F.lit(float(CLIPPED - 1))}
    return _by_class(error, one, lambda a, b: one[a] * one[b] / (2 if a == b else 1))


def _by_class(error: Column, single: dict, both) -> Column:
    """The value of an error's class; that of two errors is ``both`` of their classes."""
    out = F.lit(None).cast("double")
    for e, v in single.items():
        out = F.when(error == e, v).otherwise(out)
    for i, a in enumerate(sorted(ERRORS[:4])):
        for b in sorted(ERRORS[:4])[i:]:
            out = F.when(error == f"{a}+{b}", both(a, b)).otherwise(out)
    return out


#: Letters that the letter model tells apart; all others are one. So its table has at most 38 x 38 entries.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_model(forms: DataFrame) -> dict[tuple[str, str], float]:
    """log P(letter | letter before) over all cores, each form counted once; ^ begins and $ ends a core."""
    plain = F.concat(F.lit("^"), F.regexp_replace("core", f"[^{_LETTERS}]", "*"), F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("core") + 1), lambda i: F.substring(plain, i, F.lit(2)))
    got = forms.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()  # at most 38 x 38
    sums: dict[str, int] = {}
    for r in got:
        sums[r["p"][0]] = sums.get(r["p"][0], 0) + r["n"]
    size = len(_LETTERS) + 2
    return {(a, b): math.log((n + 1) / (sums[a] + size)) for (a, b),
        n in ((tuple(r["p"]), r["n"]) for r in got)} | {(a, ""): -math.log(sums.get(a, 0) + size) for a in f"^*{_LETTERS}"}


def _meant_as_typed(model: dict[tuple[str, str], float]):
    known = set(_LETTERS)

    @F.pandas_udf(T.DoubleType())
    def chance(cores: pd.Series) -> pd.Series:
        def one(core: str) -> float:
            s = "^" + "".join(c if c in known else "*" for c in core) + "$"
            return math.exp(sum(model.get((a, b), model[a, ""]) for a, b in zip(s, s[1:])))

        return pd.Series([one(c) for c in cores], dtype="float64")

    return chance


def _forms(names: DataFrame) -> DataFrame:
    """tab_name, name, n -> with kind and core; a name without any identifying word is its own core."""
    named = names.repartition(width(names.sparkSession)).withColumn("org", parse_org("name"))
    none = F.col("org.core") == ""
    plain = F.lower(F.regexp_replace(F.trim("name"), r"\s+", " "))
    return named.select("tab_name", "name", "n", F.when(none, F.lit("?")).otherwise(F.col("org.kind")).alias("kind"),
        F.when(none, plain).otherwise(F.col("org.core")).alias("core"))


def _keys(forms: DataFrame) -> DataFrame:
    """Forms with each key: the core, and what is left of it without any one letter, or any two of a core of eight letters or more."""
    core, n = F.col("core"), F.length("core")
    without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
    gaps = F.transform(F.sequence(F.lit(1), n), lambda i: without(core, i))
    gaps = F.concat(gaps, F.transform(gaps, lambda g: F.regexp_replace(g, r"(.)\1+", "$1")))  # letters that a gap brings together read as one
    two = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: without(without(core, j), i))))
    two = F.when(n >= 8, two).otherwise(F.array().cast("array<string>"))
    return forms.filter((F.col("kind") != "?") & (n >= 2)).select("*", F.explode(F.array_distinct(F.concat(F.array(core), gaps, two))).alias("key"))


def _stubs(forms: DataFrame) -> DataFrame:
    n = F.length("core")
    cuts = F.filter(F.sequence(F.lit(2), F.lit(CLIPPED)), lambda j: n - j >= STUB)
    return forms.filter(F.col("kind") != "?").select("*", F.explode(F.transform(cuts,
        lambda j: F.concat(F.lit("^"), F.substring(F.col("core"), F.lit(1), n - j)))).alias("key"))


def spelled_forms(forms: DataFrame) -> DataFrame:
    """``forms`` with ``own``: how many forms of the kind one expects to be this string by chance."""
    many = forms.groupBy("tab_name", "kind").agg(F.count("*").alias("of_kind"))
    return forms.join(many, ["tab_name", "kind"]).withColumn("own", F.col("of_kind") * _meant_as_typed(letter_model(forms))("core")).drop("of_kind")


def _rate(rates: dict[str, float]) -> Column:
    return _by_class(F.col("error"), rates, lambda a, b: rates[a] * rates[b] / (2 if a == b else 1))


def error_rates(pairs: DataFrame, forms: DataFrame) -> dict[str, float]:
    """Errors of each class per row, by expectation-maximisation: each seen form is one of its candidates' or its own, by the rates so far, and
    its rows count for the classes by these chances. The driver sees one row per class and round."""
    rows = float(forms.agg(F.sum("n")).first()[0] or 1)
    rates = dict(zip(ERRORS, START))
    seen = Window.partitionBy("tab_name", "kind", "seen")
    for _ in range(LEARN):
        weight = F.col("made") * _rate(rates)
        part = pairs.select("*", weight.alias("w")).withColumn("p", F.col("w") / (F.sum("w").over(seen) + F.max("own").over(seen)))
        got = {r["error"]: r["n"] for r in part.groupBy("error").agg(F.sum(F.col("p") * F.col("seen_n")).alias("n")).collect()}
        new = {e: (got.get(e, 0.0) + s * STEADY) / (rows + STEADY) for e, s in zip(ERRORS, START)}
        moved = max(abs(np.log(new[e] / rates[e])) for e in ERRORS)
        rates = new
        if moved < 0.05:
            break
    return rates


def canonical_forms(names: DataFrame) -> DataFrame:
    """names(tab_name, name, n) -> tab_name, name, n, class_id, posterior: one row per distinct non-blank name of each table.

    Null and blank names are left out. Names of one class mean one organisation; class_id is a hash of the canonical form.
    Of equally frequent forms that choose each other the greater core in byte order stays, so the result doesn't depend on the order of rows.
    """
    spelled = cut(_forms(names.filter(~blank(F.col("name")))))
    forms = cut(spelled.groupBy("tab_name", "kind", "core").agg(F.sum("n").alias("n")))
    keyed = _keys(forms)
    whole = forms.filter(F.col("kind") != "?").withColumn("key", F.concat(F.lit("^"), F.col("core")))
    better = (F.col("m.n") >= F.col("s.n")) & (F.col("m.core") != F.col("s.core"))
    on = [F.col(f"s.{c}") == F.col(f"m.{c}") for c in ("tab_name", "kind", "key")]
    take = [F.col("s.tab_name"), F.col("s.kind"), F.col("s.core").alias("seen"), F.col("s.n").alias("seen_n"),
        F.col("m.core").alias("meant"), F.col("m.n").alias("meant_n")]
    # keys are many times their forms, so their sides are never broadcast on an estimate that doesn't know it
    close = F.levenshtein("seen", "meant", 3) >= 0  # a swap counts two
    edits = keyed.hint("merge").alias("s").join(keyed.alias("m"), [*on, better]).select(take).filter(close)
    stubs = _stubs(forms)
    clipped = whole.alias("s").join(stubs.hint("merge").alias("m"), [*on, better]).select(take)
    longer = stubs.hint("merge").alias("s").join(whole.alias("m"), [*on, better]).select(take)
    pairs = either_way(edits.unionByName(clipped).unionByName(longer).distinct())  # what Python sees is near for certain
    typed = spelled_forms(forms).select("tab_name", "kind", F.col("core").alias("seen"), "own")
    pairs = pairs.join(typed.hint("merge"), ["tab_name", "kind", "seen"])
    pairs = cut(pairs.withColumn("own", F.greatest(F.col("own"), TWIN / F.col("strings")) * F.col("seen_n")))
    score = F.col("made") * _rate(error_rates(pairs, forms))
    best = (
        pairs.filter(score >= F.col("own")).groupBy("tab_name", "kind", "seen", "seen_n")
        .agg(F.max(F.struct(score.alias("score"), F.col("meant").alias("meant"), "own")).alias("best"), F.sum(score).alias("total"))
        .select("tab_name", "kind", F.col("seen").alias("core"), F.col("best.meant").alias("up"),
            (F.col("best.score") / (F.col("total") + F.col("best.own"))).alias("posterior"))
    )
    best = cut(best)
    # of two equally frequent forms that chose each other the greater one stays
    back = best.select("tab_name", "kind", F.col("core").alias("up"), F.col("up").alias("core"), F.lit(True).alias("mutual"))
    links = cut(best.join(back, ["tab_name", "kind", "core", "up"], "left").filter("mutual is null or core < up").drop("mutual"))
    for _ in range(40):  # each round halves the length of every chain
        up = links.select("tab_name", "kind", F.col("core").alias("up"), F.col("up").alias("top"))
        longer_chains = links.join(up, ["tab_name", "kind", "up"], "left")
        nxt = cut(longer_chains.select("tab_name", "kind", "core", F.coalesce("top", "up").alias("up"), "posterior", F.col("top").isNotNull().alias("moved")))
        links = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            break
    found = spelled.join(links, ["tab_name", "kind", "core"], "left")
    return found.select("tab_name", "name", "n", F.xxhash64("tab_name", "kind", F.coalesce("up", "core")).alias("class_id"),
        F.coalesce("posterior", F.lit(1.0)).alias("posterior"))


def variant_pairs(classes: DataFrame) -> DataFrame:
    """All pairs of different names of one class, name_a < name_b in byte order.

    A large class is split: its left side into blocks of about PAIR_BLOCK names, each of which meets the whole right side.
    """
    sized = classes.join(classes.groupBy("tab_name", "class_id").agg(F.count("*").alias("size")).filter("size > 1"), ["tab_name", "class_id"])
    blocks = F.ceil(F.col("size") / PAIR_BLOCK)
    left = sized.select("tab_name", "class_id", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), blocks).alias("block"))
    right = sized.select("tab_name", "class_id", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    return left.hint("merge").join(right, ["tab_name", "class_id", "block"]).filter("name_a < name_b").select("tab_name", "name_a", "name_b")


def names_of(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct names with their row counts from several tables: {tab_name: (table, column)}."""
    out = None
    for tab, (df, column) in tables.items():
        part = df.groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(tab).alias("tab_name"), "name", "n")
        out = part if out is None else out.unionByName(part)
    return out
