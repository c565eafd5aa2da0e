"""Measures over panels: growth, indices, concentration, distribution, decline, gaps and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.operators.prefix import running


def growth(df: DataFrame, year: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Percent over the year before in the table; null for the first and after a zero."""
    before = F.lag(value).over(Window.partitionBy(*(keys or [])).orderBy(year))
    return df.withColumn("growth_pct", F.try_divide(F.col(value) - before, before) * 100)


def index_to_base(df: DataFrame, keys: list[str], year: str, value: str, base: int, keep_without: bool = True) -> DataFrame:
    """Value / value in the base year x 100; groups without it are null, or left out."""
    at = F.max(F.when(F.col(year) == base, F.col(value))).over(Window.partitionBy(*keys))
    out = df.withColumn("index_value", F.try_divide(F.col(value), at) * 100)
    return out if keep_without else out.filter(F.col("index_value").isNotNull())


def _totals(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).cast("double").alias("x")).filter("x is not null")


def hhi(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of squared shares x 10000, from two sums (no window over all rows)."""
    return _totals(df, key, value).agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"),
        F.count("*").alias("entities")).select("entities", (F.try_divide(F.col("q"), F.col("s") * F.col("s")) * 10000).alias("hhi"))


def _ranked(totals: DataFrame) -> DataFrame:
    """x, n, below, sum_below: each distinct total, how many entities have it, and how many, of what sum, have less."""
    distinct = totals.groupBy("x").agg(F.count("*").cast("double").alias("n"))
    return running(distinct, [F.asc("x")], below=F.col("n"), sum_below=F.col("n") * F.col("x"))


def gini(df: DataFrame, key: str, value: str) -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over totals in rising order; equal totals share the sum of their ranks."""
    r = _ranked(_totals(df, key, value))
    ranks = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    a = r.agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"), F.sum(F.col("x") * ranks).alias("w"))
    return a.select(F.col("n").cast("long").alias("entities"),
        (F.try_divide(2 * F.col("w"), F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def top_share(df: DataFrame, key: str, value: str, tops: list[int]) -> DataFrame:
    """Percent of the total that the n greatest hold. Ties at the cut count as equal, so their order doesn't matter."""
    totals = _totals(df, key, value)
    most = totals.orderBy(F.desc("x"), key).limit(max(tops)).withColumn("no", F.row_number().over(Window.orderBy(F.desc("x"), key)))
    all_ = totals.agg(F.sum("x").alias("s"))
    part = most.agg(*[F.sum(F.when(F.col("no") <= n, F.col("x"))).alias(f"t{n}") for n in tops])
    return _top_rows(part, all_, tops)


def _top_rows(part: DataFrame, all_: DataFrame, tops: list[int]) -> DataFrame:
    one = part.withColumn("_k", F.lit(1)).join(all_.withColumn("_k", F.lit(1)), "_k")  # one row each
    rows = F.array(*[F.struct(F.lit(n).alias("top_n"), (F.try_divide(F.col(f"t{n}"), F.col("s")) * 100).alias("share_pct")) for n in tops])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def lorenz(df: DataFrame, key: str, value: str) -> DataFrame:
    """For each distinct total in rising order the share of entities and of the sum at or below it."""
    r = _ranked(_totals(df, key, value))
    a = r.agg(F.sum("n").alias("all_n"), F.sum(F.col("x") * F.col("n")).alias("all_s")).withColumn("_k", F.lit(1))
    upto = F.col("sum_below") + F.col("x") * F.col("n")
    one = r.withColumn("_k", F.lit(1)).join(F.broadcast(a), "_k")  # one row
    return one.select("x", ((F.col("below") + F.col("n")) / F.col("all_n")).alias("entity_share"), F.try_divide(upto, F.col("all_s")).alias("value_share"))


def _places(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with _no, the place of a row (from 1) among those of its keys, and _n, how many there are: ranks in one order over all rows, less
    the rows of the groups before. No group is sorted by one task."""
    ranked = running(df, [*[F.asc(k) for k in keys], *order], _before=F.lit(1))
    groups = ranked.groupBy(*keys).agg(F.min("_before").alias("_first"), F.count("*").alias("_n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    joined = ranked.alias("r").join(groups.alias("g"), same)
    return joined.select("r.*", "g._first", "g._n").withColumn("_no", F.col("_before") - F.col("_first") + 1).drop("_before", "_first")


def concentration_at(df: DataFrame, key: str, year: str, value: str, checkpoints: list[int], top: int = 10) -> DataFrame:
    """Per checkpoint year, ranks by the sum up to it; the share in that year of the top 1 % (one at least) and of the ``top``."""
    cps = F.explode(F.array(*[F.lit(c) for c in checkpoints]))
    upto = df.select(key, year, value, cps.alias("checkpoint")).filter(F.col(year) <= F.col("checkpoint"))
    per = upto.groupBy("checkpoint", key).agg(F.sum(value).alias("cumulative"),
        F.sum(F.when(F.col(year) == F.col("checkpoint"), F.col(value))).alias("in_year"))
    ranked = _places(per, ["checkpoint"], [F.desc_nulls_last("cumulative"), F.asc(key)])
    one = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.01))
    return ranked.groupBy("checkpoint").agg(
        F.max("_n").alias("entities"), (F.try_divide(F.sum(F.when(F.col("_no") <= one, F.col("in_year"))), F.sum("in_year")) * 100).alias("top1pct_share"),
        (F.try_divide(F.sum(F.when(F.col("_no") <= top, F.col("in_year"))), F.sum("in_year")) * 100).alias("top_share"),
    )


def new_entrants(df: DataFrame, key: str, year: str) -> DataFrame:
    """Entities per year in which they first occur."""
    return df.filter(F.col(year).isNotNull()).groupBy(key).agg(F.min(year).alias("entry_year")).groupBy("entry_year").agg(F.count("*").alias("new_entrants"))


def leaders(df: DataFrame, key: str, value: str, share: float = 0.01) -> DataFrame:
    """The greatest 1 % of entities (one at least), ties by key."""
    t = _totals(df, key, value)
    n = max(1, int(t.count() * share))
    return running(t, [F.desc("x"), F.asc(key)], before=F.lit(1)).filter(F.col("before") < n).select(key, F.col("x").alias("total"))


def decline(df: DataFrame, key: str, year: str, value: str, after: int) -> DataFrame:
    """Peak year (ties: the first), means up to and after a year, change in percent; only entities with both sides."""
    pre, post = F.col(year) <= after, F.col(year) > after
    a = df.groupBy(key).agg(
        F.sum(value).alias("total"), F.min_by(year, F.struct(-F.col(value), year)).alias("peak_year"), F.max(value).alias("peak_value"),
        F.avg(F.when(pre, F.col(value))).alias("pre"), F.avg(F.when(post, F.col(value))).alias("post"),
    ).filter("pre is not null and post is not null")
    pct = F.when(F.col("pre") > 0, F.round((F.col("post") - F.col("pre")) / F.col("pre") * 100, 2)).otherwise(0.0)
    return a.select(key, "total", "peak_year", "peak_value", F.round("pre", 2).alias("pre_avg"), F.round("post", 2).alias("post_avg"),
        pct.alias("decline_pct"), (F.col("peak_year") <= after).alias("peak_before"), (F.col("post") < F.col("pre")).alias("has_decline"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], nearest: bool = False) -> DataFrame:
    """Exact quantiles per group, linear or the nearest value (halves to the even place); null values are left out.

    Equal values are counted first; the place of each distinct value comes from running counts, so no group is gathered or sorted in one task."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = running(counted, [*[F.asc(k) for k in keys], F.asc(value)], _before=F.col("_c"))
    groups = placed.groupBy(*keys).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_n"))
    joined = placed.alias("r").join(groups.alias("g"), [F.col(f"r.{k}")
        .eqNullSafe(F.col(f"g.{k}")) for k in keys]) if keys else placed.withColumn("_k",
            F.lit(1)).alias("r").join(F.broadcast(groups.withColumn("_k", F.lit(1))).alias("g"), "_k")
    low, high = F.col("_before") - F.col("_first"), F.col("_before") - F.col("_first") + F.col("_c")
    at = lambda place: F.max(F.when((place >= low) & (place < high), F.col(f"r.{value}")))
    spot = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    picks = [at(F.bround(spot(q), 0)).alias(f"q{round(q * 100)}") for q in qs] if nearest else [f(i, q) for i,
        q in enumerate(qs) for f in (lambda i, q: at(F.floor(spot(q))).alias(f"l{i}"), lambda i, q: at(F.ceil(spot(q))).alias(f"h{i}"))]
    out = joined.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(*picks, *([] if nearest else [F.max("_n").alias("_n")]))
    if nearest:
        return out
    part = lambda q: spot(q) - F.floor(spot(q))
    return out.select(*keys, *[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * part(q)).alias(f"q{round(q * 100)}") for i, q in enumerate(qs)])


def right_closed(c: Column, cuts: list[float]) -> Column:
    """Labels of right-closed intervals; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    low = "-inf"
    for x in cuts:
        out = out.when(c <= x, f"({low}, {x}]")
        low = str(x)
    return out.otherwise(f"({low}, inf]")


def share_of_total(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Percent of the sum over all rows; the sum is one row."""
    total = df.agg(F.sum(value).alias("_total")).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").withColumn(out,
        F.try_divide(F.col(value) * 100.0, F.col("_total"))).drop("_total", "_k")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column, type, rows, nulls, percent missing, distinct values, least and greatest as text. Each column is read by itself and its
    values counted before they are shuffled; no row is expanded once per column."""
    types = dict(df.dtypes)

    def one(c: str) -> DataFrame:
        x = df.select(F.col(f"`{c}`").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        a = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("x").alias("distinct_values"),
            F.min("x").cast("string").alias("least"), F.max("x").cast("string").alias("greatest"))
        missing = F.round(F.try_divide(F.col("nulls") * 100.0, F.col("rows")), 4)
        return a.select(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), "rows", "nulls", missing.alias("missing_pct"),
            "distinct_values", "least", "greatest")

    return reduce(lambda a, b: a.unionByName(b), [one(c) for c in columns])


def column_examples(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """The k most frequent values of each column as text (ties: the least), with their counts."""

    def one(c: str) -> DataFrame:
        x = df.select(F.col(f"`{c}`").cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        return x.orderBy(F.desc("n"), "value").limit(k).select(F.lit(c).alias("column_name"), "value", "n")

    return reduce(lambda a, b: a.unionByName(b), [one(c) for c in columns])


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each text column the values that begin with a date yyyy-MM-dd, how many, and the first and last of them."""
    day = lambda c: F.to_date(F.try_to_timestamp(F.left(F.col(f"`{c}`"), F.lit(10)), F.lit("yyyy-MM-dd")))
    one = df.agg(*[f(day(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("dates"), F.col(f"a{i}").alias("first_day"),
        F.col(f"b{i}").alias("last_day")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def interval_counts(df: DataFrame, value: str, bins: list[tuple[float, float, str]]) -> DataFrame:
    """Label, n, pct of all rows for bins that may overlap or leave gaps: low <= value < high, or value = low where both are equal.
    Values in a gap are in no bin, those in an overlap in each."""
    x = F.col(value)
    inside = lambda lo, hi: (x == lo) if lo == hi else (x >= lo) & (x < hi)
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(inside(lo, hi)).alias(f"b{i}") for i, (lo, hi, _) in enumerate(bins)])
    rows = F.array(*[F.struct(F.lit(i).alias("bin_no"), F.lit(label).alias("label"), F.col(f"b{i}").alias("n"),
        F.round(F.try_divide(F.col(f"b{i}") * 100.0, F.col("_all")), 4).alias("pct")) for i, (_, _, label) in enumerate(bins)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def like_counts(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """One row: all rows, and per name those whose text is LIKE the pattern."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(column).like(p)).alias(n) for n, p in patterns.items()])


def list_counts(df: DataFrame, key: str, items: Column) -> DataFrame:
    """Item, n (occurrences), records (that have it), for a list column; null and blank items are left out. Two-phase hash aggregates take
    the place of accumulators that are merged chunk by chunk."""
    each = df.select(F.col(key).alias("_key"), F.explode(items).alias("item")).filter(F.trim("item") != "")
    return each.groupBy("item", "_key").agg(F.count("*").alias("n")).groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


def total_of_group(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Each row with the sum of its key; rows of a null key are one group. Summed first and joined back, so that no group is held by a task."""
    sums = df.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(out))
    return df.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def yearly_totals(df: DataFrame, year: str, entity: str) -> DataFrame:
    """Per year the rows and the entities of them; entities are counted per year before years are summed."""
    per = df.groupBy(F.col(entity).alias("_e"), F.col(year).alias("year")).agg(F.count("*").alias("n"))
    return per.groupBy("year").agg(F.sum("n").alias("publications"), F.count("_e").alias("entities"))


def grouped_by_year(df: DataFrame, year: str, kind: str, entity: str) -> DataFrame:
    """Per year and kind the rows and distinct entities."""
    return df.groupBy(F.col(year).alias("year"), kind).agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"))


def gaps(df: DataFrame, ts: str, days: int, per_day: float, tolerance: float = 0.99) -> DataFrame:
    """Periods of ``days`` from the first day on whose count lies below per_day x days x tolerance; empty periods count 0."""
    d = df.select(F.to_date(ts).alias("d")).filter("d is not null")
    per = d.groupBy("d").agg(F.count("*").alias("n"))
    span = per.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    cal = span.filter("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {days} day"))).alias("period_start"), "a")
    binned = per.withColumn("_k", F.lit(1)).join(F.broadcast(span.withColumn("_k", F.lit(1))),
        "_k").select(F.expr(f"date_add(a, cast(floor(datediff(d, a) / {days}) * {days} as int))").alias("period_start"), "n")
    counts = binned.groupBy("period_start").agg(F.sum("n").alias("n"))
    out = cal.join(counts, "period_start", "left").select("period_start", F.coalesce("n", F.lit(0)).alias("records"))
    return out.filter(F.col("records") < per_day * days * tolerance).withColumn("expected", F.lit(float(per_day * days)))


def pivot_sum(df: DataFrame, rows: str, columns: str, values: list, value: str, total: str = "total") -> DataFrame:
    """A column per given value, 0 where there is nothing, and their sum."""
    out = df.groupBy(rows).pivot(columns, values).agg(F.sum(value)).na.fill(0)
    return out.withColumn(total, reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values]))
