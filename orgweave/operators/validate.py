"""Samples and checks of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    """An order that looks random and is the same on every run."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows (here a limit is the feature)."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows of each stratum."""
    w = Window.partitionBy(*strata).orderBy(hash_order(key, seed), key)
    return df.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= n).drop("_no")


def proportional(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows, each stratum by its share (rounded down, one at least), topped up or trimmed by the hash over all strata."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size")).withColumn("_k", F.lit(1))
    total = df.agg(F.count("*").alias("_all")).withColumn("_k", F.lit(1))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_size") / F.col("_all")))
    quotas = sizes.join(F.broadcast(total), "_k").select(stratum, quota.alias("_quota"))
    w = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    ranked = df.withColumn("_no", F.row_number().over(w)).join(quotas, stratum)
    return ranked.orderBy((F.col("_no") > F.col("_quota")).cast("int"), hash_order(key, seed), key).limit(n).drop("_no", "_quota")


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts and accuracy, precision, recall, F1, false positive and negative rates; a rate over nothing is null. Rows with a null
    in either column are left out."""
    p, a = F.col(predicted).cast("boolean"), F.col(actual).cast("boolean")
    c = df.filter(p.isNotNull() & a.isNotNull()).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(fp, fp + tn).alias("false_positive_rate"),
        F.try_divide(fn, fn + tp).alias("false_negative_rate"),
    )


def accuracy_by(df: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """Shares of Yes, No and Uncertain among the answered rows of a hand-checked sample."""
    v = F.lower(F.trim(verdict))
    done = v.isin("yes", "no", "uncertain")
    return df.groupBy(*keys).agg(F.count_if(done).alias("answered"), F.count_if(v == "yes").alias("yes"), F.count_if(v == "no").alias("no"),
        F.count_if(v == "uncertain").alias("uncertain")).withColumn("accuracy", F.try_divide(F.col("yes"), F.col("yes") + F.col("no")))


def bias_ratios(df: DataFrame, year: str, value: str, early: tuple[int, int], late: tuple[int, int], matched: str) -> DataFrame:
    """Mean of the late years over that of the early ones, and the share of matched among all by value."""
    x = F.col(value)
    per = df.groupBy(year).agg(F.sum(value).alias("s"), F.sum(F.when(F.col(matched), x)).alias("m"))
    return per.agg(
        F.avg(F.when(F.col(year).between(*early), F.col("s"))).alias("early_avg"),
        F.avg(F.when(F.col(year).between(*late), F.col("s"))).alias("late_avg"), F.try_divide(F.sum("m"), F.sum("s")).alias("coverage"),
    ).withColumn("truncation_ratio", F.try_divide(F.col("late_avg"), F.col("early_avg")))


def estimated_accuracy(df: DataFrame, stage: str, rates: dict[str, float]) -> DataFrame:
    """Accuracy of all links as the mean of known rates, weighted by the links of each stage; other stages are left out."""
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col(stage)]
    return df.groupBy(stage).agg(F.count("*").alias("links")).withColumn("rate",
        rate).filter("rate is not null").agg(F.sum("links").alias("links"),
        (F.sum(F.col("links") * F.col("rate")) / F.sum("links")).alias("estimated_accuracy"))
