"""Keeping one row of several, and tables put together. Every choice has a total order: ties never depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order; rows equal in it are decided by all their columns.

    Null keys are one group. ``order`` may hold ascending or descending columns. The ranking keeps one row per key and task before it is
    shuffled (a limit on the rank is pushed below the exchange), so a key that holds a third of all rows stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order, *[F.col(f"`{c}`").cast("string") for c in df.columns if c not in keys])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_max(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The same for one falling score: an aggregate instead of a sort; of equals the row with the least ``ties``, then columns."""
    rest = [c for c in df.columns if c not in keys and c != score and c not in ties]
    pick = F.min_by(F.struct(*df.columns), F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))).alias("_s"), *ties,
        *[F.col(c).cast("string").alias(f"_{c}") for c in rest]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def drop_ambiguous(df: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key has exactly one value of ``other``; the key's values are counted, not gathered."""
    alone = df.groupBy(key).agg(F.min(other).alias("_a"), F.max(other).alias("_b")).filter("_a = _b").select(key)
    return df.join(alone, key, "left_semi")


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left side has exactly one right side."""
    return drop_ambiguous(pairs, left, right)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all, columns by name; what a table lacks is null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are in a only, in b only and in both; null keys aside."""
    x = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
