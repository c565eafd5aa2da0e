"""Mixing sources to target weights.

Each source's documents are put into a random order by a hash; prefix sums of their tokens, computed in two distributed levels (buckets
of the hash range, and within them), tell for each document where it lies in that order. The largest mix that keeps all shares uses some
source to its limit; every other source is taken for as many whole epochs as its budget holds, and then up to its exact budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.llm.tokens import TOKENIZER, count_tokens
from orgweave.shared import cut, spread

#: Documents of one source that one range of hashes holds, about.
RANGE_DOCS = 10_000
#: Most rows of the table of targets for which it is sent to every executor.
FEW_TARGETS = 100_000


def prefix_sums(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs(doc_id, source, tokens) -> with ``upto``: tokens of the documents of the source up to and including this one.

    The order is that of hash(doc_id, seed), ties by doc_id and tokens. No range of hashes holds much more than RANGE_DOCS documents
    of a source, so no task grows with the data; the running sums of whole ranges are one small row each.
    """
    count = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(max(1, count / RANGE_DOCS))))
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    placed = cut(docs.withColumn("order", order).withColumn("range", F.shiftright(F.col("order"), 63 - bits) if bits else F.lit(0).cast("long")))
    sums = placed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(offsets, ["source", "range"]).withColumn("upto", F.col("offset") + F.sum("tokens").over(inside)).drop("order", "range", "offset")


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, available, budget, epochs, rest: what each source gives to each mix.

    A named source without any tokens gives nothing, and the others keep their shares to each other; shares and repeats that are null or
    not positive count as 0. Rows of targets that name one source of a mix twice are added up.
    """
    wanted = targets.groupBy("mix_name", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    there = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    p = wanted.join(there, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    useful = (F.col("target_share") > 0) & (F.col("available") > 0) & (F.col("max_repeats") > 0)
    most = F.when(useful, F.col("max_repeats") * F.col("available") / F.col("target_share"))
    p = p.withColumn("size", F.min(most).over(Window.partitionBy("mix_name")))
    budget = F.when(useful, F.least(F.floor(F.col("target_share") * F.col("size") + 1e-6), F.col("max_repeats") * F.col("available"))).otherwise(0)
    p = p.withColumn("budget", budget.cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.greatest("available", F.lit(1)))).otherwise(0)
    return p.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")).drop("size")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """docs(doc_id, source, tokens) -> mix_name, source, doc_id, tokens, copies: the documents of each mix and how often each is used.

    Documents whose source is null or not named are not used. Each source stays below its budget by less than one document.
    """
    docs = docs.select("doc_id", "source", "tokens")
    plans = cut(plan(docs, targets))
    if plans.count() <= FEW_TARGETS:
        plans = F.broadcast(plans)
    placed = prefix_sums(docs.filter(F.col("source").isNotNull()), seed)
    used = placed.join(plans.select("mix_name", "source", "epochs", "rest"), "source")
    copies = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return used.withColumn("copies", copies.cast("long")).filter("copies > 0").select("mix_name", "source", "doc_id", "tokens", "copies")


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of a table with doc_id, source and text, counted once."""
    return cut(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", count_tokens(F.col("text"), tokenizer).alias("tokens")))


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, actual_share, tokens_used, documents, most_copies."""
    used = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"),
        F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(used, ["mix_name", "source"], "left").na.fill(0, ["tokens_used", "documents", "most_copies"])
    total = F.sum("tokens_used").over(Window.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", F.round(F.try_divide(F.col("tokens_used"), total), 6).alias("actual_share"),
        "tokens_used", "documents", "most_copies", "max_repeats")


def check(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What must hold of any mix of docs(doc_id, source, tokens): mix_name, source, over_repeats (documents used too often), over_budget and
    short (1 if the source gives more than its share of the largest possible mix, or falls short of it by a document or more)."""
    p = plan(docs, targets)
    used = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most"))
    longest = docs.groupBy("source").agg(F.max("tokens").alias("longest"))
    both = p.join(used, ["mix_name", "source"], "left").join(longest, "source", "left").na.fill(0, ["used", "most", "longest"])
    flag = lambda c, n: c.cast("int").alias(n)
    return both.select("mix_name", "source", flag(F.col("most") > F.col("max_repeats"), "over_repeats"),
        flag(F.col("used") > F.col("budget"), "over_budget"), flag((F.col("budget") > 0) & (F.col("used") <= F.col("budget") - F.col("longest")), "short"))
