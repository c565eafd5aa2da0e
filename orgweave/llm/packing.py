"""Filling fixed-capacity containers: minimum bin slack.

Per bin, the longest item left is taken, and a subset-sum dynamic programme over the lengths still available, held as bits of one
integer, finds the fullest combination that fits beside it; both are removed, and the next bin begins. Items are spread over shards of
about SHARD_ITEMS by a hash, each packed by one task, so that no task grows with the data. The last bin of a shard is where slack is left:
the items of all last bins are packed again, in shards of their own, until one shard holds them. So the slack doesn't grow with the shards.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.llm.tokens import TOKENIZER, count_tokens
from orgweave.shared import cut, spread

#: Items that one task packs.
SHARD_ITEMS = 20_000


def fullest(capacity: int, counts: dict[int, int]) -> list[int]:
    """The lengths, each at most as often as it is there, whose sum comes nearest to the capacity from below."""
    reach, want = 1, 1 << capacity
    full = (want << 1) - 1
    steps: list[tuple[int, int, int]] = []  # (sums reachable before, length, copies added at once)
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left and not reach & want:  # 1, 2, 4, ... copies at once reach every number of them
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= (reach << copies * length) & full
            left, copies = left - copies, copies * 2
        if reach & want:
            break
    total, out = reach.bit_length() - 1, []
    for before, length, copies in reversed(steps):
        if not (before >> total) & 1:
            out += [length] * copies
            total -= length * copies
    return out


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices. Items of length 0 go into the first bin; no item may be longer than the capacity."""
    by_length: dict[int, list[int]] = {}
    empty = []
    for i, n in enumerate(lengths):
        (by_length.setdefault(n, []) if n > 0 else empty).append(i)
    counts = {n: len(v) for n, v in by_length.items()}
    bins: list[list[int]] = []
    while counts:
        longest = max(counts)
        take = [longest]
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        for n in fullest(capacity - longest, counts):
            take.append(n)
            counts[n] -= 1
            if not counts[n]:
                del counts[n]
        bins.append([by_length[n].pop() for n in take])
    if empty:
        if not bins:
            bins.append([])
        bins[0] += empty
    return bins


_OUT = T.StructType([
    T.StructField("container_name", T.StringType()), T.StructField("bin_id", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("piece_no", T.LongType()),
    T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


def pack_table(items: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """items(doc_id, tokens) -> container_name, bin_id, doc_id, piece_no, token_start, n_tokens for each (name, capacity).

    A document above the capacity is cut into pieces of exactly the capacity, each filling a bin of its own, and a rest that is packed
    like any other; no other document is split. Documents without tokens (null, empty) take no room and go with a shard's first bin.
    Containers of null, or of no, capacity hold nothing.
    """
    spark = items.sparkSession
    sizes = [(n, int(c)) for n, c in containers if c is not None and c > 0]
    if not sizes:
        return spark.createDataFrame([], _OUT)
    # rows are numbered once and written: a repeated row is a document of its own
    items = cut(items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.monotonically_increasing_id().alias("row")))
    shards = max(1, math.ceil(items.count() / SHARD_ITEMS))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("long").alias("capacity")) for n, c in sizes]))
    cut_up = items.select("doc_id", "tokens", "row", each.alias("c")).select("doc_id", "tokens", "row",
        F.col("c.name").alias("container_name"), F.col("c.capacity").alias("capacity"))
    over = F.col("tokens") > F.col("capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    full = cut_up.filter(over).select("container_name", "doc_id", "capacity", "row", F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("piece_no"))
    full = full.select("container_name", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row",
        "piece_no").alias("bin_id"), "doc_id", "piece_no", ((F.col("piece_no") - 1) * F.col("capacity")).alias("token_start"),
        F.col("capacity").alias("n_tokens"))
    rest = cut_up.select(
        "container_name", "capacity", "doc_id", F.when(over, whole + 1).otherwise(1).alias("piece_no"),
        F.when(over, whole * F.col("capacity")).otherwise(0).alias("token_start"),
        F.when(over, F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "tokens", "row"), F.lit(shards)).alias("shard"),
    ).filter(~((F.col("piece_no") > 1) & (F.col("n_tokens") == 0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        shard = pdf["shard"].iloc[0]
        no = [0] * len(pdf)
        for b, members in enumerate(pack(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))):
            for i in members:
                no[i] = b
        pdf["bin_id"] = [f"{round_}-{shard}-{b}" for b in no]
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")  # may be null
        pdf["last"] = pd.Series(no) == max(no)
        return pdf[[*_OUT.names, "capacity", "last"]]

    done, round_ = full, 0
    while True:
        packed = rest.groupBy("container_name", "shard").applyInPandas(run,
            T.StructType([*_OUT.fields, T.StructField("capacity", T.LongType()), T.StructField("last", T.BooleanType())]))
        if shards == 1:
            return packed.select(_OUT.names).unionByName(done)
        packed = cut(packed)
        done = done.unionByName(packed.filter("not last").select(_OUT.names))
        left, round_ = packed.filter("last"), round_ + 1
        shards = min(shards // 2, max(1, math.ceil(left.count() / len(sizes) / SHARD_ITEMS)))
        rest = left.select("container_name", "capacity", "doc_id", "piece_no", "token_start", "n_tokens",
            F.pmod(F.xxhash64("doc_id", "piece_no", "bin_id"), F.lit(shards)).alias("shard"))


def pack_documents(docs: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = [(r["container_name"], r["capacity_tokens"]) for r in containers.select("container_name",
        "capacity_tokens").distinct().orderBy("container_name", "capacity_tokens").collect()]  # a few kinds of container
    items = spread(docs.select("doc_id", "text")).select("doc_id", count_tokens(F.col("text"), tokenizer).alias("tokens"))
    return pack_table(items, sizes)


def report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: bins, their fill, and how many more there are than the tokens need at least."""
    per = packed.groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("container_name").agg(F.count("*")
        .alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    sized = per.join(containers.groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity_tokens")), "container_name")
    room = F.col("bins") * F.col("capacity_tokens")
    return sized.select("container_name", "capacity_tokens", "bins", "tokens", "fullest", F.round(F.col("tokens") / room, 6).alias("fill"),
        (F.col("bins") - F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("bins_above_bound"))


def check(packed: DataFrame, items: DataFrame, containers: DataFrame) -> DataFrame:
    """What must hold of any packing of items(doc_id, tokens), per container: container_name, documents (of the packing), pieces_lost (documents
    whose pieces don't add up to their tokens, or don't follow on each other), overfull (bins above the capacity), split_too_small (documents
    in pieces that would fit whole). Documents without an id are counted as one."""
    sizes = containers.groupBy("container_name").agg(F.max("capacity_tokens").alias("capacity"))
    per = packed.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"),
        F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    whole = items.groupBy("doc_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count("*").alias("copies"))
    same = per.join(whole.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "full_outer").join(sizes, "container_name", "left")
    lost = F.coalesce(F.col("got") != F.col("tokens"), F.lit(True)) | ((F.col("copies") == 1) & (F.col("end") != F.col("tokens")))
    docs = same.groupBy("container_name").agg(F.count("*").alias("documents"), F.count_if(lost).alias("pieces_lost"),
        F.count_if((F.col("copies") == 1) & (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split_too_small"))
    bins = packed.groupBy("container_name", "bin_id").agg(F.sum("n_tokens").alias("used")).join(sizes, "container_name")
    over = bins.groupBy("container_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return docs.join(over, "container_name").select("container_name", "documents", "pieces_lost", "overfull", "split_too_small")
