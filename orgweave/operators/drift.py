"""Schemas that drift between files: what changed from file to file, and one consistent table.

Each file's schema is a graph: its fields, with their names, types and nesting. Where fields go and others come between a file and the one
before in its feed, each pair of a field that went and one that came is a node of the graph that both schemas make together; it is linked
with the node of its pair of names (one node for all files and feeds, so that what is plain in one file speaks for the same names in
another), with that of its pair of types, and with that of its pair of nestings. Similarity flooding starts from the likeness of names
and values and passes scores on along these links until nothing moves. Fields that stay are the anchors: two names that stand side by side
in one file are different fields, and each such file counts as a score of 0 for their pair. The flooded score decides which pairs are
renames, and a consistent one-to-one set is read off.

Rows are reduced to one profile per file and field before anything is compared (partial aggregation, so a file or feed that holds a
third of all rows is no burden); pairs, their likeness and their scores are tables, whatever the width of a file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.shared import cut, spread

#: Counters of a field's value sketch; the size of a profile is bounded by it. Values that share one are taken for equal.
BUCKETS = 4096
#: Least flooded score (0 to 1) for a new name to take over an old one.
ACCEPT = 0.4
#: Share of a node's score that comes along its links, and of it the shares of names, types and nesting.
FLOW, BY_NAMES, BY_TYPES, BY_NESTING = 0.6, 0.9, 0.05, 0.05
#: The flooding ends when no score moves by more than this; each round shrinks what moves at least by FLOW, so the rounds are bounded.
TOLERANCE, ROUNDS = 1e-3, 30
KINDS = ("string", "number", "boolean", "object", "list of lists", "list")


def value_kind(v: Column) -> Column:
    """string, number, boolean, object, list or list of lists; null for null."""
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), None).when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY<ARRAY"), "list of lists").when(t.startswith("ARRAY"), "list").otherwise("number")
    )


def field_values(raw: DataFrame) -> DataFrame:
    """feed, file_no, file_seq, field, value (variant) of every member of every readable record."""
    v = raw.select("feed", "file_no", "file_seq", F.try_parse_json("record").alias("v"))
    return v.filter(F.col("v").isNotNull()).select("feed", "file_no", "file_seq",
        F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("field", "value"))


def profiles(values: DataFrame) -> DataFrame:
    """file_no, field, kind: the kind that most non-null values of the field have in the file (ties: in the order of KINDS).

    A list counts as a list of lists if any of the file's lists is one: an empty list is either.
    """
    kind = value_kind(F.col("value"))
    counts = values.select("file_no", "field", kind.alias("k")).groupBy("file_no", "field").agg(*[F.count_if(F.col("k") == k).alias(k) for k in KINDS])
    merged = {k: F.col(f"`{k}`") for k in KINDS}
    merged["list of lists"] = F.when(merged["list of lists"] > 0, merged["list of lists"] + merged["list"]).otherwise(0)
    merged["list"] = F.when(F.col("`list of lists`") > 0, 0).otherwise(merged["list"])
    best = F.greatest(*merged.values())
    chosen = F.lit(None).cast("string")
    for k in reversed(KINDS):
        chosen = F.when((merged[k] == best) & (best > 0), k).otherwise(chosen)
    return counts.select("file_no", "field", chosen.alias("kind"))


def sketches(values: DataFrame) -> DataFrame:
    """file_no, field, b, c: how often words, and numbers by magnitude, fall into each of BUCKETS counters."""
    text = F.regexp_replace(F.to_json("value"), r'"(?:[^"\\]|\\.)*"\s*:', " ")  # the values of an object, not its keys
    words = F.regexp_extract_all(text, F.lit(r"(?U)([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\p{L}\d])|[\p{L}\p{N}]+)"), 1)
    word = values.select("file_no", "field", F.explode(words).alias("w"))
    x = F.expr("try_cast(w as double)")
    whole = F.when(F.col("w").contains("."), "f").otherwise("i")
    number = F.concat(F.lit("#"), whole, F.when(x == 0, "0").otherwise(F.floor(F.log10(F.abs(x)) * 2).cast("string")))
    token = F.when(x.isNotNull() & ~F.isnan(x), number).otherwise(F.lower("w"))
    return word.select("file_no", "field", F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int").alias("b")).groupBy("file_no", "field",
        "b").agg(F.count("*").alias("c"))


def name_words(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w]


def _word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    stem = 0
    while stem < min(len(a), len(b)) and a[stem] == b[stem]:
        stem += 1
    return stem / max(len(a), len(b)) if stem >= 3 else 0.0


def name_similarity(a: str, b: str) -> float:
    """Words in common or of one stem, initials that stand for words, letters in common."""
    x, y = name_words(a), name_words(b)
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    scores = []
    for p, q in ((x, y), (y, x)):
        hit, text = 0.0, "".join(w[0] for w in q)
        for w in p:
            near = max(_word_similarity(w, v) for v in q)
            if 2 <= len(w) <= 5 and (w in text or (len(w) >= 3 and _subsequence(text, w) and len(text) >= len(w) - 1)):
                near = 1.0
            hit += near
        scores.append(hit / len(p))
    grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in ("".join(x), "".join(y))]
    gram = len(grams[0] & grams[1]) / max(1, len(grams[0] | grams[1]))
    return max(0.25 * min(scores) + 0.75 * max(scores), gram) if max(scores) > 0 else gram


def _subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


@F.pandas_udf(T.DoubleType())
def _names_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def evidence(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``pairs`` (file_no, old_name, new_name, old_kind, new_kind) with ``start``, 0 to 1: values 0.6 and name 0.4, or name alone 0.6, or, of
    fields that hold words, values alone 0.8; a little less if the kinds differ. Values count by the cosine of the roots of their counters,
    and as much as the name where one side has none.

    ``old`` and ``new``: file_no (that of the pair), field, b, c. Counters meet in a join, so no pair carries sketches along."""
    size = lambda df, n: df.groupBy("file_no", F.col("field").alias(n)).agg(F.sum("c").alias(f"{n}_size"))
    o = old.select("file_no", "b", F.col("field").alias("old_name"), F.col("c").alias("c1"))
    n = new.select("file_no", "b", F.col("field").alias("new_name"), F.col("c").alias("c2"))
    dot = o.hint("merge").join(n, ["file_no", "b"]).groupBy("file_no", "old_name", "new_name").agg(F.sum(F.sqrt(F.col("c1") * F.col("c2"))).alias("dot"))
    names = spread(cut(pairs.select("old_name", "new_name").distinct())).withColumn("name", _names_alike("old_name", "new_name"))
    full = pairs.hint("merge").join(names, ["old_name", "new_name"]).join(dot, ["file_no", "old_name", "new_name"],
        "left").join(size(old, "old_name"), ["file_no", "old_name"], "left").join(size(new, "new_name"), ["file_no", "new_name"], "left")
    cosine = F.coalesce(F.col("dot"), F.lit(0.0)) / F.sqrt(F.col("old_name_size") * F.col("new_name_size"))
    value = F.coalesce(cosine, F.col("name"))
    numeric = lambda k: F.coalesce(F.col(k).isin("number", "boolean"), F.lit(False))
    by_words = F.when(numeric("old_kind") | numeric("new_kind"), 0.0).otherwise(0.8 * value)  # many words in common say more than like numbers do
    same = F.when(F.col("old_kind").eqNullSafe(F.col("new_kind")), 1.0).otherwise(0.9)
    start = F.greatest(0.6 * value + 0.4 * F.col("name"), by_words, 0.6 * F.col("name")) * same
    return full.select("file_no", "old_name", "new_name", "old_kind", "new_kind", start.alias("start"))


def _nesting(kind: Column) -> Column:
    return F.when(kind.isin("string", "number", "boolean"), "scalar").otherwise(F.coalesce(kind, F.lit("null")))


def flood(pairs: DataFrame, schemas: DataFrame) -> DataFrame:
    """``pairs`` of ``evidence`` with ``score``, the fixed point of the flooding. ``schemas``: file_no, field of all files, for the anchors.

    A pair keeps 1 - FLOW of its start and takes FLOW of the mean of its neighbours: the node of its two names, whose score is the mean over
    all pairs with these names, in either direction, and over the files in which both names stand, as 0; the nodes of its two types and
    nestings, whose scores are the means over their pairs. Scores only depend on a pair's start and its nodes, so the rounds run over the
    distinct combinations of nodes, with the sums of their starts: as many rows as there are schemas' combinations, not files."""
    a, b = F.least("old_name", "new_name"), F.greatest("old_name", "new_name")
    nodes = {"types": F.concat_ws(">", F.coalesce("old_kind", F.lit("null")), F.coalesce("new_kind", F.lit("null"))),
        "nesting": F.concat_ws(">", _nesting(F.col("old_kind")), _nesting(F.col("new_kind")))}
    p = cut(pairs.withColumns({"a": a, "b": b, **nodes}))
    both = p.select("a", "b").distinct()
    beside = both.join(schemas.select("file_no", F.col("field").alias("a")), "a").join(schemas.select("file_no", F.col("field").alias("b")),
        ["file_no", "b"]).groupBy("a", "b").agg(F.count("*").alias("apart"))
    combined = p.groupBy("a", "b", "types", "nesting").agg(F.count("*").alias("n"), F.sum("start").alias("sum"))
    state = cut(combined.join(beside, ["a", "b"], "left").select("a", "b", "types", "nesting", "n", "sum",
        F.coalesce("apart", F.lit(0)).alias("apart"), F.lit(0.0).alias("flow"), F.lit(True).alias("first")))
    for _ in range(ROUNDS):
        # the sum of scores of a combination, with what flowed to each of its pairs in the round before
        held = state.withColumn("total", F.when(F.col("first"), F.col("sum")).otherwise((1 - FLOW) * F.col("sum") + FLOW * F.col("n") * F.col("flow")))
        by_name = held.groupBy("a", "b").agg((F.sum("total") / (F.sum("n") + F.max("apart"))).alias("by_name"))
        by_type = held.groupBy("types").agg((F.sum("total") / F.sum("n")).alias("by_type"))
        by_nest = held.groupBy("nesting").agg((F.sum("total") / F.sum("n")).alias("by_nest"))
        flow = BY_NAMES * F.col("by_name") + BY_TYPES * F.col("by_type") + BY_NESTING * F.col("by_nest")
        nxt = held.join(by_name, ["a", "b"]).join(by_type, "types").join(by_nest, "nesting")
        nxt = cut(nxt.select("a", "b", "types", "nesting", "n", "sum", "apart", flow.alias("flow"), F.lit(False).alias("first"),
            F.abs(flow - F.col("flow")).alias("moved")))
        state = nxt.drop("moved")
        if nxt.filter(F.col("moved") > TOLERANCE).isEmpty():
            break
    flowed = p.join(state.select("a", "b", "types", "nesting", "flow"), ["a", "b", "types", "nesting"])
    return flowed.select(*pairs.columns, ((1 - FLOW) * F.col("start") + FLOW * F.col("flow")).alias("score"))


_MATCHES = T.ArrayType(T.StructType([T.StructField("old_name", T.StringType()), T.StructField("new_name", T.StringType())]))


def consistent(pairs: list[tuple[float, str, str]]) -> list[tuple[str, str]]:
    """A consistent choice of (score, old name, new name): by falling score (ties: by names), each field once."""
    taken_old, taken_new, out = set(), set(), []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in taken_old and b not in taken_new:
            taken_old.add(a)
            taken_new.add(b)
            out.append((a, b))
    return out


@F.pandas_udf(_MATCHES)
def _choose(pairs: pd.Series) -> pd.Series:
    return pd.Series([[{"old_name": a, "new_name": b} for a, b in consistent([(r["score"], r["old_name"], r["new_name"]) for r in rows])] for rows in pairs])


def correspondences(scored: DataFrame) -> DataFrame:
    """file_no, old_name, new_name: of each file's pairs whose flooded score suffices a consistent choice."""
    kept = scored.filter(F.col("score") >= ACCEPT).groupBy("file_no").agg(F.collect_list(F.struct("score", "old_name", "new_name")).alias("pairs"))  # the fields of one file
    return kept.select("file_no", F.explode(_choose("pairs")).alias("m")).select("file_no", "m.old_name", "m.new_name")


def schema_changes(raw: DataFrame) -> DataFrame:
    """feed, file_seq, file_no, field_name, old_name, change_kind (added, removed, renamed, retyped), old_kind, new_kind.

    Unreadable records and records that are no object have no fields; a file without readable records has none at all. Repeated lines
    change nothing. A field whose values are all null in one of two neighbouring files keeps its last known kind. Rows without feed,
    file number or sequence are left out. Files with one file_seq in a feed come in the order of file_no.
    """
    raw = raw.filter(F.col("feed").isNotNull() & F.col("file_no").isNotNull() & F.col("file_seq").isNotNull())
    in_feed = Window.partitionBy("feed").orderBy("file_seq", "file_no")
    files = raw.select("feed", "file_seq", "file_no").distinct().withColumn("at", F.row_number().over(in_feed)).withColumn("before",
        F.lag("file_no").over(in_feed))
    files = cut(files)
    values = field_values(raw)
    prof = cut(profiles(values))
    # the last known kind of a field that is null throughout a file
    named = prof.join(files.select("file_no", "feed", "at"), "file_no")
    known = F.last("kind", ignorenulls=True).over(Window.partitionBy("feed", "field").orderBy("at"))
    named = named.withColumn("kind", known)
    pair = files.filter("before is not null")
    old = named.select(F.col("file_no").alias("before"), "field", F.col("kind").alias("old_kind")).join(pair.select("before", "file_no"),
        "before").select("file_no", "field", "old_kind", F.lit(True).alias("was"))
    new = named.join(pair.select("file_no"), "file_no", "left_semi").select("file_no", "field", F.col("kind").alias("new_kind"), F.lit(True).alias("is"))
    both = cut(old.join(new, ["file_no", "field"], "full_outer"))
    gone, come = both.filter("is is null"), both.filter("was is null")
    # only files where something goes and something comes need sketches
    pairs = cut(gone.select("file_no", F.col("field").alias("old_name"),
        "old_kind").join(come.select("file_no", F.col("field").alias("new_name"), "new_kind"), "file_no"))
    before = pair.select("file_no", "before")
    need_old = pairs.select("file_no", F.col("old_name").alias("field")).distinct().join(before,
        "file_no").select(F.col("before").alias("src"), "file_no", "field")
    need_new = pairs.select(F.col("file_no").alias("src"), "file_no", F.col("new_name").alias("field")).distinct()
    wanted = cut(need_old.unionByName(need_new).select(F.col("src").alias("file_no"), "field").distinct())
    open_files = raw.join(wanted.select("file_no").distinct(), "file_no", "left_semi")  # before any record is read again
    sketch = cut(sketches(field_values(open_files).join(wanted, ["file_no", "field"], "left_semi"))).withColumnRenamed("file_no", "src")
    side = lambda need: need.join(sketch, ["src", "field"]).select("file_no", "field", "b", "c")
    matched = cut(correspondences(flood(evidence(pairs, side(need_old), side(need_new)), prof)))
    renamed = matched.join(gone.select("file_no", F.col("field").alias("old_name"), "old_kind"),
        ["file_no", "old_name"]).join(come.select("file_no", F.col("field").alias("new_name"), "new_kind"), ["file_no", "new_name"])
    stay = both.filter("was and is").select("file_no", F.col("field").alias("new_name"), F.col("field").alias("old_name"), "old_kind", "new_kind")
    cols = ["file_no", "field_name", "old_name", "change_kind", "old_kind", "new_kind"]

    def rows(df: DataFrame, kind: str, name: str, old_name: Column) -> DataFrame:
        return df.select("file_no", F.col(name).alias("field_name"), old_name.alias("old_name"), F.lit(kind).alias("change_kind"),
            "old_kind", "new_kind").select(cols)

    none = F.lit(None).cast("string")
    taken_old, taken_new = matched.select("file_no", F.col("old_name").alias("field")), matched.select("file_no", F.col("new_name").alias("field"))
    kept = ["file_no", "new_name", "old_name", "old_kind", "new_kind"]
    retyped = renamed.select(kept).unionByName(stay.select(kept)).filter("old_kind <> new_kind")
    changes = (
        rows(renamed, "renamed", "new_name", F.col("old_name"))
        .unionByName(rows(retyped, "retyped", "new_name", F.col("old_name")))
        .unionByName(rows(come.join(taken_new, ["file_no", "field"], "left_anti"), "added", "field", none))
        .unionByName(rows(gone.join(taken_old, ["file_no", "field"], "left_anti"), "removed", "field", F.col("field")))
    )
    return changes.join(files.select("feed", "file_seq", "file_no"), "file_no")


def consistent_names(raw: DataFrame, changes: DataFrame) -> DataFrame:
    """feed, field, unified: each name that a feed ever used, and the first name of the chain of renames it belongs to.

    Chains are followed to their start by halving them, as long as anything moves.
    """
    step = changes.filter("change_kind = 'renamed'").groupBy("feed", F.col("field_name").alias("field")).agg(F.min_by("old_name", "file_seq").alias("up"))
    # a name that was first of its feed is a start even if a later rename leads back to it
    first = field_values(raw).groupBy("feed", "field").agg(F.min("file_seq").alias("since"))
    older = first.select("feed", F.col("field").alias("up"), F.col("since").alias("up_since"))
    links = cut(step.join(first, ["feed", "field"]).join(older, ["feed", "up"]).filter("up_since < since").select("feed", "field", "up"))
    while True:
        nxt = cut(links.join(links.select("feed", F.col("field").alias("up"), F.col("up").alias("top")), ["feed", "up"],
            "left").select("feed", "field", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        links = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            break
    return first.join(links, ["feed", "field"], "left").select("feed", "field", F.coalesce("up", "field").alias("unified"))


def _typed(v: Column) -> dict[str, Column]:
    """A value as text, number, truth and list; null where it doesn't read as one."""
    nested = F.schema_of_variant(v).startswith("ARRAY") | F.schema_of_variant(v).startswith("OBJECT")
    text = F.coalesce(F.when(nested, F.to_json(v)), F.try_variant_get(v, "$", "string"))
    truth = F.lower(F.trim(text))
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    as_text = F.transform(items, lambda x: F.coalesce(F.when(F.schema_of_variant(x).startswith("ARRAY")
        | F.schema_of_variant(x).startswith("OBJECT"), F.to_json(x)), F.try_variant_get(x, "$", "string")))
    return {"text": text, "number": F.when(~nested, F.expr("try_cast(_text as double)")),
        "truth": F.when(truth.isin("true", "false"), truth == "true"), "list": as_text}


def unified_values(raw: DataFrame, changes: DataFrame) -> DataFrame:
    """feed, file_no, line_no, unified, kind, value (variant) of every non-null value, under the first name of its field."""
    names = consistent_names(raw, changes)
    v = raw.select("feed", "file_no", "line_no", F.try_parse_json("record").alias("v")).filter(F.col("v").isNotNull())
    values = v.select("feed", "file_no", "line_no", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("field", "value"))
    return values.join(names, ["feed", "field"]).select("feed", "file_no", "line_no", "unified", value_kind(F.col("value")).alias("kind"),
        "value").filter("kind is not null")


def agreed_types(values: DataFrame) -> DataFrame:
    """feed, unified, agreed (number, boolean, list or string), values, casts (values that were of another kind): per field of a feed the
    narrowest kind that every value reads as, so that no cast fails; a list where any value is one."""
    t = _typed(F.col("value"))
    read = values.withColumn("_text", t["text"])
    n = lambda c: F.count_if(c)
    per = read.groupBy("feed", "unified").agg(
        F.count("*").alias("values"), n(t["number"].isNotNull() & (F.col("kind") != "boolean")).alias("as_number"),
        n(t["truth"].isNotNull()).alias("as_truth"), n(F.col("kind").startswith("list")).alias("lists"),
        *[n(F.col("kind") == k).alias(f"_{i}") for i, k in enumerate(KINDS)],
    )
    agreed = F.when(F.col("lists") > 0, "list").when(F.col("as_number") == F.col("values"),
        "number").when(F.col("as_truth") == F.col("values"), "boolean").otherwise("string")
    same = F.when(F.col("agreed") == "list", F.col("lists")).when(F.col("agreed") == "number",
        F.col("_1")).when(F.col("agreed") == "boolean", F.col("_2")).otherwise(F.col("_0"))
    return per.withColumn("agreed", agreed).select("feed", "unified", "agreed", "values", (F.col("values") - same).alias("casts"))


def unified_table(raw: DataFrame, changes: DataFrame) -> DataFrame:
    """One consistent table in long form, typed: feed, file_no, line_no, unified, agreed, value_text, value_number, value_boolean, value_list.

    Every non-null value comes under the first name of its field, cast to the kind its field agrees on over all files of the feed
    (``agreed_types``): the column of that kind holds it, and value_text always its text (JSON for lists and objects). A lone value of a
    field that agrees on lists is a list of one. ``wide`` puts chosen fields side by side."""
    values = unified_values(raw, changes)
    types = agreed_types(values).select("feed", "unified", "agreed")
    t = _typed(F.col("value"))
    read = values.withColumn("_text", t["text"]).join(types, ["feed", "unified"])
    as_ = lambda k, c: F.when(F.col("agreed") == k, c)
    text = F.when(F.col("agreed") == "boolean", F.lower(F.trim("_text"))).otherwise(F.col("_text"))
    return read.select("feed", "file_no", "line_no", "unified", "agreed", text.alias("value_text"),
        as_("number", t["number"]).alias("value_number"), as_("boolean", t["truth"]).alias("value_boolean"), as_("list", t["list"]).alias("value_list"))


def wide(table: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row per feed, file and line of ``unified_table`` with a column per field of {unified name: text, number, boolean or list}; of values that
    a line has under two names of one field the least text counts."""
    of = {"text": "value_text", "number": "value_number", "boolean": "value_boolean", "list": "value_list"}
    picks = [F.min_by(of[k], F.when(F.col("unified") == f, F.col("value_text"))).alias(f) for f, k in fields.items()]
    return table.groupBy("feed", "file_no", "line_no").agg(*picks)
