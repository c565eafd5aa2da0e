"""Deeply nested records as related flat tables.

``child_tables`` infers a merged schema of a JSON column and explodes each array level into a table of its own that keeps the parent's
key and the ordinals of all levels above. ``explode_parallel`` does the same for parallel list columns of a typed table. Everything
runs as Spark expressions over variants and arrays; no Python touches a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How often a record may be wrapped: JSON in a JSON string, or an object whose only member holds the record.
WRAPPINGS = 4


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def unwrapped(json: Column, members: tuple[str, ...] = ()) -> Column:
    """A JSON text as a variant, however it is wrapped or encoded: byte order marks, JSON strings that hold JSON, objects with one member
    that holds an object, lists of one record. Null for null and unreadable text. A lone member that is one of ``members``, the known
    fields of a record, is no wrapper."""
    # a one-element array carries the value through the steps, so that each step is written, and evaluated, once
    held = F.array(F.try_parse_json(F.regexp_replace(json, "^[\ufeff\\s]+", "")))
    for _ in range(WRAPPINGS):
        held = F.transform(F.transform(held, lambda v: F.struct(v.alias("v"), _kind(v).alias("kind"))), lambda s: _unwrap_once(s, members))
    return F.try_element_at(held, F.lit(1))


def _unwrap_once(s: Column, known: tuple[str, ...]) -> Column:
    v, kind = s["v"], s["kind"]
    lone = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: x.isNotNull())
    # a lone member is a wrapper only if it holds an object or text that may be one
    inner = F.try_element_at(F.filter(lone, lambda x: _kind(x).startswith("OBJECT") | (_kind(x) == "STRING")), F.lit(1))
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    wrapper = F.size(names) == 1
    if known:
        wrapper = wrapper & ~F.try_element_at(names, F.lit(1)).isin(*known)
    return (
        F.when(kind == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string")))
        .when(kind.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant"))
        .when(kind.startswith("OBJECT") & wrapper, F.coalesce(inner, v))
        .otherwise(v)
    )


def as_items(v: Column) -> Column:
    """The items of a list; a lone object or scalar is a list of one; null and JSON null have none."""
    held = F.transform(F.array(v), lambda x: F.struct(x.alias("v"), _kind(x).alias("kind")))
    none = F.array().cast("array<variant>")

    def items(s: Column) -> Column:
        return F.when(s["v"].isNull() | (s["kind"] == "VOID"), none).when(s["kind"].startswith("ARRAY"),
            F.try_variant_get(s["v"], "$", "array<variant>")).otherwise(F.array(s["v"]))

    return F.flatten(F.transform(held, items))


def split_type(inner: str) -> list[tuple[str, str]]:
    """The members of an OBJECT<a: T, b: U> type string."""
    out, depth, start, quoted = [], 0, 0, False
    parts = []
    for i, c in enumerate(inner):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c == "<") - (c == ">")
            if c == "," and depth == 0:
                parts.append(inner[start:i])
                start = i + 1
    parts.append(inner[start:])
    for p in parts:
        m = re.match(r"\s*(`(?:[^`]|``)*`|[^:]+):\s*(.*)$", p, re.S)
        if m:
            out.append((m[1].strip().strip("`").replace("``", "`"), m[2].strip()))
    return out


def _path(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _members(kind: str) -> list[tuple[str, str]]:
    m = re.match(r"OBJECT<(.*)>$", kind, re.S)
    return split_type(m[1]) if m else []


def child_tables(df: DataFrame, key: str, json: str, depth: int = 8, lists: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """{path: table} for the record itself (path "") and each list found in it, at any depth.

    Paths in ``lists`` are lists even where no record has more than a lone object there.

    A table has ``key``, one ordinal per list level (``no_1``, ``no_2``, ...; from 1, empty places included), every scalar of its object
    as a string column named by its path, and ``item``, the variant. A path that is a list in one record and a lone object in another
    is a list. Levels beyond ``depth`` stay in ``item``.

    One aggregate job per list level infers that level's merged schema; levels whose type is the same in all records are read off the
    level above without a job.
    """
    out: dict[str, DataFrame] = {}

    def infer(level: DataFrame) -> str:
        return level.agg(F.schema_of_variant_agg("item").alias("s")).first()["s"] or "VOID"

    def walk(path: str, level: DataFrame, kind: str, ordinals: list[str], left: int) -> None:
        scalars: dict[str, Column] = {}
        inner: list[tuple[str, str, str]] = []

        def fields(prefix: str, at: str, kind: str) -> None:
            for name, t in _members(kind):
                label, place = f"{prefix}{name}", at + _path(name)
                if f"{path}.{label}".strip(".") in lists:
                    inner.append((label, place, t if t.startswith("ARRAY") else "VARIANT"))
                elif t.startswith("OBJECT"):
                    fields(f"{label}_", place, t)
                elif t.startswith("ARRAY") or t == "VARIANT":
                    inner.append((label, place, t))
                else:
                    scalars[label] = F.try_variant_get("item", place, "string")

        fields("", "$", kind)
        taken = {c.lower() for c in (key, *ordinals, "item")}
        named = {(f"{n}_field" if n.lower() in taken else n): c for n, c in scalars.items()}
        out[path] = level.select(key, *ordinals, *[c.alias(n) for n, c in named.items()], "item")
        if left == 0:
            return
        for label, place, t in inner:
            child = f"{path}.{label}" if path else label
            no = f"no_{len(ordinals) + 1}"
            items = level.select(key, *ordinals, F.posexplode(as_items(F.try_variant_get("item", place, "variant"))).alias("_pos",
                "item")).select(key, *ordinals, (F.col("_pos") + 1).cast("long").alias(no), "item")
            known = re.match(r"ARRAY<(.*)>$", t, re.S)
            walk(child, items, known[1] if known and "VARIANT" not in t else infer(items), [*ordinals, no], left - 1)

    # the fields of a record are those of objects with several members; the driver makes columns of them anyway
    several = df.select(F.json_object_keys(json).alias("n")).filter(F.size("n") > 1).select(F.explode("n").alias("n")).distinct()
    names = tuple(sorted(r["n"] for r in several.collect()))
    top = df.select(key, unwrapped(F.col(json), names).alias("item")).filter(F.col("item").isNotNull() & _kind(F.col("item")).startswith("OBJECT"))
    walk("", top, infer(top), [], depth)
    return out


def content(c: Column) -> Column:
    """Text that says something: not null, blank or the word None."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.coalesce((bare != "") & (bare != "none"), F.lit(False))


def explode_parallel(df: DataFrame, key: str, lists: dict[str, str], levels: int) -> DataFrame:
    """Parallel list columns {column: name}, nested ``levels`` deep, as one row per place: key, no_1..no_levels and the names.

    Values belong together by position. A null or shorter list leaves nulls in its places; a place that no list has makes no row.
    """
    names = list(lists.values())
    out = df.select(key, *[F.col(c).alias(n) for c, n in lists.items()])
    ordinals: list[str] = []
    for level in range(1, levels + 1):
        filled = [F.coalesce(F.col(n), F.array()).alias(n) for n in names]
        out = out.select(key, *ordinals, F.posexplode(F.arrays_zip(*filled)).alias("_pos", "_item"))
        ordinals.append(f"no_{level}")
        out = out.select(key, *ordinals[:-1], (F.col("_pos") + 1).cast("long").alias(ordinals[-1]), *[F.col(f"_item.{n}").alias(n) for n in names])
    return out


def work_children(papers: DataFrame, works: DataFrame) -> DataFrame:
    """tab_name, record_id, child_kind, author_no, child_no, child_name, child_id: affiliations and topics of both tables that have content."""
    none = F.lit(None).cast("string")

    def rows(tab: str, kind: str, df: DataFrame, author: Column, child: Column, name: Column, id_: Column) -> DataFrame:
        kept = df.filter(content(name) | content(id_))
        return kept.select(F.lit(tab).alias("tab_name"), "record_id", F.lit(kind).alias("child_kind"),
            author.cast("long").alias("author_no"), child.cast("long").alias("child_no"), name.alias("child_name"), id_.alias("child_id"))

    typed = papers.filter(F.col("record_id").isNotNull())
    affs = explode_parallel(typed, "record_id", {"author_affiliations": "name", "author_affiliation_ids": "id"}, 2)
    tops = explode_parallel(typed, "record_id", {"topic_names": "name", "topic_ids": "id"}, 1)
    out = rows("ai_papers", "affiliation", affs, F.col("no_1"), F.col("no_2"), F.col("name"), F.col("id")).unionByName(
        rows("ai_papers", "topic", tops, F.lit(0), F.col("no_1"), F.col("name"), F.col("id"))
    )
    tables = child_tables(works.filter(F.col("record_id").isNotNull()), "record_id", "work_json", lists=("authorships", "authorships.institutions", "topics"))
    for path, kind, author, child in (("authorships.institutions", "affiliation", F.col("no_1"), F.col("no_2")), ("topics", "topic", F.lit(0), F.col("no_1"))):
        if path in tables:
            df, item = tables[path], F.col("item")
            is_object = _kind(item).startswith("OBJECT")
            name = F.when(is_object, F.try_variant_get(item, "$.display_name", "string")).when(~_kind(item).startswith("ARRAY"),
                F.try_variant_get(item, "$", "string"))
            id_ = F.when(is_object, F.try_variant_get(item, "$.id", "string")).otherwise(none)
            out = out.unionByName(rows("openalex_work_json", kind, df, author, child, name, id_))
    return out
