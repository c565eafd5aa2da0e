"""JSON and page records of works, institutions and firms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.operators.nested import as_items, unwrapped
from orgweave.shared import cut

#: Limits of the flattened form (fixed values): items of a list that get columns of their own, and levels.
MOST_ITEMS, MOST_LEVELS = 100, 20


def flatten_paths(df: DataFrame, key: str, json: str, sep: str = "_", levels: int = MOST_LEVELS, most: int = MOST_ITEMS) -> DataFrame:
    """Key, path, value (text), one row per scalar of each record; members of lists of objects are numbered from 0, the first
    ``most`` of them, and the number of the rest comes under path + ``remaining_count``; lists of scalars are joined with "; ".
    Unreadable records give one row with the path ``flatten_error``. No path is lost, whenever it first occurs: what lies deeper than
    ``levels`` comes as JSON text under the path of its last level.
    """
    top = df.select(key, unwrapped(F.col(json)).alias("v"), F.col(json).alias("_text"))
    bad = top.filter(F.col("v").isNull()).select(key, F.lit("flatten_error").alias("path"), F.left("_text", F.lit(200)).alias("value"))
    level = top.filter(F.col("v").isNotNull()).select(key, F.lit("").alias("path"), "v")
    out = [bad]
    for _ in range(levels):
        kind = F.schema_of_variant("v")
        level = level.withColumn("kind", kind)
        is_list_of_objects = F.col("kind").startswith("ARRAY<OBJECT")
        scalars = level.filter(~F.col("kind").startswith("OBJECT") & ~is_list_of_objects & (F.col("kind") != "VOID"))
        text = F.when(F.col("kind").startswith("ARRAY"), F.coalesce(F.array_join(F.try_variant_get("v", "$", "array<string>"), "; "),
            F.to_json("v"))).otherwise(F.try_variant_get("v", "$", "string"))
        out.append(scalars.select(key, "path", text.alias("value")))
        join = lambda name: F.when(F.col("path") == "", name).otherwise(F.concat_ws(sep, "path", name))
        objects = level.filter(F.col("kind").startswith("OBJECT")).select(key, "path",
            F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v")).select(key, join(F.col("name")).alias("path"), "v")
        lists = level.filter(is_list_of_objects).select(key, "path", F.try_variant_get("v", "$", "array<variant>").alias("items"))
        items = lists.select(key, "path", F.posexplode(F.slice("items", 1, most)).alias("no", "v")).select(key,
            F.concat_ws(sep, "path", F.col("no").cast("string")).alias("path"), "v")
        out.append(lists.filter(F.size("items") > most).select(key, F.concat_ws(sep, "path", F.lit("remaining_count")).alias("path"),
            (F.size("items") - most).cast("string").alias("value")))
        level = objects.unionByName(items)
        level = cut(level)
        if level.isEmpty():
            break
    else:
        out.append(level.filter(F.schema_of_variant("v") != "VOID").select(key, "path", F.to_json("v").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), out)


def list_fields(v: Column, field: str, names: list[str], most: int) -> list[Column]:
    """Columns field_i_name for the first items of a list of objects, and field_count."""
    items = as_items(F.try_variant_get(v, f"$.{field}", "variant"))
    cols = [F.try_variant_get(F.get(items, F.lit(i)), f"$.{n}", "string").alias(f"{field}_{i}_{n}") for i in range(most) for n in names]
    return [*cols, F.size(items).alias(f"{field}_count")]


def json_structure(df: DataFrame, json: str) -> DataFrame:
    """The merged type of all records."""
    return df.agg(F.schema_of_variant_agg(unwrapped(F.col(json))).alias("structure"))


def authorship_rows(df: DataFrame, json: str, company_words: tuple[str, ...] = ("inc", "corp", "ltd", "llc", "gmbh", "research")) -> DataFrame:
    """A row per work, author and institution, one for an author without any, and one per raw affiliation that looks like a company."""
    v = unwrapped(F.col(json))
    w = df.select(v.alias("v")).filter("v is not null").select(F.try_variant_get("v", "$.id", "string").alias("openalex_id"),
        F.try_variant_get("v", "$.publication_year", "int").alias("publication_year"),
        F.explode(as_items(F.try_variant_get("v", "$.authorships", "variant"))).alias("a"))
    a = w.select(
        "openalex_id", "publication_year", F.try_variant_get("a", "$.author.id", "string").alias("author_id"),
        F.try_variant_get("a", "$.author_position", "string").alias("author_position"),
        F.try_variant_get("a", "$.is_corresponding", "boolean").alias("is_corresponding"),
        as_items(F.try_variant_get("a", "$.institutions", "variant")).alias("institutions"),
        F.try_variant_get("a", "$.raw_affiliation_strings", "array<string>").alias("raw"),
    )
    keys = ["openalex_id", "publication_year", "author_id", "author_position", "is_corresponding"]
    i = a.select(*keys, F.explode_outer("institutions").alias("i"))
    rows = i.select(*keys, *[F.try_variant_get("i", f"$.{p}", "string").alias(n) for p,
        n in (("id", "institution_id"), ("display_name", "institution_name"), ("type", "institution_type"),
        ("country_code", "country_code"))], F.coalesce(F.schema_of_variant("i") != "VOID", F.lit(False)).alias("has_institution"),
        F.lit("institutions").alias("source"))
    raw = a.select(*keys, F.explode("raw").alias("institution_name"))
    looks = reduce(lambda x, y: x | y, [F.lower("institution_name").contains(k) for k in company_words])
    none = F.lit(None).cast("string")
    extra = raw.filter(looks).select(*keys, none.alias("institution_id"), "institution_name", F.lit("company").alias("institution_type"),
        none.alias("country_code"), F.lit(True).alias("has_institution"), F.lit("raw_affiliation").alias("source"))
    return rows.unionByName(extra)


def related(items: Column, relation: str) -> Column:
    """Ids of the related institutions (array of struct of id and relationship) of one kind."""
    return F.transform(F.filter(items, lambda x: F.lower(x["relationship"]) == relation), lambda x: x["id"])


def wikidata_claims(v: Column) -> Column:
    """Struct of tickers (P414 with P249), parents (P127, P749) and names (P1448, P742) of an entity record."""

    def values(prop: str, path: str) -> Column:
        return F.filter(F.transform(as_items(F.try_variant_get(v, f"$.claims.{prop}", "variant")),
            lambda c: F.try_variant_get(c, path, "string")), lambda x: x.isNotNull())

    main = "$.mainsnak.datavalue.value"
    return F.struct(
        F.array_union(values("P414", "$.qualifiers.P249[0].datavalue.value"), values("P249", main)).alias("tickers"),
        F.array_union(values("P127", f"{main}.id"), values("P749", f"{main}.id")).alias("parents"),
        F.array_union(values("P1448", f"{main}.text"), values("P742", main)).alias("names"),
    )


def sparql_bindings(df: DataFrame, json: str, names: list[str]) -> DataFrame:
    """One row per binding of a result, the value of each variable as text."""
    b = df.select(F.explode(as_items(F.try_variant_get(F.try_parse_json(json), "$.results.bindings", "variant"))).alias("b"))
    return b.select(*[F.try_variant_get("b", f"$.{n}.value", "string").alias(n) for n in names])


def infobox(html: Column) -> Column:
    """Struct of tickers, ISIN, type, industry, parent and former names of a page with an infobox, as wiki text or as a table."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"\s+", " ")

    def value(label: str) -> Column:
        row = F.regexp_extract(plain, rf"(?i)<th[^>]*>\s*(?:<[^>]+>)*\s*{label}\s*(?:<[^>]+>)*\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
        wiki = F.regexp_extract(plain, rf"(?i)\|\s*{label}\s*=\s*([^|\n]*?)\s*(?=\||\}}\}}|$)", 1)
        text = F.trim(F.regexp_replace(F.when(row != "", row).otherwise(wiki), r"<[^>]+>|\[\[|\]\]", " "))
        return F.nullif(F.regexp_replace(text, r"\s+", " "), F.lit(""))

    marks = F.array_distinct(F.regexp_extract_all(F.regexp_replace(plain, r"<[^>]+>", " "),
        F.lit(r"(?:NYSE|NASDAQ|Nasdaq|LSE|TSX|TYO)\s*[:|]\s*([A-Z0-9.]{1,6})\b"), 1))
    return F.struct(
        marks.alias("tickers"), F.nullif(F.regexp_extract(plain, r"\b([A-Z]{2}[A-Z0-9]{9}\d)\b", 1), F.lit("")).alias("isin"),
        value("(?:Company )?type").alias("company_type"),
        value("Industry").alias("industry"), value("(?:Parent|Owner)").alias("parent"), value("(?:Formerly|Former names?|Former_names?)").alias("former_names"),
    )


def parallel_walk(df: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """A2: parallel lists as rows with their place from 0; a shorter list gives nulls."""
    z = F.arrays_zip(*[F.coalesce(F.col(c), F.array()).alias(n) for c, n in lists.items()])
    return df.select(key, F.posexplode(z).alias("place", "_z")).select(key, "place", *[F.col(f"_z.{n}").alias(n) for n in lists.values()])


def ordered_union(*lists: Column) -> Column:
    """A4: items of all lists once, in their order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(x, none) for x in lists])), lambda x: x.isNotNull()))


def bounded(items: Column, most: int) -> Column:
    """The first items of a list."""
    return F.slice(items, 1, most)
