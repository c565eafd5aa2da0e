"""Queries for schema drift and nested records: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orgweave.operators import drift, nested
from orgweave.shared import read


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read(spark, d, "raw_work_files")).select("file_no", "field_name", "change_kind")


def p4_unified_table(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "raw_work_files")
    return drift.unified_table(raw, drift.schema_changes(raw))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.work_children(read(spark, d, "ai_papers"), read(spark, d, "openalex_work_json"))
    return rows.select("tab_name", "record_id", "child_kind", "author_no", "child_no")


def p5_child_tables(spark: SparkSession, d: str) -> DataFrame:
    """The children with their names and ids."""
    return nested.work_children(read(spark, d, "ai_papers"), read(spark, d, "openalex_work_json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_unified_table": p4_unified_table, "p5_found": p5_found, "p5_child_tables": p5_child_tables}


def _says(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'none'))"


def _step(n: int) -> str:
    """One layer of wrapping off: text that holds JSON, a lone member that holds an object, a list of one."""
    return f"""s{n} AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]')
 WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND json_type(json_extract(j, '$.' || json_keys(j)[1])) IN ('OBJECT', 'VARCHAR') THEN json_extract(j, '$.' || json_keys(j)[1]) ELSE j END AS j FROM s{n - 1})"""


def _items(c: str) -> str:
    return f"CASE json_type({c}) WHEN 'ARRAY' THEN json_extract({c}, '$[*]') WHEN 'OBJECT' THEN [{c}] ELSE [] END"


def _children_sql(more: str = "") -> str:
    """SQL of the children; ``more`` names further columns of them."""
    both = lambda a, b: f"unnest(generate_series(1, greatest(coalesce(len({a}), 0), coalesce(len({b}), 0))))"
    item = lambda c, no: f"{no}, {c}->>'display_name' AS n, {c}->>'id' AS d"
    return f"""WITH p AS (SELECT record_id, author_affiliations AS a, author_affiliation_ids AS b, topic_names AS t, topic_ids AS u FROM ai_papers),
 p1 AS (SELECT record_id, i AS author_no, a[i] AS x, b[i] AS y FROM (SELECT *, {both('a', 'b')} AS i FROM p)), p2 AS (SELECT record_id, author_no, k AS child_no, x[k] AS n, y[k] AS d FROM (SELECT *, {both('x', 'y')} AS k FROM p1)),
 p3 AS (SELECT record_id, i AS child_no, t[i] AS n, u[i] AS d FROM (SELECT *, {both('t', 'u')} AS i FROM p)),
 s0 AS (SELECT record_id, CASE WHEN json_valid(work_json) THEN CAST(work_json AS JSON) END AS j FROM openalex_work_json), {', '.join(_step(i) for i in range(1, 5))},
 w AS (SELECT record_id, {_items("j->'authorships'")} AS au, {_items("j->'topics'")} AS tp FROM s4 WHERE json_type(j) = 'OBJECT'),
 w1 AS (SELECT record_id, i AS author_no, au[i] AS v FROM (SELECT *, unnest(generate_series(1, len(au))) AS i FROM w)),
 w2 AS (SELECT record_id, author_no, {item('ins[k]', 'k AS child_no')} FROM (SELECT *, unnest(generate_series(1, len(ins))) AS k FROM (SELECT record_id, author_no, {_items("v->'institutions'")} AS ins FROM w1))),
 w3 AS (SELECT record_id, {item('tp[i]', 'i AS child_no')} FROM (SELECT *, unnest(generate_series(1, len(tp))) AS i FROM w))
 SELECT 'ai_papers' AS tab_name, record_id, 'affiliation' AS child_kind, author_no, child_no{more} FROM p2 WHERE {_says('n')} OR {_says('d')}
 UNION ALL SELECT 'ai_papers', record_id, 'topic', 0, child_no{more} FROM p3 WHERE {_says('n')} OR {_says('d')}
 UNION ALL SELECT 'openalex_work_json', record_id, 'affiliation', author_no, child_no{more} FROM w2 WHERE {_says('n')} OR {_says('d')}
 UNION ALL SELECT 'openalex_work_json', record_id, 'topic', 0, child_no{more} FROM w3 WHERE {_says('n')} OR {_says('d')}"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _children_sql(), "p5_child_tables": _children_sql(", n AS child_name, d AS child_id")}
