import os

import pytest
from conftest import DATA

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(q for q in entry.oracle_sql() if q in ("yoy_growth", "concentration_gini", "affiliation_type",
    "parent_cascade", "token_blocked_pairs", "jw_similarity_block", "column_profile", "gap_detection_weekly", "keep_best_dedup")))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    cell = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)[:10] if hasattr(x, "isoformat") else x
    want = sorted((tuple(cell(v) for v in row) for row in r.fetchall()), key=str)
    got = sorted((tuple(cell(row[c]) for c in cols) for row in df.collect()), key=str)
    assert got == want
