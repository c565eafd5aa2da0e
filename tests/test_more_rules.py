"""Rules that SQL can't state, or that the tables don't show, by stated expectations."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orgweave.functions import classify, identifiers, records, text
from orgweave.operators import linking, linking_more, metrics, panel
from orgweave.operators.prefix import running
from orgweave.sources import readers, sinks


def test_names_of_all_scripts(spark):
    names = ["Société Générale SA", "Nestlé S.A.", "Müller Optik GmbH", "Газпром Inc.", "東京電力 Ltd", "Straße_1 Co.", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(text.clean_organization_name(F.col("n")), text.normalize_wikipedia(F.col("n"))).collect()]
    assert [g[0] for g in got] == ["SOCIÉTÉ GÉNÉRALE", "NESTLÉ", "MÜLLER OPTIK", "ГАЗПРОМ", "東京電力", "STRASSE_1", None, None]
    assert [g[1] for g in got][:4] == ["société générale sa", "nestlé s a", "müller optik", "газпром"]


def test_reasons_of_assessments(spark):
    data = [
        ("Acme", "ACME", "x", "Exact name match"), ("Acme Widgets Europe", "ACME WIDGETS", "x", "Firm name in institution (subsidiary)"),
        ("AI Corporation", "AFFYMAX INC", "other", "Known name collision"),
        ("System Dynamics Lab", "STANDARD DIVERSIFIED CO", "other", "Generic pattern mismatch"),
        ("Zed", "YACHT", "ticker_acronym", "Short ambiguous ticker"), (None, "X", "other", "Requires manual verification"),
    ]
    df = spark.createDataFrame(data, "i string, f string, m string, want string").select("want",
        classify.match_assessment(F.col("i"), F.col("f"), F.col("m")).alias("a"))
    assert all(r["want"] == r["a"]["reason"] for r in df.collect())


def test_lineage_and_labels(spark):
    df = spark.createDataFrame([("Brain Lab", ["Acme Research", None]), ("acme research paris", None), ("Zed", []), (None, None)], "n string, l array<string>")
    assert [r[0] for r in df.select(classify.big_tech_lineage(F.col("n"), F.col("l"), {"ACME": ("acme research",)})).collect()] == ["ACME", "ACME", None, None]
    p = spark.createDataFrame([("a gpu for training", ["G06N1"]), ("a spoon", ["G06N1"]), ("a spoon", None)], "t string, c array<string>")
    assert [tuple(r) for r in p.select(*[classify.strategic_label(F.col("t"), F.col("c"), h) for h in ("text", "cpc", "hybrid")])
        .collect()] == [("Infrastructure", "Algorithm", "Infrastructure"), ("Unknown", "Algorithm", "Unknown"), ("Unknown", "Unknown", "Unknown")]


def test_knowledge_base_records(spark):
    claim = lambda v, q=None: {"mainsnak": {"datavalue": {"value": v}}, **({"qualifiers": {"P249": [{"datavalue": {"value": q}}]}} if q else {})}
    e = {"claims": {"P414": [claim({"id": "Q1"}, "ABC")], "P249": [claim("XYZ")], "P127": [claim({"id": "Q5"})],
        "P1448": [claim({"text": "Acme"})], "P742": claim("Ac")}}
    df = spark.createDataFrame([(json.dumps(e),), ("{}",), ("{bad",), (None,)], "j string").select(records.wikidata_claims(F.try_parse_json("j")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert (got[0]["tickers"], got[0]["parents"], got[0]["names"]) == (["ABC", "XYZ"], ["Q5"], ["Acme", "Ac"])
    assert (got[1]["tickers"], got[3]["names"]) == ([], [])
    b = spark.createDataFrame([('{"results": {"bindings": [{"a": {"value": "1"}}, {"b": {"value": "2"}}]}}',), ("x",)], "j string")
    assert rows(records.sparql_bindings(b, "j", ["a", "b"])) == [("1", None), (None, "2")]
    r = spark.createDataFrame([([("I1", "Parent"), ("I2", "child"), ("I3", None)],), (None,)], "x array<struct<id:string,relationship:string>>")
    assert [x[0] for x in r.select(records.related(F.col("x"), "parent")).collect()] == [["I1"], None]
    v = spark.createDataFrame([('{"l": [{"n": "a"}, {"n": "b"}, {"n": "c"}]}',), ('{"l": {"n": "z"}}',), ("{}",)],
        "j string").select(F.try_parse_json("j").alias("v"))
    assert [tuple(x) for x in v.select(*records.list_fields(F.col("v"), "l", ["n"], 2)).collect()] == [("a", "b", 3), ("z", None, 1), (None, None, 0)]


def test_flattening_loses_no_depth(spark):
    deep = "1"
    for _ in range(5):
        deep = '{"a": %s}' % deep
    df = spark.createDataFrame([(1, '{"x": 1, "y": %s}' % deep)], "id int, j string")
    got = {(r["path"], r["value"]) for r in records.flatten_paths(df, "id", "j", levels=3).collect()}
    assert got == {("x", "1"), ("y_a_a", '{"a":{"a":{"a":1}}}')}


def test_identifiers(spark):
    df = spark.createDataFrame([("NYSE: ABC and (XYZ) NASDAQ: QQQ",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(identifiers.exchange_tickers(F.col("t"))).collect()] == [["ABC", "QQQ", "XYZ"], [], None]
    u = spark.createDataFrame([("http://arxiv.example/abs/2104.11612v2",), (None,)], "u string")
    assert [r[0] for r in u.select(identifiers.arxiv_id_from_url(F.col("u"))).collect()] == ["2104.11612", None]
    d = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024",), ("",), (None,)], "d string")
    assert [tuple(r) for r in d.select(identifiers.day_of_year(F.col("d")), identifiers.month_of(F.col("d"))).collect()] == [(60,
        "2024-02")] + [(None, None)] * 4
    a = spark.createDataFrame([("A. B; C. D; ",), ("A and B & C",), ("A, B, C",), ("A",), ("",), (None,)], "a string")
    assert [r[0] for r in a.select(text.author_count(F.col("a"))).collect()] == [2, 3, 3, 1, 0, 0]


def test_country_blocks_and_parents(spark):
    i = spark.createDataFrame([("a", "ACME ROTORS", [], "US", None), ("b", "ACME ROTRS", None, "USA", "Paris"),
        ("c", "ACME ROTRS", None, "DE", None), ("d", "ACME ROTORS", None, None, None), ("e", None, None, "US", None)],
        "entity_id string, name string, variants array<string>, country string, city string")
    f = spark.createDataFrame([("f1", "ACME ROTORS", None, "USA", "Paris", "rotors by acme"), ("f2", "BOLTS", None, None, None, None)],
        "gvkey string, conm_clean string, conml_clean string, fic string, city string, busdesc string")
    got = {r["entity_id"]: (r["gvkey"], r["match_method"]) for r in linking_more.country_links(i, f).collect()}
    assert got == {"a": ("f1", "string_match"), "b": ("f1", "fuzzy_jaro_winkler")}
    p = spark.createDataFrame([("kid", ["x"], []), ("x", [], []), ("kid2", ["y"], []), ("y", [], ["kid2"])],
        "entity_id string, parents array<string>, children array<string>")
    m = spark.createDataFrame([("x", "1", "exact", 0.98), ("y", "2", "exact", 0.98)],
        "entity_id string, gvkey string, match_method string, match_confidence double")
    assert rows(linking.parent_cascade(p, m)) == [("kid2", "2", "parent_cascade_exact", 0.96)]


def test_older_matcher_knows_ciks(spark):
    e = spark.createDataFrame([("1", "Some plant, CIK: 0000012345"), ("2", "Zzzz qqqq")], "entity_id string, name string")
    f = spark.createDataFrame([("f1", "AAA", "Bolts and nuts", "12345"), ("f2", "BBB", "Cooking", None)], "gvkey string, tic string, conm string, cik string")
    assert rows(linking_more.legacy(e, f)) == [("1", "f1", "cik", 0.9)]


def test_manual_rules(spark):
    e = spark.createDataFrame([("1", "an ai lab"), ("2", "acme works"), ("3", "done")], "entity_id string, name string")
    f = spark.createDataFrame([("f1", "AA"), ("f2", "AA"), ("f3", "BB")], "gvkey string, tic string")
    rules = spark.createDataFrame([(1, "ai", "AA"), (2, "acme", "BB"), (3, "done", "BB"), (4, "", "BB")], "rule_no int, pattern string, tic string")
    got = linking.manual_matches(e, f, rules, contained=True, matched=spark.createDataFrame([("3",)], "entity_id string"))
    assert rows(got.select("entity_id", "gvkey")) == [("1", "f2"), ("2", "f3")]  # two letters count, a ticker is the firm of greatest gvkey


def test_pieces_of_names_are_not_broadcast(spark, monkeypatch):
    from conftest import DATA

    from orgweave.queries_links import manual_contained_links

    monkeypatch.setattr(linking, "cut", lambda df: df)  # all of it in one plan
    plan = manual_contained_links(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan and "Broadcast" not in plan


def test_aggressive_filter_knows_its_firms_and_labels(spark):
    m = spark.createDataFrame([("019075", "exact_conm", "Acme Widgets", "ACME WIDGETS", 0.98),
        ("1", "firm_contained_conm", "Acme Widgets", "ACME WIDGETS", 0.98), ("2", "exact_conm", "Acme Widgets", "ACME WIDGETS", 0.98)],
        "gvkey string, match_method string, institution_name string, firm_name string, match_confidence double")
    kept, counts = linking.funnel(m, linking.aggressive_steps())
    assert [r["gvkey"] for r in kept.collect()] == ["2"] and {r["step"]: r["removed"] for r in counts
        .collect() if r["removed"]} == {"blocked firm": 1, "blocked method": 1}


def test_running_sums_and_quantiles_against_brute_force(spark):
    import random

    random.seed(4)
    data = [(random.choice("ab"), random.randint(0, 9), i) for i in range(300)] + [(None, 5, 300), ("a", None, 301)]
    df = spark.createDataFrame(data, "g string, x int, id long")
    got = {r["id"]: r["s"] for r in running(df.filter("x is not null"), [F.asc("x"), F.asc("id")], s=F.col("x")).collect()}
    run = 0
    for _, x, i in sorted((d for d in data if d[1] is not None), key=lambda d: (d[1], d[2])):
        assert got[i] == run
        run += x
    for nearest in (False, True):
        for r in metrics.quantiles(df, ["g"], "x", [0.25, 0.5], nearest).collect():
            v = sorted(x for g, x, _ in data if g == r["g"] and x is not None)
            for q in (0.25, 0.5):
                at = (len(v) - 1) * q
                want = v[round(at)] if nearest else v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
                assert abs(r[f"q{round(q * 100)}"] - want) < 1e-9
    assert metrics.quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_intervals_with_gaps_and_overlaps(spark):
    df = spark.createDataFrame([(1.0,), (0.9995,), (0.95,), (0.93,), (None,)], "c double")
    got = {r["label"]: r["n"] for r in metrics.interval_counts(df, "c", [(1.0, 1.0, "one"), (0.95, 0.999, "high"), (0.9, 1.0, "wide")]).collect()}
    assert got == {"one": 1, "high": 1, "wide": 3}


def test_latex_refuses_what_it_would_cut(spark):
    assert sinks.latex_table(spark.range(3), "c", most=3).count(r"\\") == 4
    with pytest.raises(ValueError):
        sinks.latex_table(spark.range(4), "c", most=3)


def test_readers_of_schemas_and_catalogs(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert ("three", "id", "bigint") in {tuple(r) for r in readers.catalog(spark).collect()}
    assert rows(readers.shape({"three": spark.table("three")})) == [("three", 1, 3)]
    assert readers.without(spark.table("three").withColumn("x", F.lit(1)), "x",
        "absent").columns == ["id"] and readers.optional(spark.table("three"),
        ["id", "no"]).columns == ["id"] and readers.head(spark.table("three"), 2).count() == 2
    assert panel.entity_span(spark.createDataFrame([("a", 1), ("a", 3)], "k string, y int"), "k", "y").first()[1:] == (1, 3)
