from conftest import rows
from pyspark.sql import functions as F

from orgweave.operators import linking_more as more
from orgweave.plans import pipelines


def _firms(spark):
    data = [("f1", "ACME ROTORS INC", "ACME ROTORS", None, "ACR", "USA", "Paris", "TX", "Acme makes rotors and turbine blades", "acme.com"),
        ("f2", "GLOBEX FOODS LTD", "GLOBEX FOODS", None, "GLX", "JPN", None, None, None, None)]
    df = spark.createDataFrame(data, "gvkey string, conm string, conm_clean string, conml_clean string, tic string, fic string, city string, state string, busdesc string, host string")
    return df.withColumn("variants", F.array("conm_clean")).withColumn("name_variants", F.array("conm_clean"))


def test_stage2_needs_checks(spark):
    i = spark.createDataFrame([
        ("a", "Acme Rotors Europe", ["ACME ROTRS"], "US", "Paris", None, None),
        ("b", "Globexx Foods", ["GLOBEXX FOODS"], "DE", None, None, None), ("c", None, None, None, None, None, None),
    ], "entity_id string, display_name string, variants array<string>, country string, city string, region string, host string")
    assert {(r["entity_id"], r["gvkey"]) for r in more.publications_stage2(i, _firms(spark)).collect()} == {("a", "f1")}


def test_stage2_compares_all_pairs(spark):
    # the common word is the only one shared by the first; glued words share none
    i = spark.createDataFrame([(str(n), "Acme Rotors Europe", [v], "US", "Paris", None, None) for n,
        v in enumerate(["ACME ROTORS ZUERICH GMBHCO", "ACMEROTORS", "ACM EROTORS", "BOLTS"])],
        "entity_id string, display_name string, variants array<string>, country string, city string, region string, host string")
    assert {r["entity_id"] for r in more.publications_stage2(i, _firms(spark)).collect()} == {"0", "1", "2"}


def test_enhanced_and_urls(spark):
    i = spark.createDataFrame([
        ("a", "ACME ROTORS", ["GLX"], "x.acme.com", "https://en.wikipedia.org/wiki/Globex_Foods", []),
        ("b", None, ["glx"], None, None, ["c"]), ("c", None, [], "acme.com", None, []), ("d", None, None, "lab.acme.com", None, None),
    ], "entity_id string, name string, acronyms array<string>, host string, wikipedia_url string, parents array<string>")
    got = {r["entity_id"]: (r["gvkey"], r["match_method"]) for r in more.stage1_enhanced(i, _firms(spark)).collect()}
    assert got == {"a": ("f1", "exact"), "b": ("f2", "acronym_ticker"), "c": ("f1", "domain")}
    got = {r["entity_id"]: (r["gvkey"], r["match_confidence"]) for r in more.smart_urls(i, _firms(spark)).collect()}
    assert got == {"a": ("f2", 0.98), "b": ("f1", 0.95), "c": ("f1", 0.98), "d": ("f1", 0.96)}


def test_wikipedia_and_wikidata(spark):
    p = spark.createDataFrame([("p", "Acme Rotors, Inc."), ("q", "Group"), ("r", None)], "entity_id string, title string")
    assert rows(more.wikipedia_names(p, _firms(spark))) == [("p", "f1", "wikipedia_improved", 0.98)]
    e = spark.createDataFrame([("e", ["acr"], ["Globex Foods"], [], None)],
        "entity_id string, tickers array<string>, names array<string>, parents array<string>, parent_tickers array<string>")
    assert {(r["gvkey"], r["match_method"]) for r in more.wikidata(e, _firms(spark)).collect()} == {("f1", "wikidata_ticker"), ("f2", "wikidata_name")}


def test_older_matchers(spark):
    e = spark.createDataFrame([("1", "Plant (ACR)", "acr", "TX"), ("2", "Globex Foods", None, None),
        ("3", "division of Globex Foods", None, None), ("4", "Acme Rotrs", None, None), ("5", None, None, None)],
        "entity_id string, name string, ticker string, state string")
    got = {r["entity_id"]: (r["gvkey"], r["match_method"]) for r in more.legacy(e, _firms(spark)).collect()}
    assert got == {"1": ("f1", "ticker"), "2": ("f2", "exact"), "3": ("f2", "subsidiary"), "4": ("f1", "fuzzy")}
    assert {(r["entity_id"], r["gvkey"]) for r in more.wratio_stage2(e, _firms(spark)).collect()} >= {("2", "f2"), ("4", "f1")}
    assert {(r["entity_id"], r["gvkey"], r["match_confidence"]) for r in more.enrichment(e, _firms(spark)).collect()} >= {("1", "f1", 0.95), ("2", "f2", 0.92)}
    assert {(r["entity_id"], r["match_method"]) for r in more.firm_to_institutions(_firms(spark), e).collect()} >= {("1", "ticker"), ("2", "exact_normalized")}
    assert {(r["entity_id"], r["gvkey"]) for r in more.filtered_names(e, _firms(spark)).collect()} >= {("2", "f2")}


def test_wratio_compares_all_pairs(spark):
    # in f1 the shared words are the most frequent, in f2 the words are glued
    f = spark.createDataFrame([("f1", "Nasnifokre Aerospace qq zz", "NSF"), ("f2", "Rashajuru Logistics", "RSH"),
        ("f3", "Nasnifokre Bolts", "NAB")], "gvkey string, conm string, tic string")
    e = spark.createDataFrame([("1", "nasnifokre aerospace"), ("2", "rasha juru logistics"),
        ("3", "aerospace nasnifokre parts makers of the northern coast"), ("4", "cooking")] + [(f"x{n}", f"nasnifokre aerospace {w}") for n,
        w in enumerate(["uu vv", "ww yy"])], "entity_id string, name string")
    assert {(r["entity_id"], r["gvkey"]) for r in more.wratio_stage2(e, f).collect()} >= {("1", "f1"), ("2", "f2")}
    got = {r["entity_id"]: (r["gvkey"], r["match_method"]) for r in more.legacy(e, f).collect()}
    assert got["1"] == ("f1", "fuzzy") and got["2"] == ("f2", "fuzzy") and got["3"] == ("f1", "fuzzy") and "4" not in got


def test_concepts(spark):
    c = spark.createDataFrame([("1", "Known", []), ("2", "Neural network layer", []), ("3", "Neural stem cell", ["2"]),
        ("4", "Sub topic", ["2"]), ("5", "Reinforcement learnings", []), ("6", "Cooking", None)], "id string, display_name string, ancestors array<string>")
    got = rows(more.select_concepts(c, spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([("reinforcement learning",)], "term string")))
    assert got == [("1", "known"), ("2", "taxonomy"), ("4", "ancestor"), ("5", "taxonomy")]


def test_patent_pipeline(spark):
    s = spark.createDataFrame([("1", 0, 0.9), ("2", 1, 0.1), ("3", 0, 0.5)], "doc_id string, flag int, a double")
    p = spark.createDataFrame([("1", "2015-01-02"), ("2", "bad"), ("3", "2015-01-01")], "patent_id string, patent_date string")
    a = spark.createDataFrame([("1", "x", "Acme Rotors, Inc."), ("2", "y", "Acme Rotors")], "patent_id string, assignee_id string, organization string")
    panel = pipelines.patents_to_panel(s, p, a, "flag", ["a", "a"])
    assert rows(panel.select("clean_name", "year", "total_ai_patents")) == [("ACME ROTORS", 2015, 1), ("ACME ROTORS", None, 1)]
    names = panel.select(F.col("assignee_id").alias("entity_id"), F.col("clean_name").alias("name"))
    links = pipelines.link_patents(names, _firms(spark))
    out = pipelines.patent_report(panel, links)
    assert rows(out["panel"].select("gvkey", "year", "total_patents")) == [("f1", 2015, 1), ("f1", None, 1)]
