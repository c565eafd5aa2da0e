import json

from conftest import rows
from pyspark.sql import functions as F

from orgweave.functions import records
from orgweave.operators import dedup, drift, linking, metrics, nested, panel, validate
from orgweave.sources import readers, sinks
from orgweave.streaming import ingest


def test_growth_hhi_gini_top(spark):
    y = spark.createDataFrame([(2000, 10), (2001, 15), (2002, 12)], "y int, n int")
    assert [r["growth_pct"] for r in metrics.growth(y, "y", "n").orderBy("y").collect()] == [None, 50.0, -20.0]
    t = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, x int")
    assert round(metrics.hhi(t, "k", "x").first()["hhi"], 6) == 3800
    flat, steep = (spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "k string, x int") for v in ([1, 1, 1, 1], [0, 0, 0, 4]))
    assert abs(metrics.gini(flat, "k", "x").first()["gini"]) < 1e-12 and abs(metrics.gini(steep, "k", "x").first()["gini"] - 0.75) < 1e-12
    assert rows(metrics.top_share(t, "k", "x", [1, 2])) == [(1, 50.0), (2, 80.0)]
    assert metrics.lorenz(t, "k", "x").agg(F.max("value_share")).first()[0] == 1.0


def test_leaders_one_percent(spark):
    for n, wanted in ((50, 1), (250, 2)):
        assert metrics.leaders(spark.range(n).withColumn("x", F.col("id")), "id", "x").count() == wanted


def test_gaps_decline_index(spark):
    e = spark.createDataFrame([("2024-01-01",)] * 10 + [("2024-01-20",)] * 3 + [(None,)], "ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["records"] for r in metrics.gaps(e, "ts", 7, 1.0).orderBy("period_start").collect()] == [0, 3]
    d = spark.createDataFrame([("a", 2019, 10), ("a", 2020, 8), ("a", 2021, 2), ("b", 2019, 1)], "k string, y int, n int")
    r = metrics.decline(d, "k", "y", "n", 2020).collect()
    assert len(r) == 1 and (r[0]["peak_year"], r[0]["pre_avg"], r[0]["post_avg"], r[0]["has_decline"]) == (2019, 9.0, 2.0, True)
    assert metrics.index_to_base(d, ["k"], "y", "n", 2021, keep_without=False).count() == 3


def test_dedup(spark):
    m = spark.createDataFrame([("p", "stage2", 0.97), ("p", "stage1", 0.97), ("q", "stage3", None), ("q", "stage3", None)], "k string, s string, c double")
    assert rows(dedup.keep_best(m, ["k"], F.desc_nulls_last("c"), F.col("s"))) == [("p", "stage1", 0.97), ("q", "stage3", None)]
    assert rows(dedup.keep_max(m, ["k"], "c", "s")) == [("p", "stage1", 0.97), ("q", "stage3", None)]
    assert rows(dedup.drop_ambiguous(m, "k", "s").select("k").distinct()) == [("q",)]
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(dedup.set_overlap(a, b, "k").first()) == (1, 1, 1)


def test_comprehensive_outer_keeps_both_keys(spark):
    a, b = spark.createDataFrame([("F1", 2001, 5)], "gvkey string, year int, n int"), spark.createDataFrame([("F2", 2001, 7)], "gvkey string, year int, m int")
    assert rows(panel.comprehensive(a, b, ["gvkey", "year"], ["n", "m"])) == [("F1", 2001, 5, 0), ("F2", 2001, 0, 7)]


def test_financials_fan_out_or_not(spark):
    p = spark.createDataFrame([("F1", 2001)], "gvkey string, year int")
    f = spark.createDataFrame([("F1", 2001, "P", 1, 1.0), ("F1", 2001, "C", 2, 2.0), ("F1", 2001, "J", 3, 3.0)],
        "gvkey string, fyear int, linkprim string, lpermno long, at double")
    assert panel.with_financials(p, f, ["at", "absent"]).count() == 2
    assert rows(panel.with_financials(p, f, ["at"], one_row=True)) == [("F1", 2001, 2.0)]


def test_cascades(spark):
    i = spark.createDataFrame([("child", ["x", "par"]), ("par", [])], "entity_id string, parents array<string>")
    m = spark.createDataFrame([("par", "001", 0.98)], "entity_id string, gvkey string, match_confidence double")
    assert rows(linking.parent_cascade(i, m)) == [("child", "001", "parent_cascade", 0.96)]
    s = lambda r: spark.createDataFrame(r, "entity_id string, gvkey string, match_method string, match_confidence double")
    got = linking.first_hit(s([("a", "1", "x", 0.9)]), s([("a", "2", "y", 0.99), ("b", "3", "y", 0.99)]))
    assert rows(got) == [("a", "1", "x", 0.9), ("b", "3", "y", 0.99)]


def test_confidences(spark):
    t, f = F.lit(True), F.lit(False)
    one = spark.range(1)
    assert one.select(linking.stage2_confidence(F.lit(0.85), t, t, f, f)).first()[0] == 0.94
    assert one.select(linking.stage2_confidence(F.lit(0.85), t, f, f, f)).first()[0] is None
    assert [one.select(linking.wratio_confidence(F.lit(float(x)))).first()[0] for x in (90, 96, 100, 80)] == [0.75, 0.89, 0.92, None]
    assert one.select(linking.same_country(F.lit("us"), F.lit("USA")),
        linking.same_country(F.lit(None).cast("string"), F.lit("US"))).first()[:] == (True, False)


def test_patent_stage2_compares_all_names(spark):
    # glued words; and two rows of one firm take one of the k places
    a = spark.createDataFrame([("p", "GRUFROFUDESYSTEMS PARTNERS"), ("q", "GRUFROFUDE SYSTEMS PARTNER"), ("r", "BOLTS"), ("s", None)],
        "entity_id string, name string")
    f = spark.createDataFrame([("g1", "GRUFROFUDE SYSTEMS PTNRS", "x"), ("g1", "GRUFROFUDE SYSTEMS PTNRS", "y"), ("g2", None, None)],
        "gvkey string, conm_clean string, busdesc string")
    assert {(r["entity_id"], r["gvkey"], r["match_method"]) for r in linking.patent_stage2(a, f, 2).collect()} == {("p", "g1",
        "fuzzy_high"), ("q", "g1", "fuzzy_high")}


def test_patent_stage1(spark):
    a = spark.createDataFrame([("1", "ACME ROTORS"), ("2", "ACME ROTORS EUROPE"), ("3", "GRW"), ("4", "IBM"), ("5", "ZED XYZ WORKS")],
        "entity_id string, name string")
    f = spark.createDataFrame([("f1", "ACME ROTORS", None, "AC"), ("f2", "GLOBAL ROTOR WORKS", None, None),
        ("f3", "INTERNATIONAL BUSINESS MACHINES", None, None), ("f4", "OTHER", None, "XYZ")], "gvkey string, conm_clean string, conml_clean string, tic string")
    got = {(r["entity_id"], r["gvkey"], r["match_method"]) for r in linking.patent_stage1(a, f).collect()}
    assert ("1", "f1", "exact_conm") in got and ("2", "f1", "firm_contained") not in got  # exact stops the firm
    assert {("3", "f2", "abbreviation_generated"), ("4", "f3", "abbreviation_dict"), ("5", "f4", "ticker_in_name")} <= got


def test_manual_identifier_and_keys(spark):
    e = spark.createDataFrame([("1", "the acme lab"), ("2", "acme")], "entity_id string, name string")
    f = spark.createDataFrame([("f", "ACM")], "gvkey string, tic string")
    m = spark.createDataFrame([(2, "acme", "ACM"), (1, "zzzz", "ACM")], "rule_no int, pattern string, tic string")
    assert {r["entity_id"] for r in linking.manual_matches(e, f, m, contained=True).collect()} == {"1", "2"}
    assert {r["entity_id"] for r in linking.manual_matches(e, f, m).collect()} == {"2"}
    a = spark.createDataFrame([("x", "Acme (ZZZ) CIK: 0001234567", "n"), ("y", "nothing", "lone")], "entity_id string, text string, name string")
    g = spark.createDataFrame([("f1", "1234567", None, "ZZZ", "n"), ("f2", None, None, None, "lone")],
        "gvkey string, cik string, cusip6 string, tic string, conm_clean string")
    assert {(r["entity_id"], r["gvkey"], r["match_method"]) for r in linking.identifier_matches(a, g).collect()} == {("x", "f1", "cik"),
        ("y", "f2", "unique_name")}


def test_token_and_contained_pairs_against_brute_force(spark):
    import random

    random.seed(1)
    words = ["aa", "bb", "cc", "dd", "ee"]
    x = [(str(i), random.sample(words, random.randint(1, 4))) for i in range(12)]
    y = [(str(i), random.sample(words, random.randint(1, 4))) for i in range(12)]
    got = {tuple(r) for r in linking.token_pairs(spark.createDataFrame(x, "id string, tokens array<string>"),
        spark.createDataFrame(y, "id string, tokens array<string>")).collect()}
    want = {(a, b, len(set(s) & set(t))) for a, s in x for b, t in y if len(set(s) & set(t)) >= min(2, len(s))}
    assert got == want
    e = [(str(i), "".join(random.choice("ab") for _ in range(14))) for i in range(20)]
    f = [(str(i), "".join(random.choice("ab") for _ in range(9))) for i in range(60)]
    got = {tuple(r) for r in linking.contained_pairs(spark.createDataFrame(e, "entity_id string, name string"),
        spark.createDataFrame(f, "gvkey string, name string")).select("entity_id", "gvkey").collect()}
    assert got == {(a, b) for a, s in e for b, t in f if t in s}


def test_funnel_counts_first_failure(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (9,)], "x int")
    kept, counts = linking.funnel(df, [("small", F.col("x") > 2), ("large", F.col("x") < 8)])
    assert rows(kept) == [(5,)] and rows(counts) == [(0, "small", 2), (1, "large", 1)]


def test_confusion_and_samples(spark):
    df = spark.createDataFrame([(True, True)] * 8 + [(True, False)] * 2 + [(False, True)] * 2 + [(False, False)] * 88 + [(None, True)], "p boolean, a boolean")
    r = validate.confusion(df, "p", "a").first()
    assert [round(r[c], 2) for c in ("accuracy", "precision", "recall", "f1")] == [0.96, 0.8, 0.8, 0.8]
    s = spark.range(100).withColumn("g", F.col("id") % 3)
    assert rows(validate.stratified(s, ["g"], "id", 5).groupBy("g").count()) == [(0, 5), (1, 5), (2, 5)]
    assert validate.proportional(s, "g", "id", 10).count() == 10 and rows(validate.sample(s, "id", 7)) == rows(validate.sample(s, "id", 7))


def test_records(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "d": [{"e": "x"}, {"e": "y"}], "n": null}'), (2, "{bad"), (3, None)], "id int, j string")
    got = {(r["id"], r["path"], r["value"]) for r in records.flatten_paths(df, "id", "j", most=1).collect()}
    assert {(1, "a_b", "1"), (1, "a_c", "1; 2"), (1, "d_0_e", "x"), (1, "d_remaining_count", "1"), (2, "flatten_error", "{bad")} <= got
    html = "<table><tr><th>Type</th><td>Public</td></tr><tr><th>Traded as</th><td>NYSE: ABC</td></tr><tr><td>ISIN US0378331005</td></tr></table>"
    box = spark.createDataFrame([(html,), (None,)], "h string").select(records.infobox(F.col("h")).alias("b")).collect()
    assert (box[0]["b"]["company_type"], box[0]["b"]["tickers"], box[0]["b"]["isin"]) == ("Public", ["ABC"], "US0378331005")


def test_readers_and_sinks(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "a.csv").write_text('id,n\n1,5\n2,x\n3\n4,6,7\n')
    assert rows(readers.csv(spark, str(tmp_path / "a.csv"), "id int, n int")) == [(1, 5), (2, None), (3, None), (4, 6)]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{broken\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "b.jsonl.gz"), "a int")) == [(1,), (2,)]
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 3}]')
    assert readers.sniffed(spark, str(tmp_path / "c.json")).count() == 2
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.tsv", 'id\tname\n1\t"x y"\n2\t\n')
    assert rows(readers.zipped_tsv(spark, str(tmp_path / "d.zip"), "id int, name string")) == [(1, "x y"), (2, None)]
    assert readers.mapping(spark, str(tmp_path / "none.csv"), [("a", "b")], "k string, v string").count() == 1
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.parquet(old, str(tmp_path / "t"))
    new = spark.createDataFrame([("2", "changed"), ("3", "c")], "id string, v string")
    assert rows(sinks.append_unique(spark, new, str(tmp_path / "t"), str(tmp_path / "u"), "id")) == [(1, "a"), (2, "b"), (3, "c")]
    made = lambda b: spark.createDataFrame([(b,)], "x int")
    assert sinks.resumable(spark, [1, 2], str(tmp_path / "r"), made) == [1, 2] and sinks.resumable(spark, [1, 2, 3], str(tmp_path / "r"), made) == [3]
    sinks.json_report(old.limit(1), str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"id": 1, "v": "a"}
    assert r"\toprule" in sinks.latex_table(old, "A_b")


def test_pages(spark):
    df = spark.range(10)
    assert rows(readers.page_by_key(df, "id", 3, 2)) == [(4,), (5,)] and rows(readers.page_by_offset(df, ["id"], 8, 5)) == [(8,), (9,)]
    assert sum(readers.rows_of_batch(df, "id", 3, b).count() for b in range(3)) == 10


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-02 00:00:00")],
        "id int, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    s = ingest.first_arrivals(ingest.file_stream(spark, str(src), "id int, ts timestamp"), "id", "ts", "1 hour")
    ingest.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


# -- nested records and drifting schemas: nulls, empties, odd texts, repeats, empty tables, clashing names -----------------------------


def test_children_of_nested_records(spark):
    j = '{"authorships": [{"institutions": [{"id": "I1", "display_name": null}, null, {"display_name": " "}, {"display_name": "B"}]}, {"institutions": {"id": "I2"}}], "topics": {"id": "T1"}}'
    works = spark.createDataFrame(
        [(1, j, "x"), (2, json.dumps(j), "x"), (3, '{"data": ' + j + "}", "x"), (4, j[:-9], "x"), (5, None, "x"), (6, "null", "x"),
        (7, "﻿[" + j + "]", "x"), (8, "", "x"), (9, "{}", "x"), (None, j, "x")],
        "record_id long, work_json string, item string",
    )
    papers = spark.createDataFrame(
        [(1, [["A", None], None, ["None", " "]], [[None, "I9"], ["I8"]], ["t", ""], None, "x"), (2, None, None, [], [], "x"), (2, None, None, [], [], "x")],
        "record_id long, author_affiliations array<array<string>>, author_affiliation_ids array<array<string>>, topic_names array<string>, topic_ids array<string>, name string",
    )
    got = rows(nested.work_children(papers, works).drop("child_name", "child_id"))
    own = [("affiliation", 1, 1), ("affiliation", 1, 4), ("affiliation", 2, 1), ("topic", 0, 1)]
    want = [("openalex_work_json", r, *c) for r in (1, 2, 3, 7) for c in own] + [("ai_papers", 1, k, a, c) for k, a,
        c in (("affiliation", 1, 1), ("affiliation", 1, 2), ("affiliation", 2, 1), ("topic", 0, 1))]
    assert got == sorted(want, key=str)
    assert nested.work_children(papers.limit(0), works.limit(0)).count() == 0


def test_child_tables_keep_keys_ordinals_and_clashing_names(spark):
    df = spark.createDataFrame([(1, '{"item": "a", "id": 5, "l": [{"no_1": 7, "m": [1, 2]}, {"m": null}]}'), (2, '{"l": {"no_1": 8}}')], "id long, j string")
    t = nested.child_tables(df, "id", "j")
    assert set(t) == {"", "l", "l.m"}
    assert "id_field" in t[""].columns and "item_field" in t[""].columns and "no_1_field" in t["l"].columns
    assert rows(t["l"].select("id", "no_1", "no_1_field")) == [(1, 1, "7"), (1, 2, None), (2, 1, "8")]
    assert rows(t["l.m"].select("id", "no_1", "no_2")) == [(1, 1, 1), (1, 1, 2)]


def _raw(spark, files):
    data = [("f", no, seq, line, json.dumps(r) if not isinstance(r, str) else r, "x") for no, seq, recs in files for line, r in enumerate(recs)]
    return spark.createDataFrame(data, "feed string, file_no long, file_seq int, line_no int, record string, kind string")


def test_schema_changes(spark):
    words = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta"]
    a = [{"id": str(i), "venue": words[i % 4], "count": i, "old": True, "n": None} for i in range(12)]
    b = [{"id": str(i), "source_name": words[i % 4], "count": str(i), "fresh": [[1]], "n": 1} for i in range(12)]
    raw = _raw(spark, [(1, 1, a), (2, 2, [*b, b[0], b[0], "{cut", "[1]"]), (3, 3, [])])
    raw = raw.unionByName(_raw(spark, [(4, 4, [{"id": "1"}, "null"])]))
    got = {(r["file_no"], r["field_name"], r["change_kind"]) for r in drift.schema_changes(raw).collect()}
    want = {(2, "source_name", "renamed"), (2, "count", "retyped"), (2, "old", "removed"),
        (2, "fresh", "added")} | {(4, c, "removed") for c in ("source_name", "count", "fresh", "n")}
    assert got == want


def test_schema_changes_of_nothing(spark):
    raw = _raw(spark, [(1, 1, [{"a": 1}])])
    assert drift.schema_changes(raw).count() == 0 and drift.schema_changes(raw.limit(0)).count() == 0
    nulls = raw.withColumns({c: F.lit(None).cast(t) for c, t in raw.dtypes})
    assert drift.schema_changes(nulls).count() == 0


def test_unified_table(spark):
    a = [{"venue": w, "k": i} for i, w in enumerate(["alpha beta", "gamma delta", "epsilon zeta"] * 3)]
    b = [{"source": w, "k": str(i)} for i, w in enumerate(["alpha beta", "gamma delta", "epsilon zeta"] * 3)]
    raw = _raw(spark, [(1, 1, a), (2, 2, b)])
    u = drift.unified_table(raw, drift.schema_changes(raw))
    assert {r[0] for r in u.select("unified").distinct().collect()} == {"venue", "k"} and u.count() == 36


def _flooded(spark, old, new, beside=()):
    """old, new: {file: {name: (kind, counters)}}; beside: names that stand side by side in a file."""
    pairs = [(f, a, b, old[f][a][0], new[f][b][0]) for f in old for a in old[f] for b in new[f]]
    side = lambda x: spark.createDataFrame([(f, a, b, c) for f in x for a in x[f] for b, c in x[f][a][1].items()], "file_no long, field string, b int, c long")
    schemas = spark.createDataFrame([(100 + n, x) for n, names in enumerate(beside) for x in names], "file_no long, field string")
    start = drift.evidence(spark.createDataFrame(pairs, "file_no long, old_name string, new_name string, old_kind string, new_kind string"),
        side(old), side(new))
    return drift.flood(start, schemas)


def test_flooding_prefers_values_and_names(spark):
    old = {1: {"cited_by_count": ("number", {1: 5, 2: 5}), "venue": ("string", {10: 4, 11: 4})}}
    new = {1: {"source": ("string", {10: 5, 11: 3}), "citations": ("string", {1: 4, 2: 6}), "other": ("boolean", {99: 9})}}
    assert rows(drift.correspondences(_flooded(spark, old, new))) == [(1, "cited_by_count", "citations"), (1, "venue", "source")]
    assert rows(drift.correspondences(_flooded(spark, old, {1: {}}))) == [] and rows(drift.correspondences(_flooded(spark, {1: {}}, new))) == []


def test_flooding_decides(spark, monkeypatch):
    """In file 3 the values of one field say too little; the same names in files 1 and 2 tell. In file 4 two flags have like values, but their
    names stand side by side elsewhere. Without the flow both come out wrong."""
    flag, text = {1: 5, 2: 5}, {10: 4, 11: 4}
    old = {1: {"open": ("string", text)}, 2: {"open": ("string", text)}, 3: {"open": ("string", {1: 5, 2: 4, 3: 1})}, 4: {"is_open": ("boolean", flag)}}
    new = {1: {"oa_mark": ("string", text)}, 2: {"oa_mark": ("string", text)}, 3: {"oa_mark": ("string", {1: 3, 8: 3, 9: 4})},
        4: {"is_withdrawn": ("boolean", flag)}}
    beside = [("is_open", "is_withdrawn")] * 6
    want = [(1, "open", "oa_mark"), (2, "open", "oa_mark"), (3, "open", "oa_mark")]
    assert rows(drift.correspondences(_flooded(spark, old, new, beside))) == want
    monkeypatch.setattr(drift, "FLOW", 0.0)
    assert rows(drift.correspondences(_flooded(spark, old, new, beside))) == [*want[:2], (4, "is_open", "is_withdrawn")]


def test_value_kinds(spark):
    v = spark.createDataFrame([('"a"',), ("1.5",), ("true",), ("[]",), ("[[]]",), ('{"a": 1}',), ("null",), (None,)],
        "j string").select(drift.value_kind(F.try_parse_json("j")))
    assert [r[0] for r in v.collect()] == ["string", "number", "boolean", "list", "list of lists", "object", None, None]
