from pyspark.sql import functions as F

from orgweave.functions import classify, identifiers, similarity, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_clean_organization_name(spark):
    for given, wanted in (("Acme Widgets, Inc.", "ACME WIDGETS"), ("", None), (None, None), ("CO.", None)):
        assert one(spark, given, text.clean_organization_name) == wanted


def test_normalisers_differ_and_take_null(spark):
    df = spark.createDataFrame([("The Acme Systems Group (Japan) Inc",), ("Cisco",), (None,), ("",)], "x string")
    got = {k: [r[0] for r in df.select(f(F.col("x"))).collect()] for k, f in text.NORMALISERS.items()}
    assert got["normalize_assignee"][1] == "cis"
    assert got["normalize_aggressive"][0] == "acme"  # one ordered pass: " inc", "group", "systems"
    assert got["normalize_firm"][0] == "acme systems group"
    assert got["normalize_wikipedia"][0] == "the acme systems group japan"
    assert all(v[2] in ("", None) and v[3] in ("", None) for v in got.values())


def test_institution_abbreviation_fires_inside_words(spark):
    assert "general electric" in one(spark, "Cambridge", text.normalize_institution)


def test_firm_variants(spark):
    df = spark.createDataFrame([("Global Rotor Works", None, "grw")], "conm string, conml string, tic string")
    assert df.select(text.firm_variants(F.col("conm"), F.col("conml"), F.col("tic"))).first()[0] == ["GLOBAL ROTOR WORKS", "GRW"]


def test_institution_variants(spark):
    df = spark.createDataFrame([("Acme (Japan)", ["Acme Ltd", None], ["ac"]), (None, None, None)], "n string, a array<string>, b array<string>")
    got = [r[0] for r in df.select(text.institution_variants(F.col("n"), F.col("a"), F.col("b"))).collect()]
    assert got == [["AC", "ACME", "ACME JAPAN"], []]


def test_identifiers(spark):
    assert one(spark, "research.acme.co.uk", identifiers.root_domain) == "acme.co.uk"
    assert one(spark, "a.b.acme.com", identifiers.root_domain) == "acme.com"
    assert one(spark, "arXiv:2104.11612v2", identifiers.arxiv_id) == "2104.11612"
    assert one(spark, "https://openalex.org/I12", identifiers.institution_id) == "I12"
    assert one(spark, "W1", identifiers.institution_id) is None
    assert one(spark, "https://www.Acme.com:80/x", identifiers.host) == "acme.com"
    assert one(spark, "https://www.Acme.com:80/x", identifiers.netloc) == "www.Acme.com:80"
    assert one(spark, "http://www.acme.com/a/b", identifiers.domain) == "acme.com"
    assert one(spark, "http://en.wikipedia.org/wiki/Acme_Corp%26Co", identifiers.wikipedia_title) == "Acme Corp&Co"
    assert one(spark, "Acme (INC) NYSE: ACM", identifiers.ticker) == "ACM"
    assert one(spark, "CUSIP: 123456789", identifiers.cusip6) == "123456"
    for f in (identifiers.domain, identifiers.host, identifiers.root_domain, identifiers.ticker, identifiers.any_date):
        assert one(spark, None, f) is None


def test_any_date(spark):
    for s in ("2024-05-06", "2024-05-06 07:08:09", "2024-05-06T07:08:09Z"):
        assert str(one(spark, s, identifiers.any_date))[:10] == "2024-05-06"
    assert one(spark, "no date", identifiers.any_date) is None


def test_affiliation_type(spark):
    for given, wanted in (("Stanford University", "university"), ("Naval Research Lab", "government"), ("Acme Inc", "firm"),
        (None, "unknown"), ("Bell Labs", "firm"), ("Lab for Systems", "firm"), ("Some Place", "unknown")):
        assert one(spark, given, classify.affiliation_type) == wanted


def test_labels_by_context_and_substring(spark):
    f = lambda c: classify.ai_labels(c)
    assert one(spark, "dropout voltage regulator", f)["is_algorithm"] is False
    assert one(spark, "dropout in a neural layer", f)["is_algorithm"] is True
    assert one(spark, "memory for a neural model", f)["is_infrastructure"] is True
    assert one(spark, "memory from a neural model", f)["is_infrastructure"] is False  # "rom" is in "from"
    assert one(spark, "a basic circuit", f)["is_infrastructure"] is True  # "asic" is in "basic"
    assert one(spark, None, f)["primary"] == "Unknown"


def test_score_flag(spark):
    df = spark.createDataFrame([(0, 0.5, None), (0, 0.51, 0.1), (1, 0.1, None), (None, None, None)], "f int, a double, b double")
    assert [r[0] for r in df.select(classify.ai_score_flag(F.col("f"), F.col("a"), F.col("b"))).collect()] == [False, True, True, False]


def test_cpc_label_first_of_equals(spark):
    assert one(spark, ["G06N3", "G06F1"], classify.cpc_label, "array<string>") == "Algorithm"
    assert one(spark, ["X", "G06Q1", "G06Q2"], classify.cpc_label, "array<string>") == "Application"
    assert one(spark, [], classify.cpc_label, "array<string>") == "Unknown"


def test_author_affiliation(spark):
    assert tuple(one(spark, "John Doe (Google Research)", classify.author_affiliation)) == ("John Doe", "Google Research")
    assert tuple(one(spark, "Jane Roe, Acme University", classify.author_affiliation)) == ("Jane Roe", "Acme University")
    assert tuple(one(spark, "Jane Roe", classify.author_affiliation)) == ("Jane Roe", None)


def test_big_tech(spark):
    assert one(spark, "META PLATFORMS", classify.big_tech_careful) == "META"
    assert one(spark, "META VISION SYSTEMS", classify.big_tech_careful) is None
    assert one(spark, "METALWORKS", classify.big_tech) == "META"


def test_similarity_against_definitions():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    @settings(max_examples=200, deadline=None)
    @given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
    def check(a, b):
        r = similarity.ratio(a, b)
        assert abs(r - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9
        assert similarity.partial_ratio(a, b) >= r - 1e-9 if len(a) == len(b) else True
        assert 0 <= similarity.wratio(a, b) <= 100 and 0 <= similarity.jaro_winkler(a, b) <= 1

    check()
    assert similarity.token_sort_ratio("b a", "a b") == 100 and round(similarity.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611


def test_near_equals_brute_force():
    import random

    from orgweave.functions import nearby, similarity

    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeo") for _ in range(draw.randint(1, 6)))
    a = sorted({" ".join(word() for _ in range(draw.randint(1, 4))) for _ in range(120)} | {"x  y z", "ab ab corp", "a" * 70 + " inc", "é" * 3 + " soc"})
    b = sorted({x[: draw.randrange(len(x))] + word() + x[draw.randrange(len(x)) :] for x in a} | {"x y  z", "ab corp corp",
        "a" * 69 + " inc", "é" * 3 + " sod"})
    for name, least in (("ratio", 85.0), ("jaro_winkler", 0.85), ("wratio", 85.0), ("wratio", 90.0)):
        scored = [(i, j, getattr(similarity, name)(x, y)) for i, x in enumerate(a) for j, y in enumerate(b)]
        want = sorted((r for r in scored if r[2] >= least), key=lambda r: (r[0], -r[2], r[1]))
        assert sorted(nearby.near(a, b, name, least), key=lambda r: (r[0], -r[2], r[1])) == want and want
        best = [r for n, r in enumerate(want) if n < 3 or want[n - 3][0] != r[0]]
        assert nearby.near(a, b, name, least, 3) == best


def test_few_pairs_of_names_are_scored_one_by_one(monkeypatch):
    import random

    from orgweave.functions import nearby, similarity

    random.seed(8)
    made = lambda: "".join(random.choice(["ba", "kle", "no", "tru", "spi", "vo", "gra", "mu", "the", "li"]) for _ in range(random.choice([2, 3, 4])))
    kinds = ["university", "medical center", "robotics", "optics", "labs intl", "partners group holdings"]
    a, b = (list(dict.fromkeys(f"{made()} {random.choice(kinds[start:])}".strip() for _ in range(n))) for start, n in ((0, 50), (2, 500)))
    score, calls = similarity.wratio, []
    monkeypatch.setattr(similarity, "wratio", lambda x, y: calls.append(1) or score(x, y))
    got = nearby.near(a, b, "wratio", 80.0, 1)
    want = [min(((i, j, s) for j, y in enumerate(b) if (s := score(x, y)) >= 80.0), key=lambda r: (-r[2], r[1]), default=None) for i, x in enumerate(a)]
    assert got == [w for w in want if w] and got
    assert len(calls) <= 2 * len(a)


def test_words_in_common_of_two_weights():
    from orgweave.functions import nearby

    # lengths of eight to one weigh less: the first such name isn't the best
    assert nearby.near(["ai qqqqqq"], ["ai" + " wxyk" * 14, "ai wxykwxyk vvvv"], "wratio", 55.0, 1) == [(0, 1, 85.5)]
