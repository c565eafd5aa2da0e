import pytest

from orgweave.llm import spellings


def _classes(spark, names):
    df = spark.createDataFrame([("t", n, k) for n, k in names], "tab_name string, name string, n long")
    out = {}
    for r in spellings.canonical_forms(df).collect():
        out.setdefault(r["class_id"], set()).add(r["name"])
    return sorted((sorted(c) for c in out.values()), key=str)


#: Names whose errors teach the rates: letters are left out and swapped, never exchanged.
LEARNED = [(f"{a}{b} Motors", 30) for a in ("Plova", "Kresti", "Stranu", "Glipo") for b in ("ramik", "dresko", "lutrif", "venos", "gapilu")]
LEARNED += [(n.replace("o", "", 1) if i % 2 else n[:2] + n[3] + n[2] + n[4:], 2) for i, (n, _) in enumerate(LEARNED)]


def test_learned_rates_tell_errors_from_namesakes(spark):
    """One letter left out of a frequent name is an error; two exchanged vowels make another name. Constant chances by distance alone took both."""
    got = _classes(spark, [*LEARNED, ("Wiskerablo Motors", 40), ("Wiskerabl Motors", 1), ("Wiskeriblu Motors", 6)])
    mine = [c for c in got if any(n.startswith("Wisk") for n in c)]
    assert mine == [["Wiskerabl Motors", "Wiskerablo Motors"], ["Wiskeriblu Motors"]]


def test_without_the_posterior_namesakes_would_be_joined(spark, monkeypatch):
    monkeypatch.setattr(spellings, "TWIN", 0.0)
    monkeypatch.setattr(spellings, "_meant_as_typed", lambda model: lambda core: spellings.F.lit(0.0))
    got = _classes(spark, [*LEARNED, ("Wiskerablo Motors", 40), ("Wiskeriblu Motors", 6)])
    assert [c for c in got if any(n.startswith("Wisk") for n in c)] == [["Wiskerablo Motors", "Wiskeriblu Motors"]]


@pytest.mark.parametrize("seen, meant, error", [("abcdefgh", "abdcefgh", "swap"), ("abcefgh", "abcdefgh", "out"),
    ("abcxdefgh", "abcdefgh", "in"), ("abcxefgh", "abcdefgh", "other"), ("abcde", "abcdefgh", "clipped"), ("abefgh", "abcdefgh", "out+out"),
    ("xbcdefgy", "abcdefgh", "other+other"), ("abc", "uvwxyz", None)])
def test_error_classes(seen, meant, error):
    assert spellings.error_class(seen, meant) == error


def test_two_errors_meet(spark):
    forms = spark.createDataFrame([("t", "k", "wiskerablos", 1), ("t", "k", "wsikerabls", 1), ("t", "k", "wixkeraylos", 1)],
        "tab_name string, kind string, core string, n long")
    keys = {r["core"]: set() for r in forms.collect()}
    for r in spellings._keys(forms).collect():
        keys[r["core"]].add(r["key"])
    assert keys["wiskerablos"] & keys["wixkeraylos"] and keys["wiskerablos"] & keys["wsikerabls"]


def test_odd_names(spark):
    assert _classes(spark, [(None, 3), (" ", 1), ("", 1)]) == []
    assert len(_classes(spark, [("中文", 1), ("!!", 2), ("a", 1), ("x" * 3000 + " Motors", 1)])) == 4
