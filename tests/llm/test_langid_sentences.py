import pytest

from orgweave.llm import langid

DE = "Die Maschine lernt aus vielen Beispielen und erkennt danach neue Bilder ohne weitere Hilfe. Der Fehler sinkt dabei um die Hälfte, wenn genug Daten da sind. "
EN = "The machine learns from many examples and then recognises new pictures without any further help. The error falls by half if there is enough data. "


@pytest.fixture(scope="module")
def model():
    sets = {}
    for code, text in (("de", DE), ("en", EN)):
        sets[code] = langid.grams([text])[0]
    return langid.Filter(sets)


def _read(model, text):
    r = langid.read_documents([text], model)
    return [(x.lang_code, bool(x.whole)) for x in r.itertuples()]


def test_a_short_sentence_in_another_language_counts(model):
    assert _read(model, EN + "Der Fehler sinkt. " + EN) == [("en", True), ("de", True), ("en", True)]


@pytest.mark.parametrize("extra", ["See https://www.fehler.example/die/maschine?id=5. ", "Mail: die.maschine@beispiel.example. ",
    "Terms: Maschine, Fehler, neue Bilder, Daten. ", "Die Maschine\n", "12345. ", "!!! "])
def test_addresses_lists_and_titles_dont_count(model, extra):
    assert {x for x, whole in _read(model, EN + extra + EN) if whole} == {"en"}


def test_many_texts_are_read_as_each_alone(model):
    texts = [DE, "", EN, "x", " \n ", DE + EN, "123", EN * 300, "中文", "\x00", EN + "\x00" + DE]
    all_ = langid.read_documents(texts, model)
    for d, t in enumerate(texts):
        alone = langid.read_documents([t], model)
        got = all_[all_["doc"] == d].drop(columns="doc").reset_index(drop=True)
        assert got.astype(str).equals(alone.drop(columns="doc").reset_index(drop=True).astype(str)) and (len(got) == 0 or got["end"].max() <= len(t))
    assert set(all_["doc"]) >= {0, 2, 5, 7}
