"""Reading organisation names as people type them.

``parse`` splits a name into a *core* (the words that identify the organisation) and a *kind* (what sort of body it is:
"univ", "state+univ", "foods", ...). Legal forms, countries, departments, research units and bodies that only hold rights
are dropped, abbreviations and translations are brought to one class per word, and typing errors in known words are mended.
Everything else in a name is core. The word lists are general business and academic vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class of a body -> the words and translations that express it.
_HEADS = {
    "univ": "university universitaet universitat universite universidad universidade universita universiteit uni univ u",
    "inst": "inst institute institut instituto istituto instituut",
    "acad": "acad academy akademie academie academia accademia",
    "ctr": "center centre zentrum centro ctr",
    "natl": "national nationales nacional nazionale natl nat",
    "coll": "college kolleg colegio",
    "hosp": "hospital klinik hopital ospedale clinic clinica",
    "state": "state staatliche estatal st",
    "sci": "sciences science wissenschaften ciencias scienze sci",
    "appl": "applied angewandte aplicadas appl",
    "tech": "technology technologies technical technische technological tecnologia tecnica technique tech",
    "medical": "medical medizinische medico medicine medizin med",
}
# Words of business; each is its own class.
_TRADES = (
    "solutions communications pharmaceuticals logistics insurance financial telecom software semiconductor motors robotics energy "
    "optics materials instruments electronics foods devices analytics industries biosciences networks imaging manufacturing "
    "aerospace chemicals automotive entertainment healthcare therapeutics diagnostics bank capital steel textiles airlines media "
    "gaming mining petroleum utilities retail consulting engineering"
)
# Words that an organisation adds to its name or leaves out without becoming another one.
_TAILS = {"systems", "partners", "holdings", "group", "international", "laboratories", "tech"}
_TAIL_WORDS = {
    "systems": "systems system", "partners": "partners partner", "holdings": "holdings holding", "group": "group groupe gruppe grupo gruppo",
    "international": "international internationale", "laboratories": "laboratories laboratory labs lab laboratorium laboratoire laboratorio",
}
_IRREGULAR = {
    "solutions": "soltns solns", "partners": "ptnrs", "holdings": "hldgs hldg", "group": "grp", "international": "intl", "systems": "sys",
    "industries": "inds ind", "electronics": "electrs elec", "semiconductor": "semicon", "manufacturing": "mfg", "materials": "matls",
    "communications": "comm comms", "financial": "finl fin", "insurance": "ins", "pharmaceuticals": "pharma", "biosciences": "biosci",
    "instruments": "instr", "motors": "mtrs", "telecom": "telcm", "aerospace": "aerosp", "laboratories": "labs",
}
_LEGAL = set(
    "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag sa s.a nv bv spa sas sarl oy oyj ab as asa se kk kg kgaa pty "
    "pte srl aps adr cl the".split()
)
_LEGAL_PHRASES = re.compile(r"\b(kabushiki kaisha|a delaware( corp| corporation)?|aktiengesellschaft|societe anonyme|co ltd|class [ab]|cl [ab])\b")
_LINKS = set("of de du des der die das do da del della di la le les el and for fur fuer et und y e at in".split())
COUNTRIES = {
    "united states": "US", "usa": "US", "united kingdom": "GB", "uk": "GB", "china": "CN", "japan": "JP", "germany": "DE", "france": "FR", "canada": "CA",
    "india": "IN", "italy": "IT", "spain": "ES", "brazil": "BR", "south korea": "KR", "korea": "KR", "netherlands": "NL", "switzerland": "CH", "israel": "IL",
    "portugal": "PT", "sweden": "SE", "australia": "AU", "austria": "AT", "belgium": "BE", "denmark": "DK", "finland": "FI", "norway": "NO", "ireland": "IE",
    "poland": "PL", "russia": "RU", "singapore": "SG", "taiwan": "TW", "mexico": "MX", "turkey": "TR", "greece": "GR", "hong kong": "HK", "hungary": "HU",
    "czech republic": "CZ", "south africa": "ZA", "new zealand": "NZ", "argentina": "AR", "chile": "CL", "thailand": "TH", "malaysia": "MY",
}
_COUNTRY = re.compile(r"(?<!of )\b(%s)\s*$" % "|".join(sorted(COUNTRIES, key=len, reverse=True)))
_RIGHTS = re.compile(
    r"^(the )?((board of )?(regents|trustees|governors|curators)( of)?|president and fellows of|governing council of)( the)? |"
    r" (research|alumni|technology) foundation$| (technology )?licensing( office| group)?$| intellectual property( holdings| management)?$| ip( holdings)?$|"
    r" technology transfer( office)?$"
)
_UNIT = re.compile(
    r"^(dept|department|school|graduate school|faculty|division|laboratory for|lab for|institute for|center for|centre for|section)\b|"
    r"^(ai|artificial intelligence|machine intelligence|machine learning|data science|robotics|vision|nlp|r d|research)( research)? (lab|labs|laboratory|group|unit|center|centre|team|division|institute)$"
)
_UNIT_TAIL = re.compile(
    r" ((ai|artificial intelligence|machine intelligence|machine learning|r d|central)( research)? (lab|labs|laboratory|laboratories|group|unit|center|centre|team)|"
    r"research( and development)?( lab| labs| laboratory| laboratories| center| centre| group| institute| division| unit)?|r d)$"
)
_UNIT_OF = re.compile(r"^((institute|laboratory|lab|center|centre) for|(dept|department|division|faculty|school|graduate school) of) .+? of (?=\w{3})")
_UNIT_HEAD = re.compile(r"^(ai|artificial intelligence|machine intelligence) (lab|laboratory|group) (of |at )?")
_EXTRA_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def _words() -> tuple[dict[str, str], dict[str, str]]:
    exact: dict[str, str] = {}
    for table in (_HEADS, _TAIL_WORDS, _IRREGULAR, {w: w for w in _TRADES.split()}):
        for kind, words in table.items():
            for w in words.split():
                exact.setdefault(w, kind)
    exact["labs"] = exact["lab"] = "laboratories"
    return exact, {w: k for w, k in exact.items() if len(w) >= 5}


_EXACT, _LONG = _words()
#: Whole-word abbreviations of more than one word.
_ACRONYMS = {"uas": ("univ", "appl", "sci"), "tu": ("tech", "univ")}
_ACADEMIC = {"univ", "inst", "acad", "natl", "coll", "hosp"}


def osa(a: str, b: str, most: int) -> int:
    """Edits (swap of neighbours counts one) between two strings, or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _gaps(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Known long words by themselves and by what is left without one letter: whatever is one edit away shares an entry.
_NEAR: dict[str, set[str]] = {}
for _w in _LONG:
    for _g in _gaps(_w):
        _NEAR.setdefault(_g, set()).add(_w)


@lru_cache(maxsize=200_000)
def _kind_of(word: str) -> str | None:
    """The class of a known word, of an abbreviation of one, or of one with a typing error (long words: two)."""
    if word in _EXACT:
        return _EXACT[word]
    if len(word) >= 4:
        close = {w for g in _gaps(word) for w in _NEAR.get(g, ())}
        for most in (1, 2):
            near = {_LONG[w] for w in close if osa(word, w, most) <= most} if most == 1 or len(word) >= 10 else set()
            if len(near) == 1:
                return near.pop()
    if 4 <= len(word) <= 7:  # a clipped word: technol, electron
        begun = {k for w, k in _LONG.items() if len(w) >= len(word) + 3 and w.startswith(word)}
        if len(begun) == 1:
            return begun.pop()
    return None


_ENDINGS = re.compile("(?<=.{4})(%s)$" % "|".join(sorted(_LONG, key=len, reverse=True)))


def _split_glued(word: str) -> list[str]:
    """The word and the known words that were typed onto its end."""
    tail: list[str] = []
    while _kind_of(word) is None and (hit := _ENDINGS.search(word)):
        word, tail = word[: hit.start()], [hit[0], *tail]
    return [word, *tail]


def fold(text: str) -> str:
    """Lower case without marks; words and the separators , and ; only."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKC", text))
    text = unicodedata.normalize("NFKD", text.casefold().translate(_EXTRA_LETTERS))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", text)  # l.l.c, s.a
    text = re.sub(r"[()\[\]|/]| - ", ",", text.replace("&", " and "))
    return re.sub(r"[^\w,;]+|_", " ", text).strip()


class Org(NamedTuple):
    kind: str  # class of body, without the tails
    core: str  # identifying words, run together and folded
    words: str  # all classes of the name, in order
    initials: str


EMPTY = Org("", "", "", "")


def _tokens(segment: str) -> list[str]:
    out: list[str] = []
    for w in segment.split():
        out += _split_glued(w) if len(w) >= 9 else [w]
    return out


def _has_core(segment: str) -> bool:
    return any(_kind_of(w) is None and w not in _LINKS and w not in _LEGAL and not w.isdigit() and w not in _ACRONYMS for w in _tokens(segment))


def _drop_country(segment: str) -> str:
    cut = _COUNTRY.sub("", segment).strip()
    return cut if cut and _has_core(cut) else ("" if not cut else segment)


def core_key(core: str) -> str:
    """Spellings that sound the same: ph/f, c/k, y/i, doubled letters."""
    return re.sub(r"(.)\1+", r"\1", core.replace("ph", "f").replace("ck", "k").replace("c", "k").replace("y", "i"))


@lru_cache(maxsize=100_000)
def parse(name: str | None) -> Org:
    if name is None:
        return EMPTY
    text = fold(name)
    segments = [s for s in (_LEGAL_PHRASES.sub(" ", re.sub(r"\s+", " ", s).strip()).strip() for s in re.split("[,;]", text)) if s and s not in COUNTRIES]
    segments = [s for s in segments if any(w not in _LEGAL for w in s.split())]
    if len(segments) > 1:
        whole = [s for s in segments if not _UNIT.search(s)]
        if any(_has_core(s) for s in whole):
            segments = whole
    # a name given as "Core, University of" is one organisation; further segments with a core of their own are places or parts
    named = " ".join(segments)
    named = _RIGHTS.sub("", _RIGHTS.sub("", f"{named}"))
    for pattern in (_UNIT_OF, _UNIT_TAIL, _UNIT_HEAD):
        cut = pattern.sub("", named).strip()
        if cut != named and _has_core(cut):
            named = cut
    named = _drop_country(named)
    while (parts := named.split()) and len(parts) > 1 and parts[-1] in _LEGAL:
        named = " ".join(parts[:-1])
    cut = _UNIT_TAIL.sub("", named).strip()
    if cut != named and _has_core(cut):
        named = cut
    kinds: list[str] = []
    core: list[str] = []
    for w in _tokens(named):
        if w in _LINKS or (w in _LEGAL and not (w == "the" and not core and not kinds and len(named) < 6)):
            continue
        if w in _ACRONYMS:
            kinds += _ACRONYMS[w]
        elif (k := _kind_of(w)) is not None:
            kinds.append(k)
        else:
            core.append(w)
    initials = "".join(w[0] for w in named.split() if w not in _LINKS and w not in _LEGAL)
    words = " ".join(kinds)
    if not core:
        return Org("", "", words, initials)
    if _ACADEMIC & set(kinds) or ("ctr" in kinds and "medical" in kinds):
        kind = "+".join(sorted(set(kinds)))
    else:
        solid = [k for k in kinds if k not in _TAILS]
        kind = "+".join(sorted(set(solid))) if solid else (kinds[0] if kinds else "")
    return Org(kind, core_key("".join(core)), words, initials)


#: Most letters that a clipped core may lack, and how many must be left.
CLIPPED, STUB = 4, 5


def core_likelihood(seen: str, meant: str) -> float:
    """Chance that a writer who means one core types the other: typing errors, one more syllable left out."""
    if seen == meant:
        return 1.0
    if len(meant) >= 5 and len(seen) >= 4:
        d = osa(seen, meant, 2)
        if d == 1:
            return 0.05
        if len(meant) - len(seen) == 2 and any(core_key(meant[:i] + meant[i + 1 :]) == seen for i in range(len(meant))):
            return 0.05  # one letter left out between two equal ones, which then read as one
        if d == 2 and min(len(seen), len(meant)) >= 9:
            return 0.002
    if len(seen) >= STUB and 2 <= len(meant) - len(seen) <= CLIPPED and meant.startswith(seen):
        return 0.01
    return 0.0


def same_organisation(a: str | None, b: str | None) -> bool:
    """Whether two names, seen side by side in one record, mean one organisation."""
    if a == b:
        return True
    x, y = parse(a), parse(b)
    if not x.core or not y.core:
        return bool(a and b) and fold(a or "") == fold(b or "") and fold(a or "") != ""
    return x.kind == y.kind and max(core_likelihood(x.core, y.core), core_likelihood(y.core, x.core)) >= 0.002


ORG_TYPE = T.StructType([T.StructField(x, T.StringType()) for x in Org._fields])


@F.pandas_udf(ORG_TYPE)
def parse_org(names: pd.Series) -> pd.DataFrame:
    """The parts of each name; a null or blank name has empty parts."""
    known = {n: parse(n) for n in names.dropna().unique()}
    rows = [known.get(n, EMPTY) if isinstance(n, str) else EMPTY for n in names]
    return pd.DataFrame(rows, columns=list(Org._fields))
