"""Languages of documents and of their segments: language-bitmask n-gram filters.

Model. A bounded sample of labelled documents gives each language a set of character n-grams (four letters; two of scripts without
spaces). The sample is then read by this first model, and the sets are made again from its segments, so that wrong labels and mixed
texts leave no trace. All sets share one bit-sliced Bloom filter: a table of 16-bit words, one bit per language; the AND of an n-gram's words is the
mask of all languages that contain it, so one look-up asks all languages at once. An n-gram belongs to a language if it is not much
rarer there than in any other, which keeps mislabelled, mixed and quoted training text out.

Decision. Per sentence and language the n-grams found are counted and corrected for the filter's false positives. The language found
most, by a clear margin, is the sentence's; neighbours of one language form a segment.

Every document is read whole. Only the model is fitted on a sample: TRAIN_DOCS labelled documents per language, chosen by a hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.shared import cut, spread

#: The languages told apart, in the order of their bits (16 at most), and the names and codes of each (fixed values).
LABELS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "ingles", "inglese", "engels"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "aleman", "tedesco", "duits"),
    "fr": ("fr", "fra", "fre", "french", "francais", "franzosisch", "frances", "francese", "frans"),
    "es": ("es", "spa", "spanish", "espanol", "espagnol", "spanisch", "castellano", "castilian", "spagnolo", "spaans"),
    "pt": ("pt", "por", "portuguese", "portugues", "portugais", "portugiesisch", "portoghese", "portugees"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch", "italiaans"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "neerlandais", "niederlandisch", "holandes", "olandese", "flemish", "vlaams"),
    "ru": ("ru", "rus", "russian", "russkij", "russkii", "русскии", "русский", "russe", "russisch", "ruso", "russo"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn", "zhongwen", "中文", "汉语", "漢語", "chinois", "chinesisch", "chino", "cinese"),
    "ja": ("ja", "jpn", "japanese", "nihongo", "日本語", "japonais", "japanisch", "japones", "giapponese"),
}
CODES = tuple(LABELS)
#: Labelled documents per language that the model is fitted on, and the size of the filter (a power of 2) and its hashes.
TRAIN_DOCS, FILTER_BITS, HASHES = 2000, 22, 3
#: An n-gram is a language's if it is in this share as many of its texts as in those of the language that has it most: by the labels
#: as given, and once the sample has been read by that first model.
RARER_BY_LABEL, RARER = 0.5, 0.25
#: What two letters of a script without spaces count against four letters of one with spaces: about as much text.
PAIR_WEIGHT = 3
#: A sentence is in another language than the rest of the text if that language has this share of its n-grams at least, leads by this, and
#: the lead is this sure for as many n-grams as there are: a few are enough if they are plain.
LEAST_SHARE, LEAST_LEAD, SURE = 0.5, 0.15, 0.999
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SENTENCE = re.compile(r".+?(?:([.!?…]+[\"”»’')\]]*(?=\s|$)|[。！？]+[\"”」』）]*)|\n+|$)", re.S)
#: A label and a colon before three or more items of a few words each: a list of keywords, no sentence.
_LIST = re.compile(r"\s*[^\W\d_][^:：,;，；、\n]{0,24}[:：]((?:[^,;，；、·]{1,60}[,;，；、·]){2,}[^,;，；、·]{1,60})$")
#: Web and mail addresses are in no language.
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[^\s@]+@[^\s@]+\.[^\s@]+")


def label_code(lang: Column) -> Column:
    """The code that a label names in any spelling, code or regional form; null for none of the ten."""
    bare = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    bare = F.translate(bare, "áàâãäçéèêëíìîïñóòôõöúùûüй", "aaaaaceeeeiiiinooooouuuuи")
    first = F.substring_index(F.substring_index(F.substring_index(bare, "-", 1), "_", 1), " ", 1)
    table = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in dict.fromkeys(names) for x in (n, code)])
    return table[first]


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Of each 16-bit code whether it is a letter or mark, 2 for the zero that parts pieces. Codes of two halves are none."""
    table = np.array([bool(re.match(r"[^\W\d_]", chr(c))) if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)], np.uint8)
    table[0] = 2
    return table


def letters(text: str) -> np.ndarray:
    """Codes of a text in lower case, runs of anything but letters and marks as one space; pieces between zero characters stay apart."""
    c = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    kind = _alphabet()[c]
    c = np.where(kind > 0, c, np.uint16(32))
    return c[(kind > 0) | np.r_[True, kind[:-1] > 0]]


def _bare(piece: str) -> str:
    """A piece without addresses and zero characters."""
    if "@" in piece or "//" in piece or "www." in piece:
        piece = _ADDRESS.sub(" ", piece)
    return piece.replace("\0", " ") if "\0" in piece else piece


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams as integers, index of the piece each comes from, its weight) of raw pieces."""
    c = letters("\0".join([f" {_bare(p)} " for p in pieces])).astype(np.uint64)
    at = np.cumsum(c == 0)
    if len(c) < 4:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
    wide = c >= 0x2E80
    four = (c[:-3] << 48) | (c[1:-2] << 32) | (c[2:-1] << 16) | c[3:]
    inside = (at[:-3] == at[3:]) & (c[:-3] != 0) & ~(wide[:-3] | wide[1:-2] | wide[2:-1] | wide[3:])
    two = (np.uint64(0xFFFF) << np.uint64(48)) | (c[:-1] << 16) | c[1:]
    pair = wide[:-1] & wide[1:] & (at[:-1] == at[1:])
    weight = np.r_[np.ones(inside.sum()), np.full(pair.sum(), float(PAIR_WEIGHT))]
    return np.concatenate([four[inside], two[pair]]), np.concatenate([at[:-3][inside], at[:-1][pair]]), weight


def _slots(g: np.ndarray) -> list[np.ndarray]:
    return [(g * m) >> np.uint64(64 - FILTER_BITS) for m in _MULTIPLIERS[:HASHES]]


class Filter:
    """A bit-sliced Bloom filter of the n-grams of all languages, and each language's rate of false positives."""

    def __init__(self, sets: dict[str, np.ndarray]):
        self.table = np.zeros(1 << FILTER_BITS, np.uint16)
        for bit, code in enumerate(CODES):
            for s in _slots(sets.get(code, np.empty(0, np.uint64)).astype(np.uint64)):
                self.table[s] |= np.uint16(1 << bit)
        filled = np.array([((self.table >> bit) & 1).mean() for bit in range(len(CODES))])
        self.false_rate = filled**HASHES

    def shares(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each piece, corrected share of them that each language contains)."""
        g, at, weight = grams(pieces)
        n = np.bincount(at, weights=weight, minlength=len(pieces))[: len(pieces)]
        mask = np.full(len(g), 0xFFFF, np.uint16)
        for s in _slots(g):
            mask &= self.table[s]
        out = np.zeros((len(pieces), len(CODES)))
        for bit in range(len(CODES)):
            hits = np.bincount(at, weights=((mask >> bit) & 1) * weight, minlength=len(pieces))[: len(pieces)]
            raw = hits / np.maximum(n, 1)
            out[:, bit] = np.clip((raw - self.false_rate[bit]) / max(1e-9, 1 - self.false_rate[bit]), 0, 1)
        return n, out


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the sentences of a text; a list of keywords, or a piece without an end, is not a whole one."""
    return [(m.start(), m.end(), m.start(1) >= 0 and not _is_list(m[0])) for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def _is_list(sentence: str) -> bool:
    m = _LIST.match(sentence)
    return m is not None and all(len(x.split()) <= 4 for x in re.split("[,;，；、·]", m[1]))


def confidence(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How sure the first language is: 0.5 for a draw, near 1 for a clear lead over many n-grams."""
    return 1 / (1 + np.exp(-np.minimum(50.0, np.sqrt(np.maximum(n, 0)) * (first - second) * 4)))


def _best_two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the greatest, the greatest, the second) of each row; the first of equals."""
    top = x.argmax(1)
    rest = x.copy()
    rest[np.arange(len(x)), top] = -1
    return top, x[np.arange(len(x)), top], rest.max(1)


def read_documents(texts: list[str], model: Filter) -> pd.DataFrame:
    """Segments (doc: place in ``texts``, lang_code, start, end, confidence, whole) in their order; none for a text without words.

    All sentences of all texts are decided at once, in arrays."""
    spans = [(d, *s) for d, t in enumerate(texts) for s in sentences(t)]
    empty = pd.DataFrame({"doc": [], "lang_code": [], "start": [], "end": [], "confidence": [], "whole": []})
    if not spans:
        return empty
    owner, start, end, whole = (np.array(x) for x in zip(*spans))
    n, share = model.shares([texts[d][a:b] for d, a, b, _ in spans])
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])  # the first sentence of each text
    size = np.diff(np.r_[first, len(owner)])
    total, all_n = np.add.reduceat(n[:, None] * share, first), np.add.reduceat(n, first)
    main, most, other = _best_two(total)
    has_words = (all_n >= 3) & (most > 0)
    of = np.repeat(np.arange(len(first)), size)
    every = np.arange(len(owner))
    best, top, second = _best_two(share)
    mine = share[every, main[of]]
    told = (best != main[of]) & (top >= LEAST_SHARE) & (top - mine >= LEAST_LEAD) & (confidence(n, top, mine) >= SURE)
    pick = np.where(told, best, main[of])
    rest = np.where(best == pick, second, top)
    sure = np.where(n > 0, confidence(n, share[every, pick], rest), 0.5)
    # sentences that can't be told go with their neighbour before
    weak = ~told & (sure < SURE)
    weak[first] = False
    lang = pick[np.maximum.accumulate(np.where(weak, 0, every))]
    whole = whole & (lang == pick)
    # a text of nothing but pieces is one of its main language
    bare = ~np.logical_or.reduceat(whole & (n > 0), first)
    lang, whole = np.where(bare[of], main[of], lang), whole & (n > 0) | bare[of]
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])])
    weight = np.add.reduceat(n, at)
    mean = np.add.reduceat(sure * n, at) / np.maximum(weight, 1e-9)
    flat = confidence(all_n, most / np.maximum(all_n, 1e-9), other / np.maximum(all_n, 1e-9))
    mean = np.where(bare[of[at]], flat[of[at]], np.where(weight > 0, mean, 0.5))
    last = np.r_[at[1:], len(owner)] - 1
    out = pd.DataFrame({"doc": owner[at], "lang_code": np.array(CODES)[lang[at]], "start": start[at], "end": end[last], "confidence": mean,
        "whole": np.logical_or.reduceat(whole, at)})
    return out[has_words[of[at]]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filter:
    """The filter of the languages of a table with (partly wrong) labels.

    The sample is bounded: about TRAIN_DOCS documents per label, by a hash of the key; the driver receives the n-grams of these, of which
    those of one text only say nothing.
    """
    labelled = docs.select(F.col(text).alias("text"), label_code(F.col(lang)).alias("code"),
        F.xxhash64(key).alias("h")).filter("code is not null and text is not null")
    sizes = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}
    if not sizes:
        return Filter({})
    part = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, TRAIN_DOCS / n))])
    sample = cut(labelled.filter(F.pmod("h", F.lit(1_000_003)) < part[F.col("code")] * 1_000_003))
    first = _fit_texts(sample.select("code", "text"), RARER_BY_LABEL)
    read = segments(sample.select(F.col("h").alias("doc_id"), "text", F.col("code").alias("lang")), first, keep_text=True).filter("confidence >= 0.9")
    return _fit_texts(cut(read.select(F.col("lang_code").alias("code"), "text")), RARER)


def _fit_texts(texts: DataFrame, rarer: float) -> Filter:
    """The filter of (code, text): n-grams counted in each text once."""
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("df", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for code, part_ in pdf.groupby("code"):
                g, at, _ = grams(list(part_["text"]))
                _, once = np.unique((g ^ (at.astype(np.uint64) * _MULTIPLIERS[1])) * _MULTIPLIERS[0], return_index=True)  # an n-gram and its text as one number
                values, df = np.unique(g[once], return_counts=True)
                rows.append(pd.DataFrame({"code": code, "gram": values.view(np.int64), "df": df}))
            if rows:
                yield pd.concat(rows)

    counts = texts.mapInPandas(count, schema).groupBy("code", "gram").agg(F.sum("df").alias("df"))
    n = {r["code"]: float(r["count"]) for r in texts.groupBy("code").count().collect()}
    if not n:
        return Filter({})
    rate = F.col("df") / F.create_map(*[F.lit(x) for c, k in n.items() for x in (c, k)])[F.col("code")]
    rated = cut(counts.withColumn("rate", rate))
    top = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rated.join(top, "gram").filter((F.col("rate") >= rarer * F.col("most")) & (F.col("df") > 1))
    got = kept.select("code", "gram").toPandas()
    return Filter({c: g["gram"].to_numpy(np.int64).view(np.uint64) for c, g in got.groupby("code")})


_SEGMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("segment_no", T.LongType()),
    T.StructField("lang_code", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("whole", T.BooleanType()), T.StructField("text", T.StringType()),
])
#: Characters that are read at once.
_CHUNK = 1_000_000


def segments(docs: DataFrame, model: Filter, key: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """doc_id, label (code that the document's label names), segment_no, lang_code, confidence, start, end, whole, text (or null).

    ``whole`` says that the segment has a whole sentence. Null, empty and wordless texts have no segments; rows without a key are left out.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.table, model.false_rate))  # 8 MB, whatever the size of the tables

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = Filter.__new__(Filter)
        local.table, local.false_rate = shipped.value
        for pdf in batches:
            ends = np.cumsum(pdf["text"].str.len().to_numpy()) // _CHUNK
            for _, part in pdf.groupby(ends):
                texts = part["text"].tolist()
                segs = read_documents(texts, local)
                at = segs["doc"].to_numpy(int)
                made = pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[at], "label": part["label"].to_numpy()[at],
                    "segment_no": segs.groupby("doc").cumcount().to_numpy() + 1, "lang_code": segs["lang_code"].to_numpy(),
                    "confidence": segs["confidence"].to_numpy(float), "start": segs["start"].to_numpy(int),
                    "end": segs["end"].to_numpy(int), "whole": segs["whole"].to_numpy(bool),
                })
                made["text"] = [texts[d][a:b] for d, a, b in zip(at, made["start"], made["end"])] if keep_text else None
                yield made[_SEGMENTS.names]

    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"), label_code(F.col(lang)).alias("label"))
    return spread(rows).mapInPandas(run, _SEGMENTS)


def document_languages(segs: DataFrame) -> DataFrame:
    """doc_id, label, lang_code, confidence, languages: one row per language of which the document has a whole sentence."""
    per = segs.filter("whole").groupBy("doc_id", "label", "lang_code").agg((F.sum(F.col("confidence") * (F.col("end") - F.col("start"))) / F
        .sum(F.col("end") - F.col("start"))).alias("confidence"))
    n = per.groupBy("doc_id").agg(F.count("*").alias("languages"))
    return per.join(n, "doc_id")


def wrong_labels(segs: DataFrame) -> DataFrame:
    """The languages of documents that are mixed or whose label is missing or wrong."""
    return document_languages(segs).filter((F.col("languages") > 1) | F.col("label").isNull()
        | (F.col("label") != F.col("lang_code"))).select("doc_id", "lang_code", "confidence")
