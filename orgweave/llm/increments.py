"""Deduplicating new batches against all history.

Every record has a few keys, each a 64-bit hash: *whole* keys (a normalised identifier, or all of its normalised content), any of which
proves a copy, and *part* keys (paragraph hashes: the pieces of its content), of which enough must be shared, and the texts agree, to
prove a near-copy. Accepted keys are kept in a ``HashStore``, a table bucketed by key in a folder that outlives the session. Only records
of batches that the store doesn't have yet are hashed; their keys meet the table bucket by bucket (the history is read where it lies and
never shuffled), and are appended to it. Neither the records of the history nor their hashes are made again.

Key rows are narrow: a hash stands for the text of a part key. The texts of records with pieces lie once, in a second table bucketed by
record, and are read only for pairs that share enough pieces.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.llm.components import roots
from orgweave.llm.orgnames import parse
from orgweave.shared import cut, remove, work_path

#: Least share of its pieces that a near-copy shares with the shorter of the two texts: two typing errors leave a third of six pieces.
COVERAGE = 0.3
#: Letters from which on a word carries a title, and the prepositions and pronouns among these, which carry none.
LONG = 4
_FUNCTION_WORDS = (
    "with using from into onto over under upon than that this these those their them they there then when where which while whose will "
    "would could should have been being were does done each both such some more most much many very also only even just about above across after "
    "against along among around before behind below beneath beside between beyond during except inside near outside since through throughout "
    "toward towards until versus via within without"
).split()
#: Words that carry something up to which a title (a preface, front matter) proves nothing without its year.
FEW = 3
#: Keys per bucket that one task should hold.
BUCKET_KEYS = 400_000
#: Kinds of keys: whole; a piece of a title; the organisation of a row; a title of few words.
WHOLE, PIECE, ORG, SHORT = 0, 1, 2, 3
#: A hashed record: table, record, batch, the text of its part keys, and its keys.
RECORD = "tab string, id bigint, batch bigint, text string, keys array<struct<kind:int,key:bigint,pieces:int>>"
_KEYS = "tab string, kind int, key bigint, th bigint, text string, pieces int, owner bigint, copies bigint"


class HashStore:
    """All accepted keys, partitioned by step and bucketed by key: tab, kind, key, th (hash of the text), text (of ORG and SHORT keys),
    pieces, owner (the first record of its step that brought this key and text), copies (how many did); the texts of records with pieces;
    and the links that each step found.

    A step is written to a folder of its own and counts from its commit on, a file that names the step and its batches. A step that
    failed is never read; a batch that is committed is never taken again, so a retry changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, generation: int):
        self.spark, self.path, self.buckets, self.generation = spark, path, buckets, generation
        self._tables()

    @classmethod
    def open(cls, spark: SparkSession, path: str, expected_keys: int = 0) -> HashStore:
        """The store at a path that all executors share; a new one where there is none, with buckets for ``expected_keys``."""
        fs, p = cls._fs(spark, path)
        if fs.exists(p(f"{path}/store.json")):
            at = json.loads(cls._read(spark, f"{path}/store.json"))
            return cls(spark, path, at["buckets"], at["generation"])
        buckets = max(spark.sparkContext.defaultParallelism, 2 ** math.ceil(math.log2(max(1, expected_keys / BUCKET_KEYS))))
        cls._write(spark, f"{path}/store.json", json.dumps({"buckets": buckets, "generation": 0}))
        return cls(spark, path, buckets, 0)

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    @classmethod
    def _read(cls, spark: SparkSession, path: str) -> str:
        return spark.read.option("wholetext", True).text(path).first()[0]

    @classmethod
    def _write(cls, spark: SparkSession, path: str, text: str) -> None:
        """A small file, there as a whole or not at all."""
        fs, p = cls._fs(spark, path)
        draft = p(f"{path}.{uuid.uuid4().hex[:8]}.draft")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p(path), False)
        fs.rename(draft, p(path))

    def _tables(self) -> None:
        tag = f"{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{self.generation}"
        self.keys_name, self.texts_name = f"orgweave_keys_{tag}", f"orgweave_texts_{tag}"
        for name, columns, by in ((self.keys_name, _KEYS, "key"), (self.texts_name, "tab string, id bigint, text string", "id")):
            if not self.spark.catalog.tableExists(name):
                place = f"{self.path}/{name.split('_')[1]}_{self.generation}"
                fs, p = self._fs(self.spark, place)
                fs.mkdirs(p(place))
                ddl = ", ".join(f"`{f.split()[0]}` {f.split()[1]}" for f in columns.split(", "))
                self.spark.sql(f"CREATE TABLE {name} ({ddl}, `step` string) USING parquet PARTITIONED BY (`step`) CLUSTERED BY (`{by}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def commits(self) -> list[dict]:
        """{step, batches, keys} of every step that counts, in their order."""
        fs, p = self._fs(self.spark, self.path)
        folder = p(f"{self.path}/commits")
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
        return [json.loads(self._read(self.spark, f"{self.path}/commits/{n}")) for n in names if n.endswith(".json")]

    def batches(self) -> set[int]:
        return {b for c in self.commits() for b in c["batches"]}

    def rows(self, steps: list[str]) -> DataFrame:
        return self.spark.table(self.keys_name).filter(F.col("step").isin(steps))

    def texts(self, steps: list[str]) -> DataFrame:
        return self.spark.table(self.texts_name).filter(F.col("step").isin(steps))

    def links(self) -> DataFrame:
        """tab, node, owner of all steps."""
        paths = [f"{self.path}/links/{c['step']}" for c in self.commits()]
        return self.spark.read.schema("tab string, node bigint, owner bigint").parquet(*paths) if paths else self.spark.createDataFrame([],
            "tab string, node bigint, owner bigint")

    def _append(self, name: str, rows: DataFrame, step: str, by: str) -> None:
        columns = [c for c in self.spark.table(name).columns if c != "step"]
        out = rows.select(columns).withColumn("step", F.lit(step)).repartition(self.buckets, by)  # each task writes one bucket
        out.write.mode("append").insertInto(name)

    def accept(self, records: DataFrame, batches: list[int]) -> None:
        """Link the hashed records (RECORD) of these batches with each other and the history, write the links, append the keys, commit.
        Batches that are committed are left out."""
        done, earlier = self.batches(), [c["step"] for c in self.commits()]
        batches = sorted(set(batches) - done)
        if not batches:
            return
        step = f"{len(earlier):08d}-{uuid.uuid4().hex[:12]}"
        records = records.filter(F.col("batch").isin(batches))
        keys = records.select("tab", "id", "text", F.explode("keys").alias("k")).select("tab", "id", "k.kind", "k.key", "k.pieces",
            F.when(F.col("k.kind") > WHOLE, F.col("text")).alias("text"))
        keys = keys.withColumn("th", F.when(F.col("kind") > WHOLE, F.xxhash64("text")).otherwise(0)).withColumn("text",
            F.when(F.col("kind") > PIECE, F.col("text")))
        # one row per key and text, before they are shuffled
        reduced = keys.groupBy("tab", "kind", "key", "th", "text", "pieces").agg(F.min("id").alias("owner"), F.count("*").alias("copies"))
        self._append(self.keys_name, reduced, step, "key")
        self._append(self.texts_name, records.filter(F.exists("keys", lambda k: k["kind"] == PIECE)), step, "id")
        _links(self, keys, step, earlier).write.mode("overwrite").parquet(f"{self.path}/links/{step}")
        n = self.rows([step]).count()
        self._write(self.spark, f"{self.path}/commits/{step}.json", json.dumps({"step": step, "batches": batches, "keys": n}))
        self._grow()

    def _grow(self) -> None:
        """More buckets once they hold more than four times BUCKET_KEYS: the history is rewritten into a new generation, which happens
        each time it has grown fourfold, so that every key is rewritten a bounded number of times."""
        commits = self.commits()
        total = sum(c["keys"] for c in commits)
        if total <= 4 * BUCKET_KEYS * self.buckets:
            return
        steps, keys, texts = [c["step"] for c in commits], self.keys_name, self.texts_name
        self.generation, self.buckets = self.generation + 1, self.buckets * 4
        self._tables()
        for old, new, by in ((keys, self.keys_name, "key"), (texts, self.texts_name, "id")):
            rows = self.spark.table(old).filter(F.col("step").isin(steps))
            rows.repartition(self.buckets, by).sortWithinPartitions("step").write.mode("append").insertInto(new)
        self._write(self.spark, f"{self.path}/store.json", json.dumps({"buckets": self.buckets, "generation": self.generation}))

    def close(self) -> None:
        """Forget the tables in this session; the folder stays."""
        for name in (self.keys_name, self.texts_name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _carries(w: Column) -> Column:
    """Whether a word carries a title."""
    return ((F.length(w) >= LONG) | w.rlike(r"\d")) & ~w.isin(_FUNCTION_WORDS)


def _alike_words(a: Column, b: Column) -> Column:
    """Whether two titles are the same but for typing errors, words that carry nothing, and an end that was cut off.

    Either word by word: at most one word in three differs, by typing errors (up to two edits) or because both carry nothing, where the
    longer title may go on after the shorter, and a last word be cut. Or, if their numbers of words that carry something differ by one at
    most, each such word that only one of them has is a misspelling of a word that only the other has, one at most in three.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    n, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    odd = F.filter(F.arrays_zip(F.slice(x, 1, n).alias("p"), F.slice(y, 1, n).alias("q")), lambda w: w["p"] != w["q"])
    ends = lambda p, q: (F.left(p, F.lit(1)) == F.left(q, F.lit(1))) & (F.right(p, F.lit(1)) == F.right(q, F.lit(1))) & (F.length(p) >= 6)
    typo = lambda p, q: (F.levenshtein(p, q, 2) >= 0) | ends(p, q) & (F.levenshtein(p, q, 3) >= 0)  # noqa: E731  a swap counts two
    last = lambda p, q: (p == F.element_at(x, -1)) & (F.size(x) <= F.size(y)) | (q == F.element_at(y, -1)) & (F.size(y) <= F.size(x))
    begun = lambda p, q: (F.startswith(p, q) | F.startswith(q, p)) & ((F.least(F.length(p), F.length(q)) > 1) | last(p, q))
    close = lambda p, q: typo(p, q) | begun(p, q) | ~_carries(p) & ~_carries(q)
    in_order = (n >= 3) & (n >= 0.5 * most) & (F.size(odd) <= F.greatest(F.lit(1), F.ceil(n * 0.35))) & F.forall(odd, lambda w: close(w["p"], w["q"]))
    cx, cy = F.filter(x, _carries), F.filter(y, _carries)
    only_x, only_y = F.array_except(cx, y), F.array_except(cy, x)
    few = F.least(F.size(cx), F.size(cy))
    covered = lambda p, other: F.forall(p, lambda w: (F.length(w) <= LONG) | F.exists(other, lambda v: typo(w, v)))
    lone_x, lone_y = F.array_except(x, y), F.array_except(y, x)
    any_order = (F.abs(F.size(cx) - F.size(cy)) <= 1) & (few >= 3) & (F.greatest(F.size(only_x),
        F.size(only_y)) <= F.ceil(few * 0.35)) & covered(only_x, lone_y) & covered(only_y, lone_x)
    return in_order | any_order


def _same_org(a: Column, b: Column) -> Column:
    """Whether two texts kind|core mean one organisation: one kind, cores at most two typing errors apart or one clipped."""
    ka, kb = F.substring_index(a, "|", 1), F.substring_index(b, "|", 1)
    ca, cb = F.substring_index(a, "|", -1), F.substring_index(b, "|", -1)
    short, long = F.least(F.length(ca), F.length(cb)), F.greatest(F.length(ca), F.length(cb))
    clipped = (short >= 5) & (long - short <= 4) & (F.startswith(ca, cb) | F.startswith(cb, ca))
    return (ka == kb) & (short >= 4) & ((F.levenshtein(ca, cb, 2) >= 0) | clipped)


def _same_short(a: Column, b: Column) -> Column:
    """Whether two titles of few words are the same but for typing errors: two letters, or one for each eight if that is less."""
    most = F.least(F.lit(2), (F.least(F.length(a), F.length(b)) / 8).cast("int"))
    d = F.levenshtein(a, b, 2)
    return (d >= 0) & (d <= most)


def _links(store: HashStore, keys: DataFrame, step: str, earlier: list[str]) -> DataFrame:
    """tab, node, owner: links of the records of a step (``keys`` as exploded, and as appended to the store) with each other and with earlier steps.

    Both sides of the join lie in buckets of the key. It brings back the owner of what it meets, which a semi-join alone would not.
    """
    new = store.rows([step])
    # copies of one key and text within the step follow the first of them; written, so that a hot key is split by the join
    several = cut(new.filter((F.col("copies") > 1) & (F.col("kind") != PIECE)).select("key", "th", F.col("owner").alias("first")))
    within = keys.filter(F.col("kind") != PIECE).select("tab", "id", "key", "th").join(several.hint("merge"),
        ["key", "th"]).filter("id <> first").select("tab", F.col("id").alias("node"), F.col("first").alias("owner"))
    x = new.select("tab", "kind", "key", F.col("th").alias("th_a"), F.col("text").alias("text_a"), F.col("pieces").alias("n_a"), F.col("owner").alias("a"))
    y = store.rows([*earlier, step]).select("key", F.col("th").alias("th_b"), F.col("text").alias("text_b"), F.col("pieces").alias("n_b"),
        F.col("owner").alias("b"), (F.col("step") == step).alias("mine"))
    differs = F.col("th_a") != F.col("th_b")
    mine = (F.col("kind") != WHOLE) & (F.col("th_a") < F.col("th_b"))
    met = x.hint("shuffle_hash").join(y, "key").filter(F.when(F.col("mine"), mine).otherwise((F.col("kind") != PIECE) | differs))
    met = cut(met.select("tab", "kind", "a", "b", "th_a", "th_b", "text_a", "text_b", "n_a", "n_b"))
    alike = F.when(F.col("kind") == WHOLE, True).when(~differs, True).when(F.col("kind") == ORG,
        _same_org(F.col("text_a"), F.col("text_b"))).otherwise(_same_short(F.col("text_a"), F.col("text_b")))
    told = met.filter((F.col("kind") != PIECE) & alike).select("tab", "a", "b")
    counted = met.filter(F.col("kind") == PIECE).groupBy("tab", "a", "b", "n_a",
        "n_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= COVERAGE * F.least("n_a", "n_b"))
    texts = store.texts([*earlier, step]).select("tab", "id", "text")
    named = lambda df, c: df.hint("shuffle_hash").join(texts.select("tab", F.col("id").alias(c), F.col("text").alias(f"text_{c}")), ["tab", c])
    near = named(named(counted.select("tab", "a", "b"), "a"), "b").filter(_alike_words(F.col("text_a"), F.col("text_b"))).select("tab", "a", "b")
    across = told.unionByName(near).select("tab", F.greatest("a", "b").alias("node"), F.least("a", "b").alias("owner")).filter("node <> owner")
    return within.unionByName(across).distinct()


def groups(links: DataFrame) -> DataFrame:
    """links(tab, node, owner) -> tab, node, root: each record that repeats an earlier one, and the first record of its group."""
    tagged = F.struct("tab", F.col("node").alias("id")), F.struct("tab", F.col("owner").alias("id"))
    found = roots(links.select(tagged[0].alias("node"), tagged[1].alias("owner")))
    return found.select("node.tab", F.col("node.id").alias("node"), F.col("root.id").alias("root"))


# -- keys of the two tables ---------------------------------------------------------------------------------------------------------


def work_number(c: Column) -> Column:
    """The digits of a work identifier, empty if there is none. Null and empty are one here: an empty key is no key."""
    return F.coalesce(F.regexp_extract(c, r"[Ww](\d+)", 1), F.lit(""))


def arxiv_number(c: Column) -> Column:
    """The identifier without prefix and version, of either form and in any case."""
    return F.coalesce(F.regexp_extract(F.lower(c), r"(\d{4}\.\d{4,5}|[a-z][a-z-]+(?:\.[a-z]{2})?/\d{7})", 1), F.lit(""))


def doi_name(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(c, r"(10\.\d{3,9}/\S+?)[.,;\s]*$", 1)), F.lit(""))


_MARK = r"(?i)^\W*(correction|corrigendum|erratum|errata|addendum|retraction|retracted|comments? on|reply|response|rejoinder|supplement|discussion)\b|\b(part|volume|chapter) ([ivx]+|\d+)\b|\b(supplementary material|a comment|a reply|erratum|corrigendum)\W*$"


def title_text(title: Column) -> Column:
    """Words of a title: lower case, no mark-up, no note of its version; the last word of a title that was cut off is left out."""
    t = F.lower(title)
    t = F.regexp_replace(F.regexp_replace(t, "&amp;|&", " and "), r"<[^>]*>|&[a-z]+;", " ")
    t = F.regexp_replace(t, r"[\[(]\s*(preprint|extended version|extended abstract|accepted manuscript|working paper|draft|v\d+)\s*[\])]", " ")
    t = F.regexp_replace(t, r"\S+(\.\.\.|…)\s*$", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def paper_keys(papers: DataFrame, batch: Column) -> DataFrame:
    """RECORD rows of ai_papers. Whole: each identifier, and the content words of the title (of LONG letters or more, or with a digit) with the
    authors and the kind of work. Parts: each two neighbouring content words of the title, with the authors and the kind of work, so that
    a title alone proves nothing. The kind tells corrections, comments and parts apart. A title of FEW content words is no content of its
    own: all of its words and the year take part, and its part key is the authors with the year."""
    # each step only names what the next ones use more than once: nothing is computed twice
    raw = papers.filter(F.col("record_id").isNotNull()).select(
        batch.alias("batch"), F.col("record_id").cast("long").alias("id"), F.regexp_extract_all(F.col("title"), F.lit(_MARK), 0).alias("marks"),
        F.coalesce(title_text(F.col("title")), F.lit("")).alias("title"),
        F.transform(F.coalesce("author_ids", F.array().cast("array<string>")), lambda a: F.trim(a)).alias("author_ids"),
        work_number(F.col("openalex_id")).alias("work_a"), work_number(F.col("paper_id")).alias("work_b"),
        arxiv_number(F.col("arxiv_id")).alias("arxiv"), doi_name(F.col("doi")).alias("doi"),
        F.coalesce(F.col("publication_year").cast("string"), F.lit("")).alias("year"),
    )
    kept = F.array_sort(F.filter("author_ids", lambda a: a.isNotNull() & (a != "")))
    mark = F.coalesce(F.array_join(F.transform("marks", lambda m: F.trim(F.regexp_replace(F.lower(m), r"[^a-z0-9 ]", ""))), " "), F.lit(""))
    read = raw.select("batch", "id", "title", "arxiv", "doi", "year",
        F.when(F.col("work_a") != "", F.col("work_a")).otherwise(F.col("work_b")).alias("work"),
        F.xxhash64(mark, F.array_join(kept, " ")).alias("by"), (F.size(kept) > 0).alias("signed"), F.split("title", " ").alias("all"))
    read = read.withColumn("words", F.filter("all", _carries))
    read = read.withColumn("few", F.size("words") <= FEW)
    says = F.when(F.col("few"), F.concat_ws("|", "title", "year")).otherwise(F.array_join("words", " "))
    key = lambda kind, k, pieces: F.struct(F.lit(kind).alias("kind"), k.alias("key"), pieces.cast("int").alias("pieces"))
    alone = lambda test, kind, k: F.when(test, key(kind, k, F.lit(1)))
    content = F.col("signed") & (F.col("title") != "")
    single = F.filter(F.array(
        alone(F.col("work") != "", WHOLE, F.xxhash64(F.lit("work"), "work")),
        alone(F.col("arxiv") != "", WHOLE, F.xxhash64(F.lit("arxiv"), "arxiv")), alone(F.col("doi") != "", WHOLE, F.xxhash64(F.lit("doi"), "doi")),
        alone(content, WHOLE, F.xxhash64(F.lit("paper"), F.col("by"), says)),
        alone(content & F.col("few"), SHORT, F.xxhash64(F.lit("short"), F.col("by"), F.col("year"))),
    ), lambda x: x.isNotNull())
    n = F.size("words") - 1
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1),
        lambda i: F.xxhash64(F.lit("piece"), F.col("by"), F.get("words", i), F.get("words", i + 1))))
    parts = F.when(content & ~F.col("few"), F.transform(hashes, lambda h: key(PIECE, h, n)))
    none = F.array().cast("array<struct<kind:int,key:bigint,pieces:int>>")
    return read.select(F.lit("ai_papers").alias("tab"), "id", "batch", F.col("title").alias("text"), F.concat(single, F.coalesce(parts, none)).alias("keys"))


@F.pandas_udf(T.StringType())
def org_text(names: pd.Series) -> pd.Series:
    """kind|core of a name; of one without any identifying word its plain words; empty for null or blank."""

    def text(name: str) -> str:
        org = parse(name)
        return f"{org.kind}|{org.core}" if org.core else " ".join(re.findall(r"[^\W_]+", name.lower()))

    known = {n: text(n) for n in names.dropna().unique()}
    return names.map(known).fillna("")


def affiliation_keys(rows: DataFrame, batch: Column) -> DataFrame:
    """RECORD rows of arxiv_paper_institutions. A row with an organisation has one part, its paper and author, and the organisation as read is
    the text that must agree but for its spelling; a row without any has one whole key. Rows without paper or author have no keys and repeat nothing."""
    raw = rows.filter(F.col("row_id").isNotNull()).select(
        batch.alias("batch"), F.col("row_id").cast("long").alias("id"), arxiv_number(F.col("arxiv_id")).alias("arxiv"),
        work_number(F.col("openalex_id")).alias("work"),
        F.coalesce(F.regexp_extract("author_id", r"[Aa](\d+)", 1), F.lit("")).alias("author_no"),
        F.coalesce(F.lower(F.trim("author_display_name")), F.lit("")).alias("author_name"),
        F.col("institution_name").alias("name"),
    )
    paper = F.when(F.col("arxiv") != "", F.concat(F.lit("a"), "arxiv")).when(F.col("work") != "", F.concat(F.lit("w"), "work"))
    author = F.when(F.col("author_no") != "", F.col("author_no")).when(F.col("author_name") != "", F.col("author_name"))
    base = raw.select("batch", "id", paper.alias("paper"), author.alias("author"), "name").filter("paper is not null and author is not null")
    named = base.select("batch", "id", "paper", "author", org_text("name").alias("text"))
    whole = ~F.col("text").contains("|")  # none, or no more than a few plain words
    key = F.when(whole, F.xxhash64(F.lit("row"), "paper", "author", "text")).otherwise(F.xxhash64(F.lit("pair"), "paper", "author"))
    keys = F.array(F.struct(F.when(whole, WHOLE).otherwise(ORG).alias("kind"), key.alias("key"), F.lit(1).alias("pieces")))
    return named.select(F.lit("arxiv_paper_institutions").alias("tab"), "id", "batch",
        F.when(whole, "").otherwise(F.col("text")).alias("text"), keys.alias("keys"))


def take(store: HashStore, papers: DataFrame, rows: DataFrame) -> None:
    """Accept every batch of the two tables that the store doesn't have. A null batch counts as history (0).

    Only rows of these batches are hashed. An empty store takes the first batch, the history, by itself; whatever else waits is taken in
    one step, so that the history is read once per call, however many batches have come since the last one."""
    spark = papers.sparkSession
    batch = F.coalesce(F.col("batch_no"), F.lit(0)).cast("long")
    found = papers.select(batch.alias("b")).unionByName(rows.select(batch.alias("b"))).groupBy("b").count().collect()  # one row per batch
    waiting = sorted({r["b"] for r in found} - store.batches())
    if not waiting:
        return
    hashed = work_path(spark, "hashed")
    try:
        new = batch.isin(waiting)
        paper_keys(papers.filter(new), batch).unionByName(affiliation_keys(rows.filter(new), batch)).write.parquet(hashed)
        records = spark.read.schema(RECORD).parquet(hashed)
        first = [] if store.batches() else waiting[:1]
        for step in (first, waiting[len(first):]):
            store.accept(records, step)
    finally:
        remove(spark, hashed)


def repeated_rows(papers: DataFrame, rows: DataFrame, store: HashStore | None = None) -> DataFrame:
    """tab_name, id_a, id_b: each record that repeats id_a, the first of its group, over all batches that the store has by now.

    Without a store one is made for this call and removed."""
    spark = papers.sparkSession
    if store is None:
        path = work_path(spark, "store")
        n = papers.select(F.lit(1)).unionAll(rows.select(F.lit(1))).count()
        store = HashStore.open(spark, path, 5 * n)
        try:
            take(store, papers, rows)
            links = cut(store.links())
        finally:
            store.close()
            remove(spark, path)
    else:
        take(store, papers, rows)
        links = store.links()
    return groups(links).select(F.col("tab").alias("tab_name"), F.col("root").alias("id_a"), F.col("node").alias("id_b"))
