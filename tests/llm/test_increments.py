import pytest
from conftest import rows
from pyspark.sql import functions as F

from orgweave.llm import increments

_P = "record_id long, batch_no int, paper_id string, openalex_id string, arxiv_id string, doi string, title string, publication_year int, author_ids array<string>"
_A = "row_id long, batch_no int, arxiv_id string, openalex_id string, author_id string, author_display_name string, institution_name string"
T = "Robust token mixers for battery diagnosis with limited supervision"


def _tables(spark):
    papers = [
        (1, 0, None, "W1", None, None, T, 2020, ["A1", "A2"]), (2, 0, None, "W2", None, None, "Front matter", 2020, ["A9"]),
        (3, 1, None, None, None, None, T + " and beyond", 2020, [" A2", "A1 "]),
        (4, 1, None, None, "hep-th/9901001v2", None, "Alpha", 2000, []), (5, 2, None, None, "HEP-TH/9901001", None, "Beta", 2001, []),
        (6, 2, None, None, None, None, "Front mater", 2020, ["A9"]),
        (7, 2, None, None, None, None, "Front matter", 2021, ["A9"]), (8, 2, None, "w1", None, None, None, None, None),
        (9, 2, None, None, None, None, "Robust token mixers for battery diagn...", 2021, ["A1", "A2"]),
    ]
    affs = [(1, 0, "2001.00001", None, "A1", "N", "Plovara Motors"), (2, 1, "2001.00001v2", None, "A1", "N", "PLOVARA MTRS"),
        (3, 2, "2001.00001", None, "A1", "N", "Plovara University"), (4, 2, "2001.00001", None, "A1", "N", "Plovarra Motors Inc")]
    return spark.createDataFrame(papers, _P), spark.createDataFrame(affs, _A)


WANT = sorted([("ai_papers", 1, 3), ("ai_papers", 1, 8), ("ai_papers", 1, 9), ("ai_papers", 4, 5), ("ai_papers", 2, 6),
    ("arxiv_paper_institutions", 1, 2), ("arxiv_paper_institutions", 1, 4)], key=str)


def test_case_blanks_short_and_cut_titles(spark):
    assert rows(increments.repeated_rows(*_tables(spark))) == WANT


def test_a_later_call_goes_on_with_the_store(spark, tmp_path):
    papers, affs = _tables(spark)
    path = str(tmp_path / "store")
    upto = lambda df, b: df.filter(F.col("batch_no") <= b)
    store = increments.HashStore.open(spark, path, 1)
    increments.take(store, upto(papers, 1), upto(affs, 1))
    store.close()
    # the second call gets the new batch and, in place of the history's rows, what must not be read
    poison = lambda df, *cols: df.select(*[F.when(F.col("batch_no") < 2,
        F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    again = increments.HashStore.open(spark, path)
    late = poison(papers, "record_id", "title", "openalex_id", "arxiv_id"), poison(affs, "row_id", "arxiv_id", "institution_name")
    assert rows(increments.repeated_rows(*late, store=again)) == WANT
    keys = sum(c["keys"] for c in again.commits())
    # a retry finds every batch committed
    assert rows(increments.repeated_rows(*late, store=again)) == WANT and sum(c["keys"] for c in again.commits()) == keys and len(again.commits()) == 3
    again.close()


def test_a_failed_step_counts_for_nothing(spark, tmp_path, monkeypatch):
    papers, affs = _tables(spark)
    store = increments.HashStore.open(spark, str(tmp_path / "store"), 1)
    increments.take(store, papers.filter("batch_no = 0"), affs.filter("batch_no = 0"))
    with monkeypatch.context() as m:
        m.setattr(increments, "_links", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            increments.take(store, papers, affs)
    assert store.batches() == {0}
    assert rows(increments.repeated_rows(papers, affs, store)) == WANT
    store.close()


def test_buckets_grow_with_the_store(spark, tmp_path, monkeypatch):
    papers, affs = _tables(spark)
    monkeypatch.setattr(increments, "BUCKET_KEYS", 1)
    store = increments.HashStore.open(spark, str(tmp_path / "store"), 1)
    before = store.buckets
    for b in (0, 1, 2):
        increments.take(store, papers.filter(F.col("batch_no") <= b), affs.filter(F.col("batch_no") <= b))
    assert store.generation >= 1 and store.buckets > before
    store.close()
    other = increments.HashStore.open(spark, str(tmp_path / "store"))
    assert other.buckets == store.buckets and rows(increments.repeated_rows(papers, affs, other)) == WANT
    other.close()


def test_near_titles(spark):
    pairs = [
        ("towards robust song tagging with sparse memory networks", "toadrs robust song tagging wiht sparse memory netwroks", True),
        ("towards robust song tagging with sparse memory networks", "towards robust song tagging with sparse m", True),
        ("towards robust song tagging with sparse memory networks", "towards robust song tagging using sparse memory networks", True),
        ("learning sparse routing for fraud detection", "learning dense routing for fraud detection", False),
        ("a b c", "x y z", False), ("", "", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("want", increments._alike_words(F.col("a"), F.col("b")).alias("got"),
        increments._alike_words(F.col("b"), F.col("a")).alias("back")).collect()
    assert all(r["want"] == r["got"] == r["back"] for r in got)
