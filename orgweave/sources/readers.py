"""Tables from files and databases. Schemas are explicit or merged; nothing is read to the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, *paths: str, merge: bool = False) -> DataFrame:
    """One table from any number of files or folders; with ``merge`` the union of their columns."""
    return spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)


def head(df: DataFrame, n: int) -> DataFrame:
    """The first rows (the limit is the feature)."""
    return df.limit(n)


def page_by_offset(df: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    """S6, S18."""
    return df.orderBy(*order).offset(offset).limit(n)


def page_by_key(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next rows after a key: the filter reaches the scan, and only n rows are sorted out."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(n)


def _batch(key: str, batches: int) -> Column:
    """The batch of a key by the first digits of its MD5, which other engines can compute too."""
    return F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("long") % batches


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, columns, rows: columns from the schema without reading, rows by a count that reads no column."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "rows") for n,
        df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def id_batches(df: DataFrame, key: str, batches: int) -> DataFrame:
    """Distinct keys with the number of the batch they belong to, by a hash."""
    return df.select(key).distinct().withColumn("batch", _batch(key, batches))


def rows_of_batch(df: DataFrame, key: str, batches: int, batch: int) -> DataFrame:
    """The rows of one batch: its keys need no list."""
    return df.filter(_batch(key, batches) == batch)


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", corrupt: str | None = None) -> DataFrame:
    """A header; values that don't fit their type are null, short rows are filled with nulls, long ones cut; whole bad lines go
    to the column ``corrupt`` if it is named."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if schema is None:
        return r.option("inferSchema", True).csv(path)
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if corrupt:
        st, r = T.StructType([*st.fields, T.StructField(corrupt, T.StringType())]), r.option("columnNameOfCorruptRecord", corrupt)
    return r.schema(st).csv(path)


def zipped_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first member of each zip archive, tab separated, with a header; read in pieces by the executors, one archive per task."""
    st = T.StructType.fromDDL(schema)
    names = st.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    for part in pd.read_csv(f, sep="\t", quotechar='"', dtype=str, usecols=lambda c: c in names, chunksize=50_000, on_bad_lines="skip"):
                        yield part.reindex(columns=names).astype(object).where(part.reindex(columns=names).notna(), None)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per line, compressed or not; lines that can't be read are dropped."""
    r = spark.read.option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one array or object."""
    r = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """By the name of the file, and for JSON by its first character."""
    bare = path.lower().removesuffix(".gz")
    if bare.endswith((".parquet", ".pq")):
        return parquet(spark, path)
    if bare.endswith((".csv", ".tsv")):
        return csv(spark, path, sep="\t" if bare.endswith(".tsv") else ",")
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()  # one line
    return json_document(spark, path) if first and first[0][0].lstrip().startswith("[") else json_lines(spark, path)


def mapping(spark: SparkSession, path: str | None, defaults: list[tuple], schema: str) -> DataFrame:
    """A small table of rules from a file, or the defaults where there is none."""
    if path is not None:
        try:
            return csv(spark, path, schema)
        except Exception as e:  # only a missing path falls back
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame(defaults, schema)


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A query of a database, read in ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def catalog(spark: SparkSession) -> DataFrame:
    """Tables, columns and types known to the session."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All columns but these; those that aren't there don't matter."""
    return df.drop(*columns)


def optional(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select(*[c for c in wanted if c in df.columns])
