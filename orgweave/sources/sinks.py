"""What is written, and how it can be taken up again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.operators.dedup import keep_best, union_all


def parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """K1, K2: snappy, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """K3."""
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    """K4: a one-row table as one JSON file at a local path."""
    row = df.limit(1).collect()
    with open(path, "w") as f:
        json.dump(row[0].asDict(recursive=True) if row else {}, f, indent=2, default=str)


def append_unique(spark: SparkSession, new: DataFrame, path: str, target: str, key: str) -> DataFrame:
    """K5: what is at ``path`` (if anything) and the new rows, cast to its types, one row per key, the older first; written to ``target``."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    rows = new.withColumn("_age", F.lit(1))
    if old is not None:
        types = dict(old.dtypes)
        rows = union_all(old.withColumn("_age", F.lit(0)), rows
            .select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns]))
    keep_best(rows, [key], F.col("_age")).drop("_age").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def resumable(spark: SparkSession, batches: list, path: str, make, column: str = "batch") -> list:
    """K6: make(batch) written to its own folder; batches whose folder is complete are skipped. Returns those done now."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = []
    for b in batches:
        folder = f"{path}/{column}={b}"
        mark = hadoop(f"{folder}/_SUCCESS")
        if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            continue
        make(b).write.mode("overwrite").parquet(folder)
        done.append(b)
    return done


def latex_table(df: DataFrame, caption: str, most: int = 1000) -> str:
    """K7: a booktabs table of a small result; numbers with thousands separators, two digits for fractions. A table of more than ``most``
    rows is no table for print: it is refused, never cut."""

    def cell(x) -> str:
        if x is None:
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{x:,}"
        if isinstance(x, float):
            return f"{x:,.2f}"
        return str(x).replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(cell(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}[htbp]", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}",
        r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
