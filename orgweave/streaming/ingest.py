"""Incremental forms of batch operators, as extensions: the rules they follow have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_arrivals(stream: DataFrame, key: str, ts: str, late: str, forget: bool = False) -> DataFrame:
    """K5 on a stream: the first row of each key to arrive, whatever its time. Rows with a null key are one group.

    Every key is remembered, so none is lost or comes twice, in whatever order files arrive; the state grows with the distinct keys, and
    ``append_first`` keeps it in the target instead. Only with ``forget`` is the state bounded by a watermark of ``late`` behind the
    greatest ``ts``: then rows that are later than that are dropped, also first ones, and a key that comes again later still is a new one.
    """
    if forget:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append_first(stream: DataFrame, key: str, ts: str, target: str, checkpoint: str) -> None:
    """K5 on a stream, with the target as its state: each micro-batch adds its rows of keys that the target lacks, then the run stops.

    Of rows of one batch the one of least ``ts`` (ties: by all columns) is first; null keys are one group. A batch is a folder of the
    target, written as a whole: one that is repeated after a failure replaces itself.
    """

    def add(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        order = Window.partitionBy(key).orderBy(F.asc_nulls_last(ts), *[F.col(c).cast("string") for c in batch.columns if c not in (key, ts)])
        first = batch.withColumn("_no", F.row_number().over(order)).filter("_no = 1").drop("_no")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            kept = batch.schema.add("_batch", "long")
            known = spark.read.schema(kept).option("basePath", target).parquet(target).filter(F.col("_batch") < no).select(F.col(key).alias("_key")).distinct()
            first = first.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/_batch={no}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def period_counts(stream: DataFrame, ts: str, period: str, late: str) -> DataFrame:
    """G29 on a stream: rows per period, final once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts,
        period).alias("w")).agg(F.count("*").alias("records")).select(F.col("w.start").alias("period_start"), "records")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; a later call goes on where this one ended (K6)."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation",
        checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
