import itertools
import os
import time

import pytest
from pyspark.sql import functions as F

from orgweave.streaming import ingest

ROWS = {"2": (2, "2024-01-02 00:00:00"), "2b": (2, "2024-01-03 00:00:00"), "1": (1, "2024-01-01 00:00:00")}


def _files(spark, src, order):
    for n, name in enumerate(order):
        part = str(src) + "_part"
        spark.createDataFrame([ROWS[name]], "id int, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("overwrite").parquet(part)
        os.makedirs(src, exist_ok=True)
        made = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.replace(f"{part}/{made}", f"{src}/{n}.parquet")
        os.utime(f"{src}/{n}.parquet", (time.time() + n, time.time() + n))


@pytest.mark.parametrize("order", list(itertools.permutations(ROWS)))
@pytest.mark.parametrize("how", ["state", "target"])
def test_no_key_is_lost_in_any_order_of_files(spark, tmp_path, order, how):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    _files(spark, src, order)
    s = ingest.file_stream(spark, str(src), "id int, ts timestamp")
    if how == "state":
        ingest.run_once(ingest.first_arrivals(s, "id", "ts", "1 hour"), out, cp)
    else:
        ingest.append_first(s, "id", "ts", out, cp)
        ingest.append_first(s, "id", "ts", out, cp)  # nothing new: nothing changes
    got = {r["id"]: r["ts"].day for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 2
    assert got == {1: 1, 2: 2 if order.index("2") < order.index("2b") else 3}
