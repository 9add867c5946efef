"""The stateful watchdog agrees with the batch form over restarts."""

import numpy as np
import pytest

from quillspark.streaming import watchdog

SCHEMA = "series string, step long, value double"


@pytest.mark.parametrize("files", [1, 3])
def test_stream_and_batch_agree_over_restarts(spark, tmp_path, files):
    rng = np.random.default_rng(files)
    rows = [(s, t, float(rng.random())) for s in ("a", "b", "c") for t in range(60)]
    rows += [(None, 1, 0.0), ("a", None, 0.0)]
    cuts = [0, 13, 14, 40, 60]
    want = sorted(map(tuple, watchdog.batch_alarms(spark.createDataFrame(rows, SCHEMA), 0.6, 3).collect()))
    assert want and max(r[3] for r in want) > 4
    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):  # a run of the stream after each part
        part = [r for r in rows if r[1] is None or x <= r[1] < y]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watchdog.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), 0.6, 3, files_per_trigger=files)
    watchdog.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), 0.6, 3)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.select("series", "step", "first_step", "length").collect())) == want


def test_late_windows_and_nulls(spark, tmp_path):
    def push(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watchdog.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), 1.0, 2)

    push(("a", 5, 0.0))
    push(("a", 4, 0.0), ("a", 5, 0.0), ("a", 6, 0.5))  # late, repeated, next
    push(("a", 7, None), ("a", 8, 0.0))
    push(("a", 9, 0.0))
    got = spark.read.parquet(str(tmp_path / "out")).select("series", "step", "first_step", "length")
    assert sorted(map(tuple, got.collect())) == [("a", 6, 5, 2), ("a", 9, 8, 2)]
