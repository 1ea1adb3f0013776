"""History is never lost, readers go on reading, and the worst symptom is the worst."""

import pytest
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.errors import EngineError
from tidemark.operators import rca
from tidemark.operators.lineage import lineage
from tidemark.operators.store import KEPT, IncidentStore

RECORD = "asset string, signature string, column_name string, change_id string, change_label string, severity string, confidence double, title string, summary string, change_at timestamp_ntz, detected_at timestamp_ntz, run_at timestamp_ntz"


def record(spark, asset, hour):
    at = F.lit(f"2026-01-01 {hour:02d}:00:00").cast("timestamp_ntz")
    row = spark.createDataFrame([(asset, "s", "c", "x", "l", "low", 0.5, "t", "s", None, None, None)], RECORD)
    return row.withColumn("detected_at", at).withColumn("run_at", at)


def test_readers_go_on_reading(spark, tmp_path):
    with IncidentStore(spark, str(tmp_path / "s")) as store:
        store.record(record(spark, "a", 1))
        seen = store.history("a")
        for hour in range(2, KEPT + 1):
            store.record(record(spark, "a", hour))
        assert seen.count() == 1 and seen.first()["occurrences"] == 1
        store.record(record(spark, "a", 9))
        assert store.history("a").first()["occurrences"] == KEPT + 1
        assert len(store._latest()) == KEPT


def test_failed_rename_loses_nothing(spark, tmp_path):
    with IncidentStore(spark, str(tmp_path / "s")) as store:
        store.record(record(spark, "a", 1))

        class Refuses:
            def __init__(self, fs):
                self.fs = fs

            def rename(self, *_):
                return False

            def __getattr__(self, name):
                return getattr(self.fs, name)

        store._fs, kept = Refuses(store._fs), store._fs
        with pytest.raises(EngineError):
            store.record(record(spark, "a", 2))
        store._fs = kept
        assert store.history("a").first()["occurrences"] == 1


def test_worst_of_equal_numbers(spark):
    rows = [("x", 0, 0.2), ("y", 0, 0.7)]
    seen = spark.createDataFrame([(a, "2026-01-02 10:00:00", n, "v", "value_substitution", m, None) for a, n, m in rows], "asset string, observed_at string, obs_ord int, column string, signature string, magnitude double, confidence double")
    changes = spark.createDataFrame([("c", "2026-01-02 09:00:00", ["r"], "l", 0)], "change_id string, ts string, targets array<string>, label string, change_ord int")
    cast = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    (got,) = rca.incidents(cast(seen, "observed_at"), cast(changes, "ts"), lineage(spark, [("r", "x"), ("r", "y")])).collect()
    assert (got["worst"]["asset"], got["worst"]["magnitude"], got["severity"]) == ("y", 0.7, "high")


def test_scratch_tables_end_with_their_scope(spark):
    with scratch.scratch_scope(spark):
        df = scratch.written(spark.range(5))
        assert df.count() == 5
        (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
