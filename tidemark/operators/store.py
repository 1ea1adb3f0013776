"""Incident history: one row for each identity, kept as Parquet snapshots.

A write makes a new snapshot folder and then moves the pointer by one rename, so
readers see the old or the new history, never a part. The last ``KEPT`` snapshots stay,
for those who still read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import SEVERITIES
from tidemark.errors import EngineError

#: Snapshots that are kept, the current one among them.
KEPT = 4
SCHEMA = (
    "identity_key string, asset string, signature string, column_name string, change_id string, change_label string, severity string, confidence double, "
    "title string, summary string, change_at timestamp_ntz, first_detected_at timestamp_ntz, last_detected_at timestamp_ntz, "
    "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, occurrences int"
)
REFRESHED = ("severity", "confidence", "title", "summary", "change_at")


def identity(asset: Column, signature: Column, change_id: Column) -> Column:
    """Key of an incident: the same asset, signature and change."""
    return F.sha2(F.concat(asset, F.lit("\0"), signature, F.lit("\0"), change_id), 256)


def upserted(history: DataFrame, new: DataFrame) -> DataFrame:
    """History after new records (asset, signature, column_name, change_id, ..., detected_at, run_at).

    A known identity keeps its first times, column and label; the rest is refreshed
    and occurrences grow. Of new records with one identity the latest run counts, each as an occurrence.
    """
    keyed = new.withColumn("identity_key", identity(F.col("asset"), F.col("signature"), F.col("change_id")))
    group = Window.partitionBy("identity_key")
    ranked = keyed.withColumn("n", F.row_number().over(group.orderBy(F.desc("run_at"), F.desc("detected_at"))))
    for name, fn, col in (("times", F.count, F.lit(1)), ("first_run", F.min, F.col("run_at")), ("first_det", F.min, F.col("detected_at"))):
        ranked = ranked.withColumn(name, fn(col).over(group))
    n = ranked.filter("n = 1").alias("n")
    h = history.alias("h")
    both = h.join(n, F.col("h.identity_key") == F.col("n.identity_key"), "full_outer")
    known, fresh = F.col("h.identity_key").isNotNull(), F.col("n.identity_key").isNotNull()
    keep = lambda c, other=None: F.when(known, F.col(f"h.{c}")).otherwise(F.col(f"n.{other or c}")).alias(c)
    take = lambda c, other=None: F.when(fresh, F.col(f"n.{other or c}")).otherwise(F.col(f"h.{c}")).alias(c)
    out = both.select(
        *[keep(c) for c in ("identity_key", "asset", "signature", "column_name", "change_id", "change_label")],
        *[take(c) for c in REFRESHED],
        keep("first_detected_at", "first_det"),
        take("last_detected_at", "detected_at"),
        keep("first_seen_at", "first_run"),
        take("last_seen_at", "run_at"),
        (F.coalesce("h.occurrences", F.lit(0)) + F.coalesce("n.times", F.lit(0))).cast("int").alias("occurrences"),
    )
    return out.select(*[c.split()[0] for c in SCHEMA.split(", ")])


class IncidentStore:
    """History in a folder of any file system that Spark writes to. For one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/snapshots"))

    def __enter__(self) -> IncidentStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing stays open."""

    def _latest(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/snapshots")))

    def table(self) -> DataFrame:
        names = self._latest()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/snapshots/{names[-1]}")

    def _replace(self, df: DataFrame) -> None:
        names = self._latest()
        number = int(names[-1]) + 1 if names else 0
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        if not self._fs.rename(self._path(aside), self._path(f"{self.folder}/snapshots/{number:012d}")):
            self._fs.delete(self._path(aside), True)
            raise EngineError(f"snapshot {number} of {self.folder} could not be put in place; the history is as it was")
        for old in names[: max(0, len(names) + 1 - KEPT)]:
            self._fs.delete(self._path(f"{self.folder}/snapshots/{old}"), True)

    def record(self, new: DataFrame) -> None:
        self._replace(upserted(self.table(), new))

    def history(self, asset: str) -> DataFrame:
        """Newest first."""
        return history_of(self.table(), asset)

    def get(self, key: str) -> DataFrame:
        return self.table().filter(F.col("identity_key") == key)

    def prune(self, before) -> int:
        """Delete what was last seen before a time; how many rows that was."""
        table = self.table()
        old = F.coalesce(F.col("last_seen_at") < F.lit(before).cast("timestamp_ntz"), F.lit(False))
        n = table.filter(old).count()
        if n:
            self._replace(table.filter(~old))
        return n


def history_of(table: DataFrame, asset: str) -> DataFrame:
    return table.filter(F.col("asset") == asset).orderBy(F.desc_nulls_last("last_detected_at"), "identity_key")


def incident_list(table: DataFrame, severity: str | None = None, order: str = "severity") -> DataFrame:
    """``table`` with ``place``: of one severity or all, by severity, confidence or time; later ones first, ties by key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    recent = F.desc_nulls_last("last_detected_at")
    orders = {"severity": [rank.desc(), recent], "confidence": [F.desc_nulls_last("confidence")], "recent": [recent]}
    rows = table if severity is None else table.filter(F.col("severity") == severity)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*orders[order], "identity_key")))
