"""Token counts as delta-maintained rollups.

Changes (inserts, deletes, revised counts) become signed deltas of documents and
tokens, added up by source, language and tokenizer version. A batch of changes is
committed as a folder of such deltas; totals are the sums over all committed batches.
Sums are additive, so batches may arrive in any order, and a batch that is committed
again, after a retry say, changes nothing: its folder exists.

A commit writes aside and is made visible by one rename. ``compact`` folds committed
batches into one and remembers their names.

Edge cases: null source or language is a group of its own; changes with null counts
count as 0; an empty batch is committed too; groups whose totals are all 0 are left
out of ``totals``; further columns of changes are ignored.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def _changes(docs: DataFrame, op: str, tokenizer: str, tokens: Column, was: Column) -> DataFrame:
    named = [F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), tokens.cast("long").alias("tokens"), was.cast("long").alias("was")]
    return docs.select("source", "lang", *named)


def inserts(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return _changes(docs, "insert", tokenizer, tokens, F.lit(0))


def deletes(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return _changes(docs, "delete", tokenizer, tokens, F.lit(0))


def revisions(docs: DataFrame, tokenizer: str, tokens: Column, was: Column) -> DataFrame:
    """Counts that replace earlier ones of the same documents."""
    return _changes(docs, "revise", tokenizer, tokens, was)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (source, lang, tokenizer, op, tokens, was)."""
    now, was = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tokens", "was"))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    change = F.when(F.col("op") == "revise", now - was).otherwise(sign * now)
    return changes.groupBy(*KEY).agg(F.sum(sign).cast("long").alias("docs"), F.sum(change).cast("long").alias("tokens"))


class TokenRollup:
    """Totals kept in a folder of any file system that Spark writes to.

    ``batches/<name>`` holds a batch's deltas. ``snapshots/<number>`` holds the sums
    and the names of the batches folded so far; the latest snapshot counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("batches", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The latest snapshot's folder and the batches in it."""
        snapshots = self._names("snapshots")
        if not snapshots:
            return None, set()
        at = f"{self.folder}/snapshots/{snapshots[-1]}"
        return at, {r["name"] for r in self.spark.read.schema("name string").parquet(f"{at}/names").collect()}

    def _publish(self, aside: str, to: str) -> bool:
        """Make a folder written aside visible at once; False if ``to`` was there first."""
        if not self._fs.exists(self._path(to)) and self._fs.rename(self._path(aside), self._path(to)):
            # Of two writers at one moment the second's folder lands inside the first's.
            inner = self._path(f"{to}/{aside.rpartition('/')[2]}")
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)
            return False
        self._fs.delete(self._path(aside), True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changed, if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"batch name {batch!r}")
        if batch in self._folded()[1] or self._fs.exists(self._path(f"{self.folder}/batches/{batch}")):
            return False
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(aside)
        return self._publish(aside, f"{self.folder}/batches/{batch}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        snapshot, folded = self._folded()
        paths = [f"{snapshot}/sums"] if snapshot else []
        paths += [f"{self.folder}/batches/{b}" for b in self._names("batches") if b not in folded]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs != 0 OR tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into a snapshot; repeats of theirs still change nothing. For one writer at a time."""
        batches, (_, folded) = self._names("batches"), self._folded()
        number = len(self._names("snapshots"))
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(b,) for b in sorted({*batches, *folded})], "name string").coalesce(1).write.parquet(f"{aside}/names")
        if self._publish(aside, f"{self.folder}/snapshots/{number:012d}"):
            for b in batches:
                self._fs.delete(self._path(f"{self.folder}/batches/{b}"), True)
