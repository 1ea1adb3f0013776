"""Change detection on a stream: each window is compared with the one before.

The stream keeps counts of values by window (bounded by the watermark); profiles and
signatures are those of the batch engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.detect import detect
from tidemark.operators.profile import NUMERIC
from tidemark.scratch import written


def window_counts(events: DataFrame, time: str, column: str, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, value, n) by tumbling window; rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "value", "n")


def window_profiles(counts: DataFrame, column: str, top_k: int = C.TOP_K) -> DataFrame:
    """Profiles with ``start``, from counts (start, value, n)."""
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    known = F.col("value").isNotNull()
    kept = F.collect_list(F.when(known & (F.col("place") <= top_k), F.struct("value", "n")))
    rows = counts.withColumn("place", place).groupBy("start").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("distinct_count"),
        F.map_from_entries(kept).alias("top_k"),
    )
    return rows.select(F.lit("").alias("asset"), F.lit("").alias("side"), "start", F.lit(column).alias("column"), F.lit(0).alias("column_ord"), "row_count", "null_count", "distinct_count", "top_k", F.lit(None).cast(NUMERIC).alias("numeric"))


def drift(profiles: DataFrame) -> DataFrame:
    """Symptoms of each window against the one before it; ``start`` is the later window's."""
    order = profiles.select("column", "start").distinct().withColumn("next", F.lead("start").over(Window.partitionBy("column").orderBy("start")))
    before = profiles.join(order, ["column", "start"]).filter("next IS NOT NULL").drop("start").withColumnRenamed("next", "start")
    return detect(before, profiles, by=["start"])


def monitor(events: DataFrame, time: str, column: str, on_symptoms: Callable[[DataFrame, int], None], *, window: str = "1 day", late: str = "1 hour", checkpoint: str, state: str, triggers: Sequence[str] = ()):
    """Start a query that hands new symptoms to ``on_symptoms``.

    Each batch reads one profile, the last window's of the batch before, and writes its
    own last one to ``state``: what is kept does not grow with the stream. A batch that
    is run again after a failure reads and writes the same folders again.
    """

    def batch(counts: DataFrame, number: int) -> None:
        spark = counts.sparkSession
        new = written(window_profiles(counts, column))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(state).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path(state))
        earlier = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path(state)))
        earlier = [n for n in earlier if n < number]
        every = new
        if earlier:
            every = spark.read.schema(new.schema).parquet(f"{state}/batch={earlier[-1]:09d}").unionByName(new)
        if new.isEmpty():
            return
        found = drift(every)
        on_symptoms(found.join(new.select("start").distinct(), "start", "left_semi"), number)
        last = new.agg(F.max("start").alias("start"))
        new.join(F.broadcast(last), "start").select(*new.columns).write.mode("overwrite").parquet(f"{state}/batch={number:09d}")
        for n in earlier[:-1]:
            fs.delete(path(f"{state}/batch={n:09d}"), True)

    writer = window_counts(events, time, column, window=window, late=late).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if "once" in triggers else writer).start()
