"""Evaluation: thresholds, seeded trials, ranked causes, blast radius."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detect import detect, with_confidence
from tidemark.operators.inject import halves, two_sample_splits
from tidemark.operators.profile import profile


def threshold_grid(df: DataFrame, low: int = 1, high: int = 60) -> DataFrame:
    """Rows of ``df`` for each threshold from low to high hundredths."""
    return df.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("threshold", F.col("t") / 100).drop("t")


def sweep(outcomes: DataFrame) -> DataFrame:
    """(threshold, recall, fp_rate) from outcomes (threshold, positive, fired)."""
    fired = F.col("fired").cast("double")
    return outcomes.groupBy("threshold").agg(F.coalesce(F.avg(F.when(F.col("positive"), fired)), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.when(~F.col("positive"), fired)), F.lit(0.0)).alias("fp_rate"))


def operating_point(table: DataFrame, max_fp: float = 0.0) -> DataFrame:
    """The middle of the thresholds with the best recall among those within ``max_fp``, else least fp, most recall, lowest threshold."""
    within = table.filter(F.col("fp_rate") <= max_fp)
    best = F.max("recall").over(Window.partitionBy())
    safe = within.withColumn("best", best).filter("recall = best").drop("best")
    place = F.row_number().over(Window.orderBy("threshold")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy())
    middle = safe.withColumn("place", place).withColumn("size", size).filter("place = floor(size / 2)").select("threshold", "recall", "fp_rate", F.lit(0).alias("choice"))
    rest = table.orderBy("fp_rate", F.desc("recall"), "threshold").limit(1).withColumn("choice", F.lit(1))
    return middle.unionByName(rest).orderBy("choice").limit(1).drop("choice")


def trial_symptoms(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Symptoms of all trials, from one profile job for each side."""
    b, a = (profile(df, columns, side=s, by=["trial"]) for df, s in ((before, "before"), (after, "after")))
    return with_confidence(detect(b, a, by=["trial"]))


def _splits(df: DataFrame, columns: Sequence[str], n: int, trials: int, key: str, seed: int, drawn: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if drawn is None:
        return two_sample_splits(df.select(key, *columns), n, trials, key, seed=seed)
    return halves(drawn.select(key, *columns, "trial", "place"), n)


def real_vs_real(df: DataFrame, columns: Sequence[str], n: int, trials: int, key: str, *, seed: int = 0, drawn: DataFrame | None = None) -> DataFrame:
    """(trial, column, n_fired, confidence): checks of halves that differ by chance only; what fires is false.

    ``drawn``: ``drawn_trials`` of ``df`` with the same trials and seed and ``n`` or more, which saves the draw.
    """
    before, after = _splits(df, columns, n, trials, key, seed, drawn)
    found = trial_symptoms(before, after, columns)
    checks = df.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    fired = found.groupBy("trial", "column").agg(F.count(F.lit(1)).alias("n_fired"), F.max("confidence").alias("confidence"))
    out = checks.join(fired, ["trial", "column"], "left")
    return out.select("trial", "column", F.coalesce("n_fired", F.lit(0)).alias("n_fired"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: (signature to be found, column, change of the second half)
Recipe = tuple[str, str, Callable[[DataFrame], DataFrame]]


def injected_recall(df: DataFrame, recipes: Sequence[Recipe], n: int, trials: int, key: str, *, seed: int = 0, drawn: DataFrame | None = None) -> DataFrame:
    """(dataset, trial, hit, confidence): whether each recipe's injection into the second half of a trial is found.

    All recipes share the halves; recipe and trial are keys of one profile job a side.
    ``dataset`` is the signature; ``drawn`` is as in ``real_vs_real``.
    """
    columns = list(dict.fromkeys(c for _, c, _ in recipes))
    before, after = _splits(df, columns, n, trials, key, seed, drawn)
    changed = None
    for signature, _, inject in recipes:
        part = inject(after).withColumn("dataset", F.lit(signature))
        changed = part if changed is None else changed.unionByName(part)
    asked = df.sparkSession.createDataFrame([(s, c) for s, c, _ in recipes], "dataset string, column string")
    b = profile(before, columns, side="before", by=["trial"]).join(F.broadcast(asked), "column")
    a = profile(changed, columns, side="after", by=["dataset", "trial"]).join(F.broadcast(asked), ["dataset", "column"])
    found = with_confidence(detect(b, a, by=["dataset", "trial"])).filter("signature = dataset").select("dataset", "trial", "confidence")
    every = df.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial")).crossJoin(F.broadcast(asked.select("dataset")))  # trials times recipes
    return every.join(found, ["dataset", "trial"], "left").select("dataset", "trial", F.col("confidence").isNotNull().alias("hit"), "confidence")


def pooled(rates: DataFrame) -> DataFrame:
    """(dataset, checks, hits, rate), with the pool of all as dataset null."""
    return rates.rollup("dataset").agg(F.count(F.lit(1)).alias("checks"), F.sum(F.col("hit").cast("int")).alias("hits"), F.avg(F.col("hit").cast("double")).alias("rate"))


def set_scores(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall) of two tables with the same columns."""
    tp = found.intersect(expected).select(F.lit("tp").alias("k"))
    fp = found.subtract(expected).select(F.lit("fp").alias("k"))
    fn = expected.subtract(found).select(F.lit("fn").alias("k"))
    n = {k: F.count_if(F.col("k") == k) for k in ("tp", "fp", "fn")}
    out = tp.unionByName(fp).unionByName(fn).agg(*[c.alias(k) for k, c in n.items()])
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(F.lit(1.0))
    return out.select("tp", "fp", "fn", ratio("fp").alias("precision"), ratio("fn").alias("recall"))
