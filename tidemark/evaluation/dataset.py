"""Labelled symptoms to fit the confidence model on: every split, size and change is a key of one profile job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.evaluation.scenarios import SCENARIOS, scenario_symptoms
from tidemark.operators.calibration import LogisticModel, out_of_fold, reliability
from tidemark.operators.detect import detect, with_features
from tidemark.operators.inject import first_drawn
from tidemark.operators.profile import profile
from tidemark.scratch import written


@dataclass(frozen=True)
class GridPoint:
    """A share of one value's rows, renamed in the second of two halves of ``n`` rows."""

    column: str
    from_value: str
    to_value: str
    n: int
    fraction: float


# Sizes, shares and seeds of the grid.
POSITIVE_SIZES = (800, 1500, 3000)
POSITIVE_FRACTIONS = (0.3, 0.6, 1.0)
NEGATIVE_SIZES = (50, 80, 120, 200)
NEGATIVE_TRIALS = 25
POSITIVE_SEED, NEGATIVE_SEED, NEGATIVE_STEP = 101, 500, 37


def default_grid(values: Sequence[tuple[str, str]]) -> list[GridPoint]:
    """All sizes and shares for each (column, value)."""
    return [GridPoint(c, v, f"{v}_RECODED", n, f) for c, v in values for n in POSITIVE_SIZES for f in POSITIVE_FRACTIONS]


def keyed_splits(df: DataFrame, points: Sequence[tuple[str, int, str]], key: str) -> DataFrame:
    """The first 2n rows of each point (name, n, seed) in the order of md5 of key and seed, with ``point``, ``place`` and ``n``."""
    sizes = F.create_map(*[F.lit(x) for p, n, _ in points for x in (p, n)])
    return first_drawn(df, [(p, 2 * n, s) for p, n, s in points], key, "point").withColumn("n", F.element_at(sizes, F.col("point")))


def renamed(rows: DataFrame, grid: Sequence[tuple[str, GridPoint]]) -> DataFrame:
    """``rows`` with each point's value renamed in the first of its rows, by place."""
    for column in dict.fromkeys(g.column for _, g in grid):
        told = F.create_map(*[x for p, g in grid if g.column == column for x in (F.lit(p), F.struct(F.lit(g.from_value).alias("old"), F.lit(g.to_value).alias("new"), F.lit(g.fraction).alias("share")))])
        rows = rows.withColumn("t_", F.element_at(told, F.col("point")))
        hit = F.coalesce(F.col(column) == F.col("t_.old"), F.lit(False))
        own = Window.partitionBy("point", hit)
        rows = rows.withColumn("k_", F.row_number().over(own.orderBy("place"))).withColumn("all_", F.count(F.lit(1)).over(own))
        change = hit & (F.col("k_") <= F.ceil(F.col("t_.share") * F.col("all_")))
        rows = rows.withColumn(column, F.when(change, F.col("t_.new")).otherwise(F.col(column))).drop("t_", "k_", "all_")
    return rows


def _labelled(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    b, a = (profile(df, columns, side=side, by=["point"]) for df, side in ((before, "before"), (after, "after")))
    return with_features(detect(b, a, by=["point"], precedence=False))


def calibration_dataset(
    df: DataFrame,
    key: str,
    grid: Sequence[GridPoint],
    negative_columns: Sequence[str],
    *,
    negative_sizes: Sequence[int] = NEGATIVE_SIZES,
    trials: int = NEGATIVE_TRIALS,
    include_scenarios: bool = True,
    seed: int = 0,
) -> DataFrame:
    """(point, column, signature, label, the features): what fires, of all detectors and without precedence.

    Label 1: renames over the grid, and the positive scenarios. Label 0: small halves
    that differ by chance, and the other scenarios.
    """
    named = [(f"p{i:04d}", g) for i, g in enumerate(grid)]
    spread = [(p, g.n, str(seed + POSITIVE_SEED + i)) for i, (p, g) in enumerate(named)]
    columns = list(dict.fromkeys(g.column for g in grid))
    drawn = written(keyed_splits(df.select(key, *columns), spread, key))
    first, second = drawn.filter("place <= n"), renamed(drawn.filter("place > n"), named)
    target = F.create_map(*[F.lit(x) for p, g in named for x in (p, g.column)])
    rows = _labelled(first, second, columns).filter(F.col("column") == F.element_at(target, F.col("point"))).withColumn("label", F.lit(1))

    chance = [(f"n{j:02d}-{t:03d}", n, str(seed + NEGATIVE_SEED + NEGATIVE_STEP * j + t)) for j, n in enumerate(negative_sizes) for t in range(trials)]
    drawn = written(keyed_splits(df.select(key, *negative_columns), chance, key))
    rows = rows.unionByName(_labelled(drawn.filter("place <= n"), drawn.filter("place > n"), negative_columns).withColumn("label", F.lit(0)))
    if include_scenarios:
        positive = [s.name for s in SCENARIOS if s.is_positive]
        found = with_features(scenario_symptoms(df.sparkSession, precedence=False)).withColumnRenamed("scenario", "point")
        rows = rows.unionByName(found.withColumn("label", F.col("point").isin(positive).cast("int")))
    return rows.select("point", "column", "signature", "label", *C.FEATURE_NAMES)


def fit_frozen_model(dataset: DataFrame, **fit) -> LogisticModel:
    """The model fitted on all labelled symptoms."""
    return LogisticModel.fit(dataset, "label", **fit)


def build_coefficients(dataset: DataFrame, *, seed: int = 0, folds: int = C.FOLDS, **fit) -> dict:
    """The fitted model as a dict, with how well it is calibrated on folds it has not seen."""
    dataset = written(dataset.withColumn("place_", F.concat_ws("/", "point", "column", "signature")))
    model = fit_frozen_model(dataset, **fit)
    size = dataset.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")).first()
    s = reliability(out_of_fold(dataset, "label", "place_", folds, **fit), "p", "label").first()
    measured = {"kfold_ece": s["ece"], "kfold_mce": s["mce"], "kfold_brier": s["brier"], "kfold_mid_range": s["mid_range_n"]}
    return model.to_dict() | {"feature_order": list(C.FEATURE_NAMES), "metadata": {"seed": seed, "dataset_size": size["n"], "positives": int(size["positives"] or 0), **measured}}
