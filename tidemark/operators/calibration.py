"""Confidence model and how well it is calibrated."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.stats import sigmoid
from tidemark.scratch import written


@dataclass
class LogisticModel:
    """Logistic regression on standardised features, fitted by gradient descent from zero."""

    weights: list[float] = field(default_factory=lambda: list(C.MODEL_WEIGHTS))
    intercept: float = C.MODEL_INTERCEPT
    feature_mean: list[float] = field(default_factory=lambda: list(C.MODEL_MEANS))
    feature_std: list[float] = field(default_factory=lambda: list(C.MODEL_STDS))

    def predict_proba(self, x: Sequence[float]) -> float:
        z = self.intercept + sum(w * (v - m) / s for w, v, m, s in zip(self.weights, x, self.feature_mean, self.feature_std))
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

    def column(self, features: Sequence[str] = C.FEATURE_NAMES):
        z = F.lit(self.intercept)
        for name, w, m, s in zip(features, self.weights, self.feature_mean, self.feature_std):
            z = z + F.lit(w) * ((F.col(name) - F.lit(m)) / F.lit(s))
        return sigmoid(z)

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2) + "\n", encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path | None = None) -> LogisticModel:
        """A saved model; the frozen one without a path."""
        return cls() if path is None else cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_dict(cls, d: dict) -> LogisticModel:
        return cls(list(d["weights"]), float(d["intercept"]), list(d["feature_mean"]), list(d["feature_std"]))

    @classmethod
    def fit(cls, df: DataFrame, label: str, features: Sequence[str] = C.FEATURE_NAMES, *, l2: float = C.FIT_L2, rate: float = C.FIT_RATE, steps: int = C.FIT_STEPS) -> LogisticModel:
        """Fit on a table of labelled symptoms.

        Equal feature vectors are counted together on the cluster. Means and deviations
        come from there too; the descent runs over the distinct vectors on the driver.
        """
        stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
        if not stats["n"]:
            raise ValueError("no rows to fit")
        mean = [stats[f"m{i}"] for i in range(len(features))]
        std = [stats[f"s{i}"] if stats[f"s{i}"] > 1e-12 else 1.0 for i in range(len(features))]
        grouped = df.groupBy(*features).agg(F.count(F.lit(1)).alias("n_"), F.sum(F.col(label).cast("double")).alias("y_")).orderBy(*features)
        rows = [([(r[c] - m) / s for c, m, s in zip(features, mean, std)], r["n_"], r["y_"]) for r in grouped.collect()]
        w, b, n = [0.0] * len(features), 0.0, stats["n"]
        for _ in range(steps):
            gw, gb = [0.0] * len(w), 0.0
            for x, count, positive in rows:
                z = b + sum(p * q for p, q in zip(w, x))
                p = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
                e = count * p - positive
                gb += e
                for j, v in enumerate(x):
                    gw[j] += e * v
            w = [v - rate * (g / n + l2 * v) for v, g in zip(w, gw)]
            b -= rate * gb / n
        return cls(w, b, mean, std)


def stratified_folds(df: DataFrame, label: str, order: str, k: int = C.FOLDS) -> DataFrame:
    """Adds fold: each class dealt in turn, in the order of ``order``."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    return df.withColumn("fold", (place % k).cast("int"))


def out_of_fold(df: DataFrame, label: str, order: str, k: int = C.FOLDS, **fit) -> DataFrame:
    """``df`` with each row's probability from a model fitted on the other folds; folds whose rest has one class are left out."""
    folds = written(stratified_folds(df, label, order, k))
    out = None
    for i in range(k):
        rest = folds.filter(F.col("fold") != i)
        if rest.select(label).distinct().count() < 2:
            continue
        part = folds.filter(F.col("fold") == i)
        part = part.withColumn("p", LogisticModel.fit(rest, label, **fit).column())
        out = part if out is None else out.unionByName(part)
    return folds.withColumn("p", F.lit(None).cast("double")).limit(0) if out is None else out


def reliability_bins(pairs: DataFrame, p: str, y: str, bins: int = C.BINS) -> DataFrame:
    """(bin, lo, hi, n, mean_p, mean_y): equal-width bins, empty ones too."""
    number = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins))).cast("int")
    got = pairs.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), "n", F.coalesce("mean_p", F.lit(0.0)).alias("mean_p"), F.coalesce("mean_y", F.lit(0.0)).alias("mean_y"))


def reliability(pairs: DataFrame, p: str, y: str, bins: int = C.BINS) -> DataFrame:
    """One row (n, brier, ece, mce, mid_range_n)."""
    table = reliability_bins(pairs, p, y, bins)
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    total = F.sum("n")
    errors = table.agg(
        total.alias("n"),
        F.coalesce(F.sum(F.col("n") * gap) / total, F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(F.when(F.col("n") > 0, gap)), F.lit(0.0)).alias("mce"),
        F.coalesce(F.sum(F.when((F.col("lo") >= 0.2) & (F.col("hi") <= 0.8), F.col("n"))), F.lit(0)).alias("mid_range_n"),
    )
    brier = pairs.agg(F.coalesce(F.avg(F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2))), F.lit(0.0)).alias("brier"))
    return errors.crossJoin(F.broadcast(brier)).select("n", "brier", "ece", "mce", "mid_range_n")  # one row each


def render_reliability(pairs: DataFrame, p: str, y: str) -> str:
    """Markdown of the reliability table."""
    s = reliability(pairs, p, y).first()
    lines = [f"n={s['n']}  ECE={s['ece']:.4f}  MCE={s['mce']:.4f}  Brier={s['brier']:.4f}", "", "| bin | n | mean p | observed |", "| --- | --- | --- | --- |"]
    for r in reliability_bins(pairs, p, y).orderBy("bin").collect():
        lines.append(f"| {r['lo']:.1f}-{r['hi']:.1f} | {r['n']} | {r['mean_p']:.3f} | {r['mean_y']:.3f} |")
    return "\n".join(lines)


def literal_pairs(spark: SparkSession, rows: list[tuple[float, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "p double, y int")
