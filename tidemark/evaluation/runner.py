"""Trials over a registry of tables: recall, false alarms, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.evaluation.registry import RealDataset, loadable
from tidemark.operators import evaluate
from tidemark.operators.calibration import render_reliability
from tidemark.operators.inject import drawn_trials
from tidemark.scratch import written


@dataclass
class EvalReport:
    """``checks``: (dataset, domain, kind, column, trial, hit, confidence), a row for each check of either experiment."""

    checks: DataFrame

    @property
    def rates(self) -> DataFrame:
        """(dataset, domain, recall, fp_rate) by dataset, and pooled with dataset null."""
        hit = F.col("hit").cast("double")
        recall, fp = F.avg(F.when(F.col("kind") == "injected", hit)), F.avg(F.when(F.col("kind") == "unchanged", hit))
        measures = [F.coalesce(recall, F.lit(0.0)).alias("recall"), F.coalesce(fp, F.lit(0.0)).alias("fp_rate")]
        own = self.checks.groupBy("dataset", "domain").agg(*measures)
        none = F.lit(None).cast("string")
        return own.unionByName(self.checks.agg(*measures).select(none.alias("dataset"), none.alias("domain"), "recall", "fp_rate"))

    @property
    def pairs(self) -> DataFrame:
        """(p, y): the confidences of all that fired, pooled over datasets, and whether it should have."""
        return self.checks.filter("hit").select(F.col("confidence").alias("p"), (F.col("kind") == "injected").cast("int").alias("y"))


def _checks(spark: SparkSession, dataset: RealDataset, n: int, trials: int, seed: int) -> DataFrame:
    df = dataset.load(spark)
    most = df.count() // 2
    sizes = {r.n for r in dataset.recipes}
    columns = dict.fromkeys([dataset.key, *dataset.columns, *(r.column for r in dataset.recipes)])
    # Smaller halves are the first of larger ones: each row is hashed once a trial for all sizes.
    drawn = drawn_trials(df.select(*columns), min(max([n, *sizes]), most), trials, dataset.key, seed=seed)
    silent = evaluate.real_vs_real(df, dataset.columns, min(n, most), trials, dataset.key, seed=seed, drawn=drawn)
    out = silent.select(F.lit("unchanged").alias("kind"), "column", "trial", (F.col("n_fired") > 0).alias("hit"), "confidence")
    for size in sorted(sizes):
        recipes = [(r.signature, r.column, r.inject) for r in dataset.recipes if r.n == size]
        found = evaluate.injected_recall(df, recipes, min(size, most), trials, dataset.key, seed=seed, drawn=drawn)
        column_of = F.create_map(*[F.lit(x) for s, c, _ in recipes for x in (s, c)])
        out = out.unionByName(found.select(F.lit("injected").alias("kind"), F.element_at(column_of, F.col("dataset")).alias("column"), "trial", "hit", "confidence"))
    return out.select(F.lit(dataset.id).alias("dataset"), F.lit(dataset.domain).alias("domain"), *out.columns)


def run_registry(spark: SparkSession, registry: Sequence[RealDataset], *, n: int = 1000, trials: int = 30, seed: int = 0, include_local: bool = False) -> EvalReport:
    """Both experiments on every dataset that can be read; ``n`` is at most half of a table."""
    checks = None
    for dataset in loadable(spark, registry):
        if dataset.local and not include_local:
            continue
        part = _checks(spark, dataset, n, trials, seed)
        checks = part if checks is None else checks.unionByName(part)
    if checks is None:
        raise ValueError("no dataset can be read")
    return EvalReport(written(checks))


def false_positive_examples(checks: DataFrame, most: int = 10) -> DataFrame:
    """The first false alarms by dataset, column and trial."""
    return checks.filter("kind = 'unchanged' AND hit").orderBy("dataset", "column", "trial").limit(most)


def render_report(report: EvalReport) -> str:
    """Markdown: a line for each dataset by name, the pool, and the reliability of the confidences."""
    rows = sorted(report.rates.collect(), key=lambda r: (r["dataset"] is None, r["dataset"]))
    lines = ["# Evaluation on real tables", "", "Changes are injected into halves drawn from real tables (recall); halves left as they are must stay silent (false alarms).", ""]
    lines += ["| dataset | domain | recall | false alarms |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['dataset'] or '**pooled**'} | {r['domain'] or ''} | {r['recall']:.3f} | {r['fp_rate']:.3f} |" for r in rows]
    return "\n".join([*lines, "", render_reliability(report.pairs, "p", "y")])
