"""Spark's pushed-down quantiles: exact, without a map of all distinct values."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest
from tidemark import constants as C
from tidemark.sources.warehouse import SparkDialect, SqlProfileSource, spark_executor

COLUMNS = {
    "spread": lambda i, rng: rng.gauss(0, 1) * 10.0 ** rng.randint(-30, 30),
    "few": lambda i, rng: float(rng.choice([1, 1, 1, 2, 9])),
    "whole": lambda i, rng: i * 7919 % 40000,
    "odd": lambda i, rng: rng.choice([None, float("nan"), float("inf"), float("-inf"), rng.random()]),
    "one": lambda i, rng: 5.0,
    "none": lambda i, rng: float("nan"),
}


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [tuple(f(i, rng) for f in COLUMNS.values()) for i in range(40000)]
    spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'whole' else 'double'}" for c in COLUMNS)).createOrReplaceTempView("ranked")
    return {c: [x for x in v if x is not None and np.isfinite(x)] for c, v in zip(COLUMNS, zip(*rows))}


def quantiles(spark, dialect):
    run, asked = spark_executor(spark), []

    def execute(sql):
        asked.append(sql)
        return run(sql)

    return {c: p.numeric and list(p.numeric.quantiles.values()) for c, p in SqlProfileSource(execute, "ranked", dialect=dialect).profile(list(COLUMNS)).items()}, asked


def test_exact_near_a_sketch(spark, values):
    got, asked = quantiles(spark, SparkDialect)
    for c, v in values.items():
        assert got[c] == (pytest.approx(list(np.quantile(v, C.QUANTILES)), rel=1e-12) if v else None)
    ranked = [sql for sql in asked if " OVER " in sql]
    # No aggregate holds a column's values, and only those near a quantile are ranked, once.
    assert not any(re.search(r"(?<!APPROX_)PERCENTILE\(", sql) for sql in asked)
    assert len(ranked) == sum(map(bool, values.values())) and all(" BETWEEN " in sql for sql in ranked)


def test_exact_whatever_the_sketch_says(spark, values):
    wrong = replace(SparkDialect, sketch="IF(COUNT({v}) >= 0, ARRAY(-3D, -2D, -2D, 0D, 0.5D, 0.5D, 3D, 3D, 7D, 8D), ARRAY({p}))")
    got, _ = quantiles(spark, wrong)
    for c, v in values.items():
        assert got[c] == (pytest.approx(list(np.quantile(v, C.QUANTILES)), rel=1e-12) if v else None)
