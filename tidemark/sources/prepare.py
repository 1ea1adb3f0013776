"""Data prepared for evaluation: filtered Parquet from CSV, seeded subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.operators.inject import seeded_sample
from tidemark.sources.files import read_snapshot


def csv_to_parquet(spark: SparkSession, source: str, target: str, keep: Column | str | None = None) -> DataFrame:
    """A CSV file's rows that ``keep`` lets through, written as Parquet and read back."""
    df = read_snapshot(spark, source)
    (df if keep is None else df.filter(keep)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def subset_to_parquet(df: DataFrame, target: str, n: int, key: str, *, seed: int = 0) -> DataFrame:
    """``n`` rows, the same each time, written as Parquet and read back."""
    seeded_sample(df, n, key, seed=seed).write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)
