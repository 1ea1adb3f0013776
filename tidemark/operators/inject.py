"""Changes injected into a snapshot, and seeded splits of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.scratch import written


def substitute(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def upper_case(df: DataFrame, column: str, category: str | None = None) -> DataFrame:
    """Values in upper case, or only those equal to ``category``, which must occur."""
    if category is None:
        return df.withColumn(column, F.upper(column))
    if not df.filter(F.col(column) == category).take(1):
        raise EngineError(f"{category!r} does not occur in {column!r}")
    return df.withColumn(column, F.when(F.col(column) == category, F.upper(column)).otherwise(F.col(column)))


def split_category(df: DataFrame, column: str, category: str, into: Sequence[str], key: str) -> DataFrame:
    """The rows of a category dealt in turn to the values of ``into``, in the order of ``key``.

    Only the category's rows are numbered.
    """
    rows = df.filter(F.col(column) == category)
    number = F.row_number().over(Window.partitionBy(column).orderBy(key)) - 1
    dealt = F.get(F.array(*[F.lit(x) for x in into]), (number % len(into)).cast("int"))
    rest = df.filter((F.col(column) != category) | F.col(column).isNull())
    return rest.unionByName(rows.withColumn(column, dealt))


def rename_part(df: DataFrame, column: str, old: str, new: str, fraction: float, key: str) -> DataFrame:
    """The first ceil(fraction x matches) rows of a value renamed, in the order of ``key``."""
    rows = df.filter(F.col(column) == old)
    whole = Window.partitionBy(column)
    number, total = F.row_number().over(whole.orderBy(key)), F.count(F.lit(1)).over(whole)
    renamed = F.when(number <= F.ceil(F.lit(fraction) * total), F.lit(new)).otherwise(F.col(column))
    rest = df.filter((F.col(column) != old) | F.col(column).isNull())
    return rest.unionByName(rows.withColumn(column, renamed))


def scale(df: DataFrame, column: str, factor: float, offset: float = 0.0) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(factor) + F.lit(offset))


def stretch(df: DataFrame, column: str, pivot: float, factor: float) -> DataFrame:
    """Values above ``pivot`` multiplied."""
    return df.withColumn(column, F.when(F.col(column) > pivot, F.col(column) * F.lit(factor)).otherwise(F.col(column)))


def first_drawn(df: DataFrame, points: Sequence[tuple[int | str, int, str]], key: str, name: str) -> DataFrame:
    """The first rows of each point (value of the column ``name``, rows, seed), in the order of md5 of key and seed, with ``place``.

    Every row's hash is made for every point, and only hashes below a point's bound meet:
    bounds under which, of so many even hashes, more than the rows asked for lie. A point
    that finds fewer, as where keys repeat, raises all bounds, to none in the end.
    """
    total, slack = df.count(), 1
    head = df.withColumn("head_", F.concat(F.col(key).cast("string"), F.lit("-")))
    while True:
        shares = [slack * (k + 8 * k**0.5 + 16) / total if total else 1 for _, k, _ in points]
        # Digits of md5 come before "g".
        bounds = [f"{int(share * 2**64):016x}" if share < 1 else "g" for share in shares]
        told = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(b).alias("b")) for (p, k, s), b in zip(points, bounds)])
        dealt = head.withColumn("at_", F.explode(told)).withColumn("draw_", F.md5(F.concat("head_", "at_.s")))
        dealt = dealt.filter(F.col("draw_").isNull() | (F.col("draw_") < F.col("at_.b")))
        near = written(dealt.select(*df.columns, F.col("at_.p").alias(name), F.col("at_.k").alias("k_"), "draw_"))
        found = {r[0]: r[1] for r in near.groupBy(name).agg(F.count(F.lit(1))).collect()}
        if all(found.get(p, 0) >= min(k, total) for p, k, _ in points):
            place = F.row_number().over(Window.partitionBy(name).orderBy("draw_", key))
            return near.withColumn("place", place).filter("place <= k_").drop("k_", "draw_")
        slack *= 8


def drawn_trials(df: DataFrame, n: int, trials: int, key: str, *, seed: int = 0) -> DataFrame:
    """The first 2n rows of each trial (column ``trial``), in the order of md5 of key and seed, with ``place``, written."""
    return written(first_drawn(df, [(t, 2 * n, str(t + seed)) for t in range(trials)], key, "trial"))


def halves(drawn: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Halves of ``n`` rows for each trial, from ``drawn_trials`` of at least as many."""
    place = F.col("place")
    return drawn.filter(place <= n).drop("place"), drawn.filter((place > n) & (place <= 2 * n)).drop("place")


def two_sample_splits(df: DataFrame, n: int, trials: int, key: str, *, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Disjoint halves of ``n`` rows for each trial (column ``trial``), in the order of md5 of key and seed."""
    return halves(drawn_trials(df, n, trials, key, seed=seed), n)


def seeded_sample(df: DataFrame, n: int, key: str, *, seed: int = 0) -> DataFrame:
    """``n`` rows (all if fewer), the same each time."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), F.lit(str(seed))))
    return df.withColumn("draw_", draw).orderBy("draw_", key).limit(n).drop("draw_")


def categorical(spark: SparkSession, column: str, counts: dict[str, int]) -> DataFrame:
    """(row_id, column) with exact counts."""
    rows = spark.createDataFrame(list(counts.items()), "value string, n int").withColumn("x", F.explode(F.array_repeat("value", F.col("n"))))
    return rows.select(F.monotonically_increasing_id().alias("row_id"), F.col("x").alias(column))


def ramp(spark: SparkSession, column: str, n: int, low: int = 10, high: int = 100) -> DataFrame:
    """(row_id, column): low, low + 1, ... high, and again, n rows."""
    return spark.range(n).select(F.col("id").alias("row_id"), (F.lit(low) + F.col("id") % (high - low + 1)).cast("double").alias(column))


def orders(spark: SparkSession, n: int, uk_share: float) -> DataFrame:
    """(order_id, country, amount): a share of UK, the rest over five countries in turn."""
    uk = round(n * uk_share)
    rest = F.get(F.array(*[F.lit(c) for c in ("US", "DE", "FR", "IN", "BR")]), ((F.col("id") - uk) % 5).cast("int"))
    country = F.when(F.col("id") < uk, F.lit("UK")).otherwise(rest)
    return spark.range(n).select((F.col("id") + 1).alias("order_id"), country.alias("country"), F.round(F.lit(10) + F.col("id") % 90 + F.lit(0.99), 2).alias("amount"))
