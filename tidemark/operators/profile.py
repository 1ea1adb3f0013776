"""Profiles of the columns of a snapshot: counts, value frequencies, statistics, quantiles.

A profile row has asset, side, any ``by`` keys, column, column_ord, row_count,
null_count, distinct_count, top_k (map of text to count) and numeric (struct, null
for columns that are not numeric or have no finite value).

Two aggregations make the profiles of all columns, and of all groups of ``by``, at
once: one of counts and moments without Expand, one of value frequencies, which also
gives the exact number of distinct values. Both combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.errors import EngineError
from tidemark.functions.stats import finite
from tidemark.scratch import written

NUMERIC = "struct<count: bigint, mean: double, stddev: double, minimum: double, maximum: double, q: array<double>>"
#: Estimated bytes of input up to which exact quantiles are taken from in-memory counts.
GROUPED_QUANTILE_BYTES = 64 << 20


def profilable(df: DataFrame) -> list[str]:
    """Columns with atomic values, in order."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def compared_columns(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Explicit columns, else those of both snapshots in the order of the first."""
    if columns is not None:
        for side, df in (("before", before), ("after", after)):
            if missing := [c for c in columns if c not in df.columns]:
                raise EngineError(f"unknown column(s) in the {side} snapshot: {', '.join(missing)}")
        return list(columns)
    there = set(profilable(after))
    return [c for c in profilable(before) if c in there]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_ord, value, n): how often each value occurs, as text; nulls are left out.

    Columns are grouped in the type they have (whole numbers, floats, text), so that
    only distinct values are turned into text.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    parts: dict[str, list[Column]] = {"bigint": [], "double": [], "string": []}
    for i, c in enumerate(columns):
        whole = isinstance(kinds[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        to = "bigint" if whole else "double" if isinstance(kinds[c], T.DoubleType) else "string"
        parts[to].append(F.struct(F.lit(i).alias("column_ord"), _quoted(c).cast(to).alias("value")))
    out = None
    for to, items in parts.items():
        if items:
            long = df.select(*by, F.explode(F.array(*items)).alias("x")).select(*by, "x.column_ord", "x.value").filter("value IS NOT NULL")
            counted = long.groupBy(*by, "column_ord", "value").agg(F.count(F.lit(1)).alias("n"))
            counted = counted.withColumn("value", F.col("value").cast("string"))
            out = counted if out is None else out.unionByName(counted)
    if out is None:
        raise EngineError("no column to profile")
    return out


def sorted_quantiles(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = C.QUANTILES) -> DataFrame:
    """(keys, q): exact, linearly interpolated quantiles of ``values`` (keys, v, n) with weights n.

    Distinct values are sorted by range partitions; running counts within partitions
    and their offsets give each value's ranks. No task holds more than its partition.
    """
    rows = written(values.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"))
    across = Window.partitionBy(*keys).orderBy("part")
    offset = F.coalesce(F.sum("part_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("offset", offset).withColumn("total", F.sum("part_n").over(Window.partitionBy(*keys)))
    rows = rows.join(sums.drop("part_n"), [*keys, "part"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("after", F.col("offset") + upto)
    q = []
    aggs = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("total") - 1)
        for name, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("after") - F.col("n") <= at) & (at < F.col("after"))
            aggs.append(F.max(F.when(here, F.col("v"))).alias(f"{name}{i}"))
        rank = F.lit(float(p)) * (F.col("total") - 1)
        q.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (rank - F.floor(rank)))
    return rows.groupBy(*keys).agg(F.max("total").alias("total"), *aggs).select(*keys, F.array(*q).alias("q"))


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    top_k: int = C.TOP_K,
    asset: str | Column = "",
    side: str = "",
    by: Sequence[str] = (),
    quantiles: str = "auto",
) -> DataFrame:
    """Profiles of the columns of ``df``, one row for each (and each group of ``by``).

    quantiles: "grouped" counts distinct values in memory, "sorted" sorts them over
    the cluster; both are exact. "auto" decides by the estimated size of the input.
    """
    columns = [c for c in profilable(df) if c not in by] if columns is None else list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise EngineError(f"unknown column(s): {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in df.schema}
    grouped = quantiles == "grouped" or quantiles == "auto" and _estimated_bytes(df) <= GROUPED_QUANTILE_BYTES
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        aggs.append(F.count(_quoted(c)).alias(f"n{i}"))
        if _is_numeric(kinds[c]):
            v = finite(_quoted(c))
            aggs += [F.count(v).alias(f"f{i}"), F.avg(v).alias(f"mean{i}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"sd{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
            if grouped:
                aggs.append(F.percentile(v, F.array(*[F.lit(p) for p in C.QUANTILES])).alias(f"q{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    items = []
    for i, c in enumerate(columns):
        numeric = F.lit(None).cast(NUMERIC)
        if _is_numeric(kinds[c]):
            q = F.col(f"q{i}") if grouped else F.lit(None).cast("array<double>")
            parts = [F.col(f"f{i}").alias("count"), F.col(f"mean{i}").alias("mean"), F.col(f"sd{i}").alias("stddev"), F.col(f"lo{i}").alias("minimum"), F.col(f"hi{i}").alias("maximum"), q.alias("q")]
            numeric = F.when(F.col(f"f{i}") > 0, F.struct(*parts)).cast(NUMERIC)
        items.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("column_ord"), F.col("row_count"), (F.col("row_count") - F.col(f"n{i}")).alias("null_count"), numeric.alias("numeric")))
    stats = wide.select(*by, F.explode(F.array(*items)).alias("s")).select(*by, "s.*")

    freq = frequencies(df, columns, by)
    keys = [*by, "column_ord"]
    distinct = freq.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_count"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value"))
    top = freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    top = top.select(*keys, F.struct("rank", "value", "n").alias("entry"))
    # The parts meet in one grouping, a row or a few of each for a column.
    parts = [stats.select(*keys, F.struct("column", "row_count", "null_count", "numeric").alias("stats")), distinct, top]
    if not grouped and any(_is_numeric(kinds[c]) for c in columns):
        numbers = [i for i, c in enumerate(columns) if _is_numeric(kinds[c])]
        values = freq.filter(F.col("column_ord").isin(numbers)).withColumn("v", finite(F.col("value"))).filter("v IS NOT NULL")
        parts.append(sorted_quantiles(values.select(*keys, "v", "n"), keys))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    only = lambda c: F.first(c, ignorenulls=True).alias(c)
    sorted_ = [only("q")] if "q" in rows.columns else []
    out = rows.groupBy(*keys).agg(only("stats"), F.sum("distinct_count").alias("distinct_count"), F.sort_array(F.collect_list("entry")).alias("entries"), *sorted_)
    out = out.filter("stats IS NOT NULL").select(*keys, "stats.*", "distinct_count", F.map_from_entries(F.transform("entries", lambda x: F.struct(x["value"], x["n"]))).alias("top_k"), *[c for c in ("q",) if sorted_])
    if sorted_:
        out = out.withColumn("numeric", F.when(F.col("numeric").isNotNull(), F.col("numeric").withField("q", F.col("q")))).drop("q")
    empty = F.create_map().cast("map<string,bigint>")
    label = F.lit(asset) if isinstance(asset, str) else asset
    return out.select(
        label.alias("asset"),
        F.lit(side).alias("side"),
        *by,
        "column",
        "column_ord",
        "row_count",
        "null_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        F.coalesce("top_k", empty).alias("top_k"),
        "numeric",
    )


def value_shares(profiles: DataFrame) -> DataFrame:
    """(asset, side, column, value, n, share) of the values in the profiles."""
    non_null = F.col("row_count") - F.col("null_count")
    rows = profiles.select("asset", "side", "column", non_null.alias("non_null"), F.explode("top_k").alias("value", "n"))
    return rows.withColumn("share", F.when(F.col("non_null") > 0, F.col("n") / F.col("non_null")).otherwise(0.0))


def coverage(profiles: DataFrame) -> DataFrame:
    """(asset, side, column, coverage): how much of the column the kept values make up."""
    non_null = F.col("row_count") - F.col("null_count")
    total = F.aggregate(F.map_values("top_k"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return profiles.select("asset", "side", "column", F.when(non_null > 0, total / non_null).otherwise(0.0).alias("coverage"))
