"""Tables on which the detectors are tried, with the changes that are injected into them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.errors import EngineError
from tidemark.operators import inject
from tidemark.sources.files import read_snapshot


@dataclass(frozen=True)
class Recipe:
    """A change of one column that a signature must find."""

    signature: str
    column: str
    inject: Callable[[DataFrame], DataFrame]
    n: int = 2000


@dataclass(frozen=True)
class RealDataset:
    """A table, the columns that must stay silent between random halves, and the recipes. ``local`` ones are run on demand."""

    id: str
    domain: str
    load: Callable[[SparkSession], DataFrame]
    key: str
    columns: tuple[str, ...]
    recipes: tuple[Recipe, ...]
    local: bool = False


def split_by_parity(df: DataFrame, column: str, value: str, key: str) -> DataFrame:
    """A value's rows dealt to two new values, by whether the key is even."""
    half = F.when(F.col(key) % 2 == 0, value + "1").otherwise(value + "2")
    return df.withColumn(column, F.when(F.col(column) == value, half).otherwise(F.col(column)))


def build_registry(folder: str) -> list[RealDataset]:
    """The datasets below ``folder``, a Parquet file each, whether they can be read or not."""

    def at(name: str) -> Callable[[SparkSession], DataFrame]:
        return lambda spark: read_snapshot(spark, f"{folder}/{name}.parquet")

    orders = RealDataset(
        "orders",
        "retail",
        at("orders"),
        "o_orderkey",
        ("o_orderstatus", "o_orderpriority", "o_totalprice"),
        (
            Recipe(C.VALUE_SUBSTITUTION, "o_orderstatus", lambda d: inject.substitute(d, "o_orderstatus", "F", "FINAL")),
            Recipe(C.CASE_FORMAT, "o_orderpriority", lambda d: d.withColumn("o_orderpriority", F.lower("o_orderpriority"))),
            Recipe(C.SPLIT_MERGE, "o_orderstatus", lambda d: split_by_parity(d, "o_orderstatus", "F", "o_orderkey")),
            Recipe(C.UNIT_SCALE, "o_totalprice", lambda d: inject.scale(d, "o_totalprice", 100.0)),
            Recipe(C.DISTRIBUTION_SHIFT, "o_totalprice", lambda d: inject.stretch(d, "o_totalprice", 250000.0, 2.0)),
        ),
    )
    customers = RealDataset(
        "customer",
        "accounts",
        at("customer"),
        "c_custkey",
        ("c_mktsegment", "c_acctbal"),
        (
            Recipe(C.VALUE_SUBSTITUTION, "c_mktsegment", lambda d: inject.substitute(d, "c_mktsegment", "BUILDING", "CONSTRUCTION")),
            Recipe(C.CASE_FORMAT, "c_mktsegment", lambda d: d.withColumn("c_mktsegment", F.lower("c_mktsegment"))),
            Recipe(C.UNIT_SCALE, "c_acctbal", lambda d: inject.scale(d, "c_acctbal", 0.01)),
        ),
    )
    events = RealDataset(
        "events",
        "clickstream",
        at("events"),
        "event_id",
        ("event_type", "value"),
        (Recipe(C.VALUE_SUBSTITUTION, "event_type", lambda d: inject.substitute(d, "event_type", "click", "tap")),),
        local=True,
    )
    return [orders, customers, events]


def loadable(spark: SparkSession, registry: Sequence[RealDataset]) -> list[RealDataset]:
    """Those that can be read; the others are skipped, not errors."""
    out = []
    for dataset in registry:
        try:
            dataset.load(spark).schema
        except (EngineError, PySparkException):
            continue
        out.append(dataset)
    return out
