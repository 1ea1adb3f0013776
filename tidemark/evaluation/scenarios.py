"""Twelve labelled changes of small tables: what must fire, what must not, and what nearly does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.detect import detect
from tidemark.operators.profile import profile

#: The numeric scenarios start from 10, 11, ... 100, and again, this many rows.
RAMP_ROWS = 1000


@dataclass(frozen=True)
class Scenario:
    """``before`` and ``after`` count a column's values; a number's change is SQL over ``x``."""

    name: str
    column: str
    kind: str
    expected: str | None
    before: dict[str, int] | None = None
    after: dict[str, int] | str = ""

    @property
    def is_positive(self) -> bool:
        return self.expected is not None


_COUNTRY = {"US": 400, "UK": 200, "DE": 200, "FR": 200}
_STATUS = {"active": 600, "pending": 250, "closed": 150}
# The labelled scenarios.
SCENARIOS = (
    Scenario("value_substitution", "country", "positive", C.VALUE_SUBSTITUTION, _COUNTRY, {"US": 400, "United Kingdom": 200, "DE": 200, "FR": 200}),
    Scenario("case_format", "status", "positive", C.CASE_FORMAT, _STATUS, {"ACTIVE": 600, "PENDING": 250, "CLOSED": 150}),
    Scenario("split_merge", "category", "positive", C.SPLIT_MERGE, {"Electronics": 500, "Books": 300, "Toys": 200}, {"Consumer": 300, "Home": 200, "Books": 300, "Toys": 200}),
    Scenario("distribution_shift", "amount", "positive", C.DISTRIBUTION_SHIFT, None, "CASE WHEN x > 55 THEN x * 2 ELSE x END"),
    Scenario("unit_scale", "amount", "positive", C.UNIT_SCALE, None, "x * 100"),
    Scenario("stable_categories", "country", "negative", None, _COUNTRY, {"US": 398, "UK": 204, "DE": 199, "FR": 199}),
    Scenario("stable_numbers", "amount", "negative", None, None, "x + 4"),
    Scenario("stable_status", "status", "negative", None, _STATUS, {"active": 604, "pending": 248, "closed": 148}),
    Scenario("volume_doubled", "country", "decoy", None, _COUNTRY, {"US": 800, "UK": 400, "DE": 400, "FR": 400}),
    Scenario("small_new_category", "country", "decoy", None, _COUNTRY, {"US": 394, "UK": 197, "DE": 197, "FR": 197, "MX": 15}),
    Scenario("mild_tail", "amount", "decoy", None, None, "CASE WHEN x > 55 THEN x * 1.15D ELSE x END"),
    Scenario("mild_offset", "amount", "decoy", None, None, "x + 6"),
)


def scenario_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both sides (scenario, text, amount) of all scenarios."""

    def counted(side: str) -> DataFrame:
        rows = [(s.name, v, n) for s in SCENARIOS if s.before is not None for v, n in getattr(s, side).items()]
        rows = spark.createDataFrame(rows, "scenario string, text string, n int").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        return rows.select("scenario", "text", F.lit(None).cast("double").alias("amount"))

    ramp = spark.range(RAMP_ROWS).select((F.lit(10) + F.col("id") % 91).cast("double").alias("x"))
    before, after = counted("before"), counted("after")
    for s in SCENARIOS:
        if s.before is None:
            row = [F.lit(s.name).alias("scenario"), F.lit(None).cast("string").alias("text")]
            before = before.unionByName(ramp.select(*row, F.col("x").alias("amount")))
            after = after.unionByName(ramp.select(*row, F.expr(s.after).cast("double").alias("amount")))
    return before, after


def scenario_symptoms(spark: SparkSession, threshold: float = C.DISTRIBUTION_THRESHOLD, precedence: bool = True) -> DataFrame:
    """Symptoms of all scenarios, from one profile job a side."""
    b, a = (profile(df, ["text", "amount"], side=side, by=["scenario"]) for df, side in zip(scenario_frames(spark), ("before", "after")))
    return detect(b, a, by=["scenario"], threshold=threshold, precedence=precedence)


def evaluate_scenarios(spark: SparkSession, threshold: float = C.DISTRIBUTION_THRESHOLD) -> DataFrame:
    """(scenario, kind, expected, found, right): right if exactly what is expected fires."""
    labels = spark.createDataFrame([(s.name, s.kind, s.expected) for s in SCENARIOS], "scenario string, kind string, expected string")
    found = scenario_symptoms(spark, threshold).groupBy("scenario").agg(F.array_join(F.sort_array(F.collect_set("signature")), ",").alias("found"))
    out = labels.join(found, "scenario", "left").withColumn("found", F.coalesce("found", F.lit("")))
    return out.withColumn("right", F.col("found") == F.coalesce("expected", F.lit("")))
