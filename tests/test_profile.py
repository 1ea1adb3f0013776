import math

import pytest

from tidemark.errors import EngineError
from tidemark.plans.analyze import profile_column, profile_columns


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_counts_and_shares(spark):
    p = profile_column(frame(spark, ["UK", "UK", "US", "US", "US", None]), "v")
    assert (p.row_count, p.null_count, p.distinct_count) == (6, 1, 2)
    assert p.value_share("UK") == 0.4 and p.value_share("none") == 0.0 and p.numeric is None


def test_ties_at_the_cut_go_by_name(spark):
    assert set(profile_column(frame(spark, list("dcfaeb")), "v", top_k=2).top_k) == {"a", "b"}


@pytest.mark.parametrize("how", ["grouped", "sorted"])
def test_non_finite_values_are_left_out_of_numbers(spark, how):
    from tidemark.operators.profile import profile
    from tidemark.plans.analyze import to_profile

    values = [float(i) for i in range(1, 101)] + [math.nan, math.inf, -math.inf, None]
    p = to_profile(profile(frame(spark, values, "double"), quantiles=how).first())
    assert (p.row_count, p.null_count, p.distinct_count, p.numeric.count) == (104, 1, 103, 100)
    assert p.numeric.mean == 50.5 and p.numeric.maximum == 100.0 and p.numeric.median == 50.5
    assert p.numeric.quantiles["p05"] == pytest.approx(5.95)


def test_single_row_has_no_deviation(spark):
    assert profile_column(frame(spark, [5.0], "double"), "v").numeric.stddev == 0.0


@pytest.mark.parametrize("values", [[], [None, None], [math.nan, math.inf]])
def test_no_finite_value_no_statistics(spark, values):
    p = profile_column(frame(spark, values, "double"), "v")
    assert p.numeric is None and p.row_count == len(values)


def test_nested_columns_are_skipped_and_unknown_ones_rejected(spark):
    df = spark.createDataFrame([(1, [1.0], "a b")], "id long, e array<float>, `odd.name` string")
    assert list(profile_columns(df)) == ["id", "odd.name"]
    with pytest.raises(EngineError, match="nope"):
        profile_columns(df, ["nope"])


def test_partitioning_does_not_matter(spark):
    df = frame(spark, [str(i % 7) for i in range(500)])
    assert profile_column(df.repartition(1), "v") == profile_column(df.repartition(13), "v")
