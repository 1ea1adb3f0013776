"""Rows drawn by hash: the same as by a sort of all hashes, with few of them moved."""

import hashlib

from pyspark.sql import functions as F
from tidemark.evaluation import dataset, runner
from tidemark.evaluation.registry import RealDataset, Recipe
from tidemark.operators import evaluate, inject


def first(keys, n, seed):
    return sorted((hashlib.md5(f"{k}-{seed}".encode()).hexdigest(), k) for k in keys)[:n]


def rows_moved(spark, run, kind="shuffleWriteRecords"):
    """Records that ``run`` writes for shuffles, or as another metric of stages has it."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        listed = store.stageList(None, False, False, none, None)
        return {(listed.apply(i).stageId(), listed.apply(i).attemptId()): getattr(listed.apply(i), kind)() for i in range(listed.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_splits_of_many_points_move_few_rows(spark):
    """Calibration data: sizes differ by point."""
    points = [("a", 700, "5"), ("b", 30, "6"), ("c", 4000, "7"), *((f"t{i}", 60, str(i)) for i in range(40))]
    df = spark.range(30000).withColumn("x", F.col("id") * 2)
    got = []
    assert rows_moved(spark, lambda: got.extend(dataset.keyed_splits(df, points, "id").collect())) < 30000
    for p, n, seed in points:
        own = sorted((r["place"], r["id"], r["x"], r["n"]) for r in got if r["point"] == p)
        assert own == [(i, k, 2 * k, n) for i, (_, k) in enumerate(first(range(30000), 2 * n, seed), 1)]


def test_splits_of_trials_move_few_rows(spark):
    df = spark.range(20000)
    got = []

    def run():
        for side in inject.two_sample_splits(df, 600, 10, "id", seed=3):
            got.append({(r["trial"], r["id"]) for r in side.collect()})

    assert rows_moved(spark, run) < 50000
    for t in range(10):
        drawn = [k for _, k in first(range(20000), 1200, t + 3)]
        assert {k for u, k in got[0] if u == t} == set(drawn[:600]) and {k for u, k in got[1] if u == t} == set(drawn[600:])


def test_keys_that_repeat(spark):
    """Hashes are few and uneven, so that the first bounds find too little."""
    rows = inject.first_drawn(spark.range(5000).selectExpr("id % 3 AS k", "id"), [(0, 100, "0"), (1, 4000, "1"), (2, 9000, "2")], "k", "trial").collect()
    for t, n in ((0, 100), (1, 4000), (2, 5000)):
        own = sorted((r["place"], r["k"]) for r in rows if r["trial"] == t)
        assert own == [(i, k) for i, (_, k) in enumerate(first([i % 3 for i in range(5000)], n, t), 1)]


def test_few_rows_and_none(spark):
    for n in (0, 1, 7):
        a, b = inject.two_sample_splits(spark.range(n), 5, 2, "id")
        assert a.count() + b.count() == 2 * n
    a, b = inject.two_sample_splits(spark.createDataFrame([(None,), (4,)], "id long"), 1, 1, "id")
    assert [r["id"] for r in a.collect()] == [None] and [r["id"] for r in b.collect()] == [4]


def test_registry_moves_few_rows(spark):
    df = spark.range(60000).selectExpr("id AS k", "CAST(id % 4 AS STRING) AS c")
    sets = [RealDataset("d", "x", lambda _: df, "k", ("c",), ())]
    assert rows_moved(spark, lambda: runner.run_registry(spark, sets, n=700, trials=10).rates.collect()) < 60000


def test_registry_draws_once_for_all_sizes(spark):
    """Halves of 300, 700 and 1000 rows are the first of one draw, and the checks those of draws of their own."""
    df = spark.range(20000).selectExpr("id AS k", "CAST(id % 4 AS STRING) AS c")
    change = lambda d: inject.substitute(d, "c", "1", "x")
    sets = [RealDataset("d", "x", lambda _: df, "k", ("c",), tuple(Recipe("value_substitution", "c", change, n) for n in (300, 1000)))]
    report = []
    # A trial writes the rows below the bound (2,374 are expected) and the 2,000 drawn.
    assert rows_moved(spark, lambda: report.append(runner.run_registry(spark, sets, n=700, trials=5)), "outputRecords") < 5 * 4600
    columns = ["trial", "hit", "confidence"]
    silent = evaluate.real_vs_real(df, ["c"], 700, 5, "k").selectExpr("trial", "n_fired > 0 AS hit", "confidence")
    assert sorted(report[0].checks.filter("kind = 'unchanged'").select(columns).collect()) == sorted(silent.collect())
    alone = [r for n in (300, 1000) for r in evaluate.injected_recall(df, [("value_substitution", "c", change)], n, 5, "k").select(columns).collect()]
    assert sorted(report[0].checks.filter("kind = 'injected'").select(columns).collect()) == sorted(alone)
