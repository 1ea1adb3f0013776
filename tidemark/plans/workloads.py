"""Further queries: file formats, prepared data, warehouse push-down, evaluation, calibration data, several assets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.evaluation import EvalReport, build_registry, calibration_dataset, default_grid, evaluate_blast_radius, evaluate_scenarios, false_positive_examples, run_registry
from tidemark.evaluation import dataset as D
from tidemark.evaluation.scenarios import RAMP_ROWS, SCENARIOS
from tidemark.operators import evaluate, inject, store
from tidemark.operators.lineage import lineage
from tidemark.plans import catalogue as K
from tidemark.plans import oracle as O
from tidemark.plans.analyze import AssetSnapshots, ChangeEvent, incidents_of, profiles_frame
from tidemark.plans.catalogue import query, table
from tidemark.scratch import scratch_root
from tidemark.sources.files import read_snapshot
from tidemark.sources.prepare import csv_to_parquet, subset_to_parquet
from tidemark.sources.warehouse import SparkDialect, SqlProfileSource, spark_executor


def _place(spark, suffix: str = "") -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}{suffix}"


# Files and prepared data ----------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_BY_STATUS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS priorities FROM orders {where} GROUP BY o_orderstatus"


def _by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("csv_scan", _BY_STATUS.format(where=""))
def csv_scan(spark, sf_dir):
    path = _place(spark, ".csv")
    table(spark, sf_dir, "orders").select(_ORDERS).write.option("header", True).csv(path)
    return _by_status(read_snapshot(spark, path))


@query("ndjson_scan", _BY_STATUS.format(where=""))
def ndjson_scan(spark, sf_dir):
    path = _place(spark, ".ndjson")
    table(spark, sf_dir, "orders").select(_ORDERS).write.json(path)
    return _by_status(read_snapshot(spark, path))


@query("csv_to_filtered_parquet", _BY_STATUS.format(where="WHERE o_totalprice > 200000 AND o_orderpriority <> '5-LOW'"))
def csv_to_filtered_parquet(spark, sf_dir):
    path = _place(spark, ".csv")
    table(spark, sf_dir, "orders").select(_ORDERS).write.option("header", True).csv(path)
    return _by_status(csv_to_parquet(spark, path, _place(spark), "o_totalprice > 200000 AND o_orderpriority != '5-LOW'"))


@query("seeded_subset", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-7'), o_orderkey LIMIT 500")
def seeded_subset(spark, sf_dir):
    return subset_to_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _place(spark), 500, "o_orderkey", seed=7)


@query(
    "literal_frames",
    "SELECT 'ramp' AS name, CAST(x AS VARCHAR) AS value, count(*) AS n FROM (SELECT 10 + i % 91 AS x FROM range(0, 1000) AS t(i)) GROUP BY ALL "
    "UNION ALL SELECT 'categorical', v, n FROM (VALUES ('US', 40), ('UK', 20), ('DE', 1)) AS c(v, n) "
    "UNION ALL SELECT 'orders', CASE WHEN i < 280 THEN 'UK' ELSE ['US', 'DE', 'FR', 'IN', 'BR'][(i - 280) % 5 + 1] END, count(*) FROM range(0, 1000) AS t(i) GROUP BY ALL",
)
def literal_frames(spark, sf_dir):
    ramp = inject.ramp(spark, "x", 1000).select(F.lit("ramp").alias("name"), F.col("x").cast("int").cast("string").alias("value"))
    named = inject.categorical(spark, "value", {"US": 40, "UK": 20, "DE": 1}).select(F.lit("categorical").alias("name"), "value")
    made = inject.orders(spark, 1000, 0.28).select(F.lit("orders").alias("name"), F.col("country").alias("value"))
    return ramp.unionByName(named).unionByName(made).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("partial_rename", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= ceil(0.3 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'FINAL' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY ALL")
def partial_rename(spark, sf_dir):
    df = inject.rename_part(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "FINAL", 0.3, "o_orderkey")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


# Push-down --------------------------------------------------------------------------------

_PUSHED = ["o_orderkey", "o_totalprice"]


@query("pushdown_profile", O.stats_sql("orders", _PUSHED))
def pushdown_profile(spark, sf_dir):
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(name)
    source = SqlProfileSource(spark_executor(spark), name, dialect=SparkDialect)
    return K.stats_rows(profiles_frame(spark, source.profile(_PUSHED)))


@query("pushdown_topk", O.topk_sql("orders", "o_orderpriority"))
def pushdown_topk(spark, sf_dir):
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(name)
    profiles = profiles_frame(spark, SqlProfileSource(spark_executor(spark), name, dialect=SparkDialect).profile(["o_orderpriority"]))
    return K.value_shares(profiles).select("column", "value", "n", F.round("share", 6).alias("share"))


# Evaluation -------------------------------------------------------------------------------


def _scenario_rows() -> str:
    """SQL of (g, side, col, v, d) for all scenarios."""
    parts = []
    for s in SCENARIOS:
        if s.before is None:
            for side, value in ((0, "x"), (1, s.after.replace("1.15D", "1.15"))):
                y = f"(SELECT CAST({value} AS DOUBLE) AS y FROM (SELECT CAST(10 + i % 91 AS DOUBLE) AS x FROM range(0, {RAMP_ROWS}) AS t(i)))"
                parts.append(f"SELECT '{s.name}' AS g, {side} AS side, 'amount' AS col, CAST(y AS VARCHAR) AS v, y AS d FROM {y}")
        else:
            for side, counts in ((0, s.before), (1, s.after)):
                values = ", ".join(f"('{v}', {n})" for v, n in counts.items())
                parts.append(f"SELECT '{s.name}' AS g, {side} AS side, 'text' AS col, v, CAST(NULL AS DOUBLE) AS d FROM (VALUES {values}) AS c(v, n), range(0, n)")
    return " UNION ALL ".join(parts)


_LABELS = ", ".join(f"('{s.name}', '{s.kind}', {K._quoted_sql(s.expected) if s.expected else 'NULL'})" for s in SCENARIOS)


@query("scenarios_found", f"WITH {O.grouped_signatures_sql(_scenario_rows())}, l(scenario, kind, expected) AS (VALUES {_LABELS}) SELECT scenario, kind, expected, coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature), '') AS found, coalesce(string_agg(DISTINCT signature, ',' ORDER BY signature), '') = coalesce(expected, '') AS \"right\" FROM l LEFT JOIN fired ON g = scenario GROUP BY scenario, kind, expected")
def scenarios_found(spark, sf_dir):
    return evaluate_scenarios(spark)


_LEVELS = ", ".join(f"('{c}', '{s}')" for c, *_, s in K.cases.BLAST_CASES)


@query(
    "blast_radius_accuracy",
    K._BLAST_SQL
    + ", w(c, id) AS (VALUES "
    + K._blast_values([(c, x) for c, _, _, _, xs, _ in K.cases.BLAST_CASES for x in xs])
    + f"), lv(c, s) AS (VALUES {_LEVELS}), n AS (SELECT count(*) FILTER (w.id IS NOT NULL AND h.unique_id IS NOT NULL) AS tp, count(*) FILTER (w.id IS NULL) AS fp, count(*) FILTER (h.unique_id IS NULL) AS fn FROM hit h FULL JOIN w ON w.c = h.c AND w.id = h.unique_id) "
    "SELECT tp, fp, fn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, (SELECT avg(CASE WHEN ['low', 'medium', 'high', 'critical'][rank] = lv.s THEN 1.0 ELSE 0.0 END) FROM inc JOIN lv ON lv.c = inc.c) AS severity_accuracy FROM n",
)
def blast_radius_accuracy(spark, sf_dir):
    return evaluate_blast_radius(spark)


def _drawn(name: str, source: str, key: str, columns: list[str], points: str, n: str) -> str:
    """CTE of the rows drawn for each point (p, seed): the first 2n, and their place."""
    order = f"md5(CAST({key} AS VARCHAR) || '-' || seed), {key}"
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT p, {n} AS n, {key} AS k, {', '.join(columns)}, row_number() OVER (PARTITION BY p ORDER BY {order}) AS place FROM {source}, {points}) WHERE place <= 2 * n)"


def _long(g: str, source: str, columns: dict[str, str], numbers: set[str], where: str, side: int) -> list[str]:
    return [f"SELECT {g} AS g, {side} AS side, '{c}' AS col, CAST(y AS VARCHAR) AS v, {'CAST(y AS DOUBLE)' if c in numbers else 'CAST(NULL AS DOUBLE)'} AS d FROM (SELECT p, {e} AS y FROM {source} WHERE {where})" for c, e in columns.items()]


#: (dataset, domain, key, columns, numbers, recipes as (signature, column, SQL))
_EVALUATED = [
    (
        "orders",
        "retail",
        "o_orderkey",
        ["o_orderstatus", "o_orderpriority", "o_totalprice"],
        {"o_totalprice"},
        [(s, c, sql) for s, c, _, sql in K._RECIPES],
    ),
    (
        "customer",
        "accounts",
        "c_custkey",
        ["c_mktsegment", "c_acctbal"],
        {"c_acctbal"},
        [
            (C.VALUE_SUBSTITUTION, "c_mktsegment", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END"),
            (C.CASE_FORMAT, "c_mktsegment", "lower(c_mktsegment)"),
            (C.UNIT_SCALE, "c_acctbal", "c_acctbal * 0.01"),
        ],
    ),
]
_EVAL_TRIALS = 30


def _registry_sql() -> str:
    ctes, rows, asked = [], [], []
    points = f"(SELECT t AS p, CAST(t AS VARCHAR) AS seed FROM (SELECT unnest(range(0, {_EVAL_TRIALS})) AS t))"
    for name, domain, key, columns, numbers, recipes in _EVALUATED:
        for kind, n in (("u", 1000), ("i", 2000)):
            ctes.append(_drawn(f"{kind}_{name}", name, key, columns, points, f"least({n}, (SELECT count(*) // 2 FROM {name}))"))
        same = {c: c for c in columns}
        for side, where in ((0, "place <= n"), (1, "place > n")):
            rows += _long(f"'{name}/unchanged/' || p", f"u_{name}", same, numbers, where, side)
            for s, c, sql in recipes:
                rows += _long(f"'{name}/{s}/' || p", f"i_{name}", {c: sql if side else c}, numbers, where, side)
        asked += [f"SELECT '{name}' AS dataset, '{domain}' AS domain, 'unchanged' AS kind, '{name}/unchanged/' || t AS g, '{c}' AS col, NULL AS signature FROM range(0, {_EVAL_TRIALS}) AS r(t)" for c in columns]
        asked += [f"SELECT '{name}', '{domain}', 'injected', '{name}/{s}/' || t, '{c}', '{s}' FROM range(0, {_EVAL_TRIALS}) AS r(t)" for s, c, _ in recipes]
    hit = "EXISTS (SELECT 1 FROM fired f WHERE f.g = a.g AND f.col = a.col AND (a.signature IS NULL OR f.signature = a.signature))"
    return (
        f"WITH {', '.join(ctes)}, {O.grouped_signatures_sql(' UNION ALL '.join(rows))}, a AS ({' UNION ALL '.join(asked)}), h AS (SELECT dataset, domain, kind, CASE WHEN {hit} THEN 1.0 ELSE 0.0 END AS hit FROM a) "
        "SELECT dataset, domain, coalesce(avg(hit) FILTER (kind = 'injected'), 0) AS recall, coalesce(avg(hit) FILTER (kind = 'unchanged'), 0) AS fp_rate FROM h GROUP BY GROUPING SETS ((dataset, domain), ())"
    )


@query("registry_rates", _registry_sql())
def registry_rates(spark, sf_dir):
    return run_registry(spark, build_registry(sf_dir), trials=_EVAL_TRIALS).rates


_TINY, _TINY_TRIALS = 40, 60
_TINY_SQL = (
    "WITH "
    + _drawn("x", "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"], f"(SELECT t AS p, CAST(t AS VARCHAR) AS seed FROM (SELECT unnest(range(0, {_TINY_TRIALS})) AS t))", str(_TINY))
    + ", "
    + O.grouped_signatures_sql(" UNION ALL ".join(r for side, where in ((0, "place <= n"), (1, "place > n")) for r in _long("p", "x", {c: c for c in ("o_orderstatus", "o_orderpriority", "o_totalprice")}, {"o_totalprice"}, where, side)))
)


@query("false_positive_examples", _TINY_SQL + " SELECT DISTINCT 'orders' AS dataset, col AS \"column\", CAST(g AS INT) AS trial FROM fired ORDER BY 2, 3 LIMIT 10")
def first_false_positives(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = evaluate.real_vs_real(df, ["o_orderstatus", "o_orderpriority", "o_totalprice"], _TINY, _TINY_TRIALS, "o_orderkey")
    checks = rows.select(F.lit("orders").alias("dataset"), F.lit("retail").alias("domain"), F.lit("unchanged").alias("kind"), "column", "trial", (F.col("n_fired") > 0).alias("hit"), "confidence")
    return false_positive_examples(EvalReport(checks).checks).select("dataset", "column", "trial")


# Calibration data ---------------------------------------------------------------------------

_GRID_VALUES = [("o_orderpriority", "1-URGENT"), ("o_orderstatus", "F")]
_NEGATIVE_COLUMNS = ["o_orderpriority", "o_orderstatus", "o_totalprice"]


def _calibration_sql() -> str:
    grid = default_grid(_GRID_VALUES)
    columns = list(dict.fromkeys(g.column for g in grid))
    positive = ", ".join(f"('p{i:04d}', {g.n}, '{D.POSITIVE_SEED + i}')" for i, g in enumerate(grid))
    negative = ", ".join(f"('n{j:02d}-{t:03d}', {n}, '{D.NEGATIVE_SEED + D.NEGATIVE_STEP * j + t}')" for j, n in enumerate(D.NEGATIVE_SIZES) for t in range(D.NEGATIVE_TRIALS))
    ctes = [_drawn("pos", "orders", "o_orderkey", columns, f"(VALUES {positive}) AS pt(p, n, seed)", "n"), _drawn("neg", "orders", "o_orderkey", _NEGATIVE_COLUMNS, f"(VALUES {negative}) AS pt(p, n, seed)", "n")]
    rows = []
    for i, g in enumerate(grid):
        c, p = g.column, f"p{i:04d}"
        rows += _long("p", "pos", {c: c}, set(), f"p = '{p}' AND place <= n", 0)
        ranked = f"(SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY place) AS r, count(*) OVER (PARTITION BY {c}) AS m FROM pos WHERE p = '{p}' AND place > n)"
        rows += _long("p", ranked, {c: f"CASE WHEN {c} = '{g.from_value}' AND r <= ceil(CAST({g.fraction} AS DOUBLE) * m) THEN '{g.to_value}' ELSE {c} END"}, set(), "true", 1)
    for side, where in ((0, "place <= n"), (1, "place > n")):
        rows += _long("p", "neg", {c: c for c in _NEGATIVE_COLUMNS}, {"o_totalprice"}, where, side)
    rows.append(_scenario_rows())
    positives = ", ".join(f"'{s.name}'" for s in SCENARIOS if s.is_positive)
    label = f"CASE WHEN g IN ({positives}) OR g LIKE 'p____' THEN 1 ELSE 0 END"
    return f"WITH {', '.join(ctes)}, {O.grouped_signatures_sql(' UNION ALL '.join(rows))} SELECT g AS point, col AS \"column\", signature, CAST({label} AS INT) AS label FROM every"


@query("calibration_rows", _calibration_sql())
def calibration_rows(spark, sf_dir):
    rows = calibration_dataset(table(spark, sf_dir, "orders"), "o_orderkey", default_grid(_GRID_VALUES), _NEGATIVE_COLUMNS)
    return rows.select("point", "column", "signature", "label")


# Incidents of several assets, list of incidents ------------------------------------------------

_RENAMES = {"customer": ("c_mktsegment", "BUILDING", "CONSTRUCTION"), "orders": ("o_orderstatus", "F", "FINAL"), "part": ("p_type", "SMALL", "TINY")}
_RENAMED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS run, * FROM ({O.value_substitution_sql(f'SELECT * FROM {t}', f'SELECT * REPLACE (CASE WHEN {c} = {K._quoted_sql(a)} THEN {K._quoted_sql(b)} ELSE {c} END AS {c}) FROM {t}', c)})" for t, (c, a, b) in _RENAMES.items()
)


@query("multi_asset_incidents", f"{K._REACH_SQL}, s AS ({_RENAMED_SQL}) SELECT run, \"column\", signature, magnitude, from_value, to_value, 'deploy-' || run AS change_id, CASE WHEN magnitude < 0.1 THEN 'low' WHEN EXISTS (SELECT 1 FROM r WHERE src = run) THEN 'high' ELSE 'medium' END AS severity, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM r WHERE src = run), '') AS affected FROM s")
def multi_asset_incidents(spark, sf_dir):
    from datetime import datetime

    assets = []
    for name, (column, old, new) in _RENAMES.items():
        df = table(spark, sf_dir, name)
        changes = [ChangeEvent(f"deploy-{name}", datetime(2026, 1, 2, 9), [name], "rename")]
        assets.append(AssetSnapshots(name, df, inject.substitute(df, column, old, new), changes, [column], datetime(2026, 1, 2, 10)))
    found = incidents_of(assets, lineage(spark, K._EDGES))
    worst = [F.col(f"worst.{c}").alias(c) for c in ("column", "signature")]
    return found.select("run", *worst, F.round("worst.magnitude", 6).alias("magnitude"), F.col("worst.from_value").alias("from_value"), F.col("worst.to_value").alias("to_value"), "change_id", "severity", F.array_join("affected", ",").alias("affected"))


_RANK_SQL = "list_position(['low', 'medium', 'high', 'critical'], severity)"


@query("incident_list", K._HISTORY_SQL + f"SELECT 'severity' AS list, identity_key, row_number() OVER (ORDER BY {_RANK_SQL} DESC, last_detected_at DESC NULLS LAST, identity_key) AS place FROM h UNION ALL SELECT 'recent', identity_key, row_number() OVER (ORDER BY last_detected_at DESC NULLS LAST, identity_key) FROM h WHERE severity = 'high'")
def incident_lists(spark, sf_dir):
    rows = K._history(spark)
    a = store.incident_list(rows).withColumn("list", F.lit("severity"))
    b = store.incident_list(rows, severity="high", order="recent").withColumn("list", F.lit("recent"))
    return a.unionByName(b).select("list", "identity_key", F.col("place").cast("long").alias("place"))


# Windows of a table, as the stream has them ------------------------------------------------------

_DAYS_SQL = "SELECT date_trunc('day', ts) AS start, count(*) AS row_count, count(*) - count(event_type) AS null_count, count(DISTINCT event_type) AS distinct_count FROM events GROUP BY 1"


@query("window_profiles", _DAYS_SQL)
def window_profile_counts(spark, sf_dir):
    from tidemark.streaming.drift import window_counts, window_profiles

    counts = window_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return window_profiles(counts, "event_type").select("start", "row_count", "null_count", "distinct_count")
