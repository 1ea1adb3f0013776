"""The engine's operators applied to the standard tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.evaluation import cases
from tidemark.operators import calibration, evaluate, inject, rca, store
from tidemark.operators.detect import detect, detect_pairs, pair, quantile_distance, with_confidence
from tidemark.operators.lineage import EDGE, lineage, with_criticality
from tidemark.operators.profile import compared_columns, coverage, frequencies, profile, sorted_quantiles, value_shares
from tidemark.plans import oracle as O
from tidemark.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stats_rows(profiles: DataFrame) -> DataFrame:
    q = [F.round(F.get("numeric.q", F.lit(i)), 6).alias(n) for i, n in enumerate(C.QUANTILE_NAMES)]
    r = lambda c, digits=6: F.round(f"numeric.{c}", digits).alias(c)
    return profiles.select("column", "row_count", "null_count", "distinct_count", F.coalesce("numeric.count", F.lit(0)).alias("finite_count"), r("mean", 4), r("stddev", 4), r("minimum"), r("maximum"), *q)


def symptom_rows(symptoms: DataFrame) -> DataFrame:
    return symptoms.select("column", "signature", F.round("magnitude", 6).alias("magnitude"), "from_value", "to_value")


def compared(before: DataFrame, after: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    columns = compared_columns(before, after, columns)
    return detect(profile(before, columns, side="before"), profile(after, columns, side="after"), **options)


# Profiles -----------------------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_stats_lineitem", O.stats_sql("lineitem", _LINE))
def profile_stats_lineitem(spark, sf_dir):
    return stats_rows(profile(table(spark, sf_dir, "lineitem"), _LINE))


@query("profile_stats_orders", O.stats_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def profile_stats_orders(spark, sf_dir):
    return stats_rows(profile(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]))


@query("profile_sorted_quantiles", O.stats_sql("lineitem", ["l_extendedprice", "l_quantity"]))
def profile_sorted_quantiles(spark, sf_dir):
    return stats_rows(profile(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], quantiles="sorted"))


@query("profile_topk_events", O.topk_sql("events", "event_type"))
def profile_topk_events(spark, sf_dir):
    rows = value_shares(profile(table(spark, sf_dir, "events"), ["event_type"]))
    return rows.select("column", "value", "n", F.round("share", 6).alias("share"))


@query("profile_topk_discount", O.topk_sql("(SELECT CAST(CAST(l_discount AS DECIMAL(18, 2)) AS VARCHAR) AS l_discount FROM lineitem)", "l_discount", 3))
def profile_topk_discount(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("decimal(18,2)"))
    rows = value_shares(profile(df, ["l_discount"], top_k=3))
    return rows.select("column", "value", "n", F.round("share", 6).alias("share"))


_DIRTY = "(SELECT CASE event_id % 50 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN NULL ELSE value END AS value FROM events)"


@query("profile_nonfinite", O.stats_sql(_DIRTY, ["value"]))
def profile_nonfinite(spark, sf_dir):
    m = F.col("event_id") % 50
    dirty = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(float("-inf"))).when(m == 3, F.lit(None)).otherwise(F.col("value"))
    return stats_rows(profile(table(spark, sf_dir, "events").select(dirty.alias("value")), ["value"]))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query("profile_all_columns_long", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM part" for c in _PART))
def profile_all_columns_long(spark, sf_dir):
    return profile(table(spark, sf_dir, "part"), _PART).select("column", "row_count", "null_count", "distinct_count")


def _coverage_sql(t: str, c: str) -> str:
    return f"SELECT '{t}' AS asset, '{c}' AS \"column\", round((SELECT sum(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR) ORDER BY 1 DESC LIMIT 50)) / CAST(count({c}) AS DOUBLE), 6) AS coverage FROM {t}"


_COVERED = [("customer", "c_mktsegment"), ("customer", "c_name"), ("part", "p_size"), ("orders", "o_custkey"), ("documents", "text"), ("conversations", "role")]


@query("coverage_by_column", " UNION ALL ".join(_coverage_sql(t, c) for t, c in _COVERED))
def coverage_by_column(spark, sf_dir):
    out = None
    for t in dict.fromkeys(t for t, _ in _COVERED):
        rows = coverage(profile(table(spark, sf_dir, t), [c for x, c in _COVERED if x == t], asset=t))
        out = rows if out is None else out.unionByName(rows)
    return out.select("asset", "column", F.round("coverage", 6).alias("coverage"))


@query("quantiles_by_group", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for p, n in zip(C.QUANTILES, C.QUANTILE_NAMES)) + " FROM lineitem GROUP BY l_returnflag")
def quantiles_by_group(spark, sf_dir):
    freq = frequencies(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], ["l_returnflag"])
    rows = sorted_quantiles(freq.select("l_returnflag", F.col("value").cast("double").alias("v"), "n"), ["l_returnflag"])
    return rows.select("l_returnflag", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(C.QUANTILE_NAMES)])


# Signatures ---------------------------------------------------------------------------


def _every(before: str, after: str, column: str) -> str:
    """All signatures on one column, with precedence."""
    number = column in ("o_totalprice", "l_extendedprice")
    return f"SELECT * FROM ({O.all_signatures_sql(before, after, [] if number else [column], [column] if number else [])})"



@query("sig_value_substitution", _every("SELECT * FROM customer", "SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment) FROM customer", "c_mktsegment"))
def sig_value_substitution(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return symptom_rows(compared(df, inject.substitute(df, "c_mktsegment", "BUILDING", "CONSTRUCTION"), ["c_mktsegment"]))


_FEW = "SELECT * FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 120)"


@query("sig_value_substitution_silent_small_n", _every(_FEW, f"SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 5 = 0 THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment) FROM ({_FEW})", "c_mktsegment"))
def sig_value_substitution_silent_small_n(spark, sf_dir):
    df = table(spark, sf_dir, "customer").orderBy("c_custkey").limit(120)
    after = df.withColumn("c_mktsegment", F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 5 == 0), "CONSTRUCTION").otherwise(F.col("c_mktsegment")))
    return symptom_rows(compared(df, after, ["c_mktsegment"]))


@query("sig_case_format", _every("SELECT * FROM orders", "SELECT * REPLACE (lower(o_orderpriority) AS o_orderpriority) FROM orders", "o_orderpriority") + " UNION ALL " + _every("SELECT * FROM part", "SELECT * REPLACE (p_type || ' ' AS p_type) FROM part", "p_type"))
def sig_case_format(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    a = compared(o, o.withColumn("o_orderpriority", F.lower("o_orderpriority")), ["o_orderpriority"])
    b = compared(p, p.withColumn("p_type", F.concat("p_type", F.lit(" "))), ["p_type"])
    return symptom_rows(a.unionByName(b))


_SPLIT = "SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN CASE (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 2 WHEN 0 THEN 'P1' ELSE 'P2' END ELSE o_orderstatus END AS o_orderstatus) FROM orders"


@query("sig_split", _every("SELECT * FROM orders", _SPLIT, "o_orderstatus"))
def sig_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return symptom_rows(compared(df, inject.split_category(df, "o_orderstatus", "P", ["P1", "P2"], "o_orderkey"), ["o_orderstatus"]))


@query("sig_merge", _every("SELECT * FROM part", "SELECT * REPLACE (CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'COMPACT' ELSE p_type END AS p_type) FROM part", "p_type"))
def sig_merge(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    after = inject.substitute(inject.substitute(df, "p_type", "SMALL", "COMPACT"), "p_type", "MEDIUM", "COMPACT")
    return symptom_rows(compared(df, after, ["p_type"]))


@query("sig_distribution_shift", _every("SELECT * FROM orders", "SELECT * REPLACE (CASE WHEN o_totalprice > 250000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM orders", "o_totalprice"))
def sig_distribution_shift(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return symptom_rows(compared(df, inject.stretch(df, "o_totalprice", 250000.0, 2.0), ["o_totalprice"]))


@query("sig_unit_scale_mult", _every("SELECT * FROM lineitem", "SELECT * REPLACE (l_extendedprice * 100 AS l_extendedprice) FROM lineitem", "l_extendedprice"))
def sig_unit_scale_mult(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return symptom_rows(compared(df, inject.scale(df, "l_extendedprice", 100.0), ["l_extendedprice"]))


@query("sig_unit_scale_add", _every("SELECT * FROM orders", "SELECT * REPLACE (o_totalprice + 200000 AS o_totalprice) FROM orders", "o_totalprice"))
def sig_unit_scale_add(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return symptom_rows(compared(df, inject.scale(df, "o_totalprice", 1.0, 200000.0), ["o_totalprice"]))


_MANY = "SELECT * REPLACE (lower(o_orderpriority) AS o_orderpriority, o_totalprice * 100 AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'FINAL' ELSE o_orderstatus END AS o_orderstatus) FROM orders"


@query("precedence_all", O.all_signatures_sql("SELECT * FROM orders", _MANY, ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]))
def precedence_all(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    after = inject.substitute(inject.scale(df.withColumn("o_orderpriority", F.lower("o_orderpriority")), "o_totalprice", 100.0), "o_orderstatus", "F", "FINAL")
    return symptom_rows(compared(df, after, ["o_orderpriority", "o_orderstatus", "o_totalprice"]))


@query("time_window_drift", O.all_signatures_sql("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'", ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]) + " UNION ALL SELECT 'o_totalprice', 'rows', CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS VARCHAR), CAST(count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS VARCHAR) FROM orders")
def time_window_drift(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    columns = ["o_orderpriority", "o_orderstatus", "o_totalprice"]
    b, a = profile(df.filter(early), columns), profile(df.filter(~early), columns)
    rows = b.filter("column = 'o_totalprice'").select("column", F.col("row_count").alias("nb")).join(a.select("column", F.col("row_count").alias("na")), "column")
    rows = rows.select("column", F.lit("rows").alias("signature"), (F.col("nb") + F.col("na")).cast("double").alias("magnitude"), F.col("nb").cast("string").alias("from_value"), F.col("na").cast("string").alias("to_value"))
    return symptom_rows(detect(b, a)).unionByName(rows)


_SHARES = "SELECT '{c}' AS \"column\", value, round(n0 / CAST(sum(n0) OVER () AS DOUBLE), 6) AS share_before, round(n1 / CAST(sum(n1) OVER () AS DOUBLE), 6) AS share_after FROM (SELECT coalesce(b.v, a.v) AS value, coalesce(b.n, 0) AS n0, coalesce(a.n, 0) AS n1 FROM (SELECT {c} AS v, count(*) AS n FROM ({b}) GROUP BY 1) b FULL JOIN (SELECT {c} AS v, count(*) AS n FROM ({a}) GROUP BY 1) a USING (v))"


def _decoy(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Shares of both sides, and a row for each symptom: none if the change is silent."""
    b, a = profile(before, [column]), profile(after, [column])
    x, y = (value_shares(p).select("column", "value", F.round("share", 6).alias(n)) for p, n in ((b, "share_before"), (a, "share_after")))
    shares = x.join(y, ["column", "value"], "full_outer").fillna(0.0, ["share_before", "share_after"])
    fired = symptom_rows(detect(b, a)).select("column", F.col("signature").alias("value"), F.col("magnitude").alias("share_before"), F.col("magnitude").alias("share_after"))
    return shares.unionByName(fired)


@query("decoy_volume_doubled", _SHARES.format(c="event_type", b="SELECT * FROM events", a="SELECT * FROM events UNION ALL SELECT * FROM events"))
def decoy_volume_doubled(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return _decoy(df, df.unionByName(df), "event_type")


@query("decoy_new_small_category", _SHARES.format(c="event_type", b="SELECT * FROM events", a="SELECT * REPLACE (CASE WHEN event_id % 67 = 0 THEN 'novel' ELSE event_type END AS event_type) FROM events"))
def decoy_new_small_category(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return _decoy(df, df.withColumn("event_type", F.when(F.col("event_id") % 67 == 0, "novel").otherwise(F.col("event_type"))), "event_type")


# Evaluation ---------------------------------------------------------------------------

_BENT = {"steep": (250000, 2.0), "mild": (400000, 1.15), "none": (1e12, 1.0)}
_DIST = " UNION ALL ".join(f"SELECT '{k}' AS name, {'true' if k == 'steep' else 'false'} AS positive, d, least_n FROM (WITH {O.distance_sql('SELECT * FROM orders', f'SELECT * REPLACE (CASE WHEN o_totalprice > {p} THEN o_totalprice * {f} ELSE o_totalprice END AS o_totalprice) FROM orders', 'o_totalprice')} SELECT d, least_n FROM dist)" for k, (p, f) in _BENT.items())
_SWEPT = f"WITH x AS ({_DIST}), g AS (SELECT unnest(range(1, 61)) / 100.0 AS threshold), r AS (SELECT CAST(threshold AS DOUBLE) AS threshold, positive, d >= greatest(threshold, 3 * 0.38 / sqrt(least_n)) AS fired FROM x, g)"


def _outcomes(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    before = profile(df, ["o_totalprice"])
    rows = None
    for name, (pivot, factor) in _BENT.items():
        after = profile(inject.stretch(df, "o_totalprice", float(pivot), factor), ["o_totalprice"])
        part = pair(before, after).withColumn("positive", F.lit(name == "steep"))
        rows = part if rows is None else rows.unionByName(part)
    rows = evaluate.threshold_grid(rows.withColumn("distance", quantile_distance()))
    fired = F.coalesce(F.col("distance") >= F.greatest(F.col("threshold"), F.lit(C.SIGNIFICANCE_Z * C.QUANTILE_NOISE_SD) / F.sqrt(F.least("b.numeric.count", "c.numeric.count"))), F.lit(False))
    return rows.select("threshold", "positive", fired.alias("fired"))


@query("threshold_sweep", _SWEPT + " SELECT threshold, avg(CAST(fired AS INT)) FILTER (positive) AS recall, avg(CAST(fired AS INT)) FILTER (NOT positive) AS fp_rate FROM r GROUP BY threshold")
def threshold_sweep(spark, sf_dir):
    return evaluate.sweep(_outcomes(spark, sf_dir))


@query("operating_point", _SWEPT + ", s AS (SELECT threshold, avg(CAST(fired AS INT)) FILTER (positive) AS recall, avg(CAST(fired AS INT)) FILTER (NOT positive) AS fp_rate FROM r GROUP BY threshold), f AS (SELECT *, row_number() OVER (ORDER BY threshold) - 1 AS i, count(*) OVER () AS n FROM (SELECT * FROM s WHERE fp_rate <= 0 QUALIFY recall = max(recall) OVER ())) SELECT threshold, recall, fp_rate FROM f WHERE i = n // 2")
def operating_point(spark, sf_dir):
    return evaluate.operating_point(evaluate.sweep(_outcomes(spark, sf_dir)))


_TRIALS = 30
_TRIAL = "SELECT t.trial, o_orderstatus, row_number() OVER (PARTITION BY t.trial ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-', CAST(t.trial AS VARCHAR))), o_orderkey) AS place FROM orders, (SELECT unnest(range(0, 30)) AS trial) t"


@query("split_real_vs_real", f"SELECT CAST(trial AS INT) AS trial, half, o_orderstatus, count(*) AS n FROM (SELECT trial, o_orderstatus, CASE WHEN place <= 1000 THEN 'before' ELSE 'after' END AS half FROM ({_TRIAL}) WHERE place <= 2000) GROUP BY ALL")
def split_real_vs_real(spark, sf_dir):
    before, after = inject.two_sample_splits(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 1000, _TRIALS, "o_orderkey")
    both = before.withColumn("half", F.lit("before")).unionByName(after.withColumn("half", F.lit("after")))
    return both.groupBy("trial", "half", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _split_sql(table: str, columns: Sequence[str], key: str, n: int) -> str:
    """CTE x: the rows drawn for each trial with their place."""
    draw = f"row_number() OVER (PARTITION BY trial ORDER BY md5(concat(CAST({key} AS VARCHAR), '-', CAST(trial AS VARCHAR))), {key})"
    return f"x AS MATERIALIZED (SELECT * FROM (SELECT trial, {key} AS k, {', '.join(columns)}, {draw} AS place FROM {table}, (SELECT unnest(range(0, {_TRIALS})) AS trial)) WHERE place <= {2 * n})"


_RETURNED = ["l_returnflag", "l_linestatus", "l_quantity"]
_CHANCE = O.grouped_signatures_sql(" UNION ALL ".join(f"SELECT trial AS g, CAST(place > 1000 AS INT) AS side, '{c}' AS col, CAST({c} AS VARCHAR) AS v, {'CAST(' + c + ' AS DOUBLE)' if c == 'l_quantity' else 'CAST(NULL AS DOUBLE)'} AS d FROM x" for c in _RETURNED))


@query("real_vs_real_silent", f"WITH {_split_sql('lineitem', _RETURNED, 'l_orderkey * 10 + l_linenumber', 1000)}, {_CHANCE} SELECT CAST(t AS INT) AS trial, c AS \"column\", count(fired.signature) AS n_fired FROM (SELECT unnest(range(0, {_TRIALS})) AS t), (SELECT unnest({_RETURNED}) AS c) LEFT JOIN fired ON fired.g = t AND fired.col = c GROUP BY ALL")
def real_vs_real_silent(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return evaluate.real_vs_real(df, _RETURNED, 1000, _TRIALS, "key").select("trial", "column", "n_fired")


_RECIPES = [
    (C.VALUE_SUBSTITUTION, "o_orderstatus", lambda d: inject.substitute(d, "o_orderstatus", "F", "FINAL"), "CASE WHEN o_orderstatus = 'F' THEN 'FINAL' ELSE o_orderstatus END"),
    (C.CASE_FORMAT, "o_orderpriority", lambda d: d.withColumn("o_orderpriority", F.lower("o_orderpriority")), "lower(o_orderpriority)"),
    (
        C.SPLIT_MERGE,
        "o_orderstatus",
        lambda d: d.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "F1").otherwise("F2")).otherwise(F.col("o_orderstatus"))),
        "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN k % 2 = 0 THEN 'F1' ELSE 'F2' END ELSE o_orderstatus END",
    ),
    (C.UNIT_SCALE, "o_totalprice", lambda d: inject.scale(d, "o_totalprice", 100.0), "o_totalprice * 100"),
    (C.DISTRIBUTION_SHIFT, "o_totalprice", lambda d: inject.stretch(d, "o_totalprice", 250000.0, 2.0), "CASE WHEN o_totalprice > 250000 THEN o_totalprice * 2 ELSE o_totalprice END"),
]
_INJECTED = O.grouped_signatures_sql(
    " UNION ALL ".join(
        f"SELECT '{s}' || '/' || trial AS g, {side} AS side, '{c}' AS col, CAST(y AS VARCHAR) AS v, {'CAST(y AS DOUBLE)' if c == 'o_totalprice' else 'CAST(NULL AS DOUBLE)'} AS d FROM (SELECT trial, {value} AS y FROM x WHERE {where})"
        for s, c, _, sql in _RECIPES
        for side, value, where in ((0, c, "place <= 2000"), (1, sql, "place > 2000"))
    )
)
_HITS_SQL = f"WITH {_split_sql('orders', ['o_orderstatus', 'o_orderpriority', 'o_totalprice'], 'o_orderkey', 2000)}, {_INJECTED}, h AS (SELECT s AS dataset, t, max(CASE WHEN fired.signature IS NULL THEN 0 ELSE 1 END) AS hit FROM (SELECT unnest({[r[0] for r in _RECIPES]}) AS s), (SELECT unnest(range(0, {_TRIALS})) AS t) LEFT JOIN fired ON fired.g = s || '/' || t AND fired.signature = s GROUP BY s, t)"


@query("inject_recall", _HITS_SQL + " SELECT dataset, count(*) AS checks, CAST(sum(hit) AS BIGINT) AS hits, avg(hit) AS rate FROM h GROUP BY ROLLUP (dataset)")
def inject_recall(spark, sf_dir):
    return evaluate.pooled(evaluate.injected_recall(table(spark, sf_dir, "orders"), [r[:3] for r in _RECIPES], 2000, _TRIALS, "o_orderkey"))


# Lineage, root causes, incidents --------------------------------------------------------

_EDGES = [("raw", "clean"), ("clean", "fact"), ("fact", "revenue"), ("fact", "metrics"), ("revenue", "board"), ("metrics", "board"), ("side", "other"), ("region", "nation"), ("nation", "customer"), ("customer", "orders"), ("orders", "lineitem")]
_EDGE_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ")"
_REACH_SQL = f"WITH RECURSIVE {_EDGE_SQL}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
_EXPOSURES = [
    ("e.board", "board view", "dashboard", "high", None, "Ann", None, ["board"]),
    ("e.api", "price api", "application", "high", None, "Bo", None, ["revenue"]),
    ("e.nb", "notes", "notebook", "high", None, "", None, ["metrics"]),
    ("e.ovr", "override", "dashboard", "medium", "critical", "", None, ["other"]),
    ("e.ml", "model", "ml", None, None, "", None, ["metrics"]),
    ("e.dash", "plain", "dashboard", None, None, "", None, ["side"]),
    ("e.bad", "bad override", "analysis", "low", "urgent", "", None, ["side"]),
    ("e.app", "app", "application", "low", None, "", None, ["clean"]),
]
_EXPOSURE_SQL = "x(unique_id, name, type, maturity, meta, owner) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in e[:6]) + ")" for e in _EXPOSURES) + ")"
_DEPENDS_SQL = "dep(unique_id, parent) AS (VALUES " + ", ".join(f"('{e[0]}', '{p}')" for e in _EXPOSURES for p in e[7]) + ")"
_CRITICALITY_SQL = (
    "CASE WHEN lower(meta) IN ('low', 'medium', 'high', 'critical') THEN list_position(['low', 'medium', 'high', 'critical'], lower(meta)) "
    "WHEN type = 'application' AND maturity = 'high' THEN 4 WHEN type IN ('application', 'ml') THEN 3 "
    "WHEN type = 'dashboard' THEN CASE maturity WHEN 'low' THEN 1 WHEN 'high' THEN 3 ELSE 2 END WHEN type IN ('notebook', 'analysis') THEN 1 ELSE 2 END"
)


def _graph(spark):
    return lineage(spark, _EDGES, _EXPOSURES)


@query("lineage_closure", _REACH_SQL + " SELECT src, dst FROM r")
def lineage_closure(spark, sf_dir):
    return lineage(spark, _EDGES).reach


@query("lineage_upstream", _REACH_SQL + " SELECT src AS id FROM r WHERE dst = 'board'")
def lineage_upstream(spark, sf_dir):
    return lineage(spark, _EDGES).upstream("board")


@query("lineage_cycle", "WITH RECURSIVE e(src, dst) AS (VALUES ('a', 'b'), ('b', 'c'), ('c', 'a')), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r WHERE src <> dst")
def lineage_cycle(spark, sf_dir):
    return lineage(spark, [("a", "b"), ("b", "c"), ("c", "a")]).reach


@query("blast_radius", _REACH_SQL + f", {_EXPOSURE_SQL}, {_DEPENDS_SQL}, hit AS (SELECT DISTINCT x.* FROM x JOIN dep USING (unique_id) WHERE parent = 'fact' OR parent IN (SELECT dst FROM r WHERE src = 'fact')) SELECT type, CAST(count(*) AS BIGINT) AS exposures, CAST(max({_CRITICALITY_SQL}) AS INT) AS max_criticality FROM hit GROUP BY type")
def blast_radius(spark, sf_dir):
    found = _graph(spark).exposures_below(spark.createDataFrame([("fact",)], "id string"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("exposures"), F.max("criticality").alias("max_criticality"))


@query("data_nodes_below", _REACH_SQL + " SELECT DISTINCT dst AS id FROM r WHERE src = 'clean'")
def data_nodes_below(spark, sf_dir):
    return _graph(spark).data_nodes_below(spark.createDataFrame([("clean",)], "id string"))


@query("exposure_criticality", f"WITH {_EXPOSURE_SQL} SELECT unique_id, CAST({_CRITICALITY_SQL} AS INT) AS criticality FROM x")
def exposure_criticality(spark, sf_dir):
    return with_criticality(_graph(spark).exposures).select("unique_id", "criticality")


_FILES = [("fact", "model", "models/fact.sql"), ("dim", "model", "models/marts/dim.sql"), ("stage", "model", "./models/stage.sql")]
_COMMITS = [
    ("aaaaaaaa1", "2026-01-02 09:00:00", "fact and dim", ["models/fact.sql", "dbt/models/marts/dim.sql"]),
    ("bbbbbbbb2", "2026-01-01 09:00:00", "backslashes", ["dbt\\models\\stage.sql", "README.md"]),
    ("cccccccc3", "2026-01-03 09:00:00", "nothing known", ["docs/index.md", "xmodels/fact.sql"]),
    ("dddddddd4", "2026-01-01 09:00:00", "dots", ["./models/fact.sql"]),
]


def _quoted_sql(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


_COMMIT_SQL = (
    "n(id, path) AS (VALUES " + ", ".join(f"({_quoted_sql(a)}, ltrim({_quoted_sql(p)}, './'))" for a, _, p in _FILES) + "), "
    "c(sha, ts, subject, file) AS (VALUES " + ", ".join(f"({_quoted_sql(s)}, TIMESTAMP {_quoted_sql(t)}, {_quoted_sql(m)}, {_quoted_sql(f)})" for s, t, m, fs in _COMMITS for f in fs) + "), "
    "m AS (SELECT sha, ts, subject, id FROM (SELECT *, ltrim(replace(file, '\\', '/'), './') AS f FROM c) JOIN n ON f = path OR ends_with(f, '/' || path))"
)


def _commits(spark) -> DataFrame:
    rows = spark.createDataFrame(_COMMITS, "sha string, ts string, subject string, files array<string>")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _file_graph(spark):
    return lineage(spark, [("stage", "fact"), ("stage", "dim")], nodes=[(a, "data", k, p) for a, k, p in _FILES])


@query("change_events_from_commits", f"WITH {_COMMIT_SQL} SELECT substr(sha, 1, 7) AS change_id, ts, subject AS label, string_agg(DISTINCT id, ',' ORDER BY id) AS targets, CAST(row_number() OVER (ORDER BY ts, substr(sha, 1, 7)) - 1 AS INT) AS change_ord FROM m GROUP BY sha, ts, subject")
def change_events_from_commits(spark, sf_dir):
    return rca.derive_changes(_commits(spark), _file_graph(spark)).withColumn("targets", F.array_join("targets", ","))


_DECLARED = [("aaaaaaa", "2026-01-02 09:00:00", ["fact", "dim"], "declared twin"), ("manual", "2026-01-04 09:00:00", ["dim"], "by hand"), ("manual", "2026-01-04 09:00:00", ["dim"], "repeat")]


@query("changes_union_dedup", f"WITH {_COMMIT_SQL}, g AS (SELECT substr(sha, 1, 7) AS change_id, ts, subject AS label, string_agg(DISTINCT id, ',' ORDER BY id) AS targets, row_number() OVER (ORDER BY ts, substr(sha, 1, 7)) AS o FROM m GROUP BY sha, ts, subject), "
       "d(change_id, ts, targets, label, o) AS (VALUES " + ", ".join(f"('{i}', TIMESTAMP '{t}', '{','.join(sorted(x))}', '{b}', {k})" for k, (i, t, x, b) in enumerate(_DECLARED)) + "), "
       "b AS (SELECT change_id, ts, targets, label, 0 AS l, o FROM d UNION ALL SELECT change_id, ts, targets, label, 1, o FROM g) SELECT change_id, ts, targets, label FROM b QUALIFY row_number() OVER (PARTITION BY change_id, targets, ts ORDER BY l, o) = 1")
def changes_union_dedup(spark, sf_dir):
    derived = rca.derive_changes(_commits(spark), _file_graph(spark))
    out = rca.combine_changes(cases.change_rows(spark, _DECLARED), derived)
    return out.select("change_id", "ts", F.array_join(F.sort_array("targets"), ",").alias("targets"), "label")


@query("unknown_targets", "SELECT change_id, target FROM (VALUES ('x', 'fact'), ('x', 'nowhere'), ('y', 'dim'), ('y', 'gone')) AS c(change_id, target) WHERE target NOT IN (" + ", ".join(f"'{a}'" for a, _, _ in _FILES) + ")")
def unknown_targets(spark, sf_dir):
    return rca.unknown_targets(cases.change_rows(spark, [("x", "2026-01-01 00:00:00", ["fact", "nowhere"], ""), ("y", "2026-01-01 00:00:00", ["dim", "gone"], "")]), _file_graph(spark))


_CASE_SQL = (
    "WITH RECURSIVE e(c, src, dst) AS (VALUES " + ", ".join(f"('{c}', '{a}', '{b}')" for c, es, _, _ in cases.RCA_CASES for a, b in es) + "), "
    "r(c, src, dst) AS (SELECT c, src, dst FROM e UNION SELECT r.c, r.src, e.dst FROM r JOIN e ON r.c = e.c AND r.dst = e.src), "
    "o(c, asset) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, _, seen, _ in cases.RCA_CASES for a in seen) + "), "
    "h(c, change_id, ts, target) AS (VALUES " + ", ".join(f"('{c}', '{i}', TIMESTAMP '{cases.DAY.get(i, '2026-01-02')} {t}:00', '{x}')" for c, _, _, cs in cases.RCA_CASES for i, t, x in cs) + "), "
    "j AS (SELECT h.c, change_id, ts, asset, epoch(TIMESTAMP '2026-01-02 10:00:00') - epoch(ts) AS lead FROM h JOIN o USING (c) WHERE (asset = target OR EXISTS (SELECT 1 FROM r WHERE r.c = h.c AND src = target AND dst = asset))), "
    "s AS (SELECT j.c, change_id, ts, count(*) AS n, 0.6 * count(*) / (SELECT count(*) FROM o WHERE o.c = j.c) + 0.4 * avg(1 - lead / 86400) AS score, min(lead) AS min_lead FROM j WHERE lead BETWEEN 0 AND 86400 GROUP BY j.c, change_id, ts) "
)


@query("rca_rank", _CASE_SQL + "SELECT c AS \"case\", change_id, CAST(n AS BIGINT) AS n_explained, round(score, 6) AS score, CAST(min_lead AS DOUBLE) AS min_lead, CAST(row_number() OVER (PARTITION BY c ORDER BY score DESC, ts DESC) AS INT) AS rank FROM s")
def rca_rank(spark, sf_dir):
    ranked = rca.rank_root_causes(*cases.rca_tables(spark))
    return ranked.select("case", "change_id", "n_explained", F.round("score", 6).alias("score"), "min_lead", "rank")


@query("rca_cases_top1", _CASE_SQL + ", t AS (SELECT c, change_id FROM s WHERE c <> 'a_day_exactly' QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, ts DESC) = 1) SELECT count(*) AS cases, avg(CASE WHEN change_id = 'true' THEN 1.0 ELSE 0.0 END) AS top1 FROM t")
def rca_cases_top1(spark, sf_dir):
    top = rca.rank_root_causes(*cases.rca_tables(spark)).filter("rank = 1 AND case != 'a_day_exactly'")
    return top.agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("change_id") == "true").cast("double")).alias("top1"))


def _blast_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in rows)


#: inc(c, rank, exposures): the changed asset is the cause; what lies below it, and the observed asset, is affected.
_BLAST_SQL = (
    "WITH RECURSIVE e(c, src, dst) AS (VALUES " + _blast_values([(c, a, b) for c, es, *_ in cases.BLAST_CASES for a, b in es]) + "), "
    "x(c, unique_id, type, maturity, parent, meta, changed) AS (VALUES " + _blast_values([(c, i, k, m, p, o, changed) for c, _, (i, k, m, p, o), changed, _, _ in cases.BLAST_CASES]) + "), "
    "r(c, src, dst) AS (SELECT c, src, dst FROM e UNION SELECT r.c, r.src, e.dst FROM r JOIN e ON r.c = e.c AND r.dst = e.src), "
    "below AS (SELECT x.c, r.dst AS id FROM x JOIN r ON r.c = x.c AND r.src = x.changed), "
    "hit AS (SELECT x.* FROM x WHERE x.parent = x.changed OR EXISTS (SELECT 1 FROM below b WHERE b.c = x.c AND b.id = x.parent)), "
    f"inc AS (SELECT x.c, greatest(CASE WHEN EXISTS (SELECT 1 FROM below b WHERE b.c = x.c) THEN 3 ELSE 2 END, coalesce((SELECT max({_CRITICALITY_SQL}) FROM hit WHERE hit.c = x.c), 0)) AS rank, coalesce((SELECT string_agg(unique_id, ',') FROM hit WHERE hit.c = x.c), '') AS exposures FROM x)"
)


@query("severity_escalation", _BLAST_SQL + " SELECT c AS \"case\", ['low', 'medium', 'high', 'critical'][rank] AS severity, exposures FROM inc")
def severity_escalation(spark, sf_dir):
    found = F.array_join(F.transform(F.coalesce("exposures", F.array().cast("array<struct<order:int,name:string,unique_id:string,type:string,owner:string,criticality:int>>")), lambda e: e["unique_id"]), ",")
    return cases.blast_incidents(spark).select("case", "severity", found.alias("exposures"))


@query("eval_precision_recall", _BLAST_SQL + ", w(c, id) AS (VALUES " + _blast_values([(c, x) for c, _, _, _, xs, _ in cases.BLAST_CASES for x in xs]) + "), n AS (SELECT count(*) FILTER (w.id IS NOT NULL AND h.unique_id IS NOT NULL) AS tp, count(*) FILTER (w.id IS NULL) AS fp, count(*) FILTER (h.unique_id IS NULL) AS fn FROM hit h FULL JOIN w ON w.c = h.c AND w.id = h.unique_id) SELECT tp, fp, fn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall FROM n")
def eval_precision_recall(spark, sf_dir):
    found = cases.blast_incidents(spark).select("case", F.explode("exposures").alias("e")).select("case", F.col("e.unique_id").alias("id"))
    expected = spark.createDataFrame([(c, x) for c, _, _, _, xs, _ in cases.BLAST_CASES for x in xs], "case string, id string")
    return evaluate.set_scores(found, expected)


_RENAMED = "SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment) FROM customer"
_SUBSTITUTED = O.value_substitution_sql("SELECT * FROM customer", _RENAMED, "c_mktsegment")


def _observed_rename(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    found = compared(df, inject.substitute(df, "c_mktsegment", "BUILDING", "CONSTRUCTION"), ["c_mktsegment"])
    found = with_confidence(found)
    at = F.lit("2026-01-02 10:00:00").cast("timestamp_ntz")
    return found.select(F.lit("customer").alias("asset"), at.alias("observed_at"), F.lit(0).alias("obs_ord"), "column", "signature", "magnitude", "confidence", "from_value", "to_value", "significance_margin", "log10_n")


def _score_sql(magnitude: str, margin: str, log_n: str) -> str:
    z = " + ".join(f"{w!r} * (({x}) - {m!r}) / {s!r}" for w, x, m, s in zip(C.MODEL_WEIGHTS, (magnitude, margin, log_n), C.MODEL_MEANS, C.MODEL_STDS))
    return f"1 / (1 + exp(-({C.MODEL_INTERCEPT!r} + {z})))"


_MAGNITUDE_SQL = "(SELECT count(*) FILTER (c_mktsegment = 'BUILDING') / CAST(count(*) AS DOUBLE) AS m, CAST(count(*) AS DOUBLE) AS n FROM customer)"
_CONFIDENCE_SQL = _score_sql("m", "least(20, m / (3 * sqrt(m * (1 - m) * 2 / n)))", "log10(n)")


@query("confidence_score", f"SELECT round(m, 6) AS magnitude, round(least(20, m / (3 * sqrt(m * (1 - m) * 2 / n))), 6) AS significance_margin, round(log10(n), 6) AS log10_n, round({_CONFIDENCE_SQL}, 6) AS confidence FROM {_MAGNITUDE_SQL}")
def confidence_score(spark, sf_dir):
    return _observed_rename(spark, sf_dir).select(*[F.round(c, 6).alias(c) for c in ("magnitude", "significance_margin", "log10_n", "confidence")])


@query("incident_synthesis", f"SELECT 'customer' AS asset, x.\"column\", x.signature, x.magnitude, x.from_value, x.to_value, 'deploy-7' AS change_id, 'high' AS severity, 'lineitem,orders' AS affected, round({_CONFIDENCE_SQL}, 6) AS confidence, TIMESTAMP '2026-01-02 10:00:00' AS detected_at FROM ({_SUBSTITUTED}) x, {_MAGNITUDE_SQL}")
def incident_synthesis(spark, sf_dir):
    changes = cases.change_rows(spark, [("deploy-7", "2026-01-02 09:30:00", ["customer"], "rename segments"), ("deploy-6", "2025-12-30 09:00:00", ["nation"], "old"), ("deploy-5", "2026-01-02 09:45:00", ["side"], "elsewhere")])
    found = rca.incidents(_observed_rename(spark, sf_dir), changes, lineage(spark, _EDGES))
    w = lambda c: F.col(f"worst.{c}").alias(c)
    return found.select(w("asset"), w("column"), w("signature"), F.round("worst.magnitude", 6).alias("magnitude"), w("from_value"), w("to_value"), "change_id", "severity", F.array_join("affected", ",").alias("affected"), F.round("worst.confidence", 6).alias("confidence"), "detected_at")


# Calibration --------------------------------------------------------------------------

_PAIR_SQL = "(SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS p, CAST(quality AS INT) AS y FROM labels)"
_BIN_SQL = f"(SELECT least(9, greatest(0, CAST(floor(p * 10) AS INT))) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM {_PAIR_SQL} GROUP BY 1)"


def _label_pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 37 % 101 / 100).alias("p"), F.col("quality").cast("int").alias("y"))


@query("reliability_bins", f"SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(mp, 0), 6) AS mean_p, round(coalesce(my, 0), 6) AS mean_y FROM (SELECT unnest(range(0, 10)) AS i) LEFT JOIN {_BIN_SQL} ON bin = i")
def reliability_bins(spark, sf_dir):
    rows = calibration.reliability_bins(_label_pairs(spark, sf_dir), "p", "y")
    return rows.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query("reliability_summary", f"SELECT CAST(sum(n) AS BIGINT) AS n, (SELECT round(avg((p - y) ** 2), 6) FROM {_PAIR_SQL}) AS brier, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, round(max(abs(mp - my)), 6) AS mce, CAST(sum(n) FILTER (bin BETWEEN 2 AND 7) AS BIGINT) AS mid_range_n FROM {_BIN_SQL}")
def reliability_summary(spark, sf_dir):
    rows = calibration.reliability(_label_pairs(spark, sf_dir), "p", "y")
    return rows.select("n", *[F.round(c, 6).alias(c) for c in ("brier", "ece", "mce")], "mid_range_n")


@query("stratified_folds", "SELECT CAST(quality AS INT) AS y, CAST((k - 1) % 5 AS INT) AS fold, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) GROUP BY ALL")
def stratified_folds(spark, sf_dir):
    rows = calibration.stratified_folds(_label_pairs(spark, sf_dir), "y", "doc_id")
    return rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


# Incident history, gate -----------------------------------------------------------------

_BATCHES = [
    [("orders", "sig", "col", "c1", "first", "medium", 0.5, "t", "s", "2026-01-01 08:00:00", "2026-01-01 09:00:00", "2026-01-01 09:00:00"), ("parts", "sig", "col", "c1", "first", "low", None, "t", "s", "2026-01-01 08:00:00", "2026-01-01 09:00:00", "2026-01-01 09:00:00")],
    [("orders", "sig", "other", "c1", "second", "high", 0.9, "t2", "s2", "2026-01-01 08:00:00", "2026-01-03 09:00:00", "2026-01-03 09:00:00"), ("orders", "sig2", "col", "c1", "first", "high", 0.7, "t", "s", None, None, "2026-01-02 09:00:00")],
]
_RECORD = "asset string, signature string, column_name string, change_id string, change_label string, severity string, confidence double, title string, summary string, change_at string, detected_at string, run_at string"
_HISTORY_SQL = (
    "WITH r(asset, signature, column_name, change_id, change_label, severity, confidence, title, summary, change_at, detected_at, run_at) AS (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for batch in _BATCHES for row in batch)
    + "), h AS (SELECT sha256(asset || chr(0) || signature || chr(0) || change_id) AS identity_key, asset, arg_min(column_name, run_at) AS column_name, arg_min(change_label, run_at) AS change_label, arg_max(severity, run_at) AS severity, arg_max(title, run_at) AS title, "
    "min(run_at) AS first_seen_at, max(run_at) AS last_seen_at, max(detected_at) AS last_detected_at, CAST(count(*) AS INT) AS occurrences FROM r GROUP BY asset, signature, change_id) "
)
_HISTORY_COLUMNS = ["identity_key", "asset", "column_name", "change_label", "severity", "title", "first_seen_at", "last_seen_at", "occurrences"]
_HISTORY_SELECT = "identity_key, asset, column_name, change_label, severity, title, CAST(first_seen_at AS TIMESTAMP) AS first_seen_at, CAST(last_seen_at AS TIMESTAMP) AS last_seen_at, occurrences"


def _history(spark) -> DataFrame:
    out = spark.createDataFrame([], store.SCHEMA)
    for rows in _BATCHES:
        new = spark.createDataFrame(rows, _RECORD)
        for c in ("change_at", "detected_at", "run_at"):
            new = new.withColumn(c, F.col(c).cast("timestamp_ntz"))
        out = store.upserted(out, new)
    return out


@query("store_upsert", _HISTORY_SQL + f"SELECT {_HISTORY_SELECT} FROM h")
def store_upsert(spark, sf_dir):
    return _history(spark).select(*_HISTORY_COLUMNS)


@query("store_history", _HISTORY_SQL + f"SELECT {_HISTORY_SELECT} FROM h WHERE asset = 'orders' ORDER BY last_detected_at DESC NULLS LAST, identity_key")
def store_history(spark, sf_dir):
    return store.history_of(_history(spark), "orders").select(*_HISTORY_COLUMNS)


@query("store_prune", _HISTORY_SQL + f"SELECT {_HISTORY_SELECT} FROM h WHERE NOT CAST(last_seen_at AS TIMESTAMP) < TIMESTAMP '2026-01-02 00:00:00'")
def store_prune(spark, sf_dir):
    rows = _history(spark)
    return rows.filter(~(F.col("last_seen_at") < F.lit(datetime(2026, 1, 2)).cast("timestamp_ntz"))).select(*_HISTORY_COLUMNS)


@query("gate_worst_severity", _BLAST_SQL + " SELECT ['low', 'medium', 'high', 'critical'][max(rank)] AS worst, max(rank) >= 3 AS failed FROM inc")
def gate_worst_severity(spark, sf_dir):
    rows = cases.blast_incidents(spark)
    rank = F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), F.col("severity"))
    return rows.agg(F.max(rank).alias("r")).select(rca.severity_name(F.col("r").cast("int")).alias("worst"), (F.col("r") >= C.SEVERITIES.index("high") + 1).alias("failed"))


@query("commit_range_targets", f"WITH {_COMMIT_SQL} SELECT id, CAST(count(DISTINCT sha) AS BIGINT) AS commits FROM m GROUP BY id")
def commit_range_targets(spark, sf_dir):
    rows = rca.derive_changes(_commits(spark), _file_graph(spark)).select("change_id", F.explode("targets").alias("id"))
    return rows.groupBy("id").agg(F.countDistinct("change_id").alias("commits"))
