import json
from datetime import datetime, timedelta

import pytest

from tidemark.errors import EngineError
from tidemark.operators import inject, store
from tidemark.operators.calibration import LogisticModel, literal_pairs, out_of_fold, reliability, reliability_bins
from tidemark.operators.lineage import lineage, load_manifest
from tidemark.plans.analyze import ChangeEvent, analyze_change
from tidemark.sources.changes import naive_utc, parse_log, resolve_range

NINE = datetime(2026, 1, 2, 9)


def graph(spark, exposures=()):
    return lineage(spark, [("fact_orders", "revenue_daily"), ("orders_raw", "fact_orders")], list(exposures))


def renamed(spark, share, n=1000):
    before = inject.orders(spark, n, share)
    return before, inject.substitute(before, "country", "UK", "United Kingdom")


@pytest.mark.parametrize(("share", "confidence"), [(0.20, 0.9479039151157225), (0.28, 0.9654162691190278), (0.10, 0.911948753931074)])
def test_golden_confidence(spark, share, confidence):
    before, after = renamed(spark, share)
    exposures = [("e.api", "pricing_api", "application", "high", None, "Ann", None, ["revenue_daily"])]
    x = analyze_change(before, after, asset="fact_orders", changes=[ChangeEvent("c1", NINE, ["fact_orders"], "deploy")], lineage=graph(spark, exposures), observed_at=NINE + timedelta(minutes=2), columns=["country"], model=LogisticModel())
    assert x.confidence == pytest.approx(confidence, abs=1e-12)
    assert x.severity == "critical" and x.affected_assets == ["revenue_daily"] and x.max_criticality == "CRITICAL"
    assert x.title == "Semantic change in country - deploy" and "2 min before" in x.evidence[0] and "directly changed fact_orders" in x.evidence[1]
    assert "Reaches 1 external consumer(s): 1 application (worst: CRITICAL)." in x.summary


def test_no_change_no_incident(spark):
    before, after = renamed(spark, 0.2)
    common = dict(asset="fact_orders", lineage=graph(spark), columns=["country"], observed_at=NINE)
    assert analyze_change(before, after, changes=[], **common) is None
    assert analyze_change(before, before, changes=[ChangeEvent("c", NINE, ["fact_orders"])], **common) is None
    late = [ChangeEvent("late", NINE + timedelta(minutes=1), ["fact_orders"]), ChangeEvent("old", NINE - timedelta(days=3), ["fact_orders"]), ChangeEvent("below", NINE, ["revenue_daily"])]
    assert analyze_change(before, after, changes=late, **common) is None


MANIFEST = {
    "nodes": {
        "m.a": {"resource_type": "model", "original_file_path": "models/a.sql", "depends_on": {"nodes": ["source.x"]}},
        "m.b": {"resource_type": "model", "original_file_path": "models/b.sql", "depends_on": {"nodes": ["m.a"]}},
    },
    "exposures": {"e.d": {"name": "d", "type": "dashboard", "maturity": "high", "owner": {"email": "o@x"}, "depends_on": {"nodes": ["m.b", "gone"]}}},
}


def test_manifest(spark, tmp_path):
    g = load_manifest(spark, MANIFEST)
    assert {r["id"] for r in g.downstream("m.a").collect()} == {"m.b", "e.d"}
    assert {r["id"] for r in g.upstream("e.d").collect()} == {"m.a", "m.b"}
    assert g.is_downstream_of("m.b", "m.a") and not g.is_downstream_of("m.a", "m.a")
    found = g.exposures_below(spark.createDataFrame([("m.a",)], "id string")).collect()
    assert [(r["name"], r["criticality"], r["owner"]) for r in found] == [("d", 3, "o@x")]
    (tmp_path / "m.json").write_text("[")
    with pytest.raises(EngineError):
        load_manifest(spark, tmp_path / "m.json")


def test_git_log_and_range():
    text = "\x1eabc\x1f2026-01-02T10:00:00+02:00\x1fsubject\x1f\n\nmodels/a.sql\nREADME.md\n\x1ebroken"
    (c,) = parse_log(text)
    assert (c.sha, c.timestamp, c.changed_files) == ("abc", datetime(2026, 1, 2, 8), ("models/a.sql", "README.md"))
    assert resolve_range(env={}) == ("HEAD~1", "HEAD")
    assert resolve_range("x", None, {"GITHUB_BASE_REF": "main", "GITHUB_SHA": "s"}) == ("x", "s")
    assert naive_utc(NINE) == NINE


def test_store_keeps_first_and_refreshes_last(spark, tmp_path):
    def row(asset, day, severity):
        t = datetime(2026, 1, day)
        return spark.createDataFrame([(asset, "sig", "col", "c1", "label", severity, 0.5, "t", "s", t, t, t)], "asset string, signature string, column_name string, change_id string, change_label string, severity string, confidence double, title string, summary string, change_at timestamp_ntz, detected_at timestamp_ntz, run_at timestamp_ntz")

    with store.IncidentStore(spark, str(tmp_path / "history")) as s:
        assert s.table().count() == 0
        s.record(row("a", 1, "low"))
        s.record(row("a", 3, "high"))
        s.record(row("b", 2, "low"))
        (a,) = s.history("a").collect()
        assert (a["occurrences"], a["severity"], a["first_seen_at"], a["last_seen_at"]) == (2, "high", datetime(2026, 1, 1), datetime(2026, 1, 3))
        assert s.get(a["identity_key"]).count() == 1
        assert s.prune(datetime(2026, 1, 2)) == 0 and s.prune(datetime(2026, 1, 3)) == 1
        assert s.history("b").count() == 0 and s.history("a").count() == 1


def test_reliability_and_model(spark):
    pairs = literal_pairs(spark, [(0.05, 0), (0.95, 1), (1.0, 1), (0.5, 0)])
    bins = {r["bin"]: r["n"] for r in reliability_bins(pairs, "p", "y").collect()}
    assert len(bins) == 10 and (bins[0], bins[9], bins[5]) == (1, 2, 1)
    s = reliability(pairs, "p", "y").first()
    assert s["mce"] == pytest.approx(0.5) and s["mid_range_n"] == 1
    frozen = LogisticModel()
    assert frozen.predict_proba([0.5, 15, 3.5]) > 0.8 > 0.3 > frozen.predict_proba([0.02, 0.5, 2])
    assert LogisticModel.from_dict(frozen.to_dict()) == frozen
    rows = [(i / 40, float(i % 3), 2.0, int(i >= 20), i) for i in range(40)]
    df = spark.createDataFrame(rows, "magnitude double, significance_margin double, log10_n double, y int, id int")
    fitted = LogisticModel.fit(df, "y", steps=200)
    assert fitted.predict_proba([0.9, 1.0, 2.0]) > 0.5 > fitted.predict_proba([0.1, 1.0, 2.0])
    assert out_of_fold(df, "y", "id", steps=20).count() == 40
    with pytest.raises(ValueError):
        LogisticModel.fit(df.limit(0), "y")


def write_inputs(tmp_path, columns=""):
    (tmp_path / "b.csv").write_text("country\n" + "UK\n" * 400 + "US\n" * 400 + "DE\n" * 200)
    (tmp_path / "a.csv").write_text("country\n" + "GB\n" * 400 + "US\n" * 400 + "DE\n" * 200)
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    return f"""
asset = "m.a"
{columns}
[source]
kind = "file"
before = "{tmp_path}/b.csv"
after = "{tmp_path}/a.csv"
[lineage]
manifest = "{tmp_path}/m.json"
[git]
base = "none"
head = "none"
[store]
path = "{tmp_path}/history"
[[changes]]
id = "c1"
targets = ["m.a"]
timestamp = 2026-01-02T09:00:00Z
label = "deploy"
"""


def test_command_line(spark, tmp_path, capsys):
    from tidemark.cli import main

    (tmp_path / "t.toml").write_text(write_inputs(tmp_path))
    args = ["analyze", "--config", str(tmp_path / "t.toml"), "--output-dir", str(tmp_path / "out")]
    assert main(args, spark) == 1
    report = json.loads((tmp_path / "out/tidemark-report.json").read_text())
    assert report["severity"] == "high" and report["gate"]["failed"] and report["incident"]["affected_assets"] == ["m.b"]
    assert (tmp_path / "out/tidemark-report.md").read_text().rstrip().endswith("-->")
    assert store.IncidentStore(spark, str(tmp_path / "history")).history("m.a").count() == 1
    assert main([*args, "--source-after", str(tmp_path / "b.csv")], spark) == 0
    assert main([*args, "--source-after", str(tmp_path / "no.csv")], spark) == 2
    (tmp_path / "t.toml").write_text(write_inputs(tmp_path, 'columns = ["nope"]'))
    assert main(args, spark) == 2


def test_several_assets(spark, tmp_path, capsys):
    from tidemark.cli import main

    head, _, tail = write_inputs(tmp_path).partition("[source]")
    source, _, rest = tail.partition("[lineage]")
    shared, _, change = ("[lineage]" + rest).partition("[[changes]]")
    block = f"[assets.source]{source}[[assets.changes]]{change}"
    broken = block.replace("/a.csv", "/none.csv")
    (tmp_path / "t.toml").write_text(f"{shared}\n[gate]\nfail_on='critical'\n[[assets]]\nname='m.b'\n{block}\n[[assets]]\nname='m.a'\n{broken}")
    assert main(["analyze", "--config", str(tmp_path / "t.toml"), "--output-dir", str(tmp_path)], spark) == 2
    report = json.loads((tmp_path / "tidemark-report.json").read_text())
    assert [a["asset"] for a in report["assets"]] == ["m.a", "m.b"] and report["assets"][0]["error"] and report["gate"]["worst_severity"] == "high"
    assert (tmp_path / "tidemark-report.md").read_text().startswith("<!--")


@pytest.mark.parametrize("change", [("asset = ", "name = "), ("[git]", "[git]\nodd = 1"), ('targets = ["m.a"]', "targets = []"), ('kind = "file"', 'kind = "odd"')])
def test_configuration_errors(tmp_path, change):
    from tidemark.config import load_config

    (tmp_path / "t.toml").write_text(write_inputs(tmp_path).replace(*change))
    with pytest.raises(EngineError):
        load_config(tmp_path / "t.toml")


def test_stream_compares_windows(spark):
    from pyspark.sql import functions as F

    from tidemark.streaming.drift import drift, window_counts, window_profiles

    rows = [(datetime(2026, 1, 1 + d, 1), v) for d, counts in enumerate([dict(a=600, b=400), dict(a=590, b=410), dict(x=600, b=400)]) for v, n in counts.items() for _ in range(n)]
    counts = window_counts(spark.createDataFrame(rows, "ts timestamp, v string"), "ts", "v")
    found = drift(window_profiles(counts, "v")).select(F.dayofmonth("start").alias("d"), "signature", "from_value", "to_value").collect()
    assert [tuple(r) for r in found] == [(3, "value_substitution", "a", "x")]


def test_stream_monitor(spark, tmp_path):
    from tidemark.streaming.drift import monitor

    src, got = str(tmp_path / "in"), []
    rows = [(datetime(2026, 1, d, 1), v) for d, counts in ((1, dict(a=600, b=400)), (2, dict(x=600, b=400)), (5, dict(x=1))) for v, n in counts.items() for _ in range(n)]
    spark.createDataFrame(rows, "ts timestamp, v string").coalesce(1).write.parquet(src)
    events = spark.readStream.schema("ts timestamp, v string").parquet(src)
    query = monitor(events, "ts", "v", lambda df, n: got.extend(r["signature"] for r in df.collect()), checkpoint=str(tmp_path / "cp"), state=str(tmp_path / "state"), triggers=["once"])
    query.awaitTermination(120)
    assert got == ["value_substitution"]
