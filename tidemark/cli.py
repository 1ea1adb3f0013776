"""Command line: ``python -m tidemark.cli analyze --config tidemark.toml``.

Exit codes: 1 if the gate fails, else 2 if anything errored, else 0.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Asset, Config, load_config
from tidemark.errors import EngineError
from tidemark.gate import gate_failed, worst_severity
from tidemark.operators import rca
from tidemark.operators.calibration import LogisticModel
from tidemark.operators.lineage import Lineage, load_manifest
from tidemark.operators.profile import compared_columns
from tidemark.operators.store import IncidentStore
from tidemark.plans.analyze import AssetSnapshots, ChangeEvent, Incident, analyze_assets, change_frame
from tidemark.render import AssetResult, as_json, markdown, multi_json, multi_markdown
from tidemark.sources.changes import collect_commits, commit_frame, resolve_range
from tidemark.sources.files import read_snapshot, read_table


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    analyze = parser.add_subparsers(dest="command", required=True).add_parser("analyze", help="compare two snapshots and report")
    analyze.add_argument("--config", default="tidemark.toml")
    analyze.add_argument("--output-dir", default=".")
    analyze.add_argument("--source-before")
    analyze.add_argument("--source-after")
    return parser


def override(config: Config, before: str | None, after: str | None) -> Config:
    if before is None and after is None:
        return config
    if config.multi or config.assets[0].source.kind != "file":
        raise EngineError("--source-before and --source-after are for a single asset from files")
    source = config.assets[0].source
    source.before, source.after = before or source.before, after or source.after
    return config


def _snapshots(spark: SparkSession, asset: Asset) -> tuple[DataFrame, DataFrame]:
    s = asset.source
    if s.kind == "file":
        return read_snapshot(spark, s.before), read_snapshot(spark, s.after)
    url = s.database if s.database and s.database.startswith("jdbc:") else None
    return read_table(spark, s.before, url=url), read_table(spark, s.after, url=url)


def _changes(spark: SparkSession, asset: Asset, graph: Lineage, derived: DataFrame) -> list[ChangeEvent]:
    declared = change_frame(spark, asset.changes)
    if unknown := rca.unknown_targets(declared, graph).collect():
        raise EngineError("; ".join(f"change {r['change_id']!r} names target {r['target']!r}, which the manifest does not have" for r in unknown))
    rows = rca.combine_changes(declared, derived).orderBy("change_ord").collect()
    if not rows:
        raise EngineError("no change is declared, and none could be derived from git")
    return [ChangeEvent(r["change_id"], r["ts"], list(r["targets"]), r["label"]) for r in rows]


def analyze_listed(spark: SparkSession, assets: Sequence[Asset], graph: Lineage, derived: DataFrame, model: LogisticModel | None) -> list[AssetResult]:
    """All assets in one analysis; errors become part of an asset's result.

    What only shows when data are read fails the analysis of all; then each is analysed alone.
    """
    results: dict[str, AssetResult] = {}
    ready: list[AssetSnapshots] = []
    for asset in assets:
        try:
            before, after = _snapshots(spark, asset)
            compared_columns(before, after, asset.columns)
            ready.append(AssetSnapshots(asset.name, before, after, _changes(spark, asset, graph, derived), asset.columns))
        except (EngineError, PySparkException) as e:
            results[asset.name] = AssetResult(asset.name, error=str(e))

    def together(some: list[AssetSnapshots]) -> None:
        try:
            found = analyze_assets(some, lineage=graph, model=model)
        except (EngineError, PySparkException) as e:
            if len(some) == 1:
                results[some[0].name] = AssetResult(some[0].name, error=str(e))
                return
            for one in some:
                together([one])
            return
        results.update({name: AssetResult(name, incident) for name, incident in found.items()})

    if ready:
        together(ready)
    return [results[a.name] for a in assets]


def record_frame(spark: SparkSession, asset: str, x: Incident) -> DataFrame:
    c, w = x.primary_cause.change, x.worst.symptom
    row = (asset, w.signature, w.column, c.id, c.label, x.severity, x.confidence, x.title, x.summary, x.change_at, x.detected_at, x.detected_at)
    names = "asset string, signature string, column_name string, change_id string, change_label string, severity string, confidence double, title string, summary string"
    return spark.createDataFrame([row], names + ", change_at timestamp_ntz, detected_at timestamp_ntz, run_at timestamp_ntz")


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    config = override(load_config(args.config), args.source_before, args.source_after)
    graph = load_manifest(spark, config.manifest)
    derived = rca.derive_changes(commit_frame(spark, collect_commits(*resolve_range(config.git_base, config.git_head))), graph)
    model = LogisticModel() if config.model else None
    results = analyze_listed(spark, sorted(config.assets, key=lambda a: a.name), graph, derived, model)
    worst = worst_severity(r.incident.severity if r.incident else None for r in results)
    failed, now = gate_failed(worst, config.fail_on), datetime.now(UTC)
    if config.multi:
        text = multi_markdown(results, fail_on=config.fail_on, failed=failed)
        payload = multi_json(results, fail_on=config.fail_on, failed=failed, worst=worst, generated_at=now)
    else:
        if results[0].error is not None:
            raise EngineError(results[0].error)
        text = markdown(results[0], fail_on=config.fail_on, failed=failed)
        payload = as_json(results[0], fail_on=config.fail_on, failed=failed, generated_at=now)
    out = Path(args.output_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "tidemark-report.md").write_text(text, encoding="utf-8")
    (out / "tidemark-report.json").write_text(json.dumps(payload, indent=2), encoding="utf-8")
    if config.store:
        with IncidentStore(spark, config.store) as store:
            for r in results:
                if r.incident:
                    store.record(record_frame(spark, r.name, r.incident))
    print(text)
    return 1 if failed else 2 if any(r.error for r in results) else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return run(spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
    except (EngineError, OSError) as e:
        print(f"tidemark: error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
