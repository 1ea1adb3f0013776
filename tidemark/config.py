"""Configuration of a run: a TOML file, checked by hand-written rules."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from tidemark.constants import SEVERITIES
from tidemark.errors import EngineError
from tidemark.plans.analyze import ChangeEvent
from tidemark.sources.changes import naive_utc
from tidemark.sources.files import check_identifier


@dataclass
class Source:
    kind: str
    before: str
    after: str
    database: str | None = None


@dataclass
class Asset:
    name: str
    source: Source
    changes: list[ChangeEvent] = field(default_factory=list)
    columns: list[str] | None = None


@dataclass
class Config:
    assets: list[Asset]
    manifest: str
    multi: bool
    git_base: str | None = None
    git_head: str | None = None
    fail_on: str = "high"
    model: bool = True
    store: str | None = None


def _only(where: str, d: Any, needed: tuple[str, ...], optional: tuple[str, ...] = (), strict: bool = True) -> dict:
    if not isinstance(d, dict):
        raise EngineError(f"{where}: a table is expected")
    if missing := [k for k in needed if k not in d]:
        raise EngineError(f"{where}: missing {', '.join(missing)}")
    if strict and (extra := sorted(set(d) - {*needed, *optional})):
        raise EngineError(f"{where}: unknown key(s) {', '.join(extra)}")
    return d


def _source(where: str, d: Any) -> Source:
    kind = d.get("kind") if isinstance(d, dict) else None
    if kind == "file":
        _only(where, d, ("kind", "before", "after"))
        return Source(kind, d["before"], d["after"])
    if kind == "warehouse":
        _only(where, d, ("kind", "database", "before_table", "after_table"))
        return Source(kind, check_identifier(d["before_table"]), check_identifier(d["after_table"]), d["database"])
    raise EngineError(f"{where}: kind must be file or warehouse")


def _change(where: str, d: Any) -> ChangeEvent:
    _only(where, d, ("id", "targets", "timestamp"), strict=False)
    if not isinstance(d["targets"], list) or not d["targets"]:
        raise EngineError(f"{where}: at least one target is needed")
    when = d["timestamp"]
    try:
        when = when if isinstance(when, datetime) else datetime.fromisoformat(str(when))
    except ValueError as e:
        raise EngineError(f"{where}: {e}") from e
    return ChangeEvent(str(d["id"]), naive_utc(when), [str(t) for t in d["targets"]], str(d.get("label", "")))


def _columns(where: str, value: Any) -> list[str] | None:
    if value is not None and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
        raise EngineError(f"{where}: columns must be a list of names")
    return value


def parse_config(raw: dict) -> Config:
    single = "asset" in raw and "source" in raw
    listed = raw.get("assets", [])
    if single and listed:
        raise EngineError("declare one asset with its source, or a list of assets, not both")
    if not single and not listed:
        raise EngineError("no asset is declared")
    if listed and any(k in raw for k in ("asset", "source", "changes", "columns")):
        raise EngineError("with a list of assets, source, changes and columns belong to each of them")
    if single:
        listed = [{"name": raw["asset"], **{k: raw[k] for k in ("source", "changes", "columns") if k in raw}}]
    assets = []
    for i, a in enumerate(listed):
        where = f"asset {i + 1}"
        _only(where, a, ("name", "source"), ("changes", "columns"))
        changes = [_change(f"{where}, change {j + 1}", c) for j, c in enumerate(a.get("changes", []))]
        assets.append(Asset(str(a["name"]), _source(where, a["source"]), changes, _columns(where, a.get("columns"))))
    names = [a.name for a in assets]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise EngineError(f"duplicate asset name(s): {', '.join(repeated)}")
    manifest = _only("lineage", raw.get("lineage", {}), ("manifest",), strict=False)["manifest"]
    git = _only("git", raw.get("git", {}), (), ("base", "head"))
    gate = _only("gate", raw.get("gate", {}), (), strict=False)
    if gate.get("fail_on", "high") not in SEVERITIES:
        raise EngineError(f"gate: fail_on must be one of {', '.join(SEVERITIES)}")
    store = _only("store", raw["store"], ("path",))["path"] if "store" in raw else None
    return Config(assets, manifest, not single, git.get("base"), git.get("head"), gate.get("fail_on", "high"), bool(gate.get("model", True)), store)


def load_config(path: str | Path) -> Config:
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise EngineError(f"no configuration at {path}") from e
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise EngineError(f"cannot read {path}: {e}") from e
    return parse_config(raw)
