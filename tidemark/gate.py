"""Severity gate and exit codes."""

from __future__ import annotations

from collections.abc import Iterable

from tidemark.constants import SEVERITIES


def gate_failed(severity: str | None, fail_on: str) -> bool:
    return severity is not None and SEVERITIES.index(severity) >= SEVERITIES.index(fail_on)


def exit_code(severity: str | None, fail_on: str) -> int:
    return int(gate_failed(severity, fail_on))


def worst_severity(severities: Iterable[str | None]) -> str | None:
    return max((s for s in severities if s is not None), key=SEVERITIES.index, default=None)
