"""Changes from the history of a git repository."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: Separators of records and fields in the log that we ask git for.
_RECORD, _FIELD = "\x1e", "\x1f"


@dataclass(frozen=True)
class CommitRecord:
    sha: str
    timestamp: datetime
    subject: str
    changed_files: tuple[str, ...]


def naive_utc(t: datetime) -> datetime:
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def parse_log(text: str) -> list[CommitRecord]:
    out = []
    for record in text.split(_RECORD):
        fields = record.strip("\n").split(_FIELD)
        if len(fields) != 4:
            continue
        sha, when, subject, files = fields
        out.append(CommitRecord(sha.strip(), naive_utc(datetime.fromisoformat(when.strip())), subject, tuple(f for f in files.splitlines() if f.strip())))
    return out


def collect_commits(base: str, head: str, cwd: str | None = None) -> list[CommitRecord]:
    """Commits of a range with the files they touch; an empty list if git or the range is not there."""
    form = f"--format={_RECORD}%H{_FIELD}%cI{_FIELD}%s{_FIELD}"
    try:
        got = subprocess.run(["git", "log", "--name-only", form, f"{base}..{head}"], cwd=cwd, capture_output=True, text=True, timeout=120, check=True)
        return parse_log(got.stdout)
    except (OSError, subprocess.SubprocessError, ValueError):
        return []


def resolve_range(base: str | None = None, head: str | None = None, env: dict[str, str] | None = None) -> tuple[str, str]:
    """Configured range, else that of the CI environment, else the last commit."""
    env = dict(os.environ) if env is None else env
    return base or env.get("GITHUB_BASE_REF") or "HEAD~1", head or env.get("GITHUB_SHA") or "HEAD"


def commit_frame(spark: SparkSession, commits: list[CommitRecord]) -> DataFrame:
    rows = [(c.sha, c.timestamp, c.subject, list(c.changed_files)) for c in commits]
    return spark.createDataFrame(rows, "sha string, ts timestamp_ntz, subject string, files array<string>")
