"""Snapshots from files and tables."""

from __future__ import annotations

import os
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import EngineError

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


READERS = {
    ".parquet": lambda s, p: s.read.parquet(p),
    ".csv": _csv,
    ".json": lambda s, p: s.read.json(p),
    ".ndjson": lambda s, p: s.read.json(p),
    ".jsonl": lambda s, p: s.read.json(p),
    ".orc": lambda s, p: s.read.orc(p),
}


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix. The schema is resolved here, so that a bad file fails here."""
    reader = READERS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if reader is None:
        raise EngineError(f"unsupported file type: {path} (known: {', '.join(sorted(READERS))})")
    try:
        df = reader(spark, path)
        df.schema
    except PySparkException as e:
        raise EngineError(f"cannot read {path}: {e}") from e
    return df


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise EngineError(f"not a plain table name: {name!r}")
    return name


def quoted(name: str) -> str:
    """A table name with each part between backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def read_table(spark: SparkSession, name: str, *, url: str | None = None, **options: str) -> DataFrame:
    """A table of the catalog, or of a database by JDBC, where filters and columns are pushed down."""
    check_identifier(name)
    try:
        if url:
            return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
        df = spark.table(quoted(name))
        df.schema
        return df
    except PySparkException as e:
        raise EngineError(f"cannot read table {name}: {e}") from e
