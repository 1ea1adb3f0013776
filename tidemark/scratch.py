"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import EngineError

_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if all executors are in this process, else an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-")
        _roots[app] = f"{shared.rstrip('/')}/tidemark-{app}"
        atexit.register(release, spark)
    return _roots[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application (also done at exit)."""
    root = _roots.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if root:
        _delete(spark, root)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end; what is read from them must be used before."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            _delete(spark, folder)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage there."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
