"""Shared helpers: tables, bounded Arrow batches, lower-casing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import release, scratch_root, written

__all__ = ["ascii_lower", "blocks_for", "bounded_arrow", "join_counted", "release", "scan_id", "scratch_root", "table", "text_chunks", "without", "written"]

#: Upper bound of the bytes handed to a Python worker in one Arrow batch.
ARROW_BATCH_BYTES = 8 << 20
#: Rows per Arrow batch; whichever bound is met first closes the batch.
ARROW_BATCH_ROWS = 4096
#: A key with more than this share of all rows is hot; fewer than ``1 / HOT_SHARE`` keys can be.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_arrow(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def text_chunks(texts: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of a batch's texts in runs of about ``chars`` characters, each one text or more."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and (not part or size < chars):
            part.append(texts[at + len(part)].as_py())
            size += len(part[-1] or "")
        yield at, part
        at += len(part)


def blocks_for(total_bytes: int, block_bytes: int, least: int = 8) -> int:
    """Number of equal blocks that keeps each near ``block_bytes``."""
    return max(least, -(-int(total_bytes or 0) // block_bytes))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` agrees with that whenever the text holds no other cased letter, and
    is far cheaper than ``translate``; which of both is taken is decided by row.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, low))


def without(items: Column, gone: Column) -> Column:
    """A non-empty array less the places in ``gone``, in time that grows with both lengths and not their product."""
    # One element, so that the lambda variable holds ``items`` evaluated once.
    kept = F.transform(F.array(items), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)))
    return F.get(kept, F.lit(0))


def scan_id() -> Column:
    """A key of its own for each row, also among rows that repeat each other."""
    return F.monotonically_increasing_id()


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``: a row for each key, and in ``n`` how many rows have it.

    ``total`` is the number of all rows or more. Hot keys, whose number is bounded, are
    broadcast and their rows stay where they are; the rows of all others are shuffled, at
    most ``HOT_SHARE`` of them to one place. ``per_key`` is read more than once.
    """
    hot = F.col("n") > total * HOT_SHARE
    few, many = per_key.filter(hot).drop("n"), per_key.filter(~hot).drop("n")
    stay = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return stay.unionByName(rest.join(many, key))
