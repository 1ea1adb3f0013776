"""Profiles computed where the data are: SQL for a warehouse, run by whatever executes it.

A dialect is a record of the few things in which engines differ. The executor is the
caller's: any function from SQL text to rows, such as ``spark_executor`` or a cursor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidemark import constants as C
from tidemark.errors import EngineError
from tidemark.plans.analyze import ColumnProfile, NumericStats

Execute = Callable[[str], Iterable[Sequence]]

_COUNTS = ("row_count", "null_count", "distinct_count")
_MOMENTS = ("numeric_count", "mean", "stddev", "minimum", "maximum")
#: Shares of rows on either side of a quantile between which its value is looked for.
_MARGIN = 0.0003


@dataclass(frozen=True)
class SqlDialect:
    """``describe``, ``finite`` and ``quantile`` are templates; numeric types are named without their parameters.

    ``distinct`` counts a column's values; an engine that multiplies rows for distinct
    counts beside other aggregates is asked by a subquery. An engine that holds all
    distinct values of a column to find a quantile has a ``sketch`` instead: approximate
    quantiles at the shares {p}, near which the exact ones are found by ``rank_query``.
    """

    name: str
    describe: str
    finite: str
    quantile: str
    numeric_types: frozenset[str]
    text_type: str = "VARCHAR"
    mark: str = '"'
    distinct: str = "COUNT(DISTINCT {c})"
    sketch: str = ""

    def quote(self, name: str) -> str:
        return self.mark + name.replace(self.mark, self.mark * 2) + self.mark

    def quote_table(self, name: str) -> str:
        return ".".join(map(self.quote, name.split(".")))

    def is_numeric_type(self, type_name: str) -> bool:
        return type_name.partition("(")[0].strip().upper() in self.numeric_types

    def types_query(self, table: str) -> str:
        return self.describe.format(table=self.quote_table(table))

    def _measures(self, table: str, column: str, numeric: bool) -> list[tuple[str, str]]:
        c = self.quote(column)
        out = [("row_count", "COUNT(*)"), ("null_count", f"COUNT(*) - COUNT({c})"), ("distinct_count", self.distinct.format(c=c, t=self.quote_table(table)))]
        if numeric:
            known = f"CASE WHEN {self.finite.format(c=c)} THEN {c} END"
            calls = dict(zip(_MOMENTS, ("COUNT", "AVG", "STDDEV_SAMP", "MIN", "MAX")))
            out += [(name, f"{call}({known})") for name, call in calls.items()]
            if self.sketch:
                shares = ", ".join(f"{x:.6f}" for p in C.QUANTILES for x in (p - _MARGIN, p + _MARGIN))
                out.append(("near_quantiles", self.sketch.format(v=known, p=shares)))
            else:
                out += [(name, self.quantile.format(v=known, p=p)) for name, p in zip(C.QUANTILE_NAMES, C.QUANTILES)]
        return out

    def width(self, numeric: bool) -> int:
        """The number of a column's measures."""
        return len(_COUNTS) + numeric * (len(_MOMENTS) + (1 if self.sketch else len(C.QUANTILES)))

    def aggregate_query(self, table: str, column: str, *, numeric: bool) -> str:
        """One row: three counts; for numbers also five moments and the quantiles, or values on either side of each."""
        listed = ", ".join(f"{e} AS {name}" for name, e in self._measures(table, column, numeric))
        return f"SELECT {listed} FROM {self.quote_table(table)}"

    def table_query(self, table: str, columns: Sequence[tuple[str, bool]]) -> str:
        """The measures of all columns (name, whether numeric) in one row and one scan."""
        listed = [f"{e} AS {name}_{i}" for i, (c, numeric) in enumerate(columns) for name, e in self._measures(table, c, numeric)]
        return f"SELECT {', '.join(listed)} FROM {self.quote_table(table)}"

    def rank_query(self, table: str, column: str, near: Sequence[tuple[float, float]], ranks: Sequence[int]) -> str:
        """(value, first, after): the values at some ranks from 0, and the ranks that each takes up.

        Values outside the ranges ``near``, which ascend and do not meet, are only counted:
        by the gap they lie in, as null. Without ranges all values are ranked.
        """
        c = self.quote(column)
        x = f"CAST({c} AS DOUBLE)"
        number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
        place, value = "0", "x"
        if near:
            bounds = [(f"x < {number(low)}", f"x <= {number(high)}") for low, high in near]
            place = f"CASE {' '.join(f'WHEN {b} THEN {i}' for i, b in enumerate(b for pair in bounds for b in pair))} ELSE {2 * len(near)} END"
            value = f"CASE WHEN {' OR '.join(f'x BETWEEN {number(low)} AND {number(high)}' for low, high in near)} THEN x END"
        rows = f"SELECT {place} AS place, {value} AS value FROM (SELECT {x} AS x FROM {self.quote_table(table)} WHERE {self.finite.format(c=c)}) AS t"
        counted = f"SELECT place, value, COUNT(*) AS n FROM ({rows}) AS r GROUP BY place, value"
        summed = f"SELECT value, n, SUM(n) OVER (ORDER BY place, value ROWS UNBOUNDED PRECEDING) AS after FROM ({counted}) AS g"
        wanted = " OR ".join(f"{r} >= after - n AND {r} < after" for r in ranks)
        return f"SELECT value, after - n AS first, after FROM ({summed}) AS s WHERE {wanted}"

    def topk_query(self, table: str, column: str, top_k: int) -> str:
        c = self.quote(column)
        return f"SELECT CAST({c} AS {self.text_type}) AS value, COUNT(*) AS n FROM {self.quote_table(table)} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT {int(top_k)}"


_WHOLE = {"TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT"}
_OTHER = {"FLOAT", "DOUBLE", "REAL", "DECIMAL", "NUMERIC"}

DuckDBDialect = SqlDialect(
    "duckdb",
    describe="DESCRIBE SELECT * FROM {table}",
    finite="isfinite({c})",
    quantile="QUANTILE_CONT({v}, {p})",
    numeric_types=frozenset(_WHOLE | _OTHER | {"HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"}),
)
SnowflakeDialect = SqlDialect(
    "snowflake",
    describe="DESCRIBE TABLE {table}",
    finite="{c} NOT IN ('NaN'::FLOAT, 'inf'::FLOAT, '-inf'::FLOAT)",
    quantile="PERCENTILE_CONT({p}) WITHIN GROUP (ORDER BY {v})",
    numeric_types=frozenset(_WHOLE | _OTHER | {"NUMBER", "BYTEINT", "FLOAT4", "FLOAT8", "DOUBLE PRECISION"}),
)
SparkDialect = SqlDialect(
    "spark",
    describe="DESCRIBE TABLE {table}",
    finite="(NOT isnan(CAST({c} AS DOUBLE)) AND abs(CAST({c} AS DOUBLE)) < DOUBLE('Infinity'))",
    quantile="PERCENTILE({v}, {p})",
    numeric_types=frozenset(_WHOLE | _OTHER),
    text_type="STRING",
    mark="`",
    distinct="(SELECT COUNT(*) FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL))",
    sketch="APPROX_PERCENTILE(CAST({v} AS DOUBLE), ARRAY({p}), 10000)",
)


def spark_executor(spark: SparkSession) -> Execute:
    return lambda sql: spark.sql(sql).collect()


class SqlProfileSource:
    """Profiles of a table's columns from a warehouse: one query for all counts, one a column for its top values.

    With a dialect that sketches quantiles, one more for each column of numbers.
    """

    def __init__(self, execute: Execute, table: str, *, dialect: SqlDialect, top_k: int = C.TOP_K):
        self.execute, self.table, self.dialect, self.top_k = execute, table, dialect, top_k

    def _chosen(self, columns: Sequence[str] | None) -> list[tuple[str, bool]]:
        types = {r[0]: r[1] for r in self.execute(self.dialect.types_query(self.table))}
        names = list(types) if columns is None else list(columns)
        if missing := [c for c in names if c not in types]:
            raise EngineError(f"unknown column(s) in {self.table}: {', '.join(missing)}")
        return [(c, self.dialect.is_numeric_type(types[c])) for c in names]

    def _counted(self, chosen: list[tuple[str, bool]]) -> list[Sequence]:
        rows = [tuple(r) for r in self.execute(self.dialect.table_query(self.table, chosen))]
        widths = [self.dialect.width(numeric) for _, numeric in chosen]
        if len(rows) != 1 or len(rows[0]) != sum(widths):
            raise EngineError(f"{self.table}: one row of {sum(widths)} measures is expected")
        ends = [sum(widths[: i + 1]) for i in range(len(widths))]
        return [rows[0][end - width : end] for end, width in zip(ends, widths)]

    def _exact(self, column: str, sketched: Sequence[float], n: int) -> list[float]:
        """Linearly interpolated quantiles of ``n`` values, from values on either side of each."""
        near: list[tuple[float, float]] = []
        for low, high in sorted(zip(sketched[::2], sketched[1::2])):
            if near and low <= near[-1][1]:
                low, high = near[-1][0], max(high, near.pop()[1])
            near.append((float(low), float(high)))
        at = [p * (n - 1) for p in C.QUANTILES]
        ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
        # A sketch may be worse than it promises: then all values are ranked.
        for ranges in (near, []):
            found = [tuple(r) for r in self.execute(self.dialect.rank_query(self.table, column, ranges, ranks))]
            value = {r: v for v, first, after in found for r in ranks if first <= r < after}
            if all(value.get(r) is not None for r in ranks):
                return [value[math.floor(a)] + (value[math.ceil(a)] - value[math.floor(a)]) * (a - math.floor(a)) for a in at]
        raise EngineError(f"{self.table}: {n} numbers are expected in {column}")

    def profile(self, columns: Sequence[str] | None = None) -> dict[str, ColumnProfile]:
        chosen = self._chosen(columns)
        out = {}
        for (name, numeric), row in zip(chosen, self._counted(chosen) if chosen else ()):
            stats = None
            if numeric and row[3]:
                mean, deviation, low, high = (float(x or 0.0) for x in row[4:8])
                quantiles = self._exact(name, row[8], int(row[3])) if self.dialect.sketch else [float(x or 0.0) for x in row[8:]]
                stats = NumericStats(int(row[3]), mean, deviation, low, high, dict(zip(C.QUANTILE_NAMES, quantiles)))
            top = {str(v): int(n) for v, n in self.execute(self.dialect.topk_query(self.table, name, self.top_k))}
            out[name] = ColumnProfile(name, *map(int, row[:3]), top, stats)
        return out
