"""Lineage as tables: nodes (id, kind, resource_type, original_file_path), edges (src, dst), exposures."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.functions.text import normal_path
from tidemark.scratch import written

NODE = "id string, kind string, resource_type string, original_file_path string"
EDGE = "src string, dst string"
EXPOSURE = "unique_id string, name string, type string, maturity string, meta_criticality string, owner string, url string, depends_on array<string>"
CRITICALITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def closure(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst) for every path of one edge or more; a node reaches itself only in the table's identity, never here.

    Paths double in length each round, so the number of rounds is the logarithm of
    the depth. Cycles are fine: a round that adds nothing is the last.
    """
    keys = [*by, "src", "dst"]
    reach = written(edges.select(*keys).filter("src != dst").distinct())
    n = reach.count()
    while True:
        left, right = reach.alias("l"), reach.alias("r")
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] + [F.col("l.dst") == F.col("r.src")]
        longer = left.join(right, on).select(*[F.col(f"l.{k}").alias(k) for k in by], "l.src", "r.dst").filter("src != dst")
        reach = written(reach.unionByName(longer).distinct())
        was, n = n, reach.count()
        if n == was:
            return reach


def criticality(type_: Column, maturity: Column, override: Column) -> Column:
    """1 (low) to 4 (critical) of an exposure."""
    levels = F.create_map(*[x for i, c in enumerate(CRITICALITIES) for x in (F.lit(c.lower()), F.lit(i + 1))])
    named = F.element_at(levels, F.lower(F.trim(override)))
    of_maturity = F.element_at(levels, F.lower(maturity))
    return (
        F.when(named.isNotNull(), named)
        .when((type_ == "application") & (maturity == "high"), F.lit(4))
        .when(type_.isin("application", "ml"), F.lit(3))
        .when(type_ == "dashboard", F.coalesce(F.when(maturity.isin("low", "medium", "high"), of_maturity), F.lit(2)))
        .when(type_.isin("notebook", "analysis"), F.lit(1))
        .otherwise(F.lit(2))
    )


def with_criticality(exposures: DataFrame) -> DataFrame:
    return exposures.withColumn("criticality", criticality(F.col("type"), F.col("maturity"), F.col("meta_criticality")))


@dataclass
class Lineage:
    """A lineage graph, with its closure computed once when first asked for."""

    nodes: DataFrame
    edges: DataFrame
    exposures: DataFrame
    by: tuple[str, ...] = ()

    def __post_init__(self):
        self._reach: DataFrame | None = None

    @property
    def reach(self) -> DataFrame:
        if self._reach is None:
            self._reach = closure(self.edges, self.by)
        return self._reach

    def for_runs(self, runs: DataFrame, by: str) -> Lineage:
        """The same graph for each value of ``by`` in ``runs``, its closure computed once. Graph and runs are control data."""
        runs = F.broadcast(runs.select(by))
        out = Lineage(self.nodes.crossJoin(runs), self.edges.crossJoin(runs), self.exposures.crossJoin(runs), (*self.by, by))
        out._reach = self.reach.crossJoin(runs)
        return out

    def add_node(self, node: str, kind: str | None = "data", path: str | None = None) -> Lineage:
        """A graph with one node more; a known node is replaced."""
        row = self.nodes.sparkSession.createDataFrame([(node, kind, None, path)], NODE)
        return Lineage(self.nodes.filter(F.col("id") != node).unionByName(row), self.edges, self.exposures, self.by)

    def add_edge(self, src: str, dst: str) -> Lineage:
        """A graph with one edge more, and its ends as nodes."""
        spark = self.nodes.sparkSession
        ends = spark.createDataFrame([(x, None, None, None) for x in dict.fromkeys((src, dst))], NODE)
        nodes = self.nodes.unionByName(ends.join(self.nodes.select("id"), "id", "left_anti").select(*self.nodes.columns))
        return Lineage(nodes, self.edges.unionByName(spark.createDataFrame([(src, dst)], EDGE)), self.exposures, self.by)

    def downstream(self, node: str) -> DataFrame:
        return self.reach.filter(F.col("src") == node).select(*self.by, F.col("dst").alias("id"))

    def upstream(self, node: str) -> DataFrame:
        return self.reach.filter(F.col("dst") == node).select(*self.by, F.col("src").alias("id"))

    def is_downstream_of(self, node: str, other: str) -> bool:
        return bool(self.reach.filter((F.col("src") == other) & (F.col("dst") == node)).take(1))

    def data_nodes_below(self, assets: DataFrame) -> DataFrame:
        """(by, id) reachable from ``assets`` (by, id) that are not exposures; unknown nodes are data."""
        below = assets.select(*self.by, F.col("id").alias("src")).join(self.reach, [*self.by, "src"]).select(*self.by, F.col("dst").alias("id")).distinct()
        exposures = self.nodes.filter("kind <=> 'exposure'").select(*self.by, "id")
        return below.join(exposures, [*self.by, "id"], "left_anti")

    def exposures_below(self, assets: DataFrame) -> DataFrame:
        """Exposures reachable from ``assets``, each once per ``by``, with their criticality."""
        below = assets.select(*self.by, F.col("id").alias("src")).join(self.reach, [*self.by, "src"]).select(*self.by, F.col("dst").alias("unique_id")).distinct()
        return with_criticality(self.exposures).join(below, [*self.by, "unique_id"])

    def nodes_for_files(self, files: DataFrame) -> DataFrame:
        """``files`` (file, ...) with the ``id`` of each node whose file it is: equal, or a suffix after a slash.

        Suffixes are exploded, so that the match is an equality and not a cross join.
        """
        path = normal_path(F.col("file"))
        parts = F.split(path, "/")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        rows = files.withColumn("suffix", F.explode(F.array_distinct(suffixes)))
        nodes = self.nodes.filter("original_file_path IS NOT NULL AND NOT kind <=> 'exposure'").select(*self.by, "id", normal_path(F.col("original_file_path")).alias("suffix"))
        return rows.join(nodes, [*self.by, "suffix"]).drop("suffix").distinct()


def lineage(spark: SparkSession, edges: list[tuple[str, str]], exposures: list[tuple] = (), nodes: list[tuple] = ()) -> Lineage:
    """A graph from rows; ends of edges are nodes."""
    known = {n[0] for n in nodes}
    rows = list(nodes) + [(x, None, None, None) for x in dict.fromkeys(x for e in edges for x in e) if x not in known]
    rows += [(e[0], "exposure", "exposure", None) for e in exposures]
    links = list(edges) + [(d, e[0]) for e in exposures for d in e[7]]
    return Lineage(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE), spark.createDataFrame(list(exposures), EXPOSURE))


def load_manifest(spark: SparkSession, source: dict | str | Path) -> Lineage:
    """Graph of a dbt manifest: a dict, or the path of a JSON file.

    Edges lead from a dependency to what depends on it; dependencies that the
    manifest's ``nodes`` do not list are dropped.
    """
    try:
        manifest = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8"))
        listed = manifest.get("nodes", {})
        nodes = [(k, "data", v.get("resource_type"), v.get("original_file_path")) for k, v in listed.items()]
        edges = [(d, k) for k, v in listed.items() for d in v.get("depends_on", {}).get("nodes", []) if d in listed]
        exposures = []
        for k, v in manifest.get("exposures", {}).items():
            owner = v.get("owner") or {}
            depends = [d for d in v.get("depends_on", {}).get("nodes", []) if d in listed]
            override = (v.get("meta") or {}).get("criticality")
            exposures.append((k, v.get("name", k), v.get("type", ""), v.get("maturity"), None if override is None else str(override), owner.get("name") or owner.get("email") or "", v.get("url"), depends))
    except (OSError, ValueError, AttributeError) as e:
        raise EngineError(f"cannot read the manifest: {e}") from e
    return lineage(spark, edges, exposures, nodes)
