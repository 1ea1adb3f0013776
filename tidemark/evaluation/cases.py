"""Labelled cases of root causes and of blast radius, as tables keyed by case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import evaluate, rca
from tidemark.operators.lineage import EDGE, EXPOSURE, NODE, Lineage, lineage


def change_rows(spark, rows: list[tuple], by: str = "") -> DataFrame:
    """(case,) id, time, targets, label."""
    schema = (by + " string, " if by else "") + "change_id string, ts string, targets array<string>, label string, change_ord int"
    keyed = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(keyed, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: (case, edges, observed assets, changes as (id, time, target)); observed at ten; the first change is the cause.
RCA_CASES = [
    ("direct_with_irrelevant_and_late", [("U", "X"), ("X", "Y"), ("V", "W")], ["X"], [("true", "09:55", "X"), ("irrelevant", "09:56", "W"), ("too_late", "10:05", "X")]),
    ("closest_upstream_wins", [("U", "X"), ("X", "Y")], ["Y"], [("true", "09:50", "X"), ("far", "02:00", "U")]),
    ("coverage_wins", [("A", "X"), ("A", "Z")], ["X", "Z"], [("true", "09:50", "A"), ("partial", "09:55", "X")]),
    ("dense_concurrency", [("U", "X"), ("X", "Y"), ("V", "W"), ("P", "Q")], ["Y"], [("true", "09:58", "X"), ("noise_w", "09:58", "W"), ("noise_q", "09:59", "Q"), ("noise_v", "09:57", "V")]),
    ("a_day_exactly", [("U", "X")], ["X"], [("edge", "10:00", "U")]),
]
DAY = {"edge": "2026-01-01"}


def rca_tables(spark):
    edges = spark.createDataFrame([(c, a, b) for c, es, _, _ in RCA_CASES for a, b in es], "case string, " + EDGE)
    graph = lineage(spark, [("x", "y")])
    nodes = edges.select("case", F.explode(F.array("src", "dst")).alias("id")).distinct().selectExpr("case", "id", "'data' AS kind", "cast(null AS string) AS resource_type", "cast(null AS string) AS original_file_path")
    graph = type(graph)(nodes, edges, graph.exposures.withColumn("case", F.lit("")), by=("case",))
    observed = [(c, a, "2026-01-02 10:00:00", i, "v", C.VALUE_SUBSTITUTION, 0.4, 0.9) for c, _, seen, _ in RCA_CASES for i, a in enumerate(seen)]
    observations = spark.createDataFrame(observed, "case string, asset string, observed_at string, obs_ord int, column string, signature string, magnitude double, confidence double")
    observations = observations.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    changes = change_rows(spark, [(c, i, f"{DAY.get(i, '2026-01-02')} {t}:00", [x], i) for c, _, _, cs in RCA_CASES for i, t, x in cs], "case")
    return observations, changes, graph


#: (case, model edges, exposures as (id, type, maturity, parent, override), changed, expected exposures, expected severity)
BLAST_CASES = [
    ("dashboard_high", [("root", "leaf")], ("e.dash", "dashboard", "high", "leaf", None), "leaf", ["e.dash"], "high"),
    ("application_critical", [("fact", "rev")], ("e.api", "application", "high", "rev", None), "fact", ["e.api"], "critical"),
    ("override_critical", [("fact", "rev")], ("e.ovr", "dashboard", "medium", "rev", "critical"), "fact", ["e.ovr"], "critical"),
    ("sibling_decoy", [("root", "a"), ("root", "b")], ("e.dash", "dashboard", "high", "b", None), "a", [], "medium"),
    ("ancestor_decoy", [("up", "mid"), ("mid", "down")], ("e.dash", "dashboard", "high", "up", None), "mid", [], "high"),
    ("notebook_no_escalation", [("fact", "rev")], ("e.nb", "notebook", "high", "rev", None), "fact", ["e.nb"], "high"),
]


def blast_incidents(spark) -> DataFrame:
    """Incidents of the blast-radius cases; the symptom is on the first asset below the changed one, else on that."""
    edges, nodes, exposures, observed, changes = [], [], [], [], []
    for case, es, (xid, kind, maturity, parent, override), changed, _, _ in BLAST_CASES:
        edges += [(case, a, b) for a, b in es] + [(case, parent, xid)]
        nodes += [(case, x, "data", None, None) for x in dict.fromkeys(y for e in es for y in e)] + [(case, xid, "exposure", "exposure", None)]
        exposures.append((case, xid, xid, kind, maturity, override, "", None, [parent]))
        below = sorted(b for a, b in es if a == changed)
        observed.append((case, below[0] if below else changed, "2026-01-02 10:00:00", 0, "v", C.VALUE_SUBSTITUTION, 0.4, 0.9))
        changes.append((case, "c1", "2026-01-02 09:50:00", [changed], "deploy"))
    graph = Lineage(spark.createDataFrame(nodes, "case string, " + NODE), spark.createDataFrame(edges, "case string, " + EDGE), spark.createDataFrame(exposures, "case string, " + EXPOSURE), ("case",))
    rows = spark.createDataFrame(observed, "case string, asset string, observed_at string, obs_ord int, column string, signature string, magnitude double, confidence double")
    return rca.incidents(rows.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")), change_rows(spark, changes, "case"), graph)


def evaluate_rca(spark: SparkSession) -> DataFrame:
    """(cases, top1): how often the true change ranks first."""
    top = rca.rank_root_causes(*rca_tables(spark)).filter("rank = 1 AND case != 'a_day_exactly'")
    return top.agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("change_id") == "true").cast("double")).alias("top1"))


def evaluate_blast_radius(spark: SparkSession) -> DataFrame:
    """(tp, fp, fn, precision, recall, severity_accuracy) over the labelled cases."""
    incidents = blast_incidents(spark)
    found = incidents.select("case", F.explode("exposures").alias("e")).select("case", F.col("e.unique_id").alias("id"))
    expected = spark.createDataFrame([(c, x) for c, _, _, _, xs, _ in BLAST_CASES for x in xs], "case string, id string")
    levels = spark.createDataFrame([(c, s) for c, *_, s in BLAST_CASES], "case string, expected string")
    right = levels.join(incidents.select("case", "severity"), "case", "left").agg(F.avg(F.coalesce(F.col("severity") == F.col("expected"), F.lit(False)).cast("double")).alias("severity_accuracy"))
    return evaluate.set_scores(found, expected).crossJoin(F.broadcast(right))  # one row each
