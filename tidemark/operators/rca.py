"""Root causes and incidents: symptoms observed, joined with changes over time and lineage.

Tables, each optionally with ``by`` keys (cases, runs) that keep analyses apart:
observations (asset, observed_at, obs_ord, column, signature, magnitude, confidence, ...),
changes (change_id, ts, targets, label, change_ord).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators.lineage import Lineage
from tidemark.scratch import written


def _seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def explained(observations: DataFrame, changes: DataFrame, graph: Lineage, max_lead: float = C.MAX_LEAD_SECONDS) -> DataFrame:
    """Observations that a change explains: at most ``max_lead`` seconds before, on a target or below one.

    The join is on asset and on a bucket of time as long as ``max_lead``; an
    observation looks into its own bucket and the one before.
    """
    by = list(graph.by)
    targets = changes.select(*by, "change_id", "change_ord", "ts", "label", F.explode("targets").alias("src"))
    below = targets.join(graph.reach, [*by, "src"]).withColumnRenamed("dst", "asset").drop("src")
    at = targets.withColumnRenamed("src", "asset").unionByName(below).distinct()

    def bucket(t: Column) -> Column:
        return F.floor(_seconds(t, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) / F.lit(float(max_lead)))

    at = at.withColumn("bucket", bucket(F.col("ts").cast("timestamp_ntz")))
    now = bucket(F.col("observed_at").cast("timestamp_ntz"))
    seen = observations.withColumn("bucket", F.explode(F.array(now, now - 1)))
    lead = _seconds(F.col("observed_at"), F.col("ts"))
    rows = seen.join(at, [*by, "asset", "bucket"]).drop("bucket").withColumn("lead", lead)
    return rows.filter((F.col("lead") >= 0) & (F.col("lead") <= max_lead))


def rank_root_causes(observations: DataFrame, changes: DataFrame, graph: Lineage, max_lead: float = C.MAX_LEAD_SECONDS) -> DataFrame:
    """Candidates (by, rank, change_id, label, ts, change_ord, score, n_explained, min_lead, explained).

    Score: share of observations explained and mean closeness in time, weighted.
    Ties go to the later change, then to the one given first.
    """
    by = list(graph.by)
    rows = explained(observations, changes, graph, max_lead)
    fields = [c for c in observations.columns if c not in by]
    one = F.struct("obs_ord", *[c for c in fields if c != "obs_ord"])
    per = rows.groupBy(*by, "change_ord", "change_id", "label", "ts").agg(
        F.count(F.lit(1)).alias("n_explained"),
        F.avg(1 - F.col("lead") / F.lit(float(max_lead))).alias("proximity"),
        F.min("lead").alias("min_lead"),
        F.sort_array(F.collect_list(one)).alias("explained"),
    )
    total = observations.groupBy(*by).agg(F.count(F.lit(1)).alias("n_observed"))
    per = per.join(total, by) if by else per.crossJoin(F.broadcast(total))  # one row: a single total
    score = F.lit(C.COVERAGE_WEIGHT) * (F.col("n_explained") / F.col("n_observed")) + F.lit(C.PROXIMITY_WEIGHT) * F.col("proximity")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("ts"), F.asc("change_ord"))
    per = per.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return per.select(*by, "rank", "change_id", "label", "ts", "change_ord", "score", "n_explained", "min_lead", "explained")


def severity_rank(magnitude: Column, propagates: Column) -> Column:
    return F.when(magnitude < C.MATERIAL_MAGNITUDE, F.lit(1)).when(propagates, F.lit(3)).otherwise(F.lit(2))


def escalated(base: Column, worst_criticality: Column, magnitude: Column) -> Column:
    """Severity raised to the worst consumer's criticality, if the change is material; never lowered."""
    return F.when((magnitude >= C.MATERIAL_MAGNITUDE) & worst_criticality.isNotNull(), F.greatest(base, worst_criticality)).otherwise(base)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in C.SEVERITIES]), rank - 1)


def incidents(observations: DataFrame, changes: DataFrame, graph: Lineage, max_lead: float = C.MAX_LEAD_SECONDS) -> DataFrame:
    """The incident of each ``by`` group that has a candidate: its top one, what it affects, how severe it is."""
    by = list(graph.by)
    # Symptoms are few and dear: what computes them must not run once for each use.
    top = rank_root_causes(written(observations), changes, graph, max_lead).filter("rank = 1").drop("rank")
    targets = changes.select(*by, "change_ord", "targets")
    top = written(top.join(targets, [*by, "change_ord"]))
    # The first of the largest magnitudes, in the order of observation; numbers may repeat between assets, so the whole observation goes along.
    worst = F.array_min(F.transform("explained", lambda o: F.struct((-o["magnitude"]).alias("k"), o["obs_ord"].alias("obs_ord"), o.alias("o"))))
    top = top.withColumn("worst", worst["o"])
    target_ids = top.select(*by, F.explode("targets").alias("id")).distinct()
    seen = top.select(*by, F.explode("explained").alias("o")).select(*by, F.col("o.asset").alias("id"))
    affected = graph.data_nodes_below(target_ids).unionByName(seen).distinct().join(target_ids, [*by, "id"], "left_anti")
    exposures = graph.exposures_below(affected.unionByName(target_ids).distinct())
    listed = F.struct((-F.col("criticality")).alias("order"), "name", "unique_id", "type", "owner", "criticality")
    exposures = exposures.groupBy(*by).agg(F.sort_array(F.collect_list(listed)).alias("exposures"), F.max("criticality").alias("max_criticality"))
    affected = affected.groupBy(*by).agg(F.sort_array(F.collect_set("id")).alias("affected"))

    def same(a: DataFrame, b: DataFrame) -> DataFrame:
        if by:
            return a.join(b, by, "left")
        return a.join(b, F.lit(True), "left")  # one incident at most, one row of b at most

    out = same(same(top, affected), exposures)
    magnitude = F.col("worst.magnitude")
    base = severity_rank(magnitude, F.coalesce(F.size("affected"), F.lit(0)) > 0)
    rank = escalated(base, F.col("max_criticality"), magnitude)
    detected = F.array_max(F.transform("explained", lambda o: o["observed_at"]))
    return out.withColumn("affected", F.coalesce("affected", F.array().cast("array<string>"))).withColumn("severity", severity_name(rank)).withColumn("detected_at", detected).withColumnRenamed("ts", "change_at")


def derive_changes(commits: DataFrame, graph: Lineage, sha_length: int = 7) -> DataFrame:
    """Changes of the commits (sha, ts, subject, files) that touch a node's file, by time and id."""
    files = commits.select("sha", "ts", "subject", F.explode("files").alias("file"))
    touched = graph.nodes_for_files(files).groupBy("sha", "ts", "subject").agg(F.sort_array(F.collect_set("id")).alias("targets"))
    out = touched.select(F.substring("sha", 1, sha_length).alias("change_id"), "ts", "targets", F.col("subject").alias("label"))
    return out.withColumn("change_ord", F.row_number().over(Window.orderBy("ts", "change_id")) - 1)


def combine_changes(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Both lists without repeats in (id, set of targets, time); of repeats the first declared stays."""
    both = declared.withColumn("list", F.lit(0)).unionByName(derived.withColumn("list", F.lit(1)))
    key = Window.partitionBy("change_id", F.sort_array(F.array_distinct("targets")), "ts").orderBy("list", "change_ord")
    first = both.withColumn("n", F.row_number().over(key)).filter("n = 1").drop("n")
    return first.withColumn("change_ord", F.row_number().over(Window.orderBy("list", "change_ord")) - 1).drop("list")


def unknown_targets(changes: DataFrame, graph: Lineage) -> DataFrame:
    """(change_id, target) of targets that are not nodes of the graph."""
    return changes.select("change_id", F.explode("targets").alias("id")).join(graph.nodes, "id", "left_anti").select("change_id", F.col("id").alias("target"))
