import os

import pytest

from compare import connect, rows_of, rows_of_sql
from tidemark.plans import catalogue, workloads  # noqa: F401

LARGER = "/root/testdata/sf0.01"
#: Quick ones; all run against SQL in the driver's correctness gate.
CHECKED = ["profile_stats_orders", "profile_sorted_quantiles", "profile_topk_events", "profile_nonfinite", "coverage_by_column", "sig_value_substitution", "sig_case_format", "sig_split", "sig_merge", "sig_distribution_shift", "sig_unit_scale_mult", "precedence_all", "decoy_volume_doubled", "split_real_vs_real", "blast_radius", "exposure_criticality", "change_events_from_commits", "changes_union_dedup", "rca_rank", "severity_escalation", "incident_synthesis", "reliability_bins", "stratified_folds", "store_upsert"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    assert rows_of(catalogue.QUERIES[name](spark, LARGER)) == rows_of_sql(connect(LARGER), catalogue.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
