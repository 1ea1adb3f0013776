"""Finds changes of meaning in data, what caused them and what they reach; every step is a Spark plan."""

from tidemark.cli import main
from tidemark.config import load_config
from tidemark.constants import DISTRIBUTION_THRESHOLD as DEFAULT_DISTRIBUTION_THRESHOLD
from tidemark.constants import FEATURE_NAMES
from tidemark.errors import EngineError
from tidemark.gate import gate_failed, worst_severity
from tidemark.operators.calibration import LogisticModel, reliability, render_reliability
from tidemark.operators.detect import detect, with_confidence, with_features
from tidemark.operators.inject import seeded_sample, two_sample_splits
from tidemark.operators.lineage import CRITICALITIES, Lineage, criticality, lineage, load_manifest
from tidemark.operators.profile import profile
from tidemark.operators.rca import combine_changes, derive_changes, incidents, rank_root_causes
from tidemark.operators.store import IncidentStore, identity, incident_list
from tidemark.plans.analyze import (
    AssetSnapshots,
    ChangeEvent,
    ColumnProfile,
    Exposure,
    Incident,
    NumericStats,
    Observation,
    RootCauseCandidate,
    Symptom,
    analyze_assets,
    analyze_change,
    analyze_change_from_profiles,
    detect_one,
    detect_symptoms,
    detect_symptoms_from_profiles,
    profile_column,
    profile_columns,
)
from tidemark.render import AssetResult, business_impact, markdown, multi_markdown, ui_json, write_documents
from tidemark.scratch import release, scratch_scope
from tidemark.sources.changes import collect_commits, resolve_range
from tidemark.sources.files import read_snapshot, read_table
from tidemark.sources.warehouse import DuckDBDialect, SnowflakeDialect, SparkDialect, SqlDialect, SqlProfileSource, spark_executor

__version__ = "0.2.0"
__all__ = [name for name in dir() if not name.startswith("_") and name not in ("cli", "config", "constants", "errors", "functions", "gate", "operators", "plans", "render", "scratch", "sources")]
