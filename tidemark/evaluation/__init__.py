"""Labelled scenarios and cases, trials on real tables, and what the detectors make of them."""

from tidemark.evaluation.cases import evaluate_blast_radius, evaluate_rca
from tidemark.evaluation.dataset import GridPoint, build_coefficients, calibration_dataset, default_grid, fit_frozen_model
from tidemark.evaluation.registry import RealDataset, Recipe, build_registry, loadable
from tidemark.evaluation.runner import EvalReport, false_positive_examples, render_report, run_registry
from tidemark.evaluation.scenarios import SCENARIOS, Scenario, evaluate_scenarios, scenario_frames

__all__ = [
    "EvalReport",
    "GridPoint",
    "RealDataset",
    "Recipe",
    "SCENARIOS",
    "Scenario",
    "build_coefficients",
    "build_registry",
    "calibration_dataset",
    "default_grid",
    "evaluate_blast_radius",
    "evaluate_rca",
    "evaluate_scenarios",
    "false_positive_examples",
    "fit_frozen_model",
    "loadable",
    "render_report",
    "run_registry",
    "scenario_frames",
]
