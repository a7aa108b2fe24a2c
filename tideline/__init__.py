"""Shoreline signals along transects, and training-data operators, on Spark."""

from .operators.boundaries import find_transitions
from .operators.classify import classify, smooth_classes
from .operators.config import CLASSES, DEFAULT, Config
from .operators.features import compute_features, valid_samples
from .operators.geometry import sample_transects
from .operators.matching import match_transitions, metrics
from .plans.workflows import analyze_all_transects, classify_samples, run_all_validations, training_samples
from .sources.readers import manual_zones, samples_csv, transects_geojson

__all__ = [
    "CLASSES", "DEFAULT", "Config", "analyze_all_transects", "classify", "classify_samples", "compute_features", "find_transitions", "manual_zones",
    "match_transitions", "metrics", "run_all_validations", "sample_transects", "samples_csv", "smooth_classes", "training_samples", "transects_geojson", "valid_samples",
]
