"""Collects all query modules."""
from . import q_confidence, q_features, q_geo, q_history, q_masks, q_matching, q_metrics, q_models, q_splits, q_tiles  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
