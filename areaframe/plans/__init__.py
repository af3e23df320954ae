"""Complete jobs built from the operators."""

from .area_features import AREA_COLUMNS, area_features
from .model_features import MODEL_COLUMNS, land_use_histogram, model_features
from .train_evaluate import evaluate, prepare_features, train_and_evaluate
from .tree_health import health_pivot, health_profile, health_summary, kept_trees

__all__ = [
    "AREA_COLUMNS",
    "MODEL_COLUMNS",
    "area_features",
    "evaluate",
    "health_pivot",
    "health_profile",
    "health_summary",
    "kept_trees",
    "land_use_histogram",
    "model_features",
    "prepare_features",
    "train_and_evaluate",
]
