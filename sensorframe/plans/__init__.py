from sensorframe.plans.analysis import (
    Selection,
    evaluate,
    feature_frame,
    learning_frame,
    select_by_scores,
    select_features,
)

__all__ = ["Selection", "evaluate", "feature_frame", "learning_frame", "select_by_scores", "select_features"]
