"""Fuzzy-rough row quality, kNN regression and prototype selection on Spark.

The public surface works on plain DataFrames described by a :class:`RowSpec`.
"""

from protosift.operators.approximation import (
    approximations,
    class_approximations,
    quality_hml,
)
from protosift.operators.conflicts import conflict_summary, owa_blocks, quality_powa
from protosift.operators.crossval import rmse_by_fold, rmse_cv, rmse_cv_scaled
from protosift.operators.neighbours import knn_predict, knn_topk
from protosift.operators.owa import owa
from protosift.operators.selection import (
    best_threshold,
    choose_prototypes,
    join_quality,
    select_prototypes,
    threshold_sweep,
)
from protosift.operators.stats import column_minmax, column_ranges, scale
from protosift.spec import RowSpec, parse_attr_types

__all__ = [
    "RowSpec",
    "approximations",
    "best_threshold",
    "choose_prototypes",
    "class_approximations",
    "column_minmax",
    "column_ranges",
    "conflict_summary",
    "join_quality",
    "knn_predict",
    "knn_topk",
    "owa",
    "owa_blocks",
    "parse_attr_types",
    "quality_hml",
    "quality_powa",
    "rmse_by_fold",
    "rmse_cv",
    "rmse_cv_scaled",
    "scale",
    "select_prototypes",
    "threshold_sweep",
]
