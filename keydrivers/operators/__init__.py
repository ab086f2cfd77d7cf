from .charts import (
    QUARTILES,
    auto_histogram,
    box_stats,
    distribution_by,
    histogram,
    scatter_points,
    scatter_sample,
    yearly_average,
)
from .clean import drop_columns, drop_sparse_columns, normalize_category, standardize_columns
from .correlate import (
    collinear_with,
    correlation_matrix,
    correlation_wide,
    correlations_with,
    target_correlation,
)
from .explain import (
    coefficient_table,
    feature_importance,
    field_rollup,
    importance_by_field,
    model_metrics,
    overfit_report,
    overfit_reports,
    residual_table,
    slot_table,
)
from .features import (
    build_features,
    feature_pipeline,
    feature_slots,
    index_categories,
    one_hot,
    prepared,
)
from .forest_path import forest_nodes
from .levels import level_index, slot_frame, with_level_index
from .metrics import leaderboard, metrics_of_all, regression_metrics, stacked
from .models import (
    FittedRegression,
    LinearFit,
    fit_forest,
    fit_linear,
    fit_linear_pipeline,
    forest_regressor,
    linear_path,
    linear_regressor,
    model_pipeline,
    score,
    score_all,
)
from .ordering import top_k
from .profile import category_cardinality, category_values, null_profile
from .quantiles import quantiles_by
from .split import assign_folds, mark_split, random_split, split
from .tuning import (
    FOLDS,
    FOREST_GRID,
    RIDGE_GRID,
    CvResult,
    best_params,
    cross_validate,
    cv_report,
    forest_cv,
    param_grid,
    ridge_cv,
)

__all__ = [name for name in dir() if not name.startswith("_")]
