"""Feature table to cleaned columns, correlations, evaluated models and top features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from accesswatch.operators import model as M
from accesswatch.operators.quality import finite_means, impute_means
from accesswatch.operators.stats import correlation_matrix, high_correlations
from accesswatch.session import checkpoint_dir
from accesswatch.sources.schemas import LABEL, numeric_names


@dataclass(frozen=True)
class Diagnostics:
    correlations: DataFrame
    high_correlations: DataFrame
    evaluations: dict[str, DataFrame]
    importances: dict[str, DataFrame]
    top_features: DataFrame
    top_correlations: DataFrame


def diagnose(
    features: DataFrame, label: str = LABEL, event_id: str = "LogID", threshold: float = 0.6,
    trees: int = M.DIAGNOSTIC_TREES, max_depth: int = 30, c: float = 1.0,
) -> Diagnostics:
    """Every numeric column but the label is a feature; both models use balanced classes."""
    checkpoint_dir(features.sparkSession)
    names = numeric_names(features)
    inputs = [n for n in names if n not in (label, event_id)]
    labelled = features.where(features[label].isNotNull())
    clean = impute_means(labelled, finite_means(labelled, inputs)).checkpoint()
    train, test = M.stratified_split(clean, label, event_id=event_id)
    models = {
        "random_forest": M.fit_forest(train, inputs, label, trees=trees, max_depth=max_depth, scaled=()),
        "logistic": M.fit_logistic(train, inputs, label, M.balanced_weights(train, label), c=c, scaled=()),
    }
    ranked = {n: M.importances(m, inputs) for n, m in models.items()}
    top = M.top_feature_union(list(ranked.values()))
    chosen = sorted(r.feature for r in top.collect())
    return Diagnostics(
        correlations=correlation_matrix(clean, names, complete=True),
        high_correlations=high_correlations(clean, threshold, names, complete=True),
        evaluations={n: M.evaluate(M.predict(m, test), label) for n, m in models.items()},
        importances=ranked,
        top_features=top,
        top_correlations=correlation_matrix(clean, chosen, complete=True),
    )
