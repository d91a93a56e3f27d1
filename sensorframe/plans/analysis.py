"""The whole analysis: raw runs -> feature frame -> selected features -> held-out scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import nan_to_null
from sensorframe.operators import gaps
from sensorframe.operators.correlation import THRESHOLD, correlated_without, drop_correlated
from sensorframe.operators.crossval import Evaluation, cross_validate, positive_label
from sensorframe.operators.features import (
    TEXT_CHANNELS,
    FeatureSpec,
    engineer,
    feature_columns,
    gap_columns,
    project,
    telling_columns,
)
from sensorframe.operators.layout import MAX_ROWS, RunLayout
from sensorframe.operators.models import ModelSpec
from sensorframe.operators.selection import above_median, forest_importance
from sensorframe.session import written


def feature_frame(
    raw: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("ts", "event_id"),
    text_channels: Sequence[str] = TEXT_CHANNELS,
    also_fill: Sequence[str] = (),
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Repair, engineer, interpolate, keep complete rows.

    The order of steps matters: features come from channels that still have their gaps (only
    ``text_channels`` are repaired before), and every column is interpolated on its own after.
    ``also_fill`` names further numeric columns to interpolate, such as time axis and label.
    All steps share one exchange on the run.
    """
    numeric = [c for c in spec.channels if c not in text_channels]
    doubles = [c for c in (*numeric, *also_fill) if raw.schema[c].dataType.typeName() in ("double", "float")]
    raw = raw.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in doubles})  # a gap is NULL from here on
    layout = RunLayout.plan(raw, keys, order, max_rows, profile=[*numeric, *also_fill])
    repaired = [c for c in spec.channels if c in text_channels]
    # Steps on cut runs read their input for the rows, for what chunks say of themselves, and for the rows beside
    # them: saved in between, a step is computed once, and the next one's further reads are of the columns they need.
    step = written if layout.chunked else lambda df: df
    df = step(layout.attach(raw)) if layout.chunked else layout.dealt(raw)
    if repaired:
        df = step(gaps.repair_channels(df, layout, repaired))
    anywhere, _ = gap_columns(spec, layout, repaired)
    extra = [c for c in also_fill if c in layout.gappy]
    # Features of gappy channels first, while the rows that interpolation has to sort in
    # reverse are narrow; then the others, whose only gaps are at the start of a run.
    df = engineer(df, layout, spec, only=anywhere)
    if anywhere or extra:
        df = step(gaps.interpolate(step(df), layout, [*anywhere, *extra]))
    others = [f.name for f in spec.features() if f.name not in anywhere]
    df = engineer(df, layout, spec, only=others, fill_start=True)
    rest = [c for c in raw.columns if c not in spec.channels]
    telling = [*rest, *telling_columns(spec, [c for c in layout.gappy if c not in repaired])]
    return gaps.drop_incomplete(project(df, [*raw.columns, *[f.name for f in spec.features()]]), telling)


def learning_frame(
    frame: DataFrame,
    label: str,
    keep: Sequence[str],
    channels: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rows with a positive label, projected to ``keep``, label and features; and the features.

    Written once to the shared folder: every model makes several passes over these rows, and none
    of them should compute the features again.
    """
    names = feature_columns(frame.columns, channels) if channels else feature_columns(frame.columns)
    names = [c for c in names if c in frame.columns and c not in (*keep, label)]
    return written(project(positive_label(frame, label), names, [*keep, label])), names


@dataclass(frozen=True)
class Selection:
    importances: DataFrame
    by_importance: list[str]
    dropped: list[str]

    @property
    def features(self) -> list[str]:
        return [f for f in self.by_importance if f not in self.dropped]


def select_features(
    frame: DataFrame,
    features: Sequence[str],
    label: str,
    threshold: float | None = THRESHOLD,
    **forest_settings,
) -> Selection:
    """Forest importances, median cut, then the correlation filter (``threshold=None`` skips it)."""
    return select_by_scores(frame, forest_importance(frame, features, label, **forest_settings), threshold)


def select_by_scores(frame: DataFrame, importances: DataFrame, threshold: float | None = THRESHOLD) -> Selection:
    """The chain behind the scores: median cut, then the correlation filter. ``importances`` has position, feature
    and importance. Only names, at most one per feature, reach the driver."""
    kept = [r["feature"] for r in above_median(importances).orderBy("position").collect()]
    dropped = [] if threshold is None else drop_correlated(frame.select(*[f"`{c}`" for c in kept]), kept, threshold)[1]
    return Selection(importances, kept, dropped)


def evaluate(
    frame: DataFrame,
    features: Sequence[str],
    label: str,
    models: dict[str, ModelSpec],
    ids: Sequence[str],
    fold: str = "run_id",
    select_within_fold: bool = False,
    threshold: float | None = THRESHOLD,
    selector: dict | None = None,
    parallelism: int = 2,
) -> tuple[Evaluation, Selection | None]:
    """Select features, then cross-validate every model.

    By default the features are selected on all rows, held-out runs included, which leaks;
    ``select_within_fold`` selects on each fold's training rows instead.
    """
    kept = list(dict.fromkeys([*ids, fold, label, *features]))
    data = written(positive_label(frame, label).select(*[f"`{c}`" for c in kept]), sort_by=(fold,))
    settings = selector or {}
    if not select_within_fold:
        selection = select_features(data, features, label, threshold, **settings)
        return cross_validate(data, selection.features, label, models, ids, fold, parallelism, store=False), selection
    per_fold = select_without(data, features, label, fold, threshold, **settings)
    return cross_validate(data, per_fold, label, models, ids, fold, parallelism, store=False), None


def select_without(
    data: DataFrame, features: Sequence[str], label: str, fold: str, threshold: float | None = THRESHOLD, **forest_settings
) -> dict[object, list[str]]:
    """For each fold the features selected on the rows of all others. Forests are fitted fold by fold; the correlation
    filter of all folds comes from one pass over the rows."""
    folds = [r[0] for r in written(data.select(fold).distinct()).orderBy(fold).toLocalIterator()]
    pairs: dict[object, list[tuple[int, int]]] = {}
    if threshold is not None:
        for row in written(correlated_without(data, features, fold, threshold)).toLocalIterator():
            pairs.setdefault(row["fold"], []).append((row["i"], row["j"]))
    chosen = {}
    for key in folds:
        scores = forest_importance(data.where(F.col(fold) != F.lit(key)), features, label, **forest_settings)
        kept = {r["feature"] for r in above_median(scores).collect()}
        late = {features[j] for i, j in pairs.get(key, ()) if features[i] in kept}
        chosen[key] = [f for f in features if f in kept and f not in late]
    return chosen
