"""Scans, expressions, windows, filters and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions import clip_negative, residual, round_half_even, to_number
from sensorframe.operators import gaps
from sensorframe.operators.correlation import correlated_features, correlation_pairs, drop_correlated
from sensorframe.operators.crossval import fold_sizes, fold_split, positive_label
from sensorframe.operators.features import (
    CROSS_TERMS,
    DIFFS,
    LAGS,
    TEXT_CHANNELS,
    WINDOWS,
    FeatureSpec,
    engineer,
    feature_columns,
    project,
)
from sensorframe.operators.layout import RunLayout
from sensorframe.operators.scaling import scaler_fit, scaler_values, standardize
from sensorframe.operators.selection import above_median, selection_counts, top_scores
from sensorframe.plans import feature_frame, learning_frame
from sensorframe.queries.common import (
    CHANNELS_SQL,
    FROM_SQL,
    IDS,
    RUNS_SQL,
    UP_TO_SQL,
    W_SQL,
    channels,
    frame_sql,
    interpolated_sql,
    labelled,
    layout_of,
    neighbours_sql,
    number_sql,
    repaired_sql,
    rounded,
    runs,
    show,
    sql_rounded,
    sql_show,
)
from sensorframe.sources import stack_runs
from sensorframe.sources.tables import KEYS, ORDER

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- sources -----------------------------------------------------------------------------------


@query(f"WITH {RUNS_SQL} SELECT run_id, event_id, event_type, {sql_show([], ['value', 'k', 'm'])}, t_raw FROM runs")
def q_scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runs(spark, sf_dir)
    return df.select(*IDS, "event_type", *[rounded(c).alias(c) for c in ("value", "k", "m")], "t_raw")


@query(
    f"""WITH {RUNS_SQL}
    SELECT run_id, event_id, round_even((value) * 1e6, 0) / 1e6 + 0.0 AS value, NULL::DOUBLE AS k FROM runs WHERE event_type = 'error'
    UNION ALL
    SELECT run_id, event_id, NULL::DOUBLE, round_even((k) * 1e6, 0) / 1e6 + 0.0 FROM runs WHERE event_type <> 'error'"""
)
def q_stack_runs(spark, sf_dir):
    """Two groups of frames with different columns, stacked."""
    df = runs(spark, sf_dir)
    with_value = df.where(F.col("event_type") == "error").select(*IDS, "value")
    with_k = df.where(F.col("event_type") != "error").select(*IDS, "k")
    return show(stack_runs([with_value, with_k]), IDS, ["value", "k"])


# -- projections -------------------------------------------------------------------------------


@query(f"WITH {RUNS_SQL} SELECT run_id, event_id, t_raw, {number_sql('t_raw')} AS t FROM runs")
def q_coerce(spark, sf_dir):
    return runs(spark, sf_dir).select(*IDS, "t_raw", to_number(F.col("t_raw")).alias("t"))


@query(
    """SELECT event_id, round_even(value / 4, 1) + 0.0 AS quarter, round_even(value, 1) + 0.0 AS tenth FROM events"""
)
def q_round_even(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        "event_id",
        (round_half_even(F.col("value") / 4) + 0.0).alias("quarter"),
        (round_half_even(F.col("value")) + 0.0).alias("tenth"),
    )


def _repaired(spark, sf_dir, profile=()):
    """Eight channels with Temp and Hum repaired, and the layout."""
    df = channels(spark, sf_dir)
    layout = layout_of(df, profile)
    return gaps.repair_channels(df, layout, TEXT_CHANNELS), layout


REPAIRED_SQL = f"""{CHANNELS_SQL},
numbers AS (SELECT * REPLACE ({number_sql('"Temp"')} AS "Temp", {number_sql('"Hum"')} AS "Hum") FROM channels),
repaired AS (SELECT * REPLACE ({repaired_sql('"Temp"')} AS "Temp", {repaired_sql('"Hum"')} AS "Hum") FROM numbers)"""


def _only(*kinds: str) -> FeatureSpec:
    return FeatureSpec(lags=(), windows=(), diffs=(), cross=tuple(t for t in CROSS_TERMS if t[0] in kinds))


def _cross_sql(kind: str, a: str, b: str) -> str:
    lag = f'lag("{b}", 1) OVER {W_SQL}'
    return {
        "product": f'"{a}" * "{b}" AS "{a}_x_{b}"',
        "ratio": f'"{a}" / NULLIF("{b}" + 1e-6, 0) AS "{a}_div_{b}"',
        "lag_product": f'"{a}" * {lag} AS "{a}_x_{b}_lag1"',
        "mean_ratio": f'"{a}" / NULLIF(avg("{b}") OVER {frame_sql(2, 2)} + 1e-6, 0) AS "{a}_div_{b}_roll_mean_5"',
        "diff_product": f'"{a}" * ("{b}" - {lag}) AS "{a}_x_{b}_diff1"',
    }[kind]


def _cross_query(name: str, kind: str) -> None:
    """One query per kind of cross term, over the whole run view."""
    spec = _only(kind)
    names = [n for n in spec.names() if n not in spec.channels]

    def run(spark, sf_dir):
        df, layout = _repaired(spark, sf_dir)
        return show(engineer(df, layout, spec), IDS, names)

    run.__name__ = name
    items = ", ".join(_cross_sql(*t) for t in spec.cross)
    query(
        f"WITH {REPAIRED_SQL}, made AS (SELECT run_id, event_id, {items} FROM repaired)"
        f" SELECT {sql_show(IDS, names)} FROM made"
    )(run)


_cross_query("q_products", "product")
_cross_query("q_ratios", "ratio")
_cross_query("q_lag_product", "lag_product")
_cross_query("q_mean_ratio", "mean_ratio")
_cross_query("q_diff_product", "diff_product")


# -- the feature frame -------------------------------------------------------------------------

NARROW = FeatureSpec(
    channels=("value", "m"),
    lags=(1, 3),
    windows=(5, 10),
    diffs=(1, 2),
    cross=(
        ("product", "value", "m"),
        ("ratio", "value", "m"),
        ("lag_product", "m", "m"),
        ("mean_ratio", "value", "value"),
        ("diff_product", "value", "m"),
    ),
)


def _stat_sql(c: str, stat: str, size: int) -> str:
    f = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    return f'{f}("{c}") OVER {frame_sql(size // 2, (size - 1) // 2)} AS "{c}_roll_{stat}_{size}"'


def features_sql(spec: FeatureSpec) -> str:
    items = [f'lag("{c}", {k}) OVER {W_SQL} AS "{c}_lag{k}"' for c in spec.channels for k in spec.lags]
    items += [_stat_sql(c, s, n) for c in spec.channels for n in spec.windows for s in spec.stats]
    items += [f'"{c}" - lag("{c}", {k}) OVER {W_SQL} AS "{c}_diff{k}"' for c in spec.channels for k in spec.diffs]
    return ", ".join([*items, *[_cross_sql(*t) for t in spec.cross]])


def complete_sql(ctes: str, source: str, spec: FeatureSpec) -> str:
    """CTEs ending in ``frame``: engineered, interpolated, complete rows."""
    names = spec.names()
    known = " AND ".join(f'"{c}" IS NOT NULL' for c in names)
    return f"""{ctes},
    engineered AS (SELECT *, {features_sql(spec)}, row_number() OVER {W_SQL} AS pos FROM {source}),
    around AS (SELECT *, {", ".join(neighbours_sql(c) for c in names)} FROM engineered),
    filled AS (SELECT run_id, ts, event_id, hours_left, {", ".join(interpolated_sql(c) for c in names)} FROM around),
    frame AS (SELECT * FROM filled WHERE {known})"""


def narrow_frame(spark, sf_dir) -> DataFrame:
    raw = labelled(spark, sf_dir).select("run_id", "ts", "event_id", "hours_left", "value", "m")
    return feature_frame(raw, NARROW)


NARROW_SQL = complete_sql(RUNS_SQL, "runs", NARROW)
FULL = FeatureSpec()
FULL_SQL = complete_sql(REPAIRED_SQL, "repaired", FULL)


@query(f"WITH {NARROW_SQL} SELECT {sql_show([*IDS, 'ts'], ['hours_left', *NARROW.names()])} FROM frame")
def q_feature_frame(spark, sf_dir):
    return show(narrow_frame(spark, sf_dir), [*IDS, "ts"], ["hours_left", *NARROW.names()])


@query(f"WITH {NARROW_SQL} SELECT {sql_show([*IDS, 'ts'], ['hours_left', *NARROW.names()])} FROM frame")
def q_feature_frame_cut(spark, sf_dir):
    """The same frame with every run cut into chunks of about 20 rows."""
    raw = labelled(spark, sf_dir).select("run_id", "ts", "event_id", "hours_left", "value", "m")
    return show(feature_frame(raw, NARROW, max_rows=20), [*IDS, "ts"], ["hours_left", *NARROW.names()])


@query(f"WITH {REPAIRED_SQL} SELECT {sql_show(IDS, TEXT_CHANNELS)} FROM repaired")
def q_repair_cut(spark, sf_dir):
    df = channels(spark, sf_dir)
    layout = RunLayout.plan(df, KEYS, ORDER, 20)
    return show(gaps.repair_channels(layout.attach(df), layout, TEXT_CHANNELS), IDS, TEXT_CHANNELS)


# Seven decimals show every mean of up to 20 readings without a tie; deviations carry more noise.
_STD = [c for c in FULL.names() if "_std_" in c]
_EXACT = ["hours_left", *[c for c in FULL.names() if c not in _STD]]


@query(f"WITH {FULL_SQL} SELECT {sql_show(IDS, _EXACT, 7)}, {sql_show([], _STD, 5)} FROM frame")
def q_feature_frame_full(spark, sf_dir):
    """All 172 columns."""
    frame = feature_frame(channels(spark, sf_dir), FULL)
    return frame.select(
        *IDS, *[rounded(c, 7).alias(c) for c in _EXACT], *[rounded(c, 5).alias(c) for c in _STD]
    )


@query(f"WITH {NARROW_SQL} SELECT {sql_show(IDS, NARROW.names())} FROM frame")
def q_select_features(spark, sf_dir):
    """Columns chosen by name pattern; time axis, keys and label stay out."""
    frame = narrow_frame(spark, sf_dir)
    names = feature_columns(frame.columns, NARROW.channels, exclude=["ts"])
    return show(project(frame, [*names, "not_there"], IDS), IDS, names)


# -- windows -----------------------------------------------------------------------------------


def _window_query(name: str, spec: FeatureSpec, decimals: int = 6, std_decimals: int = 6) -> None:
    """One feature family on a whole channel (value) and a gappy one (m), gaps left as they are."""
    names = [n for n in spec.names() if n not in spec.channels]
    std = [n for n in names if "_std_" in n]
    exact = [n for n in names if n not in std]

    def run(spark, sf_dir):
        df = runs(spark, sf_dir)
        made = engineer(df, layout_of(df), spec)
        return made.select(*IDS, *[rounded(f"`{c}`", decimals).alias(c) for c in exact], *[rounded(f"`{c}`", std_decimals).alias(c) for c in std])

    run.__name__ = name
    shown = ", ".join(filter(None, [sql_show(IDS, exact, decimals), sql_show([], std, std_decimals)]))
    query(f"WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, {features_sql(spec)} FROM runs) SELECT {shown} FROM made")(run)


_EMPTY = {"channels": ("value", "m"), "lags": (), "windows": (), "diffs": (), "cross": ()}
_window_query("q_lags", FeatureSpec(**{**_EMPTY, "lags": LAGS}))
_window_query("q_diffs", FeatureSpec(**{**_EMPTY, "diffs": DIFFS}))
for _stat in ("mean", "std", "min", "max"):
    _window_query(f"q_roll_{_stat}", FeatureSpec(**{**_EMPTY, "windows": WINDOWS, "stats": (_stat,)}))
_window_query("q_roll_wide", FeatureSpec(**{**_EMPTY, "windows": (33, 50, 100), "stats": ("mean", "std", "min", "max")}), 9, 5)  # nine decimals show means of up to 128 readings without a tie


@query(
    f"WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, last_value(m IGNORE NULLS) OVER {UP_TO_SQL} AS m FROM runs)"
    f" SELECT {sql_show(IDS, ['m'])} FROM made"
)
def q_ffill(spark, sf_dir):
    df = runs(spark, sf_dir)
    return show(gaps.forward_fill(df, layout_of(df), ["m"]), IDS, ["m"])


@query(
    f"WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, coalesce(last_value(m IGNORE NULLS) OVER {UP_TO_SQL},"
    f" first_value(m IGNORE NULLS) OVER {FROM_SQL}) AS m FROM runs) SELECT {sql_show(IDS, ['m'])} FROM made"
)
def q_ffill_bfill(spark, sf_dir):
    df = runs(spark, sf_dir)
    return show(gaps.fill_both_ways(df, layout_of(df), ["m"]), IDS, ["m"])


@query(
    f"WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, first_value(m IGNORE NULLS) OVER {FROM_SQL} AS m FROM runs)"
    f" SELECT {sql_show(IDS, ['m'])} FROM made"
)
def q_bfill(spark, sf_dir):
    df = runs(spark, sf_dir)
    return show(gaps.backward_fill(df, layout_of(df), ["m"]), IDS, ["m"])


@query(
    f"""WITH {RUNS_SQL}, numbered AS (SELECT *, row_number() OVER {W_SQL} AS pos FROM runs),
    around AS (SELECT *, {neighbours_sql("m")} FROM numbered),
    made AS (SELECT run_id, event_id, {interpolated_sql("m")} FROM around)
    SELECT {sql_show(IDS, ["m"])} FROM made"""
)
def q_interpolate(spark, sf_dir):
    df = runs(spark, sf_dir)
    return show(gaps.interpolate(df, layout_of(df), ["m"]), IDS, ["m"])


@query(f"WITH {REPAIRED_SQL} SELECT {sql_show(IDS, TEXT_CHANNELS)} FROM repaired")
def q_repair(spark, sf_dir):
    return show(_repaired(spark, sf_dir)[0], IDS, TEXT_CHANNELS)


# -- filters and folds -------------------------------------------------------------------------


@query(
    f"""WITH {RUNS_SQL}, made AS (
      SELECT run_id, event_id, hours_left, lag(value, 1) OVER {W_SQL} AS value_lag1,
        avg(value) OVER {frame_sql(2, 2)} AS value_roll_mean_5 FROM runs)
    SELECT {sql_show(IDS, ["hours_left", "value_lag1", "value_roll_mean_5"])} FROM made WHERE hours_left > 0"""
)
def q_positive_label(spark, sf_dir):
    df = labelled(spark, sf_dir)
    spec = FeatureSpec(channels=("value",), lags=(1,), windows=(5,), stats=("mean",), diffs=(), cross=())
    made = positive_label(engineer(df, layout_of(df), spec), "hours_left")
    return show(made, IDS, ["hours_left", "value_lag1", "value_roll_mean_5"])


@query(
    f"""WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, value, m, {number_sql("t_raw")} AS t FROM runs)
    SELECT {sql_show(IDS, ["value", "m", "t"])} FROM made WHERE value IS NOT NULL AND m IS NOT NULL AND t IS NOT NULL"""
)
def q_dropna(spark, sf_dir):
    df = runs(spark, sf_dir).select(*IDS, "value", "m", to_number(F.col("t_raw")).alias("t"))
    return show(gaps.drop_incomplete(df), IDS, ["value", "m", "t"])


@query(
    f"""WITH {RUNS_SQL} SELECT CASE WHEN run_id = 3 THEN 'test' ELSE 'train' END AS part, run_id, event_id,
    round_even((value) * 1e6, 0) / 1e6 + 0.0 AS value FROM runs WHERE hours_left > 0"""
)
def q_fold_split(spark, sf_dir):
    rows = positive_label(labelled(spark, sf_dir), "hours_left")
    train, test = fold_split(rows, F.col("run_id") == 3)
    both = stack_runs([train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))])
    return show(both, ["part", *IDS], ["value"])


@query(
    f"""WITH {RUNS_SQL}, own AS (
      SELECT run_id AS fold, count(*) FILTER (WHERE hours_left > 0) AS n_test FROM runs GROUP BY run_id)
    SELECT fold, CAST(sum(n_test) OVER () AS BIGINT) - n_test AS n_train, n_test,
      n_test > 0 AND sum(n_test) OVER () - n_test > 0 AS usable FROM own"""
)
def q_fold_sizes(spark, sf_dir):
    return fold_sizes(labelled(spark, sf_dir), "run_id", "hours_left")


# -- aggregates over lineitem and events --------------------------------------------------------

# Order-insensitive numeric columns of lineitem; one constant, one nearly a copy of another.
LINE_COLUMNS = {
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "net": "l_extendedprice * (1 - l_discount)",
    "gross": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "unit": "l_extendedprice / l_quantity",
    "constant": "l_quantity * 0 + 1",
}
LINE_NAMES = list(LINE_COLUMNS)
LINES_SQL = "lines AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LINE_COLUMNS.items()) + " FROM lineitem)"


def lines(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in LINE_COLUMNS.items()])


def _pairs_sql(names=LINE_NAMES, source: str = "lines", ctes: str = LINES_SQL) -> str:
    cells = ", ".join(
        f"{{'i': {i}, 'j': {j}, 'feature_i': '{a}', 'feature_j': '{b}', 'corr': corr({a}, {b})}}"
        for j, b in enumerate(names)
        for i, a in enumerate(names[:j])
    )
    return f"""{ctes}, cells AS (SELECT unnest([{cells}], recursive := true) FROM {source}),
    pairs AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, feature_i, feature_j,
      CASE WHEN NOT isnan(corr) THEN corr END AS corr FROM cells)"""


@query(f"WITH {_pairs_sql()} SELECT {sql_show(['i', 'j', 'feature_i', 'feature_j'], ['corr'])} FROM pairs")
def q_corr_pairs(spark, sf_dir):
    pairs = correlation_pairs(lines(spark, sf_dir), LINE_NAMES)
    return show(pairs, ["i", "j", "feature_i", "feature_j"], ["corr"])


# Columns with gaps in different rows; one that is constant wherever the gappy one is known, and one without values.
GAPPY_COLUMNS = {
    "value": "value",
    "m": "m",
    "late": "CASE WHEN event_id % 3 > 0 THEN hours_left + value END",
    "early": "CASE WHEN event_id % 2 = 0 THEN value * hours_left END",
    "still": "CASE WHEN m IS NULL THEN value ELSE 2.5 END",
    "none": "CASE WHEN event_id < 0 THEN value END",
}
GAPPY_SQL = f"{RUNS_SQL}, gappy AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in GAPPY_COLUMNS.items()) + " FROM runs)"


@query(f"WITH {_pairs_sql(list(GAPPY_COLUMNS), 'gappy', GAPPY_SQL)} SELECT {sql_show(['i', 'j', 'feature_i', 'feature_j'], ['corr'])} FROM pairs")
def q_corr_gaps(spark, sf_dir):
    """Each pair over the rows in which both are known."""
    rows = labelled(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in GAPPY_COLUMNS.items()])
    return show(correlation_pairs(rows, list(GAPPY_COLUMNS)), ["i", "j", "feature_i", "feature_j"], ["corr"])


@query(
    f"""WITH {_pairs_sql()} SELECT j, feature_j, round_even((max(abs(corr))) * 1e6, 0) / 1e6 + 0.0 AS max_abs_corr
    FROM pairs GROUP BY j, feature_j HAVING max(abs(corr)) > 0.9"""
)
def q_corr_filter(spark, sf_dir):
    pairs = correlation_pairs(lines(spark, sf_dir), LINE_NAMES)
    return show(correlated_features(pairs), ["j", "feature_j"], ["max_abs_corr"])


@query(f"WITH {LINES_SQL} SELECT {sql_show([], ['quantity', 'price', 'discount', 'tax', 'unit', 'constant'])} FROM lines")
def q_drop_correlated(spark, sf_dir):
    """The rows without the columns the filter drops."""
    df, _ = drop_correlated(lines(spark, sf_dir), LINE_NAMES)
    return show(df, [], df.columns)


@query(
    f"WITH {RUNS_SQL}, wide AS (SELECT "
    + ", ".join(
        f"count(*) - count({c}) AS {c}" for c in ("value", "k", "m", "t")
    )
    + f" FROM (SELECT *, {number_sql('t_raw')} AS t FROM runs)), "
    "long AS (UNPIVOT wide ON value, k, m, t INTO NAME column_name VALUE n_missing) "
    "SELECT column_name, n_missing, n_missing > 0 AS has_missing FROM long"
)
def q_null_profile(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("t", to_number(F.col("t_raw")))
    return gaps.null_profile(df, ["value", "k", "m", "t"])


_FIT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_rounded(f'avg({c})', 5)} AS mean, {sql_rounded(f'stddev_pop({c})', 5)} AS std FROM lines"
    for c in LINE_NAMES
)


@query(f"WITH {LINES_SQL} {_FIT_SQL}")
def q_scaler_fit(spark, sf_dir):
    return show(scaler_fit(lines(spark, sf_dir), LINE_NAMES), ["feature"], ["mean", "std"], 5)


@query(
    f"WITH {LINES_SQL}, fit AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in LINE_NAMES)
    + " FROM lines), made AS (SELECT "
    + ", ".join(f"CASE WHEN {c}_s = 0 THEN {c} - {c}_m ELSE ({c} - {c}_m) / {c}_s END AS {c}" for c in LINE_NAMES)
    + f" FROM lines, fit) SELECT {sql_show([], LINE_NAMES)} FROM made"
)
def q_standardize(spark, sf_dir):
    df = lines(spark, sf_dir)
    return show(standardize(df, scaler_values(df, LINE_NAMES)), [], LINE_NAMES)


@query(
    f"""WITH {RUNS_SQL}, made AS (SELECT run_id, event_id, m - k AS raw FROM runs)
    SELECT run_id, event_id, round_even((raw) * 1e6, 0) / 1e6 + 0.0 AS raw, round_even((CASE WHEN raw < 0 THEN 0.0 ELSE raw END) * 1e6, 0) / 1e6 + 0.0 AS predicted FROM made"""
)
def q_clip(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("raw", F.col("m") - F.col("k"))
    return show(df.withColumn("predicted", clip_negative(F.col("raw"))), IDS, ["raw", "predicted"])


@query(f"WITH {RUNS_SQL}, made AS (SELECT *, value - k AS residual FROM runs) SELECT {sql_show(IDS, ['residual'])} FROM made")
def q_residuals(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("residual", residual(F.col("value"), F.col("k")))
    return show(df, IDS, ["residual"])


# -- score tables ------------------------------------------------------------------------------


def feature_scores(spark, sf_dir) -> DataFrame:
    """One score per narrow feature that SQL can follow: |corr(feature, label)|."""
    rows, names = learning_frame(narrow_frame(spark, sf_dir), "hours_left", IDS, NARROW.channels)
    wide = rows.agg(*[F.abs(F.corr(c, "hours_left")).alias(c) for c in names])
    return wide.unpivot([], names, "feature", "importance")


SCORES_TABLE_SQL = (
    f"{NARROW_SQL}, score_table AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr(\"{c}\", hours_left)) AS importance FROM frame WHERE hours_left > 0"
        for c in NARROW.names()
    )
    + ")"
)


@query(
    f"""WITH {SCORES_TABLE_SQL} SELECT feature, round_even((importance) * 1e6, 0) / 1e6 + 0.0 AS importance FROM score_table
    WHERE importance >= (SELECT quantile_cont(importance, 0.5) FROM score_table)"""
)
def q_median_select(spark, sf_dir):
    return show(above_median(feature_scores(spark, sf_dir)), ["feature"], ["importance"])


@query(
    f"""WITH {SCORES_TABLE_SQL} SELECT count(*) AS n_before, count(*) FILTER (
    WHERE importance >= (SELECT quantile_cont(importance, 0.5) FROM score_table)) AS n_after FROM score_table"""
)
def q_selection_counts(spark, sf_dir):
    return selection_counts(feature_scores(spark, sf_dir))


@query(
    f"""WITH {SCORES_TABLE_SQL} SELECT feature, round_even((importance) * 1e6, 0) / 1e6 + 0.0 AS importance FROM score_table
    ORDER BY score_table.importance DESC, feature LIMIT 20"""
)
def q_topk_scores(spark, sf_dir):
    return show(top_scores(feature_scores(spark, sf_dir)), ["feature"], ["importance"])
