"""Gap handling and features against pandas, on whole runs and on runs cut into chunks."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.functions import clip_negative, guarded_ratio, round_half_even, to_number
from sensorframe.operators import gaps
from sensorframe.operators.features import (
    BASE_CHANNELS,
    GAS_CHANNELS,
    TEXT_CHANNELS,
    FeatureSpec,
    engineer,
    feature_columns,
)
from sensorframe.operators.layout import CHUNK, RunLayout
from sensorframe.operators.quantiles import exact_quantiles
from sensorframe.plans import feature_frame

INF = 1_000_000


def frame(spark, pdf: pd.DataFrame, schema: str):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def column(spark, values, **kw):
    schema = "run_id int, ts int, event_id int, x double"
    return spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], schema)


def values(df, c="x"):
    return [r[c] for r in df.orderBy("run_id", "ts", "event_id").collect()]


def plan(df, max_rows=INF, profile=()):
    return RunLayout.plan(df, ["run_id"], ["ts", "event_id"], max_rows, profile)


@pytest.mark.parametrize("max_rows", [INF, 3])
def test_interpolate_edges(spark, max_rows):
    df = column(spark, [None, None, 1.0, None, None, 4.0, None])
    layout = plan(df, max_rows)
    assert layout.chunked == (max_rows == 3)
    assert values(gaps.interpolate(df, layout, ["x"])) == [1, 1, 1, 2, 3, 4, 4]
    assert values(gaps.forward_fill(df, layout, ["x"])) == [None, None, 1, 1, 1, 4, 4]
    assert values(gaps.backward_fill(df, layout, ["x"])) == [1, 1, 1, 4, 4, 4, None]
    assert values(gaps.fill_both_ways(df, layout, ["x"])) == [1, 1, 1, 1, 1, 4, 4]
    assert CHUNK not in gaps.interpolate(df, layout, ["x"]).columns


def test_repair_rounds_half_even_and_steps(spark):
    rows = [(1, i, i, v) for i, v in enumerate([None, "2.25", "bad", " 2.35 ", "nan"])]
    df = spark.createDataFrame(rows, "run_id int, ts int, event_id int, x string")
    assert values(gaps.repair_channels(df, plan(df), ["x"])) == [2.2, 2.2, 2.2, 2.4, 2.4]


def test_numbers_from_text(spark):
    texts = ["1d", "1_000", "1e400", "", " 1.5 ", "inf", "-2e1", ".5", "5.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [
        None, None, None, None, 1.5, None, -20.0, 0.5, 5.0, None,
    ]


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, -1e-6, -3.2)], "a double, b double, p double")
    row = df.select(
        guarded_ratio(F.col("a"), F.col("b")), clip_negative(F.col("p")), round_half_even(F.col("a") * 2.25)
    ).head()
    assert list(row) == [None, 0.0, 2.2]
    assert df.select(clip_negative(F.lit(None).cast("double"))).head()[0] is None


def test_difference_is_two_rows_apart(spark):
    df = column(spark, [1.0, None, 4.0, 8.0])
    spec = FeatureSpec(channels=("x",), lags=(), windows=(), diffs=(2,), cross=())
    assert values(engineer(df, plan(df), spec), "x_diff2") == [None, None, 3.0, None]


def test_centred_window_of_ten(spark):
    df = column(spark, [float(i) for i in range(30)])
    spec = FeatureSpec(channels=("x",), lags=(), windows=(10,), stats=("min", "max"), diffs=(), cross=())
    row = engineer(df, plan(df), spec).where("event_id = 15").head()
    assert (row["x_roll_min_10"], row["x_roll_max_10"]) == (10.0, 19.0)


def test_feature_names():
    spec = FeatureSpec()
    assert len(spec.names()) == 172 and len(set(spec.names())) == 172
    assert feature_columns(["Hour", *spec.names(), "note"]) == spec.names()


# -- random runs against pandas ---------------------------------------------------------------

SCHEMA = "run_id int, ts int, event_id int, hour double, left double, Temp string, Hum string, " + ", ".join(
    f"{c} double" for c in GAS_CHANNELS
)


def random_runs() -> pd.DataFrame:
    rng = np.random.default_rng(7)
    parts = []
    for run, n in enumerate([60, 37, 3, 1, 25]):
        p = pd.DataFrame({"run_id": run, "ts": np.arange(n) // 2, "event_id": rng.permutation(n)})
        p = p.sort_values(["ts", "event_id"], ignore_index=True)
        p["hour"], p["left"] = np.arange(n) * 0.5, (n - 1 - np.arange(n)) * 1.0
        for c in TEXT_CHANNELS:
            p[c] = [("err" if rng.random() < 0.2 else f"{v:.2f}") for v in rng.normal(30, 4, n)]
        for c in GAS_CHANNELS:
            p[c] = np.round(rng.normal(200, 40, n), 2)
        p.loc[rng.random(n) < 0.3, "MQ2"] = np.nan
        p.loc[: n // 3, "MQ3"] = np.nan  # leading gap
        p.loc[n // 2 :, "MQ5"] = np.nan  # trailing gap
        p["MQ9"] = 7.0  # constant
        if run == 4:
            p["MQ4"] = np.nan  # nothing known in this run
        parts.append(p)
    parts[0].loc[10, "left"] = np.nan
    return pd.concat(parts, ignore_index=True)


def expected(run: pd.DataFrame, spec: FeatureSpec) -> pd.DataFrame:
    """The feature frame of one run by the definitions, in pandas."""
    out = run.copy()
    for c in TEXT_CHANNELS:
        out[c] = pd.to_numeric(out[c], errors="coerce").ffill().bfill().round(1)
    base = out.copy()
    for f in spec.features():
        x = base[f.channel]
        y = base[f.other] if f.other else None
        if f.kind == "lag":
            out[f.name] = x.shift(f.size)
        elif f.kind == "diff":
            out[f.name] = x - x.shift(f.size)
        elif f.kind == "rolling":
            out[f.name] = getattr(x.rolling(f.size, min_periods=1, center=spec.centred), f.stat)()
        elif f.kind == "product":
            out[f.name] = x * y
        elif f.kind == "ratio":
            out[f.name] = x / (y + 1e-6)
        elif f.kind == "lag_product":
            out[f.name] = x * y.shift(1)
        elif f.kind == "mean_ratio":
            out[f.name] = x / (y.rolling(5, min_periods=1, center=spec.centred).mean() + 1e-6)
        else:
            out[f.name] = x * y.diff()
    for c in out.columns:
        if out[c].isna().any():
            out[c] = out[c].astype(float).interpolate().ffill().bfill()
    return out.dropna()


@pytest.mark.parametrize("centred", [True, False])
@pytest.mark.parametrize("max_rows", [INF, 7])
def test_feature_frame_equals_pandas(spark, max_rows, centred):
    spec = FeatureSpec(centred=centred)
    pdf = random_runs()
    want = pd.concat([expected(r, spec) for _, r in pdf.groupby("run_id")], ignore_index=True)
    got = feature_frame(frame(spark, pdf, SCHEMA), spec, also_fill=("hour", "left"), max_rows=max_rows)
    assert set(got.columns) == set(want.columns)
    got = got.orderBy("run_id", "ts", "event_id").toPandas()
    want = want[got.columns]
    assert got["run_id"].value_counts().to_dict() == {0: 60, 1: 37}  # short and unknown runs drop out
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-7, err_msg=c)


def test_chunks_are_bounded_and_whole(spark):
    """A run with most rows is cut; nothing is lost; chunks stay near the wanted size."""
    n = 5000
    df = spark.range(n).selectExpr(
        "if(id < 4000, 0, cast(id as int)) AS run_id", "cast(id % 3 as int) AS ts", "cast(id as int) AS event_id",
        "cast(id as double) AS x",
    )
    layout = plan(df, 200)
    assert layout.chunked
    sizes = [r["count"] for r in layout.attach(df).where(f"{CHUNK} is not null").groupBy(CHUNK).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 10 and max(sizes) < 1000
    total = layout.running_total(df.withColumn("w", F.lit(1)), "w", "n", "upto")
    hot = total.where("run_id = 0").agg(F.max("n"), F.max("upto"), F.count_distinct("upto")).head()
    assert tuple(hot) == (4000, 4000, 4000)


def test_plan_has_one_exchange_and_no_python(spark):
    df = frame(spark, random_runs(), SCHEMA).repartition(4)
    text = feature_frame(df, FeatureSpec(), also_fill=("hour", "left"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(run_id") == 1
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_steps_on_cut_runs_read_their_input_a_few_times(spark):
    """Each step reads what the one before has saved: the rows, and those beside chunks on either side."""
    df = frame(spark, random_runs(), SCHEMA).repartition(4)
    text = feature_frame(df, FeatureSpec(), also_fill=("hour", "left"), max_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") <= 4 and text.count("Exchange hashpartitioning") <= 6
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("max_rows", [INF, 50])
def test_quantiles_are_exact(spark, max_rows):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 33 + ["c"], "x": np.round(rng.normal(size=734), 2)})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.9}, max_rows)
    for row in got.collect():
        x = pdf[pdf.g == row["g"]]["x"]
        np.testing.assert_allclose([row["q1"], row["q2"], row["q3"]], np.quantile(x, [0.25, 0.5, 0.9]), rtol=1e-12)
    assert got.count() == 3


def test_base_channels_are_the_spec_default():
    assert FeatureSpec().channels == BASE_CHANNELS


@pytest.mark.parametrize("centred", [True, False])
@pytest.mark.parametrize("max_rows", [INF, 300])
def test_wide_windows_agree_with_pandas(spark, centred, max_rows):
    """Windows of any size, wider than some runs, beside narrow ones; and gaps."""
    rng = np.random.default_rng(2)
    runs = np.repeat([1, 2, 3, 4], [1500, 90, 1, 40])
    x = np.where(rng.random(len(runs)) < 0.2, np.nan, 1e4 + rng.normal(size=len(runs)).cumsum())
    pdf = pd.DataFrame({"run_id": runs, "ts": range(len(runs)), "event_id": range(len(runs)), "x": x, "y": rng.integers(0, 50, len(runs)).astype(float)})
    df = frame(spark, pdf, "run_id int, ts int, event_id int, x double, y double")
    spec = FeatureSpec(channels=("x", "y"), lags=(), diffs=(), windows=(5, 33, 64, 100, 1000), cross=(), centred=centred)
    got = engineer(df, plan(df, max_rows), spec).toPandas().sort_values("event_id")
    for f in spec.features():
        want = pdf.groupby("run_id")[f.channel].transform(lambda s: getattr(s.rolling(f.size, min_periods=1, center=centred), f.stat)())
        np.testing.assert_allclose(got[f.name].to_numpy(float), want.to_numpy(float), rtol=1e-9 if f.stat != "std" else 1e-5, atol=1e-9, err_msg=f.name)


def test_full_frame_has_one_frame_for_all_neighbours_and_small_parts(spark, monkeypatch):
    """A lag or lead for each neighbour generates classes of its own: over 100 of them, Spark compiles all of them
    again for each task. Parts joined by the bytes of the narrow input leave a core or two with twice the work."""
    monkeypatch.setattr("sensorframe.operators.layout.MOST_DEALT", 40)
    rows = [("a" if i % 3 else "b", i, *[float((i * k) % 17) for k in range(1, 9)]) for i in range(400)]
    raw = spark.createDataFrame(rows, ["run_id", "ts", *FeatureSpec().channels])
    made = feature_frame(raw.withColumns({c: F.col(c).cast("string") for c in ("Temp", "Hum")}), order=["ts"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b(lag|lead)\(", plan)
    assert plan.count("collect_list(") <= 2
    assert made.rdd.getNumPartitions() == 10


def test_cut_runs_are_dealt_by_their_count(spark):
    """The steps on cut runs keep their number of parts, however few bytes their input has."""
    df = frame(spark, random_runs(), SCHEMA)
    layout = plan(df, 20)
    assert layout.chunked
    text = gaps.forward_fill(df, layout, ["MQ2"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text
