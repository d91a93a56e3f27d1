"""Selection, validation, models, sources and reports on small inputs."""

from __future__ import annotations

import os
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sensorframe.functions import strict_number
from sensorframe.operators import report
from sensorframe.operators.correlation import correlated_without, correlation_pairs, drop_correlated
from sensorframe.operators.crossval import cross_validate, fold_sizes, fold_split, grouped_folds
from sensorframe.operators.joins import join_groups
from sensorframe.operators.kernel import fourier_map, loro_kernel
from sensorframe.operators.linear import loro_linear
from sensorframe.operators.metrics import fold_metrics, model_summary
from sensorframe.operators.models import ModelSpec, boosting, forest, fourier_features, kernel_model, reference_preset
from sensorframe.operators.scaling import scaler_values, standardize
from sensorframe.operators.selection import above_median, forest_importance, top_scores
from sensorframe.plans import evaluate, feature_frame, select_features
from sensorframe.plans.analysis import select_without
from sensorframe.session import written
from sensorframe.sources import read_runs, stack_runs, write_table

IDS = ("run_id", "event_id")


def signal(n=600, runs=6, seed=1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = 10 + 3 * x[:, 0] + np.sin(2 * x[:, 1]) * 2 + rng.normal(scale=0.1, size=n)
    frame = pd.DataFrame(x, columns=["a", "b", "c", "d"])
    return frame.assign(y=np.abs(y), run_id=np.arange(n) % runs, event_id=np.arange(n))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(signal()).cache()


def test_loro_equals_refitting(rows):
    pdf = signal()
    got = loro_linear(rows, ["a", "b", "c", "d"], "y", IDS).toPandas().sort_values("event_id")
    for run in range(6):
        train, test = pdf[pdf.run_id != run], pdf[pdf.run_id == run]
        design = lambda p: np.column_stack([np.ones(len(p)), p[["a", "b", "c", "d"]]])
        w, *_ = np.linalg.lstsq(design(train), train.y, rcond=None)
        want = np.maximum(design(test) @ w, 0)
        np.testing.assert_allclose(got[got.fold == run].predicted, want, rtol=1e-9)


def test_factors_keep_the_digits_of_nearly_collinear_features(spark):
    """As least squares over whole tables has it, where sums of products do not; 30 folds, one of a row, a null one."""
    rng = np.random.default_rng(4)
    pdf = signal(900, 28)
    pdf["b"] = pdf.a + 1e-7 * rng.normal(size=900)
    pdf["y"] = np.abs(50 + pdf.c + (pdf.b - pdf.a) * 1e7 * 3)
    pdf["run_id"] = pd.Series(pdf.run_id, dtype="Int64").where(pdf.event_id % 31 > 0)
    pdf.loc[5, "run_id"] = 77
    rows = spark.createDataFrame(pdf.astype({"run_id": object})).withColumn("run_id", F.col("run_id").cast("long"))
    names = ["a", "b", "c"]
    got, plain = (loro_linear(rows, names, "y", IDS, stable=s).toPandas().set_index("event_id").predicted.sort_index() for s in (True, False))
    x = np.column_stack([np.ones(900), ((pdf[names] - pdf[names].mean()) / pdf[names].std(ddof=0)).to_numpy()])
    runs, want = pdf.run_id.fillna(-1).to_numpy(), np.zeros(900)
    for run in np.unique(runs):
        r = np.linalg.qr(np.column_stack([x, pdf.y])[runs != run], mode="r")
        want[runs == run] = np.maximum(x[runs == run] @ np.linalg.solve(r[:4, :4], r[:4, 4]), 0)
    assert abs(got - want).max() < 1e-5 < abs(plain - want).max()
    few = loro_linear(rows.where("run_id = 3"), names, "y", IDS, stable=True)
    assert few.count() == 0  # nothing to train on


def test_loro_with_collinear_and_constant_features(spark):
    pdf = signal().assign(twice=lambda p: 2 * p.a, one=1.0)
    got = loro_linear(spark.createDataFrame(pdf), ["a", "twice", "one"], "y", IDS).toPandas().set_index("event_id")
    want = loro_linear(spark.createDataFrame(pdf), ["a"], "y", IDS).toPandas().set_index("event_id")
    np.testing.assert_allclose(got.predicted.sort_index(), want.predicted.sort_index(), rtol=1e-7)


def test_refitted_folds_equal_additive_folds(rows):
    """Fitting every fold anew and solving all folds from one pass of sums agree."""
    folds = grouped_folds(rows, 3)
    models = {"Linear Regression": ModelSpec(lambda n: LinearRegression())}
    a = cross_validate(folds, ["a", "b", "c", "d"], "y", models, IDS).predictions.toPandas().set_index("event_id")
    b = loro_linear(folds, ["a", "b", "c", "d"], "y", IDS, fold="fold").toPandas().set_index("event_id")
    np.testing.assert_allclose(a.predicted.sort_index(), b.predicted.sort_index(), rtol=1e-8)


def test_kernel_features_approximate_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(30, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    z = np.stack([r["features"].toArray() for r in fourier_features(df, ["a", "b", "c"], 4000, 0.3, 1).collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_ended_validation_goes_on(rows, tmp_path):
    """A run that stops half-way, and another that only fits what is missing; other settings begin anew."""
    made, stop = [], [3]

    def make(n, depth=3):
        made.append(n)
        if n != 1000 and len([m for m in made if m != 1000]) > stop[0]:
            raise RuntimeError("ended")
        return forest(numTrees=3, maxDepth=depth, seed=1)

    models = {"forest": ModelSpec(make, trees=True)}
    folds, names = grouped_folds(rows, 6), ["a", "b", "c", "d"]
    with pytest.raises(RuntimeError, match="ended"):
        cross_validate(folds, names, "y", models, IDS, parallelism=1, resume=str(tmp_path))
    done, stop[0] = 3, 100
    n_folds = folds.select("fold").distinct().count()
    made.clear()
    again = cross_validate(folds, names, "y", models, IDS, parallelism=1, resume=str(tmp_path))
    assert len([m for m in made if m != 1000]) == n_folds - done
    assert again.predictions.count() == rows.count()
    made.clear()
    third = cross_validate(folds, names, "y", models, IDS, resume=str(tmp_path))
    assert [m for m in made if m != 1000] == []
    assert sorted(map(tuple, third.predictions.collect())) == sorted(map(tuple, again.predictions.collect()))
    assert sorted(map(tuple, third.mean_importances["forest"].collect())) == sorted(map(tuple, again.mean_importances["forest"].collect()))
    made.clear()
    cross_validate(folds, names, "y", {"forest": ModelSpec(lambda n: make(n, 2), trees=True)}, IDS, resume=str(tmp_path))
    assert len([m for m in made if m != 1000]) == n_folds


def test_correlations_of_all_folds_from_one_pass(spark):
    """Gaps in different rows, 30 folds: as pandas has it for the other folds' rows of each."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(900, 5)), columns=list("abcde"))
    pdf["b"], pdf["c"] = pdf.a + 0.3 * pdf.b, 1e6 - pdf.a + 0.1 * pdf.c
    pdf["e"] = np.where(np.arange(900) % 30 == 4, pdf.e, 7.0)  # constant without fold 4
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["fold"] = np.arange(900) % 30
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double, fold int")
    got = {(r.fold, r.i, r.j) for r in correlated_without(rows, list("abcde"), "fold", 0.05).collect()}
    want = set()
    for k in range(30):
        matrix = pdf[pdf.fold != k][list("abcde")].corr().to_numpy()
        if k == 4:
            matrix[4] = matrix[:, 4] = np.nan
        want |= {(k, i, j) for j in range(5) for i in range(j) if abs(matrix[i, j]) > 0.05}
    assert got == want
    pairs = {(r.i, r.j): r["corr"] for r in correlation_pairs(rows, list("abcde")).collect()}
    matrix = pdf[list("abcde")].corr().to_numpy()
    assert all(v == pytest.approx(matrix[i, j], abs=1e-8) for (i, j), v in pairs.items()) and len(pairs) == 10


def test_selection_within_folds_equals_selection_on_their_rows(spark, rows):
    folds = grouped_folds(rows.withColumn("twice", F.col("a") * 2 + 1), 3)
    names, settings = ["a", "twice", "b", "c"], {"numTrees": 5, "maxDepth": 4}
    got = select_without(folds, names, "y", "fold", 0.9, **settings)
    assert sorted(got) == [0, 1, 2]
    for k, chosen in got.items():
        assert chosen == select_features(folds.where(F.col("fold") != k), names, "y", 0.9, **settings).features


@pytest.mark.parametrize("long_fold", [100_000, 20])
def test_kernel_folds_equal_refitting(spark, long_fold):
    """All folds from one pass, against a ridge fit of each fold's training rows; folds of 1 to 200 rows, a null one."""
    pdf = signal(700)
    pdf["run_id"] = pd.Series(np.where(pdf.event_id < 200, 0, pdf.event_id % 40), dtype="Int64").where(pdf.event_id % 17 > 0)
    names, dim, gamma, C = ["a", "b", "c", "d"], 60, 0.1, 50.0
    got = loro_kernel(spark.createDataFrame(pdf.astype({"run_id": object})).withColumn("run_id", F.col("run_id").cast("long")), names, "y", IDS, dim=dim, gamma=gamma, seed=3, C=C, long_fold=long_fold)
    got = got.toPandas().set_index("event_id").predicted.sort_index()
    z = fourier_map(4, dim, gamma, 3)(((pdf[names] - pdf[names].mean()) / pdf[names].std(ddof=0)).to_numpy())
    runs, y = pdf.run_id.fillna(-1).to_numpy(), pdf.y.to_numpy()
    for run in np.unique(runs):
        train, test = runs != run, runs == run
        x, centre = z[train], z[train].mean(axis=0)
        penalty = 1 / (C * train.sum() * y[train].std())
        w = np.linalg.solve((x - centre).T @ (x - centre) / train.sum() + penalty * np.eye(dim), (x - centre).T @ (y[train] - y[train].mean()) / train.sum())
        want = np.maximum((z[test] - centre) @ w + y[train].mean(), 0)
        np.testing.assert_allclose(got[test], want, rtol=1e-7)


@pytest.mark.parametrize("long_fold", [5, 60])
def test_long_folds_take_their_weights_without_a_join(spark, long_fold):
    """No row carries its fold's weights; many and few long folds, beside short ones and a null one, as folds in one task."""
    pdf = signal(700)
    pdf["run_id"] = pd.Series(np.where(pdf.event_id < 200, 0, pdf.event_id % 40), dtype="Int64").where(pdf.event_id % 17 > 0)
    df = spark.createDataFrame(pdf.astype({"run_id": object})).withColumn("run_id", F.col("run_id").cast("long"))
    made = [loro_kernel(df, ["a", "b", "c", "d"], "y", IDS, dim=60, gamma=0.1, seed=3, C=50.0, long_fold=n) for n in (long_fold, 100_000)]
    assert "weights" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
    got, want = (m.toPandas().sort_values("event_id").reset_index(drop=True) for m in made)
    pd.testing.assert_frame_equal(got.drop(columns=["predicted", "residual"]), want.drop(columns=["predicted", "residual"]))
    np.testing.assert_allclose(got.predicted, want.predicted, rtol=1e-7)


def test_kernel_solved_like_mllib(rows):
    """With the same scaling, solving from sums and MLlib's fit of every fold agree."""
    folds = grouped_folds(rows, 3)
    centred = standardize(folds, scaler_values(folds, ["a", "b", "c", "d"]))
    spec = kernel_model(dim=40, gamma=0.2, C=20.0)
    a = cross_validate(centred, ["a", "b", "c", "d"], "y", {"m": spec}, IDS).predictions.toPandas().set_index("event_id")
    b = cross_validate(centred, ["a", "b", "c", "d"], "y", {"m": replace(spec, additive=False, scale=False)}, IDS).predictions.toPandas().set_index("event_id")
    np.testing.assert_allclose(a.predicted.sort_index(), b.predicted.sort_index(), rtol=1e-6)


def test_models_beat_the_mean_and_repeat(rows):
    models = {
        "Fourier Ridge": kernel_model(dim=100, gamma=0.2),
        "Gradient Boosting": ModelSpec(lambda n: boosting(maxIter=10, maxDepth=4, stepSize=0.3, seed=1), trees=True),
        "Random Forest": ModelSpec(lambda n: forest(numTrees=10, maxDepth=6, seed=1), trees=True),
        "Linear Regression": ModelSpec(lambda n: LinearRegression()),
    }
    folds = written(grouped_folds(rows, 3))  # bagging depends on the table's files, so both runs share one
    found = cross_validate(folds, ["a", "b", "c", "d"], "y", models, IDS, store=False)
    scores = model_summary(fold_metrics(found.predictions)).toPandas().set_index("model")
    assert (scores.avg_r2 > 0.5).all() and scores.avg_r2["Fourier Ridge"] > scores.avg_r2["Linear Regression"]
    assert found.predictions.count() == 4 * 600
    assert set(found.importances) == {"Gradient Boosting", "Random Forest"}
    best = top_scores(found.importances["Random Forest"], 1).head()
    assert best["feature"] == "a" and abs(found.importances["Random Forest"].agg(F.sum("importance")).head()[0] - 1) < 1e-9
    again = cross_validate(folds, ["a", "b", "c", "d"], "y", {"Random Forest": models["Random Forest"]}, IDS, store=False)
    first = found.predictions.where("model = 'Random Forest'")
    both = first.join(again.predictions.withColumnRenamed("predicted", "p2"), [*IDS])
    assert both.agg(F.max(F.abs(F.col("predicted") - F.col("p2")))).head()[0] < 1e-9


def test_select_then_validate(spark):
    noise = np.random.default_rng(5).normal(scale=0.3, size=600)
    pdf = signal().assign(e=lambda p: p.a + noise, flat=5.0, flat2=6.0, flat3=7.0)
    df = spark.createDataFrame(pdf)
    features = ["a", "e", "b", "flat", "flat2", "flat3"]
    models = {"Linear Regression": ModelSpec(lambda n: LinearRegression())}
    settings = {"numTrees": 5, "maxDepth": 4}
    run, chosen = evaluate(df, features, "y", models, IDS, "run_id", selector=settings)
    assert chosen.importances.count() == 6 and chosen.dropped == ["e"] and "a" in chosen.features
    assert run.predictions.select("fold").distinct().count() == 6
    inside, _ = evaluate(df, features, "y", models, IDS, "run_id", select_within_fold=True, selector=settings)
    assert inside.predictions.count() == 600


def test_forest_selection(rows):
    scores = forest_importance(rows, ["a", "b", "c", "d"], "y", numTrees=5, maxDepth=4)
    kept = {r["feature"] for r in above_median(scores).collect()}
    assert kept == {"a", "b"}


def test_correlation_filter_is_not_greedy(spark):
    x = np.arange(50.0)
    rng = np.random.default_rng(0)
    noise = rng.normal(scale=6, size=50)
    pdf = pd.DataFrame({"a": x, "b": x + noise, "c": x + 2 * noise, "flat": 1.0})
    corr = pdf.corr().abs()
    want = [c for j, c in enumerate(pdf.columns) if any(corr.iloc[i, j] > 0.9 for i in range(j))]
    left, dropped = drop_correlated(spark.createDataFrame(pdf), list(pdf.columns), 0.9)
    assert dropped == want and "flat" in left.columns


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    out = standardize(df, scaler_values(df, ["x", "c"])).toPandas()
    assert list(out.c) == [0, 0, 0]
    np.testing.assert_allclose(out.x, (np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4]))


def test_r2_on_a_constant_label(spark):
    rows = [("m", 0, 2.0, 2.0), ("m", 0, 2.0, 2.0), ("m", 1, 2.0, 1.0), ("m", 1, 2.0, 2.0)]
    scores = fold_metrics(spark.createDataFrame(rows, "model string, fold int, actual double, predicted double"))
    assert {r["fold"]: r["r2"] for r in scores.collect()} == {0: 1.0, 1: 0.0}


def test_fold_without_positive_labels_is_not_usable(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 0.0)], "run_id int, y double")
    got = {r["fold"]: (r["n_train"], r["n_test"], r["usable"]) for r in fold_sizes(df, "run_id", "y").collect()}
    assert got == {1: (0, 2, False), 2: (2, 0, False)}
    train, test = fold_split(df, F.col("run_id") == 1)
    assert (train.count(), test.count()) == (1, 2)


def test_salted_join_equals_broadcast_join(rows):
    groups = rows.groupBy("run_id").agg(F.avg("y").alias("m"))
    small, salted = join_groups(rows, groups, ["run_id"]), join_groups(rows, groups, ["run_id"], cells=4)
    assert "Broadcast" in small._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert salted.count() == 600 and small.exceptAll(salted).count() == 0


def test_histogram_and_density_of_a_constant(spark):
    df = spark.createDataFrame([("m", 3.0)] * 4, "model string, residual double")
    bins = report.histogram(df, "residual").toPandas()
    assert len(bins) == 30 and bins.n.sum() == 4 and bins.bin_lo.min() == 2.5
    assert report.density(df, "residual", points=7).where("density is not null").count() == 0


def test_density_integrates_to_one(rows):
    curve = report.density(rows.withColumn("model", F.lit("m")), "y").toPandas().sort_values("point")
    assert len(curve) == 200 and 0.9 < np.trapezoid(curve.density, curve.x) <= 1.0


def test_reference_preset_names():
    assert list(reference_preset()) == ["Fourier Ridge", "Gradient Boosting", "Column-Sampled Boosting", "Random Forest", "Linear Regression"]
    assert reference_preset()["Random Forest"].make(1).getNumTrees() == 300


# -- CSV runs ----------------------------------------------------------------------------------

HEADER = "Hour,Temp,Hum,MQ2,MQ3,MQ4,MQ5,MQ9,MQ135,Hours Left to Rot"


def _write(path, name, n, header=HEADER, bad=None):
    lines = [header]
    for i in range(n):
        cells = [str(i * 0.5), "err" if i == 2 else f"{20 + i}.25", "50.0", "" if i == 3 else str(i), "1", "2", "3"]
        lines.append(",".join([*cells, "4", bad if bad and i == 1 else "5.5", str(n - 1 - i)]))
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_runs(spark, tmp_path):
    _write(tmp_path, "one.csv", 30)
    _write(tmp_path, "two.csv", 25)
    df = read_runs(spark, str(tmp_path / "*.csv"))
    assert df.groupBy("run_name").count().orderBy("run_name").collect() == [("one.csv", 30), ("two.csv", 25)]
    hours = [r["Hour"] for r in df.where("run_name = 'one.csv'").orderBy("seq").collect()]
    assert hours == [i * 0.5 for i in range(30)]
    assert dict(df.dtypes)["Temp"] == "string" and dict(df.dtypes)["MQ2"] == "double"
    frame = feature_frame(df, order=("seq",), also_fill=("Hour", "Hours Left to Rot"))
    assert frame.count() == 55 and len(frame.columns) == 5 + 172
    write_table(frame, str(tmp_path / "out"), partition_by=["run_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 55


def test_csv_row_order_over_splits(spark, tmp_path):
    """A file read in several splits still numbers its rows in file order."""
    _write(tmp_path, "long.csv", 3000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_runs(spark, str(tmp_path / "long.csv"))
        assert df.rdd.getNumPartitions() > 3
        rows = df.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["Hour"] for r in rows] == [i * 0.5 for i in range(3000)]
    assert len({r["seq"] for r in rows}) == 3000


def test_csv_bad_number_raises(spark, tmp_path):
    _write(tmp_path, "bad.csv", 5, bad="oops")
    with pytest.raises(Exception, match="not a number"):
        read_runs(spark, str(tmp_path / "bad.csv")).collect()
    _write(tmp_path, "unit.csv", 5, bad="1d")
    with pytest.raises(Exception, match="not a number"):
        read_runs(spark, str(tmp_path / "unit.csv")).collect()


def test_csv_columns_are_aligned_by_name(spark, tmp_path):
    _write(tmp_path, "good.csv", 5)
    swapped = HEADER.replace("MQ9,MQ135", "MQ135,MQ9")
    _write(tmp_path, "other.csv", 5, header=swapped)
    (tmp_path / "few.csv").write_text("Hour,MQ9\n0.5,7\n")
    rows = {r["run_name"]: r for r in read_runs(spark, str(tmp_path / "*.csv")).where("seq >= 0").orderBy("seq").collect()}
    assert (rows["good.csv"]["MQ9"], rows["good.csv"]["MQ135"]) == (4.0, 5.5)
    assert (rows["other.csv"]["MQ9"], rows["other.csv"]["MQ135"]) == (5.5, 4.0)
    assert (rows["few.csv"]["MQ9"], rows["few.csv"]["MQ135"]) == (7.0, None)


def test_csv_runs_of_equal_names_stay_apart(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 4)):
        (tmp_path / folder).mkdir()
        _write(tmp_path / folder, "run.csv", n)
    df = read_runs(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r["count"] for r in df.groupBy("run_id").count().collect()) == [3, 4]
    assert df.select("run_id", "seq").distinct().count() == 7


def test_missing_texts_are_not_trimmed(spark):
    df = spark.createDataFrame([("nan",), ("",), (" 1.5 ",), (None,)], "t string")
    assert [r[0] for r in df.select(strict_number(F.col("t"))).collect()] == [None, None, 1.5, None]
    with pytest.raises(Exception, match="not a number"):
        df.select(strict_number(F.lit(" nan"))).collect()


def test_more_than_two_hundred_folds(spark):
    """No limit to the folds, predictions saved once, and least squares from sums equal to refitting."""
    pdf = signal(n=1005, runs=201)
    df = spark.createDataFrame(pdf)
    linear = {"Linear Regression": ModelSpec(lambda n: LinearRegression(), additive=True)}
    found = cross_validate(df, ["a", "b"], "y", linear, IDS, fold="run_id").predictions
    assert found.count() == 1005 and found.select("fold").distinct().count() == 201
    few = df.where("run_id < 3")
    a = cross_validate(few, ["a", "b"], "y", linear, IDS, fold="run_id").predictions.orderBy("event_id").collect()
    b = cross_validate(few, ["a", "b"], "y", {"Linear Regression": ModelSpec(lambda n: LinearRegression())}, IDS, fold="run_id")
    np.testing.assert_allclose([r["predicted"] for r in a], [r["predicted"] for r in b.predictions.orderBy("event_id").collect()], rtol=1e-8)


def test_folds_without_features_are_skipped(rows):
    models = {"Linear Regression": ModelSpec(lambda n: LinearRegression(), additive=True), "Other": ModelSpec(lambda n: LinearRegression())}
    assert cross_validate(rows, [], "y", models, IDS, fold="run_id").predictions.count() == 0


def test_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(10)] + [("x", float(i)) for i in range(10)], "model string, v double")
    bins = report.histogram(df, "v").groupBy("model").agg(F.sum("n").alias("n")).collect()
    assert sorted((r["model"] or "", r["n"]) for r in bins) == [("", 10), ("x", 10)]
    assert report.density(df, "v").where("density is not null").count() == 400
    assert sorted((r["model"] or "", r["n"]) for r in report.box_statistics(df, "v").collect()) == [("", 10), ("x", 10)]


def test_stacking_aligns_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, z int")
    assert {tuple(r) for r in stack_runs([a, b]).collect()} == {(1, 2, None), (None, 3, 4)}


@pytest.mark.parametrize("name", ["q_cv_ols", "q_cv_rff"])
def test_registered_validation_has_a_fold_per_run(spark, sf_dir, name):
    from sensorframe.queries.modelling import QUERIES

    found = QUERIES[name](spark, sf_dir).select("fold", "run_id").distinct().collect()
    assert len(found) == len({r.run_id for r in found}) == len({r.fold for r in found}) > 3


def test_boosters_have_registered_importances():
    from sensorframe.queries.modelling import QUERIES

    assert {"q_model_importance", "q_model_importance_gbt", "q_model_importance_gbt_cols"} <= QUERIES.keys()


def test_leaderboard_fits_the_full_settings(spark, sf_dir, monkeypatch):
    """Each model is made as the original is, and sees every labelled row; only the quickest is then solved."""
    from sensorframe.queries import modelling

    seen = []

    def quick(frame, features, label, models, ids, **settings):
        seen.append((models, frame.count(), features))
        return cross_validate(frame, features, label, {"Linear Regression": models["Linear Regression"]}, ids, **settings)

    monkeypatch.setattr(modelling, "cross_validate", quick)
    assert modelling.QUERIES["q_leaderboard"](spark, sf_dir).count() == 1
    [(models, n_rows, features)] = seen
    labelled = modelling.labelled(spark, sf_dir).where("hours_left > 0").count()
    assert list(models) == list(modelling.MODELS) and n_rows == labelled and set(features) == set(modelling.NARROW.names())
    made = {m: s.make(n_rows) for m, s in models.items()}
    boosters = [made["Gradient Boosting"], made["Column-Sampled Boosting"]]
    assert [(b.getMaxIter(), b.getMaxDepth(), b.getStepSize(), b.getSubsamplingRate()) for b in boosters] == [(300, 7, 0.03, 0.7), (400, 8, 0.02, 0.7)]
    assert [b.getFeatureSubsetStrategy() for b in boosters] == ["all", "0.7"]
    trees = made["Random Forest"]
    assert (trees.getNumTrees(), trees.getMaxDepth(), trees.getMinInstancesPerNode()) == (300, 15, 3)
