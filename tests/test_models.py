import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.operators import kernel, linear, metrics, prep, trees
from verdara.plans import workflows
from verdara.sources import metric_files, models, tables


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(size=(n, 2))
    x[10] = x[11]
    x[0] = [6.0, 6.0]
    y = 3 + 2 * x[:, 0] - x[:, 1] + np.sin(3 * x[:, 0]) + 0.1 * rng.normal(size=n)
    rows = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").cache(), x, y


def z_of(x):
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("kind,alpha", [("ols", 0.0), ("ridge", 1.0), ("ridge", 50.0)])
def test_linear_matches_normal_equations(spark, data, kind, alpha):
    df, x, y = data
    model = linear.fit(df, "y", ["a", "b"], kind, alpha)
    z = z_of(x)
    want = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
    assert np.array(model.stages[-1].coefficients) == pytest.approx(want, rel=1e-9)
    pred = [r["prediction"] for r in linear.predict(model, df).orderBy("id").collect()]
    assert pred == pytest.approx(y.mean() + z @ want)
    coefs = linear.coefficients(model, ["a", "b"], spark).collect()
    assert abs(coefs[0]["coef"]) >= abs(coefs[1]["coef"])


def test_lasso_matches_coordinate_descent(data):
    df, x, y = data
    z, r, alpha = z_of(x), y - y.mean(), 0.5
    w = np.zeros(2)
    for _ in range(2000):
        for j in range(2):
            rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = math.copysign(max(abs(rho) - alpha, 0), rho)
    got = linear.fit(df, "y", ["a", "b"], "lasso", alpha).stages[-1].coefficients
    assert np.array(got) == pytest.approx(w, abs=1e-6)


def test_unknown_model_type(data):
    with pytest.raises(ValueError):
        linear.fit(data[0], "y", ["a"], "elastic")


def test_pipeline_imputes_when_predicting(spark, data):
    df, _, _ = data
    model = linear.fit(df, "y", ["a", "b"], "ols")
    mid = df.select(F.percentile("a", 0.5)).first()[0]
    rows = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (mid, 1.0)], "a double, b double")
    assert len({round(r["prediction"], 9) for r in linear.predict(model, rows).collect()}) == 1


def brute(x, y, h, q=None):
    d2 = (((x if q is None else q)[:, None] - x[None]) ** 2).sum(-1)
    k = np.exp(-0.5 * d2 / h / h)
    if q is None:
        np.fill_diagonal(k, 0)
        return k @ y / (k.sum(1) + 1e-12)
    with np.errstate(invalid="ignore"):
        return k @ y / k.sum(1)


@pytest.mark.parametrize("cols,cells,pack", [
    (["a"], True, 1024), (["a"], False, 1024), (["a"], False, 50), (["a", "b"], False, 1024),
    (["a", "b"], False, 60), (["a", "b"], True, 1024), (["a", "b"], True, 60), (["a", "b"], None, 1024)])
def test_kernel_against_brute_force(data, monkeypatch, cols, cells, pack):
    """Cells, plain packs and several packs per query give the direct sums."""
    monkeypatch.setattr(kernel, "CHUNK_SIZE", pack)
    monkeypatch.setattr(kernel, "TILE_ROWS", 3 * pack)
    df, x, y = data
    x = x[:, :len(cols)]
    hs = [0.003, 0.05, 0.4, 3.0]
    risk = {r["h"]: r["rmse_loo"] for r in
            kernel.loo_risk(df, cols, "y", hs, ["id"], cells).collect()}
    for h in hs:
        assert risk[h] == pytest.approx(np.sqrt(np.mean((y - brute(x, y, h)) ** 2)), rel=1e-9)
    for h in (0.05, 0.4):
        got = {r["id"]: r["yhat"] for r in
               kernel.predict(df, df, cols, "y", h, ["id"], cells).collect()}
        assert [got[i] for i in range(len(y))] == pytest.approx(brute(x, y, h, x), rel=1e-9)


def test_kernel_edges(spark, data):
    df, _, _ = data
    far = spark.createDataFrame([(1, 1e6), (2, 0.0)], "id long, a double")
    got = {r["id"]: r["yhat"] for r in kernel.predict(far, df, ["a"], "y", 0.1, ["id"]).collect()}
    assert got[1] is None and got[2] is not None
    with pytest.raises(ValueError):
        kernel.predict(far, df, ["a"], "y", 0.0, ["id"])
    risk = kernel.loo_risk(df, ["a"], "y", [0.0, 0.5], ["id"]).orderBy("h").collect()
    assert risk[0]["rmse_loo"] == math.inf and risk[1]["rmse_loo"] < 5
    one = spark.createDataFrame([(1, 0.0, 4.0)], "id long, a double, y double")
    assert kernel.loo_risk(one, ["a"], "y", [1.0], ["id"]).first()["rmse_loo"] == pytest.approx(4.0)
    assert kernel.predict(one, one, ["a"], "y", 1.0, ["id"]).first()["yhat"] == pytest.approx(4.0)
    tie = spark.createDataFrame([(0.5, 1.0), (0.2, 1.0), (0.1, 2.0)], "h double, rmse_loo double")
    assert kernel.best_bandwidth(tie).first()["h"] == 0.2


@pytest.mark.parametrize("cols,cells,pack", [
    (["a"], False, 1024), (["a"], False, 70), (["a", "b"], False, 1024), (["a", "b"], False, 70),
    (["a"], True, 70), (["a", "b"], True, 70), (["a", "b"], None, 1024)])
def test_local_linear(data, monkeypatch, cols, cells, pack):
    monkeypatch.setattr(kernel, "CHUNK_SIZE", pack)
    monkeypatch.setattr(kernel, "TILE_ROWS", 3 * pack)
    df, x, y = data
    x, h = x[:, :len(cols)], 0.6
    got = {r["id"]: r["yhat"] for r in
           kernel.predict_local_linear(df, df, cols, "y", h, ["id"], cells).collect()}
    for i in range(len(y)):
        w = np.exp(-0.5 * ((x - x[i]) ** 2).sum(1) / h / h)
        m = np.c_[np.ones(len(y)), x - x[i]]
        a = m.T @ (w[:, None] * m)
        if np.linalg.cond(a) < 1e8:
            assert got[i] == pytest.approx(np.linalg.solve(a, m.T @ (w * y))[0], rel=1e-7)


def test_total_square_distance(data):
    df, x, _ = data
    got = {r["id"]: r["sum_d2"] for r in
           kernel.total_square_distance(df, ["a", "b"], ["id"]).collect()}
    want = ((x[:, None] - x[None]) ** 2).sum((1, 2))
    assert [got[i] for i in range(len(x))] == pytest.approx(want)


def test_kernel_model_round_trip(spark, data, tmp_path):
    df, _, _ = data
    split = prep.random_split(df, ["id"], 0.3, 1)
    scores, risk, model = workflows.kernel_scores(split, "y", ["a", "b"], ["id"], [0.1, 0.3, 1.0])
    assert risk.count() == 3 and scores.count() == 8
    model.save(str(tmp_path / "m"))
    again = models.KernelModel.load(spark, str(tmp_path / "m"))
    a, b = (sorted((r["id"], r["yhat"]) for r in m.transform(df, ["id"]).collect())
            for m in (model, again))
    assert [v for _, v in a] == pytest.approx([v for _, v in b])
    with pytest.raises(ValueError):
        models.KernelModel(df, ["a"], "y", model.scaling, 1.0, "xx")
    registry = models.ModelRegistry(spark, str(tmp_path / "reg"))
    registry.save(model, "kernel y", "y")
    assert isinstance(registry.load("kernel y"), models.KernelModel)
    assert registry.load_latest("kernel").h == model.h
    every = df.withColumnsRenamed({"id": "row"}).selectExpr(
        "'R' AS raster", "CAST(row AS int) AS row", "0 AS col", "a", "b", "row % 3 <> 0 AS valid")
    pred = {r["row"]: r["pred"] for r in workflows.map_with_kernel(every, model).collect()}
    want = dict(a)
    assert all(pred[i] == (pytest.approx(want[i], rel=1e-5) if i % 3 else -9999.0) for i in want)


def test_missing_targets_take_no_part(spark, data):
    df, _, _ = data
    gone = df.withColumn("y", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN double('nan') ELSE y END"))
    left = df.where("id % 5 > 1")
    for f in (lambda t: kernel.predict(df, t, ["a"], "y", 0.3, ["id"]),
              lambda t: kernel.predict_local_linear(df, t, ["a", "b"], "y", 0.5, ["id"]),
              lambda t: kernel.loo_risk(t, ["a"], "y", [0.3], ["id"])):
        a, b = (sorted(map(tuple, f(t).collect())) for t in (gone, left))
        assert np.array(a, float) == pytest.approx(np.array(b, float), nan_ok=True)


def test_tiles_follow_the_block_not_the_table(spark, monkeypatch):
    """Far apart clusters: a query row meets the tiles of its own cluster only."""
    monkeypatch.setattr(kernel, "CHUNK_SIZE", 10)
    rng = np.random.default_rng(2)
    for clusters in (2, 8):
        x = np.concatenate([1000.0 * k + rng.random(50) for k in range(clusters)])
        df = spark.createDataFrame([(i, float(v), float(i % 7)) for i, v in enumerate(x)],
                                   "id int, a double, y double")
        got = {r["id"]: r["yhat"] for r in kernel.predict(df, df, ["a"], "y", 0.2, ["id"], cells=False).collect()}
        w = np.exp(-0.5 * ((x[:, None] - x[None]) / 0.2) ** 2)
        assert [got[i] for i in range(len(x))] == pytest.approx(w @ (np.arange(len(x)) % 7) / w.sum(1))


def test_trees(spark, data, tmp_path):
    df, _, _ = data
    found = trees.importance_by_target(df, ["y"], ["a", "b"], n_estimators=5, max_depth=4).collect()
    assert sum(r["importance"] for r in found) == pytest.approx(1.0)
    assert found[0]["feature"] == "a"
    split = prep.random_split(df, ["id"], 0.3, 1)
    grid = {"n_estimators": [5], "max_depth": [3, 4], "min_samples_leaf": [1]}
    scores, importance, _ = workflows.tree_scores(split, "y", ["a", "b"], "id", grid=grid, draws=2)
    r2 = {r["set"]: r["value"] for r in scores.where("metric = 'R2'").collect()}
    assert r2["train"] > 0.8 and r2["val"] > 0.5 and importance.count() == 2
    boosted = trees.fit(df, "y", ["a", "b"], trees.boosted("y", n_estimators=3, max_depth=2))
    boosted.stages[-1].write().save(str(tmp_path / "g"))
    counts = {r["feature"]: r["n_splits"] for r in
              trees.split_counts(str(tmp_path / "g"), ["a", "b"], spark).collect()}
    assert sum(counts.values()) == sum(
        (t.numNodes - 1) // 2 for t in boosted.stages[-1].trees)


def test_search_parameters():
    for bad in ({"max_depth": None}, {"max_depth": 31}, {"max_leaf_nodes": 4}):
        with pytest.raises(ValueError):
            trees.forest("y", **bad)
    assert trees.spark_value("max_features", None) == "all"
    with pytest.raises(ValueError):
        trees.boosted("y", bootstrap=True)
    draws = trees.draw_params(trees.FOREST_GRID, 100, 42)
    assert len({str(d) for d in draws}) == 100 == len(draws)
    assert draws == trees.draw_params(trees.FOREST_GRID, 100, 42)


def test_regression_metrics_edges(spark):
    df = spark.createDataFrame(
        [("flat_hit", 2.0, 2.0), ("flat_hit", 2.0, 2.0), ("flat_miss", 2.0, 1.0),
         ("flat_miss", 2.0, 2.0), ("zero", 0.0, 1.0), ("zero", 0.0, -1.0),
         ("ok", 1.0, 1.5), ("ok", 3.0, 2.5), ("ok", None, 9.0)], "k string, y double, p double")
    got = {r["k"]: r for r in metrics.regression_metrics(df, "y", "p", ["k"]).collect()}
    assert got["flat_hit"]["R2"] == 1.0 and got["flat_miss"]["R2"] == 0.0
    assert got["zero"]["rRMSE(%)"] is None
    r = got["ok"]
    assert (r["RMSE"], r["MAE"], r["R2"], r["rRMSE(%)"]) == pytest.approx((0.5, 0.5, 0.75, 25.0))


def test_metric_files(spark, tmp_path):
    base = tmp_path / "res"
    (base / "artifacts_a").mkdir(parents=True)

    def put(name, text):
        (base / "artifacts_a" / name).write_text(text)
    put("metrics_total_biomass VWC.csv", ",train,val\nRMSE,1.5,2.5\nR2,0.5,\n")
    put("METRIC_iba x.csv", "﻿,val,train\r\nMAE,4,3\r\n")
    put("coefs_VWC.csv", "feature,coef\na,1\n")
    put("metrics_VWC bad.csv", "no,useful\n1,2\n")
    put("metrics_other.csv", ",train,val\nRMSE,1,2\n")
    put("metrics_VWC empty.csv", "")
    (base / "artifacts_a" / "metrics_IBA old").mkdir()
    put("metrics_IBA old/copy.csv", ",train,val\nRMSE,9,9\n")
    got = {(r["target"], r["metric"], r["set"]): r["value"] for r in metric_files.gather(
        spark, str(base), ["VWC", "IBA", "total_biomass"],
        {"A": "artifacts_a", "B": "missing"}).collect()}
    assert got == {("VWC", "RMSE", "train"): 1.5, ("VWC", "RMSE", "val"): 2.5,
                   ("VWC", "R2", "train"): 0.5, ("VWC", "R2", "val"): None,
                   ("IBA", "MAE", "train"): 3.0, ("IBA", "MAE", "val"): 4.0}


def test_metric_tables(spark):
    rows = [(m, t, k, s, v) for m, base in (("B", 1.0), ("A", 1.0), ("C", 0.5))
            for t in ("x", "y") for k, v0 in (("MAE", 2.0), ("R2", 0.4), ("rRMSE(%)", 10.0), ("RMSE", 1.0))
            for s in ("train", "val") for v in (v0 * base,)]
    long = spark.createDataFrame(rows, metric_files.SCHEMA)
    table = metrics.metrics_table(long)
    assert table.columns == ["Model", "Target", *metrics.TABLE_COLUMNS] and table.count() == 6
    best = {r["Target"]: r["Model"] for r in metrics.best_model(table).collect()}
    assert best == {"x": "A", "y": "A"}
    line = metrics.table_rows(table).where("Model = 'A' AND Target = 'x'").first()["line"]
    assert line == "A & x & 2.0 & 2.0 & 0.4 & 0.4 & 10.0 & 10.0 \\\\"
    assert metrics.table_header(["a", "b"]) == "a & b \\\\"
    means = metrics.mean_metrics(table)
    assert metrics.relative_error_columns(means).columns == [
        "Model", "rRMSE% (train)", "rRMSE% (val)"]


def test_tables_and_registry(spark, data, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(" id , value \na,1.5\nb,\n")
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["id", "value"] and dict(df.dtypes)["value"] == "double"
    assert df.where("value IS NULL").count() == 1
    assert tables.read_csv(spark, str(path), "id string, value float").dtypes[1][1] == "float"
    nan = spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, s string")
    assert tables.nan_to_null(nan).where("v IS NULL").count() == 1
    registry = models.ModelRegistry(spark, str(tmp_path / "reg"))
    first = linear.fit(data[0], "y", ["a"], "ols")
    registry.save(first, "y", "y")
    registry.save(linear.fit(data[0], "y", ["a", "b"], "ols"), "best model Y", "y")
    assert len(registry.load("y").stages[-1].coefficients) == 1
    assert len(registry.load_latest("y").stages[-1].coefficients) == 2
    with pytest.raises(FileNotFoundError):
        registry.load_latest("nothing")
    tables.write_best_bandwidth(spark.createDataFrame([(0.25,)], "h double"), str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first()[0] == "best_h=0.25"
    assert os.path.exists(tmp_path / "reg")
