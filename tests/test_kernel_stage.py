import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from verdara.operators.kernel_stage import KernelRegressor
from verdara.sources.models import ModelRegistry

GRID = [0.1, 0.3, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(150, 2))
    y = np.sin(x[:, 0]) + x[:, 1] + r.normal(size=150) * 0.1
    data = [(float(a), float(b), float(c), "keep") for (a, b), c in zip(x, y)] + [(0.1, 0.2, None, "no label")]
    return spark.createDataFrame(data + data[:3], "a double, b double, y double, note string").cache()


def brute(rows, h):
    data = rows.toPandas()
    known = data[data["y"].notna()]
    x, q = known[["a", "b"]].to_numpy(), data[["a", "b"]].to_numpy()
    mean, std = x.mean(0), x.std(0)
    gap = (q[:, None] - x[None]) / std
    w = np.exp(-0.5 * (gap ** 2).sum(-1) / h / h)
    return (w @ known["y"].to_numpy()) / w.sum(1)


def test_fitted_in_a_pipeline_saved_and_loaded(spark, rows, tmp_path):
    pipeline = Pipeline(stages=[SQLTransformer(statement="SELECT *, a + 0.0 AS a2 FROM __THIS__"),
                                KernelRegressor(featureCols=["a2", "b"], labelCol="y", bandwidth=0.4)])
    model = pipeline.fit(rows)
    got = model.transform(rows).toPandas().sort_values(["a", "b", "note"])
    want = rows.toPandas().assign(p=brute(rows, 0.4)).sort_values(["a", "b", "note"])
    assert list(got.columns) == ["a", "b", "y", "note", "a2", "prediction"] and len(got) == 154
    assert got["prediction"].to_numpy() == pytest.approx(want["p"].to_numpy(), rel=1e-9)
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    registry.save(model, "kernel pipeline", "y")
    again = registry.load("kernel pipeline")
    assert isinstance(again, PipelineModel) and again.stages[1].getOrDefault("bandwidth") == 0.4
    same = again.transform(rows).toPandas().sort_values(["a", "b", "note"])
    assert same["prediction"].to_numpy() == pytest.approx(got["prediction"].to_numpy(), rel=1e-12)


def test_grid_by_leave_one_out_and_by_cross_validation(rows):
    stage = KernelRegressor(featureCols=["a", "b"], labelCol="y", bandwidths=GRID)
    assert stage.fit(rows).getOrDefault("bandwidth") == 0.3
    grid = ParamGridBuilder().addGrid(stage.bandwidth, GRID).build()
    search = CrossValidator(estimator=stage, estimatorParamMaps=grid, numFolds=2, seed=1,
                            evaluator=RegressionEvaluator(labelCol="y"))
    found = search.fit(rows.where("y IS NOT NULL"))
    assert found.bestModel.getOrDefault("bandwidth") == 0.3 and len(found.avgMetrics) == 3


def test_local_linear_is_exact_on_a_plane_and_odd_types_are_refused(rows):
    plane = rows.where("y IS NOT NULL").selectExpr("a", "b", "2 * a - b + 1 AS y")
    model = KernelRegressor(featureCols=["a", "b"], labelCol="y", bandwidth=0.5, regType="ll").fit(plane)
    assert all(abs(r["prediction"] - r["y"]) < 1e-6 for r in model.transform(plane).collect())
    with pytest.raises(ValueError):
        KernelRegressor(featureCols=["a"], labelCol="y", bandwidth=1.0, regType="xx").fit(plane)
