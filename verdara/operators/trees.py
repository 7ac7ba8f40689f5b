"""Random forests and boosted trees: fitting, importances, randomised search."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.operators.linear import FEATURES, assembler, scaling_stage
from verdara.operators.ordered import medians
from verdara.operators.prep import Scaling, contiguous_folds
from verdara.operators.reuse import held
from verdara.operators.split_forest import SplitForestRegressor

# Search grids and the Spark parameter each name maps to.
FOREST_GRID = {
    "n_estimators": list(range(100, 1500, 100)),
    "max_depth": list(range(10, 31, 5)),
    "min_samples_split": list(range(2, 21, 2)),
    "min_samples_leaf": list(range(1, 21, 2)),
    "max_features": ["sqrt", "log2", None],
    "bootstrap": [True, False],
}
BOOST_GRID = {
    "n_estimators": list(range(100, 1500, 100)),
    "max_depth": [10, 20, 30],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "min_child_samples": [5, 10, 20],
}
FOREST_PARAMS = {
    "n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf":
    "minInstancesPerNode", "max_features": "featureSubsetStrategy", "bootstrap": "bootstrap",
    "min_samples_split": "minSamplesSplit",
}
BOOST_PARAMS = {
    "n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
    "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
    "min_child_samples": "minInstancesPerNode",
}
MAX_DEPTH = 30  # the deepest tree Spark grows


def spark_value(name: str, value):
    """Spark's value for one search parameter."""
    if name == "max_depth":
        if value is None or int(value) > MAX_DEPTH:
            raise ValueError(f"Spark grows trees up to depth {MAX_DEPTH}, not {value}")
        return int(value)
    if name == "max_features":
        return {None: "all", "sqrt": "sqrt", "log2": "log2", "auto": "all"}.get(value, str(value))
    if name == "colsample_bytree":
        return "all" if value >= 1 else str(value)
    if name in ("learning_rate", "subsample"):
        return float(value)
    if name == "bootstrap":
        return bool(value)
    return int(value)


def _checked(params: Mapping, known: Mapping[str, str]) -> dict:
    unknown = set(params) - set(known)
    if unknown:
        raise ValueError(f"unknown search parameters: {sorted(unknown)}")
    return {known[k]: spark_value(k, v) for k, v in params.items()}


def _prepare(train: DataFrame, target: str, features: Sequence[str], keep=()):
    """Median imputation only; trees need no scaling.  Stages and the vector rows."""
    mid = medians(train, features)
    stage = scaling_stage(Scaling(mid, {}, {}), standardise=False)
    pack = assembler(features)
    rows = train.where(F.col(target).isNotNull())
    ready = pack.transform(stage.transform(rows)).select(
        FEATURES, F.col(target).cast("double").alias(target), *keep)
    return stage, pack, ready


def forest(target: str, seed: int = 42, **params) -> RandomForestRegressor | SplitForestRegressor:
    kind = SplitForestRegressor if "min_samples_split" in params else RandomForestRegressor
    return kind(featuresCol=FEATURES, labelCol=target, seed=seed, **_checked(params, FOREST_PARAMS))


def boosted(target: str, seed: int = 42, **params) -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES, labelCol=target, seed=seed,
                        **_checked(params, BOOST_PARAMS))


def fit(train: DataFrame, target: str, features: Sequence[str], model) -> PipelineModel:
    with held(train.select(*dict.fromkeys([*features, target]))) as kept:
        stage, pack, ready = _prepare(kept, target, features)
        return PipelineModel([stage, pack, model.fit(ready)])


def impurity_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), largest first; the importances sum to 1."""
    values = model.stages[-1].featureImportances.toArray()
    return (spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)],
                                  "feature string, importance double")
            .orderBy(F.desc("importance"), "feature"))


def importance_by_target(train: DataFrame, targets: Sequence[str], features: Sequence[str],
                         n_estimators: int = 500, seed: int = 42, **params) -> DataFrame:
    """(target, feature, importance): one forest per target on shared features."""
    parts = []
    for t in targets:
        model = fit(train, t, features, forest(t, seed, n_estimators=n_estimators, **params))
        parts.append(impurity_importance(model, features, train.sparkSession)
                     .select(F.lit(t).alias("target"), "feature", "importance"))
    return reduce(DataFrame.unionByName, parts)


def split_counts(saved_model_path: str, features: Sequence[str], spark) -> DataFrame:
    """(feature, n_splits) of a saved boosted model, counted in its node table."""
    nodes = spark.read.parquet(f"{saved_model_path}/data")
    names = F.array(*[F.lit(f) for f in features])
    used = (nodes.where(F.col("nodeData.split.featureIndex") >= 0)
            .groupBy(F.element_at(names, F.col("nodeData.split.featureIndex") + 1)
                     .alias("feature"))
            .agg(F.count(F.lit(1)).alias("n_splits")))
    every = spark.createDataFrame([(f,) for f in features], "feature string")
    return (every.join(used, "feature", "left")
            .select("feature", F.coalesce("n_splits", F.lit(0)).cast("bigint").alias("n_splits"))
            .orderBy(F.desc("n_splits"), "feature"))


def draw_params(grid: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """Seeded draws without repetition; the whole grid if it is smaller."""
    names = sorted(grid)
    size = math.prod(len(grid[n]) for n in names)
    if size <= draws:
        return [dict(zip(names, combo)) for combo in itertools.product(*[grid[n] for n in names])]
    rng = random.Random(seed)
    out = []
    for at in rng.sample(range(size), draws):
        picked = {}
        for n in names:
            at, i = divmod(at, len(grid[n]))
            picked[n] = grid[n][i]
        out.append(picked)
    return out


def random_search(train: DataFrame, target: str, features: Sequence[str], order_col: str,
                  kind: str = "forest", grid: Mapping[str, Sequence] | None = None,
                  draws: int = 100, folds: int = 5, seed: int = 42, parallelism: int = 4):
    """Randomised search with k contiguous folds, scored by mean R².

    Returns the refitted pipeline and a (params, r2_mean) table.
    """
    known = FOREST_PARAMS if kind == "forest" else BOOST_PARAMS
    grid = grid or (FOREST_GRID if kind == "forest" else BOOST_GRID)
    make = forest if kind == "forest" else boosted
    combos = draw_params(grid, draws, seed)
    least = {"min_samples_split": 2} if "min_samples_split" in grid else {}
    est = make(target, seed, **least)
    maps = [{est.getParam(k): v for k, v in _checked(c, known).items()} for c in combos]
    with held(train.select(*dict.fromkeys([order_col, *features, target]))) as kept:
        folded = contiguous_folds(kept, order_col, folds, "_fold")
        stage, pack, ready = _prepare(folded, target, features, ["_fold"])
        cv = CrossValidator(
            estimator=est, estimatorParamMaps=maps, numFolds=folds, foldCol="_fold",
            evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
            parallelism=parallelism).fit(ready)
    table = train.sparkSession.createDataFrame(
        [(json.dumps(c, sort_keys=True), float(r)) for c, r in zip(combos, cv.avgMetrics)],
        "params string, r2_mean double").orderBy(F.desc("r2_mean"), "params")
    return PipelineModel([stage, pack, cv.bestModel]), table
