"""Linear, ridge and lasso regression on imputed, standardised features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.operators.prep import Scaling, fit_scaling
from verdara.operators.reuse import held

FEATURES = "_features"


def scaling_stage(scaling: Scaling, standardise: bool = True) -> SQLTransformer:
    """The fitted preprocessing as a stage that is saved with the pipeline.

    Prepared values get their own ``_z_`` columns; the input columns stay as they are.
    """
    empty = [c for c, m in scaling.median.items() if m is None or not math.isfinite(m)]
    if empty:
        raise ValueError(f"leave out features without a finite median: {empty}")
    cells = []
    for c, mid in scaling.median.items():
        x = f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {mid!r}D)"
        if standardise:
            x = f"({x} - ({scaling.mean[c]!r}D)) / ({scaling.std[c]!r}D)"
        cells.append(f"{x} AS `_z_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol=FEATURES,
                           handleInvalid="keep")


def estimator(model_type: str, alpha: float, label_std: float, n: int,
              target: str) -> LinearRegression:
    """Spark estimator whose penalty equals the usual sum-of-squares definition.

    Spark averages the loss over n and scales the label by its deviation, hence the
    factor std(y)/n for ridge; lasso is already per-row on unscaled labels.
    """
    base = dict(featuresCol=FEATURES, labelCol=target, predictionCol="prediction")
    kind = model_type.lower()
    if kind == "ols":
        return LinearRegression(regParam=0.0, solver="normal", **base)
    if kind == "ridge":
        return LinearRegression(regParam=alpha * label_std / n, elasticNetParam=0.0,
                                solver="normal", **base)
    if kind == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False,
                                maxIter=10000, tol=1e-12, **base)
    raise ValueError("model_type must be 'ols', 'ridge' or 'lasso'")


def fit(train: DataFrame, target: str, features: Sequence[str], model_type: str = "ridge",
        alpha: float = 1.0, scaling: Scaling | None = None) -> PipelineModel:
    """Fitted pipeline: imputation and scaling, vector assembly, regression."""
    estimator(model_type, alpha, 1.0, 1, target)
    with held(train.select(*dict.fromkeys([*features, target]))) as kept:
        scaling = scaling or fit_scaling(kept, features)
        rows = kept.where(F.col(target).isNotNull())
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
        prepare, pack = scaling_stage(scaling), assembler(features)
        ready = pack.transform(prepare.transform(rows)).select(
            FEATURES, F.col(target).cast("double"))
        model = estimator(model_type, alpha, size["s"] or 0.0, size["n"], target).fit(ready)
    return PipelineModel([prepare, pack, model])


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    scored = model.transform(df)
    keep = [c for c in scored.columns if not c.startswith("_z_") and c not in (FEATURES,)]
    return scored.select(*keep).withColumnRenamed("prediction", out)


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, coef), largest absolute value first."""
    pairs = [(f, float(c)) for f, c in zip(features, model.stages[-1].coefficients)]
    return (spark.createDataFrame(pairs, "feature string, coef double")
            .orderBy(F.abs("coef").desc(), "feature"))
