"""Kernel regression as a ``pyspark.ml`` stage, for pipelines, cross-validation and saved models."""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import kernel
from verdara.operators.prep import Scaling, fit_scaling
from verdara.operators.spread import join_lookup
from verdara.sources.scratch import stored


class _KernelParams(HasLabelCol, HasPredictionCol):
    featureCols = Param(Params._dummy(), "featureCols", "numeric feature columns",
                        TypeConverters.toListString)
    bandwidth = Param(Params._dummy(), "bandwidth", "width of the kernel in standard deviations",
                      TypeConverters.toFloat)
    bandwidths = Param(Params._dummy(), "bandwidths", "grid searched by leave-one-out risk if no "
                       "bandwidth is set", TypeConverters.toListFloat)
    regType = Param(Params._dummy(), "regType", "lc: weighted mean, ll: local-linear",
                    TypeConverters.toString)

    def _check(self) -> None:
        if self.getOrDefault(self.regType) not in ("lc", "ll"):
            raise ValueError("regType must be 'lc' or 'll'")


class KernelRegressor(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Nadaraya–Watson or local-linear regression on standardised features.

    ``fit`` keeps the rows with a label as they are; missing features count as their median.
    """

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, predictionCol="prediction",
                 bandwidth=None, bandwidths=None, regType="lc"):
        super().__init__()
        self._setDefault(predictionCol="prediction", regType="lc")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> KernelRegressionModel:
        self._check()
        features, label = self.getOrDefault(self.featureCols), self.getLabelCol()
        train = dataset.select(*features, F.col(label).cast("double").alias(label))
        train = train.where(F.col(label).isNotNull() & ~F.isnan(label))
        scaling = fit_scaling(train, features)
        if self.isSet(self.bandwidth):
            h = self.getOrDefault(self.bandwidth)
        else:
            rows = stored(scaling.standardise(train).withColumn("_at", F.monotonically_increasing_id()))
            risk = kernel.loo_risk(rows, features, label, self.getOrDefault(self.bandwidths), ["_at"])
            h = kernel.best_bandwidth(risk).first()["h"]
        model = KernelRegressionModel(train, scaling)
        return self._copyValues(model)._set(bandwidth=float(h))


class KernelRegressionModel(Model, _KernelParams, MLReadable, MLWritable):
    """Adds the prediction to all rows; NULL where every weight underflows."""

    def __init__(self, train: DataFrame | None = None, scaling: Scaling | None = None):
        super().__init__()
        self._setDefault(predictionCol="prediction", regType="lc")
        self.train, self.scaling = train, scaling

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._check()
        features, label = self.getOrDefault(self.featureCols), self.getLabelCol()
        h, out = self.getOrDefault(self.bandwidth), self.getPredictionCol()
        kept = [c for c in dataset.columns if c != out]
        rows = dataset.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *features)
        z, train = self.scaling.standardise(rows), self.scaling.standardise(self.train)
        asked = z.select(*features).distinct()  # equal rows have one prediction
        if self.getOrDefault(self.regType) == "ll":
            found = kernel.predict_local_linear(asked, train, features, label, h, features)
        else:
            found = kernel.predict(asked, train, features, label, h, features).drop("h")
        joined = join_lookup(z, found, features)
        return joined.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("yhat").alias(out))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: KernelRegressionModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        s = self.model.scaling
        scaling = {name: {c: float(v) for c, v in values.items()}
                   for name, values in (("median", s.median), ("mean", s.mean), ("std", s.std))}
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"scaling": scaling})
        self.model.train.write.parquet(f"{path}/train")


class _Reader(MLReader):
    def load(self, path: str) -> Any:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        s = metadata["scaling"]
        model = KernelRegressionModel(spark.read.parquet(f"{path}/train"),
                                      Scaling(s["median"], s["mean"], s["std"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
