"""One registry for fitted models: save, load by name, find the newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.operators import kernel
from verdara.operators.prep import Scaling

ENTRY = "path string, target string, kind string, saved_at timestamp_ntz"


class ModelRegistry:
    """Pipelines and kernel models under ``<root>/models`` and one entry row per save."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model: PipelineModel | KernelModel, name: str, target: str) -> str:
        path = f"{self.root}/models/{name}"
        kind = "kernel" if isinstance(model, KernelModel) else "pipeline"
        if kind == "kernel":
            model.save(path)
        else:
            model.write().overwrite().save(path)
        (self.spark.range(1)
         .select(F.lit(path).alias("path"), F.lit(target).alias("target"),
                 F.lit(kind).alias("kind"), F.localtimestamp().alias("saved_at"))
         .write.mode("append").parquet(f"{self.root}/entries"))
        return path

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/entries")

    def _read(self, path: str, kind: str) -> PipelineModel | KernelModel:
        return KernelModel.load(self.spark, path) if kind == "kernel" else PipelineModel.load(path)

    def load(self, name: str) -> PipelineModel | KernelModel:
        """Model saved under exactly this name."""
        path = f"{self.root}/models/{name}"
        row = latest_model(self.entries().where(F.col("path") == path), name).first()
        if row is None:
            raise FileNotFoundError(f"no model is saved as {name!r}")
        return self._read(path, row["kind"])

    def load_latest(self, text: str) -> PipelineModel | KernelModel:
        row = latest_model(self.entries(), text).first()
        if row is None:
            raise FileNotFoundError(f"no saved model has {text!r} in its name")
        return self._read(row["path"], row["kind"])


def latest_model(entries: DataFrame, text: str) -> DataFrame:
    """(path, target, kind, saved_at) of the newest entry whose name holds ``text``."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return (entries.where(F.contains(name, F.lit(text.lower())))
            .agg(F.max_by(F.struct("path", "target", "kind", "saved_at"),
                          F.struct("saved_at", "path")).alias("m"))
            .where("m IS NOT NULL").select("m.*"))


class KernelModel:
    """A fitted kernel regression: training rows, scaling and bandwidth."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str,
                 scaling: Scaling, h: float, reg_type: str = "lc"):
        if reg_type not in ("lc", "ll"):
            raise ValueError("reg_type must be 'lc' or 'll'")
        self.train, self.features, self.target = train, list(features), target
        self.scaling, self.h, self.reg_type = scaling, float(h), reg_type

    def transform(self, df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
        """(ids, yhat); ``df`` holds unscaled features."""
        z = self.scaling.standardise(df)
        train = self.scaling.standardise(self.train)
        if self.reg_type == "ll":
            return kernel.predict_local_linear(z, train, self.features, self.target,
                                               self.h, id_cols)
        return kernel.predict(z, train, self.features, self.target, self.h, id_cols).drop("h")

    def save(self, path: str) -> None:
        spark = self.train.sparkSession
        self.train.select(*self.features, self.target).write.mode("overwrite").parquet(
            f"{path}/train")
        rows = [(c, float(self.scaling.median[c]), float(self.scaling.mean[c]),
                 float(self.scaling.std[c]), i, self.target, self.h, self.reg_type)
                for i, c in enumerate(self.features)]
        spark.createDataFrame(
            rows, "feature string, median double, mean double, std double, pos int, "
                  "target string, h double, reg_type string").write.mode("overwrite").json(
            f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KernelModel:
        rows = sorted(spark.read.json(f"{path}/model").collect(), key=lambda r: r["pos"])
        scaling = Scaling({r["feature"]: r["median"] for r in rows},
                          {r["feature"]: r["mean"] for r in rows},
                          {r["feature"]: r["std"] for r in rows})
        return cls(spark.read.parquet(f"{path}/train"), [r["feature"] for r in rows],
                   rows[0]["target"], scaling, rows[0]["h"], rows[0]["reg_type"])
