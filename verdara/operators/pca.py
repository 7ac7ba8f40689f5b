"""Principal components of standardised columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdara.operators.prep import Scaling
from verdara.operators.reuse import held


@dataclass(frozen=True)
class Components:
    """Fitted components: feature × component loadings and variance shares."""

    features: tuple[str, ...]
    scaling: Scaling
    loadings: tuple[tuple[float, ...], ...]
    ratio: tuple[float, ...]

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.ratio))]

    def scores(self, df: DataFrame) -> DataFrame:
        """Append PC1…PCk as plain column arithmetic; ids and order do not matter."""
        z = [(F.col(c).cast("double") - F.lit(self.scaling.mean[c])) / F.lit(self.scaling.std[c])
             for c in self.features]
        made = {}
        for k, name in enumerate(self.names):
            total = F.lit(0.0)
            for i, col in enumerate(z):
                total = total + col * F.lit(self.loadings[i][k])
            made[name] = total
        return df.withColumns(made)


def fit(df: DataFrame, cols: Sequence[str], k: int | None = None) -> Components:
    """Fit on complete rows.  Every component's largest loading is made positive."""
    cols = list(cols)
    k = k or len(cols)
    with held(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()) as rows:
        row = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        mean = {c: row[f"m_{c}"] for c in cols}
        std = {c: row[f"s_{c}"] or 1.0 for c in cols}
        z = rows.select(*[((F.col(c) - F.lit(mean[c])) / F.lit(std[c])).alias(c) for c in cols])
        vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(z).select("v")
        model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    scaling = Scaling(mean, mean, std)
    table = model.pc.toArray().copy()
    for j in range(table.shape[1]):
        top = abs(table[:, j]).argmax()
        if table[top, j] < 0:
            table[:, j] = -table[:, j]
    return Components(tuple(cols), scaling,
                      tuple(tuple(float(v) for v in r) for r in table),
                      tuple(float(v) for v in model.explainedVariance.toArray()))


def loadings(components: Components, spark) -> DataFrame:
    """(pc, feature, loading)."""
    rows = [(name, f, components.loadings[i][j])
            for j, name in enumerate(components.names)
            for i, f in enumerate(components.features)]
    return spark.createDataFrame(rows, "pc string, feature string, loading double")


def variance(components: Components, spark) -> DataFrame:
    """(pc, evr, cum): variance share and running total in percent; one row per component."""
    rows = [(i + 1, v) for i, v in enumerate(components.ratio)]
    run = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return (spark.createDataFrame(rows, "_i int, evr double")
            .select(F.concat(F.lit("PC"), F.col("_i")).alias("pc"), "evr",
                    (F.sum("evr").over(run) * 100).alias("cum")))
