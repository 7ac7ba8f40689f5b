"""Random forests in which only nodes of a least number of rows are split.

Spark chooses the split of a node from its own rows, so leaving small nodes unsplit is the same as
growing the tree and cutting what hangs below them.  The node table of the fitted model is cut and
loaded again, so the result is a plain Spark model.  With bootstrapping, rows count as often as
they were drawn.  Forests that draw columns per node draw them as without the parameter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from verdara.sources.scratch import scratch_dir


def _kept(nodes: pd.DataFrame, least: int) -> pd.DataFrame:
    """Nodes of one tree that stay, numbered anew in depth-first order; -1: no child."""
    rows = {r.id: r for r in nodes.itertuples()}
    number, order, stack = {}, [], [0]
    while stack:
        at = rows[stack.pop()]
        inner = at.left >= 0 and at.n >= least
        number[at.id] = len(order)
        order.append((at.id, inner))
        if inner:
            stack += [at.right, at.left]
    return pd.DataFrame(
        [(nodes["treeID"].iloc[0], i, number[i], *((number[rows[i].left], number[rows[i].right])
                                                   if inner else (-1, -1))) for i, inner in order],
        columns=["treeID", "id", "number", "left", "right"])


def cut(model: RandomForestRegressionModel, least: int, spark) -> RandomForestRegressionModel:
    """The model without splits of nodes that have fewer than ``least`` rows."""
    whole, path = scratch_dir(spark) + "/forest", scratch_dir(spark) + "/forest"
    model.write().save(whole)
    nodes = spark.read.parquet(f"{whole}/data")
    node = F.col("nodeData")
    slim = nodes.select("treeID", node["id"].alias("id"), node["leftChild"].alias("left"),
                        node["rightChild"].alias("right"), node["rawCount"].alias("n"))
    kept = slim.groupBy("treeID").applyInPandas(
        lambda tree: _kept(tree, least), "treeID int, id int, number int, left int, right int")
    leaf, split = F.col("left") < 0, nodes.schema["nodeData"].dataType["split"].dataType
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>")
                    .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).cast(split)
    new = (node.withField("id", F.col("number")).withField("leftChild", F.col("left"))
           .withField("rightChild", F.col("right"))
           .withField("gain", F.when(leaf, -1.0).otherwise(node["gain"]))
           .withField("split", F.when(leaf, none).otherwise(node["split"])))
    own = nodes.withColumn("id", node["id"]).join(kept, ["treeID", "id"])
    own.select("treeID", new.alias("nodeData")).write.parquet(f"{path}/data")
    spark.read.parquet(f"{whole}/treesMetadata").write.parquet(f"{path}/treesMetadata")
    spark.read.text(f"{whole}/metadata").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


class SplitForestRegressor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """RandomForestRegressor with ``minSamplesSplit``; fits a RandomForestRegressionModel."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a node",
                                TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features per split",
                                  TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows per tree", TypeConverters.toBoolean)
    minSamplesSplit = Param(Params._dummy(), "minSamplesSplit", "least rows of a node that is split",
                            TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(minSamplesSplit=2)
        self._set(**params)

    def _fit(self, dataset):
        params = {p.name: v for p, v in self.extractParamMap().items()}
        least = params.pop("minSamplesSplit")
        model = RandomForestRegressor(**params).fit(dataset)
        return cut(model, least, dataset.sparkSession) if least > 2 else model
