"""Metric files of many models, gathered into one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default targets and the folder of each model.
TARGETS = ("VWC", "IBA", "total_biomass")
MODEL_FOLDERS = {
    "Linear Regression": "artifacts_linear",
    "Nadaraya-Watson": "artifacts_nadaraya_watson",
    "Random Forest": "artifacts_rf",
    "LightGBM": "artifacts_lgbm",
}
SCHEMA = "model string, target string, metric string, set string, value double"


def target_of(name: Column, targets: Sequence[str]) -> Column:
    """First listed target that is part of the file name, case-insensitive."""
    rule = None
    for t in targets:
        hit = F.contains(F.lower(name), F.lit(t.lower()))
        rule = F.when(hit, t) if rule is None else rule.when(hit, t)
    return rule


def gather(spark: SparkSession, base_dir: str, targets: Sequence[str] = TARGETS,
           model_folders: Mapping[str, str] = MODEL_FOLDERS) -> DataFrame:
    """(model, target, metric, set, value) of every conforming metric file.

    A file directly below the model folder counts when its name holds ``metric`` and a
    target and its header names ``train`` and ``val``; a folder of part files written by
    Spark counts like a file.  Files are read whole, because the column order may
    differ from file to file and the header belongs to its own lines; a metric file
    has four lines.  Unreadable or non-conforming files and missing folders are
    skipped.
    """
    out = spark.createDataFrame([], SCHEMA)
    for model, folder in model_folders.items():
        try:
            path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            lines = (spark.read.option("pathGlobFilter", "*.csv")
                     .option("recursiveFileLookup", True)
                     .option("ignoreCorruptFiles", True)
                     .text(f"{base_dir}/{folder}", wholetext=True)
                     .select(F.substring_index(path, f"/{folder}/", -1).alias("name"),
                             "value"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # one level only; part files stand for the folder that Spark wrote
        parts = F.split("name", "/")
        lines = (lines.where((F.size(parts) == 1) | (F.size(parts) == 2) & parts[1].startswith("part-"))
                 .withColumn("name", parts[0]))
        out = out.unionByName(_parse(lines, targets).select(F.lit(model).alias("model"), "*"))
    return out


def _parse(files: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Long rows of the conforming files."""
    target = target_of(F.col("name"), targets)
    rows = F.filter(F.split(F.col("value"), "\r?\n"), lambda s: F.length(F.trim(s)) > 0)
    wanted = (files.where(F.contains(F.lower("name"), F.lit("metric")) & target.isNotNull())
              .select(target.alias("target"), rows.alias("rows"))
              .where(F.size("rows") > 1)
              .select("target", F.split(F.col("rows")[0], ",").alias("head"),
                      F.explode(F.slice("rows", 2, F.size("rows") - 1)).alias("row")))
    at = {s: F.array_position(F.transform("head", F.trim), s) for s in ("train", "val")}
    cells = F.split("row", ",")
    fields = {s: F.trim(F.try_element_at(cells, F.when(p > 0, p).cast("int")))
              for s, p in at.items()}
    conforming = wanted.where((at["train"] > 0) & (at["val"] > 0))
    return (conforming.select("target", cells[0].alias("metric"),
                              *[c.try_cast("double").alias(s) for s, c in fields.items()])
            .unpivot(["target", "metric"], ["train", "val"], "set", "value"))
