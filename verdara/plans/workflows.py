"""The four end-to-end flows: extract, align and explore, train and score, map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.functions.points import normal_id
from verdara.operators import (
    align, boxcox, correlate, crosspol, kernel, linear, metrics, pca, prep, raster, tidy, trees)
from verdara.sources import tables
from verdara.sources.models import KernelModel
from verdara.sources.scratch import stored


def extract_wide_table(points: DataFrame, stacks: Mapping[str, tuple[DataFrame, Mapping[int, str]]],
                       meta: DataFrame, id_col: str, raster_col: str, x_col: str,
                       y_col: str) -> DataFrame:
    """Points sampled from every stack, cross-pol columns added, merged by point id."""
    parts = []
    for pixels, bands in stacks.values():
        part = raster.sample_points(points, pixels, meta, bands, [id_col], raster_col, x_col, y_col)
        parts.append(part)
        cross = crosspol.crosspol_wide(part, [id_col], in_db=False)
        if len(cross.columns) > 1:
            parts.append(cross)
    return align.outer_merge(parts, [id_col])


def align_wide(field: DataFrame, wide: DataFrame, point_col: str | None = None,
               time_col: str | None = None, radar_point_col: str | None = None,
               keep: Sequence[str] | None = None, prefixes: Sequence[str] | None = None,
               tolerance_days: int | None = 2, probe_col: str | None = None,
               order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Aligned rows and their counters from a wide radar table.

    ``order`` names the column with the position of a row in the files; of several rows of a
    point the first value counts.
    """
    radar_point_col = radar_point_col or align.detect_point_col(wide.columns)
    # ids first: rows whose ids differ in notation only belong to one point
    wide = wide.withColumn(radar_point_col, normal_id(F.col(radar_point_col)))
    rows = align.align(field, tidy.tidy_wide(wide, radar_point_col, order=order), point_col, time_col,
                       radar_point_col, keep, prefixes, tolerance_days)
    return rows, align.align_stats(rows, probe_col)


def explore(aligned: DataFrame, targets: Sequence[str], features: Sequence[str],
            components: int = 4, threshold: float = 0.4, method: str = "pearson",
            forced: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Correlations before and after Box-Cox and with components, and the selection."""
    corr = getattr(correlate, method)
    k = min(components, len(features))
    fitted = pca.fit(aligned, features, k)
    scored = fitted.scores(aligned)
    lambdas = boxcox.fit_lambdas(aligned, [*features, *targets])
    plain = corr(aligned, targets, features)
    with_pc = corr(scored, targets, fitted.names)
    return {
        "scored": scored, "correlations": plain, "component_correlations": with_pc,
        "transformed_correlations": corr(boxcox.transform(aligned, lambdas), targets, features),
        "selected": correlate.select_features(plain.unionByName(with_pc), threshold, forced),
    }


def _two_sets(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where("split = 'train'"), split.where("split = 'val'")


def _score(scored: DataFrame, target: str, yhat: str) -> DataFrame:
    """(target, set, metric, value) of rows with a split column."""
    wide = metrics.regression_metrics(scored.withColumnRenamed("split", "set"), target, yhat,
                                      ["set"])
    return (metrics.metrics_long(wide, ["set"])
            .select(F.lit(target).alias("target"), "set", "metric", "value"))


def linear_scores(split: DataFrame, targets: Sequence[str], features: Sequence[str],
                  model_type: str = "ridge", alpha: float = 1.0) -> DataFrame:
    """Fit on train, score both sets, one target after the other on shared scaling."""
    train, _ = _two_sets(split)
    scaling = prep.fit_scaling(train, features)
    parts = []
    for target in targets:
        model = linear.fit(train, target, features, model_type, alpha, scaling)
        parts.append(_score(linear.predict(model, split), target, "prediction"))
    return reduce(DataFrame.unionByName, parts)


def kernel_scores(split: DataFrame, target: str, features: Sequence[str],
                  id_cols: Sequence[str], grid: Sequence[float],
                  reg_type: str = "lc") -> tuple[DataFrame, DataFrame, KernelModel]:
    """Bandwidth by leave-one-out on train, then scores of both sets.

    Returns the scores, the risk table and the fitted model.
    """
    train, _ = _two_sets(split)
    scaling = prep.fit_scaling(train, features)
    z = scaling.standardise(train)
    risk = kernel.loo_risk(z, features, target, grid, id_cols)
    h = kernel.best_bandwidth(risk).first()["h"]
    model = KernelModel(train.select(*id_cols, *features, target), features, target, scaling,
                        h, reg_type)
    yhat = model.transform(split, id_cols)
    scored = split.select(*id_cols, "split", target).join(yhat, list(id_cols))
    return _score(scored, target, "yhat"), risk, model


def tree_scores(split: DataFrame, target: str, features: Sequence[str], order_col: str,
                kind: str = "forest", grid: Mapping[str, Sequence] | None = None,
                draws: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Randomised search on train, then scores of both sets and the importances."""
    train, _ = _two_sets(split)
    model, _table = trees.random_search(train, target, features, order_col, kind, grid, draws,
                                        seed=seed)
    scored = linear.predict(model, split)
    importance = trees.impurity_importance(model, features, split.sparkSession)
    return _score(scored, target, "prediction"), importance, model


def write_metric_files(long: DataFrame, base_dir: str, folders: Mapping[str, str]) -> None:
    """``<folder>/metrics_<target>.csv`` per model and target with train and val columns.

    A metric table has one row per model, target, metric and set, so the list of
    model and target pairs is short.  The scores are computed once.
    """
    wide = stored(long.groupBy("model", "target", "metric")
                  .pivot("set", ["train", "val"]).agg(F.avg("value")))
    for row in wide.select("model", "target").distinct().collect():
        part = wide.where((F.col("model") == row["model"]) & (F.col("target") == row["target"]))
        tables.write_csv(part.select("metric", "train", "val").coalesce(1),
                         f"{base_dir}/{folders[row['model']]}/metrics_{row['target']}.csv")


def map_from_features(stacks: Mapping[str, DataFrame | None],
                      bands: Mapping[str, Mapping[int, str]], features: Sequence[str],
                      model: PipelineModel, nodata: Mapping[str, float | None] | None = None,
                      out_nodata: float = -9999.0) -> DataFrame:
    """(raster, row, col, pred) from temporal-mean features and a fitted pipeline.

    Lazy; ``write_prediction`` raises if no pixel was valid, without a second pass.
    """
    pixels = raster.stack_pixels(stacks)
    present = {s: b for s, b in bands.items() if stacks.get(s) is not None}
    every = raster.pixel_features(pixels, present, features, nodata, keep_invalid=True)
    return raster.prediction_raster(linear.predict(model, every), nodata=out_nodata)


def map_from_ratios(intensity: DataFrame, bands: Mapping[int, str], model: PipelineModel,
                    nodata: float | None = None, out_nodata: float = -9999.0) -> DataFrame:
    """(raster, row, col, pred) from the two ratio-of-means features."""
    every = raster.ratio_of_means(intensity, bands, nodata=nodata, keep_invalid=True)
    return raster.prediction_raster(linear.predict(model, every), nodata=out_nodata)


def map_with_kernel(every: DataFrame, model: KernelModel, out_nodata: float = -9999.0) -> DataFrame:
    """As above for a kernel model, whose prediction is joined back by pixel."""
    yhat = model.transform(every.where("valid"), list(raster.PIXEL))
    scored = every.select(*raster.PIXEL, "valid").join(yhat, list(raster.PIXEL), "left")
    return raster.prediction_raster(scored, "yhat", out_nodata)
