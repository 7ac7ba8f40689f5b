"""Every operator bound to the given tables: name → (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.functions import dates, points, radar
from verdara.operators import (
    align, boxcox, correlate, crosspol, describe, kernel, linear, metrics, pca, prep, raster,
    tidy, trees)
from verdara.plans import inputs as src
from verdara.plans.inputs import table
from verdara.sources import metric_files, models, tables

H_GRID = tuple(10 ** (-2 + 3 * i / 29) for i in range(30))
H_PREDICT = 0.3
REGRESSORS = ["n_lines", "sum_qty", "avg_discount"]
LINE_FEATURES = ["l_quantity", "l_discount"]
ALPHA_RIDGE, ALPHA_LASSO = 1.0, 100.0
PARCELS = ["R1", "R4", "R7"]
MAP_FEATURES = ["Sigma0_VH", "Sigma0_VV"]
SMALL_TREES = {"n_estimators": 10, "max_depth": 5}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round the DOUBLE columns so that both engines print the same digits."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), special.get(n, digits)).alias(n) if t == "double"
        else F.col(f"`{n}`") for n, t in df.dtypes])


# --- tables ---------------------------------------------------------------

@query
def load_table(spark, sf_dir):
    path = src.scratch_dir(spark) + "/customer"
    wide = table(spark, sf_dir, "customer").withColumnRenamed("c_name", " c_name ")
    tables.write_csv(wide, path)
    return tables.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query
def load_missing(spark, sf_dir):
    """NaN cells of a file are missing values."""
    path = src.scratch_dir(spark) + "/customer"
    nan = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", nan.alias("c_acctbal")), path)
    rows = tables.read_csv(spark, path, "c_custkey bigint, c_acctbal double")
    return rows.withColumn("missing", F.col("c_acctbal").isNull())


@query
def write_roundtrip(spark, sf_dir):
    path = src.scratch_dir(spark) + "/pixels"
    tables.write_pixels(src.pixels(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return rounded(back.select("raster", "row", "col", "band",
                               F.col("value").cast("double").alias("value")))


@query
def preview(spark, sf_dir):
    return (table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
            .orderBy("event_id").limit(5))


@query
def select_xy(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return prep.select_xy(lines, ["l_extendedprice"])


@query
def rename_project(spark, sf_dir):
    return (table(spark, sf_dir, "orders")
            .select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date")
                    .alias("o_orderdate"))
            .withColumnsRenamed({"o_totalprice": "total_biomass", "o_orderdate": "sample_day"}))


@query
def fill_zero(spark, sf_dir):
    per = (table(spark, sf_dir, "orders").groupBy("o_custkey")
           .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total")))
    joined = (table(spark, sf_dir, "customer").select("c_custkey")
              .join(per, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey"))
    return rounded(prep.fill_zero(joined), 2)


@query
def model_ready(spark, sf_dir):
    return prep.model_ready(
        table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date")),
        "l_orderkey", "l_shipdate", ["l_extendedprice"], ["l_quantity", "l_discount"])


@query
def prefix_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(points.has_prefix(points.normal_id(F.col("p_type")), ("S", "P"))).select(
        "p_partkey", "p_type")


@query
def cover_type(spark, sf_dir):
    labels = {"P": "Grass", "S": "Young crop", "E": "Old crop"}
    return table(spark, sf_dir, "part").select(
        "p_partkey", points.cover_type(F.col("p_type"), labels).alias("cover"))


@query
def relabel_targets(spark, sf_dir):
    return metrics.relabel(
        table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment",
        {"HOUSEHOLD": "Household", "MACHINERY": "Machines", "BUILDING": "Buildings"})


@query
def detect_roles(spark, sf_dir):
    sheet = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("update_note"), F.col("value").alias("VWC"),
        F.col("user_id").cast("string").alias("id_point"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("fecha_hora"))
    roles = align.detect_roles(sheet)
    cells = [x for role, col in roles.items() for x in (F.lit(role), F.lit(col), F.col(f"n_{role}"))]
    return (sheet.agg(*[F.count(col).alias(f"n_{role}") for role, col in roles.items()])
            .select(F.stack(F.lit(len(roles)), *cells).alias("role", "column", "n_values")))


# --- dates and names ------------------------------------------------------

@query
def parse_date_tag(spark, sf_dir):
    ts = F.col("ts")
    styles = {
        "dMonY": F.date_format(ts, "dMMMyyyy"), "dMonY_sep": F.date_format(ts, "dd_MMM_yyyy"),
        "iso": F.date_format(ts, "yyyy-MM-dd"), "ymd": F.date_format(ts, "yyyyMMdd"),
        "dmy": F.date_format(ts, "ddMMyyyy"),
        "spanish": F.concat(F.date_format(ts, "dd"), F.lit("Ene"), F.date_format(ts, "yyyy")),
        "letters_first": F.date_format(ts, "MMMddyyyy"), "no_date": F.col("event_type"),
    }
    cells = [x for name, tag in styles.items() for x in (F.lit(name), tag)]
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.stack(F.lit(len(styles)), *cells).alias("style", "tag"))
    return rows.select("event_id", "style", "tag", dates.date_from_tag(F.col("tag")).alias("date"),
                       dates.date_from_plain_tag(F.col("tag")).alias("plain_date"))


@query
def parse_band_name(spark, sf_dir):
    day = F.date_format("ts", "ddMMMyyyy")
    kind = F.col("event_type")
    name = (F.when(kind == "view", F.concat(F.lit("Sigma0_IW1_VH_mst_"), day))
            .when(kind == "click", F.concat(F.lit("gamma0_IW2_vv_slv4_"), day))
            .when(kind == "purchase", F.concat(F.lit("entropy_slv8_"), day))
            .when(kind == "signup", F.concat(F.lit("dpRVI_"), day))
            .otherwise(F.lit("DPRVI")))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    parts = radar.intensity_parts(F.col("name"))
    haa = radar.decomposition_parts(F.col("name"))
    return rows.select(
        "event_id", "name", parts["prod"].alias("prod"), parts["pol"].alias("pol"),
        haa["param"].alias("param"),
        dates.date_from_tag(F.coalesce(parts["date"], haa["date"])).alias("date"),
        radar.vegetation_index_date(F.col("name")).alias("index_date"))


@query
def date_plus_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", dates.date_plus_time(F.col("ts").cast("date"),
                                         F.date_format("ts", "HH:mm:ss")).alias("datetime"))


# --- tidy and align -------------------------------------------------------

def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", F.col("user_id").cast("bigint"))


@query
def tidy_long(spark, sf_dir):
    return rounded(_with_key(tidy.tidy_long(src.radar_wide(spark, sf_dir), "user_id",
                                            drop_null=True)))


@query
def tidy_wide(spark, sf_dir):
    return rounded(_with_key(tidy.tidy_wide(src.radar_wide(spark, sf_dir), "user_id")))


@query
def tidy_first_row(spark, sf_dir):
    """Several rows a point: the first value in the order of the files, column before row."""
    path = src.scratch_dir(spark) + "/radar"
    tables.write_parquet(src.radar_slots(spark, sf_dir).orderBy("slot", "user_id"), path)
    wide = tables.read_parquet(spark, path, position="_place").drop("slot")
    return rounded(_with_key(tidy.tidy_wide(wide, "user_id", order="_place")))


@query
def pivot_first_row(spark, sf_dir):
    """Several long rows a cell: the first by event."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("var_base"), F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("val"), "event_id")
    return rounded(tidy.pivot_tidy(rows, "user_id", src.RADAR_VARS, order="event_id"))


def _align(spark, sf_dir, radar_df, **kw):
    out = align.align(src.field_rows(spark, sf_dir), radar_df, "user_id", "ts", "user_id", **kw)
    return rounded(_with_key(out).drop("ts"))


@query
def align_exact(spark, sf_dir):
    return _align(spark, sf_dir, src.radar_views(spark, sf_dir), tolerance_days=None).select(
        "event_id", "user_id", "day", "value", "view")


@query
def align_two_notations(spark, sf_dir):
    """Radar points written in two ways are one point; every field row stays once."""
    long = src.radar_tidy(spark, sf_dir)
    radar_df = long.select("user_id", "date", "view", F.lit(None).cast("double").alias("click")).unionByName(
        long.select(F.concat(F.lit(" "), "user_id", F.lit(" ")).alias("user_id"), "date",
                    F.lit(None).cast("double").alias("view"), "click"))
    return _align(spark, sf_dir, radar_df).select("event_id", "user_id", "day", "value", "sar_date",
                                                  "day_diff", "view", "click")


@query
def align_nearest(spark, sf_dir):
    return _align(spark, sf_dir, src.radar_views(spark, sf_dir)).select(
        "event_id", "user_id", "day", "value", "view", "sar_date", "day_diff")


@query
def align_probe_col(spark, sf_dir):
    found = _align(spark, sf_dir, src.radar_tidy(spark, sf_dir))
    how = (F.when((F.col("day_diff") == 0) & F.col("click").isNotNull(), "exact")
           .when(F.col("sar_date").isNotNull(), "nearest").otherwise("none"))
    return found.select("event_id", "user_id", "day", "sar_date", "click", "error", "signup",
                        "view", how.alias("how"))


@query
def align_keep_only(spark, sf_dir):
    return _align(spark, sf_dir, src.radar_tidy(spark, sf_dir), keep=["signup", "view", "Alpha"])


@query
def align_stats(spark, sf_dir):
    aligned = align.align(src.field_rows(spark, sf_dir), src.radar_views(spark, sf_dir),
                          "user_id", "ts", "user_id")
    return align.align_stats(aligned)


@query
def dates_by_point(spark, sf_dir):
    return _with_key(align.dates_by_point(src.radar_long(spark, sf_dir), "user_id"))


@query
def common_dates(spark, sf_dir):
    return _with_key(crosspol.common_dates(src.radar_long(spark, sf_dir), ["user_id", "date"],
                                           "var_base", "view", "click"))


@query
def outer_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")

    def per(kind, agg):
        return events.where(F.col("event_type") == kind).groupBy("user_id").agg(agg)

    return rounded(align.outer_merge([
        per("purchase", F.count(F.lit(1)).alias("n_purchases")),
        per("view", F.sum("value").alias("view_sum")),
        per("error", F.max("value").alias("error_max"))], ["user_id"]), 4)


# --- radar algebra --------------------------------------------------------

@query
def crosspol_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.stack(F.lit(2), F.lit("VH"), F.col("l_tax"), F.lit("VV"), F.col("l_discount"))
        .alias("pol", "val"))
    return rounded(crosspol.crosspol_long(rows, ["l_orderkey", "l_linenumber"]))


@query
def crosspol_wide_db(spark, sf_dir):
    """Wide names, decibels in and out; only dates with both polarisations give columns."""
    db = {"Sigma0_VH_19Feb2025": "l_extendedprice", "Sigma0_VV_19Feb2025": "l_quantity",
          "Gamma0_VH_15Mar2025": "l_tax", "Gamma0_VV_15Mar2025": "l_discount",
          "Sigma0_VH_08Apr2025": "l_tax"}
    wide = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *[radar.linear_to_db(F.col(c)).alias(n) for n, c in db.items()])
    return rounded(crosspol.crosspol_wide(wide, ["l_orderkey", "l_linenumber"], True, True), 4)


@query
def db_linear(spark, sf_dir):
    db = radar.linear_to_db(F.col("l_extendedprice"))
    return rounded(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", db.alias("db"), radar.db_to_linear(db).alias("back"),
        radar.linear_to_db(F.col("l_discount")).alias("discount_db")), 5)


@query
def db_minmax(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(crosspol.scale_db(lines, ["l_returnflag"], "l_extendedprice")
                   .drop("l_extendedprice"))


# --- rasters --------------------------------------------------------------

@query
def band_names(spark, sf_dir):
    return raster.name_bands(src.pixels(spark, sf_dir), src.INTENSITY_BANDS).drop("value")


@query
def mapped_bands(spark, sf_dir):
    names = dict(src.INTENSITY_BANDS) | {41: "unreadable", 42: "Sigma0_VH_nodate"}
    return raster.mapped_intensity_bands(src.pixels(spark, sf_dir), names).drop("value")


@query
def pixel_valid_mask(spark, sf_dir):
    return raster.valid_pixels(src.masked_pixels(spark, sf_dir), src.NODATA)


@query
def pixel_temporal_mean(spark, sf_dir):
    bands = [b for b, n in src.INTENSITY_BANDS.items() if n.startswith("Sigma0_VV")]
    return rounded(raster.temporal_mean(src.masked_pixels(spark, sf_dir), bands))


@query
def crosspol_pixel_mean(spark, sf_dir):
    cols = ["Sigma0_SUM_VHVV", "Sigma0_RATIO_VH_VV", "Gamma0_SUM_VHVV", "Gamma0_RATIO_VH_VV"]
    pix = src.pixels(spark, sf_dir).withColumn("stack", F.lit("intensity"))
    return rounded(raster.pixel_features(pix, {"intensity": src.INTENSITY_BANDS}, cols), 4)


@query
def ratio_of_means(spark, sf_dir):
    return rounded(raster.ratio_of_means(src.pixels(spark, sf_dir), src.INTENSITY_BANDS), 4)


@query
def pixel_features(spark, sf_dir):
    cols = ["Sigma0_VV", "Sigma0_VH", "Gamma0_VV", "Gamma0_VH", "dpRVI", "Entropy",
            "Anisotropy", "Alpha"]
    return rounded(raster.pixel_features(
        src.stacked_pixels(spark, sf_dir), src.STACK_BANDS, cols,
        {k: src.NODATA for k in src.STACK_BANDS}))


@query
def parcel_scan(spark, sf_dir):
    return rounded(raster.scan_parcels(src.pixels(spark, sf_dir), PARCELS)
                   .withColumn("value", F.col("value").cast("double")))


@query
def raster_catalogue(spark, sf_dir):
    return raster.raster_catalogue(src.pixels(spark, sf_dir), src.raster_meta(spark, sf_dir))


@query
def point_pixel_join(spark, sf_dir):
    names = src.INTENSITY_BANDS
    out = raster.sample_points(
        src.sampling_points(spark, sf_dir), src.pixels(spark, sf_dir),
        src.raster_meta(spark, sf_dir), names, ["c_custkey"], "id_parcel", "x", "y")
    return rounded(out.select("c_custkey", *[F.col(n).cast("double").alias(n)
                                             for n in names.values()]))


def _map_model(spark, sf_dir):
    pix = src.stacked_pixels(spark, sf_dir)
    return raster.pixel_features(pix, src.STACK_BANDS, MAP_FEATURES,
                                 {k: src.NODATA for k in src.STACK_BANDS}, keep_invalid=True)


def _map_scores(spark, sf_dir):
    every = src.stored(_map_model(spark, sf_dir))
    train = every.where("valid").withColumn(
        "target", F.substring("raster", 2, 9).cast("double"))
    model = linear.fit(train, "target", MAP_FEATURES, "ols")
    return raster.prediction_raster(linear.predict(model, every), nodata=src.NODATA)


@query
def predict_raster(spark, sf_dir):
    scored = _map_scores(spark, sf_dir).where(F.col("pred") != src.NODATA)
    return rounded(scored.withColumn("pred", F.col("pred").cast("double")), 3)


@query
def predict_raster_sink(spark, sf_dir):
    catalogue = raster.raster_catalogue(src.pixels(spark, sf_dir))
    path = src.scratch_dir(spark) + "/prediction"
    tables.write_prediction(raster.full_frame(_map_scores(spark, sf_dir), catalogue,
                                              nodata=src.NODATA), path, src.NODATA)
    back = spark.read.parquet(path).select("raster", "row", "col", "pred")
    return rounded(back.withColumn("pred", F.col("pred").cast("double")), 3)


# --- statistics -----------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query
def describe_by_cover(spark, sf_dir):
    return rounded(describe.describe_by(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], LINE_NUMBERS), 4)


@query
def describe_gaps(spark, sf_dir):
    """NULL groups, NaN and NULL values, and a group without values."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr("nullif(l_returnflag, 'N')").alias("flag"), "l_linestatus",
        F.when(F.col("l_tax") == 0.02, F.lit(float("nan"))).when(F.col("l_returnflag") == "A", None)
        .otherwise(F.col("l_quantity")).alias("l_quantity"))
    return rounded(describe.describe_by(lines, ["flag"], ["l_quantity"]), 4)


@query
def describe_by_date(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return rounded(describe.describe_by(lines, ["day"], ["l_quantity", "l_linenumber"]), 4)


@query
def box_stats(spark, sf_dir):
    return rounded(describe.box_stats(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"]), 4)


@query
def monthly_mean(spark, sf_dir):
    return rounded(describe.monthly_mean(
        table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", ["l_returnflag"]), 4)


@query
def bootstrap_band(spark, sf_dir):
    band = describe.bootstrap_band(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice",
                                   ["o_orderkey"], ["o_orderstatus"])
    # means of prices end on half a cent: rounded on the scaled binary value, as its SQL does
    return band.select("month", "o_orderstatus", "n", *[
        (F.round(F.col(c) * 100.0) / 100.0).alias(c) for c in ("mean", "low", "high")])


@query
def pearson_pairs(spark, sf_dir):
    return rounded(correlate.pearson(src.order_level(spark, sf_dir),
                                     ["sum_price", "sum_charge"], REGRESSORS))


@query
def spearman_pairs(spark, sf_dir):
    return rounded(correlate.spearman(src.stored(src.order_level(spark, sf_dir)),
                                      ["sum_price", "sum_charge"], REGRESSORS))


@query
def corr_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return rounded(correlate.correlation_matrix(lines, LINE_NUMBERS))


@query
def corr_select(spark, sf_dir):
    corr = correlate.pearson(src.order_level(spark, sf_dir), ["sum_price", "sum_charge"],
                             REGRESSORS)
    return correlate.select_features(corr, 0.4, ["Alpha"])


@query
def corr_union(spark, sf_dir):
    orders = src.order_level(spark, sf_dir)
    first = correlate.correlation_wide(
        correlate.pearson(orders, ["sum_price"], REGRESSORS[:2]), REGRESSORS[:2])
    second = correlate.correlation_wide(
        correlate.pearson(orders, ["sum_charge"], REGRESSORS[1:]), REGRESSORS[1:])
    return rounded(correlate.stack_matrices(first, second))


BOXCOX_COLS = ["l_extendedprice", "l_quantity", "l_discount"]


@query
def boxcox_lambda(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    best = boxcox.fit_lambdas(lines, BOXCOX_COLS)
    n = lines.agg(*[F.count(c).alias(c) for c in best])
    cells = [x for c, f in best.items() for x in (F.lit(c), F.lit(f.lam), F.lit(f.shift), F.col(c))]
    return rounded(n.select(F.stack(F.lit(len(best)), *cells)
                            .alias("column", "lambda", "shift", "n")), 4, shift=6)


@query
def boxcox_transform(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *BOXCOX_COLS)
    return rounded(boxcox.transform(lines, boxcox.fit_lambdas(lines, BOXCOX_COLS)), 4)


@query
def pca_scores(spark, sf_dir):
    orders = src.stored(src.order_level(spark, sf_dir))
    fitted = pca.fit(orders, REGRESSORS)
    return rounded(fitted.scores(orders).select("l_orderkey", *fitted.names), 5)


@query
def pca_loadings(spark, sf_dir):
    return rounded(pca.loadings(pca.fit(src.order_level(spark, sf_dir), REGRESSORS), spark))


@query
def pca_variance(spark, sf_dir):
    return rounded(pca.variance(pca.fit(src.order_level(spark, sf_dir), REGRESSORS), spark))


@query
def pca_append(spark, sf_dir):
    orders = src.stored(src.order_level(spark, sf_dir))
    scored = pca.fit(orders, REGRESSORS, 2).scores(orders)
    return rounded(correlate.pearson(scored, ["sum_price"], [*REGRESSORS, "PC1", "PC2"]))


# --- preparation ----------------------------------------------------------

@query
def random_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return prep.random_split(orders, ["o_orderkey"], 0.3, 42)


def _gappy_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"))


@query
def median_impute(spark, sf_dir):
    lines = _gappy_lines(spark, sf_dir)
    return rounded(prep.fit_scaling(lines, LINE_FEATURES).impute(lines))


@query
def standardize(spark, sf_dir):
    lines = _gappy_lines(spark, sf_dir)
    return rounded(prep.fit_scaling(lines, LINE_FEATURES).standardise(lines))


# --- linear models --------------------------------------------------------

def _line_model(spark, sf_dir, kind, alpha=1.0):
    lines = table(spark, sf_dir, "lineitem")
    return linear.fit(lines, "l_extendedprice", LINE_FEATURES, kind, alpha)


def _coefs(spark, sf_dir, kind, alpha=1.0):
    return rounded(linear.coefficients(_line_model(spark, sf_dir, kind, alpha),
                                       LINE_FEATURES, spark), 4)


@query
def ols_fit(spark, sf_dir):
    return _coefs(spark, sf_dir, "ols")


@query
def ridge_fit(spark, sf_dir):
    return _coefs(spark, sf_dir, "ridge", ALPHA_RIDGE)


@query
def ridge_coefficients(spark, sf_dir):
    return _coefs(spark, sf_dir, "ridge", 5000.0)


@query
def lasso_fit(spark, sf_dir):
    return _coefs(spark, sf_dir, "lasso", ALPHA_LASSO)


@query
def ridge_metrics(spark, sf_dir):
    from verdara.plans.workflows import linear_scores

    orders = src.stored(src.order_level(spark, sf_dir))
    split = prep.random_split(orders, ["l_orderkey"], 0.3, 42)
    return rounded(linear_scores(split, ["sum_price", "avg_discount"], ["n_lines", "sum_qty"],
                                 "ridge", ALPHA_RIDGE), 4)


# --- kernel regression ----------------------------------------------------

@query
def nw_predict(spark, sf_dir):
    rows = src.kernel_rows(spark, sf_dir)
    return rounded(kernel.predict(rows, rows, ["x"], "y", H_PREDICT, ["s_suppkey"])
                   .select("s_suppkey", "yhat"))


@query
def nw_loo_risk(spark, sf_dir):
    return rounded(kernel.loo_risk(src.kernel_rows(spark, sf_dir), ["x"], "y", H_GRID,
                                   ["s_suppkey"]))


@query
def nw_best_bandwidth(spark, sf_dir):
    return rounded(kernel.best_bandwidth(kernel.loo_risk(
        src.kernel_rows(spark, sf_dir), ["x"], "y", H_GRID, ["s_suppkey"])))


@query
def nw_val_risk(spark, sf_dir):
    rows = prep.random_split(src.kernel_rows(spark, sf_dir), ["s_suppkey"], 0.3, 42)
    return rounded(kernel.validation_risk(
        rows.where("split = 'val'"), rows.where("split = 'train'"), ["x"], "y",
        H_GRID, ["s_suppkey"]))


@query
def nw_two_predict(spark, sf_dir):
    """Two features, every bandwidth of the grid; customers without a target take no part."""
    rows = src.kernel_pairs(spark, sf_dir)
    return rounded(kernel.predict(rows, rows, ["x", "z"], "y", H_GRID, ["c_custkey"]))


@query
def nw_two_loo_risk(spark, sf_dir):
    return rounded(kernel.loo_risk(src.kernel_pairs(spark, sf_dir), ["x", "z"], "y", H_GRID,
                                   ["c_custkey"]))


@query
def nw_local_linear(spark, sf_dir):
    rows = src.kernel_rows(spark, sf_dir)
    return rounded(kernel.predict_local_linear(rows, rows, ["x"], "y", H_PREDICT, ["s_suppkey"]),
                   5)


@query
def nw_metrics(spark, sf_dir):
    from verdara.plans.workflows import kernel_scores

    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("y"))
    split = prep.random_split(rows, ["s_suppkey"], 0.3, 42)
    return rounded(kernel_scores(split, "y", ["s_acctbal"], ["s_suppkey"],
                                 H_GRID)[0])


@query
def pairwise_sqdist(spark, sf_dir):
    rows = src.kernel_rows(spark, sf_dir)
    return rounded(kernel.total_square_distance(rows, ["x", "y"], ["s_suppkey"]), 4)


# --- trees ----------------------------------------------------------------

@query
def rf_importance(spark, sf_dir):
    return rounded(trees.importance_by_target(
        src.stored(src.order_level(spark, sf_dir)), ["sum_price"], REGRESSORS, **SMALL_TREES))


@query
def importance_long(spark, sf_dir):
    return rounded(trees.importance_by_target(
        src.stored(src.order_level(spark, sf_dir)), ["sum_price", "sum_charge"], REGRESSORS,
        n_estimators=5, max_depth=4))


@query
def gbt_split_counts(spark, sf_dir):
    orders = src.stored(src.order_level(spark, sf_dir))
    model = trees.fit(orders, "sum_price", REGRESSORS,
                      trees.boosted("sum_price", n_estimators=5, max_depth=3))
    path = src.scratch_dir(spark) + "/gbt"
    model.stages[-1].write().overwrite().save(path)
    return trees.split_counts(path, REGRESSORS, spark)


@query
def rf_min_split(spark, sf_dir):
    return rounded(trees.importance_by_target(
        src.stored(src.order_level(spark, sf_dir)), ["sum_price"], REGRESSORS, min_samples_split=20,
        **SMALL_TREES))


@query
def rf_search(spark, sf_dir):
    grid = {"n_estimators": [3, 5], "max_depth": [3, 5], "min_samples_leaf": [1, 5]}
    return rounded(trees.random_search(src.stored(src.order_level(spark, sf_dir)), "sum_price", REGRESSORS,
                                       "l_orderkey", "forest", grid, draws=3)[1])


@query
def gbt_search(spark, sf_dir):
    grid = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.1, 0.2]}
    return rounded(trees.random_search(src.stored(src.order_level(spark, sf_dir)), "sum_price", REGRESSORS,
                                       "l_orderkey", "boosted", grid, draws=2)[1])


# --- scores and metric tables ---------------------------------------------

@query
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(src.scored_lines(spark, sf_dir), "price",
                                              "price_hat", ["model", "set"]), 4)


@query
def residuals(spark, sf_dir):
    return rounded(metrics.residuals(src.scored_lines(spark, sf_dir), "price", "price_hat",
                                     ["l_orderkey", "l_linenumber", "set"]), 4)


@query
def scatter_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "cover", points.cover_type(F.col("l_returnflag"), {"A": "Grass", "N": "Young crop"}))
    return rounded(describe.scatter_pairs(
        lines, ["l_orderkey", "l_linenumber", "cover"], ["l_extendedprice", "l_quantity"],
        ["l_discount", "l_tax"]))


@query
def metric_by_model(spark, sf_dir):
    return rounded(metrics.metric_by_model(src.metric_rows(spark, sf_dir), "MAE"), 4)


@query
def gather_metrics(spark, sf_dir):
    from verdara.plans.workflows import write_metric_files

    base = src.scratch_dir(spark)
    folders = {m: f"artifacts_{m}" for m in ("A", "N", "R", "absent")}
    write_metric_files(src.metric_rows(spark, sf_dir), base, folders)
    return rounded(metric_files.gather(spark, base, ["price", "net"], folders), 4)


@query
def metrics_table(spark, sf_dir):
    return rounded(metrics.metrics_table(src.metric_rows(spark, sf_dir)), 2)


@query
def metrics_latex_rows(spark, sf_dir):
    path = src.scratch_dir(spark) + "/table"
    tables.write_lines(metrics.table_lines(metrics.metrics_table(src.metric_rows(spark, sf_dir))),
                       "line", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def mean_metrics(spark, sf_dir):
    return rounded(metrics.mean_metrics(metrics.metrics_table(src.metric_rows(spark, sf_dir))), 2)


@query
def best_model(spark, sf_dir):
    return rounded(metrics.best_model(metrics.metrics_table(src.metric_rows(spark, sf_dir))), 2)


# --- saved models ---------------------------------------------------------

@query
def model_roundtrip(spark, sf_dir):
    registry = models.ModelRegistry(spark, src.scratch_dir(spark))
    registry.save(_line_model(spark, sf_dir, "ols"), "l_extendedprice", "l_extendedprice")
    scored = linear.predict(registry.load("l_extendedprice"), table(spark, sf_dir, "lineitem"))
    return rounded(scored.select("l_orderkey", "l_linenumber", "prediction"), 3)


@query
def latest_model(spark, sf_dir):
    registry = models.ModelRegistry(spark, src.scratch_dir(spark))
    for kind in ("ridge", "ols"):
        registry.save(_line_model(spark, sf_dir, kind), f"{kind} l_extendedprice",
                      "l_extendedprice")
    newest = models.latest_model(registry.entries(), "L_EXTENDED")
    return newest.select("target", F.element_at(F.split("path", "/"), -1).alias("name"))
