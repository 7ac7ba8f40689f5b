"""The given tables in the shapes the operators work on.  All rows take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.sources.scratch import scratch_dir, stored  # noqa: F401

RADAR_VARS = ("click", "error", "signup", "view")
TAGS = ("19Feb2025", "15Mar2025", "08Apr2025", "26May2025", "19Jun2025")
INTENSITY_BANDS = {
    i + 1: f"{family}_{TAGS[i % 5]}"
    for i, family in enumerate(f for name in ("Sigma0_VH", "Sigma0_VV", "Gamma0_VH", "Gamma0_VV")
                               for f in [name] * 5)}
INDEX_BANDS = {21 + i: f"dpRVI_{t}" for i, t in enumerate(TAGS)}
DECOMPOSITION_BANDS = {
    26 + i: f"{family}_{TAGS[i % 5]}"
    for i, family in enumerate(f for name in ("Entropy", "Anisotropy", "Alpha")
                               for f in [name] * 5)}
STACK_BANDS = {"intensity": INTENSITY_BANDS, "dprvi": INDEX_BANDS,
               "haalpha": DECOMPOSITION_BANDS}
NODATA = -9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, value): purchases play the field measurements."""
    return (table(spark, sf_dir, "events").where("event_type = 'purchase'")
            .select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id", "value"))


def radar_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, var_base, date, val): daily means of all other event types."""
    return (table(spark, sf_dir, "events").where("event_type <> 'purchase'")
            .groupBy("user_id", F.col("event_type").alias("var_base"),
                     F.col("ts").cast("date").alias("date"))
            .agg(F.avg("value").alias("val"))
            .withColumn("user_id", F.col("user_id").cast("string")))


def radar_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdara.operators.tidy import pivot_tidy

    return pivot_tidy(radar_long(spark, sf_dir), "user_id", RADAR_VARS)


def radar_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, date, view): one radar variable only."""
    return (table(spark, sf_dir, "events").where("event_type = 'view'")
            .groupBy(F.col("user_id").cast("string").alias("user_id"),
                     F.col("ts").cast("date").alias("date"))
            .agg(F.avg("value").alias("view")))


def radar_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per point, one column per variable and acquisition date."""
    from verdara.operators.tidy import widen

    events = table(spark, sf_dir, "events")
    # acquisition dates are the calendar of a sensor: a short list
    days = sorted(r[0] for r in events.select(F.col("ts").cast("date")).distinct().collect())
    return widen(radar_tidy(spark, sf_dir), "user_id", RADAR_VARS, days)


def radar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, slot, variable_date…): up to three rows a point, with gaps, and a variable in two
    notations of its dates."""
    from verdara.operators.tidy import widen

    events = (table(spark, sf_dir, "events").where("event_type <> 'purchase'")
              .withColumn("user_id", F.col("user_id").cast("string"))
              .withColumn("slot", F.pmod("event_id", F.lit(3)).cast("int"))
              .withColumn("date", F.col("ts").cast("date")))
    days = sorted(r[0] for r in events.select("date").distinct().collect())
    tidy = (events.groupBy("user_id", "slot", "date").pivot("event_type", list(RADAR_VARS))
            .agg(F.avg("value")).withColumn("point", F.struct("user_id", "slot")))
    wide = widen(tidy, "point", RADAR_VARS, days)
    again = [F.col(f"click_{d:%d%b%Y}").alias(f"error_{d:%Y%m%d}") for d in days]
    return wide.select("point.user_id", "point.slot", *wide.columns[1:], *again)


def order_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, n_lines, sum_qty, avg_discount, sum_price, sum_charge): one row per order."""
    return (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_discount"), F.sum("l_extendedprice").alias("sum_price"),
        F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("sum_charge")))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raster, row, col, band, value): one pixel per embedding, one band per position."""
    return (table(spark, sf_dir, "embeddings")
            .select(F.concat(F.lit("R"), F.col("label")).alias("raster"),
                    F.floor(F.col("vec_id") / 25).cast("int").alias("row"),
                    F.pmod("vec_id", F.lit(25)).cast("int").alias("col"),
                    F.posexplode("embedding").alias("_pos", "value"))
            .select("raster", "row", "col", (F.col("_pos") + 1).alias("band"), "value"))


def masked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with raster R3 all nodata and some NaN cells, for the masks."""
    value = (F.when(F.col("raster") == "R3", F.lit(NODATA))
             .when((F.col("band") == 7) & (F.col("value") > 0.2), F.lit(float("nan")))
             .otherwise(F.col("value")))
    return pixels(spark, sf_dir).withColumn("value", value.cast("float"))


def stacked_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pixels with the stack each band belongs to; bands 41–64 carry no name."""
    band = F.col("band")
    return masked_pixels(spark, sf_dir).withColumn(
        "stack", F.when(band.between(21, 25), "dprvi").when(band.between(26, 40), "haalpha")
        .otherwise("intensity"))


def raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per raster: origin at the top left, pixels of 10 × 10."""
    from verdara.operators.raster import raster_catalogue

    return raster_catalogue(pixels(spark, sf_dir)).select(
        "raster", F.lit(500.0).alias("x0"), (F.col("n_rows") * 10.0).alias("y0"),
        F.lit(10.0).alias("dx"), F.lit(10.0).alias("dy"), F.lit(NODATA).alias("nodata"),
        F.lit("EPSG:32618").alias("crs"))


def sampling_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, id_parcel, x, y): some points lie outside, some parcels do not exist."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("R"), F.pmod("c_nationkey", F.lit(12))).alias("id_parcel"),
        (495.0 + F.pmod(key * 37, F.lit(265))).cast("double").alias("x"),
        F.pmod(key * 11, F.lit(210)).cast("double").alias("y"))


def kernel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, x, y): standardised balance and nation number of every supplier."""
    from verdara.operators.prep import fit_scaling

    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return fit_scaling(rows, ["x"]).standardise(rows)


def kernel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, x, z, y): standardised balance and nation of every customer; a twentieth of
    the targets is missing."""
    from verdara.operators.prep import fit_scaling

    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("z"),
        F.when(F.col("c_custkey") % 20 != 0, F.length("c_name") + F.col("c_custkey") % 7)
        .cast("double").alias("y"))
    return fit_scaling(rows, ["x", "z"]).standardise(rows)


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with model (return flag), set (line status), truth and estimate."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("val").alias("set"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") * 1000).alias("price_hat"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * 950).alias("net_hat"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, target, metric, set, value) of two targets over all line items."""
    from verdara.operators.metrics import metrics_long, regression_metrics

    rows = scored_lines(spark, sf_dir)
    parts = [metrics_long(regression_metrics(rows, t, f"{t}_hat", ["model", "set"])
                          .withColumn("target", F.lit(t)), ["model", "target", "set"])
             for t in ("price", "net")]
    return parts[0].unionByName(parts[1]).select("model", "target", "metric", "set", "value")
