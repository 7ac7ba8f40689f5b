import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdara.functions import dates, points, radar

TAGS = {
    "19Feb2025": dt.date(2025, 2, 19), "8Apr2025": dt.date(2025, 4, 8),
    "08Abr2025": dt.date(2025, 4, 8), "2025-02-19": dt.date(2025, 2, 19),
    "2025_02_19": dt.date(2025, 2, 19), "19_Feb_2025": dt.date(2025, 2, 19),
    "20250219": dt.date(2025, 2, 19), "08042025": dt.date(2025, 4, 8),
    "19feb2025": dt.date(2025, 2, 19), "02February2025": dt.date(2025, 2, 2),
    "Apr82025": None, "31Feb2025": None, "garbage": None, "": None, "2025": None,
    "20251340": None, "12Dic2024": dt.date(2024, 12, 12),
}


def test_tags_agree_on_driver_and_in_columns(spark):
    df = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    got = {r["tag"]: r["d"] for r in
           df.select("tag", dates.date_from_tag(F.col("tag")).alias("d")).collect()}
    assert got == TAGS
    assert {t: dates.tag_to_date(t) for t in TAGS} == TAGS


def test_null_tag_and_plain_parser(spark):
    df = spark.createDataFrame([(None,), ("19Feb2025",), ("20250219",), ("08Abr2025",)], "t string")
    rows = df.select(dates.date_from_tag(F.col("t")), dates.date_from_plain_tag(F.col("t"))).collect()
    day = dt.date(2025, 2, 19)
    assert [tuple(r) for r in rows] == [
        (None, None), (day, day), (day, day), (dt.date(2025, 4, 8), None)]
    assert dates.tag_to_date("08Abr2025", flexible=False) is None


@pytest.mark.parametrize("name,parts", [
    ("Sigma0_RATIO_VH_VV_19Feb2025", ("Sigma0_RATIO_VH_VV", "19Feb2025")),
    ("dpRVI_2025_02_19", ("dpRVI", "2025_02_19")), ("dpRVI_2025-02-19", ("dpRVI", "2025-02-19")),
    ("Alpha_19_Feb_2025", ("Alpha", "19_Feb_2025")), ("NoDate", ("NoDate", "")),
    ("a_b", ("a", "b")),
])
def test_split_name(spark, name, parts):
    assert dates.split_name(name) == parts
    row = spark.range(1).select(dates.split_name_col(F.lit(name)).alias("s")).first()["s"]
    assert (row["base"], row["tag"]) == parts


def test_cover_labels(spark):
    df = spark.createDataFrame([("G1-1",), ("Y2-3",), ("O1-2",), ("x",), (None,)], "p string")
    got = [r[0] for r in df.select(points.cover_type(F.col("p"))).collect()]
    assert got == ["Grass", "Young crop", "Old crop", "Unknown", "Unknown"]
    mature = [r[0] for r in df.select(points.cover_type(
        F.col("p"), points.COVER_LABELS_TREES)).collect()]
    assert mature == ["Unknown", "Young crop", "Mature crop", "Unknown", "Unknown"]


def test_db_round_trip_and_floor(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (-1.0,), (100.0,)], "x double")
    rows = df.select(radar.linear_to_db(F.col("x")).alias("db"),
                     radar.db_to_linear(radar.linear_to_db(F.col("x"))).alias("back"),
                     radar.floored_db(F.col("x")).alias("f")).collect()
    assert rows[1]["db"] is None and rows[2]["db"] is None
    assert rows[0]["back"] == pytest.approx(0.5) and rows[3]["db"] == pytest.approx(20)
    assert rows[1]["f"] == pytest.approx(-100)


def test_band_names(spark):
    names = ["Sigma0_IW1_VH_mst_19Feb2025", "gamma0_x_vv_20250408", "Sigma0_VH", "Alpha_slv_2025-06-19",
             "dpRVI_19Feb2025", "my dprvi", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(radar.intensity_parts(F.col("n")).alias("i"),
                     radar.decomposition_parts(F.col("n")).alias("h"),
                     radar.vegetation_index_date(F.col("n")).alias("v")).collect()
    assert tuple(rows[0]["i"]) == ("Sigma0", "VH", "19Feb2025")
    assert tuple(rows[1]["i"]) == ("gamma0", "VV", "20250408") and rows[2]["i"] is None
    assert tuple(rows[3]["h"]) == ("Alpha", "2025-06-19")
    assert [r["v"] for r in rows] == [None] * 4 + ["19Feb2025", "NA", None]
    assert radar.parse_intensity(names[1]) == ("Gamma0", "VV", "20250408")


def test_round_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,), (83.30144,)], "x double")
    assert [r[0] for r in df.select(radar.round_even(F.col("x"))).collect()] == [
        0.12, 0.38, 2.5, 83.3]
