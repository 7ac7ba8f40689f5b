import pytest


from verdara.operators import linear, raster
from verdara.plans import workflows
from verdara.sources import tables

INT = {1: "Sigma0_IW1_VH_mst_19Feb2025", 2: "Sigma0_VV_19Feb2025", 3: "Sigma0_VH_08Apr2025",
       4: "Sigma0_VV_08Apr2025", 5: "Gamma0_VH_19Feb2025", 6: "Gamma0_VV_19Feb2025",
       7: "unreadable", 9: "Sigma0_VH_26May2025"}
SCHEMA = "raster string, row int, col int, band int, value float"
NAN, INF = float("nan"), float("inf")


def cells(col, values, raster_id="A", row=0):
    return [(raster_id, row, col, b + 1, float(v)) for b, v in enumerate(values)]


@pytest.fixture(scope="module")
def pix(spark):
    rows = (cells(0, [1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 0.0, 0.0, 8.0])
            + cells(1, [-9999.0] * 9) + cells(2, [-9999.0, 2.0, 3.0, 4.0, 5.0, 10.0, 0, 0, 8.0])
            + cells(3, [1.0, NAN, 3.0, 4.0, 5.0, 10.0, 0.0, 0.0, 8.0])
            + cells(4, [1.0, 2.0, 3.0, 4.0, INF, 10.0, 0.0, 0.0, 8.0])
            + cells(5, [1.0, 0.0, 3.0, 4.0, 5.0, 10.0, 0.0, 0.0, 8.0])
            + cells(6, [0.0, 0.0, 3.0, 4.0, 5.0, 10.0, 0.0, 0.0, 8.0], row=1))
    return spark.createDataFrame(rows, SCHEMA)


def by_col(df, *names):
    return {r["col"]: tuple(r[n] for n in names) for r in df.collect()}


def test_valid_pixels(pix):
    def kept(df):
        return {r["col"] for r in df.collect()}
    assert kept(raster.valid_pixels(pix, -9999.0)) == {0, 2, 5, 6}
    assert kept(raster.valid_pixels(pix, -9999.0, "any")) == {0, 5, 6}
    assert kept(raster.valid_pixels(pix)) == {0, 1, 2, 5, 6}
    with pytest.raises(ValueError):
        raster.valid_pixels(pix, 0.0, "some")


def test_features_mean_of_ratios_and_ratio_of_means(pix):
    stack = raster.stack_pixels({"intensity": pix, "dprvi": None})
    feats = ["Sigma0_VH", "sigma0_ratio_vh_vv", "Sigma0_SUM_VHVV", "Gamma0_VV"]
    got = by_col(raster.pixel_features(stack, {"intensity": INT}, feats,
                                       {"intensity": -9999.0}), *feats)
    # the ratio uses the two common dates, the mean of VH all three; x/0 drops pixel 5
    assert set(got) == {0, 2, 6}
    assert got[0] == pytest.approx((4.0, (0.5 + 0.75) / 2, 5.0, 10.0))
    assert got[6][1] == pytest.approx(0.75), "0/0 is skipped"
    rom = by_col(raster.ratio_of_means(pix, INT, nodata=-9999.0), "Sigma0_RATIO_VH_VV")
    assert rom[0][0] == pytest.approx(4.0 / 3.0)


def test_features_from_other_stacks_and_errors(spark, pix):
    other = spark.createDataFrame(cells(0, [1.0, 3.0]) + cells(5, [NAN, 3.0]), SCHEMA)
    bands = {"intensity": INT, "dprvi": {1: "dpRVI_19Feb2025", 2: "dprvi"},
             "haalpha": {1: "Alpha_slv_19Feb2025", 2: "Entropy_slv_19Feb2025"}}
    stack = raster.stack_pixels({"intensity": pix, "dprvi": other, "haalpha": other})
    got = by_col(raster.pixel_features(stack, bands, ["dpRVI", "Alpha", "entropy"]),
                 "dpRVI", "Alpha", "entropy")
    assert got[0] == (2.0, 1.0, 3.0) and 5 not in got
    with pytest.raises(ValueError, match="unknown feature"):
        raster.pixel_features(stack, bands, ["NDVI"])
    with pytest.raises(ValueError, match="cannot be built"):
        raster.pixel_features(stack, {"intensity": INT}, ["Anisotropy"])
    with pytest.raises(ValueError, match="no raster stack"):
        raster.stack_pixels({"intensity": None})
    with pytest.raises(ValueError, match="no valid pixel"):
        raster.has_valid_pixel(raster.valid_pixels(pix.where("col = 1"), -9999.0))


def test_features_use_one_shuffle(pix):
    stack = raster.stack_pixels({"intensity": pix})
    plan = raster.pixel_features(stack, {"intensity": INT}, ["Sigma0_VH", "Sigma0_RATIO_VH_VV"]) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_point_sampling(spark, pix):
    meta = spark.createDataFrame([("A", 100.0, 50.0, 10.0, 10.0)],
                                 "raster string, x0 double, y0 double, dx double, dy double")
    points = spark.createDataFrame(
        [("in", "A", 105.0, 45.0), ("edge", "A", 120.0, 50.0), ("left", "A", 99.9, 45.0),
         ("below", "A", 105.0, 0.0), ("unknown", "Z", 105.0, 45.0)],
        "id_point string, id_parcel string, long double, lat double")
    out = raster.sample_points(points, pix, meta, {1: "a", 2: "b"}, ["id_point"])
    got = {r["id_point"]: (r["a"], r["b"]) for r in out.collect()}
    assert got == {"in": (1.0, 2.0), "edge": (-9999.0, 2.0), "left": (None, None),
                   "below": (None, None), "unknown": (None, None)}


def test_extract_wide_table(spark, pix):
    meta = spark.createDataFrame([("A", 100.0, 50.0, 10.0, 10.0)],
                                 "raster string, x0 double, y0 double, dx double, dy double")
    points = spark.createDataFrame([("p", "A", 105.0, 45.0)],
                                   "id_point string, id_parcel string, long double, lat double")
    names = {1: "Sigma0_VH_19Feb2025", 2: "Sigma0_VV_19Feb2025"}
    out = workflows.extract_wide_table(
        points, {"intensity": (pix, names), "haalpha": (pix, {3: "Alpha_19Feb2025"})}, meta,
        "id_point", "id_parcel", "long", "lat").first()
    assert out["Sigma0_RATIO_VH_VV_19Feb2025"] == 0.5 and out["Alpha_19Feb2025"] == 3.0


def test_band_names_and_catalogue(spark, pix):
    names = {r["band"]: r["band_name"] for r in raster.name_bands(pix, INT).collect()}
    assert names[1] == INT[1] and names[8] == "Banda 08"
    mapped = {(r["band"], r["prod"], r["pol"]) for r in
              raster.mapped_intensity_bands(pix, INT).collect()}
    assert (5, "Gamma0", "VH") in mapped and not any(b in (7, 8) for b, _, _ in mapped)
    row = raster.raster_catalogue(pix).first()
    assert (row["n_rows"], row["n_cols"], row["n_bands"]) == (2, 7, 9)
    assert raster.scan_parcels(pix, ["B"]).isEmpty()
    mean = by_col(raster.temporal_mean(pix, [1, 2]), "mean")
    assert mean[0] == (1.5,) and mean[3] == (1.0,)


def test_map_prediction_and_frame(spark, pix, tmp_path):
    train = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 7.0)], "Sigma0_VH double, t double")
    model = linear.fit(train, "t", ["Sigma0_VH"], "ols")
    out = workflows.map_from_features({"intensity": pix}, {"intensity": INT}, ["Sigma0_VH"], model,
                                      {"intensity": -9999.0})
    assert dict(out.dtypes)["pred"] == "float" and out.count() == 7
    got = by_col(out, "pred")
    assert got[0][0] == pytest.approx(7.0) and got[1][0] == -9999.0 and got[3][0] == -9999.0
    assert tables.write_prediction(out, str(tmp_path / "p")) == 4
    with pytest.raises(ValueError, match="no valid pixel"):
        tables.write_prediction(out.where("col = 1"), str(tmp_path / "q"))
    full = raster.full_frame(out, raster.raster_catalogue(pix))
    assert full.count() == 14 and full.where("pred = -9999").count() == 10
    two = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, 3.0, 1.0), (4.0, 7.0, 5.0), (3.0, 1.0, 9.0)],
                                "Sigma0_RATIO_VH_VV double, Gamma0_RATIO_VH_VV double, t double")
    ratio = linear.fit(two, "t", ["Sigma0_RATIO_VH_VV", "Gamma0_RATIO_VH_VV"], "ols")
    assert workflows.map_from_ratios(pix, INT, ratio, -9999.0).where("pred <> -9999").count() == 4
