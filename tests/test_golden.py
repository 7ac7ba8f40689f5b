"""Published model quality on the two public field tables.

The tables are not part of this repository.  Point VERDARA_GOLDEN_DIR to a folder with
``grass.csv`` and ``citrus.csv`` (columns as in FEATURES below) to run these tests.
"""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdara.operators import correlate, kernel, linear, prep, trees
from verdara.plans import workflows
from verdara.sources import tables

FOLDER = os.environ.get("VERDARA_GOLDEN_DIR", "")
pytestmark = pytest.mark.skipif(not FOLDER, reason="VERDARA_GOLDEN_DIR is not set")

# Features, validation rows (seed 42, 30 %), published scores.
FEATURES = {
    "citrus": ["Sigma0_RATIO_VH_VV", "Gamma0_RATIO_VH_VV"],
    "grass": ["Sigma0_RATIO_VH_VV", "Gamma0_RATIO_VH_VV", "PC4", "Alpha"],
}
VALIDATION = {
    "citrus": """O1-1 O1-9 O2-9 Y1-1 Y1-17 Y2-1 Y2-25 Y1-14 Y2-7 O1-5 O1-7 O1-19 O2-21 Y1-4 Y1-12
        Y1-22 Y2-4 O1-18 O2-4 Y2-24 O1-3 O1-15 O1-20 O2-10 O2-15 Y1-2 Y1-16 Y2-16 O1-2 O2-6""",
    "grass": """G1-9 G2-9 O1-1 O1-13 O1-17 O2-1 O2-13 O2-25 O2-9 Y1-17 Y2-13 Y2-17 Y2-9 G1-5 G1-7
        G1-14 G2-7 Y1-14 Y2-5 O1-7 O2-5 O2-7 G1-22 G2-4 G2-18 G2-22 Y1-18 Y2-8 Y2-18 O1-12 O2-4
        O2-8 Y1-24 Y2-20 O1-3 O2-20 G2-11 G2-16 Y1-6 Y1-11 O1-6 O1-11 O1-16 O2-2 O2-6""",
}
# (table, target): RMSE, MAE, R2, rRMSE(%) as (train, val)
RIDGE = {
    ("citrus", "tree_height"): ((0.831635, 0.924995), (0.71632, 0.776349),
                                (0.155394, 0.0891966), (30.1228, 33.1574)),
    ("citrus", "canopy_diam"): ((0.788353, 1.0131), (0.648386, 0.774998),
                                (0.0984506, 0.162149), (23.1504, 29.9684)),
    ("citrus", "biomasa_total_m3_kg"): ((16.9159, 19.2626), (13.9974, 16.3143),
                                        (0.143984, 0.130517), (71.2122, 77.2339)),
    ("grass", "VWC"): ((97.2385, 98.5657), (75.776, 83.3014), (0.247344, 0.0940957),
                       (42.6466, 48.9299)),
    ("grass", "total_biomass"): ((388.954, 394.263), (303.104, 333.206), (0.247344, 0.0940957),
                                 (42.6466, 48.9299)),
    ("grass", "IBA"): ((1406.49, 1088.02), (952.463, 828.322), (0.363718, -0.188902),
                       (61.4697, 62.4778)),
}
KERNEL = {
    ("citrus", "tree_height"): ((0.382758, 0.444201), (0.306964, 0.323655),
                                (0.821089, 0.789959), (13.8639, 15.9228)),
    ("citrus", "canopy_diam"): ((0.473557, 0.952806), (0.381429, 0.633418),
                                (0.674693, 0.258917), (13.9063, 28.1847)),
    ("citrus", "biomasa_total_m3_kg"): ((8.57333, 11.8182), (6.20882, 8.45972),
                                        (0.780118, 0.672709), (36.0918, 47.3854)),
    ("grass", "VWC"): ((82.725, 91.2527), (62.5211, 78.8681), (0.455256, 0.223534),
                       (36.2812, 45.2996)),
    ("grass", "total_biomass"): ((330.9, 365.011), (250.084, 315.472), (0.455256, 0.223534),
                                 (36.2812, 45.2996)),
    ("grass", "IBA"): ((1375.7, 974.163), (854.981, 756.484), (0.391274, 0.0469039),
                       (60.1239, 55.9398)),
}
BANDWIDTH = {
    ("citrus", "tree_height"): (0.10985411419875583, 0.4609596881085864),
    ("citrus", "canopy_diam"): (0.13257113655901082, 0.5480601292070707),
    ("citrus", "biomasa_total_m3_kg"): (0.13257113655901082, 9.886880791218138),
    ("grass", "VWC"): (0.5963623316594643, 97.79758637151241),
    ("grass", "total_biomass"): (0.5963623316594643, 391.1903454860497),
    ("grass", "IBA"): (1.0481131341546852, 1516.9489596779367),
}
COEFFICIENTS = {
    ("citrus", "tree_height"): (0.352608, 0.116803),
    ("citrus", "canopy_diam"): (0.220271, 0.175691),
    ("citrus", "biomasa_total_m3_kg"): (6.81363, 2.50666),
    ("grass", "VWC"): (-55.1712, 30.0843, 12.0234, 8.4156),
    ("grass", "total_biomass"): (-220.685, 120.337, 48.0936, 33.6624),
    ("grass", "IBA"): (-660.373, 1368.91, 644.626, -15.4743),
}
FOREST_VAL_RMSE = {("citrus", "tree_height"): 0.504207, ("grass", "VWC"): 83.0847}
SPEARMAN_CITRUS = {
    ("tree_height", "Sigma0_RATIO_VH_VV"): 0.5367813403,
    ("tree_height", "Gamma0_RATIO_VH_VV"): 0.5018032129,
    ("canopy_diam", "Sigma0_RATIO_VH_VV"): 0.4646024602,
    ("canopy_diam", "Gamma0_RATIO_VH_VV"): 0.5154155416,
}
PEARSON_GRASS = {("VWC", "Sigma0_RATIO_VH_VV"): -0.4252042810, ("VWC", "PC4"): -0.4037680520,
                 ("IBA", "Gamma0_RATIO_VH_VV"): 0.5429179800, ("IBA", "Alpha"): 0.0660793493}
NAMES = ("RMSE", "MAE", "R2", "rRMSE(%)")


@pytest.fixture(scope="module")
def split(spark):
    def load(name):
        df = tables.read_csv(spark, f"{FOLDER}/{name}.csv")
        return df.withColumn("split", F.when(
            F.col("id_point").isin(VALIDATION[name].split()), "val").otherwise("train")).cache()
    return {name: load(name) for name in FEATURES}


def check(scores, want):
    got = {(r["metric"], r["set"]): r["value"] for r in scores.collect()}
    for name, pair in zip(NAMES, want):
        assert (got[(name, "train")], got[(name, "val")]) == pytest.approx(pair, rel=1e-5)


@pytest.mark.parametrize("key", list(RIDGE), ids="-".join)
def test_ridge(split, key):
    name, target = key
    check(workflows.linear_scores(split[name], [target], FEATURES[name]), RIDGE[key])
    model = linear.fit(split[name].where("split = 'train'"), target, FEATURES[name])
    assert tuple(model.stages[-1].coefficients) == pytest.approx(COEFFICIENTS[key], rel=1e-5)


@pytest.mark.parametrize("key", list(KERNEL), ids="-".join)
def test_kernel(split, key):
    name, target = key
    scores, risk, model = workflows.kernel_scores(
        split[name], target, FEATURES[name], ["id_point"], np.logspace(-3, 1, 50).tolist())
    best = kernel.best_bandwidth(risk).first()
    assert (best["h"], best["rmse_loo"]) == pytest.approx(BANDWIDTH[key], rel=1e-10)
    check(scores, KERNEL[key])


def test_correlations_select_the_published_features(split):
    got = {(r["target"], r["feature"]): r["r"] for r in correlate.spearman(
        split["citrus"], ["tree_height", "canopy_diam"], FEATURES["citrus"]).collect()}
    assert got == pytest.approx(SPEARMAN_CITRUS, abs=1e-9)
    corr = correlate.pearson(split["grass"], ["VWC", "total_biomass", "IBA"], FEATURES["grass"])
    values = {(r["target"], r["feature"]): r["r"] for r in corr.collect()}
    assert {k: values[k] for k in PEARSON_GRASS} == pytest.approx(PEARSON_GRASS, abs=1e-9)
    chosen = {r[0] for r in correlate.select_features(corr, 0.4, ["Alpha"]).collect()}
    assert chosen == set(FEATURES["grass"])


@pytest.mark.parametrize("key", list(FOREST_VAL_RMSE), ids="-".join)
def test_forest_quality(split, key):
    """Another random generator, so only the quality is comparable."""
    name, target = key
    train = split[name].where("split = 'train'")
    model = trees.fit(train, target, FEATURES[name], trees.forest(
        target, n_estimators=100, max_depth=8, min_samples_leaf=3))
    scored = linear.predict(model, split[name]).where("split = 'val'")
    err = (F.col(target) - F.col("prediction")) ** 2
    assert scored.agg(F.sqrt(F.avg(err))).first()[0] < 1.15 * FOREST_VAL_RMSE[key]


def test_split_size(split):
    assert {n: prep.random_split(df.drop("split"), ["id_point"]).where("split = 'val'").count()
            for n, df in split.items()} == {"citrus": 30, "grass": 45}
