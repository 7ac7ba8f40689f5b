import math

import numpy as np
import pandas as pd
import pytest

from verdara.operators import boxcox, correlate, describe, ordered, pca, prep


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[.7, .29, .01]),
        "x": rng.normal(size=n).round(1), "y": rng.exponential(size=n),
        "z": rng.integers(0, 4, n).astype(float)})
    pdf.loc[:150, "z"] = 2.0  # one value holds more than a third of the rows
    pdf["w"] = pdf["x"] * 2 + rng.normal(size=n)
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("per_bucket", [10, 2_000_000])
def test_describe_matches_pandas(table, per_bucket):
    df, pdf = table
    got = {(r["g"], r["var"]): r for r in
           describe.describe_by(df, ["g"], ["x", "y", "z"], per_bucket).collect()}
    want = pdf.groupby("g")[["x", "y", "z"]].describe()
    for g in "abc":
        for c in "xyz":
            r, w = got[(g, c)], want.loc[g, c]
            mine = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
            assert mine == pytest.approx(list(w), rel=1e-12, nan_ok=True)


def test_describe_nulls_and_single_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", float("nan"))], "g string, x double")
    got = {r["g"]: r for r in describe.describe_by(df.replace(float("nan"), None), ["g"], ["x"]).collect()}
    assert got["a"]["std"] is None and got["a"]["q50"] == 1.0
    assert got["b"]["count"] == 0 and got["b"]["q50"] is None


@pytest.mark.parametrize("per_bucket", [20, 2_000_000])
def test_box_stats(table, per_bucket):
    df, pdf = table
    for r in describe.box_stats(df, ["g"], ["y"], per_bucket).collect():
        v = pdf.loc[pdf.g == r["g"], "y"]
        a, c = v.quantile(.25), v.quantile(.75)
        ok = v.between(a - 1.5 * (c - a), c + 1.5 * (c - a))
        assert (r["whisker_low"], r["whisker_high"]) == (v[ok].min(), v[ok].max())
        assert r["n_outliers"] == (~ok).sum() and r["q50"] == pytest.approx(v.median())


@pytest.mark.parametrize("per_bucket", [25, 2_000_000])
def test_spearman_matches_pandas(table, per_bucket):
    df, pdf = table
    got = {(r["target"], r["feature"]): r["r"] for r in
           correlate.spearman(df, ["y", "w"], ["x", "z"], rows_per_bucket=per_bucket).collect()}
    want = pdf[["x", "y", "z", "w"]].corr("spearman")
    for (t, f), r in got.items():
        assert r == pytest.approx(want.loc[t, f], abs=1e-12)


def test_correlations_with_nulls_and_constants(spark, table):
    _, pdf = table
    pdf = pdf.copy()
    pdf.loc[::7, "x"] = np.nan
    pdf["k"] = 5.0
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    for method, fn in (("pearson", correlate.pearson), ("spearman", correlate.spearman)):
        got = {r["feature"]: r["r"] for r in fn(df, ["y"], ["x", "z", "k"]).collect()}
        assert got["x"] == pytest.approx(
            pdf[["y", "x"]].corr(method).loc["y", "x"], abs=1e-12)
        assert got["k"] is None
        gone = {r["feature"]: r["r"] for r in fn(df, ["y"], ["x", "z"], "propagate").collect()}
        assert gone["x"] is None and gone["z"] == pytest.approx(got["z"])
    matrix = correlate.correlation_matrix(df, ["x", "y"], "spearman")
    assert matrix.count() == 4 and matrix.where("target = feature AND abs(r - 1) < 1e-9").count() == 2
    with pytest.raises(ValueError):
        correlate.correlation_matrix(df, ["x"], "kendall")


def test_feature_selection(spark):
    corr = spark.createDataFrame([("t", "a", 0.4), ("t", "b", -0.41), ("t", "c", None),
                                  ("u", "a", 0.1), ("u", "c", 0.2)],
                                 "target string, feature string, r double")
    assert {r[0] for r in correlate.select_features(corr).collect()} == {"b"}
    assert {r[0] for r in correlate.select_features(corr, forced=["b", "Alpha"]).collect()} == {
        "b", "Alpha"}
    wide = correlate.correlation_wide(corr, ["a", "b", "c"])
    assert wide.columns == ["target", "a", "b", "c"] and wide.count() == 2


def _loglik(x, lam):
    y = np.log(x) if abs(lam) < 1e-12 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * math.log(y.var())


def test_boxcox_is_the_maximum(spark, table):
    df, pdf = table
    lambdas = boxcox.fit_lambdas(df, ["y", "x"])
    for c, (lam, shift) in lambdas.items():
        x = pdf[c].to_numpy()
        assert shift == (0 if x.min() > 0 else pytest.approx(abs(x.min()) + 1e-6))
        x = x + shift
        best = _loglik(x, lam)
        assert best >= max(_loglik(x, v) for v in np.arange(-2, 2.001, 0.005)) - 1e-9
        assert abs(lam * 1e4 - round(lam * 1e4)) < 1e-6
    out = boxcox.transform(df, lambdas).orderBy("id").toPandas()
    y = pdf["y"].to_numpy()
    assert out["y"].to_numpy() == pytest.approx((y ** lambdas["y"].lam - 1) / lambdas["y"].lam, rel=1e-9)
    # another table is moved by the shift of the fit, not by its own least value
    part = boxcox.transform(df.where("id < 10"), lambdas).orderBy("id").toPandas()
    assert part["x"].to_numpy() == pytest.approx(out["x"].to_numpy()[:len(part)])
    few = spark.createDataFrame([(None,), (3.0,), (3.0,)], "c double")
    assert boxcox.fit_lambdas(few, ["c"]) == {"c": None}


def test_boxcox_moves_beyond_the_grid(spark):
    rng = np.random.default_rng(1)
    x = (10 + rng.normal(size=400)) ** 0.25
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert boxcox.fit_lambdas(df, ["x"])["x"].lam > 2
    rising = df.selectExpr("exp(-exp(-20 * (x - 1.7))) + 1e9 AS x")
    with pytest.raises(ValueError):
        boxcox.fit_lambdas(rising, ["x"])


def test_pca_matches_svd(table):
    df, pdf = table
    cols = ["x", "y", "z", "w"]
    fitted = pca.fit(df, cols)
    z = ((pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)).to_numpy()
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(4), abs(vt).argmax(1)])[:, None]
    assert np.array(fitted.loadings) == pytest.approx(vt.T, abs=1e-9)
    assert fitted.ratio == pytest.approx(s ** 2 / (s ** 2).sum())
    scores = fitted.scores(df).orderBy("id").select(*fitted.names).toPandas().to_numpy()
    assert scores == pytest.approx(z @ vt.T, abs=1e-9)
    load = np.array(fitted.loadings)
    assert load.T @ load == pytest.approx(np.eye(4), abs=1e-9)
    assert pca.variance(fitted, df.sparkSession).orderBy("pc").collect()[-1]["cum"] == pytest.approx(100)
    assert pca.loadings(fitted, df.sparkSession).count() == 16


def test_split_is_exact_disjoint_and_stable(spark):
    df = spark.range(1000).repartition(7)
    out = prep.random_split(df, ["id"], 0.3, 42)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 300}
    again = prep.random_split(df.repartition(3), ["id"], 0.3, 42)
    assert out.exceptAll(again).count() == 0
    assert prep.random_split(df.limit(7), ["id"], 0.5, 1).where("split = 'val'").count() == 4
    assert prep.random_split(df, ["id"], 0.0).where("split = 'val'").count() == 0
    other = prep.random_split(df, ["id"], 0.3, 43)
    assert out.exceptAll(other).count() > 0


@pytest.mark.parametrize("n,sizes", [(10, [2] * 5), (13, [3, 3, 3, 2, 2])])
def test_contiguous_folds(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "k")
    rows = prep.contiguous_folds(df, "k").orderBy("k").collect()
    folds = [r["fold"] for r in rows]
    assert folds == sorted(folds) and [folds.count(i) for i in range(5)] == sizes


def test_folds_of_text_and_large_ids(spark):
    text = spark.createDataFrame([(f"G{i}-1",) for i in range(11)] + [(None,)], "k string")
    got = {r["k"]: r["fold"] for r in prep.contiguous_folds(text, "k", 3).collect()}
    order = sorted(f"G{i}-1" for i in range(11))
    assert [got[k] for k in order] == [0] * 4 + [1] * 4 + [2] * 3 and got[None] == 0
    large = spark.createDataFrame([(2 ** 62 + i,) for i in range(4)], "k bigint")
    assert [r["fold"] for r in prep.contiguous_folds(large, "k", 2).orderBy("k").collect()] == [0, 0, 1, 1]


def test_values_at_ranks_over_many_parts(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v")
    assert ordered.values_at_ranks(df, "v", [1, 250, 251, 1000], 90) == [0, 249, 250, 999]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (4.0, 5.0), (float("nan"), 5.0), (10.0, 5.0)],
                               "a double, b double")
    fitted = prep.fit_scaling(df, ["a", "b"])
    assert fitted.median == {"a": 4.0, "b": 5.0} and fitted.std["b"] == 1.0
    filled = np.array([1, 4, 4, 4, 10.0])
    assert fitted.mean["a"] == pytest.approx(filled.mean())
    z = [r["a"] for r in fitted.standardise(df).collect()]
    assert z == pytest.approx((filled - filled.mean()) / filled.std())
    assert prep.select_xy(df, ["b"]).columns == ["a", "b"]


def test_quantiles_over_many_buckets(spark):
    rng = np.random.default_rng(9)
    v = np.r_[rng.normal(size=999), np.full(500, 0.25)]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    row = ordered.group_quantiles(df, [], ["v"], [0.0, 0.1, 0.5, 0.9, 1.0], 50).first()
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(
        np.quantile(v, [0.0, 0.1, 0.5, 0.9, 1.0]))


def test_quantiles_do_not_depend_on_the_buckets(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.normal(size=900), np.exp(rng.normal(size=300) * 6)]
    rows = [(float(x), None if i % 3 == 0 else f"g{i % 3}") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows + [(None, "g1"), (float("nan"), "g1"), (None, "empty")],
                               "v double, g string")
    found = [sorted(map(tuple, ordered.group_quantiles(df, ["g"], ["v"], [0.25, 0.5], per).collect()),
                    key=str) for per in (10 ** 6, 900, 100, 7)]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 3
    by = {r[0]: r[2:] for r in found[0]}
    for g in (None, "g1", "g2"):
        own = [x for x, k in rows if k == g]
        assert by[g] == pytest.approx(np.quantile(own, [0.25, 0.5]))


def test_null_groups_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 3.0), (None, 4.0), ("a", 1.0), ("a", None)],
                               "g string, v double")
    stats = {r["g"]: r for r in describe.describe_by(df, ["g"], ["v"]).collect()}
    assert (stats[None]["count"], stats[None]["mean"], stats[None]["max"]) == (2, 3.5, 4.0)
    assert (stats[None]["q25"], stats[None]["q50"], stats[None]["q75"]) == (3.25, 3.5, 3.75)
    box = {r["g"]: r for r in describe.box_stats(df, ["g"], ["v"]).collect()}
    assert box[None]["n_outliers"] == 0 and box[None]["whisker_high"] == 4.0 and box["a"]["q50"] == 1.0


def test_bootstrap_band_against_brute_force(spark):
    import datetime as dt
    import hashlib
    import math

    r = np.random.default_rng(9)
    rows = [(i, dt.date(2025, 1 + i % 2, 1 + i % 20), float(v) if i % 11 else None, "g" if i % 3 else None)
            for i, v in enumerate(r.gamma(2.0, size=600))]
    df = spark.createDataFrame(rows, "id long, day date, v double, g string").repartition(5)
    got = {(x["month"].month, x["g"]): x for x in describe.bootstrap_band(df, "day", "v", ["id"], ["g"], 100, seed=3).collect()}

    def weight(i, b):
        u = int(hashlib.md5(f"3:{i}:{b // 4}".encode()).hexdigest()[8 * (b % 4):8 * (b % 4) + 8], 16) / 2 ** 32
        k, p, total = 0, math.exp(-1), math.exp(-1)
        while u >= total and k < 11:
            k += 1
            p /= k
            total += p
        return k

    assert set(got) == {(1, "g"), (2, "g"), (1, None), (2, None)}
    for (month, g), x in got.items():
        own = [(i, v) for i, d, v, h in rows if d.month == month and h == g and v is not None]
        means = []
        for b in range(100):
            w = np.array([weight(i, b) for i, _ in own])
            means.append((w @ np.array([v for _, v in own])) / w.sum())
        low, high = np.quantile(means, [0.025, 0.975])
        assert (x["n"], x["low"], x["high"]) == (len(own), pytest.approx(low), pytest.approx(high))
        half = 1.96 * np.std([v for _, v in own], ddof=1) / np.sqrt(len(own))
        assert x["mean"] - 2 * half < x["low"] < x["mean"] < x["high"] < x["mean"] + 2 * half
    with pytest.raises(ValueError):
        describe.bootstrap_band(df, "day", "v", ["id"], resamples=30)
