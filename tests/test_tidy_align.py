import datetime as dt
import random

import pytest


from verdara.operators import align, crosspol, tidy
from verdara.operators.spread import hot_keys, join_lookup, salt_lookup, salt_rows
from verdara.plans.workflows import align_wide
from verdara.sources import tables

D = dt.date


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(
        [(" g1-1 ", 1.0, 2.0, 3.0, None, 9.0), ("G1-2", None, 5.0, None, 7.0, 9.0),
         ("G1-3", None, None, None, None, 9.0)],
        "id_point string, Sigma0_VH_19Feb2025 double, Sigma0_VH_08Abr2025 double,"
        "dpRVI_2025_02_19 double, dpRVI_08042025 double, nodate double")


def test_tidy_long_and_wide(wide):
    long = {(r["id_point"], r["var_base"], r["date"]): r["val"]
            for r in tidy.tidy_long(wide, "id_point", drop_null=True).collect()}
    assert long[("G1-2", "dpRVI", D(2025, 4, 8))] == 7.0 and len(long) == 5
    rows = {(r["id_point"], r["date"]): (r["Sigma0_VH"], r["dpRVI"])
            for r in tidy.tidy_wide(wide, "id_point").collect()}
    assert rows == {(" g1-1 ", D(2025, 2, 19)): (1.0, 3.0), (" g1-1 ", D(2025, 4, 8)): (2.0, None),
                    ("G1-2", D(2025, 4, 8)): (5.0, 7.0)}
    same = tidy.tidy_wide(wide, "id_point", unique_points=True).collect()
    assert sorted(map(str, same)) == sorted(map(str, tidy.tidy_wide(wide, "id_point").collect()))


def test_tidy_wide_needs_no_shuffle_for_unique_points(wide):
    plan = tidy.tidy_wide(wide, "id_point", unique_points=True)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_tidy_then_widen_is_identity(wide):
    days = [D(2025, 2, 19), D(2025, 4, 8)]
    back = tidy.widen(tidy.tidy_wide(wide, "id_point"), "id_point", ["Sigma0_VH", "dpRVI"], days)
    row = back.where("id_point = 'G1-2'").first()
    assert (row["Sigma0_VH_08Apr2025"], row["dpRVI_08Apr2025"], row["dpRVI_19Feb2025"]) == (
        5.0, 7.0, None)


def test_no_value_columns(spark):
    with pytest.raises(ValueError):
        tidy.tidy_wide(spark.createDataFrame([("a",)], "id_point string"), "id_point")


@pytest.fixture(scope="module")
def radar(spark):
    return spark.createDataFrame(
        [("P1", D(2025, 1, 10), 1.0, None), ("P1", D(2025, 1, 14), 2.0, 5.0),
         ("P1", D(2025, 1, 20), 3.0, 6.0), ("p2 ", D(2025, 1, 1), 4.0, 7.0)],
        "id_point string, date date, VV double, Alpha double")


@pytest.fixture(scope="module")
def field(spark):
    t = dt.datetime
    return spark.createDataFrame(
        [("p1", t(2025, 1, 10, 9, 30), 0), ("P1 ", t(2025, 1, 12), 1), ("P1", t(2025, 1, 15), 2),
         ("P1", t(2025, 1, 17), 3), ("P1", None, 4), ("P9", t(2025, 1, 10), 5),
         ("P2", t(2025, 1, 4), 6), ("P1", t(2025, 1, 10), 7)],
        "id_point string, datetime timestamp_ntz, k int")


@pytest.mark.parametrize("floor", [1, 10 ** 6])
def test_align_cases(field, radar, floor):
    """``floor=1`` makes every frequent key hot, so the salted path is exercised too."""
    rows = {r["k"]: r for r in align.align(field, radar, hot_floor=floor).collect()}
    assert len(rows) == 8
    assert (rows[0]["sar_date"], rows[0]["day_diff"], rows[0]["VV"]) == (D(2025, 1, 10), 0, 1.0)
    assert rows[1]["sar_date"] == D(2025, 1, 10), "equal distance takes the earlier date"
    assert (rows[2]["day_diff"], rows[2]["VV"]) == (-1, 2.0)
    assert rows[3]["sar_date"] is None and rows[4]["sar_date"] is None
    assert rows[5]["sar_date"] is None and rows[6]["sar_date"] is None
    assert rows[7]["VV"] == 1.0


def test_align_options_and_stats(field, radar):
    exact = align.align(field, radar, tolerance_days=None)
    assert {r["k"] for r in exact.where("sar_date IS NOT NULL").collect()} == {0, 7}
    wider = align.align(field, radar, tolerance_days=3)
    stats = [align.align_stats(x).first() for x in (exact, align.align(field, radar), wider)]
    assert [s["filled_nearest"] for s in stats] == [0, 2, 4]
    assert {s["n"] for s in stats} == {8}
    probe = align.align_stats(align.align(field, radar), "Alpha").first()
    assert (probe["unmatched_exact"], probe["filled_nearest"], probe["unmatched"]) == (8, 4, 4)
    kept = align.align(field, radar, keep=["Alpha", "absent"])
    assert kept.columns == ["id_point", "datetime", "k", "day", "sar_date", "day_diff", "Alpha"]
    only = align.align(field, radar, prefixes=["p2"], tolerance_days=3)
    assert [r["k"] for r in only.where("sar_date IS NOT NULL").collect()] == [6]


def test_align_text_dates_and_wide(spark, wide):
    field = spark.createDataFrame([("G1-1", "2025-02-20 10:00:00"), ("G1-1", "bad")],
                                  "Punto string, fecha string")
    with pytest.raises(ValueError):
        align.align(field, tidy.tidy_wide(wide, "id_point"))
    rows, stats = align_wide(field, wide, time_col="fecha")
    got = {r["fecha"]: r["sar_date"] for r in rows.collect()}
    assert got == {"2025-02-20 10:00:00": D(2025, 2, 19), "bad": None}
    assert stats.first()["unmatched"] == 1


def test_align_against_brute_force(spark):
    rng = random.Random(5)
    # one point holds a third of all rows
    points = ["HOT"] * 5 + [f"p{i}" for i in range(10)]
    base = D(2025, 3, 1)
    field = [(rng.choice(points), base + dt.timedelta(rng.randrange(20)), i) for i in range(400)]
    radar = {(rng.choice(points), base + dt.timedelta(rng.randrange(20))): float(i)
             for i in range(60)}
    f = spark.createDataFrame(field, "id_point string, day_in date, k int")
    r = spark.createDataFrame([(p, d, v) for (p, d), v in radar.items()],
                              "id_point string, date date, v double")
    got = {x["k"]: x["sar_date"] for x in align.align(
        f, r, "id_point", "day_in", "id_point", hot_floor=5).collect()}
    for p, d, k in field:
        near = sorted((abs((e - d).days), e) for q, e in radar if q.upper() == p.upper())
        assert got[k] == (near[0][1] if near and near[0][0] <= 2 else None)


def test_hot_keys_go_by_rows_not_by_share(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id < 25 THEN -1 ELSE id END AS k")
    hot = hot_keys(rows, ["k"], floor=10)  # less than 0.1 % of the rows
    assert [tuple(r) for r in hot.collect()] == [(-1, 3)]
    salted = salt_rows(rows.repartition(8), ["k"], hot)
    assert salted.where("k = -1").select("_salt").distinct().count() > 1
    assert salted.where("k <> -1 AND _salt <> 0").isEmpty()
    assert salt_lookup(rows.distinct(), ["k"], hot).where("k = -1").count() == 3


def test_columns_of_one_date_in_two_notations(spark):
    wide = spark.createDataFrame([("p", None, 5.0, 1.0), ("q", 2.0, 9.0, None)],
                                 "id string, VH_19Feb2025 double, VH_20250219 double, VV_19Feb2025 double")
    for unique in (True, False):
        got = {r["id"]: (r["VH"], r["VV"]) for r in
               tidy.tidy_wide(wide, "id", unique_points=unique).collect()}
        assert got == {"p": (5.0, 1.0), "q": (2.0, None)}


def test_ids_are_normalised_before_rows_are_tidied(spark):
    wide = spark.createDataFrame([("a1", 1.0, None), ("A1 ", None, 2.0)],
                                 "id string, VH_19Feb2025 double, VV_19Feb2025 double")
    field = spark.createDataFrame([("A1", "2025-02-19")], "id string, fecha string")
    for days in (2, None):
        rows, _ = align_wide(field, wide, "id", "fecha", "id", tolerance_days=days)
        assert [(r["VH"], r["VV"]) for r in rows.collect()] == [(1.0, 2.0)]


def test_join_lookup_spreads_copies_and_keeps_rows(spark):
    left = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3)] + [(None, 3)] * 20,
                                 "k string, v int").repartition(4)
    right = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
    out = join_lookup(left, right, ["k"], floor=10)
    assert out.count() == 72
    assert out.where("w = 10").count() == 50 and out.where("w IS NULL").count() == 21
    assert join_lookup(left, right, ["k"], how="inner", floor=10).count() == 51
    with pytest.raises(ValueError):
        join_lookup(left, right, ["k"], how="full")


def test_outer_merge_and_dates(spark, radar):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id_point string, a int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "id_point string, b int")
    got = {r["id_point"]: (r["a"], r["b"]) for r in align.outer_merge([a, b], ["id_point"]).collect()}
    assert got == {"x": (1, None), "y": (2, 3), "z": (None, 4)}
    row = align.dates_by_point(radar, "id_point").where("id_point = 'P1'").first()
    assert (row["n_dates"], row["first"], row["last"]) == (3, D(2025, 1, 10), D(2025, 1, 20))


def test_detect_columns(spark):
    assert align.detect_point_col(["x", "Punto de muestreo", " ID_POINT "]) == " ID_POINT "
    assert align.detect_point_col(["x", "my_point_name"]) == "my_point_name"
    assert align.detect_point_col(["x", "y"]) == "x"
    df = spark.createDataFrame([("a", "no date", "2025-01-02")],
                               "id string, date_note string, fecha string")
    assert align.detect_time_col(df) == "fecha"
    assert align.detect_time_col(df.select("id")) is None


def test_crosspol_wide_and_long(spark):
    wide = spark.createDataFrame(
        [("p", 0.2, 0.4, 0.3, 9.0), ("q", -0.2, 0.0, 0.3, 9.0)],
        "id_point string, Sigma0_IW1_VH_mst_19Feb2025 double, Sigma0_VV_19Feb2025 double,"
        "Gamma0_VH_19Feb2025 double, Sigma0_SUM_VHVV_19Feb2025 double")
    out = crosspol.crosspol_wide(wide, ["id_point"], in_db=False)
    assert out.columns == ["id_point", "Sigma0_RATIO_VH_VV_19Feb2025", "Sigma0_SUM_VHVV_19Feb2025"]
    rows = {r[0]: (r[1], r[2]) for r in out.collect()}
    assert rows["p"] == (0.5, pytest.approx(0.6)) and rows["q"] == (None, -0.2)
    as_db = crosspol.crosspol_wide(wide, ["id_point"], in_db=False, output_db=True)
    db = {r[0]: (r[1], r[2]) for r in as_db.collect()}
    assert db["q"] == (None, None) and db["p"][0] == pytest.approx(-3.0103, abs=1e-4)
    from_db = crosspol.crosspol_wide(wide, ["id_point"]).where("id_point = 'p'").first()
    assert from_db[1] == pytest.approx(10 ** -0.02)
    long = spark.createDataFrame([("a", "VH", 1.0), ("a", "VV", 2.0), ("b", "VH", 1.0)],
                                 "k string, pol string, val double")
    assert [tuple(r) for r in crosspol.crosspol_long(long, ["k"]).collect()] == [("a", 3.0, 0.5)]


def test_scale_db_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 100.0), ("b", 5.0)], "g string, x double")
    got = {(r["g"], r["x"]): r["scaled"] for r in crosspol.scale_db(df, ["g"], "x").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 100.0): 1.0, ("b", 5.0): None}
    both = crosspol.common_dates(
        spark.createDataFrame([(1, "VH"), (1, "VV"), (2, "VH")], "d int, p string"),
        ["d"], "p", "VH", "VV")
    assert [r["d"] for r in both.collect()] == [1]


def test_first_row_counts_in_the_order_of_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Sigma0_VH_19Feb2025,dpRVI_19Feb2025\np,,7.0\np,9.0,NaN\np,3.0,1.0\n")
    (tmp_path / "b.csv").write_text("id,Sigma0_VH_19Feb2025,dpRVI_19Feb2025\np,1.0,5.0\nq,NaN,\n")
    wide = tables.read_csv(spark, str(tmp_path / "*.csv"), position="_place")
    assert wide.where("dpRVI_19Feb2025 IS NULL").count() == 2
    rows = tidy.tidy_wide(wide, "id", order="_place").collect()
    assert [(r["id"], r["Sigma0_VH"], r["dpRVI"]) for r in rows] == [("p", 9.0, 7.0)]
    least = tidy.tidy_wide(wide.drop("_place"), "id").collect()
    assert [(r["id"], r["Sigma0_VH"], r["dpRVI"]) for r in least] == [("p", 1.0, 1.0)]


def test_an_earlier_column_comes_before_an_earlier_row(spark):
    wide = spark.createDataFrame([("p", 1, None, 5.0), ("p", 2, 8.0, 6.0)],
                                 "id string, n int, v_19Feb2025 double, v_20250219 double")
    assert [r["v"] for r in tidy.tidy_wide(wide, "id", order="n").collect()] == [8.0]


@pytest.mark.parametrize("tolerance", [None, 2])
def test_ids_in_two_notations_are_one_point(spark, tolerance):
    day = dt.date(2025, 2, 19)
    radar = spark.createDataFrame([("a1", day, 1.0, None), ("A1 ", day, None, 2.0)],
                                  "id_point string, date date, VH double, VV double")
    field = spark.createDataFrame([("A1", day, 5.0)], "id_point string, date date, y double")
    rows = align.align(field, radar, tolerance_days=tolerance).collect()
    assert [(r["y"], r["VH"], r["VV"]) for r in rows] == [(5.0, 1.0, 2.0)]
