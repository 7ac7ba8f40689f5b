import numpy as np
import pandas as pd
import pytest

from verdara.operators import kernel, lattice


def direct(q, x, y, h, local):
    gap = x[None] - q[:, None]
    w = np.exp(-0.5 * (gap ** 2).sum(-1) / h / h)
    if not local:
        return np.stack([w.sum(1), w @ y], axis=1)
    d = x.shape[1]
    z = [np.ones_like(w)] + [gap[:, :, k] for k in range(d)]
    return np.stack([(w * z[i] * z[j]).sum(1) for i in range(d + 1) for j in range(i, d + 1)]
                    + [(w * zi) @ y for zi in z], axis=1)


def frame(x, y, h):
    cells, n, m, t = lattice.fold(x, np.ones(len(x)), y, h)
    return pd.DataFrame({"cell": list(cells), "n": n, "m": list(m), "t": list(t)})


@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("h", [0.15, 0.7, 5.0])
@pytest.mark.parametrize("local", [False, True])
def test_sums_match_the_points(d, h, local):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, d)) * 1.3 + 0.2
    y, q = r.normal(size=700) + 3, r.normal(size=(300, d)) * 1.5
    names = ["a", "b"][:d]
    got, doubt = lattice.tile(pd.DataFrame(q, columns=names), frame(x, y, h), names, None, h, 700, local, 0.0)
    want = direct(q, x, y, h, local)
    good = ~doubt
    assert good.mean() > 0.9 or h < 0.2
    scale = np.abs(want[:, :1]) * np.maximum(1.0, h * h)
    assert np.abs(got - want)[good].max(axis=1) == pytest.approx(0, abs=1e-9)
    assert (np.abs(got - want)[good] / scale[good]).max() < 1e-10


def test_leave_one_out_takes_the_row_itself_away():
    r = np.random.default_rng(2)
    x, y, h = np.concatenate([r.normal(size=(400, 2)), [[30.0, 30.0]]]), r.normal(size=401), 0.5
    q = pd.DataFrame(x, columns=["a", "b"]).assign(y=y)
    got, doubt = lattice.tile(q, frame(x, y, h), ["a", "b"], "y", h, 401, False, 1e-12)
    w = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1) / h / h)
    np.fill_diagonal(w, 0)
    good = ~doubt
    yhat, want = (s[:, 1] / (s[:, 0] + 1e-12) for s in (got, np.stack([w.sum(1), w @ y], axis=1)))
    assert good.sum() > 390 and not doubt[400] and yhat[400] == 0
    assert yhat[good] == pytest.approx(want[good], rel=1e-10, abs=1e-12)


def test_far_rows_are_summed_over_points(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 2))
    y = x[:, 0] + 2 * x[:, 1]
    train = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                  "id long, a double, b double, y double").repartition(3)
    q = np.concatenate([x[:20], r.normal(size=(20, 2)) * 6, [[15.0, -9.0], [80.0, 80.0]]])
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "id long, a double, b double")
    got = {g["id"]: g["yhat"] for g in kernel.predict(asked, train, ["a", "b"], "y", 0.6, ["id"], True).collect()}
    w = np.exp(-0.5 * ((q[:, None] - x[None]) ** 2).sum(-1) / 0.36)
    for i in range(len(q)):
        if w[i].sum() > 0:
            assert got[i] == pytest.approx(w[i] @ y / w[i].sum(), rel=1e-10)
        else:
            assert got[i] is None
    assert len(got) == len(q)


def test_work_decides_between_cells_and_points():
    assert lattice.pays(6.0, 6.0, 0.5, 10_000, 10_000) and lattice.pays(6.0, None, 0.5, 10_000, 10_000)
    assert not lattice.pays(6.0, 6.0, 0.001, 10_000, 10_000)
    assert lattice.pays(6.0, 6.0, 0.05, 10**7, 10**7)
    with pytest.raises(ValueError):
        kernel._sums(None, None, ["a", "b", "c"], "y", [1.0], ["id"], None, False, True)
