import random

import pytest
from pyspark.ml import PipelineModel

from verdara.operators import trees


def grow(rows, depth, least, leaf=1):
    """Nested (feature, threshold, gain, left, right) or mean, by trying every split."""
    ys = [y for _, y in rows]
    mean = sum(ys) / len(ys)
    error = lambda part: sum((y - sum(z for _, z in part) / len(part)) ** 2 for _, y in part)
    if depth == 0 or len(rows) < least:
        return mean
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            left = [r for r in rows if r[0][f] <= a]
            right = [r for r in rows if r[0][f] > a]
            gain = error(rows) - error(left) - error(right)
            if min(len(left), len(right)) >= leaf and (best is None or gain > best[2]):
                best = (f, (a + b) / 2, gain, left, right)
    if best is None or best[2] <= 0:
        return mean
    return (*best[:3], grow(best[3], depth - 1, least, leaf), grow(best[4], depth - 1, least, leaf))


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] <= tree[1] else tree[4]
    return tree


def gains(tree):
    if isinstance(tree, tuple):
        yield tree[0], tree[2]
        yield from gains(tree[3])
        yield from gains(tree[4])


def data(n, seed):
    r = random.Random(seed)
    xs = [(float(i), r.random(), r.random()) for i in range(n)]
    return [(x, 3 * x[1] + (x[0] > n / 3) + r.gauss(0, 0.5)) for x in xs]


def table(spark, rows):
    return spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, c double, y double")


EXACT = {"n_estimators": 1, "bootstrap": False, "max_features": None}


@pytest.mark.parametrize("least,leaf,depth", [(2, 1, 3), (12, 1, 6), (9, 3, 6), (100, 1, 4)])
def test_equals_trying_every_split(spark, tmp_path, least, leaf, depth):
    rows = data(30, least)
    model = trees.fit(table(spark, rows), "y", ["a", "b", "c"], trees.forest(
        "y", max_depth=depth, min_samples_leaf=leaf, min_samples_split=least, **EXACT))
    model.write().save(str(tmp_path / "m"))
    want = grow(rows, depth, least, leaf)
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        got = {r["a"]: r["prediction"] for r in m.transform(table(spark, rows)).collect()}
        for x, _ in rows:
            assert got[x[0]] == pytest.approx(value(want, x), abs=1e-9)
    total = sum(g for _, g in gains(want))
    importance = {r["feature"]: r["importance"] for r in
                  trees.impurity_importance(model, ["a", "b", "c"], spark).collect()}
    for i, f in enumerate("abc"):
        own = sum(g for k, g in gains(want) if k == i)
        assert importance[f] == pytest.approx(own / total if total else 0.0, abs=1e-9)
    assert (model.stages[-1].totalNumNodes - 1) // 2 == sum(1 for _ in gains(want))


def test_many_trees_keep_their_other_nodes(spark):
    rows = table(spark, data(200, 1))
    fits = [trees.fit(rows, "y", ["a", "b", "c"], trees.forest(
        "y", n_estimators=6, max_depth=6, min_samples_split=m)).stages[-1] for m in (2, 30, 10_000)]
    sizes = [[t.numNodes for t in m.trees] for m in fits]
    assert all(a > b > c == 1 for a, b, c in zip(*sizes))
    assert [t.toDebugString.split("\n")[1] for t in fits[0].trees] == [
        t.toDebugString.split("\n")[1] for t in fits[1].trees]


def test_search_draws_the_parameter(spark):
    rows = table(spark, data(60, 2))
    grid = {"n_estimators": [2], "max_depth": [4], "min_samples_split": [2, 50]}
    model, scores = trees.random_search(rows, "y", ["a", "b", "c"], "a", grid=grid, folds=3, parallelism=2)
    assert scores.count() == 2 and scores.where("r2_mean is null").count() == 0
    assert model.transform(rows).where("prediction is null").count() == 0
