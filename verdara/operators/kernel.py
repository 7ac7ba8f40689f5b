"""Gaussian-kernel (Nadaraya–Watson) regression without pairwise rows.

Training rows are folded into elements: a centre with the weight and the sum of
y at that centre.  Equal feature vectors always fold into one element.  For one
feature and many training rows the elements are lattice cells of width h/16 that
carry a short series of moments; their number depends on the value range and h,
not on the number of rows, and the series is exact to about 1e-12.  Two features,
and local-linear fits of one or two, take the cells of ``lattice`` for each bandwidth
at which they are less work than pairs of points, and points for the rest.

Query rows and elements meet in blocks, like the tiles of a matrix product: both
sides are keyed by bandwidth, range block, element chunk and query salt, and a tile
of bounded size on both sides is reduced by numpy to one row of sums per query row.
No query × training pair ever becomes a row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.operators import lattice
from verdara.sources.scratch import stored

# The tile functions travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# exp(-0.5·39²) underflows to 0 in double precision: nothing beyond 39 h counts.
REACH = 39.0
CELLS_PER_H = 16
SERIES = 18
# Bounds of a tile: elements per chunk, query rows per salt, query rows per step.
CHUNK_SIZE = 4096
TILE_ROWS = 50_000
STEP = 128
LOO_EPSILON = 1e-12


@dataclass(frozen=True)
class _Layout:
    xs: tuple[str, ...]
    blocked: dict[float, list[int]]
    cells: bool
    rows: int = 0
    widths: tuple[float, ...] = ()


def _layout(train: DataFrame, xs: Sequence[str], hs: Sequence[float],
            cells: bool | None) -> _Layout:
    row = train.agg(F.count(F.lit(1)).alias("n"),
                    *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)],
                    *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]).first()
    if not row["n"]:
        raise ValueError("the kernel needs at least one training row")
    widths = [row[f"hi{i}"] - row[f"lo{i}"] for i in range(len(xs))]
    blocked = {h: [i for i, w in enumerate(widths) if w > REACH * h] for h in hs}
    return _Layout(tuple(xs), blocked, cells is not False and len(xs) == 1, row["n"], tuple(widths))


def _with_bandwidth(df: DataFrame, hs: Sequence[float]) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(i).alias("hi"), F.lit(float(h)).alias("h"))
                     for i, h in enumerate(hs)])
    return df.select("*", F.explode(grid).alias("_g")).select(
        *df.columns, F.col("_g.hi").alias("hi"), F.col("_g.h").alias("h"))


def _block(layout: _Layout, hs: Sequence[float]) -> Column:
    """Range block of a row as array of BIGINT; 0 along features that need no blocks."""
    def coordinate(i: int) -> Column:
        on = [k for k, h in enumerate(hs) if i in layout.blocked[h]]
        at = F.floor(F.col(layout.xs[i]) / (F.lit(REACH) * F.col("h")))
        if layout.cells:
            # cut between whole cells, so that no cell is split over two blocks
            at = F.floor(_cell(layout) / (REACH * CELLS_PER_H))
        return F.when(F.col("hi").isin(on), at).otherwise(F.lit(0)).cast("bigint") \
            if on else F.lit(0).cast("bigint")
    return F.array(*[coordinate(i) for i in range(len(layout.xs))])


def _neighbours(layout: _Layout, hs: Sequence[float], block: Column) -> Column:
    """The blocks within reach of ``block``, itself included."""
    dims = range(len(layout.xs))
    by_pattern: dict[tuple[int, ...], list[int]] = {}
    for k, h in enumerate(hs):
        by_pattern.setdefault(tuple(layout.blocked[h]), []).append(k)
    out = None
    for pattern, ks in by_pattern.items():
        offsets = [[]]
        for i in dims:
            offsets = [o + [d] for o in offsets for d in ((-1, 0, 1) if i in pattern else (0,))]
        moved = F.array(*[F.array(*[block[i] + F.lit(o[i]) for i in dims]) for o in offsets])
        hit = F.col("hi").isin(ks)
        out = F.when(hit, moved) if out is None else out.when(hit, moved)
    return out


def _cell(layout: _Layout) -> Column:
    return F.floor(F.col(layout.xs[0]) / (F.col("h") / CELLS_PER_H))


def _centre(layout: _Layout) -> list[Column]:
    if not layout.cells:
        return [F.col(x) for x in layout.xs]
    return [(_cell(layout) + 0.5) * (F.col("h") / CELLS_PER_H)]


def _series(layout: _Layout, weight: Column) -> list[Column]:
    """Moments of one row about the centre of its cell."""
    u = (F.col(layout.xs[0]) - _centre(layout)[0]) / F.col("h")
    base = weight * F.exp(-0.5 * u * u)
    return [base * F.pow(u, F.lit(float(m))) / F.lit(float(math.factorial(m)))
            for m in range(SERIES)]


def _elements(train: DataFrame, y: str, hs: Sequence[float], layout: _Layout) -> DataFrame:
    """(hi, _b, c0…, m0…, t0…): weight and y-sum of a point or moments of a cell."""
    points = train.groupBy(*layout.xs).agg(
        F.count(F.lit(1)).cast("double").alias("m0"), F.sum(F.col(y).cast("double")).alias("t0"))
    rows = _with_bandwidth(points, hs)
    names = [f"c{i}" for i in range(len(layout.xs))]
    if layout.cells:
        sums = [F.sum(m).alias(f"{k}{i}") for k in ("m", "t")
                for i, m in enumerate(_series(layout, F.col(f"{k}0")))]
        rows = rows.groupBy("hi", _block(layout, hs).alias("_b"),
                            _centre(layout)[0].alias("c0")).agg(F.sum("m0").alias("n"), *sums)
    else:
        rows = rows.withColumn("_b", _block(layout, hs)).withColumns(
            dict(zip(names, _centre(layout))))
    return rows.drop("h", *layout.xs)


def _kept(layout: _Layout, id_cols: Sequence[str], own_y: str | None) -> list[str]:
    return list(dict.fromkeys([*id_cols, *layout.xs, *([own_y] if own_y else [])]))


def _tiles(asked: DataFrame, train: DataFrame, y: str, hs: Sequence[float], layout: _Layout,
           id_cols: Sequence[str], own_y: str | None, local: bool) -> DataFrame:
    """(ids, h, [y,] s0…): sums per query row over all elements it reaches.

    ``asked`` holds query rows with hi, the place of their bandwidth in ``hs``, and h.  Chunks of
    elements and salts of query rows follow from the sizes of each block, so a query row meets as
    many tiles as its own surroundings need, however large the table is.
    """
    keep = _kept(layout, id_cols, own_y)
    key = ["hi", "block", "chunk", "salt"]
    asked = asked.select(*keep, "hi", "h").withColumn("block", _block(layout, hs))
    rows = asked.groupBy("hi", "block").agg(F.count(F.lit(1)).alias("_rows"))
    # elements go only to blocks that hold query rows
    reach = rows.select(F.col("hi").alias("hi"), F.col("block").alias("block"), F.explode(_neighbours(layout, hs, F.col("block"))).alias("_b"))
    near = _elements(train, y, hs, layout).join(reach, ["hi", "_b"]).drop("_b")
    size = near.groupBy("hi", "block").agg(F.count(F.lit(1)).alias("_n"))
    tiles = stored(rows.join(size, ["hi", "block"], "left").select(
        "hi", "block", F.ceil(F.col("_rows") / TILE_ROWS).cast("int").alias("_salts"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("_n", F.lit(0)) / CHUNK_SIZE)).cast("int")
        .alias("_chunks")))
    split = not tiles.where("_chunks > 1").isEmpty()
    left = (asked.join(tiles, ["hi", "block"])
            .withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id(), *keep),
                                       F.col("_salts")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .drop("_salts", "_chunks"))
    at = F.xxhash64(*[f"c{i}" for i in range(len(layout.xs))])
    right = (near.join(tiles, ["hi", "block"])
             .withColumn("chunk", F.pmod(at, F.col("_chunks")).cast("int"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
             .drop("_salts", "_chunks"))

    size = _sum_count(len(layout.xs), local)
    names = [f"s{k}" for k in range(size)]
    ids = list(dict.fromkeys([*id_cols, *([own_y] if own_y else [])]))
    kinds = dict(left.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["h double"]
                       + [f"{n} double" for n in names])
    xs, cells = list(layout.xs), layout.cells

    def reduce_tile(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = q[ids + ["h"]].copy()
        found = np.zeros((len(q), size))
        if len(q) and len(e):
            x = q[xs].to_numpy(float)
            own = q[own_y].to_numpy(float) if own_y else None
            found = _tile_sums(x, own, float(q["h"].iloc[0]), e, cells, local)
        out[names] = found
        return out

    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(reduce_tile, schema)
    if split:
        sums = sums.groupBy(*ids, "h").agg(*[F.sum(n).alias(n) for n in names])
    return sums


def _lattice_tiles(asked: DataFrame, train: DataFrame, y: str, hs: Sequence[float],
                   layout: _Layout, id_cols: Sequence[str], own_y: str | None,
                   local: bool) -> DataFrame:
    """As ``_tiles`` over lattice cells; with the features, hi and _doubt for a second look."""
    xs, keep = list(layout.xs), _kept(layout, id_cols, own_y)
    points = train.groupBy(*xs).agg(F.count(F.lit(1)).cast("double").alias("m0"),
                                    F.sum(F.col(y).cast("double")).alias("t0"))
    block = F.array(*[F.floor(F.floor(F.col(x) / F.col("h")) / lattice.BLOCK) for x in xs])
    asked = asked.select(*keep, "hi", "h").withColumn("block", block)
    sizes = stored(asked.groupBy("hi", "block").agg(
        F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("_salts")))
    steps = [[]]
    for _ in xs:
        steps = [s + [d] for s in steps for d in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[F.col("block")[i] + F.lit(d) for i, d in enumerate(s)])
                                 for s in steps])).alias("_b")
    reach = sizes.select("hi", "block", "_salts", around)
    cells = lattice.elements(points, xs, hs).withColumn(
        "_b", F.transform("cell", lambda c: F.floor(c / lattice.BLOCK)))
    key = ["hi", "block", "salt"]
    right = (cells.join(reach, ["hi", "_b"])
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
             .drop("_b", "_salts"))
    left = (asked.join(sizes, ["hi", "block"])
            .withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id(), *keep),
                                       F.col("_salts")).cast("int")).drop("_salts"))
    names = [f"s{k}" for k in range(_sum_count(len(xs), local))]
    kinds = dict(left.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["hi int", "h double", "_doubt boolean"]
                       + [f"{n} double" for n in names])
    n_train, epsilon = layout.rows, LOO_EPSILON if own_y else 0.0

    def reduce_tile(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = q[keep + ["hi", "h"]].copy()
        h = float(q["h"].iloc[0]) if len(q) else 1.0
        sums, out["_doubt"] = lattice.tile(q, e, xs, own_y, h, n_train, local, epsilon)
        out[names] = sums
        return out

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(reduce_tile, schema)


def _sums(queries: DataFrame, train: DataFrame, xs: Sequence[str], y: str, hs: Sequence[float],
          id_cols: Sequence[str], own_y: str | None, local: bool, cells: bool | None) -> DataFrame:
    """(ids, h, [y,] s0…) over cells or points, by bandwidth."""
    if cells and len(xs) > lattice.MOST_FEATURES:
        raise ValueError(f"cell moments are built for up to {lattice.MOST_FEATURES} features")
    layout = _layout(train, xs, hs, False if local else cells)
    fine = layout.cells  # one feature: cells of width h/16
    coarse: list[float] = []
    if cells is not False and not fine and len(xs) <= lattice.MOST_FEATURES:
        n = queries.count()
        coarse = [h for h in hs if cells or lattice.pays(*(*layout.widths, None)[:2], h, n, layout.rows)]
    points = [h for h in hs if h not in coarse]
    keep = _kept(layout, id_cols, own_y)
    args = (layout, id_cols, own_y, local)
    out = []
    if points:
        out.append(_tiles(_with_bandwidth(queries.select(*keep), points), train, y, points, *args))
    if coarse:
        found = stored(_lattice_tiles(_with_bandwidth(queries.select(*keep), coarse), train, y,
                                      coarse, *args))
        out.append(found.where("not _doubt"))
        doubt = found.where("_doubt")
        if not doubt.isEmpty():  # far from all training rows
            out.append(_tiles(doubt, train, y, coarse, *args))
    shown = list(dict.fromkeys([*id_cols, *([own_y] if own_y else [])])) + ["h"] + [
        f"s{k}" for k in range(_sum_count(len(xs), local))]
    return reduce(DataFrame.unionByName, [o.select(*shown) for o in out])


def _sum_count(d: int, local: bool) -> int:
    return (d + 1) * (d + 2) // 2 + d + 1 if local else 2


def _tile_sums(x: np.ndarray, own: np.ndarray | None, h: float, e: pd.DataFrame, cells: bool,
               local: bool) -> np.ndarray:
    """Sums of one tile.  ``own`` holds y of the query rows for leave-one-out."""
    d = x.shape[1]
    c = e[[f"c{i}" for i in range(d)]].to_numpy(float)
    order = SERIES if cells else 1
    m = e[[f"m{i}" for i in range(order)]].to_numpy(float)
    t = e[[f"t{i}" for i in range(order)]].to_numpy(float)
    out = np.zeros((len(x), _sum_count(d, local)))
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        gap = [x[part, k, None] - c[None, :, k] for k in range(d)]
        square = reduce(np.add, [g * g for g in gap])
        w = np.exp(square * (-0.5 / (h * h)))
        if local:
            z = [np.ones_like(w)] + [-g for g in gap]
            pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
            out[part] = np.stack([(w * z[i] * z[j]) @ m[:, 0] for i, j in pairs]
                                 + [(w * zi) @ t[:, 0] for zi in z], axis=1)
            continue
        if cells:
            weight, total = (_polynomial(gap[0] / h, a) for a in (m, t))
            if own is not None:
                weight, total = _without_self(x[part], own[part], h, c, m, t, weight, total,
                                              e["n"].to_numpy())
            out[part, 0], out[part, 1] = (w * weight).sum(1), (w * total).sum(1)
            continue
        if own is not None:  # the row leaves its point before anything is summed
            row, col = np.nonzero(square == 0)
            same = (x[part][row] == c[col]).all(1)
            row, col = row[same], col[same]
            w[row, col] = 0.0
            out[at + row, 0] = m[col, 0] - 1.0
            out[at + row, 1] = t[col, 0] - own[at + row]
        out[part, 0] += w @ m[:, 0]
        out[part, 1] += w @ t[:, 0]
    return out


def _polynomial(v: np.ndarray, moments: np.ndarray) -> np.ndarray:
    acc = np.broadcast_to(moments[:, -1], v.shape)
    for k in range(moments.shape[1] - 2, -1, -1):
        acc = acc * v + moments[:, k]
    return acc


def _without_self(x, own, h, c, m, t, weight, total, count):
    """Take each row's own part out of its cell before anything is summed.

    ``count`` gives the rows per cell.  A cell that holds nothing but the row itself counts
    exactly 0, whatever the last digit of its moments.
    """
    weight, total = (np.array(np.broadcast_to(a, (len(x), len(c)))) for a in (weight, total))
    width = h / CELLS_PER_H
    mine = (np.floor(x[:, 0] / width) + 0.5) * width
    row, col = np.nonzero(mine[:, None] == c[:, 0][None])
    u = (x[row, 0] - c[col, 0]) / h
    k = np.arange(SERIES)
    scale = np.array([math.factorial(i) for i in k], dtype=float)
    part = np.exp(-0.5 * u * u)[:, None] * u[:, None] ** k / scale
    powers = u[:, None] ** k
    others = count[col] > 1
    weight[row, col] = others * ((m[col] - part) * powers).sum(1)
    total[row, col] = others * ((t[col] - part * own[row][:, None]) * powers).sum(1)
    return weight, total


def _known(rows: DataFrame, y: str) -> DataFrame:
    """Rows with a target; a missing one takes no part."""
    return rows.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))


def kernel_sums(queries: DataFrame, train: DataFrame, xs: Sequence[str], y: str,
                hs: Sequence[float], id_cols: Sequence[str], leave_one_out: bool = False,
                cells: bool | None = None) -> DataFrame:
    """(ids, h, [y,] s0, s1) with s0 = Σw and s1 = Σw·y over the training rows.

    ``leave_one_out`` takes each query row's own part out of its sums; the query
    rows then are the training rows and carry ``y``.  ``id_cols`` identify a row.
    """
    train = _known(train, y)
    queries = _known(queries, y) if leave_one_out else queries
    return _sums(queries, train, xs, y, hs, id_cols, y if leave_one_out else None, False, cells)


def predict(queries: DataFrame, train: DataFrame, xs: Sequence[str], y: str,
            h: float | Sequence[float], id_cols: Sequence[str],
            cells: bool | None = None) -> DataFrame:
    """(ids, h, yhat): Σwy/Σw; NULL where every weight underflows."""
    hs = [h] if isinstance(h, (int, float)) else list(h)
    if any(v <= 0 for v in hs):
        raise ValueError("a bandwidth must be positive")
    sums = kernel_sums(queries, train, xs, y, hs, id_cols, cells=cells)
    return sums.select(*id_cols, "h", F.try_divide("s1", "s0").alias("yhat"))


def _risk(scored: DataFrame, y: str, name: str) -> DataFrame:
    err = F.col(y).cast("double") - F.col("yhat")
    return scored.groupBy("h").agg(F.sqrt(F.avg(err * err)).alias(name))


def loo_risk(train: DataFrame, xs: Sequence[str], y: str, hs: Sequence[float],
             id_cols: Sequence[str], cells: bool | None = None) -> DataFrame:
    """(h, rmse_loo): leave-one-out RMSE; a bandwidth ≤ 0 scores infinity."""
    good = [float(h) for h in hs if h > 0]
    bad = [float(h) for h in hs if h <= 0]
    out = None
    if good:
        sums = kernel_sums(train, train, xs, y, good, id_cols, True, cells)
        yhat = F.col("s1") / (F.col("s0") + F.lit(LOO_EPSILON))
        out = _risk(sums.withColumn("yhat", yhat), y, "rmse_loo")
    if bad:
        rows = train.sparkSession.createDataFrame(
            [(h, math.inf) for h in bad], "h double, rmse_loo double")
        out = rows if out is None else out.unionByName(rows)
    return out


def best_bandwidth(risk: DataFrame) -> DataFrame:
    """One row (h, rmse_loo): the smallest risk, the smaller h on a tie."""
    return risk.agg(F.min_by(F.struct("h", "rmse_loo"), F.struct("rmse_loo", "h")).alias("b")) \
        .select("b.h", "b.rmse_loo")


def validation_risk(val: DataFrame, train: DataFrame, xs: Sequence[str], y: str,
                    hs: Sequence[float], id_cols: Sequence[str]) -> DataFrame:
    """(h, rmse_val) of the kernel fitted on ``train``."""
    val = _known(val, y)
    yhat = predict(val, train, xs, y, hs, id_cols)
    return _risk(yhat.join(val.select(*id_cols, y), list(id_cols)), y, "rmse_val")


def predict_local_linear(queries: DataFrame, train: DataFrame, xs: Sequence[str], y: str,
                         h: float, id_cols: Sequence[str], cells: bool | None = None) -> DataFrame:
    """(ids, yhat) of the local-linear fit; a singular system falls back to Σwy/Σw.

    The tiles reduce to (d+1)-sized moment sums; one feature is solved in closed
    form, more features by a vectorised solve per Arrow batch.
    """
    d, train = len(xs), _known(train, y)
    sums = _sums(queries, train, xs, y, [h], id_cols, None, True, cells)
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    s = [F.col(f"s{k}") for k in range(_sum_count(d, True))]
    flat = F.try_divide(s[len(pairs)], s[0])
    if d == 1:
        det = s[0] * s[2] - s[1] * s[1]
        # relative test: the determinant is a difference of two equal-sized products
        ok = F.abs(det) > F.lit(1e-14) * s[0] * s[2]
        fit = F.when(ok, (s[2] * s[3] - s[1] * s[4]) / F.nullif(det, F.lit(0.0)))
    else:
        fit = _solver(d, pairs)(F.array(*s))
    return sums.select(*id_cols, F.coalesce(F.nanvl(fit, flat), flat).alias("yhat"))


def _solver(d: int, pairs: Sequence[tuple[int, int]]):
    @F.pandas_udf("double")
    def intercept(sums: pd.Series) -> pd.Series:
        flat = np.stack(sums.to_numpy())
        a = np.zeros((len(flat), d + 1, d + 1))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = flat[:, k]
        b = flat[:, len(pairs):]
        good = np.linalg.cond(a) < 1e12
        out = np.full(len(flat), np.nan)
        if good.any():
            out[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, 0, 0]
        return pd.Series(out)

    return intercept


def total_square_distance(df: DataFrame, xs: Sequence[str], id_cols: Sequence[str]) -> DataFrame:
    """(ids, sum_d2): squared distance of each row summed over all other rows.

    Uses ‖a−b‖² = ‖a‖² + ‖b‖² − 2a·b, so one aggregation of d+2 sums replaces the
    pairs; features are centred first and the result is clamped at 0.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
                 *[F.var_pop(x).alias(f"v{i}") for i, x in enumerate(xs)]).first()
    spread = sum(row[f"v{i}"] for i in range(len(xs))) if row["n"] else 0.0
    norm = reduce(lambda a, b: a + b,
                  [(F.col(x) - F.lit(row[f"m{i}"])) * (F.col(x) - F.lit(row[f"m{i}"]))
                   for i, x in enumerate(xs)])
    return df.select(*id_cols, F.greatest(
        F.lit(0.0), F.lit(float(row["n"])) * (norm + F.lit(spread))).alias("sum_d2"))
