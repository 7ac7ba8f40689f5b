"""Gaussian sums over a lattice of cells, for one or two features.

Training rows are folded into cells of width h that carry moments up to degree TERMS - 1 in each
feature.  In a block of query cells, the sums of all cells around it become one Taylor polynomial
per query cell: along each feature the change from moments to polynomial depends on the distance of
the two cells alone, so it is a product with one matrix per feature and not with one per pair of
cells.  A query row then evaluates the polynomial of its cell, and its derivatives where sums
weighted by the offsets to the training rows are wanted, as local-linear fits need.

The work grows with the cells and with the rows, never with their product.  Hermite functions fall
off as exp(-D²/4) with the distance D of two cells in units of h, which bounds the error of each
sum; a row that lies so far from all training rows that the bound is not small beside its sum is
marked as in doubt, and the caller sums it over the points.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_FEATURES = 2
TERMS = 22
# Cells along a feature of one block of queries; cells beyond the next block weigh below 1e-46.
BLOCK = 16
FAR = 1e-46
# Error of a sum beside Σ exp(-D²/4), and the part of the sum it may reach.
ROUNDING = 1e-14
ALLOWED, ALLOWED_LOCAL = 1e-10, 1e-11
# Cells that one task holds before it hands on partial moments.
HELD = 2000
# Query rows summed at once.
STEP = 5000
# Measured on one core; they weigh the two ways against each other and change no result.
FLOPS, TILE_SECONDS, PAIR_SECONDS = 5e9, 0.01, 2e-8

ELEMENT = "hi int, cell array<bigint>, n double, m array<double>, t array<double>"


def pays(width: float, other: float | None, h: float, queries: int, points: int) -> bool:
    """Whether cells take less work than pairs of points; both give the same sums."""
    spans = [width / h + 1] + ([] if other is None else [other / h + 1])
    near, own = ([min(s, k) for s in spans] for k in (3 * BLOCK, BLOCK))
    blocks = math.prod(math.ceil(s / BLOCK) for s in spans)
    flops = 4 * TERMS ** (len(spans) + 1) * (math.prod(near) * own[0] + math.prod(own) * near[-1])
    share = math.prod(min(1.0, 2 * 39.0 / s) for s in spans)
    return blocks * (flops / FLOPS + TILE_SECONDS) < queries * points * share * PAIR_SECONDS


# --- moments of the training rows ---

def _powers(u: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    return np.asarray(weight)[..., None] * u[:, None] ** np.arange(TERMS)


def fold(x: np.ndarray, m0: np.ndarray, t0: np.ndarray, h: float):
    """(cells, rows, moments, moments of y) of the occupied cells."""
    at = np.floor(x / h).astype(np.int64)
    cells, of = np.unique(at, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    edges = np.searchsorted(of.ravel()[order], np.arange(len(cells)))
    u = (x - (at + 0.5) * h) / h
    n = np.add.reduceat(m0[order], edges)
    sums = []
    for weight in (m0, t0):
        parts = np.empty((len(cells), TERMS ** x.shape[1]))
        for k, (low, high) in enumerate(zip(edges, [*edges[1:], len(order)])):
            own = order[low:high]
            total = _powers(u[own, 0], weight[own])
            parts[k] = total.sum(0) if x.shape[1] == 1 else (total.T @ _powers(u[own, 1])).ravel()
        sums.append(parts)
    return cells, n, *sums


def elements(points: DataFrame, xs: Sequence[str], hs: Sequence[float]) -> DataFrame:
    """(hi, cell, n, m, t): the cells of every bandwidth, from (xs, m0, t0) of distinct points.

    Tasks read neighbouring points and add them up before partial moments are shuffled, so most
    cells have one part; parts are summed by place, so no task holds all parts of a cell.
    """
    names = list(xs)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.repartitionByRange(parts, *names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush():
            rows = [(k[0], list(k[1:]), *v) for k, v in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["hi", "cell", "n", "m", "t"])

        for batch in batches:
            x, m0, t0 = batch[names].to_numpy(float), batch["m0"].to_numpy(), batch["t0"].to_numpy()
            for hi, h in enumerate(hs):
                for at in range(0, len(x), HELD):
                    part = slice(at, at + HELD)
                    for cell, *new in zip(*fold(x[part], m0[part], t0[part], h)):
                        key = (hi, *cell.tolist())
                        old = held.get(key)
                        held[key] = new if old is None else [a + b for a, b in zip(old, new)]
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    rows = points.select(*names, "m0", "t0").mapInPandas(partial, ELEMENT)
    single = rows.select("hi", "cell", F.lit(-1).alias("k"), F.col("n").alias("m"), F.lit(0.0).alias("t"))
    each = rows.select("hi", "cell", F.posexplode(F.arrays_zip("m", "t")).alias("k", "v")).select(
        "hi", "cell", "k", "v.m", "v.t")
    sums = single.unionByName(each).groupBy("hi", "cell", "k").agg(F.sum("m").alias("m"), F.sum("t").alias("t"))
    # at most 1 + TERMS^features values to a cell
    listed = sums.groupBy("hi", "cell").agg(F.array_sort(F.collect_list(F.struct("k", "m", "t"))).alias("v"))
    return listed.select("hi", "cell", F.col("v")[0]["m"].alias("n"),
                         F.expr("transform(slice(v, 2, size(v) - 1), x -> x.m)").alias("m"),
                         F.expr("transform(slice(v, 2, size(v) - 1), x -> x.t)").alias("t"))


# --- sums at the query rows ---

def _change(gap: np.ndarray) -> np.ndarray:
    """Matrices from moments to Taylor coefficients for cells ``gap`` cells apart."""
    d = gap.astype(float)
    hermite = [np.exp(-0.5 * d * d), d * np.exp(-0.5 * d * d)]
    for n in range(1, 2 * TERMS - 2):
        hermite.append(d * hermite[n] - n * hermite[n - 1])
    factorial = np.array([math.factorial(k) for k in range(TERMS)], float)
    j, k = np.meshgrid(np.arange(TERMS), np.arange(TERMS), indexing="ij")
    scale = (-1.0) ** j / (factorial[j] * factorial[k])
    return np.stack(hermite)[j + k].transpose(2, 0, 1) * scale


class _Side:
    """Change matrices and their bounds along one feature."""

    def __init__(self, asked: np.ndarray, cells: np.ndarray):
        self.q, self.e = np.unique(asked), np.unique(cells)
        gap = self.q[:, None] - self.e[None]
        known = np.unique(gap)
        self.blocks = _change(known)[np.searchsorted(known, gap)]  # q, e, j, k
        self.same = gap == 0
        self.bound = np.exp(-0.25 * gap.astype(float) ** 2)
        self.at_q, self.at_e = np.searchsorted(self.q, asked), np.searchsorted(self.e, cells)

    def matrix(self, keep: np.ndarray | bool = True) -> np.ndarray:
        blocks = self.blocks if keep is True else np.where(keep[:, :, None, None], self.blocks, 0.0)
        return blocks.transpose(0, 2, 1, 3).reshape(len(self.q) * TERMS, len(self.e) * TERMS)


def _polynomials(sides: list[_Side], moments: np.ndarray, without_own: bool) -> np.ndarray:
    """Taylor coefficients by query cell; ``without_own`` leaves out each cell's own moments."""
    if len(sides) == 1:
        a = sides[0]
        full = np.zeros((len(a.e), TERMS))
        full[a.at_e] = moments
        return (a.matrix(~a.same if without_own else True) @ full.ravel()).reshape(-1, TERMS)
    a, b = sides
    full = np.zeros((len(a.e), TERMS, len(b.e), TERMS))
    full[a.at_e, :, b.at_e, :] = moments.reshape(-1, TERMS, TERMS)
    full = full.reshape(len(a.e) * TERMS, len(b.e) * TERMS)
    if without_own:
        out = a.matrix(~a.same) @ full @ b.matrix().T + a.matrix(a.same) @ full @ b.matrix(~b.same).T
    else:
        out = a.matrix() @ full @ b.matrix().T
    return out.reshape(len(a.q), TERMS, len(b.q), TERMS).transpose(0, 2, 1, 3)


def _derivatives(u: np.ndarray) -> list[np.ndarray]:
    """Powers of u and their first and second derivatives."""
    k = np.arange(TERMS)
    p = _powers(u)
    first, second = np.zeros_like(p), np.zeros_like(p)
    first[:, 1:] = k[1:] * p[:, :-1]
    second[:, 2:] = k[2:] * k[1:-1] * p[:, :-2]
    return [p, first, second]


def _evaluate(poly: np.ndarray, place: tuple, groups: list[np.ndarray], powers: list[list[np.ndarray]],
              orders: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Values of the polynomials of the rows' cells; ``orders`` names the derivative per feature."""
    n = len(powers[0][0])
    out = np.empty((n, len(orders)))
    for rows in groups:
        own = poly[tuple(p[rows[0]] for p in place)]
        for c, order in enumerate(orders):
            left = powers[0][order[0]][rows]
            if len(powers) == 1:
                out[rows, c] = left @ own
            else:
                out[rows, c] = ((left @ own) * powers[1][order[1]][rows]).sum(1)
    return out


def sums(x: np.ndarray, own_y: np.ndarray | None, h: float, cells: np.ndarray, n: np.ndarray,
         m: np.ndarray, t: np.ndarray, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums, error bound) of every query row over the cells.

    Sums are Σw and Σwy; ``local`` gives Σw·zi·zj and Σw·zi·y with z = (1, offsets).  With ``own_y``
    each row is taken out of its own cell.
    """
    d = x.shape[1]
    asked = np.floor(x / h).astype(np.int64)
    u = (x - (asked + 0.5) * h) / h
    sides = [_Side(asked[:, i], cells[:, i]) for i in range(d)]
    place = tuple(s.at_q for s in sides)
    flat = np.ravel_multi_index(place, [len(s.q) for s in sides])
    order = np.argsort(flat, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(flat[order])) + 1)
    powers = [_derivatives(u[:, i]) for i in range(d)]
    zero = (0,) * d
    orders = [zero]
    if local:
        one = [tuple(int(i == k) for i in range(d)) for k in range(d)]
        two = [tuple(a + b for a, b in zip(one[i], one[j])) for i in range(d) for j in range(i, d)]
        orders += one + two
    loo = own_y is not None
    weight = _evaluate(_polynomials(sides, m, loo), place, groups, powers, orders)
    total = _evaluate(_polynomials(sides, t, loo), place, groups, powers, orders[:1 + d if local else 1])
    count = np.zeros([len(s.e) for s in sides])
    count[tuple(s.at_e for s in sides)] = n
    bound = sides[0].bound @ count
    bound = (bound[:, None] if d == 1 else bound @ sides[1].bound.T)
    bound = bound[place if d > 1 else (place[0], 0)]
    if loo:
        own_n, own_m, own_t = _own_cells(asked, cells, n, m, t)
        others = own_n > 1
        change = _change(np.array([0]))[0]
        for values, moments, self_part in ((weight, own_m, 1.0), (total, own_t, own_y)):
            part = moments.reshape(-1, *(TERMS,) * d)
            poly = (part @ change.T if d == 1 else change @ part @ change.T)
            if d == 1:
                at_own = (poly * powers[0][0]).sum(1)
            else:
                at_own = np.einsum("nj,njk,nk->n", powers[0][0], poly, powers[1][0])
            values[:, 0] += np.where(others, at_own - self_part, 0.0)
        bound = bound - np.where(others, 0.0, own_n)
    if not local:
        return np.concatenate([weight, total], axis=1), ROUNDING * bound
    pairs = [weight[:, 0]] + [h * weight[:, 1 + k] for k in range(d)]
    at = 1 + d
    for i in range(d):
        for j in range(i, d):
            pairs.append(h * h * (weight[:, at] + (weight[:, 0] if i == j else 0.0)))
            at += 1
    return (np.stack([*pairs, total[:, 0], *[h * total[:, 1 + k] for k in range(d)]], axis=1),
            ROUNDING * bound)


def _own_cells(asked, cells, n, m, t):
    """The rows' own cells; a row without one among the cells gets an empty one."""
    where = {tuple(c): i for i, c in enumerate(cells.tolist())}
    at = np.array([where.get(tuple(a), -1) for a in asked.tolist()], int)
    found = at >= 0
    return (np.where(found, n[at], 0.0), np.where(found[:, None], m[at], 0.0),
            np.where(found[:, None], t[at], 0.0))


def tile(q: pd.DataFrame, e: pd.DataFrame, xs: Sequence[str], own_y: str | None, h: float,
         n_train: int, local: bool, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums, doubt) of the query rows of one tile."""
    size = (len(xs) + 1) * (len(xs) + 2) // 2 + len(xs) + 1 if local else 2
    found, error = np.zeros((len(q), size)), np.zeros(len(q))
    if len(e) and len(q):
        x = q[list(xs)].to_numpy(float)
        y = q[own_y].to_numpy(float) if own_y else None
        cells = np.stack(e["cell"].to_numpy())
        n, m, t = e["n"].to_numpy(), np.stack(e["m"].to_numpy()), np.stack(e["t"].to_numpy())
        for at in range(0, len(q), STEP):
            part = slice(at, at + STEP)
            found[part], error[part] = sums(x[part], None if y is None else y[part], h, cells, n, m, t, local)
    allowed = ALLOWED_LOCAL if local else ALLOWED
    return found, error + FAR * n_train > allowed * (found[:, 0] + epsilon)
