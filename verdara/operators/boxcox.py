"""Box-Cox transformation with a maximum-likelihood exponent."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.operators.ordered import melt, number, value_counts
from verdara.operators.reuse import held

LIMIT = 50.0
GRID = tuple(round(-2.0 + 0.1 * i, 1) for i in range(41))


class Fitted(NamedTuple):
    """Exponent and the amount added to the values before; both from the fitted rows."""

    lam: float
    shift: float


def boxcox(x: Column, lam: float) -> Column:
    """ln x for λ = 0, else (x^λ − 1)/λ."""
    if abs(lam) < 1e-12:
        return F.log(x)
    return (F.pow(x, F.lit(float(lam))) - 1.0) / F.lit(float(lam))


def _shift(low: float | None) -> float:
    return 0.0 if low is None or low > 0 else abs(low) + 1e-6


def fit_lambdas(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = GRID,
                refine: int = 3) -> dict[str, Fitted | None]:
    """λ and shift per column: best grid value, then ``refine`` passes around the maximum.

    A maximum on the edge of the grid moves the grid outwards first; beyond ±LIMIT there is no
    maximum and an error is raised.  A column without values or with one value has no fit.  The table is
    read once: equal values are folded to (value, count), and every pass works on
    those for all columns at once.  One number per column and grid value returns.
    """
    with held(value_counts(melt(df, [], cols), ["var"])) as counts:
        low = {r["var"]: r["low"] for r in
               counts.groupBy("var").agg(F.min("val").alias("low")).collect()}
        live = [c for c in cols if c in low]
        if not live:
            return dict.fromkeys(cols)
        move = _by_var({c: _shift(low[c]) for c in live})
        logs = counts.select("var", "n", F.log(F.col("val") + move).alias("lx"))
        mean = {r["var"]: r["m"] for r in logs.groupBy("var").agg(
            (F.sum(F.col("n") * F.col("lx")) / F.sum("n")).alias("m")).collect()}
        centred = logs.select("var", "n", (F.col("lx") - _by_var(mean)).alias("z"))
        best = _climb(centred, live, list(grid), refine)
    return {c: Fitted(best[c], _shift(low[c])) if best.get(c) is not None else None for c in cols}


def _by_var(values: Mapping[str, object]) -> Column:
    """Value of the row's variable; one entry per fitted column."""
    return F.element_at(F.create_map(*[
        x for c, v in values.items()
        for x in (F.lit(c), F.array(*[F.lit(float(g)) for g in v]) if isinstance(v, list)
                  else F.lit(float(v)))]), F.col("var"))


def _scores(centred: DataFrame, grids: Mapping[str, list[float]]) -> dict[str, list[float | None]]:
    """Profile log-likelihood per n, without terms that do not depend on λ.

    With z = ln x − mean(ln x) the variance of the transformed values is, up to
    powers of the geometric mean that cancel in the likelihood, var(expm1(λz))/λ²,
    which keeps its digits for any λ.  A value meets the grid inside its task and is
    folded there, so the shuffle carries one partial sum per column and grid value.
    """
    met = (centred.where(F.col("var").isin(list(grids)))
           .select("var", "n", "z", F.posexplode(_by_var(grids)).alias("at", "lam")))
    q = F.when(F.abs("lam") < 1e-12, F.col("z")).otherwise(
        F.expm1(F.col("lam") * F.col("z")) / F.nullif(F.col("lam"), F.lit(0.0)))
    sums = (met.select("var", "at", "n", q.alias("q")).groupBy("var", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("s1"),
        F.sum(F.col("n") * F.col("q") * F.col("q")).alias("s2")).collect())
    out: dict[str, list[float | None]] = {c: [None] * len(g) for c, g in grids.items()}
    for r in sums:
        var = r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2
        if 0 < var < math.inf:
            out[r["var"]][r["at"]] = -0.5 * math.log(var)
    return out


def _climb(centred: DataFrame, cols: Sequence[str], grid: list[float],
           refine: int) -> dict[str, float | None]:
    step, best = grid[1] - grid[0], {}
    todo = {c: grid for c in cols}
    while todo:
        again = {}
        for c, values in _scores(centred, todo).items():
            at = _top(values)
            best[c] = None if at is None else todo[c][at]
            if at is None or not refine:
                continue
            low, high = todo[c][0], todo[c][-1]
            if at in (0, len(values) - 1) and max(high, -low) >= LIMIT:
                raise ValueError(f"the likelihood of {c} has no maximum within ±{LIMIT:g}")
            if at == len(values) - 1:
                again[c] = [high + step * i for i in range(len(grid))]
            elif at == 0:
                again[c] = [low - step * i for i in reversed(range(len(grid)))]
        todo = again
    for _ in range(refine):
        grids = {c: [lam + step * i / 10 for i in range(-10, 11)]
                 for c, lam in best.items() if lam is not None}
        if not grids:
            break
        for c, values in _scores(centred, grids).items():
            at = _top(values)
            best[c] = best[c] if at is None else grids[c][at]
        step /= 10
    return best


def _top(values: Sequence[float | None]) -> int | None:
    """Position of the first largest known value."""
    known = [i for i, v in enumerate(values) if v is not None]
    return max(known, key=lambda i: (values[i], -i)) if known else None


def transform(df: DataFrame, fitted: Mapping[str, Fitted | None]) -> DataFrame:
    """Replace each column by its transform; NULL stays NULL, unfitted columns stay.

    Values that the shift of the fit leaves at or below zero have no transform and become NULL.
    """
    made = {}
    for c, f in fitted.items():
        if f is not None:
            x = number(c) + F.lit(f.shift)
            made[c] = F.when(x > 0, boxcox(x, f.lam))
    return df.withColumns(made)
