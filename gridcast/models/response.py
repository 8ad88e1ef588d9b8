"""Gain and time constants of a zone's response to an input, by least squares on lagged rows.

For an input that is constant between samples the continuous first- and second-order responses are
exactly linear in earlier samples, so the fit is a small linear system per zone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.models import linear
from gridcast.operators.windows import lag_rows


def _normal_sums(df: DataFrame, inputs: Sequence[str], output: str) -> DataFrame:
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(inputs) for b in inputs[i:]]
    return df.groupBy("zone").agg(
        F.array(*products).alias("xx"), F.array(*[F.sum(F.col(a) * F.col(output)) for a in inputs]).alias("xy")
    )


def first_order(df: DataFrame, u: str, y: str, order_by: str = "ds", dt: float = 1.0, **options) -> DataFrame:
    """Gain ``k`` and time constant ``tau`` of k / (tau s + 1) per zone. Null when the fitted factor is
    not that of a decaying response."""
    rows = lag_rows(df, order_by, {"y1": (y, 1), "u1": (u, 1)}, **options).na.drop("any", subset=["y1", "u1", y])
    s = rows.groupBy("zone").agg(
        F.sum(F.col("y1") * F.col("y1")).alias("yy"), F.sum(F.col("y1") * F.col("u1")).alias("yu"),
        F.sum(F.col("u1") * F.col("u1")).alias("uu"), F.sum(F.col("y1") * F.col(y)).alias("yt"),
        F.sum(F.col("u1") * F.col(y)).alias("ut"),
    )
    det = F.nullif(F.col("yy") * F.col("uu") - F.col("yu") * F.col("yu"), F.lit(0.0))
    fitted = s.select(
        "zone",
        ((F.col("uu") * F.col("yt") - F.col("yu") * F.col("ut")) / det).alias("a"),
        ((F.col("yy") * F.col("ut") - F.col("yu") * F.col("yt")) / det).alias("b"),
    )
    decays = (F.col("a") > 0) & (F.col("a") < 1)
    return fitted.withColumns({
        "k": F.when(decays, F.col("b") / (1 - F.col("a"))),
        "tau": F.when(decays, -dt / F.ln("a")),
    })


def second_order(df: DataFrame, u: str, y: str, order_by: str = "ds", dt: float = 1.0, **options) -> DataFrame:
    """Gain ``k``, natural frequency ``wn`` and damping ``zeta`` per zone. Null when a pole of the fitted
    recursion is not that of a decaying second-order response."""
    lags = {"y1": (y, 1), "y2": (y, 2), "u1": (u, 1), "u2": (u, 2)}
    inputs = list(lags)
    rows = lag_rows(df, order_by, lags, **options).na.drop("any", subset=[*inputs, y])
    upper = np.triu_indices(4)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xx = np.zeros((4, 4))
                xx[upper] = r.xx
                xx = xx + np.triu(xx, 1).T
                scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
                a1, a2, b1, b2 = np.linalg.lstsq(
                    xx / np.outer(scale, scale), np.asarray(r.xy) / scale, rcond=1e-13)[0] / scale
                out.append((r.zone, a1, a2, b1, b2, *_physical(a1, a2, b1 + b2, dt)))
            yield pd.DataFrame(out, columns=["zone", "a1", "a2", "b1", "b2", "k", "wn", "zeta"])

    return _normal_sums(rows, inputs, y).mapInPandas(
        solve, "zone string, a1 double, a2 double, b1 double, b2 double, k double, wn double, zeta double"
    )


def _physical(a1: float, a2: float, b: float, dt: float) -> tuple[float | None, float | None, float | None]:
    z = np.roots([1.0, -a1, -a2])
    decaying = len(z) == 2 and np.all(np.abs(z) < 1) and np.all((z.imag != 0) | (z.real > 0))
    if not decaying:
        return None, None, None
    s = np.log(z.astype(complex)) / dt
    wn = float(np.sqrt((s[0] * s[1]).real))
    return float(b / (1 - a1 - a2)), wn, float(-(s[0] + s[1]).real / (2 * wn))


REFINED = "zone string, n long, a array<double>, b array<double>, offset double, k double, tau double, wn double, zeta double"


def centred(df: DataFrame, u: str, y: str, order: int = 1, dt: float = 1.0, order_by: str = "ds", **options) -> DataFrame:
    """Least squares with a constant: the response around an operating point, for series without noise in the output.
    zone, n, a, b (by lag), offset, k, and tau (order 1) or wn and zeta (order 2); constants are null as in the plain fits."""
    return _around(df, u, y, order, dt, order_by, order, False, options)


def refined(df: DataFrame, u: str, y: str, order: int = 1, dt: float = 1.0, order_by: str = "ds", lags: int = 24, **options) -> DataFrame:
    """The same for an output measured with noise, in which least squares sees a faster response than there is.

    Earlier outputs are replaced, as instruments, by what the earlier inputs make of them: first by regression on ``lags`` inputs, then by the
    response fitted last, until it stays. All of it comes from the covariances of lagged rows, which are one small row per zone."""
    return _around(df, u, y, order, dt, order_by, max(lags, 2 * order), True, options)


def _around(df: DataFrame, u: str, y: str, order: int, dt: float, order_by: str, n_inputs: int, instruments: bool, options: dict) -> DataFrame:
    if order not in (1, 2):
        raise ValueError("a response is of first or second order")
    outputs = {f"y{k}": (y, k) for k in range(1, order + 1)}
    inputs = {f"u{k}": (u, k) for k in range(1, n_inputs + 1)}
    names = [*outputs, *inputs]
    rows = lag_rows(df, order_by, {**outputs, **inputs}, **options)
    upper = np.triu_indices(len(names))
    # The response's own regressors among all lagged columns.
    own = [*range(order), *range(order, 2 * order)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xx = np.zeros((len(names), len(names)))
                xx[upper] = r.xx
                xx = xx + np.triu(xx, 1).T
                theta = _fitted(xx, np.asarray(r.xy), own, order, instruments)
                means = np.asarray(r.means)
                a, b = theta[:order], theta[order:]
                k = tau = wn = zeta = None
                if order == 1 and 0 < a[0] < 1:
                    k, tau = float(b[0] / (1 - a[0])), float(-dt / np.log(a[0]))
                elif order == 2:
                    k, wn, zeta = _physical(a[0], a[1], float(b.sum()), dt)
                out.append((r.zone, r.n, a.tolist(), b.tolist(), float(means[-1] - theta @ means[own]), k, tau, wn, zeta))
            yield pd.DataFrame(out, columns=["zone", "n", "a", "b", "offset", "k", "tau", "wn", "zeta"])

    return linear.moments(rows, names, y).mapInPandas(solve, REFINED)


def _fitted(xx: np.ndarray, xy: np.ndarray, own: list[int], order: int, instruments: bool, steps: int = 50) -> np.ndarray:
    """Coefficients of the columns ``own`` from covariances of all lagged columns, outputs first, and of these with the output."""
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    xx, xy = xx / np.outer(scale, scale), xy / scale

    def solved(weights: np.ndarray) -> np.ndarray:
        """Weights give each instrument as a combination of the lagged columns."""
        return np.linalg.lstsq(weights @ xx[:, own], weights @ xy, rcond=1e-12)[0] / scale[own]

    chosen = np.zeros((len(own), len(xx)))
    chosen[np.arange(len(own)), own] = 1
    if not instruments:
        return solved(chosen)
    given = np.arange(order, len(xx))
    first = chosen.copy()
    first[:order] = 0
    first[np.ix_(range(order), given)] = np.linalg.lstsq(xx[np.ix_(given, given)], xx[np.ix_(given, range(order))], rcond=1e-9)[0].T
    theta = solved(first)
    for _ in range(steps):
        a, b = theta[:order], theta[order:]
        if np.abs(np.roots([1.0, *-a])).max(initial=0.0) >= 1:
            break
        # What an input does to the output so many steps later.
        response = np.zeros(len(given) + 1)
        for k in range(1, len(response)):
            response[k] = (b[k - 1] if k <= order else 0.0) + sum(a[j] * response[k - 1 - j] for j in range(min(order, k)))
        weights = chosen.copy()
        for j in range(order):
            weights[j] = 0
            reach = len(given) - j - 1
            weights[j, order + j + 1:] = response[1:reach + 1] * scale[order + j + 1:]
        after = solved(weights)
        if not np.isfinite(after).all():
            break
        if np.allclose(after, theta, rtol=1e-10, atol=1e-12):
            return after
        theta = after
    return theta
