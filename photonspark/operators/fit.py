"""Per-pixel curve fits.

Straight lines and parabolas are closed forms over sums, on built-in aggregates. The other models
are fitted by Levenberg-Marquardt for all pixels of a batch at once (numpy); ``MODELS`` is the
registry that own models are added to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.functions.models import A as ERF_A
from photonspark.functions.models import P as ERF_P

INVALID = 1e20


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + ERF_P * np.abs(x))
    return np.sign(x) * (1 - np.polyval((*ERF_A[::-1], 0.0), t) * np.exp(-x * x))


@dataclass(frozen=True)
class Model:
    """``f(x, p)`` with x (n,) and p (pixels, parameters); ``start(x, y)`` estimates p for all pixels."""

    names: tuple[str, ...]
    f: Callable[[np.ndarray, np.ndarray], np.ndarray]
    start: Callable[[np.ndarray, np.ndarray], np.ndarray]
    positive: tuple[str, ...] = ()

    def valid(self, p: np.ndarray) -> np.ndarray:
        return np.all([p[:, self.names.index(n)] > 0 for n in self.positive], axis=0) if self.positive else np.ones(len(p), bool)


def _col(p: np.ndarray, i: int) -> np.ndarray:
    return p[:, i : i + 1]


def _gauss(x, mu, sigma):
    return np.exp(-0.5 * ((x - mu) / sigma) ** 2)


def _tail(x, mu, sigma):
    return 0.5 * (1 - erf((x - mu) / (np.sqrt(2) * sigma)))


def _sharing(x, p):
    mu, sigma = _col(p, 2), _col(p, 3)
    return _col(p, 0) - _col(p, 1) * x + _col(p, 4) * (_gauss(x, mu, sigma) + _col(p, 5) * _tail(x, mu, sigma))


def _sharing_kb(x, p):
    mu, sigma, beta = _col(p, 2), _col(p, 3), _col(p, 6) * _col(p, 2)
    kb = _gauss(x, beta, sigma) + _col(p, 5) * _tail(x, beta, sigma)
    return _sharing(x, p[:, :6]) + _col(p, 4) * _col(p, 7) * kb


def _scurve(sign: int):
    def f(x, p):
        d = x - _col(p, 2)
        return _col(p, 0) + _col(p, 1) * x + 0.5 * (1 + sign * erf(d / (np.sqrt(2) * _col(p, 3)))) * (_col(p, 4) + _col(p, 5) * d)

    return f


def _peak(x, y):
    """Height, place and width (full width at half maximum / 2.35) of the first largest value."""
    top = y.argmax(axis=1)
    rows = np.arange(len(y))
    height = y[rows, top]
    above = y > height[:, None] / 2
    left = np.where(above.any(axis=1), above.argmax(axis=1), top)
    right = np.where(above.any(axis=1), y.shape[1] - 1 - above[:, ::-1].argmax(axis=1), top)
    step = abs(x[-1] - x[0]) / max(1, len(x) - 1)
    return height, x[top], np.maximum((x[right] - x[left]) / 2.35, step / 2.35)


def _start_gauss(x, y):
    return np.stack(_peak(x, y), axis=1)


def _ends(y):
    """Means of the first and of the last tenth."""
    n = max(1, y.shape[1] // 10)
    return y[:, :n].mean(axis=1), y[:, -n:].mean(axis=1)


def _start_plateau(x, y):
    height, mu, sigma = _peak(x, y)
    low, _ = _ends(y)
    return np.stack([height - low / 2, low, mu, sigma], axis=1)


def _start_sharing(x, y):
    first, last = _ends(y)
    height, mu, sigma = _peak(x, y - last[:, None])
    return np.stack([last, np.zeros_like(mu), mu, sigma, height, np.clip((first - last) / np.maximum(height, 1e-12), 0, 1)], axis=1)


def _start_sharing_kb(x, y):
    p = _start_sharing(x, y)
    return np.concatenate([p, np.full((len(p), 1), 1.10), np.full((len(p), 1), 0.10)], axis=1)


def _start_scurve(sign: int):
    def start(x, y):
        first, last = _ends(y)
        low, high = (first, last) if sign > 0 else (last, first)
        rise = (y - low[:, None]) / np.where(high == low, 1, high - low)[:, None]
        at = lambda share: x[np.abs(rise - share).argmin(axis=1)]
        sigma = np.maximum(np.abs(at(0.9) - at(0.1)) / 2.5631, 1.0)
        zero = np.zeros_like(low)
        return np.stack([low, zero, at(0.5), sigma, high - low, zero], axis=1)

    return start


def _line(x, y):
    slope = ((x - x.mean()) * y).sum(axis=1) / max(((x - x.mean()) ** 2).sum(), 1e-300)
    return np.stack([y.mean(axis=1) - slope * x.mean(), slope], axis=1)


MODELS: dict[str, Model] = {
    "pol1": Model(("p0", "p1"), lambda x, p: _col(p, 0) + _col(p, 1) * x, _line),
    "pol2": Model(("p0", "p1", "p2"), lambda x, p: _col(p, 0) + x * (_col(p, 1) + x * _col(p, 2)), lambda x, y: np.c_[_line(x, y), np.zeros(len(y))]),
    "gaussian": Model(("A", "mu", "sigma"), lambda x, p: _col(p, 0) * _gauss(x, _col(p, 1), _col(p, 2)), _start_gauss, ("sigma",)),
    "gaussian_erfc_plateau": Model(("A", "S", "mu", "sigma"), lambda x, p: _col(p, 0) * np.exp(-((x - _col(p, 2)) ** 2) / (2 * _col(p, 3) ** 2)) + _col(p, 1) * _tail(x, _col(p, 2), _col(p, 3)), _start_plateau, ("sigma",)),
    "gaussian_charge_sharing": Model(("p0", "p1", "mu", "sigma", "N", "C"), _sharing, _start_sharing, ("sigma",)),
    "gaussian_charge_sharing_kb": Model(("p0", "p1", "mu", "sigma", "N", "C", "kb_mean", "kb_frac"), _sharing_kb, _start_sharing_kb, ("sigma",)),
    "rising_scurve": Model(("p0", "p1", "mu", "sigma", "A", "C"), _scurve(1), _start_scurve(1), ("sigma",)),
    "falling_scurve": Model(("p0", "p1", "mu", "sigma", "A", "C"), _scurve(-1), _start_scurve(-1), ("sigma",)),
}


@dataclass
class FitModel:
    """Settings of a fit; parameters are named or numbered."""

    name: str
    max_calls: int = 100
    tolerance: float = 0.5
    strategy: int = 0
    compute_errors: bool = False
    fixed: dict[int, float] = field(default_factory=dict)
    start: dict[int, float] = field(default_factory=dict)
    limits: dict[int, tuple[float, float]] = field(default_factory=dict)

    @property
    def model(self) -> Model:
        return MODELS[self.name]

    @property
    def n_par(self) -> int:
        return len(self.model.names)

    @property
    def par_names(self) -> tuple[str, ...]:
        return self.model.names

    def _at(self, which: int | str) -> int:
        return self.model.names.index(which) if isinstance(which, str) else range(self.n_par)[which]

    def set_par_limits(self, which: int | str, low: float, high: float) -> None:
        self.limits[self._at(which)] = (low, high)

    def fix_parameter(self, which: int | str, value: float) -> None:
        self.fixed[self._at(which)] = value

    def release_parameter(self, which: int | str) -> None:
        self.fixed.pop(self._at(which), None)

    def set_parameter(self, which: int | str, value: float) -> None:
        self.start[self._at(which)] = value

    def __call__(self, x, par) -> np.ndarray:
        return self.model.f(np.asarray(x, float), np.asarray(par, float)[None])[0]


def chi2(model: Model, x, y, p, weight) -> np.ndarray:
    """Sum of weighted squared residuals of each pixel; parameters that are not valid cost ``INVALID``."""
    with np.errstate(all="ignore"):
        out = (weight * (y - model.f(x, p)) ** 2).sum(axis=1)
    return np.where(model.valid(p) & np.isfinite(out), out, INVALID)


def minimise(fit: FitModel, x: np.ndarray, y: np.ndarray, y_err: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Levenberg-Marquardt for (pixels, n) values; pixels that fail get zeros. Points of error 0 are skipped."""
    model = fit.model
    weight = np.ones_like(y) if y_err is None else np.where(y_err > 0, 1 / np.where(y_err > 0, y_err, 1) ** 2, 0)
    p = model.start(x, y).astype(float)
    for i, v in (fit.start | fit.fixed).items():
        p[:, i] = v
    free = [i for i in range(fit.n_par) if i not in fit.fixed]
    low = np.array([fit.limits.get(i, (-np.inf, np.inf))[0] for i in range(fit.n_par)])
    high = np.array([fit.limits.get(i, (-np.inf, np.inf))[1] for i in range(fit.n_par)])
    p = np.clip(p, low, high)
    damp, best, live = np.full(len(y), 1e-3), chi2(model, x, y, p, weight), np.ones(len(y), bool)

    def jacobian(q, k):
        columns = []
        for i in free:
            h = 1e-6 * np.maximum(np.abs(q[:, i]), 1e-3)
            up, down = q.copy(), q.copy()
            up[:, i] += h
            down[:, i] -= h
            columns.append((model.f(x, up) - model.f(x, down)) / (2 * h[:, None]))
        return np.stack(columns, axis=2)

    for _ in range(fit.max_calls):
        k = np.flatnonzero(live)
        if not len(k) or not free:
            break
        with np.errstate(all="ignore"):
            j = jacobian(p[k], k)
            residual = y[k] - model.f(x, p[k])
            normal = np.einsum("knp,kn,knq->kpq", j, weight[k], j)
            slope = np.einsum("knp,kn,kn->kp", j, weight[k], residual)
        bad = ~(np.isfinite(normal).all(axis=(1, 2)) & np.isfinite(slope).all(axis=1))
        normal[bad], slope[bad] = np.eye(len(free)), 0
        diagonal = np.einsum("kpp->kp", normal)
        damped = normal + (damp[k, None] * np.maximum(diagonal, 1e-12))[:, :, None] * np.eye(len(free))
        step = np.zeros_like(p[k])
        step[:, free] = np.linalg.solve(damped, slope[:, :, None])[:, :, 0]
        tried = np.clip(p[k] + step, low, high)
        cost = chi2(model, x, y[k], tried, weight[k])
        better = cost < best[k]
        small = np.abs(best[k] - cost) <= 1e-4 * fit.tolerance * 1e-3 * np.maximum(best[k], 1e-12)
        p[k[better]], best[k[better]] = tried[better], cost[better]
        damp[k] = np.where(better, damp[k] / 5, damp[k] * 4)
        live[k] = ~bad & ~(better & small) & (damp[k] < 1e12)
    good = model.valid(p) & np.isfinite(p).all(axis=1) & (best < INVALID)
    out = {"par": np.where(good[:, None], p, 0), "chi2": np.where(good, best, 0)}
    if fit.compute_errors and free:
        with np.errstate(all="ignore"):
            j = jacobian(p, np.arange(len(p)))
            normal = np.einsum("knp,kn,knq->kpq", j, weight, j)
        errors = np.zeros_like(p)
        for i in np.flatnonzero(good & np.isfinite(normal).all(axis=(1, 2))):
            errors[i, free] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(normal[i])), 0))
        out["par_err"] = errors
    return out


def fit_pixels(df: DataFrame, fit: FitModel, x: list[float] | None = None, rows: int = 4096) -> DataFrame:
    """Fit packed pixels ``(row, col, y array[, y_err array])`` on a common grid x; no shuffle.

    Result: row, col, par, par_err (zeros without errors), chi2, ndf.
    """
    grid, weighted = np.asarray(x, float), "y_err" in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                y = np.array(part["y"].tolist(), float)
                found = minimise(fit, grid, y, np.array(part["y_err"].tolist(), float) if weighted else None)
                errors = found.get("par_err", np.zeros_like(found["par"]))
                yield pd.DataFrame({"row": part["row"], "col": part["col"], "par": list(found["par"]), "par_err": list(errors), "chi2": found["chi2"], "ndf": len(grid) - fit.n_par})

    return df.select("row", "col", "y", *["y_err"] * weighted).mapInPandas(run, "row long, col long, par array<double>, par_err array<double>, chi2 double, ndf int")


#: Older names of fits and their models; ``pol1`` there is slope, intercept.
LEGACY = {"gaus": "gaussian", "pol1": "pol1", "scurve": "rising_scurve", "scurve2": "falling_scurve"}


def fit_legacy(df: DataFrame, name: str, x: list[float]) -> DataFrame:
    """``fit_gaus``, ``fit_pol1``, ``fit_scurve`` and ``fit_scurve2``: parameters only, or with ``y_err`` also errors, chi2 and Ndf."""
    weighted = "y_err" in df.columns
    found = fit_pixels(df, FitModel(LEGACY[name], compute_errors=weighted), x)
    if name == "pol1":
        found = found.withColumn("par", F.reverse("par")).withColumn("par_err", F.reverse("par_err"))
    return found.withColumnRenamed("ndf", "Ndf") if weighted else found.select("row", "col", "par")


def pack_points(df: DataFrame) -> DataFrame:
    """Long points (row, col, x, y) to one array a pixel, ordered by x; a pixel has as many values as the scan has steps."""
    points = df.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    return points.select("row", "col", F.transform("p", lambda q: q["y"].cast("double")).alias("y"))


def fit_pol1(df: DataFrame, by: list[str], x: Column, y: Column, w: Column | None = None) -> DataFrame:
    """p0 + p1 x by the normal equations; null where they are singular."""
    w = F.lit(1).cast("long") if w is None else w
    s = df.groupBy(*by).agg(F.sum(w).alias("s0"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    c = lambda n: F.col(n).cast("double")
    det = c("s0") * c("sxx") - c("sx") * c("sx")
    p1 = F.try_divide(c("s0") * c("sxy") - c("sx") * c("sy"), det)
    p0 = F.try_divide(c("sxx") * c("sy") - c("sx") * c("sxy"), det)
    return s.select(*by, p0.alias("p0"), p1.alias("p1"))


def fit_pol2(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """p0 + p1 x + p2 x**2 by Cramer's rule."""
    sums = {f"x{k}": F.sum(x**k if k > 1 else (x if k else F.lit(1))).cast("double") for k in range(5)}
    sums |= {f"y{k}": F.sum(y * (x**k) if k > 1 else (y * x if k else y)).cast("double") for k in range(3)}
    s = df.groupBy(*by).agg(*(v.alias(n) for n, v in sums.items()))
    c = F.col

    def det(m: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    rows = [[c(f"x{i + k}") for k in range(3)] for i in range(3)]
    whole = det(rows)
    solved = [F.try_divide(det([[c(f"y{i}") if k == at else rows[i][k] for k in range(3)] for i in range(3)]), whole) for at in range(3)]
    return s.select(*by, *(v.alias(f"p{k}") for k, v in enumerate(solved)))


def chi2_of(df: DataFrame, by: list[str], y: Column, f: Column, sigma: Column | None = None) -> DataFrame:
    """Chi squared of each group; points of error 0 are skipped."""
    z = y - f if sigma is None else F.try_divide(y - f, sigma)
    return df.groupBy(*by).agg(F.coalesce(F.sum(z * z), F.lit(0.0)).alias("chi2"))
