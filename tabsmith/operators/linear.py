"""Linear models fitted from sufficient statistics (K2, K9 linear path, J2).

One distributed pass (:func:`sums.gram` grouped by fold) yields Z'Z of
Z = [1, x_1..x_p, y] per fold; every fit and fold score below is p x p
algebra on those matrices.  Objectives follow the usual definitions:

* ols:        ||y - b - Xw||^2
* ridge:      ||y - b - Xw||^2 + alpha ||w||^2
* lasso:      1/(2n) ||y - b - Xw||^2 + alpha ||w||_1
* elasticnet: 1/(2n) ||y - b - Xw||^2 + alpha l1 ||w||_1 + alpha (1 - l1)/2 ||w||^2

The intercept is never penalised.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class LinearSpec:
    name: str
    method: str = "ols"
    alpha: float = 0.0
    l1_ratio: float = 1.0
    max_iter: int = 2000
    tol: float = 1e-4


# Fixed hyper-parameters of the reference's linear model suite.
LINEAR_SUITE = [
    LinearSpec("Linear Regression", "ols"),
    LinearSpec("Ridge Regression", "ridge", alpha=3.0),
    LinearSpec("Lasso Regression", "lasso", alpha=0.5, l1_ratio=1.0),
    LinearSpec("ElasticNet", "elasticnet", alpha=0.5, l1_ratio=0.5),
]


def _centred(m: np.ndarray, idx: Sequence[int]):
    """n, means, centred Sxx, Sxy, Syy for feature positions ``idx`` (1-based in Z) and y (last)."""
    n = m[0, 0]
    yi = m.shape[0] - 1
    ix = np.asarray(idx, dtype=int)
    sx = m[0, ix]
    sy = m[0, yi]
    sxx = m[np.ix_(ix, ix)] - np.outer(sx, sx) / n
    sxy = m[ix, yi] - sx * sy / n
    syy = m[yi, yi] - sy * sy / n
    return n, sx / n, sy / n, sxx, sxy, syy


def fit(m: np.ndarray, idx: Sequence[int], spec: LinearSpec) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (in the centred coordinates of the Gram)."""
    n, mx, my, sxx, sxy, _ = _centred(m, idx)
    p = len(idx)
    if p == 0:
        return np.zeros(0), my
    if spec.method == "ols":
        w = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    elif spec.method == "ridge":
        w = np.linalg.solve(sxx + spec.alpha * np.eye(p), sxy)
    else:
        l1 = spec.l1_ratio if spec.method == "elasticnet" else 1.0
        w = _coordinate_descent(sxx / n, sxy / n, spec.alpha * l1, spec.alpha * (1 - l1), spec.max_iter, spec.tol)
    return w, float(my - w @ mx)


def _coordinate_descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float, max_iter: int, tol: float) -> np.ndarray:
    """min 1/2 w'Aw - b'w + l1 |w|_1 + l2/2 |w|^2 by cyclic coordinate descent."""
    p = len(b)
    w = np.zeros(p)
    for _ in range(max_iter):
        w_max = 0.0
        d_max = 0.0
        for j in range(p):
            if a[j, j] <= 0:
                continue
            old = w[j]
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (a[j, j] + l2)
            d_max = max(d_max, abs(w[j] - old))
            w_max = max(w_max, abs(w[j]))
        if w_max == 0.0 or d_max / w_max < tol:
            break
    return w


def sse(m: np.ndarray, idx: Sequence[int], w: np.ndarray, b: float) -> float:
    """Sum of squared errors of y - b - Xw over the rows summarised by ``m``."""
    k = m.shape[0]
    v = np.zeros(k)
    v[0] = -b
    v[np.asarray(idx, dtype=int)] = -w
    v[k - 1] = 1.0
    return float(max(v @ m @ v, 0.0))


def r2_from(m: np.ndarray, idx: Sequence[int], w: np.ndarray, b: float) -> float:
    n = m[0, 0]
    yi = m.shape[0] - 1
    sst = m[yi, yi] - m[0, yi] ** 2 / n
    e = sse(m, idx, w, b)
    if sst <= 1e-12 * max(m[yi, yi], 1.0):
        return 1.0 if e <= 1e-12 else 0.0
    return 1.0 - e / sst


def cv_scores(folds: dict, idx: Sequence[int], spec: LinearSpec) -> list[float]:
    """Per-fold R2: train on total minus the fold, score on the fold."""
    total = sum(folds.values())
    out = []
    for f in sorted(folds):
        test = folds[f]
        w, b = fit(total - test, idx, spec)
        out.append(r2_from(test, idx, w, b))
    return out


def fold_metrics(folds: dict, idx: Sequence[int], spec: LinearSpec) -> list[dict]:
    """Per-fold R2, RMSE and n (MAE needs the rows and is computed by K8)."""
    total = sum(folds.values())
    out = []
    for f in sorted(folds):
        test = folds[f]
        w, b = fit(total - test, idx, spec)
        n = test[0, 0]
        out.append({"fold": f, "r2": r2_from(test, idx, w, b), "rmse": float(np.sqrt(sse(test, idx, w, b) / n)), "n": n})
    return out


def summarise(scores: Sequence[float]) -> dict:
    a = np.asarray(scores, dtype=float)
    return {"mean": float(a.mean()), "std": float(a.std()), "min": float(a.min()), "max": float(a.max())}
