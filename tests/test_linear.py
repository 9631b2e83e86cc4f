import numpy as np

from tabsmith.operators import linear
from tabsmith.operators.sums import gram


def _data(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3)) * [1, 10, 100] + [5, -3, 1e4]
    y = X @ [1.5, -0.2, 0.01] + rng.normal(size=n)
    fold = np.arange(n) % 4
    df = spark.createDataFrame([(int(f), *map(float, x), float(t)) for f, x, t in zip(fold, X, y)], "fold int, a double, b double, c double, y double")
    return df, X, y, fold


def test_ols_ridge_and_cv_from_sums(spark):
    df, X, y, fold = _data(spark)
    g, c = gram(df, ["a", "b", "c", "y"], group="fold")
    total = sum(g.values())
    w, b = linear.fit(total, [1, 2, 3], linear.LinearSpec("ols"))
    A = np.hstack([np.ones((len(X), 1)), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    np.testing.assert_allclose(w, ref[1:], rtol=1e-8)
    # ridge: centred normal equations
    Xc, yc = X - X.mean(0), y - y.mean()
    wr, _ = linear.fit(total, [1, 2, 3], linear.LinearSpec("ridge", "ridge", alpha=3.0))
    np.testing.assert_allclose(wr, np.linalg.solve(Xc.T @ Xc + 3 * np.eye(3), Xc.T @ yc), rtol=1e-8)
    # CV R2 from sums equals direct CV
    scores = linear.cv_scores(g, [1, 2, 3], linear.LinearSpec("ols"))
    direct = []
    for f in range(4):
        tr, te = fold != f, fold == f
        coef = np.linalg.lstsq(A[tr], y[tr], rcond=None)[0]
        pred = A[te] @ coef
        direct.append(1 - ((y[te] - pred) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
    np.testing.assert_allclose(scores, direct, rtol=1e-7)


def test_lasso_kkt(spark):
    df, X, y, _ = _data(spark, seed=2)
    g, c = gram(df, ["a", "b", "c", "y"])
    spec = linear.LinearSpec("lasso", "lasso", alpha=0.5, tol=1e-10, max_iter=100000)
    w, b = linear.fit(g[0], [1, 2, 3], spec)
    Xc, yc = X - X.mean(0), y - y.mean()
    grad = Xc.T @ (yc - Xc @ w) / len(y)
    for j in range(3):
        if w[j] != 0:
            assert abs(grad[j] - 0.5 * np.sign(w[j])) < 1e-6
        else:
            assert abs(grad[j]) <= 0.5 + 1e-6
