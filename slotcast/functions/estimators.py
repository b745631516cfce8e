"""Small estimators in NumPy, run inside grouped Spark jobs.

One sparse linear model for many targets at once (from rows, or from sums of products), and one smoothed quantile regression
for many levels at once.  Each solves one group's small problem; Spark deals the groups.
"""

from __future__ import annotations

import math

import numpy as np


def lasso_path(gram: np.ndarray, cross: np.ndarray, floor: float = 0.0, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The knots (penalties, coefficients) of the LASSO path from zero coefficients down.

    ``gram`` and ``cross`` are x'x and x'y of centred columns.  Between two knots the
    coefficients are linear in the penalty.  Features enter when their correlation
    with the residual reaches the penalty and leave when their coefficient meets zero;
    the inverse of the active block is updated, not solved anew.  A path ends after
    ``most`` knots; a penalty below the last is served by its coefficients.
    """
    p = len(cross)
    beta, corr = np.zeros(p), cross.astype(float).copy()
    size = np.maximum(np.diag(gram), 0.0)
    flat = size <= 1e-12 * max(1.0, float(size.max(initial=0.0)))  # never enter
    out = flat.copy()  # nor do those that the active ones span, until one of these leaves
    level = float(np.abs(np.where(out, 0.0, corr)).max(initial=0.0))
    knots, coefs = [level], [beta.copy()]
    active: list[int] = []
    inverse = np.zeros((0, 0))
    start = level
    left = -1
    while level > max(floor, 1e-10 * max(start, 1e-300)) and len(knots) <= most:
        inside = np.zeros(p, bool)
        inside[active] = True
        ready = np.flatnonzero(~inside & ~out & (np.abs(corr) >= level * (1 - 1e-9)))
        for j in ready:
            if j == left:
                continue
            b = gram[active, j]
            v = inverse @ b
            rest = gram[j, j] - b @ v
            if rest <= 1e-9 * size[j]:
                out[j] = True
                continue
            k = len(active)
            grown = np.empty((k + 1, k + 1))
            grown[:k, :k] = inverse + np.outer(v, v) / rest
            grown[:k, k] = grown[k, :k] = -v / rest
            grown[k, k] = 1 / rest
            inverse = grown
            active.append(int(j))
        if not active:
            break
        sign = np.sign(corr[active])
        w = inverse @ sign
        slope = w @ gram[active]  # whole rows: the matrix is symmetric
        inside[active] = True
        free = ~inside & ~out
        c, a = corr[free], slope[free]
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.concatenate([(level - c) / (1 - a), (level + c) / (1 + a)])
            drops = -beta[active] / w
        steps = steps[steps > 1e-12 * level]  # neither NaN nor behind
        drops = np.where(drops > 1e-12 * level, drops, np.inf)
        step = min(level, float(steps.min(initial=np.inf)), float(drops.min(initial=np.inf)))
        beta[active] += step * w
        corr -= step * slope
        level -= step
        left = -1
        if drops.min(initial=np.inf) <= step * (1 + 1e-12):
            k = int(drops.argmin())
            left = active.pop(k)
            beta[left] = 0.0
            out = flat.copy()
            q, r = np.delete(inverse[:, k], k), inverse[k, k]
            inverse = np.delete(np.delete(inverse, k, 0), k, 1) - np.outer(q, q) / r
        knots.append(level)
        coefs.append(beta.copy())
    return np.array(knots), np.array(coefs)


def _at(penalty: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values along the path at penalties, linear between knots; rows are penalties."""
    place = np.clip(np.searchsorted(-knots, -penalty, "right"), 1, max(1, len(knots) - 1))
    if len(knots) == 1:
        return np.repeat(values[:1], len(penalty), axis=0)
    high, low = knots[place - 1], knots[place]
    share = np.clip((high - penalty) / np.maximum(high - low, 1e-300), 0.0, 1.0)[:, None]
    return values[place - 1] * (1 - share) + values[place] * share


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 5, n_alphas: int = 100, eps: float = 1e-3) -> dict:
    """LASSO of each column of ``y`` on ``x`` with the penalty chosen by contiguous folds.

    Minimises ``|y - xb|^2 / 2n + alpha |b|`` with an intercept.  Errors of the held
    rows are compared at ``n_alphas`` penalties from the smallest that gives zero
    coefficients down to ``eps`` of it; each fold's path is exact.  Returns alpha,
    intercept, coef (features x targets).
    """
    n, p = x.shape
    x_mean, y_mean = x.mean(axis=0), y.mean(axis=0)
    xc, yc = x - x_mean, y - y_mean
    cross = xc.T @ yc / n
    grid = np.maximum(np.abs(cross).max(axis=0, initial=0.0), 1e-12)[:, None] * np.geomspace(1.0, eps, n_alphas)
    errors = np.zeros((y.shape[1], n_alphas))
    for held in np.array_split(np.arange(n), min(folds, n)):
        train = np.ones(n, bool)
        train[held] = False
        if not train.any():
            continue
        fx, fy = x[train].mean(axis=0), y[train].mean(axis=0)
        tx, ty = x[train] - fx, y[train] - fy
        gram, own = tx.T @ tx / len(tx), tx.T @ ty / len(tx)
        for k in range(y.shape[1]):
            knots, coefs = lasso_path(gram, own[:, k], float(grid[k, -1]))
            predicted = fy[k] + _at(grid[k], knots, coefs @ (x[held] - fx).T)
            errors[k] += ((y[held, k] - predicted) ** 2).sum(axis=1)
    gram = xc.T @ xc / n
    alpha = grid[np.arange(len(grid)), errors.argmin(axis=1)]
    coef = np.empty((p, y.shape[1]))
    for k in range(y.shape[1]):
        knots, coefs = lasso_path(gram, cross[:, k], float(alpha[k]) * (1 - 1e-9))
        coef[:, k] = _at(alpha[k : k + 1], knots, coefs)[0]
    coef[np.abs(coef) < 1e-12 * (1 + np.abs(coef).max(initial=0.0))] = 0.0
    return {"alpha": alpha, "intercept": y_mean - x_mean @ coef, "coef": coef}


def lasso_cv_of_sums(sums: np.ndarray, scale: np.ndarray, shift: np.ndarray, n_alphas: int = 100, eps: float = 1e-3) -> dict:
    """:func:`lasso_cv` of the features ``scale * x + shift`` from sums of products alone.

    ``sums`` is (folds, 1 + p, 1 + p + targets): for each contiguous fold of rows the sums
    of (1, x) times (1, x, y).  Centred products don't see a shift, so the scale of a
    window meets its matrix as a factor of rows and columns.  What a penalty costs on held
    rows is a quadratic form of its coefficients, up to a number that all penalties share.
    """
    p = len(scale)
    both = np.outer(scale, scale)

    def centred(part: np.ndarray, x_mean: np.ndarray, y_mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products of a part's rows around given means, in the scaled features."""
        n, x_sum, y_sum = part[0, 0], part[0, 1 : p + 1], part[0, p + 1 :]
        gram = part[1:, 1 : p + 1] - np.outer(x_mean, x_sum) - np.outer(x_sum, x_mean) + n * np.outer(x_mean, x_mean)
        cross = part[1:, p + 1 :] - np.outer(x_mean, y_sum) - np.outer(x_sum, y_mean) + n * np.outer(x_mean, y_mean)
        return gram * both, cross * scale[:, None]

    def means(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return part[0, 1 : p + 1] / part[0, 0], part[0, p + 1 :] / part[0, 0]

    whole = sums.sum(axis=0)
    n = whole[0, 0]
    x_mean, y_mean = means(whole)
    gram, cross = (m / n for m in centred(whole, x_mean, y_mean))
    grid = np.maximum(np.abs(cross).max(axis=0, initial=0.0), 1e-12)[:, None] * np.geomspace(1.0, eps, n_alphas)
    errors = np.zeros((len(y_mean), n_alphas))
    for i, held in enumerate(sums):
        train = np.delete(sums, i, axis=0).sum(axis=0)
        if train[0, 0] < 1:
            continue
        at = means(train)
        own = [m / train[0, 0] for m in centred(train, *at)]
        held_gram, held_cross = centred(held, *at)
        for k in range(len(y_mean)):
            b = _at(grid[k], *lasso_path(own[0], own[1][:, k], float(grid[k, -1])))
            errors[k] += ((b @ held_gram) * b).sum(axis=1) - 2 * b @ held_cross[:, k]
    alpha = grid[np.arange(len(grid)), errors.argmin(axis=1)]
    coef = np.empty((p, len(y_mean)))
    for k in range(len(y_mean)):
        coef[:, k] = _at(alpha[k : k + 1], *lasso_path(gram, cross[:, k], float(alpha[k]) * (1 - 1e-9)))[0]
    coef[np.abs(coef) < 1e-12 * (1 + np.abs(coef).max(initial=0.0))] = 0.0
    return {"alpha": alpha, "intercept": y_mean - (scale * x_mean + shift) @ coef, "coef": coef}


def _rise(z: np.ndarray) -> np.ndarray:
    """Distribution function of the logistic kernel."""
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def smooth_quantiles(x: np.ndarray, y: np.ndarray, taus: list[float], bandwidth: float | None = None, most: int = 60) -> np.ndarray:
    """Quantile regression with the check loss smoothed by a logistic kernel.

    Returns (levels, 1 + features) coefficients, intercept first.  The bandwidth is in
    units of the residual spread; by default ``max(0.05, ((k + log n) / n) ** 0.4)``.
    Newton steps are halved until the gradient shrinks.
    """
    n = len(y)
    z = np.column_stack([np.ones(n), x])
    k = z.shape[1]
    start, *_ = np.linalg.lstsq(z, y, rcond=None)
    spread = max(float(np.median(np.abs(y - z @ start))) / 0.67448975, 1e-6)
    h = spread * (bandwidth or max(0.05, ((k + math.log(n)) / n) ** 0.4))
    out = np.empty((len(taus), k))
    for i, tau in enumerate(taus):
        b = start.copy()
        b[0] += float(np.quantile(y - z @ b, tau))

        def gradient(b, tau=tau):
            return z.T @ (_rise((z @ b - y) / h) - tau) / n

        g = gradient(b)
        for _ in range(most):
            if np.abs(g).max() < 1e-9:
                break
            rise = _rise((z @ b - y) / h)
            w = rise * (1 - rise) / h
            hess = (z * w[:, None]).T @ z / n + 1e-9 * np.eye(k)
            step = np.linalg.lstsq(hess, g, rcond=None)[0]
            t, size = 1.0, np.linalg.norm(g)
            while t > 1e-6:
                new = gradient(b - t * step)
                if np.linalg.norm(new) < size:
                    break
                t /= 2
            else:
                break
            b, g = b - t * step, new
        out[i] = b
    return out
