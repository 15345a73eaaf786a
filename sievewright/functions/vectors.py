"""Small dense models and layouts in numpy, for tasks and drivers that hold bounded tables."""

from __future__ import annotations

import numpy as np


def fit_logit(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50, balanced: bool = True) -> np.ndarray:
    """Coefficients and intercept of an L2 logistic model by Newton steps; the intercept is not shrunk."""
    n = len(y)
    w = np.ones(n)
    if balanced:
        w = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    a = np.hstack([x, np.ones((n, 1))])
    shrink = np.append(np.full(x.shape[1], 1 / c), 1e-9)
    theta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -35, 35)))
        grad = a.T @ (w * (p - y)) + shrink * theta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(shrink)
        step = np.linalg.solve(hess + 1e-10 * np.eye(len(theta)), grad)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def logit_scores(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -35, 35)))


class Scaler:
    """Median imputation (an all-null column becomes 0), then mean 0 and population deviation 1."""

    def __init__(self, x: np.ndarray):
        some = ~np.isnan(x).all(axis=0)
        self.middle = np.zeros(x.shape[1])
        self.middle[some] = np.nanmedian(x[:, some], axis=0)
        filled = self.fill(x)
        self.mean, sd = filled.mean(axis=0), filled.std(axis=0)
        self.sd = np.where(sd > 0, sd, 1)

    def fill(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.middle, x)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.fill(x) - self.mean) / self.sd


def average_ranks(v: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(first, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def auc(y: np.ndarray, s: np.ndarray) -> float | None:
    n1 = int((y == 1).sum())
    if n1 in (0, len(y)):
        return None
    return float((average_ranks(s)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def f2(y: np.ndarray, hit: np.ndarray) -> float:
    tp, fp, fn = (y[hit] == 1).sum(), (y[hit] == 0).sum(), (y[~hit] == 1).sum()
    return float(5 * tp / (5 * tp + 4 * fn + fp)) if tp else 0.0


def best_f2_cut(y: np.ndarray, s: np.ndarray) -> float:
    """The first of 99 cuts with the best F2."""
    cuts = np.arange(1, 100) / 100
    return float(cuts[int(np.argmax([round(f2(y, s >= t), 9) for t in cuts]))])


def stratified_folds(y: np.ndarray, folds: int, rng: np.random.Generator) -> np.ndarray:
    """Each class dealt round in a drawn order."""
    out = np.zeros(len(y), int)
    for c in (0, 1):
        at = rng.permutation(np.flatnonzero(y == c))
        out[at] = (np.arange(len(at)) + (c * 2)) % folds
    return out


def stress_layout(distance: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Points in the plane by stress majorisation from a circle; equal weights."""
    n = len(distance)
    turn = 2 * np.pi * np.arange(n) / max(1, n)
    at = np.stack([np.cos(turn), np.sin(turn)], 1) * (distance.max() / 2 if n else 1)
    for _ in range(rounds if n > 1 else 0):
        gap = np.linalg.norm(at[:, None] - at[None], axis=2)
        ratio = np.divide(distance, gap, out=np.zeros_like(gap), where=gap > 1e-12)
        b = -ratio
        np.fill_diagonal(b, ratio.sum(1) - np.diag(ratio))
        at = b @ at / n
    return at


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average linkage; new clusters count on from n, ties to the smallest pair."""
    n = len(distance)
    live, size, d = list(range(n)), {i: 1 for i in range(n)}, {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        a, b = min(d, key=lambda p: (d[p], p))
        out.append((a, b, d[a, b], size[a] + size[b]))
        live = [x for x in live if x not in (a, b)]
        for x in live:
            da, db = (d[min(x, c), max(x, c)] for c in (a, b))
            d[x, new] = (size[a] * da + size[b] * db) / (size[a] + size[b])
        d = {p: v for p, v in d.items() if a not in p and b not in p}
        size[new] = size[a] + size[b]
        live.append(new)
    return out


def neighbour_layout(x: np.ndarray, perplexity: float = 5.0, rounds: int = 250, seed: int = 0) -> np.ndarray:
    """Exact t-SNE of a bounded table, from its first two principal components."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.zeros((n, n))
    goal = np.log(min(perplexity, n - 1))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(60):
            w = np.exp(-beta * (d[i] - np.delete(d[i], i).min()))
            w[i] = 0
            q = w / w.sum()
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            if abs(h - goal) < 1e-6:
                break
            lo, hi = (beta, hi) if h > goal else (lo, beta)
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    c = x - x.mean(0)
    y = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    y = 1e-2 * y / max(1e-12, y.std())
    speed = np.zeros_like(y)
    for k in range(rounds):
        w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(w, 0)
        g = (p * (4 if k < 60 else 1) - w / w.sum()) * w
        grad = 4 * (np.diag(g.sum(1)) - g) @ y
        speed = (0.5 if k < 60 else 0.8) * speed - min(50.0, n) * grad
        y = y + speed
    return y - y.mean(0)
