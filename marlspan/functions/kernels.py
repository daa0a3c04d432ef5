"""Numerics that have no SQL form, for grouped functions: special functions,
unit-root and causality tests, shrinkage, linkage, Markov switching. Written
from the published formulas with numpy alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

# MacKinnon (2010) response surface for the ADF distribution with a constant, one and two variables.
TAU = {1: {0.01: -3.43035, 0.05: -2.86154, 0.1: -2.56677}, 2: {0.01: -3.89644, 0.05: -3.33613, 0.1: -3.04445}}
# MacKinnon (1994) approximate p-values with a constant: small and large tau polynomials and limits.
SMALL_P = {1: (2.1659, 1.4412, 0.038269), 2: (2.92, 1.5012, 0.039796)}
LARGE_P = {1: (1.7339, 0.93202, -0.12745, -0.010368), 2: (2.1945, 0.64695, -0.29198, -0.042377)}
TAU_LIMITS = {1: (-18.83, -1.61, 2.74), 2: (-18.86, -2.62, 0.92)}
# KPSS (1992) critical values for a level.
KPSS_LEVELS = {0.1: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}
# Trace statistics at 5 % with a constant, for one and two remaining relations (Osterwald-Lenum 1992).
TRACE_95 = {1: 3.8415, 2: 15.4943}


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) / a


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_p(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(x, k):
        if x is None or x != x or k <= 2:
            return None
        return 0.0 if abs(x) >= 1 else t_p(x * math.sqrt((k - 2) / (1 - x * x)), k - 2)

    return pd.Series([one(x, k) for x, k in zip(r, n)], dtype="float64")


def spearman(a, b) -> float | None:
    x, y = pd.Series(a).rank(), pd.Series(b).rank()
    return None if x.std() == 0 or y.std() == 0 else float(np.corrcoef(x, y)[0, 1])


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and (X'X)^-1."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    return beta, y - x @ beta, inv


def ols_hac(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    n = len(a)
    x = np.column_stack([np.ones(n), a])
    beta, e, inv = ols(b, x)
    lags = int(4 * (n / 100) ** (2 / 9))
    u = x * e[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    se = math.sqrt(max((inv @ s @ inv)[1, 1], 0.0))
    t = beta[1] / se if se else math.nan
    return float(beta[1]), float(beta[0]), float(t), t_p(t, n - 2)


def adf_p(tau: float, variables: int = 1) -> float:
    low, star, high = TAU_LIMITS[variables]
    if tau > high:
        return 1.0
    if tau < low:
        return 0.0
    poly = SMALL_P[variables] if tau <= star else LARGE_P[variables]
    return normal_cdf(sum(c * tau ** i for i, c in enumerate(poly)))


def adf(y: np.ndarray, constant: bool = True) -> float:
    """The ADF statistic; the number of lagged differences is chosen by AIC."""
    n = len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(y)

    def fit(k: int, skip: int):
        rows = np.arange(skip, len(d))
        cols = [y[rows]] + [d[rows - i] for i in range(1, k + 1)] + ([np.ones(len(rows))] if constant else [])
        x = np.column_stack(cols)
        beta, e, inv = ols(d[rows], x)
        s2 = e @ e / max(1, len(rows) - x.shape[1])
        aic = len(rows) * math.log(max(e @ e / len(rows), 1e-300)) + 2 * x.shape[1]
        return aic, beta[0] / math.sqrt(max(s2 * inv[0, 0], 1e-300))

    best = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return float(fit(best, best)[1])


def kpss(y: np.ndarray) -> float:
    e = y - y.mean()
    n = len(y)
    lags = int(math.ceil(12 * (n / 100) ** 0.25))
    var = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    s = np.cumsum(e)
    return float(s @ s / (n * n * var)) if var > 0 else math.nan


LEAST = 20


def usable(*columns: np.ndarray) -> bool:
    """Whether a test can be made: rows enough, all finite, nothing constant."""
    return all(len(x) >= LEAST and np.isfinite(x).all() and np.ptp(x) > 0 for x in columns)


def adf_kpss(y: np.ndarray) -> tuple[float, float, float, str]:
    if not usable(y):
        return math.nan, math.nan, math.nan, "insufficient"
    tau, k = adf(y), kpss(y)
    p = adf_p(tau)
    rejects_root, rejects_level = p < 0.05, k > KPSS_LEVELS[0.05]
    verdict = "stationary" if rejects_root and not rejects_level else "I(1)-like" if rejects_level and not rejects_root else "ambiguous"
    return tau, p, k, verdict


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    if not usable(a, b):
        return math.nan, math.nan, math.nan
    beta, e, _ = ols(b, np.column_stack([np.ones(len(a)), a]))
    if np.ptp(e) <= 1e-12 * np.ptp(b):  # one is a multiple of the other: nothing is left to test
        return float(beta[1]), math.nan, math.nan
    tau = adf(e, constant=False)
    return float(beta[1]), tau, adf_p(tau, 2)


def johansen(a: np.ndarray, b: np.ndarray) -> tuple[float, float, int | None]:
    if not usable(a, b):
        return math.nan, math.nan, None
    y = np.column_stack([a, b])
    d = np.diff(y, axis=0)
    z0, z1, z2 = d[1:], y[1:-1], np.column_stack([np.ones(len(d) - 1), d[:-1]])
    r0 = z0 - z2 @ np.linalg.lstsq(z2, z0, rcond=None)[0]
    r1 = z1 - z2 @ np.linalg.lstsq(z2, z1, rcond=None)[0]
    n = len(r0)
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    eig = np.sort(np.real(np.linalg.eigvals(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01)))[::-1].clip(0, 1 - 1e-12)
    trace = [-n * np.log(1 - eig[i:]).sum() for i in range(2)]
    rank = 0 if trace[0] <= TRACE_95[2] else 1 if trace[1] <= TRACE_95[1] else 2
    return float(trace[0]), float(trace[1]), rank


def granger(x: np.ndarray, y: np.ndarray, most: int) -> tuple[int | None, float, float]:
    """Whether the past of ``x`` helps to predict ``y``; nothing on fewer than
    five rows a lag and ten more."""
    if not usable(x, y) or len(y) < 5 * most + 10:
        return None, math.nan, math.nan
    def design(k: int, skip: int):
        rows = np.arange(skip, len(y))
        own = np.column_stack([np.ones(len(rows))] + [y[rows - i] for i in range(1, k + 1)])
        return y[rows], own, np.column_stack([own] + [x[rows - i] for i in range(1, k + 1)])

    def aic(k: int) -> float:
        t, _, both = design(k, most)
        e = ols(t, both)[1]
        return len(t) * math.log(max(e @ e / len(t), 1e-300)) + 2 * both.shape[1]

    most = max(1, min(most, (len(y) - 4) // 4))
    k = min(range(1, most + 1), key=aic)
    t, own, both = design(k, k)
    e0, e1 = ols(t, own)[1], ols(t, both)[1]
    free = len(t) - both.shape[1]
    f = ((e0 @ e0 - e1 @ e1) / k) / (e1 @ e1 / free) if free > 0 and e1 @ e1 > 0 else math.nan
    return k, float(f), f_p(f, k, free)


def ledoit_wolf(s: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Shrunk covariance towards a scaled identity, and the intensity, from the
    covariances ``s`` and the means ``q`` of products of squared deviations."""
    p = len(s)
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (q - s ** 2).sum() / (n * p))
    k = b2 / d2 if d2 else 0.0
    return (1 - k) * s + k * mu * np.eye(p), float(k)


def average_merges(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of average linkage by height, each as two leaves of the groups
    that it joins. A chain goes from group to nearest group until two are each
    other's nearest, so every merge costs a few rows of the matrix."""
    d, size = dist.astype("float64").copy(), np.ones(len(dist))
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(len(d), bool), [], []
    while len(merges) < len(d) - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]  # of equally near ones the one before, or the chain would not end
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((i, j, float(d[i, j])))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        size[i] += size[j]
        alive[j] = False
    return sorted(merges, key=lambda m: m[2])


def _cheapest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over all k the least ``a[i, k] + b[k, j]``."""
    out = np.full((len(a), b.shape[1]), np.inf)
    for i in range(len(a)):
        out[i] = (a[i][:, None] + b).min(axis=0)
    return out


def leaf_order(dist: np.ndarray, merges: list[tuple[int, int, float]]) -> list[int]:
    """Of all orders that turn branches of the tree around, one whose neighbours
    are nearest in all. For each branch the least cost is kept for each pair of
    leaves at its ends; on the way back the ends that gave it are found again."""
    root_of = list(range(len(dist)))

    def root(i: int) -> int:
        while root_of[i] != i:
            root_of[i] = root_of[root_of[i]]
            i = root_of[i]
        return i

    # per branch: its leaves, the least costs by left and right end, and the two branches it joins
    branch = {i: (np.array([i]), np.zeros((1, 1)), None) for i in range(len(dist))}
    for i, j, _ in merges:
        left, right = root(i), root(j)
        x, y = branch[left], branch[right]
        across = _cheapest(_cheapest(x[1], dist[np.ix_(x[0], y[0])]), y[1])
        n = len(x[0])
        cost = np.full((n + len(y[0]),) * 2, np.inf)
        cost[:n, n:], cost[n:, :n] = across, across.T
        root_of[right] = left
        branch[left] = (np.r_[x[0], y[0]], cost, (x, y))

    def told(node, u: int, w: int) -> list[int]:  # noqa: ANN001
        leaves, _, parts = node
        if parts is None:
            return [int(leaves[0])]
        x, y = parts
        n = len(x[0])
        if u >= n:  # the other branch is on the left
            return told(node, w, u)[::-1]
        between = x[1][u][:, None] + dist[np.ix_(x[0], y[0])] + y[1][:, w - n][None, :]
        m, k = np.unravel_index(int(between.argmin()), between.shape)
        return told(x, u, int(m)) + told(y, int(k), w - n)

    whole = branch[root(0)]
    if whole[2] is None:
        return [0]
    return told(whole, *map(int, np.unravel_index(int(whole[1].argmin()), whole[1].shape)))


def average_linkage(dist: np.ndarray, cut: float) -> tuple[list[int], list[int]]:
    """Clusters at height ``cut``, named by their first leaf, and the best order of the leaves."""
    merges, label = average_merges(dist), np.arange(len(dist))
    for i, j, h in merges:
        if h <= cut:
            a, b = label[i], label[j]
            label[(label == a) | (label == b)] = min(a, b)
    return label.tolist(), leaf_order(dist, merges)


def universe(s: np.ndarray, q: np.ndarray, n: int):
    cov, k = ledoit_wolf(s, q, n)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    share = float(np.linalg.eigvalsh(corr)[-1] / len(corr))
    label, order = average_linkage(np.sqrt(np.clip((1 - corr) / 2, 0, None)), 0.6)
    return k, share, label, np.argsort(order).tolist()


def rolling_spearman(a: np.ndarray, b: np.ndarray, window: int, least: int) -> np.ndarray:
    """Spearman over the last ``window`` rows at each row, of ``least`` rows on;
    ranks of ties are means. All windows of a chunk are ranked at once."""
    out = np.full(len(a), np.nan)

    def ranks(x: np.ndarray) -> np.ndarray:
        below, same = (x[:, None, :] < x[:, :, None]).sum(axis=2), (x[:, None, :] == x[:, :, None]).sum(axis=2)
        return below + (same + 1) / 2

    def rho(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = ranks(x), ranks(y)
        x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))

    for n in range(least, min(window, len(a) + 1)):
        out[n - 1] = rho(a[None, :n], b[None, :n])[0]
    if len(a) >= window:
        wa, wb = np.lib.stride_tricks.sliding_window_view(a, window), np.lib.stride_tricks.sliding_window_view(b, window)
        step = max(1, 4_000_000 // window ** 2)
        for i in range(0, len(wa), step):
            out[window - 1 + i:window - 1 + i + step] = rho(wa[i:i + step], wb[i:i + step])
    return out


def markov_two_states(y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Smoothed probability of the state with the larger deviation, by EM on a
    two-state switching mean and variance."""
    mid = np.median(np.abs(y - y.mean()))
    wild = np.abs(y - y.mean()) > mid
    mean = np.array([y[~wild].mean(), y[wild].mean()])
    var = np.array([max(y[~wild].var(), 1e-12), max(y[wild].var(), 1e-12)])
    move = np.array([[0.95, 0.05], [0.05, 0.95]])
    for _ in range(rounds):
        dens = np.exp(-0.5 * (y[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        ahead, back = np.empty((len(y), 2)), np.ones((len(y), 2))
        p = np.array([0.5, 0.5])
        for t in range(len(y)):
            p = (p if t == 0 else p @ move) * dens[t]
            p /= p.sum()
            ahead[t] = p
        for t in range(len(y) - 2, -1, -1):
            back[t] = move @ (dens[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        smooth = ahead * back
        smooth /= smooth.sum(axis=1, keepdims=True)
        joint = ahead[:-1, :, None] * move * (dens[1:] * back[1:])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        w = smooth.sum(axis=0)
        new = (smooth * y[:, None]).sum(axis=0) / w
        var = np.maximum((smooth * (y[:, None] - new) ** 2).sum(axis=0) / w, 1e-12)
        move = joint.sum(axis=0) / joint.sum(axis=(0, 2))[:, None]
        if np.abs(new - mean).max() < 1e-9:
            break
        mean = new
    return smooth[:, int(np.argmax(var))]


def bisect(f, low: np.ndarray, high: np.ndarray, steps: int = 60) -> np.ndarray:
    """Roots of ``f``, elementwise, between ``low`` and ``high``; nan where both ends have one sign."""
    a = f(low)
    none = ~(a * f(high) <= 0)
    for _ in range(steps):
        mid = 0.5 * (low + high)
        m = f(mid)
        left = a * m <= 0
        high, low, a = np.where(left, mid, high), np.where(left, low, mid), np.where(left, a, m)
    return np.where(none, np.nan, 0.5 * (low + high))
