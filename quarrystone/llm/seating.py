"""Gibbs draws for Pitman-Yor restaurants of which only customers and tables of each dish are known.

Given its customers c and its tables t, the seating of a dish can be any of
S_d(c, t) weighted arrangements (generalised Stirling numbers). Summed over
them, the conditional of t given all other dishes is a finite distribution that
is drawn from directly: the same chain that removes the dish's customers and
seats them again, with no seating to remember.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Dishes of more customers than these are drawn from an asymptotic form.
EXACT = 256
#: Dishes are drawn in so many blocks, by chance; within a block all see the tables as they were before it.
BLOCKS = 8
_EDGES = (2, 3, 4, 5, 6, 8, 10, 13, 16, 21, 27, 35, 46, 60, 80, 105, 140, 190, EXACT + 1)
_CELLS = 1 << 20


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers."""
    x = np.asarray(x, float)
    z = x + 7
    low = np.log(x)
    for k in range(1, 7):
        low = low + np.log(x + k)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


@lru_cache(maxsize=64)
def log_stirling(d: float) -> np.ndarray:
    """[c, t] -> log S_d(c, t) for c up to EXACT; -inf where t is 0 or above c."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(invalid="ignore", divide="ignore"):
            stay = np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(stay, out[c, :-1])
    return out


@lru_cache(maxsize=64)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the generating function ((1-(1-x)**d)/d)**t has its saddle for customers a table s: log s, log f, log x and log curvature."""
    z = np.geomspace(1e-5, 600, 4000)
    one = -np.expm1(-d * z)
    log_f = np.log(one / d)
    log_x = np.log(-np.expm1(-z))
    log_s = np.log(d) + log_x + z * (1 - d) - np.log(one)
    curve = log_s + np.log(np.maximum(np.gradient(log_s, z), 1e-12)) + log_x + z  # x * dg/dx
    return log_s, log_f, log_x, curve


def log_stirling_of(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t): exact up to EXACT customers and for one table or one customer a table, else by the saddle point."""
    c, t = np.asarray(c, float), np.asarray(t, float)
    out = np.zeros(len(c))
    small = c <= EXACT
    out[small] = log_stirling(d)[c[small].astype(int), t[small].astype(int)]
    lone = ~small & (t <= 1)
    out[lone] = lgamma(c[lone] - d) - lgamma(np.array(1 - d))
    rest = np.flatnonzero(~small & (t > 1) & (t < c))
    if len(rest):
        a, b = c[rest], t[rest]
        log_s, log_f, log_x, curve = _saddle(d)
        at = np.log(a / b)
        f, x, v = (np.interp(at, log_s, y) for y in (log_f, log_x, curve))
        out[rest] = lgamma(a + 1) - lgamma(b + 1) + b * f - a * x - 0.5 * (np.log(2 * np.pi * b) + v)
    return out


def tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, drawn given the tables of their restaurants' other dishes.

    P(t) ~ S_d(c, t) * p**t * prod over j < t of (theta + d * (others + j)), where
    p is the parent's probability of the dish. Above EXACT customers, t - 1 is
    a Poisson number whose mean solves the ratio of neighbouring terms.
    """
    t = np.minimum(c, 1).astype(float)
    order = np.argsort(c, kind="stable")
    by = c[order]
    log_s = log_stirling(d)
    for lo, hi in zip(_EDGES[:-1], _EDGES[1:], strict=True):
        a, z = np.searchsorted(by, (lo, hi))
        most = hi - 1
        for i in range(a, z, max(1, _CELLS // most)):
            at = order[i : min(z, i + max(1, _CELLS // most))]
            k = np.arange(1, most + 1)
            w = np.cumsum(np.log(theta + d * (others[at][:, None] + (k - 1))) + np.log(p[at])[:, None], 1)
            w += log_s[c[at].astype(int), 1 : most + 1]
            w -= w.max(1, keepdims=True)
            cum = np.cumsum(np.exp(w), 1)
            t[at] = 1 + (cum < (rng.random(len(at)) * cum[:, -1])[:, None]).sum(1)
    at = order[np.searchsorted(by, EXACT + 1) :]
    if len(at):
        log_x, log_f = _saddle(d)[:2]
        n, mean = c[at].astype(float), np.ones(len(at))
        for _ in range(30):
            mean = np.minimum(1 + (theta + d * (others[at] + mean)) * p[at] * np.exp(np.interp(np.log(n / mean), log_x, log_f)), n)
        t[at] = np.minimum(1 + rng.poisson(np.minimum(mean - 1, 1e15)), n)
    return t


def sweep(c: np.ndarray, t: np.ndarray, whose: np.ndarray, total: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """New tables of all dishes, block by block. whose: the restaurant of each dish; total: tables of each restaurant (changed along)."""
    t = t.astype(float)
    block = rng.integers(BLOCKS, size=len(c))
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(BLOCKS + 1))
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        at = order[a:z]
        new = tables(c[at], total[whose[at]] - t[at], p[at], d, theta, rng)
        total += np.bincount(whose[at], new - t[at], len(total))
        t[at] = new
    return t


def parameters(d: float, theta: float, restaurants: tuple, customers: tuple, cells: tuple, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength, each drawn from its conditional over a grid that closes in three times.

    restaurants: tables and how many restaurants have so many; customers: the
    same of customers; cells: customers, tables and how many dishes have them.
    Priors: uniform and exponential with mean 1.
    """
    if not len(cells[0]) or not len(restaurants[0]):
        return d, theta
    held, number = (np.asarray(x, float) for x in restaurants)
    guests, times = (np.asarray(x, float) for x in customers)
    c, t, n = (np.asarray(x, float) for x in cells)

    def likely(d: float, theta: float) -> float:
        seats = float((n * log_stirling_of(c, t, d)).sum())
        opened = float((number * ((held - 1) * np.log(d) + lgamma(theta / d + held) - lgamma(theta / d + 1))).sum())
        return seats + opened - float((times * (lgamma(theta + guests) - lgamma(np.array(theta + 1)))).sum()) - theta

    def drawn(f, low: float, high: float) -> float:
        for _ in range(3):
            grid = np.linspace(low, high, 9)
            w = np.array([f(x) for x in grid])
            w = np.exp(w - w.max())
            x, step = float(rng.choice(grid, p=w / w.sum())), (high - low) / 8
            low, high = max(low, x - step), min(high, x + step)
        return x

    # rounded, so that tables of Stirling numbers are met again
    d = round(drawn(lambda x: likely(round(x, 3), theta), 0.02, 0.98), 3)
    return d, float(np.exp(drawn(lambda x: likely(d, float(np.exp(x))) + x, np.log(0.01), np.log(1000.0))))
