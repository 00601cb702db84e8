"""Special functions and distributions over arrays: a call answers for a whole batch of rows at once.

Arguments are arrays of one shape, or numbers; an argument for which no honest answer exists refuses the call. Series and
continued fractions run over all elements until the last has settled to the machine's precision; a continued fraction is the
quotient of two linear recurrences, which are scaled down together before they overflow. Quantiles are found by bisection of
all elements side by side, down to neighbouring numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

PRECISION = float(np.finfo(float).eps)
MOST_STEPS = 200_000


class Refused(ValueError):
    """An argument for which no honest answer exists."""


def need(ok, why: str) -> None:
    """Refuse unless the condition holds for every element."""
    if not np.all(ok):
        raise Refused(why)


def _arrays(*values) -> list[np.ndarray]:
    return [np.array(v, float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in values))]


def _each(f: Callable[[float], float]) -> Callable:
    """A function of the standard library, over an array."""

    def over(x):
        x = np.asarray(x, float)
        return np.fromiter(map(f, x.ravel().tolist()), float, x.size).reshape(x.shape)

    return over


erf, erfc = _each(math.erf), _each(math.erfc)
_gammaln = _each(math.lgamma)


def gammaln(x):
    x = np.asarray(x, float)
    need(~((x <= 0) & (x == np.floor(x))), "log gamma has a pole at whole numbers up to 0")
    return _gammaln(x)


def _where(which: np.ndarray, f: Callable, g: Callable, *args: np.ndarray) -> np.ndarray:
    """`f` of the elements in `which`, `g` of the others."""
    out = np.empty(which.shape)
    for part, h in ((which, f), (~which, g)):
        if part.any():
            out[part] = h(*(a[part] for a in args))
    return out


def _settle(step: Callable[[int, np.ndarray], np.ndarray], size: int) -> None:
    """Take steps until no element asks for more. `step` gets the step's number and the elements that go on, and gives those
    that are to go on still."""
    left = np.arange(size)
    for k in range(1, MOST_STEPS):
        left = step(k, left)
        if not len(left):
            return
    raise Refused("a series did not settle")


def _quotient(numerator: Callable[[int, np.ndarray], np.ndarray], denominator: Callable[[int, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """1 / (d1 + n1 / (d2 + n2 / (d3 + ...))) of `size` elements: the convergents' tops and bottoms obey one recurrence.
    `numerator(k, which)` is n_k of the chosen elements, `denominator(k, which)` is d_k."""
    everything = np.arange(size)
    top, bottom = np.zeros((2, size)), np.ones((2, size))  # convergents k - 1 and k
    top[1], bottom[1] = 1.0, denominator(1, everything)
    value, calm = top[1] / bottom[1], np.zeros(size, int)

    def step(k: int, left: np.ndarray) -> np.ndarray:
        n, d = numerator(k, left), denominator(k + 1, left)
        for pair in (top, bottom):
            pair[0, left], pair[1, left] = pair[1, left], d * pair[1, left] + n * pair[0, left]
        large = left[np.abs(bottom[1, left]) > 1e120]
        scale = np.abs(bottom[1, large])
        top[:, large] /= scale
        bottom[:, large] /= scale
        with np.errstate(divide="ignore", invalid="ignore"):
            new = top[1, left] / bottom[1, left]
        still = ~(np.abs(new - value[left]) <= PRECISION * np.abs(new))
        value[left] = new
        calm[left] = np.where(still, 0, calm[left] + 1)
        return left[calm[left] < 2]  # odd and even convergents come from either side

    _settle(step, size)
    return value


# Incomplete gamma
def _gamma_scale(a, x):
    return np.exp(a * np.log(x) - x - _gammaln(a))


def _gamma_below(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) by powers of x over rising factorials of a."""
    power = 1 / a
    total = power.copy()

    def step(k: int, left: np.ndarray) -> np.ndarray:
        power[left] *= x[left] / (a[left] + k)
        total[left] += power[left]
        return left[power[left] > PRECISION / 2 * total[left]]

    _settle(step, len(a))
    return total * _gamma_scale(a, x)


def _gamma_above(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x) by Legendre's continued fraction."""
    return _gamma_scale(a, x) * _quotient(lambda k, i: k * (a[i] - k), lambda k, i: x[i] - a[i] + (2 * k - 1), len(a))


def _gamma(a, x, upper: bool):
    a, x = _arrays(a, x)
    need((a > 0) & (x >= 0), "gamma_q needs a > 0 and x >= 0" if upper else "gamma_p needs a > 0 and x >= 0")
    out = np.where(x == 0, 0.0, 1.0)
    out = 1 - out if upper else out
    inner = (x > 0) & np.isfinite(x)
    if upper:
        out[inner] = _where(x[inner] < a[inner] + 1, lambda a, x: 1 - _gamma_below(a, x), _gamma_above, a[inner], x[inner])
    else:
        out[inner] = _where(x[inner] < a[inner] + 1, _gamma_below, lambda a, x: 1 - _gamma_above(a, x), a[inner], x[inner])
    return out


def gamma_p(a, x):
    """Regularised lower incomplete gamma."""
    return _gamma(a, x, False)


def gamma_q(a, x):
    """Its complement, exact in the tail."""
    return _gamma(a, x, True)


# Incomplete beta
def _beta_side(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) where x is below the mean: there the fraction settles fast."""

    def numerator(k: int, i: np.ndarray) -> np.ndarray:
        m, p, q = k // 2, a[i], b[i]
        top = m * (q - m) if k % 2 == 0 else -(p + m) * (p + q + m)
        return top * x[i] / ((p + k - 1) * (p + k))

    fraction = _quotient(numerator, lambda k, i: np.ones(len(i)), len(a))
    return fraction * np.exp(a * np.log(x) + b * np.log1p(-x) + _gammaln(a + b) - _gammaln(a + 1) - _gammaln(b))


def beta_i(a, b, x):
    """Regularised incomplete beta."""
    a, b, x = _arrays(a, b, x)
    need((a > 0) & (b > 0), "beta_i needs positive shapes")
    need((x >= 0) & (x <= 1), "beta_i needs x in [0, 1]")
    out = x.copy()
    inner = (x > 0) & (x < 1)
    a, b, x = a[inner], b[inner], x[inner]
    out[inner] = _where(x * (a + b + 2) < a + 1, _beta_side, lambda a, b, x: 1 - _beta_side(b, a, 1 - x), a, b, x)
    return out


# Normal
def norm_cdf(x):
    return erfc(np.asarray(x, float) / -math.sqrt(2)) / 2


def norm_sf(x):
    return norm_cdf(-np.asarray(x, float))


def norm_pdf(x):
    x = np.asarray(x, float)
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _share(p) -> None:
    need((np.asarray(p) >= 0) & (np.asarray(p) <= 1), "a probability lies in [0, 1]")


_STANDARD = NormalDist()


def norm_inv(p):
    _share(p)
    (p,) = _arrays(p)
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, 0.0))
    inner = (p > 0) & (p < 1) & (p != 0.5)
    q = p[inner]
    x = _each(_STANDARD.inv_cdf)(q)
    for _ in range(2):  # Newton's steps, on the side where the difference is exact
        density = norm_pdf(x)
        off = np.where(x < 0, norm_cdf(x) - q, (1 - q) - norm_sf(x))
        x = x - np.divide(off, density, out=np.zeros_like(x), where=density > 1e-280)
    out[inner] = x
    return out


def _deviation(sd) -> None:
    need(np.asarray(sd) > 0, "a deviation is positive")


def normal_cdf(x, mean, sd):
    _deviation(sd)
    return norm_cdf((np.asarray(x, float) - mean) / sd)


def normal_inv(p, mean, sd):
    _deviation(sd)
    return mean + sd * norm_inv(p)


def lognorm_cdf(x, mu, sigma):
    _deviation(sigma)
    x, mu, sigma = _arrays(x, mu, sigma)
    return _where(x > 0, lambda x, mu, sigma: norm_cdf((np.log(x) - mu) / sigma), lambda x, mu, sigma: np.zeros(len(x)), x, mu, sigma)


def lognorm_inv(p, mu, sigma):
    return np.exp(normal_inv(p, mu, sigma))


# Quantiles of the others
def invert(below: Callable[..., np.ndarray], start: np.ndarray, *args: np.ndarray) -> np.ndarray:
    """The least x >= 0 that is not `below(x, *args)`: doubled from `start` until it is above, then bisected."""
    low, high = np.zeros(len(start)), start.copy()
    left = np.arange(len(start))
    while len(left):
        left = left[below(high[left], *(a[left] for a in args)) & (high[left] < 1e300)]
        low[left] = high[left]
        high[left] *= 2
    endless = high >= 1e300
    left = np.flatnonzero(~endless)
    while len(left):
        middle = (low[left] + high[left]) / 2
        open_ = (middle > low[left]) & (middle < high[left]) & (middle > 1e-300)
        left, middle = left[open_], middle[open_]
        if len(left):
            up = below(middle, *(a[left] for a in args))
            low[left[up]], high[left[~up]] = middle[up], middle[~up]
    return np.where(endless, np.inf, (low + high) / 2)


def _freedom(*df) -> None:
    for d in df:
        need(np.asarray(d) > 0, "degrees of freedom are positive")


def t_sf(t, df):
    _freedom(df)
    t, df = _arrays(t, df)
    square = np.where(np.isfinite(t), t * t, 0)
    half = np.where(np.isfinite(t), beta_i(df / 2, 0.5, df / (df + square)) / 2, 0.0)
    return np.where(t >= 0, half, 1 - half)


def t_cdf(t, df):
    return t_sf(-np.asarray(t, float), df)


def t_two_sided(t, df):
    return 2 * t_sf(np.abs(t), df)


def t_pdf(t, df):
    _freedom(df)
    t, df = _arrays(t, df)
    return np.exp(_gammaln((df + 1) / 2) - _gammaln(df / 2) - np.log(df * math.pi) / 2 - (df + 1) / 2 * np.log1p(t * t / df))


def t_inv(p, df):
    _share(p)
    _freedom(df)
    p, df = _arrays(p, df)
    out = np.where(p == 0, -np.inf, np.where(p == 1, np.inf, 0.0))
    inner = (p > 0) & (p < 1) & (p != 0.5)
    tail = np.minimum(p, 1 - p)[inner]
    x = invert(lambda x, tail, df: t_sf(x, df) > tail, np.ones(len(tail)), tail, df[inner])
    out[inner] = np.where(p[inner] < 0.5, -x, x)
    return out


def _positive_quantile(p, cdf: Callable[..., np.ndarray], start: Callable[..., np.ndarray], *args):
    """Quantiles of a distribution over positive numbers."""
    _share(p)
    p, *args = _arrays(p, *args)
    out = np.where(p == 1, np.inf, 0.0)
    inner = (p > 0) & (p < 1)
    own = [a[inner] for a in args]
    out[inner] = invert(lambda x, q, *rest: cdf(x, *rest) < q, start(*own), p[inner], *own)
    return out


def _mass(x, what: str) -> None:
    need(np.asarray(x) >= 0, f"{what} has no mass below 0: x >= 0")


def chisq_cdf(x, df):
    _freedom(df)
    _mass(x, "chi-squared")
    return gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chisq_sf(x, df):
    _freedom(df)
    _mass(x, "chi-squared")
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chisq_inv(p, df):
    _freedom(df)
    return _positive_quantile(p, chisq_cdf, lambda df: np.maximum(df, 1.0), df)


def f_cdf(x, a, b):
    _freedom(a, b)
    x, a, b = _arrays(np.maximum(x, 0), a, b)
    return beta_i(a / 2, b / 2, a * x / (a * x + b))


def f_sf(x, a, b):
    _freedom(a, b)
    x, a, b = _arrays(np.maximum(x, 0), a, b)
    return beta_i(b / 2, a / 2, b / (b + a * x))


def f_inv(p, a, b):
    _freedom(a, b)
    return _positive_quantile(p, f_cdf, lambda a, b: np.ones(len(a)), a, b)


def gamma_cdf(x, shape, scale):
    need((np.asarray(shape) > 0) & (np.asarray(scale) > 0), "shape and scale are positive")
    _mass(x, "the gamma distribution")
    return gamma_p(shape, np.asarray(x, float) / scale)


def beta_cdf(x, a, b):
    return beta_i(a, b, x)


# Counts
def _count(k) -> None:
    need((np.asarray(k) >= 0) & (np.asarray(k) == np.floor(k)), "a count is whole and not negative")


def binom_pmf(k, n, p):
    _count(k)
    _count(n)
    _share(p)
    k, n, p = _arrays(k, n, p)
    need(k <= n, "more successes than trials")
    sure = (p == 0) | (p == 1)
    inner = lambda k, n, p: np.exp(_gammaln(n + 1) - _gammaln(k + 1) - _gammaln(n - k + 1) + k * np.log(p) + (n - k) * np.log1p(-p))
    return _where(sure, lambda k, n, p: (k == n * p).astype(float), inner, k, n, p)


def binom_cdf(k, n, p):
    _count(k)
    _count(n)
    _share(p)
    k, n, p = _arrays(k, n, p)
    return _where(k >= n, lambda k, n, p: np.ones(len(k)), lambda k, n, p: beta_i(n - k, k + 1, 1 - p), k, n, p)


def _rate(rate) -> None:
    need(np.asarray(rate) > 0, "a rate is positive")


def poisson_pmf(k, rate):
    _count(k)
    _rate(rate)
    k, rate = _arrays(k, rate)
    return np.exp(k * np.log(rate) - rate - _gammaln(k + 1))


def poisson_cdf(k, rate):
    _count(k)
    _rate(rate)
    return gamma_q(np.asarray(k, float) + 1, rate)
