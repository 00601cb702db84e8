"""Kernels over vectors and matrices that Spark's own expressions do not give. Each takes a batch: vectors of one length as the
rows of a matrix, numbers as an array, and answers for all rows at once with numpy's stacked linear algebra. An answer that
does not exist without being an error (a share of no variation) is NaN in a masked array, which becomes null."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions.special import chisq_sf, f_sf, need, norm_cdf, t_two_sided

CLOSE, CLOSE_AT_ZERO = 1e-9, 1e-12  # how far a matrix may be from its transpose
SINGULAR = 1e15  # condition numbers from here on


def _square(a: np.ndarray) -> np.ndarray:
    n = math.isqrt(a.shape[1])
    need(n * n == a.shape[1] and n > 0, "the matrix is not square")
    return a.reshape(-1, n, n)


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(len(m), -1)


def mat_determinant(a):
    return np.linalg.det(_square(a))


def _regular(m: np.ndarray) -> np.ndarray:
    need(np.linalg.cond(m) < SINGULAR, "the matrix is singular")
    return m


def mat_inverse(a):
    return _flat(np.linalg.inv(_regular(_square(a))))


def mat_solve(a, b):
    m = _square(a)
    need(b.shape[1] == m.shape[1], "the right-hand side has another length")
    return np.linalg.solve(_regular(m), b[:, :, None])[:, :, 0]


def mat_multiply(a, b):
    return _flat(_square(a) @ _square(b))


def _is_symmetric(m: np.ndarray) -> np.ndarray:
    other = m.transpose(0, 2, 1)
    return (np.abs(m - other) <= CLOSE_AT_ZERO + CLOSE * np.abs(other)).all(axis=(1, 2))


def _symmetric(a: np.ndarray) -> np.ndarray:
    m = _square(a)
    need(_is_symmetric(m), "the matrix is not symmetric")
    return m


def mat_is_symmetric(a):
    return _is_symmetric(_square(a)).astype(float)


def mat_eigenvalues(a):
    return np.linalg.eigvalsh(_symmetric(a))[:, ::-1]


def mat_eigenvectors(a):
    v = np.linalg.eigh(_symmetric(a))[1][:, :, ::-1]
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
    return _flat(v * np.where(lead < 0, -1.0, 1.0))


def _lower_factor(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky's factor of every matrix, column by column, and whether there is one."""
    out, there = np.zeros_like(m), np.ones(len(m), bool)
    for j in range(m.shape[1]):
        rest = m[:, j:, j] - np.einsum("mik,mk->mi", out[:, j:, :j], out[:, j, :j])
        there &= rest[:, 0] > 0
        out[:, j:, j] = rest / np.sqrt(np.where(rest[:, 0] > 0, rest[:, 0], 1.0))[:, None]
    return out, there


def mat_cholesky(a):
    factor, there = _lower_factor(_symmetric(a))
    need(there, "the matrix is not positive definite")
    return _flat(factor)


def mat_is_positive_definite(a):
    m = _square(a)
    return (_lower_factor(m)[1] & _is_symmetric(m)).astype(float)


def _qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(_square(a))
    sign = np.where(np.diagonal(r, axis1=1, axis2=2) < 0, -1.0, 1.0)
    return q * sign[:, None, :], r * sign[:, :, None]


def mat_qr_q(a):
    return _flat(_qr(a)[0])


def mat_qr_r(a):
    return _flat(_qr(a)[1])


def mat_singular_values(a):
    return np.linalg.svd(_square(a), compute_uv=False)


# Regression
class Fit:
    """Least squares of every row's y on its design (rows, observations, predictors), about the mean."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        need(np.isfinite(x).all() and np.isfinite(y).all(), "an observation is not finite")
        self.n, self.p = x.shape[1:]
        need(self.n == y.shape[1] and self.n > self.p, "too few observations")
        need(np.linalg.matrix_rank(x) == self.p, "the predictors are dependent or constant")
        q, r = np.linalg.qr(x)
        back = np.linalg.inv(r)
        self.b = (back @ (q.transpose(0, 2, 1) @ y[:, :, None]))[:, :, 0]
        left = ((y - (x @ self.b[:, :, None])[:, :, 0]) ** 2).sum(axis=1)
        total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        self.r2 = np.ma.masked_array(1 - np.divide(left, total, out=np.full(len(y), np.nan), where=total != 0), total == 0)
        self.s = np.sqrt(left / (self.n - self.p))
        self.se = self.s[:, None] * np.sqrt((back**2).sum(axis=2))


def _line(x: np.ndarray, y: np.ndarray) -> Fit:
    need(x.shape[1] == y.shape[1], "the series have different lengths")
    return Fit(np.stack((np.ones_like(x), x), axis=2), y)


def regress_slope(x, y):
    return _line(x, y).b[:, 1]


def regress_intercept(x, y):
    return _line(x, y).b[:, 0]


def regress_r2(x, y):
    return _line(x, y).r2


def regress_adj_r2(x, y):
    f = _line(x, y)
    return 1 - (1 - f.r2) * (f.n - 1) / (f.n - f.p)


def regress_residual_error(x, y):
    return _line(x, y).s


def regress_stderr(x, y):
    return _line(x, y).se[:, 1]


def regress_tstat(x, y):
    f = _line(x, y)
    need(f.se[:, 1] > 0, "the fit is exact: the slope has no error")
    return f.b[:, 1] / f.se[:, 1]


def regress_pvalue(x, y):
    return t_two_sided(regress_tstat(x, y), x.shape[1] - 2)


def _by_width(f, x: np.ndarray, y: np.ndarray, p: np.ndarray, *more: np.ndarray):
    """`f` of the designs of each number of predictors."""
    need((p == np.floor(p)) & (p >= 1) & (x.shape[1] == y.shape[1] * p), "the design does not fit the response")
    width = int(p[0])  # one length of x and one of y leave one width
    return f(x.reshape(len(x), y.shape[1], width), y, *more)


def regress_multiple_r2(x, y, p):
    return _by_width(lambda d, y: Fit(d, y).r2, x, y, p)


def regress_multiple_f_p(x, y, p):
    f = _by_width(Fit, x, y, p)
    a, b = max(f.p - 1, 1), f.n - f.p
    whole = f.r2.filled(0.0)
    exact = whole >= 1
    ratio = np.divide(whole / a, (1 - whole) / b, out=np.zeros_like(whole), where=~exact)
    return np.ma.masked_array(np.where(exact, 0.0, f_sf(ratio, a, b)), np.ma.getmaskarray(f.r2))


def regress_ridge_norm(x, y, p, penalty):
    need(penalty >= 0, "a penalty is not negative")

    def length(d: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        pull = np.sqrt(penalty)[:, None, None] * np.eye(d.shape[2])
        a = np.concatenate((d, pull), axis=1)
        full = np.concatenate((y, np.zeros((len(y), d.shape[2]))), axis=1)
        b = np.linalg.pinv(a, rcond=np.finfo(float).eps * max(a.shape[1:])) @ full[:, :, None]
        return np.linalg.norm(b[:, :, 0], axis=1)

    return _by_width(length, x, y, p, penalty)


# Tests
def _var(a: np.ndarray) -> np.ndarray:
    need(a.shape[1] >= 2, "too few observations")
    return a.var(axis=1, ddof=1)


def ttest_1samp_t(a, m):
    s = np.sqrt(_var(a))
    need(s > 0, "the sample has no spread")
    return (a.mean(axis=1) - m) / (s / math.sqrt(a.shape[1]))


def ttest_1samp_df(a, m):
    _var(a)
    return np.full(len(a), a.shape[1] - 1.0)


def ttest_1samp_p(a, m):
    return t_two_sided(ttest_1samp_t(a, m), a.shape[1] - 1)


def ttest_df_welch(v1, n1, v2, n2):
    need((np.asarray(n1) > 1) & (np.asarray(n2) > 1) & (v1 >= 0) & (v2 >= 0) & (v1 + v2 > 0), "two samples with spread")
    p, q = v1 / n1, v2 / n2
    return (p + q) ** 2 / (p * p / (n1 - 1) + q * q / (n2 - 1))


def ttest_2samp_t(a, b):
    s = _var(a) / a.shape[1] + _var(b) / b.shape[1]
    need(s > 0, "the samples have no spread")
    return (a.mean(axis=1) - b.mean(axis=1)) / np.sqrt(s)


def ttest_2samp_df(a, b):
    return ttest_df_welch(_var(a), a.shape[1], _var(b), b.shape[1])


def ttest_2samp_p(a, b):
    return t_two_sided(ttest_2samp_t(a, b), ttest_2samp_df(a, b))


def ttest_paired_t(a, b):
    need(a.shape[1] == b.shape[1], "pairs need equal lengths")
    return ttest_1samp_t(a - b, 0.0)


def ttest_paired_p(a, b):
    return t_two_sided(ttest_paired_t(a, b), a.shape[1] - 1)


def chisq_test_t(o, e):
    need(o.shape[1] == e.shape[1] > 1 and (e > 0).all(), "expected counts are positive, one for each observed")
    return ((o - e) ** 2 / e).sum(axis=1)


def chisq_test_p(o, e):
    return chisq_sf(chisq_test_t(o, e), o.shape[1] - 1)


def f_test_t(a, b):
    v = _var(b)
    need(v > 0, "the second sample has no spread")
    return _var(a) / v


def f_test_p(a, b):
    f = f_test_t(a, b)
    need(f > 0, "the first sample has no spread")
    m, n = a.shape[1] - 1, b.shape[1] - 1
    return np.minimum(1.0, 2 * np.minimum(f_sf(f, m, n), f_sf(1 / f, n, m)))


def _powers(a: np.ndarray, least: int, what: str, power: int) -> np.ndarray:
    """Sums of powers of the z-scores."""
    s = np.sqrt(_var(a))
    need((a.shape[1] >= least) & (s > 0), what)
    return (((a - a.mean(axis=1, keepdims=True)) / s[:, None]) ** power).sum(axis=1)


def skewness(a):
    n = a.shape[1]
    return n / ((n - 1) * max(n - 2, 1)) * _powers(a, 3, "skewness needs three values with spread", 3)


def kurtosis(a):
    n = a.shape[1]
    sums = _powers(a, 4, "kurtosis needs four values with spread", 4)
    return n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * sums - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


def jarque_bera_t(a):
    return a.shape[1] / 6 * (skewness(a) ** 2 + kurtosis(a) ** 2 / 4)


def jarque_bera_p(a):
    return chisq_sf(jarque_bera_t(a), 2)


# Finance
def irr(flows):
    """Rates with zero present value: scanned outward from 0, first upwards, then bisected, then verified."""
    need(flows.shape[1] > 1 and ((flows > 0).any(axis=1) & (flows < 0).any(axis=1)).all(), "flows need both signs")
    at = np.arange(flows.shape[1])

    def value(which: np.ndarray, rates: np.ndarray) -> np.ndarray:
        return (flows[which] / (1 + rates)[:, None] ** at).sum(axis=1)

    everything = np.arange(len(flows))
    start = value(everything, np.zeros(len(flows)))
    low, high = np.full(len(flows), np.nan), np.full(len(flows), np.nan)
    low[start == 0] = high[start == 0] = 0.0
    for end in (1000.0, -0.999999):
        left = everything[np.isnan(low)]
        before, last = start[left], 0.0
        for k in range(1, 401):
            if not len(left):
                break
            here = end * (k / 400) ** 3
            now = value(left, np.full(len(left), here))
            crossed = before * now <= 0
            low[left[crossed]], high[left[crossed]] = last, here
            left, before, last = left[~crossed], now[~crossed], here
    need(~np.isnan(low), "no rate gives zero")
    for _ in range(200):
        middle = (low + high) / 2
        same = value(everything, low) * value(everything, middle) > 0
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    rates = (low + high) / 2
    need(np.abs(value(everything, rates)) <= 1e-6 * np.abs(flows).sum(axis=1), "no rate gives zero")
    return rates


def _d1(s, k, r, v, t):
    need((s > 0) & (k > 0) & (v > 0) & (t > 0), "spot, strike, volatility and time are positive")
    return (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))


def black_scholes_call(s, k, r, v, t):
    d = _d1(s, k, r, v, t)
    return s * norm_cdf(d) - k * np.exp(-r * t) * norm_cdf(d - v * np.sqrt(t))


def black_scholes_put(s, k, r, v, t):
    d = _d1(s, k, r, v, t)
    return k * np.exp(-r * t) * norm_cdf(v * np.sqrt(t) - d) - s * norm_cdf(-d)


def greeks_delta(s, k, r, v, t):
    return norm_cdf(_d1(s, k, r, v, t))
