"""The numeric function catalogue: names, arguments, and what each computes.

Functions that Spark's expressions can state are SQL functions (`CREATE TEMPORARY FUNCTION ... RETURN`), which Catalyst
inlines: they stay on the JVM and optimise with the query. The others are Arrow-backed kernels. Both kinds answer null for
a null argument and refuse, with a reason, what has no honest answer (a null element, unequal lengths, no spread).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessera.functions import kernels, special
from tessera.session import ship


@dataclass(frozen=True)
class Entry:
    name: str
    category: str
    takes: tuple[str, ...]  # vec or num
    gives: str
    about: str
    sql: str | None = None  # over a, b, c, d, e
    kernel: Any = None
    checks: tuple[tuple[str, str], ...] = ()  # refusals: condition, reason


SUM = "aggregate({0}, 0D, (s, x) -> s + x)"
LET = "element_at(transform(array({0}), {1} -> {2}), 1)"


def _sum(v: str) -> str:
    return SUM.format(v)


def _let(value: str, name: str, body: str) -> str:
    return LET.format(value, name, body)


def _mean(v: str) -> str:
    return f"({_sum(v)} / size({v}))"


# Moments are updated value by value (Welford), so an expression has no lambda inside a lambda: Spark cannot hand such an
# argument to a Python kernel.
def _squares(v: str) -> str:
    """Sum of squares about the mean."""
    return f"aggregate({v}, named_struct('n', 0D, 'm', 0D, 's', 0D), (s, x) -> named_struct('n', s.n + 1, 'm', s.m + (x - s.m) / (s.n + 1), 's', s.s + (x - s.m) * (x - s.m) * s.n / (s.n + 1)), s -> s.s)"


def _cross(p: str, q: str) -> str:
    """Sum of products about the means."""
    pairs = f"zip_with({p}, {q}, (y, z) -> named_struct('y', y, 'z', z))"
    return f"aggregate({pairs}, named_struct('n', 0D, 'm', 0D, 'k', 0D, 's', 0D), (s, x) -> named_struct('n', s.n + 1, 'm', s.m + (x.y - s.m) / (s.n + 1), 'k', s.k + (x.z - s.k) / (s.n + 1), 's', s.s + (x.y - s.m) * (x.z - s.k) * s.n / (s.n + 1)), s -> s.s)"


SAME = ("size(a) <> size(b)", "the vectors have different lengths")
FULL = ("size(a) = 0", "the vector is empty")
TWO = ("size(a) < 2", "at least two values are needed")
SPREAD = (f"size(a) < 2 or {_squares('a')} = 0", "the vector has no spread")
SPREAD_B = (f"{_squares('b')} = 0", "the second vector has no spread")
DOT = _sum("zip_with(a, b, (y, z) -> y * z)")
NORM = "sqrt(" + _sum("transform({0}, y -> y * y)") + ")"
REAL = "filter(a, y -> not isnan(y))"
QUANTILE = _let("array_sort(a)", "o", _let("(size(o) - 1) * {0}", "h", "element_at(o, cast(floor(h) as int) + 1) + (h - floor(h)) * (element_at(o, cast(ceil(h) as int) + 1) - element_at(o, cast(floor(h) as int) + 1))"))
WINDOW = (("b <> floor(b) or b < 1 or b > size(a)", "the window is whole, at least 1 and at most the length"),)


def _rolling(body: str) -> str:
    return f"transform(a, (y, i) -> case when i + 1 >= b then {_let('slice(a, cast(i + 2 - b as int), cast(b as int))', 'w', body)} end)"


def _prefix(step: str) -> str:
    """A running fold: (the values so far, the level)."""
    return f"aggregate(a, named_struct('o', cast(array() as array<double>), 'l', 0D), (s, x) -> {step}, s -> s.o)"


def _v(name, category, takes, gives, about, sql, *checks):
    return Entry(name, category, tuple(takes.split()), gives, about, sql=sql, checks=checks)


def _k(name, category, takes, gives, about, kernel=None):
    return Entry(name, category, tuple(takes.split()), gives, about, kernel=kernel or getattr(kernels, name, None) or getattr(special, name))


PEAKS = "aggregate(a, named_struct('o', cast(array() as array<double>), 'p', cast('-Infinity' as double)), (s, x) -> named_struct('o', array_append(s.o, x / greatest(s.p, x) - 1D), 'p', greatest(s.p, x)), s -> s.o)"
EXCESS = "transform(a, y -> y - b)"

ENTRIES: list[Entry] = [
    # construction
    _v("mat_identity", "construction", "num", "vec", "identity matrix, flat row-major", "transform(sequence(0, cast(a * a as int) - 1), i -> case when i div cast(a as int) = i % cast(a as int) then 1D else 0D end)", ("a < 1 or a <> floor(a)", "a size is whole and positive")),
    # vector arithmetic
    _v("vec_add", "vector", "vec vec", "vec", "a + b", "zip_with(a, b, (y, z) -> y + z)", SAME),
    _v("vec_subtract", "vector", "vec vec", "vec", "a - b", "zip_with(a, b, (y, z) -> y - z)", SAME),
    _v("vec_multiply", "vector", "vec vec", "vec", "a * b, element by element", "zip_with(a, b, (y, z) -> y * z)", SAME),
    _v("vec_divide", "vector", "vec vec", "vec", "a / b, element by element", "zip_with(a, b, (y, z) -> y / z)", SAME, ("exists(b, y -> y = 0)", "division by zero")),
    _v("vec_scale", "vector", "vec num", "vec", "a times a number", "transform(a, y -> y * b)"),
    _v("vec_dot", "vector", "vec vec", "num", "sum of products", DOT, SAME),
    _v("vec_sum", "vector", "vec", "num", "sum", _sum("a")),
    _v("vec_mean", "vector", "vec", "num", "mean", _mean("a"), FULL),
    _v("vec_min", "vector", "vec", "num", "least element that is a number", f"array_min({REAL})", FULL),
    _v("vec_max", "vector", "vec", "num", "largest element that is a number", f"array_max({REAL})", FULL),
    _v("vec_range", "vector", "vec", "num", "largest less least", f"array_max({REAL}) - array_min({REAL})", FULL),
    _v("vec_norm_l1", "vector", "vec", "num", "sum of absolute values", _sum("transform(a, y -> abs(y))")),
    _v("vec_norm_l2", "vector", "vec", "num", "root of the sum of squares", NORM.format("a")),
    _v("vec_euclidean", "vector", "vec vec", "num", "distance", NORM.format("zip_with(a, b, (y, z) -> y - z)"), SAME),
    _v("vec_cosine_similarity", "vector", "vec vec", "num", "cosine", f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})", SAME, (f"{NORM.format('a')} = 0 or {NORM.format('b')} = 0", "a vector has no length")),
    _v("vec_cosine_distance", "vector", "vec vec", "num", "one less the cosine", f"1D - {DOT} / ({NORM.format('a')} * {NORM.format('b')})", SAME, (f"{NORM.format('a')} = 0 or {NORM.format('b')} = 0", "a vector has no length")),
    _v("vec_quantile", "vector", "vec num", "num", "order statistic by linear interpolation", QUANTILE.format("b"), FULL, ("exists(a, y -> isnan(y)) or not (b between 0 and 1)", "values are numbers and the share lies in [0, 1]")),
    _v("vec_median", "vector", "vec", "num", "middle order statistic", QUANTILE.format("0.5D"), FULL, ("exists(a, y -> isnan(y))", "a value is not a number")),
    # statistics
    _v("vec_variance", "statistics", "vec", "num", "sample variance", f"{_squares('a')} / (size(a) - 1)", TWO),
    _v("vec_variance_pop", "statistics", "vec", "num", "mean square distance from the mean", f"{_squares('a')} / size(a)", FULL),
    _v("vec_stddev", "statistics", "vec", "num", "sample deviation", f"sqrt({_squares('a')} / (size(a) - 1))", TWO),
    _v("vec_stddev_pop", "statistics", "vec", "num", "population deviation", f"sqrt({_squares('a')} / size(a))", FULL),
    _v("vec_covariance", "statistics", "vec vec", "num", "sample covariance", f"{_cross('a', 'b')} / (size(a) - 1)", SAME, TWO),
    _v("vec_covariance_pop", "statistics", "vec vec", "num", "population covariance", f"{_cross('a', 'b')} / size(a)", SAME, FULL),
    _v("vec_correlation", "statistics", "vec vec", "num", "correlation", f"{_cross('a', 'b')} / sqrt({_squares('a')} * {_squares('b')})", SAME, SPREAD, SPREAD_B),
    _v("vec_standardise", "statistics", "vec", "vec", "z-scores", _let(_mean("a"), "m", _let(f"sqrt({_squares('a')} / (size(a) - 1))", "d", "transform(a, y -> (y - m) / d)")), SPREAD),
    _k("vec_skewness", "statistics", "vec", "num", "adjusted skewness", kernels.skewness),
    _k("vec_kurtosis", "statistics", "vec", "num", "adjusted excess kurtosis", kernels.kurtosis),
    # calculus, spacing 1
    _v("vec_cumulative_sum", "calculus", "vec", "vec", "prefix sums", _prefix("named_struct('o', array_append(s.o, s.l + x), 'l', s.l + x)")),
    _v("vec_differences", "calculus", "vec", "vec", "steps", "zip_with(slice(a, 2, size(a) - 1), slice(a, 1, size(a) - 1), (y, z) -> y - z)", FULL),
    _v("vec_derivative", "calculus", "vec", "vec", "first derivative", "transform(a, (y, i) -> case when i = 0 then element_at(a, 2) - y when i = size(a) - 1 then y - element_at(a, i) else (element_at(a, i + 2) - element_at(a, i)) / 2 end)", TWO),
    _v("vec_second_derivative", "calculus", "vec", "vec", "second derivative", "transform(sequence(0, size(a) - 1), i -> " + _let("least(greatest(i, 1), size(a) - 2)", "j", "element_at(a, j + 2) - 2 * element_at(a, j + 1) + element_at(a, j)") + ")", ("size(a) < 3", "at least three values are needed")),
    _v("vec_integral", "calculus", "vec", "num", "area by trapezoids", f"{_sum('a')} - (element_at(a, 1) + element_at(a, -1)) / 2", TWO),
    _v("vec_integral_simpson", "calculus", "vec", "num", "area by Simpson's rule", _sum("transform(a, (y, i) -> case when i in (0, size(a) - 1) then y when i % 2 = 1 then 4 * y else 2 * y end)") + " / 3", ("size(a) < 3 or size(a) % 2 = 0", "an odd number of values is needed, at least three")),
    _v("vec_cumulative_integral", "calculus", "vec", "vec", "prefix areas by trapezoids", "aggregate(a, named_struct('o', cast(array() as array<double>), 'l', 0D, 'p', cast(null as double)), (s, x) -> named_struct('o', array_append(s.o, s.l + coalesce((s.p + x) / 2, 0D)), 'l', s.l + coalesce((s.p + x) / 2, 0D), 'p', x), s -> s.o)"),
    # matrices
    _v("mat_is_square", "matrix", "vec", "num", "1 if the length is a square", "case when sqrt(size(a)) = floor(sqrt(size(a))) and size(a) > 0 then 1D else 0D end"),
    _v("mat_trace", "matrix", "vec", "num", "sum of the diagonal", _sum("filter(a, (y, i) -> i % (cast(sqrt(size(a)) as int) + 1) = 0)"), ("sqrt(size(a)) <> floor(sqrt(size(a))) or size(a) = 0", "the matrix is not square")),
    _v("mat_transpose", "matrix", "vec", "vec", "transpose of a square matrix", "transform(a, (y, i) -> element_at(a, cast((i % cast(sqrt(size(a)) as int)) * cast(sqrt(size(a)) as int) + i div cast(sqrt(size(a)) as int) + 1 as int)))", ("sqrt(size(a)) <> floor(sqrt(size(a))) or size(a) = 0", "the matrix is not square")),
    _v("mat_vec", "matrix", "vec vec", "vec", "matrix times vector; rows follow from the vector's length", "transform(sequence(0, size(a) div size(b) - 1), i -> " + _sum("zip_with(slice(a, cast(i * size(b) + 1 as int), size(b)), b, (y, z) -> y * z)") + ")", ("size(b) = 0 or size(a) % size(b) <> 0 or size(a) = 0", "the shapes do not fit")),
    *(_k(n, "matrix", t, g, d) for n, t, g, d in (("mat_determinant", "vec", "num", "determinant"), ("mat_inverse", "vec", "vec", "inverse"), ("mat_multiply", "vec vec", "vec", "product of square matrices"), ("mat_solve", "vec vec", "vec", "solution of a x = b"), ("mat_is_symmetric", "vec", "num", "1 if symmetric"))),
    *(_k(n, "decomposition", "vec", g, d) for n, g, d in (("mat_cholesky", "vec", "lower factor"), ("mat_eigenvalues", "vec", "eigenvalues, largest first"), ("mat_eigenvectors", "vec", "eigenvectors in columns, dominant entry positive"), ("mat_is_positive_definite", "num", "1 if the Cholesky factor exists"), ("mat_qr_q", "vec", "orthogonal factor"), ("mat_qr_r", "vec", "triangular factor"), ("mat_singular_values", "vec", "singular values, largest first"))),
    # distributions
    *(_k(n, "distribution", " ".join(["num"] * k), "num", d) for n, k, d in (
        ("beta_cdf", 3, "beta"), ("binom_cdf", 3, "binomial"), ("binom_pmf", 3, "binomial mass"), ("chisq_cdf", 2, "chi-squared"), ("chisq_inv", 2, "chi-squared value at a share"), ("chisq_sf", 2, "chi-squared tail"),
        ("f_cdf", 3, "Fisher"), ("f_inv", 3, "Fisher quantile"), ("f_sf", 3, "Fisher tail"), ("gamma_cdf", 3, "gamma"), ("lognorm_cdf", 3, "log-normal"), ("lognorm_inv", 3, "log-normal quantile"),
        ("norm_cdf", 1, "standard normal"), ("norm_inv", 1, "standard normal quantile"), ("norm_sf", 1, "standard normal tail"), ("normal_cdf", 3, "normal"), ("normal_inv", 3, "normal quantile"),
        ("poisson_cdf", 2, "Poisson"), ("poisson_pmf", 2, "Poisson mass"), ("t_cdf", 2, "Student"), ("t_inv", 2, "Student quantile"), ("t_pdf", 2, "Student density"), ("t_sf", 2, "Student tail"), ("t_two_sided", 2, "both Student tails"),
    )),
    _v("expon_cdf", "distribution", "num num", "num", "exponential", "case when a <= 0 then 0D else -expm1(-b * a) end", ("b <= 0", "a rate is positive")),
    _v("norm_pdf", "distribution", "num", "num", "standard normal density", "exp(-a * a / 2) / sqrt(2 * pi())"),
    _v("normal_pdf", "distribution", "num num num", "num", "normal density", "exp(-(a - b) * (a - b) / (2 * c * c)) / (c * sqrt(2 * pi()))", ("c <= 0", "a deviation is positive")),
    _v("uniform_cdf", "distribution", "num num num", "num", "uniform", "least(greatest((a - b) / (c - b), 0D), 1D)", ("c <= b", "the bounds are in order")),
    *(_k(n, "special", " ".join(["num"] * k), "num", d, f) for n, k, d, f in (("beta_i", 3, "part of the beta integral, as a share", special.beta_i), ("erf", 1, "Gauss's error integral", special.erf), ("erfc", 1, "what the error integral leaves of 1", special.erfc), ("gamma_p", 2, "lower part of the gamma integral, as a share", special.gamma_p), ("gamma_q", 2, "upper part of the gamma integral, as a share", special.gamma_q), ("gammaln", 1, "logarithm of the gamma function", special.gammaln))),
    # inference and regression
    *(_k(n, "inference", t, "num", d) for n, t, d in (
        ("chisq_test_p", "vec vec", "goodness of fit, p"), ("chisq_test_t", "vec vec", "goodness of fit"), ("f_test_p", "vec vec", "ratio of variances, p"), ("f_test_t", "vec vec", "ratio of variances"), ("jarque_bera_p", "vec", "normality, p"), ("jarque_bera_t", "vec", "normality"),
        ("ttest_1samp_df", "vec num", "one sample, degrees of freedom"), ("ttest_1samp_p", "vec num", "one sample, p"), ("ttest_1samp_t", "vec num", "one sample"), ("ttest_2samp_df", "vec vec", "Welch, degrees of freedom"), ("ttest_2samp_p", "vec vec", "Welch, p"), ("ttest_2samp_t", "vec vec", "Welch"),
        ("ttest_df_welch", "num num num num", "Welch degrees of freedom from variances and counts"), ("ttest_paired_p", "vec vec", "pairs, p"), ("ttest_paired_t", "vec vec", "pairs"),
    )),
    *(_k(n, "regression", t, "num", d) for n, t, d in (
        ("regress_adj_r2", "vec vec", "adjusted R squared"), ("regress_intercept", "vec vec", "intercept"), ("regress_multiple_f_p", "vec vec num", "p of the overall F"), ("regress_multiple_r2", "vec vec num", "R squared of a design"), ("regress_pvalue", "vec vec", "p of the slope"), ("regress_r2", "vec vec", "R squared"),
        ("regress_residual_error", "vec vec", "residual error"), ("regress_ridge_norm", "vec vec num num", "length of ridge coefficients"), ("regress_slope", "vec vec", "slope"), ("regress_stderr", "vec vec", "error of the slope"), ("regress_tstat", "vec vec", "t of the slope"),
    )),
    _v("vec_regression_slope", "regression", "vec vec", "num", "slope of b on a", f"{_cross('a', 'b')} / {_squares('a')}", SAME, SPREAD),
    _v("vec_regression_intercept", "regression", "vec vec", "num", "intercept of b on a", f"{_mean('b')} - {_cross('a', 'b')} / {_squares('a')} * {_mean('a')}", SAME, SPREAD),
    _v("vec_regression_r2", "regression", "vec vec", "num", "R squared of b on a; null if b is constant", f"case when {_squares('b')} = 0 then null else power({_cross('a', 'b')}, 2) / ({_squares('a')} * {_squares('b')}) end", SAME, SPREAD),
    # series
    _v("ts_autocorrelation", "series", "vec num", "num", "correlation with itself at a lag", _let(_mean("a"), "m", _sum("zip_with(slice(a, cast(b + 1 as int), cast(size(a) - b as int)), slice(a, 1, cast(size(a) - b as int)), (y, z) -> (y - m) * (z - m))")) + f" / {_squares('a')}", SPREAD, ("b < 0 or b <> floor(b) or b >= size(a)", "the lag is whole and less than the length")),
    _v("ts_cumulative_return", "series", "vec", "num", "compound return", "aggregate(a, 1D, (s, x) -> s * (1 + x)) - 1"),
    _v("ts_drawdown", "series", "vec", "vec", "fall from the peak so far", PEAKS, FULL, ("element_at(a, 1) <= 0", "a peak is positive")),
    _v("ts_max_drawdown", "series", "vec", "num", "deepest fall", f"array_min({PEAKS})", FULL, ("element_at(a, 1) <= 0", "a peak is positive")),
    _v("ts_ewma", "series", "vec num", "vec", "exponential smoothing", "aggregate(a, named_struct('o', cast(array() as array<double>), 'l', cast(null as double)), (s, x) -> named_struct('o', array_append(s.o, coalesce(b * x + (1 - b) * s.l, x)), 'l', coalesce(b * x + (1 - b) * s.l, x)), s -> s.o)", ("b <= 0 or b > 1", "the factor lies in (0, 1]")),
    _v("ts_returns", "series", "vec", "vec", "relative steps", "zip_with(slice(a, 2, size(a) - 1), slice(a, 1, size(a) - 1), (y, z) -> y / z - 1)", TWO, ("exists(a, y -> y = 0)", "a price is zero")),
    _v("ts_log_returns", "series", "vec", "vec", "log steps", "zip_with(slice(a, 2, size(a) - 1), slice(a, 1, size(a) - 1), (y, z) -> ln(y / z))", TWO, ("exists(a, y -> y <= 0)", "a price is not positive")),
    _v("ts_rolling_mean", "series", "vec num", "vec", "trailing mean", _rolling(_mean("w")), *WINDOW),
    _v("ts_rolling_min", "series", "vec num", "vec", "trailing minimum", _rolling("array_min(w)"), *WINDOW),
    _v("ts_rolling_max", "series", "vec num", "vec", "trailing maximum", _rolling("array_max(w)"), *WINDOW),
    _v("ts_rolling_std", "series", "vec num", "vec", "trailing sample deviation", _rolling(f"sqrt({_squares('w')} / (size(w) - 1))"), *WINDOW, ("b < 2", "a deviation needs two values")),
    # finance
    _v("npv", "finance", "num vec", "num", "present value from period 1", _sum("transform(b, (y, i) -> y / power(1 + a, i + 1))"), ("a <= -1", "a rate is above -1")),
    _v("npv_from_now", "finance", "num vec", "num", "present value from period 0", _sum("transform(b, (y, i) -> y / power(1 + a, i))"), ("a <= -1", "a rate is above -1")),
    _k("irr", "finance", "vec", "num", "internal rate of return"),
    _v("pv", "finance", "num num num num", "num", "annuity present value (rate, periods, payment, future)", "case when a = 0 then -(d + c * b) else -(d + c * (power(1 + a, b) - 1) / a) / power(1 + a, b) end"),
    _v("fv", "finance", "num num num num", "num", "annuity future value (rate, periods, payment, present)", "case when a = 0 then -(d + c * b) else -(d * power(1 + a, b) + c * (power(1 + a, b) - 1) / a) end"),
    _v("pmt", "finance", "num num num num", "num", "annuity payment (rate, periods, present, future)", "case when a = 0 then -(c + d) / b else -(c * power(1 + a, b) + d) * a / (power(1 + a, b) - 1) end", ("b <= 0", "periods are positive")),
    _v("sln", "finance", "num num num", "num", "straight-line charge (cost, salvage, life)", "(a - b) / c", ("c <= 0", "a life is positive")),
    _v("syd", "finance", "num num num num", "num", "sum-of-digits charge (cost, salvage, life, period)", "(a - b) * (c - d + 1) * 2 / (c * (c + 1))", ("c <= 0 or d < 1 or d > c", "the period lies in the life")),
    _v("var_historical", "risk", "vec num", "num", "quantile of outcomes", QUANTILE.format("b"), FULL, ("exists(a, y -> isnan(y)) or not (b between 0 and 1)", "values are numbers and the tail lies in [0, 1]")),
    _v("expected_shortfall", "risk", "vec num", "num", "mean of outcomes at most that quantile", _let(QUANTILE.format("b"), "q", _let("filter(a, y -> y <= q)", "t", _mean("t"))), FULL, ("exists(a, y -> isnan(y)) or not (b between 0 and 1)", "values are numbers and the tail lies in [0, 1]")),
    _v("sharpe", "risk", "vec num", "num", "mean excess over its deviation", _let(EXCESS, "w", f"{_mean('w')} / sqrt({_squares('w')} / (size(w) - 1))"), SPREAD),
    _v("sortino", "risk", "vec num", "num", "mean excess over its downside deviation", _let(EXCESS, "w", f"{_mean('w')} / sqrt(" + _sum("transform(w, y -> power(least(y, 0D), 2))") + " / size(w))"), FULL, ("not exists(a, y -> y < b)", "nothing is below the target")),
    *(_k(n, "options", "num num num num num", "num", d) for n, d in (("black_scholes_call", "call (spot, strike, rate, volatility, years)"), ("black_scholes_put", "put"), ("greeks_delta", "call delta"))),
    _v("greeks_vega", "options", "num num num num num", "num", "vega", _let("(ln(a / b) + (c + d * d / 2) * e) / (d * sqrt(e))", "z", "a * exp(-z * z / 2) / sqrt(2 * pi()) * sqrt(e)"), ("a <= 0 or b <= 0 or d <= 0 or e <= 0", "spot, strike, volatility and time are positive")),
]
BY_NAME = {e.name: e for e in ENTRIES}

#: Verbs with any number of arguments or with rows as results; Python and SQL give them elsewhere (construction, cubes, graphs).
OTHERS = [("vec_of", "construction", "numbers", "vec", "vector of numbers"), ("mat_of", "construction", "rows, columns, numbers", "vec", "matrix of numbers")] + [
    (n, k, "names and options", "rows", d) for n, k, d in (("cube_dimensions", "cube", "levels of a cube"), ("cube_measures", "cube", "rules of a cube's measures"), ("cube_rollup", "cube", "aggregate to the kept dimensions"), ("cube_consolidate", "cube", "move members up a hierarchy"), ("cube_slice", "cube", "fix one member"), ("cubes", "cube", "all cubes"), ("derived", "cube", "named queries"), ("graph_cycles", "graph", "simple circuits"), ("graph_influence", "graph", "damped products of weights"), ("graph_reachable", "graph", "breadth-first reach"), ("graph_shortest_path", "graph", "cheapest paths"), ("graph_time_respecting", "graph", "earliest arrival"), ("functions", "catalogue", "this catalogue"))
]


def body(e: Entry) -> str:
    """The whole expression of a SQL function: null for null, then refusals, then the value."""
    names = "abcde"[: len(e.takes)]
    text = e.sql
    for condition, why in reversed(e.checks):
        text = f"case when {condition} then cast(raise_error('{e.name}: {why}') as {'array<double>' if e.gives == 'vec' else 'double'}) else {text} end"
    vectors = [n for n, t in zip(names, e.takes, strict=True) if t == "vec"]
    if vectors:
        text = f"case when {' or '.join(f'exists({n}, y -> y is null)' for n in vectors)} then cast(raise_error('{e.name}: an element is null') as {'array<double>' if e.gives == 'vec' else 'double'}) else {text} end"
    return f"case when {' or '.join(f'{n} is null' for n in names)} then null else {text} end"


def _groups(columns: list[pa.Array], vec: list[bool], name: str):
    """Rows without a null, in groups of equal lengths of their vectors: their places and the kernel's arguments. Arrow keeps a
    null element apart from NaN."""
    there = np.ones(len(columns[0]), bool)
    for c in columns:
        there &= c.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(there)
    if not len(rows):
        return
    numbers = [None if is_vec else c.to_numpy(zero_copy_only=False).astype(float) for c, is_vec in zip(columns, vec, strict=True)]
    parts = {}
    for i, (c, is_vec) in enumerate(zip(columns, vec, strict=True)):
        if is_vec:
            offsets, missing = c.offsets.to_numpy(), np.concatenate(([0], np.cumsum(c.values.is_null().to_numpy(zero_copy_only=False))))
            if (missing[offsets[rows + 1]] > missing[offsets[rows]]).any():
                raise special.Refused(f"{name}: an element is null")
            parts[i] = (offsets[rows], offsets[rows + 1] - offsets[rows], c.values.to_numpy(zero_copy_only=False))
    lengths = np.stack([p[1] for p in parts.values()], axis=1) if parts else np.zeros((len(rows), 1), int)
    _, group = np.unique(lengths, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        yield rows[some], [numbers[i][rows[some]] if i not in parts else parts[i][2][parts[i][0][some][:, None] + np.arange(parts[i][1][some[0]])] for i in range(len(columns))]


def answer(e: Entry, columns: list[pa.Array]) -> pa.Array:
    """A kernel's answers for a batch: null for null, all rows of equal lengths in one call."""
    size, found = len(columns[0]), list(_groups(columns, [t == "vec" for t in e.takes], e.name))
    known = np.zeros(size, bool)
    if e.gives == "num":
        out = np.zeros(size)
        for rows, args in found:
            value = e.kernel(*args)
            out[rows], known[rows] = np.ma.getdata(value), ~np.ma.getmaskarray(value)
        return pa.array(out, mask=~known)
    lengths, values = np.zeros(size, np.int64), []
    for rows, args in found:
        value = np.asarray(e.kernel(*args), float)
        lengths[rows], known[rows] = value.shape[1], True
        values.append((rows, value))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.empty(offsets[-1])
    for rows, value in values:
        flat[offsets[rows][:, None] + np.arange(value.shape[1])] = value
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(~known))


def udf(e: Entry):
    """An Arrow-backed kernel with the null and element contract."""
    run = lambda *columns: answer(e, list(columns))
    shapes = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d), 5: lambda a, b, c, d, e_: run(a, b, c, d, e_)}
    f = shapes[len(e.takes)]
    f.__annotations__ = dict.fromkeys(f.__code__.co_varnames[: f.__code__.co_argcount], pa.Array) | {"return": pa.Array}
    return arrow_udf(f, "array<double>" if e.gives == "vec" else "double")


_REGISTERED: set[str] = set()


def register(spark: SparkSession, names: list[str] | None = None) -> None:
    """Make the functions known to this session's SQL."""
    ship(spark)
    key = f"{spark.sparkContext.applicationId}/{id(spark._jsparkSession)}"
    for e in ENTRIES if names is None else [BY_NAME[n] for n in names]:
        if f"{key}/{e.name}" in _REGISTERED:
            continue
        if e.sql is not None:
            args = ", ".join(f"{n} {'ARRAY<DOUBLE>' if t == 'vec' else 'DOUBLE'}" for n, t in zip("abcde", e.takes, strict=False))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {e.name}({args}) RETURNS {'ARRAY<DOUBLE>' if e.gives == 'vec' else 'DOUBLE'} RETURN {body(e)}")
        else:
            spark.udf.register(e.name, udf(e))
        _REGISTERED.add(f"{key}/{e.name}")


def fn(name: str, *args: Column | str | float) -> Column:
    """A function of the catalogue as a Column; register(spark) comes first."""
    if name not in BY_NAME:
        raise KeyError(f"no function {name}")
    return F.call_function(name, *(F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x for x in args))


def vec_of(*numbers: Column) -> Column:
    """A vector of numbers; null if one of them is."""
    missing = None
    for n in numbers:
        missing = n.isNull() if missing is None else missing | n.isNull()
    return F.when(~missing, F.array(*(n.cast("double") for n in numbers)))


def mat_of(rows: int, columns: int, *numbers: Column) -> Column:
    """A row-major matrix with its shape as metadata."""
    if rows * columns != len(numbers):
        raise special.Refused(f"mat_of: {rows} by {columns} needs {rows * columns} numbers")
    return vec_of(*numbers).alias("matrix", metadata={"shape": [rows, columns]})


def functions(spark: SparkSession) -> DataFrame:
    """The catalogue as rows."""
    own = [(e.name, e.category, len(e.takes), ", ".join(e.takes), e.gives, e.about) for e in ENTRIES]
    more = [(n, k, -1, t, g, d) for n, k, t, g, d in OTHERS]
    return spark.createDataFrame(sorted(own + more), "function string, category string, arity int, takes string, gives string, about string")
