"""The catalogue's contract: null for null, refusals with a reason, and values from closed forms."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import catalogue, kernels, scalars, special
from tessera.session import Refused


@pytest.fixture(scope="module")
def ask(spark):
    catalogue.register(spark)
    scalars.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS r").first()["r"]


@pytest.mark.parametrize("e", catalogue.ENTRIES, ids=lambda e: e.name)
def test_null_gives_null(ask, e):
    for k in range(len(e.takes)):
        args = ["cast(null as " + ("array<double>" if t == "vec" else "double") + ")" if i == k else "array(1D, 2D, 4D, 8D)" if t == "vec" else "0.5D" for i, t in enumerate(e.takes)]
        assert ask(f"{e.name}({', '.join(args)})") is None


@pytest.mark.parametrize("e", [e for e in catalogue.ENTRIES if "vec" in e.takes], ids=lambda e: e.name)
def test_null_element_is_refused(ask, e):
    args = ["array(1D, cast(null as double), 3D, 4D)" if t == "vec" else "0.5D" for t in e.takes]
    with pytest.raises(Exception, match="null"):
        ask(f"{e.name}({', '.join(args)})")


@pytest.mark.parametrize("text, why", [
    ("vec_add(array(1D), array(1D, 2D))", "lengths"), ("vec_cosine_similarity(array(0D), array(1D))", "length"), ("vec_correlation(array(1D, 1D), array(1D, 2D))", "spread"), ("vec_standardise(array(2D, 2D))", "spread"), ("vec_quantile(array(1D), 1.5D)", "share"),
    ("vec_integral_simpson(array(1D, 2D))", "odd"), ("vec_second_derivative(array(1D, 2D))", "three"), ("ts_rolling_mean(array(1D, 2D), 3D)", "window"), ("ts_ewma(array(1D), 0D)", "factor"), ("ts_log_returns(array(1D, -1D))", "positive"), ("ts_drawdown(array(0D, 1D))", "peak"),
    ("mat_inverse(array(1D, 2D, 2D, 4D))", "singular"), ("mat_trace(array(1D, 2D))", "square"), ("mat_cholesky(array(1D, 2D, 2D, 1D))", "definite"), ("chisq_cdf(-1D, 2D)", "x >= 0"), ("normal_cdf(0D, 0D, -1D)", "positive"), ("binom_pmf(1.5D, 3D, 0.5D)", "whole"), ("norm_inv(2D)", "0, 1"), ("irr(array(1D, 2D))", "signs"),
    ("black_scholes_call(0D, 1D, 0D, 1D, 1D)", "positive"), ("sharpe(array(1D, 1D), 0D)", "spread"), ("sortino(array(1D, 2D), 0D)", "below"), ("telemetry_breach_severity(1D, 0D)", "zero"), ("logistics_check_digit('12a')", "digits"), ("logistics_leg_cost(-1D, 2D)", "negative"),
])
def test_refusals(ask, text, why):
    with pytest.raises(Exception, match=why):
        ask(text)


@pytest.mark.parametrize("text, value", [
    ("norm_cdf(1.96D)", 0.9750021048517795), ("t_two_sided(2D, 10D)", 0.07338803477074037), ("chisq_sf(3.84D, 1D)", 0.05004352124870519), ("f_sf(4D, 2D, 10D)", 1.8**-5), ("gamma_p(0.5D, 0.5D)", 0.6826894921370859), ("beta_i(0.5D, 0.5D, 0.25D)", 1 / 3),
    ("erf(0.5D)", 0.5204998778130465), ("gammaln(0.5D)", math.log(math.sqrt(math.pi))), ("t_inv(0.975D, 5D)", 2.570581835636314), ("chisq_inv(0.95D, 3D)", 7.814727903251179), ("f_inv(0.95D, 2D, 7D)", 3.5 * (0.05 ** (-2 / 7) - 1)), ("poisson_cdf(3D, 2D)", 0.857123460498547),
    ("lognorm_cdf(-1D, 0D, 1D)", 0.0), ("norm_inv(0D)", -math.inf), ("t_inv(0.5D, 3D)", 0.0), ("mat_trace(mat_multiply(array(1D, 2D, 3D, 4D), mat_transpose(array(1D, 2D, 3D, 4D))))", 30.0), ("vec_regression_r2(array(1D, 2D), array(3D, 3D))", None), ("regress_r2(array(1D, 2D, 3D), array(3D, 3D, 3D))", None),
    ("telemetry_window_start(-1, 60)", -60), ("logistics_check_digit('')", 0), ("gcd(-12, 18)", 6), ("lcm(4, 6)", 12), ("trunc_number(-1.29D, 1)", -1.2),
])
def test_values(ask, text, value):
    assert ask(text) == (value if value is None else pytest.approx(value, rel=1e-11, abs=1e-12))


def test_min_and_max_pass_over_nan(ask):
    assert ask("vec_max(array(1D, cast('NaN' as double)))") == 1.0


def test_quantiles_invert_their_cdf():
    for p in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999):
        assert special.norm_cdf(special.norm_inv(p)) == pytest.approx(p, rel=1e-10)
        for df in (1, 2.5, 30):
            assert special.t_cdf(special.t_inv(p, df), df) == pytest.approx(p, rel=1e-9)
            assert special.chisq_cdf(special.chisq_inv(p, df), df) == pytest.approx(p, rel=1e-9)
            assert special.f_cdf(special.f_inv(p, df, 4), df, 4) == pytest.approx(p, rel=1e-9)


def test_packs_keep_their_names(spark):
    with pytest.raises(Refused):
        scalars.Pack("a", (scalars.SqlFunction("b_f", "x INT", "INT", "x"),)).register(spark)


def test_columns(spark):
    catalogue.register(spark)
    df = spark.sql("SELECT array(3D, 4D) AS v")
    assert df.select(catalogue.fn("vec_norm_l2", "v").alias("n")).first()["n"] == 5.0
    with pytest.raises(KeyError):
        catalogue.fn("vec_nothing", "v")
    made = df.select(catalogue.mat_of(1, 2, df.v[0], df.v[1]))
    assert made.schema[0].metadata == {"shape": [1, 2]}
    with pytest.raises(special.Refused):
        catalogue.mat_of(2, 2, df.v[0])
    assert catalogue.functions(spark).count() == 157


KERNELS = [e for e in catalogue.ENTRIES if e.kernel is not None]


def arguments(e, r: random.Random) -> list | None:
    """A row that the kernel answers."""
    n = r.choice([2, 3])
    if e.category in ("matrix", "decomposition"):
        m = np.array([[r.gauss(0, 1) for _ in range(n)] for _ in range(n)])
        flat = (m @ m.T + n * np.eye(n)).ravel().tolist()
        second = flat[: n * n] if e.name == "mat_multiply" else [r.gauss(0, 1) for _ in range(n)]
        return [flat, second][: len(e.takes)]
    if e.name == "irr":
        return [[-100.0] + [r.uniform(20, 90) for _ in range(n + 1)]]
    if e.name == "ttest_df_welch":
        return [r.uniform(1, 5), 5.0 + n, r.uniform(1, 5), 7.0]
    if e.name.startswith("regress_multiple") or e.name == "regress_ridge_norm":
        return [[r.gauss(0, 1) for _ in range(2 * (n + 4))], [r.gauss(0, 1) for _ in range(n + 4)], 2.0, 0.5][: len(e.takes)]
    if e.name == "beta_i":
        return [r.uniform(0.5, 6), r.uniform(0.5, 6), r.uniform(0.05, 0.95)]
    if "vec" in e.takes:
        return [[abs(r.gauss(5, 2)) + 0.1 for _ in range(n + 4)] if t == "vec" else r.uniform(0, 1) for t in e.takes]
    if e.name.startswith(("binom", "poisson")):
        return [float(n), 8.0, r.uniform(0.05, 0.95)] if e.name.startswith("binom") else [float(n), r.uniform(0.5, 9)]
    return [r.uniform(0.05, 0.95)] + [r.uniform(0.5, 6) for _ in e.takes[1:]]


@pytest.mark.parametrize("e", KERNELS, ids=lambda e: e.name)
def test_a_batch_gives_what_its_rows_give(e):
    """Rows of several lengths, with nulls between them, in one batch and one by one."""
    r = random.Random(e.name)
    rows = [arguments(e, r) if k % 4 else None for k in range(40)]
    kinds = [pa.list_(pa.float64()) if t == "vec" else pa.float64() for t in e.takes]
    column = lambda some: [pa.array([x if x is None else x[i] for x in some], kinds[i]) for i in range(len(kinds))]
    many = catalogue.answer(e, column(rows)).to_pylist()
    sliced = catalogue.answer(e, [c.slice(5, 20) for c in column(rows)]).to_pylist()
    for k, x in enumerate(rows):
        one = catalogue.answer(e, column([x])).to_pylist()[0]
        assert (one is None) == (x is None)
        assert many[k] == (one if one is None else pytest.approx(one, rel=1e-9, abs=1e-9))
        assert not 5 <= k < 25 or sliced[k - 5] == (one if one is None else pytest.approx(one, rel=1e-9, abs=1e-9))
    assert catalogue.answer(e, column([])).to_pylist() == [] and catalogue.answer(e, column([None])).to_pylist() == [None]


def test_kernels_against_numpy():
    """Batches against numpy's routines for one problem at a time."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 12)), rng.normal(size=(30, 12))
    for k in range(30):
        b, left, *_ = np.linalg.lstsq(np.column_stack((np.ones(12), x[k])), y[k], rcond=None)
        assert kernels.regress_slope(x, y)[k] == pytest.approx(b[1]) and kernels.regress_residual_error(x, y)[k] == pytest.approx(math.sqrt(left[0] / 10))
        design = np.vstack((x[k].reshape(6, 2), 0.7 * np.eye(2)))
        ridge, *_ = np.linalg.lstsq(design, np.concatenate((y[k, :6], [0, 0])), rcond=None)
        assert kernels.regress_ridge_norm(x, y[:, :6], np.full(30, 2.0), np.full(30, 0.49))[k] == pytest.approx(np.linalg.norm(ridge))
    m = rng.normal(size=(20, 4, 4))
    spd = m @ m.transpose(0, 2, 1) + np.eye(4)
    assert np.allclose(kernels.mat_cholesky(spd.reshape(20, -1)).reshape(20, 4, 4), np.linalg.cholesky(spd))
    assert kernels.mat_is_positive_definite(np.array([[1.0, 2, 2, 1], [2, 0, 0, 1], [1, 2, 3, 9]])).tolist() == [0.0, 1.0, 0.0]
    flat = kernels.regress_r2(np.array([[1.0, 2, 3], [1, 2, 3]]), np.array([[3.0, 3, 3], [1, 2, 4]]))
    assert flat.mask.tolist() == [True, False]


def test_special_functions_over_arrays():
    """Closed forms over wide ranges, each in one call."""
    x = np.array([1e-8, 0.1, 0.9, 1.0, 3.0, 30.0, 200.0])
    assert np.allclose(special.gamma_q(1.0, x), np.exp(-x), rtol=1e-12, atol=0) and np.allclose(special.gamma_p(1.0, x), -np.expm1(-x), rtol=1e-12, atol=0)
    assert np.allclose(special.gamma_p(0.5, x * x), special.erf(x), rtol=1e-12) and np.allclose(special.gamma_q(0.5, np.minimum(x, 25) ** 2), special.erfc(np.minimum(x, 25)), rtol=1e-11, atol=0)
    a = np.array([50.0, 1e3, 1e5, 1e6])
    assert np.allclose(special.gamma_p(a, a) + special.gamma_q(a, a), 1) and np.allclose(special.gamma_q(a, a), 0.5 - 1 / (3 * np.sqrt(2 * np.pi * a)), atol=1e-4)
    p = np.array([1e-12, 0.2, 0.5, 0.77, 1 - 1e-9])
    assert np.allclose(special.beta_i(1.0, 3.0, p), -np.expm1(3 * np.log1p(-p)), rtol=1e-11) and np.allclose(special.beta_i(2.5, 1.0, p), p**2.5, rtol=1e-11)
    assert np.allclose(special.beta_i(0.5, 0.5, p), 2 / np.pi * np.arcsin(np.sqrt(p)), rtol=1e-11) and np.allclose(special.beta_i(400.0, 300.0, p) + special.beta_i(300.0, 400.0, 1 - p), 1)
    for df in (0.3, 1.0, 4.0, 90.0):
        q = np.array([1e-9, 0.02, 0.5, 0.98])
        assert np.allclose(special.t_cdf(special.t_inv(q, df), df), q, rtol=1e-9) and np.allclose(special.chisq_cdf(special.chisq_inv(q, df), df), q, rtol=1e-9) and np.allclose(special.f_cdf(special.f_inv(q, df, 3.0), df, 3.0), q, rtol=1e-9)
    k = np.arange(12)
    assert special.binom_pmf(k, 11, 0.3).sum() == pytest.approx(1) and np.allclose(np.cumsum(special.binom_pmf(k, 11, 0.3)), special.binom_cdf(k, 11, 0.3)) and np.allclose(np.cumsum(special.poisson_pmf(k, 2.5)), special.poisson_cdf(k, 2.5))
    with pytest.raises(special.Refused):
        special.gamma_p(np.array([1.0, -1.0]), 1.0)
