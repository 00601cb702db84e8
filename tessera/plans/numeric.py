"""Queries over the function catalogue, and for each the same figures by relational SQL for a second engine.

The Spark side calls catalogue functions on whole vectors; the other side unnests the vectors and uses plain aggregates,
windows, closed forms and Simpson's rule, so the two share no formula. Vectors come from `embeddings`: v is the vector, a and
b its halves, p a price series made of it. Nothing is shuffled on the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import catalogue, scalars
from tessera.plans.sqlqueries import views

SQL: dict[str, str] = {}
ORACLE: dict[str, str] = {}

S = """(SELECT vec_id, v, slice(v, 1, 32) AS a, slice(v, 33, 32) AS b, transform(v, x -> 100 + 10 * x) AS p
  FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM embeddings) q) s"""
D = """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  h AS (SELECT l.vec_id, l.i, l.x AS a, r.x AS b FROM e l JOIN e r ON l.vec_id = r.vec_id AND r.i = l.i + 32 WHERE l.i <= 32),
  s AS (SELECT vec_id, i, 100 + 10 * x AS p FROM e)"""
#: The normal distribution function by Simpson's rule over 400 steps from 0, for the second engine.
PHI = "(0.5 + {0} / 1200 * list_sum(list_transform(range(0, 401), lambda k: CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({0} * k / 400, 2) / 2))) / sqrt(2 * pi()))"


def add(name: str, sql: str, oracle: str | None) -> None:
    SQL[name] = sql
    if oracle is not None:
        ORACLE[name] = oracle


#: How many functions each category has.
ORACLE["functions_catalogue"] = """SELECT category, CAST(n AS BIGINT) AS count FROM (VALUES ('calculus', 7), ('catalogue', 1), ('construction', 3), ('cube', 7), ('decomposition', 7), ('distribution', 28), ('finance', 8), ('graph', 5), ('inference', 15), ('matrix', 9), ('options', 4),
  ('regression', 14), ('risk', 4), ('series', 11), ('special', 6), ('statistics', 10), ('vector', 18)) t(category, n)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(text: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            catalogue.register(spark)
            scalars.register(spark)
            views(spark, sf_dir, text)
            return spark.sql(text)

        return run

    return {k: of(v) for k, v in SQL.items()} | {"functions_catalogue": lambda spark, _: catalogue.functions(spark).groupBy("category").count(), "construct_vectors": construct}


def _r(pairs: dict[str, str], digits: int = 8) -> str:
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in pairs.items())


def _f(*names: str) -> dict[str, str]:
    return {n.split("(")[0]: n for n in names}


def _by_place(series: dict[str, str], n: int = 64) -> str:
    """A row for each place of several series of one length; each series is computed once a vector."""
    inner = f"SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in series.items())} FROM {S}"
    return f"SELECT vec_id, i, {_r({k: f'get({k}, i)' for k in series})} FROM (SELECT *, explode(sequence(0, {n - 1})) AS i FROM ({inner}) y) z"


def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_of and mat_of over the rows of `supplier`; what they hold comes out row by row."""
    catalogue.register(spark)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    made = s.select("s_suppkey", catalogue.mat_of(2, 2, key, balance, -balance, key * 2).alias("m"), catalogue.vec_of(key, F.when(key % 5 != 0, balance)).alias("v"))
    return made.select("s_suppkey", F.col("m")[0].alias("m11"), F.col("m")[1].alias("m12"), F.col("m")[2].alias("m21"), F.col("m")[3].alias("m22"), F.col("v")[1].alias("v2"), F.col("v").isNull().alias("no_v"))


ORACLE["construct_vectors"] = "SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS m11, s_acctbal AS m12, -s_acctbal AS m21, CAST(2 * s_suppkey AS DOUBLE) AS m22, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS v2, s_suppkey % 5 = 0 AS no_v FROM supplier"

# Vectors
add("vec_arithmetic",
    f"SELECT vec_id, i, {_r({'added': 'n[i]', 'taken': 'm[i]', 'times': 't[i]', 'over': 'd[i]', 'scaled': 'k[i]'})} FROM (SELECT vec_id, explode(sequence(0, 31)) AS i, n, m, t, d, k FROM (SELECT vec_id, vec_add(a, b) AS n, vec_subtract(a, b) AS m, vec_multiply(a, b) AS t, vec_divide(a, transform(b, x -> x + 2)) AS d, vec_scale(a, 2.5D) AS k FROM {S}) q) z",
    f"{D} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {_r({'added': 'a + b', 'taken': 'a - b', 'times': 'a * b', 'over': 'a / (b + 2)', 'scaled': 'a * 2.5'})} FROM h")
add("vec_products", f"SELECT vec_id, {_r(_f('vec_dot(a, b)', 'vec_euclidean(a, b)', 'vec_cosine_similarity(a, b)', 'vec_cosine_distance(a, b)'))} FROM {S}",
    f"{D} SELECT vec_id, {_r({'vec_dot': 'sum(a * b)', 'vec_euclidean': 'sqrt(sum((a - b) * (a - b)))', 'vec_cosine_similarity': 'sum(a * b) / sqrt(sum(a * a) * sum(b * b))', 'vec_cosine_distance': '1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b))'})} FROM h GROUP BY vec_id")
add("vec_summaries", f"SELECT vec_id, {_r(_f('vec_sum(v)', 'vec_mean(v)', 'vec_min(v)', 'vec_max(v)', 'vec_range(v)', 'vec_norm_l1(v)', 'vec_norm_l2(v)', 'vec_median(v)', 'vec_quantile(v, 0.3D)'))} FROM {S}",
    f"{D} SELECT vec_id, {_r({'vec_sum': 'sum(x)', 'vec_mean': 'avg(x)', 'vec_min': 'min(x)', 'vec_max': 'max(x)', 'vec_range': 'max(x) - min(x)', 'vec_norm_l1': 'sum(abs(x))', 'vec_norm_l2': 'sqrt(sum(x * x))', 'vec_median': 'median(x)', 'vec_quantile': 'quantile_cont(x, 0.3)'})} FROM e GROUP BY vec_id")
add("vec_topk", f"SELECT vec_id, round(sim, 8) AS sim FROM (SELECT vec_id, vec_cosine_similarity(v, q) AS sim FROM {S}, (SELECT CAST(embedding AS ARRAY<DOUBLE>) AS q FROM embeddings WHERE vec_id = 7) o) t ORDER BY t.sim DESC, vec_id LIMIT 10",
    "SELECT vec_id, round(sim, 8) AS sim FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) AS sim FROM embeddings) t ORDER BY t.sim DESC, vec_id LIMIT 10")
add("vec_statistics", f"SELECT vec_id, {_r(_f('vec_variance(v)', 'vec_variance_pop(v)', 'vec_stddev(v)', 'vec_stddev_pop(v)', 'vec_covariance(a, b)', 'vec_covariance_pop(a, b)', 'vec_correlation(a, b)', 'vec_skewness(v)', 'vec_kurtosis(v)'))} FROM {S}",
    f"{D} SELECT vec_id, {_r({'vec_variance': 'any_value(vs)', 'vec_variance_pop': 'any_value(vp)', 'vec_stddev': 'any_value(ss)', 'vec_stddev_pop': 'any_value(sp)', 'vec_covariance': 'covar_samp(a, b)', 'vec_covariance_pop': 'covar_pop(a, b)', 'vec_correlation': 'corr(a, b)', 'vec_skewness': 'any_value(sk)', 'vec_kurtosis': 'any_value(ku)'})} FROM h JOIN (SELECT vec_id, var_samp(x) AS vs, var_pop(x) AS vp, stddev_samp(x) AS ss, stddev_pop(x) AS sp, skewness(x) AS sk, kurtosis(x) AS ku FROM e GROUP BY vec_id) m USING (vec_id) GROUP BY vec_id")
add("vec_standardise", f"SELECT vec_id, i, round(z, 8) AS z FROM (SELECT vec_id, vec_standardise(v) AS zs FROM {S}) u LATERAL VIEW posexplode(zs) t AS i, z",
    f"{D} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 8) AS z FROM e WINDOW w AS (PARTITION BY vec_id)")
add("calculus_scalars", f"SELECT vec_id, {_r(_f('vec_integral(v)', 'vec_integral_simpson(slice(v, 1, 63))'))} FROM {S}",
    f"{D} SELECT vec_id, {_r({'vec_integral': 'sum(CASE WHEN i IN (1, 64) THEN x / 2 ELSE x END)', 'vec_integral_simpson': 'sum(CASE WHEN i > 63 THEN 0 WHEN i IN (1, 63) THEN x WHEN i % 2 = 0 THEN 4 * x ELSE 2 * x END) / 3'})} FROM e GROUP BY vec_id")
add("calculus_series", _by_place({'total': 'vec_cumulative_sum(v)', 'area': 'vec_cumulative_integral(v)', 'slope': 'vec_derivative(v)', 'bend': 'vec_second_derivative(v)', 'step': 'vec_differences(v)'}),
    f"{D} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {_r({'total': 'sum(x) OVER w', 'area': 'sum(x) OVER w - (x + first_value(x) OVER w) / 2', 'slope': 'CASE i WHEN 1 THEN lead(x) OVER w - x WHEN 64 THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END', 'bend': 'CASE i WHEN 1 THEN lead(x, 2) OVER w - 2 * lead(x) OVER w + x WHEN 64 THEN x - 2 * lag(x) OVER w + lag(x, 2) OVER w ELSE lead(x) OVER w - 2 * x + lag(x) OVER w END', 'step': 'lead(x) OVER w - x'})} FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)")

# Matrices: m is the 2 by 2 matrix of the first four entries with 2 on the diagonal added, t its symmetric part times two.
M = f"""(SELECT vec_id, m, array(2 * m[0], m[1] + m[2], m[1] + m[2], 2 * m[3]) AS t, slice(a, 5, 2) AS c FROM (SELECT vec_id, array(a[0] + 2, a[1], a[2], a[3] + 2) AS m, a FROM {S}) q) s"""
DM = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v[1] + 2 AS a, v[2] AS b, v[3] AS c, v[4] + 2 AS d, v[5] AS p, v[6] AS q FROM e), t AS (SELECT *, 2 * a AS r, b + c AS k, 2 * d AS s FROM m)"
add("mat_basic", f"SELECT vec_id, {_r({'trace': 'mat_trace(m)', 'det': 'mat_determinant(m)', 'square': 'mat_is_square(m)', 'no_square': 'mat_is_square(slice(m, 1, 3))', 'sym_m': 'mat_is_symmetric(m)', 'sym_t': 'mat_is_symmetric(t)', 'v1': 'mat_vec(m, c)[0]', 'v2': 'mat_vec(m, c)[1]', 'p11': 'mat_multiply(m, mat_transpose(m))[0]', 'p12': 'mat_multiply(m, mat_transpose(m))[1]', 'p22': 'mat_multiply(m, mat_transpose(m))[3]', 'one': 'mat_multiply(m, mat_inverse(m))[0]', 'inv12': 'mat_inverse(m)[1]', 'x1': 'mat_solve(m, c)[0]', 'x2': 'mat_solve(m, c)[1]', 'unit': 'mat_trace(mat_identity(3D))'})} FROM {M}",
    f"{DM} SELECT vec_id, {_r({'trace': 'a + d', 'det': 'a * d - b * c', 'square': '1.0::DOUBLE', 'no_square': '0.0::DOUBLE', 'sym_m': '0.0::DOUBLE', 'sym_t': '1.0::DOUBLE', 'v1': 'a * p + b * q', 'v2': 'c * p + d * q', 'p11': 'a * a + b * b', 'p12': 'a * c + b * d', 'p22': 'c * c + d * d', 'one': '1.0::DOUBLE', 'inv12': '-b / (a * d - b * c)', 'x1': '(d * p - b * q) / (a * d - b * c)', 'x2': '(a * q - c * p) / (a * d - b * c)', 'unit': '3.0::DOUBLE'})} FROM t")
add("mat_decompose", f"SELECT vec_id, {_r({'l11': 'mat_cholesky(t)[0]', 'l21': 'mat_cholesky(t)[2]', 'l22': 'mat_cholesky(t)[3]', 'pd': 'mat_is_positive_definite(t)', 'e1': 'mat_eigenvalues(t)[0]', 'e2': 'mat_eigenvalues(t)[1]', 'length': 'pow(mat_eigenvectors(t)[0], 2) + pow(mat_eigenvectors(t)[2], 2)', 'r11': 'abs(mat_qr_r(m)[0])', 'q11': 'abs(mat_qr_q(m)[0])', 's1': 'mat_singular_values(m)[0]', 's2': 'mat_singular_values(m)[1]'})} FROM {M}",
    f"{DM} SELECT vec_id, {_r({'l11': 'sqrt(r)', 'l21': 'k / sqrt(r)', 'l22': 'sqrt(s - k * k / r)', 'pd': '1.0::DOUBLE', 'e1': '(r + s) / 2 + sqrt(pow((r - s) / 2, 2) + k * k)', 'e2': '(r + s) / 2 - sqrt(pow((r - s) / 2, 2) + k * k)', 'length': '1.0::DOUBLE', 'r11': 'sqrt(a * a + c * c)', 'q11': 'abs(a) / sqrt(a * a + c * c)', 's1': 'sqrt((a*a+b*b+c*c+d*d) / 2 + sqrt(pow((a*a+b*b+c*c+d*d) / 2, 2) - pow(a * d - b * c, 2)))', 's2': 'sqrt((a*a+b*b+c*c+d*d) / 2 - sqrt(pow((a*a+b*b+c*c+d*d) / 2, 2) - pow(a * d - b * c, 2)))'})} FROM t")

# Distributions: at arguments with closed forms, or by Simpson's rule
X = "(SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS q, CAST(l_quantity / 10 AS DOUBLE) AS x, CAST(l_quantity / 51 AS DOUBLE) AS p FROM lineitem) s"
add("dist_normal", f"SELECT q, {_r({'c': 'norm_cdf(x - 2.5D)', 'u': 'norm_sf(x - 2.5D)', 'd': 'norm_pdf(x - 2.5D)', 'n': 'normal_cdf(x, 2.0D, 1.5D)', 'nd': 'normal_pdf(x, 2.0D, 1.5D)', 'back': 'norm_inv(norm_cdf(x - 2.5D))', 'nback': 'normal_inv(normal_cdf(x, 2.0D, 1.5D), 2.0D, 1.5D)', 'ln': 'lognorm_cdf(x, 0.5D, 0.8D)', 'lback': 'lognorm_inv(lognorm_cdf(x, 0.5D, 0.8D), 0.5D, 0.8D)', 'ef': 'erf(x - 2.5D)', 'efc': 'erfc(x - 2.5D)'}, 9)} FROM {X}",
    f"SELECT q, {_r({'c': PHI.format('(x - 2.5)'), 'u': '1 - ' + PHI.format('(x - 2.5)'), 'd': 'exp(-pow(x - 2.5, 2) / 2) / sqrt(2 * pi())', 'n': PHI.format('((x - 2) / 1.5)'), 'nd': 'exp(-pow((x - 2) / 1.5, 2) / 2) / (1.5 * sqrt(2 * pi()))', 'back': 'x - 2.5', 'nback': 'x', 'ln': PHI.format('((ln(x) - 0.5) / 0.8)'), 'lback': 'x', 'ef': '2 * ' + PHI.format('((x - 2.5) * sqrt(2))') + ' - 1', 'efc': '2 - 2 * ' + PHI.format('((x - 2.5) * sqrt(2))')}, 9)} FROM {X}")
add("dist_continuous", f"SELECT q, {_r({'t1': 't_cdf(x - 2, 1D)', 't1d': 't_pdf(x - 2, 1D)', 't2': 't_sf(x, 2D)', 't2b': 't_two_sided(x, 2D)', 't1i': 't_inv(p, 1D)', 'c2': 'chisq_cdf(x, 2D)', 'c2s': 'chisq_sf(x, 2D)', 'c2i': 'chisq_inv(p, 2D)', 'f22': 'f_cdf(x, 2D, 2D)', 'f22s': 'f_sf(x, 2D, 2D)', 'f22i': 'f_inv(p, 2D, 2D)', 'g1': 'gamma_cdf(x, 1D, 2D)', 'g2p': 'gamma_p(2D, x)', 'g2q': 'gamma_q(2D, x)', 'b22': 'beta_cdf(p, 2D, 2D)', 'bi': 'beta_i(1D, 3D, p)', 'ex': 'expon_cdf(x, 0.5D)', 'un': 'uniform_cdf(x, 1D, 4D)', 'lg': 'gammaln(q) - gammaln(q + 1)'}, 9)} FROM {X}",
    f"SELECT q, {_r({'t1': '0.5 + atan(x - 2) / pi()', 't1d': '1 / (pi() * (1 + pow(x - 2, 2)))', 't2': '0.5 - x / (2 * sqrt(2 + x * x))', 't2b': '1 - x / sqrt(2 + x * x)', 't1i': 'tan(pi() * (p - 0.5))', 'c2': '1 - exp(-x / 2)', 'c2s': 'exp(-x / 2)', 'c2i': '-2 * ln(1 - p)', 'f22': 'x / (1 + x)', 'f22s': '1 / (1 + x)', 'f22i': 'p / (1 - p)', 'g1': '1 - exp(-x / 2)', 'g2p': '1 - exp(-x) * (1 + x)', 'g2q': 'exp(-x) * (1 + x)', 'b22': '3 * p * p - 2 * p * p * p', 'bi': '1 - pow(1 - p, 3)', 'ex': '1 - exp(-x / 2)', 'un': 'least(greatest((x - 1) / 3, 0), 1)', 'lg': '-ln(q)'}, 9)} FROM {X}")
add("dist_discrete", f"SELECT k, {_r({'bp': 'binom_pmf(k, 12D, 0.3D)', 'bc': 'binom_cdf(k, 12D, 0.3D)', 'pp': 'poisson_pmf(k, 2.5D)', 'pc': 'poisson_cdf(k, 2.5D)'}, 10)} FROM (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS k FROM lineitem WHERE l_quantity <= 12) s",
    f"WITH k AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS k FROM lineitem WHERE l_quantity <= 12), j AS (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS j), w AS (SELECT j, factorial(12) / factorial(j) / factorial(12 - j) * pow(0.3, j) * pow(0.7, 12 - j) AS b, exp(-2.5) * pow(2.5, j) / factorial(j) AS p FROM j) SELECT k, {_r({'bp': 'max(CASE WHEN j = k THEN b END)', 'bc': 'sum(b)', 'pp': 'max(CASE WHEN j = k THEN p END)', 'pc': 'sum(p)'}, 10)} FROM k JOIN w ON j <= k GROUP BY k")

# Inference: p-values where few degrees of freedom give closed forms
add("inference_statistics", f"SELECT vec_id, {_r(_f('ttest_1samp_t(v, 0.01D)', 'ttest_1samp_df(v, 0.01D)', 'ttest_2samp_t(a, b)', 'ttest_2samp_df(a, b)', 'ttest_paired_t(a, b)', 'f_test_t(a, b)', 'jarque_bera_t(v)', 'jarque_bera_p(v)') | {'welch': 'ttest_df_welch(vec_variance(a), 32D, vec_variance(b), 32D)', 'chisq': 'chisq_test_t(transform(a, x -> x + 1), transform(b, x -> x + 2))'}, 7)} FROM {S}",
    f"{D}, m AS (SELECT vec_id, (avg(x) - 0.01) / (stddev_samp(x) / 8) AS t1, 64 / 6.0 * (pow(skewness(x), 2) + pow(kurtosis(x), 2) / 4) AS jb FROM e GROUP BY vec_id), w AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, avg(a - b) / (stddev_samp(a - b) / sqrt(32)) AS tp, sum(pow(a - b - 1, 2) / (b + 2)) AS cs FROM h GROUP BY vec_id) SELECT vec_id, {_r({'ttest_1samp_t': 't1', 'ttest_1samp_df': '63.0::DOUBLE', 'ttest_2samp_t': '(ma - mb) / sqrt((va + vb) / 32)', 'ttest_2samp_df': '31 * pow(va + vb, 2) / (va * va + vb * vb)', 'ttest_paired_t': 'tp', 'f_test_t': 'va / vb', 'jarque_bera_t': 'jb', 'jarque_bera_p': 'exp(-jb / 2)', 'welch': '31 * pow(va + vb, 2) / (va * va + vb * vb)', 'chisq': 'cs'}, 7)} FROM m JOIN w USING (vec_id)")
add("inference_pvalues", f"SELECT vec_id, {_r({'one': 'ttest_1samp_p(slice(v, 1, 2), 0D)', 'paired': 'ttest_paired_p(slice(v, 1, 2), slice(v, 3, 2))', 'f': 'f_test_p(slice(v, 1, 3), slice(v, 4, 3))', 'chisq': 'chisq_test_p(transform(slice(v, 1, 3), x -> x + 1), array(1D, 2D, 3D))', 'slope': 'regress_pvalue(slice(v, 1, 4), slice(v, 5, 4))', 'two': 'ttest_2samp_p(slice(v, 1, 2), transform(slice(v, 1, 2), x -> 1 - x))'}, 7)} FROM {S}",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, unnest(v[1:4]) AS x, unnest(v[5:8]) AS y FROM e), g AS (SELECT vec_id, corr(x, y) * sqrt(2) / sqrt(1 - pow(corr(x, y), 2)) AS t FROM u GROUP BY vec_id),
  c AS (SELECT vec_id, (v[1] + v[2]) / abs(v[1] - v[2]) AS t1, (v[1] - v[3] + v[2] - v[4]) / abs(v[1] - v[3] - v[2] + v[4]) AS t2, (pow(v[1] - v[2], 2) + pow(v[2] - v[3], 2) + pow(v[3] - v[1], 2)) / (pow(v[4] - v[5], 2) + pow(v[5] - v[6], 2) + pow(v[6] - v[4], 2)) AS f, pow(v[1], 2) + pow(v[2] - 1, 2) / 2 + pow(v[3] - 2, 2) / 3 AS x2, (v[1] + v[2] - 1) / (abs(v[1] - v[2]) / sqrt(2)) AS tw FROM e)
  SELECT vec_id, {_r({'one': '1 - 2 * atan(abs(t1)) / pi()', 'paired': '1 - 2 * atan(abs(t2)) / pi()', 'f': '2 * least(1 / (1 + f), f / (1 + f))', 'chisq': 'exp(-x2 / 2)', 'slope': '1 - abs(t) / sqrt(2 + t * t)', 'two': '1 - abs(tw) / sqrt(2 + tw * tw)'}, 7)} FROM c JOIN g USING (vec_id)""")
add("regression_line", f"SELECT vec_id, {_r(_f('regress_slope(a, b)', 'regress_intercept(a, b)', 'regress_r2(a, b)', 'regress_adj_r2(a, b)', 'regress_residual_error(a, b)', 'regress_stderr(a, b)', 'regress_tstat(a, b)', 'vec_regression_slope(a, b)', 'vec_regression_intercept(a, b)', 'vec_regression_r2(a, b)'), 7)} FROM {S}",
    f"{D}, r AS (SELECT vec_id, regr_slope(b, a) AS k, regr_intercept(b, a) AS c, regr_r2(b, a) AS r2, regr_sxx(b, a) AS sxx, sqrt(regr_syy(b, a) * (1 - regr_r2(b, a)) / 30) AS s FROM h GROUP BY vec_id) SELECT vec_id, {_r({'regress_slope': 'k', 'regress_intercept': 'c', 'regress_r2': 'r2', 'regress_adj_r2': '1 - (1 - r2) * 31 / 30', 'regress_residual_error': 's', 'regress_stderr': 's / sqrt(sxx)', 'regress_tstat': 'k / (s / sqrt(sxx))', 'vec_regression_slope': 'k', 'vec_regression_intercept': 'c', 'vec_regression_r2': 'r2'}, 7)} FROM r")
add("regression_multiple", f"SELECT vec_id, {_r({'r2': 'regress_multiple_r2(flatten(transform(slice(v, 1, 4), x -> array(1D, x))), slice(v, 5, 4), 2D)', 'p': 'regress_multiple_f_p(flatten(transform(slice(v, 1, 4), x -> array(1D, x))), slice(v, 5, 4), 2D)', 'ridge': 'regress_ridge_norm(a, b, 1D, 0.5D)'}, 7)} FROM {S}",
    f"{D}, u AS (SELECT l.vec_id, regr_r2(r.x, l.x) AS r2 FROM e l JOIN e r ON l.vec_id = r.vec_id AND r.i = l.i + 4 WHERE l.i <= 4 GROUP BY l.vec_id), g AS (SELECT vec_id, abs(sum(a * b) / (sum(a * a) + 0.5)) AS k FROM h GROUP BY vec_id) SELECT vec_id, {_r({'r2': 'r2', 'p': '1 - sqrt(r2)', 'ridge': 'k'}, 7)} FROM u JOIN g USING (vec_id)")

# Series
add("series_steps", _by_place({'ret': 'ts_returns(p)', 'log_ret': 'ts_log_returns(p)'}, 63),
    f"{D} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {_r({'ret': 'n / p - 1', 'log_ret': 'ln(n / p)'})} FROM (SELECT *, lead(p) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM s) q WHERE n IS NOT NULL")
add("series_rolling", _by_place({'mean': 'ts_rolling_mean(v, 5D)', 'low': 'ts_rolling_min(v, 5D)', 'high': 'ts_rolling_max(v, 5D)', 'sd': 'ts_rolling_std(v, 5D)'}),
    f"{D} SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {_r({k: f'CASE WHEN i >= 5 THEN {f}(x) OVER w END' for k, f in (('mean', 'avg'), ('low', 'min'), ('high', 'max'), ('sd', 'stddev_samp'))})} FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("series_drawdown", _by_place({'fall': 'ts_drawdown(p)', 'deepest': 'array_repeat(ts_max_drawdown(p), 64)'}),
    f"{D}, q AS (SELECT vec_id, i, p / max(p) OVER (PARTITION BY vec_id ORDER BY i) - 1 AS f FROM s) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, {_r({'fall': 'f', 'deepest': 'min(f) OVER (PARTITION BY vec_id)'})} FROM q")
add("series_scalars", f"SELECT vec_id, {_r({'ac0': 'ts_autocorrelation(v, 0D)', 'ac3': 'ts_autocorrelation(v, 3D)', 'compound': 'ts_cumulative_return(v)', 'smooth': 'element_at(ts_ewma(v, 0.3D), -1)'})} FROM {S}",
    f"{D}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS d FROM e), l AS (SELECT *, lag(d, 3) OVER (PARTITION BY vec_id ORDER BY i) AS d3 FROM m) SELECT vec_id, {_r({'ac0': '1.0::DOUBLE', 'ac3': 'sum(d * d3) / sum(d * d)', 'compound': 'exp(sum(ln(1 + x))) - 1', 'smooth': 'sum(x * pow(0.7, 64 - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END)'})} FROM l GROUP BY vec_id")

# Finance and risk
add("finance_flows", f"SELECT vec_id, {_r({'npv': 'npv(0.05D, v)', 'now': 'npv_from_now(0.05D, v)', 'irr': 'irr(array(-100D, 100 + 50 * v[0]))'})} FROM {S}",
    f"{D} SELECT vec_id, {_r({'npv': 'sum(x / pow(1.05, i))', 'now': 'sum(x / pow(1.05, i - 1))', 'irr': 'max(CASE WHEN i = 1 THEN x / 2 END)'})} FROM e GROUP BY vec_id")
add("finance_annuity", f"SELECT q, {_r({'present': 'pv(0.01D, q, -100D, 0D)', 'future': 'fv(0.01D, q, -100D, 50D)', 'pay': 'pmt(0.01D, q, 1000D, 0D)', 'flat': 'pv(0D, q, -100D, 0D)', 'straight': 'sln(1000D, 100D, q)', 'digits': 'syd(1000D, 100D, q, 1D)'})} FROM {X}",
    f"SELECT q, {_r({'present': '(SELECT sum(100 / pow(1.01, unnest)) FROM unnest(range(1, q::INTEGER + 1)))', 'future': '-50 * pow(1.01, q) + (SELECT sum(100 * pow(1.01, unnest)) FROM unnest(range(0, q::INTEGER)))', 'pay': '-1000 / (SELECT sum(1 / pow(1.01, unnest)) FROM unnest(range(1, q::INTEGER + 1)))', 'flat': '100 * q', 'straight': '900 / q', 'digits': '900 * q / (q * (q + 1) / 2)'})} FROM {X}")
add("risk_measures", f"SELECT vec_id, {_r({'var5': 'var_historical(v, 0.05D)', 'es5': 'expected_shortfall(v, 0.05D)', 'sharpe': 'sharpe(v, 0.001D)', 'sortino': 'sortino(v, 0.001D)'})} FROM {S}",
    f"{D}, q AS (SELECT *, quantile_cont(x, 0.05) OVER (PARTITION BY vec_id) AS k FROM e) SELECT vec_id, {_r({'var5': 'max(k)', 'es5': 'avg(x) FILTER (WHERE x <= k)', 'sharpe': '(avg(x) - 0.001) / stddev_samp(x)', 'sortino': '(avg(x) - 0.001) / sqrt(sum(pow(least(x - 0.001, 0), 2)) / 64)'})} FROM q GROUP BY vec_id")
D1 = "((ln(q / 25) + (0.03 + 0.02) * 0.5) / (0.2 * sqrt(0.5)))"
D2 = "((ln(q / 25) + (0.03 - 0.02) * 0.5) / (0.2 * sqrt(0.5)))"
add("option_prices", f"SELECT q, {_r({'call': 'black_scholes_call(q, 25D, 0.03D, 0.2D, 0.5D)', 'put': 'black_scholes_put(q, 25D, 0.03D, 0.2D, 0.5D)', 'delta': 'greeks_delta(q, 25D, 0.03D, 0.2D, 0.5D)', 'vega': 'greeks_vega(q, 25D, 0.03D, 0.2D, 0.5D)'}, 6)} FROM {X} WHERE q BETWEEN 15 AND 40",
    f"SELECT q, {_r({'call': f'q * {PHI.format(D1)} - 25 * exp(-0.015) * {PHI.format(D2)}', 'put': f'q * {PHI.format(D1)} - 25 * exp(-0.015) * {PHI.format(D2)} - q + 25 * exp(-0.015)', 'delta': PHI.format(D1), 'vega': f'q * exp(-pow({D1}, 2) / 2) / sqrt(2 * pi()) * sqrt(0.5)'}, 6)} FROM {X} WHERE q BETWEEN 15 AND 40")

# Scalar functions beside the catalogue, and packs
add("scalar_gaps", "SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS g, lcm(o_orderkey, o_custkey) AS l, trunc_number(-o_totalprice, 1) AS t, iszero(o_totalprice) AS z, strpos(o_orderpriority, '-') AS p, substr_index(o_orderpriority, '-', 1) AS s, to_hex(o_orderkey) AS h, starts_with(o_orderpriority, '1') AS sw, ends_with(o_orderpriority, 'H') AS ew, regexp_match(o_orderpriority, '[A-Z]+') AS m, concat_known(o_orderstatus, nullif(o_orderpriority, '5-LOW')) AS c, date_bin(INTERVAL '3' DAY, CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1995-01-02 00:00:00') AS b, to_unixtime(CAST(o_orderdate AS TIMESTAMP)) AS u, to_timestamp_millis(o_orderkey) AS ms FROM orders",
    "SELECT o_orderkey, CAST(gcd(o_orderkey, o_custkey) AS BIGINT) AS g, CAST(lcm(o_orderkey, o_custkey) AS BIGINT) AS l, trunc(-o_totalprice * 10) / 10 AS t, o_totalprice = 0 AS z, CAST(strpos(o_orderpriority, '-') AS INTEGER) AS p, split_part(o_orderpriority, '-', 1) AS s, lower(to_hex(o_orderkey)) AS h, starts_with(o_orderpriority, '1') AS sw, ends_with(o_orderpriority, 'H') AS ew, regexp_extract(o_orderpriority, '[A-Z]+') AS m, concat(o_orderstatus, nullif(o_orderpriority, '5-LOW')) AS c, time_bucket(INTERVAL '3 days', o_orderdate, TIMESTAMP '1995-01-02') AS b, CAST(epoch(o_orderdate) AS BIGINT) AS u, make_timestamp(o_orderkey * 1000) AS ms FROM orders")
add("pack_functions", "SELECT l_orderkey, l_linenumber, l_partkey, round(telemetry_breach_severity(l_quantity, 20), 8) AS severity, telemetry_window_start(l_partkey - 100, 60) AS w, round(logistics_leg_cost(l_quantity, l_tax), 8) AS cost, logistics_dwell_hours(TIMESTAMP '1990-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP)) AS hours, logistics_check_digit(CAST(l_orderkey AS STRING)) AS digit FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest((l_quantity - 20) / 20, 0), 8) AS severity, CAST(floor((l_partkey - 100) / 60.0) * 60 AS BIGINT) AS w, round(l_quantity * l_tax, 8) AS cost, datediff('hour', TIMESTAMP '1990-01-01', l_shipdate)::DOUBLE AS hours, CAST((11 - list_sum(list_transform(range(1, length(CAST(l_orderkey AS VARCHAR)) + 1), lambda i: CAST(substr(CAST(l_orderkey AS VARCHAR), i, 1) AS INTEGER) * ((i - 1) % 6 + 2))) % 11) % 11 AS BIGINT) AS digit FROM lineitem")
add("pack_table_function", "SELECT band, lower, upper FROM telemetry_threshold_bands(10D)", "SELECT * FROM (VALUES ('nominal', 0.0::DOUBLE, 10.0::DOUBLE), ('elevated', 10.0, 15.0), ('critical', 15.0, 'Infinity'::DOUBLE)) t(band, lower, upper)")
