"""Relational queries over the sample tables: each a Spark plan and, by the same name, SQL for a second engine.

The plans are Spark SQL where that is the plain form; what differs between engines (integer division, null order, QUALIFY,
DISTINCT ON, GROUPS frames) is written the Spark way here and the other engine's way in ORACLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SQL: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a query names."""
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def add(name: str, sql: str, oracle: str | None = None) -> None:
    SQL[name] = sql
    ORACLE[name] = oracle or sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(text: str) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, text)
            return spark.sql(text)

        return run

    return {k: of(v) for k, v in SQL.items()}


REV = "l_extendedprice * (1 - l_discount)"

# Reporting queries
add("tpch_q1", f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({REV}), 2) AS sum_disc,
  round(sum({REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
add("tpch_q3", f"""SELECT o_orderkey, o_orderdate, o_orderpriority, round(sum({REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15' GROUP BY o_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderkey LIMIT 10""")
add("tpch_q5", f"""SELECT n_name, round(sum({REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name""")
add("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
add("needle_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey = 4711")

# Projections, filters, predicates
add("project_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price, CAST(o_orderkey AS STRING) AS k, o_orderkey % 7 AS m FROM orders")
add("integer_division", "SELECT o_orderkey, o_orderkey DIV 7 AS d, -o_orderkey DIV 7 AS neg, -o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, -o_orderkey // 7 AS neg, -o_orderkey % 7 AS r FROM orders")
add("filter_predicates", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#3') AND p_type IS NOT NULL AND NOT (p_name LIKE '%7_')")
add("three_valued_logic", """SELECT c_custkey, (x > 0) AS gt, (x > 0 OR TRUE) AS t, (x > 0 AND FALSE) AS f, x IS NULL AS missing, x IS DISTINCT FROM 1 AS dist, coalesce(x, -1) AS c
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 END AS x FROM customer) q""")

# Joins
add("join_inner", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000")
add("join_left", "SELECT o_orderkey, count(l_orderkey) AS n, sum(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
add("join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
add("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k")
add("join_cross", "SELECT r_name, c_mktsegment, count(*) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s GROUP BY r_name, c_mktsegment")
add("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
add("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
add("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
add("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey = 1 THEN NULL ELSE s_nationkey END FROM supplier)")
add("join_self", "SELECT a.c_custkey AS c1, b.c_custkey AS c2 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey WHERE a.c_acctbal > 9000 AND b.c_acctbal > 9000")
add("join_natural_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
add("subquery_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
add("join_lateral", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 2) t")

# Aggregation
add("agg_basic", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS custs, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(median(o_totalprice), 4) AS mid, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
add("agg_ordered", "SELECT o_custkey, min_by(o_orderkey, o_totalprice) AS cheapest, max_by(o_orderkey, o_totalprice) AS dearest, array_join(array_sort(collect_list(o_orderstatus)), ',') AS statuses FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey")
add("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g1, CAST(grouping(l_linestatus) AS TINYINT) AS g2, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
add("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
add("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
add("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even FROM events GROUP BY event_type")
add("agg_moments", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(var_samp(value), 5) AS v, round(var_pop(value), 5) AS vp, round(covar_samp(value, user_id), 5) AS cs, round(covar_pop(value, user_id), 5) AS cp, round(corr(value, user_id), 8) AS r FROM events GROUP BY event_type")
add("agg_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem GROUP BY l_returnflag")
add("agg_percentile", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q9 FROM orders GROUP BY o_orderstatus")
add("agg_bool_bit", "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS every_one, bool_or(c_acctbal > 9990) AS any_one, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx FROM customer GROUP BY c_mktsegment")
add("agg_empty", "SELECT sum(o_totalprice) AS s, count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
add("agg_skew_kurtosis", "SELECT event_type, round(sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) * skewness(value), 6) AS sk, round((count(*) - 1) / ((count(*) - 2) * (count(*) - 3)) * ((count(*) + 1) * kurtosis(value) + 6), 6) AS ku FROM events GROUP BY event_type", "SELECT event_type, round(skewness(value), 6) AS sk, round(kurtosis(value), 6) AS ku FROM events GROUP BY event_type")

# Windows
add("window_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
add("window_offset", "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, first_value(value) OVER w AS first_v, nth_value(value, 2) OVER w AS second_v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
add("window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_n, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS peak FROM events")
add("window_groups", "SELECT p_partkey, sum(p_size) OVER (ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM (SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size) AS g FROM part) q", "SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
add("window_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")

# Sorting, limits, sets, CTEs
add("sort_nulls", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY x ASC NULLS LAST, n_nationkey) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST, n_nationkey) AS BIGINT) AS d FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 5 END AS x FROM nation) q")
add("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
add("distinct_on", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) q WHERE rn = 1", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id")
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("set_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
add("set_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation")
add("set_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer")
add("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("cte", "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), m AS (SELECT max(s) AS top FROM t) SELECT k, round(s, 2) AS s FROM t, m WHERE s > 0.5 * top")
add("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
add("values_rows", "SELECT a, b FROM VALUES (1, 'x'), (2, NULL), (NULL, 'z') AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)")
add("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open_q, 'F' AS filled_q))", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_q, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS filled_q FROM lineitem GROUP BY l_returnflag")

# Scalar functions of the engine
add("scalar_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity) + cbrt(l_quantity) + ln(l_quantity) + log10(l_quantity) + log2(l_quantity), 8) AS a, round(sin(l_tax) + cos(l_tax) + tan(l_tax) + atan2(l_tax, l_quantity) + degrees(l_tax) + radians(l_quantity), 8) AS b, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, sign(l_discount - 0.05) AS sg, power(l_linenumber, 3) AS p, abs(-l_quantity) AS ab FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity) + cbrt(l_quantity) + ln(l_quantity) + log10(l_quantity) + log2(l_quantity), 8) AS a, round(sin(l_tax) + cos(l_tax) + tan(l_tax) + atan2(l_tax, l_quantity) + degrees(l_tax) + radians(l_quantity), 8) AS b, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sg, power(l_linenumber, 3) AS p, abs(-l_quantity) AS ab FROM lineitem")
add("scalar_text", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substr(c_name, 2, 5) AS s, lpad(c_mktsegment, 12, '*') AS lp, replace(c_name, '0', 'o') AS r, instr(c_name, '0') AS i, reverse(c_mktsegment) AS rv, split_part(c_name, '#', 2) AS sp, concat_ws('-', c_mktsegment, c_name) AS cw, left(c_mktsegment, 3) AS lf, right(c_name, 3) AS rt, translate(c_mktsegment, 'AEI', 'xyz') AS tr, levenshtein(c_mktsegment, 'BUILDING') AS lv, ascii(c_mktsegment) AS asc_v, md5(c_name) AS h, starts FROM (SELECT *, startswith(c_name, 'C') AS starts FROM customer) q",
    "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, substr(c_name, 2, 5) AS s, lpad(c_mktsegment, 12, '*') AS lp, replace(c_name, '0', 'o') AS r, CAST(instr(c_name, '0') AS INTEGER) AS i, reverse(c_mktsegment) AS rv, split_part(c_name, '#', 2) AS sp, concat_ws('-', c_mktsegment, c_name) AS cw, left(c_mktsegment, 3) AS lf, right(c_name, 3) AS rt, translate(c_mktsegment, 'AEI', 'xyz') AS tr, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INTEGER) AS lv, ascii(c_mktsegment) AS asc_v, md5(c_name) AS h, starts_with(c_name, 'C') AS starts FROM customer")
add("scalar_regexp", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+)', 1) AS first_word, regexp_replace(p_brand, '[0-9]', '#') AS masked, p_brand RLIKE '2' AS has2 FROM part", "SELECT p_partkey, regexp_extract(p_type, '([A-Z]+)', 1) AS first_word, regexp_replace(p_brand, '[0-9]', '#', 'g') AS masked, regexp_matches(p_brand, '2') AS has2 FROM part")
add("scalar_dates", "SELECT o_orderkey, date_trunc('MONTH', o_orderdate) AS month_start, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS d, quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM-dd') AS txt, datediff(o_orderdate, DATE '1995-01-01') AS days FROM orders",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofyear(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y-%m-%d') AS txt, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
add("scalar_conditional", "SELECT c_custkey, nullif(c_nationkey, 3) AS nf, ifnull(nullif(c_nationkey, 3), -1) AS ni, greatest(c_acctbal, 0.0D) AS g, least(c_acctbal, 0.0D) AS l, nvl2(nullif(c_nationkey, 3), 'y', 'n') AS n2 FROM customer",
    "SELECT c_custkey, nullif(c_nationkey, 3) AS nf, ifnull(nullif(c_nationkey, 3), -1) AS ni, greatest(c_acctbal, 0.0) AS g, least(c_acctbal, 0.0) AS l, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 'y' ELSE 'n' END AS n2 FROM customer")
add("date_bins", "SELECT timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 21600000000 * 21600000000) AS bin, count(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bin, count(*) AS n FROM events GROUP BY 1")
