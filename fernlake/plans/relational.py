"""Relational operators and scalar functions: one SQL text for Spark, and the same or its twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def runner(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def not_in(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column is NOT IN the keys, nulls as in SQL: no keys keep every row, else a null on either side keeps none.

    Spark broadcasts what NOT IN names, however large; here the anti join can be dealt out.
    """
    state = keys.agg(F.count("*").alias("__n"), F.count(key).alias("__known"))
    kept = rows.join(keys.select(F.col(key).alias("__key")).distinct(), F.col(column) == F.col("__key"), "left_anti")
    return kept.join(F.broadcast(state), (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(column).isNotNull()), "left_semi")


def subquery_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    return not_in(part.select("p_partkey"), "p_partkey", lineitem.where("l_quantity > 25").select("l_partkey"), "l_partkey")


#: Exact sums: doubles go through decimals, so that neither engine's order of adding shows.
def total(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


REVENUE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
MONEY = f"CAST(SUM({REVENUE}) AS DOUBLE)"

#: name -> SQL for both engines, or (SQL for Spark, SQL for the oracle).
QUERIES: dict[str, str | tuple[str, str]] = {
    "project_cast": "SELECT l_orderkey AS k, l_linenumber + 1 AS line, CAST(l_quantity AS BIGINT) AS qty, CAST(l_orderkey AS VARCHAR(20)) AS txt FROM lineitem",
    "filter_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 1000 AND o_orderstatus <> 'F') OR NOT (o_orderpriority >= '3' OR o_custkey < 100)",
    "filter_between_in_null": "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, event_type FROM events) e WHERE event_type IN ('click', 'view') AND (v IS NULL OR v BETWEEN 10 AND 60)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR p_name LIKE 'p_rt%'",
    "filter_is_true": "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END AS b FROM events) e WHERE b IS TRUE",
    "null_safe_equal": ("SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'view') AS t FROM events) e WHERE t <=> NULL", "SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'view') AS t FROM events) e WHERE t IS NOT DISTINCT FROM NULL"),
    "integer_division": ("SELECT event_id, event_id DIV 7 AS q, event_id % 7 AS r FROM events", "SELECT event_id, event_id // 7 AS q, event_id % 7 AS r FROM events"),
    "join_inner": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_full": "SELECT a.u AS u1, b.u AS u2, a.n AS n1, b.n AS n2 FROM (SELECT user_id AS u, COUNT(*) AS n FROM events WHERE event_type = 'click' AND user_id % 3 < 2 GROUP BY user_id) a FULL JOIN (SELECT user_id AS u, COUNT(*) AS n FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY user_id) b ON a.u = b.u",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300)"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_cross": "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_multi": f"SELECT n_name, {MONEY} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "agg_basic": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {total('l_quantity')} AS qty, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, {MONEY} AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_avg_stddev": f"SELECT l_returnflag, ROUND({total('l_quantity')} / COUNT(*), 6) AS avg_qty, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 5) AS vp FROM lineitem GROUP BY l_returnflag",
    "agg_count_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 3 AND MIN(o_totalprice) > 0",
    "agg_expression": "SELECT user_id % 10 AS g, COUNT(*) + 1 AS n1, MAX(event_id) - MIN(event_id) AS span FROM events GROUP BY user_id % 10",
    "agg_filter_clause": "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(*) AS n FROM events GROUP BY user_id",
    "agg_bool": "SELECT user_id, BOOL_AND(value > 1) AS every, BOOL_OR(value > 95) AS some FROM events GROUP BY user_id",
    "agg_median": "SELECT event_type, ROUND(MEDIAN(value), 6) AS med FROM events GROUP BY event_type",
    "agg_corr": "SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "agg_arg_max": "SELECT event_type, MAX_BY(event_id, event_id % 1000 * 100000 + event_id % 997) AS at_max FROM events GROUP BY event_type",
    "agg_array": ("SELECT user_id, ARRAY_JOIN(ARRAY_SORT(COLLECT_SET(event_type)), ',') AS kinds FROM events GROUP BY user_id", "SELECT user_id, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id"),
    "agg_string": ("SELECT n_regionkey, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_empty": "SELECT COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS s, MIN(event_type) AS lo FROM events WHERE event_id < 0",
    "rollup": "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n, CAST(GROUPING(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "window_rank": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_distribution": "SELECT o_orderkey, CAST(NTILE(4) OVER w AS BIGINT) AS q, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
    "window_lag_lead": "SELECT event_id, LAG(event_id, 1) OVER w AS prev, LEAD(event_id, 2, -1) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "window_frame": "SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events".replace("SUM(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)"),
    "window_first_last": "SELECT event_id, FIRST_VALUE(event_type) OVER w AS f, LAST_VALUE(event_type) OVER w AS l, NTH_VALUE(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 100",
    "sort_nulls": "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 13 END AS v FROM events) e ORDER BY v DESC NULLS LAST, event_id ASC NULLS LAST LIMIT 50",
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT user_id AS x FROM events UNION SELECT o_custkey FROM orders",
    "intersect": "SELECT user_id AS x FROM events INTERSECT SELECT c_custkey FROM customer",
    "except": "SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey FROM orders",
    "intersect_all": "SELECT user_id % 9 AS x FROM events INTERSECT ALL SELECT n_regionkey FROM nation",
    "except_all": "SELECT user_id % 9 AS x FROM events EXCEPT ALL SELECT n_regionkey FROM nation",
    "distinct": "SELECT DISTINCT event_type, user_id % 5 AS g FROM events",
    "cte": "WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE n >= 10) SELECT c_name, n FROM customer JOIN big ON c_custkey = k WHERE k IN (SELECT k FROM top)",
    "recursive_cte": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n FROM r",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "subquery_correlated": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "subquery_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)",
    "subquery_exists": "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0)",
    "values": "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, b)",
    "select_no_from": "SELECT 1 AS one, 'x' AS s, CAST(NULL AS INT) AS n",
    "case_conditional": "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS c, COALESCE(NULLIF(event_type, 'error'), 'none') AS t, GREATEST(event_id, user_id) AS g, LEAST(event_id, user_id) AS l FROM events",
    "tpch_q1": f"SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS sum_qty, {total('l_extendedprice')} AS sum_base_price, {MONEY} AS sum_disc_price, ROUND({total('l_discount')} / COUNT(*), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": f"SELECT l_orderkey, {MONEY} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q6": f"SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.09 AND l_quantity < 24",
    # --- scalar functions ---
    "fn_string": ("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS s, CAST(strpos(p_name, 'a') AS BIGINT) AS p, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim(concat('  ', p_brand, ' ')) AS t, replace(p_type, 'A', 'ae') AS r, translate(p_type, 'ABC', 'xyz') AS tr, reverse(p_brand) AS rv, concat_ws('/', p_brand, p_type) AS cw, starts_with(p_name, 'p') AS sw, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS lv, split_part(p_name, ' ', 1) AS sp FROM part".replace("strpos(p_name, 'a')", "locate('a', p_name)").replace("starts_with", "startswith"), "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS s, CAST(strpos(p_name, 'a') AS BIGINT) AS p, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, trim(concat('  ', p_brand, ' ')) AS t, replace(p_type, 'A', 'ae') AS r, translate(p_type, 'ABC', 'xyz') AS tr, reverse(p_brand) AS rv, concat_ws('/', p_brand, p_type) AS cw, starts_with(p_name, 'p') AS sw, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS lv, split_part(p_name, ' ', 1) AS sp FROM part"),
    "fn_initcap": ("SELECT c_custkey, initcap(c_mktsegment) AS i FROM customer", "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i FROM customer"),
    "fn_regex": ("SELECT p_partkey, regexp_like(p_name, '[0-9]+') AS m, regexp_replace(p_name, '[aeiou]', '_') AS r, CAST(regexp_count(p_name, '[a-z]') AS BIGINT) AS n FROM part", "SELECT p_partkey, regexp_matches(p_name, '[0-9]+') AS m, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, len(regexp_extract_all(p_name, '[a-z]')) AS n FROM part"),
    "fn_date": ("SELECT event_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS h, CAST(date_part('dow', ts) - 1 AS BIGINT) AS dow, CAST(year(ts) AS BIGINT) AS y, CAST(date_part('doy', ts) AS BIGINT) AS doy, make_date(2024, 2, 29) AS leap, CAST(datediff(DATE '2024-03-01', CAST(ts AS DATE)) AS BIGINT) AS d FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, date_part('dow', ts) AS dow, year(ts) AS y, date_part('doy', ts) AS doy, make_date(2024, 2, 29) AS leap, datediff('day', CAST(ts AS DATE), DATE '2024-03-01') AS d FROM events"),
    "fn_date_bin": ("SELECT window(ts, '15 minutes').start AS b, COUNT(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL '15 minutes', ts) AS b, COUNT(*) AS n FROM events GROUP BY 1"),
    "fn_math": ("SELECT event_id, abs(event_id - 500) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 9) AS s, round(ln(value + 1), 9) AS l, round(log10(value + 1), 9) AS l10, round(power(value, 2), 4) AS p, sign(event_id - 5) AS sg FROM events".replace("sign(event_id - 5)", "CAST(sign(event_id - 5) AS INT)"), "SELECT event_id, abs(event_id - 500) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 9) AS s, round(ln(value + 1), 9) AS l, round(log10(value + 1), 9) AS l10, round(power(value, 2), 4) AS p, CAST(sign(event_id - 5) AS INT) AS sg FROM events"),
    "fn_trunc": ("SELECT event_id, CASE WHEN v < 0 THEN ceil(v) ELSE floor(v) END AS t FROM (SELECT event_id, value - 50 AS v FROM events) e".replace("CASE WHEN", "CAST(CASE WHEN").replace("END AS", "END AS BIGINT) AS"), "SELECT event_id, CAST(trunc(value - 50) AS BIGINT) AS t FROM events"),
    "fn_gcd": ("WITH RECURSIVE g(id, a, b) AS (SELECT n_nationkey, n_nationkey + 12, n_regionkey + 6 FROM nation UNION ALL SELECT id, b, a % b FROM g WHERE b <> 0) SELECT id, a AS gcd FROM g WHERE b = 0", "SELECT n_nationkey AS id, CAST(gcd(n_nationkey + 12, n_regionkey + 6) AS INT) AS gcd FROM nation"),
    "fn_array": ("SELECT n_nationkey AS k, size(a) AS n, array_contains(a, 3) AS has, element_at(a, 1) AS e1, array_join(array_sort(array_distinct(a)), ',') AS j FROM (SELECT n_nationkey, array(n_regionkey, 3, n_nationkey, 3) AS a FROM nation) x", "SELECT n_nationkey AS k, CAST(len(a) AS INT) AS n, list_contains(a, 3) AS has, a[1] AS e1, array_to_string(list_sort(list_distinct(a)), ',') AS j FROM (SELECT n_nationkey, [n_regionkey, 3, n_nationkey, 3] AS a FROM nation) x"),
    "fn_unnest": ("SELECT n_nationkey AS k, x FROM nation LATERAL VIEW explode(sequence(CAST(0 AS BIGINT), CAST(n_regionkey AS BIGINT))) t AS x", "SELECT n_nationkey AS k, unnest(range(0, n_regionkey + 1)) AS x FROM nation"),
    "fn_map": ("SELECT n_nationkey AS k, element_at(m, n_name) AS v, array_join(map_keys(m), ',') AS ks, size(map_values(m)) AS n FROM (SELECT n_nationkey, n_name, map(n_name, n_regionkey, 'z', 9) AS m FROM nation) x", "SELECT n_nationkey AS k, m[n_name] AS v, array_to_string(map_keys(m), ',') AS ks, CAST(len(map_values(m)) AS INT) AS n FROM (SELECT n_nationkey, n_name, MAP {n_name: n_regionkey, 'z': 9} AS m FROM nation) x"),
    "fn_hash": ("SELECT n_name, md5(n_name) AS m, sha2(n_name, 256) AS s, hex(n_name) AS h, base64(CAST(n_name AS BINARY)) AS b, octet_length(CAST(n_name AS BINARY)) AS n FROM nation", "SELECT n_name, md5(n_name) AS m, sha256(n_name) AS s, hex(n_name) AS h, base64(encode(n_name)) AS b, CAST(octet_length(encode(n_name)) AS INT) AS n FROM nation"),
    "fn_civil_time": ("SELECT to_timestamp_ntz('2021-03-04T05:06:07') AS t, date_format(TIMESTAMP_NTZ '2021-03-04 05:06:07', \"yyyy-MM-dd'T'HH:mm\") AS w", "SELECT TIMESTAMP '2021-03-04 05:06:07' AS t, strftime(TIMESTAMP '2021-03-04 05:06:07', '%Y-%m-%dT%H:%M') AS w"),
    "asof_join": ("SELECT o_orderkey, (SELECT MAX(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderkey < o.o_orderkey) AS prev FROM orders o".replace("SELECT o_orderkey, (SELECT MAX(i.o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderkey < o.o_orderkey) AS prev FROM orders o", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders"), "SELECT o.o_orderkey, i.o_orderkey AS prev FROM orders o ASOF LEFT JOIN orders i ON i.o_custkey = o.o_custkey AND i.o_orderkey < o.o_orderkey"),
}
#: Approximate aggregates have no exact twin.
ROWS_ONLY = {
    "agg_approx": "SELECT event_type, approx_count_distinct(user_id) AS users, percentile_approx(value, 0.5, 10000) AS med FROM events GROUP BY event_type",
}


def queries() -> dict:
    both = {name: text if isinstance(text, str) else text[0] for name, text in QUERIES.items()} | ROWS_ONLY
    return {name: runner(text) for name, text in both.items()} | {"subquery_in": subquery_in}


def oracle_sql() -> dict[str, str]:
    return {name: text if isinstance(text, str) else text[1] for name, text in QUERIES.items()}
