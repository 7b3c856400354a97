"""The rest of the relational surface: sets, grouping, windows, functions."""

from __future__ import annotations

from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

R.sql("projection", "SELECT o_orderkey, CAST(o_totalprice * 100 AS BIGINT) AS cents, upper(o_orderpriority) AS priority FROM {orders}", "SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS cents, upper(o_orderpriority) AS priority FROM orders")
R.sql("filter_between", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus <> 'F'")
R.sql("filter_like", "SELECT p_partkey FROM {part} WHERE p_type LIKE 'PRO%' OR p_name LIKE '%o_t'")
R.sql("filter_is_null", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer}) t WHERE k IS NULL")
R.sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
R.sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
R.sql("intersect", "SELECT nullif(c_nationkey, 3) AS k FROM {customer} INTERSECT SELECT nullif(s_nationkey, 3) FROM {supplier}")
R.sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
R.sql("except", "SELECT nullif(c_custkey, 3) AS k FROM {customer} EXCEPT SELECT nullif(o_custkey, 5) FROM {orders} WHERE o_totalprice > 200000")
R.sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
R.sql("group_by", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
R.sql("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
R.sql("distinct_agg", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM {lineitem} GROUP BY l_returnflag")
R.sql("filtered_agg", "SELECT l_linestatus, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large, round(sum(l_tax) FILTER (WHERE l_returnflag = 'A'), 4) AS tax FROM {lineitem} GROUP BY l_linestatus")
R.sql("rollup", "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
R.sql("cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
R.sql("window_rank", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS INTEGER) AS d FROM {customer}")
R.sql("window_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}")
R.sql("window_lag", "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM {events}")
R.sql("top_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) t WHERE r <= 3")
R.sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})")
R.sql("correlated_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
R.sql("case_when", "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'middle' ELSE 'large' END AS size, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY 1")
R.sql("date_parts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1, 2")
R.sql("date_interval", "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1996-01-31' + INTERVAL '1' MONTH AND o_orderdate < DATE '1996-05-01' - INTERVAL '3' DAY")
R.sql("string_functions", "SELECT c_custkey, substring(c_name, 1, 4) AS head, length(c_name) AS n, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR(10))) AS tag FROM {customer}", "SELECT c_custkey, substring(c_name, 1, 4) AS head, CAST(length(c_name) AS INTEGER) AS n, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS tag FROM customer")
R.sql("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
R.sql("array_functions", "SELECT vec_id, size(embedding) AS n, round(CAST(embedding[0] AS DOUBLE), 6) AS head FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS head FROM embeddings")
R.sql("cte", "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), best AS (SELECT max(total) AS top FROM spend) SELECT o_custkey, round(total, 2) AS total FROM spend, best WHERE total > top * 0.8")
R.sql("limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
R.sql("map_functions", "SELECT c_custkey, m['a'] AS a, CAST(size(m) AS INTEGER) AS n FROM (SELECT c_custkey, map('a', c_nationkey, 'b', c_nationkey + 1) AS m FROM {customer}) t", "SELECT c_custkey, m['a'] AS a, CAST(cardinality(m) AS INTEGER) AS n FROM (SELECT c_custkey, MAP {'a': c_nationkey, 'b': c_nationkey + 1} AS m FROM customer) t")
