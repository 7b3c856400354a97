"""A decision-support suite over the driver tables.

The tables lack partsupp, comments, phones, addresses and some dates; the
queries keep the shape of the well-known suite with the columns that exist.
What would be in partsupp is derived from the line items.
"""

from __future__ import annotations

from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_REVENUE = "l_extendedprice * (1 - l_discount)"
_PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM {lineitem} GROUP BY l_partkey, l_suppkey)"

R.sql("tpch_q01", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({_REVENUE}), 2) AS sum_disc_price, round(sum({_REVENUE} * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""")  # fmt: skip
R.sql("tpch_q02", f"""
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM {{part}}, {{supplier}}, {_PARTSUPP} ps, {{nation}}, {{region}}
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND p_type LIKE 'PROMO%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(l_extendedprice / l_quantity) FROM {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100
""")  # fmt: skip
R.sql("tpch_q03", f"""
SELECT l_orderkey, round(sum({_REVENUE}), 2) AS revenue, o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")  # fmt: skip
R.sql("tpch_q04", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS order_count FROM {orders}
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 30)
GROUP BY o_orderpriority ORDER BY o_orderpriority
""")  # fmt: skip
R.sql("tpch_q05", f"""
SELECT n_name, round(sum({_REVENUE}), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC
""")  # fmt: skip
R.sql("tpch_q06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24
""")  # fmt: skip
R.sql("tpch_q07", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, {_REVENUE} AS volume
  FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year
""")  # fmt: skip
R.sql("tpch_q08", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {_REVENUE} AS volume, n2.n_name AS nation
  FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
    AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type LIKE 'ECO%') all_nations
GROUP BY o_year ORDER BY o_year
""")  # fmt: skip
R.sql("tpch_q09", f"""
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, {_REVENUE} - 0.37 * p_retailprice * l_quantity AS amount
  FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{nation}}
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%1%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC
""")  # fmt: skip
R.sql("tpch_q10", f"""
SELECT c_custkey, c_name, round(sum({_REVENUE}), 2) AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
""")  # fmt: skip
R.sql("tpch_q11", """
WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM {lineitem} GROUP BY l_partkey, l_suppkey),
  own AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM ps, {supplier}, {nation} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_4')
SELECT ps_partkey, round(sum(value), 2) AS value FROM own GROUP BY ps_partkey HAVING sum(value) > (SELECT sum(value) * 0.002 FROM own) ORDER BY value DESC, ps_partkey
""")  # fmt: skip
R.sql("tpch_q12", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag
""")  # fmt: skip
R.sql("tpch_q13", """
SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (
  SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC
""")  # fmt: skip
R.sql("tpch_q14", f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS promo_revenue
FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'
""")  # fmt: skip
R.sql("tpch_q15", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REVENUE}), 2) AS total_revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey
""")  # fmt: skip
R.sql("tpch_q16", """
SELECT p_brand, p_type, p_size, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS supplier_cnt FROM {lineitem}, {part}
WHERE p_partkey = l_partkey AND p_type NOT LIKE 'PROMO%' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45, 49)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size
""")  # fmt: skip
R.sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem}, {part}
WHERE p_partkey = l_partkey AND p_brand LIKE '%1' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)
""")  # fmt: skip
R.sql("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM {customer}, {orders}, {lineitem}
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100
""")  # fmt: skip
R.sql("tpch_q19", f"""
SELECT round(sum({_REVENUE}), 2) AS revenue FROM {{lineitem}}, {{part}}
WHERE (p_partkey = l_partkey AND p_brand LIKE '%1' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 5)
   OR (p_partkey = l_partkey AND p_brand LIKE '%2' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 10)
   OR (p_partkey = l_partkey AND p_brand LIKE '%3' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 15)
""")  # fmt: skip
R.sql("tpch_q20", """
SELECT s_suppkey, s_name FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey AND n_regionkey = 1 AND s_suppkey IN (
  SELECT ps_suppkey FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty FROM {lineitem} GROUP BY l_partkey, l_suppkey) ps
  WHERE ps_partkey IN (SELECT p_partkey FROM {part} WHERE p_type LIKE 'ECO%')
    AND ps_availqty > (SELECT 1.1 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = ps_partkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))
ORDER BY s_name
""")  # fmt: skip
R.sql("tpch_q21", """
SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation}
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_quantity > 25
  AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 25)
  AND s_nationkey = n_nationkey AND n_regionkey = 3
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
""")  # fmt: skip
R.sql("tpch_q22", """
SELECT cntry, CAST(count(*) AS BIGINT) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(CAST(c_nationkey AS VARCHAR(10)), 1, 1) AS cntry, c_acctbal FROM {customer} c
  WHERE c_nationkey IN (1, 3, 7, 13, 17, 23) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 7, 13, 17, 23))
    AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)) custsale
GROUP BY cntry ORDER BY cntry
""")  # fmt: skip
