"""Joins: types, semantics, strategies, pipelines, skew, sources, orders.

The tables have no nulls and no orphans, so inputs are derived: one side is
filtered, or keys are made null by ``nullif``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generators
from ..operators import balance, sorting
from ..operators import joins as J
from ..sources import catalog
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# Customers with an account below 4000 and the larger half of the orders: unmatched rows on both sides.
_C = "(SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal < 4000)"
_O = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000)"


def _sides(t):
    c = t.customer.where("c_acctbal < 4000").select("c_custkey", "c_nationkey", "c_acctbal")
    o = t.orders.where("o_totalprice > 150000").select("o_orderkey", "o_custkey", "o_totalprice")
    return c, o


_KEY = ("c_custkey", "o_custkey")
for _how, _sql in {
    "inner": f"SELECT * FROM {_C} c JOIN {_O} o ON c_custkey = o_custkey",
    "left": f"SELECT * FROM {_C} c LEFT JOIN {_O} o ON c_custkey = o_custkey",
    "right": f"SELECT * FROM {_C} c RIGHT JOIN {_O} o ON c_custkey = o_custkey",
    "full": f"SELECT * FROM {_C} c FULL JOIN {_O} o ON c_custkey = o_custkey",
    "left_semi": f"SELECT * FROM {_C} c WHERE EXISTS (SELECT 1 FROM {_O} o WHERE c_custkey = o_custkey)",
    "left_anti": f"SELECT * FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM {_O} o WHERE c_custkey = o_custkey)",
    "right_semi": f"SELECT * FROM {_O} o WHERE EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey)",
    "right_anti": f"SELECT * FROM {_O} o WHERE NOT EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey)",
}.items():
    R.frame(_sql, f"join_{_how}")(lambda t, how=_how: J.join(*_sides(t), _KEY, how))


# ---------------------------------------------------------------- semantics

_NL = "(SELECT c_custkey AS id, nullif(c_nationkey, 3) AS k FROM customer WHERE c_custkey < 300)"
_NR = "(SELECT s_suppkey AS sid, nullif(s_nationkey, 7) AS sk FROM supplier)"


def _null_sides(t):
    l = t.customer.where("c_custkey < 300").selectExpr("c_custkey AS id", "nullif(c_nationkey, 3) AS k")
    return l, t.supplier.selectExpr("s_suppkey AS sid", "nullif(s_nationkey, 7) AS sk")


@R.frame(f"SELECT * FROM {_NL} l FULL JOIN {_NR} r ON k = sk")
def join_null_keys(t):
    return J.join(*_null_sides(t), ("k", "sk"), "full")


@R.frame(f"SELECT * FROM {_NL} l FULL JOIN {_NR} r ON k IS NOT DISTINCT FROM sk")
def join_null_safe(t):
    return J.join(*_null_sides(t), ("k", "sk"), "full", null_safe=True)


# Null keys over the whole tables: any number of them where nulls match nothing, one customer's where they match.
_WL = "(SELECT c_custkey AS id, CASE WHEN c_nationkey <> 3 THEN c_custkey END AS k FROM customer)"
_WR = "(SELECT o_orderkey AS oid, CASE WHEN o_orderkey % 10 <> 7 THEN o_custkey END AS ok FROM orders)"
_SL = "(SELECT c_custkey AS id, nullif(c_custkey, 4) AS k FROM customer)"


@R.frame(f"SELECT * FROM {_WL} l FULL JOIN {_WR} r ON k = ok")
def join_null_keys_whole(t):
    l = t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_nationkey <> 3 THEN c_custkey END AS k")
    r = t.orders.selectExpr("o_orderkey AS oid", "CASE WHEN o_orderkey % 10 <> 7 THEN o_custkey END AS ok")
    return J.join(l, r, ("k", "ok"), "full")


@R.frame(f"SELECT * FROM {_SL} l FULL JOIN {_WR} r ON k IS NOT DISTINCT FROM ok")
def join_null_safe_whole(t):
    l = t.customer.selectExpr("c_custkey AS id", "nullif(c_custkey, 4) AS k")
    r = t.orders.selectExpr("o_orderkey AS oid", "CASE WHEN o_orderkey % 10 <> 7 THEN o_custkey END AS ok")
    return J.join(l, r, ("k", "ok"), "full", null_safe=True)


@R.frame("SELECT c_custkey, s_suppkey, c_nationkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10")
def join_composite(t):
    l, r = t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey")
    both = balance.block_join(l, r, [("c_nationkey", "s_nationkey"), ("c_custkey % 10", "s_suppkey % 10")])
    return both.select("c_custkey", "s_suppkey", "c_nationkey")


@R.frame("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey / 4 * 1.0 = (s_suppkey + 1) / 2 * 1.0")
def join_expr_key(t):
    return J.join(t.part.select("p_partkey"), t.supplier.select("s_suppkey"), ("p_partkey / 4 * 1.0", "(s_suppkey + 1) / 2 * 1.0"))


_RES = "o_totalprice > c_acctbal * 60"


@R.frame(f"SELECT * FROM {_C} c LEFT JOIN {_O} o ON c_custkey = o_custkey AND {_RES}")
def join_left_residual(t):
    return J.join(*_sides(t), _KEY, "left", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_C} c RIGHT JOIN {_O} o ON c_custkey = o_custkey AND {_RES}")
def join_right_residual(t):
    return J.join(*_sides(t), _KEY, "right", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_C} c FULL JOIN {_O} o ON c_custkey = o_custkey AND {_RES}")
def join_full_residual(t):
    return J.join(*_sides(t), _KEY, "full", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_C} c WHERE EXISTS (SELECT 1 FROM {_O} o WHERE c_custkey = o_custkey AND {_RES})")
def join_semi_residual(t):
    return J.join(*_sides(t), _KEY, "left_semi", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_C} c WHERE NOT EXISTS (SELECT 1 FROM {_O} o WHERE c_custkey = o_custkey AND {_RES})")
def join_anti_residual(t):
    return J.join(*_sides(t), _KEY, "left_anti", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_O} o WHERE EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey AND {_RES})")
def join_right_semi_residual(t):
    return J.join(*_sides(t), _KEY, "right_semi", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame(f"SELECT * FROM {_O} o WHERE NOT EXISTS (SELECT 1 FROM {_C} c WHERE c_custkey = o_custkey AND {_RES})")
def join_right_anti_residual(t):
    return J.join(*_sides(t), _KEY, "right_anti", residual="r.o_totalprice > l.c_acctbal * 60")


@R.frame("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(t):
    n = t.nation.select("n_nationkey", "n_regionkey")
    out = J.theta_join(n, n, "l.n_nationkey < r.n_nationkey AND l.n_regionkey <> r.n_regionkey")
    return out.select(F.col("n_nationkey_l").alias("low"), F.col("n_nationkey_r").alias("high"))


@R.frame("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 7) FROM supplier WHERE s_nationkey < 9)")
def join_not_in_nulls(t):
    r = t.supplier.where("s_nationkey < 9").selectExpr("nullif(s_nationkey, 7) AS k")
    return J.not_in(t.customer.select("c_custkey", "c_nationkey"), r, "c_nationkey", "k").select("c_custkey")


@R.frame("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 9)")
def join_not_in(t):
    r = t.supplier.where("s_nationkey < 9").select("s_nationkey")
    return J.not_in(t.customer.select("c_custkey", "c_nationkey"), r, "c_nationkey", "s_nationkey").select("c_custkey")


@R.frame("SELECT n_nationkey, CAST(count(*) AS BIGINT) AS pairs FROM nation JOIN customer a ON n_nationkey = a.c_nationkey JOIN supplier b ON n_nationkey = b.s_nationkey GROUP BY n_nationkey")
def join_duplicates(t):
    return J.pair_counts([(t.nation, "n_nationkey"), (t.customer, "c_nationkey"), (t.supplier, "s_nationkey")], "n_nationkey", "pairs")


def _empty_counts(t, empty: str):
    out = None
    for how in J.JOIN_TYPES:
        l, r = t.nation.select("n_nationkey"), t.region.select("r_regionkey")
        l, r = (l.where("n_nationkey < 0"), r) if empty == "left" else (l, r.where("r_regionkey < 0"))
        one = J.join(l, r, ("n_nationkey", "r_regionkey"), how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def _empty_sql(**n: str) -> str:
    table = {"left": "(SELECT CAST(count(*) AS BIGINT) FROM nation)", "right": "(SELECT CAST(count(*) AS BIGINT) FROM region)", "0": "CAST(0 AS BIGINT)"}
    return " UNION ALL ".join(f"SELECT '{h}' AS how, {table[v]} AS n" for h, v in n.items())


R.frame(_empty_sql(inner="0", left="0", right="right", full="right", left_semi="0", left_anti="0", right_semi="0", right_anti="right"), "join_empty_left")(lambda t: _empty_counts(t, "left"))
R.frame(_empty_sql(inner="0", left="left", right="0", full="left", left_semi="0", left_anti="left", right_semi="0", right_anti="0"), "join_empty_right")(lambda t: _empty_counts(t, "right"))


@R.frame("SELECT a.n_nationkey, b.s_suppkey FROM nation a JOIN supplier b ON a.n_nationkey = b.s_nationkey AND a.n_regionkey IS NOT DISTINCT FROM a.n_regionkey")
def join_struct_key(t):
    l = t.nation.select("n_nationkey", F.struct(F.col("n_nationkey").alias("k")).alias("key"))
    r = t.supplier.select("s_suppkey", F.struct(F.col("s_nationkey").alias("k")).alias("key"))
    return J.join(l, r, "key").select("n_nationkey", "s_suppkey")


@R.frame("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_labels(t):
    return J.join(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "left", suffixes=("", "_label")).select("doc_id", "lang", "quality", "toxic")


# ---------------------------------------------------------------- strategies

_STRATEGY_SQL = "SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
for _s in ("auto", "shuffle_hash", "broadcast", "sort_merge", "nested_loop"):

    @R.frame(_STRATEGY_SQL, f"strategy_{_s}")
    def _strategy(t, s=_s):
        c, n = t.customer.select("c_nationkey", "c_acctbal"), t.nation.select("n_nationkey", "n_name")
        both = J.join(c, n, ("c_nationkey", "n_nationkey"), strategy=s, strict=True)
        return both.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@R.frame(f"SELECT * FROM {_C} c LEFT JOIN {_O} o ON c_custkey = o_custkey")
def strategy_shuffle_hash_build_left(t):
    return J.join(*_sides(t), _KEY, "left", strategy="shuffle_hash", strict=True, build="left")


@R.frame(f"SELECT * FROM {_C} c RIGHT JOIN {_O} o ON c_custkey = o_custkey")
def strategy_broadcast_build_left(t):
    return J.join(*_sides(t), _KEY, "right", strategy="broadcast", strict=True, build="left")


# ---------------------------------------------------------------- pipelines

_FOUR = """
SELECT l_orderkey, l_linenumber, o_custkey, p_brand, s_nationkey, c_mktsegment FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45
"""


@R.frame(_FOUR)
def four_way_join(t):
    base = t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = J.chain(base, [
        (t.orders.select("o_orderkey", "o_custkey"), ("l_orderkey", "o_orderkey")),
        (t.part.select("p_partkey", "p_brand"), ("l_partkey", "p_partkey")),
        (t.supplier.select("s_suppkey", "s_nationkey"), ("l_suppkey", "s_suppkey")),
        (t.customer.select("c_custkey", "c_mktsegment"), ("o_custkey", "c_custkey")),
    ])
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "p_brand", "s_nationkey", "c_mktsegment")


R.sql("four_way_nested", """
SELECT l_orderkey, l_linenumber, o_custkey, p_brand, s_nationkey, c_mktsegment FROM (
  SELECT * FROM (
    SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity > 45) a
    JOIN {part} ON l_partkey = p_partkey) b
  JOIN {supplier} ON l_suppkey = s_suppkey) c
JOIN {customer} ON o_custkey = c_custkey
""")  # fmt: skip


@R.frame("""
WITH base AS (SELECT i AS id1, i + 1 AS id2, i + 2 AS id3, i + 3 AS id4 FROM range(1024) t(i)), small AS (SELECT i AS id FROM range(1024) t(i))
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(id1 + id2 + id3 + id4) AS BIGINT) AS total FROM base
JOIN small a ON id1 = a.id JOIN small b ON id2 = b.id + 1 JOIN small c ON id3 = c.id + 2 JOIN small d ON id4 = d.id + 3
""")
def four_way_generated(t):
    base = generators.base_table(t._spark, 1024)
    smalls = [(generators.small_table(t._spark, 1024, k, "world").select(F.col("id").alias(f"s{k}")), (f"id{k + 1}", f"s{k}")) for k in range(4)]
    ids = F.col("id1") + F.col("id2") + F.col("id3") + F.col("id4")
    return J.chain(base, smalls).agg(F.count(F.lit(1)).alias("n"), F.sum(ids).alias("total"))


# A key that a third of the orders have.
@R.frame("""
SELECT c_custkey, c_mktsegment, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS spent
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS k, o_totalprice FROM orders) JOIN customer ON k = c_custkey GROUP BY c_custkey, c_mktsegment
""")
def skewed_join(t):
    o = t.orders.select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END").alias("c_custkey"), "o_totalprice")
    both = balance.salted_join(o, t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return both.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@R.frame("""
WITH e AS (SELECT CAST(floor((pow(16.0, i / 2000.0) - 1) / 15.0 * 1000) AS INTEGER) AS id FROM range(2000) t(i))
SELECT id, CAST(count(*) AS BIGINT) AS n FROM e JOIN (SELECT CAST(i AS INTEGER) AS k FROM range(1000) t(i)) ON id = k GROUP BY id
""")
def exponential_join(t):
    skewed = t._spark.range(2000).select(generators.exponential(0, 1000, 2000))
    both = J.join(skewed, generators.small_table(t._spark, 1000, 0, "x").select(F.col("id").alias("k")), ("id", "k"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R.frame("SELECT o_orderkey, o_custkey FROM orders")
def rebalance(t):
    return balance.rebalance(t.orders.select("o_orderkey", "o_custkey"))


@R.frame("SELECT o_orderkey, o_custkey FROM orders")
def rebalance_by_key(t):
    return balance.rebalance(t.orders.select("o_orderkey", "o_custkey"), 16, "o_custkey")


# ---------------------------------------------------------------- outer joins that filters narrow

R.sql("full_to_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_acctbal < 4000) c FULL JOIN (SELECT * FROM {orders} WHERE o_totalprice > 150000) o ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
R.sql("full_to_left", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_acctbal < 4000) c FULL JOIN (SELECT * FROM {orders} WHERE o_totalprice > 150000) o ON c_custkey = o_custkey WHERE c_custkey IS NOT NULL")
R.sql("exists", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
R.sql("not_exists", "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
R.sql("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)")
R.sql("cross_join", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")

# ---------------------------------------------------------------- sources


@R.frame("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
def parquet_scan(t):
    return t.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")


@R.frame("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (CAST(NULL AS INTEGER), 'c')) t(id, value)")
def memory_table(t):
    return catalog.memory_table(t._spark, [(1, "a"), (2, "b"), (None, "c")], "id int, value string", partitions=2)


@R.frame("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
def memory_partitions(t):
    return t.nation.repartition(4).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@R.frame(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM supplier"
    for c in ("s_suppkey", "s_name", "s_nationkey")
))
def table_stats(t):
    return catalog.table_stats(t.supplier.select("s_suppkey", "s_name", "s_nationkey"))


# ---------------------------------------------------------------- orders


@R.frame("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS LAST, c_custkey")
def sort_nulls_last(t):
    return sorting.sort_nulls_last(t.customer.selectExpr("c_custkey", "nullif(c_nationkey, 3) AS k"), "k", "c_custkey")


@R.frame("SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment, c_nationkey DESC, c_custkey")
def sort_multi_key(t):
    return sorting.sort_nulls_last(t.customer.select("c_mktsegment", "c_nationkey", "c_custkey"), "c_mktsegment", "c_nationkey desc", "c_custkey")


@R.frame("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY 1, 2")
def sort_distinct(t):
    return sorting.sorted_distinct(t.customer, "c_nationkey", "c_mktsegment")


@R.frame("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return sorting.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, "o_totalprice desc", "o_orderkey")


@R.frame("SELECT CAST(count(*) AS BIGINT) AS found FROM range(20000) p(i) WHERE EXISTS (SELECT 1 FROM range(10000) b(i) WHERE b.i = p.i)")
def lookup_half_missing(t):
    built = generators.repeated_table(t._spark, 10_000, 8)
    probe = t._spark.range(20_000).select(F.col("id").cast("int").alias("id"))
    return J.join(probe, built, "id", "left_semi").agg(F.count(F.lit(1)).alias("found"))
