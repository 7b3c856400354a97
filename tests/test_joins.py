"""The join fixtures: null keys, duplicates, empty sides, residuals, strategies."""

import pytest

from sparkloom.functions import generators
from pyspark.sql import functions as F

from sparkloom.operators import balance
from sparkloom.operators import joins as J
from sparkloom.operators.balance import heavy_keys, rebalance, salted_join
from sparkloom.plans import introspect

ALL = ("auto", "shuffle_hash", "broadcast", "sort_merge")


def two(spark, left, right):
    make = lambda rows, word: spark.createDataFrame([x if isinstance(x, tuple) else (x, word) for x in rows], "id int, value string")
    return make(left, "left"), make(right, "right")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


N = None
CASES = {
    "inner": ([1, 2, N], [N, 2, 3], [(2, "left", 2, "right")]),
    "left": ([1, 2, N], [1, 1, N], [(1, "left", 1, "right")] * 2 + [(2, "left", N, N), (N, "left", N, N)]),
    "left_semi": ([1, 2, N], [1, 1, N], [(1, "left")]),
    "left_anti": ([1, 2, N], [1, 1, N], [(2, "left"), (N, "left")]),
    "right": ([1, 1, N], [1, 2, N], [(1, "left", 1, "right")] * 2 + [(N, N, 2, "right"), (N, N, N, "right")]),
    "right_semi": ([1, 2, 2, N], [2, 2, 3, N], [(2, "right")] * 2),
    "right_anti": ([1, 2, N], [1, 2, 3, N], [(3, "right"), (N, "right")]),
    "full": ([1, 2, N], [2, 3, N], [(1, "left", N, N), (2, "left", 2, "right"), (N, "left", N, N), (N, N, 3, "right"), (N, N, N, "right")]),
}


@pytest.mark.parametrize("strategy", ALL)
@pytest.mark.parametrize("how", CASES)
def test_types(spark, how, strategy):
    left, right, expected = CASES[how]
    out = J.join(*two(spark, left, right), "id", how, strategy=strategy)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert rows(out) == sorted(expected, key=key)


def test_no_match(spark):
    assert rows(J.join(*two(spark, [1, 2, N], [N, 4, 5]), "id")) == []


def test_full_with_residual(spark):
    l, r = two(spark, [1, 2, (3, "same"), N], [2, (3, "same"), 4, N])
    out = J.join(l, r, "id", "full", residual="l.value != r.value")
    assert len(rows(out)) == 7
    assert (2, "left", 2, "right") in rows(out) and (3, "same", N, N) in rows(out) and (N, N, 3, "same") in rows(out)


@pytest.mark.parametrize("how, ids", [("left_semi", [1]), ("left_anti", [2, 3, N]), ("right_semi", [1]), ("right_anti", [2, 4, N])])
def test_semi_and_anti_with_residual_and_nulls(spark, how, ids):
    l, r = two(spark, [(1, "a"), (2, "b"), (3, "c"), (N, "d")], [(1, "x"), (2, "b"), (4, "y"), (N, "d")])
    got = [x[0] for x in rows(J.join(l, r, "id", how, residual="l.value <> r.value"))]
    assert got == ids


def test_many_left_rows(spark):
    l = spark.range(200).selectExpr("CAST(id AS INT) AS id")
    r = spark.createDataFrame([(1,), (70,), (140,)], "id int")
    assert [x[0] for x in rows(J.join(l, r, "id", "left_semi"))] == [1, 70, 140]
    assert J.join(l, r, "id", "left_anti").count() == 197
    assert J.join(l, r, "id", "left").count() == 200
    assert J.join(l, r, "id", "full").count() == 200


@pytest.mark.parametrize("empty, counts", [("left", [0, 0, 3, 3, 0, 0, 0, 3]), ("right", [0, 3, 0, 3, 0, 3, 0, 0])])
def test_empty_sides(spark, empty, counts):
    l, r = two(spark, [] if empty == "left" else [1, 2, 3], [] if empty == "right" else [1, 2, 3])
    assert [J.join(l, r, "id", how).count() for how in J.JOIN_TYPES] == counts


def test_duplicates_multiply(spark):
    a, b = generators.repeated_table(spark, 3, 500), generators.repeated_table(spark, 4, 40)
    assert J.join(a, b, "id").count() == 3 * 500 * 40


def test_composite_expression_and_struct_keys(spark):
    l = spark.createDataFrame([(1, 2), (3, 4), (N, 4)], "a int, b int")
    assert rows(J.join(l, l, ["a", "b"]))[0] == (1, 2, 1, 2) and J.join(l, l, ["a", "b"]).count() == 2
    assert J.join(l, l, ["a", "b"], null_safe=True).count() == 3
    assert rows(J.join(l, l, ("a + 1", "b"))) == [(1, 2, 1, 2), (3, 4, 3, 4), (3, 4, N, 4)]
    s = l.selectExpr("struct(a) AS k")
    assert J.join(s, s, "k").count() == 3


def test_not_in(spark):
    l, r = two(spark, [1, 2, N], [2, N])
    assert J.not_in(l, r, "id", "id").count() == 0
    assert [x[0] for x in rows(J.not_in(l, r.where("id = 2"), "id", "id"))] == [1]
    assert J.not_in(l, r.where("id = 9"), "id", "id").count() == 3


def test_four_way(spark):
    base = generators.base_table(spark, 1024, partitions=16)
    smalls = [(generators.small_table(spark, 1024, 0, "world").selectExpr(f"id + {k} AS s{k}"), (f"id{k + 1}", f"s{k}")) for k in range(4)]
    assert J.chain(base, smalls).count() == 1024


HONOURED = {
    ("broadcast", "right"): ("inner", "left", "left_semi", "left_anti"),
    ("broadcast", "left"): ("inner", "right"),
    ("shuffle_hash", "right"): ("inner", "left", "right", "full", "left_semi", "left_anti"),
    ("shuffle_hash", "left"): ("inner", "left", "right", "full"),
    ("nested_loop", "right"): ("inner",),
    ("sort_merge", "right"): ("inner", "left", "right", "full", "left_semi", "left_anti"),
}


@pytest.mark.parametrize("strategy, build", HONOURED)
def test_strict_tells_ignored_hints(spark, strategy, build):
    l, r = spark.range(50).toDF("id"), spark.range(60).toDF("id")
    for how in J.JOIN_TYPES[:6]:
        if how in HONOURED[strategy, build]:
            out = J.join(l, r, "id", how, strategy=strategy, build=build, strict=True)
            assert introspect.joins(out)[0].node == J.STRATEGIES[strategy][1]
        else:
            with pytest.raises(J.StrategyNotHonoured):
                J.join(l, r, "id", how, strategy=strategy, build=build, strict=True)


def test_outer_elimination_and_exists_plans(spark):
    l, r = two(spark, [1, 1, N], [1, 2, N])
    l.createOrReplaceTempView("tl"), r.createOrReplaceTempView("tr")
    full = spark.sql("SELECT * FROM tl FULL JOIN tr ON tl.id = tr.id WHERE tr.id IS NOT NULL")
    assert introspect.joins(full)[0].join_type == "RightOuter"
    assert len(full.collect()) == 3
    assert introspect.joins(spark.sql("SELECT * FROM tl WHERE EXISTS (SELECT 1 FROM tr WHERE tr.id = tl.id)"))[0].join_type == "LeftSemi"
    assert introspect.joins(spark.sql("SELECT * FROM tl WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.id = tl.id)"))[0].join_type == "LeftAnti"


def test_frames_run_again(spark):
    out = J.join(*two(spark, [1, 2], [2, 3]), "id")
    assert out.count() == out.count() == 1


def test_bad_arguments(spark):
    l, r = two(spark, [1], [1])
    for bad in ({"how": "sideways"}, {"strategy": "magic"}, {"build": "top"}, {"on": []}):
        with pytest.raises(ValueError):
            J.join(l, r, **({"on": "id"} | bad))


def test_salted_join_equals_plain_join(spark):
    l = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    r = spark.range(100).selectExpr("id AS k", "id * 2 AS w")
    assert heavy_keys(l, "k", 0.1).collect()[0]["k"] == 7
    for how in ("inner", "left"):
        assert rows(salted_join(l, r, "k", how).select("k", "v", "w")) == rows(l.join(r, "k", how).select("k", "v", "w"))
    assert rebalance(l, 8, "k").count() == 3000


def brute(left, right, how, match):
    pairs = [(l, r) for l in left for r in right if match(l, r)]
    lonely_l = [l for l in left if not any(match(l, r) for r in right)]
    lonely_r = [r for r in right if not any(match(l, r) for l in left)]
    out = {
        "inner": [l + r for l, r in pairs],
        "left": [l + r for l, r in pairs] + [l + (N, N) for l in lonely_l],
        "right": [l + r for l, r in pairs] + [(N, N) + r for r in lonely_r],
        "full": [l + r for l, r in pairs] + [l + (N, N) for l in lonely_l] + [(N, N) + r for r in lonely_r],
        "left_semi": [l for l in left if l not in lonely_l],
        "left_anti": lonely_l,
        "right_semi": [r for r in right if r not in lonely_r],
        "right_anti": lonely_r,
    }
    return sorted(out[how], key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("seed, null_safe, residual", [(1, False, False), (2, True, False), (3, False, True), (4, True, True)])
def test_random_tables_against_brute_force(spark, seed, null_safe, residual):
    import random

    r = random.Random(seed)
    make = lambda n: [(r.choice([N, *range(12)]), r.choice([N, *range(6)])) for _ in range(n)]
    left, right = make(90), make(70)
    same = lambda a, b: (a == b) if null_safe else (a is not None and a == b)
    less = lambda a, b: not residual or (a is not None and b is not None and a < b)
    l, rt = spark.createDataFrame(left, "id int, v int"), spark.createDataFrame(right, "id int, v int")
    for how in J.JOIN_TYPES:
        got = rows(J.join(l, rt, "id", how, residual="l.v < r.v" if residual else None, null_safe=null_safe))
        assert got == brute(left, right, how, lambda a, b: same(a[0], b[0]) and less(a[1], b[1])), how


def test_not_in_large_right_side_is_not_broadcast(spark):
    left = spark.range(100).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS k")
    right = spark.range(20_000_000).selectExpr("id * 2 AS k")
    out = J.not_in(left, right, "k", "k")
    anti = [j for j in introspect.joins(out) if j.join_type == "LeftAnti"]
    assert anti and all(j.node != "BroadcastHashJoin" or j.build == "left" for j in anti)
    some = J.not_in(left, right.limit(30), "k", "k")
    assert {r["k"] for r in some.collect()} == {i for i in range(100) if i % 7} - {r["k"] for r in right.limit(30).collect()}
    assert J.not_in(left, right.limit(0), "k", "k").count() == 100
    assert J.not_in(left, right.limit(3).union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k", "k").count() == 0


def test_equal_rows_of_a_hot_key_are_spread(spark):
    left = spark.range(20_000).selectExpr("CASE WHEN id < 15000 THEN 1 ELSE CAST(id AS INT) END AS k")
    right = spark.createDataFrame([(1, "x"), (16_000, "y"), (1, "z")], "k int, v string")
    for how, n in (("inner", 30_001), ("left", 30_000 + 5_000)):
        out = balance.salted_join(left, right, "k", how, salts=8, share=0.01)
        assert out.columns == ["k", "v"] and out.count() == n
    hot = balance.written(left.where("k = 1")).withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)))
    assert hot.select("s").distinct().count() == 8


def test_block_join_equals_plain_join(spark):
    import random

    r = random.Random(5)
    make = lambda n: [(r.choice([N, 1, 1, 1, *range(9)]), r.choice([N, 0.5, 0.5, float("nan"), -0.0]), i % 70) for i in range(n)]
    left, right = spark.createDataFrame(make(300), "k int, x double, v int"), spark.createDataFrame(make(200), "k bigint, x double, v int")
    key = lambda df: sorted(map(str, df.collect()))
    for a, b, on in ((left, right, ["k", "x"]), (left, right, "k"), (left, right, [("k % 3", "k % 3"), ("x", "x")]), (left, left, "x"), (left, right.where("k = 1"), ("k", "k")), (left.where("k = 1"), right.where("k > 6"), "k")):
        plain = J.join(a, b, on)
        for block, task in ((4, 50), (1000, 10**9)) if on == "k" else ((4, 50),):
            out = balance.block_join(a, b, on, block=block, task=task)
            assert out.dtypes == plain.dtypes and key(out) == key(plain)
    assert balance.block_join(left.limit(0), right, "k", task=1).count() == 0


def test_pairs_of_one_key_are_dealt_over_tasks(spark, tmp_path):
    from sparkloom.queries import QUERIES

    spark.range(40_000).selectExpr("id * 10 AS c_custkey", "3 AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).selectExpr("id * 10 AS s_suppkey", "3 AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["join_composite"](spark, str(tmp_path))
    made = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("c"), F.sum("s_suppkey").alias("s")).collect()
    assert sum(r["n"] for r in made) == 40_000 * 600
    assert sum(r["c"] for r in made) == 600 * 10 * sum(range(40_000)) and sum(r["s"] for r in made) == 40_000 * 10 * sum(range(600))
    assert max(r["n"] for r in made) <= 40_000 * 600 / 2


def test_pairs_of_a_key_are_counted_without_being_made(spark, tmp_path):
    from sparkloom.queries import QUERIES

    # Nation 2 has two rows, nation 9 has none, nation 4 has no supplier; 2 * 10^9 pairs for nation 1.
    spark.createDataFrame([(1,), (2,), (2,), (4,), (N,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(100_000).selectExpr("CASE WHEN id > 6 THEN 1 ELSE element_at(array(2, 2, 9, 4, 2, NULL, NULL), CAST(id AS INT) + 1) END AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).selectExpr("CASE WHEN id > 4 THEN 1 ELSE element_at(array(2, 9, 2, NULL, 7), CAST(id AS INT) + 1) END AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    out = QUERIES["join_duplicates"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("Aggregate"), "rows are counted below the joins"
    assert out.dtypes == [("n_nationkey", "int"), ("pairs", "bigint")]
    assert rows(out) == [(1, 99_993 * 19_995), (2, 2 * 3 * 2)]
    with pytest.raises(ValueError):
        J.pair_counts([], "k", "n")
