"""Sources, settings, SQL text, generators, orders, streams and the command line."""

import json

import pytest

from sparkloom import bench
from sparkloom.functions import generators, sqltext
from sparkloom.operators import sorting
from sparkloom.plans import introspect
from sparkloom.session import EngineConfig, read_settings
from sparkloom.sources import catalog, sinks
from sparkloom.streaming.bounded import read_bounded, run_bounded

SF = "/root/testdata/sf0.001"


def test_settings_file(tmp_path):
    f = tmp_path / "conf"
    f.write_text("# comment\nspark.a = 1\n\nbroken\nspark.b=x=y\n")
    with pytest.warns(UserWarning, match="broken"):
        assert read_settings(str(f)) == {"spark.a": "1", "spark.b": "x=y"}
    assert EngineConfig(partitions=3).spark_settings()["spark.sql.shuffle.partitions"] == "3"


def test_split_statements():
    assert sqltext.split_statements("select ';' ; -- a;b\n /* ; */ select 2;; ") == ["select ';'", "select 2"]
    assert sqltext.translate("a ~ 'x~y' AND b !~ 'z'") == "a RLIKE 'x~y' AND b NOT RLIKE 'z'"


def test_script_with_a_view(spark):
    out = sqltext.run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT 'abc' AS s; SELECT s FROM v WHERE s ~ '^a'")
    assert [r[0] for r in out[-1].collect()] == ["abc"]


def test_register_and_pushdown(spark):
    assert "lineitem" in catalog.register_dir(spark, SF)
    df = spark.table("lineitem").where("l_quantity > 49").select("l_orderkey")
    scan = introspect.scans(df)[0]
    assert "GreaterThan(l_quantity,49.0)" in scan["pushed"] and scan["columns"] == "l_orderkey:bigint,l_quantity:double"
    assert catalog.strip_namespace("select * from my.db.t join my . db . u", "my", "db") == "select * from t join u"


def test_memory_and_stats(spark):
    t = catalog.memory_table(spark, [(1, "a"), (1, None), (None, "b"), (2, "b")], "id int, v string", 3, "mem")
    assert spark.table("mem").rdd.getNumPartitions() == 3
    expected = {("id", 4, 1, 2), ("v", 4, 1, 2)}
    assert {tuple(r) for r in catalog.table_stats(t).collect()} == expected
    assert {tuple(r) for r in catalog.table_stats(t, exact=False).collect()} == expected
    assert catalog.load_to_memory(t, 2).storageLevel.useMemory


def test_generators(spark):
    assert [r[0] for r in spark.range(10).select(generators.exponential(0, 10, 10)).collect()] == [0, 0, 0, 0, 1, 2, 2, 3, 5, 7]
    words = [r["value"] for r in generators.small_table(spark, 20, 5).collect()]
    assert len(set(words)) == 20 and all(len(w) == 32 and w.isalnum() for w in words)
    nulls = spark.range(1000).toDF("id").select(generators.nullable("id", 10)).where("id IS NULL").count()
    assert 50 < nulls < 200


def test_orders(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, "c"), (2, None)], "k int, v string")
    assert [tuple(r) for r in sorting.sort_nulls_last(df, "k", "v").collect()] == [(1, "c"), (2, "b"), (2, None), (None, "a")]
    assert [tuple(r) for r in sorting.top_k(df, 2, "k desc", "v").collect()] == [(2, "b"), (2, None)]
    assert [r[0] for r in sorting.sorted_distinct(df, "k").collect()] == [1, 2, None]


def test_bounded_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).repartition(4).write.parquet(src)
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 100, 2)], "id long, name string")
    out = run_bounded(read_bounded(spark, src), lambda s: s.join(names, "id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert out.count() == 50


def test_bench_command(spark, tmp_path):
    q = tmp_path / "queries"
    q.mkdir()
    (q / "q1.sql").write_text("create or replace temp view big as select * from orders where o_totalprice > 1000; select count(*) as n from big;")
    (q / "q2.sql").write_text("select nonsense from nowhere")
    out = tmp_path / "out"
    args = bench.parser().parse_args(["--data-path", SF, "--query-path", str(q), "--output", str(out), "--num-queries", "2", "--iterations", "2", "--from-memory", "--memory-partitions", "2"])
    results = bench.run(args, spark)
    assert [r["query"] for r in results] == ["1"] and len(results[0]["iterations_ms"]) == 2
    assert json.loads((out / "results.json").read_text())["results"][0]["query"] == "1"
    assert (out / "summary.csv").read_text().startswith("query,first_ms") and list(out.glob("1*.plan.txt"))
    args.query = "2"
    with pytest.raises(Exception, match="(?i)nowhere"):
        bench.run(args, spark)
    spark.catalog.clearCache()


def test_explain_after_run_reads_the_final_plan(spark):
    catalog.register_dir(spark, SF)
    df = spark.sql("SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey")
    df.collect()
    assert introspect.joins(df)[0].node == "BroadcastHashJoin" and introspect.exchanges(df)


def test_bucketed_tables_join_without_an_exchange(spark):
    a = sinks.write_bucketed(spark.range(1000).selectExpr("id AS k", "id * 2 AS v"), "bucketed_a", 4, "k")
    b = sinks.write_bucketed(spark.range(0, 2000, 2).selectExpr("id AS k", "id AS w"), "bucketed_b", 4, "k")
    both = a.hint("merge").join(b, "k")
    assert introspect.exchanges(both) == [] and introspect.joins(both)[0].node == "SortMergeJoin"
    assert both.count() == 500
    spark.sql("DROP TABLE bucketed_a"), spark.sql("DROP TABLE bucketed_b")


def test_regular_expressions_of_either_case(spark):
    spark.sql("SELECT * FROM VALUES ('Ab'), ('cd') AS t(x)").createOrReplaceTempView("words_t")
    for op, want in (("~* 'AB'", ["Ab"]), ("!~* 'aB'", ["cd"]), ("~ 'ab'", []), ("!~ 'ab'", ["Ab", "cd"]), ("~* x", ["Ab", "cd"])):
        (got,) = sqltext.run_script(spark, f"SELECT x FROM words_t WHERE x {op} ORDER BY x")
        assert [r["x"] for r in got.collect()] == want
