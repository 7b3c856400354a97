import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import additive_ann as A

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)
        out[q] = d[:k]
    return out


def test_recall_ranks_and_scores(spark):
    g = np.random.default_rng(0)
    rows = [(i, g.normal(size=24).astype(float).tolist(), 0) for i in range(3000)]
    got = A.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, row_block=700, query_block=11, pool=60, size=32, books=16, sample=2000).collect()
    want = brute([r[:2] for r in rows], range(0, 3000, 100))
    hits = 0
    for q, best in want.items():
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and [r[2] for r in mine] == sorted(r[2] for r in mine)
        hits += len({r[1] for r in mine} & {i for _, i in best})
        exact = {i: d for d, i in best}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in mine if i in exact)
    assert hits / (10 * len(want)) >= 0.9


def test_beam_search_and_joint_books_reduce_the_error():
    g = np.random.default_rng(2)
    x = g.normal(size=(1500, 16))
    made = A.fit(x, books=6, size=16, rounds=2)

    def error(m, beam):
        codes, norms = m.encode(x, beam)
        total = sum(m.words[j][codes[:, j]] for j in range(6))
        assert np.allclose((total**2).sum(1), norms)
        return ((x - total) ** 2).sum(1).mean()

    assert error(made, 8) < error(made, 1) and error(made, 4) < error(A.fit(x, books=6, size=16, rounds=0), 4)


def test_ties_odd_vectors_repeats_and_few_candidates(spark):
    rows = [
        (0, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (9, [0.0, -1.0], 0), (0, [9.0, 9.0], 0), (3, [0.0, 1.0], 1),
        (200, [0.0, 0.0], 0), (300, None, 0), (400, [1.0, None], 0), (500, [float("nan"), 1.0], 0), (600, [float("inf"), 1.0], 0), (700, [1.0], 0), (None, [1.0, 1.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in A.search(df, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**0.5), (0, 2, 5, 2**0.5), (0, 3, 9, 2**0.5)]
    assert A.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert A.search(df.where("vec_id = 200"), F.col("id") % 100 == 0).count() == 0
    assert A.search(df, F.col("id") == 12345).count() == 0


def test_many_equal_vectors_and_string_ids(spark):
    g = np.random.default_rng(4)
    same = g.normal(size=8).tolist()
    rows = [(i, same if i % 3 == 0 else g.normal(size=8).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[:2] for r in rows], range(0, 400, 100))
    got = A.search(df, F.col("id") % 100 == 0, least=200).collect()
    for q, best in want.items():
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[1] for r in mine] == [i for _, i in best] and [r[2] for r in mine] == pytest.approx([d for d, _ in best])
    named = df.withColumn("vec_id", F.format_string("v%03d", "vec_id"))
    again = A.search(named, F.col("id").isin("v000", "v100", "v200", "v300"), least=200).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in again} == {(f"v{r['query_id']:03d}", r["rank"], f"v{r['id']:03d}") for r in got}


def test_query_recall_on_the_given_tables(spark):
    from sparkloom.llm.queries import op6_ann

    path = "/root/testdata/sf0.01"
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    ok = [(i, v) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = brute(ok, [i for i, _ in ok if i % 100 == 0])
    got = op6_ann(spark, path).collect()
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in best}) for q, best in want.items())
    assert len(got) == 10 * len(want) and hits / len(got) >= 0.9
