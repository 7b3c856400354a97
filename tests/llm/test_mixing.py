import pytest
from helpers import ODD, SPACED, documents, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3.0 * sizes[s] for s in over}
        if len(held) == len(names):
            return held


@pytest.fixture(scope="module")
def corpus(spark):
    r = rng(3)
    texts = [prose(r, words=r.randint(1, 200)) for _ in range(900)] + ODD
    sources = [r.choice(["hot"] * 6 + ["a", "b", "ä", "tiny", None]) for _ in texts]
    sources = [s if s != "tiny" or i % 9 == 0 else "hot" for i, s in enumerate(sources)]
    return documents(spark, texts, sources=sources), texts, sources


def test_sizes_targets_and_taken(corpus):
    docs, texts, sources = corpus
    rows = M.mix(docs, fan_in=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {i: len(SPACED.findall(t or "")) for i, t in enumerate(texts)}
    per = {}
    for i, s in enumerate(sources):
        per[s] = per.get(s, 0) + size[i]
    want = brute_targets(per)
    taken = dict.fromkeys(per, 0)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        low = int(want[s] / per[s] + 1e-9) if per[s] else 0
        assert low <= r["copies"] <= low + 1
        taken[s] += r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max(8, 0.005 * want[s])


def test_reruns_agree_whatever_the_partitions(corpus):
    docs, *_ = corpus
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert key(M.mix(docs)) == key(M.mix(docs.repartition(7)))
    assert key(M.mix(docs)) != key(M.mix(docs, seed=5))


def test_expected_copies_are_unbiased(spark):
    # Sixty sources of the same documents: half of them are wanted 0.8 times, the others 1.2 times.
    words = [1, 5, 9, 20, 40, 3, 70, 33]
    texts, sources = ["w " * n for _ in range(60) for n in words], [f"s{i:02d}" for i in range(60) for _ in words]
    docs = documents(spark, texts, sources=sources)
    total = {}
    for r in M.mix(docs, weights=(2.0, 3.0), fan_in=3).collect():
        kind = round(r["target"] / r["source_size"], 3), r["size"]
        total[kind] = total.get(kind, 0) + r["copies"] / 30
    assert {k for k, _ in total} == {0.8, 1.2} and len(total) == 16
    assert all(abs(n - k) < 0.3 for (k, _), n in total.items())


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    docs = documents(spark, ["a b c"] * 20).withColumn("doc_id", F.lit(1).cast("long")).withColumn("target", F.lit("x")).withColumn("size", F.lit("y"))
    assert M.mix(docs).count() == 20
    assert M.mix(docs.limit(0)).count() == 0
    nothing = documents(spark, [None, ""], sources=[None, "a"])
    assert [(r["taken"], r["target"]) for r in M.mix(nothing).collect()] == [(0, 0.0), (0, 0.0)]


def test_equal_rows_are_dealt_like_different_ones(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 50)
    one = "w " * 7
    rows = [(None, one, "hot")] * 1000 + [(i, "w " * (1 + i % 90), "hot") for i in range(500)] + [(i, "x y z", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs, fan_in=4).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1000
    for s in ("hot", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 8
    copies = {r["copies"] for r in got if r["doc_id"] is None}
    assert len(copies) == 2


def test_one_very_long_text_and_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "w " * (200_000 if i == 3 else 50 + i), "ab"[i % 2]) for i in range(400)], "doc_id string, text string, source string")
    got = M.mix(docs).collect()
    assert {r["doc_id"] for r in got} == {f"d{i}" for i in range(400)}
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "a")) <= 60


def test_query_keeps_targets_on_the_given_tables(spark):
    from sparkloom.llm.queries import op4_mixing

    got = op4_mixing(spark, "/root/testdata/sf0.01").groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) > 5 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)
