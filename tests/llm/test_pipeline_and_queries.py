import os

import duckdb
import pytest
from helpers import ALNUM, documents, lower, prose, rng

import corpus_pipeline as P
from sparkloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 11)) and len(Q.QUERIES) == 10
    import __spark_entry__ as e

    assert set(Q.QUERIES) | {"pipeline"} <= set(e.queries())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in cur.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_queries_cover_their_tables(spark, name):
    table = "embeddings" if name.startswith("op6") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert Q.QUERIES[name](spark, SF).count() == (50 if table == "embeddings" else n)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Planted cases: copies, benchmark passages, toxic words, texts without letters, clean texts."""
    r = rng(77)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [prose(r, words=20) for _ in range(6)]
    clean = [prose(r, words=r.randint(30, 90)) for _ in range(150)]
    toxic = [" ".join([*prose(r, words=30).split(), "scumbar", "idiotel", "scumbar"]) for _ in range(60)]
    copies = [clean[0]] * 5 + [clean[1].upper()] + [" ".join(["zz", *prose(rng(500), words=120).split(), "q" * (k + 1)]) for k in range(4)]
    leaked = [prose(r, words=20) + " " + items[0] + " " + items[1] for _ in range(5)]
    texts = clean + toxic + copies + leaked + ["12 34 !!", "", None]
    docs = documents(spark, texts, sources=[["a", "b", None][i % 3] for i in range(len(texts))])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(150 <= i < 210)) for i in range(0, 210, 2)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, items


def test_stages(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_dup", "decontamination", "mixing"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}.parquet")
        docs = spark.read.parquet(f"{path}/{name}.parquet")
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    n = len(texts)
    assert not left["toxicity"] & set(range(150, 210)) and set(range(150)) <= left["toxicity"]
    assert left["toxicity"] - left["language"] == {n - 3, n - 2, n - 1}
    gone = left["language"] - left["near_dup"]
    assert gone == set(range(210, 216)) | set(range(217, 220))
    words = [" ".join(ALNUM.findall(lower(t))) for t in texts]
    whole = [" ".join(ALNUM.findall(lower(i))) for i in items]
    assert left["near_dup"] - left["decontamination"] == {i for i in left["near_dup"] if sum(x in words[i] for x in whole) >= 2}
    assert left["mixing"] == left["decontamination"] and set(range(150)) <= left["mixing"]
    assert docs.selectExpr("sum(taken)").first()[0] > 0


def test_run_on_small_tables_and_odd_documents(spark, folder, tmp_path):
    assert P.run(spark, SF).count() > 100
    path = folder[0]
    rows = spark.read.parquet(f"{path}/documents.parquet")
    odd = rows.unionByName(rows.limit(20)).selectExpr("if(doc_id % 7 = 0, null, doc_id) AS doc_id", "if(doc_id % 11 = 0, null, text) AS text", "lang", "source", "n_chars", "1 AS score", "2 AS size", "3 AS d", "'x' AS evidence")
    for some in (odd, odd.limit(0)):
        docs = some
        for k, (name, stage) in enumerate(P.STAGES):
            stage(spark, docs, path).write.parquet(out := f"{tmp_path}/{some is odd}-{k}")
            docs = spark.read.parquet(out)
        assert (docs.count() > 0) == (some is odd)
    assert os.path.exists(tmp_path)


def test_stage_drops_leaks_of_a_single_item(spark, tmp_path):
    r = rng(78)
    items = [prose(r, words=20) for _ in range(6)]
    clean = [prose(r, words=r.randint(30, 90)) for _ in range(40)]
    whole = [f"{prose(r, words=20)} {i.upper()} {prose(r, words=20)}" for i in items]
    part = [f"{prose(r, words=20)} {' '.join(i.split()[5:13])}" for i in items]
    short = [" ".join(i.split()[5:12]) for i in items]
    texts = clean + short + whole + part
    spark.createDataFrame([*enumerate(items[:5]), (None, items[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {x["doc_id"] for x in P.drop_contaminated(spark, documents(spark, texts), str(tmp_path)).collect()}
    assert kept == set(range(len(clean) + len(short)))
