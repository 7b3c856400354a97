import zlib

import numpy as np
from helpers import ODD, by_id, documents, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import byte_cnn as B
from sparkloom.llm import textscan
from sparkloom.llm.queries import op1_quality


def corpus(n=240):
    r = rng(1)
    texts, labels = [], []
    for i in range(n):
        t = prose(r, words=r.randint(20, 120))
        good = i % 3 != 0
        if not good:
            k = i // 3 % 3
            t = [" | ".join(t.split()), " ".join(w + "!!" for w in t.upper().split()), " ".join(w + r.choice(["&&&", "%%%", "$$$"]) for w in t.split())][k]
        texts.append(t)
        labels.append(int(good))
    return texts, labels


def test_learns_and_scores_held_out_rows(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, None), (None, 1), (3, labels[3])], "doc_id long, quality int")
    m = B.learn(docs, marks, F.col("k") % 4 != 0)
    got = by_id(B.score(docs, m))
    held = [i for i in range(len(texts)) if i % 4 == 0]
    assert np.mean([(got[i]["score"] >= 0.3) == labels[i] for i in held]) > 0.93


def test_slices_and_chunks_do_not_change_scores(monkeypatch):
    texts, labels = corpus(60)
    raw = [t.encode() for t in texts]
    m = B.fit(raw, np.array(labels, float), epochs=2, min_steps=1)
    one = np.concatenate([m.scores(textscan.Texts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), slice(0, 1))) for b in raw])
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    monkeypatch.setattr(B, "SLICE_BLOCKS", 3)
    many = m.scores(textscan.Texts(np.frombuffer(b"".join(raw), np.uint8), offsets, slice(0, len(raw))))
    assert np.allclose(one, many, atol=1e-6)


def test_the_whole_text_counts():
    texts, labels = corpus(240)
    m = B.fit([t.encode() for t in texts], np.array(labels, float))
    good = prose(rng(3), words=3000)
    raw = [good.encode(), (good + " " + " | ".join(prose(rng(4), words=80).split())).encode()]
    s = m.scores(textscan.Texts(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]), slice(0, 2)))
    assert s[0] > 0.5 > s[1]


def test_odd_rows_clashing_columns_and_empty_tables(spark):
    docs = documents(spark, [*ODD, "z" * 200_000]).withColumn("Score", F.lit("old"))
    marks = spark.createDataFrame([], "doc_id long, quality int")
    m = B.learn(docs, marks, F.lit(True))
    out = B.score(docs, m)
    assert out.columns.count("score") == 1 and "Score" not in out.columns
    assert {round(r["score"], 6) for r in out.collect()} == {0.5} and out.count() == len(ODD) + 1
    one = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert min(r["score"] for r in B.score(docs, B.learn(docs, one, F.lit(True))).collect()) > 0.99
    assert B.score(docs.limit(0), m).count() == 0


def naive(m, data):
    """Every filter at every place, one after the other."""
    width, more = len(m.table), len(m.table) - 1
    blocks = max(1, -(-(len(data) + more) // m.block))
    flat = bytes(more) + data + bytes(blocks * m.block - len(data))
    responses = [[sum(m.table[j][flat[a + j]][f] for j in range(width)) for f in range(m.table.shape[2])] for a in range(blocks * m.block)]
    feats = np.array([np.max(responses[b * m.block : (b + 1) * m.block], axis=0) for b in range(blocks)])
    units = []
    for b in range(blocks):
        chunk = np.maximum(np.maximum(feats[b], feats[min(b + 1, blocks - 1)]) + m.bias, 0)
        units.append(np.maximum(chunk @ m.hidden + m.hidden_bias, 0))
    return 1 / (1 + np.exp(-(np.max(units, axis=0) @ m.out + m.out_bias)))


def one(m, data):
    return m.scores(textscan.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), slice(0, 1)))[0]


def test_scores_equal_a_naive_convolution(monkeypatch):
    texts, labels = corpus(40)
    raw = [t.encode() for t in texts] + [b"", b"x", bytes(range(256))]
    m = B.fit(raw[:40], np.array(labels, float), epochs=2, min_steps=1, filters=5, units=4, width=4)
    for data in raw:
        assert abs(one(m, data) - naive(m, data)) < 1e-5
    monkeypatch.setattr(B, "PIECE_BLOCKS", 2)
    for data in raw:
        assert abs(one(m, data) - naive(m, data)) < 1e-5


def test_long_texts_are_learned_from(spark):
    r = rng(2)
    texts, labels = [], []
    for i in range(80):
        t = prose(r, words=1800)
        labels.append(i % 2)
        texts.append(t if i % 2 else " ".join(w + "%%%" for w in t.split()))
    assert min(len(t) for t in texts) > 8000
    docs = documents(spark, texts)
    m = B.learn(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"), F.col("k") % 4 != 0)
    got = by_id(B.score(docs, m))
    assert np.mean([(got[i]["score"] >= 0.3) == labels[i] for i in range(0, 80, 4)]) > 0.9


def test_query_equals_the_naive_network(spark, tmp_path):
    texts, labels = corpus(60)
    texts += [*ODD, texts[0]]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = B.learn(docs, marks, F.col("k").isin([i for i in range(60) if zlib.crc32(str(i).encode()) % 5]))
    got = by_id(op1_quality(spark, str(tmp_path)))
    assert len(got) == len(texts) and got[len(texts) - 1]["score"] == got[0]["score"]
    for i, t in enumerate(texts):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
        if len(t or "") < 300:
            assert abs(got[i]["score"] - naive(model, (t or "").encode())) < 1e-4
