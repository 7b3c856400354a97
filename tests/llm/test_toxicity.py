import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ALNUM, ODD, by_id, documents, lower, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as X
from sparkloom.llm.queries import op3_toxicity

BAD = ["idiotus", "scumbar", "trashik", "moronel"]


def corpus(n=400):
    r = rng(9)
    texts, labels = [], []
    for i in range(n):
        w = prose(r, r.choice(["en", "fr", "de"]), r.randint(15, 80)).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "en", "ly", "é"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def learned(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (2, None), (5, 1)], "doc_id long, toxic int")
    return docs, labels, X.learn(docs, marks, F.col("k") % 4 != 3, k=5, block=8)


def test_held_out_rows(learned):
    docs, labels, index = learned
    got = by_id(X.score(docs, index))
    held = [i for i in got if i % 4 == 3]
    assert np.mean([(got[i]["score"] >= 0.5) == labels[i] for i in held]) > 0.9
    for i in held:
        if got[i]["evidence"]:
            near = json.loads(got[i]["evidence"])
            assert 1 <= len(near) <= 5 and [c for _, c, _ in near] == sorted((c for _, c, _ in near), reverse=True)


def dense(ix):
    n, m = len(ix.labels), len(ix.weight)
    out = np.zeros((n, m))
    for j in range(m):
        if ix.row[j] >= 0:
            out[:, j] = ix.dense[ix.row[j]]
        at = slice(ix.begin[ix.entry[j]], ix.begin[ix.entry[j + 1]])
        out[ix.example[at], j] = ix.value[at]
    return out


def test_search_is_exact(learned):
    _, _, ix = learned
    vectors = dense(ix)
    n, m = vectors.shape
    assert n > 3 * ix.block and np.allclose((vectors**2).sum(1), 1) and (ix.row >= 0).any() and (ix.row < 0).any()
    g = np.random.default_rng(1)
    for _ in range(200):
        t = np.sort(g.choice(m, g.integers(1, 30), replace=False))
        w = g.random(len(t)) + 0.01
        w /= np.sqrt((w * w).sum())
        sims = vectors[:, t] @ w
        found, cosine = ix.search(t, w, ix.sums(np.zeros(len(t), np.int64), t, w, 1)[0])
        order = np.lexsort((np.arange(n), -np.round(sims, 12)))
        order = order[sims[order] > 0][: ix.k]
        assert np.allclose(sims[order], cosine) and (found == order).all()


def plain_scores(texts, labels, train, k=15, chance=10.0):
    """The method by its definition, with plain words and no index."""
    words = [Counter(ALNUM.findall(lower(t))) for t in texts]
    known = [i for i in train if labels.get(i) in (0, 1)]
    rate = sum(labels[i] for i in known) / len(known)
    n, pos = len(known), sum(labels[i] for i in known)
    base = pos / n
    share = {1: rate / pos * n, 0: (1 - rate) / (n - pos) * n}
    df, with_label = Counter(), Counter()
    for i in known:
        df.update(words[i].keys())
        if labels[i]:
            with_label.update(words[i].keys())
    weight = {}
    for w, d in df.items():
        a, b, s = with_label[w], d - with_label[w], with_label[w] / d
        ratio = 2 * ((a * math.log(s / base) if a else 0) + (b * math.log((1 - s) / (1 - base)) if b else 0))
        weight[w] = (math.log((1 + n) / (1 + d)) + 1) * (1 + (math.sqrt(max(ratio - chance, 0)) if s > base else 0))

    def vector(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [vector(c) for c in words]

    def vote(i, others):
        cosines = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in others), reverse=True)
        near = [(share[labels[j]] / (1.05 - min(c, 1)), labels[j]) for c, j in cosines[:k] if c > 0]
        return (sum(x for x, y in near if y) + rate) / (sum(x for x, _ in near) + 1)

    votes = np.array([vote(i, [j for j in known if j != i]) for i in known])
    y = np.array([labels[i] for i in known], float)
    slope, shift = X.calibrate(votes, y, np.where(y == 1, share[1], share[0]))
    return [X.logistic(slope * X.logit(vote(i, known)) + shift) if vectors[i] else None for i in range(len(texts))]


def test_query_equals_brute_force(spark, tmp_path):
    texts, labels = corpus(160)
    texts += [*ODD, texts[0] + " scumbar"]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = {i: y for i, y in enumerate(labels)}
    spark.createDataFrame(list(marks.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    train = [i for i in marks if zlib.crc32(str(i).encode()) % 5 != 0]
    want = plain_scores(texts, marks, train)
    got = by_id(op3_toxicity(spark, str(tmp_path)))
    assert len(got) == len(texts)
    for i, p in enumerate(want):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.5)
        if p is not None:
            assert got[i]["score"] == pytest.approx(p, abs=1e-9)


def test_copies_with_clashing_labels_and_repeated_rows(spark):
    texts, labels = corpus(200)
    r = rng(8)
    same = prose(r, words=40) + " scumbar idiotus"
    texts += [same] * 6
    marks = [*enumerate(labels), *((200 + k, k % 2) for k in range(6))]
    docs = documents(spark, texts)
    index = X.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True), k=5)
    assert sum(k in {str(i) for i in range(200, 206)} for k in index.keys) == 2  # one for each label
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = X.score(twice, index).collect()
    by_text = {}
    for row in got:
        by_text.setdefault(row["text"], set()).add(row["score"])
    assert len(got) == 2 * len(texts) and all(len(s) == 1 for s in by_text.values())


def test_odd_rows(spark, learned):
    _, _, index = learned
    docs = documents(spark, [*ODD, "trashik " * 50_000, "Trashik " * 400_000]).withColumn("evidence", F.lit(1))
    got = by_id(X.score(docs, index))
    assert got[len(ODD)]["score"] == got[len(ODD) + 1]["score"] > 0.5
    assert all(got[i]["score"] == index.none and got[i]["evidence"] is None for i in (0, 1, 2, 4)) and index.none < 0.5
    assert X.score(docs.limit(0), index).count() == 0


def test_without_labels_or_with_one_kind(spark):
    docs = documents(spark, ["a b", "c d"])
    none = X.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert [r["score"] for r in X.score(docs, none).collect()] == [0.0, 0.0]
    ones = X.learn(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int"), F.lit(True))
    assert [r["score"] for r in X.score(docs, ones).collect()] == [1.0, 1.0]
