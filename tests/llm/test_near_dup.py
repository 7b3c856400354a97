import numpy as np
import pytest
from helpers import ODD, SPACED, by_id, documents, lower, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import near_dup as N


def sets(texts, width):
    out = []
    for t in texts:
        w = SPACED.findall(lower(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(texts, width, percent=80):
    s = sets(texts, width)
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            k = len(s[i] & s[j])
            if s[i] and s[j] and 100 * k >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return [(len(s[i]), find(i), find(i) == i) for i in range(len(s))]


def edited(r, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = "".join(r.choice("abcdef") for _ in range(5))
    return " ".join(w)


def corpus():
    r = rng(21)
    texts = [prose(r, words=r.randint(2, 150)) for _ in range(60)] + ODD
    base = prose(r, words=160)
    texts += [base] * 15 + [edited(r, base, s) for s in (0.005, 0.01, 0.02, 0.03) for _ in range(12)]
    chain = prose(r, words=100)
    for _ in range(12):  # each like the one before, the ends unlike each other
        texts.append(chain)
        chain = " ".join(chain.split()[6:]) + " " + prose(r, words=6)
    shared = prose(r, words=50)  # one passage in many texts, too short to make them alike
    texts += [prose(r, words=70) + " " + shared + " " + prose(r, words=70) for _ in range(30)]
    texts += [prose(r, words=20_000)]
    texts += [texts[-1].upper()]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(spark, width):
    texts = corpus()
    got = by_id(N.deduplicate(documents(spark, texts).repartition(5), width=width))
    want = brute(texts, width)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == want


def test_shuffled_verification_and_salted_centres(spark):
    texts = corpus()
    docs = documents(spark, texts)
    s = sets(texts, 4)
    pairs = [(i, 0) for i in range(1, len(texts))] + [(i, 7) for i in range(8, len(texts))]
    got = {tuple(r) for r in N.verify(docs, spark.createDataFrame(pairs, "a long, c long"), "doc_id", "text", 4, 80, group=10, broadcast_rows=0).collect()}
    assert got == {(a, c) for a, c in pairs if s[a] and s[c] and 100 * len(s[a] & s[c]) >= 80 * len(s[a] | s[c])}


def test_chunks_with_fewer_words_than_a_shingle(spark):
    got = by_id(N.deduplicate(documents(spark, ["a b", "A  b", "b a", "c"]).repartition(4), width=5))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(4)] == [(1, 0), (1, 0), (1, 2), (1, 3)]


def test_sketches_merge_and_estimate():
    g = np.random.default_rng(3)
    e = g.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b, both = e[:600], e[300:], e
    k = N.sketches(np.concatenate([a, b, both]), np.array([0, 600, 1200, 2100]))
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    grid = np.linspace(0, 1, 201)
    more, fewer = int((k[0] > k[1]).sum()), int((k[0] < k[1]).sum())
    best = grid[N.log_likelihood(grid, 600, 600, more, fewer, 128 - more - fewer).argmax()]
    assert abs(best - 1 / 3) < 0.15
    assert N.hopeless(k[0], k[1], 600, 600, 0.8) and not N.hopeless(k[0], k[0], 600, 600, 0.8)
    assert N.hopeless(k[0], k[2], 100, 300, 0.8)


def test_components_of_long_chains(spark):
    ids = list(range(0, 60))
    rng(1).shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(100, 101), (103, 101)]
    got = {r["id"]: r["comp"] for r in N.components(spark.createDataFrame(links, "a long, c long")).collect()}
    assert all(got[i] == 0 for i in range(60)) and got[101] == got[103] == 100


def test_repeated_ids_null_ids_and_empty_table(spark):
    t = prose(rng(2), words=50)
    rows = [(5, t), (5, t), (9, t.upper()), (None, t), (None, "alone here"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit(1)).withColumn("rep", F.lit(1))
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in N.deduplicate(docs).collect())
    assert got == [(-1, -1, True), (-1, 5, False), (3, 3, True), (3, 3, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()).count("alone here") == 1
    assert sum(lower(r["text"]) == lower(t) for r in kept.collect()) == 1 and kept.count() == 4
    assert N.deduplicate(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0
