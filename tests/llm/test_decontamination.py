import hashlib

import pytest
from helpers import ALNUM, ODD, documents, lower, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import decontamination as D


def brute(texts, items, width=8):
    wins = []
    for i, t in items:
        w = ALNUM.findall(lower(t))
        if w:
            wins += [(i, w[a : a + width]) for a in range(max(1, len(w) - width + 1))]
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        hit, names = set(), set()
        for i, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    names |= {str(i)} if i is not None else set()
        out.append((len(w), len(hit), len(names), ",".join(sorted(names))))
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = rng(12)
    passages = [prose(r, words=r.randint(9, 30)) for _ in range(12)]
    items = [(i, p) for i, p in enumerate(passages)] + [(100, passages[0]), (3, passages[3]), (None, passages[4]), (7, None), (8, ""), (9, "short one"), (10, "the the the the the the the the the the"), (11, "...")]
    texts = list(ODD)
    for _ in range(150):
        w = prose(r, words=r.randint(5, 120)).split()
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages).upper().split()
            a = r.randrange(len(p))
            k = r.randrange(len(w))
            w[k:k] = p[a : a + r.randint(6, 20)]
        if r.random() < 0.2:
            w += ["Short", "ONE", *["the"] * r.randint(0, 20)]
        texts.append(" ".join(w))
    texts += [" ".join([passages[1]] * 400), "É É é short-one", texts[20], texts[20]]
    return texts, items


def frame(spark, texts, items):
    return documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")


def check(rows, texts, items):
    want = brute(texts, items)
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, k, names = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) == (n, hit, k, names, k >= 2), texts[r["doc_id"]]


def test_equals_brute_force(spark, data):
    texts, items = data
    check(D.contamination(*frame(spark, texts, items)).collect(), texts, items)


def test_shuffled_joins_give_the_same(spark, data):
    texts, items = data
    check(D.contamination(*frame(spark, texts, items), broadcast_rows=0).collect(), texts, items)


def test_plan_is_native(spark, data):
    df = D.contamination(*frame(spark, *data))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_postings_and_intersection(spark):
    docs, bench = frame(spark, ["alpha beta gamma delta", "delta xx gamma beta", "alpha only here", None, ""], [(1, "alpha beta gamma delta"), (2, "alpha unheard")])
    test = D.phrases(bench)
    index = D.postings(docs, test, "text", "doc_id", 1000)
    terms = {r["t"]: r["term"] for r in test.terms.collect()} | {D.END_NUMBER: None}
    keys = {r["d"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("d")).collect()}
    got = sorted((keys[r["d"]], r["pos"], terms[r["t"]] or "") for r in index.collect())
    assert got == [(0, 0, "alpha"), (0, 1, "beta"), (0, 2, "gamma"), (0, 3, "delta"), (0, 4, ""), (1, 0, "delta"), (1, 2, "gamma"), (1, 3, "beta"), (1, 4, ""), (2, 0, "alpha"), (2, 3, ""), (4, 0, "")]
    looked = D.lookup(test, index, 1000).collect()
    assert len(looked) == 1 and [x["df"] for x in looked[0]["terms"]] == [2, 2, 2, 2]
    assert [(keys[r["d"]], r["start"], r["n"]) for r in D.exact_matches(index, D.lookup(test, index, 1000), 1000).collect()] == [(0, 0, 4)]
    near = D.near_matches(index, D.near_lookup(test, index, 0.7, 1000), 8, 1000)
    assert {keys[r["d"]] for r in near.collect()} == {0, 1}


def test_repeated_ids_null_ids_empty_tables_and_clashes(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "c d e f g h i j")], "item_id long, text string")
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (1, "other"), (None, "a b c d e f g h i j"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS tag", "3 AS n_hit", "4 AS pos")
    got = sorted((r["doc_id"] or -1, r["n_hit"], r["contaminated"]) for r in D.contamination(docs, bench).collect())
    assert got == [(-1, 0, False), (-1, 10, True), (1, 0, False), (1, 10, True), (1, 10, True)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["text"]) == [(1, "other")] and kept.count() == 2
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert {r["n_items"] for r in D.contamination(docs, bench.limit(0)).collect()} == {0}


def test_ids_of_any_type(spark, data):
    texts, items = data
    docs, bench = frame(spark, texts, items)
    got = {r["doc_id"]: r["n_hit"] for r in D.contamination(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), bench).collect()}
    assert got == {f"d{i}": x[1] for i, x in enumerate(brute(texts, items))}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    assert F is not None


def brute_near(texts, items, share, width=8):
    """Items of whose windows ``share`` of the distinct words stand around one of the window's words."""
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        names = set()
        for i, x in items:
            v = ALNUM.findall(lower(x))
            for a in range(max(1, len(v) - width + 1)) if v and i is not None else ():
                p = set(v[a : a + width])
                if any(w[k] in p and len(p & set(w[max(k - width + 1, 0) : k + width])) / len(p) >= share for k in range(len(w))):
                    names.add(str(i))
        out.append(names)
    return out


def strict_near(texts, items, share, width=8):
    """The same within ``width`` successive words, which has to be found whatever word is gone."""
    out = []
    for t in texts:
        w = ALNUM.findall(lower(t))
        names = set()
        for i, x in items:
            v = ALNUM.findall(lower(x))
            for a in range(max(1, len(v) - width + 1)) if v and i is not None else ():
                p = set(v[a : a + width])
                if any(len(p & set(w[k : k + width])) / len(p) >= share for k in range(len(w))):
                    names.add(str(i))
        out.append(names)
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_altered_passages_are_near_whatever_word_is_gone(spark, rows):
    passage = "one two three four five six seven eight"
    w = passage.split()
    texts = ["nothing here", passage, " ".join(reversed(w))]
    texts += [" ".join([*w[:k], "zzz", *w[k + 1 :]]) for k in range(8)] + [" ".join(w[:k] + w[k + 1 :]) for k in range(8)]
    texts += [" ".join(x for x in w if x not in (w[k], w[(k + 3) % 8])) for k in range(8)] + [" ".join(w[:5])]
    # One word of the last item is in no text.
    items = [(1, passage), (2, "nothing else is in this other item at all"), (3, "one two three four five six seven unheard"), (None, passage)]
    docs, bench = frame(spark, texts, items)
    got = {r["doc_id"]: r for r in D.contamination(docs, bench, near_share=0.75, broadcast_rows=rows).collect()}
    assert len(got) == len(texts) and "1" in got[1]["near_items"]
    assert all("1" in got[i]["near_items"] and got[i]["n_hit"] == (8 if i == 1 else 0) for i in range(1, len(texts) - 1))
    assert not got[0]["n_near"] and not got[len(texts) - 1]["n_near"] and "3" in got[1]["near_items"]


def test_near_items_lie_between_two_brute_forces(spark, data):
    texts, items = data
    got = {r["doc_id"]: r for r in D.contamination(*frame(spark, texts, items), near_share=0.75).collect()}
    most, least = brute_near(texts, items, 0.75), strict_near(texts, items, 0.75)
    for i in range(len(texts)):
        near = set(got[i]["near_items"])
        assert least[i] <= near <= most[i] and set(got[i]["items"]) <= near and got[i]["n_near"] == len(near)
    check(list(got.values()), texts, items)
