import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, SPACED, documents, lower, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import suffix_lm as S
from sparkloom.llm import textscan
from sparkloom.llm.store import freeing


def toks(t):
    return [*SPACED.findall(lower(t)), None]


def corpus():
    r = rng(30)
    line = "all rights are reserved by the author"
    # What follows "lo mi" depends on the word before.
    more = [f" {line}", " ka lo mi pu", " te lo mi ro"]
    return [prose(r, words=r.randint(3, 80)) + more[i % 3] for i in range(300)] + ODD


def plain_tree(train, depth, min_context, min_follower, base, discount=0.75):
    """Followers of each retained context, and the mass left to its next shorter suffix: by the definition, context by context."""
    follow = defaultdict(Counter)
    for t in train:
        w = toks(t)
        for i in range(len(w)):
            for n in range(1, min(depth, i) + 1):
                follow[tuple(w[i - n : i])][w[i]] += 1
    own, rest, passed = {(): None}, {}, set()
    for c in sorted(follow, key=len):
        total = sum(follow[c].values())
        seen = {x: n for x, n in follow[c].items() if n >= min_follower}
        if total < min_context or not seen:
            continue
        own[c] = {x: (n - discount) / total for x, n in seen.items()}
        lower = {x: base(x) if len(c) == 1 else own[c[1:]][x] for x in seen}
        left = total - sum(seen.values())
        gain = sum(n * math.log(n / total / lower[x]) for x, n in seen.items())
        gain += left * math.log(left / total / max(1 - sum(lower.values()), 1e-9)) if left else 0
        rest[c] = max(1 - sum(own[c].values()), 1e-9) / max(1 - sum(lower.values()), 1e-9)
        if gain > 0.5 * len(seen) * math.log(total):
            passed.add(c)
    states = {c[k:] for c in passed for k in range(len(c))}
    return {c: own[c] for c in states}, rest


def plain_probability(own, rest, base, context, x):
    """Of ``x`` after the longest suffix of ``context`` that is a state."""
    while context and context not in own:
        context = context[1:]
    if not context:
        return base(x)
    return own[context][x] if x in own[context] else rest[context] * plain_probability(own, rest, base, context[1:], x)


SMALL = {"min_context": 8, "min_follower": 2}


@pytest.fixture(scope="module", params=[(1 << 18, 1 << 19), (40, 30)], ids=["head", "tables"])
def scored(spark, request):
    texts = corpus()
    docs = documents(spark, texts)
    head, tree_head = request.param
    m = S.learn(docs, where=F.col("doc_id") % 5 != 1, head=head, tree_head=tree_head, **SMALL)
    assert (m.rest is None) == (head > 40)
    return texts, m, {r["doc_id"]: r for r in S.score(docs, m).collect()}


def test_base_scores_equal_brute_force(scored):
    texts, m, got = scored
    c = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert (m.total, m.distinct) == (n, v) and len(got) == len(texts)
    for i, t in enumerate(texts):
        w = toks(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)


def test_scores_equal_a_plain_suffix_tree(scored):
    texts, m, got = scored
    train = [t for i, t in enumerate(texts) if i % 5 != 1]
    c = Counter(w for t in train for w in toks(t))
    base = lambda x: (c[x] + 0.5) / m.divisor
    own, rest = plain_tree(train, 3, SMALL["min_context"], SMALL["min_follower"], base)
    assert {len(s) for s in own} == {1, 2, 3} and m.states.count() == len(own) + sum(len(x) for x in own.values())
    for i, t in enumerate(texts):
        w = toks(t)
        want = sum(math.log10(plain_probability(own, rest, base, tuple(w[max(k - 3, 0) : k]), w[k])) for k in range(len(w)))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9, abs=1e-9)
    # Each state's distribution over all tokens and the unknown one sums to one.
    for s in list(own)[:40]:
        assert sum(plain_probability(own, rest, base, s, x) for x in [*c, "never seen"]) == pytest.approx(1, abs=1e-6)


def test_tree_predicts_held_out_texts_better(scored):
    _, _, got = scored
    held = [i for i in range(300) if i % 5 == 1]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held) + 50


def test_the_tree_grows_with_the_corpus(spark):
    phrases = [" ".join(prose(rng(90 + i), words=6).split()[:6]) + f" k{i}" for i in range(30)]
    texts = [f"{prose(rng(i), words=10)} {phrases[i // 12]} z{i // 12}" for i in range(360)]
    sizes = [S.learn(documents(spark, texts[:n]), **SMALL).states.count() for n in (60, 360)]
    assert sizes[1] > 3 * sizes[0] > 0


def test_long_texts_in_slices(spark, monkeypatch):
    texts = [prose(rng(60 + i), words=400) for i in range(3)]
    docs = documents(spark, texts)
    m = S.learn(docs, min_context=4, min_follower=2)
    whole = [r["score"] for r in S.score(docs, m).orderBy("doc_id").collect()]
    for t in textscan.chunks(pa.array(texts)):
        h, begin = S.tokens(t)
        gains, _ = S._tree_gains(h, begin, 3, m.tree, m.tree_values, None)
        monkeypatch.setattr(S, "SLICE", 7)
        parts, _ = S._tree_gains(h, begin, 3, m.tree, m.tree_values, None)
        assert np.allclose(gains, parts) and gains.any() and len(whole) == 3
        monkeypatch.setattr(textscan, "CHUNK_BYTES", 50)
        assert (S.tokens(t)[0] == h).all() and (S.tokens(t)[1] == begin).all()


def test_ids_of_any_type(spark):
    texts = corpus()[:60]
    docs = documents(spark, texts)
    m = S.learn(docs, **SMALL)
    names = {f"d{r['doc_id']}": r["score"] for r in S.score(docs, m).collect()}
    assert {r["doc_id"]: r["score"] for r in S.score(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), m).collect()} == names


def test_odd_tables(spark):
    docs = documents(spark, [*ODD, "w " * 30_000]).withColumn("score", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("h", F.lit(3))
    none = S.learn(docs, where=F.lit(False))
    got = {r["doc_id"]: r for r in S.score(docs, none).collect()}
    assert got[0]["n_tokens"] == 1 and got[0]["n_known"] == 0 and got[len(ODD)]["n_tokens"] == 30_001 and got[0]["base_score"] == 0
    assert S.score(docs.limit(0), S.learn(docs)).count() == 0
    twice = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert S.score(twice, S.learn(twice)).count() == 2 * (len(ODD) + 1)


def test_tally_stays_bounded_and_exact():
    tally, out = S.Tally(most=50), Counter()
    g = np.random.default_rng(1)
    want = Counter()
    for _ in range(40):
        keys = g.integers(0, 200, 30).astype(np.uint64)
        want.update(keys.tolist())
        if (full := tally.add(keys)) is not None:
            for k, n in zip(*full, strict=True):
                out[int(k)] += int(n)
    for k, n in zip(*tally.merged(), strict=True):
        out[int(k)] += int(n)
    assert out == want


def test_pairs_and_questions_go_in_blocks(spark, monkeypatch):
    """A row for each part that a task knows something for, not one for each pair or key of a text."""
    made = {}
    write = S.materialize

    def seen(df, name):
        table = write(df, name)
        made[name] = made.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(S, "materialize", seen)
    monkeypatch.setattr(S, "PART_BITS", (1, 16))
    texts = corpus()
    docs = documents(spark, texts).repartition(2)
    m = S.learn(docs, head=40, tree_head=30, **SMALL)
    scores = {r["doc_id"]: r["score"] for r in S.score(docs, m).collect()}
    assert sum(len(set(toks(t))) for t in texts) > 5000 and made["lm-parts"] < 2 * len(texts) and made["lm-rest"] < 200
    whole = S.learn(docs, **SMALL)
    for r in S.score(docs, whole).collect():
        assert scores[r["doc_id"]] == pytest.approx(r["score"], rel=1e-9, abs=1e-9)


def test_blocks_and_codes_give_back_what_they_hold():
    g = np.random.default_rng(2)
    part = np.sort(g.integers(0, 5, 1000))
    key, more = np.sort(g.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)), g.integers(0, 1 << 63, 1000, dtype=np.uint64)
    got = [(p, n, S.unpacked(b, n, 2)) for p, _, n, b in S.blocks(part, 0, key, more)]
    assert [p for p, *_ in got] == [0, 1, 2, 3, 4] and sum(n for _, n, _ in got) == 1000
    assert (np.concatenate([c[0] for *_, c in got]) == key).all() and (np.concatenate([c[1] for *_, c in got]) == more).all()
    assert list(S.blocks(np.zeros(0, np.int64), 0, np.zeros(0, np.uint64))) == []
    for bits, contexts, names in ((1, 3, 2), (7, 1, 1000), (16, 1 << 18, 1 << 20)):
        codes = S.Codes(np.arange(contexts, dtype=np.uint64), np.arange(names, dtype=np.uint64), bits)
        c, x = g.integers(0, contexts, 500), g.integers(0, names, 500)
        code = codes(c, x)
        back = codes.told(code)
        assert (back[0] == c).all() and (back[1] == x).all() and (code >> np.uint64(48)).max() < 1 << bits


def test_what_was_shuffled_is_freed(spark):
    k = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with freeing(spark):
        assert spark.conf.get(k) == "true"
    assert spark.conf.get(k) == "false" and spark.conf.get(k, None) is None
