import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import ODD, by_id, documents, prose, rng
from pyspark.sql import functions as F

from sparkloom.llm import language_id as I
from sparkloom.llm import textscan
from sparkloom.llm.queries import op7_language


def plain_grams(text):
    words = []
    for b in text.lower().encode():
        words.append(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0)
    s = [0, *words, 0]
    out = Counter()
    for i in range(len(s)):
        if s[i]:
            out[(s[i],)] += 1
        if i + 1 < len(s) and (s[i] or s[i + 1]):
            out[(s[i], s[i + 1])] += 1
        if i + 2 < len(s) and s[i + 1]:
            out[(s[i], s[i + 1], s[i + 2])] += 1
    return out


def code(g):
    n = 0
    for b in g:
        n = n << 8 | b
    return n | (len(g) - 1) << 24


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_distances_equal_plain_out_of_place(spark):
    r = rng(4)
    texts = [prose(r, lang, 40) for lang in ("en", "fr", "de") for _ in range(6)]
    langs = [lang for lang in ("en", "fr", "de") for _ in range(6)]
    p = I.learn_profiles(documents(spark, texts, langs), profile_size=120)
    assert p.languages == ["de", "en", "fr"]
    total = {lang: sum((plain_grams(t) for t, x in zip(texts, langs, strict=True) if x == lang), Counter()) for lang in p.languages}
    lists = {lang: {code(g): i for i, g in enumerate(ranked(total[lang], 120))} for lang in p.languages}
    for j, lang in enumerate(p.languages):
        assert {int(g): int(k) for g, k in zip(p.grams[j], p.ranks[j], strict=True)} == lists[lang]
    probe = [*texts[:5], "The the, then!", "ß", "x y"]
    (t,) = textscan.chunks(I._lower(pa.array(probe)))
    got = I.distances(t, p)
    for i, text in enumerate(probe):
        mine = ranked(plain_grams(text), 120)
        for j, lang in enumerate(p.languages):
            want = np.mean([abs(k - lists[lang][code(g)]) if code(g) in lists[lang] else 120 for k, g in enumerate(mine)])
            assert abs(got[i, j] - want) < 1e-9


def test_held_out_accuracy(spark):
    r = rng(6)
    langs = [r.choice(["en", "fr", "de"]) for _ in range(300)]
    docs = documents(spark, [prose(r, x, r.randint(8, 60)) for x in langs], langs)
    p = I.learn_profiles(docs, where=F.col("doc_id") % 3 != 0)
    got = by_id(I.identify(docs.drop("lang"), p))
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in range(0, 300, 3)]) > 0.95
    assert all(0 <= got[i]["score"] <= 1 for i in got)


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, "der und die " * 40_000], ["en"] * len(ODD) + ["de"]).withColumn("Lang_Pred", F.lit("q"))
    p = I.learn_profiles(docs.unionByName(docs.withColumn("lang", F.lit(None).cast("string"))))
    got = by_id(I.identify(docs, p))
    for i in (0, 1, 2, 4, 6):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[3]["lang_pred"] in ("en", "de") and got[len(ODD)]["lang_pred"] == "de"
    empty = I.learn_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in I.identify(docs, empty).collect()} == {"und"}
    assert I.identify(docs.limit(0), p).count() == 0
    one = I.learn_profiles(docs.where("lang = 'de'"))
    assert by_id(I.identify(docs, one))[3]["lang_pred"] == "de"


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    r = rng(11)
    text = prose(r, "fr", 300) + "!!" + "é" * 40 + " x"
    (whole,) = textscan.chunks(pa.array([text.lower()]))
    want = I.text_counts(whole)
    for size in (1, 7, 64):
        monkeypatch.setattr(I, "CHUNK_BYTES", size)
        assert all((a == b).all() for a, b in zip(want, I.text_counts(whole), strict=True))


def test_many_languages_repeated_rows_and_equal_distances(spark):
    r = rng(12)
    langs = [f"l{i:04d}" for i in range(1200)]
    docs = documents(spark, [prose(r, words=4) for _ in langs], langs)
    assert I.learn_profiles(docs).languages == langs
    same = documents(spark, ["a b c"] * 4 + ["zz yy"], ["q", "p", "p", "q", None])
    p = I.learn_profiles(same)
    got = I.identify(same.unionByName(same).withColumn("doc_id", F.lit(None).cast("long")), p).collect()
    assert {(r["lang_pred"], round(r["score"], 9)) for r in got} == {("p", 0.5)} and len(got) == 10


def test_query_equals_brute_force(spark, tmp_path):
    r = rng(13)
    langs = [r.choice(["en", "fr", "de", None]) for _ in range(60)]
    texts = [prose(r, x or "en", r.randint(1, 40)) for x in langs] + ODD
    langs += ["en"] * len(ODD)
    documents(spark, texts, langs).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(op7_language(spark, str(tmp_path)))
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2 and langs[i] and texts[i] is not None]
    known = sorted({langs[i] for i in train})
    lists = {x: {code(g): k for k, g in enumerate(ranked(sum((plain_grams(texts[i]) for i in train if langs[i] == x), Counter()), 400))} for x in known}
    for i, t in enumerate(texts):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not any(c.isalpha() for c in t):
            assert got[i]["lang_pred"] == "und"
            continue
        mine = ranked(plain_grams(t), 400)
        d = sorted((sum(abs(k - lists[x][code(g)]) if code(g) in lists[x] else 400 for k, g in enumerate(mine)) / len(mine), x) for x in known)
        assert got[i]["lang_pred"] == d[0][1] and abs(got[i]["score"] - d[1][0] / (d[0][0] + d[1][0])) < 1e-9
