import json

from helpers import ALNUM, ODD, by_id, documents, lower, rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import license_scan as L


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
def test_matching_statistics_and_places(sequences, text):
    a = L.SuffixAutomaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = length = 0
    for k, x in enumerate(text):
        state, length = a.step(state, length, x)
        best = max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in inside), default=0)
        assert length == best
        if length:
            run = text[k + 1 - length : k + 1]
            assert a.places[state] == sorted((s, j) for s, q in enumerate(sequences) for j in range(length, len(q) + 1) if q[j - length : j] == run)


def brute(text):
    w = ALNUM.findall(lower(text))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_equal_brute_force(spark):
    r = rng(2)
    words = "gnu general public license apache cc by mit License, CC-BY MIT the word; GNU (general) x".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(200)] + ODD + ["cc by " * 30_000, "cc-by-cc by", "MIT\nLicense"]
    got = by_id(L.scan(documents(spark, texts)))
    for i, t in enumerate(texts):
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute(t), t
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) or not g["base_labels"]
        assert 0 <= g["score"] <= 1 and (g["score"] == 1) >= (g["n_base"] > 0)


def test_templates_are_found_through_gaps_and_cut_ends(spark):
    mit = L.TEMPLATES["mit-grant"].split()
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of THE work this software and associated documentation files, the Software, to deal in the Software without restriction",
        "lorem " + " ".join(mit[:10]) + " dolor",
        "Licensed under the Apache License, Version 2.0.",
        "lorem ipsum " * 5 + " ".join(mit[4:]),
    ]
    got = by_id(L.scan(documents(spark, texts)))
    assert "mit-grant" in got[0]["labels"] and got[1]["labels"] == "" and got[2]["labels"] == "apache,apache-2.0" and got[3]["labels"] == "mit-grant"
    (label, a, b, share), *_ = json.loads(got[3]["spans"])
    assert (label, a, b) == ("mit-grant", 10, 10 + len(mit) - 4) and 0.75 <= share <= 1


def test_clashing_columns_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["apache license", "apache license"]).withColumn("doc_id", F.lit(7).cast("long")).withColumn("Labels", F.lit("x")).withColumn("n_words", F.lit("y"))
    out = L.scan(docs)
    assert [r["labels"] for r in out.collect()] == ["apache", "apache"]
    assert L.scan(docs.limit(0)).count() == 0


def test_a_base_phrase_of_one_word(spark):
    using = L.scanner(base={"mit": "mit", "cc by": "cc-by"}, templates={"t": "a b c d e"})
    got = {r["doc_id"]: r for r in L.scan(documents(spark, ["the MIT one", "mit cc by mit", "cc", None]), using=using).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["base_labels"]) for i in range(4)] == [(1, 1, "mit"), (3, 0, "cc-by,mit"), (0, None, ""), (0, None, "")]
