"""Benchmark decontamination with a distributed positional inverted index.

Everything is DataFrame functions; no Python runs on the executors.

1. Test items are cut into windows of ``width`` successive words (an item of
   fewer words is one window).  Equal windows are one phrase.  Their words are
   the terms.
2. The index: texts are split once, and for every place of a term one posting
   is stored, ``t, d, tag, pos``.  A text's number of words is stored beside
   them, as the posting of a blank.
3. How often each term stands in the texts is counted over the index, and the
   words of each phrase are put in order, the rarest first.
4. The postings of each phrase's rarest term, moved back by the term's place in
   the phrase, are where it may begin.  They are intersected with the postings
   of the second rarest, moved alike, and what is left with those of all other
   terms, for which only texts that are left are read.  That gives every exact
   match.
5. Proximity, in any order and with gaps, is asked for by ``near_share``: a
   phrase is looked up by so many of its rarest words that one has to be among
   any words that make up the share (``near_lookup``), and its terms' postings
   around these places, found by blocks of places, are counted.
6. Matches become the union of hit positions and the items, document by
   document.

A side is broadcast only if its rows and bytes were counted and are within
``broadcast_rows`` and 64 MB; otherwise joins shuffle, and adaptive execution splits a
frequent word.  A frequent passage makes as many matches as it has places,
never pairs of documents.

Defined results: a null or wordless text has no words and no hit; null or
wordless items have no window; an item without an id counts for hits, not for
items; repeated items count once and repeated documents alike; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh
from .store import left_out, materialize, small

#: Words of lower-cased text.  A class that names its members is several times faster in Java than one that names the others.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The term that stands for the end of a text: no word has a blank.
END, END_NUMBER = " ", -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII only take the fast function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


@dataclass
class Phrases:
    """Windows of the test items: ``p, words, n``; their items ``p, item_id``; their terms ``term, t``."""

    windows: DataFrame
    items: DataFrame
    terms: DataFrame


def _sent(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """Broadcast what was counted to be small, shuffle the rest."""
    return F.broadcast(df) if small(df, broadcast_rows) else df.hint("merge")


def phrases(items: DataFrame, key: str = "item_id", text: str = "text", width: int = 8) -> Phrases:
    split = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    cut = split.select("item_id", "w", F.explode(starts).alias("a")).select("item_id", F.slice("w", F.col("a"), F.lit(width)).alias("words"))
    # Words hold no blank, so the joined words name the window.
    cut = materialize(cut.select("item_id", F.array_join("words", " ").alias("phrase"), "words"), "decon-cut")
    windows = cut.groupBy("phrase").agg(F.first("words").alias("words"))
    windows = materialize(windows.select(F.monotonically_increasing_id().alias("p"), "phrase", "words", F.size("words").alias("n")), "decon-windows")
    known = windows.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("t"))
    named = cut.select("phrase", "item_id").distinct().join(windows.select("phrase", "p"), "phrase").select("p", "item_id")
    return Phrases(windows.select("p", "words", "n"), materialize(named, "decon-items"), materialize(known, "decon-terms"))


def document_key(doc: Column, text: Column) -> tuple[Column, Column]:
    """Rows with one key and one text get one result, so these two columns name a row."""
    return F.xxhash64(doc).alias("d"), F.xxhash64(text).alias("tag")


def postings(docs: DataFrame, test: Phrases, text: str, key: str, broadcast_rows: int) -> DataFrame:
    """The stored index ``t, d, tag, pos`` of all terms, and of the end of each text."""
    d, tag = document_key(F.col(key), F.col(text))
    tokens = docs.select(d, tag, F.posexplode(F.concat(words(F.col(text)), F.array(F.lit(END)))).alias("pos", "term"))
    end = docs.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(END_NUMBER).cast("long").alias("t"))
    terms = materialize(test.terms.unionByName(end), "decon-terms")
    return materialize(tokens.join(_sent(terms, broadcast_rows), "term").select("t", "d", "tag", "pos"), "decon-postings")


def _rated(test: Phrases, index: DataFrame, broadcast_rows: int) -> DataFrame:
    """``p, n, place, t, df``: the words of each phrase, and how often each stands in the texts."""
    counts = materialize(index.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "decon-counts")
    placed = test.windows.select("p", "n", F.posexplode("words").alias("place", "term")).join(_sent(test.terms, broadcast_rows), "term")
    return placed.join(counts, "t", "left").select("p", "n", "place", "t", F.coalesce("df", F.lit(0)).alias("df"))


def lookup(test: Phrases, index: DataFrame, broadcast_rows: int) -> DataFrame:
    """``p, n, terms``: each phrase that can occur with ``struct<df, place, t>`` of its words, the rarest first."""
    rated = _rated(test, index, broadcast_rows)
    order = rated.groupBy("p").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "place", "t"))).alias("terms"))
    # A word that no text has rules its phrase out.
    return materialize(order.where(F.col("terms")[0]["df"] > 0), "decon-lookup")


def near_lookup(test: Phrases, index: DataFrame, min_share: float, broadcast_rows: int) -> DataFrame:
    """``p, t, own, least``: each phrase with its rarest words that occur, so many that ``least`` of its words ``own`` can't do without all of them."""
    rated = _rated(test, index, broadcast_rows).select("p", "t", "df").distinct()
    order = rated.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("terms"))
    least = F.greatest(F.ceil(F.size("terms") * F.lit(min_share) - F.lit(1e-9)), F.lit(1)).cast("int")
    there = F.filter("terms", lambda x: x["df"] > 0)
    order = order.select("p", least.alias("least"), there.alias("there")).where(F.size("there") >= F.col("least"))
    # Words that no text has are missing everywhere; what is left of the share may miss that many fewer.
    some = F.slice("there", F.lit(1), F.size("there") - F.col("least") + 1)
    return materialize(order.select("p", "least", F.transform("there", lambda x: x["t"]).alias("own"), F.explode(some["t"]).alias("t")), "decon-near-lookup")


def exact_matches(index: DataFrame, looked: DataFrame, broadcast_rows: int) -> DataFrame:
    """``d, tag, start, n, p`` of every place where a phrase stands."""
    spot = ["d", "tag", "p", "n", "start"]
    first, second = F.col("terms")[0], F.col("terms")[1]
    rarest = looked.select("p", "n", first["t"].alias("t"), first["place"].alias("place"))
    begun = index.join(_sent(rarest, broadcast_rows), "t").select("d", "tag", "p", "n", (F.col("pos") - F.col("place")).alias("start")).where(F.col("start") >= 0)
    # Repeated rows have the same postings.
    begun = materialize(begun.distinct(), "decon-begun")
    whole = begun.where(F.col("n") == 1)

    then = looked.where(F.col("n") > 1).select("p", second["t"].alias("t"), second["place"].alias("place"))
    asked = begun.join(_sent(then, broadcast_rows), "p").select(*spot, "t", (F.col("start") + F.col("place")).alias("pos"))
    lists = index.join(_sent(then.select("t").distinct(), broadcast_rows), "t", "left_semi")
    left = materialize(asked.join(lists, ["t", "d", "tag", "pos"], "left_semi").select(*spot), "decon-left")
    whole = whole.unionByName(left.where(F.col("n") == 2))

    left = left.where(F.col("n") > 2)
    others = looked.where(F.col("n") > 2).select("p", F.explode(F.slice("terms", F.lit(3), F.col("n"))).alias("x")).select("p", "x.t", "x.place")
    asked = left.join(_sent(others, broadcast_rows), "p").select(*spot, "t", (F.col("start") + F.col("place")).alias("pos"))
    texts = materialize(left.select("d", "tag").distinct(), "decon-texts")
    lists = index.join(_sent(texts, broadcast_rows), ["d", "tag"], "left_semi")
    found = asked.join(lists, ["t", "d", "tag", "pos"], "left_semi").groupBy(*spot).agg(F.count(F.lit(1)).alias("there"))
    return whole.unionByName(found.where(F.col("there") == F.col("n") - 2).select(*spot))


def near_matches(index: DataFrame, near: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """``d, tag, p`` where enough of a phrase's distinct words stand less than ``width`` from one of those it is looked up by."""
    seeds = index.join(_sent(near, broadcast_rows), "t").select("d", "tag", "p", "own", "least", "pos").distinct()
    block = F.floor(F.col("pos") / F.lit(width))
    seeds = materialize(seeds.select("*", F.explode(F.array(block - 1, block, block + 1)).alias("block")), "decon-seeds")
    around = index.where(F.col("t") != END_NUMBER).select("d", "tag", block.alias("block"), F.col("t").alias("other"), F.col("pos").alias("at"))
    both = seeds.join(around, ["d", "tag", "block"]).where((F.abs(F.col("at") - F.col("pos")) < width) & F.array_contains("own", F.col("other")))
    found = both.groupBy("d", "tag", "p", "pos").agg(F.count_distinct("other").alias("there"), F.first("least").alias("least"))
    return found.where(F.col("there") >= F.col("least")).select("d", "tag", "p").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 8,
    min_items: int = 2,
    broadcast_rows: int = 200_000,
    near_share: float | None = None,
) -> DataFrame:
    """For every row of ``docs``: ``d, tag, doc_id, n_words, n_hit, n_items, items, contaminated``.

    With ``near_share`` also ``n_near, near_items``: the items of whose windows
    that share of the distinct words stands around a place, in any order.
    """
    test = phrases(benchmark, width=width)
    index = postings(docs, test, text, key, broadcast_rows)
    matches = materialize(exact_matches(index, lookup(test, index, broadcast_rows), broadcast_rows), "decon-matches")

    before = F.max("end").over(Window.partitionBy("d", "tag").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.select("d", "tag", "start", (F.col("start") + F.col("n")).alias("end")).distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    new = F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))
    hits = spans.groupBy("d", "tag").agg(F.sum(new).cast("long").alias("n_hit"))
    names = _sent(test.items.where(F.col("item_id").isNotNull()), broadcast_rows)
    per = matches.select("d", "tag", "p").distinct().join(names, "p").groupBy("d", "tag").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = hits.join(per, ["d", "tag"], "left")
    if near_share is not None:
        close = near_matches(index, near_lookup(test, index, near_share, broadcast_rows), width, broadcast_rows).join(names, "p")
        found = found.join(close.groupBy("d", "tag").agg(F.collect_set(F.col("item_id").cast("string")).alias("near_items")), ["d", "tag"], "full")
    sizes = index.where(F.col("t") == END_NUMBER).groupBy("d", "tag").agg(F.max("pos").cast("long").alias("n_words"))
    found = materialize(sizes.join(found, ["d", "tag"], "left"), "decon-found")

    d, tag = document_key(F.col(key), F.col(text))
    out = docs.select(F.col(key).alias("doc_id"), d, tag).join(found, ["d", "tag"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long")).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    out = out.withColumn("items", F.sort_array(F.coalesce("items", none))).withColumn("n_items", F.size("items").cast("long"))
    if near_share is not None:
        out = out.withColumn("near_items", F.sort_array(F.coalesce("near_items", none))).withColumn("n_near", F.size("near_items").cast("long"))
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = 8) -> DataFrame:
    """The rows of ``docs`` without a hit; one window of one item, with an id or not, is enough."""
    found = contamination(docs.select(key, text), benchmark, key, text, width).where("n_hit > 0")
    names = [fresh(docs, "d"), fresh(docs, "tag")]
    gone = materialize(found.select("d", "tag").distinct().toDF(*names), "decon-gone")
    d, tag = document_key(F.col(key), F.col(text))
    marked = docs.select("*", d.alias(names[0]), tag.alias(names[1]))
    return left_out(marked, gone, names).select(*docs.columns)
