"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (lower-cased A-Z, letters, digits and all bytes from 0x80), as
64-bit hashes.  The examples are a bounded sample of the labelled rows, and
every word of any example is a dimension of the vectors.  A term weighs
(1 + ln count) times its idf times a supervised weight: 1 plus the square root
of what its log-likelihood ratio for the label, in the sample, has above
``chance``.  So ordinary words make neighbours of texts that are alike, and a
word that goes with the label outweighs them.

The examples' unit vectors lie in an inverted index whose posting lists are
cut into blocks of examples.  For each block the largest weight of each term
is kept; the sum of query weight times block maximum bounds every cosine in
the block.  Lists of terms that a good part of the examples have are stored as
dense rows and summed for many texts at once, block maxima being taken of the
sums.  The most promising blocks are searched first; of the others, those
whose bound reaches the k-th best cosine so far are searched too, so the
result is exactly that of comparing with every example.

The vote of the ``k`` nearest weighs 1 / (distance + 0.05) with distance
1 - cosine, times the share of the label's rows that the sample stands for,
and is smoothed by one vote of the base rate.  The score is that vote
calibrated by a logistic curve, fitted on the votes that each example gets
from the others.  ``evidence`` lists the nearest examples with cosine and
label.

Defined results: a text without a term of any example, so a null or empty one
too, gets the share of label 1 among examples without a term, smoothed by the
base rate; without examples of both labels every score is the share of 1
among the labels, or 0 without any; equal cosines (to 12 digits) go to the
example first in the index's order; examples of one label that agree in the
four smallest hashes of their five-word shingles (copies) count once; rows are
independent of each other, so repeated rows get equal scores.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_dup, textscan
from .frames import annotate
from .store import materialize

#: Blocks that are searched before any is left out.
LEAD = 4
#: Lists that hold more than one in so many examples are dense; all of them are at most so many times the postings.
DENSE = 12
#: Texts whose dense sums are held at once.
TOGETHER = 64


def terms(t: textscan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts, and the text that each is in."""
    h, first = textscan.word_hashes(t.lowered(), textscan.ALNUM)
    return h, np.repeat(np.arange(len(t)), np.diff(first))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``start`` and have ``n`` places."""
    total = np.cumsum(n)
    return np.repeat(start - total + n, n) + np.arange(total[-1] if len(total) else 0)


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Index:
    lookup: textscan.Lookup
    weight: np.ndarray  # by term: idf times the supervised weight
    labels: np.ndarray  # of the examples that have a term
    share: np.ndarray  # rows that an example stands for
    keys: list
    entry: np.ndarray  # by term, one more at the end: its first block entry
    block_of: np.ndarray  # by block entry
    maximum: np.ndarray  # by block entry: the largest weight
    begin: np.ndarray  # by block entry, one more at the end: its first posting
    row: np.ndarray  # by term: its dense row, or -1
    dense: np.ndarray  # [row, example]
    example: np.ndarray  # by posting, of the type that numpy counts with
    value: np.ndarray  # by posting
    block: int
    k: int
    none: float  # base rate among examples without a term
    rate: float
    slope: float = 1.0
    shift: float = 0.0

    @property
    def blocks(self) -> int:
        return -(-len(self.labels) // self.block)

    def sums(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """What the dense terms give to the cosine of each text with each example."""
        at = np.flatnonzero(self.row[term] >= 0)
        w = np.zeros((texts, len(self.dense)))
        w[owner[at], self.row[term[at]]] = weight[at]
        return w @ self.dense

    def search(self, term: np.ndarray, weight: np.ndarray, cosine: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (without ``but``) and their cosines, exactly; ``cosine`` has the dense sums."""
        sparse = np.flatnonzero(self.row[term] < 0)
        term, weight = term[sparse], weight[sparse]
        n = self.entry[term + 1] - self.entry[term]
        entries, w = ranges(self.entry[term], n), np.repeat(weight, n)
        own = self.block_of[entries]
        bounds = np.bincount(own, w * self.maximum[entries], self.blocks).astype(float)
        bounds += np.maximum.reduceat(cosine, np.arange(0, len(cosine), self.block))
        order = np.argsort(-bounds, kind="stable")
        seen = np.zeros(self.blocks, dtype=bool)

        def measure(chosen: np.ndarray) -> np.ndarray:
            """Adds the other terms' postings of some blocks; the cosines of the examples of all blocks seen, 0 elsewhere."""
            wanted = np.zeros(self.blocks, dtype=bool)
            wanted[chosen] = True
            seen[chosen] = True
            some = np.flatnonzero(wanted[own])
            e = entries[some]
            n = self.begin[e + 1] - self.begin[e]
            at = ranges(self.begin[e], n)
            np.add(cosine, np.bincount(self.example[at], self.value[at] * np.repeat(w[some], n), len(cosine)), out=cosine)
            out = np.where(np.repeat(seen, self.block)[: len(cosine)], cosine, 0.0)
            if but >= 0:
                out[but] = 0.0
            return out

        known = measure(order[:LEAD])
        least = np.partition(known, -self.k)[-self.k] if len(known) > self.k else 0.0
        more = order[LEAD:]
        more = more[(bounds[more] > 0) & (bounds[more] >= least - 1e-9)]
        if len(more):
            known = measure(more)
        found = np.flatnonzero(known > 0)
        if len(found) > self.k:
            edge = np.partition(known[found], -self.k)[-self.k]
            found = found[known[found] >= edge - 1e-9]
        found = found[np.lexsort((found, -np.round(known[found], 12)))[: self.k]]
        return found, np.minimum(known[found], 1.0)

    def votes(self, t: textscan.Texts, but: list[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray] | None]:
        """For each text the vote, before calibration, with the examples and cosines behind it; None without a term."""
        owner, term, count = vectors(t, self.lookup)
        w = (1 + np.log(count)) * self.weight[term]
        w /= np.sqrt(np.bincount(owner, w * w, len(t)))[owner]
        cuts = np.searchsorted(owner, np.arange(len(t) + 1)).tolist()
        for lo in range(0, len(t), TOGETHER):
            hi = min(lo + TOGETHER, len(t))
            part = slice(cuts[lo], cuts[hi])
            sums = self.sums(owner[part] - lo, term[part], w[part], hi - lo)
            for i in range(lo, hi):
                a, b = cuts[i], cuts[i + 1]
                if a == b:
                    yield None
                    continue
                found, cosine = self.search(term[a:b], w[a:b], sums[i - lo], but[i] if but else -1)
                near = self.share[found] / (1 - cosine + 0.05)
                yield float(((near * self.labels[found]).sum() + self.rate) / (near.sum() + 1)), found, cosine

    def scores(self, t: textscan.Texts) -> Iterator[tuple[float, str | None]]:
        if not 0 < self.rate < 1:
            yield from [(self.none, None)] * len(t)
            return
        for v in self.votes(t):
            if v is None:
                yield self.none, None
                continue
            p, found, cosine = v
            evidence = json.dumps([[self.keys[i], round(float(c), 6), int(self.labels[i])] for i, c in zip(found, cosine, strict=True)])
            yield float(logistic(self.slope * logit(p) + self.shift)), evidence


def logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def vectors(t: textscan.Texts, lookup: textscan.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), in order of text and term."""
    h, owner = terms(t)
    j = lookup(h)
    hit = np.flatnonzero(j >= 0)
    key, n = np.unique(owner[hit] << 32 | j[hit], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, n


def one_of_each(rows: DataFrame) -> DataFrame:
    """One of the sample's rows that have the same label and the same four smallest hashes of five-word shingles.

    Copies agree in them.  Left in, the words of one much copied toxic text
    would all look like marks of toxicity.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [[h] for h in b.column("h").to_pylist()]
            for t in textscan.chunks(b.column("t")):
                elements, first = near_dup.shingles(t, 5)
                for i in np.flatnonzero(np.diff(first)).tolist():
                    marks[t.rows.start + i] = elements[first[i] : min(first[i + 1], first[i] + 4)].view(np.int64).tolist()  # shingles are sorted
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.list_(pa.int64()))], names=[*b.schema.names, "m"])

    marked = rows.mapInArrow(least, "k string, t string, y int, h long, m array<long>")
    first = marked.groupBy("y", "m").agg(F.min(F.struct("h", "k", "t")).alias("r"))
    return materialize(first.select("r.k", "r.t", "y", "r.h"), "toxic-distinct")


def gains(n: np.ndarray, pos: np.ndarray, base: float, chance: float) -> np.ndarray:
    """Square root of what the log-likelihood ratio of the label's share with a term has above ``chance``, where that share is raised."""
    neg, share = n - pos, pos / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(pos > 0, pos * np.log(share / base), 0.0) + np.where(neg > 0, neg * np.log((1 - share) / (1 - base)), 0.0))
    return np.sqrt(np.where(share > base, np.maximum(ratio - chance, 0.0), 0.0))


def build(
    hashes: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, keys: list, shares: np.ndarray, rate: float, k: int, block: int, chance: float
) -> Index:
    """Index of examples, each with its distinct terms and their counts."""
    n = np.array([len(h) for h in hashes], dtype=np.int64)
    has = np.flatnonzero(n)
    without = np.flatnonzero(n == 0)
    none = float((labels[without] * shares[without]).sum() + rate) / (shares[without].sum() + 1) if len(labels) else 0.0
    vocabulary, term = np.unique(np.concatenate([hashes[i] for i in has]) if len(has) else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(len(has)), n[has])
    y = labels[has].astype(float)
    df = np.bincount(term, minlength=len(vocabulary)).astype(float)
    base = float(labels.mean()) if len(labels) else 0.0
    gain = gains(df, np.bincount(term, y[owner], len(vocabulary)), base, chance) if 0 < base < 1 else np.zeros(len(vocabulary))
    weight = (np.log((1 + len(labels)) / (1 + df)) + 1) * (1 + gain)
    value = 1 + np.log(np.concatenate([counts[i] for i in has]) if len(has) else np.zeros(0))
    value = value * weight[term]
    value /= np.sqrt(np.bincount(owner, value * value, len(has)))[owner]
    # Examples with the same strongest term lie side by side, so that block maxima are tight.
    order = np.lexsort((term, -value, owner))
    strongest = term[order[np.searchsorted(owner, np.arange(len(has)))]] if len(has) else np.zeros(0, np.int64)
    place = np.lexsort((has, strongest))
    rank = np.empty(len(has), dtype=np.int64)
    rank[place] = np.arange(len(has))
    example = rank[owner]
    order = np.lexsort((example, term))
    term, example, value = term[order], example[order], value[order]
    of = example // block
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])])) if len(term) else np.zeros(0, np.int64)
    often = np.flatnonzero(df * DENSE > len(has))
    row = np.full(len(vocabulary), -1, dtype=np.int64)
    row[often] = np.arange(len(often))
    dense = np.zeros((len(often), len(has)))
    at = np.flatnonzero(row[term] >= 0)
    dense[row[term[at]], example[at]] = value[at]
    return Index(
        textscan.Lookup(vocabulary), weight, y[place], shares[has][place], [keys[i] for i in has[place]], np.searchsorted(term[new], np.arange(len(vocabulary) + 1)),
        of[new].astype(np.intp), np.maximum.reduceat(value, new) if len(new) else np.zeros(0), np.append(new, len(term)), row, dense, example.astype(np.intp), value, block, k, none, rate,
    )


def calibrate(votes: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the votes' log-odds, by Newton's method with a light prior on slope 1."""
    if min((labels == 1).sum(), (labels == 0).sum()) < 10:
        return 1.0, 0.0
    x, w = logit(votes), shares / shares.mean()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = logistic(a * x + b)
        r, v = w * (labels - p), w * p * (1 - p)
        g = np.array([(r * x).sum() - (a - 1), r.sum() - b * 0.1])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and math.isfinite(a + b) else (1.0, 0.0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = 2000,
    k: int = 15,
    block: int = 64,
    chance: float = 10.0,
) -> Index:
    """Index of at most ``per_class`` labelled rows of either label (by a hash of the key); ``train`` is a condition on ``k``."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).where(train)
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = total.get(1, 0) / sum(total.values()) if total else 0.0
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    # At most 2 * per_class narrow rows are sent to the executors; of rows that repeat a key no more are taken than that.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    rows = rows.select(F.col("k").cast("string").alias("k"), "t", "y", F.xxhash64("k", "t").alias("h"))
    rows = materialize(rows.orderBy("h", "k", "t").limit(2 * per_class).repartition(docs.sparkSession.sparkContext.defaultParallelism, "h"), "toxic-sample")
    rows = one_of_each(rows)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textscan.chunks(b.column("t")):
                h, owner = terms(t)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                cuts = pa.array(np.searchsorted(owner[new], np.arange(len(t) + 1)).astype(np.int32))
                part = b.slice(t.rows.start, len(t))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h[new].view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("k"), part.column("y"), *lists], names=["h", "k", "y", "j", "n"])

    got = rows.select("h", "k", "y", "t").mapInArrow(project, "h long, k string, y int, j array<long>, n array<int>").toArrow()
    got = got.combine_chunks().sort_by([("h", "ascending"), ("k", "ascending")])
    y = np.asarray(got["y"]).astype(float)
    size = np.bincount(y.astype(int), minlength=2)
    shares = np.where(y == 1, rate / max(size[1], 1), (1 - rate) / max(size[0], 1)) * len(y)
    hashes = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in got["j"]]
    counts = [np.asarray(x.values).astype(float) for x in got["n"]]
    index = build(hashes, counts, y, got["k"].to_pylist(), shares, rate, k, block, chance)
    if not 0 < rate < 1:
        return replace(index, none=rate)

    # Every example is voted on by the others; that tells how far votes can be trusted.
    place = {h: i for i, h in enumerate(index.keys)}
    spread = docs.sparkSession.sparkContext.broadcast((index, place))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, at = spread.value
        for b in batches:
            keys, out = b.column("k").to_pylist(), []
            for t in textscan.chunks(b.column("t")):
                but = [at.get(x, -1) for x in keys[t.rows]]
                out.extend(v[0] if v else None for v in ix.votes(t, but))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.float64())], names=["y", "p"])

    votes = rows.select("k", "t", "y").mapInArrow(voted, "y int, p double").where("p IS NOT NULL").toArrow()
    y, p = np.asarray(votes["y"]).astype(float), np.asarray(votes["p"])
    slope, shift = calibrate(p, y, np.where(y == 1, rate / max(y.sum(), 1), (1 - rate) / max((1 - y).sum(), 1)) * len(y))
    return replace(index, slope=slope, shift=shift)


def score(docs: DataFrame, index: Index, text: str = "text", name: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with the calibrated score of every whole text and the examples behind it."""
    spread = docs.sparkSession.sparkContext.broadcast(index)
    at = [c for c in docs.columns if c.lower() not in (name.lower(), evidence.lower())].index(text)

    def run(batch: pa.RecordBatch) -> list:
        ix = spread.value
        scores, why = [], []
        for t in textscan.chunks(batch.column(at)):
            for s, e in ix.scores(t):
                scores.append(s)
                why.append(e)
        return [scores, why]

    return annotate(docs, T.StructType([T.StructField(name, T.DoubleType()), T.StructField(evidence, T.StringType())]), run)
