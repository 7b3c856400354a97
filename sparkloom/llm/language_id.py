"""Language identification with rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 bytes of
lower-cased words, with a blank at either end of a word), in order of
frequency.  A document's own list is compared with each profile by the
out-of-place distance: the sum over the document's n-grams of the difference
of ranks, or of the profile's length where the profile lacks the n-gram.  The
nearest profile names the language.

Counts for the profiles cover every training document: each task sums what it
reads, one shuffle adds the sums by (language, n-gram), and only the top of
each language's list goes to the driver: ``profile_size`` numbers for each
language, however many there are.  A long text is counted piece by piece, and
there are at most 3.7 million different n-grams.

Defined results: a text that is null, empty or without a letter is ``und``
with score 0, and so is every text when there is nothing to learn from.
Ties in frequency go to the smaller n-gram, ties in distance to the first
language by code point.  Rows are independent, so repeated rows get equal
results and a null key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .frames import annotate

UNKNOWN = "und"
#: Texts are taken together up to so many bytes: each byte makes three n-grams of eight bytes, several times over.
CHUNK_BYTES = 1 << 18
LENGTHS = (1, 2, 3)
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class Profiles:
    """Languages in order of code point; for each its n-grams, sorted, and their ranks."""

    languages: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]
    size: int


def grams(texts: textscan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some texts, and the text that each is in."""
    lengths = np.diff(texts.offsets)
    owner = np.repeat(np.arange(len(texts)), lengths)
    padded = np.zeros(len(texts.data) + len(texts) + 3, dtype=np.uint64)
    at = np.arange(len(texts.data)) + owner + 1
    padded[at] = _LETTER[texts.data]
    text_of = np.zeros(len(padded), dtype=np.int64)
    text_of[at] = owner
    letter = padded > 0
    out, owners = [], []
    keep = np.flatnonzero(letter)
    out.append(padded[keep])
    owners.append(text_of[keep])
    # A blank may only be the first or the last byte, so the byte that must be a letter also tells the text.
    pair = np.flatnonzero(letter[:-1] | letter[1:])
    out.append(padded[pair] << np.uint64(8) | padded[pair + 1] | np.uint64(1 << 24))
    owners.append(np.where(letter[pair], text_of[pair], text_of[pair + 1]))
    mid = np.flatnonzero(letter[1:-1])
    out.append(padded[mid] << np.uint64(16) | padded[mid + 1] << np.uint64(8) | padded[mid + 2] | np.uint64(2 << 24))
    owners.append(text_of[mid + 1])
    return np.concatenate(out), np.concatenate(owners)


def piece_grams(left: int, data: np.ndarray, right: int, last: bool) -> np.ndarray:
    """The n-grams of one piece of a text between two bytes: those whose second byte of two, or middle one of three, it has."""
    p = np.concatenate([[_LETTER[left]], _LETTER[data], [_LETTER[right]]]).astype(np.uint64)
    a, b = (p[:-1], p[1:]) if last else (p[:-2], p[1:-1])
    two = (a > 0) | (b > 0)
    mid = np.flatnonzero(p[1:-1]) + 1
    three = p[mid - 1] << np.uint64(16) | p[mid] << np.uint64(8) | p[mid + 1] | np.uint64(2 << 24)
    return np.concatenate([p[mid], a[two] << np.uint64(8) | b[two] | np.uint64(1 << 24), three])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, in order of the key."""
    key = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    n = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(n, first) if len(first) else n)


def text_counts(t: textscan.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) of some texts in order, with how often each occurs."""
    if len(t) > 1 or len(t.data) <= CHUNK_BYTES:
        gram, owner = grams(t)
        return counted(owner, gram)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(t.data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(t.data))
        left, right = (int(t.data[a - 1]) if a else 0), (int(t.data[b]) if b < len(t.data) else 0)
        held.append(np.unique(piece_grams(left, t.data[a:b], right, b == len(t.data)), return_counts=True))
        if len(held) >= 32:
            held = [merged(held)]
    gram, n = merged(held)
    return np.zeros(len(gram), np.int64), gram, n


def counted(owner: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, gram) in order, with how often each occurs."""
    key = np.sort(owner.astype(np.uint64) << np.uint64(32) | gram)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, n = key[first], np.diff(np.append(first, len(key)))
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF), n


def top_ranked(owner: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams of each owner with their ranks; the input is ordered by (owner, gram)."""
    order = np.lexsort((-n, owner))
    owner = owner[order]
    first = np.searchsorted(owner, owner, "left")
    rank = np.arange(len(owner)) - first
    keep = rank < size
    return owner[keep], gram[order][keep], rank[keep]


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def learn_profiles(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    where: Column | None = None,
    profile_size: int = 400,
) -> Profiles:
    """Profiles of all rows of ``docs`` (those of ``where``) that have a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for t in textscan.chunks(_lower(batch.column(0)), CHUNK_BYTES):
                owner, g, n = text_counts(t)
                if len(g):
                    held.append((langs[t.rows][owner].astype(np.uint64) << np.uint64(32) | g, n))
                if len(held) >= 32:
                    held = [merged(held)]
        if held:
            key, n = merged(held)
            known = list(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([known[i] for i in (key >> np.uint64(32)).tolist()], pa.string()),
                    pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )

    sums = rows.mapInArrow(tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the top of each of 16 parts of a language's n-grams, so that no task sorts all of one language's.
    part = F.pmod(F.xxhash64("gram"), F.lit(16))
    by_part = Window.partitionBy("lang", part).orderBy(F.desc("n"), "gram")
    some = sums.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= profile_size)
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = some.withColumn("rank", F.row_number().over(by_count) - 1).where(F.col("rank") < profile_size)
    found = top.groupBy("lang").agg(F.collect_list(F.struct("rank", "gram")).alias("list")).collect()
    found = sorted(found, key=lambda r: r["lang"])
    lists = [np.array(r["list"], dtype=np.int64).reshape(-1, 2) for r in found]
    orders = [np.argsort(x[:, 1]) for x in lists]
    return Profiles(
        [r["lang"] for r in found], [x[o, 1].astype(np.uint64) for x, o in zip(lists, orders, strict=True)], [x[o, 0] for x, o in zip(lists, orders, strict=True)], profile_size
    )


def distances(t: textscan.Texts, p: Profiles) -> np.ndarray:
    """Mean out-of-place distance of each text to each profile; a text without n-grams has the largest."""
    out = np.full((len(t), len(p.languages)), float(p.size))
    owner, gram, rank = top_ranked(*text_counts(t), p.size)
    if not len(owner) or not p.languages:
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.append(first, len(owner)))
    for j, (known, ranks) in enumerate(zip(p.grams, p.ranks, strict=True)):
        k = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        d = np.where(known[k] == gram, np.abs(rank - ranks[k]), p.size)
        out[owner[first], j] = np.add.reduceat(d, first) / size
    return out


def identify(
    docs: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    The score is the runner-up's share of the two smallest distances (0.5 for a
    tie, towards 1 when the nearest profile fits far better); with one known
    language it is the share of the largest distance that the text keeps clear of.
    """
    spread = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text)

    def predict(column: pa.Array) -> list:
        p = spread.value
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        langs: list[str] = [UNKNOWN] * len(column)
        scores = np.zeros(len(column))
        for t in textscan.chunks(_lower(column), CHUNK_BYTES):
            d = distances(t, p)
            if not d.shape[1]:
                continue
            best = d.argmin(axis=1)
            near = d[np.arange(len(d)), best]
            if d.shape[1] > 1:
                second = np.partition(d, 1, axis=1)[:, 1]
                s = np.where(near + second > 0, second / np.maximum(near + second, 1e-12), 0.5)
            else:
                s = 1 - near / p.size
            for i in np.flatnonzero(lettered[t.rows]):
                langs[t.rows.start + i] = p.languages[best[i]]
                scores[t.rows.start + i] = s[i]
        return [langs, scores]

    fields = T.StructType([T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    # The text is read under a name of its own, since annotate() replaces clashing columns.
    if text.lower() in (pred.lower(), score.lower()):
        raise ValueError("the result columns can't have the text column's name")
    keep = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    at = keep.index(text)
    return annotate(docs, fields, lambda batch: predict(batch.column(at)))
