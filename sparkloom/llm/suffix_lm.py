"""Language-model scores from a probabilistic suffix tree.

Tokens are words between blanks, A-Z lower-cased, as 64-bit hashes, and one
end for each text.

* Unigrams: exact counts of all training tokens, summed in each task and then
  by one shuffle; the table has a row for each distinct token and stays
  distributed.
* Contexts of 1 to ``depth`` tokens are counted level by level over all
  training texts, with what follows them.  The tree is bounded by absolute
  counts alone: a context occurs ``min_context`` times or more, a follower
  ``min_follower`` times or more after it, so the tree grows with the corpus.
  A context of n + 1 tokens can only be that frequent if its last n tokens with
  the token before them were, which the level before has counted.
* A context is retained if it predicts better than its longest shorter suffix
  by more than its parameters cost: count times divergence against
  0.5 ln(count) for each follower.  Suffixes of what is retained stay.
* Next-token distributions are smoothed by absolute discounting; the mass
  saved goes to the distribution of the next shorter suffix, renormalised over
  the tokens that the longer one lacks, down to the unigrams.
* A text is scored token by token in the state of the longest suffix in the
  tree.

The tree is a table ``h, v`` that stays distributed.  As a follower of a
context is one of all its suffixes too, what a token's states add to its
unigram score is a sum over its contexts: ``v`` of each state (the mass left
over) and ``v`` of each (state, token) pair (its log-ratio, less what the next
shorter pair gave).  So scoring needs no walk: it sums the values of the keys
that the table has.  The values that are wanted most often go along with the
code (at most ``head``), unigram counts alike; the others are asked for at the
tables.  A Bloom filter of bounded size tells most absent keys.

What is shuffled in large numbers goes in blocks: a task sorts what it has
gathered, up to some million keys, and sends each part of the key space its
share as one row, compressed.  Parts grow in number with the corpus, so that
one of them stays small; no context or key lands in one alone that other rows
would have to wait for.  Pairs of frequent contexts and followers go as numbers
of a list that goes along, others as hashes.  Texts are scored in rounds, one
after the other, so that only one round's questions are on disk at once.

Defined results: a null text is empty and has the end as its only token;
without training texts every token's base probability is that of an unknown
one; rows are scored on their own, so repeated rows and null ids stay.  Ids may
be of any type.  A text is of one round by its own hash, whatever its id.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textscan
from .store import forget, freeing, materialize

#: The end of a text, as a hash that is not made from bytes.
END = np.uint64(0x0123456789ABCDEF)
_DISTINCT = 1 << 20
#: Bits of a filter of the keys in a table, as powers of two: 12 for each key between these bounds, so 32 MB in memory at most.
FILTER_BITS = (16, 28)
#: Bits that a key sets in its filter.
PROBES = 3
_BASE, _PAIR = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
#: Rounds of texts that are scored one after the other, and shares of the parts that meet the tables one after the other in each.
ROUNDS, SHARES = 2, 4
#: Training tokens for each part that keys are dealt to, and bounds of the number of parts, as powers of two.
PART_TOKENS, PART_BITS = 21, (7, 16)
#: Tokens and contexts that can be numbered, as a power of two.
NUMBERED = 24
#: What a task may hold before it sends it: keys that texts ask for, and texts.
_ASKED, _TEXTS = 1 << 20, 1 << 16
#: Tokens whose contexts are looked at together.
SLICE = 1 << 18


def tokens(t: textscan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each text, and where each text's begin."""
    words, first = textscan.word_hashes(t.lowered(), textscan.SPACED)
    h = np.full(len(words) + len(t), END, dtype=np.uint64)
    begin = first + np.arange(len(t) + 1)
    if len(words):
        h[np.arange(len(words)) + np.repeat(np.arange(len(t)), np.diff(first))] = words
    return h, begin


def scattered(token: np.ndarray) -> np.ndarray:
    """What a token adds to the key of a context, before its place is counted in."""
    return textscan.mix(token + np.uint64(1))


def led_by(context: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """The key of a context moved on by one token: the sum over its tokens, the nearest first, times powers of a base."""
    return scattered(follower) + context * _BASE


def pair(context: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """The key of a context with what follows it."""
    return textscan.mix((context ^ _PAIR) * _PAIR + follower)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted rows, a new value begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Tally:
    """Counts of 64-bit keys, each with a row of other columns that it stands for; ``add`` gives back what has to leave."""

    def __init__(self, most: int = _DISTINCT):
        self.most, self.held, self.size = most, [], 0

    def merged(self) -> list[np.ndarray]:
        if not self.held:
            return []
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.argsort(cols[0])
        first = runs(key := cols[0][order])
        return [key[first], np.add.reduceat(cols[1][order], first) if len(first) else cols[1], *(c[order[first]] for c in cols[2:])]

    def add(self, key: np.ndarray, *more: np.ndarray) -> list[np.ndarray] | None:
        order = np.argsort(key) if more else None
        key = key[order] if more else np.sort(key)
        first = runs(key)
        self.held.append([key[first], np.diff(np.append(first, len(key))), *(m[order[first]] for m in more)])
        self.size += len(first)
        if self.size > self.most:
            got = self.merged()
            if len(got[0]) > self.most // 2:
                self.held, self.size = [], 0
                return got
            self.held, self.size = [got], len(got[0])
        return None


class Listed(textscan.Lookup):
    """A lookup that is sent as its hashes only."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        super().__init__(hashes, bits)
        self.bits = bits

    def __reduce__(self):
        hashes = np.empty_like(self.sorted)
        hashes[self.order] = self.sorted
        return Listed, (hashes, self.bits)


class Bitmap:
    """Whether a key may be in a table, as a Bloom filter whose bits for a key lie in one word: no false absence."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        word = self.words[(h >> np.uint64(36) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        wanted = np.zeros(len(h), dtype=np.uint64)
        for i in range(PROBES):
            wanted |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return word & wanted == wanted


def bitmap(keys: DataFrame, name: str = "h", rows: int | None = None) -> Bitmap:
    """Of a table's keys, put together by the executors, a row a key: at most 2^22 words of 64 bits come to the driver."""
    least, most = FILTER_BITS
    bits = min(max((12 * (keys.count() if rows is None else rows)).bit_length(), least), most)
    word = F.shiftrightunsigned(name, 36).bitwiseAND(F.lit((1 << bits - 6) - 1)).cast("int").alias("word")
    bit = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(`{name}`, {6 * i}) & 63 AS INT))" for i in range(PROBES))
    got = keys.select(word, F.expr(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    made = np.zeros(1 << bits - 6, dtype=np.uint64)
    made[np.asarray(got["word"], dtype=np.int64)] = np.asarray(got["bits"], dtype=np.int64).view(np.uint64)
    return Bitmap(made)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _counted(rows: DataFrame) -> DataFrame:
    """``h, c``: how often the texts have each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        out = lambda found: pa.RecordBatch.from_arrays([_signed(found[0]), _signed(found[1])], names=["h", "c"])
        for b in batches:
            for t in textscan.chunks(b.column(0)):
                if (full := tally.add(tokens(t)[0])) is not None:
                    yield out(full)
        if last := tally.merged():
            yield out(last)

    return rows.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


BLOCK = "part int, first long, n long, block binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, the first ascending, as one binary: the steps of the first, bytes of one weight together, compressed."""
    steps = np.diff(columns[0], prepend=np.uint64(0))
    planes = [c.view(np.uint8).reshape(-1, 8).T.ravel() for c in (steps, *columns[1:])]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(block: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(block, decompressed_size=8 * n * columns, codec="zstd"), dtype=np.uint8).reshape(columns, 8, n)
    first, *more = (np.ascontiguousarray(r.T).view(np.uint64).ravel() for r in raw)
    return [np.cumsum(first, dtype=np.uint64), *more]


def blocks(part: np.ndarray, first: int, *columns: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of ``BLOCK``, one for each part; rows of a part lie together, by the first column."""
    for lo, hi in itertools.pairwise(np.append(runs(part), len(part))):
        yield int(part[lo]), first, int(hi - lo), packed(*(c[lo:hi] for c in columns))


def _sent(made: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BLOCK``."""
    while rows := list(itertools.islice(made, 256)):
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "first", "n", "block"])


def _met(sent: DataFrame) -> DataFrame:
    """Blocks of a part, one after the other, in one task."""
    return sent.select("part", "first", "n", "block").repartition("part").sortWithinPartitions("part", "first")


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)


def part_bits(total: int) -> int:
    """Of the parts for a corpus of so many tokens."""
    least, most = PART_BITS
    return min(max((total >> PART_TOKENS).bit_length(), least), most)


@dataclass
class Codes:
    """Pairs of a numbered context and a numbered token as one number of 64 bits.

    The highest 16 are the part, made of both numbers so that no context or
    token is dealt to one part; below it the context's number and what the part
    does not tell of the token's.
    """

    contexts: np.ndarray
    tokens: np.ndarray
    bits: int  # of the parts

    @property
    def width(self) -> int:
        return (max(len(self.tokens) - 1, 0) >> self.bits).bit_length()

    def __call__(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        part = context + token & (1 << self.bits) - 1
        return (part << 48 | context << self.width | token >> self.bits).view(np.uint64)

    def told(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of contexts and tokens."""
        code = code.view(np.int64)
        context = (code & (1 << 48) - 1) >> self.width
        token = (code & (1 << self.width) - 1) << self.bits | (code >> 48 & 0xFFFF) - context & (1 << self.bits) - 1
        return self.contexts[context], self.tokens[token]


def _pairs(rows: DataFrame, found, codes: Codes, least: int, name: str) -> DataFrame:
    """The table ``ctx, x, c`` of the pairs that occur ``least`` times or more.

    ``found(texts)`` gives pairs of numbers as codes, and contexts and followers
    of the others.
    """
    bits, spread = codes.bits, rows.sparkSession.sparkContext.broadcast(codes)

    def coded(got: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
        return blocks((got[0] >> np.uint64(48)).astype(np.int64), 0, got[0] & np.uint64((1 << 48) - 1), got[1].astype(np.uint64))

    def named(got: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
        part = (got[0] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((got[2], part))
        return blocks(part[order], 1, got[2][order], got[3][order], got[1][order].astype(np.uint64))

    def gather(texts: Iterator[textscan.Texts]) -> Iterator[tuple[int, int, int, bytes]]:
        numbers, names = Tally(), Tally()
        for t in texts:
            for code, ctx, x in found(t):
                if (full := numbers.add(code)) is not None:
                    yield from coded(full)
                if len(ctx) and (full := names.add(pair(ctx, x), ctx, x)) is not None:
                    yield from named(full)
        if last := numbers.merged():
            yield from coded(last)
        if last := names.merged():
            yield from named(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(gather(t for b in batches for t in textscan.chunks(b.column(0))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, kind), met in itertools.groupby(_received(batches), lambda r: r[:2]):
            cols = [np.concatenate(c) for c in zip(*(unpacked(block, n, 2 + kind) for _, _, n, block in met), strict=True)]
            key = pair(cols[0], cols[1]) if kind else cols[0] | np.uint64(part << 48)
            order = np.argsort(key)
            first = runs(key[order])
            c = np.add.reduceat(cols[-1][order], first)
            at = order[first[c >= least]]
            ctx, x = (cols[0][at], cols[1][at]) if kind else spread.value.told(key[at])
            yield pa.RecordBatch.from_arrays([_signed(ctx), _signed(x), _signed(c[c >= least])], names=["ctx", "x", "c"])

    made = materialize(_met(rows.mapInArrow(run, BLOCK)).mapInArrow(merge, "ctx long, x long, c long"), name)
    spread.destroy()
    return made


def contexts(h: np.ndarray, begin: np.ndarray, lo: int, hi: int, depth: int, known=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places from ``lo`` to ``hi`` whose context of that length lies in their text, and its key.

    ``known(n, keys)`` tells which keys may be contexts of n tokens; places
    without go no further.
    """
    at = np.arange(lo, hi)
    start = begin[np.searchsorted(begin, at, "right") - 1]
    key = np.zeros(len(at), dtype=np.uint64)
    power = np.uint64(1)
    for n in range(1, depth + 1):
        ok = at - start >= n
        at, start, key = at[ok], start[ok], key[ok]
        key = key + scattered(h[at - n]) * power
        power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
        if known is not None:
            ok = known(n, key)
            at, start, key = at[ok], start[ok], key[ok]
        yield at, key


def _extended(rows: DataFrame, name: str) -> DataFrame:
    """``ctx, shorter, total`` of the contexts that rows of ``ctx, shorter, x, c`` make when their follower joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx, shorter, x = (np.asarray(b.column(c), dtype=np.int64).view(np.uint64) for c in ("ctx", "shorter", "x"))
            # A context of one token has the empty one as its next shorter, and that stays empty.
            short = np.where(ctx == 0, np.uint64(0), led_by(shorter, x))
            yield pa.RecordBatch.from_arrays([_signed(led_by(ctx, x)), _signed(short), b.column("c")], names=["ctx", "shorter", "total"])

    return materialize(rows.select("ctx", "shorter", "x", "c").mapInArrow(run, "ctx long, shorter long, total long"), name)


def _pair_keys(found: DataFrame) -> DataFrame:
    """``h``: the keys of rows of ``ctx, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx, x = (np.asarray(b.column(c), dtype=np.int64).view(np.uint64) for c in ("ctx", "x"))
            yield pa.RecordBatch.from_arrays([_signed(pair(ctx, x))], names=["h"])

    return found.select("ctx", "x").mapInArrow(run, "h long")


def _numbered(table: DataFrame, name: str, most: int) -> tuple[np.ndarray, DataFrame | None]:
    """The most frequent of ``name`` as a list, those that occur most first, and a table of the others, if any."""
    top, rest = most_frequent(table, min(most, 1 << NUMBERED))
    names = np.asarray(top[name], dtype=np.int64).view(np.uint64)
    return names[np.argsort(-np.asarray(top["c"], dtype=np.int64), kind="stable")], rest


def grow(
    rows: DataFrame, counts: DataFrame, divisor: float, bits: int, depth: int, min_context: int, min_follower: int, discount: float = 0.75, head: int = 1 << 18
) -> DataFrame | None:
    """The tree as ``h, v, c``, ``c`` being how often the key occurs; ``h, c`` of ``counts`` are the unigrams of ``rows``."""
    context = rows.sparkSession.sparkContext
    frequent = counts.where(F.col("c") >= min_follower)
    names, others = _numbered(frequent, "h", head)
    follows = context.broadcast((Listed(names), bitmap(others) if others is not None else None))
    base = (F.ln(F.col("c") + 0.5) - F.lit(math.log(divisor))).alias("base")
    below = frequent.select(F.lit(0).cast("long").alias("shorter"), F.col("h").alias("x"), base, base.alias("lower"))
    end = int(END)
    found = counts.select(F.lit(0).cast("long").alias("ctx"), F.lit(0).cast("long").alias("shorter"), F.col("h").alias("x"), "c")
    levels: list[tuple[DataFrame, DataFrame]] = []
    filters: list[Bitmap] = []
    scratch: list[DataFrame] = []
    for n in range(1, depth + 1):
        # A follower, an end aside, makes a context with those that it follows, and occurs as often as that one.
        heads = _extended(found.where((F.col("c") >= min_context) & (F.col("x") != end)), f"lm-contexts{n}")
        if not heads.limit(1).count():
            forget(heads)
            break
        filters.append(bitmap(heads, "ctx"))
        # From the second level on, what follows a context has to have followed the next shorter one.
        before = bitmap(_pair_keys(found), rows=found.count()) if n > 1 else None
        codes = Codes(_numbered(heads.withColumnRenamed("total", "c"), "ctx", head)[0], names, bits)
        spread = context.broadcast((list(filters), before, codes, Listed(codes.contexts)))

        def grams(t: textscan.Texts, n=n, spread=spread) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            (number, others), (known, before, codes, numbered) = follows.value, spread.value
            h, begin = tokens(t)
            for lo in range(0, len(h), SLICE):
                *_, shorter, (at, key) = (None, *contexts(h, begin, lo, min(lo + SLICE, len(h)), n, lambda m, k: known[m - 1](k)))
                x = number(h[at])
                ok = x >= 0
                if others is not None:
                    missed = np.flatnonzero(~ok)
                    ok[missed] = others(h[at[missed]])
                at, key, x = at[ok], key[ok], x[ok]
                if before is not None:
                    ok = before(pair(shorter[1][np.searchsorted(shorter[0], at)], h[at]))
                    at, key, x = at[ok], key[ok], x[ok]
                ctx = numbered(key)
                ok = (ctx >= 0) & (x >= 0)
                yield codes(ctx[ok], x[ok]), key[~ok], h[at[~ok]]

        # What the bitmaps let through by chance goes here: counts and contexts are exact.
        counted = _pairs(rows, grams, codes, min_follower, f"lm-pairs{n}")
        # A follower of a context follows its suffixes too, so the level below has a row for each.
        found = counted.join(heads, "ctx").join(below, ["shorter", "x"])
        found = materialize(found.withColumn("own", F.ln((F.col("c") - F.lit(discount)) / F.col("total"))), f"lm-followers{n}")
        forget(counted, heads)
        spread.destroy()
        scratch.append(found)
        per = found.groupBy("ctx").agg(
            F.first("shorter").alias("shorter"), F.first("total").alias("total"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("counted"),
            F.sum(F.col("c") * (F.ln(F.col("c") / F.col("total")) - F.col("lower"))).alias("gain"),
            F.sum(F.exp("own")).alias("own"), F.sum(F.exp("lower")).alias("lower"),
        )
        # Followers that were not counted are one more outcome.
        left, over = F.col("total") - F.col("counted"), F.greatest(1 - F.col("lower"), F.lit(1e-9))
        rest = F.when(left > 0, left * (F.ln(left / F.col("total")) - F.ln(over))).otherwise(F.lit(0.0))
        passed = F.col("gain") + rest > F.lit(0.5) * F.col("k") * F.ln("total")
        mass = F.log10(F.greatest(1 - F.col("own"), F.lit(1e-9)) / over)
        levels.append((materialize(per.select("ctx", "shorter", "total", passed.alias("passed"), mass.alias("rest")), f"lm-states{n}"), found))
        below = found.select(F.col("ctx").alias("shorter"), "x", "base", F.col("own").alias("lower"))
    follows.destroy()

    # From the longest on: a state stays if it passed or is a suffix of one that stays.
    values, needed = None, None
    for per_level, measured in reversed(levels):
        per = per_level
        keep = F.col("passed")
        if needed is not None:
            per = per.join(needed, "ctx", "left")
            keep = keep | F.coalesce("needed", F.lit(False))
        kept = materialize(per.where(keep).select("ctx", "shorter", "total", "rest"), "lm-kept")
        needed = kept.select(F.col("shorter").alias("ctx")).distinct().withColumn("needed", F.lit(True))
        pairs = measured.select("ctx", "x", "c", "own", "lower").join(kept.select("ctx", "rest"), "ctx")
        # A pair takes back the mass that its own state leaves to others.
        value = (F.col("own") - F.col("lower")) / F.lit(math.log(10)) - F.col("rest")
        part = kept.select("ctx", F.lit(None).cast("long").alias("x"), F.col("rest").alias("v"), F.col("total").alias("c"))
        part = part.unionAll(pairs.select("ctx", "x", value.alias("v"), "c"))
        values = part if values is None else values.unionAll(part)
        scratch += [per_level, kept]
    if values is None:
        forget(*scratch)
        return None

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ctx = np.asarray(b.column(0), dtype=np.int64).view(np.uint64)
            state = b.column(1).is_null().to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(1).fill_null(0), dtype=np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(np.where(state, ctx, pair(ctx, x))), b.column(2), b.column(3)], names=["h", "v", "c"])

    tree = materialize(values.mapInArrow(keyed, "h long, v double, c long"), "lm-tree")
    forget(*scratch)
    return tree


def most_frequent(table: DataFrame, most: int) -> tuple[pa.Table, DataFrame | None]:
    """At most ``most`` rows of the largest ``c``, and a table of the others, if any.

    Counts by eighths of powers of two: a few hundred rows tell which count
    makes the head.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1))).collect()), reverse=True)
    seen, least = 0, 1 << 30
    for s, n in sizes:
        if seen + n > most:
            break
        seen, least = seen + n, s
    return table.where(step >= least).toArrow(), table.where(step < least) if seen < sum(n for _, n in sizes) else None


@dataclass
class Model:
    head: textscan.Lookup  # the most frequent tokens
    head_counts: np.ndarray
    tree: textscan.Lookup  # the most frequent keys of the tree
    tree_values: np.ndarray
    rest: DataFrame | None  # the others as blocks of keys and values, unigrams as logarithms
    more_tokens: bool  # whether these have tokens
    may_rest: Bitmap | None  # of the other keys of the tree
    total: int
    distinct: int
    depth: int
    bits: int  # of the parts
    states: DataFrame | None  # the whole tree

    @property
    def divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def learn(
    docs: DataFrame,
    where: Column | None = None,
    text: str = "text",
    depth: int = 3,
    min_context: int = 32,
    min_follower: int = 4,
    head: int = 1 << 18,
    tree_head: int = 1 << 20,
) -> Model:
    """Counts and tree of all rows of ``docs`` that meet ``where``."""
    if not 1 <= min_follower <= min_context:
        raise ValueError("a context has to be as frequent as its followers")
    with freeing(docs.sparkSession):
        return _learned(docs, where, text, depth, min_context, min_follower, head, tree_head)


def _learned(docs: DataFrame, where: Column | None, text: str, depth: int, min_context: int, min_follower: int, head: int, tree_head: int) -> Model:
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialize(_counted(rows), "lm-counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = size["n"], size["v"]
    bits = part_bits(total)
    tree = grow(rows, counts, total + 0.5 * (distinct + 1), bits, depth, min_context, min_follower, head=head)
    top, rest = most_frequent(counts, head)
    u64 = lambda c: np.asarray(c, dtype=np.int64).view(np.uint64)
    if rest is not None:
        rest = rest.select("h", F.log10(F.col("c") + F.lit(0.5)).alias("v"), F.lit(True).alias("token"))
    more_tokens = rest is not None
    keys, values, may_rest = np.zeros(0, np.uint64), np.zeros(0), None
    if tree is not None:
        best, other = most_frequent(tree, tree_head)
        keys, values = u64(best["h"]), np.asarray(best["v"])
        if other is not None:
            may_rest = bitmap(other)
            other = other.select("h", "v", F.lit(False).alias("token"))
            rest = other if rest is None else rest.unionAll(other)
    if rest is not None:
        rest = materialize(_table_blocks(rest, bits), "lm-rest")
    forget(counts)
    return Model(
        Listed(u64(top["h"])), np.asarray(top["c"], dtype=np.int64), Listed(keys, 22), values,
        rest, more_tokens, may_rest, total, distinct, depth, bits, tree,
    )


def _table_blocks(table: DataFrame, bits: int) -> DataFrame:
    """Rows of ``h, v, token`` as blocks; those of tokens are in parts of their own."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        held: list[list[np.ndarray]] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                h = np.asarray(b.column("h"), dtype=np.int64).view(np.uint64)
                held.append([_part(h, b.column("token").to_numpy(zero_copy_only=False), bits), h, np.asarray(b.column("v"), dtype=np.float64).view(np.uint64)])
            if held and (b is None or sum(len(x[0]) for x in held) >= _ASKED):
                part, h, v = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.lexsort((h, part))
                yield from blocks(part[order], -1, h[order], v[order])
                held = []

    return table.select("h", "v", "token").mapInArrow(lambda batches: _sent(made(batches)), BLOCK)


def _part(h: np.ndarray, token: np.ndarray | bool, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) * 2 + token


def _tree_gains(h: np.ndarray, begin: np.ndarray, depth: int, tree: textscan.Lookup, values: np.ndarray, may: Bitmap | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """What the tree's head adds to each token, and the places and keys that only the rest of the tree can tell."""
    out, open_ = np.zeros(len(h)), []
    found = np.zeros(0, dtype=np.int64)  # where the tree's head has the states that were last asked for

    def told(at: np.ndarray, key: np.ndarray, k: np.ndarray) -> None:
        hit = k >= 0
        out[at[hit]] += values[k[hit]]
        if may is not None:
            missed = np.flatnonzero(~hit)
            missed = missed[may(key[missed])]
            if len(missed):
                open_.append((at[missed], key[missed]))

    def state(_: int, key: np.ndarray) -> np.ndarray:
        nonlocal found
        found = tree(key)
        there = found >= 0
        if may is not None:
            missed = np.flatnonzero(~there)
            there[missed] = may(key[missed])
        found = found[there]
        return there

    for lo in range(0, len(h), SLICE):
        # Places without a state go no further: the suffixes of a state are states.
        for at, key in contexts(h, begin, lo, min(lo + SLICE, len(h)), depth, state):
            if len(at):
                told(at, key, found)
                follower = pair(key, h[at])
                told(at, follower, tree(follower))
    return out, open_


def _questions(keys: list[tuple[np.ndarray, np.ndarray, bool]], first: int, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Blocks of keys, the texts that ask for them, counted from ``first``, and how often, of lists of texts, keys and whether they are tokens."""
    for token in (False, True):
        if not (mine := [k for k in keys if k[2] == token]):
            continue
        owner, h = (np.concatenate(c) for c in list(zip(*mine, strict=True))[:2])
        order = np.argsort(h, kind="stable")
        owner, h = owner[order].astype(np.uint64), h[order]
        at = runs(h, owner)
        n = np.diff(np.append(at, len(h))).astype(np.uint64)
        yield from blocks(_part(h[at], token, bits), first, h[at], owner[at], n)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the tables' blocks add to the texts whose questions meet them, summed over a task's parts: texts and sums as blocks."""
    held: dict[int, np.ndarray] = {}
    unseen = math.log10(0.5)

    def out() -> Iterator[tuple[int, int, int, bytes]]:
        for first, sums in held.items():
            at = np.flatnonzero(sums.any(axis=0))
            if len(at):
                yield 0, first, len(at), packed(at.astype(np.uint64), *(np.ascontiguousarray(x[at]).view(np.uint64) for x in sums))
        held.clear()

    for part, met in itertools.groupby(_received(batches), lambda r: r[0]):
        token, parts, table = part % 2 == 1, [], None
        for _, first, n, block in met:
            if first < 0:
                parts.append(unpacked(block, n, 2))
                continue
            if table is None:
                if not parts:
                    break
                keys, values = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(keys)
                table = keys[order], values[order].view(np.float64)
            h, owner, times = unpacked(block, n, 3)
            k = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
            hit = table[0][k] == h
            owner, times, v = owner[hit].astype(np.int64), times[hit].astype(float), table[1][k[hit]]
            if not len(owner):
                continue
            sums = held.get(first, np.zeros((3, 0)))
            if (size := int(owner.max()) + 1) > sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, size - sums.shape[1])))
            # An unknown token's share is in the text's own sum.
            sums[0 if token else 1] += np.bincount(owner, times * (v - unseen if token else v), sums.shape[1])
            if token:
                sums[2] += np.bincount(owner, times, sums.shape[1])
            held[first] = sums
            if sum(x.shape[1] for x in held.values()) >= _TEXTS * 16:
                yield from _sent(out())
    yield from _sent(out())


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``uid, tail, tail_more, tail_known`` of blocks of answers, those of the same texts together."""
    for first, met in itertools.groupby(_received(batches), lambda r: r[1]):
        sums = np.zeros((3, 0))
        for _, _, n, block in met:
            at, *more = unpacked(block, n, 4)
            at = at.astype(np.int64)
            if at[-1] >= sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, int(at[-1]) + 1 - sums.shape[1])))
            sums[:, at] += np.stack([x.view(np.float64) for x in more])
        arrays = [pa.array(first + np.arange(sums.shape[1])), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["uid", "tail", "tail_more", "tail_known"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    spread = docs.sparkSession.sparkContext.broadcast(
        (model.head, model.head_counts, model.tree, model.tree_values, model.may_rest, model.more_tokens, model.depth, model.bits)
    )
    kind = docs.schema[key].dataType
    arrow = to_arrow_type(kind)
    fields = [
        ("uid", T.LongType()), ("doc_id", kind), ("tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("more", T.DoubleType()),
        ("part", T.IntegerType()), ("first", T.LongType()), ("n", T.LongType()), ("block", T.BinaryType()),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    types = [arrow if n == "doc_id" else to_arrow_type(t) for n, t in fields]

    def batch(size: int, **columns) -> pa.RecordBatch:
        made = [columns[n] if n in columns else pa.nulls(size, t) for (n, _), t in zip(fields, types, strict=True)]
        return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_counts, tree, values, may, more_tokens, depth, bits = spread.value
        logs = np.log10(head_counts + 0.5)
        # Unique within the job that writes these rows, which are then only read.
        uid = first = TaskContext.get().partitionId() << 36
        asked: list[tuple[np.ndarray, np.ndarray, bool]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for b in _sent(_questions(asked, first, bits)):
                yield batch(b.num_rows, part=b.column(0), first=b.column(1), n=b.column(2), block=b.column(3))
            asked.clear()

        for b in batches:
            for t in textscan.chunks(b.column(1)):
                h, begin = tokens(t)
                owner = np.repeat(np.arange(len(t)), np.diff(begin))
                at = head(h)
                inside = at >= 0
                base = np.full(len(h), math.log10(0.5))
                base[inside] = logs[at[inside]]
                base = np.bincount(owner, base, len(t)).astype(float)
                known = np.bincount(owner[inside], minlength=len(t))
                gains, open_ = _tree_gains(h, begin, depth, tree, values, may)
                more = np.bincount(owner, gains, len(t)).astype(float)
                ids = uid + np.arange(len(t))
                yield batch(len(t), uid=ids, doc_id=b.column(0).slice(t.rows.start, len(t)), tokens=np.diff(begin), known=known.astype(np.int64), base=base, more=more)
                if more_tokens:
                    outside = np.flatnonzero(~inside)
                    asked.append((owner[outside] + (uid - first), h[outside], True))
                asked += [(owner[places] + (uid - first), keys, False) for places, keys in open_]
                uid += len(t)
                if uid - first >= _TEXTS or sum(len(k) for _, k, _ in asked) >= _ASKED:
                    yield from sent()
                    first = uid
        yield from sent()

    def told(rows: DataFrame) -> DataFrame:
        parts = materialize(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema), "lm-parts")
        out = parts.where(F.col("part").isNull()).select("uid", "doc_id", "tokens", "known", "base", "more")
        if model.rest is None:
            return out.withColumns({"tail": F.lit(0.0), "tail_more": F.lit(0.0), "tail_known": F.lit(0)})
        asked = parts.where(F.col("part").isNotNull()).select("part", "first", "n", "block").unionAll(model.rest)
        answers = []
        for share in range(SHARES):
            # Parts of tree and tokens have even and odd numbers.
            mine = F.shiftright("part", 1).bitwiseAND(F.lit(SHARES - 1)) == share
            answers.append(materialize(_met(asked.where(mine)).mapInArrow(_answers, BLOCK), "lm-answers"))
        found = functools.reduce(DataFrame.unionAll, answers).repartition("first").sortWithinPartitions("first")
        found = found.mapInArrow(_totals, "uid long, tail double, tail_more double, tail_known long")
        out = materialize(out.join(found, "uid", "left").fillna(0, ["tail", "tail_more", "tail_known"]), "lm-told")
        forget(parts, *answers)
        return out

    with freeing(docs.sparkSession):
        if model.rest is None:
            out = told(docs)
        else:
            rounds = F.pmod(F.xxhash64(F.col(text)), F.lit(ROUNDS))
            out = functools.reduce(DataFrame.unionAll, [told(docs.where(rounds == k)) for k in range(ROUNDS)])
    spread.destroy()
    base = F.col("base") + F.col("tail") - F.col("tokens") * F.lit(math.log10(model.divisor))
    return out.select(
        "doc_id", F.col("tokens").alias("n_tokens"), (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more") + F.col("tail_more")).alias("score"),
    )
