"""Near-duplicate documents with SetSketch registers.

A document's set are its distinct word shingles as 64-bit hashes.

* Sketch: every element scatters points, a Poisson process in time with random
  registers, so each register's smallest time is an independent exponential of
  rate n, as if every element had drawn one for every register.  A register
  keeps the truncated logarithm of its smallest time to a base slightly above
  1; the maximum merges two sketches, and equal registers are as likely as the
  sets are alike.  Points later than the last register needs are never made.
* Banding: ``rows`` registers make a band; documents that agree in a band meet
  in its bucket.  At the threshold of 0.8, 32 bands of 4 miss a pair with a
  chance of about 5e-8.
* Identical sets are one representative from the start (128 bits of sums over
  the set and its size name it), so copies never make pairs.
* In each bucket all members are compared with one centre (its smallest id),
  which settles most buckets.  Where members are left in different components,
  the buckets that share members make a cluster, and a cluster's texts are dealt
  into blocks of bounded size.  A group is a pair of blocks; within it the pairs
  that share a band and lie in different components are compared, in order of
  the estimate, and only links that join components come out.  So no rows are
  made for pairs, nobody is dropped or capped, and linked members are not
  compared among themselves.  A text goes to as many groups as its cluster has
  blocks: m texts that are alike but not linked move m * m / 256 texts.
* Verification: the two sketches' joint likelihood of the similarity turns
  hopeless pairs away (a likelihood ratio of e^-25), then the full sets, made
  anew from the texts, decide.  A centre's members are dealt over salted groups
  of ``group`` rows, and only the centre's set is held.
* Components: the verified links are contracted to smallest neighbours, with
  pointer jumping, over tables.

Defined results: a null text, or one without words, has an empty set and is
its own component; fewer words than a shingle make one shingle; a null id
takes no part in naming, its component is the smallest id of the texts it is
linked with, else null, and it is kept only in the latter case; rows that
repeat an id with the same text get the same result each.  Ids may be of any
type that can be sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .frames import fresh
from .store import left_out, materialize, named, numbered, small

REGISTERS, BANDS, ROWS = 128, 32, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Points are drawn in blocks of these sizes; the sums within a block depend on nothing else.
_BLOCKS = (1, 1, 2, 4, 8, 16)
#: Elements whose points are drawn at once.
ELEMENTS = 1 << 18
_STEP, _SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHINGLE = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD6, 0xD1B54A32D192ED02, 0xAEF17502108EF2D8, 0x9FB21C651E98DF24, 0xE7037ED1A0B428DA, 0xA0761D6478BD642E)]


def shingles(t: textscan.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    h, first = textscan.word_hashes(t.lowered(), textscan.SPACED)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(t) + 1, np.int64)
    n = np.diff(first)
    full = np.zeros(len(h), dtype=np.uint64)
    for j in range(min(width, len(h))):
        full[: len(h) - j] += h[j:] * _SHINGLE[j % len(_SHINGLE)] if j < len(_SHINGLE) else textscan.mix(h[j:] + np.uint64(j))
    full = textscan.mix(full)
    parts, sizes = [], np.zeros(len(t) + 1, np.int64)
    for i, (a, k) in enumerate(zip(first[:-1].tolist(), n.tolist(), strict=True)):
        if k >= width:
            x = np.sort(full[a : a + k - width + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif k:
            s = np.uint64(k)
            for j in range(k):
                s = textscan.mix((np.array([s], np.uint64) + h[a + j]) * _SHINGLE[4])[0]
            x = np.array([s], dtype=np.uint64)
        else:
            continue
        parts.append(x)
        sizes[i + 1] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def sketches(elements: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each set; a set of n elements takes about max(n, registers * 14) points."""
    sets = len(first) - 1
    n = np.diff(first)
    least = np.full((sets, registers), np.inf)
    todo = np.flatnonzero(n)
    slack = 9.0
    while len(todo):
        end = np.zeros(sets)
        end[todo] = (math.log(registers) + slack) / n[todo]
        chosen = np.zeros(sets, dtype=bool)
        chosen[todo] = True
        every = np.repeat(np.arange(sets), n)
        some = np.flatnonzero(chosen[every])
        flat = least.reshape(-1)
        # Smallest times merge, so a long text's elements go through in parts.
        for lo in range(0, len(some), ELEMENTS):
            at = some[lo : lo + ELEMENTS]
            owner, e = every[at], elements[at]
            time, until = np.zeros(len(e)), end[owner]
            drawn = block = 0
            while len(e):
                size = _BLOCKS[min(block, len(_BLOCKS) - 1)]
                counter = np.arange(drawn + 1, drawn + size + 1, dtype=np.uint64) * _STEP
                bits = textscan.mix(e[:, None] + counter[None, :])
                gap = np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                gap /= -registers
                gap[:, 0] += time
                times = np.cumsum(gap, axis=1)
                where = (bits * _SIDE >> np.uint64(40)).astype(np.int64) % registers
                early = times <= until[:, None]
                target = (owner[:, None] * registers + where)[early]
                np.minimum.at(flat, target, times[early])
                on = early[:, -1]
                time, e, owner, until = times[on, -1], e[on], owner[on], until[on]
                drawn, block = drawn + size, block + 1
        # A register that no point reached in time needs later points (once in some thousand sets).
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        slack *= 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / math.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, k), 0, LIMIT + 1).astype(np.uint16)


def bands(regs: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(regs), count), dtype=np.uint64)
    for b in range(count):
        x = np.full(len(regs), b + 1, dtype=np.uint64)
        for r in range(rows):
            x = textscan.mix(x * _STEP + regs[:, b * rows + r].astype(np.uint64) + np.uint64(1))
        out[:, b] = x
    return out


def log_likelihood(j: np.ndarray, n_a: int, n_b: int, more: int, fewer: int, equal: int) -> np.ndarray:
    """Of similarity ``j``, given the sizes and how registers of a compare with those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    return more * np.log(up) + fewer * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def hopeless(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold: float) -> bool:
    """Whether the sizes, or the sketches' joint likelihood, rule the similarity out."""
    top = min(n_a / n_b, n_b / n_a)
    if top < threshold:
        return True
    grid = np.linspace(0.0, top, 65)
    more, fewer = int((a > b).sum()), int((a < b).sum())
    found = log_likelihood(grid, n_a, n_b, more, fewer, len(a) - more - fewer)
    if grid[found.argmax()] >= threshold:
        return False
    at = log_likelihood(np.linspace(threshold, top, 9), n_a, n_b, more, fewer, len(a) - more - fewer)
    return bool(found.max() - at.max() > 25)


def rejected(j_hat: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, fewer: np.ndarray, equal: np.ndarray, threshold: float) -> np.ndarray:
    """``hopeless`` for many pairs, with the share of equal registers in place of the likeliest similarity."""
    top = np.minimum(n_a / n_b, n_b / n_a)
    at = np.minimum(j_hat, top)
    ratio = log_likelihood(at, n_a, n_b, more, fewer, equal) - log_likelihood(np.full(len(at), threshold), n_a, n_b, more, fewer, equal)
    return (top < threshold) | (at < threshold) & (ratio > 25)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``doc_id, n, sum_a, sum_b, bands`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in textscan.chunks(b.column(1)):
                elements, first = shingles(t, width)
                n = np.diff(first)
                has = n > 0
                keys = np.where(has[:, None], bands(sketches(elements, first)), 0).view(np.int64)
                sums = np.zeros((2, len(t)), dtype=np.uint64)
                if len(elements):
                    at = first[:-1][has]
                    sums[0, has] = np.add.reduceat(elements, at)
                    sums[1, has] = np.add.reduceat(textscan.mix(elements ^ _SIDE), at)
                values = pa.array(keys.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * BANDS), values)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(t.rows.start, len(t)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    names=["doc_id", "n", "sum_a", "sum_b", "bands"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, sum_a long, sum_b long, bands array<long>")


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """The texts of the rows of ``wanted`` (by ``id``), which is sent to the executors if it was measured to be small."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(wanted) if small(wanted, broadcast_rows) else wanted.hint("merge"), "id")


def verify(docs: DataFrame, pairs: DataFrame, key: str, text: str, width: int, percent: int, group: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Those ``(a, c)`` of ``pairs`` whose sets are similar; only the texts that are named are moved."""
    heavy = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(group))).cast("int").alias("parts"))
    heavy = materialize(heavy, "dup-centres")
    member = pairs.join(heavy, "c").select(F.col("a").alias("id"), "c", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    centre = heavy.select(F.col("c").alias("id"), "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = materialize(member.unionByName(centre), "dup-wanted")
    rows = _texts(docs, key, text, wanted, broadcast_rows).repartition("c", "part").sortWithinPartitions("c", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for b in batches:
            ids, cs, parts, roles = (b.column(x).to_pylist() for x in ("id", "c", "part", "role"))
            out: list[tuple[int, int]] = []
            for t in textscan.chunks(b.column("text")):
                elements, first = shingles(t, width)
                regs = sketches(elements, first)
                for i in range(len(t)):
                    k = t.rows.start + i
                    mine = elements[first[i] : first[i + 1]]
                    if (cs[k], parts[k]) != at:
                        at, centres = (cs[k], parts[k]), []
                    if not len(mine):
                        continue
                    if roles[k] == 0:
                        if not any(np.array_equal(mine, x) for x, _ in centres):
                            centres.append((mine.copy(), regs[i]))
                        continue
                    for x, r in centres:
                        if hopeless(regs[i], r, len(mine), len(x), percent / 100):
                            continue
                        if linked(mine, x, percent):
                            out.append((ids[k], cs[k]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "c"])

    return rows.mapInArrow(run, "a long, c long")


def _join_group(ids: list[int], comps: list[int], sides: list[int], sets: list[np.ndarray], regs: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links between different components among the texts of one group; with ``cross``, of the two sides only."""
    label = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    root = list(range(len(label)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    comp = np.array([label[c] for c in comps])
    side, size = np.array(sides), np.array([len(x) for x in sets])
    found: list[np.ndarray] = []
    for i in range(len(ids) - 1):
        other = np.arange(i + 1, len(ids))
        other = other[(comp[other] != comp[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
        if cross:
            other = other[side[other] != side[i]]
        same = regs[other] == regs[i]
        near = same.reshape(len(other), BANDS, ROWS).all(axis=2).any(axis=1)
        other, same = other[near], same[near].sum(axis=1)
        if not len(other):
            continue
        more = (regs[other] < regs[i]).sum(axis=1)
        out = rejected(same / REGISTERS, np.full(len(other), size[i]), size[other], more, REGISTERS - same - more, same, percent / 100)
        found.append(np.stack([np.full(len(other), i), other, same], axis=1)[~out])
    links = []
    if found:
        pairs = np.concatenate(found)
        for i, j, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
            a, b = find(comp[i]), find(comp[j])
            if a != b and linked(sets[i], sets[j], percent):
                root[a] = b
                links.append((ids[i], ids[j]))
    return links


def settle(docs: DataFrame, members: DataFrame, key: str, text: str, width: int, percent: int, block_rows: int = 256, block_elements: int = 1 << 19, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Links ``(a, c)`` that join components within clusters; ``members`` has ``rep, n, comp, cluster``.

    A cluster has a block for each ``block_rows`` texts or ``block_elements``
    shingles, and a text goes to as many groups as its cluster has blocks.
    """
    per = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))), F.ceil(F.sum("n") / F.lit(float(block_elements)))).cast("int").alias("blocks"))
    per = materialize(per, "dup-clusters")
    dealt = members.join(per, "cluster").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select(F.col("rep").alias("id"), "comp", "cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    wanted = dealt.select("id", "comp", "cluster", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = _texts(docs, key, text, materialize(wanted, "dup-wanted"), broadcast_rows)
    rows = rows.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, comps, sides, sets, regs = None, [], [], [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                out.extend(_join_group(ids, comps, sides, sets, np.array(regs), at[1] != at[2], percent))

        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("id", "comp", "cluster", "bi", "bj", "side")]
            for t in textscan.chunks(b.column("text")):
                elements, first = shingles(t, width)
                made = sketches(elements, first)
                for i in range(len(t)):
                    one, comp, cluster, bi, bj, side = (c[t.rows.start + i] for c in cols)
                    if (cluster, bi, bj) != at:
                        close()
                        at, ids, comps, sides, sets, regs = (cluster, bi, bj), [], [], [], [], []
                    mine = elements[first[i] : first[i + 1]]
                    if len(mine):
                        for x, v in ((ids, one), (comps, comp), (sides, side), (sets, mine.copy()), (regs, made[i])):
                            x.append(v)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "c"])

    return rows.mapInArrow(run, "a long, c long")


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id that is linked with another (columns ``a, c``): the smallest id that is reachable.

    Each round points every node to its smallest neighbour, shortens the paths,
    and keeps the links between what is left, which shrink by half or more.
    """
    a, c = F.col("a"), F.col("c")
    edges = materialize(links.where(a != c).select(F.greatest(a, c).alias("a"), F.least(a, c).alias("c")).distinct(), "dup-links")
    labels = links.sparkSession.createDataFrame([], "id long, comp long")
    while edges.limit(1).count():
        ends = edges.select(a.alias("id"), c.alias("other")).unionAll(edges.select(c.alias("id"), a.alias("other")))
        low = materialize(ends.groupBy("id").agg(F.least("id", F.min("other")).alias("comp")), "dup-low")
        while True:
            far = low.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
            jumped = materialize(low.join(far, "comp").select("id", F.col("far").alias("comp"), F.col("comp").alias("was")), "dup-low")
            low = jumped.select("id", "comp")
            if jumped.where(F.col("comp") != F.col("was")).limit(1).count() == 0:
                break
        x, y = low.select(F.col("id").alias("a"), F.col("comp").alias("x")), low.select(F.col("id").alias("c"), F.col("comp").alias("y"))
        left = edges.join(x, "a").join(y, "c").where(F.col("x") != F.col("y"))
        edges = materialize(left.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("c")).distinct(), "dup-links")
        onward = low.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        known = labels.join(onward, "comp", "left").select("id", F.coalesce("far", "comp").alias("comp"))
        labels = materialize(known.unionByName(low.join(labels.select("id"), "id", "left_anti")), "dup-labels")
    return labels


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    kind = docs.schema[key].dataType
    rows, names = numbered(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    found = _classes(rows, "doc_id", "text", width, percent)
    return named(named(found, names, "doc_id", kind), names, "component_id", kind)


def _classes(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    signed = materialize(signatures(docs, key, text, width), "dup-signatures")
    sets = signed.where(F.col("n") > 0).groupBy("sum_a", "sum_b", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    sets = materialize(sets, "dup-sets")
    filed = materialize(sets.where(F.col("rep").isNotNull()).select("rep", F.explode("bands").alias("bucket")), "dup-buckets")
    heads = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("c")).where(F.col("k") > 1).select("bucket", "c")
    heads = materialize(heads, "dup-heads")
    # Tables on both sides, so adaptive execution can split a bucket that many texts are in.
    held = materialize(filed.join(heads, "bucket").where(F.col("rep") != F.col("c")), "dup-held")
    comps = None
    pairs = materialize(held.select(F.col("rep").alias("a"), "c").distinct(), "dup-pairs")
    if pairs.limit(1).count():
        links = materialize(verify(docs, pairs, key, text, width, percent), "dup-verified")
        comps = components(links)
        labels = held.select("bucket", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        open_ = materialize(labels.select("bucket", "rep", F.coalesce("comp", "rep").alias("comp")), "dup-open")
        # Every pair with a centre was compared; a bucket whose other members are in one component is done.
        split = open_.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("c")).where(F.col("lo") != F.col("hi")).select("bucket", "c")
        left = materialize(open_.join(materialize(split, "dup-split"), "bucket"), "dup-left")
        near = materialize(left.select(F.col("rep").alias("a"), "c").distinct(), "dup-near")
        if near.limit(1).count():
            clusters = components(near).select(F.col("id").alias("rep"), F.col("comp").alias("cluster"))
            sizes = sets.where(F.col("rep").isNotNull()).groupBy("rep").agg(F.max("n").alias("n"))
            members = left.select("rep", "comp").distinct().join(clusters, "rep").join(sizes, "rep")
            more = settle(docs, materialize(members, "dup-members"), key, text, width, percent)
            comps = components(materialize(links.unionByName(more), "dup-links"))

    named = sets.select(F.col("sum_a").alias("x"), F.col("sum_b").alias("y"), F.col("n").alias("z"), "rep")
    if comps is not None:
        named = named.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    else:
        named = named.withColumn("component_id", F.col("rep"))
    named = materialize(named.select("x", "y", "z", "component_id"), "dup-named")
    # Both sides are tables, so adaptive execution can split a set that a third of the rows have.
    whole = signed.select("doc_id", "n", "sum_a", "sum_b").join(named, (F.col("sum_a") == F.col("x")) & (F.col("sum_b") == F.col("y")) & (F.col("n") == F.col("z")), "left")
    component = F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one for each component.

    Where every id is there once, ids name rows and only the ids that go are
    joined back.  Else rows are numbered in a table first, so repeated ids and
    rows without an id are told apart.
    """
    sizes = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(key)).alias("ids")).first()
    if sizes["n"] == sizes["ids"]:
        gone = deduplicate(docs, key, text, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(key))
        return left_out(docs, materialize(gone, "dup-gone"), [key])
    number = fresh(docs, "row_number")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "dup-rows")
    gone = deduplicate(rows, number, text, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias(number))
    return left_out(rows, materialize(gone, "dup-gone"), [number]).select(*docs.columns)
