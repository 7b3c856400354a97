"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of ``books``
full-dimensional codebooks.  The books start from k-means on residuals and are
then fitted jointly by least squares, encoding anew in between; they are
learned from at most ``sample`` vectors (in order of a hash of the id).  Every
vector of the table is then indexed: a beam search keeps the ``beam`` best
partial sums while going through the books, and the code is stored with the
squared norm of its sum.

A query's inner products with all codewords are its lookup table; with the
stored norm, the sum of one entry for each book gives the approximate distance
to any indexed vector.  Queries and codes are dealt into blocks by hashes;
each pair of blocks is one task's group of bounded size.  Only codes and norms
are copied to the blocks of queries, no vectors.  Over all blocks the
``shortlist`` approximately nearest of each query go on, and these alone are
measured exactly on the original vectors, which are joined by id.  Recall
depends on the shortlist, which is ``pool`` vectors, or ``share`` of a table in
which that would be more (``least`` at least).

Equal vectors are indexed once, with their ``k`` + 1 smallest ids: no other of
them can be among a query's nearest, since ties go to the smaller id.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another dimension than most, take no part, nor do rows
without an id; rows that repeat an id are one candidate, since a result names
ids only, with the smallest vector; ties go to the smaller id; fewer candidates
than ``k`` are all returned; an empty table gives an empty result.  Ids may be
of any type that can be sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize, named, numbered


#: Codes that are scored at once; the best so far go on to the next ones of the block.
SCAN = 16384


@dataclass
class Codebooks:
    words: np.ndarray  # [books, size, dimension]

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of their sums."""
        books, size, _ = self.words.shape
        n, rows = len(x), np.arange(len(x))[:, None]
        words = self.words.astype(np.float32)
        norms = (words * words).sum(-1)
        rest = x.astype(np.float32)[:, None, :]
        left = (rest * rest).sum(-1)  # squared lengths of what is left
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for m in range(books):
            wide = (left[:, :, None] - 2 * (rest @ words[m].T) + norms[m]).reshape(n, -1)
            keep = min(beam, wide.shape[1])
            best = np.argpartition(wide, keep - 1, axis=1)[:, :keep]
            b, k = best // size, best % size
            rest, left = rest[rows, b] - words[m][k], wide[rows, best]
            codes = np.concatenate([codes[rows, b], k[:, :, None].astype(np.uint8)], axis=2)
        codes = codes[np.arange(n), left.argmin(axis=1)]
        total = np.zeros((n, self.words.shape[2]))
        for m in range(books):
            total += self.words[m][codes[:, m]]
        return codes, (total * total).sum(-1)


def _kmeans(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(-1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=size)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, books: int = 32, size: int = 64, rounds: int = 2, beam: int = 4, seed: int = 11) -> Codebooks:
    rng = np.random.default_rng(seed)
    rest = x.copy()
    words = np.zeros((books, size, x.shape[1]))
    for m in range(books):
        words[m] = _kmeans(rest, size, rng)
        rest -= words[m][((words[m] ** 2).sum(-1) - 2 * rest @ words[m].T).argmin(axis=1)]
    made = Codebooks(words)
    offsets = np.arange(books) * size
    for _ in range(rounds):
        codes, _ = made.encode(x, beam)
        at = codes + offsets
        gram, right = np.zeros((books * size, books * size)), np.zeros((books * size, x.shape[1]))
        for m in range(books):
            np.add.at(right, at[:, m], x)
            for j in range(books):
                np.add.at(gram, (at[:, m], at[:, j]), 1.0)
        gram[np.diag_indices_from(gram)] += 1e-3 * max(1.0, len(x) / size)
        # The ridge draws towards the present words, so that an unused word stays as it is.
        right += 1e-3 * max(1.0, len(x) / size) * made.words.reshape(books * size, -1)
        made = Codebooks(np.linalg.solve(gram, right).reshape(words.shape))
    return made


def valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))) & F.exists(vector, lambda v: v != 0)


def prepare(vectors: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """``id, v, query``: what takes part, one row an id."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("query", F.coalesce(is_query, F.lit(False))), "ann-rows")
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """``id, v, ids``: each vector once, with the ``k`` + 1 smallest ids that have it."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.select("id", "v", place.alias("place")).where(F.col("place") <= k + 1)
    return materialize(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"), "ann-distinct")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def index(rows: DataFrame, sample: int = 8192, books: int = 32, size: int = 64, beam: int = 4) -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks, and the table ``id, code, norm`` of every row of ``id, v``."""
    got = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not len(got):
        return None, None
    made = fit(_matrix(got["v"]), books, size, beam=beam)
    spread = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                codes, norms = spread.value.encode(_matrix(part.column(1)), beam)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["id", "code", "norm"])

    return made, materialize(rows.select("id", "v").mapInArrow(run, "id long, code binary, norm double"), "ann-index")


def shortlist(rows: int, pool: int, share: float, least: int) -> int:
    """How many vectors are measured exactly for a query."""
    return max(least, min(pool, math.ceil(share * rows)))


def search(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    pool: int = 512,
    share: float = 0.02,
    least: int = 40,
    row_block: int = 1 << 18,
    query_block: int = 2048,
    **options,
) -> DataFrame:
    """``query_id, rank, id, score`` of the rows that ``is_query`` (a condition on ``id``) names, against all others."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType
    rows, names = numbered(prepare(vectors, key, vector, is_query), "id")
    table = distinct(rows, k)
    made, codes = index(table, **options)
    if made is None:
        empty = [T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())]
        return spark.createDataFrame([], T.StructType(empty))
    queries = rows.where("query").select(F.col("id").cast("long").alias("id"), "v")
    size = codes.count()
    # Itself may be among the nearest, so one more goes on.
    taken = shortlist(size, pool, share, least) + 1
    row_blocks, query_blocks = max(1, -(-size // row_block)), max(1, -(-queries.count() // query_block))
    spread = spark.sparkContext.broadcast(made)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).alias("qb")).select("*", numbers(row_blocks).alias("rb"))
    right = codes.select("id", "code", "norm", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(row_blocks)).alias("rb")).select("*", numbers(query_blocks).alias("qb"))

    def pairs(q: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(r):
            words = spread.value.words
            ids, norm = np.asarray(r["id"]), np.asarray(r["norm"], dtype=np.float32)
            codes = np.frombuffer(b"".join(r["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            own, y = np.asarray(q["id"]), _matrix(q["v"])
            for lo in range(0, len(own), 64):
                part, mine = y[lo : lo + 64], own[lo : lo + 64]
                tables = [(-2 * w @ part.T).astype(np.float32) for w in words]
                value, place = np.zeros((0, len(part)), np.float32), np.zeros((0, len(part)), np.int64)
                for a in range(0, len(ids), SCAN):
                    near = np.repeat(norm[a : a + SCAN, None], len(part), axis=1)
                    for m, t in enumerate(tables):
                        near += np.take(t, codes[a : a + SCAN, m], axis=0)
                    rows = np.repeat(np.arange(a, a + len(near))[:, None], len(part), axis=1)
                    value, place = np.concatenate([value, near]), np.concatenate([place, rows])
                    if len(value) > taken:
                        best = np.argpartition(value, taken - 1, axis=0)[:taken]
                        value, place = np.take_along_axis(value, best, axis=0), np.take_along_axis(place, best, axis=0)
                found.append((np.repeat(mine, len(value)), ids[place.T.ravel()], value.T.ravel().astype(float)))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, float))]
        return pa.table({"query_id": cols[0], "id": cols[1], "near": cols[2]})

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(pairs, "query_id long, id long, near double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))
    chosen = materialize(near.withColumn("place", place).where(F.col("place") <= taken).select("query_id", "id"), "ann-shortlist")
    # Exact distances: a shortlisted id meets its vector, and the two their query.
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("asked"))
    both = chosen.join(table, "id").join(asked, "query_id")
    squares = F.aggregate(F.zip_with("v", "asked", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)
    exact = both.select("query_id", F.sqrt(squares).alias("score"), F.explode("ids").alias("id")).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    out = exact.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return named(named(out, names, "query_id", kind), names, "id", kind).select("query_id", "rank", "id", "score")
