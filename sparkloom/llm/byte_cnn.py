"""Quality classifier: a byte-level convolutional network in numpy.

Each filter looks at ``width`` successive bytes; its response is the sum of
one learned weight for each (place, byte), which is a byte embedding followed
by a convolution, folded into one table.  The whole document is covered by
overlapping chunks (two neighbouring blocks of ``block`` bytes, moving on by
one block).  A filter's largest response within a chunk is the chunk's
feature, a layer of hidden units reads the chunk's features, each unit is
max-pooled over all chunks, and a logistic unit combines them into one
probability.

The network is fitted on a bounded sample of labelled rows: at most
``per_class`` rows of either label, in order of a hash of the key, so reruns
take the same rows.  Of a text of more than ``train_chars`` characters pieces
are taken, at places that follow from a hash, as many as make up that length;
so any labelled row may be drawn, and the driver holds a bounded number of
bytes.  Scoring reads every byte of every text; a long one goes through in
pieces, whose maxima merge.

Defined results: a null or empty text is one blank chunk and gets the score of
that; without labelled rows of both classes every score is the share of 1
among the labels, or 0.5 without any.  Rows are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .frames import annotate

#: Positions whose responses are held at once when scoring.
SLICE_BLOCKS = 512
#: Blocks of a long text that are laid out at once.
PIECE_BLOCKS = 1 << 14


@dataclass
class ByteCNN:
    table: np.ndarray  # [width, 256, filters]
    bias: np.ndarray  # [filters]
    hidden: np.ndarray  # [filters, units]
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    block: int

    def layout(self, t: textscan.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The texts in blocks, and each text's first block.

        A filter ends at its position.  At least width - 1 zero bytes stand
        before and after each text, so no filter sees two texts.
        """
        lengths, more = np.diff(t.offsets), len(self.table) - 1
        blocks = np.maximum(1, -(-(lengths + more) // self.block))
        first = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.zeros(first[-1] * self.block + more, dtype=np.uint8)
        shift = np.repeat(first[:-1] * self.block + more - t.offsets[:-1], lengths)
        flat[np.arange(len(t.data)) + shift] = t.data
        return flat, first

    def block_features(self, flat: np.ndarray, blocks: int) -> np.ndarray:
        """Largest response of each filter among the positions of each block."""
        filters = self.table.shape[2]
        out = np.empty((blocks, filters), dtype=np.float32)
        for a in range(0, blocks, SLICE_BLOCKS):
            b = min(blocks, a + SLICE_BLOCKS)
            lo, n = a * self.block, (b - a) * self.block
            total = np.take(self.table[0], flat[lo : lo + n], axis=0)
            for j in range(1, len(self.table)):
                total += np.take(self.table[j], flat[lo + j : lo + j + n], axis=0)
            out[a:b] = total.reshape(b - a, self.block, filters).max(axis=1)
        return out

    def chunk_features(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A chunk for each block: it and the next one of the same text."""
        nxt = np.minimum(np.arange(len(feats)) + 1, np.repeat(first[1:] - 1, np.diff(first)))
        return np.maximum(np.maximum(feats, feats[nxt]) + self.bias, 0)

    def pooled(self, t: textscan.Texts) -> np.ndarray:
        """Largest response of each unit over all chunks of each text."""
        flat, first = self.layout(t)
        chunks = self.chunk_features(self.block_features(flat, first[-1]), first)
        return np.maximum.reduceat(np.maximum(chunks @ self.hidden + self.hidden_bias, 0), first[:-1], axis=0)

    def pooled_by_pieces(self, data: np.ndarray) -> np.ndarray:
        """The same of one text, ``PIECE_BLOCKS`` blocks and the next one at a time."""
        more = len(self.table) - 1
        blocks = max(1, -(-(len(data) + more) // self.block))
        best = None
        for a in range(0, blocks, PIECE_BLOCKS):
            b = min(blocks, a + PIECE_BLOCKS + 1)  # the last block is the first of the next piece
            lo, n = a * self.block - more, (b - a) * self.block + more
            flat = np.zeros(n, dtype=np.uint8)
            part = data[max(lo, 0) : lo + n]
            flat[max(-lo, 0) : max(-lo, 0) + len(part)] = part
            chunks = self.chunk_features(self.block_features(flat, b - a), np.array([0, b - a]))
            if b < blocks:
                chunks = chunks[:-1]  # it belongs to the next piece, with the block after it
            units = np.maximum(chunks @ self.hidden + self.hidden_bias, 0).max(axis=0)
            best = units if best is None else np.maximum(best, units)
        return best[None, :]

    def scores(self, t: textscan.Texts) -> np.ndarray:
        pooled = self.pooled_by_pieces(t.data) if len(t) == 1 and len(t.data) > PIECE_BLOCKS * self.block else self.pooled(t)
        return 1 / (1 + np.exp(-np.clip((pooled @ self.out).astype(np.float64) + self.out_bias, -30, 30)))


def fit(
    texts: list[bytes],
    labels: np.ndarray,
    width: int = 6,
    filters: int = 16,
    units: int = 16,
    block: int = 64,
    epochs: int = 24,
    min_steps: int = 600,
    batch: int = 64,
    rate: float = 0.01,
    seed: int = 7,
) -> ByteCNN:
    """Adam on the mean log loss, classes weighted alike; gradients flow through the maxima only."""
    rng = np.random.default_rng(seed)
    # A random byte embedding that keeps letters, digits, blanks and marks apart is where training starts.
    kind = np.zeros((256, 8))
    kind[:, :6] = rng.normal(0, 0.5, (256, 6))
    kind[97:123, 6], kind[65:91, 7] = 1, 1
    kernel = rng.normal(0, 0.35, (width, 8, filters))
    m = ByteCNN(
        np.einsum("be,wef->wbf", kind, kernel).astype(np.float32), np.zeros(filters, np.float32),
        rng.normal(0, 0.35, (filters, units)).astype(np.float32), np.zeros(units, np.float32),
        rng.normal(0, 0.35, units).astype(np.float32), 0.0, block,
    )
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    bias = np.zeros(1, np.float32)
    params = [m.table, m.bias, m.hidden, m.hidden_bias, m.out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    epochs = max(epochs, -(-min_steps // -(-len(texts) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])])
            t = textscan.Texts(np.frombuffer(b"".join(texts[i] for i in ids), np.uint8), offsets, slice(0, len(ids)))
            flat, first = m.layout(t)
            feats = m.block_features(flat, first[-1])
            chunks = m.chunk_features(feats, first)
            raw = chunks @ m.hidden + m.hidden_bias
            act = np.maximum(raw, 0)
            pooled = np.maximum.reduceat(act, first[:-1], axis=0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + bias[0], -30, 30)))
            g = ((p - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
            # Which chunk gave each document's maximum of each unit.
            owner = np.repeat(np.arange(len(ids)), np.diff(first))
            d, c, u = np.empty((len(ids), units), int), None, None
            for i in range(len(ids)):
                d[i] = first[i] + act[first[i] : first[i + 1]].argmax(axis=0)
            gp = g[:, None] * m.out[None, :] * (pooled > 0)
            i, u = np.nonzero(gp)
            c, gu = d[i, u], gp[i, u]
            grad_hidden = np.zeros_like(m.hidden)
            np.add.at(grad_hidden.T, u, chunks[c] * gu[:, None])
            gf = gu[:, None] * m.hidden.T[u] * (chunks[c] > 0)  # [selected, filters]
            # The position in the chunk that gave each filter's maximum.
            last = first[owner[c] + 1] - 1
            start = np.where(feats[c] >= feats[np.minimum(c + 1, last)], c[:, None], np.minimum(c + 1, last)[:, None])
            k, f = np.nonzero(gf)
            base, gk = start[k, f] * block, gf[k, f]
            key, inverse = np.unique(base * filters + f, return_inverse=True)
            gk = np.bincount(inverse, gk, len(key)).astype(np.float32)
            base, f = key // filters, key % filters
            span = base[:, None] + np.arange(block)[None, :]
            resp = sum(m.table[j][flat[span + j], f[:, None]] for j in range(width))
            at = base + resp.argmax(axis=1)
            grad_table = np.zeros_like(m.table)
            for j in range(width):
                np.add.at(grad_table[j], (flat[at + j], f), gk)
            grads = [
                grad_table, np.bincount(f, gk, filters).astype(np.float32), grad_hidden,
                np.bincount(u, gu, units).astype(np.float32), pooled.T @ g, np.array([g.sum()], np.float32),
            ]
            step += 1
            lr = rate * min(1.0, 2 * (1 - epoch / epochs) + 0.1)
            for q, gr, (a, b) in zip(params, grads, moments, strict=True):
                a += 0.1 * (gr - a)
                b += 0.01 * (gr * gr - b)
                q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    m.out_bias = float(bias[0])
    return m


def constant(share: float) -> ByteCNN:
    """A network that gives every text the same probability."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return ByteCNN(
        np.zeros((1, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32),
        np.zeros(1, np.float32), np.zeros(1, np.float32), float(np.log(share / (1 - share))), 64,
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, per_class: int, chars: int, piece: int = 512
) -> list[tuple[bytes, int]]:
    """At most ``per_class`` rows of each label, in order of a hash of the key; repeated labels count once."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).where(train).dropDuplicates(["k", "y"])
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # At most 2 * per_class narrow rows are sent to the executors, and their texts come back.
    # No more rows come back than were sent, though keys may repeat.
    got = rows.join(F.broadcast(picked), "k").select(F.xxhash64("k", "t").alias("h"), "k", "t", "y")
    # Zero bytes keep the pieces apart, as the network has them before and after a text.
    numbers = F.sequence(F.lit(0), F.lit(max(chars // piece, 1) - 1))
    pieces = F.transform(numbers, lambda i: F.substring("t", (F.pmod(F.xxhash64("h", i), F.length("t") - piece) + 1).cast("int"), F.lit(piece)))
    cut = F.when(F.length("t") <= chars, F.col("t")).otherwise(F.array_join(pieces, "\0" * 16))
    got = got.orderBy("h", "k", "t", "y").limit(2 * per_class).select(cut.alias("t"), "y").toArrow()
    return [(t.encode(), y) for t, y in zip(got["t"].to_pylist(), got["y"].to_pylist(), strict=True)]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = 2000,
    train_chars: int = 6144,
    **options,
) -> ByteCNN:
    """Fit on the sample; ``train`` is a condition on the key, named ``k``."""
    rows = labelled_sample(docs, labels, key, text, label, train, per_class, train_chars)
    y = np.array([r[1] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    return fit([r[0] for r in rows], y, **options)


def score(docs: DataFrame, model: ByteCNN, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = [c for c in docs.columns if c.lower() != name.lower()].index(text)

    def run(batch: pa.RecordBatch) -> list:
        parts = [spread.value.scores(t) for t in textscan.chunks(batch.column(at))]
        return [np.concatenate(parts) if parts else np.zeros(0)]

    return annotate(docs, T.StructType([T.StructField(name, T.DoubleType())]), run)
