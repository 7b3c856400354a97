"""Balance: repartitioning and joins that stand hot keys."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


def rebalance(df: DataFrame, n: int | None = None, *keys: str | Column) -> DataFrame:
    """Partitions of even size: adaptive execution splits large ones and merges small ones.  Rows stay the same."""
    args = ([n] if n else []) + list(keys)
    return df.hint("rebalance", *args) if args else df.hint("rebalance")


def heavy_keys(df: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """``key, n`` of the keys that hold at least ``share`` of the rows: 1 / share keys at most."""
    total = df.count()
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2.0, share * total))


def written(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in shared storage, so a retried task reads what the first one read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes of the cluster share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="sparkloom-"))
    return df.checkpoint()


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16, share: float = 0.001) -> DataFrame:
    """Inner or left join on ``key`` where hot keys of ``left`` are dealt over ``salts`` partitions.

    Which keys are hot is counted; they are at most 1 / share, so they may be
    broadcast.  Their left rows are written first and dealt by their place in
    what was written: equal rows are spread too, and a retried task deals them
    alike.  Only the hot keys' right rows are copied, once for each salt; all
    other rows are joined as they are.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = heavy_keys(left, key, share).select(F.col(key).alias("__hot"))
    hot = F.broadcast(hot.where(F.col("__hot").isNotNull()))
    cold = left.join(hot, left[key] == F.col("__hot"), "left_anti").join(right, key, how)
    place = F.monotonically_increasing_id()
    spread = written(left.join(hot, left[key] == F.col("__hot"), "left_semi")).withColumn("__salt", F.pmod(F.xxhash64(place), F.lit(salts)).cast("int"))
    copies = right.join(hot, right[key] == F.col("__hot"), "left_semi").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cold.unionByName(spread.join(copies, [key, "__salt"], how).drop("__salt"))


def block_join(left: DataFrame, right: DataFrame, on: joins.Key | Sequence[joins.Key], suffixes: tuple[str, str] = ("_l", "_r"), block: int = 1 << 10, task: int = 1 << 22) -> DataFrame:
    """Inner join, with arguments and columns as ``joins.join``, whose pairs may far outnumber the rows.

    Pairs are counted by key first.  If there are more than ``task``, the rows
    of a key are dealt into blocks of about ``block`` by their place in what was
    written (see ``salted_join``), and each block of the left side meets each of
    the right side at a place of its own, in as many tasks as there are
    ``task`` rows and pairs.  A task makes about that many pairs and holds a
    block, however many rows a key has; a row travels once for each block that
    it meets, so pairs / ``block`` rows a side are added.  Counts of keys with
    more than ``block`` rows are broadcast: rows / ``block`` at most.
    """
    on = [on] if isinstance(on, str | tuple) else list(on)
    names = [f"__on{i}" for i in range(len(on))]
    sides, counts = [], []
    for i, df in enumerate((left, right)):
        keys = [k if isinstance(k, str) else k[i] for k in on]
        keyed = df.select("*", *[(F.col(f"`{k}`") if k in df.columns else F.expr(k)).alias(n) for k, n in zip(keys, names, strict=True)])
        for n in names:
            keyed = keyed.where(F.col(n).isNotNull())
        sides.append(keyed)
        counts.append(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias(f"__rows{i}")))
    l, r = (F.coalesce(F.col(f"__rows{i}").cast("double"), F.lit(0.0)) for i in (0, 1))
    total = counts[0].join(counts[1], names, "full").agg(F.sum(l + r + l * r)).first()[0] or 0.0
    if total <= task:
        return joins.join(left, right, on, suffixes=suffixes)
    n = math.ceil(total / task)
    maps = min(n, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = [F.coalesce(F.col(f"__blocks{i}"), F.lit(1)) for i in (0, 1)]
    grid = [*names, "__block0", "__block1"]
    dealt = []
    for i, keyed in enumerate(sides):
        rows = written(keyed.repartition(maps)).withColumn("__place", F.monotonically_increasing_id())
        for j, c in enumerate(counts):
            many = c.where(F.col(f"__rows{j}") > block).withColumn(f"__blocks{j}", F.ceil(F.col(f"__rows{j}") / block).cast("int"))
            rows = rows.join(F.broadcast(many.drop(f"__rows{j}")), names, "left")
        own = F.pmod(F.xxhash64("__place"), blocks[i]).cast("int").alias(f"__block{i}")
        met = F.explode(F.sequence(F.lit(0), blocks[1 - i] - 1)).alias(f"__block{1 - i}")
        dealt.append(rows.select(*[f"`{c}`" for c in keyed.columns], own, met).repartition(n, *grid))
    out = joins.join(*dealt, grid, strategy="sort_merge", suffixes=suffixes)
    return out.drop(*[g + s for g in grid for s in suffixes])
