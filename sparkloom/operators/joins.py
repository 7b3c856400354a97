"""Equi-joins: eight types, residual predicates, null-safe keys, chosen strategies.

``left_semi``/``left_anti`` give left rows and ``right_semi``/``right_anti``
right rows; the latter two are the former with the sides swapped.  A null key
matches nothing unless ``null_safe``.  A residual predicate is part of the join
condition: a pair that fails it counts as unmatched, it is not filtered out
afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import introspect

JOIN_TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti", "right_semi", "right_anti")
#: Strategy, its hint, and the physical node that the hint asks for.
STRATEGIES = {
    "auto": (None, None),
    "shuffle_hash": ("shuffle_hash", "ShuffledHashJoin"),
    "broadcast": ("broadcast", "BroadcastHashJoin"),
    "sort_merge": ("merge", "SortMergeJoin"),
    "nested_loop": ("shuffle_replicate_nl", "CartesianProduct"),
}


class StrategyNotHonoured(RuntimeError):
    """The planner chose another join than the one asked for."""


Key = str | tuple[str, str]


def _condition(l: DataFrame, r: DataFrame, on: Key | Sequence[Key], null_safe: bool) -> tuple[DataFrame, DataFrame, list[Column], list[str]]:
    """Both sides with a column for each key that is an expression, and the equalities."""
    pairs = [(k, k) if isinstance(k, str) else k for k in ([on] if isinstance(on, str | tuple) else on)]
    terms, extra = [], []
    for i, (a, b) in enumerate(pairs):
        names = []
        for side, key in ((0, a), (1, b)):
            df = (l, r)[side]
            if key not in df.columns:
                name = f"__key{i}_{side}"
                df = df.withColumn(name, F.expr(key))
                l, r = (df, r) if side == 0 else (l, df)
                extra.append(name)
                key = name
            names.append(key)
        x, y = F.col(f"l.`{names[0]}`"), F.col(f"r.`{names[1]}`")
        terms.append(x.eqNullSafe(y) if null_safe else x == y)
    return l, r, terms, extra


def join(
    left: DataFrame,
    right: DataFrame,
    on: Key | Sequence[Key],
    how: str = "inner",
    residual: str | None = None,
    null_safe: bool = False,
    strategy: str = "auto",
    strict: bool = False,
    build: str = "right",
    suffixes: tuple[str, str] = ("_l", "_r"),
) -> DataFrame:
    """Join on equal keys.

    ``on``: column names that both sides have, or pairs of names or SQL
    expressions for the left and the right side.  ``residual``: SQL over
    ``l.column`` and ``r.column``.  ``strategy`` is asked for by a hint on the
    ``build`` side; with ``strict``, StrategyNotHonoured is raised where the
    planner ignores it.  Columns that both sides have get the suffixes.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {', '.join(JOIN_TYPES)}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if build not in ("left", "right"):
        raise ValueError("build must be left or right")
    l, r, terms, extra = _condition(left, right, on, null_safe)
    if not terms:
        raise ValueError("an equi-join needs a key; see theta_join")
    if residual:
        terms.append(F.expr(residual))
    hint, node = STRATEGIES[strategy]
    if hint:
        l, r = (l.hint(hint), r) if build == "left" else (l, r.hint(hint))
    a, b = l.alias("l"), r.alias("r")
    condition = reduce(lambda x, y: x & y, terms)
    if how in ("right_semi", "right_anti"):
        out = b.join(a, condition, how.replace("right", "left")).select(*[F.col(f"r.`{c}`") for c in right.columns])
    elif how in ("left_semi", "left_anti"):
        out = a.join(b, condition, how).select(*[F.col(f"l.`{c}`") for c in left.columns])
    else:
        both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
        named = [F.col(f"l.`{c}`").alias(c + suffixes[0] if c.lower() in both else c) for c in left.columns]
        named += [F.col(f"r.`{c}`").alias(c + suffixes[1] if c.lower() in both else c) for c in right.columns]
        out = a.join(b, condition, how).select(*named)
    if strict and node:
        found = introspect.joins(out, initial=True)
        swapped = how in ("right_semi", "right_anti")
        side = {"left": "right", "right": "left"}[build] if swapped else build
        if not found or found[0].node != node or found[0].build not in (None, side):
            got = f"{found[0].node}, build side {found[0].build}" if found else "no join"
            raise StrategyNotHonoured(f"{strategy} ({build} side) was asked for a {how} join; the plan has {got}")
    return out


def theta_join(left: DataFrame, right: DataFrame, condition: str, how: str = "inner", suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """A join on any condition over ``l.column`` and ``r.column``; without an equality Spark runs a nested loop."""
    a, b = left.alias("l"), right.alias("r")
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    named = [F.col(f"l.`{c}`").alias(c + suffixes[0] if c.lower() in both else c) for c in left.columns]
    named += [F.col(f"r.`{c}`").alias(c + suffixes[1] if c.lower() in both else c) for c in right.columns]
    return a.join(b, F.expr(condition), how).select(*named)


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key ...)``: nothing if a right key is null, and no null left key unless right is empty.

    An anti join on the key, for which the planner may broadcast, hash or sort
    as the sides' sizes suggest; what nulls and an empty right side mean comes
    from one row of counts, the only thing that is always broadcast.
    """
    keys = right.select(F.col(right_key).alias("__in"))
    counts = keys.agg(F.count(F.lit(1)).alias("__rows"), F.count("__in").alias("__keys"))
    l, r = left.alias("l"), keys.where(F.col("__in").isNotNull()).alias("r")
    key = F.col(f"l.`{left_key}`")
    kept = l.join(r, key == F.col("r.__in"), "left_anti").crossJoin(F.broadcast(counts))
    holds = (F.col("__rows") == 0) | (key.isNotNull() & (F.col("__keys") == F.col("__rows")))
    return kept.where(holds).select(*[F.col(f"l.`{c}`") for c in left.columns])


def chain(base: DataFrame, others: Sequence[tuple[DataFrame, Key | Sequence[Key]]], how: str = "inner", strategy: str = "auto") -> DataFrame:
    """Left-deep joins of ``base`` with each of ``others`` in turn; the build sides are the others."""
    out = base
    for i, (other, on) in enumerate(others):
        out = join(out, other, on, how, strategy=strategy, suffixes=("", f"_{i + 1}"))
    return out


def pair_counts(tables: Sequence[tuple[DataFrame, str]], key: str, pairs: str) -> DataFrame:
    """``key, pairs``: how many rows the inner join of all tables on one key has for each key, without making them.

    ``tables``: each with its column that is the key; the first one's type counts.
    Rows are counted by key in each table, the counts are joined and multiplied.
    """
    out = None
    for i, (df, column) in enumerate(tables):
        n = df.groupBy(F.col(f"`{column}`").alias(f"__key{i}")).agg(F.count(F.lit(1)).alias(f"__n{i}"))
        out = n if out is None else join(out, n, ("__key0", f"__key{i}"))
    if out is None:
        raise ValueError("pair_counts needs a table")
    out = out.where(F.col("__key0").isNotNull())
    return out.select(F.col("__key0").alias(key), reduce(lambda x, y: x * y, [F.col(f"__n{i}") for i in range(len(tables))]).alias(pairs))


def explain_join(df: DataFrame) -> list[tuple[str, str, str | None]]:
    return [(j.node, j.join_type, j.build) for j in introspect.joins(df)]
