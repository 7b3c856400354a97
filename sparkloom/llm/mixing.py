"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target: its weight's share of all words, held to
``max_epochs`` times its own size, the excess shared again by weight among the
others until none is above.  A document of a source is then wanted
target / size times.  The whole part of that is taken as it is; the fractional
part is a copy probability, the same for the whole source.

Pivotal rounding turns the probabilities into zeros and ones: two documents
are paired, and mass moves between them at random, its expectation kept, until
one of them is integral; the other goes on to the next pair.  Mass is counted
in words (a document's probability times its size), so a pair's expected words
are kept exactly.

Pairs form a reduction tree.  Documents of one source and one size class (a
power of two) are dealt by a hash into blocks of about ``fan_in``, a block is
folded pair by pair and leaves one document undecided, and these meet in the
next, smaller level until ``fan_in`` of the class are left.  The residuals of
all classes of a source, a bounded number, are combined last: from the longest
document on, each is paired with all shorter ones together, which gain or lose
in proportion, so that only short documents can be left undecided and the
source ends within about a short document of its target.  The number of levels
is the logarithm of the largest class; no block grows with the data, however
large one source is or however often one row is repeated: equal rows are
numbered before they are dealt.  Everything is DataFrame functions.

Random choices come from hashes of ``seed``, the level and the row, so reruns
agree.  Defined results: a null text has size 0 and is never taken; a null
source is a source of its own, last in order; repeated rows are documents of
their own, all kept; an empty table gives an empty result.  Ids may be of any
type that can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SPACED_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between blanks: 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """``source, source_size, target`` of ``source, size`` rows.

    Weights are dealt in order of code point (null last), repeating.  The rows
    are one for each source from here on.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Numbering needs an order over all sources: range partitions are numbered apart, and shifted by the counts before.
    order = [F.col("source").isNull(), F.col("source")]
    per = materialize(per, "mix-sources")
    part = per.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    part = materialize(part, "mix-ranges")
    ahead = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range partition, of which there are at most spark.sql.shuffle.partitions.
    ahead = ahead.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("ahead")
    number = (place % len(weights)).cast("int")
    weighted = part.join(F.broadcast(ahead), "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1))
    table = materialize(weighted.drop("part", "ahead"), "mix-weights")

    # A source is at its limit once limit <= rate * weight, and the rate only rises: the set grows to a fixed point.
    limit = F.col("source_size") * F.lit(float(max_epochs))
    rate = 0.0
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    while True:
        full = limit <= F.lit(rate) * F.col("weight")
        row = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["open"] == 0:
            break
        new = (total - row["held"]) / row["open"]
        if new <= rate * (1 + 1e-12):  # sums may differ in their last bits
            break
        rate = new
    target = F.least(limit, F.lit(rate) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


#: Copies of one row that are numbered together.
COPIES = 4096


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 by hash."""
    return F.xxhash64(*parts).bitwiseAND((1 << 52) - 1).cast("double") / F.lit(float(1 << 52))


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _fold(level: Column, seed: int, doc: str) -> Column:
    """Fold a block's documents: those decided, and the one left over.

    The running document holds words a*p; the next one b*q.  Mass moves either
    way with the chances that keep both expectations.
    """
    start = F.struct(F.lit(None).cast(doc).alias("run"), F.array().cast(f"array<{doc}>").alias("done"))

    def with_(x: Column, p: Column, one: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), p.alias("p"), one.cast("int").alias("one"))

    def decided(x: Column, one: int) -> Column:
        return with_(x, x["p"], F.lit(one))

    def running(x: Column, p: Column) -> Column:
        return with_(x, _clip(p), F.lit(None))

    def step(acc: Column, x: Column) -> Column:
        r = acc["run"]
        a, b = r["size"].cast("double"), x["size"].cast("double")
        p, q = r["p"], x["p"]
        up = F.least(a * (F.lit(1.0) - p), b * q)  # words that r can gain from x
        down = F.least(a * p, b * (F.lit(1.0) - q))  # words that r can give to x
        gain = _uniform(F.lit(seed), level, r["h"], x["h"]) * (up + down) < down  # chance down / (up + down), so the expected move is 0
        # Who ends integral, and as what, follows from which of the two limits the move met.
        r_full, x_none = a * (F.lit(1.0) - p) <= b * q, a * (F.lit(1.0) - p) > b * q
        r_none, x_full = a * p <= b * (F.lit(1.0) - q), a * p > b * (F.lit(1.0) - q)
        out = F.when(gain & r_full, F.struct(running(x, q - up / b).alias("run"), decided(r, 1).alias("d")))
        out = out.when(gain & x_none, F.struct(running(r, p + up / a).alias("run"), decided(x, 0).alias("d")))
        out = out.when(~gain & r_none, F.struct(running(x, q + down / b).alias("run"), decided(r, 0).alias("d")))
        out = out.when(~gain & x_full, F.struct(running(r, p - down / a).alias("run"), decided(x, 1).alias("d")))
        return F.when(r.isNull(), F.struct(x.alias("run"), acc["done"].alias("done"))).otherwise(
            F.struct(out["run"].alias("run"), F.concat(acc["done"], F.array(out["d"])).alias("done"))
        )

    return F.aggregate(F.col("block"), start, step)


def _settle(seed: int, doc: str) -> Column:
    """A source's residuals ``block``, the longest first, as ``list<struct<x, one>>``: zeros and ones.

    Documents of one class are folded pair by pair.  The one that a class
    leaves moves mass from or to all that follow together, in proportion, until
    it is integral.  What happens to the probabilities q of all that follow is
    one line, ``slope`` * q + ``lift``; ``size`` and ``mass`` are their sums of
    sizes and of sizes times first probabilities.
    """
    double = lambda x: F.lit(x).cast("double")
    total = F.aggregate("block", double(0.0), lambda acc, x: acc + x["size"])
    mass = F.aggregate("block", double(0.0), lambda acc, x: acc + x["size"] * x["p"])
    none = F.lit(None).cast(doc)
    decided = f"array<struct<x:{doc},one:int>>"
    start = F.struct(
        double(1.0).alias("slope"), double(0.0).alias("lift"), total.alias("size"), mass.alias("mass"),
        none.alias("run"), double(0.0).alias("p"), F.array().cast(decided).alias("done"),
    )

    def integral(x: Column, p: Column) -> Column:
        """Where nothing could balance it, chance decides; 1e-9 is what the sums lose in their last bits."""
        one = F.when(p >= 1 - 1e-9, F.lit(1)).when(p <= 1e-9, F.lit(0)).otherwise((_uniform(F.lit(seed), F.lit("last"), x["h"]) < p).cast("int"))
        return F.struct(x.alias("x"), one.alias("one"))

    def step(acc: Column, x: Column) -> Column:
        r, p = acc["run"], acc["p"]
        a, b = r["size"].cast("double"), x["size"].cast("double")
        q = _clip(acc["slope"] * x["p"] + acc["lift"])
        rest, rest_mass = F.greatest(acc["size"] - b, double(0.0)), F.greatest(acc["mass"] - b * x["p"], double(0.0))
        u = _uniform(F.lit(seed), F.lit("settle"), r["h"], x["h"])

        def state(slope, lift, run, p, done) -> Column:
            return F.struct(slope.alias("slope"), lift.alias("lift"), rest.alias("size"), rest_mass.alias("mass"), run.alias("run"), _clip(p).alias("p"), done.alias("done"))

        # Of one class: mass moves between the two.
        up, down = F.least(a * (1 - p), b * q), F.least(a * p, b * (1 - q))
        gain = u * (up + down) < down
        p2 = F.when(gain, p + up / a).otherwise(p - down / a)
        q2 = F.when(gain, q - up / b).otherwise(q + down / b)
        ends = F.when(gain, a * (1 - p) <= b * q).otherwise(a * p <= b * (1 - q))  # the running one is integral
        pair = F.when(ends, state(acc["slope"], acc["lift"], x, q2, F.concat(acc["done"], F.array(integral(r, F.round(p2)))))).otherwise(
            state(acc["slope"], acc["lift"], r, p2, F.concat(acc["done"], F.array(integral(x, F.round(q2)))))
        )
        # Of a shorter class: the running one is settled with all that follow.
        held = F.greatest(double(0.0), F.least(acc["size"], acc["slope"] * acc["mass"] + acc["lift"] * acc["size"]))
        room = acc["size"] - held
        up, down = F.least(a * (1 - p), held), F.least(a * p, room)
        gain = u * (up + down) < down
        f = F.when(gain & (held > 0), 1 - up / F.when(held > 0, held)).otherwise(F.lit(1.0))
        s = F.when(~gain & (room > 0), down / F.when(room > 0, room)).otherwise(F.lit(0.0))
        slope, lift = acc["slope"] * f * (1 - s), acc["lift"] * f * (1 - s) + s
        settled = integral(r, F.when(gain, p + up / a).otherwise(p - down / a))
        on = state(slope, lift, x, slope * x["p"] + lift, F.concat(acc["done"], F.array(settled)))
        same = F.floor(F.log2(r["size"])) == F.floor(F.log2(x["size"]))
        return F.when(r.isNull(), state(acc["slope"], acc["lift"], x, q, acc["done"])).when(same, pair).otherwise(on)

    return F.aggregate("block", start, step, lambda acc: F.concat(acc["done"], F.array(integral(acc["run"], acc["p"]))))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows that are equal get numbers ``copy`` from 0; those of one row are made in many tasks if they are many."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "mix-rows")
    once = counted.where(F.col("n") == 1).select(*cols, F.lit(0).cast("long").alias("copy"))
    parts = counted.where(F.col("n") > 1).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    parts = parts.repartition("doc_id", "tag", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    return once.unionAll(parts.select(*cols, F.explode(F.sequence(F.col("part") * COPIES, last)).alias("copy")))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    fan_in: int = 32,
    seed: int = 20240917,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` for every row of ``docs``."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        word_count(F.col(text)).alias("size"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"),
    )
    sizes = materialize(rows, "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)

    # Everything that a row needs of its source: one row for each source, joined by hash of the source, or sent whole
    # where the planner finds it small; a hot source is split by adaptive execution, since nothing above groups by it.
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(F.lit(0.0))
    # Differences below a millionth of a word come from rounding in the shares.
    whole = F.floor(wanted + F.lit(1e-9))
    t = targets.select(F.col("source").alias("s"), F.greatest(wanted - whole, F.lit(0.0)).alias("p"))
    joined = sizes.join(t, sizes["source"].eqNullSafe(t["s"]), "inner").drop("s")
    joined = materialize(joined, "mix-wanted")

    cols = ["source", "doc_id", "size"]
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    decided = joined.where(~fractional).select(*cols, F.lit(0).alias("one"))
    numbered = _numbered(joined.where(fractional)).withColumn("class", F.floor(F.log2("size")).cast("int"))
    doc = f"struct<h:bigint,doc_id:{docs.schema[key].dataType.simpleString()},size:bigint,p:double,one:int>"
    x = F.struct(F.xxhash64(F.lit(seed), "doc_id", "tag", "copy").alias("h"), "doc_id", "size", "p", F.lit(None).cast("int").alias("one")).cast(doc)
    numbered = materialize(numbered.select("source", "class", x.alias("x")), "mix-numbered")
    many = materialize(numbered.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    most = many.agg(F.max("n")).first()[0] or 0
    other = many.select(F.col("source").alias("s"), F.col("class").alias("c"), "n")
    open_ = numbered.join(other, numbered["source"].eqNullSafe(other["s"]) & (numbered["class"] == other["c"]), "inner").select("source", "class", "x", "n")

    level, ready = 0, None
    while True:
        few = open_.where(F.col("n") <= fan_in).select("source", "x")
        ready = few if ready is None else ready.unionAll(few)
        if most <= fan_in:
            break
        up = F.ceil(F.col("n") / F.lit(float(fan_in)))
        dealt = open_.where(F.col("n") > fan_in).select("source", "class", "x", F.pmod(F.xxhash64(F.lit(level), "x.h"), up).alias("b"), up.alias("n"))
        blocks = dealt.groupBy("source", "class", "b").agg(F.sort_array(F.collect_list("x")).alias("block"), F.max("n").alias("n"))
        folded = materialize(blocks.select("source", "class", "n", _fold(F.lit(level), seed, doc).alias("f")), f"mix-level{level}")
        done = folded.select("source", F.explode("f.done").alias("x"))
        decided = decided.unionAll(done.select("source", "x.doc_id", "x.size", "x.one"))
        open_ = folded.select("source", "class", F.col("f.run").alias("x"), "n")
        most = -(-most // fan_in)
        level += 1
    # At most fan_in documents of each power of two are left of a source.
    key_ = F.struct((-F.col("x.size")).alias("order"), F.col("x.h").alias("h"), F.col("x").alias("x"))
    left = ready.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(key_)), lambda k: k["x"]).alias("block"))
    settled = materialize(left.select("source", _settle(seed, doc).alias("ones")), "mix-settled")
    settled = settled.select("source", F.explode("ones").alias("z"))
    decided = decided.unionAll(settled.select("source", "z.x.doc_id", "z.x.size", "z.one"))

    back = targets.select(F.col("source").alias("s"), "source_size", "target", whole.cast("long").alias("whole"))
    out = decided.join(back, decided["source"].eqNullSafe(back["s"]), "inner")
    copies = F.col("whole") + F.col("one")
    return out.select(
        "doc_id", "size", "source", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )
