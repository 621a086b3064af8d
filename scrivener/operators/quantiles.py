"""Exact quantiles of groups of any size.

``percentile`` holds the values of a group in one task. Here equal values are counted
first; then each round cuts the range that holds a wanted rank into bins and counts them,
until the ranges hold few distinct values, which are ranked. A round is one aggregate over
the counts, and no task ever holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.sources.scratch import stored

#: Bins of a range, distinct values of a range that are ranked in one task, and rounds after which they are in any case.
BINS, FEW, ROUNDS = 1 << 10, 1 << 14, 24


def quantiles(rows: DataFrame, value: str, probs: tuple[float, ...], *keys: str, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, prob, value) by linear interpolation between the two ranks around prob * (n - 1), of the values that are neither null nor not-a-number.

    A null key is a key. Groups without a value have no row.
    """
    named = [f"__k{i}" for i in range(len(keys))]
    cells = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = stored(cells.groupBy(*named, "__v").agg(F.count("*").alias("__n")), "counts")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in named]
    total = counts.groupBy(*named).agg(F.sum("__n").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("distinct"))
    at = F.col("prob") * (F.col("n") - 1)
    asked = total.select(*named, "n", "lo", "hi", "distinct", F.explode(F.array(*map(F.lit, map(float, probs)))).alias("prob"))
    # ``before`` rows lie below the range [lo, hi] that holds the rank
    asked = asked.select(*named, "prob", "n", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"), "lo", "hi", "distinct", F.lit(0).cast("long").alias("before"))
    asked = stored(asked, "asked")
    for _ in range(ROUNDS):
        if not asked.filter((F.col("distinct") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        ranges = asked.select(*named, "lo", "hi").distinct()
        inside = counts.alias("c").join(F.broadcast(ranges).alias("r"), [*same("c", "r"), F.col("__v").between(F.col("lo"), F.col("hi"))])
        # halves first, so that the widest ranges do not overflow
        share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")
        binned = inside.select(*[F.col(f"r.{k}").alias(k) for k in named], "lo", "hi", bin_.alias("bin"), "__v", "__n").groupBy(*named, "lo", "hi", "bin").agg(F.sum("__n").alias("__n"), F.min("__v").alias("new_lo"), F.max("__v").alias("new_hi"), F.count("*").alias("new_distinct"))
        order = Window.partitionBy(*named, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        binned = binned.withColumn("under", F.coalesce(F.sum("__n").over(order), F.lit(0)))
        rank = F.col("rank") - F.col("before")
        met = asked.alias("a").join(binned.alias("b"), [*same("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi"), rank >= F.col("under"), rank < F.col("under") + F.col("__n")])
        asked = stored(met.select(*[F.col(f"a.{k}").alias(k) for k in named], "prob", "n", "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("new_distinct").alias("distinct"), (F.col("before") + F.col("under")).alias("before")), "asked")
    ranges = asked.select(*named, "lo", "hi").distinct()
    inside = counts.alias("c").join(F.broadcast(ranges).alias("r"), [*same("c", "r"), F.col("__v").between(F.col("lo"), F.col("hi"))])
    upto = Window.partitionBy(*named, "lo", "hi").orderBy("__v")
    ranked = inside.select(*[F.col(f"r.{k}").alias(k) for k in named], "lo", "hi", "__v", "__n").withColumn("end", F.sum("__n").over(upto))
    rank = F.col("rank") - F.col("before")
    met = asked.alias("a").join(ranked.alias("b"), [*same("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi"), rank < F.col("end"), rank >= F.col("end") - F.col("__n")])
    pairs = met.select(*[F.col(f"a.{k}").alias(k) for k in named], "prob", "n", "rank", "__v").groupBy(*named, "prob", "n").agg(F.min_by("__v", "rank").alias("low"), F.max_by("__v", "rank").alias("high"))
    exact = F.col("prob") * (F.col("n") - 1)
    part = exact - F.floor(exact)
    value_ = F.when(part == 0, F.col("low")).otherwise(F.col("low") * (1 - part) + F.col("high") * part)
    return pairs.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], "prob", value_.alias("value"))
