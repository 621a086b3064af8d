"""Seeded samples and splits by hash rank: the same rows for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of lowest seeded hash; all rows if there are fewer (``shortfall`` says how many are missing)."""
    picked = rows.withColumn("__rank", seeded(seed, F.col(key))).orderBy("__rank", key).limit(n).drop("__rank")
    return picked


def shortfall(rows: DataFrame, n: int) -> DataFrame:
    return rows.agg(F.count("*").alias("available"), F.greatest(F.lit(0), F.lit(n) - F.count("*")).alias("missing"))


#: Leading hexadecimal digits of a hash that make a part; places are counted within parts, then over at most 4,096 of them.
DIGITS = 3


def _placed(rows: DataFrame, order: tuple[str, ...], *groups: str) -> DataFrame:
    """``rows`` with __place, from 1 in the order of __hash and ``order`` over all rows, or within each of a few groups."""
    cut = rows.withColumn("__part", F.substring("__hash", 1, DIGITS))
    before = Window.partitionBy(*[f"__of_{g}" for g in groups]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col("__part").alias("__of"), *[F.col(g).alias(f"__of_{g}") for g in groups]).agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col("__part") == F.col("__of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    place = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy("__hash", *order)) + F.col("__before")
    return cut.join(F.broadcast(offsets), same).withColumn("__place", place).drop("__part", "__of", "__before", *[f"__of_{g}" for g in groups])


def balanced(rows: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """All rows of the smaller of two groups and as many of the larger, by seeded hash."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n"))
    least = sizes.agg(F.min("__n").alias("__least"))
    return _placed(rows.withColumn("__hash", seeded(seed, F.col(key))), (key,), group).join(F.broadcast(least)).filter(F.col("__place") <= F.col("__least")).drop("__hash", "__place", "__least")


def group_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """``split``: validation for the ceil(share * groups) groups of lowest hash, train for the rest.

    Groups go whole, so both halves of a pair are on one side. Distinct groups are ranked
    within parts of the hash range, and parts after one another.
    """
    groups = rows.select(group).distinct().withColumn("__hash", seeded(seed, F.col(group)))
    total = groups.agg(F.count("*").alias("__n"))
    ranked = _placed(groups, (group,)).join(F.broadcast(total))
    named = ranked.select(group, F.when(F.col("__place") <= F.ceil(F.col("__n") * share), "validation").otherwise("train").alias("split"))
    return rows.join(named, group)


def three_way(key: Column, seed: int, train: float = 0.8, validation: float = 0.1) -> Column:
    """train, validation or test by the first digits of the seeded hash; needs no other row."""
    at = F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")


def untouched(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """The rows whose key was not used; repeated rows stay repeated."""
    return rows.join(used.select(key).distinct(), key, "left_anti")


def round_robin(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """n rows taken from the groups in turn, best score first.

    Once a group has no more rows the others go on in order, which a counter over a
    shrinking list of groups would not do exactly.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    # no row beyond its group's n-th can be taken, so groups are cut before the sort
    return rows.withColumn("turn", place).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)
