"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in spark.checkpoint.dir.

    Where a session names none, one on a single machine (a test) gets a temporary folder;
    one on a cluster gets an error, as its executors could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that ``spread_join`` sends to all tasks, at most, and rows that a key has before it may be one of them.
HOT_KEYS, HOT_ROWS = 1 << 14, 64


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Left join of many rows to one row a key, without gathering any key's rows in one task.

    ``right`` has each key once and, in ``size_col``, how many of the ``total`` rows of
    ``left`` have it. Keys with more than ``max(HOT_ROWS, total / HOT_KEYS)`` rows, of which
    there are at most HOT_KEYS, are broadcast; their rows then go through the shuffle of
    all others under a salt that meets nothing. Null keys meet nothing either.
    """
    values = [c for c in right.columns if c not in keys]
    limit = max(HOT_ROWS, total // HOT_KEYS)
    named = lambda mark: [F.col(k).alias(f"__{mark}_{i}") for i, k in enumerate(keys)]
    found = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    # no literal, or the optimizer would drop the salt from the join's keys
    hot = right.filter(F.col(size_col) > limit).select(*named("hot"), found.alias("__hot"))
    cold = right.filter(F.col(size_col) <= limit).select(*named("cold"), F.least(F.col(size_col), F.lit(0)).cast("long").alias("__none"), found.alias("__cold"))
    same = lambda mark: [left[k] == F.col(f"__{mark}_{i}") for i, k in enumerate(keys)]
    rows = left.join(F.broadcast(hot), same("hot"), "left")
    rows = rows.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    both = rows.join(cold, [F.col("__salt") == F.col("__none"), *same("cold")], "left").withColumn("__met", F.coalesce("__hot", "__cold"))
    return both.select(*[left[c] for c in left.columns], *[F.col(f"__met.v{i}").alias(v) for i, v in enumerate(values)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())
