"""A frozen selection of any size: identifiers in chunks by hash, and a tree of digests over them.

One root names the set, whatever the order or partitioning of its rows. Where two sets
differ, the tree leads to the chunks that do, so a change among billions of identifiers is
found by comparing a few nodes a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers of a chunk, on average at most.
CHUNK_IDS = 1 << 12


def depth_for(n: int, chunk_ids: int = CHUNK_IDS) -> int:
    """Leading hex digits of the hash that make chunks of about so many identifiers."""
    depth = 1
    while n > chunk_ids * 16**depth:
        depth += 1
    return depth


def chunks(ids: DataFrame, key: str, depth: int) -> DataFrame:
    """(prefix, n, digest): the identifiers whose SHA-256 begins with the prefix, sorted and hashed, one a line; a null one counts as empty."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = ids.select(F.substring(F.sha2(ident, 256), 1, depth).alias("prefix"), ident.alias("id"))
    return rows.groupBy("prefix").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("digest"))


def digest_tree(ids: DataFrame, key: str, depth: int) -> DataFrame:
    """(level, prefix, n, digest) of all nodes, level 0 and prefix '' the root; a node hashes ``prefix:digest`` of its children, one a line. No rows, no nodes."""
    level = chunks(ids, key, depth)
    out = level.select(F.lit(depth).alias("level"), "*")
    for k in reversed(range(depth)):
        child = F.struct("prefix", "digest")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["prefix"], c["digest"])), "\n")
        level = level.groupBy(F.substring("prefix", 1, k).alias("parent")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest")).withColumnRenamed("parent", "prefix")
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def changed_chunks(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(prefix, compared) of the chunks in which two trees differ; ``compared`` nodes of each level were looked at on the way."""
    spark = a.sparkSession
    open_ = spark.createDataFrame([("",)], "parent string")
    compared = 0
    for level in range(depth + 1):
        side = lambda t, name: t.filter(F.col("level") == level).select(F.substring("prefix", 1, max(0, level - 1)).alias("parent"), "prefix", F.col("digest").alias(name))  # noqa: E731, B023
        # only children of nodes that differ are read on
        x, y = (side(t, n).join(F.broadcast(open_), "parent", "left_semi") for t, n in ((a, "x"), (b, "y")))
        both = x.join(y, ["parent", "prefix"], "full").select("prefix", (~F.col("x").eqNullSafe(F.col("y"))).alias("differs")).collect()
        compared += len(both)
        differ = [(r["prefix"],) for r in both if r["differs"]]
        open_ = spark.createDataFrame(differ, "parent string")
    return open_.select(F.col("parent").alias("prefix"), F.lit(compared).alias("compared"))


def freeze(ids: DataFrame, key: str, path: str, seed: int, input_digest: str, depth: int | None = None) -> DataFrame:
    """Write a selection: identifiers by chunk, the tree, and one row (seed, n, dataset_sha256, depth, root), which is returned."""
    depth = depth_for(ids.count()) if depth is None else depth
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    held = ids.select(F.substring(F.sha2(ident, 256), 1, depth).alias("prefix"), ident.alias("id"))
    held.repartitionByRange("prefix", "id").sortWithinPartitions("prefix", "id").write.mode("errorifexists").parquet(f"{path}/identifiers")
    digest_tree(ids, key, depth).write.mode("errorifexists").parquet(f"{path}/tree")
    tree = ids.sparkSession.read.parquet(f"{path}/tree")
    root = tree.filter("level = 0").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("root"))
    row = root.select(F.lit(seed).alias("seed"), "n", F.lit(input_digest).alias("dataset_sha256"), F.lit(depth).alias("depth"), "root")
    row.write.mode("errorifexists").parquet(f"{path}/manifest")
    return ids.sparkSession.read.parquet(f"{path}/manifest")
