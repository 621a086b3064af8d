"""Merkle manifest of a dataset, kept as strings of concatenated digests.

Rows are leaves. Nodes of a group (a source, then the list of sources) lie in aligned
blocks of ``BLOCK``; a block keeps a whole level as one string of hex digests, 64
characters each, so parents are hashes of fixed-width substrings and a node's siblings
are the substrings on both sides of it within its run. The blocks' own roots are the
next nodes, until a group has one left.

Leaves get their place from a range sort by (source, identifier): the sorted partitions
are numbered, and the rows that a source has in earlier partitions are added up, so a
source of any size is spread over all tasks and no window holds one.

The way back goes down from the root: a block hands each child the segments of siblings
above it, which are as many as the tree has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import ascii_lower, shuffle_partitions, stored

#: Nodes that are hashed together, and levels that a block covers.
ARITY, LEVELS = 16, 2
BLOCK = ARITY**LEVELS
#: Hex digits of a digest, and of a run of them.
DIGEST = 64
RUN = ARITY * DIGEST
#: Rows whose doc_id has a CRC-32 that this divides are tampered with.
TAMPER_EVERY = 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one a partition and group that are sent to all tasks, at most; 40 bytes each.
BROADCAST_ROWS = 1 << 18


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (hex) of the fields: ``-`` for null, else byte count, ``:`` and value."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _nth(level: Column, first: Column, count: Column | int) -> Column:
    """``count`` digests of a level, from number ``first``."""
    count = count if isinstance(count, Column) else F.lit(count)
    return F.substring(level, (first * DIGEST + 1).cast("int"), (count * DIGEST).cast("int"))


def _parents(level: Column) -> Column:
    """The next level: the hash of each run of digests."""
    runs = F.ceil(F.length(level) / RUN).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, (i * RUN + 1).cast("int"), F.lit(RUN)), 256)), "")


def _flanks(level: Column, at: Column) -> Column:
    """The digests before and after number ``at`` within its run."""
    start = F.floor(at / ARITY) * ARITY
    return F.struct(_nth(level, start, at - start).alias("left"), _nth(level, at + 1, start + (ARITY - 1) - at).alias("right"))


def _block_levels(total: Column) -> Column:
    """Levels to hash within a block of a group of so many nodes."""
    found = F.lit(0)
    for level in range(LEVELS):
        found = F.when(total > ARITY**level, F.lit(level + 1)).otherwise(found)
    return found


def blocks_of(nodes: DataFrame, extra: tuple = ()) -> DataFrame:
    """Aligned blocks of nodes (grp, total, pos, node): level0, level1, level2, the number of levels to hash and the block's own node.

    ``extra`` names columns of the nodes that the block keeps in the list ``rows``. No
    block holds more than ``BLOCK`` nodes, however large its group is.
    """
    held = F.struct("pos", "node", *extra)
    found = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(held)).alias("rows"))
    found = found.withColumn("levels", _block_levels(F.col("total"))).withColumn("level0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    if not extra:
        found = found.drop("rows")
    found = found.withColumn("level1", F.when(F.col("levels") > 0, _parents(F.col("level0"))))
    found = found.withColumn("level2", F.when(F.col("levels") > 1, _parents(F.col("level1"))))
    return found.withColumn("node", F.coalesce("level2", "level1", "level0"))


def _next(blocks: DataFrame) -> DataFrame:
    return blocks.select("grp", F.ceil(F.col("total") / BLOCK).alias("total"), F.col("block").alias("pos"), "node")


def _rounds(nodes: DataFrame, extra: tuple, label: str) -> list[DataFrame]:
    """Blocks of nodes, blocks of those blocks' nodes and so on; in the last, every group has one."""
    found = [stored(blocks_of(nodes, extra), f"{label}-0")]
    largest = found[0].agg(F.max("total")).first()[0] or 0
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        found.append(stored(blocks_of(_next(found[-1])), f"{label}-{len(found)}"))
    return found


def _segments(at: Column) -> list[Column]:
    """Sibling segments within a block of the node at a place: one a level that is hashed."""
    return [F.when(F.col("levels") > level, _flanks(F.col(f"level{level}"), F.floor(at / ARITY**level))) for level in range(LEVELS)]


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Of each child of the blocks: grp, pos, subroot, root and ``path``, the segments from its own level to the root."""
    rows = blocks.join(above.withColumnRenamed("pos", "block"), ["grp", "block"]).withColumn("at", F.explode(F.sequence(F.lit(0), (F.length("level0") / DIGEST).cast("int") - 1)))
    path = F.concat(F.array_compact(F.array(*_segments(F.col("at")))), F.col("path"))
    return rows.select("grp", (F.col("block") * BLOCK + F.col("at")).alias("pos"), "subroot", "root", path.alias("path"))


def _down(top: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the children of all rounds but the first, from those of the last round's blocks down."""
    for blocks in reversed(top):
        above = _descend(blocks, above)
    return above


def leaf_positions(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, doc_id, node, ...) with pos, their place within the group, and total, its size.

    Leaves ascend by doc_id, a null one first; of equal doc_id, by their own digest.
    """
    spark = leaves.sparkSession
    order = ("grp", "doc_id", "node")
    ranged = leaves.repartitionByRange(shuffle_partitions(spark) * 4, *order).sortWithinPartitions(*order)
    # the number of a row within its sorted partition, as the task writes it
    place = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("part", F.shiftright(place, 33)).withColumn("row", place.bitwiseAND(F.lit((1 << 33) - 1))), "leaves")
    counts = ranged.groupBy("grp", "part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows of one a partition and group that meet: partitions plus groups, at most
    starts = stored(counts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(group).alias("total")), "starts")
    starts = starts.withColumnsRenamed({"grp": "__grp", "part": "__part"})
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = ranged.join(starts, (F.col("grp") == F.col("__grp")) & (F.col("part") == F.col("__part")))
    return placed.withColumn("pos", F.col("row") + F.col("shift")).drop("__grp", "__part", "part", "row", "shift")


def _hashed_up(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, tamper_every: int = TAMPER_EVERY, columns: tuple = COLUMNS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether a tampered copy is found out.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. A row's
    proof is its siblings of all levels; folding the tampered row's leaf (the row's own,
    where it is not tampered with) into them gives folded_root. Tampering lower-cases
    A-Z of the text where ``tamper_every`` divides the CRC-32 of the decimal doc_id.

    Defined cases: nulls are hashed as ``-`` and differ from empty texts; a null source is
    a source of its own and comes first; a null doc_id comes first in its source and is
    not tampered with; rows of one doc_id go by their digest, equal rows are leaves each;
    a text without capitals verifies after tampering; a source with one row has its leaf
    as subroot, one source's subroot is the root, and a table of one row has the digest
    of nothing as proof; texts of any length are hashed whole; further columns are not
    looked at; an empty table gives no rows.
    """
    kinds = ("long", "string", "string", "long", "string")
    named = docs.select(*[F.col(f"`{c}`").cast(kind).alias(name) for c, kind, name in zip(columns, kinds, COLUMNS, strict=True)])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0) & F.col("text").isNotNull()
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = named.select(
        # a null source sorts before all others, which sort by their bytes
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("grp"),
        "doc_id",
        leaf_hash(*fields, F.col("text")).alias("node"),
        F.when(hit, leaf_hash(*fields, ascii_lower(F.col("text")))).alias("tampered"),
    )
    rounds = _rounds(leaf_positions(leaves), ("doc_id", "tampered"), "blocks")
    # a group that is done in an earlier round stays one node, which later rounds do not hash
    subroots = rounds[-1].select("grp", "node")
    ordered = leaf_positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("doc_id"), "node"))
    tops = _rounds(ordered.withColumnRenamed("doc_id", "name"), ("name",), "sources")
    root = tops[-1].select("grp", F.col("block").alias("pos"), F.lit("").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = _down(tops, root)
    names = tops[0].select("block", F.posexplode("rows").alias("at", "r")).select((F.col("block") * BLOCK + F.col("at")).alias("pos"), F.col("r.name").alias("grp"), F.col("r.node").alias("subroot"))
    above = names.join(above.drop("grp", "subroot"), "pos").select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "root", "path")
    above = stored(_down(rounds[1:], above), "paths")
    blocks = rounds[0].join(above.withColumnRenamed("pos", "block"), ["grp", "block"])
    # runs first, then their leaves, so that a leaf carries its own run and not its whole block
    run = F.col("run")
    runs = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.size("rows") / ARITY).cast("int") - 1)))
    upper = F.concat(F.array_compact(F.array(*[F.when(F.col("levels") > level, _flanks(F.col(f"level{level}"), F.floor(run / ARITY ** (level - 1)))) for level in range(1, LEVELS)])), F.col("path"))
    runs = runs.select("subroot", "root", "levels", upper.alias("upper"), _nth(F.col("level0"), run * ARITY, ARITY).alias("own"), F.slice("rows", run * ARITY + 1, F.lit(ARITY)).alias("rows"))
    rows = runs.select("subroot", "root", "levels", "upper", "own", F.posexplode("rows").alias("at", "r"))
    path = F.when(F.col("levels") > 0, F.concat(F.array(_flanks(F.col("own"), F.col("at"))), F.col("upper"))).otherwise(F.col("upper"))
    rows = rows.select(F.col("r.doc_id").alias("doc_id"), F.col("r.node").alias("leaf"), F.col("r.tampered").alias("tampered"), "subroot", "root", path.alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    found = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), _hashed_up(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
