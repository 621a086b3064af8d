"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is cut by 2^(r+1) - 1 masks. Bit i has a vector m(i) of r+1 bits, and
mask v holds the bits whose product <m(i), v> over GF(2) is 1. Any r vectors span less
than r+1 dimensions, so for any r differing bits some v is orthogonal to all of them:
that mask leaves the differing bits out, and both fingerprints fall into one bucket of
its table. No pair within the radius is missed.

Links run between distinct fingerprints only. A bucket is one row an element until its
size is known: buckets up to ``BUCKET`` are linked in one call, and larger ones are dealt
out in pairs of blocks, so no task holds an unbounded bucket. A bucket gives back the
edges of a spanning forest, not its pairs. Sizes and components go back to their rows
by joins that spread hot buckets, fingerprints and components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import spread_join, stored
from scrivener.llm.components import component_of

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints that one call links; larger buckets are dealt out in blocks of this size.
BUCKET = 4096
#: Buckets up to this size travel as one row each.
SMALL = 64
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; 0 without words."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle]))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    over = _bit_counts(hashes) * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The identifier, a hash of its text and the fingerprint as a signed 64-bit number (id, text_hash, fp)."""
    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, fp bigint")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The masks of the covering family, as signed numbers.

    Bit vectors m(i) run over the non-zero vectors in turn, which spreads the bits
    evenly; every mask then holds about half of them.
    """
    size = (1 << radius + 1) - 1
    vectors = [1 + i % size for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _stars(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Of each group that links of at most ``radius`` bits hold together, by breadth-first search: every other member and the least one."""
    groups: list[list[int]] = []
    if len(fps) <= 16:
        free = list(fps)
        while free:
            group = [free.pop()]
            for at in group:
                near = [x for x in free if ((x ^ at) & (1 << BITS) - 1).bit_count() <= radius]
                if near:
                    group += near
                    free = [x for x in free if x not in near]
            groups.append(group)
    else:
        every = np.asarray(fps, np.int64)
        bits, rest = every.view(np.uint64), np.arange(len(every))
        while len(rest):
            group, rest = [int(rest[0])], rest[1:]
            for at in group:
                near = np.bitwise_count(bits[rest] ^ bits[at]) <= radius
                if near.any():
                    group += rest[near].tolist()
                    rest = rest[~near]
            groups.append(every[group].tolist())
    return [(x, least) for group in groups if len(group) > 1 for least in (min(group),) for x in group if x != least]


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["src", "dst"])


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edge_batch([e for fps in batch.column(0).to_pylist() for e in _stars(fps, radius)])

    return run


def _link_blocks(radius: int):
    def run(part: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_edge_batch(_stars(part["fp"].to_pylist(), radius))])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) that keep every link's component; null fingerprints have none, an empty table gives none.

    A bucket ties each of its groups to the group's least member, so a fingerprint has one
    such tie a table. All of them are then tied to the least: a group of any size that
    many tables hold leaves with about one edge a fingerprint.
    """
    masks = covering_masks(BITS, radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = spread_join(rows, sizes, ["t", "key"], "n", distinct.count() * len(masks)).filter("n > 1")
    few = min(SMALL, bucket)
    small = met.filter(F.col("n") <= few).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(_link(radius), "src bigint, dst bigint")
    # a large bucket of k blocks: each fingerprint goes to the k pairs of its own block
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    large = met.filter(F.col("n") > few).withColumn("b", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    paired = large.select("t", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp")
    more = paired.groupBy("t", "key", "i", "j").applyInArrow(_link_blocks(radius), "src bigint, dst bigint")
    # as many ties as there are tables and blocks
    tied = found.unionByName(more).groupBy("src").agg(F.collect_set("dst").alias("near")).withColumn("dst", F.array_min("near"))
    return tied.select(F.explode(F.array_append("near", F.col("src"))).alias("src"), "dst").filter("src <> dst").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The marked documents (id, text_hash, fp), and of each fingerprint its rows and component (fp, n, component_id)."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprints")
    member = component_of(links(least.select("fp"), radius), "src", "dst")  # fp of every linked fingerprint -> its component
    named = least.join(member, least["fp"] == member["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "members")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    found = spread_join(named, smallest, ["component"], "members", named.count())
    return marked, stored(found.select("fp", "n", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row a document: the identifier, fingerprint (16 hex digits) and component_id.

    component_id is the smallest identifier reachable over links of at most ``radius``
    differing bits. Defined cases: null, empty and wordless texts have fingerprint zero
    and link like any other; a text of fewer words than a shingle is one shingle; equal
    fingerprints are linked; a null identifier keeps its row and never names a component
    unless all of it are null; repeated rows stay repeated; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    marked, facts = _components(docs, id_col, text_col, shingle, radius)
    out = spread_join(marked, facts, ["fp"], "n", marked.count())
    return out.select(F.col("id").cast(kind).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns: of each component the one with the smallest identifier.

    Where that identifier is repeated within the component, one of its rows stays.
    Defined cases as for ``near_duplicates``: null, empty and wordless texts are one group;
    of a component of null identifiers one row stays; column names do not matter; an
    empty table gives an empty one.
    """
    marked, facts = _components(docs, id_col, text_col, shingle, radius)
    name = lambda ident, text_hash: F.concat_ws(":", ident.cast("string"), text_hash.cast("string"))
    named = facts.select(F.col("fp").alias("__fp"), "component_id")
    found = marked.join(named, (marked["fp"] == named["__fp"]) & marked["id"].eqNullSafe(named["component_id"]))
    # a component of null identifiers only is named by one of its fingerprints
    owners = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("k")).agg(F.min("text_hash").alias("text_hash")).select(name(F.col("component_id"), F.col("text_hash")).alias("__owner"))
    rows = docs.withColumn("__row", name(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))))
    kept = rows.join(owners, rows["__row"] == owners["__owner"], "left_semi")
    return kept.dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
