"""Exact deduplication with Patricia-trie owners.

Rows are dealt out by length and content hash. Each partition inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the identifier of the
row that stays and the number of rows seen. A trie over its memory budget moves its
largest subtree to a temporary file of its own task and returns to it at the end; the
files of a task hold less than the texts of its partition, and a retried task begins anew.

The same trie first runs inside every input partition, so a text copied a billion
times leaves each partition once. Owners go back to the rows by digest; those of hot
texts are broadcast, so no task gathers a hot group there either.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import spread_join, stored

#: Text bytes that one trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


class _Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.owner, self.children = label, owner, {}


class _Spilled:
    """A subtree on disk: every later string that reaches it is appended there."""

    __slots__ = ("file", "prefix")

    def __init__(self, prefix: bytes):
        self.prefix, self.file = prefix, tempfile.TemporaryFile()

    def add(self, suffix: bytes, owner) -> None:
        pickle.dump((suffix, owner), self.file, pickle.HIGHEST_PROTOCOL)

    def read(self) -> Iterator[tuple[bytes, list]]:
        self.file.seek(0)
        with self.file:
            while True:
                try:
                    yield pickle.load(self.file)
                except EOFError:
                    return


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving, so that C compares the bytes."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaOwners:
    """A compressed radix trie from byte strings to ``[identifier, rows]``.

    ``keep`` is ``"max"`` or ``"min"``; a null identifier loses to any other.
    """

    def __init__(self, keep: str = "max", budget: int = TRIE_BYTES, prefix: bytes = b""):
        if keep not in ("max", "min"):
            raise ValueError(f"keep must be max or min, not {keep}")
        self.keep, self.budget, self.prefix = keep, budget, prefix
        self.root, self.held, self.spilled = _Node(b""), 0, []

    def _merge(self, into: list | None, owner: list) -> list:
        if into is None:
            return list(owner)
        a, b = into[0], owner[0]
        if a is None or b is not None and (b > a if self.keep == "max" else b < a):
            into[0] = b
        into[1] += owner[1]
        return into

    def add(self, text: bytes, owner: list) -> None:
        node, i, n = self.root, 0, len(text)
        while i < n:
            child = node.children.get(text[i])
            if child is None:
                node.children[text[i]] = _Node(text[i:], list(owner))
                self.held += n - i + 200
                break
            if type(child) is _Spilled:
                child.add(text[i:], owner)
                return
            label = child.label
            if text.startswith(label, i):
                node, i = child, i + len(label)
                continue
            k = _shared(text[i : i + len(label)], label)
            middle = _Node(label[:k])
            child.label = label[k:]
            middle.children[label[k]] = child
            node.children[text[i]] = middle
            self.held += 200
            node, i = middle, i + k
        else:
            node.owner = self._merge(node.owner, owner)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Move the largest subtree under the first branching node to a file."""
        node, prefix = self.root, self.prefix
        while True:
            held = {b: c for b, c in node.children.items() if type(c) is _Node}
            if not held:
                self.held = 0
                return
            first, child = max(held.items(), key=lambda x: self._size(x[1]))
            if len(node.children) > 1 or node.owner is not None:
                break
            if not child.children:
                return  # one string alone: a file would hold as much
            node, prefix = child, prefix + child.label
        out = _Spilled(prefix)
        for suffix, owner in self._walk(child, b""):
            if type(owner) is _Spilled:  # an older file below moves into the new one
                for rest, old in owner.read():
                    out.add(suffix + rest, old)
                self.spilled.remove(owner)
            else:
                out.add(suffix, owner)
        self.held -= self._size(child)
        node.children[first] = out
        self.spilled.append(out)

    @staticmethod
    def _size(top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            if type(node) is _Node:
                total += len(node.label) + 200
                stack += node.children.values()
        return total

    @staticmethod
    def _walk(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, prefix)]
        while stack:
            node, prefix = stack.pop()
            if type(node) is _Spilled:
                yield prefix, node
                continue
            prefix += node.label
            if node.owner is not None:
                yield prefix, node.owner
            stack += [(c, prefix) for c in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every distinct string once; spilled subtrees follow, each in a trie of its own."""
        waiting: list[_Spilled] = []
        trie = self
        while True:
            for text, owner in trie._walk(trie.root, trie.prefix):
                if type(owner) is not _Spilled:
                    yield text, owner
            waiting += trie.spilled
            trie.root, trie.held, trie.spilled = _Node(b""), 0, []
            if not waiting:
                return
            part = waiting.pop()
            trie = PatriciaOwners(self.keep, self.budget, part.prefix)
            for suffix, owner in part.read():
                trie.add(suffix, owner)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] if isinstance(row[-1], bytes) else b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _owners(keep: str, budget: int, with_text: bool, id_type: str):
    """mapInArrow function: (id, rows, n_bytes, digest, text) in, one row a distinct text out."""
    fields = [("keep_id", pa.string() if id_type == "string" else pa.int64()), ("group_size", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())]
    schema = pa.schema(fields + [("text", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaOwners(keep, budget)
        for batch in batches:
            ids, rows, digests, texts = (batch.column(c).to_pylist() for c in ("keep_id", "group_size", "digest", "text"))
            for ident, n, digest, text in zip(ids, rows, digests, texts, strict=True):
                trie.add(text, [ident, n, digest])
        out = ((o[0], o[1], len(t), o[2], t) if with_text else (o[0], o[1], len(t), o[2]) for t, o in trie.items())
        yield from _batches(out, schema)

    return run


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row a distinct text: keep_id, group_size, n_bytes and digest (SHA-256)."""
    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    out = f"keep_id {kind}, group_size bigint, n_bytes bigint, digest binary"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast(kind).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    once = rows.mapInArrow(_owners(keep, trie_bytes, True, kind), f"{out}, text binary")
    dealt = once.repartition("n_bytes", "digest")
    return dealt.mapInArrow(_owners(keep, trie_bytes, False, kind), out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Name the owner of every row's text.

    Returns one row for each input row: the identifier under its own name, keep_id
    (the row of equal text that stays), group_size (long), kept and text_sha256.

    Defined cases: a null text equals an empty one; texts differ by any byte, white
    space included; a null identifier stays only where all of its group are null; rows
    that repeat an identifier and its text share one fate; an empty table gives an
    empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    owners = stored(text_owners(docs, id_col, text_col, keep, trie_bytes), "owners")
    total = owners.agg(F.sum("group_size")).first()[0] or 0
    facts = facts.withColumnRenamed(id_col, "__id")
    return spread_join(facts, owners, ["n_bytes", "digest"], "group_size", total).select(
        F.col("__id").alias(id_col),
        F.col("keep_id").cast(dict(docs.dtypes)[id_col]).alias("keep_id"),
        "group_size",
        F.col("__id").cast(dict(owners.dtypes)["keep_id"]).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns, one a distinct text.

    Repeats of the owning row itself (equal identifier and text) are reduced to one, of
    which any may stay where they differ in other columns. Null texts are empty; of a
    group of null identifiers one row stays; column names do not matter; an empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda digest, ident: F.concat(F.hex(digest), F.lit(":"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    owners = text_owners(docs, id_col, text_col, keep).select(name("digest", "keep_id").alias("__owner"))
    rows = docs.withColumn("__row", name(F.unhex(F.sha2(text, 256)), id_col))
    kept = rows.join(owners, rows["__row"] == owners["__owner"], "left_semi")
    return kept.dropDuplicates(["__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
