"""Alignment of two tokenizers, and how often their tokens end together.

Both sides encode every text. Byte offsets at which a token of each ends cut a text into
groups, and the two tokens that end there are linked. How often an id pair is linked is
counted over the whole table, outside memory:

1. Each task numbers its documents within a *spill* and collects (pair, document) records.
   A full spill is sorted by radix, side B, side A and document, and leaves as one
   zstd-compressed run a radix: a directory of its pairs and counts, and the records.
2. Directories of one radix meet in a task and are merged by a heap of block ends, which
   adds up every pair's count. As B is the major key, all pairs of a B id come one after
   another, so its highest count is known as soon as it has passed. Where a radix has more
   directories than a task should hold, parts of them are merged first.
3. Totals are sent back to the runs of their radix, whose records become what each
   document of the spill gains: links with the highest count, and the sum of counts. Runs
   of one radix are spread over tasks by size, so a frequent token does not gather.
4. What a spill gains from its radixes is added up beside its documents.

Pairs are counted within a spill first, so a pair that every document has is one entry a
run. Runs are kept in the shared folder: a lost executor's task reads them again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import shuffle_partitions, stored

#: Records after which a spill is written, and documents after which it is, if they have few.
SPILL_RECORDS, SPILL_DOCS = 1 << 20, 1 << 14
#: Radixes of the B id.
RADIXES = 64
#: Bytes of runs, and of directories, that one task gets.
TASK_BYTES = 16 << 20
#: Entries of a directory that the merge looks at together, and directories that it merges at once.
CHUNK, FAN_IN = 1 << 12, 64
#: Characters of text that are encoded together.
BATCH_CHARS = 1 << 20

#: Ids of side A, and documents of a spill, are below these; ids of side B below 2^15, or 2^63 over both.
_SIDE, _DOCS = 1 << 24, 1 << 24

# The pattern by which byte-level vocabularies cut a text, and characters that
# every engine of such patterns puts into the same classes (Latin letters, ASCII, dashes and quotes).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIKE = re.compile("[\t\n\r\x20-\x7e\u00c0-\u024f\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*")


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers of 0 or more in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 or more as one compressed string."""
    parts = []
    for values in map(_narrow, arrays):
        parts += [struct.pack("<cq", values.dtype.char.encode(), len(values)), values.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<cq", raw, at)
        at += struct.calcsize("<cq")
        values = np.frombuffer(raw, np.dtype(kind.decode()), n, at)
        at += values.nbytes
        out.append(values.astype(np.int64))
    return out


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def plain_ranks(bpe_json: str) -> bool:
    """Whether a tokenizer is nothing but byte-level merges in order of their ids, so that an encoder by ranks gives the same ids.

    For every token, as a text of its own, both are compared.
    """
    spec = json.loads(bpe_json)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    extras = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if model.get("type") != "BPE" or extras or not level or spec.get("normalizer") or not all(t["special"] for t in spec.get("added_tokens", ())):
        return False
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or len(set(model["vocab"]) - {t["content"] for t in spec.get("added_tokens", ())}) - len(merged) != 256:
        return False
    sides = Sides(bpe_json, None, True)
    texts = [t.decode() for t in sides.bytes_a if t.decode("utf-8", "ignore").encode() == t]
    return [e.ids for e in sides.a.encode_batch_fast(texts, add_special_tokens=False)] == [sides.fast.encode_ordinary(t) for t in texts]


class Sides:
    """Both tokenizers of a worker, and the bytes of their tokens; ``plain`` as ``plain_ranks`` has it."""

    def __init__(self, bpe_json: str, piece_model: bytes | None, plain: bool = False):
        # one thread: a task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(bpe_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model) if piece_model else None
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t["id"] for t in json.loads(bpe_json).get("added_tokens", ())}
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, ident in vocabulary.items():
            self.bytes_a[ident] = token.encode() if ident in added else bytes(letters[c] for c in token)
        self.bytes_b = [_piece_bytes(self.b, i) for i in range(self.b.get_piece_size())] if self.b else []
        # texts of characters on which all engines agree are encoded by the faster one
        ranks = {t: i for i, t in enumerate(self.bytes_a) if i not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.lengths = [np.array(list(map(len, side)), np.int64) for side in (self.bytes_a, self.bytes_b)]
        # decimals with what follows them: another token, the other side, the next group, or nothing
        names = [[str(i) for i in range(len(side))] for side in (self.bytes_a, self.bytes_b)]
        self.decimals = np.array([n + end for side in names for end in (",", "|", ";", "") for n in side], object)
        self.pieces = [np.array(side, object) for side in (self.bytes_a, self.bytes_b)]
        self.starts = (0, 4 * len(self.bytes_a))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; empty where a text is empty or either side's bytes are not those of the text after a space."""
        spaced = [" " + t for t in texts]
        alike = [self.fast is not None and ALIKE.fullmatch(t) is not None for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, same in zip(spaced, alike, strict=True) if not same], add_special_tokens=False))
        left = [self.fast.encode_ordinary(t) if same else next(rest).ids for t, same in zip(spaced, alike, strict=True)]
        right = self.b.encode(texts, num_threads=1)
        data = [t.encode() for t in spaced]
        whole = [self._gives(n, side, data) for n, side in enumerate((left, right))]
        for n, text in enumerate(texts):
            if not text or not all(w[n] for w in whole):
                left[n], right[n] = [], []
        return left, right

    def _gives(self, n: int, side: list[list[int]], data: list[bytes]) -> list[bool]:
        """Whether each list of ids stands for its bytes: all at once, and one by one where that fails."""
        ids, sizes = _flat(side)
        pieces = self.pieces[n][ids].tolist()
        if b"".join(pieces) == b"".join(data):
            ends = np.append(0, np.cumsum(self.lengths[n][ids]))[np.cumsum(sizes)]
            if (ends == np.cumsum([len(d) for d in data])).all():
                return [True] * len(side)
        cuts = np.append(0, np.cumsum(sizes)).tolist()
        return [b"".join(pieces[i:j]) == d for i, j, d in zip(cuts[:-1], cuts[1:], data, strict=True)]


def _flat(side: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    sizes = np.array(list(map(len, side)), np.int64)
    return np.fromiter(chain.from_iterable(side), np.int64, int(sizes.sum())), sizes


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next free from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(rest)}


def _piece_bytes(model, ident: int) -> bytes:
    piece = model.id_to_piece(ident)
    if model.is_byte(ident):
        return bytes([int(piece[3:-1], 16)])
    return piece.replace("▁", " ").encode()


class _Batch:
    """Groups and links of the encodings of some texts, on one axis of bytes."""

    def __init__(self, sides: Sides, left: list[list[int]], right: list[list[int]]):
        self.sides = sides
        self.ids, self.n = zip(*map(_flat, (left, right)), strict=True)
        # both sides of a text have the same bytes, so ends of all texts lie on one axis
        ends_a, ends_b = (np.cumsum(lengths[ids]) for lengths, ids in zip(sides.lengths, self.ids, strict=True))
        place = np.full(int(ends_a[-1]) + 1 if len(ends_a) else 1, -1)
        place[ends_a] = np.arange(len(ends_a))
        met = place[ends_b]
        self.at_b = np.flatnonzero(met >= 0)
        self.at_a = met[self.at_b]
        self.doc = np.repeat(np.arange(len(left)), self.n[0])[self.at_a]
        self.groups = np.bincount(self.doc, minlength=len(left))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[0][self.at_a], self.ids[1][self.at_b]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as decimals; nothing for a text without tokens."""
        counts_a, counts_b = np.diff(self.at_a, prepend=-1), np.diff(self.at_b, prepend=-1)
        place_a = np.arange(len(self.ids[0])) + np.repeat(np.cumsum(counts_b) - counts_b, counts_a)
        place_b = np.arange(len(self.ids[1])) + np.repeat(np.cumsum(counts_a), counts_b)
        sizes = [len(s) for s in (self.sides.bytes_a, self.sides.bytes_b)]
        key_a, key_b = self.ids[0].copy(), self.ids[1] + self.sides.starts[1]
        key_a[self.at_a] += sizes[0]
        last = np.append(self.doc[1:] != self.doc[:-1], True)[: len(self.doc)]
        key_b[self.at_b] += np.where(last, 3, 2) * sizes[1]
        order = np.empty(len(key_a) + len(key_b), np.int64)
        order[place_a], order[place_b] = key_a, key_b
        words = self.sides.decimals[order].tolist()
        out, at = [], 0
        for n in (self.n[0] + self.n[1]).tolist():
            out.append(hashlib.sha256("".join(words[at : at + n]).encode()).hexdigest() if n else "")
            at += n
        return out


class _Spill:
    """Records (B, A, document) of some documents, until they are written as runs."""

    def __init__(self, radixes: int, vocabulary_b: int):
        self.radixes, self.per = radixes, -(-vocabulary_b // radixes)
        if self.radixes * self.per * _SIDE * _DOCS > 1 << 63:
            raise ValueError(f"{vocabulary_b} ids of side B are too many for records of 64 bits")
        self.docs, self.records, self.held = 0, 0, []

    def add(self, batch: _Batch, docs: int) -> None:
        a, b = batch.pairs()
        # radix-major order of the B ids
        side = (b % self.radixes) * self.per + b // self.radixes
        self.held.append((side * _SIDE + a, batch.doc + self.docs))
        self.docs += docs
        self.records += len(a)

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix, directory, records) of every radix that has any."""
        # pair and document in one number: what is sorted is 64 bits wide
        both = np.concatenate([k * _DOCS + d for k, d in self.held] or [np.zeros(0, np.int64)])
        self.held = []
        both.sort()
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        times = np.diff(first, append=len(both))
        keys, docs = both[first] // _DOCS, both[first] % _DOCS
        cuts = np.searchsorted(keys, np.arange(self.radixes + 1) * self.per * _SIDE)
        for radix in range(self.radixes):
            i, j = cuts[radix], cuts[radix + 1]
            if i < j:
                pair = np.flatnonzero(np.append(True, keys[i + 1 : j] != keys[i : j - 1]))
                held = np.diff(pair, append=j - i)
                yield radix, pack(_deltas(keys[i:j][pair]), np.add.reduceat(times[i:j], pair)), pack(held, docs[i:j], times[i:j])


def merge_counts(runs: list[tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge sorted runs of (keys, counts) into one without repeated keys, a part at a time.

    A heap holds the last key of each run's next ``chunk`` entries. The smallest of them
    bounds what can be merged: every run gives its entries up to it, and none is met again.
    """
    at = [0] * len(runs)
    heap = [(int(keys[min(chunk, len(keys)) - 1]), n) for n, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = []
        for n, (keys, counts) in enumerate(runs):
            end = at[n] + int(np.searchsorted(keys[at[n] : at[n] + chunk], bound, "right"))
            if end > at[n]:
                parts.append((keys[at[n] : end], counts[at[n] : end]))
                at[n] = end
        keys, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[first], np.add.reduceat(counts, first)
        while heap and heap[0][0] <= bound:
            _, n = heapq.heappop(heap)
            if at[n] < len(runs[n][0]):
                heapq.heappush(heap, (int(runs[n][0][min(at[n] + chunk, len(runs[n][0])) - 1]), n))


def _merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All directories as one, at most FAN_IN of them at once."""
    level = [(np.cumsum(d), c) for d, c in map(unpack, runs)]
    while True:
        level = [tuple(np.concatenate(x) for x in zip(*merge_counts(level[i : i + FAN_IN]), strict=True)) for i in range(0, len(level), FAN_IN)]
        if len(level) == 1:
            return level[0]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of sorted batches, gathered by their first columns."""
    at, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


#: A document (radix null), or a run of a spill.
_SPILLED = "spill bigint, place int, id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, radix int, directory binary, records binary"
_SPILLED_SCHEMA = pa.schema([("spill", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("radix", pa.int32()), ("directory", pa.binary()), ("records", pa.binary())])


def _spills(sides: Callable[[], Sides], radixes: int, spill_records: int):
    """Documents (id, text) to their own rows and the runs of their spill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sides()
        number = TaskContext.get().partitionId() << 33
        spill = _Spill(radixes, len(own.bytes_b))

        def encoded(ids: list, texts: list[str]) -> pa.RecordBatch:
            batch = _Batch(own, *own.encode(texts))
            places = range(spill.docs, spill.docs + len(ids))
            spill.add(batch, len(ids))
            facts = zip(places, ids, *(x.tolist() for x in (*batch.n, batch.groups)), batch.digests(), strict=True)
            return _record_batch([(number, *f, None, None, None) for f in facts], _SPILLED_SCHEMA)

        def written() -> Iterator[pa.RecordBatch]:
            for radix, directory, records in spill.runs():
                yield _record_batch([(number, None, None, None, None, None, None, radix, directory, records)], _SPILLED_SCHEMA)

        for whole in batches:
            ids, texts, held = [], [], 0
            for ident, text in zip(whole.column(0).to_pylist(), whole.column(1), strict=True):
                ids.append(ident)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield encoded(ids, texts)
                    ids, texts, held = [], [], 0
                    if spill.records >= spill_records:
                        yield from written()
                        number += 1
                        spill = _Spill(radixes, len(own.bytes_b))
            if ids:
                yield encoded(ids, texts)
            if spill.records >= spill_records or spill.docs >= SPILL_DOCS:
                yield from written()
                number += 1
                spill = _Spill(radixes, len(own.bytes_b))
        yield from written()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories sorted by (radix, part) to one merged directory of each."""
    schema = pa.schema([("radix", pa.int32()), ("part", pa.int32()), ("directory", pa.binary())])
    for (radix, part), rows in _groups(batches, 2):
        keys, counts = _merged([r[0] for r in rows])
        yield _record_batch([(radix, part, pack(_deltas(keys), counts))], schema)


def _with_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories sorted by radix to the totals of all pairs, and which of them are the highest of their B id."""
    schema = pa.schema([("radix", pa.int32()), ("totals", pa.binary())])
    for (radix,), rows in _groups(batches, 1):
        keys, counts = _merged([r[0] for r in rows])
        side = keys // _SIDE
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(keys)))
        yield _record_batch([(radix, pack(_deltas(keys), counts, counts == most))], schema)


_GAINS_SCHEMA = pa.schema([("spill", pa.int64()), ("gains", pa.binary())])


def _gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (radix, part), its totals first (spill null), to what each run's documents gain."""
    at, totals = None, None
    for batch in batches:
        out = []
        for radix, part, spill, found, directory, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found is not None:
                deltas, counts, best = unpack(found)
                at, totals = (radix, part), (np.cumsum(deltas), counts, best)
                continue
            if at != (radix, part):
                raise ValueError("a run came without its totals")
            keys = np.cumsum(unpack(directory)[0])
            held, docs, times = unpack(records)
            place = np.repeat(np.searchsorted(totals[0], keys), held)
            size = int(docs.max()) + 1
            best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(best, docs, times * totals[2][place])
            np.add.at(total, docs, times * totals[1][place])
            out.append((spill, pack(best, total)))
        yield _record_batch(out, _GAINS_SCHEMA)


_RESULT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_RESULT_SCHEMA = pa.schema([("id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by spill, gains first (place null), to its documents with their sums."""
    at, sums = None, np.zeros((2, 0), np.int64)
    for batch in batches:
        out = []
        for spill, gains, place, ident, n_a, n_b, n_groups, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if spill != at:
                at, sums = spill, np.zeros((2, 0), np.int64)
            if place is None:
                part = np.stack(unpack(gains))
                if part.shape[1] > sums.shape[1]:
                    sums, part = part, sums
                sums[:, : part.shape[1]] += part
                continue
            best, total = sums[:, place].tolist() if place < sums.shape[1] else (0, 0)
            out.append((ident, n_a, n_b, n_groups, n_groups, best, total, sha))
        yield _record_batch(out, _RESULT_SCHEMA)


_LOADED: dict[str, Sides] = {}


def _sides(docs: DataFrame, bpe_path: str, piece_path: str) -> Callable[[], Sides]:
    """Read both vocabularies once on the driver; each Python worker loads them once."""
    with open(bpe_path, encoding="utf-8") as bpe, open(piece_path, "rb") as piece:
        files = (bpe.read(), piece.read())
    shipped = docs.sparkSession.sparkContext.broadcast((*files, plain_ranks(files[0])))
    name = hashlib.sha256(files[0].encode() + files[1]).hexdigest()

    def get() -> Sides:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Sides(*shipped.value)
        return _LOADED[name]

    return get


def _parted(rows: DataFrame, size: str, task_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (radix, spill, ...) with the part of their radix that they are dealt to; (radix, parts), as many as its bytes need; and tasks for all."""
    # one row a radix
    parts = stored(rows.groupBy("radix").agg(F.sum(F.octet_length(size)).alias("bytes")), "parts")
    tasks = (parts.agg(F.sum("bytes")).first()[0] or 0) // task_bytes + 1
    parts = F.broadcast(parts.select("radix", F.ceil(F.col("bytes") / task_bytes).cast("int").alias("parts")))
    dealt = rows.join(parts, "radix").withColumn("part", F.pmod(F.xxhash64("spill"), F.col("parts")).cast("int")).drop("parts")
    return dealt, parts, max(tasks, shuffle_partitions(rows.sparkSession))


def align(
    docs: DataFrame,
    bpe_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    radixes: int = RADIXES,
    spill_records: int = SPILL_RECORDS,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Encode every text by both vocabularies and measure how they agree.

    Returns the identifier, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair
    is the most frequent, ties included, of its B id in the whole table), count_sum (the
    counts of all links' pairs, added up) and groups_sha256. No token is empty, so at each
    common end one token of either side ends, and there are as many links as groups.

    Defined cases: null and empty texts, and those that a side does not give back after a
    space (as one with U+2581), have zeros and no digest; texts of any length are encoded
    whole; special tokens' strings are plain text; repeated rows each get theirs and each
    count; an identifier may be null; other columns are not looked at; an empty table
    gives no rows. Bounds on spills, radixes and tasks change no number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spilled = stored(rows.mapInArrow(_spills(_sides(docs, bpe_path, piece_path), radixes, spill_records), _SPILLED), "spills")
    runs = spilled.filter(F.col("radix").isNotNull())

    dealt, _, tasks = _parted(runs.select("spill", "radix", "directory"), "directory", task_bytes)
    dealt = dealt.select("radix", "part", "directory").repartition(tasks, "radix", "part").sortWithinPartitions("radix", "part")
    counted = dealt.mapInArrow(_counted, "radix int, part int, directory binary")
    merged = counted.select("radix", "directory").repartition(min(tasks, radixes), "radix").sortWithinPartitions("radix")
    totals = stored(merged.mapInArrow(_with_best, "radix int, totals binary"), "totals")

    own, parts, tasks = _parted(runs.select("spill", "radix", "directory", "records"), "records", task_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    sent = totals.join(parts, "radix").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("radix", "part", none("bigint").alias("spill"), "totals", none("binary").alias("directory"), none("binary").alias("records"))
    both = own.select("radix", "part", "spill", none("binary").alias("totals"), "directory", "records").unionByName(sent)
    both = both.repartition(tasks, "radix", "part").sortWithinPartitions("radix", "part", F.col("spill").asc_nulls_first())
    gains = both.mapInArrow(_gained, "spill bigint, gains binary")

    documents = spilled.filter(F.col("radix").isNull()).select("spill", none("binary").alias("gains"), "place", "id", "n_a", "n_b", "n_groups", "groups_sha256")
    gains = gains.select("spill", "gains", none("int").alias("place"), *[none("bigint").alias(c) for c in ("id", "n_a", "n_b", "n_groups")], none("string").alias("groups_sha256"))
    beside = gains.unionByName(documents).repartition(tasks, "spill").sortWithinPartitions("spill", F.col("place").asc_nulls_first())
    return beside.mapInArrow(_added_up, _RESULT).withColumnRenamed("id", id_col)
