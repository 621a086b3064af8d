"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by one space and closed by an end byte. Each byte
is eight binary decisions; the node of a decision under a context (the bytes before, up
to ``DEPTH``) counts zeros and ones. A node's weighted probability is the mean of its
Krichevsky-Trofimov estimate and of the product over its longer contexts, so the tree
mixes all depths. Counts come from every training text; the weights they give are then
fixed, and a byte is scored from the root, mixing each depth by its posterior weight.

n-grams (a context and the byte after it, one number: a code) are counted in each input
partition, summed by a shuffle, and dealt out by their last three context bytes. A
partition weighs whole subtrees, of which only the sums go up to the shallow levels; once
those are known it gives every code of its subtrees its log-probability from the full
tree, in double precision from the counts themselves. Scoring then only looks codes up:
the ``HEAD_CODES`` most frequent are sent to the tasks (16 bytes each) and all others
meet their values in a join, as words beyond ``HEAD_WORDS`` meet their counts. Both are
bounds of memory: they change no score. The shallow levels that are sent to the weighing
tasks have at most 65,793 contexts by construction (about 6.6 million nodes if every
pair of bytes that UTF-8 allows is met; tens of thousands in the given tables).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import shuffle_partitions, stored
from scrivener.llm.language_id import fold

DEPTH = 5
#: Codes (their probabilities) and words (their counts) that are sent to all scoring tasks.
HEAD_CODES, HEAD_WORDS = 1 << 20, 1 << 17
FOLDS, HELD_OUT = 7, 2
END = b"\n"
#: Contexts longer than this are weighed by subtree, up to this by depth.
SHALLOW = 2
#: Grams whose subtrees a task weighs at once, unless a single subtree has more; and grams of a partition.
SUBTREE_GRAMS, PARTITION_GRAMS = 1 << 17, 1 << 20
#: Bytes of text that are counted and scored at once.
CHUNK = 1 << 21
SCORED = 1 << 20
#: Texts of a chunk, at most: their places and 48 bits of a code share one number.
PLACE_BITS = 15
#: Distinct grams, and words, that a counting task holds before it hands them on.
FLUSH, FLUSH_WORDS = 1 << 21, 1 << 19
CACHE_BITS = 20
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HALF = np.log(0.5)


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def _codes(texts: list[bytes]) -> np.ndarray:
    """Of every byte of every text, the byte and the DEPTH bytes before it as one number."""
    pad = END * DEPTH
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    codes = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        codes <<= 8
        codes |= data[k : len(data) - DEPTH + k]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    keep = np.ones(len(data), bool)
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return codes[keep[DEPTH:]]


def _summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], *(np.add.reduceat(v[order], first) if len(codes) else v for v in values)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, whether it teaches) the distinct codes, and how often texts that teach have them."""
    held, n_held, texts, size = [], 0, {True: [], False: []}, 0

    def total() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def take() -> int:
        new = 0
        for teaches, some in texts.items():
            if some:
                codes, n = np.unique(_codes(some), return_counts=True)
                held.append((codes, n if teaches else np.zeros_like(n)))
                some.clear()
                new += len(codes)
        return new

    for batch in batches:
        for text, teaches in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = b" ".join(words_of(text.as_py())) + END
            texts[teaches].append(data)
            size += len(data)
            if size >= CHUNK:
                n_held, size = n_held + take(), 0
                if n_held > FLUSH:
                    held[:] = [total()]
                    if (n_held := len(held[0][0])) > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["code", "n"])
                        n_held = 0
    take()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["code", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        counts.clear()
        for i in range(0, len(items), 1 << 16):
            part = items[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            counts[b""] += 1  # the end of a text
        if len(counts) > FLUSH_WORDS:
            yield from out()
    yield from out()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series eight steps up, and back."""
    y = x + 8
    back = np.log(x)
    for k in range(1, 8):
        back = back + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - back


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones in any one order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the node's own estimate, ln of its weighted probability); ``below``: ln of the product over longer contexts."""
    own = log_kt(zeros.astype(float), ones.astype(float))
    if below is None:
        return np.ones(len(own)), own
    both = np.logaddexp(_HALF + own, _HALF + below)
    return np.exp(_HALF + own - both), both


def _up(key: np.ndarray, depth: int) -> np.ndarray:
    """The key of the same decision under the context of ``depth`` bytes."""
    return key & ((1 << 8 * depth + 8) - 1)


def _levels(code: np.ndarray, n: np.ndarray, j: int) -> Iterator[tuple]:
    """Decision ``j`` of whole subtrees, at each depth from DEPTH down to SHALLOW + 1.

    Yields the depth, its nodes (key, zeros, ones, weight, ln of the weighted probability)
    and the node of each code. A node without counts weighs one half and multiplies
    nothing, so codes that training never met have nodes too.
    """
    byte = code & 255
    bit = byte >> 7 - j & 1
    key, at = np.unique(code >> 8 << 8 | 1 << j | byte >> 8 - j, return_inverse=True)
    zeros, ones = np.bincount(at, n * (1 - bit), len(key)), np.bincount(at, n * bit, len(key))
    below = None
    for depth in range(DEPTH, SHALLOW, -1):
        if depth < DEPTH:
            key, up = np.unique(_up(key, depth), return_inverse=True)
            zeros, ones, below = (np.bincount(up, x, len(key)) for x in (zeros, ones, log_w))  # noqa: F821
            at = up[at]
        weight, log_w = _weigh(zeros, ones, below)
        yield depth, key, zeros, ones, weight, log_w, at


_NODE_FIELDS = ["key", "zeros", "ones", "weight", "log_w"]
_NODES = "key bigint, zeros double, ones double, weight double, log_w double"


def _node_batches(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)]) for c in columns], _NODE_FIELDS)


def _whole_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of a partition, several subtrees at a time."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not pairs:
        return
    code, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
    pairs.clear()
    root = code >> 8 & (1 << 8 * (SHALLOW + 1)) - 1
    order = np.argsort(root, kind="stable")
    root = root[order]
    starts = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
    del root
    at = 0
    while at < len(order):
        end = starts[np.searchsorted(starts, at + SUBTREE_GRAMS, side="right") - 1]
        if end <= at:
            later = np.searchsorted(starts, at, side="right")
            end = starts[later] if later < len(starts) else len(order)
        elif at + SUBTREE_GRAMS >= len(order):
            end = len(order)
        yield code[order[at:end]], n[order[at:end]]
        at = end


def _subtree_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counted nodes at depth SHALLOW + 1."""
    for code, n in _whole_subtrees(batches):
        for j in range(8):
            for depth, *nodes, _ in _levels(code, n, j):
                if depth == SHALLOW + 1:
                    met = nodes[1] + nodes[2] > 0
                    yield from _node_batches(*(x[met] for x in nodes))


def _one_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weigh one depth from sums over its longer contexts."""
    for batch in batches:
        key, zeros, ones, below = (batch.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
        yield from _node_batches(key, zeros, ones, *_weigh(zeros, ones, below))


def _met(context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether training met each code's context."""
    distinct, at = np.unique(context, return_inverse=True)
    return (np.bincount(at, n, len(distinct)) > 0)[at]


def evaluate(code: np.ndarray, n: np.ndarray, shallow: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of the probability of each code's last byte after its context, for the codes of whole subtrees.

    ``n``: how often training met each; ``shallow``: the sorted keys, zeros, ones and weights of
    the depths 0 to SHALLOW. An estimate is at least half a count over all counts plus
    one, so no probability is zero.
    """
    context = code >> 8
    inside = {d: _met(context & (1 << 8 * d) - 1, n) for d in range(DEPTH, SHALLOW, -1)}
    total = np.zeros(len(code))
    for j in range(8):
        bit = (code >> 7 - j & 1).astype(bool)
        p, started = np.full(len(code), 0.5), np.zeros(len(code), bool)

        def mix(zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray, at: np.ndarray, has: np.ndarray) -> None:
            nonlocal p, started
            own = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)  # noqa: B023
            w = weight[at]
            p = np.where(has, np.where(started, w * own + (1 - w) * p, own), p)
            started = started | has

        for depth, key, zeros, ones, weight, _, at in _levels(code, n, j):
            mix(zeros, ones, weight, at, inside[depth])
        for depth in range(SHALLOW, -1, -1):
            key, up = np.unique(_up(key, depth), return_inverse=True)
            at = up[at]
            zeros, ones, weight, found = _look_up(shallow[depth], key)
            if j == 0:  # the first decision of a context is met if the context is
                inside[depth] = found[at]
            mix(zeros, ones, weight, at, inside[depth])
        total += np.log10(p)
    return total


def _look_up(level: tuple[np.ndarray, ...], key: np.ndarray) -> tuple[np.ndarray, ...]:
    """zeros, ones and weight of the nodes of a level, those of a node without counts where there is none, and whether there is one."""
    keys, *columns = level
    if not len(keys):
        return np.zeros(len(key)), np.zeros(len(key)), np.full(len(key), 0.5), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    found = keys[at] == key
    return *(np.where(found, c[at], none) for c, none in zip(columns, (0.0, 0.0, 0.5), strict=True)), found


def _values(shallow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _whole_subtrees(batches):
            value = evaluate(code, n, shallow.value)
            for i in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (code, n, value)], ["code", "n", "log10"])

    return run


def _by_subtree(grams: DataFrame, partitions: int) -> DataFrame:
    """The (code, n) of all contexts that share their last SHALLOW + 1 bytes in one partition."""
    last = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * (SHALLOW + 1)) - 1))
    return grams.select("code", "n").repartition(partitions, last)


def code_values(grams: DataFrame) -> DataFrame:
    """(code, n, log10) of every code, by the tree of all codes with their counts.

    ``grams`` has code and n, 0 for codes that are to be scored but teach nothing, each
    code once. An empty table gives none; without any count each byte has 1/256.
    """
    spark = grams.sparkSession
    partitions = max(shuffle_partitions(spark), -(-grams.count() // PARTITION_GRAMS))
    at = stored(_by_subtree(grams, partitions).mapInArrow(_subtree_tops, _NODES), "ctw")
    shallow: list = [None] * (SHALLOW + 1)
    for depth in range(SHALLOW, -1, -1):
        upper = F.col("key").bitwiseAND(F.lit((1 << 8 * depth + 8) - 1))
        sums = at.groupBy(upper.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        at = stored(sums.mapInArrow(_one_level, _NODES), "ctw")
        level = at.select("key", "zeros", "ones", "weight").toArrow()
        order = np.argsort(level["key"].to_numpy())
        shallow[depth] = tuple(level[c].to_numpy()[order] for c in ("key", "zeros", "ones", "weight"))
    sent = spark.sparkContext.broadcast(shallow)
    return stored(_by_subtree(grams, partitions).mapInArrow(_values(sent), "code bigint, n bigint, log10 double"), "codes")


def _floor_for(rows: DataFrame, n, at_most: int) -> float:
    """The least power of 2^(1/8) such that at most so many rows have ``n`` of it or more."""
    steps = rows.groupBy(F.floor(F.log2(n.cast("double")) * 8).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    floor, total = 0.0, 0
    for s in steps:  # one row an eighth of a power of two: at most 512
        total += s["count"]
        if total > at_most:
            return 2.0 ** ((s["step"] + 1) / 8)
    return floor


class CodeTable:
    """log10 probabilities by code, through a table of those looked up before."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        """``codes``: sorted."""
        self.codes, self.values = codes, values
        self.slots = np.full(1 << CACHE_BITS, -1, np.int64)
        self.known = np.zeros(1 << CACHE_BITS)

    def _find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], np.nan)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """NaN for codes that are not in the table."""
        slot = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.slots[slot] != codes)
        out = self.known[slot]
        if len(missed):
            out[missed] = self._find(codes[missed])
            # of codes that share a slot the last stays, in both arrays
            self.slots[slot[missed]] = codes[missed]
            self.known[slot[missed]] = out[missed]
        return out


#: The model that this Python worker has linked, by broadcast.
_LINKED: dict[int, tuple] = {}


def _score(model, key: str, words_total: int, vocabulary: int):
    """Rows of texts, with what their bounded model gives, and rows of codes that it has not: the texts that have them, and how often."""

    names = ["row", "id", "held_out", "n_tokens", "n_head", "head", "score", "n_bytes", "rest", "code", "at", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LINKED:
            _LINKED.clear()
            codes, values, words, counts = model.value
            base = np.log10((counts + 1) / (words_total + vocabulary + 1)).tolist()
            _LINKED[key] = (CodeTable(codes, values), dict(zip(words.to_pylist(), base, strict=True)))
        table, head = _LINKED[key]
        for batch in batches:
            ids, held, places = batch.column(0), batch.column(1), batch.column(3).to_numpy()
            rows: list[tuple] = []
            texts: list[bytes] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                lengths = [len(t) for t in texts]
                codes = _codes(texts)
                values = table.log10(codes)
                far = np.flatnonzero(np.isnan(values))
                values[far] = 0
                scores = np.add.reduceat(values, np.cumsum([0, *lengths[:-1]]))
                i = [r[0] for r in rows]
                arrays = [pa.array(places[i]), ids.take(pa.array(i)), held.take(pa.array(i)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64()), pa.array(scores), pa.array(lengths, pa.int64()), pa.array([r[4] for r in rows], pa.list_(pa.binary()))]
                none = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, *none], names)
                if len(far):
                    pairs, times = np.unique(codes[far] << PLACE_BITS | np.repeat(np.arange(len(texts)), lengths)[far], return_counts=True)
                    code, at = pairs >> PLACE_BITS, places[np.array(i)[pairs & (1 << PLACE_BITS) - 1]]
                    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                    ends = np.append(first, len(code)).astype(np.int32)
                    for k in range(0, len(first), 1 << 16):
                        e = ends[k : k + (1 << 16) + 1]
                        lists = [pa.ListArray.from_arrays(pa.array(e - e[0]), pa.array(x[e[0] : e[-1]])) for x in (at, times)]
                        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(e) - 1, a.type) for a in arrays), pa.array(code[e[:-1]]), *lists], names)
                rows.clear(), texts.clear()

            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                texts.append(b" ".join(words) + END)
                words.append(b"")
                values = list(map(head.get, words))
                rest = [w for w, v in zip(words, values, strict=True) if v is None] if None in values else []
                rows.append((i, len(words), len(words) - len(rest), sum(v for v in values if v is not None), rest))
                size += len(texts[-1])
                if size >= SCORED or len(texts) >> PLACE_BITS:
                    yield from out()
                    size = 0
            if rows:
                yield from out()

    return run


def ctw_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_codes: int = HEAD_CODES, head_words: int = HEAD_WORDS) -> DataFrame:
    """Score every text by the tree learned from those outside the held-out fold.

    Returns the identifier, held_out (crc32 of the identifier as text, modulo 7, is 2),
    n_tokens (words and the end), n_known (those met in training), train_tokens,
    base_score (add-one unigrams, log10), score (log10 probability of the text's bytes)
    and bits_per_byte, the code length that the score stands for over the bytes of the
    text, its end included. Defined cases: a null text is empty and has its end only; a
    null identifier is not held out and teaches nothing; repeated rows count each;
    without training texts the tree gives every bit one half; other columns are not
    looked at; an empty table gives no rows. ``head_codes`` and ``head_words`` bound what
    tasks hold and change no result.
    """
    spark = docs.sparkSession
    own = fold(id_col, FOLDS)
    train = docs.filter(own != HELD_OUT).select(F.col(text_col).cast("string").alias("text"))
    counts = stored(train.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    every = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(own != HELD_OUT, F.lit(False)).alias("teaches"))
    grams = stored(every.mapInArrow(_count_grams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "grams")
    known = code_values(grams)

    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = sums["n"], sums["v"]
    head = counts.filter(F.col("n") >= _floor_for(counts, F.col("n"), head_words)).toArrow()
    # codes that training never met count as met once here
    often = F.greatest(F.col("n"), F.lit(1))
    floor = _floor_for(known, often, head_codes)
    sent = known.filter(often >= floor).select("code", "log10").toArrow()
    codes = sent["code"].to_numpy()
    order = np.argsort(codes)
    model = spark.sparkContext.broadcast((codes[order], sent["log10"].to_numpy()[order], head["word"].combine_chunks(), head["n"].to_numpy()))
    del sent, codes, order, head

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(own == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = (
        f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_head bigint, head double, score double, n_bytes bigint, rest array<binary>, "
        "code bigint, at array<bigint>, times array<bigint>"
    )
    met = stored(rows.mapInArrow(_score(model, uuid.uuid4().hex, total, vocabulary), schema), "scored")
    scored = met.filter(F.col("code").isNull()).drop("code", "at", "times")
    rest = scored.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    share = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + vocabulary + 1)))
    tails = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * share).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_tail"))
    found = scored.join(tails, "row", "left")
    score = F.col("score")
    if floor > 0:
        asked = met.filter(F.col("code").isNotNull()).select("code", "at", "times").join(known.select("code", "log10"), "code")
        one = asked.select("log10", F.explode(F.arrays_zip("at", "times")).alias("x")).select(F.col("x.at").alias("row"), (F.col("x.times") * F.col("log10")).alias("part"))
        found = found.join(one.groupBy("row").agg(F.sum("part").alias("far")), "row", "left")
        score = F.col("score") + F.coalesce("far", F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (score / (-math.log10(2) * F.col("n_bytes"))).alias("bits_per_byte"),
    )
