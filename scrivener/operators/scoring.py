"""Scorers of sentences: any model that sees text, and a packed bigram table.

Both are column expressions over the array of a document's sentences, so a document stays
in its row: texts go to Python in Arrow batches, scores come back, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scorer says of a sentence: its mean negative log-likelihood (null unless ``ok``), how many tokens it has, and why it has no value.
SCORE = "struct<nll:double,n_tokens:int,status:string>"
STATUSES = ("ok", "insufficient_input", "exceeds_context", "non_finite", "error")

Scored = tuple[float | None, int, str]

#: The models that this worker has loaded, by name.
_LOADED: dict[str, Callable[[list[str]], Iterable[Scored]]] = {}


def _loaded(name: str, load: Callable[[], Callable[[list[str]], Iterable[Scored]]]) -> Callable[[list[str]], Iterable[Scored]]:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


class TextScorer:
    """A model over whole sentences, such as a neural one.

    ``load`` is called once in each Python worker and gives a function from a list of
    sentences to (nll, tokens, status) of each; ``name`` tells models of one worker apart.
    Sentences come in lists of at most ``batch``, whatever document they belong to.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], Iterable[Scored]]], batch: int = 256):
        self.name, self.load, self.batch = name, load, batch

    def scores(self, texts: Column) -> Column:
        """An array of SCORE for an array of sentences; null for null."""
        name, load, batch = self.name, self.load, self.batch
        kind = pa.struct([("nll", pa.float64()), ("n_tokens", pa.int32()), ("status", pa.string())])

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            score = _loaded(name, load)
            for part in parts:
                flat = pc.list_flatten(part).to_pylist()
                found: list[Scored] = []
                for i in range(0, len(flat), batch):
                    asked = flat[i : i + batch]
                    answer = list(score(asked))
                    if len(answer) != len(asked) or any(s not in STATUSES for _, _, s in answer):
                        raise ValueError(f"{name} must give (nll, tokens, status) for each sentence, with a status of {STATUSES}")
                    found += answer
                columns = [pa.array([f[k] for f in found], field.type) for k, field in enumerate(kind)]
                yield _lists(part, pa.StructArray.from_arrays(columns, fields=list(kind)))

        return F.arrow_udf(f"array<{SCORE}>")(_typed(run))(texts)


def _typed(run):
    """The hints by which Spark tells an iterator of arrays from a single one."""
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """The flat values as lists of the lengths (and nulls) of another array of lists."""
    lengths = pc.list_value_length(like)
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(lengths))


class LetterModel:
    """A model of words in closed form: a word ends after each letter with probability ``stop``, and its letters are drawn from ``letters`` alike.

    Calling it gives the scorer's function. The first word of a sentence is not scored.
    """

    def __init__(self, letters: int = 26, stop: float = 0.2):
        self.letters, self.stop = letters, stop

    def __call__(self) -> Callable[[list[str]], list[Scored]]:
        word = regex.compile(r"\p{L}+")
        a, b = float(np.log(self.letters) - np.log(1 - self.stop)), float(np.log(1 - self.stop) - np.log(self.stop))

        def score(texts: list[str]) -> list[Scored]:
            out: list[Scored] = []
            for text in texts:
                sizes = [len(w) for w in word.findall(text)]
                # -ln(stop (1 - stop)^(n - 1) letters^-n), over all words but the first
                out.append((sum(n * a + b for n in sizes[1:]) / (len(sizes) - 1), len(sizes), "ok") if len(sizes) > 1 else (None, len(sizes), "insufficient_input"))
            return out

        return score

    def scorer(self) -> TextScorer:
        return TextScorer(f"letters-{self.letters}-{self.stop}", self)


class BigramTable:
    """The bigram counts of a corpus as sorted arrays, sent to the tasks once; for counts of a checked size."""

    def __init__(self, spark: SparkSession, bigrams: pa.Table, vocabulary: int):
        words = pc.unique(pa.chunked_array([*bigrams["a"].chunks, *bigrams["b"].chunks], pa.string()))
        a, b = (pc.index_in(bigrams[c], value_set=words).to_numpy().astype(np.int64) for c in ("a", "b"))
        counts = bigrams["c_ab"].to_numpy().astype(np.float64)
        key = a * len(words) + b
        order = np.argsort(key)
        contexts = np.bincount(a, counts, len(words)) if len(a) else np.zeros(len(words))
        self.shipped = spark.sparkContext.broadcast((words, key[order], counts[order], contexts, vocabulary))

    def nll(self, tokens: Column, k: float, limit: int) -> Column:
        """An array of each sentence's mean negative log-likelihood, for an array of its tokens; null below two tokens and above the limit."""
        shipped = self.shipped

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield _lists(part, _mean_nll(pc.list_flatten(part), *shipped.value, k, limit))

        return F.arrow_udf("array<double>")(_typed(run))(tokens)

    def running(self, tokens: Column, k: float) -> Column:
        """For an array of tokens, the running sums of the negative log-likelihoods of all but the first."""
        shipped = self.shipped

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                logs, sizes, of = _logs(part, *shipped.value, k)
                kept = np.maximum(sizes - 1, 0)
                ends = np.cumsum(kept)
                whole = np.cumsum(logs)
                before = np.concatenate(([0.0], whole))[ends - kept]
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole - before[of]))

        return F.arrow_udf("array<double>")(_typed(run))(tokens)

    def release(self) -> None:
        self.shipped.unpersist()


def _logs(sentences: pa.Array, words: pa.Array, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, vocabulary: int, k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences, one after another, the negative log-likelihood of every token but the first; the sentences' sizes; and whose each value is."""
    sizes = pc.list_value_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pc.list_flatten(sentences).dictionary_encode()
    place = pc.index_in(known.dictionary, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = place[known.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = of[1:] == of[:-1]
    a, b, of = ids[:-1][inside], ids[1:][inside], of[1:][inside]
    joint, context = np.zeros(len(a)), np.zeros(len(a))
    if len(keys):
        both = (a >= 0) & (b >= 0)
        asked = a[both] * len(words) + b[both]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        joint[both] = np.where(keys[at] == asked, counts[at], 0.0)
        context[a >= 0] = contexts[a[a >= 0]]
    return _minus_log(joint, context, vocabulary, k), sizes, of


def _minus_log(joint: np.ndarray, context: np.ndarray, vocabulary: int, k: float) -> np.ndarray:
    """By the C library's logarithm, once for each distinct share: numpy's own differs from it in a last bit here and there, which SQL does not."""
    if not vocabulary:
        return np.full(len(joint), np.nan)
    shares, back = np.unique((joint + k) / (context + k * vocabulary), return_inverse=True)
    return -np.fromiter(map(math.log, shares.tolist()), np.float64, len(shares))[back]


def _mean_nll(sentences: pa.Array, words: pa.Array, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, vocabulary: int, k: float, limit: int) -> pa.Array:
    logs, sizes, of = _logs(sentences, words, keys, counts, contexts, vocabulary, k)
    means = np.bincount(of, logs, len(sizes)) / np.maximum(sizes - 1, 1)
    return pa.array(means, mask=(sizes < 2) | (sizes > limit))


#: What a task finds out of a document's sentences: their sizes; the mean of each whose pairs it all knows; of the others the counts of all pairs, packed; and the pairs among those that it must ask for.
PARTIAL = "struct<sizes:array<int>,means:array<double>,open:binary,asked:array<struct<at:int,a:string,b:string>>>"
_ASKED = pa.struct([("at", pa.int32()), ("a", pa.string()), ("b", pa.string())])
#: A filter is made in so many segments, each by one task; every key sets so many bits of its segment.
SEGMENTS, PROBES = 64, 4


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of every word; as Python's strings only a part of them at a time."""
    parts = [hash_array(words.slice(i, 1 << 16).to_numpy(zero_copy_only=False), categorize=False) for i in range(0, len(words), 1 << 16)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of every pair, by those of its words."""
    return _mixed(a * np.uint64(0x9E3779B97F4A7C15) + _mixed(b))


def _bit(keys: np.ndarray, width: int, probe: int) -> np.ndarray:
    """The bit that a probe sets of a key in its segment of ``width`` bits, a power of two."""
    return (_mixed(keys) + np.uint64(probe) * (keys | np.uint64(1))) & np.uint64(width - 1)


def _segments(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - SEGMENTS.bit_length() + 1)


class KeyFilter:
    """A Bloom filter: says no only of keys that are not in it. Made by the tasks, a segment each, of at most ``most`` bits."""

    def __init__(self, pairs: DataFrame, words: DataFrame | None, n: int, most: int):
        """Of ``n`` keys: pairs (a, b) and words (a)."""
        width = 1 << max(6, (max(10 * n, 1) // SEGMENTS).bit_length())
        while width * SEGMENTS > most and width > 64:
            width //= 2
        self.width = width

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = [_hashes(c) for c in batch.columns]
                keys = _of_pairs(*h) if len(h) == 2 else _mixed(h[0])
                yield pa.RecordBatch.from_arrays([pa.array(_segments(keys).astype(np.int32)), pa.array(keys.view(np.int64))], ["segment", "key"])

        def bitmap(group: pa.Table) -> pa.Table:
            found = np.zeros(width, bool)
            for chunk in group["key"].chunks:
                for probe in range(PROBES):
                    found[_bit(chunk.to_numpy().view(np.uint64), width, probe)] = True
            return pa.table({"segment": group["segment"][:1].cast(pa.int32()), "bits": pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())})

        keys = pairs.mapInArrow(keyed, "segment int, key long")
        if words is not None:
            keys = keys.unionAll(words.mapInArrow(keyed, "segment int, key long"))
        self.bits = np.zeros((SEGMENTS, width // 8), np.uint8)
        for r in keys.groupBy("segment").applyInArrow(bitmap, "segment int, bits binary").toLocalIterator():
            self.bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = self.bits.ravel()

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for probe in range(PROBES):
            asked = keys[left]
            at = _bit(asked, self.width, probe) + _segments(asked) * np.uint64(self.width)
            hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out[left[~hit]] = False
            left = left[hit]
        return out


class PartialTable:
    """What tasks know of counts that are too many for them: the words, the most frequent bigrams, and a filter over all others.

    ``words`` has (w, c_a), c_a being its count as a context, and ``whole`` says whether no
    word is missing. The filter holds all bigrams that ``bigrams`` lacks, and the contexts
    that ``words`` lacks.
    """

    def __init__(self, spark: SparkSession, words: pa.Table, whole: bool, bigrams: pa.Table, others: KeyFilter, vocabulary: int):
        given = words["w"].combine_chunks().cast(pa.string())
        hashes = _hashes(given)
        order = np.argsort(hashes, kind="stable")
        hashes, given = hashes[order], given.take(pa.array(order))
        contexts = words["c_a"].to_numpy().astype(np.float64)[order]
        shipped = (given, hashes, contexts, whole, others, vocabulary)
        a, b = (_places(pc.unique(bigrams[c].combine_chunks().cast(pa.string())), bigrams[c], given, hashes) for c in ("a", "b"))
        known = (a >= 0) & (b >= 0)
        if not known.all():
            raise ValueError("a frequent bigram has a word that is not sent along")
        keys = a * len(given) + b
        order = np.argsort(keys)
        self.shipped = spark.sparkContext.broadcast((*shipped, keys[order], bigrams["c_ab"].to_numpy().astype(np.float64)[order]))

    def partial(self, tokens: Column, k: float, limit: int) -> Column:
        """PARTIAL of an array of sentences, each an array of tokens; those below two tokens and above the limit have neither a mean nor pairs."""
        shipped = self.shipped

        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield _partial(part, *shipped.value, k, limit)

        return F.arrow_udf(PARTIAL)(_typed(run))(tokens)

    def release(self) -> None:
        self.shipped.unpersist()


def _at(words: pa.Array, given: pa.Array, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of words among the given ones, which are sorted by their hashes; -1 where a word is not there."""
    out = np.full(len(words), -1, np.int64)
    at = np.searchsorted(hashes, own)
    left = np.arange(len(words))
    while True:
        left = left[at[left] < len(hashes)]
        left = left[hashes[at[left]] == own[left]]
        if not len(left):
            return out
        same = pc.equal(words.take(pa.array(left)), given.take(pa.array(at[left]))).to_numpy(zero_copy_only=False)
        out[left[same]] = at[left[same]]
        # another word may have the same hash
        left = left[~same]
        at[left] += 1


def _places(distinct: pa.Array, column: pa.ChunkedArray, given: pa.Array, hashes: np.ndarray) -> np.ndarray:
    place = _at(distinct, given, hashes, _hashes(distinct))
    return place[pc.index_in(column.combine_chunks().cast(pa.string()), value_set=distinct).to_numpy()] if len(distinct) else np.zeros(0, np.int64)


def _offsets(like: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Where the lists of an array begin and end among its flat values, the offsets, and which lists are null."""
    lengths = pc.list_value_length(like)
    ends = np.concatenate(([0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    return ends, pa.array(ends.astype(np.int32)), pc.is_null(lengths)


def _partial(part: pa.Array, given: pa.Array, hashes: np.ndarray, contexts: np.ndarray, whole: bool, others: KeyFilter, vocabulary: int, keys: np.ndarray, counts: np.ndarray, k: float, limit: int) -> pa.Array:
    ends, offsets, none = _offsets(part)
    sentences = pc.list_flatten(part)
    sizes = pc.list_value_length(sentences).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    scored = (sizes >= 2) & (sizes <= limit)
    flat = pc.list_flatten(sentences).dictionary_encode()
    words = flat.dictionary
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = _hashes(words)
    place = _at(words, given, hashes, own)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = (of[1:] == of[:-1]) & scored[of[1:]]
    a, b, of = codes[:-1][inside], codes[1:][inside], of[1:][inside]
    at_a, at_b = place[a], place[b]
    joint, known = np.zeros(len(a)), np.zeros(len(a), bool)
    both = (at_a >= 0) & (at_b >= 0)
    if len(keys):
        asked = at_a[both] * len(given) + at_b[both]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        joint[both], known[both] = np.where(hit, counts[at], 0.0), hit
    context = np.where(at_a >= 0, contexts[at_a] if len(contexts) else 0.0, 0.0)
    open_ = np.flatnonzero(~known & both if whole else ~known)
    unsure = np.zeros(len(a), bool)
    unsure[open_] = others.may_hold(_of_pairs(own[a[open_]], own[b[open_]]))
    if not whole:
        missing = np.flatnonzero(at_a < 0)
        met, back = np.unique(a[missing], return_inverse=True)
        unsure[missing] |= others.may_hold(_mixed(own[met]))[back]
    asking = np.zeros(len(sizes), bool)
    asking[of[unsure]] = True
    held = asking[of]
    done = ~held
    means = np.bincount(of[done], _minus_log(joint[done], context[done], vocabulary, k), len(sizes)) / np.maximum(sizes - 1, 1)
    row = np.repeat(np.arange(len(part)), np.diff(ends))
    # the pairs of open sentences by row, and which of them are asked for
    at_row = row[of[held]]
    starts = np.concatenate(([0], np.cumsum(np.bincount(at_row, minlength=len(part)))))
    pairs = np.stack((joint[held], context[held]), axis=1).astype(np.int64)
    packed = [_packed(pairs[x:y]) for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    asked = np.flatnonzero(unsure[held])
    cells = pa.StructArray.from_arrays(
        [pa.array((asked - starts[at_row[asked]]).astype(np.int32)), words.take(pa.array(a[unsure])), words.take(pa.array(b[unsure]))], fields=list(_ASKED)
    )
    asks = np.concatenate(([0], np.cumsum(np.bincount(at_row[asked], minlength=len(part)))))
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(offsets, pa.array(sizes.astype(np.int32)), mask=none),
        pa.ListArray.from_arrays(offsets, pa.array(means, mask=~scored | asking), mask=none),
        pa.array(packed, pa.binary()),
        pa.ListArray.from_arrays(pa.array(asks.astype(np.int32)), cells),
    ], ["sizes", "means", "open", "asked"])


def _packed(pairs: np.ndarray) -> bytes | None:
    """Counts (pairs of long) by planes of bytes, of which the high ones are mostly zero, compressed; None for none."""
    if not len(pairs):
        return None
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(pairs.view(np.uint8).T).tobytes(), asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(packed, 16 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(16, n).T).view(np.int64)


def whole_means(partial: list[Column], answers: Column, vocabulary: int, k: float, limit: int) -> Column:
    """An array of each sentence's mean, for the first three parts of PARTIAL and an array of answers (at, c_ab, c_a; null counts are 0).

    Every sentence is added up in the order of its tokens, as if its counts had been known at once.
    """

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for sizes, means, packed, at, c_ab, c_a in parts:
            ends, offsets, none = _offsets(sizes)
            n = pc.list_flatten(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(means)
            open_ = np.flatnonzero(pc.is_null(flat).to_numpy(zero_copy_only=False) & (n >= 2) & (n <= limit))
            found = flat.fill_null(0.0).to_numpy(zero_copy_only=False).copy()
            scored = ~pc.is_null(flat).to_numpy(zero_copy_only=False)
            if len(open_):
                row = np.repeat(np.arange(len(sizes)), np.diff(ends))
                starts = np.concatenate(([0], np.cumsum(np.bincount(row[open_], n[open_] - 1, len(sizes)).astype(np.int64))))
                some = np.flatnonzero(np.diff(starts)).tolist()
                counts = np.concatenate([_unpacked(packed[i].as_py(), int(starts[i + 1] - starts[i])) for i in some])
                where = np.repeat(starts[:-1], np.diff(_offsets(at)[0])) + pc.list_flatten(at).to_numpy(zero_copy_only=False)
                for column, given in ((0, c_ab), (1, c_a)):
                    more = pc.list_flatten(given).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    counts[where, column] = np.maximum(counts[where, column], more)
                of = np.repeat(np.arange(len(open_)), n[open_] - 1)
                logs = _minus_log(counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64), vocabulary, k)
                found[open_] = np.bincount(of, logs, len(open_)) / (n[open_] - 1)
                scored[open_] = True
            yield pa.ListArray.from_arrays(offsets, pa.array(found, mask=~scored), mask=none)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    of = [answers.getField(c) for c in ("at", "c_ab", "c_a")]
    return F.arrow_udf("array<double>")(run)(*partial, *of)
