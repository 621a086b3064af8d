"""What a document's probability loses without each of its sentences, by removing them from its counts.

Nothing is measured twice: sums of sentence lengths lose the sentence's own; windows of
tokens that lie before or after it keep their distinct counts, and only those across the
cut are counted; tag trigrams inside it leave the entropy's sum and the two across the cut
enter it; the median of the other perplexities is read off by rank. Work grows with the
document's tokens, not with tokens times sentences.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.operators import features as X
from scrivener.operators.scoring import TextScorer

CELL = "struct<left_out:int,perplexity:double,sentence_length_cv:double,mattr:double,pos_3gram_entropy:double>"

Features = tuple[float | None, float | None, float | None, float | None]


def _distinct(tokens: list, window: int) -> list[int]:
    """Distinct tokens of every full window."""
    held: dict = {}
    out = []
    for i, t in enumerate(tokens):
        held[t] = held.get(t, 0) + 1
        if i >= window:
            old = tokens[i - window]
            held[old] -= 1
            if not held[old]:
                del held[old]
        if i >= window - 1:
            out.append(len(held))
    return out


def _sums(values: list[int]) -> list[int]:
    out = [0]
    for v in values:
        out.append(out[-1] + v)
    return out


def _variation(n: int, s: int, q: int) -> float | None:
    return math.sqrt((n * q - s * s) / (n * (n - 1))) / (s / n) if n >= 2 and s > 0 else None


class Document:
    """The counts of one document, from which each sentence is taken away in turn.

    ``bare`` marks sentences of closing marks alone, which are none where they come first.
    """

    def __init__(self, words: list[list[str]], tags: list[list[str]], perplexities: list[float | None], bare: list[bool], window: int = X.MATTR_WINDOW):
        self.window, self.perplexities, self.bare = window, perplexities, bare
        self.words = [w for s in words for w in s]
        self.word_ends = _sums([len(s) for s in words])
        self.distinct = _sums(_distinct(self.words, window))
        self.tags = [t for s in tags for t in s]
        self.tag_ends = _sums([len(s) for s in tags])
        self.trigrams = Counter(zip(self.tags, self.tags[1:], self.tags[2:], strict=False))
        self.weighted = sum(c * math.log2(c) for c in self.trigrams.values())
        self.lengths = [len(s) for s in tags]
        # marks before the first real sentence, and those that would come first without it
        self.leading = next((i for i, b in enumerate(bare) if not b), len(bare))
        self.next_real = next((i for i in range(self.leading + 1, len(bare)) if not bare[i]), len(bare))
        real = range(self.leading, len(bare))
        self.moments = (len(real), sum(self.lengths[i] for i in real), sum(self.lengths[i] ** 2 for i in real))
        self.ranked = sorted((perplexities[i], i) for i in real if perplexities[i] is not None)

    def whole(self) -> Features:
        return self._median(()), _variation(*self.moments), self._mattr(0, 0), self._entropy(0, 0)

    def without(self, i: int) -> Features:
        # without the first real sentence, marks right after it come first and go too
        gone = () if i < self.leading else range(i, self.next_real) if i == self.leading else (i,)
        n, s, q = self.moments
        for g in gone:
            n, s, q = n - 1, s - self.lengths[g], q - self.lengths[g] ** 2
        return self._median(gone), _variation(n, s, q), self._mattr(self.word_ends[i], self.word_ends[i + 1]), self._entropy(self.tag_ends[i], self.tag_ends[i + 1])

    def _median(self, gone) -> float | None:
        places = sorted(bisect_left(self.ranked, (self.perplexities[g], g)) for g in gone if self.perplexities[g] is not None)
        n = len(self.ranked) - len(places)
        if not n:
            return None

        def at(k: int) -> float:
            for p in places:
                k += p <= k
            return self.ranked[k][0]

        return (at((n - 1) // 2) + at(n // 2)) / 2

    def _mattr(self, a: int, b: int) -> float | None:
        """Without the words from a to b."""
        window, n = self.window, len(self.words) - (b - a)
        if n < window:
            return None
        if a == b:
            total = self.distinct[-1]
        else:
            last = len(self.distinct) - 1
            before, after = max(0, min(a - window + 1, last)), min(b, last)
            across = self.words[max(0, a - window + 1) : a] + self.words[b : b + window - 1]
            total = self.distinct[before] + self.distinct[last] - self.distinct[after] + sum(_distinct(across, window))
        return total / (window * (n - window + 1))

    def _entropy(self, a: int, b: int) -> float | None:
        """Without the tags from a to b."""
        tags, n = self.tags, len(self.tags) - (b - a)
        if n < 3:
            return None
        change: dict[tuple, int] = {}
        if a < b:
            for k in range(max(0, a - 2), min(b, len(tags) - 2)):
                g = (tags[k], tags[k + 1], tags[k + 2])
                change[g] = change.get(g, 0) - 1
            across = tags[max(0, a - 2) : a] + tags[b : b + 2]
            for g in zip(across, across[1:], across[2:], strict=False):
                change[g] = change.get(g, 0) + 1
        total = self.weighted
        for g, d in change.items():
            c = self.trigrams[g]
            total += ((c + d) * math.log2(c + d) if c + d else 0.0) - (c * math.log2(c) if c else 0.0)
        return math.log2(n - 2) - total / (n - 2)


def _run(words: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("left_out", pa.int32()), *[(f, pa.float64()) for f in X.FEATURES]]))
    for columns in words:
        out = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            document = Document(*row)
            found = [(-1, document.whole()), *[(i, document.without(i)) for i in range(len(row[0]))]]
            out.append([{"left_out": i, **dict(zip(X.FEATURES, f, strict=True))} for i, f in found])
        yield pa.array(out, kind)


_run.__annotations__ = {"words": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}


def without_each(documents: DataFrame, corpus: DataFrame | X.LanguageModel | None, scorer: TextScorer | None = None) -> DataFrame:
    """``documents`` (id, s, ...), s an array of (hybrid_index, origin, text, ...) in order, with ``variants``.

    Those are the features of the whole document (left_out -1, first) and without each of
    its sentences, null where they cannot be given. Every sentence but the last must end
    with a mark, as spliced ones do; then they are what the joined text would be cut into.
    """
    kept = documents.columns
    rows = documents.withColumn("text", F.lit(None).cast("string"))
    rows = X.with_sentences(rows, corpus, scorer=scorer, given=F.transform("s", lambda x: x["text"])).drop("text")
    texts = F.transform("sentences", lambda x: x["sentence"])
    columns = (
        F.transform(texts, lambda t: T.tokens(t)), F.transform(texts, lambda t: F.transform(T.tokens(t, T.COUNTED), T.tag)),
        F.transform("sentences", lambda x: x["perplexity"]), F.transform(texts, lambda t: t.rlike(r"^[.!?]")),
    )
    names = ("__words", "__tags", "__ppl", "__bare")
    rows = rows.select(*kept, *[c.alias(n) for c, n in zip(columns, names, strict=True)])
    return rows.select(*kept, F.arrow_udf(f"array<{CELL}>")(_run)(*names).alias("variants"))
