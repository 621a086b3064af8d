"""Word classes learned from a corpus, as tags in place of a lexicon.

A word is described by what stands before and after it: how often each of the most frequent
words does, or any other. Classes are the parts of a mixture of such distributions, fitted by
reassigning every word to the class that makes its neighbours likeliest, until none moves.
Start and ties are fixed, so a corpus always gives the same classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.operators.features import bigram_model, entropy_of_tags
from scrivener.sources.scratch import stored

CLASSES, CONTEXTS = 16, 64
#: Words that get a class, the most frequent ones; all others are one class of rare words. About 40 bytes each go to every task.
VOCABULARY = 1 << 17
#: Frequent words among which the classes start, and rounds of reassignment at most.
STARTS, ROUNDS = 256, 30
SMOOTH = 0.5


def profiles(bigrams: DataFrame, contexts: int = CONTEXTS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(word, rank, cells): of the most frequent words, how often each neighbour occurs: cells (dim, n), at most 2 * contexts + 2 of them."""
    both = bigrams.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("c_ab").alias("n")), F.struct(F.col("b").alias("word"), F.col("c_ab").alias("n")))))
    top = both.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(vocabulary)
    top = stored(top, "words").orderBy(F.desc("n"), "word")
    frequent = [r["word"] for r in top.limit(contexts).collect()]
    spark = bigrams.sparkSession
    known = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(frequent)], "context string, place int"))
    rest = F.lit(contexts)
    after = bigrams.join(known, bigrams["b"] == known["context"], "left").select(F.col("a").alias("word"), F.coalesce("place", rest).alias("dim"), F.col("c_ab").alias("n"))
    before = bigrams.join(known, bigrams["a"] == known["context"], "left").select(F.col("b").alias("word"), (F.coalesce("place", rest) + contexts + 1).alias("dim"), F.col("c_ab").alias("n"))
    cells = after.unionByName(before).groupBy("word", "dim").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("dim", "n"))).alias("cells"))
    return top.withColumnRenamed("n", "count").join(cells, "word").select("word", "count", "cells")


def _dense(cells: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(cells), width))
    flat = pc.list_flatten(cells)
    rows = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
    out[rows, pc.struct_field(flat, "dim").to_numpy(zero_copy_only=False)] = pc.struct_field(flat, "n").to_numpy(zero_copy_only=False)
    return out


def _starts(rows: np.ndarray, classes: int) -> np.ndarray:
    """Distant rows: the first, then always the one farthest from those taken, by the roots of shares."""
    shares = np.sqrt(rows / rows.sum(axis=1, keepdims=True))
    picked = [0]
    off = ((shares - shares[0]) ** 2).sum(axis=1)
    while len(picked) < min(classes, len(rows)) and off.max() > 1e-12:
        picked.append(int(np.argmax(off)))
        off = np.minimum(off, ((shares - shares[picked[-1]]) ** 2).sum(axis=1))
    return rows[picked]


def _logs(sums: np.ndarray) -> np.ndarray:
    smoothed = sums + SMOOTH
    return np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def induce(corpus: DataFrame, text_col: str = "text", classes: int = CLASSES, contexts: int = CONTEXTS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(word, class): a class from 0 for each of the most frequent words of the corpus; classes are numbered by their most frequent word. No words, no rows."""
    bigrams, _, _ = bigram_model(corpus, text_col)
    width = 2 * contexts + 2
    words = stored(profiles(stored(bigrams, "bigrams"), contexts, vocabulary), "profiles")
    first = words.orderBy(F.desc("count"), "word").limit(STARTS).toArrow().combine_chunks()
    if not first.num_rows:
        return words.select("word", F.lit(0).alias("class"))
    logs = _logs(_starts(_dense(first["cells"].chunk(0), width), classes))

    def summed(logs: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(logs.shape)
            for batch in batches:
                dense = _dense(batch.column(1), width)
                own = np.argmax(dense @ logs.T, axis=1)
                np.add.at(total, own, dense)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

        return run

    sums = np.zeros(logs.shape)
    for _ in range(ROUNDS):
        # whole numbers, so their sums are the same in any order
        parts = words.select("word", "cells").mapInArrow(summed(logs), "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        found = np.zeros(logs.size)
        for r in parts:
            found[r["at"]] = r["v"]
        found = found.reshape(logs.shape)
        if (found == sums).all():
            break
        sums, logs = found, _logs(found)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(_dense(batch.column(1), width) @ logs.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own.astype(np.int32))], ["word", "count", "part"])

    named = stored(words.select("word", "cells", "count").mapInArrow(assigned, "word string, count bigint, part int"), "classes")
    # a row a class
    heads = sorted(named.groupBy("part").agg(F.max(F.struct("count", "word")).alias("head")).collect(), key=lambda r: (-r["head"]["count"], r["head"]["word"]))
    number = {r["part"]: i for i, r in enumerate(heads)}
    return named.select("word", F.array(*[F.lit(number.get(k, -1)) for k in range(len(logs))])[F.col("part")].alias("class"))


def tagger(classes: DataFrame, vocabulary: int = VOCABULARY) -> Callable[[Column], Column]:
    """A function from an array of tokens to the array of their tags: ``C`` and the class, ``NUM``, or ``RARE`` for words without one."""
    held = classes.orderBy("word").limit(vocabulary + 1).toArrow().combine_chunks()
    if held.num_rows > vocabulary:
        raise ValueError(f"more than {vocabulary} words have a class")
    words = pa.array(held["word"].to_pylist(), pa.string())
    names = np.array([f"C{c}" for c in held["class"].to_pylist()] + ["RARE", "NUM"], object)
    shipped = classes.sparkSession.sparkContext.broadcast((words, names))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, names = shipped.value
        for part in parts:
            flat = pc.list_flatten(part).dictionary_encode()
            place = pc.index_in(flat.dictionary, value_set=words).fill_null(len(names) - 2).to_numpy(zero_copy_only=False).astype(np.int64)
            digits = pc.match_substring_regex(flat.dictionary, r"^\p{N}").to_numpy(zero_copy_only=False)
            place = np.where(digits & (place == len(names) - 2), len(names) - 1, place)
            tags = names[place][flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, object)
            lengths = pc.list_value_length(part)
            offsets = np.concatenate(([0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(tags, pa.string()), mask=pc.is_null(lengths))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lambda tokens: F.arrow_udf("array<string>")(run)(tokens)


def learned_entropy(docs: DataFrame, tags: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entropy in bits of trigrams of learned tags, across sentences: (id, pos_3gram_entropy, pos_reason)."""
    rows = docs.select(F.col(id_col).alias("id"), tags(T.tokens(F.coalesce(F.col(text_col), F.lit("")), T.COUNTED)).alias("__g"))
    return entropy_of_tags(rows).drop("__g")
