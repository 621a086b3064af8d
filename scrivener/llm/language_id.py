"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent n-grams of letters (one to three,
words padded with a separator). A document is compared with each profile by the
out-of-place distance: the sum, over the document's own most frequent n-grams, of how
far each is from its place in the profile, and the profile's length where it is absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import stored

#: n-grams in a profile, of a language and of a document.
PROFILE = 400
GRAM = 3
UNKNOWN = "und"
#: n-grams that a task counts for a language before it hands them on.
FLUSH = 1 << 21
#: Profile rows that are sent to a task at once; with more, languages are compared in parts.
MAX_PROFILE_ROWS = 1 << 20
FOLDS, HELD_OUT = 4, 2


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else 0."""
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, each packed in 63 bits, and their counts."""
    empty = np.zeros(0, np.int64)
    if not text:
        return empty, empty
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not points.any():
        return empty, empty
    # one separator between words and at both ends
    padded = np.concatenate(([0], points, [0])).astype(np.int64)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    p = padded[keep]
    one = p[p != 0]
    two = p[:-1] | p[1:] << 21
    three = (p[:-2] | p[1:-1] << 21 | p[2:] << 42)[p[1:-1] != 0]
    # lengths are told apart by what they hold: a one-gram has no second letter, and a
    # three-gram with a last separator differs from a two-gram by a marker in bit 63
    return np.unique(np.concatenate((one, two | np.int64(1) << 62, three | np.int64(-1) << 63)), return_counts=True)


def _top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        distinct, where = np.unique(codes, return_inverse=True)
        return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)

    def out(lang: str) -> pa.RecordBatch:
        codes, counts = merged(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = grams(text.as_py())
            if len(found[0]):
                held.setdefault(lang, []).append(found)
                sizes[lang] = sizes.get(lang, 0) + len(found[0])
            if sizes.get(lang, 0) > FLUSH:
                held[lang] = [merged(lang)]
                sizes[lang] = len(held[lang][0][0])
                if sizes[lang] > FLUSH // 2:
                    yield out(lang)
                    del held[lang], sizes[lang]
    for lang in list(held):
        yield out(lang)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """The profiles (lang, place from 0, code) of all rows with a language."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", (F.col("place") - 1).alias("place"), "code")


def _parts(profiles: DataFrame, most: int) -> list[DataFrame]:
    """The profiles in ranges of languages of at most ``most`` rows, or of one language."""
    sizes = profiles.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    if sum(s["count"] for s in sizes) <= most:
        return [profiles]
    firsts, held = [], most + 1
    for s in sizes:
        if held + s["count"] > most:
            firsts.append(s["lang"])
            held = 0
        held += s["count"]
    ends = [*firsts[1:], None]
    return [profiles.filter((F.col("lang") >= a) & (F.lit(True) if b is None else F.col("lang") < b)) for a, b in zip(firsts, ends, strict=True)]


def _table(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, the codes of all profiles in order, where each code's entries start, and of every entry its language and place.

    One entry a profile row, so that memory follows the rows and not languages times codes.
    """
    rows = profiles.toArrow()
    named = rows["lang"].dictionary_encode().combine_chunks()
    given = named.dictionary.to_pylist()
    langs = sorted(given)
    index = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([index[x] for x in given], np.int32)[named.indices.to_numpy()]
    order = np.argsort(rows["code"].to_numpy(), kind="stable")
    codes, starts = np.unique(rows["code"].to_numpy()[order], return_index=True)
    return langs, codes, np.append(starts, len(order)).astype(np.int64), lang[order], rows["place"].to_numpy()[order].astype(np.int32)


def _predict(langs: list[str], codes: np.ndarray, starts: np.ndarray, lang: np.ndarray, place: np.ndarray, size: int, text: str | None) -> tuple[str, float]:
    found, counts = grams(text)
    if not len(found) or not langs:
        return UNKNOWN, 0.0
    own = _top(found, counts, size)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    held = np.where(codes[at] == own, starts[at + 1] - starts[at], 0)
    # the entries of all own codes, one run after another
    entry = np.arange(held.sum()) + np.repeat(starts[at] - np.cumsum(held) + held, held)
    near = size - np.abs(place[entry] - np.repeat(np.arange(len(own)), held))
    off = size * len(own) - np.bincount(lang[entry], near, len(langs))
    best = int(np.argmin(off))
    return langs[best], float(1 - off[best] / (size * len(own)))


def _nearest(rows: DataFrame, profiles: DataFrame, size: int) -> DataFrame:
    """``rows`` (doc, text, lang, score) with the language of ``profiles`` where it scores higher."""
    table = rows.sparkSession.sparkContext.broadcast(_table(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = table.value
        for batch in batches:
            found = [_predict(*learned, size, t.as_py()) for t in batch.column(1)]
            best = [f if f[0] != UNKNOWN and (lang == UNKNOWN or f[1] > score) else (lang, score) for f, lang, score in zip(found, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "text", "lang", "score"])

    return rows.mapInArrow(run, rows.schema)


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = PROFILE, most: int = MAX_PROFILE_ROWS) -> DataFrame:
    """(doc, lang, score): each row of ``docs`` as a struct, its language and score (1: same order as the profile, 0: nothing shared).

    The language is ``und`` with score 0 where the text is null or has no letter, or
    nothing was learned. Distances that tie go to the language that sorts first.
    ``profiles`` is read once for each part of ``most`` rows; columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).cast("string").alias("text"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    for part in _parts(profiles, most):
        rows = _nearest(rows, part, size)
    return rows.select("doc", "lang", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, most: int = MAX_PROFILE_ROWS) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row.

    Returns the identifier, held_out (crc32 of the identifier as text, modulo 4, is 2),
    lang_pred and score. Rows with a null identifier or language teach nothing; a null
    identifier is not held out; repeated rows count each; empty tables give no rows.
    """
    own = fold(id_col, FOLDS)
    # learned once: sizes and rows of the profiles are both asked for
    profiles = stored(learn_profiles(docs.filter(own != HELD_OUT), text_col, lang_col, size), "profiles")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(own == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    found = identify(rows, profiles, "text", size, most)
    return found.select(F.col("doc.id").alias(id_col), "doc.held_out", F.col("lang").alias("lang_pred"), "score")
