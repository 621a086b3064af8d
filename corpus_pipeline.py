"""Corpus preparation in five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``; ``run`` writes each result to the shared folder as Parquet
and reads it again, so no stage recomputes another and a lost executor costs one stage.

Every stage accepts an empty table, repeated rows, nulls in any column, texts of any
length and further columns of any name, which it carries along; its docstring says what
becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import bpe, exact_dedup, language_id, mixing, simhash
from scrivener.llm.common import read_table, stored

#: Documents that share less than this with every language's profile are rejected, whatever their language's own floor.
MIN_LANGUAGE_SCORE = 0.05
#: A language's floor lies below this quantile of its own documents' scores by so many times what that lies below their median.
LOW_QUANTILE, SPREADS = 0.01, 1.5
SCORE_STEPS = 1000
RANKS = "byte_bpe_50k.tiktoken"
#: Differing fingerprint bits of near copies: wider than the query's three, as one changed
#: word in two hundred moves three or four bits. Unrelated texts differ by 32 on average.
NEAR_RADIUS = 5
#: What an encoding worker remembers: less than alone, as four stages before it have filled the executors' heaps.
MAX_PIECES, MAX_STATES = 1 << 17, 1 << 16


def language_floors(found: DataFrame) -> list[tuple[str, float]]:
    """The least score of each language, by the scores of rows that are labelled with it and taken for it."""
    own = found.filter(F.col("doc.lang").cast("string") == F.col("lang"))
    counts: dict[str, dict[int, int]] = {}
    # one row a language and step of the score
    for r in own.groupBy("lang", F.floor(F.col("score") * SCORE_STEPS).cast("int").alias("step")).count().collect():
        counts.setdefault(r["lang"], {})[r["step"]] = r["count"]

    def at(steps: dict[int, int], share: float) -> int:
        left = share * sum(steps.values())
        for step in sorted(steps):
            left -= steps[step]
            if left <= 0:
                return step
        return max(steps)

    low = {lang: at(steps, LOW_QUANTILE) for lang, steps in counts.items()}
    return [(lang, max(MIN_LANGUAGE_SCORE, (low[lang] - SPREADS * (at(steps, 0.5) - low[lang])) / SCORE_STEPS)) for lang, steps in counts.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or that are farther from every learned language than its own documents are.

    Null, empty and letterless texts go. A null language or identifier teaches nothing,
    and its document is judged by its text. Repeated rows share one fate. Where nothing
    is labelled no language is known, and every document goes.
    """
    taught = docs.filter(language_id.fold("doc_id", language_id.FOLDS) != language_id.HELD_OUT)
    profiles = language_id.learn_profiles(taught)
    # learned once, as both the floors and the documents are scored by them
    profiles = stored(profiles, "profiles")
    floors = spark.createDataFrame(language_floors(language_id.identify(taught, profiles)), "of string, floor double")
    found = language_id.identify(docs, profiles).join(F.broadcast(floors), F.col("lang") == F.col("of"), "left")
    kept = found.filter((F.col("lang") != language_id.UNKNOWN) & (F.col("score") >= F.coalesce("floor", F.lit(MIN_LANGUAGE_SCORE))))
    return kept.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays.

    A null text is empty. A null identifier stays only where all of its text's are null;
    of repeated rows, and of rows that share identifier and text, one stays.
    """
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked SimHash fingerprints the document with the smallest identifier stays.

    Texts without words are one group. A null identifier stays only where all of its
    group's are null; of rows that share the identifier that stays, one stays.
    """
    return simhash.representatives(docs, radius=NEAR_RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order.

    Texts without words are not taken. A null source is a source of its own, a null
    identifier sorts first, and repeated rows are documents each.
    """
    order = mixing.training_order(mixing.mix_sources(docs, keep=tuple(docs.columns)))
    return order.select(*[F.col(f"kept.`{c}`") for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every text, and whether decoding gives the text back.

    Null and empty texts have no tokens; one row for each row that comes in.
    """
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, verify_col="round_trip", max_pieces=MAX_PIECES, max_states=MAX_STATES)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]

#: Profiles, fingerprints and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
