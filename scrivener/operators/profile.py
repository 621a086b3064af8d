"""Reconstruction of segmented texts, data profiling, text-quality checks and stability summaries."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrivener.functions import text as T
from scrivener.functions.stats import ratio, variation


def reconstruct_concat(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text): the stripped, non-blank parts in order, joined by one space."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: T.strip(s["t"]))
    return rows.groupBy(key).agg(F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("text"))


def _painted(starts: list[int], ends: list[int], texts: list[str], extra: int) -> str:
    """Spans in order, later ones on top, over spaces: the ends cut the line into gaps, and each gap is read from the last span that covers it."""
    cuts = sorted({0, *(max(0, s) for s in starts), *(max(0, e + extra) for e in ends)})
    out, active, given = [], [], 0
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        while given < len(starts) and starts[given] <= low:
            heapq.heappush(active, -given)
            given += 1
        while active and ends[-active[0]] + extra <= low:
            heapq.heappop(active)
        if active:
            top = -active[0]
            out.append((texts[top] or "")[low - starts[top] : high - starts[top]].ljust(high - low))
        else:
            out.append(" " * (high - low))
    return "".join(out)


def overlay_sweep(spans: Column, inclusive_end: bool = True) -> Column:
    """The text of an array of (start, end, id, text) spans, laid over a line of spaces in order of start, end and id; n log n for n spans."""
    extra = 1 if inclusive_end else 0

    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in parts:
            yield pa.array([None if row[0] is None else _painted(*row, extra) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    ordered = F.array_sort(spans)
    return F.arrow_udf("string")(run)(*[ordered.getField(name) for name in ("start", "end", "text")])


def reconstruct_overlay(rows: DataFrame, key: str, start: str, end: str, ident: str, text: str, inclusive_end: bool = True) -> DataFrame:
    """(key, text, ok, matched, total): spans laid over spaces by their offsets, later ones on top.

    ``matched`` of ``total`` spans have the length that their offsets give them; ``ok`` says that all have.
    """
    extra = 1 if inclusive_end else 0
    span = F.struct(F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(ident).cast("string").alias("id"), F.col(text).alias("text"))
    fits = F.length(F.col(text)) == F.col(end) - F.col(start) + extra
    held = rows.groupBy(key).agg(F.collect_list(span).alias("__spans"), F.count_if(fits).alias("matched"), F.count("*").alias("total"))
    return held.select(key, overlay_sweep(F.col("__spans"), inclusive_end).alias("text"), (F.col("matched") == F.col("total")).alias("ok"), "matched", "total")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) by falling count, then value; ``(none)`` stands for null."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def infer_type(values: Column) -> Column:
    """As an aggregate over strings, blank ones aside: empty, int, float or string."""
    some = values.isNotNull() & (values != "")
    whole = F.count_if(some & ~values.rlike(r"^\s*[+-]?\d+\s*$"))
    number = F.count_if(some & values.try_cast("double").isNull())
    return F.when(F.count_if(some) == 0, "empty").when(whole == 0, "int").when(number == 0, "float").otherwise("string")


def infer_types(rows: DataFrame) -> DataFrame:
    """(column_name, dtype) of every column, read as strings."""
    found = rows.agg(*[infer_type(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("dtype")) for i, c in enumerate(rows.columns)]
    return found.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def length_distribution(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    q = lambda p: F.percentile(n, F.lit(p))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(n).alias("min_len"), q(0.5).alias("median_len"), q(0.9).alias("p90_len"), q(0.95).alias("p95_len"), F.max(n).alias("max_len"))


def foreign_key_check(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Distinct non-blank keys, how many have no counterpart, and whether all join."""
    keys = rows.select(F.col(key).alias("k")).filter(F.col("k").isNotNull() & (F.col("k").cast("string") != "")).distinct()
    known = other.select(F.col(other_key).alias("o")).distinct()
    joined = keys.join(known, keys["k"] == known["o"], "left")
    return joined.agg(F.count("*").alias("distinct_keys"), F.count_if(F.col("o").isNull()).alias("missing"), (F.count_if(F.col("o").isNull()) == 0).alias("joinable"))


def span_summary(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: first start, last end, rows and the length between them, 0 at least."""
    out = rows.groupBy(key).agg(F.min(start).alias("min_start"), F.max(end).alias("max_end"), F.count("*").alias("rows"))
    return out.withColumn("approx_len", F.greatest(F.lit(0), F.col("max_end") - F.col("min_start")))


def map_spans(spans: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Spans (key, span_id, start, end) and the targets (key, target_id, start, end) of the same key that they overlap: (key, span_id, target_id), offsets half-open.

    Both lists are merged in order of their offsets, once: how many targets start before a
    span's end, and how many have all ended by its start, are the ends of a run of targets
    that it is joined to by number. Targets may overlap one another; those of a run that
    ended early are left out at the end. A span_id names one span of its key.
    """
    order = Window.partitionBy(key).orderBy("start", "end", "target_id")
    numbered = targets.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "reach": F.max("end").over(order)})
    none, one, no = F.lit(None), F.lit(1).cast("long"), F.lit(0).cast("long")
    event = lambda pos, rank, starts, ends, ask: F.struct(pos.cast("long").alias("pos"), F.lit(rank).alias("rank"), starts.alias("starts"), ends.alias("ends"), F.lit(ask).alias("ask"))
    # of equal offsets: ends of targets, then spans, then starts of targets
    of_targets = F.array(event(F.col("start"), 2, one, no, ""), event(F.col("reach"), 0, no, one, ""))
    of_spans = F.array(event(F.col("start"), 1, no, no, "first"), event(F.col("end"), 1, no, no, "last"))
    both = numbered.select(key, none.cast(dict(spans.dtypes)["span_id"]).alias("span_id"), none.cast("long").alias("start"), F.inline(of_targets)).unionByName(spans.select(key, "span_id", F.col("start").cast("long").alias("start"), F.inline(of_spans)))
    upto = Window.partitionBy(key).orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumns({"started": F.sum("starts").over(upto), "ended": F.sum("ends").over(upto)}).filter("ask <> ''")
    run = counted.groupBy(key, "span_id").agg(F.max(F.when(F.col("ask") == "first", F.col("ended"))).alias("first"), F.max(F.when(F.col("ask") == "last", F.col("started"))).alias("last"), F.max("start").alias("span_start"))
    asked = run.filter("first < last").select(key, "span_id", "span_start", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("at"))
    met = asked.join(numbered.select(key, "at", "end", "target_id"), [key, "at"])
    return met.filter(F.col("end") > F.col("span_start")).select(key, "span_id", "target_id")


def sentence_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_id, start, end): where each raw sentence match lies; matches follow each other without gaps."""
    raw = F.regexp_extract_all(F.col(text_col), F.lit(T.SENTENCE), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(raw).alias("p", "s"))
    end = F.sum(F.length("s").cast("long")).over(Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).select("id", (F.col("p") + 1).alias("sentence_id"), (F.col("end") - F.length("s")).alias("start"), "end")


def repeated_ngram_ratio(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, repeated_ngram_ratio): repeats beyond the first over all n-grams of words; null below 2n words."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(_with_repeats, n).drop("text")


def _with_repeats(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (with a column text) and repeated_ngram_ratio, counted inside the row."""
    kept = rows.columns
    words = T.tokens(F.coalesce(F.col("text"), F.lit("")), T.WORDLIKE)
    rows = rows.select(*kept, words.alias("__w")).select(*kept, F.when(F.size("__w") >= 2 * n, T.grams(F.col("__w"), n)).alias("__g"))
    return rows.select(*kept, F.when(F.col("__g").isNotNull(), ratio(F.size("__g") - F.size(F.array_distinct("__g")), F.size("__g"))).alias("repeated_ngram_ratio"))


# What a generated text must not say, and words of the task that it should say.
LEAKAGE = ("as an ai", "language model", "prompt", "instruction", "controlled local generation", "experiment")
KEYWORDS = ("setback", "changed", "approach", "learned", "reflection", "mistake")


def quality_checks(docs: DataFrame, keywords: tuple[str, ...] = KEYWORDS, leakage: tuple[str, ...] = LEAKAGE, low: int = 250, high: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Checks of a generated text: size, leakage, keywords, ending and repetition, by one pass without an exchange.

    A null text is empty. Up to five repeated lines are named, in the order of their first places.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = _with_repeats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), 4)
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), T.strip), lambda x: x != "")
    found = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda term: F.contains(F.lower(t), term))
    rows = rows.select(
        "id", "repeated_ngram_ratio", T.strip(t).alias("t"), T.regex_word_count(t).alias("words"), found(leakage).alias("leaked_terms"), found(keywords).alias("keyword_hits"),
        F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))).alias("lines"),
    )
    # of each line that occurs again, its first place: sorted, equal lines follow each other
    before, after = (F.concat(F.array(F.lit(None).cast("struct<x:string,i:int>")), F.slice("lines", 1, F.size("lines"))), F.slice("lines", 2, F.size("lines")))
    firsts = F.zip_with(F.zip_with("lines", F.slice(before, 1, F.size("lines")), lambda x, y: F.when(y.isNull() | (x["x"] != y["x"]), x)), after, lambda x, y: F.when(x.isNotNull() & (x["x"] == y["x"]), F.struct(x["i"].alias("i"), x["x"].alias("x"))))
    rows = rows.withColumn("repeats", F.sort_array(F.filter(firsts, lambda x: x.isNotNull())))
    return rows.select(
        "id", (F.col("t") != "").alias("non_empty"), "words", F.col("words").between(low, high).alias("length_ok"), F.array_join("leaked_terms", "|").alias("leaked_terms"), (F.size("leaked_terms") == 0).alias("no_leakage"),
        F.array_join("keyword_hits", "|").alias("keyword_hits"), (F.size("keyword_hits") >= 2).alias("keywords_ok"), F.col("t").rlike(r"[.!?][\"')\]]?\s*$").alias("ends_ok"), "repeated_ngram_ratio",
        F.array_join(F.transform(F.slice("repeats", 1, 5), lambda x: x["x"]), "|").alias("repeated_lines"),
        ((F.coalesce("repeated_ngram_ratio", F.lit(0.0)) > 0.08) | (F.size("repeats") > 0)).alias("repetitive"),
    )


def pilot_score(words: Column, grade: Column, independent: Column, rows: Column) -> Column:
    """20 for grade 9 or 10, up to 30 for length, 2 for the task and up to 8 for the number of segments."""
    length = F.when(words.between(500, 1500), 30.0).otherwise(F.greatest(F.lit(0.0), 30 - F.abs(words - 1000) / 100))
    return F.when(grade.isin(9, 10), 20.0).otherwise(0.0) + length + F.when(independent, 2.0).otherwise(0.0) + F.least(F.lit(8.0), F.log2(F.greatest(F.lit(1), rows).cast("double")))


def prefix_rows(docs: DataFrame, targets: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, target, n_tokens, text): the first min(target, n) lexical tokens of every document."""
    rows = docs.select(F.col(id_col).alias("id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"), F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return rows.select("id", "target", F.least("target", F.size("w")).alias("n_tokens"), F.slice("w", 1, F.col("target")).alias("w"))


def summary_by_target(rows: DataFrame, value: str) -> DataFrame:
    """Count, mean, median, range and variation by target; the mean sums nine decimals exactly, so the order of rows does not show in it."""
    mean = F.sum(F.col(value).cast("decimal(28,9)")).cast("double") / F.count("*")
    return rows.filter(F.col(value).isNotNull()).groupBy("target").agg(F.count("*").alias("n"), mean.alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_samp(value).alias("stdev"), variation(F.col(value)).alias("cv"))


def drift(rows: DataFrame, value: str) -> DataFrame:
    """Change from the previous and from the first measurement of a document, by token count."""
    by = Window.partitionBy("id").orderBy("n_tokens", "target")
    before = F.lag(value).over(by)
    first = F.first_value(F.col(value)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("id", "target", (F.col(value) - before).alias("delta_from_previous"), ratio(F.col(value) - before, before).alias("relative_delta"), (F.col(value) - first).alias("delta_from_first"))


def first_to_final(rows: DataFrame, value: str) -> DataFrame:
    """(id, points, first, final, absolute_change, relative_change): a document's measurements that exist, by token count."""
    place = F.struct("n_tokens", "target")
    held = rows.filter(F.col(value).isNotNull()).groupBy("id").agg(F.count("*").alias("points"), F.min_by(value, place).alias("first"), F.max_by(value, place).alias("final"))
    change = F.col("final") - F.col("first")
    return held.select("id", "points", "first", "final", change.alias("absolute_change"), ratio(change, F.col("first")).alias("relative_change"))


def reproducibility(runs: DataFrame, key: str, order: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Largest absolute difference of each key's values from its first run; null below two runs."""
    first = F.first_value(F.col(value)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = runs.filter(F.col(value).isNotNull()).withColumn("__d", F.abs(F.col(value) - first))
    out = rows.groupBy(key).agg(F.when(F.count("*") >= 2, F.max("__d")).alias("max_absolute_difference"))
    return out.withColumn("effectively_identical", F.col("max_absolute_difference") <= tolerance)


def normalised(text: Column) -> Column:
    """A view for comparison only: line ends and white space made one; ``nfc`` composes characters before it where texts need it."""
    return T.normalise_spaces(F.regexp_replace(text, "\r\n?", "\n"))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Texts in Unicode normalisation form C, which no built-in function gives; null for null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalised_view(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, view_sha256, changed): the text as it is, and its view for comparison; a null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t")).withColumn("view", normalised(nfc("t")))
    return rows.select("id", F.sha2("t", 256).alias("text_sha256"), F.sha2("view", 256).alias("view_sha256"), (F.col("t") != F.col("view")).alias("changed"))


MANIFEST = ("document_id", "family_id", "category", "source_id", "topic_id", "language", "word_count", "generation_model", "transformation_type", "transformation_regions", "split", "dataset_version")


def corpus_manifest(docs: DataFrame, split: Column, version: str) -> DataFrame:
    """The twelve columns of a document manifest; columns that ``docs`` lacks are null, word_count comes from its text."""
    given = {c: F.col(c).cast("string") for c in docs.columns}
    given |= {"word_count": T.word_count(F.coalesce(F.col("text"), F.lit(""))), "split": split, "dataset_version": F.lit(version)}
    return docs.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in MANIFEST])


def copies(rows: DataFrame, key: str, text: str, family: str) -> DataFrame:
    """Texts that are equal after normalisation but belong to more than one family: leakage across a split by family."""
    digest = F.sha2(normalised(F.coalesce(F.col(text), F.lit(""))), 256)
    return rows.groupBy(digest.alias("text_hash")).agg(F.count("*").alias("n"), F.count_distinct(family).alias("families"), F.min(key).alias("first_id")).filter("families > 1")


def chat_prompts(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, prompt): the turns of a conversation in order, one ``role: text`` a line."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(": ", "role", "text").alias("t"))))
    return turns.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("prompt"))


def inclusion(docs: DataFrame, languages: tuple[str, ...], least_words: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, verdict): ``included``, or the first criterion that a document fails.

    Of equal normalised texts the smallest identifier is the one that counts. Copies are
    found by hash with one grouping, joined back by hash.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), T.word_count(t).alias("words"), F.sha2(normalised(t), 256).alias("h"), t.rlike(r"[\x00-\x08\uFFFD]").alias("damaged"))
    first = rows.groupBy("h").agg(F.min("id").alias("first"))
    verdict = (
        F.when(~F.coalesce(F.col("lang").isin(*languages), F.lit(False)), "other_language").when(F.col("words") < least_words, "too_short")
        .when(F.col("damaged"), "damaged").when(F.col("id") != F.col("first"), "duplicate").otherwise("included")
    )
    return rows.join(first, "h").select("id", verdict.alias("verdict"))


def manifest_rows(docs: DataFrame, split: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: identifier, family, language, words, text hash and split."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("document_id"), F.col("source").alias("family_id"), F.col("lang").alias("language"), T.word_count(t).alias("word_count"), F.sha2(t, 256).alias("text_sha256"), split.alias("split"))


def runtime_summary(runs: DataFrame, order: str, seconds: str, tokens: str) -> DataFrame:
    """Median and first latency, and median tokens a second, of timed runs."""
    return runs.agg(F.median(seconds).alias("median_seconds"), F.min_by(seconds, order).alias("first_seconds"), F.median(ratio(F.col(tokens), F.col(seconds))).alias("median_tokens_per_second"))
