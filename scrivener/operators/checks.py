"""Checks that a run must pass, each a row (check_name, passed) computed from the run's own relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import finite
from scrivener.operators.features import FEATURES


def as_rows(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One aggregate pass over ``rows``; an empty table passes every check."""
    found = rows.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(f"c{i}") for i, c in enumerate(checks.values())])
    cells = [F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("passed")) for i, name in enumerate(checks)]
    return found.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def feature_checks(table: DataFrame) -> DataFrame:
    """A value or a reason, never both; values finite and within their range."""
    reasons = ("perplexity_reason", "cv_reason", "mattr_reason", "pos_reason")
    either = F.lit(True)
    whole = F.lit(True)
    for name, reason in zip(FEATURES, reasons, strict=True):
        either = either & (F.col(name).isNull() == F.col(reason).isNotNull())
        whole = whole & (F.col(name).isNull() | finite(F.col(name)).isNotNull())
    ok = lambda name, test: F.col(name).isNull() | test
    return as_rows(table, {
        "value_or_reason": either, "finite_values": whole, "perplexity_positive": ok("perplexity", F.col("perplexity") > 0), "cv_not_negative": ok("sentence_length_cv", F.col("sentence_length_cv") >= 0),
        "mattr_in_range": ok("mattr", F.col("mattr").between(0, 1)), "entropy_not_negative": ok("pos_3gram_entropy", F.col("pos_3gram_entropy") >= -1e-9),
    })


def pair_checks(pairs: DataFrame) -> DataFrame:
    unique = pairs.groupBy("pair_id").agg(F.count("*").alias("n"), F.bool_and(F.col("human_text").isNotNull() & F.col("ai_text").isNotNull()).alias("both"))
    return as_rows(unique, {"unique_pair_ids": F.col("n") == 1, "both_sides": F.col("both")})


def hybrid_checks(hybrid: DataFrame) -> DataFrame:
    """Two inserted sentences, dense indexes from 0, and sources in rising order."""
    docs = hybrid.groupBy("pair_id").agg(F.count_if(F.col("origin") == "ai_inserted").alias("inserted"), F.count("*").alias("n"), F.count_distinct("hybrid_index").alias("d"), F.min("hybrid_index").alias("lo"), F.max("hybrid_index").alias("hi"), F.array_sort(F.collect_list(F.when(F.col("origin") == "human", F.struct("hybrid_index", "source_human_index")))).alias("h"))
    order = F.transform("h", lambda x: x["source_human_index"])
    return as_rows(docs, {"two_inserted": F.col("inserted") == 2, "dense_indexes": (F.col("n") == F.col("d")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), "human_order_kept": order == F.array_sort(order)})


def split_checks(rows: DataFrame, group: str, label: str) -> DataFrame:
    """No group on both sides, and both classes on each side."""
    groups = rows.groupBy(group).agg(F.count_distinct("split").alias("sides"))
    sides = rows.groupBy("split").agg(F.count_distinct(label).alias("classes"))
    return as_rows(groups, {"groups_disjoint": F.col("sides") == 1}).unionByName(as_rows(sides, {"both_classes_each_side": F.col("classes") == 2}))


def unchanged(before: DataFrame, after: DataFrame, name: str = "raw_dataset_unchanged") -> DataFrame:
    """Two digests of one table, each a row (n, digest), are the same."""
    both = before.select(F.col("n").alias("__n"), F.col("digest").alias("__digest")).join(F.broadcast(after))
    return as_rows(both, {name: (F.col("__n") == F.col("n")) & F.col("__digest").eqNullSafe(F.col("digest"))})


def distribution_checks(selected: DataFrame, long: DataFrame, summary: DataFrame, target: int, key: str = "pair_id") -> DataFrame:
    """A sampled run: its size, unique keys, a result for every selected key and no other, values in range, and counts of the summary.

    ``long`` has (key, label, feature, v, reason), ``summary`` (feature, label, count).
    """
    keys = selected.groupBy(key).agg(F.count("*").alias("__chosen"))
    results = long.select(key).distinct().withColumn("__has", F.lit(True))
    matched = keys.join(results, key, "full")
    size = selected.agg(F.count("*").alias("n"))
    counted = long.groupBy("feature", "label").agg(F.count(finite(F.col("v"))).alias("__valid"), F.count_if(F.col("reason").isNotNull()).alias("__missing"), F.count("*").alias("__all"))
    told = counted.join(summary.select("feature", "label", "count"), ["feature", "label"], "left")
    value = F.col("v")
    return (
        as_rows(size, {"sample_size_expected_or_explained": F.col("n") <= target})
        .unionByName(as_rows(keys, {"no_duplicate_selected_ids": F.col("__chosen") == 1}))
        .unionByName(as_rows(matched, {"pairs_preserved": F.col("__has").isNotNull(), "pair_results_match_selected_rows": F.col("__chosen").isNotNull() & F.col("__has").isNotNull()}))
        .unionByName(as_rows(long, {"finite_feature_values_when_present": value.isNull() | finite(value).isNotNull(), "mattr_in_valid_range_when_present": (F.col("feature") != "mattr") | value.isNull() | value.between(0, 1)}))
        .unionByName(as_rows(told, {"distribution_summary_counts_consistent": (F.col("count") == F.col("__valid")) & (F.col("__valid") + F.col("__missing") == F.col("__all"))}))
    )


def source_checks(hybrid: DataFrame, pairs: DataFrame, scores: DataFrame, rejected: DataFrame) -> DataFrame:
    """Spliced documents against the pairs they come from, their scores, and the counts of built and rejected ones."""
    cell = F.struct("hybrid_index", "text", "source_ai_index")
    of = lambda origin: F.array_sort(F.collect_list(F.when(F.col("origin") == origin, cell)))
    docs = hybrid.groupBy("pair_id").agg(of("human").alias("__human"), of("ai_inserted").alias("__ai"), F.count("*").alias("__n"))
    joined = docs.join(pairs.select("pair_id", T.sentences(F.col("human_text")).alias("__h"), T.sentences(F.col("ai_text")).alias("__a")), "pair_id", "left")
    found = as_rows(joined, {
        "inserted_ai_text_matches_source_sentences": F.forall("__ai", lambda x: x["text"] == F.get(F.col("__a"), x["source_ai_index"])),
        "ground_truth_indices_valid": F.forall("__ai", lambda x: (x["hybrid_index"] >= 0) & (x["hybrid_index"] < F.col("__n"))),
        "human_sentence_sequence_preserved": F.transform("__human", lambda x: x["text"]) == F.col("__h"),
    })
    score = F.col("score")
    found = found.unionByName(as_rows(scores, {"finite_anomaly_values_when_present": score.isNull() | finite(score).isNotNull(), "unavailable_scores_have_explicit_reasons": score.isNull() == F.col("score_reason").isNotNull()}))
    built = docs.agg(F.count("*").alias("__built"), F.sum(F.size("__ai")).alias("__inserted"))
    counts = built.join(F.broadcast(rejected.agg(F.count("*").alias("__rejected")))).join(F.broadcast(pairs.agg(F.count("*").alias("__pairs"))))
    consistent = (F.col("__built") + F.col("__rejected") == F.col("__pairs")) & (F.coalesce("__inserted", F.lit(0)) == 2 * F.col("__built"))
    return found.unionByName(as_rows(counts, {"result_counts_internally_consistent": consistent}))


def grid_checks(grid: DataFrame, hybrid: DataFrame, configurations: int) -> DataFrame:
    """Every configuration is there and covers the same documents, sentences and inserted sentences."""
    each = grid.groupBy("window", "feature_set").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("docs"), F.count_if(F.col("origin") == "ai_inserted").alias("truths"))
    whole = hybrid.agg(F.count("*").alias("__n"), F.count_distinct("pair_id").alias("__docs"))
    per = as_rows(each.join(F.broadcast(whole)), {"all_documents": F.col("docs") == F.col("__docs"), "all_sentences": F.col("n") == F.col("__n"), "two_truths_a_document": F.col("truths") == 2 * F.col("__docs")})
    return as_rows(each.agg(F.count("*").alias("n")), {"configurations": F.col("n") == configurations}).unionByName(per)


def pilot_checks(selected: DataFrame, rebuilt: DataFrame, key: str, prompt: str, text: str, least: int = 4) -> DataFrame:
    """A pilot's documents: unique, not blank, put together again from their parts, and of enough prompts."""
    unique = selected.groupBy(key).agg(F.count("*").alias("n"))
    whole = selected.join(rebuilt.select(key, F.col("text").alias("__text"), "ok"), key, "left")
    prompts = selected.agg(F.count_distinct(prompt).alias("prompts"), F.count("*").alias("n"))
    return (
        as_rows(whole, {"reconstructed_success": F.col("ok") & (F.col("__text") == F.col(text)), "non_empty_files": T.strip(F.col(text)) != ""})
        .unionByName(as_rows(unique, {"no_duplicate_ids": F.col("n") == 1}))
        .unionByName(as_rows(prompts, {"prompt_diversity": F.col("prompts") >= F.least(F.lit(least), F.col("n"))}))
    )
