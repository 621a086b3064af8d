"""Registered queries over the given tables; each has its SQL in ``oracles`` where SQL can express it.

Stand-ins: a user turn and the assistant turn after it are a pair (label 0 and 1);
``labels.quality`` is the class of a document, its language the audited group and its
source the topic. Documents are scored against the conversations as reference corpus and
pairs against the documents, so no text is scored by its own counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import cohens_d, nine_numbers, overlap_ratio, ratio, rounded, safe_log
from scrivener.operators import attribution as A
from scrivener.operators import calibrate as K
from scrivener.operators import checks as C
from scrivener.operators import evaluate as E
from scrivener.operators import features as X
from scrivener.operators import hybrid as H
from scrivener.operators import model as M
from scrivener.operators import profile as P
from scrivener.operators import sampling as S
from scrivener.sources.readers import dealt_out, read_parameters, table_digest
from scrivener.sources.scratch import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED = 20260813
#: Words that the generated texts of the tables have; those of the reference task are the operator's default.
KEYWORDS = ("the", "and", "with", "that", "tion", "ing")


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(rows: DataFrame) -> DataFrame:
    """``rows`` with every double at six decimals, so that the order of a sum does not show."""
    return rows.select(*[rounded(F.col(f"`{c}`")).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in rows.dtypes])


def _docs(spark, d):
    return dealt_out(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _turns(spark, d):
    return dealt_out(table(spark, d, "conversations"))


def _pairs(spark, d):
    return H.pairs(_turns(spark, d))


def _features(spark, d):
    return X.feature_table(_docs(spark, d), _turns(spark, d))


def _scored(spark, d, model=None):
    """Labelled documents with the model's p, null where it abstains, the prediction, and word counts."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = _docs(spark, d).join(labels, "doc_id").withColumn("words", T.word_count(F.col("text")))
    found = X.feature_table(docs, _turns(spark, d) if model is None else model, keep=("lang", "source", "label", "words"))
    p = rounded(M.probability(list(M.PARAMETERS), M.INTERCEPT), 9)
    rows = found.select(F.col("id").alias("doc_id"), "lang", "source", "words", "label", p.alias("p"))
    return rows.withColumn("predicted", (F.col("p") > 0.5).cast("int"))


def _spliced(spark, d):
    return H.spliced_documents(_pairs(spark, d)).filter("reason is null").drop("reason")


def _hybrid(spark, d):
    return H.splice(_pairs(spark, d))[0]


@register
def sentence_length_cv(spark, d):
    return _six(X.sentence_length_cv(_docs(spark, d)).withColumnRenamed("id", "doc_id"))


@register
def text_statistics(spark, d):
    return X.text_statistics(_docs(spark, d)).withColumnRenamed("id", "doc_id")


@register
def mattr25(spark, d):
    return _six(X.mattr(_docs(spark, d)).withColumnRenamed("id", "doc_id"))


@register
def pos_trigram_entropy(spark, d):
    return _six(X.pos_trigram_entropy(_docs(spark, d)).withColumnRenamed("id", "doc_id"))


@register
def lm_bigram_counts(spark, d):
    return X.bigram_model(_turns(spark, d))[0]


@register
def sentence_perplexity(spark, d):
    rows = X.sentence_perplexity(_docs(spark, d), _turns(spark, d), texts=False)
    return _six(rows.select(F.col("id").alias("doc_id"), "sentence_id", "n_tokens", "perplexity", "status", "reason", "warning"))


@register
def doc_perplexity(spark, d):
    return _six(X.document_perplexity(_docs(spark, d), _turns(spark, d)).withColumnRenamed("id", "doc_id"))


@register
def feature_vector(spark, d):
    rows = X.feature_array(_features(spark, d))
    return _six(rows.select(F.col("id").alias("doc_id"), *X.FEATURES, F.size(F.filter("features", lambda f: f["available"])).alias("n_available"), "complete"))


@register
def insufficient_reasons(spark, d):
    return X.reason_counts(_features(spark, d))


@register
def analyze(spark, d):
    found = M.analyze(_docs(spark, d), _turns(spark, d), M.parameters(spark), texts=False)
    value = lambda n: F.get("features", F.lit(n))["value"]
    rows = found.select(
        "doc_id", "state", "label", "ai_probability", *[value(i).alias(n) for i, n in enumerate(X.FEATURES)], F.size("sentence_evidence").alias("n_evidence"), F.col("text_statistics.word_count").alias("word_count"),
        T.headline(F.col("state"), F.col("label")).alias("headline"), T.explanation(F.col("state"), F.col("label")).alias("explanation"),
        T.signal_text(rounded(F.col("ai_probability"), 9)).alias("signal"),
    )
    return _six(rows)


@register
def evidence_top3(spark, d):
    rows = M.lowest_evidence(X.sentence_perplexity(_docs(spark, d), _turns(spark, d), texts=False))
    return _six(rows.select(F.col("id").alias("doc_id"), "place", "sentence_id", "perplexity"))


@register
def feature_display(spark, d):
    rows = _features(spark, d)
    shown = [T.feature_text(rounded(F.col(n), 9), F.col(n)).alias(n) for n in X.FEATURES]
    return rows.select(F.col("id").alias("doc_id"), *shown)


@register
def standardise(spark, d):
    rows = X.sentence_length_cv(_docs(spark, d)).join(X.pos_trigram_entropy(_docs(spark, d)), "id")
    return _six(M.standardise_parameters(rows, ("sentence_length_cv", "pos_3gram_entropy")))


def _training(spark, d):
    """Both halves of every pair with all four features, and the pair's split."""
    return S.group_split(_pair_features(spark, d).dropna(subset=list(X.FEATURES)), "pair_id", 0.2, SEED)


@register
def fit_logreg(spark, d):
    return M.fit(_training(spark, d).filter("split = 'train'"), "label")


@register
def ablation(spark, d):
    """Validation metrics of the models with the first feature, two, three and all four, on the same rows; F1 above the first's, and coefficients."""
    rows = _training(spark, d).persist()
    out = None
    for rung in range(1, len(X.FEATURES) + 1):
        features = X.FEATURES[:rung]
        params, intercept = M.load_parameters(M.fit(rows.filter("split = 'train'"), "label", features))
        p = M.probability(params, intercept)
        scored = rows.filter("split = 'validation'").select(F.lit("+".join(features)).alias("model"), "label", p.alias("p"), (p > 0.5).cast("int").alias("predicted"))
        part = E.binned(scored, "model").withColumn("coefficients", F.array(*[F.lit(float(x[3])) for x in params]))
        out = part if out is None else out.unionByName(part)
    base = out.filter(F.col("model") == X.FEATURES[0]).select(F.col("f1").alias("base_f1"))
    return out.join(F.broadcast(base)).withColumn("delta_f1", F.col("f1") - F.col("base_f1")).drop("base_f1")


@register
def metrics_overall(spark, d):
    return _six(E.metrics(_scored(spark, d)))


@register
def roc_auc(spark, d):
    return _six(E.roc_auc(_scored(spark, d)))


@register
def group_audit(spark, d):
    rows = _scored(spark, d).withColumn("audit_group", F.when(F.col("lang") == "en", "reference").otherwise("audited"))
    return _six(E.group_audit(rows, "audit_group"))


@register
def word_bins(spark, d):
    return _six(E.binned(_scored(spark, d).withColumn("word_bin", T.word_bin(F.col("words"))), "word_bin"))


@register
def margin_bins(spark, d):
    return _six(E.metrics(E.margins(_scored(spark, d)).filter("margin is not null"), "margin_bin"))


@register
def calibration(spark, d):
    return _six(E.calibration(_scored(spark, d)))


@register
def selective_performance(spark, d):
    return _six(E.selective(_scored(spark, d)))


@register
def confident_failures(spark, d):
    return _six(E.confident_failures(_scored(spark, d), "doc_id").select("doc_id", "label", "predicted", "p", "margin"))


@register
def always_human_baseline(spark, d):
    return _six(E.metrics(_scored(spark, d).withColumn("predicted", F.lit(0))))


@register
def threshold_baseline(spark, d):
    return _six(E.best_threshold(_scored(spark, d), "words").select(F.col("threshold").cast("long").alias("threshold"), "tp", "flagged", "positives", "f1"))


@register
def pair_rows(spark, d):
    return H.unpivot(_pairs(spark, d)).select("pair_id", "label", F.sha2("text", 256).alias("text_hash"), T.word_count(F.col("text")).alias("words"))


@register
def usable_pairs(spark, d):
    return H.usable(_pairs(spark, d)).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@register
def seeded_sample(spark, d):
    return S.sample(_pairs(spark, d), "pair_id", 200, SEED).select("pair_id")


@register
def heldout_antijoin(spark, d):
    pairs = _pairs(spark, d)
    rest = S.untouched(pairs, S.sample(pairs, "pair_id", 20, SEED), "pair_id")
    return S.sample(rest, "pair_id", 10, SEED + 2).select("pair_id")


@register
def balanced_groups(spark, d):
    docs = _docs(spark, d).withColumn("audit_group", F.when(F.col("lang") == "en", "reference").otherwise("audited"))
    return S.balanced(docs, "doc_id", "audit_group", SEED).select("doc_id", "audit_group")


@register
def pair_split(spark, d):
    return S.group_split(H.unpivot(_pairs(spark, d)).select("pair_id", "label"), "pair_id", 0.2, SEED)


@register
def family_split(spark, d):
    return _docs(spark, d).select("source", "doc_id", S.three_way(F.col("source"), SEED).alias("split"))


def _pair_features(spark, d):
    rows = H.unpivot(_pairs(spark, d)).withColumn("id", F.concat_ws("#", "pair_id", F.col("label").cast("string")))
    return X.feature_table(rows, _docs(spark, d), "id", keep=("pair_id", "label"))


def _long_features(spark, d):
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), rounded(F.col(f), 9).alias("v"), F.col(X.REASONS[f]).alias("reason")) for f in X.FEATURES])
    return _pair_features(spark, d).select("pair_id", "label", F.explode(cells).alias("x")).select("pair_id", "label", "x.*")


@register
def distribution_summary(spark, d):
    return _six(_long_features(spark, d).groupBy("feature", "label").agg(*nine_numbers(F.col("v"))))


@register
def distribution_overlap(spark, d):
    side = lambda y: F.when(F.col("label") == y, F.col("v"))
    parts = []
    for k, y in (("h", 0), ("a", 1)):
        v = side(y)
        parts += [F.count(v).alias(f"{k}n"), F.avg(v).alias(f"{k}m"), F.var_samp(v).alias(f"{k}v"), F.min(v).alias(f"{k}lo"), F.max(v).alias(f"{k}hi"), F.percentile(v, F.lit(0.25)).alias(f"{k}q1"), F.percentile(v, F.lit(0.75)).alias(f"{k}q3"), F.median(v).alias(f"{k}med")]
    rows = _long_features(spark, d).groupBy("feature").agg(*parts)
    c = F.col
    return _six(rows.select("feature", overlap_ratio(c("hlo"), c("hhi"), c("alo"), c("ahi")).alias("range_overlap"), overlap_ratio(c("hq1"), c("hq3"), c("aq1"), c("aq3")).alias("iqr_overlap"), cohens_d(c("hn"), c("hm"), c("hv"), c("an"), c("am"), c("av")).alias("cohens_d"), (c("amed") - c("hmed")).alias("median_difference")))


@register
def paired_differences(spark, d):
    wide = _long_features(spark, d).groupBy("feature", "pair_id").agg(F.max(F.when(F.col("label") == 0, F.col("v"))).alias("h"), F.max(F.when(F.col("label") == 1, F.col("v"))).alias("a"))
    diff = F.col("a") - F.col("h")
    return _six(wide.withColumn("x", diff).groupBy("feature").agg(F.count("*").alias("pairs"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x") > 0).alias("rising"), F.count_if(F.col("x") < 0).alias("falling"), F.count_if(F.col("x") == 0).alias("equal"), *nine_numbers(F.col("x"))))


@register
def hybrid_splice(spark, d):
    return _hybrid(spark, d)


@register
def hybrid_rejects(spark, d):
    return H.splice(_pairs(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@register
def local_windows_clipped(spark, d):
    return _six(H.local_features(_spliced(spark, d)).select("pair_id", "hybrid_index", "window_first", "window_last", "length", "mattr", "pos_3gram_entropy"))


@register
def local_windows_shifted(spark, d):
    return _six(H.local_features(_spliced(spark, d), (5,)).select("pair_id", "hybrid_index", "window_first", "window_last", "length", "mattr", "pos_3gram_entropy"))


@register
def robust_z(spark, d):
    """Of every document's sentence lengths: whole table, long documents included."""
    rows = X.sentence_rows(_docs(spark, d)).select(F.col("id").alias("doc_id"), "sentence_id", T.count_matches(F.col("sentence"), T.COUNTED).cast("double").alias("length"))
    return _six(H.robust_z(rows, "doc_id", "sentence_id", "length"))


COMPONENTS = ("perplexity", "length", "mattr", "pos_3gram_entropy")


def _anomaly(spark, d):
    rows = H.local_features(_spliced(spark, d), corpus=_docs(spark, d))
    return H.ranked(H.anomaly_scores(rows, "pair_id", "hybrid_index", COMPONENTS, ("origin",)), "pair_id", "hybrid_index")


@register
def anomaly_rank(spark, d):
    return _six(_anomaly(spark, d).select("pair_id", "hybrid_index", "origin", "z_perplexity", "z_length", "z_mattr", "z_pos_3gram_entropy", "score", "score_reason"))


@register
def anomaly_capture(spark, d):
    return _six(H.capture_rates(_anomaly(spark, d), F.col("origin") == "ai_inserted"))


SETS = {"perplexity_only": COMPONENTS[:1], "sentence_length_only": COMPONENTS[1:2], "mattr_only": COMPONENTS[2:3], "pos_3gram_entropy_only": COMPONENTS[3:], "all_features": COMPONENTS}
WIDTHS = (1, 3, 5, 7)


def _grid(spark, d):
    """(window, feature_set, pair_id, hybrid_index, origin, score) of 4 windows by 5 feature sets; one pass measures and one ranks all windows' values."""
    rows = H.local_features(_spliced(spark, d), WIDTHS, _docs(spark, d)).withColumn("doc", F.concat_ws("|", F.col("width").cast("string"), "pair_id"))
    scores = H.anomaly_scores(rows, "doc", "hybrid_index", COMPONENTS, ("width", "pair_id", "origin"))
    # scores to nine decimals: a rank must not turn on the last bit of a sum
    cells = [F.struct(F.lit(name).alias("feature_set"), rounded(H.mean_abs([F.col(f"z_{c}") for c in cs]), 9).alias("score")) for name, cs in SETS.items()]
    return scores.select(F.col("width").alias("window"), "pair_id", "hybrid_index", "origin", F.inline(F.array(*cells)))


@register
def sensitivity_grid(spark, d):
    rows = _grid(spark, d).withColumn("doc", F.concat_ws("|", F.col("window").cast("string"), "feature_set", "pair_id"))
    ranks = H.ranked(rows, "doc", "hybrid_index")
    ai = (F.col("origin") == "ai_inserted") & F.col("score").isNotNull()
    human = F.when(F.col("origin") == "human", F.col("score"))
    inserted = F.when(ai, F.col("score"))
    return _six(ranks.groupBy("window", "feature_set").agg(
        F.count("score").alias("scored"), F.median(inserted).alias("ai_median"), F.median(human).alias("human_median"), (F.median(inserted) - F.median(human)).alias("gap"),
        *[E.capture(F.col(b), ai).alias(b) for b in H.BANDS],
    ))


CHANGES = ("log_perplexity", "length", "mattr", "pos_3gram_entropy")


def _boundary(spark, d):
    rows = H.local_features(_spliced(spark, d), corpus=_docs(spark, d))
    return H.boundaries(rows.withColumn("log_perplexity", safe_log(F.col("perplexity"))), ("perplexity", *CHANGES))


def _boundary_scores(spark, d):
    changes = tuple(f"change_{c}" for c in CHANGES)
    return H.anomaly_scores(_boundary(spark, d), "pair_id", "boundary_index", changes, ("boundary_type", "target_boundary", "change_perplexity", *changes))


@register
def boundary_scores(spark, d):
    changes = [f"change_{c}" for c in ("perplexity", *CHANGES)]
    return _six(_boundary_scores(spark, d).select("pair_id", "boundary_index", "boundary_type", "target_boundary", *changes, "score"))


@register
def boundary_capture(spark, d):
    """Share of all boundaries between origins that each band holds; bands rank the boundaries of a document."""
    rows = _boundary_scores(spark, d).withColumn("score", rounded(F.col("score"), 9))
    return _six(H.capture_rates(H.ranked(rows, "pair_id", "boundary_index"), F.col("target_boundary")))


@register
def boundary_summary(spark, d):
    return _six(_boundary(spark, d).groupBy("boundary_type").agg(F.count("*").alias("n"), F.avg("change_length").alias("mean_change"), F.median("change_length").alias("median_change")))


def _attribution(spark, d):
    """What every spliced document's probability loses without each of its sentences; documents that the model abstains from are left out."""
    p = M.probability(list(M.PARAMETERS), M.INTERCEPT)
    rows = H.attribution(A.without_each(_spliced(spark, d), _docs(spark, d)), p).filter("reason is null or reason <> 'full_document_not_classified'")
    rows = rows.select("pair_id", "left_out", F.get("s", F.col("left_out"))["origin"].alias("origin"), rounded(F.col("contribution"), 9).alias("contribution"), "reason")
    return H.ranked(rows, "pair_id", "left_out", "contribution", floor_one=True)


@register
def loo_attribution(spark, d):
    return _six(_attribution(spark, d).select("pair_id", "left_out", "origin", "contribution", "reason", "rank", "top_25", "top_10"))


@register
def attribution_report(spark, d):
    """Rates and medians per document first, then their means and medians over documents."""
    ai = F.col("origin") == "ai_inserted"
    side = lambda y: F.median(F.when(F.col("origin") == y, F.col("contribution")))
    each = _attribution(spark, d).groupBy("pair_id").agg(E.capture(F.col("top_10"), ai).alias("c10"), E.capture(F.col("top_25"), ai).alias("c25"), side("ai_inserted").alias("ai"), side("human").alias("human"))
    return _six(each.agg(
        F.count("*").alias("documents"), F.avg("c10").alias("top_10"), F.avg("c25").alias("top_25"), F.median("ai").alias("ai_median"), F.median("human").alias("human_median"),
        F.median(F.col("ai") - F.col("human")).alias("median_difference"),
    ))


@register
def prefix_stability(spark, d):
    return _six(P.summary_by_target(_prefixes(spark, d), "ttr"))


def _prefixes(spark, d):
    rows = P.prefix_rows(_docs(spark, d), (10, 25, 50, 100, 200))
    return rows.select("id", "target", "n_tokens", ratio(F.size(F.array_distinct("w")), F.col("n_tokens")).alias("ttr"))


@register
def prefix_drift(spark, d):
    return _six(P.drift(_prefixes(spark, d), "ttr").withColumnRenamed("id", "doc_id"))


@register
def reconstruct_concat(spark, d):
    rows = _turns(spark, d)
    out = P.reconstruct_concat(rows, "conv_id", "turn", "text")
    return out.select("conv_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


@register
def reconstruct_overlay(spark, d):
    """Documents cut into sentences with offsets, and laid together again: the text comes back."""
    docs = _docs(spark, d)
    offsets = P.sentence_offsets(docs)
    parts = offsets.join(docs, offsets["id"] == docs["doc_id"]).select("doc_id", "start", (F.col("end") - 1).alias("end"), "sentence_id", F.expr("substring(text, int(start) + 1, int(end - start))").alias("part"))
    out = P.reconstruct_overlay(parts, "doc_id", "start", "end", "sentence_id", "part")
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"), "ok")


@register
def value_counts(spark, d):
    return P.value_counts(_docs(spark, d), "source")


@register
def infer_dtype(spark, d):
    return P.infer_types(table(spark, d, "documents"))


@register
def length_distribution(spark, d):
    return _six(P.length_distribution(_docs(spark, d), "text", "lang"))


@register
def fk_check(spark, d):
    return P.foreign_key_check(table(spark, d, "labels"), "doc_id", _docs(spark, d), "doc_id")


@register
def turn_spans(spark, d):
    rows = _turns(spark, d)
    return P.span_summary(rows.withColumn("last", F.col("turn") + F.length("text")), "conv_id", "turn", "last")


@register
def pilot_round_robin(spark, d):
    docs = _docs(spark, d).withColumn("words", T.word_count(F.col("text"))).withColumn("score", rounded(P.pilot_score(F.col("words"), F.lit(9), F.col("lang") == "en", F.size(F.split("text", "\n")))))
    return S.round_robin(docs, "source", "score", "doc_id", 8).select("doc_id", "source", "turn", "score")


@register
def repeated_ngrams(spark, d):
    return _six(P.repeated_ngram_ratio(_docs(spark, d)).withColumnRenamed("id", "doc_id"))


@register
def quality_checks(spark, d):
    return _six(P.quality_checks(_docs(spark, d), KEYWORDS, (*P.LEAKAGE, "tion of")).withColumnRenamed("id", "doc_id"))


@register
def span_mapping(spark, d):
    """Which sentences each 1000-character passage of a document meets."""
    offsets = P.sentence_offsets(_docs(spark, d))
    passages = _docs(spark, d).select(F.col("doc_id").alias("id"), F.length("text").alias("n"), F.explode(F.expr("sequence(0L, cast(length(text) / 1000 as bigint))")).alias("span_id"))
    passages = passages.select("id", "span_id", (F.col("span_id") * 1000).alias("start"), F.least((F.col("span_id") + 1) * 1000, F.col("n").cast("long")).alias("end"))
    met = P.map_spans(passages, offsets.withColumnRenamed("sentence_id", "target_id"), "id")
    return met.groupBy(F.col("id").alias("doc_id"), "span_id").agg(F.count("*").alias("n"), F.min("target_id").alias("first_sentence"), F.max("target_id").alias("last_sentence"))


@register
def leakage_copies(spark, d):
    return P.copies(_docs(spark, d), "doc_id", "text", "source")


@register
def localization(spark, d):
    """Of the top quarter of sentences by length z against the inserted ones, per document: precision, recall, overlap, and the share of their ends that a flagged run shares."""
    sentences = _hybrid(spark, d).withColumn("length", T.count_matches(F.col("text"), T.COUNTED).cast("double"))
    z = H.robust_z(sentences, "pair_id", "hybrid_index", "length", ("origin",)).withColumn("score", rounded(F.abs("z"), 9))
    ranks = H.ranked(z, "pair_id", "hybrid_index", floor_one=True)
    return _six(E.localization(ranks.withColumn("known", F.col("origin") == "ai_inserted").withColumn("flagged", F.col("top_25")), "pair_id", "hybrid_index"))


@register
def chat_prompts(spark, d):
    return P.chat_prompts(_turns(spark, d)).select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("n_chars"))


@register
def reproducibility(spark, d):
    rows = _turns(spark, d).withColumn("words", T.word_count(F.col("text")).cast("double"))
    return _six(P.reproducibility(rows, "conv_id", "turn", "words"))


@register
def source_criteria(spark, d):
    return P.inclusion(_docs(spark, d), ("en",), 50).groupBy("verdict").agg(F.count("*").alias("n"))


@register
def document_manifest(spark, d):
    return P.manifest_rows(_docs(spark, d), S.three_way(F.col("source"), SEED))


@register
def repeated_evaluation(spark, d):
    return _six(E.repeated(_scored(spark, d), "doc_id", (1, 2, 3, 4, 5)))


@register
def metric_deltas(spark, d):
    rows = _scored(spark, d)
    return _six(E.metric_deltas(E.metrics(rows), E.metrics(rows.withColumn("predicted", F.lit(0))), ("accuracy", "precision", "recall", "f1", "coverage")))


@register
def checks_features(spark, d):
    return C.feature_checks(_features(spark, d))


@register
def checks_hybrid(spark, d):
    return C.hybrid_checks(_hybrid(spark, d)).unionByName(C.pair_checks(_pairs(spark, d)))


@register
def checks_split(spark, d):
    return C.split_checks(S.group_split(H.unpivot(_pairs(spark, d)).select("pair_id", "label"), "pair_id", 0.2, SEED), "pair_id", "label")


@register
def eligibility_count(spark, d):
    """How many texts a pilot could use; the pool itself keeps every text that is not blank."""
    words = T.word_count(F.col("text"))
    eligible = (F.col("lang") == "en") & words.between(300, 1800)
    return _docs(spark, d).agg(F.count("*").alias("total"), F.count_if(T.strip(F.col("text")) != "").alias("pool"), F.count_if(eligible).alias("eligible"))


@register
def first_pairs(spark, d):
    """The first twenty pairs in the order of their conversations."""
    key = F.split("pair_id", "-")
    rows = _pairs(spark, d).withColumns({"conv": F.get(key, F.lit(0)).cast("long"), "turn": F.get(key, F.lit(1)).cast("long")})
    return rows.orderBy("conv", "turn").limit(20).select("pair_id")


@register
def role_texts(spark, d):
    """The text that each row of the validation half stands for: the human one for label 0, else the other."""
    rows = S.group_split(H.unpivot(_pairs(spark, d)).select("pair_id", "label"), "pair_id", 0.2, SEED).filter("split = 'validation'")
    text = F.when(F.col("label") == 0, F.col("human_text")).otherwise(F.col("ai_text"))
    return rows.join(_pairs(spark, d), "pair_id").select("pair_id", "label", F.sha2(text, 256).alias("text_hash"), T.word_count(text).alias("words"))


@register
def prediction_rows(spark, d):
    """Every scored row with its bins and whether its prediction is right, in order."""
    rows = E.margins(_scored(spark, d).filter("p is not null")).withColumn("word_bin", T.word_bin(F.col("words")))
    columns = ("doc_id", "label", "words", "word_bin", "p", "margin", "margin_bin", "predicted", (F.col("predicted") == F.col("label")).alias("correct"))
    return _six(rows.select(*columns)).orderBy("doc_id", "label")


@register
def id_union(spark, d):
    """Identifiers that either table knows, each once."""
    both = _docs(spark, d).select("doc_id").union(table(spark, d, "labels").select("doc_id")).distinct()
    return both.agg(F.count("*").alias("ids"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register
def id_overlap(spark, d):
    """A later sample shares no pair with the one before it."""
    pairs = _pairs(spark, d)
    used = S.sample(pairs, "pair_id", 20, SEED)
    later = S.sample(S.untouched(pairs, used, "pair_id"), "pair_id", 10, SEED + 2)
    shared = used.select("pair_id").intersect(later.select("pair_id"))
    return shared.agg(F.count("*").alias("shared"), (F.count("*") == 0).alias("disjoint"))


def _rounded_anomaly(spark, d):
    return _anomaly(spark, d).withColumn("score", rounded(F.col("score"), 9))


@register
def human_above_ai(spark, d):
    """Per document the original sentences that score above its least anomalous inserted one; null without such a score."""
    least = F.min(F.when(F.col("origin") == "ai_inserted", F.col("score")))
    rows = _rounded_anomaly(spark, d).groupBy("pair_id").agg(least.alias("least_ai"), F.collect_list(F.when(F.col("origin") == "human", F.col("score"))).alias("human"))
    above = F.size(F.filter("human", lambda x: x > F.col("least_ai"))).cast("long")
    return _six(rows.select("pair_id", "least_ai", F.when(F.col("least_ai").isNotNull(), above).alias("above")))


@register
def anomaly_report(spark, d):
    """Nine numbers of the scores by origin, the gap between the medians, and documents built and rejected."""
    rows = _rounded_anomaly(spark, d)
    side = lambda y: F.when(F.col("origin") == y, F.col("score"))
    gap = F.median(side("ai_inserted")) - F.median(side("human"))
    scores = rows.agg(F.count_distinct("pair_id").alias("documents"), *nine_numbers(side("ai_inserted"), "ai_"), *nine_numbers(side("human"), "human_"), gap.alias("gap"))
    rejected = H.splice(_pairs(spark, d))[1].agg(F.count("*").alias("rejected"))
    return _six(scores.join(F.broadcast(rejected)))


@register
def distribution_reasons(spark, d):
    """Why values are missing, by feature and side."""
    return _long_features(spark, d).filter("v is null").groupBy("feature", "label", "reason").agg(F.count("*").alias("n"))


@register
def span_keys(spark, d):
    """Keys of the span aggregate, and how many have more than one row."""
    rows = _turns(spark, d)
    spans = P.span_summary(rows.withColumn("last", F.col("turn") + F.length("text")), "conv_id", "turn", "last")
    return spans.agg(F.count("*").alias("keys"), F.count_if(F.col("rows") > 1).alias("with_several"))


def _long_of(rows):
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), rounded(F.col(f), 9).alias("v"), F.col(X.REASONS[f]).alias("reason")) for f in X.FEATURES])
    return rows.select("pair_id", "label", F.explode(cells).alias("x")).select("pair_id", "label", "x.*")


def _digest(rows):
    """The digest of a table as it is now, as a value: later changes of the table do not reach it."""
    return rows.sparkSession.createDataFrame([table_digest(rows).first()], "n bigint, digest decimal(38,0)")


@register
def checks_distribution(spark, d):
    """Of a run over 200 sampled pairs; the table's digest is taken before the run and once more after it."""
    before = _digest(table(spark, d, "conversations"))
    pairs = _pairs(spark, d)
    selected = S.sample(pairs, "pair_id", 200, SEED)
    rows = H.unpivot(selected).withColumn("id", F.concat_ws("#", "pair_id", F.col("label").cast("string")))
    long = _long_of(X.feature_table(rows, _docs(spark, d), "id", keep=("pair_id", "label")))
    long = stored(long, "long")
    summary = stored(long.groupBy("feature", "label").agg(*nine_numbers(F.col("v"))), "summary")
    same = C.unchanged(before, table_digest(table(spark, d, "conversations")))
    return C.distribution_checks(selected, long, summary, 200).unionByName(same)


@register
def checks_sources(spark, d):
    hybrid, rejected = H.splice(_pairs(spark, d))
    return C.source_checks(hybrid, _pairs(spark, d), _anomaly(spark, d), rejected)


@register
def checks_grid(spark, d):
    return C.grid_checks(_grid(spark, d), _hybrid(spark, d), len(WIDTHS) * len(SETS))


@register
def checks_pilot(spark, d):
    docs = _docs(spark, d)
    before = _digest(table(spark, d, "documents").select(*docs.columns))
    selected = docs.join(F.broadcast(pilot_round_robin(spark, d).select("doc_id")), "doc_id", "left_semi")
    offsets = P.sentence_offsets(selected)
    parts = offsets.join(selected, offsets["id"] == selected["doc_id"]).select("doc_id", "start", (F.col("end") - 1).alias("end"), "sentence_id", F.expr("substring(text, int(start) + 1, int(end - start))").alias("part"))
    rebuilt = stored(P.reconstruct_overlay(parts, "doc_id", "start", "end", "sentence_id", "part"), "rebuilt")
    same = C.unchanged(before, table_digest(table(spark, d, "documents").select(*docs.columns)), "raw_table_unchanged")
    return C.pilot_checks(selected, rebuilt, "doc_id", "source", "text").unionByName(same)


@register
def known_rows(spark, d):
    """The first five classified documents, scored again by the parameters as written and read back."""
    model = X.LanguageModel(_turns(spark, d))
    scored = _scored(spark, d, model)
    known = stored(scored.filter("p is not null").orderBy("doc_id").limit(5).select("doc_id", F.col("predicted").alias("expected_prediction"), F.col("p").alias("expected_p")), "known")
    path = scratch_path(spark, "parameters")
    M.parameters(spark).write.parquet(path)
    params, intercept = M.load_parameters(read_parameters(spark, path))
    # every row of a known document is measured again; others meet no known row
    again = _docs(spark, d).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    found = X.feature_table(again, model).select(F.col("id").alias("doc_id"), rounded(M.probability(params, intercept), 9).alias("p"))
    return _six(M.verify_known(found.withColumn("predicted", (F.col("p") > 0.5).cast("int")), known, "doc_id"))


@register
def training_metadata(spark, d):
    rows = _pair_features(spark, d)
    return M.training_metadata(rows, S.group_split(rows.dropna(subset=list(X.FEATURES)), "pair_id", 0.2, SEED), "pair_id")


def _labelled_words(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return _docs(spark, d).join(labels, "doc_id").select("doc_id", "lang", "source", T.word_count(F.col("text")).alias("words"), "label")


@register
def group_holdouts(spark, d):
    """Each source held out, judged by the word counts of the others."""
    return _six(E.group_out(_labelled_words(spark, d), "source", "words"))


@register
def metadata_leakage(spark, d):
    """Area under the curve of a score that knows language and source only."""
    return _six(E.roc_auc(E.learned_share(_labelled_words(spark, d), ("lang", "source"), "doc_id", SEED)))


@register
def sanity_checks(spark, d):
    """Areas that length, source and permuted labels give, and families on both sides of a pair split."""
    rows = _labelled_words(spark, d)
    named = lambda name, found: found.select(F.lit(name).alias("check_name"), F.col("roc_auc").alias("value"))
    out = named("length_only", E.roc_auc(rows, score="words", width=1.0))
    out = out.unionByName(named("topic_only", E.roc_auc(E.learned_share(rows, ("source",), "doc_id", SEED))))
    out = out.unionByName(named("permuted_labels", E.roc_auc(E.permuted_labels(rows, "doc_id", SEED), score="words", width=1.0)))
    sides = pair_split(spark, d).groupBy("pair_id").agg(F.count_distinct("split").alias("sides"))
    return _six(out.unionByName(sides.agg(F.lit("families_on_both_sides").alias("check_name"), F.count_if(F.col("sides") > 1).cast("double").alias("value"))))


@register
def calibration_methods(spark, d):
    """Brier score and expected calibration error of one half of the documents, as scored and by two maps that the other half taught."""
    rows = _scored(spark, d).filter("p is not null").persist()
    taught = F.substring(S.seeded(SEED, F.col("doc_id")), 1, 1) < "8"
    learn, rest = rows.filter(taught), rows.filter(~taught)
    out = None
    for name, found in (("as_scored", rest), ("platt", K.platt(learn, rest)), ("isotonic", K.isotonic(learn, rest))):
        part = E.calibration(found).agg(F.lit(name).alias("method"), F.sum("n").alias("n"), F.sum("brier_part").alias("brier"), F.sum("ece_part").alias("ece"))
        out = part if out is None else out.unionByName(part)
    return _six(out)


@register
def normalised_view(spark, d):
    return P.normalised_view(_docs(spark, d)).withColumnRenamed("id", "doc_id")


@register
def corpus_manifest(spark, d):
    """Both halves of every pair, and the spliced document where there is one with the sentences that it took over."""
    sides = H.unpivot(_pairs(spark, d)).select(
        F.concat_ws("#", "pair_id", F.col("label").cast("string")).alias("document_id"), F.col("pair_id").alias("family_id"), F.when(F.col("label") == 0, "human").otherwise("ai").alias("category"),
        F.lit("none").alias("transformation_type"), F.lit(None).cast("string").alias("transformation_regions"), "text",
    )
    taken = F.col("origin") == "ai_inserted"
    ordered = F.array_sort(F.collect_list(F.struct("hybrid_index", "text")))
    at = F.when(taken, F.col("hybrid_index"))
    spliced = _hybrid(spark, d).groupBy("pair_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.concat_ws("-", F.min(at).cast("string"), F.max(at).cast("string")).alias("transformation_regions"))
    spliced = spliced.select(F.concat("pair_id", F.lit("#hybrid")).alias("document_id"), F.col("pair_id").alias("family_id"), F.lit("hybrid").alias("category"), F.lit("inserted_block").alias("transformation_type"), "transformation_regions", "text")
    docs = sides.unionByName(spliced).withColumn("source_id", F.lit("conversations"))
    return P.corpus_manifest(docs, S.three_way(F.col("family_id"), SEED), "1")
