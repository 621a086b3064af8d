"""Standardised logistic model that abstains on incomplete evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import finite, rounded
from scrivener.operators.checks import split_checks
from scrivener.operators.features import FEATURES, LanguageModel, feature_array, feature_table, statistics_of
from scrivener.operators.sampling import group_split
from scrivener.operators.scoring import TextScorer
from scrivener.sources.readers import model_metadata, read_parameters
from scrivener.sources.scratch import stored
from scrivener.sources.sinks import write_model

#: Parameters of the registered queries: feature, mean, scale and coefficient; the intercept.
PARAMETERS = (("perplexity", 900.0, 600.0, -1.2), ("sentence_length_cv", 0.6, 0.25, -1.0), ("mattr", 0.85, 0.08, 0.9), ("pos_3gram_entropy", 4.5, 0.8, -0.9))
INTERCEPT = 0.1
PARAMETER_SCHEMA = "feature string, position int, mean double, scale double, coefficient double, intercept double"


def parameters(spark: SparkSession, rows: tuple = PARAMETERS, intercept: float = INTERCEPT) -> DataFrame:
    return spark.createDataFrame([(f, i, m, s, c, intercept) for i, (f, m, s, c) in enumerate(rows)], PARAMETER_SCHEMA)


def load_parameters(params: DataFrame) -> tuple[list[tuple[str, float, float, float]], float]:
    """The rows of a parameter table, checked: fixed feature order, finite values, one intercept."""
    rows = params.orderBy("position").limit(len(FEATURES) + 1).collect()
    if not rows or [r["feature"] for r in rows] != [f for f in FEATURES if f in {r["feature"] for r in rows}]:
        raise ValueError(f"features must be in the order {FEATURES}")
    if any(r["scale"] is None or not r["scale"] > 0 or r["coefficient"] is None for r in rows) or len({r["intercept"] for r in rows}) != 1:
        raise ValueError("scales must be positive, coefficients given and the intercept one value")
    return [(r["feature"], r["mean"], r["scale"], r["coefficient"]) for r in rows], rows[0]["intercept"]


def probability(rows: list[tuple[str, float, float, float]], intercept: float) -> Column:
    """p of class 1, null unless every feature has a finite value."""
    z = F.lit(intercept)
    for name, mean, scale, coefficient in rows:
        z = z + (finite(F.col(name)) - mean) / scale * coefficient
    return 1 / (1 + F.exp(-z))


def standardise_parameters(rows: DataFrame, features: tuple = FEATURES) -> DataFrame:
    """(feature, n, mean, scale) with the population deviation, over rows with all features."""
    whole = rows.dropna(subset=list(features))
    cells = whole.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("c")).select("c.*")
    return cells.groupBy("feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))


def fit(train: DataFrame, label: str = "label", features: tuple = FEATURES) -> DataFrame:
    """Fit an L2 logistic regression (C = 1) on standardised features; returns the parameter table.

    Scaling uses the population deviation of the training rows, so it is done here and
    not by the estimator; the penalty per row is 1/n.
    """
    spark = train.sparkSession
    whole = train.dropna(subset=[*features, label]).persist()
    try:
        scales = {r["feature"]: (r["mean"], r["scale"] or 1.0) for r in standardise_parameters(whole, features).collect()}
        n = whole.count()
        ready = whole.select(F.col(label).cast("double").alias("label"), *[((F.col(f) - scales[f][0]) / scales[f][1]).alias(f) for f in features])
        fitted = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=1000).fit(VectorAssembler(inputCols=list(features), outputCol="features").transform(ready))
    finally:
        whole.unpersist()
    return parameters(spark, tuple((f, *map(float, scales[f]), float(c)) for f, c in zip(features, fitted.coefficients, strict=True)), float(fitted.intercept))


def analyze(
    docs: DataFrame, corpus: DataFrame | LanguageModel | None, params: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    scorer: TextScorer | None = None, extractor: Callable[[DataFrame], DataFrame] | None = None, texts: bool = True,
) -> DataFrame:
    """One row a document: state, label, probability, features, sentence evidence and statistics.

    ``empty_input`` and ``whitespace_only_input`` are settled before anything is
    measured, a null text counting as empty; otherwise an incomplete feature vector gives
    ``insufficient_evidence`` and keeps what could be measured.

    Perplexity comes from ``corpus``, or from a ``scorer`` of texts. An ``extractor`` takes
    the place of all measuring: it is given rows (id, text), never an empty or blank text,
    and returns them with the columns of ``feature_table`` and ``sentences``. Without
    ``texts`` the evidence has no text, and a large language model takes none through an
    exchange.
    """
    rows, intercept = load_parameters(params)
    text = F.coalesce(F.col("text"), F.lit(""))
    gate = F.when(text == "", "empty_input").when(T.strip(text) == "", "whitespace_only_input")
    if extractor is None:
        given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"gate": gate, "text_statistics": F.struct(*statistics_of(text))})
        table = feature_table(given, corpus, "id", "text", scorer, ("gate", "text_statistics", "sentences"), texts)
    else:
        given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        table = extractor(given.filter(gate.isNull())).unionByName(given.filter(gate.isNotNull()), allowMissingColumns=True)
        table = table.withColumns({"gate": gate, "text_statistics": F.struct(*statistics_of(text))})
    table = feature_array(table)
    usable = F.col("gate").isNull() & F.col("complete")
    p = F.when(usable, probability(rows, intercept))
    barred = F.transform("features", lambda f: F.struct(f["name"].alias("name"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("available"), F.col("gate").alias("reason")))
    none = F.array().cast("array<struct<sentence_id:int,text:string,perplexity:double,available:boolean,reason:string>>")

    def evidence(x, i):
        known = x["perplexity"].isNotNull()
        reason = F.when(~known, F.coalesce(x["reason"], F.lit("perplexity_unavailable")))
        return F.struct((i + 1).alias("sentence_id"), (x["sentence"] if texts else F.lit(None).cast("string")).alias("text"), x["perplexity"].alias("perplexity"), known.alias("available"), reason.alias("reason"))

    return table.select(
        F.col("id").alias(id_col),
        F.when(usable, "classified").otherwise("insufficient_evidence").alias("state"),
        F.when(p > 0.5, "ai_associated").when(usable, "human_associated").alias("label"),
        p.alias("ai_probability"),
        F.when(F.col("gate").isNull(), F.col("features")).otherwise(barred).alias("features"),
        F.when(F.col("gate").isNull(), F.coalesce(F.transform("sentences", evidence), none)).otherwise(none).alias("sentence_evidence"),
        "text_statistics",
    )


def lowest_evidence(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n sentences of lowest perplexity of each document; those equal to nine decimals in sentence order."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(rounded(F.col("perplexity"), 9), "sentence_id"))
    return scored.filter(F.col("perplexity").isNotNull()).withColumn("place", place).filter(F.col("place") <= n)


def verify_known(scored: DataFrame, known: DataFrame, *keys: str, tolerance: float = 1e-12) -> DataFrame:
    """Whether a model still gives known rows what it gave them: each must be found once, with the same prediction and p.

    ``known`` has the keys, expected_prediction and expected_p; a row that is missing or
    repeated is not verified.
    """
    found = scored.join(known.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("matches"), F.max("predicted").alias("observed_prediction"), F.max("p").alias("observed_p"))
    joined = known.join(found, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    delta = F.abs(F.col("observed_p") - F.col("expected_p"))
    same = (F.col("matches") == 1) & (F.col("observed_prediction") == F.col("expected_prediction")) & (delta <= tolerance)
    return joined.select(*keys, "matches", "expected_prediction", "observed_prediction", "expected_p", "observed_p", delta.alias("delta"), F.coalesce(same, F.lit(False)).alias("verified"))


def training_metadata(rows: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """One row on a training run: rows before and after the feature filter, and groups and rows on each side."""
    side = lambda name: F.col("split") == name
    kept = split.agg(
        F.count("*").alias("__kept"), F.count_distinct(F.when(side("train"), F.col(group))).alias("training_groups"), F.count_if(side("train")).alias("training_rows"),
        F.count_distinct(F.when(side("validation"), F.col(group))).alias("validation_groups"), F.count_if(side("validation")).alias("validation_rows"),
    )
    before = rows.agg(F.count("*").alias("rows_before_feature_filter"))
    dropped = (F.col("rows_before_feature_filter") - F.col("__kept")).alias("rows_dropped")
    return before.join(F.broadcast(kept)).select("rows_before_feature_filter", dropped, "training_groups", "training_rows", "validation_groups", "validation_rows")


def train(rows: DataFrame, group: str, path: str, seed: int, share: float = 0.2, label: str = "label", known: int = 5, tolerance: float = 1e-12) -> DataFrame:
    """One whole training run: split by group, fit, write, read back, and verify before anything uses it.

    ``rows`` has the group, the label and all features; rows without one of them are left
    out. The parameters go to ``path`` with one row of metadata. The first ``known`` rows of
    the validation side must then be found once each, and get the same prediction and the
    same p from what was read as from what was fitted, or the run fails. Returns the
    metadata with the number of rows that were verified.
    """
    spark = rows.sparkSession
    whole = rows.dropna(subset=[*FEATURES, label])
    split = stored(group_split(whole, group, share, seed), "split")
    failed = split_checks(split, group, label).filter("not passed").collect()
    if failed:
        raise ValueError(f"the split does not serve: {[r['check_name'] for r in failed]}")
    fitted, intercept = load_parameters(fit(split.filter("split = 'train'"), label))
    details = training_metadata(rows, split, group).withColumns({"feature_order": F.array(*map(F.lit, FEATURES)), "seed": F.lit(seed), "group": F.lit(group)})
    write_model(parameters(spark, tuple(fitted), intercept), path, details)
    read, read_intercept = load_parameters(read_parameters(spark, f"{path}/parameters"))
    asked = split.filter("split = 'validation'").withColumn("__key", F.concat_ws("#", F.col(group).cast("string"), F.col(label).cast("string")))
    scored = lambda values, constant: asked.select("__key", probability(values, constant).alias("p")).withColumn("predicted", (F.col("p") > 0.5).cast("int"))
    expected = scored(fitted, intercept).orderBy("__key").limit(known).select("__key", F.col("predicted").alias("expected_prediction"), F.col("p").alias("expected_p"))
    verdicts = verify_known(scored(read, read_intercept), expected, "__key", tolerance=tolerance).agg(F.count("*").alias("known"), F.count_if("verified").alias("verified")).first()
    if verdicts["verified"] < verdicts["known"]:
        raise ValueError(f"{verdicts['known'] - verdicts['verified']} of {verdicts['known']} known rows are not scored as before")
    return model_metadata(spark, path).withColumn("verified_rows", F.lit(verdicts["verified"]))


class Detector:
    """``analyze`` with everything in place, for any batch of documents: the language model is counted once, when it is made.

    A ``scorer`` or an ``extractor`` takes the corpus's place. Used as a context, it lets go
    of the model at the end.
    """

    def __init__(self, corpus: DataFrame | LanguageModel | None, params: DataFrame, scorer: TextScorer | None = None, extractor: Callable[[DataFrame], DataFrame] | None = None):
        needed = scorer is None and extractor is None
        if needed and corpus is None:
            raise ValueError("a corpus, a scorer or an extractor is needed")
        self.model = (corpus if isinstance(corpus, LanguageModel) else LanguageModel(corpus)) if needed else None
        self.params, self.scorer, self.extractor = params, scorer, extractor

    def __call__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return analyze(docs, self.model, self.params, id_col, text_col, self.scorer, self.extractor)

    def release(self) -> None:
        if self.model is not None:
            self.model.release()

    def __enter__(self) -> Detector:
        return self

    def __exit__(self, *failure: object) -> None:
        self.release()
