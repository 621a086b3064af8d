"""Document features with a reason wherever a value cannot be given.

Every feature is an expression over the arrays of a document's sentences and tokens, so
a document is measured in its row; only a language model too large for the tasks needs
an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import finite, ratio
from scrivener.operators.scoring import BigramTable, KeyFilter, PartialTable, TextScorer, whole_means
from scrivener.sources.scratch import scratch_path, stored

FEATURES = ("perplexity", "sentence_length_cv", "mattr", "pos_3gram_entropy")
REASONS = {"perplexity": "perplexity_reason", "sentence_length_cv": "cv_reason", "mattr": "mattr_reason", "pos_3gram_entropy": "pos_reason"}
MATTR_WINDOW = 25
CONTEXT_LIMIT = 1024
ADD_K = 0.5
#: Bigrams of a model that is sent to all tasks, at most: about 60 bytes each on the driver while they are packed, and 16 in every task.
BROADCAST_BIGRAMS = 1 << 21
#: Of a larger model the tasks get the most frequent words and bigrams, so many at most, and a filter over the others of so many bits. Bounds change no score.
SHIPPED_WORDS, SHIPPED_BIGRAMS, FILTER_BITS = 1 << 21, 1 << 20, 1 << 29
#: Counts up to this are told apart where the least count of those that are sent is looked for.
TOP_COUNT = 1 << 10


def context_limit(tokenizer_limit: int | None = CONTEXT_LIMIT, positions: int | None = CONTEXT_LIMIT) -> int | None:
    """The smaller of a tokenizer's limit (of no account unless between 0 and a million) and a model's positions; None if neither is known."""
    known = [x for x, ok in ((tokenizer_limit, tokenizer_limit is not None and 0 < tokenizer_limit < 1_000_000), (positions, positions is not None and positions > 0)) if ok]
    return min(known, default=None)


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_id from 1, sentence)."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.sentences(F.col(text_col))).alias("p", "sentence")).select("id", (F.col("p") + 1).alias("sentence_id"), "sentence")


def token_rows(docs: DataFrame, pattern: str = T.LEXICAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos from 0, token), lower-cased, in document order."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(T.tokens(F.col(text_col), pattern)).alias("pos", "token"))


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with these columns as a result of their own.

    A later filter on a computed column would otherwise be moved below its computation and
    written out there again, expression in expression.
    """
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*columns))))


def _with_variation(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and sentence_length_cv and cv_reason."""
    kept = rows.columns
    rows = rows.select(*kept, F.transform(T.sentences(F.coalesce(F.col("text"), F.lit(""))), lambda s: T.count_matches(s, T.COUNTED)).alias("__l"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate("__l", start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    # whole-number sums, read in one pass: the variance has no rounding before its division
    n, s, q = F.col("__m.n"), F.col("__m.s"), F.col("__m.q")
    reason = F.when(n < 2, "insufficient_sentences_for_cv: require_at_least=2").when(s == 0, "zero_mean_sentence_length")
    value = F.when((n >= 2) & (s > 0), F.sqrt(ratio(n * q - s * s, n * (n - 1))) / ratio(s, n))
    return rows.select(*kept, sums.alias("__m")).select(*kept, value.alias("sentence_length_cv"), reason.alias("cv_reason"))


def _with_mattr(rows: DataFrame, window: int = MATTR_WINDOW) -> DataFrame:
    """``rows`` (with a column text) and mattr and mattr_reason.

    A token at p is the first of its kind in every window that holds p but not the place
    of its last occurrence; summing how many windows that is gives all distinct counts in
    one pass. Sorting a document's (token, place) brings the last occurrence next to each
    token, so no row leaves its task.
    """
    kept = rows.columns
    rows = rows.select(*kept, T.tokens(F.coalesce(F.col("text"), F.lit(""))).alias("__w"))
    n = F.size("__w")
    places = F.sort_array(F.transform("__w", lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    rows = rows.select(*kept, n.alias("__n"), F.when(n >= window, places).alias("__s"))
    n = F.col("__n")
    before = F.concat(F.array(F.struct(F.lit("").alias("t"), F.lit(-1).alias("i"))), F.slice("__s", 1, n - 1))

    def new(x, y):
        last = F.when(x["t"] == y["t"], y["i"]).otherwise(-1)
        return F.greatest(F.lit(0), F.least(x["i"], n - window) - F.greatest(x["i"] - window + 1, last + 1, F.lit(0)) + 1)

    total = F.aggregate(F.zip_with("__s", before, new), F.lit(0).cast("long"), lambda a, x: a + x)
    reason = F.when(n < window, F.concat(F.lit("insufficient_tokens_for_window: have="), n.cast("string"), F.lit(f" require_at_least={window}")))
    return rows.select(*kept, F.when(n >= window, total / (window * (n - window + 1))).alias("mattr"), reason.alias("mattr_reason"))


def _with_entropy(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and pos_3gram_entropy and pos_reason.

    Equal trigrams lie side by side once a document's are sorted; the lengths of their
    runs are the counts.
    """
    kept = rows.columns
    rows = rows.select(*kept, F.transform(T.tokens(F.coalesce(F.col("text"), F.lit("")), T.COUNTED), T.tag).alias("__g"))
    return entropy_of_tags(rows).drop("__g")


def entropy_of_tags(rows: DataFrame) -> DataFrame:
    """``rows`` (with __g, an array of tags) and pos_3gram_entropy and pos_reason."""
    kept = rows.columns
    rows = rows.select(*kept, F.size("__g").alias("__n"), F.when(F.size("__g") >= 3, F.sort_array(T.grams(F.col("__g"), 3))).alias("__s"))
    after = F.concat(F.slice("__s", 2, F.size("__s") - 1), F.array(F.lit("")))
    ends = F.filter(F.transform(F.zip_with("__s", after, lambda x, y: x != y), lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    rows = rows.select(*kept, "__n", ends.alias("__p"))
    runs = F.zip_with("__p", F.concat(F.array(F.lit(-1)), F.slice("__p", 1, F.size("__p") - 1)), lambda x, y: (x - y).cast("double"))
    total = F.aggregate(runs, F.lit(0.0), lambda a, c: a + c * F.log2(c))
    n, grams = F.col("__n"), (F.col("__n") - 2).cast("double")
    reason = F.when(n < 3, F.concat(F.lit("insufficient_pos_tags_for_3grams: have="), n.cast("string"), F.lit(" require_at_least=3")))
    return rows.select(*kept, F.when(n >= 3, F.log2(grams) - total / grams).alias("pos_3gram_entropy"), reason.alias("pos_reason"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def sentence_length_cv(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sample deviation over mean of sentence lengths: (id, sentence_length_cv, cv_reason)."""
    return _with_variation(_texts(docs, id_col, text_col)).drop("text")


def mattr(docs: DataFrame, window: int = MATTR_WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Moving-average type-token ratio over full windows: (id, mattr, mattr_reason)."""
    return _with_mattr(_texts(docs, id_col, text_col), window).drop("text")


def pos_trigram_entropy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entropy in bits of tag trigrams, across sentences: (id, pos_3gram_entropy, pos_reason)."""
    return _with_entropy(_texts(docs, id_col, text_col)).drop("text")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The three features that need no language model, and their reasons, by one pass without an exchange."""
    return with_text_features(_texts(docs, id_col, text_col)).drop("text")


def with_text_features(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and the three features that need no language model, with their reasons."""
    return with_moving(_with_variation(rows))


def with_moving(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and the two features that move over tokens, with their reasons."""
    return _with_entropy(_with_mattr(rows))


def bigram_model(corpus: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of a reference corpus: bigrams (a, b, c_ab), contexts (a, c_a) and one row with v, the vocabulary size."""
    tokens = corpus.select(F.explode(T.sentences(F.col(text_col))).alias("s")).select(T.tokens(F.col("s")).alias("w"))
    pairs = tokens.filter(F.size("w") >= 2).select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    bigrams = pairs.groupBy("a", "b").agg(F.count("*").alias("c_ab"))
    contexts = bigrams.groupBy("a").agg(F.sum("c_ab").alias("c_a"))
    vocabulary = tokens.select(F.explode("w").alias("t")).agg(F.count_distinct("t").alias("v"))
    return bigrams, contexts, vocabulary


class LanguageModel:
    """The counts of a reference corpus, made once and used for every batch that is scored by them.

    Up to BROADCAST_BIGRAMS bigrams go to the tasks as arrays, and documents are scored in
    their rows. Of more the tasks get the most frequent ones and a filter that knows most
    pairs that the corpus lacks; only what is left is joined by shuffle. ``path`` is where
    bigrams are written, else a new folder of the shared one. ``release`` lets go of what
    the executors hold.
    """

    def __init__(self, corpus: DataFrame, text_col: str = "text", path: str | None = None):
        spark = corpus.sparkSession
        bigrams, _, sizes = bigram_model(corpus, text_col)
        path = path or scratch_path(spark, "bigrams")
        bigrams.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.bigrams = spark.read.schema(bigrams.schema).parquet(path)
        found = sizes_of(self.bigrams, sizes)
        self.vocabulary, self.small = found["v"], found["n"] <= BROADCAST_BIGRAMS
        if self.small:
            self.table = BigramTable(spark, self.bigrams.toArrow(), self.vocabulary)
            return
        self.contexts = self.bigrams.groupBy("a").agg(F.sum("c_ab").alias("c_a"))
        both = self.bigrams.select(F.col("a").alias("w"), F.col("c_ab").alias("c")).unionAll(self.bigrams.select("b", F.lit(0).cast("long")))
        words = stored(both.groupBy("w").agg(F.sum("c").alias("c_a")), "words")
        least, missing = least_count(words, "c_a", SHIPPED_WORDS)
        self.whole = not missing
        sent = words.filter(F.col("c_a") >= least)
        pairs = self.bigrams
        if missing:
            # a bigram whose words are not both sent is asked for, however frequent it is
            pairs = pairs.join(sent.select(F.col("w").alias("a")), "a", "left_semi").join(sent.select(F.col("w").alias("b")), "b", "left_semi")
        often, left = least_count(pairs, "c_ab", SHIPPED_BIGRAMS)
        frequent = pairs.filter(F.col("c_ab") >= often).select("a", "b", "c_ab")
        others = self.bigrams.select("a", "b") if missing else self.bigrams.filter(F.col("c_ab") < often).select("a", "b")
        contexts = words.filter((F.col("c_a") < least) & (F.col("c_a") > 0)).select("w") if missing else None
        keys = KeyFilter(others, contexts, found["n"] + missing if missing else left, FILTER_BITS)
        self.table = PartialTable(spark, sent.toArrow(), self.whole, frequent.toArrow(), keys, self.vocabulary)

    def release(self) -> None:
        self.table.release()


def least_count(rows: DataFrame, count: str, most: int) -> tuple[int, int]:
    """The least count such that ``most`` rows at most have it or more, and how many rows have less. Above TOP_COUNT in powers of two."""
    c = F.col(count)
    step = F.when(c <= TOP_COUNT, c).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(c.cast("double")))).cast("long"))
    left = sorted(((r["step"], r["n"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, held, least = sum(n for _, n in left), 0, None
    for at, n in left:
        if held + n > most:
            break
        held, least = held + n, at
    if least is None:
        least = 1 + 2 * max(at for at, _ in left) if left else 0
    return least, total - held


def sizes_of(bigrams: DataFrame, vocabulary: DataFrame) -> dict[str, int]:
    """v, the distinct words, and n, the distinct bigrams."""
    return {"v": vocabulary.first()["v"], "n": bigrams.count()}


def _nll_by_shuffle(rows: DataFrame, model: LanguageModel, k: float, limit: int) -> DataFrame:
    """``rows`` (__w, ...) with __n and __nll in place of __w, by counts that are too many for the tasks.

    A task scores the sentences whose counts it all knows, and asks for the pairs of others
    that the filter may hold. Rows are stored with a number, and with the counts of the
    latter sentences in place of tokens; answers come back to them by that number, so that no
    text is shuffled unless the caller's rows hold one.
    """
    rows = rows.withColumn("__p", model.table.partial(F.col("__w"), k, limit)).drop("__w")
    kept = [c for c in rows.columns if c != "__p"]
    rows = stored(rows.select(F.monotonically_increasing_id().alias("__row"), *kept, "__p.*"), "sentences")
    asked = rows.select("__row", F.inline("asked")).join(model.bigrams, ["a", "b"], "left" if not model.whole else "inner")
    asked = asked.withColumn("c_a", F.lit(None).cast("long")) if model.whole else asked.join(model.contexts, "a", "left")
    held = asked.groupBy("__row").agg(F.collect_list(F.struct("at", "c_ab", "c_a")).alias("__x"))
    joined = rows.drop("asked").join(held, "__row", "left")
    nll = whole_means([F.col(c) for c in ("sizes", "means", "open")], F.col("__x"), model.vocabulary, k, limit)
    return joined.withColumn("__nll", nll).withColumnRenamed("sizes", "__n").select(*kept, "__n", "__nll")


def _by_counts(rows: DataFrame, kept: list[str], words: Column, model: LanguageModel, k: float, limit: int) -> DataFrame:
    """The columns ``kept``, and __n and __nll, the sizes and mean negative log-likelihoods of sentences, for an array of each one's tokens."""
    rows = rows.select(*kept, words.alias("__w"))
    if not model.small:
        return _nll_by_shuffle(rows, model, k, limit)
    return rows.select(*kept, F.transform("__w", F.size).alias("__n"), model.table.nll(F.col("__w"), k, limit).alias("__nll"))


def with_sentences(
    rows: DataFrame, corpus: DataFrame | LanguageModel | None, k: float = ADD_K, limit: int | None = None, scorer: TextScorer | None = None, given: Column | None = None, texts: bool = True
) -> DataFrame:
    """``rows`` (id, text, ...) with ``sentences``: an array of (sentence, n_tokens, perplexity, status, reason, warning).

    By an add-k bigram model of ``corpus`` unless a ``scorer`` of texts is given. The
    first token of a sentence is not scored; a sentence over the context limit has no
    value, and is never cut. ``given`` holds the sentences, where they are known already.
    Without ``texts`` the column text goes and ``sentence`` is null, so that scores by a
    large model take no text through an exchange.
    """
    limit = context_limit() if limit is None else limit
    kept = [c for c in rows.columns if texts or c != "text"]
    cut = T.sentences(F.coalesce(F.col("text"), F.lit(""))) if given is None else given
    none = F.lit(None).cast("string")
    if scorer is not None:
        rows = rows.select(*kept, cut.alias("__s")).withColumn("__x", scorer.scores(F.col("__s")))
        found = F.zip_with("__s", "__x", lambda s, x: F.struct((s if texts else none).alias("sentence"), x["n_tokens"].alias("n_tokens"), F.when((x["status"] == "ok") & (x["n_tokens"] <= limit), x["nll"]).alias("nll"), x["status"].alias("said")))
    else:
        model = corpus if isinstance(corpus, LanguageModel) else LanguageModel(corpus)
        words = lambda sentences: F.transform(sentences, lambda s: T.tokens(s))
        if not texts:
            rows = _by_counts(rows, kept, words(cut), model, k, limit).withColumn("__s", F.transform("__n", lambda n: none))
        elif model.small:
            rows = _by_counts(rows.select(*kept, cut.alias("__s")), [*kept, "__s"], words(F.col("__s")), model, k, limit)
        else:
            # cut once more behind the exchange, which sentences beside their text would double
            rows = _by_counts(rows, kept, words(cut), model, k, limit).withColumn("__s", cut)
        sizes = F.zip_with("__s", "__n", lambda s, n: F.struct(s.alias("sentence"), n.alias("n_tokens")))
        found = F.zip_with(sizes, "__nll", lambda s, x: F.struct(s["sentence"].alias("sentence"), s["n_tokens"].alias("n_tokens"), x.alias("nll"), F.lit("ok").alias("said")))

    def cell(x):
        size, value = x["n_tokens"], finite(F.exp(x["nll"]))
        status = F.when(size < 2, "insufficient_input").when(size > limit, "exceeds_context").when(x["said"] != "ok", x["said"]).when(value.isNull(), "non_finite").otherwise("ok")
        reason = F.when((size > limit) | (x["said"] == "exceeds_context"), "sentence_exceeds_language_model_context").when(value.isNull(), "perplexity_unavailable")
        warning = F.when(size == 2, "one_usable_prediction")
        return F.struct(x["sentence"].alias("sentence"), size.alias("n_tokens"), F.when(size >= 2, value).alias("perplexity"), status.alias("status"), reason.alias("reason"), warning.alias("warning"))

    return rows.select(*kept, found.alias("__f")).select(*kept, F.transform("__f", cell).alias("sentences"))


def sentence_perplexity(
    docs: DataFrame, corpus: DataFrame | LanguageModel | None, k: float = ADD_K, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text", scorer: TextScorer | None = None, texts: bool = True
) -> DataFrame:
    """Perplexity of every sentence: id, sentence_id, sentence (null without ``texts``), n_tokens, perplexity, status, reason and warning.

    Status is ``ok``, ``insufficient_input`` below two tokens, ``exceeds_context``,
    ``non_finite``, or what a ``scorer`` says; a warning tells of one prediction only.
    """
    rows = with_sentences(_texts(docs, id_col, text_col), corpus, k, limit, scorer, texts=texts)
    return rows.select("id", F.posexplode("sentences").alias("p", "x")).select("id", (F.col("p") + 1).alias("sentence_id"), "x.*")


def middle(values: Column) -> Column:
    """Median of the non-null values of an array; null if there are none."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.transform(F.array(known), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)[0]


def prefix_scores(docs: DataFrame, corpus: DataFrame | LanguageModel, targets: tuple[int, ...], k: float = ADD_K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, target, n_tokens, scored, nll, perplexity) of the first min(target, n) words of every text.

    Each word is scored once, given the one before it; running sums give the mean at every
    target, so no prefix is scored again. Null below two words.
    """
    model = corpus if isinstance(corpus, LanguageModel) else LanguageModel(corpus)
    rows = docs.select(F.col(id_col).alias("id"), F.slice(T.tokens(F.coalesce(F.col(text_col), F.lit(""))), 1, max(targets)).alias("w"))
    if model.small:
        rows = rows.select("id", F.size("w").alias("n"), model.table.running(F.col("w"), k).alias("sums"))
    else:
        # a document's words are one sentence each two of them, so that the joined counts come back by place
        pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))
        rows = rows.select("id", F.size("w").alias("n"), F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<array<string>>")).alias("__w"))
        rows = _nll_by_shuffle(rows, model, k, 2)
        start = F.array().cast("array<double>")
        rows = rows.select("id", "n", F.aggregate("__nll", start, lambda s, x: F.array_append(s, F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) + x)).alias("sums"))
    rows = rows.select("id", "n", "sums", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    size = F.least("target", "n")
    nll = F.when(size >= 2, F.get("sums", size - 2) / (size - 1))
    return rows.select("id", "target", size.alias("n_tokens"), F.greatest(size - 1, F.lit(0)).alias("scored"), nll.alias("nll"), finite(F.exp(nll)).alias("perplexity"))


def with_median(rows: DataFrame) -> DataFrame:
    """``rows`` (with sentences) and perplexity, the median of those that exist, and perplexity_reason."""
    rows = rows.withColumn("perplexity", middle(F.transform("sentences", lambda x: x["perplexity"])))
    return rows.withColumn("perplexity_reason", F.when(F.col("perplexity").isNull(), "no_valid_sentence_perplexity_values"))


def document_perplexity(docs: DataFrame, corpus: DataFrame | LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", scorer: TextScorer | None = None) -> DataFrame:
    """Median of the sentence perplexities that exist: (id, perplexity, perplexity_reason)."""
    return with_median(with_sentences(_texts(docs, id_col, text_col), corpus, scorer=scorer, texts=False)).drop("sentences")


def statistics_of(t: Column) -> list[Column]:
    """Characters, words, sentences, lexical tokens, counted tokens and non-space tokens of a text."""
    return [
        F.length(t).cast("long").alias("char_count"), T.word_count(t).alias("word_count"), F.size(T.sentences(t)).cast("long").alias("sentence_count"),
        T.count_matches(t, T.LEXICAL).alias("lexical_tokens"), T.count_matches(t, T.COUNTED).alias("counted_tokens"), T.count_matches(t, T.NON_SPACE).alias("non_space_tokens"),
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every document; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), *statistics_of(F.coalesce(F.col(text_col), F.lit(""))))


def feature_table(docs: DataFrame, corpus: DataFrame | LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", scorer: TextScorer | None = None, keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """All four features of every document and their reasons, one row each, in one pass over the documents.

    ``keep`` names further columns to carry along: those of ``docs``, ``text`` and
    ``sentences`` (each with its perplexity; without ``texts`` a large model gives them
    without their text).
    """
    own = [c for c in keep if c not in ("text", "sentences")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *own)
    model = corpus if scorer is not None or isinstance(corpus, LanguageModel) else LanguageModel(corpus)
    if scorer is not None or model.small or texts and "sentences" in keep:
        rows = with_text_features(with_median(with_sentences(rows, model, scorer=scorer)))
    else:
        # measured before the exchange, so that no text goes through it that is not kept
        rows = with_text_features(rows).withColumn("__kept", F.col("text") if "text" in keep else F.lit(None).cast("string"))
        rows = with_median(with_sentences(rows, model, texts=False))
        rows = rows.select("id", F.col("__kept").alias("text"), *[c for c in rows.columns if c not in ("id", "__kept")])
    rows = settled(rows, *FEATURES, *REASONS.values())
    return rows.drop(*[c for c in ("text", "sentences") if c not in keep])


def feature_array(table: DataFrame) -> DataFrame:
    """``table`` with ``features``: an array of (name, value, available, reason) in the fixed order, and ``complete``."""
    cells = []
    for name in FEATURES:
        value = finite(F.col(name))
        reason = F.when(value.isNull(), F.coalesce(F.col(REASONS[name]), F.lit(f"{name}_unavailable")))
        cells.append(F.struct(F.lit(name).alias("name"), value.alias("value"), value.isNotNull().alias("available"), reason.alias("reason")))
    complete = F.lit(True)
    for name in FEATURES:
        complete = complete & finite(F.col(name)).isNotNull()
    return table.withColumn("features", F.array(*cells)).withColumn("complete", complete)


def reason_counts(table: DataFrame) -> DataFrame:
    """(feature, reason, n) of all unavailable values."""
    cells = feature_array(table).select(F.explode("features").alias("f"))
    return cells.filter(~F.col("f.available")).groupBy(F.col("f.name").alias("feature"), F.col("f.reason").alias("reason")).agg(F.count("*").alias("n"))
