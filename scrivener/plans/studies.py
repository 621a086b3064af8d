"""Registered queries of scorers, refits, leakage, large quantiles and frozen selections, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import rounded
from scrivener.operators import evaluate as E
from scrivener.operators import features as X
from scrivener.operators import frozen, leakage, quantiles, refits, scoring, wordclass
from scrivener.operators import hybrid as H
from scrivener.operators import model as M
from scrivener.operators import profile as P
from scrivener.operators import sampling as S
from scrivener.plans import oracles as O
from scrivener.plans.queries import SEED, _docs, _labelled_words, _pair_features, _pairs, _six, _turns
from scrivener.sources.scratch import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Letters and stop of the closed-form scorer, and parameters for the perplexities that it gives.
LETTERS, STOP = 26, 0.2
LETTER_PARAMETERS = (("perplexity", 3e7, 2e7, -1.2), *M.PARAMETERS[1:])
TARGETS = (10, 25, 50, 100, 200)
SEEDS = (1, 2, 3, 4, 5)
PROBS = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def _scorer():
    return scoring.LetterModel(LETTERS, STOP).scorer()


@register
def scored_by_text(spark, d):
    """Every sentence by a scorer that is given its text."""
    rows = X.sentence_perplexity(_docs(spark, d), None, scorer=_scorer())
    return _six(rows.select(F.col("id").alias("doc_id"), "sentence_id", "n_tokens", F.ln("perplexity").alias("nll"), "status", "warning"))


@register
def analyze_injected(spark, d):
    """The detector with an extractor of the caller's in place of its own."""
    extract = lambda rows: X.feature_table(rows, None, "id", scorer=_scorer(), keep=("text", "sentences"))
    detector = M.Detector(None, M.parameters(spark, LETTER_PARAMETERS), extractor=extract)
    found = detector(_docs(spark, d))
    return _six(found.select("doc_id", "state", "label", "ai_probability", F.size("sentence_evidence").alias("n_evidence"), F.size(F.filter("features", lambda f: f["available"])).alias("n_available")))


@register
def training_run(spark, d):
    """Fit on pairs, write, read back and verify: what the run says of itself."""
    found = M.train(_pair_features(spark, d), "pair_id", scratch_path(spark, "model"), SEED)
    return found.select("rows_before_feature_filter", "rows_dropped", "training_groups", "training_rows", "validation_groups", "validation_rows", F.col("verified_rows").cast("bigint").alias("verified_rows"))


@register
def threshold_heldout(spark, d):
    """A threshold on perplexity that the training half chose, judged on the validation half."""
    rows = S.group_split(_pair_features(spark, d).dropna(subset=list(X.FEATURES)), "pair_id", 0.2, SEED)
    rows = stored(rows.select("label", "split", rounded(F.col("perplexity"), 6).alias("perplexity")), "halves")
    chosen = E.best_threshold(rows.filter("split = 'train'"), "perplexity", width=16.0).select("threshold")
    judged = rows.filter("split = 'validation'").join(F.broadcast(chosen)).withColumn("predicted", (F.col("perplexity") <= F.col("threshold")).cast("int"))
    return _six(E.metrics(judged, "threshold"))


def _lengths(spark, d):
    return _labelled_words(spark, d).select("doc_id", "source", "label", F.ln(F.col("words") + F.lit(1.0)).alias("x"))


@register
def group_refits(spark, d):
    """Each source judged by a model of text length that was fitted to all others."""
    found = refits.group_refits(_lengths(spark, d), "source", ("x",))
    return _six(found.select("source", F.col("n_train").cast("bigint").alias("n_train"), "n_test", "accuracy", F.get("weights", F.lit(0)).alias("weight"), "constant"))


@register
def group_refits_features(spark, d):
    """Each source judged by a model of all four features that was fitted to all others."""
    labels = _labelled_words(spark, d).select("doc_id", "label")
    rows = X.feature_table(_docs(spark, d).join(labels, "doc_id"), _turns(spark, d), keep=("source", "label"))
    return _six(refits.group_refits(rows, "source", X.FEATURES).select("source", "n_train", "n_test", "accuracy"))


@register
def seed_refits(spark, d):
    """A model of text length for every seed, judged by the documents that its resampling left out; then mean and deviation over seeds."""
    return _six(refits.over_seeds(refits.seed_refits(_lengths(spark, d), "doc_id", SEEDS, ("x",))))


@register
def near_copy_leakage(spark, d):
    """Documents whose five-word shingles another shares to eight tenths, and whether they lie on different sides of a split by source."""
    docs = _docs(spark, d).withColumn("split", S.three_way(F.col("source"), SEED))
    return leakage.near_copies(docs, "split")


@register
def marker_leakage(spark, d):
    return _six(leakage.marker_shares(H.unpivot(_pairs(spark, d)), P.LEAKAGE))


@register
def metadata_fit(spark, d):
    """Area under the curve of a model that sees language, source and order of length only."""
    rows = _labelled_words(spark, d).withColumn("size", F.floor(F.log2(F.col("words") + F.lit(1))).cast("string"))
    return _six(E.roc_auc(leakage.metadata_scores(rows, ("lang", "source", "size"), "doc_id", SEED)))


def _prefix_scores(spark, d):
    # to nine decimals, so that sums do not turn on the last bit of a logarithm
    rows = X.prefix_scores(_docs(spark, d), _turns(spark, d), TARGETS)
    return rows.withColumns({"nll": rounded(F.col("nll"), 9), "perplexity": rounded(F.col("perplexity"), 6)})


@register
def prefix_perplexity(spark, d):
    """Perplexity and mean negative log-likelihood by prefix length over all documents."""
    rows = _prefix_scores(spark, d)
    both = [P.summary_by_target(rows, v).select("target", *[F.col(c).alias(f"{v}_{c}") for c in ("n", "mean", "median", "min", "max", "stdev", "cv")]) for v in ("perplexity", "nll")]
    found = both[0].join(both[1], "target")
    # six significant places at the size of the values
    return found.select("target", F.col("nll_n").alias("n"), *[rounded(F.col(f"{v}_{c}"), 3 if v == "perplexity" and c != "cv" else 5).alias(f"{v}_{c}") for v in ("perplexity", "nll") for c in ("mean", "median", "min", "max", "stdev", "cv")])


@register
def prefix_first_to_final(spark, d):
    found = P.first_to_final(_prefix_scores(spark, d), "nll")
    return _six(found.withColumnRenamed("id", "doc_id"))


@register
def length_quantiles(spark, d):
    """Quantiles of text length by language, without any language in one task."""
    rows = _docs(spark, d).withColumn("n_chars", F.length("text"))
    return _six(quantiles.quantiles(rows, "n_chars", PROBS, "lang"))


@register
def frozen_manifest(spark, d):
    """The digest tree over all pairs."""
    return frozen.digest_tree(_pairs(spark, d), "pair_id", 2)


@register
def learned_tag_entropy(spark, d):
    """Tag-trigram entropy by word classes that were learned from the conversations."""
    tags = wordclass.tagger(wordclass.induce(_turns(spark, d)))
    return _six(wordclass.learned_entropy(_docs(spark, d), tags).withColumnRenamed("id", "doc_id"))


_W = O.tokens("s")
_A = f"(ln({LETTERS}) - ln(1 - {STOP}))"
_B = f"(ln(1 - {STOP}) - ln({STOP}))"
_LETTER_NLL = f"CASE WHEN len(w) > 1 THEN list_sum(list_transform(w[2:], lambda x: length(x) * {_A} + {_B})) / (len(w) - 1) END"


def _letters(rel: str) -> str:
    """(id, sentence_id, n_tokens, nll)"""
    return f"""(SELECT id, sentence_id, len(w) AS n_tokens, {_LETTER_NLL} AS nll FROM
        (SELECT id, sentence_id, {_W} AS w FROM (SELECT id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS sentence_id FROM (SELECT id, {O.sentences('text')} AS l FROM ({rel})))))"""


_Z = " + ".join([str(M.INTERCEPT), *[f"(({n}) - {m}) / {s} * {c}" for n, m, s, c in LETTER_PARAMETERS]])
_XY = f"(SELECT doc_id, source, label, ln(words + 1.0::DOUBLE) AS x FROM {O._WORDS})"
_POISSON = " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in refits.POISSON)


def _newton(models: str, steps: int = 25) -> str:
    """CTEs ``fit`` (m, w1, w0) of rows ``r`` (m, x, y, w): a one-feature logistic fit a model, by Newton steps with closed two-by-two solutions."""
    return f"""mo AS MATERIALIZED (SELECT m, sum(w) AS n, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS scale FROM r GROUP BY m),
        z AS MATERIALIZED (SELECT r.m, (x - mean) / scale AS z, y, w FROM r JOIN mo USING (m) WHERE w > 0),
        it AS (SELECT m, 0 AS k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b0 FROM mo
            UNION ALL
            SELECT m, k + 1, any_value(b1) - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), any_value(b0) - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) FROM
                (SELECT m, k, any_value(b1) AS b1, any_value(b0) AS b0, sum(w * (p - y)) AS g0, sum(w * (p - y) * z) + any_value(b1) AS g1,
                        sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * z) AS h01, sum(w * p * (1 - p) * z * z) + 1 AS h11
                 FROM (SELECT it.m, k, b1, b0, z, y, w, 1 / (1 + exp(-(b1 * z + b0))) AS p FROM it JOIN z USING (m) WHERE k < {steps}) GROUP BY m, k)
            GROUP BY m, k, h00, h01, h11, g0, g1),
        fit AS (SELECT m, n, b1 / scale AS w1, b0 - b1 / scale * mean AS w0 FROM it JOIN mo USING (m) WHERE k = {steps})"""


_SHINGLES = f"""d AS MATERIALIZED (SELECT doc_id, {O._SPLIT_OF('source')} AS split, {O.tokens('text', O.COUNTED)} AS w FROM documents),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        k AS MATERIALIZED (SELECT d.doc_id, any_value(split) AS split, count(s) AS n, coalesce(md5(string_agg(s, '|' ORDER BY s)), '#' || d.doc_id) AS h FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id),
        c AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS class_size FROM k),
        p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id WHERE x.doc_id IN (SELECT class_id FROM c) AND y.doc_id IN (SELECT class_id FROM c) GROUP BY a, b),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE o / (x.n + y.n - o) >= 0.8)"""
_PREFIX = f"""w AS MATERIALIZED (SELECT id, ({O.tokens("coalesce(text, '')")})[1:{max(TARGETS)}] AS w FROM ({O.DOCS})), b AS MATERIALIZED {O.bigrams(O.CORPUS)}, c AS (SELECT a, sum(c_ab) AS c_a FROM b GROUP BY a),
        v AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest({_W}) AS t FROM (SELECT unnest({O.sentences('text')}) AS s FROM ({O.CORPUS})))),
        p AS (SELECT id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b, unnest(range(2, len(w) + 1)) AS i FROM w WHERE len(w) >= 2),
        s AS MATERIALIZED (SELECT id, i, -ln((coalesce(c_ab, 0) + 0.5) / (coalesce(c_a, 0) + 0.5 * v)) AS l FROM p LEFT JOIN b USING (a, b) LEFT JOIN c USING (a) CROSS JOIN v),
        t AS (SELECT id, len(w) AS n, unnest([{', '.join(map(str, TARGETS))}]) AS target FROM w),
        m AS MATERIALIZED (SELECT id, target, least(target, n) AS n_tokens, {O.six('avg(l)', 9)} AS nll, {O.six('exp(avg(l))')} AS perplexity FROM t JOIN s USING (id) WHERE i <= target GROUP BY id, target, n)"""
_STATS = {"mean": "sum({v}::DECIMAL(28, 9))::DOUBLE / count(*)", "median": "median({v})", "min": "min({v})", "max": "max({v})", "stdev": "stddev_samp({v})", "cv": "stddev_samp({v}) / avg({v})"}
_META = O.ORACLE_SQL["training_metadata"]

ORACLE_SQL: dict[str, str] = {
    "scored_by_text": f"""SELECT id AS doc_id, sentence_id, n_tokens, CASE WHEN n_tokens <= 1024 THEN {O.six('nll')} END AS nll, CASE WHEN n_tokens < 2 THEN 'insufficient_input' WHEN n_tokens > 1024 THEN 'exceeds_context' ELSE 'ok' END AS status,
        CASE WHEN n_tokens = 2 THEN 'one_usable_prediction' END AS warning FROM {_letters(O.DOCS)}""",
    "analyze_injected": f"""WITH s AS MATERIALIZED (SELECT id, count(*) AS n, median(exp(nll)) FILTER (n_tokens <= 1024) AS perplexity FROM {_letters(O.DOCS)} GROUP BY id),
        f AS (SELECT d.doc_id, coalesce(n, 0) AS n_evidence, perplexity, sentence_length_cv, mattr, pos_3gram_entropy FROM documents d LEFT JOIN s ON s.id = d.doc_id
              JOIN {O.cv(O.DOCS)} v ON v.id = d.doc_id JOIN {O.mattr(O.DOCS)} m ON m.id = d.doc_id JOIN {O.pos(O.DOCS)} g ON g.id = d.doc_id),
        p AS (SELECT *, CASE WHEN {O._WHOLE} THEN 1 / (1 + exp(-({_Z}))) END AS p FROM f)
        SELECT doc_id, CASE WHEN p IS NULL THEN 'insufficient_evidence' ELSE 'classified' END AS state, CASE WHEN p > 0.5 THEN 'ai_associated' WHEN p IS NOT NULL THEN 'human_associated' END AS label, {O.six('p')} AS ai_probability,
            n_evidence, (perplexity IS NOT NULL)::INT + (sentence_length_cv IS NOT NULL)::INT + (mattr IS NOT NULL)::INT + (pos_3gram_entropy IS NOT NULL)::INT AS n_available FROM p""",
    "training_run": f"SELECT *, least(5, validation_rows) AS verified_rows FROM ({_META})",
    "threshold_heldout": f"""WITH f AS MATERIALIZED (SELECT pair_id, label, {O.six('perplexity')} AS v FROM side_features WHERE {O._WHOLE}),
            g AS (SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}|' || pair_id), pair_id) <= ceil(count(*) OVER () * 0.2) THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT pair_id FROM f)),
            s AS MATERIALIZED (SELECT * FROM f JOIN g USING (pair_id)), t AS (SELECT * FROM s WHERE split = 'train'),
            c AS (SELECT a.v AS threshold, 2 * count(*) FILTER (b.label = 1) / (count(*) + (SELECT count(*) FROM t WHERE label = 1)) AS f1 FROM (SELECT DISTINCT v FROM t) a JOIN t b ON b.v <= a.v GROUP BY a.v ORDER BY f1 DESC, threshold LIMIT 1),
            j AS MATERIALIZED (SELECT label, (v <= threshold)::INT AS predicted, {O.six('threshold')} AS threshold FROM s, c WHERE split = 'validation')
        {O.metrics('j', 'threshold')}""",
    "group_refits": f"""WITH RECURSIVE a AS MATERIALIZED (SELECT * FROM {_XY}), r AS MATERIALIZED (SELECT g.source AS m, x, label AS y, (a.source <> g.source)::INT AS w FROM a, (SELECT DISTINCT source FROM a) g), {_newton('source')}
        SELECT source, n::BIGINT AS n_train, count(*) AS n_test, {O.six('count(*) FILTER ((w1 * x + w0 > 0) = (label = 1)) / count(*)')} AS accuracy, {O.six('w1')} AS weight, {O.six('w0')} AS constant
        FROM a JOIN fit ON m = source GROUP BY source, n, w1, w0""",
    "seed_refits": f"""WITH RECURSIVE a AS MATERIALIZED (SELECT * FROM {_XY}),
        u AS (SELECT seed, x, label, ('0x' || substr(md5(seed || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM a, (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed)),
        r AS MATERIALIZED (SELECT seed AS m, x, label AS y, {_POISSON} AS w FROM u), {_newton('seed')},
        e AS (SELECT m, count(*) FILTER ((w1 * x + w0 > 0) = (y = 1)) / count(*) AS accuracy FROM r JOIN fit USING (m) WHERE w = 0 GROUP BY m)
        SELECT count(accuracy) AS runs, {O.six('avg(accuracy)')} AS mean_accuracy, {O.six('stddev_samp(accuracy)')} AS sd_accuracy FROM e""",
    "near_copy_leakage": f"""WITH {_SHINGLES}
        SELECT c.doc_id, c.split, c.class_id, c.class_size, (SELECT count(*) FROM l WHERE a = c.class_id) AS links,
            (SELECT count(DISTINCT o.split) FROM c o WHERE o.class_id = c.class_id OR o.class_id IN (SELECT b FROM l WHERE a = c.class_id)) > 1 AS crosses FROM c""",
    "marker_leakage": f"""SELECT marker, label, count(*) AS n, count(*) FILTER (contains(lower(text), marker)) AS with_marker, {O.six('count(*) FILTER (contains(lower(text), marker)) / count(*)')} AS share
        FROM ({O.SIDES}), (SELECT unnest([{', '.join(repr(m) for m in P.LEAKAGE)}]) AS marker) GROUP BY marker, label""",
    "prefix_perplexity": f"""WITH {_PREFIX} SELECT target, count(*) AS n, {', '.join(O.six(sql.format(v=v), 3 if v == 'perplexity' and c != 'cv' else 5) + f' AS {v}_{c}' for v in ('perplexity', 'nll') for c, sql in _STATS.items())} FROM m GROUP BY target""",
    "prefix_first_to_final": f"""WITH {_PREFIX}, e AS (SELECT id, count(*) AS points, arg_min(nll, n_tokens * 1000 + target) AS f, arg_max(nll, n_tokens * 1000 + target) AS l FROM m GROUP BY id)
        SELECT id AS doc_id, points, {O.six('f')} AS first, {O.six('l')} AS final, {O.six('l - f')} AS absolute_change, {O.six('(l - f) / f')} AS relative_change FROM e""",
    "length_quantiles": " UNION ALL ".join(f"SELECT lang, {p}::DOUBLE AS prob, {O.six(f'quantile_cont(length(text)::DOUBLE, {p})')} AS value FROM documents GROUP BY lang" for p in PROBS),
    "frozen_manifest": f"""WITH i AS (SELECT pair_id AS id, substr(sha256(pair_id), 1, 2) AS prefix FROM ({O.PAIRS})), a AS (SELECT prefix, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM i GROUP BY prefix),
        b AS (SELECT substr(prefix, 1, 1) AS parent, sum(n)::BIGINT AS n, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM a GROUP BY parent)
        SELECT 2 AS level, * FROM a UNION ALL SELECT 1, * FROM b UNION ALL SELECT 0, '', sum(n)::BIGINT, sha256(string_agg(parent || ':' || digest, chr(10) ORDER BY parent)) FROM b""",
}

ORACLE_SQL = {name: O.unicode_spaces(O.whole(sql)) for name, sql in ORACLE_SQL.items()}
