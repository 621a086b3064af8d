"""Injected scorers and extractors, removal attribution, training runs and refits against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scrivener.operators import attribution, features, hybrid, model, scoring

WORDS = "the cat of sat running 12 mat wordly and dog ran quickly heit bon nation".split()


def passage(rng, sentences, low=3, high=14):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", "!", "?"]) for _ in range(sentences))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def corpus(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(passage(rng, 30),) for _ in range(20)], "text string")


# a scorer that sees text


def fake_scorer(batches=None):
    def load():
        def score(texts):
            return [(math.log(len(t) + 1), len(t.split()), "ok") for t in texts]

        return score

    return scoring.TextScorer("length-plus-one", load, batch=3)


def test_fake_scorer_gives_every_sentence_its_perplexity(spark):
    docs = frame(spark, ["One two three. Four five!", "Alone. Two words here", None, "", "?!"])
    got = features.sentence_perplexity(docs, None, scorer=fake_scorer()).collect()
    assert {(r.id, r.sentence_id): r.sentence for r in got} == {(0, 1): "One two three.", (0, 2): "Four five!", (1, 1): "Alone.", (1, 2): "Two words here"}
    for r in got:
        n = len(r.sentence.split())
        assert r.n_tokens == n and r.status == ("ok" if n > 1 else "insufficient_input")
        assert (r.perplexity is None) == (n < 2) and (n < 2 or math.isclose(r.perplexity, len(r.sentence) + 1))
        assert r.warning == ("one_usable_prediction" if n == 2 else None)
    table = {r.id: r for r in features.feature_table(docs, None, scorer=fake_scorer()).collect()}
    assert math.isclose(table[0].perplexity, (len("One two three.") + 1 + len("Four five!") + 1) / 2)
    assert table[2].perplexity_reason == table[3].perplexity_reason == "no_valid_sentence_perplexity_values"


def test_scorer_statuses_limits_and_bad_answers(spark):
    def load():
        return lambda texts: [(None, 9, "error") if "bad" in t else (math.inf, 9, "ok") if "huge" in t else (1.0, 2000 if "long" in t else 9, "ok") for t in texts]

    docs = frame(spark, ["A bad one. A huge one. A long one. A fine one."])
    got = {r.sentence_id: r for r in features.sentence_perplexity(docs, None, scorer=scoring.TextScorer("statuses", load)).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["error", "non_finite", "exceeds_context", "ok"]
    assert [got[i].reason for i in (1, 2, 3, 4)] == ["perplexity_unavailable", "perplexity_unavailable", "sentence_exceeds_language_model_context", None]
    assert got[4].perplexity == pytest.approx(math.e) and all(got[i].perplexity is None for i in (1, 2, 3))
    with pytest.raises(Exception, match="status"):
        features.sentence_perplexity(docs, None, scorer=scoring.TextScorer("short", lambda: lambda texts: [])).collect()


def test_letter_model_in_closed_form(spark):
    scorer = scoring.LetterModel(26, 0.25).scorer()
    (row,) = features.sentence_perplexity(frame(spark, ["Ab abc d."]), None, scorer=scorer).collect()
    each = [-math.log(0.25 * 0.75 ** (n - 1) / 26**n) for n in (3, 1)]
    assert row.n_tokens == 3 and row.perplexity == pytest.approx(math.exp(sum(each) / 2))


def test_model_sizes_give_equal_scores(spark, monkeypatch):
    docs = frame(spark, [passage(random.Random(k), 6) for k in range(8)] + ["unseen words only. the unseen the.", "", None])
    found = lambda: sorted(map(tuple, features.sentence_perplexity(docs, corpus(spark)).collect()))
    small = found()
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    large = found()
    assert len(small) == len(large) and all(a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-12) and a[5:] == b[5:] for a, b in zip(small, large, strict=True))


@pytest.mark.parametrize("words, bigrams, bits", [(1 << 20, 1 << 20, 1 << 20), (1 << 20, 4, 1 << 20), (1 << 20, 0, 4096), (6, 4, 1 << 20), (0, 0, 4096)])
def test_what_tasks_lack_of_a_large_model_changes_no_bit(spark, monkeypatch, words, bigrams, bits):
    texts = [passage(random.Random(k), 6) for k in range(8)] + ["unseen words only. the unseen the.", "", None, "One.", "the " * 1025 + "end. the the the."]
    docs = frame(spark, texts)
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 1 << 21)
    found = lambda: sorted(map(tuple, features.sentence_perplexity(docs, corpus(spark)).collect()))
    small = found()
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    for name, value in (("SHIPPED_WORDS", words), ("SHIPPED_BIGRAMS", bigrams), ("FILTER_BITS", bits)):
        monkeypatch.setattr(features, name, value)
    # not nearly: sums follow the order of the tokens, wherever their counts come from
    assert found() == small


def test_no_text_is_stored_or_joined_where_a_large_model_scores(spark, monkeypatch):
    docs = frame(spark, [passage(random.Random(k), 6) for k in range(4)] + [None]).withColumn("source", F.lit("s"))
    table = lambda: sorted(map(str, features.feature_table(docs, corpus(spark), keep=("source", "text")).collect()))
    small = table()
    kept = []
    real = features.stored
    monkeypatch.setattr(features, "stored", lambda rows, label: kept.append(set(rows.columns)) or real(rows, label))
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    assert table() == small
    kept.clear()
    for found in (features.feature_table(docs, corpus(spark), keep=("source",)), features.document_perplexity(docs, corpus(spark)), features.sentence_perplexity(docs, corpus(spark), texts=False)):
        assert found.count() > 0
    assert len(kept) == 6 and not any({"text", "__w", "__s"} & columns for columns in kept)


def test_analysis_without_texts_differs_in_them_alone(spark, monkeypatch):
    docs = frame(spark, [passage(random.Random(k), 6) for k in range(4)] + [None, "", "  ", "Word."])
    parameters = model.parameters(spark)
    found = lambda texts: {r.doc_id: r.asDict(True) for r in model.analyze(docs, corpus(spark), parameters, texts=texts).collect()}
    whole = found(True)
    assert whole[0]["sentence_evidence"][0]["text"] and whole[4]["sentence_evidence"] == []
    kept = []
    real = features.stored
    monkeypatch.setattr(features, "stored", lambda rows, label: kept.append(set(rows.columns)) or real(rows, label))
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    assert found(True) == whole
    kept.clear()
    bare = found(False)
    for row in whole.values():
        for e in row["sentence_evidence"]:
            e["text"] = None
    assert bare == whole and kept and not any({"text", "__w"} & columns for columns in kept)


def test_refits_measure_their_rows_once(spark):
    from scrivener.operators import refits

    seen = spark.sparkContext.accumulator(0)

    def measured(x):
        seen.add(1)
        return float(x)

    # not deterministic, so that no plan evaluates it twice for one reading
    once = F.udf(measured, "double").asNondeterministic()
    rows = spark.range(40).select(F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("g"), once("id").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert refits.group_refits(rows, "g", ("x",)).count() == 4
    assert seen.value == 40


def test_extractor_takes_the_place_of_measuring(spark):
    seen = spark.sparkContext.accumulator(0)

    def extract(rows):
        @F.udf("string")
        def must_not_be_blank(text):
            assert text.strip()
            seen.add(1)
            return text

        cells = "array<struct<sentence:string,n_tokens:int,perplexity:double,status:string,reason:string,warning:string>>"
        given = rows.select("id", must_not_be_blank("text").alias("text"))
        values = {"perplexity": 900.0, "sentence_length_cv": 0.6, "mattr": 0.85, "pos_3gram_entropy": 4.5}
        for name in features.FEATURES:
            given = given.withColumn(name, F.lit(values[name])).withColumn(features.REASONS[name], F.lit(None).cast("string"))
        return given.withColumn("sentences", F.array().cast(cells))

    docs = frame(spark, ["Enough text.", "", " \n ", None, "  "])
    with model.Detector(None, model.parameters(spark), extractor=extract) as detector:
        got = {r.doc_id: r for r in detector(docs).collect()}
    assert got[0].state == "classified" and got[0].ai_probability == pytest.approx(1 / (1 + math.exp(-model.INTERCEPT)))
    assert [f.name for f in got[0].features] == list(features.FEATURES)
    for i, reason in ((1, "empty_input"), (2, "whitespace_only_input"), (3, "empty_input"), (4, "whitespace_only_input")):
        assert got[i].state == "insufficient_evidence" and {f.reason for f in got[i].features} == {reason}
    assert seen.value == 1
    with pytest.raises(ValueError, match="needed"):
        model.Detector(None, model.parameters(spark))


# attribution by removal


def spliced(spark, texts):
    cut = [[s.strip() for s in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", t) if s.strip()] for t in texts]
    return spark.createDataFrame([(f"d{n}", [(i, "human", s) for i, s in enumerate(c)]) for n, c in enumerate(cut)], "pair_id string, s array<struct<hybrid_index:int,origin:string,text:string>>")


def test_removal_equals_measuring_each_variant(spark):
    rng = random.Random(8)
    texts = [passage(rng, n) for n in (1, 2, 3, 5, 9, 14)] + [passage(rng, 12, 0, 3), "One. ... Two three four. ?! Five six.", passage(rng, 6) + " and an open end"]
    documents = spliced(spark, texts)
    got = {(r.pair_id, r.left_out): r for r in attribution.without_each(documents, corpus(spark)).select("pair_id", F.inline("variants")).collect()}
    variants = []
    for r in documents.collect():
        parts = [x.text for x in r.s]
        variants += [(f"{r.pair_id}#{k}", " ".join(p for i, p in enumerate(parts) if i != k)) for k in range(-1, len(parts))]
    want = {r.id: r for r in features.feature_table(spark.createDataFrame(variants, "id string, text string"), corpus(spark), "id").collect()}
    assert {f"{p}#{k}" for p, k in got} == set(want)
    for (p, k), r in got.items():
        for name in features.FEATURES:
            assert (r[name] is None) == (want[f"{p}#{k}"][name] is None), (p, k, name)
            assert r[name] is None or r[name] == pytest.approx(want[f"{p}#{k}"][name], abs=1e-9), (p, k, name)


def test_removal_work_grows_with_tokens():
    def steps(n):
        rng = random.Random(n)
        cut = [[rng.choice(WORDS) for _ in range(10)] for _ in range(n)]
        counted = []
        original = attribution._distinct
        attribution._distinct = lambda tokens, window: counted.append(len(tokens)) or original(tokens, window)
        try:
            document = attribution.Document(cut, cut, [float(i) for i in range(n)], [False] * n)
            for i in range(n):
                document.without(i)
        finally:
            attribution._distinct = original
        return sum(counted)

    assert 3.5 < steps(400) / steps(100) < 4.5


def test_attribution_reasons(spark):
    rows = attribution.without_each(spliced(spark, [passage(random.Random(3), 8), "Short one. Two."]), corpus(spark))
    got = hybrid.attribution(rows, model.probability(list(model.PARAMETERS), model.INTERCEPT)).collect()
    assert {r.reason for r in got if r.pair_id == "d1"} == {"full_document_not_classified"}
    assert all(r.contribution is not None for r in got if r.pair_id == "d0" and r.reason is None) and len(got) == 10


# one training run


def training_rows(spark, n=60):
    rng = random.Random(11)
    rows = [(f"p{i}", y, 900 + 100 * rng.gauss(0, 1) - 300 * y, 0.6 + 0.1 * rng.gauss(0, 1), 0.85 + 0.02 * rng.gauss(0, 1) * (1 + y), 4.5 + rng.gauss(0, 1) - y) for i in range(n) for y in (0, 1)]
    rows += [("p0x", 1, None, 0.5, 0.8, 4.0)]
    return spark.createDataFrame(rows, "pair_id string, label int, perplexity double, sentence_length_cv double, mattr double, pos_3gram_entropy double")


def test_training_run_verifies_and_writes(spark, tmp_path):
    rows = training_rows(spark)
    (row,) = model.train(rows, "pair_id", str(tmp_path / "run"), 7).collect()
    assert row.artifact_available and row.verified_rows == 5 and row.rows_before_feature_filter == 121 and row.rows_dropped == 1
    assert row.training_groups + row.validation_groups == 60 and list(row.feature_order) == list(features.FEATURES)
    again = model.load_parameters(spark.read.parquet(str(tmp_path / "run" / "parameters")))
    assert [r[0] for r in again[0]] == list(features.FEATURES)
    with pytest.raises(Exception, match="(?i)exist"):
        model.train(rows, "pair_id", str(tmp_path / "run"), 7)
    with pytest.raises(ValueError, match="split"):
        model.train(rows.filter("label = 0"), "pair_id", str(tmp_path / "one"), 7)


def test_training_run_fails_where_the_written_model_differs(spark, tmp_path, monkeypatch):
    original = model.read_parameters
    monkeypatch.setattr(model, "read_parameters", lambda s, path: original(s, path).withColumn("intercept", F.col("intercept") + 1e-6))
    with pytest.raises(ValueError, match="not scored as before"):
        model.train(training_rows(spark), "pair_id", str(tmp_path / "run"), 7)


# white space of Unicode


def test_unicode_white_space(spark):
    from scrivener.functions import text as T

    cases = ["a b", " a　", " ", " a\x1cb ", "", None]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(T.word_count(F.col("v")), T.strip(F.col("v")), T.normalise_spaces(F.col("v")), T.regex_word_count(F.col("v"))).collect()
    assert [r[0] for r in rows] == [None if c is None else len(c.split()) for c in cases]
    assert [r[1] for r in rows] == [None if c is None else c.strip() for c in cases]
    assert [r[2] for r in rows] == [None if c is None else " ".join(c.split()) for c in cases]
    assert [r[3] for r in rows] == [None if c is None else len(re.findall(r"\b[\w'-]+\b", c)) for c in cases]
    (row,) = model.analyze(frame(spark, ["  "]), corpus(spark), model.parameters(spark)).collect()
    assert {f.reason for f in row.features} == {"whitespace_only_input"}


# many fits at once


def newton(x, y, w, penalty=1.0):
    """One fit by itself: coefficients and intercept for unscaled features."""
    import numpy as np

    n = w.sum()
    mean = (w[:, None] * x).sum(axis=0) / n
    scale = np.sqrt((w[:, None] * (x - mean) ** 2).sum(axis=0) / n)
    z = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), axis=1)
    keep = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + keep, z.T @ (w * (p - y)) + keep @ beta)
    weights = beta[:-1] / scale
    return weights, beta[-1] - weights @ mean


def labelled(n=400, groups=7):
    rng = random.Random(21)
    out = []
    for i in range(n):
        a, b = rng.gauss(50, 9), rng.gauss(0, 0.1)
        y = int(rng.random() < 1 / (1 + math.exp(-(0.1 * (a - 50) + 8 * b + (i % groups) / 5 - 0.5))))
        out.append((i, None if i % groups == 3 else f"g{i % groups}", y, a, b))
    return out


def test_group_refits_equal_separate_fits(spark):
    import numpy as np

    from scrivener.operators import refits

    rows = labelled()
    table = spark.createDataFrame([*rows, (999, "g0", 1, None, 0.0)], "k int, g string, label int, a double, b double").repartition(5)
    got = {r.g: r for r in refits.group_refits(table, "g", ("a", "b")).collect()}
    assert len(got) == 7 and None in got
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows], float)
    for g, r in got.items():
        own = np.array([q[1] == g for q in rows])
        weights, constant = newton(x, y, (~own).astype(float))
        assert np.allclose(r.weights, weights, atol=1e-8) and math.isclose(r.constant, constant, abs_tol=1e-7)
        right = ((x[own] @ weights + constant > 0) == (y[own] == 1)).mean()
        assert r.n_train == (~own).sum() and r.n_test == own.sum() and math.isclose(r.accuracy, right)


def test_refits_without_a_class_or_rows(spark):
    from scrivener.operators import refits

    table = spark.createDataFrame([(g, y, float(i)) for i, (g, y) in enumerate([("a", 1), ("a", 1), ("b", 0), ("b", 0)] * 3)], "g string, label int, v double")
    got = refits.group_refits(table, "g", ("v",)).collect()
    assert [r.accuracy for r in got] == [None, None]
    assert refits.group_refits(table.limit(0), "g", ("v",)).count() == 0


def test_seed_refits_equal_separate_fits(spark):
    import hashlib

    import numpy as np

    from scrivener.operators import refits

    rows = labelled()
    table = spark.createDataFrame(rows, "k int, g string, label int, a double, b double").repartition(3)
    got = {r.seed: r for r in refits.seed_refits(table, "k", (1, 2, 3), ("a", "b")).collect()}
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows], float)
    for seed, r in got.items():
        at = [int(hashlib.md5(f"{seed}|{q[0]}".encode()).hexdigest()[:8], 16) / 2**32 for q in rows]
        times = np.array([sum(u >= e for e in refits.POISSON) for u in at], float)
        weights, constant = newton(x, y, times)
        assert r.n_train == times.sum() and r.n_test == (times == 0).sum()
        assert np.allclose(r.weights, weights, atol=1e-8) and math.isclose(r.constant, constant, abs_tol=1e-7)
    summary = refits.over_seeds(spark.createDataFrame(list(got.values()))).first()
    assert summary.runs == 3 and math.isclose(summary.mean_accuracy, sum(r.accuracy for r in got.values()) / 3)


# near copies, markers and metadata


def near_texts():
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 120))] for _ in range(12)]
    out = []
    for i, words in enumerate(base):
        for k in range(5):
            edited = list(words)
            for _ in range(k):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out.append((len(out), " ".join(edited) + ("." if k % 2 else ""), f"s{(i + k) % 3}"))
    shared = [rng.choice(vocabulary) for _ in range(60)]
    out += [(len(out) + k, " ".join([*shared, *(rng.choice(vocabulary) for _ in range(60))]), "s0") for k in range(20)]
    return out + [(500, "two words", "s0"), (501, "Two  words!", "s1"), (502, "", "s0"), (503, None, "s1"), (504, "...", "s2")]


def test_near_copies_equal_all_pairs(spark):
    from scrivener.operators import leakage

    rows = near_texts()
    table = spark.createDataFrame(rows, "doc_id long, text string, split string").repartition(4)
    sets = {}
    for i, text, _ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        sets[i] = frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    of = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    alike = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    links = {a: {b for b in set(of.values()) if b != a and alike(a, b)} for a in set(of.values())}
    side = {i: s for i, _, s in rows}
    got = {r.doc_id: r for r in leakage.near_copies(table, "split").collect()}
    assert set(got) == set(sets) and any(links.values())
    for i, r in got.items():
        around = {side[j] for j in sets if of[j] == of[i] or of[j] in links[of[i]]}
        assert (r.class_id, r.class_size, r.links, r.crosses) == (of[i], sum(c == of[i] for c in of.values()), len(links[of[i]]), len(around) > 1)
    pairs = {(r.a, r.b): r.similarity for r in leakage.similar_sets(leakage.shingle_sets(table)).collect()}
    assert set(pairs) == {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    assert leakage.near_copies(table.limit(0), "split").count() == 0


def test_markers_and_metadata(spark):
    from scrivener.operators import evaluate, leakage

    rng = random.Random(2)
    rows = [(i, i % 2, f"text {'As an AI' if i % 2 and i % 3 == 0 else ''}", f"maker{i % 2}" if rng.random() < 0.95 else "other", f"topic{rng.randrange(5)}", rng.choice(["a", None])) for i in range(400)]
    table = spark.createDataFrame(rows, "k int, label int, text string, made string, topic string, odd string")
    got = {(r.marker, r.label): (r.n, r.with_marker) for r in leakage.marker_shares(table, ("as an ai", "maker1")).collect()}
    assert got["as an ai", 0] == (200, 0) and got["as an ai", 1] == (200, sum(1 for r in rows if "As an AI" in r[2])) and got["maker1", 1] == (200, 0)
    planted = evaluate.roc_auc(leakage.metadata_scores(table, ("made", "topic", "odd"), "k", 5)).first().roc_auc
    fair = evaluate.roc_auc(leakage.metadata_scores(table, ("topic", "odd"), "k", 5)).first().roc_auc
    assert planted > 0.95 and 0.35 < fair < 0.65
    # values that the taught half never held are one more category
    strange = table.withColumn("made", F.when(F.md5(F.concat(F.lit("5|"), F.col("k").cast("string"))) < "8", F.col("made")).otherwise("never seen"))
    assert leakage.metadata_scores(strange, ("made",), "k", 5).select("p").distinct().count() == 1


# quantiles of large groups


@pytest.mark.parametrize("bins, few", [(4, 1), (16, 3), (1 << 10, 1 << 14)])
def test_quantiles_equal_percentile(spark, bins, few):
    from scrivener.operators import quantiles

    rng = random.Random(13)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [(None, float(rng.randrange(4))) for _ in range(200)] + [("c", x) for x in (1e300, -1e300, 5.0, 1e-300, 0.0)] + [("d", 7.0), ("e", None), ("f", math.nan)]
    rows += [("g", float(10**k)) for k in range(40)] + [("h", 3.0)] * 100
    table = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(r.g, r.prob): r.value for r in quantiles.quantiles(table, "v", probs, "g", bins=bins, few=few).collect()}
    want = table.filter("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
    assert len(got) == len(want) * len(probs)
    for r in want:
        for p, q in zip(probs, r.q, strict=True):
            assert got[r.g, p] == pytest.approx(q, rel=1e-12, abs=1e-12)
    whole = {r.prob: r.value for r in quantiles.quantiles(table.filter("g = 'a'"), "v", (0.5,), bins=bins, few=few).collect()}
    assert whole[0.5] == got["a", 0.5]


# frozen selections


def test_frozen_tree_names_the_set_and_finds_changes(spark, tmp_path):
    from scrivener.operators import frozen

    ids = spark.createDataFrame([(f"id{i}",) for i in range(3000)], "k string")
    tree = frozen.digest_tree(ids, "k", 2)
    root = lambda t: t.filter("level = 0").first().digest
    assert root(tree) == root(frozen.digest_tree(ids.orderBy(F.desc("k")).repartition(7), "k", 2)) and tree.filter("level = 0").first().n == 3000
    other = frozen.digest_tree(ids.withColumn("k", F.when(F.col("k") == "id77", "id77x").otherwise(F.col("k"))), "k", 2)
    import hashlib

    want = {hashlib.sha256(x.encode()).hexdigest()[:2] for x in ("id77", "id77x")}
    found = frozen.changed_chunks(tree, other, 2).collect()
    assert {r.prefix for r in found} == want and found[0].compared <= 1 + 16 + 32
    assert frozen.changed_chunks(tree, tree, 2).count() == 0
    (row,) = frozen.freeze(ids, "k", str(tmp_path / "m"), 5, "abc", 2).collect()
    assert (row.seed, row.n, row.root) == (5, 3000, root(tree)) and spark.read.parquet(str(tmp_path / "m" / "identifiers")).count() == 3000
    (none,) = frozen.freeze(ids.limit(0), "k", str(tmp_path / "e"), 5, "abc").collect()
    assert none.n == 0 and none.root == hashlib.sha256(b"").hexdigest()
    assert [frozen.depth_for(n) for n in (0, 1 << 16, (1 << 16) + 1, 10**9)] == [1, 1, 2, 5]


# overlays, spans, prefixes and word classes


def test_overlay_sweep_equals_painting(spark):
    from scrivener.operators import profile

    rng = random.Random(17)
    rows, want = [], {}
    for key in range(30):
        spans = []
        for i in range(rng.randrange(1, 25)):
            start = rng.randrange(60)
            size = rng.randrange(1, 20)
            text = "".join(rng.choice("abcdéf") for _ in range(size if rng.random() < 0.8 else rng.randrange(1, 25)))
            spans.append((start, start + size - 1, str(i), text))
        line = [" "] * max(e + 1 for _, e, _, _ in spans)
        for s, e, _, t in sorted(spans):
            for k in range(s, e + 1):
                line[k] = t[k - s] if k - s < len(t) else " "
        want[key] = ("".join(line), sum(len(t) == e - s + 1 for s, e, _, t in spans), len(spans))
        rows += [(key, *s) for s in spans]
    table = spark.createDataFrame(rows, "k int, s long, e long, i string, t string").repartition(4)
    got = {r.k: (r.text, r.matched, r.total) for r in profile.reconstruct_overlay(table, "k", "s", "e", "i", "t").collect()}
    assert got == want
    open_ = {r.k: (r.text, r.ok) for r in profile.reconstruct_overlay(spark.createDataFrame([("x", 0, 3, "1", "abc"), ("x", 3, 5, "2", "de")], "k string, s long, e long, i string, t string"), "k", "s", "e", "i", "t", False).collect()}
    assert open_ == {"x": ("abcde", True)}


def test_span_merge_equals_comparing_all(spark):
    from scrivener.operators import profile

    rng = random.Random(19)
    spans, targets = [], []
    for key in ("a", "b", "c"):
        for i in range(60):
            s = rng.randrange(300)
            spans.append((key, i, s, s + rng.randrange(0, 40)))
        for i in range(80):
            s = rng.randrange(300)
            targets.append((key, i, s, s + rng.randrange(0, 60 if key == "b" else 9)))
    spans.append(("only spans", 0, 0, 9))
    got = profile.map_spans(spark.createDataFrame(spans, "k string, span_id long, start long, end long"), spark.createDataFrame(targets, "k string, target_id long, start long, end long"), "k").collect()
    # an empty span meets a target that it lies inside
    want = sorted((k, i, j) for k, i, s, e in spans for l, j, a, b in targets if k == l and s < b and e > a)  # noqa: E741
    assert sorted(map(tuple, got)) == want


def test_spans_of_a_long_document(spark):
    from scrivener.operators import profile

    n = 100_000
    targets = spark.range(n).select(F.lit("d").alias("k"), F.col("id").alias("target_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    spans = spark.range(n // 10).select(F.lit("d").alias("k"), F.col("id").alias("span_id"), (F.col("id") * 100 + 5).alias("start"), (F.col("id") * 100 + 105).alias("end"))
    met = profile.map_spans(spans, targets, "k").groupBy("span_id").agg(F.count("*").alias("n"), F.min("target_id").alias("first"))
    assert met.filter((F.col("n") != F.when(F.col("span_id") == n // 10 - 1, 10).otherwise(11)) | (F.col("first") != F.col("span_id") * 10)).count() == 0 and met.count() == n // 10


def test_prefixes_are_scored_once(spark, monkeypatch):
    from scrivener.operators import profile

    docs = frame(spark, [passage(random.Random(k), 9).replace(".", "") for k in range(5)] + ["one", "", None])
    targets = (2, 10, 25, 500)
    found = lambda: {(r.id, r.target): r for r in features.prefix_scores(docs, corpus(spark), targets).collect()}
    got = found()
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", r.text or "")
        for t in targets:
            (alone,) = features.sentence_perplexity(spark.createDataFrame([(0, " ".join(words[:t]))], "doc_id long, text string"), corpus(spark)).collect() or [None]
            row = got[r.doc_id, t]
            assert row.n_tokens == min(t, len(words)) and (row.perplexity is None) == (alone is None or alone.perplexity is None)
            assert row.perplexity is None or row.perplexity == pytest.approx(alone.perplexity, rel=1e-9)
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    for key, row in found().items():
        assert row.nll is None and got[key].nll is None or row.nll == pytest.approx(got[key].nll, rel=1e-12)
    ends = {r.id: r for r in profile.first_to_final(spark.createDataFrame(list(got.values())), "perplexity").collect()}
    assert ends[0].first == got[0, 2].perplexity and ends[0].final == got[0, 500].perplexity and ends[0].points == 4 and 5 not in ends


def test_planted_word_classes_come_back(spark):
    from scrivener.operators import wordclass

    rng = random.Random(23)
    kinds = {"det": ["the", "ein", "los"], "noun": [f"noun{c}" for c in "abcdefgh"], "verb": [f"verb{c}" for c in "abcdefgh"], "adv": ["soon", "often"]}
    pick = lambda k: rng.choice(kinds[k])
    lines = [" ".join(pick(k) for k in ("det", "noun", "verb", "det", "noun", "adv")) + "." for _ in range(900)]
    corpus_ = spark.createDataFrame([(x,) for x in lines], "text string")
    classes = {r["word"]: r["class"] for r in wordclass.induce(corpus_, classes=4, contexts=16).collect()}
    found = [{classes[w] for w in words} for words in kinds.values()]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == 4
    again = {r["word"]: r["class"] for r in wordclass.induce(corpus_.repartition(7), classes=4, contexts=16).collect()}
    assert again == classes
    tags = wordclass.tagger(wordclass.induce(corpus_, classes=4, contexts=16))
    docs = frame(spark, ["The nouna verbb 12 zebra.", None])
    (row, none) = docs.select(tags(F.split(F.lower("text"), r"[ .]"))).orderBy("doc_id").collect()
    assert row[0][:5] == [f"C{classes['the']}", f"C{classes['nouna']}", f"C{classes['verbb']}", "NUM", "RARE"] and none[0] is None
    entropy = {r.id: r for r in wordclass.learned_entropy(frame(spark, ["the nouna verba. " * 5, "the"]), tags).collect()}
    assert entropy[0].pos_3gram_entropy == pytest.approx(math.log2(13) - (5 * math.log2(5) + 2 * 4 * math.log2(4)) / 13)
    assert entropy[1].pos_reason.startswith("insufficient")
    assert wordclass.induce(corpus_.limit(0)).count() == 0


def test_local_features_by_either_size_of_model(spark, monkeypatch):
    documents = spliced(spark, [passage(random.Random(k), 5) for k in range(4)])
    columns = ["pair_id", "hybrid_index", "width", "perplexity", "mattr", "length"]
    found = lambda: sorted(map(tuple, hybrid.local_features(documents, (1, None), corpus(spark)).select(*columns).collect()), key=str)
    removed = lambda: sorted(map(str, attribution.without_each(documents, corpus(spark)).select("pair_id", F.size("variants")).collect()))
    small = found(), removed()
    monkeypatch.setattr(features, "BROADCAST_BIGRAMS", 0)
    assert (found(), removed()) == small and small[0][0][3] is not None
