"""Core operators against plain Python, and the cases that the given tables never hold."""

import hashlib
import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.functions import stats as St
from scrivener.functions import text as T
from scrivener.operators import calibrate, checks, evaluate, features, hybrid, model, profile, sampling
from scrivener.sources import readers, sinks
from scrivener.streaming import scoring

CORPUS = [("The cat sat on the mat. The dog sat.",), ("A cat and a dog.",)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def one(spark, expression, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expression).collect()]


def test_mattr_and_entropy_by_brute_force(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("ab cd ef gh the of 12 running wordly".split()) for _ in range(n)) for n in (0, 1, 2, 3, 24, 25, 26, 90)]
    docs = frame(spark, texts)
    mattr = {r.id: r for r in features.mattr(docs).collect()}
    pos = {r.id: r for r in features.pos_trigram_entropy(docs).collect()}
    tags = dict(zip(sorted({w for t in texts for w in t.split()}), one(spark, T.tag(F.col("v")), *sorted({w for t in texts for w in t.split()})), strict=True))
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z]+", t)
        if len(words) < 25:
            assert mattr[i].mattr is None and mattr[i].mattr_reason == f"insufficient_tokens_for_window: have={len(words)} require_at_least=25"
        else:
            assert math.isclose(mattr[i].mattr, statistics.mean(len(set(words[k : k + 25])) / 25 for k in range(len(words) - 24)), abs_tol=1e-12) and mattr[i].mattr_reason is None
        g = [tags[w] for w in t.split()]
        if len(g) < 3:
            assert pos[i].pos_3gram_entropy is None and pos[i].pos_reason == f"insufficient_pos_tags_for_3grams: have={len(g)} require_at_least=3"
        else:
            c = Counter(zip(g, g[1:], g[2:], strict=False)).values()
            assert math.isclose(pos[i].pos_3gram_entropy, -sum(x / sum(c) * math.log2(x / sum(c)) for x in c), abs_tol=1e-9)


def test_length_variation_reasons(spark):
    got = {r.id: r for r in features.sentence_length_cv(frame(spark, ["One two. Three four five six!", "Hi.", "... !!! ?", None, "", "Same one. Same two."])).collect()}
    assert math.isclose(got[0].sentence_length_cv, statistics.stdev([2, 4]) / 3)
    assert got[1].cv_reason == got[3].cv_reason == got[4].cv_reason == "insufficient_sentences_for_cv: require_at_least=2"
    assert got[2].cv_reason in ("zero_mean_sentence_length", "insufficient_sentences_for_cv: require_at_least=2") and got[2].sentence_length_cv is None
    assert got[5].sentence_length_cv == 0 and got[5].cv_reason is None


def test_perplexity_statuses(spark):
    long, limit = " ".join(["cat"] * 1025), " ".join(["cat"] * 1024)
    docs = frame(spark, [f"{long}. The cat sat.", "Hi.", "Hello world.", f"{limit}.", None])
    got = {(r.id, r.sentence_id): r for r in features.sentence_perplexity(docs, spark.createDataFrame(CORPUS, "text string")).collect()}
    assert got[0, 1].status == "exceeds_context" and got[0, 1].reason == "sentence_exceeds_language_model_context" and got[0, 1].perplexity is None
    assert got[0, 2].status == "ok" and got[3, 1].status == "ok" and got[3, 1].perplexity > 0
    assert got[1, 1].status == "insufficient_input" and got[2, 1].warning == "one_usable_prediction"
    words = [re.findall(r"[a-z]+", s.lower()) for t in CORPUS for s in t[0].split(".")]
    pairs, v = Counter(p for w in words for p in zip(w, w[1:], strict=False)), len({x for w in words for x in w})
    heads = Counter()
    for (a, _), n in pairs.items():
        heads[a] += n
    nll = [-math.log((pairs[a, b] + 0.5) / (heads[a] + 0.5 * v)) for a, b in (("the", "cat"), ("cat", "sat"))]
    assert math.isclose(got[0, 2].perplexity, math.exp(sum(nll) / 2))
    docp = {r.id: r for r in features.document_perplexity(docs, spark.createDataFrame(CORPUS, "text string")).collect()}
    assert math.isclose(docp[0].perplexity, got[0, 2].perplexity) and docp[1].perplexity_reason == docp[4].perplexity_reason == "no_valid_sentence_perplexity_values"


def test_analyze_states(spark):
    rng = random.Random(3)
    text = " ".join(" ".join(rng.choice("cat dog mat sat the a on and ran".split()) for _ in range(rng.randint(4, 12))) + "." for _ in range(8))
    docs = frame(spark, [text, "", "  \n\t ", None, "Hi."])
    got = {r.doc_id: r for r in model.analyze(docs, spark.createDataFrame(CORPUS, "text string"), model.parameters(spark)).collect()}
    assert got[0].state == "classified" and got[0].label in ("ai_associated", "human_associated") and [f.name for f in got[0].features] == list(features.FEATURES)
    z = model.INTERCEPT + sum((f.value - m) / s * c for f, (_, m, s, c) in zip(got[0].features, model.PARAMETERS, strict=True))
    assert math.isclose(got[0].ai_probability, 1 / (1 + math.exp(-z)), abs_tol=1e-12)
    assert [e.sentence_id for e in got[0].sentence_evidence] == list(range(1, 9))
    for i, reason in ((1, "empty_input"), (2, "whitespace_only_input"), (3, "empty_input")):
        assert got[i].state == "insufficient_evidence" and {f.reason for f in got[i].features} == {reason} and not got[i].sentence_evidence and got[i].ai_probability is None
    assert got[4].state == "insufficient_evidence" and sum(f.available for f in got[4].features) < 4
    again = model.analyze(docs, spark.createDataFrame(CORPUS, "text string"), model.parameters(spark)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_robust_z_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 1.0, 2.0, 2.0, 3.5, 9.0, float("nan")]) if g % 2 else float(i % 3)) for g in range(30) for i in range(rng.randint(1, 9))] + [(99, 0, 5.0), (98, 0, 2.0), (98, 1, 2.0), (98, 2, 2.0)]
    got = {(r.g, r.i): (r.z, r.z_reason) for r in hybrid.robust_z(spark.createDataFrame(rows, "g int, i int, x double"), "g", "i", "x").collect()}
    assert len(got) == len(rows)
    for g, i, x in rows:
        others = [y for h, j, y in rows if h == g and j != i and y is not None and not math.isnan(y)]
        if x is None or math.isnan(x):
            assert got[g, i] == (None, "current_value_unavailable")
        elif not others:
            assert got[g, i] == (None, "no_reference_values")
        else:
            m = statistics.median(others)
            mad = statistics.median(abs(y - m) for y in others)
            assert got[g, i] == (None, "mad_zero") if mad == 0 else math.isclose(got[g, i][0], 0.6745 * (x - m) / mad, abs_tol=1e-12)


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)] + [("b", 1, 0.5)] * 3 + [("a", 1, None)]
    got = {r.k: r.roc_auc for r in evaluate.roc_auc(spark.createDataFrame(rows, "k string, label int, p double"), "k").collect()}
    ones, zeros = ([p for k, y, p in rows if k == "a" and y == c and p is not None] for c in (1, 0))
    assert math.isclose(got["a"], sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)) and got["b"] is None


def test_metrics_without_predictions(spark):
    r = evaluate.metrics(spark.createDataFrame([(1, None), (0, None)], "label int, predicted int")).first()
    assert (r.coverage, r.accuracy, r.precision, r.fpr, r.fnr) == (0, 0, 0, None, None)


def test_bins():
    assert [b for _, b in T.WORD_BINS][:2] == ["0-20", "21-40"]


def test_bin_edges(spark):
    assert one(spark, T.word_bin(F.col("v")), 0, 20, 21, 200, 201, schema="v int") == ["0-20", "0-20", "21-40", "151-200", "201+"]
    assert one(spark, T.margin_bin(F.col("v")), 0.0, 0.05, 0.5, 0.4999, 0.51, -0.1, schema="v double") == ["0.00-0.05", "0.05-0.10", "0.45-0.50", "0.45-0.50", None, None]


def test_scalars(spark):
    assert one(spark, T.lenient_int(F.col("v")), "12.0", "x", None, "7") == [12, 0, 0, 7]
    assert one(spark, T.strict_int(F.col("v")), "12.0", "12", "x", None) == [10**12, 12, 10**12, 10**12]
    assert one(spark, T.feature_text(F.col("v")), 123.456, 42.93217, 0.5, 3.0, None, schema="v double") == ["123.46", "42.932", "0.5", "3", "Unavailable"]
    assert one(spark, T.signal_text(F.col("v")), 0.5, None, schema="v double") == ["0.500", "Not reported"]
    values = [0.0045, 0.82875, 0.89525, 12.0005, 100.005, 1234.565, -3.14155, 1.00005, 99.9999, 0.1, 2.675, 1e-7]
    assert [float(x) for x in one(spark, T.fixed(F.col("v"), 4), *values, schema="v double")] == [float(f"{x:.4f}") for x in values]
    assert one(spark, T.fixed(F.col("v"), 3), *values, schema="v double") == [f"{x:.3f}" for x in values]
    assert one(spark, T.number_text(F.col("v")), 1234.5, None, schema="v double") == ["1,234.50", "n/a"]
    assert one(spark, T.preview(F.col("v"), 3), "abc", " ab\ncd") == ["abc", "ab ..."]
    assert one(spark, T.word_count(F.col("v")), "  one two\nthree ", "") == [3, 0]
    assert one(spark, F.size(T.sentences(F.col("v"))), "One. Two? Three", "") == [3, 0]
    assert one(spark, St.safe_log(F.col("v")), 0.0, -1.0, 1.0, float("inf"), schema="v double") == [None, None, 0.0, None]


def test_ties_are_shown_as_printf_shows_them(spark):
    ties = [0.90625, 0.96875, 0.03125, 0.09375, -0.90625, 0.5, 12.40625]
    assert one(spark, T.fixed(F.col("v"), 4), *ties, schema="v double") == [f"{x:.4f}" for x in ties]
    assert one(spark, T.feature_text(F.col("v")), 0.90625, 100.125, 100.375, 10.0625, schema="v double") == ["0.9062", "100.12", "100.38", "10.062"]
    # rounded to nine decimals these are 10 and 100, but their sizes lie below
    assert one(spark, T.feature_text(St.rounded(F.col("v"), 9), F.col("v")), 9.9999999999, 99.9999999999, schema="v double") == ["10", "100.000"]


def test_splice(spark):
    pairs = spark.createDataFrame([("p", "H1. H2. H3.", "A1. A2. A3. A4."), ("q", "H1.", "A1. A2. A3."), ("r", "H1. H2.", "A1. A2.")], "pair_id string, human_text string, ai_text string")
    kept, rejected = hybrid.splice(pairs)
    assert [r.text for r in kept.orderBy("hybrid_index").collect()] == ["H1.", "A2.", "A3.", "H2.", "H3."]
    assert {r.pair_id: r.reason for r in rejected.collect()} == {"q": "insufficient_human_sentences_for_middle_insertion", "r": "insufficient_ai_sentences_for_two_sentence_block"}
    assert all(r.passed for r in checks.hybrid_checks(kept).collect())


def test_windows(spark):
    rows = spark.createDataFrame([(f"d{n}", i, "human", f"s{i}") for n in (1, 2, 3, 6, 9) for i in range(n)], "pair_id string, hybrid_index int, origin string, text string")
    both = hybrid.windows(hybrid.documents_of(rows), (7, None)).collect()
    got = {(r.pair_id, r.hybrid_index): (r.windows[0].window_first, r.windows[0].window_last, r.windows[0].window_text) for r in both}
    assert got["d1", 0] == (0, 0, "s0") and got["d2", 0][0] is None and got["d6", 3][0] is None
    assert got["d9", 0][:2] == (0, 6) and got["d9", 4][:2] == (1, 7) and got["d9", 8][:2] == (2, 8)
    clipped = {(r.pair_id, r.hybrid_index): r.windows[1].window_text for r in both}
    assert clipped["d9", 0] == "s0 s1" and clipped["d9", 8] == "s7 s8" and clipped["d9", 4] == "s3 s4 s5" and clipped["d1", 0] == "s0"


def test_ranks_and_bands(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate([1.0, 3.0, None, 3.0, 0.5])], "g string, i int, score double")
    got = {r.i: r for r in hybrid.ranked(rows, "g", "i").collect()}
    assert [got[i]["rank"] for i in range(5)] == [3, 1, None, 2, 4] and got[1].top_25 and not got[3].top_25 and not got[2].top_50 and got[3].top_50


def test_overlay(spark):
    rows = [("a", 0, 2, "1", "abc"), ("a", 5, 6, "2", "fg"), ("b", 0, 3, "1", "wxyz"), ("b", 2, 3, "2", "QQ"), ("c", 0, 4, "1", "ab")]
    frame_ = spark.createDataFrame(rows, "k string, s long, e long, i string, t string")
    got = {r.k: (r.text, r.ok) for r in profile.reconstruct_overlay(frame_, "k", "s", "e", "i", "t").collect()}
    assert got == {"a": ("abc  fg", True), "b": ("wxQQ", True), "c": ("ab   ", False)}
    exclusive = {r.k: r.ok for r in profile.reconstruct_overlay(frame_, "k", "s", "e", "i", "t", inclusive_end=False).collect()}
    assert not any(exclusive.values())


def test_types_and_repeats(spark):
    rows = spark.createDataFrame([("1", "1.5", "x", ""), ("2", "2", "3", None)], "a string, b string, c string, d string")
    assert {r.column_name: r.dtype for r in profile.infer_types(rows).collect()} == {"a": "int", "b": "float", "c": "string", "d": "empty"}
    got = {r.id: r.repeated_ngram_ratio for r in profile.repeated_ngram_ratio(frame(spark, ["a b c d a b c d", "a b c", None])).collect()}
    assert got == {0: 1 / 5, 1: None, 2: None}


def test_sampling(spark):
    rows = spark.createDataFrame([(f"p{k // 2}", k % 2, "x" if k < 30 else "y") for k in range(100)], "pair_id string, label int, g string")
    split = sampling.group_split(rows, "pair_id", 0.2, 7)
    assert all(r.passed for r in checks.split_checks(split, "pair_id", "label").collect()) and split.filter("split = 'validation'").select("pair_id").distinct().count() == 10
    assert {r.g: r["count"] for r in sampling.balanced(rows.withColumn("k", F.concat("pair_id", "label")), "k", "g", 1).groupBy("g").count().collect()} == {"x": 30, "y": 30}
    one_ = sampling.sample(rows.distinct(), "pair_id", 5, 3).collect()
    assert one_ == sampling.sample(rows.distinct().repartition(9), "pair_id", 5, 3).collect() or len(one_) == 5
    assert sampling.shortfall(rows, 120).first().missing == 20
    assert sampling.untouched(rows, rows.filter("g = 'x'"), "pair_id").count() == 70


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2)) * [3, 0.5] + [10, -1]
    y = (x[:, 0] / 3 - x[:, 1] * 2 + rng.normal(size=120) > 5).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1)], "perplexity double, mattr double, label int")
    params, intercept = model.load_parameters(model.fit(rows, "label", ("perplexity", "mattr")))
    s = np.column_stack([np.ones(120), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-s @ w))
        h = s.T @ (s * (p * (1 - p))[:, None]) + np.diag([0, 1, 1])
        w -= np.linalg.solve(h, s.T @ (p - y) + np.array([0, 1, 1]) * w)
    assert np.allclose([intercept, *[c for *_, c in params]], w, atol=1e-5)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text('id,text,source_text,instructions\n,"a ""q""\nline",b,\nx,,c,\ny,, ,\n', encoding="utf-8")
    pairs = readers.read_pairs(spark, str(tmp_path / "pairs.csv"))
    assert [(r.row_index, r.pair_id) for r in pairs.orderBy("row_index").collect()] == [(0, "row-0"), (1, "x"), (2, "y")]
    assert [r.reason for r in hybrid.usable(pairs).orderBy("row_index").collect()] == [None, "missing_human_text", "missing_human_text"]
    with pytest.raises(ValueError):
        readers.require_unique(pairs.union(pairs), "pair_id")
    with pytest.raises(ValueError):
        readers.require_matches(pairs, spark.createDataFrame([("zz",)], "pair_id string"), "pair_id")
    wanted = spark.createDataFrame([(0, "row-0"), (1, "no"), (9, "x")], "row_index bigint, id string")
    assert [r.reason for r in readers.rows_at(pairs.withColumnRenamed("pair_id", "id"), wanted).orderBy("row_index").collect()] == [None, "raw_id_mismatch", "raw_row_not_found"]
    model.parameters(spark).write.parquet(f"{tmp_path}/params")
    assert readers.read_parameters(spark, f"{tmp_path}/params").count() == 4
    sinks.write_predictions(pairs, f"{tmp_path}/out", ["pair_id", "ai_text"])
    sinks.write_documents(pairs, f"{tmp_path}/json")
    sinks.write_texts(pairs, f"{tmp_path}/texts", "pair_id", "ai_text")
    assert spark.read.text(f"{tmp_path}/json").count() == 3
    assert sinks.manifest(pairs, "pair_id", 1, "d").first().selected_ids == ["row-0", "x", "y"]
    assert "(none)" in sinks.markdown(profile.value_counts(pairs.limit(0), "pair_id"), "t") and readers.file_digest(spark, f"{tmp_path}/pairs.csv").count() == 1


def test_segments(spark):
    rows = [("e", "2", "5", "6", "C", "fg"), ("e", "1", "0.0", "2", "C", "abc"), ("", "9", "0", "1", "C", "zz")]
    wide = readers.with_row_index(spark.createDataFrame([(*r, "p", "9", "No", "t") for r in rows], "essay_id_comp string, discourse_id string, discourse_start string, discourse_end string, discourse_type string, discourse_text string, prompt_name string, grade_level string, ell_status string, task string"))
    got = readers.nest_segments(wide).collect()
    assert len(got) == 1 and [s.text for s in got[0].segments] == ["abc", "fg"] and got[0].n_segments == 2
    assert readers.first_rows(wide, "essay_id_comp").filter("essay_id_comp = 'e'").first().discourse_id == "2"


def test_stream_scores_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "text": "The cat sat. The dog ran."}\n{"doc_id": 2}\n')
    detector = model.Detector(spark.createDataFrame(CORPUS, "text string"), model.parameters(spark))
    query = scoring.score_stream(scoring.requests(spark, f"{tmp_path}/in"), detector, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(120)
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1] and [r.doc_id for r in spark.read.parquet(f"{tmp_path}/out_rejected").collect()] == [2]


def test_thresholds_and_areas_beyond_all_slices(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), float(rng.choice([-9000, -8999, -1, 0, 1, 2, 7, 4096, 4097, 9000, 9001]))) for _ in range(300)] + [(1, None)]
    frame_ = spark.createDataFrame(rows, "label int, p double")
    known = [(y, p) for y, p in rows if p is not None]
    ones, zeros = ([p for y, p in known if y == c] for c in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    assert math.isclose(evaluate.roc_auc(frame_).first().roc_auc, area) and math.isclose(evaluate.roc_auc(frame_, width=1.0).first().roc_auc, area)
    f1 = {t: 2 * sum(y for y, p in known if p <= t) / (sum(p <= t for _, p in known) + len(ones)) for _, t in known}
    best = min(f1, key=lambda t: (-f1[t], t))
    got = evaluate.best_threshold(frame_, "p").first()
    assert (got.threshold, got.tp, got.positives) == (best, sum(y for y, p in known if p <= best), len(ones)) and math.isclose(got.f1, f1[best])
    assert evaluate.best_threshold(frame_.limit(0), "p").count() == 0


def test_places_by_hash(spark):
    rows = spark.createDataFrame([(f"p{k}", "x" if k < 700 else None if k < 1000 else "y") for k in range(3000)], "k string, g string")
    by_hash = lambda keys, seed: sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))
    split = {r.k for r in sampling.group_split(rows, "k", 0.2, 7).filter("split = 'validation'").collect()}
    assert split == set(by_hash([f"p{k}" for k in range(3000)], 7)[:600])
    two = {r.k for r in sampling.balanced(rows.filter("g is null or g = 'y'"), "k", "g", 3).collect()}
    assert two == {f"p{k}" for k in range(700, 1000)} | set(by_hash([f"p{k}" for k in range(1000, 3000)], 3)[:300])


def test_holdouts_and_leakage(spark):
    rows = [(i, "a" if i < 40 else "b" if i < 70 else None, i % 7, int(i % 3 == 0)) for i in range(100)]
    frame_ = spark.createDataFrame(rows, "id int, g string, x int, label int")
    got = {r.g: r for r in evaluate.group_out(frame_, "g", "x").collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        mean = [statistics.mean(x for _, h, x, y in rows if h != g and y == c) for c in (0, 1)]
        t, up = sum(mean) / 2, mean[1] >= mean[0]
        own = [(x, y) for _, h, x, y in rows if h == g]
        assert math.isclose(r.threshold, t) and math.isclose(r.accuracy, sum(((x > t) if up else (x < t)) == (y == 1) for x, y in own) / len(own)) and r.n_train == 100 - len(own)
    alone = evaluate.group_out(frame_.filter("g = 'a'"), "g", "x").first()
    assert alone.threshold is None and alone.accuracy is None and alone.n_test == 40
    moved = {r.id: r.label for r in evaluate.permuted_labels(frame_, "id", 4).collect()}
    assert sum(moved.values()) == sum(y for *_, y in rows) and any(moved[i] != y for i, _, _, y in rows)
    taught = {i: hashlib.md5(f"4|{i}".encode()).hexdigest()[0] < "8" for i in range(100)}
    for r in evaluate.learned_share(frame_, ("g",), "id", 4).select("g", "p").distinct().collect():
        cell = [y for i, g, _, y in rows if g == r.g and taught[i]]
        assert math.isclose(r.p, (sum(cell) + 1) / (len(cell) + 2))


def test_known_rows_and_model_files(spark, tmp_path):
    scored = spark.createDataFrame([(1, 1, 0.75), (2, 0, 0.25), (2, 0, 0.25), (3, 1, 0.9)], "id int, predicted int, p double")
    known = spark.createDataFrame([(1, 1, 0.75), (2, 0, 0.25), (3, 1, 0.9 + 1e-9), (4, 1, 0.6)], "id int, expected_prediction int, expected_p double")
    got = {r.id: (r.matches, r.verified) for r in model.verify_known(scored, known, "id").collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (1, False), 4: (0, False)}
    absent = readers.model_metadata(spark, f"{tmp_path}/model").first()
    assert not absent.artifact_available and absent.feature_order == list(features.FEATURES)
    sinks.write_model(model.parameters(spark), f"{tmp_path}/model", spark.createDataFrame([("run", 3)], "name string, rows int"))
    assert readers.model_metadata(spark, f"{tmp_path}/model").first().name == "run" and readers.read_parameters(spark, f"{tmp_path}/model/parameters").count() == 4


def test_normalised_view(spark):
    got = {r.id: r for r in profile.normalised_view(frame(spark, ["cafe\u0301\r\nx", "caf\u00e9 x", None, ""])).collect()}
    assert got[0].view_sha256 == got[1].view_sha256 == got[1].text_sha256 and got[0].changed and not got[1].changed
    assert got[2].view_sha256 == got[3].view_sha256 and not got[2].changed


def test_checks_fail_on_unsound_runs(spark):
    failed = lambda rows: {r.check_name for r in rows.collect() if not r.passed}
    table = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    digest = readers.table_digest
    assert not failed(checks.unchanged(digest(table), digest(table.repartition(3)))) and failed(checks.unchanged(digest(table), digest(table.distinct())))
    assert failed(checks.unchanged(digest(table), digest(table.fillna("b")))) == {"raw_dataset_unchanged"} and not failed(checks.unchanged(digest(table.limit(0)), digest(table.limit(0))))
    chosen = spark.createDataFrame([("p",), ("q",), ("q",)], "pair_id string")
    long = spark.createDataFrame([("p", 0, "mattr", 1.5, None), ("p", 1, "mattr", float("nan"), None), ("r", 0, "mattr", None, "short")], "pair_id string, label int, feature string, v double, reason string")
    summary = spark.createDataFrame([("mattr", 0, 2)], "feature string, label int, count bigint")
    assert len(failed(checks.distribution_checks(chosen, long, summary, 2))) == 7
    pairs = spark.createDataFrame([("p", "H1. H2. H3.", "A1. A2. A3. A4."), ("q", "H1.", "A1. A2. A3.")], "pair_id string, human_text string, ai_text string")
    kept, rejected = hybrid.splice(pairs)
    scores = spark.createDataFrame([(1.0, None), (None, "none")], "score double, score_reason string")
    assert not failed(checks.source_checks(kept, pairs, scores, rejected))
    other = kept.withColumn("text", F.concat("text", F.lit("x"))).withColumn("hybrid_index", F.col("hybrid_index") + 1)
    bad = spark.createDataFrame([(float("inf"), None), (None, None)], "score double, score_reason string")
    assert len(failed(checks.source_checks(other.filter("hybrid_index > 2"), pairs, bad, rejected.limit(0)))) == 6
    grid = kept.select(F.explode(F.array(F.lit(1), F.lit(3))).alias("window"), F.lit("all").alias("feature_set"), "pair_id", "origin")
    assert not failed(checks.grid_checks(grid, kept, 2)) and len(failed(checks.grid_checks(grid.filter("origin = 'human'"), kept, 3))) == 3
    picked = spark.createDataFrame([(1, "a", " "), (1, "a", " ")], "id int, prompt string, t string")
    rebuilt = spark.createDataFrame([(1, "x", True)], "id int, text string, ok boolean")
    assert len(failed(checks.pilot_checks(picked, rebuilt, "id", "prompt", "t"))) == 4


def test_recalibration_by_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform(0.02, 0.98, 150), 2)
    y = (rng.uniform(size=150) < p**2).astype(int)
    learn = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, label int")
    asked = [0.0, 0.1, 0.5, 0.505, 0.9, 1.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*asked, None])], "i int, p double")
    found = {n: [r.p for r in f(learn, rows).orderBy("i").collect()] for n, f in (("platt", calibrate.platt), ("isotonic", calibrate.isotonic))}
    logit = lambda v: np.log(np.clip(v, 1e-9, 1 - 1e-9) / (1 - np.clip(v, 1e-9, 1 - 1e-9)))
    s, w = np.column_stack([np.ones(150), logit(p)]), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-s @ w))
        w -= np.linalg.solve(s.T @ (s * (q * (1 - q))[:, None]), s.T @ (q - y))
    assert np.allclose(found["platt"][:-1], 1 / (1 + np.exp(-(w[0] + w[1] * logit(np.array(asked))))), atol=1e-4) and found["platt"][-1] is None
    blocks = []  # adjacent violators pooled: mean, weight, values
    for v in sorted(set(p)):
        blocks.append([y[p == v].mean(), (p == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    xs, ys = [v for b in blocks for v in b[2]], [b[0] for b in blocks for _ in b[2]]
    assert np.allclose(found["isotonic"][:-1], np.interp(asked, xs, ys), atol=1e-9) and found["isotonic"][-1] is None
