"""Corpus operators against brute force, with null, empty, tied, repeated and clashing rows."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scrivener.llm import bpe, common, components, ctw, exact_dedup, html_text, language_id, mixing, simhash, url_filter, vptree, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, TARGET string"


def docs(spark, rows):
    """Documents with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "y", "z") for i, t, lang, src in rows], DOCS)


# exact deduplication


def test_exact_dedup_owner_is_largest_id(spark):
    rows = [(1, "a", "en", "s"), (5, "a", "en", "s"), (2, None, "en", "s"), (9, "", "en", "s"), (3, "A", "en", "s"), (4, "a ", "en", "s"), (5, "a", "en", "s"), (7, "x" * 200_000, "en", "s"), (8, "x" * 200_000, "en", "s")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    want = set()
    for i, t, *_ in rows:
        same = [r for r in rows if (r[1] or "") == (t or "")]
        keep = max(r[0] for r in same)
        want.add((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    kept = exact_dedup.kept_documents(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8, 9]


def test_exact_dedup_null_id_and_empty_table(spark):
    rows = docs(spark, [(None, "a", "en", "s"), (1, "a", "en", "s"), (None, "b", "en", "s")])
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {(None, 1, False), (1, 1, True), (None, None, True)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [1, 2_000, 50_000, 1 << 30])
def test_trie_spills_by_subtree_and_keeps_all(budget):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(3000)] + [b"p" * 300 + bytes([k]) for k in range(200)]
    trie = exact_dedup.PatriciaOwners("max", budget)
    want: dict = {}
    for i, t in enumerate(texts):
        trie.add(t, [i, 1])
        want[t] = [i, want.get(t, [0, 0])[1] + 1]
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want


# byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(reference_encoding):
    own = bpe.Tokenizer(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(7)
    letters = "abcdefghijklmnop   \n\t'sé漢字😀 \x1c\x85​٣½²ªǅ  THE123!@"
    texts = ["", " ", "a" * 3000, "theth" * 400, "<|endoftext|>", "it's we'll I'D"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        assert own.encode(t) == reference_encoding.encode_ordinary(t)
        assert own.decode(own.encode(t), part=2) == t


@pytest.mark.parametrize("seed", range(3))
def test_transducer_equals_merging_for_any_merge_table(seed):
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    known = [b"a", b"b", b"c"]
    while len(ranks) < 290:
        token = rng.choice(known) + rng.choice(known)
        if token not in ranks:
            ranks[token] = len(ranks)
            known.append(token)
    plain = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.BytePairTransducer(ranks, max_states=50)
    for _ in range(400):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        assert list(own.encode(t.encode())) == plain.encode_ordinary(t)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("most", [1, 50, 1 << 18])
def test_pieces_together_equal_merging(seed, most):
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    known = [b"a", b"b", "é".encode()]
    while len(ranks) < 290:
        token = rng.choice(known) + rng.choice(known)
        if token not in ranks:
            ranks[token] = len(ranks)
            known.append(token)
    plain = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.BytePairTransducer(ranks, max_states=most)
    texts = ["", "a"] + ["".join(rng.choice("abcé漢") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for _ in range(2):
        assert own.encode_together([t.encode() for t in texts]) == [tuple(plain.encode_ordinary(t)) for t in texts]
        assert list(own.encode(b"abcab" * 9)) == plain.encode_ordinary("abcab" * 9)
    assert own.encode_together([]) == []


def test_texts_together_equal_texts_alone(reference_encoding, monkeypatch):
    rng = random.Random(3)
    words = ["the", " thin", " 漢字", "x" * 200, " é" * 3, "\n", " qzv", "😀"]
    texts = [None, ""] + ["".join(rng.choice(words) + rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = [reference_encoding.encode_ordinary(t or "") for t in texts]
    for chars, pieces, states in ((1, 8, 32), (500, 64, 64), (1 << 20, 1 << 19, 1 << 18)):
        monkeypatch.setattr(bpe, "CHARS_TOGETHER", chars)
        own = bpe.Tokenizer(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, pieces, states)
        assert list(own.encode_all(texts)) == want
        assert list(own.encode_all(iter(texts))) == want and list(own.encode_all([])) == []


def test_new_pieces_step_together():
    """Ten thousand new words take as many array look-ups as the longest has bytes, not one a byte and word."""
    rng = random.Random(1)
    own = bpe.Tokenizer(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [" ".join("".join(rng.choice("etaoins") for _ in range(12)) for _ in range(100)) for _ in range(100)]
    looked_up, alone = [], []
    steps, one = own.transducer._steps_together, own.transducer.encode
    own.transducer._steps_together = lambda keys: looked_up.append(len(keys)) or steps(keys)
    own.transducer.encode = lambda text: alone.append(text) or one(text)
    found = list(own.encode_all(texts))
    assert alone == [] and len(looked_up) <= 64 and sum(looked_up) > 100_000
    assert [own.decode(ids) for ids in found] == texts


@pytest.mark.parametrize("keep", [True, False])
def test_worker_keeps_its_tokenizer_from_task_to_task(spark, keep):
    """Tasks that find nothing compiled are no more than there are Python workers; unasked for, none is kept."""
    rows = spark.range(0, 96, 1, 48).select(F.col("id").cast("string").alias("text"))
    tokenizer = bpe._tokenizer(rows, RANKS, public_tokenizers.PATTERN, keep=keep)

    def run(batches):
        own = tokenizer()
        met = len(own.pieces)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.encode(text)
        yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), "met": met}])

    found = rows.mapInArrow(run, "pid bigint, met bigint").collect()
    workers = {r.pid for r in found}
    assert len(found) == 48 > len(workers)
    cold = sum(r.met == 0 for r in found)
    assert cold <= len(workers) if keep else cold == 48


def test_changed_rank_file_is_compiled_again(spark, tmp_path):
    path = tmp_path / "ranks"
    got = []
    for pair in (b"ab", b"bc"):
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*(bytes([b]) for b in range(256)), pair])))
        rows = docs(spark, [(i, "abc", "en", "s") for i in range(8)]).coalesce(1)
        got.append({r.ids_sha256 for r in bpe.round_trip(rows, str(path), r"\w+").collect()})
    assert got == [{hashlib.sha256(ids).hexdigest()} for ids in (b"256 99", b"97 256")]


def test_encode_hands_its_caps_on(spark, monkeypatch):
    seen = []
    plain = bpe._tokenizer
    monkeypatch.setattr(bpe, "_tokenizer", lambda *a: seen.append(a[3:]) or plain(*a))
    bpe.encode(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_pieces=64, max_states=32)
    assert seen == [(64, 32)]


def test_streaming_decoder_waits_for_whole_characters():
    data = "é漢😀".encode() + b"\xff\xe6\xbc" + "ñ".encode() + b"\xf0\x9f"
    decoder = bpe.StreamingDecoder({i: bytes([b]) for i, b in enumerate(data)})
    assert "".join(decoder.feed([i]) for i in range(len(data))) + decoder.finish() == data.decode("utf-8", "replace")


def test_bpe_round_trip_and_columns(spark, reference_encoding):
    rows = [(1, "the cat\nsat", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (1, "the cat\nsat", "en", "s"), (None, "ñ" * 5000, "es", "s")]
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs(spark, rows), RANKS, public_tokenizers.PATTERN).collect()))
    want = []
    for i, t, *_ in rows:
        ids = reference_encoding.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs(spark, rows), RANKS, public_tokenizers.PATTERN, verify_col="same")
    back = bpe.decode(encoded, RANKS).collect()
    assert all(r.same and r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# nearest neighbours


def brute(vectors, k, every):
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in good:
        if i % every == 0:
            near = sorted((math.sqrt(sum((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, r + 1, j, round(s, 9)) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_nearest_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    vectors += [(i, [1.0] * 6) for i in range(400, 480)] + [(500, [0.0] * 6), (600, None), (700, []), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [float("nan")] * 6), (None, [1.0] * 6), (800, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, rank int, score int")
    for shard_rows, sample in ((8192, 1 << 14), (40, 1 << 14), (30, 60), (30, 0)):
        got = vptree.nearest(rows, query_every=20, shard_rows=shard_rows, sample=sample).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == brute(vectors, 10, 20)
    assert vptree.nearest(rows.limit(0)).count() == 0


def test_nearest_with_ties_at_the_last_place_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(5)]) for i in rng.sample(range(1, 3000), 900)] + [(700, [float(a), 1.0, 0.0, 0.0, 0.5]) for a in range(15)]
    rows += [(100 * k, [float(rng.randint(-2, 2)) for _ in range(5)]) for k in range(40, 60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in vptree.nearest(table, shard_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    distinct = sorted({(i, tuple(v)) for i, v in rows if any(v)})
    for q in {i for i, _ in distinct if i % 100 == 0}:
        want = []
        for _, v in [d for d in distinct if d[0] == q]:
            near = sorted((math.dist(v, w), i) for i, w in distinct if i != q)[:10]
            want += [(n + 1, s, i) for n, (s, i) in enumerate(near)]
        assert sorted((n, round(s, 9), i) for n, s, i in got[q]) == sorted((n, round(s, 9), i) for n, s, i in want)


def test_shards_are_skipped_and_relaxed_search_keeps_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    data = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).tolist()
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    want = brute(list(enumerate(data)), 10, 100)
    found = {relax: [(r.query_id, r.vec_id) for r in vptree.nearest(table, shard_rows=200, relax=relax).collect()] for relax in (1.0, 1.5)}
    exact = {(q, v) for q, _, v, _ in want}
    assert set(found[1.0]) == exact and len(found[1.0]) == len(exact)
    assert len(set(found[1.5]) & exact) / len(exact) >= 0.9
    points = np.array(data)
    cells = vptree.Cells(points[:1000], 20)
    at = cells.assign(points)
    for c in range(20):
        for r, path in zip(np.flatnonzero(at == c), cells.path_distances(points[at == c], at[at == c]), strict=True):
            assert np.allclose(path, [np.linalg.norm(points[r] - cells.points[v]) for v in cells.paths[c]])
        reach = np.array(cells.path_distances(points[at == c], at[at == c]))
        cells.low[c, : reach.shape[1]], cells.high[c, : reach.shape[1]] = reach.min(axis=0), reach.max(axis=0)
    least = np.array([[np.linalg.norm(points[at == c] - q, axis=1).min() for c in range(20)] for q in points[:50]])
    bounds = cells.bounds(points[:50])
    assert (bounds <= least).all() and (bounds > 0).mean() > 0.3


def test_relaxed_search_keeps_recall_and_skips_more():
    rng = np.random.default_rng(1)
    points, queries = rng.normal(size=(3000, 8)), rng.normal(size=(40, 8))
    tree = vptree.VantagePointTree(points)
    exact, off = tree.search(queries, 10)
    assert np.allclose(np.sort(np.linalg.norm(queries[:, None] - points, axis=2), axis=1)[:, :10], off)
    relaxed, _ = tree.search(queries, 10, relax=1.5)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), relaxed.tolist(), strict=True)]) >= 0.9


# HTML extraction


def test_html_blocks():
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div>
    <article><header><h1>Title &amp; more</h1></header><p>One<b>two</b> <!-- c --> three<br>four<p>Caf&eacute;&nbsp;x</p><aside>Side</aside><div class="comments"><p>First!</div><form>q</form></article>
    <footer>&copy; me</footer></body>"""
    assert html_text.blocks(page) == (["Title & more", "Onetwo three four", "Café x"], True)
    assert html_text.blocks("a < b &lt;i&gt; <") == (["a < b <i> <"], False)
    assert html_text.blocks("") == ([], False) and html_text.blocks("<div><p>open") == (["open"], False)


def test_repeated_substrings_by_brute_force():
    rng = np.random.default_rng(3)
    tokens, page = rng.integers(0, 3, 300), np.sort(rng.integers(0, 12, 300))
    run = 5
    where: dict = {}
    for i in range(300 - run + 1):
        if page[i] == page[i + run - 1]:
            where.setdefault(tuple(tokens[i : i + run]), []).append(i)
    want = np.zeros(300, bool)
    for places in where.values():
        if len({page[i] for i in places}) >= 2:
            for i in places:
                want[i : i + run] = True
    assert (html_text.repeated(tokens, page, run) == want).all()


def test_extract_text_with_and_without_landmarks(spark):
    same = "<div><p>welcome to our site please read the rules before posting</p><p>{}</p></div>"
    rows = [(1, "http://a.b/1", same.format("unique words about cats and dogs in the rain")), (2, "http://a.b/2", same.format("other text about boats")), (3, "http://c.d/1", same.format("alone on its host")),
            (4, None, None), (5, "x", ""), (6, "http://a.b/3", "<article><p>welcome to our site please read the rules before posting</p></article>")]
    frame = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id bigint, url string, html string, text string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(frame).collect()}
    assert got[1][0] == "unique words about cats and dogs in the rain" and got[2][0] == "other text about boats"
    assert got[3][0].endswith("\nalone on its host") and got[4] == ("", 0) == got[5]
    assert got[6][0] == "welcome to our site please read the rules before posting"
    assert html_text.extract_text(frame.limit(0)).count() == 0


# language identification


def test_language_id_learns_outside_the_fold(spark):
    words = {"en": "the of and that with this from have".split(), "de": "der die und nicht mit sich auf eine".split()}
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang, "s") for i, lang in enumerate(["en", "de"] * 60)] + [(1000, None, "en", "s"), (1001, "123 !!", "de", "s"), (1002, "", None, "s"), (None, "the and", "xx", "s")]
    got = {r.doc_id: r for r in language_id.language_id(docs(spark, rows)).collect()}
    for i, t, lang, _ in rows:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if t and re.search("[a-z]", t) and i is not None:
            assert got[i].lang_pred == lang
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[None].lang_pred in ("en", "de")
    assert language_id.language_id(docs(spark, [])).count() == 0


def plain_grams(text):
    found: Counter = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        found.update(word)
        for n in (2, 3):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def test_language_id_by_brute_force(spark):
    """Profiles, places and distances against plain dictionaries; also with languages in parts."""
    rng = random.Random(9)
    letters = {"xa": "abcdefgh", "xb": "efghijkl", "xc": "ijklmnop", "xd": "aeimoszé"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], weights=range(8, 0, -1), k=rng.randint(1, 7))) for _ in range(n))
    rows = [(k, text(lang, rng.randint(1, 60)), lang, "s") for k, lang in enumerate(["xa", "xb", "xc", "xd"] * 12)] + [(200, text("xa", 9000), "xa", "s"), (3, text("xb", 5), "xb", "s"), (3, text("xb", 5), "xb", "s"), (201, None, "xa", "s"), (202, "7 ?", "xb", "s")]
    frame = docs(spark, rows).withColumns({"lang_pred": F.lit(1), "score": F.lit("s"), "doc": F.lit("d")})
    size = 30
    # ties among equal counts go by the packed code: order the n-grams as the operator does
    code = lambda g: (lambda p: p[0] if len(g) == 1 else (p[0] | p[1] << 21 | 1 << 62) if len(g) == 2 else (p[0] | p[1] << 21 | p[2] << 42) - (1 << 63))([0 if c == " " else ord(c) for c in g])
    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]
    learned: dict = {}
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in learned.items()}
    want = []
    for i, t, *_ in rows:
        own = top(plain_grams(t))
        if not own:
            want.append((i, "und", 0.0))
            continue
        off = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(off, key=lambda lang: (off[lang], lang))
        want.append((i, best, round(1 - off[best] / (size * len(own)), 12)))
    for most in (language_id.MAX_PROFILE_ROWS, 70, 1):
        got = [(r.doc_id, r.lang_pred, round(r.score, 12)) for r in language_id.language_id(frame, size=size, most=most).collect()]
        assert sorted(got) == sorted(want)


def test_grams_by_brute_force():
    text = "Été, 12 ab—a"
    codes, counts = language_id.grams(text)
    want: Counter = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        want.update(word)
        want.update(padded[i : i + 2] for i in range(len(padded) - 1))
        want.update(padded[i : i + 3] for i in range(len(padded) - 2))
    assert sorted(counts.tolist()) == sorted(want.values()) and len(codes) == len(want)


def test_language_profiles_of_thousands_of_languages(spark):
    """Memory follows profile rows: 3,000 languages of their own letters each, and each is found."""
    word = lambda k: "".join(chr(0x4E00 + (k * 7 + j) % 20000) for j in range(7))
    profiles = language_id.learn_profiles(spark.createDataFrame([(f"l{k:04d}", word(k)) for k in range(3000)], "lang string, text string"))
    table = language_id._table(profiles)
    assert len(table[0]) == 3000 and sum(x.nbytes for x in table[1:]) < 40 * profiles.count()
    asked = spark.createDataFrame([(k, word(k)) for k in range(0, 3000, 50)], "id int, text string")
    assert all(r.lang == f"l{r.doc.id:04d}" and r.score == 1.0 for r in language_id.identify(asked, profiles).collect())


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def test_fingerprints():
    for t in (None, "", " \t", "One", "one two", "A b C d É x", "w " * 70_000, " ".join(map(str, range(500)))):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_covering_masks_leave_no_pair_out():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        flip = sum(1 << b for b in bits)
        assert any(not m & flip for m in masks)


@pytest.mark.parametrize("bucket", [4096, 7])
def test_links_keep_every_component(spark, bucket):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for b in base for _ in range(15)} | {b ^ 1 << 3 | 1 << 60 for b in base} | {0, 7}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), bucket=bucket)
    got = {r.node: r.component for r in components.component_of(edges, "src", "dst").collect()}
    parent = {f: f for f in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {f: got.get(f, f) for f in signed} == {f: top(f) for f in signed}


def test_near_duplicates_rows(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(4, long, "en", "s"), (2, long + " tail", "en", "s"), (9, None, "en", "s"), (8, " ", "en", "s"), (7, "other words here now", "en", "s"), (7, "other words here now", "en", "s"), (None, "alone in the dark", "en", "s")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    assert len(got) == len(rows) and all(f == f"{plain_fingerprint(dict((r[0], r[1]) for r in rows)[i]):016x}" for i, f, _ in got)
    by = {i: c for i, _, c in got}
    assert by[9] == by[8] == 8 and by[7] == 7 and by[None] is None
    kept = simhash.representatives(docs(spark, rows))
    assert sorted(((r.doc_id or -1) for r in kept.collect())) == sorted([-1, 7, 8] + ([2] if by[4] == 2 else [2, 4]))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# context-tree weighting


def plain_base(rows):
    low = {c: c + 32 for c in range(65, 91)}
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [""] for i, t, *_ in rows}
    counts = Counter(w for i in toks if zlib.crc32(str(i).encode()) % 7 != 2 for w in toks[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks.items()}


@pytest.mark.parametrize("bounds", [{}, {"head_codes": 300, "head_words": 2}])
def test_ctw_base_score_and_bounds(spark, bounds):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "Then", "that", "cat", "sat", "mat", "zz" + str(i)], k=rng.randint(1, 60))), "en", "s") for i in range(60)] + [(100, None, "en", "s"), (101, "", "en", "s")]
    want = plain_base(rows)
    got = ctw.ctw_score(docs(spark, rows), **bounds).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-9 * abs(base) + 1e-9
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert ctw.ctw_score(docs(spark, [])).count() == 0


def plain_ctw(train, depth):
    """Log-probability of a byte after a context, by recursion over a tree of plain counts."""
    counts: dict = {}
    for text in train:
        data = ctw.END * depth + text + ctw.END
        for at in range(depth, len(data)):
            for d in range(depth + 1):
                for j in range(8):
                    cell = counts.setdefault((data[at - d : at], 1 << j | data[at] >> 8 - j), [0, 0])
                    cell[data[at] >> 7 - j & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted: dict = {}

    def log_w(context, node):
        if (context, node) not in counts:
            return 0.0
        if (context, node) not in weighted:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(log_w(bytes([b]) + context, node) for b in range(256))
                own = math.log(0.5 * math.exp(own) + 0.5 * math.exp(below))
            weighted[context, node] = own
        return weighted[context, node]

    def log10(context, byte):
        total = 0.0
        for j in range(8):
            node, p = 1 << j | byte >> 8 - j, None
            for d in range(depth, -1, -1):
                own = context[len(context) - d :]
                if (own, 1) not in counts:
                    continue
                a, b = counts.get((own, node), (0, 0))
                here = (b + 0.5) / (a + b + 1)
                w = 0.5 if (own, node) not in counts else math.exp(math.log(0.5) + kt(a, b) - log_w(own, node))
                p = here if p is None else w * here + (1 - w) * p
            total += math.log10(p if byte >> 7 - j & 1 else 1 - p)
        return total

    return log10


def test_ctw_against_recursion_and_sums_to_one(spark):
    train = [b"abab", b"abba ab", b"b"]
    asked = [int.from_bytes(c + bytes([b]), "big") for c in (b"\n\n\n\nb", b"\n\n\nab", b"xxxba", b"qqqqq") for b in range(256)]
    counts = Counter(ctw._codes([t + ctw.END for t in train]).tolist())
    grams = spark.createDataFrame([(int(c), int(counts.get(c, 0))) for c in {*counts, *asked}], "code bigint, n bigint")
    found = {r.code: r.log10 for r in ctw.code_values(grams).collect()}
    plain = plain_ctw(train, ctw.DEPTH)
    for at in range(0, len(asked), 256):
        codes = asked[at : at + 256]
        assert abs(sum(10 ** found[c] for c in codes) - 1) < 1e-9
        assert np.allclose([found[c] for c in codes], [plain((c >> 8).to_bytes(5, "big"), c & 255) for c in codes], atol=1e-9)
    assert {round(r.log10, 9) for r in ctw.code_values(grams.withColumn("n", F.lit(0).cast("long"))).collect()} == {round(-math.log10(256), 9)}


def test_ctw_never_scores_minus_infinity(spark):
    # one context that was met twenty million times with one byte, and asked for another
    codes = [int.from_bytes(b"aaaaa" + bytes([b]), "big") for b in (255, 97, 0)]
    grams = spark.createDataFrame([(codes[0], 20_000_000), (codes[1], 0), (codes[2], 0)], "code bigint, n bigint")
    found = {r.code: r.log10 for r in ctw.code_values(grams).collect()}
    assert all(math.isfinite(v) for v in found.values()) and -1e-6 < found[codes[0]] <= 0 and max(found[c] for c in codes[1:]) < -7


def test_ctw_bound_changes_no_score(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "then", "cathedral", "sat", "zürich", "q" + str(i)], k=rng.randint(1, 40))), "en", "s") for i in range(80)] + [(100, None, "en", "s"), (100, "only here: xyzzy", "en", "s"), (None, "the cat", "en", "s")]
    taught = [b" ".join(ctw.words_of(t)) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    plain = plain_ctw(taught, ctw.DEPTH)
    score = lambda data: sum(plain((b"\n" * 5 + data)[at : at + 5], data[at]) for at in range(len(data)))
    texts = [b" ".join(ctw.words_of(t)) + ctw.END for _, t, *_ in rows]
    want = sorted((score(data), -score(data) / math.log10(2) / len(data)) for data in texts)
    for bound in (0, 90, ctw.HEAD_CODES):
        got = ctw.ctw_score(docs(spark, rows), head_codes=bound).collect()
        assert len(got) == len(rows) and np.allclose(sorted((r.score, r.bits_per_byte) for r in got), want, rtol=1e-9)


def test_large_hosts_lose_the_same_passages(spark):
    rng = random.Random(6)
    notices = [" ".join(f"n{k}w{j}" for j in range(12)) for k in range(20)]
    body = lambda k: " ".join(f"b{k}x{rng.randint(0, 9999)}" for _ in range(15))
    # each notice is on two pages of its host only; the last pages are equal, and have no usable URL
    pages = [(k, f"http://h{k % 2}.org/{k}", f"<p>{body(k)}</p><p>{notices[k // 4 * 2 + k % 2]}</p><p>{body(k)}</p>") for k in range(40)] + [(50, None, f"<p>{notices[0]}</p>"), (51, None, f"<p>{notices[0]}</p>"), (52, "http://h0.org/x", "<p>few words</p>"), (53, None, None)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    one, dealt = ({r.page_id: r.text for r in html_text.extract_text(table, chunk_tokens=n).collect()} for n in (html_text.CHUNK_TOKENS, 30))
    assert dealt == one and len(one) == len(pages)
    assert not any(n in text for n in notices for text in dealt.values()) and dealt[50] == dealt[51] == "" and dealt[52] == "few words"
    assert all(len(dealt[k].split()) == 30 for k in range(40))


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        cut = {s for s in free if level * w[s] > most * sizes[s]}
        if not cut:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in cut}
        left -= sum(most * sizes[s] for s in cut)
        free -= cut
    return target


def test_mixing_targets_and_positions(spark):
    rng = random.Random(1)
    names = ["b", "a", "Z", "é", None, "hot", "c"]
    rows = [(i, " ".join("w" * rng.randint(1, 40)), "en", rng.choice([*names, "hot", "hot", "hot"])) for i in range(900)] + [(1000, None, "en", "a"), (1001, "", "en", None)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    sizes: dict = {}
    for r, (i, t, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert (r.doc_id, r.size) == (i, len((t or "").split())) and r.taken <= 2 * r.size and r.taken == r.size * len(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
        sizes[s] = sizes.get(s, 0) + r.size
    want, of = plain_targets(sizes), {i: s for i, _, _, s in rows}
    for s in sizes:
        mine = [r for r in got if of[r.doc_id] == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken, *r.positions) for r in got) == sorted((r.doc_id, r.taken, *r.positions) for r in again)
    order = [r.position for r in mixing.training_order(mixing.mix_sources(docs(spark, rows))).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.positions) for r in got)


def test_mixing_positions_by_brute_force(spark):
    """Midpoints on the axis of cumulative words, and the demand inverted by bisection; clashing columns and repeated identifiers."""
    rng = random.Random(4)
    rows = [(rng.randint(0, 150), " ".join("w" * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", "a"])) for _ in range(300)]
    frame = docs(spark, rows).withColumns({"target": F.lit("t"), "taken": F.lit(1), "positions": F.lit(2), "source_size": F.lit(3)})
    found = mixing.mix_sources(frame, keep=tuple(frame.columns)).collect()
    order = {(r.doc_id, r.text): (r.h, r.x) for r in frame.select("doc_id", "text", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("x")).collect()}
    unsigned = lambda h: h & (1 << 64) - 1
    slice_of = lambda h: (unsigned(h) >> 40) * mixing.SLICES >> 24
    want = []
    for place, source in enumerate("abc"):
        mine = sorted([r for r in rows if r[3] == source], key=lambda r: (slice_of(order[r[0], r[1]][0]), order[r[0], r[1]][0], str(r[0]), order[r[0], r[1]][1]))
        total = sum(len(t.split()) for _, t, *_ in mine)
        target = plain_targets({s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "abc"})[source]
        start, end = mixing.RAMPS[place]
        demand = lambda t: start * t + (end - start) * t * t / 2  # noqa: B023, E731
        before = 0
        for i, t, *_ in mine:
            size, times = len(t.split()), []
            for k in range(2):
                at = k * total + before + size / 2
                if size and at < target:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        mid = (low + high) / 2
                        low, high = (mid, high) if demand(mid) < at / target * demand(1) else (low, mid)
                    times.append(round(low, 6))
            want.append((i, t, source, size, total, *times))
            before += size
    assert sorted((r.doc_id, r.kept.text, r.kept.source, r.size, r.source_size, *(round(p, 6) for p in r.positions)) for r in found) == sorted(want)
    again = mixing.mix_sources(frame.repartition(9)).collect()
    assert sorted((r.doc_id, r.size, *r.positions) for r in again) == sorted((r.doc_id, r.size, *r.positions) for r in found)


def test_mixing_cuts_hot_identifiers_without_changing_positions(spark):
    """A third of the rows share a null identifier: cut by text, and with more slices, positions stay those of one task a slice."""
    rows = [(None if i % 3 == 0 else i % 900, " ".join("w" * (i % 23)) + f" t{i}", "en", "ab"[i % 5 == 0] if i % 11 else None) for i in range(6000)]
    frame = docs(spark, rows)
    plain = mixing.mix_sources(frame, keep=("text",))
    parts = []
    cut_hot = mixing._cut_hot

    def watched(*args):
        out = cut_hot(*args)
        parts.append(out.groupBy("__source", "__slice", "__rank", "__sub").count().agg(F.max("count")).first()[0])
        return out

    mixing._cut_hot = watched
    try:
        cut = mixing.mix_sources(frame, keep=("text",), slice_rows=8)
    finally:
        mixing._cut_hot = cut_hot
    key = lambda df: sorted((str(r.doc_id), r.kept.text, r.size, *r.positions) for r in df.collect())
    assert key(cut) == key(plain) and parts[0] <= 60


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    got = mixing.mix_sources(docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


# WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (9, "u", "z"), (9, "u", "z")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, html string, header string")
    path = common.scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        same = [r[0] for r in rows if (r[2] or "") == (h or "")]
        body = (h or "").encode()
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == min(same) else "revisit", None if i == min(same) else min(same)))
    assert got == sorted(want, key=str)
    records = warc.read_records(spark, path).collect()
    assert len(records) == len(rows) and all(bytes(r.payload) == (dict((x[0], x[2]) for x in rows)[r.record_id] or "").encode() and bytes(r.header).endswith(b"\r\n\r\n") for r in records)
    assert not any(b"\r\nX: y" in bytes(r.header) for r in records)
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_warc_deals_out_a_shared_payload_and_takes_an_empty_table(spark):
    rows = [(k, f"u{k}", "same" * 1000 if k < 300 else f"p{k}") for k in range(320)] + [(None, "n", "same" * 1000)]
    path, none = common.scratch_path(spark, "warc-hot"), common.scratch_path(spark, "warc-none")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archive(pages, path)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_index(spark, path).collect()}
    assert got == {k: ("response", None, len(h)) if k == 0 or k is not None and k >= 300 else ("revisit", 0, len(h)) for k, _, h in rows}
    assert spark.read.parquet(f"{path}/payloads").count() == 21
    warc.write_archive(pages.limit(0), none)
    assert warc.read_index(spark, none).count() == 0


def test_warc_stops_at_damaged_payloads(spark):
    path = common.scratch_path(spark, "warc-bad")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).collect()
    spark.createDataFrame(bad, "digest binary, payload binary, copies bigint").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_index(spark, path).collect()


# URL filter


def test_url_rules_spread_repeated_pages(spark):
    """Thousands of null URLs and of one URL, with and without a rule: one row each, and not all in one task."""
    many = spark.range(20000).select(F.col("id").alias("page_id"), F.expr("case when id % 3 = 0 then null when id % 3 = 1 then 'http://a.net/x' else concat('https://h', id, '.org/fr/') end").alias("url"))
    found = url_filter.judge_urls(many, url_filter.rules_frame(spark, url_filter.RULES))
    got = {(r.rule, r.verdict): r.n for r in found.groupBy("rule", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, "allow"): 6667, ("net/", "block"): 6667, ("org/fr/", "allow"): 6666}
    sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 20000 / len(sizes)


def test_url_rules(spark):
    urls = ["http://Example.NET/en/x?q", "https://a.example.net/en/", "http://example.net/fr/", "http://m.example.com/de/1#t", "http://example.com/d", "ftp://x.org/fr/1", "http://org", "http://net/", "http://notnet/", "no scheme net/", None, "http://net?x", "://b.net/"]
    pages = spark.createDataFrame([(k, u, "p", "r") for k, u in enumerate(urls)] + [(0, urls[0], "p", "r")], "page_id bigint, url string, path string, rule string")
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = urls[r.page_id] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best[1:])
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES).limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/p")).alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("HTTP://H"), F.col("id"), F.lit(".NET/p?x=1")).alias("url"))
    assert sorted(r.page_id for r in url_filter.listed_urls(pages, listed).collect()) == list(range(3000))
    keys = listed.select(F.col("url").alias("k"))
    other = spark.range(20000).select(F.concat(F.lit("other"), F.col("id")).alias("k2"))
    assert url_filter.possible_hits(other, "k2", keys, "k", 3000).count() < 1000


# joins that spread hot keys


def test_spread_join_equals_a_left_join(spark):
    rows = [(k % 7 if k % 2 else 3, k) for k in range(1000)] + [(None, 1), (99, 2)]
    left = spark.createDataFrame(rows, "a int, b int")
    right = left.filter("a <> 99").groupBy("a").agg(F.count("*").alias("n"), F.max("b").alias("top"))
    want = sorted(left.join(right, "a", "left").select("a", "b", "n", "top").collect(), key=str)
    for total in (1002, 1 << 24):
        assert sorted(common.spread_join(left, right, ["a"], "n", total).collect(), key=str) == want


# components


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.component_of(spark.createDataFrame(edges, "s bigint, d bigint"), "s", "d").collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)}
