"""Cover-tree search, Merkle manifest and tokenizer alignment against brute force."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from scrivener.llm import alignment, covertree, html_text, merkle

LONG = 2**63 - 1


# top-k by inner product


def best_products(rows, k, every):
    rows = [(i, [max(-LONG, min(LONG, math.floor(256 * x))) for x in v]) for i, v in rows]
    out = []
    for i, v in rows:
        if i % every == 0:
            found = sorted((-max(-LONG, min(LONG, sum(map(int.__mul__, v, w)))), j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"cell_rows": 100, "sample": 50}, {"cell_rows": 300, "least_rows": 1, "sample": 3}])
def test_top_inner_products_are_exact(spark, bounds):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] * (1 + i % 3) + 0.05 * rng.normal(size=8)).tolist()) for i in range(1500)]
    # a third of all rows are one vector; lengths differ; zero, empty and huge vectors take part
    rows += [(i, [1.0, 0.0, 2.0]) for i in range(5000, 5700)]
    rows += [(9000, [0.0] * 8), (9050, []), (9051, []), (9100, [1e300] * 3), (9101, [-1e300] * 3), (9150, [1.0] * 3)]
    # an identifier with several vectors is never its own neighbour
    rows += [(100, [5.0] * 8), (101, [5.0] * 8), (101, [4.0] * 8)]
    unusable = [(None, [1.0]), (1, None), (2, [None, 1.0, 3.0]), (3, [math.nan]), (50, [math.inf] * 8)]
    table = spark.createDataFrame([(i, v, "x", "y", 0) for i, v in [*rows, *unusable, rows[0]]], "vec_id long, embedding array<double>, score string, QID string, cell int")
    assert sorted(map(tuple, covertree.top_inner(table, **bounds).collect())) == best_products(rows, covertree.K, covertree.QUERY_EVERY)


def test_top_inner_of_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.top_inner(table).collect()] == [(0, 1, 1, 256 * 512)]
    assert covertree.top_inner(table.limit(0)).count() == 0


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=6) * 100 + rng.normal(size=(400, 6)) for _ in range(12)])
    tree = covertree.CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    for n in range(len(tree.low)):
        rows = tree.order[tree.low[n] : tree.high[n]]
        assert tree.centre[n] in rows
        assert np.linalg.norm(points[rows] - points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
        assert sorted(np.concatenate([tree.order[tree.low[c] : tree.high[c]] for c in tree.children[n]] or [rows])) == sorted(rows)
    whole = np.floor(points * 4).astype(np.int64)
    searched = covertree.Searched(whole, np.arange(len(whole)))
    asked = np.arange(0, len(whole), 50)
    best = covertree.Best(asked, 5, np.full(len(asked), -LONG))
    searched.search(whole[asked], best)
    assert searched.pairs < len(asked) * len(whole) / 4
    want = np.sort(np.where(np.arange(len(whole)) == asked[:, None], -LONG, whole[asked] @ whole.T), axis=1)[:, :-6:-1]
    assert (best.scores == want).all()


# Merkle manifest


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [hashed("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def siblings_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        start = at // 16 * 16
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])))
        at //= 16
    return out


def manifest_of(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda x: x[:3])
        trees[name] = levels_of([x[2] for x in by_source[name]])
    top = levels_of([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(by_source[name]):
            path = siblings_of(trees[name], i) + siblings_of(top, k)
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in path:
                node = hashed(left + node + right)
            out.append((row[0], leaf, trees[name][-1][0], top[-1][0], hashed("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, node string, GRP string, pos int"


def manifest(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(3)
    return sorted(map(tuple, merkle.manifest(table).collect()), key=str)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4097])
def test_manifest_of_one_source(spark, n):
    rows = [(i * 7 % 10_007, "x", "en", None, f"Text {i} Ä") for i in range(n)]
    assert manifest(spark, rows) == manifest_of(rows)


def test_manifest_of_many_sources_nulls_repeats_and_long_texts(spark):
    rng = random.Random(6)
    rows = [(i, f"s{rng.randrange(40)}" if i % 3 else "hot", "de", i, "Wort" * rng.randrange(9)) for i in range(2000)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (7, "hot", "en", 3, ""), (7, "hot", "en", 3, ""), (8, "é", "en", 1, "A" * 300_000), (9, "", "en", 2, None)]
    rows += [(i, f"q{i}", None, None, "Only One") for i in range(300)]
    got = manifest(spark, rows)
    assert got == manifest_of(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    # the root names the set of rows, whatever their order
    assert manifest(spark, rows[::-1]) == got


def test_manifest_of_one_row_and_of_none(spark):
    ((_, leaf, subroot, root, proof, _, verified),) = manifest(spark, [(1, "a", "en", 1, "x")])
    assert leaf == subroot == root and proof == hashed("") and verified
    assert manifest(spark, []) == []


# alignment of tokenizers

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_loops(rows):
    left, right = tokenizers.Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in prints}
    for n, b in enumerate(sorted(set(range(256)) - set(prints))):
        letters[chr(256 + n)] = b
    bytes_a = lambda i: bytes(letters[c] for c in left.id_to_token(i))
    bytes_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    count, found = Counter(), []
    for ident, text in rows:
        data = (" " + (text or "")).encode()
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        if not text or b"".join(map(bytes_a, a)) != data or b"".join(map(bytes_b, b)) != data:
            found.append((ident, [], [], [], ""))
            continue
        ends_a = dict(zip(np.cumsum([len(bytes_a(i)) for i in a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum([len(bytes_b(i)) for i in b]).tolist(), range(len(b)), strict=True))
        groups, links, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, a[at_a : ends_a[end] + 1])) + "|" + ",".join(map(str, b[at_b : ends_b[end] + 1])))
            at_a, at_b = ends_a[end] + 1, ends_b[end] + 1
            links.append((a[at_a - 1], b[at_b - 1]))
        count.update(links)
        found.append((ident, a, b, links, hashed(";".join(groups))))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, len(a), len(b), len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for i, a, b, x, sha in found), key=str)


def texts_to_align():
    rng = random.Random(9)
    words = "the of Und señor l'été 漢字 नमस्ते 12,5 x_y foo-bar Zürich naïve <s> \n\n \t".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900 + i, "the same text of all copies") for i in range(200)]
    return rows + [(None, None), (1, ""), (1, " "), (2, "a▁b"), (3, "<|endoftext|> <s> </s> <unk> <0x41>"), (4, "x" * 100_000), (6, " "), (6, " ")]


@pytest.mark.parametrize("bounds", [{}, {"radixes": 3, "spill_records": 500, "task_bytes": 4000}])
def test_alignment_equals_loops(spark, monkeypatch, bounds):
    rows = texts_to_align()
    monkeypatch.setattr(alignment, "BATCH_CHARS", 2000 if bounds else alignment.BATCH_CHARS)
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, spill string, RADIX int, id string").repartition(3)
    assert sorted(map(tuple, alignment.align(table, BPE, PIECES, **bounds).collect()), key=str) == aligned_by_loops(rows)


def test_both_encoders_of_side_a_agree_where_either_is_used():
    with open(BPE, encoding="utf-8") as file:
        spec = file.read()
    assert alignment.plain_ranks(spec)
    whole = json.loads(spec)
    for part, key, value in (("model", "ignore_merges", True), ("model", "unk_token", "?"), ("pre_tokenizer", "add_prefix_space", True)):
        assert not alignment.plain_ranks(json.dumps(whole | {part: whole[part] | {key: value}}))
    sides = alignment.Sides(spec, None, True)
    every = [chr(c) for c in range(0x2100) if alignment.ALIKE.fullmatch(chr(c))]
    texts = [a + x + b for x in every for a in ("", "a", " ", "1", "'", "\n", "é", "  ") for b in ("", "a", " ", "1", "s", "\n", "  ")]
    assert [e.ids for e in sides.a.encode_batch_fast(texts, add_special_tokens=False)] == [sides.fast.encode_ordinary(t) for t in texts]


def test_alignment_of_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECES).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1 << 12])
def test_heap_merge_adds_up_counts(chunk):
    rng = random.Random(2)
    runs, want = [], Counter()
    for _ in range(9):
        run = Counter(rng.randrange(200) for _ in range(rng.randrange(150)))
        want.update(run)
        runs.append((np.array(sorted(run), np.int64), np.array([run[k] for k in sorted(run)], np.int64)))
    parts = list(alignment.merge_counts(runs, chunk))
    keys = np.concatenate([p[0] for p in parts]).tolist()
    assert keys == sorted(want)
    assert np.concatenate([p[1] for p in parts]).tolist() == [want[k] for k in keys]


def test_packed_arrays_come_back():
    arrays = [np.array(x, np.int64) for x in ([], [0, 255], [65536], [1 << 40, 3])]
    assert [a.tolist() for a in alignment.unpack(alignment.pack(*arrays))] == [a.tolist() for a in arrays]


# pages that are broken, long or empty

BROKEN = ("<script ", "<a ", "<!-- ", '<p class="', "<p class='\"", "<a<a", '"<a \'', "</", "<div></b>", "<div>", "<title>", "&amp", "<x y=")


@pytest.mark.parametrize("piece", BROKEN)
def test_a_megabyte_of_broken_markup_is_read_in_seconds(piece):
    for end in ("", ">", "-->", "'>", "<p>end</p>"):
        began = time.process_time()
        html_text.blocks(piece * ((1 << 20) // len(piece)) + end)
        assert time.process_time() - began < 10


def test_markup_equals_one_pattern_over_random_pages():
    whole = re.compile(
        r"""<!--.*?(?:-->|$)|<(script|style|title|textarea|noscript|iframe|template|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""", re.S | re.I
    )
    rng = random.Random(41)
    bits = ['<p class="x">', "<p>", "</p>", "<a href='q'>", '"', "'", "<", ">", "<script>", "</script >", "<!--", "-->", "<article>", "text ", "<br/>", "<div id=nav>", "<?x?>", "<!doctype html>", "</", "<title>t</title>", "<svg", "é ", "=", "/"]
    for _ in range(5000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 16)))
        want = [(m.start(), m.end(), "", None, "") if m[3] is None else (m.start(), m.end(), m[2], m[3], m[4]) for m in whole.finditer(page)]
        assert list(html_text.markup(page)) == want, page


def test_pages_without_blocks_long_pages_and_repeated_rows(spark):
    empty = [(i, None, None) for i in range(3000)] + [(i, "http://h.net/x", "<nav>menu</nav>") for i in range(3000, 4000)]
    long = "<article>" + "".join(f"<p>Satz {i} &amp; mehr</p>" for i in range(20_000)) + "</article>"
    rows = [*empty, (9000, "http://h.net/l", long), (9001, "http://h.net/r", "<p>own words of this page</p>"), (9001, "http://h.net/r", "<p>own words of this page</p>")]
    table = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "page_id long, url string, html string, text string, n_chars int, MARKS boolean").repartition(5)
    got = html_text.extract_text(table).collect()
    assert len(got) == len(rows) and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id < 4000)
    (found,) = [r for r in got if r.page_id == 9000]
    assert found.text == "\n".join(f"Satz {i} & mehr" for i in range(20_000)) and found.n_chars == len(found.text)
    assert [r.text for r in got if r.page_id == 9001] == ["own words of this page"] * 2


# repeats of a host, pages with landmarks included


def test_suffix_array_and_common_prefixes_by_brute_force():
    rng = np.random.default_rng(11)
    for turn in range(150):
        n = int(rng.integers(0, 50))
        tokens, segment = rng.integers(0, 1 + turn % 3, n), np.sort(rng.integers(0, 1 + turn % 5, n))
        order, common = html_text.suffix_array(tokens, segment)
        suffix = [[int(t) for t, s in zip(tokens[i:], segment[i:], strict=True) if s == segment[i]] for i in range(n)]
        assert sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            same = [x == y for x, y in zip(a, b, strict=False)]
            assert a <= b and common[k] == (same.index(False) if False in same else len(same))


def test_pages_with_landmarks_join_the_suffix_array_of_their_host(spark):
    """Every page of a host is evidence, by what lies outside of a marked main part and by what lies in one; by brute force, for hosts of one part and of many."""
    rng = random.Random(17)
    say = lambda k, n=12: " ".join(f"{k}w{j}" for j in range(n))
    lines = [say(f"m{k}") for k in range(6)]
    pages = []
    for i in range(60):
        marked, menu, own = rng.random() < 0.6, rng.choice(lines), say(f"own{i}", 9)
        shared = rng.choice(lines)
        main = f"<p>{own}</p><p>{shared}</p>"
        pages.append((i, f"http://h{i % 3}.org/{i}", f"<nav>{menu}</nav>" + (f"<article>{main}</article>" if marked else f"<div>{main}</div>"), marked, menu, own, shared))
    # a menu on one page with landmarks and one without; a passage of two articles on two pages without; a host where all have landmarks
    pages.append((100, "http://x.org/a", f"<nav>{say('menu')}</nav><article><p>{say('art')}</p></article>", True, say("menu"), say("art"), None))
    pages.append((101, "http://x.org/b", f"<div>{say('menu')}</div><div>{say('other')}</div>", False, None, say("other"), say("menu")))
    pages += [(110 + i, f"http://y.org/{i}", f"<article><p>{say(f'a{i}')}</p><p>{say('quote')}</p></article>", True, None, say(f"a{i}"), say("quote")) for i in range(2)]
    pages += [(120 + i, f"http://y.org/{i}", f"<p>{say('quote')}</p><p>{say(f'b{i}')}</p>", False, None, say(f"b{i}"), say("quote")) for i in range(2)]
    pages += [(130 + i, f"http://z.org/{i}", f"<nav>{say('top')}</nav><article><p>{say('top')}</p></article>", True, say("top"), say("top"), None) for i in range(3)]
    outside: dict = {}
    within: dict = {}
    for i, url, _, marked, menu, own, shared in pages:
        for line in {menu} | (set() if marked else {own, shared}):
            outside.setdefault((url.split("/")[2], line), set()).add(i)
        for line in {own, shared} if marked else ():
            within.setdefault((url.split("/")[2], line), set()).add(i)
    repeats = lambda url, line: line is not None and len(outside.get((url.split("/")[2], line), ())) >= html_text.PAGES
    goes = lambda url, line: repeats(url, line) and len(outside[url.split("/")[2], line]) > len(within.get((url.split("/")[2], line), ()))
    table = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    for tokens in (html_text.CHUNK_TOKENS, 60):
        got = {r.page_id: r for r in html_text.extract_text(table, chunk_tokens=tokens).collect()}
        assert len(got) == len(pages)
        for i, url, _, marked, menu, own, shared in pages:
            body = [x for x in ((own, shared) if i < 100 or marked else (shared, own)) if x]
            assert got[i].text == "\n".join(x for x in body if marked or not goes(url, x)), (i, tokens)
            assert got[i].n_repeated == sum(len(x.split()) for x in [menu] * repeats(url, menu) + [x for x in (own, shared) if not marked and goes(url, x)]), (i, tokens)
    assert got[101].text == say("other") and got[100].n_repeated == 12
    assert got[120].text == f"{say('quote')}\n{say('b0')}" and got[130].text == say("top") and got[130].n_repeated == 12


def test_main_parts_of_wholly_marked_hosts_change_nothing():
    """They are left out of the stream there; with them in it every text and count is the same."""
    import pyarrow as pa

    rng = random.Random(5)
    lines = [" ".join(f"l{k}w{j}" for j in range(rng.randint(6, 14))) for k in range(6)]
    pick = lambda n: [rng.choice(lines) for _ in range(n)]
    pages = [{"id": i, "url": f"u{i}", "host": "h", "part": 0, "parts": 1, "kept": pick(3), "beside": pick(2), "marks": True} for i in range(40)]
    without, joined = (html_text._without_repeats(pa.Table.from_pylist([p | {"mixed": m} for p in pages]), None).to_pylist() for m in (False, True))
    assert without == joined and [r["text"] for r in joined] == ["\n".join(p["kept"]) for p in pages] and any(r["n_repeated"] for r in joined)


def test_identifiers_of_pages_stay_as_they_are(spark):
    rows = [(2**62 + 1, "http://a.b/1", "<article>one</article>"), (None, "http://a.b/2", "<p>two</p>"), (2**53 + 1, "http://a.b/3", "<p>three</p>"), (None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for tokens in (html_text.CHUNK_TOKENS, 1):
        got = html_text.extract_text(table, chunk_tokens=tokens).collect()
        assert sorted((r.text, r.page_id) for r in got if r.text) == [("one", 2**62 + 1), ("three", 2**53 + 1), ("two", None)] and len(got) == 4
