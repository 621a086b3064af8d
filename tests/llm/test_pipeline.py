"""The corpus pipeline, stage by stage, against brute force on a small table."""

import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from scrivener.llm import bpe, mixing, simhash
from scrivener.llm.common import read_table


def test_stages(spark, tmp_path):
    words = "the of and that with this from have which their would there about other".split()
    clean = [(k, " ".join(words[(k * j) % len(words)] + str(k * j % 97) + "x" for j in range(1, 40)), "en", f"s{k % 3}", 10) for k in range(40)]
    rows = [*clean, (100, clean[0][1], "en", "s0", 1), (101, None, "en", "s0", 0), (102, "12 34 !!", None, None, 8), (103, "", "en", "s1", 0), (104, clean[1][1], None, None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = read_table(spark, str(tmp_path), "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "bpe_encode" or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in found) for name, found in seen.items()}
    assert ids["language_id"] == sorted(r[0] for r in rows if r[1] and re.search("[a-z]", r[1]))
    assert ids["exact_dedup"] == sorted([*range(2, 40), 100, 104])
    assert set(ids["simhash_dedup"]) <= set(ids["exact_dedup"]) and len(ids["simhash_dedup"]) >= 35
    assert set(ids["mix_sources"]) <= set(ids["simhash_dedup"])
    total = lambda found: sum(len(r.text.split()) for r in found)
    assert abs(total(seen["mix_sources"]) - 1.5 * total(seen["simhash_dedup"])) < 0.1 * total(seen["simhash_dedup"])
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in seen["mix_sources"]}
    assert ids["bpe_encode"] == ids["mix_sources"] and all(r.round_trip and list(r.ids) == plain.encode_ordinary(text[r.doc_id]) for r in seen["bpe_encode"])
    spark.createDataFrame(rows[:30], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/small/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/small").count() > 0


def test_language_floor_rejects_unlearned_languages_and_noise(spark):
    rng = random.Random(5)
    words = {
        "en": "the of and that with this from have which their would there about other people water between through never while house morning children thought because".split(),
        "de": "der die und das nicht mit sich auch eine werden durch zwischen wasser menschen morgen kinder haus gedanke weil niemals andere deutsche straße schön über".split(),
    }
    clean = [(k, " ".join(rng.choices(words[lang], k=60)), lang, "s", 1) for k, lang in enumerate(["en", "de"] * 60)]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60))
    rows = [*clean, (500, polish, None, "s", 1), (501, noise, None, "s", 1), (502, "12 34", None, "s", 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, table, "").collect()) == [r[0] for r in clean]


WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, target int, lang_pred string, score string, ids string, kept int, doc int, fp int, positions int"


def wide(spark, rows):
    """Documents with further columns whose names are those of the stages' own."""
    return spark.createDataFrame([(*r, "z", 1, "y", "x", "i", 2, 3, 4, 5) for r in rows], WIDE)


def test_near_copies_and_mixing_by_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, k = [], 0
    for group in range(30):
        words = rng.choices(vocabulary, k=rng.choice([60, 200, 600]))
        for _ in range(rng.choice([1, 1, 2, 6])):  # each copy is an edit of the one before: links form chains
            rows.append((rng.randint(0, 1 << 40), " ".join(words), "en", f"s{group % 3}" if group % 4 else None, k))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            k += 1
    rows += [(7, "long " + " ".join(rng.choices(vocabulary, k=60_000)), "en", "s1", 0), (8, None, None, None, 0), (9, " ", None, "s1", 0), (None, "a text without a name", "en", "s2", 0)]
    table = wide(spark, rows)
    near = corpus_pipeline.drop_near_copies(spark, table, "")
    assert near.columns == table.columns
    fps = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= corpus_pipeline.NEAR_RADIUS:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least: dict = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = r[0] if least.get(g) is None else min(least[g], r[0] if r[0] is not None else least[g])
    kept = near.collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, least.values())) and len(kept) < len(rows) - 10

    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == table.columns
    times: dict = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    sizes = {r.doc_id: len((r.text or "").split()) for r in kept}
    names = sorted({r.source for r in kept if r.source is not None}) + [None]
    total = {s: sum(sizes[r.doc_id] for r in kept if r.source == s) for s in names}
    weight, share, cut = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(total.values()), {}
    while True:
        level = (share - sum(cut.values())) / sum(w for s, w in weight.items() if s not in cut)
        over = {s: 2 * total[s] for s in names if s not in cut and level * weight[s] > 2 * total[s]}
        if not over:
            break
        cut |= over
    hashes = {r.doc_id: r.h for r in near.select("doc_id", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string")).alias("h")).collect()}
    for s in names:
        target, before = cut.get(s, level * weight[s]), 0
        for i in sorted((r.doc_id for r in kept if r.source == s), key=lambda i: ((hashes[i] & (1 << 64) - 1) >> 40, hashes[i])):
            want = sum(sizes[i] > 0 and p * total[s] + before + sizes[i] / 2 < target for p in range(2))
            assert times.get(i, 0) == want
            before += sizes[i]


def test_stages_take_empty_repeated_and_clashing_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs into the woods " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + "again", "en", None, 1), (None, text, None, "a", 1), (3, None, "en", "a", 0), (4, "x " * 300_000, "en", "b", 0)]
    for table in (wide(spark, rows), wide(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            found = out.collect()
            assert name == "bpe_encode" or out.columns == table.columns
            assert name in ("mix_sources", "bpe_encode") or len(found) <= len(rows)
            if not table.take(1):
                assert not found
            elif name == "language_id":
                assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "4", "None"]
            elif name == "exact_dedup":
                assert sorted(str(r.doc_id) for r in found) == ["1", "2", "3", "4"]
            elif name == "simhash_dedup":
                assert sorted(r.doc_id for r in found if r.doc_id != 2) == [1, 3, 4]
            elif name == "bpe_encode":
                assert len(found) == len(rows) and all(r.round_trip for r in found)
