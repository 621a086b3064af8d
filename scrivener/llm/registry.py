"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import alignment, bpe, covertree, ctw, exact_dedup, html_text, language_id, merkle, mixing, simhash, url_filter, vptree, warc
from scrivener.llm.common import read_table, scratch_path

RANKS = "byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_score(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    first = mixed.withColumn("first_position", F.get("positions", F.lit(0)))
    # documents in the order in which training meets them; those that it does not take come first
    return first.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, url_filter.RULES))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_inner(read_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_vptree": op3_vptree,
    "op4_html_text": op4_html_text,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_ctw": op7_ctw,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_url_filter": op10_url_filter,
    "op11_cover_tree": op11_cover_tree,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_vptree": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
              AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 10""",
    "op9_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
            FROM pages),
        digits AS (
            SELECT page_id, string_agg(lpad(to_base(('0x' || substr(h, 1 + 5 * k, 5))::BIGINT, 32), 4, '0'), '' ORDER BY k) AS b
            FROM p, range(8) r(k) GROUP BY page_id)
        SELECT page_id, strlen(html) AS payload_bytes,
               translate(b, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> owner THEN owner END AS refers_to
        FROM p JOIN digits USING (page_id)""",
    "op10_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fits AS (
            SELECT page_id, host, path, h || p AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
            FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1""",
    "op11_cover_tree": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
              AND coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 5""",
    "op12_merkle": """
        WITH RECURSIVE fields AS (
            SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS grp, text,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
                   xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                       lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) AS crc
            FROM documents),
        leaves AS (
            SELECT rid, doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN crc % 5 = 0 AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS tampered,
                   row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n
            FROM fields),
        tree AS (
            SELECT grp, 0 AS lvl, n, pos, leaf AS node FROM leaves
            UNION ALL
            SELECT grp, lvl + 1, (n + 15) // 16, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, lvl, n, pos // 16),
        subroots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
            SELECT 0 AS lvl, n, pos, subroot AS node FROM subroots
            UNION ALL
            SELECT lvl + 1, (n + 15) // 16, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 16),
        near AS (
            SELECT l.rid, 0 AS part, t.lvl, t.pos, t.node, t.pos < l.pos >> (4 * t.lvl) AS is_left
            FROM leaves l JOIN tree t ON t.grp = l.grp AND t.n > 1 AND t.pos // 16 = l.pos >> (4 * t.lvl + 4)
            WHERE t.pos <> l.pos >> (4 * t.lvl)
            UNION ALL
            SELECT l.rid, 1, t.lvl, t.pos, t.node, t.pos < s.pos >> (4 * t.lvl)
            FROM leaves l JOIN subroots s USING (grp) JOIN top t ON t.n > 1 AND t.pos // 16 = s.pos >> (4 * t.lvl + 4)
            WHERE t.pos <> s.pos >> (4 * t.lvl)),
        levels AS (
            SELECT l.rid, 0 AS part, t.lvl FROM leaves l JOIN (SELECT DISTINCT grp, lvl FROM tree WHERE n > 1) t USING (grp)
            UNION ALL SELECT l.rid, 1, t.lvl FROM leaves l, (SELECT DISTINCT lvl FROM top WHERE n > 1) t),
        segments AS (
            SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS k,
                   coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE is_left), '') AS l,
                   coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE NOT is_left), '') AS r
            FROM levels LEFT JOIN near USING (rid, part, lvl) GROUP BY rid, part, lvl),
        folded AS (
            SELECT rid, 0::BIGINT AS k, coalesce(tampered, leaf) AS node FROM leaves
            UNION ALL
            SELECT f.rid, s.k, sha256(s.l || f.node || s.r) FROM folded f JOIN segments s ON s.rid = f.rid AND s.k = f.k + 1)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN (SELECT grp, subroot FROM subroots) USING (grp)
        CROSS JOIN (SELECT node AS root FROM top WHERE n = 1)
        LEFT JOIN (SELECT rid, string_agg(l || r, '' ORDER BY k) AS proof FROM segments GROUP BY rid) USING (rid)
        JOIN (SELECT rid, arg_max(node, k) AS folded_root FROM folded GROUP BY rid) USING (rid)""",
}
