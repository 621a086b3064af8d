"""URL filtering: a blocked Bloom filter, then an exact hash join (DataFrame operations only).

Listed canonical URLs set bits in 64-bit blocks, one block a key. A candidate key that
finds all of its bits set is a possible hit; an exact join on the key removes the false
positives. The filter has at most ``MAX_BLOCKS`` rows of 16 bytes, which bounds what is
broadcast; the listed keys themselves are joined without a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.common import ascii_lower, spread_join, stored

BITS_PER_KEY = 16
PROBES = 6
#: Bound of the broadcast filter: 2^18 blocks of 64 bits.
MAX_BLOCKS = 1 << 18

# The rules of the production query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _mask(key: Column) -> Column:
    h, mask = F.xxhash64(key, F.lit(2)), F.lit(0).cast("long")
    for j in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return mask


def bloom_blocks(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as rows (__block, __bits), and its number of blocks, at most MAX_BLOCKS."""
    blocks = 1
    while blocks * 64 < n_keys * BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    rows = listed.select(_block(F.col(key), blocks).alias("__block"), _mask(F.col(key)).alias("__mask"))
    return rows.groupBy("__block").agg(F.bit_or("__mask").alias("__bits")), blocks


def possible_hits(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, n_keys: int) -> DataFrame:
    """The rows whose key the filter cannot rule out."""
    bloom, blocks = bloom_blocks(listed, listed_key, n_keys)
    probed = rows.withColumn("__block", _block(F.col(key), blocks))
    hits = probed.join(F.broadcast(bloom), "__block")
    return hits.filter(F.col("__bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key))).drop("__block", "__bits")


def listed_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose canonical URL (host and path) is listed, all columns kept.

    A null URL or one without ``://`` is never listed. Repeated list entries count once.
    """
    keys = listed.select(F.concat(url_host(F.col(listed_col)), url_path(F.col(listed_col))).alias("__key")).filter("__key <> ''").distinct()
    rows = pages.withColumn("__url_key", F.concat(url_host(F.col(url_col)), url_path(F.col(url_col)))).filter("__url_key <> ''")
    hits = possible_hits(rows, "__url_key", keys, "__key", keys.count())
    return hits.join(keys, hits["__url_key"] == keys["__key"], "left_semi").drop("__url_key")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table of literals, so that no Python worker reads them."""
    cells = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("verdict", "host", "path"), rule, strict=True)]) for rule in rules]
    none = F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.explode(F.array(*cells) if cells else none).alias("r")).select("r.*")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Give every page the verdict of the longest rule that fits it.

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains where
    the path starts with the rule's path. Candidate keys are cut from each URL in the
    shapes that the rules have (labels of host, length of path), so a page makes at most
    one key a shape. Each distinct host and path is judged once, and the verdict goes back
    to its pages by a join that spreads pairs with many pages, null URLs among them. Returns the identifier, host, path, rule (``host`` + ``path``, null
    if none fits) and verdict (``default`` if none fits), one row for each page.

    Defined cases: a null URL or one without ``://`` has empty host and path and no rule;
    rules of one length tie to the greater rule string, equal rules to the greater
    verdict; repeated pages each get a row; an empty rule table leaves the default.
    """
    rule = F.concat("host", "path")
    listed = rules.filter("host is not null and path is not null").groupBy(rule.alias("__key")).agg(F.max("verdict").alias("verdict"), F.max(F.size(F.split("host", r"\."))).alias("__labels"), F.max(F.length("path")).alias("__length"))
    # all shapes in one row: label counts and path lengths are bounded by the length of a URL
    shapes = listed.groupBy("__labels", "__length").agg(F.lit(1)).agg(F.collect_list(F.struct(F.col("__labels").alias("labels"), F.col("__length").alias("length"))).alias("__shapes"))
    rows = pages.select(F.col(id_col).alias("__id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.size(F.split("host", r"\."))
    fits = F.filter("__shapes", lambda s: (labels >= s["labels"]) & (F.length("path") >= s["length"]) & (F.col("host") != ""))
    keys = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["length"])))
    pairs = rows.groupBy("host", "path").agg(F.count("*").alias("__n"))
    cut = pairs.filter("host <> ''").join(F.broadcast(shapes)).select("host", "path", F.explode(keys).alias("__url_key"))
    hits = possible_hits(cut, "__url_key", listed, "__key", listed.count())
    best = (
        hits.join(listed, hits["__url_key"] == listed["__key"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("__key").alias("length"), F.col("__key").alias("rule"), F.col("verdict"))).alias("__best"))
    )
    # pairs without a hit stay in the list, so that much-repeated ones are known and spread like the others
    judged = stored(pairs.join(best, ["host", "path"], "left").select("host", "path", "__n", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict")), "verdicts")
    total = judged.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return spread_join(rows, judged, ["host", "path"], "__n", total).select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict")
