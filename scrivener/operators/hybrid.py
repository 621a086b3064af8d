"""Spliced documents, local features, robust scores and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import finite, ratio, rounded
from scrivener.operators import features as X
from scrivener.operators.scoring import TextScorer

BANDS = {"top_50": 0.5, "top_25": 0.25, "top_10": 0.1}


def pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, human_text, ai_text): a user turn and the assistant turn that follows it."""
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("human_text"))
    reply = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai_text"))
    return user.join(reply, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), "human_text", "ai_text")


def usable(rows: DataFrame) -> DataFrame:
    """``rows`` with the reason why a pair cannot be used; a missing human text is named first."""
    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) == ""
    return rows.withColumn("reason", F.when(blank("human_text"), "missing_human_text").when(blank("ai_text"), "missing_ai_source_text"))


def unpivot(rows: DataFrame) -> DataFrame:
    """(pair_id, label, text): label 0 for the human text, 1 for the other."""
    both = F.array(F.struct(F.lit(0).alias("label"), F.col("human_text").alias("text")), F.struct(F.lit(1).alias("label"), F.col("ai_text").alias("text")))
    return rows.select("pair_id", F.explode(both).alias("x")).select("pair_id", "x.label", "x.text")


def spliced_documents(rows: DataFrame) -> DataFrame:
    """Two sentences from the middle of the second text inside the middle of the first: one row a pair.

    (pair_id, s, reason): s an array of (hybrid_index from 0, origin, text,
    source_human_index, source_ai_index), or why a pair is rejected.
    """
    cut = rows.select("pair_id", T.sentences(F.col("human_text")).alias("h"), T.sentences(F.col("ai_text")).alias("a"))
    reason = F.when(F.size("h") < 2, "insufficient_human_sentences_for_middle_insertion").when(F.size("a") < 3, "insufficient_ai_sentences_for_two_sentence_block")
    middle, start = F.floor(F.size("h") / 2).cast("int"), F.greatest(F.lit(0), F.floor(F.size("a") / 2).cast("int") - 1)
    row = lambda origin, text, human, ai: F.struct(F.lit(origin).alias("origin"), text.alias("text"), human.cast("int").alias("source_human_index"), ai.cast("int").alias("source_ai_index"))
    human = F.transform("h", lambda s, i: row("human", s, i, F.lit(None)))
    ai = F.transform("a", lambda s, i: row("ai_inserted", s, F.lit(None), i))
    joined = F.concat(F.slice(human, 1, middle), F.slice(ai, start + 1, 2), F.slice(human, middle + 1, F.size("h")))
    placed = F.transform(joined, lambda x, i: F.struct(i.alias("hybrid_index"), x["origin"].alias("origin"), x["text"].alias("text"), x["source_human_index"].alias("source_human_index"), x["source_ai_index"].alias("source_ai_index")))
    return cut.select("pair_id", F.when(reason.isNull(), placed).alias("s"), reason.alias("reason"))


def splice(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sentences of all spliced documents, a row each, and the rejected pairs with their reason."""
    found = spliced_documents(rows)
    return found.select("pair_id", F.inline("s")), found.filter("reason is not null").select("pair_id", "reason")


def documents_of(sentences: DataFrame) -> DataFrame:
    """Rows (pair_id, hybrid_index, text, ...) put together: (pair_id, s), s in order."""
    rest = [c for c in sentences.columns if c not in ("pair_id", "hybrid_index")]
    return sentences.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("hybrid_index", *rest))).alias("s"))


def clipped_window(i: Column, n: Column) -> tuple[Column, Column]:
    """First and last index of [i-1, i+1], cut at the ends."""
    return F.greatest(i - 1, F.lit(0)), F.least(i + 1, n - 1)


def shifted_window(i: Column, n: Column, width: int) -> tuple[Column, Column]:
    """First and last index of the window of min(width, n) sentences around i, moved inwards at the ends.

    Null where that size is even (above one), since no such window has a centre.
    """
    size = F.least(F.lit(width), n)
    first = F.greatest(F.lit(0), F.least(i - F.floor(size / 2).cast("int"), n - size))
    odd = (size % 2 == 1) | (n <= 1)
    return F.when(odd, first), F.when(odd, first + size - 1)


def _window(s: Column, i: Column, width: int | None) -> Column:
    """(width, window_first, window_last, window_text) of the sentence at a place."""
    n = F.size(s)
    first, last = clipped_window(i, n) if width is None else shifted_window(i, n, width)
    text = F.array_join(F.transform(F.slice(s, first + 1, last - first + 1), lambda x: x["text"]), " ")
    return F.struct(F.lit(width).cast("int").alias("width"), first.alias("window_first"), last.alias("window_last"), text.alias("window_text"))


def windows(documents: DataFrame, widths: tuple[int | None, ...] = (None,)) -> DataFrame:
    """Rows (pair_id, hybrid_index, origin, text, windows) of documents (pair_id, s): each sentence and its windows' texts; a width of None clips, a number shifts.

    All widths come from one pass over the document's array, and no sentence meets another by a join.
    """
    s = F.col("s")
    every = F.transform(s, lambda x, i: F.struct(x["hybrid_index"].alias("hybrid_index"), x["origin"].alias("origin"), x["text"].alias("text"), F.array(*[_window(s, i, w) for w in widths]).alias("windows")))
    return documents.select("pair_id", F.inline(every))


def local_features(documents: DataFrame, widths: tuple[int | None, ...] = (None,), corpus: DataFrame | X.LanguageModel | None = None, scorer: TextScorer | None = None) -> DataFrame:
    """A row a sentence and width of documents (pair_id, s): pair_id, hybrid_index, origin, width, window_first, window_last, length, and mattr and pos_3gram_entropy of the window with their reasons.

    With a corpus or a scorer also the perplexity of the sentence, which is scored once for
    all widths. Values are kept to nine decimals, so that windows of equal content have
    equal values and their deviations are zero instead of rounding errors. No row leaves
    its task.
    """
    rows = windows(documents, widths)
    known = ["pair_id", "hybrid_index", "origin"]
    if corpus is not None or scorer is not None:
        rows = X.with_median(X.with_sentences(rows, corpus, scorer=scorer)).withColumn("perplexity", rounded(F.col("perplexity"), 9))
        known.append("perplexity")
    length = T.count_matches(F.col("text"), T.COUNTED).cast("double").alias("length")
    rows = rows.select(*known, length, F.inline("windows")).withColumnRenamed("window_text", "text")
    rows = X.with_moving(rows)
    return rows.select(*known, "length", "width", "window_first", "window_last", rounded(F.col("mattr"), 9).alias("mattr"), "mattr_reason", rounded(F.col("pos_3gram_entropy"), 9).alias("pos_3gram_entropy"), "pos_reason")


def _middle(by: WindowSpec, place: Column, value: Column, others: Column) -> Column:
    """Median of a sorted group's other values, given this one's place (from 0): three places of the whole decide it."""
    low, high = F.floor((others - 1) / 2), F.floor(others / 2)
    at = [F.max(F.when(place == low + k, value)).over(by) for k in range(3)]
    # without the value at ``place`` all later ones move up by one
    pick = lambda p: F.when(p < place, F.when(p == low, at[0]).otherwise(at[1])).otherwise(F.when(p == low, at[1]).otherwise(at[2]))
    return F.when(others > 0, (pick(low) + pick(high)) / 2)


def robust_z_long(rows: DataFrame, group: str, index: str, name: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leave-one-out robust z of each value among those of its group and name: (group, index, name, z, z_reason) and the columns to keep.

    0.6745 (x - median) / MAD over all other finite values. Leaving one value out gives at
    most three different medians, so deviations are ranked once for each of them; medians
    are read off by rank. One exchange, by group, serves all names and all windows, and
    rows without a value go through the same pass: n log n a group.
    """
    x = finite(F.col(value).cast("double"))
    cells = rows.select(F.col(group).alias("g"), F.col(index).alias("i"), F.col(name).alias("c"), x.alias("x"), *keep).repartition("g")
    by = Window.partitionBy("g", "c")
    cells = cells.withColumn("k", F.row_number().over(by.orderBy(F.col("x").asc_nulls_last(), "i")) - 1).withColumn("n", F.count("x").over(by) - 1)
    known = F.col("x").isNotNull()
    cells = cells.withColumn("m", F.when(known, _middle(by, F.col("k"), F.col("x"), F.col("n"))))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    # which of the three medians a row has: it lies at or below the middle, between its halves, or above
    cells = cells.withColumn("j", F.when(F.col("k") <= low, 0).when(F.col("k") <= high, 1).otherwise(2))
    each = [F.max(F.when(F.col("j") == j, F.col("m"))).over(by) for j in range(3)]
    ranked = known & (F.col("n") > 0)
    # medians that no value of the group has are not needed; a row without a z goes on once, beside the others
    centres = F.filter(F.array(*[F.struct(F.lit(j).alias("v"), e.alias("centre")) for j, e in enumerate(each)]), lambda e: e["centre"].isNotNull())
    alone = F.array(F.struct(F.lit(-1).alias("v"), F.lit(None).cast("double").alias("centre")))
    spread = cells.withColumn("every", centres).select("g", "i", "c", "x", "n", "m", "j", *keep, F.inline(F.when(ranked, F.col("every")).otherwise(alone)))
    spread = spread.withColumn("d", F.abs(F.col("x") - F.col("centre")))
    one = Window.partitionBy("g", "c", "v")
    spread = spread.withColumn("p", F.row_number().over(one.orderBy("d", "i")) - 1)
    spread = spread.withColumn("mad", _middle(one, F.col("p"), F.col("d"), F.col("n"))).filter("v = j or v = -1")
    z = F.when(F.col("mad") != 0, 0.6745 * (F.col("x") - F.col("m")) / F.col("mad"))
    missing = F.when(F.col("x").isNull(), "current_value_unavailable").otherwise("no_reference_values")
    reason = F.when(F.col("v") == -1, missing).when(F.col("mad") == 0, "mad_zero")
    return spread.select(F.col("g").alias(group), F.col("i").alias(index), F.col("c").alias(name), F.when(F.col("v") >= 0, z).alias("z"), reason.alias("z_reason"), *keep)


def robust_z(rows: DataFrame, group: str, index: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leave-one-out robust z of one value: (group, index, z, z_reason) and the columns to keep."""
    return robust_z_long(rows.withColumn("__name", F.lit(value)), group, index, "__name", value, keep).drop("__name")


def anomaly_scores(rows: DataFrame, group: str, index: str, components: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute robust z over the components that have one: (group, index, z_<component>, reason_<component>, score, score_reason) and the columns to keep."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in components])
    long = robust_z_long(rows.select(group, index, *keep, F.inline(cells)), group, index, "name", "x", keep)
    one = lambda column, c: F.max(F.when(F.col("name") == c, F.col(column)))
    held = [F.first(k).alias(k) for k in keep]
    out = long.groupBy(group, index).agg(*[one("z", c).alias(f"z_{c}") for c in components], *[one("z_reason", c).alias(f"reason_{c}") for c in components], *held)
    return out.withColumn("score", mean_abs([F.col(f"z_{c}") for c in components])).withColumn("score_reason", F.when(F.col("score").isNull(), "no_available_component_z_scores"))


def mean_abs(zs: list[Column]) -> Column:
    """Mean of the absolute values that are there; null if none is."""
    total = sum((F.coalesce(F.abs(z), F.lit(0.0)) for z in zs), F.lit(0.0))
    return ratio(total, sum((z.isNotNull().cast("int") for z in zs), F.lit(0)))


def ranked(rows: DataFrame, group: str, index: str, score: str = "score", floor_one: bool = False) -> DataFrame:
    """``rows`` with rank (descending score, ties by index; null without score), n_ranked and the top bands."""
    by = Window.partitionBy(group)
    has = F.col(score).isNotNull()
    place = F.row_number().over(by.orderBy(F.col(score).desc_nulls_last(), index))
    out = rows.withColumn("n_ranked", F.count(score).over(by)).withColumn("rank", F.when(has, place))
    for name, share in BANDS.items():
        top = F.ceil(F.col("n_ranked") * share)
        top = F.greatest(F.lit(1), top) if floor_one else top
        out = out.withColumn(name, F.coalesce(F.col("rank") <= top, F.lit(False)))
    return out


def boundaries(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Adjacent sentences: boundary_index, origins, flags and the absolute change of each value, to nine decimals."""
    by = Window.partitionBy("pair_id").orderBy("hybrid_index")
    right = F.lead("origin").over(by)
    out = rows.select("pair_id", F.col("hybrid_index").alias("boundary_index"), F.col("origin").alias("left_origin"), right.alias("right_origin"), *[rounded(F.abs(F.lead(v).over(by) - F.col(v)), 9).alias(f"change_{v}") for v in values])
    out = out.filter("right_origin is not null")
    ai = lambda c: F.col(c) == "ai_inserted"
    return out.withColumns({
        "boundary_type": F.concat("left_origin", F.lit("__TO__"), "right_origin"), "target_boundary": ai("left_origin") != ai("right_origin"), "human_to_ai": ~ai("left_origin") & ai("right_origin"),
        "ai_to_human": ai("left_origin") & ~ai("right_origin"), "ai_internal": ai("left_origin") & ai("right_origin"), "human_internal": ~ai("left_origin") & ~ai("right_origin"),
    })


def capture_rates(rows: DataFrame, known: Column, group: str = "pair_id") -> DataFrame:
    """Pooled capture of the known rows by each band, and the mean of the per-document rates."""
    rates = [ratio(F.count_if(F.col(b) & known), F.count_if(known)) for b in BANDS]
    pooled = rows.agg(F.count("*").alias("rows"), F.count_if(known).alias("known"), *[r.alias(b) for r, b in zip(rates, BANDS, strict=True)])
    each = rows.groupBy(group).agg(*[r.alias(b) for r, b in zip(rates, BANDS, strict=True)])
    macro = each.agg(*[F.avg(b).alias(f"macro_{b}") for b in BANDS])
    return pooled.join(F.broadcast(macro))


def attribution(variants: DataFrame, p: Column) -> DataFrame:
    """(pair_id, left_out, contribution, reason, ...) of rows (pair_id, variants, ...): what the probability loses without a sentence.

    ``p`` is the probability as an expression over the features of a variant.
    """
    kept = [c for c in variants.columns if c != "variants"]
    rows = variants.select(*kept, F.get("variants", F.lit(0)).alias("__whole"), F.inline(F.slice("variants", 2, F.size("variants"))))
    rows = rows.withColumn("p_part", p)
    rows = rows.select(*kept, F.col("left_out").alias("__at"), "p_part", "__whole.*").withColumn("p_full", p)
    reason = F.when(F.col("p_full").isNull(), "full_document_not_classified").when(F.col("p_part").isNull(), "reduced_document_not_classified")
    return rows.select(*kept, F.col("__at").alias("left_out"), (F.col("p_full") - F.col("p_part")).alias("contribution"), reason.alias("reason"))
