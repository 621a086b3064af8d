"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between two values.
Its integral up to t, times the source's target, is the source's cumulative demand for
words at t. Documents of a source lie one after another, in a seeded order, on the axis
of its cumulative words; inverting the demand at a document's midpoint gives its
position in training. Positions sort all documents by range.

The order inside a source comes from a hash. Running totals are taken per slice of the
hash range and added up over slices, so a source with a third of all rows is spread over
all tasks; slices grow in number with the rows. Rows of an identifier that fills a slice
by itself (a null one, say) are cut further, by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import WORD

#: Slices of the hash range within a source, at least, and rows of a table for each slice
#: beyond that. Slices change no position.
SLICES, SLICE_ROWS = 256, 1 << 16
SEED = 8
#: Identifiers of a source that are cut further, at most.
HOT_KEYS = 1 << 14
#: Slices of all sources that are broadcast, at most; 40 bytes each.
BROADCAST_ROWS = 1 << 18
BASE_WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: Schedule of a source by its place in the list: weight at the start and at the end,
#: relative to the base weight. Each pair averages one, so targets hold for any schedule.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(place: Column, values: tuple) -> Column:
    out = F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        out = F.when(place % len(values) == k, F.lit(v)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple = BASE_WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source: __source, source_size, __place, __weight and target.

    Targets share ``share`` of all words by weight; none exceeds ``max_epochs`` times its
    source, and what is cut is shared again. With sources by rising size / weight, those
    that are cut come first, so one running sum finds the level at which the rest meet
    the budget. Only rows of one a source go through the unpartitioned windows.
    """
    per = sizes.groupBy("__source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("__place", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    per = per.withColumn("__weight", _cycle(F.col("__place"), weights)).withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = Window.partitionBy()
    rising = Window.orderBy((F.col("__cap") / F.col("__weight")).asc(), F.col("__place"))
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    budget = F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("__cap").over(every))
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(after)
    per = per.withColumn("__budget", budget).withColumn("__level", level)
    # the first source whose cap is not reached fixes the level of all that follow
    free = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__weight"), F.struct((F.col("__cap") / F.col("__weight")).alias("ratio"), F.col("__place"), F.col("__level").alias("level")))).over(every)
    target = F.when(free.isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), free["level"] * F.col("__weight")))
    return per.withColumn("target", target).select("__source", "source_size", "__place", "__weight", "target")


def _invert(share: Column, start: Column, end: Column) -> Column:
    """Time t at which the integral of a weight, linear from ``start`` to ``end``, is ``share`` of its whole."""
    area = (start + end) / 2 * share
    slope = end - start
    root = (F.sqrt(F.greatest(start * start + 2 * slope * area, F.lit(0.0))) - start) / slope
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(slope == 0, share).otherwise(root)))


def _cut_hot(rows: DataFrame, most: int, n_rows: int) -> DataFrame:
    """``rows`` with __rank and __sub, which cut a slice without changing its order.

    An identifier with more than ``most`` rows in a source (HOT_KEYS at most) has a rank of
    its own, odd, between those of the hashes before and after it, and within it 256 parts
    by the first byte of the text's hash. All other rows of a slice without one are one part.
    """
    plain = {"__rank": F.lit(0), "__sub": F.lit(0).cast("long")}
    if n_rows <= most:
        return rows.withColumns(plain)
    # reads identifiers and sources alone; a slice has this many rows only by such an identifier or by chance
    crowded = rows.groupBy("__source", "__slice").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("__source").alias("__s"), F.col("__slice").alias("__k"))
    if crowded.isEmpty():
        return rows.withColumns(plain)
    met = [rows["__source"].eqNullSafe(F.col("__s")), rows["__slice"] == F.col("__k")]
    by_hash = rows.join(F.broadcast(crowded), met, "left_semi").groupBy("__source", "__slice", "__hash").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = by_hash.groupBy(F.col("__source").alias("__s"), F.col("__slice").alias("__k")).agg(F.sort_array(F.collect_list("__hash")).alias("__hots"))
    held = rows.join(F.broadcast(hot), met, "left").withColumn("__hots", F.coalesce("__hots", F.array().cast("array<bigint>")))
    own = F.array_contains("__hots", F.col("__hash"))
    rank = F.size(F.filter("__hots", lambda h: h < F.col("__hash"))) * 2 + own.cast("int")
    return held.withColumns({"__rank": rank, "__sub": F.when(own, F.shiftright("__text", 56)).otherwise(F.lit(0).cast("long"))}).drop("__s", "__k", "__hots")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = BASE_WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    ramps: tuple = RAMPS,
    slices: int | None = None,
    slice_rows: int = SLICE_ROWS,
    keep: tuple = (),
) -> DataFrame:
    """Assign training positions to every document.

    Returns the identifier, size (words), source_size, target, taken (words, repeats
    counted), with ``keep`` a struct ``kept`` of the columns named there, and positions: one position in 0..1 for each
    time the document is taken, at most ``max_epochs``. A document is taken in a pass if
    its midpoint on the axis of its source's words, passes laid end to end, lies below
    the target; so a source's words differ from its target by half a document at most.

    Defined cases: a null text has size 0 and, as a text without words does, is taken
    zero words; a null source is a source, listed last; documents of equal hash are
    ordered by identifier, those of one identifier by a hash of their text; repeated rows
    count each; columns may have any names; an empty table gives no rows; a table without
    words has targets of 0.
    """
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("__text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__kept")] if keep else []),
    )
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(SEED), F.col("__id").cast("string")))
    n_rows = docs.count()
    if slices is None:
        slices = SLICES
        while slices < min(n_rows // slice_rows, 1 << 24):
            slices *= 2
    rows = rows.withColumn("__slice", F.floor((F.shiftrightunsigned("__hash", 40)) * F.lit(slices) / F.lit(1 << 24)).cast("int"))
    rows = _cut_hot(rows, max(slice_rows, n_rows // HOT_KEYS), n_rows)
    cut = ["__slice", "__rank", "__sub"]
    totals = rows.groupBy("__source", *cut).agg(F.sum("size").alias("size"))
    targets = source_targets(totals, weights, share, max_epochs)
    # one row a slice, and a few hundred a hot identifier
    order = Window.partitionBy("__source").orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__source", *cut, F.coalesce(F.sum("size").over(order), F.lit(0)).alias("__offset"))
    # sent to all tasks while few, joined by shuffle beyond that
    facts = offsets.join(targets, offsets["__source"].eqNullSafe(targets["__source"])).select(
        offsets["__source"].alias("__s"), *[F.col(c).alias(f"{c}_of") for c in cut], "__offset", "source_size", "__place", "target"
    )
    if facts.count() <= BROADCAST_ROWS:
        facts = F.broadcast(facts)
    within = Window.partitionBy("__source", *cut).orderBy("__hash", F.col("__id").cast("string"), "__text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(facts, [placed["__source"].eqNullSafe(F.col("__s")), *[F.col(c) == F.col(f"{c}_of") for c in cut]])
    middle = F.col("__offset") + F.col("__before") + F.col("size") / 2
    start, end = _cycle(F.col("__place"), tuple(r[0] for r in ramps)), _cycle(F.col("__place"), tuple(r[1] for r in ramps))
    passes = []
    for k in range(max_epochs):
        at = F.lit(float(k)) * F.col("source_size") + middle
        passes.append(F.when((F.col("size") > 0) & (at < F.col("target")), _invert(at / F.col("target"), start, end)))
    return placed.withColumn("positions", F.array_compact(F.array(*passes))).select(
        F.col("__id").alias(id_col),
        *([F.col("__kept").alias("kept")] if keep else []),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("positions")).alias("taken"),
        "positions",
    )


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each time a document is taken, sorted by position over all partitions."""
    taken = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return taken.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)
