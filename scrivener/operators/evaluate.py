"""Evaluation of scored rows (label, p, predicted; predicted null where the model abstained)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.functions.stats import confusion, ratio, scores_of


def metrics(rows: DataFrame, *keys: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and the scores they give, overall or by key."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count(predicted).alias("classified"), *confusion(F.col(label), F.col(predicted)))
    found = scores_of(*(F.col(c) for c in ("tn", "fp", "fn", "tp")))
    return counts.select(*keys, "total", "classified", ratio(F.col("classified"), F.col("total")).alias("coverage"), "tn", "fp", "fn", "tp", *[v.alias(k) for k, v in found.items()])


#: Slices of a value's range on either side of zero; running sums are made within a slice, then over slices.
SLICES = 1 << 12


def _slice(value: Column, width: float) -> Column:
    """The slice of a value: it rises with the value and needs no other row; values beyond all slices are in the outermost."""
    value = value.cast("double")
    at = F.greatest(F.lit(-SLICES), F.least(F.lit(SLICES), F.floor(value / width).cast("int")))
    return F.when(F.isnan(value), SLICES).otherwise(at)


def roc_auc(rows: DataFrame, *keys: str, label: str = "label", score: str = "p", width: float = 1 / 256) -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing their mean rank; null with one class only.

    Scores are counted first, so windows run over distinct scores instead of rows. Slices
    of ``width`` are ranked apart; what lies below a slice comes from one row a slice.
    """
    by = [F.col(k) for k in keys]
    points = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    points = points.withColumn("__slice", _slice(F.col(score), width))
    below = Window.partitionBy(*by, "__slice").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = points.withColumn("under", F.coalesce(F.sum("zeros").over(below), F.lit(0)))
    slices = ranked.groupBy(*keys, "__slice").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.sum(F.col("ones") * (F.col("under") + F.col("zeros") / 2)).alias("inside"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("under", F.coalesce(F.sum("zeros").over(before), F.lit(0)))
    sums = slices.groupBy(*keys).agg(F.sum("ones").alias("n1"), F.sum("zeros").alias("n0"), F.sum(F.col("inside") + F.col("ones") * F.col("under")).alias("u"))
    return sums.select(*keys, "n1", "n0", ratio(F.col("u"), F.col("n1") * F.col("n0")).alias("roc_auc"))


def binned(rows: DataFrame, bin_col: str) -> DataFrame:
    """Metrics and area by bin; bins without rows are absent."""
    return metrics(rows, bin_col).join(roc_auc(rows, bin_col), bin_col, "left")


def group_audit(rows: DataFrame, group: str, p: str = "p", predicted: str = "predicted") -> DataFrame:
    """Per group: coverage, flagged, false-positive rate among classified rows, and the signal's middle and tails."""
    q = lambda x: F.percentile(p, F.lit(x))
    out = rows.groupBy(group).agg(F.count("*").alias("sample"), F.count(predicted).alias("classified"), F.count_if(F.col(predicted) == 1).alias("flagged"), F.avg(p).alias("signal_mean"), F.median(p).alias("signal_median"), q(0.1).alias("signal_p10"), q(0.9).alias("signal_p90"))
    return out.select(group, "sample", "classified", (F.col("sample") - F.col("classified")).alias("abstained"), ratio(F.col("classified"), F.col("sample")).alias("coverage"), "flagged", ratio(F.col("flagged"), F.col("classified")).alias("false_positive_rate"), "signal_mean", "signal_median", "signal_p10", "signal_p90")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """By probability bin: rows, mean probability, share of ones and the bin's part of Brier and expected calibration error."""
    known = rows.filter(F.col("p").isNotNull())
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    y = F.col("label").cast("double")
    parts = known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(y).alias("share"), F.sum((F.col("p") - y) * (F.col("p") - y)).alias("squares"))
    whole = Window.partitionBy()
    n = F.sum("n").over(whole)
    return parts.select("bin", "n", "mean_p", "share", (F.col("squares") / n).alias("brier_part"), (F.abs(F.col("mean_p") - F.col("share")) * F.col("n") / n).alias("ece_part"))


def selective(rows: DataFrame, thresholds: tuple = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4)) -> DataFrame:
    """Coverage and accuracy when rows below each confidence margin abstain."""
    margin = F.abs(F.col("p") - 0.5)
    kept = rows.select("label", "predicted", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.coalesce(margin >= t, F.lit(False)))).alias("threshold"))
    sums = kept.groupBy("threshold").agg(F.count("*").alias("kept"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))
    total = rows.agg(F.count("*").alias("total"))
    return sums.join(F.broadcast(total)).select("threshold", "kept", ratio(F.col("kept"), F.col("total")).alias("coverage"), ratio(F.col("right"), F.col("kept")).alias("accuracy"))


def confident_failures(rows: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """The n wrong predictions farthest from one half."""
    wrong = rows.filter(F.col("predicted") != F.col("label")).withColumn("margin", F.abs(F.col("p") - 0.5))
    return wrong.orderBy(F.desc("margin"), id_col).limit(n)


def best_threshold(rows: DataFrame, value: str, label: str = "label", width: float = 1.0) -> DataFrame:
    """The threshold on one value (at or below it means class 1) with the best F1; ties to the smaller.

    Running sums go by slices of ``width``; the sums before a slice are a table of at most
    one row a slice.
    """
    points = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("ones"), F.count("*").alias("n"))
    points = points.withColumn("__slice", _slice(F.col("threshold"), width))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = points.groupBy(F.col("__slice").alias("__of")).agg(F.sum("ones").alias("__ones"), F.sum("n").alias("__n"))
    sums = sums.select("__of", earlier("__ones").alias("__ones_before"), earlier("__n").alias("__n_before"), F.sum("__ones").over(Window.partitionBy()).alias("positives"))
    upto = Window.partitionBy("__slice").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    ranked = points.join(F.broadcast(sums), F.col("__slice") == F.col("__of")).select("threshold", (F.sum("ones").over(upto) + F.col("__ones_before")).alias("tp"), (F.sum("n").over(upto) + F.col("__n_before")).alias("flagged"), "positives")
    scored = ranked.withColumn("f1", ratio(2 * F.col("tp"), F.col("flagged") + F.col("positives")))
    return scored.orderBy(F.desc("f1"), "threshold").limit(1)


def localization(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Flagged against known places of each group: precision, recall, overlap (shared over either), and the share of known ends that a flagged run has too.

    An end lies between two places of which one is known and one is not; the same for flags.
    """
    by = Window.partitionBy(group).orderBy(index)
    ends = lambda c: F.col(c) != F.lead(c).over(by)
    marked = rows.withColumns({"__known": F.coalesce(ends("known"), F.lit(False)), "__flag": F.coalesce(ends("flagged"), F.lit(False))})
    hit = F.count_if(F.col("flagged") & F.col("known"))
    return marked.groupBy(group).agg(
        ratio(hit, F.count_if("flagged")).alias("precision"), ratio(hit, F.count_if("known")).alias("recall"), ratio(hit, F.count_if(F.col("flagged") | F.col("known"))).alias("overlap"),
        ratio(F.count_if(F.col("__known") & F.col("__flag")), F.count_if("__known")).alias("boundary_accuracy"),
    )


def margins(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", F.abs(F.col("p") - 0.5)).withColumn("margin_bin", T.margin_bin(F.col("margin")))


def capture(flagged: Column, known: Column) -> Column:
    """Share of the known rows that are flagged; null without known rows."""
    return ratio(F.count_if(flagged & known), F.count_if(known))


def metric_deltas(new: DataFrame, old: DataFrame, names: tuple[str, ...], tolerance: float = 1e-12) -> DataFrame:
    """(metric, delta, reproduced) of two one-row metric tables; null equals null."""
    a = new.select(*[F.col(n).cast("double").alias(f"a_{n}") for n in names])
    b = old.select(*[F.col(n).cast("double").alias(f"b_{n}") for n in names])
    cells = [F.struct(F.lit(n).alias("metric"), (F.col(f"a_{n}") - F.col(f"b_{n}")).alias("delta"), F.coalesce(F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) <= tolerance, F.col(f"a_{n}").isNull() & F.col(f"b_{n}").isNull()).alias("reproduced")) for n in names]
    return a.join(F.broadcast(b)).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def repeated(rows: DataFrame, key: str, seeds: tuple[int, ...]) -> DataFrame:
    """Accuracy over a seeded half of the rows, once a seed, and its mean and deviation over seeds."""
    half = F.filter(F.array(*map(F.lit, seeds)), lambda s: F.substring(F.md5(F.concat(s.cast("string"), F.lit("|"), F.col(key).cast("string"))), 1, 1) < "8")
    each = rows.select("label", "predicted", F.explode(half).alias("seed")).groupBy("seed").agg(ratio(F.count_if(F.col("label") == F.col("predicted")), F.count("predicted")).alias("accuracy"))
    return each.agg(F.count("*").alias("runs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("sd_accuracy"))


def group_out(rows: DataFrame, group: str, value: str, label: str = "label") -> DataFrame:
    """Each group judged by what the others teach: the middle between the class means of all other groups.

    Sums of the others are the whole's less the group's own, so rows are read once however
    many groups there are. Threshold and accuracy are null where the others lack a class.
    """
    known = rows.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    side = lambda y: F.when(F.col(label) == y, F.col(value).cast("double"))
    sums = [f(side(y)).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("s", F.sum))]
    own = known.groupBy(F.col(group).alias("__group")).agg(*sums)
    whole = known.agg(*[s.alias(f"w_{k}") for s, k in zip(sums, ("n0", "s0", "n1", "s1"), strict=True)])
    rest = lambda y: ratio(F.col(f"w_s{y}") - F.coalesce(f"s{y}", F.lit(0.0)), F.col(f"w_n{y}") - F.col(f"n{y}"))
    taught = own.join(F.broadcast(whole)).select("__group", (F.col("w_n0") + F.col("w_n1") - F.col("n0") - F.col("n1")).alias("n_train"), ((rest(0) + rest(1)) / 2).alias("threshold"), (rest(1) >= rest(0)).alias("__rises"))
    joined = known.join(taught, F.col(group).eqNullSafe(F.col("__group")))
    right = F.when(F.col("__rises"), F.col(value) > F.col("threshold")).otherwise(F.col(value) < F.col("threshold")) == (F.col(label) == 1)
    return joined.groupBy(group, "n_train", "threshold").agg(F.count("*").alias("n_test"), ratio(F.count_if(right), F.count(right)).alias("accuracy"))


def learned_share(rows: DataFrame, fields: tuple[str, ...], key: str, seed: int, label: str = "label") -> DataFrame:
    """(fields, label, p) of the half of the rows that is not learned from: p is the smoothed share of ones in its cell of ``fields``, one half for an unseen cell.

    What no text goes into should not tell the classes apart; an area far from one half is leakage.
    """
    taught = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 1) < "8"
    marked = rows.withColumn("__taught", taught)
    cells = marked.filter("__taught").groupBy(*[F.col(f).alias(f"__{f}") for f in fields]).agg(ratio(F.count_if(F.col(label) == 1) + 1, F.count("*") + 2).alias("p"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return marked.filter("not __taught").drop("p").join(cells, same, "left").select(*fields, label, F.coalesce("p", F.lit(0.5)).alias("p"))


def permuted_labels(rows: DataFrame, key: str, seed: int, label: str = "label", digits: int = 1) -> DataFrame:
    """``rows`` with each label moved to the row before it in seeded order, round within every part of the hash range.

    Every part keeps its labels, so the classes keep their sizes. ``digits`` hexadecimal
    digits make 16 parts each; a part with one row keeps its label, so take few for small tables.
    """
    marked = rows.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    part = Window.partitionBy(F.substring("__hash", 1, digits))
    order = part.orderBy("__hash", key)
    return marked.withColumn(label, F.coalesce(F.lead(label).over(order), F.first(label).over(order))).drop("__hash")
