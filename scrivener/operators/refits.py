"""Many logistic fits at once: one model for every group left out, or for every seed of a resampling.

All models share the rows. A step of Newton's method needs of each model a gradient and a
Gram matrix, which are sums over rows; a task forms those of all models for its rows by
matrix products, and one aggregate a step adds them up. Means and deviations come from the
sums of each group's own rows: what a model without a group sees is the whole less that.

Models are at most MAX_MODELS a run, as each row is weighed for each of them; the numbers
that reach the driver are models times squared features, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.stats import ratio
from scrivener.sources.scratch import stored

MAX_MODELS = 1 << 12
#: Steps of Newton's method, and the largest change of a coefficient at which it has ended.
STEPS, SETTLED = 50, 1e-11
#: Upper ends of the cumulative Poisson(1) distribution: how often a group is drawn for a seed.
POISSON = tuple(float(x) for x in np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])))


@dataclass
class Fits:
    """Of each model: its key, rows (by weight), means, deviations, coefficients (per deviation) and intercept."""

    keys: list
    n: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: np.ndarray
    features: tuple[str, ...]

    def frame(self, spark, key: str, kind: str) -> DataFrame:
        """A row a model: the key, n, and ``weights`` and ``constant`` that apply to unscaled features."""
        weights = self.coefficients / self.scale
        constant = self.intercept - (weights * self.mean).sum(axis=1)
        rows = [(k, float(n), w.tolist(), float(c)) for k, n, w, c in zip(self.keys, self.n, weights, constant, strict=True)]
        return spark.createDataFrame(rows, f"`{key}` {kind}, n_train double, weights array<double>, constant double")


def left_out(group: Column, groups: list) -> Column:
    """Weights of a row for models that each leave one group out: 0 for its own, 1 for all others."""
    return F.transform(F.array(*map(F.lit, groups)), lambda g: F.when(g.eqNullSafe(group), 0.0).otherwise(1.0))


def drawn(seeds: tuple[int, ...], key: Column) -> Column:
    """Weights of a row for models of seeded resamplings: how often its key is drawn, by a Poisson distribution of mean one."""
    at = lambda s: F.conv(F.substring(F.md5(F.concat(s.cast("string"), F.lit("|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.transform(F.array(*map(F.lit, seeds)), lambda s: F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0.0), lambda n, edge: n + F.when(at(s) >= edge, 1.0).otherwise(0.0)))


def _sums(models: int, width: int, state: np.ndarray | None):
    """Batches (x, y, w) to one row: the sums of all models over the partition.

    Without a state, the weights' sums of 1, x and x^2; with one (coefficients, then the
    constant, a row a model), those of the gradient and of the upper half of the Gram matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            y = batch.column(1).to_numpy()
            w = batch.column(2).flatten().to_numpy().reshape(-1, models)
            one = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            if state is None:
                part = np.concatenate((w.T @ one, w.T @ (x * x)), axis=1)
            else:
                p = 1 / (1 + np.exp(-np.clip(one @ state.T, -700, 700)))
                gradient = (w * (p - y[:, None])).T @ one
                curve = w * p * (1 - p)
                i, j = np.triu_indices(width + 1)
                part = np.concatenate((gradient, curve.T @ (one[:, i] * one[:, j])), axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    return run


def _added(rows: DataFrame, models: int, width: int, state: np.ndarray | None) -> np.ndarray:
    parts = rows.mapInArrow(_sums(models, width, state), "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(len(cells))
    for r in cells:
        found[r["at"]] = r["v"]
    return found.reshape(models, -1)


def fit_all(rows: DataFrame, keys: list, weights: Column, features: tuple[str, ...], label: str = "label", penalty: float = 1.0) -> Fits:
    """A logistic model for each key, on rows weighed by the array ``weights`` (one a key).

    Features are standardised by the weighed mean and population deviation of the model's
    own rows, and coefficients, but not the intercept, have an L2 penalty. Rows that lack a
    feature or the label are left out. A model whose rows have one class only, or none, has
    not-a-number coefficients.
    """
    if not 0 < len(keys) <= MAX_MODELS:
        raise ValueError(f"{len(keys)} models; between 1 and {MAX_MODELS} can be fitted together")
    width, models = len(features), len(keys)
    known = rows.dropna(subset=[*features, label])
    spread = known.select(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)], F.count("*").alias("n")).first()
    if not spread["n"]:
        return Fits(keys, np.zeros(models), np.zeros((models, width)), np.ones((models, width)), np.full((models, width), np.nan), np.full(models, np.nan), features)
    shift, unit = np.array([spread[f"m{k}"] for k in range(width)]), np.array([spread[f"s{k}"] or 1.0 for k in range(width)])
    # one scale for all models keeps the sums well conditioned; each model's own is applied to them
    x = F.array(*[(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(features, shift, unit, strict=True)])
    ready = stored(known.select(x.alias("x"), F.col(label).cast("double").alias("y"), weights.alias("w")), "refit")
    moments = _added(ready, models, width, None)
    n = moments[:, width]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = moments[:, :width] / n[:, None]
        scale = np.sqrt(np.maximum(moments[:, width + 1 :] / n[:, None] - mean**2, 0.0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    beta = np.zeros((models, width + 1))
    open_ = n > 0
    for _ in range(STEPS):
        inside = beta[:, :width] / scale
        state = np.concatenate((inside, (beta[:, width] - (inside * np.nan_to_num(mean)).sum(axis=1))[:, None]), axis=1)
        sums = _added(ready, models, width, state)
        step = np.zeros_like(beta)
        for m in np.flatnonzero(open_):
            gradient, gram = sums[m, : width + 1], np.zeros((width + 1, width + 1))
            gram[np.triu_indices(width + 1)] = sums[m, width + 1 :]
            gram = gram + np.triu(gram, 1).T
            # from the shared scale to the model's own
            change = np.eye(width + 1)
            change[:width, :width] = np.diag(1 / scale[m])
            change[:width, width] = -mean[m] / scale[m]
            gradient, gram = change @ gradient, change @ gram @ change.T
            gradient[:width] += penalty * beta[m, :width]
            gram[:width, :width] += penalty * np.eye(width)
            step[m] = np.linalg.lstsq(gram, gradient, rcond=None)[0]
        # a class that is missing drives the intercept off without end
        beta = beta - np.clip(step, -8.0, 8.0)
        if np.abs(step).max() < SETTLED:
            break
    beta[~open_ | (np.abs(beta[:, width]) > 30)] = np.nan
    return Fits(keys, n, np.nan_to_num(mean) * unit + shift, scale * unit, beta[:, :width], beta[:, width], features)


def _p(features: tuple[str, ...]) -> Column:
    z = F.col("constant")
    for k, f in enumerate(features):
        z = z + F.get("weights", F.lit(k)) * F.col(f)
    return 1 / (1 + F.exp(-z))


def group_refits(rows: DataFrame, group: str, features: tuple[str, ...], label: str = "label") -> DataFrame:
    """Each group judged by a model fitted to all others: group, n_train, n_test, accuracy, and the model's weights and constant.

    Accuracy is null where the others have one class only. A null group is a group.
    """
    # measured once, as the groups, the fits and the verdicts all read it
    known = stored(rows.dropna(subset=[*features, label]).select(group, *features, label), "known")
    groups = [r[0] for r in known.select(group).distinct().orderBy(group).limit(MAX_MODELS + 1).collect()]
    kind = dict(rows.dtypes)[group]
    if not groups:
        return rows.sparkSession.createDataFrame([], f"`{group}` {kind}, n_train double, n_test bigint, accuracy double, weights array<double>, constant double")
    fits = fit_all(known, groups, left_out(F.col(group), groups), features, label).frame(rows.sparkSession, "__of", kind)
    joined = known.join(F.broadcast(fits), F.col(group).eqNullSafe(F.col("__of"))).withColumn("__p", _p(features))
    right = F.when(~F.isnan("__p"), (F.col("__p") > 0.5) == (F.col(label) == 1))
    return joined.groupBy(group, "n_train", "weights", "constant").agg(F.count("*").alias("n_test"), ratio(F.count_if(right), F.count(right)).alias("accuracy")).select(group, "n_train", "n_test", "accuracy", "weights", "constant")


def seed_refits(rows: DataFrame, key: str, seeds: tuple[int, ...], features: tuple[str, ...], label: str = "label") -> DataFrame:
    """A model for every seed on a resampling of the keys, judged by the keys that it did not draw: seed, n_train, n_test, accuracy, weights, constant.

    Rows of one key go together, so both halves of a pair are drawn or left out alike.
    """
    known = rows.dropna(subset=[*features, label])
    fits = fit_all(known, list(seeds), drawn(seeds, F.col(key)), features, label).frame(rows.sparkSession, "seed", "int")
    weights = F.posexplode(drawn(seeds, F.col(key)))
    held = known.select(*features, label, weights.alias("__at", "__times")).filter("__times = 0").withColumn("seed", F.get(F.array(*map(F.lit, seeds)), F.col("__at")))
    judged = held.join(F.broadcast(fits), "seed").withColumn("__p", _p(features))
    right = F.when(~F.isnan("__p"), (F.col("__p") > 0.5) == (F.col(label) == 1))
    return judged.groupBy("seed", "n_train", "weights", "constant").agg(F.count("*").alias("n_test"), ratio(F.count_if(right), F.count(right)).alias("accuracy")).select("seed", "n_train", "n_test", "accuracy", "weights", "constant")


def over_seeds(refits: DataFrame) -> DataFrame:
    """Runs, and the mean and deviation of their accuracy."""
    return refits.agg(F.count("accuracy").alias("runs"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("sd_accuracy"))
