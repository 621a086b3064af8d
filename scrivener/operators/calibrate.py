"""Recalibration: maps of a probability to a better one, learned on some scored rows for others."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before a logarithm.
EDGE = 1e-9
#: Steps of p whose rows are one weighted point of the isotonic fit, which Spark finishes on the driver.
STEPS = 1000


def _logit(p: Column) -> Column:
    inside = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.when(p.isNotNull(), F.ln(inside / (1 - inside)))


def platt(learn: DataFrame, rows: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """``rows`` with p mapped by a logistic curve over its logit, fitted without a penalty; rows without p keep none."""
    known = learn.filter(F.col(p).isNotNull() & F.col(label).isNotNull())
    points = known.select(F.col(label).cast("double").alias("label"), _logit(F.col(p)).alias("x"))
    fitted = LogisticRegression(regParam=0.0, tol=1e-10, maxIter=200).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(points))
    return rows.withColumn(p, 1 / (1 + F.exp(-(F.lit(float(fitted.coefficients[0])) * _logit(F.col(p)) + float(fitted.intercept)))))


def isotonic(learn: DataFrame, rows: DataFrame, label: str = "label", p: str = "p", steps: int = STEPS) -> DataFrame:
    """``rows`` with p mapped by the rising step curve of least squares, linear between its points; rows without p keep none.

    All rows that learn are counted, by step of p; what reaches the driver is at most one
    point a step.
    """
    known = learn.filter(F.col(p).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(F.floor(F.col(p) * steps).alias("step")).agg(F.avg(p).alias("x"), F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    fitted = IsotonicRegression(featuresCol="x", weightCol="weight").fit(points)
    mapped = fitted.setFeaturesCol("__x").setPredictionCol("__p").transform(rows.withColumn("__x", F.coalesce(F.col(p), F.lit(0.0))))
    return mapped.withColumn(p, F.when(F.col(p).isNotNull(), F.col("__p"))).drop("__x", "__p")
