"""Scoring of documents that arrive as a stream.

Scoring keeps no state: each micro-batch is analysed as a batch is, and written with its
batch number, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivener.operators.model import Detector

REQUEST_SCHEMA = "doc_id bigint, text string"


def requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON requests, one a line; those without a text are left for ``rejected``."""
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def score_stream(incoming: DataFrame, detector: Detector, out_path: str, checkpoint: str) -> StreamingQuery:
    """Analyse every micro-batch into ``out_path``, partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        found = detector(batch.filter("text is not null"))
        found.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        rejected = batch.filter("text is null").select("doc_id", F.lit("text_missing").alias("reason"))
        rejected.write.mode("overwrite").parquet(f"{out_path}_rejected/batch={number}")

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
