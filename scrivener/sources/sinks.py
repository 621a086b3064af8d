"""Writers of results: tables as Parquet, predictions as delimited text, reports as JSON or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def write_predictions(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Delimited text with a header and the columns in this order; null becomes empty.

    Quotes are doubled, and white space at the ends of a value is kept, so ``readers.read_strings`` gets the values back.
    """
    kept = {"header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*columns).write.options(**kept).csv(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One folder of text for each key."""
    rows.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def manifest(ids: DataFrame, key: str, seed: int, digest: str) -> DataFrame:
    """One row that freezes a selection: seed, size, input digest and the sorted identifiers."""
    return ids.agg(F.lit(seed).alias("seed"), F.count("*").alias("n"), F.lit(digest).alias("dataset_sha256"), F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("selected_ids"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """The column ``line`` as text in files whose names sort in this order, sorted by range over all tasks."""
    lines.orderBy(*order).select(F.col("line").alias("value")).write.text(path)


def write_model(params: DataFrame, path: str, metadata: DataFrame) -> None:
    """The parameter table, and one row of metadata as JSON, under one folder."""
    params.write.mode("errorifexists").parquet(f"{path}/parameters")
    metadata.limit(1).coalesce(1).write.mode("errorifexists").json(f"{path}/metadata")


def markdown(counts: DataFrame, title: str, limit: int = 50) -> str:
    """A small table of (value, n) rows as Markdown; ``(none)`` if there are none."""
    rows = counts.limit(limit).collect()
    lines = [f"| {r[0]} | {r[1]:,} |" for r in rows] or ["(none)"]
    return "\n".join([f"## {title}", "", *lines, ""])
