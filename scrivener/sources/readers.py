"""Typed readers. Schemas are declared, never inferred; delimited text comes in as strings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scrivener.functions import text as T

PAIR_COLUMNS = ("id", "text", "source_text", "instructions")
SEGMENT_COLUMNS = ("essay_id_comp", "discourse_id", "discourse_start", "discourse_end", "discourse_type", "discourse_text", "prompt_name", "grade_level", "ell_status", "task")


def strings(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A delimited file with a header and quoted line breaks; every column a string, never null: a value that is blank, or that a short row lacks, is blank.

    A file is one task, as line breaks may be quoted; a folder of files is as many.
    """
    rows = spark.read.schema(strings(columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def with_row_index(rows: DataFrame) -> DataFrame:
    """``rows`` with row_index from 0 in file order: the place in its partition and the rows of the partitions before it.

    Counts come from a first pass that reads no column; no row leaves the JVM, and the
    counts are one row a partition.
    """
    marked = rows.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__n"))
    offsets = sizes.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    index = F.col("__offset") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    joined = marked.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], index.alias("row_index"))


def dealt_out(rows: DataFrame, pieces_a_core: int = 4) -> DataFrame:
    """``rows`` over all cores where a table comes in fewer pieces than they need; as it is where it comes in many."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < pieces_a_core * cores else rows


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Paired texts as (row_index, pair_id, human_text, ai_text, instructions); a blank id becomes ``row-<index>``."""
    rows = with_row_index(read_strings(spark, path, PAIR_COLUMNS))
    ident = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.concat(F.lit("row-"), F.col("row_index").cast("string"))).otherwise(F.col("id"))
    return rows.select("row_index", ident.alias("pair_id"), F.col("text").alias("human_text"), F.col("source_text").alias("ai_text"), "instructions")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` if no key repeats, else an error that names some of those that do."""
    repeated = rows.groupBy(key).count().filter("count > 1").orderBy(key).limit(10).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {[r[key] for r in repeated]}")
    return rows


def require_matches(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted rows; an error that lists up to ten keys without a row, or if a key has several."""
    missing = wanted.select(key).distinct().join(rows, key, "left_anti").orderBy(key).limit(10).collect()
    if missing:
        raise ValueError(f"no rows for {[r[key] for r in missing]}")
    return require_unique(rows.join(wanted.select(key).distinct(), key, "left_semi"), key)


def rows_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (row_index, id) with the row found there, and why it does not serve: raw_row_not_found, raw_id_mismatch."""
    found = rows.select("row_index", F.col("id").alias("found_id"), *[c for c in rows.columns if c not in ("row_index", "id")])
    joined = wanted.join(found, "row_index", "left")
    return joined.withColumn("reason", F.when(F.col("found_id").isNull(), "raw_row_not_found").when(F.col("found_id") != F.col("id"), "raw_id_mismatch"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return with_row_index(read_strings(spark, path, SEGMENT_COLUMNS))


def nest_segments(rows: DataFrame, key: str = "essay_id_comp", attributes: tuple[str, ...] = ("prompt_name", "grade_level", "ell_status", "task")) -> DataFrame:
    """One row an essay: attributes of its first row, and its segments in offset order. Rows with a blank key are left out."""
    span = F.struct(T.lenient_int(F.col("discourse_start")).alias("start"), T.lenient_int(F.col("discourse_end")).alias("end"), F.col("discourse_id").alias("id"), F.col("discourse_type").alias("type"), F.col("discourse_text").alias("text"))
    kept = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return kept.groupBy(key).agg(*[F.min_by(a, "row_index").alias(a) for a in attributes], F.count("*").alias("n_segments"), F.array_sort(F.collect_list(span)).alias("segments"))


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key in file order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("row_index"))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a line, split over tasks; one that is no JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    from scrivener.operators.model import PARAMETER_SCHEMA, load_parameters

    params = spark.read.schema(PARAMETER_SCHEMA).parquet(path)
    load_parameters(params)
    return params


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata row of a written model; of one that is not there, that it is not and the features it would take."""
    from scrivener.operators.features import FEATURES

    try:
        return spark.read.json(f"{path}/metadata").withColumn("artifact_available", F.lit(True))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.range(1).select(F.lit(False).alias("artifact_available"), F.array(*map(F.lit, FEATURES)).alias("feature_order"))


def table_digest(rows: DataFrame) -> DataFrame:
    """One row (n, digest) that no order of rows changes: equal before and after a run that left the table alone."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).alias("digest"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file: equal before and after a run if the input was left alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
