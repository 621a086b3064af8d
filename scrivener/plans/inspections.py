"""Registered queries of inspection: profiles, reports, delimited text and JSON written and read again, samples and a repeated run, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.operators import evaluate as E
from scrivener.operators import features as X
from scrivener.operators import inspection as I
from scrivener.operators import profile as P
from scrivener.plans import oracles as O
from scrivener.plans.queries import _docs, _features, _six, pilot_round_robin, table
from scrivener.sources import readers, sinks
from scrivener.sources.scratch import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Characters of a segment, rows of a preview and of a sample in each group.
WIDTH, PREVIEW, REQUESTED = 200, 30, 25
DOCUMENT = ("doc_id", "lang", "source", "text")
#: Words beyond which the repeated run predicts class 1.
LONG = 120


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def _profile(spark, d):
    return I.table_profile(table(spark, d, "documents"), "doc_id", "text", "lang", "source")


@register
def table_profile(spark, d):
    """Rows, types by the first 200 rows, labels, keys and lengths of the documents."""
    return _profile(spark, d)


@register
def profile_report(spark, d):
    """The same as lines of a report."""
    return I.report_lines(_profile(spark, d))


@register
def last_by_key(spark, d):
    """The last document of every source."""
    rows = I.table_by_key(table(spark, d, "documents"), "source", "doc_id")
    return rows.select("source", "doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@register
def feature_by_name(spark, d):
    """Two features read from the array by their names, and one that no document has."""
    found = _features(spark, d).transform(X.feature_array)
    names = {"mattr": "mattr", "cv": "sentence_length_cv", "absent": "burstiness"}
    return _six(found.select(F.col("id").alias("doc_id"), *[I.feature_value(F.col("features"), name).alias(c) for c, name in names.items()]))


@register
def label_codes(spark, d):
    """Codes of label names; a document without a label abstains."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ai_associated").when(F.col("quality") == 0, "human_associated").alias("name"))
    rows = _docs(spark, d).select("doc_id").join(labels, "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("abstained")))
    return rows.select("doc_id", "name", I.label_code(F.col("name")).alias("code"))


@register
def sample_shortfall(spark, d):
    """What a sample of 25 documents a source would take, and why it falls short."""
    return I.sample_report(_docs(spark, d), "source", REQUESTED)


@register
def document_preview(spark, d):
    """The first 30 documents, their texts on one line."""
    return I.preview(_docs(spark, d), "doc_id", PREVIEW, "text").select(*DOCUMENT)


@register
def pilot_report(spark, d):
    """Lines of the manifest of a selected pilot."""
    docs = _docs(spark, d).withColumn("words", T.word_count(F.col("text")))
    # numbers eight rows
    chosen = pilot_round_robin(spark, d).select("doc_id", "score", F.row_number().over(Window.orderBy("turn", "source")).alias("number"))
    rows = docs.join(F.broadcast(chosen), "doc_id")
    fields = {
        "document": F.col("doc_id"), "topic": F.col("source"), "language": F.col("lang"), "words": I.grouped(F.col("words")), "status": F.lit(""),
        "rationale": I.rationale(F.col("words"), F.col("lang") == "en"),
    }
    return I.entry_lines(rows, "number", F.concat(F.lit("document "), F.col("doc_id").cast("string")), fields)


@register
def delimited_documents(spark, d):
    """Documents written as delimited text and read again."""
    path = scratch_path(spark, "delimited")
    sinks.write_predictions(_docs(spark, d), path, list(DOCUMENT))
    rows = readers.read_strings(spark, path, DOCUMENT)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.nullif("lang", F.lit("")).alias("lang"), F.nullif("source", F.lit("")).alias("source"), F.sha2("text", 256).alias("text_sha256"))


def _segments(spark, d):
    """Documents cut into segments of 200 characters, written as delimited text and read as segments of essays."""
    docs = _docs(spark, d)
    status = F.when(F.col("lang") == "en", "No").when(F.col("lang") == "fr", "Yes").when(F.col("lang") == "de", " ").otherwise("")
    cut = I.segments(docs, WIDTH).join(docs.select(F.col("doc_id").alias("id"), "source", "lang", status.alias("status")), "id")
    rows = cut.select(
        F.col("id").alias("essay_id_comp"), "discourse_id", F.col("start").alias("discourse_start"), F.col("end").alias("discourse_end"), F.lit("Evidence").alias("discourse_type"),
        F.col("text").alias("discourse_text"), F.col("source").alias("prompt_name"), F.col("lang").alias("grade_level"), F.col("status").alias("ell_status"), F.lit("Independent").alias("task"),
    )
    path = scratch_path(spark, "segments")
    sinks.write_predictions(rows, path, list(readers.SEGMENT_COLUMNS))
    return readers.read_segments(spark, path)


@register
def delimited_segments(spark, d):
    """Essays nested from their segments and put together again by offsets."""
    rows = readers.nest_segments(_segments(spark, d))
    text = P.overlay_sweep(F.col("segments"), False)
    return rows.select(F.col("essay_id_comp").cast("bigint").alias("doc_id"), F.nullif("prompt_name", F.lit("")).alias("source"), F.col("n_segments").alias("segments"), F.element_at("segments", -1)["end"].cast("bigint").alias("last_end"), F.sha2(text, 256).alias("text_sha256"))


@register
def segments_with_status(spark, d):
    """Segments whose status is Yes or No, not blank or a space."""
    return I.with_status(_segments(spark, d), "ell_status", "Yes", "No").groupBy("ell_status").agg(F.count("*").alias("segments"), F.count_distinct("essay_id_comp").alias("essays"), F.sum(F.length("discourse_text")).alias("characters"))


@register
def json_documents(spark, d):
    """Documents written as nested JSON and read again."""
    path = scratch_path(spark, "json")
    sinks.write_documents(_docs(spark, d).select("doc_id", F.struct("lang", F.struct("source").alias("origin")).alias("meta"), F.array("text").alias("texts")), path)
    rows = readers.read_json_rows(spark, path, "doc_id bigint, meta struct<lang:string,origin:struct<source:string>>, texts array<string>")
    return rows.select("doc_id", F.col("meta.lang").alias("lang"), F.col("meta.origin.source").alias("source"), F.sha2(F.get("texts", F.lit(0)), 256).alias("text_sha256"))


@register
def reproduced_run(spark, d):
    """A run judged, its metrics written, and the run repeated over other partitions."""
    words = T.word_count(F.coalesce(F.col("text"), F.lit("")))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = _docs(spark, d).select("doc_id", words.alias("words"))
    run = lambda rows: labels.join(rows, "doc_id", "left").withColumn("predicted", (F.col("words") > LONG).cast("int"))
    first = stored(E.metrics(run(docs)), "metrics")
    again = run(docs.repartition(7, "words"))
    return I.reproduction_checks(first, E.metrics(again), ("accuracy", "precision", "recall", "f1"), "total", again, "words")


def _type(c: str) -> str:
    some = f"x.{c} IS NOT NULL AND x.{c}::VARCHAR <> ''"
    return f"""CASE WHEN count(*) FILTER ({some}) = 0 THEN 'empty' WHEN count(*) FILTER ({some} AND NOT regexp_full_match(x.{c}::VARCHAR, '\\s*[+-]?\\d+\\s*')) = 0 THEN 'int'
        WHEN count(*) FILTER ({some} AND try_cast(x.{c}::VARCHAR AS DOUBLE) IS NULL) = 0 THEN 'float' ELSE 'string' END"""


_GROUPED = "CASE WHEN {v} = floor({v}) THEN format('{{:,}}', {v}::BIGINT) ELSE format('{{:,}}', floor({v})::BIGINT) || '.50' END"
_FACTS = (("1 rows", 1, "rows", "count(*)"), ("4 keys", 1, "distinct", "count(DISTINCT nullif(source, ''))"), ("5 length", 1, "min", "min(length(coalesce(text, '')))"), ("5 length", 2, "median", "median(length(coalesce(text, '')))"), ("5 length", 3, "max", "max(length(coalesce(text, '')))"))
_PROFILE = " UNION ALL ".join(
    [
        *[f"SELECT '{section}' AS section, {place}::BIGINT AS place, '{name}' AS name, {_GROUPED.format(v=v)} AS value FROM documents" for section, place, name, v in _FACTS],
        *[f"SELECT '2 columns', {k}::BIGINT, '{c}', {_type(c)} FROM (SELECT * FROM documents ORDER BY doc_id LIMIT {I.SAMPLE}) x" for k, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"), 1)],
        "SELECT '3 labels', 0::BIGINT, coalesce(lang, ''), format('{:,}', count(*)) FROM documents GROUP BY coalesce(lang, '')",
    ]
)
_COUNT = O.count("text", r"\S+")
_HEADS = ["'### ' || number || '. document ' || doc_id", "'- document: ' || doc_id", "'- topic: ' || coalesce(nullif(source, ''), '(missing)')", "'- language: ' || coalesce(nullif(lang, ''), '(missing)')", "'- words: ' || format('{:,}', words)", "'- status: (missing)'",
          "'- rationale: ' || CASE WHEN lang = 'en' THEN 'preferred grade, ' ELSE '' END || CASE WHEN words BETWEEN 500 AND 1500 THEN '500 to 1500 words, ' ELSE 'outside the preferred length, kept for diversity, ' END || 'identifier unique'"]
_SEGMENTS = f"SELECT *, CASE lang WHEN 'en' THEN 'No' WHEN 'fr' THEN 'Yes' END AS status, ((length(text) + {WIDTH - 1}) // {WIDTH})::BIGINT AS k FROM documents WHERE length(text) > 0"
_READ = "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents"

ORACLE_SQL: dict[str, str] = {
    "table_profile": _PROFILE,
    "profile_report": f"""WITH p AS ({_PROFILE}) SELECT section, place, name, '- ' || CASE WHEN name = '' THEN '(none)' ELSE name END || ': ' || coalesce(value, '(none)') AS line FROM p
        UNION ALL SELECT DISTINCT section, -1::BIGINT, '', '## ' || split_part(section, ' ', 2) FROM p""",
    "last_by_key": "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars, sha256(arg_max(text, doc_id)) AS text_sha256 FROM documents WHERE source <> '' GROUP BY source",
    "feature_by_name": f"SELECT doc_id, {O.six('mattr')} AS mattr, {O.six('sentence_length_cv')} AS cv, NULL::DOUBLE AS absent FROM {O.mattr('SELECT doc_id AS id, text FROM documents')} JOIN {O.cv('SELECT doc_id AS id, text FROM documents')} USING (id) JOIN (SELECT doc_id, doc_id AS id FROM documents) USING (id)",
    "label_codes": "SELECT doc_id, CASE quality WHEN 1 THEN 'ai_associated' WHEN 0 THEN 'human_associated' ELSE 'abstained' END AS name, CASE WHEN quality IN (0, 1) THEN quality::INT END AS code FROM (SELECT doc_id FROM documents) LEFT JOIN labels USING (doc_id)",
    "sample_shortfall": f"SELECT source, {REQUESTED}::BIGINT AS requested, count(*) AS available, least(count(*), {REQUESTED}) AS taken, CASE WHEN count(*) < {REQUESTED} THEN 'fewer_rows_than_requested: available=' || count(*) || ' requested={REQUESTED}' END AS reason FROM documents GROUP BY source",
    "document_preview": rf"""SELECT doc_id, lang, source, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '...' ELSE t END AS text
        FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents ORDER BY doc_id LIMIT {PREVIEW})""",
    "pilot_report": f"""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY turn, source) AS number FROM ({O.ORACLE_SQL['pilot_round_robin']})),
        r AS (SELECT number, unnest(range(0, {len(_HEADS)})) AS place, [{', '.join(_HEADS)}] AS held FROM (SELECT *, {_COUNT} AS words FROM documents) JOIN c USING (doc_id))
        SELECT number AS section, place::INT AS place, held[place + 1] AS line FROM r""",
    # a null value is written as a blank one
    "delimited_documents": "SELECT doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "delimited_segments": f"SELECT doc_id, nullif(source, '') AS source, k AS segments, length(text)::BIGINT AS last_end, sha256(text) AS text_sha256 FROM ({_SEGMENTS})",
    "segments_with_status": f"SELECT status AS ell_status, sum(k)::BIGINT AS segments, count(DISTINCT doc_id) AS essays, sum(length(text))::BIGINT AS characters FROM ({_SEGMENTS}) WHERE status IS NOT NULL GROUP BY status",
    "json_documents": _READ,
    "reproduced_run": "SELECT unnest(['metrics_reproduced', 'row_count_matches', 'rows_joined']) AS check_name, unnest([true, true, (SELECT count(*) FILTER (d.doc_id IS NULL) = 0 FROM labels l LEFT JOIN documents d USING (doc_id))]) AS passed",
}

ORACLE_SQL = {name: O.unicode_spaces(O.whole(sql)) for name, sql in ORACLE_SQL.items()}
