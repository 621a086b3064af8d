"""Inspection against plain Python, and the cases that the given tables never hold."""

import csv
import hashlib
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrivener.functions import text as T
from scrivener.operators import inspection, profile
from scrivener.sources import readers, sinks

COLUMNS = "id bigint, text string, label string, key string"
ROWS = [(1, "one two", "0", "5"), (2, None, "0", ""), (3, "", "1", None), (4, "x" * 1500, None, "5"), (5, "y", "", "a b"), (5, "y", "", "a b")]


def told(frame):
    return {(r.section, r.name): r.value for r in frame.collect()}


def test_profile_by_plain_python(spark):
    got = told(inspection.table_profile(spark.createDataFrame(ROWS, COLUMNS), "id", "text", "label", "key"))
    lengths = [len(t or "") for _, t, *_ in ROWS]
    assert got["5 length", "min"] == "0" and got["5 length", "max"] == "1,500"
    assert got["5 length", "median"] == f"{statistics.median(lengths):g}"
    labels = Counter(r[2] or "" for r in ROWS)
    assert {name: int(v) for (section, name), v in got.items() if section == "3 labels"} == labels
    assert got["1 rows", "rows"] == "6" and got["4 keys", "distinct"] == "2"
    assert [got["2 columns", c] for c in ("id", "text", "label", "key")] == ["int", "string", "int", "string"]


def test_profile_types_come_from_the_first_rows_only(spark):
    rows = spark.range(300).select("id", F.col("id").cast("string").alias("text"), F.when(F.col("id") < 200, "1.5").otherwise("word").alias("label"), F.lit("").alias("key"))
    got = told(inspection.table_profile(rows.repartition(5), "id", "text", "label", "key"))
    assert got["2 columns", "label"] == "float" and got["2 columns", "key"] == "empty" and got["4 keys", "distinct"] == "0"
    assert told(inspection.table_profile(rows, "id", "text", "label", "key", sample=201))["2 columns", "label"] == "string"
    # an even number of rows: the median lies between two lengths, and is shown with decimals
    assert told(inspection.table_profile(spark.createDataFrame([(1, "a", "", ""), (2, "bb", "", "")], COLUMNS), "id", "text", "label", "key"))["5 length", "median"] == "1.50"


def test_profile_and_report_of_an_empty_table(spark, tmp_path):
    found = inspection.table_profile(spark.createDataFrame([], COLUMNS), "id", "text", "label", "key")
    got = told(found)
    assert got["1 rows", "rows"] == "0" and got["5 length", "median"] is None and not any(section == "3 labels" for section, _ in got)
    sinks.write_lines(inspection.report_lines(found), f"{tmp_path}/report", "section", "place", "name")
    assert "- median: (none)" in [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]


def test_report_lines_are_written_in_order(spark, tmp_path):
    found = inspection.table_profile(spark.createDataFrame(ROWS, COLUMNS), "id", "text", "label", "key")
    sinks.write_lines(inspection.report_lines(found), f"{tmp_path}/report", "section", "place", "name")
    lines = [line for part in sorted((tmp_path / "report").glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]
    assert lines[:2] == ["## rows", "- rows: 6"]
    assert lines[2:7] == ["## columns", "- id: int", "- text: string", "- label: int", "- key: string"]
    assert lines[7:11] == ["## labels", "- (none): 3", "- 0: 2", "- 1: 1"]
    assert lines[11:] == ["## keys", "- distinct: 2", "## length", "- min: 0", "- median: 1", "- max: 1,500"]


def test_entries_number_rows_and_name_what_is_missing(spark):
    rows = spark.createDataFrame([(2, "b", None, 700), (1, "a", "", 40)], "number int, id string, topic string, words int")
    fields = {"topic": F.col("topic"), "words": F.col("words"), "why": inspection.rationale(F.col("words"), F.col("id") == "b")}
    lines = [r.line for r in inspection.entry_lines(rows, "number", F.col("id"), fields).orderBy("section", "place").collect()]
    assert lines == [
        "### 1. a", "- topic: (missing)", "- words: 40", "- why: outside the preferred length, kept for diversity, identifier unique",
        "### 2. b", "- topic: (missing)", "- words: 700", "- why: preferred grade, 500 to 1500 words, identifier unique",
    ]


def test_last_row_of_a_key_wins(spark):
    rows = spark.createDataFrame([("p", 1, "old"), ("p", 3, "new"), ("p", 2, "mid"), ("", 9, "blank"), (None, 9, "none"), ("q", 1, None)], "key string, at int, text string")
    assert sorted((r.key, r.at, r.text) for r in inspection.table_by_key(rows.repartition(3), "key", "at").collect()) == [("p", 3, "new"), ("q", 1, None)]
    assert inspection.table_by_key(rows.limit(0), "key", "at").count() == 0


def test_labels_features_and_status_by_name(spark):
    rows = spark.createDataFrame([("human_associated",), ("ai_associated",), ("mixed",), (" ai_associated",), (None,)], "name string")
    assert [r.code for r in rows.select(inspection.label_code(F.col("name")).alias("code")).collect()] == [0, 1, None, None, None]
    cells = spark.sql("SELECT array(named_struct('name', 'a', 'value', 1.5D), named_struct('name', 'b', 'value', CAST(NULL AS DOUBLE)), named_struct('name', 'a', 'value', 9D)) AS f")
    value = lambda name: cells.select(inspection.feature_value(F.col("f"), name)).first()[0]
    assert (value("a"), value("b"), value("c")) == (1.5, None, None)
    status = spark.createDataFrame([("Yes",), ("No",), ("",), (" ",), (None,), ("yes",), ("No ",)], "s string")
    assert sorted(r.s for r in inspection.with_status(status, "s", "Yes", "No").collect()) == ["No", "Yes"]


def test_margins_outside_the_bins_are_errors(spark):
    margins = lambda *values: spark.createDataFrame([(v,) for v in values], "m double").select(T.checked_margin_bin(F.col("m")).alias("bin"))
    assert [r.bin for r in margins(0.0, 0.05, 0.15, 0.4999, 0.5, None).collect()] == ["0.00-0.05", "0.05-0.10", "0.15-0.20", "0.45-0.50", "0.45-0.50", None]
    for wrong in (-0.01, 0.51):
        with pytest.raises(Exception, match="no bin for the margin"):
            margins(wrong).collect()


def test_samples_say_why_they_fall_short(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 5 + [(None,)], "g string")
    got = {r.g: (r.requested, r.available, r.taken, r.reason) for r in inspection.sample_report(rows, "g", 3).collect()}
    assert got == {"a": (3, 3, 3, None), "b": (3, 5, 3, None), None: (3, 1, 1, "fewer_rows_than_requested: available=1 requested=3")}


def test_preview_is_one_line_and_bounded(spark):
    rows = spark.createDataFrame([(3, "z"), (1, " a\n\tb c "), (2, "w" * 200), (4, None)], "id int, text string")
    got = inspection.preview(rows, "id", 3, "text").collect()
    assert [(r.id, r.text) for r in got] == [(1, "a b c"), (2, "w" * 160 + "..."), (3, "z")]
    assert inspection.preview(rows, "id", 9).count() == 4


def test_a_repeated_run_can_fail_each_check(spark):
    run = lambda accuracy, f1, total: spark.createDataFrame([(accuracy, f1, total)], "accuracy double, f1 double, total bigint")
    judged = spark.createDataFrame([(1, 5), (2, 6)], "id int, words int")
    check = lambda first, again, rows=judged: {r.check_name: r.passed for r in inspection.reproduction_checks(first, again, ("accuracy", "f1"), "total", rows, "words").collect()}
    good = {"metrics_reproduced": True, "row_count_matches": True, "rows_joined": True}
    assert check(run(0.5, None, 2), run(0.5 + 1e-14, None, 2)) == good
    assert check(run(0.5, 0.1, 2), run(0.5 + 1e-9, 0.1, 2)) == good | {"metrics_reproduced": False}
    assert check(run(0.5, 0.1, 2), run(0.5, None, 2)) == good | {"metrics_reproduced": False}
    assert check(run(0.5, 0.1, 2), run(0.5, 0.1, 3)) == good | {"row_count_matches": False}
    assert check(run(0.5, 0.1, 2), run(0.5, 0.1, 2), judged.unionByName(spark.createDataFrame([(3, None)], "id int, words int"))) == good | {"rows_joined": False}
    assert not check(run(0.5, 0.1, 2).limit(0), run(0.5, 0.1, 2))["metrics_reproduced"]


HARD = ['say "yes", twice', "two\nlines", " spaces kept ", "back\\slash \\\" end", "a,b", "ünï", '"', '""', "tab\there", "#mark", "\\"]


def test_delimited_text_comes_back_as_it_was(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(HARD)] + [("90", None), ("91", "")], "id string, text string")
    sinks.write_predictions(rows.repartition(3), f"{tmp_path}/out", ["id", "text"])
    got = {r.id: r.text for r in readers.read_strings(spark, f"{tmp_path}/out", ("id", "text")).collect()}
    assert got == {str(i): t for i, t in enumerate(HARD)} | {"90": "", "91": ""}
    plain = {}
    for part in (tmp_path / "out").glob("part-*"):
        with part.open(encoding="utf-8", newline="") as f:
            plain |= {r["id"]: r["text"] for r in csv.DictReader(f)}
    assert plain == got


def test_segments_put_together_again(spark, tmp_path):
    texts = ["abcdefghij", "", "é" * 7, None, HARD[0] + "\n" + HARD[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cut = inspection.segments(docs, 4)
    pieces = {}
    for r in cut.orderBy("id", "start").collect():
        pieces.setdefault(r.id, []).append((r.start, r.end, r.text))
    assert {i: "".join(t for *_, t in ps) for i, ps in pieces.items()} == {i: t for i, t in enumerate(texts) if t}
    assert all(a[1] == b[0] for ps in pieces.values() for a, b in zip(ps[:-1], ps[1:], strict=True))
    wide = cut.select(F.col("id").alias("essay_id_comp"), "discourse_id", F.col("start").alias("discourse_start"), F.col("end").alias("discourse_end"), F.lit("t").alias("discourse_type"), F.col("text").alias("discourse_text"), *[F.lit("").alias(c) for c in readers.SEGMENT_COLUMNS[6:]])
    sinks.write_predictions(wide.repartition(3), f"{tmp_path}/segments", list(readers.SEGMENT_COLUMNS))
    nested = readers.nest_segments(readers.read_segments(spark, f"{tmp_path}/segments"))
    got = {int(r.essay_id_comp): r.sha for r in nested.select("essay_id_comp", F.sha2(profile.overlay_sweep(F.col("segments"), False), 256).alias("sha")).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts) if t}


def test_json_rows_come_back_and_broken_ones_are_errors(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, None, ""])], "id bigint, text string")
    sinks.write_documents(rows, f"{tmp_path}/json")
    got = readers.read_json_rows(spark, f"{tmp_path}/json", "id bigint, text string").collect()
    assert sorted((r.id, r.text) for r in got) == list(enumerate([*HARD, None, ""]))
    (tmp_path / "broken.json").write_text('{"id": 1}\n{"id": \n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json_rows(spark, f"{tmp_path}/broken.json", "id bigint, text string").collect()
