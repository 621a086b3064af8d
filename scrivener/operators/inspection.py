"""Inspection of given tables: profiles by one scan with a sample for types, tables by key, reports as ordered lines, and checks of a repeated run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.operators.checks import as_rows
from scrivener.operators.profile import infer_types

#: Rows, first by order, whose values decide a column's type.
SAMPLE = 200
#: Label names of the two classes.
LABELS = {"human_associated": 0, "ai_associated": 1}


def label_code(name: Column) -> Column:
    """0 or 1 of a label's name; null for any other, an abstention among them."""
    out = F.lit(None).cast("int")
    for label, code in LABELS.items():
        out = F.when(name == label, code).otherwise(out)
    return out


def feature_value(features: Column, name: str) -> Column:
    """The value of the named feature in an array of (name, value, ...); null where it is absent or unavailable, the first where names repeat."""
    return F.get(F.filter(features, lambda f: f["name"] == name), F.lit(0))["value"]


def with_status(rows: DataFrame, column: str, *values: str) -> DataFrame:
    """The rows whose value is exactly one of these; blank, padded and null values are not."""
    return rows.filter(F.col(column).isin(*values))


def preview(rows: DataFrame, order: str, n: int, text: str | None = None, width: int = 160) -> DataFrame:
    """The first ``n`` rows by ``order``; ``text`` on one line, cut to ``width`` characters and an ellipsis."""
    first = rows.orderBy(order).limit(n)
    if text is None:
        return first
    line = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    return first.withColumn(text, F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line))


def grouped(number: Column) -> Column:
    """A count with thousands set off; a number that is not whole has two decimals."""
    number = number.cast("double")
    return F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 2))


def value_cells(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(kind, value, n): how often each value of each named column occurs, all of them by one scan and one exchange of counts."""
    cells = [F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in columns.items()]
    return rows.select(F.inline(F.array(*cells))).groupBy("kind", "value").agg(F.count("*").alias("n"))


def column_types(rows: DataFrame, order: str, n: int = SAMPLE) -> DataFrame:
    """(place, column_name, dtype) by the first ``n`` rows: what a reader of strings would take each column for."""
    found = infer_types(rows.orderBy(order).limit(n))
    place = F.array_position(F.array(*map(F.lit, rows.columns)), F.col("column_name"))
    return found.select(place.alias("place"), "column_name", "dtype")


def table_profile(rows: DataFrame, order: str, text: str, label: str, key: str, sample: int = SAMPLE) -> DataFrame:
    """(section, place, name, value) of a table: rows, column types, label counts, distinct keys and text lengths.

    Values of label, key and length are counted by one scan (``value_cells``), in which no
    group is larger than its number of distinct values a task; types come from ``sample``
    rows. A null label counts as the blank one, blank and null keys are no keys, a null
    text has length 0. An empty table has no labels, and null lengths.
    """
    cells = value_cells(rows, {"label": F.coalesce(F.col(label).cast("string"), F.lit("")), "key": F.col(key), "length": F.length(F.coalesce(F.col(text), F.lit("")))})
    size = F.when(F.col("kind") == "length", F.col("value").cast("long"))
    summed = cells.agg(
        F.coalesce(F.sum(F.when(size.isNotNull(), F.col("n"))), F.lit(0)).alias("rows"),
        F.count_if((F.col("kind") == "key") & (F.coalesce(F.col("value"), F.lit("")) != "")).alias("keys"),
        F.min(size).alias("min"), F.max(size).alias("max"), F.percentile(size, F.lit(0.5), F.when(size.isNotNull(), F.col("n")).otherwise(0)).alias("median"),
    )
    fact = lambda section, place, name, value: F.struct(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), F.lit(name).alias("name"), grouped(F.col(value)).alias("value"))
    facts = summed.select(F.inline(F.array(fact("1 rows", 1, "rows", "rows"), fact("4 keys", 1, "distinct", "keys"), fact("5 length", 1, "min", "min"), fact("5 length", 2, "median", "median"), fact("5 length", 3, "max", "max"))))
    types = column_types(rows, order, sample).select(F.lit("2 columns").alias("section"), "place", F.col("column_name").alias("name"), F.col("dtype").alias("value"))
    # labels have no order of their own: they sort by name within place 0
    labels = cells.filter("kind = 'label'").select(F.lit("3 labels").alias("section"), F.lit(0).cast("long").alias("place"), F.col("value").alias("name"), grouped(F.col("n")).alias("value"))
    return facts.unionByName(types).unionByName(labels)


def table_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by ``order`` where a key repeats; blank and null keys are left out. ``order`` tells the rows of a key apart."""
    kept = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != key]), F.col(order)).alias("__last")).select(key, "__last.*")


def report_lines(found: DataFrame) -> DataFrame:
    """(section, place, name, line) of (section, place, name, value): a heading for each section, then one bullet a row.

    ``name`` orders lines of one place; a blank name shows as ``(none)``. Nothing is
    gathered or numbered: ``sinks.write_lines`` sorts by range.
    """
    heads = found.groupBy("section").agg(F.lit(-1).cast("long").alias("place"), F.lit("").alias("name")).withColumn("line", F.concat(F.lit("## "), F.substring_index("section", " ", -1)))
    shown = F.when(F.col("name") == "", "(none)").otherwise(F.col("name"))
    body = found.select("section", "place", "name", F.concat(F.lit("- "), shown, F.lit(": "), F.coalesce("value", F.lit("(none)"))).alias("line"))
    return heads.unionByName(body)


def entry_lines(rows: DataFrame, order: str, title: Column, fields: dict[str, Column]) -> DataFrame:
    """(section, place, line): each row as a numbered heading and a bullet a field, ``(missing)`` where a field is null or blank.

    ``order`` is the row's number in the report; it orders the entries.
    """
    shown = [F.concat(F.lit(f"- {name}: "), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("(missing)"))) for name, value in fields.items()]
    head = F.concat(F.lit("### "), F.col(order).cast("string"), F.lit(". "), title.cast("string"))
    return rows.select(F.col(order).cast("long").alias("section"), F.posexplode(F.array(head, *shown)).alias("place", "line"))


def rationale(words: Column, preferred: Column, low: int = 500, high: int = 1500) -> Column:
    """Why a pilot text was selected."""
    return F.concat_ws(
        ", ", F.when(preferred, "preferred grade"), F.when(words.between(low, high), f"{low} to {high} words").otherwise("outside the preferred length, kept for diversity"), F.lit("identifier unique")
    )


def sample_report(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, requested, available, taken, reason) of a sample of ``n`` in each group: all rows are taken where there are fewer, and the reason says so."""
    held = rows.groupBy(group).agg(F.count("*").alias("available"))
    short = F.when(F.col("available") < n, F.concat(F.lit("fewer_rows_than_requested: available="), F.col("available").cast("string"), F.lit(f" requested={n}")))
    return held.select(group, F.lit(n).cast("long").alias("requested"), "available", F.least(F.col("available"), F.lit(n).cast("long")).alias("taken"), short.alias("reason"))


def reproduction_checks(first: DataFrame, again: DataFrame, values: tuple[str, ...], count: str, judged: DataFrame, joined: str, tolerance: float = 1e-12) -> DataFrame:
    """(check_name, passed) of a run that repeats another: metrics reproduced, rows as many, all rows joined.

    ``first`` and ``again`` have one row of metrics each (``values`` and ``count``); a
    metric that is missing in both is reproduced, in one of them is not. ``judged`` holds
    the rows behind ``again``, ``joined`` a column that is null where a row met nothing.
    An absent row of metrics fails.
    """
    one = lambda rows, mark: rows.agg(*[F.first(c).alias(f"__{mark}_{c}") for c in (*values, count)], F.count("*").alias(f"__{mark}"))
    both = one(first, "a").join(F.broadcast(one(again, "b")))
    close = F.col("__a") == 1
    for c in values:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        close = close & F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    found = as_rows(both, {"metrics_reproduced": close & (F.col("__b") == 1), "row_count_matches": F.col(f"__a_{count}") == F.col(f"__b_{count}")})
    return found.unionByName(as_rows(judged, {"rows_joined": F.col(joined).isNotNull()}))


def segments(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, discourse_id, start, end, text): a text cut into pieces of ``width`` characters, offsets half-open; an empty text has none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")).filter(F.length("__t") > 0)
    cut = rows.select("id", "__t", F.posexplode(F.sequence(F.lit(0), F.length("__t") - 1, F.lit(width))).alias("discourse_id", "start"))
    piece = F.substring(F.col("__t"), F.col("start") + 1, F.lit(width))
    return cut.select("id", "discourse_id", "start", (F.col("start") + F.length(piece)).alias("end"), piece.alias("text"))
