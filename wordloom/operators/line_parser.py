"""Loading of delivered text lines, with the failing ones set apart.

Parsed cells are exploded to (row, column, value), joined to a rule table, each rule is
evaluated on its cells, failures are aggregated to one list of reasons a row, and the clean
rows are those that the failures do not name (anti-join).  Only failures are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between the parts of a text line.
ASCII_SPACE = "[ \\t\\n\\r\\f]+"
#: White space of Unicode, as words are trimmed of it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The shape of a component.
NUMBER = "\\A[+-]?(?:[0-9]++\\.?[0-9]*+|\\.[0-9]++)(?:[eE][+-]?[0-9]++)?\\z"
#: A quoted or bare csv field; possessive, so that long lines need no stack.
CSV_FIELD = '(?:"(?:[^"]|"")*+"|[^",]*+)'
CSV_LINE = f"\\A{CSV_FIELD}(?:,{CSV_FIELD})*+\\z"

#: kind of cell, check, reason given when the check does not hold.
RULES = [
    ("line", "present", "line is null"),
    ("layout", "present", "model has no known layout"),
    ("utf8", "true", "bytes are not valid UTF-8"),
    ("quoting", "true", "broken quoting"),
    ("width", "zero", "wrong number of fields"),
    ("word", "not_empty", "word is empty"),
    ("component", "number", "component is not a number"),
    ("component", "finite", "component is not finite as FLOAT"),
]


@dataclass(frozen=True)
class ParsedLines:
    """``clean``: line_id, model_id, line_no, word, embedding.  ``rejected``: line_id,
    reasons (sorted), bad_columns (0 is the word; null where the whole line fails)."""

    clean: DataFrame
    rejected: DataFrame


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "kind string, check string, reason string")


def _holds(check: Column, value: Column) -> Column:
    as_float = F.expr("try_cast(value as float)")
    return (
        F.when(check == "present", value.isNotNull())
        .when(check == "true", value == "true")
        .when(check == "zero", value == "0")
        .when(check == "not_empty", F.length(value) > 0)
        .when(check == "number", value.rlike(NUMBER))
        .when(
            check == "finite",
            ~value.rlike(NUMBER) | (F.abs(as_float) < F.lit(float("inf"))),
        )
    )


def _prepared(lines: DataFrame, models: DataFrame) -> DataFrame:
    """One row a line that is no header, with its cells where the line can be cut."""
    layouts = models.select(
        F.col("model_id").alias("layout_model"), F.lower("layout").alias("layout"), "dims"
    ).dropDuplicates(["layout_model"])
    rows = lines.select("line_id", "model_id", "line_no", "line_bytes").join(
        layouts, F.col("model_id") == F.col("layout_model"), "left"
    )
    rows = rows.where(
        ~F.coalesce((F.col("layout") == "text_dims") & (F.col("line_no") == 1), F.lit(False))
    )
    raw = F.col("line_bytes").cast("string")
    rows = rows.withColumn("known", F.col("layout").isin("text", "text_dims", "csv") & F.col("dims").isNotNull())
    rows = rows.withColumn("utf8", F.is_valid_utf8(raw))
    rows = rows.withColumn(
        "line", F.when(F.col("layout") == "csv", F.regexp_replace(raw, "\\r\\z", "")).otherwise(raw)
    )
    rows = rows.withColumn(
        "quoting", F.when(F.col("layout") == "csv", F.col("line").rlike(CSV_LINE)).otherwise(F.lit(True))
    )
    quoted = F.transform(
        # Every field is preceded by a comma here, so that no match is empty.
        F.regexp_extract_all(F.concat(F.lit(","), F.col("line")), F.lit(f",({CSV_FIELD})"), F.lit(1)),
        lambda c: F.when(
            c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    parts = F.array_remove(F.split("line", ASCII_SPACE), "")
    usable = F.col("known") & F.col("utf8") & F.col("quoting")
    return rows.withColumn(
        "cells", F.when(usable & (F.col("layout") == "csv"), quoted).when(usable, parts)
    ).drop("layout_model", "line")


def _facts() -> Column:
    """The cells of a row and what is known of the row as a whole, in one list."""

    def fact(kind: str, column: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), column.cast("int").alias("column"), value.cast("string").alias("value"))

    nowhere = F.lit(None)
    whole = F.array(
        fact("line", nowhere, F.length("line_bytes")),
        fact("layout", nowhere, F.when(F.col("known"), F.col("layout"))),
        fact("utf8", nowhere, F.coalesce("utf8", F.lit(True))),
        fact("quoting", nowhere, F.coalesce(F.col("quoting") | ~F.col("utf8") | ~F.col("known"), F.lit(True))),
        fact("width", nowhere, F.when(F.col("cells").isNull(), 0).otherwise(F.size("cells") - F.col("dims") - 1)),
    )
    cells = F.transform(
        F.coalesce("cells", F.array().cast("array<string>")),
        lambda c, i: F.struct(
            F.when(i == 0, F.lit("word")).otherwise(F.lit("component")).alias("kind"),
            i.cast("int").alias("column"),
            c.alias("value"),
        ),
    )
    return F.concat(whole, cells)


def parse_lines(lines: DataFrame, models: DataFrame) -> ParsedLines:
    """Split ``lines`` into words with vectors and rejected lines with reasons.

    ``lines``: line_id (key), model_id, line_no, line_bytes; ``models``: model_id, layout
    (text, text_dims, csv), dims.  Other columns are ignored.  Line 1 of a text_dims model
    is its header and in neither result.  A null line, or one whose model has no known
    layout, is rejected; an empty line has the wrong number of fields.  Repeated words are
    no failure; a line delivered again is judged again.  Empty tables give empty results.
    """
    rows = _prepared(lines, models)
    cells = rows.select("line_id", F.inline(_facts()))
    judged = cells.join(F.broadcast(rule_table(lines.sparkSession)), "kind")
    failures = judged.where(~F.coalesce(_holds(F.col("check"), F.col("value")), F.lit(False)))
    rejected = failures.groupBy("line_id").agg(
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.array_sort(F.collect_set("column")).alias("bad_columns"),
    )
    clean = rows.join(rejected.select("line_id"), "line_id", "left_anti").select(
        "line_id",
        "model_id",
        "line_no",
        F.col("cells")[0].alias("word"),
        F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c.try_cast("float")).alias("embedding"),
    )
    return ParsedLines(clean, rejected)
