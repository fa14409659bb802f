"""Queries over delivered lines (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.line_parser import ParsedLines, parse_lines
from wordloom.runtime import table


def _parsed(spark: SparkSession, sf_dir: str) -> ParsedLines:
    return parse_lines(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "models"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).rejected.select("line_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).rejected.select(
        "line_id", F.concat_ws("; ", "reasons").alias("reasons")
    )


def p1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean lines as words; vectors by their size and the sum of components times places."""
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)
    return _parsed(spark, sf_dir).clean.select(
        "line_id", "model_id", "line_no", "word", F.size("embedding").alias("size"), (F.round(total, 4) + 0.0).alias("mark")
    )


def p1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the clean lines, a row a component."""
    clean = _parsed(spark, sf_dir).clean
    exploded = clean.select("line_id", "word", F.posexplode("embedding").alias("place", "value"))
    return exploded.select("line_id", "word", "place", F.col("value").cast("double").alias("value"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p1_words": p1_words, "p1_components": p1_components}

_CUT = r"""
WITH known AS (
  SELECT r.line_id, r.model_id, r.line_no, r.line_bytes, lower(m.layout) AS layout, m.dims,
         TRY(decode(r.line_bytes)) AS whole
  FROM raw_lines r LEFT JOIN models m ON r.model_id = m.model_id
  WHERE NOT coalesce(lower(m.layout) = 'text_dims' AND r.line_no = 1, false)
), lines AS (
  SELECT *, CASE WHEN layout = 'csv' THEN regexp_replace(whole, '\r\z', '') ELSE whole END AS line FROM known
), checked AS (
  SELECT *, layout <> 'csv' OR regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoting FROM lines
), cut AS (
  SELECT *, CASE WHEN layout = 'csv'
    THEN list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
           lambda c: CASE WHEN c[1] = '"' THEN replace(c[2:len(c) - 1], '""', '"') ELSE c END)
    ELSE list_filter(regexp_split_to_array(line, '[ \t\n\r\f]+'), lambda c: c <> '') END AS cells
  FROM checked
), judged AS (
  SELECT *, whole IS NOT NULL AND quoting AND len(cells) = dims + 1 AND cells[1] <> ''
    AND len(list_filter(cells[2:], lambda c: NOT (regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
        AND abs(coalesce(TRY_CAST(c AS DOUBLE), 'inf'::DOUBLE)) < 3.4028235677973366e38))) = 0
    AND layout IN ('text', 'text_dims', 'csv') AS good
  FROM cut
)
"""

SQL = {
    "p1_found": _CUT + "SELECT line_id FROM judged WHERE NOT coalesce(good, false)",
    "p1_reasons": _CUT
    + """SELECT line_id, array_to_string(list_sort(list_filter([
      CASE WHEN layout IS NULL OR layout NOT IN ('text', 'text_dims', 'csv') THEN 'model has no known layout' END,
      CASE WHEN whole IS NULL THEN 'bytes are not valid UTF-8' END,
      CASE WHEN whole IS NOT NULL AND NOT quoting THEN 'broken quoting' END,
      CASE WHEN whole IS NOT NULL AND quoting AND len(cells) <> dims + 1 THEN 'wrong number of fields' END,
      CASE WHEN whole IS NOT NULL AND quoting AND cells[1] = '' THEN 'word is empty' END,
      CASE WHEN whole IS NOT NULL AND quoting AND len(list_filter(cells[2:], lambda c: NOT regexp_full_match(c, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'))) > 0 THEN 'component is not a number' END,
      CASE WHEN whole IS NOT NULL AND quoting AND len(list_filter(cells[2:], lambda c: regexp_full_match(c, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
        AND abs(coalesce(TRY_CAST(c AS DOUBLE), 'inf'::DOUBLE)) >= 3.4028235677973366e38)) > 0 THEN 'component is not finite as FLOAT' END
    ], lambda r: r IS NOT NULL)), '; ') AS reasons FROM judged WHERE NOT coalesce(good, false)""",
    "p1_components": _CUT
    + "SELECT line_id, cells[1] AS word, (i - 2)::INT AS place, cells[i]::FLOAT::DOUBLE AS value FROM (SELECT *, unnest(range(2, len(cells) + 1)) AS i FROM judged WHERE good)",
    "p1_words": _CUT
    + """SELECT line_id, model_id, line_no, cells[1] AS word, (len(cells) - 1)::INT AS size,
      round(list_sum(list_transform(cells[2:], lambda c, i: c::FLOAT::DOUBLE * i)), 4) + 0.0 AS mark FROM judged WHERE good""",
}
