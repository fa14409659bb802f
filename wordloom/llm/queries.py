"""The registered queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.clusters import Groups, all_vectors, similarity_groups
from wordloom.llm.encode import decode_corpus, encode_corpus
from wordloom.llm.encoding_repair import repair_words
from wordloom.llm.language import mislabelled_or_mixed, passages
from wordloom.llm.mixing import Mix, mix_sources
from wordloom.llm.neighbours import nearest_pairs, nearest_rows
from wordloom.llm.visual_form import look_alike_classes, same_looking_pairs, with_form
from wordloom.runtime import materialize, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(table(spark, sf_dir, "vocab_words"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "vocab_words").select("word_id", "model_id", "word")
    return with_form(words)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(table(spark, sf_dir, "vocab_words"))


def _groups(spark: SparkSession, sf_dir: str) -> Groups:
    names = ("word_vectors", "pq_codes", "pq_books", "models")
    return similarity_groups(all_vectors(*(table(spark, sf_dir, n) for n in names)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).members.where("row_id <> head_id").select("head_id", "row_id")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).groups


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_words(table(spark, sf_dir, "vocab_words")).select("word_id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_words(table(spark, sf_dir, "vocab_words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pairs(table(spark, sf_dir, "word_vectors"))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "word_vectors")
    near = nearest_rows(rows)
    words = rows.select("row_id", "word")
    other = rows.select(F.col("row_id").alias("other_id"), F.col("word").alias("other_word"))
    return near.join(words, "row_id").join(other, "other_id")


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of p5_found by comparing all, and whether routers over small partitions find 0.9 of them."""
    rows = table(spark, sf_dir, "word_vectors")
    exact, routed = nearest_pairs(rows, target=1 << 40), nearest_pairs(rows, target=64)
    pairs = materialize(exact.withColumn("of", F.lit(1)).unionByName(routed.withColumn("of", F.lit(2))))
    told = pairs.groupBy("row_id_a", "row_id_b").agg(F.sum("of").alias("of"))
    counted = told.agg(F.count_if(F.col("of").isin(1, 3)).alias("pairs"), F.count_if(F.col("of") == 3).alias("both"))
    return counted.select("pairs", (F.col("both") >= 0.9 * F.col("pairs")).alias("recall_kept"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids of each document spell its text."""
    documents = table(spark, sf_dir, "documents")
    encoded = encode_corpus(documents)
    back = decode_corpus(encoded).withColumnRenamed("text", "spelled")
    return documents.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("spelled")).alias("spelled"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mix keeps what it promises of each target: its share, within a hundredth of the
    whole, among the sources that have documents, and the cap on repeats."""
    shares = _mix(spark, sf_dir).shares.join(table(spark, sf_dir, "mix_targets").select("source", "max_repeats"), "source")
    return shares.select(
        "source",
        F.round("weight", 6).alias("weight"),
        (F.col("documents") > 0).alias("used"),
        (F.abs(F.col("actual_share") - F.coalesce("reachable_weight", F.lit(0.0))) < 0.01).alias("share_kept"),
        (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled_or_mixed(table(spark, sf_dir, "documents"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the passages of each document that is not blank are numbered and within its text."""
    documents = table(spark, sf_dir, "documents")
    found = passages(documents).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("passage").alias("last"), F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.bool_and((F.col("begin") < F.col("end")) & F.col("confidence").between(0, 1)).alias("sound"),
    )
    whole = (F.col("n") == F.col("last")) & (F.col("begin") >= 0) & (F.col("end") <= F.char_length("text")) & F.col("sound")
    return found.join(documents, "doc_id").select("doc_id", whole.alias("covered"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_forms": p2_forms, "p2_classes": p2_classes, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_nearest": p5_nearest, "p5_recall": p5_recall, "p6_ids": p6_ids, "p6_spelled": p6_spelled, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_bounds": p7_bounds, "p8_found": p8_found, "p8_passages": p8_passages, "p8_covered": p8_covered}


_CODED = """
size AS (SELECT quantizer_id, count(DISTINCT sub) AS subs FROM pq_books GROUP BY quantizer_id),
c AS (SELECT row_id, model_id, quantizer_id, norm, len(codes) AS n, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS sub
  FROM pq_codes JOIN models USING (model_id) WHERE codes IS NOT NULL),
p AS (SELECT c.row_id, any_value(c.model_id) AS model_id, any_value(c.quantizer_id) AS quantizer_id, any_value(norm) AS norm, count(vec) AS known, any_value(n) AS n, list(vec ORDER BY c.sub) AS parts
  FROM c LEFT JOIN pq_books b ON b.quantizer_id = c.quantizer_id AND b.sub = c.sub AND b.centroid = c.code GROUP BY c.row_id),
coded AS (SELECT row_id, model_id, list_transform(flatten(parts), lambda x: (x * coalesce(norm, 1::FLOAT))::FLOAT) AS embedding FROM p JOIN size USING (quantizer_id) WHERE known = n AND n = subs)
"""

_UNIT = """u AS (SELECT row_id, model_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM {source}
  WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"""

_NEAREST = f"""WITH {_UNIT.format(source="word_vectors")},
s AS (SELECT a.row_id AS a, b.row_id AS b, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS cosine FROM u a JOIN u b ON a.model_id = b.model_id AND a.row_id <> b.row_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM s),
pairs AS (SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM r WHERE place <= 5)"""

# White space of Unicode.
_SPACES = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

#: Exact results; the operators are exact in models of one partition, as all are at small scales.
#: Where there is no single right result, what is stated are the bounds it keeps.
SQL = {
    "p3_found": f"""WITH {_CODED}, every AS (SELECT row_id, model_id, embedding FROM word_vectors UNION ALL SELECT * FROM coded), {_UNIT.format(source="every")},
pairs AS (SELECT a.model_id, a.row_id AS a, b.row_id AS b FROM u a JOIN u b USING (model_id) WHERE a.row_id = b.row_id OR list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.70),
sets AS (SELECT model_id, a, list(b ORDER BY b) AS s FROM pairs GROUP BY model_id, a),
whole AS (SELECT s FROM sets GROUP BY model_id, s HAVING count(*) = len(s) AND len(s) > 1)
SELECT s[1] AS head_id, unnest(s[2:]) AS row_id FROM whole""",
    "p5_found": f"{_NEAREST} SELECT * FROM pairs",
    "p5_nearest": f"""{_NEAREST} SELECT other_id, row_id, cosine, place, v.word, w.word AS other_word FROM (SELECT a AS row_id, b AS other_id, cosine + 0.0 AS cosine, place FROM r WHERE place <= 5)
JOIN word_vectors v USING (row_id) JOIN (SELECT row_id AS other_id, word FROM word_vectors) w USING (other_id)""",
    "p5_recall": f"{_NEAREST} SELECT count(*) AS pairs, true AS recall_kept FROM pairs",
    "p6_spelled": "SELECT doc_id, true AS spelled FROM documents",
    "p8_covered": f"SELECT doc_id, true AS covered FROM documents WHERE length(trim(text, {_SPACES})) > 0",
    "p7_bounds": """SELECT source, round(weight, 6) AS weight, EXISTS (FROM documents d WHERE d.source = t.source AND d.text <> '') AS used,
true AS share_kept, true AS repeats_kept FROM mix_targets t""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
