"""Exact nearest-neighbour and analogy queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.errors import AnalogyError
from wordloom.functions.vector import analogy_offset, dot, l2_normalize
from wordloom.model import EmbeddingModel
from wordloom.operators.lookup import lookup_distinct

#: Rows of either side that one task compares at once.
BLOCK = 8192


def _ranked(words: DataFrame, query: Column, limit: int) -> DataFrame:
    scored = words.select("word", dot(F.col("embedding"), query).alias("similarity"))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), "word").limit(limit)


def embedding_similarity(model: EmbeddingModel, vector: list[float], limit: int, skips: list[str] | None = None) -> DataFrame:
    """word, similarity of the words most similar to a vector, which is normalized first.

    Words in ``skips`` are left out.  Ties come in byte order of the words; a limit of 0 gives
    no row.  Bucket rows take no part.
    """
    length = float(np.linalg.norm(np.asarray(vector, float)))
    unit = [float(x) / length if length else float(x) for x in vector]
    words = model.words.where(~F.col("word").isin(skips)) if skips else model.words
    return _ranked(words, F.array(*[F.lit(x) for x in unit]), limit)


def embedding_similarity_masked(model: EmbeddingModel, vector: list[float], limit: int, skips: DataFrame) -> DataFrame:
    """embedding_similarity() with the skipped words in a table of any size."""
    kept = model.words.join(skips.select("word"), "word", "left_anti")
    length = float(np.linalg.norm(np.asarray(vector, float)))
    return _ranked(kept, F.array(*[F.lit(float(x) / (length or 1.0)) for x in vector]), limit)


def word_similarity(model: EmbeddingModel, word: str, limit: int) -> DataFrame | None:
    """word, similarity of the words most similar to a word, known or not, without itself; None
    if it has no vector."""
    asked = model.words.sparkSession.createDataFrame([(word,)], "word string")
    row = lookup_distinct(asked, model).first()
    if row is None:
        return None
    return _ranked(model.words.where(F.col("word") != word), F.array(*[F.lit(float(x)) for x in row.embedding]), limit)


def analogy(model: EmbeddingModel, query: tuple[str, str, str], limit: int, remove: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """word, similarity of what is to c as b is to a; the flagged query words are left out.

    Raises AnalogyError, with which words are present, if one has no vector.
    """
    asked = model.words.sparkSession.createDataFrame([(w,) for w in query], "word string")
    vectors = {r.word: r.embedding for r in lookup_distinct(asked, model).collect()}  # three rows
    present = [w in vectors for w in query]
    if not all(present):
        raise AnalogyError(present)
    a, b, c = (np.asarray(vectors[w], float) for w in query)
    skips = [w for w, flag in zip(query, remove) if flag]
    return embedding_similarity(model, (b - a + c).tolist(), limit, skips)


def _blocks(rows: DataFrame, key: str) -> int:
    return max(1, -(-rows.select(key).count() // BLOCK))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks).flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def nearest_batch(queries: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """query_id, word, similarity, place: the words most similar to each of many vectors.

    ``queries``: query_id, vector, skips (array of words left out, or null); ``words``: word,
    embedding.  Both sides are cut into blocks, each pair of blocks is one product of matrices
    with its best words kept, and the best of all blocks follow by rank.  Rows with a null
    vector or word take no part.
    """
    if limit < 1:
        return words.sparkSession.createDataFrame([], "query_id long, word string, similarity double, place int")
    asked = queries.where("vector is not null")
    held = words.where("embedding is not null and word is not null")
    many_queries, many_words = _blocks(asked, "query_id"), _blocks(held, "word")
    left = asked.select(
        F.pmod(F.xxhash64("query_id"), F.lit(many_queries)).alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(many_words - 1))).alias("b"),
        "query_id", F.col("vector").cast("array<double>").alias("vector"), "skips",
    )
    right = held.select(
        F.explode(F.sequence(F.lit(0), F.lit(many_queries - 1))).alias("c"),
        F.pmod(F.xxhash64("word"), F.lit(many_words)).alias("d"),
        "word", F.col("embedding").cast("array<double>").alias("embedding"),
    )
    kind = dict(queries.dtypes)["query_id"]

    def best(q: pa.Table, w: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", q.schema.field("query_id").type), ("word", pa.string()), ("similarity", pa.float64())])
        if not len(q) or not len(w):
            return schema.empty_table()
        names = np.array(w.column("word").to_pylist(), object)
        order = np.array(sorted(range(len(names)), key=lambda i: names[i].encode()))
        names, base = names[order], _matrix(w.column("embedding"))[order]
        number = {n: i for i, n in enumerate(names)}
        score = _matrix(q.column("vector")) @ base.T
        for i, skips in enumerate(q.column("skips").to_pylist()):
            score[i, [number[s] for s in skips or () if s in number]] = -np.inf
        top = min(limit, len(names))
        # All that reach the last kept score, so that ties are settled by the word.
        least = np.partition(score, len(names) - top, axis=1)[:, [len(names) - top]]
        row, column = np.nonzero((score >= least) & (score > -np.inf))
        by = np.lexsort((column, -score[row, column], row))
        row, column = row[by], column[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < top], column[place < top]
        return pa.table([q.column("query_id").take(pa.array(row)), pa.array(names[column], pa.string()), pa.array(score[row, column])], schema=schema)

    hits = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(best, f"query_id {kind}, word string, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "word")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def word_similarity_batch(model: EmbeddingModel, queries: DataFrame, limit: int) -> DataFrame:
    """query_id (the word), word, similarity, place for many words; ``queries``: word.  Words
    without a vector give no row."""
    vectors = lookup_distinct(queries, model)
    asked = vectors.select(F.col("word").alias("query_id"), F.col("embedding").alias("vector"), F.array("word").alias("skips"))
    return nearest_batch(asked, model.words, limit)


def embedding_similarity_batch(model: EmbeddingModel, queries: DataFrame, limit: int) -> DataFrame:
    """nearest_batch() with every vector normalized first; ``queries``: query_id, vector, skips."""
    asked = queries.select("query_id", l2_normalize(F.col("vector")).alias("vector"), "skips")
    return nearest_batch(asked, model.words, limit)


def _three(model: EmbeddingModel, queries: DataFrame) -> DataFrame:
    """query_id, and vectors and words of each query's a, b and c; a vector is null if absent."""
    listed = queries.select("query_id", F.posexplode(F.array("a", "b", "c")).alias("at", "word"))
    vectors = lookup_distinct(listed, model).select("word", "embedding")
    joined = listed.join(vectors, "word", "left")
    picked = [F.max(F.when(F.col("at") == i, F.col("embedding"))).alias(f"v{i}") for i in range(3)]
    return queries.select("query_id", "a", "b", "c").join(joined.groupBy("query_id").agg(*picked), "query_id")


def analogy_presence(model: EmbeddingModel, queries: DataFrame) -> DataFrame:
    """query_id, a_present, b_present, c_present.  ``queries``: query_id, a, b, c."""
    flags = [F.col(f"v{i}").isNotNull().alias(f"{n}_present") for i, n in enumerate("abc")]
    return _three(model, queries).select("query_id", *flags)


def analogy_batch(model: EmbeddingModel, queries: DataFrame, limit: int, remove: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """analogy() for many queries; those with an absent word give no row."""
    found = _three(model, queries).where("v0 is not null and v1 is not null and v2 is not null")
    offset = analogy_offset(F.col("v0"), F.col("v1"), F.col("v2"))
    skips = F.array(*[F.col(n) for n, flag in zip("abc", remove) if flag]).cast("array<string>")
    asked = found.select("query_id", l2_normalize(offset).alias("vector"), skips.alias("skips"))
    return nearest_batch(asked, model.words, limit)
