"""Queries of lookup, similarity, sub-words and quantization over the test tables.

The model: words and vectors of ``word_vectors`` (the first row of each word), buckets from
``embeddings``; words to look up from ``vocab_words``.  A vector is compared by its length and
by ``mark``, the sum of its components times their places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import ngrams as g
from wordloom.functions import vector as v
from wordloom.functions.indexers import FastTextIndexer, FloretIndexer, HashIndexer, numbered_rows
from wordloom.model import EmbeddingModel, Subwords
from wordloom.operators import lookup, quantize, similarity, subwords
from wordloom.runtime import table

MIN_N, MAX_N, NATIVE_BITS, FASTTEXT_BUCKETS = 3, 6, 21, 2_000_000
LIMIT = 10
TRIPLE = ("1", "2", "3")


def mark(vector: Column, digits: int = 5) -> Column:
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), digits) + 0.0


def rounded(value: Column) -> Column:
    return F.round(value.cast("double"), 6) + 0.0


MARK = "round(list_sum(list_transform({0}, lambda x, i: x::DOUBLE * i)), 5) + 0.0"


def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table embeddings as words: the vec_id is the word."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("word"), F.col("vec_id").alias("idx"), "embedding", F.lit(None).cast("float").alias("norm")
    )


def plain_model(spark: SparkSession, sf_dir: str) -> EmbeddingModel:
    return EmbeddingModel(plain_words(spark, sf_dir), 64)


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "word_vectors").where("word is not null and embedding is not null")
    first = rows.groupBy("word").agg(F.min_by(F.struct("row_id", "embedding", "norm"), "row_id").alias("r"))
    return numbered_rows(first.select("word", "r.row_id", "r.embedding", "r.norm"), "row_id", "idx").select(
        "word", F.col("idx").cast("long").alias("idx"), "embedding", "norm"
    )


def bucket_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = table(spark, sf_dir, "embeddings")
    order = rows.agg(F.min("vec_id"), F.count("*")).first()
    return rows.select((F.col("vec_id") - order[0]).alias("bucket"), "embedding"), order[1]


def corpus_model(spark: SparkSession, sf_dir: str) -> EmbeddingModel:
    buckets, count = bucket_rows(spark, sf_dir)
    return EmbeddingModel(corpus_words(spark, sf_dir), 64, Subwords(FastTextIndexer(count), MIN_N, MAX_N), buckets)


def native_model(spark: SparkSession, sf_dir: str) -> EmbeddingModel:
    own = HashIndexer(8)
    buckets = bucket_rows(spark, sf_dir)[0].where(F.col("bucket") < own.upper_bound)
    return EmbeddingModel(corpus_words(spark, sf_dir), 64, Subwords(own, MIN_N, MAX_N), buckets)


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vocab_words").select("word").where("word is not null").distinct()


_WORDS = """
words AS (SELECT word, row_number() OVER (ORDER BY row_id) - 1 AS idx, embedding, norm FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY row_id) AS k FROM word_vectors
  WHERE word IS NOT NULL AND embedding IS NOT NULL) WHERE k = 1),
asked AS (SELECT DISTINCT word FROM vocab_words WHERE word IS NOT NULL),
buckets AS (SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS bucket, embedding FROM embeddings)
"""


def _grams(source: str) -> str:
    return f"""
marked AS (SELECT word, '<' || word || '>' AS m FROM {source}),
starts AS (SELECT word, m, unnest(range(1, length(m) - {MIN_N} + 2)) AS i FROM marked),
grams AS (SELECT word, unnest(list_transform(range({MIN_N}, least({MAX_N}, length(m) - i + 1) + 1), lambda n: substring(m, i, n))) AS ngram FROM starts)
"""


def _fold(offset: int, body: str, items: str) -> str:
    return f"list_reduce(list_concat([{offset}::BIGINT], {items}), lambda h, b: {body})"


def _native(ngram: str, bits: int) -> str:
    size = 1 << bits
    length = f"list_transform(range(0, 8), lambda k: (strlen_chars >> (8 * k)) & 255)"
    points = f"flatten(list_transform(string_split({ngram}, ''), lambda c: list_transform(range(0, 4), lambda k: (ord(c)::BIGINT >> (8 * k)) & 255)))"
    items = f"list_concat({length.replace('strlen_chars', f'length({ngram})')}, {points})"
    return _fold(g.OFFSET_64 % size, f"(xor(h, b) * {g.PRIME_64 % size}) % {size}", items)


def _fasttext(ngram: str) -> str:
    """The hash in SQL; the UTF-8 bytes are taken from the hexadecimal form."""
    items = (
        f"list_transform(range(0, strlen({ngram})), lambda k: "
        f"(('0x' || substring(hex(encode({ngram})), 2 * k + 1, 2))::BIGINT))"
    )
    wide = "CASE WHEN b > 127 THEN b | 4294967040 ELSE b END"
    return _fold(g.OFFSET_32, f"(xor(h, {wide}) * {g.PRIME_32}) & 4294967295", items)


_UNKNOWN = "unknown AS (SELECT word FROM asked WHERE word NOT IN (SELECT word FROM words))"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# Vector arithmetic


@query("SELECT row_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM word_vectors WHERE embedding IS NOT NULL")
def vector_norms(spark, d):
    rows = table(spark, d, "word_vectors").where("embedding is not null")
    return rows.select("row_id", rounded(v.l2_norm(F.col("embedding"))).alias("length"))


@query(
    "WITH n AS (SELECT row_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM word_vectors WHERE embedding IS NOT NULL)"
    f" SELECT row_id, {MARK.format('list_transform(embedding, lambda x: CASE WHEN length = 0 THEN x ELSE x / length END)')} AS mark FROM n"
)
def normalize(spark, d):
    rows = table(spark, d, "word_vectors").where("embedding is not null").withColumn("length", v.l2_norm(F.col("embedding")))
    return rows.select("row_id", mark(v.l2_normalize(F.col("embedding"), F.col("length"))).alias("mark"))


@query(
    f"SELECT row_id, {MARK.format('list_transform(embedding, lambda x: (x::DOUBLE * coalesce(norm, 1))::FLOAT)').replace(', 5)', ', 3)')} AS mark FROM word_vectors WHERE embedding IS NOT NULL"
)
def unnormalize(spark, d):
    rows = table(spark, d, "word_vectors").where("embedding is not null")
    return lookup.unnormalized(rows).select("row_id", mark(F.col("embedding"), 3).alias("mark"))


@query("""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), s AS (
  SELECT vec_id, greatest(-1, least(1, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS s FROM embeddings e, q)
SELECT vec_id, round(s, 6) + 0.0 AS cosine, round(1 - acos(s) / pi(), 6) + 0.0 AS angular,
  round(sqrt(2 - 2 * s), 6) + 0.0 AS distance, round(1 - sqrt(2 - 2 * s) / 2, 6) + 0.0 AS euclidean FROM s
""")
def score_conversions(spark, d):
    rows = table(spark, d, "embeddings")
    first = rows.orderBy("vec_id").first()
    score = v.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first.embedding]))
    scored = rows.select("vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("s"))
    s = F.col("s")
    return scored.select(
        "vec_id", rounded(v.cosine_similarity(s)).alias("cosine"), rounded(v.angular_similarity(s)).alias("angular"),
        rounded(v.euclidean_distance(s)).alias("distance"), rounded(v.euclidean_similarity(s)).alias("euclidean"),
    )


# Similarity

_PLAIN = "w AS (SELECT vec_id::VARCHAR AS word, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _top(vector: str, where: str, source: str) -> str:
    return (
        f"SELECT w.word, round(s, 6) + 0.0 AS similarity FROM (SELECT w.word, list_dot_product(w.e, {vector}) AS s FROM w, {source} WHERE {where}) w"
        f" ORDER BY s DESC, word LIMIT {LIMIT}"
    )


_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_OFFSET = "(SELECT list_transform(list_zip(a.e, b.e, c.e), lambda t: t[2] - t[1] + t[3]) AS o FROM w a, w b, w c WHERE a.word = '1' AND b.word = '2' AND c.word = '3')"


def _scores(rows: DataFrame) -> DataFrame:
    return rows.withColumn("similarity", rounded(F.col("similarity")))


@query(f"WITH {_PLAIN} " + _top("q.e", "w.word <> q.word", "(SELECT * FROM w WHERE word = '7') q"))
def word_similarity(spark, d):
    return _scores(similarity.word_similarity(plain_model(spark, d), "7", LIMIT))


@query(f"WITH {_PLAIN}, q AS (SELECT {_UNIT.format('e')} AS u FROM w WHERE word = '5') " + _top("q.u", "true", "q"))
def embedding_similarity(spark, d):
    vector = table(spark, d, "embeddings").where("vec_id = 5").first().embedding
    return _scores(similarity.embedding_similarity(plain_model(spark, d), [3 * x for x in vector], LIMIT))


@query(f"WITH {_PLAIN}, q AS (SELECT {_UNIT.format('e')} AS u FROM w WHERE word = '5') " + _top("q.u", "label <> 3", "q"))
def embedding_similarity_masked(spark, d):
    rows = table(spark, d, "embeddings")
    skips = rows.where("label = 3").select(F.col("vec_id").cast("string").alias("word"))
    vector = rows.where("vec_id = 5").first().embedding
    return _scores(similarity.embedding_similarity_masked(plain_model(spark, d), list(vector), LIMIT, skips))


@query(f"WITH {_PLAIN}, q AS (SELECT {_UNIT.format('o')} AS u FROM {_OFFSET}) " + _top("q.u", "word NOT IN ('1', '2', '3')", "q"))
def analogy(spark, d):
    return _scores(similarity.analogy(plain_model(spark, d), TRIPLE, LIMIT))


@query(f"WITH {_PLAIN}, q AS (SELECT {_UNIT.format('o')} AS u FROM {_OFFSET}) " + _top("q.u", "word NOT IN ('1')", "q"))
def analogy_masked(spark, d):
    return _scores(similarity.analogy(plain_model(spark, d), TRIPLE, LIMIT, (True, False, False)))


@query(f"""
WITH {_PLAIN}, q AS (SELECT * FROM w WHERE vec_id % 100 = 0),
s AS (SELECT q.word AS query_id, w.word, list_dot_product(w.e, q.e) AS s FROM q JOIN w ON q.word <> w.word),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, word) AS place FROM s)
SELECT query_id, word, round(s, 6) + 0.0 AS similarity, place FROM r WHERE place <= {LIMIT}
""")
def word_similarity_batch(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("word"))
    return _scores(similarity.word_similarity_batch(plain_model(spark, d), asked, LIMIT))


@query(f"""
WITH q AS (SELECT row_id, {_UNIT.format('embedding::DOUBLE[]')} AS u FROM word_vectors WHERE row_id % 100 = 0 AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
w AS (SELECT vec_id::VARCHAR AS word, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT row_id AS query_id, word, list_dot_product(e, u) AS s FROM q, w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, word) AS place FROM s)
SELECT query_id, word, round(s, 6) + 0.0 AS similarity, place FROM r WHERE place <= {LIMIT}
""")
def embedding_similarity_batch(spark, d):
    rows = table(spark, d, "word_vectors").where("row_id % 100 = 0 and embedding is not null")
    rows = rows.where(v.l2_norm(F.col("embedding")) > 0)
    asked = rows.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("array<string>").alias("skips"))
    return _scores(similarity.embedding_similarity_batch(plain_model(spark, d), asked, LIMIT))


_TRIPLES = "t AS (SELECT a.vec_id AS query_id, a.word AS a, (a.vec_id + 1)::VARCHAR AS b, (a.vec_id + 2)::VARCHAR AS c FROM w a WHERE a.vec_id % 3 = 0)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id % 3 = 0")
    text = lambda c: c.cast("string")
    return rows.select(
        F.col("vec_id").alias("query_id"), text(F.col("vec_id")).alias("a"), text(F.col("vec_id") + 1).alias("b"), text(F.col("vec_id") + 2).alias("c")
    )


@query(f"""
WITH {_PLAIN}, {_TRIPLES}, o AS (SELECT query_id, t.a, t.b, t.c, list_transform(list_zip(a.e, b.e, c.e), lambda x: x[2] - x[1] + x[3]) AS o
  FROM t JOIN w a ON a.word = t.a JOIN w b ON b.word = t.b JOIN w c ON c.word = t.c),
u AS (SELECT *, {_UNIT.format('o')} AS u FROM o),
s AS (SELECT query_id, word, list_dot_product(e, u) AS s FROM u, w WHERE word NOT IN (u.a, u.b, u.c)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, word) AS place FROM s)
SELECT query_id, word, round(s, 6) + 0.0 AS similarity, place FROM r WHERE place <= {LIMIT}
""")
def analogy_batch(spark, d):
    return _scores(similarity.analogy_batch(plain_model(spark, d), _triples(spark, d), LIMIT))


@query(f"""
WITH {_PLAIN}, {_TRIPLES} SELECT query_id, a IN (SELECT word FROM w) AS a_present, b IN (SELECT word FROM w) AS b_present,
  c IN (SELECT word FROM w) AS c_present FROM t
""")
def analogy_presence(spark, d):
    return similarity.analogy_presence(plain_model(spark, d), _triples(spark, d))


# Vocabulary and lookup


@query(f"WITH {_WORDS} SELECT (SELECT count(*) FROM words) AS words_len, (SELECT count(*) FROM words) + (SELECT count(*) FROM buckets) AS vocab_len, 64 AS dims")
def vocab_stats(spark, d):
    model = corpus_model(spark, d).checked()
    return spark.createDataFrame([(len(model), *model.shape)], "words_len long, vocab_len long, dims int")


@query(f"WITH {_WORDS} SELECT idx, word, round(coalesce(norm, 1)::DOUBLE, 6) AS norm FROM words")
def iter_with_norms(spark, d):
    model = corpus_model(spark, d)
    return lookup.iter_words(model, True).join(model.words.select("word", "idx"), "word").select("idx", "word", rounded(F.col("norm")).alias("norm"))


@query(
    f"WITH {_WORDS}, m AS (SELECT idx, embedding FROM words UNION ALL SELECT bucket + (SELECT count(*) FROM words), embedding FROM buckets)"
    f" SELECT idx, {MARK.format('embedding')} AS mark FROM m"
)
def storage_rows(spark, d):
    return corpus_model(spark, d).storage().select("idx", mark(F.col("embedding")).alias("mark"))


@query(
    f"WITH {_WORDS}, m AS (SELECT word_id AS pos, idx % (SELECT count(*) FROM words) AS idx FROM vocab_words)"
    f" SELECT pos, m.idx, {MARK.format('embedding')} AS mark FROM m JOIN words ON m.idx = words.idx"
)
def gather_rows(spark, d):
    model = corpus_model(spark, d)
    asked = table(spark, d, "vocab_words").select(F.col("word_id").alias("pos"), (F.col("idx") % len(model)).alias("idx"))
    return lookup.gather(asked, model).select("pos", "idx", mark(F.col("embedding")).alias("mark"))


@query(
    f"WITH {_WORDS} SELECT n - 1 - idx AS idx, {MARK.format('embedding')} AS mark FROM words, (SELECT count(*) AS n FROM words)"
)
def clone_from_mapping(spark, d):
    model = corpus_model(spark, d)
    mapping = model.words.select((F.lit(len(model) - 1) - F.col("idx")).alias("new_idx"), F.col("idx").alias("old_idx"))
    return lookup.clone_from_mapping(mapping, model).select("idx", mark(F.col("embedding")).alias("mark"))


@query(f"WITH {_WORDS} SELECT asked.word, idx, {MARK.format('embedding')} AS mark FROM asked JOIN words ON asked.word = words.word")
def known_lookup(spark, d):
    model = EmbeddingModel(corpus_words(spark, d), 64)
    found = lookup.lookup_distinct(asked_words(spark, d), model)
    return found.join(model.words.select("word", "idx"), "word").select("word", "idx", mark(F.col("embedding")).alias("mark"))


# Sub-words


@query(f"WITH {_WORDS}, {_grams('asked')} SELECT ngram, count(*) AS n FROM grams GROUP BY ngram")
def ngrams(spark, d):
    rows = subwords.ngram_rows(asked_words(spark, d), Subwords(HashIndexer(NATIVE_BITS), MIN_N, MAX_N))
    return rows.groupBy("ngram").agg(F.count("*").alias("n"))


def _distinct_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return subwords.ngram_rows(asked_words(spark, d), Subwords(HashIndexer(NATIVE_BITS), MIN_N, MAX_N)).select("ngram").distinct()


@query(f"WITH {_WORDS}, {_grams('asked')}, x AS (SELECT DISTINCT ngram FROM grams) SELECT ngram, {_native('ngram', NATIVE_BITS)} AS bucket FROM x")
def native_hash(spark, d):
    return _distinct_ngrams(spark, d).select("ngram", g.fnv_low_bits(F.col("ngram"), NATIVE_BITS).alias("bucket"))


@query(f"WITH {_WORDS}, {_grams('asked')}, x AS (SELECT DISTINCT ngram FROM grams) SELECT ngram, {_fasttext('ngram')} % {FASTTEXT_BUCKETS} AS bucket FROM x")
def fasttext_hash(spark, d):
    return _distinct_ngrams(spark, d).select("ngram", g.fasttext_bucket(F.col("ngram"), FASTTEXT_BUCKETS).alias("bucket"))


FLORET_BUCKETS, FLORET_SEED = 65535, 42


def _murmur(source: str, seed: int) -> str:
    """CTEs: ``hashed``, with both halves of MurmurHash3 x64-128 of ``ngram``, of less than 32 bytes."""
    times = lambda x, y: f"(({x})::UHUGEINT * {y}::UHUGEINT % 18446744073709551616::UHUGEINT)"
    plus = lambda x, y: f"((({x})::UHUGEINT + ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    turn = lambda x, r: f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % 18446744073709551616::UHUGEINT + ({x})::UHUGEINT // {1 << 64 - r}::UHUGEINT)"
    both = lambda x, y: f"xor(({x})::UBIGINT, ({y})::UBIGINT)"
    high = lambda x: f"(({x})::UBIGINT >> 33)"
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    word = lambda at: f"(('0x' || array_to_string(list_reverse(list_transform(range(0, 8), lambda k: CASE WHEN {at} + k < size THEN substring(h, 2 * ({at} + k) + 1, 2) ELSE '00' END)), ''))::UBIGINT)"
    mixed1 = lambda k: times(turn(times(k, c1), 31), c2)
    mixed2 = lambda k: times(turn(times(k, c2), 33), c1)
    steps = [
        ("b0", source, f"*, hex(encode(ngram)) AS h, strlen(ngram) AS size, {seed}::UBIGINT AS s"),
        ("b1", "b0", f"*, {word('0')} AS w0, {word('8')} AS w1, {word('16')} AS w2, {word('24')} AS w3"),
        ("b2", "b1", f"*, {mixed1('w0')} AS k0, {mixed2('w1')} AS k1, {mixed1('w2')} AS k2, {mixed2('w3')} AS k3"),
        ("b3", "b2", f"*, {plus(times(plus(turn(both('s', 'k0'), 27), 's'), 5), 0x52DCE729)} AS m1"),
        ("b4", "b3", f"*, {plus(times(plus(turn(both('s', 'k1'), 31), 'm1'), 5), 0x38495AB5)} AS m2"),
        ("b5", "b4", f"*, CASE WHEN size >= 16 THEN {both('m1', 'k2')} ELSE {both('s', 'k0')} END AS t1, CASE WHEN size >= 16 THEN {both('m2', 'k3')} ELSE {both('s', 'k1')} END AS t2"),
        ("b6", "b5", f"*, {both('t1', 'size')} AS u1, {both('t2', 'size')} AS u2"),
        ("b7", "b6", f"*, {plus('u1', 'u2')} AS v1"),
        ("b8", "b7", f"*, {plus('u2', 'v1')} AS v2"),
        ("b9", "b8", f"*, {times(both('v1', high('v1')), 0xFF51AFD7ED558CCD)} AS x1, {times(both('v2', high('v2')), 0xFF51AFD7ED558CCD)} AS x2"),
        ("b10", "b9", f"*, {times(both('x1', high('x1')), 0xC4CEB9FE1A85EC53)} AS y1, {times(both('x2', high('x2')), 0xC4CEB9FE1A85EC53)} AS y2"),
        ("b11", "b10", f"*, {both('y1', high('y1'))} AS z1, {both('y2', high('y2'))} AS z2"),
        ("b12", "b11", f"*, {plus('z1', 'z2')}::UBIGINT AS h1"),
        ("hashed", "b12", f"ngram, h1, {plus('z2', 'h1')}::UBIGINT AS h2"),
    ]
    return ", ".join(f"{name} AS MATERIALIZED (SELECT {columns} FROM {of})" for name, of, columns in steps)


@query(f"""WITH {_WORDS}, {_grams('asked')}, x AS (SELECT DISTINCT ngram FROM grams), {_murmur('x', FLORET_SEED)}
SELECT ngram, ((h1 % 4294967296) % {FLORET_BUCKETS})::BIGINT AS bucket_0, ((h1 // 4294967296) % {FLORET_BUCKETS})::BIGINT AS bucket_1,
  ((h2 % 4294967296) % {FLORET_BUCKETS})::BIGINT AS bucket_2, ((h2 // 4294967296) % {FLORET_BUCKETS})::BIGINT AS bucket_3 FROM hashed""")
def floret_hash(spark, d):
    found = FloretIndexer(FLORET_BUCKETS, 4, FLORET_SEED).buckets_of(_distinct_ngrams(spark, d))
    return found.select("ngram", *[F.col("found")[i].alias(f"bucket_{i}") for i in range(4)])


@query(f"WITH {_WORDS}, {_UNKNOWN} SELECT word, word IN (SELECT word FROM words) AS known FROM asked WHERE word IN (SELECT word FROM words) OR length(word) >= {MIN_N - 2}")
def known_and_unknown(spark, d):
    """The asked words that have a row, and those that have n-grams only."""
    found = lookup.word_index(asked_words(spark, d), corpus_model(spark, d))
    known, unknown = lookup.known_words(found), lookup.unknown_words(found)
    return known.select("word", F.lit(True).alias("known")).unionByName(unknown.select("word", F.lit(False).alias("known")))


_INDEXERS = {
    "bucket_subword": lambda buckets: HashIndexer(buckets.bit_length() - 1),
    "fasttext_subword": lambda buckets: FastTextIndexer(buckets),
}


@query("""SELECT model_id, vocab_kind AS kind, min_n, max_n, bow, eow, buckets AS upper_bound, true AS infallible FROM models
WHERE vocab_kind IN ('bucket_subword', 'fasttext_subword') AND buckets IS NOT NULL AND (vocab_kind = 'fasttext_subword' OR bit_count(buckets) = 1)""")
def subword_parameters(spark, d):
    """The accessors of every hashed vocabulary of the table of models."""
    rows = table(spark, d, "models").where("buckets is not null").collect()  # a row a model
    found = []
    for r in rows:
        if r.vocab_kind not in _INDEXERS or (r.vocab_kind == "bucket_subword" and r.buckets.bit_count() != 1):
            continue
        own = Subwords(_INDEXERS[r.vocab_kind](r.buckets), r.min_n, r.max_n, r.bow, r.eow)
        found.append((r.model_id, own.kind.value, own.min_n, own.max_n, own.bow, own.eow, own.indexer.upper_bound, own.indexer.infallible))
    return spark.createDataFrame(found, "model_id long, kind string, min_n int, max_n int, bow string, eow string, upper_bound long, infallible boolean")


_BY_MODEL = """m AS (SELECT model_id, vocab_kind, min_n, max_n, bow, eow, buckets FROM models WHERE vocab_kind IN ('bucket_subword', 'fasttext_subword') AND buckets IS NOT NULL
  AND (vocab_kind = 'fasttext_subword' OR bit_count(buckets) = 1)),
own AS (SELECT DISTINCT m.*, word, bow || word || eow AS marked FROM vocab_words v JOIN m USING (model_id) WHERE word IS NOT NULL),
begun AS (SELECT *, unnest(range(1, length(marked) - min_n + 2)) AS i FROM own),
pieces AS (SELECT *, unnest(list_transform(range(min_n::BIGINT, least(max_n, length(marked) - i + 1) + 1), lambda n: substring(marked, i, n))) AS ngram FROM begun),
kinds AS (SELECT DISTINCT vocab_kind, ngram FROM pieces)"""


@query(f"""WITH {_BY_MODEL}, f AS (SELECT *, CASE WHEN vocab_kind = 'fasttext_subword' THEN {_fasttext('ngram')} ELSE {_native('ngram', 30)} END AS hash FROM kinds)
SELECT model_id, word, count(*) AS n, sum(hash % buckets)::BIGINT AS total FROM pieces JOIN f USING (vocab_kind, ngram) GROUP BY model_id, word""")
def ngrams_by_model(spark, d):
    """The n-grams of every model's words by its own lengths, markers and buckets: how many a word has
    and the sum of their buckets."""
    models = {r.model_id: r for r in table(spark, d, "models").where("buckets is not null").collect()}  # a row a model
    words = table(spark, d, "vocab_words").where("word is not null").select("model_id", "word").distinct()
    # Models of the same parameters are taken together.
    groups: dict[tuple, list[int]] = {}
    for r in models.values():
        if r.vocab_kind in _INDEXERS and (r.vocab_kind != "bucket_subword" or r.buckets.bit_count() == 1):
            groups.setdefault((r.vocab_kind, r.buckets, r.min_n, r.max_n, r.bow, r.eow), []).append(r.model_id)
    out = spark.createDataFrame([], "model_id long, word string, n long, total long")
    for (kind, buckets, *lengths), members in sorted(groups.items()):
        own = Subwords(_INDEXERS[kind](buckets), *lengths)
        of = words.where(F.col("model_id").isin(members))
        found = subwords.subword_indices(of.select("word").distinct(), own)
        counted = found.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("bucket") * F.col("n")).alias("total"))
        out = out.unionByName(of.join(counted, "word").select("model_id", "word", "n", "total"))
    return out


@query(f"WITH {_WORDS}, {_grams('asked')}, x AS (SELECT word, ngram, count(*) AS n FROM grams GROUP BY ALL), h AS (SELECT *, {_native('ngram', 8)} AS bucket FROM x) SELECT word, bucket, sum(n)::BIGINT AS n FROM h GROUP BY word, bucket")
def subword_indices(spark, d):
    return subwords.subword_indices(asked_words(spark, d), Subwords(HashIndexer(8), MIN_N, MAX_N))


@query(f"WITH {_WORDS}, {_grams('asked')}, h AS (SELECT word, ngram, {_native('ngram', 8)} + (SELECT count(*) FROM words) AS idx FROM grams) SELECT word, count(*) AS n, sum(idx)::BIGINT AS total, min(ngram) AS first FROM h GROUP BY word")
def ngram_indices(spark, d):
    model = native_model(spark, d)
    found = subwords.ngram_indices(asked_words(spark, d), model.subwords, len(model))
    total = F.aggregate("ngram_indices", F.lit(0).cast("long"), lambda s, x: s + x["indices"][0])
    return found.select("word", F.size("ngram_indices").cast("long").alias("n"), total.alias("total"), F.col("ngram_indices")[0]["ngram"].alias("first"))


def _pooled(source: str, bucket: str) -> str:
    return f"""{_grams(source)}, x AS (SELECT word, ngram, count(*) AS n FROM grams GROUP BY ALL),
h AS (SELECT *, {bucket} AS bucket FROM x), c AS (SELECT word, bucket, sum(n) AS n FROM h GROUP BY word, bucket),
p AS (SELECT word, pos, sum(n * embedding[pos]::DOUBLE) AS s, sum(n) AS hits FROM c JOIN buckets USING (bucket), range(1, 65) t(pos) GROUP BY word, pos),
total AS (SELECT word, list(s ORDER BY pos) AS total, max(hits) AS hits FROM p GROUP BY word)"""


_FT_BUCKET = _fasttext("ngram") + " % (SELECT count(*) FROM embeddings)"


@query(f"WITH {_WORDS}, {_UNKNOWN}, {_pooled('unknown', _FT_BUCKET)} SELECT word, hits::BIGINT AS hits, round(sqrt(list_dot_product(total, total)), 5) AS length, {MARK.format('total')} AS mark FROM total")
def oov_pooling(spark, d):
    model = corpus_model(spark, d)
    unknown = asked_words(spark, d).join(model.words, "word", "left_anti")
    found = subwords.pooled(unknown, model)
    return found.select("word", "hits", F.round(v.l2_norm(F.col("total")), 5).alias("length"), mark(F.col("total")).alias("mark"))


_LOOKUP = f"""WITH {_WORDS}, {_UNKNOWN}, {_pooled('unknown', _FT_BUCKET)},
found AS (SELECT asked.word, embedding::DOUBLE[] AS e, coalesce(norm, 1)::DOUBLE AS norm FROM asked JOIN words ON asked.word = words.word
  UNION ALL SELECT word, list_transform(total, lambda x: (x / sqrt(list_dot_product(total, total)))::FLOAT::DOUBLE), sqrt(list_dot_product(total, total)) FROM total)"""


@query(_LOOKUP + " SELECT word, round(norm, 5) AS norm, round(list_sum(list_transform(e, lambda x, i: x * i)), 4) + 0.0 AS mark FROM found")
def lookup_with_norm(spark, d):
    found = lookup.lookup_distinct(asked_words(spark, d), corpus_model(spark, d))
    return found.select("word", F.round("norm", 5).alias("norm"), mark(F.col("embedding"), 4).alias("mark"))


@query(_LOOKUP + " SELECT word_id AS pos, v.word, found.word IS NOT NULL AS found, coalesce(round(list_sum(list_transform(e, lambda x, i: x * i)), 4), 0.0) + 0.0 AS mark FROM vocab_words v LEFT JOIN found ON v.word = found.word")
def lookup_batch(spark, d):
    asked = table(spark, d, "vocab_words").select(F.col("word_id").alias("pos"), "word")
    found = lookup.lookup_batch(asked, corpus_model(spark, d))
    return found.select("pos", "word", "found", mark(F.col("embedding"), 4).alias("mark"))


@query(f"""WITH {_WORDS}, {_UNKNOWN}, {_grams('unknown')}, h AS (SELECT word, {_FT_BUCKET} + (SELECT count(*) FROM words) AS idx FROM grams),
s AS (SELECT word, count(*) AS n, sum(idx) AS total FROM h GROUP BY word)
SELECT asked.word, words.idx AS word_idx, coalesce(n, 0) AS n, coalesce(total, 0)::BIGINT AS total FROM asked LEFT JOIN words ON asked.word = words.word LEFT JOIN s ON asked.word = s.word""")
def word_indices(spark, d):
    found = lookup.word_index(asked_words(spark, d), corpus_model(spark, d))
    total = F.aggregate("subword_idx", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("word", "word_idx", F.coalesce(F.size("subword_idx"), F.lit(0)).cast("long").alias("n"), F.coalesce(total, F.lit(0)).alias("total"))


_EXPLICIT = f"""{_grams('words')}, x AS (SELECT DISTINCT ngram FROM grams), h AS (SELECT ngram, {_native('ngram', 8)} AS old FROM x),
k AS (SELECT old, row_number() OVER (ORDER BY min(ngram)) - 1 AS new FROM h GROUP BY old)"""


@query(f"WITH {_WORDS}, {_EXPLICIT} SELECT ngram, new AS bucket FROM h JOIN k USING (old)")
def explicit_conversion(spark, d):
    return subwords.to_explicit(native_model(spark, d)).subwords.indexer.table.select("ngram", "bucket")


@query(f"""WITH {_WORDS}, {_EXPLICIT}, {_UNKNOWN}, {_grams('unknown').replace('marked', 'marked2').replace('starts', 'starts2').replace('grams', 'grams2')},
c AS (SELECT word, new, old, count(*) AS n FROM grams2 JOIN h USING (ngram) JOIN k USING (old) GROUP BY ALL),
p AS (SELECT word, pos, sum(n * embedding[pos]::DOUBLE) AS s, sum(n) AS hits FROM c JOIN buckets ON c.old = buckets.bucket, range(1, 65) t(pos) GROUP BY word, pos),
total AS (SELECT word, list(s ORDER BY pos) AS total, max(hits) AS hits FROM p GROUP BY word)
SELECT word, hits::BIGINT AS hits, {MARK.format('total')} AS mark FROM total""")
def explicit_lookup(spark, d):
    model = subwords.to_explicit(native_model(spark, d))
    unknown = asked_words(spark, d).join(model.words, "word", "left_anti")
    return subwords.pooled(unknown, model).select("word", "hits", mark(F.col("total")).alias("mark"))


_COMPOSE = f"WITH {_WORDS}, {_pooled('words', _FT_BUCKET)}"


@query(_COMPOSE + f" SELECT words.word, round(list_sum(list_transform(CASE WHEN total IS NULL THEN embedding::DOUBLE[] ELSE list_transform(list_zip(embedding::DOUBLE[], total), lambda t: ((t[1] + t[2]) * (1 / (hits + 1)::DOUBLE))::FLOAT::DOUBLE) END, lambda x, i: x * i)), 4) + 0.0 AS mark FROM words LEFT JOIN total ON words.word = total.word")
def fasttext_compose(spark, d):
    return subwords.compose_words(corpus_model(spark, d)).select("word", mark(F.col("embedding"), 4).alias("mark"))


@query(_COMPOSE + f" SELECT words.word, round(list_sum(list_transform(CASE WHEN total IS NULL THEN list_transform(embedding::DOUBLE[], lambda x: (x * coalesce(norm, 1))::FLOAT::DOUBLE) ELSE list_transform(list_zip(embedding::DOUBLE[], total), lambda t: (t[1] * coalesce(norm, 1) * (hits + 1) - t[2])::FLOAT::DOUBLE) END, lambda x, i: x * i)), 3) + 0.0 AS mark FROM words LEFT JOIN total ON words.word = total.word")
def fasttext_decompose(spark, d):
    return subwords.decompose_words(corpus_model(spark, d)).select("word", mark(F.col("embedding"), 3).alias("mark"))


# Quantization


@query("""
WITH size AS (SELECT quantizer_id, count(DISTINCT sub) AS subs FROM pq_books GROUP BY quantizer_id),
c AS (SELECT row_id, quantizer_id, norm, len(codes) AS n, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS sub FROM pq_codes JOIN models USING (model_id) WHERE codes IS NOT NULL),
p AS (SELECT c.row_id, any_value(c.quantizer_id) AS quantizer_id, any_value(norm) AS norm, count(vec) AS known, any_value(n) AS n, list(vec ORDER BY c.sub) AS parts
  FROM c LEFT JOIN pq_books b ON b.quantizer_id = c.quantizer_id AND b.sub = c.sub AND b.centroid = c.code GROUP BY c.row_id)
SELECT row_id, round(list_sum(list_transform(flatten(parts), lambda x, i: (x * coalesce(norm, 1::FLOAT))::FLOAT::DOUBLE * i)), 4) + 0.0 AS mark
FROM p JOIN size USING (quantizer_id) WHERE known = n AND n = subs
""")
def pq_decode(spark, d):
    names = ("pq_codes", "pq_books", "models")
    codes, books, models = (table(spark, d, n) for n in names)
    rows = codes.join(models.select("model_id", "quantizer_id"), "model_id")
    found = quantize.decode_rows(rows, books).where("embedding is not null")
    return found.select("row_id", mark(F.col("embedding"), 4).alias("mark"))


@query("""
WITH size AS (SELECT quantizer_id, count(DISTINCT sub) AS subs FROM pq_books GROUP BY quantizer_id),
q AS (SELECT quantizer_id, sub, centroid, vec::DOUBLE[] AS vec, subs FROM pq_books JOIN size USING (quantizer_id)),
p AS (SELECT row_id, quantizer_id, sub, centroid, list_sum(list_transform(list_zip(embedding[sub * (64 // subs) + 1 : (sub + 1) * (64 // subs)]::DOUBLE[], vec), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist
  FROM word_vectors, q WHERE embedding IS NOT NULL)
SELECT quantizer_id, row_id, sub, arg_min(centroid, (dist, centroid)) AS code FROM p GROUP BY quantizer_id, row_id, sub
""")
def pq_encode(spark, d):
    """Every row by every codebook."""
    books, out = table(spark, d, "pq_books"), None
    for r in sorted(books.select("quantizer_id").distinct().collect()):  # a row a codebook
        coded = quantize.encode_rows(table(spark, d, "word_vectors"), quantize.Quantizer.from_books(books, r.quantizer_id), "row_id")
        own = coded.select(F.lit(r.quantizer_id).alias("quantizer_id"), "row_id", F.posexplode("codes").alias("sub", "code"))
        out = own if out is None else out.unionByName(own)
    return out


@query(SQL["pq_decode"])
def pq_reconstruct(spark, d):
    """pq_decode by the codebooks as matrices, for the rows whose codes can be decoded."""
    codes, books, models = (table(spark, d, n) for n in ("pq_codes", "pq_books", "models"))
    rows, out = codes.join(models.select("model_id", "quantizer_id"), "model_id"), None
    for r in sorted(books.select("quantizer_id").distinct().collect()):  # a row a codebook
        own = quantize.Quantizer.from_books(books, r.quantizer_id)
        fits = (F.size("codes") == own.quantized_len) & ~F.exists("codes", lambda c: c.isNull() | (c < 0) | (c >= own.centroids.shape[1]))
        good = rows.where(F.col("quantizer_id") == r.quantizer_id).where(fits)
        found = quantize.reconstruct(good.select("row_id", "codes", "norm"), own, "row_id")
        found = found.select("row_id", mark(F.col("embedding"), 4).alias("mark"))
        out = found if out is None else out.unionByName(found)
    return out


# Trained quantizers have no single right result: what is stated are the bounds they keep.


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "word_vectors").select(F.col("row_id").alias("idx"), "embedding")


@query("""SELECT row_id AS idx, true AS nearest, true AS within_length FROM word_vectors WHERE embedding IS NOT NULL""")
def pq_train(spark, d):
    """Every row under a quantizer trained on all rows: whether its codes name the nearest centroids,
    found by comparing it with each, and whether the decoded vector is off by less than its length."""
    rows = _vectors(spark, d).where("embedding is not null")
    quantizer, _ = quantize.train(rows, 8, 4, iterations=5, normalize=True)
    coded = quantize.encode_rows(rows, quantizer, "idx", normalize=True)
    back = quantize.reconstruct(coded, quantizer, "idx").withColumnRenamed("embedding", "decoded")
    unit = v.l2_normalize(F.col("embedding"), v.l2_norm(F.col("embedding")))
    width = quantizer.reconstructed_len // quantizer.quantized_len
    parts = rows.select("idx", F.posexplode(F.array(*[F.slice(unit, 1 + q * width, width) for q in range(quantizer.quantized_len)])).alias("sub", "part"))
    gaps = F.aggregate(F.zip_with("part", "vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    books = quantizer.books(spark).select("sub", "centroid", "vec")
    near = parts.join(books, "sub").groupBy("idx", "sub").agg(F.min(gaps).alias("least"))
    named = coded.select("idx", F.posexplode("codes").alias("sub", "centroid"))
    told = parts.join(named, ["idx", "sub"]).join(books, ["sub", "centroid"]).select("idx", "sub", gaps.alias("gap"))
    best = told.join(near, ["idx", "sub"]).groupBy("idx").agg(F.bool_and(F.col("gap") <= F.col("least") + 1e-5).alias("nearest"))
    length = v.l2_norm(F.col("embedding"))
    gap = v.l2_norm(v.subtract(F.col("embedding"), F.col("decoded")))
    return rows.join(back, "idx").select("idx", (gap <= length).alias("within_length")).join(best, "idx")


@query("""SELECT * FROM (VALUES ('pq', true, true, false), ('opq', true, true, true)) t(quantizer, better_than_one_centroid, improves, orthogonal)""")
def opq_train(spark, d):
    """Of a plain and a rotated quantizer over all rows: whether the loss is below that of one centroid,
    whether more steps make it no greater, and whether there is a rotation, which keeps lengths."""
    rows, found = _vectors(spark, d).where("embedding is not null"), []
    moments = rows.select(F.posexplode(v.l2_normalize(F.col("embedding"), v.l2_norm(F.col("embedding")))).alias("at", "x"))
    spread = moments.groupBy("at").agg(F.var_pop("x").alias("s")).agg(F.sum("s")).first()[0]
    for name in ("pq", "opq"):
        first, later = (quantize.train(rows, 8, 4, iterations=n, normalize=True, rotate=name == "opq") for n in (1, 5))
        turned = later[0].projection
        found.append((name, later[1] < spread, later[1] <= first[1] + 1e-9, turned is not None and bool(np.allclose(turned @ turned.T, np.eye(len(turned)), atol=1e-6))))
    return spark.createDataFrame(found, "quantizer string, better_than_one_centroid boolean, improves boolean, orthogonal boolean")
