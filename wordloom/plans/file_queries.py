"""Queries that write the corpus model in a format and read it again."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.indexers import FloretIndexer
from wordloom.functions.vector import scale, to_float
from wordloom.model import EmbeddingModel, Subwords
from wordloom.operators import quantize, similarity
from wordloom.operators.subwords import normalized_words, to_explicit
from wordloom.plans.model_queries import SQL as MODEL_SQL
from wordloom.plans.model_queries import _WORDS, MARK, bucket_rows, corpus_model, corpus_words, mark, native_model, rounded
from wordloom.runtime import shared_folder, table
from wordloom.sources import fasttext, floret, native, text, toml, word2vec
from wordloom.sources.files import OrderedFile, float_bytes, row_slices

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _place(spark: SparkSession) -> str:
    """A new file in the shared folder, which must be one that tasks can open; removed at the end."""
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"model files need a shared folder that tasks can open by its path, not {folder}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"wordloom-model-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    os.makedirs(path)
    return os.path.join(path, "model")


def _listed(model: EmbeddingModel) -> DataFrame:
    return model.words.select("word", "idx", rounded(F.coalesce("norm", F.lit(1.0))).alias("norm"), mark(F.col("embedding"), 3).alias("mark"))


_ALL = f"WITH {_WORDS} SELECT word, idx, {{norm}} AS norm, {MARK.format('embedding').replace(', 5)', ', 3)')} AS mark FROM words"
_PLAIN = _ALL.format(norm="1.0::DOUBLE")
_NORMED = _ALL.format(norm="round(coalesce(norm, 1)::DOUBLE, 6)")
_UNIT = f"""WITH {_WORDS}, n AS (SELECT word, idx, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length, embedding FROM words)
SELECT word, idx, round(length::FLOAT::DOUBLE, 6) AS norm,
  round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN length = 0 THEN 0 ELSE (x::DOUBLE * (1 / length))::FLOAT::DOUBLE * i END)), 3) + 0.0 AS mark FROM n"""


def _words_only(spark: SparkSession, d: str) -> EmbeddingModel:
    words = corpus_words(spark, d)
    # Formats of one word a row hold words without white space only.
    return EmbeddingModel(words, 64)


@query(_PLAIN)
def word2vec_round_trip(spark, d):
    path = _place(spark)
    model = _words_only(spark, d)
    spaced = model.words.withColumn("word", F.hex("word"))
    word2vec.write_word2vec_binary(EmbeddingModel(spaced, 64), path)
    back = word2vec.read_word2vec_binary(spark, path, normalize=False)
    return _listed(EmbeddingModel(back.words.withColumn("word", F.decode(F.unhex("word"), "UTF-8")), 64))


@query(_PLAIN)
def text_round_trip(spark, d):
    path = _place(spark)
    spaced = _words_only(spark, d).words.withColumn("word", F.hex("word"))
    text.write_text(EmbeddingModel(spaced, 64), path)
    back = text.read_text(spark, path, normalize=False)
    return _listed(EmbeddingModel(back.words.withColumn("word", F.decode(F.unhex("word"), "UTF-8")), 64))


@query(_UNIT)
def text_dims_normalized(spark, d):
    path = _place(spark)
    spaced = _words_only(spark, d).words.withColumn("word", F.hex("word"))
    text.write_text_dims(EmbeddingModel(spaced, 64), path)
    back = text.read_text_dims(spark, path)
    return _listed(EmbeddingModel(back.words.withColumn("word", F.decode(F.unhex("word"), "UTF-8")), 64))


@query(_NORMED)
def native_round_trip(spark, d):
    path = _place(spark)
    native.write_embeddings(native_model(spark, d), path)
    return _listed(native.read_embeddings(spark, path))


@query(f"WITH {_WORDS} SELECT bucket, {MARK.format('embedding').replace(', 5)', ', 3)')} AS mark FROM buckets WHERE bucket < 256")
def native_buckets(spark, d):
    path = _place(spark)
    native.write_embeddings(native_model(spark, d), path)
    return native.read_embeddings(spark, path).buckets.select("bucket", mark(F.col("embedding"), 3).alias("mark"))


# The numbers of first appearance in the file are the numbers themselves.
@query(MODEL_SQL["explicit_conversion"])
def explicit_round_trip(spark, d):
    path = _place(spark)
    native.write_embeddings(to_explicit(native_model(spark, d)), path)
    return native.read_embeddings(spark, path).subwords.indexer.table.select("ngram", "bucket")


def _kept(model: DataFrame, other: DataFrame, norms: bool) -> DataFrame:
    """word, idx of ``other`` (word, idx, embedding, norm), and whether ``model`` has the same row, but for
    the rounding of FLOAT."""
    wanted = model.select(F.col("idx").alias("of"), F.col("word").alias("told"), F.col("embedding").alias("wanted"), F.col("norm").alias("length"))
    near = F.forall(F.zip_with(F.col("embedding").cast("array<double>"), F.col("wanted").cast("array<double>"), lambda x, y: F.abs(x - y)), lambda g: g < 1e-3)
    same = (F.col("word") == F.col("told")) & near
    if norms:
        same &= F.abs(F.coalesce("norm", F.lit(1.0)) - F.coalesce("length", F.lit(1.0))) < 1e-3
    return other.join(wanted, F.col("idx") == F.col("of"), "left").select("word", "idx", F.coalesce(same, F.lit(False)).alias("kept"))


_KEPT = f"WITH {_WORDS} SELECT word, idx, true AS kept FROM words"


@query(_KEPT)
def quantized_round_trip(spark, d):
    """A container of codes, read again and reconstructed; its metadata and simple vocabulary too."""
    path = _place(spark)
    model = native.quantize_model(_words_only(spark, d), 8, 4, 3, normalize=True, rotate=True)
    native.write_embeddings(model, path)
    back = native.mmap_embeddings(spark, path)
    return _kept(model.reconstruct().words, back.reconstruct().words, True)


@query(f"WITH {_WORDS} SELECT idx, true AS kept FROM words")
def quantized_rows(spark, d):
    """Every row of a container of codes, asked by number and decoded alone."""
    path = _place(spark)
    model = native.quantize_model(_words_only(spark, d), 8, 4, 3)
    native.write_embeddings(model, path)
    back = native.mmap_embeddings(spark, path)
    found = back.gather(back.words.select(F.col("idx").alias("pos"), "idx")).select("idx", "embedding", F.lit("").alias("word"), F.lit(None).cast("float").alias("norm"))
    return _kept(model.reconstruct().words.withColumn("word", F.lit("")), found, False).drop("word")


@query(_KEPT)
def fasttext_round_trip(spark, d):
    """What is read are the words' own vectors, the bucket rows taken out and mixed in again, of length 1."""
    path = _place(spark)
    model = corpus_model(spark, d)
    fasttext.write_fasttext(model, path)
    whole = model.words.withColumn("embedding", to_float(scale(F.col("embedding"), F.coalesce("norm", F.lit(1.0)).cast("double"))))
    return _kept(normalized_words(whole), fasttext.read_fasttext(spark, path).words, True)


@query(_NORMED)
def simple_round_trip(spark, d):
    """A container of words alone, mapped, by the reader that refuses codes."""
    path = _place(spark)
    native.write_embeddings(_words_only(spark, d), path)
    return _listed(native.mmap_viewable(spark, path))


_BUCKETS = f"WITH {_WORDS} SELECT bucket, {MARK.format('embedding').replace(', 5)', ', 3)')} AS mark FROM buckets"


@query(_BUCKETS)
def fasttext_chunk(spark, d):
    """A container with a fastText vocabulary."""
    path = _place(spark)
    native.write_embeddings(corpus_model(spark, d), path)
    return native.read_embeddings(spark, path).buckets.select("bucket", mark(F.col("embedding"), 3).alias("mark"))


@query(_BUCKETS)
def floret_chunk(spark, d):
    """A container with a floret vocabulary."""
    path = _place(spark)
    rows, count = bucket_rows(spark, d)
    empty = corpus_words(spark, d).limit(0)
    native.write_embeddings(EmbeddingModel(empty, 64, Subwords(FloretIndexer(count, 3, 42), 2, 3, "[", "]"), rows), path)
    return native.read_embeddings(spark, path).buckets.select("bucket", mark(F.col("embedding"), 3).alias("mark"))


@query("""SELECT model_id, regexp_extract(metadata, 'dims = ([0-9]+)', 1)::INT AS dims, regexp_extract(metadata, 'ns = ([0-9]+)', 1)::INT AS ns,
  regexp_extract(metadata, 'language = "([^"]*)"', 1) AS language FROM models WHERE metadata IS NOT NULL""")
def metadata_alone(spark, d):
    """The metadata of all models in one container, read without the rest."""
    path = _place(spark)
    rows = table(spark, d, "models").where("metadata is not null").collect()  # a row a model
    whole = {"models": {str(r.model_id): toml.parse(r.metadata) for r in rows}}
    native.write_embeddings(_words_only(spark, d).set_metadata(whole)[0], path)
    found = [
        (int(k), m.get("hyperparameters", {}).get("dims"), m.get("hyperparameters", {}).get("ns"), m.get("description", {}).get("language"))
        for k, m in native.read_metadata(path)["models"].items()
    ]
    return spark.createDataFrame(found, "model_id long, dims int, ns int, language string")


# Real words: only ASCII white space, which ends a word in these formats, is replaced; the number
# before keeps them apart.
_REAL = "idx || ':' || regexp_replace(word, '[ \\t\\n\\r\\f]', '_', 'g')"


def _real_words(spark: SparkSession, d: str) -> DataFrame:
    words = corpus_words(spark, d)
    return words.withColumn("word", F.concat(F.col("idx").cast("string"), F.lit(":"), F.regexp_replace("word", "[ \\t\\n\\r\\f]", "_")))


_REAL_ALL = f"WITH {_WORDS} SELECT {_REAL} AS word, idx, 1.0::DOUBLE AS norm, {MARK.format('embedding').replace(', 5)', ', 3)')} AS mark FROM words"


@query(_REAL_ALL)
def text_real_words(spark, d):
    path = _place(spark)
    text.write_text(EmbeddingModel(_real_words(spark, d), 64), path)
    return _listed(text.read_text(spark, path, normalize=False))


@query(_REAL_ALL.replace(_REAL, f"regexp_replace({_REAL}, '[' || chr(133) || chr(160) || chr(5760) || chr(8192) || '-' || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(11) || ']+$', '')"))
def word2vec_real_words(spark, d):
    """White space of Unicode at the end of a word is dropped in reading."""
    path = _place(spark)
    word2vec.write_word2vec_binary(EmbeddingModel(_real_words(spark, d), 64), path)
    return _listed(word2vec.read_word2vec_binary(spark, path, normalize=False))


_TORN = "CASE WHEN ascii(right(w, 1)) < 128 THEN left(w, length(w) - 1) ELSE left(w, length(w) - 1) || chr(65533) END"


@query(f"WITH {_WORDS}, r AS (SELECT *, {_REAL} AS w FROM words) SELECT {_TORN} AS word, idx FROM r")
def text_lossy(spark, d):
    """Words whose last byte is cut off, so that many are no UTF-8, written as they are and read lossily."""
    path = _place(spark)
    rows = _real_words(spark, d)
    cut = F.encode("word", "UTF-8")
    vectors = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    line = F.concat(F.substring(cut, F.lit(1), F.length(cut) - 1), F.encode(F.concat(F.lit(" "), vectors, F.lit("\n")), "UTF-8"))
    with OrderedFile(path) as out:
        out.table(rows.select("idx", line.alias("data")), "idx")
    return text.read_text(spark, path, lossy=True, check=False).words.select("word", "idx")


@query(f"WITH {_WORDS}, r AS (SELECT *, {_REAL} AS w FROM words) SELECT {_TORN} AS word, idx FROM r")
def word2vec_lossy(spark, d):
    path = _place(spark)
    rows = _real_words(spark, d)
    cut = F.encode("word", "UTF-8")
    vectors = float_bytes(rows, "idx").withColumnRenamed("idx", "of")
    joined = rows.join(vectors, F.col("idx") == F.col("of"))
    line = F.concat(F.substring(cut, F.lit(1), F.length(cut) - 1), F.lit(b" "), "data", F.lit(b"\n"))
    with OrderedFile(path) as out:
        out.bytes(f"{rows.count()} 64\n".encode())
        out.table(joined.select("idx", line.alias("data")), "idx")
    return word2vec.read_word2vec_binary(spark, path, lossy=True, check=False).words.select("word", "idx")


_REFUSED = {
    "mark": "FormatError", "version": "FormatError", "no chunk": "FormatError", "unknown chunk": "UnknownChunkError", "torn head": "ReadError",
    "torn vocabulary": "ReadError", "short matrix": "MatrixShapeError", "repeated word": "ValueError", "codes to be viewed": "FormatError",
    "no line": "FormatError", "sizes of a text": "FormatError", "words of a text": "FormatError", "repeated line": "ValueError",
    "sizes of word2vec": "FormatError", "torn row": "ReadError", "mark of fastText": "FormatError", "floret numbers": "FormatError",
    "odd parts": "QuantizationError", "many bits": "QuantizationError", "explicit of words": "ConversionError", "absent word": "AnalogyError",
    "null word": "WriteError", "other vocabulary": "WriteError",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{error}')" for case, error in _REFUSED.items()) + ") t(refused, error)")
def refusals(spark, d):
    """The kind of error of what is refused."""
    model, path = _words_only(spark, d), _place(spark)
    good, other = path + ".good", path + ".codes"
    native.write_embeddings(model, good)
    native.write_embeddings(native.quantize_model(model, 8, 2, 1), other)
    with open(good, "rb") as file:
        data = file.read()
    chunks = data[: 12 + 4 * int.from_bytes(data[8:12], "little")]
    body = data[len(chunks) :]
    words = int.from_bytes(body[12:20], "little")
    twice = model.words.unionByName(model.words.withColumn("idx", F.col("idx") + words))

    def wrote(content: bytes):
        with open(path, "wb") as file:
            file.write(content)

    def read(reader, content: bytes, **more):
        wrote(content)
        found = reader(spark, path, **more)
        return found.words.write.format("noop").mode("overwrite").save()

    container = native.read_embeddings
    first = model.words.orderBy("idx").first().word
    cases = {
        "mark": lambda: read(container, b"XXXX" + data[4:]),
        "version": lambda: read(container, data[:4] + b"\7" + data[5:]),
        "no chunk": lambda: read(container, data[:8] + bytes(4)),
        "unknown chunk": lambda: read(container, data[:8] + b"\1\0\0\0\x4d\0\0\0"),
        "torn head": lambda: read(container, data[:6]),
        "torn vocabulary": lambda: native._stretches(spark, _torn(path, data[: len(chunks) + 40]), len(chunks) + 20, words, 0),
        "short matrix": lambda: read(container, chunks + body[:12] + (0).to_bytes(8, "little") + body[20:]),
        "repeated word": lambda: _reread(spark, container, EmbeddingModel(twice, 64), path),
        "codes to be viewed": lambda: native.read_viewable(spark, other),
        "no line": lambda: read(text.read_text, b""),
        "sizes of a text": lambda: read(text.read_text_dims, b"a b\n"),
        "words of a text": lambda: read(text.read_text_dims, b"3 1\na 1\n"),
        "repeated line": lambda: read(text.read_text, b"a 1\na 2\n"),
        "sizes of word2vec": lambda: read(word2vec.read_word2vec_binary, b"x\n"),
        "torn row": lambda: row_slices(spark, _torn(path, b"1 2\na 123"), 4, 1, b" ", 8),
        "mark of fastText": lambda: read(fasttext.read_fasttext, bytes(200)),
        "floret numbers": lambda: read(floret.read_floret_text, b"0 1 2 3 1 1 < >\n"),
        "odd parts": lambda: quantize.train(model.storage(), 7, 4),
        "many bits": lambda: quantize.train(model.storage(), 8, 40),
        "explicit of words": lambda: to_explicit(model),
        "absent word": lambda: similarity.analogy(model, ("\0 no word", first, first), 1),
        "null word": lambda: text.write_text(EmbeddingModel(model.words.withColumn("word", F.lit(None).cast("string")), 64), path),
        "other vocabulary": lambda: fasttext.write_fasttext(model, path),
    }
    found = []
    for case, act in cases.items():
        try:
            act()
            found.append((case, "none"))
        except Exception as error:  # noqa: BLE001 - its kind is the result
            told = str(error)
            inner = [name for name in set(_REFUSED.values()) if f"{name}:" in told or f"wordloom.errors.{name}" in told]
            found.append((case, type(error).__name__ if not inner or type(error).__name__ in _REFUSED.values() else inner[0]))
    return spark.createDataFrame(found, "refused string, error string")


def _torn(path: str, content: bytes) -> str:
    with open(path, "wb") as file:
        file.write(content)
    return path


def _reread(spark: SparkSession, reader, model: EmbeddingModel, path: str) -> None:
    native.write_embeddings(model, path)
    reader(spark, path)


@query(f"WITH {_WORDS} SELECT bucket, {MARK.format('embedding').replace(', 5)', ', 3)')} AS mark FROM buckets")
def floret_round_trip(spark, d):
    path = _place(spark)
    rows, count = bucket_rows(spark, d)
    empty = corpus_words(spark, d).limit(0)
    floret.write_floret_text(EmbeddingModel(empty, 64, Subwords(FloretIndexer(count), 2, 3), rows), path)
    return floret.read_floret_text(spark, path).buckets.select("bucket", mark(F.col("embedding"), 3).alias("mark"))


@query(f"""WITH {_WORDS}, s AS (SELECT count(*) AS n, sum(strlen(word) + 4) AS size, max(norm IS NOT NULL)::INT AS normed FROM words),
v AS (SELECT *, 12 + 4 * (2 + normed) + 12 + 20 + size AS place FROM s),
m AS (SELECT *, place + 28 + 4 - (place + 4) % 4 + 4 * 64 * (n + (SELECT count(*) FROM buckets WHERE bucket < 256)) AS after FROM v)
SELECT (after + normed * (24 + 4 - (after + 4) % 4 + 4 * n))::BIGINT AS bytes FROM m""")
def serialized_length(spark, d):
    return spark.createDataFrame([(native.serialized_length(native_model(spark, d)),)], "bytes long")


@query("""SELECT model_id, regexp_extract(metadata, 'dims = ([0-9]+)', 1)::INT AS dims, regexp_extract(metadata, 'ns = ([0-9]+)', 1)::INT AS ns,
  regexp_extract(metadata, 'language = "([^"]*)"', 1) AS language FROM models WHERE metadata IS NOT NULL""")
def model_metadata(spark, d):
    """The TOML of every model, a row each."""

    def run(batches):
        for batch in batches:
            tables = [toml.parse(x) for x in batch.column(1).to_pylist()]
            heads = [t.get("hyperparameters", {}) for t in tables]
            columns = [pa.array([h.get(k) for h in heads], pa.int32()) for k in ("dims", "ns")]
            columns.append(pa.array([t.get("description", {}).get("language") for t in tables], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["model_id", "dims", "ns", "language"])

    rows = table(spark, d, "models").where("metadata is not null").select("model_id", "metadata")
    return rows.mapInArrow(run, "model_id long, dims int, ns int, language string")
