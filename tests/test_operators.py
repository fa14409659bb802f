import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.errors import AnalogyError, ConversionError, QuantizationError
from wordloom.functions import ngrams as g
from wordloom.functions import vector as v
from wordloom.functions.indexers import ExplicitIndexer, FastTextIndexer, FloretIndexer, HashIndexer, numbered_rows
from wordloom.model import EmbeddingModel, Subwords, VocabKind
from wordloom.operators import lookup, quantize, similarity, subwords
from wordloom.streaming.lookup import lookup_each_batch, lookup_known

SCHEMA = "word string, idx long, embedding array<float>, norm float"

# Published n-gram buckets.
NATIVE_21 = {
    "<Daniël>": [214157, 233912, 311961, 488897, 620206, 741276, 841219, 1167494, 1192256, 1489905, 1532271, 1644730, 1666166, 1679745, 1680294, 1693100, 2026735, 2065822],
    "<hallo>": [75867, 104120, 136555, 456131, 599360, 722393, 938007, 985859, 1006102, 1163391, 1218704, 1321513, 1505861, 1892376],
}
NATIVE_2 = {"<Daniël>": [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3], "<hallo>": [0, 0, 0, 0, 1, 1, 1, 2, 3, 3, 3, 3, 3, 3]}
FASTTEXT_55 = {"<Daniël>": [441697, 749365, 1105725, 1880616], "<überspringen>": [79599, 352266, 385524, 629649, 716781, 978563, 991164, 1230973, 1350653, 1992797]}


def one(spark, column, *values):
    frame = spark.createDataFrame([(x,) for x in values], "x string")
    return [r[0] for r in frame.select(column).collect()]


def test_ngrams(spark):
    found = one(spark, g.ngrams(F.col("x"), 3, 6), "ˈjəp", "", "ab", None)
    assert sorted(found[0]) == sorted(["ˈjə", "jəp", "ˈjəp"]) and found[1:] == [[], [], None]
    whole = one(spark, g.ngrams(F.col("x"), 1, 3), "hellö world")[0]
    assert len(whole) == 30 and whole.count("l") == 3 and "lö " in whole
    for low, high in ((0, 3), (2, 1)):
        with pytest.raises(ValueError):
            g.ngrams(F.col("x"), low, high)


def test_published_buckets(spark):
    for bits, table in ((21, NATIVE_21), (2, NATIVE_2)):
        got = one(spark, F.array_sort(F.transform(g.ngrams(F.col("x"), 3, 6), lambda n: g.fnv_low_bits(n, bits))), *table)
        assert got == list(table.values())
    got = one(spark, F.array_sort(F.transform(g.ngrams(F.col("x"), 5, 5), lambda n: g.fasttext_bucket(n, 2_000_000))), *FASTTEXT_55)
    assert got == list(FASTTEXT_55.values())


def test_wide_hash_keeps_the_low_bits(spark):
    words = ["a", "ël>", "日本", "👍x", "z" * 300, None]
    frame = spark.createDataFrame([(w,) for w in words], "x string")
    for r in frame.select(g.fnv_low_bits(F.col("x"), 31).alias("a"), g.fnv_low_bits(F.col("x"), 40).alias("b")).collect():
        assert (r.a is None and r.b is None) or r.a == r.b % (1 << 31)


def test_scores(spark):
    s = F.col("x").cast("double")
    rows = spark.createDataFrame([("1",), (str(0.5**0.5),), ("0",), ("-1",)], "x string")
    got = np.array([list(r) for r in rows.select(v.angular_similarity(s), v.euclidean_distance(s), v.euclidean_similarity(s)).collect()])
    want = [[1, 0, 1], [0.75, 0.76537, 0.61732], [0.5, 2**0.5, 1 - 0.5**0.5], [0, 2, 0]]
    assert np.allclose(got, want, atol=1e-5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    return {f"w{i:02d}": rng.normal(size=6) / 3 for i in range(40)} | {"ä": np.zeros(6)}, rng.normal(size=(64, 6))


@pytest.fixture(scope="module")
def model(spark, data):
    words, buckets = data
    rows = [(w, i, x.tolist(), 2.0 if i % 2 else None) for i, (w, x) in enumerate(words.items())]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(buckets)], "bucket long, embedding array<float>")
    return EmbeddingModel(spark.createDataFrame(rows, SCHEMA), 6, Subwords(HashIndexer(6)), table).checked()


def fnv(text, bits):
    h = g.OFFSET_64
    for byte in len(text).to_bytes(8, "little") + text.encode("utf-32-le"):
        h = ((h ^ byte) * g.PRIME_64) % (1 << 64)
    return h % (1 << bits)


def grams(word, low=3, high=6):
    m = f"<{word}>"
    return [m[i : i + n] for n in range(low, high + 1) for i in range(len(m) - n + 1)]


def test_lookup(spark, model, data):
    words, buckets = data
    asked = ["w01", "unknown", "unknown", "w01", "", None, "w02", "x"]
    frame = spark.createDataFrame([(i, w, "clash") for i, w in enumerate(asked)], "pos long, word string, embedding string")
    got = {r.pos: r for r in lookup.lookup_batch(frame, model).collect()}
    assert len(got) == len(asked) and [got[i].found for i in range(8)] == [True] * 4 + [False, False, True, True]
    assert np.allclose(got[0].embedding, words["w01"], atol=1e-6) and got[0].norm == 2 and got[6].norm == 1
    total = sum(buckets[fnv(n, 6)] for n in grams("unknown"))
    assert np.allclose(got[1].embedding, total / np.linalg.norm(total), atol=1e-5) and got[1].norm == pytest.approx(np.linalg.norm(total), abs=1e-4)
    assert got[4].embedding == [0] * 6
    index = {r.word: r for r in lookup.word_index(frame, model).collect()}
    assert index["w01"].word_idx == 1 and index["w01"].subword_idx is None
    assert index["unknown"].subword_idx == sorted(41 + fnv(n, 6) for n in grams("unknown"))
    assert index[""].word_idx is None and index[""].subword_idx is None
    assert lookup.known_words(lookup.word_index(frame, model)).count() == 2 and lookup.unknown_words(lookup.word_index(frame, model)).count() == 2
    assert lookup.lookup_batch(frame.limit(0), model).count() == 0


def test_simple_vocabulary_has_no_backoff(spark, model):
    plain = EmbeddingModel(model.words, 6)
    frame = spark.createDataFrame([(0, "unknown"), (1, "w01")], "pos long, word string")
    assert {r.pos: r.found for r in lookup.lookup_batch(frame, plain).collect()} == {0: False, 1: True}
    assert plain.kind is VocabKind.SIMPLE and model.kind is VocabKind.BUCKET and plain.shape == (41, 6) and model.shape == (105, 6)


def test_gather_iterate_and_scale(spark, model, data):
    asked = spark.createDataFrame([(0, 0), (1, 40), (2, 0), (3, 41)], "pos long, idx long")
    got = {r.pos: r.embedding for r in lookup.gather(asked, model).collect()}
    assert np.allclose(got[0], got[2]) and np.allclose(got[3], data[1][0], atol=1e-6) and len(got) == 4
    assert [r.word for r in lookup.iter_words(model).limit(3).collect()] == ["w00", "w01", "w02"]
    assert [r.norm for r in lookup.iter_words(model, True).limit(2).collect()] == [1, 2]
    mapping = spark.createDataFrame([(0, 5), (1, 5)], "new_idx long, old_idx long")
    assert {r.idx for r in lookup.clone_from_mapping(mapping, model).collect()} == {0, 1}
    scaled = {r.word: r.embedding for r in lookup.unnormalized(model.words).collect()}
    assert np.allclose(scaled["w01"], 2 * data[0]["w01"], atol=1e-6)


def ranking(words, vector, skip, limit):
    unit = np.asarray(vector, float)
    scored = sorted((-float(np.float32(x).astype(float) @ unit), w) for w, x in words.items() if w not in skip)
    return [w for _, w in scored[:limit]]


def test_similarity(spark, model, data, monkeypatch):
    words, _ = data
    q = np.float32(words["w03"]).astype(float)
    assert [r.word for r in similarity.word_similarity(model, "w03", 7).collect()] == ranking(words, q, {"w03"}, 7)
    assert similarity.word_similarity(EmbeddingModel(model.words, 6), "none", 3) is None
    assert similarity.word_similarity(model, "w03", 0).count() == 0
    unit = q / np.linalg.norm(q)
    assert [r.word for r in similarity.embedding_similarity(model, (3 * q).tolist(), 5).collect()] == ranking(words, unit, (), 5)
    skips = spark.createDataFrame([("w03",), ("w04",)], "word string")
    assert [r.word for r in similarity.embedding_similarity_masked(model, q.tolist(), 50, skips).collect()] == ranking(words, unit, {"w03", "w04"}, 50)
    a, b, c = (np.float32(words[w]).astype(float) for w in ("w01", "w02", "w05"))
    o = b - a + c
    o /= np.linalg.norm(o)
    assert [r.word for r in similarity.analogy(model, ("w01", "w02", "w05"), 40).collect()] == ranking(words, o, {"w01", "w02", "w05"}, 40)
    assert [r.word for r in similarity.analogy(model, ("w01", "w02", "w05"), 9, (False, True, False)).collect()] == ranking(words, o, {"w02"}, 9)
    with pytest.raises(AnalogyError) as error:
        similarity.analogy(EmbeddingModel(model.words, 6), ("w01", "Foo", "w05"), 3)
    assert error.value.present == [True, False, True]
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    for block in (8192, 7):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = {}
        for r in similarity.word_similarity_batch(model, asked, 6).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.word)
        assert got == {w: ranking(words, np.float32(x).astype(float), {w}, 6) for w, x in words.items()}
    triples = spark.createDataFrame([(1, "w01", "w02", "w05"), (2, "w01", "no", "w05")], "query_id long, a string, b string, c string")
    plain = EmbeddingModel(model.words, 6)
    got = [r.word for r in similarity.analogy_batch(plain, triples, 4).orderBy("place").collect()]
    assert got == ranking(words, o, {"w01", "w02", "w05"}, 4)
    assert {tuple(r) for r in similarity.analogy_presence(plain, triples).collect()} == {(1, True, True, True), (2, True, False, True)}


def test_compose_and_decompose(spark, model, data):
    words, buckets = data
    composed = {r.word: r.embedding for r in subwords.compose_words(model).collect()}
    hits = [buckets[fnv(n, 6)] for n in grams("w07")]
    assert np.allclose(composed["w07"], (words["w07"] + sum(hits)) / (len(hits) + 1), atol=1e-5)
    from dataclasses import replace

    apart = {r.word: r.embedding for r in subwords.decompose_words(replace(model, words=subwords.normalized_words(subwords.compose_words(model)))).collect()}
    assert all(np.allclose(apart[w], x, atol=1e-4) for w, x in words.items())


def test_explicit(spark, model):
    explicit = subwords.to_explicit(model)
    table = {r.ngram: r.bucket for r in explicit.subwords.indexer.table.collect()}
    every = sorted({n for r in model.words.collect() for n in grams(r.word)})
    order = {}
    for n in every:
        order.setdefault(fnv(n, 6), len(order))
    assert table == {n: order[fnv(n, 6)] for n in every} and explicit.subwords.indexer.upper_bound == len(order)
    frame = spark.createDataFrame([(0, "w0"), (1, "zzz")], "pos long, word string")
    got = {r.pos: r.found for r in lookup.lookup_batch(frame, explicit).collect()}
    assert got == {0: True, 1: False}
    listed = {r.word: r.ngram_indices for r in subwords.ngram_indices(frame, explicit.subwords, 41).collect()}
    assert any(x.indices == [] for x in listed["zzz"]) and [41 + table["<w0"]] in [x.indices for x in listed["w0"]]
    for bad in (None, explicit.subwords, Subwords(FloretIndexer(5, 1))):
        with pytest.raises(ConversionError):
            subwords.to_explicit(EmbeddingModel(model.words, 6, bad, model.buckets))


def test_numbering(spark):
    frame = spark.createDataFrame([(f"k{i:04d}",) for i in range(1000)], "k string").repartition(7)
    assert {r.k: r.n for r in numbered_rows(frame, "k", "n").collect()} == {f"k{i:04d}": i for i in range(1000)}


def test_indexer_bounds():
    for make in (lambda: HashIndexer(65), lambda: FastTextIndexer(0), lambda: FastTextIndexer(1 << 31), lambda: FloretIndexer(0), lambda: FloretIndexer(5, 5)):
        with pytest.raises(ValueError):
            make()
    assert HashIndexer(21).upper_bound == 1 << 21 and not ExplicitIndexer.infallible and FloretIndexer(7).whole_word


def test_quantizing(spark):
    x = np.arange(100 * 20, dtype=float).reshape(100, 20)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "idx long, embedding array<float>")
    losses = []
    for bits in (1, 3, 5):
        quantizer, loss = quantize.train(rows, 10, bits, 5)
        coded = quantize.encode_rows(rows, quantizer, "idx")
        codes = {r.idx: r.codes for r in coded.collect()}
        assert len(codes) == 100 and all(0 <= c < 1 << bits for r in codes.values() for c in r)
        back = {r.idx: r.embedding for r in quantize.reconstruct(coded, quantizer, "idx").collect()}
        assert np.isclose(np.mean([((x[i] - back[i]) ** 2).sum() for i in back]), loss, rtol=1e-3)
        losses.append(loss)
    assert losses == sorted(losses, reverse=True)
    unit, _ = quantize.train(rows, 10, 4, 3, attempts=2, normalize=True)
    coded = quantize.encode_rows(rows, unit, "idx", normalize=True)
    assert all(np.isclose(r.norm, np.linalg.norm(x[r.idx]), rtol=1e-5) for r in coded.collect())
    turned, _ = quantize.train(rows, 10, 4, 3, rotate=True)
    assert np.allclose(turned.projection @ turned.projection.T, np.eye(20), atol=1e-8)
    for parts, bits in ((3, 2), (10, 7), (10, 0), (10, 9)):
        with pytest.raises(QuantizationError):
            quantize.train(rows, parts, bits)
    books = unit.books(spark, 3)
    again = quantize.Quantizer.from_books(books, 3)
    assert np.allclose(again.centroids, unit.centroids, atol=1e-5)


def test_streams(spark, model, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(0, "w01"), (1, "unknown")], "pos long, word string").write.parquet(str(source))
    stream = spark.readStream.schema("pos long, word string").parquet(str(source))
    lookup_known(stream, model).writeStream.format("memory").queryName("known").trigger(availableNow=True).start().awaitTermination()
    assert {r.word: r.norm for r in spark.table("known").collect()} == {"w01": 2, "unknown": None}
    seen = []
    run = lookup_each_batch(model, lambda frame, _: seen.extend(frame.collect()))
    stream.writeStream.foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    assert {r.word: r.found for r in seen} == {"w01": True, "unknown": True}


def test_wide_hashes(spark):
    from wordloom.functions import ngrams as g

    words = ["<a>", "hallo", "ü日", "", None, "x" * 300]

    def plain(word):
        h = g.OFFSET_64
        for byte in len(word).to_bytes(8, "little") + word.encode("utf-32-le"):
            h = ((h ^ byte) * g.PRIME_64) & 0xFFFFFFFFFFFFFFFF
        return h

    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    for bits in (31, 32, 62, 63, 64):
        got = {r.i: r.h for r in frame.select("i", g.fnv_low_bits(frame.w, bits).alias("h")).collect()}
        assert {i: None if h is None else int(h) for i, h in got.items()} == {i: None if w is None else plain(w) % (1 << bits) for i, w in enumerate(words)}
    rows = HashIndexer(64).buckets_of(frame.select(frame.w.alias("ngram")).where("w is not null")).collect()
    assert HashIndexer(64).upper_bound == 1 << 64 and {int(r.found[0]) for r in rows} == {plain(w) for w in words if w is not None}


# Published rankings over a file of vectors of place names, which is not part of this
# repository; WORDLOOM_PLACES names it.
NEAR_STUTTGART = "Karlsruhe Mannheim München Darmstadt Heidelberg Wiesbaden Kassel Düsseldorf Leipzig Berlin"
NEAR_BERLIN = """Potsdam Hamburg Leipzig Dresden München Düsseldorf Bonn Stuttgart Weimar Berlin-Charlottenburg
Rostock Karlsruhe Chemnitz Breslau Wiesbaden Hannover Mannheim Kassel Köln Danzig
Erfurt Dessau Bremen Charlottenburg Magdeburg Neuruppin Darmstadt Jena Wien Heidelberg
Dortmund Stettin Schwerin Neubrandenburg Greifswald Göttingen Braunschweig Berliner Warschau Berlin-Spandau"""


@pytest.mark.skipif("WORDLOOM_PLACES" not in os.environ, reason="the file of place names is not there")
def test_published_rankings(spark):
    from wordloom.sources.text import read_text

    model = read_text(spark, os.environ["WORDLOOM_PLACES"])
    for word, near in (("Stuttgart", NEAR_STUTTGART), ("Berlin", NEAR_BERLIN)):
        found = similarity.word_similarity(model, word, len(near.split()))
        assert [r.word for r in found.collect()] == near.split()
