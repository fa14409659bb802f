import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from wordloom.errors import FormatError, MatrixShapeError, WordloomError
from wordloom.functions.indexers import ExplicitIndexer, FastTextIndexer, FloretIndexer, HashIndexer
from wordloom.model import EmbeddingModel, Subwords
from wordloom.operators.subwords import to_explicit
from wordloom.sources import fasttext, floret, native, text, toml, word2vec

SCHEMA = "word string, idx long, embedding array<float>, norm float"
WORDS = ["this", "is", "ä", "test"]


def make(spark, subwords=None, norms=True, metadata=None, dims=4):
    rng = np.random.default_rng(0)
    rows = [(w, i, rng.normal(size=dims).tolist(), float(i + 2) if norms else None) for i, w in enumerate(WORDS)]
    buckets = None
    if subwords:
        buckets = spark.createDataFrame([(b, rng.normal(size=dims).tolist()) for b in range(subwords.indexer.upper_bound)], "bucket long, embedding array<float>")
    return EmbeddingModel(spark.createDataFrame(rows, SCHEMA), dims, subwords, buckets, metadata)


def content(model):
    words = [(r.word, r.idx, np.round(r.embedding, 5).tolist(), None if r.norm is None else round(r.norm, 5)) for r in model.words.orderBy("idx").collect()]
    buckets = None if model.buckets is None else [(r.bucket, np.round(r.embedding, 5).tolist()) for r in model.buckets.orderBy("bucket").collect()]
    return words, buckets, model.metadata


KINDS = {
    "simple": None,
    "bucket": Subwords(HashIndexer(4)),
    "fasttext": Subwords(FastTextIndexer(20)),
}
META = {"hyperparameters": {"dims": 300, "ns": 5}, "description": {"description": 'Zeit "neu"\n', "language": "de", "rate": 0.5, "on": True}}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("norms", [True, False])
def test_native_round_trip(spark, tmp_path, kind, norms):
    model = make(spark, KINDS[kind], norms, META if norms else None)
    path = str(tmp_path / "model")
    native.write_embeddings(model, path)
    back = native.read_embeddings(spark, path)
    assert content(back) == content(model)
    assert back.checked() is back and back.subwords == model.subwords
    assert native.read_metadata(path) == model.metadata
    assert native.serialized_length(model) == (tmp_path / "model").stat().st_size


def walked(model, offset):
    """Length of what is written from a place on, each part laid behind the one before it."""
    dense = isinstance(model, EmbeddingModel)
    words = model.words.collect()
    rows = len(words) + (model.buckets.count() if model.buckets is not None else 0)
    normed = any(r.norm is not None for r in words)
    at = offset + 4 + 4 + 4 + 4 * (2 + normed + (model.metadata is not None))
    if model.metadata is not None:
        at += 4 + 8 + len(toml.dump(model.metadata).encode())
    items = sum(4 + len(r.word.encode()) for r in words)
    if model.subwords is None:
        at += 12 + 8 + items
    elif isinstance(model.subwords.indexer, ExplicitIndexer):
        grams = model.subwords.indexer.table.collect()
        at += 12 + 8 + 8 + 4 + 4 + items + sum(4 + len(r.ngram.encode()) + 8 for r in grams)
    else:
        at += 12 + 8 + 4 + 4 + 4 + items
    if dense:
        at += 12 + 8 + 4 + 4
        at += 4 - at % 4
        at += 4 * rows * model.dims
    else:
        book = model.quantizer
        at += 12 + 5 * 4 + 8 + 4 + 4
        at += 4 - at % 4
        at += 4 * (0 if book.projection is None else model.dims**2) + 4 * book.centroids.size
        at += 4 * rows * any(r.code_norm is not None for r in words) + rows * book.quantized_len
    if normed:
        at += 12 + 8 + 4
        at += 4 - at % 4
        at += 4 * len(words)
    return at - offset


def test_length_at_every_place(spark):
    models = [make(spark), make(spark, KINDS["bucket"], metadata=META), to_explicit(make(spark, KINDS["bucket"], norms=False))]
    models.append(native.quantize_model(make(spark, KINDS["fasttext"], dims=8), 4, 2, 2, normalize=True, rotate=True))
    for model in models:
        for offset in range(16):
            assert native.serialized_length(model, offset) == walked(model, offset)


def test_loading_refuses(spark, tmp_path):
    path = str(tmp_path / "model")
    model = make(spark, dims=8)
    native.write_embeddings(model, path)
    data = bytearray((tmp_path / "model").read_bytes())
    at = data.index(struct.pack("<QI", 4, 8)) # rows and components of the matrix
    data[at : at + 8] = struct.pack("<Q", 3)
    (tmp_path / "short").write_bytes(data)
    with pytest.raises(MatrixShapeError):
        native.read_embeddings(spark, str(tmp_path / "short"))
    twice = EmbeddingModel(model.words.replace("is", "this", "word"), 8)
    native.write_embeddings(twice, path)
    with pytest.raises(ValueError):
        native.read_embeddings(spark, path)
    assert len(native.read_embeddings(spark, path, check=False)) == 4
    for write, read in ((text.write_text, text.read_text), (text.write_text_dims, text.read_text_dims), (word2vec.write_word2vec_binary, word2vec.read_word2vec_binary)):
        write(twice, path)
        with pytest.raises(ValueError):
            read(spark, path)
        assert len(read(spark, path, check=False)) == 4


def test_only_vectors_can_be_viewed(spark, tmp_path):
    path = str(tmp_path / "model")
    native.write_embeddings(make(spark), path)
    assert content(native.read_viewable(spark, path)) == content(native.mmap_viewable(spark, path)) == content(make(spark))
    native.write_embeddings(native.quantize_model(make(spark, dims=8), 4, 2, 2), path)
    with pytest.raises(FormatError):
        native.read_viewable(spark, path)


def test_stretches(spark, tmp_path, monkeypatch):
    """Rows of a file are found in stretches as well."""
    from wordloom.sources import files

    model = EmbeddingModel(spark.createDataFrame([(f"w{i}é" * (1 + i % 5), i, [float(i)], None) for i in range(500)], SCHEMA), 1)
    path = str(tmp_path / "model")
    for module in (files, native):
        monkeypatch.setattr(module, "SLICE", 300)
    native.write_embeddings(model, path)
    with native._Reader(path) as reader:
        reader.header()
        _, end = reader.chunk()
        begin = reader.file.tell() + 8
        found = native._found(spark, path, begin, end, 500)
        alone = native._stretches(spark, path, begin, 500, 0)
        assert len(found) > 10 and found[-1][3] == alone[-1][3] == end and sum(x[1] for x in found) == 500
    assert content(native.read_embeddings(spark, path)) == content(model)
    word2vec.write_word2vec_binary(model, path)
    size = (tmp_path / "model").stat().st_size
    found = files.row_stretches(spark, path, 6, size, 500, files.Marked(b" ", 4))
    assert len(found) > 10 and found[-1][3] == files.row_slices(spark, path, 6, 500, b" ", 4)[-1][3] and sum(x[1] for x in found) == 500
    with open(path, "ab") as file:
        file.write(b"behind 0000\n")  # rows behind the last are not read
    assert len(word2vec.read_word2vec_binary(spark, path)) == 500
    word2vec.write_word2vec_binary(model, path)
    assert content(word2vec.read_word2vec_binary(spark, path, normalize=False)) == content(model)


def test_native_explicit_and_floret(spark, tmp_path):
    path = str(tmp_path / "model")
    model = to_explicit(make(spark, KINDS["bucket"], metadata=META))
    assert model.metadata is None and isinstance(model.subwords.indexer, ExplicitIndexer)
    native.write_embeddings(model, path)
    back = native.read_embeddings(spark, path)
    assert content(back) == content(model)
    pairs = lambda m: {tuple(r) for r in m.subwords.indexer.table.select("ngram", "bucket").collect()}
    assert pairs(back) == pairs(model) and native.serialized_length(model) == (tmp_path / "model").stat().st_size

    rows = spark.createDataFrame([(b, [float(b), 1.0]) for b in range(7)], "bucket long, embedding array<float>")
    model = EmbeddingModel(spark.createDataFrame([], SCHEMA), 2, Subwords(FloretIndexer(7, 3, 42), 2, 3, "[", "]"), rows)
    native.write_embeddings(model, path)
    back = native.read_embeddings(spark, path)
    assert content(back) == content(model) and back.subwords == model.subwords


@pytest.mark.parametrize("normalize", [True, False])
def test_native_quantized(spark, tmp_path, normalize):
    model = native.quantize_model(make(spark, KINDS["bucket"], dims=8), 4, 2, 5, normalize=normalize, rotate=normalize)
    path = str(tmp_path / "model")
    native.write_embeddings(model, path)
    assert native.serialized_length(model) == (tmp_path / "model").stat().st_size
    back = native.read_embeddings(spark, path)
    assert isinstance(back, native.QuantizedModel)
    (a, b, _), (c, d, _) = content(back.reconstruct()), content(model.reconstruct())
    assert [x[:2] for x in a] == [x[:2] for x in c]
    assert np.allclose([x[2] for x in a], [x[2] for x in c], atol=1e-4) and np.allclose([x[1] for x in b], [x[1] for x in d], atol=1e-4)


def test_quantized_rows(spark):
    model = native.quantize_model(make(spark, KINDS["bucket"], dims=8), 4, 2, 3, normalize=True)
    whole = {r.idx: r.embedding for r in model.reconstruct().storage().collect()}
    assert model.shape == (20, 8) and len(whole) == 20
    asked = spark.createDataFrame([(0, 19), (1, 0), (2, 19)], "pos long, idx long")
    got = {r.pos: r for r in model.gather(asked).collect()}
    assert all(np.allclose(got[p].embedding, whole[i]) for p, i in ((0, 19), (1, 0), (2, 19)))
    mapping = spark.createDataFrame([(0, 19), (1, 19)], "new_idx long, old_idx long")
    assert len({tuple(r.codes) for r in model.clone_from_mapping(mapping).collect()}) == 1


def test_native_errors(spark, tmp_path):
    path = tmp_path / "model"
    for data in (b"XXXX" + struct.pack("<II", 0, 0), b"FiFu" + struct.pack("<II", 0, 0), b"FiFu" + struct.pack("<III", 0, 1, 77), b"Fi"):
        path.write_bytes(data)
        with pytest.raises(WordloomError):
            native.read_embeddings(spark, str(path))
    native.write_embeddings(make(spark), str(path))
    path.write_bytes(path.read_bytes()[:-3])  # norms that can't be read are no norms
    assert {r.norm for r in native.read_embeddings(spark, str(path)).words.collect()} == {None}


@pytest.mark.parametrize("dims", [False, True])
def test_text_round_trip(spark, tmp_path, dims):
    path = tmp_path / "model.txt"
    head = "2 3\n" if dims else ""
    path.write_text(head + "berlin 1 2.5 -3\nä  0.00001 0\t0.5 \r\n")
    read = text.read_text_dims if dims else text.read_text
    model = read(spark, str(path), normalize=False)
    words, _, _ = content(model)
    assert words == [("berlin", 0, [1.0, 2.5, -3.0], None), ("ä", 1, [1e-05, 0.0, 0.5], None)]
    out = tmp_path / "out.txt"
    text.write_text(model, str(out), dims=dims)
    assert out.read_text() == head + "berlin 1 2.5 -3\nä 0.00001 0 0.5\n"
    unit = read(spark, str(path))
    text.write_text(unit, str(out), unnormalize=True, dims=dims)
    assert np.allclose([r[2] for r in content(read(spark, str(out), normalize=False))[0]], [r[2] for r in words])
    assert np.allclose([np.linalg.norm(r[2]) for r in content(unit)[0]], 1, atol=1e-5)


def test_white_space(spark, tmp_path):
    """Only ASCII white space cuts a line, the first one too; word2vec drops that of Unicode, no more."""
    path = tmp_path / "model"
    path.write_text("a\u00a0b 0.1 0.2\nc\u3000d\x1c 1 2\n")
    assert [r[0] for r in content(text.read_text(spark, str(path), normalize=False))[0]] == ["a\u00a0b", "c\u3000d\x1c"]
    path.write_text("2 1 2 2 1 1 \u00a0 >\x1c\n0 1\n1 2\n")
    own = floret.read_floret_text(spark, str(path)).subwords
    assert (own.bow, own.eow) == ("\u00a0", ">\x1c")
    path.write_bytes(b"2 1\n" + "\u3000x\x1c\u00a0".encode() + b" " + struct.pack("<f", 1) + b"\ny " + struct.pack("<f", 2))
    assert [r[0] for r in content(word2vec.read_word2vec_binary(spark, str(path), normalize=False))[0]] == ["x\x1c", "y"]


def test_text_of_floats():
    import pyarrow as pa

    values = np.concatenate([np.float32([0, -0.0, 1, -3, 1e-45, 1e-5, 0.1, 16777216, 3.4e38, 1.1754944e-38, 123456.79]), np.random.default_rng(1).normal(size=2000).astype(np.float32) * np.float32(10) ** np.random.default_rng(2).integers(-30, 30, 2000)]).astype(np.float32)
    assert text.float_texts(pa.array(values)).to_pylist() == [text.float_text(x) for x in values]


def test_text_errors(spark, tmp_path):
    path = tmp_path / "model.txt"
    path.write_bytes(b"meren 1 2\nzee\xc3n 1 2\n")
    with pytest.raises(PySparkException):
        text.read_text(spark, str(path)).words.collect()
    assert content(text.read_text(spark, str(path), lossy=True))[0][1][0] == "zee�n"
    path.write_bytes(b"a 1 2\nb 1\n")
    with pytest.raises(PySparkException):
        text.read_text(spark, str(path)).words.collect()
    path.write_bytes(b"3 2\na 1 2\n")
    with pytest.raises(FormatError):
        text.read_text_dims(spark, str(path))
    path.write_bytes(b"")
    with pytest.raises(FormatError):
        text.read_text(spark, str(path))


def test_word2vec_round_trip(spark, tmp_path):
    model = make(spark, norms=False)
    path = tmp_path / "model.bin"
    word2vec.write_word2vec_binary(model, str(path))
    assert content(word2vec.read_word2vec_binary(spark, str(path), normalize=False)) == content(model)
    unit = word2vec.read_word2vec_binary(spark, str(path))
    word2vec.write_word2vec_binary(unit, str(path), unnormalize=True)
    back = content(word2vec.read_word2vec_binary(spark, str(path), normalize=False))[0]
    assert np.allclose([r[2] for r in back], [r[2] for r in content(model)[0]], atol=1e-5)
    path.write_bytes(b"1 1\nzee\xc3 " + struct.pack("<f", 1))
    assert content(word2vec.read_word2vec_binary(spark, str(path), lossy=True))[0][0][0] == "zee�"
    with pytest.raises(PySparkException):
        word2vec.read_word2vec_binary(spark, str(path)).words.collect()


def test_fasttext_round_trip(spark, tmp_path):
    model = make(spark, Subwords(FastTextIndexer(20), 2, 3))
    path = str(tmp_path / "model.bin")
    fasttext.write_fasttext(model, path)
    back = fasttext.read_fasttext(spark, path)
    (a, b, meta), (c, d, _) = content(back), content(model)
    assert b == d and meta["bucket"] == 20 and meta["loss"] == "HierarchicalSoftmax"
    units = [(np.array(v) * n, np.array(w) * m) for (_, _, v, n), (_, _, w, m) in zip(a, c)]
    assert all(np.allclose(x, y, atol=1e-3) for x, y in units)
    data = (tmp_path / "model.bin").read_bytes()
    for at, form, value in ((0, "<I", 1), (4, "<I", 13), (8 + 48 + 8 + 8, "<I", 1), (8 + 48 + 8 + 20, "<q", 0)):
        (tmp_path / "bad").write_bytes(data[:at] + struct.pack(form, value) + data[at + struct.calcsize(form) :])
        with pytest.raises(WordloomError):
            fasttext.read_fasttext(spark, str(tmp_path / "bad"))


# A published example of the format, with two sets of markers.
BUCKETS = """0 -2.2611 3.9302 2.6676 -11.233 0.093715 -10.52 -9.6463 -0.11853 2.101 -0.10145
1 -3.12 -1.7981 10.7 -6.171 4.4527 10.967 9.073 6.2056 -6.1199 -2.0402
2 9.5689 5.6721 -8.4832 -1.2249 2.1871 -3.0264 -2.391 -5.3308 -3.2847 -4.0382
3 3.6268 4.2759 -1.7007 1.5002 5.5266 1.8716 -12.063 0.26314 2.7645 2.4929
4 -11.683 -7.7068 2.1102 2.214 7.2202 0.69799 3.2173 -5.382 -2.0838 5.0314
5 -4.3024 8.0241 2.0714 -1.0174 -0.28369 1.7622 7.8797 -1.7795 6.7541 5.6703
6 8.3574 -5.225 8.6529 8.5605 -8.9465 3.767 -5.4636 -1.4635 -0.98947 -0.58025
7 -10.01 3.3894 -4.4487 1.1669 -11.904 6.5158 4.3681 0.79913 -6.9131 -8.687
8 -5.4576 7.1019 -8.8259 1.7189 4.955 -8.9157 -3.8905 -0.60086 -2.1233 5.892
9 8.0678 -4.4142 3.6236 4.5889 -2.7611 2.4455 0.67096 -4.2822 2.0875 4.6274
"""
POOLED = {
    ("<", ">"): {
        ",": "-5.7814 2.6918 0.57029 -3.6985 -2.7079 1.4406 1.0084 1.7463 -3.8625 -3.0565",
        "der": "0.08224 2.6601 -1.173 1.1549 -0.42821 -0.097268 -2.5589 -1.609 -0.16968 0.84687",
    },
    ("[", "]"): {
        ",": "1.3844874 2.3464875 1.2599748 -0.6150249 -2.7724452 -0.79785013 -4.0532503 -1.1515112 0.19298255 -0.7406751",
        "der": "-0.30920622 3.038363 -0.68778753 -0.563806 1.5502453 -0.06880643 -1.2151338 -0.047910027 -1.5533295 0.95536256",
    },
}


@pytest.mark.parametrize("marks", POOLED)
def test_floret(spark, tmp_path, marks):
    from wordloom.operators.lookup import lookup_distinct

    whole = f"10 10 2 3 2 2166136261 {marks[0]} {marks[1]}\n" + BUCKETS
    path = tmp_path / "model.floret"
    path.write_text(whole)
    model = floret.read_floret_text(spark, str(path))
    want = {w: np.array(v.split(), float) for w, v in POOLED[marks].items()}
    asked = spark.createDataFrame([(w,) for w in want], "word string")
    for r in lookup_distinct(asked, model).collect():
        unit = want[r.word] / np.linalg.norm(want[r.word])
        assert np.allclose(r.embedding, unit, atol=1e-4)
    floret.write_floret_text(model, str(tmp_path / "out"))
    assert (tmp_path / "out").read_text() == whole
    for bad in ("10 10 3 2 2 1 < >\n", "0 10 2 3 2 1 < >\n", "10 10 2 3 5 1 < >\n", "9 10 2 3 2 1 < >\n", "x\n"):
        path.write_text(bad + BUCKETS)
        with pytest.raises(WordloomError):
            floret.read_floret_text(spark, str(path))


def test_checked(spark):
    rows = [("a", 0, [1.0], None), ("a", 1, [1.0], None)]
    with pytest.raises(ValueError):
        EmbeddingModel(spark.createDataFrame(rows, SCHEMA), 1).checked()
    with pytest.raises(MatrixShapeError):
        EmbeddingModel(spark.createDataFrame([("a", 0, [1.0, 2.0], None)], SCHEMA), 1).checked()


def test_toml():
    table = {"a": 1, "b c": "x\n\"y\"", "t": {"u": {"v": [1, 2.5, True]}, "w": {}}}
    assert toml.parse(toml.dump(table)) == table
    with pytest.raises(FormatError):
        toml.parse("= 1")


def test_rows_are_found_from_any_place(spark, tmp_path, monkeypatch):
    """Words longer than what is looked at, words of zeros, and floats that look like the mark."""
    from wordloom.sources import files

    rng = np.random.default_rng(4)
    words = ["w" * int(rng.choice([1, 3, 9, 700])) + str(i) + "\0" * int(rng.choice([0, 0, 5])) for i in range(400)]
    space = float(np.frombuffer(b"    ", "<f4")[0])
    rows = [(w, i, [space if rng.random() < 0.3 else float(np.float32(rng.normal())) for _ in range(3)], None) for i, w in enumerate(words)]
    model = EmbeddingModel(spark.createDataFrame(rows, SCHEMA), 3)
    path = str(tmp_path / "model")
    monkeypatch.setattr(files, "SLICE", 900)
    monkeypatch.setattr(files, "ENTRY", 40)
    native.write_embeddings(model, path)
    assert content(native.read_embeddings(spark, path)) == content(model)
    word2vec.write_word2vec_binary(model, path)
    assert content(word2vec.read_word2vec_binary(spark, path, normalize=False)) == content(model)
