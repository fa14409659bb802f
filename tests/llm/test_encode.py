import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wordloom.llm.bpe import encoder
from wordloom.llm.encode import TOKENIZER, encode_corpus
from wordloom.llm.points import code_points, to_text


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return lambda texts: [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


CASES = [
    "don't we'll I've x!'s 'string  'tis\n\n  a\t b  ", "", None, "   ", " \n 'll", "<|endoftext|> hi",
    "a" * 2000, "x" * 700 + " zz", "日本語のテキスト中文字符" * 20, "''s 's's", "it's' 't", "１２３ ４ x²³½", " 'd 　x",
    "\x00\x01", "👍🏽 👨‍👩‍👧", "'re've'll're", "a'r\n",
]


def test_cases(reference):
    ids, bounds = encoder(TOKENIZER).encode(pa.array(CASES, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference(CASES)


def test_random(reference):
    rnd = random.Random(0)
    letters = "abcdefst'  \n\tré日1²!?…​ ER"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    ids, bounds = encoder(TOKENIZER).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference(texts)


def test_words_that_differ_in_their_last_bytes(reference):
    texts = ["=========", "=========\x00", "=" * 8, "=" * 8 + "\x00" * 7, "=" * 8 + "\x00" * 8, "abcdefgA", "abcdefg\xc1"]
    texts += ["\x00" * n for n in (7, 8, 9, 15, 16, 17)] + ["ab" * 255 + "c", "ab" * 256, "a" * 513, "=-" * 2500, "中文" * 800]
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (511, 512, 513, 600, 5000)]
    for batch in (texts, texts[::-1]):
        ids, bounds = encoder(TOKENIZER).encode(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference(batch)


def test_equal_keys(reference, monkeypatch):
    from wordloom.llm import bpe

    keys = bpe._keys
    monkeypatch.setattr(bpe, "_keys", lambda d, b, s: np.where(s < 8, keys(d, b, s), keys(d, b, s) | np.uint64((1 << 62) - 1)))
    own = bpe.BytePairEncoder(TOKENIZER)
    texts = ["information technology", "something otherwise", "informatics", "otherwise information", "x" * 40] * 2
    for _ in range(2):
        ids, bounds = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == reference(texts)


def test_frame(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(0, CASES[0], "clash")]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(out) == len(rows)
    want = reference(CASES)
    assert all(list(r.ids) == want[r.doc_id] for r in out)
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark, reference, monkeypatch):
    from wordloom.llm import points

    monkeypatch.setattr(points, "PIECE_BYTES", 64)
    rnd = random.Random(3)
    words = ["don't", "'re", "x,", "  ", "\n", "été", "日本語。", "a.b", "1st", "!?"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200))) for _ in range(60)] + ["", None, "z" * 999]
    encode = encoder(TOKENIZER)
    from wordloom.llm.encode import _encoded

    got = [ids[a:b].tolist() for _, _, ids, bounds in _encoded(encode, pa.array(texts)) for a, b in zip(bounds, bounds[1:])]
    assert got == reference(texts)


def test_round_trip_of_points():
    texts = pa.array(["a", "", None, "é日👍", "\x00"])
    points, _, _, bounds = code_points(texts)
    assert to_text(points, bounds, texts.is_valid().to_numpy(zero_copy_only=False)).equals(texts)


def test_decode(spark):
    from wordloom.llm.encode import decode_corpus

    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in decode_corpus(encode_corpus(frame)).collect()}
    assert got == {i: t or "" for i, t in enumerate(CASES)}
    assert decode_corpus(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""
