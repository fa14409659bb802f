import numpy as np

from wordloom.llm.encoding_repair import _numbers, judge, losses, repair_words
from wordloom.llm.encodings import GRID, READ, WIDE, WRITTEN, as_points, as_texts, read_bytes, sound, sound_words, undo, undone, written_bytes

CLEAN = ["kümön", "schlösser", "grüße", "brötchen", "fährte", "çedéra", "garçon", "señora", "über", "größer", "mädchen", "löwe"]


def test_undo():
    assert undo("kÃ¼mÃ¶n", "utf-8", "cp1252") == "kümön"
    assert undo("ã\x83\x88ã\x82¤ト", "utf-8", "latin_1") == "トイト"
    assert undo("ƒyƒ‹", "cp932", "cp1252") == "ペル"
    assert undo("kümön", "utf-8", "cp1252") is None


def test_undo_of_batches():
    words = ["", "kÃ¼mÃ¶n", "plain", "ƒyƒ‹", "größer", "Москва", "гр", "t«âc", "Ã", "日本", "ÐžÐº�", "a\U0001f600Ã¼"] + CLEAN
    points, bounds = as_points(words)
    for written, read in GRID:
        got = {}
        for which, made, cuts, _ in undone(points, bounds, written, read):
            got |= dict(zip(which.tolist(), as_texts(made, cuts, np.arange(len(which)))))
        want = {k: t for k, t in ((k, undo(w, written, read)) for k, w in enumerate(words)) if t is not None}
        assert got == want, (written, read)
    assert WIDE <= set(WRITTEN)


def originals(word, learned):
    flat = np.zeros((1024, 1024), np.float32)
    flat[:, 0] = 0
    return {text: utf8 for _, text, _, _, utf8 in judge([word], np.zeros(1, bool), learned, flat - 1)}


def test_undoes_what_lies_under_a_single_byte_reading():
    inner = "größer".encode().decode("cp1252")
    word = inner.encode("cp1252").decode("cp1251")
    assert "größer" in originals(word, [("cp1252", "cp1251"), ("utf-8", "cp1252")])


def test_undoes_any_number_of_readings_of_utf8():
    word = "größer"
    for _ in range(6):
        word = word.encode().decode("latin_1")
    assert originals(word, [("utf-8", "latin_1")])["größer"]


def test_sound():
    assert all(map(sound, [*CLEAN, "Москва", "ピヨヒ", "naïve²", "O'Brien"]))
    assert not any(map(sound, ["kÃ¼m", "rekrдsang", "a�b", "sÅ\x93"]))


def test_sound_of_batches():
    words = [*CLEAN, "", "kÃ¼m", "a�b", "VoN", "VÖNß", "McAdam", "x²", "²x", "\xa0wort\u3000", "ab‑cd", "日本の", "\U00020000"]
    assert sound_words(*as_points(words)).tolist() == [sound(w) for w in words]


def test_bytes_name_the_encodings():
    def agreed(garbled, clean):
        read = {d: f for _, d, f in zip(*map(list, read_bytes(*as_points([garbled]))))}
        made = {d: f for _, d, f in zip(*map(list, written_bytes(*as_points([clean]))))}
        return [GRID[k] for k in _numbers([(made[d], read[d]) for d in read.keys() & made.keys()])]

    votes = agreed("kÃ¼mÃ¶n", "kümön")
    assert ("utf-8", "cp1252") in votes and ("utf-8", "cp1251") not in votes
    assert ("koi8_r", "cp1252") in agreed("ÐÒÉ×ÅÔ", "привет") and ("cp932", "cp1252") in agreed("ƒyƒ‹", "ペル")
    assert not agreed("kÃ¼mÃ¶n", "kümün")


def test_readings_that_lose_characters():
    assert losses("m�n", "mön") and losses("m��n", "mön") is False and losses("m�n�", "mönü")


def test_repair(spark):
    rows = [(i, w) for i, w in enumerate(CLEAN * 3)]
    garbled = {100 + i: (w.encode().decode("cp1252"), w) for i, w in enumerate(CLEAN)}
    garbled |= {200: ("schl�sser", "schlösser"), 201: ("nÃ¼lpe", "nülpe")}
    garbled |= {202: ("grüße".encode().decode("cp1252").encode().decode("cp1252", "replace"), "grüße")}
    rows += [(i, g) for i, (g, _) in garbled.items()]
    rows += [(300, None), (301, ""), (302, "Ã"), (303, "plain"), (304, "раypal"), (305, "x" * 50_000), (306, "löwe²")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "word_id long, word string, restored string")
    got = {r.word_id: r.restored for r in repair_words(frame).collect()}
    assert got == {i: w for i, (_, w) in garbled.items()}
    assert repair_words(frame.limit(0)).count() == 0
