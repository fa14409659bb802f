import random
import unicodedata

import pyarrow as pa

from wordloom.llm.visual_form import consistent_form, same_looking_pairs


def form(*texts):
    return consistent_form(pa.array(texts, pa.string())).to_pylist()


def test_same_look():
    same = [
        ("ｆｕｌｌ", "full"), ("ẹ́", "ẹ́"), ("zero​width­", "zerowidth"),
        (" a　b ", "a b"), ("раypаl", "paypal"), ("ﬁn", "fin"), ("ⅿⅰⅼ", "mil"), ("ﾋﾞｸ", "ビク"),
        ("한", "한"), ("Пpaкo", "Прако"), ("υπoλυ", "υπολυ"), ("ꓓսb", "Dub"), ("ё", "ë"),
    ]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    assert form("Прако") == ["Прако"] and form("paypal") == ["paypal"]


def test_other_look():
    for a, b in [("a", "A"), ("e", "é"), ("x²", "x2"), ("①", "1"), ("™", "TM"), ("l", "I"), ("rn", "m"), ("½", "1⁄2"), ("₂", "2")]:
        assert form(a) != form(b)


def test_edges_and_nfc():
    assert form("", None, "​", "  ", "́a", "x" * 100_000) == ["", None, "", "", "́a", "x" * 100_000]
    rnd = random.Random(1)
    letters = "aeouȩ̣́́̈ 가각ąビ゙カٓا"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for t, f in zip(texts, form(*texts)):
        assert f == unicodedata.normalize("NFC", t.strip(" ")), ascii(t)


def test_pairs(spark):
    rows = [
        (1, 1, "full"), (2, 1, "ｆｕｌｌ"), (3, 1, "full"), (4, 2, "full"), (5, 1, None), (6, 1, " "), (7, 1, "​"),
        (8, None, "full"), (9, 1, "Full"), (10, 1, "fu­ll"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "word_id long, model_id long, word string, form string")
    got = {tuple(r) for r in same_looking_pairs(frame).collect()}
    assert got == {(1, 2), (2, 3), (1, 10), (3, 10), (2, 10)}
    assert same_looking_pairs(frame.limit(0)).count() == 0


def test_classes(spark):
    from wordloom.llm.visual_form import look_alike_classes

    rows = [(1, 1, "cafe\u0301"), (2, 1, "café"), (3, 1, "café"), (4, 1, "cafe"), (5, 2, "café"), (6, 1, None), (7, None, "café"), (8, 3, "аbc"), (9, 3, "abc")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "word_id long, model_id long, word string, form string")
    got = {(r.model_id, r.spellings, r.rows, r.representative, r.word) for r in look_alike_classes(frame).collect()}
    assert got == {(1, 2, 3, 2, "café"), (3, 2, 2, 8, "аbc")}
    assert look_alike_classes(frame.limit(0)).count() == 0
