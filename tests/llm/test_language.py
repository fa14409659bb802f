import numpy as np
import pytest

from wordloom.llm.language import fit, language_of_label, mislabelled_or_mixed, passages

TEXTS = {
    "en": "The {a} is connected with the {b} so that the noise remains low. As shown in figure {n}, the {b} surrounds the {a} at least in part.",
    "de": "Der {a} ist mit dem {b} verbunden, sodass kaum ein Geräusch entsteht. Wie in Figur {n} gezeigt, liegt der {b} wenigstens teilweise an dem {a} an.",
    "fr": "Le {a} est relié avec le {b} de sorte que le bruit reste faible. Comme le montre la figure {n}, le {b} entoure le {a} au moins en partie.",
    "zh": "所述{a}通过所述{b}连接，并且噪声很小。如图{n}所示，所述{b}至少部分地包围所述{a}，即使在高负载下也是如此。",
}


def text(language, n):
    return TEXTS[language].format(a=f"motor {n}", b=f"sensor {n * 7}", n=n)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(100 * k + n, " ".join(text(x, n + i) for i in range(5)), x) for k, x in enumerate(TEXTS) for n in range(40)]
    rows += [
        (1000, text("de", 1), "en"), (1001, text("fr", 2), None), (1002, text("en", 3), "EN-us"), (1003, text("en", 3), "und"),
        (1004, text("en", 4) + "\n" + text("de", 4) + "\n\n" + text("de", 5), "en"),
        (1005, None, "en"), (1006, "", None), (1007, " \n ", None), (1008, "ABSTRACT", None), (1009, "1 | 2 | 3", None),
        (1010, text("en", 4) + " Here the lid („Das ist nur ein fremdes Zitat hier“) is closed with the motor.", "en"),
        (1011, text("zh", 4) + "这里所述的传感器（state of the art）至少部分地包围所述电机。", "zh"),
        (1012, (text("fr", 1) + " ") * 3000, "fre"),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, passage string")


def test_cases(documents):
    got = {tuple(r) for r in mislabelled_or_mixed(documents).collect()}
    assert got == {(1000, "de"), (1001, "fr"), (1003, "en"), (1004, "de"), (1004, "en")}


def test_passages(documents):
    rows = [r for r in passages(documents).collect() if r.doc_id == 1004]
    whole = documents.where("doc_id = 1004").first().text
    assert [r.lang for r in rows] == ["en", "de"] and [r.sentences for r in rows] == [2, 4]
    assert whole[rows[1].begin : rows[1].end].startswith("Der motor") and rows[0].confidence > 0.8


def test_every_text_has_a_row(spark, documents):
    few = [
        (1, "Der Motor ist hier.", None), (2, "ABSTRACT", None), (3, "1 | 2 | 3", None), (4, " \n", None), (5, None, None), (6, "图如下。", None),
        (7, "Das Geräusch ist klein.\nDer Sensor liegt an.", "und"), (8, "„Der Motor ist verbunden“", "de"),
    ]
    frame = spark.createDataFrame(few, "doc_id long, text string, lang string")
    classifier = fit(documents)
    rows = {r.doc_id: r for r in passages(frame, classifier).collect()}
    assert set(rows) == {1, 2, 3, 6, 7, 8} and all(0 <= r.confidence <= 1 for r in rows.values())
    assert rows[3].lang is None and rows[3].confidence == 0 and rows[2].sentences == 0
    assert (rows[1].lang, rows[6].lang, rows[7].lang, rows[7].sentences, rows[8].lang) == ("de", "zh", "de", 2, "de")
    assert (rows[7].begin, rows[7].end) == (0, len(few[6][1]))
    assert {tuple(r) for r in mislabelled_or_mixed(frame, classifier).collect()} == {(1, "de"), (6, "zh"), (7, "de")}


def test_confidence_grows_with_the_lead():
    from wordloom.llm.language import _line

    lead = np.linspace(0, 1, 2000)
    right = np.random.default_rng(0).random(2000) < 1 / (1 + np.exp(-(8 * lead - 1)))
    slope, level = _line(lead, right)
    assert abs(slope - 8) < 1.5 and abs(level + 1) < 0.5


def test_very_long_texts(documents, monkeypatch):
    import pyarrow as pa

    from wordloom.llm import points
    from wordloom.llm.language import BORDER, find_passages, score_sentences

    classifier = fit(documents)
    whole = " ".join([text("en", 1)] * 9) + "\n" + " ".join([text("de", 2)] * 9)

    def found():
        parts = [find_passages(score_sentences(classifier, t, s), classifier) for _, t, s in points.chunks(pa.array([whole, None]), BORDER)]
        return [(classifier.languages[x], b, e, n) for p in parts for x, b, e, n in zip(p.language, p.begin, p.end, p.sentences)]

    once = found()
    monkeypatch.setattr(points, "PIECE_BYTES", 128)
    assert found() == once and [x[0] for x in once] == ["en", "de"] and once[1][2] == len(whole)


def test_labels_and_empty(spark, documents):
    frame = spark.createDataFrame([(x,) for x in ["en", "EN", "en-US", "eng", "ger", "zh-CN", "n/a", "it", " ", None, "english"]], "l string")
    assert [r[0] for r in frame.select(language_of_label(frame.l)).collect()] == ["en"] * 4 + ["de", "zh"] + [None] * 5
    assert mislabelled_or_mixed(documents.limit(0)).count() == 0
    assert fit(documents.where("lang is null")) is None


def test_other_languages(spark, documents):
    made = documents.where("lang in ('de', 'fr')").replace("fr", "lb", "lang")
    classifier = fit(made, {"de": "de", "lb": "lb ltz"})
    assert classifier.languages == ["de", "lb"]
    assert mislabelled_or_mixed(made.replace("lb", "ltz", "lang"), classifier).count() == 0
