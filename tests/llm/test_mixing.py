import pytest

from wordloom.llm.mixing import mix_sources

TARGETS = "source string, weight double, max_repeats int"


def run(spark, rows, targets, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")
    mix = mix_sources(docs, spark.createDataFrame(targets, TARGETS), **options)
    return {r.doc_id: r for r in mix.documents.collect()}, {r.source: r for r in mix.shares.collect()}


def test_shares(spark):
    rows = [(i, "a" if i % 10 else "b", "word " * (1 + i % 17), "clash") for i in range(2000)]
    rows += [(5000, None, "word", ""), (5001, "a", None, ""), (5002, "a", "", ""), (5003, "other", "word", "")]
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 2)]
    docs, shares = run(spark, rows, targets)
    assert not {5000, 5001, 5002, 5003} & set(docs)
    assert shares["none"].documents == 0 and shares["none"].actual_share == 0
    assert shares["a"].actual_share == pytest.approx(0.625, abs=2e-3)
    assert shares["b"].actual_share == pytest.approx(0.375, abs=2e-3)
    assert max(r.copies for r in docs.values() if r.source == "b") == 3
    assert {r.copies for r in docs.values() if r.source == "a"} == {1}
    again, _ = run(spark, rows, targets)
    assert {k: v.copies for k, v in docs.items()} == {k: v.copies for k, v in again.items()}


def test_smaller_total_mixes_copies(spark):
    rows = [(i, "a", "word word word", "") for i in range(500)] + [(1000 + i, "b", "word", "") for i in range(200)]
    docs, shares = run(spark, rows, [("a", 0.5, 2), ("b", 0.5, 9)], total_tokens=1000)
    assert shares["a"].tokens == pytest.approx(500, abs=2)
    assert shares["b"].tokens == pytest.approx(500, abs=1)
    assert {r.copies for r in docs.values() if r.source == "b"} == {2, 3}


def test_empty(spark):
    docs, shares = run(spark, [], [("a", 1.0, 1)])
    assert not docs and shares["a"].tokens == 0
    docs, shares = run(spark, [(1, "a", "word", "")], [])
    assert not docs and not shares


def test_large_documents_are_certain(spark):
    # One document of a third of the tokens: its inclusion probability would be above 1.
    rows = [(i, "a ", "x") for i in range(200)] + [(1000, "word " * 150, "x"), (1001, "word " * 60, "x")]
    rows += [(2000 + i, "a b c ", "y") for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.4, 1), ("y", 0.6, 1)], "source string, weight double, max_repeats int")
    taken = 0
    for seed in range(6):
        mix = mix_sources(documents, targets, total_tokens=900, size_power=1.0, seed=seed)
        found = {r.doc_id: r.copies for r in mix.documents.collect()}
        share = {r.source: r.actual_share for r in mix.shares.collect()}
        assert found[1000] == 1 and max(found.values()) == 1 and abs(share["x"] - 0.4) < 0.06
        taken += found.get(1001, 0)
    assert taken > 0
