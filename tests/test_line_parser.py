from wordloom.operators.line_parser import parse_lines

MODELS = [(1, "text", 2), (2, "text_dims", 2), (3, "csv", 2), (4, None, 2)]


def run(spark, lines):
    models = spark.createDataFrame(MODELS, "model_id long, layout string, dims int")
    schema = "line_id long, model_id long, line_no long, line_bytes binary, reasons string"
    rows = [(i, m, n, None if b is None else bytearray(b), "clash") for i, m, n, b in lines]
    result = parse_lines(spark.createDataFrame(rows, schema), models)
    clean = {r.line_id: (r.word, [round(x, 3) for x in r.embedding]) for r in result.clean.collect()}
    rejected = {r.line_id: r.reasons for r in result.rejected.collect()}
    return clean, rejected


def test_layouts(spark):
    clean, rejected = run(
        spark,
        [
            (1, 1, 1, b"  a \t1 \x0c-2.5e0\r"),
            (2, 1, 2, b"a 1"),
            (3, 2, 1, b"5 2"),
            (4, 2, 2, b"x .5 5."),
            (5, 3, 1, b'"a ""b"", c",1,"2"\r'),
            (6, 3, 2, b'a"b,1,2'),
            (7, 3, 3, b',1,2'),
            (8, 1, 3, b"\xff 1 2"),
            (9, 1, 4, b"w 1e39 1"),
            (10, 1, 5, b"w 1e-99 nan"),
            (11, 1, 6, b""),
            (12, 1, 7, None),
            (13, 4, 1, b"w 1 2"),
            (14, 99, 1, b"w 1 2"),
            (15, 3, 4, b"w, 1,2"),
        ],
    )
    assert clean == {1: ("a", [1.0, -2.5]), 4: ("x", [0.5, 5.0]), 5: ('a "b", c', [1.0, 2.0])}
    assert 3 not in rejected
    assert rejected[2] == ["wrong number of fields"]
    assert rejected[6] == ["broken quoting"]
    assert rejected[7] == ["word is empty"]
    assert rejected[8] == ["bytes are not valid UTF-8"]
    assert rejected[9] == ["component is not finite as FLOAT"]
    assert rejected[10] == ["component is not a number"]
    assert rejected[11] == ["wrong number of fields"]
    assert rejected[12] == ["line is null"]
    assert rejected[13] == rejected[14] == ["model has no known layout"]
    assert rejected[15] == ["component is not a number"]


def test_empty_and_long(spark):
    clean, rejected = run(spark, [])
    assert not clean and not rejected
    long = b'"' + b"x" * 200_000 + b'",1,2'
    clean, rejected = run(spark, [(1, 3, 1, long), (2, 3, 2, b"w,1," + b"9" * 100_000)])
    assert len(clean[1][0]) == 200_000 and rejected[2] == ["component is not finite as FLOAT"]
