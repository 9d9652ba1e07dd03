import pytest
from pyspark.sql import functions as F

from millrace.functions import gotokens as go
from millrace.operators import lexer


def lex(spark, text):
    row = spark.createDataFrame([(1, text)], "doc_id int, content string")
    return [
        (t.tok_name, t.literal)
        for t in row.select(lexer.lex(F.col("content")).alias("t")).first().t
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        ("a+b", [("IDENT", "a"), ("+", "+"), ("IDENT", "b")]),
        ("x // end", [("IDENT", "x"), ("SPACE", " "), ("COMMENT", "// end")]),
        ("// end\r\nx", [("COMMENT", "// end"), ("NEWLINE", "\n"), ("IDENT", "x")]),
        ("f(/* in\ncall */)", [("IDENT", "f"), ("(", "("), ("COMMENT", "/* in\ncall */"), (")", ")")]),
        ("/* open", [("COMMENT", "/* open")]),
        ("/*/ x", [("COMMENT", "/*/ x")]),
        ("`raw\r\n\\`;", [("STRING", "`raw\n\\`"), (";", ";")]),
        ('"a\\"b\\\\" c', [("STRING", '"a\\"b\\\\"'), ("SPACE", " "), ("IDENT", "c")]),
        ('"open\nx', [("STRING", '"open'), ("NEWLINE", "\n"), ("IDENT", "x")]),
        ("don't\n", [("IDENT", "don"), ("CHAR", "'t"), ("NEWLINE", "\n")]),
        ("'\\'' 'x'", [("CHAR", "'\\''"), ("SPACE", " "), ("CHAR", "'x'")]),
        ("0x1p-2 1.5e-3 2i .5 07 0b1_0 1e3i", None),
        ("a &^= b <<= c ... ~d", None),
        ("é_1 日本 # @", None),
        ("1..2", [("FLOAT", "1."), ("FLOAT", ".2")]),
        ("func f() {\n\t\treturn\n}", None),
    ],
)
def test_tokens(spark, text, expected):
    found = lex(spark, text)
    if expected is not None:
        assert found == expected
    else:
        assert "".join(literal for _, literal in found) == text


def test_number_kinds(spark):
    kinds = [n for n, _ in lex(spark, "0x1p-2 1.5e-3 2i .5 07 0b1_0 1e3i 0xe 0x.1p1") if n != "SPACE"]
    assert kinds == "FLOAT FLOAT IMAG FLOAT INT INT IMAG INT FLOAT".split()


def test_operators_and_words(spark):
    spelled = [s for s in go.SPELLINGS if not s.isspace()]
    found = [n for n, _ in lex(spark, " ".join(spelled)) if n != "SPACE"]
    assert found == spelled


def test_very_long_literals(spark):
    text = 'x := "' + "\\x00" * 50_000 + '" /*' + "*a" * 50_000 + "*/ `" + "b" * 50_000 + "`"
    assert [n for n, _ in lex(spark, text)] == ["IDENT", "SPACE", ":=", "SPACE", "STRING", "SPACE", "COMMENT", "SPACE", "STRING"]


def test_offsets_are_bytes(spark):
    row = spark.createDataFrame([(7, "é = 1\r\n日 \tx")], "doc_id int, content string")
    rows = lexer.token_table(row).orderBy("pos").collect()
    raw = "é = 1\r\n日 \tx".encode()
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [raw[r.start : r.end].decode() for r in rows] == [r.literal for r in rows]


def test_typed_literals(spark):
    row = spark.createDataFrame([(1, 'var x int16 = "s"; var b bool // c')], "doc_id int, content string")
    found = row.select(lexer.typed_trainable_literals(lexer.lex(F.col("content"))).alias("l")).first().l
    assert found == ["x", "int16", '"s"', "b", "// c"]


def test_dimension(spark):
    rows = go.dimension_rows()
    assert [i for i, _, _ in rows] == list(range(92))
    assert rows[12][1:] == ("+", "+") and rows[58][1:] == (":", ":") and rows[85][1:] == ("var", "var")
    ids = spark.createDataFrame([(89,), (92,), (4,)], "tok_id int")
    assert {tuple(r) for r in go.token_lookup(ids).collect()} == {
        (89, "SPACE", " "), (92, "UNKNOWN", ""), (4, "IDENT", "IDENT"),
    }
