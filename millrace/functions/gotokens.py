"""The Go token dimension: ids, names and spellings, from the public ``go/token`` package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Token ids of go/token (Go 1.18 and later).
CLASSES = {0: "ILLEGAL", 1: "EOF", 2: "COMMENT", 4: "IDENT", 5: "INT", 6: "FLOAT", 7: "IMAG", 8: "CHAR", 9: "STRING"}
OPERATORS_FROM_12 = (
    "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- "
    "== < > = ! != <= >= := ... ( [ { , . ) ] } ; :"
).split()
KEYWORDS_FROM_61 = (
    "break case chan const continue default defer else fallthrough for func go goto if import "
    "interface map package range return select struct switch type var"
).split()
TILDE = (88, "~")
# Ids after the last Go token stand for single white-space characters.
SPACE, NEWLINE, TAB = 89, 90, 91
WHITESPACE = {SPACE: ("SPACE", " "), NEWLINE: ("NEWLINE", "\n"), TAB: ("TAB", "\t")}
GO_TOKENS = 92
# Ids 3, 10, 11, 59, 60, 86 and 87 mark group borders and print as token(n).
MARKERS = (3, 10, 11, 59, 60, 86, 87)

COMMENT, IDENT, INT, FLOAT, IMAG, CHAR, STRING = 2, 4, 5, 6, 7, 8, 9
LITERAL_IDS = (COMMENT, IDENT, INT, FLOAT, IMAG, CHAR, STRING)
LITERAL_NAMES = ("IDENT", "COMMENT", "STRING", "INT", "FLOAT", "IMAG", "CHAR")

# Basic type words of the typed id space, two of them with a trailing blank.
BASIC_TYPES = (
    "int", "int8", "int16 ", "int32 ", "int64", "uint", "uint8", "uint16", "uint32", "uint64",
    "uintptr", "float32", "float64", "complex64", "complex128", "string", "bool", "byte", "rune",
)

SPELLINGS = {
    **{s: 12 + i for i, s in enumerate(OPERATORS_FROM_12)},
    **{s: 61 + i for i, s in enumerate(KEYWORDS_FROM_61)},
    TILDE[1]: TILDE[0],
    **{text: i for i, (_, text) in WHITESPACE.items()},
}


def dimension_rows() -> list[tuple[int, str, str]]:
    """(id, name, literal) of all 92 tokens; a class prints its name for its literal."""
    rows = {i: (name, name) for i, name in CLASSES.items()}
    rows.update({i: (f"token({i})", f"token({i})") for i in MARKERS})
    rows.update({i: (s, s) for s, i in SPELLINGS.items()})
    rows.update(WHITESPACE)
    return [(i, *rows[i]) for i in sorted(rows)]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        dimension_rows(), "tok_id int, tok_name string, tok_literal string"
    )


def token_lookup(tokens: DataFrame, id_column: str = "tok_id") -> DataFrame:
    """Name and literal of each id; other ids are UNKNOWN with an empty literal."""
    dim = F.broadcast(dimension(tokens.sparkSession)).withColumnRenamed("tok_id", "_id")
    return tokens.join(dim, F.col(id_column) == F.col("_id"), "left").select(
        *tokens.columns,
        F.coalesce("tok_name", F.lit("UNKNOWN")).alias("tok_name"),
        F.coalesce("tok_literal", F.lit("")).alias("tok_literal"),
    )


_NAME_LIST = [name for _, name, _ in dimension_rows()]
_LITERAL_LIST = [literal for _, _, literal in dimension_rows()]


def name_of(tok_id: Column) -> Column:
    """Name by position in the 92-entry list, for use inside array expressions."""
    return F.coalesce(F.get(F.lit(_NAME_LIST), tok_id.cast("int")), F.lit("UNKNOWN"))
