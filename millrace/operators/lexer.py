"""Go lexing as Catalyst expressions.

One total pattern splits a text into pieces that concatenate to the text again. Everything up to
the array of tokens happens inside the row: no Python worker and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import gotokens as go
from millrace.operators.indexing import by_key

# The scanner's rules: raw strings and block comments run to the end of the text when they are
# not closed, strings and runes to the end of the line. Possessive groups keep the matcher
# iterative on literals of any length.
RAW_STRING = r"`[^`]*+`?"
STRING = r'"(?:\\["\\]|[^"\n])*+"?'
RUNE = r"'(?:\\['\\]|[^'\n])*+'?"
COMMENT = r"//[^\n]*+|/\*.*?(?:\*/|\z)"
WORD = r"[\p{L}_][\p{L}\p{Nd}_]*+"
NUMBER = (
    r"0[xX][0-9a-fA-F_]*+(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?[0-9_]*+)?i?"
    r"|(?:0[oObB][0-9_]*+|[0-9][0-9_]*+)(?:\.[0-9_]*+)?(?:[eEpP][+-]?[0-9_]*+)?i?"
    r"|\.[0-9][0-9_]*+(?:[eEpP][+-]?[0-9_]*+)?i?"
)
OPERATOR = (
    r"&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]="
)
LITERALS = "|".join([RAW_STRING, STRING, RUNE, COMMENT, NUMBER, OPERATOR])
# The most frequent pieces, words and white space, are tried first.
PATTERN = f"(?s)({WORD}|[ \\n]|{LITERALS}|.)"
# The same with white space in runs: a line break with its indent, and other blanks.
RUN_PATTERN = f"(?s)({WORD}|[ \\t\\r]++|\\n[\\t\\r]*+|{LITERALS}|.)"

_SPELLED = list(go.SPELLINGS)
_SPELLED_IDS = list(go.SPELLINGS.values())


def token_id(text: Column) -> Column:
    """Go token id of one piece of the pattern.

    Any longer piece that is neither spelled, quoted, a comment nor a number is a word, so only
    single characters need a look at their letter class. Blanks and words, the most frequent
    pieces, pass no array search.
    """

    def starts(*chars: str) -> Column:
        return reduce(lambda x, y: x | y, [F.startswith(text, F.lit(c)) for c in chars])

    hexadecimal = starts("0x", "0X")
    point_or_exponent = F.when(hexadecimal, text.rlike("[.pP]")).otherwise(text.rlike("[.eEpP]"))
    number = (
        F.when(F.endswith(text, F.lit("i")), go.IMAG)
        .when(point_or_exponent, go.FLOAT)
        .otherwise(go.INT)
    )
    spelled = F.array_position(F.lit(_SPELLED), text).cast("int")
    return (
        F.when(text == " ", go.SPACE)
        .when(text.isin(_SPELLED), F.get(F.lit(_SPELLED_IDS), spelled - 1))
        .when(starts('"', "`"), go.STRING)
        .when(starts("'"), go.CHAR)
        .when(starts("/"), go.COMMENT)
        .when(((text >= "0") & (text < ":")) | starts("."), number)
        .when(F.length(text) > 1, go.IDENT)
        .when(text.rlike(r"[\p{L}_]"), go.IDENT)
        .otherwise(0)
    )


def clean_literal(text: Column) -> Column:
    """Carriage returns leave raw strings and block comments, and the end of a line comment."""
    first = F.substring(text, 1, 1)
    return (
        F.when(~F.contains(text, F.lit("\r")), text)
        .when(F.startswith(text, F.lit("//")), F.regexp_replace(text, "\r\\z", ""))
        .when(first.isin("`", "/"), F.replace(text, F.lit("\r"), F.lit("")))
        .otherwise(text)
    )


def ascii_token_id(text: str) -> int:
    """``token_id`` of an ASCII piece inside a task."""
    if text in go.SPELLINGS:
        return go.SPELLINGS[text]
    first = text[0]
    if first in "\"`":
        return go.STRING
    if first == "'":
        return go.CHAR
    if first == "/":
        return go.COMMENT
    if first in "0123456789.":
        if text.endswith("i"):
            return go.IMAG
        marks = ".pP" if text.startswith(("0x", "0X")) else ".eEpP"
        return go.FLOAT if any(c in text for c in marks) else go.INT
    return go.IDENT if len(text) > 1 or first.isalpha() or first == "_" else 0


def ascii_clean_literal(text: str) -> str:
    """``clean_literal`` inside a task."""
    if text.startswith("//"):
        return text.removesuffix("\r")
    return text.replace("\r", "") if text[0] in "`/" else text


def pieces(content: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(1))


def lex(content: Column) -> Column:
    """ARRAY<STRUCT<tok_id, tok_name, literal>> of a text; carriage returns yield no token.

    White space is kept to the character: every blank, tab and line break is a token.
    """
    return identified(pieces(content))


def identified(found: Column) -> Column:
    """ARRAY<STRUCT<tok_id, tok_name, literal>> of an array of pieces."""
    kept = F.filter(found, lambda t: t != "\r")
    identified = F.transform(
        kept, lambda t: F.struct(token_id(t).alias("tok_id"), clean_literal(t).alias("literal"))
    )
    return F.transform(
        identified,
        lambda t: F.struct(
            t["tok_id"].alias("tok_id"), go.name_of(t["tok_id"]).alias("tok_name"), t["literal"].alias("literal")
        ),
    )


def token_table(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per token with byte offsets (key, pos, start, end, tok_id, tok_name, literal).

    Texts move to their key's partition before they are split, so the offsets' window needs no
    shuffle of the many small token rows.
    """
    split = by_key(documents, key).select(
        key, F.posexplode(pieces(F.col("content"))).alias("_pos", "_text")
    )
    before = W.partitionBy(key).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(key).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    size = F.octet_length("_text")
    placed = split.select(
        key,
        (F.count_if(F.col("_text") != "\r").over(so_far) - 1).cast("int").alias("pos"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int").alias("start"),
        "_text",
    ).where(F.col("_text") != "\r")
    return placed.select(
        key,
        "pos",
        "start",
        (F.col("start") + size).alias("end"),
        token_id(F.col("_text")).alias("tok_id"),
        clean_literal(F.col("_text")).alias("literal"),
    ).withColumn("tok_name", go.name_of(F.col("tok_id")))


def trainable_literals(tokens: Column) -> Column:
    """Literals a tokenizer is trained on: names, comments, strings and numbers."""
    return F.transform(
        F.filter(tokens, lambda t: t["tok_id"].isin(list(go.LITERAL_IDS))), lambda t: t["literal"]
    )


def typed_trainable_literals(tokens: Column) -> Column:
    """Literals of names, strings and comments, basic type words left out."""
    kinds = [go.IDENT, go.STRING, go.COMMENT]
    wanted = F.filter(tokens, lambda t: t["tok_id"].isin(kinds) & ~t["literal"].isin(list(go.BASIC_TYPES)))
    return F.transform(wanted, lambda t: t["literal"])


def kind_histogram(documents: DataFrame, *by: str) -> DataFrame:
    """Tokens per kind: counted per partition first, so only small counts are shuffled."""
    text = F.col("_text")
    return (
        documents.select(*by, F.explode(pieces(F.col("content"))).alias("_text"))
        .where(text != "\r")
        .groupBy(*by, token_id(text).alias("tok_id"))
        .agg(F.count("*").alias("n"))
        .withColumn("tok_name", go.name_of(F.col("tok_id")))
        .drop("tok_id")
    )
