"""Three tokenizers over document tables: plain metaspace, Go-aware, and typed Go.

Each trains on, encodes and decodes DataFrames. Documents are (keys..., content); encoded ones
are (keys..., ids).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import gotokens as go
from millrace.functions.text import ascii_strip, comment_inner, string_inner
from millrace.operators import bpe, lexer

# Indents told apart after a line break, and ids beyond the trained vocabulary.
INDENTS = 8
GO_EXTRA = go.GO_TOKENS + 3 + INDENTS
# Tokens written with one blank after them, and with one on both sides.
BLANK_AFTER = (
    ": , ; break default func interface select case defer go map struct chan else goto package "
    "switch const fallthrough if range type continue for import return var"
).split()
BLANK_AROUND = ":= = && || >= <= > < != == - + * / % += -= *= /= %= << >>".split()
# Borders of the typed id space.
TYPES_START = 89
MARKS = ('"', "//", "/*", "*/")
MARKS_START = TYPES_START + len(go.BASIC_TYPES)
TYPED_START = MARKS_START + len(MARKS)

RUN_OPEN, RUN_CLOSE = "\ue000", "\ue001"


class Tokenizer(Protocol):
    vocabulary: bpe.Vocabulary

    def training_words(self, corpus: DataFrame, *keys: str) -> DataFrame: ...

    def vocab_size(self) -> int: ...

    def encode(self, documents: DataFrame, *keys: str) -> DataFrame: ...

    def decode(self, ids: Column) -> Column: ...

    def id_to_token(self, token_id: Column) -> Column: ...


def fixed_unit(token_id: Column) -> Column:
    return F.array(
        F.struct(F.lit(None).cast("string").alias("word"), token_id.cast("int").alias("fixed"))
    )


@dataclass(frozen=True)
class MetaspaceSpeller:
    def units(self, piece: str) -> list[str | int]:
        return [bpe.META + piece]

    def word(self, text: str) -> str:
        return text

    def kind(self, piece: str) -> int:
        return bpe.PLAIN


@dataclass(frozen=True)
class GoSpeller:
    """ASCII pieces of ``lexer.RUN_PATTERN``; Go ids follow a vocabulary of ``size`` ids."""

    size: int

    def word(self, text: str) -> str:
        return bpe.byte_symbols(text)

    def kind(self, piece: str) -> int:
        """Runs of tabs and carriage returns that hold no blank are not written."""
        if piece[0] in " \t\r":
            return bpe.BLANK if " " in piece else bpe.UNWRITTEN
        return bpe.BLANK_AROUND if piece in BLANK_AROUND else bpe.BLANK_AFTER if piece in BLANK_AFTER else bpe.PLAIN

    def units(self, piece: str) -> list[str | int]:
        if piece[0] in " \t\r":
            return [self.size + go.SPACE]
        if piece[0] == "\n":
            tabs = len(piece.replace("\r", "")) - 1
            return [self.size + go.GO_TOKENS + min(tabs, INDENTS - 1)]
        tok_id = lexer.ascii_token_id(piece)
        if tok_id in go.LITERAL_IDS:
            return bpe.ascii_byte_level_words(lexer.ascii_clean_literal(piece))
        return [self.size + tok_id]


@dataclass(frozen=True)
class TypedGoSpeller:
    """ASCII pieces of ``lexer.PATTERN``."""

    compat: bool

    def word(self, text: str) -> str:
        return bpe.byte_symbols(text)

    def kind(self, piece: str) -> int:
        return bpe.UNWRITTEN if piece == "\r" or (piece in " \n\t" and not self.compat) else bpe.PLAIN

    def units(self, piece: str) -> list[str | int]:
        tok_id, literal = lexer.ascii_token_id(piece), lexer.ascii_clean_literal(piece)
        spell = bpe.ascii_byte_level_words
        if literal in go.BASIC_TYPES:
            return [TYPES_START + go.BASIC_TYPES.index(literal)]
        if tok_id == go.STRING:
            return [mark_id('"'), *spell(literal[1 : max(len(literal) - 1, 1)]), mark_id('"')]
        if tok_id == go.COMMENT and literal.startswith("//"):
            return [mark_id("//"), *spell(literal[2:])]
        if tok_id == go.COMMENT:
            return [mark_id("/*"), *spell(literal[2 : max(len(literal) - 2, 2)]), mark_id("*/")]
        return spell(literal) if tok_id == go.IDENT else [tok_id]


def mark_id(text: str) -> int:
    return MARKS_START + MARKS.index(text)


class MetaspaceTokenizer:
    extra_ids = 0
    first_id = 0

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.vocabulary = vocabulary

    @staticmethod
    def training_words(corpus: DataFrame, *keys: str) -> DataFrame:
        return corpus.select(*keys, bpe.metaspace_words(ascii_strip(F.col("content"))).alias("words"))

    @classmethod
    def train(cls, corpus: DataFrame, vocab_size: int, train_shards: int | None = None) -> MetaspaceTokenizer:
        """Train on the whole corpus, or on its first ``train_shards`` shards by ``shard_id``.

        All chosen rows make one training, whatever the chunks in which they would be fed.
        """
        if train_shards is not None:
            corpus = corpus.where(F.col("shard_id") < train_shards)
        return cls.train_counts(cls.word_counts(corpus), vocab_size)

    @classmethod
    def word_counts(cls, corpus: DataFrame) -> DataFrame:
        return bpe.word_counts(cls.training_words(corpus))

    @classmethod
    def train_counts(cls, counts: DataFrame, vocab_size: int) -> MetaspaceTokenizer:
        """Train on word counts (word, n), for instance merged from the tables of several shards."""
        return cls(bpe.train(counts, vocab_size - cls.extra_ids))

    @classmethod
    def count_shards(cls, corpus: DataFrame, path: str) -> None:
        """Store the word counts of each shard of (shard_id, content) that is not stored yet."""
        bpe.store_shard_counts(corpus, cls.training_words, path)

    def first(self, merges: int) -> MetaspaceTokenizer:
        """The tokenizer after the first merges of its training."""
        return type(self)(self.vocabulary.first(merges))

    def vocab_size(self) -> int:
        return len(self.vocabulary) + self.extra_ids

    def speller(self) -> bpe.Speller:
        return MetaspaceSpeller()

    def pieces(self, documents: DataFrame, *keys: str) -> DataFrame:
        return documents.select(*keys, bpe.metaspace_parts(F.col("content")).alias("pieces"))

    def encode(self, documents: DataFrame, *keys: str) -> DataFrame:
        """Ids of each document."""
        pieces = self.pieces(documents, *keys)
        return bpe.place_ids(pieces, self.vocabulary, self.speller(), self.first_id, *keys)

    def decode(self, ids: Column) -> Column:
        real = F.filter(ids, lambda i: i >= len(bpe.SPECIALS))
        text = F.array_join(F.transform(real, self.vocabulary.token_at), "")
        return F.regexp_replace(F.translate(text, bpe.META, " "), "^ ", "")

    def id_to_token(self, token_id: Column) -> Column:
        return self.vocabulary.token_at(token_id)


class GoTokenizer(MetaspaceTokenizer):
    """Go tokens and indents have ids of their own; names, comments and literals are spelled."""

    extra_ids = GO_EXTRA

    @staticmethod
    def literal_counts_words(literals: Column) -> Column:
        return F.flatten(
            F.transform(
                literals, lambda t: F.transform(bpe.byte_level_words(t), bpe.to_byte_symbols)
            )
        )

    @staticmethod
    def trainable(tokens: Column) -> Column:
        return lexer.trainable_literals(tokens)

    @classmethod
    def training_words(cls, corpus: DataFrame, *keys: str) -> DataFrame:
        literals = cls.trainable(lexer.lex(ascii_strip(F.col("content"))))
        return corpus.select(*keys, cls.literal_counts_words(literals).alias("words"))

    @classmethod
    def word_counts(cls, corpus: DataFrame) -> DataFrame:
        """Counts of the training words: pieces are counted first, and each distinct one is looked at once."""
        text = ascii_strip(F.col("content"))
        found = bpe.word_counts(corpus.select(lexer.pieces(text).alias("words")))
        words = cls.literal_counts_words(cls.trainable(lexer.identified(F.array("word"))))
        spelled = found.select("n", F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
        return spelled.groupBy("word").agg(F.sum("n").alias("n"))

    @staticmethod
    def spell(text: Column) -> Column:
        return bpe.word_units(bpe.byte_level_words(text))

    pattern = lexer.RUN_PATTERN

    def speller(self) -> bpe.Speller:
        return GoSpeller(len(self.vocabulary))

    def piece_units(self, piece: Column) -> Column:
        """Word and fixed-id units of a piece that is not white space."""
        tok_id = lexer.token_id(piece)
        return F.when(tok_id.isin(list(go.LITERAL_IDS)), self.spell(lexer.clean_literal(piece))).otherwise(
            fixed_unit(tok_id + len(self.vocabulary))
        )

    def pieces(self, documents: DataFrame, *keys: str) -> DataFrame:
        """Pieces of each text, and the units of those beyond ASCII, whose letters only Java's classes tell.

        White space comes in runs. A run with a blank is one SPACE, which is left out after a
        token that implies a blank and before one that has blanks on both sides. A line break
        carries the number of tabs that follow it.
        """
        text = F.col("_text")
        beyond = F.filter("pieces", lambda t: F.octet_length(t) != F.length(t))
        odd = F.when(F.octet_length(text) != F.length(text), F.transform(beyond, self.piece_units))
        return documents.select(
            *keys, F.col("content").alias("_text"), lexer.pieces(F.col("content"), self.pattern).alias("pieces")
        ).select(*keys, "pieces", odd.alias("odd"))

    def go_text(self) -> list[str]:
        """Text of the ids from the vocabulary's end on, blanks included."""
        out = []
        for _, _, literal in go.dimension_rows():
            if literal in BLANK_AROUND:
                out.append(f" {literal} ")
            elif literal in BLANK_AFTER:
                out.append(f"{literal} ")
            else:
                out.append(literal)
        return out + ["\n" + "\t" * t for t in range(GO_EXTRA - go.GO_TOKENS)]

    def decode(self, ids: Column) -> Column:
        """Runs of spelled ids are decoded together and lose their first character."""
        size, text = len(self.vocabulary), self.go_text()

        def piece(i: Column, at: Column) -> Column:
            opens = (at == 0) | (F.get(ids, F.greatest(at - 1, F.lit(0))) >= size)
            closes = F.coalesce(F.get(ids, at + 1) >= size, F.lit(True))
            spelled = F.when(i >= len(bpe.SPECIALS), self.vocabulary.token_at(i)).otherwise("")
            return F.when(
                i < size,
                F.concat(
                    F.when(opens, RUN_OPEN).otherwise(""),
                    spelled,
                    F.when(closes, RUN_CLOSE).otherwise(""),
                ),
            ).otherwise(F.get(F.lit(text), i - size))

        joined = F.array_join(F.transform(ids, piece), "")
        parts = F.split(joined, f"[{RUN_OPEN}{RUN_CLOSE}]", -1)

        def readable(part: Column, at: Column) -> Column:
            spelled = bpe.from_byte_symbols(part)
            return F.when(at % 2 == 1, F.substring(spelled, 2, 2**31 - 1)).otherwise(part)

        return F.array_join(F.transform(parts, readable), "")

    def id_to_token(self, token_id: Column) -> Column:
        size = len(self.vocabulary)
        plain = [literal for _, _, literal in go.dimension_rows()]
        plain += ["\n" + "\t" * t for t in range(GO_EXTRA - go.GO_TOKENS)]
        spelled = bpe.from_byte_symbols(self.vocabulary.token_at(token_id))
        return (
            F.when(token_id < len(bpe.SPECIALS), "")
            .when(token_id < size, F.substring(spelled, 2, 2**31 - 1))
            .otherwise(F.get(F.lit(plain), (token_id - size).cast("int")))
        )

    def id_to_token_name(self, token_id: Column) -> Column:
        return go_token_name(token_id, len(self.vocabulary), self.vocabulary.token_at(token_id))


def go_token_name(token_id: Column, size: int, spelled: Column) -> Column:
    """Display name of an id: ``name_`` and ``_name_`` show the blanks a token implies."""
    names = []
    for _, name, _ in go.dimension_rows():
        after, around = name in BLANK_AFTER, name in BLANK_AROUND
        names.append(f"{name}_" if after else f"_{name}_" if around else name)
    names += [f"NL_INDENT_{t}" for t in range(GO_EXTRA - go.GO_TOKENS)]
    return F.when(token_id < size, spelled).otherwise(
        F.get(F.lit(names), (token_id - size).cast("int"))
    )


class TypedGoTokenizer(GoTokenizer):
    """Go ids, then basic types, quotation and comment marks, then the spelled vocabulary.

    The ids 89 to 91 mean basic types. White space, which would share them, is left out unless
    ``compat`` asks for the shared ids.
    """

    extra_ids = TYPED_START
    first_id = TYPED_START

    def __init__(self, vocabulary: bpe.Vocabulary, compat: bool = False):
        super().__init__(vocabulary)
        self.compat = compat

    @staticmethod
    def trainable(tokens: Column) -> Column:
        return lexer.typed_trainable_literals(tokens)

    pattern = lexer.PATTERN

    def speller(self) -> bpe.Speller:
        return TypedGoSpeller(self.compat)

    def piece_units(self, piece: Column) -> Column:
        """The same; basic types are left to the speller, as all of them are ASCII."""
        literal, tok_id = lexer.clean_literal(piece), lexer.token_id(piece)
        block = F.substring(literal, F.lit(3), F.greatest(F.length(literal) - 4, F.lit(0)))

        def mark(text: str) -> Column:
            return fixed_unit(F.lit(mark_id(text)))

        return (
            F.when(tok_id == go.STRING, F.concat(mark('"'), self.spell(string_inner(literal)), mark('"')))
            .when(
                (tok_id == go.COMMENT) & F.startswith(literal, F.lit("//")),
                F.concat(mark("//"), self.spell(comment_inner(literal))),
            )
            .when(tok_id == go.COMMENT, F.concat(mark("/*"), self.spell(block), mark("*/")))
            .when(tok_id == go.IDENT, self.spell(literal))
            .otherwise(fixed_unit(tok_id))
        )

    def id_to_token(self, token_id: Column) -> Column:
        head = [name for i, name, _ in go.dimension_rows() if i < TYPES_START]
        head += [*go.BASIC_TYPES, *MARKS]
        spelled = token_id - TYPED_START
        return (
            F.when(token_id < TYPED_START, F.get(F.lit(head), token_id.cast("int")))
            .when(spelled < len(bpe.SPECIALS), "")
            .otherwise(bpe.from_byte_symbols(self.vocabulary.token_at(spelled)))
        )

    def decode(self, ids: Column) -> Column:
        return F.array_join(F.transform(ids, self.id_to_token), "")
