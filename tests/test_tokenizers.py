import random

import pyarrow as pa
import pytest
from models import greedy_bpe
from pyspark.sql import functions as F

from millrace.functions import gotokens as go
from millrace.operators import bpe, codecs, lexer
from millrace.plans import bindings as b
from millrace.plans import trained

GO = (
    'package main\n\nimport (\n\t"fmt"\n)\n\n/* x\ny */ var s = `raw\nstr` +  "a\\"bé" // Buz\n'
    "func f(x int) int { return 0x1p-2  + 1.5e-3 ; a , b:=  c }\r\n\t\t\t\t\t\t\t\t\tx.y   don't\n"
    'q "unterminated é 日本\n \t z \t = w\n\r\t <- p\t \t,  q'
)
PROSE = "the cat  sat on the mat\nthat the hat, as a cat's hat does: 12 hats "


def counts_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


@pytest.mark.parametrize("seed", range(3))
def test_training_equals_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(40)}
    words.update({"aaa": 5, "aaaa": 2, "abab": 3})
    tokens, merges = greedy_bpe(words, 40)
    found = bpe.train(counts_frame(spark, words), 40)
    assert found.tokens == tokens
    assert found.merges == merges


@pytest.mark.parametrize(("hot", "room"), [(1, 10**6), (3, 10**6), (64, 60), (1024, 10**6)])
def test_training_to_the_end_equals_one_merge_at_a_time(spark, monkeypatch, hot, room):
    rng = random.Random(hot)
    words = {"".join(rng.choices("abcd", [6, 3, 2, 1], k=rng.randint(1, 8))): rng.randint(1, 3) for _ in range(30)}
    words.update({"aaaaa": 5, "ababab": 3, "abcabc": 3, "bcbc": 3})
    monkeypatch.setattr(bpe, "HOT_PAIRS", hot)
    monkeypatch.setattr(bpe, "RUN_SYMBOLS", room)
    tokens, merges = greedy_bpe(words, 1000)
    found = bpe.train(counts_frame(spark, words), 1000)
    assert found.tokens == tokens and found.merges == merges


def test_registered_training_is_whole_and_takes_many_merges_a_round(spark, small, monkeypatch):
    rounds, apply = [], bpe.apply_merges
    monkeypatch.setattr(bpe, "apply_merges", lambda words, merges: rounds.append(len(merges)) or apply(words, merges))
    monkeypatch.setattr(trained, "_trained", {})
    size = trained.tokenizer(spark, small).vocab_size()
    counts = bpe.word_counts(codecs.MetaspaceTokenizer.training_words(b.corpus(spark, small)))
    assert trained.VOCABULARY == 2**15
    assert size == trained.VOCABULARY or sum(rounds) >= counts.count() / 2
    assert size > 1000 and sum(rounds) >= 50 * len(rounds)


@pytest.mark.parametrize("kind", ["metaspace", "go"])
def test_training_on_shards_sums_their_tables(spark, small, kind, tmp_path):
    cls = trained.KINDS[kind]
    docs = b.shards(spark, small, "content").where(F.col("doc_id") < 150).select("shard_id", "content")
    path = str(tmp_path / "counts")
    # Shards come one after another; those that are there are not counted again.
    cls.count_shards(docs.where("shard_id < 2"), path)
    cls.count_shards(docs, path)
    cls.count_shards(docs, path)
    assert spark.read.parquet(path).groupBy("shard_id", "word").count().where("count > 1").isEmpty()
    for n in (1, 2):
        expected = bpe.word_counts(cls.training_words(docs.where(F.col("shard_id") < n)))
        found = bpe.merged_counts(spark, path, n)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    every = bpe.word_counts(cls.training_words(docs))
    assert bpe.merged_counts(spark, path).exceptAll(every).isEmpty() and bpe.merged_counts(spark, path, 0).isEmpty()
    # Training from the tables equals training from the text, and the model that takes one merge at a time.
    few = 40
    counts = {r.word: r.n for r in bpe.merged_counts(spark, path, 1).collect()}
    size = len({c for w in counts for c in w}) + len(bpe.SPECIALS) + few
    tokens, merges = greedy_bpe(counts, size)
    direct = cls.train(docs, size + cls.extra_ids, train_shards=1).vocabulary
    merged = cls.train_counts(bpe.merged_counts(spark, path, 1), size + cls.extra_ids).vocabulary
    assert (direct.tokens, direct.merges) == (merged.tokens, merged.merges) == (tokens, merges)


def test_first_merges_are_a_shorter_training(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(40)}
    whole = bpe.train(counts_frame(spark, words), 60)
    for n in (0, 1, 5, 20):
        tokens, merges = greedy_bpe(words, 6 + n)
        assert whole.first(n) == bpe.Vocabulary(tokens, merges)
    assert whole.first(10**6) == whole


def test_training_runs_out_of_pairs(spark):
    found = bpe.train(counts_frame(spark, {"ab": 2, "c": 1}), 100)
    assert found.tokens == [*bpe.SPECIALS, "a", "b", "c", "ab"]


def test_leading_pairs_alone_reach_the_driver(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("".join(map(bpe.symbol, rng.sample(range(50), 2))).encode(), rng.randint(1, 9)) for _ in range(400)]
    rows = list(dict(rows).items())
    frame = spark.createDataFrame(rows, "pair binary, n bigint").repartition(7)

    def refuse(self):
        raise AssertionError("a limit that is collected sends its rows of every partition")

    monkeypatch.setattr(type(frame), "collect", refuse)
    expected = sorted((-n, tuple(bpe.ids_of(pair.decode()))) for pair, n in rows)
    assert bpe.leading_pairs(frame, 40) == expected[:40]
    assert bpe.leading_pairs(frame, 10**4) == expected
    assert bpe.leading_pairs(frame.where("n > 99"), 5) == []


def test_training_limits(spark):
    words = {"abab": 3, "bcbc": 2}
    assert len(bpe.train(counts_frame(spark, words), 7)) == 7


@pytest.fixture(scope="module")
def prose(spark):
    texts = [PROSE, GO, "", " ", "  a", "a ", "né é", "x\n\ny"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")


@pytest.fixture(scope="module")
def metaspace(prose):
    return codecs.MetaspaceTokenizer.train(prose, 90)


@pytest.fixture(scope="module")
def go_tokenizer(prose):
    return codecs.GoTokenizer.train(prose, 90 + codecs.GO_EXTRA)


def library(vocabulary, level):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.models.BPE(
        vocab={t: i for i, t in enumerate(vocabulary.tokens)},
        merges=[(vocabulary.tokens[a], vocabulary.tokens[b]) for a, b, _ in vocabulary.merges],
        unk_token="[UNK]",
        fuse_unk=True,
    )
    t = tokenizers.Tokenizer(model)
    t.add_special_tokens(bpe.SPECIALS)
    if level == "byte":
        t.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel()
        t.decoder = tokenizers.decoders.ByteLevel()
    else:
        t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
        t.decoder = tokenizers.decoders.Metaspace()
    return t


def test_metaspace_equals_library(prose, metaspace):
    t = library(metaspace.vocabulary, "meta")
    for r in metaspace.encode(prose, "doc_id").join(prose, "doc_id").select(
        "content", "ids", metaspace.decode(F.col("ids")).alias("decoded")
    ).collect():
        assert r.ids == t.encode(r.content).ids
        assert r.decoded == t.decode(r.ids)


def go_ids(spark, tokenizer, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    encoded = tokenizer.encode(frame, "doc_id").select("doc_id", "ids", tokenizer.decode(F.col("ids")).alias("back"))
    return {texts[r.doc_id]: (r.ids, r.back) for r in encoded.collect()}


def test_go_ids_of_snippets(spark, go_tokenizer):
    """Written out from the rules: 42 is =, 49 and 54 are parentheses, 85 is var, 89 a blank and
    92 to 99 a line break with up to seven tabs."""
    t, size = library(go_tokenizer.vocabulary, "byte"), len(go_tokenizer.vocabulary)
    rows = {
        "": ([], ""),
        "x": (["x"], "x"),
        "x y": (["x", 89, "y"], "x y"),
        "x  \t y": (["x", 89, "y"], "x y"),
        "x = 1": (["x", 42, "1"], "x = 1"),
        "x=1": (["x", 42, "1"], "x = 1"),
        "x   =   1": (["x", 42, "1"], "x = 1"),
        "var x": ([85, "x"], "var x"),
        "f(x)": (["f", 49, "x", 54], "f(x)"),
        "f ( x )": (["f", 89, 49, 89, "x", 89, 54], "f ( x )"),
        "a\n\t\tx": (["a", 94, "x"], "a\n\t\tx"),
        "a\n" + 9 * "\t" + "x": (["a", 99, "x"], "a\n" + 7 * "\t" + "x"),
        "a\tx": (["a", "x"], None),
    }
    got = go_ids(spark, go_tokenizer, list(rows))
    for text, (parts, back) in rows.items():
        expected = [i for p in parts for i in (t.encode(p).ids if isinstance(p, str) else [size + p])]
        assert got[text][0] == expected, text
        assert back is None or got[text][1] == back


def test_blank_runs_count_once(spark, go_tokenizer):
    texts = [f"x{' ' * a}{'\t' * b}y" for a in range(1, 4) for b in range(3)]
    assert len({tuple(ids) for ids, _ in go_ids(spark, go_tokenizer, texts).values()}) == 1


def test_go_round_trip_of_formatted_code(spark, go_tokenizer):
    code = 'package main\n\nfunc f(x int) {\n\tif x == 1 {\n\t\treturn x\n\t}\n\tmain("cat")\n}\n'
    row = spark.createDataFrame([(1, code)], "doc_id int, content string")
    back = go_tokenizer.encode(row, "doc_id").select(go_tokenizer.decode(F.col("ids")).alias("d")).first().d
    letters = set("".join(go_tokenizer.vocabulary.tokens))
    assert set("cat12x") <= letters
    assert back.replace('"', "") == code.replace('"', "")


def test_typed_ids(spark, prose):
    typed = codecs.TypedGoTokenizer.train(prose, 80 + codecs.TYPED_START)
    row = spark.createDataFrame(
        [(1, 'var x int16 = "ab" /* c */ // d\nvar b bool = 5')], "doc_id int, content string"
    )
    ids = typed.encode(row, "doc_id").first().ids
    t = library(typed.vocabulary, "byte")

    def spell(s):
        return [i + codecs.TYPED_START for i in t.encode(s).ids]

    at = codecs.MARKS_START
    expected = [85, *spell("x"), *spell("int16"), 42, at, *spell("ab"), at, at + 2, *spell(" c "), at + 3]
    expected += [at + 1, *spell(" d"), 85, *spell("b"), 89 + go.BASIC_TYPES.index("bool"), 42, 5]
    assert ids == expected
    compat = codecs.TypedGoTokenizer(typed.vocabulary, compat=True)
    assert compat.encode(row, "doc_id").first().ids[1] == 89
    assert typed.vocab_size() == len(typed.vocabulary) + 112


def test_encoding_keeps_documents_in_their_rows(prose, metaspace, go_tokenizer):
    for tokenizer in (metaspace, go_tokenizer):
        plan = tokenizer.encode(prose, "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_encoding_of_null_documents(spark, metaspace, go_tokenizer):
    frame = spark.createDataFrame([(1, None), (2, "the")], "doc_id int, content string")
    for tokenizer in (metaspace, go_tokenizer):
        ids = {r.doc_id: r.ids for r in tokenizer.encode(frame, "doc_id").collect()}
        assert ids[1] == [] and ids[2]


def test_vocabulary_survives_storage(spark, metaspace, tmp_path):
    metaspace.vocabulary.save(spark, str(tmp_path / "v"))
    loaded = bpe.Vocabulary.load(spark, str(tmp_path / "v"))
    assert loaded == metaspace.vocabulary
    a, b = loaded.vocab_table(spark), metaspace.vocabulary.vocab_table(spark)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_id_names(spark, go_tokenizer):
    size = len(go_tokenizer.vocabulary)
    ids = spark.range(size, size + 100).select(F.col("id"))
    rows = {r.id - size: (r.t, r.n) for r in ids.select(
        "id", go_tokenizer.id_to_token(F.col("id")).alias("t"), go_tokenizer.id_to_token_name(F.col("id")).alias("n")
    ).collect()}
    assert rows[12] == ("+", "_+_") and rows[57] == (";", ";_") and rows[49] == ("(", "(")
    assert rows[94] == ("\n\t\t", "NL_INDENT_2") and rows[90] == ("\n", "NEWLINE")


def test_byte_alphabet():
    letters = bpe.byte_alphabet()
    assert len(set(letters)) == 256
    assert (letters[32], letters[10], letters[65]) == ("Ġ", "Ċ", "A")


def test_metaspace_words_at_blanks_and_signs(spark):
    """Words of odd texts; both the blank and its sign separate."""
    m = bpe.META
    texts = {
        "": [], " ": [m], "a": [m + "a"], "a ": [m + "a", m], " a": [m + "a"], "  a": [m, m + "a"], "a\n b": [m + "a\n", m + "b"],
        m: [m], m + "a": [m + "a"], f" {m}a": [m, m + "a"], f"a{m} é": [m + "a", m, m + "é"], None: [],
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", bpe.metaspace_words(F.col("t")).alias("w")).collect():
        assert row.w == texts[row.t], row


def test_special_tokens_come_with_the_sizes_of_trained_vocabularies(spark, small):
    from millrace.plans.queries import QUERIES

    rows = QUERIES["special_token_lookup"](spark, small).collect()
    assert [(r.token, r.id) for r in rows] == [("[UNK]", 0), ("[PAD]", 1), ("[EOS]", 2)]
    for kind, extra in (("metaspace", 0), ("go", 103), ("typed", 112)):
        learnt = trained.first_merges(spark, small, kind).vocabulary
        assert {r[f"{kind}_size"] for r in rows} == {len(learnt.tokens) + extra} and len(learnt.merges) == trained.FIRST_MERGES


ODD = ["a", "int", "int16 ", " ", "\t", "\r", "\n", "\n\t", '"', "'", "`", "//", "/*", "*/", "0x1p", ".5e", "i", "_"]
ODD += ["~", "\x00", "\x1c", "\x1f", "\x0b", "\x0c", "=", ":=", "func", "return", ",", "-", "'s", "\\", "1", "string"]


@pytest.mark.parametrize("compat", [None, False, True])
def test_tasks_spell_ascii_pieces_as_columns_do(spark, compat):
    rng = random.Random(3)
    vocabulary = bpe.Vocabulary([*bpe.SPECIALS, "a"], [])
    tok = codecs.GoTokenizer(vocabulary) if compat is None else codecs.TypedGoTokenizer(vocabulary, compat)
    texts = ["".join(rng.choices(ODD, k=rng.randint(1, 40))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    pieces = tok.pieces(frame, "doc_id").select(F.explode("pieces").alias("p")).distinct()
    inked = pieces.where(~F.col("p").rlike(r"^[ \t\r\n]"))
    speller = tok.speller()
    for p, units in inked.select("p", tok.piece_units(F.col("p"))).collect():
        expected = [u.fixed if u.word is None else u.word for u in units]
        if compat is None or lexer.ascii_clean_literal(p) not in go.BASIC_TYPES:
            assert speller.units(p) == expected, p


@pytest.mark.parametrize("cls", [codecs.GoTokenizer, codecs.TypedGoTokenizer])
def test_counting_pieces_first_counts_the_same_words(spark, prose, cls):
    expected = bpe.word_counts(cls.training_words(prose.union(prose)))
    assert sorted(cls.word_counts(prose.union(prose)).collect()) == sorted(expected.collect())


def test_a_distinct_piece_is_spelled_once():
    seen = []

    class Counting(codecs.GoSpeller):
        def units(self, piece):
            seen.append(piece)
            return super().units(piece)

    encoder = bpe.PieceEncoder(bpe.Vocabulary([*bpe.SPECIALS, "Ġ", "a"], []), 0, Counting(5))
    rows = pa.array([["a", " ", "a", "=", " ", "a"], None, [], ["a", "\t", "\n\t"]], pa.list_(pa.string()))
    ids = bpe._placed(rows, None, encoder).to_pylist()
    assert bpe._placed(rows, None, encoder).to_pylist() == ids
    equals = 5 + go.SPELLINGS["="]
    assert ids == [[3, 4, 5 + go.SPACE, 3, 4, equals, 3, 4], [], [], [3, 4, 5 + go.GO_TOKENS + 1]]
    assert sorted(seen) == sorted({"a", " ", "=", "\t", "\n\t"})
