"""Every operator bound to the given tables: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import gotokens as go
from millrace.functions import text as t
from millrace.operators import (
    bpe,
    checkpoints,
    codecs,
    dataset,
    evaluation,
    lexer,
    metrics,
    prompts,
)
from millrace.operators.indexing import row_index, shuffled_index
from millrace.plans import bindings as b
from millrace.plans.trained import FIRST_MERGES, first_merges, shard_counts, tokenizer
from millrace.session import fresh_path, materialise
from millrace.sources import corpus as src
from millrace.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WIDTH, STRIDE = 65, 64
SEED = 42
PAD = "<pad>"
GO_SIZE = 1000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(words, sep: str = " "):
    return F.array_join(words, sep)


def spread_corpus(spark, sf):
    return b.spread(b.corpus(spark, sf), "doc_id")


# Sources and sinks


@query
def corpus_scan(spark, sf):
    return src.read_corpus(spark, f"{sf}/documents.parquet", "text")


@query
def corpus_select(spark, sf):
    return src.select_slice(b.corpus(spark, sf), lang="en").select("doc_id", "content")


@query
def file_inventory(spark, sf):
    return src.list_files(spark, sf, ".parquet", SEED).select("name", "length")


@query
def jsonl_samples_scan(spark, sf):
    path = fresh_path(spark, "samples")
    b.corpus(spark, sf).select(F.col("content").alias("sample")).write.json(path)
    good, _ = src.split_rejected(src.read_samples(spark, path))
    return good


@query
def jsonl_prompts_scan(spark, sf):
    path = fresh_path(spark, "prompts")
    b.prompts(spark, sf).select("description", "package").write.json(path)
    return src.read_prompts(spark, path)


@query
def eval_tasks_scan(spark, sf):
    path = fresh_path(spark, "tasks")
    rows = b.prompts(spark, sf).select(
        F.col("conv_id").cast("string").alias("task_id"),
        F.col("description").alias("prompt"),
        F.lit("import").alias("import"),
        F.col("package").alias("test_setup"),
        F.lower("description").alias("test"),
    )
    rows.write.json(path)
    return src.read_tasks(spark, path)


CURVE_FILES = 4


@query
def loss_csv_scan(spark, sf):
    """Two curves, each a folder of several files whose names follow the steps."""
    paths = []
    for kind in ("click", "view"):
        paths.append(fresh_path(spark, "curve"))
        lines = b.curve(spark, sf, kind).select(
            F.col("step").cast("double"), F.floor(metrics.micros("ts") / 1000000), "loss"
        )
        lines.repartitionByRange(CURVE_FILES, "step").sortWithinPartitions("step").write.csv(paths[-1])
    return src.read_curve(spark, paths)


@query
def write_row_shards(spark, sf):
    path = fresh_path(spark, "shards")
    src.write_shards(b.shards(spark, sf, "content"), path, "doc_id")
    return src.shard_manifest(spark.read.parquet(path))


def encoded_shards(spark, sf, kind: str = "metaspace", tok=None) -> DataFrame:
    """Encoded documents with their shard, encoded and placed where they were read."""
    tok = tok or tokenizer(spark, sf, kind)
    docs = b.spread(b.shards(spark, sf, "content"), "doc_id")
    return tok.encode(docs, "shard_id", "doc_id").withColumn("rn", F.col("doc_id"))


def written_tokens(spark, sf, encoded: DataFrame) -> DataFrame:
    """Documents and tokens of each written shard, beside the total of its summary."""
    path = fresh_path(spark, "token-shards")
    src.write_token_shards(encoded, path)
    total = spark.read.schema("num_tokens bigint").json(f"{path}/summary.json").first()[0]
    return src.read_token_shards(spark, path).groupBy("shard_id").agg(
        F.count("*").alias("documents"), F.sum(F.size("ids")).alias("num_tokens")
    ).withColumn("summary_tokens", F.lit(total).cast("bigint"))


@query
def write_token_shards(spark, sf):
    return written_tokens(spark, sf, encoded_shards(spark, sf))


@query
def write_token_shards_first_merges(spark, sf):
    """The same with ids that SQL can repeat: the first merges of the whole training."""
    return written_tokens(spark, sf, encoded_shards(spark, sf, tok=first_merges(spark, sf)))


@query
def token_shard_scan(spark, sf):
    path = fresh_path(spark, "word-shards")
    src.write_shards(b.word_tokens(spark, sf), f"{path}/shards")
    return src.read_token_shards(spark, path).select("shard_id", "doc_id", joined("ids").alias("text"))


@query
def token_summary(spark, sf):
    """The number of tokens written as a summary and read again; no row numbers, no shards."""
    path = fresh_path(spark, "summary")
    words = b.corpus(spark, sf).select(F.split("content", " ").alias("ids"))
    src.write_summary(src.token_summary(words), path)
    return spark.read.schema("num_tokens bigint").json(path)


@query
def append_jsonl(spark, sf):
    path = fresh_path(spark, "appended")
    said = b.table(spark, sf, "conversations").select("role", F.col("text").alias("sample"))
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    src.append_samples(said.where(is_user), path)
    src.append_samples(said.where(~is_user), path)
    return src.read_samples(spark, path).select("sample")


@query
def write_eval_summary(spark, sf):
    path = fresh_path(spark, "evaluation")
    summary = evaluation.nested_summary(evaluation.outcomes(b.candidates(spark, sf)))
    evaluation.write_eval_summary(summary, path)
    return spark.read.schema(summary.schema).json(path).select(
        "task_id", F.size("candidate_sequences").alias("n"), "num_compiled", "num_passed"
    )


@query
def vocab_save_load(spark, sf):
    path = fresh_path(spark, "vocabulary")
    tokenizer(spark, sf).vocabulary.save(spark, path)
    return bpe.Vocabulary.load(spark, path).vocab_table(spark)


# Scalar text functions


@query
def ascii_strip(spark, sf):
    return b.corpus(spark, sf).select("doc_id", t.ascii_strip(F.col("content")).alias("content"))


@query
def strip_ws(spark, sf):
    padded = F.concat(F.lit(" \n\t"), F.col("content"), F.lit("\r\n "))
    return b.corpus(spark, sf).select("doc_id", t.strip_ws(padded).alias("content"))


@query
def truncate_after_marker(spark, sf):
    return b.corpus(spark, sf).select(
        "doc_id", t.truncate_after(F.col("content"), ".\n").alias("content")
    )


@query
def assemble_sources(spark, sf):
    return b.prompts(spark, sf).select(
        "conv_id",
        t.test_source(F.col("package"), F.col("description")).alias("test_source"),
        t.candidate_source(F.col("description"), F.col("package")).alias("program"),
    )


def sizes(spark, sf) -> DataFrame:
    """Products of keys, in decimals: with keys of some millions they are beyond 64 bits."""
    o = b.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("decimal(38,0)")
    return o.select("o_orderkey", (key * key * F.col("o_custkey") * (F.col("o_custkey") % 2 * 999 + 1)).alias("n"))


@query
def human_bytes(spark, sf):
    return sizes(spark, sf).select("o_orderkey", t.human_bytes(F.col("n")).alias("size"))


@query
def human_count(spark, sf):
    return sizes(spark, sf).select("o_orderkey", t.human_count(F.col("n")).alias("count"))


PHASES = list(t.PHASE_PREFIX)


@query
def metric_name_prefix(spark, sf):
    phase = F.element_at(F.lit(PHASES), (F.col("event_id") % len(PHASES) + 1).cast("int"))
    return b.table(spark, sf, "events").select(
        "event_id", t.metric_path(phase, F.col("event_type")).alias("path")
    )


@query
def checkpoint_filename(spark, sf):
    pattern = F.when(F.col("event_type") == "signup", "run-step={step}-lr={lr}.pt").otherwise(
        "run-step={step}-loss={loss:.2f}.pt"
    )
    name = t.fill_filename(pattern, {"step": F.col("event_id"), "loss": F.col("value") / 7})
    named = b.table(spark, sf, "events").select("event_id", name.alias("file"))
    return named.where(~F.contains("file", F.lit("{")))


@query
def metrics_to_string(spark, sf):
    pair = F.array(
        F.struct(F.lit("LOSS").alias("name"), (F.col("l_discount") / 7).alias("value")),
        F.struct(F.lower("l_returnflag").alias("name"), (F.col("l_tax") / 3).alias("value")),
    )
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", t.metrics_line(pair, "Test").alias("line")
    )


@query
def split_object_url(spark, sf):
    parts = t.object_url_parts(F.col("url"), "https://")
    return b.table(spark, sf, "pages").select("page_id", *parts)


@query
def chat_prompt_build(spark, sf):
    user = prompts.described_prompt(F.col("description"), F.col("package"))
    messages = prompts.conversation("Write code.", "Example request", "Example answer", user)
    return b.prompts(spark, sf).select("conv_id", F.posexplode(messages).alias("pos", "m")).select(
        "conv_id", "pos", "m.role", "m.content"
    )


@query
def package_prompt_build(spark, sf):
    """Prompts that name a package only."""
    messages = prompts.conversation(
        "Write code.", "Example request", "Example answer", prompts.package_prompt(F.col("package"))
    )
    return b.prompts(spark, sf).select("conv_id", F.posexplode(messages).alias("pos", "m")).select(
        "conv_id", "pos", "m.role", "m.content"
    )


@query
def char_token_ratio(spark, sf):
    """Characters per token id, with the first merges of the training so that SQL can count the ids."""
    tok, docs = first_merges(spark, sf), spread_corpus(spark, sf)
    return tok.encode(docs, "doc_id", "content").select(
        "doc_id", t.char_token_ratio(F.col("content"), F.col("ids")).alias("ratio")
    )


@query
def roundtrip_status(spark, sf):
    tok, docs = tokenizer(spark, sf), b.corpus(spark, sf)
    back = tok.encode(spread_corpus(spark, sf), "doc_id").select(
        "doc_id", tok.decode(F.col("ids")).alias("decoded")
    )
    return docs.join(back, "doc_id").groupBy("lang").agg(
        F.avg((F.col("decoded") == F.col("content")).cast("int")).alias("success_rate")
    )


@query
def tokens_of_type(spark, sf):
    found = t.tokens_of_type(lexer.lex(F.col("content")), "INT")
    return spread_corpus(spark, sf).select("doc_id", joined(found, "|").alias("literals"))


@query
def literal_inner(spark, sf):
    lit = F.col("literal")
    rows = lexer.token_table(b.corpus(spark, sf)).where(F.col("tok_id").isin(go.STRING, go.COMMENT))
    return rows.select(
        "doc_id",
        "pos",
        F.when(F.col("tok_id") == go.STRING, t.string_inner(lit)).otherwise(t.comment_inner(lit)).alias("inner"),
    )


# Lexing


@query
def go_lex(spark, sf):
    """Every token of every document, as one digest per document."""
    row = F.concat_ws(
        ":", F.col("pos").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"),
        F.col("tok_id").cast("string"), "tok_name", "literal",
    )
    return lexer.token_table(b.corpus(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("num_tokens"),
        F.md5(
            joined(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"]), "\n")
        ).alias("digest"),
    )


@query
def whitespace_fill(spark, sf):
    tokens = lexer.token_table(b.corpus(spark, sf))
    return tokens.groupBy("doc_id").agg(
        F.count_if(F.col("tok_id") == go.SPACE).alias("spaces"),
        F.count_if(F.col("tok_id") == go.NEWLINE).alias("newlines"),
        F.count_if(F.col("tok_id") == go.TAB).alias("tabs"),
    )


@query
def newline_normalise(spark, sf):
    """Line breaks outside literals are tokens, the others stay in their literal."""
    tokens = lexer.token_table(b.corpus(spark, sf))
    breaks = F.length("literal") - F.length(F.replace("literal", F.lit("\n"), F.lit("")))
    return tokens.groupBy("doc_id").agg(F.sum(breaks).alias("line_breaks"))


@query
def token_dim_lookup(spark, sf):
    ids = b.table(spark, sf, "events").select("event_id", (F.col("event_id") % 100).alias("tok_id"))
    return go.token_lookup(ids)


@query
def trainable_literals(spark, sf):
    found = lexer.trainable_literals(lexer.lex(F.col("content")))
    return spread_corpus(spark, sf).select("doc_id", F.md5(joined(found, "|")).alias("digest"))


@query
def typed_trainable_literals(spark, sf):
    found = lexer.typed_trainable_literals(lexer.lex(F.col("content")))
    return spread_corpus(spark, sf).select("doc_id", F.md5(joined(found, "|")).alias("digest"))


@query
def token_kind_histogram(spark, sf):
    return lexer.kind_histogram(spread_corpus(spark, sf), "lang")


# Tokenizers


@query
def pretok_metaspace(spark, sf):
    words = bpe.metaspace_words(F.col("content"))
    return spread_corpus(spark, sf).select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.md5(joined("w", "|")).alias("digest")
    )


@query
def pretok_bytelevel(spark, sf):
    words = F.transform(bpe.byte_level_words(F.col("content")), bpe.to_byte_symbols)
    return spread_corpus(spark, sf).select("doc_id", F.explode(words).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )


@query
def word_freq(spark, sf):
    return bpe.word_counts(codecs.MetaspaceTokenizer.training_words(spread_corpus(spark, sf)))


@query
def bpe_top_pairs(spark, sf):
    """The first training round: weighted neighbour counts of all distinct words."""
    counts = word_freq(spark, sf)
    # ASCII and the blank's sign as four-byte symbols, and back.
    letters = "".join(map(chr, range(128))) + bpe.META
    symbols = "".join(bpe.symbol(i) for i in range(len(letters)))
    words = counts.select(F.translate("word", letters, symbols).alias("symbols"), "n").where(
        F.length("symbols") > 1
    )
    return bpe.pair_counts(words).select(
        F.translate(F.col("pair").cast("string"), symbols, letters).alias("pair"), "n"
    )


@query
def bpe_train(spark, sf):
    return tokenizer(spark, sf).vocabulary.merge_table(spark)


@query
def bpe_train_lexed(spark, sf):
    return tokenizer(spark, sf, "go").vocabulary.merge_table(spark)


@query
def bpe_train_typed(spark, sf):
    return tokenizer(spark, sf, "typed").vocabulary.merge_table(spark)


@query
def vocab_build(spark, sf):
    """All entries of the trained vocabulary: special ones, the alphabet, and merges."""
    return tokenizer(spark, sf).vocabulary.vocab_table(spark)


@query
def vocab_build_first_merges(spark, sf):
    return first_merges(spark, sf).vocabulary.vocab_table(spark)


def first_merge_table(spark, sf, kind: str) -> DataFrame:
    return first_merges(spark, sf, kind).vocabulary.merge_table(spark)


@query
def bpe_train_first_merges(spark, sf):
    """The first merges of the whole training, few enough for SQL to repeat them one at a time."""
    return first_merge_table(spark, sf, "metaspace")


@query
def bpe_train_lexed_first_merges(spark, sf):
    return first_merge_table(spark, sf, "go")


@query
def bpe_train_typed_first_merges(spark, sf):
    return first_merge_table(spark, sf, "typed")


@query
def special_token_lookup(spark, sf):
    """Special tokens, the ids that each tokenizer has beside its trained vocabulary, and its size.

    Sizes are those after the first merges of the whole training, as SQL cannot repeat all of them.
    """
    toks = {k: tokenizer(spark, sf, k) for k in ("metaspace", "go", "typed")}
    vocab = toks["metaspace"].vocabulary.vocab_table(spark)
    extra = [F.lit(t.vocab_size() - len(t.vocabulary)).alias(f"{k}_extra") for k, t in toks.items()]
    sizes = [F.lit(t.first(FIRST_MERGES).vocab_size()).alias(f"{k}_size") for k, t in toks.items()]
    return vocab.where(F.col("kind") == "special").select("token", "id", *extra, *sizes)


@query
def bpe_encode_first_merges(spark, sf):
    ids = first_merges(spark, sf).encode(spread_corpus(spark, sf), "doc_id")
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def bpe_encode(spark, sf):
    return tokenizer(spark, sf).encode(spread_corpus(spark, sf), "doc_id")


@query
def bpe_decode(spark, sf):
    """What a document is after encoding and decoding."""
    tok = tokenizer(spark, sf)
    return bpe_encode(spark, sf).select("doc_id", tok.decode(F.col("ids")).alias("decoded"))


@query
def go_encode(spark, sf):
    return tokenizer(spark, sf, "go").encode(spread_corpus(spark, sf), "doc_id")


@query
def go_decode(spark, sf):
    tok = tokenizer(spark, sf, "go")
    return go_encode(spark, sf).select("doc_id", tok.decode(F.col("ids")).alias("decoded"))


@query
def id_to_token(spark, sf):
    tok = tokenizer(spark, sf, "go")
    used = go_encode(spark, sf).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return used.select("id", "n", tok.id_to_token(F.col("id")).alias("token"))


@query
def id_to_token_name(spark, sf):
    ids = b.table(spark, sf, "events").select("event_id", (F.col("event_id") % 100 + GO_SIZE).alias("id"))
    return ids.select(
        "event_id", codecs.go_token_name(F.col("id"), GO_SIZE, F.lit(None).cast("string")).alias("name")
    )


@query
def typed_go_encode(spark, sf):
    return tokenizer(spark, sf, "typed").encode(spread_corpus(spark, sf), "doc_id")


@query
def typed_go_decode(spark, sf):
    tok = tokenizer(spark, sf, "typed")
    return typed_go_encode(spark, sf).select("doc_id", tok.decode(F.col("ids")).alias("decoded"))


@query
def encode_batch_shards(spark, sf):
    return encoded_shards(spark, sf).groupBy("shard_id").agg(
        F.count("*").alias("documents"), F.sum(F.size("ids")).alias("num_tokens")
    )


@query
def train_first_shard(spark, sf):
    """The merges of a training on the first shard, from the stored word counts of that shard."""
    return tokenizer(spark, sf, train_shards=1).vocabulary.merge_table(spark)


@query
def train_two_shards_first_merges(spark, sf):
    return tokenizer(spark, sf, train_shards=2).first(FIRST_MERGES).vocabulary.merge_table(spark)


@query
def train_first_shard_first_merges(spark, sf):
    return tokenizer(spark, sf, train_shards=1).first(FIRST_MERGES).vocabulary.merge_table(spark)


@query
def shard_word_counts(spark, sf):
    """The stored word counts of all shards."""
    stored = spark.read.schema("word string, n bigint, shard_id int").parquet(shard_counts(spark, sf, "metaspace"))
    return stored.select("shard_id", "word", "n")


@query
def train_shard_chunks(spark, sf):
    """Chunks in which a shard's documents would be fed, and whether training on one shard uses them."""
    return b.places(spark, sf).groupBy(
        "shard_id", F.floor((F.col("rn") - 1) % b.ROWS_PER_SHARD / 16).alias("chunk")
    ).agg(F.count("*").alias("rows")).withColumn("used", F.col("shard_id") < 1)


# Dataset building


@query
def doc_token_counts(spark, sf):
    return dataset.token_counts(b.word_tokens(spark, sf))


@query
def flatten_tokens(spark, sf):
    """The token stream of each shard, one digest per document's stretch of it."""
    stream = dataset.flatten_tokens(b.word_tokens(spark, sf))
    pairs = F.array_sort(F.collect_list(F.struct("gpos", "token")))
    return stream.groupBy("shard_id", "doc_id").agg(
        F.min("gpos").alias("first_pos"),
        F.max("gpos").alias("last_pos"),
        F.md5(joined(F.transform(pairs, lambda p: p["token"]))).alias("digest"),
    )


def windows(spark, sf) -> DataFrame:
    return dataset.strict_windows(b.word_tokens(spark, sf), WIDTH, STRIDE)


@query
def window_strict(spark, sf):
    return windows(spark, sf).select("shard_id", "win", "start", joined("ids").alias("text"))


def padded(spark, sf) -> DataFrame:
    words = b.spread(
        b.corpus(spark, sf).select("doc_id", F.split("content", " ").alias("ids")), "doc_id"
    )
    return dataset.padded_windows(words, WIDTH, STRIDE, PAD)


@query
def window_padded(spark, sf):
    return padded(spark, sf).select("doc_id", "start", "n_real", joined("ids").alias("text"))


@query
def shuffle_global(spark, sf):
    return dataset.global_shuffle(b.corpus(spark, sf).select("doc_id"), SEED, "doc_id")


@query
def shuffle_buffered(spark, sf):
    found = materialise(windows(spark, sf).select("shard_id", "win"), "windows")
    return dataset.buffered_shuffle(found, SEED, WIDTH, buffer=500)


def batches(spark, sf, drop_last: bool) -> DataFrame:
    docs = b.corpus(spark, sf).select("doc_id")
    placed = shuffled_index(docs, SEED, "doc_id", total="total")
    return dataset.assign_batches(placed, 16, drop_last)


@query
def batch_assign(spark, sf):
    return batches(spark, sf, True).select("doc_id", "pos", "batch_id")


@query
def batch_assign_keep_last(spark, sf):
    return batches(spark, sf, False).select("doc_id", "pos", "batch_id")


@query
def accum_step_assign(spark, sf):
    full = F.floor(F.col("total") / 16)
    return dataset.assign_steps(batches(spark, sf, True), 4, full).select("doc_id", "batch_id", "step")


@query
def split_exact(spark, sf):
    return dataset.exact_split(b.corpus(spark, sf).select("doc_id"), SEED, "doc_id")


@query
def shift_targets(spark, sf):
    return dataset.shift_targets(windows(spark, sf)).select(
        "shard_id", "win", joined("inputs").alias("inputs"), joined("targets").alias("targets")
    )


@query
def pad_mask(spark, sf):
    masked = dataset.pad_masks(dataset.shift_targets(padded(spark, sf)), PAD)
    return masked.select(
        "doc_id",
        "start",
        joined(F.transform("attention_mask", lambda m: m.cast("string")), "").alias("attention_mask"),
        joined(F.transform("loss_mask", lambda m: m.cast("string")), "").alias("loss_mask"),
    )


@query
def left_truncate_context(spark, sf):
    ids = F.split(F.expr("substring(text, 1, cursor)"), " ")
    return b.requests(spark, sf).select("doc_id", ids.alias("ids")).select(
        "doc_id", joined(dataset.left_truncate(F.col("ids"), 64, 24)).alias("context")
    )


@query
def completion_budget(spark, sf):
    ids = F.split("description", " ")
    return b.prompts(spark, sf).select(
        "conv_id", dataset.completion_budget(ids, 512, 128).alias("budget")
    )


@query
def quarantine_failures(spark, sf):
    """Documents as JSON lines, those without labels cut short: accepted and rejected counts."""
    path = fresh_path(spark, "lines")
    docs = b.corpus(spark, sf).join(b.table(spark, sf, "labels"), "doc_id", "left")
    line = F.to_json(F.struct(F.col("content").alias("sample")))
    cut = F.when(F.col("quality").isNull(), F.substring(line, 1, 12)).otherwise(line)
    docs.select(cut.alias("value")).write.text(path)
    good, bad = src.split_rejected(src.read_samples(spark, path))
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(
        F.count("*").alias("n")
    )


@query
def sample_rows(spark, sf):
    return dataset.sample_rows(b.corpus(spark, sf), SEED, 50, "doc_id").select("doc_id", "content")


@query
def draw_with_replacement(spark, sf):
    draws = b.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("draw")
    )
    return dataset.draw_rows(b.corpus(spark, sf).select("doc_id"), draws, SEED, "doc_id")


@query
def review_filter(spark, sf):
    reviews = b.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "n").otherwise("y").alias("answer")
    )
    return dataset.review_filter(b.corpus(spark, sf), reviews, "doc_id").select("doc_id", "content")


@query
def resume_offset(spark, sf):
    done = b.table(spark, sf, "conversations").where(F.col("turn") == 5).select("conv_id")
    return dataset.resume_by_key(b.prompts(spark, sf), done, "conv_id")


def planned_prompts(spark, sf, described: bool) -> DataFrame:
    draws = b.prompts(spark, sf).select(F.col("conv_id").alias("draw"))
    names = b.table(spark, sf, "nation").select(F.lower("n_name").alias("name")).orderBy("name")
    plan = prompts.prompt_plan(draws, [r["name"] for r in names.collect()], SEED, prompts.temperature_range(described))
    return plan.withColumn("temperature", F.round("temperature", 9))


@query
def prompt_plan(spark, sf):
    return planned_prompts(spark, sf, described=False)


@query
def described_prompt_plan(spark, sf):
    return planned_prompts(spark, sf, described=True)


@query
def explode_choices(spark, sf):
    responses = b.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
        F.array(F.concat(F.lit("\n"), "text", F.lit("\n")), F.concat("role", F.lit("  "))).alias("choices"),
    )
    return prompts.explode_choices(responses)


@query
def validation_registry(spark, sf):
    named = b.corpus(spark, sf).select(F.col("source").alias("name"), "doc_id")
    return dataset.validation_sets(named, "src0", SEED, "doc_id")


@query
def shard_progress(spark, sf):
    return dataset.shard_progress(b.shards(spark, sf, "content").withColumn("rn", F.col("doc_id")))


# Evaluation


@query
def stop_token_flag(spark, sf):
    flag = evaluation.stop_flag(F.col("ids"), PAD, ["the", "de"])
    return padded(spark, sf).select("doc_id", "start", flag.alias("stop"))


@query
def strip_prompt_ids(spark, sf):
    ids = F.split("content", " ")
    cut = F.floor(F.size(ids) / 2).cast("int")
    return b.corpus(spark, sf).select("doc_id", joined(evaluation.strip_prompt(ids, cut)).alias("rest"))


@query
def candidate_count_check(spark, sf):
    """Users as tasks: most do not have exactly ten candidates, and those are reported."""
    users = b.table(spark, sf, "events").select(F.col("user_id").alias("task_id"))
    return evaluation.wrong_candidate_counts(users, 70)


@query
def candidate_outcome(spark, sf):
    return evaluation.outcomes(b.candidates(spark, sf))


def counts(spark, sf) -> DataFrame:
    return evaluation.task_counts(evaluation.outcomes(b.candidates(spark, sf)))


@query
def task_counts(spark, sf):
    return counts(spark, sf)


@query
def task_rates(spark, sf):
    return evaluation.task_rates(counts(spark, sf), 10)


@query
def pass_at_k(spark, sf):
    rates = evaluation.any_of_k(counts(spark, sf), 10)
    return rates.select("k", F.round("pass_at_k", 9).alias("pass_at_k"), F.round("compile_at_k", 9).alias("compile_at_k"))


@query
def eval_summary_nested(spark, sf):
    summary = evaluation.nested_summary(evaluation.outcomes(b.candidates(spark, sf)))
    flags = F.transform("candidate_sequences", lambda c: F.concat_ws(
        "/", c["candidate_id"].cast("string"), c["compiled"].cast("string"), c["passed"].cast("string"),
        F.coalesce(c["error_log"], F.lit("-")), c["code"],
    ))
    return summary.select("task_id", joined(flags, ";").alias("candidates"), "num_compiled", "num_passed")


@query
def masked_loss(spark, sf):
    found = evaluation.masked_loss(b.token_loss(spark, sf), 1, "dataset", "batch")
    return found.withColumn("loss", F.round("loss", 10))


@query
def dataset_val_loss(spark, sf):
    found = evaluation.dataset_loss(b.token_loss(spark, sf), 1)
    return found.withColumn("loss", F.round("loss", 10))


# Metrics


@query
def weighted_mean(spark, sf):
    return metrics.weighted_mean(b.metrics(spark, sf)).withColumn("mean", F.round("mean", 6))


@query
def step_loss_mean(spark, sf):
    per_batch = evaluation.masked_loss(b.token_loss(spark, sf), 1, "batch").withColumnRenamed("batch", "batch_id")
    stepped = dataset.assign_steps(per_batch, 8, F.lit(200))
    return metrics.step_means(stepped).withColumn("loss", F.round("loss", 10))


@query
def tokens_ingested(spark, sf):
    return metrics.tokens_ingested(b.metrics(spark, sf)).select("run_id", "seq", "total_tokens_ingested")


def smoothed(spark, sf, kind: str) -> DataFrame:
    return metrics.rolling_mean(row_index(b.curve(spark, sf, kind), "step"), "loss", 512, "smoothed_loss")


@query
def rolling_mean(spark, sf):
    # The mean of 512 two-digit values can end in a five at any digit one would round to; times
    # 512 it has two digits again.
    return smoothed(spark, sf, "click").select(
        "step", F.round(F.col("smoothed_loss") * 512, 2).alias("smoothed_loss_x512")
    )


def curve_parts(spark, sf) -> DataFrame:
    first = b.curve(spark, sf, "click").select(F.lit(0).alias("file_ordinal"), "step", "loss")
    return first.unionByName(b.curve(spark, sf, "view").select(F.lit(1).alias("file_ordinal"), "step", "loss"))


@query
def curve_concat(spark, sf):
    return metrics.concat_curves(curve_parts(spark, sf), "step")


@query
def common_range(spark, sf):
    a = metrics.concat_curves(curve_parts(spark, sf), "step").select(F.lit("a").alias("curve"), "index", "loss")
    other = b.curve(spark, sf, "error").select(F.lit(0).alias("file_ordinal"), "step", "loss")
    c = metrics.concat_curves(other, "step").select(F.lit("b").alias("curve"), "index", "loss")
    return metrics.common_range(a.unionByName(c))


def reporting_phase() -> Column:
    return F.element_at(F.lit(PHASES), (F.col("seq") % len(PHASES) + 1).cast("int"))


@query
def metric_series(spark, sf):
    return metrics.metric_series(b.metric_steps(spark, sf), reporting_phase())


@query
def metric_latest(spark, sf):
    """Four batches to a step, four hundred steps to an epoch."""
    counted = b.metric_steps(spark, sf).withColumns({
        "step_idx": F.col("step"),
        "batch_idx": F.col("step") * 4,
        "epoch_idx": F.floor(F.col("step") / 400),
    })
    return metrics.latest_values(counted, reporting_phase())


@query
def hyperparams_stringify(spark, sf):
    calls = b.metrics(spark, sf)
    return metrics.hyperparameters(calls, ["name", "value", "weight"])


@query
def step_elapsed_ms(spark, sf):
    stepped = b.metric_steps(spark, sf).withColumn("epoch", F.floor(F.col("step") / 400))
    return metrics.elapsed_ms(stepped).select(
        "run_id", "step", F.round("step_ms", 3).alias("step_ms"), F.round("since_epoch_ms", 3).alias("since_epoch_ms")
    )


STEP_COLUMNS = "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double"


def run_steps(spark, sf) -> DataFrame:
    return b.metric_steps(spark, sf).select(
        "run_id", "seq", F.floor(F.col("step") / 400).alias("epoch"), "step",
        F.floor(metrics.micros("ts") / 1000000).cast("double").alias("seconds"),
    )


LIMITS = (1, 60, 36000.0)


@query
def checkpoint_policy(spark, sf):
    return checkpoints.checkpoint_policy(materialise(run_steps(spark, sf), "run-steps"), *LIMITS)


@query
def retention_keep_n(spark, sf):
    fired = b.metrics(spark, sf).select("run_id", "seq")
    return metrics.keep_newest(fired, 3)


def per_source(spark, sf) -> DataFrame:
    return b.corpus(spark, sf).groupBy("source").agg(
        F.sum(F.size(F.split("content", " "))).alias("tokens"),
        F.count("*").alias("docs"),
        F.sum(F.length("content")).alias("chars"),
    )


@query
def compute_budget(spark, sf):
    parts = metrics.compute_budget(F.col("tokens") * 1000, F.col("docs"), F.lit(8), F.lit(64))
    return per_source(spark, sf).select("source", *parts)


@query
def expected_loss(spark, sf):
    law = metrics.expected_loss(F.col("chars") * 100, F.col("tokens") * 1000)
    return per_source(spark, sf).select("source", F.round(law, 6).alias("expected_loss"))


@query
def lr_time_budget(spark, sf):
    found = metrics.time_budget_factor(b.metric_steps(spark, sf), 100, 1_000_000.0, 0.1)
    return found.withColumn("lr_factor", F.round("lr_factor", 12))


@query
def lr_onecycle(spark, sf):
    steps = row_index(b.metrics(spark, sf).select("run_id", "seq"), "seq", "step", within=("run_id",), total="total")
    rate = metrics.onecycle_rate(F.col("step") - 1, F.col("total"), 50, 0.01)
    return steps.select("run_id", "step", F.round(rate, 9).alias("lr"))


@query
def top_ops(spark, sf):
    calls = b.table(spark, sf, "lineitem").select("l_suppkey", F.round(F.col("l_quantity")).cast("bigint").alias("q"))
    return metrics.top_operations(calls, "l_suppkey", "q")


@query
def param_summary(spark, sf):
    p = b.table(spark, sf, "part").select(
        F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 64 + 1).alias("shape"),
        (F.col("p_size") > 10).alias("trainable"),
    )
    found = metrics.parameter_summary(p)
    return found.select(*found.columns, t.human_count(F.col("total")).alias("total_text"))


# Streaming


SHARDS_PER_TRIGGER = 16
# Micro-batches that a whole corpus comes in, at most; what each of them costs does not follow its size.
MICRO_BATCHES = 64


def shards_per_trigger(documents: int) -> int:
    """Shard files to a micro-batch: more of them where there would be too many micro-batches."""
    return max(SHARDS_PER_TRIGGER, -(-documents // (b.ROWS_PER_SHARD * MICRO_BATCHES)))


def streamed_tokens(spark, sf, tok) -> DataFrame:
    """The ledger of a stream over shard files: one entry per shard, and the total of all of them."""
    path = fresh_path(spark, "shards")
    rows = b.shards(spark, sf, "content").withColumn("shard", F.col("shard_id"))
    src.write_shards(rows, path, "doc_id")
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("doc_id", T.LongType()),
        T.StructField("content", T.StringType()),
    ])
    per_trigger = shards_per_trigger(b.corpus(spark, sf).count())
    files = jobs.file_stream(spark, path, schema, per_trigger=per_trigger).withColumnRenamed("shard", "shard_id")
    ledger, _ = jobs.tokenize_files(files, lambda batch: tok.encode(batch, "shard_id", "doc_id"))
    total = ledger.agg(F.max("running_tokens")).first()[0] or 0
    return ledger.groupBy("shard_id").agg(
        F.sum("documents").alias("documents"), F.sum("num_tokens").alias("num_tokens")
    ).withColumn("total_tokens", F.lit(total).cast("bigint"))


@query
def stream_tokenize_files(spark, sf):
    return streamed_tokens(spark, sf, tokenizer(spark, sf))


@query
def stream_tokenize_first_merges(spark, sf):
    return streamed_tokens(spark, sf, first_merges(spark, sf))


STREAM_FILES = 4


def event_stream(spark, sf) -> DataFrame:
    """The events in files that follow each other, one file to a micro-batch."""
    path, events = fresh_path(spark, "events"), b.table(spark, sf, "events")
    events.repartitionByRange(STREAM_FILES, "event_id").write.parquet(path)
    return jobs.file_stream(spark, path, events.schema, per_trigger=1)


@query
def stream_weighted_mean(spark, sf):
    """Sums of four micro-batches and more in the state store."""
    e = event_stream(spark, sf).select(
        F.col("event_type").alias("name"), "value", (1 + F.col("event_id") % 7).alias("weight")
    )
    return jobs.weighted_means(e).withColumn("mean", F.round("mean", 6))


@query
def stream_checkpoint_policy(spark, sf):
    """Steps arrive in STREAM_FILES parts that follow each other; the stream is started again for each."""
    path, progress = fresh_path(spark, "steps"), fresh_path(spark, "stream-checkpoints")
    steps = materialise(run_steps(spark, sf), "run-steps")
    shares = [i / STREAM_FILES for i in range(1, STREAM_FILES)]
    bounds = steps.agg(F.percentile_approx("seq", shares).alias("q")).first()["q"] or []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda q: q < F.col("seq"))) if bounds else F.lit(0)
    for number in range(STREAM_FILES):
        steps.where(place == number).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, steps.schema, per_trigger=None)
        fires, late = jobs.checkpoint_policy(stream, *LIMITS, path=progress)
    if not late.isEmpty():
        raise ValueError("steps came out of order")
    return fires


CONTEXT = 64


def streamed_contexts(spark, sf, encode) -> DataFrame:
    path = fresh_path(spark, "requests")
    b.requests(spark, sf).select(
        F.col("text").alias("fileContents"), F.col("cursor").alias("cursorOffset")
    ).write.json(path)
    stream = spark.readStream.schema(src.REQUEST).json(path)
    found = jobs.context_requests(stream, encode, CONTEXT)
    return found.select("request_id", joined(F.col("context_ids").cast("array<string>")).alias("context"))


@query
def stream_context_requests(spark, sf):
    return streamed_contexts(spark, sf, lambda r: r.select("request_id", F.split("content", " ").alias("ids")))


@query
def stream_context_ids(spark, sf):
    """Contexts cut in ids of the trained tokenizer."""
    return streamed_contexts(spark, sf, lambda r: tokenizer(spark, sf).encode(r, "request_id"))


@query
def stream_context_ids_first_merges(spark, sf):
    return streamed_contexts(spark, sf, lambda r: first_merges(spark, sf).encode(r, "request_id"))


# The whole way


@query
def training_windows(spark, sf):
    """Documents, tokens and training windows of each shard after Go-aware encoding."""
    # Windows read the ids twice, once for their number, so they are stored first.
    encoded = materialise(encoded_shards(spark, sf, "go"), "encoded")
    found = dataset.strict_windows(encoded, WIDTH, STRIDE)
    return found.groupBy("shard_id").agg(
        F.count("*").alias("num_windows"),
        F.max("start").alias("last_start"),
        F.sum(F.size("ids")).alias("num_ids"),
    )
