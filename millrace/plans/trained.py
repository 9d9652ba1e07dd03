"""Vocabularies that the registered queries share, trained once per session and table folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.operators import bpe, codecs
from millrace.plans import bindings as b
from millrace.session import fresh_path

# All ids of a trained tokenizer; fewer where the corpus has no more pairs.
VOCABULARY = 2**15
KINDS = {
    "metaspace": codecs.MetaspaceTokenizer,
    "go": codecs.GoTokenizer,
    "typed": codecs.TypedGoTokenizer,
}
# Merges that the check queries take from the beginning of a whole training, as SQL repeats them one by one.
FIRST_MERGES = 24
_trained: dict[tuple, codecs.MetaspaceTokenizer] = {}
_counted: dict[tuple, str] = {}


def tokenizer(spark: SparkSession, sf_dir: str, kind: str = "metaspace", train_shards: int | None = None):
    """The tokenizer trained on the whole corpus, or on its first ``train_shards`` shards."""
    session = spark.sparkContext.applicationId
    key = (session, sf_dir, kind, train_shards)
    if key not in _trained:
        cls = KINDS[kind]
        if train_shards is None:
            _trained[key] = cls.train(b.spread(b.corpus(spark, sf_dir), "doc_id"), VOCABULARY)
        else:
            counts = bpe.merged_counts(spark, shard_counts(spark, sf_dir, kind), train_shards)
            _trained[key] = cls.train_counts(counts, VOCABULARY)
    return _trained[key]


def shard_counts(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Folder of the word counts of all shards, filled once per session and kind."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _counted:
        path = fresh_path(spark, "shard-counts")
        KINDS[kind].count_shards(b.shards(spark, sf_dir, "content"), path)
        _counted[key] = path
    return _counted[key]


def first_merges(spark: SparkSession, sf_dir: str, kind: str = "metaspace"):
    return tokenizer(spark, sf_dir, kind).first(FIRST_MERGES)
