"""Views that bind the operators' input shapes to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.indexing import bucket_of, cut_points, row_index, running_total

ROWS_PER_SHARD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), "lang", "source"
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when a small file arrives as fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shards(spark, sf_dir, *columns: str) -> DataFrame:
    """Documents in key order, cut into consecutive groups of ROWS_PER_SHARD.

    A document's shard follows from its key and the shards' first keys, so the rows stay where they
    are and no text is shuffled.
    """
    wanted = columns or ("content", "lang", "source")
    docs = corpus(spark, sf_dir).select("doc_id", *wanted)
    return docs.withColumn("shard_id", bucket_of(F.col("doc_id"), cut_points(docs, "doc_id", ROWS_PER_SHARD)))


def places(spark, sf_dir) -> DataFrame:
    """Row number and shard of each document, keys only."""
    indexed = row_index(corpus(spark, sf_dir).select("doc_id"), "doc_id")
    return indexed.withColumn("shard_id", F.floor((F.col("rn") - 1) / ROWS_PER_SHARD).cast("int"))


def word_tokens(spark, sf_dir) -> DataFrame:
    """Blank-separated words as a stand-in for token ids; the key gives the order in a shard."""
    return shards(spark, sf_dir, "content").select(
        "shard_id", F.col("doc_id").alias("rn"), "doc_id", F.split("content", " ").alias("ids")
    )


def curve(spark, sf_dir, event_type: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == event_type)
        .select(F.col("event_id").alias("step"), "ts", F.col("value").alias("loss"))
    )


def metrics(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("run_id"),
        F.col("event_type").alias("name"),
        F.col("event_id").alias("seq"),
        "value",
        (1 + F.col("event_id") % 7).alias("weight"),
        "ts",
    )
    return rows


def metric_steps(spark, sf_dir) -> DataFrame:
    """Metrics with the 1-based step of each row inside its run."""
    return running_total(metrics(spark, sf_dir), "seq", F.lit(1), "step", within=("run_id",))


def candidates(spark, sf_dir) -> DataFrame:
    """Ten recorded candidates per task: consecutive events are the candidates of one task."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.floor(F.col("event_id") / 10).alias("task_id"),
        (F.col("event_id") % 10).cast("int").alias("candidate_id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("build_rc"),
        F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("test_rc"),
        (F.col("event_type") == "signup").alias("timed_out"),
        F.col("props").alias("stderr"),
        F.concat(F.lit("v := "), F.col("value").cast("string")).alias("code"),
    )


def token_loss(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        (F.col("l_orderkey") % 200).alias("batch"),
        F.col("l_linenumber").alias("target"),
        F.col("l_discount").alias("loss"),
    )


def prompts(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("turn") == 0)
        .select(
            "conv_id",
            F.col("text").alias("description"),
            F.concat(F.lit("pkg"), F.col("conv_id").cast("string")).alias("package"),
        )
    )


def requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.floor(F.col("n_chars") / 2).cast("int").alias("cursor")
    )
