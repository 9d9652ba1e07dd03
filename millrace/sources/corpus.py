"""Readers and writers of corpus, token, sample, task, curve and vocabulary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import seeded_md5
from millrace.functions.text import strip_ws
from millrace.operators.indexing import by_key

SAMPLE = T.StructType(
    [T.StructField("sample", T.StringType()), T.StructField("_corrupt_record", T.StringType())]
)
PROMPT = T.StructType(
    [T.StructField("description", T.StringType()), T.StructField("package", T.StringType())]
)
# The fields of an evaluation task.
TASK = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "task_id",
            "prompt",
            "import",
            "docstring",
            "declaration",
            "canonical_solution",
            "test",
            "test_setup",
            "example_test",
        )
    ]
)
CURVE = T.StructType(
    [
        T.StructField("step", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("loss", T.DoubleType()),
    ]
)
REQUEST = T.StructType(
    [
        T.StructField("fileContents", T.StringType()),
        T.StructField("cursorOffset", T.IntegerType()),
    ]
)
ROWS_PER_SHARD = 64_000
# Fixed value: the largest id that a token of a shard may have.
MAX_TOKEN_ID = 65_535


def read_corpus(spark: SparkSession, path: str, text_column: str = "content") -> DataFrame:
    return spark.read.parquet(path).select(F.col(text_column).alias("content"))


def select_slice(corpus: DataFrame, **equal) -> DataFrame:
    """One slice of a larger corpus; partition columns prune folders, others row groups."""
    for column, value in equal.items():
        corpus = corpus.where(F.col(column) == value)
    return corpus


def list_files(spark: SparkSession, folder: str, suffix: str, seed=0) -> DataFrame:
    """Files below a folder in seeded random order. File bodies are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    )
    return found.orderBy(seeded_md5(seed, F.col("name")), "path")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(SAMPLE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROMPT).json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK).json(path).select("task_id", "prompt", "test_setup", "test")


def read_curve(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Headerless CSV files or folders of them as one curve, in argument order.

    ``offset`` is the line's 0-based number in its argument: files of a folder by name, the splits of a
    file by where they start, the lines of a split as they are read. Only one row per split takes part
    in the sums.
    """
    parts = [
        spark.read.schema(CURVE)
        .csv(p)
        .select(
            "*",
            F.lit(i).alias("file_ordinal"),
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )
        for i, p in enumerate(paths)
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    split = ["file_ordinal", "_file", "_start"]
    sizes = lines.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    before = W.partitionBy("file_ordinal").orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        lines.join(starts, split)
        .withColumn("offset", F.col("_before") + F.col("_line") - F.col("_first"))
        .drop("_file", "_start", "_line", "_first", "_before")
    )


def write_shards(sharded: DataFrame, path: str, order: str = "rn", watch: Observation | None = None, *sums) -> None:
    """One folder per shard, rows in corpus order; the rows are shuffled once, by shard.

    What is observed is counted behind that shuffle, in the tasks that write, so a repeated task does
    not count twice.
    """
    placed = by_key(sharded, "shard_id").sortWithinPartitions("shard_id", order)
    if watch is not None:
        placed = placed.observe(watch, *sums)
    placed.write.partitionBy("shard_id").parquet(path)


def shard_manifest(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("shard_id").agg(
        F.format_string("shard-%03d.parquet", F.first("shard_id")).alias("file"),
        F.count("*").alias("rows"),
        F.sum(F.length("content")).alias("chars"),
    )


def write_token_shards(documents: DataFrame, path: str, order: str = "rn", max_id: int = MAX_TOKEN_ID) -> dict:
    """Encoded documents (shard_id, doc_id, ids, ``order``) by shard, in order, and their summary.

    The shards lie in ``path/shards``, ``path/summary.json`` holds the number of tokens. Documents,
    tokens and the largest id are counted by the writing tasks themselves and returned. An id outside
    [0, ``max_id``] stops the write, as a 16-bit array could not hold it, and no summary appears.
    """
    fits = F.forall("ids", lambda i: i.between(0, max_id))
    fault = F.raise_error(F.concat(F.lit("token id out of range in document "), F.col("doc_id").cast("string")))
    columns = dict.fromkeys(["shard_id", order, "doc_id"])
    checked = documents.select(*columns, F.when(F.coalesce(fits, F.lit(True)), F.col("ids")).otherwise(fault).alias("ids"))
    watch = Observation()
    write_shards(
        checked,
        f"{path}/shards",
        order,
        watch,
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.greatest(F.size("ids"), F.lit(0)).cast("bigint")).alias("num_tokens"),
        F.max(F.array_max("ids")).alias("largest_id"),
    )
    counted = dict(watch.get)
    counted["num_tokens"] = counted["num_tokens"] or 0
    write_summary(documents.sparkSession.createDataFrame([(counted["num_tokens"],)], "num_tokens bigint"), f"{path}/summary.json")
    return counted


def read_token_shards(spark: SparkSession, path: str, shard_ids: list[int] | None = None) -> DataFrame:
    stored = spark.read.parquet(f"{path}/shards")
    return stored if shard_ids is None else stored.where(F.col("shard_id").isin(shard_ids))


def token_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(F.sum(F.size("ids")).cast("bigint").alias("num_tokens"))


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    summary.coalesce(1).write.json(path)


def append_samples(samples: DataFrame, path: str) -> None:
    samples.select("sample").write.mode("append").json(path)


def split_rejected(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable samples, and the others with the reason why they are not."""
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed")
        .when(F.col("sample").isNull(), "missing")
        .when(strip_ws(F.col("sample")) == "", "empty")
    )
    judged = samples.withColumn("reason", reason)
    return (
        judged.where(F.col("reason").isNull()).select("sample"),
        judged.where(F.col("reason").isNotNull()),
    )
