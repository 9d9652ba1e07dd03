"""Incremental forms of the batch jobs. Each runs until its input is used up, then returns.

Progress and state live in the shared folder, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.checkpoints import FIRED
from millrace.operators.checkpoints import checkpoint_policy as policy
from millrace.operators.dataset import left_truncate
from millrace.operators.metrics import weighted_mean
from millrace.session import discard, exists, fresh_path, materialise

# Fixed value: tokens generated per completion request.
MAX_NEW_TOKENS = 24


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet", per_trigger: int | None = 64
) -> DataFrame:
    """New files of a folder, ``per_trigger`` to a micro-batch; None takes all that have arrived."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true")
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_to_end(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Drain an append-mode stream into a table of the shared folder and read it back."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, label)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    run_to_end(writer, f"{path}/progress")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def latest_result(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Drain a complete-mode aggregate; every batch replaces the result table.

    With the ``path`` of an earlier run the state goes on from where it stopped.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, label)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    run_to_end(stream.writeStream.outputMode("complete").foreachBatch(replace), f"{path}/progress")
    return spark.read.schema(stream.schema).parquet(f"{path}/state")


LEDGER = "shard_id int, documents bigint, num_tokens bigint, running_tokens bigint"


def tokenize_files(
    shards: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Encode each new shard file once: (ledger, encoded documents).

    ``encode`` takes a micro-batch (shard_id, doc_id, content) and returns (shard_id, doc_id, ids). Its
    rows and its entries in the ledger lie under the number of the micro-batch, which a restarted stream
    repeats, so a micro-batch that is run again replaces what it has written and every shard counts
    exactly once. An entry holds a shard's documents and tokens and the running total over all
    micro-batches before it and the batch's shards up to it; ``path`` names the place of an earlier run
    that is to go on.
    """
    spark = shards.sparkSession
    path = path or fresh_path(spark, "stream-tokens")
    ledger, tokens = f"{path}/ledger", f"{path}/tokens"

    def take(batch: DataFrame, batch_id: int) -> None:
        encode(batch).select("shard_id", "doc_id", "ids").write.mode("overwrite").parquet(f"{tokens}/batch_id={batch_id}")
        stored = spark.read.schema("shard_id int, ids array<int>").parquet(f"{tokens}/batch_id={batch_id}")
        counted = stored.groupBy("shard_id").agg(
            F.count("*").alias("documents"), F.sum(F.size("ids")).cast("bigint").alias("num_tokens")
        )
        before = 0
        if exists(spark, ledger):
            # The micro-batch before holds the total, unless it had no rows; then all entries are summed.
            last = f"{ledger}/batch_id={batch_id - 1}"
            if exists(spark, last):
                before = spark.read.schema(LEDGER).parquet(last).agg(F.max("running_tokens")).first()[0]
            if not before:
                earlier = spark.read.schema(f"{LEDGER}, batch_id bigint").parquet(ledger).where(F.col("batch_id") < batch_id)
                before = earlier.agg(F.sum("num_tokens")).first()[0] or 0
        # One row per shard of this micro-batch, whose number of files is bounded.
        up_to = W.partitionBy(F.lit(0)).orderBy("shard_id").rowsBetween(W.unboundedPreceding, 0)
        entries = counted.withColumn("running_tokens", F.lit(before) + F.sum("num_tokens").over(up_to))
        entries.write.mode("overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    run_to_end(shards.writeStream.foreachBatch(take), f"{path}/progress")
    return (
        spark.read.schema(f"{LEDGER}, batch_id bigint").parquet(ledger),
        spark.read.schema("shard_id int, doc_id bigint, ids array<int>, batch_id bigint").parquet(tokens),
    )


def weighted_means(metrics: DataFrame, path: str | None = None) -> DataFrame:
    return latest_result(weighted_mean(metrics), "stream-means", path)


STATE = "run_id bigint, epoch bigint, step bigint, seconds double, seq bigint"


def checkpoint_policy(
    steps: DataFrame, max_epochs: int, max_steps: int, max_seconds: float, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The checkpoint chain over micro-batches: (fires, late rows).

    Contract: files come in the order of ``seq`` within a run; inside a micro-batch rows may stand
    in any order. A row at or below a ``seq`` that an earlier micro-batch has passed can no longer
    take its place in the chain. It is not folded in but returned among the late rows.

    A micro-batch is decided by the batch operator, whose tasks are chunks and not runs, from the states
    (last fire and last row of each run) that the one before has written. Fires and states lie under the
    number of the micro-batch, which a restarted stream repeats, so each is decided once; ``path`` names
    the place of an earlier run that is to go on.
    """
    spark = steps.sparkSession
    path = path or fresh_path(spark, "stream-checkpoints")
    rows, states = f"{path}/rows", f"{path}/states"

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = f"{states}/batch_id={batch_id - 1}"
        before = session.read.schema(STATE).parquet(earlier) if exists(session, earlier) else session.createDataFrame([], STATE)
        passed = before.select(F.col("run_id").alias("_run"), F.col("seq").alias("_passed"))
        late = F.coalesce(F.col("seq") <= F.col("_passed"), F.lit(False)).alias("late")
        kept = [c for c in ("run_id", "seq", "epoch", "step", "seconds", "named") if c in batch.columns]
        tagged = batch.join(passed, F.col("run_id").eqNullSafe(F.col("_run")), "left").select(*kept, late)
        tagged = materialise(tagged, "micro-batch")
        timely = tagged.where("not late")
        fired = policy(timely, max_epochs, max_steps, max_seconds, states=before).withColumn("late", F.lit(False))
        out = fired.unionByName(tagged.where("late").select(*fired.columns))
        out.write.mode("overwrite").parquet(f"{rows}/batch_id={batch_id}")
        # The latest of: the run's first row, the state before, a fire of this micro-batch.
        fires = session.read.schema(f"{FIRED}, late boolean").parquet(f"{rows}/batch_id={batch_id}").where("not late")
        first = timely.groupBy("run_id").agg(F.min_by("seconds", "seq").alias("seconds"), F.max("seq").alias("seq"))
        first = first.select("run_id", F.lit(0).alias("epoch"), F.lit(0).alias("step"), "seconds", "seq")
        found = first.withColumn("_age", F.lit(0))
        found = found.unionByName(before.withColumn("_age", F.lit(1))).unionByName(fires.drop("late").withColumn("_age", F.lit(2)))
        last = F.max_by(F.struct("epoch", "step", "seconds"), F.struct("_age", "seq")).alias("_last")
        after = found.groupBy("run_id").agg(last, F.max("seq").alias("seq")).select("run_id", "_last.*", "seq")
        after.write.mode("overwrite").parquet(f"{states}/batch_id={batch_id}")
        discard(fired)
        discard(tagged)

    run_to_end(steps.writeStream.foreachBatch(take), f"{path}/progress")
    decided = spark.read.schema(f"{FIRED}, late boolean").parquet(rows).drop("batch_id")
    return decided.where("not late").drop("late"), decided.where("late").drop("late")


def context_requests(
    requests: DataFrame, encode: Callable[[DataFrame], DataFrame], context: int, max_new: int = MAX_NEW_TOKENS
) -> DataFrame:
    """Truncated context of each completion request; the id is a digest of the request.

    ``encode`` takes (request_id, content), the text before the cursor, and returns (request_id, ids): a
    tokenizer's encoding runs inside the stream.
    """
    before = requests.select(
        F.md5(F.concat_ws(":", F.col("cursorOffset").cast("string"), "fileContents")).alias("request_id"),
        F.expr("substring(fileContents, 1, cursorOffset)").alias("content"),
    )
    prepared = encode(before).select("request_id", left_truncate(F.col("ids"), context, max_new).alias("context_ids"))
    return append_to_parquet(prepared, "stream-requests")
