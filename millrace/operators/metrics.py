"""Metric tables: means, running sums, curves, schedules and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import metric_path
from millrace.operators.indexing import overlapping_chunks, row_index, running_total

CHUNK_ROWS = 65_536

# Fitted constants of the loss law in parameters n and tokens d.
LOSS_FLOOR, LOSS_N, LOSS_N_POWER, LOSS_D, LOSS_D_POWER = 1.69, 406, 0.34, 410.7, 0.27
# One-cycle schedule, start and end divisors of the peak rate.
ONECYCLE_DIV, ONECYCLE_FINAL_DIV = 25.0, 25.0


def weighted_mean(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"),
        F.sum("weight").alias("weight"),
    )


def step_means(stepped: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean of the losses of each step's batches."""
    return stepped.groupBy(*by, "step").agg(F.avg("loss").alias("loss"))


def tokens_ingested(metrics: DataFrame) -> DataFrame:
    """Tokens a run has seen up to each of its rows; ``weight`` is the row's token count."""
    return running_total(
        metrics, "seq", F.col("weight"), "total_tokens_ingested", within=("run_id",)
    )


def rolling_mean(indexed: DataFrame, value: str, window: int, name: str, index: str = "rn") -> DataFrame:
    """Mean of the trailing ``window`` values, null until there are that many."""
    chunk_rows = max(CHUNK_ROWS, window)
    chunks = overlapping_chunks(indexed, index, chunk_rows, window - 1)
    frame = W.partitionBy("_chunk").orderBy(index).rowsBetween(1 - window, 0)
    mean = F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))
    return chunks.withColumn(name, mean).where("_own").drop("_chunk", "_own")


def concat_curves(parts: DataFrame, order: str) -> DataFrame:
    """Curve files appended in argument order (``file_ordinal``), with a new 0-based index."""
    placed = row_index(parts, order, "_rn", within=("file_ordinal",))
    # One row per file named in the arguments.
    lengths = parts.groupBy("file_ordinal").agg(F.count("*").alias("_n"))
    before = (
        W.partitionBy(F.lit(0)).orderBy("file_ordinal").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = lengths.select(
        "file_ordinal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        placed.join(F.broadcast(starts), "file_ordinal")
        .withColumn("index", F.col("_start") + F.col("_rn") - 1)
        .drop("_rn", "_start")
    )


def common_range(curves: DataFrame, index: str = "index") -> DataFrame:
    """Rows of each tagged curve up to the shortest curve's last index."""
    # One row per compared curve.
    ends = curves.groupBy("curve").agg(F.max(index).alias("_end"))
    shortest = ends.select("curve", F.min("_end").over(W.partitionBy(F.lit(0))).alias("_end"))
    return curves.join(F.broadcast(shortest), "curve").where(F.col(index) <= F.col("_end")).drop("_end")


# Phases whose metrics are kept step by step, and those that overwrite.
APPENDED = ("step", "train_batch", "validation_batch", "test_batch")
OVERWRITTEN = ("validation", "test")


def metric_series(metrics: DataFrame, phase: Column) -> DataFrame:
    """Values of the phases that are appended."""
    return metrics.where(phase.isin(*APPENDED)).select(
        "run_id", metric_path(phase, F.col("name")).alias("path"), "step", "value", "seq"
    )


def latest_values(metrics: DataFrame, phase: Column) -> DataFrame:
    """The latest value of each metric whose phase overwrites, and of the three counters.

    ``metrics`` has step_idx, batch_idx and epoch_idx beside name, value and seq: every training
    step moves train/steps, every training batch train/batches, and train/epochs is the last
    epoch that a later one has followed or that ended the run's rows.
    """
    shown = metrics.where(phase.isin(*OVERWRITTEN)).select(
        "run_id", metric_path(phase, F.col("name")).alias("path"), "value", "seq"
    )
    counters = [("step", "train/steps", "step_idx"), ("train_batch", "train/batches", "batch_idx")]
    for moved, path, column in counters:
        shown = shown.unionByName(
            metrics.where(phase == moved).select(
                "run_id", F.lit(path).alias("path"), F.col(column).cast("double").alias("value"), "seq"
            )
        )
    epochs = metrics.select(
        "run_id", F.lit("train/epochs").alias("path"), F.col("epoch_idx").cast("double").alias("value"), "seq"
    )
    return shown.unionByName(epochs).groupBy("run_id", "path").agg(F.max_by("value", "seq").alias("value"))


def hyperparameters(calls: DataFrame, columns: list[str]) -> DataFrame:
    """Key and value strings per run; a later call (``seq``) replaces a key."""
    pairs = calls.select(
        "run_id", "seq", *[F.col(c).cast("string").alias(c) for c in columns]
    ).unpivot(["run_id", "seq"], columns, "key", "value")
    return pairs.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def elapsed_ms(stepped: DataFrame) -> DataFrame:
    """Milliseconds since the previous step of the run and since the first of the epoch.

    ``stepped`` has run_id, epoch, step and ts. The starts have a row per run and epoch.
    """
    chunks = overlapping_chunks(stepped.withColumn("_us", micros("ts")), "step", CHUNK_ROWS, 1)
    previous = F.lag("_us").over(W.partitionBy("run_id", "_chunk").orderBy("step"))
    own = chunks.withColumn("_before", previous).where("_own")
    starts = stepped.groupBy(F.col("run_id").alias("_run"), F.col("epoch").alias("_epoch")).agg(
        F.min_by(micros("ts"), "step").alias("_start")
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & F.col("epoch").eqNullSafe(F.col("_epoch"))
    return own.join(starts, same).select(
        "run_id",
        "step",
        ((F.col("_us") - F.col("_before")) / 1000.0).alias("step_ms"),
        ((F.col("_us") - F.col("_start")) / 1000.0).alias("since_epoch_ms"),
    )


def keep_newest(checkpoints: DataFrame, max_files: int, order: str = "seq") -> DataFrame:
    """Which checkpoints stay and which go when only the newest ``max_files`` are kept per run."""
    placed = row_index(checkpoints, order, "_rn", within=("run_id",), total="_n")
    return placed.withColumn(
        "action", F.when(F.col("_rn") > F.col("_n") - max_files, "keep").otherwise("delete")
    ).drop("_rn", "_n")


def compute_budget(
    token_budget: Column, batch_size: Column, accumulate: Column, context: Column
) -> list[Column]:
    per_batch = batch_size * accumulate * context
    return [
        per_batch.cast("bigint").alias("tokens_per_batch"),
        F.floor(token_budget / per_batch).cast("bigint").alias("total_steps"),
    ]


def expected_loss(n: Column, d: Column) -> Column:
    return (
        F.lit(LOSS_FLOOR)
        + F.lit(float(LOSS_N)) / F.pow(n.cast("double"), F.lit(LOSS_N_POWER))
        + F.lit(LOSS_D) / F.pow(d.cast("double"), F.lit(LOSS_D_POWER))
    )


def time_budget_factor(
    stepped: DataFrame, warmup: int, budget_seconds: float, min_factor: float
) -> DataFrame:
    """Linear warm-up over steps, then decay with the time since the run's warm-up ended.

    The clock of a run, one row from a partial aggregate, is handed to each chunk of its steps, so that
    a run of any length is joined by run and chunk.
    """
    now, chunk = micros("ts"), F.floor(F.col("step") / CHUNK_ROWS)
    clocks = stepped.groupBy(F.col("run_id").alias("_run")).agg(
        F.max(F.when(F.col("step") == warmup, now)).alias("_clock"), F.min(chunk).alias("_low"), F.max(chunk).alias("_high")
    )
    clocks = clocks.select("_run", "_clock", F.explode(F.sequence("_low", "_high")).alias("_of"))
    spent = (now - F.col("_clock")) / 1e6 / budget_seconds
    factor = F.when(F.col("step") < warmup, F.col("step") / warmup).otherwise(
        F.greatest(F.lit(float(min_factor)), 1.0 - spent)
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_chunk") == F.col("_of"))
    return stepped.withColumn("_chunk", chunk).join(clocks, same).select("run_id", "step", factor.alias("lr_factor"))


def onecycle_rate(step: Column, total: Column, warmup: int, max_lr: float) -> Column:
    """Cosine from max_lr/25 up to max_lr, then down to a 25th of the start.

    ``step`` counts from 0. The rise ends at ``warmup - 1``, the fall at ``total - 1``.
    """
    initial = max_lr / ONECYCLE_DIV
    final = initial / ONECYCLE_FINAL_DIV

    def cosine(start: float, end: float, share: Column) -> Column:
        return F.lit(end) + F.lit((start - end) / 2.0) * (F.lit(1.0) + F.cos(F.lit(math.pi) * share))

    peak = F.lit(float(warmup - 1))
    rise = cosine(initial, max_lr, step / peak)
    fall = cosine(max_lr, final, (step - peak) / (total - 1 - peak))
    return F.when(step <= peak, rise).otherwise(fall)


def top_operations(calls: DataFrame, op: str, measure: str, n: int = 10) -> DataFrame:
    """The n operations with the largest totals; the limit is the feature."""
    return (
        calls.groupBy(op)
        .agg(F.sum(measure).alias("total"), F.count("*").alias("calls"))
        .orderBy(F.desc("total"), op)
        .limit(n)
    )


def parameter_summary(parameters: DataFrame) -> DataFrame:
    """Element counts over (shape ARRAY<BIGINT>, trainable BOOLEAN)."""
    elements = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    return parameters.select(elements.alias("n"), "trainable").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0)).alias("trainable"),
        F.sum(F.when(F.col("trainable"), 0).otherwise(F.col("n"))).alias("frozen"),
    )
