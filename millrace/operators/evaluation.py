"""Outcomes of generated candidates and masked losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: denominator when a batch has no active element.
NO_ACTIVE = 1e-8


def stop_flag(ids: Column, pad, stop: list) -> Column:
    """Is the last id that is not padding a stop id? With padding only, the first id counts."""
    last_real = F.try_element_at(F.filter(ids, lambda t: t != F.lit(pad)), F.lit(-1))
    return F.coalesce(last_real, F.get(ids, F.lit(0))).isin(stop)


def strip_prompt(ids: Column, prompt_length: Column) -> Column:
    return F.slice(ids, (prompt_length + 1).cast("int"), F.greatest(F.size(ids), F.lit(1)))


def wrong_candidate_counts(candidates: DataFrame, k: int) -> DataFrame:
    """Tasks that do not have exactly k candidates."""
    return (
        candidates.groupBy("task_id")
        .agg(F.count("*").alias("n_candidates"))
        .where(F.col("n_candidates") != k)
    )


def outcomes(recorded: DataFrame) -> DataFrame:
    """Flags and error log from return codes.

    A time-out leaves the flags as they stood, so a missing build code means that the build
    itself timed out. Its log is null.
    """
    compiled = F.coalesce(F.col("build_rc") == 0, F.lit(False))
    passed = compiled & ~F.col("timed_out") & F.coalesce(F.col("test_rc") == 0, F.lit(False))
    failed = F.when(F.col("build_rc") != 0, True).otherwise(F.coalesce(F.col("test_rc") != 0, F.lit(False)))
    return recorded.select(
        "task_id",
        "candidate_id",
        compiled.alias("compiled"),
        passed.alias("passed"),
        F.when(~F.col("timed_out") & failed, F.col("stderr")).alias("error_log"),
        "code",
    )


def task_counts(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("task_id").agg(
        F.count_if("compiled").alias("num_compiled"), F.count_if("passed").alias("num_passed")
    )


def task_rates(counts: DataFrame, k: int) -> DataFrame:
    return counts.select(
        "task_id",
        (F.col("num_passed") / k).alias("pass_rate"),
        (F.col("num_compiled") / k).alias("compile_rate"),
    )


def any_of_k(counts: DataFrame, k: int) -> DataFrame:
    """Share of tasks with at least one passing, and one compiling, candidate among k."""
    return counts.agg(
        F.lit(k).alias("k"),
        F.avg((F.col("num_passed") > 0).cast("double")).alias("pass_at_k"),
        F.avg((F.col("num_compiled") > 0).cast("double")).alias("compile_at_k"),
    )


def nested_summary(outcome: DataFrame) -> DataFrame:
    """One row per task with its candidates, in order; a task has k of them."""
    return outcome.groupBy("task_id").agg(
        F.array_sort(
            F.collect_list(F.struct("candidate_id", "compiled", "passed", "error_log", "code"))
        ).alias("candidate_sequences"),
        F.count_if("compiled").alias("num_compiled"),
        F.count_if("passed").alias("num_passed"),
    )


def write_eval_summary(summary: DataFrame, path: str) -> None:
    summary.write.json(path)


def masked_loss(losses: DataFrame, pad, *by: str) -> DataFrame:
    """Mean loss over the targets that are not padding, per batch."""
    active = F.col("target") != F.lit(pad)
    count = F.count_if(active)
    return losses.groupBy(*by).agg(
        (
            F.coalesce(F.sum(F.when(active, F.col("loss"))), F.lit(0.0))
            / F.when(count == 0, NO_ACTIVE).otherwise(count)
        ).alias("loss"),
        F.count("*").alias("n_targets"),
    )


def dataset_loss(losses: DataFrame, pad) -> DataFrame:
    """Per data set the unweighted mean of its batches' losses."""
    return (
        masked_loss(losses, pad, "dataset", "batch")
        .groupBy("dataset")
        .agg(F.avg("loss").alias("loss"), F.count("*").alias("n_batches"))
    )
