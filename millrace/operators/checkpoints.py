"""When a run writes a checkpoint: a chain of decisions in the order of the run's steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.indexing import row_index
from millrace.session import materialise

SCAN_ROWS = 262_144
FIRED = "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double"
CLOCKS = ["epoch", "step", "seconds"]
# An entry is a row that may be a chunk's first fire; its chain's last fire in the chunk is the end.
ENTRIES = (
    "key string, chunk bigint, at bigint, epoch double, step double, seconds double, "
    "end_epoch double, end_step double, end_seconds double"
)


def first_due(
    column: np.ndarray, named: np.ndarray, start: np.ndarray, since: np.ndarray, limit: float
) -> np.ndarray:
    """For each (start, since) the first named row from ``start`` on that is ``limit`` past ``since``.

    The number of rows stands for none. Maxima of stretches of doubled lengths are skipped from long to
    short, so the column need not rise. A missing value is never due, and nothing is due after one.
    """
    n = len(column)
    maxima = [np.where(named & ~np.isnan(column), column, -np.inf)]
    while 2 ** len(maxima) <= n:
        half, short = 2 ** (len(maxima) - 1), maxima[-1]
        maxima.append(np.maximum(short, np.append(short[half:], np.full(half, -np.inf))))
    at = start.astype(np.int64)
    with np.errstate(invalid="ignore"):
        for level in range(len(maxima) - 1, -1, -1):
            inside = np.minimum(at, n - 1)
            skipped = (at < n) & ~(maxima[level][inside] - since >= limit)
            at = np.where(skipped, np.minimum(at + 2**level, n), at)
    return at


def first_fires(
    clocks: list[np.ndarray], named: np.ndarray, start: np.ndarray, since: list[np.ndarray], limits: tuple
) -> np.ndarray:
    """The first row from each ``start`` on at which one of the clocks is due."""
    due = [first_due(c, named, start, s, limit) for c, s, limit in zip(clocks, since, limits, strict=True)]
    return np.minimum.reduce(due)


def following(clocks: list[np.ndarray], named: np.ndarray, limits: tuple) -> np.ndarray:
    """For each row the one that fires next if it fires."""
    return first_fires(clocks, named, np.arange(1, len(named) + 1), clocks, limits)


def _in_order(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray]:
    rows = rows.sort_values("rn")
    return rows, [rows[c].to_numpy(dtype=np.float64) for c in CLOCKS], rows["named"].to_numpy(dtype=bool)


def _entries(placed: DataFrame, starts: DataFrame, limits: tuple) -> DataFrame:
    """What a chunk does to a chain that enters it: its possible first fires with their chains' ends.

    Whatever fired before, no clock of it stands above the largest value before the chunk, so a row that
    is due even by those fires at the latest, and later rows are no entries. The first chunk of a run
    has one row: its first fire, or ``at`` = -1, with the state that leaves it.
    """

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, clocks, named = _in_order(rows)
        before = [np.array([rows[f"_{c}"].iloc[0]], dtype=np.float64) for c in CLOCKS]
        n, opening = len(rows), key[1] == 0
        sure = int(first_fires(clocks, named, np.zeros(1, dtype=np.int64), before, limits)[0])
        ends, onward = np.arange(n), following(clocks, named, limits)
        ends = np.where(onward < n, onward, ends)
        while (ends[ends] != ends).any():
            ends = ends[ends]
        at = np.flatnonzero(named[: sure + 1]) if not opening else np.arange(sure, min(sure + 1, n))
        found = {"at": at}
        found |= {c: v[at] for c, v in zip(CLOCKS, clocks, strict=True)}
        found |= {f"end_{c}": v[ends[at]] for c, v in zip(CLOCKS, clocks, strict=True)}
        if opening and not len(at):
            found = {"at": [-1]} | {c: b for c, b in zip(CLOCKS, before, strict=True)}
            found |= {f"end_{c}": b for c, b in zip(CLOCKS, before, strict=True)}
        return pd.DataFrame({"key": key[0], "chunk": key[1], **found})

    return placed.join(starts, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(find, ENTRIES)


def _walk(entries: DataFrame, limits: tuple) -> DataFrame:
    """The chunks' first fires (key, chunk, at), chunk after chunk, streamed in Arrow batches."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last, done = None, None, None
        for batch in batches:
            hits = []
            for (key, chunk), rows in batch.groupby(["key", "chunk"], sort=False):
                if (key, chunk) == done:
                    continue
                if key != run:
                    # A run begins with the one row of its first chunk.
                    run, hit = key, 0
                else:
                    due = np.zeros(len(rows), dtype=bool)
                    for clock, since, limit in zip(CLOCKS, last, limits, strict=True):
                        due |= rows[clock].to_numpy() - since >= limit
                    if not due.any():
                        continue
                    hit = int(due.argmax())
                done, row = (key, chunk), rows.iloc[hit]
                last = tuple(row[f"end_{c}"] for c in CLOCKS)
                if row["at"] >= 0:
                    hits.append((key, chunk, row["at"]))
            if hits:
                yield pd.DataFrame(hits, columns=["key", "chunk", "at"])

    ordered = entries.repartition("key").sortWithinPartitions("key", "chunk", "at")
    return ordered.mapInPandas(scan, "key string, chunk bigint, at bigint")


def _replay(placed: DataFrame, first: DataFrame, limits: tuple) -> DataFrame:
    """All fires of the chunks whose first fire is known."""

    def fires(rows: pd.DataFrame) -> pd.DataFrame:
        rows, clocks, named = _in_order(rows)
        onward, at, hits = following(clocks, named, limits), int(rows["at"].iloc[0]), []
        while at < len(rows):
            hits.append(at)
            at = onward[at]
        return rows.iloc[hits][["run_id", "seq", *CLOCKS]]

    return placed.join(first, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(fires, FIRED)


def _present(clock: str) -> Column:
    return F.col(clock).isNotNull() & ~F.isnan(F.col(clock).cast("double"))


def _starts(placed: DataFrame, states: DataFrame | None) -> DataFrame:
    """Per run and chunk the largest clocks before it; of a first chunk the state that enters it.

    A clock that was missing somewhere before bounds nothing: it is infinite.
    """
    chunks = placed.groupBy("key", "chunk").agg(
        F.min_by("seconds", "rn").alias("_first"),
        *[F.max(c).cast("double").alias(f"_max_{c}") for c in CLOCKS],
        *[F.min(_present(c)).alias(f"_all_{c}") for c in CLOCKS],
    )
    run = W.partitionBy("key").orderBy("chunk")
    opening = {"epoch": F.lit(0.0), "step": F.lit(0.0), "seconds": F.first("_first").over(run)}
    if states is not None:
        kept = states.select(
            _key("run_id").alias("key"), F.lit(True).alias("_kept"), *[F.col(c).cast("double").alias(f"_kept_{c}") for c in CLOCKS]
        )
        chunks = chunks.join(kept, "key", "left")
        opening = {c: F.when(F.col("_kept"), F.col(f"_kept_{c}")).otherwise(o) for c, o in opening.items()}
    chunks = chunks.select("*", *[o.alias(f"_open_{c}") for c, o in opening.items()])
    before = run.rowsBetween(W.unboundedPreceding, -1)
    bounds = []
    for c in CLOCKS:
        whole = F.min(f"_all_{c}").over(before) & _present(f"_open_{c}")
        largest = F.greatest(f"_open_{c}", F.max(f"_max_{c}").over(before))
        bound = F.when(F.col("chunk") == 0, F.col(f"_open_{c}")).otherwise(F.when(whole, largest).otherwise(F.lit(float("inf"))))
        bounds.append(bound.alias(f"_{c}"))
    return chunks.select("key", "chunk", *bounds)


def _key(run_id: str) -> Column:
    """A run's name, of the null run too."""
    return F.coalesce(F.col(run_id).cast("string"), F.lit("null"))


def checkpoint_policy(
    steps: DataFrame,
    max_epochs: int,
    max_steps: int,
    max_seconds: float,
    scan_rows: int = SCAN_ROWS,
    states: DataFrame | None = None,
) -> DataFrame:
    """Steps (run_id, seq, epoch, step, seconds) at which the run writes a checkpoint.

    A row fires when epoch, step or time since the last fire reaches its limit; a fire resets all three.
    The first state is epoch 0, step 0 and the time of the run's first row, or the run's row of
    ``states`` (run_id, epoch, step, seconds). A boolean column ``named``, if there is one, is false for
    steps whose file name stays unfilled: such a row is skipped and resets nothing. A null run is a
    run, a null clock is never due.

    Each fire depends on the one before, so the chain is cut: every chunk of ``scan_rows`` steps finds in
    a task of its own where a chain may enter it and where it then leaves; one narrow pass per run goes
    from chunk to chunk over these entries, and the entered chunks list their fires side by side. A
    chunk has as many entries as steps fit in one limit, so the pass reads a run's length times
    that share; only chunks shorter than a limit are read whole. ``steps`` is read several times while the plan is built
    and the numbered steps are written once, so give a stored table.
    """
    limits = (max_epochs, max_steps, max_seconds)
    narrow = steps.select(
        F.col("run_id").cast("bigint"),
        F.col("seq").cast("bigint"),
        F.col("epoch").cast("bigint"),
        F.col("step").cast("bigint"),
        F.col("seconds").cast("double"),
        (F.coalesce("named", F.lit(True)) if "named" in steps.columns else F.lit(True)).alias("named"),
    )
    numbered = row_index(narrow, "seq", "rn", within=("run_id",))
    chunk = F.floor((F.col("rn") - 1) / scan_rows)
    placed = materialise(numbered.select(_key("run_id").alias("key"), chunk.alias("chunk"), "*"), "run-steps")
    entries = _entries(placed, _starts(placed, states), limits)
    return _replay(placed, _walk(entries, limits), limits)
