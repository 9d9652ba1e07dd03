"""From encoded documents to training windows, batches, steps and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.hashing import hex_bucket, seeded_md5
from millrace.operators.indexing import row_index, running_total, shuffled_index

# Fixed value: memory of the shuffle buffer; one id takes eight bytes there.
BUFFER_BYTES = 2**30


def token_counts(documents: DataFrame) -> DataFrame:
    """Tokens per document, per shard and in all, from one rollup."""
    sized = documents.select("shard_id", "doc_id", F.size("ids").cast("bigint").alias("n"))
    return sized.rollup("shard_id", "doc_id").agg(F.sum("n").alias("num_tokens"))


def shard_offsets(documents: DataFrame) -> DataFrame:
    """Position of each document's first token in its shard, and the shard's length.

    The window sees only (shard_id, rn, number of ids); its offsets are joined back by shard and row,
    which spreads a shard over tasks. ``rn`` is unique in its shard. Documents are read twice: encoded
    ones should come from a table.
    """
    n = F.col("_n")
    shard = W.partitionBy("shard_id")
    before = shard.orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    sized = documents.select("shard_id", "rn", F.size("ids").cast("bigint").alias("_n"))
    offsets = sized.select(
        "shard_id",
        "rn",
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("doc_offset"),
        F.sum(n).over(shard).alias("shard_tokens"),
    )
    return documents.join(offsets, ["shard_id", "rn"])


def flatten_tokens(documents: DataFrame, max_id: int | None = None) -> DataFrame:
    """The token stream of each shard: documents in order, nothing between them.

    With ``max_id`` an id outside [0, max_id] stops the job, as a 16-bit array could not hold it.
    """
    token = F.col("token")
    if max_id is not None:
        token = F.when(token.between(0, max_id), token).otherwise(
            F.raise_error(F.concat(F.lit("token id out of range: "), token.cast("string")))
        )
    return shard_offsets(documents).select(
        "shard_id", "doc_id", "doc_offset", F.posexplode("ids").alias("pos", "token")
    ).select("shard_id", (F.col("doc_offset") + F.col("pos")).alias("gpos"), "doc_id", token.alias("token"))


def strict_windows(
    documents: DataFrame, width: int, stride: int, keep_last: bool = False
) -> DataFrame:
    """Windows of exactly ``width`` tokens that start every ``stride`` tokens of a shard.

    The last possible start is left out unless ``keep_last``. Each document hands out slices,
    one per window it touches, so rows grow with windows and not with tokens.
    """
    placed = shard_offsets(documents).where(F.size("ids") > 0)
    off, n = F.col("doc_offset"), F.size("ids")
    first = F.greatest(F.lit(0), F.floor((off - width) / stride) + 1)
    last = F.floor((off + n - 1) / stride)
    start = F.col("win") * stride
    fits = start <= F.col("shard_tokens") - width if keep_last else start < F.col("shard_tokens") - width
    begin, end = F.greatest(start, off), F.least(start + width, off + n)
    pieces = (
        placed.withColumn("win", F.explode(F.when(first <= last, F.sequence(first, last))))
        .where(fits & (begin < end))
        .select(
            "shard_id",
            "win",
            off.alias("off"),
            F.slice("ids", (begin - off + 1).cast("int"), (end - begin).cast("int")).alias("part"),
        )
    )
    return pieces.groupBy("shard_id", "win").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("off", "part"))), lambda p: p["part"])
        ).alias("ids")
    ).select("shard_id", "win", (F.col("win") * stride).alias("start"), "ids")


def padded_windows(samples: DataFrame, width: int, stride: int, pad) -> DataFrame:
    """Windows of one sample each, the short ones filled up with ``pad`` on the right."""
    n = F.size("ids")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride)))
    part = F.slice("ids", F.col("start") + 1, F.lit(width))
    return (
        samples.withColumn("start", F.explode(starts))
        .withColumn("part", part)
        .withColumn("n_real", F.size("part"))
        .withColumn(
            "ids",
            F.concat("part", F.array_repeat(F.lit(pad), F.lit(width) - F.col("n_real"))),
        )
        .drop("part")
    )


def global_shuffle(rows: DataFrame, seed, *ids: str) -> DataFrame:
    return shuffled_index(rows, seed, *ids, name="pos")


def buffered_shuffle(
    windows: DataFrame, seed, width: int, buffer: int | None = None
) -> DataFrame:
    """Random order that mixes shards only within a buffer's reach.

    Shards come in random order; those whose windows start within the same buffer length form
    a group, and windows are in random order inside their group.
    """
    buffer = buffer or BUFFER_BYTES // (width * 8)
    sizes = windows.groupBy("shard_id").agg(F.count("*").alias("n_windows"))
    ranked = sizes.withColumn("_file_md5", seeded_md5(seed, F.col("shard_id")))
    placed = running_total(
        ranked, "_file_md5", F.col("n_windows"), "_until", bucket=hex_bucket(F.col("_file_md5"))
    ).select(
        "shard_id",
        "n_windows",
        F.floor((F.col("_until") - F.col("n_windows")) / buffer).alias("buffer_group"),
    )
    keyed = windows.join(placed.drop("n_windows"), "shard_id").withColumn(
        "_md5", seeded_md5(seed, F.col("shard_id"), F.col("win"))
    )
    inside = running_total(
        keyed, "_md5", F.lit(1), "_inside", within=("buffer_group",), bucket=hex_bucket(F.col("_md5"))
    )
    groups = placed.groupBy("buffer_group").agg(F.sum("n_windows").alias("_n"))
    starts = running_total(groups, "buffer_group", F.col("_n"), "_end").select(
        F.col("buffer_group").alias("_group"), (F.col("_end") - F.col("_n")).alias("_start")
    )
    joined = inside.join(starts, F.col("buffer_group") == F.col("_group"))
    return joined.withColumn("pos", F.col("_start") + F.col("_inside")).drop(
        "_md5", "_inside", "_group", "_start"
    )


def assign_batches(
    ordered: DataFrame, batch_size: int, drop_last: bool, pos: str = "pos", total: str = "total"
) -> DataFrame:
    """Consecutive rows to batches; the incomplete last one is kept or dropped."""
    out = ordered.withColumn("batch_id", F.floor((F.col(pos) - 1) / batch_size))
    if drop_last:
        out = out.where((F.col("batch_id") + 1) * batch_size <= F.col(total))
    return out


def assign_steps(batches: DataFrame, accumulate: int, batches_in_epoch: Column) -> DataFrame:
    """Optimizer step of each batch of an epoch; leftover batches form none."""
    step = F.floor(F.col("batch_id") / accumulate)
    return batches.withColumn("step", step).where((step + 1) * accumulate <= batches_in_epoch)


def exact_split(rows: DataFrame, seed, *ids: str, share: float = 0.9) -> DataFrame:
    """Seeded shuffle, then exactly floor(n * share) rows to ``train``, the rest ``validation``."""
    placed = shuffled_index(rows, seed, *ids, name="pos", total="_n")
    cut = F.floor(F.col("_n") * F.lit(share))
    return placed.withColumn(
        "split", F.when(F.col("pos") <= cut, "train").otherwise("validation")
    ).drop("_n")


def shift_targets(windows: DataFrame) -> DataFrame:
    n = F.greatest(F.size("ids") - 1, F.lit(0))
    return windows.withColumn("inputs", F.slice("ids", F.lit(1), n)).withColumn(
        "targets", F.slice("ids", F.lit(2), n)
    )


def pad_masks(shifted: DataFrame, pad) -> DataFrame:
    def mask(ids: str) -> Column:
        return F.transform(ids, lambda t: (t != F.lit(pad)).cast("int"))

    return shifted.withColumn("attention_mask", mask("inputs")).withColumn("loss_mask", mask("targets"))


def left_truncate(ids: Column, context: int, max_new: int) -> Column:
    """The last ``context - max_new`` ids, which leaves room for ``max_new`` more."""
    if context < max_new:
        raise ValueError("context must be at least max_new")
    keep = context - max_new
    if keep == 0:
        return F.slice(ids, 1, 0)
    return F.when(F.size(ids) > keep, F.slice(ids, -keep, keep)).otherwise(ids)


def completion_budget(ids: Column, context: int, max_new: int) -> Column:
    return F.least(F.lit(max_new), F.lit(context) - F.size(ids))


def sample_rows(rows: DataFrame, seed, n: int, *ids: str) -> DataFrame:
    """``n`` distinct rows drawn at random; the limit is the feature."""
    return (
        rows.withColumn("_md5", seeded_md5(seed, *[F.col(i) for i in ids]))
        .orderBy("_md5")
        .limit(n)
        .drop("_md5")
    )


def draw_rows(rows: DataFrame, draws: DataFrame, seed, order: str) -> DataFrame:
    """One row drawn with replacement for each row of ``draws`` (column ``draw``).

    A draw becomes a row position; rows and draws meet in an equi-join on it.
    """
    indexed = row_index(rows, order, "_rn")
    n = rows.count()
    digest = seeded_md5(seed, F.col("draw"))
    position = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.lit(n)) + 1
    return draws.withColumn("_rn", position).join(indexed, "_rn").drop("_rn")


def review_filter(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Rows whose reviewer did not answer ``n``; no answer keeps the row."""
    return rows.join(reviews, key, "left").where(F.coalesce(F.col("answer"), F.lit("")) != "n")


def resume_by_key(prompts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return prompts.join(done.select(key), key, "left_anti")


def resume_by_position(indexed: DataFrame, n_done: int, rn: str = "rn") -> DataFrame:
    return indexed.where(F.col(rn) > n_done)


def validation_sets(named: DataFrame, trained: str, seed, *ids: str, share: float = 0.9) -> DataFrame:
    """The trained set's held-out rows under its name, then every other known set in full."""
    own = exact_split(named.where(F.col("name") == trained), seed, *ids, share=share)
    held_out = own.where(F.col("split") == "validation").drop("split", "pos")
    return held_out.unionByName(named.where(F.col("name") != trained))


def shard_progress(sharded: DataFrame) -> DataFrame:
    """Rows and characters of the shard being filled, after each row; lengths are shuffled, not texts."""
    so_far = W.partitionBy("shard_id").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    return sharded.select("shard_id", "doc_id", "rn", F.length("content").alias("_chars")).select(
        "shard_id",
        "doc_id",
        F.count("*").over(so_far).alias("rows_so_far"),
        F.sum("_chars").over(so_far).alias("chars_so_far"),
    )
