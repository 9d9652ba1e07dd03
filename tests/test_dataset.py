import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import dataset, indexing
from millrace.plans import bindings as b


def documents(spark, lengths, shard=0):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((shard, i + 1, i, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "shard_id int, rn bigint, doc_id int, ids array<int>")


@pytest.mark.parametrize("keep_last", [False, True])
@pytest.mark.parametrize("width, stride", [(5, 4), (5, 5), (3, 5), (8, 2)])
@pytest.mark.parametrize("lengths", [[], [0], [5], [1, 3, 1], [4, 0, 7, 2], [13], [2] * 12, [9, 9, 3]])
def test_strict_windows(spark, lengths, width, stride, keep_last):
    n = sum(lengths)
    stop = n - width + (1 if keep_last else 0)
    expected = [(s, list(range(s, s + width))) for s in range(0, max(stop, 0), stride)]
    found = dataset.strict_windows(documents(spark, lengths), width, stride, keep_last)
    assert sorted((r.start, r.ids) for r in found.collect()) == expected


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_windows_over_shards_read_narrow_columns(spark):
    docs = documents(spark, [3, 4, 5])
    for frame in (dataset.strict_windows(docs, 5, 4), dataset.flatten_tokens(docs)):
        lines = plan_of(frame).split("\n")
        at = max(n for n, line in enumerate(lines) if "Window [" in line)
        assert re.search(r"Project \[shard_id#\d+, rn#\d+L?, cast\(size\(ids#\d+, \w+\) as bigint\) AS _n#\d+L\]", lines[at + 1]), lines[at + 1]


def test_counts_move_no_text(spark, small):
    docs = b.shards(spark, small, "content")
    sized = dataset.token_counts(docs.withColumn("ids", F.split("content", " ")))
    for frame in (sized, dataset.shard_progress(docs.withColumn("rn", F.col("doc_id")))):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "text" in plan
        moved = [line for line in plan_of(frame).split("\n") if "Window" in line or "Aggregate" in line]
        assert moved and not any("content#" in line or "ids#" in line for line in moved)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()


def test_cut_points(spark):
    frame = spark.range(1000).select((F.col("id") * 3).alias("key"))
    assert indexing.cut_points(frame, "key", 300) == [900, 1800, 2700]
    assert indexing.cut_points(frame, "key", 1000) == [] and indexing.cut_points(frame.limit(0), "key", 5) == []


def test_padded_windows(spark):
    width, stride = 5, 4
    lengths = [0, 1, 4, 5, 6, 9]
    found = {}
    for r in dataset.padded_windows(documents(spark, lengths), width, stride, -1).collect():
        found.setdefault(r.doc_id, {})[r.start] = r.ids
    at = 0
    for i, n in enumerate(lengths):
        ids = list(range(at, at + n))
        expected = {s: (ids[s : s + width] + [-1] * width)[:width] for s in range(0, n, stride)}
        assert found.get(i, {}) == expected
        at += n


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
def test_split_is_exact(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    found = dataset.exact_split(rows, 7, "doc_id").collect()
    assert sum(r.split == "train" for r in found) == int(n * 0.9)
    assert sorted(r.pos for r in found) == list(range(1, n + 1))


def test_flatten_refuses_large_ids(spark):
    docs = documents(spark, [3])
    assert dataset.flatten_tokens(docs, max_id=2).count() == 3
    with pytest.raises(Exception, match="out of range"):
        dataset.flatten_tokens(docs, max_id=1).collect()


def test_buffered_shuffle_keeps_windows_within_reach(spark):
    rows = [(s, w) for s in range(12) for w in range(s % 5 + 1)]
    frame = spark.createDataFrame(rows, "shard_id int, win bigint")
    found = dataset.buffered_shuffle(frame, 3, 5, buffer=6).orderBy("pos").collect()
    assert sorted((r.shard_id, r.win) for r in found) == rows
    assert [r.pos for r in found] == list(range(1, len(rows) + 1))
    groups = [r.buffer_group for r in found]
    assert groups == sorted(groups)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard_id, set()).add(r.buffer_group)
    assert all(len(g) == 1 for g in by_shard.values())


def test_buffered_shuffle_of_many_groups_broadcasts_nothing_large(spark):
    frame = spark.range(10_000).select((F.col("id") / 4).cast("int").alias("shard_id"), F.col("id").alias("win"))
    found = dataset.buffered_shuffle(frame, 3, 5, buffer=5)
    assert sorted(r.pos for r in found.collect()) == list(range(1, 10_001))


def test_filled_decimals_of_any_width(spark):
    frame = spark.createDataFrame([("{v:.9f}|{v:.1f}|{v}", 0.125), ("{v:.0f}{w:.2f}", 2.5)], "p string, v double")
    got = [r[0] for r in frame.select(t.fill_filename(F.col("p"), {"v": F.col("v")})).collect()]
    assert got == ["0.125000000|0.1|0.125", "2{w:.2f}"]


def test_left_truncate(spark):
    row = documents(spark, [10])

    def last(context, new):
        return row.select(dataset.left_truncate(F.col("ids"), context, new).alias("x")).first().x

    assert last(7, 3) == [6, 7, 8, 9]
    assert last(30, 3) == list(range(10))
    assert last(5, 5) == []
    with pytest.raises(ValueError):
        last(4, 5)


def test_batches_and_steps(spark):
    placed = indexing.shuffled_index(spark.range(23).toDF("doc_id"), 1, "doc_id", total="total")
    assert dataset.assign_batches(placed, 5, True).count() == 20
    assert dataset.assign_batches(placed, 5, False).count() == 23
    full = dataset.assign_batches(placed, 5, True)
    steps = dataset.assign_steps(full, 3, F.floor(F.col("total") / 5))
    assert {r.batch_id for r in steps.collect()} == {0, 1, 2}


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(indexing, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(indexing, "MIN_BUCKET", 1)
    monkeypatch.setattr(indexing, "FINE_STEP", 4)


def test_running_total_over_many_buckets(spark, small_buckets):
    rng = random.Random(5)
    # One run holds most rows, and keys lie far apart in places.
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 3), k * k * k, rng.randint(0, 9)) for k in range(120)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "run_id int, seq bigint, n int")
    found = indexing.running_total(frame, "seq", F.col("n"), "so_far", within=("run_id",), total="all")
    sums, expected = {}, {}
    for run, seq, n in sorted(rows, key=lambda r: r[1]):
        sums[run] = sums.get(run, 0) + n
        expected[seq] = sums[run]
    assert {r.seq: r.so_far for r in found.collect()} == expected
    assert {(r.run_id, r["all"]) for r in found.collect()} == set(sums.items())
    index = indexing.row_index(frame, "seq").orderBy("seq").collect()
    assert [r.rn for r in index] == list(range(1, 121))


def test_bounds_split_evenly(spark, small_buckets):
    frame = spark.range(200).withColumnRenamed("id", "k")
    bounds = indexing.quantile_bounds(frame, "k")
    sizes = frame.groupBy(indexing.bucket_of(F.col("k"), bounds)).count().collect()
    assert len(sizes) > 50 and max(r["count"] for r in sizes) <= 8


def test_draws_and_resume(spark):
    rows = spark.range(10).toDF("doc_id")
    draws = spark.range(50).toDF("draw")
    found = dataset.draw_rows(rows, draws, 1, "doc_id").collect()
    assert len(found) == 50 and {r.doc_id for r in found} <= set(range(10))
    indexed = indexing.row_index(rows, "doc_id")
    assert dataset.resume_by_position(indexed, 4).count() == 6


def test_text_functions(spark):
    row = spark.createDataFrame(
        [("  x \n", "//c", "/*c*/", '"s"', 12345, 999, 0.125)], "a string, b string, c string, d string, n int, m int, v double"
    )
    found = row.select(
        t.strip_ws(F.col("a")),
        t.comment_inner(F.col("b")),
        t.comment_inner(F.col("c")),
        t.string_inner(F.col("d")),
        t.human_count(F.col("n")),
        t.human_bytes(F.col("m")),
        t.fixed_decimals(F.col("v"), 2),
        t.fill_filename("{step}-{loss:.2f}-{epoch}", {"step": F.col("m"), "loss": F.col("v")}),
    ).first()
    assert list(found) == ["x", "c", "*c*", "s", "12.3k", "999 B", "0.12", "999-0.12-{epoch}"]
