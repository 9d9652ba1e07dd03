import json
import random
import re

import numpy as np
import pytest
from models import checkpoint_chain
from pyspark.sql import functions as F

from millrace.operators import checkpoints, evaluation, metrics
from millrace.operators.indexing import row_index
from millrace.sources import corpus as src
from millrace.streaming import jobs


def chain_rows():
    rng, rows = random.Random(2), []
    for run in range(3):
        step, epoch, seconds = 0, 0, 100.0 * run
        for i in range(200):
            step += 1
            epoch += rng.random() < 0.02
            seconds += rng.choice([0, 1, 1, 30]) if run else 1
            rows.append((run, i * 3 + run, epoch, step, seconds))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(1, 25, 60.0), (5, 10, 1e9), (9, 999, 45.0)])
def test_checkpoint_policy_and_stream(spark, tmp_path, limits):
    rows = chain_rows()
    frame = spark.createDataFrame(rows, "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double")
    expected = set()
    for run in range(3):
        ordered = sorted(r[1:] for r in rows if r[0] == run)
        expected |= {(run, s) for s in checkpoint_chain(ordered, limits)}
    found = checkpoints.checkpoint_policy(frame, *limits, scan_rows=17)
    assert {(r.run_id, r.seq) for r in found.collect()} == expected
    path = str(tmp_path / "steps")
    middle = sorted(r[1] for r in rows)[len(rows) // 2]
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        frame.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, frame.schema, per_trigger=1)
    fires, late = jobs.checkpoint_policy(stream, *limits)
    assert {(r.run_id, r.seq) for r in fires.collect()} == expected and late.isEmpty()


def test_unfilled_names_are_skipped_without_a_reset(spark):
    rows = [(1, s, 0, s, 0.0, s not in (3, 4, 8)) for s in range(1, 13)]
    frame = spark.createDataFrame(rows, "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double, named boolean")
    found = checkpoints.checkpoint_policy(frame, 9, 3, 1e9).collect()
    assert [r.seq for r in found] == [5, 9, 12]


def due_by_scan(column, named, start, since, limit):
    return [
        next((j for j in range(i, len(column)) if named[j] and column[j] - s >= limit), len(column))
        for i, s in zip(start, since)
    ]


def test_first_due_row_of_any_column():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 17, 64, 65):
        column = rng.integers(0, 9, n).astype(float)
        column[rng.random(n) < 0.1] = np.nan
        named, start = rng.random(n) < 0.8, rng.integers(0, n + 1, 40)
        since = np.append(rng.integers(-3, 9, 38).astype(float), [np.nan, np.inf])
        for limit in (-2, 0, 3, 7.5):
            found = checkpoints.first_due(column, named, start, since, limit)
            assert found.tolist() == due_by_scan(column, named, start, since, limit)


def chain_with_gaps(rows, limits):
    """rows of (seq, epoch, step, seconds, named) in order; nulls are never due."""
    last, fired = (0, 0, rows[0][3]), []
    for seq, *now, named in rows:
        due = any(a is not None and b is not None and a - b >= limit for a, b, limit in zip(now, last, limits))
        if named and due:
            fired.append(seq)
            last = tuple(now)
    return fired


@pytest.mark.parametrize("scan_rows", [1, 7, 40, 1000])
def test_chunks_of_a_run_give_the_whole_chain(spark, scan_rows):
    rng, rows = random.Random(scan_rows), []
    for run in (None, 1, 2, 3, 4):
        step, limit_of_nulls = 0, 0.1 if run in (2, 3) else 0
        for seq in range(rng.choice([1, 50, 120])):
            step = step + 1 if run != 4 else rng.randint(0, 40)
            clocks = [seq // 40, step, float(rng.choice([seq, seq, 3 * seq]))]
            clocks = [None if rng.random() < limit_of_nulls else c for c in clocks]
            rows.append((run, seq, *clocks, rng.random() < 0.8))
    frame = spark.createDataFrame(
        rows, "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double, named boolean"
    ).repartition(3)
    for limits in ((2, 9, 60.0), (9, 35, 1e9)):
        expected = set()
        for run in {r[0] for r in rows}:
            expected |= {(run, s) for s in chain_with_gaps(sorted(r[1:] for r in rows if r[0] == run), limits)}
        found = checkpoints.checkpoint_policy(frame, *limits, scan_rows=scan_rows).collect()
        assert {(r.run_id, r.seq) for r in found} == expected and len(found) == len(expected)


def test_entries_are_few_where_chunks_are_long(spark):
    rows = [(1, s, 0, s, 0.0) for s in range(4000)]
    frame = spark.createDataFrame(rows, "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double")
    placed = frame.select(
        F.lit("1").alias("key"), F.floor(F.col("seq") / 1000).alias("chunk"), (F.col("seq") + 1).alias("rn"), "*", F.lit(True).alias("named")
    )
    entries = checkpoints._entries(placed, checkpoints._starts(placed, None), (9, 25, 1e9))
    assert entries.count() == 1 + 3 * 25


def test_checkpoint_stream_goes_on_after_a_stop(spark, tmp_path):
    rows = chain_rows()
    frame = spark.createDataFrame(rows, "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double")
    path, progress = str(tmp_path / "steps"), str(tmp_path / "progress")
    for low, high in ((0, 90), (90, 333), (333, 9999)):
        frame.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, frame.schema, per_trigger=None)
        fires, late = jobs.checkpoint_policy(stream, 2, 25, 60.0, path=progress)
    expected = {(r.run_id, r.seq) for r in checkpoints.checkpoint_policy(frame, 2, 25, 60.0).collect()}
    assert {(r.run_id, r.seq) for r in fires.collect()} == expected and late.isEmpty()


def test_stream_reports_late_steps(spark, tmp_path):
    schema = "run_id bigint, seq bigint, epoch bigint, step bigint, seconds double"
    path = str(tmp_path / "steps")
    for part in ([(1, s, 0, s, 0.0) for s in (4, 5, 6)], [(1, s, 0, s, 0.0) for s in (2, 6, 7, 9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, spark.read.parquet(path).schema, per_trigger=1)
    fires, late = jobs.checkpoint_policy(stream, 9, 4, 1e9)
    assert sorted(r.seq for r in fires.collect()) == [4, 9]
    assert sorted(r.seq for r in late.collect()) == [2, 6]


def test_null_groups_keep_their_rows(spark):
    rows = [(None, 1), (None, 2), ("a", 3), ("a", 4)]
    frame = spark.createDataFrame(rows, "run string, seq bigint")
    found = row_index(frame, "seq", "rn", within=("run",), total="n").collect()
    assert sorted((r.seq, r.rn, r.n) for r in found) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2)]


def test_rolling_mean_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK_ROWS", 10)
    values = [float(i * i % 17) for i in range(57)]
    values[30] = float("nan")
    frame = row_index(spark.createDataFrame(list(enumerate(values)), "step bigint, loss double"), "step")
    found = {r.step: r.m for r in metrics.rolling_mean(frame, "loss", 5, "m").collect()}
    for i in range(57):
        part = values[max(0, i - 4) : i + 1]
        if len(part) < 5:
            assert found[i] is None
        elif 30 in range(i - 4, i + 1):
            assert found[i] != found[i]
        else:
            assert found[i] == pytest.approx(sum(part) / 5)


def test_curves_keep_argument_and_line_order(spark, tmp_path):
    paths = []
    for name, lines in (("z", ["5,1,0.5", "3,2,0.25"]), ("a", ["9,3,"])):
        paths.append(str(tmp_path / f"{name}.csv"))
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    curve = metrics.concat_curves(src.read_curve(spark, paths), "offset")
    rows = [(r["index"], r.step, r.loss) for r in curve.orderBy("index").collect()]
    assert rows == [(0, 5.0, 0.5), (1, 3.0, 0.25), (2, 9.0, None)]


def test_bad_json_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"sample": "x"}', '{"sample": "y', "[1", '{"sample": null}', '{"other": 1}', '{"sample": "  "}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = src.split_rejected(src.read_samples(spark, str(tmp_path / "s.jsonl")))
    assert [r.sample for r in good.collect()] == ["x"]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "malformed", "malformed", "missing", "missing"]


def test_append_adds(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([("a\nb",)], "sample string")
    src.append_samples(frame, path)
    src.append_samples(frame, path)
    assert src.read_samples(spark, path).count() == 2


def test_shard_files_and_pruning(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.createDataFrame(
        [(i // 3, i + 1, i, [i]) for i in range(10)], "shard_id int, rn bigint, doc_id bigint, ids array<int>"
    )
    counted = src.write_token_shards(docs, path)
    assert src.read_token_shards(spark, path).count() == 10
    one = src.read_token_shards(spark, path, [2])
    assert [r.doc_id for r in one.orderBy("rn").collect()] == [6, 7, 8]
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard_id", plan)
    names = [r.name for r in src.list_files(spark, path, ".parquet").collect()]
    assert len(names) == 4


def test_token_shards_have_a_summary_and_a_limit(spark, tmp_path):
    schema = "shard_id int, rn bigint, doc_id bigint, ids array<int>"
    docs = spark.createDataFrame([(0, 1, 1, [3, 65_535]), (0, 2, 2, []), (1, 3, 3, None), (1, 4, 4, [7])], schema)
    counted = src.write_token_shards(docs, str(tmp_path / "good"))
    assert counted == {"documents": 4, "num_tokens": 3, "largest_id": 65_535}
    stored = [json.loads(f.read_text()) for f in (tmp_path / "good" / "summary.json").glob("part-*.json")]
    assert stored == [{"num_tokens": 3}]
    for bad in (65_536, -1):
        path = tmp_path / f"bad{bad}"
        with pytest.raises(Exception, match="out of range in document 9"):
            src.write_token_shards(docs.unionByName(spark.createDataFrame([(1, 5, 9, [bad])], schema)), str(path))
        assert not (path / "summary.json").exists()
    assert src.write_token_shards(docs.limit(0), str(tmp_path / "none")) == {
        "documents": 0, "num_tokens": 0, "largest_id": None,
    }


def test_curve_of_a_folder_keeps_the_order_of_files_and_lines(spark, tmp_path):
    lines = [f"{i},1,0.5" for i in range(500)]
    for k in range(5):
        (tmp_path / f"part-{k}.csv").write_text("\n".join(lines[100 * k : 100 * k + 100]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # Several splits to a file, so that no file is read by one task.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        found = src.read_curve(spark, [str(tmp_path), str(tmp_path / "part-3.csv")])
        rows = sorted((r.file_ordinal, r.offset, r.step) for r in found.collect())
        assert found.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == [(0, i, float(i)) for i in range(500)] + [(1, i, 300.0 + i) for i in range(100)]


def shard_files(spark, path, shards):
    for shard, texts in shards:
        rows = [(shard, shard * 100 + i, text) for i, text in enumerate(texts)]
        frame = spark.createDataFrame(rows, "shard_id int, doc_id bigint, content string")
        frame.coalesce(1).write.mode("append").parquet(path)
    return frame.schema


class Crash(Exception):
    pass


def test_token_stream_counts_once_over_restarts(spark, tmp_path):
    path, place = str(tmp_path / "shards"), str(tmp_path / "place")
    shards = [(k, ["a b c", "d", "e f"][: k + 1]) for k in range(3)] + [(3, ["a b c d e f g h"])]
    schema = shard_files(spark, path, shards)
    words = lambda d: d.select("shard_id", "doc_id", F.transform(F.split("content", " "), lambda w: F.ascii(w)).alias("ids"))
    seen = []

    def crashing(at):
        def encode(batch):
            seen.append(1)
            if len(seen) == at:
                raise Crash("stopped")
            return words(batch)

        return encode

    stream = lambda: jobs.file_stream(spark, path, schema, per_trigger=1)
    with pytest.raises(Exception, match="stopped"):
        jobs.tokenize_files(stream(), crashing(3), place)
    half = spark.read.parquet(f"{place}/ledger").orderBy("batch_id").collect()
    assert [r.running_tokens for r in half] == [3, 7]
    # As if the last batch had been written but not committed: its number comes again and replaces it.
    spark.read.parquet(f"{place}/ledger/batch_id=1").withColumn("num_tokens", F.lit(999).cast("bigint")).write.parquet(
        f"{place}/ledger/batch_id=2"
    )
    ledger, tokens = jobs.tokenize_files(stream(), words, place)
    rows = ledger.orderBy("batch_id").collect()
    assert [(r.batch_id, r.shard_id, r.documents, r.num_tokens, r.running_tokens) for r in rows] == [
        (0, 0, 1, 3, 3), (1, 1, 2, 4, 7), (2, 2, 3, 6, 13), (3, 3, 1, 8, 21),
    ]
    assert tokens.count() == 7 and tokens.select("doc_id").distinct().count() == 7
    # A later run takes new files only.
    shard_files(spark, path, [(9, ["x y"])])
    ledger, _ = jobs.tokenize_files(stream(), words, place)
    assert ledger.agg(F.max("running_tokens"), F.sum("num_tokens")).first() == (23, 23)


def test_weighted_means_go_on_after_a_restart(spark, tmp_path):
    path, place = str(tmp_path / "rows"), str(tmp_path / "place")
    rows = [(f"m{i % 3}", float(i), 1 + i % 4) for i in range(40)]
    frame = lambda part: spark.createDataFrame(part, "name string, value double, weight bigint")
    stream = lambda: jobs.file_stream(spark, path, frame(rows).schema, per_trigger=1)
    for at in range(0, 20, 5):
        frame(rows[at : at + 5]).coalesce(1).write.mode("append").parquet(path)
    jobs.weighted_means(stream(), place)
    for at in range(20, 40, 5):
        frame(rows[at : at + 5]).coalesce(1).write.mode("append").parquet(path)
    found = {r["name"]: r["mean"] for r in jobs.weighted_means(stream(), place).collect()}
    expected = {r["name"]: r["mean"] for r in metrics.weighted_mean(frame(rows)).collect()}
    assert found == pytest.approx(expected)


def test_time_budget_joins_by_run_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CHUNK_ROWS", 7)
    rows = [(run, s, s * 1_000_000) for run in (1, None) for s in range(1, 40)] + [(2, s, s) for s in range(1, 5)]
    frame = spark.createDataFrame(rows, "run_id bigint, step bigint, us bigint").withColumn("ts", F.timestamp_micros("us"))
    found = metrics.time_budget_factor(frame, 10, 100.0, 0.8)
    got = {(r.run_id, r.step): r.lr_factor for r in found.collect()}
    assert len(got) == len(rows)
    for run, s, _ in rows:
        assert got[run, s] == pytest.approx(s / 10 if s < 10 else max(0.8, 1 - (s - 10) / 100)), (run, s)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in [line for line in plan.split("\n") if "Join" in line][0]


def test_outcomes(spark):
    rows = [
        (1, 0, 0, 0, False, "warn"),  # passes
        (1, 1, 2, None, False, "build"),  # build fails
        (1, 2, 0, 1, False, "test"),  # test fails
        (1, 3, None, None, True, "stale"),  # build times out
        (1, 4, 0, None, True, "stale"),  # test times out
    ]
    recorded = spark.createDataFrame(
        rows, "task_id int, candidate_id int, build_rc int, test_rc int, timed_out boolean, stderr string"
    ).withColumn("code", F.lit("c"))
    found = evaluation.outcomes(recorded).orderBy("candidate_id").collect()
    assert [(r.compiled, r.passed, r.error_log) for r in found] == [
        (True, True, None), (False, False, "build"), (True, False, "test"), (False, False, None), (True, False, None),
    ]
    rates = evaluation.any_of_k(evaluation.task_counts(evaluation.outcomes(recorded)), 5).first()
    assert (rates.k, rates.pass_at_k, rates.compile_at_k) == (5, 1.0, 1.0)
    nested = evaluation.nested_summary(evaluation.outcomes(recorded)).first()
    assert [c.candidate_id for c in nested.candidate_sequences] == [0, 1, 2, 3, 4]
    assert evaluation.wrong_candidate_counts(recorded, 5).isEmpty()


def test_losses_and_stops(spark):
    losses = spark.createDataFrame(
        [("a", 0, 1, 5.0), ("a", 0, 2, 1.0), ("a", 0, 3, 2.0), ("a", 1, 1, 3.0)],
        "dataset string, batch int, target int, loss double",
    )
    found = {r.batch: r.loss for r in evaluation.masked_loss(losses, 1, "batch").collect()}
    assert found == {0: 1.5, 1: 0.0}
    assert evaluation.dataset_loss(losses, 1).first().loss == 0.75
    ids = spark.createDataFrame([([3, 2, 1, 1],), ([3, 2, 4],), ([1, 1],), ([],)], "ids array<int>")
    stops = [r[0] for r in ids.select(evaluation.stop_flag(F.col("ids"), 1, [2])).collect()]
    assert stops[:3] == [True, False, False]


def test_onecycle_ends(spark):
    steps = spark.range(100).select(F.col("id"), metrics.onecycle_rate(F.col("id"), F.lit(100), 11, 0.5).alias("lr"))
    lr = [r.lr for r in steps.orderBy("id").collect()]
    assert lr[0] == pytest.approx(0.02) and lr[10] == pytest.approx(0.5) and lr[99] == pytest.approx(0.0008)
    assert max(lr) == lr[10]


def test_request_stream(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"fileContents": "a b c d", "cursorOffset": 5}) + "\n")
    stream = spark.readStream.schema(src.REQUEST).json(str(tmp_path))
    found = jobs.context_requests(
        stream, lambda r: r.select("request_id", F.split("content", " ").alias("ids")), context=26
    )
    assert [r.context_ids for r in found.collect()] == [["b", "c"]]


def test_sizes_beyond_64_bits(spark, tmp_path):
    from millrace.plans.queries import QUERIES

    rows = [(3, 2), (9_000_000, 899_999), (9_000_000, 900_000), (None, 1)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    found = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("human_bytes", "human_count")}
    assert [(r[0], r[1]) for r in sorted(found["human_bytes"], key=str)] == [
        (3, "18 B"), (9_000_000, "7.2899919E10 TB"), (9_000_000, "7.29E7 TB"), (None, None)
    ]
    assert sorted(str(r[1]) for r in found["human_count"]) == ["18", "72899919000000.0B", "72900000000.0B", "None"]


def test_micro_batches_grow_with_the_corpus():
    from millrace.plans import queries as q

    assert q.shards_per_trigger(0) == q.shards_per_trigger(60_000) == q.SHARDS_PER_TRIGGER
    for documents in (10**5, 10**6, 10**8):
        shards = -(-documents // 64)
        assert -(-shards // q.shards_per_trigger(documents)) <= q.MICRO_BATCHES


def test_stream_total_goes_on_after_a_micro_batch_without_rows(spark, tmp_path):
    path, frame = str(tmp_path / "in"), spark.createDataFrame([(0, 1, "a b")], "shard_id int, doc_id bigint, content string")
    found = []
    for number, rows in enumerate((frame, frame.where("false"), frame.withColumn("shard_id", F.lit(2)))):
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, frame.schema, per_trigger=1)
        encode = lambda d: d.select("shard_id", "doc_id", F.array(F.lit(1), F.lit(2)).alias("ids"))
        ledger, _ = jobs.tokenize_files(stream, encode, str(tmp_path / "out"))
        found.append(sorted(r.running_tokens for r in ledger.collect()))
    assert found == [[2], [2], [2, 4]]
