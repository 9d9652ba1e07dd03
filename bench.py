"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma-separated)
another choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.queries import QUERIES
from millrace.session import local_session

HEADLINE = (
    "corpus_scan write_row_shards token_summary doc_token_counts flatten_tokens window_strict "
    "window_padded shuffle_global shuffle_buffered split_exact batch_assign go_lex "
    "token_kind_histogram pretok_metaspace word_freq bpe_top_pairs bpe_train bpe_encode bpe_decode "
    "bpe_train_lexed go_encode go_decode training_windows masked_loss pass_at_k weighted_mean "
    "tokens_ingested rolling_mean metric_series step_elapsed_ms checkpoint_policy top_ops "
    "stream_tokenize_files stream_weighted_mean stream_checkpoint_policy"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
