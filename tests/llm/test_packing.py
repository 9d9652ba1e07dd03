"""Packing operators, the pipeline and the entry."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import binpack, localpack
from millrace.llm.tokens import ChunkEncoder, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
DOC = "doc_id bigint, text string, piece int, length int, ids string"
ROWS = [(1, None), (2, ""), (None, "Hello, wörld's <|endoftext|> 12!"), (3, "long words " * 9000), (3, "long words " * 9000), (4, "tie"), (5, "tie")]


def docs_of(spark):
    return spark.createDataFrame([(*r, 0, 0, "") for r in ROWS], DOC)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_chunk_encoder_equals_the_library(texts):
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    got = ENCODER.encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == expected


ENCODER = ChunkEncoder(tokenizer_path())


def test_search_tree_and_best_fit():
    rng = np.random.default_rng(1)
    tree, rooms = binpack.CapacityTree(100), []
    for _ in range(300):
        room = int(rng.integers(0, 101))
        tree.add(room, 1)
        rooms.append(room)
        if len(rooms) > 20:
            gone = rooms.pop(int(rng.integers(len(rooms))))
            tree.add(gone, -1)
        need = int(rng.integers(0, 101))
        assert tree.smallest(need) == min((r for r in rooms if r >= need), default=-1)
    lengths = rng.integers(1, 101, 400)
    for bins in (localpack.best_fit(lengths, 100), localpack.pack(lengths, 100)):
        assert np.bincount(bins, weights=lengths).max() <= 100
    listed = binpack.best_fit_decreasing(lengths.tolist(), 100)
    assert sorted(i for b in listed for i in b) == list(range(400))
    assert len(listed) == len(set(localpack.best_fit(lengths, 100).tolist()))


def test_local_search_empties_bins():
    """Best fit decreasing needs five bins here, exchanges find the four."""
    lengths = np.array([4, 4, 8, 6, 4, 7, 7, 5, 9, 4])
    capacity = 15
    assert len(set(localpack.best_fit(lengths, capacity).tolist())) == 5
    search = localpack.LocalSearch(lengths, localpack.best_fit(lengths, capacity), capacity)
    before = np.sort(capacity - search.room)
    bins = search.run()
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= capacity and (fill**2).sum() >= (before.astype(float) ** 2).sum()
    assert len(set(bins.tolist())) == 4
    assert localpack.fewest_bins(lengths, capacity) == 4


def test_packed_pieces_are_whole_and_gapless(spark):
    got = localpack.pack_documents(docs_of(spark), capacity=512).collect()
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for key, text in ROWS:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], dtype="<u4")
            pieces.setdefault((key, n, at, len(part), zlib.crc32(part.tobytes())), []).append(1)
    seen = {}
    for r in got:
        seen.setdefault(tuple(r)[:5], []).append(1)
    assert seen == pieces
    rows = {}
    for r in got:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert localpack.pack_documents(docs_of(spark).limit(0)).count() == 0


def test_binary_rows_round_trip(spark, tmp_path):
    packed = binpack.packed_rows(docs_of(spark), capacity=256, block_tokens=4000)
    binpack.write_packed(packed, str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    for r in packed.collect():
        positions = np.frombuffer(r["position_ids"], dtype="<u4")
        assert len(r["ids"]) == 4 * 256 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert (positions[a:b] == np.arange(b - a)).all()
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    found = {}
    for r in binpack.unpack(packed).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for key, text in dict(ROWS).items():
        copies = sum(k == key for k, _ in ROWS)
        ids = [i for _, part in sorted(found[key])[::copies] for i in part]
        assert ids == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
    assert binpack.packed_rows(docs_of(spark).limit(0)).count() == 0


def test_pipeline_decisions(spark, small):
    import corpus_pipeline
    from millrace.llm import decontam, pii, simhash, toxicity
    from millrace.llm.common import table
    from millrace.session import materialise

    docs = table(spark, small, "documents")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, materialise(stage(spark, now, small), f"test-{name}")
        assert now.columns == columns
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.fit(before, table(spark, small, "labels")))
            expected = {r["doc_id"] for r in scored.where("predicted = 0").collect()}
        elif name == "near_dedup":
            expected = {r["doc_id"] for r in simhash.near_duplicates(before).where("doc_id = component_id").collect()}
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontam.contaminated(before, table(spark, small, "benchmark")).collect()}
            expected = {r["doc_id"] for r in before.collect()} - hit
        else:
            expected = {r["doc_id"] for r in before.collect()}
            masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()}
            assert masked == {r["doc_id"]: (pii.masked(r["text"]), len(pii.masked(r["text"]))) for r in before.collect()}
        assert {r["doc_id"] for r in now.collect()} == expected
    packed = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in packed.collect()} == expected


def test_entry_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "millrace", "bench.py"):
        if name != "millrace":
            (tmp_path / name).symlink_to(root / name)
    (tmp_path / "millrace").mkdir()
    for part in (root / "millrace").iterdir():
        if part.name != "llm":
            (tmp_path / "millrace" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bpe_train' in q and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
