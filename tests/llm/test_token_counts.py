import numpy as np
import pytest

from cairnmem.llm import token_counts, tokens
from cairnmem.llm.queries import QUERIES
from cairnmem.llm.staging import Stage


def test_against_counts(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, sf_dir).collect()}
    assert {i: rows[i]["n_tokens"] for i, _ in texts} == {i: len(tokens.encode(t, special=False)) for i, t in texts}
    assert all(r["ended"] for r in rows.values())


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_of_any_size(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN_BLOCKS", 4)
    rng = np.random.default_rng(block)
    files = {f: rng.integers(0, 4, 60).astype("<u2") for f in range(3)} | {3: np.zeros(20, "<u2"), 4: np.full(5, 3, "<u2")}
    rows = [(f, k // block, ids[k : k + block].tobytes()) for f, ids in files.items() for k in range(0, len(ids), block)]
    df = spark.createDataFrame(rows, "file bigint, block bigint, data binary").repartition(3)
    found = sorted(tuple(r) for r in token_counts.count_tokens(df, end_id=0).collect())
    expected = []
    for f, ids in files.items():
        at = 0
        for n, e in enumerate([*np.flatnonzero(ids == 0).tolist(), len(ids)]):
            if e < len(ids) or e > at:
                expected.append((f, n, at, e - at, e < len(ids)))
            at = e + 1
    assert found == sorted(expected)


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}", block_tokens=2)
    found = sorted((r["start"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(blocks, 9).collect())
    assert found == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 1, False)]


def test_a_flat_file_over_2_gb(spark, tmp_path):
    with open(tmp_path / "a.bin", "wb") as f:
        f.truncate((1 << 31) + 10)
        f.seek(1 << 31)
        f.write(np.array([5, 9, 6], "<u2").tobytes())
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}", block_tokens=1 << 22)
    found = sorted((r["start"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(blocks, 9).collect())
    assert found == [(0, (1 << 30) + 1, True), ((1 << 30) + 2, 3, False)]


def test_special_text_cannot_end_a_document(odd):
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_token_counts(odd).collect()}
    assert len(rows) == len({r["doc_id"] for r in odd.collect()}) and rows[3] == rows[4] == 0
    assert rows[11] == len(tokens.encode([r["text"] for r in odd.collect() if r["doc_id"] == 11][0], special=False))


def test_empty(spark, empty):
    assert token_counts.document_token_counts(empty).count() == 0
    assert token_counts.count_tokens(spark.createDataFrame([], "file bigint, block bigint, data binary"), stage=Stage(spark, "t")).count() == 0
