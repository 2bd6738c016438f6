import numpy as np
import pytest

from cairnmem.llm import exact_dedup, jaccard_join, lm_score, packing, quality, sharding, substring_dedup, token_counts


@pytest.fixture(scope="module")
def long(spark):
    """Two texts of 300,000 words that differ in a hundredth of them, an exact copy, and a short one."""
    words = [f"w{k}" for k in np.random.default_rng(5).integers(0, 60_000, 300_000)]
    other = [w if k % 1000 else "edit" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "\n".join(words)), (4, "short one"), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_copies(long):
    assert {i: r["keep_id"] for i, r in by_id(exact_dedup.classes(long)).items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_near_copies(long):
    assert {i: r["component_id"] for i, r in by_id(jaccard_join.near_copies(long)).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_substrings(long):
    found = by_id(substring_dedup.remove_repeats(long, with_text=False))
    assert found[1]["n_removed"] == found[1]["n_words"] == 300_000 == found[3]["n_removed"] and found[4]["n_removed"] == 0
    assert found[2]["n_removed"] == 300_000 - 300


def test_scores_sizes_and_pieces(long):
    scores = by_id(lm_score.scores(long))
    assert scores[1]["n_tokens"] == 300_001 and scores[1]["score"] == pytest.approx(scores[3]["score"])
    labels = long.sparkSession.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.scores(long, labels).collect())
    pieces = packing.pack(long, with_ids=False).where("doc_id = 1").collect()
    tokens = by_id(token_counts.document_token_counts(long))
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] == tokens[1]["n_tokens"] + 1
    assert by_id(sharding.shard(long))[1]["size"] == by_id(sharding.shard(long))[3]["size"]
