"""Operators on state that queries do not reach: errors, edges, recall of the approximate search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmem.functions import extraction, vectors
from cairnmem.operators import claims, cognition, graph, lifecycle, oplog, vector_index
from cairnmem.runtime import first_rows
from cairnmem.sources import tables


def test_the_default_search_finds_nine_tenths(spark, sf_dir, tmp_path):
    m = tables.memories(spark, sf_dir).where("embedding is not null")
    path = f"file://{tmp_path}/index"
    vector_index.build(m, path)
    v = {r["rid"]: np.array(r["embedding"]) for r in m.select("rid", "embedding").collect()}
    ids, all_ = list(v), np.array([x / np.linalg.norm(x) for x in v.values()])
    hits = asked = 0
    for rid in ids[::50]:
        q = v[rid] / np.linalg.norm(v[rid])
        best = {ids[i] for i in np.argsort(-(all_ @ q))[:10]}
        hits += len(best & {r["rid"] for r in vector_index.search(spark, path, q).collect()})
        asked += 10
    assert hits / asked >= 0.9


def test_exact_search_sees_vectors_of_no_direction(spark, tmp_path):
    rows = [(f"m{i}", np.random.default_rng(i).normal(size=4).tolist()) for i in range(60)] + [("zero", [0.0] * 4), ("none", None)]
    m = spark.createDataFrame(rows, "rid string, embedding array<double>")
    path = f"file://{tmp_path}/index"
    vector_index.build(m, path, cells=9)
    q = [1.0, -0.5, 0.2, 0.1]
    s = vectors.cosine_with(F.col("embedding"), q)
    expected = [r["rid"] for r in m.where("embedding is not null").orderBy(F.desc(s), "rid").collect()]
    for k in (1, 5, 61, 100):
        assert [r["rid"] for r in vector_index.search(spark, path, q, k, probes=1, exact=True).collect()] == expected[:k]
    with pytest.raises(ValueError):
        vector_index.build(m.where("rid = 'none'"), path)


@pytest.mark.parametrize("n", [0, 1, 17, 100, 500])
def test_first_rows_are_those_of_a_sort(spark, n):
    df = spark.range(100, numPartitions=7).withColumn("x", F.col("id") % 3)
    assert sorted(tuple(r) for r in first_rows(df, n, "x", "id").collect()) == sorted(sorted(((i, i % 3) for i in range(100)), key=lambda r: (r[1], r[0]))[:n])


def test_pairs_within_reach_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), float(rng.integers(0, 50))) for i in range(120)] + [(900, None, 1.0), (901, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, at double")
    at = {i: t for i, _, t in rows}
    every = {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(df.where("at is not null"), "id", "v", 0.7).collect()}
    for block in (4096, 5):
        near = {(r["id_a"], r["id_b"]) for r in vectors.similar_pairs(df, "id", "v", 0.7, block, within=("at", 7.0)).collect()}
        assert near == {(a, b) for a, b in every if abs(at[a] - at[b]) <= 7.0}


def test_batches_and_records_that_are_refused(spark):
    new = spark.createDataFrame([(1, "a", "x"), (2, "a", None)], "seq bigint, namespace string, text string")
    quotas = spark.createDataFrame([("a", 1)], "namespace string, max_memories bigint")
    taken, refused = lifecycle.admit(new, new.where("false"), quotas)
    assert [r["seq"] for r in taken.collect()] == [1] and refused.first()["refused"] == 1
    with pytest.raises(ValueError):
        lifecycle.admit(new, new, quotas, most=1)
    assert lifecycle.record(new, 0.0).count() == 1
    with pytest.raises(Exception, match="no text"):
        lifecycle.record(new, 0.0, strict=True).collect()


def test_lag_of_peers_ahead_behind_and_without_a_log(spark):
    log = spark.createDataFrame([(10 * i, f"o{i}") for i in range(50)], "hlc bigint, op_id string")
    peers = spark.createDataFrame([("new", -5, ""), ("mid", 250, "o25"), ("tie", 250, "a"), ("done", 490, "o49"), ("ahead", 9999, "z")], "peer string, hlc bigint, op_id string")
    assert {r["peer"]: r["behind"] for r in oplog.lag(log, peers).collect()} == {"new": 50, "mid": 24, "tie": 25}
    assert oplog.lag(log.where("false"), peers).count() == 0


def test_entities_of_a_question_and_components_that_do_not_settle(spark):
    names = spark.createDataFrame([("Acme Corp",), ("Corp",), ("Zed",), (None,)], "name string")
    assert graph.seeds_of("Who leads Acme Corp?", names) == ["Acme Corp", "Corp"] and graph.seeds_of(" ?", names) == []
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    with pytest.raises(RuntimeError):
        cognition.connected(links, rounds=1)


def test_cues_of_two_words(spark):
    texts = spark.createDataFrame([("a", "according to some, Ann Lee leads Acme"), ("b", "Ann Lee leads Acme")], "rid string, text string")
    assert {r["id"]: r["modality"] for r in extraction.extract(texts).collect()} == {"a": "reported", "b": "asserted"}


def test_conflicted_claims_are_those_of_the_pairs(spark, sf_dir):
    c, a, p = tables.claims(spark, sf_dir), tables.aliases(spark), tables.policies(spark)
    pairs = claims.scoped_conflicts(c, a, p).select(F.explode(F.array("claim_id_a", "claim_id_b")).alias("i")).distinct()
    assert {r["claim_id"] for r in claims.conflicted(c, a, p).collect()} == {r["i"] for r in pairs.collect()}
