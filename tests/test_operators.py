"""Claims, graph, cognition, lifecycle and log on small frames."""

import random

import pytest
from pyspark.sql import functions as F
from test_recall import NOW, memory

from cairnmem.functions import extraction
from cairnmem.operators import claims as c
from cairnmem.operators import cognition as g
from cairnmem.operators import graph, lifecycle, oplog
from cairnmem.schema import MEMORY


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[k] for k in rows[0]) for r in rows], MEMORY)


CLAIM = "claim_id bigint, namespace string, src string, rel_type string, dst string, polarity int, modality string, valid_from double, valid_to double, extractor string, confidence_band string, source_memory_rid string"


def claim(i, polarity=1, begin=None, end=None, who="w", band="medium", dst="bar", src="dan", ns="n", modality="asserted"):
    return (i, ns, src, "was_at", dst, polarity, modality, begin, end, who, band, f"m{i}")


def claims(spark, *rows):
    return spark.createDataFrame(rows, CLAIM)


def test_polarity_pairs_are_all_pairs(spark):
    df = claims(spark, claim(1), claim(2), claim(3, -1), claim(4, 0), claim(5, -1, dst="inn"))
    assert sorted((r["claim_id_pos"], r["claim_id_neg"]) for r in c.polarity_contradictions(df).collect()) == [(1, 3), (2, 3)]


def test_temporal_pairs(spark):
    df = claims(spark, claim(1, begin=0.0, end=1000.0), claim(2, begin=1000.0, end=5000.0), claim(3, begin=900.0, end=1800.0), claim(4, begin=0.0), claim(5, begin=6000.0, end=9000.0))
    found = {(r["claim_id_a"], r["claim_id_b"]) for r in c.temporal_contradictions(df).collect()}
    assert found == {(1, 2), (2, 3)}  # touching windows meet; 1 and 3 end 800 s apart; 4 is open; 5 is apart


def test_as_of_is_half_open(spark):
    df = claims(spark, claim(1, begin=0.0, end=10.0), claim(2, begin=10.0), claim(3, end=20.0))
    assert [r["claim_id"] for r in c.as_of(df, 10.0).collect()] == [2]
    assert [r["claim_id"] for r in c.known_by(df, 10.0).orderBy("claim_id").collect()] == [1, 2]


def test_one_winner_a_key(spark):
    df = claims(spark, claim(1, 1, 0.0, None, band="low"), claim(2, -1, 0.0, None, band="high"), claim(3, 1, 0.0, 5.0, band="high"))
    assert [(r["verdict"], r["claim_id"]) for r in c.reconcile(df, 6.0).collect()] == [("NO", 2)]
    assert [(r["verdict"], r["claim_id"]) for r in c.reconcile(df, 1.0).collect()] == [("YES", 3)]
    assert c.reconcile(df, -1.0).count() == 0


def test_scoped_conflicts(spark):
    policies = spark.createDataFrame([("was_at", "*", False, "low"), ("was_at", "free", True, "low")], "rel_type string, namespace string, overlap_allowed boolean, missing_time_severity string")
    aliases = spark.createDataFrame([("the bar", "bar", "*")], "alias string, canonical_name string, namespace string")
    df = claims(
        spark, claim(1, begin=0.0, end=9.0), claim(2, begin=5.0, end=20.0, dst="inn"), claim(3, begin=30.0, end=40.0, dst="zoo"), claim(4, dst="the bar"),
        claim(5, dst="pub", modality="quoted"), claim(6, ns="free"), claim(7, dst="inn", ns="free"),
    )
    found = {(r["claim_id_a"], r["claim_id_b"]): (r["severity"], r["reason_codes"][1]) for r in c.scoped_conflicts(df, aliases, policies).collect()}
    assert found[1, 2] == ("high", "overlapping_validity_windows")
    assert (1, 3) not in found and (1, 4) not in found  # apart in time; the same object by another name
    assert found[2, 4] == ("low", "missing_temporal_qualifier")
    assert not {5, 6, 7} & {x for pair in found for x in pair}


def test_ingest_checks(spark):
    new = spark.createDataFrame([("a", "b", "knows", None, None), ("", "b", "knows", None, None), ("a", "b", "Bad Name", None, None), ("a", "b", "knows", 5.0, 1.0)], "src string, dst string, rel_type string, valid_from double, valid_to double")
    good, bad = c.ingest(new)
    assert good.count() == 1 and good.first()["modality"] == "asserted"
    assert sorted(r["reason"] for r in bad.collect()) == ["rel_type is not a name", "src is empty", "valid_from is after valid_to"]


def test_extraction(spark):
    texts = spark.createDataFrame([("t", "Ann Lee is not married to Bo; Zed Corp acquired Yam. Ann Lee allegedly founded Zed Corp"), ("n", None), ("e", "")], "rid string, text string")
    found = {(r["src"], r["rel_type"], r["dst"]): (r["polarity"], r["modality"]) for r in extraction.extract(texts).collect()}
    assert found == {("Ann Lee", "married_to", "Bo"): (-1, "asserted"), ("Zed Corp", "acquired", "Yam"): (1, "asserted"), ("Ann Lee", "founded", "Zed Corp"): (1, "reported")}


def test_edges_last_writer_wins(spark):
    log = spark.createDataFrame([("a", "b", "r", 1.0, 1.0, 1), ("a", "b", "r", 3.0, 2.0, 1), ("a", "b", "r", 2.0, 2.0, 0)], "src string, dst string, rel_type string, weight double, at double, nth int")
    assert [r["weight"] for r in graph.last_edges(log).collect()] == [3.0]


def test_reachable_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    rows = graph.reachable(edges, spark.createDataFrame([("a",)], "entity string"), 9).collect()
    assert {(r["entity"], r["depth"]) for r in rows} == {("a", 0), ("b", 1), ("c", 2)}


def test_hubs_need_five(spark):
    edges = spark.createDataFrame([("hub", f"x{i}", "r", 1.0) for i in range(6)], "src string, dst string, rel_type string, weight double")
    assert [(r["entity"], r["degree"]) for r in graph.hubs(edges).collect()] == [("hub", 6)]


def test_link_by_name(spark):
    texts = spark.createDataFrame([("1", "Met Ann Lee at the bank."), ("2", "annex"), ("3", None)], "rid string, text string")
    names = spark.createDataFrame([("Ann Lee",), ("Ann",), ("bank",)], "name string")
    assert {(r["id"], r["name"]) for r in graph.link_by_name(texts, names).collect()} == {("1", "Ann Lee"), ("1", "Ann"), ("1", "bank")}


def test_decay_and_triggers(spark):
    old = NOW - 40 * 604800.0
    df = frame(spark, [memory("new", 1, importance=0.9), memory("old", 1, importance=0.9, last_access=old), memory("dull", 1, importance=0.1, last_access=old)])
    assert {r["rid"] for r in g.faded(df, NOW).collect()} == {"old", "dull"}
    t = g.decay_triggers(df, NOW).collect()
    assert [x["source_rids"] for x in t] == [["old"]] and 0 < t[0]["urgency"] <= 0.9
    many = frame(spark, [memory(f"m{i}", None) for i in range(10)])
    assert g.consolidation_triggers(many).count() == 1 and g.consolidation_triggers(many.limit(9)).count() == 0


def test_trigger_states(spark):
    triggers = spark.createDataFrame([(1, "pending", NOW), (2, "dismissed", NOW), (3, "delivered", NOW - 200000)], "trigger_id int, status string, created_at double")
    events = spark.createDataFrame([(1, "delivered"), (2, "acted")], "trigger_id int, `to` string")
    assert {r["trigger_id"]: (r["status"], r["accepted"]) for r in g.step_triggers(triggers, events, NOW).collect()} == {1: ("delivered", True), 2: ("dismissed", False), 3: ("expired", False)}


def test_consolidation(spark):
    df = frame(spark, [memory("a", 1, importance=0.9), memory("b", 1, importance=0.4), memory("far", 1, created_at=NOW - 1e8), memory("other", 4)])
    found = g.clusters(df, 0.9)
    assert {(r["cluster"], r["rid"]) for r in found.collect()} == {("a", "a"), ("a", "b")}
    new = g.consolidate(found, df).first()
    assert new["importance"] == pytest.approx(0.99) and new["summary"] == "text a | text b" and new["consolidated_from"] == ["a", "b"]
    after = {r["rid"]: r for r in g.after_consolidation(found, df).collect()}
    assert after["a"]["consolidation_status"] == "consolidated" and after["b"]["importance"] == pytest.approx(0.12) and after["far"]["consolidation_status"] == "active"


def test_connected_is_the_smallest_reachable(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = g.connected(spark.createDataFrame(links, "a int, b int")).collect()
    assert {r["id"]: r["root"] for r in rows} == {x: find(x) for x in parent}


def test_weights_learn_only_from_enough(spark):
    weights = {"similarity": 0.5, "decay": 0.2, "recency": 0.3}
    rows = [(True, 1.0, 0.0, 0.0)] * 30
    schema = "relevant boolean, similarity double, decay double, recency double"
    new = {r["signal"]: r["weight"] for r in g.learn_weights(spark.createDataFrame(rows, schema), weights).collect()}
    assert sum(new.values()) == pytest.approx(1) and new["similarity"] > 0.5
    few = {r["signal"]: r["weight"] for r in g.learn_weights(spark.createDataFrame(rows[:5], schema), weights).collect()}
    assert few == pytest.approx(weights)


def test_forget_correct_evict(spark):
    df = frame(spark, [memory("a", 1), memory("b", 2, importance=0.1), memory("t", 3, consolidation_status="tombstoned")])
    one = spark.createDataFrame([("a", "new words"), ("t", "x"), ("nobody", "y")], "rid string, text string")
    after = {r["rid"]: r for r in lifecycle.correct(df, one, NOW).collect()}
    assert after["a"]["consolidation_status"] == "tombstoned" and after["a-corrected"]["text"] == "new words" and "t-corrected" not in after and len(after) == 4
    assert [r["rid"] for r in lifecycle.evict(df, NOW, 1).collect()] == ["b"]
    assert lifecycle.evict(df, NOW, 5).count() == 0
    assert lifecycle.get(df, "t").count() == 1 and lifecycle.get(df, "zzz").count() == 0


def test_record(spark):
    new = spark.createDataFrame([(1, "hello", None), (2, None, 0.9)], "seq int, text string, importance double")
    rows = lifecycle.record(new, NOW).collect()
    assert len(rows) == 1 and rows[0]["importance"] == 0.5 and rows[0]["half_life"] == 604800.0 and len(rows[0]["rid"]) == 34


def test_budget_ends_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 2, 9), ("c", 3, 1)], "g string, n int, size int")
    assert [r["n"] for r in lifecycle.within_budget(df, "g", ["n"], F.col("size"), 10).collect()] == [1]


def test_fold_in_any_order_and_twice(spark):
    rng = random.Random(1)
    ops = [(f"op{i}", rng.choice(["record", "update", "forget"]), rng.randrange(5), f"m{rng.randrange(4)}", "d", float(i)) for i in range(40)]
    schema = "op_id string, op_type string, hlc bigint, target_rid string, origin_actor string, importance double"
    results = []
    for _ in range(3):
        rng.shuffle(ops)
        results.append(sorted(map(tuple, oplog.fold(spark.createDataFrame(ops + ops[:10], schema)).collect()), key=str))
    assert results[0] == results[1] == results[2]


def test_log_pages_and_application(spark):
    log = spark.createDataFrame([(f"op{i}", i // 2, "a" if i % 2 else "b") for i in range(10)], "op_id string, hlc bigint, origin_actor string")
    assert [r["op_id"] for r in oplog.since(log, 1, "op2", limit=3).collect()] == ["op3", "op4", "op5"]
    assert [r["op_id"] for r in oplog.since(log, 1, "op2", "a", 2).collect()] == ["op4", "op6"]
    after, counts = oplog.apply(log.where("hlc < 3"), log.unionByName(log.limit(2)))
    assert after.count() == 10 and tuple(counts.first()) == (4, 8)
    again, counts = oplog.apply(after, log)
    assert again.count() == 10 and counts.first()["applied"] == 0
