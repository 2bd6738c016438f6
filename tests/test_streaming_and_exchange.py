"""Streams against their batch forms; export, import, snapshots, encryption."""

import pytest
from pyspark.sql import functions as F

from cairnmem.sources import exchange, synthetic, tables, tenants
from cairnmem.streaming import events as streams
from cairnmem.streaming import schedule


@pytest.fixture(scope="module")
def event_files(spark, sf_dir, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('events')}/in"
    tables.table(spark, sf_dir, "events").repartition(3).write.parquet(path)
    return path


def test_closed_windows_equal_batch(spark, event_files, tmp_path):
    batch = spark.read.schema(streams.EVENT_SCHEMA).parquet(event_files).withColumn("at", F.col("ts").cast("timestamp"))
    whole = {tuple(r) for r in streams.tumbling(batch).withColumn("total", F.round("total", 4)).collect()}
    out = streams.run(streams.tumbling(streams.read(spark, event_files)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    closed = {tuple(r) for r in out.withColumn("total", F.round("total", 4)).collect()}
    assert closed <= whole and len(whole) - len(closed) <= 10


def test_session_windows(spark, event_files, tmp_path):
    batch = spark.read.schema(streams.EVENT_SCHEMA).parquet(event_files).withColumn("at", F.col("ts").cast("timestamp"))
    whole = {tuple(r) for r in streams.sessions(batch).collect()}
    out = streams.run(streams.sessions(streams.read(spark, event_files)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert {tuple(r) for r in out.collect()} <= whole


def test_each_event_once(spark, sf_dir, tmp_path):
    e = tables.table(spark, sf_dir, "events")
    e.unionByName(e.limit(50)).write.parquet(f"file://{tmp_path}/in")
    out = streams.run(streams.once(streams.read(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert out.count() == e.count()


def test_operations_are_applied_once(spark, sf_dir, tmp_path):
    log = tables.oplog(spark, sf_dir)
    log.write.parquet(f"file://{tmp_path}/in/a")
    log.limit(20).write.parquet(f"file://{tmp_path}/in/b")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    streams.apply_batches(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == log.count()


def test_stateful_fold_equals_batch(spark, sf_dir, tmp_path):
    from cairnmem.operators import oplog

    log = tables.oplog(spark, sf_dir).limit(200)
    log.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in")
    q = streams.fold(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    found = {r["target"]: (r["importance"], r["n_writes"], r["last_hlc"], r["tombstoned"]) for r in spark.table("folded").collect()}
    saved = spark.read.parquet(f"file://{tmp_path}/in")
    expected = {r["target_rid"]: (r["importance"], r["n_writes"], r["last_hlc"], r["tombstoned"]) for r in oplog.fold(saved).collect()}
    assert found == expected


def test_json_export_and_import(spark, sf_dir, tmp_path):
    m = tables.memories(spark, sf_dir).select("rid", "text", "importance", "consolidation_status")
    exchange.export_json({"memories": m}, f"file://{tmp_path}/x")
    schema = "rid string, text string, importance double, consolidation_status string"
    empty = spark.createDataFrame([], schema)
    back = exchange.import_json(spark, f"file://{tmp_path}/x/memories", schema, empty, ["rid"])
    assert back.count() == m.where("consolidation_status <> 'tombstoned'").count()
    with pytest.raises(ValueError):
        exchange.import_json(spark, f"file://{tmp_path}/x/memories", schema, back, ["rid"])
    assert exchange.import_json(spark, f"file://{tmp_path}/x/memories", schema, back, ["rid"], merge=True).count() == back.count()


def test_jsonl_skips_broken_lines(spark):
    lines = spark.createDataFrame([('{"type":"memory","rid":"a"}',), ("{broken",), ('{"type":"edge","rid":"b"}',), (None,)], "value string")
    assert [r["rid"] for r in exchange.from_jsonl(lines, "memory", "rid string").collect()] == ["a"]


def test_snapshot_manifest_ignores_order(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    one = exchange.snapshot({"t": df}, f"file://{tmp_path}", 1).first()
    two = exchange.snapshot({"t": df.orderBy(F.desc("id")).repartition(3)}, f"file://{tmp_path}", 2).first()
    assert one["n_rows"] == 50 and one["checksum"] == two["checksum"] and spark.read.parquet(f"file://{tmp_path}/v2/t").count() == 50


def test_encryption(spark):
    key, other = bytes(32), bytes([1]) * 32
    df = spark.createDataFrame([("secret",), (None,)], "t string").withColumn("e", exchange.encrypted(F.col("t"), key))
    row = df.select("t", "e", exchange.decrypted(F.col("e"), key).alias("ok"), exchange.decrypted(F.col("e"), other).alias("no")).where("t is not null").first()
    assert row["ok"] == "secret" and row["no"] is None and "secret" not in row["e"]
    with pytest.raises(ValueError):
        exchange.encrypted(F.col("t"), b"short")


def test_embedder(spark):
    class Model:
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r["v"] for r in df.select(exchange.embedder(Model)("t").alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_hash_embedding(spark):
    v = spark.createDataFrame([("a b c",), ("",)], "t string").select(exchange.hash_embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-9 and sum(v[1]["v"]) == 0


def test_tenants(spark):
    m = synthetic.life(spark, 30, 1e9)
    for name, n in (("b", 10), ("a", 20)):
        tenants.save(m.limit(n), name, "memories")
    tenants.save(m.limit(5), "a", "memories")
    assert [t for t in tenants.tenants(spark) if t in "ab"] == ["a", "b"]
    assert {r["tenant"]: r["n_rows"] for r in tenants.usage(spark).collect()} == {"a": 25, "b": 10}
    with pytest.raises(ValueError):
        tenants.database("a; DROP")


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a, b = (sorted(map(tuple, synthetic.life(spark, 50, 1e9, partitions=p).collect())) for p in (1, 7))
    assert a == b


def test_schedule():
    assert [schedule.interval(s) for s in (0, 900, 3600)] == [300.0, 900.0, 1800.0]
    assert schedule.due({}, 0.0) == sorted(schedule.WORKERS)
    assert schedule.trigger("sync") == {"processingTime": "500 milliseconds"}
