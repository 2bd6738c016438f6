import numpy as np
import pyarrow as pa

from cairnmem.llm import chunks, words


def test_many_empty_rows_make_many_chunks():
    batch = pa.record_batch({"text": pa.array([""] * 70_000 + [None] * 30_000, pa.string())})
    sizes = [t.num_rows for t in words.text_chunks(iter([batch] * 25), most=1 << 18)]
    assert sum(sizes) == 2_500_000 and max(sizes) == 1 << 18 and len(sizes) == 10


def test_rows_of_a_chunk_are_within_what_its_numbers_hold():
    assert words.CHUNK_ROWS <= 1 << 24


def test_buckets_nest():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 10_000, dtype=np.uint64) * np.uint64(2))
    for coarse, times in ((1, 5), (7, 3), (300, 11)):
        fine = chunks.bucket_of(keys, coarse * times)
        assert (fine // np.uint64(times) == chunks.bucket_of(keys, coarse)).all() and (np.diff(fine.astype(np.int64)) >= 0).all()


def test_a_plan_bounds_what_a_task_brings_together(spark):
    some = spark.createDataFrame([(i, 1000) for i in range(50)], "chunk bigint, n_words bigint")
    flat, deep = chunks.plan(some), chunks.plan(some, fan_in=8)
    assert flat.groups == 1 and flat.sent == flat.buckets
    assert deep.groups == 7 and deep.buckets % deep.sent == 0 and deep.buckets >= flat.buckets
