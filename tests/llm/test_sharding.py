import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from cairnmem.llm import sharding
from cairnmem.llm.queries import QUERIES


def check(rows, texts, shards=8):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def test_even_and_whole(spark, sf_dir, texts):
    rows = QUERIES["op10_sharding"](spark, sf_dir).collect()
    loads = check(rows, texts)
    largest = max(r["size"] for r in rows)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= largest
    where = defaultdict(set)
    for r in rows:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_a_group_larger_than_a_shard(spark):
    texts = [(i, "copy " * 20) for i in range(400)] + [(1000 + i, f"own text {i} " * 8) for i in range(500)] + [(5000 + i, f"twin {i // 2} " * 9) for i in range(100)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    loads = check(rows, texts)
    assert max(loads.values()) - min(loads.values()) <= 250
    where = defaultdict(Counter)
    for r in rows:
        where[r["text_crc32"]][r["shard"]] += 1
    hot = max(where.values(), key=lambda c: sum(c.values()))
    assert len(hot) <= 5  # 400 copies need four shards
    assert sum(len(c) > 1 for c in where.values() if sum(c.values()) == 2) <= 3


def test_pairs_without_other_rows_stay_whole(spark):
    texts = [(i, f"pair {i // 2:05d} " * 5) for i in range(4000)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    loads = check(rows, texts)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 2 * rows[0]["size"]
    where = defaultdict(set)
    for r in rows:
        where[r["text_crc32"]].add(r["shard"])
    assert len(where) == 2000 and all(len(s) == 1 for s in where.values())


def test_one_group_of_all_rows_fills_the_shards(spark):
    from pyspark.sql import functions as F

    texts = [(i, "x" * (i % 50)) for i in range(2000)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4), group=F.lit("all")).collect()
    loads = check(rows, texts)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 100


@pytest.mark.parametrize("sizes", [[3, 3, 1, 1], [4, 2, 2, 1, 1], [2, 2, 2, 2]])
def test_against_all_ways_to_deal(spark, sizes):
    """Groups of equal texts in two shards: as few split, and as even, as the best of all ways to deal the rows."""
    texts = [(10 * g + i, f"group {g} text") for g, n in enumerate(sizes) for i in range(n)]
    size, group = len(texts[0][1]) + 1, [i // 10 for i, _ in texts]

    def cost(shards):
        of = defaultdict(set)
        for g, s in zip(group, shards, strict=True):
            of[g].add(s)
        return abs(2 * sum(shards) - len(shards)) * size, sum(len(s) > 1 for s in of.values())

    best = min(cost(s) for s in product((0, 1), repeat=len(texts)))
    rows = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(texts, "doc_id bigint, text string"), shards=2).collect()}
    uneven, split = cost([rows[i] for i, _ in texts])
    assert best[1] == 0 and split == 0 and uneven <= best[0] + 2 * size


def test_odd_rows(odd):
    check(sharding.shard(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty(empty):
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("by", [(), ("k",)])
def test_running_sum(spark, by):
    from pyspark.sql import functions as F

    df = spark.range(5000, numPartitions=3).select(F.monotonically_increasing_id().alias("row"), (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"))
    seen = Counter()
    for r in sorted(sharding.running_sum(df, F.col("v"), by, "at").collect(), key=lambda r: r["row"]):
        key = r["k"] if by else 0
        assert r["at"] == seen[key]
        seen[key] += r["v"]
