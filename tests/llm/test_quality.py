import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairnmem.llm import quality
from cairnmem.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op9_quality_classifier"](spark, sf_dir).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for p, q, _ in held]) > 0.93
    ones, zeros = ([s for _, q, s in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.95


def test_held_out_labels_teach_nothing(spark, sf_dir, documents):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.scores(documents, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9)


def test_chunks_do_not_matter(texts):
    import pyarrow as pa

    column = pa.array([t for _, t in texts] + [None, "", " \n"])
    whole = quality.statistics(column)
    parts = np.concatenate([quality.statistics(column.slice(i, 7)) for i in range(0, len(column), 7)])
    assert np.array_equal(whole, parts) and np.isfinite(whole).all()


def test_isotonic():
    x, y = quality.isotonic(np.arange(4.0), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_against_brute_force(spark, sf_dir, documents, texts):
    """The whole model in plain numpy: one matrix of all rows, and isotonic values as the largest of the
    least means over all runs around a place."""
    x = {i: quality.statistics(pa.array([t]))[0].astype(float) for i, t in texts}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["doc_id"] in x and r["quality"] in (0, 1)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    fitting, holding = ([(x[i], y) for i, y in labels if fold(i) in folds] for folds in ((1, 2, 3), (4,)))
    rows, d = np.array([v for v, _ in fitting]), len(x[texts[0][0]])
    mean, scale = rows.mean(axis=0), np.sqrt(np.maximum((rows**2).mean(axis=0) - rows.mean(axis=0) ** 2, 1e-6))
    rng = np.random.default_rng(quality.SEED)
    directions, phases = rng.normal(size=(d, quality.FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    features = lambda v: np.append(1.0, np.cos(np.clip((v - mean) / scale, -8, 8) @ directions + phases) * np.sqrt(2 / quality.FEATURES))
    z, y = np.array([features(v) for v in rows]), np.array([y for _, y in fitting], float)
    penalty = np.full(quality.FEATURES + 1, np.sqrt(quality.RIDGE * len(y) / quality.FEATURES))
    penalty[0] = np.sqrt(1e-9)
    w = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(y, np.zeros(len(penalty))), rcond=None)[0]
    bins = sorted((int(np.clip((features(v) @ w + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1)), y) for v, y in holding)
    n = len(bins)
    means = np.array([[np.mean([y for _, y in bins[a : b + 1]]) if b >= a else np.nan for b in range(n)] for a in range(n)])
    first, last = ([k(j for j in range(n) if bins[j][0] == bins[i][0]) for i in range(n)] for k in (min, max))
    fitted = [max(min(means[a][b] for b in range(last[i], n) if last[b] == b) for a in range(i + 1) if first[a] == a) for i in range(n)]
    pools = sorted({round(f, 9) for f in fitted})
    knots = [np.mean([(b + 0.5) / quality.BINS * 2 - 0.5 for (b, _), f in zip(bins, fitted, strict=True) if round(f, 9) == p]) for p in pools]
    values = (np.array(pools) * n + 0.5 * np.mean(pools)) / (n + 0.5)
    found = {r["doc_id"]: r["score"] for r in quality.scores(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    for i, v in x.items():
        assert found[i] == pytest.approx(np.interp(features(v) @ w, knots, values), abs=1e-4)


def test_odd_rows_and_labels(spark, odd, empty):
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (99, 1), (3, None), (7, 1), (8, 0), (9, 0), (11, 1)], "doc_id bigint, quality int")
    rows = quality.scores(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert quality.scores(empty, some).count() == 0
    assert {r["score"] for r in quality.scores(odd, some.where("false")).collect()} == {1.0}
    kept = quality.keep_good(odd, some)
    assert kept.columns == odd.columns
