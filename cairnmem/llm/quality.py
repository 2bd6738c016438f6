"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Each document becomes a vector of statistics of its text (lengths, shares of character classes,
repetition of words and lines).  Random Fourier features approximate a Gaussian kernel over the
standardised statistics.  Every partition sums its own part of the normal equations, the parts are
summed in a fixed number of groups, and the ridge solution scores documents.  A fold of the labelled
rows that the ridge has not seen gives calibrated probabilities by isotonic regression.

What reaches the driver has a size that the parameters fix: the sums of the normal equations, the
means, and the calibration counts of ``BINS`` bins.  All labelled rows outside ``HELD_OUT`` are used.

Labels: rows whose crc32(doc_id as text) mod 5 is 0 are never learned from; remainder 4 calibrates,
the others fit.  A label that is null, or whose doc_id is null or without a document, teaches
nothing; a repeated label counts as often as it stands.  Without any labels of both kinds every score
is the share of 1 among the labels, or 1 without any.

Nulls and ties: a null text counts as empty, and empty texts are scored like any other.  Repeated
rows get equal scores; a null doc_id stays null and counts as not held out.  An empty table gives no
rows.  Language, source and doc_id are never inputs.  Other columns are ignored, or kept by
``keep_good``.  Very long texts are read whole; a text that is longer than a chunk is one of its own.  Raw
scores outside [-0.5, 1.5] fall in the outermost bin of the calibration.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import words
from cairnmem.llm.staging import Stage

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
FEATURES = 384
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.3
SEED = 20240501
#: Groups in which the partitions' normal equations are summed.
SUM_GROUPS = 16

#: Character classes whose shares of a text's bytes are statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"#$%&*+=@^~_\\/", b"|<>{}[]", b"\n", b" \t", bytes(range(128, 256)))


def statistics(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of document statistics for each text, as float32."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    if not rows:
        return np.empty((0, len(CLASSES) + 14), np.float32)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin : begin + ends[-1]]
    bytes_ = np.maximum(size, 1)

    # Classes are counted in one pass: each has its own 8-bit lane of a sum over short runs.
    lanes = np.zeros(256, np.uint64)
    for k, chars in enumerate(CLASSES):
        lanes[list(chars)] |= np.uint64(1 << 8 * k)
    cuts = np.unique(np.concatenate([np.arange(0, len(raw), 255), ends[:-1][ends[:-1] < len(raw)], [0]])) if len(raw) else np.empty(0, np.int64)
    shares = np.zeros((rows, len(CLASSES)))
    if len(raw):
        sums = np.add.reduceat(lanes[raw], cuts).view(np.uint8).reshape(-1, 8)[:, : len(CLASSES)]
        owner = np.searchsorted(ends, cuts, side="right")
        for k in range(len(CLASSES)):
            shares[:, k] = np.bincount(owner, sums[:, k], minlength=rows) / bytes_

    flat, n = words.split(texts)
    total = np.maximum(n, 1)
    distinct, ids = words.coded(flat)
    doc = np.repeat(np.arange(rows), n)
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.float64)
    mean = np.bincount(doc, length, minlength=rows) / total
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, minlength=rows) / total - mean * mean, 0))
    pairs, times = np.unique(doc * (len(distinct) + 1) + ids, return_counts=True)
    of = pairs // (len(distinct) + 1)
    kinds = np.bincount(of, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, of, times)
    entropy = -np.bincount(of, times / total[of] * np.log(times / total[of]), minlength=rows)
    plain = ~pc.match_substring_regex(distinct, r"^\p{L}+[.,]?$").to_numpy(zero_copy_only=False) if len(distinct) else np.empty(0, bool)
    odd = np.bincount(doc, plain[ids], minlength=rows) / total
    short = np.bincount(doc, length <= 3, minlength=rows) / total

    lines = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line_kinds, line_ids = words.coded(lines.flatten())
    line_doc = np.repeat(np.arange(rows), n_lines)
    line_pairs, line_times = np.unique(line_doc * (len(line_kinds) + 1) + line_ids, return_counts=True)
    line_of = line_pairs // (len(line_kinds) + 1)
    repeated = 1 - np.bincount(line_of, minlength=rows) / np.maximum(n_lines, 1)
    top_line = np.zeros(rows)
    np.maximum.at(top_line, line_of, line_times)

    columns = [
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), kinds / total, np.log1p(kinds) / np.log1p(total),
        most / total, entropy / np.log1p(total), odd, short, np.log1p(n_lines), np.log1p(size / np.maximum(n_lines, 1)),
        repeated, top_line / np.maximum(n_lines, 1),
    ]
    return np.column_stack([*columns, np.sqrt(shares)]).astype(np.float32)


@dataclass
class Model:
    """A fitted classifier; ``score`` maps statistics to calibrated probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(x)), z])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit of shares at ordered x by pooling adjacent violators: the
    centre and the value of each pool."""
    pools: list[list[float]] = []
    for xi, ni, pi in zip(x, n, positive, strict=True):
        pools.append([xi * ni, ni, pi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x, the statistics as little-endian float32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.text_chunks(batches):
            x = statistics(table["text"])
            blobs = pa.array([row.tobytes() for row in x], pa.binary())
            for batch in pa.table({"doc_id": table["doc_id"], "x": blobs}).to_batches():
                yield batch

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(work, "doc_id long, x binary")


def _summed(df: DataFrame, part) -> np.ndarray | None:
    """The sum, over all batches of df (x, y), of the vector that ``part(x, y)`` gives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)
                own = part(x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % SUM_GROUPS]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(1).to_pylist():
                own = np.frombuffer(v, np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    sums = df.select("x", "y").mapInArrow(work, "k long, v binary").repartition(SUM_GROUPS, "k").mapInArrow(add, "k long, v binary")
    total = None
    # SUM_GROUPS rows, of the size of the sum.
    for row in sums.collect():
        own = np.frombuffer(row["v"], np.float64)
        total = own if total is None else total + own
    return total


def fit(x: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit a model from staged statistics x (doc_id, x) and labels (id_col, label_col)."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(
        (F.col("y") == 0) | (F.col("y") == 1)
    )
    y = y.withColumn("fold", _fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    known = stage.write(x.join(y, "doc_id").select("x", "y", "fold"), "labelled")
    fitting = known.where(F.col("fold") != CALIBRATION)

    moments = _summed(fitting, lambda v, _: np.concatenate([[len(v)], v.sum(axis=0), (v * v).sum(axis=0)]))
    d = len(CLASSES) + 14
    rng = np.random.default_rng(SEED)
    n = moments[0] if moments is not None else 0
    mean = moments[1 : 1 + d] / n if n else np.zeros(d)
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 1e-6)) if n else np.ones(d)
    model = Model(
        mean, scale, rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1),
        np.array([0.0]), np.array([1.0]),
    )

    def normal(v: np.ndarray, t: np.ndarray) -> np.ndarray:
        z = model.features(v)
        return np.concatenate([(z.T @ z).ravel(), z.T @ t])

    if n:
        sums = _summed(fitting, normal)
        a, b = sums[: (FEATURES + 1) ** 2].reshape(FEATURES + 1, -1), sums[(FEATURES + 1) ** 2 :]
        penalty = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
        penalty[0, 0] = 1e-9
        model.weights = np.linalg.solve(a + penalty, b)
    counts = _summed(known.where(F.col("fold") == CALIBRATION), lambda v, t: _binned(model, v, t))
    if counts is None and n:
        counts = _summed(fitting, lambda v, t: _binned(model, v, t))
    if counts is not None:
        n_of, ones = counts.reshape(2, BINS)
        some = np.flatnonzero(n_of)
        # Half a row of each kind at the ends keeps scores off 0 and 1.
        model.knots, model.values = isotonic(_CENTRES[some], n_of[some], ones[some])
        model.values = (model.values * n_of.sum() + 0.5 * model.values.mean()) / (n_of.sum() + 0.5)
    return model


_CENTRES = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5


def _binned(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
    return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]).astype(np.float64)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels name documents by id_col, too."""
    stage = Stage(docs.sparkSession, "quality")
    x = stage.write(_statistics(docs, id_col, text_col), "statistics")
    held = docs.sparkSession.sparkContext.broadcast(fit(x, labels, stage, id_col, label_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(v))], names=["doc_id", "score"])

    return x.mapInArrow(work, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """docs, with all their columns, without those that score below the threshold."""
    stage = Stage(docs.sparkSession, "quality")
    # Statistics of all documents, not of labelled ones: a join that picks those would shuffle the texts.
    x = stage.write(_statistics(docs, id_col, text_col), "statistics")
    held = docs.sparkSession.sparkContext.broadcast(fit(x, labels, stage, id_col, label_col))
    return docs.where(_score(held)(F.col(f"`{text_col}`").cast("string")) >= threshold)


def _score(held):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = [held.value.score(statistics(t["text"])) for t in words.text_chunks(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))]
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return score
