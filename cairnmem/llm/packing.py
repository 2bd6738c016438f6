"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n, after as many
pieces of the largest length as fit.  Each piece is a training sequence of its own, so no sequence
crosses documents and none is padded; equal lengths share a bucket, from which ``batches`` draws.

The operator only maps: no shuffle, and a lost executor costs its own tasks.

Nulls and ties: a null text counts as empty; every document has at least its end token.  A null
doc_id is kept as null.  Repeated rows are packed each on their own.  An empty table gives no rows.
Columns other than the two named ones are ignored.  A very long text is cut into as many pieces of the
largest length as it fills; its ids must fit in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.llm import tokens
from cairnmem.llm.staging import partitions, prepare

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "`offset` long, bucket int, ids array<int>"
)


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first.

    >>> piece_lengths(2059, 1024)
    [1024, 1024, 8, 2, 1]
    """
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame,
    max_tokens: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it lies in its document, its sequence, its bucket and its ids.

    ``max_tokens`` must be a power of two.  ``sequence_id`` is unique in the result; its high bits
    are the task, its low bits count the task's pieces.  ``bucket`` is log2 of the length.
    ``with_ids=False`` leaves the ids out.
    """
    prepare(docs.sparkSession)
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for begin in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in range(6)]
                all_ids = []
                for doc_id, text in zip(ids_of[begin : begin + 256].to_pylist(), texts[begin : begin + 256].to_pylist(), strict=True):
                    ids = np.append(tokens.encode(text, ranks_path), np.uint32(end_id)).astype("<u4")
                    at, raw = 0, ids.tobytes()
                    for length in piece_lengths(len(ids), max_tokens):
                        row = (doc_id, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), len(ids), sequence)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        at, sequence = at + length, sequence + 1
                    all_ids.append(ids)
                lengths = np.array(cols[2], np.int64)
                arrays = [pa.array(c, pa.int64()) for c in cols]
                arrays.append(pa.array(np.zeros(len(lengths), np.int64)))
                arrays.append(pa.array(np.log2(lengths).astype(np.int32)))
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_ids).astype(np.int32))))
                else:
                    arrays.append(pa.nulls(len(lengths), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)
    return out if with_ids else out.drop("ids")


def batches(packed: DataFrame, tokens_per_batch: int, seed: int = 0) -> DataFrame:
    """Sequences of ``pack`` in batches of one bucket each, with a ``batch_id``: every batch has
    tokens_per_batch tokens, but for the last ones of each task and bucket.

    Sequences are dealt to tasks by hash, so no task has a whole bucket, and a batch is a run of neighbours.
    """
    deal = F.xxhash64("sequence_id", F.lit(seed))
    parts = partitions(packed.sparkSession)
    dealt = packed.withColumn("_part", F.pmod(deal, F.lit(parts)))
    nth = F.row_number().over(Window.partitionBy("_part", "bucket").orderBy(deal, "sequence_id")) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(tokens_per_batch) / F.col("length")))
    number = F.concat_ws("-", "bucket", "_part", F.floor(nth / rows).cast("long"))
    return dealt.withColumn("batch_id", number).drop("_part")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
