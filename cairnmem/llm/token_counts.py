"""Token counts of documents in flat, unindexed token files.

A token file is a bare run of ids in which every document ends with one separator id.  Files are
read as fixed-size blocks that know nothing of documents.  Each block is searched for separators
with one vectorised comparison; documents that cross blocks are stitched by a prefix scan over one
small row per block.  The scan has two levels, so that even a file that holds all tokens is not
scanned in one task: runs of blocks first, then the totals of the runs.

Nulls and ties: a null text is an empty document of no tokens.  Tokens after a file's last separator
are a document that has not ended (``ended`` false).  Repeated rows are documents of their own, a
null doc_id stays null, and an empty table or file gives no rows.  A very long document spans as many
blocks as it needs.

``document_token_counts`` writes real flat files (in a store that pyarrow opens, else a table of blocks) and
finds the documents again by scanning their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.llm import tokens
from cairnmem.llm.staging import Stage, partitions, prepare

BLOCK_TOKENS = 1 << 18
#: Blocks in a run of the first level of the prefix scan.
RUN_BLOCKS = 1024


def token_files(
    docs: DataFrame,
    end_id: int = 50256,
    block_tokens: int = BLOCK_TOKENS,
    dtype: str = "<u2",
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
) -> DataFrame:
    """Flat token files of docs, as blocks: file, block, data, and the order in which docs went in; for
    stores that only Spark writes to.

    A task writes one file.  ``data`` holds ids only.  ``doc_ids`` and ``first`` are the manifest: the
    documents begun in this block, and how many of the file came before; no position is kept.
    """
    prepare(docs.sparkSession)
    if end_id >= 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError("end_id does not fit the ids' type")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        begun: list[int | None] = []
        size = 0

        def cut(stream: np.ndarray) -> pa.RecordBatch:
            nonlocal block, first
            cols = [[file], [block], [stream.tobytes()], [first], [list(begun)]]
            block, first = block + 1, first + len(begun)
            begun.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], names=NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokens.encode(text, ranks_path, special=False)
                begun.append(doc_id)
                held.append(np.append(ids, np.uint32(end_id)).astype(dtype))
                size += len(ids) + 1
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    while len(stream) >= block_tokens:
                        yield cut(stream[:block_tokens])
                        stream = stream[block_tokens:]
                    held, size = [stream], len(stream)
        if size or begun:
            yield cut(np.concatenate(held))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "file long, block long, data binary, first long, doc_ids array<long>"
    )


NAMES = ["file", "block", "data", "first", "doc_ids"]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]


def write_token_files(
    docs: DataFrame, root: str, end_id: int = 50256, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text",
    ranks_path: str | None = None,
) -> DataFrame:
    """Write docs as flat token files under a folder of a store that pyarrow opens; running the result
    (name, first, doc_ids), the manifest, writes them.

    A task writes one file of ids and separators alone, under another name until it is whole; a task that
    runs again writes the same file again.  The manifest tells which documents went in, in which order.
    """
    prepare(docs.sparkSession)
    if end_id >= 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError("end_id does not fit the ids' type")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, folder = _store(root)
        name, hidden, first = f"part-{TaskContext.get().partitionId():06d}.bin", f".{uuid.uuid4().hex}", 0
        store.create_dir(folder)
        rows: list[tuple[str, int, list[int | None]]] = []
        with store.open_output_stream(f"{folder}/{hidden}") as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    out.write(np.append(tokens.encode(text, ranks_path, special=False), np.uint32(end_id)).astype(dtype).tobytes())
                rows.append((name, first, batch.column(0).to_pylist()))
                first += batch.num_rows
        if not first:
            store.delete_file(f"{folder}/{hidden}")
            return
        store.move(f"{folder}/{hidden}", f"{folder}/{name}")
        for row in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["name", "first", "doc_ids"]
            )

    files, path = Stage.files(docs.sparkSession, root)
    files.mkdirs(path)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(work, "name string, first long, doc_ids array<long>")


def read_token_files(spark, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """Blocks (file, block, data) of the flat token files under a path.

    ``file`` is a hash of the file's name.  Spark lists the files; a task reads the byte range of each of
    its blocks, so files may have any size.  In a store that pyarrow cannot open, Spark reads each file
    whole, and a file may have 2 GB.
    """
    step = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path)
    block = F.explode(F.expr(f"sequence(0L, greatest(length - 1L, 0L) div {step}L)")).alias("block")
    one = files.select("path").first()
    if one and one[0].split(":")[0] not in RANGED:
        out = files.select(F.xxhash64("path").alias("file"), "content", block)
        return out.select("file", "block", F.expr(f"substring(content, int(block * {step}) + 1, {step})").alias("data"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as f:
                    f.seek(block * step)
                    cols = [[file], [block], [f.read(step)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=False)], names=NAMES[:3])

    prepare(spark)
    ranges = files.select("path", F.xxhash64("path").alias("file"), block).repartition(partitions(spark))
    return ranges.mapInArrow(read, "file long, block long, data binary")


#: Schemes of the stores whose files pyarrow opens.
RANGED = ("file", "hdfs", "s3", "gs")


def _store(name: str) -> tuple[pa.fs.FileSystem, str]:
    if name.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(name)


def _opened(name: str) -> pa.NativeFile:
    store, path = _store(name)
    return store.open_input_file(path)


def count_tokens(blocks: DataFrame, end_id: int = 50256, dtype: str = "<u2", stage: Stage | None = None) -> DataFrame:
    """Documents of token files: file, ordinal, start, n_tokens (without the separator), ended."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", dtype)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
                names=["file", "block", "n", "ends"],
            )

    stage = stage or Stage(blocks.sparkSession, "token-counts")
    found = stage.write(blocks.select("file", "block", "data").mapInArrow(scan, "file long, block long, n long, ends array<int>"), "blocks")
    # The scan's windows see a thin row of each block; its separators are joined after.
    thin = found.select("file", "block", "n", F.size("ends").alias("k"), (F.get("ends", F.size("ends") - 1) + 1).alias("begins"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        thin.withColumn("run", F.expr(f"block div {RUN_BLOCKS}"))
        .withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("nth", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .withColumn("stop", F.col("at") + F.col("begins"))
        .withColumn("open", F.max("stop").over(before))
    )
    of_file = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = inner.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("stop").alias("stop"))
    runs = (
        runs.withColumn("run_at", F.coalesce(F.sum("n").over(of_file), F.lit(0)))
        .withColumn("run_nth", F.coalesce(F.sum("k").over(of_file), F.lit(0)))
        .withColumn("run_open", F.coalesce(F.max(F.col("run_at") + F.col("stop")).over(of_file), F.lit(0)))
        .withColumn("is_last", F.lead("run").over(Window.partitionBy("file").orderBy("run")).isNull())
        .select("file", "run", "run_at", "run_nth", "run_open", "is_last")
    )
    placed = inner.join(runs, ["file", "run"]).select(
        "file",
        "block",
        (F.col("run_at") + F.col("at")).alias("at"),
        (F.col("run_nth") + F.col("nth")).alias("nth"),
        F.coalesce(F.col("run_at") + F.col("open"), "run_open").alias("open"),
        "n",
        "k",
        "begins",
        (F.col("is_last") & F.lead("block").over(Window.partitionBy("file", "run").orderBy("block")).isNull()).alias("is_last"),
    )
    held = found.where(F.size("ends") > 0).select("file", "block", "ends")
    ended = placed.join(held, ["file", "block"]).select("file", "at", "nth", "open", "ends", F.posexplode("ends").alias("j", "e")).select(
        "file",
        (F.col("nth") + F.col("j")).alias("ordinal"),
        F.when(F.col("j") == 0, F.col("open")).otherwise(F.col("at") + F.get("ends", F.col("j") - 1) + 1).alias("start"),
        (F.col("at") + F.col("e")).alias("stop"),
        F.lit(True).alias("ended"),
    )
    rest = placed.where("is_last").select(
        "file",
        (F.col("nth") + F.col("k")).alias("ordinal"),
        F.coalesce(F.col("at") + F.col("begins"), "open").alias("start"),
        (F.col("at") + F.col("n")).alias("stop"),
        F.lit(False).alias("ended"),
    )
    return ended.unionByName(rest.where("stop > start")).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended"
    )


def document_token_counts(docs: DataFrame, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Write docs as flat token files, scan them, and name the documents by the manifest."""
    stage = Stage(docs.sparkSession, "token-files")
    root = f"{stage.qualified}/flat"
    if root.split(":")[0] in RANGED:
        manifest = stage.write(write_token_files(docs, root, end_id, dtype, id_col, text_col), "manifest")
        names = docs.sparkSession.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.xxhash64("path").alias("file"))
        manifest, blocks = manifest.join(names, "name"), read_token_files(docs.sparkSession, root, dtype=dtype)
    else:
        manifest = blocks = stage.write(token_files(docs, end_id, dtype=dtype, id_col=id_col, text_col=text_col), "files")
    manifest = manifest.select("file", "first", F.posexplode("doc_ids").alias("j", "doc_id")).select(
        "file", (F.col("first") + F.col("j")).alias("ordinal"), "doc_id"
    )
    counts = count_tokens(blocks, end_id, dtype, stage)
    return manifest.join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal", "start", "ended")
