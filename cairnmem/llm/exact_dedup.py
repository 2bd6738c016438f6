"""Exact dedup with two passes over a Bloom filter that knows "once" from "more than once".

Documents become digests (doc_id and SHA-256, 40 bytes), packed into chunks of some hundred thousand
rows.  Every chunk sends its distinct hashes, 8 bytes each, to segments of the hash space by the key
exchange of ``chunks``.  A segment goes over them twice: pass one counts, per slot of its filter,
whether it was hit once or again; pass two probes, and answers each chunk with one bit a hash.  A row
with a slot that was hit once only is certainly unique and passes straight through; the others (copies, and
a share of false alarms that the slots per row bound) are shuffled by their digest and grouped exactly.

A segment's filter has ``SLOTS_PER_ROW`` slots a row and about ``SEGMENT_BYTES`` bytes of bits, and is held by
the one task that needs it: more rows make more segments, never larger ones, and nothing is broadcast.
A group in a third of all rows weighs one hash a chunk.  Groups are reduced before the shuffle, and joined
back by a plain sort-merge join of two exchanges, which adaptive execution may split where one is hot.

``drop_copies`` reads the documents once for the digests and then as what it returns, in two branches: those
whose digest a further filter, of the repeated digests alone, does not hold stay where they are; the others
are joined with the row of their group that stays.  That filter is broadcast with at most ``FILTER_BYTES``;
where the repeated digests are too many for it, more rows take the join, with the same result.

Nulls and ties: a null text counts as empty, so null and empty texts are copies of each other.  Of a
group the row with the smallest doc_id stays, nulls last; of rows with that same doc_id one stays.
An empty table gives an empty result.  Other columns never take part, whatever their names.  Very long
texts are hashed whole, by Spark's own functions, and never leave the JVM.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import chunks, words
from cairnmem.llm.staging import Stage, partitions

SLOTS_PER_ROW = 24
SEGMENT_BYTES = 4 << 20
FILTER_BYTES = 64 << 20
CHUNK_ROWS = 1 << 18
_PROBES = 2


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _hashes(digests: pa.Array) -> np.ndarray:
    """The first 64 bits of some digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), "<u8")


def _slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots that a hash probes, one array a probe."""
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return [(x % np.uint64(size)).astype(np.int64) for x in (h >> np.uint64(1), mixed >> np.uint64(3))][:_PROBES]


def _possible(h: np.ndarray, notes: list[np.ndarray]) -> tuple[list[np.ndarray], None]:
    """Both passes over one segment: which hashes, each sent once by a chunk, are possibly repeated.

    The note tells which a chunk itself holds twice.  Both probes of one hash may share a slot, which
    only costs a false alarm.
    """
    size = max(64, SLOTS_PER_ROW * len(h))
    seen, again = np.zeros(size, bool), np.zeros(size, bool)
    for begin in range(0, len(h), 1 << 20):
        slots, n = np.unique(np.concatenate(_slots(h[begin : begin + (1 << 20)], size)), return_counts=True)
        again[slots] |= seen[slots] | (n > 1)
        seen[slots] = True
    out = np.ones(len(h), bool)
    for at in _slots(h, size):
        out &= again[at]
    return [out | notes[0]], None


_QUESTION = chunks.Question(["bool"], ["bool"], chunks.shared().combine, chunks.shared().answer, judge=_possible)


def _probed(docs: DataFrame, id_col: str, text_col: str, stage: Stage, segment_bytes: int, fan_in: int | None) -> DataFrame:
    """Of every document: row, doc_id, sha and whether it is possibly repeated (maybe); staged."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        for batch in _joined(batches, CHUNK_ROWS):
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                own = batch.slice(begin, CHUNK_ROWS)
                cols = [pa.array([number]), pa.array([own.num_rows]), pa.array([chunks.ipc(pa.Table.from_batches([own]))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "n", "rows"])
                number += 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _hashes(chunks.unipc(blob)["sha"])
                group, first = words.ranked(h)
                yield from chunks.cells(number, h[first], [np.bincount(group) > 1], how.sent, how.rest)

    def flag(left: pa.Table, replies: pa.Table) -> pa.Table:
        rows = chunks.unipc(left["rows"][0].as_py())
        maybe = chunks.reply(replies, "bool")[words.ranked(_hashes(rows["sha"]))[0]]
        number = (left["chunk"][0].as_py() << 24) + np.arange(len(maybe), dtype=np.int64)
        return pa.table({"row": pa.array(number), "doc_id": rows["doc_id"], "sha": rows["sha"], "maybe": pa.array(maybe)})

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col)).alias("sha"))
    digests = stage.write(thin.mapInArrow(pack, "chunk long, n long, rows binary"), "digests")
    how = chunks.plan(digests, "n", exact=True, fan_in=fan_in, bucket_keys=max(1, 8 * segment_bytes // SLOTS_PER_ROW))
    replies = chunks.ask(digests.select("chunk", "rows").mapInArrow(keys, chunks.cell_schema(1)), how, _QUESTION, stage)
    both = digests.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    out = stage.write(both.applyInArrow(flag, "row long, doc_id long, sha binary, maybe boolean"), "probed", by="maybe")
    stage.drop(digests, replies)
    return out


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def _groups(probed: DataFrame, stage: Stage) -> DataFrame:
    """Of each digest that is possibly repeated: the row that stays (keep) and group_size; staged."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    return stage.write(probed.where("maybe").groupBy("sha").agg(F.min(first).alias("keep"), F.count("*").alias("group_size")), "groups")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, fan_in: int | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    stage = Stage(docs.sparkSession, "exact-dedup")
    probed = _probed(docs, id_col, text_col, stage, segment_bytes, fan_in)
    groups = _groups(probed, stage)
    grouped = probed.where("maybe").join(groups, "sha").select(
        "doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "sha"
    )
    alone = probed.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return grouped.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _bits(digests: DataFrame, size: int) -> bytes:
    """A bit for each slot that some digests hit.  A reducer holds the slots of its own cell only."""
    cells = min(4 * partitions(digests.sparkSession), -(-size // 4096))
    width = -(-size // cells)
    width += -width % 8

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, 1 << 20):
            slots = words.distinct(np.concatenate(_slots(_hashes(batch.column(0)), size)))
            cell = slots // width
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            local = (slots - cell * width).astype("<u4")
            sent = [local[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(slots)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[cuts]), pa.array(sent, pa.binary())], names=["cell", "slots"])

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(width, bool)
        for slots in table["slots"].to_pylist():
            seen[np.frombuffer(slots, "<u4")] = True
        return pa.table({"cell": table["cell"][:1], "bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    bits = bytearray(width // 8 * cells)
    # One filter's bits, so FILTER_BYTES or little more.
    for row in digests.mapInArrow(hit, "cell long, slots binary").groupBy("cell").applyInArrow(merge, "cell long, bits binary").collect():
        bits[row["cell"] * width // 8 : (row["cell"] + 1) * width // 8] = row["bits"]
    return bytes(bits)


def _probe(held: Broadcast, size: int):
    """A function of a column of digests: whether all their slots were hit."""

    @F.pandas_udf("boolean")
    def probe(sha: pd.Series) -> pd.Series:
        bits, h = np.frombuffer(held.value, np.uint8), np.frombuffer(b"".join(d[:8] for d in sha), "<u8")
        hit = np.ones(len(h), bool)
        for at in _slots(h, size):
            hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(hit)

    return probe


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, filter_bytes: int = FILTER_BYTES,
    fan_in: int | None = None,
) -> DataFrame:
    """docs without the copies: all columns, whatever they are called; one row of each group stays."""
    stage = Stage(docs.sparkSession, "drop-copies")
    probed = _probed(docs, id_col, text_col, stage, segment_bytes, fan_in)
    repeated = stage.write(_groups(probed, stage).where("group_size > 1").select("sha", F.col("keep.id").alias("keep_id")), "repeated")
    stage.drop(probed)
    size = max(64, min(8 * filter_bytes, SLOTS_PER_ROW * repeated.count()))
    hit = _probe(docs.sparkSession.sparkContext.broadcast(_bits(repeated.select("sha"), size)), size)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    rows = rows.select("d", F.col(f"d.`{id_col}`").cast("long").alias("id"), _digest(F.col(f"d.`{text_col}`")).alias("sha"))
    maybe = rows.where(hit("sha")).join(repeated.withColumn("found", F.lit(True)), "sha", "left")
    staying = maybe.where(F.col("found").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    # Rows with one text and one doc_id: any of them is as good.
    staying = staying.groupBy("sha", "id").agg(F.first("d").alias("d"))
    return rows.where(~hit("sha")).select("d.*").unionByName(staying.select("d.*")).select([F.col(f"`{c}`") for c in docs.columns])
