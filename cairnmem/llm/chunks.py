"""Tokenised chunks of a corpus, and the exchange of keys between chunks.

A chunk is the words of some megabytes of whole documents, coded by the chunk's own vocabulary; it is
one row of a staged table.  Corpus-wide questions about keys (shingles, windows, n-grams: "does this
key occur elsewhere", "how often") are asked by chunk: each chunk sends its distinct keys once, cut
into buckets by hash range, and each bucket answers every chunk in the order of its keys.  So a key
that a third of all documents hold weighs one entry a chunk, a row is a block of some thousand keys
and not one key, and no task holds more than one bucket or one chunk.

A bucket has a row of every chunk.  Beyond ``FAN_IN`` chunks these rows would be many and small, so
there the exchange has two levels: groups of at most about that many chunks are merged first, by
coarse buckets, and each merged part asks the buckets like one chunk and hands the answers on.  The rows of a
task are then bounded by FAN_IN and by the number of groups, whatever the number of chunks.

Keys are 64-bit hashes; a bucket implies their high bits.  Where equal keys alone decide, all 64 bits
are exchanged (``exact``), and the first note can be a further hash that must be equal, too (``checked``).
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import words
from cairnmem.llm.staging import Stage, partitions

CHUNK_SCHEMA = "chunk long, n_words long, docs binary, vocab binary, ids binary"
#: Keys of one bucket, about: more buckets than the session's partitions ask for, where there are more.
BUCKET_KEYS = 1 << 21
_REST = 6
#: Chunks whose keys one level of the exchange brings together.
FAN_IN = 4096
#: Chunks of series 1 are numbered from here.
SERIES = 1 << 38


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


@dataclass
class Chunk:
    """One decoded chunk: documents (their ids and a hash of their texts), and the codes of their words."""

    number: int
    doc_ids: pa.Array
    marks: pa.Array
    counts: np.ndarray
    vocab: pa.Array
    ids: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> "Chunk":
        row = table.slice(0, 1).to_pylist()[0]
        docs = pa.ipc.open_stream(row["docs"]).read_all().combine_chunks()
        vocab = pa.ipc.open_stream(row["vocab"]).read_all()["word"].combine_chunks()
        vocab = vocab if isinstance(vocab, pa.Array) else pa.array([], pa.large_string())
        doc_ids, marks = (docs[c].combine_chunks() for c in ("doc_id", "mark"))
        return cls(row["chunk"], doc_ids, marks, docs["n"].to_numpy(), vocab, unsqueeze(row["ids"], "<i4"))

    def rows(self) -> np.ndarray:
        """A number of each document that no other document has, also if doc_ids repeat."""
        return (np.int64(self.number) << np.int64(24)) + np.arange(len(self.counts), dtype=np.int64)

    def hashes(self) -> np.ndarray:
        return words.hashes(self.vocab)[self.ids]

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = words.halves(self.vocab)
        return a[self.ids], b[self.ids]

    def owners(self) -> np.ndarray:
        """The place, in the chunk, of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def tokenised(
    docs: DataFrame, stage: Stage, lower: bool, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = words.CHUNK_BYTES,
    series: int = 0,
) -> DataFrame:
    """The staged chunks of docs; a null text has no words.

    Chunks of different ``series`` (0 or 1) have different numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = series * SERIES + (TaskContext.get().partitionId() << 16)
        for table in words.text_chunks(batches, limit=chunk_bytes):
            flat, counts = words.split(table["text"], lower)
            vocab, ids = words.coded(flat)
            about = ipc(pa.table({"doc_id": table["doc_id"], "mark": table["mark"], "n": pa.array(counts)}))
            cols = [[number], [len(ids)], [about], [ipc(pa.table({"word": vocab}))], [squeeze(ids.astype("<i4"))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cols)],
                names=["chunk", "n_words", "docs", "vocab", "ids"],
            )
            number += 1

    text = F.col(text_col).cast("string")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return stage.write(thin.mapInArrow(work, CHUNK_SCHEMA), "chunks")


@dataclass(frozen=True)
class Plan:
    """How the keys of some chunks are exchanged."""

    #: Buckets that merge and answer, those that chunks send to, and groups of chunks (1: one level).
    buckets: int
    sent: int
    groups: int
    #: Low bytes of a key that are sent.
    rest: int


def plan(
    chunks: DataFrame, keys_col: str = "n_words", exact: bool = False, fan_in: int | None = None, bucket_keys: int = BUCKET_KEYS
) -> Plan:
    """How to exchange the keys of some chunks, from how many of both there are."""
    n, keys = chunks.agg(F.count("*"), F.sum(keys_col)).first()
    wanted = min(1 << 24, max(4 * partitions(chunks.sparkSession), (keys or 0) // bucket_keys + 1))
    groups = -(-n // (fan_in or FAN_IN))
    if groups <= 1:
        return Plan(wanted, wanted, 1, whole(wanted) if exact else _REST)
    sent = -(-wanted // groups)
    return Plan(sent * -(-wanted // sent), sent, groups, 8)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets of some keys; they do not decrease as the keys grow, and each of n lies in one of n / k."""
    return ((keys >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def whole(n: int) -> int:
    """Low bytes of a key that with its bucket, of n, make out the whole key."""
    return 7 if n >= 256 else 8


def pack_keys(keys: np.ndarray, rest: int = _REST) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :rest].T).tobytes()


def unpack_keys(data: bytes, rest: int = _REST) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(rest, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :rest] = planes.T
    return out.view("<u8").ravel()


def cells(chunk: int, keys: np.ndarray, notes: list[np.ndarray], n: int, rest: int) -> Iterator[pa.RecordBatch]:
    """What a chunk sends: a row for each of n buckets, of its sorted distinct keys and notes on them.

    Of a key go the ``rest`` low bytes.  A note of booleans goes as bits, of other numbers as compressed byte planes.
    """
    if not len(keys):
        return
    bucket = bucket_of(keys, n).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for begin in range(0, len(cuts), 256):
        own = cuts[begin : begin + 256]
        ends = np.append(cuts[begin + 1 : begin + 256], cuts[begin + 256] if begin + 256 < len(cuts) else len(keys))
        cols = [
            pa.array(bucket[own]),
            pa.array(np.full(len(own), chunk, np.int64)),
            pa.array([pack_keys(keys[a:b], rest) for a, b in zip(own, ends, strict=True)], pa.binary()),
        ]
        cols += [pa.array([_note(x[a:b]) for a, b in zip(own, ends, strict=True)], pa.binary()) for x in notes]
        yield pa.RecordBatch.from_arrays(cols, names=_cell_names(len(notes)))


def _cell_names(notes: int) -> list[str]:
    return ["bucket", "chunk", "keys", *(f"note{i}" for i in range(notes))]


def _note(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes() if x.dtype == bool else squeeze(x)


def _unnote(data: bytes, n: int, dtype: str) -> np.ndarray:
    if dtype == "bool":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return unsqueeze(data, dtype)


def cell_schema(notes: int) -> str:
    return "bucket long, chunk long, keys binary" + "".join(f", note{i} binary" for i in range(notes))


def no_cells(notes: int) -> pa.Table:
    """What a chunk without keys sends, as a table."""
    names = _cell_names(notes)
    return pa.table([pa.array([], pa.int64() if i < 2 else pa.binary()) for i in range(len(names))], names=names)


def _read(table: pa.Table, notes: list[str], rest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of some cells: how many keys each has, all keys, and the notes on them."""
    parts = [unpack_keys(k, rest) for k in table["keys"].to_pylist()]
    sizes = np.array([len(p) for p in parts])
    values = [np.concatenate([_unnote(d, k, t) for d, k in zip(table[f"note{i}"].to_pylist(), sizes, strict=True)]) for i, t in enumerate(notes)]
    return sizes, np.concatenate(parts), values


def _split(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    return pa.array([_note(flat[b - k : b]) for b, k in zip(ends, sizes, strict=True)], pa.binary())


@dataclass(frozen=True)
class Question:
    """What buckets are asked.

    ``notes`` and ``replies`` are the types of the notes on an entry and of the answers to it.
    ``combine(group, notes)`` gets, for some entries, the number of the key's group and the notes, and
    returns the notes by group, as if one chunk had sent them.  ``answer(notes)`` makes of those the
    answers by group and, last, integers to be summed over all buckets, or None.  A bucket may also
    ``judge(keys, notes)`` its entries itself, and return the answers by entry and None.
    """

    notes: list[str]
    replies: list[str]
    combine: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]
    answer: Callable[[list[np.ndarray]], tuple[list[np.ndarray], np.ndarray | None]]
    checked: bool = False
    judge: Callable[[np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], np.ndarray | None]] | None = None

    def grouped(self, keys: np.ndarray, notes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The group of each entry, a first entry and the notes of each group."""
        group, first = words.ranked(keys, notes[0] if self.checked else None)
        if self.checked:
            return group, first, [notes[0][first], *self.combine(group, notes[1:])]
        return group, first, self.combine(group, notes)

    def answers(self, keys: np.ndarray, notes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray | None]:
        if self.judge is not None:
            return self.judge(keys, notes)
        group, _, merged = self.grouped(keys, notes)
        found, sums = self.answer(merged[1:] if self.checked else merged)
        return [x[group] for x in found], sums

    @property
    def schema(self) -> str:
        return "bucket long, chunk long, n long, sums array<long>" + "".join(f", reply{i} binary" for i in range(len(self.replies)))

    def table(self, cells: pa.Table, sizes: np.ndarray, found: list[np.ndarray], sums: np.ndarray | None) -> pa.Table:
        cols = {"bucket": cells["bucket"], "chunk": cells["chunk"], "n": pa.array(sizes.astype(np.int64))}
        cols["sums"] = pa.array([None if sums is None else sums.tolist()] + [None] * (len(sizes) - 1), pa.list_(pa.int64()))
        return pa.table(cols | {f"reply{i}": _split(x, sizes) for i, x in enumerate(found)})


def ask(sent: DataFrame, how: Plan, what: Question, stage: Stage) -> DataFrame:
    """What the buckets answer to cells: (bucket, chunk, n, sums, reply0, ...), each reply in the order
    of the keys sent; staged.  Sums go with one row of each bucket."""

    def answer(table: pa.Table, rest: int) -> pa.Table:
        sizes, keys, notes = _read(table, what.notes, rest)
        return what.table(table, sizes, *what.answers(keys, notes))

    if how.groups == 1:
        found = sent.groupBy("bucket").applyInArrow(lambda t: answer(t, how.rest), what.schema)
        return stage.write(found, "replies")

    def merge(table: pa.Table) -> pa.Table:
        _, keys, notes = _read(table, what.notes, how.rest)
        _, first, merged = what.grouped(keys, notes)
        return pa.Table.from_batches(cells(table["part"][0].as_py(), keys[first], merged, how.buckets, fine))

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, keys, notes = _read(left, what.notes, how.rest)
        group, _ = words.ranked(keys, notes[0] if what.checked else None)
        sums = [s for s in right["sums"].to_pylist() if s is not None]
        return what.table(left, sizes, [reply(right, t, i)[group] for i, t in enumerate(what.replies)], np.sum(sums, axis=0) if sums else None)

    fine = whole(how.buckets)
    part = F.pmod(F.xxhash64("chunk"), F.lit(how.groups)) * how.sent + F.col("bucket")
    sent = stage.write(sent.withColumn("part", part), "sent")
    merged = sent.groupBy("part").applyInArrow(merge, cell_schema(len(what.notes)))
    merged = stage.write(merged.groupBy("bucket").applyInArrow(lambda t: answer(t, fine), what.schema), "merged")
    back = merged.withColumnRenamed("chunk", "part")
    found = stage.write(sent.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(hand_on, what.schema), "replies")
    stage.drop(sent, merged)
    return found


def _shared(group: np.ndarray, notes: list[np.ndarray]) -> list[np.ndarray]:
    return [(np.bincount(group) > 1) | (np.bincount(group, notes[0]) > 0)]


def shared(checked: bool = False) -> Question:
    """Whether a key was sent by two chunks, or noted as repeated by one."""
    return Question(["<u4", "bool"] if checked else ["bool"], ["bool"], _shared, lambda notes: (notes, None), checked)


def reply(table: pa.Table, dtype: str, i: int = 0) -> np.ndarray:
    """The answers to one chunk, in the order of its sorted distinct keys."""
    if not table.num_rows:
        return np.empty(0, bool if dtype == "bool" else dtype)
    table = table.sort_by("bucket")
    return np.concatenate([_unnote(d, n, dtype) for d, n in zip(table[f"reply{i}"].to_pylist(), table["n"].to_pylist(), strict=True)])
