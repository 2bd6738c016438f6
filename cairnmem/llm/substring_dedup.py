"""Substring dedup by level-wise doubling.

Windows of ``min_words`` words that start at more than one place of the corpus are repeated; the
words they cover are removed.  Levels lead there: windows of a quarter of that length first, and only
those that repeat are extended to twice their length (a window and the one that overlaps or follows it,
both repeated), which are asked for again.  35 words are reached by way of 9 and 18.  What survives at
``min_words`` decides the removal; it is extended further, to 70, 140, ..., until no candidate is left,
and the last length at which a document has a repeated window is reported with it.

Each level asks the buckets of ``chunks`` which keys occur elsewhere.  A chunk sends each distinct
window once, noted if the chunk itself holds it twice, so a passage in a third of all documents is
one entry a chunk.  Levels after the first carry places and hashes of the surviving windows only.

On the way up windows are compared by 64-bit hashes, where two unlike ones that agree only stay candidates.
At ``min_words`` the candidates are hashed anew from their words, and are equal where 64 bits and an independent
32 bits are: among w windows some w**2 / 2**97 accidental pairs, 0.003 for the 2e13 windows of 100 TB.
Levels beyond, which decide nothing but ``longest``, use 64 bits again.

Nulls and ties: all copies of a repeated window are removed, the first too.  A null text has no
words; a text shorter than a window keeps all of its words.  Repeated rows remove each other.  A null
doc_id stays null, and an empty table gives no rows.  Other columns are ignored.  Very long texts: a
text is never cut; one that is longer than a chunk is a chunk of its own, and its words must fit in a task.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import chunks, words
from cairnmem.llm.staging import Stage

#: The first level has at least so many words, if min_words has.
FIRST_LEVEL = 8
_DOC = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, longest long"


def levels(min_words: int) -> list[int]:
    """Window lengths from the first level to min_words, each at most twice the one before.

    >>> levels(35)
    [9, 18, 35]
    """
    out = [min_words]
    while -(-out[0] // 2) >= FIRST_LEVEL:
        out.insert(0, -(-out[0] // 2))
    return out


def _sent(number: int, keys: np.ndarray, checks: np.ndarray | None, how: chunks.Plan) -> Iterator[pa.RecordBatch]:
    group, first = words.ranked(keys, checks)
    notes = [np.bincount(group, minlength=len(first)) > 1]
    return chunks.cells(number, keys[first], notes if checks is None else [checks[first], *notes], how.sent, how.rest)


def _repeated(keys: np.ndarray, checks: np.ndarray | None, replies: pa.Table) -> np.ndarray:
    """Which of a chunk's keys occur elsewhere."""
    return chunks.reply(replies, "bool")[words.ranked(keys, checks)[0]] if len(keys) else np.empty(0, bool)


_TYPES = {"kind": pa.string(), "chunk": pa.int64(), "length": pa.int64(), "n": pa.int64(), "counts": pa.binary(), "places": pa.binary(), "keys": pa.binary()}
_OUT = "kind string, chunk long, length long, n long, counts binary, places binary, keys binary"


def _rows(rows: list[dict]) -> pa.Table:
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items()})


def _packed(places: np.ndarray) -> bytes:
    return chunks.squeeze(np.diff(places, prepend=0).astype("<i8"))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(chunks.unsqueeze(data, "<i8"))


def _passed(number: int, counts: np.ndarray, places: np.ndarray, keys: np.ndarray, length: int, longer: int, min_words: int) -> pa.Table:
    """What is known after a level: candidates of the next (with keys, unless those are made anew), and what was
    found: the repeated windows at min_words, the documents that have any beyond."""
    rows = []
    owner = np.searchsorted(np.cumsum(counts), places, side="right")
    if length >= min_words and len(places):
        what = places if length == min_words else words.distinct(owner)
        rows.append({"kind": "found", "chunk": number, "length": length, "n": len(what), "places": _packed(what)})
    step = longer - length
    after = np.minimum(np.searchsorted(places, places + step), max(len(places) - 1, 0))
    both = np.flatnonzero(places[after] == places + step)
    both = both[places[both] + longer <= np.cumsum(counts)[owner[both]]]
    if len(both):
        row = {"kind": "level", "chunk": number, "length": longer, "n": len(both), "places": _packed(places[both])}
        if longer != min_words:
            row |= {"counts": chunks.squeeze(counts.astype("<i8")), "keys": words.mix(keys[both], keys[after[both]]).astype("<u8").tobytes()}
        rows.append(row)
    return _rows(rows)


def _keys(c: chunks.Chunk, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and checks of the windows of n words at some places."""
    a, b = c.halves()
    return words.windows(a, n)[at], (words.windows(b, n)[at] & np.uint64(0xFFFFFFFF)).astype("<u4")


def remove_repeats(
    docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
    fan_in: int | None = None,
) -> DataFrame:
    """doc_id, text without repeated passages (its words joined by spaces), n_words, n_removed,
    kept_sha256 of that text, and longest: the last of min_words, 2 * min_words, ... with a repeated
    window, 0 for none.  ``fan_in`` is how many chunks one level of the exchange takes."""
    stage = Stage(docs.sparkSession, "substring-dedup")
    corpus = chunks.tokenised(docs, stage, lower=False, id_col=id_col, text_col=text_col)
    up = levels(min_words)
    found, level, length = None, None, up[0]
    while level is None or level.limit(1).count():
        longer = up[up.index(length) + 1] if length < min_words else 2 * length
        if length == min_words:
            passed = _decide(corpus, level, min_words, stage, fan_in)
        elif level is None:
            passed = _first(corpus, length, longer, min_words, stage, fan_in)
        else:
            passed = _extend(level, length, longer, min_words, stage, fan_in)
        passed = stage.write(passed, "level", by="kind")
        if level is not None:
            stage.drop(level)
        level, more = (passed.where(F.col("kind") == kind).drop("kind") for kind in ("level", "found"))
        level._cairnmem_path = f"{passed._cairnmem_path}/kind=level"
        found, length = more if found is None else found.unionByName(more), longer

    def kept(left: pa.Table, found: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        edges, longest = np.zeros(len(c.ids) + 1, np.int32), np.zeros(len(c.counts), np.int64)
        owner = c.owners()
        for r in found.select(["length", "places"]).sort_by("length").to_pylist():
            places = _places(r["places"])
            if r["length"] == min_words:
                np.add.at(edges, places, 1)
                np.add.at(edges, places + min_words, -1)
            longest[owner[places] if r["length"] == min_words else places] = r["length"]
        keep = np.cumsum(edges)[:-1] == 0
        n_kept = np.bincount(owner, keep, minlength=len(c.counts)).astype(np.int64)
        stay = c.vocab.take(pa.array(c.ids[keep])).cast(pa.large_string())
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_kept)])), stay)
        texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()
        return pa.table(
            {
                "doc_id": c.doc_ids, "n_words": pa.array(c.counts), "n_removed": pa.array(c.counts - n_kept),
                "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                "text": pa.array(texts, pa.string()) if with_text else pa.nulls(len(texts), pa.string()), "longest": pa.array(longest),
            }
        )

    out = corpus.groupBy("chunk").cogroup(found.select("chunk", "length", "places").groupBy("chunk")).applyInArrow(kept, _DOC)
    return out.select("doc_id", "text", "n_words", "n_removed", "kept_sha256", "longest")


def _first(corpus: DataFrame, length: int, longer: int, min_words: int, stage: Stage, fan_in: int | None) -> DataFrame:
    """The first level, of all windows."""
    how = chunks.plan(corpus, exact=True, fan_in=fan_in)

    def windows(c: chunks.Chunk) -> tuple[np.ndarray, np.ndarray]:
        at = words.starts(c.counts, length)
        return at, words.windows(c.hashes(), length)[at]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = chunks.Chunk.of(pa.table(batch.slice(i, 1)))
                yield from _sent(c.number, windows(c)[1], None, how)

    def hear(left: pa.Table, replies: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        at, keys = windows(c)
        hit = _repeated(keys, None, replies)
        return _passed(c.number, c.counts, at[hit], keys[hit], length, longer, min_words)

    replies = chunks.ask(corpus.mapInArrow(ask, chunks.cell_schema(1)), how, chunks.shared(), stage)
    return corpus.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(hear, _OUT)


def _extend(level: DataFrame, length: int, longer: int, min_words: int, stage: Stage, fan_in: int | None) -> DataFrame:
    """A further level, of candidates that carry their keys."""
    how = chunks.plan(level, "n", exact=True, fan_in=fan_in)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _sent(number, np.frombuffer(keys, "<u8"), None, how)

    def hear(left: pa.Table, replies: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        keys, places = np.frombuffer(row["keys"], "<u8"), _places(row["places"])
        hit = _repeated(keys, None, replies)
        return _passed(row["chunk"], chunks.unsqueeze(row["counts"], "<i8"), places[hit], keys[hit], length, longer, min_words)

    replies = chunks.ask(level.select("chunk", "keys").mapInArrow(ask, chunks.cell_schema(1)), how, chunks.shared(), stage)
    return level.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(hear, _OUT)


def _decide(corpus: DataFrame, level: DataFrame | None, length: int, stage: Stage, fan_in: int | None) -> DataFrame:
    """The level that decides, of candidates (None: all windows) hashed anew from their words."""
    every = level is None
    if every:
        marks = corpus.select("chunk", F.lit(None).cast("binary").alias("places"))
        how = chunks.plan(corpus, exact=True, fan_in=fan_in)
    else:
        marks = level.select("chunk", "places")
        how = chunks.plan(level, "n", exact=True, fan_in=fan_in)

    def windows(c: chunks.Chunk, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = [m for m in marks.to_pylist() if m["n"] is None]
        at = words.starts(c.counts, length) if every else _places(marks[0]["places"]) if marks else np.empty(0, np.int64)
        return at, *(_keys(c, length, at) if len(at) else (np.empty(0, "<u8"), np.empty(0, "<u4")))

    def ask(left: pa.Table, marks: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        sent = list(_sent(c.number, *windows(c, marks.append_column("n", pa.nulls(len(marks), pa.int64())))[1:], how))
        return pa.Table.from_batches(sent) if sent else chunks.no_cells(2)

    def hear(left: pa.Table, both: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        at, keys, checks = windows(c, both)
        hit = _repeated(keys, checks, both.filter(pc.is_valid(both["n"])))
        return _passed(c.number, c.counts, at[hit], keys[hit], length, 2 * length, length)

    sent = corpus.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(ask, chunks.cell_schema(2))
    replies = chunks.ask(sent, how, chunks.shared(checked=True), stage)
    both = replies.select("chunk", "bucket", "n", "reply0").unionByName(marks, allowMissingColumns=True)
    return corpus.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(hear, _OUT)
