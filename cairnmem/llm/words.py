"""Words of whole texts as arrays: splitting, hashing, windows, and tokenised chunks.

A word is a maximal run of bytes other than ASCII white space, ``[^\\x20\\x09-\\x0D]+``.  All work is
on arrays of a few million words, so that a task's memory depends on the chunk size and its longest
document, not on the input.

Words and windows are named by 64-bit hashes.  Two different ones share a hash with probability
2**-64; what needs more uses both halves of ``halves``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once, and rows (of which many may be empty).
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS
) -> Iterator[pa.Table]:
    """The rows of some batches, as tables of about ``limit`` bytes of text (or one longer text) and at
    most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size, rows = 0, 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, before = 0, 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            stop = min(stop, batch.num_rows, begin + most - rows)
            held.append(batch.slice(begin, stop - begin))
            size, rows = size + int(ends[stop - 1]) - before, rows + stop - begin
            begin, before = stop, int(ends[stop - 1])
            if size >= limit or rows >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def split(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and the number of words of each; a null text has none.

    ``lower`` lower-cases A-Z only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # of no chunks
        texts = pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
    return (flat if filled.all() else flat.filter(pa.array(filled))), np.diff(ends).astype(np.int64)


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and each word's place among them."""
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def halves(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    raw = b"".join(map(xxhash.xxh3_128_digest, words.cast(pa.large_binary()).to_pylist()))
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def ranked(keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each (key, check), its place among the sorted distinct ones; and where one of each stands."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def news(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys[order]
        own = np.concatenate([[True], k[1:] != k[:-1]])
        c = check[order] if check is not None else k
        return own, np.concatenate([[True], c[1:] != c[:-1]])

    order = np.argsort(keys)
    new, other = news(order)
    if (other & ~new).any():  # two checks of one key, which must stand together
        order = np.lexsort((check, keys))
        new, other = news(order)
    new |= other
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order[new]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which for many different values beats hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    x = a * _K1 + (b ^ (b >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n hashes that start at each place; len(h) - n + 1 of them.

    Runs of 1, 2, 4, ... are hashed by doubling, and those of the binary digits of n put together.
    """
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out, done, run, length = None, 0, h, 1
    while True:
        if n & length:
            part = run[done : done + size]
            out = part if out is None else mix(out, part)
            done += length
        if done == n:
            return out.copy() if out is h else out
        run = mix(run[:-length], run[length:])
        length *= 2


def starts(counts: np.ndarray, n: int) -> np.ndarray:
    """Places, among the words of some documents, where a window of n words of one document starts."""
    ends = np.cumsum(counts)
    valid = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return valid[valid + n <= np.repeat(ends, counts)]
