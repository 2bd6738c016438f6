"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

Every window of a document that has as many words as some benchmark item is compared with the items
of that size.  Its 128-bit SimHash is looked up in a multi-index: fingerprints are cut into 8 blocks of 16
bits; two that differ in at most ``RADIUS`` bits differ in at most RADIUS // 8 = 4 bits of some block.  The
index holds each item's block values with up to 2 bits flipped, and a window asks for its own with up to 2
flipped, so every fingerprint within the radius is found.  Unlike fingerprints share a bucket with
probability 0.27 and come within the radius with 1e-5.  Candidates are verified by the exact weighted
Jaccard similarity of their 5-word shingles (weights: how often a shingle occurs; in the SimHash the n-th
occurrence of a shingle is a feature of its own).  At a similarity of 0.8 fingerprints differ in 19 bits on
average, with a deviation of 4: a match at the very threshold is out of reach with probability 1e-6.

Windows are pruned before hashing without loss: a window that passes has at least ``threshold`` times
its item's shingles in common with the item, so windows with fewer shingles of items of that size cannot
pass.  Those left are runs of neighbours; fingerprints and overlaps slide along a run, so that time
and memory are linear in the document and the item, however long both are.

The benchmark is a stated query set: it is read in blocks of items of at most ``BLOCK_WORDS`` words (or
one longer item) and ``BLOCK_ITEMS`` items, each broadcast in turn, so what is broadcast is bounded; a
block is a scan of the documents.  Documents are mapped only; nothing of them is shuffled or sent to the driver.

Words are compared in lower case, items and texts by the same function.  Nulls and ties: null, empty and
wordless items and texts match nothing; an item shorter than a shingle is one shingle of all its words; a
text shorter than an item is one window.  Of several windows of one document that match an item the most
similar counts, then the first.  Repeated rows and items each give their own results; null ids stay null; empty
tables give no rows.  Other columns are ignored, or kept by ``drop_contaminated``.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import words
from cairnmem.llm.staging import prepare

SHINGLE = 5
THRESHOLD = 0.8
BITS = 128
RADIUS = 39
BLOCK_ITEMS = 4096
BLOCK_WORDS = 1 << 21
_BLOCKS = BITS // 16
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Features whose bits are summed at once.
_SLICE = 1 << 15
#: All flips of up to half the bits in which a block may differ.
_FLIPS = np.array([sum(1 << b for b in bits) for k in range(RADIUS // _BLOCKS // 2 + 1) for bits in combinations(range(16), k)], np.int64)


def _feature(h: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The features of the nth occurrences of some shingles; of the first, the shingle."""
    return np.where(nth > 0, words.mix(h, nth.astype(np.uint64)), h)


def _signs(features: np.ndarray) -> np.ndarray:
    """1 or -1 for each bit of each feature."""
    halves = [words.mix(features, np.full(len(features), salt, np.uint64)).view(np.uint8).reshape(-1, 8) for salt in _SALTS]
    return 2 * np.unpackbits(np.concatenate(halves, axis=1), axis=1).astype(np.int8) - 1


class Windows:
    """All windows of m neighbours in a run of shingles, as one slides along."""

    def __init__(self, shingles: np.ndarray, m: int):
        self.kinds, kind = np.unique(shingles, return_inverse=True)
        self.m, self.n = m, len(shingles) - m + 1
        size = len(shingles) + 1
        order = np.sort(kind * size + np.arange(len(shingles)))
        first = np.searchsorted(order, kind[:m] * size)
        # Of the first window: which occurrence of its kind each shingle is.
        self._nth = np.searchsorted(order, kind[:m] * size + np.arange(m)) - first
        self._head = kind[:m]

        # What leaves and what comes as a window moves on, and how many of its kind the window had and has then.
        at = np.arange(self.n - 1)
        self.out, self.new = kind[at], kind[at + m]
        self.had = np.searchsorted(order, self.out * size + at + m) - np.searchsorted(order, self.out * size + at)
        self.has = np.searchsorted(order, self.new * size + at + m) - np.searchsorted(order, self.new * size + at + 1) + 1

    def prints(self) -> np.ndarray:
        """The fingerprint of each window, as 16 bytes."""
        features = _feature(self.kinds[self._head], self._nth)
        total = np.zeros(BITS, np.int64)
        for begin in range(0, self.m, _SLICE):
            total += _signs(features[begin : begin + _SLICE]).sum(axis=0, dtype=np.int64)
        out = [np.packbits(total > 0)[None, :]]
        for begin in range(0, self.n - 1, _SLICE):
            some = slice(begin, min(begin + _SLICE, self.n - 1))
            gone, come = _feature(self.kinds[self.out[some]], self.had[some] - 1), _feature(self.kinds[self.new[some]], self.has[some] - 1)
            sums = total + np.cumsum(_signs(come) - _signs(gone), axis=0, dtype=np.int32)
            out.append(np.packbits(sums > 0, axis=1))
            total = sums[-1].astype(np.int64)
        return np.concatenate(out)

    def similarities(self, kinds: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of each window with a bag of sorted kinds."""
        at = np.minimum(np.searchsorted(kinds, self.kinds), len(kinds) - 1)
        most = np.where(kinds[at] == self.kinds, times[at], 0)
        both = np.minimum(np.bincount(self._head, minlength=len(most)), most).sum()
        steps = (self.has <= most[self.new]).astype(np.int64) - (self.had <= most[self.out])
        both = both + np.concatenate([[0], np.cumsum(steps)])
        return both / (self.m + times.sum() - both)


def _runs(places: np.ndarray, need: int, m: int, last: int) -> list[tuple[int, int]]:
    """First and last starts, up to ``last``, of the runs of windows of m that hold ``need`` of some places."""
    if len(places) < need:
        return []
    low = np.maximum(places[need - 1 :] - m + 1, 0)
    high = np.minimum(places[: len(places) - need + 1], last)
    low, high = low[low <= high], high[low <= high]
    if not len(low):
        return []
    cuts = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
    return list(zip(low[np.concatenate([[0], cuts])].tolist(), high[np.concatenate([cuts - 1, [len(high) - 1]])].tolist(), strict=True))


class Index:
    """Some benchmark items, by size in words, with their shingles and the multi-index.

    ``sizes``: of each size in words the ids, the bags (sorted shingles and how often each occurs) and the
    fingerprints of its items.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold, self.radius = threshold, radius
        by_size: dict[int, list[tuple[int | None, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            low, n = words.split(pc.utf8_lower(pa.array([text or ""], pa.string())))
            if n[0]:
                by_size[int(n[0])].append((item_id, words.windows(words.hashes(low), min(SHINGLE, int(n[0])))))
        self.sizes, self._index = {}, {}
        for n, found in sorted(by_size.items()):
            prints = np.concatenate([Windows(s, len(s)).prints() for _, s in found])
            self.sizes[n] = ([i for i, _ in found], [np.unique(s, return_counts=True) for _, s in found], prints)
            keys = self._asked(prints)
            order = np.argsort(keys, axis=None)
            self._index[n] = (keys.ravel()[order], (order // keys.shape[1]).astype(np.int32))
        # By length of shingles: the sorted shingles, and for each the places in ``sizes`` of items that hold it.
        self._known = {}
        for k in {min(SHINGLE, n) for n in self.sizes}:
            own = [(j, bag[0]) for j, n in enumerate(self.sizes) if min(SHINGLE, n) == k for bag in self.sizes[n][1]]
            pairs = np.unique(np.array([(s, j) for j, bag in own for s in bag.tolist()], np.dtype([("s", "<u8"), ("j", "<u8")])))
            known, first = np.unique(pairs["s"], return_index=True)
            self._known[k] = (known, np.append(first, len(pairs)), pairs["j"].astype(np.int64))

    @staticmethod
    def _asked(prints: np.ndarray) -> np.ndarray:
        """What each fingerprint is looked up by: block and value, with up to half the reach flipped."""
        blocks = prints.reshape(len(prints), _BLOCKS, 2).astype(np.int64)
        values = blocks[:, :, 0] << 8 | blocks[:, :, 1]
        keys = (np.arange(_BLOCKS) << 16)[None, :, None] | (values[:, :, None] ^ _FLIPS)
        return keys.reshape(len(prints), -1).astype(np.int32)

    def _candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) pairs whose fingerprints differ in at most radius bits."""
        items, (keys, item) = self.sizes[n][2], self._index[n]
        found = []
        for begin in range(0, len(prints), 512):
            asked = self._asked(prints[begin : begin + 512])
            first = np.searchsorted(keys, asked.ravel())
            hit = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == asked.ravel())
            count = np.searchsorted(keys, asked.ravel()[hit], side="right") - first[hit]
            at = np.repeat(first[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(np.unique(np.repeat(begin + hit // asked.shape[1], count) * len(items) + item[at]))
        pairs = np.concatenate(found) if found else np.empty(0, np.int64)
        w, i = pairs // len(items), pairs % len(items)
        close = _POP[prints[w] ^ items[i]].sum(axis=1) <= self.radius
        return zip(w[close].tolist(), i[close].tolist(), strict=True)

    def matches(self, texts: pa.Array | pa.ChunkedArray) -> list[tuple[int, int | None, int, int, float]]:
        """(row, item, first word, words, similarity) of the best window of each row and item."""
        flat, counts = words.split(pc.utf8_lower(texts.cast(pa.string())))
        distinct, ids = words.coded(flat)
        h = words.hashes(distinct)[ids]
        ends = np.cumsum(counts)
        sizes = np.array(list(self.sizes), np.int64)
        best: dict[tuple[int, int, int], tuple[float, int, int]] = {}
        for k, (known, first, holders) in self._known.items():
            # Where a shingle of some item starts: few places, found by its low bits first.
            all_k = words.windows(h, k)
            table = np.zeros(1 << 20, bool)
            table[known & np.uint64((1 << 20) - 1)] = True
            at = np.flatnonzero(table[all_k & np.uint64((1 << 20) - 1)])
            of = np.minimum(np.searchsorted(known, all_k[at]), len(known) - 1)
            row = np.searchsorted(ends, at, side="right")
            good = (known[of] == all_k[at]) & (at + k <= ends[np.minimum(row, len(ends) - 1)])
            at, of, row = at[good], of[good], row[good]
            # By row and size of items, the places of shingles that such items hold.
            times = first[of + 1] - first[of]
            size = holders[np.repeat(first[of] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            at, row = np.repeat(at, times), np.repeat(row, times)
            order = np.lexsort((at, size, row))
            at, row, size = at[order], row[order], size[order]
            cuts = np.flatnonzero(np.diff(row * len(sizes) + size, prepend=-1))
            stops = np.append(cuts[1:], len(at))
            # A window of fewer shingles than the item's must hold as many of them.
            need = np.ceil(self.threshold * (sizes[size[cuts]] - k + 1) - 1e-9)
            for a, b in zip(cuts[stops - cuts >= need].tolist(), stops[stops - cuts >= need].tolist(), strict=True):
                r, begin = int(row[a]), int(ends[row[a]] - counts[row[a]])
                self._windows(r, int(sizes[size[a]]), k, all_k[begin : int(ends[r]) - k + 1], at[a:b] - begin, best)
        return [(r, self.sizes[n][0][i], first, size, s) for (r, n, i), (s, first, size) in best.items()]

    def _windows(self, r: int, n: int, k: int, own: np.ndarray, places: np.ndarray, best: dict) -> None:
        """The windows of n words of one document, whose shingles are ``own``, of items at some ``places``."""
        m = min(n - k + 1, len(own))
        if m == 1:  # Windows that are one shingle: the first of each kind is as good as all.
            places = np.sort(places[np.unique(own[places], return_index=True)[1]])
        for low, high in _runs(places, int(np.ceil(self.threshold * (n - k + 1) - 1e-9)), m, len(own) - m):
            run = Windows(own[low : high + m], m)
            near = defaultdict(list)
            for w, i in self._candidates(n, run.prints()):
                near[i].append(w)
            for i, some in near.items():
                similar = run.similarities(*self.sizes[n][1][i])[some]
                j = int(np.argmax(similar))
                s, at = float(similar[j]), low + some[j]
                if s >= self.threshold - 1e-12 and s > best.get((r, n, i), (0.0, 0, 0))[0]:
                    best[r, n, i] = (s, at, m + k - 1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[object]:
    """Broadcast indexes of the benchmark, a block of items at a time."""
    prepare(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    block: list[tuple[int | None, str | None]] = []
    size = 0
    for row in items.toLocalIterator():
        n = len((row[1] or "").split())
        if block and (len(block) == BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield benchmark.sparkSession.sparkContext.broadcast(Index(block, threshold))
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield benchmark.sparkSession.sparkContext.broadcast(Index(block, threshold))


def find(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of each document and item that match."""
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for held in _blocks(benchmark, item_col, item_text_col, threshold):

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for table in words.text_chunks(batches):
                found = held.value.matches(table["text"])
                ids = table["doc_id"].take(pa.array([f[0] for f in found], pa.int64())).combine_chunks()
                cols = [ids if isinstance(ids, pa.Array) else pa.array([], pa.int64())]
                cols += [pa.array([f[i] for f in found], pa.float64() if i == 4 else pa.int64()) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        out = out.unionByName(docs.mapInArrow(work, schema))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs, with all their columns, without those that match any item."""
    for held in _blocks(benchmark, item_col, item_text_col, threshold):
        docs = docs.where(_clean(held)(F.col(f"`{text_col}`").cast("string")))
    return docs


def _clean(held):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        out = np.ones(len(text), bool)
        done = 0
        for table in words.text_chunks(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
            out[[done + m[0] for m in held.value.matches(table["text"])]] = False
            done += table.num_rows
        return pa.array(out)

    return clean
