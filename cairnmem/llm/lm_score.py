"""Language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of orders 2, 1 and 0 (uniform over the
vocabulary and one unknown token).  The weights depend on how often the context was seen, in buckets
of powers of two.  They are learned by expectation-maximisation on a part of the training documents,
with counts from which that part has been deleted; scores then use the counts of all training
documents.  The mixture is a proper distribution for every context.

Counts cover all training documents: every chunk sends its n-grams with their counts to the buckets
of ``chunks`` and gets the corpus counts back, so no count table is ever in one place.  N-grams are
equal where 64 bits of a hash and further bits of an independent one are, 32 for words and 16 for pairs: among
1e12 different pairs 0.4 are expected to share their counts by accident, among 1e10 words none (6e-10).  The weights are learned from a
histogram of the deleted part's tokens by context bucket and by the two estimates' logarithms, in steps
of half a power of two; a cell keeps the means of the logarithms of its tokens, which stand for them.
At most ``CONTEXT_BUCKETS * SPAN**2`` cells (33 MB) reach the driver, whatever the corpus.

Tokens are words, A-Z in lower case, and one end per document.

Nulls and ties: a null or empty text is the end token alone.  A null doc_id counts as not held out.
Repeated rows count and are scored each.  Without training documents every probability is 1.  An
empty table gives no rows.  Other columns are ignored.  Very long texts: a text is never cut; one that is
longer than a chunk is a chunk of its own, and its words must fit in a task.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmem.llm import chunks, words
from cairnmem.llm.staging import Stage

FOLDS, HELD_OUT = 7, 2
#: One training document in so many is deleted while the weights are learned.
DELETED = 8
CONTEXT_BUCKETS = 40
EM_ROUNDS = 60
#: Further bits by which words, and pairs, must agree.
_CHECK_WORD, _CHECK_PAIR = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)
#: Cells of the histogram: steps in a power of two, and steps of an estimate; the outermost take what lies beyond.
STEPS, SPAN = 2, 160
_END, _START, _UNIGRAM = (np.uint64(x) for x in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B))


@dataclass
class Ngrams:
    """Tokens of a chunk, as codes, and their n-grams, as keys."""

    tokens: np.ndarray
    pairs: np.ndarray
    pair_of: np.ndarray
    contexts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    key_of: np.ndarray
    owner: np.ndarray
    n_codes: int

    @classmethod
    def of(cls, c: chunks.Chunk) -> "Ngrams":
        end = len(c.vocab)
        stops = np.cumsum(c.counts + 1) - 1
        tokens = np.full(len(c.ids) + len(c.counts), end, np.int64)
        inside = np.ones(len(tokens), bool)
        inside[stops] = False
        tokens[inside] = c.ids
        before = np.roll(tokens, 1)
        before[stops - c.counts] = end + 1
        pairs, pair_of = np.unique(before * (end + 2) + tokens, return_inverse=True)
        contexts, nexts = pairs // (end + 2), pairs % (end + 2)

        def grams(h: np.ndarray) -> np.ndarray:
            h = np.append(h, [_END, _START])
            return np.concatenate([words.mix(h[: end + 1], np.full(end + 1, _UNIGRAM)), words.mix(h[contexts], h[nexts])])

        keys, checks = (grams(h) for h in words.halves(c.vocab))
        checks = (checks & np.where(np.arange(len(checks)) <= end, _CHECK_WORD, _CHECK_PAIR)).astype("<u4")
        key_of, first = words.ranked(keys, checks)
        owner = np.repeat(np.arange(len(c.counts)), c.counts + 1)
        return cls(tokens, pairs, pair_of, contexts, keys[first], checks[first], key_of, owner, end + 1)

    def counted(self, weight: np.ndarray) -> np.ndarray:
        """By key, how often its n-gram stands in documents of weight 1."""
        w = weight[self.owner].astype(np.float64)
        counts = np.concatenate([np.bincount(self.tokens, w, self.n_codes), np.bincount(self.pair_of, w, len(self.pairs))])
        return np.bincount(self.key_of, counts, len(self.keys)).astype("<i8")

    def parted(self, by_key: np.ndarray, documents: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By pair: the counts of the pair, its context (``documents`` for a start) and its token."""
        own = by_key[self.key_of].astype(np.float64)
        unigram, pair = own[: self.n_codes], own[self.n_codes :]
        return pair, np.append(unigram, documents)[self.contexts], unigram[self.pairs % (self.n_codes + 1)]

    def summed(self, by_pair: np.ndarray, documents: int) -> np.ndarray:
        """Sums of what the pairs have, by document."""
        return np.bincount(self.owner, by_pair[self.pair_of], documents)


def _remainders(c: chunks.Chunk) -> np.ndarray:
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) for i in c.doc_ids.to_pylist()], np.int64)


def _held_out(crc: np.ndarray) -> np.ndarray:
    return (crc >= 0) & (crc % FOLDS == HELD_OUT)


def _deleted(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string"))
    return F.coalesce((crc % FOLDS != HELD_OUT) & (F.floor(crc / FOLDS) % DELETED == 0), F.lit(False))


def _context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1).astype(np.int64), CONTEXT_BUCKETS - 1)


def learn(bucket: np.ndarray, two: np.ndarray, one: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (context bucket, order 0 to 2) from held-out tokens, n of each kind.

    ``two`` and ``one`` are the estimates of order 2 and 1 over that of order 0.
    """
    p = np.column_stack([np.ones(len(n)), one, two])

    def em(p: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = prior / prior.sum()
        for _ in range(rounds):
            part = p * w
            w = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) + prior
            w /= w.sum()
        return w

    pooled = em(p, n, np.full(3, 1e-2)) if len(n) else np.array([1.0, 0.0, 0.0])
    out = np.tile(pooled, (CONTEXT_BUCKETS, 1))
    for b in np.unique(bucket):
        own = bucket == b
        out[b] = em(p[own], n[own], pooled + 1e-6)
    return out


def _log2(ratio: np.ndarray) -> np.ndarray:
    """Logarithms of estimates; of an estimate of nothing, 0."""
    return np.log2(ratio, out=np.zeros_like(ratio), where=ratio > 0)


def _steps(ratio: np.ndarray) -> np.ndarray:
    """Cells of some estimates; 0 is an estimate of nothing."""
    return np.where(ratio > 0, np.clip(np.round(_log2(ratio) * STEPS) + SPAN // 2, 1, SPAN - 1), 0).astype(np.int64)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``fan_in`` is how many chunks one level of the exchange takes."""
    spark = docs.sparkSession
    stage = Stage(spark, "lm-score")
    deleted = _deleted(F.col(id_col).cast("long"))
    rest = chunks.tokenised(docs.where(~deleted), stage, True, id_col, text_col)
    part = chunks.tokenised(docs.where(deleted), stage, True, id_col, text_col, series=1)
    corpus = rest.unionByName(part)
    how = chunks.plan(corpus, exact=True, fan_in=fan_in)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = chunks.Chunk.of(pa.table(batch.slice(i, 1)))
                grams = Ngrams.of(c)
                train = ~_held_out(_remainders(c))
                unigram = np.zeros(len(grams.keys), bool)
                unigram[grams.key_of[: grams.n_codes]] = True
                gone = train if c.number >= chunks.SERIES else np.zeros(len(train), bool)
                notes = [grams.checks, grams.counted(train), grams.counted(gone), unigram]
                yield from chunks.cells(c.number, grams.keys, notes, how.sent, how.rest)

    def total(group: np.ndarray, notes: list[np.ndarray]) -> list[np.ndarray]:
        return [*(np.bincount(group, x).astype("<i8") for x in notes[:2]), np.bincount(group, notes[2]) > 0]

    def counts(notes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        (all_, gone), unigram = notes[:2], notes[2]
        left = all_ - gone
        sums = [all_[unigram].sum(), (all_[unigram] > 0).sum(), left[unigram].sum(), (left[unigram] > 0).sum()]
        return [all_, gone], np.array(sums, np.int64)

    what = chunks.Question(["<u4", "<i8", "<i8", "bool"], ["<i8", "<i8"], total, counts, checked=True)
    replies = chunks.ask(corpus.mapInArrow(ask, chunks.cell_schema(4)), how, what, stage)
    sums = replies.where("sums is not null").agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).first()
    n, v, n_left, v_left = (int(x or 0) for x in sums)
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    counted = docs.agg(F.count_if(~held), F.count_if(~held & ~deleted)).first()
    starts, starts_left = (int(x or 0) for x in counted)

    def histogram(left: pa.Table, answer: pa.Table) -> pa.Table:
        grams = Ngrams.of(chunks.Chunk.of(left))
        count = chunks.reply(answer, "<i8") - chunks.reply(answer, "<i8", 1)
        pair, context, own = grams.parted(count, starts_left)
        two = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0) * (v_left + 1)
        one = own / max(n_left, 1) * (v_left + 1)
        bucket, times = _context_bucket(context), np.bincount(grams.pair_of, minlength=len(pair))
        cells, of = np.unique((bucket * SPAN + _steps(two)) * SPAN + _steps(one), return_inverse=True)
        sums = [np.bincount(of, times * x, len(cells)) for x in (np.ones(len(times)), _log2(two), _log2(one))]
        return pa.table({"cell": pa.array(cells, pa.int64())} | {k: pa.array(x) for k, x in zip(("n", "two", "one"), sums, strict=True)})

    of_part = part.groupBy("chunk").cogroup(replies.where(F.col("chunk") >= chunks.SERIES).groupBy("chunk"))
    found = of_part.applyInArrow(histogram, "cell long, n double, two double, one double")
    # At most CONTEXT_BUCKETS * SPAN**2 rows.
    found = found.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "two", "one"))).toPandas().sort_values("cell")
    cell, n_of = found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    two, one = (np.where(k > 0, np.exp2(found[c].to_numpy() / np.maximum(n_of, 1)), 0.0) for c, k in (("two", cell // SPAN % SPAN), ("one", cell % SPAN)))
    weights = learn(cell // SPAN**2, two, one, n_of)

    def score(left: pa.Table, answer: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        grams = Ngrams.of(c)
        pair, context, own = grams.parted(chunks.reply(answer, "<i8"), starts)
        w = weights[_context_bucket(context)]
        two = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        log = np.log10(w[:, 0] / (v + 1) + w[:, 1] * own / max(n, 1) + w[:, 2] * two)
        base = np.log10((own + 1) / (n + 1 * (v + 1)))
        d = len(c.counts)
        return pa.table(
            {
                "doc_id": c.doc_ids,
                "held_out": pa.array(_held_out(_remainders(c))),
                "n_tokens": pa.array(c.counts + 1),
                "n_known": pa.array(grams.summed((own > 0).astype(np.float64), d).astype(np.int64)),
                "train_tokens": pa.array(np.full(d, n, np.int64)),
                "base_score": pa.array(grams.summed(base, d)),
                "score": pa.array(grams.summed(log, d)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, schema)
