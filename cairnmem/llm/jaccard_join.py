"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word n-grams; two link when the Jaccard similarity of their sets reaches a
threshold.  The result names the components of these links.

1. Every chunk asks the buckets of ``chunks`` which n-grams occur in more than one document.  A
   document with too few shared n-grams cannot link, and drops out; so do n-grams of one document.
2. Equal sets become one representative.  The n-grams of representatives get a global order, rare
   ones first, from their document frequencies (which the buckets count).
3. The order is cut into fragments of equal weight, and every set into a segment for each.  Candidate
   pairs share an n-gram of their prefixes, have lengths that allow the threshold, and stand so in
   the order at that n-gram that the overlap can still suffice; all three tests lose no link.
4. Candidates are verified by counting the overlap of each fragment separately and summing per pair.

Candidates come in rounds.  In a list of the documents of a prefix n-gram, each document is first
paired with leaders of the list (others each round): one pair a document, then four, and so on
up to ``MAX_LEADERS``; documents that are connected already need no pair.  A list that has few pairs between different
components left after the first round has them verified at once, and is left out of later rounds.  When a round connects nothing
more, all remaining pairs within a list, between different components, are verified.  So a large group of near copies costs a
few pairs a member, and no link between different components is ever skipped.

Lists, leaders and labels are plain tables.  The entries of a list meet its leaders in ``SALTS`` parts; what else
is joined on a hot key is a join of two exchanges, which adaptive execution may split.  Sets are compared by 64-bit n-gram hashes.

Nulls and ties: a null or empty text has the empty set, size 0, and links with nothing.  A text
shorter than an n-gram is one n-gram of all of its words.  component_id is the smallest doc_id of the
component, nulls last, so it is null only where all are.  Repeated rows are linked like any equal
texts.  An empty table gives no rows.  Other columns are ignored, or kept by ``drop_near_copies``.  A very
long text is a chunk of its own, whose words must fit in a task; its set is verified a fragment at a time.

Rounds and leaders only set how soon pairs are tested: what they leave is tested in full.  In a hot list, documents
near its leader are paired by the n-grams that they differ from it in, the others by the list.  That last step is still
quadratic in the documents of one list that are far from its leader, or whose differences share an n-gram, where they
could link by size and place, and yet do not.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.llm import chunks, words
from cairnmem.llm.components import components
from cairnmem.llm.staging import Stage

FRAGMENTS = 8
#: Rounds of leaders, and leaders of a list in one, before the rest is tested pair by pair.
MAX_ROUNDS = 5
PAIRS_PER_ENTRY = 1
MAX_LEADERS = 64
#: Parts of a list in the joins of its entries with what there is once a list, and the entries from which leaders come in parts.
SALTS = 8
HOT_LIST = 256
#: Distinct n-grams of representatives in a block of the second exchange, about.
BLOCK_KEYS = 1 << 20


def shingles(c: chunks.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, n-gram) of a chunk, by document, then by hash."""
    h, owners = c.hashes(), c.owners()
    at = words.starts(c.counts, n)
    owner, key = [owners[at]], [words.windows(h, n)[at]]
    begins = np.cumsum(c.counts) - c.counts
    for length in range(1, n):
        short = np.flatnonzero(c.counts == length)
        if len(short):
            whole = words.windows(h, length)[begins[short]]
            owner.append(short)
            key.append(words.mix(whole, np.full(len(short), length, np.uint64)))
    codes, of = np.unique(np.concatenate(key), return_inverse=True)
    pairs = words.distinct(np.concatenate(owner) * np.int64(max(len(codes), 1)) + of)
    return pairs // max(len(codes), 1), codes[pairs % max(len(codes), 1)]


def _sets(corpus: DataFrame, n: int, percent: int, stage: Stage) -> DataFrame:
    """Of each document: row, doc_id, mark, size, digest and the shared n-grams, null where it cannot link."""
    how = chunks.plan(corpus)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = chunks.Chunk.of(pa.table(batch.slice(i, 1)))
                keys, times = np.unique(shingles(c, n)[1], return_counts=True)
                yield from chunks.cells(c.number, keys, [times > 1], how.sent, how.rest)

    def gather(left: pa.Table, replies: pa.Table) -> pa.Table:
        c = chunks.Chunk.of(left)
        owner, key = shingles(c, n)
        distinct, of = np.unique(key, return_inverse=True)
        common = chunks.reply(replies, "bool")[of] if len(distinct) else np.empty(0, bool)
        size = np.bincount(owner, minlength=len(c.counts))
        left_over = np.bincount(owner, common, minlength=len(c.counts)).astype(np.int64)
        ends = np.cumsum(left_over)
        kept = key[common].astype("<u8")
        rows, blobs, digests = c.rows(), [None] * len(c.counts), [None] * len(c.counts)
        for d in np.flatnonzero((left_over > 0) & (100 * left_over >= percent * size)):
            blobs[d] = kept[ends[d] - left_over[d] : ends[d]].tobytes()
            # Only sets that are shared as a whole can have an equal.
            digests[d] = xxhash.xxh3_128_digest(blobs[d] if left_over[d] == size[d] else b"row %d" % rows[d])
        return pa.table(
            {
                "row": pa.array(rows), "doc_id": c.doc_ids, "mark": c.marks, "size": pa.array(size.astype(np.int64)),
                "digest": pa.array(digests, pa.binary()), "keys": pa.array(blobs, pa.binary()),
            }
        )

    replies = chunks.ask(corpus.mapInArrow(ask, chunks.cell_schema(1)), how, chunks.shared(), stage)
    sets = corpus.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        gather, "row long, doc_id long, mark long, size long, digest binary, keys binary"
    )
    sets = stage.write(sets, "sets")
    stage.drop(replies)
    return sets


def _blocks(sets: DataFrame, stage: Stage) -> DataFrame:
    """Sets (row, size, keys), some thousand together: chunk, n_keys, rows, sizes, lengths, keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 16, []

        def block() -> pa.RecordBatch:
            rows, sizes, keys = zip(*held, strict=True)
            lengths = np.array([len(k) // 8 for k in keys], "<i8")
            cols = [np.array(rows, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), lengths.tobytes(), b"".join(keys)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([int(lengths.sum())]), *(pa.array([c], pa.binary()) for c in cols)],
                names=["chunk", "n_keys", "rows", "sizes", "lengths", "keys"],
            )

        total = 0
        for batch in batches:
            for row, size, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((row, size, keys))
                total += len(keys) // 8
                if total >= BLOCK_KEYS:
                    yield block()
                    number, held, total = number + 1, [], 0
        if held:
            yield block()

    schema = "chunk long, n_keys long, rows binary, sizes binary, lengths binary, keys binary"
    return stage.write(sets.select("row", "size", "keys").mapInArrow(work, schema), "blocks")


def _bin(frequency: np.ndarray) -> np.ndarray:
    """Document frequencies in steps of an eighth of a power of two; 0 for a frequency of 1."""
    return np.minimum(np.ceil(np.log2(np.maximum(frequency, 1)) * 8), 255).astype(np.uint8)


def _place(bins: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in the global order: by bin, then by hash."""
    return (bins.astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8))


def _pivots(mass: np.ndarray) -> np.ndarray:
    """Places that cut the n-grams of frequency over 1 into fragments of equal weight."""
    mass = mass.astype(np.float64)
    mass[0] = 0
    ends = np.cumsum(mass)
    out = []
    for k in range(1, FRAGMENTS):
        at = ends[-1] * k / FRAGMENTS
        b = min(int(np.searchsorted(ends, at)), 255)
        inside = (at - (ends[b] - mass[b])) / mass[b] if mass[b] else 0.0
        out.append((b << 56) + min(int(inside * 2.0**56), 2**56 - 1))
    return np.array(out, np.uint64)


_CUT = {
    "token": pa.int64(), "row": pa.int64(), "size": pa.int64(), "pos": pa.int64(), "hot": pa.bool_(), "fragment": pa.int64(),
    "keys": pa.list_(pa.int64()),
}


def _cut(blocks: DataFrame, percent: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The prefix index (token, row, size, pos, and whether a hot list is possible) and the segments (row, size, fragment, keys)."""
    how = chunks.plan(blocks, "n_keys")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct, times = np.unique(np.frombuffer(keys, "<u8"), return_counts=True)
                yield from chunks.cells(number, distinct, [times.astype("<u8")], how.sent, how.rest)

    def bins(notes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        return [_bin(notes[0])], np.bincount(_bin(notes[0]), notes[0], 256).astype(np.int64)

    frequency = chunks.Question(["<u8"], ["<u1"], lambda group, notes: [np.bincount(group, notes[0]).astype("<u8")], bins)
    replies = chunks.ask(blocks.select("chunk", "keys").mapInArrow(ask, chunks.cell_schema(1)), how, frequency, stage)
    mass = replies.where("sums is not null").select(F.posexplode("sums").alias("bin", "mass")).groupBy("bin").agg(F.sum("mass").alias("mass"))
    of_bin = np.zeros(256, np.int64)
    for r in mass.collect():
        of_bin[r["bin"]] = r["mass"]
    pivots = _pivots(of_bin)

    def cut(left: pa.Table, replies: pa.Table) -> pa.Table:
        block = left.slice(0, 1).to_pylist()[0]
        rows, sizes, lengths = (np.frombuffer(block[c], "<i8") for c in ("rows", "sizes", "lengths"))
        keys, owner = np.frombuffer(block["keys"], "<u8"), np.repeat(np.arange(len(rows)), lengths)
        _, of = np.unique(keys, return_inverse=True)
        bins = chunks.reply(replies, "<u1")[of]
        some = bins > 0
        m = np.bincount(owner, some, minlength=len(rows)).astype(np.int64)
        some &= (100 * m >= percent * sizes)[owner]
        keys, owner, bins = keys[some], owner[some], bins[some]
        place = _place(bins, keys)
        order = np.lexsort((keys, place, owner))
        keys, owner, place = keys[order], owner[order], place[order]
        starts = np.searchsorted(owner, np.arange(len(rows)))
        # N-grams of one document come first in the order.
        pos = np.arange(len(keys)) - starts[owner] + (sizes - m)[owner]
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        lead = np.flatnonzero(pos < prefix[owner])
        fragment = np.searchsorted(pivots, place, side="right")
        edges = np.flatnonzero(np.diff(owner * FRAGMENTS + fragment, prepend=-1))
        index = {"token": keys[lead].view(np.int64), "row": rows[owner[lead]], "size": sizes[owner[lead]], "pos": pos[lead]}
        # No list is longer than the n-gram is frequent.
        index["hot"] = bins[order][lead] >= _bin(np.array([HOT_LIST]))[0]
        segments = {
            "row": rows[owner[edges]], "size": sizes[owner[edges]], "fragment": fragment[edges].astype(np.int64),
            "keys": pa.ListArray.from_arrays(pa.array(np.append(edges, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64))),
        }
        return pa.concat_tables([
            pa.table({k: pa.array(t[k], kind) if k in t else pa.nulls(len(t["row"]), kind) for k, kind in _CUT.items()}) for t in (index, segments)
        ])

    found = blocks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        cut, "token long, row long, size long, pos long, hot boolean, fragment long, keys array<long>"
    )
    found = stage.write(found.withColumn("kind", F.when(F.col("fragment").isNull(), "index").otherwise("segment")), "cut", by="kind")
    stage.drop(replies)
    return (
        found.where("kind = 'index'").select("token", "row", "size", "pos", "hot"),
        found.where("kind = 'segment'").select("row", "size", "fragment", "keys"),
    )


def _can_link(percent: int, size: Column, pos: Column, size_2: Column, pos_2: Column) -> Column:
    """Whether sizes and places at a common n-gram allow the threshold."""
    return (100 * F.least(size, size_2) >= percent * F.greatest(size, size_2)) & (
        (100 + percent) * F.least(size - pos, size_2 - pos_2) >= percent * (size + size_2)
    )


def _dealt(entries: DataFrame, hot: Column | None = None) -> DataFrame:
    """Entries of (hot) lists dealt to ``SALTS`` parts, so that no task gets all of an n-gram that many have."""
    part = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    return entries.withColumn("salt", part if hot is None else F.when(hot, part).otherwise(0))


def _every(lists: DataFrame, hot: Column | None = None) -> DataFrame:
    """What there is of each list, for every part of it."""
    parts = F.array(*map(F.lit, range(SALTS)))
    return lists.withColumn("salt", F.explode(parts if hot is None else F.when(hot, parts).otherwise(F.array(F.lit(0)))))


class _Join:
    """The rounds of candidates and their verification."""

    def __init__(self, index: DataFrame, segments: DataFrame, percent: int, stage: Stage):
        self.segments, self.percent, self.stage = segments, percent, stage
        self.index = index
        self.labels = stage.write(index.select("row", F.col("row").alias("root")).distinct(), "labels")
        self.tested = index.sparkSession.createDataFrame([], "a long, b long")

    def run(self, rounds: int = MAX_ROUNDS) -> None:
        """Connect everything that links."""
        leaders = 1
        for k in range(rounds):
            many = self._open()
            # Where a list has pairs in proportion to its entries, they are looked at directly; more are thinned out by leaders.
            if k and not many or not self._star(k, leaders):
                break
            leaders = min(4 * leaders, MAX_LEADERS)
        else:
            self._open()
        self._rest()

    def _open(self) -> bool:
        """Keep the entries of lists that hold more than one component, as the others never open again; whether any
        of them holds more than ``PAIRS_PER_ENTRY`` pairs of different components an entry, and so not few."""
        entries = self.stage.write(self.index.select("token", "row", "size", "pos", "hot").join(self.labels, "row"), "entries")
        parts = entries.groupBy("token", "root", "hot").agg(F.count("*").cast("double").alias("n"))
        pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
        tokens = parts.groupBy("token", "hot").agg(pairs.alias("p"), F.sum("n").alias("n"), F.max(F.struct("n", "root"))["root"].alias("major"))
        tokens = tokens.where("p > 0").withColumn("few", F.col("p") <= PAIRS_PER_ENTRY * F.col("n"))
        tokens = self.stage.write(tokens.select("token", "hot", F.col("n").cast("long"), "major", "few"), "tokens")
        hot = F.col("hot")
        self.index = self.stage.write(_dealt(entries, hot).join(_every(tokens, hot).drop("hot"), ["token", "salt"]).drop("salt"), "open")
        self.stage.drop(entries)
        return bool(tokens.where("not few").limit(1).count())

    def _few(self) -> DataFrame:
        """All pairs of different components in lists with few of them.

        One of the two is not of the list's largest component, so the join makes at most four times as many.
        """
        lists = self.index.where("few")
        x, y = (lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "pos", "root", "major"))) for s in "ab")
        fits = _can_link(self.percent, F.col("size_a"), F.col("pos_a"), F.col("size_b"), F.col("pos_b"))
        once = (F.col("row_a") < F.col("row_b")) | (F.col("root_b") == F.col("major_b"))
        pairs = x.where("root_a != major_a").join(y, "token").where(once & (F.col("root_a") != F.col("root_b")) & fits)
        return pairs.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))

    def _met(self, entries: DataFrame) -> DataFrame:
        """Entries, with the number of entries that the lists of their document hold."""
        return entries.join(self.stage.write(entries.groupBy("row").agg(F.sum("n").alias("met")), "met"), "row")

    def _untested(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.tested, ["a", "b"], "left_anti")

    def _star(self, seed: int, leaders: int) -> bool:
        """Up to so many pairs a document, with leaders of its lists; whether any documents were connected.  After
        the first round, lists with few pairs have all of them tested instead, and are done with.

        A list is dealt by hash, and each part has one leader: the document whose lists hold most entries, which has few
        n-grams of its own and so is amid its near copies.  A document takes those that most of its lists name.  Pairs that were tested before are left out at the end, where they are few and dealt by pair.
        """
        deal = F.xxhash64("row", F.lit(seed))
        lead = F.min(F.struct((-F.col("met")).alias("less"), deal.alias("h"), "row", "size", "pos", "root")).alias("lead")
        index = self.index.where("not few") if seed else self.index
        lists = self._met(index).groupBy("token", F.pmod(deal, F.lit(leaders)).alias("part")).agg(lead, F.first("n").alias("n"))
        lists, lead = self.stage.write(lists.select("token", "n", "lead"), "lists"), F.col("lead")
        fits = _can_link(self.percent, F.col("size"), F.col("pos"), lead["size"], lead["pos"])
        hot = F.col("n") > HOT_LIST
        votes = _dealt(index.select("token", "row", "size", "pos", "root", "n"), hot).drop("n").join(_every(lists, hot).drop("n"), ["token", "salt"]).where((F.col("root") != lead["root"]) & fits)
        votes = votes.groupBy("row", lead["row"].alias("other"))
        votes = votes.agg(F.count("*").alias("votes")).withColumns({"a": F.least("row", "other"), "b": F.greatest("row", "other")})
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("votes"), "other"))
        pairs = votes.withColumn("place", place).where(F.col("place") <= leaders).select("a", "b")
        if seed:
            pairs, self.index = pairs.unionByName(self._few()), self.index.where("not few")
        connected = self._connect(self._untested(pairs.distinct()))
        if seed == 1:
            # From here on only the documents of lists with many pairs are compared.
            self.segments = self.stage.write(self.segments.join(self.index.select("row").distinct(), "row", "left_semi"), "segments")
        return connected

    def _rest(self) -> None:
        """All pairs of different components that share a list and are not tested yet.

        Two documents near the leader of a hot list are paired by their n-grams off the leader only.
        """
        hot = (F.col("n") > HOT_LIST) & ~F.col("few")
        lists = self.index.withColumns({"near": F.lit(False), "lead": F.lit(None).cast("long")})
        off = None
        if self.index.where(hot).limit(1).count():
            leads = self._met(self.index.where(hot)).groupBy("token").agg(F.min(F.struct((-F.col("met")).alias("less"), "row")).alias("l"))
            leads = self.stage.write(leads.select("token", F.col("l.row").alias("lead")), "leads")
            near, off = self._near(_dealt(self.index.where(hot)).join(_every(leads), ["token", "salt"]).select("lead", "row", "size").distinct())
            self._open()
            lists = self.index.join(leads, "token", "left").join(near.select("lead", "row", F.lit(True).alias("near")), ["lead", "row"], "left")
            lists = self.stage.write(lists.withColumn("near", F.coalesce("near", F.lit(False))), "near-entries")
        lists = lists.where("not few")
        x, y = (lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "pos", "root", "near"))) for s in "ab")
        fits = _can_link(self.percent, F.col("size_a"), F.col("pos_a"), F.col("size_b"), F.col("pos_b"))
        once = (F.col("row_a") < F.col("row_b")) | F.col("near_b")
        pairs = x.where("not near_a").join(y, "token").where(once & (F.col("root_a") != F.col("root_b")) & fits)
        pairs = pairs.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).unionByName(self._few())
        self._connect(self._untested((pairs if off is None else pairs.unionByName(self._off(off))).distinct()))

    def _near(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of documents and leaders of their lists (lead, row, size): those near each other, and the entries (lead,
        token, row, ...) of what they differ in.

        For any set C, x and y differ in as many n-grams as their differences from C, X and Y, do.  So they link when
        2 (100 + percent) |X & Y| >= e(x) + e(y), where e(x) = (100 + percent) |X| - (100 - percent) |x|.  C is the
        leader's n-grams that others have, too.  Where e(x) + e(y) <= 0, both link with the document of least e, and are
        connected here; any other two share an n-gram of X and Y.
        """
        none, whole = F.array().cast("array<long>"), 100 + self.percent
        mine = self.segments.select("row", "fragment", F.col("keys").alias("mine"))
        its = self.segments.select(F.col("row").alias("lead"), "fragment", F.col("keys").alias("its"))
        parts = members.withColumn("fragment", F.explode(F.array(*(F.lit(k).cast("long") for k in range(FRAGMENTS)))))
        parts = parts.join(mine, ["row", "fragment"], "left").join(its, ["lead", "fragment"], "left")
        parts = parts.withColumns({"mine": F.coalesce("mine", none), "its": F.coalesce("its", none)})
        off = F.concat(F.array_except("mine", "its"), F.array_except("its", "mine")).alias("off")
        parts = self.stage.write(parts.select("lead", "row", "size", F.size("mine").alias("m"), F.size("its").alias("c"), off), "parts")
        sums = parts.groupBy("lead", "row", "size").agg(F.sum("m").alias("m"), F.sum("c").alias("c"), F.sum(F.size("off")).alias("d"))
        # N-grams of one document are differences, too.
        alone = F.col("size") - F.col("m")
        sums = sums.withColumns({"alone": alone, "d": F.col("d") + alone, "e": whole * (F.col("d") + alone) - (100 - self.percent) * F.col("size")})
        near = self.stage.write(sums.where(3 * F.col("d") <= F.col("size") + F.col("c")).select("lead", "row", "size", "alone", "d", "e"), "near")
        least = self.stage.write(near.groupBy("lead").agg(F.min(F.struct("e", "row")).alias("least")).select("lead", "least.*"), "least")
        star = near.join(least.toDF("lead", "e_2", "row_2"), "lead").where("e + e_2 <= 0 and row != row_2")
        roots = (self.labels.toDF(f"row{s}", f"root{s}") for s in ("", "_2"))
        star = star.join(next(roots), "row").join(next(roots), "row_2").where("root != root_2")
        self._connect(self._untested(star.select(F.least("row", "row_2").alias("a"), F.greatest("row", "row_2").alias("b")).distinct()))
        off = parts.select("lead", "row", F.explode("off").alias("token")).join(near, ["lead", "row"])
        off = self.stage.write(off.join(least.select("lead", F.col("e").alias("least")), "lead"), "off")
        return near, off

    def _off(self, off: DataFrame) -> DataFrame:
        """Pairs of different components that may link by what both differ from a leader in.

        One of the two, b, does not link with the document of least e: e(b) > -least.  So the n-grams they must share
        are so many, and the first of them, rarest first, stands in a prefix that is the shorter for it.
        """
        times = self.stage.write(off.groupBy("lead", "token").agg(F.count("*").alias("times")), "times")
        off = _dealt(off).join(_every(times), ["lead", "token", "salt"]).drop("salt")
        at = F.row_number().over(Window.partitionBy("lead", "row").orderBy("times", "token")) - 1 + F.col("alone")
        off = off.withColumn("left", F.col("d") - at).where("times > 1").join(self.labels, "row")
        twice = 2 * (100 + self.percent)
        must = lambda e: F.greatest(F.lit(1), F.ceil(e / twice))
        # As many n-grams as must be shared, at least, stand at the first shared one and after it.
        index = self.stage.write(off.where(F.col("left") >= must(F.col("e") - F.abs("least"))), "off-index")
        a, b = (index.select("lead", "token", "least", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "root", "e", "left"))) for s in "ab")
        a = a.where(F.col("left_a") >= must(F.col("e_a") - F.col("least")))
        pairs = a.join(b.where("e_b > -least").drop("least"), ["lead", "token"]).where("root_a != root_b")
        pairs = pairs.where((twice * F.least("left_a", "left_b") >= F.col("e_a") + F.col("e_b")))
        pairs = pairs.where(100 * F.least("size_a", "size_b") >= self.percent * F.greatest("size_a", "size_b"))
        return pairs.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))

    def _connect(self, pairs: DataFrame) -> bool:
        pairs = self.stage.write(pairs, "pairs")
        one, two = (
            self.segments.select(F.col("row").alias(s), F.col("size").alias(f"size_{s}"), "fragment", F.col("keys").alias(f"keys_{s}")) for s in "ab"
        )
        overlap = F.size(F.array_intersect("keys_a", "keys_b")).alias("o")
        partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "size_a", "size_b", overlap)
        sums = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("o").alias("o"))
        links = self.stage.write(sums.where((100 + self.percent) * F.col("o") >= self.percent * (F.col("size_a") + F.col("size_b"))), "links")
        self.tested = self.tested.unionByName(pairs)
        if not links.limit(1).count():
            return False
        of_a, of_b = (self.labels.select(F.col("row").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
        roots = links.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        merged = components(roots, self.stage).withColumnRenamed("root", "to")
        labels = self.labels.join(merged, F.col("root") == F.col("id"), "left").select("row", F.coalesce("to", "root").alias("root"))
        self.labels = self.stage.write(labels, "labels")
        return True


def near_copies(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, mark (a hash of the text) and whether the row stays (one of
    each component does)."""
    stage = Stage(docs.sparkSession, "jaccard-join")
    corpus = chunks.tokenised(docs, stage, lower=True, id_col=id_col, text_col=text_col)
    sets = _sets(corpus, n, percent, stage)
    stage.drop(corpus)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    can = sets.where("digest is not null")
    classes = stage.write(can.groupBy("digest").agg(F.min(first).alias("first")), "classes")
    reps = can.join(classes.select("first.row"), "row", "left_semi")
    index, segments = _cut(_blocks(reps, stage), percent, stage)
    join = _Join(index, segments, percent, stage)
    join.run()
    roots = join.labels.select("row", "root")
    of_class = classes.join(roots, classes["first.row"] == roots["row"], "left").select("digest", "first", F.coalesce("root", "first.row").alias("root"))
    of_class = stage.write(of_class, "roots")
    least = stage.write(of_class.groupBy("root").agg(F.min("first").alias("least")), "least")
    of_class = stage.write(of_class.join(least, "root").select("digest", "least"), "of-class")
    columns = ("doc_id", F.col("size").alias("n_shingles"))
    # Documents that cannot link have no digest, and take no part in the join.
    alone = sets.where("digest is null").select(*columns, F.col("doc_id").alias("component_id"), "mark", F.lit(True).alias("stays"))
    linked = sets.where("digest is not null").select("row", "doc_id", "mark", "size", "digest").join(of_class, "digest")
    stays = (F.col("least.row") == F.col("row")).alias("stays")
    return alone.unionByName(linked.select(*columns, F.col("least.doc_id").alias("component_id"), "mark", stays))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, with one document of each component.

    Rows that repeat both doc_id and text stay or go together.
    """
    stage = Stage(docs.sparkSession, "drop-near-copies")
    found = stage.write(near_copies(docs, n, percent, id_col, text_col).select("doc_id", "mark", "stays"), "verdicts")
    gone = found.groupBy("doc_id", "mark").agg(F.max("stays").alias("any")).where("not any").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"d.`{text_col}`").cast("string")) == F.col("_mark"))
    return rows.join(gone, same, "left_anti").select("d.*")
