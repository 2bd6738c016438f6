"""Recall: filter, score, rank.

The query's vector and weights are constants of the plan.  Ranking is by score, then by rid, so equal
scores have one order.  Recall never changes state; ``reinforce`` is a transition of its own.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnmem.functions import scoring, vectors

#: Queries that are scored in one pass over the memories.
QUERY_BLOCK = 512
#: What a match of keywords adds, at most.
KEYWORD_BOOST = 0.31


def visible(
    memories: DataFrame, namespace: str | None = None, domain: str | None = None, source: str | None = None,
    memory_type: str | None = None, time_window: tuple[float, float] | None = None, include_consolidated: bool = False,
) -> DataFrame:
    """Memories that a recall may see: neither tombstoned nor cold, and all given filters hold.

    Both ends of a time window belong to it.
    """
    statuses = ["active", "consolidated"] if include_consolidated else ["active"]
    out = memories.where(F.col("consolidation_status").isin(statuses) & (F.col("storage_tier") != "cold"))
    for column, value in (("namespace", namespace), ("domain", domain), ("source", source), ("type", memory_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out if time_window is None else out.where(F.col("created_at").between(*time_window))


@dataclass(frozen=True)
class Recall:
    """A recall under construction; every method returns a new one.

    ``Recall(memories, now).vector(v).where(namespace="u1").top(5).run()``
    """

    memories: DataFrame
    now: float
    query: tuple[float, ...] | None = None
    text: str | None = None
    k: int = 10
    weights: scoring.Weights = scoring.Weights()
    filters: dict = field(default_factory=dict)
    proximity: DataFrame | None = None
    skip: DataFrame | None = None

    def vector(self, v: Sequence[float]) -> "Recall":
        return replace(self, query=tuple(map(float, v)))

    def asking(self, text: str) -> "Recall":
        """The query's words, which set the mood."""
        return replace(self, text=text)

    def where(self, **filters) -> "Recall":
        return replace(self, filters=self.filters | filters)

    def top(self, k: int) -> "Recall":
        return replace(self, k=k)

    def expanded(self, proximity: DataFrame) -> "Recall":
        """Score with graph proximity (rid, graph_proximity), at the weights for that."""
        return replace(self, proximity=proximity, weights=self.weights.expanded())

    def refined(self, v: Sequence[float], seen: DataFrame, of_old: float = 0.4) -> "Recall":
        """Blend the query with another and leave out what was seen (rid)."""
        if self.query is None:
            raise ValueError("a recall is refined from its first query")
        blended = tuple(of_old * a + (1 - of_old) * float(b) for a, b in zip(self.query, v, strict=True))
        return replace(self, query=blended, skip=seen.select("rid"))

    def scored(self) -> DataFrame:
        """All visible memories that have an embedding, with their signals."""
        if self.query is None:
            raise ValueError("recall needs a query vector")
        df = visible(self.memories, **self.filters).where(F.col("embedding").isNotNull())
        if self.skip is not None:
            df = df.join(self.skip, "rid", "left_anti")
        near = None
        if self.proximity is not None:
            df = df.join(self.proximity.select("rid", F.col("graph_proximity").alias("_near")), "rid", "left")
            near = F.coalesce(F.col("_near"), F.lit(0.0))
        similarity = vectors.cosine_with(F.col("embedding"), self.query)
        df = df.withColumn("_sim", similarity)
        parts = scoring.signals(
            F.col("_sim"), F.col("importance"), F.col("valence"), F.col("half_life"), F.col("created_at"), self.now,
            scoring.sentiment(self.text), near, self.weights,
        )
        return df.withColumns(parts).drop("_sim", "_near")

    def run(self) -> DataFrame:
        """The k best: rid, the score, its signals, and why each was retrieved."""
        kept = ("rid", "score", "similarity", "decay", "recency", "importance", "graph_proximity", "valence_multiplier", "created_at")
        best = self.scored().select(*kept).orderBy(F.desc("score"), "rid").limit(self.k)
        return best.withColumn("why_retrieved", why())


def why() -> Column:
    """Reasons, from the signals."""
    return F.filter(
        F.array(
            F.when(F.col("similarity") >= 0.25, F.format_string("semantically similar (%.2f)", "similarity")),
            F.when(F.col("graph_proximity") > 0, F.format_string("connected in the graph (%.2f)", "graph_proximity")),
            F.when(F.col("recency") >= 0.5, F.lit("recent")),
            F.when(F.col("importance") >= 0.8, F.lit("important")),
            F.when(F.col("valence_multiplier") > 1.15, F.lit("emotionally relevant")),
        ),
        lambda x: x.isNotNull(),
    )


def similar(memories: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k most similar memories alone: rid, similarity."""
    s = vectors.cosine_with(F.col("embedding"), query)
    return memories.where("embedding is not null").select("rid", s.alias("similarity")).orderBy(F.desc("similarity"), "rid").limit(k)


def with_details(memories: DataFrame, best: DataFrame, columns: Sequence[str] = ("text",)) -> DataFrame:
    """Ranked rows with further columns, which only the rows found are read for.

    ``best`` has at most k rows, so it is broadcast.
    """
    return memories.select("rid", *columns).join(F.broadcast(best), "rid")


def recall_many(
    memories: DataFrame, queries: DataFrame, now: float, k: int = 10, weights: scoring.Weights = scoring.Weights()
) -> DataFrame:
    """(query_id, rid, score, rank) of the k best memories of every query (query_id, embedding).

    Queries are taken in blocks of ``QUERY_BLOCK``, each one pass over the memories; a batch of
    memories is scored against a block by one matrix product and sends its k best of each query on.
    Memories whose vectors have another length than the queries' are not found.
    """
    df = visible(memories).where("embedding is not null").select("rid", "importance", "half_life", "created_at", "embedding")
    wanted = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    out = df.sparkSession.createDataFrame([], "query_id long, rid string, score double")
    block: list[tuple[int, list[float]]] = []
    for row in wanted.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(_best_of_block(df, block, now, k, weights)), []
    if block:
        out = out.unionByName(_best_of_block(df, block, now, k, weights))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rid"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of_block(df: DataFrame, block: list[tuple[int, list[float]]], now: float, k: int, w: scoring.Weights) -> DataFrame:
    ids = np.array([b[0] for b in block], np.int64)
    q = np.array([b[1] for b in block])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    df = df.where(F.size("embedding") == q.shape[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            imp, half, at = (batch[c].to_numpy() for c in ("importance", "half_life", "created_at"))
            v = batch["embedding"].flatten().to_numpy().reshape(batch.num_rows, -1)
            sim = (q @ v.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-300)
            age = now - at
            base = w.sim * sim + w.decay * imp * np.exp2(-age / half) + w.recency * np.exp(-age / scoring.RECENCY_SECONDS)
            score = np.maximum(base * (1 + w.alpha_imp * imp / (1 + np.exp(-w.gate_k * (sim - w.gate_tau)))), 0.0)
            least = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
            rows, at = np.nonzero(score >= least[:, None])
            rid, score = np.array(batch["rid"].to_pylist()), score[rows, at]
            # Of the few that are left, ties of the last place included, the first k of each query.
            order = np.lexsort((rid[at], -score, rows))
            rows, at, score = rows[order], at[order], score[order]
            own = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows[own]]), pa.array(rid[at[own]].tolist(), pa.string()), pa.array(score[own])], names=["query_id", "rid", "score"]
            )

    return df.mapInArrow(work, "query_id long, rid string, score double")


def response(ranked: DataFrame) -> DataFrame:
    """One row about a ranked result: confidence, top similarity, spread, sources, count, hints.

    Confidence is the top similarity, raised by a tenth of the spread between best and last score, in
    [0, 1]; without rows it is 0.  Below 0.35 a hint asks for more detail, without rows for other words.
    """
    one = ranked.agg(
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("top_similarity"),
        F.coalesce(F.max("score") - F.min("score"), F.lit(0.0)).alias("score_spread"),
        F.count("*").alias("candidate_count"),
    )
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top_similarity") + 0.1 * F.col("score_spread")))
    hints = F.when(F.col("candidate_count") == 0, F.array(F.lit("nothing found: use other words")))
    hints = hints.when(F.col("confidence") < 0.35, F.array(F.lit("weak match: add detail"))).otherwise(F.array().cast("array<string>"))
    return one.withColumn("confidence", confidence).withColumn("hints", hints)


def reinforce(memories: DataFrame, hits: DataFrame, now: float, factor: float = 1.2) -> DataFrame:
    """memories after a recall: hits last longer, and were accessed now."""
    found = hits.select("rid").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return memories.join(found, "rid", "left").withColumns(
        {
            "half_life": F.when(hit, F.col("half_life") * factor).otherwise(F.col("half_life")),
            "last_access": F.when(hit, F.lit(now)).otherwise(F.col("last_access")),
            "access_count": F.col("access_count") + hit.cast("int"),
        }
    ).drop("_hit")


def stems(text: Column) -> Column:
    """Distinct words of a text, in lower case, without a common English ending."""
    # Endings go from the whole text at once: one expression, not one for each word.
    short = F.regexp_replace(F.lower(text), r"(ing|ed|es|s)(?![\p{L}0-9])", "")
    return F.array_distinct(F.filter(F.split(short, r"[^\p{L}0-9]+"), lambda w: F.length(w) > 0))


def keyword_recall(texts: DataFrame, id_col: str, text_col: str, query: str, k: int = 10) -> DataFrame:
    """(id, matched, score) of the k rows that hold most of a query's stems, in one scan of all texts.

    For many queries of one table, ``keyword_index`` reads the texts once.
    """
    wanted = stems(F.lit(query))
    matched = F.size(F.array_intersect(stems(F.col(text_col)), wanted)).alias("matched")
    # Rows without a match come last, so they can go after the limit; a filter before it would compute the stems twice.
    best = texts.select(F.col(id_col).alias("id"), matched).orderBy(F.desc("matched"), "id").limit(k).where("matched > 0")
    return best.withColumn("score", KEYWORD_BOOST * F.col("matched") / F.size(wanted))


#: Folders over which the postings of stems are dealt.
POSTING_PARTS = 64


def keyword_index(texts: DataFrame, path: str, id_col: str, text_col: str, parts: int = POSTING_PARTS) -> None:
    """Write an inverted index of texts: (stem, id), in folders by a hash of the stem and sorted by stem, so
    that a lookup reads the folders, and within them the row groups, of its own stems."""
    postings = texts.select(F.col(id_col).alias("id"), F.explode(stems(F.col(text_col))).alias("stem"))
    postings = postings.withColumn("part", F.pmod(F.xxhash64("stem"), F.lit(parts)).cast("int"))
    # Salted by id: a stem of every text is in as many files as the session has partitions.
    postings.repartition("part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("part", "stem").write.partitionBy("part").mode("overwrite").parquet(path)


def keyword_lookup(spark: SparkSession, path: str, query: str, k: int = 10, parts: int = POSTING_PARTS) -> DataFrame:
    """What ``keyword_recall`` finds, from the index."""
    # One row, of the query's stems and their folders.
    wanted = spark.range(1).select(F.explode(stems(F.lit(query))).alias("stem")).select("stem", F.pmod(F.xxhash64("stem"), F.lit(parts)).cast("int").alias("part"))
    found = wanted.collect()
    postings = spark.read.parquet(path).where(F.col("part").isin([r["part"] for r in found]) & F.col("stem").isin([r["stem"] for r in found]))
    best = postings.groupBy("id").agg(F.count("*").cast("int").alias("matched")).orderBy(F.desc("matched"), "id").limit(k)
    return best.withColumn("score", KEYWORD_BOOST * F.col("matched") / len(found))


def evaluate(ranked: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """Of each query: recall@k, precision@k and reciprocal rank.

    ranked: query_id, rid, rank (from 1); golden: query_id, rid.  A query without golden rows is left
    out; one without hits scores 0.
    """
    gold = golden.select("query_id", "rid").distinct()
    shown = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("shown"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "rid"], "left_semi")
    hits = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("expected"))
    return (
        sizes.join(shown, "query_id", "left")
        .join(hits, "query_id", "left")
        .select(
            "query_id",
            (F.coalesce("hits", F.lit(0)) / F.col("expected")).alias("recall_at_k"),
            F.coalesce(F.col("hits") / F.col("shown"), F.lit(0.0)).alias("precision_at_k"),
            F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        )
    )


def covering(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """ranked (query_id, rid, rank) with the sources (rid, source_rid) that a consolidated memory stands for, at its
    rank; of several places of one memory the best counts."""
    more = ranked.join(sources, "rid").select("query_id", F.col("source_rid").alias("rid"), "rank")
    return ranked.select("query_id", "rid", "rank").unionByName(more).groupBy("query_id", "rid").agg(F.min("rank").alias("rank"))


def by_tag(metrics: DataFrame, tags: DataFrame, passing: float = 0.5) -> DataFrame:
    """Of each tag of queries (query_id, tags): queries, mean metrics, and the share whose recall passes."""
    own = metrics.join(tags.select("query_id", F.explode("tags").alias("tag")).distinct(), "query_id")
    return own.groupBy("tag").agg(
        F.count("*").alias("n"), F.avg("recall_at_k").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"),
        F.avg((F.col("recall_at_k") >= passing).cast("double")).alias("pass_rate"),
    )
