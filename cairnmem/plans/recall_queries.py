"""Recall queries over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.operators import graph, recall
from cairnmem.operators.recall import Recall
from cairnmem.plans.registry import query
from cairnmem.plans.sql import COSINE, EDGE_LOG, MEMORIES, SCORED, given
from cairnmem.sources import tables
from cairnmem.sources.tables import NOW

_SCORE = "greatest((0.5::double * sim + 0.2::double * decay + 0.3::double * recency) * (1 + amplified){valence}, 0)"


def _ranked(valence: str = "", where: str = "", k: int = 10) -> str:
    score = _SCORE.format(valence=valence)
    return given(MEMORIES, SCORED, body=f"SELECT rid, round({score}, 6) AS score FROM signals {where} ORDER BY {score} DESC, rid LIMIT {k}")


_NEUTRAL = " * (1 + 0.3::double * abs(valence))"


def _base(spark: SparkSession, sf_dir: str) -> Recall:
    return Recall(tables.memories(spark, sf_dir), NOW).vector(tables.query_vector(spark, sf_dir))


def _short(df: DataFrame) -> DataFrame:
    return df.select("rid", F.round("score", 6).alias("score"))


@query(given(MEMORIES, body=f" SELECT rid, round({COSINE}, 6) AS similarity FROM memories, q WHERE embedding IS NOT NULL ORDER BY {COSINE} DESC, rid LIMIT 10"))
def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar memories."""
    best = recall.similar(tables.memories(spark, sf_dir), tables.query_vector(spark, sf_dir))
    return best.select("rid", F.round("similarity", 6).alias("similarity"))


@query(_ranked(_NEUTRAL))
def recall_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance-gated recall with all signals: the flagship."""
    return _short(_base(spark, sf_dir).run())


@query(_ranked(" * (1 + 0.3::double * greatest(-valence, 0.0::double))"))
def recall_sad_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall for a query in a negative mood."""
    return _short(_base(spark, sf_dir).asking("why am I so sad and worried").run())


@query(_ranked(_NEUTRAL, "WHERE namespace = 'u8' AND source = 'user'"))
def recall_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall within a namespace and a source."""
    return _short(_base(spark, sf_dir).where(namespace="u8", source="user").run())


@query(_ranked(_NEUTRAL, "WHERE created_at BETWEEN 1704110400 AND 1704139200"))
def recall_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall within a time window; both ends belong to it."""
    return _short(_base(spark, sf_dir).where(time_window=(1704110400.0, 1704139200.0)).run())


@query(_ranked(_NEUTRAL).replace("WHERE consolidation_status = 'active')", "WHERE consolidation_status IN ('active', 'consolidated'))"))
def recall_with_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall that sees consolidated memories too."""
    return _short(_base(spark, sf_dir).where(include_consolidated=True).run())


@query(_ranked(_NEUTRAL, "WHERE type = 'procedural'", 5))
def recall_procedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best procedural memories."""
    return _short(_base(spark, sf_dir).where(memory_type="procedural").top(5).run())


_NEAR = """
near_parts AS (
    SELECT e, min(h) AS hops FROM (
        SELECT 'customer8' AS e, 0 AS h
        UNION ALL SELECT dst, 1 FROM place_edges WHERE src = 'customer8'
        UNION ALL SELECT p.src, 2 FROM place_edges o JOIN place_edges p ON o.dst = p.dst WHERE o.src = 'customer8'
        UNION ALL SELECT p.dst, 2 FROM place_edges o JOIN place_edges p ON o.dst = p.src WHERE o.src = 'customer8'
    ) GROUP BY e
)
"""


@query(
    given(
        MEMORIES, SCORED, EDGE_LOG, _NEAR,
        body="""
        SELECT rid, round(greatest((0.35::double * sim + 0.15::double * decay + 0.2::double * recency + 0.3::double * coalesce(1 / (1.0::double + hops), 0))
            * (1 + amplified) * (1 + 0.3::double * abs(valence)), 0), 6) AS score, round(coalesce(1 / (1.0::double + hops), 0), 6) AS graph_proximity
        FROM signals LEFT JOIN near_parts ON entity = e
        ORDER BY (0.35::double * sim + 0.15::double * decay + 0.2::double * recency + 0.3::double * coalesce(1 / (1.0::double + hops), 0))
            * (1 + amplified) * (1 + 0.3::double * abs(valence)) DESC, rid LIMIT 10""",
    )
)
def recall_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall that also looks two hops around an entity of the query."""
    m = tables.memories(spark, sf_dir)
    near = graph.proximity(tables.place_edges(spark, sf_dir), m.select("rid", "entity"), ["customer8"], hops=2)
    best = Recall(m, NOW).vector(tables.query_vector(spark, sf_dir)).expanded(near).run()
    return best.select("rid", F.round("score", 6).alias("score"), F.round("graph_proximity", 6).alias("graph_proximity"))


_BATCH = given(
    MEMORIES,
    body=f"""
    , qs AS (SELECT vec_id AS query_id, label AS query_label, embedding::double[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
    cross_parts AS (
        SELECT query_id, query_label, rid, visible.label, importance, {NOW}::double - created_at AS age, half_life,
            list_dot_product(embedding, qv) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(qv, qv))) AS sim
        FROM visible, qs WHERE embedding IS NOT NULL
    ),
    scored AS (
        SELECT *, greatest((0.5::double * sim + 0.2::double * importance * pow(2.0::double, -age / half_life) + 0.3::double * exp(-age / 604800.0::double))
            * (1 + 1 / (1 + exp(-12 * (sim - 0.25::double))) * 0.8::double * importance), 0) AS score FROM cross_parts
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rid) AS rank FROM scored QUALIFY rank <= 10)
    """,
)


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = tables.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return recall.recall_many(tables.memories(spark, sf_dir), queries.select(F.col("vec_id").alias("query_id"), "embedding"), NOW)


@query(_BATCH + "SELECT query_id, rid, round(score, 6) AS score, rank FROM ranked")
def recall_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every query whose number is divisible by 50, against all memories."""
    return _many(spark, sf_dir).select("query_id", "rid", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


_METRICS = """
    , gold AS (SELECT query_id, rid FROM qs JOIN memories ON label = query_label WHERE rid <> 'm' || query_id),
    hit AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM ranked WHERE (query_id, rid) IN (SELECT query_id, rid FROM gold) GROUP BY 1),
    size AS (SELECT query_id, count(*) AS expected FROM gold GROUP BY 1),
    metrics AS (
        SELECT query_id, coalesce(hits, 0) / expected AS recall_at_k, coalesce(hits / 10, 0) AS precision_at_k, coalesce(1 / first, 0) AS reciprocal_rank
        FROM size LEFT JOIN hit USING (query_id)
    )
"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # One row a query: broadcast up to the size that the session allows.
    m = tables.memories(spark, sf_dir).where("label is not null").select("rid", "label")
    gold = m.join(labels, "label").where(F.col("rid") != F.concat(F.lit("m"), "query_id")).select("query_id", "rid")
    return recall.evaluate(_many(spark, sf_dir), gold)


@query(
    _BATCH + _METRICS
    + "SELECT query_id, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(reciprocal_rank, 6) AS reciprocal_rank FROM metrics"
)
def recall_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and reciprocal rank of each query; memories of its label are relevant."""
    return _metrics(spark, sf_dir).select("query_id", *(F.round(c, 6).alias(c) for c in ("recall_at_k", "precision_at_k", "reciprocal_rank")))


@query(
    _BATCH + _METRICS
    + """SELECT query_label % 2 = 0 AS even_label, count(*) AS n, round(avg(recall_at_k), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr
    FROM metrics JOIN qs USING (query_id) GROUP BY 1"""
)
def eval_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of groups of queries."""
    tags = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 2 == 0).alias("even_label"))
    joined = _metrics(spark, sf_dir).join(tags, "query_id")
    return joined.groupBy("even_label").agg(
        F.count("*").alias("n"), F.round(F.avg("recall_at_k"), 6).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr")
    )


@query(
    _BATCH + _METRICS
    + "SELECT query_id, rid, rank FROM ranked WHERE (query_id, rid) IN (SELECT query_id, rid FROM gold)"
)
def golden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the results were expected: a semi join."""
    labels = tables.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    m = tables.memories(spark, sf_dir).where("label is not null").select("rid", "label")
    gold = m.join(labels, "label").where(F.col("rid") != F.concat(F.lit("m"), "query_id"))
    return _many(spark, sf_dir).join(gold, ["query_id", "rid"], "left_semi").select("query_id", "rid", F.col("rank").cast("long"))


_REFINED = """
first_best AS (
    SELECT rid FROM signals ORDER BY greatest((0.5::double * sim + 0.2::double * decay + 0.3::double * recency) * (1 + amplified) * (1 + 0.3::double * abs(valence)), 0) DESC, rid LIMIT 10
),
q2 AS (
    SELECT list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: 0.4::double * p[1] + (1 - 0.4::double) * p[2]) AS v2
    FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1
),
parts2 AS (
    SELECT visible.*, list_dot_product(embedding, v2) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v2, v2))) AS sim,
        {now}::double - created_at AS age FROM visible, q2 WHERE embedding IS NOT NULL AND rid NOT IN (SELECT rid FROM first_best)
),
scored2 AS (
    SELECT rid, greatest((0.5::double * sim + 0.2::double * importance * pow(2.0::double, -age / half_life) + 0.3::double * exp(-age / 604800.0::double))
        * (1 + 1 / (1 + exp(-12 * (sim - 0.25::double))) * 0.8::double * importance) * (1 + 0.3::double * abs(valence)), 0) AS score FROM parts2
)
""".replace("{now}", str(NOW))


@query(given(MEMORIES, SCORED, _REFINED, body="SELECT rid, round(score, 6) AS score FROM scored2 ORDER BY scored2.score DESC, rid LIMIT 10"))
def recall_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second recall from a blended query, without what the first one showed."""
    first = _base(spark, sf_dir)
    return _short(first.refined(tables.query_vector(spark, sf_dir, 1), first.run()).run())


@query(
    given(
        MEMORIES, SCORED,
        body=f"""
        , best AS (SELECT sim, {_SCORE.format(valence=_NEUTRAL)} AS score FROM signals ORDER BY score DESC, rid LIMIT 10)
        SELECT count(*) AS candidate_count, round(max(sim), 6) AS top_similarity, round(max(score) - min(score), 6) AS score_spread,
            round(least(1, greatest(0, max(sim) + 0.1::double * (max(score) - min(score)))), 6) AS confidence,
            CASE WHEN least(1, greatest(0, max(sim) + 0.1::double * (max(score) - min(score)))) < 0.35 THEN 1 ELSE 0 END AS n_hints FROM best""",
    )
)
def recall_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller is told about a result."""
    r = recall.response(_base(spark, sf_dir).run())
    rounded = (F.round(c, 6).alias(c) for c in ("top_similarity", "score_spread", "confidence"))
    return r.select("candidate_count", *rounded, F.size("hints").alias("n_hints"))


@query(
    given(
        MEMORIES, SCORED,
        body=f"""
        , best AS (SELECT *, {_SCORE.format(valence=_NEUTRAL)} AS score FROM signals ORDER BY score DESC, rid LIMIT 10)
        SELECT rid, concat_ws('; ', CASE WHEN sim >= 0.25 THEN printf('semantically similar (%.2f)', sim) END,
            CASE WHEN recency >= 0.5 THEN 'recent' END, CASE WHEN importance >= 0.8 THEN 'important' END,
            CASE WHEN 1 + 0.3::double * abs(valence) > 1.15 THEN 'emotionally relevant' END) AS reasons FROM best""",
    )
)
def recall_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each memory was retrieved."""
    return _base(spark, sf_dir).run().select("rid", F.array_join("why_retrieved", "; ").alias("reasons"))


@query(
    given(
        MEMORIES, SCORED,
        body=f"""
        , best AS (SELECT rid FROM signals ORDER BY {_SCORE.format(valence=_NEUTRAL)} DESC, rid LIMIT 10)
        SELECT rid, round(CASE WHEN rid IN (SELECT rid FROM best) THEN half_life * 1.2::double ELSE half_life END, 3) AS half_life,
            CASE WHEN rid IN (SELECT rid FROM best) THEN access_count + 1 ELSE access_count END AS access_count FROM memories""",
    )
)
def reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories after a recall has reinforced its hits."""
    out = recall.reinforce(tables.memories(spark, sf_dir), _base(spark, sf_dir).run(), NOW)
    return out.select("rid", F.round("half_life", 3).alias("half_life"), F.col("access_count").cast("long"))


_STEMS = r"""
list_distinct(list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}0-9]+'), lambda w: length(w) > 0), lambda w: regexp_replace(w, '(ing|ed|es|s)$', '')))
"""


@query(
    f"""WITH m AS (SELECT doc_id AS id, len(list_intersect({_STEMS.format(text="coalesce(text, '')")}, {_STEMS.format(text="'the License, licensed works'")})) AS matched,
        len({_STEMS.format(text="'the License, licensed works'")}) AS wanted FROM documents)
    SELECT id, matched, round(0.31::double * matched / wanted, 6) AS score FROM m WHERE matched > 0 ORDER BY matched DESC, id LIMIT 10"""
)
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold most words of a query, stemmed."""
    found = recall.keyword_recall(tables.table(spark, sf_dir, "documents"), "doc_id", "text", "the License, licensed works")
    return found.select("id", F.col("matched").cast("long"), F.round("score", 6).alias("score"))


@query(
    given(
        MEMORIES, SCORED, EDGE_LOG, _NEAR,
        body="""
        , by_vector AS (SELECT rid, sim AS strength FROM signals ORDER BY sim DESC, rid LIMIT 20),
        by_graph AS (SELECT rid, 1 / (1.0::double + hops) AS strength FROM memories JOIN near_parts ON entity = e WHERE hops = 0)
        SELECT rid, round(max(strength), 6) AS strength, count(*) AS ways FROM (SELECT * FROM by_vector UNION ALL SELECT * FROM by_graph) GROUP BY rid""",
    )
)
def candidates_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by vector and by graph, each once."""
    m = tables.memories(spark, sf_dir)
    v = recall.similar(recall.visible(m), tables.query_vector(spark, sf_dir), 20).select("rid", F.col("similarity").alias("strength"))
    g = graph.proximity(tables.place_edges(spark, sf_dir), m.select("rid", "entity"), ["customer8"], hops=0)
    both = v.unionByName(g.select("rid", F.col("graph_proximity").alias("strength")))
    return both.groupBy("rid").agg(F.round(F.max("strength"), 6).alias("strength"), F.count("*").alias("ways"))
