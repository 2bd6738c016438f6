"""Queries over state that changes: conflicts, triggers, urges, sessions, watermarks, indexes, exchange."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.functions import dates
from cairnmem.operators import claims as c
from cairnmem.operators import cognition as g
from cairnmem.operators import graph, lifecycle, oplog, recall, vector_index
from cairnmem.operators.recall import Recall
from cairnmem.plans import cognition_queries, recall_queries
from cairnmem.plans.claims_queries import _SCOPED, _scoped
from cairnmem.plans.registry import ORACLE_SQL, query
from cairnmem.plans.sql import CLAIMS, EDGE_LOG, MEMORIES, OPLOG, given
from cairnmem.runtime import scratch
from cairnmem.sources import exchange, tables
from cairnmem.sources.tables import NOW


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir)


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events")


# ---- indexes


@query(ORACLE_SQL["recall_topk"])
def recall_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar memories by the inverted file, whose exact search is that of a full scan."""
    path = scratch(spark, "vectors")
    vector_index.build(_m(spark, sf_dir), path)
    best = vector_index.search(spark, path, tables.query_vector(spark, sf_dir), probes=8, exact=True)
    return best.select("rid", F.round("similarity", 6).alias("similarity"))


@query(ORACLE_SQL["keyword_recall"])
def keyword_recall_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold most words of a query, by the index of postings."""
    path = scratch(spark, "postings")
    recall.keyword_index(tables.table(spark, sf_dir, "documents"), path, "doc_id", "text")
    found = recall.keyword_lookup(spark, path, "the License, licensed works")
    return found.select("id", F.col("matched").cast("long"), F.round("score", 6).alias("score"))


@query(ORACLE_SQL["recall_expanded"])
def recall_from_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded recall around the entities that the query itself names."""
    m, edges = _m(spark, sf_dir), tables.place_edges(spark, sf_dir)
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    near = graph.proximity(edges, m.select("rid", "entity"), graph.seeds_of("where is Customer8 today?", names), hops=2)
    best = Recall(m, NOW).vector(tables.query_vector(spark, sf_dir)).expanded(near).run()
    return best.select("rid", F.round("score", 6).alias("score"), F.round("graph_proximity", 6).alias("graph_proximity"))


@query(
    recall_queries._BATCH
    + """
    , sources AS (SELECT 'm' || seq AS rid, 'm' || (seq + 1) AS source_rid FROM memories WHERE seq % 5 = 0),
    covered AS (
        SELECT query_id, rid, min(rank) AS rank FROM (
            SELECT query_id, rid, rank FROM ranked UNION ALL SELECT query_id, source_rid, rank FROM ranked JOIN sources USING (rid)) GROUP BY ALL),
    gold AS (SELECT query_id, rid FROM qs JOIN memories ON label = query_label WHERE rid <> 'm' || query_id),
    hit AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM covered WHERE (query_id, rid) IN (SELECT query_id, rid FROM gold) GROUP BY 1),
    shown AS (SELECT query_id, count(*) AS shown FROM covered GROUP BY 1),
    size AS (SELECT query_id, count(*) AS expected FROM gold GROUP BY 1)
    SELECT query_id, round(coalesce(hits, 0) / expected, 6) AS recall_at_k, round(coalesce(hits / shown, 0), 6) AS precision_at_k, round(coalesce(1 / first, 0), 6) AS reciprocal_rank
    FROM size LEFT JOIN shown USING (query_id) LEFT JOIN hit USING (query_id)"""
)
def recall_eval_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that count what a consolidated memory stands for."""
    m = _m(spark, sf_dir)
    sources = m.where("seq % 5 = 0").select("rid", F.concat(F.lit("m"), F.col("seq") + 1).alias("source_rid"))
    labels = tables.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = m.where("label is not null").join(labels, "label").where(F.col("rid") != F.concat(F.lit("m"), "query_id")).select("query_id", "rid")
    found = recall.evaluate(recall.covering(recall_queries._many(spark, sf_dir), sources), gold)
    return found.select("query_id", *(F.round(x, 6).alias(x) for x in ("recall_at_k", "precision_at_k", "reciprocal_rank")))


@query(
    recall_queries._BATCH + recall_queries._METRICS
    + """, tags AS (SELECT vec_id AS query_id, unnest([CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END, 'rest' || label % 3]) AS tag FROM embeddings)
    SELECT tag, count(*) AS n, count(*) FILTER (recall_at_k >= 0.02) AS n_passing, round(sum(reciprocal_rank), 4) AS total_rank FROM metrics JOIN tags USING (query_id) GROUP BY tag"""
)
def eval_by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics and the share that passes, of queries by several tags each."""
    label = F.col("label")
    tags = F.array(F.when(label % 2 == 0, "even").otherwise("odd"), F.concat(F.lit("rest"), label % 3))
    found = recall.by_tag(recall_queries._metrics(spark, sf_dir), tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), tags.alias("tags")), passing=0.02)
    return found.select("tag", "n", F.round(F.col("pass_rate") * F.col("n")).cast("long").alias("n_passing"), F.round(F.col("mrr") * F.col("n"), 4).alias("total_rank"))


@query(
    given(
        MEMORIES, EDGE_LOG,
        body="""SELECT (SELECT count(embedding) FROM memories) AS vectors, (SELECT count(*) FROM (SELECT src FROM place_edges UNION SELECT dst FROM place_edges)) AS entities,
        (SELECT count(*) FROM place_edges) AS edges""",
    )
)
def rebuilt_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rebuilding the indexes of vectors and of the graph counts."""
    path, edges = scratch(spark, "vectors"), tables.place_edges(spark, sf_dir)
    n = vector_index.build(_m(spark, sf_dir), path, cells=16)
    both = graph.both_ways(edges).agg(F.countDistinct("entity").alias("entities"), (F.count("*") / 2).cast("long").alias("edges"))
    return both.select(F.lit(n).cast("long").alias("vectors"), "entities", "edges")


# ---- lifecycle


@query(
    given(
        MEMORIES, EDGE_LOG, OPLOG,
        body="""
        , ends AS (SELECT src AS e FROM place_edges UNION SELECT dst FROM place_edges),
        mem AS (SELECT count(*) FILTER (consolidation_status = 'active') AS active_memories, count(*) FILTER (consolidation_status = 'consolidated') AS consolidated_memories,
            count(*) FILTER (consolidation_status = 'tombstoned') AS tombstoned_memories, count(*) FILTER (storage_tier = 'cold') AS archived_memories,
            count(*) FILTER (consolidation_status <> 'tombstoned' AND storage_tier <> 'cold') AS scoring_cache_entries,
            count(embedding) FILTER (consolidation_status <> 'tombstoned') AS vec_index_entries FROM memories)
        SELECT mem.*, (SELECT count(*) FROM place_edges) AS edges, (SELECT count(*) FROM ends) AS entities, (SELECT count(*) FROM oplog) AS operations,
            (SELECT count(*) FILTER (event_id % 3 = 0) FROM events) AS open_conflicts, (SELECT count(*) FILTER (event_id % 3 = 1) FROM events) AS resolved_conflicts,
            (SELECT count(*) FILTER (event_id % 4 = 0) FROM events) AS pending_triggers, (SELECT count(*) FILTER (c_custkey % 2 = 0) FROM customer) AS active_patterns,
            (SELECT count(*) FROM ends) AS graph_index_entities, (SELECT count(*) FROM (SELECT DISTINCT src, dst, rel_type FROM place_edges)) AS graph_index_edges FROM mem""",
    )
)
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a database."""
    n, k = F.col("event_id"), F.col("c_custkey")
    conflicts = _e(spark, sf_dir).select(F.when(n % 3 == 0, "open").when(n % 3 == 1, "resolved").otherwise("dismissed").alias("status"))
    triggers = _e(spark, sf_dir).select(F.when(n % 4 == 0, "pending").otherwise("delivered").alias("status"))
    patterns = tables.table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "active").otherwise("stale").alias("status"))
    return lifecycle.engine_stats(_m(spark, sf_dir), tables.place_edges(spark, sf_dir), tables.oplog(spark, sf_dir), conflicts, triggers, patterns)


@query(
    given(
        MEMORIES,
        body="""
        , held AS (SELECT namespace, count(*) AS n FROM memories GROUP BY namespace),
        new AS (SELECT conv_id * 100 + turn AS seq, 'u' || (conv_id % 10) AS namespace FROM conversations),
        placed AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY seq) AS place FROM new)
        SELECT namespace, count(*) AS accepted FROM placed JOIN held USING (namespace) WHERE right(namespace, 1)::int % 3 = 0 OR place <= 20 GROUP BY namespace""",
    )
)
def admit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch as far as the quotas of its namespaces allow: some have none, the others room for twenty more."""
    stored = _m(spark, sf_dir)
    new = tables.turns(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.concat(F.lit("u"), F.col("conv_id") % 10).alias("namespace"))
    quotas = stored.groupBy("namespace").agg((F.count("*") + 20).alias("max_memories")).where(F.substring("namespace", -1, 1).cast("int") % 3 != 0)
    return lifecycle.admit(new, stored, quotas, most=None)[0].groupBy("namespace").agg(F.count("*").alias("accepted"))


@query(
    """WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 2 = 0),
    state AS (SELECT 's' || event_id AS session_id, user_id, CASE WHEN r = 1 THEN 'active' ELSE 'ended' END AS status FROM s),
    begun AS (SELECT DISTINCT user_id FROM events WHERE event_id % 7 = 1),
    after AS (SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM begun) THEN 'ended' ELSE status END AS status FROM state
        UNION ALL SELECT user_id, 'active' FROM begun),
    stopped AS (SELECT DISTINCT user_id FROM begun WHERE user_id % 4 = 0)
    SELECT CASE WHEN status = 'active' AND user_id IN (SELECT user_id FROM stopped) THEN 'ended' ELSE status END AS status, count(*) AS n FROM after GROUP BY 1"""
)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after some have begun, which ends their users' older ones, and some of those have ended."""
    e = _e(spark, sf_dir)
    even = e.where("event_id % 2 = 0")
    newest = even.groupBy("user_id").agg(F.max("event_id").alias("last"))
    state = even.join(newest, "user_id").select(
        F.concat(F.lit("s"), "event_id").alias("session_id"), "user_id", F.when(F.col("event_id") == F.col("last"), "active").otherwise("ended").alias("status"),
        F.lit(0.0).alias("started_at"), F.when(F.col("event_id") != F.col("last"), 1.0).alias("ended_at"),
    )
    new = e.where("event_id % 7 = 1").select("user_id").distinct().withColumn("session_id", F.concat(F.lit("n"), "user_id"))
    begun = lifecycle.start_sessions(state, new, NOW)
    ended = lifecycle.end_sessions(begun, new.where("user_id % 4 = 0"), NOW)
    return ended.groupBy("status").agg(F.count("*").alias("n"))


@query(given(EDGE_LOG, MEMORIES, body="SELECT entity, coalesce(t, '') AS relationship_types FROM (SELECT DISTINCT entity FROM active) LEFT JOIN (SELECT DISTINCT src AS entity, 'ordered' AS t FROM edge_log) USING (entity)"))
def relationship_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = graph.both_ways(tables.edge_log(spark, sf_dir)).select("entity", "other", "rel_type")
    return lifecycle.relationship_depth(_m(spark, sf_dir), ways).select("entity", F.coalesce("relationship_types", F.lit("")).alias("relationship_types"))


# ---- conflicts

_CONFLICTS = """conflicts AS (SELECT event_id AS conflict_id, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status,
    'minor' AS conflict_type, event_type AS dst_a, 'user' || user_id % 5 AS dst_b, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
    epoch_us(ts) / 1000000.0::double AS detected_at FROM events)"""


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return _e(spark, sf_dir).select(
        n.alias("conflict_id"), F.when(n % 3 == 0, "open").when(n % 3 == 1, "resolved").otherwise("dismissed").alias("status"), F.lit("minor").alias("conflict_type"),
        F.col("event_type").alias("dst_a"), F.concat(F.lit("user"), F.col("user_id") % 5).alias("dst_b"),
        F.when(n % 4 == 0, "high").when(n % 4 == 1, "medium").otherwise("low").alias("priority"), tables.seconds(F.col("ts")).alias("detected_at"),
    )


@query(f"WITH {_CONFLICTS} SELECT conflict_id, CASE WHEN status = 'open' AND conflict_id % 2 = 0 THEN 'dismissed' WHEN status = 'open' AND conflict_id % 5 = 0 THEN 'resolved' ELSE status END AS status FROM conflicts")
def settled_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts after some were dismissed and then some resolved."""
    all_ = _conflicts(spark, sf_dir)
    dismissed = c.settle(all_, all_.where("conflict_id % 2 = 0"), "dismissed")
    return c.settle(dismissed, all_.where("conflict_id % 5 = 0"), "resolved").select("conflict_id", "status")


@query(
    f"""WITH {_CONFLICTS}, t AS (SELECT conflict_id % 4 = 0 AS hit, * FROM conflicts), told AS (SELECT dst_a AS token FROM t WHERE hit UNION SELECT dst_b FROM t WHERE hit)
    SELECT 'type' AS what, CASE WHEN hit THEN 'preference' ELSE conflict_type END AS name, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'token', token, 1 FROM told"""
)
def reclassified_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts given another type, and the tokens that teaches."""
    all_ = _conflicts(spark, sf_dir)
    changes = all_.where("conflict_id % 4 = 0").select("conflict_id", F.lit("preference").alias("to"), F.lit("likes").alias("category"))
    out, told = c.reclassify(all_, changes)
    types = out.groupBy(F.lit("type").alias("what"), F.col("conflict_type").alias("name")).agg(F.count("*").alias("n"))
    return types.unionByName(told.select(F.lit("token").alias("what"), F.col("token").alias("name"), F.lit(1).cast("long").alias("n")))


@query(
    given(
        MEMORIES,
        body="""SELECT 'merge-' || a.rid || '-' || b.rid AS rid, a.text || ' | ' || b.text AS text, round(greatest(a.importance, b.importance), 6) AS importance, a.namespace
        FROM memories a JOIN memories b ON b.seq = a.seq + 1 WHERE a.seq % 40 = 0""",
    )
)
def merged_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories that merging makes."""
    m = _m(spark, sf_dir)
    s = F.col("seq")
    decisions = m.where("seq % 20 = 0").select(
        F.col("rid").alias("memory_a"), F.concat(F.lit("m"), s + 1).alias("memory_b"), F.when(s % 40 == 0, "merge").otherwise("keep_a").alias("strategy")
    )
    return c.merged_memories(m, decisions, NOW).select("rid", "text", F.round("importance", 6).alias("importance"), "namespace")


@query(
    given(
        CLAIMS, _SCOPED, MEMORIES,
        body="""
        SELECT x.claim_id_a, x.claim_id_b, ma.text AS text_a, mb.text AS text_b FROM conflicts x JOIN claims a ON a.claim_id = claim_id_a JOIN claims b ON b.claim_id = claim_id_b
        LEFT JOIN memories ma ON ma.rid = a.source_memory_rid LEFT JOIN memories mb ON mb.rid = b.source_memory_rid""",
    )
)
def conflict_memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts with what the memories behind both sides say."""
    found = _scoped(spark, sf_dir).select("claim_id_a", "claim_id_b")
    for s in "ab":
        side = tables.claims(spark, sf_dir).select(F.col("claim_id").alias(f"claim_id_{s}"), F.col("source_memory_rid").alias(f"memory_{s}"))
        found = found.join(side, f"claim_id_{s}")
    return c.with_texts(found, _m(spark, sf_dir)).select("claim_id_a", "claim_id_b", "text_a", "text_b")


@query(
    given(
        CLAIMS,
        body="""
        , allowed AS (SELECT claim_id, namespace = 'n3' AS ok FROM claims),
        p AS (SELECT a.dst <> b.dst AS other, a.polarity = 1 AND b.polarity = 1 AS both_yes, x.ok AND y.ok AS multi, a.dst IN ('F', 'O') OR b.dst IN ('F', 'O') AS vague,
            (a.valid_from IS NOT NULL OR a.valid_to IS NOT NULL) AND (b.valid_from IS NOT NULL OR b.valid_to IS NOT NULL) AS timed,
            coalesce(a.valid_to, 'infinity'::double) >= coalesce(b.valid_from, '-infinity'::double) AND coalesce(b.valid_to, 'infinity'::double) >= coalesce(a.valid_from, '-infinity'::double) AS meet
            FROM claims a JOIN claims b USING (src, rel_type) JOIN allowed x ON x.claim_id = a.claim_id JOIN allowed y ON y.claim_id = b.claim_id WHERE a.claim_id < b.claim_id),
        codes AS (SELECT 'multi_valued_relation_policy' AS code, count(*) FILTER (multi AND other) AS n FROM p
            UNION ALL SELECT 'entity_link_ambiguous', count(*) FILTER (vague) FROM p
            UNION ALL SELECT 'possible_temporal_succession', count(*) FILTER (other AND both_yes AND timed AND NOT meet) FROM p)
        SELECT code, n FROM codes WHERE n > 0""",
    )
)
def claim_policy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of claims the codes of time, policies and aliases hold for."""
    vague = spark.createDataFrame([("F", "filled", "*"), ("F", "finished", "n1"), ("O", "open", "*"), ("O", "ordered", "n2"), ("P", "pending", "*")], "alias string, canonical_name string, namespace string")
    found = c.pair_codes(tables.claims(spark, sf_dir), tables.policies(spark), vague).select(F.explode("codes").alias("code"))
    wanted = ("multi_valued_relation_policy", "entity_link_ambiguous", "possible_temporal_succession")
    return found.where(F.col("code").isin(*wanted)).groupBy("code").agg(F.count("*").alias("n"))


# ---- cognition


@query(
    given(
        MEMORIES, _CONFLICTS,
        body=f"""
        , trend AS (SELECT namespace, avg(valence) FILTER (created_at >= {NOW} - 604800) - avg(valence) FILTER (created_at < {NOW} - 604800) AS delta FROM active GROUP BY namespace),
        goals AS (SELECT rid, entity, importance FROM active WHERE seq % 25 = 1),
        fresh AS (SELECT DISTINCT entity FROM active WHERE created_at >= {NOW} - 14 * 86400.0::double),
        t AS (
            SELECT 'conflict_escalation' AS trigger_type, CASE priority WHEN 'high' THEN 0.7::double ELSE 0.5::double END + 0.3::double * least(1.0::double, greatest(0.0::double, {NOW}::double - detected_at) / 604800) AS urgency
                FROM conflicts WHERE status = 'open' AND priority <> 'low'
            UNION ALL SELECT 'pattern_discovered', (c_custkey % 10) / 10.0::double FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 >= 3
            UNION ALL SELECT 'valence_trend', least(1.0::double, abs(delta)) FROM trend WHERE abs(delta) >= 0.02
            UNION ALL SELECT CASE WHEN entity IN (SELECT entity FROM fresh) THEN 'goal_progress' ELSE 'goal_stagnation' END,
                CASE WHEN entity IN (SELECT entity FROM fresh) THEN importance / 2 ELSE importance END FROM goals
        )
        SELECT trigger_type, count(*) AS n, round(sum(urgency), 4) AS total FROM t GROUP BY trigger_type""",
    )
)
def other_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers of conflicts, patterns, moods and goals."""
    m, k = _m(spark, sf_dir), F.col("c_custkey")
    patterns = tables.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), k).alias("pattern_key"), (k % 10 / 10.0).alias("confidence"), (k % 5).alias("occurrence_count"), F.when(k % 2 == 0, "active").otherwise("stale").alias("status")
    )
    goals = g.active(m).where("seq % 25 = 1").select("rid", "entity", "importance")
    found = (
        g.conflict_triggers(_conflicts(spark, sf_dir), NOW).unionByName(g.pattern_triggers(patterns))
        .unionByName(g.valence_triggers(g.valence_trends(m, NOW), least=0.02)).unionByName(g.goal_triggers(goals, m, NOW))
    )
    return found.groupBy("trigger_type").agg(F.count("*").alias("n"), F.round(F.sum("urgency"), 4).alias("total"))


_SAME_ENTITY = cognition_queries._CLUSTERS.replace("embedding, sqrt", "embedding, entity, sqrt").replace("FROM e a JOIN e b ON a.rid < b.rid", "FROM e a JOIN e b ON a.rid < b.rid AND a.entity = b.entity")


@query(cognition_queries._recursive(MEMORIES, _SAME_ENTITY, body="SELECT cluster, rid, place FROM clusters"))
def clusters_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of memories that have an entity in common."""
    m = _m(spark, sf_dir)
    found = g.clusters(m, cognition_queries.SIMILAR, cognition_queries.WEEK, links=m.select("rid", "entity"))
    return found.withColumn("place", F.col("place").cast("long"))


@query(
    cognition_queries._recursive(
        MEMORIES, cognition_queries._CLUSTERS,
        body="SELECT coalesce('c-' || cluster, rid) AS rid, entity FROM memories LEFT JOIN clusters USING (rid) GROUP BY ALL",
    )
)
def consolidated_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of memories after consolidation has moved those of the sources."""
    return g.transfer_links(cognition_queries._clusters(spark, sf_dir), _m(spark, sf_dir).select("rid", "entity"))


@query(
    given(
        MEMORIES, cognition_queries._TRAITS,
        body="""SELECT namespace, trait_name, round(CASE WHEN trait_name = 'warmth' AND right(namespace, 1)::int % 2 = 0 THEN least(1.0::double, right(namespace, 1)::int / 4.0::double) ELSE score END, 6) AS score,
        round(CASE WHEN trait_name = 'warmth' AND right(namespace, 1)::int % 2 = 0 THEN 1 ELSE sample_count / (sample_count + 20.0::double) END, 6) AS confidence FROM traits""",
    )
)
def personality_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits of which some were set by hand."""
    m = _m(spark, sf_dir)
    digit = F.substring("namespace", -1, 1).cast("int")
    wanted = m.select("namespace").distinct().where(digit % 2 == 0).select("namespace", F.lit("warmth").alias("trait_name"), (digit / 4.0).alias("score"))
    out = g.set_traits(g.personality(m), wanted)
    return out.select("namespace", "trait_name", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query(
    given(
        cognition_queries._STATE,
        body=f"""
        , keyed AS (SELECT user_id, cooldown_key, max(urgency) AS urgency, {NOW}::double - 3600.0::double * (user_id % 60) AS created_at FROM urges GROUP BY user_id, cooldown_key),
        wanted AS (SELECT * FROM keyed WHERE {NOW}::double - created_at < 172800 AND NOT (cooldown_key = 'check_in' AND user_id % 2 = 0)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY urgency DESC, cooldown_key) AS place FROM wanted)
        SELECT CASE WHEN urgency >= 0.6 AND place <= 2 THEN 'popped' ELSE 'waiting' END AS state, split_part(cooldown_key, ':', 1) AS kind, count(*) AS n FROM placed GROUP BY ALL""",
    )
)
def urge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urges after the old have expired, some were suppressed, and the due ones were popped."""
    urges = cognition_queries._urges(spark, sf_dir).groupBy("user_id", "cooldown_key").agg(F.max("urgency").alias("urgency"))
    queue = urges.withColumn("created_at", F.lit(NOW) - 3600.0 * (F.col("user_id") % 60))
    queue = g.suppress_urges(g.expire_urges(queue, NOW), urges.where("cooldown_key = 'check_in' and user_id % 2 = 0"))
    popped, waiting = g.pop_urges(queue, threshold=0.6, most=2)
    both = popped.withColumn("state", F.lit("popped")).unionByName(waiting.withColumn("state", F.lit("waiting")))
    return both.groupBy("state", F.substring_index("cooldown_key", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    cognition_queries._recursive(
        MEMORIES, cognition_queries._DECAY_TRIGGERS, "best AS (SELECT * FROM active WHERE type = 'episodic' ORDER BY importance DESC, rid LIMIT 100)",
        cognition_queries._CLUSTERS.replace("FROM active WHERE embedding", "FROM best WHERE embedding"),
        body="""
        SELECT 'triggers' AS phase, (SELECT count(*) FROM decay_triggers) + (SELECT count(*) FROM ready) AS n_rows
        UNION ALL SELECT 'consolidation', count(DISTINCT cluster) FROM clusters
        UNION ALL SELECT 'personality', 4 * count(DISTINCT namespace) FROM active""",
    )
)
def think_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of thinking with consolidation: what each phase found."""
    config = g.ThinkConfig(
        run_conflict_scan=False, run_pattern_mining=False, consolidation_sim_threshold=cognition_queries.SIMILAR, consolidation_time_window_days=7
    )
    return g.think(_m(spark, sf_dir), tables.place_edges(spark, sf_dir), NOW, config)[1]


@query(
    """WITH e AS (SELECT 'Sarah' || chr(97 + (c_custkey % 26)::int) AS src, 'NATION' || c_nationkey AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'lives_in' ELSE 'visits' END AS rel_type FROM customer),
    t AS (SELECT src AS name, rel_type = 'lives_in' AS p, 'person' AS shape FROM e UNION ALL SELECT dst, false, 'tech' FROM e)
    SELECT name, any_value(shape) AS entity_type FROM t GROUP BY name"""
)
def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their types, of edges of which half are new."""
    k = F.col("c_custkey")
    all_ = tables.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Sarah"), F.chr(97 + k % 26)).alias("src"), F.concat(F.lit("NATION"), "c_nationkey").alias("dst"),
        F.when(k % 2 == 0, "lives_in").otherwise("visits").alias("rel_type"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("at"), k.alias("nth"),
    )
    return graph.relate(all_.where("nth % 4 < 2"), all_.where("nth % 4 >= 2"))[1]


# ---- log and exchange


@query("SELECT event_id, round(CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN epoch_us(date_trunc('day', ts)) / 1000000.0::double WHEN 2 THEN epoch_us(ts) / 1000000.0::double - 7200 ELSE epoch_us(ts) / 1000000.0::double END, 3) AS at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of all events, read from ISO 8601 texts of several forms; other texts are no times."""
    n, whole = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(n % 5 == 0, F.concat(whole, F.lit("Z"))).when(n % 5 == 1, whole).when(n % 5 == 2, F.concat(whole, F.lit("+0200")))
    text = text.when(n % 5 == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.lit("about "), whole))
    return _e(spark, sf_dir).select("event_id", F.round(dates.iso_seconds(text), 3).alias("at"))


_MARKS = """log AS (SELECT *, 'db' || (hlc % 3) AS db FROM oplog),
    marks AS (SELECT origin_actor AS peer, db, max(hlc) AS hlc, arg_max(op_id, (hlc, op_id)) AS op_id FROM log GROUP BY ALL)"""


@query(given(OPLOG, _MARKS, body="SELECT peer, db, hlc, op_id FROM marks"))
def peer_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks of peers after reports that came out of order."""
    log = tables.oplog(spark, sf_dir).withColumn("db", F.concat(F.lit("db"), F.col("hlc") % 3)).withColumnRenamed("origin_actor", "peer")
    even = F.substring("op_id", -1, 1).cast("int") % 2 == 0
    start = log.where("false").select("peer", "db", "hlc", "op_id")
    return oplog.advance(oplog.advance(start, log.where(~even)), log.where(even))


@query(
    given(
        OPLOG,
        body="""
        , log AS (SELECT *, 'db' || (hlc % 3) AS db FROM oplog),
        marks AS (SELECT origin_actor AS peer, db, max(hlc) AS hlc, arg_max(op_id, (hlc, op_id)) AS op_id FROM log WHERE right(op_id, 1) IN ('1', '3') AND hlc % 1000 < 10 GROUP BY ALL)
        SELECT m.peer, m.db, count(*) AS n FROM log l JOIN marks m USING (db) WHERE (l.hlc, l.op_id) > (m.hlc, m.op_id) GROUP BY ALL""",
    )
)
def sync_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each peer has yet to pull of each database."""
    log = tables.oplog(spark, sf_dir).withColumn("db", F.concat(F.lit("db"), F.col("hlc") % 3))
    seen = log.where(F.substring("op_id", -1, 1).isin("1", "3") & (F.col("hlc") % 1000 < 10)).withColumnRenamed("origin_actor", "peer")
    marks = oplog.advance(seen.where("false"), seen)
    return oplog.after_marks(log, marks).groupBy("peer", "db").agg(F.count("*").alias("n"))


@query("SELECT 'database' AS kind, 'db' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 UNION ALL SELECT 'token', 't' || c_custkey FROM customer WHERE c_custkey % 4 = 0 OR (c_custkey % 5 = 0 AND c_custkey % 10 <> 0)")
def control_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases and tokens after an import, which leaves out revoked tokens and replaces nothing."""
    k = F.col("c_custkey")
    customer = tables.table(spark, sf_dir, "customer")
    databases, tokens = customer.select(F.concat(F.lit("db"), k).alias("name"), k), customer.select(F.concat(F.lit("t"), k).alias("token_hash"), (k % 10 == 0).alias("revoked"), k)
    path = scratch(spark, "control")
    exchange.export_control(databases.where(k % 3 == 0), tokens.where(k % 5 == 0), path)
    have, held = exchange.import_control(databases.where(k % 2 == 0), tokens.where(k % 4 == 0), path)
    return have.select(F.lit("database").alias("kind"), "name").unionByName(held.select(F.lit("token").alias("kind"), F.col("token_hash").alias("name")))


@query(given(MEMORIES, body="SELECT namespace, count(*) AS n, count(*) AS embedded FROM memories WHERE consolidation_status <> 'tombstoned' GROUP BY namespace"))
def jsonl_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories imported from lines of JSON twice: with new ids and embeddings, and once."""
    m = _m(spark, sf_dir).where("consolidation_status <> 'tombstoned'").select("rid", "text", "namespace")
    lines = exchange.to_jsonl(m, tables.place_edges(spark, sf_dir))
    lines = lines.unionByName(spark.createDataFrame([("not json",)], "value string"))
    schema = "rid string, text string, namespace string"
    once = exchange.import_jsonl(lines, schema, m.select("rid"), exchange.hash_embedding(F.col("text")))
    twice = exchange.import_jsonl(lines, schema, once)
    new = once.select("rid", "namespace", "embedding").unionByName(twice.select("rid", "namespace"), allowMissingColumns=True)
    return new.groupBy("namespace").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))
