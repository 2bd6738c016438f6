"""Cognition queries over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.operators import cognition as g
from cairnmem.plans.registry import query
from cairnmem.plans.sql import MEMORIES, given
from cairnmem.sources import tables
from cairnmem.sources.tables import NOW

#: Similarity at which the test vectors form clusters.
SIMILAR = 0.35
WEEK = 604800.0

_LEFT = f"importance * pow(2.0::double, -({NOW}::double - last_access) / half_life)"


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    given(
        MEMORIES,
        body=f"""SELECT rid, round(importance, 6) AS original_importance, round({_LEFT}, 6) AS current_score, round(({NOW}::double - last_access) / 86400, 6) AS days_since_access
        FROM active WHERE {_LEFT} < 0.01""",
    )
)
def decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.faded(_m(spark, sf_dir), NOW), "original_importance", "current_score", "days_since_access")


_DECAY_TRIGGERS = f"""
decay_triggers AS (
    SELECT 'decay_review' AS trigger_type, importance * (1 - {_LEFT} / importance) AS urgency, rid AS source FROM active
    WHERE importance >= 0.5 AND {_LEFT} < 0.1 ORDER BY urgency DESC, rid LIMIT 5
),
ready AS (
    SELECT 'consolidation_ready' AS trigger_type, least(1.0::double, count(*) / 100.0::double) AS urgency, '' AS source FROM active WHERE type = 'episodic' HAVING count(*) >= 10
)
"""


def _flat(triggers: DataFrame) -> DataFrame:
    return triggers.select("trigger_type", F.round("urgency", 6).alias("urgency"), F.array_join("source_rids", ",").alias("source"))


@query(given(MEMORIES, _DECAY_TRIGGERS, body="SELECT trigger_type, round(urgency, 6) AS urgency, source FROM decay_triggers"))
def decay_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(g.decay_triggers(_m(spark, sf_dir), NOW))


@query(given(MEMORIES, _DECAY_TRIGGERS, body="SELECT trigger_type, round(urgency, 6) AS urgency, source FROM ready"))
def consolidation_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(g.consolidation_triggers(_m(spark, sf_dir)))


@query(
    given(MEMORIES, _DECAY_TRIGGERS, body="SELECT trigger_type, round(urgency, 6) AS urgency, source FROM (SELECT * FROM decay_triggers UNION ALL SELECT * FROM ready)")
)
def all_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(g.all_triggers(_m(spark, sf_dir), NOW))


@query(
    f"""WITH t AS (SELECT event_id AS trigger_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'delivered' WHEN 2 THEN 'acknowledged' ELSE 'dismissed' END AS status,
        {NOW}::double - 3600.0::double * (event_id % 60) AS created_at,
        CASE event_id % 5 WHEN 0 THEN 'delivered' WHEN 1 THEN 'acted' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'acknowledged' END AS goal FROM events),
    s AS (SELECT *, coalesce((status = 'pending' AND goal IN ('delivered', 'dismissed')) OR (status = 'delivered' AND goal IN ('acknowledged', 'acted', 'dismissed'))
        OR (status = 'acknowledged' AND goal IN ('acted', 'dismissed')), false) AS accepted FROM t),
    n AS (SELECT trigger_id, created_at, accepted, CASE WHEN accepted THEN goal ELSE status END AS status FROM s)
    SELECT trigger_id, accepted, CASE WHEN status IN ('pending', 'delivered', 'acknowledged') AND {NOW}::double - created_at >= 172800 THEN 'expired' ELSE status END AS status FROM n"""
)
def trigger_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    e = tables.table(spark, sf_dir, "events")
    status = F.when(n % 4 == 0, "pending").when(n % 4 == 1, "delivered").when(n % 4 == 2, "acknowledged").otherwise("dismissed")
    goal = F.when(n % 5 == 0, "delivered").when(n % 5 == 1, "acted").when(n % 5 == 2, "dismissed").when(n % 5 == 3, "acknowledged")
    triggers = e.select(n.alias("trigger_id"), status.alias("status"), (F.lit(NOW) - 3600.0 * (n % 60)).alias("created_at"))
    events = e.where("event_id % 5 <> 4").select(n.alias("trigger_id"), goal.alias("to"))
    return g.step_triggers(triggers, events, NOW).select("trigger_id", "accepted", "status")


_CLUSTERS = f"""
e AS (SELECT rid, created_at, importance, text, valence, half_life, embedding, sqrt(list_dot_product(embedding, embedding)) AS l FROM active WHERE embedding IS NOT NULL),
links AS (
    SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.rid < b.rid
    WHERE list_dot_product(a.embedding, b.embedding) / (a.l * b.l) >= {SIMILAR} AND abs(a.created_at - b.created_at) <= {WEEK}
),
ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach AS (SELECT x AS id, x AS root FROM ways UNION SELECT w.x, r.root FROM ways w JOIN reach r ON w.y = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
placed AS (
    SELECT root AS cluster, rid, row_number() OVER (PARTITION BY root ORDER BY importance DESC, rid) AS place, count(*) OVER (PARTITION BY root) AS n
    FROM roots JOIN memories ON rid = id
),
clusters AS (SELECT cluster, rid, place FROM placed WHERE n >= 2 AND place <= 10)
"""


def _recursive(*parts: str, body: str) -> str:
    return given(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.clusters(_m(spark, sf_dir), SIMILAR, WEEK)


@query(_recursive(MEMORIES, _CLUSTERS, body="SELECT cluster, rid, place FROM clusters"))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).withColumn("place", F.col("place").cast("long"))


_SUMMARY = "string_agg(text, ' | ' ORDER BY importance DESC, rid)"


@query(_recursive(MEMORIES, _CLUSTERS, body=f"SELECT cluster, {_SUMMARY} AS summary FROM clusters JOIN memories USING (rid) GROUP BY cluster"))
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.summaries(_clusters(spark, sf_dir), _m(spark, sf_dir))


@query(
    _recursive(
        MEMORIES, _CLUSTERS,
        body=f"""SELECT cluster, round(least(1, max(importance) * 1.1::double), 6) AS importance, round(avg(valence), 6) AS valence, {_SUMMARY} AS summary,
        string_agg(rid, ',' ORDER BY rid) AS consolidated_from FROM clusters JOIN memories USING (rid) GROUP BY cluster""",
    )
)
def consolidate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = g.consolidate(_clusters(spark, sf_dir), _m(spark, sf_dir))
    return _round(new, "importance", "valence").select("cluster", "importance", "valence", "summary", F.array_join("consolidated_from", ",").alias("consolidated_from"))


@query(
    _recursive(
        MEMORIES, _CLUSTERS,
        body="""SELECT m.rid, CASE WHEN c.rid IS NULL THEN consolidation_status ELSE 'consolidated' END AS consolidation_status,
        round(CASE WHEN c.rid IS NULL THEN importance ELSE importance * 0.3::double END, 6) AS importance FROM memories m LEFT JOIN clusters c USING (rid)""",
    )
)
def consolidated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    return _round(g.after_consolidation(_clusters(spark, sf_dir), m).select("rid", "consolidation_status", "importance"), "importance")


@query(
    _recursive(
        MEMORIES, _CLUSTERS,
        body="""
        , members AS (SELECT cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM clusters JOIN memories USING (rid))
        SELECT cluster, place, round(avg(x), 6) AS mean FROM members GROUP BY cluster, place""",
    )
)
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each cluster, a row for each position."""
    from cairnmem.functions.vectors import mean_vector

    own = _clusters(spark, sf_dir).join(_m(spark, sf_dir).select("rid", "embedding"), "rid")
    means = mean_vector(own, ["cluster"], "embedding")
    return means.select("cluster", F.posexplode("mean").alias("place", "mean")).select("cluster", F.col("place").cast("long"), F.round("mean", 6).alias("mean"))


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey AS rid, 'supplier' || l_suppkey AS entity FROM lineitem)
    SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM l x JOIN l y ON x.rid = y.rid AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 3"""
)
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers named together by at least three orders."""
    links = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rid"), F.concat(F.lit("supplier"), "l_suppkey").alias("entity"))
    return g.cooccurrence(links, 3)


_TIMES = "SELECT domain, dayofweek(make_timestamp((created_at * 1000000)::bigint)) + 1 AS dow, hour(make_timestamp((created_at * 1000000)::bigint)) AS hour, count(*) AS n FROM active GROUP BY ALL HAVING count(*) >= 15"


@query(given(MEMORIES, body=_TIMES))
def temporal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.temporal_clusters(_m(spark, sf_dir), least=15)
    return found.select("domain", F.col("dow").cast("long"), F.col("hour").cast("long"), "n")


_TREND = f"""
trend AS (SELECT namespace, avg(valence) FILTER (created_at >= {NOW} - {WEEK}) AS recent_avg, avg(valence) FILTER (created_at < {NOW} - {WEEK}) AS baseline_avg FROM active GROUP BY namespace)
"""


@query(
    given(
        MEMORIES, _TREND,
        body="""SELECT namespace, round(recent_avg, 6) AS recent_avg, round(baseline_avg, 6) AS baseline_avg, round(recent_avg - baseline_avg, 6) AS delta,
        CASE WHEN recent_avg < baseline_avg THEN 'negative' WHEN recent_avg > baseline_avg THEN 'positive' ELSE 'stable' END AS direction FROM trend WHERE recent_avg IS NOT NULL AND baseline_avg IS NOT NULL""",
    )
)
def valence_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.valence_trends(_m(spark, sf_dir), NOW), "recent_avg", "baseline_avg", "delta")


@query(
    """SELECT label, source_kind, count(*) AS n FROM (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source_kind FROM embeddings) GROUP BY ALL HAVING count(*) >= 5"""
)
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thematic groups of labelled vectors."""
    kind = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("source_kind")
    return g.topic_clusters(tables.table(spark, sf_dir, "embeddings"), "label", kind)


@query(
    f"""WITH old AS (SELECT 'p' || c_custkey AS pattern_key, 0.5::double AS confidence, 1000.0::double AS first_seen, 2000.0::double AS last_confirmed, c_custkey % 4 + 1 AS occurrence_count FROM customer WHERE c_custkey % 2 = 0),
    new AS (SELECT 'p' || c_custkey AS pattern_key, 0.9::double AS confidence FROM customer WHERE c_custkey % 3 = 0)
    SELECT pattern_key, coalesce(n.confidence, o.confidence) AS confidence, coalesce(first_seen, {NOW}) AS first_seen, CASE WHEN n.confidence IS NULL THEN last_confirmed ELSE {NOW} END AS last_confirmed,
        coalesce(occurrence_count, 0) + CASE WHEN n.confidence IS NULL THEN 0 ELSE 1 END AS occurrence_count, CASE WHEN n.confidence IS NULL THEN 'stale' ELSE 'active' END AS status,
        CASE WHEN n.confidence IS NULL THEN 'kept' WHEN o.confidence IS NULL THEN 'new' ELSE 'updated' END AS change
    FROM old o FULL JOIN new n USING (pattern_key)"""
)
def pattern_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    customer = tables.table(spark, sf_dir, "customer").withColumn("pattern_key", F.concat(F.lit("p"), k))
    old = customer.where("c_custkey % 2 = 0").select(
        "pattern_key", F.lit(0.5).alias("confidence"), F.lit(1000.0).alias("first_seen"), F.lit(2000.0).alias("last_confirmed"), (k % 4 + 1).alias("occurrence_count")
    )
    return g.upsert_patterns(old, customer.where("c_custkey % 3 = 0").select("pattern_key", F.lit(0.9).alias("confidence")), NOW)


_TRAITS = """
one AS (
    SELECT namespace, (1 + avg(valence)) / 2 AS warmth, avg(abs(valence)) AS energy, avg(CASE WHEN type IN ('semantic', 'procedural') THEN 1.0::double ELSE 0 END) AS depth,
        avg(importance) AS attentiveness, count(*) AS sample_count FROM active GROUP BY namespace
),
traits AS (
    SELECT namespace, 'warmth' AS trait_name, warmth AS score, sample_count FROM one UNION ALL SELECT namespace, 'energy', energy, sample_count FROM one
    UNION ALL SELECT namespace, 'depth', depth, sample_count FROM one UNION ALL SELECT namespace, 'attentiveness', attentiveness, sample_count FROM one
)
"""


@query(
    given(MEMORIES, _TRAITS, body="SELECT namespace, trait_name, round(score, 6) AS score, round(sample_count / (sample_count + 20.0::double), 6) AS confidence, sample_count FROM traits")
)
def personality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.personality(_m(spark, sf_dir)), "score", "confidence")


@query(given(MEMORIES, _TRAITS, body="SELECT namespace, trait_name, CASE WHEN score > 0.6 THEN 'high' WHEN score < 0.4 THEN 'low' ELSE 'even' END AS level FROM traits"))
def personality_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.tone(g.personality(_m(spark, sf_dir)))


@query(given(MEMORIES, body=f"SELECT rid, last_access FROM active WHERE importance >= 0.5 AND last_access <= {NOW} - 20 * 86400.0::double ORDER BY active.last_access, rid LIMIT 10"))
def stale_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.stale(_m(spark, sf_dir), NOW, days=20).select("rid", "last_access")


@query(
    given(
        MEMORIES,
        body=f"""
        , d AS (SELECT rid, {NOW}::double + (json_extract(metadata, '$.k')::double - 50) * 86400 AS deadline FROM active)
        SELECT rid, round(deadline, 3) AS deadline FROM d WHERE d.deadline BETWEEN {NOW} AND {NOW} + 7 * 86400.0::double ORDER BY d.deadline, rid LIMIT 10""",
    )
)
def upcoming_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines of the next week, from the metadata."""
    at = F.lit(NOW) + (F.get_json_object("metadata", "$.k").cast("double") - 50) * 86400
    m = _m(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(at.cast("decimal(20,6)").alias("remind_at"))))
    return g.upcoming(m, NOW).select("rid", F.round("deadline", 3).alias("deadline"))


_SIGNALS = {"similarity": 0.50, "decay": 0.20, "recency": 0.30}


def _learned(signals: dict[str, float]) -> str:
    total = "(similarity + decay + recency)"
    moved = {s: f"CASE WHEN count(*) < 5 THEN {w}::double ELSE greatest(0.05::double, least(0.9::double, {w}::double + 0.01::double * sum(sign * {s} / {total}))) END" for s, w in signals.items()}
    one = ", ".join(f"{c} AS {s}" for s, c in moved.items())
    rows = " UNION ALL ".join(f"SELECT user_id, '{s}' AS signal, round({s} / {total}, 6) AS weight FROM o" for s in signals)
    return f"""WITH f AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS sign, value / 100 AS similarity, (event_id % 10) / 10.0::double AS decay,
        (event_id % 7 + 1) / 7.0::double AS recency FROM events), o AS (SELECT user_id, {one} FROM f GROUP BY user_id) {rows}"""


@query(_learned(_SIGNALS))
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each user after a generation of all their feedback."""
    n = F.col("event_id")
    f = tables.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").isin("purchase", "signup").alias("relevant"), (F.col("value") / 100).alias("similarity"), (n % 10 / 10.0).alias("decay"),
        ((n % 7 + 1) / 7.0).alias("recency"),
    )
    return _round(g.learn_weights(f, _SIGNALS, least_events=5, by=("user_id",)), "weight")


@query(
    given(
        MEMORIES,
        body="""
        , o AS (SELECT rid, avg((seq % 3) / 2.0::double) AS outcome FROM memories WHERE seq % 20 = 0 GROUP BY rid)
        SELECT rid, round(coalesce(importance * 0.8::double + outcome * 0.2::double, importance), 6) AS effectiveness FROM memories LEFT JOIN o USING (rid) WHERE type = 'procedural'""",
    )
)
def procedural_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    return _round(g.reinforce_procedural(m, m.where("seq % 20 = 0").select("rid", (F.col("seq") % 3 / 2.0).alias("outcome"))), "effectiveness")


_STATE = f"""
state AS (
    SELECT user_id, ({NOW}::double - max(epoch_us(ts) / 1000000.0::double)) / 3600 AS hours_idle, count(*) FILTER (event_type = 'error') AS open_conflicts,
        avg(value / 100) FILTER (event_id % 2 = 0) AS recent_avg, avg(value / 100) FILTER (event_id % 2 = 1) AS baseline_avg FROM events GROUP BY user_id
),
pending AS (
    SELECT user_id, event_id AS trigger_id, CASE event_type WHEN 'error' THEN 'decay_review' WHEN 'click' THEN 'pattern_discovered' ELSE 'reminder_due' END AS trigger_type,
        least(1.0::double, value / 200) AS urgency FROM events WHERE event_type IN ('error', 'click', 'signup')
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, trigger_type ORDER BY trigger_id) AS n FROM pending),
urges AS (
    SELECT user_id, 'check_in' AS instinct, least(0.8::double, (hours_idle - 8) / 16) AS urgency, 'check_in' AS cooldown_key FROM state WHERE hours_idle >= 8
    UNION ALL SELECT user_id, 'conflict_alerting', least(0.8::double, open_conflicts / 10.0::double), 'conflict_alerting' FROM state WHERE open_conflicts >= 5
    UNION ALL SELECT user_id, 'emotional_awareness', least(0.9::double, abs(recent_avg - baseline_avg)), 'emotional_awareness:negative' FROM state WHERE recent_avg < baseline_avg
    UNION ALL SELECT user_id, 'follow_up', least(0.7::double, urgency), 'follow_up:' || trigger_id FROM numbered WHERE trigger_type = 'decay_review' AND n <= 2
    UNION ALL SELECT user_id, 'pattern_surfacing', urgency, 'pattern_surfacing:' || trigger_id FROM numbered WHERE trigger_type = 'pattern_discovered' AND n <= 2
    UNION ALL SELECT user_id, 'reminder', greatest(0.6::double, urgency), 'reminder:' || trigger_id FROM numbered WHERE trigger_type = 'reminder_due'
)
"""


def _urges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    v, even = F.col("value") / 100, F.col("event_id") % 2 == 0
    state = e.groupBy("user_id").agg(
        ((F.lit(NOW) - F.max(tables.seconds(F.col("ts")))) / 3600).alias("hours_idle"), F.count_if(F.col("event_type") == "error").alias("open_conflicts"),
        F.avg(F.when(even, v)).alias("recent_avg"), F.avg(F.when(~even, v)).alias("baseline_avg"),
    )
    kind = F.when(F.col("event_type") == "error", "decay_review").when(F.col("event_type") == "click", "pattern_discovered").otherwise("reminder_due")
    pending = e.where(F.col("event_type").isin("error", "click", "signup")).select(
        "user_id", F.col("event_id").alias("trigger_id"), kind.alias("trigger_type"), F.least(F.lit(1.0), F.col("value") / 200).alias("urgency")
    )
    return g.instincts(state, pending)


@query(given(_STATE, body="SELECT user_id, instinct, round(urgency, 6) AS urgency, cooldown_key FROM urges"))
def instinct_urges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_urges(spark, sf_dir), "urgency")


@query(
    given(
        _STATE,
        body="""
        , keyed AS (SELECT user_id, instinct AS cooldown_key, least(1.0::double, max(urgency) + 0.1::double * (count(*) - 1)) AS urgency, count(*) - 1 AS boost_count FROM urges GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY urgency DESC, cooldown_key) AS place FROM keyed)
        SELECT user_id, cooldown_key, round(urgency, 6) AS urgency, boost_count, place FROM placed WHERE place <= 4""",
    )
)
def urge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urges of one kind merged, and the four most urgent of each user."""
    merged = g.queue_urges(_urges(spark, sf_dir).withColumn("cooldown_key", F.col("instinct")), most=4)
    return _round(merged, "urgency").select("user_id", "cooldown_key", "urgency", "boost_count", F.col("place").cast("long"))


@query(
    given(
        MEMORIES, _DECAY_TRIGGERS,
        body="""
        , e AS (SELECT DISTINCT src, rel_type, dst FROM (SELECT 'customer' || o_custkey AS src, 'prefers' AS rel_type, o_orderpriority AS dst FROM orders)),
        degree AS (SELECT x, count(DISTINCT y) AS d FROM (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e) GROUP BY x)
        SELECT 'triggers' AS phase, (SELECT count(*) FROM decay_triggers) + (SELECT count(*) FROM ready) AS n_rows
        UNION ALL SELECT 'conflicts', count(*) FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst
        UNION ALL SELECT 'patterns', count(*) FROM degree WHERE d >= 5
        UNION ALL SELECT 'personality', 4 * count(DISTINCT namespace) FROM active""",
    )
)
def think_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of thinking without consolidation: what each phase found."""
    edges = tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer"), "o_custkey").alias("src"), F.lit("prefers").alias("rel_type"), F.col("o_orderpriority").alias("dst"), F.lit(1.0).alias("weight")
    )
    return g.think(_m(spark, sf_dir), edges, NOW, g.ThinkConfig(run_consolidation=False))[1]
