"""Lifecycle, session, log and exchange queries over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.operators import graph, lifecycle, oplog
from cairnmem.plans.registry import query
from cairnmem.plans.sql import EDGE_LOG, MEMORIES, OPLOG, given
from cairnmem.runtime import scratch
from cairnmem.sources import exchange, synthetic, tables, tenants
from cairnmem.sources.tables import NOW
from cairnmem.streaming import events as streams


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'semantic' ELSE 'episodic' END AS type, 0.5::double AS importance, 604800.0::double AS half_life,
        CASE WHEN turn = 1 THEN 'work' ELSE 'general' END AS domain, 'active' AS consolidation_status, 'default' AS namespace FROM conversations WHERE text IS NOT NULL"""
)
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New memories from conversations, with defaults."""
    new = tables.turns(spark, sf_dir).select(
        "conv_id", "turn", "text", (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.when(F.col("role") == "system", "semantic").alias("type"),
        F.when(F.col("turn") == 1, "work").alias("domain"),
    )
    return lifecycle.record(new, NOW).select("conv_id", "turn", "type", "importance", "half_life", "domain", "consolidation_status", "namespace")


@query(given(MEMORIES, body="SELECT rid, type, text, consolidation_status FROM memories WHERE rid = 'm23'"))
def get_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.get(_m(spark, sf_dir), "m23").select("rid", "type", "text", "consolidation_status")


@query(
    given(
        MEMORIES,
        body="SELECT rid, (SELECT count(*) FROM memories WHERE domain = 'click') AS total FROM memories WHERE domain = 'click' ORDER BY created_at DESC, rid LIMIT 25 OFFSET 50",
    )
)
def list_memories_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.page(_m(spark, sf_dir), limit=25, offset=50, domain="click").select("rid", "total")


@query(
    given(
        MEMORIES,
        body="""SELECT namespace, count(*) FILTER (consolidation_status = 'active') AS active_memories, count(*) FILTER (consolidation_status = 'consolidated') AS consolidated_memories,
        count(*) FILTER (consolidation_status = 'tombstoned') AS tombstoned_memories, count(*) FILTER (storage_tier = 'cold') AS archived_memories, count(*) FILTER (type = 'episodic') AS episodic,
        count(*) FILTER (type = 'semantic') AS semantic, count(*) FILTER (type = 'procedural') AS procedural, count(embedding) AS vector_index_entries, count(*) AS total FROM memories GROUP BY namespace""",
    )
)
def stats_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stats(_m(spark, sf_dir))


@query(
    given(
        MEMORIES,
        body="SELECT namespace, domain, type, count(*) AS n, sum(importance::decimal(20, 9))::double / count(*) AS avg_importance FROM active GROUP BY ROLLUP (namespace, domain, type)",
    )
)
def rollup_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means at every level (an extension).

    Means are of exact sums: one of doubles depends on the order of summation, and so does its rounding.
    """
    own = _m(spark, sf_dir).where("consolidation_status = 'active'")
    mean = F.sum(F.col("importance").cast("decimal(20,9)")).cast("double") / F.count("*")
    return own.rollup("namespace", "domain", "type").agg(F.count("*").alias("n"), mean.alias("avg_importance"))


@query(given(MEMORIES, body="SELECT domain, count(*) AS n, round(avg(importance), 6) AS avg_effectiveness FROM active WHERE type = 'procedural' GROUP BY domain"))
def procedural_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lifecycle.procedural_stats(_m(spark, sf_dir)), "avg_effectiveness")


@query(
    given(
        MEMORIES,
        body=f"""
        , own AS (SELECT * FROM active WHERE entity = 'customer8' AND created_at >= {NOW} - 90 * 86400.0::double),
        d AS (SELECT string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain) AS domains FROM (SELECT domain, count(*) AS n FROM own GROUP BY domain))
        SELECT 'customer8' AS entity, count(*) AS mention_count, count(DISTINCT session_id) AS session_count, round(avg(valence), 6) AS avg_valence,
            round(coalesce(avg(valence) FILTER (created_at >= {NOW} - 45 * 86400.0::double), 0) - coalesce(avg(valence) FILTER (created_at < {NOW} - 45 * 86400.0::double), 0), 6) AS valence_trend,
            min(created_at) AS first_seen, max(created_at) AS last_seen, round(count(*) / 90.0::double, 6) AS interaction_frequency, any_value(domains) AS domains FROM own, d""",
    )
)
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _round(lifecycle.entity_profile(_m(spark, sf_dir), "customer8", NOW), "avg_valence", "valence_trend", "interaction_frequency")
    return p.select("entity", "mention_count", "session_count", "avg_valence", "valence_trend", "first_seen", "last_seen", "interaction_frequency", "domains")


@query(
    given(
        MEMORIES, EDGE_LOG,
        body="""
        , own AS (SELECT entity, count(DISTINCT session_id) AS sessions_together, count(*) AS memories_mentioning, avg(valence) AS avg_valence,
            string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains_spanning, count(DISTINCT domain) AS n_domains FROM active GROUP BY entity),
        degree AS (SELECT src AS entity, count(DISTINCT dst) AS connection_count FROM edge_log GROUP BY src)
        SELECT entity, sessions_together, memories_mentioning, round(avg_valence, 6) AS avg_valence, domains_spanning, coalesce(connection_count, 0) AS connection_count,
            round(1 - exp(-(memories_mentioning / 20.0::double + sessions_together / 10.0::double + n_domains / 5.0::double + coalesce(connection_count, 0) / 10.0::double) / 4), 6) AS depth_score
        FROM own LEFT JOIN degree USING (entity)""",
    )
)
def relationship_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = graph.both_ways(tables.edge_log(spark, sf_dir)).select("entity", "other", "rel_type")
    out = _round(lifecycle.relationship_depth(_m(spark, sf_dir), ways), "avg_valence", "depth_score")
    return out.select("entity", "sessions_together", "memories_mentioning", "avg_valence", "domains_spanning", "connection_count", "depth_score")


@query(
    given(
        MEMORIES,
        body="""SELECT session_id, min(created_at) AS started_at, round(max(created_at) - min(created_at), 6) AS duration, count(*) AS memory_count, round(avg(valence), 6) AS avg_valence,
        string_agg(DISTINCT domain, ',' ORDER BY domain) AS topics FROM memories GROUP BY session_id""",
    )
)
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lifecycle.session_summary(_m(spark, sf_dir)), "duration", "avg_valence")


_SESSIONS = """
at_events AS (SELECT user_id, epoch_us(ts) / 1000000.0::double AS t FROM events),
flagged AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS first FROM at_events),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM flagged),
sessions AS (SELECT user_id, session::bigint AS session, min(t) AS started_at, max(t) AS ended_at, count(*) AS n_events FROM numbered GROUP BY ALL)
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = tables.table(spark, sf_dir, "events").select("user_id", tables.seconds(F.col("ts")).alias("at"))
    return lifecycle.sessions_by_gap(at)


@query(given(_SESSIONS, body="SELECT user_id, session, started_at, ended_at, n_events FROM sessions"))
def sessions_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@query(
    given(
        _SESSIONS,
        body="SELECT user_id, session, started_at, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, session DESC) AS place FROM sessions QUALIFY place <= 3",
    )
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest_sessions(_sessions(spark, sf_dir), 3).select("user_id", "session", "started_at", F.col("place").cast("long"))


@query(given(_SESSIONS, body="SELECT CASE WHEN 1706600000 - ended_at > 86400 THEN 'abandoned' ELSE 'active' END AS status, count(*) AS n FROM sessions GROUP BY ALL"))
def sessions_abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.abandon(_sessions(spark, sf_dir), 1706600000.0).groupBy("status").agg(F.count("*").alias("n"))


@query(
    given(
        MEMORIES,
        body=f"""SELECT rid, round(importance * pow(2.0::double, -({NOW}::double - last_access) / half_life), 6) AS current_score FROM active WHERE storage_tier = 'hot'
        ORDER BY importance * pow(2.0::double, -({NOW}::double - last_access) / half_life), rid LIMIT greatest(0, (SELECT count(*) FROM active WHERE storage_tier = 'hot') - 800)""",
    )
)
def evict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(lifecycle.evict(_m(spark, sf_dir), NOW, 800), "current_score")


@query(given(MEMORIES, body="SELECT rid, CASE WHEN seq % 10 = 3 THEN 'tombstoned' ELSE consolidation_status END AS consolidation_status FROM memories"))
def forget_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    return lifecycle.forget(m, m.where("seq % 10 = 3")).select("rid", "consolidation_status")


@query(
    given(
        MEMORIES,
        body="""
        , hit AS (SELECT * FROM memories WHERE seq % 50 = 7 AND consolidation_status <> 'tombstoned')
        SELECT rid, text, CASE WHEN rid IN (SELECT rid FROM hit) THEN 'tombstoned' ELSE consolidation_status END AS consolidation_status, namespace FROM memories
        UNION ALL SELECT rid || '-corrected', 'corrected ' || text, consolidation_status, namespace FROM hit""",
    )
)
def correct_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    new = m.where("seq % 50 = 7").select("rid", F.concat(F.lit("corrected "), "text").alias("text"))
    return lifecycle.correct(m, new, NOW).select("rid", "text", "consolidation_status", "namespace")


@query(given(MEMORIES, body="SELECT CASE WHEN seq % 9 = 2 THEN 'cold' ELSE storage_tier END AS storage_tier, count(*) AS n FROM memories GROUP BY ALL"))
def archive_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _m(spark, sf_dir)
    return lifecycle.set_tier(m, m.where("seq % 9 = 2"), "cold").groupBy("storage_tier").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::bigint AS used FROM conversations) WHERE used <= 400"""
)
def token_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns of each conversation that fit a budget of tokens."""
    kept = lifecycle.within_budget(tables.turns(spark, sf_dir), "conv_id", [F.desc("turn")], F.floor(F.length("text") / 4), 400)
    return kept.select("conv_id", "turn", "used")


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


@query(
    " UNION ALL ".join(
        f"SELECT event_type, {b}::double AS le, count(*) FILTER (value <= {b}) AS n, round(sum(value), 4) AS total, count(*) AS count FROM events GROUP BY event_type" for b in _BOUNDS
    )
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lifecycle.latency_histogram(tables.table(spark, sf_dir, "events"), "value", _BOUNDS, "event_type")
    return h.select("event_type", "le", "n", F.round("sum", 4).alias("total"), "count")


@query(
    """WITH b AS (SELECT n_name AS category, ' Word' || s_suppkey % 7 AS token, s_acctbal / 10000 AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'seed' ELSE 'learned' END AS source,
        s_suppkey % 2 AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT category, lower(trim(token)) AS token_normalized, round(max(confidence), 6) AS confidence FROM b GROUP BY ALL"""
)
def substitution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.table(spark, sf_dir, "supplier").join(tables.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    token = F.concat(F.lit(" Word"), (F.col("s_suppkey") % 7).cast("string"))
    kind = F.when(F.col("s_suppkey") % 2 == 0, "seed").otherwise("learned")
    rows = s.select(F.col("n_name").alias("category"), token.alias("token"), (F.col("s_acctbal") / 10000).alias("confidence"), kind.alias("source"))
    out = lifecycle.upsert_members(rows.where("source = 'seed'"), rows.where("source = 'learned'"))
    return _round(out.select("category", "token_normalized", "confidence"), "confidence")


@query(
    """SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 7 * n_nationkey ELSE 1000 END AS max_memories, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE 5 END AS max_sessions FROM nation"""
)
def quotas_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas, or defaults where there are none: a left join."""
    k = F.col("n_nationkey")
    nation = tables.table(spark, sf_dir, "nation")
    quotas = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), (7 * k).alias("max_memories"), k.alias("max_sessions"))
    return exchange.quota_of(nation.select(F.col("n_name").alias("name")), quotas, {"max_memories": 1000, "max_sessions": 5})


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'imported' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"""
)
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that keeps what is there: an anti join."""
    customer = tables.table(spark, sf_dir, "customer").select("c_custkey")
    old = customer.where("c_custkey % 2 = 0").withColumn("origin", F.lit("kept"))
    new = customer.where("c_custkey % 3 = 0").withColumn("origin", F.lit("imported"))
    return exchange.merge_new(old, new, ["c_custkey"])


@query(given(MEMORIES, body="SELECT rid, type, round(importance, 6) AS importance, namespace FROM memories WHERE consolidation_status <> 'tombstoned'"))
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories as lines of JSON, and back."""
    m = _m(spark, sf_dir).where("consolidation_status <> 'tombstoned'").select("rid", F.col("type").alias("kind"), "importance", "namespace")
    e = tables.place_edges(spark, sf_dir)
    back = exchange.from_jsonl(exchange.to_jsonl(m, e), "memory", "rid string, kind string, importance double, namespace string")
    return back.select("rid", F.col("kind").alias("type"), F.round("importance", 6).alias("importance"), "namespace")


@query(given(MEMORIES, body="SELECT rid, text FROM memories"))
def encrypted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encrypted and decrypted again."""
    key = bytes(range(32))
    return _m(spark, sf_dir).select("rid", exchange.decrypted(exchange.encrypted(F.col("text"), key), key).alias("text"))


@query(given(MEMORIES, body="SELECT namespace, count(*) AS n, count(embedding) AS had FROM memories GROUP BY namespace"))
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory has an embedding after a backfill."""
    m = _m(spark, sf_dir).withColumn("had", F.col("embedding").isNotNull())
    filled = oplog.backfill_embeddings(m, exchange.hash_embedding(F.col("text")))
    return filled.where("embedding is not null").groupBy("namespace").agg(F.count("*").alias("n"), F.count_if("had").alias("had"))


@query(
    given(
        OPLOG,
        body="""
        , after AS (SELECT hlc, op_id FROM oplog ORDER BY hlc, op_id LIMIT 1 OFFSET 100)
        SELECT oplog.op_id, oplog.hlc FROM oplog, after WHERE (oplog.hlc, oplog.op_id) > (after.hlc, after.op_id) AND origin_actor <> 'device1' ORDER BY oplog.hlc, oplog.op_id LIMIT 50""",
    )
)
def oplog_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of operations after a cursor."""
    log = tables.oplog(spark, sf_dir)
    at = log.orderBy("hlc", "op_id").limit(101).orderBy(F.desc("hlc"), F.desc("op_id")).first()
    return oplog.since(log, at["hlc"], at["op_id"], "device1", 50).select("op_id", "hlc")


@query(
    given(
        OPLOG,
        body="""SELECT target_rid, arg_max(importance, (hlc, op_id)) FILTER (op_type <> 'forget') AS importance, arg_max(origin_actor, (hlc, op_id)) FILTER (op_type <> 'forget') AS last_writer,
        count(*) FILTER (op_type <> 'forget') AS n_writes, max(hlc) AS last_hlc, bool_or(op_type = 'forget') AS tombstoned FROM oplog GROUP BY target_rid""",
    )
)
def oplog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from operations, some of them delivered twice."""
    log = tables.oplog(spark, sf_dir)
    return oplog.fold(log.unionByName(log.where("hlc % 3 = 0")))


@query(
    given(
        OPLOG,
        body="SELECT count(*) FILTER (right(op_id, 1) IN ('7', '9')) AS applied, count(*) FILTER (right(op_id, 1) IN ('1', '3', '5')) + count(*) FILTER (right(op_id, 1) = '9') AS skipped FROM oplog",
    )
)
def oplog_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations applied once, however often they come."""
    log = tables.oplog(spark, sf_dir)
    last = F.substring("op_id", -1, 1)
    incoming = log.where(last.isin("1", "3", "5", "7", "9")).unionByName(log.where(last == "9"))
    return oplog.apply(log.where(~last.isin("7", "9")), incoming)[1]


@query(given(MEMORIES, body="SELECT namespace, count(*) AS n FROM memories WHERE importance > 0.25 GROUP BY namespace"))
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any SQL, with parameters."""
    statement = "SELECT namespace, count(*) AS n FROM memories_view WHERE importance > :least GROUP BY namespace"
    return tenants.query(spark, {"memories_view": _m(spark, sf_dir)}, statement, {"least": 0.25})


@query("SELECT 5000 AS n, 5000 AS n_rids, true AS in_range")
def synthetic_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic memories: as many as asked for, each with an id of its own, in range."""
    fine = (F.col("importance").between(0, 1) & F.col("valence").between(-1, 1) & (F.col("created_at") <= NOW)).alias("fine")
    one = synthetic.life(spark, 5000, NOW).select("rid", fine)
    return one.agg(F.count("*").alias("n"), F.countDistinct("rid").alias("n_rids"), F.min("fine").alias("in_range"))


@query("SELECT sum(epoch_us(ts) % 1000003)::bigint AS mark, count(*) AS n_rows, true AS intact FROM events")
def snapshot_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a version and read again: its rows, a mark that no order changes, and whether the
    checksum of the manifest holds."""
    path = scratch(spark, "snapshot")
    manifest = exchange.snapshot({"events": tables.table(spark, sf_dir, "events")}, path, 1).select("checksum")
    back = spark.read.parquet(f"{path}/v1/events")
    mark = back.agg(F.sum(F.unix_micros(F.col("ts").cast("timestamp")) % 1000003).alias("mark"), F.count("*").alias("n_rows"))
    now = exchange.checksum(back.repartition(7)).select(F.col("checksum").alias("now"))
    # One row each.
    return mark.crossJoin(F.broadcast(manifest)).crossJoin(F.broadcast(now)).select("mark", "n_rows", (F.col("checksum") == F.col("now")).alias("intact"))


@query(given(OPLOG, body="SELECT op_id FROM oplog WHERE right(op_id, 1) = '4'"))
def oplog_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.oplog(spark, sf_dir)
    return oplog.unseen(log, log.where(F.substring("op_id", -1, 1) != "4")).select("op_id")


@query(given(OPLOG, body="SELECT op_id, hlc FROM oplog ORDER BY hlc DESC, op_id DESC LIMIT 1000"))
def oplog_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.newest(tables.oplog(spark, sf_dir), 1000).select("op_id", "hlc")


@query(given(OPLOG, body="SELECT origin_actor, max(hlc) AS hlc, arg_max(op_id, (hlc, op_id)) AS op_id FROM oplog GROUP BY origin_actor"))
def last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.last_position(tables.oplog(spark, sf_dir), "origin_actor")


@query(
    given(
        OPLOG,
        body="""
        , peers AS (SELECT origin_actor AS peer, min(hlc) AS h, arg_min(op_id, (hlc, op_id)) AS o FROM oplog GROUP BY origin_actor)
        SELECT peer, count(*) AS behind FROM oplog, peers WHERE (hlc, op_id) > (h, o) GROUP BY peer""",
    )
)
def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.oplog(spark, sf_dir)
    peers = log.groupBy("origin_actor").agg(F.min(oplog.position()).alias("p")).select(F.col("origin_actor").alias("peer"), "p.hlc", "p.op_id")
    return oplog.lag(log, peers)


@query(
    """WITH a AS (SELECT target_rid AS c, 'm' || (event_id % 40) AS m FROM (SELECT 'm' || (event_id % 997) AS target_rid, event_id FROM events) WHERE event_id % 2 = 0),
    b AS (SELECT 'm' || (event_id % 997) AS c, 'm' || (event_id % 40) AS m FROM events WHERE event_id % 3 = 0)
    SELECT c AS cluster, count(*) AS n_members FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY c"""
)
def members_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidation members of two replicas: a union of sets."""
    n = F.col("event_id")
    rows = tables.table(spark, sf_dir, "events").select(n, F.concat(F.lit("m"), n % 997).alias("cluster"), F.concat(F.lit("m"), n % 40).alias("member"))
    both = oplog.union_members(rows.where("event_id % 2 = 0"), rows.where("event_id % 3 = 0"))
    return both.groupBy("cluster").agg(F.count("*").alias("n_members"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 day, ts)) // 1000000 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows, in their batch form."""
    return streams.tumbling(_events(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query(
    """SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([(epoch_us(ts) // 1000000) // 43200 * 43200, (epoch_us(ts) // 1000000) // 43200 * 43200 - 43200]) AS w FROM events) GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows, in their batch form."""
    return streams.sliding(_events(spark, sf_dir))


@query(
    """WITH f AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS first FROM events),
    s AS (SELECT user_id, us, sum(first) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT min(us) AS started_us, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows, in their batch form."""
    return streams.sessions(_events(spark, sf_dir))
