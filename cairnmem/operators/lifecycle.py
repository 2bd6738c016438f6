"""The lifecycle of memories and sessions: state in, state out."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.functions import scoring
from cairnmem.runtime import first_rows
from cairnmem.schema import MEMORY_DEFAULTS, with_defaults

SESSION_GAP = 30 * 60.0
ABANDONED = 24 * 3600.0


def record(new: DataFrame, now: float, strict: bool = False) -> DataFrame:
    """Rows to append for new memories: defaults, and an id from content and place.

    A row without text is refused: it is left out, or, if ``strict``, fails the batch.  ``seq`` orders the new rows.
    """
    if strict:
        new = new.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a memory has no text"))))
    df = with_defaults(new.where("text is not null"), MEMORY_DEFAULTS)
    rid = F.concat(F.lit("m-"), F.substring(F.sha2(F.concat_ws("\x1f", "namespace", "text", F.col("seq").cast("string")), 256), 1, 32))
    return df.withColumns(
        {
            "rid": rid, "created_at": F.lit(now), "last_access": F.lit(now), "access_count": F.lit(0).cast("long"),
            "consolidation_status": F.lit("active"), "storage_tier": F.lit("hot"),
        }
    )


def get(memories: DataFrame, rid: str) -> DataFrame:
    """One memory, tombstoned or not; no row if there is none."""
    return memories.where(F.col("rid") == rid)


def page(memories: DataFrame, limit: int, offset: int = 0, sort_by: str = "created_at", **filters: str) -> DataFrame:
    """A page of memories that pass the filters, the largest ``sort_by`` first, with the total and whether
    more follow (has_more)."""
    for column, value in filters.items():
        memories = memories.where(F.col(column) == value)
    total = memories.agg(F.count("*").alias("total"))
    rows = memories.orderBy(F.desc(sort_by), "rid").offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def admit(new: DataFrame, stored: DataFrame, quotas: DataFrame, most: int | None = 10_000) -> tuple[DataFrame, DataFrame]:
    """A batch of memories (namespace, seq, ...) as far as the quotas (namespace, max_memories) allow, and
    how many of each namespace were refused.  A batch of over ``most`` rows (None: any) is an error.

    Ranks run over the batch, not over what is stored.
    """
    if most is not None and new.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} memories")
    held = stored.groupBy("namespace").agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy("namespace").orderBy("seq"))
    room = F.col("max_memories") - F.coalesce("_held", F.lit(0))
    placed = new.withColumn("_place", place).join(quotas, "namespace", "left").join(held, "namespace", "left")
    placed = placed.withColumn("_fits", F.col("max_memories").isNull() | (F.col("_place") <= room))
    refused = placed.where("not _fits").groupBy("namespace").agg(F.count("*").alias("refused"))
    return placed.where("_fits").select(new.columns), refused


def forget(memories: DataFrame, rids: DataFrame) -> DataFrame:
    """memories with some tombstoned; a tombstone never goes."""
    gone = rids.select("rid").distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), "tombstoned").otherwise(F.col("consolidation_status"))
    return memories.join(gone, "rid", "left").withColumn("consolidation_status", status).drop("_gone")


def correct(memories: DataFrame, corrections: DataFrame, now: float) -> DataFrame:
    """memories after corrections (rid, text): the original is tombstoned, and a copy with the new
    text and an id of its own, with all else kept, takes its place.  Tombstones are not corrected."""
    new = corrections.select("rid", F.col("text").alias("_text"))
    live = memories.where("consolidation_status <> 'tombstoned'")
    copies = live.join(new, "rid").withColumns({"rid": F.concat("rid", F.lit("-corrected")), "text": F.col("_text"), "created_at": F.lit(now), "last_access": F.lit(now)}).drop("_text")
    return forget(memories, live.join(new, "rid", "left_semi")).unionByName(copies.select(memories.columns))


def move_links(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links (rid, entity) with those of some rids under new ones (rid, new_rid)."""
    return links.join(moves, "rid", "left").select(F.coalesce("new_rid", "rid").alias("rid"), "entity").distinct()


def set_tier(memories: DataFrame, rids: DataFrame, tier: str) -> DataFrame:
    """memories with some in another tier: archive to cold, hydrate to hot."""
    some = rids.select("rid").distinct().withColumn("_hit", F.lit(True))
    return memories.join(some, "rid", "left").withColumn("storage_tier", F.when(F.col("_hit"), tier).otherwise(F.col("storage_tier"))).drop("_hit")


def evict(memories: DataFrame, now: float, most: int) -> DataFrame:
    """The weakest hot active memories, as many as there are over ``most``: rid, current_score.

    By ranges of the score, so that no task ranks or holds all that go, however many they are.
    """
    left = scoring.decay(F.col("importance"), F.lit(now) - F.col("last_access"), F.col("half_life"))
    hot = memories.where("consolidation_status = 'active' and storage_tier = 'hot'").select("rid", left.alias("current_score"))
    over = max(0, hot.count() - most)
    return first_rows(hot, over, "current_score", "rid")


def stats(memories: DataFrame, by: str = "namespace") -> DataFrame:
    """Counts of memories by status, tier and type, for each namespace."""
    def n(condition: str, name: str):
        return F.count_if(F.expr(condition)).alias(name)

    return memories.groupBy(by).agg(
        n("consolidation_status = 'active'", "active_memories"), n("consolidation_status = 'consolidated'", "consolidated_memories"),
        n("consolidation_status = 'tombstoned'", "tombstoned_memories"), n("storage_tier = 'cold'", "archived_memories"),
        n("type = 'episodic'", "episodic"), n("type = 'semantic'", "semantic"), n("type = 'procedural'", "procedural"),
        n("embedding is not null", "vector_index_entries"), F.count("*").alias("total"),
    )


def engine_stats(
    memories: DataFrame, edges: DataFrame, operations: DataFrame, conflicts: DataFrame, triggers: DataFrame, patterns: DataFrame
) -> DataFrame:
    """One row about all state: the counters of a whole database."""
    def n(condition: str, name: str):
        return F.count_if(F.expr(condition)).alias(name)

    ends = edges.select(F.explode(F.array("src", "dst")).alias("e")).agg(F.countDistinct("e").alias("entities"))
    one = memories.agg(
        n("consolidation_status = 'active'", "active_memories"), n("consolidation_status = 'consolidated'", "consolidated_memories"),
        n("consolidation_status = 'tombstoned'", "tombstoned_memories"), n("storage_tier = 'cold'", "archived_memories"),
        n("consolidation_status <> 'tombstoned' and storage_tier <> 'cold'", "scoring_cache_entries"),
        n("embedding is not null and consolidation_status <> 'tombstoned'", "vec_index_entries"),
    )
    # One row each.
    parts = (
        edges.agg(F.count("*").alias("edges"), F.countDistinct("src", "dst", "rel_type").alias("graph_index_edges")),
        ends.withColumn("graph_index_entities", F.col("entities")), operations.agg(F.count("*").alias("operations")),
        conflicts.agg(n("status = 'open'", "open_conflicts"), n("status = 'resolved'", "resolved_conflicts")),
        triggers.agg(n("status = 'pending'", "pending_triggers")), patterns.agg(n("status = 'active'", "active_patterns")),
    )
    for part in parts:
        one = one.crossJoin(F.broadcast(part))
    return one


def procedural_stats(memories: DataFrame) -> DataFrame:
    """Of each domain: how many procedural memories, and their mean effectiveness."""
    own = memories.where("type = 'procedural' and consolidation_status = 'active'")
    return own.groupBy("domain").agg(F.count("*").alias("n"), F.avg("importance").alias("avg_effectiveness"))


def entity_profile(memories: DataFrame, entity: str, now: float, days: float = 90) -> DataFrame:
    """One row about an entity's memories of the last days.

    valence_trend: mean of the newer half of the window less that of the older; frequency: mentions a day;
    domain_counts: a map; dominant_emotion: the commonest emotional_state, the first of equals, if there is any.
    """
    begin, middle = now - days * 86400.0, now - days * 43200.0
    own = memories.where((F.col("entity") == entity) & (F.col("created_at") >= begin) & (F.col("consolidation_status") == "active"))
    newer = F.col("created_at") >= middle
    one = own.agg(
        F.count("*").alias("mention_count"), F.countDistinct("session_id").alias("session_count"), F.avg("valence").alias("avg_valence"),
        (F.coalesce(F.avg(F.when(newer, F.col("valence"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~newer, F.col("valence"))), F.lit(0.0))).alias("valence_trend"),
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
    domains = own.groupBy("domain").agg(F.count("*").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "domain"))).alias("d"), F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("domain_counts")
    )
    felt = own if "emotional_state" in own.columns else own.withColumn("emotional_state", F.lit(None).cast("string"))
    felt = felt.groupBy("emotional_state").agg(F.count("*").alias("n")).where("emotional_state is not null")
    felt = felt.agg(F.min_by("emotional_state", F.struct(-F.col("n"), "emotional_state")).alias("dominant_emotion"))
    text = F.array_join(F.transform("d", lambda s: F.concat(s["domain"], F.lit(":"), (-s["m"]).cast("string"))), ",")
    return one.crossJoin(F.broadcast(domains.select(text.alias("domains"), "domain_counts"))).crossJoin(F.broadcast(felt)).withColumns(
        {"entity": F.lit(entity), "window_days": F.lit(float(days)), "interaction_frequency": F.col("mention_count") / days}
    )


def relationship_depth(memories: DataFrame, connections: DataFrame) -> DataFrame:
    """Of each entity: sessions, mentions, domains, connections (entity, other, rel_type) and their types, and a
    depth in [0, 1).

    depth_score: 1 - exp(-(mentions / 20 + sessions / 10 + domains / 5 + connections / 10) / 4).
    """
    own = memories.where("consolidation_status = 'active'").groupBy("entity").agg(
        F.countDistinct("session_id").alias("sessions_together"), F.count("*").alias("memories_mentioning"),
        F.avg("valence").alias("avg_valence"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains_spanning"),
        F.countDistinct("domain").alias("n_domains"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )
    degree = connections.groupBy("entity").agg(
        F.countDistinct("other").alias("connection_count"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("relationship_types")
    )
    out = own.join(degree, "entity", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0)))
    depth = F.col("memories_mentioning") / 20 + F.col("sessions_together") / 10 + F.col("n_domains") / 5 + F.col("connection_count") / 10
    return out.withColumn("depth_score", 1 - F.exp(-depth / 4)).drop("n_domains")


def sessions_by_gap(events: DataFrame, by: str = "user_id", at: str = "at", gap: float = SESSION_GAP) -> DataFrame:
    """Sessions of each user: a new one begins after more than ``gap`` seconds without an event."""
    w = Window.partitionBy(by).orderBy(at)
    first = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_first", first).withColumn("session", F.sum("_first").over(upto))
    return marked.groupBy(by, "session").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("n_events"))


def session_summary(memories: DataFrame) -> DataFrame:
    """Of each session: when, how many memories, their mean valence and topics."""
    return memories.groupBy("session_id").agg(
        F.min("created_at").alias("started_at"), (F.max("created_at") - F.min("created_at")).alias("duration"), F.count("*").alias("memory_count"),
        F.avg("valence").alias("avg_valence"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("topics"),
    )


def newest_sessions(sessions: DataFrame, most: int, by: str = "user_id") -> DataFrame:
    """The newest sessions of each user."""
    w = Window.partitionBy(by).orderBy(F.desc("started_at"), F.desc("session"))
    return sessions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def abandon(sessions: DataFrame, now: float, after: float = ABANDONED) -> DataFrame:
    """Sessions with a status: those without an event for a day are abandoned."""
    return sessions.withColumn("status", F.when(F.lit(now) - F.col("ended_at") > after, "abandoned").otherwise("active"))


def start_sessions(sessions: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """sessions (session_id, user_id, status, started_at, ended_at) with new ones (session_id, user_id); a user has
    one active session, so an older one ends."""
    begun = new.select("session_id", "user_id", F.lit("active").alias("status"), F.lit(now).alias("started_at"), F.lit(None).cast("double").alias("ended_at"))
    ending = sessions.where("status = 'active'").join(new.select("user_id").distinct(), "user_id", "left_semi").select("session_id")
    return end_sessions(sessions, ending, now).unionByName(begun.join(sessions.select("session_id"), "session_id", "left_anti").select(sessions.columns))


def end_sessions(sessions: DataFrame, ending: DataFrame, now: float) -> DataFrame:
    """sessions with some active ones (session_id) ended; a session that is not active does not change."""
    hit = ending.select("session_id").distinct().withColumn("_hit", F.lit(True))
    ends = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "active")
    return sessions.join(hit, "session_id", "left").withColumns(
        {"ended_at": F.when(ends, F.lit(now)).otherwise(F.col("ended_at")), "status": F.when(ends, "ended").otherwise(F.col("status"))}
    ).select(sessions.columns)


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where("status = 'active'")


def within_budget(rows: DataFrame, by: str, order: list, size, budget: int) -> DataFrame:
    """The first rows of each group whose sizes add up to a budget at most; the first that does not fit
    ends the group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def latency_histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], by: str) -> DataFrame:
    """Cumulative counts of values up to each bound, with sum and count, for each group."""
    counts = [F.count_if(F.col(value) <= b) for b in bounds]
    one = rows.groupBy(by).agg(F.array(*counts).alias("_c"), F.sum(value).alias("sum"), F.count("*").alias("count"))
    bound = F.array(*[F.lit(float(b)) for b in bounds])
    return one.select(by, "sum", "count", F.explode(F.arrays_zip(bound.alias("le"), F.col("_c").alias("n"))).alias("b")).select(by, "b.le", "b.n", "sum", "count")


def upsert_members(members: DataFrame, learned: DataFrame) -> DataFrame:
    """Members of substitution categories (category, token, confidence, source) with learned tokens:
    tokens are compared trimmed and in lower case, the higher confidence stays, then the learned."""
    def side(df: DataFrame, order: int) -> DataFrame:
        return df.select("category", F.lower(F.trim("token")).alias("token_normalized"), F.trim("token").alias("token_display"), "confidence", "source", F.lit(order).alias("_o"))

    both = side(members, 0).unionByName(side(learned, 1))
    best = F.max(F.struct("confidence", "_o", "token_display", "source")).alias("m")
    return both.groupBy("category", "token_normalized").agg(best).select("category", "token_normalized", "m.token_display", "m.confidence", "m.source")


def reset_members(members: DataFrame) -> DataFrame:
    """Members without what was learned."""
    return members.where("source = 'seed'")
