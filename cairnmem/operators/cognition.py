"""Cognition: decay, triggers, clusters, consolidation, patterns, personality, learning.

Every function takes the state it needs and the time as ``now``, and returns rows; nothing is changed
in place.  Where no formula is prescribed, the docstring states the one used here.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnmem.functions import scoring, vectors
from cairnmem.runtime import cut
from cairnmem.schema import DAY

TRIGGER_COLUMNS = ("trigger_type", "reason", "urgency", "source_rids", "suggested_action")
EXPIRY = 48 * 3600.0


def active(memories: DataFrame) -> DataFrame:
    return memories.where("consolidation_status = 'active'")


def decayed(memories: DataFrame, now: float) -> DataFrame:
    """Active memories with the strength that is left since their last access."""
    left = scoring.decay(F.col("importance"), F.lit(now) - F.col("last_access"), F.col("half_life"))
    return active(memories).withColumn("current_score", left).withColumn("days_since_access", (F.lit(now) - F.col("last_access")) / DAY)


def faded(memories: DataFrame, now: float, threshold: float = 0.01) -> DataFrame:
    """Memories whose strength is under a threshold."""
    return decayed(memories, now).where(F.col("current_score") < threshold).select(
        "rid", F.col("importance").alias("original_importance"), "current_score", "days_since_access"
    )


def decay_triggers(memories: DataFrame, now: float, importance: float = 0.5, threshold: float = 0.1, limit: int = 5) -> DataFrame:
    """The most urgent important memories that fade: urgency = importance * (1 - share left)."""
    fading = decayed(memories, now).where((F.col("importance") >= importance) & (F.col("current_score") < threshold))
    urgency = F.col("importance") * (1 - F.col("current_score") / F.col("importance"))
    return (
        fading.select(
            F.lit("decay_review").alias("trigger_type"), F.lit("important memory is fading").alias("reason"), urgency.alias("urgency"),
            F.array("rid").alias("source_rids"), F.lit("ask_user_to_confirm_or_forget").alias("suggested_action"), "rid",
        )
        .orderBy(F.desc("urgency"), "rid").limit(limit).drop("rid")
    )


def consolidation_triggers(memories: DataFrame, least: int = 10) -> DataFrame:
    """One trigger where enough episodic memories are active; urgency grows with their number, to 1."""
    counted = active(memories).where("type = 'episodic'").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.select(
        F.lit("consolidation_ready").alias("trigger_type"), F.concat(F.col("n").cast("string"), F.lit(" episodic memories")).alias("reason"),
        F.least(F.lit(1.0), F.col("n") / (10.0 * least)).alias("urgency"), F.array().cast("array<string>").alias("source_rids"),
        F.lit("run_consolidation").alias("suggested_action"),
    )


def reminders(memories: DataFrame, now: float, within: float = 3600.0) -> DataFrame:
    """Triggers for memories whose metadata holds a ``remind_at`` that comes soon: the sooner, the more
    urgent, 0.6 at least."""
    at = F.get_json_object("metadata", "$.remind_at").cast("double")
    left = at - now
    return active(memories).withColumn("_left", left).where((F.col("_left") >= 0) & (F.col("_left") < within)).select(
        F.lit("reminder_due").alias("trigger_type"), F.lit("reminder is due").alias("reason"),
        F.greatest(F.lit(0.6), 1 - F.col("_left") / within).alias("urgency"), F.array("rid").alias("source_rids"),
        F.lit("remind_user").alias("suggested_action"),
    )


def all_triggers(memories: DataFrame, now: float, **limits) -> DataFrame:
    return decay_triggers(memories, now, **limits).unionByName(consolidation_triggers(memories)).unionByName(reminders(memories, now))


# Which states a trigger can go to from each.
TRANSITIONS = {"pending": ("delivered", "dismissed", "expired"), "delivered": ("acknowledged", "acted", "dismissed", "expired"), "acknowledged": ("acted", "dismissed", "expired")}


def step_triggers(triggers: DataFrame, events: DataFrame, now: float) -> DataFrame:
    """Triggers (trigger_id, status, created_at) after one event each (trigger_id, to); an event that
    the state does not allow does nothing.  Open triggers that are 48 hours old expire."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.coalesce(F.array_contains(table[F.col("status")], F.col("to")), F.lit(False))
    stepped = triggers.join(events, "trigger_id", "left").withColumn("accepted", allowed)
    stepped = stepped.withColumn("status", F.when(F.col("accepted"), F.col("to")).otherwise(F.col("status")))
    late = F.col("status").isin(*TRANSITIONS) & (F.lit(now) - F.col("created_at") >= EXPIRY)
    return stepped.withColumn("status", F.when(late, "expired").otherwise(F.col("status"))).drop("to")


def conflict_triggers(conflicts: DataFrame, now: float, patience: float = 7 * DAY) -> DataFrame:
    """Open conflicts (conflict_id, priority, status, detected_at) above low priority: the longer open, the more
    urgent.  urgency: 0.5, for high priority 0.7, and up to 0.3 more with the age over ``patience``."""
    base = F.when(F.col("priority") == "high", 0.7).otherwise(0.5)
    age = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(now) - F.col("detected_at")) / patience)
    return conflicts.where("status = 'open' and priority in ('high', 'medium')").select(
        F.lit("conflict_escalation").alias("trigger_type"), F.concat(F.col("priority"), F.lit(" conflict is open")).alias("reason"),
        (base + 0.3 * age).alias("urgency"), F.array(F.col("conflict_id").cast("string")).alias("source_rids"), F.lit("resolve_conflict").alias("suggested_action"),
    )


def pattern_triggers(patterns: DataFrame, least: int = 3) -> DataFrame:
    """Active patterns (pattern_key, confidence, occurrence_count, status) found at least so often; as urgent as
    they are certain."""
    return patterns.where((F.col("status") == "active") & (F.col("occurrence_count") >= least)).select(
        F.lit("pattern_discovered").alias("trigger_type"), F.lit("a pattern recurs").alias("reason"), F.col("confidence").cast("double").alias("urgency"),
        F.array("pattern_key").alias("source_rids"), F.lit("mention_pattern").alias("suggested_action"),
    )


def valence_triggers(trends: DataFrame, by: str = "namespace", least: float = 0.1) -> DataFrame:
    """Moods that have moved by at least so much; as urgent as they moved, 1 at most."""
    return trends.where(F.abs("delta") >= least).select(
        F.lit("valence_trend").alias("trigger_type"), F.concat(F.lit("mood turned "), "direction").alias("reason"),
        F.least(F.lit(1.0), F.abs("delta")).alias("urgency"), F.array(F.col(by).cast("string")).alias("source_rids"), F.lit("check_in").alias("suggested_action"),
    )


def goal_triggers(goals: DataFrame, memories: DataFrame, now: float, days: float = 14) -> DataFrame:
    """Goals (rid, entity, importance): progress where an active memory of the entity is from the last days, else
    stagnation; as urgent as the goal is important, half of that for progress."""
    fresh = active(memories).where(F.col("created_at") >= now - days * DAY).groupBy("entity").agg(F.count("*").alias("_n"))
    moving = F.col("_n").isNotNull()
    return goals.join(fresh, "entity", "left").select(
        F.when(moving, "goal_progress").otherwise("goal_stagnation").alias("trigger_type"),
        F.when(moving, "a goal moves").otherwise("a goal stands still").alias("reason"),
        F.when(moving, F.col("importance") / 2).otherwise(F.col("importance")).alias("urgency"), F.array("rid").alias("source_rids"),
        F.when(moving, "report_progress").otherwise("ask_about_goal").alias("suggested_action"),
    )


def cluster_links(memories: DataFrame, threshold: float = 0.6, window: float = 7 * DAY, links: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of active memories that are similar and near in time; with ``links`` (rid, entity), of
    those that have an entity in common."""
    some = active(memories).where("embedding is not null")
    pairs = vectors.similar_pairs(some, "rid", "embedding", threshold, within=("created_at", window))
    if links is not None:
        # An entity of both: each pair looks for the entities of its first end among those of the second.
        first, second = (links.select(F.col("rid").alias(f"id_{s}"), "entity").distinct() for s in "ab")
        shared = pairs.select("id_a", "id_b").join(first, "id_a").join(second, ["id_b", "entity"]).select("id_a", "id_b").distinct()
        pairs = pairs.join(shared, ["id_a", "id_b"], "left_semi")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity")


def connected(links: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, root) of the ends of links (a, b): the smallest id that is reachable.

    Labels go along links and then to their label's label, so a chain of n needs about log2(n) rounds;
    each round's labels are checkpointed.  Labels that still change after ``rounds`` are an error.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    both = cut(both)
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "id")
    labels = cut(labels)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.id == near.x).select("id", F.least("root", "near").alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut(step.join(jump, "root", "left").select("id", F.coalesce(F.least("root", "far"), "root").alias("root")))
        changed = step.join(labels.withColumnRenamed("root", "old"), "id").where("root <> old").limit(1).count()
        labels = step
        if not changed:
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds: raise the number of rounds")


def clusters(
    memories: DataFrame, threshold: float = 0.6, window: float = 7 * DAY, least: int = 2, most: int = 10, links: DataFrame | None = None
) -> DataFrame:
    """(cluster, rid, place): connected similar memories; of a large cluster the ``most`` important stay.

    With ``links`` (rid, entity) only memories with an entity in common are connected.
    """
    found = connected(cluster_links(memories, threshold, window, links))
    named = found.join(memories.select("rid", "importance"), found.id == F.col("rid")).select(F.col("root").alias("cluster"), "rid", "importance")
    w = Window.partitionBy("cluster")
    ranked = named.withColumn("place", F.row_number().over(w.orderBy(F.desc("importance"), "rid"))).withColumn("n", F.count("*").over(w))
    return ranked.where((F.col("n") >= least) & (F.col("place") <= most)).select("cluster", "rid", "place")


def summaries(clusters_: DataFrame, memories: DataFrame, separator: str = " | ") -> DataFrame:
    """Extractive summary of each cluster: all texts, the most important first."""
    m = clusters_.join(memories.select("rid", "text", "importance"), "rid")
    lead = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("i"), "rid", "text")))
    return m.groupBy("cluster").agg(F.array_join(F.transform(lead, lambda s: s["text"]), separator).alias("summary"))


def consolidate(clusters_: DataFrame, memories: DataFrame) -> DataFrame:
    """The new semantic memory of each cluster: summary, importance a tenth over the largest (1 at
    most), mean valence and half-life, and its sources."""
    m = clusters_.join(memories, "rid")
    new = m.groupBy("cluster").agg(
        F.least(F.lit(1.0), F.max("importance") * 1.1).alias("importance"), F.avg("valence").alias("valence"),
        F.max("half_life").alias("half_life"), F.array_sort(F.collect_list("rid")).alias("consolidated_from"),
    )
    return new.join(summaries(clusters_, memories), "cluster").withColumn("type", F.lit("semantic")).withColumn("consolidation_status", F.lit("active"))


def after_consolidation(clusters_: DataFrame, memories: DataFrame) -> DataFrame:
    """memories with the sources consolidated, at three tenths of their importance."""
    gone = clusters_.select("rid", F.concat(F.lit("c-"), "cluster").alias("_into"))
    hit = F.col("_into").isNotNull()
    return memories.join(gone, "rid", "left").withColumns(
        {
            "consolidation_status": F.when(hit, "consolidated").otherwise(F.col("consolidation_status")),
            "importance": F.when(hit, F.col("importance") * 0.3).otherwise(F.col("importance")),
            "consolidated_into": F.col("_into"),
        }
    ).drop("_into")


def transfer_links(clusters_: DataFrame, links: DataFrame) -> DataFrame:
    """Links (rid, entity) after consolidation: those of the sources, once each, under their new memory, ``c-``
    and the cluster's name; the others as they are."""
    into = clusters_.select("rid", F.concat(F.lit("c-"), "cluster").alias("_into"))
    return links.join(into, "rid", "left").select(F.coalesce("_into", "rid").alias("rid"), "entity").distinct()


def topic_clusters(rows: DataFrame, *by: Column | str, least: int = 5) -> DataFrame:
    """Groups of rows of a topic, of at least so many."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cooccurrence(links: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n) of entities that are named together by at least so many memories (rid, entity).

    Each memory sends its sorted entities once and expands them itself, without a self-join.
    """
    sets = links.groupBy("rid").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = sets.select(F.explode(F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.greatest(F.size("e"), F.lit(1))), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def temporal_clusters(memories: DataFrame, least: int = 5, share: float = 0.0) -> DataFrame:
    """Memories by domain, weekday (1 Sunday) and hour, where they cluster."""
    at = F.timestamp_seconds(F.col("created_at"))
    counted = active(memories).groupBy("domain", F.dayofweek(at).alias("dow"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))
    if share:
        total = active(memories).groupBy("domain").agg(F.count("*").alias("total"))
        counted = counted.join(total, "domain").where(F.col("n") >= share * F.col("total")).drop("total")
    return counted.where(F.col("n") >= least)


def valence_trends(memories: DataFrame, now: float, recent: float = 7 * DAY, by: str = "namespace", least: float = 0.0) -> DataFrame:
    """Mean valence of the last days against before, and the direction."""
    new = F.col("created_at") >= now - recent
    out = active(memories).groupBy(by).agg(
        F.avg(F.when(new, F.col("valence"))).alias("recent_avg"), F.avg(F.when(~new, F.col("valence"))).alias("baseline_avg")
    )
    out = out.withColumn("delta", F.col("recent_avg") - F.col("baseline_avg"))
    direction = F.when(F.col("delta") < 0, "negative").when(F.col("delta") > 0, "positive").otherwise("stable")
    return out.where(F.abs(F.col("delta")) >= least).withColumn("direction", direction)


def upsert_patterns(old: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Patterns (pattern_key, ...) after mining: those found again are confirmed and counted, new ones
    begin, and those not found go stale."""
    n = new.select("pattern_key", F.col("confidence").alias("_confidence"))
    j = old.join(n, "pattern_key", "full")
    found, known = F.col("_confidence").isNotNull(), F.col("occurrence_count").isNotNull()
    return j.select(
        "pattern_key",
        F.coalesce("_confidence", "confidence").alias("confidence"),
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(found, F.lit(now)).otherwise(F.col("last_confirmed")).alias("last_confirmed"),
        (F.coalesce("occurrence_count", F.lit(0)) + found.cast("int")).cast("long").alias("occurrence_count"),
        F.when(found, "active").otherwise("stale").alias("status"),
        F.when(found & known, "updated").when(found, "new").otherwise("kept").alias("change"),
    )


def personality(memories: DataFrame, by: str = "namespace") -> DataFrame:
    """Four traits of each namespace, in [0, 1], with a confidence and the sample they rest on.

    warmth: half of one more than the mean valence; energy: mean size of valence; depth: share of
    semantic and procedural memories; attentiveness: mean importance.  Confidence: n / (n + 20).
    """
    deep = F.col("type").isin("semantic", "procedural").cast("double")
    one = active(memories).groupBy(by).agg(
        ((1 + F.avg("valence")) / 2).alias("warmth"), F.avg(F.abs("valence")).alias("energy"), F.avg(deep).alias("depth"),
        F.avg("importance").alias("attentiveness"), F.count("*").alias("sample_count"),
    )
    traits = F.explode(F.array(*[F.struct(F.lit(t).alias("trait_name"), F.col(t).alias("score")) for t in ("warmth", "energy", "depth", "attentiveness")]))
    confidence = (F.col("sample_count") / (F.col("sample_count") + 20.0)).alias("confidence")
    return one.select(by, traits.alias("t"), confidence, "sample_count").select(by, "t.trait_name", "t.score", "confidence", "sample_count")


def set_traits(traits: DataFrame, wanted: DataFrame, by: str = "namespace") -> DataFrame:
    """traits with some set by hand (by, trait_name, score): held to [0, 1], and certain."""
    own = wanted.select(by, "trait_name", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("_score"))
    j = traits.join(own, [by, "trait_name"], "left")
    return j.select(
        by, "trait_name", F.coalesce("_score", "score").alias("score"), F.when(F.col("_score").isNull(), F.col("confidence")).otherwise(1.0).alias("confidence"), "sample_count"
    )


def tone(traits: DataFrame, by: str = "namespace") -> DataFrame:
    """How each trait shows: high over 0.6, low under 0.4, else even."""
    level = F.when(F.col("score") > 0.6, "high").when(F.col("score") < 0.4, "low").otherwise("even")
    return traits.select(by, "trait_name", level.alias("level"))


def stale(memories: DataFrame, now: float, days: float = 30, importance: float = 0.5, limit: int = 10) -> DataFrame:
    """Important memories that nobody has touched for so many days, the longest first."""
    old = active(memories).where((F.col("importance") >= importance) & (F.col("last_access") <= now - days * DAY))
    return old.select("rid", "importance", "last_access").orderBy("last_access", "rid").limit(limit)


def upcoming(memories: DataFrame, now: float, days: float = 7, deadline: str = "$.remind_at", limit: int = 10) -> DataFrame:
    """Memories with a deadline in the next days, the nearest first."""
    at = F.get_json_object("metadata", deadline).cast("double")
    soon = active(memories).withColumn("deadline", at).where(F.col("deadline").between(now, now + days * DAY))
    return soon.select("rid", "deadline").orderBy("deadline", "rid").limit(limit)


# The range and the step of learned weights.
WEIGHT_RANGE, ETA = (0.05, 0.90), 0.01


def learn_weights(
    feedback: DataFrame, weights: dict[str, float], eta: float = ETA, least_events: int = 20, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, signal, weight) after a generation of feedback (relevant, and a contribution of each signal).

    Each event moves each weight by eta times the signal's share of the contributions, up if relevant;
    the sum is applied at once, clamped, and made to sum to 1.  Under ``least_events`` nothing changes.  With
    ``by`` each user, say, has weights of their own, learned from their own events.
    """
    total = sum((F.col(s) for s in weights), F.lit(0.0))
    sign = F.when(F.col("relevant"), 1.0).otherwise(-1.0)
    sums = [F.coalesce(F.sum(F.when(total > 0, sign * F.col(s) / total).otherwise(0.0)), F.lit(0.0)).alias(s) for s in weights]
    one = feedback.groupBy(*by).agg(*sums, F.count("*").alias("_n"))
    moved = {s: F.greatest(F.lit(WEIGHT_RANGE[0]), F.least(F.lit(WEIGHT_RANGE[1]), F.lit(w) + eta * F.col(s))) for s, w in weights.items()}
    moved = {s: F.when(F.col("_n") >= least_events, c).otherwise(F.lit(weights[s])) for s, c in moved.items()}
    all_ = sum(moved.values(), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), (c / all_).alias("weight")) for s, c in moved.items()])
    return one.select(*by, F.explode(rows).alias("w")).select(*by, "w.*")


def reinforce_procedural(memories: DataFrame, outcomes: DataFrame, rate: float = 0.2) -> DataFrame:
    """(rid, effectiveness) after outcomes (rid, outcome) in [0, 1]: moved by ``rate`` towards their mean."""
    mean = outcomes.groupBy("rid").agg(F.avg("outcome").alias("_o"))
    kept = memories.where("type = 'procedural'").join(mean, "rid", "left")
    return kept.select("rid", F.coalesce(F.col("importance") * (1 - rate) + F.col("_o") * rate, "importance").alias("effectiveness"))


def instincts(state: DataFrame, triggers: DataFrame) -> DataFrame:
    """Urges of each user's state (user_id, hours_idle, open_conflicts, recent_avg, baseline_avg) and
    pending triggers (user_id, trigger_id, trigger_type, urgency): (user_id, instinct, urgency, cooldown_key).

    Absence from 8 hours on, up to 0.8; 5 open conflicts or more, up to 0.8; a mood that has fallen,
    up to 0.9; the first two decay triggers, up to 0.7; the first two patterns; reminders from 0.6.
    """
    delta = F.col("recent_avg") - F.col("baseline_avg")
    def urge(when: Column, name: str, urgency: Column, key: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("instinct"), urgency.cast("double").alias("urgency"), F.lit(key).alias("cooldown_key")))

    own = F.array(
        urge(F.col("hours_idle") >= 8, "check_in", F.least(F.lit(0.8), (F.col("hours_idle") - 8) / 16), "check_in"),
        urge(F.col("open_conflicts") >= 5, "conflict_alerting", F.least(F.lit(0.8), F.col("open_conflicts") / 10), "conflict_alerting"),
        urge(delta < 0, "emotional_awareness", F.least(F.lit(0.9), F.abs(delta)), "emotional_awareness:negative"),
    )
    from_state = state.select("user_id", F.explode(own).alias("u")).where("u is not null").select("user_id", "u.*")
    kinds = {"decay_review": ("follow_up", F.least(F.lit(0.7), F.col("urgency"))), "pattern_discovered": ("pattern_surfacing", F.col("urgency")), "reminder_due": ("reminder", F.greatest(F.lit(0.6), F.col("urgency")))}
    w = Window.partitionBy("user_id", "trigger_type").orderBy("trigger_id")
    first = triggers.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= 2) | (F.col("trigger_type") == "reminder_due"))
    for kind, (name, urgency) in kinds.items():
        part = first.where(F.col("trigger_type") == kind)
        from_state = from_state.unionByName(part.select("user_id", F.lit(name).alias("instinct"), urgency.alias("urgency"), F.concat(F.lit(f"{name}:"), "trigger_id").alias("cooldown_key")))
    return from_state


def queue_urges(urges: DataFrame, most: int = 20) -> DataFrame:
    """Pending urges of each user: those of one cooldown key are one, boosted by a tenth for each
    repeat (1 at most); of more than ``most`` the least urgent go."""
    merged = urges.groupBy("user_id", "cooldown_key").agg(F.max("urgency").alias("urgency"), (F.count("*") - 1).alias("boost_count"))
    merged = merged.withColumn("urgency", F.least(F.lit(1.0), F.col("urgency") + 0.1 * F.col("boost_count")))
    w = Window.partitionBy("user_id").orderBy(F.desc("urgency"), "cooldown_key")
    return merged.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def expire_urges(queue: DataFrame, now: float, after: float = EXPIRY) -> DataFrame:
    """Urges (user_id, cooldown_key, urgency, created_at) that have not waited too long."""
    return queue.where(F.lit(now) - F.col("created_at") < after)


def suppress_urges(queue: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Urges without those of some keys (user_id, cooldown_key)."""
    return queue.join(unwanted.select("user_id", "cooldown_key").distinct(), ["user_id", "cooldown_key"], "left_anti")


def pop_urges(queue: DataFrame, threshold: float = 0.7, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The most urgent urges of each user, from a threshold on, and the queue without them."""
    w = Window.partitionBy("user_id").orderBy(F.desc("urgency"), "cooldown_key")
    placed = queue.withColumn("_place", F.row_number().over(w))
    due = (F.col("urgency") >= threshold) & (F.col("_place") <= most)
    return placed.where(due).drop("_place"), placed.where(~due).drop("_place")


@dataclass(frozen=True)
class ThinkConfig:
    """What a round of thinking does."""

    importance_threshold: float = 0.5
    decay_threshold: float = 0.1
    max_triggers: int = 5
    run_consolidation: bool = True
    run_conflict_scan: bool = True
    run_pattern_mining: bool = True
    run_personality: bool = True
    min_active_memories: int = 10
    consolidation_limit: int = 100
    consolidation_time_window_days: float = 7
    consolidation_sim_threshold: float = 0.6


def think(memories: DataFrame, edges: DataFrame, now: float, config: ThinkConfig = ThinkConfig()) -> tuple[dict[str, DataFrame], DataFrame]:
    """A round of thinking: the new rows of each phase, and a report (phase, n_rows).

    Phases: triggers, consolidation, conflicts, patterns, personality; each one plan over the same state.
    """
    from cairnmem.operators import claims, graph

    out = {"triggers": all_triggers(memories, now, importance=config.importance_threshold, threshold=config.decay_threshold, limit=config.max_triggers)}
    if config.run_consolidation:
        best = active(memories).where("type = 'episodic'").orderBy(F.desc("importance"), "rid").limit(config.consolidation_limit)
        found = clusters(best, config.consolidation_sim_threshold, config.consolidation_time_window_days * DAY)
        out["consolidation"] = consolidate(found, memories)
    if config.run_conflict_scan:
        out["conflicts"] = claims.value_conflicts(edges)
    if config.run_pattern_mining:
        out["patterns"] = graph.hubs(edges)
    if config.run_personality:
        out["personality"] = personality(memories)
    report = None
    for phase, rows in out.items():
        one = rows.agg(F.count("*").alias("n_rows")).select(F.lit(phase).alias("phase"), "n_rows")
        report = one if report is None else report.unionByName(one)
    return out, report
