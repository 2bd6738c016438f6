"""Claims: contradictions, points in time, winners, scoped conflicts, status.

A claim is an edge with polarity, modality, validity and a source.  Joins on a claim's key are equi
joins with a residual condition, so the sort-merge plan (and its split of skewed keys) applies.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmem.schema import CLAIM_DEFAULTS, CONFIDENCE_RANK, MODALITIES, with_defaults

KEY = ("namespace", "src", "rel_type", "dst")
#: Seconds between the ends of two accounts that make them contradict.
END_GAP = 900.0


def rank_of(band: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(band == name, rank).otherwise(out)
    return out


def _side(df: DataFrame, side: str, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in columns))


def ingest(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with defaults, and those refused, with the reason.

    Ends must not be empty, the relation must be a lower-case name, modality and polarity known, and
    validity must not end before it begins.
    """
    df = with_defaults(new, CLAIM_DEFAULTS)
    reason = (
        F.when(F.coalesce(F.trim("src"), F.lit("")) == "", "src is empty")
        .when(F.coalesce(F.trim("dst"), F.lit("")) == "", "dst is empty")
        .when(~F.coalesce(F.col("rel_type").rlike("^[a-z_][a-z0-9_]*$"), F.lit(False)), "rel_type is not a name")
        .when(~F.col("polarity").isin(1, 0, -1), "polarity is unknown")
        .when(~F.col("modality").isin(*MODALITIES), "modality is unknown")
        .when(F.col("valid_from") > F.col("valid_to"), "valid_from is after valid_to")
    )
    df = df.withColumn("reason", reason)
    return df.where("reason is null").drop("reason"), df.where("reason is not null")


def latest(claims: DataFrame, order: str = "claim_id") -> DataFrame:
    """One claim of each (src, dst, rel_type, extractor, polarity, namespace): the latest."""
    keys = ("src", "dst", "rel_type", "extractor", "polarity", "namespace")
    # As a maximum, which combines before the shuffle.
    return claims.groupBy(*keys).agg(F.max_by(F.struct(*claims.columns), order).alias("_c")).select("_c.*")


def of_entity(claims: DataFrame, entity: str, namespace: str | None = None) -> DataFrame:
    """Claims whose source or object an entity is."""
    out = claims.where((F.col("src") == entity) | (F.col("dst") == entity))
    return out if namespace is None else out.where(F.col("namespace") == namespace)


def ledger(claims: DataFrame) -> DataFrame:
    """Of each (namespace, src, rel_type, dst): how many claims of each polarity, and by whom."""
    return claims.groupBy(*KEY).agg(
        F.count("*").alias("n_claims"),
        F.count_if(F.col("polarity") == 1).alias("n_positive"),
        F.count_if(F.col("polarity") == -1).alias("n_negative"),
        F.array_sort(F.collect_set("extractor")).alias("extractors"),
    )


def polarity_contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of one positive and one negative claim on the same relation."""
    columns = ("claim_id", "extractor", "confidence_band", "valid_from", "valid_to")
    yes = _side(claims.where("polarity = 1"), "pos", KEY, columns)
    return yes.join(_side(claims.where("polarity = -1"), "neg", KEY, columns), list(KEY))


def temporal_contradictions(claims: DataFrame, gap: float = END_GAP) -> DataFrame:
    """Pairs of positive claims on one relation whose windows meet but end over ``gap`` seconds apart.

    Claims with an open end take no part; windows that touch meet.
    """
    bounded = claims.where("polarity = 1 and valid_from is not null and valid_to is not null")
    columns = ("claim_id", "extractor", "valid_from", "valid_to")
    a, b = _side(bounded, "a", KEY, columns), _side(bounded, "b", KEY, columns)
    meet = (F.col("valid_to_a") >= F.col("valid_from_b")) & (F.col("valid_to_b") >= F.col("valid_from_a"))
    apart = F.abs(F.col("valid_to_a") - F.col("valid_to_b"))
    return a.join(b, list(KEY)).where((F.col("claim_id_a") < F.col("claim_id_b")) & meet & (apart > gap)).withColumn("gap_minutes", apart / 60)


def presence_denials(claims: DataFrame, system_prefix: str = "system.") -> DataFrame:
    """Negative claims that a system's positive claim on the same relation contradicts."""
    denied = _side(claims.where("polarity = -1"), "denial", KEY, ("claim_id", "extractor"))
    logged = claims.where((F.col("polarity") == 1) & F.col("extractor").startswith(system_prefix))
    return denied.join(_side(logged, "system", KEY, ("claim_id", "extractor", "valid_from", "valid_to")), list(KEY))


def valid_at(t: Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether a window, open to the right, holds a time; one without a begin holds none."""
    return F.coalesce((valid_from <= t) & (valid_to.isNull() | (t < valid_to)), F.lit(False))


def as_of(claims: DataFrame, t: float) -> DataFrame:
    """Claims that were valid at a time."""
    return claims.where(valid_at(F.lit(t), F.col("valid_from"), F.col("valid_to")))


def known_by(claims: DataFrame, t: float) -> DataFrame:
    """Claims that had begun by a time, whether or not they have ended."""
    return claims.where(F.col("valid_from") <= t)


def as_of_each(times: DataFrame, claims: DataFrame, keys: tuple[str, ...] = ("src", "rel_type"), bucket: float = 30 * 86400.0) -> DataFrame:
    """Of each (keys, t) in ``times``: the valid claim that began last (then the largest claim_id).

    A range join: windows are cut into buckets of time, so rows meet on keys and bucket.  A window
    without an end is cut at the last time asked for.
    """
    asked = times.withColumn("_b", F.floor(F.col("t") / bucket))
    last = F.broadcast(times.agg(F.max("t").alias("_last")))
    begun = claims.where("valid_from is not null").crossJoin(last).where("valid_from <= _last")
    end = F.least(F.coalesce("valid_to", "_last"), F.col("_last"))
    spread = begun.withColumn("_b", F.explode(F.sequence(F.floor(F.col("valid_from") / bucket), F.floor(F.greatest(end, "valid_from") / bucket)))).drop("_last")
    met = asked.join(spread, [*keys, "_b"]).where(valid_at(F.col("t"), F.col("valid_from"), F.col("valid_to")))
    best = F.max(F.struct("valid_from", "claim_id", "dst", "polarity", "extractor")).alias("c")
    return met.groupBy(*keys, "t").agg(best).select(*keys, "t", "c.claim_id", "c.dst", "c.polarity", "c.extractor")


def reconcile(claims: DataFrame, t: float) -> DataFrame:
    """The winner of each relation with claims of both polarities: valid at t, then the higher
    confidence, then the positive, then the smallest claim_id.  None valid: no winner."""
    both = claims.where("polarity <> 0").groupBy(*KEY).agg(F.min("polarity").alias("lo"), F.max("polarity").alias("hi")).where("lo < hi")
    standing = as_of(claims.where("polarity <> 0"), t).join(both.select(*KEY), list(KEY), "left_semi")
    # The best of a group as a minimum, which combines before the shuffle.
    order = F.struct((-rank_of(F.col("confidence_band"))).alias("r"), (-F.col("polarity")).alias("p"), "claim_id", "extractor", "confidence_band")
    best = standing.groupBy(*KEY).agg(F.min(order).alias("w"))
    return best.select(*KEY, F.when(F.col("w.p") == -1, "YES").otherwise("NO").alias("verdict"), "w.claim_id", "w.extractor", "w.confidence_band")


def contradiction_counts(claims: DataFrame, system_prefix: str = "system.") -> DataFrame:
    """Of each subject: how many polarity contradictions and denials it has, without making the pairs: on one
    relation each positive claim contradicts each negative one."""
    system = (F.col("polarity") == 1) & F.col("extractor").startswith(system_prefix)
    one = claims.groupBy(*KEY).agg(
        F.count_if(F.col("polarity") == 1).alias("yes"), F.count_if(F.col("polarity") == -1).alias("no"), F.count_if(system).alias("logged")
    )
    both = one.where("no > 0 and yes > 0").groupBy("src")
    return both.agg(F.sum(F.col("yes") * F.col("no")).alias("n_polarity"), F.sum(F.col("logged") * F.col("no")).alias("n_denials"))


def verdict_scores(claims: DataFrame) -> DataFrame:
    """Points of each subject: 3 a polarity contradiction, 2 a temporal one, 2 a denial; and a label."""
    counted = contradiction_counts(claims).select("src", (3 * F.col("n_polarity") + 2 * F.col("n_denials")).alias("points"))
    points = counted.unionByName(temporal_contradictions(claims).groupBy("src").agg((2 * F.count("*")).alias("points")))
    label = F.when(F.col("score") >= 5, "VERY HIGH").when(F.col("score") >= 3, "HIGH").otherwise("elevated")
    return points.groupBy("src").agg(F.sum("points").alias("score")).withColumn("label", label)


def resolve_aliases(claims: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Canonical names of some columns: an alias of the claim's namespace, else of all ('*')."""
    for c in columns:
        own = aliases.select(F.col("alias").alias(c), "namespace", F.col("canonical_name").alias("_own"))
        any_ = aliases.where("namespace = '*'").select(F.col("alias").alias(c), F.col("canonical_name").alias("_any"))
        claims = claims.join(own, [c, "namespace"], "left").join(any_, c, "left").withColumn(c, F.coalesce("_own", "_any", c)).drop("_own", "_any")
    return claims


def with_policy(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims whose relation has a policy: of their namespace, else of all ('*')."""
    fields = ("overlap_allowed", "missing_time_severity")
    own = policies.select("rel_type", "namespace", *(F.col(c).alias(f"_own_{c}") for c in fields))
    any_ = policies.where("namespace = '*'").select("rel_type", *(F.col(c).alias(f"_any_{c}") for c in fields))
    df = claims.join(own, ["rel_type", "namespace"], "left").join(any_, "rel_type", "left")
    df = df.withColumns({c: F.coalesce(f"_own_{c}", f"_any_{c}") for c in fields})
    return df.where("overlap_allowed is not null").drop(*(f"_{s}_{c}" for c in fields for s in ("own", "any")))


def _contenders(claims: DataFrame, aliases: DataFrame, policies: DataFrame) -> DataFrame:
    scanned = claims.where("polarity = 1 and modality in ('asserted', 'reported')")
    return with_policy(resolve_aliases(scanned, aliases), policies)


SCOPE = ("namespace", "src", "rel_type")


def _timed() -> Column:
    """Whether the claims a and b both have a time."""
    return F.expr("(valid_from_a is not null or valid_to_a is not null) and (valid_from_b is not null or valid_to_b is not null)")


def _meet() -> Column:
    """Whether the windows of a and b meet, open ends reaching for ever."""
    starts = [F.coalesce(f"valid_from_{s}", F.lit(float("-inf"))) for s in "ab"]
    ends = [F.coalesce(f"valid_to_{s}", F.lit(float("inf"))) for s in "ab"]
    return (ends[0] >= starts[1]) & (ends[1] >= starts[0])


def conflicted(claims: DataFrame, aliases: DataFrame, policies: DataFrame) -> DataFrame:
    """claim_id of the claims that take part in any scoped conflict: a semi join, which stops at the first
    rival of a claim and makes no pairs."""
    df = _contenders(claims, aliases, policies).where("not overlap_allowed")
    columns = ("claim_id", "dst", "valid_from", "valid_to")
    a, b = _side(df, "a", SCOPE, columns), _side(df, "b", tuple(F.col(c).alias(f"{c}_b") for c in SCOPE), columns)
    same = [F.col(c) == F.col(f"{c}_b") for c in SCOPE]
    return a.join(b, [*same, F.expr("dst_a <> dst_b"), ~_timed() | _meet()], "left_semi").select(F.col("claim_id_a").alias("claim_id")).distinct()


def scoped_conflicts(claims: DataFrame, aliases: DataFrame, policies: DataFrame) -> DataFrame:
    """Pairs of claims on different objects of a relation that allows one, with severity and reasons.

    Pairs with times on both sides conflict where the windows meet (high); where they do not, the
    later one succeeds the earlier and nothing is reported.  A missing time has the policy's severity.
    """
    df = _contenders(claims, aliases, policies).where("not overlap_allowed")
    keys = SCOPE
    columns = ("claim_id", "dst", "valid_from", "valid_to", "missing_time_severity", "source_memory_rid")
    pairs = _side(df, "a", keys, columns).join(_side(df, "b", keys, columns), list(keys)).where("claim_id_a < claim_id_b and dst_a <> dst_b")
    timed, meet = _timed(), _meet()
    severity = F.when(timed, "high").otherwise(F.col("missing_time_severity_a"))
    second = F.when(timed, "overlapping_validity_windows").otherwise("missing_temporal_qualifier")
    return pairs.where(~timed | meet).select(
        *keys, "claim_id_a", "claim_id_b", "dst_a", "dst_b", severity.alias("severity"),
        F.array(F.lit("same_subject_same_relation_distinct_object"), second).alias("reason_codes"),
    )


def claim_status(claims: DataFrame, aliases: DataFrame, policies: DataFrame, now: float) -> DataFrame:
    """The status of each claim, the first that holds: conflicted, superseded (a later claim of the
    subject and relation begins at or after its end), historical (ended), low_confidence,
    uncorroborated (one source for the relation), active."""
    ids = conflicted(claims, aliases, policies).withColumn("_conflicted", F.lit(True))
    # The latest begin of a subject and relation, and the sources of each claim's key, as plain aggregates.
    last = claims.groupBy("namespace", "src", "rel_type").agg(F.max("valid_from").alias("_last"))
    sources = claims.groupBy(*KEY).agg(F.countDistinct("source_memory_rid").alias("_sources"))
    df = claims.join(ids, "claim_id", "left").join(last, ["namespace", "src", "rel_type"]).join(sources, list(KEY))
    status = (
        F.when(F.col("_conflicted"), "conflicted")
        .when(F.col("valid_to") <= F.col("_last"), "superseded")
        .when(F.col("valid_to") < now, "historical")
        .when(F.col("confidence_band") == "low", "low_confidence")
        .when(F.col("_sources") <= 1, "uncorroborated")
        .otherwise("active")
    )
    return df.select("claim_id", status.alias("status"))


def ambiguous(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """claims with ``ambiguous``: whether an end is an alias of more than one canonical name."""
    many = aliases.groupBy("alias").agg(F.countDistinct("canonical_name").alias("n")).where("n > 1")
    for c in ("src", "dst"):
        claims = claims.join(many.select(F.col("alias").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    return claims.withColumn("ambiguous", F.coalesce("_src", "_dst", F.lit(False))).drop("_src", "_dst")


def pair_codes(claims: DataFrame, policies: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """All pairs of claims of one subject and relation, with the codes that tell how they stand to each other.

    Codes of policies (``multi_valued_relation_policy``, ``possible_temporal_succession``) and of aliases
    (``entity_link_ambiguous``) need those tables.
    """
    keys = ("src", "rel_type")
    columns = ["claim_id", "namespace", "dst", "polarity", "modality", "confidence_band", "source_memory_rid", "extractor", "valid_from", "valid_to"]
    more = []
    if policies is not None:
        claims = claims.join(with_policy(claims, policies).select("claim_id", "overlap_allowed"), "claim_id", "left")
        more.append((F.expr("overlap_allowed_a and overlap_allowed_b and dst_a <> dst_b"), "multi_valued_relation_policy"))
        more.append((F.expr("dst_a <> dst_b and polarity_a = 1 and polarity_b = 1") & _timed() & ~_meet(), "possible_temporal_succession"))
        columns.append("overlap_allowed")
    if aliases is not None:
        claims = ambiguous(claims, aliases)
        more.append((F.expr("ambiguous_a or ambiguous_b"), "entity_link_ambiguous"))
        columns.append("ambiguous")
    pairs = _side(claims, "a", keys, columns).join(_side(claims, "b", keys, columns), list(keys)).where("claim_id_a < claim_id_b")

    def code(condition: str, name: str) -> Column:
        return F.when(F.expr(condition), name)

    alike = "dst_a = dst_b and polarity_a = polarity_b and polarity_a <> 0"
    codes = F.array(
        code("dst_a <> dst_b and polarity_a = 1 and polarity_b = 1", "same_subject_same_relation_distinct_object"),
        code("dst_a = dst_b and polarity_a * polarity_b = -1", "negation_detected"),
        code("modality_a <> modality_b", "modality_mismatch"),
        code("namespace_a <> namespace_b", "cross_namespace_coexistence"),
        code(f"{alike} and source_memory_rid_a <> source_memory_rid_b", "corroborated_multi_source"),
        code(f"{alike} and source_memory_rid_a = source_memory_rid_b and extractor_a = extractor_b", "self_reinforcing_duplicate_skipped"),
        code("'low' in (confidence_band_a, confidence_band_b)", "low_relation_extraction_confidence"),
        *(F.when(condition, name) for condition, name in more),
    )
    return pairs.select(*keys, "claim_id_a", "claim_id_b", F.filter(codes, lambda x: x.isNotNull()).alias("codes"))


# Relations whose contradictions matter most, and those of preference.
IDENTITY = ("works_at", "lives_in", "birthday", "spouse")
PREFERENCE = ("likes", "favorite", "prefers", "dislikes")


def value_conflicts(edges: DataFrame) -> DataFrame:
    """Pairs of different values of one (src, rel_type), with type and priority by relation."""
    one = edges.select("src", "rel_type", F.col("dst").alias("dst_a")).distinct()
    two = edges.select("src", "rel_type", F.col("dst").alias("dst_b")).distinct()
    kind = F.when(F.col("rel_type").isin(*IDENTITY), "identity_fact").when(F.col("rel_type").isin(*PREFERENCE), "preference").otherwise("minor")
    priority = F.when(F.col("conflict_type") == "identity_fact", "high").when(F.col("conflict_type") == "preference", "medium").otherwise("low")
    return one.join(two, ["src", "rel_type"]).where("dst_a < dst_b").withColumn("conflict_type", kind).withColumn("priority", priority)


def find_conflicts(
    conflicts: DataFrame, status: str | None = None, conflict_type: str | None = None, entity: str | None = None,
    priority: str | None = None, limit: int = 50, order: tuple[str, ...] = ("src",), namespace: str | None = None,
) -> DataFrame:
    """The first conflicts that pass all filters given."""
    given = (("status", status), ("conflict_type", conflict_type), ("src", entity), ("priority", priority), ("namespace", namespace))
    for column, value in given:
        if value is not None:
            conflicts = conflicts.where(F.col(column) == value)
    return conflicts.orderBy(*order).limit(limit)


def resolve(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """memories after decisions (memory_a, memory_b, strategy): keep_a and keep_b tombstone the other
    memory, merge both, keep_both none.  A tombstone stays, whatever else is decided."""
    gone = (
        F.when(F.col("strategy") == "keep_a", F.array("memory_b"))
        .when(F.col("strategy") == "keep_b", F.array("memory_a"))
        .when(F.col("strategy") == "merge", F.array("memory_a", "memory_b"))
    )
    losers = decisions.select(F.explode(gone).alias("rid")).distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone"), "tombstoned").otherwise(F.col("consolidation_status"))
    return memories.join(losers, "rid", "left").withColumn("consolidation_status", status).drop("_gone")


def merged_memories(memories: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """The new memory of each merge (memory_a, memory_b, strategy merge): both texts, the larger importance and
    half-life, the mean valence, the namespace of the first; active."""
    parts = ("text", "importance", "valence", "half_life", "namespace")
    pairs = decisions.where("strategy = 'merge'").select("memory_a", "memory_b").distinct()
    for s in "ab":
        pairs = pairs.join(memories.select(F.col("rid").alias(f"memory_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in parts)), f"memory_{s}")
    return pairs.select(
        F.concat(F.lit("merge-"), "memory_a", F.lit("-"), "memory_b").alias("rid"), F.concat_ws(" | ", "text_a", "text_b").alias("text"),
        F.greatest("importance_a", "importance_b").alias("importance"), ((F.col("valence_a") + F.col("valence_b")) / 2).alias("valence"),
        F.greatest("half_life_a", "half_life_b").alias("half_life"), F.col("namespace_a").alias("namespace"), F.lit(now).alias("created_at"),
        F.lit("active").alias("consolidation_status"), F.array("memory_a", "memory_b").alias("merged_from"),
    )


def settle(conflicts: DataFrame, decisions: DataFrame, status: str) -> DataFrame:
    """conflicts (conflict_id, status, ...) with some open ones (conflict_id) resolved or dismissed; a settled
    conflict stays as it is."""
    hit = decisions.select("conflict_id").distinct().withColumn("_hit", F.lit(True))
    now = F.when(F.col("_hit") & (F.col("status") == "open"), status).otherwise(F.col("status"))
    return conflicts.join(hit, "conflict_id", "left").withColumn("status", now).drop("_hit")


def reclassify(conflicts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conflicts with the types that some were given (conflict_id, to, category), and what that teaches: both
    values are members of the category, to be upserted among its tokens."""
    new = changes.select("conflict_id", F.col("to").alias("_to"))
    out = conflicts.join(new, "conflict_id", "left").withColumn("conflict_type", F.coalesce("_to", "conflict_type")).drop("_to")
    told = conflicts.join(changes.where("category is not null"), "conflict_id").select("category", F.explode(F.array("dst_a", "dst_b")).alias("token"))
    return out, told.distinct().select("category", "token", F.lit(0.8).alias("confidence"), F.lit("learned").alias("source"))


def with_texts(conflicts: DataFrame, memories: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """conflicts (memory_a, memory_b, ...) with what both memories say: two left joins."""
    for s in "ab":
        conflicts = conflicts.join(memories.select(F.col("rid").alias(f"memory_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns)), f"memory_{s}", "left")
    return conflicts
