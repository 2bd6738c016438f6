"""Claim, conflict and graph queries over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.functions import extraction, vectors
from cairnmem.operators import claims as c
from cairnmem.operators import graph
from cairnmem.plans.registry import query
from cairnmem.plans.sql import CLAIMS, EDGE_LOG, MEMORIES, given
from cairnmem.sources import tables

#: A time at which claims stand (1998-07-01), and the present of the claims.
THEN, PRESENT = 899251200.0, 1009843200.0

_PAIRS = """
polarity_pairs AS (
    SELECT p.namespace, p.src, p.rel_type, p.dst, p.claim_id AS claim_id_pos, n.claim_id AS claim_id_neg, p.extractor AS extractor_pos, n.extractor AS extractor_neg
    FROM claims p JOIN claims n USING (namespace, src, rel_type, dst) WHERE p.polarity = 1 AND n.polarity = -1
),
temporal_pairs AS (
    SELECT a.namespace, a.src, a.rel_type, a.dst, a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, abs(a.valid_to - b.valid_to) / 60 AS gap_minutes
    FROM claims a JOIN claims b USING (namespace, src, rel_type, dst)
    WHERE a.claim_id < b.claim_id AND a.polarity = 1 AND b.polarity = 1 AND a.valid_from IS NOT NULL AND a.valid_to IS NOT NULL AND b.valid_from IS NOT NULL
        AND b.valid_to IS NOT NULL AND a.valid_to >= b.valid_from AND b.valid_to >= a.valid_from AND abs(a.valid_to - b.valid_to) > 900
),
denial_pairs AS (
    SELECT d.src, d.dst, d.claim_id AS claim_id_denial, s.claim_id AS claim_id_system, s.extractor AS extractor_system
    FROM claims d JOIN claims s USING (namespace, src, rel_type, dst) WHERE d.polarity = -1 AND s.polarity = 1 AND s.extractor LIKE 'system.%'
)
"""


@query(given(CLAIMS, _PAIRS, body="SELECT src, dst, claim_id_pos, claim_id_neg, extractor_pos, extractor_neg FROM polarity_pairs"))
def polarity_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.polarity_contradictions(tables.claims(spark, sf_dir))
    return found.select("src", "dst", "claim_id_pos", "claim_id_neg", "extractor_pos", "extractor_neg")


@query(given(CLAIMS, _PAIRS, body="SELECT src, dst, claim_id_a, claim_id_b, round(gap_minutes, 3) AS gap_minutes FROM temporal_pairs"))
def temporal_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.temporal_contradictions(tables.claims(spark, sf_dir))
    return found.select("src", "dst", "claim_id_a", "claim_id_b", F.round("gap_minutes", 3).alias("gap_minutes"))


@query(given(CLAIMS, _PAIRS, body="SELECT src, dst, claim_id_denial, claim_id_system, extractor_system FROM denial_pairs"))
def presence_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.presence_denials(tables.claims(spark, sf_dir)).select("src", "dst", "claim_id_denial", "claim_id_system", "extractor_system")


@query(
    given(
        CLAIMS, _PAIRS,
        body="""
        , points AS (SELECT src, 3 AS p FROM polarity_pairs UNION ALL SELECT src, 2 FROM temporal_pairs UNION ALL SELECT src, 2 FROM denial_pairs)
        SELECT src, sum(p)::bigint AS score, CASE WHEN sum(p) >= 5 THEN 'VERY HIGH' WHEN sum(p) >= 3 THEN 'HIGH' ELSE 'elevated' END AS label FROM points GROUP BY src""",
    )
)
def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.verdict_scores(tables.claims(spark, sf_dir))


@query(given(CLAIMS, _PAIRS, body="SELECT src, count(*) AS n FROM polarity_pairs GROUP BY src ORDER BY n DESC, src LIMIT 20"))
def contradictions_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = c.contradiction_counts(tables.claims(spark, sf_dir))
    return found.select("src", F.col("n_polarity").alias("n")).orderBy(F.desc("n"), "src").limit(20)


@query(given(CLAIMS, body=f"SELECT claim_id, src, dst, polarity, extractor FROM claims WHERE valid_from <= {THEN} AND (valid_to IS NULL OR {THEN} < valid_to)"))
def claims_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.as_of(tables.claims(spark, sf_dir), THEN).select("claim_id", "src", "dst", "polarity", "extractor")


@query(given(CLAIMS, body=f"SELECT namespace, count(*) AS n FROM claims WHERE valid_from <= {THEN} GROUP BY namespace"))
def claims_known_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.known_by(tables.claims(spark, sf_dir), THEN).groupBy("namespace").agg(F.count("*").alias("n"))


@query(
    given(
        CLAIMS,
        body=f"""
        , times AS (SELECT DISTINCT src, rel_type, {THEN}::double + k * 7776000.0::double AS t FROM claims, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE namespace = 'n1'),
        met AS (
            SELECT src, rel_type, t, claim_id, dst, polarity, row_number() OVER (PARTITION BY src, rel_type, t ORDER BY valid_from DESC, claim_id DESC) AS r
            FROM times JOIN claims USING (src, rel_type) WHERE valid_from <= t AND (valid_to IS NULL OR t < valid_to)
        )
        SELECT src, t, claim_id, dst, polarity FROM met WHERE r = 1""",
    )
)
def claims_as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed at each of several times: a range join."""
    all_ = tables.claims(spark, sf_dir)
    step = F.explode(F.array(*[F.lit(THEN + k * 7776000.0) for k in range(4)])).alias("t")
    times = all_.where("namespace = 'n1'").select("src", "rel_type").distinct().select("src", "rel_type", step)
    return c.as_of_each(times, all_).select("src", "t", "claim_id", "dst", "polarity")


@query(
    given(
        CLAIMS,
        body=f"""
        , standing AS (
            SELECT *, row_number() OVER (PARTITION BY namespace, src, rel_type, dst ORDER BY CASE confidence_band WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
                polarity DESC, claim_id) AS r
            FROM claims WHERE polarity <> 0 AND valid_from <= {THEN} AND (valid_to IS NULL OR {THEN} < valid_to) AND (namespace, src, rel_type, dst) IN (
                SELECT namespace, src, rel_type, dst FROM claims WHERE polarity <> 0 GROUP BY ALL HAVING count(DISTINCT polarity) = 2)
        )
        SELECT src, dst, CASE polarity WHEN 1 THEN 'YES' ELSE 'NO' END AS verdict, claim_id, extractor FROM standing WHERE r = 1""",
    )
)
def reconcile_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.reconcile(tables.claims(spark, sf_dir), THEN).select("src", "dst", "verdict", "claim_id", "extractor")


@query(
    given(
        CLAIMS,
        body="""SELECT namespace, src, dst, count(*) AS n_claims, count(*) FILTER (polarity = 1) AS n_positive, count(*) FILTER (polarity = -1) AS n_negative,
            list_aggregate(list_sort(list_distinct(list(extractor))), 'string_agg', ',') AS extractors FROM claims GROUP BY ALL""",
    )
)
def claims_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ledger(tables.claims(spark, sf_dir)).withColumn("extractors", F.array_join("extractors", ",")).drop("rel_type")


@query(
    given(
        CLAIMS,
        body="SELECT claim_id FROM claims QUALIFY row_number() OVER (PARTITION BY src, dst, rel_type, extractor, polarity, namespace ORDER BY claim_id DESC) = 1",
    )
)
def claims_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.latest(tables.claims(spark, sf_dir)).select("claim_id")


@query(given(CLAIMS, body="SELECT claim_id, src, dst FROM claims WHERE (src = 'part7' OR dst = 'part7') AND namespace = 'n2'"))
def claims_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.of_entity(tables.claims(spark, sf_dir), "part7", "n2").select("claim_id", "src", "dst")


_ALIASES = "aliases(alias, canonical_name, namespace) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{n}')" for a, b, n in tables.ALIASES) + ")"

_SCOPED = """
scanned AS (SELECT * FROM claims WHERE polarity = 1 AND modality IN ('asserted', 'reported') AND namespace <> 'n3'),
conflict_pairs AS (
    SELECT a.namespace, a.src, a.rel_type, a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, a.dst AS dst_a, b.dst AS dst_b,
        (a.valid_from IS NOT NULL OR a.valid_to IS NOT NULL) AND (b.valid_from IS NOT NULL OR b.valid_to IS NOT NULL) AS timed,
        coalesce(a.valid_to, 'infinity'::double) >= coalesce(b.valid_from, '-infinity'::double)
            AND coalesce(b.valid_to, 'infinity'::double) >= coalesce(a.valid_from, '-infinity'::double) AS meet
    FROM scanned a JOIN scanned b USING (namespace, src, rel_type) WHERE a.claim_id < b.claim_id AND a.dst <> b.dst
),
conflicts AS (
    SELECT *, CASE WHEN timed THEN 'high' ELSE 'medium' END AS severity, 'same_subject_same_relation_distinct_object,'
        || CASE WHEN timed THEN 'overlapping_validity_windows' ELSE 'missing_temporal_qualifier' END AS reason_codes
    FROM conflict_pairs WHERE NOT timed OR meet
)
"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scoped_conflicts(tables.claims(spark, sf_dir), tables.aliases(spark), tables.policies(spark))


@query(given(CLAIMS, _SCOPED, body="SELECT src, claim_id_a, claim_id_b, dst_a, dst_b, severity, reason_codes FROM conflicts"))
def scoped_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scoped(spark, sf_dir).withColumn("reason_codes", F.array_join("reason_codes", ","))
    return found.select("src", "claim_id_a", "claim_id_b", "dst_a", "dst_b", "severity", "reason_codes")


@query(
    given(
        CLAIMS, _SCOPED,
        body="""
        SELECT src, claim_id_a, claim_id_b, dst_a, dst_b FROM conflicts WHERE severity = 'high' ORDER BY src, claim_id_a, claim_id_b LIMIT 50""",
    )
)
def conflicts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scoped(spark, sf_dir).withColumnRenamed("severity", "priority")
    best = c.find_conflicts(found, priority="high", order=("src", "claim_id_a", "claim_id_b"))
    return best.select("src", "claim_id_a", "claim_id_b", "dst_a", "dst_b")


@query(
    given(
        CLAIMS, _SCOPED,
        body="""
        SELECT x.claim_id_a, x.claim_id_b, a.source_memory_rid AS memory_a, b.source_memory_rid AS memory_b, a.extractor AS extractor_a, b.extractor AS extractor_b
        FROM conflicts x LEFT JOIN claims a ON a.claim_id = claim_id_a LEFT JOIN claims b ON b.claim_id = claim_id_b""",
    )
)
def conflict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts with what both sides rest on: two left joins."""
    found = _scoped(spark, sf_dir).select("claim_id_a", "claim_id_b")
    for s in "ab":
        side = tables.claims(spark, sf_dir).select(F.col("claim_id").alias(f"claim_id_{s}"), F.col("source_memory_rid").alias(f"memory_{s}"), F.col("extractor").alias(f"extractor_{s}"))
        found = found.join(side, f"claim_id_{s}", "left")
    return found.select("claim_id_a", "claim_id_b", "memory_a", "memory_b", "extractor_a", "extractor_b")


@query(
    given(
        CLAIMS, _SCOPED,
        body=f"""
        , conflicted AS (SELECT claim_id_a AS claim_id FROM conflicts UNION SELECT claim_id_b FROM conflicts)
        SELECT claim_id, CASE WHEN claim_id IN (SELECT claim_id FROM conflicted) THEN 'conflicted'
            WHEN valid_to <= max(valid_from) OVER (PARTITION BY namespace, src, rel_type) THEN 'superseded' WHEN valid_to < {PRESENT} THEN 'historical'
            WHEN confidence_band = 'low' THEN 'low_confidence' WHEN sources <= 1 THEN 'uncorroborated' ELSE 'active' END AS status
        FROM claims JOIN (SELECT namespace, src, rel_type, dst, count(DISTINCT source_memory_rid) AS sources FROM claims GROUP BY ALL) USING (namespace, src, rel_type, dst)""",
    )
)
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.claim_status(tables.claims(spark, sf_dir), tables.aliases(spark), tables.policies(spark), PRESENT)


@query(
    given(
        CLAIMS,
        body="""
        , p AS (SELECT a.dst = b.dst AS same, a.polarity AS x, b.polarity AS y, a.modality <> b.modality AS m, a.namespace <> b.namespace AS n, a.source_memory_rid = b.source_memory_rid AS s,
            a.extractor = b.extractor AS e, a.confidence_band = 'low' OR b.confidence_band = 'low' AS l FROM claims a JOIN claims b USING (src, rel_type) WHERE a.claim_id < b.claim_id),
        codes AS (
            SELECT 'same_subject_same_relation_distinct_object' AS code, count(*) FILTER (NOT same AND x = 1 AND y = 1) AS n FROM p
            UNION ALL SELECT 'negation_detected', count(*) FILTER (same AND x * y = -1) FROM p UNION ALL SELECT 'modality_mismatch', count(*) FILTER (m) FROM p
            UNION ALL SELECT 'cross_namespace_coexistence', count(*) FILTER (n) FROM p
            UNION ALL SELECT 'corroborated_multi_source', count(*) FILTER (same AND x = y AND x <> 0 AND NOT s) FROM p
            UNION ALL SELECT 'self_reinforcing_duplicate_skipped', count(*) FILTER (same AND x = y AND x <> 0 AND s AND e) FROM p
            UNION ALL SELECT 'low_relation_extraction_confidence', count(*) FILTER (l) FROM p
        )
        SELECT code, n FROM codes WHERE n > 0""",
    )
)
def claim_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of claims each code holds for."""
    found = c.pair_codes(tables.claims(spark, sf_dir)).select(F.explode("codes").alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query(
    given(
        CLAIMS, _ALIASES,
        body="""
        , renamed AS (SELECT claim_id, CASE WHEN src = 'part1' THEN 'widget maker' WHEN src = 'part2' THEN 'ring maker' ELSE src END AS src, 'Status ' || dst AS dst, namespace FROM claims)
        SELECT claim_id, coalesce(o.canonical_name, g.canonical_name, r.src) AS src, coalesce(o2.canonical_name, g2.canonical_name, r.dst) AS dst
        FROM renamed r LEFT JOIN aliases o ON o.alias = r.src AND o.namespace = r.namespace LEFT JOIN aliases g ON g.alias = r.src AND g.namespace = '*'
        LEFT JOIN aliases o2 ON o2.alias = r.dst AND o2.namespace = r.namespace LEFT JOIN aliases g2 ON g2.alias = r.dst AND g2.namespace = '*'""",
    )
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.when(F.col("src") == "part1", "widget maker").when(F.col("src") == "part2", "ring maker").otherwise(F.col("src"))
    renamed = tables.claims(spark, sf_dir).select("claim_id", src.alias("src"), F.concat(F.lit("Status "), "dst").alias("dst"), "namespace")
    return c.resolve_aliases(renamed, tables.aliases(spark)).select("claim_id", "src", "dst")


@query(
    """WITH e AS (SELECT DISTINCT 'customer' || o_custkey AS src, CASE WHEN o_orderkey % 3 = 0 THEN 'likes' WHEN o_orderkey % 3 = 1 THEN 'works_at' ELSE 'ordered_as' END AS rel_type,
        o_orderpriority AS dst FROM orders)
    SELECT a.src, a.rel_type, a.dst AS dst_a, b.dst AS dst_b, CASE a.rel_type WHEN 'works_at' THEN 'identity_fact' WHEN 'likes' THEN 'preference' ELSE 'minor' END AS conflict_type,
        CASE a.rel_type WHEN 'works_at' THEN 'high' WHEN 'likes' THEN 'medium' ELSE 'low' END AS priority
    FROM e a JOIN e b ON a.src = b.src AND a.rel_type = b.rel_type AND a.dst < b.dst"""
)
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    kind = F.when(n == 0, "likes").when(n == 1, "works_at").otherwise("ordered_as")
    edges = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("customer"), "o_custkey").alias("src"), kind.alias("rel_type"), F.col("o_orderpriority").alias("dst"))
    return c.value_conflicts(edges)


@query(
    given(
        MEMORIES,
        body="""
        , decisions AS (SELECT rid AS memory_a, 'm' || (seq + 1) AS memory_b, CASE seq % 4 WHEN 0 THEN 'keep_a' WHEN 1 THEN 'keep_b' WHEN 2 THEN 'merge' ELSE 'keep_both' END AS strategy
            FROM memories WHERE seq % 13 = 0),
        losers AS (SELECT memory_b AS rid FROM decisions WHERE strategy IN ('keep_a', 'merge') UNION SELECT memory_a FROM decisions WHERE strategy IN ('keep_b', 'merge'))
        SELECT rid, CASE WHEN rid IN (SELECT rid FROM losers) THEN 'tombstoned' ELSE consolidation_status END AS consolidation_status FROM memories""",
    )
)
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.memories(spark, sf_dir).select("rid", "seq", "consolidation_status")
    n = F.col("seq") % 4
    strategy = F.when(n == 0, "keep_a").when(n == 1, "keep_b").when(n == 2, "merge").otherwise("keep_both")
    decisions = m.where("seq % 13 = 0").select(F.col("rid").alias("memory_a"), F.concat(F.lit("m"), F.col("seq") + 1).alias("memory_b"), strategy.alias("strategy"))
    return c.resolve(m, decisions).select("rid", "consolidation_status")


@query(
    """WITH n AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE 'c' || conv_id END AS src, role AS dst, CASE turn % 3 WHEN 0 THEN 'says_to' WHEN 1 THEN 'Says' ELSE 'x_1' END AS rel_type,
        CASE WHEN turn = 5 THEN 9 END AS polarity FROM conversations)
    SELECT conv_id, turn, CASE WHEN src = '' THEN 'src is empty' WHEN NOT regexp_matches(rel_type, '^[a-z_][a-z0-9_]*$') THEN 'rel_type is not a name'
        WHEN coalesce(polarity, 1) NOT IN (1, 0, -1) THEN 'polarity is unknown' ELSE 'accepted' END AS outcome FROM n"""
)
def claims_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which new claims are accepted, and why others are not."""
    t = F.col("turn")
    new = tables.turns(spark, sf_dir).select(
        "conv_id", "turn", F.when(t == 0, "").otherwise(F.concat(F.lit("c"), "conv_id")).alias("src"), F.col("role").alias("dst"),
        F.when(t % 3 == 0, "says_to").when(t % 3 == 1, "Says").otherwise("x_1").alias("rel_type"), F.when(t == 5, 9).alias("polarity"),
        F.lit(None).cast("double").alias("valid_from"), F.lit(None).cast("double").alias("valid_to"),
    )
    good, bad = c.ingest(new)
    return good.select("conv_id", "turn", F.lit("accepted").alias("outcome")).unionByName(bad.select("conv_id", "turn", F.col("reason").alias("outcome")))


# Sentences about a customer, a number from 0 to 5 each, and the claim that each holds: source, relation,
# object, polarity, modality.
_SENTENCES = (
    ("C{k} Chen works at Acme N{n}", "C{k} Chen|works_at|Acme N{n}|1|asserted"),
    ("some say C{k} Stone allegedly founded Blue N{n}", "C{k} Stone|founded|Blue N{n}|1|reported"),
    ("C{k} Diaz is not married to Dan N{n}.", "C{k} Diaz|married_to|Dan N{n}|-1|asserted"),
    ("Acme N{n}'s CEO, C{k} Reed", "C{k} Reed|ceo_of|Acme N{n}|1|asserted"),
    ("in time, then Acme C{k} acquired Blue N{n}", "Acme C{k}|acquired|Blue N{n}|1|asserted"),
    ("nothing about customer {k} of nation {n}", ""),
)


def _sql_text(form: str) -> str:
    return "'" + form.replace("'", "''").replace("{k}", "' || c_custkey || '").replace("{n}", "' || c_nationkey || '") + "'"


@query(
    " UNION ALL ".join(
        "SELECT c_custkey AS id, " + ", ".join(f"{_sql_text(v) if k != 'polarity' else v} AS {k}" for k, v in zip(("src", "rel_type", "dst", "polarity", "modality"), found.split("|"), strict=True))
        + f" FROM customer WHERE c_custkey % 6 = {i}"
        for i, (_, found) in enumerate(_SENTENCES) if found
    )
)
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims found in a sentence about every customer."""
    k, text = F.col("c_custkey"), F.lit(None).cast("string")
    for i, (form, _) in enumerate(_SENTENCES):
        said = F.replace(F.replace(F.lit(form), F.lit("{k}"), k.cast("string")), F.lit("{n}"), F.col("c_nationkey").cast("string"))
        text = F.when(k % 6 == i, said).otherwise(text)
    texts = tables.table(spark, sf_dir, "customer").select(k.alias("rid"), text.alias("text"))
    return extraction.extract(texts).select("id", "src", "rel_type", "dst", "polarity", "modality")


@query(
    given(
        EDGE_LOG,
        body="SELECT src, dst, rel_type, arg_max(weight, (wrote, nth)) AS weight FROM edge_log GROUP BY ALL",
    )
)
def edges_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as last written."""
    return graph.last_edges(tables.edge_log(spark, sf_dir)).select("src", "dst", "rel_type", "weight")


@query(given(EDGE_LOG, body="SELECT src, dst, rel_type FROM place_edges WHERE src = 'nation3' OR dst = 'nation3'"))
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(tables.place_edges(spark, sf_dir), "nation3").select("src", "dst", "rel_type")


@query(
    given(
        EDGE_LOG,
        body="""
        , ends AS (SELECT src AS name, wrote FROM edge_log UNION ALL SELECT dst, wrote FROM edge_log)
        SELECT name, count(*) AS mention_count, min(wrote) AS first_seen, max(wrote) AS last_seen FROM ends GROUP BY name""",
    )
)
def entities_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities(tables.edge_log(spark, sf_dir))


@query(
    given(
        EDGE_LOG,
        body="""
        , ends AS (SELECT src AS name FROM edge_log UNION ALL SELECT dst FROM edge_log)
        SELECT name, count(*) AS mention_count FROM ends WHERE lower(name) LIKE '%omer1%' GROUP BY name ORDER BY mention_count DESC, name LIMIT 20""",
    )
)
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_entities(graph.entities(tables.edge_log(spark, sf_dir)), "Omer1").select("name", "mention_count")


@query(
    given(
        EDGE_LOG,
        body="""
        , e AS (SELECT DISTINCT src, dst FROM edge_log), both_ways AS (SELECT src AS entity, dst AS other FROM e UNION SELECT dst, src FROM e)
        SELECT entity, count(DISTINCT other) AS degree FROM both_ways GROUP BY entity HAVING count(DISTINCT other) >= 5""",
    )
)
def entity_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(tables.edge_log(spark, sf_dir))


@query(
    given(
        EDGE_LOG,
        body="""
        SELECT a.src AS e0, a.dst AS e1, b.dst AS e2, c.dst AS e3 FROM (SELECT DISTINCT dst AS src, src AS dst FROM edge_log WHERE dst = 'part11') a
        JOIN place_edges b ON b.src = a.dst JOIN place_edges c ON c.src = b.dst""",
    )
)
def entity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, who ordered it, their nation, its region: a path of three joins."""
    places = tables.place_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    start = tables.edge_log(spark, sf_dir).where("dst = 'part11'").select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct()
    return graph.chain(start, places, places)


@query(
    given(
        EDGE_LOG,
        body="""
        , one AS (SELECT dst FROM place_edges WHERE src = 'supplier5'), two AS (SELECT dst FROM place_edges WHERE src IN (SELECT dst FROM one))
        SELECT 'supplier5' AS seed, 'supplier5' AS entity, 0 AS depth UNION ALL SELECT 'supplier5', dst, 1 FROM one UNION ALL SELECT 'supplier5', dst, 2 FROM two""",
    )
)
def reachable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("supplier5",)], "entity string")
    return graph.reachable(tables.place_edges(spark, sf_dir), seeds, 4)


_TYPES = r"""
    WITH names AS (
        SELECT n_name AS name, 'located_in' AS rel_type FROM nation UNION ALL SELECT r_name, 'owns' FROM region
        UNION ALL SELECT c_mktsegment, 'runs' FROM customer UNION ALL SELECT 'Sarah No' || c_custkey, 'works_at' FROM customer
        UNION ALL SELECT 'Bank Of ' || n_name, 'owns' FROM nation UNION ALL SELECT p_name, 'uses' FROM part UNION ALL SELECT 'spark', 'runs' FROM region),
    w AS (SELECT *, regexp_split_to_array(lower(name), '[^\p{L}0-9]+') AS words FROM names)
    SELECT name, CASE
        WHEN list_has_any(words, ['api', 'database', 'server', 'python', 'rust', 'spark', 'redis', 'docker', 'kubernetes', 'linux']) AND NOT contains(name, ' ') THEN 'tech'
        WHEN list_has_any(words, ['inc', 'corp', 'ltd', 'company', 'university', 'bank']) THEN 'organization'
        WHEN regexp_matches(name, '^[A-Z][A-Z0-9]{1,7}$') THEN 'tech'
        WHEN rel_type IN ('works_at', 'lives_in', 'married_to', 'parent_of', 'knows', 'manages', 'reports_to') THEN 'person'
        WHEN regexp_matches(name, '^[A-Z][a-z]+( [A-Z][a-z]+){0,2}$') THEN 'person' ELSE 'unknown' END AS entity_type FROM w
"""


@query(_TYPES)
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all names in several tables."""
    t = {name: tables.table(spark, sf_dir, name) for name in ("nation", "region", "customer", "part")}
    parts = (
        ("nation", F.col("n_name"), "located_in"), ("region", F.col("r_name"), "owns"), ("customer", F.col("c_mktsegment"), "runs"),
        ("customer", F.concat(F.lit("Sarah No"), "c_custkey"), "works_at"), ("nation", F.concat(F.lit("Bank Of "), "n_name"), "owns"), ("part", F.col("p_name"), "uses"),
        ("region", F.lit("spark"), "runs"),
    )
    out = None
    for table, name, relation in parts:
        own = t[table].select(name.alias("name"), graph.entity_type(name, F.lit(relation)).alias("entity_type"))
        out = own if out is None else out.unionByName(own)
    return out


@query(
    given(
        MEMORIES,
        body="""
        , names(name) AS (VALUES ('click'), ('user 8'), ('purchase event'), ('signup by user 14'))
        SELECT rid AS id, name FROM memories JOIN names ON ' ' || lower(text) || ' ' LIKE '% ' || lower(name) || ' %'""",
    )
)
def backfill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories linked with the entities that their texts name."""
    names = spark.createDataFrame([("click",), ("user 8",), ("purchase event",), ("signup by user 14",)], "name string")
    return graph.link_by_name(tables.memories(spark, sf_dir), names)


@query(
    """WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v)
    SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.e, b.e) / (a.l * b.l), 6) AS similarity
    FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.3"""
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of similar vectors, by blocks."""
    found = vectors.similar_pairs(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    given(
        MEMORIES,
        body="""
        , k AS (SELECT DISTINCT namespace, domain || ':' || type AS m FROM active)
        SELECT a.namespace AS a, b.namespace AS b, count(*) AS n FROM k a JOIN k b ON a.m = b.m AND a.namespace < b.namespace GROUP BY ALL""",
    )
)
def domain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that have kinds of memories in common, and how many."""
    kinds = tables.memories(spark, sf_dir).where("consolidation_status = 'active'").select("namespace", F.concat_ws(":", "domain", "type").alias("m"))
    return graph.overlapping(kinds, "namespace", "m")
