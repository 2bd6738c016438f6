"""The logical tables in DuckDB SQL, as common table expressions for the queries' oracles."""

from cairnmem.sources.tables import NOW

_AT = "(epoch_us(ts) / 1000000.0::double)"

MEMORIES = f"""
memories AS (
    SELECT event_id AS seq, 'm' || event_id AS rid,
        CASE WHEN event_id % 10 = 0 THEN 'procedural' WHEN event_id % 10 <= 3 THEN 'semantic' ELSE 'episodic' END AS type,
        event_type || ' by user ' || user_id AS text, {_AT} AS created_at, least(value / 100, 1.0::double) AS importance,
        (event_id * 7919 % 2001 - 1000) / 1000.0::double AS valence, 604800.0::double * (1 + event_id % 4) AS half_life,
        least({_AT} + (event_id % 5) * 86400.0::double, {NOW}::double) AS last_access, event_id % 7 AS access_count,
        CASE WHEN event_id % 23 = 0 THEN 'tombstoned' WHEN event_id % 19 = 0 THEN 'consolidated' ELSE 'active' END AS consolidation_status,
        CASE WHEN event_id % 11 = 0 THEN 'cold' ELSE 'hot' END AS storage_tier, props AS metadata, 'u' || (user_id % 10) AS namespace,
        0.5::double + (event_id % 6) / 10.0::double AS certainty, event_type AS domain,
        CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'inference' ELSE 'system' END AS source,
        'customer' || user_id AS entity, 's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
        embedding::double[] AS embedding, label
    FROM events LEFT JOIN embeddings ON event_id = vec_id
),
active AS (SELECT * FROM memories WHERE consolidation_status = 'active'),
visible AS (SELECT * FROM active WHERE storage_tier <> 'cold'),
q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0)
"""

COSINE = "(list_dot_product(embedding, v) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v, v))))"

SCORED = f"""
parts AS (
    SELECT visible.*, {COSINE} AS sim, {NOW}::double - created_at AS age FROM visible, q WHERE embedding IS NOT NULL
),
signals AS (
    SELECT *, importance * pow(2.0::double, -age / half_life) AS decay, exp(-age / 604800.0::double) AS recency,
        1 / (1 + exp(-12 * (sim - 0.25::double))) * 0.8::double * importance AS amplified FROM parts
)
"""

EDGE_LOG = """
edge_log AS (
    SELECT 'customer' || o_custkey AS src, 'part' || l_partkey AS dst, 'ordered' AS rel_type, l_quantity AS weight,
        epoch_us(l_shipdate) / 1000000.0::double AS wrote, l_orderkey * 10 + l_linenumber AS nth
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
place_edges AS (
    SELECT 'customer' || c_custkey AS src, 'nation' || c_nationkey AS dst, 'located_in' AS rel_type, 1.0::double AS weight FROM customer
    UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey, 'located_in', 1.0::double FROM supplier
    UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey, 'located_in', 1.0::double FROM nation
)
"""

CLAIMS = """
claims AS (
    SELECT l_orderkey * 10 + l_linenumber AS claim_id, 'part' || l_partkey AS src, 'supplied_ok' AS rel_type, o_orderstatus AS dst,
        CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS polarity,
        CASE l_linenumber WHEN 3 THEN 'reported' WHEN 5 THEN 'hypothetical' ELSE 'asserted' END AS modality,
        'n' || (l_partkey % 5) AS namespace,
        CASE WHEN l_linenumber <> 6 THEN epoch_us(l_shipdate) / 1000000.0::double END AS valid_from,
        CASE WHEN l_linenumber < 6 THEN epoch_us(l_shipdate) / 1000000.0::double + 30 * 86400.0::double END AS valid_to,
        CASE WHEN l_suppkey % 10 = 0 THEN 'system.' ELSE '' END || 'supplier' || l_suppkey AS extractor,
        CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'medium' ELSE 'high' END AS confidence_band,
        'm' || l_orderkey AS source_memory_rid
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""

OPLOG = """
oplog AS (
    SELECT 'op' || lpad(event_id::varchar, 12, '0') AS op_id,
        CASE event_type WHEN 'error' THEN 'forget' WHEN 'click' THEN 'update' ELSE 'record' END AS op_type,
        epoch_us(ts) AS hlc, 'm' || (event_id % 997) AS target_rid, 'device' || (user_id % 3) AS origin_actor,
        value AS importance, props AS payload
    FROM events
)
"""


def given(*tables: str, body: str) -> str:
    """A statement over some of the tables above."""
    return "WITH " + ", ".join(t.strip() for t in tables) + body
