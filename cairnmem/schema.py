"""Logical tables, allowed values and defaults.

Times are seconds since 1970 as DOUBLE, vectors are ARRAY<FLOAT> or ARRAY<DOUBLE>, open ends of
validity are NULL.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86400.0

# Allowed values of enumerations.
MEMORY_TYPES = ("episodic", "semantic", "procedural")
STATUSES = ("active", "consolidated", "tombstoned")
TIERS = ("hot", "warm", "cold")
MODALITIES = ("asserted", "reported", "hypothetical", "denied", "quoted")
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
TRAITS = ("warmth", "energy", "depth", "attentiveness")

# The columns of the tables.
MEMORY = (
    "rid string, type string, text string, created_at double, importance double, valence double, half_life double, "
    "last_access double, access_count bigint, consolidation_status string, storage_tier string, consolidated_into string, "
    "metadata string, namespace string, certainty double, domain string, source string, emotional_state string, "
    "embedding array<double>"
)
EDGE = "src string, dst string, rel_type string, weight double, created_at double, edge_id string, tombstoned boolean"
CLAIM = (
    "claim_id string, src string, dst string, rel_type string, weight double, polarity int, modality string, namespace string, "
    "valid_from double, valid_to double, extractor string, extractor_version string, confidence_band string, "
    "source_memory_rid string, span_start int, span_end int"
)
OPLOG = "op_id string, op_type string, timestamp double, target_rid string, payload string, actor_id string, hlc bigint, origin_actor string"

# What a record takes where the caller gives nothing.
MEMORY_DEFAULTS = {
    "type": "episodic",
    "importance": 0.5,
    "valence": 0.0,
    "half_life": 604800.0,
    "metadata": "{}",
    "namespace": "default",
    "certainty": 0.8,
    "domain": "general",
    "source": "user",
}
CLAIM_DEFAULTS = {
    "polarity": 1,
    "modality": "asserted",
    "namespace": "default",
    "extractor": "manual",
    "confidence_band": "medium",
    "weight": 1.0,
}


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with each default where its column is null or missing."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    )
